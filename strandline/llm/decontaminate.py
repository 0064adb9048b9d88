"""Benchmark decontamination by an FM-index for each training shard.

A shard is a run of documents inside one task. Its words become symbols: one for each word of the benchmark's
phrases, one separator for all others. Stretches of phrase words too short for any phrase cannot hold an
occurrence and are left out, with the separators between. Over what remains an FM-index is built: suffix array,
Burrows-Wheeler transform, its wavelet tree for rank, and every 16th suffix position. All phrases are searched
backward in step, each occurrence is located by walking to a sampled suffix, and the spans found are merged.

A benchmark beyond block_bytes is searched in blocks, one after the other: neither the driver nor a task ever holds more
than a block. What the blocks find is kept by text and merged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._common import Folder, discard, few, fresh, in_batches, scratch, ship, stored

_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
SAMPLE = 16
SHARD_BYTES = 6 << 20


def words(text: str | None) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters, A-Z lower-cased."""
    return text.encode().translate(_WORD).split() if text else []


class WaveletTree:
    """Rank over small integers: one bit plane for each bit, high to low, zeros kept before ones (matrix form)."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        cur = values
        for b in range(bits - 1, -1, -1):
            bit = ((cur >> b) & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(len(cur) - int(bit.sum()))
            cur = np.concatenate([cur[~bit], cur[bit]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before place i, for arrays of both."""
        start, end = np.zeros_like(i), i
        for level in range(self.bits):
            ones, z = self.ones[level], self.zeros[level]
            bit = (symbol >> (self.bits - 1 - level)) & 1
            s1, e1 = ones[start], ones[end]
            start = np.where(bit == 1, z + s1, start - s1)
            end = np.where(bit == 1, z + e1, end - e1)
        return end - start


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """By prefix doubling; seq ends in a unique smallest symbol."""
    n = len(seq)
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        second = np.zeros(n, dtype=np.int64)
        second[: n - k] = rank[k:] + 1 if k < n else 0
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.empty(n, dtype=np.int64)
        new[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = new
        if rank[order[-1]] == n - 1:
            return order
        k *= 2


class FMIndex:
    """Count and locate phrases in a sequence of symbols >= 1; symbol 0 is the end mark."""

    def __init__(self, seq: np.ndarray, sigma: int):
        text = np.append(seq, 0).astype(np.int64)
        sa = suffix_array(text)
        bwt = text[sa - 1]
        self.n = len(text)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.tree = WaveletTree(bwt, max(1, int(sigma - 1).bit_length()))
        self.bwt = bwt
        marked = sa % SAMPLE == 0
        self.marked = marked
        self.before = np.concatenate([[0], np.cumsum(marked)])
        self.samples = sa[marked]

    def ranges(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix range of each row of phrases (all of one length), by backward search."""
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), self.n, dtype=np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            live = np.flatnonzero(low < high)
            if not len(live):
                break
            c = phrases[live, k]
            low[live] = self.first[c] + self.tree.rank(c, low[live])
            high[live] = self.first[c] + self.tree.rank(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each suffix row, by stepping back to a sampled one."""
        out = np.zeros(len(rows), dtype=np.int64)
        steps = np.zeros(len(rows), dtype=np.int64)
        open_, rows = np.arange(len(rows)), rows.copy()
        while len(open_):
            here = rows[open_]
            done = self.marked[here]
            hit = open_[done]
            out[hit] = self.samples[self.before[rows[hit]]] + steps[hit]
            open_ = open_[~done]
            here = rows[open_]
            c = self.bwt[here]
            rows[open_] = self.first[c] + self.tree.rank(c, here)
            steps[open_] += 1
        return out


class Phrases:
    """The windows of a block of benchmark items: `window` consecutive words, or a shorter item whole."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.vocab: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], list[int]] = {}
        self.names: list[str | None] = []
        for name, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 2) for w in words(text)]
            if not ids:
                continue
            at = len(self.names)
            self.names.append(name)
            for k in range(max(1, len(ids) - window + 1)):
                own = owners.setdefault(tuple(ids[k : k + window]), [])
                if not own or own[-1] != at:
                    own.append(at)
        self.by_length: dict[int, tuple[np.ndarray, list[list[int]]]] = {}
        for n in sorted({len(p) for p in owners}):
            chosen = [p for p in owners if len(p) == n]
            self.by_length[n] = (np.array(chosen, dtype=np.int64), [owners[p] for p in chosen])
        self.shortest = min(self.by_length, default=0)

    def find(self, docs: list[list[bytes]]) -> list[tuple[np.ndarray, set[int]]]:
        """For each document of a shard: its hit words as merged [start, end) spans, and the items found in it."""
        out: list[tuple[np.ndarray, set[int]]] = [(np.zeros((0, 2), dtype=np.int64), set()) for _ in docs]
        if not self.by_length:
            return out
        get = self.vocab.get
        parts: list[np.ndarray] = []
        origin: list[np.ndarray] = []
        base = 0
        for d in docs:
            ids = np.fromiter((get(w, 1) for w in d), dtype=np.int64, count=len(d))
            edge = np.flatnonzero(np.diff(np.concatenate([[0], (ids > 1).astype(np.int8), [0]])))
            starts, ends = edge[0::2], edge[1::2]
            keep = ends - starts >= self.shortest
            for s, e in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True):
                parts += [ids[s:e], np.array([1])]
                origin.append(np.arange(base + s, base + e + 1))
            base += len(d)
        if not parts:
            return out
        seq, place = np.concatenate(parts), np.concatenate(origin)
        index = FMIndex(seq, len(self.vocab) + 2)
        firsts, lengths, who = [], [], []
        for n, (phrases, owners) in self.by_length.items():
            low, high = index.ranges(phrases)
            for k in np.flatnonzero(high > low).tolist():
                firsts.append(np.arange(low[k], high[k]))
                lengths.append(n)
                who.append(owners[k])
        if not firsts:
            return out
        at = place[index.locate(np.concatenate(firsts))]
        size = np.repeat(lengths, [len(x) for x in firsts])
        owner = np.repeat(np.arange(len(who)), [len(x) for x in firsts])
        bounds = np.cumsum([0, *(len(d) for d in docs)])
        doc = np.searchsorted(bounds, at, side="right") - 1
        order = np.lexsort((at, doc))
        cuts = np.flatnonzero(np.diff(doc[order])) + 1
        for group in np.split(order, cuts):
            d = int(doc[group[0]])
            spans = merged(at[group] - bounds[d], at[group] - bounds[d] + size[group])
            items: set[int] = set()
            for o in np.unique(owner[group]).tolist():
                items.update(who[o])
            out[d] = (spans, items)
        return out


def merged(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Union of [start, end) spans, as sorted disjoint rows; those that touch become one."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(s) - 1]])
    return np.stack([s[new], e[last]], axis=1)


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The benchmark's (name, text) in blocks of bounded text, read one partition at a time; at least one, if empty."""
    block: list[tuple[str | None, str | None]] = []
    size = 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("i"), "text").toLocalIterator():
        n = len((r["text"] or "").encode())
        if block and size + n > block_bytes:
            yield block
            block, size = [], 0
        block.append((r["i"], r["text"]))
        size += n
    yield block


def _shards(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Runs of whole documents of about SHARD_BYTES of text."""
    for b in batches:
        col, start, size, docs = b.column(b.schema.get_field_index(text)), 0, 0, []
        for k in range(b.num_rows):
            value = col[k].as_py()
            docs.append(words(value))
            size += len(value or "")
            if size >= SHARD_BYTES or k + 1 == b.num_rows:
                yield b.slice(start, k + 1 - start), docs
                start, size, docs = k + 1, 0, []


Found = tuple[np.ndarray, list[str]]


def _search(block: Broadcast, window: int) -> Callable[[list[list[bytes]]], list[Found]]:
    """shard -> per document (merged spans, names of the items found), for a block of phrases that is read once."""
    phrases: list[Phrases] = []

    def find(docs: list[list[bytes]]) -> list[Found]:
        if not phrases:
            phrases.append(Phrases(block.value, window))
        p = phrases[0]
        return [(spans, sorted({p.names[i] for i in items} - {None})) for spans, items in p.find(docs)]

    return find


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


def _listed(spans: np.ndarray) -> list[dict]:
    return [{"first": a, "end": b} for a, b in spans.tolist()]


def _by_text(docs: DataFrame, blocks: Iterator[list], window: int, at: Folder) -> DataFrame:
    """(key, names, spans) of the texts that hold a phrase, by the MD5 of the text; one pass over the texts for each block."""
    sc, parts = ship(docs.sparkSession).sparkContext, []
    for block in blocks:
        held = sc.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held: Broadcast = held) -> Iterator[pa.RecordBatch]:
            find = _search(held, window)
            for part, shard in _shards(batches, "text"):
                got = find(shard)
                hit = [k for k, (s, _) in enumerate(got) if len(s)]
                cols = [pa.array([got[k][1] for k in hit], pa.list_(pa.string())), pa.array([_listed(got[k][0]) for k in hit], _SPANS)]
                yield pa.RecordBatch.from_arrays([part.column(1).take(pa.array(hit, pa.int64())), *cols], names=["key", "names", "spans"])

        found = in_batches(docs.select("text", F.md5("text").alias("key")), run, "key string, names array<string>, spans array<struct<first:long,end:long>>")
        parts.append(at.stored(found.dropDuplicates(["key"])))
        held.destroy()
    every = reduce(DataFrame.unionAll, parts)
    rows = every.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"), F.flatten(F.collect_list("spans")).alias("spans"))
    return at.stored(in_batches(rows, _united, rows.schema))  # a text has a row for each block at most


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        both = [np.array([(s["first"], s["end"]) for s in x]) for x in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([_listed(merged(x[:, 0], x[:, 1])) for x in both], _SPANS)], names=b.schema.names)


def _one_or_more(benchmark: DataFrame, block_bytes: int) -> tuple[list | None, Iterator[list]]:
    """The only block, or None and all blocks."""
    blocks = _blocks(benchmark, block_bytes)
    first = next(blocks)
    second = next(blocks, None)
    return (first, iter(())) if second is None else (None, chain([first, second], blocks))


def _reports(docs: DataFrame, find_all: Callable) -> DataFrame:
    """The result of contamination(); find_all: (part, shard) -> what is found in each document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = find_all()
        for part, shard in _shards(batches, "text"):
            got = find(part, shard)
            hit = [int((s[:, 1] - s[:, 0]).sum()) for s, _ in got]
            names = [hashlib.sha256(",".join(n).encode()).hexdigest() for _, n in got]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(d) for d in shard], pa.int64()), pa.array(hit, pa.int64()), pa.array([len(n) for _, n in got], pa.int64()), pa.array(names, pa.string()), pa.array([h > 0 for h in hit], pa.bool_()), pa.array([_listed(s) for s, _ in got], _SPANS)],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"],
            )

    return in_batches(docs, run, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<first:long,end:long>>")


def _array(spans: list[dict] | None) -> np.ndarray:
    return np.array([(s["first"], s["end"]) for s in spans or []], dtype=np.int64).reshape(-1, 2)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans) for each row of docs.

    spans: the merged word spans [first, end) inside any occurrence. Null and blank texts have no words. Items
    without words are not searched; an item without id counts in all but n_items and items_sha256; items that repeat
    count once by id. An empty benchmark hits nothing. Rows are neither merged nor dropped; other columns are ignored.
    """
    spark = docs.sparkSession
    only, blocks = _one_or_more(benchmark, block_bytes)
    rows = docs.select("doc_id", "text")
    if only is not None:
        held = ship(spark).sparkContext.broadcast(only)

        def search() -> Callable:
            find = _search(held, window)
            return lambda part, shard: find(shard)

        return _reports(rows, search)
    at = Folder(spark, "leaks")
    found = few(stored(_by_text(rows, blocks, window, at), "leaks"))
    at.drop()

    def known() -> Callable:
        return lambda part, shard: [(_array(s), n or []) for n, s in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]

    return _reports(rows.join(found, F.md5("text") == F.col("key"), "left").select("doc_id", "text", "names", "spans"), known)


def cut_out(text: str, spans: np.ndarray) -> str:
    """The text without the words of the spans and what stands between them; a newline joins what is left."""
    import re

    raw = text.encode()
    places = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(_WORD))]
    out, at = [], 0
    for a, b in spans.tolist():
        out.append(raw[at : places[a][0]].decode().rstrip(" "))
        at = places[b - 1][1]
    out.append(raw[at:].decode().lstrip(" "))
    return "\n".join(x for x in out if x)


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 4 << 20) -> DataFrame:
    """docs with every hit span cut out of its text (and n_chars, where it is a column, counted anew).

    Items without id are searched too. The cut repeats until no phrase is left, as joining what surrounds a span may form
    one. A document left without any word goes; one that had none before stays. All other rows and columns stay as they are.
    """
    spark = docs.sparkSession
    only, blocks = _one_or_more(benchmark, block_bytes)
    if only is not None:
        held = ship(spark).sparkContext.broadcast(only)

        def search() -> Callable:
            find = _search(held, window)
            return lambda part, shard: [s for s, _ in find(shard)], lambda text: find([words(text)])[0][0]

        return _cut(docs, search)
    spans, key = fresh("__spans", docs), fresh("__key", docs)
    last = None
    while True:
        at = Folder(spark, "leaks")
        found = _by_text(docs, blocks, window, at).select(F.col("key").alias(key), F.col("spans").alias(spans))
        if found.isEmpty():
            at.drop()
            return docs

        def known() -> Callable:
            return lambda part, shard: [_array(x) for x in part.column(part.num_columns - 1).to_pylist()], lambda text: ()

        path = scratch(spark, "clean")
        docs = stored(_cut(docs.join(few(found), F.md5("text") == F.col(key), "left").drop(key), known, extra=1), "clean", path)
        at.drop()
        if last:
            discard(spark, last)
        last, blocks = path, _blocks(benchmark, block_bytes)


def _cut(docs: DataFrame, search: Callable, extra: int = 0) -> DataFrame:
    """docs, without its last `extra` columns, cut. search: the spans of a shard's documents, and of a text that was cut."""
    at = docs.columns.index("text")
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    schema = StructType(docs.schema.fields[: len(docs.columns) - extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, again = search()
        for part, shard in _shards(batches, "text"):
            got = find(part, shard)
            part = part.select(range(part.num_columns - extra))
            hit = [k for k, s in enumerate(got) if len(s)]
            if not hit:
                yield part
                continue
            texts = part.column(at).to_pylist()
            sizes = part.column(count).to_pylist() if count is not None else []
            gone = set()
            for k in hit:
                spans = got[k]
                while len(spans):
                    texts[k] = cut_out(texts[k], spans)
                    spans = again(texts[k])
                if not words(texts[k]):
                    gone.add(k)
                if sizes:
                    sizes[k] = len(texts[k])
            cols = list(part.columns)
            cols[at] = pa.array(texts, part.schema.field(at).type)
            if count is not None:
                cols[count] = pa.array(sizes, part.schema.field(count).type)
            out = pa.RecordBatch.from_arrays(cols, schema=part.schema)
            yield out.filter(pa.array([k not in gone for k in range(out.num_rows)], pa.bool_())) if gone else out

    return in_batches(docs, run, schema)
