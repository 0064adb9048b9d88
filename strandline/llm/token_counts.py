"""Token counts by a finite-state transducer compiled from a SentencePiece BPE vocabulary.

BPE has local structure: a token sequence is the encoding of its text exactly when each neighbouring pair is
the encoding of its own two tokens. So the encoding of text[:i] ends in one token, found among the vocabulary's
suffixes of text[:i] by that pair test, and what follows depends only on the longest suffix that begins some
token and on the last tokens at its places. Those are the states of a deterministic transducer; a transition
on a character carries the change in the number of tokens. States are compiled as texts first reach them.

A text is cut into chunks where a word mark follows another character. No token spans such a cut, so whatever
state enters a chunk, its first transition leads to the same state. A chunk's map from entering states to (leaving
state, count) is therefore constant, and the maps of a text compose by adding counts, in a prefix scan over a batch.

A long text is also cut into pieces of a fixed size, spaces or not, which are counted in parallel. A piece's map is not
constant. It is held as the piece's run from the start state and the piece: another entering state is run along until
both are in the same state, from where on the map is known; runs of one character, where that may never happen, are run
to the end. The maps of a text's pieces are composed in order, each applied to the state that the one before it leaves.
"""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ship, vocabulary_path

MARK = "▁"
MAX_CHUNKS = 400_000
MAX_STATES = 300_000
LONG = 1 << 20  # characters from which on a text is cut into pieces
PIECE = 1 << 18


class State(dict):
    """Transitions of a state: character -> (state, change in tokens). A missing one is compiled on first use."""

    __slots__ = ("counts", "fst", "lasts", "live")

    def __init__(self, fst: Transducer, live: str, lasts: tuple, counts: tuple):
        self.fst, self.live, self.lasts, self.counts = fst, live, lasts, counts

    def __missing__(self, char: str) -> tuple[State, int]:
        got = self[char] = self.fst.step(self, char)
        return got


class Transducer:
    """Compiled from the pieces and scores of a SentencePiece BPE model with byte fallback and no normalisation."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        by_score = sorted(ids, key=lambda i: (-sp.get_score(i), i))
        self.rank = {sp.id_to_piece(i): k for k, i in enumerate(by_score)}
        self.prefixes = {p[:k] for p in self.rank for k in range(1, len(p) + 1)}
        self.byte_fallback = any(sp.is_byte(i) for i in range(sp.get_piece_size()))
        if any(MARK in p.lstrip(MARK) for p in self.rank):
            raise ValueError("a piece holds a word mark after another character: chunks would not be independent")
        probe = " a  béﬁ　c\t\nÅ "
        if sp.normalize(probe).replace(" ", MARK) != MARK + probe.replace(" ", MARK):
            raise ValueError("the model normalises its input")
        self.pairs: dict[tuple[str | None, str], bool] = {}
        self.states: dict[tuple, State] = {}
        self.plans: dict[str, tuple] = {}
        self.chunks: dict[str, int] = {}
        self.start = self.state("", (None,), (0,))

    def state(self, live: str, lasts: tuple, counts: tuple) -> State:
        key = (live, lasts, counts)
        got = self.states.get(key)
        if got is None:
            got = self.states[key] = State(self, live, lasts, counts)
        return got

    def merge(self, text: str) -> list[str]:
        """BPE of a short text by repeated best merges, leftmost first; the definition the transducer follows."""
        parts, rank, none = list(text), self.rank.get, len(self.rank)
        ranks = [rank(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] + parts[i], none)
            if i < len(ranks):
                ranks[i] = rank(parts[i] + parts[i + 1], none)
        return parts

    def fits(self, before: str | None, token: str) -> bool:
        key = (before, token)
        got = self.pairs.get(key)
        if got is None:
            got = self.pairs[key] = self.merge((before or "") + token) == ([token] if before is None else [before, token])
        return got

    def step(self, at: State, char: str) -> tuple[State, int]:
        if char not in self.rank:
            return self.start, len(char.encode()) if self.byte_fallback else 1
        text = at.live + char
        plan = self.plans.get(text)
        if plan is None:
            plan = self.plans[text] = self.plan(text)
        tokens, live, held = plan
        lasts, counts, pairs = at.lasts, at.counts, self.pairs
        for k, token in tokens:  # longest first; exactly one fits
            before = lasts[k]
            got = pairs.get((before, token))
            if got is None:
                got = self.fits(before, token)
            if got:
                delta = counts[k] + 1
                return self.state(live, (*[lasts[i] for i in held], token), (*[counts[i] - delta for i in held], 0)), delta
        raise AssertionError(f"no token ends {text!r}")

    def plan(self, text: str) -> tuple[list[tuple[int, str]], str, list[int]]:
        """Of a live suffix and the next character: tokens that may end it, the live suffix that stays, the places kept.

        A state knows the last token and count at the places where a later token may begin, and at its end;
        places are given by their position among those.
        """
        n = len(text)
        places = {k: i for i, k in enumerate([*(k for k in range(n - 1) if text[k:-1] in self.prefixes), n - 1])}
        tokens = [(places[k], text[k:]) for k in range(n) if text[k:] in self.rank]
        held = [k for k in range(n) if text[k:] in self.prefixes]
        return tokens, text[held[0] :], [places[k] for k in held]

    def run(self, text: str, at: State | None = None) -> tuple[State, int]:
        """The map of a chunk at one entering state: (leaving state, tokens)."""
        st, total = at or self.start, 0
        for char in text:
            st, d = st[char]
            total += d
        return st, total

    def piece_map(self, piece: str) -> PieceMap:
        if len(self.states) >= MAX_STATES:
            self._forget()
        leaving, count = self.run(piece)
        return PieceMap(piece, (leaving.live, leaving.lasts, leaving.counts), count)

    def apply(self, piece: PieceMap, entering: State) -> tuple[State, int]:
        """A piece's map at an entering state: (leaving state, tokens)."""
        here, known, more = entering, self.start, 0
        for char in piece.text:
            if here is known:
                return self.state(*piece.leaving), more + piece.count
            here, n = here[char]
            known, m = known[char]
            more += n - m
        return here, more + piece.count

    def chunk_count(self, chunk: str) -> int:
        got = self.chunks.get(chunk)
        if got is None:
            if len(self.chunks) >= MAX_CHUNKS or len(self.states) >= MAX_STATES:
                self._forget()
            got = self.run(MARK + chunk)[1]
            if len(chunk) <= 64:
                self.chunks[chunk] = got
        return got

    def _forget(self) -> None:
        """Drop what was compiled, so that memory stays bounded; it is compiled again where needed."""
        self.chunks.clear()
        if len(self.states) >= MAX_STATES:
            self.states.clear()
            self.pairs.clear()
            self.start.clear()
            self.states["", (None,), (0,)] = self.start
            gc.collect()

    def count(self, text: str | None) -> int:
        return int(self.counts([text])[0])

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text: the chunks' counts, composed in one scan over the batch."""
        known, flat, ends = self.chunks, [], []
        for text in texts:
            if text:
                if MARK in text:
                    text = text.replace(MARK, " ")
                parts = text.split(" ")
                if "" in parts:
                    parts = [x[1:].replace(" ", MARK) for x in re.findall(r" +[^ ]*", " " + text)]
                for chunk in parts:
                    got = known.get(chunk)
                    flat.append(self.chunk_count(chunk) if got is None else got)
            ends.append(len(flat))
        scan = np.concatenate([[0], np.cumsum(np.array(flat, dtype=np.int64))])
        return np.diff(scan[np.array([0, *ends], dtype=np.int64)])


@dataclass
class PieceMap:
    """The map of a piece of a text: the piece, and where and with how many tokens its run from the start state ends."""

    text: str
    leaving: tuple
    count: int


def pieces(text: str, size: int = 0) -> list[str]:
    """A text as the transducer reads it, a mark for each space and one before it, cut every `size` characters."""
    size = size or PIECE
    marked = MARK + text.replace(" ", MARK)
    return [marked[k : k + size] for k in range(0, len(marked), size)]


_compiled: dict[str, Transducer] = {}


def transducer(model_file: str) -> Transducer:
    """This process's transducer for a model file."""
    if model_file not in _compiled:
        _compiled[model_file] = Transducer(model_file)
    return _compiled[model_file]


def count_tokens(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs; a null text counts as empty.

    vocabulary: the file's name among the public tokenizers, looked up on each executor. Texts of LONG characters or
    more are counted in pieces. Rows are neither merged nor dropped, and come in no order; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = transducer(vocabulary_path(vocabulary))
        gc.disable()  # states refer to one another and live on; _forget() collects them
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                n = fst.counts(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    ship(docs.sparkSession)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    long, rows = F.coalesce(F.char_length("text") >= LONG, F.lit(False)), docs.select("doc_id", "text", size)
    out = rows.where(~long).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").unionAll(_in_pieces(rows.where(long), vocabulary))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def _in_pieces(rows: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of rows (doc_id, text, n_bytes): the pieces are dealt out to all tasks, mapped, and composed by text."""
    head = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1)
                for no, piece in enumerate(pieces(row.column(1)[0].as_py())):
                    yield pa.RecordBatch.from_arrays([row.column(0), row.column(2), row.column(3), pa.array([no], pa.int32()), pa.array([piece])], names=["doc_id", "n_bytes", "row", "no", "piece"])

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = transducer(vocabulary_path(vocabulary))
        for b in batches:
            got = [fst.piece_map(x.as_py()) for x in b.column(4)]
            cols = [pa.array([json.dumps(m.leaving) for m in got], pa.string()), pa.array([m.count for m in got], pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, "leaving", "count"])

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst, last, state, total = transducer(vocabulary_path(vocabulary)), None, None, 0
        one = lambda: pa.RecordBatch.from_arrays([last.column(0), last.column(1), pa.array([total], pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1)
                if last is None or row.column(2)[0] != last.column(2)[0]:
                    if last is not None:
                        yield one()
                    state, total = fst.start, 0
                live, lasts, counts = json.loads(row.column(5)[0].as_py())
                state, n = fst.apply(PieceMap(row.column(4)[0].as_py(), (live, tuple(lasts), tuple(counts)), row.column(6)[0].as_py()), state)
                last, total = row, total + n
        if last is not None:
            yield one()

    keyed = f"{head}, row long, no int, piece string"
    cuts = rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(cut, keyed)
    mapped = cuts.repartition("row", "no").mapInArrow(maps, f"{keyed}, leaving string, count long")
    return mapped.repartition("row").sortWithinPartitions("row", "no").mapInArrow(compose, f"{head}, n_tokens long")
