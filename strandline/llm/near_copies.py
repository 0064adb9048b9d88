"""SimHash near-dedup at a five-word Jaccard similarity of 0.8: wide fingerprints, deletion variants, an exact check.

At a similarity of 0.8 two fingerprints differ in about 15 % of their bits, too many for a few segments of 64 bits. So a
text's distinct shingles vote on 1,024 bits, seen as a square of 32 x 32, whose rows, columns and (broken) diagonals are the
segments.
Two texts are compared if any segment of theirs differs by at most one bit: every segment is indexed by its one-wildcard
variants. A segment travels twice, once by its upper and once by its lower half; whatever bit differs, one of the halves
is equal, and the variants of the other half are met inside the group of that half, without a row for each of them.

What meets is verified. Fingerprints farther apart than those of 0.8 by 3.5 standard deviations are dropped and those nearer
by five are links; in between, and for sets of fewer than 64 shingles, the shingles of both texts decide. A pair of
similarity 0.8 shares no variant with a probability of about 4 %, of 0.85 of 0.1 %; what counts is whether a text is
joined to any of its class, and the README has the share that brute force finds missed.

Work is on distinct shingle sets, so copies never multiply. A variant with more than two sets is first met by one set for
each of its two segment values, and each value's sets by that one; of what a set so meets only the one that it meets in
most segments is verified, which joins a large group in linear work. Then the sets of such variants meet again with their
classes and fingerprints: first each with its nearest set of another class, then with all of other classes that
fingerprints and maps allow, so no pair that meets is lost. A map has a bit for each residue of a set's shingles; bits of
one map that the other lacks are shingles that the other set lacks, so the similarity has a bound that is never too low.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Folder, few, fresh, in_batches, ship, stored
from ._graph import connected_components

SHINGLE, SIMILARITY = 5, 0.8
SIDE = 32
BITS = SIDE * SIDE
SEGMENTS = 3 * SIDE
BLOCK = 1 << 18  # pairs that are compared at once
EXACT_BELOW = 64  # shingles; the bits of smaller sets are no normal approximation
MAP = 2048  # bits; a bound for sets of up to some 800 shingles, beyond which most bits are set
HELD = 1 << 19  # rows of one half's group beyond which long runs are no longer held
_DRAWN = np.random.default_rng(20240501).integers(0, 1 << 64, (2, BITS // 64), dtype=np.uint64) | np.uint64(1)
_DIAGONALS = np.add.outer(np.arange(SIDE), np.arange(SIDE)) % SIDE * SIDE + np.arange(SIDE)  # into the columns: row i of diagonal k has bit (k + i) % 32
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()  # a byte's bits, one in each byte


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct XXH64 (seed 42) of all word shingles, ascending; one of all words if they are fewer, none without words."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)) if len(words) > shingle else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(g, 42) for g in grams), dtype=np.uint64))


def similar(x: np.ndarray, y: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether the Jaccard similarity of two ascending shingle sets is at least `similarity`."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)) - 1e-9:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both) - 1e-9


def fingerprint(s: np.ndarray) -> np.ndarray:
    """The 1,024 majority bits of a shingle set, as bytes; a bit is set if it is in over half of the hashes."""
    counts = np.zeros(BITS, dtype=np.int32)
    for at in range(0, len(s), 255):  # so many fit into the lanes of a byte
        h = s[at : at + 255, None] * _DRAWN[0]
        h ^= h >> np.uint64(29)
        h *= _DRAWN[1]
        h ^= h >> np.uint64(32)
        counts += _LANES.take(h.view(np.uint8)).sum(axis=0).view(np.uint8)
    return np.packbits(2 * counts > len(s))


def residues(s: np.ndarray) -> np.ndarray:
    """The map of a shingle set, as bytes: a bit for each residue that occurs."""
    out = np.zeros(MAP, dtype=bool)
    out[(s % np.uint64(MAP)).astype(np.int64)] = True
    return np.packbits(out)


def possible(n: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """Whether sets of sizes n and m with maps x and y (rows of integers) can be that similar; true for all that are."""
    lacking = lambda p, q: np.bitwise_count(p & ~q).sum(axis=1, dtype=np.int64)
    both = np.minimum(n - lacking(x, y), m - lacking(y, x))
    return both >= similarity * (n + m - both) - 1e-9


def segments(fp: np.ndarray) -> np.ndarray:
    """The rows, columns and diagonals of a fingerprint's square, as integers of 32 bits."""
    square = np.unpackbits(fp).reshape(SIDE, SIDE)
    return np.packbits(np.stack([square, square.T, square.T.ravel()[_DIAGONALS]]), axis=2).view(">u4").reshape(SEGMENTS).astype(np.int64)


def half_keys(fp: np.ndarray) -> np.ndarray:
    """Two keys for each segment: its number and side, the half that groups (16 bits) and the half that may differ (16 bits)."""
    v, at = segments(fp), np.arange(SEGMENTS, dtype=np.int64) << 33
    return np.concatenate([at | v, at | (1 << 32) | (v & 0xFFFF) << 16 | v >> 16])


def distances(similarity: float, sure: float = 5.0, allowed: float = 3.5) -> tuple[int, int]:
    """Differing bits up to which two sets are surely that similar, and beyond which they are not; in standard deviations."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    deviation = math.sqrt(p * (1 - p) / BITS)
    return int((p - sure * deviation) * BITS), int((p + allowed * deviation) * BITS) + 1


def with_sets(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, th, id, size, fp, map) of each row: the text's hash, its shingle set's digest, size, fingerprint and map; a set of size 0 has id 0."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                got = [shingles(x.as_py(), shingle) for x in b.column(2)]
                ids = np.array([xxhash.xxh64_intdigest(s.tobytes(), 7) if len(s) else 0 for s in got], dtype=np.uint64).view(np.int64)
                fps = pa.array([fingerprint(s).tobytes() if len(s) else None for s in got], pa.binary())
                maps = pa.array([residues(s).tobytes() if len(s) else None for s in got], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids), pa.array([len(s) for s in got], pa.int32()), fps, maps], names=["doc_id", "th", "id", "size", "fp", "map"])

    ship(docs.sparkSession)
    return in_batches(docs.select("doc_id", text_hash().alias("th"), "text"), run, f"doc_id {kind}, th long, id long, size int, fp binary, map binary")


def text_hash():
    """Of a row's text, null apart from empty."""
    return F.xxhash64(F.col("text"), F.col("text").isNull())


def _keyed(sets: DataFrame) -> DataFrame:
    """(key, id) and the other columns, if there are any besides the fingerprint: the half keys of each set (id, fp, ..)."""
    more = sets.columns[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                keys = pa.array(np.concatenate([half_keys(np.frombuffer(x.as_py(), dtype=np.uint8)) for x in part.column(1)]))
                each = pa.array(np.repeat(np.arange(part.num_rows), 2 * SEGMENTS))
                cols = [part.column(k).take(each) for k in (range(part.num_columns) if more else [0])]
                yield pa.RecordBatch.from_arrays([keys, *cols], names=["key", "id", *(["fp", *more] if more else [])])

    kinds = [f"{c} {sets.schema[c].dataType.simpleString()}" for c in (["fp", *more] if more else [])]
    return in_batches(sets, run, ", ".join(["key long, id long", *kinds]))


class _Meeting:
    """Pairs (a, b) of the variants met in rows (key, id) that come sorted; members of variants of more than two sets as (a, a)."""

    def __init__(self):
        self.out: list[tuple[np.ndarray, np.ndarray]] = []
        self.first: dict[int, int] = {}  # of the open group: the first set of each long run that has been put out

    def pairs(self, x: np.ndarray, y: np.ndarray) -> None:
        self.out.append((np.maximum(x, y), np.minimum(x, y)))

    def shorten(self, key: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A group too large to hold: the sets of a run meet its first one here, and two of them stand for it."""
        runs, start, count = np.unique(key, return_index=True, return_counts=True)
        keep = np.ones(len(key), dtype=bool)
        for k, s, n in zip(runs.tolist(), start.tolist(), count.tolist(), strict=True):
            if n > 2:
                own = ids[s : s + n]
                self.pairs(own, np.full(n, self.first.setdefault(k, int(own[0]))))
                self.pairs(own, own)
                keep[s + 2 : s + n] = False
        return key[keep], ids[keep]

    def groups(self, key: np.ndarray, ids: np.ndarray) -> None:
        """All variants of whole groups."""
        runs, start, count = np.unique(key, return_index=True, return_counts=True)
        upper = runs >> 32 & 1 == 0  # equal segments meet in either half; once is enough
        place, of = _spread(start + 1, np.where(upper, count - 1, 0))
        self.pairs(ids[place], ids[start[of]])
        marked = upper & (count > 2)
        for j in range(16):
            low = np.flatnonzero(runs >> j & 1 == 0)
            to = np.searchsorted(runs, runs[low] | 1 << j)
            met = (to < len(runs)) & (runs[np.minimum(to, len(runs) - 1)] == runs[low] | 1 << j)
            x, y = low[met], to[met]
            self.pairs(ids[start[x]], ids[start[y]])
            many = count[x] + count[y] > 2
            marked[x[many]] = marked[y[many]] = True
        place, _ = _spread(start, np.where(marked & (upper | (count <= 2)), count, 0))  # longer runs of lower halves are marked in their upper one
        self.pairs(ids[place], ids[place])
        self.first.clear()

    def taken(self) -> pa.RecordBatch:
        a, b = (np.concatenate([x[k] for x in self.out] or [np.zeros(0, dtype=np.int64)]) for k in (0, 1))
        self.out = []
        rows, met = np.unique(np.stack([a, b], axis=1), axis=0, return_counts=True)
        return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(x)) for x in rows.T), pa.array(met)], names=["a", "b", "met"])


def _spread(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places start .. start + count of each run in turn, and which run each is of."""
    of = np.repeat(np.arange(len(count)), count)
    return np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + start[of], of


def _met(sets: DataFrame) -> DataFrame:
    """(a, b, met, again): pairs of sets that meet in a variant, in how many, and if both are members of variants with more than two; members of no such pair as (a, a)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meet = _Meeting()
        key, ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for b in batches:
            key, ids = np.concatenate([key, b.column(0).to_numpy()]), np.concatenate([ids, b.column(1).to_numpy()])
            if len(key) < HELD // 4:
                continue
            cut = int(np.searchsorted(key, key[-1] >> 16 << 16))  # the last group may go on
            if cut:
                meet.groups(key[:cut], ids[:cut])
                key, ids = key[cut:], ids[cut:]
            if len(key) >= HELD:
                key, ids = meet.shorten(key, ids)
            yield _compact(meet.taken())
        if len(key):
            meet.groups(key, ids)
        yield _compact(meet.taken())

    keyed = _keyed(sets.select("id", "fp")).repartition(F.shiftright("key", 16)).sortWithinPartitions("key", "id")
    return in_batches(keyed, run, "a long, b long, met long, again boolean")


def _compact(rows: pa.RecordBatch) -> pa.RecordBatch:
    """The rows of a meeting with a mark on pairs of members, of which each a keeps one with most variants, and members of no such pair as (a, a)."""
    a, b, met = (rows.column(k).to_numpy() for k in range(3))
    own = a == b
    again = np.flatnonzero(~own & np.isin(a, a[own]) & np.isin(b, a[own]))
    best = again[np.lexsort((b[again], -met[again], a[again]))]
    best = best[np.unique(a[best], return_index=True)[1]]
    keep = np.where(own, ~np.isin(a, np.concatenate([a[best], b[best]])), True)
    keep[again] = False
    keep[best] = True
    marks = own.copy()
    marks[best] = True
    return pa.RecordBatch.from_arrays([*rows.columns, pa.array(marks)], names=[*rows.schema.names, "again"]).filter(pa.array(keep))


def _to_verify(met: DataFrame, family: DataFrame) -> DataFrame:
    """(a, b): of the pairs met those with an end that does not meet again, as it is not in the family, and of the others each a's with most variants in common."""
    x, y = (family.select(F.col("id").alias(c), F.lit(True).alias(f"again_{c}")) for c in "ab")
    pairs = met.where("a <> b").groupBy("a", "b").agg(F.sum("met").alias("met")).join(x, "a", "left").join(y, "b", "left")
    again = F.col("again_a").isNotNull() & F.col("again_b").isNotNull()
    most = pairs.where(again).groupBy("a").agg(F.max(F.struct("met", F.bitwise_not("b").alias("c"))).alias("w"))
    return pairs.where(~again).select("a", "b").unionAll(most.select("a", F.bitwise_not("w.c").alias("b")))


def _differing(fps: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The differing bits of pairs of rows, a few thousand pairs at once: fingerprints of all would be a hundred times the pairs."""
    out = [np.zeros(0, dtype=np.int64)]
    for at in range(0, len(p), 4096):
        out.append(np.bitwise_count(fps[p[at : at + 4096]] ^ fps[q[at : at + 4096]]).sum(axis=1, dtype=np.int64))
    return np.concatenate(out)


class _Family:
    """Pairs (x, y, bits) of different classes that meet in a half key's group and whose sizes, fingerprints and maps, if given, allow the similarity."""

    def __init__(self, similarity: float, nearest: bool):
        self.similarity, self.nearest, self.far = similarity, nearest, distances(similarity)[1]

    def group(self, key: np.ndarray, ids: np.ndarray, root: np.ndarray, size: np.ndarray, fps: np.ndarray, maps: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        names, of, count = np.unique(root, return_inverse=True, return_counts=True)
        if len(names) < 2:
            return
        most = count.argmax()
        rare = np.flatnonzero(of != most)  # pairs of different classes have an end here
        low, lower = key & 0xFFFF, bool(key[0] >> 32 & 1)
        step = max(1, BLOCK // len(ids))
        for at in range(0, len(rare), step):
            i = rare[at : at + step]
            x = low[i, None] ^ low[None, :]
            meets = (x & (x - 1) == 0) & (of[i, None] != of[None, :])
            if lower:
                meets &= x != 0  # equal segments meet in the upper half's group
            p, q = np.nonzero(meets)
            p = i[p]
            small, large = np.minimum(size[p], size[q]), np.maximum(size[p], size[q])
            fits = small >= self.similarity * large - 1e-9
            p, q, small = p[fits], q[fits], small[fits]
            bits = _differing(fps, p, q)
            keep = (bits <= self.far) | (small < EXACT_BELOW)
            if not self.nearest:
                keep &= (ids[p] > ids[q]) | (of[q] == most)
            p, q, bits = p[keep], q[keep], bits[keep]
            if maps is not None:
                keep = self._possible(size, maps, p, q)
                p, q, bits = p[keep], q[keep], bits[keep]
            if not len(p):
                continue
            if self.nearest:
                order = np.lexsort((bits, p))
                order = order[np.unique(p[order], return_index=True)[1]]
            else:
                order = np.flatnonzero(self._first(fps, p, q) == key[0] >> 33)
            yield pa.RecordBatch.from_arrays([pa.array(ids[p[order]]), pa.array(ids[q[order]]), pa.array(bits[order])], names=["x", "y", "bits"])

    def _possible(self, size: np.ndarray, maps: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        out = [np.zeros(0, dtype=bool)]
        for at in range(0, len(p), 4096):
            i, j = p[at : at + 4096], q[at : at + 4096]
            out.append(possible(size[i], size[j], maps[i], maps[j], self.similarity))
        return np.concatenate(out)

    @staticmethod
    def _first(fps: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The first segment in which two sets meet: there, and only there, their pair is put out."""
        out = [np.zeros(0, dtype=np.int64)]
        for at in range(0, len(p), 4096):
            square = np.unpackbits((fps[p[at : at + 4096]] ^ fps[q[at : at + 4096]]).view(np.uint8), axis=1).reshape(-1, SIDE, SIDE)
            diagonal = square.transpose(0, 2, 1).reshape(-1, BITS)[:, _DIAGONALS]
            out.append((np.concatenate([square.sum(axis=2), square.sum(axis=1), diagonal.sum(axis=2)], axis=1) <= 1).argmax(axis=1))
        return np.concatenate(out)


def _across(sets: DataFrame, similarity: float, nearest: bool) -> DataFrame:
    """(x, y, bits) of sets (id, fp, root, size, map) of different classes that meet; only each one's nearest in a group, if so asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = _Family(similarity, nearest)
        held: list[np.ndarray] = []

        def done(upto: int) -> Iterator[pa.RecordBatch]:
            cuts = [0, *(np.flatnonzero(np.diff(held[0][:upto] >> 16)) + 1).tolist(), upto]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a + 1:
                    yield from work.group(*(x[a:b] for x in held))

        for b in batches:
            if not b.num_rows:
                continue
            new = [b.column(k).to_numpy() for k in range(4)] + [np.frombuffer(b"".join(b.column(k).to_pylist()), dtype=np.uint64).reshape(b.num_rows, -1) for k in range(4, b.num_columns)]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
            cut = int(np.searchsorted(held[0], held[0][-1] >> 16 << 16))
            yield from done(cut)
            held = [x[cut:] for x in held]
        if held:
            yield from done(len(held[0]))

    more = [] if nearest else ["map"]  # each one's nearest are few without it
    keyed = _keyed(sets.select("id", "fp", "root", "size", *more)).repartition(F.shiftright("key", 16)).sortWithinPartitions("key", "id")
    return in_batches(keyed.select("key", "id", "root", "size", "fp", *more), run, "x long, y long, bits long")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, bits, sure) of the pairs whose sizes and fingerprints allow that similarity; sure: no need to look at the texts."""
    near, far = distances(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if not t.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(t.column(k).to_pylist()), dtype=np.uint64).reshape(t.num_rows, -1) for k in (2, 3))
            bits = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            large = t.column(4).to_numpy(zero_copy_only=False)
            out = pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(bits), pa.array(large & (bits <= near))], names=["a", "b", "bits", "sure"])
            yield out.filter(pa.array(~large | (bits <= far)))

    x = sets.select(F.col("id").alias("a"), F.col("fp").alias("x"), F.col("size").alias("n"))
    y = sets.select(F.col("id").alias("b"), F.col("fp").alias("y"), F.col("size").alias("m"))
    both = pairs.join(x, "a").join(y, "b").where(f"least(n, m) >= {similarity} * greatest(n, m) - 1e-9")
    return in_batches(both.select("a", "b", "x", "y", F.expr(f"least(n, m) >= {EXACT_BELOW}").alias("large")), run, "a long, b long, bits long, sure boolean")


def _checked(pairs: DataFrame, docs: DataFrame, sets: DataFrame, shingle: int, similarity: float, at: Folder) -> DataFrame:
    """The pairs (a, b) of set digests whose shingles are that similar, by one text of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(256)(lambda text: shingles(text, shingle))
        for t in batches:
            alike = [similar(known(x.as_py()), known(y.as_py()), similarity) for x, y in zip(t.column(2), t.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], names=["a", "b"]).filter(pa.array(alike, pa.bool_()))

    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    one = few(at.stored(sets.select("w.doc_id", "w.th", "id").join(ends, "id", "left_semi").withColumnsRenamed({"doc_id": "__i", "th": "__h"})))
    rows = docs.select("doc_id", "text", text_hash().alias("__t")).join(one, F.col("doc_id").eqNullSafe(F.col("__i")) & (F.col("__t") == F.col("__h")))
    texts = at.stored(rows.groupBy("id").agg(F.any_value("text").alias("text")))
    x, y = texts.select(F.col("id").alias("a"), F.col("text").alias("x")), texts.select(F.col("id").alias("b"), F.col("text").alias("y"))
    return in_batches(pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y"), run, "a long, b long")


def _classes(edges: DataFrame, at: Folder) -> DataFrame:
    return at.stored(connected_components(edges).withColumnRenamed("node", "id"))


def _merged(roots: DataFrame, links: DataFrame, at: Folder) -> DataFrame:
    """(id, root) after more links (a, b): only classes are linked anew, by their roots, and their sets follow."""
    p, q = (roots.select(F.col("id").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
    placed = links.join(p, "a", "left").join(q, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    tops = _classes(at.stored(placed.where("a <> b").distinct()), at)
    moved = roots.join(tops.select(F.col("id").alias("root"), F.col("root").alias("top")), "root", "left")
    return at.stored(moved.select("id", F.coalesce("top", "root").alias("root")).unionAll(tops.join(roots, "id", "left_anti")))


def classes(sets: DataFrame, docs: DataFrame, at: Folder, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(id, root) of all sets that are linked to another; sets: id, size, fp, map and, as w, the doc_id and th of one text of each, stored."""
    near = distances(similarity)[0]
    met = at.stored(_met(sets.where("size > 0")))
    a, b = (met.where("again").select(F.col(x).alias("id")).distinct() for x in "ab")
    family = at.stored(a.unionAll(b).distinct())
    links = at.stored(_verified(at.stored(_to_verify(met, few(family))), sets, similarity))
    unsure = links.where("not sure")
    nearest = at.stored(unsure.groupBy("a").agg(F.min(F.struct("bits", "b")).alias("w")).select("a", "w.b"))
    edges = at.stored(links.where("sure").select("a", "b").unionAll(_checked(nearest, docs, sets, shingle, similarity, at)))
    roots = _classes(edges, at)
    for last in (False, True):
        placed = sets.join(family, "id", "left_semi").join(roots, "id", "left").select("id", "fp", F.coalesce("root", "id").alias("root"), "size", "map")
        found = at.stored(_across(at.stored(placed), similarity, nearest=not last))
        if not last:
            found = found.groupBy("x").agg(F.min(F.struct("bits", "y")).alias("w")).select("x", "w.y", "w.bits")
        found = found.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"), "bits")
        if last:  # and what met at first, was left open and is still apart
            found = found.unionAll(_apart(unsure.select("a", "b", "bits").join(nearest, ["a", "b"], "left_anti"), roots))
        n, m = (sets.select(F.col("id").alias(x), F.col("size").alias(f"n{x}")) for x in "ab")
        sized = found.distinct().join(n, "a").join(m, "b")
        found = at.stored(sized.select("a", "b", F.expr(f"bits <= {near} and least(na, nb) >= {EXACT_BELOW}").alias("sure")))
        new = found.where("sure").select("a", "b").unionAll(_checked(found.where("not sure"), docs, sets, shingle, similarity, at))
        roots = _merged(roots, at.stored(new), at)
    return roots


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b, ..) whose ends are in different classes so far."""
    p, q = (roots.select(F.col("id").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
    return pairs.join(p, "a", "left").join(q, "b", "left").where("coalesce(ra, a) <> coalesce(rb, b)").select(*pairs.columns)


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that stay when each class of near copies keeps one, with all their columns.

    Texts of `similarity` or more that meet are linked, and a class is all that links reach; texts without words (null
    and blank ones) are copies of each other. The row with the smallest doc_id stays, one without an id only where no
    other is in its class; of rows with that id the one whose text has the smallest hash, and of equal texts any one.
    An empty table stays empty. No column of docs is changed, whatever its name.
    """
    spark = docs.sparkSession
    at = Folder(spark, "near-copies")
    marked = at.stored(with_sets(docs, shingle))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    sets = at.stored(marked.groupBy("id").agg(F.any_value("size").alias("size"), F.any_value("fp").alias("fp"), F.any_value("map").alias("map"), F.min(order).alias("w")))
    roots = classes(sets, docs, at, shingle, similarity)
    placed = sets.select("id", "w").join(roots, "id", "left").select(F.coalesce("root", "id").alias("root"), "w")
    best = placed.groupBy("root").agg(F.min("w").alias("w"))
    i, h, r = (fresh(x, docs) for x in ("__i", "__h", "__r"))
    chosen = stored(best.select(F.col("w.doc_id").alias(i), F.col("w.th").alias(h)), "stay")
    repeated = marked.join(chosen, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col("th") == F.col(h)), "left_semi").count() > chosen.count()
    at.drop()
    kept = docs.join(chosen, F.col("doc_id").eqNullSafe(F.col(i)) & (text_hash() == F.col(h)), "left_semi")
    if repeated:
        first = Window.partitionBy("doc_id", text_hash()).orderBy(F.lit(0))
        kept = kept.withColumn(r, F.row_number().over(first)).where(F.col(r) == 1).drop(r)
    return kept
