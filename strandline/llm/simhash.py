"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit segments. Two fingerprints at most three bits apart have a
segment in which they differ by at most one bit, so each segment value is indexed by its 32 one-wildcard
variants: an equality group of such a variant holds at most two different values, whatever the data. Pairs of
neighbouring segment values are then equality-joined to the fingerprints that carry them and verified on all
64 bits. Work is on distinct fingerprints, so copies never multiply.

A segment value carried by more than `dense` fingerprints is not compared pairwise: inside it each fingerprint
is listed under the points of its radius-1 and radius-2 balls on the other segment. All that meet at a point
which has a radius-1 member lie within three bits of that member, so one star there carries every link.
That is exact and linear in the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ._common import ship, stored
from ._graph import connected_components

MAX_BITS = 3
LOW = 0xFFFFFFFF
SLICE = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority-bit fingerprint of the XXH64 (seed 42) of all word shingles, repeats included; 0 without words."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - shingle + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, SLICE):
        part = words[at : min(n, at + SLICE) + shingle - 1]
        if len(part) <= shingle:
            grams = [b" ".join(part)]
        else:
            grams = map(b" ".join, zip(*(part[k:] for k in range(shingle)), strict=False))
        hashes = np.fromiter((digest(g, 42) for g in grams), dtype=np.uint64).astype(">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) for each row of docs; fp is the fingerprint's bits as a signed long. Null or blank text: 0."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(x.as_py(), shingle) for x in b.column(1)), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def _segments(fps: DataFrame) -> DataFrame:
    """(side, v, rest, fp): each fingerprint under both of its segments."""
    low, high = F.col("fp").bitwiseAND(F.lit(LOW)), F.shiftrightunsigned("fp", 32)
    sides = F.array(
        F.struct(F.lit(0).alias("side"), low.alias("v"), high.alias("rest")),
        F.struct(F.lit(1).alias("side"), high.alias("v"), low.alias("rest")),
    )
    return fps.select("fp", F.explode(sides).alias("s")).select("s.side", "s.v", "s.rest", "fp")


def _neighbours(values: DataFrame) -> DataFrame:
    """(side, lo, hi) of distinct segment values that differ in exactly one bit, by their one-wildcard variants."""
    bit = F.expr("explode(sequence(0, 31))").alias("j")
    key = F.expr("(v & ~shiftleft(1L, j)) | shiftleft(cast(j as long), 32) | shiftleft(cast(side as long), 38)")
    variants = values.select("side", "v", bit).select("side", "v", key.alias("key"))
    met = variants.groupBy("key").agg(F.first("side").alias("side"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    return met.where("lo < hi").select("side", "lo", "hi")


def _ball(radius: int) -> str:
    """SQL: the masks of exactly `radius` bits out of 32."""
    if radius == 0:
        return "array(0L)"
    if radius == 1:
        return "transform(sequence(0, 31), i -> shiftleft(1L, i))"
    return "flatten(transform(sequence(0, 30), i -> transform(sequence(i + 1, 31), j -> shiftleft(1L, i) | shiftleft(1L, j))))"


def _stars(listed: DataFrame, by: list[str]) -> DataFrame:
    """Edges from each listed fingerprint to the smallest radius-1 member of its point."""
    centre = listed.groupBy(*by).agg(F.min(F.expr("if(near, fp, null)")).alias("c")).where("c is not null")
    return listed.join(centre, by).where("fp <> c").select(F.greatest("fp", "c").alias("a"), F.least("fp", "c").alias("b"))


def links(fps: DataFrame, dense: int = 2000) -> DataFrame:
    """Edges (a > b) over the distinct longs in `fps.fp` that join all fingerprints within three bits of each other.

    Segment values with at most `dense` fingerprints give each linked pair once; beyond that, star edges
    that connect the same fingerprints.
    """
    seg = stored(_segments(fps), "segments")
    sizes = stored(seg.groupBy("side", "v").agg(F.count("*").alias("n")), "values")
    pairs = _neighbours(sizes.select("side", "v"))
    n = sizes.select("side", F.col("v").alias("lo"), F.col("n").alias("nlo"))
    m = sizes.select("side", F.col("v").alias("hi"), F.col("n").alias("nhi"))
    pairs = pairs.join(n, ["side", "lo"]).join(m, ["side", "hi"])
    same = sizes.where("n > 1").select("side", F.col("v").alias("hi"), F.col("v").alias("lo"), F.col("n").alias("nlo"), F.col("n").alias("nhi"))
    pairs = stored(pairs.unionByName(same).select("side", "lo", "hi", F.expr(f"greatest(nlo, nhi) > {dense}").alias("hot")), "pairs")
    x = seg.select("side", F.col("v").alias("lo"), F.col("rest").alias("rx"), F.col("fp").alias("x"))
    y = seg.select(F.col("side").alias("yside"), F.col("v").alias("hi"), F.col("rest").alias("ry"), F.col("fp").alias("y"))
    far = F.expr(f"bit_count(x ^ y) <= {MAX_BITS} and (lo < hi or x < y)")
    left = pairs.where("not hot").join(x, ["side", "lo"]).select("side", "lo", F.col("hi").alias("h"), "x")
    near = left.join(y, (F.col("side") == F.col("yside")) & (F.col("h") == F.col("hi")) & far).select("x", "y")
    edges = near.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
    if pairs.where("hot").isEmpty():
        return edges.distinct()
    hot = pairs.where("hot")
    alone = hot.where("lo = hi").join(x, ["side", "lo"])
    listed = alone.select("side", "lo", "rx", F.col("x").alias("fp"), F.explode(F.expr(f"concat({_ball(0)}, {_ball(1)})")).alias("mask"), F.lit(True).alias("near"))
    listed = listed.unionAll(alone.select("side", "lo", "rx", F.col("x").alias("fp"), F.explode(F.expr(_ball(2))).alias("mask"), F.lit(False).alias("near")))
    listed = listed.select("side", "lo", "fp", F.expr("rx ^ mask").alias("z"), "near")
    edges = edges.unionAll(_stars(listed, ["side", "lo", "z"]))
    cross = hot.where("lo < hi")
    ends = cross.join(x, ["side", "lo"]).select("side", "lo", "hi", F.col("rx").alias("r"), F.col("x").alias("fp"))
    ends = ends.unionByName(cross.join(y.withColumnRenamed("yside", "side"), ["side", "hi"]).select("side", "lo", "hi", F.col("ry").alias("r"), F.col("y").alias("fp")))
    listed = ends.select("side", "lo", "hi", "fp", "r", F.explode(F.expr(f"concat({_ball(0)}, {_ball(1)})")).alias("mask"))
    listed = listed.select("side", "lo", "hi", "fp", F.expr("r ^ mask").alias("z"), F.lit(True).alias("near"))
    return edges.unionAll(_stars(listed, ["side", "lo", "hi", "z"])).distinct()


def classes(fps: DataFrame, dense: int = 2000) -> DataFrame:
    """(fp, root) of the distinct longs in `fps.fp`: root is the smallest of the linked fingerprints."""
    distinct = stored(fps.select("fp").distinct(), "distinct")
    roots = connected_components(links(distinct, dense))
    return distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3, dense: int = 2000) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of docs.

    component_id is the smallest doc_id that the fingerprints' links reach. Null or blank texts have fingerprint
    zero and are linked like any other. Repeated rows are kept. A null doc_id takes part in the links and never
    names a component (which is null if no member has an id). Other columns of docs are ignored.
    """
    marks = stored(fingerprints(docs, shingle), "fingerprints")
    firsts = marks.groupBy("fp").agg(F.min("doc_id").alias("first"))
    rooted = stored(classes(marks, dense).join(firsts, "fp"), "classes")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    bits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marks.join(named, "fp").select("doc_id", bits.alias("fingerprint"), "component_id")


def with_fingerprint(docs: DataFrame, shingle: int = 3, name: str = "__fp") -> DataFrame:
    """docs with each text's fingerprint as a signed long in a last column."""
    rows = docs.drop(name)
    at = rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(x.as_py(), shingle) for x in b.column(at)), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp.view(np.int64))], names=[*b.schema.names, name])

    ship(docs.sparkSession)
    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(name, LongType())]))


def one_of_each(docs: DataFrame, shingle: int = 3, dense: int = 2000) -> DataFrame:
    """The rows of docs that stay when each near-duplicate class keeps one, with all their columns.

    The row with the smallest doc_id stays, one without an id only where no other is in its class; of repeated
    rows of that id and fingerprint the one with the smallest text (nulls first). A column __fp is dropped.
    """
    marked = stored(with_fingerprint(docs, shingle), "marked")
    return stay(marked, classes(marked.select(F.col("__fp").alias("fp")), dense))


def stay(marked: DataFrame, rooted: DataFrame) -> DataFrame:
    """The rows of marked that stay, without __fp, where rooted has the class (fp, root) of each __fp; see one_of_each."""
    ids = marked.select("doc_id", F.col("__fp").alias("fp"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")
    best = ids.join(rooted, "fp").groupBy("root").agg(F.min(order).alias("w"))
    chosen = stored(best.select(F.col("w.doc_id").alias("__id"), F.col("w.fp").alias("__f")), "stay")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__fp") == F.col("__f"))
    kept = marked.join(chosen, same, "left_semi")
    if ids.join(chosen, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("fp") == F.col("__f")), "left_semi").count() > chosen.count():
        first = Window.partitionBy("doc_id", "__fp").orderBy(F.asc_nulls_first("text"))
        kept = kept.withColumn("__row", F.row_number().over(first)).where("__row = 1").drop("__row")
    return kept.drop("__fp")
