"""The near-dedup stage against brute force over all pairs, and its variants against brute force over all segments."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from strandline.llm import near_copies

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def stay_by_force(docs):
    sets, root = [grams(t) for _, t in docs], list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return sorted(docs[k][0] for k in range(len(docs)) if find(k) == k)


def texts():
    rng = np.random.default_rng(3)
    out = [None, "", " \n", "one two", "One TWO", "one two three"]
    for base in range(6):
        words = [f"w{x}" for x in rng.integers(0, 5000, 150)]
        for _ in range(12):
            changed = list(words)
            for at in rng.integers(0, 150, rng.integers(0, 7)):
                changed[at] = f"x{rng.integers(0, 10**6)}"
            out.append(" ".join(changed))
    return out


def holds(kept, docs):
    """No row goes that brute force keeps, and few stay that it drops: a pair of just 0.8 may share no variant."""
    want = stay_by_force(docs)
    assert 4 < len(want) < len(docs)
    assert set(want) <= set(kept) and len(kept) - len(want) <= 0.05 * len(docs)
    return len(kept) - len(want)


def test_near_copies_by_force(spark, sf):
    docs = list(enumerate(texts()))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    holds([r["doc_id"] for r in near_copies.one_of_each(df).collect()], docs)


def test_rows_that_stay(spark):
    rows = [(None, "a b c d e f", "x"), (4, "A b c d e f", "y"), (3, "a b c d e f", "z"), (3, "a b c d e f", "z"), (None, None, "n"), (None, "", "n"), (9, " ", "n"), (None, "alone", "o"), (None, "alone", "o")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __t string").withColumn("fp", F.lit(1)).withColumn("root", F.lit("r"))
    kept = near_copies.one_of_each(docs)
    assert kept.schema == docs.schema
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(3, "a b c d e f", "z", 1, "r"), (9, " ", "n", 1, "r"), (None, "alone", "o", 1, "r")], key=str)
    assert near_copies.one_of_each(docs.limit(0)).count() == 0


def test_near_copies_of_documents(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    docs = [(r["doc_id"], r["text"]) for r in rows.orderBy("doc_id").collect()]
    assert holds([r["doc_id"] for r in near_copies.one_of_each(rows).collect()], docs) <= 1


def test_stage_takes_similarity(spark, sf):
    docs = list(enumerate(texts()))
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string"), sf)
    assert kept.columns == ["doc_id", "text"]
    holds([r["doc_id"] for r in kept.collect()], docs)


def variants_by_force(fps):
    segs = [near_copies.segments(f).tolist() for f in fps]
    return {(i, j) for i in range(len(fps)) for j in range(i) if any((x ^ y).bit_count() <= 1 for x, y in zip(segs[i], segs[j], strict=True))}


@pytest.mark.parametrize("held", [1 << 20, 8])
def test_variants_by_force(held):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 256, (3, near_copies.BITS // 8), dtype=np.uint8)
    fps = []
    for k in range(30):
        bits = np.unpackbits(base[k % 3])
        bits[rng.integers(0, near_copies.BITS, 10 * (k % 9))] ^= 1
        fps.append(np.packbits(bits))
    rows = sorted((int(key), i) for i, f in enumerate(fps) for key in near_copies.half_keys(f))
    key, ids = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    words = np.stack(fps).view(np.uint64)
    meet, family, first, again = near_copies._Meeting(), near_copies._Family(0.0, nearest=False), [], []
    for group in np.unique(key >> 16):
        own = key >> 16 == group
        k, i = key[own], ids[own]
        for out in family.group(k, i, i, np.full(len(i), 500), words[i]):
            again += [tuple(sorted(x, reverse=True)) for x in zip(*(out.column(c).to_pylist() for c in (0, 1)), strict=True)]
        if len(k) > held:
            k, i = meet.shorten(k, i)
        meet.groups(k, i)
        part = meet.taken()
        first += list(zip(*(part.column(c).to_pylist() for c in (0, 1)), strict=True))
    members, pairs, want = {a for a, b in first if a == b}, {x for x in first if x[0] != x[1]}, variants_by_force(fps)
    assert pairs <= want and all((i, j) in pairs or {i, j} <= members for i, j in want)
    assert sorted(again) == sorted(want)  # each pair in one place


def test_fingerprint_by_definition():
    s = near_copies.shingles(" ".join(f"w{k * k % 701}" for k in range(900)))
    one = np.stack([near_copies.fingerprint(s[k : k + 1]) for k in range(len(s))])
    assert len(s) > 510 and (near_copies.fingerprint(s) == np.packbits(2 * np.unpackbits(one, axis=1).sum(axis=0, dtype=int) > len(s))).all()
    square = np.unpackbits(one[0]).reshape(32, 32)
    want = [int("".join(map(str, x)), 2) for x in [*square.tolist(), *square.T.tolist(), *([square[i][(k + i) % 32] for i in range(32)] for k in range(32))]]
    assert near_copies.segments(one[0]).tolist() == want


def test_similar_at_the_threshold():
    x = np.arange(9, dtype=np.uint64)
    assert near_copies.similar(x, np.arange(1, 9, dtype=np.uint64)) and not near_copies.similar(x, np.arange(2, 9, dtype=np.uint64))
    assert near_copies.similar(np.arange(8, dtype=np.uint64), np.arange(10, dtype=np.uint64)) and not near_copies.similar(np.arange(7, dtype=np.uint64), x)
