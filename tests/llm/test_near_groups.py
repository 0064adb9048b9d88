"""Near-dedup of one large group whose texts are mostly just below the similarity: what is compared does not grow with its square."""

import numpy as np
import pytest
from strandline.llm import near_copies
from test_near_copies import stay_by_force


def group(many):
    rng = np.random.default_rng(12)
    base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
    for _ in range(many):
        words = list(base)
        for at in rng.integers(0, 120, 2):
            words[at] = f"x{rng.integers(0, 10**9)}"
        yield " ".join(words)


def test_pairs_of_a_large_group(spark, monkeypatch):
    many, rows = 240, []
    for name in ("_verified", "_checked"):
        monkeypatch.setattr(near_copies, name, lambda pairs, *more, _call=getattr(near_copies, name): rows.append(pairs.count()) or _call(pairs, *more))
    docs = list(enumerate(group(many)))
    kept = [r["doc_id"] for r in near_copies.one_of_each(spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    want = stay_by_force(docs)
    assert 4 < len(want) < many and set(want) <= set(kept) and len(kept) - len(want) <= 0.05 * many
    assert len(rows) == 4 and sum(rows) <= 8 * many, rows


@pytest.mark.parametrize("size", [3, 40, 150, 900, 4000])
def test_maps_rule_out_nothing_similar(size):
    rng = np.random.default_rng(size)
    ruled = 0
    for k in range(200):
        x = rng.integers(0, 1 << 64, size, dtype=np.uint64)
        gone = rng.random(size) < k % 40 / 100
        y = np.concatenate([x[~gone], rng.integers(0, 1 << 64, int(gone.sum()) if k % 2 else 0, dtype=np.uint64)])
        x, y = np.unique(x), np.unique(y)
        if not len(y):
            continue
        n, m, p, q = np.array([len(x)]), np.array([len(y)]), *(near_copies.residues(s).view(np.uint64)[None] for s in (x, y))
        fits = near_copies.possible(n, m, p, q)[0]
        assert fits == near_copies.possible(m, n, q, p)[0] and (fits or not near_copies.similar(x, y))
        ruled += not fits
    assert size > 900 or ruled


def test_all_that_meets_is_verified_or_meets_again(spark):
    met = [(1, 1, 9), (2, 2, 9), (3, 3, 9), (2, 1, 4), (3, 1, 1), (3, 2, 5), (3, 2, 1), (4, 3, 1), (5, 4, 1), (5, -(2**63), 1), (6, 5, 2), (6, 5, 1)]
    family = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    got = near_copies._to_verify(spark.createDataFrame(met, "a long, b long, met long"), family)
    assert sorted(map(tuple, got.collect())) == [(2, 1), (3, 2), (4, 3), (5, -(2**63)), (5, 4), (6, 5)]


def test_more_links_move_whole_classes(spark):
    at = near_copies.Folder(spark, "merged")
    try:
        roots = at.stored(spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5), (7, 5), (9, 9), (10, 9)], "id long, root long"))
        links = at.stored(spark.createDataFrame([(7, 2), (12, 6), (4, 3), (6, 7), (-8, 4)], "a long, b long"))
        got = near_copies._merged(roots, links, at)
        assert sorted(map(tuple, got.collect())) == [(-8, -8), (1, 1), (2, 1), (3, -8), (4, -8), (5, 1), (6, 1), (7, 1), (9, 9), (10, 9), (12, 1)]
    finally:
        at.drop()


def test_members_are_told_once():
    import pyarrow as pa

    rows = [(1, 1, 1), (2, 1, 3), (2, 2, 1), (3, 2, 1), (4, 4, 2), (5, 3, 1), (6, 1, 1), (6, 2, 2), (6, 4, 2), (6, 6, 1)]
    out = near_copies._compact(pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["a", "b", "met"]))
    assert list(zip(*(c.to_pylist() for c in out.columns), strict=True)) == [(2, 1, 3, True), (3, 2, 1, False), (4, 4, 2, True), (5, 3, 1, False), (6, 2, 2, True)]
