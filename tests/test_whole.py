"""Registered queries that take the whole table, and their tables' rows."""

import hashlib

from strandline.plans.queries import QUERIES, table


def test_replace_reaches_the_end(spark, sf):
    docs = table(spark, sf, "documents")
    want = {r["doc_id"]: hashlib.md5(r["text"].replace("e", "3").encode()).hexdigest() for r in docs.where("text is not null").collect()}
    got = QUERIES["string_replace"](spark, sf).where("r is not null").collect()
    assert {r["doc_id"]: r["r"] for r in got} == want


def test_sort_places_every_row(spark, sf):
    rows = table(spark, sf, "orders").collect()
    order = sorted(rows, key=lambda r: (-r["o_totalprice"], r["o_orderkey"]))
    got = QUERIES["sort_values_all"](spark, sf).orderBy("place").collect()
    assert [(r["place"], r["o_orderkey"]) for r in got] == [(k, r["o_orderkey"]) for k, r in enumerate(order, 1)] and len(got) > 500


def test_reindex_keeps_every_order_and_fills(spark, sf):
    rows = {r["o_orderkey"]: r["o_totalprice"] for r in table(spark, sf, "orders").collect()}
    got = {r["o_orderkey"]: r["o_totalprice"] for r in QUERIES["reindex_fill_all"](spark, sf).collect()}
    assert got == rows | {max(rows) + k: -1.0 for k in range(1, 501)} and len(rows) > 500


def test_gaps_count_every_event(spark, sf):
    got = QUERIES["resample_fill_gaps_all"](spark, sf).collect()
    assert sum(r["n"] or 0 for r in got) == table(spark, sf, "events").count() and any(r["n"] is None for r in got)
