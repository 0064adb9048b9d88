"""The operators on awkward tables, and the queries against brute force on small ones."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import oracle
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from strandline.llm import crf_quality, decontaminate, fertility, mixing, sharding, simhash, token_counts, token_files, toxicity, url_filter
from strandline.llm._common import scratch
from strandline.llm._graph import connected_components
from strandline.llm.queries import ORACLE_SQL, QUERIES
from test_near_copies import stay_by_force as near_copies_by_force

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, slot string, copy string, fp string, shard string, __fp string"
LONG = " ".join(f"word{k % 700}" for k in range(30_000)) + " " + "x" * 200_000
TEXTS = [(1, "A plain line.\nAnother one here."), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (6, "same text"), (7, "same text"), (7, "same text"), (None, "no id"), (None, None), (8, "日本語 🙂 é\u2003x"), (9, "a b c d e f g h i j k l")]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, None if k % 4 == 0 else "en", None if k % 3 == 0 else f"s{k % 2}", None, "clash", "clash", "clash", "clash", "clash", "clash") for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 1), (5, 1, 0), (None, 1, 1), (6, None, None), (9, 0, 1), (9, 0, 1)], "doc_id long, quality int, toxic int")


def test_toxicity_awkward(awkward, nothing, labels):
    for docs, n in ((awkward, len(TEXTS)), (nothing, 0)):
        got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
        assert len(got) == n and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert toxicity.train(awkward, labels.limit(0)).lexicon == {}


def test_toxicity_learns(spark):
    rng = np.random.default_rng(6)
    letters = [a + b + c for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    docs = [(k, " ".join(rng.choice(letters, 30)) + (" zounds egad" if k % 5 == 0 else "")) for k in range(1500)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k, _ in docs], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    assert set(model.lexicon) == {b"zounds", b"egad"}
    got = toxicity.score(df, model).collect()
    assert all(r["predicted"] == int(r["doc_id"] % 5 == 0) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    spans = next(r["passages"] for r in got if r["doc_id"] == 5)
    assert [(s["first"], s["end"]) for s in spans] == [(30, 32)]


def test_toxicity_copies_are_no_evidence(spark):
    rng = np.random.default_rng(6)
    letters = [a + b + c for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    docs = [(k, " ".join(rng.choice(letters, 30)) + (" zounds" if k % 5 == 0 else "")) for k in range(1500)]
    docs += [(2000 + k, f"rarely uncommon quaint {docs[3][1]} w{k}") for k in range(200)]
    labels = spark.createDataFrame([(k, int(k >= 2000 or k % 5 == 0)) for k, _ in docs], "doc_id long, toxic int")
    df = spark.createDataFrame([*docs, (5, None), (None, "zounds")], "doc_id long, text string")
    assert set(toxicity.train(df, labels).lexicon) == {b"zounds"}
    assert set(toxicity.train(df, labels, sample=700).lexicon) == {b"zounds"}


@pytest.mark.parametrize(("query", "column", "target"), [("op1_toxicity", "toxic", 0.3), ("op8_crf_quality", "quality", 0.7)])
def test_scores_of_the_query(spark, sf, query, column, target):
    """Each row's score again from its text alone, by the model's own formula over whole texts."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    if column == "toxic":
        model = toxicity.train(docs, labels)
        again = lambda t: model.probability(sum(-np.log(max(x[3], 1e-300)) for x in model.segments(t)[1]))
    else:
        model = crf_quality.train(docs, labels)

        def again(t):
            x, size = crf_quality.line_features(t)
            p, w = model.marginals(x), size if size.sum() else np.ones(len(size))
            return model.probability(float(np.average(p, weights=w)))

    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = QUERIES[query](spark, sf).collect()
    assert len(got) == len(text)
    for r in got:
        assert r["score"] == pytest.approx(again(text[r["doc_id"]])) and r["predicted"] == int(r["score"] >= target)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_quality_awkward(awkward, nothing, labels):
    for docs, n in ((awkward, len(TEXTS)), (nothing, 0)):
        model = crf_quality.train(docs, labels)
        got = crf_quality.score(docs, model).collect()
        assert len(got) == n and all(0 <= r["score"] <= 1 for r in got)
        kept = crf_quality.keep_good(docs, model)
        assert kept.schema == docs.schema and kept.count() == sum(r["predicted"] for r in got)


def test_quality_held_out(spark, sf):
    got = QUERIES["op8_crf_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) / len(got) >= 0.9


def test_mixing_awkward(awkward, nothing):
    got = mixing.mixed(awkward, epochs=3.0)
    again = mixing.mixed(awkward.repartition(5), epochs=3.0)
    key = lambda df: Counter((r["doc_id"], r["text"], r["copy"], r["shuffle_key"]) for r in df.collect())
    assert key(got) == key(again) and got.columns[-1] == "shuffle_key"
    assert mixing.mixed(nothing).count() == 0
    assert mixing.mixed(awkward, {"s0": 0.0}).count() == 0
    assert {r["source"] for r in mixing.mixed(awkward, {None: 1.0}, epochs=5.0).collect()} == {None}


def test_mixing_reaches_weights(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 10 == 0, "rare").otherwise("hot").alias("source"))
    counts = {r["source"]: r["count"] for r in mixing.mixed(docs, {"rare": 1.0, "hot": 1.0}).groupBy("source").count().collect()}
    assert abs(counts["rare"] - 10_000) < 500 and abs(counts["hot"] - 10_000) < 500
    copies = mixing.mixed(docs, {"rare": 1.0}).groupBy("doc_id").count().agg(F.avg("count")).first()[0]
    assert copies == pytest.approx(10, rel=0.05)


def test_poisson_inverse(spark):
    u = [0.0, 0.1, 0.36, 0.37, 0.5, 0.9, 0.999, 1 - 1e-12]
    df = spark.createDataFrame([(x,) for x in u], "u double").withColumn("rate", F.lit(1.0)).withColumn("cdf", mixing.poisson_cdf())
    got = [r[0] for r in df.selectExpr("size(filter(cdf, c -> u >= c))").collect()]
    total, want = [], []
    p = acc = np.exp(-1.0)
    for k in range(1, 30):
        total.append(acc)
        p /= k
        acc += p
    want = [sum(x >= c for c in total) for x in u]
    assert got == want


@pytest.mark.parametrize("rate", [499, 501, 5000])
def test_mixing_of_high_rates(spark, rate):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("s").alias("source"))
    got = sorted((r["doc_id"], r["copy"]) for r in mixing.mixed(docs, epochs=float(rate)).collect())
    n = Counter(i for i, _ in got)
    assert got == sorted((i, c + 1) for i, k in n.items() for c in range(k))
    mean, var = np.mean(list(n.values())), np.var(list(n.values()))
    assert abs(mean - rate) < 5 * (rate / 40) ** 0.5 and 0.4 < var / rate < 2


def test_mixture_keeps_columns(spark):
    docs = spark.createDataFrame([(k, "t", "s", "mine", 7) for k in range(50)], "doc_id long, text string, source string, copy string, shuffle_key int")
    got = mixing.replicated(docs)
    assert got.schema == docs.schema
    assert Counter(r["doc_id"] for r in got.collect()) == Counter(r["doc_id"] for r in mixing.mixed(docs).collect()) and {(r["copy"], r["shuffle_key"]) for r in got.collect()} == {("mine", 7)}


def test_mixture_is_in_hash_order(spark, sf):
    keys = [r["shuffle_key"] for r in QUERIES["op2_mixing"](spark, sf).collect()]
    assert keys == sorted(keys) and len(keys) > 100


def test_urls(spark):
    rows = [(1, "HTTP://A.Example.ORG/es/1?x=/fr/"), (2, "https://example.org/en/17#t"), (3, "https://org/x"), (4, "https://x.com/fr/"), (5, "http://y.com/de/a"), (6, None), (7, "no scheme"), (8, "http://casino-win.net"), (None, "https://notexample.org/es/"), (9, "a://b://c/d"), (9, ""), (10, "https://org?q")]
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, host string, verdict string")
    got = url_filter.judged(pages).collect()
    assert [(r["host"], r["path"]) for r in got] == [url_filter.cut(u) for _, u in rows]
    assert [r["rule"] for r in got] == ["example.org/es/", "example.org/en/1", "org/", "com/fr/", "com/de/", None, None, None, "org/", None, None, None]
    assert [r["verdict"] for r in got][:5] == ["block", "block", "allow", "allow", "block"] and got[7]["verdict"] == "block" and got[8]["verdict"] == "allow"
    assert url_filter.judged(pages.limit(0)).count() == 0


def classes_by_force(ids_fps):
    fps = sorted({f for _, f in ids_fps})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(fps):
        for b in fps[k + 1 :]:
            if (a ^ b).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    least = {}
    for i, f in ids_fps:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return [least.get(find(f)) for _, f in ids_fps]


@pytest.mark.parametrize("dense", [2000, 1])
def test_links_by_force(spark, dense):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = [int(b) ^ sum(1 << int(x) for x in set(rng.integers(0, 64, rng.integers(0, 5)).tolist())) for b in base for _ in range(8)] + [0, 7, 15, 1 << 63]
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long").distinct()
    got = {r["fp"] % (1 << 64): r["root"] % (1 << 64) for r in simhash.classes(df, dense).collect()}
    want = classes_by_force([(f, f) for f in fps])
    for (i, f), (j, g) in zip(enumerate(fps), enumerate(fps[1:], 1), strict=False):
        assert (got[f] == got[g]) == (want[i] == want[j])
    assert len(set(got.values())) == len(set(want))


def test_near_duplicates_awkward(awkward, nothing):
    got = simhash.near_duplicates(awkward).collect()
    assert sorted((r["doc_id"] or -1, r["fingerprint"], r["component_id"]) for r in got) == sorted((i or -1, f"{simhash.fingerprint(t):016x}", c) for (i, t), c in zip(TEXTS, classes_by_force([(i, simhash.fingerprint(t)) for i, t in TEXTS]), strict=True))
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.one_of_each(awkward)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "5", "6", "8", "9", "None"]
    assert "__fp" not in kept.columns and simhash.one_of_each(nothing).count() == 0


def test_components(spark):
    chain = [(k, k + 1) for k in range(200)] + [(500, 501), (501, 500), (7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(201)} | {500: 500, 501: 500}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def leaks_by_force(text, items, window=10):
    w, hit, names = decontaminate.words(text), set(), set()
    for name, t in items:
        iw = decontaminate.words(t)
        for k in range(max(1, len(iw) - window + 1)) if iw else []:
            x = iw[k : k + window]
            for j in range(len(w) - len(x) + 1):
                if w[j : j + len(x)] == x:
                    hit |= set(range(j, j + len(x)))
                    names.add(name)
    names -= {None}
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


def test_decontamination_awkward(spark, awkward, nothing):
    items = [("10", "word1 word2 word3 word4 word5 word6 word7 word8 word9 word10 word11"), ("9", "Same TEXT"), ("2", None), ("3", "..."), (None, "plain line"), ("11", "a b c d e f g h i j k l")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    by_text = {}
    for size in (4 << 20, 20):
        got = decontaminate.contamination(awkward, bench, block_bytes=size).drop("spans").collect()
        assert Counter((r["doc_id"], *tuple(r)[1:]) for r in got) == Counter((i, *leaks_by_force(t, items)) for i, t in TEXTS)
        cut = decontaminate.remove_contamination(awkward, bench, block_bytes=size)
        by_text[size] = Counter(map(tuple, cut.collect()))
        assert cut.schema == awkward.schema
    assert by_text[20] == by_text[4 << 20]
    assert decontaminate.contamination(nothing, bench).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.contamination(awkward, bench.limit(0)).collect())
    clean = decontaminate.remove_contamination(awkward, bench)
    rows = clean.collect()
    assert clean.schema == awkward.schema and len(rows) == len(TEXTS) - 4
    assert all(leaks_by_force(r["text"], items)[1] == 0 for r in rows)
    assert next(r for r in rows if r["doc_id"] == 5)["n_chars"] == len(next(r for r in rows if r["doc_id"] == 5)["text"])


def test_decontamination_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op5_decontaminate"](spark, sf).collect()}
    starts = {}
    for name, t in items:
        w = decontaminate.words(t)
        for k in range(max(1, len(w) - 9)):
            starts.setdefault(tuple(w[k : k + 10]), set()).add(name)
    assert {len(k) for k in starts} == {10}
    for d in docs:
        w, hit, names = decontaminate.words(d["text"]), set(), set()
        for j in range(len(w) - 9):
            found = starts.get(tuple(w[j : j + 10]))
            if found:
                hit |= set(range(j, j + 10))
                names |= found
        assert got[d["doc_id"]] == (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))


def test_fertility_awkward(awkward, nothing):
    got = fertility.judged(awkward).collect()
    want = sorted((i or -1, len(w), c, s, d, r) for i, t in TEXTS for w, c, s, d, r in [fertility.base_counts(t)])
    assert sorted((r["doc_id"] or -1, r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    assert all(r["base_failed"] == (r["n_words"] < 50 or 2 * r["n_repeat_words"] > r["n_words"]) and not (r["kept"] and r["base_failed"]) for r in got)
    assert fertility.judged(nothing).count() == 0


def test_fertility_rejects_outliers(spark):
    rng = np.random.default_rng(3)
    names = ["the", "house", "river", "under", "green", "walks", "slowly", "bright", "morning", "stone"] + [f"{a}{b}" for a in ("over", "out", "in") for b in ("land", "side", "come", "look")]
    plain = [(k, " ".join(rng.choice(names, 120)), "en") for k in range(300)]
    odd = [(1000, " ".join(chr(0x13000 + int(x)) * 3 for x in rng.integers(0, 900, 120)), "en"), (1001, " ".join(rng.choice(["xq#z", "qq@j"], 120)), "en")]
    got = {r["doc_id"]: r["kept"] for r in fertility.judged(spark.createDataFrame(plain + odd, "doc_id long, text string, lang string")).collect()}
    assert not got[1000] and not got[1001] and sum(got[k] for k, _, _ in plain) >= 299


def quartile_fences(counts, fence=3.0, least=0.12):
    """A band by hand from {bin: weight}."""
    total, upto, q = sum(counts.values()), 0.0, {}
    for k in sorted(counts):
        upto += counts[k]
        for x in (0.25, 0.5, 0.75):
            if upto >= (x - 1e-9) * total:
                q.setdefault(x, k)
    reach = fence * (q[0.75] - q[0.25] + 1)
    return min(q[0.25] - reach, q[0.5] * (1 - least)) / fertility.BINS, max(q[0.75] + 1 + reach, q[0.5] * (1 + least) + 1) / fertility.BINS


def test_fertility_query_by_force(spark, sf):
    lang = {r["doc_id"]: r["lang"] or "und" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op6_fertility"](spark, sf).collect()
    group = lambda r, x: (int(np.floor(np.log2(max(1, r["n_tokens"]))))) if x == "entropy" else -1
    passing = [r for r in got if not r["base_failed"]]
    for x in fertility.MEASURES:
        at = [(lang[r["doc_id"]], group(r, x), int(np.floor(r[x] * fertility.BINS))) for r in passing]

        def drawn(own, above, weight=fertility.WEIGHT):
            n = Counter(own)
            total = sum(above.values())
            return {k: n[k] + weight * v / total for k, v in above.items()}

        everyone, band = Counter(b for _, _, b in at), {}
        for key in {(a, o) for a, o, _ in at}:
            above = drawn([b for _, o, b in at if o == key[1]], everyone)
            band[key] = quartile_fences(drawn([b for a, o, b in at if (a, o) == key], above))
        for r in passing:
            low, high = band[lang[r["doc_id"]], group(r, x)]
            assert (x in r["outside"].split(",")) == (not low <= r[x] <= high)
    assert all(r["kept"] == (not r["base_failed"] and r["outside"] == "") for r in got) and len(passing) > 100


@pytest.mark.parametrize("n", [1, 20, 99, 101])
def test_fertility_judges_small_tables(spark, n):
    rng = np.random.default_rng(3)
    plain = [(k, " ".join(rng.choice(["the", "house", "river", "under", "green", "walks", "slowly", "bright", "morning", "stone"], 120)), "en") for k in range(n)]
    odd = [(1000, " ".join(chr(0x13000 + int(x)) * 3 for x in rng.integers(0, 900, 120)), "en")]
    got = {r["doc_id"]: r["kept"] for r in fertility.judged(spark.createDataFrame(plain + odd, "doc_id long, text string, lang string")).collect()}
    assert n == 1 or (not got[1000] and all(got[k] for k, _, _ in plain))


def test_token_counts_awkward(awkward, nothing):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = token_counts.count_tokens(awkward, limit=1000).collect()
    want = [(i, len((t or "").encode()), len(sp.encode(t or ""))) for i, t in TEXTS]
    assert sorted(map(str, ((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got))) == sorted(map(str, want)) and all(r["over_limit"] == (r["n_tokens"] > 1000) for r in got)
    assert token_counts.count_tokens(nothing).count() == 0


def test_long_texts_are_counted_in_pieces(spark):
    import sentencepiece

    rng, sp = np.random.default_rng(4), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    blank = "".join(chr(x) for x in rng.choice(np.array([*range(0x4E00, 0x4F00), *range(97, 123)]), 3_000_000))
    texts = [(1, blank), (1, blank), (None, "x" * (1 << 20)), (2, " y" * (1 << 19)), (3, "short")]
    got = token_counts.count_tokens(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    want = [(i, len(t.encode()), len(sp.encode(t))) for i, t in texts]
    assert sorted(map(str, ((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got))) == sorted(map(str, want))


def test_token_counts_query(spark, sf):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op7_token_counts"](spark, sf).collect()
    assert len(got) == len(texts) and all(r["n_tokens"] == len(sp.encode(texts[r["doc_id"]])) for r in got)


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_sharding_awkward(awkward, nothing, shards):
    got = sharding.sharded(awkward, shards, slots=64).collect()
    assert len(got) == len(TEXTS)
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in got) == sorted((i or -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in TEXTS)
    for s in range(shards):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert sharding.sharded(nothing, shards, slots=64).count() == 0


def test_sharding_query_is_even(spark, sf):
    got = QUERIES["op9_sharding"](spark, sf).collect()
    load = Counter()
    for r in got:
        load[r["shard"]] += r["size"]
    assert set(load) == set(range(40)) and max(load.values()) - min(load.values()) <= max(r["size"] for r in got)
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}


def test_sharding_query_by_force(spark, sf):
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op9_sharding"](spark, sf).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {i: (len(t) + 16, zlib.crc32(t)) for i, t in docs.items()}
    for s in range(40):
        own = sorted((r for r in got if r["shard"] == s), key=lambda r: (r["vslot"], r["doc_id"]))
        assert [r["slot"] for r in own] == list(range(len(own)))
    shard_of = {}
    assert all(shard_of.setdefault(r["vslot"], r["shard"]) == r["shard"] for r in got)


def test_equal_records_spread(spark, tmp_path):
    docs = spark.range(1000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same text").alias("text"))
    load = Counter()
    for r in sharding.sharded(docs, 4).collect():
        load[r["shard"]] += r["size"]
    assert len(load) == 4 and max(load.values()) < 1.1 * min(load.values())
    sharding.write_shards(docs, 4, str(tmp_path / "out"), bytes_per_file=2000)
    assert all(1 < len(list((tmp_path / "out" / f"shard={s}").glob("*.parquet"))) <= 5 for s in range(4))


def test_map_versions(spark):
    path = scratch(spark, "map")
    sharding.store_map(spark, path, 1, [0, 1, 0])
    sharding.store_map(spark, path, 2, [0, 1, 1])
    read = lambda v=None: sorted(map(tuple, sharding.load_map(spark, path, v).select("slot", "shard").collect()))
    assert read(1) == [(0, 0), (1, 1), (2, 0)] and read() == [(0, 0), (1, 1), (2, 1)]


@pytest.mark.parametrize("shard_tokens", [1 << 18, 8])
def test_token_files_awkward(awkward, nothing, shard_tokens):
    enc = token_files.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    got = sorted(token_files.token_table(awkward, shard_tokens=shard_tokens).collect(), key=lambda r: (r["start"], r["n_tokens"]))
    at = 0
    for r, (i, t) in zip(got, sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")), strict=True):
        ids = [*enc.tok.encode(t or "", add_special_tokens=False).ids, 1]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)
    assert token_files.token_table(nothing).count() == 0


def test_token_files_query(spark, sf):
    enc = token_files.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    got, at = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op10_token_files"](spark, sf).collect()}, 0
    for d in sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r["doc_id"]):
        ids = [*enc.tok.encode(d["text"], add_special_tokens=False).ids, 1]
        assert got[d["doc_id"]] == (at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(name, spark, sf):
    assert oracle.from_spark(QUERIES[name](spark, sf)) == oracle.from_sql(oracle.connect(sf), ORACLE_SQL[name])


def test_simhash_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = classes_by_force([(d["doc_id"], simhash.fingerprint(d["text"])) for d in docs])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op4_simhash"](spark, sf).collect()}
    assert got == {d["doc_id"]: (f"{simhash.fingerprint(d['text']):016x}", c) for d, c in zip(docs, want, strict=True)}


def test_pipeline_stages_by_force(spark, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {"": docs}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = list(rows.values())[-1]
        out = scratch(spark, "stage")
        stage(spark, before, sf).write.parquet(out)
        rows[name] = spark.read.parquet(out)
        assert rows[name].columns == docs.columns
    kept, single, clean, mixture = list(rows.values())[1:]
    scores = crf_quality.score(docs, crf_quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet")))
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(r[0] for r in scores.where("predicted = 1").select("doc_id").collect())
    left = {r[0] for r in single.select("doc_id").collect()}
    want = set(near_copies_by_force([(r["doc_id"], r["text"]) for r in kept.orderBy("doc_id").collect()]))
    assert want <= left and len(left - want) <= 1
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hits = {r["doc_id"]: r["contaminated"] for r in decontaminate.contamination(single, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    old, new = ({r["doc_id"]: r["text"] for r in d.collect()} for d in (single, clean))
    assert all(new[i] == t for i, t in old.items() if not hits[i])
    assert all(leaks_by_force(new[i], items)[1] == 0 for i in list(new)[:40] if hits[i])
    want = mixing.mixed(clean).groupBy("doc_id").count().collect()
    assert Counter(r[0] for r in mixture.select("doc_id").collect()) == {r["doc_id"]: r["count"] for r in want}
    last = corpus_pipeline.STAGES[-1][1](spark, mixture, sf)
    assert Counter(r[0] for r in last.select("doc_id").collect()) == Counter(r[0] for r in mixture.select("doc_id").collect())
