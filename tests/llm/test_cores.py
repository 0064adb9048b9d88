"""The methods' cores against brute force, without Spark."""

import itertools
import math
import random

import numpy as np
import pytest
import public_tokenizers
from strandline.llm import crf_quality, decontaminate, fertility, simhash, toxicity, url_filter
from strandline.llm.sharding import dealt, rebalanced
from strandline.llm.token_counts import Transducer, pieces
from strandline.llm.token_files import Encoder, WaveletMatrix, pack, unpack


def maximal_by_definition(scores):
    """Ruzzo and Tompa: the best segment, then the same to its left and right; of equal scores the shortest."""
    best = None
    for i, j in itertools.combinations(range(len(scores) + 1), 2):
        s = sum(scores[i:j])
        if s > 0 and (best is None or s > best[0] or (s == best[0] and j - i < best[2] - best[1])):
            best = (s, i, j)
    if best is None:
        return []
    s, i, j = best
    right = [(a + j, b + j, t) for a, b, t in maximal_by_definition(scores[j:])]
    return maximal_by_definition(scores[:i]) + [(i, j, s)] + right


@pytest.mark.parametrize("seed", range(40))
def test_maximal_segments(seed):
    r = random.Random(seed)
    scores = [r.choice([-1, -1, -1]) if r.random() < 0.6 else r.choice([1.5, 2.25, 4.125]) + r.randint(0, 999) / 1024 / 1024 for _ in range(r.randint(0, 25))]
    hits = [(i, s) for i, s in enumerate(scores) if s > 0]
    got = toxicity.maximal_segments(hits, 1.0)
    want = maximal_by_definition(scores)
    assert sum(s for _, _, s in got) == pytest.approx(sum(s for _, _, s in want))
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    for a, b, s in got:
        assert s == pytest.approx(sum(scores[a:b])) and s > 0


def test_karlin_root():
    scores, p = np.array([3.0, 5.0]), np.array([0.01, 0.002])
    lam = toxicity._karlin(scores, p, 0.5)
    assert (p * np.exp(lam * scores)).sum() + (1 - p.sum()) * math.exp(-lam * 0.5) == pytest.approx(1, abs=1e-6)


def test_logistic_1d():
    x, y = np.array([0.0, 0.0, 1.0, 1.0]), np.array([0.0, 1.0, 0.0, 1.0])
    a, b = toxicity.logistic_1d(x, y, np.array([90.0, 10.0, 10.0, 90.0]), ridge=0)
    assert 1 / (1 + math.exp(-a)) == pytest.approx(0.1, abs=1e-4) and 1 / (1 + math.exp(-a - b)) == pytest.approx(0.9, abs=1e-4)


def brute_marginals(e, trans):
    total, bad = 0.0, np.zeros(len(e))
    for ys in itertools.product((0, 1), repeat=len(e)):
        w = math.exp(sum(e[i] for i, y in enumerate(ys) if y) + sum(trans[a][b] for a, b in zip(ys, ys[1:], strict=False)))
        total += w
        bad += w * np.array(ys)
    return bad / total, math.log(total)


def test_crf_marginals_and_gradient():
    rng = np.random.default_rng(0)
    model = crf_quality.QualityModel(emit=rng.normal(size=3 * crf_quality.WIDTH), trans=rng.normal(size=(2, 2)))
    seqs = [rng.random((n, crf_quality.WIDTH)).astype(np.float32) for n in (5, 3, 1)]
    for x in seqs:
        want, _ = brute_marginals(crf_quality.with_neighbours(x) @ model.emit, model.trans)
        assert np.allclose(model.marginals(x), want, atol=1e-6)
    lens = np.array([5, 3, 1])
    starts = np.array([0, 5, 8])
    order = [starts[: int((lens > t).sum())] + t for t in range(5)]
    x = np.concatenate([crf_quality.with_neighbours(s) for s in seqs]).astype(float)
    y, weight = rng.integers(0, 2, 9), np.repeat(1 / lens, lens)
    theta = np.concatenate([model.emit, model.trans.ravel()])
    f = lambda t: crf_quality._objective(t, x, y, weight, order, 0.1)
    value, grad = f(theta)
    want = 0.05 * theta @ theta
    for s, n in zip(starts, lens, strict=True):
        e, ys = x[s : s + n] @ model.emit, y[s : s + n]
        score = (e * ys).sum() + sum(model.trans[a, b] for a, b in zip(ys, ys[1:], strict=False))
        want += (brute_marginals(e, model.trans)[1] - score) / n
    assert value == pytest.approx(want)
    for k in (0, 7, 20, len(theta) - 4, len(theta) - 1):
        d = np.zeros_like(theta)
        d[k] = 1e-5
        assert grad[k] == pytest.approx((f(theta + d)[0] - f(theta - d)[0]) / 2e-5, abs=1e-5)


def test_fingerprint_by_definition():
    import xxhash

    text = "The  quick brown\tfox jumps over the lazy DOG again and again and again"
    words = text.encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) > len(grams))
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint("one TWO") == xxhash.xxh64_intdigest(b"one two", 42)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n\t") == 0
    long = " ".join(str(k % 977) for k in range(simhash.SLICE + 5000))
    before, simhash.SLICE = simhash.SLICE, 1000
    try:
        sliced = simhash.fingerprint(long)
    finally:
        simhash.SLICE = before
    assert simhash.fingerprint(long) == sliced


@pytest.mark.parametrize("seed", range(25))
def test_phrases_against_scan(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(r.choice([2, 4, 12]))] + ["é"]
    items = [(str(i), " ".join(r.choice(vocab) for _ in range(r.randint(0, 14)))) for i in range(6)] + [("none", None)]
    docs = [" ".join(r.choice([*vocab, "zz"]) for _ in range(r.randint(0, 60))) for _ in range(7)]
    docs[0] += " " + (items[0][1] or "")
    phrases = decontaminate.Phrases(items, 5)
    for d, (spans, found) in zip(docs, phrases.find([decontaminate.words(d) for d in docs]), strict=True):
        w, hit, names = decontaminate.words(d), set(), set()
        for name, text in items:
            iw = decontaminate.words(text)
            for k in range(max(1, len(iw) - 4)) if iw else []:
                x = iw[k : k + 5]
                for j in range(len(w) - len(x) + 1):
                    if w[j : j + len(x)] == x:
                        hit |= set(range(j, j + len(x)))
                        names.add(name)
        assert {i for a, b in spans.tolist() for i in range(a, b)} == hit
        assert {phrases.names[i] for i in found} == names


def test_cut_out():
    text = "Keep this, one two three four. And this."
    assert decontaminate.cut_out(text, np.array([[2, 6]])) == "Keep this,\n. And this."
    assert decontaminate.cut_out("a b", np.array([[0, 2]])) == ""


@pytest.fixture(scope="module")
def fst():
    return Transducer(public_tokenizers.path("piece_bpe_32k.model"))


PARTS = [" ", "  ", "a", "b", "the", "ing", "\n", "\t", "é", "日本", "🙂", "▁", "<s>", "</s>", "<0x0A>", "\x00", "ﬁ", "ا", "don't", "    ", "0", "12", "....", "!!", "　", "Ａ", "न", "्", "ü", "́"]


def test_transducer_counts_as_the_library(fst):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    r = random.Random(5)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    texts += ["a" * 20_000, " " * 500, "ab" * 300, "=-" * 100, "\n" * 300, "", None]
    assert fst.counts(texts).tolist() == [len(sp.encode(t or "")) for t in texts]


def test_piece_maps_compose(fst):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    r = random.Random(9)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(1, 60))) for _ in range(300)] + ["a" * 500, " " * 100, "=-" * 90, "日本" * 70]
    for t in texts:
        for size in (1, 3, 17):
            state, total = fst.start, 0
            for m in map(fst.piece_map, pieces(t, size)):
                state, n = fst.apply(m, state)
                total += n
            assert total == len(sp.encode(t))


def test_transducer_forgets(fst, monkeypatch):
    import strandline.llm.token_counts as module

    want = fst.counts(["some words here", "and more of them"]).tolist()
    monkeypatch.setattr(module, "MAX_CHUNKS", 1)
    monkeypatch.setattr(module, "MAX_STATES", 1)
    assert fst.counts(["some words here", "and more of them"]).tolist() == want


def test_encoder_as_the_library():
    enc = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    r = random.Random(2)
    more = ["B", "The", "É", "Σ", "<|endoftext|>", "'s", "'S", "...", "\x85", "\x1c", "İ", "ǅ", "¼", "ª", "ß", "_", "Þ", "÷", "\xad", "µ", "Ĳ"]
    texts = ["".join(r.choice(PARTS + more) for _ in range(r.randint(0, 25))) for _ in range(3000)] + ["", "A. B, C.\nD"]
    for t, ids in zip(texts, enc.encode(texts), strict=True):
        assert ids.tolist() == [*enc.tok.encode(t, add_special_tokens=False).ids, 1]
    assert enc.encode([None])[0].tolist() == [1]


@pytest.mark.parametrize("n", [0, 1, 7, 8, 1000])
def test_wavelet_matrix(n):
    values = np.random.default_rng(n).integers(0, 300, n).astype(np.uint16)
    m = WaveletMatrix.build(values, 9)
    assert (m.decode() == values).all()
    for i in range(0, n, 37):
        assert m.access(i) == values[i]
    for v in (0, 5, 299, 511, 700):
        at = np.flatnonzero(values == v)
        assert m.count(v) == len(at) and m.rank(v, n // 2) == (values[: n // 2] == v).sum()
        assert [m.select(v, k) for k in range(len(at))] == at.tolist()
        with pytest.raises(IndexError):
            m.select(v, len(at))


def test_file_round_trip():
    ids = np.arange(100, dtype=np.uint16) % 17
    docs, lengths, m = unpack(pack([None, -4, 2**40], [10, 0, 90], ids, 5))
    assert docs == [None, -4, 2**40] and lengths.tolist() == [10, 0, 90] and (m.decode() == ids).all()
    with pytest.raises(ValueError, match="not a wavelet"):
        unpack(b"nothing here")


def test_rebalanced_map():
    r = random.Random(0)
    sizes = [int(r.paretovariate(1.5) * 100) for _ in range(512)]
    edited = rebalanced(dealt(512, 10), sizes, 10)
    load = [sum(s for s, k in zip(sizes, edited, strict=True) if k == shard) for shard in range(10)]
    assert max(load) <= max(max(sizes), 1.01 * sum(sizes) / 10)
    assert rebalanced(edited, sizes, 10) == edited
    assert rebalanced([0, 0], [0, 0], 3) == [0, 0]


def test_base_counts_by_definition():
    import re

    r = random.Random(4)
    for _ in range(300):
        text = "".join(r.choice(["a", "b ", "c\n", "  ", "#", "é ", " ", "\x1c", "a b a b ", "\n\n", "x|y"]) for _ in range(r.randint(0, 30)))
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = list(zip(words, words[1:], words[2:], strict=False))
        rep = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        dup = sum(x in lines[:k] for k, x in enumerate(lines))
        got = fertility.base_counts(text)
        assert ([w.decode() for w in got[0]], *got[1:]) == (words, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(rep))


def test_url_model_on_unseen_hosts():
    model = url_filter.train()
    p = lambda u: model.probability(*url_filter.cut(u))
    good = ["https://www.thenertion.example.net/en/5", "http://blog.library-news.org/en/history"]
    bad = ["https://casino-win.example.net/en/45", "http://cheap-pills.example.com/en/3", "https://spam-farm.example.org/en/9", "http://adult-x.example.com/en/77", "https://free-bets.example.net/en/2", "https://ads-track.example.com/en/12"]
    assert max(map(p, good)) < 0.4 < min(map(p, bad))
