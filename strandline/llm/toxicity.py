"""Toxicity by maximum-scoring segment search over token log-odds.

Tokens are runs of ASCII letters and non-ASCII characters, A-Z lower-cased. Their log-odds between toxic and
other training documents carry an informative Dirichlet prior proportional to the pooled incidence (Monroe et
al., 2008); a token scores the odds' lower confidence bound when that is significant, and a small negative
drift otherwise. A linear scan (Ruzzo and Tompa, 1999) then finds every maximal-scoring segment of a text, and
Karlin-Altschul statistics give each an E-value for a text of that length. The significant segments' summed
normalised scores, calibrated on the training documents, give the document's probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import few, held_out, ship, stored

SPLIT = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes(ord(LOWER[UPPER.index(chr(c))]) if chr(c) in UPPER else c if chr(c) in LOWER or c > 127 else 32 for c in range(256))


REACH = 3


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


@dataclass
class ToxicityModel:
    """lexicon: token -> score; every other token scores -drift. lam, k: Karlin-Altschul. slope, bias: calibration."""

    lexicon: dict[bytes, float] = field(default_factory=dict)
    drift: float = 0.5
    lam: float = 1.0
    k: float = 0.1
    max_evalue: float = 0.05
    slope: float = 1.0
    bias: float = -3.0

    def segments(self, text: str | None) -> tuple[int, list[tuple[int, int, float, float]]]:
        """Token count, and (first token, end token, score, E-value) of each significant maximal segment."""
        toks = words(text)
        get = self.lexicon.get
        hits = [(i, s) for i, s in enumerate(map(get, toks)) if s is not None]
        found = maximal_segments(hits, self.drift)
        n = max(1, len(toks))
        out = [(a, b, s, self.k * n * math.exp(-self.lam * s)) for a, b, s in found]
        return len(toks), [x for x in out if x[3] <= self.max_evalue]

    def evidence(self, segments: list[tuple[int, int, float, float]]) -> float:
        """Sum over the significant segments of -ln(E-value)."""
        return sum(-math.log(max(x[3], 1e-300)) for x in segments)

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.bias + self.slope * math.log1p(evidence)))))


def maximal_segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments [start, end) of a sequence whose tokens score -drift but for `hits` (index, score).

    Linear: only the positive hits start or end a segment, so the candidates of the classic algorithm are
    (start, end, sum before, sum after) of those. Ties keep the longer segment's first form.
    """
    stack: list[list[float]] = []  # start, end, left sum, right sum
    link: list[int] = []  # of each: the nearest candidate before it with a smaller left sum
    total, last = 0.0, 0
    for i, s in hits:
        total -= drift * (i - last)
        last = i + 1
        if s <= 0:
            total += s
            continue
        now = [i, i + 1, total, total + s]
        total += s
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= now[2]:
                j = link[j]
            if j < 0 or stack[j][3] >= now[3]:
                stack.append(now)
                link.append(j)
                break
            now = [stack[j][0], now[1], stack[j][2], now[3]]
            del stack[j:], link[j:]
    return [(int(a), int(b), r - lft) for a, b, lft, r in stack]


def log_odds(y1: np.ndarray, n1: float, y0: np.ndarray, n0: float, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of the toxic against the other incidence, and its standard deviation, under the Dirichlet prior."""
    alpha = prior * (y1 + y0)
    a0 = prior * (n1 + n0)
    odds = np.log((y1 + alpha) / (n1 + a0 - y1 - alpha)) - np.log((y0 + alpha) / (n0 + a0 - y0 - alpha))
    return odds, np.sqrt(1 / (y1 + alpha) + 1 / (y0 + alpha))


def _karlin(scores: np.ndarray, p: np.ndarray, drift: float) -> float:
    """The positive root of sum p e^(lam s) = 1, the rest of the probability at -drift."""
    rest = max(0.0, 1 - float(p.sum()))

    def excess(lam: float) -> float:
        return float((p * np.exp(np.minimum(lam * scores, 600))).sum()) + rest * math.exp(-lam * drift) - 1

    low, high = 1e-6, 1.0
    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return (low + high) / 2


def known_labels(labels: DataFrame, target: str) -> DataFrame:
    """(__id, y) of the ids that are labelled 0 or 1 and not held out; of repeated ones the larger label."""
    y = labels.select(F.col("doc_id").alias("__id"), F.col(target).cast("int").alias("y")).where("y in (0, 1) and __id is not null")
    return y.groupBy("__id").agg(F.max("y").alias("y")).where(~held_out("__id"))


def labelled(docs: DataFrame, labels: DataFrame, target: str, sample: int) -> DataFrame:
    """(doc_id, text, y) of the training rows, written once; of at most `sample` ids of each label, those with the smallest hash."""
    y = stored(known_labels(labels, target), "labels")
    mark, chosen = F.xxhash64("__id", F.lit(7)), []
    for k, n in sorted((r["y"], r["count"]) for r in y.groupBy("y").count().collect()):
        share = min(1.0, 1.5 * sample / n + 1000 / n)  # a share by hash first, so that the sort has few to keep
        own = y.where((F.col("y") == k) & (F.pmod(mark, F.lit(1 << 20)) < int(share * (1 << 20))))
        chosen.append(own if n <= sample else own.orderBy(mark, "__id").limit(sample))
    if not chosen:
        return docs.limit(0).select("doc_id", "text", F.lit(0).alias("y"))
    ids = few(stored(reduce(DataFrame.unionAll, chosen), "sample"))
    return stored(docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("__id")).select("doc_id", "text", "y"), "labelled")


def contexts(rows: DataFrame) -> DataFrame:
    """(w, context): one context of each token of each text, that with the least hash, without repeats.

    A context is the tokens REACH before and behind. Copies and near copies of a text have the same contexts, so the rare
    words of a much-copied document are no evidence, while a word or short phrase that makes texts toxic stands in
    different ones. No row is left out.
    """
    w = rows.select(F.xxhash64("text").alias("t"), F.split(F.translate("text", UPPER, LOWER), SPLIT).alias("ws")).where("ws is not null")
    near = F.transform("ws", lambda x, i: F.struct(x.alias("w"), F.xxhash64(F.get("ws", i - REACH), F.get("ws", i + REACH)).alias("context")))
    each = w.select("t", F.explode(near).alias("x")).groupBy("t", "x.w").agg(F.min("x.context").alias("context"))
    return each.select("w", "context").distinct()


def train(docs: DataFrame, labels: DataFrame, prior: float = 0.1, z: float = 3.0, bound: float = 1.0, drift: float = 0.5, sample: int = 100_000) -> ToxicityModel:
    """Fit on labelled rows that are not held out; a token's incidence is that of documents, among toxic ones of contexts().

    prior: prior mass as a share of all incidences. z: least z-score of a lexicon token. bound: standard
    deviations taken off its log-odds. sample: at most so many labelled ids of each kind, those with the smallest hash,
    which bounds the lexicon, so that it can be sent to every task: it holds no token that is not in two of their toxic
    texts. Without labelled rows of both kinds the lexicon is empty.
    """
    rows = labelled(docs, labels, "toxic", sample)
    toxic = contexts(rows.where("y = 1")).groupBy("w").agg(F.count("*").alias("y1")).select("w", "y1", F.col("y1").alias("n"))
    toks = F.array_distinct(F.split(F.translate("text", UPPER, LOWER), SPLIT))
    other = rows.where("y = 0").select(F.explode(toks).alias("w")).groupBy("w").agg(F.count("*").alias("n")).select("w", F.lit(0).cast("long").alias("y1"), "n")
    seen = toxic.unionAll(other).where("w <> ''").groupBy("w").agg(F.sum("y1").alias("y1"), F.sum("n").alias("n"))
    seen = stored(seen, "incidence")
    n1, n = (float(x or 0) for x in seen.agg(F.sum("y1"), F.sum("n")).first())
    model = ToxicityModel(drift=drift)
    if n1 == 0 or n == n1:
        return model
    n0 = n - n1
    y1, y0 = F.col("y1"), F.col("n") - F.col("y1")
    alpha, a0 = prior * F.col("n"), prior * n
    odds = F.ln((y1 + alpha) / (n1 + a0 - y1 - alpha)) - F.ln((y0 + alpha) / (n0 + a0 - y0 - alpha))
    sd = F.sqrt(1 / (y1 + alpha) + 1 / (y0 + alpha))
    strong = seen.where("y1 >= 2").withColumn("odds", odds).withColumn("sd", sd).where(F.col("odds") >= z * F.col("sd"))
    top = strong.select("w", "y1", "n").collect()
    if not top:
        return model
    c1, c = (np.array([r[k] for r in top], dtype=float) for k in ("y1", "n"))
    est, dev = log_odds(c1, n1, c - c1, n0, prior)
    score = est - bound * dev
    keep = score > 0
    model.lexicon = {r["w"].encode(): float(s) for r, s, k in zip(top, score, keep, strict=True) if k}
    background = (c - c1 + 0.5) / (n0 + 1)
    model.lam = _karlin(score[keep], background[keep], drift)
    _calibrate(model, rows)
    return model


def _calibrate(model: ToxicityModel, rows: DataFrame) -> None:
    """Logistic fit of the label on ln(1 + evidence) over all training rows, from counts in 0.05-wide bins."""
    held = ship(rows.sparkSession).sparkContext.broadcast(model)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, counts = held.value, {}
        for b in batches:
            for t, y in zip(b.column(0), b.column(1), strict=True):
                x = math.log1p(m.evidence(m.segments(t.as_py())[1]))
                key = (min(400, int(x * 20)), y.as_py())
                counts[key] = counts.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.int32()), pa.array([k[1] for k in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["x", "y", "n"])

    got = rows.select("text", "y").mapInArrow(bins, "x int, y int, n long").groupBy("x", "y").agg(F.sum("n").alias("n")).collect()
    x, y, n = (np.array([r[k] for r in got], dtype=float) for k in ("x", "y", "n"))
    model.bias, model.slope = logistic_1d(x / 20, y, n)


def logistic_1d(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Bias and slope (not negative) of a weighted logistic fit with a ridge on the slope; by Newton steps."""
    a, b = 0.0, 1.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -40, 40)))
        g = np.array([(n * (y - p)).sum(), (n * (y - p) * x).sum() - ridge * b])
        v = n * p * (1 - p) + 1e-9 * n
        h = np.array([[v.sum(), (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + ridge]])
        step = np.linalg.solve(h + 1e-9 * np.eye(2), g)
        scale = min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
        a, b = a + scale * step[0], b + scale * step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(max(0.0, b))


PASSAGES = "array<struct<first:long,end:long,score:double,evalue:double>>"


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_tokens, n_passages, passages) for each row of docs.

    passages lists every significant segment by its token positions. Null and blank texts have no passage and
    get the score of no evidence. Rows are neither merged nor dropped; a null doc_id is not held out.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = ship(docs.sparkSession).sparkContext.broadcast(model)
    form = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("evalue", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            found = [m.segments(t.as_py()) for t in b.column(1)]
            p = [m.probability(m.evidence(s)) for _, s in found]
            spans = [[dict(zip(("first", "end", "score", "evalue"), x, strict=True)) for x in s] for _, s in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(p, pa.float64()), pa.array([n for n, _ in found], pa.int64()), pa.array(spans, form)], names=["doc_id", "score", "n_tokens", "passages"]
            )

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, n_tokens long, passages {PASSAGES}")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_tokens", F.size("passages").cast("long").alias("n_passages"), "passages")
