"""Document quality from a linear-chain conditional random field over lines.

Every line is a node with two states, good and bad. Its emission weights see its own features and those of the
lines before and after it; transition weights tie neighbouring labels. Training maximises the conditional
likelihood by L-BFGS on a bounded sample of labelled documents: first with each document's label on all its
lines, then again with the lines of bad documents relabelled by their marginals, since a bad document may
hold good lines. Forward-backward gives each line's marginal of being bad; their mean, weighted by line
length, is calibrated on training documents into the document's probability of good quality.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import held_out, in_batches, ship, stored
from .toxicity import known_labels, logistic_1d

_ALPHA = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DIGIT = b"0123456789"
_SYMBOL = b"#*$%&|<>{}[]\\^~=_+@/"
_SHOUT = b"!?"
_STOP = b".,;:'\"()-"
FEATURES = ("bias", "short", "long", "upper", "digit", "symbol", "shout", "stop", "word_length", "unique", "adjacent", "pipes", "copy", "ends", "blank")
WIDTH = len(FEATURES)


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x WIDTH features in 0..1, bytes of each line) of the \\n-split text; a null or empty text is one blank line."""
    lines = (text or "").encode().split(b"\n")
    out = np.zeros((len(lines), WIDTH), dtype=np.float32)
    seen: set[bytes] = set()
    for k, line in enumerate(lines):
        n = len(line)
        ws = line.split()
        row = out[k]
        row[0] = 1.0
        if not ws:
            row[14] = 1.0
            continue
        count = lambda chars: n - len(line.translate(None, chars))  # noqa: E731, B023
        alpha, m = max(1, count(_ALPHA)), len(ws)
        pipes = line.count(b"|")
        row[1:] = (
            1 / (1 + m / 4), min(1.0, m / 200), count(_UPPER) / alpha, min(1.0, 4 * count(_DIGIT) / n), min(1.0, count(_SYMBOL) / m), min(1.0, count(_SHOUT) / m), min(1.0, count(_STOP) / m),
            min(1.0, n / m / 20), len(set(ws)) / m, sum(map(eq, ws, ws[1:])) / m, min(1.0, 2 * pipes / m), float(line in seen), float(ws[-1][-1:] in b".!?:\"" and ws[-1][-1:] != b""), 0.0,
        )
        seen.add(line)
    return out, np.array([len(x) for x in lines], dtype=np.float64)


def with_neighbours(x: np.ndarray) -> np.ndarray:
    """Each line's features beside those of the lines before and after (zeros, so no bias, beyond the ends)."""
    n = len(x)
    out = np.zeros((n, 3 * WIDTH), dtype=np.float32)
    out[:, :WIDTH] = x
    out[1:, WIDTH : 2 * WIDTH] = x[:-1]
    out[:-1, 2 * WIDTH :] = x[1:]
    return out


@dataclass
class QualityModel:
    """emit: weights of state bad against good. trans: log-potentials [from, to], 0 good and 1 bad."""

    emit: np.ndarray = field(default_factory=lambda: np.zeros(3 * WIDTH))
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    bias: float = 4.0
    slope: float = 8.0

    def marginals(self, x: np.ndarray) -> np.ndarray:
        """P(bad) of each line, by forward-backward."""
        e = with_neighbours(x) @ self.emit
        n = len(e)
        (t00, t01), (t10, t11) = np.exp(self.trans).tolist()
        odds = np.exp(np.clip(e, -30, 30)).tolist()
        fg, fb = [0.0] * n, [0.0] * n
        g, b = 1.0, odds[0]
        for i in range(n):
            if i:
                g, b = g * t00 + b * t10, (g * t01 + b * t11) * odds[i]
            s = g + b
            g, b = g / s, b / s
            fg[i], fb[i] = g, b
        out = np.empty(n)
        g, b = 1.0, 1.0
        for i in range(n - 1, -1, -1):
            out[i] = fb[i] * b / (fg[i] * g + fb[i] * b)
            b *= odds[i]
            g, b = t00 * g + t01 * b, t10 * g + t11 * b
            s = g + b
            g, b = g / s, b / s
        return out

    def badness(self, text: str | None) -> tuple[float, int, int]:
        """Length-weighted mean of the lines' P(bad), lines, lines more likely bad."""
        x, size = line_features(text)
        p = self.marginals(x)
        w = size if size.sum() > 0 else np.ones(len(size))
        return float((p * w).sum() / w.sum()), len(p), int((p > 0.5).sum())

    def probability(self, badness: float) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.bias - self.slope * badness))))


def _objective(theta: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray, order: list[np.ndarray], ridge: float) -> tuple[float, np.ndarray]:
    """Negative conditional log-likelihood and gradient. order[t]: line number at place t of each sequence that long, longest first."""
    w, tr = theta[:-4], theta[-4:].reshape(2, 2)
    e = x @ w
    steps = len(order)
    fwd: list[np.ndarray] = []
    for t in range(steps):
        idx = order[t]
        emit = np.stack([np.zeros(len(idx)), e[idx]], axis=1)
        if t:
            a = fwd[-1][: len(idx)]
            emit += np.logaddexp(a[:, :1] + tr[0], a[:, 1:] + tr[1])
        fwd.append(emit)
    ends = [len(o) for o in order] + [0]
    first = order[0] if steps else np.zeros(0, dtype=int)
    sw = weight[first]
    logz = np.zeros(len(first))
    p = np.zeros(len(e))
    gt = np.zeros((2, 2))
    loss = 0.0
    back = np.zeros((0, 2))
    for t in range(steps - 1, -1, -1):
        idx = order[t]
        now = np.zeros((len(idx), 2))
        nxt = ends[t + 1]
        if nxt:
            j = order[t + 1]
            m = np.stack([back[:, 0], back[:, 1] + e[j]], axis=1)
            now[:nxt] = np.logaddexp(tr[:, 0] + m[:, :1], tr[:, 1] + m[:, 1:])
            z = logz[:nxt]
            pair = np.exp(fwd[t][:nxt, :, None] + tr[None] + m[:, None, :] - z[:, None, None])
            gt += (pair * sw[:nxt, None, None]).sum(axis=0)
            np.add.at(gt, (y[idx[:nxt]], y[j]), -sw[:nxt])
            loss -= (tr[y[idx[:nxt]], y[j]] * sw[:nxt]).sum()
        if nxt < len(idx):
            logz[nxt : len(idx)] = np.logaddexp(fwd[t][nxt:, 0], fwd[t][nxt:, 1])
        p[idx] = np.exp(fwd[t][:, 1] + now[:, 1] - logz[: len(idx)])
        back = now
    loss += (logz * sw).sum() - (e * y * weight).sum() + ridge / 2 * float(theta @ theta)
    return loss, np.concatenate([x.T @ ((p - y) * weight), gt.ravel()]) + ridge * theta


def lbfgs(f, theta: np.ndarray, steps: int = 80, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with backtracking; f gives value and gradient."""
    s_list: list[np.ndarray] = []
    y_list: list[np.ndarray] = []
    value, grad = f(theta)
    for _ in range(steps):
        q, alphas = grad.copy(), []
        for s, y in zip(reversed(s_list), reversed(y_list), strict=True):
            a = (s @ q) / (s @ y)
            alphas.append(a)
            q -= a * y
        q *= (s_list[-1] @ y_list[-1]) / (y_list[-1] @ y_list[-1]) if s_list else 1 / max(1.0, float(np.abs(grad).max()))
        for (s, y), a in zip(zip(s_list, y_list, strict=True), reversed(alphas), strict=True):
            q += s * (a - (y @ q) / (s @ y))
        rate, slope = 1.0, float(grad @ q)
        for _ in range(30):
            v, g = f(theta - rate * q)
            if v <= value - 1e-4 * rate * slope:
                break
            rate /= 2
        else:
            return theta
        s, y = -rate * q, g - grad
        theta = theta + s
        if s @ y > 1e-10:
            s_list, y_list = [*s_list, s][-memory:], [*y_list, y][-memory:]
        done = abs(value - v) < 1e-6 * max(1.0, abs(value))
        value, grad = v, g
        if done:
            break
    return theta


def _fit(seqs: list[np.ndarray], labels: list[np.ndarray], ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Emission and transition weights; sequences weigh the same whatever their length."""
    by = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
    starts = np.cumsum([0, *(len(seqs[i]) for i in by)])
    x = np.concatenate([with_neighbours(seqs[i]) for i in by]).astype(np.float64)
    y = np.concatenate([labels[i] for i in by]).astype(int)
    lens = np.array([len(seqs[i]) for i in by])
    weight = np.repeat(1 / lens, lens)
    order = [starts[: int((lens > t).sum())] + t for t in range(int(lens.max()))]
    theta = lbfgs(lambda th: _objective(th, x, y, weight, order, ridge), np.zeros(3 * WIDTH + 4))
    return theta[:-4], theta[-4:].reshape(2, 2)


def train(docs: DataFrame, labels: DataFrame, sample: int = 4000, max_lines: int = 300, max_bytes: int = 65_536, ridge: float = 0.02) -> QualityModel:
    """Fit on a bounded sample of labelled rows that are not held out.

    sample: at most so many ids of each label, those with the smallest hash; of their documents those of at most
    max_lines lines and max_bytes bytes, and no more than 3 x sample rows should ids repeat. So what reaches the
    driver is bounded. Without rows of both labels the model rates every document alike.
    """
    y = stored(known_labels(labels, "quality"), "labels")
    counts = {r["y"]: r["count"] for r in y.groupBy("y").count().collect()}
    mark = F.xxhash64("__id", F.lit(7))
    chosen = []
    for k, n in counts.items():  # first a share by hash, so that the sort of the ids has few to keep
        share = min(1.0, 1.5 * sample / n + 1000 / n)
        chosen.append(y.where((F.col("y") == k) & (F.pmod(mark, F.lit(1 << 20)) < int(share * (1 << 20)))).orderBy(mark, "__id").limit(sample))
    if len(chosen) < 2:
        return QualityModel()
    ids = F.broadcast(stored(chosen[0].unionAll(chosen[1]), "sample"))  # at most 2 x sample rows
    rows = docs.select("doc_id", "text").where(F.octet_length("text") <= max_bytes).join(ids, F.col("doc_id") == F.col("__id"))
    rows = rows.where(F.size(F.split("text", "\n")) <= max_lines)
    feats = in_batches(rows.select("text", "y"), _features, "y int, x binary, size binary").limit(3 * sample).collect()
    seqs = [np.frombuffer(r["x"], dtype=np.float32).reshape(-1, WIDTH) for r in feats]
    bad = np.array([1 - r["y"] for r in feats])
    model = QualityModel()
    if not len(bad) or bad.min() == bad.max():
        return model
    y = [np.full(len(s), b) for s, b in zip(seqs, bad, strict=True)]
    for again in range(2):
        model.emit, model.trans = _fit(seqs, y, ridge)
        if not again:
            for i, s in enumerate(seqs):
                if bad[i]:
                    p = model.marginals(s)
                    y[i] = (p >= min(0.5, p.max())).astype(int)
    mean = []
    for s, r in zip(seqs, feats, strict=True):
        size = np.frombuffer(r["size"], dtype=np.float64)
        w = size if size.sum() > 0 else np.ones(len(size))
        mean.append(float((model.marginals(s) * w).sum() / w.sum()))
    at = np.array(mean)
    weight = np.ones(len(at))
    model.bias, model.slope = _calibrate(at, 1.0 - bad, weight)
    return model


def _calibrate(badness: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    bias, slope = logistic_1d(1 - badness, good, n, ridge=0.01)
    return bias + slope, slope


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [line_features(t.as_py()) for t in b.column(0)]
        yield pa.RecordBatch.from_arrays([b.column(1), pa.array([x.tobytes() for x, _ in got], pa.binary()), pa.array([s.tobytes() for _, s in got], pa.binary())], names=["y", "x", "size"])


def score(docs: DataFrame, model: QualityModel, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_lines, n_bad_lines) for each row of docs.

    Null and empty texts are one blank line and are scored as such. Rows are neither merged nor dropped; other
    columns of docs are ignored; a null doc_id is not held out.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = ship(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            got = [m.badness(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.probability(x[0]) for x in got], pa.float64()), pa.array([x[1] for x in got], pa.int64()), pa.array([x[2] for x in got], pa.int64())], names=["doc_id", "score", "n_lines", "n_bad_lines"])

    out = in_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double, n_lines long, n_bad_lines long")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_lines", "n_bad_lines")


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = 0.7) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with all their columns."""
    held = ship(docs.sparkSession).sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            good = [m.probability(m.badness(t.as_py())[0]) >= threshold for t in b.column(at)]
            yield b.filter(pa.array(good, pa.bool_()))

    return in_batches(docs, run, docs.schema)
