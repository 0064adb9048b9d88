"""Quality rules with tokeniser fertility.

Base rules count words, symbols, repeated lines and repeated three-word windows. The method's own rules measure
how public vocabularies take a text apart: characters per token under each vocabulary, the share of byte-fallback
tokens and the entropy of the token distribution. Documents of one language and like length (octaves of
tokens) form a group; a document outside its group's band for any measure is rejected. Bands are quartile
fences over all documents that pass the base rules, from histograms of bounded size. A group's histogram is
drawn towards that of all languages, and that one's towards that of all lengths, as by WEIGHT documents more, so
a band changes smoothly with a group's size and every document has one.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import ship, stored, vocabulary_path

MAX_WORDS = 300_000
SYMBOLS = b"#*$%&|<>"
BLANKS = b"\x09\x0a\x0b\x0c\x0d\x20"
MEASURES = ("piece_chars", "byte_chars", "fallback", "entropy")
BINS = 200  # for each unit of a measure
WEIGHT = 100.0


class Fertility:
    """Tokens of single words under a SentencePiece vocabulary with byte fallback and a byte-level one."""

    def __init__(self, piece_path: str, byte_path: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        self.sp = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        with open(byte_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("fertility", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        size = self.sp.get_piece_size()
        self.is_byte = np.array([self.sp.is_byte(i) for i in range(size)])
        self.size = size
        self.known: dict[bytes, tuple[bytes, int]] = {}

    def learn(self, words: set[bytes]) -> None:
        if len(self.known) > MAX_WORDS:
            self.known.clear()
        new = list(words.difference(self.known))
        texts = [w.decode() for w in new]
        for w, ids, t in zip(new, self.sp.encode(texts, num_threads=1), texts, strict=True):
            self.known[w] = (np.array(ids, dtype=np.uint16).tobytes(), len(self.bpe.encode_ordinary(" " + t)))

    def measures(self, words: list[bytes], chars: int) -> tuple[float, float, float, float, int]:
        """Characters per token of both vocabularies, byte-fallback share, entropy in bits; tokens. Zeros without words."""
        if not words:
            return 0.0, 0.0, 0.0, 0.0, 0
        got = list(map(self.known.__getitem__, words))
        ids = np.frombuffer(b"".join([g[0] for g in got]), dtype=np.uint16)
        counts = np.bincount(ids, minlength=self.size)
        n = len(ids)
        p = counts[counts > 0] / n
        return chars / n, chars / max(1, sum([g[1] for g in got])), float(counts[self.is_byte].sum() / n), float(-(p * np.log2(p)).sum()), n


_ready: dict[tuple[str, str], Fertility] = {}


def base_counts(text: str | None) -> tuple[list[bytes], int, int, int, int]:
    """Words; code points in them, symbols, repeated lines with a word, words in repeated three-word windows."""
    raw = (text or "").encode()
    words = raw.split()
    points = len(text or "") - (len(raw) - len(raw.translate(None, BLANKS)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()] if b"\n" in raw else []
    repeated = 0
    if len(words) > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        seen = Counter(windows)
        if len(seen) < len(windows):
            hit = np.fromiter((seen[w] > 1 for w in windows), dtype=bool, count=len(windows))
            cover = np.zeros(len(words), dtype=bool)
            for k in range(3):
                cover[k : len(words) - 2 + k] |= hit
            repeated = int(cover.sum())
    return words, points, symbols, len(lines) - len(set(lines)), repeated


COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, piece_chars double, byte_chars double, fallback double, entropy double, n_tokens long"


def measured(docs: DataFrame, piece: str = "piece_bpe_32k.model", byte: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id, lang ('und' where null), the base counts and the fertility measures of each row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = vocabulary_path(piece), vocabulary_path(byte)
        if paths not in _ready:
            _ready[paths] = Fertility(*paths)
        tool = _ready[paths]
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                base = [base_counts(t) for t in part.column(2).to_pylist()]
                tool.learn(set(chain.from_iterable(x[0] for x in base)))
                rows = [(len(w), c, s, d, r, *tool.measures(w, c)) for w, c, s, d, r in base]
                types = [pa.int64()] * 5 + [pa.float64()] * 4 + [pa.int64()]
                cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], names=["doc_id", "lang", *(x.split()[0] for x in COUNTS.split(", "))])

    ship(docs.sparkSession)
    lang = F.coalesce("lang", F.lit("und")) if "lang" in docs.columns else F.lit("und")
    return docs.select("doc_id", lang.alias("lang"), "text").mapInArrow(run, f"doc_id {kind}, lang string, {COUNTS}")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def bands(rows: DataFrame, fence: float = 3.0, least: float = 0.12, weight: float = WEIGHT) -> DataFrame:
    """(lang, octave, m, low, high): the band of each measure, by its place in MEASURES, for each group of rows.

    Entropy grows with length, so its groups are a language and an octave of tokens; the others' octave is -1. A band
    reaches `fence` interquartile ranges beyond the quartiles and at least `least` of the median beyond it. Measures are
    binned to 1/200, so the histograms are bounded and the bands do not depend on the rows' order.
    """
    values = F.array(*[F.struct(F.lit(k).alias("m"), F.floor(F.col(x) * BINS).cast("long").alias("bin"), (F.col("octave") if x == "entropy" else F.lit(-1)).alias("octave")) for k, x in enumerate(MEASURES)])
    hist = stored(rows.select("lang", F.explode(values).alias("v")).groupBy("lang", "v.octave", "v.m", "v.bin").agg(F.count("*").alias("n")), "histograms")
    share = hist.groupBy("m", "bin").agg(F.sum("n").alias("n"))
    share = share.select("m", "bin", (F.col("n") / F.sum("n").over(Window.partitionBy("m"))).alias("p"))
    for group in (["octave", "m"], ["lang", "octave", "m"]):  # each level's shares are those of the level above, with its own counts
        own = hist.groupBy(*group, "bin").agg(F.sum("n").alias("n"))
        both = own.select(*group).distinct().join(share, [c for c in share.columns if c in group]).join(own, [*group, "bin"], "left")
        n = F.coalesce("n", F.lit(0))
        share = both.select(*group, "bin", ((n + weight * F.col("p")) / (F.sum(n).over(Window.partitionBy(*group)) + weight)).alias("p"))
    upto = share.withColumn("upto", F.sum("p").over(Window.partitionBy(*group).orderBy("bin")))
    quart = upto.groupBy(*group).agg(*[F.min(F.when(F.col("upto") >= q - 1e-9, F.col("bin"))).alias(x) for x, q in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))])
    reach = fence * (F.col("q3") - F.col("q1") + 1)
    low = F.least(F.col("q1") - reach, F.col("q2") * (1 - least)) / BINS
    high = F.greatest(F.col("q3") + 1 + reach, F.col("q2") * (1 + least) + 1) / BINS
    return quart.select("lang", "octave", "m", low.alias("low"), high.alias("high"))


def judged(docs: DataFrame, fence: float = 3.0, least: float = 0.12, weight: float = WEIGHT) -> DataFrame:
    """One row for each row of docs: doc_id, the base counts, base_failed, kept, the measures and `outside`.

    outside names the measures beyond the band of the document's language (and octave of tokens, for entropy); a group
    of which no document passes the base rules has no band. Null and blank texts have no words and so fail the base
    rules. Repeated rows and null ids are kept; a null language is 'und'. An empty table gives no rows.
    """
    rows = stored(measured(docs), "fertility")
    octave = F.floor(F.log2(F.greatest("n_tokens", F.lit(1)))).cast("int")
    rows = rows.withColumn("octave", octave).withColumn("base_failed", base_failed())
    known = stored(bands(rows.where("not base_failed"), fence, least, weight), "bands")
    band = F.struct("low", "high")
    general = known.where("octave = -1").groupBy("lang").agg(*[F.max(F.when(F.col("m") == k, band)).alias(f"b_{x}") for k, x in enumerate(MEASURES) if x != "entropy"])
    entropy = known.where("octave >= 0").select("lang", "octave", band.alias("b_entropy"))
    got = rows.join(general, "lang", "left").join(entropy, ["lang", "octave"], "left")
    off = [F.when((F.col(x) < F.col(f"b_{x}.low")) | (F.col(x) > F.col(f"b_{x}.high")), F.lit(x)) for x in MEASURES]
    got = got.withColumn("outside", F.array_compact(F.array(*off)))
    kept = ~F.col("base_failed") & (F.size("outside") == 0)
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), *MEASURES, "n_tokens", "outside")
