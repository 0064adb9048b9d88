"""Token ids in wavelet matrix files.

The rows are put in ascending doc_id order by a range shuffle and encoded in that order; runs of whole documents
make shards of about `shard_tokens` ids. A shard's file holds, in one compressed blob, the documents' ids and
lengths and a wavelet matrix: one bit plane for each bit of an id, high to low, each plane's zeros kept before
its ones. With the planes' rank counts it gives access to any token, counts a token in any prefix and finds
its k-th occurrence without decoding the rest. Spark's own writer stores the blobs in the shared folder, so any
file system serves, a task that is run again replaces its own output, and no executor keeps a file.

File: magic b"WMX1", then little-endian uint32 header length, a JSON header (bits, tokens, docs, sizes of the
blocks), and zstd blocks: doc ids as int64 with a null bitmap, lengths as int64, then the planes as packed bits.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import in_batches, scratch, ship, vocabulary_path

MAGIC = b"WMX1"
MAX_WORDS = 1_200_000
RUN_BYTES = 8 << 20
END_ID = 1


class WaveletMatrix:
    """Access, rank, count and select over unsigned integers below 2**bits."""

    def __init__(self, planes: list[np.ndarray], n: int):
        self.planes, self.n, self.bits = planes, n, len(planes)
        self._ranks: list[np.ndarray] | None = None
        self._zeros: list[int] | None = None

    @classmethod
    def build(cls, values: np.ndarray, bits: int) -> WaveletMatrix:
        planes, cur = [], values
        for b in range(bits - 1, -1, -1):
            bit = ((cur >> b) & 1).astype(bool)
            planes.append(np.packbits(bit))
            cur = np.concatenate([np.compress(~bit, cur), np.compress(bit, cur)])
        return cls(planes, len(values))

    def plane(self, level: int) -> np.ndarray:
        return np.unpackbits(self.planes[level], count=self.n).view(bool)

    def decode(self) -> np.ndarray:
        """All values in order."""
        if self.n == 0:
            return np.zeros(0, dtype=np.uint32)
        dtype = np.uint16 if self.bits <= 16 else np.uint32
        out = np.zeros(self.n, dtype=dtype)  # in the order of the level reached from below
        for level in range(self.bits - 1, -1, -1):
            bit = self.plane(level)
            one, zero = np.flatnonzero(bit), np.flatnonzero(~bit)
            up = np.empty(self.n, dtype=dtype)
            up[zero], up[one] = out[: len(zero)], out[len(zero) :] | dtype(1 << (self.bits - 1 - level))
            out = up
        return out

    def _ready(self) -> tuple[list[np.ndarray], list[int]]:
        """Ones before each byte of each plane, and each plane's zeros."""
        if self._ranks is None or self._zeros is None:
            pop = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1).astype(np.int64)
            self._ranks = [np.concatenate([[0], np.cumsum(pop[p])]) for p in self.planes]
            self._zeros = [self.n - int(r[-1]) for r in self._ranks]
        return self._ranks, self._zeros

    def _ones(self, level: int, i: int) -> int:
        ranks, _ = self._ready()
        byte, rest = divmod(i, 8)
        return int(ranks[level][byte]) + ((int(self.planes[level][byte]) >> (8 - rest)).bit_count() if rest else 0)

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (7 - (i & 7)) & 1

    def access(self, i: int) -> int:
        _, zeros = self._ready()
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            bit, ones = self._bit(level, i), self._ones(level, i)
            value = value << 1 | bit
            i = zeros[level] + ones if bit else i - ones
        return value

    def rank(self, value: int, i: int) -> int:
        """How often value occurs before place i."""
        start, end = self._range(value, i)
        return end - start

    def _range(self, value: int, i: int) -> tuple[int, int]:
        _, zeros = self._ready()
        if value >> self.bits:
            return 0, 0
        start, end = 0, i
        for level in range(self.bits):
            s, e = self._ones(level, start), self._ones(level, end)
            start, end = (zeros[level] + s, zeros[level] + e) if value >> (self.bits - 1 - level) & 1 else (start - s, end - e)
        return start, end

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, k: int) -> int:
        """Place of the k-th occurrence (from 0) of value; IndexError if there is none."""
        ranks, zeros = self._ready()
        start, end = self._range(value, self.n)
        if not 0 <= k < end - start:
            raise IndexError(k)
        i = start + k
        for level in range(self.bits - 1, -1, -1):
            one = value >> (self.bits - 1 - level) & 1
            i = self._nth(level, one, i - zeros[level] if one else i)
        return i

    def _nth(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) such bit in a plane."""
        ranks, _ = self._ready()
        before = ranks[level] if bit else 8 * np.arange(len(ranks[level])) - ranks[level]
        byte = int(np.searchsorted(before, k, side="right")) - 1
        left = k - int(before[byte])
        value = int(self.planes[level][byte])
        for j in range(8):
            if (value >> (7 - j) & 1) == bit:
                if left == 0:
                    return 8 * byte + j
                left -= 1
        raise IndexError(k)


def pack(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, bits: int) -> bytes:
    """A shard's file."""
    import zstandard

    press = zstandard.ZstdCompressor(level=1).compress
    known = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    blocks = [known.tobytes(), np.packbits([d is None for d in doc_ids]).tobytes(), np.array(lengths, dtype="<i8").tobytes(), *(p.tobytes() for p in WaveletMatrix.build(ids, bits).planes)]
    packed = [press(b) for b in blocks]
    head = json.dumps({"bits": bits, "tokens": len(ids), "docs": len(doc_ids), "blocks": [len(p) for p in packed]}).encode()
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, *packed])


def unpack(blob: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """Document ids, their lengths and the wavelet matrix of a shard's file."""
    import zstandard

    if blob[:4] != MAGIC:
        raise ValueError("not a wavelet matrix file")
    size = int.from_bytes(blob[4:8], "little")
    head = json.loads(blob[8 : 8 + size])
    at, blocks, decompress = 8 + size, [], zstandard.ZstdDecompressor().decompress
    for n in head["blocks"]:
        blocks.append(decompress(blob[at : at + n]) if n else b"")
        at += n
    ids, null = np.frombuffer(blocks[0], dtype="<i8"), np.unpackbits(np.frombuffer(blocks[1], dtype=np.uint8), count=head["docs"])
    docs = [None if x else int(d) for d, x in zip(ids, null, strict=True)]
    return docs, np.frombuffer(blocks[2], dtype="<i8"), WaveletMatrix([np.frombuffer(b, dtype=np.uint8) for b in blocks[3:]], head["tokens"])


# The public tokenizer's pre-tokeniser over text in Latin-1, lower-cased: its letters (a-z and the
# letters from U+00AA up), its numbers (digits, superscripts, fractions) and its white space, spelled out.
_LETTER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_BLANK = "\x09-\x0d\x20\x85\xa0"
_PIECES = re.compile(f"[{_LETTER}]+|[{_NUMBER}]|'s|'t|'re|'ve|'m|'ll|'d|[^{_BLANK}{_LETTER}{_NUMBER}]+")


def _byte_alphabet() -> dict[int, int]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or one from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: b if b in own else 256 + rest.index(b) for b in range(256)}


_FULL_STOP = f"([{_LETTER}{_NUMBER}])([.,]) "
_BLANKS = re.compile(f"[{_BLANK}]")
_END = "\u2400"  # stands behind each text for its end id; no Latin-1 text holds it


class Words(dict):
    """Ids of each word between blanks, as bytes; a new word's are those of its pre-tokens in turn."""

    def __init__(self, piece):
        self.piece = piece

    def __missing__(self, word: str) -> bytes:
        got = self[word] = self.piece(word) if word.isalpha() else b"".join(map(self.piece, _PIECES.findall(word)))
        return got


class Encoder:
    """The tokenizers library's ids, kept for each word.

    The normaliser folds white space and case and the pre-tokeniser cuts a text into pre-tokens, none with a blank in
    it, that the library's BPE model encodes one by one; so a text's ids are those of its words in turn. Latin-1
    texts are cut here, a full stop or comma behind a word apart from it: the words of many texts are numbered at once,
    the pre-tokens of each new word go to the model, and the words' ids are gathered by number. Any other text, and any
    that holds a special token's string, goes through the whole library. A tokenizer that does not work so is refused.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.bits = max(1, (self.tok.get_vocab_size(with_added_tokens=True) - 1).bit_length())
        self.dtype = np.dtype("<u2") if self.bits <= 16 else np.dtype("<u4")
        self.code = "H" if self.bits <= 16 else "I"
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.bytes = _byte_alphabet()
        self.known = Words(self._piece)
        probes = ["One  two,\nthree...it's 12\x85\xb2 \x1c{x}. 3.", "caf\xe9. \xc9T\xc9's \xa0\xfcber\xb5m\xad,", "\x00a'll_b"]
        for probe, ids in zip(probes, self.encode(probes), strict=True):
            if ids[:-1].tolist() != self.tok.encode(probe, add_special_tokens=False).ids:
                raise ValueError("this tokenizer's pre-tokens are not as expected")

    def _piece(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() and piece.isalpha() else piece.encode().decode("latin-1").translate(self.bytes)
        return array(self.code, [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _blanked(self, text: str) -> str:
        """A Latin-1 text in lower case, its white space as blanks, and the end mark."""
        blank = text.lower().replace("\n", " ")
        return (blank if blank.isprintable() else _BLANKS.sub(" ", blank)) + " " + _END

    def _latin(self, texts: list[str], end: int) -> list[np.ndarray]:
        cut = pc.split_pattern(pc.replace_substring_regex(pa.array([self._blanked(t) for t in texts], pa.large_string()), _FULL_STOP, r"\1 \2 "), " ")
        words = pc.dictionary_encode(cut.flatten())
        if len(self.known) > MAX_WORDS:
            self.known.clear()
        self.known[_END] = array(self.code, [end]).tobytes()
        ids = pa.array(list(map(self.known.__getitem__, words.dictionary.to_numpy(zero_copy_only=False).tolist())), pa.large_binary()).take(words.indices)
        _, offsets, data = ids.buffers()
        at = np.frombuffer(offsets, dtype=np.int64)[ids.offset : ids.offset + len(ids) + 1]
        bounds = at[cut.offsets.to_numpy() - cut.offsets[0].as_py()] // self.dtype.itemsize
        flat = np.frombuffer(data, dtype=self.dtype)
        return [flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def _is_latin(self, text: str) -> bool:
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return False
        return not any(x in text for x in self.special)

    def encode(self, texts: list[str | None], end: int = END_ID) -> list[np.ndarray]:
        """Ids of each text and the end id; a null text is empty."""
        texts = [t or "" for t in texts]
        latin = [self._is_latin(t) for t in texts]
        cut = iter(self._latin([t for t, x in zip(texts, latin, strict=True) if x], end) if any(latin) else [])
        return [next(cut) if x else np.array([*self.tok.encode(t, add_special_tokens=False).ids, end], dtype=self.dtype) for t, x in zip(texts, latin, strict=True)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _runs(batch: pa.RecordBatch, text: int = 1) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about RUN_BYTES of text, so that what is numbered at once is bounded."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy().astype(np.int64)
    run = (np.cumsum(sizes) - sizes) // RUN_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


FILES = "part int, shard int, docs long, tokens long, file binary"


def write_shards(docs: DataFrame, path: str, vocabulary: str = "word_bpe_49k.json", shard_tokens: int = 1 << 18, end: int = END_ID) -> None:
    """Write the ids of all texts of docs, each with the end id behind it, in ascending doc_id order.

    Rows with a null doc_id come first; rows of one id are ordered by their text, nulls first, so repeated rows
    are kept side by side. A null text is empty. A document is never split over shards, so a shard may be
    larger than shard_tokens. Other columns are ignored. An empty table gives no file.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, docs.rdd.getNumPartitions())  # as many as the scan has
    order = [F.asc_nulls_first("doc_id"), F.asc_nulls_first("text")]
    rows = rows.repartitionByRange(parts, F.asc_nulls_first("doc_id"), F.xxhash64("text").asc()).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(vocabulary_path(vocabulary))
        part, shard = TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        arrays: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            blob = pack(names, [len(a) for a in arrays], np.concatenate(arrays), enc.bits)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(names)], pa.int64()), pa.array([size], pa.int64()), pa.array([blob], pa.binary())], names=["part", "shard", "docs", "tokens", "file"])

        for b in batches:
            for piece in _runs(b):
                for name, ids in zip(piece.column(0).to_pylist(), enc.encode(piece.column(1).to_pylist(), end), strict=True):
                    names.append(name)
                    arrays.append(ids)
                    size += len(ids)
                    if size >= shard_tokens:
                        yield flush()
                        shard, size, names, arrays = shard + 1, 0, [], []
        if names:
            yield flush()

    ship(docs.sparkSession)
    in_batches(rows, run, FILES).write.mode("overwrite").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files: start is the number of ids before the document's.

    Places come from the shards' counts in two steps, within each part of the range shuffle and over the
    parts, so no step holds more rows than a part has shards or the job has parts.
    """
    ship(spark)
    files = spark.read.schema(FILES).parquet(path)
    sizes = files.select("part", "shard", "tokens")
    parts = sizes.groupBy("part").agg(F.sum("tokens").alias("n")).collect()  # a row for each part of the shuffle
    base, total = {}, 0
    for r in sorted(parts):
        base[r["part"]] = total
        total += r["n"]
    known = spark.sparkContext.broadcast(base)
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    places = sizes.select("part", "shard", F.coalesce(F.sum("tokens").over(within), F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, before, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                docs, lengths, matrix = unpack(blob.as_py())
                ids = matrix.decode().astype("<u4")
                ends = np.cumsum(lengths)
                starts = ends - lengths
                crc = [zlib.crc32(ids[s:e].data) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(known.value[part] + before + starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = files.join(places, ["part", "shard"]).select("part", "before", "file")
    return in_batches(rows, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", shard_tokens: int = 1 << 18, path: str | None = None) -> DataFrame:
    """Write docs as wavelet matrix files and read them back; see write_shards and read_shards."""
    path = path or scratch(docs.sparkSession, "token-files")
    write_shards(docs, path, vocabulary, shard_tokens)
    return read_shards(docs.sparkSession, path)
