"""Token ids as length-delimited binary records, with an index for shuffled reads.

A file is a run of frames in ascending doc_id order. A frame is: length of the payload (8 bytes),
masked checksum of these 8 bytes (4), payload, masked checksum of the payload (4), line feed. The
payload is: doc_id (8), 1 if the id is null else 0 (1), bytes per token id, 2 or 4 (1), token ids.
All numbers are little-endian. The mask rotates the crc32 right by 15 bits and adds 0xA282EAD8,
so a checksum stored next to its data is never a checksum of itself.

The files are written by Spark's text writer, whose line separator ends each frame; so any store
that Spark can write will do, and a task lost half-way leaves nothing behind. The index (part,
split, offset, length, doc_id, n_tokens, before) is built by reading the files back, which also
verifies every checksum; a wrong one is an error.

Null and empty texts give the end id alone. Null ids come first. Rows that share an id follow each
other, by text. An empty table gives no rows. Extra columns do not matter. Words are encoded once
per worker and remembered up to a bound: the tokenizer drops white space and never joins across it.
A word of letters, with or without closing punctuation, is split as the tokenizer splits it and given
to the library's BPE model; every other word takes the library's whole path.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import uuid
import zlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import application_folder
from .common import in_arrow, in_parts, remembered

END_ID, RECORDS_PER_FILE = 2, 4096
REMEMBERED, AT_ONCE = 690_000, 2048
VOCABULARY = "word_bpe_49k.json"


def masked(data: bytes) -> int:
    value = zlib.crc32(data)
    return (((value >> 15) | (value << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def tokenizer(vocabulary: str):
    """Tokenizer of a public vocabulary name or of a file path, one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if not os.path.isabs(vocabulary):
        import public_tokenizers

        vocabulary = public_tokenizers.path(vocabulary)
    return Tokenizer.from_file(vocabulary)


#: Bytes as the printable characters that a byte-level vocabulary uses: printable ones as they are, the others from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_CHARACTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(_PRINTED))}
_CLOSING = ".,;:!?"


def encoder(vocabulary: str) -> WordEncoder:
    """The worker's encoder; it outlives a task, so that words are not encoded again by each."""
    return remembered(f"encoder {vocabulary}", lambda: WordEncoder(vocabulary))


class WordEncoder:
    """Token ids of texts, through a bounded memory of encoded words."""

    def __init__(self, vocabulary: str):
        self.tokenizer = tokenizer(vocabulary)
        self.model = self.tokenizer.model
        self.closing: dict[str, list[int]] = {"": []}
        # only for a tokenizer whose split of plain words this class knows: letters, then punctuation
        probe = [piece for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str("word.")] if self.tokenizer.pre_tokenizer else []
        self.plain = probe == ["word", "."] and self.tokenizer.normalizer is not None and (
            self.tokenizer.normalizer.normalize_str("Wo\n rd") == "wo rd")
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.starts, self.sizes = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.used = np.empty(0, bool)

    def _keep_used(self) -> None:
        """Forget the words that no later texts held since the last time; all words where that frees little."""
        kept = np.flatnonzero(self.used)
        if 4 * len(kept) > 3 * REMEMBERED:
            self.forget()
            return
        words = list(self.place)
        self.place = {words[i]: place for place, i in enumerate(kept.tolist())}
        self.ids, self.sizes = self._known(kept), self.sizes[kept]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.used = np.zeros(len(kept), bool)

    def _whole(self, words: list[str]) -> list[list[int]]:
        # the library's results take about a kilobyte a word
        parts = (words[start:start + AT_ONCE] for start in range(0, len(words), AT_ONCE))
        return [e.ids for part in parts for e in self.tokenizer.encode_batch(part, add_special_tokens=False)]

    def _word(self, word: str) -> list[int] | None:
        """Ids of a word of letters and closing punctuation, None for others."""
        body = word.rstrip(_CLOSING)
        if not body.isalpha():
            return None
        small = body.lower()
        if not small.isascii() or not body.isascii():
            if "\u03a3" in body or not small.isalpha() or not unicodedata.is_normalized("NFC", body):
                return None
            small = small.encode().decode("latin-1").translate(_CHARACTERS)
        # letters of ASCII stand for themselves in the vocabulary
        ids = [t.id for t in self.model.tokenize(small)]
        if len(body) == len(word):
            return ids
        tail = word[len(body):]
        if tail not in self.closing:
            if len(self.closing) > 10_000:
                self.closing = {"": []}
            self.closing[tail] = self._whole([tail])[0]
        return ids + self.closing[tail]

    def _learn(self, fresh: list[str]) -> None:
        """Remember distinct words that are not known yet."""
        plain, rest, sizes, flat = [], [], [], []
        for word in fresh:
            ids = self._word(word) if self.plain else None
            if ids is None:
                rest.append(word)
            else:
                plain.append(word)
                sizes.append(len(ids))
                flat += ids
        for ids in self._whole(rest):
            sizes.append(len(ids))
            flat += ids
        self.place.update(zip(chain(plain, rest), range(len(self.place), len(self.place) + len(fresh)), strict=True))
        sizes, flat = np.array(sizes, np.int64), np.array(flat, np.uint32)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, flat])
        self.used = np.concatenate([self.used, np.zeros(len(fresh), bool)])

    def _places(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[str], list[str]]:
        """Place of each word (-1: unknown), which are unknown, these words and the distinct ones of them."""
        at = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(at < 0)
        missing = [words[i] for i in unknown.tolist()]
        return at, unknown, missing, list(dict.fromkeys(missing))

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; words are looked up and learned for many texts at once."""
        split = [t.replace("\n", " ").split(" ") if t else [] for t in texts]
        words = list(chain.from_iterable(split))
        at, unknown, missing, fresh = self._places(words)
        self.used[at[at >= 0]] = True
        if fresh:
            if len(self.place) + len(fresh) > REMEMBERED:
                self._keep_used()
                at, unknown, missing, fresh = self._places(words)
            self._learn(fresh)
            at[unknown] = np.fromiter(map(self.place.__getitem__, missing), np.int64, len(missing))
        ends = np.cumsum([len(x) for x in split])
        return [self._known(at[end - len(x):end]) for x, end in zip(split, ends, strict=True)]

    def _known(self, at: np.ndarray) -> np.ndarray:
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.starts[at] - ends + sizes, sizes) + np.arange(total)]


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    payload = struct.pack("<qBB", doc_id or 0, doc_id is None, width) + ids.astype(f"<u{width}").tobytes()
    length = struct.pack("<Q", len(payload))
    return b"".join([length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))])


def parsed(data) -> list[tuple[int, int, int | None, np.ndarray]]:
    """(offset, length, doc_id, ids) of each frame; a damaged frame raises."""
    data, at, out = memoryview(data), 0, []
    while at < len(data):
        (size,), (check,) = struct.unpack_from("<Q", data, at), struct.unpack_from("<I", data, at + 8)
        payload = data[at + 12:at + 12 + size]
        if masked(data[at:at + 8]) != check or struct.unpack_from("<I", data, at + 12 + size)[0] != masked(payload):
            raise ValueError(f"damaged record at byte {at}")
        doc_id, null, width = struct.unpack_from("<qBB", payload)
        out.append((at, size + 17, None if null else doc_id, np.frombuffer(payload[10:], f"<u{width}")))
        at += size + 17
    return out


def write_records(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end_id: int = END_ID,
                  records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write the frames of all documents below ``folder``/data."""

    def run(batches):
        words = encoder(vocabulary)
        for batch in in_parts(batches):
            ids = words.encode_all(batch.column(1).to_pylist())
            frames = [frame(i, np.append(x, np.uint32(end_id))) for i, x in zip(batch.column(0).to_pylist(), ids, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["frame"])

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(
        F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    in_arrow(ordered, run, "frame binary", keeps=f"encoder {vocabulary}").select(F.col("frame").cast("string")).write.option(
        "lineSep", "\n").option("maxRecordsPerFile", records_per_file).text(f"{folder}/data")


def index_records(spark: SparkSession, folder: str) -> DataFrame:
    """Read the files back: a row per frame with its place and, beside it, the crc32 of its ids."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = parsed(content.as_buffer())
                sizes = np.array([len(r[3]) for r in rows], np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array([name] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()),
                    pa.array(sizes), pa.array(np.cumsum(sizes) - sizes),
                    pa.array([zlib.crc32(r[3].astype("<u4").tobytes()) for r in rows], pa.int64()),
                ], ["file", "offset", "length", "doc_id", "n_tokens", "before", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/data")
    rows = in_arrow(files.select("path", "content"), run,
                    "file string, offset long, length long, doc_id long, n_tokens long, before long, ids_crc32 long")
    name = F.regexp_extract("file", r"part-(\d+)-[^/]*-c(\d+)[^/]*$", 1), F.regexp_extract("file", r"part-(\d+)-[^/]*-c(\d+)[^/]*$", 2)
    rows = rows.withColumns({"part": name[0].cast("long"), "split": name[1].cast("long")})
    rows.write.parquet(f"{folder}/index")
    return spark.read.schema(rows.schema).parquet(f"{folder}/index")


def with_starts(index: DataFrame) -> DataFrame:
    """Add ``start``, the ids of all documents before. Only one row per file meets in a window."""
    files = index.groupBy("part", "split").agg(F.sum("n_tokens").alias("_tokens"))
    earlier = Window.orderBy("part", "split").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("part", "split", F.coalesce(F.sum("_tokens").over(earlier), F.lit(0)).alias("_start"))
    return index.join(files, ["part", "split"]).withColumn("start", F.col("_start") + F.col("before")).drop("_start")


def read_records(spark: SparkSession, wanted: DataFrame) -> DataFrame:
    """doc_id and ids of the index rows in ``wanted``, in any order: each file is opened once, frames cut by offset."""

    def run(batches):
        for batch in batches:
            for content, places in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                data = memoryview(content.as_buffer())
                got = [parsed(data[p["offset"]:p["offset"] + p["length"]])[0] for p in places]
                yield pa.RecordBatch.from_arrays([
                    pa.array([g[2] for g in got], pa.int64()),
                    pa.array([g[3].tolist() for g in got], pa.list_(pa.int64()))], ["doc_id", "ids"])

    places = wanted.groupBy("file").agg(F.collect_list(F.struct("offset", "length")).alias("places"))
    folders = [r.folder for r in wanted.select(F.regexp_extract("file", r"^(.*)/[^/]*$", 1).alias("folder")).distinct().collect()]
    if not folders:
        return spark.createDataFrame([], "doc_id long, ids array<long>")
    files = spark.read.format("binaryFile").load(folders).select(F.col("path").alias("file"), "content")
    return in_arrow(files.join(places, "file").select("content", "places"), run, "doc_id long, ids array<long>")


def token_records(docs: DataFrame, folder: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """Write ``docs`` and read them back: doc_id, start, n_tokens, ids_crc32 and the place of each record."""
    spark = docs.sparkSession
    folder = folder or f"{application_folder(spark)}/records-{uuid.uuid4().hex}"
    write_records(docs, folder, vocabulary)
    return with_starts(index_records(spark, folder)).select(
        "doc_id", "start", "n_tokens", "ids_crc32", "part", "split", "offset", "length")
