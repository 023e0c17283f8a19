"""Fixed-width bit packing of token ids (operator 11): files of ids in the minimum vocabulary bits, with block offsets.

Texts are sorted over the cluster by doc_id, encoded by the ``tokenizers`` library in whole, and each task streams its
share of the ids into files. An id takes the least bits that hold the vocabulary's largest id, so eight ids take as many
bytes as an id has bits: both packing and unpacking are a few shifts of numpy columns, one for each of the eight places.

File, little-endian: magic ``SLBP``, version, bits, ids a block (uint32 each); the packed blocks, each padded to whole
groups of eight ids; then the footer: document ids (int64, and a byte for each that is null), ends of the documents in
ids (int64), byte offsets of the blocks (int64); last the counts of documents, ids and blocks and the footer's offset
(int64 each). ``TokenFile`` reads any range of ids or any document by seeking to the blocks that hold it.

Tasks write under names of their own in the shared folder and report them as rows of the file table; only files of
reported attempts are ever read. The ids before a file are a sum over the table of files, one row each.

Defined results: a null or empty text is the end id alone; a null doc_id comes first and is read back as null; rows of
one doc_id are documents each, ordered by a hash of their text (equal texts are interchangeable). An empty table gives no
file and no row. Very long texts are encoded in whole. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import SLICE_BYTES, Scratch, slices, text_buffer
from strandline.llm.packing import SPECIAL, SPECIAL_ID, Encoder
from strandline.llm.warc import _open

MAGIC = b"SLBP"
VERSION = 1
BLOCK_IDS = 4096
END_ID = 2
_GROUP = 8

# ------------------------------------------------------------------ bits


def bits_for(largest: int) -> int:
    """The least bits that hold ids from 0 to ``largest``."""
    return max(1, int(largest).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids, padded with zeros to whole groups of eight, as ``bits`` bytes a group; low bits come first."""
    lanes = np.zeros((-(-len(ids) // _GROUP), _GROUP), np.uint64)
    lanes.ravel()[: len(ids)] = ids
    out = np.zeros((len(lanes), bits), np.uint8)
    for lane in range(_GROUP):
        first, shift = divmod(lane * bits, 8)
        value = lanes[:, lane] << np.uint64(shift)
        for k in range(-(-(shift + bits) // 8)):
            out[:, first + k] |= (value >> np.uint64(8 * k)).astype(np.uint8)
    return out.tobytes()


def unpack_bits(raw: bytes, count: int, bits: int) -> np.ndarray:
    """The first ``count`` ids of packed groups."""
    groups = -(-count // _GROUP)
    packed = np.frombuffer(raw, np.uint8, groups * bits).reshape(groups, bits).astype(np.uint64)
    lanes, mask = np.zeros((groups, _GROUP), np.uint32), np.uint64((1 << bits) - 1)
    for lane in range(_GROUP):
        first, shift = divmod(lane * bits, 8)
        value = np.zeros(groups, np.uint64)
        for k in range(-(-(shift + bits) // 8)):
            value |= packed[:, first + k] << np.uint64(8 * k)
        lanes[:, lane] = (value >> np.uint64(shift)) & mask
    return lanes.ravel()[:count]


# ------------------------------------------------------------------ files


class TokenWriter:
    """Streams documents into one file: a block's ids and the index of documents are all that it holds."""

    def __init__(self, sink, bits: int, block: int = BLOCK_IDS):
        if block % _GROUP:
            raise ValueError(f"a block is a multiple of {_GROUP} ids")
        self.sink, self.bits, self.block = sink, bits, block
        self.rest, self.at, self.total = np.zeros(0, np.uint32), 0, 0
        self.docs: list[int | None] = []
        self.ends: list[int] = []
        self.offsets: list[int] = []
        self._put(MAGIC + np.array([VERSION, bits, block], "<u4").tobytes())

    def _put(self, raw: bytes) -> None:
        self.sink.write(raw)
        self.at += len(raw)

    def add(self, doc_ids: list[int | None], ends: np.ndarray, ids: np.ndarray) -> None:
        """Documents whose ids end at ``ends`` in ``ids``."""
        self.docs += doc_ids
        self.ends += (ends + self.total).tolist()
        self.total += len(ids)
        self.rest = np.concatenate([self.rest, ids])
        full = len(self.rest) // self.block * self.block
        for lo in range(0, full, self.block):
            self._block(self.rest[lo : lo + self.block])
        self.rest = self.rest[full:]

    def _block(self, ids: np.ndarray) -> None:
        self.offsets.append(self.at)
        self._put(pack_bits(ids, self.bits))

    def close(self) -> None:
        if len(self.rest):
            self._block(self.rest)
        footer = self.at
        self._put(np.array([d or 0 for d in self.docs], "<i8").tobytes() + bytes(d is None for d in self.docs))
        self._put(np.array(self.ends, "<i8").tobytes() + np.array(self.offsets, "<i8").tobytes())
        self._put(np.array([len(self.docs), self.total, len(self.offsets), footer], "<i8").tobytes())
        self.sink.close()


class TokenFile:
    """Random access to a file of packed ids, given an open seekable source."""

    def __init__(self, source):
        self.source = source
        head = self._read(0, 16)
        version, self.bits, self.block = np.frombuffer(head, "<u4", offset=4).tolist()
        if head[:4] != MAGIC or version != VERSION:
            raise ValueError("not a file of packed token ids")
        size = source.seek(0, 2) or source.tell()
        n, self.total, blocks, footer = np.frombuffer(self._read(size - 32, 32), "<i8").tolist()
        raw = self._read(footer, size - 32 - footer)
        null = np.frombuffer(raw, np.uint8, n, 8 * n)
        self.doc_ids = [None if gone else d for d, gone in zip(np.frombuffer(raw, "<i8", n).tolist(), null.tolist(), strict=True)]
        self.ends = np.frombuffer(raw, "<i8", n, 9 * n)
        self.offsets = np.append(np.frombuffer(raw, "<i8", blocks, 17 * n), footer)

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo..hi of the file, out of the blocks that hold them."""
        lo, hi = max(0, lo), min(hi, self.total)
        if lo >= hi:
            return np.zeros(0, np.uint32)
        a, b = lo // self.block, (hi - 1) // self.block + 1
        raw = self._read(int(self.offsets[a]), int(self.offsets[b] - self.offsets[a]))
        return unpack_bits(raw, min(self.total, b * self.block) - a * self.block, self.bits)[lo - a * self.block : hi - a * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))

    def documents(self, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first document, last, their ids) in runs of whole documents of about ``most`` ids; a longer one is alone."""
        lo, n = 0, len(self.ends)
        while lo < n:
            start = int(self.ends[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(self.ends, start + most, "right")))
            yield lo, hi, self.ids(start, int(self.ends[hi - 1]))
            lo = hi


# ------------------------------------------------------------------ ids


class _Library:
    """The tokenizers library behind the two calls that ``Encoder`` makes for segments it has not met."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def encode_ordinary(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode_to_numpy(self, text: str, **_) -> np.ndarray:
        return np.array(self.encode_ordinary(text), np.uint32)


class LibraryEncoder(Encoder):
    """``Encoder`` over a tokenizer file of byte-level pieces, whose new segments go to the tokenizers library."""

    def __init__(self, tokenizer, keep: int = 400_000):
        self.bpe, self.keep = _Library(tokenizer), keep
        vocabulary = tokenizer.get_vocab()
        self.blank_first = np.zeros(max(vocabulary.values()) + 1, bool)
        self.blank_first[[i for piece, i in vocabulary.items() if piece.startswith("Ġ")]] = True
        self._forget()


class PlainEncoder:
    """Any other tokenizer file: every text goes to the library as it is."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def encode(self, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        view = data[offsets[lo] : offsets[hi]].tobytes()
        cuts = (offsets[lo : hi + 1] - offsets[lo]).tolist()
        got = [np.array(self.tokenizer.encode(view[a:b].decode(), add_special_tokens=False).ids, np.uint32) for a, b in zip(cuts, cuts[1:], strict=False)]
        return np.concatenate(got), np.cumsum([0, *map(len, got)])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _splits_at_blanks(config: dict) -> bool:
    """Whether a piece always begins at a blank before a non-blank, so that ids of a text are those of its segments."""
    pre = config.get("pre_tokenizer") or {}
    plain = config.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    return bool(plain) and [(t["content"], t["id"]) for t in config.get("added_tokens", [])] == [(SPECIAL, SPECIAL_ID)]


_encoders: dict[str, tuple[Encoder | PlainEncoder, int]] = {}


def encoder_of(path: str) -> tuple[Encoder | PlainEncoder, int]:
    """The encoder of a tokenizer file and the bits of its ids; kept by the worker."""
    if path not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            config = f.read()
        tokenizer = Tokenizer.from_str(config)
        kind = LibraryEncoder if _splits_at_blanks(json.loads(config)) else PlainEncoder
        _encoders[path] = kind(tokenizer), bits_for(max(tokenizer.get_vocab(with_added_tokens=True).values()))
    return _encoders[path]


def _with_end(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after each text, and the new ends of the texts."""
    return np.insert(ids, ends[1:], np.uint32(end_id)), ends[1:] + np.arange(1, len(ends))


# ------------------------------------------------------------------ Spark jobs

_FILES = pa.schema([("part", pa.int32()), ("nth", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def write_token_files(docs: DataFrame, folder: str, *, tokenizer: str | None = None, end_id: int = END_ID, block: int = BLOCK_IDS, file_ids: int = 1 << 25) -> DataFrame:
    """Write the ids of all texts under ``folder``; the lazy result, to be settled before use, has a row a file.

    Files hold documents in ascending order; their rows, sorted by (part, nth), follow each other. A file is closed when
    it has ``file_ids`` ids, which bounds the index of documents that a task holds.
    """
    path = tokenizer or default_tokenizer()

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc, bits = encoder_of(path)
        where, inside = _open(folder)
        where.create_dir(inside, recursive=True)
        writer, name, done = None, "", []

        def close():
            nonlocal writer
            if writer is not None:
                writer.close()
                done.append({"part": part, "nth": len(done), "path": f"{folder}/{name}", "n_docs": len(writer.docs), "n_ids": writer.total})
                writer = None

        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            data, offsets = text_buffer(batch.column(1))
            for lo, hi in slices(offsets, SLICE_BYTES):
                if writer is None:
                    name = f"ids-{uuid.uuid4().hex}.slbp"
                    writer = TokenWriter(where.open_output_stream(f"{inside}/{name}", compression=None), bits, block)
                ids, ends = enc.encode(data, offsets, lo, hi)
                flat, cuts = _with_end(ids, ends, end_id)
                writer.add(ids_of[lo:hi], cuts, flat)
                if writer.total >= file_ids:
                    close()
        close()
        yield pa.RecordBatch.from_pylist(done, schema=_FILES)

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("nth"))
    order = [F.col("doc_id").asc_nulls_first(), "tie", "nth"]  # the last deals out rows that repeat
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(run, "part int, nth int, path string, n_docs long, n_ids long")


def with_starts(files: DataFrame) -> DataFrame:
    """The table of files with the ids before each: a running sum over one row a file."""
    w = Window.orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(w), F.lit(0)))


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in files (path, start)."""

    def run(batches):
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                where, inside = _open(path)
                with where.open_input_file(inside) as source:
                    file = TokenFile(source)
                    for lo, hi, ids in file.documents():
                        ends = file.ends[lo:hi]
                        begins = np.concatenate([[int(file.ends[lo - 1]) if lo else 0], ends[:-1]])
                        raw = memoryview(ids.astype("<u4", copy=False).tobytes())
                        cuts = ((begins - begins[0]) * 4).tolist()
                        crc = [zlib.crc32(raw[a : a + 4 * n]) for a, n in zip(cuts, (ends - begins).tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(file.doc_ids[lo:hi], pa.int64()), pa.array(begins + before), pa.array(ends - begins), pa.array(crc, pa.int64())], schema=_READ)

    return files.select("path", "start").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_round_trip(docs: DataFrame, **options) -> DataFrame:
    """Encode, write and read back all documents: doc_id, start, n_tokens, ids_crc32 of each."""
    scratch = Scratch(docs.sparkSession, "token-files")
    folder = scratch.path("ids")
    files = scratch.settle(write_token_files(docs, folder, **options), "files")
    # a file a row: dealt by number, not by the size of this table
    dealt = with_starts(files).repartition(max(1, files.count()), "path")
    result = scratch.settle(read_token_files(dealt), "documents")
    scratch.keep(result)
    scratch.remove(folder)
    return result
