"""Token-ID files of patched frame-of-reference blocks.

A file holds the ids of whole documents in ascending document order, back to back:

    magic "CLTOK01\\n"
    blocks of 4096 ids (the last may be shorter):
        minimum u32, ids u16, exceptions u16, width u8,
        the ids less the minimum, their low ``width`` bits packed from the lowest bit,
        exceptions' positions u16 each, then their full differences u32 each
    index: block starts u64 each (one more for the end), document ids i64 each,
        a byte each that is 1 for a null document id, token counts u32 each
    trailer: index start u64, blocks u32, documents u32, tokens u64, magic

A block's width is the bit length of a high percentile of its differences, so a few large
ids do not widen the rest: they go to the exception list. The block starts make each
document readable alone. Files are written by executors to the shared folder under names
that no other attempt uses; only those that a finished task reports are read.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, partitions, require, shared_path
from .tokenization import encoder, slices, text_sizes, tokenizer_path

MAGIC = b"CLTOK01\n"
BLOCK = 4096
PERCENTILE = 97.0
_head = struct.Struct("<IHHB")
_trailer = struct.Struct("<QIIQ8s")


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of each value, from the lowest bit on."""
    if width in (8, 16, 32):
        return values.astype(f"<u{width // 8}").tobytes()
    if width == 0:
        return b""
    bits = (values[:, None] >> np.arange(width, dtype=np.uint32)).astype(np.uint8) & 1
    return np.packbits(bits, bitorder="little").tobytes()


def unpack_bits(data: bytes, count: int, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", count).astype(np.uint32)
    if width == 0:
        return np.zeros(count, np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=count * width, bitorder="little").reshape(count, width)
    padded = np.zeros((count, 32), np.uint8)
    padded[:, :width] = bits
    return np.packbits(padded, axis=1, bitorder="little").view("<u4").reshape(count)


def encode_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    least = int(ids.min())
    rest = ids - np.uint32(least)
    width = int(np.partition(rest, k := int((len(rest) - 1) * percentile / 100))[k]).bit_length()
    if width < 32:
        at = np.flatnonzero(rest >> np.uint32(width))
    else:
        at = np.empty(0, np.int64)
    return b"".join((_head.pack(least, len(ids), len(at), width), pack_bits(rest, width), at.astype("<u2").tobytes(), rest[at].astype("<u4").tobytes()))


def decode_block(data: bytes) -> np.ndarray:
    least, count, exceptions, width = _head.unpack_from(data)
    end = _head.size + (count * width + 7) // 8
    rest = unpack_bits(data[_head.size : end], count, width)
    if exceptions:
        at = np.frombuffer(data, "<u2", exceptions, end)
        rest[at] = np.frombuffer(data, "<u4", exceptions, end + 2 * exceptions)
    return rest + np.uint32(least)


class TokenFileWriter:
    """Writes documents one after another; keeps one block and the index in memory."""

    def __init__(self, out, percentile: float = PERCENTILE):
        self.out, self.percentile = out, percentile
        self.pending: list[bytes] = []
        self.held = self.tokens = 0
        self.starts, self.ids, self.counts = [len(MAGIC)], [], []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.tokens += len(ids) // 4
        self.pending.append(ids)
        self.held += len(ids)
        if self.held >= 64 * 4 * BLOCK:
            self._blocks(False)

    def _blocks(self, last: bool) -> None:
        data = np.frombuffer(b"".join(self.pending), "<u4")
        end = len(data) if last else len(data) // BLOCK * BLOCK
        for at in range(0, end, BLOCK):
            block = encode_block(data[at : min(at + BLOCK, end)], self.percentile)
            self.out.write(block)
            self.starts.append(self.starts[-1] + len(block))
        self.pending = [data[end:].tobytes()]
        self.held = 4 * (len(data) - end)

    def close(self) -> None:
        self._blocks(True)
        nulls = np.array([x is None for x in self.ids], np.uint8)
        ids = np.array([0 if x is None else x for x in self.ids], "<i8")
        for part in (np.array(self.starts, "<u8"), ids, nulls, np.array(self.counts, "<u4")):
            self.out.write(part.tobytes())
        self.out.write(_trailer.pack(self.starts[-1], len(self.starts) - 1, len(self.ids), self.tokens, MAGIC))
        self.out.close()


class TokenFileReader:
    """Reads a file's index, then whole documents in order or one alone."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        at, blocks, docs, self.tokens, magic = _trailer.unpack(self._read(size - _trailer.size, _trailer.size))
        if magic != MAGIC or self._read(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a token file")
        index = self._read(at, size - _trailer.size - at)
        parts, end = [], 0
        for kind, n in (("<u8", blocks + 1), ("<i8", docs), ("u1", docs), ("<u4", docs)):
            parts.append(np.frombuffer(index, kind, n, end))
            end += n * np.dtype(kind).itemsize
        self.starts, ids, nulls, self.counts = parts
        self.doc_ids = [None if null else int(x) for x, null in zip(ids, nulls)]
        self.firsts = np.concatenate(([0], np.cumsum(self.counts, dtype=np.int64)))

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def blocks(self, first: int, last: int) -> np.ndarray:
        """The ids of blocks first to last, last not included."""
        base = int(self.starts[first])
        data = self._read(base, int(self.starts[last]) - base)
        ends = (self.starts[first : last + 1] - base).tolist()
        return np.concatenate([decode_block(data[a:b]) for a, b in pairwise(ends)] or [np.empty(0, np.uint32)])

    def document(self, k: int) -> np.ndarray:
        a, b = int(self.firsts[k]), int(self.firsts[k + 1])
        if a == b:
            return np.empty(0, np.uint32)
        first = a // BLOCK
        return self.blocks(first, (b - 1) // BLOCK + 1)[a - first * BLOCK : b - first * BLOCK]

    def documents(self, group: int = 64) -> Iterator[bytes]:
        """The ids of each document in order, as bytes; ``group`` blocks are held at a time."""
        block, held = 0, b""
        for n in (self.counts.astype(np.int64) * 4).tolist():
            parts, have = [held], len(held)
            while have < n:
                upto = min(block + group, len(self.starts) - 1)
                parts.append(self.blocks(block, upto).astype("<u4").tobytes())
                have, block = have + len(parts[-1]), upto
            held = b"".join(parts)
            yield held[:n]
            held = held[n:]


def _filesystem(uri: str):
    return pafs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", files: int | None = None) -> DataFrame:
    """Encode whole texts and write them in ascending id order; returns the files' manifest.

    The manifest has (file, part, documents, tokens, start), ``start`` being the ids in all
    files before. Each document is its text's ids and ``end_id``; null and empty texts are
    the end id alone. Null ids come first; rows with equal ids follow each other in an
    order fixed by their texts. Ids are integers; others are an error. Other columns are not read. An
    empty table gives no files.
    """
    require(docs, id_col, text_col)
    spark = docs.sparkSession
    path = tokenizer or tokenizer_path("word_bpe_49k.json")
    end = int(end_id).to_bytes(4, "little")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer = encoder(path).encode, None
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.tok"
        for batch in batches:
            if writer is None:
                where, base = _filesystem(folder)
                where.create_dir(base, recursive=True)
                writer = TokenFileWriter(where.open_output_stream(f"{base}/{name}"))
            for lo, hi in slices(text_sizes(batch.column(1)), 12_000_000):
                ids = batch.column(0).slice(lo, hi - lo).to_pylist()
                for doc_id, got in zip(ids, encode(batch.column(1).slice(lo, hi - lo))):
                    writer.add(doc_id, got + end)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "part": pa.array([part], pa.int32()), "documents": [len(writer.ids)], "tokens": [writer.tokens]})

    dealt = docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).repartitionByRange(files or partitions(spark), id_col)
    ordered = dealt.sortWithinPartitions(F.col(id_col), F.xxhash64(text_col))
    written = ordered.mapInArrow(lean(write), "file string, part int, documents bigint, tokens bigint").collect()
    rows, start = [], 0
    for r in sorted(written, key=lambda r: r["part"]):
        rows.append((r["file"], r["part"], r["documents"], r["tokens"], start))
        start += r["tokens"]
    return spark.createDataFrame(rows, "file string, part int, documents bigint, tokens bigint, start bigint")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Read the files of a manifest: (doc_id, start, n_tokens, token_ids binary) per document.

    ``start`` counts the ids of all documents before it, in all files.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = _filesystem(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with where.open_input_file(f"{base}/{name}") as source:
                    reader = TokenFileReader(source)
                    rows: tuple[list, list, list, list] = ([], [], [], [])
                    size = 0
                    for k, ids in enumerate(reader.documents()):
                        for column, value in zip(rows, (reader.doc_ids[k], start + int(reader.firsts[k]), len(ids) // 4, ids)):
                            column.append(value)
                        size += len(ids)
                        if size > 12_000_000:
                            yield out(rows)
                            rows, size = ([], [], [], []), 0
                    if rows[0]:
                        yield out(rows)

    def out(rows) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)], names=["doc_id", "start", "n_tokens", "token_ids"])

    spark: SparkSession = manifest.sparkSession
    files = manifest.select("file", "start")
    return files.repartition(max(1, partitions(spark)), "file").mapInArrow(lean(read), "doc_id bigint, start bigint, n_tokens bigint, token_ids binary")


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    """Writes all documents to token files in the shared folder and reads them back."""
    folder = shared_path(spark, "token-files")
    manifest = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return read_token_files(manifest, folder).select("doc_id", "start", "n_tokens", F.crc32("token_ids").alias("ids_crc32"))
