"""Token files: ids in fixed-size blocks, each block's bytes (or bits) transposed into planes and packed plane by plane.

A file holds the documents of one range of doc_ids in order. It begins with MAGIC; then come the planes of each block,
packed with zstandard; then the index: for every block the offsets of its planes, for every document its id and length; and
last the index's place. A reader needs only the blocks that it asks for.

Rules for input: null text is the empty text; every document gets the end id, so an empty one is that id alone; rows that
share a doc_id come one after the other in the order of their texts, null doc_ids first; doc_ids are whole numbers of 64
bits (what can't be cast to one counts as null); a text of any length may run over many blocks; an empty table gives no files
and no rows.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib

import numpy as np
import pandas as pd
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .piece_encoder import BatchEncoder
from .shared import cut, once, ready, shared_dir

MAGIC = b"FLTOK01\n"
BLOCK = 65_536  # ids of a block


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The bytes (or bits) of equal place value of all ids, together."""
    n, k = len(ids), ids.dtype.itemsize
    by = np.ascontiguousarray(ids).view(np.uint8).reshape(n, k)
    if not bits:
        return [by[:, i].tobytes() for i in range(k)]
    return [np.packbits(p).tobytes() for p in np.unpackbits(by, axis=1, bitorder="little").T]


def from_planes(planes: list[bytes], n: int, dtype: np.dtype, bits: bool) -> np.ndarray:
    k = np.dtype(dtype).itemsize
    if not bits:
        by = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        by = np.packbits(np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], axis=1), axis=1, bitorder="little")
    return np.ascontiguousarray(by).reshape(n * k).view(dtype)


class TokenWriter:
    """Writes one file; ids of documents in turn. Holds one block at a time, and the index."""

    def __init__(self, stream, dtype: str = "<u2", bits: bool = False, level: int = 3):
        self.out, self.dtype, self.bits = stream, np.dtype(dtype), bits
        self.pack = zstandard.ZstdCompressor(level=level)
        self.held: list[np.ndarray] = []
        self.n_held, self.at = 0, len(MAGIC)
        self.blocks: list = []
        self.doc_ids: list = []
        self.lengths: list[int] = []
        stream.write(MAGIC)

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))
        for i in range(0, len(ids), BLOCK):
            part = ids[i : i + BLOCK].astype(self.dtype)
            self.held.append(part)
            self.n_held += len(part)
            while self.n_held >= BLOCK:
                full = np.concatenate(self.held)
                self._block(full[:BLOCK])
                self.held, self.n_held = [full[BLOCK:]], len(full) - BLOCK

    def _block(self, ids: np.ndarray) -> None:
        places = [self.at]
        for p in to_planes(ids, self.bits):
            data = self.pack.compress(p)
            self.out.write(data)
            self.at += len(data)
            places.append(self.at)
        self.blocks.append([len(ids), places])

    def close(self) -> int:
        """Ends the file; its size in bytes."""
        if self.n_held:
            self._block(np.concatenate(self.held))
        index = self.pack.compress(json.dumps({"dtype": self.dtype.str, "bits": self.bits, "blocks": self.blocks, "doc_ids": self.doc_ids, "lengths": self.lengths}).encode())
        self.out.write(index + struct.pack("<QI", self.at, zlib.crc32(index)) + MAGIC)
        return self.at + len(index) + 12 + len(MAGIC)


class TokenReader:
    """Reads a seekable file that TokenWriter wrote."""

    def __init__(self, stream):
        self.src, size = stream, stream.size()
        tail = 12 + len(MAGIC)
        end = self._at(size - tail, tail)
        if end[12:] != MAGIC or self._at(0, len(MAGIC)) != MAGIC:
            raise ValueError("no token file")
        at, crc = struct.unpack("<QI", end[:12])
        index = self._at(at, size - tail - at)
        if zlib.crc32(index) != crc:
            raise ValueError("bad checksum of the index")
        self.index = json.loads(zstandard.ZstdDecompressor().decompress(index))
        self.doc_ids, self.lengths = self.index["doc_ids"], self.index["lengths"]

    def _at(self, place: int, n: int) -> bytes:
        self.src.seek(place)
        return self.src.read(n)

    def block(self, k: int) -> np.ndarray:
        n, places = self.index["blocks"][k]
        raw, unpack = self._at(places[0], places[-1] - places[0]), zstandard.ZstdDecompressor()
        planes = [unpack.decompress(raw[a - places[0] : b - places[0]]) for a, b in zip(places, places[1:])]
        return from_planes(planes, n, np.dtype(self.index["dtype"]), self.index["bits"])

    def documents(self):
        """(doc_id, [pieces of its ids]) in order, a block in memory at a time and what the document spans."""
        k, held = 0, np.zeros(0, self.index["dtype"])
        for doc_id, n in zip(self.doc_ids, self.lengths):
            pieces = []
            while n:
                if not len(held):
                    held, k = self.block(k), k + 1
                pieces.append(held[:n])
                n -= len(pieces[-1])
                held = held[len(pieces[-1]) :]
            yield doc_id, pieces


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 0, bits: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode docs and write token files in ascending doc_id order; the manifest: (part, path, n_docs, n_tokens, n_bytes).

    Rows are dealt out by ranges of (doc_id, text hash), so one doc_id may hold any share of them. A file is written under
    a name of its own and moved into place, so a repeated task leaves the same file.
    """
    spark = docs.sparkSession
    ready(spark)
    folder = shared_dir(spark, "token-files")
    with open(tokenizer_path, "rb") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def write(batches):
        enc = once("batch-encoder", hashlib.md5(spec.value).hexdigest(), lambda: BatchEncoder(spec.value))
        writer = store = part = None
        tokens = docs_n = 0
        for pdf in batches:
            for p, doc_id, ids in zip(pdf["part"], pdf["doc_id"], enc.encode_all(list(pdf["text"]))):
                if writer is None:
                    part = int(p)
                    store, place = fs.FileSystem.from_uri(folder)
                    store.create_dir(place, recursive=True)
                    name = f"{place}/part-{part:06d}.tok"
                    temp = f"{place}/.{part:06d}-{np.random.default_rng().integers(1 << 62)}"
                    stream = store.open_output_stream(temp)
                    writer = TokenWriter(stream, "<u2" if max(enc.size - 1, end_id) < 1 << 16 else "<u4", bits)
                ids = np.append(ids, np.uint32(end_id))
                writer.add(None if pd.isna(doc_id) else int(doc_id), ids)
                tokens += len(ids)
                docs_n += 1
        if writer is not None:
            size = writer.close()
            stream.close()
            store.move(temp, name)
            yield pd.DataFrame({"part": [part], "path": [f"{folder}/part-{part:06d}.tok"], "n_docs": [docs_n], "n_tokens": [tokens], "n_bytes": [size]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    # a nullable integer column reaches pandas as float; as text it keeps all digits
    rows = rows.select(F.spark_partition_id().alias("part"), F.col("doc_id").cast("string").alias("doc_id"), "text")
    return cut(rows.mapInPandas(write, "part int, path string, n_docs long, n_tokens long, n_bytes long"), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files; start counts the ids of all before it.

    The running sum over the manifest has a row for each file, not for each document.
    """
    from pyspark.sql import Window as W

    spark: SparkSession = manifest.sparkSession
    ready(spark)
    before = F.coalesce(F.sum("n_tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # a task for each file: a number given here is one that Spark doesn't merge
    files = manifest.select("part", "path", before.alias("base")).repartitionByRange(max(1, manifest.count()), "part")

    def read(batches):
        for pdf in batches:
            for path, base in zip(pdf["path"], pdf["base"]):
                store, place = fs.FileSystem.from_uri(path)
                with store.open_input_file(place) as src:
                    rows, at = [], int(base)
                    for doc_id, pieces in TokenReader(src).documents():
                        crc = 0
                        for p in pieces:
                            crc = zlib.crc32(p.astype("<u4").tobytes(), crc)
                        n = sum(map(len, pieces))
                        rows.append((doc_id, at, n, crc))
                        at += n
                        if len(rows) == 10_000:
                            yield _frame(rows)
                            rows = []
                    yield _frame(rows)

    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")])
    return files.mapInPandas(read, schema)


def _frame(rows: list) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
    return out.astype({"doc_id": "Int64", "start": "int64", "n_tokens": "int64", "ids_crc32": "int64"})
