"""Packing of documents into sequences of a fixed number of tokens: first-fit decreasing in randomised groups.

A document's ids, with an end id, are cut into pieces of `capacity` from its start; full pieces are sequences of their own, and
what is left over, one piece a document at most, goes to a random group of about GROUP pieces. In a group the pieces are taken
longest first, and each goes to the first sequence with room for it: a tournament tree over the sequences' free room, whose
inner nodes hold the most room below them, names it in one walk from the root. Groups know nothing of each other, so any number
of them are packed at once, and none grows with the input.

Rules for input: a null or empty text is one end id; a text of any length runs over as many sequences as it takes; rows that
share an id, or are equal, are documents each; an empty table gives an empty one; other columns are left to the caller.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .piece_encoder import WordEncoder
from .shared import cut, once, ready

#: Pieces that are packed together, about; and the numbers that a group may give to its sequences.
GROUP, NUMBERS = 4096, 1 << 20


class Tournament:
    """Free room of sequences 0, 1, ...: a full binary tree, in an array, whose inner nodes hold the larger of two rooms."""

    def __init__(self, sequences: int, capacity: int):
        self.leaves = 1 << max(0, sequences - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def first_with(self, length: int) -> int:
        """The first sequence with that much room; there is one."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < length:
                at += 1
        return at - self.leaves

    def take(self, sequence: int, length: int) -> int:
        """Fill that much of a sequence; the room it had."""
        room, at = self.room, sequence + self.leaves
        before = room[at]
        room[at] = before - length
        while at > 1:
            at //= 2
            most = max(room[2 * at], room[2 * at + 1])
            if room[at] == most:
                break
            room[at] = most
        return before


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset in it) of each length; equal lengths in their given order."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free = Tournament(len(lengths), capacity)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        s = free.first_with(n)
        sequence[i], offset[i] = s, capacity - free.take(s, n)
    return sequence, offset


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, ids, doc_tokens, place), written: pieces of whole encoded texts; place is a number of the piece's own.

    ids are little-endian unsigned 32-bit numbers, at most `capacity` of them a row.
    """
    spark = docs.sparkSession
    ready(spark)
    with open(tokenizer_path, "rb") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def encode(batches):
        enc = once("word-encoder", hashlib.md5(spec.value).hexdigest(), lambda: WordEncoder(spec.value))
        for pdf in batches:
            all_ids = [np.append(ids, np.uint32(end_id)) for ids in enc.encode_all(list(pdf["text"]))]
            tokens = np.array([len(x) for x in all_ids], np.int64)
            cuts = -(-tokens // capacity)
            doc = np.repeat(np.arange(len(pdf)), cuts)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * capacity
            for a in range(0, len(doc), 4096):  # a long text has many pieces
                d, s = doc[a : a + 4096], start[a : a + 4096]
                ids = [all_ids[i][x : x + capacity].tobytes() for i, x in zip(d.tolist(), s.tolist())]
                yield pd.DataFrame({"id": pdf["id"].to_numpy()[d], "start": s, "length": np.minimum(capacity, tokens[d] - s), "ids": ids, "doc_tokens": tokens[d]})

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    pieces = rows.mapInPandas(encode, "id string, start long, length long, ids binary, doc_tokens long")
    # what is random is written, so it stays as it is when a task runs again
    return cut(pieces.withColumn("place", F.monotonically_increasing_id()).withColumn("chance", F.rand(1)), "token-pieces")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence_id, offset), a row for each piece of a document.

    Offsets of a sequence run from 0 without a gap. Sequence ids are distinct numbers, not one after the other: odd ones are
    full pieces, even ones belong to the groups.
    """
    pieces = token_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col)
    groups = max(1, math.ceil(pieces.filter(F.col("length") < capacity).count() / group))
    columns = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place").reset_index(drop=True)
        sequence, offset = first_fit_decreasing(pdf["length"].to_numpy(), capacity)
        return pdf.assign(sequence_id=2 * (pdf["grp"] * NUMBERS + sequence), offset=offset)[columns]

    full = pieces.filter(F.col("length") == capacity).select(*columns[:5], (2 * F.col("place") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.filter(F.col("length") < capacity).withColumn("grp", F.floor(F.col("chance") * groups))
    schema = "id string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    packed = rest.groupBy("grp").applyInPandas(pack, schema).unionByName(full)
    kind = docs.schema[id_col].dataType
    return packed.select(F.col("id").cast(kind).alias(id_col), *columns[1:])


def sequences(packed: DataFrame, capacity: int = 2048, pad_id: int = 0, id_col: str = "doc_id") -> DataFrame:
    """(sequence_id, ids, filled, documents): what a trainer reads, `capacity` ids a row, padded at the end.

    documents are the pieces in order, each with its document's id, its start there, its offset and its length. A sequence has
    at most `capacity` pieces.
    """
    piece = F.struct("offset", "length", F.col(id_col).alias("id"), "start", "ids")
    held = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    filled = F.aggregate("p", F.lit(0).cast("long"), lambda n, x: n + x.length)
    pad = F.unhex(F.repeat(F.hex(F.lit(pad_id.to_bytes(4, "little"))), (capacity - filled).cast("int")))
    ids = F.concat(F.aggregate("p", F.lit(b""), lambda b, x: F.concat(b, x.ids)), pad)
    return held.select("sequence_id", ids.alias("ids"), filled.alias("filled"), F.transform("p", lambda x: F.struct(x.id.alias("id"), x.start.alias("start"), x.offset.alias("offset"), x.length.alias("length"))).alias("documents"))
