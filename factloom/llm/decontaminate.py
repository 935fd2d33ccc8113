"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, and an exact check.

Texts and items are lower-cased word sequences, cut into overlapping shingles of five words; an item with fewer words is
one shingle. Every window of a text that is as long as an item gets a 64-bit SimHash, one bit for each majority of its
shingles' hash bits. Windows count whose weighted Jaccard similarity with the item, of the two multisets of shingles, is 0.8
or more. Such a window differs from the item in a known number of shingles at most, so that it can only turn those bits of
the item's fingerprint whose majority is that narrow: these bits are the item's Hamming budget, all others are firm. Eight
tables, one for each block of eight bits, hold for each value of the block the items that it is within the budget of; the
items that all eight name are the window's candidates. So no similar window is ever lost to its fingerprint. Candidates with
enough shared shingles are checked exactly.

Rules for input: a null or empty text matches nothing, nor does an item without words; a text shorter than an item is one
window; texts of any length are read whole; repeated rows and ids give one row for each pair of ids, with the best match;
rows with null ids are compared under the null id; items are taken in blocks of bounded bytes, however many there are, with
a scan of the texts for each block; an empty table on either side gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import once, ready, shingle_hashes, word_hashes

SHINGLE, SIMILARITY_TENTHS = 5, 8
#: Bytes of item texts that are sent to the executors at a time.
ITEM_BYTES = 16_000_000
#: Starts of windows that are worked on at a time.
CHUNK = 1 << 16
#: Shingles of an item from which windows with too few shingles of items are left before their fingerprints are read.
LONG_ITEM = 40
_WORD = re.compile(r"\w+")
_LANES = np.uint64(0x0101010101010101)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def needed(n: int, m: int) -> int:
    """How many shingles multisets of n and m have in common at least, if they reach the similarity."""
    return -(-SIMILARITY_TENTHS * (n + m) // (10 + SIMILARITY_TENTHS))


def votes_of(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set, lowest bit first."""
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def to_print(on: np.ndarray) -> np.ndarray:
    """Rows of 64 truth values as numbers."""
    return np.packbits(on, axis=-1, bitorder="little").view("<u8")[..., 0]


def block_of(prints: np.ndarray, k: int) -> np.ndarray:
    """Block k of fingerprints: their bits k, k + 8, k + 16, ... as numbers of eight bits."""
    return ((prints >> np.uint64(k)) & _LANES) * np.uint64(0x0102040810204080) >> np.uint64(56)


class Windows:
    """SimHash fingerprints of all windows of any length over one run of shingle hashes, by blocks.

    The votes of a block's eight bits are summed together, in the byte lanes of 64-bit words: running sums may overflow, as
    the difference of two of them is the sum of a window's votes whatever was carried. A vote is 1 or -1, so up to 127 of
    them fit a lane; the fingerprints of longer windows are made in wider lanes, of ones.
    """

    def __init__(self, h: np.ndarray):
        self.h, self.runs, self.whole = h, {}, {}

    def _sum(self, x: np.ndarray) -> np.ndarray:
        run = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x, out=run[1:])
        return run

    def block(self, k: int, n: int, at: np.ndarray | None = None) -> np.ndarray:
        """Block k of the fingerprints of the windows of n shingles: of all starts, or of those given."""
        if n > 127:
            if n not in self.whole:
                self.whole[n] = self.prints(n)
            return block_of(self.whole[n] if at is None else self.whole[n][at], k)
        if k not in self.runs:
            run = self._sum((((self.h >> np.uint64(k)) & _LANES) << np.uint64(1)) - _LANES)
            self.runs[k] = run, run + _LANES * np.uint64(127)  # lifted: a lane's highest bit tells whether its votes are above zero
        run, lifted = self.runs[k]
        votes = lifted[n:] - run[:-n] if at is None else lifted[at + n] - run[at]
        votes &= _LANES << np.uint64(7)
        votes *= np.uint64(0x0002040810204081)
        votes >>= np.uint64(56)
        return votes

    def prints(self, n: int) -> np.ndarray:
        """For each start, the fingerprint of the n shingles from there; a bit is set if it is set in over half of them."""
        width = next(w for w in (8, 16, 32, 64) if n < 1 << w)
        ones, high = np.uint64(sum(1 << i for i in range(0, 64, width))), np.uint64(sum(1 << (i + width - 1) for i in range(0, 64, width)))
        lift = ones * np.uint64((1 << (width - 1)) - 1 - n // 2)
        out = np.zeros(max(0, len(self.h) - n + 1), np.uint64)
        for k in range(width):
            run = self._sum((self.h >> np.uint64(k)) & ones)
            out |= ((run[n:] - run[:-n] + lift) & high) >> np.uint64(width - 1 - k)
        return out


class Sized:
    """The items of one width and number of shingles: fingerprints, budgets, and the eight tables."""

    def __init__(self, items: list[int], shingles: list[np.ndarray]):
        self.items, self.n = np.array(items), len(shingles[0])
        self.need = needed(self.n, self.n)
        self.votes = np.stack([votes_of(s) for s in shingles])
        self.prints = to_print(self.votes * 2 > self.n)
        loose = self.n - self.need
        self.firm = to_print(((self.votes - loose) * 2 > self.n) | ((self.votes + loose) * 2 <= self.n))
        self.cells = np.uint8 if len(items) <= 8 else np.uint16 if len(items) <= 16 else np.uint32 if len(items) <= 32 else np.uint64
        size = np.dtype(self.cells).itemsize * 8
        self.words = -(-len(items) // size)
        self.tables = np.zeros((8, self.words, 256), self.cells)
        values = np.arange(256, dtype=np.uint64)
        for block in range(8):
            own, firm = block_of(self.prints, block), block_of(self.firm, block)
            for i in range(len(items)):
                fits = ((values ^ own[i]) & firm[i]) == 0
                self.tables[block, i // size] |= fits.astype(self.cells) << self.cells(i % size)
        self.size = size
        #: Blocks by how few of their values name an item: most windows are done with after two or three.
        self.order = np.argsort((self.tables != 0).sum(axis=2), axis=0, kind="stable")

    def candidates(self, windows: Windows, within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) for the items that all eight blocks of a window's fingerprint name.

        Of long items few bits are firm, and the tables name most of them for most windows; there `within`, the windows that
        hold enough shingles of any item, come first, so that what is named at a time stays few.
        """
        at, items = [], []
        first = np.flatnonzero(within) if self.n >= LONG_ITEM else None
        for w in range(self.words):
            left, named = first, None
            for step, block in enumerate(self.order[:, w].tolist()):
                found = self.tables[block, w].take(windows.block(block, self.n, left))
                named = found if named is None else named & found
                if step or first is not None:
                    some = np.flatnonzero(named != 0)
                    left, named = some if left is None else left[some], named[some]
            for i in range(min(self.size, len(self.items) - w * self.size)):
                hit = left[(named >> self.cells(i)) & self.cells(1) != 0]
                at.append(hit)
                items.append(np.full(len(hit), self.items[w * self.size + i]))
        return np.concatenate(at), np.concatenate(items)

    def of_whole(self, votes: np.ndarray, n: int) -> np.ndarray:
        """Items that a text of n shingles, fewer than theirs, may be similar to, by the same rule for its one window."""
        need = needed(n, self.n)
        if need > n:
            return np.zeros(0, np.int64)
        on, high, low = votes * 2 > n, (self.votes - (self.n - need)) * 2 > n, (self.votes + (n - need)) * 2 <= n
        return self.items[~(high & ~on | low & on).any(axis=1)]


class Items:
    """One block of items, by width and size."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.ids, self.shingles = [], []
        by = defaultdict(list)
        for item_id, text in items:
            if len(w := word_hashes(text)):
                k = min(SHINGLE, len(w))
                self.shingles.append(shingle_hashes(w, k))
                by[k, len(self.shingles[-1])].append(len(self.ids))
                self.ids.append(item_id)
        self.n = [len(s) for s in self.shingles]
        self.sized: dict[int, list[Sized]] = defaultdict(list)
        for (k, _), own in sorted(by.items()):
            self.sized[k].append(Sized(own, [self.shingles[i] for i in own]))
        self.known = {k: np.unique(np.concatenate([self.shingles[i] for s in sized for i in s.items])) for k, sized in self.sized.items()}
        self.parts = [np.unique(s, return_counts=True) for s in self.shingles]

    def matches(self, texts: list[str | None]) -> list[list[tuple]]:
        """For each text, (item id, shared, union, first word, bits apart) of the best window for each item that it holds."""
        out: list[list[tuple]] = [[] for _ in texts]
        words = [word_hashes(t) for t in texts]
        for k, sized in self.sized.items():
            all_h = [shingle_hashes(w, k) for w in words]
            found: dict[tuple[int, int], list[np.ndarray]] = defaultdict(list)
            for some in self._runs(all_h):
                self._scan([all_h[t] for t in some], some, sized, self.known[k], found)
            for t, h in enumerate(all_h):
                if 0 < len(h) < sized[-1].n:
                    votes = votes_of(h)
                    for s in sized:
                        for i in s.of_whole(votes, len(h)) if s.n > len(h) else ():
                            found[t, int(i)].append(np.zeros(1, np.int64))
            for (t, i), starts in sorted(found.items()):
                if best := self._best(all_h[t], i, np.unique(np.concatenate(starts))):
                    out[t].append((self.ids[i], *best))
        return out

    @staticmethod
    def _runs(all_h: list[np.ndarray]):
        """Numbers of texts in a row, about CHUNK shingles together; a longer text is alone."""
        some, held = [], 0
        for t, h in enumerate(all_h):
            if some and held + len(h) > CHUNK:
                yield some
                some, held = [], 0
            some.append(t)
            held += len(h)
        if some:
            yield some

    def _scan(self, texts: list[np.ndarray], numbers: list[int], sized: list[Sized], known: np.ndarray, found: dict) -> None:
        """Add to found[text, item] the starts of windows that are candidates and have enough shingles of items."""
        joined, most = np.concatenate(texts), sized[-1].n
        edges = np.concatenate(([0], np.cumsum([len(h) for h in texts])))
        for first in range(0, len(joined), CHUNK):
            h = joined[first : first + CHUNK + most - 1]
            windows = Windows(h)
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            held = np.concatenate(([0], np.cumsum(known[at] == h)))
            for s in sized:
                if len(h) < s.n:
                    break
                enough = held[s.n :] - held[: -s.n] >= s.need
                start, item = s.candidates(windows, enough)
                start, item = start[enough[start]] + first, item[enough[start]]
                text = np.searchsorted(edges, start, side="right") - 1
                whole = start + s.n <= edges[text + 1]  # not over the end of a text
                start, item, text = start[whole], item[whole], text[whole]
                for t, i in {*zip(text.tolist(), item.tolist())}:
                    found[numbers[t], i].append(start[(text == t) & (item == i)] - edges[t])

    def _best(self, h: np.ndarray, item: int, starts: np.ndarray) -> tuple | None:
        """The exact check: the window with the highest similarity that reaches 0.8, the first of equals."""
        n, (own, want), best = min(self.n[item], len(h)), self.parts[item], None
        for s in starts:
            got, times = np.unique(h[s : s + n], return_counts=True)
            j = np.minimum(np.searchsorted(own, got), len(own) - 1)
            ok = own[j] == got
            shared = int(np.minimum(times[ok], want[j[ok]]).sum())
            union = n + self.n[item] - shared
            if shared * 10 >= SIMILARITY_TENTHS * union and (best is None or shared * best[1] > best[0] * union):
                best = (shared, union, int(s))
        if best is None:
            return None
        mine, its = (to_print(votes_of(x) * 2 > len(x)) for x in (h[best[2] : best[2] + n], self.shingles[item]))
        return (*best, int(np.bitwise_count(mine ^ its)))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item_id, similarity, first_word, bits_apart): each pair of a document and an item that it holds."""
    spark = docs.sparkSession
    ready(spark)
    own = items.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).filter("text is not null")
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / ITEM_BYTES))
    found = None
    for b in range(blocks):
        part = sorted(((r["item_id"], r["text"]) for r in own.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()), key=repr)
        got = _scan(docs, part, id_col, text_col)
        found = got if found is None else found.unionByName(got)
    best = F.max(F.struct("similarity", (-F.col("first_word")).alias("w"), (-F.col("bits_apart")).alias("d"))).alias("m")
    return found.groupBy("doc_id", "item_id").agg(best).select(F.col("doc_id").alias(id_col), "item_id", "m.similarity", (-F.col("m.w")).alias("first_word"), (-F.col("m.d")).alias("bits_apart"))


def _scan(docs: DataFrame, part: list, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(part)
    key = hashlib.md5(repr(part).encode()).hexdigest()

    @F.pandas_udf("array<struct<item_id:long,similarity:double,first_word:int,bits_apart:int>>")
    def run(texts: pd.Series) -> pd.Series:
        index = once("items", key, lambda: Items(sent.value))
        return pd.Series([[{"item_id": i, "similarity": s / u, "first_word": w, "bits_apart": d} for i, s, u, w, d in found] for found in index.matches(list(texts))])

    return docs.select(F.col(id_col).alias("doc_id"), F.inline(run(F.coalesce(F.col(text_col), F.lit("")))))
