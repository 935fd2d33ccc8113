"""What the training-data operators share: the folder all executors see, shipping of the package, word tables."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from factloom.session import shared_folder as shared_dir
from factloom.session import ship

#: Rows that one Arrow batch carries to Python; texts can be long, so batches are small.
ARROW_ROWS = "1000"


def ready(spark: SparkSession) -> None:
    """Make Python workers able to import this package, and keep their batches small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    ship(spark)


def cut(df: DataFrame, name: str, spent: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Write df to the shared folder and read it back: later jobs restart from there when executors are lost.

    `spent` are earlier cuts that nothing but df reads; their folders go. A caller's last cuts stay as long as its result.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    for x in spent:
        delete(spark, x.cut_path)
    back = spark.read.schema(df.schema).parquet(path)
    back.cut_path = path
    return back


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder that cut() or a writer made, in whatever store it lies."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def own_name(df: DataFrame, name: str) -> str:
    """`name`, or with as many underscores behind it as it takes to be none of df's columns (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_models: dict[tuple[str, str], object] = {}


def once(kind: str, key: str, build):
    """A worker process keeps one built object, the one that was asked for last: workers live on from stage to stage.

    Models hold references to themselves, so what was kept before is collected at once, not some time later, and handed back
    to the system where the C library can.
    """
    if (kind, key) not in _models:
        _models.clear()
        gc.collect()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)
        _models[kind, key] = build()
    return _models[kind, key]


#: Characters of a piece of text that is remembered; longer ones (texts without spaces) are worked out each time.
LONGEST = 48


class Recent(dict):
    """make(key), remembered for about the last 2 x `limit` distinct keys of up to LONGEST characters: bounded in bytes too."""

    def __init__(self, make, limit: int = 150_000):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        if len(key) > LONGEST:
            return self.make(key)
        if (found := self.old.get(key)) is None:
            found = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class WordRows(dict):
    """Word -> row number; rows hold what `make(words)` gives for words not seen before.

    Bounded: forgets all when `limit` words or `chars` characters are held; one text's words are always held together.
    """

    def __init__(self, make, width: int, dtype, limit: int = 80_000, chars: int = 3_000_000):
        super().__init__()
        self.make, self.limit, self.chars, self.held, self.new = make, limit, chars, 0, []
        self.rows = np.zeros((4096, width), dtype)

    def __missing__(self, word):
        at = self[word] = len(self)
        self.held += len(word)
        self.new.append(word)
        return at

    def look_up(self, words: list) -> np.ndarray:
        """The row numbers of words; self.rows then holds all of them."""
        if len(self) > self.limit or self.held > self.chars:
            self.clear()
            self.held = 0
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            n, k = len(self), len(self.new)
            if n > len(self.rows):
                grown = np.zeros((max(n, 2 * len(self.rows)), self.rows.shape[1]), self.rows.dtype)
                grown[: n - k] = self.rows[: n - k]
                self.rows = grown
            self.rows[n - k : n] = self.make(self.new)
            self.new = []
        return at


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers (a public finaliser: xor-shift and odd multipliers)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_grams(words: list[str], sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of each word, and of its character n-grams with < and > around it; and where each word's begin.

    Words hold no white space, and there is at least one. All code points are hashed together, as polynomials.
    """
    joined = " ".join([f"<{w}>" for w in words])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    gap = codes == 32
    owner = np.cumsum(gap)
    base = np.uint64(0x100000001B3)
    starts = np.concatenate(([0], np.flatnonzero(gap) + 1))
    place = np.arange(len(codes)) - starts[owner]
    powers = np.multiply.accumulate(np.full(int(place.max()) + 2, base, np.uint64))
    ids, owners = [np.add.reduceat(np.where(gap, np.uint64(0), codes * powers[place]), starts) + np.uint64(1)], [np.arange(len(words))]
    h = codes
    for n in range(1, max(sizes) + 1):
        if n > 1:
            if len(codes) < n:
                break
            h = h[:-1] * base + codes[n - 1 :]
        if n in sizes:
            ok = ~gap[: len(h)] & (owner[: len(h)] == owner[n - 1 :]) & ~gap[n - 1 :]
            ids.append(h[ok] + np.uint64(n << 56))
            owners.append(owner[: len(h)][ok])
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    found = (mix64(np.concatenate(ids)[order]) % np.uint64(buckets)).astype(np.int64)
    return found, np.searchsorted(owners[order], np.arange(len(words)))


_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: A prime, two bases, and by base the powers of it and of its inverse.
_PRIME = (1 << 31) - 1
_PRIME_BASES = (1_103_515_249, 1_812_433_279)
_PRIME_POWERS = [[np.ones(1, np.uint64), np.ones(1, np.uint64)] for _ in _PRIME_BASES]
_WORD_CHARS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        for i, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _POWERS[i] = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(max(n, 1 << 16) - 1, b, np.uint64))))
    return _POWERS[0][:n], _POWERS[1][:n]


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, or a little above it: the high bits count once more, as 2**31 leaves 1."""
    return (x & np.uint64(_PRIME)) + (x >> np.uint64(31))


def _reduced(x: np.ndarray) -> np.ndarray:
    x = _fold(_fold(_fold(x)))
    return x - (x >= np.uint64(_PRIME)) * np.uint64(_PRIME)


def _prime_powers(k: int, n: int) -> list[np.ndarray]:
    held = _PRIME_POWERS[k]
    for i, b in enumerate((_PRIME_BASES[k], pow(_PRIME_BASES[k], -1, _PRIME))):
        while len(held[i]) < n:
            held[i] = np.concatenate((held[i], _reduced(held[i] * np.uint64(pow(b, len(held[i]), _PRIME)))))
    return [held[0][:n], held[1][:n]]


def word_hashes(text: str | None, stretch: int = 1 << 20) -> np.ndarray:
    """62-bit hashes of the lower-cased words of a text in order; words are what the pattern \\w+ finds.

    All characters are hashed together, as polynomials over two fields, so that words which repeat in patterns don't fall
    together as they do modulo a power of two; a text of many characters in stretches that end between words.
    """
    text = (text or "").lower()
    if not _WORD_CHARS:
        _WORD_CHARS.append(np.array([c == "_" or c.isalnum() for c in map(chr, range(0x110000))]))
    codes = np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    inside = _WORD_CHARS[0][codes]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    if len(codes) <= stretch:
        return field_hashes(codes, starts, ends)
    cuts = np.append(np.arange(0, len(codes), stretch), len(codes))
    at = np.searchsorted(starts, cuts)
    return np.concatenate([field_hashes(codes[starts[a] : ends[b - 1]], starts[a:b] - starts[a], ends[a:b] - starts[a]) for a, b in zip(at, at[1:]) if b > a] or [np.zeros(0, np.uint64)])


def hash_spans(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit keys of codes[start:end] for each span. Unlike spans may share a key, patterned ones among them: compare spans."""
    up, down = _powers(len(codes) + 1)
    run = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:-1], out=run[1:])
    return mix64((run[ends] - run[starts]) * down[starts])


def field_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of codes[start:end] for each span: two polynomials modulo a prime, each of 31 bits, spread over 64."""
    found = np.zeros(len(starts), np.uint64)
    for k in range(len(_PRIME_BASES)):
        up, down = _prime_powers(k, len(codes) + 1)
        run = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(_fold((codes.astype(np.uint64) + np.uint64(1)) * up[:-1]), out=run[1:])
        found = (found << np.uint64(31)) | _reduced(_reduced(run[ends] - run[starts]) * down[starts])
    return mix64(found)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k words in a row, repeats included; fewer than k words give none."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        h = h * np.uint64(_BASE) + words[i : i + len(h)]
    return mix64(h)
