"""BPE encoding and decoding by dynamic programming over prefixes.

The BPE result of each prefix of a word ends in exactly one token. A suffix automaton of the vocabulary gives all tokens
that end at a position; the one whose pairing with the last token of the prefix before it survives the merge order is that
token. Back-pointers from the end of the word then give the exact ids, without running any merges.

Rules for input: null text is the empty text; empty text has no ids and decodes to ''; a text of any length is encoded
whole; equal rows give equal results; an empty table gives an empty one; other columns are left out or kept by the caller.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Recent, once, ready

#: Pairs of tokens that a worker remembers, some 120 bytes each.
PAIRS = 400_000
#: Separators that str.split() takes but the tokenizers' white space class does not.
_NOT_SPACE = regex.compile("[\x1c-\x1f]")
_SPACE = regex.compile(r"[\t-\r \x85   -     　]+")


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte: itself where it is visible Latin-1, else from U+0100 up."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class SuffixAutomaton:
    """Of many words at once; the state of each whole word carries its number."""

    def __init__(self, words: dict[str, int]):
        self.next: list[dict] = [{}]
        self.link, self.len, self.word = [-1], [0], [-1]
        self._ends: dict[int, tuple] = {0: ()}
        for w, n in words.items():
            at = 0
            for c in w:
                at = self._grow(at, c)
            self.word[at] = n

    def _state(self, length: int, nexts: dict, link: int) -> int:
        self.next.append(nexts)
        self.link.append(link)
        self.len.append(length)
        self.word.append(-1)
        return len(self.len) - 1

    def _split(self, p: int, c: str, q: int) -> int:
        """A state for the shorter strings of q, those that reach it from p."""
        new = self._state(self.len[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _grow(self, last: int, c: str) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.len[q] == self.len[last] + 1 else self._split(last, c, q)
        cur, p = self._state(self.len[last] + 1, {}, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._split(p, c, q)
        return cur

    def ends(self, state: int) -> tuple:
        """(word number, length) of all whole words that are suffixes of this state's longest string, longest first."""
        if (found := self._ends.get(state)) is None:
            own = ((self.word[state], self.len[state]),) if self.word[state] >= 0 else ()
            found = self._ends[state] = own + self.ends(self.link[state])
        return found


class Bpe:
    """Encoder and decoder for a tokenizer file with byte-level BPE: merges, optional word-end marks, normalising steps."""

    def __init__(self, spec: bytes):
        j = json.loads(spec)
        model = j["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.special_at = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.string = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        steps = (j.get("normalizer") or {}).get("normalizers", [])
        self.kinds = {s["type"] for s in steps}
        pre = j["pre_tokenizer"]
        split = next((p for p in pre.get("pretokenizers", []) if p["type"] == "Split"), None)
        self.pattern = regex.compile(split["pattern"]["Regex"]) if split else regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        #: Whether any word of letters alone is one piece of the pattern.
        self.words_of_letters = all(self.pattern.findall(w) == [w] for w in ("s", "re", "llama", "Tve", "été", "ЖЗ", "日本語", "aʰ")) and regex.search(r"\\p\{L\}\]?\+", self.pattern.pattern) is not None
        self.joined_bytes = (j.get("decoder") or {}).get("type") == "ByteLevel"
        self.of_byte = byte_chars()
        self.to_byte = {c: b for b, c in self.of_byte.items()}
        self.by_latin = {b: c for b, c in self.of_byte.items()}
        self._merge_order(merges)
        self.automaton = SuffixAutomaton({self.symbols[t]: t for t in self.symbols if self._whole(t)})
        del self.vocab, self.symbols  # only the tables built from them are needed
        #: By pair of tokens, as one number, whether they stay apart.
        self.fits: dict[int, bool] = {}
        self.tokens = max(self.string) + 1
        #: Ids of pieces between white space and of the words within them, together.
        self.chunks = Recent(self._chunk, 120_000)

    def _mark(self, c: str) -> str:
        """The symbol of a character that ends a word."""
        return chr(ord(c) + 0x10000)

    def _merge_order(self, merges: list[tuple[str, str]]) -> None:
        self.symbols, self.rank, self.left, self.right, self.merged = {}, {}, {}, {}, {}
        for c in self.to_byte:
            for name, sym in ((c, c), (c + self.suffix, self._mark(c))):
                if name in self.vocab and (i := self.vocab[name]) not in self.symbols:
                    self.symbols[i], self.rank[i] = sym, -1
        for r, (a, b) in enumerate(merges):
            x, y, z = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.merged[x, y] = r
            if z not in self.symbols:
                self.symbols[z], self.rank[z], self.left[z], self.right[z] = self.symbols[x] + self.symbols[y], r, x, y

    def _apart(self, a: int, b: int, before: int, ties: bool) -> bool:
        """Whether no merge crosses the border of a and b while both are undone, latest merge first. `before` bounds the
        rank of a crossing merge; at that very rank it comes first only where b was undone last (`ties`)."""
        rank, merged = self.rank, self.merged
        while True:
            r = merged.get((a, b))
            if r is not None and (r < before or ties and r == before):
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if rb >= ra:
                before, ties, b = rb, True, self.left[b]
            else:
                before, ties, a = ra, False, self.right[a]

    def _whole(self, t: int) -> bool:
        """Whether the merges give this token for its own string."""
        return self.rank[t] < 0 or self._apart(self.left[t], self.right[t], self.rank[t], False)

    def _follows(self, a: int, b: int) -> bool:
        if (ok := self.fits.get(a * self.tokens + b)) is None:
            if len(self.fits) > PAIRS:
                self.fits.clear()
            ok = self.fits[a * self.tokens + b] = self._apart(a, b, 1 << 40, False)
        return ok

    def encode_word(self, word: str) -> bytes:
        """Ids, as bytes, of one piece that the splitting pattern gave."""
        # ASCII letters and digits stand for themselves
        sym = word if word.isascii() and word.isalnum() else "".join(map(self.of_byte.__getitem__, word.encode("utf-8", "replace")))
        if not sym:
            return b""
        if self.suffix:
            sym = sym[:-1] + self._mark(sym[-1])
        sam, fits, follows, tokens = self.automaton, self.fits, self._follows, self.tokens
        nexts, link, length, ends = sam.next, sam.link, sam.len, sam._ends
        last, back, state, run = [], [], 0, 0
        for i, c in enumerate(sym, 1):
            while (to := nexts[state].get(c)) is None:
                state = link[state]
                run = length[state]
            state, run = to, run + 1
            for t, n in whole if (whole := ends.get(state)) is not None else sam.ends(state):
                if n <= run:
                    if n != i:
                        before = last[i - n - 1]
                        if not (ok if (ok := fits.get(before * tokens + t)) is not None else follows(before, t)):
                            continue
                    last.append(t)
                    back.append(i - n)
                    break
        ids, i = [], len(sym)
        while i:
            ids.append(last[i - 1])
            i = back[i - 1]
        return array("I", ids[::-1]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a piece of text with no white space to its left and right that matters."""
        found, at = [], 0
        for m in self.special_at.finditer(chunk) if self.special_at and "<" in chunk else ():
            found += self._plain(chunk[at : m.start()]), np.array([self.special[m.group()]], "<u4").tobytes()
            at = m.end()
        return b"".join((*found, self._plain(chunk[at:])))

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        if "NFC" in self.kinds and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        given, letters = text, self.words_of_letters and text.isalpha()
        if "Replace" in self.kinds and not letters:
            text = _SPACE.sub(" ", text)
        if "Lowercase" in self.kinds:
            text = text.lower() if text.isascii() else text.replace("Σ", "σ").lower()
        words = [text] if letters and text.isalpha() else self.pattern.findall(text)  # a word of letters stays whole
        if words == [given]:
            return self.encode_word(given)
        return b"".join(map(self.chunks.__getitem__, words))

    def encode(self, text: str | None) -> np.ndarray:
        """Ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return np.zeros(0, "<u4")
        if "Replace" not in self.kinds or self.pattern.fullmatch(" "):
            return np.frombuffer(self._chunk(text), "<u4")
        chunks = text.split() if not _NOT_SPACE.search(text) else _SPACE.split(text)
        return np.frombuffer(b"".join(map(self.chunks.__getitem__, chunks)), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; special tokens keep their strings."""
        tokens = map(self.string.__getitem__, ids.tolist())
        if not self.joined_bytes:
            return " ".join(tokens)
        out = bytearray()
        for t in tokens:
            out += t.encode() if t in self.special else bytes(map(self.to_byte.__getitem__, t))
        return out.decode("utf-8", "replace")


def bpe_model(spec: bytes) -> Bpe:
    """The model of a tokenizer file, built once in a process."""
    return once("bpe", hashlib.md5(spec).hexdigest(), lambda: Bpe(spec))


def encode_decode_udf(spark: SparkSession, tokenizer_path: str):
    """A column function: text -> struct(ids binary, little-endian unsigned 32-bit; decoded string).

    The driver reads the tokenizer file, under two megabytes whatever the data, and ships it.
    """
    ready(spark)
    with open(tokenizer_path, "rb") as f:
        spec = spark.sparkContext.broadcast(f.read())

    @F.pandas_udf("ids binary, decoded string")
    def run(texts: pd.Series) -> pd.DataFrame:
        bpe = bpe_model(spec.value)
        ids = [bpe.encode(t) for t in texts]
        return pd.DataFrame({"ids": [i.tobytes() for i in ids], "decoded": [bpe.decode(i) for i in ids]})

    return run


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary, n_tokens long, decoded string) for every row of docs."""
    run = encode_decode_udf(docs.sparkSession, tokenizer_path)
    one: Column = run(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col), one.alias("e")).select(id_col, F.col("e.ids").alias("ids"), F.expr("cast(length(e.ids) div 4 as bigint)").alias("n_tokens"), F.col("e.decoded").alias("decoded"))
