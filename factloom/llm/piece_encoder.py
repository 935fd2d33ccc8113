"""The tokenizers library over many texts: pieces that were seen before are looked up in arrays, new ones go to the library together.

A piece is a part of a text whose ids do not depend on what stands around it, so the ids of a text are those of its pieces in
turn. Pieces are found by a 64-bit hash and then compared character by character; where two unlike pieces share a hash, the
texts at hand go to the library as they are. Memory is bounded by numbers of pieces, ids and characters, and long texts are
taken a stretch at a time, cut between two words.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np

from .bpe import byte_chars
from .shared import hash_spans

#: Kinds of characters: the apostrophe and what lies beyond Latin are just visible; odd white space and controls are other.
OTHER, SPACE, NEWLINE, VISIBLE, LETTER, NUMBER, SIGN = range(7)
#: What stands before, between and behind texts.
EDGE = 0x110000
#: White space to the normaliser of tokenizers with word ends.
_BLANK = re.compile("[\t-\r \x85\xa0  -     　]")
#: A space that every splitting pattern here begins a piece at, or drops.
_BETWEEN_WORDS = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for lengths[0] numbers, then the same from starts[1], and so on."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _classes() -> np.ndarray:
    """For each code point, and for EDGE, what it is to the byte-level splitting pattern."""
    kinds = np.full(EDGE + 1, VISIBLE, np.uint8)
    for i in range(0x3100):
        c = chr(i)
        if c == " " or c == "\n":
            kinds[i] = SPACE if c == " " else NEWLINE
        elif c.isspace() or c == "'" or unicodedata.category(c) in ("Cc", "Cf"):
            kinds[i] = VISIBLE if c == "'" else OTHER
        elif i < 0x250:
            kinds[i] = {"L": LETTER, "N": NUMBER}.get(unicodedata.category(c)[0], SIGN)
    kinds[EDGE] = OTHER
    return kinds


class Growing:
    """An array that is added to."""

    def __init__(self, dtype):
        self.room, self.n = np.empty(1 << 14, dtype), 0

    def add(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.room):
            wider = np.empty(max(2 * len(self.room), self.n + len(x)), self.room.dtype)
            wider[: self.n] = self.room[: self.n]
            self.room = wider
        self.room[self.n : self.n + len(x)] = x
        self.n += len(x)

    def __len__(self) -> int:
        return self.n

    def held(self) -> np.ndarray:
        return self.room[: self.n]


class BatchEncoder:
    """Byte-level BPE. The splitting pattern always begins a piece at a single space between two visible characters, at and
    after a single newline between two, and where letters, numbers and signs of Latin text meet (but at apostrophes, which may
    begin a contraction). Texts are cut there and nowhere else. New pieces are joined by such spaces or newlines, encoded in
    one call, and told apart by the tokens that begin with a space or are the newline's.
    """

    #: Pieces, and their ids and characters, that are remembered; and characters that are cut at a time.
    PIECES, IDS, CHUNK = 1_500_000, 12_000_000, 1 << 18

    def __init__(self, spec: bytes):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(spec.decode())
        self.whole.no_truncation()
        self.whole.no_padding()
        j, vocab = json.loads(spec), self.whole.get_vocab()
        self.size = self.whole.get_vocab_size()
        self.special = [t["content"] for t in j["added_tokens"]]
        self.turn = 0
        self._prepare(j, vocab)
        self._empty()

    def _prepare(self, j: dict, vocab: dict) -> None:
        self.cuts = j["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and not j["normalizer"]
        space, newline = byte_chars()[32], byte_chars()[10]
        self.spaced, self.newline = np.zeros(max(vocab.values()) + 1, bool), vocab.get(newline)
        self.spaced[[i for t, i in vocab.items() if t.startswith(space)]] = True
        self.kinds = _classes()

    def _empty(self) -> None:
        """Sorted hashes, the row of each; rows: where ids and characters begin, how many, when last used."""
        self.keys, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.at, self.n, self.from_, self.width, self.used = (Growing(np.int64) for _ in range(5))
        self.ids, self.chars = Growing(np.dtype("<u4")), Growing(np.dtype("<u4"))

    def _folded(self, codes: np.ndarray) -> np.ndarray:
        return codes

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _pieces(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces begin and how long they are. EDGE is a piece of its own."""
        kind = self.kinds[codes]
        seen = kind >= VISIBLE
        begins = np.zeros(len(codes), bool)
        here = kind[1:-1]
        lone = seen[:-2] & seen[2:]
        begins[1:-1] = lone & ((here == SPACE) | (here == NEWLINE))
        begins[2:] |= lone & (here == NEWLINE)
        begins[1:] |= (kind[:-1] >= LETTER) & (kind[1:] >= LETTER) & (kind[:-1] != kind[1:])
        edge = codes == EDGE
        begins |= edge
        begins[1:] |= edge[:-1]
        starts = np.flatnonzero(begins)
        return starts, np.diff(np.append(starts, len(codes)))

    def _learn(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each piece's begin, how many) of pieces, by the library."""
        kind = self.kinds[codes]
        blank = np.concatenate(([0], np.cumsum((kind == SPACE) | (kind == NEWLINE) | (kind == OTHER))))
        led = kind[starts] == SPACE
        blanks = blank[starts + lengths] - blank[starts]
        groups = [np.flatnonzero(led & (blanks == 1) & (lengths > 1)), np.flatnonzero(~led & (blanks == 0))]
        parts, at, n = [], np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        have = 0
        for g, joined in zip(groups, (True, False)):
            if not len(g):
                continue
            if joined:
                text = codes[spread(starts[g], lengths[g])]
            else:  # with a newline before each
                where = np.cumsum(lengths[g] + 1) - lengths[g] - 1
                text = np.full(where[-1] + lengths[g][-1] + 1, 10, "<u4")
                text[spread(where + 1, lengths[g])] = codes[spread(starts[g], lengths[g])]
            ids = self._library(text.astype("<u4").tobytes().decode("utf-32-le"))
            first = np.flatnonzero(self.spaced[ids] if joined else ids == self.newline)
            if len(first) != len(g):
                raise RuntimeError("pieces and their tokens do not agree")
            at[g], n[g] = have + first + (not joined), np.diff(np.append(first, len(ids))) - (not joined)
            parts.append(ids)
            have += len(ids)
        alone = np.ones(len(starts), bool)
        alone[np.concatenate(groups)] = False
        for i in np.flatnonzero(alone):
            ids = self._library(codes[starts[i] : starts[i] + lengths[i]].astype("<u4").tobytes().decode("utf-32-le"))
            at[i], n[i] = have, len(ids)
            parts.append(ids)
            have += len(ids)
        return np.concatenate(parts), at, n

    def _encode(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of all texts in turn, and how many there are by EDGE that ends a text; None where hashes don't tell pieces apart."""
        starts, lengths = self._pieces(codes)
        ends = codes[starts] == EDGE
        own, size = starts[~ends], lengths[~ends]
        found, first, of = np.unique(hash_spans(codes, own, own + size), return_index=True, return_inverse=True)
        spot = np.searchsorted(self.keys, found)
        known = np.zeros(len(found), bool)
        inside = spot < len(self.keys)
        known[inside] = self.keys[spot[inside]] == found[inside]
        new = np.flatnonzero(~known)
        if len(new):
            at, width = own[first[new]], size[first[new]]
            ids, begin, n = self._learn(codes, at, width)
            rows = self.at.n + np.arange(len(new))
            for column, x in ((self.at, begin + self.ids.n), (self.n, n), (self.from_, np.cumsum(width) - width + self.chars.n), (self.width, width), (self.used, np.full(len(new), self.turn))):
                column.add(x)
            self.ids.add(ids)
            self.chars.add(codes[spread(at, width)])
            self.keys, self.row = np.insert(self.keys, spot[new], found[new]), np.insert(self.row, spot[new], rows)
            spot = np.searchsorted(self.keys, found)
        row = self.row[spot]
        self.used.held()[row] = self.turn
        row = row[of]
        if (self.width.held()[row] != size).any() or (self.chars.held()[spread(self.from_.held()[row], size)] != codes[spread(own, size)]).any():
            return None
        each = np.zeros(len(starts), np.int64)
        each[~ends] = self.n.held()[row]
        out = self.ids.held()[spread(self.at.held()[row], each[~ends])]
        self._forget()
        return out, np.diff(np.cumsum(each)[ends])

    def _forget(self) -> None:
        """Keep the half that was used last, once there are too many."""
        self.turn += 1
        if self.at.n <= self.PIECES and self.ids.n <= self.IDS and self.chars.n <= self.IDS:
            return
        last = self.used.held()
        keep = np.flatnonzero(last > np.partition(last, len(last) // 2)[len(last) // 2])  # none, if one batch brought most
        at, n, from_, width, used = (x.held()[keep] for x in (self.at, self.n, self.from_, self.width, self.used))
        ids, chars = self.ids.held()[spread(at, n)], self.chars.held()[spread(from_, width)]
        to = np.full(self.at.n, -1)
        to[keep] = np.arange(len(keep))
        left = to[self.row] >= 0
        keys, row = self.keys[left], to[self.row[left]]
        self._empty()
        self.keys, self.row = keys, row
        for column, x in ((self.at, np.cumsum(n) - n), (self.n, n), (self.from_, np.cumsum(width) - width), (self.width, width), (self.used, used), (self.ids, ids), (self.chars, chars)):
            column.add(x)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out = [np.zeros(0, "<u4") for _ in texts]
        some, held = [], 0
        for i, t in enumerate(texts):
            if not t:
                continue
            if not self.cuts or any(x in t for x in self.special):
                out[i] = self._library(t)
            elif len(t) > self.CHUNK:
                out[i] = np.concatenate([self._some([x])[0] for x in self._stretches(t)])
            else:
                if held + len(t) > self.CHUNK:
                    self._fill(texts, some, out)
                    some, held = [], 0
                some.append(i)
                held += len(t)
        self._fill(texts, some, out)
        return out

    def _stretches(self, text: str):
        at = 0
        while m := _BETWEEN_WORDS.search(text, at + self.CHUNK):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]

    def _fill(self, texts: list[str], some: list[int], out: list[np.ndarray]) -> None:
        if some:
            for i, part in zip(some, self._some([texts[i] for i in some])):
                out[i] = part

    def _some(self, texts: list[str]) -> list[np.ndarray]:
        edge = np.array([EDGE], "<u4")
        got = self._encode(self._folded(np.concatenate([edge, *(x for t in texts for x in (np.frombuffer(t.encode("utf-32-le"), "<u4"), edge))])))
        if got is None:
            return [self._library(t) for t in texts]
        return np.split(got[0], np.cumsum(got[1])[:-1])


class WordEncoder(BatchEncoder):
    """BPE with word ends, lower case, white space dropped. Words never reach over white space; letters, single numbers and
    signs of Latin text are words apart (but at apostrophes). New words of Latin letters are encoded in one call by the same
    model without its normaliser, and told apart by the tokens that end a word; other pieces are joined by a special token,
    which the library never merges with what stands beside it.
    """

    def _prepare(self, j: dict, vocab: dict) -> None:
        from tokenizers import Tokenizer

        steps = [{k: v for k, v in s.items() if k in ("type", "pattern")} for s in (j["normalizer"] or {}).get("normalizers", [])]
        split = (j["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        fixed = [t for t in j["added_tokens"] if not t["normalized"] and not t["lstrip"] and not t["rstrip"] and not t["single_word"]]
        suffix = j["model"].get("end_of_word_suffix")
        self.cuts = (
            steps == [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}}, {"type": "Lowercase"}]
            and split[0].get("pattern") == {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
            and bool(fixed)
            and bool(suffix)
        )
        if not self.cuts:
            return
        self.mark, self.mark_id = np.frombuffer(fixed[0]["content"].encode("utf-32-le"), "<u4"), fixed[0]["id"]
        self.words = Tokenizer.from_str(json.dumps(j | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *split[1:]]}}))
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.kinds = _classes()
        for i in range(0x3100):
            if _BLANK.fullmatch(chr(i)):
                self.kinds[i] = SPACE
            elif self.kinds[i] < VISIBLE or i == 0x130:  # the capital I with a dot falls into two characters
                self.kinds[i] = VISIBLE

    def _folded(self, codes: np.ndarray) -> np.ndarray:
        codes[(codes >= 65) & (codes <= 90)] += 32
        return codes

    def _pieces(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind = self.kinds[codes]
        a, b = kind[:-1], kind[1:]
        edge = codes == EDGE
        begins = edge.copy()
        begins[1:] |= ((a == SPACE) != (b == SPACE)) | ((a >= LETTER) & (b >= LETTER) & ((a != b) | (a == NUMBER))) | edge[:-1]
        starts = np.flatnonzero(begins)
        lengths = np.diff(np.append(starts, len(codes)))
        some = kind[starts] != SPACE
        return starts[some], lengths[some]

    def _learn(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        letters = np.minimum.reduceat(np.append(self.kinds[codes] == LETTER, True), np.stack((starts, starts + lengths), axis=1).ravel())[::2]
        parts, at, n, have = [], np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), 0
        for g, sep in ((np.flatnonzero(letters), np.array([32], "<u4")), (np.flatnonzero(~letters), self.mark)):
            if not len(g):
                continue
            k, ends = len(sep), np.cumsum(lengths[g] + len(sep))
            text = np.empty(ends[-1], "<u4")
            text[spread(ends - k, np.full(len(g), k))] = np.tile(sep, len(g))
            text[spread(ends - k - lengths[g], lengths[g])] = codes[spread(starts[g], lengths[g])]
            joined = text.tobytes().decode("utf-32-le")
            if k == 1:
                ids = np.array(self.words.encode_batch_fast([joined.lower()], add_special_tokens=False)[0].ids, "<u4")
                ends = np.flatnonzero(self.last[ids]) + 1
                first = np.concatenate(([0], ends[:-1]))
            else:
                ids = self._library(joined)
                ends = np.flatnonzero(ids == self.mark_id)
                first = np.concatenate(([0], ends[:-1] + 1))
            if len(ends) != len(g):
                raise RuntimeError("pieces and their tokens do not agree")
            at[g], n[g] = have + first, ends - first
            parts.append(ids)
            have += len(ids)
        return np.concatenate(parts), at, n
