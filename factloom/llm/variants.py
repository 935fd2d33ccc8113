"""Spelling variants: words one insertion, deletion or replacement apart, found in a trie over letter counts.

A word is placed by the counts of its letters, one group of letters after the other: first those of a few large groups that
split the alphabet, which give the cell that a task works on, then those of single letters. One changed letter adds at most one
to one count (a surplus) and takes at most one from another (a deficit). So two tries are walked together depth first, node
against node; a child whose count differs spends from a budget of one surplus and one deficit, and a pair of nodes that has
overspent is left with all that lies below it. Words that reach leaves together are then compared letter by letter.

A cell is compared with itself and with the cells that are in reach of the budget, each pair of cells in one place. How many
large groups there are goes by the number of words in the fullest cell; a cell that stays too full after that is dealt out in
pairs of parts, so no task's memory grows with the input.

Rules for input: a null text has no words; a null id is the empty text where it is hashed; texts and words of any length are
read whole; repeated rows count as often as they stand there; an empty table gives an empty one; other columns don't matter.
"""

from __future__ import annotations

import math
import string

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, ready

#: Words of a cell that are compared at once, about; words that a task takes; pairs of nodes that a step of the walk expands.
CELL, TASK, STEP = 30_000, 100_000, 200_000
#: What a row is to a unit: a word of the unit's cell, such a word once more to be met by the others, a word of another cell.
HOME, OWN, OTHER = range(3)
#: How many large groups the alphabet is split into: the first of these numbers that keeps cells small enough.
SPLITS = (3, 4, 6, 8)
#: Letters, frequent ones first, and how many groups the others (U+00C0 to U+00FF) fall into by code point.
LETTERS, OTHERS = "etaoinsrhldcumfpgwybvkxjqz", 6
#: Letters of words that are compared as arrays; longer words one by one.
WIDE = 48


def words(docs: DataFrame, least_letters: int = 7, least_rows: int = 2, noise: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): runs of Latin letters with A-Z lowered, of every document, that are long and frequent enough.

    A run whose crc32, with its document's id before it, `noise` divides, loses one letter: spelling errors to be found.
    """
    run = F.explode(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(f"[A-Za-zÀ-ÿ]{{{least_letters},}}"), F.lit(0)))
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("d"), run.alias("r"))
    runs = runs.withColumn("r", F.translate("r", string.ascii_uppercase, string.ascii_lowercase)).withColumn("h", F.crc32(F.concat("d", F.lit(":"), "r")))
    at = (F.col("h") % F.length("r")).cast("int")
    shorter = F.concat(F.substring("r", F.lit(1), at), F.substring("r", at + 2, F.length("r")))
    found = runs.select(F.when(F.col("h") % noise == 0, shorter).otherwise(F.col("r")).alias("word"))
    return found.filter(F.length("word") >= least_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_rows)


def large_groups(k: int) -> list[str]:
    """The alphabet in k groups of about equal weight: frequent letters are dealt out to and fro."""
    others = [chr(c) for c in range(0xC0, 0x100)]
    groups = [""] * k
    for i, c in enumerate([*LETTERS, *others]):
        at = i % (2 * k)
        groups[min(at, 2 * k - 1 - at)] += c
    return groups


def cell_of(word: Column, k: int) -> Column:
    """The counts of k large groups, as text."""
    return F.concat_ws(".", *[(F.length(word) - F.length(F.translate(word, g, ""))).cast("string") for g in large_groups(k)])


def _targets(cells: pd.DataFrame) -> pd.DataFrame:
    """(cell, target): each cell in reach that does not come after it, itself included."""
    out_cell, out_target = [], []
    for cell in cells["cell"]:
        c = list(map(int, cell.split(".")))
        for up in (None, *range(len(c))):
            for down in (None, *range(len(c))):
                if up is not None and up == down:
                    continue
                t = c.copy()
                if up is not None:
                    t[up] += 1
                if down is not None:
                    t[down] -= 1
                if t <= c and min(t) >= 0:
                    out_cell.append(cell)
                    out_target.append(".".join(map(str, t)))
    return pd.DataFrame({"cell": out_cell, "target": out_target})


def near_words(found: DataFrame, cell_words: int = CELL) -> DataFrame:
    """(word, n, n_near, best, best_n): of each word that has near words, how many, and the most frequent (the first of ties).

    `found` is a written table of distinct words with their n.
    """
    spark = found.sparkSession
    ready(spark)
    for k in SPLITS:
        sizes = cut(found.groupBy(cell_of(F.col("word"), k).alias("cell")).agg(F.count(F.lit(1)).alias("size")), "variants-cells")
        most = sizes.agg(F.max("size")).first()[0] or 0
        if most <= cell_words:
            break
    reach = sizes.select("cell").mapInPandas(lambda batches: map(_targets, batches), "cell string, target string")
    reach = reach.join(sizes.select(F.col("cell").alias("target"), F.col("size").alias("home")), "target").join(sizes, "cell")
    parts = reach.groupBy("target").agg(F.ceil(F.first("home") / cell_words).alias("p"), F.ceil(F.sum("size") / (8 * cell_words)).alias("q"))
    reach = cut(reach.join(parts, "target").select("cell", "target", "p", "q"), "variants-reach")

    placed = found.select("word", "n", cell_of(F.col("word"), k).alias("cell"), F.xxhash64("word").alias("h")).join(reach, "cell")
    # a word is at home in one part of its own cell, and a guest of all home parts there and in the other cells in reach
    guest = placed.select("word", "n", "target", F.when(F.col("cell") == F.col("target"), OWN).otherwise(OTHER).alias("role"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("p") - 1)).alias("i"), F.pmod("h", "q").alias("j"))
    home = placed.filter("cell = target").select("word", "n", "target", F.lit(HOME).alias("role"), F.pmod("h", "p").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("q") - 1)).alias("j"))
    rows = guest.unionByName(home).withColumn("unit", F.concat_ws("/", "target", "i", "j"))
    total = reach.join(sizes, "cell").agg(F.sum(F.col("size") * (F.col("p") + F.when(F.col("cell") == F.col("target"), F.col("q")).otherwise(0)))).first()[0] or 0
    tasks = max(1, math.ceil(total / TASK))
    dealt = rows.select("word", "n", "role", "unit", F.pmod(F.xxhash64("unit"), F.lit(tasks)).alias("task"))
    part = dealt.groupBy("task").applyInPandas(compare, "word string, n long, n_near long, best string, best_n long")
    first = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("b")
    return part.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), first).select("word", "n", "n_near", F.col("b.word").alias("best"), (-F.col("b.n")).alias("best_n"))


def with_forms(found: DataFrame, near: DataFrame, times: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word.

    A word's form is its most frequent near word, if that is `times` as frequent. Forms grow in frequency, so following them
    ends; each round follows twice as many steps as the one before.
    """
    near = cut(near, "variants-near")
    links = cut(near.filter(F.col("best_n") >= F.col("n") * times).select("word", F.col("best").alias("to")), "variants-links")
    while True:
        further = links.select(F.col("word").alias("to"), F.col("to").alias("last"))
        step = cut(links.join(further, "to", "left").select("word", F.coalesce("last", "to").alias("to"), F.col("last").isNotNull().alias("moved")), "variants-links", (links,))
        links = step.select("word", "to")
        links.cut_path = step.cut_path
        if step.filter("moved").isEmpty():
            break
    form = F.col("best_n") >= F.col("n") * times
    known = near.join(links, "word", "left").select("word", F.when(form, F.col("best")).alias("form"), F.col("to").alias("root"), "n_near", F.when(form, F.col("best_n")).alias("form_n"))
    out = found.join(known, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def spelling_variants(docs: DataFrame, **options) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of docs."""
    found = cut(words(docs, **options), "variants-words")
    return with_forms(found, near_words(found))


class Trie:
    """Rows in order of their unit and letter counts. Level 0 has a node for each unit; a node is a range of rows."""

    def __init__(self, rows: np.ndarray, unit: np.ndarray, counts: np.ndarray):
        order = np.lexsort((*counts[rows].T[::-1], unit[rows]))
        self.rows = rows[order]
        unit, counts = unit[self.rows], counts[self.rows]
        changed = np.diff(unit, prepend=-1) != 0
        #: By level: where nodes begin (with the end), what each stands for, where its children begin (with the end).
        self.begin, self.value, self.child = [], [], []
        for level in range(counts.shape[1] + 1):
            if level:
                changed[1:] |= np.diff(counts[:, level - 1]) != 0
            at = np.flatnonzero(changed)
            if level:
                self.child.append(np.append(np.searchsorted(at, self.begin[-1][:-1]), len(at)).astype(np.int32))
            self.begin.append(np.append(at, len(rows)).astype(np.int32))
            self.value.append(counts[at, level - 1] if level else unit[at])


def crossed(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which, x, y): for each k, every a[k] + 0..n[k]-1 with every b[k] + 0..m[k]-1."""
    each = n * m
    which = np.repeat(np.arange(len(a)), each)
    i = np.arange(len(which)) - np.repeat(np.cumsum(each) - each, each)
    return which, a[which] + i // m[which], b[which] + i % m[which]


def walk(home: Trie, guest: Trie, counts: np.ndarray):
    """Pairs of rows (home, guest) whose letter counts differ by one surplus and one deficit at most, some at a time."""
    _, x, y = np.intersect1d(home.value[0], guest.value[0], return_indices=True)
    levels = counts.shape[1]
    stack = [(0, x, y, np.ones(len(x), np.int8), np.ones(len(x), np.int8))]
    while stack:
        level, x, y, up, down = stack.pop()
        if not len(x):
            continue
        if len(x) > 1:
            # as many pairs at once as have few children between them
            (a, b) = (home.child, guest.child) if level < levels else (home.begin, guest.begin)
            n, m = (c[level][z + 1].astype(np.int64) - c[level][z] for c, z in ((a, x), (b, y)))
            end = int(np.searchsorted(np.cumsum(n * m), STEP)) or 1
            if end < len(x):
                stack.append((level, x[end:], y[end:], up[end:], down[end:]))
                x, y, up, down = x[:end], y[:end], up[:end], down[:end]
        a, b = home.begin[level], guest.begin[level]
        n, m = a[x + 1].astype(np.int64) - a[x], b[y + 1].astype(np.int64) - b[y]
        leaf = (n == 1) & (m == 1) if level < levels else np.ones(len(x), bool)
        if leaf.any():
            # one word on both sides: the rest of the counts at once; at the last level, all words of the leaves
            yield from leaves(home, guest, a[x[leaf]], n[leaf], b[y[leaf]], m[leaf], counts)
            x, y, up, down = x[~leaf], y[~leaf], up[~leaf], down[~leaf]
        if level == levels or not len(x):
            continue
        a, b = home.child[level], guest.child[level]
        which, i, j = crossed(a[x], a[x + 1] - a[x], b[y], b[y + 1] - b[y])
        more = guest.value[level + 1][j].astype(np.int64) - home.value[level + 1][i]
        up, down = up[which] - np.maximum(more, 0), down[which] - np.maximum(-more, 0)
        stay = (up >= 0) & (down >= 0)
        stack.append((level + 1, i[stay], j[stay], up[stay].astype(np.int8), down[stay].astype(np.int8)))


def leaves(home: Trie, guest: Trie, a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray, counts: np.ndarray):
    """Pairs of rows of leaves within the budget, about STEP pairs at a time; large leaves go by parts of their home rows."""
    part = np.maximum(1, STEP // m)
    times = -(-n // part)
    k = np.repeat(np.arange(len(a)), times)
    done = (np.arange(len(k)) - np.repeat(np.cumsum(times) - times, times)) * part[k]
    a, n, b, m = a[k] + done, np.minimum(part[k], n[k] - done), b[k], m[k]
    blocks = np.cumsum(n * m) // STEP
    for x in np.split(np.arange(len(a)), np.flatnonzero(np.diff(blocks)) + 1):
        _, i, j = crossed(a[x], n[x], b[x], m[x])
        i, j = home.rows[i], guest.rows[j]
        more = counts[j] - counts[i]
        up, down = np.maximum(more, 0).sum(axis=1), -np.minimum(more, 0).sum(axis=1)
        # with equal counts a letter can only have given way to another of its group, and most groups are one letter
        stay = (up <= 1) & (down <= 1) & ((up + down > 0) | (counts[i, len(LETTERS) :] > 0).any(axis=1))
        yield i[stay], j[stay]


def one_apart(a: str, b: str) -> bool:
    """Whether two unlike words differ by one inserted, deleted or replaced letter."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    at = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def _near(i: np.ndarray, j: np.ndarray, letters: np.ndarray, length: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which pairs of words are one letter apart. letters: a row for each word, zeros behind it; long words are in `held`."""
    swap = length[i] > length[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    ok = np.zeros(len(i), bool)
    long = (length[i] > WIDE) | (length[j] > WIDE)
    for k in np.flatnonzero(long):
        ok[k] = one_apart(held[i[k]], held[j[k]])
    by = length[j] - length[i]
    same = np.flatnonzero((by == 0) & ~long)
    ok[same] = (letters[i[same]] != letters[j[same]]).sum(axis=1) == 1
    more = np.flatnonzero((by == 1) & ~long)
    a, b = letters[i[more]], letters[j[more]]
    first = (a != b).argmax(axis=1)  # unlike lengths, so there is one
    ok[more] = ((a[:, :-1] == b[:, 1:]) | (np.arange(a.shape[1] - 1) < first[:, None])).all(axis=1)
    return ok


def letter_counts(held: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts by letter group, letters of words up to WIDE, lengths) of words."""
    length = np.fromiter(map(len, held), np.int64, len(held))
    codes = np.frombuffer("".join(held).encode("utf-32-le"), "<u4").astype(np.int64)
    owner = np.repeat(np.arange(len(held)), length)
    group = np.zeros(256, np.int64)
    group[0xC0:] = len(LETTERS) + np.arange(64) % OTHERS
    group[[ord(c) for c in LETTERS]] = np.arange(len(LETTERS))
    levels = len(LETTERS) + OTHERS
    counts = np.bincount(owner * levels + group[codes], minlength=len(held) * levels).reshape(-1, levels)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(length) - length, length)
    letters = np.zeros((len(held), WIDE + 1), np.uint8)
    fits = place < WIDE
    letters[owner[fits], place[fits]] = codes[fits]
    small = counts.max(initial=0) < 127
    return counts.astype(np.int8 if small else np.int64), letters, length


def compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """Near words among the rows of a task: home rows of each unit against its guests."""
    held, word = np.unique(pdf["word"].to_numpy(dtype=object), return_inverse=True)  # in the order of code points
    n = np.zeros(len(held), np.int64)
    n[word] = pdf["n"]
    _, unit = np.unique(pdf["unit"].to_numpy(dtype=object), return_inverse=True)
    role = pdf["role"].to_numpy()
    counts, letters, length = letter_counts(held.tolist())
    counts = counts[word]
    to, near = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    home, guest = (np.flatnonzero(x) for x in (role == HOME, role != HOME))
    if len(home) and len(guest):
        for i, j in walk(Trie(home, unit, counts), Trie(guest, unit, counts), counts):
            a, b = word[i], word[j]
            ok = np.flatnonzero(a != b)
            ok = ok[_near(a[ok], b[ok], letters, length, held)]
            # guests of the home words' own cell are at home with those words in turn
            both = ok[role[j[ok]] == OTHER]
            to += a[ok], b[both]
            near += b[ok], a[both]
    to, near = np.concatenate(to), np.concatenate(near)
    order = np.lexsort((near, -n[near], to))
    to, near = to[order], near[order]
    first = np.flatnonzero(np.diff(to, prepend=-1))
    w, b = to[first], near[first]
    return pd.DataFrame({"word": held[w], "n": n[w], "n_near": np.diff(np.append(first, len(to))), "best": held[b], "best_n": n[b]})
