"""SimHash near-duplicates: fingerprints of whole texts, and a binary-trie self-join that finds all close pairs.

Fingerprints link when they differ in `radius` bits or fewer. With radius r, two linked fingerprints agree in at least one
of r + 1 blocks of bits. So the trie is cut r + 1 times, each time with another block of bits as its top: below one value of
the block lies one sub-trie, and a task joins the sub-tries of a stretch of values, each with itself. The join walks pairs
of nodes downwards together, adds up the bits in which they differ, and drops a pair when the budget is exceeded. A sub-trie
gives links of a spanning forest only, never all pairs of a group; the components of these links are those of all links.

near_duplicates() links by one 64-bit fingerprint. similar_documents() finds texts by the similarity of their word shingles:
several shorter fingerprints, each with its own tries, propose a spanning forest, and an exact Jaccard similarity decides.
The forest leaves out pairs, so close_sets() then proposes every pair of unlinked texts that can reach the similarity.

Rules for input: null text is the empty text; texts without words have fingerprint zero and link like any other; repeated
rows and equal texts share a fingerprint; null ids are kept and get the component of their fingerprint; component_id is the
smallest non-null doc_id of the component; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import cut, delete, mix64, ready, shingle_hashes, word_hashes

_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
SEED = 42
#: Fingerprints that a task joins, about.
STRETCH = 20_000
#: Texts on a side of a cell that close_sets() compares at a time, rows of a task's group, pairs held at a time.
CELL, GROUP_ROWS, HELD = 300, 20_000, 1_000_000
#: Counters of shingle frequency, and rows that a task counts, about: so many that it fills most counters, of which it gives one row each.
COUNTERS_BITS, COUNTED = 20, 50_000
LEAF = 12  # node pairs with at most so many fingerprints on a side are compared outright


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64 bits; a bit is set if it is set in over half of the XXH64 hashes of the word shingles, repeats included."""
    # bytes.lower() changes A-Z only
    words = _WORDS.findall((text or "").encode("utf-8", "replace").lower())
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    h = np.fromiter((digest(view[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())), "<u8", len(words) - k + 1)
    return int(np.packbits(bit_votes(h) * 2 > len(h), bitorder="little").view("<u8")[0])


def bit_votes(h: np.ndarray) -> np.ndarray:
    """How many of the numbers have each of the 64 bits set, lowest bit first.

    Every eighth bit has a byte of a word to itself, in which up to 255 numbers add up at once.
    """
    out = np.zeros((8, 8), np.int64)
    lanes = np.uint64(0x0101010101010101)
    full = np.zeros(-(-len(h) // 255) * 255, np.uint64)
    full[: len(h)] = h
    for k in range(8):
        sums = ((full >> np.uint64(k)) & lanes).reshape(-1, 255).sum(axis=1, dtype=np.uint64)
        out[k] = sums.view(np.uint8).reshape(-1, 8).sum(axis=0)
    return out.T.ravel()


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = 3) -> Column:
    """A long column: the fingerprint as a signed number."""
    ready(docs.sparkSession)

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return run(F.coalesce(F.col(text_col), F.lit("")))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of n items' group, given links a-b: label passing with pointer jumping."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def trie_links(keys: np.ndarray, top: int, radius: int, bits: int = 64, most: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """Links among distinct, sorted keys of `bits` bits (left-aligned) that agree in their `top` highest bits.

    Nodes of the binary trie are ranges of the sorted keys. A frontier holds node pairs (x, y) with x <= y and the bits in
    which their prefixes differ; it starts with every sub-trie below the top paired with itself, and is worked off depth
    first in blocks, so that memory stays bounded. Gives a spanning forest, and each key's link to its first close key.
    """
    n = len(keys)
    root, first = np.arange(n), np.arange(n)
    head = keys >> np.uint64(64 - top) if top else np.zeros(n, np.uint64)
    edges = np.concatenate(([0], np.flatnonzero(head[1:] != head[:-1]) + 1, [n]))
    runs = np.stack((edges[:-1], edges[1:], edges[:-1], edges[1:], np.zeros(len(edges) - 1, np.int64)), 1)
    stack = [(top, runs[runs[:, 1] - runs[:, 0] > 1])]
    ones = {}
    while stack:
        depth, f = stack.pop()
        if len(f) > most:
            half = len(f) // 2
            stack += [(depth, f[:half]), (depth, f[half:])]
            continue
        small = ((f[:, 1] - f[:, 0] <= LEAF) & (f[:, 3] - f[:, 2] <= LEAF)) | (depth >= bits)
        if small.any():
            a, b = _close(keys, f[small], radius)
            if len(a):
                np.minimum.at(first, b, a)
                new = root[a] != root[b]
                if new.any():
                    root = _roots(n, np.concatenate((a[new], np.arange(n))), np.concatenate((b[new], root)))
        f = f[~small]
        if not len(f):
            continue
        if depth not in ones:
            ones[depth] = np.concatenate(([0], np.cumsum((keys >> np.uint64(63 - depth)) & np.uint64(1)))).astype(np.int64)
        up = ones[depth]
        mx = f[:, 1] - (up[f[:, 1]] - up[f[:, 0]])  # below a node the keys with a zero bit come first
        my = f[:, 3] - (up[f[:, 3]] - up[f[:, 2]])
        same = f[:, 0] == f[:, 2]
        kids = [
            np.stack((f[:, 0], mx, f[:, 2], my, f[:, 4]), 1),
            np.stack((mx, f[:, 1], my, f[:, 3], f[:, 4]), 1),
            np.stack((f[:, 0], mx, my, f[:, 3], f[:, 4] + 1), 1),
            np.stack((mx, f[:, 1], f[:, 2], my, f[:, 4] + 1), 1)[~same],
        ]
        f = np.concatenate(kids)
        f = f[(f[:, 4] <= radius) & (f[:, 1] > f[:, 0]) & (f[:, 3] > f[:, 2])]
        f = f[~((f[:, 0] == f[:, 2]) & (f[:, 1] - f[:, 0] == 1))]
        if len(f):
            stack.append((depth + 1, f))
    at = np.arange(n)
    return np.concatenate((at[root != at], at[first != at])), np.concatenate((root[root != at], first[first != at]))


def _close(keys: np.ndarray, f: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j within the node pairs f whose keys differ in at most radius bits."""
    i, j = _pairs(f)
    near = np.bitwise_count(keys[i] ^ keys[j]) <= radius
    return i[near], j[near]


def _pairs(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j with i in f[:, 0] : f[:, 1] and j in f[:, 2] : f[:, 3] of one row of f."""
    nx, ny = f[:, 1] - f[:, 0], f[:, 3] - f[:, 2]
    many = nx * ny
    of = np.repeat(np.arange(len(f)), many)
    k = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    i, j = f[of, 0] + k // ny[of], f[of, 2] + k % ny[of]
    keep = i < j
    return i[keep], j[keep]


def links(prints: DataFrame, n: int, radius: int, bits: int = 64) -> DataFrame:
    """(a, b): links among the nodes of (band, node, fp); n is about the number of nodes.

    Each band and block of bits is dealt out by the first bits of the block, into stretches of about STRETCH fingerprints.
    A stretch that holds many more, as close copies do, is dealt out further: its nodes go by hash into parts, and each two
    parts meet in one group.
    """
    blocks = radius + 1
    width = min(bits * (k + 1) // blocks - bits * k // blocks for k in range(blocks))
    cut_bits = min(width, max(0, math.ceil(math.log2(max(1, n) / STRETCH))))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["block"].iloc[0])
        lo, hi = bits * block // blocks, bits * (block + 1) // blocks
        x = pdf["fp"].to_numpy(np.int64).view(np.uint64)
        left = x << np.uint64(64 - bits)  # turned so that the block is on top
        keys = left << np.uint64(lo) | left >> np.uint64(bits - lo) if lo else left
        if bits < 64:
            keys &= ~np.uint64((1 << (64 - bits)) - 1)
        node = pdf["node"].to_numpy(np.int64)
        order = np.lexsort((node, keys))
        keys, node = keys[order], node[order]
        own, at, of = np.unique(keys, return_index=True, return_inverse=True)
        a, b = trie_links(own, hi - lo, radius, bits)
        twin = node != node[at][of]  # nodes with one fingerprint
        return pd.DataFrame({"a": np.concatenate((node[at][a], node[twin])), "b": np.concatenate((node[at][b], node[at][of][twin]))})

    def stretch(k: int) -> Column:
        return F.shiftrightunsigned(F.shiftleft(F.col("fp"), 64 - bits + bits * k // blocks), 64 - cut_bits) if cut_bits else F.lit(0).cast("long")

    tops = F.array(*[F.struct(F.lit(k).alias("block"), stretch(k).alias("stretch")) for k in range(blocks)])
    cells, cell = prints.select("band", "node", "fp", F.inline(tops)), ["band", "block", "stretch"]
    large = cells.groupBy(*cell).count().filter(F.col("count") > 2 * STRETCH).select(*cell, F.ceil(F.col("count") / STRETCH).cast("long").alias("parts"))
    large = cut(large, "simhash-large")
    if large.isEmpty():
        delete(large.sparkSession, large.cut_path)
        return cells.groupBy(*cell).applyInPandas(join, "a long, b long")
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    cells = cells.join(large, cell, "left").withColumn("own", F.pmod(F.xxhash64("node"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    cells = cells.select("node", "fp", *cell, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return cells.groupBy(*cell, "i", "j").applyInPandas(join, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id, n_members) for every row of docs."""
    marked = cut(docs.select(F.col(id_col).alias("doc_id"), fingerprints(docs, text_col, shingle).alias("fp")), "simhash-fp")
    # copies share a fingerprint: from here on there is one row for each
    prints = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")), "simhash-prints")
    found = links(prints.select(F.lit(0).alias("band"), F.col("fp").alias("node"), "fp"), prints.count(), radius)
    part = connected_components(found, "a", "b")  # (node, root)
    of = prints.join(part, prints["fp"] == part["node"], "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root"))
    low = of.groupBy("root").agg(F.min("low").alias("component_id"), F.sum("n").alias("n_members"))
    of = cut(of.select("fp", "root").join(low, "root").select("fp", "component_id", "n_members"), "simhash-of", (prints,))
    return marked.join(of, "fp").select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_members")


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text; fewer words are one shingle, none give none."""
    words = word_hashes(text)
    return np.unique(shingle_hashes(words, min(shingle, len(words)))) if len(words) else words


def band_prints(sets: list[np.ndarray], bands: int, bits: int, chunk: int = 1 << 15) -> np.ndarray:
    """For each set of shingle hashes, `bands` SimHash fingerprints of `bits` bits; every 64 bits come from another mixing.

    About `chunk` hashes are worked on at a time, of many sets together; bits are summed in byte lanes, 255 hashes at a time.
    """
    mixes = -(-bands * bits // 64)
    out = np.zeros((len(sets), bands), np.uint64)
    lanes = np.uint64(0x0101010101010101)
    weights = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    full = [i for i, h in enumerate(sets) if len(h)]
    edges = np.concatenate(([0], np.cumsum([len(sets[i]) for i in full])))
    for own in np.split(np.arange(len(full)), np.flatnonzero(np.diff(edges[:-1] // chunk)) + 1) if full else []:
        h, sizes = np.concatenate([sets[full[i]] for i in own]), np.diff(edges)[own]
        pieces = -(-sizes // 255)
        first = np.cumsum(pieces) - pieces
        starts = np.repeat(np.cumsum(sizes) - sizes, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
        votes = np.empty((len(own), mixes, 8, 8), np.int64)  # text, mixing, byte, bit
        for i in range(mixes):
            m = mix64(h + np.uint64(0x9E3779B97F4A7C15 * (i + 1) % (1 << 64)))
            for k in range(8):
                sums = np.add.reduceat((m >> np.uint64(k)) & lanes, starts)
                votes[:, i, :, k] = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8), first, axis=0, dtype=np.int64)
        on = (votes.reshape(len(own), -1) * 2 > sizes[:, None])[:, : bands * bits].reshape(len(own), bands, bits)
        out[np.array(full)[own]] = on @ weights
    return out


def counters_of(h: np.ndarray) -> np.ndarray:
    """The counters of shingle hashes: their first bits."""
    return (h >> np.uint64(64 - COUNTERS_BITS)).astype(np.int64)


def counter_ranks(texts: DataFrame, n: int, shingle: int) -> bytes:
    """The rank of each counter, by how many shingles it counts in the sets of all rows of (text), then by number; n is about the number of rows."""

    def count(batches):
        full = np.zeros(1 << COUNTERS_BITS, np.int64)
        for pdf in batches:
            for t in pdf["text"]:
                np.add.at(full, counters_of(shingle_set(t, shingle)), 1)
        for k in np.array_split(np.flatnonzero(full), 16):
            yield pd.DataFrame({"k": k, "n": full[k]})

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        full, ranks = np.zeros(1 << COUNTERS_BITS, np.int64), np.zeros(1 << COUNTERS_BITS, "<u4")
        full[pdf["k"].to_numpy(np.int64)] = pdf["n"].to_numpy(np.int64)
        ranks[np.argsort(full, kind="stable")] = np.arange(len(full))
        return pd.DataFrame({"ranks": [ranks.tobytes()]})

    tasks = max(texts.sparkSession.sparkContext.defaultParallelism, math.ceil(n / COUNTED))
    counted = texts.coalesce(tasks).mapInPandas(count, "k int, n long").groupBy("k").agg(F.sum("n").alias("n"))
    packed = counted.groupBy().applyInPandas(pack, "ranks binary").collect()  # one row for each counter, however many texts
    return bytes(packed[0]["ranks"]) if packed else bytes(4 << COUNTERS_BITS)


def rare_first(h: np.ndarray, ranks: np.ndarray, similarity: float) -> np.ndarray:
    """The prefix of a set in the order of (rank of the counter, hash): two sets of that similarity have a hash of their prefixes in common."""
    order = np.lexsort((h, ranks[counters_of(h)]))
    return h[order[: len(h) - math.ceil(similarity * len(h) - 1e-9) + 1]] if len(h) else np.zeros(1, np.uint64)


def close_sets(sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs of nodes in different parts whose sets can reach the similarity; none that reaches it is left out.

    sets: (node, part, n, s), n being the size of a set and s its prefix. In the cell of the first hash that two prefixes
    share, what comes after it bounds their overlap. Cells within one part make no pairs; large cells are cut into blocks,
    and each two blocks meet in one place.
    """
    rows = sets.select("node", "part", "n", F.posexplode("s").alias("pos", "s")).select("node", "part", "n", "s", (F.col("n") - F.col("pos") - 1).alias("left"))
    hot = rows.groupBy("s").agg(F.count(F.lit(1)).alias("m"), F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo != hi")
    hot = cut(hot.select("s", F.ceil(F.col("m") / CELL).cast("long").alias("blocks"), "m"), "similar-hot")
    groups = max(1, math.ceil((hot.agg(F.sum(F.col("m") * F.col("blocks"))).first()[0] or 0) / GROUP_ROWS))
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    cells = rows.join(hot, "s").distinct().withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = cells.select("s", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "part", "n", "left")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["s", "i", "j", "side"])
        s, i, j, side, node, part, n, left = (pdf[c].to_numpy(np.int64) for c in ("s", "i", "j", "side", "node", "part", "n", "left"))
        new = (s[1:] != s[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        start = np.concatenate(([0], np.flatnonzero(new) + 1)) if len(s) else np.zeros(0, np.int64)
        end = np.append(start[1:], len(s))[: len(start)]
        before = np.concatenate(([0], np.cumsum(side)))
        middle = end - (before[end] - before[start])
        alone = i[start] == j[start]
        f = np.stack((start, middle, np.where(alone, start, middle), end), 1)
        step = np.cumsum((f[:, 1] - f[:, 0]) * (f[:, 3] - f[:, 2])) // HELD
        got = np.zeros((0, 2), np.int64)
        for part_of in np.split(f, np.flatnonzero(np.diff(step)) + 1) if len(f) else []:
            x, y = _pairs(part_of)
            can = (part[x] != part[y]) & ((1 + np.minimum(left[x], left[y])) * (1 + similarity) >= similarity * (n[x] + n[y]) - 1e-9)
            x, y = node[x[can]], node[y[can]]
            got = np.unique(np.concatenate((got, np.stack((np.maximum(x, y), np.minimum(x, y)), 1))), axis=0)
        return pd.DataFrame({"a": got[:, 0], "b": got[:, 1]})

    return cells.groupBy(F.pmod(F.xxhash64("s", "i", "j"), F.lit(groups))).applyInPandas(meet, "a long, b long").distinct()


def similar_documents(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, bands: int = 16, bits: int = 40, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sha, component_id, root) for every row, sha being of its text: documents linked by a Jaccard similarity of their shingle sets of `similarity` or more.

    The fingerprints' tries give a spanning forest of close texts, whose links are checked on whole texts; that settles most
    copies. Texts that are still apart meet in close_sets(), which misses no pair, and are checked likewise: so no link
    depends on chance, on the forest or on a group's size. Rows with equal texts are one node, numbered in a written
    table; component_id is the smallest id of the component, or a hash of its texts if all ids are null. Components of unlike texts that
    share an id can have the same component_id, but never the same root.
    """
    spark = docs.sparkSession
    ready(spark)

    @F.pandas_udf("array<long>")
    def mark(texts: pd.Series) -> pd.Series:
        return pd.Series(list(band_prints([shingle_set(t, shingle) for t in texts], bands, bits).view(np.int64)))

    @F.pandas_udf("array<long>")
    def shingles(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, shingle).view(np.int64) for t in texts])

    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(text, 256).alias("sha"), mark(text).alias("prints")), "similar-prints")
    nodes = marked.groupBy("sha").agg(F.min("doc_id").alias("low"), F.first("prints").alias("prints"))
    # a node's number is its place in the written table: no two texts share one, however many there are
    nodes = cut(nodes.select("sha", F.monotonically_increasing_id().alias("node"), "low", "prints"), "similar-nodes")
    cells = nodes.select("node", F.posexplode("prints").alias("band", "fp"))
    pairs = links(cells.select("band", "node", "fp"), nodes.count(), radius, bits).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    keyed = docs.select(F.sha2(text, 256).alias("sha"), text.alias("text"))

    def check(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs, "similar-pairs")
        # shingle sets of the texts that stand in a pair, one text for each node
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes.select("node", "sha"), "node")
        sets = cut(keyed.join(wanted, "sha").groupBy("node").agg(F.min("text").alias("text")).select("node", shingles(F.col("text")).alias("s")), "similar-sets")
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
        shared = F.size(F.array_intersect("sa", "sb"))
        union = F.size("sa") + F.size("sb") - shared
        return both.filter((union == 0) | (shared >= F.lit(similarity) * union)).select("a", "b")

    part = connected_components(check(pairs), "a", "b")
    of = cut(nodes.join(part, "node", "left").select("sha", "node", "low", F.coalesce("root", "node").alias("part")), "similar-parts")

    sent = spark.sparkContext.broadcast(counter_ranks(docs.select(text.alias("text")), marked.count(), shingle))

    @F.pandas_udf("struct<n:int,s:array<long>>")
    def prefix(texts: pd.Series) -> pd.DataFrame:
        ranks = np.frombuffer(sent.value, "<u4")
        sets = [shingle_set(t, shingle) for t in texts]
        return pd.DataFrame({"n": [len(h) for h in sets], "s": [rare_first(h, ranks, similarity).view(np.int64) for h in sets]})

    sets = keyed.select("sha", prefix("text").alias("p")).join(of, "sha").select("node", "part", "p.n", "p.s")
    more = check(close_sets(cut(sets, "similar-prefixes"), similarity))
    name = of.select("node", "part")
    more = more.join(name.toDF("a", "pa"), "a").join(name.toDF("b", "pb"), "b").select("pa", "pb")
    whole = connected_components(more, "pa", "pb").select(F.col("node").alias("part"), "root")
    of = cut(of.join(whole, "part", "left").select("sha", "low", F.coalesce("root", "part").alias("root")), "similar-roots")
    low = of.groupBy("root").agg(F.coalesce(F.min("low"), F.xxhash64(F.min("sha"))).alias("component_id"))
    of = of.select("sha", "root").join(low, "root")
    return marked.join(of, "sha").select(F.col("doc_id").alias(id_col), "sha", "component_id", "root")
