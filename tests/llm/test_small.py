"""Edge cases and brute-force versions of the training-data operators on small tables."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import public_tokenizers
from factloom.llm import bpe, chat, clusters, components, decontaminate, langid, lines, media, packing, piece_encoder, quality, shared, sharding, simhash, token_files, variants
from tokenizers import Tokenizer

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos int, fp string, th long"


def docs(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 7, "x", 1) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "Été", "straße", "日本", "<|endoftext|>", "it's", "12", "</s>"]
    rows = [(1, None, "a"), (2, "", "b"), (3, "   \n\t ", None), (None, "no id here at all", "a"), (5, "same text twice over", "a"), (5, "same text twice over", "a"), (6, "same text twice over", "b"), (7, " ".join(rng.choice(words) for _ in range(20_000)), "c")]
    return docs(spark, rows + [(10 + i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60))), "abc"[i % 3]) for i in range(60)])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_bpe_matches_the_library(path):
    own, lib, rng = bpe.Bpe(open(path, "rb").read()), Tokenizer.from_file(path), random.Random(1)
    parts = ["a", "b", " ", "  ", "<|endoftext|>", "<", "|", "é", "́", "the", "in", "rat", "'s", "'LL", "\n", "\t", "\xa0", " 1", "2.", "!!", "日", "ß", "Σ", "İ", "\x1c", "​", "😀"]
    for _ in range(1500):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        want = lib.encode(s, add_special_tokens=False).ids
        assert own.encode(s).tolist() == want
        assert own.decode(own.encode(s)) == lib.decode(want, skip_special_tokens=False)


def test_bpe_documents(spark, odd, none):
    lib = Tokenizer.from_file(WORD)
    got = sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in bpe.encode_documents(odd, WORD).collect()), key=repr)
    want = []
    for i, t in texts_of(odd):
        ids = lib.encode(t, add_special_tokens=False).ids
        want.append((i, bytearray(np.array(ids, "<u4").tobytes()), lib.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=repr)
    assert bpe.encode_documents(none, WORD).count() == 0


@pytest.mark.parametrize("kept", [(2_000_000, 12_000_000), (300, 12_000_000), (2_000_000, 10)])
def test_batch_encoder(kept):
    enc, rng = token_files.BatchEncoder(open(BYTE, "rb").read()), random.Random(2)
    enc.PIECES, enc.IDS = kept
    parts = ["a", "b", " ", "  ", "<|endoftext|>", "é", "the", "in", "'s", "'", "'re", "\n", "\n\n", "\t", "\xa0", "\xad", "\x1c", "\x00", " 1", "²", ".", ',"', "(", "日", " 日本", "ـ", "\u0301", "\u200b", "\u3000", "😀", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    texts[7] = " ".join(rng.choice(["some", "words,", "again\nand"]) for _ in range(100_000))
    got = [ids for k in range(0, 4000, 500) for ids in enc.encode_all(texts[k : k + 500])]
    for s, ids in zip(texts, got):
        assert ids.tolist() == enc.whole.encode(s, add_special_tokens=False).ids, s
    assert len(enc.keys) == len(enc.at) == len(enc.n) and enc.encode_all([]) == []


@pytest.mark.parametrize("bits", [False, True])
def test_token_files(spark, odd, none, bits, monkeypatch):
    lib = Tokenizer.from_file(BYTE)
    got = sorted(map(tuple, token_files.read_token_files(token_files.write_token_files(odd, BYTE, bits=bits)).collect()), key=lambda r: r[1])
    want, at = [], 0
    for i, t in sorted(texts_of(odd), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*lib.encode(t, add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert token_files.read_token_files(token_files.write_token_files(none, BYTE)).count() == 0


def test_planes_round_trip():
    rng = np.random.default_rng(3)
    for dtype in ("<u2", "<u4"):
        for n in (1, 7, 8, 1000):
            x = rng.integers(0, 60_000, n).astype(dtype)
            for bits in (False, True):
                assert (token_files.from_planes(token_files.to_planes(x, bits), n, np.dtype(dtype), bits) == x).all()


def test_media(spark, odd, none):
    rows = media.media_table(odd).collect()
    want = {}
    for i, t in texts_of(odd):
        raw = t.encode()
        want.setdefault(i, []).append((len(raw), raw + b" " * (-len(raw) % 192 if raw else 192)))
    for r in rows:
        assert (r["n_bytes"], bytes(r["payload"])) in want[r["doc_id"]]
    same = {(bytes(r["media"]), bytes(r["phash"])) for r in rows if r["doc_id"] in (5, 6)}
    assert len(same) == 1 and len(rows) == odd.count()
    assert media.media_table(none).count() == 0


def test_png_filters_and_damage():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 256, (5, 12), dtype=np.uint8)
    up = np.vstack((np.zeros((1, 12), np.uint8), x[:-1])).astype(int)
    left = np.hstack((np.zeros((5, 3), int), x[:, :-3].astype(int)))
    corner = np.hstack((np.zeros((5, 3), int), up[:, :-3]))
    p = left + up - corner
    da, db, dc = abs(p - left), abs(p - up), abs(p - corner)
    paeth = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, up, corner))
    for kind, guess in enumerate((0, left, up, (left + up) // 2, paeth)):
        lines_ = np.hstack((np.full((5, 1), kind, np.uint8), (x.astype(int) - guess).astype(np.uint8)))
        assert (media.unfilter(lines_, 3) == x).all()
    png = media.write_png(media.pad(b"some text " * 50))
    assert media.read_png(png).tobytes() == media.pad(b"some text " * 50)
    for at in (3, 20, len(png) // 2, len(png) - 5):
        with pytest.raises(ValueError):
            media.read_png(png[:at] + bytes([png[at] ^ 1]) + png[at + 1 :])


def groups_of(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(6)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    want = groups_of(pairs, {x for p in pairs for x in p})
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {n: r for n, r in want.items() if n in linked}


def slow_print(t):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    k = min(3, len(w))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(len(w) - k + 1)] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, odd, none):
    base = " ".join(f"word{i}" for i in range(3000))
    more = docs(spark, [(100, base, "a"), (101, base.replace("word5 ", "other "), "a"), (102, base.replace("word9 ", "Other "), "b")])
    both = odd.unionByName(more)
    prints = [(i, slow_print(t)) for i, t in texts_of(both)]
    pairs = [(i, j) for i, (_, x) in enumerate(prints) for j, (_, y) in enumerate(prints) if i < j and bin(x ^ y).count("1") <= 2]
    root = groups_of(pairs, range(len(prints)))
    low = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            low[root[i]] = min(d, low.get(root[i], d))
    want = sorted(((d, f"{x:016x}", low.get(root[i])) for i, (d, x) in enumerate(prints)), key=repr)
    got = sorted((tuple(r)[:3] for r in simhash.near_duplicates(both).collect()), key=repr)
    assert got == want
    assert simhash.near_duplicates(none).count() == 0


def test_trie_join_finds_all_links():
    rng = np.random.default_rng(7)
    for bits, radius in ((64, 2), (40, 3)):
        base = rng.integers(0, 1 << bits, 6, dtype=np.uint64)
        keys = {int(x) ^ sum({1 << int(b) for b in rng.integers(0, bits, rng.integers(0, 6))}) for x in base for _ in range(70)}
        keys = np.sort(np.array(list(keys), np.uint64) << np.uint64(64 - bits))
        near = np.bitwise_count(keys[:, None] ^ keys[None, :]) <= radius
        want = groups_of([(i, j) for i, j in zip(*np.nonzero(near)) if i < j], range(len(keys)))
        a, b = simhash.trie_links(keys, 0, radius, bits)
        assert groups_of(list(zip(a.tolist(), b.tolist())), range(len(keys))) == want


def test_similar_documents(spark, odd, none):
    words = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(words), "a"), (2, " ".join(words[:190]), "a"), (3, " ".join(words[:120]), "b"), (4, " ".join(words), "c"), (5, None, "a"), (6, "", "b"), (7, "two words", "a")]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5, 6: 5, 7: 7}
    assert simhash.similar_documents(none).count() == 0


def test_similar_documents_in_a_family_of_half_similar_texts(spark):
    """Copies of one original, each edited too far to be linked with it, and for each a close copy of its own."""
    rng = random.Random(12)
    base, rows, want = [f"w{i}" for i in range(200)], [], {}
    for i in range(1200):
        own = list(base)
        for at in rng.sample(range(200), 6):
            own[at] = f"e{i}x{at}"
        near = list(own)
        near[rng.randrange(200)] = f"n{i}"
        near[rng.randrange(200)] = f"m{i}"
        rows += [(2 * i, " ".join(own), "a"), (2 * i + 1, " ".join(near), "a")]
    rows.append((9999, " ".join(base), "a"))
    cut_of = {i: {tuple(t.split()[k : k + 5]) for k in range(196)} for i, t, _ in rows}
    by = {}
    for i, s in cut_of.items():
        for x in s:
            by.setdefault(x, []).append(i)
    ids, full = sorted(cut_of), np.zeros((len(cut_of), len(by)), np.float32)
    for k, x in enumerate(by):
        full[np.searchsorted(ids, by[x]), k] = 1
    shared, size = full @ full.T, full.sum(axis=1)
    i, j = np.nonzero(np.triu(shared * 10 >= 8 * (size[:, None] + size[None, :] - shared), 1))
    want = groups_of([(ids[a], ids[b]) for a, b in zip(i, j)], ids)
    assert len(set(want.values())) > 500
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs(spark, rows)).collect()}
    assert got == want


def prefixes(spark, df, monkeypatch):
    """Sizes and prefixes of the sets that similar_documents() hands to the exact search."""
    seen, own = [], simhash.close_sets
    monkeypatch.setattr(simhash, "close_sets", lambda sets, similarity: seen.extend((r["n"], frozenset(x % (1 << 64) for x in r["s"])) for r in sets.collect()) or own(sets, similarity))
    simhash.similar_documents(df)
    return seen


def test_shingles_are_ordered_by_their_counts_in_all_documents(spark, monkeypatch):
    monkeypatch.setattr(simhash, "COUNTED", 10)
    rng = random.Random(31)
    rows = [(i, " ".join(rng.choice("aaabbc") for _ in range(rng.randint(1, 60))), "x") for i in range(400)] + [(400, None, "x")]
    sets = [simhash.shingle_set(t, 5).tolist() for _, t, _ in rows]
    counts = Counter(x >> 44 for s in sets for x in s)
    want = [(len(s), frozenset(sorted(s, key=lambda x: (counts[x >> 44], x))[: len(s) + 1 - -(-8 * len(s) // 10)] or [0])) for s in sets]
    assert Counter(prefixes(spark, docs(spark, rows), monkeypatch)) == Counter(want)


def test_shingles_found_very_often_are_counted_to_the_end(spark, monkeypatch):
    for last in range(100):
        words = f"v1 v2 v3 v4 v5 w{last}".split()
        less, more = (int(simhash.shingle_set(" ".join(w), 5)[0]) for w in (words[:5], words[1:]))
        if less >> 44 > more >> 44:  # by their hashes alone the other would come first
            break
    text = F.when(F.col("doc_id") == 0, " ".join(words)).when(F.col("doc_id") <= 66_000, " ".join(words[:5])).otherwise(" ".join(words[1:]))
    got = prefixes(spark, spark.range(136_001).select(F.col("id").alias("doc_id")).withColumn("text", text), monkeypatch)
    assert [s for n, s in got if n == 2] == [{less}]


def test_similar_documents_under_one_id(spark):
    """Two unlike texts share an id; each has a close copy under another id, and the copies are not linked through the id."""
    a, b = [f"a{i}" for i in range(200)], [f"b{i}" for i in range(200)]
    rows = [(2, " ".join(a), "x"), (2, " ".join(b), "x"), (5, " ".join(a[:190]), "x"), (6, " ".join(b[:190]), "x"), (7, "text of its own", "x"), (None, "without an id", "x")]
    root = {r["sha"]: r["root"] for r in simhash.similar_documents(docs(spark, rows)).collect()}
    of = [root[hashlib.sha256(t.encode()).hexdigest()] for _, t, _ in rows]
    assert of[0] == of[2] and of[1] == of[3] and len(set(of)) == 4


def test_near_copies_of_a_text_under_a_repeated_id(spark):
    """The texts of a repeated id give way without taking their components along."""
    import corpus_pipeline

    text = {k: [f"{k}{i}" for i in range(200)] for k in "abc"}
    full = lambda k, n=200: " ".join(text[k][:n])
    rows = [(2, full("a"), "x"), (2, full("b"), "x"), (1, full("a", 190), "x"), (6, full("b", 190), "x"), (7, full("c"), "x")]
    got = corpus_pipeline.drop_near_copies(spark, docs(spark, rows), "")
    kept = {(r["doc_id"], r["text"]) for r in got.collect()}
    assert (1, full("a", 190)) in kept and (7, full("c")) in kept
    assert len(kept) == 3 and sum(t in (full("b"), full("b", 190)) for _, t in kept) == 1


def test_lines(spark, none):
    menu, other = "Home | About | Contact us today", "seen on two sites only, not more"
    rows = [(i, f"own line {i}\n{menu}\n\nlast", f"s{i % 4}") for i in range(8)] + [(20, menu, "s1"), (21, other, "s1"), (22, other, "s2"), (23, None, "s3"), (24, "", None), (25, f"  {menu} ", "s2"), (0, f"own line 0\n{menu}\n\nlast", "s0")]
    got = lines.dedup_lines(docs(spark, rows)).collect()
    text = {(r["doc_id"], r["source"]): r["text"] for r in got}
    assert len(got) == len(rows)
    assert text[0, "s0"] == f"own line 0\n{menu}\n\nlast"
    assert text[3, "s3"] == "own line 3\n" and text[20, "s1"] == "" and text[25, "s2"] == ""
    assert text[21, "s1"] == other and text[22, "s2"] == other and text[23, "s3"] is None and text[24, None] == ""
    kept = lines.dedup_lines(docs(spark, rows), drop_emptied=True)
    assert {20, 25}.isdisjoint({r["doc_id"] for r in kept.collect()}) and kept.count() == len(rows) - 2
    assert lines.dedup_lines(none).count() == 0


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|end|>", "<!|end|><!!/s>[!INST]", "", None, "a\nb $1 \\ é😀", "<|turn|>assistant<|text|>x"]
    rows = [(c, t, r, x) for c in (1, 2) for t, (r, x) in enumerate([(r, x) for x in nasty for r in ("user", "assistant", None, "odd <|text|> role")])] + [(3, None, "assistant", "z"), (3, 5, "user", "y"), (3, 5, "user", "y"), (None, 0, "user", "no id")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, stretch int")
    out = chat.format_turns(df).withColumn("turns", chat.read_back(F.col("formatted")))
    got = {r["conv_id"]: r for r in out.withColumn("loss", chat.trained_text(F.col("turns"), F.col("mask"))).collect()}
    for c in (1, 2):
        want = [(r or "", x or "") for k, _, r, x in rows if k == c]
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == want
        assert got[c]["loss"] == "".join(x for r, x in want if r == "assistant")
        assert sum(m["skip"] + m["keep"] + m["rest"] for m in got[c]["mask"]) == len(got[c]["formatted"])
        assert got[c]["formatted"].count("<|end|>") == len(want)
    assert got[3]["n_turns"] == 3 and got[3]["loss"] == "z" and got[None]["n_turns"] == 1
    assert chat.format_turns(df.limit(0)).count() == 0


def test_chat_layouts(spark):
    rows = [
        ('{"prompt": "p", "response": "r"}', [("user", "p"), ("assistant", "r")]),
        ('{"instruction": "i", "input": "x", "output": "o"}', [("user", "i\n\nx"), ("assistant", "o")]),
        ('{"instruction": "i", "input": "", "output": "o"}', [("user", "i"), ("assistant", "o")]),
        ('{"messages": [{"role": "user", "content": "a"}, {"content": "b", "role": "assistant"}]}', [("user", "a"), ("assistant", "b")]),
        ('{"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}', [("user", "a"), ("assistant", "b")]),
        ('{"question": "q", "answer": "a", "id": 7, "meta": {"source": "s", "x y": [1]}}', [("user", "q"), ("assistant", "a")]),
        ('{"messages": [{"role": "user", "content": "a", "name": "n"}, {"role": "assistant", "content": null}], "id": 1}', [("user", "a"), ("assistant", None)]),
        ('{"messages": []}', []), ('{"message": {"content": "c", "role": "tool"}}', [("tool", "c")]), ('{"role": "user", "content": "{\\"prompt\\": 1}"}', [("user", '{"prompt": 1}')]),
        ('{"prompt": "p", "response": "r", "input": "of another layout"}', [("user", "p"), ("assistant", "r")]),
        ('{"prompt": "p", "response": {"text": "deeper"}}', None), ("{}", None), ("[1]", None), ('{"unknown": 1}', None), ("not json", None), (None, None),
    ]
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(rows)], "i int, record string")
    got = {r["i"]: r["turns"] for r in chat.canonical_turns(df).collect()}
    assert {i: t and [tuple(x) for x in t] for i, t in got.items()} == {i: w for i, (_, w) in enumerate(rows)}


def test_json_paths(spark):
    rows = [
        ('{"a b": 1, "x:y<z": {"q`r": "s"}, "e": [], "n": null}', ["a b", "e[]", "n", "x:y<z.q`r"]),
        ('{"a": [[{"b": 1}], [{"c": "x"}]], "d": {"e": {"f": 1.5}}}', ["a[][].b", "a[][].c", "d.e.f"]),
        ('{"a, b: STRING>": 1, "OBJECT<q: ARRAY<": [1.5]}', ["OBJECT<q: ARRAY<[]", "a, b: STRING>"]),
        ('{"a": [1, "x", {"b": 2}]}', ["a[]"]), ("{}", []), ("[]", ["[]"]), ('"s"', []), ("broken", []), (None, []),
    ]
    got = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(rows)], "i int, r string").select("i", chat.json_paths(F.col("r")).alias("p"))
    paths = {r["i"]: r["p"] for r in got.collect()}
    assert paths == {i: sorted(w) for i, (_, w) in enumerate(rows)}
    hashes = spark.createDataFrame([(["b", "a.c"],)], "p array<string>").select(chat.fingerprint_column(F.array_sort("p")))
    assert hashes.first()[0] == chat.fingerprint(["b", "a.c"])


def test_chat_tables(spark):
    nested = spark.createDataFrame([(1, 0, ("user", "a"), "x")], "thread long, position long, message struct<role:string,content:string>, layout string")
    assert tuple(chat.canonical_rows(nested).first())[:4] == (1, 0, "user", "a")
    flat = spark.createDataFrame([(1, 0, "user", "a", 5)], "conv_id long, turn long, role string, text string, extra int")
    assert tuple(chat.canonical_rows(flat).first())[:4] == (1, 0, "user", "a")
    with pytest.raises(ValueError):
        chat.canonical_rows(nested.select("thread"))


def test_decontamination(spark, none):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((20, 40, 60, 14, 3, 5))] + [(6, ""), (7, None)]
    fill = lambda n: " ".join(word() for _ in range(n))
    near = items[2][1].split()
    near[30] = "changed"
    far = items[1][1].split()
    far[5:35:4] = ["changed"] * len(far[5:35:4])
    rows = [(1, f"{fill(300)} {items[0][1].upper()} {fill(50)}", "a"), (2, items[1][1] + " tail", "a"), (3, f"{fill(10)}, {' '.join(near)}. {fill(3)}", "a"), (4, f"{fill(9)} {' '.join(far)}", "a"), (5, fill(500), "a"), (6, f"{fill(30)} {items[4][1]} {fill(30)}", "a"), (7, items[5][1], "a"), (8, None, "a"), (9, "", "b"), (10, items[3][1], "a"), (10, items[3][1], "a")]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def similarity(a, b):
        k = min(5, len(b))
        count = lambda w: {x: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)].count(x) for x in {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}}
        x, y = count(a), count(b)
        return sum(min(n, y.get(s, 0)) for s, n in x.items()) / max(1, sum(max(x.get(s, 0), y.get(s, 0)) for s in {*x, *y}))

    want = set()
    for i, t, _ in rows:
        for j, b in items:
            w, v = decontaminate.words_of(t), decontaminate.words_of(b)
            if v and max((similarity(w[s : s + len(v)], v) for s in range(max(1, len(w) - len(v) + 1))), default=0) >= 0.8:
                want.add((i, j))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs(spark, rows), bench).collect()}
    assert got == want and {(1, 0), (2, 1), (3, 2), (6, 4), (7, 5), (10, 3)} <= want and (4, 1) not in want
    assert decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.contaminated(docs(spark, rows), bench.limit(0)).count() == 0


def test_window_prints():
    """Sliding sums in byte lanes give the majority of every window, for windows longer than a byte counts too."""
    h = np.random.default_rng(14).integers(0, 1 << 64, 1500, dtype=np.uint64)
    h[200:900] = h[200]
    windows = decontaminate.Windows(h)
    for n in (1, 2, 5, 40, 127, 128, 254, 255, 256, 700, 1500):
        want = [sum(1 << b for b in range(64) if 2 * int(((h[s : s + n] >> np.uint64(b)) & np.uint64(1)).sum()) > n) for s in range(0, 1501 - n, 97)]
        assert windows.prints(n)[::97].tolist() == want


def test_word_hashes():
    rng = random.Random(15)
    parts = ["A", "b", "İ", "ß", "ΑΣ", "é", "日本", "_1", "\U0001d54f", "-", " ", ", ", "\n", "\u093c"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(800)] + ["", None, "-"]
    of = {}
    for t in texts:
        words, h = decontaminate.words_of(t), shared.word_hashes(t)
        assert len(words) == len(h) and all(of.setdefault(w, x) == x for w, x in zip(words, h.tolist()))
        assert shared.word_hashes(t, 7).tolist() == h.tolist()
    assert len(set(of.values())) == len(of)


def test_decontamination_of_windows_with_distant_fingerprints():
    rng, tried = random.Random(13), 0
    for _ in range(3000):
        x, y = ("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(2))
        item, window = " ".join([x] * 20 + [y] * 20), " ".join([x] * 23 + [y] * 17)
        index = decontaminate.Items([(1, item)])
        h = shared.shingle_hashes(shared.word_hashes(window), 5)
        if int(decontaminate.Windows(h).prints(len(h))[0] ^ index.sized[5][0].prints[0]).bit_count() > 23:
            tried += 1
            assert [m[:3] for m in index.matches([window])[0]] == [(1, 33, 39)]
    assert tried


def test_sharding(spark, odd, none, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_GROUPS", 10)
    monkeypatch.setattr(sharding, "FAN", 3)
    rows = sharding.shard_documents(odd, 4).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    for s in by.values():
        assert sorted(r["slot"] for r in s) == list(range(len(s)))
    want = sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts_of(odd)), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=repr) == want
    assert len({r["shard"] for r in rows if r["doc_id"] in (5, 6)}) == 1
    assert sharding.shard_documents(none, 4).count() == 0


def test_differencing_balances():
    rng = np.random.default_rng(9)
    parts = np.zeros((500, 8), np.int64)
    parts[:, 0] = rng.integers(1, 10_000, 500)
    goes, sums = sharding.difference(parts)
    own = np.bincount(goes[:, 0], parts[:, 0], 8)
    assert sorted(own) == sorted(sums) and own.max() - own.min() <= 50


def test_quality(spark, none):
    rng = random.Random(10)
    good = lambda: " ".join(rng.choice(["tha", "ering", "onsh", "ation", "neth"]) + rng.choice(["re", "an", "ou"]) for _ in range(60))
    rows = [(i, good() if i % 3 else " ".join(w.upper() + "!!" for w in good().split()), "a") for i in range(300)] + [(900, None, "a"), (901, "", "a")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    df = docs(spark, rows)
    keep = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    model = quality.fit(df, labels, keep)
    got = {r["doc_id"]: r["s"] for r in df.select("doc_id", quality.score_column(df, model).alias("s")).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all((got[i] >= 0.7) == (i % 3 > 0) for i in held)
    assert got[900] == got[901] and 0 <= got[900] <= 1
    assert none.select(quality.score_column(none, model)).count() == 0
    assert 0 <= quality.Scorer(quality.fit(none, labels.limit(0), keep)).score("anything") <= 1


def test_quality_scores_are_those_of_the_features():
    rng = random.Random(16)
    texts = [" ".join(rng.choice(["Of", "of", "the,", "été", "x", "the"]) for _ in range(rng.randint(0, 50))) for _ in range(200)]
    model = quality.train([quality.document_features(t) for t in texts], np.array([len(t) % 2 for t in texts]))
    scorer = quality.Scorer(model)
    for t in texts:
        ids, w = quality.document_features(t)
        z = (w @ model["vectors"][ids] if len(ids) else 0) @ model["out"] + model["bias"] if len(ids) else model["bias"]
        assert np.isclose(scorer.score(t), 1 / (1 + np.exp(z[0] - z[1])), atol=1e-5)


def test_viterbi():
    rng = np.random.default_rng(11)
    scores = rng.normal(size=(40, 3)).astype(np.float32)
    lengths = np.array([7, 0, 12, 1, 20])
    got, at = langid.viterbi(scores, lengths, 0.7), 0
    for n in lengths:
        best = np.zeros((n, 3))
        back = np.zeros((n, 3), int)
        s = scores[at : at + n]
        for t in range(n):
            step = best[t - 1][:, None] - 0.7 * (1 - np.eye(3)) if t else np.zeros((1, 3))
            back[t] = step.argmax(axis=0)
            best[t] = s[t] + step.max(axis=0)
        path = [int(best[-1].argmax())] if n else []
        for t in range(n - 1, 0, -1):
            path.append(int(back[t][path[-1]]))
        mine = got[at : at + n]
        value = lambda p: sum(s[t][p[t]] for t in range(n)) - 0.7 * sum(a != b for a, b in zip(p, p[1:]))
        assert np.isclose(value(mine), value(path[::-1]))
        at += n


def test_viterbi_with_many_labels():
    scores = np.zeros((3, 300), np.float32)
    scores[0, 280] = scores[1, 3] = scores[2, 280] = 9
    assert langid.viterbi(scores, np.array([3]), 0.5).tolist() == [280, 3, 280]
    assert langid.viterbi(scores, np.array([1, 2]), 20.0).tolist() == [280, 3, 3]


def test_langid(spark, none):
    texts = {"en": "the cat and the dog with this house", "fr": "le chat et le chien avec cette maison", "ru": "кошка и собака в этом доме"}
    rows = [(i, t, lang) for i, (lang, t) in enumerate(list(texts.items()) * 20)] + [(100, None, "en"), (101, "123 !!", "fr"), (102, "", None), (103, "the dog", None)]
    df = spark.createDataFrame([(i, t, g, "s") for i, t, g in rows], "doc_id long, text string, lang string, source string")
    model = langid.fit(df, F.lit(True))
    got = {r["doc_id"]: (r["p"]["lang"], r["p"]["score"]) for r in df.select("doc_id", langid.language_column(df, model).alias("p")).collect()}
    assert all(got[i][0] == g for i, _, g in rows[:60])
    assert got[100] == got[101] == got[102] == ("und", 0.0) and got[103][0] == "en"
    mixed = spark.createDataFrame([(texts["en"] + " " + texts["ru"],)], "text string")
    spans = mixed.select(langid.span_column(mixed, model).alias("s")).first()["s"]
    assert [(x["lang"], x["first"]) for x in spans] == [("en", 0), ("ru", 8)]
    empty = langid.fit(df.limit(0), F.lit(True))
    assert [r[0]["lang"] for r in df.limit(2).select(langid.language_column(df, empty)).collect()] == ["und", "und"]


def test_langid_predictions_are_those_of_a_plain_walk(monkeypatch):
    """The same model read word by word: posteriors, the best path by trying all switches, the share of letters."""
    monkeypatch.setattr(langid, "SWITCH", 2.718)  # with a penalty that no sum of others equals, no two paths are as good
    texts = {"en": "the cat and the dog with this house, 12 times!", "fr": "le chat et le chien avec cette maison", "de": "die katze und der hund mit diesem haus", "ru": "кошка и собака в этом доме"}
    model = langid.train([(lang, t) for lang, t in texts.items()])
    langs, rng = model["langs"], random.Random(17)
    kind = lambda c: [n for s, n in langid.SCRIPTS if s <= ord(c)][-1]

    def word_scores(piece):
        w = "".join(c for c in piece if c.isalpha()).lower()
        if not w:
            return np.zeros(len(langs)), 0, 0
        ids, _ = langid.grams_of([w])
        found = Counter(map(kind, w))
        script = min(found, key=lambda n: (-found[n], n))
        can = [script in used for used in model["scripts"]]
        if not any(can):
            return np.zeros(len(langs)), len(w), 0
        total = np.where(can, model["logs"][ids].sum(axis=0, dtype=np.float64), -np.inf)
        total -= total.max()
        return np.maximum(total - np.log(np.exp(total).sum()), langid.FLOOR), len(w), len(w)

    def plain(text):
        seen = [word_scores(p) for p in text.split()]
        if not any(n for _, n, _ in seen):
            return "und", 0.0
        best, back = np.zeros(len(langs)), []
        for t, (s, _, _) in enumerate(seen):
            step = best[:, None] - langid.SWITCH * (1 - np.eye(len(langs)))
            stay = best >= step.max(axis=0)  # on a tie no switch
            back.append(np.where(stay, np.arange(len(langs)), step.argmax(axis=0)))
            best = s + step.max(axis=0)
        label, letters = int(best.argmax()), np.zeros(len(langs))
        for (_, _, n), b in zip(reversed(seen), reversed(back)):
            letters[label] += n
            label = int(b[label])
        return langs[int(letters.argmax())], letters.max() / sum(n for _, n, _ in seen)

    pool = [w for t in texts.values() for w in t.split()] + ["12", "--", "日本"]
    said = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 25))) for _ in range(150)] + [" ".join(t for t in texts.values())]
    lang, share = langid.Labeller(model).predict(said)
    differ = [t for t, a, x in zip(said, lang, share) if (a, round(x, 6)) != (plain(t)[0], round(plain(t)[1], 6))]
    assert len(differ) <= 2  # ties of single and double precision, and of words that no language has the script of


def test_langid_learns_from_texts_with_many_copies(spark):
    said = [(f"l{k}", f"{chr(97 + k) * 3}{chr(97 + j) * 4} {chr(97 + k) * 5}") for k in range(10) for j in range(3)]
    df = spark.createDataFrame(said, "lang string, text string").crossJoin(spark.range(2000))
    model = langid.fit(df, F.lit(True))
    assert model["langs"] == sorted({k for k, _ in said})
    few = spark.createDataFrame(said, "lang string, text string")
    assert (langid.fit(few, F.lit(True))["logs"] == model["logs"]).all()


def test_digest_of_ids_is_little_endian():
    assert hashlib.sha256(np.array([1, 70000], "<u4").tobytes()).hexdigest() == hashlib.sha256(bytes([1, 0, 0, 0, 0x70, 0x11, 1, 0])).hexdigest()


def thue_morse(k):
    """Two words of 2**k letters, each the other with a and b exchanged; they share every polynomial hash modulo 2**64."""
    a, b = "a", "b"
    for _ in range(k):
        a, b = a + b, b + a
    return a, b


def test_patterned_words_are_told_apart(spark):
    for k in (10, 11):
        a, b = thue_morse(k)
        keys = shared.hash_spans(np.frombuffer((a + b).encode(), np.uint8), np.array([0, len(a)]), np.array([len(a), 2 * len(a)]))
        assert keys[0] == keys[1]
        assert len(set(shared.word_hashes(f"{a} {b}").tolist())) == 2
        df = docs(spark, [(1, a, "s"), (2, b, "s"), (3, a, "t")])
        roots = {(r["doc_id"], r["root"]) for r in simhash.similar_documents(df).select("doc_id", "root").collect()}
        assert len({r for _, r in roots}) == 2
        for cls, path in ((piece_encoder.BatchEncoder, BYTE), (piece_encoder.WordEncoder, WORD)):
            enc, lib = cls(open(path, "rb").read()), Tokenizer.from_file(path)
            for t, ids in zip([a, b, f"x {a} y {b}"], enc.encode_all([a, b, f"x {a} y {b}"])):
                assert ids.tolist() == lib.encode(t, add_special_tokens=False).ids


def test_word_hashes_in_stretches():
    text = " ".join(f"word{i % 97} été{i % 31}" for i in range(5000))
    assert (shared.word_hashes(text) == shared.word_hashes(text, stretch=1000)).all()
    assert shared.word_hashes("Été 12 x")[0] == shared.word_hashes("été")[0]


@pytest.mark.parametrize("cls, path", [(piece_encoder.BatchEncoder, BYTE), (piece_encoder.WordEncoder, WORD)])
def test_batch_encoders_match_the_library(cls, path):
    lib, rng = Tokenizer.from_file(path), random.Random(21)
    parts = ["a", "B", " ", "\n", "'", "'s", "'RE", "é", "İ", "Σ", "9", "²", "!", "<", "|", "<|endoftext|>", "\u0301", "ß", "語", "\u3000", "\x1c", "\x85", "K", "ﬁ", "\xad", "\u200d", "\xa0"]
    odd = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["", " ", "long " * 3000, "x" * 3000]
    enc = cls(open(path, "rb").read())
    assert enc.cuts
    for chunk, pieces in ((enc.CHUNK, enc.PIECES), (500, 200)):  # long texts in stretches, and much forgotten
        enc.CHUNK, enc.PIECES = chunk, pieces
        for t, ids in zip(odd, enc.encode_all(odd)):
            assert ids.tolist() == lib.encode(t, add_special_tokens=False).ids


def test_chat_keeps_very_long_turns(spark):
    """A text longer than the JSON parser takes by default; and a record of no layout is an error turn, not nothing."""
    n = 25_000_000
    long = spark.range(1).select(F.lit(7).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.concat(F.repeat(F.lit("ab "), n // 3), F.lit('"\\é')).alias("text"))
    from factloom.llm import queries

    got = chat.canonical_turns(queries.op3_records(long)).filter("conv_id = 7").select("layout", F.size("turns").alias("n"), F.length(F.col("turns")[0]["text"]).alias("chars"), F.right(F.col("turns")[0]["text"], F.lit(4)).alias("tail")).first()
    assert got["layout"] and (got["n"], got["chars"], got["tail"]) == (1, n // 3 * 3 + 3, ' "\\é')
    out = chat.outline(F.lit('{"a\\"b": "' + "\\u00e9x" * 200_000 + '", "c": ["' + "y" * 50 + '"]}'))
    cut = spark.range(1).select(out.alias("o")).first()["o"]
    assert len(cut) < 400 and '"a\\"b": "' in cut and cut.endswith('"]}')


def plain_fit(lengths, capacity):
    room, out = [], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        s = next((k for k, r in enumerate(room) if r >= lengths[i]), len(room))
        if s == len(room):
            room.append(capacity)
        out.append((i, s, capacity - room[s]))
        room[s] -= lengths[i]
    return sorted(out)


def test_first_fit_decreasing():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 37, 400):
        lengths = rng.integers(1, 65, n)
        sequence, offset = packing.first_fit_decreasing(lengths, 64)
        assert list(zip(range(n), sequence.tolist(), offset.tolist())) == plain_fit(lengths.tolist(), 64)


def test_packing(spark, odd, none):
    lib = Tokenizer.from_file(WORD)
    packed = packing.pack_documents(odd, WORD, capacity=64, group=20)
    rows = packed.collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append(r)
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        assert 0 < r["length"] <= 64 and len(r["ids"]) == 4 * r["length"]
    for s in by_seq.values():
        s.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in s] == np.cumsum([0, *[r["length"] for r in s]])[:-1].tolist() and s[-1]["offset"] + s[-1]["length"] <= 64
    want = Counter()
    for i, t in texts_of(odd):
        ids = [*lib.encode(t, add_special_tokens=False).ids, 1]
        for a in range(0, len(ids), 64):
            want[i, a, np.array(ids[a : a + 64], "<u4").tobytes(), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], bytes(r["ids"]), r["doc_tokens"]) for r in rows) == want
    whole = packing.sequences(packed, capacity=64, pad_id=49407).collect()
    assert {r["sequence_id"] for r in whole} == set(by_seq)
    for r in whole:
        s = by_seq[r["sequence_id"]]
        assert bytes(r["ids"]) == b"".join(bytes(x["ids"]) for x in s) + np.full(64 - r["filled"], 49407, "<u4").tobytes()
        assert [(x["id"], x["start"], x["offset"], x["length"]) for x in r["documents"]] == [(x["doc_id"], x["start"], x["offset"], x["length"]) for x in s]
    assert packing.pack_documents(none, WORD).count() == 0


def plain_kmeans(vectors, k, rounds):
    """(cluster, distance) of (id, whole numbers), in plain Python."""
    seeds = sorted(vectors, key=lambda v: (hashlib.sha256(f"3:{v[0] if v[0] is not None else ''}".encode()).hexdigest(), v[1]))[:k]
    c = [list(v) for _, v in seeds]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in vectors]
        for j in range(len(c)):
            mine = [v for (_, v), o in zip(vectors, of) if o == j]
            c[j] = [sum(x) // len(mine) for x in zip(*mine)] if mine else c[j]
    return [(i, near(v)[1], near(v)[0]) for i, v in vectors], [tuple(x) for x in c]


def test_clusters(spark):
    rng = random.Random(31)
    make = lambda m: [rng.choice([-1, 0, 1, 1, 2]) * rng.random() * m for _ in range(8)]
    rows = [(i, make(2), i) for i in range(120)] + [(5, [0.5] * 8, 1), (5, [0.5] * 8, 1), (None, make(1), 2), (200, None, 3), (201, [1.0] * 7, 4), (202, [1.0] * 7 + [None], 5), (203, [1.0] * 7 + [float("nan")], 6), (204, [1.0] * 7 + [float("inf")], 7), (205, [-0.0001] * 8, 8), (206, [float(1 << 18)] + [0.0] * 7, 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int")
    kept = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v, _ in rows if v and len(v) == 8 and all(x is not None and abs(x) <= 1 << 17 for x in v)]
    for k in (1, 5):
        placed, centroids = clusters.kmeans(df, clusters=k, rounds=4, width=8)
        want, at = plain_kmeans(kept, k, 4)
        assert centroids == at
        got = clusters.with_inertia(placed, centroids).collect()
        assert Counter((r["vec_id"], r["cluster"], r["distance"]) for r in got) == Counter(want)
        for r in got:
            assert r["cluster_inertia"] == sum(d for _, c, d in want if c == r["cluster"]) and r["inertia"] == sum(d for _, _, d in want)
            assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, at[r["cluster"]])).encode()).hexdigest()
    placed, centroids = clusters.kmeans(df.limit(0), width=8)
    assert centroids == [] and clusters.with_inertia(placed, centroids).count() == 0
    two, few = clusters.kmeans(df.limit(2), clusters=5, rounds=2, width=8)
    assert len(few) == 2 and two.count() == 2


def test_progressive_search_is_exact():
    rng = np.random.default_rng(4)
    order = clusters.sequency_order(64)
    h = clusters.transform(np.eye(64, dtype=np.int64))
    assert (h @ h == 64 * np.eye(64, dtype=np.int64)).all() and order[0] == 0 and (h[order[1]] == np.repeat([1, -1], 32)).all()
    x, c = rng.integers(-1500, 1500, (300, 64)), rng.integers(-1500, 1500, (8, 64))
    c[3], c[6], x[:20] = c[1], x[50], c[1]  # ties go to the smaller number
    of, d = clusters.search(clusters.transform(x)[:, order], clusters.transform(c)[:, order])
    full = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert (of == full.argmin(axis=1)).all() and (d == 64 * full.min(axis=1)).all()


def plain_variants(counts):
    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out, form = {}, {}
    for w, n in counts.items():
        others = sorted((-counts[x], x) for x in counts if near(w, x))
        form[w] = others[0][1] if others and -others[0][0] >= 10 * n else None
        out[w] = (n, len(others), counts[form[w]] if form[w] else None)
    rows = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, *out[w]))
    return rows


@pytest.mark.parametrize("cell", [50_000, 3])
def test_variants(spark, monkeypatch, cell):
    """Against all pairs; with tiny cells, so that they are dealt out in pairs of parts; long words and letters of one group."""
    rng = random.Random(41)
    base = ["abcdefg", "zzzzzzz", "éèêëìíîï", "q" * 60, "abcabcabc"]
    held = {}
    for _ in range(220):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(w))
            w[i : i + 1] = rng.choice([[], [rng.choice("abzqéðx")], [w[i], rng.choice("abzéð")]])
        if len(w) >= 7:
            held["".join(w)] = rng.choice([2, 3, 30, 400, 5000])
    df = spark.createDataFrame(list(held.items()), "word string, n long")
    monkeypatch.setattr(variants, "STEP", 50)
    got = variants.with_forms(df, variants.near_words(df, cell_words=cell)).collect()
    assert {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in got} == plain_variants(held) and len(got) == len(held)


def test_variant_words(spark, none):
    rows = [(i, "Seventh SEVENTH seventh éééééééé Sixlet tinywords, tinywords x" + "y" * 3000, "s") for i in range(40)] + [(None, "nobodys nobodys", "s"), (3, None, "s"), (3, "", "s")]
    df = docs(spark, rows)
    want = Counter()
    import re

    for i, t, _ in rows:
        for r in re.findall("[A-Za-z\u00c0-\u00ff]+", t or ""):
            r = "".join(c.lower() if c < "\x80" else c for c in r)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            w = r[: h % len(r)] + r[h % len(r) + 1 :] if h % 31 == 0 else r
            want[w] += len(w) >= 7
    assert {(r["word"], r["n"]) for r in variants.words(df).collect()} == {(w, n) for w, n in want.items() if n >= 2}
    assert variants.spelling_variants(none).count() == 0
    assert variants.spelling_variants(df).columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_langid_scripts_of_no_learned_language():
    model = langid.train([("en", "the cat and the dog"), ("de", "die katze und der hund")])
    lang, share = langid.Labeller(model).predict(["แมว หมา", "кошка", "the cat кот", "12"])
    assert set(lang[:2]) <= {"de", "en"} and share[:2].tolist() == [0, 0]
    assert lang[2] == "en" and np.isclose(share[2], 6 / 9) and lang[3] == "und"


def test_pairs_of_words_have_an_order():
    a = quality.pairs_of(np.array([5, 9, 5, 5, 9, 9]))
    assert a[0] != a[1] and a[2] != a[4] and a[0] == a[3]


@pytest.mark.parametrize("size", [15, 60, 150, 400])
def test_decontamination_by_item_size(size):
    """Every window of 0.8 or more is found at any size of items, against plain Python; edited copies in long texts."""
    rng = random.Random(size)
    pool = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(pool) for _ in range(size))) for i in range(12)]
    texts = []
    for k in range(16):
        words = items[k % 12][1].split()
        for _ in range(rng.randint(0, max(1, size // 40))):
            words[rng.randrange(size)] = "edited"
        texts.append(" ".join([rng.choice(pool) for _ in range(rng.randint(0, 300))] + words + [rng.choice(pool) for _ in range(rng.randint(0, 300))]))
    texts += [" ".join(rng.choice(pool) for _ in range(1000)), ""]
    got = {(t, f[0]) for t, found in enumerate(decontaminate.Items(items).matches(texts)) for f in found}
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    want = set()
    for t, text in enumerate(texts):
        w = text.split()
        for i, it in items:
            own, n = grams(it.split()), size - 4
            common = [tuple(w[a : a + 5]) in own for a in range(len(w) - 4)]
            for a in range(len(w) - size + 1):
                if sum(common[a : a + n]) < 0.8 * n:
                    continue
                window = grams(w[a : a + size])
                shared = sum((window & own).values())
                if shared >= 0.8 * (2 * n - shared):
                    want.add((t, i))
    assert got == want and len(want) >= 12
