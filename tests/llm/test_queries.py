"""The registered queries over the smallest tables, against plain Python or SQL; and the pipeline stage by stage."""

import hashlib
import os
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
import public_tokenizers
from factloom.llm import queries as q
from factloom.llm.decontaminate import words_of
from tokenizers import Tokenizer

from test_small import groups_of, slow_print

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
sha = lambda b: hashlib.sha256(b).hexdigest()
held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "labels", "conversations", "benchmark"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def texts(con):
    return dict(con.execute("select doc_id, coalesce(text, '') from documents").fetchall())


def rows(spark, name):
    return q.QUERIES[name](spark, SF).collect()


def test_op1(spark, texts):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in rows(spark, "op1_bpe"):
        ids = lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()))
        assert r["decoded_sha256"] == sha(lib.decode(ids, skip_special_tokens=False).encode())


def test_op2(spark, texts, con):
    """Every window of every text against every item, in plain Python."""
    items = [(i, words_of(t)) for i, t in con.execute("select item_id, text from benchmark").fetchall()]
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    want = set()
    for d, t in texts.items():
        w = words_of(t)
        here = set(grams(w))
        for i, v in items:
            own, n = grams(v), len(v) - 4
            if not here & set(own):  # no shingle in common, no similarity
                continue
            for s in range(max(1, len(w) - len(v) + 1)):
                window = grams(w[s : s + len(v)])
                shared = sum((window & own).values())
                if shared >= 0.8 * (sum(window.values()) + n - shared):
                    want.add((d, i))
    assert want and {(r["doc_id"], r["item_id"]) for r in rows(spark, "op2_decontamination")} == want


def test_op4(spark, texts):
    got = {r["doc_id"]: r for r in rows(spark, "op4_simhash")}
    prints = {i: slow_print(t) for i, t in texts.items()}
    root = groups_of([(i, j) for i in prints for j in prints if i < j and (prints[i] ^ prints[j]).bit_count() <= 2], prints)
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{x:016x}", root[i]) for i, x in prints.items()}


def test_op3(spark, con):
    turns = defaultdict(list)
    for c, _, role, text in con.execute("select * from conversations order by conv_id, turn").fetchall():
        turns[c].append((role or "", text or ""))
    turns[-1] = [(r, "</s>[INST] ok [/INST]") for r in ("user", "assistant")]
    got = rows(spark, "op3_chat")
    assert len(got) == len(turns)
    for r in got:
        t = turns[r["conv_id"]]
        loss = "".join(x for role, x in t if role == "assistant")
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (len(t), len(loss), sha(loss.encode()))
        assert r["turns_sha256"] == sha("".join(f"{a}\n{b}\n" for a, b in t).encode())
        assert r["formatted_chars"] > sum(len(a) + len(b) for a, b in t)


def test_op5(spark, texts):
    for r in rows(spark, "op5_media"):
        raw = texts[r["doc_id"]].encode()
        pay = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(pay), sha(pay), zlib.crc32(pay[-16:]))


def test_op6(spark, texts):
    lib, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    got = {r["doc_id"]: r for r in rows(spark, "op6_token_files")}
    for i in sorted(texts):
        ids = [*lib.encode(texts[i], add_special_tokens=False).ids, 0]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_op7(spark, con):
    label = dict(con.execute("select doc_id, quality from labels").fetchall())
    got = {r["doc_id"]: r for r in rows(spark, "op7_quality")}
    assert all(r["held_out"] == held(i) and r["predicted"] == (r["score"] >= 0.7) for i, r in got.items())
    known = [i for i in label if held(i)]
    assert np.mean([got[i]["predicted"] == label[i] for i in known]) >= 0.8


def test_op8(spark, con):
    rel = con.execute(q.ORACLE_SQL["op8_line_dedup"])
    names = [x[0] for x in rel.description]
    assert sorted(tuple(r[n] for n in names) for r in rows(spark, "op8_line_dedup")) == sorted(rel.fetchall())


def test_op9(spark, con):
    lang = dict(con.execute("select doc_id, lang from documents").fetchall())
    got = rows(spark, "op9_langid")
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in got if r["held_out"]]) >= 0.9


def test_op10(spark, texts):
    got = rows(spark, "op10_sharding")
    size, at, of = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in got:
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(texts[r["doc_id"]].encode()) + 8, zlib.crc32(texts[r["doc_id"]].encode()), "bytes", None)
        size[r["shard"]] += r["size"]
        at[r["shard"]].append(r["slot"])
        of[texts[r["doc_id"]]].add(r["shard"])
    assert set(size) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in at.values())
    assert all(len(s) == 1 for s in of.values())
    groups = defaultdict(int)
    for t in texts.values():
        groups[t] += len(t.encode()) + 8
    assert max(size.values()) <= max(max(groups.values()), 1.02 * sum(size.values()) / 24)


def test_op7_scores_are_those_of_a_plain_model(spark, texts):
    """The registered scores, from the features of each whole text and the same learned model."""
    from factloom.llm import quality

    model = quality.fit(q.table(spark, SF, "documents"), q.table(spark, SF, "labels"), ~q.held_out())
    for r in rows(spark, "op7_quality"):
        ids, w = quality.document_features(texts[r["doc_id"]])
        z = (w @ model["vectors"][ids] @ model["out"] if len(ids) else 0) + model["bias"]
        assert np.isclose(r["score"], 1 / (1 + np.exp(z[0] - z[1])), atol=1e-5)


def test_op9_predictions_are_those_of_a_plain_model(spark, texts):
    """The registered predictions of short texts, by trying every step of the path word by word."""
    from factloom.llm import langid

    model = langid.fit(q.table(spark, SF, "documents"), ~q.held_out())
    langs, differ, seen = model["langs"], 0, 0
    got = {r["doc_id"]: r for r in rows(spark, "op9_langid")}
    for i, text in texts.items():
        words = ["".join(c for c in p if c.isalpha()).lower() for p in text.split()]
        if not 0 < len(words) <= 400:
            continue
        best, back = np.zeros(len(langs)), []
        for w in words:
            s = np.zeros(len(langs))
            if w:
                ids, _ = langid.grams_of([w])
                can = np.array([langid._NAMES[langid.scripts_of([w])[0]] in used for used in model["scripts"]])
                s = np.where(can, model["logs"][ids].sum(axis=0, dtype=np.float64), -np.inf) if can.any() else s
                s = np.maximum(s - s.max() - np.log(np.exp(s - s.max()).sum()), langid.FLOOR) if can.any() else s
            stay = best >= best.max() - langid.SWITCH
            back.append(np.where(stay, np.arange(len(langs)), best.argmax()))
            best = s + np.maximum(best, best.max() - langid.SWITCH)
        label, letters = int(best.argmax()), np.zeros(len(langs))
        for w, b in zip(reversed(words), reversed(back)):
            letters[label] += len(w)
            label = int(b[label])
        want = (langs[int(letters.argmax())], letters.max() / letters.sum()) if letters.sum() else ("und", 0.0)
        seen += 1
        differ += (got[i]["lang_pred"], round(got[i]["score"], 5)) != (want[0], round(want[1], 5))
    assert seen > 50 and differ <= 0.03 * seen  # single precision on one side: paths of equal worth


def test_op10_is_plain_differencing(spark, texts):
    """Shard sizes of the registered query, by Karmarkar-Karp over all groups in plain Python."""
    import heapq

    groups = Counter()
    for t in texts.values():
        groups[t] += len(t.encode()) + 8
    heap = [(-n, k, (n, *[0] * 23)) for k, n in enumerate(sorted(groups.values(), reverse=True))]
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, k, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        total = tuple(sorted((x + y for x, y in zip(a, reversed(b))), reverse=True))
        heapq.heappush(heap, (total[-1] - total[0], k, total))
    size = Counter()
    for r in rows(spark, "op10_sharding"):
        size[r["shard"]] += r["size"]
    plain = heap[0][2]
    assert max(size.values()) - min(size.values()) <= 2 * (plain[0] - plain[-1]) + 64 and sum(size.values()) == sum(plain)


@pytest.mark.parametrize("name", ["op11_clusters", "op13_variants"])
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rel = c.execute(q.ORACLE_SQL[name])
    names = [x[0] for x in rel.description]
    got = q.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=repr) == sorted(rel.fetchall(), key=repr)


def test_op12(spark, texts):
    """Pieces of all whole texts, by the library; sequences without gaps, and as full as first-fit decreasing makes them."""
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got, seqs = defaultdict(list), defaultdict(list)
    for r in rows(spark, "op12_packing"):
        got[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(got) == set(texts)
    left = []
    for i, pieces in got.items():
        ids, at = [*lib.encode(texts[i], add_special_tokens=False).ids, 1], 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes()))
            at += r["length"]
        assert at == len(ids)
        left += [len(ids) % 2048] if len(ids) % 2048 else []
    for s in seqs.values():
        s.sort()
        assert [o for o, _ in s] == np.cumsum([0, *[n for _, n in s]])[:-1].tolist() and sum(n for _, n in s) <= 2048
    room = []
    for n in sorted(left, reverse=True):  # one group here
        k = next((k for k, x in enumerate(room) if x >= n), len(room))
        room += [2048] if k == len(room) else []
        room[k] -= n
    full = sum(len([1 for r in p if r["length"] == 2048]) for p in got.values())
    assert len(seqs) == full + len(room)


def shingles(text):
    w = words_of(text)
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def test_pipeline(spark, con):
    docs, kept = q.table(spark, SF, "documents"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        kept.append({r["doc_id"]: r for r in docs.collect()})
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns
    raw = dict(con.execute("select doc_id, text from documents").fetchall())
    good, lined, apart, clean, ids = kept

    label = dict(con.execute("select doc_id, quality from labels").fetchall())
    assert np.mean([(i in good) == (label[i] == 1) for i in label]) >= 0.85 and all(r["text"] == raw[i] for i, r in good.items())

    sites, first = defaultdict(set), {}
    for i in sorted(good):
        for pos, x in enumerate(good[i]["text"].split("\n")):
            if x.strip():
                sites[x.strip()].add(good[i]["source"])
                first.setdefault(x.strip(), (i, pos))
    for i, r in good.items():
        left = [x for pos, x in enumerate(r["text"].split("\n")) if len(sites[x.strip()]) < 3 or first[x.strip()] == (i, pos)]
        text = "\n".join(left)
        assert (i in lined) == (text.strip() != "" or text == r["text"])
        assert i not in lined or (lined[i]["text"], lined[i]["n_chars"]) == (text, len(text))

    sets = {i: shingles(r["text"]) for i, r in lined.items()}
    root = {i: i for i in lined}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and (shared := len(sets[i] & sets[j])) >= 0.8 * (len(sets[i]) + len(sets[j]) - shared):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert set(apart) == {find(i) for i in lined}

    items = [words_of(t) for (t,) in con.execute("select text from benchmark").fetchall()]
    holds = {i for i, r in apart.items() for v in items if f" {' '.join(v)} " in f" {' '.join(words_of(r['text']))} "}
    assert holds and not holds & set(clean)
    assert len(apart) - len(clean) <= len(holds) + 3

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert set(ids) == set(clean)
    for i, r in ids.items():
        assert np.frombuffer(r["ids"], "<u4").tolist() == lib.encode(clean[i]["text"], add_special_tokens=False).ids


def test_pipeline_stages_with_odd_rows(spark):
    words = " ".join(f"word{i}" for i in range(100))
    rows = [(1, words), (1, words), (None, words), (None, "no id but text of its own here"), (2, "one text of two under this id"), (2, "the other text that id two has"), (3, None), (4, "")]
    names = "sha _key _score _bad _gone n_lines n_removed"
    df = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 9 - k, *range(6)) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in names.split()))
    got = corpus_pipeline.drop_near_copies(spark, df, SF)
    assert got.columns == df.columns
    # unlike texts are documents each, though they share an id; of the repeated row, the one whose other columns come first
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted([(1, words), rows[3], rows[4], rows[5], (3, None)], key=repr)
    assert [r["sha"] for r in got.filter("doc_id = 1").collect()] == [8]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, df, SF)
        assert kept.columns == df.columns
        assert {tuple(r)[6:] for r in kept.collect()} <= {tuple(range(6))}
    assert corpus_pipeline.drop_contaminated(spark, df, SF).count() == df.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), SF).count() == 0
