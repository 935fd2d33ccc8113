"""Worked cases of single operators, with nulls, empty inputs and ties."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from factloom.functions import periods
from factloom.functions.locale import KOREAN
from factloom.operators import claims, compute, ranking, text, verdict


def test_compound_numbers(spark):
    cases = [
        ("23만8천명", [(238000, 0, 5)]), ("338만 4523명", [(3384523, 0, 9)]), ("360, 100명", [(360, 0, 4), (100, 5, 8)]), ("1억2천만원", [(120000000, 0, 5)]), ("4천억원", [(4e11, 0, 3)]), ("1억2천만 3500명", [(120003500, 0, 10)]), ("", []), (None, []), ("no number", []),
        ("2천 4백명과 5백", [(2400, 0, 5), (500, 8, 10)]), ("1만 20000", [(10000, 0, 2), (20000, 3, 8)]), ("3만 2억", [(30000, 0, 2), (2e8, 3, 5)]), ("1조 2억 3만 45.5%", [(1000200030045.5, 0, 13)]), ("1,234.5만", [(12345000, 0, 8)]), ("7만. 8", [(70000, 0, 2), (8, 4, 5)]), ("3천 만명", [(30000000, 0, 4)]), ("1억 2 3", [(100000002, 0, 4), (3, 5, 6)]),
    ]
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string").select("i", text.numbers_column(F.col("t")).alias("n"))
    assert {r["i"]: [tuple(x) for x in r["n"]] for r in got.collect()} == {i: w for i, (_, w) in enumerate(cases)}


def test_periods(spark):
    day = dt.date
    rows = [("지난달", "M", day(2025, 3, 5), "202502"), ("작년", "M", day(2025, 3, 5), "202403"), ("지난분기", "Q", day(2025, 2, 1), "202404"), ("지난해 말", "M", day(2025, 6, 1), "202412"), ("2023년 3분기", "Q", day(2025, 6, 1), "202303"), ("1955~1960년", "Y", day(2025, 6, 1), "1960"), ("언젠가", "Y", day(2025, 6, 1), "언젠가"), (None, "Y", day(2025, 6, 1), None)]
    df = spark.createDataFrame(rows, "e string, f string, at date, want string")
    bad = df.select("e", "want", periods.normalize(F.col("e"), F.col("f"), F.col("at")).alias("got")).filter(~F.col("got").eqNullSafe(F.col("want"))).collect()
    assert not bad


def test_relative_periods(spark):
    day = dt.date(2025, 3, 5)
    rows = [("전전년", "Y", "2023"), ("전전년도", "M", "202303"), ("직전연도", "Y", "2024"), ("당월", "M", "202503"), ("다음달", "M", "202504"), ("4년여 전", "Y", "2021"), ("1955–1960년", "Y", "1960"), ("1955—1960", "M", "1960"), ("직전분기", "Q", "202404"), ("당분기", "Q", "202501"), ("2023년 12월", "M", "202312"), ("전년도 2분기", "Q", "202402"), ("연초", "M", "202501"), ("당해", "Y", "당해"), ("내년", "Y", "내년")]
    df = spark.createDataFrame([(*r, day) for r in rows], "e string, f string, want string, at date")
    assert not df.select("e", "want", periods.normalize(F.col("e"), F.col("f"), F.col("at")).alias("got")).filter(~F.col("got").eqNullSafe(F.col("want"))).collect()
    ok = [("전분기 대비", True), ("당해", True), ("1년새", True), ("지난주", True), ("최근", False), ("내년", False), ("20245", False), ("202413", True), (None, True)]
    assert [r[0] for r in spark.createDataFrame(ok, "e string, ok boolean").select(periods.valid(F.col("e")) == F.col("ok")).collect()] == [True] * len(ok)


def test_claim_values(spark):
    rows = [
        ("0~14세 인구가 줄었다.", None, "rate", None, None), ("3주 동안 20시간 일했다.", None, "level", None, None), ("46개월 만에 감소로 전환했다.", None, "rate", None, None), ("근속은 46개월이다.", "개월", "level", None, 46.0),
        ("수출이 320억 감소했다.", None, "rate", None, -3.2e10), ("15~29세 취업자 3천명이 늘었다.", "명", "rate", None, 3000.0), ("물가가 1.1% 낮아졌다.", "%", "rate", None, -1.1), ("물가가 1.1% 낮아졌다.", "%", "level", None, 1.1), ("물가가 1.1% 올랐다.", "%", "rate", "decrease", -1.1), (None, None, None, None, None),
    ]
    df = spark.createDataFrame([(i, *r[:4], None) for i, r in enumerate(rows)], "i int, sentence string, unit string, claim_type string, comparison_operator string, value double")
    got = {r["i"]: r["claim_value"] for r in text.claim_value(df, KOREAN).collect()}
    assert got == {i: r[4] for i, r in enumerate(rows)}


def test_expressions_are_counted(spark):
    rows = [("20.1%로 역대 최고치를 기록했다.", 1), ("인구가 역대 최고치를 기록했다.", 1), ("1위는 서울이다.", None), ("전국 4위 도시다.", 1), ("만족도는 6.4점이다.", 0), ("9만7000명 줄어 14개월째 감소다.", 2), ("3월의 날씨다.", None), ("지수는 116.38로 나타났다.", 1), ("2.5P대다.", None), ("두 배 늘었다.", 1)]
    got = {r["article_id"]: r["expressions"] for r in text.numeric_candidates(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "article_id int, text string"), KOREAN).collect()}
    assert got == {i: n for i, (_, n) in enumerate(rows) if n is not None}


def test_foreign_by_proper_nouns(spark):
    rows = [("노인 인도 통행", [], False), ("인도 수출", ["인도"], True), ("호주제 폐지", ["호주제"], False), ("일본", None, True), (None, ["인도"], False), ("인도", [None, "인도"], True)]
    df = spark.createDataFrame(rows, "p string, n array<string>, want boolean")
    assert not df.filter(claims.foreign(KOREAN, "p", nouns={"p": "n"}) != F.col("want")).collect()


def test_containing_by_lookup(spark, monkeypatch):
    """Terms tried one by one, found by automata in one part and in several, and looked up give the same pairs."""
    from factloom.operators import joins

    texts = spark.createDataFrame([("abcdefghijk",), ("xyz",), ("한국은행 총재",), ("",), ("aaaaaaaaaaaa",), (None,)], "t string")
    terms = spark.createDataFrame([(w, i) for i, w in enumerate(["abcdefghi", "abcdefghZ", "cde", "z", "은행", "", None, "aaaaaaaaaaa", "abcdefghijkl", "x", "x"])], "w string, n int")
    want = sorted(map(tuple, joins.containing(texts, "t", terms, "w").collect()))
    assert [(t, w) for t, w, _ in want] == [("aaaaaaaaaaaa", "aaaaaaaaaaa"), ("abcdefghijk", "abcdefghi"), ("abcdefghijk", "cde"), ("xyz", "x"), ("xyz", "x"), ("xyz", "z"), ("한국은행 총재", "은행")]
    for few, part, sent in ((0, 1 << 20, 1 << 20), (0, 20, 1 << 20), (0, 20, 0)):
        for name, x in (("FEW", few), ("PART_BYTES", part), ("SENT_BYTES", sent)):
            monkeypatch.setattr(joins, name, x)
        assert sorted(map(tuple, joins.containing(texts, "t", terms, "w").collect())) == want
        assert joins.containing(texts, "t", terms.limit(0), "w").count() == 0
        assert joins.containing(texts.limit(0), "t", terms, "w").count() == 0


def test_containing_many_terms(spark):
    """300,000 terms in one automaton, against plain Python."""
    from factloom.operators import joins

    terms = spark.range(300_000).select(F.concat(F.lit("k"), F.conv("id", 10, 36)).alias("w"))
    said = [" ".join("k" + x.upper() for x in (f"{i:x}", "zz", f"{i * 7:x}q")) for i in range(200)]
    got = {tuple(r) for r in joins.containing(spark.createDataFrame([(t,) for t in said], "t string"), "t", terms, "w").collect()}
    held = {r["w"] for r in terms.collect()}
    assert got == {(t, t[i:j]) for t in said for i in range(len(t)) for j in range(i + 1, min(len(t), i + 6) + 1) if t[i:j] in held}


def slow_nearest(x, k):
    import numpy as np

    n = x.astype(np.float64) / np.maximum(np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True), 1e-30)
    s = np.round(n @ n.T, 9)
    return {(i, r + 1): int(j) for i in range(len(x)) for r, j in enumerate(np.lexsort((np.arange(len(x)), -s[i]))[:k])}


@pytest.mark.parametrize("sent", [400, 1 << 20])
def test_vector_blocks(spark, monkeypatch, sent):
    import numpy as np

    from factloom.operators import vectors

    monkeypatch.setattr(vectors, "BLOCK_ROWS", 9)
    monkeypatch.setattr(vectors, "SENT_BYTES", sent)
    x = np.random.default_rng(1).normal(size=(70, 5)).astype(np.float32)
    x[3] = x[20] = x[21] = x[22] = 0
    x[10] = x[11]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    # what is no vector of this width is a zero vector
    rows[20], rows[21], rows[22] = (20, None), (21, [1.0] * 4), (22, [1.0, None, 1.0, float("nan"), 1.0])
    index = spark.createDataFrame(rows, "table_id long, embedding array<float>")
    got = vectors.vector_topk(index.withColumnRenamed("table_id", "qid"), index, 4)
    want = slow_nearest(x, 4)
    assert {(r["qid"], r["rank"]): r["table_id"] for r in got.collect()} == want
    assert vectors.vector_topk(index.limit(0).withColumnRenamed("table_id", "qid"), index).count() == 0
    assert vectors.vector_topk(index.withColumnRenamed("table_id", "qid"), index.limit(0)).count() == 0
    # all cells read is the exact search
    cells = vectors.CellIndex(index, cells=6)
    assert {(r["qid"], r["rank"]): r["table_id"] for r in cells.topk(index.withColumnRenamed("table_id", "qid"), 4, probes=6).collect()} == want


def test_cells_find_nine_of_ten(spark):
    import numpy as np

    from factloom.operators import vectors

    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 16))[rng.integers(0, 40, 3000)] + 0.4 * rng.normal(size=(3000, 16))
    index = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "table_id long, embedding array<float>")
    got = vectors.index_recall(index.filter("table_id % 20 = 0").withColumnRenamed("table_id", "qid"), index, k=5).collect()
    assert len(got) == 150 and all(r["k"] == 5 for r in got)
    assert got[0]["recall"] == sum(r["found"] for r in got) / 750 and got[0]["recall"] >= 0.9
    assert vectors.index_recall(index.limit(0).withColumnRenamed("table_id", "qid"), index.limit(0)).count() == 0


def test_trigrams_by_bounds(spark, monkeypatch):
    """Against all pairs; many rows share all but a query's rare trigrams, and frequent trigrams are split."""
    import random

    from factloom.operators import matching

    monkeypatch.setattr(matching, "HEAVY", 7)
    rng = random.Random(3)
    words = ["market", "markets", "red", "ring", "widget", "small", "grew", "the", "table", "of", "x"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    queries = [(i, say(rng.randint(1, 6))) for i in range(40)] + [(90, ""), (91, None), (92, "qqq"), (93, "the market grew")]
    index = [(i, say(rng.randint(1, 5))) for i in range(150)] + [(900, None), (901, ""), (902, "the market grew"), (903, "the market grew")]
    got = matching.trigram_topk(spark.createDataFrame(queries, "qid int, t string"), spark.createDataFrame(index, "table_id int, t string"), k=5)
    grams = lambda t: {f"  {w} "[i : i + 3] for w in (t or "").lower().split() for i in range(len(w) + 1)}
    want = {}
    for q, t in queries:
        a = grams(t)
        scores = sorted((-len(a & grams(x)) / len(a | grams(x)), i) for i, x in index if a & grams(x))
        want |= {(q, r + 1): i for r, (s, i) in enumerate([s for s in scores if -s[0] >= 0.1][:5])}
    assert {(r["qid"], r["rank"]): r["table_id"] for r in got.collect()} == want


def test_display_text(spark):
    """Worked cases of what a reader is shown."""
    block = "이 문단은 두 번 반복되어 나오는 관련 기사 안내문입니다 "
    cases = [
        ("메뉴 입력 2024.01.02. 03:04 홈 입력2024.01.02. 05:06 업데이트 2024.01.02.  07:08 23 본문이다. 끝.", "본문이다. 끝."),
        ("앞 Video Player is loading. 재생\n자막 End of dialog window. 뒤 By Taboola 광고", "앞   뒤"),
        (block + block + block + "본문", block + "본문"),
        ("하나. 둘? 셋! 넷. 46.1%로 2023년. 3명", "하나. 둘? 셋!\n\n넷. 46.1%로 2023년. 3명"),
        ("줄이 있다.\n둘. 셋. 넷. 다섯.", "줄이 있다.\n둘. 셋. 넷. 다섯."),
        ("\u3000 안쪽 \ufeff", "안쪽"), ("", ""), (None, None), ("짧은 짧은 짧은 짧은", "짧은 짧은 짧은 짧은"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "article_id int, text string")
    assert {r["article_id"]: r["text"] for r in text.shown_text(df, KOREAN).collect()} == {i: w for i, (_, w) in enumerate(cases)}


def test_repeats_are_those_of_trying_all_lengths():
    import random

    from factloom.operators import repeats

    def slow(t, least, most):
        out, i = "", 0
        while i < len(t):
            n = next((n for n in range(min(most, (len(t) - i) // 2), least - 1, -1) if t[i : i + n] == t[i + n : i + 2 * n]), 0)
            out += t[i : i + (n or 1)]
            i += n or 1
            while n and t[i : i + n] == t[i - n : i]:
                i += n
        return out

    rng = random.Random(1)
    for k in range(300):
        s = "".join(rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 120)))
        b = "".join(rng.choice("abcdefg ") for _ in range(rng.randint(15, 320)))
        s = s + b * (k % 4) + b[: rng.randint(0, len(b))] + s
        assert repeats.collapse(s) == slow(s, 20, 300) and repeats.collapse(s, 3, 40) == slow(s, 3, 40)


def test_series_index(spark):
    """Extremes of any stretch against plain Python: gaps, repeated and missing values, units, mixed frequencies, odd periods."""
    import random

    from factloom.operators import series

    rng = random.Random(6)
    months = [f"{y}{m:02d}" for y in (2020, 2021, 2022) for m in range(1, 13)] + ["2020", "2021", "2022"]
    obs = [(c, "A", "F", p, rng.choice([None, 1.0, 2.0, 3.0, -4.5]), "w" if (c, p) == (2, "202106") else "u") for c in (1, 2, 3) for p in rng.sample(months, 20) for _ in range(rng.choice([1, 1, 2]))] + [(1, "A", "F", "bad", 99.0, "u"), (1, "A", "F", None, 99.0, "u"), (4, "A", "F", "202213", 1.0, "u")]
    ends = [*months, "201912", "202301", "bad", None]
    asks = [(i, rng.choice([1, 2, 3, 4, 5]), "A", "F", rng.choice(ends), rng.choice(ends)) for i in range(300)]
    o = spark.createDataFrame(obs, "table_id int, item_id string, dim string, period string, value double, unit string")
    a = spark.createDataFrame(asks, "claim_id int, table_id int, item_id string, dim string, start_period string, end_period string")
    for high in (True, False):
        want = {}
        for i, c, _, _, lo, hi in asks:
            here = [(-v if high else v, p, u) for x, _, _, p, v, u in obs if x == c and v is not None and p in months and lo in months + ends[-4:-2] and hi in months + ends[-4:-2] and lo <= p <= hi]
            if here:
                v, p, _ = min(here)
                want[i] = ("mixed_units", None, None) if len({u for *_, u in here}) > 1 else ("ok", -v if high else v, p)
        assert {r["claim_id"]: (r["status"], r["value"], r["period"]) for r in series.range_extremes(a, o, high).collect()} == want


def test_computed_claims(spark):
    obs = spark.createDataFrame([(1, "A", "F", p, v, "u") for p, v in (("202301", 4.0), ("202302", 2.0), ("202401", 5.0), ("202402", None))] + [(2, "A", "F", "202401", 1.0, "u"), (2, "A", "F", "202401", 2.0, "w")], "table_id int, item_id string, dim string, period string, value double, unit string")
    ask = lambda i, kind, t, p, s=None: (i, kind, t, "A", "F", p, s)
    rows = [ask(1, "lookup", 1, "202401"), ask(2, None, 1, "202402"), ask(3, "lookup", 1, "199901"), ask(4, "lookup", 9, "202401"), ask(5, "lookup", 2, "202401"), ask(6, "rate", 1, "202401"), ask(7, "change", 1, "202401"), ask(8, "rate", 1, "202301"), ask(9, "max_check", 1, "202401", "202301"), ask(10, "min_check", 1, "202401", "202301"), ask(11, "max_check", 1, "202201", "202101"), ask(12, "max_check", 9, "202401", "202301"), ask(13, "min_check", 2, "202401", "202401"), ask(14, "rate", 1, None)]
    df = spark.createDataFrame(rows, "claim_id int, calc_type string, table_id int, item_id string, dim string, period string, start_period string")
    got = {r["claim_id"]: (r["status"], r["value"], r["period"]) for r in compute.compute(df, obs).collect()}
    assert got == {
        1: ("ok", 5.0, "202401"), 2: ("no_value", None, "202402"), 3: ("other_period", None, "199901"), 4: ("none", None, "202401"), 5: ("many", None, "202401"), 6: ("ok", 25.0, "202301~202401"), 7: ("ok", 1.0, "202301~202401"), 8: ("no_base", None, "202201~202301"),
        9: ("ok", 5.0, "202401"), 10: ("ok", 2.0, "202302"), 11: ("empty", None, None), 12: ("empty", None, None), 13: ("mixed_units", None, None), 14: ("none", None, ""),
    }


def test_upserted_table_keeps_late_columns(spark):
    from factloom.sources import sinks

    path = sinks.staging_dir(spark, "late")
    rows = lambda *ids: spark.createDataFrame([(i, "a", 1) for i in ids], "id int, v string, seq int")
    sinks.write_upsert(path, rows(*range(100)), "id", 4)
    sinks.write_upsert(path, spark.createDataFrame([(i, "b", "new", 2) for i in (5, 50, 200)], "id int, v string, late string, seq int"), "id", 4)
    sinks.write_upsert(path, rows(*[i for i in range(100) if i != 50]), "id", 4)
    got = {r["id"]: (r["v"], r["late"]) for r in sinks.read_upserted(spark, path).collect()}
    assert got == {i: ("a", None) for i in range(100)} | {50: ("b", "new"), 200: ("b", "new")}


def test_shared_folder_must_be_named_on_a_cluster(spark):
    from types import SimpleNamespace

    from factloom.session import shared_folder

    conf = SimpleNamespace(get=lambda *_: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://host:7077", applicationId="x"))
    with pytest.raises(RuntimeError):
        shared_folder(cluster, "any")


def test_base_periods(spark):
    df = spark.createDataFrame([("202501", "M"), ("202501", "Q"), ("2024", "Y"), (None, "M")], "p string, f string")
    got = [tuple(r) for r in df.select(periods.prior_year(F.col("p")), periods.prior_immediate(F.col("p"), F.col("f"))).collect()]
    assert got == [("202401", "202412"), ("202401", "202404"), ("2023", "2023"), (None, None)]


def test_tolerance_and_rule(spark):
    cols = "claim_value double, claim_unit string, claim_type string, value_type string, claim_period string, calc_type string, computed_value double, computed_unit string, computed_period string"
    rows = [
        (-1.1, "%", "rate", "level", "2024", "rate", -1.15, "%", "2023~2024"),
        (135000.0, "명", "level", "delta", "2024", "change", 135000.0, "명", "2023~2024"),
        (10.0, "톤", "level", "level", "2024", "lookup", 10.0, "천달러", "2024"),
        (6.0, "%", "level", "level", "2024", "max_check", 6.0, "2020＝100", "2024"),
        (5.0, "명", "level", "level", "1955", "lookup", 5.0, "명", "2024"),
        (5.0, "명", "level", "level", "2024", "lookup", 5.0, "명", None),
        (None, "명", "level", "level", "2024", "lookup", 5.0, "명", "2024"),
    ]
    got = [r["verdict"] for r in verdict.rule_verdict(spark.createDataFrame(rows, cols)).collect()]
    assert got == ["match", "match", None, None, None, None, None]


def test_ratio_and_rate(spark):
    cells = spark.createDataFrame([(1, v, "명", True) for v in (33840.0, 27218.0, 22904.0, 22915.0)] + [(1, 166558.0, "명", False), (2, 1.0, "명", True), (2, 0.0, "명", False), (3, 1.0, "명", True), (3, 1.0, "톤", False)], "claim_id int, value double, unit string, part boolean")
    got = {r["claim_id"]: (r["status"], r["value"]) for r in compute.agg_ratio(cells).collect()}
    assert got == {1: ("ok", 64.2), 2: ("zero_base", None), 3: ("mixed_units", None)}
    pair = spark.createDataFrame([(98.7, 125.4), (1.0, 0.0)], "value double, base_value double")
    assert [r[0] for r in pair.select(compute.change_rate()).collect()] == [-21.3, None]


def test_backfill_prefers_official_source(spark):
    rows = [("a", 1, "Kim", "uncertain"), ("a", 2, "Kim", "uncertain"), ("a", 3, "통계청", "verified"), ("a", 4, None, None), ("b", 1, None, None)]
    got = claims.backfill(spark.createDataFrame(rows, "article_id string, pos int, source_org string, source_class string"))
    assert {(r["article_id"], r["pos"]): r["source_org"] for r in got.collect()} == {("a", 1): "Kim", ("a", 2): "Kim", ("a", 3): "통계청", ("a", 4): "통계청", ("b", 1): None}


def test_routing(spark):
    rows = [("rate", "level", "x", None, "rate"), ("compare", None, "x", None, "change"), ("forecast", None, "x", None, None), (None, None, "x", None, None), ("level", "delta", "x", None, "change"), ("level", "level", "9년 만에 최고", None, "max_check"), ("level", "level", "역대 최저", None, "min_check"), ("rate", None, "x", "일본", None)]
    df = spark.createDataFrame(rows, "claim_type string, value_type string, sentence string, region string, want string")
    assert not df.filter(~claims.route(KOREAN, "region").eqNullSafe(F.col("want"))).collect()


def test_sentences_and_dedupe(spark):
    lead = "이 문장은 서른 글자가 넘도록 길게 적은 머리말 문장이라서 한 번만 남아야 합니다."
    df = spark.createDataFrame([(1, f"{lead} 짧다. {lead} 짧다."), (2, None), (3, "")], "article_id int, text string")
    got = {r["article_id"]: r["text"] for r in text.dedupe_sentences(df, KOREAN).collect()}
    assert got == {1: f"{lead} 짧다. 짧다."}
    once = spark.createDataFrame(list(got.items()), "article_id int, text string")
    assert text.dedupe_sentences(once, KOREAN).collect()[0]["text"] == got[1]


def test_chunks_rejoin(spark):
    long = "".join(f"sentence number {i}. " for i in range(900))
    df = spark.createDataFrame([(1, long), (2, "short"), (3, None), (4, "x" * 7001)], "article_id int, text string")
    rows = text.chunks(df).orderBy("article_id", "chunk").collect()
    assert all(len(r["text"]) <= 3000 for r in rows)
    assert "".join(r["text"] for r in rows if r["article_id"] == 1) == long
    assert [len(r["text"]) for r in rows if r["article_id"] == 4] == [3000, 3000, 1001]


def test_replies_are_salvaged(spark):
    whole = '[{"sentence": "a 1", "claim_type": "level", "value": "1", "unit": "명"}, {"sentence": "b", "claim_type": null}]'
    df = spark.createDataFrame([(1, 0, whole), (2, 0, whole[:70] + ', {"sentence": "cut'), (3, 0, "no array"), (4, 0, None)], "article_id int, chunk_no int, reply string")
    got = sorted(((r["article_id"], r["sentence"], r["error"]) for r in text.parse_replies(df).collect()), key=repr)
    assert got == [(1, "a 1", False), (2, "a 1", False), (3, None, True), (4, None, True)]


def test_located_claims_do_not_overlap(spark):
    a = spark.createDataFrame([(1, "one two three")], "article_id long, text string")
    c = spark.createDataFrame([(1, 1, "one two"), (1, 2, "two three"), (1, 3, "three"), (1, 4, "none")], "article_id long, claim_id long, sentence string")
    located = ranking.locate_claims(a, c)
    assert {r["claim_id"]: r["kept"] for r in located.collect()} == {1: True, 2: False, 3: True, 4: False}
    parts = ranking.segments(a, located).orderBy("pos").collect()
    assert [(r["text"], r["claim_no"]) for r in parts] == [("one two", 1), (" ", None), ("three", 2)]


def test_upsert_is_idempotent(spark):
    from factloom.sources.sinks import upsert

    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    batch = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id int, v string, seq int")
    once = upsert(old, batch, "id")
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "d"), (3, "e")]
    assert sorted(map(tuple, upsert(once, batch, "id").collect())) == sorted(map(tuple, once.collect()))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "article_id int, text string")
    assert text.sentences(none, KOREAN).count() == 0
    assert text.chunks(none).count() == 0
    cells = spark.createDataFrame([], "claim_id int, value double, unit string, period string")
    assert compute.agg_sum(cells).count() == 0 and compute.extreme_check(cells).count() == 0


def test_rematching_is_greedy_and_one_to_one(spark):
    from factloom.operators.evaluation import rematch_numbers

    gold = spark.createDataFrame([(1, 10, "up 25 percent"), (1, 11, "25 again"), (1, 12, "only 7"), (2, 20, "1,200 people")], "article_id long, gold_id long, sentence string")
    claims_ = spark.createDataFrame([(1, 100, 0, "it rose 25"), (1, 101, 1, "7 days"), (2, 200, 0, "1200 came"), (3, 300, 0, "25")], "article_id long, claim_id long, pos int, sentence string")
    assert sorted(map(tuple, rematch_numbers(gold, claims_).collect())) == [(1, 10, 100), (2, 20, 200)]


def test_tiebreak_reorders_runs_only(spark):
    from factloom.operators.matching import simplicity_tiebreak

    rows = [(1, 1, 7, 0.0300, "a/b/c"), (1, 2, 8, 0.0290, "a"), (1, 3, 9, 0.0280, "a/b"), (1, 4, 6, 0.0200, "a/b"), (2, 1, 5, 0.1, "a/b")]
    got = simplicity_tiebreak(spark.createDataFrame(rows, "claim_id long, place int, table_id long, score double, title string")).orderBy("claim_id", "place").collect()
    assert [(r["claim_id"], r["table_id"]) for r in got] == [(1, 8), (1, 7), (1, 9), (1, 6), (2, 5)]


def test_pages_give_their_text(spark):
    from factloom.sources.readers import extract_articles

    body = 'x<script>Fusion.globalContent={"content_elements":[{"type":"text","content":"<b>A &amp; {B}</b>"},{"type":"image"},{"type":"text","content":"second"}]};more</script><p>no</p>'
    rows = [(1, body), (2, "<p>one &lt;</p><p> </p><p>two</p>"), (3, 'Fusion.globalContent={"broken'), (4, None)]
    got = {r["page_id"]: r["text"] for r in extract_articles(spark.createDataFrame(rows, "page_id int, html string")).collect()}
    assert got == {1: "A & {B}\n\nsecond", 2: "one <\n\ntwo", 3: None, 4: None}


def test_display_text_joins_repeats_and_groups_sentences(spark):
    from factloom.functions.locale import ENGLISH

    lead = "This block of text comes twice here. "
    df = spark.createDataFrame([(1, f"{lead}{lead}One. Two. Three. All rights reserved"), (2, None)], "article_id int, text string")
    got = [(r["paragraph"], r["text"]) for r in text.display_text(df, ENGLISH).orderBy("paragraph").collect()]
    assert got == [(0, "This block of text comes twice here. One. Two."), (1, "Three.")]


def test_slot_state_across_batches(spark):
    from factloom.sources.sinks import staging_dir
    from factloom.streaming.verify import slot_state

    path, out, ck = (staging_dir(spark, n) for n in ("turns", "slots", "ck"))
    for rows in ([(1, 0, None, "a")], [(1, 1, "2024", "b"), (2, 0, None, None)], [(1, 2, "2025", None)]):
        spark.createDataFrame(rows, "conv_id long, turn long, period string, region string").coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema("conv_id long, turn long, period string, region string").parquet(path)
        slot_state(stream, ["period", "region"]).writeStream.format("parquet").option("checkpointLocation", ck).option("path", out).trigger(availableNow=True).start().awaitTermination()
    got = {(r["conv_id"], r["turn"]): (r["period"], r["region"]) for r in spark.read.parquet(out).collect()}
    assert got == {(1, 0): (None, "a"), (1, 1): ("2024", "a"), (1, 2): ("2024", "a"), (2, 0): (None, None)}


def test_versions_change_in_one_step(spark, monkeypatch):
    """A failure before the commit leaves the old version whole; a clash starts over; a repeated batch changes nothing."""
    from factloom.sources import sinks, versioned

    root = sinks.staging_dir(spark, "versions")
    rows = lambda v, *ids: spark.createDataFrame([(i, v, 1) for i in ids], "id int, v string, seq int")
    table = lambda n=None: {r["id"]: r["v"] for r in sinks.read_upserted(spark, root, n).collect()}
    assert sinks.read_upserted(spark, root) is None and versioned.versions(spark, root) == []
    assert sinks.write_upsert(root, rows("a", *range(20)), "id", 4, "s", 0) == 1
    assert sinks.write_upsert(root, rows("b", 3, 4), "id", 4, "s", 1) == 2
    assert sinks.write_upsert(root, rows("never", 3, 4), "id", 4, "s", 1) == 2 and table()[3] == "b"
    real = versioned.commit

    def fails(*_):
        raise OSError("lost between write and commit")

    monkeypatch.setattr(versioned, "commit", fails)
    with pytest.raises(OSError):
        sinks.write_upsert(root, rows("c", *range(20)), "id", 4)
    monkeypatch.setattr(versioned, "commit", real)
    assert table() == {i: "b" if i in (3, 4) else "a" for i in range(20)} and table(1) == dict.fromkeys(range(20), "a")

    def late(s, path, content, once=[]):
        if not once:  # another writer is faster
            once.append(1)
            sinks.write_upsert(root, rows("other", 5), "id", 4)
        real(s, path, content)

    monkeypatch.setattr(versioned, "commit", lambda s, path, content: (monkeypatch.setattr(versioned, "commit", real), late(s, path, content)))
    assert sinks.write_upsert(root, rows("mine", 6), "id", 4) == 4
    assert (table()[5], table()[6]) == ("other", "mine") and versioned.versions(spark, root) == [1, 2, 3, 4]
    with pytest.raises(versioned.Clash):
        versioned.commit(spark, root, {"version": 4, "tables": {}, "batches": {}})
    with pytest.raises(ValueError):
        sinks.read_upserted(spark, root, 9)
    before = table()
    assert versioned.vacuum(spark, root, keep=1) > 0 and table() == before and versioned.versions(spark, root) == [4]
    assert sinks.write_upsert(root, rows("z").limit(0), "id", 4) == 5 and table() == before


def test_article_stream_is_taken_once(spark):
    """A micro-batch that runs again, as after a failure, changes nothing; an article that comes again replaces its records."""
    from factloom.functions.locale import ENGLISH
    from factloom.sources import sinks, versioned
    from factloom.streaming import articles as st

    obs = spark.createDataFrame([(1, "A", "F", "2020", 10.0, "units")], "table_id int, item_id string, dim string, period string, value double, unit string")
    claims = spark.createDataFrame([(1, 7, "It shipped 10 units.", 10.0, "units", "level", "level", "2020"), (2, 7, "It shipped 99 units.", 99.0, "units", "level", "level", "2020"), (3, 8, "No match.", 5.0, "units", "level", "level", "2020")], "claim_id int, article_id int, sentence string, claim_value double, claim_unit string, claim_type string, value_type string, claim_period string")
    matches = spark.createDataFrame([(1, "lookup", 1, "A", "F", "2020", "2020", "units"), (2, "lookup", 1, "A", "F", "2020", "2020", "units")], "claim_id int, calc_type string, table_id int, item_id string, dim string, period string, start_period string, computed_unit string")
    articles = spark.createDataFrame([(7, "It shipped 10 units. It shipped 99 units."), (8, "No match. Nothing."), (8, "No match. Nothing.")], "article_id int, text string")

    def chain(batch):
        records = st.records_of(batch, claims, matches, obs)
        return {"records": (records, "claim_id"), "articles": (st.article_export(batch, records, ENGLISH), "article_id")}

    path, target, mark = (sinks.staging_dir(spark, n) for n in ("in", "out", "mark"))
    articles.write.parquet(path)
    source = spark.readStream.schema(articles.schema).parquet(path)
    st.article_stream(source, chain, target, mark, 2).awaitTermination()
    want = ({(1, "match"), (2, None), (3, None)}, {(7, 2, 2, 1), (8, 0, 1, 0)})
    held = lambda: ({(r["claim_id"], r["verdict"]) for r in versioned.snapshot(spark, target, "records").collect()}, {tuple(r) for r in versioned.snapshot(spark, target, "articles").select("article_id", "n_expressions", "n_claims", "n_match").collect()})
    assert held() == want and versioned.snapshot(spark, target, "records").count() == 3
    assert versioned.upsert_tables(spark, target, chain(articles.limit(0)), sinks.upsert, 2, (mark, 0)) == 1 and held() == want
    articles.filter("article_id = 7").write.mode("append").parquet(path)
    st.article_stream(source, chain, target, mark, 2).awaitTermination()
    assert held() == want and versioned.versions(spark, target) == [1, 2]


def test_ordered_slots(spark):
    """Turns that come late, twice and in any order; state that ends after an hour without turns."""
    import datetime as dt

    from factloom.sources.sinks import staging_dir
    from factloom.streaming.slots import ordered_slots

    path, out, mark = (staging_dir(spark, n) for n in ("turns", "slots", "mark"))
    day = lambda minute: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)
    batches = [
        [(1, 1, day(2), "late 2024", None), (2, 0, day(1), None, None), (1, 2, day(3), "2025", "south")],
        [(1, 0, day(0), None, "north"), (1, 1, day(2), "late 2024", None), (None, 3, day(3), "x", "x"), (2, None, day(3), "x", "x")],
        [(3, 0, day(60), "far", None)],  # the watermark passes the first turns
        [(1, 3, day(1), "too late", "too late"), (1, 4, day(70), None, None), (3, 1, day(200), None, None)],
        [(1, 5, day(210), None, "new"), (9, 0, day(2000), None, None)],  # after an hour of silence nothing is known
        [(9, 1, day(9000), None, None)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, "conv_id long, turn int, said timestamp, period string, region string").coalesce(1).write.mode("append").parquet(path)
        source = spark.readStream.schema("conv_id long, turn int, said timestamp, period string, region string").parquet(path)
        got = ordered_slots(source, ["period", "region"], "said")
        got.writeStream.format("parquet").option("checkpointLocation", mark).option("path", out).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    rows = {(r["conv_id"], r["turn"]): (r["period"], r["region"]) for r in spark.read.parquet(out).collect() if r["conv_id"] < 9}
    assert rows == {(1, 0): (None, "north"), (1, 1): ("late 2024", "north"), (1, 2): ("late 2024", "north"), (2, 0): (None, None), (3, 0): ("far", None), (1, 4): (None, None), (3, 1): (None, None), (1, 5): (None, "new")}


def test_stale_joins_only_what_changed(spark):
    """A few changes among many rows: the same answer as a full join, from the rows of their ranges alone."""
    from factloom.sources import sinks

    catalog = spark.range(20_000).selectExpr("id as table_id", "concat('text ', id) as text")
    cache = catalog.filter("table_id not in (5, 6)").selectExpr("table_id", "if(table_id = 77, 'old', text) as text", "if(table_id = 99, 'm1', 'm2') as model").unionByName(spark.sql("select cast(-4 as bigint) as table_id, 'x' as text, 'm2' as model"))
    assert {tuple(r) for r in sinks.stale(catalog, cache, "m2").collect()} == {(5, "new"), (6, "new"), (77, "text"), (99, "model"), (-4, "gone")}
    assert sinks.stale(catalog, catalog.selectExpr("*", "'m2' as model"), "m2").count() == 0
    assert sinks.stale(catalog.limit(3), cache.limit(0), "m2").count() == 3 and sinks.stale(catalog.limit(0), cache.limit(3), "m2").count() == 3
    a, b = (sinks.range_digests(x.withColumn("model", F.lit("m2")), "table_id", ["text", "model"]) for x in (catalog, cache))
    assert a.count() <= 4096 and a.exceptAll(b).count() <= 4


def test_crawl_goes_on_where_it_stopped(spark):
    from factloom.operators import catalog
    from factloom.session import shared_folder

    rows = [("A", 0, 1, None), ("A", 0, 2, None), ("A", 1, 0, None), ("A", 1, 3, None), ("A", 3, 1, None), ("A", 3, None, 10), ("A", 2, None, 10), ("B", 0, None, 11), ("B", 7, None, 12), ("A", 3, 3, None), ("A", 9, 8, None)]
    items = spark.createDataFrame(rows, "view string, parent_id long, list_id long, table_id long")
    roots = spark.createDataFrame([("A", 0), ("B", 0), ("A", 0)], "view string, list_id long")
    folder = shared_folder(spark, "crawl")
    want = ({("A", 10, 2), ("B", 11, 1)}, {("A", 0, 0), ("B", 0, 0), ("A", 1, 1), ("A", 2, 1), ("A", 3, 2)})
    catalog.crawl(items, roots, folder, most_levels=2)
    for _ in range(2):  # goes on, then finds all done
        tables, seen = catalog.crawl(items, roots, folder)
        assert ({tuple(r) for r in tables.collect()}, {tuple(r) for r in seen.select("view", "list_id", "level").collect()}) == want
    tables, seen = catalog.crawl(items, roots.limit(0), shared_folder(spark, "crawl"))
    assert tables.count() == seen.count() == 0
