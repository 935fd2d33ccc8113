"""Work that must grow with distinct texts and kinds of tables, not with pairs of rows; results against plain models."""

import random
import re
import time

from pyspark.sql import functions as F

from factloom.operators import matching


def most_rows(spark, df, step: str = "") -> int:
    """Runs df; the most rows that any step of its plan, of those with that in their name, puts out."""
    df.write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = spark._jsparkSession.sharedState().statusStore()
    run = store.executionsList().last().executionId()
    values, nodes, most = store.executionMetrics(run), store.planGraph(run).allNodes(), 0
    for i in range(nodes.size()):
        metrics = nodes.apply(i).metrics()
        for j in range(metrics.size() if step in nodes.apply(i).name() else 0):
            if metrics.apply(j).name() == "number of output rows":
                value = values.get(metrics.apply(j).accumulatorId())
                most = max(most, int(value.get().replace(",", "")) if value.isDefined() else 0)
    return most


WORDS = ["redring", "ring", "red", "gears", "gear", "widget", "widely", "market", "bolts", "plate"]


def _asked(rng, spark):
    """Claims, a catalog and synonyms of few words; ids, texts and keywords that are null or come twice."""
    say = lambda a, b: " ".join(rng.choice(WORDS) for _ in range(rng.randint(a, b)))
    claims = [(i % 35, say(1, 5)) for i in range(40)] + [(90, None), (91, ""), (92, "nothing here")]
    catalog = [(i % 55, [rng.choice(WORDS) for _ in range(rng.randint(0, 3))], say(1, 2)) for i in range(60)] + [(100, None, "red ri"), (101, ["gear", None], None), (None, ["gear"], "widget")]
    synonyms = [("market", "widget"), ("red", "gear")]
    frames = spark.createDataFrame(claims, "claim_id long, sentence string"), spark.createDataFrame(catalog, "table_id long, keywords array<string>, title string"), spark.createDataFrame(synonyms, "term string, target string")
    scores = []
    for c, t in claims:
        if t is None:
            continue
        n, of = re.sub(r"\s+", "", t), {}
        meant = {b for a, b in synonyms if a in t}
        for table, kws, title in catalog:
            for kw in kws or []:
                false = lambda kw=kw: kw == "ring" and "ring" in n and "ring" not in n.replace("redring", "")
                if kw is None:
                    continue
                w = 1.0 if kw in n and not false() else 0.5 if kw in meant else 1.0 if len(kw) >= 5 and kw[:5] in n and not false() else 0
                if w:
                    of[table] = of.get(table, 0) + w
            if title and title[:6] in t:
                of[table] = of.get(table, 0) + 1
        scores += [(c, k, round(min(1.0, s / 3), 6)) for k, s in of.items()]
    return frames, scores


def _plain_topk(scores, k):
    by = {}
    for c, table, s in scores:
        by.setdefault(c, []).append((-s, -1 if table is None else table))
    return sorted((c, -1 if t is None else t, r + 1, -s) for c, rows in by.items() for r, (s, t) in enumerate(sorted(rows)[:k]))


def test_keyword_search_is_the_top_of_all_scores(spark):
    for seed in range(2):
        frames, want = _asked(random.Random(seed), spark)
        got = [(r["claim_id"], r["table_id"], round(r["score"], 6)) for r in matching.keyword_scores(*frames, {"ring": ["redring"]}).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
        top = matching.keyword_search(*frames, {"ring": ["redring"]}, k=3)
        assert sorted((r["claim_id"], -1 if r["table_id"] is None else r["table_id"], r["rank"], round(r["score"], 6)) for r in top.collect()) == _plain_topk(want, 3)


def _many_alike(spark, tmp_path, suppliers=400, parts=3000):
    """Tables of few names, as the given ones: each name stands in many rows."""
    names = [f"{a} {b}" for a in ("red", "old", "hot", "new") for b in ("ring", "gear", "widget")]
    spark.createDataFrame([(i, i % 25, 1.0) for i in range(suppliers)], "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(i, names[i % 12], "Brand#1", "SMALL", 1) for i in range(parts)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_keyword_topk_makes_no_pairs(spark, tmp_path):
    from factloom import registry

    d = _many_alike(spark, tmp_path)
    assert most_rows(spark, registry.queries()["m6_keyword_topk"](spark, d)) <= 10 * 3000  # 825,750 when each claim met all its tables


def test_trigram_topk_makes_no_pairs(spark, tmp_path):
    from factloom import registry

    d = _many_alike(spark, tmp_path)
    assert most_rows(spark, registry.queries()["m5_trigram_topk"](spark, d)) <= 400 * 30 * 2  # 600,000 when each query met its rows of the index


def test_trigram_topk_of_many_alike(spark):
    """Texts that many queries and many rows of the index share, ids that come twice with the same and with other texts."""
    rng = random.Random(5)
    say = lambda a, b: " ".join(rng.choice(WORDS) for _ in range(rng.randint(a, b)))
    said, titles = [say(1, 3) for _ in range(6)], [say(1, 2) for _ in range(8)]
    queries, index = [(i % 25, rng.choice(said)) for i in range(30)], [(i % 70, rng.choice(titles)) for i in range(80)]
    got = matching.trigram_topk(spark.createDataFrame(queries, "qid int, t string"), spark.createDataFrame(index, "table_id int, t string"), k=4)
    grams = lambda t: {f"  {w} "[i : i + 3] for w in t.split() for i in range(len(w) + 1)}
    scores = [(q, x, len(grams(a) & grams(b)) / len(grams(a) | grams(b))) for q, a in queries for x, b in index]
    assert sorted((r["qid"], r["table_id"], r["rank"], r["score"]) for r in got.collect()) == _plain_topk([s for s in scores if s[2] >= 0.1], 4)


def test_match_makes_no_pairs(spark, tmp_path):
    from factloom import registry

    d = _many_alike(spark, tmp_path)
    assert most_rows(spark, registry.queries()["m20_match"](spark, d)) <= 400 * 35 * 2


def test_keyword_scores_go_out_in_blocks(spark, tmp_path, monkeypatch):
    """Nothing before the last two steps holds more than blocks; ids that are null or repeated are all told of."""
    from factloom.plans import matching_queries as q

    d = _many_alike(spark, tmp_path)
    pairs = q.m1(spark, d)
    assert pairs.count() == pairs.select("claim_id", "table_id").distinct().count() > 500_000
    assert joined_rows(spark, pairs) <= 20_000  # 825,750 when the last join gave pairs
    monkeypatch.setattr(matching, "BLOCK", 3)
    for seed in range(2, 4):
        frames, want = _asked(random.Random(seed), spark)
        more = frames[0].unionByName(spark.sql("select cast(null as bigint) as claim_id, 'red market' as sentence from range(2)"))
        lost = [(None, t, s) for c, t, s in matching_scores(spark, frames, "red market") for _ in range(2)]
        got = [(r["claim_id"], r["table_id"], r["score"]) for r in matching.keyword_scores(more, *frames[1:], {"ring": ["redring"]}, digits=6).collect()]
        assert sorted(got, key=repr) == sorted(want + lost, key=repr)


def matching_scores(spark, frames, sentence):
    """(claim_id, table_id, score) of one sentence."""
    one = spark.createDataFrame([(1, sentence)], "claim_id long, sentence string")
    return [tuple(r) for r in matching.keyword_scores(one, *frames[1:], {"ring": ["redring"]}, digits=6).collect()]


def joined_rows(spark, df) -> int:
    """Runs df; the most rows that any join of its plan puts out."""
    return most_rows(spark, df, "Join")


def test_shuffle_files_of_written_steps_go(spark):
    from factloom.session import written

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f.getName() for f in (all_files.apply(i) for all_files in [disk.getAllFiles()] for i in range(all_files.size())) if f.getName().startswith("shuffle_")}
    before = files()
    got = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "grouped")
    assert got.count() == 7
    for _ in range(50):  # they go beside the job
        if not (left := {f for f in files() - before if f.endswith(".data")}):
            break
        time.sleep(0.1)
    assert len(left) <= 1  # that of the count() above


def test_batch_of_a_versioned_table_is_worked_out_once(spark):
    from factloom.sources import sinks

    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(i):
        seen.add(1)
        return i

    root = sinks.staging_dir(spark, "once")
    for n in range(2):
        rows = spark.range(20).select(counted("id").alias("id"), F.lit(n).alias("v"), F.lit(n).alias("seq"))
        sinks.write_upsert(root, rows, "id", 4)
    assert seen.value == 40
    assert sorted(map(tuple, sinks.read_upserted(spark, root).collect())) == [(i, 1) for i in range(20)]


def test_records_of_articles_in_few_shuffles(spark):
    """Claims meet their matches once and their cells once; one without a match has nulls."""
    from factloom.streaming import articles as st

    obs = spark.sql("select 1L as table_id, 'A' as item_id, 'F' as dim, '2020' as period, 10.0D as value, 'units' as unit")
    claims = spark.sql("select id as claim_id, 7L as article_id, 'x' as sentence, 10.0D as claim_value, 'units' as claim_unit, 'level' as claim_type, 'level' as value_type, '2020' as claim_period from range(3)")
    matches = spark.sql("select id as claim_id, case id when 0 then 'lookup' end as calc_type, 1L as table_id, 'A' as item_id, 'F' as dim, '2020' as period, '2020' as start_period, 'units' as computed_unit from range(2)")
    got = st.records_of(spark.sql("select 7L as article_id, 'x' as text from range(2)"), claims, matches, obs)
    assert sorted((r["claim_id"], r["calc_type"], r["status"], r["computed_value"], r["computed_period"], r["verdict"]) for r in got.collect()) == [
        (0, "lookup", "ok", 10.0, "2020", "match"), (1, "lookup", "ok", 10.0, "2020", "match"), (2, None, None, None, None, None)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = st.records_of(spark.range(5).selectExpr("id as article_id", "'x' as text"), claims, matches, obs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") <= 12
