"""The streaming forms over staged copies of the given tables, run until all is processed."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from factloom.operators import verdict as j
from factloom.registry import query
from factloom.session import spent_shuffles, written
from factloom.sources.sinks import read_upserted, staging_dir
from factloom.sources.versioned import snapshot
from factloom.streaming import articles
from factloom.streaming import verify as st
from factloom.streaming.slots import ordered_slots

from .compute_queries import _JUDGED, _KIND, _RULE, judged, reqs
from .packs import ENGLISH
from .text_queries import _CANDS, _CLAIM_SENTENCES, _claim_articles
from .views import over, table


def _stream(df, name: str):
    path = staging_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(path)


def _in_files(df, name: str, rows: int, files: int) -> str:
    """A folder with df in as many files as it has tasks, in some `files` at least, by its number of rows."""
    path = staging_dir(df.sparkSession, name)
    with spent_shuffles(df.sparkSession):
        df.write.option("maxRecordsPerFile", max(1, -(-rows // files))).parquet(path)
    return path


def _in_two(spark, path: str):
    """A stream of the folder's files that takes them in two micro-batches."""
    held = spark.read.parquet(path)
    return spark.readStream.schema(held.schema).option("maxFilesPerTrigger", max(2, -(-len(held.inputFiles()) // 2))).parquet(path)


@query("r1_verify_stream", over(f"with {_JUDGED} select claim_id, {_RULE} as verdict from jf"))
def r1(spark, d):
    r, obs = written(reqs(spark, d), "claims-known"), written(table(spark, d, "observations"), "observations")
    path = _in_files(judged(spark, d, r, obs), "claims-in", r.count(), 4)
    target = staging_dir(spark, "verified")
    q = st.verify_stream(_in_two(spark, path), lambda b: j.rule_verdict(b).select("claim_id", "verdict"), target, "claim_id", staging_dir(spark, "verified-checkpoint"), 8)
    q.awaitTermination()
    return read_upserted(spark, target).select("claim_id", "verdict")


_STREAMED = f"""{_CLAIM_SENTENCES}, {_CANDS}, ex as (select article_id, sum(expressions) as n_expressions from c group by article_id)"""


@query("r1_article_stream", over(f"with {_JUDGED}, {_STREAMED}, vd as (select *, {_RULE} as verdict from jf) select claim_id, vd.article_id, calc_type, verdict, coalesce(n_expressions, 0) as n_expressions, count(*) over (partition by vd.article_id) as n_claims, count(*) filter (where verdict = 'match') over (partition by vd.article_id) as n_match from vd left join ex on vd.article_id = ex.article_id"))
def r1_articles(spark, d):
    """Articles in, records and an export by article out; some articles come twice."""
    r = written(reqs(spark, d), "claims-known")
    claims = r.selectExpr("claim_id", "article_id", "pos", "table_id", "value as claim_value", "unit as claim_unit", "claim_type", "value_type", "period as claim_period")
    unit = F.expr("case when claim_id % 11 = 0 then '2020=100' when table_id % 4 = 0 then '%' else 'units' end")
    matches = r.select("claim_id", "table_id", "item_id", "dim", "period", F.expr(_KIND).alias("calc_type"), F.lit("199701").alias("start_period"), unit.alias("computed_unit"))
    obs = written(table(spark, d, "observations"), "observations")

    def chain(batch):
        records = written(articles.records_of(batch, claims, matches, obs), "records")
        return {"records": (records, "claim_id"), "articles": (articles.article_export(batch, records, ENGLISH), "article_id")}

    said = _claim_articles(spark, d)
    path = _in_files(said, "articles-in", r.agg(F.count_distinct("article_id")).first()[0], 3)
    said.filter("article_id % 50 = 0").repartition(1).write.mode("append").parquet(path)  # these come once more
    target = staging_dir(spark, "article-tables")
    articles.article_stream(_in_two(spark, path), chain, target, staging_dir(spark, "articles-checkpoint"), 8).awaitTermination()
    export = snapshot(spark, target, "articles")
    return snapshot(spark, target, "records").join(export, "article_id").select("claim_id", "article_id", "calc_type", "verdict", "n_expressions", "n_claims", "n_match")


@query("r2_job_status", "select user_id as job, first(event_type order by ts desc, event_id desc) as status, max(ts) as at from events group by user_id")
def r2(spark, d):
    return st.job_status(table(spark, d, "events").selectExpr("user_id as job", "event_id", "event_type as status", "ts"))


@query("r3_slot_state", """with t as (select conv_id, turn, case when length(text) % 3 = 0 then cast(length(text) as varchar) end as period, case when length(text) % 5 = 0 then role end as region from conversations)
  select conv_id, turn, first_value(period ignore nulls) over w as period, first_value(region ignore nulls) over w as region from t window w as (partition by conv_id order by turn rows between unbounded preceding and current row)""")
def r3(spark, d):
    turns = table(spark, d, "conversations").selectExpr("conv_id", "turn", "if(length(text) % 3 = 0, cast(length(text) as string), null) as period", "if(length(text) % 5 = 0, role, null) as region")
    # a conversation's turns lie in one file each, so they arrive in order
    out = staging_dir(spark, "slots")
    got = st.slot_state(_stream(turns.repartition(4, "conv_id"), "turns-in"), ["period", "region"])
    got.writeStream.format("parquet").option("checkpointLocation", staging_dir(spark, "slots-checkpoint")).option("path", out).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("conv_id long, turn long, period string, region string").parquet(out)


@query("r3_ordered_slots", """with t as (select conv_id, turn, any_value(case when length(text) % 3 = 0 then cast(length(text) as varchar) end) as period, any_value(case when length(text) % 5 = 0 then role end) as region from conversations group by conv_id, turn)
  select conv_id, turn, first_value(period ignore nulls) over w as period, first_value(region ignore nulls) over w as region from t window w as (partition by conv_id order by turn rows between unbounded preceding and current row)""")
def r3_ordered(spark, d):
    """Turns out of order and some of them twice, each a minute after the one before; a last row of no conversation ends the wait."""
    turns = table(spark, d, "conversations").selectExpr("conv_id", "turn", "timestamp_millis(1704067200000 + turn * 60000) as said", "if(length(text) % 3 = 0, cast(length(text) as string), null) as period", "if(length(text) % 5 = 0, role, null) as region")
    path, out = staging_dir(spark, "late-turns"), staging_dir(spark, "ordered-slots")
    turns.unionByName(turns.filter("turn % 3 = 0")).repartition(4, F.xxhash64("conv_id", "turn")).write.parquet(path)
    spark.sql("select cast(-1 as bigint) as conv_id, cast(0 as bigint) as turn, timestamp '2100-01-01' as said, cast(null as string) as period, cast(null as string) as region").write.mode("append").parquet(path)
    source = spark.readStream.schema(turns.schema).parquet(path)
    got = ordered_slots(source, ["period", "region"], "said", late="30 days", keep=dt.timedelta(days=30))
    got.writeStream.format("parquet").option("checkpointLocation", staging_dir(spark, "ordered-checkpoint")).option("path", out).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(got.schema).parquet(out)


@query("r4_with_scorer", over("select claim_id, cast(length(sentence) as double) / 10 as score from claims"))
def r4(spark, d):
    c = table(spark, d, "claims").select("claim_id", "sentence")
    return st.with_scorer(c, lambda pdf: pdf["sentence"].str.len() / 10).select("claim_id", F.col("score"))
