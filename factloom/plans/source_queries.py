"""Sources and sinks. Files are written from the given tables first, then read by the source under test."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.registry import query
from factloom.sources import readers as r
from factloom.sources import sinks as s

from .views import over, table


def _staged(df, name: str, form: str, **options) -> str:
    path = s.staging_dir(df.sparkSession, name)
    df.write.options(**options).format(form).save(path)
    return path


@query("s1_read_articles", over("select article_id, case when article_id % 10 = 0 then date '2025-01-01' else published_date end as published_date, md5(regexp_replace(text, '﻿', '', 'g')) as body from articles where flag"))
def s1(spark, d):
    a = table(spark, d, "articles").selectExpr("concat('﻿', cast(article_id as string)) as title", "if(article_id % 10 = 0, 'soon', date_format(published_date, 'yyyy-M-d')) as date", "url", "concat(text, '﻿') as text", "if(flag, ' True', 'False') as flag")
    path = _staged(a, "articles", "csv", header=True, quote='"', escape='"', quoteAll=True)
    return r.read_articles(spark, path).select(F.col("title").cast("long").alias("article_id"), "published_date", F.md5("text").alias("body"))


@query("s2_titles", over("select title, text, case when article_id % 10 <> 0 then strftime(published_date, '%Y-%m-%d') end as date from (select *, row_number() over (partition by title order by article_id desc) as k from articles) where k = 1"))
def s2(spark, d):
    return r.titles(table(spark, d, "articles").selectExpr("article_id as pos", "title", "text", "if(article_id % 10 = 0, 'x', date_format(published_date, 'yyyy-M-d')) as date"))


@query("s3_read_catalog", over("select cast(table_id as varchar) as table_id, title, category, len(keywords) as n_keywords from catalog"))
def s3(spark, d):
    # one file for each category, each an object with an array of tables
    c = table(spark, d, "catalog").groupBy("category").agg(F.collect_list(F.struct(F.col("table_id").cast("string").alias("tblId"), F.col("org_id").cast("string").alias("orgId"), "title", F.col("category").alias("category"), "keywords")).alias("tables")).select("tables")
    path = _staged(c.repartition(4), "catalog", "json")
    rows = spark.read.schema(r.CATALOG_JSON).json(path).select(F.inline("tables")).withColumnRenamed("tblId", "table_id")
    return rows.select("table_id", "title", "category", F.size("keywords").cast("long").alias("n_keywords"))


@query("s4_read_jsonl", "select event_id, event_type from events where event_id % 7 > 1")
def s4(spark, d):
    line = F.expr("case event_id % 7 when 0 then '' when 1 then concat('{\"event_id\": ', cast(event_id as string), ', \"event') else to_json(struct(event_id, event_type)) end")
    path = _staged(table(spark, d, "events").select(line.alias("value")), "lines", "text")
    return r.read_jsonl(spark, path, "event_id long, event_type string")


@query("s5_read_params", "select cast(s_suppkey as varchar) as table_id, 'area' as axis, n_name as label, cast(n_nationkey as varchar) as code, n_nationkey = s_nationkey as is_default from supplier, nation where n_nationkey % 5 = s_suppkey % 5")
def s5(spark, d):
    sup, n = table(spark, d, "supplier"), table(spark, d, "nation")
    g = sup.join(n, n["n_nationkey"] % 5 == sup["s_suppkey"] % 5).groupBy("s_suppkey", "s_nationkey").agg(F.map_from_entries(F.collect_list(F.struct("n_name", F.col("n_nationkey").cast("string")))).alias("m"))
    rows = g.select(F.col("s_suppkey").cast("string").alias("id"), F.lit("1").alias("orgId"), F.create_map(F.lit("I1"), F.lit("units")).alias("items"), F.create_map(F.lit("area"), F.struct(F.col("m").alias("code_map"), F.col("s_nationkey").cast("string").alias("default_value"))).alias("dimensions"))
    return r.read_params(spark, _staged(rows, "params", "json"))[1]


@query("s6_read_golden", over("select cast(claim_id as varchar) as claim_id, sentence from claims"))
def s6(spark, d):
    c = table(spark, d, "claims").select(F.col("claim_id").alias("Unnamed: 0"), "claim_id", "sentence")
    return r.read_golden(spark, _staged(c, "golden", "csv", header=True, quote='"', escape='"'))


def _unescaped(text: str) -> str:
    """SQL that reads the entities that occur in the pages; the ampersand's own comes last."""
    for entity, c in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        text = f"replace({text}, '&{entity};', '{c}')"
    return text


_PARAGRAPH = _unescaped("regexp_replace(regexp_replace(p, '<[^>]*>', '', 'g'), '^\\s+|\\s+$', '', 'g')")


@query("s7_extract_articles", f"""select page_id, case when page_id % 3 = 0 then left(url, 40) || ' & more {{' else nullif(array_to_string(list_filter(list_transform(regexp_extract_all(html, '(?is)<p[^>]*>(.*?)</p>', 1), lambda p: {_PARAGRAPH}), lambda p: p <> ''), chr(10) || chr(10)), '') end as text from pages""")
def s7(spark, d):
    p = table(spark, d, "pages")
    # every third page carries its text in an embedded object, as news sites do
    body = F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), F.concat(F.lit("<b>"), F.substring("url", 1, 40), F.lit("</b> &amp; more {")).alias("content")), F.struct(F.lit("image").alias("type"), F.lit("x").alias("content"))).alias("content_elements")))
    return r.extract_articles(p.withColumn("html", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<script>Fusion.globalContent="), body, F.lit(";var a={}</script>"), F.col("html"))).otherwise(F.col("html"))))


@query("s8_publish_dates", "select event_id as page_id, case when event_id % 4 = 3 then null else cast(date_trunc('second', ts) + interval 9 hour as date) end as published from events")
def s8(spark, d):
    e = table(spark, d, "events").selectExpr("event_id as page_id", "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") as t")
    rec = F.expr("""case page_id % 4 when 0 then to_json(named_struct('display_date', t, 'created_date', '2001-01-01T00:00:00Z')) when 1 then to_json(named_struct('first_publish_date', t)) when 2 then to_json(named_struct('created_date', t)) else '{}' end""")
    return r.publish_dates(e.withColumn("record", rec))


@query("s9_upsert", over("select result_id, case when result_id % 3 = 0 then 'undecidable' else verdict end as verdict, case when result_id % 3 = 0 then 'new' end as note from records union all select result_id + 10000000, 'match', null from records where result_id % 50 = 0"))
def s9(spark, d):
    t = table(spark, d, "records").select("result_id", "verdict")
    b = t.filter("result_id % 3 = 0")
    batch = b.selectExpr("result_id", "'match' as verdict", "'old' as note", "1 as seq").unionByName(b.selectExpr("result_id", "'undecidable' as verdict", "'new' as note", "2 as seq"))
    more = t.filter("result_id % 50 = 0").selectExpr("result_id + 10000000 as result_id", "'match' as verdict", "cast(null as string) as note", "1 as seq")
    return s.upsert(t, batch.unionByName(more), "result_id")


@query("s9_write_upsert", over("select result_id, case when result_id % 3 = 0 then 'undecidable' else verdict end as verdict, case when result_id % 3 = 0 then 'late' end as note from records"))
def s9w(spark, d):
    t = table(spark, d, "records").select("result_id", "verdict", F.lit(1).alias("seq"))
    path = s.staging_dir(spark, "upserted")
    s.write_upsert(path, t, "result_id", 8)
    s.write_upsert(path, t.filter("result_id % 3 = 0").withColumns({"verdict": F.lit("undecidable"), "note": F.lit("late")}), "result_id", 8)
    s.write_upsert(path, t.filter("result_id % 3 = 1"), "result_id", 8)  # a batch without the late column
    return s.read_upserted(spark, path).select("result_id", "verdict", "note")


@query("s10_read_all", over("select result_id, verdict, row_number() over (order by result_id) as n from records"))
def s10(spark, d):
    # the place of each row in the output as it comes: the rows of all partitions before its own, and its place there
    r = s.read_all(table(spark, d, "records").select("result_id", "verdict"), "result_id").withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
    r = spark.read.parquet(_staged(r, "in-order", "parquet"))  # places are read off one run of the sort
    before = r.groupBy("part").count().withColumn("before", F.coalesce(F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return r.join(before, "part").select("result_id", "verdict", (F.col("before") + F.row_number().over(W.partitionBy("part").orderBy("at"))).alias("n"))


@query("s11_export_records", "select event_id, case when event_id % 5 = 0 then null else cast(json_extract_string(props, '$.k') as varchar) end as k, case when event_id % 5 = 0 then 'broken {' end as raw from events")
def s11(spark, d):
    e = table(spark, d, "events").select("event_id", F.expr("if(event_id % 5 = 0, 'broken {', props)").alias("dims"))
    return s.export_records(e, "dims").select("event_id", F.try_element_at("dims_map", F.lit("k")).alias("k"), F.col("dims_raw").alias("raw"))


@query("s12_export_texts", over("select distinct article_title as title, case when table_id % 3 = 0 then 'live' else 'file' end as text from records where table_id % 3 <> 2 and false union all select title, coalesce(l, f) from (select t.title, case when k % 3 = 0 then 'live' end as l, case when k % 2 = 0 then 'file' end as f from (select distinct article_title as title, cast(split_part(article_title, ' ', 2) as int) as k from records) t) where coalesce(l, f) is not null"))
def s12(spark, d):
    rec = table(spark, d, "records").select(F.col("article_title").alias("title"))
    cust = table(spark, d, "customer").selectExpr("concat('Customer ', cast(c_custkey as string)) as title", "c_custkey as k")
    return s.export_texts(rec, cust.filter("k % 3 = 0").withColumn("text", F.lit("live")), cust.filter("k % 2 = 0").withColumn("text", F.lit("file")))


@query("s13_export_dates", over("select article_title as title, coalesce(arg_min(published, result_id) filter (where published is not null), any_value(case when o.k % 2 = 0 then date '2000-01-01' end)) as date from (select *, cast(split_part(article_title, ' ', 2) as int) as k from records) o group by 1 having coalesce(arg_min(published, result_id) filter (where published is not null), any_value(case when o.k % 2 = 0 then date '2000-01-01' end)) is not null"))
def s13(spark, d):
    rec = table(spark, d, "records").selectExpr("article_title as title", "result_id", "published as date")
    filed = table(spark, d, "customer").filter("c_custkey % 2 = 0").selectExpr("concat('Customer ', cast(c_custkey as string)) as title", "date '2000-01-01' as date")
    return s.export_dates(rec, filed)


@query("s14_table_url", over("select table_id, case when table_id % 2 = 0 then 'https://s.example/table?orgId=' || org_id || '&tblId=' || replace(replace(title, ' ', '+'), '#', '%23') else 'https://s.example/search?q=' || replace(title, ' ', '+') end as url from catalog"))
def s14(spark, d):
    c = table(spark, d, "catalog")
    return c.select("table_id", s.table_url(F.expr("if(table_id % 2 = 0, org_id, null)"), F.col("title"), "https://s.example").alias("url"))


@query("s15_org_ids", over("select distinct r.table_id, case when r.table_id % 2 = 0 then c.org_id when r.table_id % 3 = 0 then c.org_id + 100 end as org_id from records r left join catalog c on r.table_id = c.table_id"))
def s15(spark, d):
    c = table(spark, d, "catalog")
    return s.org_ids(table(spark, d, "records"), c.filter("table_id % 2 = 0"), c.filter("table_id % 3 = 0").selectExpr("table_id", "org_id + 100 as org_id"))


@query("s16_pending", "select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_linenumber < 3)")
def s16(spark, d):
    done = table(spark, d, "lineitem").filter("l_linenumber < 3").selectExpr("l_orderkey as o_orderkey")
    return s.pending(table(spark, d, "orders").select("o_orderkey"), done, "o_orderkey")


@query("s17_result_rows", over("select claim_id as id, case when pos = 5 then null else value end as value, case when pos = 5 then 'no value' end as reason, case when pos = 5 then 'skip' else 'claim' end as kind from claims"))
def s17(spark, d):
    c = table(spark, d, "claims")
    rows = s.result_rows(c.filter("pos != 5").selectExpr("claim_id as id", "value"), c.filter("pos = 5").selectExpr("claim_id as id", "'no value' as reason"))
    path = _staged(rows, "results", "json")
    return spark.read.schema("id long, value double, reason string, kind string").json(path)


_RANKED = "rk as (select *, row_number() over (partition by claim_id, source order by score desc, table_id) as rank from candidates)"


@query("s18_match_log", over(f"with {_RANKED} select claim_id, count(*) filter (where source = 'keyword') as keyword, count(*) filter (where source = 'vector') as vector, count(*) as total, first(table_id order by source, table_id) filter (where rank = 1) as top1 from rk group by claim_id"))
def s18(spark, d):
    from factloom.operators.matching import source_rank

    return s.match_log(source_rank(table(spark, d, "candidates")), ["keyword", "vector"])


_SCORED = "sd as (select claim_id as item_id, table_id, max(score) as score from candidates where source <> 'index' group by 1, 2)"


def _handoff(spark, d):
    queued = table(spark, d, "claims").selectExpr("claim_id as item_id", "article_id")
    scored = table(spark, d, "candidates").filter("source != 'index'").groupBy(F.col("claim_id").alias("item_id"), "table_id").agg(F.max("score").alias("score"))
    done = spark.read.schema("item_id long, table_id long, score double").parquet(_staged(scored, "scored", "parquet"))
    return s.handoff(queued, done)


@query("s19_handoff", over(f"with {_SCORED} select claim_id as item_id, article_id, table_id, score from claims join (select * from (select *, row_number() over (partition by item_id order by score desc, table_id) as k from sd) where k = 1) on item_id = claim_id"))
def s19(spark, d):
    return _handoff(spark, d)[0].select("item_id", "article_id", "table_id", "score")


@query("s19_unscored", over(f"with {_SCORED} select claim_id as item_id from claims where claim_id not in (select item_id from sd)"))
def s19b(spark, d):
    return _handoff(spark, d)[1]


@query("s20_load_index", "select vec_id as table_id, label from embeddings where vec_id % 4 > 0")
def s20(spark, d):
    e = table(spark, d, "embeddings")
    meta, vec = e.selectExpr("vec_id as pos", "vec_id as table_id", "label"), e.selectExpr("vec_id as pos", "embedding")
    return s.load_index(meta, vec, e.filter("vec_id % 4 = 0").selectExpr("vec_id as table_id")).select("table_id", "label")


@query("s21_stale", over("select table_id, case table_id % 5 when 0 then 'new' when 1 then 'text' when 2 then 'model' end as why from catalog where table_id % 5 < 3 union all select -s_suppkey - 1, 'gone' from supplier"))
def s21(spark, d):
    c = table(spark, d, "catalog").selectExpr("table_id", "title as text")
    cache = c.filter("table_id % 5 > 0").selectExpr("table_id", "if(table_id % 5 = 1, 'other', text) as text", "if(table_id % 5 = 2, 'm1', 'm2') as model")
    gone = table(spark, d, "supplier").selectExpr("-s_suppkey - 1 as table_id", "'x' as text", "'m2' as model")
    return s.stale(c, cache.unionByName(gone), "m2")


@query("s22_with_reviews", over("select result_id, case when result_id % 4 = 0 then 'match' else verdict end as final, case when result_id % 4 = 0 then verdict = 'match' end as agrees from records"))
def s22(spark, d):
    rec = table(spark, d, "records").select("result_id", "verdict")
    return s.with_reviews(rec, rec.filter("result_id % 4 = 0").selectExpr("result_id as claim_id", "'match' as reviewer_verdict")).select("result_id", "final", "agrees")


@query("s23_period_ranges", over("select table_id, 'Y' as freq, cast(1990 + table_id % 9 as varchar) as start, '2024' as \"end\" from catalog union all select table_id, 'M', '202001', cast(202400 + table_id % 12 as varchar) from catalog where table_id % 2 = 0"))
def s23(spark, d):
    t = F.expr("concat('{prdSe:\"Y\",strtPrdDe:\"', cast(1990 + table_id % 9 as string), '\", endPrdDe : \"2024\"}', if(table_id % 2 = 0, concat(',{prdSe:\"M\",strtPrdDe:\"202001\",endPrdDe:\"', cast(202400 + table_id % 12 as string), '\"}'), ''))")
    return r.period_ranges(table(spark, d, "catalog").select("table_id", t.alias("text")))
