"""Aggregations and reports over verification records."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import reports as r
from factloom.registry import query

from .views import over, table


def records(spark, d):
    return table(spark, d, "records").withColumnRenamed("article_title", "article").withColumn("table_name", F.expr("concat('T', cast(result_id % 7 as string))"))


@query("a1_by_article", over("select article_title as article, count(*) as n, string_agg(result_id || ':' || verdict, ',' order by result_id) as claims from records group by 1"))
def a1(spark, d):
    x = r.by_article(records(spark, d))
    return x.select("article", F.size("claims").cast("long").alias("n"), F.array_join(F.transform("claims", lambda c: F.concat(c.result_id.cast("string"), F.lit(":"), c.verdict)), ",").alias("claims"))


@query("a2_dominant", over("select article_title as article, case min(s) when 0 then 'mismatch' when 1 then 'undecidable' else 'match' end as verdict, count(*) filter (where s = m) as n from (select *, min(s) over (partition by article_title) as m from (select *, case verdict when 'mismatch' then 0 when 'undecidable' then 1 else 2 end as s from records)) group by 1"))
def a2(spark, d):
    return r.dominant(records(spark, d))


@query("a3_display_date", over("select article_title as article, max(created_at) as latest, coalesce(max(published), cast(max(created_at) as date)) as shown from records group by 1"))
def a3(spark, d):
    return r.display_date(records(spark, d))


@query("a4_kpis", over("""select *, case when dots >= 3 then 'high' when dots = 2 then 'medium' else 'low' end as band from (select count(*) as total, count(*) filter (where verdict = 'mismatch') as mismatch, count(*) filter (where verdict = 'undecidable') as undecidable, count(*) filter (where verdict = 'match') as match,
  round(avg(score), 4) as mean, count(distinct article_title) as articles, round(count(*) filter (where verdict in ('match', 'mismatch')) / count(*), 4) as rate, cast(round(avg(score) * 4) as int) as dots from records)"""))
def a4(spark, d):
    return r.kpis(records(spark, d))


@query("a5_distribution", over("select verdict, count(*) as n, count(*) filter (where score < 0.5) as low, round(count(*) * 100.0 / sum(count(*)) over (), 1) as percent from records group by verdict"))
def a5(spark, d):
    return r.distribution(records(spark, d))


_REVIEW = "verdict = 'undecidable' or (verdict = 'match' and score < 0.5) or score between 0.4 and 0.6"


@query("a6_review_queue", over(f"select result_id from records where {_REVIEW}"))
def a6(spark, d):
    return records(spark, d).filter(r.needs_review()).select("result_id")


@query("a7_funnel", over("select 'status' as kind, status as value, count(*) as n from records group by 2 union all select 'missing', x, count(*) from (select unnest(case when result_id % 3 = 0 then ['period', 'region'] when result_id % 3 = 1 then ['age'] else [] end) as x from records) group by 2 union all select 'tag', 'multi_age', count(*) from records where result_id % 5 = 0"))
def a7(spark, d):
    x = records(spark, d).withColumns({"missing": F.expr("case result_id % 3 when 0 then array('period', 'region') when 1 then array('age') else cast(array() as array<string>) end"), "tag": F.expr("if(result_id % 5 = 0, 'multi_age', null)")})
    return r.funnel(x)


@query("a8_outcome", over("""select article, case when n = 0 then 'no_claims' when kept = 0 then 'all_filtered' when tr = 0 then 'all_untrusted' when fail then 'error' when done = kept then 'complete' when done > 0 then 'partial' else 'none' end as outcome
  from (select article_id as article, count(*) as n, count(*) filter (where supp % 3 > 0) as kept, count(*) filter (where supp % 3 > 0 and part % 3 > 0) as tr, bool_or(pos = 7 and supp % 5 = 0) as fail, count(*) filter (where supp % 3 > 0 and part % 3 > 0 and pos % 2 = 0) as done from claims group by 1)"""))
def a8(spark, d):
    c = table(spark, d, "claims").selectExpr("article_id as article", "claim_id", "supp % 3 > 0 as kept", "part % 3 > 0 as trusted", "pos = 7 and supp % 5 = 0 as failed", "pos % 2 = 0 as done")
    return r.outcome(c)


@query("a9_cited_tables", over("select article_title as article, table_id, first('T' || cast(result_id % 7 as varchar) order by result_id) as table_name from records group by 1, 2"))
def a9(spark, d):
    return r.cited_tables(records(spark, d))


@query("a10_visible", over(f"select result_id from records where (published is null or date '2001-06-01' - published <= 900) and article_title in (select article_title from records where {_REVIEW})"))
def a10(spark, d):
    return r.visible(records(spark, d), F.lit("2001-06-01").cast("date"), 900).select("result_id")


_COVER = "cv as (select c.claim_id, article_id, source_org as org, supp % 2 = 0 as gov, h.claim_id is not null as hit from claims c left join (select distinct claim_id from candidates where source = 'keyword' and score > 20) h on c.claim_id = h.claim_id)"


def _cover(spark, d):
    c = table(spark, d, "claims").selectExpr("claim_id", "article_id as article", "source_org as org", "supp % 2 = 0 as gov")
    return r.coverage(c, table(spark, d, "candidates").filter("source = 'keyword' and score > 20"))


@query("a11_coverage", over(f"with {_COVER} select (select round(avg(hit::int), 6) from cv) as share, (select round(avg(h::int), 6) from (select bool_or(hit) as h from cv where gov group by article_id)) as gov_share"))
def a11(spark, d):
    return _cover(spark, d)[0]


@query("a11_uncovered_orgs", over(f"with {_COVER} select org, count(*) as n from cv where not hit group by org"))
def a11b(spark, d):
    return _cover(spark, d)[1]


@query("a12_freq_support", over("""with p as (select l_suppkey as table_id, case l_linenumber % 3 when 0 then 'Y' when 1 then 'Q' else 'M' end as freq, l_returnflag = 'A' as ok, l_linestatus = 'F' and l_suppkey % 2 = 0 and l_quantity > 48 as reg from lineitem),
  s as (select table_id, freq, bool_or(ok) as ok, bool_or(reg) as reg from p group by 1, 2) select table_id, coalesce(string_agg(freq, ',' order by freq) filter (where ok), '') as supported, coalesce(string_agg(freq, ',' order by freq) filter (where ok and not reg), '') as new from s group by 1"""))
def a12(spark, d):
    p = table(spark, d, "lineitem").selectExpr("l_suppkey as table_id", "case l_linenumber % 3 when 0 then 'Y' when 1 then 'Q' else 'M' end as freq", "l_returnflag = 'A' as ok", "l_linestatus = 'F' and l_suppkey % 2 = 0 and l_quantity > 48 as registered")
    return r.freq_support(p).select("table_id", F.array_join("supported", ",").alias("supported"), F.array_join("new", ",").alias("new"))


@query("a13_merge_freqs", over("select result_id, case result_id % 4 when 0 then 'Y,M' when 1 then 'Q,M,H' when 2 then 'Y' else 'Y,Q,A,H' end as freqs from records"))
def a13(spark, d):
    x = F.expr("case result_id % 4 when 0 then array('M') when 1 then array('M', 'H') when 2 then null else array('H', 'Q') end")
    y = F.expr("case result_id % 4 when 0 then array('Y', 'M') when 1 then array('Q') when 2 then array('Y') else array('A', 'Y') end")
    return records(spark, d).select("result_id", F.array_join(r.merge_freqs(x, y), ",").alias("freqs"))


_LAST = "(select l_suppkey, {0} as label, arg_max({1}, l_orderkey * 10 + l_linenumber + l_partkey * 100000) as code from lineitem group by 1, 2)"


@query("a14_code_maps", over(f"""select l_suppkey as table_id, 'C1' as axis, string_agg(label || '=' || code, ',' order by label) as codes from {_LAST.format("l_returnflag", "cast(l_linenumber as varchar)")} group by 1
  union all select l_suppkey, 'C2', string_agg(label || '=' || code, ',' order by label) from {_LAST.format("l_linestatus", "l_returnflag")} group by 1"""))
def a14(spark, d):
    x = table(spark, d, "lineitem").selectExpr("l_suppkey as table_id", "l_orderkey * 10 + l_linenumber + l_partkey * 100000 as ord", "cast(l_linenumber as string) as C1", "l_returnflag as C1_NM", "l_returnflag as C2", "l_linestatus as C2_NM")
    return r.code_maps(x, 2).select("table_id", "axis", F.array_join(F.transform(F.map_entries("codes"), lambda e: F.concat(e.key, F.lit("="), e.value)), ",").alias("codes"))


@query("a15_axis_values", over("select table_id, string_agg(distinct item_id, ',' order by item_id) as item_id_values, string_agg(distinct dim, ',' order by dim) as dim_values from observations group by 1"))
def a15(spark, d):
    x = r.axis_values(table(spark, d, "observations"), ["item_id", "dim"])
    return x.select("table_id", F.array_join("item_id_values", ",").alias("item_id_values"), F.array_join("dim_values", ",").alias("dim_values"))


@query("a16_refresh_set", over("""select n.table_id, case when c.fetched_at is null then 'missing' else 'stale' end as why, coalesce(retry_count, 0) + case when coalesce(failed, false) then 1 else 0 end as retry_count from (select distinct table_id from records) n
  left join (select s_suppkey as table_id, date '2001-01-01' - cast(s_suppkey * 7 as int) as fetched_at, s_suppkey % 3 as retry_count, s_suppkey % 4 = 0 as failed from supplier where s_suppkey % 5 > 0) c on n.table_id = c.table_id where c.fetched_at is null or date '2001-01-31' - c.fetched_at > 90"""))
def a16(spark, d):
    cache = table(spark, d, "supplier").filter("s_suppkey % 5 > 0").selectExpr("s_suppkey as table_id", "date_sub(date '2001-01-01', cast(s_suppkey * 7 as int)) as fetched_at", "s_suppkey % 3 as retry_count", "s_suppkey % 4 = 0 as failed")
    return r.refresh_set(cache, records(spark, d), F.lit("2001-01-31").cast("date"))


@query("a17_run_summary", over("""with c as (select user_id as article_id, count(*) as calls, min(ts) as a, max(ts) as b from events group by 1)
  select count(*) as articles, sum(coalesce(calls, 0)) as calls, count(*) filter (where coalesce(calls, 0) <> 3) as off, count(*) filter (where length(text) > 4000) as cut, cast(floor(epoch(max(b))) as bigint) - cast(floor(epoch(min(a))) as bigint) as seconds from articles left join c using (article_id)"""))
def a17(spark, d):
    return r.run_summary(table(spark, d, "articles"), table(spark, d, "events").selectExpr("user_id as article_id", "ts"), 3)
