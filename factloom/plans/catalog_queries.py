"""Building and checking the catalog, over parts and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import catalog as c
from factloom.registry import query
from factloom.session import shared_folder, written

from .views import over, table

_INDEX = "ix as (select table_id, org_id, title, title as text from catalog)"


def index(spark, d):
    return table(spark, d, "catalog").selectExpr("table_id", "org_id", "title", "title as text")


def _crawl(spark, d):
    return table(spark, d, "lineitem").selectExpr("if(l_partkey % 3 = 0, null, l_partkey) as leaf_id", "if(l_partkey % 3 = 0, l_suppkey, null) as list_id", "l_orderkey * 1000000 + l_linenumber * 100000 + cast(l_extendedprice as bigint) % 100000 as pos", "l_shipdate as seen").groupBy("leaf_id", "list_id", "pos").agg(F.max("seen").alias("seen"))


_CRAWL = "cr as (select case when l_partkey % 3 = 0 then null else l_partkey end as leaf_id, case when l_partkey % 3 = 0 then l_suppkey end as list_id, l_orderkey * 1000000 + l_linenumber * 100000 + cast(floor(l_extendedprice) as bigint) % 100000 as pos, max(l_shipdate) as seen from lineitem group by 1, 2, 3)"


@query("b1_crawl_leaves", f"with {_CRAWL} select leaf_id, min(pos) as pos from cr where leaf_id is not null group by leaf_id")
def b1(spark, d):
    return c.crawl_leaves(_crawl(spark, d))[0].select("leaf_id", "pos")


@query("b2_frontier", f"with {_CRAWL} select distinct list_id from cr where leaf_id is null and list_id not in (select s_suppkey from supplier where s_suppkey % 4 = 0)")
def b2(spark, d):
    visited = table(spark, d, "supplier").filter("s_suppkey % 4 = 0").selectExpr("s_suppkey as list_id")
    return c.frontier(c.crawl_leaves(_crawl(spark, d))[1], visited)


#: A tree of categories, three below each, every fourth node a table, with ways back up.
_TREE = """select 'V' as view, cast(p_partkey div 3 as bigint) as parent_id, case when p_partkey % 4 > 0 then p_partkey end as list_id, case when p_partkey % 4 = 0 then p_partkey end as table_id from part where p_partkey > 0
  union all select 'V', p_partkey, cast(p_partkey div 9 as bigint), null from part where p_partkey % 10 = 0"""


@query("b2_crawl", f"""with recursive it as ({_TREE.replace(" div ", " // ")}), v as (select cast(0 as bigint) as list_id union select it.list_id from v join it on it.parent_id = v.list_id where it.list_id is not null)
  select 'category' as kind, list_id as id from v union all select distinct 'table', table_id from it join v on it.parent_id = v.list_id where table_id is not null""")
def b2_crawl(spark, d):
    items = spark.sql(_TREE.replace("from part", "from {part}"), part=table(spark, d, "part"))
    roots = spark.sql("select 'V' as view, cast(0 as bigint) as list_id")
    tables, seen = c.crawl(written(items, "crawl-items"), roots, shared_folder(spark, "crawl"))
    return seen.selectExpr("'category' as kind", "list_id as id").unionByName(tables.selectExpr("'table' as kind", "table_id as id"))


_VIEWS = "vw as (select table_id, case r.k when 1 then title else case when table_id % 5 = 0 then '' else upper(title) end end as name, case when r.k = 1 then 'EN' when table_id % 2 = 0 then 'NATIVE' else 'OTHER' end as view, r.k as pos from catalog, range(1, 3) r(k))"


@query("b3_pick_title", over(f"with {_VIEWS} select table_id, first(name order by case view when 'NATIVE' then 0 when 'EN' then 99 else 50 end, pos) as name, first(view order by case view when 'NATIVE' then 0 when 'EN' then 99 else 50 end, pos) as view from vw where name <> '' group by table_id"))
def b3(spark, d):
    rows = table(spark, d, "catalog").selectExpr("*", "explode(array(1, 2)) as pos").selectExpr("table_id", "case when pos = 1 then title when table_id % 5 = 0 then '' else upper(title) end as name", "case when pos = 1 then 'EN' when table_id % 2 = 0 then 'NATIVE' else 'OTHER' end as view", "pos")
    return c.pick_title(rows, {"NATIVE": 0, "EN": 99})


@query("b4_enrich_text", over("select table_id, case when org_id >= 25 then title when table_id % 6 = 0 then '[NATION_' || org_id || ' ' || title else '[NATION_' || org_id || case when table_id % 2 = 0 then ', 2024-05' else '' end || '] ' || title end as text, case when org_id >= 25 then 'unknown_org' when table_id % 6 = 0 then 'already' else 'done' end as outcome from catalog"))
def b4(spark, d):
    ix = index(spark, d).withColumn("text", F.expr("if(table_id % 6 = 0 and org_id < 25, concat('[NATION_', cast(org_id as string), ' ', text), text)"))
    orgs = table(spark, d, "nation").selectExpr("n_nationkey as org_id", "n_name as org_name")
    dates = index(spark, d).filter("table_id % 2 = 0").selectExpr("table_id", "'2024-05' as year_month")
    return c.enrich_text(ix, orgs, dates).select("table_id", "text", "outcome")


@query("b5_append_axes", over("select table_id, case when table_id % 3 = 0 then title when table_id % 3 = 1 then title || ' (axes: sex, age)' else title || ' (axes: sex, age) x' end as text from catalog"))
def b5(spark, d):
    ix = index(spark, d).select("table_id", F.expr("if(table_id % 3 = 2, concat(text, ' (axes: sex, age) x'), text)").alias("text"), F.expr("if(table_id % 3 = 0, cast(array() as array<string>), array('sex', 'age'))").alias("axes"))
    return ix.select("table_id", c.append_axes(F.col("text"), F.col("axes")).alias("text"))


@query("b6_patch_titles", over("select table_id, case when table_id % 4 = 0 then '통계 ' || title when table_id % 4 = 3 then '표 ' || title else title end as title, table_id % 4 = 0 as patched from catalog"))
def b6(spark, d):
    ix = index(spark, d).withColumn("title", F.expr("if(table_id % 4 = 3, concat('표 ', title), title)"))
    names = index(spark, d).filter("table_id % 4 != 2").selectExpr("table_id", "if(table_id % 4 = 1, upper(title), concat('통계 ', title)) as native")
    return c.patch_titles(ix, names).select("table_id", "title", "patched")


@query("b7_org_whitelist", over("select n_nationkey as org_id, n_name as org_name from nation where n_nationkey in (select s_nationkey from supplier) or n_nationkey in (select org_id from catalog)"))
def b7(spark, d):
    params = table(spark, d, "supplier").selectExpr("s_nationkey as org_id")
    return c.org_whitelist(params, index(spark, d), table(spark, d, "nation").selectExpr("n_nationkey as org_id", "n_name as org_name"))


_LAB = "lb as (select table_id, string_agg(label, ' ' order by o) as l, count(*) as n from (select l_partkey as table_id, 'S' || cast(l_suppkey as varchar) as label, min(l_orderkey) as o, min(l_suppkey) as s from lineitem group by 1, 2) group by 1)"


def _labels(spark, d):
    return table(spark, d, "lineitem").selectExpr("l_partkey as table_id", "concat('S', cast(l_suppkey as string)) as label", "l_orderkey * 100000 + l_suppkey as ord")


_LAB = _LAB.replace("min(l_orderkey) as o", "min(l_orderkey * 100000 + l_suppkey) as o")


@query("b8_add_labels", over(f"with {_LAB} select table_id, case when n between 1 and 25 then title || ' ' || l else title end as text, case when n between 1 and 25 then title end as backup from catalog left join lb using (table_id)"))
def b8(spark, d):
    return c.add_labels(index(spark, d), _labels(spark, d), 25).select("table_id", "text", "backup")


@query("b8_revert", over("select table_id, title as text from catalog"))
def b8r(spark, d):
    x = c.add_labels(index(spark, d), _labels(spark, d), 25)
    return c.revert(x.drop("backup"), x.filter("backup is not null").selectExpr("table_id", "backup as old")).select("table_id", "text")


def _twice(spark, d):
    """The catalog with some rows twice, as a crawl leaves it."""
    cat = table(spark, d, "catalog")
    return cat.unionByName(cat.filter("table_id % 10 = 3"))


_TWICE = "tw as (select * from catalog union all select * from catalog where table_id % 10 = 3), pm as (select s_suppkey * 2 as table_id from supplier union all select -s_suppkey - 1 from supplier where s_suppkey < 5)"


def _params(spark, d):
    s = table(spark, d, "supplier")
    return s.selectExpr("s_suppkey * 2 as table_id").unionByName(s.filter("s_suppkey < 5").selectExpr("-s_suppkey - 1 as table_id"))


@query("b9_duplicate_ids", over(f"with {_TWICE} select table_id, count(*) as n from tw group by 1 having count(*) > 1"))
def b9(spark, d):
    return c.dup_ids(_twice(spark, d))


_INT = "select table_id, 'params' as missing_in from (select distinct table_id from tw) where table_id not in (select table_id from pm) union all select table_id, 'catalog' from (select distinct table_id from pm) where table_id not in (select table_id from tw)"


@query("b10_integrity", over(f"with {_TWICE} {_INT}"))
def b10(spark, d):
    return c.integrity(_twice(spark, d), _params(spark, d))


@query("b11_required", over("select table_id, 'description' as field from catalog where description = '' union all select table_id, 'keywords' from catalog where len(keywords) = 0"))
def b11(spark, d):
    return c.required(table(spark, d, "catalog"), ["title", "description", "keywords"])


_COL = "kc as (select kw, count(distinct table_id) as n, sum(distinct table_id) as s from (select table_id, unnest(keywords) as kw from catalog) group by kw having count(distinct table_id) > 1)"


@query("b12_keyword_collisions", over(f"with {_COL} select kw, n, s as id_sum from kc"))
def b12(spark, d):
    return c.kw_collisions(table(spark, d, "catalog")).select("kw", "n", F.aggregate("tables", F.lit(0).cast("bigint"), lambda a, b: a + b).alias("id_sum"))


@query("b13_keyword_substrings", over("""with k as (select distinct table_id, unnest(list_concat(keywords, [category])) as kw from catalog), w as (select distinct kw from k)
  select a.kw as inner, b.kw as outer, (select count(distinct table_id) from k where k.kw = a.kw) as n_tables, a.kw = 'Brand#1' as documented from w a, w b where a.kw <> b.kw and length(a.kw) >= 2 and contains(b.kw, a.kw)"""))
def b13(spark, d):
    cat = table(spark, d, "catalog").withColumn("keywords", F.concat("keywords", F.array("category")))
    doc = cat.select(F.explode("keywords").alias("outer")).distinct().select(F.lit("Brand#1").alias("inner"), "outer")
    return c.kw_substrings(cat, doc)


_GAP = "gp as (select table_id, list_filter(list_concat([title], keywords), lambda w: not contains(embedding_text, w)) as m from catalog)"


@query("b14_text_gaps", over(f"with {_GAP} select table_id, len(m) as n, array_to_string(m, ',') as missing from gp where len(m) > 0"))
def b14(spark, d):
    return c.text_gaps(table(spark, d, "catalog")).select("table_id", F.size("missing").cast("long").alias("n"), F.array_join("missing", ",").alias("missing"))


@query("b15_unknown_categories", over("select distinct category from catalog where category not in (select 'Brand#' || cast(n_nationkey as varchar) from nation where n_nationkey % 2 = 0)"))
def b15(spark, d):
    return c.unknown_categories(table(spark, d, "catalog"), _vocab(spark, d))


def _vocab(spark, d):
    return table(spark, d, "nation").filter("n_nationkey % 2 = 0").selectExpr("concat('Brand#', cast(n_nationkey as string)) as category")


@query("b16_with_version", over("select table_id, case when table_id % 2 = 0 then 'v2,' || category else array_to_string(keywords, ',') end as keywords from catalog"))
def b16(spark, d):
    cat = table(spark, d, "catalog")
    v = cat.selectExpr("table_id", "if(table_id % 2 = 0, 'V2', 'V3') as version", "array('v2', category) as words")
    return c.with_version(cat, v, "V2").select("table_id", F.array_join("keywords", ",").alias("keywords"))


@query("b17_validate", over(f"""with {_TWICE}, kc as (select kw from (select table_id, unnest(keywords) as kw from tw) group by kw having count(distinct table_id) > 1)
  select * from (select 'duplicate id' as finding, 'error' as severity, (select count(*) from (select table_id from tw group by 1 having count(*) > 1)) as n union all select 'integrity', 'error', (select count(*) from ({_INT}))
  union all select 'required field', 'error', (select count(*) from tw where description = '') union all select 'shared keyword', 'warning', (select count(*) from kc)
  union all select 'text gap', 'warning', (select count(*) from tw where len(list_filter(list_concat([title], keywords), lambda w: not contains(embedding_text, w))) > 0)
  union all select 'unknown category', 'warning', (select count(*) from (select distinct category from tw where category not in (select 'Brand#' || cast(n_nationkey as varchar) from nation where n_nationkey % 2 = 0)))) where n > 0"""))
def b17(spark, d):
    return c.validate(_twice(spark, d), _params(spark, d), _vocab(spark, d), ["title", "description"])


@query("b18_enrich_queue", over("select table_id, case when table_id % 3 = 0 and table_id % 4 > 0 then title || ' (axes: sex)' else title end as text, table_id % 4 = 0 or table_id % 3 = 0 as marked, table_id % 3 = 0 and table_id % 4 > 0 as changed from catalog"))
def b18(spark, d):
    ix = index(spark, d).selectExpr("table_id", "text", "table_id % 4 = 0 as marked")
    ax = index(spark, d).select("table_id", F.array(F.lit("sex")).alias("axes"))
    return c.enrich_queue(index(spark, d).filter("table_id % 3 = 0"), ix, ax)
