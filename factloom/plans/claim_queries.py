"""Filtering, attribution and routing of claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions.locale import KOREAN
from factloom.operators import claims as ops
from factloom.registry import query

from .packs import ENGLISH
from .views import over, table

#: Organisations: suppliers; those with even keys publish official figures.
ORGS = "orgs as (select concat('Supplier ', cast(s_suppkey as string)) as org, s_suppkey % 2 = 0 as verified from supplier)"
CLASSED = """sc as (select n, min(case when n = org then case when verified then 1 else 2 end when verified then 3 else 4 end) as k from (select distinct source_org as n from claims where source_org is not null), orgs where contains(n, org) group by n),
  cl as (select claims.*, case when k in (1, 3) then 'verified' when k in (2, 4) then 'known_not' else 'uncertain' end as source_class from claims left join sc on source_org = n)"""


def _orgs(spark, d):
    return table(spark, d, "supplier").selectExpr("concat('Supplier ', cast(s_suppkey as string)) as org", "s_suppkey % 2 = 0 as verified")


def _classed(spark, d):
    return ops.classify_source(table(spark, d, "claims"), _orgs(spark, d))


@query("c1_classify_source", over(f"with {ORGS}, {CLASSED} select claim_id, source_org, source_class from cl"))
def c1(spark, d):
    return _classed(spark, d).select("claim_id", "source_org", "source_class")


@query("c2_standalone", over("select result_id, contains(replace(article_title, 'Customer 10', ''), 'Customer 1') as found, contains(article_title, 'Customer 2') as other from records"))
def c2(spark, d):
    return table(spark, d, "records").select("result_id", ops.standalone(F.lit("Customer 1"), F.col("article_title"), "1", "0").alias("found"), ops.standalone(F.lit("Customer 2"), F.col("article_title"), "1", "0").alias("other"))


_REASONS = "lb as (select result_id as article_id, concat(case when result_id % 3 = 0 then 'note by ' else 'published by ' end, 'Supplier ', cast(table_id as string)) as reason from records)"
_INFER = f"""{_REASONS}, iorgs as (select concat('Supplier', cast(s_suppkey as string)) as org from supplier),
  inf as (select article_id, first(org order by length(org) desc, org) as org from lb, iorgs where contains(reason, 'published') and contains(regexp_replace(reason, '\\s+', '', 'g'), org) group by article_id)"""


def _reasons(spark, d):
    return table(spark, d, "records").selectExpr("result_id as article_id", "concat(if(result_id % 3 = 0, 'note by ', 'published by '), 'Supplier ', cast(table_id as string)) as reason")


def _spaceless(spark, d):
    return _orgs(spark, d).withColumn("org", F.replace("org", F.lit(" "), F.lit("")))


@query("c3_infer_org", over(f"with {_INFER} select article_id, org from inf"))
def c3(spark, d):
    return ops.infer_org(_reasons(spark, d), _spaceless(spark, d), "published")


_FILL = """nm as (select article_id, source_org, max(case when source_class = 'verified' then 1 else 0 end) as v, count(*) as n, min(pos) as p from cl where source_org is not null group by article_id, source_org),
  bst as (select article_id as a, source_org as o from (select *, row_number() over (partition by article_id order by v desc, n desc, p, source_org) as k from nm) where k = 1)"""


@query("c4_backfill", over(f"with {ORGS}, {CLASSED}, {_FILL} select claim_id, coalesce(source_org, o) as source_org from cl left join bst on article_id = a"))
def c4(spark, d):
    return ops.backfill(_classed(spark, d)).select("claim_id", "source_org")


@query("c5_resolve_sources", over(f"with {ORGS}, {CLASSED}, {_FILL}, {_INFER} select claim_id, coalesce(source_org, o, inf.org) as source_org from cl left join bst on cl.article_id = a left join inf on cl.article_id = inf.article_id"))
def c5(spark, d):
    return ops.resolve_sources(_classed(spark, d), _reasons(spark, d), _spaceless(spark, d), "published").select("claim_id", "source_org")


@query("c6_no_digit", over("select claim_id, value is not null and not regexp_matches(sentence, '[0-9]') as bad from (select claim_id, value, case when pos = 3 then regexp_replace(sentence, '[0-9]', 'x', 'g') else sentence end as sentence from claims)"))
def c6(spark, d):
    c = table(spark, d, "claims").withColumn("sentence", F.expr("if(pos = 3, regexp_replace(sentence, '[0-9]', 'x'), sentence)"))
    return c.select("claim_id", ops.no_digit().alias("bad"))


@query("c7_not_printed", over("select claim_id, v is not null and not contains(sentence, cast(cast(v as bigint) as varchar)) as bad from (select claim_id, sentence, value + pos % 2 as v from claims)"))
def c7(spark, d):
    return table(spark, d, "claims").select("claim_id", F.coalesce(ops.not_printed(F.expr("value + pos % 2")), F.lit(False)).alias("bad"))


@query("c8_no_value", over("select claim_id, claim_type in ('level', 'rate') and value is null as bad from claims"))
def c8(spark, d):
    return table(spark, d, "claims").select("claim_id", ops.no_value().alias("bad"))


@query("c9_verifiable", over(f"""with {ORGS}, {CLASSED} select claim_id, case when source_class <> 'verified' then 'source' when value is not null and not contains(sentence, cast(cast(value as bigint) as varchar)) then 'not printed'
  when claim_type in ('level', 'rate') and value is null then 'no value' end as drop_reason from cl"""))
def c9(spark, d):
    return ops.verifiable(_classed(spark, d), ENGLISH).select("claim_id", "drop_reason")


@query("c10_dedup_claims", over("select claim_id, article_id from (select *, row_number() over (partition by article_id, left(sentence, 20) order by pos, claim_id) as k from claims) where k = 1"))
def c10(spark, d):
    return ops.dedup_claims(table(spark, d, "claims").withColumn("sentence", F.expr("concat(' ', left(sentence, 20))"))).select("claim_id", "article_id")


_FOREIGN = "coalesce(regexp_matches(comparison_target, 'NATION_3|NATION_7|NATION_11'), false)"
_EXT = "case when regexp_matches(sentence, 'all-time|record|in (\\d+) years|since the (pandemic|merger)') then case when regexp_matches(sentence, 'lowest|smallest|least') and not regexp_matches(sentence, 'highest|largest|most') then 'min' else 'max' end end"


@query("c11_foreign", over(f"select claim_id, {_FOREIGN} as is_foreign from claims"))
def c11(spark, d):
    return table(spark, d, "claims").select("claim_id", ops.foreign(ENGLISH, "comparison_target", "source_org").alias("is_foreign"))


#: Words that are a country or a common noun, with the proper nouns that a tagger finds in them.
_TAGGED = "select claim_id, case supp % 5 when 0 then '노인 인도 통행' when 1 then '인도 수출' when 2 then '호주제 폐지' when 3 then '일본 관광객' end as population, case supp % 5 when 1 then array('인도') when 2 then array('호주제') when 0 then array() end as nouns from claims"


@query("c11_proper_nouns", over("select claim_id, supp % 5 in (1, 3) as is_foreign from claims"))
def c11_nouns(spark, d):
    rows = spark.sql(_TAGGED.replace("from claims", "from {claims}"), claims=table(spark, d, "claims"))
    return rows.select("claim_id", ops.foreign(KOREAN, "population", nouns={"population": "nouns"}).alias("is_foreign"))


@query("c12_extreme", over(f"select claim_id, {_EXT} as direction from claims"))
def c12(spark, d):
    return table(spark, d, "claims").select("claim_id", ops.extreme(ENGLISH).alias("direction"))


ROUTE = f"case when {_FOREIGN} then null when claim_type = 'rate' then 'rate' when claim_type = 'compare' then 'change' when claim_type = 'level' then case {_EXT} when 'max' then 'max_check' when 'min' then 'min_check' else case when value_type = 'delta' then 'change' else 'lookup' end end end"


@query("c13_route", over(f"select claim_id, {ROUTE} as calc_type from claims"))
def c13(spark, d):
    return table(spark, d, "claims").select("claim_id", ops.route(ENGLISH, "comparison_target").alias("calc_type"))


_KOREAN_KIND = "case when supp % 5 in (1, 3) then null when claim_type = 'rate' then 'rate' when claim_type = 'compare' then 'change' when claim_type = 'level' and value_type = 'delta' then 'change' when claim_type = 'level' then 'lookup' end"


@query("c13_route_nouns", over(f"select claim_id, {_KOREAN_KIND} as calc_type from claims"))
def c13_nouns(spark, d):
    """A pavement and a family law are routed, though their words hold the names of countries."""
    rows = spark.sql(_TAGGED.replace("select claim_id,", "select claim_id, claim_type, value_type, '취업자가 늘었다' as sentence,").replace("from claims", "from {claims}"), claims=table(spark, d, "claims"))
    return rows.select("claim_id", ops.route(KOREAN, "population", nouns={"population": "nouns"}).alias("calc_type"))


@query("c14_wants_comparison", over("select claim_id, regexp_matches(sentence, 'rose|grew|increased|gained|fell|declined|dropped|decreased') as wants from claims"))
def c14(spark, d):
    return table(spark, d, "claims").select("claim_id", ops.wants_comparison(ENGLISH).alias("wants"))


_SYNONYMS = "values (0, 'red', 'crimson'), (1, 'ring', 'loop'), (2, 'small', 'little'), (3, 'widget', 'gadget')"


@query("c15_normalize_stat", over(f"""select table_id, coalesce(target, title) as normalized from (select c.table_id, c.title, first(s.target order by s.ord) as target from catalog c left join ({_SYNONYMS}) s(ord, term, target) on contains(c.title, s.term) group by c.table_id, c.title)"""))
def c15(spark, d):
    syn = spark.sql(f"select * from {_SYNONYMS} as s(ord, term, target)")
    return ops.normalize_stat(table(spark, d, "catalog"), syn, "title").select("table_id", "normalized")
