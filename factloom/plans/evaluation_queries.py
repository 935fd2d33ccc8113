"""Golden-set scoring over claims, candidates and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import evaluation as e
from factloom.operators.matching import source_rank
from factloom.registry import query

from .views import over, table

_GOLD = "gd as (select claim_id, cast(part % 50 as bigint) as gold from claims)"


def gold(spark, d):
    return table(spark, d, "claims").selectExpr("claim_id", "part % 50 as gold")


def ranked(spark, d, source):
    return source_rank(table(spark, d, "candidates").filter(F.col("source") == source)).select("claim_id", "table_id", "rank")


def _best(source):
    return f"(select gd.claim_id, min(r.rank) as rank from gd left join (select claim_id, table_id, row_number() over (partition by claim_id order by score desc, table_id) as rank from candidates where source = '{source}') r on r.claim_id = gd.claim_id and r.table_id = gd.gold group by gd.claim_id)"


_METRICS = "count(*) as n, round(avg(coalesce((rank <= 1)::double, 0)), 6) as recall_1, round(avg(coalesce((rank <= 3)::double, 0)), 6) as recall_3, round(avg(coalesce((rank <= 5)::double, 0)), 6) as recall_5, round(avg(coalesce(1.0::double / rank, 0)), 6) as mrr"


@query("e1_golden", over("select claim_id, case when part % 10 = 1 then '7' else cast(part % 60 as varchar) end as gold, case when pos % 2 = 0 then 'high' else 'low' end as confidence from claims where part % 4 > 0 and (part % 10 = 1 or part % 60 in (select table_id from catalog where table_id % 7 = 0))"))
def e1(spark, d):
    m = table(spark, d, "claims").filter("part % 4 > 0").selectExpr("claim_id", "if(part % 10 = 1, 'old', cast(part % 60 as string)) as table_id", "if(pos % 2 = 0, 'exact', 'near') as status")
    return e.golden(table(spark, d, "claims").select("claim_id"), m, table(spark, d, "catalog").filter("table_id % 7 = 0"), {"old": "7"})


@query("e2_merge_golden", over("select 'good' as part, count(*) as n from claims where pos <> 5 union all select 'empty', count(*) from claims where pos = 5 union all select 'unknown', count(*) from (select distinct claim_id from candidates) where claim_id % 8 = 5"))
def e2(spark, d):
    c = table(spark, d, "claims").selectExpr("claim_id", "if(pos = 5, ' ', sentence) as sentence", "pos")
    good, empty, unknown = e.merge_golden(c.filter("pos % 2 = 0"), c.filter("pos % 2 = 1").drop("pos"), table(spark, d, "candidates").select("claim_id").distinct())
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    return count(good, "good").unionByName(count(empty, "empty")).unionByName(count(unknown, "unknown"))


@query("e3_derive_verdict", over("select result_id, case result_id % 5 when 0 then 'match' when 1 then 'mismatch' when 2 then 'match' when 3 then 'mismatch' end as v from records"))
def e3(spark, d):
    s = F.expr("case result_id % 5 when 0 then 'agrees' when 1 then 'differs' when 2 then 'auto (error 1.5%)' when 3 then 'auto (error 12%)' else 'open' end")
    return table(spark, d, "records").select("result_id", e.derive_verdict(s, {"agrees": "match", "differs": "mismatch"}).alias("v"))


@query("e4_rank_metrics", over(f"with {_GOLD} select {_METRICS} from {_best('keyword')}"))
def e4(spark, d):
    return e.rank_metrics(ranked(spark, d, "keyword"), gold(spark, d))


@query("e5_rank_metrics_multi", over(f"with gd as (select claim_id, cast(part % 50 as bigint) as gold from claims union all select claim_id, cast((part + 1) % 50 as bigint) from claims) select {_METRICS.replace('rank <= 3', 'rank <= 5').replace('recall_3', 'r5').replace('(rank <= 5)::double, 0)), 6) as recall_5', '(rank <= 10)::double, 0)), 6) as recall_10').replace('r5', 'recall_5')} from {_best('vector')}"))
def e5(spark, d):
    g = e.split_golds(table(spark, d, "claims").selectExpr("claim_id", "concat(cast(part % 50 as string), ', ', cast((part + 1) % 50 as string), ',') as gold")).withColumn("gold", F.col("gold").cast("long"))
    return e.rank_metrics(ranked(spark, d, "vector"), g, (1, 5, 10))


_VG = "vg as (select claim_id, pos % 2 = 0 as hit, list_filter(list_distinct(regexp_extract_all(sentence, '[a-zA-Z0-9]+')), lambda w: length(w) >= 2 and not contains(coalesce(title || ' shipments units In', ''), w)) as u from claims left join catalog on claims.part = catalog.table_id)"


@query("e6_vocab_gap", over(f"with {_VG} select claim_id, hit, len(u) as n from vg"))
def e6(spark, d):
    return _gaps(spark, d).select("claim_id", "hit", F.size("unmatched").cast("long").alias("n"))


def _gaps(spark, d):
    c = table(spark, d, "claims").selectExpr("claim_id", "sentence", "part as table_id", "pos % 2 = 0 as hit")
    return e.vocab_gap(c, table(spark, d, "catalog").selectExpr("table_id", "concat(title, ' shipments units In') as text"))


@query("e6_vocab_crosstab", over(f"with {_VG} select len(u) > 0 as has_gap, count(*) filter (where hit) as hits, count(*) filter (where not hit) as misses from vg group by 1"))
def e6b(spark, d):
    return e.crosstab(_gaps(spark, d))


@query("e7_build_query", over("select claim_id, concat_ws(' ', source_org, unit, case claim_type when 'rate' then 'growth' when 'level' then 'total' end) as q from claims"))
def e7(spark, d):
    return table(spark, d, "claims").withColumn("blank", F.lit("  ")).select("claim_id", e.build_query(["source_org", "blank", "unit"], {"rate": "growth", "level": "total"}, "claim_type").alias("q"))


@query("e8_summarize", over(f"with {_GOLD}, rs as (select 'keyword' as system, rank, claim_id % 9 as ms from {_best('keyword')} union all select 'vector', rank, claim_id % 9 from {_best('vector')}) select system, count(*) as n, format('{{:.1f}}%', avg(coalesce((rank = 1)::double, 0)) * 100) as top1, format('{{:.3f}}', avg(coalesce(1.0::double / rank, 0))) as mrr, format('{{:.1f}}', avg(ms)) as latency from rs group by system"))
def e8(spark, d):
    one = lambda s: e.best_ranks(ranked(spark, d, s), gold(spark, d)).select(F.lit(s).alias("system"), "rank", (F.col("claim_id") % 9).alias("ms"))
    return e.summarize(one("keyword").unionByName(one("vector")))


@query("e9_version_diff", over(f"with {_GOLD} select claim_id, case when coalesce(b.rank, 99) < coalesce(a.rank, 99) then 'improved' when coalesce(b.rank, 99) > coalesce(a.rank, 99) then 'worse' else 'same' end as change from {_best('keyword')} a join {_best('vector')} b using (claim_id)"))
def e9(spark, d):
    return e.version_diff(*[e.best_ranks(ranked(spark, d, s), gold(spark, d)) for s in ("keyword", "vector")])


@query("e10_ablation", over(f"with {_GOLD} " + " union all ".join(f"select '{s}' as system, {_METRICS} from {_best(s)}" for s in ("keyword", "vector", "index"))))
def e10(spark, d):
    return e.ablation({s: ranked(spark, d, s) for s in ("keyword", "vector", "index")}, gold(spark, d))


#: Gold sentences: the beginnings of claims; extracted are the claims at even places.
_ER = """gs as (select claim_id as gold_id, article_id, left(sentence, length(sentence) - pos) as sentence from claims), xs as (select claim_id, article_id, pos, sentence from claims where pos % 2 = 0),
  er as (select g.article_id, gold_id, arg_min(x.claim_id, x.pos) as claim_id from gs g left join xs x on g.article_id = x.article_id and (contains(regexp_replace(g.sentence, '\\s+', '', 'g'), regexp_replace(x.sentence, '\\s+', '', 'g')) or contains(regexp_replace(x.sentence, '\\s+', '', 'g'), regexp_replace(g.sentence, '\\s+', '', 'g'))) group by 1, 2)"""


def _extraction(spark, d):
    c = table(spark, d, "claims")
    return c.selectExpr("claim_id as gold_id", "article_id", "substring(sentence, 1, length(sentence) - pos) as sentence"), c.filter("pos % 2 = 0").select("claim_id", "article_id", "pos", "sentence")


@query("e11_extract_recall", over(f"with {_ER} select article_id, gold_id, claim_id from er"))
def e11(spark, d):
    return e.extract_recall(*_extraction(spark, d))


def _rematch(spark, d):
    g, x = _extraction(spark, d)
    r = e.extract_recall(g, x)
    missed = g.join(r.filter("claim_id is null").select("gold_id"), "gold_id", "left_semi")
    return g, x, r, e.rematch_numbers(missed, x)


_NUMBERS = "list_distinct(list_filter(regexp_extract_all(replace(sentence, ',', ''), '[0-9]+(?:\\.[0-9]+)?'), lambda x: length(x) >= 2))"
_AGAIN = f"""{_ER}, mg as (select gs.article_id, gs.gold_id, {_NUMBERS} as n, row_number() over (partition by gs.article_id order by gs.gold_id) as k from gs join er using (gold_id) where er.claim_id is null),
  xn as (select article_id, claim_id, pos, {_NUMBERS} as n from xs),
  rm as (select distinct article_id, cast(0 as bigint) as k, cast([] as bigint[]) as used, cast(null as bigint) as gold_id, cast(null as bigint) as claim_id from mg
    union all select article_id, k, case when m is null then used else list_append(used, m) end, gold_id, m from (select rm.article_id, mg.k, rm.used, mg.gold_id, arg_min(xn.claim_id, xn.pos) filter (where list_has_any(xn.n, mg.n) and not list_contains(rm.used, xn.claim_id)) as m
      from rm join mg on mg.article_id = rm.article_id and mg.k = rm.k + 1 left join xn on xn.article_id = rm.article_id group by rm.article_id, mg.k, rm.used, mg.gold_id))"""


@query("e12_rematch_numbers", over(f"with {_AGAIN} select article_id, gold_id, claim_id from rm where claim_id is not null").replace("with ", "with recursive ", 1))
def e12(spark, d):
    return _rematch(spark, d)[3]


@query("e13_extract_report", over(f"""with {_AGAIN}, rp as (select count(*) as gold, count(er.claim_id) as found, count(coalesce(er.claim_id, rm.claim_id)) as adjusted from er left join rm on rm.gold_id = er.gold_id and rm.claim_id is not null)
  select gold, found, adjusted, round(found / gold, 4) as recall, round(adjusted / gold, 4) as adjusted_recall, round((select count(*) filter (where regexp_matches(sentence, '[0-9]')) / count(*) from xs), 4) as precision from rp""").replace("with ", "with recursive ", 1))
def e13(spark, d):
    _, x, r, again = _rematch(spark, d)
    return e.extract_report(r, again, x)


@query("e14_classifier_eval", over("select regexp_replace(url, '/+$', '') as url, bool_or(flag) as label, bool_or(article_id % 5 > 1) as predicted, bool_or(flag) = bool_or(article_id % 5 > 1) as right from articles group by 1"))
def e14(spark, d):
    a = table(spark, d, "articles")
    return e.classifier_eval(a.selectExpr("url", "if(flag, 'x', null) as claim"), a.selectExpr("concat(url, '/') as url", "article_id % 5 > 1 as predicted"))


@query("e15_proxy_quality", over("select case when supp % 2 = 0 then 'a' else 'b' end as system, 1.0 as numeric, round(avg(((value is not null)::int + (comparison_target is not null)::int + (source_org is not null)::int) / 3), 4) as filled, round(avg((claim_type in ('level', 'rate'))::int), 4) as typed from claims group by 1"))
def e15(spark, d):
    c = table(spark, d, "claims").withColumn("system", F.expr("if(supp % 2 = 0, 'a', 'b')"))
    return e.proxy_quality(c, ["value", "comparison_target", "source_org"], ("level", "rate"))


_VE = """ve as (select claim_id, claim_type, unit, cast(value as double) as v, case pos % 4 when 0 then value when 1 then value + 40 when 2 then value + 1 end as official, case pos % 3 when 0 then 'match' when 1 then 'mismatch' else 'undecidable' end as gold, case when unit = '%' then 0.1 when value % 10 = 0 then 5.0 else 0.5 end as tol from claims where value is not null and pos % 4 < 3)"""


@query("e16_verdict_eval", over(f"with {_VE}, vp as (select *, case when claim_type <> 'rate' and abs(v - official) <= tol then 'match' when claim_type = 'rate' and abs(v - official) <= tol then 'match' when abs(v - official) > 5 * tol then 'mismatch' else 'undecidable' end as predicted from ve) select claim_id, official, predicted, gold, predicted = gold as right from vp"))
def e16(spark, d):
    c = table(spark, d, "claims").filter("value is not null").selectExpr("claim_id", "pos", "value as claim_value", "unit as claim_unit", "claim_type", "value_type", "period as claim_period")
    m = table(spark, d, "claims").filter("value is not null").selectExpr("claim_id", "case pos % 4 when 0 then concat('about 5 tons / ', cast(cast(value as int) as string), ' ', unit) when 1 then concat(cast(cast(value as int) + 40 as string), unit) when 2 then concat('total ', cast(cast(value as int) + 1 as string)) else 'none given' end as cell")
    v = c.selectExpr("claim_id", "case pos % 3 when 0 then 'match' when 1 then 'mismatch' else 'unconfirmed' end as gold")
    return e.verdict_eval(c, m, v)


@query("e17_gold_articles", over("select regexp_replace(url, '/+$', '') as url, 2 as n_gold, 'first,second' as sentences from articles where article_id % 3 = 0 and article_id <> 6"))
def e17(spark, d):
    a = table(spark, d, "articles")
    g = a.filter("article_id % 3 = 0").selectExpr("concat(url, '//') as url", "inline(array(named_struct('gold_id', 2, 'sentence', 'second'), named_struct('gold_id', 1, 'sentence', 'first')))")
    return e.gold_articles(a, g, a.filter("article_id = 6")).select("url", "n_gold", F.array_join("sentences", ",").alias("sentences"))


@query("e18_gold_integrity", over("""with a as (select claim_id from claims), b as (select claim_id from claims where pos % 2 = 0), c as (select claim_id + 8 as claim_id from claims where pos % 3 = 0)
  select 'claims' as a, 'mapping' as b, (select count(*) from a) as ids_a, (select count(*) from a where claim_id not in (from b)) as missing union all select 'claims', 'verdicts', (select count(*) from a), (select count(*) from a where claim_id not in (from c))
  union all select 'mapping', 'claims', (select count(*) from b), (select count(*) from b where claim_id not in (from a)) union all select 'mapping', 'verdicts', (select count(*) from b), (select count(*) from b where claim_id not in (from c))
  union all select 'verdicts', 'claims', (select count(*) from c), (select count(*) from c where claim_id not in (from a)) union all select 'verdicts', 'mapping', (select count(*) from c), (select count(*) from c where claim_id not in (from b))"""))
def e18(spark, d):
    c = table(spark, d, "claims")
    return e.gold_integrity({"claims": c, "mapping": c.filter("pos % 2 = 0"), "verdicts": c.filter("pos % 3 = 0").selectExpr("claim_id + 8 as claim_id")})


@query("e19_confusion", "select count(*) as n, round(avg((toxic = 1) = (quality = 0)::int::bool), 6) as accuracy, count(*) filter (where quality = 1 and toxic = 1) as false_negatives, count(*) filter (where quality = 0 and toxic = 0) as false_positives, count(*) filter (where doc_id % 10 between 4 and 6) as ambiguous from labels".replace("avg((toxic = 1) = (quality = 0)::int::bool)", "avg(((toxic = 1) = (quality = 0))::int)"))
def e19(spark, d):
    return e.confusion(table(spark, d, "labels").selectExpr("toxic = 1 as gold", "quality = 0 as predicted", "cast(doc_id % 10 as double) / 10 as score"))
