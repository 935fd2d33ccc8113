"""Official cells, calculations and the rule verdict."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import compute as v
from factloom.operators import series
from factloom.operators import verdict as j
from factloom.registry import query

from .views import over, table

#: Requests: what a claim's supplier shipped in the month that it names.
REQS = """rq as (select claim_id, supp as table_id, case pos % 3 when 0 then 'A' when 1 then 'N' else 'R' end as item_id, case when part % 2 = 0 then 'F' else 'O' end as dim,
   case when freq = 'M' then period else period || lpad(cast(1 + part % 12 as varchar), 2, '0') end as period, value, unit, claim_type, value_type, article_id, pos from claims)"""


def reqs(spark, d):
    return table(spark, d, "claims").selectExpr("claim_id", "supp as table_id", "case pos % 3 when 0 then 'A' when 1 then 'N' else 'R' end as item_id", "if(part % 2 = 0, 'F', 'O') as dim",
        "if(freq = 'M', period, concat(period, lpad(cast(1 + part % 12 as string), 2, '0'))) as period", "value", "unit", "claim_type", "value_type", "article_id", "pos")


def _obs(spark, d):
    return table(spark, d, "observations")


_SER = "se as (select claim_id, o.period, o.value, o.unit from rq join observations o using (table_id, item_id, dim) where o.period between '199701' and rq.period)"


def _stretches(spark, d):
    return reqs(spark, d).drop("value", "unit").withColumns({"start_period": F.lit("199701"), "end_period": F.col("period")}).drop("period")


def _series(spark, d):
    return v.fetch_series(_stretches(spark, d), _obs(spark, d))


@query("v1_parse_value", over("select event_id, case when s in ('', '-', '..', 'X', 'n/a') then null else cast(replace(s, ',', '') as double) end as value from (select event_id, case event_id % 6 when 0 then '-' when 1 then '..' when 2 then 'X' when 3 then '1,234' when 4 then '' else cast(event_id as varchar) end as s from events)"))
def v1(spark, d):
    s = F.expr("case event_id % 6 when 0 then ' - ' when 1 then '..' when 2 then 'X' when 3 then '1,234' when 4 then '' else cast(event_id as string) end")
    return table(spark, d, "events").select("event_id", v.parse_value(s).alias("value"))


@query("v2_lookup_cell", over(f"with {REQS} select claim_id, case when n = 1 then 'ok' when n > 1 then 'many' when a > 0 then 'other_period' else 'none' end as status, case when n = 1 then val end as value, case when n = 1 then u end as unit from (select claim_id, count(*) filter (where o.period = rq.period) as n, count(o.period) as a, min(o.value) filter (where o.period = rq.period) as val, min(o.unit) filter (where o.period = rq.period) as u from rq left join observations o using (table_id, item_id, dim) group by claim_id)"))
def v2(spark, d):
    return v.lookup_cell(reqs(spark, d).drop("value", "unit"), _obs(spark, d))


@query("v3_fetch_series", over(f"with {REQS}, {_SER} select claim_id, count(*) as n, sum(value) as total, min(period) as first_period from se group by claim_id"))
def v3(spark, d):
    return _series(spark, d).groupBy("claim_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.min("period").alias("first_period"))


@query("v4_fetch_codes", over(f"with {REQS} select claim_id, o.dim, o.value, o.unit from rq join observations o on rq.table_id = o.table_id and rq.item_id = o.item_id and rq.period = o.period where o.dim in ('F', 'O')"))
def v4(spark, d):
    r = reqs(spark, d).drop("value", "unit").withColumn("dims", F.array(F.lit("F"), F.lit("O"), F.lit("F")))
    return v.fetch_codes(r, _obs(spark, d))


@query("v5_asof_month", over(f"with {REQS} select claim_id, max(o.period) as period, arg_max(o.value, o.period) as value from rq join observations o using (table_id, item_id, dim) where cast(left(o.period, 4) as int) * 12 + cast(right(o.period, 2) as int) between cast(left(rq.period, 4) as int) * 12 + cast(right(rq.period, 2) as int) - 3 and cast(left(rq.period, 4) as int) * 12 + cast(right(rq.period, 2) as int) group by claim_id"))
def v5(spark, d):
    return v.asof_month(reqs(spark, d).drop("value", "unit"), _obs(spark, d))


_CELLS = "ce as (select claim_id, o.dim, o.value, case when claim_id % 7 = 0 then o.dim else o.unit end as unit from rq join observations o on rq.table_id = o.table_id and rq.item_id = o.item_id and rq.period = o.period)"


def _cells(spark, d):
    return v4(spark, d).withColumn("unit", F.expr("if(claim_id % 7 = 0, dim, unit)"))


@query("v6_sum", over(f"with {REQS}, {_CELLS} select claim_id, case when count(distinct unit) > 1 then 'mixed_units' else 'ok' end as status, case when count(distinct unit) = 1 then sum(value) end as value, case when count(distinct unit) = 1 then min(unit) end as unit from ce group by claim_id"))
def v6(spark, d):
    return v.agg_sum(_cells(spark, d))


@query("v7_ratio", over(f"with {REQS}, {_CELLS} select claim_id, case when u > 1 then 'mixed_units' when coalesce(b, 0) = 0 then 'zero_base' when a is null then 'empty' else 'ok' end as status, case when u = 1 and b > 0 then round(a / b * 100, 1) end as value from (select claim_id, count(distinct unit) as u, sum(value) filter (where dim = 'F') as a, sum(value) filter (where dim = 'O') as b from ce group by claim_id)"))
def v7(spark, d):
    return v.agg_ratio(_cells(spark, d).withColumn("part", F.col("dim") == "F"))


_PAIR = "pq as (select claim_id, o.value, o.unit, b.value as base from rq join observations o using (table_id, item_id, dim, period) left join observations b on b.table_id = rq.table_id and b.item_id = rq.item_id and b.dim = rq.dim and b.period = cast(cast(rq.period as int) - 100 as varchar))"


def _pairs(spark, d):
    from factloom.functions.periods import prior_year

    cells = reqs(spark, d).drop("value", "unit").join(_obs(spark, d).select(*v.CELL, "period", "value", "unit"), [*v.CELL, "period"])
    return v.with_base(cells.withColumn("base_period", prior_year(F.col("period"))), _obs(spark, d))


@query("v8_change", over(f"with {REQS}, {_PAIR} select claim_id, value - base as result from pq"))
def v8(spark, d):
    return _pairs(spark, d).select("claim_id", v.change().alias("result"))


@query("v9_change_rate", over(f"with {REQS}, {_PAIR} select claim_id, round((value - base) / nullif(base, 0) * 100, 1) as result from pq"))
def v9(spark, d):
    return _pairs(spark, d).select("claim_id", v.change_rate().alias("result"))


@query("v10_rate_or_points", over(f"with {REQS}, {_PAIR} select claim_id, case when unit = '%' then round(value - base, 4) else round((value - base) / nullif(base, 0) * 100, 1) end as result, case when unit = '%' then '%p' else '%' end as result_unit, case when unit = '%' then 'change' else 'rate' end as calc_type from pq"))
def v10(spark, d):
    return v.rate_or_points(_pairs(spark, d)).select("claim_id", "result", "result_unit", "calc_type")


@query("v11_max_check", over(f"with {REQS}, {_SER} select claim_id, 'ok' as status, max(value) as value, first(period order by value desc, period) as period from se group by claim_id"))
def v11(spark, d):
    return series.range_extremes(_stretches(spark, d), _obs(spark, d), True)


@query("v12_min_check", over(f"with {REQS}, {_SER} select claim_id, 'ok' as status, min(value) as value, first(period order by value, period) as period from se group by claim_id"))
def v12(spark, d):
    return series.range_extremes(_stretches(spark, d), _obs(spark, d), False)


_KIND = "case pos % 6 when 0 then 'rate' when 1 then 'change' when 2 then 'max_check' when 3 then 'min_check' else 'lookup' end"
COMPUTED = f"""{REQS}, k as (select *, {_KIND} as calc_type from rq), {_SER}, co as (
  select k.claim_id, calc_type, case when o.value is not null then 'ok' when exists (select 1 from observations x where x.table_id = k.table_id and x.item_id = k.item_id and x.dim = k.dim) then 'other_period' else 'none' end as status, o.value, k.period
    from k left join observations o on o.table_id = k.table_id and o.item_id = k.item_id and o.dim = k.dim and o.period = k.period where calc_type = 'lookup'
  union all select k.claim_id, calc_type, case when o.value is null then 'none' when b.value is null then 'no_base' when calc_type = 'rate' and b.value = 0 then 'zero_base' else 'ok' end,
    case when calc_type = 'rate' then round((o.value - b.value) / nullif(b.value, 0) * 100, 1) else o.value - b.value end, cast(cast(k.period as int) - 100 as varchar) || '~' || k.period
    from k left join observations o on o.table_id = k.table_id and o.item_id = k.item_id and o.dim = k.dim and o.period = k.period left join observations b on b.table_id = k.table_id and b.item_id = k.item_id and b.dim = k.dim and b.period = cast(cast(k.period as int) - 100 as varchar) where calc_type in ('rate', 'change')
  union all select k.claim_id, any_value(calc_type), case when count(se.value) > 0 then 'ok' else 'empty' end, case when any_value(calc_type) = 'max_check' then max(se.value) else min(se.value) end,
    case when any_value(calc_type) = 'max_check' then first(se.period order by se.value desc, se.period) else first(se.period order by se.value, se.period) end from k left join se on se.claim_id = k.claim_id where calc_type in ('max_check', 'min_check') group by k.claim_id)"""


def computed(spark, d):
    r = reqs(spark, d).drop("value", "unit").withColumns({"calc_type": F.expr(_KIND), "start_period": F.lit("199701")})
    return v.compute(r, _obs(spark, d))


@query("v13_compute", over(f"with {COMPUTED} select claim_id, calc_type, status, value, period from co"))
def v13(spark, d):
    return computed(spark, d)


# The verdict: claims beside what was computed for them.
_JUDGED = f"""{COMPUTED}, jd as (select rq.claim_id, article_id, pos, rq.value as claim_value, unit as claim_unit, claim_type, value_type, rq.period as claim_period, calc_type, co.value as computed_value, case when claim_id % 11 = 0 then '2020=100' when rq.table_id % 4 = 0 then '%' else 'units' end as computed_unit, co.period as computed_period from rq join co using (claim_id)),
  jf as (select *, unit_p as pct, abs(claim_value - computed_value) as gap, case when unit_p then 0.1 else 0.5 * pow(10, case when claim_value is null then null when claim_value % 10 = 0 then 1 else 0 end) end as tolerance,
   coalesce(claim_type = 'level' and calc_type in ('change', 'rate') and not (value_type = 'delta' and calc_type = 'change') or claim_type = 'rate' and calc_type in ('lookup', 'sum', 'level') or calc_type not in ('change', 'rate') and unit_p and computed_unit = '2020=100', false) as type_off,
   claim_unit <> computed_unit and not unit_p as unit_off, coalesce(abs(cast(left(claim_period, 4) as int) - cast(left(computed_period, 4) as int)) > 3 and abs(cast(left(claim_period, 4) as int) - cast(left(right(computed_period, 6), 4) as int)) > 3, false) as year_off
   from (select *, claim_unit = '%' as unit_p from jd))"""


def judged(spark, d, r=None, obs=None):
    """Claims with what was computed for them; from requests and observations that are at hand, if given."""
    asks = (reqs(spark, d) if r is None else r).withColumnsRenamed({"value": "claim_value", "unit": "claim_unit"}).withColumns({"claim_period": F.col("period"), "calc_type": F.expr(_KIND), "start_period": F.lit("199701")})
    own = ("article_id", "pos", "table_id", "claim_value", "claim_unit", "claim_type", "value_type", "claim_period")
    c = v.compute(asks, _obs(spark, d) if obs is None else obs, own).select("claim_id", *own, "calc_type", F.col("value").alias("computed_value"), F.col("period").alias("computed_period"))
    return c.withColumn("computed_unit", F.expr("case when claim_id % 11 = 0 then '2020=100' when table_id % 4 = 0 then '%' else 'units' end"))


@query("j1_is_percent", over(f"with {_JUDGED} select claim_id, case when pos % 2 = 0 then pct else computed_unit = '%' or claim_type = 'rate' end as pct from jf"))
def j1(spark, d):
    x = judged(spark, d).withColumn("claim_unit", F.expr("if(pos % 2 = 0, claim_unit, null)"))
    return x.select("claim_id", j.is_percent().alias("pct"))


@query("j2_gap", over(f"with {_JUDGED} select claim_id, gap from jf"))
def j2(spark, d):
    return judged(spark, d).select("claim_id", j.gap().alias("gap"))


@query("j3_tolerance", over("select result_id, case result_id % 5 when 0 then 500.0 when 1 then 0.05 when 2 then 0.1 when 3 then 50.0 else 0.5 end as tolerance from records"))
def j3(spark, d):
    x = table(spark, d, "records").selectExpr("result_id", "cast(case result_id % 5 when 0 then 100000 when 1 then 4.3 when 2 then 12 when 3 then 1200 else 91155 end as double) as claim_value", "if(result_id % 5 in (1, 2), '%', 'units') as claim_unit", "cast(null as string) as computed_unit", "'level' as claim_type")
    return x.select("result_id", j.tolerance().alias("tolerance"))


@query("j4_type_mismatch", over(f"with {_JUDGED} select claim_id, type_off from jf"))
def j4(spark, d):
    return judged(spark, d).select("claim_id", j.type_mismatch().alias("type_off"))


@query("j5_gran_mismatch", over("select claim_id, case when pos % 3 = 2 then false else (length(period) = 6) <> (pos % 3 = 0) end as gran_off from claims"))
def j5(spark, d):
    x = table(spark, d, "claims").selectExpr("claim_id", "period as claim_period", "case pos % 3 when 0 then '202301~202401' when 1 then '2023' else 'soon' end as computed_period")
    return x.select("claim_id", j.gran_mismatch().alias("gran_off"))


@query("j6_year_mismatch", over("select claim_id, case when pos % 2 = 0 then abs(cast(left(period, 4) as int) - 2001) > 3 and abs(cast(left(period, 4) as int) - 1992) > 3 else false end as year_off from claims"))
def j6(spark, d):
    x = table(spark, d, "claims").selectExpr("claim_id", "period as claim_period", "if(pos % 2 = 0, '1992~200105', 'x') as computed_period")
    return x.select("claim_id", j.year_mismatch().alias("year_off"))


_RULE = "case when gap <= tolerance and not type_off and not unit_off and not year_off and coalesce(computed_period, '') <> '' then 'match' end"


@query("j7_rule_verdict", over(f"with {_JUDGED} select claim_id, gap, type_off, unit_off, year_off, {_RULE} as verdict from jf"))
def j7(spark, d):
    return j.rule_verdict(judged(spark, d)).select("claim_id", "gap", "type_off", "unit_off", "year_off", "verdict")


@query("j8_adjudication", over(f"with {_JUDGED} select claim_id, case when r is not null then r when claim_id % 4 = 0 then 'undecidable' when claim_id % 4 = 1 then 'mismatch' when claim_id % 4 = 2 then 'undecidable' end as verdict, case when r is null and claim_id % 4 = 1 then 'value' when r is null and claim_id % 4 = 2 then 'target' end as gap_type from (select *, {_RULE} as r from jf)"))
def j8(spark, d):
    replies = table(spark, d, "claims").filter("claim_id % 4 < 3").selectExpr("claim_id", """case claim_id % 4 when 0 then '{"verdict":"match","gap_type":"time","topic_match":false}' when 1 then '{"verdict":"mismatch","gap_type":"Numeric","topic_match":true}' else '{"verdict":"perhaps","gap_type":"scope","topic_match":true}' end as reply""")
    return j.apply_adjudication(j.rule_verdict(judged(spark, d)).select("claim_id", "verdict"), replies)


@query("j9_needs_joint", over(f"with {_JUDGED} select article_id, count(*) > 1 and bool_or(claim_type = 'compare') or count(computed_value) > 1 as joint from jf group by article_id"))
def j9(spark, d):
    return j.needs_joint(judged(spark, d))


@query("j10_early_exit", over("select claim_id, case when pos = 7 then 'undecidable' when supp % 5 = 0 then 'undecidable' when part % 6 = 0 then 'unclear' when pos = 4 then 'undecidable' end as verdict from claims"))
def j10(spark, d):
    x = table(spark, d, "claims").selectExpr("claim_id", "if(pos = 7, 'forecast', claim_type) as claim_type", "supp % 5 = 0 as is_foreign", "part % 6 > 0 as trusted", "if(pos = 4, null, 'lookup') as calc_type")
    return x.select("claim_id", j.early_exit()["verdict"].alias("verdict"))


@query("j11_records", over("select claim_id, left(md5(coalesce(source_org, '') || '|' || sentence), 12) as result_id, category, case when pos % 2 = 0 then 'yes' else 'no' end as calc_required from claims left join catalog on claims.part = catalog.table_id"))
def j11(spark, d):
    x = table(spark, d, "claims").selectExpr("claim_id", "source_org as title", "sentence", "part as table_id", "if(pos % 2 = 0, 'change', null) as calc_type")
    return j.to_records(x, table(spark, d, "catalog")).select("claim_id", "result_id", "category", "calc_required")


@query("j12_calc_summary", over("select claim_id, 'change ' || case when freq = 'M' then left(period, 4) || '년 ' || cast(cast(right(period, 2) as int) as varchar) || '월' else period end || '~2024' || case when value is null then '' else format(' {:.1f}', value) end || ' units' as summary from claims"))
def j12(spark, d):
    x = table(spark, d, "claims").selectExpr("claim_id", "'change' as calc_type", "concat(period, '~2024') as computed_period", "freq", "value as computed_value", "'units' as computed_unit")
    return j.calc_summary(x).select("claim_id", "summary")


@query("j13_check_explanations", over("select result_id, result_id % 3 > 0 and (verdict <> 'undecidable' or result_id % 2 = 0) as ok from records"))
def j13(spark, d):
    x = table(spark, d, "records").selectExpr("result_id", "verdict", "if(result_id % 3 = 0, ' ', 'because') as text", "if(result_id % 2 = 0, 'old data', null) as limitation")
    return j.check_explanations(x).select("result_id", "ok")
