"""Slots, dimensions and period arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import periods as p
from factloom.operators import slots as ops
from factloom.registry import query

from .packs import ENGLISH
from .views import over, table

#: Names of a table's codes: a supplier's nation and region names, and item names of its flags.
DIMS = """dims as (select s_suppkey as table_id, 'area' as axis, cast(n_nationkey as varchar) as code, n_name as name, n_nationkey as ord from supplier, nation where n_nationkey % 5 = s_suppkey % 5
  union all select s_suppkey, 'zone', cast(r_regionkey as varchar), r_name, r_regionkey from supplier, region)"""
_REQ = "req as (select claim_id, supp as table_id, comparison_target as a, case supp % 3 when 0 then 'ASIA' when 1 then 'the AMERICA market' end as b from claims)"


def dims(spark, d):
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    area = s.join(n, n["n_nationkey"] % 5 == s["s_suppkey"] % 5).selectExpr("s_suppkey as table_id", "'area' as axis", "cast(n_nationkey as string) as code", "n_name as name", "n_nationkey as ord")
    zone = s.crossJoin(F.broadcast(r)).selectExpr("s_suppkey as table_id", "'zone' as axis", "cast(r_regionkey as string) as code", "r_name as name", "r_regionkey as ord")
    return area.unionByName(zone)


def req(spark, d):
    return table(spark, d, "claims").selectExpr("claim_id", "supp as table_id", "comparison_target as a", "case supp % 3 when 0 then 'ASIA' when 1 then 'the AMERICA market' end as b")


_BEST = """pr as (select claim_id, axis, code, name, row_number() over (partition by claim_id {axis} order by f, case when t = name then 0 else 1 end, length(name) desc, ord, code) as k from
  (select claim_id, table_id, 0 as f, a as t from req where a is not null union all select claim_id, table_id, 1, b from req where b is not null) join dims using (table_id) where contains(t, name) or contains(name, t))"""


@query("p1_match_by_name", over(f"with {DIMS}, {_REQ}, {_BEST.format(axis='')} select claim_id, code, name from pr where k = 1"))
def p1(spark, d):
    return ops.match_by_name(req(spark, d), dims(spark, d), ["a", "b"])


_ZONES = "dims as (select s_suppkey as table_id, 'zone' as axis, cast(r_regionkey as varchar) as code, r_name as name, r_regionkey as ord from supplier, region)"


@query("p2_select_item", over(f"with {_ZONES}, {_REQ}, {_BEST.format(axis='')} select claim_id, code as item_id from pr where k = 1"))
def p2(spark, d):
    return ops.match_by_name(req(spark, d), dims(spark, d).filter("axis = 'zone'"), ["a", "b"]).select("claim_id", F.col("code").alias("item_id"))


_SEL = f"{DIMS}, {_REQ}, {_BEST.format(axis=', axis')}"


@query("p3_select_dims", over(f"with {_SEL} select claim_id, string_agg(axis || '=' || code, ',' order by axis) as slots from pr where k = 1 and not (axis = 'zone' and claim_id % 4 = 0) group by claim_id"))
def p3(spark, d):
    filled = table(spark, d, "claims").filter("claim_id % 4 = 0").selectExpr("claim_id", "'zone' as axis")
    got = ops.select_dims(req(spark, d), dims(spark, d), filled, ["a", "b"])
    return got.select("claim_id", F.array_join(F.transform(F.map_entries("slots"), lambda e: F.concat(e.key, F.lit("="), e.value)), ",").alias("slots"))


@query("p4_dim_hints", over(f"with {DIMS}, {_REQ} select claim_id, axis, first(name order by length(name) desc, name) as label from req join dims using (table_id) where contains(regexp_replace(b, '\\s+', '', 'g'), name) group by claim_id, axis"))
def p4(spark, d):
    return ops.dim_hints(req(spark, d), dims(spark, d), "b")


@query("p5_demo_hints", over("select claim_id, case when contains(sentence, 'units') then 'count' when contains(sentence, 'percent') then 'rate' end as kind, case when contains(sentence, 'rose') then 'up' end as way from claims"))
def p5(spark, d):
    h = ops.demo_hints(F.col("sentence"), [("percent", "kind", "rate"), ("units", "kind", "count"), ("rose", "way", "up")])
    return table(spark, d, "claims").select("claim_id", F.try_element_at(h, F.lit("kind")).alias("kind"), F.try_element_at(h, F.lit("way")).alias("way"))


@query("p6_ground_hints", over(f"with {DIMS}, {_REQ} select claim_id, code from req join dims using (table_id) where axis = 'zone' and name = 'ASIA' and name <> 'total' and contains(regexp_replace(b, '\\s+', '', 'g'), 'ASI')"))
def p6(spark, d):
    s = req(spark, d).selectExpr("claim_id", "table_id", "'zone' as axis", "'ASIA' as label", "'A SI' as quote", "b as question")
    return ops.ground_hints(s, dims(spark, d), ENGLISH).select("claim_id", "code")


_PARAMS = "pa as (select s_suppkey as table_id, 'area' as axis, 'A0' as dv from supplier where s_suppkey % 3 > 0 union all select s_suppkey, 'zone', 'Z0' from supplier where s_suppkey % 3 > 0)"


@query("p7_build_slots", over(f"with {_PARAMS} select c.claim_id, case when max(pa.axis) is not null then string_agg(pa.axis || '=' || case when pa.axis = 'area' and pos % 2 = 0 then 'X' else dv end, ',' order by pa.axis) end as slots from claims c left join pa on c.supp = pa.table_id group by c.claim_id"))
def p7(spark, d):
    params = table(spark, d, "supplier").filter("s_suppkey % 3 > 0").selectExpr("s_suppkey as table_id", "stack(2, 'area', 'A0', 'zone', 'Z0') as (axis, default_value)")
    r = table(spark, d, "claims").selectExpr("claim_id", "supp as table_id", "if(pos % 2 = 0, map('area', 'X'), cast(map() as map<string,string>)) as slots")
    got = ops.build_slots(r, params)
    return got.select("claim_id", F.when(F.col("slots").isNotNull(), F.array_join(F.transform(F.map_entries("slots"), lambda e: F.concat(e.key, F.lit("="), e.value)), ",")).alias("slots"))


@query("p8_dynamic_slots", over(f"with {_SEL} select r.claim_id, x.axis, coalesce(case when x.axis = 'area' and r.claim_id % 4 = 0 then 'M' end, pr.code, 'ALL') as code from req r join (select distinct table_id, axis from dims) x using (table_id) left join pr on pr.claim_id = r.claim_id and pr.axis = x.axis and pr.k = 1"))
def p8(spark, d):
    mapped = table(spark, d, "claims").filter("claim_id % 4 = 0").selectExpr("claim_id", "'area' as axis", "'M' as code")
    return ops.dynamic_slots(req(spark, d), dims(spark, d), mapped, ["a", "b"])


@query("p9_encode_dims", over(f"with {DIMS} select claim_id, label, coalesce(code, label) as code from (select claim_id, supp as table_id, 'zone' as axis, case when pos % 2 = 0 then 'EUROPE' else 'nowhere' end as label from claims) q left join dims on q.table_id = dims.table_id and q.axis = dims.axis and q.label = dims.name"))
def p9(spark, d):
    q = table(spark, d, "claims").selectExpr("claim_id", "supp as table_id", "'zone' as axis", "if(pos % 2 = 0, 'EUROPE', 'nowhere') as label")
    return ops.encode_dims(q, dims(spark, d)).select("claim_id", "label", "code")


@query("p10_missing_slots", over("select claim_id, concat_ws(',', case when supp % 2 = 0 and supp % 4 > 0 then 'age' end, case when pos % 2 > 0 then 'period' end, case when supp % 3 = 0 then 'region' end) as missing, case when pos % 2 > 0 then 'period' when supp % 3 = 0 then 'region' when supp % 2 = 0 and supp % 4 > 0 then 'age' end as ask from claims"))
def p10(spark, d):
    cat = table(spark, d, "supplier").selectExpr("s_suppkey as table_id", "filter(array('period', if(s_suppkey % 3 = 0, 'region', null), if(s_suppkey % 2 = 0, 'age', null)), x -> x is not null) as required_slots")
    r = table(spark, d, "claims").selectExpr("claim_id", "supp as table_id", "map('period', if(pos % 2 = 0, '2024', null), 'age', if(supp % 4 = 0, '20', null)) as slots")
    return ops.missing_slots(r, cat, ["period", "region", "age"]).select("claim_id", F.array_join("missing", ",").alias("missing"), "ask")


@query("p11_needs_region", over(f"with {DIMS} select table_id, count(distinct code) > 1 and not bool_or(name = 'NATION_1' and code = '1') as needs from dims where axis = 'area' group by table_id"))
def p11(spark, d):
    from dataclasses import replace

    defaults = table(spark, d, "supplier").selectExpr("s_suppkey as table_id", "'1' as default_value")
    return ops.needs_region(dims(spark, d), defaults, "area", replace(ENGLISH, national="NATION_1"))


@query("p12_granularity", over("select event_id, case when contains(t, 'quarter') then 'Q' when contains(t, 'month') then 'M' end as g from (select event_id, concat(case event_id % 4 when 0 then 'last quarter of the month ' when 1 then 'this month ' else '' end, event_type) as t from events)"))
def p12(spark, d):
    t = F.expr("concat(case event_id % 4 when 0 then 'last quarter of the month ' when 1 then 'this month ' else '' end, event_type)")
    return table(spark, d, "events").select("event_id", ops.granularity(t, ENGLISH).alias("g"))


@query("p13_choose_freq", over("select event_id, case event_id % 3 when 0 then case when w = 'M' then 'M' else 'Y' end when 1 then case when w in ('Q', 'M') then w else 'Q' end else 'Y' end as freq from (select event_id, case event_id % 5 when 0 then 'Q' when 1 then 'M' else 'Y' end as w from events)"))
def p13(spark, d):
    e = table(spark, d, "events").selectExpr("event_id", "case event_id % 5 when 0 then 'Q' when 1 then 'M' else 'Y' end as w", "case event_id % 3 when 0 then array('M', 'Y') when 1 then array('Q', 'M') else array('Y') end as s")
    return e.select("event_id", ops.choose_freq(F.col("w"), F.col("s")).alias("freq"))


_EXPR = "case event_id % 9 when 0 then '2023년' when 1 then '1955~1960년' when 2 then '3년 전' when 3 then '지난달' when 4 then '작년' when 5 then '지난해 말' when 6 then '2023년 3분기' when 7 then '지난분기' else '작년 7월' end"


@query("p14_normalize_period", over(f"""select event_id, case event_id % 9 when 0 then '2023' when 1 then '1960' when 2 then cast(y - 3 as varchar)
   when 3 then case f when 'M' then case when m = 1 then cast(y - 1 as varchar) || '12' else cast(y * 100 + m - 1 as varchar) end else '지난달' end
   when 4 then case f when 'M' then cast((y - 1) * 100 + m as varchar) when 'Q' then cast((y - 1) * 100 + q as varchar) else cast(y - 1 as varchar) end
   when 5 then case f when 'M' then cast((y - 1) * 100 + 12 as varchar) when 'Q' then cast((y - 1) * 100 + 4 as varchar) else cast(y - 1 as varchar) end
   when 6 then case f when 'Q' then '202303' else '2023년 3분기' end
   when 7 then case f when 'Q' then case when q = 1 then cast(y - 1 as varchar) || '04' else cast(y * 100 + q - 1 as varchar) end else '지난분기' end
   else case f when 'M' then cast((y - 1) * 100 + 7 as varchar) when 'Q' then cast((y - 1) * 100 + q as varchar) else cast(y - 1 as varchar) end end as period
  from (select event_id, year(ts) as y, month(ts) as m, (month(ts) - 1) // 3 + 1 as q, case event_id % 3 when 0 then 'Y' when 1 then 'M' else 'Q' end as f from (select event_id, cast(ts as date) + cast(event_id % 700 as int) as ts from events))"""))
def p14(spark, d):
    e = table(spark, d, "events").selectExpr("event_id", "date_add(cast(ts as date), cast(event_id % 700 as int)) as at", f"{_EXPR} as e", "case event_id % 3 when 0 then 'Y' when 1 then 'M' else 'Q' end as f")
    return e.select("event_id", p.normalize(F.col("e"), F.col("f"), F.col("at")).alias("period"))


#: A relative expression of the article's date, by event, and what it stands for in years, quarters and months.
_RELATIVE = [
    ("전전년", "y - 2", "(y - 2) * 100 + q", "(y - 2) * 100 + m"), ("전전년도", "y - 2", "(y - 2) * 100 + q", "(y - 2) * 100 + m"), ("전년도", "y - 1", "(y - 1) * 100 + q", "(y - 1) * 100 + m"), ("직전연도", "y - 1", "(y - 1) * 100 + q", "(y - 1) * 100 + m"),
    ("당월", None, None, "y * 100 + m"), ("다음달", None, None, "case when m = 12 then (y + 1) * 100 + 1 else y * 100 + m + 1 end"), ("4년여 전", "y - 4", "y - 4", "y - 4"), ("1955–1960년", "1960", "1960", "1960"),
    ("직전분기", None, "case when q = 1 then (y - 1) * 100 + 4 else y * 100 + q - 1 end", None), ("당분기", None, "y * 100 + q", None), ("당해", None, None, None), ("1년새", None, None, None), ("전기", None, None, None),
    ("연말", None, "y * 100 + 4", "y * 100 + 12"), ("금년 3월", "y", "y * 100 + q", "y * 100 + 3"), ("2019년 12월", None, None, "201912"), ("전분기", None, "case when q = 1 then (y - 1) * 100 + 4 else y * 100 + q - 1 end", None),
]
_WORDS = f"case event_id % {len(_RELATIVE)} " + " ".join(f"when {i} then '{w}'" for i, (w, *_) in enumerate(_RELATIVE)) + " end"
_MEANT = "case " + " ".join(f"when event_id % {len(_RELATIVE)} = {i} and f = '{f}' then cast({x} as varchar)" for i, (_, *xs) in enumerate(_RELATIVE) for f, x in zip("YQM", xs) if x) + f" else {_WORDS} end"
_FREQ = f"case event_id // {len(_RELATIVE)} % 3 when 0 then 'Y' when 1 then 'M' else 'Q' end"


@query("p14_relative_words", over(f"select event_id, {_MEANT} as period from (select event_id, year(ts) as y, month(ts) as m, (month(ts) - 1) // 3 + 1 as q, {_FREQ} as f from (select event_id, cast(ts as date) + cast(event_id % 700 as int) as ts from events))"))
def p14_relative(spark, d):
    e = table(spark, d, "events").selectExpr("event_id", "date_add(cast(ts as date), cast(event_id % 700 as int)) as at", f"{_WORDS} as e", f"{_FREQ.replace('//', 'div')} as f")
    return e.select("event_id", p.normalize(F.col("e"), F.col("f"), F.col("at")).alias("period"))


_VALID = "(1, '직전분기'), (2, '당해 말'), (3, '1년새'), (4, '다음달'), (5, '지난주'), (6, '전기 대비'), (7, '최근'), (8, '내년'), (9, '2024년'), (10, '202404')"


@query("p16_relative_words", over(f"select event_id, e, k is null or k not in (7, 8, 9) as ok from (select event_id, k, e from events left join (values {_VALID}) v(k, e) on event_id % 11 = k)"))
def p16_relative(spark, d):
    words = spark.sql(f"select * from values {_VALID} as v(k, e)")
    e = table(spark, d, "events").select("event_id", (F.col("event_id") % 11).alias("k")).join(F.broadcast(words), "k", "left")
    return e.select("event_id", "e", p.valid(F.col("e")).alias("ok"))


@query("p15_month_period", over("""select event_id, case event_id % 4 when 0 then '202406' when 1 then cast((y - 1) * 100 + 11 as varchar) when 2 then cast((y - case when 10 >= m then 1 else 0 end) * 100 + 10 as varchar) else cast(y * 100 + 5 as varchar) end as period
  from (select event_id, year(a) as y, month(a) as m from (select event_id, cast(ts as date) + cast(event_id % 700 as int) as a from events))"""))
def p15(spark, d):
    e = table(spark, d, "events").selectExpr("event_id", "date_add(cast(ts as date), cast(event_id % 700 as int)) as at", "case event_id % 4 when 0 then '24년 6월 수출' when 1 then '작년 11월' when 2 then '지난 10월' else '올 5월' end as e")
    return e.select("event_id", p.month_period(F.col("e"), F.col("at")).alias("period"))


@query("p16_valid_period", over("""select event_id, e is null or regexp_matches(e, '^\\d{4}$|^\\d{6}$') or contains(e, '작년') as ok, case when not coalesce(case f when 'Y' then regexp_matches(e, '^\\d{4}$') when 'M' then regexp_matches(e, '^\\d{4}(0[1-9]|1[0-2])$') else regexp_matches(e, '^\\d{4}0[1-4]$') end, false) then 'bad period for ' || f end as problem
  from (select event_id, case event_id % 7 when 0 then '2024' when 1 then '202413' when 2 then '작년' when 3 then 'soon' when 4 then '202404' when 5 then '2024011' end as e, case event_id % 3 when 0 then 'Y' when 1 then 'M' else 'Q' end as f from events)"""))
def p16(spark, d):
    e = table(spark, d, "events").selectExpr("event_id", "case event_id % 7 when 0 then '2024' when 1 then '202413' when 2 then '작년' when 3 then 'soon' when 4 then '202404' when 5 then '2024011' end as e", "case event_id % 3 when 0 then 'Y' when 1 then 'M' else 'Q' end as f")
    return e.select("event_id", p.valid(F.col("e")).alias("ok"), p.fits(F.col("e"), F.col("f")).alias("problem"))


@query("p17_ground_region", over("select claim_id, case when contains(regexp_replace(sentence, '\\s+', '', 'g'), 'supplier' || cast(supp // 2 as varchar)) then 'supplier ' || cast(supp // 2 as varchar) end as region from claims"))
def p17(spark, d):
    return table(spark, d, "claims").select("claim_id", ops.ground_region(F.expr("concat('supplier ', cast(supp div 2 as string))"), F.col("sentence")).alias("region"))


@query("p18_merge_turns", """with t as (select conv_id, turn, case when length(text) % 3 = 0 then cast(length(text) as varchar) end as period, case when length(text) % 5 = 0 then role end as region from conversations)
  select conv_id, turn, first_value(period ignore nulls) over w as period, first_value(region ignore nulls) over w as region from t window w as (partition by conv_id order by turn rows between unbounded preceding and current row)""")
def p18(spark, d):
    t = table(spark, d, "conversations").selectExpr("conv_id", "turn", "if(length(text) % 3 = 0, cast(length(text) as string), null) as period", "if(length(text) % 5 = 0, role, null) as region")
    return ops.merge_turns(t, ["period", "region"])


@query("p19_prior_year", over("select claim_id, case when length(period) = 6 then cast(cast(left(period, 4) as int) - 1 as varchar) || right(period, 2) else cast(cast(period as int) - 1 as varchar) end as base from claims"))
def p19(spark, d):
    return table(spark, d, "claims").select("claim_id", p.prior_year(F.col("period")).alias("base"))


@query("p20_prior_immediate", over("select claim_id, case when freq = 'Y' then cast(cast(period as int) - 1 as varchar) when right(period, 2) = '01' then cast(cast(left(period, 4) as int) - 1 as varchar) || '12' else cast(cast(period as int) - 1 as varchar) end as base from claims"))
def p20(spark, d):
    return table(spark, d, "claims").select("claim_id", p.prior_immediate(F.col("period"), F.col("freq")).alias("base"))


@query("p21_wants_immediate", over("select event_id, event_id % 6 in (1, 3, 4) as wants from events"))
def p21(spark, d):
    e = F.expr("case event_id % 6 when 0 then '작년 3월' when 1 then '전월' when 2 then '지난해' when 3 then '3월' when 4 then '직전 분기' else null end")
    return table(spark, d, "events").select("event_id", p.wants_immediate(e).alias("wants"))


@query("p22_anchor_base", over("""select claim_id, case when freq = 'M' then case pos % 5 when 0 then left(period, 4) || '01' when 1 then cast(y - 1 as varchar) || '12' when 2 then cast((y * 12 + m - 1 - 5) // 12 as varchar) || lpad(cast((y * 12 + m - 1 - 5) % 12 + 1 as varchar), 2, '0') when 3 then left(period, 4) || '07' end end as base
  from (select *, cast(left(period, 4) as int) as y, case when length(period) = 6 then cast(right(period, 2) as int) end as m from claims)"""))
def p22(spark, d):
    s = F.expr("case pos % 5 when 0 then '올해 들어' when 1 then '지난해 말보다' when 2 then '5개월 연속' when 3 then '하반기' else 'none' end")
    return table(spark, d, "claims").select("claim_id", p.anchor_base(s, F.col("period"), F.col("freq")).alias("base"))


@query("p23_series_start", over("select claim_id, case when contains(sentence, 'since the merger') then 1999 when contains(sentence, 'in 3 years') then cast(left(period, 4) as int) - 3 when contains(sentence, 'record') then 1960 end as start_year from claims"))
def p23(spark, d):
    return table(spark, d, "claims").select("claim_id", ops.series_start(F.col("sentence"), p.year_of(F.col("period")), ENGLISH).alias("start_year"))


@query("p24_special_tag", over("select claim_id, case when pos % 6 > 4 then 'multi_age' when contains(sentence, 'since the merger') then 'since_event' when contains(sentence, 'in 3 years') then 'n_years' when contains(sentence, 'record') then 'all_time' end as tag from claims"))
def p24(spark, d):
    return table(spark, d, "claims").select("claim_id", ops.special_tag(F.col("sentence"), F.expr("if(pos % 6 > 4, 2, 1)"), ENGLISH).alias("tag"))


#: Five-year age bands of each table, 0~4세 to 95~99세 and 100세이상.
_BANDS = "bands as (select s_suppkey as table_id, 'B' || cast(k as varchar) as code, k * 5 as lo, case when k < 20 then k * 5 + 4 end as hi from supplier, range(21) r(k))"


def _bands(spark, d):
    s = table(spark, d, "supplier").selectExpr("s_suppkey as table_id", "explode(sequence(0, 20)) as k")
    return s.selectExpr("table_id", "concat('B', cast(k as string)) as code", "if(k = 20, '100세이상', concat(cast(k * 5 as string), '~', cast(k * 5 + 4 as string), '세')) as name")


@query("p25_decade_codes", over(f"""with {_BANDS} select c.claim_id, c.dec as decade, string_agg(b.code, ',' order by b.code) as codes from (select claim_id, supp, pos, case pos % 4 when 0 then 20 when 1 then 70 when 2 then 10 else 30 end as dec from claims where pos % 4 in (0, 1, 3)) c
   join bands b on c.supp = b.table_id where case when pos % 4 = 1 then b.lo >= dec else b.lo >= dec and b.hi < dec + 10 end group by c.claim_id, c.dec"""))
def p25(spark, d):
    c = table(spark, d, "claims").selectExpr("claim_id", "supp as table_id", "case pos % 4 when 0 then '지난달 20대 취업자 수' when 1 then '70대 이상 인구' when 2 then '상위 10대 기업' else '전국 30대는' end as sentence")
    return ops.decade_codes(c, ops.parse_bands(_bands(spark, d))).select("claim_id", "decade", F.array_join("codes", ",").alias("codes"))


@query("p26_named_age_codes", over(f"""with {_BANDS} select c.claim_id, c.g as age_group, string_agg(b.code, ',' order by b.code) as codes from (select claim_id, supp, case pos % 3 when 0 then '청년' when 1 then '고령층' end as g, case pos % 3 when 0 then 15 when 1 then 65 end as glo, case pos % 3 when 0 then 29 end as ghi from claims where pos % 3 < 2) c
   join bands b on c.supp = b.table_id where lo >= glo and (ghi is null or coalesce(hi, 999) <= ghi) group by c.claim_id, c.g"""))
def p26(spark, d):
    c = table(spark, d, "claims").selectExpr("claim_id", "supp as table_id", "case pos % 3 when 0 then '청년 실업률' when 1 then '고령층 인구' else '전체' end as sentence")
    return ops.named_age_codes(c, _bands(spark, d)).select("claim_id", "age_group", F.array_join("codes", ",").alias("codes"))
