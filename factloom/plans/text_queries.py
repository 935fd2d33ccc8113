"""Text preparation over documents and claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions.locale import BLANK as LOCALE_BLANK
from factloom.functions.locale import KOREAN
from factloom.operators import text
from factloom.registry import query

from .packs import ENGLISH
from .views import over, table

_INC = ENGLISH.include.replace("'", "''")
_COUNTED = ENGLISH.counted.replace("'", "''")
#: A document's sentences, as DuckDB splits them.
SENTENCES = r"""s as (select article_id, i - 1 as pos, regexp_replace(x, '^\s+|\s+$', '', 'g') as sentence from
  (select article_id, unnest(string_split(regexp_replace(text, '([.])\s+', '\1' || chr(1), 'g'), chr(1))) as x, generate_subscripts(string_split(regexp_replace(text, '([.])\s+', '\1' || chr(1), 'g'), chr(1)), 1) as i from articles)
  where regexp_replace(x, '^\s+|\s+$', '', 'g') <> '')"""


@query("t1_normalisers", over("select article_id, md5(regexp_replace(title, '\\s+', '', 'g')) as plain, md5(regexp_replace(title, '[\\s·]+', '', 'g')) as dotless, translate(title, '“”‘’', '\"\"''''') as quoted from articles"))
def t1(spark, d):
    a = table(spark, d, "articles")
    return a.select("article_id", F.md5(text.no_space(F.col("title"))).alias("plain"), F.md5(text.no_space_or_dot(F.col("title"))).alias("dotless"), text.straight_quotes(F.col("title")).alias("quoted"))


@query("t2_clean_articles", over("""select article_id, title,
  trim(regexp_replace(split_part(regexp_replace(case when length(title) > 0 then left(body, length(title)) || chr(10) || ltrim(substr(body, length(title) + 1), ' ') else body end, '^((?s:.)*?)(?:By [A-Z][a-z]+)', '\\1'), 'All rights reserved', 1), 'Related articles(?s:.)*', ''), ' ') as text
  from (select article_id, trim(title, ' ') as title, left(case when length(trim(title, ' ')) > 0 then substr(text, strpos(text, left(trim(title, ' '), 12))) else text end, 3000) as body from articles where length(title) < 3000 and title = trim(title))"""))
def t2(spark, d):
    a = table(spark, d, "articles").filter("length(title) < 3000 and title = trim(title)")
    return text.clean_articles(a.select("article_id", "title", "text"), ENGLISH)


@query("t3_clean_body", over("""select article_id, case when length(trim(c, ' ')) > 50 then trim(c, ' ') else text end as text from (
  select article_id, text, case when least(nullif(strpos(rest, 'All rights reserved'), 0), nullif(strpos(rest, 'Related articles'), 0)) is not null
     then left(rest, least(nullif(strpos(rest, 'All rights reserved'), 0), nullif(strpos(rest, 'Related articles'), 0)) - 1) else rest end as c
  from (select article_id, text, regexp_replace(text, '^(?s:.)*?(?:By [A-Z][a-z]+)', '') as rest from articles))"""))
def t3(spark, d):
    return text.clean_body(table(spark, d, "articles").select("article_id", "text"), ENGLISH)


#: Articles as scraped: with datelines after a menu, a player's text, or a block three times and a trailer.
_SCRAPED = """select article_id, case article_id % 4 when 1 then concat('Menu Published 2024.01.02. 03:04 Home Published 2024.01.02. 05:06 Updated 2024.01.02. 07:08 12 ', text)
   when 2 then concat('Video Player is loading. Play End of dialog window.', replace(text, chr(10), ' '), ' Video Player is loading. End of dialog window.')
   when 3 then concat(left(text, 60), left(text, 60), replace(text, chr(10), ' '), ' By Taboola ', left(text, 50)) else text end as text from articles"""
_BLANK = LOCALE_BLANK.replace("'", "''")
#: Twenty characters from each place on, and where they come again: runs of such places at one distance are equal blocks.
_LEADS = "".join(f" || lead(c, {i}) over w" for i in range(1, 20))
_SHOWN = rf"""raw as ({_SCRAPED}), bd as materialized (select article_id, regexp_replace(regexp_replace(regexp_replace(text, '(?s)(?:{ENGLISH.trailer}).*', ''), '{ENGLISH.widget}', ' ', 'g'), '(?s)\A.*{ENGLISH.dateline}', '') as t from raw),
  ch as (select article_id, unnest(string_split(t, '')) as c, generate_subscripts(string_split(t, ''), 1) as i from bd),
  gr as materialized (select article_id, i, c{_LEADS} as g from ch window w as (partition by article_id order by i)),
  pr as (select a.article_id, a.i, b.i - a.i as n from gr a join gr b on a.article_id = b.article_id and a.g = b.g and b.i - a.i between 20 and 300),
  il as (select *, i - row_number() over (partition by article_id, n order by i) as island from pr),
  ag as (select article_id, i, n, max(i) over (partition by article_id, n, island) - i + 20 as agree from il),
  en as materialized (select article_id, i, max(n) as n, max_by(i + n + agree // n * n, n) as e from ag where agree >= n group by 1, 2),
  nx as materialized (select a.*, b.i as nxt from en a asof left join en b on a.article_id = b.article_id and a.e <= b.i),
  sq as (select article_id, i, n, e, nxt, 1 as before from nx where (article_id, i) in (select (article_id, min(i)) from en group by article_id)
    union all select nx.article_id, nx.i, nx.n, nx.e, nx.nxt, sq.e from sq join nx on sq.article_id = nx.article_id and sq.nxt = nx.i),
  cl as (select article_id, string_agg(substr(t, before, i + n - before), '' order by i) || substr(any_value(t), max(e)) as t from sq join bd using (article_id) group by article_id),
  sh as (select article_id, regexp_replace(regexp_replace(coalesce(cl.t, bd.t), '\A{_BLANK}+', ''), '{_BLANK}+\z', '') as t from bd left join cl using (article_id)),
  sp as (select *, string_split(regexp_replace(t, '([.?!]){_BLANK}+([^0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)) as s from sh)"""


@query("t4_display_text", over(rf"""with {_SHOWN} select article_id, case when contains(t, chr(10)) or len(s) <= 1 then t else array_to_string(list_transform(range(0, (len(s) + 2) // 3), lambda k: array_to_string(list_slice(s, k * 3 + 1, k * 3 + 3), ' ')), chr(10) || chr(10)) end as text from sp""").replace("with ", "with recursive ", 1))
def t4(spark, d):
    return text.shown_text(spark.sql(_SCRAPED.replace("from articles", "from {articles}"), articles=table(spark, d, "articles")), ENGLISH)


@query("t5_sentences", over(f"with {SENTENCES} select article_id, cast(pos as int) as pos, sentence from s"))
def t5(spark, d):
    return text.sentences(table(spark, d, "articles"), ENGLISH)


@query("t6_dedupe_sentences", over(rf"""with {SENTENCES}, k as (select *, row_number() over (partition by article_id, regexp_replace(sentence, '\s+', '', 'g') order by pos) as nth from s)
  select article_id, string_agg(sentence, ' ' order by pos) as text from k where nth = 1 or length(regexp_replace(sentence, '\s+', '', 'g')) < 30 group by article_id"""))
def t6(spark, d):
    return text.dedupe_sentences(table(spark, d, "articles"), ENGLISH)


def _claim_articles(spark, d):
    """One text for each order: its claims' sentences."""
    c = table(spark, d, "claims")
    return c.groupBy("article_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda x: x.sentence), " ").alias("text"))


_CLAIM_SENTENCES = SENTENCES.replace("from articles", "from (select article_id, string_agg(sentence, ' ' order by pos) as text from claims group by article_id)")
_CANDS = f"""c as (select article_id, pos, sentence, case when len(regexp_extract_all(sentence, '{_COUNTED}')) = 0 and regexp_matches(sentence, '{ENGLISH.extreme}') then 1 else len(regexp_extract_all(sentence, '{_COUNTED}')) end as expressions
   from s where regexp_matches(sentence, '{_INC}'))"""


@query("t7_numeric_candidates", over(f"with {_CLAIM_SENTENCES}, {_CANDS} select article_id, cast(pos as int) as pos, sentence, expressions from c"))
def t7(spark, d):
    return text.numeric_candidates(_claim_articles(spark, d), ENGLISH)


_PART = "(select article_id, sentence from claims where pos % 2 = 0)"
_MISSED = f"""{_CLAIM_SENTENCES}, {_CANDS}, x as (select article_id as a, regexp_replace(sentence, '\\s+', '', 'g') as t from {_PART}),
  m as (select c.article_id, c.pos, c.sentence, c.expressions, count(x.t) as covered from c left join x on c.article_id = x.a and (contains(regexp_replace(c.sentence, '\\s+', '', 'g'), x.t) or contains(x.t, regexp_replace(c.sentence, '\\s+', '', 'g'))) group by all having count(x.t) < c.expressions)"""


@query("t8_missed_candidates", over(f"with {_MISSED} select article_id, cast(pos as int) as pos, sentence, expressions, covered from m"))
def t8(spark, d):
    return text.missed(text.numeric_candidates(_claim_articles(spark, d), ENGLISH), table(spark, d, "claims").filter("pos % 2 = 0"))


_END = "case when length({t}) - {a} <= 3000 then length({t}) when strpos(reverse(substr({t}, {a} + 1501, 1500)), '.') > 0 then {a} + 3001 - strpos(reverse(substr({t}, {a} + 1501, 1500)), '.') else {a} + 3000 end"


@query("t9_chunks", over(f"""with ch as (select article_id, text, 0 as chunk, 0 as a, {_END.format(t="text", a="0")} as b from articles where length(text) > 0
  union all select article_id, text, chunk + 1, b, {_END.format(t="text", a="b")} from ch where b < length(text))
  select article_id, chunk, substr(text, a + 1, b - a) as text from ch""").replace("with ", "with recursive ", 1))
def t9(spark, d):
    return text.chunks(table(spark, d, "articles"))


#: Korean sentences, one for each claim: what they say of its quantity goes by the claim.
_KOREAN = """ks as (select claim_id, claim_id % 6 as k, cast(cast(coalesce(value, 7) as int) as string) as q, cast(part % 900 + 11 as string) as p, pos from claims),
  kt as (select claim_id as article_id, pos, k, q, p, case k when 0 then concat('고령 인구는 ', q, '.1%로 역대 최고치를 기록했다.') when 1 then '인구가 역대 최저치다.' when 2 then concat(q, '위는 서울이다.')
    when 3 then concat('전국 ', q, '위 도시다.') when 4 then concat('만족도는 6.', q, '점이다.') else concat('취업자 ', p, '만명이 ', q, '개월째 줄었다.') end as text from ks)"""


def _korean(spark, d):
    return spark.sql(f"with {_KOREAN.replace('from claims', 'from {claims}')} select * from kt", claims=table(spark, d, "claims"))


@query("t7_korean_candidates", over(f"with {_KOREAN} select article_id, cast(0 as int) as pos, text as sentence, case k when 4 then 0 when 5 then 2 else 1 end as expressions from kt where k <> 2").replace("as string)", "as varchar)"))
def t7_korean(spark, d):
    return text.numeric_candidates(_korean(spark, d), KOREAN)


@query("t8_korean_missed", over(f"with {_KOREAN} select article_id, cast(0 as int) as pos, text as sentence, case k when 5 then 2 else 1 end as expressions, case when pos % 2 = 0 then 1 else 0 end as covered from kt where k not in (2, 4) and (k = 5 or pos % 2 = 1)").replace("as string)", "as varchar)"))
def t8_korean(spark, d):
    k = _korean(spark, d)
    return text.missed(text.numeric_candidates(k, KOREAN), k.filter("pos % 2 = 0").select("article_id", F.col("text").alias("sentence")))


@query("t10_batches", over(f"with {_MISSED} select article_id, cast(pos as int) as pos, floor((row_number() over (partition by article_id order by pos) - 1) / 3) as batch from m"))
def t10(spark, d):
    m = text.missed(text.numeric_candidates(_claim_articles(spark, d), ENGLISH), table(spark, d, "claims").filter("pos % 2 = 0"))
    return text.batches(m).select("article_id", "pos", F.col("batch").cast("double").alias("batch"))


@query("t11_compound_numbers", over("""select result_id, 10000.0 * (result_id % 900 + 1) + result_id % 7 * 1000 as value, length('from ') as start_at from records where result_id % 7 > 0"""))
def t11(spark, d):
    r = table(spark, d, "records").filter("result_id % 7 > 0").select("result_id", F.concat(F.lit("from "), F.expr("result_id % 900 + 1").cast("string"), F.lit("만"), F.expr("result_id % 7").cast("string"), F.lit("천명")).alias("s"))
    return r.select("result_id", F.inline(text.numbers_column(F.col("s")))).select("result_id", "value", F.col("start").cast("long").alias("start_at"))


@query("t12_claim_value", over("""select claim_id, case when comparison_operator = 'decrease' or (comparison_operator is null and claim_type = 'rate' and regexp_matches(sentence, 'fell|declined|dropped|decreased'))
  then -v else v end as claim_value from (select *, coalesce(value, cast(regexp_extract(sentence, '(fell to|rose to|shipped) (\\d+)', 2) as double)) as v from claims)"""))
def t12(spark, d):
    c = table(spark, d, "claims").withColumn("unit", F.expr("if(unit = '%', 'percent', unit)"))
    return text.claim_value(c, ENGLISH).select("claim_id", "claim_value")


#: Claims in Korean without a value: ages and lengths of time, units, directions.
_UNSAID = """ku as (select claim_id, claim_id % 7 as k, part % 900 + 11 as p, supp % 90 + 2 as q from claims),
  kv as (select claim_id, k, p, q, case k when 0 then '0~14세 인구가 줄었다.' when 1 then concat(cast(q as string), '주 동안 20시간 일했다.') when 2 then concat(cast(q as string), '주 동안 ', cast(p as string), '명이 줄었다.') when 3 then concat(cast(q as string), '개월 만에 ', cast(p as string), '% 낮아졌다.')
    when 4 then concat('근속은 ', cast(q as string), '개월이다.') when 5 then concat('수출은 ', cast(q as string), '억 ', cast(p as string), '만 달러 늘었다.') else concat('15~29세 ', cast(p as string), '명이 ', cast(q as string), '분기째 쉰다.') end as sentence,
    case k when 2 then '명' when 4 then '개월' when 5 then '달러' end as unit, case when k in (2, 3) then 'rate' else 'level' end as claim_type from ku)"""


@query("t12_korean_value", over(f"with {_UNSAID} select claim_id, cast(case k when 2 then -p when 3 then -p when 4 then q when 5 then q * 100000000 + p * 10000 when 6 then p end as double) as claim_value from kv").replace("as string)", "as varchar)"))
def t12_korean(spark, d):
    c = spark.sql(f"with {_UNSAID.replace('from claims', 'from {claims}')} select *, cast(null as double) as value, cast(null as string) as comparison_operator from kv", claims=table(spark, d, "claims"))
    return text.claim_value(c, KOREAN).select("claim_id", "claim_value")


@query("t13_number_variants", over("""select result_id, concat_ws('|', plain, commas, scaled) as forms from (select result_id, cast(n as varchar) as plain, format('{:,}', n) as commas,
   concat(case when n // 100000000 > 0 then cast(n // 100000000 as varchar) || '억' else '' end, case when n % 100000000 // 10000 > 0 then cast(n % 100000000 // 10000 as varchar) || '만' else '' end, case when n % 10000 > 0 then cast(n % 10000 as varchar) else '' end) as scaled
   from (select result_id, (result_id + 10000) * 7919 as n from records))"""))
def t13(spark, d):
    r = table(spark, d, "records").select("result_id", F.expr("(result_id + 10000) * 7919").alias("n"))
    return r.select("result_id", F.array_join(text.number_variants(F.col("n")), "|").alias("forms"))


@query("t14_strip_title", over("select article_id, ltrim(substr(text, length(title) + 1), ' ') as sentence from articles where length(title) > 0 union all select article_id, text from articles where length(title) = 0"))
def t14(spark, d):
    return text.strip_title(table(spark, d, "articles").select("article_id", "title", F.col("text").alias("sentence"))).select("article_id", "sentence")


def _replies(spark, d):
    c = table(spark, d, "claims")
    one = F.to_json(F.struct("sentence", "claim_type", F.col("value").cast("int").cast("string").alias("value"), "unit"))
    r = c.groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("pos", one.alias("j")))).alias("t"))
    whole = F.concat(F.lit("Here: ["), F.array_join(F.transform("t", lambda x: x.j), ", "), F.lit("] done"))
    # every third reply breaks off inside its last object
    return r.select("article_id", F.lit(0).alias("chunk_no"), F.expr("t").alias("t"), whole.alias("w")).select("article_id", "chunk_no", F.when(F.col("article_id") % 3 == 0, F.substring("w", F.lit(1), F.length("w") - 12)).otherwise(F.col("w")).alias("reply"))


@query("t15_parse_replies", over("""with n as (select *, row_number() over (partition by article_id order by pos) as k, count(*) over (partition by article_id) as n from claims)
  select article_id, cast(k - 1 as int) as pos, sentence, claim_type, cast(cast(value as int) as varchar) as value, unit, false as error from n where article_id % 3 <> 0 or k < n
  union all select article_id, null, null, null, null, null, true from n where article_id % 3 = 0 and n = 1"""))
def t15(spark, d):
    return text.parse_replies(_replies(spark, d)).drop("chunk_no")


@query("t16_coerce_claims", over("""select result_id, case when status in ('1-URGENT', '2-HIGH') then status end as claim_type, case result_id % 4 when 0 then 'increase' when 1 then 'decrease' end as comparison_operator,
  case when result_id % 5 = 0 then null else cast(result_id * 1000 as double) end as value, case when result_id % 2 = 0 then article_title else 'second' end as source_org from records"""))
def t16(spark, d):
    r = table(spark, d, "records").select("result_id", F.col("status").alias("claim_type"), F.expr("case result_id % 4 when 0 then 'rise' when 1 then 'fall' else 'unknown' end").alias("comparison_operator"),
        F.expr("if(result_id % 5 = 0, 'n/a', format_number(result_id * 1000, 0))").alias("value"), F.expr("if(result_id % 2 = 0, array(article_title, 'x'), array(' ', 'second'))").alias("source_orgs"))
    return text.coerce_claims(r, ENGLISH, ("1-URGENT", "2-HIGH"))


@query("t17_guard_labels", over(f"""with {_CLAIM_SENTENCES}, {_CANDS}, a as (select distinct article_id from c)
  select r.result_id as article_id, case when verdict = 'match' and score < 0.9 and a.article_id is not null then true when verdict = 'match' then false else false end as label,
   case when verdict = 'match' and not (score < 0.9 and a.article_id is not null) then least(score, 0.15) else score end as score from records r left join a on r.result_id = a.article_id"""))
def t17(spark, d):
    r = table(spark, d, "records").select(F.col("result_id").alias("article_id"), (F.col("verdict") == "match").alias("label"), "score", F.expr("if(score < 0.9, 'official statistics', 'none')").alias("reason"))
    return text.guard_labels(r, text.numeric_candidates(_claim_articles(spark, d), ENGLISH), ENGLISH).select("article_id", "label", "score")
