"""Retrieval, fusion and gates of table matching; top k, samples and places."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import matching as m
from factloom.operators import ranking as k
from factloom.operators import vectors
from factloom.registry import query

from .views import over, table

_SYN = "values ('market', 'widget'), ('red', 'gear')"
_SYNS = f"syn(term, target) as ({_SYN})"
_KS = f"""{_SYNS}, kw as (select distinct table_id, unnest(keywords) as kw from catalog), tx as (select distinct sentence as t from topics),
  ew as (select t, target from tx, syn where contains(t, term)),
  hw as (select t, kw, case when contains(regexp_replace(t, '\\s+', '', 'g'), kw) and not (kw = 'ring' and not contains(replace(regexp_replace(t, '\\s+', '', 'g'), 'redring', ''), kw)) then 1.0 when exists (select 1 from ew where ew.t = tx.t and ew.target = k.kw) then 0.5
     when length(kw) >= 5 and contains(regexp_replace(t, '\\s+', '', 'g'), left(kw, 5)) then 1.0 end as w from tx, (select distinct kw from kw) k),
  al as (select t, table_id, w from hw join kw using (kw) where w is not null union all select t, table_id, 1.0 from tx, catalog where contains(t, left(title, 6))),
  sc as (select claim_id, table_id, least(1.0, sum(w) / 3) as score from al join topics on sentence = t group by claim_id, table_id)"""


def _asked(spark, d):
    return table(spark, d, "topics"), table(spark, d, "catalog"), spark.sql(f"select * from {_SYN} as s(term, target)"), {"ring": ["redring"]}


@query("m1_keyword_scores", over(f"with {_KS} select claim_id, table_id, round(cast(score as double), 6) as score from sc"))
def m1(spark, d):
    return m.keyword_scores(*_asked(spark, d), digits=6)


#: A keyword's nouns as a tagger might give them: its first three and its last two characters, none for those of five.
_NOUNS = "case when length(kw) = 5 then {none} else {two} end"
_KM = _KS.replace("when length(kw) >= 5 and contains(regexp_replace(t, '\\s+', '', 'g'), left(kw, 5)) then 1.0", "when length(kw) <> 5 and contains(regexp_replace(t, '\\s+', '', 'g'), left(kw, 3)) and contains(regexp_replace(t, '\\s+', '', 'g'), right(kw, 2)) then 1.0")


@query("m1_morph_scores", over(f"with {_KM} select claim_id, table_id, round(cast(score as double), 6) as score from sc"))
def m1_morph(spark, d):
    topics, catalog, *how = _asked(spark, d)
    nouns = F.expr(_NOUNS.format(none="cast(array() as array<string>)", two="array(left(kw, 3), right(kw, 2))"))
    tokens = catalog.select(F.explode("keywords").alias("kw")).distinct().select("kw", nouns.alias("tokens"))
    return m.keyword_scores(topics, catalog, *how, tokens, digits=6)


@query("m2_expand_terms", over(f"with {_SYNS}, tx as (select distinct sentence as t from topics) select t, string_agg(distinct target, ',' order by target) as terms from tx, syn where contains(t, term) group by t"))
def m2(spark, d):
    x = m.expand_terms(table(spark, d, "topics").select(F.col("sentence").alias("t")).distinct(), spark.sql(f"select * from {_SYN} as s(term, target)"))
    return x.select("t", F.array_join("terms", ",").alias("terms"))


@query("m3_stem_match", over("select claim_id, contains(sentence, left('widgets', 5)) as hit, false as short from topics"))
def m3(spark, d):
    return table(spark, d, "topics").select("claim_id", m.stem_match(F.lit("widgets"), F.col("sentence")).alias("hit"), m.stem_match(F.lit("gear"), F.col("sentence")).alias("short"))


@query("m4_false_friend", over("select claim_id, contains(sentence, 'ring') and not contains(replace(replace(sentence, 'red ring', ''), 'blue ring', ''), 'ring') as only_false from topics"))
def m4(spark, d):
    return table(spark, d, "topics").select("claim_id", m.false_friend_only(F.lit("ring"), F.col("sentence"), {"ring": ["red ring", "blue ring"]}).alias("only_false"))


_TRI = """tq as (select distinct sentence as t from topics), ti as (select distinct title as t from catalog),
  qw as (select t, unnest(string_split(trim(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g')), ' ')) as w from tq), iw as (select t, unnest(string_split(trim(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g')), ' ')) as w from ti),
  qg as (select distinct t, substr('  ' || w || ' ', i, 3) as g from qw, range(1, 40) r(i) where i <= length(w) + 1), ig as (select distinct t, substr('  ' || w || ' ', i, 3) as g from iw, range(1, 40) r(i) where i <= length(w) + 1),
  qn as (select t, count(*) as n from qg group by t), inn as (select t, count(*) as n from ig group by t),
  sh as (select qg.t as qt, ig.t as it, count(*) as n from qg join ig using (g) group by 1, 2),
  ss as (select qt, it, sh.n / (qn.n + inn.n - sh.n) as s from sh join qn on qn.t = qt join inn on inn.t = it where sh.n / (qn.n + inn.n - sh.n) >= 0.1),
  tr as (select claim_id as qid, table_id, s as score, row_number() over (partition by claim_id order by s desc, table_id) as rank from topics join ss on sentence = qt join catalog on title = it)"""


@query("m5_trigram_topk", over(f"with {_TRI} select qid, table_id, round(score, 6) as score, rank from tr where rank <= 30"))
def m5(spark, d):
    x = m.trigram_topk(table(spark, d, "topics").selectExpr("claim_id as qid", "sentence as t"), table(spark, d, "catalog").selectExpr("table_id", "title as t"))
    return x.withColumn("score", F.round("score", 6))


@query("m6_keyword_topk", over(f"with {_KS} select * from (select claim_id, table_id, row_number() over (partition by claim_id order by score desc, table_id) as rank from sc) where rank <= 5"))
def m6(spark, d):
    return m.keyword_search(*_asked(spark, d)).select("claim_id", "table_id", "rank")


_COS = """qv as (select vec_id as qid, embedding::double[64] as q from embeddings where vec_id % 20 = 0), vr as (select qid, vec_id as table_id, round(array_cosine_similarity(q, embedding::double[64]), 9) as s from qv, embeddings),
  vk as (select *, row_number() over (partition by qid order by s desc, table_id) as rank from vr)"""


def _vectors(spark, d):
    e = table(spark, d, "embeddings").selectExpr("vec_id as table_id", "embedding")
    return e.filter("table_id % 20 = 0").withColumnRenamed("table_id", "qid"), e


@query("m7_vector_topk", f"with {_COS} select qid, table_id, round(s, 6) as score, rank from vk where rank <= 5")
def m7(spark, d):
    return vectors.vector_topk(*_vectors(spark, d)).withColumn("score", F.round("score", 6))


@query("m8_index_topk", f"with {_COS} select qid, table_id, round(s, 6) as score, rank from vk where rank <= 10 and s >= 0.5")
def m8(spark, d):
    return vectors.index_topk(*_vectors(spark, d)).withColumn("score", F.round("score", 6))


@query("m7_cell_recall")
def m7_cells(spark, d):
    q, x = _vectors(spark, d)
    return vectors.index_recall(q, x, k=5)


@query("m9_hash_embed", over("""with ch as (select claim_id as id, unnest(string_split(sentence, '')) as c from topics), ct as (select id, cast('0x' || right(md5(c), 2) as int) % 64 as d, count(*) as n from ch group by 1, 2)
  select id, max(case when d = 5 then n else 0 end) / sqrt(sum(n * n)) as v5, round(sum(n) / sqrt(sum(n * n)), 6) as total from ct group by id"""))
def m9(spark, d):
    x = m.hash_embed(table(spark, d, "topics").selectExpr("claim_id as id", "sentence as t"))
    return x.select("id", F.get("v", 5).alias("v5"), F.round(F.aggregate("v", F.lit(0.0), lambda a, b: a + b), 6).alias("total"))


@query("m10_expand_query", over("select claim_id, case when nation % 3 = 0 then sentence || ' bureau' || case when contains(sentence, 'market') then '' else ' market' end when nation % 3 = 1 then sentence || ' office' else sentence end as q from topics"))
def m10(spark, d):
    t = table(spark, d, "topics").withColumn("org", F.expr("case nation % 3 when 0 then 'A' when 1 then 'B' end"))
    return t.select("claim_id", m.expand_query(F.col("sentence"), F.col("org"), {"A": ["bureau", "market"], "B": ["office"]}).alias("q"))


@query("m11_morph_match", over("select table_id, contains(title, split_part(category, '#', 2)) and contains(title, 'ring') as hit, contains(title, keywords[1]) as own from catalog"))
def m11(spark, d):
    return table(spark, d, "catalog").select("table_id", m.morph_match(F.col("title"), F.array(F.split_part("category", F.lit("#"), F.lit(2)), F.lit("ring"))).alias("hit"), m.morph_match(F.col("title"), F.array(F.get("keywords", 0))).alias("own"))


_ORDER = ["keyword", "vector", "index", "lexical"]
_MC = """rk as (select *, row_number() over (partition by claim_id, source order by score desc, table_id) as rank from candidates),
  mc as (select claim_id, table_id, first(score order by case source when 'keyword' then 1 when 'vector' then 2 else 3 end) as score, max(rank) filter (where source = 'keyword') as kw, max(rank) filter (where source = 'vector') as vec, max(rank) filter (where source = 'index') as idx from rk group by claim_id, table_id)"""


def merged(spark, d):
    return m.merge_candidates(m.source_rank(table(spark, d, "candidates")), _ORDER)


def _ranks(df):
    return df.select("claim_id", "table_id", *[F.try_element_at("ranks", F.lit(n)).alias(a) for n, a in (("keyword", "kw"), ("vector", "vec"), ("index", "idx"))])


@query("m12_merge_candidates", over(f"with {_MC} select claim_id, table_id, kw, vec, idx from mc"))
def m12(spark, d):
    return _ranks(merged(spark, d))


@query("m13_population_signal", over(f"with {_MC} select claim_id, table_id, case when table_id % 3 = 0 then 1 end as pop, kw from mc"))
def m13(spark, d):
    c = merged(spark, d).withColumns({"terms": F.array(F.lit("x"), F.lit("m0")), "txt": F.expr("concat('m', cast(table_id % 3 as string))")})
    return m.population_signal(c, "terms", "txt").select("claim_id", "table_id", F.try_element_at("ranks", F.lit("population")).alias("pop"), F.try_element_at("ranks", F.lit("keyword")).alias("kw"))


@query("m14_institution_signal", over(f"with {_MC} select claim_id, table_id, case when claim_id % 3 = table_id % 3 and claim_id % 3 <> 2 then 1 end as inst from mc"))
def m14(spark, d):
    c = merged(spark, d).withColumns({"org": F.expr("concat('a', cast(claim_id % 3 as string))"), "torg": F.expr("concat('org', cast(table_id % 3 as string))")})
    return m.institution_signal(c, "org", "torg", ["org0", "org1"], {"a0": "org0", "a1": "org1", "a2": "org2"}).select("claim_id", "table_id", F.try_element_at("ranks", F.lit("institution")).alias("inst"))


@query("m15_dimension_signals", over(f"with {_MC} select claim_id, table_id, case when claim_id % 2 = 0 and table_id % 4 = 0 then 1 end as g, case when claim_id % 5 = table_id % 5 then 1 end as r from mc"))
def m15(spark, d):
    c = merged(spark, d).withColumns({"gender": F.expr("if(claim_id % 2 = 0, 'women', null)"), "region": F.expr("concat('R', cast(claim_id % 5 as string), '.')"), "txt": F.expr("concat(if(table_id % 4 = 0, 'women ', ''), 'R', cast(table_id % 5 as string), '.')")})
    x = m.dimension_signals(c, "gender", "region", "txt")
    return x.select("claim_id", "table_id", F.try_element_at("ranks", F.lit("gender")).alias("g"), F.try_element_at("ranks", F.lit("region")).alias("r"))


_RRF = "rf as (select *, round(coalesce(1.0 / (60 + idx), 0)::double + coalesce(1.0 / (60 + kw), 0)::double + coalesce(1.0 / (60 + vec), 0)::double, 12) as rrf from mc), rp as (select *, row_number() over (partition by claim_id order by rrf desc, table_id) as place from rf)"


@query("m16_rrf", over(f"with {_MC}, {_RRF} select claim_id, table_id, round(rrf, 9) as rrf, place from rp"))
def m16(spark, d):
    return m.rrf(merged(spark, d)).select("claim_id", "table_id", F.round("rrf", 9).alias("rrf"), "place")


_RR = """rs as (select *, case when table_id % 4 > 0 then 1 / (1 + exp(-(table_id % 7 - 3)::double)) else 0.0 end as sg from mc), r2 as (select *, row_number() over (partition by claim_id order by sg desc, table_id) as rr from rs),
  r3 as (select *, round(coalesce(1.0 / (60 + idx), 0)::double + coalesce(1.0 / (60 + kw), 0)::double + (1.0 / (60 + rr))::double + coalesce(1.0 / (60 + vec), 0)::double, 12) as rrf from r2), r4 as (select *, row_number() over (partition by claim_id order by rrf desc, table_id) as place from r3)"""


def reranked(spark, d):
    c = merged(spark, d)
    return m.rerank(c, c.filter("table_id % 4 > 0").selectExpr("claim_id", "table_id", "cast(table_id % 7 - 3 as double) as logit"))


@query("m17_rerank", over(f"with {_MC}, {_RR} select claim_id, table_id, round(rrf, 9) as rrf, place from r4 where place <= 5"))
def m17(spark, d):
    return reranked(spark, d).select("claim_id", "table_id", F.round("rrf", 9).alias("rrf"), "place")


_COV = "rg as (select s_suppkey as table_id, 1990 + s_suppkey % 10 as lo, 1996 + s_suppkey % 10 as hi from supplier), cv as (select claim_id, table_id, row_number() over (partition by claim_id order by case when place > 5 then 2 when claim_id % 4 > 0 and rg.lo is not null and not (1993 + claim_id % 10 between lo and hi) then 1 else 0 end, place) as place from rp left join rg using (table_id))"


@query("m18_coverage_filter", over(f"with {_MC}, {_RRF}, {_COV} select claim_id, table_id, place from cv"))
def m18(spark, d):
    r = table(spark, d, "supplier").selectExpr("s_suppkey as table_id", "1990 + s_suppkey % 10 as lo", "1996 + s_suppkey % 10 as hi")
    c = m.rrf(merged(spark, d)).withColumn("year", F.expr("if(claim_id % 4 > 0, 1993 + claim_id % 10, null)"))
    return m.coverage_filter(c, r).select("claim_id", "table_id", "place")


@query("m19_trusted", over(f"with {_MC}, {_RR} select claim_id, table_id, kw is not null or rr = 1 and sg >= 0.5 as trusted from r4 where place <= 5"))
def m19(spark, d):
    return reranked(spark, d).select("claim_id", "table_id", m.trusted().alias("trusted"))


_FULL = f"""{_KS}, kt as (select claim_id, table_id, rank from (select claim_id, table_id, row_number() over (partition by claim_id order by score desc, table_id) as rank from sc) where rank <= 5),
  {_TRI}, lt as (select qid as claim_id, table_id, rank from tr where rank <= 30), fu as (select claim_id, table_id, max(kr) as kr, max(lr) as lr from (select claim_id, table_id, rank as kr, null as lr from kt union all select claim_id, table_id, null, rank from lt) group by 1, 2),
  ff as (select *, round(coalesce(1.0 / (60 + kr), 0)::double + coalesce(1.0 / (60 + lr), 0)::double, 12) as rrf from fu), fp as (select *, row_number() over (partition by claim_id order by rrf desc, table_id) as place from ff)"""


@query("m20_match", over(f"with {_FULL} select claim_id, table_id, place, kr is not null as trusted from fp where place <= 5"))
def m20(spark, d):
    topics, catalog = table(spark, d, "topics"), table(spark, d, "catalog")
    kw = m.keyword_search(*_asked(spark, d)).select("claim_id", "table_id", F.lit("keyword").alias("source"), "rank", "score")
    lex = m.trigram_topk(topics.selectExpr("claim_id as qid", "sentence as t"), catalog.selectExpr("table_id", "title as t")).select(F.col("qid").alias("claim_id"), "table_id", F.lit("lexical").alias("source"), "rank", "score")
    fused = m.rrf(m.merge_candidates(kw.unionByName(lex), _ORDER)).filter("place <= 5")
    return fused.select("claim_id", "table_id", "place", m.trusted().alias("trusted"))


@query("m21_simplicity_tiebreak", over(f"""with {_MC}, {_RRF}, tb as (select claim_id, place, table_id, rrf, rrf as head, 0 as run from rp where place = 1
  union all select rp.claim_id, rp.place, rp.table_id, rp.rrf, case when head - rp.rrf <= 0.0015 then head else rp.rrf end, case when head - rp.rrf <= 0.0015 then run else rp.place - 1 end from tb join rp on rp.claim_id = tb.claim_id and rp.place = tb.place + 1)
  select claim_id, table_id, row_number() over (partition by claim_id order by run, table_id % 4 + case when table_id % 5 = 0 then 1 else 0 end, place) as place from tb""").replace("with ", "with recursive ", 1))
def m21(spark, d):
    c = m.rrf(merged(spark, d)).withColumns({"score": F.col("rrf"), "title": F.expr("concat(repeat('a/', cast(table_id % 4 as int)), case table_id % 10 when 0 then ' 소분류' when 5 then '세분류별' else '' end)")})
    return m.simplicity_tiebreak(c)


_AX = "ax as (select s_suppkey as table_id, 'A' || cast(n_nationkey as varchar) as code, n_name as name from supplier, nation where n_nationkey % 3 = s_suppkey % 3)"
_MS = f"""{_AX}, fl as (select claim_id, supp as table_id, 'region' as field, comparison_target as value from claims union all select claim_id, supp, 'age', case when pos % 3 = 0 then 'NATION_1' when pos % 3 = 1 then 'zzz' end from claims),
  ms as (select claim_id, field, value, min(code) filter (where name = value) as exact, count(distinct code) filter (where contains(name, value)) as n, min(code) filter (where contains(name, value)) as ins from fl left join ax using (table_id) group by 1, 2, 3),
  st as (select claim_id, field, case when value is null then 'not_needed' when exact is not null then 'exact' when n = 1 then 'contained' when n > 1 then 'ambiguous' else 'not_found' end as status, case when value is null then null when exact is not null then exact when n = 1 then ins end as code from ms)"""


@query("m22_map_slots", over(f"with {_MS} select claim_id, field, status, code, bool_and(status not in ('ambiguous', 'not_found')) over (partition by claim_id) as verifiable from st"))
def m22(spark, d):
    c = table(spark, d, "claims").selectExpr("claim_id", "supp as table_id", "comparison_target as region", "case pos % 3 when 0 then 'NATION_1' when 1 then 'zzz' end as age")
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    ax = s.join(F.broadcast(n), n["n_nationkey"] % 3 == s["s_suppkey"] % 3).selectExpr("s_suppkey as table_id", "concat('A', cast(n_nationkey as string)) as code", "n_name as name")
    return m.map_slots(c, ax, ["region", "age"])


@query("k1_topk", "select * from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders) where rank <= 3")
def k1(spark, d):
    return k.topk(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3).select("o_custkey", "o_orderkey", "rank")


@query("k2_source_rank", over("select claim_id, table_id, source, row_number() over (partition by claim_id, source order by score desc, table_id) as rank from candidates"))
def k2(spark, d):
    return m.source_rank(table(spark, d, "candidates")).select("claim_id", "table_id", "source", "rank")


@query("k3_stable_partition", over(f"with {_MC}, {_RRF}, {_COV} select claim_id, max(place) as n, sum(place * table_id) as mix from cv group by claim_id"))
def k3(spark, d):
    return m18(spark, d).groupBy("claim_id").agg(F.max("place").alias("n"), F.sum(F.col("place") * F.col("table_id")).alias("mix"))


@query("k4_sort_articles", over("select article, verdict, row_number() over (order by case verdict when 'mismatch' then 0 when 'undecidable' then 1 else 2 end, article) as at from (select distinct article_title as article, verdict from records)"))
def k4(spark, d):
    from pyspark.sql import Window as W

    r = table(spark, d, "records").select(F.col("article_title").alias("article"), "verdict").distinct()
    s = k.sort_articles(r, "severity").withColumn("part", F.spark_partition_id()).withColumn("id", F.monotonically_increasing_id())
    sizes = s.groupBy("part").count().withColumn("before", F.coalesce(F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return s.join(sizes, "part").select("article", "verdict", (F.col("before") + F.row_number().over(W.partitionBy("part").orderBy("id"))).alias("at"))


@query("k5_page", "select o_orderkey, 3 as page, 10 as n_shown from orders order by o_totalprice desc, o_orderkey limit 20 offset 40")
def k5(spark, d):
    return k.page(table(spark, d, "orders"), [F.desc("o_totalprice"), "o_orderkey"], 3).select("o_orderkey", "page", F.size("shown").alias("n_shown"))


@query("k6_mixed_sample", """with a as (select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 30), b as (select o_orderkey from orders where o_orderkey not in (select o_orderkey from a) order by md5('7|' || cast(o_orderkey as varchar)), o_orderkey limit 20)
  select o_orderkey, 'dense' as part from a union all select o_orderkey, 'random' from b""")
def k6(spark, d):
    return k.mixed_sample(table(spark, d, "orders"), "o_orderkey", "o_totalprice", 30, 20, 7).select("o_orderkey", "part")


@query("k7_stratified", "select o_orderkey, o_orderstatus from (select *, row_number() over (partition by o_orderstatus order by md5('7|' || cast(o_orderkey as varchar)), o_orderkey) as r from orders) where r <= case o_orderstatus when 'F' then 10 when 'O' then 25 else 0 end")
def k7(spark, d):
    return k.stratified(table(spark, d, "orders"), "o_orderkey", "o_orderstatus", {"F": 10, "O": 25}, 7).select("o_orderkey", "o_orderstatus")


def _marked(spark, d):
    """Each document's third and fourth word, the third once more, and words that it hasn't, as claims to place in it."""
    a = table(spark, d, "articles")
    word = lambda i: F.element_at(F.split("text", r"\s+"), i)
    said = [(word(3), F.lit("match")), (word(4), F.lit("match")), (word(3), F.when(F.col("article_id") % 2 == 0, "match").otherwise("mismatch")), (F.lit("no such words"), F.lit("match"))]
    claims = F.array(*[F.struct((F.col("article_id") * 4 + i).alias("claim_id"), x.alias("sentence"), v.alias("verdict")) for i, (x, v) in enumerate(said)])
    return a, a.filter(F.size(F.split("text", r"\s+")) > 4).select("article_id", F.inline(claims))


_QUOTES = "translate({}, '“”‘’', concat(chr(34), chr(34), chr(39), chr(39)))"
_LOCATED = rf"""cl as (select article_id, article_id * 4 + i as claim_id, case i when 1 then w[4] when 3 then 'no such words' else w[3] end as sentence, case when i = 2 and article_id % 2 > 0 then 'mismatch' else 'match' end as v from (select article_id, string_split_regex(text, '[ \t\n\v\f\r]+') as w from articles), range(4) r(i) where len(w) > 4),
  pl as (select cl.article_id, claim_id, v, length(sentence) as n, case when sentence <> '' then nullif(strpos({_QUOTES.format("text")}, {_QUOTES.format("sentence")}), 0) - 1 end as s from cl join articles using (article_id)),
  o as (select *, s + n as e, row_number() over (partition by article_id order by s nulls last, claim_id) as k from pl),
  f as (select article_id, claim_id, s, e, k, case when s is null then 'not found' else 'kept' end as state, case when s is not null then e else 0 end as upto, coalesce(s, -1) as spot, v as seen from o where k = 1
    union all select o.article_id, o.claim_id, o.s, o.e, o.k, case when o.s is null then 'not found' when o.s >= f.upto then 'kept' when o.s = f.spot and o.v is not distinct from f.seen then 'duplicate' else 'overlap' end,
      case when o.s >= f.upto then o.e else f.upto end, case when o.s >= f.upto then o.s else f.spot end, case when o.s >= f.upto then o.v else f.seen end from f join o on o.article_id = f.article_id and o.k = f.k + 1),
  lc as (select article_id, claim_id, s, e, state = 'kept' as kept, state, case when state <> 'duplicate' then row_number() over (partition by article_id order by case state when 'kept' then 0 when 'not found' then 1 when 'overlap' then 2 else 3 end, s, claim_id) end as number from f)"""
_SEGMENTS = r"""kp as (select article_id, s, e, number as claim_no, coalesce(lag(e) over (partition by article_id order by s), 0) as before from lc where kept),
  pt as (select article_id, before as a, s as b, null as claim_no from kp union all select article_id, s, e, claim_no from kp
    union all select x.article_id, coalesce(max(e), 0), length(any_value(x.text)), null from articles x left join kp using (article_id) group by x.article_id),
  pc as (select article_id, a, claim_no, case when claim_no is null then string_split_regex(substr(text, a + 1, b - a), '
{2,}') else [substr(text, a + 1, b - a)] end as x from pt join articles using (article_id) where b > a),
  pe as (select article_id, a, claim_no, unnest(x) as text, generate_subscripts(x, 1) as i from pc),
  pp as (select *, sum(case when i > 1 then 1 else 0 end) over (partition by article_id order by a, i) as p from pe)
  select article_id, row_number() over (partition by article_id order by a, i) as pos, claim_no, dense_rank() over (partition by article_id order by p) - 1 as paragraph, text from pp where text <> ''"""


@query("k8_locate_claims", over(f'with {_LOCATED} select article_id, claim_id, s as start, e as "end", kept, state, number from lc').replace("with ", "with recursive ", 1))
def k8(spark, d):
    return k.locate_claims(*_marked(spark, d))


@query("k9_segments", over(f"with {_LOCATED}, {_SEGMENTS}").replace("with ", "with recursive ", 1))
def k9(spark, d):
    a, c = _marked(spark, d)
    return k.segments(a, k.locate_claims(a, c))


@query("k10_set_operations", "select n_nationkey as key, 'unused' as kind from nation where n_nationkey not in (select s_nationkey from supplier) union all select s_nationkey, 'any' from (select s_nationkey from supplier union select c_nationkey from customer)")
def k10(spark, d):
    n, s, c = table(spark, d, "nation"), table(spark, d, "supplier").select("s_nationkey"), table(spark, d, "customer").select("c_nationkey")
    unused = n.join(s, n["n_nationkey"] == s["s_nationkey"], "left_anti").select(F.col("n_nationkey").alias("key"), F.lit("unused").alias("kind"))
    return unused.unionByName(s.union(c).distinct().select(F.col("s_nationkey").alias("key"), F.lit("any").alias("kind")))
