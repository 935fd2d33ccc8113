"""Matching claims to statistics tables: keyword, trigram and vector retrieval, fusion by reciprocal rank, gates.

Containment joins run over distinct texts against distinct keywords; trigram search is an equi-join on trigrams; vectors are
in `vectors`.
Candidates are rows (claim_id, table_id, …) with ranks in a map from the source's name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.session import written

from .joins import containing
from .ranking import topk
from .text import no_space

SIGNALS = ("population", "institution", "gender", "region")


def expand_terms(texts: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(t, terms): for distinct texts t the targets of the synonyms (term, target) that occur in them."""
    return containing(texts, "t", synonyms.select("term", "target"), "term").groupBy("t").agg(F.array_sort(F.collect_set("target")).alias("terms"))


def stem_match(keyword: Column, text: Column, least: int = 5) -> Column:
    """Whether a keyword of `least` characters or more begins like some part of the text."""
    return (F.length(keyword) >= least) & F.contains(text, F.substring(keyword, 1, least))


def false_friend_only(keyword: Column, text: Column, compounds: dict[str, list[str]]) -> Column:
    """Whether the keyword occurs in the text only inside its listed compounds."""
    out = F.lit(False)
    for word, longer in compounds.items():
        rest = text
        for x in longer:
            rest = F.replace(rest, F.lit(x), F.lit(""))
        out = F.when(keyword == word, F.contains(text, keyword) & ~F.contains(rest, keyword)).otherwise(out)
    return out


def morph_match(text: Column, tokens: Column) -> Column:
    """Whether all core nouns of a keyword (supplied by any tagger) occur in the text."""
    return (F.size(tokens) > 0) & F.forall(tokens, lambda t: F.contains(text, t))


def table_kinds(catalog: DataFrame) -> DataFrame:
    """(table_id, kind, keywords, heads): tables of the same keywords and title beginnings are of one kind, and score alike."""
    head = F.substring("title", 1, 6)
    tables = catalog.groupBy("table_id").agg(F.array_sort(F.flatten(F.collect_list("keywords"))).alias("keywords"), F.array_sort(F.collect_list(F.when(head != "", head))).alias("heads"))
    return tables.withColumn("kind", F.sha2(F.to_json(F.struct("keywords", "heads")), 256))


def kind_scores(texts: DataFrame, kinds: DataFrame, synonyms: DataFrame, compounds: dict[str, list[str]] | None = None, kw_tokens: DataFrame | None = None) -> DataFrame:
    """(t, kind, score) above zero, of distinct texts (t) and kinds of tables (kind, keywords, heads); see keyword_scores()."""
    extra = expand_terms(texts, synonyms)
    texts = texts.join(extra, "t", "left").withColumn("n", no_space(F.col("t")))
    words = kinds.select("kind", F.explode("keywords").alias("kw"))
    norm = no_space(F.col("kw"))
    direct = F.contains("n", norm) & ~false_friend_only(norm, F.col("n"), compounds or {})
    near = stem_match(norm, F.col("n")) & ~false_friend_only(norm, F.col("n"), compounds or {}) if kw_tokens is None else morph_match(F.col("n"), F.col("tokens"))
    weight = F.when(direct, 1.0).when(F.coalesce(F.array_contains("terms", F.col("kw")), F.lit(False)), 0.5).when(near, 1.0)
    terms = words.select("kw").distinct()
    if kw_tokens is None:
        # what a keyword begins with stands wherever the keyword or its stem does; synonyms name keywords that may not stand there
        terms = terms.withColumn("stem", F.left(norm, F.lit(5)))
    else:
        # a keyword stands there itself, or all its nouns do, so the longest of them
        nouns = kw_tokens.groupBy("kw").agg(F.first(F.filter("tokens", lambda x: F.length(x) > 0)).alias("tokens"))
        terms = terms.join(nouns, "kw", "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))
        longest = F.get(F.sort_array(F.transform("tokens", lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))), asc=False), 0)["x"]
        terms = terms.withColumn("stem", F.explode(F.array_distinct(F.filter(F.array(norm, longest), lambda x: x.isNotNull()))))
    spelled = containing(texts, "n", terms, "stem").select("t", "kw", weight.alias("w"))
    meant = texts.withColumn("kw", F.explode("terms")).join(terms.drop("stem").distinct(), "kw").select("t", "kw", weight.alias("w"))
    hits = spelled.unionByName(meant).filter("w is not null").distinct()
    by_word = hits.join(words, "kw").select("t", "kind", "w")
    heads = kinds.select("kind", F.explode("heads").alias("head"))
    by_title = containing(texts.select("t"), "t", heads.select("head").distinct(), "head").join(heads, "head").select("t", "kind", F.lit(1.0).alias("w"))
    return by_word.unionByName(by_title).groupBy("t", "kind").agg(F.least(F.lit(1.0), F.sum("w") / 3).alias("score"))


def _scored_kinds(claims: DataFrame, catalog: DataFrame, *how) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(claim_id, t) of claims, (table_id, kind) of tables, and the scores of distinct texts with distinct kinds."""
    spoken, tables = claims.select("claim_id", F.col("sentence").alias("t")), table_kinds(catalog)
    kinds = written(tables.select("kind", "keywords", "heads").dropDuplicates(["kind"]), "table-kinds")
    return spoken, tables.select("table_id", "kind"), kind_scores(spoken.select("t").distinct(), kinds, *how)


#: Ids that one row of a block holds: of claims of one text, of tables of one kind.
BLOCK = 1000


def _blocks(rows: DataFrame, key: str, item: str) -> tuple[DataFrame, DataFrame]:
    """(key, part, <item>s): the ids of a key in arrays of some BLOCK, by their hash, nulls too; and (key, parts) how many at most."""
    parts = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    nulls = F.array_repeat(F.lit(None).cast(rows.schema[item].dataType), (F.count(F.lit(1)) - F.count(item)).cast("int"))
    dealt = rows.join(parts, key).withColumn("part", F.pmod(F.xxhash64(item), F.col("parts")))
    return dealt.groupBy(key, "part").agg(F.concat(F.array_sort(F.collect_list(item)), nulls).alias(f"{item}s")), parts


def keyword_scores(claims: DataFrame, catalog: DataFrame, synonyms: DataFrame, compounds: dict[str, list[str]] | None = None, kw_tokens: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """(claim_id, table_id, score) above zero: 1 for each keyword in the sentence or its stem, 0.5 for a synonym of one in
    it, 1 for the title's first six characters; a third of the sum, at most 1.

    Where a tagger is at hand, as kw_tokens (kw, tokens: its core nouns), all of a keyword's nouns in the sentence stand in for
    its stem. Sentences and keywords are matched once each, however many claims and tables share them; scores are rounded to
    digits, if any are given, before they are told of all pairs.

    There may be as many rows as claims times tables. So up to the last step the claims of a text and the tables of a kind go in
    blocks, which meet by kind and part of it in tasks of their own; each writes out its pairs as it goes and holds none.
    """
    spoken, tables, scores = _scored_kinds(claims, catalog, synonyms, compounds, kw_tokens)
    if digits is not None:
        scores = scores.withColumn("score", F.round("score", digits))
    said, _ = _blocks(spoken, "t", "claim_id")
    held, parts = _blocks(tables, "kind", "table_id")
    each = scores.join(parts, "kind").select("t", "kind", "score", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    tasks = 4 * int(claims.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # blocks are few bytes and many rows, so bytes must not set the number
    met = each.join(said.drop("part"), "t").select("kind", "part", "score", "claim_ids").repartition(tasks, "kind", "part").join(held, ["kind", "part"])
    return met.select(F.explode("claim_ids").alias("claim_id"), "table_ids", "score").select("claim_id", F.explode("table_ids").alias("table_id"), "score")


def keyword_search(claims: DataFrame, catalog: DataFrame, synonyms: DataFrame, compounds: dict[str, list[str]] | None = None, kw_tokens: DataFrame | None = None, k: int = 5) -> DataFrame:
    """(claim_id, table_id, score, rank): the k first tables of each claim by keyword_scores(), without scoring all pairs.

    Of a kind of tables only its first k can be among a text's first k, and of the kinds only those whose first tables are; so
    a text picks k kinds, then k of their tables, and a claim takes what its text has.
    """
    spoken, tables, scores = _scored_kinds(claims, catalog, synonyms, compounds, kw_tokens)
    order = [F.desc("score"), "table_id"]
    first = topk(tables, ["kind"], ["table_id"], k).withColumnRenamed("rank", "of_kind")
    kinds = topk(scores.join(first.filter("of_kind = 1"), "kind"), ["t"], order, k).select("t", "kind", "score")
    best = topk(kinds.join(first, "kind"), ["t"], order, k).select("t", "table_id", "score")
    return topk(spoken.join(best, "t").select("claim_id", "table_id", "score"), ["claim_id"], order, k)


def keyword_topk(scores: DataFrame, k: int = 5) -> DataFrame:
    return topk(scores.filter("score > 0"), ["claim_id"], [F.desc("score"), "table_id"], k)


def trigrams(c: Column) -> Column:
    """The distinct trigrams of a text's words, each word with two spaces before and one after, as in a trigram index."""
    words = F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))))


#: Index texts that a trigram meets in one part of the join; one that more have is met in several.
HEAVY = 10_000


def trigram_topk(queries: DataFrame, index: DataFrame, k: int = 30, least: float = 0.1) -> DataFrame:
    """(qid, table_id, score, rank): trigram similarity of queries (qid, t) and index rows (table_id, t), least or above.

    Distinct texts meet through the query's rarest trigrams first. A similarity of s takes ceil(s * n) shared trigrams of the
    query's n, so a row that shares none of its rarest P - ceil(s * n) + 1 (of P that the index knows) can't have it. The
    rarer half of a query's trigrams proposes rows; the k that share most of it are scored and give a bound on the k-th score;
    the others are scored only if what they share and what is left of the query could reach it; and of the other half only as
    many trigrams are read as the bound asks for, none as a rule. Frequent trigrams are split by the index's texts.
    """
    q = queries.select("t").distinct().withColumn("g", trigrams(F.col("t"))).select(F.col("t").alias("qt"), F.size("g").alias("nq"), "g")
    x = index.select("t").distinct().withColumn("g", trigrams(F.col("t"))).select(F.col("t").alias("xt"), F.size("g").alias("nx"), "g")
    said = x.select("xt", "nx", F.explode("g").alias("g"))
    frequency = said.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    held = q.select("qt", "nq", F.explode("g").alias("g")).join(frequency, "g").groupBy("qt", "nq").agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("gs"))
    held = held.withColumns({"p": F.size("gs"), "half": F.ceil(F.size("gs") / 2).cast("int")})
    parts = F.ceil(F.col("df") / HEAVY)
    placed = said.join(frequency.filter(F.col("df") > HEAVY), "g", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("xt"), parts), F.lit(0))).select("g", "part", "xt", "nx")

    def meeting(rows: DataFrame, first: Column, many: Column) -> DataFrame:
        """(qt, nq, p, half, xt, nx, c): rows of the index that share c of these of the query's trigrams."""
        some = rows.select(*[c for c in rows.columns if c != "gs"], F.explode(F.slice("gs", first, F.greatest(many, F.lit(0)))).alias("x")).select("*", "x.g", "x.df").drop("x")
        some = some.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("df") / HEAVY), F.lit(1)) - 1))).drop("df")
        return some.join(placed, ["g", "part"]).groupBy(*[c for c in some.columns if c not in ("g", "part")], "xt", "nx").agg(F.count(F.lit(1)).alias("c"))

    def scored(pairs: DataFrame) -> DataFrame:
        """(qt, xt, score) of pairs, from all trigrams of both."""
        both = pairs.select("qt", "xt").join(q.select("qt", F.col("g").alias("qg")), "qt").join(x.select("xt", F.col("g").alias("xg")), "xt")
        n = F.size(F.array_intersect("qg", "xg"))
        return both.select("qt", "xt", (n / (F.size("qg") + F.size("xg") - n)).alias("score"))

    most = lambda n: n / (F.col("nq") + F.col("nx") - n)  # noqa: E731  the similarity if n are shared
    near = meeting(held.filter("p > 0"), F.lit(1), F.col("half"))
    near = written(near.withColumn("place", F.row_number().over(W.partitionBy("qt").orderBy(F.desc(most(F.col("c"))), "xt"))), "trigram-pairs")
    first = scored(near.filter(F.col("place") <= k))
    bound = first.groupBy("qt").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
    bound = written(bound, "trigram-bounds")
    bound = held.join(bound, "qt", "left").withColumn("kth", F.greatest(F.coalesce("kth", F.lit(least)), F.lit(least)))
    reach = F.least(F.col("c") + F.col("p") - F.col("half"), F.col("nx"))
    others = near.filter(F.col("place") > k).join(bound.select("qt", "kth"), "qt").filter(most(reach) >= F.col("kth") - 1e-9)
    needed = F.col("p") - F.ceil(F.col("kth") * F.col("nq") - 1e-9).cast("int") + 1
    late = meeting(bound.withColumn("more", needed - F.col("half")).filter("more > 0"), F.col("half") + 1, F.col("more"))
    late = late.filter((most(F.least(F.col("p") - F.col("half"), F.col("nx"))) >= F.col("kth") - 1e-9)).join(near.select("qt", "xt"), ["qt", "xt"], "left_anti")
    score = first.unionByName(scored(others.select("qt", "xt").unionByName(late.select("qt", "xt")))).filter(F.col("score") >= least)
    # of the rows that share a text only the first k can be among a query's first k, and queries of one text have the same
    order = [F.desc("score"), "table_id"]
    first = topk(index.select("table_id", F.col("t").alias("xt")), ["xt"], ["table_id"], k).drop("rank")
    best = topk(score.join(first, "xt"), ["qt"], order, k).select("qt", "table_id", "score")
    return topk(queries.withColumnRenamed("t", "qt").join(best, "qt").select("qid", "table_id", "score"), ["qid"], order, k)


def hash_embed(texts: DataFrame, dims: int = 64) -> DataFrame:
    """(id, v array<double>): counts of characters by md5 mod `dims` (a power of two up to 256), scaled to length 1."""
    chars = texts.select("id", F.explode(F.split(F.coalesce("t", F.lit("")), "")).alias("c")).filter("c != ''")
    cell = (F.conv(F.right(F.md5("c"), F.lit(2)), 16, 10).cast("int") % dims).alias("d")
    counts = chars.groupBy("id", cell).agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("d", "n"))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    full = texts.select("id").join(maps, "id", "left")
    return full.select("id", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.coalesce(F.try_element_at("m", d), F.lit(0)) / F.coalesce("norm", F.lit(1.0))).alias("v"))


def expand_query(query: Column, org: Column, aliases: dict[str, list[str]]) -> Column:
    """The query with its institution's aliases put after it, those that it doesn't have yet."""
    more = F.lit(None).cast("array<string>")
    for name, words in aliases.items():
        more = F.when(org == name, F.array(*map(F.lit, words))).otherwise(more)
    fresh = F.filter(F.coalesce(more, F.array().cast("array<string>")), lambda w: ~F.contains(query, w))
    return F.concat_ws(" ", query, fresh)


def source_rank(scored: DataFrame) -> DataFrame:
    """scored (claim_id, table_id, source, score) plus rank within claim and source."""
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("claim_id", "source").orderBy(F.desc("score"), "table_id")))


def merge_candidates(ranked: DataFrame, order: list[str]) -> DataFrame:
    """(claim_id, table_id, score, ranks map<source, rank>): one row a table; the score of the first source that has it."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("source"))
    g = ranked.groupBy("claim_id", "table_id").agg(F.min(F.struct(place.alias("p"), "rank", "score")).alias("f"), F.map_from_entries(F.array_sort(F.collect_set(F.struct("source", "rank")))).alias("ranks"))
    return g.select("claim_id", "table_id", "f.score", "ranks")


def add_signal(cands: DataFrame, name: str, when: Column) -> DataFrame:
    """Candidates for which `when` holds get rank 1 from a signal of that name."""
    return cands.withColumn("ranks", F.when(F.coalesce(when, F.lit(False)), F.map_concat(F.map_filter("ranks", lambda k, _: k != name), F.create_map(F.lit(name), F.lit(1)))).otherwise(F.col("ranks")))


def population_signal(cands: DataFrame, terms: str, table_text: str) -> DataFrame:
    return add_signal(cands, "population", F.exists(terms, lambda t: F.contains(F.col(table_text), t)))


def institution_signal(cands: DataFrame, org: str, table_org: str, allowed: list[str], aliases: dict[str, str]) -> DataFrame:
    """The claim's institution, by its alias and if allowed, is the table's."""
    name = F.col(org)
    for a, b in aliases.items():
        name = F.when(F.col(org) == a, F.lit(b)).otherwise(name)
    return add_signal(cands, "institution", name.isin(*allowed) & F.contains(F.col(table_org), name))


def dimension_signals(cands: DataFrame, gender: str, region: str, table_text: str) -> DataFrame:
    return add_signal(add_signal(cands, "gender", F.contains(F.col(table_text), F.col(gender))), "region", F.contains(F.col(table_text), F.col(region)))


def rrf(cands: DataFrame, k: int = 60) -> DataFrame:
    """cands plus rrf, the sum of 1 / (k + rank) over all ranks, and place by it."""
    score = F.aggregate(F.map_values("ranks"), F.lit(0.0), lambda acc, r: acc + F.lit(1.0) / (r + k))
    return cands.withColumn("rrf", F.round(score, 12)).withColumn("place", F.row_number().over(W.partitionBy("claim_id").orderBy(F.desc("rrf"), "table_id")))


def rerank(cands: DataFrame, pair_scores: DataFrame | None, k: int = 5) -> DataFrame:
    """With pair scores (claim_id, table_id, logit): sigmoid, its rank as one more source, then rrf. Without: trusted, then score."""
    if pair_scores is None:
        place = F.row_number().over(W.partitionBy("claim_id").orderBy(F.desc(trusted()), F.desc("score"), "table_id"))
        return cands.withColumns({"rrf": F.lit(None).cast("double"), "place": place}).filter(F.col("place") <= k)
    s = cands.join(pair_scores, ["claim_id", "table_id"], "left").withColumn("score", F.coalesce(F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("logit"))), F.lit(0.0)))
    r = F.row_number().over(W.partitionBy("claim_id").orderBy(F.desc("score"), "table_id"))
    s = s.withColumn("_r", r).withColumn("ranks", F.map_concat("ranks", F.create_map(F.lit("reranker"), F.col("_r")))).drop("_r", "logit")
    return rrf(s).filter(F.col("place") <= k)


def coverage_filter(cands: DataFrame, ranges: DataFrame, top: int = 5) -> DataFrame:
    """Within the first `top` places, tables whose known ranges (table_id, lo, hi) leave out the claim's year go last."""
    by_table = ranges.filter("lo is not null and hi is not null").groupBy("table_id").agg(F.collect_list(F.struct("lo", "hi")).alias("r"))
    rows = cands.join(by_table, "table_id", "left")
    out = F.col("year").isNotNull() & F.col("r").isNotNull() & ~F.exists("r", lambda x: F.col("year").between(x.lo, x.hi))
    zone = F.when(F.col("place") > top, 2).when(F.coalesce(out, F.lit(False)), 1).otherwise(0)
    return rows.withColumn("place", F.row_number().over(W.partitionBy("claim_id").orderBy(zone, "place"))).drop("r")


def trusted(least: float = 0.5) -> Column:
    """A keyword rank or a signal's; else first place at the reranker with a score of `least` or more."""
    has = lambda n: F.map_contains_key("ranks", n)
    first = (F.try_element_at("ranks", F.lit("reranker")) == 1) & (F.col("score") >= least)
    return has("keyword") | F.greatest(*[has(s) for s in SIGNALS]) | F.coalesce(first, F.lit(False))


def simplicity_tiebreak(ranked: DataFrame, epsilon: float = 0.0015, fine: tuple[str, ...] = ("소분류", "세분류")) -> DataFrame:
    """ranked (claim_id, place, table_id, score, title) with runs within epsilon of the run's head reordered by axes.

    A title has an axis more than slashes, and one more if it speaks of a fine classification. Where a run starts depends on
    the run before, so each claim's short list is folded.
    """
    axes = F.size(F.split("title", "/")) + F.greatest(*[F.contains("title", F.lit(w)) for w in (*fine, *fine[:1])]).cast("int")
    one = ranked.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("place", "table_id", "score", axes.alias("axes")))).alias("c"))
    step = f"""aggregate(c, cast(array() as array<struct<head:double,run:int,axes:int,place:int,table_id:bigint>>), (acc, x) -> concat(acc, array(case
        when size(acc) > 0 and try_element_at(acc, -1).head - x.score <= {epsilon} then named_struct('head', try_element_at(acc, -1).head, 'run', try_element_at(acc, -1).run, 'axes', x.axes, 'place', x.place, 'table_id', cast(x.table_id as bigint))
        else named_struct('head', cast(x.score as double), 'run', size(acc), 'axes', x.axes, 'place', x.place, 'table_id', cast(x.table_id as bigint)) end)))"""
    rows = one.select("claim_id", F.inline(F.expr(step)))
    return rows.select("claim_id", "table_id", F.row_number().over(W.partitionBy("claim_id").orderBy("run", "axes", "place")).alias("place"))


def map_slots(claims: DataFrame, axes: DataFrame, fields: list[str]) -> DataFrame:
    """(claim_id, field, status, code) and through it whether the whole claim can be checked.

    Each of the claim's fields must be one code's name of its table, or lie inside exactly one; null is not needed.
    axes: table_id, code, name.
    """
    long = claims.select("claim_id", "table_id", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])))
    met = long.join(axes, "table_id", "left").groupBy("claim_id", "field", "value").agg(F.min(F.when(F.col("name") == F.col("value"), F.col("code"))).alias("exact"), F.count_distinct(F.when(F.contains("name", "value"), F.col("code"))).alias("n"), F.min(F.when(F.contains("name", "value"), F.col("code"))).alias("inside"))
    status = F.when(F.col("value").isNull(), "not_needed").when(F.col("exact").isNotNull(), "exact").when(F.col("n") == 1, "contained").when(F.col("n") > 1, "ambiguous").otherwise("not_found")
    rows = met.select("claim_id", "field", status.alias("status"), F.when(status == "exact", F.col("exact")).when(status == "contained", F.col("inside")).alias("code"))
    ok = rows.groupBy("claim_id").agg(F.bool_and(~F.col("status").isin("ambiguous", "not_found")).alias("verifiable"))
    return rows.join(ok, "claim_id")
