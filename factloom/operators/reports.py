"""Aggregations and reports over verification records.

Records: result_id, article, verdict (match, mismatch, undecidable), score, created_at, published, table_id, table_name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEVERITY = ["mismatch", "undecidable", "match"]


def severity(verdict: Column) -> Column:
    return F.when(verdict == "mismatch", 0).when(verdict == "undecidable", 1).when(verdict == "match", 2)


def by_article(df: DataFrame) -> DataFrame:
    """(article, claims array<struct>): an article's records in the order of their ids."""
    return df.groupBy("article").agg(F.array_sort(F.collect_list(F.struct("result_id", "verdict", "score"))).alias("claims"))


def dominant(df: DataFrame) -> DataFrame:
    """(article, verdict, n): the most severe verdict and how many records have it."""
    counts = df.groupBy("article").agg(*[F.sum((F.col("verdict") == v).cast("long")).alias(v) for v in SEVERITY])
    pick = F.when(F.col("mismatch") > 0, "mismatch").when(F.col("undecidable") > 0, "undecidable").when(F.col("match") > 0, "match")
    return counts.select("article", pick.alias("verdict"), F.when(pick == "mismatch", F.col("mismatch")).when(pick == "undecidable", F.col("undecidable")).otherwise(F.col("match")).alias("n"))


def display_date(df: DataFrame) -> DataFrame:
    """(article, latest, shown): the latest record, and the publishing date or else that."""
    return df.groupBy("article").agg(F.max("created_at").alias("latest"), F.max("published").alias("p")).select("article", "latest", F.coalesce("p", F.to_date("latest")).alias("shown"))


def kpis(df: DataFrame) -> DataFrame:
    """One row: counts by verdict, share that could be judged, mean score, its dots (0..4) and band, articles."""
    g = df.agg(F.count(F.lit(1)).alias("total"), *[F.sum((F.col("verdict") == v).cast("long")).alias(v) for v in SEVERITY], F.avg("score").alias("mean"), F.count_distinct("article").alias("articles"))
    dots = F.round(F.col("mean") * 4).cast("int")
    return g.withColumns({"rate": F.round((F.col("match") + F.col("mismatch")) / F.col("total"), 4), "mean": F.round("mean", 4), "dots": dots, "band": F.when(dots >= 3, "high").when(dots == 2, "medium").otherwise("low")})


def distribution(df: DataFrame, low: float = 0.5) -> DataFrame:
    """(verdict, n, percent, low): percentages over all judged rows, and how many score below `low`."""
    g = df.filter("verdict is not null").groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("score") < low).cast("long")).alias("low"))
    return g.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(W.partitionBy()), 1))


def needs_review() -> Column:
    """Undecidable, a weak match, or a score from 0.4 to 0.6."""
    return (F.col("verdict") == "undecidable") | ((F.col("verdict") == "match") & (F.col("score") < 0.5)) | F.col("score").between(0.4, 0.6)


def funnel(df: DataFrame) -> DataFrame:
    """(kind, value, n): rows by status, by missing slot and by special tag."""
    status = df.select(F.lit("status").alias("kind"), F.col("status").alias("value"))
    slots = df.select(F.lit("missing").alias("kind"), F.explode("missing").alias("value"))
    tags = df.filter("tag is not null").select(F.lit("tag").alias("kind"), F.col("tag").alias("value"))
    return status.unionByName(slots).unionByName(tags).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))


def outcome(claims: DataFrame) -> DataFrame:
    """(article, outcome): the first that holds of no_claims, all_filtered, all_untrusted, error, complete, partial, none."""
    g = claims.groupBy("article").agg(F.count("claim_id").alias("n"), F.sum(F.col("kept").cast("long")).alias("kept"), F.sum((F.col("kept") & F.col("trusted")).cast("long")).alias("trusted"), F.coalesce(F.bool_or("failed"), F.lit(False)).alias("failed"), F.sum((F.col("kept") & F.col("trusted") & F.col("done")).cast("long")).alias("done"))
    ladder = F.when(F.col("n") == 0, "no_claims").when(F.col("kept") == 0, "all_filtered").when(F.col("trusted") == 0, "all_untrusted").when(F.col("failed"), "error").when(F.col("done") == F.col("kept"), "complete").when(F.col("done") > 0, "partial").otherwise("none")
    return g.select("article", ladder.alias("outcome"))


def cited_tables(df: DataFrame) -> DataFrame:
    """(article, table_id, table_name): each table once, by the name it was first cited with."""
    return df.filter("table_id is not null").groupBy("article", "table_id").agg(F.min(F.struct("result_id", "table_name")).alias("f")).select("article", "table_id", "f.table_name")


def visible(df: DataFrame, today: Column, days: int) -> DataFrame:
    """Records of articles with any claim to review, in the last `days` days; dates that can't be read stay."""
    flagged = df.filter(needs_review()).select("article").distinct()
    return df.filter(F.col("published").isNull() | (F.datediff(today, "published") <= days)).join(flagged, "article", "left_semi")


def coverage(claims: DataFrame, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((share, gov_share) over claims and articles; (org, n) of claims without a table, most first)."""
    rows = claims.join(hits.select("claim_id").distinct().withColumn("hit", F.lit(True)), "claim_id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    by_article = rows.filter("gov").groupBy("article").agg(F.bool_or("hit").alias("h")).agg(F.round(F.avg(F.col("h").cast("int")), 6).alias("gov_share"))
    share = rows.agg(F.round(F.avg(F.col("hit").cast("int")), 6).alias("share"))
    return share.crossJoin(by_article), rows.filter(~F.col("hit")).groupBy("org").agg(F.count(F.lit(1)).alias("n"))


def freq_support(probes: DataFrame) -> DataFrame:
    """(table_id, supported, new): frequencies that answered, and those among them that weren't registered."""
    g = probes.groupBy("table_id").agg(F.array_sort(F.collect_set(F.when(F.col("ok"), F.col("freq")))).alias("supported"), F.array_sort(F.collect_set(F.when(F.col("registered"), F.col("freq")))).alias("known"))
    return g.select("table_id", "supported", F.array_except("supported", "known").alias("new"))


def merge_freqs(observed: Column, registered: Column, canonical: tuple[str, ...] = ("Y", "Q", "M")) -> Column:
    """Their union: canonical ones in that order, then others sorted."""
    both = F.array_union(F.coalesce(observed, F.array().cast("array<string>")), F.coalesce(registered, F.array().cast("array<string>")))
    order = F.array(*map(F.lit, canonical))
    return F.concat(F.filter(order, lambda f: F.array_contains(both, f)), F.array_sort(F.array_except(both, order)))


def code_maps(obs: DataFrame, axes: int) -> DataFrame:
    """(table_id, axis, codes map<label, code>) from wide rows C1.., C1_NM..; the last row wins. Axes without labels stay out."""
    long = obs.select("table_id", "ord", F.inline(F.array(*[F.struct(F.lit(f"C{i}").alias("axis"), F.col(f"C{i}").alias("code"), F.col(f"C{i}_NM").alias("label")) for i in range(1, axes + 1)]))).filter("label is not null and code is not null")
    last = long.groupBy("table_id", "axis", "label").agg(F.max(F.struct("ord", "code")).alias("m"))
    return last.groupBy("table_id", "axis").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "m.code")))).alias("codes"))


def axis_values(obs: DataFrame, columns: list[str]) -> DataFrame:
    """(table_id, <column>_values…): the distinct values of each column, sorted."""
    return obs.groupBy("table_id").agg(*[F.array_sort(F.collect_set(c)).alias(f"{c}_values") for c in columns])


def refresh_set(cache: DataFrame, needed: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """(table_id, why, retry_count): needed tables missing from the cache or older than `days`; a failed one counts one more try."""
    rows = needed.select("table_id").distinct().join(cache, "table_id", "left")
    why = F.when(F.col("fetched_at").isNull(), "missing").when(F.datediff(now, "fetched_at") > days, "stale")
    return rows.withColumn("why", why).filter("why is not null").select("table_id", "why", (F.coalesce("retry_count", F.lit(0)) + F.coalesce(F.col("failed").cast("int"), F.lit(0))).alias("retry_count"))


def run_summary(articles: DataFrame, replies: DataFrame, expected: int, most_chars: int = 4000) -> DataFrame:
    """One row: articles, model calls, articles off the expected number of calls, inputs that were cut, seconds from first to last call."""
    calls = replies.groupBy("article_id").agg(F.count(F.lit(1)).alias("calls"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    rows = articles.select("article_id", F.length("text").alias("n")).join(calls, "article_id", "left")
    return rows.agg(F.count(F.lit(1)).alias("articles"), F.sum(F.coalesce("calls", F.lit(0))).alias("calls"), F.sum((F.coalesce("calls", F.lit(0)) != expected).cast("long")).alias("off"), F.sum((F.col("n") > most_chars).cast("long")).alias("cut"), (F.unix_timestamp(F.max("b")) - F.unix_timestamp(F.min("a"))).alias("seconds"))
