"""Top k, pages, samples and the placing of claims in a text. Every order is total, so results don't vary by run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def topk(df: DataFrame, key: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each key plus rank; Spark limits rows before the shuffle."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter(F.col("rank") <= k)


def sort_articles(df: DataFrame, mode: str) -> DataFrame:
    """By severity (mismatch, undecidable, match) or by date, newest first; then by article."""
    severity = F.when(F.col("verdict") == "mismatch", 0).when(F.col("verdict") == "undecidable", 1).otherwise(2)
    return df.orderBy(severity, "article") if mode == "severity" else df.orderBy(F.desc("date"), "article")


def page(df: DataFrame, order: list, number: int, size: int = 20, window: int = 10) -> DataFrame:
    """The rows of one page, its number held to what there is, with pages shown: at most `window` around it.

    Only the rows up to the page's end are sorted out, by a limit and not by numbering all rows.
    """
    total = df.count()
    pages = max(1, -(-total // size))
    number = min(max(1, number), pages)
    start = max(1, min(number - window // 2, pages - window + 1))
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size)
    return rows.withColumns({"page": F.lit(number), "shown": F.sequence(F.lit(start), F.lit(min(pages, start + window - 1)))})


def hashed(seed: int, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def mixed_sample(df: DataFrame, key: str, density: str, n_dense: int, n_rand: int, seed: int) -> DataFrame:
    """The n_dense rows of highest density, then n_rand of the others in the order of a seeded hash."""
    dense = df.orderBy(F.desc(density), key).limit(n_dense).withColumn("part", F.lit("dense"))
    rest = df.join(dense.select(key), key, "left_anti").orderBy(hashed(seed, key), key).limit(n_rand).withColumn("part", F.lit("random"))
    return dense.unionByName(rest)


def stratified(df: DataFrame, key: str, label: str, n_by_label: dict, seed: int) -> DataFrame:
    """For each label the first n rows in the order of a seeded hash."""
    n = F.lit(0)
    for value, k in n_by_label.items():
        n = F.when(F.col(label) == value, F.lit(k)).otherwise(n)
    r = F.row_number().over(W.partitionBy(label).orderBy(hashed(seed, key), key))
    return df.withColumn("_r", r).filter((F.col("_r") <= n) & (F.col("_r") <= max(n_by_label.values(), default=0))).drop("_r")


def locate_claims(articles: DataFrame, claims: DataFrame) -> DataFrame:
    """(article_id, claim_id, start, end, kept, state, number): where each claim's sentence first stands, quotes aside.

    Claims are taken by start, then id. One that begins before the end of the last kept claim isn't kept: it is a `duplicate`
    if it begins where that one does and has the same verdict (a column of claims, if there is one), else an `overlap`; one
    that doesn't occur is `not found`. Kept claims are numbered by place, after them those not found by id, then the overlaps;
    duplicates have no number. An article's claims are selected in one fold over their sorted array.
    """
    from .text import straight_quotes

    at = F.position(straight_quotes(F.col("sentence")), straight_quotes(F.col("text")))
    verdict = F.col("verdict").cast("string") if "verdict" in claims.columns else F.lit(None).cast("string")
    rows = claims.withColumn("_v", verdict).join(articles.select("article_id", "text"), "article_id").select("article_id", "claim_id", F.when((at > 0) & (F.col("sentence") != ""), at - 1).alias("start"), F.length("sentence").alias("n"), "_v")
    one = F.struct(F.col("start").isNull().alias("lost"), "start", "claim_id", (F.col("start") + F.col("n")).alias("end"), F.col("_v").alias("v"))
    held = rows.groupBy("article_id").agg(F.array_sort(F.collect_list(one)).alias("c"))

    def said(x: Column, state: Column) -> Column:
        return F.struct(x["claim_id"].alias("claim_id"), x["start"].alias("start"), x["end"].alias("end"), state.alias("state"))

    def step(acc: Column, x: Column) -> Column:
        keep = x["start"] >= acc["upto"]
        state = F.when(keep, "kept").when((x["start"] == acc["at"]) & x["v"].eqNullSafe(acc["v"]), "duplicate").otherwise("overlap")
        own = lambda new, old: F.when(keep, x[new]).otherwise(acc[old])
        return F.struct(own("end", "upto").alias("upto"), own("start", "at").alias("at"), own("v", "v").alias("v"), F.concat(acc["out"], F.array(said(x, state))).alias("out"))

    none = F.filter(F.transform("c", lambda x: said(x, F.lit(""))), lambda x: F.lit(False))
    first = F.struct(F.lit(0).alias("upto"), F.lit(-1).alias("at"), F.lit(None).cast("string").alias("v"), none.alias("out"))
    found = F.aggregate(F.filter("c", lambda x: ~x["lost"]), first, step, lambda acc: acc["out"])
    lost = F.transform(F.filter("c", lambda x: x["lost"]), lambda x: said(x, F.lit("not found")))
    held = held.select("article_id", found.alias("f"), lost.alias("lost"))
    of = lambda state: F.filter("f", lambda x: x["state"] == state)

    def numbered(rows: Column, after: Column | None) -> Column:
        number = lambda i: (after + i + 1).cast("int") if after is not None else F.lit(None).cast("int")
        return F.transform(rows, lambda x, i: F.struct(x["claim_id"].alias("claim_id"), x["start"].alias("start"), x["end"].alias("end"), (x["state"] == "kept").alias("kept"), x["state"].alias("state"), number(i).alias("number")))

    kept, n_lost = F.size(of("kept")), F.size("lost")
    return held.select("article_id", F.inline(F.concat(numbered(of("kept"), F.lit(0)), numbered(F.col("lost"), kept), numbered(of("overlap"), kept + n_lost), numbered(of("duplicate"), None))))


def segments(articles: DataFrame, located: DataFrame) -> DataFrame:
    """(article_id, pos, claim_no, paragraph, text): the text cut at kept claims, what is between them also at blank lines.

    Claims have their number, other stretches none. A claim lies in one paragraph, whatever lines it has; paragraphs count
    from 0, and those that nothing is left of don't count.
    """
    w = W.partitionBy("article_id").orderBy("start")
    kept = located.filter("kept").select("article_id", "start", "end", F.col("number").alias("claim_no"), F.coalesce(F.lag("end").over(w), F.lit(0)).alias("before"))
    text = articles.select("article_id", "text", F.length("text").alias("n"))
    last = kept.groupBy("article_id").agg(F.max("end").alias("before"))
    none = F.lit(None).cast("int").alias("claim_no")
    rest = text.join(last, "article_id", "left").select("article_id", F.coalesce("before", F.lit(0)).alias("a"), F.col("n").alias("b"), none)
    parts = kept.select("article_id", F.col("before").alias("a"), F.col("start").alias("b"), none).unionByName(kept.select("article_id", F.col("start").alias("a"), F.col("end").alias("b"), "claim_no")).unionByName(rest).filter("b > a")
    piece = F.substring(F.col("text"), F.col("a") + 1, F.col("b") - F.col("a"))
    cut = parts.join(text, "article_id").select("article_id", "a", "claim_no", F.posexplode(F.when(F.col("claim_no").isNull(), F.split(piece, r"\n{2,}")).otherwise(F.array(piece))).alias("i", "text"))
    order = W.partitionBy("article_id").orderBy("a", "i")
    cut = cut.withColumn("p", F.sum((F.col("i") > 0).cast("int")).over(order)).filter("text != ''")
    return cut.select("article_id", F.row_number().over(order).alias("pos"), "claim_no", (F.dense_rank().over(W.partitionBy("article_id").orderBy("p")) - 1).alias("paragraph"), "text")
