"""Filtering claims, finding their sources, and choosing the calculation that checks them.

Where organisations, synonyms or words join by containment, the texts to match are made distinct first, so the pairs grow
with distinct names and not with rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.locale import Pack

from .joins import containing
from .text import no_space, number_variants, straight_quotes


def classify_source(df: DataFrame, orgs: DataFrame, drop: str = r"\(추정\)") -> DataFrame:
    """df plus source_class from orgs(org, verified): the exact name, else a verified name inside, else a known other."""
    name = F.trim(F.regexp_replace("source_org", drop, ""))
    names = df.select(name.alias("_n")).filter("_n is not null and _n != ''").distinct()
    hit = containing(names, "_n", orgs.select("org", "verified"), "org").groupBy("_n").agg(F.min(F.when(F.col("_n") == F.col("org"), F.when(F.col("verified"), 1).otherwise(2)).otherwise(F.when(F.col("verified"), 3).otherwise(4))).alias("_k"))
    kind = F.when(F.col("_k").isin(1, 3), "verified").when(F.col("_k").isin(2, 4), "known_not").otherwise("uncertain")
    return df.withColumn("_n0", name).join(hit, F.col("_n0") == F.col("_n"), "left").withColumn("source_class", kind).drop("_n0", "_n", "_k")


def standalone(org: Column, text: Column, ending: str = "부", more: str = "문") -> Column:
    """Whether org occurs; for names with that ending, elsewhere than in the longer word."""
    return F.when(F.endswith(org, F.lit(ending)), F.contains(F.replace(text, F.concat(org, F.lit(more)), F.lit("")), org)).otherwise(F.contains(text, org))


def infer_org(labels: DataFrame, orgs: DataFrame, publication: str) -> DataFrame:
    """(article_id, org): the longest org name in a reason that speaks of a publication; ties go to the smaller name."""
    reasons = labels.filter(F.col("reason").rlike(publication)).select("article_id", no_space(F.col("reason")).alias("_r"))
    texts = reasons.select("_r").distinct()
    best = containing(texts, "_r", orgs.select("org").distinct(), "org").filter(standalone(F.col("org"), F.col("_r"))).groupBy("_r").agg(F.min(F.struct((-F.length("org")).alias("n"), "org")).alias("b"))
    return reasons.join(best, "_r").select("article_id", "b.org")


def backfill(claims: DataFrame) -> DataFrame:
    """Blank source_org gets its article's most frequent verified org, else its most frequent org; the first on ties.

    claims: article_id, pos, source_org, source_class.
    """
    named = claims.filter("source_org is not null and source_org != ''").groupBy("article_id", "source_org").agg(F.max((F.col("source_class") == "verified").cast("int")).alias("v"), F.count(F.lit(1)).alias("n"), F.min("pos").alias("p"))
    best = named.groupBy("article_id").agg(F.min(F.struct((-F.col("v")).alias("v"), (-F.col("n")).alias("n"), "p", "source_org")).alias("b")).select(F.col("article_id").alias("_a"), F.col("b.source_org").alias("_o"))
    return claims.join(best, F.col("article_id") == F.col("_a"), "left").withColumn("source_org", F.coalesce(F.when(F.col("source_org") != "", F.col("source_org")), "_o")).drop("_a", "_o")


def resolve_sources(claims: DataFrame, labels: DataFrame, orgs: DataFrame, publication: str) -> DataFrame:
    """backfill, then the org inferred from the article's reason."""
    got = infer_org(labels, orgs, publication).select(F.col("article_id").alias("_a"), F.col("org").alias("_i"))
    return backfill(claims).join(got, F.col("article_id") == F.col("_a"), "left").withColumn("source_org", F.coalesce("source_org", "_i")).drop("_a", "_i")


def no_digit() -> Column:
    """A value is given but the sentence has no digit."""
    return F.col("value").isNotNull() & ~F.col("sentence").rlike("[0-9]")


def not_printed(value: Column) -> Column:
    """No printed form of the value occurs in the sentence."""
    return value.isNotNull() & ~F.exists(number_variants(value), lambda v: F.contains(F.col("sentence"), v))


def no_value() -> Column:
    """A claim of a level or a rate without a value."""
    return F.col("claim_type").isin("level", "rate") & F.col("value").isNull()


def verifiable(claims: DataFrame, pack: Pack) -> DataFrame:
    """claims plus drop_reason; null where the claim can be checked."""
    why = F.when(F.coalesce(F.col("source_class"), F.lit("uncertain")) != "verified", "source").when(no_digit(), "no digit").when(not_printed(F.col("value")), "not printed").when(no_value(), "no value").when(F.col("sentence").rlike(pack.opinion), "opinion")
    return claims.withColumn("drop_reason", why)


def dedup_claims(claims: DataFrame) -> DataFrame:
    """The first claim of each article with a sentence, quotes and outer space aside."""
    first = F.row_number().over(W.partitionBy("article_id", F.trim(straight_quotes(F.col("sentence")))).orderBy("pos", "claim_id"))
    return claims.withColumn("_k", first).filter("_k = 1").drop("_k")


def foreign(pack: Pack, *columns: str, nouns: dict[str, str] | None = None) -> Column:
    """Whether any column names a foreign country.

    nouns: for some columns, the column with the array of their proper nouns as a tagger gives them; then only these count,
    so that common nouns of the same letters don't. Where that array is null, and for other columns, any part counts.
    """
    words = "|".join(pack.foreign)

    def names(c: str) -> Column:
        part = F.col(c).rlike(words)
        if c in (nouns or {}):
            tagged = F.col(nouns[c])
            part = F.when(F.col(c).isNull(), False).when(tagged.isNotNull(), F.arrays_overlap(F.filter(tagged, lambda x: x.isNotNull()), F.array(*map(F.lit, pack.foreign)))).otherwise(part)
        return F.coalesce(part, F.lit(False))

    return F.greatest(*map(names, columns), F.lit(False), F.lit(False))


def extreme(pack: Pack) -> Column:
    """'max' or 'min' for a claim of a historical extreme; min only where no word for a maximum stands."""
    is_extreme = F.col("sentence").rlike(f"{pack.all_time}|{pack.n_years}|{pack.event_since}")
    return F.when(is_extreme, F.when(F.col("sentence").rlike(pack.min_words) & ~F.col("sentence").rlike(pack.max_words), "min").otherwise("max"))


def route(pack: Pack, *foreign_columns: str, nouns: dict[str, str] | None = None) -> Column:
    """The calculation that checks a claim; null where none can. nouns: the columns' proper nouns, as in foreign()."""
    e = extreme(pack)
    level = F.when(e == "max", "max_check").when(e == "min", "min_check").when(F.col("value_type") == "delta", "change").otherwise("lookup")
    return F.when(foreign(pack, *foreign_columns, nouns=nouns), F.lit(None)).when(F.col("claim_type") == "rate", "rate").when(F.col("claim_type") == "compare", "change").when(F.col("claim_type") == "level", level)


def wants_comparison(pack: Pack, text: str = "sentence") -> Column:
    return F.col(text).rlike(pack.comparison)


def normalize_stat(df: DataFrame, synonyms: DataFrame, col: str) -> DataFrame:
    """df plus normalized: the target of the first synonym(ord, term, target) inside col, else col."""
    texts = df.select(F.col(col).alias("_t")).distinct()
    hit = containing(texts, "_t", synonyms.select("ord", "term", "target"), "term").groupBy("_t").agg(F.min(F.struct("ord", "target")).alias("_b"))
    return df.join(hit, F.col(col) == F.col("_t"), "left").withColumn("normalized", F.coalesce("_b.target", col)).drop("_t", "_b")
