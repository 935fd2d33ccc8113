"""The rule side of a verdict: gap, tolerance, mismatches of kind, granularity and year; and the record that is kept.

Column expressions read: claim_value, claim_unit, claim_type, value_type, claim_period, calc_type, computed_value,
computed_unit, computed_period. Nulls never match: what can't be decided is deferred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHANGES, LEVELS = ("change", "rate"), ("lookup", "sum", "level")


def is_percent() -> Column:
    return F.when(F.coalesce("claim_unit", F.lit("")) != "", F.col("claim_unit") == "%").otherwise(F.coalesce(F.col("computed_unit") == "%", F.lit(False)) | F.coalesce(F.col("claim_type").isin("rate", "ratio"), F.lit(False)))


def gap() -> Column:
    return F.abs(F.col("claim_value") - F.col("computed_value"))


def tolerance() -> Column:
    """Half a unit of the last printed digit: decimals of a percentage (0.1 without), trailing zeros (up to 3) of a count."""
    text = F.col("claim_value").cast("decimal(38,10)").cast("string")
    decimals = F.length(F.regexp_extract(text, r"\.(\d*?)0*$", 1))
    zeros = F.least(F.length(F.regexp_extract(F.abs(F.round("claim_value")).cast("decimal(38,0)").cast("string"), r"^[1-9]\d*?(0*)$", 1)), F.lit(3))
    return F.when(is_percent(), F.when(decimals > 0, F.lit(0.5) * F.pow(F.lit(10.0), -decimals)).otherwise(0.1)).otherwise(F.lit(0.5) * F.pow(F.lit(10.0), zeros))


def type_mismatch() -> Column:
    """A level against a change (but a delta against a change is meant so), a rate against a level, percent against an index."""
    level = (F.col("claim_type") == "level") & F.col("calc_type").isin(*CHANGES) & ~((F.col("value_type") == "delta") & (F.col("calc_type") == "change"))
    rate = (F.col("claim_type") == "rate") & F.col("calc_type").isin(*LEVELS)
    index = ~F.col("calc_type").isin(*CHANGES) & is_percent() & F.coalesce("computed_unit", F.lit("")).rlike(r"(19|20)\d{2}\s*[＝=]\s*100")
    return F.coalesce(level, F.lit(False)) | F.coalesce(rate, F.lit(False)) | F.coalesce(index, F.lit(False))


def granularity(period: Column) -> Column:
    runs = F.regexp_extract_all(period, F.lit(r"(\d+)"), F.lit(1))
    return F.when(period.contains("월") & ~period.contains("개월"), "M").when(F.exists(runs, lambda r: F.length(r) == 6), "M").when(F.exists(runs, lambda r: F.length(r) == 4), "Y")


def gran_mismatch() -> Column:
    return F.coalesce(granularity(F.col("claim_period")) != granularity(F.col("computed_period")), F.lit(False))


def year_mismatch(most: int = 3) -> Column:
    """Whether the closest pair of years lies over `most` apart; False where either side names none."""
    years = lambda c: F.transform(F.regexp_extract_all(F.col(c), F.lit(r"((?:19|20)\d{2})"), F.lit(1)), lambda x: x.cast("int"))
    gaps = F.flatten(F.transform(years("claim_period"), lambda a: F.transform(years("computed_period"), lambda b: F.abs(a - b))))
    return F.coalesce(F.array_min(gaps) > most, F.lit(False))


def rule_verdict(df: DataFrame) -> DataFrame:
    """df plus gap, tolerance, the mismatch flags and verdict: 'match', or null where the rule defers."""
    both = (F.coalesce("claim_unit", F.lit("")) != "") & (F.coalesce("computed_unit", F.lit("")) != "")
    unit = both & (F.col("claim_unit") != F.col("computed_unit")) & ~is_percent()
    out = df.withColumns({"gap": gap(), "tolerance": tolerance(), "type_off": type_mismatch(), "unit_off": F.coalesce(unit, F.lit(False)), "year_off": year_mismatch(), "gran_off": gran_mismatch()})
    ok = (F.col("gap") <= F.col("tolerance")) & ~F.col("type_off") & ~F.col("unit_off") & ~F.col("year_off") & ~F.col("gran_off") & (F.coalesce("computed_period", F.lit("")) != "")
    return out.withColumn("verdict", F.when(ok, "match"))


#: Other names of gap types.
GAP_ALIASES = {"numeric": "value", "number": "value", "time": "period", "date": "period", "scope": "target", "none": None}


def apply_adjudication(df: DataFrame, replies: DataFrame) -> DataFrame:
    """df (claim_id, verdict) overlaid with an external reply (JSON: verdict, gap_type, topic_match) where the rule deferred.

    Verdicts outside the list are undecidable; a topic that doesn't match forces undecidable without a gap type.
    """
    r = replies.select("claim_id", F.from_json("reply", "struct<verdict:string,gap_type:string,topic_match:boolean>").alias("r"))
    rows = df.join(r, "claim_id", "left")
    aliases = F.create_map(*[x for k, v in GAP_ALIASES.items() if v for x in (F.lit(k), F.lit(v))])
    kind = F.lower(F.trim("r.gap_type"))
    known = F.when(F.col("r.verdict").isin("match", "mismatch", "undecidable"), F.col("r.verdict")).when(F.col("r").isNotNull(), "undecidable")
    off = F.coalesce(~F.col("r.topic_match"), F.lit(False))
    deferred = F.col("verdict").isNull()
    gap_type = F.when(deferred & ~off & (kind != "none") & (kind != ""), F.coalesce(F.try_element_at(aliases, kind), kind))
    return rows.withColumns({"gap_type": gap_type, "verdict": F.when(deferred & off, "undecidable").when(deferred, known).otherwise(F.col("verdict"))}).drop("r")


def needs_joint(claims: DataFrame) -> DataFrame:
    """(article_id, joint): several claims with a comparison among them, or several computed results."""
    return claims.groupBy("article_id").agg((((F.count(F.lit(1)) > 1) & F.coalesce(F.bool_or(F.col("claim_type") == "compare"), F.lit(False))) | (F.count("computed_value") > 1)).alias("joint"))


def early_exit() -> Column:
    """struct(verdict, calc_required) for claims that stop before matching; null where they go on."""
    out = lambda v, c: F.struct(F.lit(v).alias("verdict"), F.lit(c).alias("calc_required"))
    return F.when(F.col("claim_type") == "forecast", out("undecidable", "no")).when(F.col("is_foreign"), out("undecidable", "no")).when(~F.col("trusted"), out("unclear", "no")).when(F.col("calc_type").isNull(), out("undecidable", "no"))


def record_id(title: Column, sentence: Column) -> Column:
    """The first 12 hex digits of md5 over title|sentence; nulls count as empty."""
    return F.substring(F.md5(F.concat(F.coalesce(title, F.lit("")), F.lit("|"), F.coalesce(sentence, F.lit("")))), 1, 12)


def to_records(df: DataFrame, catalog: DataFrame) -> DataFrame:
    """df (title, sentence, table_id, calc_type, …) plus result_id, the table's category and calc_required."""
    cat = catalog.select("table_id", "category")
    return df.join(cat, "table_id", "left").withColumns({"result_id": record_id(F.col("title"), F.col("sentence")), "calc_required": F.when(F.coalesce(F.col("calc_type"), F.lit("lookup")) == "lookup", "no").otherwise("yes")})


def period_label(period: Column, freq: Column) -> Column:
    """2024년 2분기 or 2024년 2월 for six digits by frequency; other periods as they are; ~ joins both ends."""
    one = lambda p: F.when(p.rlike(r"^\d{6}$") & freq.isin("Q", "M"), F.concat(F.substring(p, 1, 4), F.lit("년 "), F.substring(p, 5, 2).cast("int").cast("string"), F.when(freq == "Q", "분기").otherwise("월"))).otherwise(p)
    return F.array_join(F.transform(F.split(period, "~"), one), "~")


def calc_summary(df: DataFrame) -> DataFrame:
    """df plus summary: what was computed, over which period, with which result."""
    text = F.concat_ws(" ", F.coalesce("calc_type", F.lit("lookup")), period_label(F.col("computed_period"), F.col("freq")), F.format_number("computed_value", 1), "computed_unit")
    return df.withColumn("summary", text)


def check_explanations(df: DataFrame) -> DataFrame:
    """df plus ok: the text isn't blank, and an undecidable verdict states its limitation."""
    filled = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    return df.withColumn("ok", filled("text") & (filled("limitation") | (F.col("verdict") != "undecidable")))
