"""Line dedup by distinct-site spread, with DataFrame operations only.

A HyperLogLog sketch of the sites is kept for each line hash and merged by aggregation. Where the estimate lies near the
threshold, the sites of those lines are counted exactly. A line seen on `min_sites` sites or more is boilerplate: it stays
at its first place (smallest id, then text hash, then line number) and goes everywhere else.

Rules for input: lines are what newlines separate, compared without the white space around them; blank lines always stay;
a null site counts as none; a null text stays null; rows that share id and text are one occurrence, so both keep the line;
null ids come first; other columns pass through unchanged, whatever their names, but for n_lines and n_removed, which are
replaced; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, own_name

MIN_SITES = 3
#: 2**LOG_K buckets in a sketch; its relative error is about 1.04 / 2**(LOG_K / 2).
LOG_K = 10
BAND = 4 * 1.04 / 2 ** (LOG_K / 2)


def occurrences(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """(id, th, pos, site, a, b): every line that isn't blank, under two independent 64-bit hashes."""
    line = F.trim(F.regexp_replace("line", r"^\s+|\s+$", ""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(site_col).alias("site"), F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "line"))
    return rows.withColumn("line", line).filter("line != ''").select("id", "th", "pos", "site", F.xxhash64("line").alias("a"), F.xxhash64(F.lit("second"), F.col("line")).alias("b"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(a, b, first, sites): lines on min_sites sites or more, and where each occurs first."""
    first = F.min(F.struct(F.col("id").isNotNull().alias("k"), "id", "th", "pos")).alias("first")
    spread = lines.groupBy("a", "b").agg(F.hll_sketch_agg(F.col("site").cast("string"), F.lit(LOG_K)).alias("sketch"), first)
    spread = spread.select("a", "b", "first", F.hll_sketch_estimate("sketch").alias("sites")).filter(F.col("sites") >= min_sites * (1 - BAND) - 1)
    spread = cut(spread, "line-spread")
    near = spread.filter(F.col("sites") <= min_sites * (1 + BAND) + 1)
    # distinct first: a line that a third of all rows hold is then a row for each site
    exact = lines.select("a", "b", "site").distinct().join(near.select("a", "b"), ["a", "b"], "left_semi").groupBy("a", "b").agg(F.count("site").alias("sites"))
    far = spread.filter(F.col("sites") > min_sites * (1 + BAND) + 1)
    return far.unionByName(near.drop("sites").join(exact, ["a", "b"])).filter(F.col("sites") >= min_sites)


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", drop_emptied: bool = False) -> DataFrame:
    """docs with boilerplate lines taken out of text_col, plus n_lines and n_removed.

    With drop_emptied, documents that had lines and lost them all are left out.
    """
    lines = occurrences(docs, id_col, text_col, site_col)
    bad = boilerplate(lines, min_sites)
    here: Column = F.struct(F.col("id").isNotNull().alias("k"), "id", "th", "pos")
    gone = lines.join(bad.select("a", "b", "first"), ["a", "b"]).filter(~here.eqNullSafe(F.col("first")))
    # a document's key is a hash of id and text; copies under one id lose the same lines
    gone_id, gone_th, gone_pos, kept = (own_name(docs, x) for x in ("_gone_id", "_gone_th", "_gone", "_kept"))
    gone = gone.groupBy(F.col("id").alias(gone_id), F.col("th").alias(gone_th)).agg(F.collect_set("pos").alias(gone_pos))
    on = docs[id_col].eqNullSafe(gone[gone_id]) & (F.xxhash64(docs[text_col]) == gone[gone_th])
    old = F.split(F.col(text_col), "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(old) - 1), F.col(gone_pos))
    text = F.array_join(F.transform(stay, lambda i: F.get(old, i)), "\n")
    n_lines, n_removed = F.coalesce(F.when(F.col(text_col).isNotNull(), F.size(old)), F.lit(0)).cast("long"), F.coalesce(F.size(gone_pos), F.lit(0)).cast("long")
    out = docs.join(gone, on, "left").withColumns({"n_lines": n_lines, "n_removed": n_removed, kept: F.when(F.col(gone_pos).isNull(), F.col(text_col)).otherwise(text)})
    if drop_emptied:
        out = out.filter((F.col("n_removed") == 0) | (F.trim(kept) != ""))
    return out.withColumn(text_col, F.col(kept)).drop(gone_id, gone_th, gone_pos, kept)
