"""The whole chain over a stream of articles: candidates, claims, official cells, verdicts, records and exports.

Articles stream in; claims as a model gave them, matches, official cells and the catalog are static tables, or tables that grow
on their own and are read anew for each micro-batch. What a micro-batch yields goes into versioned tables in one commit, so
readers see the records of an article and the exports made from them together, or neither.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.locale import Pack
from factloom.operators import compute, text, verdict
from factloom.sources.sinks import upsert
from factloom.sources.versioned import upsert_tables


def records_of(articles: DataFrame, claims: DataFrame, matches: DataFrame, obs: DataFrame) -> DataFrame:
    """(claim_id, article_id, calc_type, status, computed_value, computed_period, verdict) of the claims of articles.

    claims: claim_id, article_id, sentence and what the rule reads of a claim (claim_value, claim_unit, claim_type, value_type,
    claim_period). matches: claim_id, calc_type, the cell, period, start_period and computed_unit; claims without a match keep
    null verdicts. Repeated rows of an article make no repeated records.
    """
    read = ("article_id", "claim_value", "claim_unit", "claim_type", "value_type", "claim_period")
    own = claims.join(articles.select("article_id").distinct(), "article_id", "left_semi").select("claim_id", *read)
    got = compute.compute(own.join(matches.withColumn("_met", F.lit(True)), "claim_id", "left"), obs, (*read, "computed_unit", "_met"))
    of_match = {"calc_type": "calc_type", "status": "status", "value": "computed_value", "period": "computed_period"}
    rows = got.select("claim_id", *read, "computed_unit", *[F.when(F.col("_met"), F.col(c)).alias(name) for c, name in of_match.items()])
    return verdict.rule_verdict(rows).select("claim_id", "article_id", "calc_type", "status", "computed_value", "computed_period", "verdict")


def article_export(articles: DataFrame, records: DataFrame, pack: Pack) -> DataFrame:
    """(article_id, n_expressions, n_claims, n_match): how much of an article's numbers was checked, and with what result."""
    said = text.numeric_candidates(articles.select("article_id", "text").distinct(), pack).groupBy("article_id").agg(F.sum("expressions").alias("n_expressions"))
    of = records.groupBy("article_id").agg(F.count(F.lit(1)).alias("n_claims"), F.count_if(F.col("verdict") == "match").alias("n_match"))
    out = articles.select("article_id").distinct().join(said, "article_id", "left").join(of, "article_id", "left")
    return out.select("article_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_expressions", "n_claims", "n_match")])


def article_stream(stream: DataFrame, chain: Callable[[DataFrame], dict[str, tuple[DataFrame, str]]], target: str, checkpoint: str, buckets: int = 64, trigger: dict | None = None):
    """A running query that upserts what chain makes of each micro-batch, {table: (rows, key)}, into the tables below target.

    All tables of a micro-batch change in one commit, which carries its number: one that is run again after a failure changes
    nothing. An article that comes again replaces its records.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        made = {name: (rows.withColumn("seq", F.lit(batch_id)), key) for name, (rows, key) in chain(batch).items()}
        upsert_tables(batch.sparkSession, target, made, upsert, buckets, (checkpoint, batch_id))

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
