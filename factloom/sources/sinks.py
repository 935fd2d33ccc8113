"""Upserts, exports, hand-offs between jobs and index loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.session import shared_folder as staging_dir

from .readers import parsed_dims
from .versioned import snapshot, upsert_tables


def upsert(target: DataFrame, batch: DataFrame, key: str, created: Column | None = None) -> DataFrame:
    """target with batch's rows in place of those with the same key; of several in a batch the last by `seq` wins.

    Columns that one side lacks are null there, so a later batch may bring new ones; created_at has a default.
    """
    last = F.row_number().over(W.partitionBy(key).orderBy(F.desc("seq")))
    fresh = batch.withColumn("_k", last).filter("_k = 1").drop("_k", "seq")
    if created is not None:
        fresh = fresh.withColumn("created_at", F.coalesce("created_at", created) if "created_at" in fresh.columns else created)
    return target.join(fresh.select(key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def write_upsert(target_path: str, batch: DataFrame, key: str, buckets: int = 64, name: str | None = None, number: int | None = None) -> int:
    """Upsert into a versioned table; the version that holds the batch. A batch of that name and number is taken once.

    Only the hash partitions that the batch touches are rewritten, and all of them are replaced in one step: a failure before
    it leaves the old version whole, and readers stay on that until then.
    """
    return upsert_tables(batch.sparkSession, target_path, {"main": (batch, key)}, upsert, buckets, None if name is None else (name, number or 0))


def read_upserted(spark: SparkSession, target_path: str, version: int | None = None) -> DataFrame | None:
    """The table that write_upsert() keeps, as of a version, with every column that some batch brought."""
    return snapshot(spark, target_path, version=version)


def read_all(df: DataFrame, key: str) -> DataFrame:
    return df.orderBy(key)


def export_records(df: DataFrame, dims: str) -> DataFrame:
    """df with its dimension text as a map, and the text itself aside where it can't be parsed."""
    m = parsed_dims(F.col(dims))
    return df.withColumns({f"{dims}_map": m, f"{dims}_raw": F.when(m.isNull(), F.col(dims))})


def export_texts(records: DataFrame, live: DataFrame, filed: DataFrame) -> DataFrame:
    """(title, text) for cited titles: the live text, else the file's; titles with neither are left out."""
    cited = records.select("title").distinct()
    a, b = live.select("title", F.col("text").alias("_live")), filed.select("title", F.col("text").alias("_file"))
    return cited.join(a, "title", "left").join(b, "title", "left").select("title", F.coalesce("_live", "_file").alias("text")).filter("text is not null")


def export_dates(records: DataFrame, filed: DataFrame) -> DataFrame:
    """(title, date): the first date that a record has, by id, else the file's."""
    own = records.groupBy("title").agg(F.min(F.when(F.col("date").isNotNull(), F.struct("result_id", "date"))).alias("m")).select("title", "m.date")
    return own.join(filed.select("title", F.col("date").alias("_f")), "title", "left").select("title", F.coalesce("date", "_f").alias("date")).filter("date is not null")


def table_url(org: Column, table: Column, base: str) -> Column:
    """A direct link where the organisation is known, else a search for the table."""
    return F.when(org.isNotNull(), F.concat(F.lit(f"{base}/table?orgId="), org.cast("string"), F.lit("&tblId="), F.url_encode(table.cast("string")))).otherwise(F.concat(F.lit(f"{base}/search?q="), F.url_encode(table.cast("string"))))


def org_ids(records: DataFrame, catalog: DataFrame, index: DataFrame) -> DataFrame:
    """(table_id, org_id) of cited tables: from the catalog, the rest from the index, the smallest on repeats."""
    need = records.select("table_id").filter("table_id is not null").distinct()
    one = lambda df, name: df.groupBy("table_id").agg(F.min("org_id").alias(name))
    return need.join(one(catalog, "_c"), "table_id", "left").join(one(index, "_i"), "table_id", "left").select("table_id", F.coalesce("_c", "_i").alias("org_id"))


def pending(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return df.join(done.select(key).distinct(), key, "left_anti")


def result_rows(claims: DataFrame, skipped: DataFrame) -> DataFrame:
    """One sink schema for claim rows and skip rows."""
    return claims.withColumn("kind", F.lit("claim")).unionByName(skipped.withColumn("kind", F.lit("skip")), allowMissingColumns=True)


def match_log(ranked: DataFrame, sources: list[str]) -> DataFrame:
    """(claim_id, <source>…, total, top1): candidates of each source, and the table in the keyword source's first place."""
    counts = [F.sum((F.col("source") == s).cast("long")).alias(s) for s in sources]
    return ranked.groupBy("claim_id").agg(*counts, F.count(F.lit(1)).alias("total"), F.min(F.when(F.col("rank") == 1, F.struct(F.col("source"), "table_id"))).alias("t")).withColumn("top1", F.col("t.table_id")).drop("t")


def handoff(queued: DataFrame, scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((item_id, …, table_id, score) the best scored table of each queued item; (item_id) items that nothing was scored for)."""
    best = scored.groupBy("item_id").agg(F.max(F.struct("score", F.negative("table_id").alias("t"))).alias("m")).select("item_id", F.negative("m.t").alias("table_id"), "m.score")
    return queued.join(best, "item_id"), queued.join(best, "item_id", "left_anti").select("item_id")


def load_index(meta: DataFrame, vectors: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows to append: meta and vectors by position, ids that aren't there yet. Both must have as many rows.

    The count is checked inside the job: a position that one side lacks fails it.
    """
    rows = meta.join(vectors, "pos", "full")
    bad = F.col("table_id").isNull() | F.col("embedding").isNull()
    checked = rows.withColumn("pos", F.when(bad, F.raise_error(F.lit("metadata and vectors differ in number")).cast("long")).otherwise(F.col("pos")))
    return checked.join(existing.select("table_id"), "table_id", "left_anti")


def range_digests(rows: DataFrame, key: str, columns: list[str], bits: int = 12) -> DataFrame:
    """(range, n, a, b): for each range of the key's hash how many rows it has, and two sums of the hashes of their columns.

    One pass with a partial sum in every task; 2**bits rows at most come out, whatever goes in. Keep them beside a cache, and
    only what changes has to be read again.
    """
    said = lambda seed: F.sum(F.xxhash64(F.lit(seed), key, *[F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for c in columns]).cast("decimal(38,0)"))
    return rows.groupBy(hash_range(key, bits).alias("range")).agg(F.count(F.lit(1)).alias("n"), said(1).alias("a"), said(2).alias("b"))


def hash_range(key: str, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - bits).cast("int")


def stale(catalog: DataFrame, cache: DataFrame, model: str, bits: int = 12) -> DataFrame:
    """(table_id, why): vectors to make anew or to drop, as the text or the model changed or one side lacks the table.

    Both sides are first compared by the digests of hash ranges, as if every cached vector were of this model; only rows of
    ranges that differ are joined.
    """
    mine = range_digests(catalog.withColumn("model", F.lit(model)), "table_id", ["text", "model"], bits)
    its = range_digests(cache, "table_id", ["text", "model"], bits)
    both = mine.join(its.toDF("range", "_n", "_a", "_b"), "range", "full")
    same = F.col("n").eqNullSafe(F.col("_n")) & F.col("a").eqNullSafe(F.col("_a")) & F.col("b").eqNullSafe(F.col("_b"))
    differ = F.broadcast(both.filter(~same).select(F.col("range").alias("_range")))  # 2**bits numbers at most
    within = lambda rows: rows.join(differ, hash_range("table_id", bits) == F.col("_range"), "left_semi")
    c = within(cache).select("table_id", F.col("text").alias("_t"), F.col("model").alias("_m"))
    rows = within(catalog.select("table_id", "text")).join(c, "table_id", "full")
    why = F.when(F.col("_m").isNull(), "new").when(F.col("text").isNull(), "gone").when(~F.col("_m").eqNullSafe(F.lit(model)), "model").when(~F.col("text").eqNullSafe(F.col("_t")), "text")
    return rows.select("table_id", why.alias("why")).filter("why is not null")


def with_reviews(records: DataFrame, reviews: DataFrame) -> DataFrame:
    """records beside the reviewer's verdict, what holds of the two, and whether they agree."""
    r = reviews.select(F.col("claim_id").alias("result_id"), "reviewer_verdict")
    return records.join(r, "result_id", "left").withColumns({"final": F.coalesce("reviewer_verdict", "verdict"), "agrees": F.col("reviewer_verdict") == F.col("verdict")})
