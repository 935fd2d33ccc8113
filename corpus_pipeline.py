"""From raw documents to token ids in five stages; each stage works on what the one before it kept.

Rules for input: as the operators state; all stages but the last return the columns of documents, n_chars following the
text. An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import bpe, decontaminate, lines, quality, simhash
from factloom.llm.queries import THRESHOLD, WORD_BPE, held_out, table
from factloom.llm.shared import cut, own_name


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; the classifier learns from the labels beside the raw table."""
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out())
    score = own_name(docs, "_score")
    return docs.withColumn(score, quality.score_column(docs, model)).filter(F.col(score) >= THRESHOLD).drop(score)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go, and with them documents that had no other line."""
    own = {c: own_name(docs, f"_own_{c}") for c in ("n_lines", "n_removed") if c in docs.columns}  # kept over the stage's counts
    out = lines.dedup_lines(docs.withColumnsRenamed(own), drop_emptied=True).drop("n_lines", "n_removed").withColumnsRenamed({v: k for k, v in own.items()})
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of texts that share 0.8 of their five-word shingles: the one with the smallest id.

    Rows without an id come after all others; then the smaller text hash decides; of rows with one id and text, the one
    whose other columns come first as JSON stays. Unlike texts stay each, whether or not they share an id.
    """
    groups = simhash.similar_documents(docs).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("k"), "doc_id", "sha")).alias("m"))
    name = lambda i, sha: F.concat_ws(":", i.cast("string"), sha)
    key = own_name(docs, "_key")
    keep = groups.select(name(F.col("m.doc_id"), F.col("m.sha")).alias(key))
    keyed = docs.withColumn(key, name(F.col("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256))).join(keep, key, "left_semi")
    rest = F.to_json(F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")]))
    return keyed.groupBy(key).agg(F.min_by(F.struct(*docs.columns), rest).alias("row")).select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; rows go by their text's hash, so ids may be null or repeated."""
    key, bad = own_name(docs, "_key"), own_name(docs, "_bad")
    keyed = docs.withColumn(key, F.sha2("text", 256))
    found = cut(decontaminate.contaminated(keyed, table(spark, sf_dir, "benchmark"), id_col=key).select(F.col(key).alias(bad)).distinct(), "contaminated")
    return keyed.join(found, keyed[key] == found[bad], "left_anti").select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document left, with the digests of ids and decoded text."""
    e = bpe.encode_documents(docs, WORD_BPE)
    return e.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", drop_low_quality),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding", encode),
]

#: SQL has no classifier, fingerprints or BPE; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), ()
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower(), before)
        before = (docs,)
    return STAGES[-1][1](spark, docs, sf_dir)
