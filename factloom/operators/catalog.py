"""Building and checking the catalog of statistics tables.

Catalog: table_id, title, category, keywords array, description, embedding_text. Index: table_id, org_id, text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def crawl_leaves(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leaves, the first row of each leaf id by pos; categories, rows without a leaf id)."""
    first = F.row_number().over(W.partitionBy("leaf_id").orderBy("pos"))
    leaves = rows.filter("leaf_id is not null").withColumn("_k", first).filter("_k = 1").drop("_k")
    return leaves, rows.filter("leaf_id is null and list_id is not null")


def frontier(categories: DataFrame, visited: DataFrame) -> DataFrame:
    """Child categories that haven't been visited."""
    return categories.select("list_id").distinct().join(visited, "list_id", "left_anti")


def crawl(items: DataFrame, roots: DataFrame, folder: str, most_levels: int = 1000) -> tuple[DataFrame, DataFrame]:
    """((view, table_id, level), (view, list_id, level)): all tables and categories below the roots, each at its first level.

    items (view, parent_id, list_id, table_id) hold a category's children: categories by list_id, tables by table_id. roots:
    (view, list_id). A level of categories is one join; what was visited is left out of the next, so cycles end. Every level is
    written below folder, and a crawl that was broken off goes on after the last level that is there as a whole.
    """
    spark = items.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    kind = items.schema["list_id"].dataType.simpleString()
    visited = lambda n: [f"{folder}/visited/{i:04d}" for i in range(n)]
    read = lambda n: spark.read.schema(f"view string, list_id {kind}, level int").parquet(*visited(n))

    def whole(path: str) -> bool:
        place = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return place.getFileSystem(conf).exists(place)

    level = 0
    while whole(visited(level + 1)[-1]):
        level += 1
    if not level:
        roots.select("view", "list_id").distinct().withColumn("level", F.lit(0)).write.mode("overwrite").parquet(visited(1)[-1])
        level = 1
    while level < most_levels and not read(level).filter(F.col("level") == level - 1).isEmpty():
        front = read(level).filter(F.col("level") == level - 1).select("view", F.col("list_id").alias("parent_id"))
        below = items.filter("table_id is null and list_id is not null").join(front, ["view", "parent_id"]).select("view", "list_id").distinct()
        below.join(read(level), ["view", "list_id"], "left_anti").withColumn("level", F.lit(level)).write.mode("overwrite").parquet(visited(level + 1)[-1])
        level += 1
    seen = read(level)
    tables = items.filter("table_id is not null").join(seen.withColumnRenamed("list_id", "parent_id"), ["view", "parent_id"]).groupBy("view", "table_id").agg((F.min("level") + 1).alias("level"))
    return tables, seen


def pick_title(rows: DataFrame, priority: dict[str, int]) -> DataFrame:
    """(table_id, name, view): one named row for each table, by the view's priority, then pos; other views come between."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in priority.items() for x in (F.lit(k), F.lit(v))]), F.col("view")), F.lit(50))
    best = rows.filter("name is not null and trim(name) != ''").groupBy("table_id").agg(F.min(F.struct(rank.alias("r"), "pos", "name", "view")).alias("b"))
    return best.select("table_id", "b.name", "b.view")


def enrich_text(index: DataFrame, orgs: DataFrame, dates: DataFrame) -> DataFrame:
    """index with `[org, year-month] ` before the text, once; plus outcome: done, already or unknown_org."""
    rows = index.join(orgs, "org_id", "left").join(dates, "table_id", "left")
    prefix = F.concat(F.lit("["), F.concat_ws(", ", "org_name", "year_month"), F.lit("] "))
    outcome = F.when(F.col("org_name").isNull(), "unknown_org").when(F.startswith("text", F.concat(F.lit("["), F.col("org_name"))), "already").otherwise("done")
    return rows.withColumn("outcome", outcome).withColumn("text", F.when(outcome == "done", F.concat(prefix, F.col("text"))).otherwise(F.col("text"))).drop("org_name", "year_month")


def append_axes(text: Column, axes: Column) -> Column:
    """The text with its axis names behind it, unless they are there."""
    suffix = F.concat(F.lit(" (axes: "), F.array_join(axes, ", "), F.lit(")"))
    return F.when((F.coalesce(F.size(axes), F.lit(0)) > 0) & ~F.contains(text, suffix), F.concat(text, suffix)).otherwise(text)


def looks_english(title: Column) -> Column:
    """Has letters, and only ASCII ones."""
    return title.rlike(r"\p{L}") & ~title.rlike(r"[\p{L}&&[^\p{ASCII}]]")


def patch_titles(index: DataFrame, names: DataFrame) -> DataFrame:
    """index with English-looking titles replaced by a name (table_id, native) that doesn't look English."""
    rows = index.join(names, "table_id", "left")
    use = looks_english(F.col("title")) & F.col("native").isNotNull() & ~looks_english(F.col("native"))
    return rows.withColumn("patched", F.coalesce(use, F.lit(False))).withColumn("title", F.when(F.col("patched"), F.col("native")).otherwise(F.col("title"))).drop("native")


def org_whitelist(params: DataFrame, index: DataFrame, names: DataFrame) -> DataFrame:
    """(org_id, org_name) for the ids of either source."""
    return params.select("org_id").union(index.select("org_id")).distinct().join(names, "org_id")


def add_labels(index: DataFrame, codes: DataFrame, most: int = 80) -> DataFrame:
    """index with the distinct labels of its table behind the text, in order, where there are 1 to `most`; plus backup."""
    first = codes.groupBy("table_id", "label").agg(F.min("ord").alias("ord"))
    labels = first.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("ord", "label"))).alias("l"))
    rows = index.join(labels, "table_id", "left")
    ok = F.coalesce(F.size("l"), F.lit(0)).between(1, most)
    return rows.withColumn("backup", F.when(ok, F.col("text"))).withColumn("text", F.when(ok, F.concat_ws(" ", "text", F.array_join(F.transform("l", lambda x: x.label), " "))).otherwise(F.col("text"))).drop("l")


def revert(index: DataFrame, backup: DataFrame) -> DataFrame:
    """index with texts as in backup (table_id, old)."""
    return index.join(backup, "table_id", "left").withColumn("text", F.coalesce("old", "text")).drop("old")


def dup_ids(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("table_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def integrity(catalog: DataFrame, params: DataFrame) -> DataFrame:
    """(table_id, missing_in): ids of one table that the other lacks."""
    a = catalog.select("table_id").distinct().join(params.select("table_id"), "table_id", "left_anti").withColumn("missing_in", F.lit("params"))
    b = params.select("table_id").distinct().join(catalog.select("table_id"), "table_id", "left_anti").withColumn("missing_in", F.lit("catalog"))
    return a.unionByName(b)


def required(catalog: DataFrame, fields: list[str]) -> DataFrame:
    """(table_id, field): fields that are null, blank or empty."""
    kinds = dict(catalog.dtypes)
    empty = lambda c: F.col(c).isNull() | ((F.size(c) == 0) if kinds[c].startswith("array") else (F.trim(F.col(c).cast("string")) == ""))
    return catalog.select("table_id", F.explode(F.filter(F.array(*[F.when(empty(c), F.lit(c)) for c in fields]), lambda x: x.isNotNull())).alias("field"))


def kw_collisions(catalog: DataFrame) -> DataFrame:
    """(kw, n, tables): keywords of more than one table."""
    kw = catalog.select("table_id", F.explode(F.array_distinct("keywords")).alias("kw"))
    return kw.groupBy("kw").agg(F.array_sort(F.collect_set("table_id")).alias("tables")).filter(F.size("tables") > 1).select("kw", F.size("tables").alias("n"), "tables")


def kw_substrings(catalog: DataFrame, documented: DataFrame, least: int = 2) -> DataFrame:
    """(inner, outer, n_tables, documented): distinct keywords inside another table's longer keyword.

    Every substring of a keyword is a row, so this is an equi-join; keywords are short, and each is taken once.
    """
    kw = catalog.select("table_id", F.explode(F.array_distinct("keywords")).alias("kw")).distinct()
    words = kw.select("kw").distinct()
    starts = words.select(F.col("kw").alias("outer"), F.explode(F.sequence(F.lit(1), F.length("kw"))).alias("a"))
    subs = starts.select("outer", F.explode(F.transform(F.sequence(F.lit(least), F.greatest(F.length("outer") - F.col("a") + 1, F.lit(least))), lambda n: F.substring(F.col("outer"), F.col("a"), n))).alias("inner")).filter((F.length("inner") >= least) & (F.col("inner") != F.col("outer"))).distinct()
    pairs = subs.join(words.withColumnRenamed("kw", "inner"), "inner")
    tables = pairs.join(kw.select(F.col("kw").alias("inner"), F.col("table_id").alias("ti")), "inner").groupBy("inner", "outer").agg(F.count_distinct("ti").alias("n_tables"))
    return tables.join(documented.withColumn("documented", F.lit(True)), ["inner", "outer"], "left").withColumn("documented", F.coalesce("documented", F.lit(False)))


def text_gaps(catalog: DataFrame) -> DataFrame:
    """(table_id, missing): the title or keywords that the search text lacks."""
    gaps = F.filter(F.concat(F.array("title"), "keywords"), lambda w: ~F.contains(F.col("embedding_text"), w))
    return catalog.select("table_id", gaps.alias("missing")).filter(F.size("missing") > 0)


def unknown_categories(catalog: DataFrame, vocabulary: DataFrame) -> DataFrame:
    return catalog.select("category").distinct().join(vocabulary, "category", "left_anti")


def with_version(catalog: DataFrame, versions: DataFrame, version: str) -> DataFrame:
    """catalog with the keywords of a version (table_id, version, words) where it has them."""
    v = versions.filter(F.col("version") == version).select("table_id", "words")
    return catalog.join(v, "table_id", "left").withColumn("keywords", F.coalesce("words", "keywords")).drop("words")


def validate(catalog: DataFrame, params: DataFrame, vocabulary: DataFrame, fields: list[str]) -> DataFrame:
    """(finding, severity, n): how many of each finding; it passes if there is no error."""
    one = lambda df, name, severity: df.select(F.lit(name).alias("finding"), F.lit(severity).alias("severity"))
    found = one(dup_ids(catalog), "duplicate id", "error").unionByName(one(integrity(catalog, params), "integrity", "error")).unionByName(one(required(catalog, fields), "required field", "error"))
    found = found.unionByName(one(kw_collisions(catalog), "shared keyword", "warning")).unionByName(one(text_gaps(catalog), "text gap", "warning")).unionByName(one(unknown_categories(catalog, vocabulary), "unknown category", "warning"))
    return found.groupBy("finding", "severity").agg(F.count(F.lit(1)).alias("n"))


def enrich_queue(cands: DataFrame, index: DataFrame, axes: DataFrame) -> DataFrame:
    """index (with marked) after one round: candidates not yet marked get their axes; plus changed, where a new vector is due."""
    due = cands.select("table_id").distinct().withColumn("due", F.lit(True))
    rows = index.join(due, "table_id", "left").join(axes, "table_id", "left")
    now = F.coalesce("due", F.lit(False)) & ~F.col("marked")
    text = F.when(now, append_axes(F.col("text"), F.col("axes"))).otherwise(F.col("text"))
    return rows.withColumns({"changed": text != F.col("text"), "marked": F.col("marked") | now, "text": text}).drop("due", "axes")
