"""Connected components of a link table, with nothing gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import delete, shared_dir


def connected_components(links: DataFrame, a: str, b: str, most_rounds: int = 100) -> DataFrame:
    """(node, root) for each node that has a link to another; root is the smallest node of its component.

    Alternates two steps until the links no longer change. Large star: every node links its larger neighbours to the
    smallest node it sees. Small star: every node links its smaller neighbours, and itself, to the smallest of them. Both
    keep components as they are and end in one star around each smallest node, in few rounds. Each round is a written table.
    """
    spark = links.sparkSession

    def write(df: DataFrame) -> tuple[DataFrame, str, tuple]:
        path = shared_dir(spark, "components")
        df.write.parquet(path)
        back = spark.read.schema("u long, v long").parquet(path)
        mark = back.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return back, path, tuple(mark)

    # v is always the smaller end
    edges = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).distinct()
    edges, path, mark = write(edges)
    for _ in range(most_rounds if mark[0] else 0):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        new, new_path, new_mark = write(small)
        delete(spark, path)
        edges, path = new, new_path
        if new_mark == mark:
            break
        mark = new_mark
    else:
        if mark[0]:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
