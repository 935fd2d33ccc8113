"""Tables that change in one step: snapshots of Parquet folders under a log of commits.

A folder holds any number of named tables, each dealt out to hash partitions of its key. A commit is one small file of the log,
named by its version, which lists the folders of every partition of every table. Writers put their data down first, under names
of their own, and then move the commit's file to its place; that either succeeds as a whole or fails as the version is there
already, which is how two writers at once are told apart: the later one starts over on the new version. Readers follow the
last commit, or any earlier one, and never see data that no commit names. What no kept commit names is removed by vacuum().

A batch that carries a name and a number is taken once: commits remember the last number of each name.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.session import spent_shuffles


class Clash(RuntimeError):
    """Another writer committed this version first."""


def _files(spark: SparkSession, path: str):
    """(the file system of a path, the path) of the cluster."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _name(version: int) -> str:
    return f"{version:020d}.json"


def versions(spark: SparkSession, root: str) -> list[int]:
    """Versions that the log still holds, in order."""
    fs, log = _files(spark, f"{root}/_log")
    if not fs.exists(log):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(log)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """What a version, the last if none is given, consists of; version 0 is empty."""
    held = versions(spark, root)
    if version is None:
        version = held[-1] if held else 0
    if version == 0:
        return {"version": 0, "tables": {}, "batches": {}}
    if version not in held:
        raise ValueError(f"version {version} is not in the log of {root}")
    fs, file = _files(spark, f"{root}/_log/{_name(version)}")
    stream = fs.open(file)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def commit(spark: SparkSession, root: str, content: dict) -> None:
    """Make content["version"] the last version, or raise Clash if there is one of that number."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    fs, temp = _files(spark, f"{root}/_log/.{uuid.uuid4().hex}")
    stream = fs.create(temp, False)
    try:
        stream.write(json.dumps(content).encode())
    finally:
        stream.close()
    place = jvm.org.apache.hadoop.fs.Path(f"{root}/_log/{_name(content['version'])}")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    never_over = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(temp, place, never_over)
    except Exception as e:
        fs.delete(temp, False)
        if "FileAlreadyExists" in str(e):
            raise Clash(f"version {content['version']} of {root} is there already") from None
        raise


def snapshot(spark: SparkSession, root: str, table: str = "main", version: int | None = None) -> DataFrame | None:
    """A table as of a version, with every column that some batch brought; None if that version has no such table."""
    held = manifest(spark, root, version)["tables"].get(table)
    if held is None:
        return None
    schema = T.StructType.fromJson(held["schema"])
    paths = [f"{root}/{p}" for p in held["parts"].values()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _wider(a: T.StructType, b: T.StructType) -> T.StructType:
    """The columns of a, then those that only b has; all may be null."""
    mine = {f.name for f in a}
    return T.StructType([T.StructField(f.name, f.dataType) for f in [*a, *(f for f in b if f.name not in mine)]])


def upsert_tables(spark: SparkSession, root: str, batches: dict[str, tuple[DataFrame, str]], merge: Callable[[DataFrame, DataFrame, str], DataFrame], buckets: int = 64, batch: tuple[str, int] | None = None, tries: int = 5) -> int:
    """Upsert one batch for each named table, (rows, key), in one commit; the version that holds it.

    Only the partitions that a batch touches are rewritten. merge(target, batch, key) gives their new rows. A batch (name,
    number) that a commit already holds changes nothing. A clash starts over on the version that won; after `tries` it is raised.
    """
    for left in range(tries - 1, -1, -1):
        base = manifest(spark, root)
        if batch and base["batches"].get(batch[0], -1) >= batch[1]:
            return base["version"]
        tables = dict(base["tables"])
        for name, (rows, key) in batches.items():
            held = tables.get(name, {"schema": None, "parts": {}, "key": key, "buckets": buckets})
            tables[name] = _with_batch(spark, root, held, rows, merge)
        done = dict(base["batches"]) | ({batch[0]: batch[1]} if batch else {})
        try:
            commit(spark, root, {"version": base["version"] + 1, "tables": tables, "batches": done})
            return base["version"] + 1
        except Clash:
            if not left:
                raise
    raise Clash(root)


def part_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _with_batch(spark: SparkSession, root: str, held: dict, rows: DataFrame, merge) -> dict:
    """The table's entry after a batch; its new folders are written, and nothing refers to them yet.

    The batch is worked out once, into a folder of its own that goes again; one that a failure leaves is removed by vacuum().
    """
    key, buckets = held["key"], held["buckets"]
    staged = f"{root}/data/{uuid.uuid4().hex}"
    with spent_shuffles(spark):
        rows.write.parquet(staged)
    rows = spark.read.schema(rows.schema).parquet(staged)
    touched = sorted(r[0] for r in rows.select(part_of(key, buckets)).distinct().collect())  # at most `buckets` numbers
    old = [held["parts"][str(p)] for p in touched if str(p) in held["parts"]]
    if held["schema"] is None:
        target = rows.drop("seq").limit(0)
    else:
        schema = T.StructType.fromJson(held["schema"])
        target = spark.read.schema(schema).parquet(*[f"{root}/{p}" for p in old]) if old else spark.createDataFrame([], schema)
    new = merge(target, rows, key)
    folder = f"data/{uuid.uuid4().hex}"
    with spent_shuffles(spark):
        new.withColumn("_part", part_of(key, buckets)).write.partitionBy("_part").parquet(f"{root}/{folder}")
    fs, where = _files(spark, staged)
    fs.delete(where, True)
    fs, where = _files(spark, f"{root}/{folder}")
    names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    parts = {k: v for k, v in held["parts"].items() if int(k) not in touched} | {n.split("=")[1]: f"{folder}/{n}" for n in names if n.startswith("_part=")}
    schema = _wider(T.StructType.fromJson(held["schema"]) if held["schema"] else T.StructType([]), new.schema)
    return held | {"schema": schema.jsonValue(), "parts": parts}


def last_wins(target: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """target with batch's rows in place of those with the same key; of several in a batch the last by `seq`, if it has one."""
    fresh = batch
    if "seq" in batch.columns:
        fresh = batch.withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy(F.desc("seq")))).filter("_k = 1").drop("_k", "seq")
    return target.join(fresh.select(key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Forget all but the last `keep` versions, and remove the data folders that none of those names; how many went.

    Not to be run beside a writer, whose data no commit names yet.
    """
    held = versions(spark, root)
    kept = held[-keep:]
    named = {p.split("/")[1] for v in kept for t in manifest(spark, root, v)["tables"].values() for p in t["parts"].values()}
    for v in held[: -len(kept)] if kept else []:
        fs, file = _files(spark, f"{root}/_log/{_name(v)}")
        fs.delete(file, False)
    fs, data = _files(spark, f"{root}/data")
    spent = [s.getPath() for s in fs.listStatus(data) if s.getPath().getName() not in named] if fs.exists(data) else []
    for p in spent:
        fs.delete(p, True)
    return len(spent)
