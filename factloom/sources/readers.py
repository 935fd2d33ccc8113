"""Scans. Each names its schema, so nothing is inferred and columns are pruned at the scan."""

from __future__ import annotations

import html
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARTICLE_CSV = "title string, date string, url string, text string, flag string"


def read_articles(spark: SparkSession, path: str, fallback: str = "2025-01-01") -> DataFrame:
    """(title, published_date, url, text) of rows flagged true; byte order marks go anywhere, bad dates become the fallback."""
    rows = spark.read.schema(ARTICLE_CSV).csv(path, header=True, multiLine=True, quote='"', escape='"')
    clean = rows.select(*[F.regexp_replace(c, "﻿", "").alias(c) for c in ("title", "date", "url", "text", "flag")])
    date = F.coalesce(F.expr("try_to_timestamp(date, 'yyyy-M-d')").cast("date"), F.lit(fallback).cast("date"))
    return clean.filter(F.lower(F.trim("flag")) == "true").select("title", date.alias("published_date"), "url", "text")


def titles(df: DataFrame) -> DataFrame:
    """(title, text, date): the last row of each title by pos; the date as YYYY-MM-DD, null where it can't be read."""
    last = df.groupBy("title").agg(F.max(F.struct("pos", "text", "date")).alias("m"))
    return last.select("title", "m.text", F.date_format(F.expr("try_to_timestamp(m.date, 'yyyy-M-d')"), "yyyy-MM-dd").alias("date"))


CATALOG_JSON = "tables array<struct<tblId:string,orgId:string,title:string,category:string,keywords:array<string>>>"


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """One row for each table of a nested catalog file."""
    return spark.read.schema(CATALOG_JSON).json(path, multiLine=True).select(F.inline("tables")).withColumnRenamed("tblId", "table_id")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines that parse; blank and broken ones are skipped."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED").dropna(how="all")


PARAMS_JSON = "id string, orgId string, items map<string,string>, dimensions map<string,struct<code_map:map<string,string>,default_value:string>>"


def read_params(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(items: table_id, item_id, name; codes: table_id, axis, label, code, is_default) from nested table parameters."""
    rows = spark.read.schema(PARAMS_JSON).json(path)
    items = rows.select(F.col("id").alias("table_id"), F.explode("items").alias("item_id", "name"))
    axes = rows.select(F.col("id").alias("table_id"), F.explode("dimensions").alias("axis", "d"))
    codes = axes.select("table_id", "axis", F.explode("d.code_map").alias("label", "code"), F.col("d.default_value").alias("_d"))
    return items, codes.withColumn("is_default", F.coalesce(F.col("code") == F.col("_d"), F.lit(False))).drop("_d")


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, without its unnamed columns."""
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    return rows.drop(*[c for c in rows.columns if c.startswith(("Unnamed", "_c")) or not c.strip()])


_TAG = re.compile(r"<[^>]*>")
_BLOCK = re.compile(r"(?is)<p[^>]*>(.*?)</p>")


def embedded_json(page: str, marker: str) -> dict | None:
    """The object that follows marker, its braces balanced outside strings."""
    at = page.find(marker)
    at = page.find("{", at) if at >= 0 else -1
    if at < 0:
        return None
    try:
        return json.JSONDecoder(strict=False).raw_decode(page, at)[0]
    except ValueError:
        return None


def article_text(page: str | None, marker: str) -> str | None:
    """Text elements of the embedded object, tags stripped and entities read, blank lines between; else the page's paragraphs."""
    found = embedded_json(page or "", marker)
    parts = [x.get("content", "") for x in (found or {}).get("content_elements", []) if isinstance(x, dict) and x.get("type") == "text"] if isinstance(found, dict) else []
    if not parts:
        parts = _BLOCK.findall(page or "")
    clean = [html.unescape(_TAG.sub("", p)).strip() for p in parts]
    return "\n\n".join(c for c in clean if c) or None


def extract_articles(pages: DataFrame, marker: str = "Fusion.globalContent=") -> DataFrame:
    """(page_id, text) for all pages; null text where nothing is found. The brace matcher runs in Arrow batches."""

    @F.pandas_udf("string")
    def body(c: pd.Series) -> pd.Series:
        return c.map(lambda p: article_text(p, marker))

    return pages.select("page_id", body("html").alias("text"))


def publish_dates(pages: DataFrame, record: str = "record") -> DataFrame:
    """(page_id, published): the first of display, first-publish and created date, moved from UTC to Korean time."""
    first = F.coalesce(*[F.get_json_object(record, f"$.{k}") for k in ("display_date", "first_publish_date", "created_date")])
    return pages.select("page_id", F.to_date(F.from_utc_timestamp(F.to_timestamp(first), "Asia/Seoul")).alias("published"))


def period_ranges(meta: DataFrame, start: str = "strtPrdDe", end: str = "endPrdDe", freq: str = "prdSe") -> DataFrame:
    """(table_id, freq, start, end) from metadata text with unquoted keys, {prdSe:"Y",strtPrdDe:"2000",endPrdDe:"2024"}."""
    found = lambda k: F.regexp_extract_all("text", F.lit(rf'{k}\s*:\s*"([^"]*)"'), F.lit(1))
    return meta.select("table_id", F.inline(F.arrays_zip(found(freq).alias("freq"), found(start).alias("start"), found(end).alias("end"))))


def parsed_dims(text: Column) -> Column:
    return F.from_json(text, T.MapType(T.StringType(), T.StringType()))
