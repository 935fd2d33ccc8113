"""Scoring against golden sets: retrieval ranks, extraction recall, verdict accuracy, system comparisons."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import no_space


def golden(claims: DataFrame, mapping: DataFrame, catalog: DataFrame, overrides: dict[str, str]) -> DataFrame:
    """(claim_id, gold, confidence): claims with a mapped table of the catalog; ids by override; exact matches count as high."""
    rows = claims.join(mapping, "claim_id", "left")
    to = F.create_map(*[F.lit(x) for kv in overrides.items() for x in kv]) if overrides else F.lit(None).cast("map<string,string>")
    rows = rows.withColumn("gold", F.coalesce(F.try_element_at(to, F.col("table_id")), "table_id")).filter("gold is not null and gold != ''")
    return rows.join(catalog.select(F.col("table_id").cast("string").alias("gold")), "gold", "left_semi").select("claim_id", "gold", F.when(F.col("status") == "exact", "high").otherwise("low").alias("confidence"))


def merge_golden(first: DataFrame, second: DataFrame | None, mapping: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(claims with a sentence, rows without, mapping rows of unknown claims)."""
    rows = first if second is None else first.unionByName(second, allowMissingColumns=True)
    full = F.trim(F.coalesce("sentence", F.lit(""))) != ""
    good = rows.filter(full)
    return good, rows.filter(~full), mapping.join(good.select("claim_id"), "claim_id", "left_anti")


def derive_verdict(status: Column, known: dict[str, str], auto: str = "auto", most: float = 2.0) -> Column:
    """A status's verdict; for automatic ones by the error percentage in its text, 2.0 or less being a match."""
    error = F.regexp_extract(status, r"([0-9]+(?:\.[0-9]+)?)\s*%", 1).try_cast("double")
    direct = F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), status)
    return F.coalesce(direct, F.when(F.contains(status, F.lit(auto)) & error.isNotNull(), F.when(error <= most, "match").otherwise("mismatch")))


def best_ranks(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """(claim_id, rank): the best rank of any gold table (claim_id, gold) in ranked (claim_id, table_id, rank); null if none."""
    return gold.join(ranked, (gold["claim_id"] == ranked["claim_id"]) & (gold["gold"] == ranked["table_id"]), "left").groupBy(gold["claim_id"]).agg(F.min("rank").alias("rank"))


def rank_metrics(ranked: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """One row: n, recall at each k, mean reciprocal rank."""
    r = best_ranks(ranked, gold)
    return r.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))), 6).alias(f"recall_{k}") for k in ks], F.round(F.avg(F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


def split_golds(gold: DataFrame) -> DataFrame:
    """One row for each of the comma-separated golds."""
    return gold.select("claim_id", F.explode(F.split("gold", ",")).alias("gold")).withColumn("gold", F.trim("gold")).filter("gold != ''")


def vocab_gap(claims: DataFrame, tables: DataFrame, least: int = 2) -> DataFrame:
    """(claim_id, hit, unmatched): whether the gold table was found, and the claim's words that its text lacks."""
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.col("sentence"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), lambda w: F.length(w) >= least))
    rows = claims.join(tables.select("table_id", "text"), "table_id", "left")
    return rows.select("claim_id", "hit", F.filter(words, lambda w: ~F.contains(F.coalesce("text", F.lit("")), w)).alias("unmatched"))


def crosstab(gaps: DataFrame) -> DataFrame:
    """(has_gap, hits, misses)."""
    return gaps.groupBy((F.size("unmatched") > 0).alias("has_gap")).agg(F.sum(F.col("hit").cast("long")).alias("hits"), F.sum((~F.col("hit")).cast("long")).alias("misses"))


def build_query(fields: list[str], kinds: dict[str, str], kind: str) -> Column:
    """The claim's fields that aren't blank, joined by spaces, with its kind's word behind."""
    word = F.try_element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col(kind))
    return F.concat_ws(" ", *[F.when(F.trim(F.col(f)) != "", F.trim(F.col(f))) for f in fields], word)


def summarize(results: DataFrame) -> DataFrame:
    """(system, n, top1, mrr, latency): printed figures of each system from (system, rank, ms)."""
    share = F.avg(F.coalesce((F.col("rank") == 1).cast("double"), F.lit(0.0)))
    return results.groupBy("system").agg(F.count(F.lit(1)).alias("n"), F.concat(F.format_number(share * 100, 1), F.lit("%")).alias("top1"), F.format_number(F.avg(F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0))), 3).alias("mrr"), F.format_number(F.avg("ms"), 1).alias("latency"))


def version_diff(a: DataFrame, b: DataFrame, missing: int = 99) -> DataFrame:
    """(claim_id, change): improved, worse or same from a to b, a missing rank counting as 99."""
    ra, rb = F.coalesce("ra", F.lit(missing)), F.coalesce("rb", F.lit(missing))
    rows = a.select("claim_id", F.col("rank").alias("ra")).join(b.select("claim_id", F.col("rank").alias("rb")), "claim_id")
    return rows.select("claim_id", F.when(rb < ra, "improved").when(rb > ra, "worse").otherwise("same").alias("change"))


def ablation(systems: dict[str, DataFrame], gold: DataFrame) -> DataFrame:
    """rank_metrics of each system's ranking, by name."""
    out = None
    for name, ranked in systems.items():
        one = rank_metrics(ranked, gold).withColumn("system", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def extract_recall(gold: DataFrame, extracted: DataFrame) -> DataFrame:
    """(article_id, gold_id, claim_id): the first extracted claim that holds or lies in the gold sentence, spaces aside; else null."""
    g = gold.select("article_id", "gold_id", no_space(F.col("sentence")).alias("g"))
    x = extracted.select(F.col("article_id").alias("_a"), "claim_id", "pos", no_space(F.col("sentence")).alias("x")).filter("x != ''")
    hit = (F.col("article_id") == F.col("_a")) & (F.contains("g", "x") | F.contains("x", "g"))
    return g.join(x, hit, "left").groupBy("article_id", "gold_id").agg(F.min(F.when(F.col("claim_id").isNotNull(), F.struct("pos", "claim_id"))).alias("m")).select("article_id", "gold_id", "m.claim_id")


def rematch_numbers(missed: DataFrame, extracted: DataFrame) -> DataFrame:
    """(article_id, gold_id, claim_id): missed gold sentences matched one to one, in order, with the first unused extracted
    claim that shares a number of two digits or more. Greedy and so sequential: one pass over each article's rows, in order,
    through an index of their numbers."""
    numbers = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(F.regexp_replace(c, ",", ""), F.lit(r"([0-9]+(?:\.[0-9]+)?)"), F.lit(1)), lambda x: F.length(x) >= 2))
    g = missed.select("article_id", F.lit(0).alias("kind"), F.col("gold_id").alias("id"), F.col("gold_id").alias("pos"), numbers(F.col("sentence")).alias("n"))
    x = extracted.select("article_id", F.lit(1).alias("kind"), F.col("claim_id").alias("id"), F.col("pos").cast("long").alias("pos"), numbers(F.col("sentence")).alias("n"))

    def greedy(batches):
        # rows come by article, gold sentences first: one pass, an article in memory at a time
        article, golds, free = None, [], []

        def match():
            # by number the claims that have it, in order, and how many of the first are used: each claim is passed once
            having, past, used, out = {}, {}, set(), []
            for k, (_, n) in enumerate(free):
                for x in n:
                    having.setdefault(x, []).append(k)
            for i, n in golds:
                first = None
                for x in n:
                    own, at = having.get(x, ()), past.get(x, 0)
                    while at < len(own) and own[at] in used:
                        at += 1
                    past[x] = at
                    if at < len(own) and (first is None or own[at] < first):
                        first = own[at]
                if first is not None:
                    used.add(first)
                    out.append((article, i, free[first][0]))
            return out

        for pdf in batches:
            out = []
            for a, kind, i, n in zip(pdf["article_id"], pdf["kind"], pdf["id"], pdf["n"]):
                if a != article:
                    out += match()
                    article, golds, free = a, [], []
                (free if kind else golds).append((i, set(n)))
            yield pd.DataFrame(out, columns=["article_id", "gold_id", "claim_id"])
        yield pd.DataFrame(match(), columns=["article_id", "gold_id", "claim_id"])

    # only articles that miss something are passed on
    both = g.unionByName(x.join(g.select("article_id").distinct(), "article_id", "left_semi"))
    return both.repartition("article_id").sortWithinPartitions("article_id", "kind", "pos", "id").mapInPandas(greedy, "article_id long, gold_id long, claim_id long")


def extract_report(recall: DataFrame, rematched: DataFrame, extracted: DataFrame) -> DataFrame:
    """One row: gold, found, found after rematching, recall raw and adjusted, and precision with extra claims that have a digit counted as right."""
    r = recall.join(rematched.select("gold_id", F.col("claim_id").alias("again")), "gold_id", "left").agg(F.count(F.lit(1)).alias("gold"), F.count("claim_id").alias("found"), F.count(F.coalesce("claim_id", "again")).alias("adjusted"))
    p = extracted.agg(F.count(F.lit(1)).alias("extracted"), F.sum(F.col("sentence").rlike("[0-9]").cast("long")).alias("right"))
    return r.crossJoin(p).select("gold", "found", "adjusted", F.round(F.col("found") / F.col("gold"), 4).alias("recall"), F.round(F.col("adjusted") / F.col("gold"), 4).alias("adjusted_recall"), F.round(F.col("right") / F.col("extracted"), 4).alias("precision"))


def bare_url(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), "/+$", "")


def classifier_eval(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """(url, label, predicted, right): an article is positive if any of its gold rows has a claim; urls without end slashes."""
    g = gold.groupBy(bare_url(F.col("url")).alias("url")).agg(F.bool_or(F.col("claim").isNotNull()).alias("label"))
    return g.join(predictions.select(bare_url(F.col("url")).alias("url"), "predicted"), "url").withColumn("right", F.col("label") == F.col("predicted"))


def proxy_quality(claims: DataFrame, fields: list[str], types: tuple[str, ...]) -> DataFrame:
    """(system, numeric, filled, typed): shares of claims with a digit, of filled fields, and of known types."""
    filled = sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0)) / len(fields)
    return claims.groupBy("system").agg(F.round(F.avg(F.col("sentence").rlike("[0-9]").cast("int")), 4).alias("numeric"), F.round(F.avg(filled), 4).alias("filled"), F.round(F.avg(F.coalesce(F.col("claim_type").isin(*types), F.lit(False)).cast("int")), 4).alias("typed"))


def official_value(text: Column, unit: Column) -> Column:
    """The number in a free-text cell; of several parts between slashes the first that names the unit, else the first with a number."""
    parts = F.split(text, "/")
    by_unit = F.get(F.filter(parts, lambda x: F.contains(x, unit) & x.rlike("[0-9]")), 0)
    part = F.coalesce(by_unit, F.get(F.filter(parts, lambda x: x.rlike("[0-9]")), 0))
    return F.regexp_replace(F.regexp_extract(part, r"(-?[0-9][0-9,]*(?:\.[0-9]+)?)", 1), ",", "").try_cast("double")


def verdict_eval(claims: DataFrame, mapping: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(claim_id, official, predicted, gold, right) for claims whose official value can be read; another name of undecidable counts as it."""
    from .verdict import rule_verdict

    rows = claims.join(mapping, "claim_id").join(verdicts, "claim_id").withColumn("computed_value", official_value(F.col("cell"), F.col("claim_unit"))).filter("computed_value is not null")
    judged = rule_verdict(rows.withColumns({"computed_unit": F.col("claim_unit"), "computed_period": F.col("claim_period"), "calc_type": F.when(F.col("claim_type") == "rate", "rate").otherwise("lookup")}))
    predicted = F.coalesce("verdict", F.when(F.col("gap") > 5 * F.col("tolerance"), "mismatch").otherwise("undecidable"))
    gold = F.when(F.col("gold") == "unconfirmed", "undecidable").otherwise(F.col("gold"))
    return judged.select("claim_id", F.col("computed_value").alias("official"), predicted.alias("predicted"), gold.alias("gold"), (predicted == gold).alias("right"))


def gold_articles(articles: DataFrame, gold: DataFrame, known_bad: DataFrame) -> DataFrame:
    """(url, n_gold, sentences): articles of the gold set with its sentences in order; those of known_bad (url) left out."""
    g = gold.groupBy(bare_url(F.col("url")).alias("url")).agg(F.array_sort(F.collect_list(F.struct("gold_id", "sentence"))).alias("s"))
    rows = articles.select(bare_url(F.col("url")).alias("url")).distinct().join(g, "url").join(known_bad.select(bare_url(F.col("url")).alias("url")), "url", "left_anti")
    return rows.select("url", F.size("s").alias("n_gold"), F.transform("s", lambda x: x.sentence).alias("sentences"))


def gold_integrity(sets: dict[str, DataFrame]) -> DataFrame:
    """(a, b, ids_a, missing): for each ordered pair of sets the ids of a, and how many of them b lacks."""
    out = None
    for a, da in sets.items():
        for b, db in sets.items():
            if a != b:
                ids = da.select("claim_id").distinct()
                one = ids.join(db.select("claim_id").distinct().withColumn("_in", F.lit(True)), "claim_id", "left").agg(F.count(F.lit(1)).alias("ids_a"), F.sum(F.col("_in").isNull().cast("long")).alias("missing")).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "ids_a", "missing")
                out = one if out is None else out.unionByName(one)
    return out


def confusion(df: DataFrame) -> DataFrame:
    """One row: n, accuracy, false positives, false negatives, and scores from 0.4 to 0.6."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("gold") == F.col("predicted")).cast("int")), 6).alias("accuracy"), F.sum((~F.col("gold") & F.col("predicted")).cast("long")).alias("false_positives"), F.sum((F.col("gold") & ~F.col("predicted")).cast("long")).alias("false_negatives"), F.sum(F.col("score").between(0.4, 0.6).cast("long")).alias("ambiguous"))
