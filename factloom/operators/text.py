"""Text preparation: cleaning scraped articles, sentences, numeric candidates, chunks, replies of a model.

Throughout: a null text gives no sentences and stays null where a text is returned; ids are carried as they are.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.locale import BLANK, Pack
from factloom.session import ship

from . import repeats


def no_space(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", "")


def no_space_or_dot(c: Column) -> Column:
    return F.regexp_replace(c, r"[\s·]+", "")


def straight_quotes(c: Column) -> Column:
    return F.translate(c, "“”‘’", "\"\"''")


def clean_articles(df: DataFrame, pack: Pack, anchor: int = 12, most: int = 3000) -> DataFrame:
    """text from the title's first characters on, cut to `most`; a newline after the title; first byline and junk gone."""
    quoted, title = straight_quotes(F.col("text")), straight_quotes(F.trim("title"))
    at = F.when(F.length(title) > 0, F.position(F.substring(title, 1, anchor), quoted))
    body = F.substring(F.when(at > 0, F.substring(F.col("text"), at, F.length("text"))).otherwise(F.col("text")), 1, most)
    titled = F.when(F.startswith(straight_quotes(body), title) & (F.length(title) > 0), F.concat(F.substring(body, F.lit(1), F.length(title)), F.lit("\n"), F.ltrim(F.substring(body, F.length(title) + 1, F.length(body))))).otherwise(body)
    no_byline = F.regexp_replace(titled, f"(?s)^(.*?)(?:{pack.byline})", "$1")
    return df.withColumn("text", F.trim(F.get(F.split(no_byline, pack.junk, 2), 0)))


def clean_body(df: DataFrame, pack: Pack, least: int = 50) -> DataFrame:
    """text after the byline, to the first stop marker; the text itself where 50 characters or fewer are left."""
    rest = F.regexp_replace("text", f"(?s)^.*?(?:{pack.byline})", "")
    at = F.array_min(F.filter(F.array(*[F.locate(s, rest) for s in pack.stops]), lambda x: x > 0))
    cut = F.trim(F.when(at.isNotNull(), F.substring(rest, F.lit(1), at - 1)).otherwise(rest))
    return df.withColumn("text", F.when(F.length(cut) > least, cut).otherwise(F.col("text")))


def shown_text(df: DataFrame, pack: Pack, together: int = 3) -> DataFrame:
    """(article_id, text): what a reader is shown of a scraped article; the article itself stays as it is.

    What follows the trailer goes, players' texts become a space, and what stands before the last dateline goes with it. Of
    adjacent equal blocks one stays. A text without line breaks is put in paragraphs of three sentences; a sentence ends where
    a space that no digit follows comes after a stop.
    """
    ship(df.sparkSession)
    body = F.regexp_replace(F.get(F.split("text", pack.trailer, 2), 0), pack.widget, " ")
    body = F.regexp_replace(body, rf"(?s)\A.*{pack.dateline}", "")
    shown = F.regexp_replace(F.regexp_replace(collapse_repeats(body), rf"\A{BLANK}+", ""), rf"{BLANK}+\z", "")
    rows = df.select("article_id", shown.alias("t"))
    said = F.split("t", rf"(?<=[.?!]){BLANK}+(?=[^0-9])")
    grouped = F.transform(F.sequence(F.lit(0), F.floor((F.size("s") - 1) / together).cast("int")), lambda i: F.array_join(F.slice("s", i * together + 1, together), " "))
    text = F.when(F.contains("t", F.lit("\n")) | (F.size("s") <= 1), F.col("t")).otherwise(F.array_join(grouped, "\n\n"))
    return rows.withColumn("s", said).select("article_id", text.alias("text"))


def display_text(df: DataFrame, pack: Pack) -> DataFrame:
    """(article_id, paragraph, text): the paragraphs of shown_text(); a null text has none."""
    return shown_text(df, pack).select("article_id", F.posexplode(F.split("text", r"\n{2,}")).alias("paragraph", "text"))


def collapse_repeats(text: Column, least: int = 20, most: int = 300) -> Column:
    """The text with one of adjacent equal blocks of `least` to `most` characters left, from the start on, longest blocks first."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: repeats.collapse(t, least, most), na_action="ignore")

    return run(text)


def sentences(df: DataFrame, pack: Pack) -> DataFrame:
    """(article_id, pos, sentence): trimmed, blanks dropped, pos as split."""
    parts = df.select("article_id", F.posexplode(F.split("text", pack.sentence_end + r"\s+")).alias("pos", "s"))
    return parts.select("article_id", "pos", F.trim(F.regexp_replace("s", r"^\s+|\s+$", "")).alias("sentence")).filter("sentence != ''")


def dedupe_sentences(df: DataFrame, pack: Pack, least: int = 30) -> DataFrame:
    """(article_id, text): sentences of `least` visible characters or more stay where they come first; joined by spaces.

    A row for each row of df that has a sentence. All happens within the row: sentences are sorted by two hashes and place,
    so that the first of equal ones is the one with another before it; nothing is shuffled.
    """
    said = F.filter(F.transform(F.split("text", pack.sentence_end + r"\s+"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    norm = lambda x: F.when(F.length(no_space(x)) >= least, no_space(x))
    rows = df.select("article_id", said.alias("s")).filter(F.size("s") > 0)
    mark = lambda x, i: F.struct(F.when(norm(x).isNotNull(), F.xxhash64(norm(x))).alias("a"), F.when(norm(x).isNotNull(), F.xxhash64(F.lit("second"), norm(x))).alias("b"), i.alias("i"))
    rows = rows.withColumn("m", F.array_sort(F.transform("s", mark)))
    before = lambda k: F.get(F.col("m"), k - 1)
    first = F.filter("m", lambda x, k: x.a.isNull() | (k == 0) | ~(before(k)["a"].eqNullSafe(x.a) & before(k)["b"].eqNullSafe(x.b)))
    rows = rows.select("article_id", "s", F.array_sort(F.transform(first, lambda x: x.i)).alias("kept"))
    return rows.select("article_id", F.array_join(F.transform("kept", lambda i: F.get("s", i)), " ").alias("text"))


def numeric_candidates(df: DataFrame, pack: Pack) -> DataFrame:
    """(article_id, pos, sentence, expressions): sentences with an expression worth checking, and how many claims they make.

    A historical extreme beside a value only describes it, so it counts as one claim only where nothing else counts.
    """
    s = sentences(df, pack).filter(F.col("sentence").rlike(pack.include))
    counted = F.regexp_count("sentence", F.lit(pack.counted)).cast("long")
    return s.withColumn("expressions", F.when((counted == 0) & F.col("sentence").rlike(pack.extreme), F.lit(1).cast("long")).otherwise(counted))


def missed(cands: DataFrame, claims: DataFrame) -> DataFrame:
    """Candidates with fewer claims of their article inside them than they have expressions; plus covered."""
    c = claims.select(F.col("article_id").alias("_a"), no_space(F.col("sentence")).alias("_s")).filter("_s != ''")
    hit = (F.col("article_id") == F.col("_a")) & (F.contains(no_space(F.col("sentence")), F.col("_s")) | F.contains(F.col("_s"), no_space(F.col("sentence"))))
    found = cands.join(c, hit, "left").groupBy("article_id", "pos", "sentence", "expressions").agg(F.count("_s").alias("covered"))
    return found.filter("covered < expressions")


def chunks(df: DataFrame, size: int = 3000, ends: str = ".") -> DataFrame:
    """(article_id, chunk, text): up to `size` characters, ending at the last sentence end of the second half if any.

    Where a chunk ends depends on where the last one did, so a fold over possible numbers of chunks carries the position.
    """
    step = f"""aggregate(sequence(1, cast(ceil(length(text) / {size / 2}) as int) + 1), cast(array() as array<struct<a:int,b:int>>), (acc, i) ->
      case when coalesce(try_element_at(acc, -1).b, 0) >= length(text) then acc else concat(acc, array(named_struct('a', coalesce(try_element_at(acc, -1).b, 0), 'b',
        case when length(text) - coalesce(try_element_at(acc, -1).b, 0) <= {size} then length(text)
             when locate('{ends}', reverse(substring(text, coalesce(try_element_at(acc, -1).b, 0) + {size // 2} + 1, {size // 2}))) > 0
             then coalesce(try_element_at(acc, -1).b, 0) + {size} + 1 - locate('{ends}', reverse(substring(text, coalesce(try_element_at(acc, -1).b, 0) + {size // 2} + 1, {size // 2})))
             else coalesce(try_element_at(acc, -1).b, 0) + {size} end))) end)"""
    cut = df.filter("length(text) > 0").select("article_id", "text", F.posexplode(F.expr(step)).alias("chunk", "c"))
    return cut.select("article_id", "chunk", F.expr("substring(text, c.a + 1, c.b - c.a)").alias("text"))


def batches(missed_rows: DataFrame, size: int = 3) -> DataFrame:
    """missed_rows plus batch: runs of `size` in each article, by position."""
    return missed_rows.withColumn("batch", F.floor((F.row_number().over(W.partitionBy("article_id").orderBy("pos")) - 1) / size))


#: Korean scale words and what they stand for.
BIG = {"조": 10**12, "억": 10**8, "만": 10**4}
SMALL = {"천": 1000, "백": 100}
_NUM = r"[0-9][0-9,]*(?:\.[0-9]+)?"
_THOUSANDS, _HUNDREDS = rf"{_NUM}\s*천", rf"{_NUM}\s*백"
#: One group of a number: digits, or thousands and hundreds in words, and the scale that lifts them.
_GROUP = rf"(?:{_THOUSANDS}(?:\s*{_HUNDREDS})?|{_HUNDREDS}|{_NUM})(?:\s*[조억만])?"


def numbers_column(c: Column) -> Column:
    """array<struct<value,start,end>>: the numbers of a text, with scale words.

    The text is cut into groups and what stands between them. Groups with nothing but space between them are one number as
    long as they fall: a group with a scale joins if the scale is below the last one's, a bare one if its value is, and ends it.
    """
    amount = lambda g, pattern: F.regexp_replace(F.nullif(F.regexp_extract(g, pattern, 1), F.lit("")), ",", "").cast("double")
    named = lambda words, x: F.coalesce(*[F.when(x == w, F.lit(float(n))) for w, n in words.items()])

    def group(g: Column, at: Column) -> Column:
        words = [amount(g, rf"({_NUM})\s*{w}") * n for w, n in SMALL.items()]
        value = F.when(F.coalesce(*words).isNotNull(), sum(F.coalesce(w, F.lit(0.0)) for w in words)).otherwise(amount(g, rf"^({_NUM})"))
        scale = named(BIG, F.right(g, F.lit(1)))
        return F.struct((value * F.coalesce(scale, F.lit(1.0))).alias("value"), at.alias("start"), (at + F.length(g)).alias("end"), scale.alias("scale"))

    def step(acc: Column, x: Column) -> Column:
        last, g = F.try_element_at(acc["out"], F.lit(-1)), group(x, acc["at"])
        joins = F.coalesce(acc["close"] & (F.coalesce(g["scale"], g["value"]) < last["scale"]), F.lit(False))
        longer = F.struct((last["value"] + g["value"]).alias("value"), last["start"].alias("start"), g["end"].alias("end"), g["scale"].alias("scale"))
        out = F.when(joins, F.concat(F.slice(acc["out"], 1, F.greatest(F.size(acc["out"]) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(acc["out"], F.array(g)))
        digit = x.rlike("^[0-9]")
        return F.struct((acc["at"] + F.length(x)).alias("at"), F.when(digit, True).otherwise(acc["close"] & x.rlike(r"^\s*$")).alias("close"), F.when(digit, out).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("close"), F.array().cast("array<struct<value:double,start:int,end:int,scale:double>>").alias("out"))
    pieces = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(rf"{_GROUP}|[^0-9]+"), F.lit(0))
    return F.aggregate(pieces, start, step, lambda acc: F.transform(acc["out"], lambda x: F.struct(x.value.alias("value"), x.start.alias("start"), x.end.alias("end"))))


def claim_value(df: DataFrame, pack: Pack) -> DataFrame:
    """df plus claim_value: the given value, else the number right before the unit, else the last that is no duration.

    A number is a duration or an age by the word right after it, unless that word is the unit; ranges of ages give no
    numbers. A decrease, by the operator or, where none is given, in a rate's words, makes a positive value negative.
    """
    said = F.col("sentence")
    if pack.age_range:
        said = F.regexp_replace(said, pack.age_range, "·")
    numbers = F.transform(numbers_column(said), lambda x: F.struct(x.value.alias("value"), F.substring(said, x.end + 1, F.length(said)).alias("rest")))
    by_unit = F.get(F.filter("_n", lambda x: F.startswith(F.ltrim(x.rest), F.nullif(F.col("unit"), F.lit("")))), 0).value
    marker = lambda x: F.nullif(F.regexp_extract(x.rest, pack.durations, 1), F.lit(""))
    last = F.try_element_at(F.filter("_n", lambda x: marker(x).isNull() | marker(x).eqNullSafe(F.col("unit"))), F.lit(-1)).value
    value = F.coalesce(F.col("value"), by_unit, last)
    falls = (F.col("comparison_operator") == "decrease") | F.col("comparison_operator").isNull() & (F.col("claim_type") == "rate") & F.col("sentence").rlike(pack.decrease)
    return df.withColumn("_n", numbers).withColumn("claim_value", F.when((value > 0) & F.coalesce(falls, F.lit(False)), -value).otherwise(value)).drop("_n")


def number_variants(value: Column) -> Column:
    """array<string>: a whole number as printed plainly, with commas, and with 조, 억, 만."""
    n = value.cast("bigint")
    jo, eok, man, rest = F.floor(n / 10**12), F.floor(n % 10**12 / 10**8), F.floor(n % 10**8 / 10**4), n % 10**4
    scaled = F.concat(*[F.when(x > 0, F.concat(x.cast("string"), F.lit(w))).otherwise(F.lit("")) for x, w in ((jo, "조"), (eok, "억"), (man, "만"), (rest, ""))])
    return F.when(value.isNotNull(), F.array_distinct(F.array(n.cast("string"), F.format_number(n, 0), scaled)))


def strip_title(df: DataFrame) -> DataFrame:
    """sentence without the article's title in front of it."""
    starts = F.startswith("sentence", "title") & (F.length("title") > 0)
    return df.withColumn("sentence", F.when(starts, F.ltrim(F.substring(F.col("sentence"), F.length("title") + 1, F.length("sentence")))).otherwise(F.col("sentence")))


REPLY = "array<struct<sentence:string,claim_type:string,value:string,unit:string>>"


def salvage(text: str) -> list[dict]:
    """Whole objects of an array that may be cut off."""
    out, at, decode = [], text.find("["), json.JSONDecoder(strict=False)
    at = max(at, 0)
    while (at := text.find("{", at)) >= 0:
        try:
            got, at = decode.raw_decode(text, at)
        except ValueError:
            at += 1
            continue
        if isinstance(got, dict):
            out.append({k: None if got.get(k) is None else str(got[k]) for k in ("sentence", "claim_type", "value", "unit")})
    return out


def parse_replies(replies: DataFrame, types: tuple[str, ...] = ("level", "rate", "compare", "forecast")) -> DataFrame:
    """(article_id, chunk_no, pos, sentence, claim_type, value, unit, error) from (article_id, chunk_no, reply).

    The array is located inside the reply and curly quotes are made straight; where it can't be parsed, whole objects are
    saved one by one, and only there Python runs. Rows of no known type go; a reply without any object is an error row.
    """
    text = straight_quotes(F.col("reply"))
    got = replies.withColumn("_t", F.regexp_extract(text, r"(?s)\[.*\]", 0)).withColumn("_a", F.from_json("_t", REPLY))

    @F.pandas_udf(REPLY)
    def save(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: salvage(t) if t else [])

    whole = F.col("_a").isNotNull() & F.forall("_a", lambda x: x.sentence.isNotNull() | x.claim_type.isNotNull())
    ok = got.filter(whole).select("article_id", "chunk_no", F.posexplode_outer("_a").alias("pos", "c"))
    cut = got.filter(~F.coalesce(whole, F.lit(False))).select("article_id", "chunk_no", F.posexplode_outer(save(text)).alias("pos", "c"))
    rows = ok.unionByName(cut).select("article_id", "chunk_no", "pos", "c.*", F.col("c").isNull().alias("error"))
    return rows.filter(F.col("error") | F.col("claim_type").isin(*types))


def coerce_claims(df: DataFrame, pack: Pack, types: tuple[str, ...] = ("level", "rate", "compare", "forecast")) -> DataFrame:
    """claim_type in the list or null; operator by synonym or null; value as a number; source_org the first that isn't blank."""
    synonyms = F.create_map(*[F.lit(x) for kv in pack.operators.items() for x in kv])
    org = F.get(F.filter("source_orgs", lambda x: F.trim(x) != ""), 0)
    return df.withColumns({"claim_type": F.when(F.col("claim_type").isin(*types), F.col("claim_type")), "comparison_operator": F.try_element_at(synonyms, F.col("comparison_operator")), "value": F.expr("try_cast(replace(value, ',', '') as double)"), "source_org": org}).drop("source_orgs")


def guard_labels(labels: DataFrame, cands: DataFrame, pack: Pack) -> DataFrame:
    """A positive label needs statistical words in its reason and a candidate in its text; else false, score at most 0.15."""
    has = cands.select(F.col("article_id").alias("_a")).distinct()
    rows = labels.join(has, F.col("article_id") == F.col("_a"), "left")
    ok = F.col("reason").rlike(pack.vocabulary) & F.col("_a").isNotNull()
    bad = F.col("label") & ~F.coalesce(ok, F.lit(False))
    return rows.withColumns({"score": F.when(bad, F.least("score", F.lit(0.15))).otherwise(F.col("score")), "label": F.col("label") & ~bad}).drop("_a")
