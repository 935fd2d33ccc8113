"""Names to codes, slots of a query, series starts and age bands.

Reference tables of names and codes are joined by table id, so a claim meets only the names of its own table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.locale import Pack


def match_by_name(claims: DataFrame, names: DataFrame, fields: list[str], axis: list[str] | None = None) -> DataFrame:
    """(claim_id, *axis, code, name): for each claim the best name of its table.

    Fields count in order; in a field an exact name comes first, then the longest name inside it or around it, then the
    smaller ord. claims: claim_id, table_id and the fields. names: table_id, code, name, ord and the axis columns.
    """
    axis = axis or []
    texts = claims.select("claim_id", "table_id", F.posexplode(F.array(*[F.col(f) for f in fields])).alias("field", "t")).filter("t is not null and t != ''")
    hit = F.contains("t", "name") | F.contains("name", "t")
    pairs = texts.join(names, "table_id").filter(hit)
    best = F.min(F.struct("field", (F.col("t") != F.col("name")).alias("far"), (-F.length("name")).alias("n"), "ord", "code", "name")).alias("b")
    return pairs.groupBy("claim_id", *axis).agg(best).select("claim_id", *axis, "b.code", "b.name")


def select_dims(claims: DataFrame, dim_codes: DataFrame, filled: DataFrame, fields: list[str]) -> DataFrame:
    """(claim_id, slots map<axis, code>): names matched on the axes that aren't filled yet."""
    got = match_by_name(claims, dim_codes, fields, ["axis"]).join(filled, ["claim_id", "axis"], "left_anti")
    return got.groupBy("claim_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("axis", "code")))).alias("slots"))


def dim_hints(claims: DataFrame, dim_codes: DataFrame, question: str) -> DataFrame:
    """(claim_id, axis, label): for each axis of the claim's table the longest label inside the question, spaces aside."""
    texts = claims.select("claim_id", "table_id", F.regexp_replace(question, r"\s+", "").alias("q"))
    pairs = texts.join(dim_codes.select("table_id", "axis", "name"), "table_id").filter(F.contains("q", "name"))
    return pairs.groupBy("claim_id", "axis").agg(F.min(F.struct((-F.length("name")).alias("n"), "name")).alias("b")).select("claim_id", "axis", F.col("b.name").alias("label"))


def demo_hints(text: Column, words: list[tuple[str, str, str]]) -> Column:
    """map<axis, label> from (word, axis, label) in order; a later word overrides an earlier one."""
    last: dict[str, Column] = {}
    for word, axis, label in words:
        last[axis] = F.when(F.contains(text, F.lit(word)), F.lit(label)).otherwise(last.get(axis, F.lit(None).cast("string")))
    full = F.create_map(*[x for axis, label in last.items() for x in (F.lit(axis), label)])
    return F.map_filter(full, lambda _, v: v.isNotNull())


def ground_hints(suggestions: DataFrame, dim_codes: DataFrame, pack: Pack) -> DataFrame:
    """Suggestions whose label is a real code of the axis and no total, and whose quote occurs in the question."""
    real = dim_codes.filter(~F.col("name").isin(*pack.total_labels)).select("table_id", "axis", F.col("name").alias("label"), "code")
    return suggestions.filter(F.contains(F.regexp_replace("question", r"\s+", ""), F.regexp_replace("quote", r"\s+", ""))).join(real, ["table_id", "axis", "label"])


def build_slots(requests: DataFrame, params: DataFrame) -> DataFrame:
    """(claim_id, slots): for each axis of the table the given slot or its default; null slots where the table is unknown.

    requests: claim_id, table_id, slots map. params: table_id, axis, default_value.
    """
    rows = requests.join(params, "table_id", "left")
    value = F.coalesce(F.try_element_at("slots", F.col("axis")), "default_value")
    return rows.groupBy("claim_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("axis").isNotNull(), F.struct("axis", value.alias("v")))))).alias("m")).select("claim_id", F.when(F.size("m") > 0, F.col("m")).alias("slots"))


def dynamic_slots(claims: DataFrame, dim_codes: DataFrame, mapped: DataFrame, fields: list[str]) -> DataFrame:
    """(claim_id, axis, code): the strictly mapped code, else the matched name's, else ALL, for every axis of the table."""
    axes = dim_codes.select("table_id", "axis").distinct()
    named = match_by_name(claims, dim_codes, fields, ["axis"]).select("claim_id", "axis", F.col("code").alias("named"))
    rows = claims.select("claim_id", "table_id").join(axes, "table_id").join(mapped.select("claim_id", "axis", F.col("code").alias("mapped")), ["claim_id", "axis"], "left").join(named, ["claim_id", "axis"], "left")
    return rows.select("claim_id", "axis", F.coalesce("mapped", "named", F.lit("ALL")).alias("code"))


def encode_dims(slots: DataFrame, dim_codes: DataFrame) -> DataFrame:
    """slots (claim_id, table_id, axis, label) plus code; unknown labels pass through."""
    codes = dim_codes.select("table_id", "axis", F.col("name").alias("label"), "code")
    return slots.join(codes, ["table_id", "axis", "label"], "left").withColumn("code", F.coalesce("code", "label"))


def missing_slots(requests: DataFrame, catalog: DataFrame, priority: list[str]) -> DataFrame:
    """(claim_id, missing array, ask): required slots of the table that are null, and the first of them by priority."""
    need = catalog.select("table_id", "required_slots")
    rows = requests.join(need, "table_id", "left")
    gone = F.filter(F.coalesce("required_slots", F.array().cast("array<string>")), lambda s: F.try_element_at("slots", s).isNull())
    ask = F.get(F.filter(F.array(*map(F.lit, priority)), lambda p: F.array_contains("missing", p)), 0)
    return rows.select("claim_id", F.array_sort(gone).alias("missing")).withColumn("ask", ask)


def needs_region(dim_codes: DataFrame, defaults: DataFrame, axis: str, pack: Pack) -> DataFrame:
    """(table_id, needs): whether the axis has several codes and no nationwide default."""
    codes = dim_codes.filter(F.col("axis") == axis).join(defaults.select("table_id", F.col("default_value").alias("_d")), "table_id", "left")
    national = F.max(F.coalesce((F.col("name") == pack.national) & (F.col("code") == F.col("_d")), F.lit(False)))
    return codes.groupBy("table_id").agg(F.count_distinct("code").alias("n"), national.alias("has")).select("table_id", ((F.col("n") > 1) & ~F.col("has")).alias("needs"))


def granularity(text: Column, pack: Pack) -> Column:
    """'Q' where a quarter word occurs, else 'M' where a month word does, else null."""
    found = lambda words: F.greatest(*[F.contains(text, F.lit(w)) for w in (*words, words[0])])
    return F.when(found(pack.quarter_words), "Q").when(found(pack.month_words), "M")


def choose_freq(wanted: Column, supported: Column) -> Column:
    """The wanted frequency if supported, else Y, else the first that is supported."""
    return F.when(F.array_contains(supported, wanted), wanted).when(F.array_contains(supported, "Y"), "Y").otherwise(F.get(supported, 0))


def ground_region(region: Column, text: Column) -> Column:
    """The region if the text has it, spaces aside; else null."""
    return F.when(F.contains(F.regexp_replace(text, r"\s+", ""), F.regexp_replace(region, r"\s+", "")), region)


def merge_turns(turns: DataFrame, slots: list[str], key: str = "conv_id", order: str = "turn") -> DataFrame:
    """turns with each slot filled from the first turn that gave it, up to the present one."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return turns.withColumns({s: F.first(s, ignorenulls=True).over(w) for s in slots})


def series_start(sentence: Column, article_year: Column, pack: Pack) -> Column:
    """The year that a claim of an extreme counts from: an event's year, N years before the article, 1960 for all time."""
    event = F.regexp_extract(sentence, pack.event_since, 1)
    year = F.lit(None).cast("int")
    for word, y in pack.events.items():
        year = F.coalesce(year, F.when(event == word, F.lit(y)))
    n = F.nullif(F.regexp_extract(sentence, pack.n_years, 1), F.lit("")).cast("int")
    return F.coalesce(year, article_year - n, F.when(sentence.rlike(pack.all_time), F.lit(1960)))


def special_tag(sentence: Column, n_age_codes: Column, pack: Pack) -> Column:
    return F.when(n_age_codes > 1, "multi_age").when(sentence.rlike(pack.event_since), "since_event").when(sentence.rlike(pack.n_years), "n_years").when(sentence.rlike(pack.all_time), "all_time")


def parse_bands(labels: DataFrame) -> DataFrame:
    """(…, lo, hi) from labels like 20~24세 and 100세이상; other labels are left out, hi is null where open."""
    lo = F.regexp_extract("name", r"^(\d+)~(\d+)세$", 1)
    rows = labels.withColumns({"lo": F.when(F.col("name") == "100세이상", 100).when(lo != "", lo.cast("int")), "hi": F.nullif(F.regexp_extract("name", r"^(\d+)~(\d+)세$", 2), F.lit("")).cast("int")})
    return rows.filter("lo is not null")


# What may stand around a decade of age, and what may not.
AGE_AFTER = "후반|초반|중반|이상|미만|인구|실업률|취업률|취업자|근로자|직장인|남성|여성|남자|여자|가구주|세대주"
NOT_AFTER = "기업|은행|국가|기관|대학|도시|종목|그룹|브랜드"
NOT_BEFORE = "전차|차량|트럭|헬기|전투기|버스|컴퓨터|노트북|항공기|탱크|장비"
AGE_GROUPS = [("영유아", 0, 6), ("아동", 0, 17), ("청소년", 9, 24), ("청년", 15, 29), ("중장년", 40, 64), ("고령층", 65, None), ("고령자", 65, None), ("노인", 65, None)]


def decade_codes(claims: DataFrame, bands: DataFrame) -> DataFrame:
    """(claim_id, decade, codes): codes of the five-year bands that a decade of age (20대, 70대 이상) covers.

    Words before and after decide whether it is an age; where they don't, the claim is left out as unresolved.
    claims: claim_id, table_id, sentence. bands: table_id, code, lo, hi.
    """
    s = F.regexp_replace("sentence", r"\s+", "")
    pattern = r"^(.*?)(?<!\d)(\d)0대(이상)?(.{0,6})"
    rows = claims.select("claim_id", "table_id", F.regexp_extract(s, pattern, 2).alias("d"), F.regexp_extract(s, pattern, 3).alias("above"), F.regexp_extract(s, pattern, 4).alias("after"), F.expr("right(regexp_extract(regexp_replace(sentence, '\\\\s+', ''), '^(.*?)(?<!\\\\d)(\\\\d)0대(이상)?(.{0,6})', 1), 6)").alias("before"))
    is_age = ~F.col("after").rlike(NOT_AFTER) & ~F.col("before").rlike(NOT_BEFORE) & (F.col("after").rlike(AGE_AFTER) | F.col("after").rlike("^$|^[는가이을를의도만에과와랑]"))
    rows = rows.filter((F.col("d") != "") & is_age).withColumn("start", F.col("d").cast("int") * 10)
    inside = F.when(F.col("above") != "", F.col("lo") >= F.col("start")).otherwise((F.col("lo") >= F.col("start")) & (F.col("hi") < F.col("start") + 10))
    found = rows.join(bands, "table_id").filter(inside)
    return found.groupBy("claim_id").agg(F.min("start").alias("decade"), F.array_sort(F.collect_set("code")).alias("codes"))


def named_age_codes(claims: DataFrame, labels: DataFrame) -> DataFrame:
    """(claim_id, age_group, codes): an explicit label with the group's name, else the bands within its standard range."""
    spark = claims.sparkSession
    groups = spark.createDataFrame([(i, *g) for i, g in enumerate(AGE_GROUPS)], "ord int, age_group string, glo int, ghi int")
    hit = claims.select("claim_id", "table_id", F.regexp_replace("sentence", r"\s+", "").alias("s")).join(F.broadcast(groups), F.contains("s", "age_group"))
    one = hit.groupBy("claim_id", "table_id").agg(F.min(F.struct("ord", "age_group", "glo", "ghi")).alias("g")).select("claim_id", "table_id", "g.*")
    explicit = one.join(labels, "table_id").filter(F.contains("name", "age_group")).groupBy("claim_id").agg(F.min("code").alias("own"))
    within = (F.col("lo") >= F.col("glo")) & (F.col("ghi").isNull() | (F.coalesce("hi", F.lit(999)) <= F.col("ghi")))
    banded = one.join(parse_bands(labels), "table_id").filter(within).groupBy("claim_id").agg(F.array_sort(F.collect_set("code")).alias("banded"))
    return one.join(explicit, "claim_id", "left").join(banded, "claim_id", "left").select("claim_id", "age_group", F.coalesce(F.when(F.col("own").isNotNull(), F.array("own")), "banded").alias("codes")).filter("codes is not null")
