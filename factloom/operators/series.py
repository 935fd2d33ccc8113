"""An index over the series of official cells that answers what lies between two periods, without reading the series again.

Each cell (table, item, dimension) becomes one row: its periods in order, without gaps, and above them a sparse table, whose level
k holds for every place where the least and where the greatest value of the 2**k places from there on lies, the earliest of ties.
Any stretch is two of them, which may overlap; only where a cell has several units are those of a stretch looked through. Claims that ask the
same of a cell ask once: the questions of a cell are gathered first, distinct, so their number is bounded by its periods, and
answered in the cell's row; a claim then meets the one row of its question in an equi-join.

Periods are YYYY, or YYYY and a month or quarter from 01 to 12, and keep the order that they have as text. Other strings, and
nulls, lie in no stretch. A cell's row grows with its span of periods alone, not with claims or repeated observations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import periods

CELL = ["table_id", "item_id", "dim"]
#: Places of a year: itself, then what lies in it.
PLACES = 13


def position(period: Column) -> Column:
    """The place of a period, in the order of periods as text; null for other strings."""
    well = period.rlike(r"^\d{4}(0[1-9]|1[0-2])?$")
    return F.when(well, periods.year_of(period) * PLACES + F.coalesce(periods.suffix_of(period), F.lit(0)))


def period_at(place: Column) -> Column:
    suffix = F.pmod(place, F.lit(PLACES))
    year = F.floor(place / PLACES)
    return F.when(suffix == 0, periods.make(year)).otherwise(periods.make(year, suffix))


#: What is known of one place: observations, the least and greatest value, the range of units of those that have a value.
_FIELDS = ("n", "lo", "hi", "unit_lo", "unit_hi")


def _better(values: Column, highest: bool, a: Column, b: Column) -> Column:
    """Of two places, a not after b, the one with the better value; -1 is no place, and a tie goes to the earlier."""
    x, y = F.get(values, a), F.get(values, b)
    return F.when(b < 0, a).when(a < 0, b).when(y > x if highest else y < x, b).otherwise(a)


def _levels(values: str, highest: bool) -> Column:
    """The sparse table: of each level and place the place of the best value from there on; -1 where there is none."""
    v = F.col(values)
    ground = F.transform(v, lambda x, i: F.when(x.isNull(), F.lit(-1)).otherwise(i))
    top = F.length(F.bin(F.size(v))) - 1
    steps = F.when(top > 0, F.sequence(F.lit(1), top)).otherwise(F.array().cast("array<int>"))

    def above(acc: Column, k: Column) -> Column:
        last, half = acc["last"], F.pow(F.lit(2), k - 1).cast("int")
        new = F.transform(F.slice(last, F.lit(1), F.size(last) - half), lambda a, i: _better(v, highest, a, F.get(last, i + half)))
        return F.struct(new.alias("last"), F.concat(acc["all"], F.array(new)).alias("all"))

    return F.aggregate(steps, F.struct(ground.alias("last"), F.array(ground).alias("all")), above, lambda acc: acc["all"])


def series_index(obs: DataFrame) -> DataFrame:
    """(cell, first, places, los, his, lo_at, hi_at, unit_lo, unit_hi): a row for each cell of obs (cell, period, value, unit)."""
    held = F.when(F.col("value").isNotNull(), F.col("unit"))
    at = obs.select(*CELL, position(F.col("period")).alias("p"), "value", "unit").groupBy(*CELL, "p")
    at = at.agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.min(held).alias("unit_lo"), F.max(held).alias("unit_hi"))
    rows = at.groupBy(*CELL).agg(F.array_sort(F.collect_list(F.when(F.col("p").isNotNull(), F.struct("p", F.struct(*_FIELDS).alias("e"))))).alias("s"), F.min("unit_lo").alias("unit_lo"), F.max("unit_hi").alias("unit_hi"))

    # gaps are filled with nulls, so a place is found by counting
    gap = lambda x, i: F.coalesce(F.get("s", i + 1)["p"] - x["p"] - 1, F.lit(0))
    nothing = F.when(F.lit(False), F.col("s")[0]["e"])
    dense = F.flatten(F.transform("s", lambda x, i: F.concat(F.array(x["e"]), F.array_repeat(nothing, gap(x, i)))))
    rows = rows.select(*CELL, "unit_lo", "unit_hi", F.get("s", 0)["p"].alias("first"), dense.alias("places"))
    rows = rows.select("*", F.transform("places", lambda x: x["lo"]).alias("los"), F.transform("places", lambda x: x["hi"]).alias("his"))
    return rows.select("*", _levels("los", False).alias("lo_at"), _levels("his", True).alias("hi_at"))


def asked(rows: DataFrame, obs: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """rows (with the cell's columns) plus known, whether obs has the cell, and found, what lies from period lo to hi.

    found is a struct: n (observations, of a single period only), lo, lo_p, hi, hi_p, mixed (units); null if nothing is asked.
    """
    rows = rows.withColumns({"_lo": F.coalesce(position(lo), F.lit(-1)), "_hi": F.coalesce(position(hi), F.lit(-1))})
    questions = rows.select(*CELL, "_lo", "_hi").groupBy(*CELL).agg(F.collect_set(F.struct("_lo", "_hi")).alias("q"))
    answers = _answers(questions, obs).select(*CELL, "known", F.inline("told"))
    return rows.join(answers, [*CELL, "_lo", "_hi"], "left").drop("_lo", "_hi").withColumn("known", F.coalesce("known", F.lit(False)))


#: More than any place: a question is one number, its first place times this and its last.
SPAN = 1 << 20


def asked_together(rows: DataFrame, obs: DataFrame, **asks: tuple[Column, Column]) -> DataFrame:
    """rows plus known and, for each name of asks, what lies from its period lo to hi in the row's cell, as asked() has it.

    Rows meet all answers of their cell at once, a map by question, so they are shuffled once, whatever they ask and carry.
    """
    at = lambda p: F.coalesce(position(p), F.lit(-1)) + 1
    rows = rows.withColumns({f"_{name}": at(lo).cast("long") * SPAN + at(hi) for name, (lo, hi) in asks.items()})
    numbers = rows.select(*CELL, F.explode(F.array(*[f"_{name}" for name in asks])).alias("x")).groupBy(*CELL).agg(F.collect_set("x").alias("q"))
    split = F.transform("q", lambda x: F.struct((F.floor(x / SPAN) - 1).cast("int").alias("_lo"), (x % SPAN - 1).cast("int").alias("_hi")))
    told = F.filter("told", lambda x: x["found"].isNotNull())
    number = lambda x: (x["_lo"] + 1).cast("long") * SPAN + x["_hi"] + 1
    held = _answers(numbers.select(*CELL, split.alias("q")), obs).select(*CELL, "known", F.map_from_entries(F.transform(told, lambda x: F.struct(number(x), x["found"]))).alias("_held"))
    met = rows.join(held, CELL, "left").withColumns({name: F.try_element_at("_held", F.col(f"_{name}")) for name in asks} | {"known": F.coalesce("known", F.lit(False))})
    return met.drop("_held", *[f"_{name}" for name in asks])


def _answers(questions: DataFrame, obs: DataFrame) -> DataFrame:
    """(cell, known, told) of questions (cell, q: an array of the distinct _lo and _hi asked); told has _lo, _hi and found.

    All questions of a cell are answered in its row, step by step over the array: a row for each would copy the index.
    """
    met = questions.join(series_index(obs).withColumn("known", F.lit(True)), CELL, "left")
    held = lambda x, *names: [x[n].alias(n) for n in names]

    def stretch(x: Column) -> Column:
        return F.struct(*held(x, "_lo", "_hi"), F.greatest(x["_lo"] - F.col("first"), F.lit(0)).alias("a"), F.least(x["_hi"] - F.col("first"), F.size("places") - 1).alias("b"))

    def level(x: Column) -> Column:
        """With k: from place a to b there are 2**k places or more and fewer than twice as many; null if there are none."""
        within = (x["_lo"] >= 0) & (x["_hi"] >= 0) & (x["a"] <= x["b"])
        return F.struct(*held(x, "_lo", "_hi", "a", "b"), F.when(within, F.length(F.bin(x["b"] - x["a"] + 1)) - 1).alias("k"))

    def best(x: Column, values: str, at: str, highest: bool) -> Column:
        over = F.get(at, x["k"])
        return F.nullif(_better(F.col(values), highest, F.get(over, x["a"]), F.get(over, x["b"] - F.pow(F.lit(2), x["k"]).cast("int") + 1)), F.lit(-1))

    def placed(x: Column) -> Column:
        return F.struct(*held(x, "_lo", "_hi", "a", "b", "k"), F.when(x["k"].isNotNull(), best(x, "los", "lo_at", False)).alias("least"), F.when(x["k"].isNotNull(), best(x, "his", "hi_at", True)).alias("most"))

    def told(x: Column) -> Column:
        here = F.slice("places", x["a"] + 1, x["b"] - x["a"] + 1)
        mixed = (F.col("unit_lo") != F.col("unit_hi")) & (F.array_min(F.transform(here, lambda y: y["unit_lo"])) != F.array_max(F.transform(here, lambda y: y["unit_hi"])))
        n = F.when(x["a"] == x["b"], F.get("places", x["a"])["n"])
        found = F.struct(n.alias("n"), F.get("los", x["least"]).alias("lo"), (x["least"] + F.col("first")).alias("lo_p"), F.get("his", x["most"]).alias("hi"), (x["most"] + F.col("first")).alias("hi_p"), F.coalesce(mixed, F.lit(False)).alias("mixed"))
        return F.struct(*held(x, "_lo", "_hi"), F.when(x["k"].isNotNull(), found).alias("found"))

    steps = F.transform(F.transform(F.transform(F.transform("q", stretch), level), placed), told)
    return met.select(*CELL, F.coalesce("known", F.lit(False)).alias("known"), steps.alias("told"))


def range_extremes(requests: DataFrame, obs: DataFrame, highest: bool = True) -> DataFrame:
    """(claim_id, status, value, period): the extreme from start_period to end_period and the earliest period that has it.

    Requests whose stretch holds no value are left out.
    """
    got = asked(requests.select("claim_id", *CELL, "start_period", "end_period"), obs, F.col("start_period"), F.col("end_period"))
    name = "hi" if highest else "lo"
    ok = ~F.col("found.mixed")
    rows = got.filter(F.col(f"found.{name}").isNotNull())
    return rows.select("claim_id", F.when(ok, "ok").otherwise("mixed_units").alias("status"), F.when(ok, F.col(f"found.{name}")).alias("value"), F.when(ok, period_at(F.col(f"found.{name}_p"))).alias("period"))
