"""Official cells and what is computed from them. Errors are values of a status column, never exceptions.

Requests meet observations by equi-joins on table, item and dimension; what lies between two periods comes from the index of
series. Aggregates go by request, with a partial sum before each shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import periods

from .series import CELL, asked_together, period_at

# What an official table prints where it has no number.
MISSING = ("", "-", "..", "X", "n/a")


def parse_value(c: Column) -> Column:
    t = F.trim(c)
    return F.when(~t.isin(*MISSING), F.regexp_replace(t, ",", "").try_cast("double"))


def lookup_cell(requests: DataFrame, obs: DataFrame) -> DataFrame:
    """(claim_id, status, value, unit): ok with exactly one cell that has a number; else none, many, other_period, no_value.

    Cells are counted by key and period first, so a request meets one row and not a whole series.
    """
    at = obs.groupBy(*CELL, "period").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("v"), F.min("unit").alias("u"))
    series = obs.select(*CELL).distinct().withColumn("any", F.lit(True))
    got = requests.select("claim_id", *CELL, "period").join(at, [*CELL, "period"], "left").join(series, CELL, "left")
    status = F.when(F.col("n") == 1, F.when(F.col("v").isNull(), "no_value").otherwise("ok")).when(F.col("n") > 1, "many").when(F.col("any"), "other_period").otherwise("none")
    return got.select("claim_id", status.alias("status"), F.when(status == "ok", F.col("v")).alias("value"), F.when(status == "ok", F.col("u")).alias("unit"))


def fetch_series(requests: DataFrame, obs: DataFrame) -> DataFrame:
    """(claim_id, period, value, unit): cells from start_period to end_period that have a number."""
    asked = requests.select("claim_id", *CELL, "start_period", "end_period")
    return asked.join(obs.select(*CELL, "period", "value", "unit"), CELL).filter(F.col("period").between(F.col("start_period"), F.col("end_period")) & F.col("value").isNotNull()).select("claim_id", "period", "value", "unit")


def fetch_codes(requests: DataFrame, obs: DataFrame) -> DataFrame:
    """(claim_id, dim, value, unit): the cells of all codes in the array dims, for one period."""
    rows = requests.select("claim_id", "table_id", "item_id", "period", F.explode(F.array_distinct("dims")).alias("dim"))
    return rows.join(obs.select(*CELL, "period", "value", "unit"), [*CELL, "period"]).select("claim_id", "dim", "value", "unit")


def asof_month(requests: DataFrame, obs: DataFrame, tolerance: int = 3) -> DataFrame:
    """(claim_id, period, value): the newest cell of the request's month or up to `tolerance` months before.

    Each request asks for its few months by name, so this is an equi-join.
    """
    y, m = periods.year_of(F.col("period")), periods.suffix_of(F.col("period"))
    months = F.array(*[periods.shift(y, m, -k, 12) for k in range(tolerance + 1)])
    asked = requests.select("claim_id", *CELL, F.explode(months).alias("period"))
    found = asked.join(obs.filter("value is not null").select(*CELL, "period", "value"), [*CELL, "period"])
    return found.groupBy("claim_id").agg(F.max(F.struct("period", "value")).alias("m")).select("claim_id", "m.period", "m.value")


def _units(status_ok: Column) -> Column:
    return F.when(F.col("units") > 1, "mixed_units").when(F.col("n") == 0, "empty").otherwise(status_ok)


def agg_sum(cells: DataFrame) -> DataFrame:
    """(claim_id, status, value, unit): the sum of same-unit values."""
    g = cells.groupBy("claim_id").agg(F.sum("value").alias("s"), F.count_distinct("unit").alias("units"), F.count(F.lit(1)).alias("n"), F.min("unit").alias("unit"))
    st = _units(F.lit("ok"))
    return g.select("claim_id", st.alias("status"), F.when(st == "ok", F.col("s")).alias("value"), F.when(st == "ok", F.col("unit")).alias("unit"))


def agg_ratio(cells: DataFrame) -> DataFrame:
    """(claim_id, status, value): sum of the rows with `part` over the sum of the others, in percent to one decimal."""
    g = cells.groupBy("claim_id").agg(F.sum(F.when(F.col("part"), F.col("value"))).alias("a"), F.sum(F.when(~F.col("part"), F.col("value"))).alias("b"), F.count_distinct("unit").alias("units"), F.count(F.lit(1)).alias("n"))
    st = _units(F.when(F.coalesce(F.col("b"), F.lit(0)) == 0, "zero_base").when(F.col("a").isNull(), "empty").otherwise("ok"))
    return g.select("claim_id", st.alias("status"), F.when(st == "ok", F.round(F.col("a") / F.col("b") * 100, 1)).alias("value"))


def with_base(cells: DataFrame, obs: DataFrame) -> DataFrame:
    """cells (claim_id, table_id, item_id, dim, period, base_period, value, unit) plus base_value and base_unit."""
    base = obs.select(*CELL, F.col("period").alias("base_period"), F.col("value").alias("base_value"), F.col("unit").alias("base_unit"))
    return cells.join(base, [*CELL, "base_period"], "left")


def change() -> Column:
    return F.col("value") - F.col("base_value")


def change_rate() -> Column:
    """Percent to one decimal; null where the base is zero or missing."""
    return F.round(F.try_divide(F.col("value") - F.col("base_value"), F.col("base_value")) * 100, 1)


def rate_or_points(pairs: DataFrame) -> DataFrame:
    """pairs plus result, result_unit and calc_type: over a series in percent a rate becomes a change in points."""
    points = F.col("unit") == "%"
    return pairs.withColumns({"result": F.when(points, F.round(change(), 4)).otherwise(change_rate()), "result_unit": F.when(points, "%p").otherwise("%"), "calc_type": F.when(points, "change").otherwise("rate")})


def extreme_check(series: DataFrame, highest: bool = True) -> DataFrame:
    """(claim_id, status, value, period): the extreme of a series and the earliest period that has it."""
    best = F.min(F.struct((-F.col("value") if highest else F.col("value")).alias("v"), "period"))
    g = series.groupBy("claim_id").agg(best.alias("b"), F.count_distinct("unit").alias("units"), F.count(F.lit(1)).alias("n"))
    st = _units(F.lit("ok"))
    value = -F.col("b.v") if highest else F.col("b.v")
    return g.select("claim_id", st.alias("status"), F.when(st == "ok", value).alias("value"), F.when(st == "ok", F.col("b.period")).alias("period"))


def compute(claims: DataFrame, obs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(claim_id, calc_type, status, value, period): each claim by its calc_type; unknown ones look their cell up.

    claims: claim_id (distinct), calc_type, table_id, item_id, dim, period, freq, start_period, and those of keep, which go out
    as they are. A claim asks the index of series for one stretch, its cell at its period or from start_period to it, and a rate
    or change for its base too.
    """
    kind = F.coalesce("calc_type", F.lit("lookup"))
    rows = claims.withColumn("calc_type", F.when(kind.isin("rate", "change", "max_check", "min_check"), kind).otherwise("lookup"))
    rows = rows.select(*dict.fromkeys(["claim_id", "calc_type", *CELL, "period", "start_period", *keep]))
    is_pair, is_extreme, is_max = F.col("calc_type").isin("rate", "change"), F.col("calc_type").isin("max_check", "min_check"), F.col("calc_type") == "max_check"
    base_period = F.when(is_pair, periods.prior_year(F.col("period")))
    got = asked_together(rows, obs, _own=(F.when(is_extreme, F.col("start_period")).otherwise(F.col("period")), F.col("period")), _base=(base_period, base_period))
    best, place = (F.when(is_max, F.col(f"_own.hi{x}")).otherwise(F.col(f"_own.lo{x}")) for x in ("", "_p"))
    got = got.select("claim_id", "calc_type", "period", *keep, "known", F.col("_own.n").alias("_n"), best.alias("value"), place.alias("_place"), F.col("_own.mixed").alias("_mixed"), F.col("_base.lo").alias("base_value"))
    lookup = F.when(F.col("_n") == 1, F.when(F.col("value").isNull(), "no_value").otherwise("ok")).when(F.col("_n") > 1, "many").when(F.col("known"), "other_period").otherwise("none")
    pair = F.when(F.col("value").isNull(), "none").when(F.col("base_value").isNull(), "no_base").when((F.col("calc_type") == "rate") & (F.col("base_value") == 0), "zero_base").otherwise("ok")
    extreme = F.when(F.col("_mixed"), "mixed_units").when(F.col("value").isNull(), "empty").otherwise("ok")
    status = F.when(is_pair, pair).when(is_extreme, extreme).otherwise(lookup)
    result = F.when(F.col("calc_type") == "change", change()).when(is_pair, change_rate()).otherwise(F.col("value"))
    period = F.when(is_pair, F.concat_ws("~", base_period, "period")).when(is_extreme, F.when(status == "ok", period_at(F.col("_place")))).otherwise(F.col("period"))
    return got.select("claim_id", "calc_type", status.alias("status"), F.when(status == "ok", result).alias("value"), period.alias("period"), *keep)
