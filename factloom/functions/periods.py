"""Period arithmetic on strings YYYY, YYYYMM and YYYY + quarter 01..04, told apart by frequency Y, M or Q.

Null periods, and those of another shape, give null; nothing is ever a date.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Relative words of the Korean periods and what they stand for; where one holds another it comes first.
YEAR_OFFSETS = {"재작년": -2, "전전년도": -2, "전전년": -2, "작년": -1, "지난해": -1, "전년도": -1, "전년": -1, "직전연도": -1, "올해": 0, "금년": 0}
MONTH_OFFSETS = {"지난달": -1, "전달": -1, "전월": -1, "당월": 0, "이번달": 0, "다음달": 1}
QUARTER_OFFSETS = {"지난분기": -1, "전분기": -1, "직전분기": -1, "당분기": 0}
# Words by which a period counts as relative, whether or not it can be worked out here.
RELATIVE = ("작년", "지난해", "올해", "지난달", "이번달", "재작년", "지난주", "이번주", "전년", "전월", "전달", "전분기", "지난분기", "직전분기", "당분기", "전기", "당월", "당해", "1년새", "다음달")
END_MARKS, START_MARKS = ("말", "연말"), ("초", "연초")


def year_of(p: Column) -> Column:
    return F.substring(p, 1, 4).cast("int")


def suffix_of(p: Column) -> Column:
    return F.when(F.length(p) == 6, F.substring(p, 5, 2).cast("int"))


def make(year: Column, suffix: Column | None = None) -> Column:
    y = F.lpad(year.cast("int").cast("string"), 4, "0")
    return y if suffix is None else F.concat(y, F.lpad(suffix.cast("int").cast("string"), 2, "0"))


def shift(year: Column, suffix: Column, by: Column | int, in_year: int) -> Column:
    """The period `by` months (in_year 12) or quarters (4) later."""
    total = year * in_year + suffix - 1 + by
    return make(F.floor(total / in_year), F.pmod(total, F.lit(in_year)) + 1)


def _first(words: dict[str, int], text: Column) -> Column:
    out = F.lit(None).cast("int")
    for w, n in words.items():
        out = F.coalesce(out, F.when(F.contains(text, F.lit(w)), F.lit(n)))
    return out


def _any(words: tuple[str, ...], text: Column) -> Column:
    return F.greatest(*[F.contains(text, F.lit(w)) for w in words])


def normalize(period: Column, freq: Column, at: Column) -> Column:
    """An absolute period for an expression in an article written on date `at`; the expression itself if none is seen.

    In turn: a bare year; the end of a year range; N years ago; a quarter or month with its year resolved; month or quarter
    offsets; year offsets with marks for the year's start or end; a year offset.
    """
    y, m = F.year(at), F.month(at)
    q = F.floor((m - 1) / 3) + 1
    group = lambda pattern, k=1: F.nullif(F.regexp_extract(period, pattern, k), F.lit(""))
    bare = group(r"^(\d{4})년?$")
    until = group(r"(\d{4})\s*[~\-–—]\s*(\d{4})\s*년?", 2)
    ago = group(r"(\d+)년\s*여?\s*전").cast("int")
    offset = _first(YEAR_OFFSETS, period)
    own_year = F.coalesce(group(r"(\d{4})년").cast("int"), y + offset, y)
    quarter, month = group(r"([1-4])\s*분기").cast("int"), group(r"(1[0-2]|[1-9])\s*월").cast("int")
    m_off, q_off = _first(MONTH_OFFSETS, period), _first(QUARTER_OFFSETS, period)
    end, start = _any(END_MARKS, period), _any(START_MARKS, period)
    marked = offset.isNotNull() | end | start
    base = y + F.coalesce(offset, F.lit(0))
    monthly = F.when(month.isNotNull(), make(own_year, month)).when(m_off.isNotNull(), shift(y, m, m_off, 12)).when(marked, make(base, F.when(end, 12).when(start, 1).otherwise(m)))
    quarterly = F.when(quarter.isNotNull(), make(own_year, quarter)).when(q_off.isNotNull(), shift(y, q, q_off, 4)).when(marked, make(base, F.when(end, 4).when(start, 1).otherwise(q)))
    return F.coalesce(bare, until, make(y - ago), F.when(freq == "M", monthly), F.when(freq == "Q", quarterly), make(y + offset), period)


def month_period(text: Column, at: Column) -> Column:
    """YYYYMM from `24년 6월`, `작년 11월`, `지난 10월` (the last one before the date) or `올 5월`; else null."""
    group = lambda pattern, k=1: F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))
    pattern = r"(?<!\d)(\d{4}|\d{2})년\s*(\d{1,2})월"
    y, m = group(pattern), group(pattern, 2)
    explicit = F.concat(F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y), F.lpad(m, 2, "0"))
    last_year = group(r"작년\s*(\d{1,2})월").cast("int")
    word, month = group(r"(지난|올해?|이번)\s*(\d{1,2})월"), group(r"(지난|올해?|이번)\s*(\d{1,2})월", 2).cast("int")
    relative = F.when(month.between(1, 12), make(F.year(at) - F.when((word == "지난") & (month >= F.month(at)), 1).otherwise(0), month))
    return F.coalesce(explicit, F.when(last_year.between(1, 12), make(F.year(at) - 1, last_year)), relative)


def valid(period: Column, relative: tuple[str, ...] = RELATIVE) -> Column:
    """Null, four or six digits, or a relative word."""
    return period.isNull() | period.rlike(r"^\d{4}$|^\d{6}$") | _any(relative, period)


def fits(period: Column, freq: Column) -> Column:
    """An error text where the period's shape isn't the frequency's; else null."""
    ok = F.when(freq == "Y", period.rlike(r"^\d{4}$")).when(freq == "M", period.rlike(r"^\d{4}(0[1-9]|1[0-2])$")).when(freq == "Q", period.rlike(r"^\d{4}0[1-4]$"))
    return F.when(~F.coalesce(ok, F.lit(False)), F.concat(F.lit("bad period for "), F.coalesce(freq, F.lit("?"))))


def prior_year(p: Column) -> Column:
    """The same period a year before."""
    return F.when(F.length(p) == 6, make(year_of(p) - 1, suffix_of(p))).otherwise((p.cast("int") - 1).cast("string"))


def prior_immediate(p: Column, freq: Column) -> Column:
    """The month or quarter before; years go by prior_year."""
    s, y = suffix_of(p), year_of(p)
    back = F.when(s <= 1, make(y - 1, F.when(freq == "M", 12).otherwise(4))).otherwise(make(y, s - 1))
    return F.when((F.length(p) == 6) & freq.isin("M", "Q"), back).otherwise(prior_year(p))


def wants_immediate(target: Column) -> Column:
    """Whether a comparison target means the period just before: last-year words rule it out, then immediate words, then a bare month or quarter."""
    return F.coalesce(F.when(target.rlike("작년|전년|지난해"), False).when(target.rlike("전달|전월|전분기|직전"), True).otherwise(F.trim(target).rlike(r"^\d{1,2}(월|분기)$")), F.lit(False))


def anchor_base(sentence: Column, p: Column, freq: Column) -> Column:
    """The period that a phrase counts from: year to date, end of last year, N months in a row, half-year; else null."""
    y, s = year_of(p), suffix_of(p)
    n = F.nullif(F.regexp_extract(sentence, r"(\d+)\s*개월\s*(?:연속|째)", 1), F.lit("")).cast("int")
    half = F.nullif(F.regexp_extract(sentence, "(상반기|하반기)", 1), F.lit(""))
    base = (
        F.when(sentence.rlike(r"올해\s*들어|올\s*들어"), make(y, F.lit(1)))
        .when(sentence.rlike(r"(지난해|작년)\s*말"), make(y - 1, F.when(freq == "M", 12).otherwise(4)))
        .when(n.isNotNull() & (freq == "M"), shift(y, s, -n, 12))
        .when(half.isNotNull() & (freq == "M"), make(y, F.when(half == "상반기", 1).otherwise(7)))
    )
    return F.when((F.length(p) == 6) & freq.isin("M", "Q"), base)
