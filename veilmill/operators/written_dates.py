"""Dates as people write them, in built-in expressions: found, read and moved in the hand that they came in.

Four hands: day month year and month day year with names of months, numbers with / or . between them, and year first. Names
are met with a table of months by spelling; what a date becomes is put together from the pieces of its own text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .canonical import bound
from .dates import MONTHS_EN, MONTHS_FR, SHORT_EN, SHORT_FR, plain

#: Spellings of months by table: 0 and 1 full, 2 and 3 short French names, with accents and without, 4 full and 5 short English ones.
TABLES = tuple(
    tuple(names) for names in (MONTHS_FR, [plain(m) for m in MONTHS_FR], [m.split()[0] for m in SHORT_FR], [plain(m.split()[0]) for m in SHORT_FR], MONTHS_EN, [m.split()[0] for m in SHORT_EN])
)
FULL = (0, 1, 0, 1, 4, 4)


def _spellings(order: tuple[int, ...]) -> dict[str, int]:
    """table * 12 + month by spelling; the first table in order that has it counts."""
    out: dict[str, int] = {}
    for t in order:
        names = [m.split() for m in (SHORT_FR if t == 2 else SHORT_EN)] if t in (2, 5) else [[plain(x) for x in m.split()] for m in SHORT_FR] if t == 3 else [[m] for m in TABLES[t]]
        for i, several in enumerate(names):
            for name in several:
                out.setdefault(name, t * 12 + i)
    return out


FRENCH_FIRST, ENGLISH_FIRST = _spellings((0, 1, 4, 2, 3, 5)), _spellings((4, 0, 1, 5, 2, 3))
NAMES = "|".join(sorted(FRENCH_FIRST, key=lambda n: (-len(n), n)))

#: Recognised in texts; RE2 has these forms too.
WRITTEN = rf"\b(?:[0-9]{{1,2}}(?:er|st|nd|rd|th)? (?i:{NAMES})\.? [0-9]{{4}}|(?i:{NAMES})\.? [0-9]{{1,2}}(?:st|nd|rd|th)?,? [0-9]{{4}})\b"
#: What every written date has, from a digit on.
GUARD = rf"[0-9](?:(?:er|st|nd|rd|th)? (?i:{NAMES})\.? [0-9]{{4}}|(?:st|nd|rd|th)?,? [0-9]{{4}})"
NUMERIC = r"\b(?:[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2})\b"

_DAY_FIRST = rf"(?i)\A([0-9]{{1,2}})(er|st|nd|rd|th)?( )({NAMES})(\.?)( )([0-9]{{4}})\z"
_MONTH_FIRST = rf"(?i)\A({NAMES})(\.?)( )([0-9]{{1,2}})(st|nd|rd|th)?(,? )([0-9]{{4}})\z"
_NUMBERS = r"\A([0-9]{1,2})([/.])([0-9]{1,2})([/.])([0-9]{4})\z"
_YEAR_FIRST = r"\A([0-9]{4})(/)([0-9]{1,2})(/)([0-9]{1,2})\z"
#: What is read: the day, the layout, and the pieces that carry over.
READING = "struct<day:date,layout:string,dd:string,suffix:string,name:string,dot:string,code:int,mm:string,one:string,two:string,month_first:boolean>"


def _table(names: dict[str, int], key: Column) -> Column:
    return F.element_at(F.create_map(*(x for k, v in names.items() for x in (F.lit(k), F.lit(v)))), key)


def reading(value: Column) -> Column:
    """READING of a value that is a date as a whole; null for others, ISO dates among them."""
    at = lambda p, i: F.regexp_extract(value, p, i)
    number = lambda c: c.try_cast("int")
    nothing = F.lit(None).cast("string")

    def made(day: Column, layout: str, **parts: Column) -> Column:
        fields = {"dd": nothing, "suffix": nothing, "name": nothing, "dot": nothing, "code": F.lit(None).cast("int"), "mm": nothing, "one": nothing, "two": nothing, "month_first": F.lit(False)} | parts
        whole = F.struct(day.alias("day"), F.lit(layout).alias("layout"), *(c.alias(k) for k, c in fields.items())).cast(READING)
        return F.when(day.isNotNull(), whole)

    def by_name(p: str, names: dict[str, int], name: int, dot: int, day: int, suffix: int, one: int, two: int, layout: str) -> Column:
        code = _table(names, F.lower(at(p, name)))
        date = F.try_make_timestamp(number(at(p, 7)), F.pmod(code, F.lit(12)) + 1, number(at(p, day)), F.lit(0), F.lit(0), F.lit(0)).cast("date")
        return made(date, layout, dd=at(p, day), suffix=at(p, suffix), name=at(p, name), dot=at(p, dot), code=code, one=at(p, one), two=at(p, two))

    def by_number() -> Column:
        a, b = at(_NUMBERS, 1), at(_NUMBERS, 3)
        date = lambda d, m: F.try_make_timestamp(number(at(_NUMBERS, 5)), number(m), number(d), F.lit(0), F.lit(0), F.lit(0)).cast("date")
        usual, other = date(a, b), date(b, a)
        return made(F.coalesce(usual, other), "numbers", dd=F.when(usual.isNotNull(), a).otherwise(b), mm=F.when(usual.isNotNull(), b).otherwise(a), one=at(_NUMBERS, 2), two=at(_NUMBERS, 4), month_first=usual.isNull())

    def year_first() -> Column:
        date = F.try_make_timestamp(number(at(_YEAR_FIRST, 1)), number(at(_YEAR_FIRST, 3)), number(at(_YEAR_FIRST, 5)), F.lit(0), F.lit(0), F.lit(0)).cast("date")
        return made(date, "year", dd=at(_YEAR_FIRST, 5), mm=at(_YEAR_FIRST, 3), one=at(_YEAR_FIRST, 2), two=at(_YEAR_FIRST, 4))

    return (
        F.when(value.rlike(_DAY_FIRST), by_name(_DAY_FIRST, FRENCH_FIRST, 4, 5, 1, 2, 3, 6, "day"))
        .when(value.rlike(_MONTH_FIRST), by_name(_MONTH_FIRST, ENGLISH_FIRST, 1, 2, 4, 5, 3, 6, "month"))
        .when(value.rlike(_NUMBERS) & (at(_NUMBERS, 2) == at(_NUMBERS, 4)), by_number())
        .when(value.rlike(_YEAR_FIRST), year_first())
    )


def written(r: Column, day: Column) -> Column:
    """day in the hand of a reading."""
    d, m, y = F.day(day), F.month(day), F.lpad(F.year(day).cast("string"), 4, "0")
    width = lambda n, like: F.when(F.startswith(like, F.lit("0")), F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string"))
    table = F.floor(r["code"] / 12).cast("int")
    pick = lambda t: F.get(F.get(F.array(*(F.array(*map(F.lit, names)) for names in TABLES)), t), m - 1)
    name, full = pick(table), pick(F.get(F.array(*map(F.lit, FULL)), table))
    upper, title = r["name"].rlike(r"\A\P{Ll}{2,}\z"), r["name"].rlike(r"\A\p{Lu}")
    styled = F.when(upper, F.upper(name)).when(title, F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, F.lit(2), F.length(name)))).otherwise(name)
    # A month without a short form of its own takes no dot.
    month = F.concat(styled, F.when((r["dot"] != "") & ((name != full) | ~table.isin(2, 3, 5)), F.lit(".")).otherwise(""))
    tail = F.when(d.isin(11, 12, 13), "th").when(d % 10 == 1, "st").when(d % 10 == 2, "nd").when(d % 10 == 3, "rd").otherwise("th")
    french = (table < 4) & (r["layout"] == "day")
    ordinal = F.when(french & (d == 1), F.lit("er")).when(r["suffix"].isin("st", "nd", "rd", "th"), tail).otherwise("")
    number = F.concat(F.when(ordinal == "er", d.cast("string")).otherwise(width(d, r["dd"])), ordinal)
    as_wide = lambda n, like: F.when(F.length(like) == 2, F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string"))
    mm, dd = as_wide(m, r["mm"]), as_wide(d, r["dd"])
    pair = F.when(r["month_first"], F.concat(mm, r["one"], dd)).otherwise(F.concat(dd, r["one"], mm))
    return (
        F.when(r["layout"] == "day", F.concat(number, r["one"], month, r["two"], y))
        .when(r["layout"] == "month", F.concat(month, r["one"], number, r["two"], y))
        .when(r["layout"] == "numbers", F.concat(pair, r["two"], y))
        .when(r["layout"] == "year", F.concat(y, r["one"], mm, r["two"], dd))
    )


def moved(value: Column, days: Column) -> Column:
    """A written date moved by days within years 1 to 9999, in its own hand; null for what is none."""
    first = F.lit("0001-01-01").cast("date")
    day = lambda r: F.date_add(first, F.pmod(F.datediff(r["day"], first) + days, F.lit(3_652_059)).cast("int"))
    return bound(reading(value), lambda r: F.when(r.isNotNull(), written(r, day(r))))
