"""Date rules as column expressions; dates outside 1862 .. today are rejected, not repaired."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .textops import as_col, strip

MIN_YEAR = 1862
RULES = ("prefer_decision", "prefer_cnr", "agree_only")


def parse_iso_date(c: Column | str) -> Column:
    """A leading YYYY-MM-DD; what follows is ignored, and an invalid date is null."""
    t = strip(c)
    day = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(t, 1, 10))
    return day.try_cast("date")


def cnr_date_text(cnr: Column | str) -> Column:
    """The third part of a record number: '' if it is there but empty, null if there are fewer parts."""
    return F.get(F.split(as_col(cnr), "_"), 2)


def date_status(c: Column | str, today: str) -> Column:
    c = as_col(c)
    day = parse_iso_date(c)
    return (
        F.when(c.isNull() | (strip(c) == ""), "missing")
        .when(day.isNull(), "unparseable")
        .when((F.year(day) < MIN_YEAR) | (day > F.lit(today).cast("date")), "implausible")
        .otherwise("ok")
    )


def usable_date(c: Column | str, today: str) -> Column:
    return F.when(date_status(c, today) == "ok", parse_iso_date(c))


def resolve_date(decision: Column | str, cnr: Column | str, today: str, rule: str = "prefer_decision") -> Column:
    """Struct: judgment_date, date_source, both statuses, date_conflict, year_conflict."""
    if rule not in RULES:
        raise ValueError(f"unknown date rule {rule!r}; expected one of {RULES}")
    inside = cnr_date_text(cnr)
    a, b = usable_date(decision, today), usable_date(inside, today)
    both = a.isNotNull() & b.isNotNull()
    conflict = both & (a != b)
    if rule == "agree_only":
        chosen = F.when(both & (a == b), a)
        source = F.when(both & (a == b), "decision_date")
    elif rule == "prefer_cnr":
        chosen = F.coalesce(b, a)
        source = F.when(b.isNotNull(), "cnr").when(a.isNotNull(), "decision_date")
    else:
        chosen = F.coalesce(a, b)
        source = F.when(a.isNotNull(), "decision_date").when(b.isNotNull(), "cnr")
    return F.struct(
        chosen.cast("string").alias("judgment_date"),
        source.alias("date_source"),
        date_status(decision, today).alias("decision_date_status"),
        date_status(inside, today).alias("cnr_date_status"),
        F.coalesce(conflict, F.lit(False)).alias("date_conflict"),
        F.coalesce(both & (F.year(a) != F.year(b)), F.lit(False)).alias("year_conflict"),
    )


def judgment_year(judgment_date: Column | str, dataset_year: Column | str) -> Column:
    return F.coalesce(F.substring(as_col(judgment_date), 1, 4).try_cast("int"), as_col(dataset_year).try_cast("int"))


def year_period(year: Column | str) -> Column:
    y = as_col(year)
    return (
        F.when(y.isNull(), "unknown")
        .when(y < 2010, "before 2010")
        .when(y < 2015, "2010-14")
        .when(y < 2020, "2015-19")
        .when(y < 2024, "2020-23")
        .otherwise("2024+")
    )
