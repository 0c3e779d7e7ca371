"""Irregular readings onto a regular grid of equal cells.

Consecutive readings of a source bound an interval with an increment. A
cumulative counter's increment is the difference of its readings; where the
counter falls it was reset, and the new reading is what came since. A level (a
flow, a power) is first turned into such a counter: its increment over an
interval is the mean of both readings times the hours between. Increments are
spread over the cells in proportion to the overlap; intervals longer than
``max_gap_days`` are not trusted and the time they cover is marked uncovered.

Readings are chained in two steps, within a day and from day to day, so the
largest window partition is one source's readings of one day or one source's
days, however many readings a source has. A day is summed up before it is
shuffled on, and every row goes through one chain of three shuffles at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_TIME = r"(?:[T\s]\s*(\d{1,2}:\d{2}(?::\d{2})?)(?:\.\d+)?\s*(?:Z|[+-]\d{2}:?\d{2})?)?$"
_YEAR_FIRST = r"^\s*(\d{4})([-/.]?)(\d{2})\2(\d{2})" + _TIME
_DAY_FIRST = r"^\s*(\d{1,2})[-/.\s]+([A-Za-z]{3})[a-z]*[-/.,\s]+(\d{4})" + _TIME


def read_moment(text: Column) -> Column:
    """Timestamp (without zone) named by a date string, else null.

    Year first (with -, /, . or nothing between) or day first with the month's
    English name, with or without a time of day, stray blanks around. A day that
    no calendar has gives null; an impossible time of day counts as midnight.
    """
    s = F.rtrim(text)
    first_year = F.when(s.rlike(_YEAR_FIRST), s)
    first_day = F.when(s.rlike(_DAY_FIRST), s)
    return F.coalesce(
        F.regexp_replace(first_year, _YEAR_FIRST, "$1-$3-$4 $5").try_cast("timestamp_ntz"),
        F.regexp_replace(first_year, _YEAR_FIRST, "$1-$3-$4").try_cast("timestamp_ntz"),
        F.try_to_timestamp(F.rtrim(F.regexp_replace(first_day, _DAY_FIRST, "$1-$2-$3 $4")), F.lit("d-MMM-yyyy[ H:m[:s]]")).cast("timestamp_ntz"),
        F.try_to_timestamp(F.regexp_replace(first_day, _DAY_FIRST, "$1-$2-$3"), F.lit("d-MMM-yyyy")).cast("timestamp_ntz"),
    )


def regular_grid(df: DataFrame, source: Column, moment: Column, value: Column, order: Column, first_cell: str, cell_days: int = 7, kind: str = "level", max_gap_days: float = 45.0) -> DataFrame:
    """One row per source and cell from its first to its last counting reading.

    Columns: source, cell (its start, timestamp_ntz), n_readings, amount (the
    share of all increments that falls into the cell), mean_rate (amount per
    covered hour), covered_hours, uncovered_hours, resets, status: 'observed' (a
    reading lies in the cell), 'filled' (none, but intervals cover all of it) or
    'uncovered' (none, and some of it lies in a gap longer than
    ``max_gap_days``). ``kind`` is 'level' or 'counter'. Readings with a null in
    source, moment or value, or a NaN value, don't count. Readings of
    one moment are chained in the order of ``order`` and the value; equal rows
    are all kept. An empty table gives an empty result.
    """
    if kind not in ("level", "counter"):
        raise ValueError("kind must be 'level' or 'counter'")
    base = df.select(source.cast("string").alias("source"), moment.cast("timestamp_ntz").alias("t"), value.cast("double").alias("v"), order.cast("long").alias("o"))
    base = base.where("source IS NOT NULL AND t IS NOT NULL AND v IS NOT NULL AND NOT isnan(v)").withColumn("day", F.col("t").cast("date"))
    spot = F.struct("t", "o", "v")
    origin = F.lit(first_cell).cast("timestamp_ntz")
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / F.lit(1e6)
    cell_of = lambda c: F.floor(F.datediff(c.cast("date"), origin.cast("date")) / F.lit(cell_days))

    def span(a: Column, b: Column) -> Column:
        """Hours, increment and reset between two readings; null where there is no second."""
        hours = (seconds(b["t"]) - seconds(a["t"])) / 3600
        if kind == "counter":
            fell = b["v"] < a["v"]
            amount, reset = F.when(fell, b["v"]).otherwise(b["v"] - a["v"]), fell.cast("long")
        else:
            amount, reset = (a["v"] + b["v"]) / 2 * hours, F.lit(0).cast("long")
        return F.when(b.isNotNull(), F.struct(hours.alias("hours"), amount.alias("amount"), reset.alias("reset"), (hours <= F.lit(max_gap_days * 24)).alias("trusted")))

    in_day = Window.partitionBy("source", "day").orderBy("t", "o", "v")
    chained = base.withColumn("to", F.lead(spot).over(in_day)).withColumn("s", span(spot, F.col("to")))
    days = chained.groupBy("source", "day").agg(
        F.min(spot).alias("first"), F.max(spot).alias("last"), F.count("*").alias("n"), F.sum(F.when(F.col("s.trusted"), F.col("s.amount"))).alias("amount"), F.sum(F.when(F.col("s.trusted"), F.col("s.hours"))).alias("covered"),
        F.sum(F.when(~F.col("s.trusted"), F.col("s.hours"))).alias("uncovered"), F.sum("s.reset").alias("resets"),
    )
    linked = days.withColumn("to", F.lead("first").over(Window.partitionBy("source").orderBy("day"))).withColumn("s", span(F.col("last"), F.col("to")))
    own, until = cell_of(F.col("last.t")), cell_of(F.col("to.t"))
    cells = linked.withColumn("c", F.explode(F.sequence(own, F.coalesce(until, own))))
    left = seconds(origin) + F.col("c") * (cell_days * 86400)
    overlap = (F.least(seconds(F.col("to.t")), left + cell_days * 86400) - F.greatest(seconds(F.col("last.t")), left)) / 3600
    share = F.when(F.col("s.hours") > 0, overlap / F.nullif(F.col("s.hours"), F.lit(0.0))).otherwise(1.0)
    here, trusted = F.col("c") == own, F.col("s.trusted")
    both = lambda x, y: F.when(x.isNotNull() | y.isNotNull(), F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))
    pieces = cells.select(
        "source", "c", F.when(here, F.col("n")).otherwise(0).alias("n"), both(F.when(here, F.col("amount")), F.when(trusted, F.col("s.amount") * share)).alias("amount"),
        both(F.when(here, F.col("covered")), F.when(trusted, overlap)).alias("covered"), both(F.when(here, F.col("uncovered")), F.when(~trusted, overlap)).alias("uncovered"),
        (F.when(here, F.coalesce("resets", F.lit(0))).otherwise(0) + F.when(F.col("c") == until, F.col("s.reset")).otherwise(0)).alias("resets"),
    )
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    out = pieces.groupBy("source", "c").agg(F.sum("n").alias("n_readings"), F.sum("amount").alias("amount"), zero("covered").alias("covered_hours"), zero("uncovered").alias("uncovered_hours"), F.sum("resets").alias("resets"))
    status = F.when(F.col("n_readings") > 0, "observed").when(F.col("uncovered_hours") > 0, "uncovered").otherwise("filled")
    start = F.timestamp_seconds(seconds(origin) + F.col("c") * (cell_days * 86400)).cast("timestamp_ntz")
    return out.select("source", start.alias("cell"), "n_readings", "amount", F.try_divide("amount", "covered_hours").alias("mean_rate"), "covered_hours", "uncovered_hours", "resets", status.alias("status"))
