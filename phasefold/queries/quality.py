"""Queries of the data-quality operators that belong to the core: p1 and p3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasefold.operators.latest import latest_rows, q
from phasefold.operators.regular_grid import read_moment, regular_grid
from phasefold.operators.spikes import Limits, flag_readings

FLOW = "S12.C.D.S333"
#: A flow of 2e6 or a landing of 1e6 kt passes anything measured on earth; the seas have -2.5 to 42 degrees.
LIMITS = {FLOW: Limits(0.0, 2e6, 0.1, True), "anchovy": Limits(0.0, 1e6, 0.001, True), "sio_sst": Limits(-2.5, 42.0, 0.0001, False, 0.05)}


def station(name: str = "station_id"):
    return F.upper(F.trim(F.col(name)))


def p1_flags(spark: SparkSession, d: str) -> DataFrame:
    """Every implausible reading with the reason."""
    flow = latest_rows(spark.read.parquet(f"{d}/sumflow.parquet"), ["reading_id"], "received_at", ["station_id", FLOW])
    yearly = latest_rows(spark.read.parquet(f"{d}/sardine_anchovy_sst.parquet"), ["obs_id"], "loaded_at", ["site_id", "year", "anchovy", "sio_sst"])
    rivers = flag_readings(flow, station(), F.col("reading_id"), F.col("reading_id"), {FLOW: (F.col(q(FLOW)), LIMITS[FLOW])})
    seas = flag_readings(yearly, F.upper(F.trim("site_id")), F.col("year"), F.col("obs_id"), {f: (F.col(f), LIMITS[f]) for f in ("anchovy", "sio_sst")})
    return rivers.unionByName(seas).select("field", "record_id", "reason")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_flags(spark, d).select("field", "record_id")


def p1_impossible(spark: SparkSession, d: str) -> DataFrame:
    """Of the implausible readings those that cannot exist."""
    return p1_flags(spark, d).where("reason = 'impossible'").select("field", "record_id")


def _weeks(spark: SparkSession, d: str, kind: str) -> DataFrame:
    rows = latest_rows(spark.read.parquet(f"{d}/sumflow.parquet"), ["reading_id"], "received_at", ["station_id", "Date", FLOW])
    rows = rows.withColumn("moment", read_moment(F.col("Date")))
    inside = F.col("moment").cast("date").between(F.lit("1979-12-31").cast("date"), F.lit("2005-12-31").cast("date"))
    grid = regular_grid(rows.where(inside), station(), F.col("moment"), F.col(q(FLOW)), F.col("reading_id"), "1979-12-31", 7, kind)
    return grid.withColumn("station_id", F.col("source")).withColumn("week_start", F.date_format("cell", "yyyy-MM-dd"))


def p3_weekly(spark: SparkSession, d: str) -> DataFrame:
    """Weekly flow per station with missing weeks filled or marked."""
    return _weeks(spark, d, "level").select("station_id", "week_start", "n_readings", F.col("amount").cast("float").alias("amount"), F.col("mean_rate").cast("float").alias("mean_rate"), F.round("covered_hours", 4).alias("covered_hours"), F.round("uncovered_hours", 4).alias("uncovered_hours"), "status")


def p3_counter(spark: SparkSession, d: str) -> DataFrame:
    """The readings taken as those of a cumulative counter: increments since the last reading or reset, by week."""
    return _weeks(spark, d, "counter").select("station_id", "week_start", "n_readings", F.col("amount").cast("float").alias("amount"), F.round("covered_hours", 4).alias("covered_hours"), "resets", "status")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _weeks(spark, d, "level").where("status <> 'observed'").select("station_id", "week_start")


QUERIES = {"p1_found": p1_found, "p1_flags": p1_flags, "p1_impossible": p1_impossible, "p3_found": p3_found, "p3_weekly": p3_weekly, "p3_counter": p3_counter}

_P3_BASE = """
WITH held AS (
  SELECT reading_id, arg_max(struct_pack(s := station_id, d := "Date", v := "S12.C.D.S333"), received_at) AS h
  FROM sumflow GROUP BY reading_id),
text AS (SELECT upper(trim(h.s)) AS station_id, trim(h.d) AS d FROM held WHERE h.v IS NOT NULL AND NOT isnan(h.v)),
days AS (
  SELECT station_id, coalesce(
    CASE WHEN regexp_matches(d, '^\\d{4}-\\d{2}-\\d{2}') THEN try_cast(substr(d, 1, 10) AS DATE) END,
    CASE WHEN regexp_matches(d, '^\\d{4}/\\d{2}/\\d{2}$') THEN try_cast(replace(d, '/', '-') AS DATE) END,
    CASE WHEN regexp_matches(d, '^\\d{8}$') THEN try_cast(substr(d, 1, 4) || '-' || substr(d, 5, 2) || '-' || substr(d, 7, 2) AS DATE) END,
    CASE WHEN regexp_matches(d, '^\\d{2}-[A-Z][a-z]{2}-\\d{4}$') THEN CAST(try_strptime(d, '%d-%b-%Y') AS DATE) END) AS day
  FROM text),
weeks AS (
  SELECT station_id, CAST(floor((day - DATE '1979-12-31') / 7) AS BIGINT) AS w, count(*) AS n FROM days
  WHERE station_id IS NOT NULL AND day BETWEEN DATE '1979-12-31' AND DATE '2005-12-31' GROUP BY 1, 2),
spine AS (SELECT station_id, unnest(range(min(w), max(w) + 1)) AS w FROM weeks GROUP BY 1)
"""


def _p3_grid(amount: str, reset: str, columns: str) -> str:
    """Every pair of consecutive readings, spread over the weeks it touches."""
    return f"""
WITH held AS (
  SELECT reading_id, arg_max(struct_pack(s := station_id, d := "Date", v := "S12.C.D.S333"), received_at) AS h
  FROM sumflow GROUP BY reading_id),
text AS (SELECT upper(trim(h.s)) AS station_id, trim(h.d) AS d, h.v AS v, reading_id AS o FROM held WHERE h.v IS NOT NULL AND NOT isnan(h.v)),
timed AS (SELECT station_id, o, v, coalesce(
    CASE WHEN regexp_matches(d, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN coalesce(try_cast(d AS TIMESTAMP), try_cast(substr(d, 1, 10) AS TIMESTAMP)) END,
    CASE WHEN regexp_matches(d, '^\\d{{4}}/\\d{{2}}/\\d{{2}}$') THEN try_cast(replace(d, '/', '-') AS TIMESTAMP) END,
    CASE WHEN regexp_matches(d, '^\\d{{8}}$') THEN try_cast(substr(d, 1, 4) || '-' || substr(d, 5, 2) || '-' || substr(d, 7, 2) AS TIMESTAMP) END,
    CASE WHEN regexp_matches(d, '^\\d{{2}}-[A-Z][a-z]{{2}}-\\d{{4}}$') THEN try_strptime(d, '%d-%b-%Y') END) AS t FROM text),
r AS (SELECT * FROM timed WHERE station_id IS NOT NULL AND CAST(t AS DATE) BETWEEN DATE '1979-12-31' AND DATE '2005-12-31'),
n AS (SELECT *, lead(t) OVER w AS t2, lead(v) OVER w AS v2 FROM r WINDOW w AS (PARTITION BY station_id ORDER BY t, o, v)),
s AS (SELECT *, epoch(t2) - epoch(t) AS secs, {amount} AS amount, {reset} AS reset, (epoch(t2) - epoch(t)) / 3600.0 <= 1080 AS trusted FROM n WHERE t2 IS NOT NULL),
c AS (SELECT *, unnest(range(CAST(floor((CAST(t AS DATE) - DATE '1979-12-31') / 7) AS BIGINT), CAST(floor((CAST(t2 AS DATE) - DATE '1979-12-31') / 7) AS BIGINT) + 1)) AS w FROM s),
p AS (SELECT *, least(epoch(t2), epoch(TIMESTAMP '1979-12-31') + (w + 1) * 604800) - greatest(epoch(t), epoch(TIMESTAMP '1979-12-31') + w * 604800) AS lap FROM c),
g AS (
  SELECT station_id, w, sum(CASE WHEN trusted THEN amount * CASE WHEN secs > 0 THEN lap / secs ELSE 1 END END) AS amount, sum(CASE WHEN trusted THEN lap ELSE 0 END) / 3600.0 AS covered,
    sum(CASE WHEN trusted THEN 0 ELSE lap END) / 3600.0 AS uncovered, sum(CASE WHEN w = CAST(floor((CAST(t2 AS DATE) - DATE '1979-12-31') / 7) AS BIGINT) THEN reset ELSE 0 END) AS resets
  FROM p GROUP BY 1, 2),
k AS (SELECT station_id, CAST(floor((CAST(t AS DATE) - DATE '1979-12-31') / 7) AS BIGINT) AS w, count(*) AS n FROM r GROUP BY 1, 2),
a AS (SELECT station_id, w, coalesce(n, 0) AS n, amount, coalesce(covered, 0) AS covered, coalesce(uncovered, 0) AS uncovered, coalesce(resets, 0) AS resets FROM g FULL JOIN k USING (station_id, w))
SELECT station_id, strftime(DATE '1979-12-31' + CAST(7 * w AS INTEGER), '%Y-%m-%d') AS week_start, n AS n_readings, CAST(amount AS FLOAT) AS amount, {columns},
  round(covered, 4) AS covered_hours, CASE WHEN n > 0 THEN 'observed' WHEN uncovered > 0 THEN 'uncovered' ELSE 'filled' END AS status FROM a"""


ORACLE = {
    "p1_impossible": """
WITH f AS (SELECT reading_id AS i, arg_max(struct_pack(s := station_id, v := "S12.C.D.S333"), received_at) AS h FROM sumflow GROUP BY reading_id),
y AS (SELECT obs_id AS i, arg_max(struct_pack(s := site_id, t := "year", a := anchovy, b := sio_sst), loaded_at) AS h FROM sardine_anchovy_sst GROUP BY obs_id)
SELECT 'S12.C.D.S333' AS field, i AS record_id FROM f WHERE i IS NOT NULL AND h.s IS NOT NULL AND NOT isnan(h.v) AND (h.v < 0 OR h.v > 2e6)
UNION ALL SELECT 'anchovy', i FROM y WHERE i IS NOT NULL AND h.s IS NOT NULL AND h.t IS NOT NULL AND NOT isnan(h.a) AND (h.a < 0 OR h.a > 1e6)
UNION ALL SELECT 'sio_sst', i FROM y WHERE i IS NOT NULL AND h.s IS NOT NULL AND h.t IS NOT NULL AND NOT isnan(h.b) AND (h.b < -2.5 OR h.b > 42)""",
    "p3_found": _P3_BASE + """
SELECT s.station_id, strftime(DATE '1979-12-31' + CAST(7 * s.w AS INTEGER), '%Y-%m-%d') AS week_start
FROM spine s ANTI JOIN weeks k ON s.station_id = k.station_id AND s.w = k.w""",
    "p3_weekly": _p3_grid("(v + v2) / 2 * (epoch(t2) - epoch(t)) / 3600.0", "0", "CAST(amount / nullif(covered, 0) AS FLOAT) AS mean_rate, round(uncovered, 4) AS uncovered_hours"),
    "p3_counter": _p3_grid("CASE WHEN v2 < v THEN v2 ELSE v2 - v END", "CAST(v2 < v AS BIGINT)", "CAST(resets AS BIGINT) AS resets"),
}
