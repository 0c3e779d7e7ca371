"""Queries p2 and p4 to p8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasefold.operators.latest import latest_rows
from phasefold.session import materialize

from .leaks import leaked_spans, remove_leaks
from .residue import find_residue
from .splits import assign_splits, tie_records
from .tokens import encode
from .topn import top_n
from .vectors import mutual, similar

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def _ties(spark: SparkSession, d: str) -> DataFrame:
    return tie_records(spark.read.parquet(f"{d}/prediction_inputs.parquet"), "input_id", ["trainRuns", "testRuns"], "observer_code")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _ties(spark, d).where("first < record").select(F.col("first").alias("first_id"), F.col("record").alias("input_id"))


def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    """input_id and split of every record."""
    return assign_splits(_ties(spark, d), SHARES).select(F.col("record").alias("input_id"), "split")


def p2_shares(spark: SparkSession, d: str) -> DataFrame:
    """Of each split whether its share is as near its target as the ties allow, and whether ties stay whole."""
    ties = materialize(_ties(spark, d))
    got = materialize(assign_splits(ties, SHARES))
    placed = got.join(ties, "record")
    crossing = placed.groupBy("first").agg(F.count_distinct("split").alias("n")).agg(F.max("n").alias("most"))
    largest = ties.groupBy("first").count().agg(F.max("count").alias("largest"))
    total = got.agg(F.count("*").alias("records"), F.count_distinct("record").alias("ids"))
    each = got.groupBy("split").agg(F.count("*").alias("n"))
    target = F.create_map(*[F.lit(x) for kv in SHARES.items() for x in kv])[F.col("split")]
    one = each.join(F.broadcast(crossing.join(largest).join(total)))  # one row of figures
    # whole components: a split may miss its target by the largest of them, or by 1 % of the records
    near = F.abs(F.col("n") - target * F.col("records")) <= F.greatest(F.col("largest"), F.col("records") * 0.01)
    return one.select("split", near.alias("near"), (F.col("most") == 1).alias("whole"), "records", "ids")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    keys = ["testRuns", "testRows", "trainRuns", "trainRows"]
    rows = latest_rows(spark.read.parquet(f"{d}/neighbor_candidates.parquet"), keys, "loaded_at", ["distance"])
    other = rows.where(~((F.col("testRuns") == F.col("trainRuns")) & (F.col("testRows") == F.col("trainRows"))))
    settings = spark.read.parquet(f"{d}/simplex_result.parquet").where("testRuns IS NOT NULL")
    k = F.when(F.col("knn") > 0, F.col("knn")).otherwise(F.col("embedDimensions") + 1)
    limits = settings.groupBy("testRuns").agg(F.max(k).alias("n"))
    return top_n(other, keys[:2], "distance", keys[2:], limits, "testRuns", "n").select(*keys)


def p7_spans(spark: SparkSession, d: str) -> DataFrame:
    """Every leaked span with its length and coverage."""
    return leaked_spans(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/heldout_items.parquet"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_spans(spark, d).select("doc_id", "item_id").distinct()


def p7_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Every document's decoded text without the spans that leaked."""
    return remove_leaks(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/heldout_items.parquet"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return find_residue(spark.read.parquet(f"{d}/documents.parquet")).distinct()


BLOCK_COLUMNS = [f"{c}_t{lag}" for c in "xyz" for lag in ("", "-1", "-2")]


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def p5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest of every complete vector, by collection."""
    block = similar(spark.read.parquet(f"{d}/block_3sp.parquet"), "state_id", F.array(*[F.col(f"`{c}`") for c in BLOCK_COLUMNS]), 9)
    train = similar(spark.read.parquet(f"{d}/train_states.parquet"), "state_id", F.col("trainStates"), 24)
    both = block.withColumn("collection", F.lit("block_3sp")).unionByName(train.withColumn("collection", F.lit("train_states")))
    return both.select("collection", "id", "rank", "other", F.round("distance", 6).alias("distance"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    block = similar(spark.read.parquet(f"{d}/block_3sp.parquet"), "state_id", F.array(*[F.col(f"`{c}`") for c in BLOCK_COLUMNS]), 9, within=0.02)
    train = similar(spark.read.parquet(f"{d}/train_states.parquet"), "state_id", F.col("trainStates"), 24, within=0.6)
    found = [mutual(block, 0.02).withColumn("collection", F.lit("block_3sp")), mutual(train, 0.6).withColumn("collection", F.lit("train_states"))]
    return found[0].unionByName(found[1]).select("collection", "first_id", "second_id")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(spark.read.parquet(f"{d}/documents.parquet"), _tokenizer("byte_bpe_50k.json"))


QUERIES = {"p5_found": p5_found, "p5_neighbours": p5_neighbours, "p6_ids": p6_ids, "p2_found": p2_found, "p2_splits": p2_splits, "p2_shares": p2_shares, "p4_found": p4_found, "p7_found": p7_found, "p7_spans": p7_spans, "p7_cleaned": p7_cleaned, "p8_found": p8_found}

_P5 = """
WITH b AS (SELECT 'block_3sp' AS collection, state_id AS id, min([x_t, "x_t-1", "x_t-2", y_t, "y_t-1", "y_t-2", z_t, "z_t-1", "z_t-2"]) AS v
  FROM block_3sp WHERE state_id IS NOT NULL AND NOT list_bool_or(list_transform([x_t, "x_t-1", "x_t-2", y_t, "y_t-1", "y_t-2", z_t, "z_t-1", "z_t-2"], lambda e: e IS NULL OR NOT isfinite(e))) GROUP BY state_id),
t AS (SELECT 'train_states' AS collection, state_id AS id, min(trainStates) AS v FROM train_states
  WHERE state_id IS NOT NULL AND len(trainStates) = 24 AND NOT list_bool_or(list_transform(trainStates, lambda e: e IS NULL OR NOT isfinite(e))) GROUP BY state_id),
c AS (SELECT * FROM b UNION ALL SELECT * FROM t),
p AS (SELECT x.collection, x.id, y.id AS other, list_distance(x.v, y.v) AS d FROM c x JOIN c y ON x.collection = y.collection AND x.id <> y.id),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY collection, id ORDER BY d, other) AS rank FROM p) WHERE rank <= 5)
"""

ORACLE = {
    "p2_found": r"""
WITH RECURSIVE r AS (
  SELECT DISTINCT input_id AS i, trainRuns AS a, testRuns AS b,
    CASE WHEN regexp_matches(observer_code, '[0-9]') THEN upper(regexp_replace(observer_code, '[^\p{L}]', '', 'g')) || ':' ||
      regexp_replace(regexp_replace(observer_code, '[^0-9]', '', 'g'), '^0+', '') END AS p
  FROM prediction_inputs WHERE input_id IS NOT NULL),
k AS (SELECT i, 'r' || a AS k FROM r WHERE a IS NOT NULL UNION SELECT i, 'r' || b FROM r WHERE b IS NOT NULL UNION SELECT i, 'p' || p FROM r WHERE p IS NOT NULL),
e AS (SELECT DISTINCT x.i AS a, y.i AS b FROM k x JOIN k y USING (k)),
c(i, m) AS (SELECT a, b FROM e UNION SELECT e.a, c.m FROM e JOIN c ON e.b = c.i)
SELECT min(m) AS first_id, i AS input_id FROM c GROUP BY i HAVING min(m) < i""",
    "p2_shares": """
SELECT s.split, TRUE AS near, TRUE AS whole, n AS records, n AS ids
FROM (VALUES ('train'), ('validation'), ('test')) s(split), (SELECT count(DISTINCT input_id) AS n FROM prediction_inputs)""",
    "p5_found": _P5 + """
SELECT collection, least(id, other) AS first_id, greatest(id, other) AS second_id FROM n
WHERE d <= CASE collection WHEN 'block_3sp' THEN 0.02 ELSE 0.6 END GROUP BY ALL HAVING count(*) = 2""",
    "p5_neighbours": _P5 + "SELECT collection, id, CAST(rank AS INTEGER) AS rank, other, round(d, 6) AS distance FROM n",
    "p4_found": """
WITH held AS (
  SELECT testRuns, testRows, trainRuns, trainRows, arg_max(struct_pack(d := distance), loaded_at).d AS d
  FROM neighbor_candidates GROUP BY ALL),
ok AS (SELECT * FROM held WHERE isfinite(d) AND NOT (testRuns = trainRuns AND testRows = trainRows)),
k AS (SELECT testRuns, CASE WHEN knn > 0 THEN knn ELSE embedDimensions + 1 END AS n FROM simplex_result),
ranked AS (
  SELECT ok.*, n, row_number() OVER (PARTITION BY testRuns, testRows ORDER BY d, trainRuns, trainRows) AS rank
  FROM ok JOIN k USING (testRuns))
SELECT testRuns, testRows, trainRuns, trainRows FROM ranked WHERE rank <= n""",
}
