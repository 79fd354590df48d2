"""As-of joins and range vectors by step, without a range join and without one task for a busy key.

``as_of`` gives each row the latest row of the other side with its key at or before its time.
Both sides are one list by key and time; rows are cut into spans of time, each span finds
what lies within it, and the last row of all earlier spans comes from a list with one row a
span.  So a task holds a span of a key and never all of it.

``range_vectors`` gives, for every key and step, the rows of the ``over`` steps up to it, the empty
ones too: rows are first added up by step, and a frame over the steps adds those sums.

Rows with a null key or time match nothing.  Of several rows at one time the largest value is the
latest.  A row without an earlier one has nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.tables import table


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, values: list[str], span: str = "1 day") -> DataFrame:
    """left with the columns ``values`` and ``as_of_at`` of the latest right row of its key at or before its time."""
    span_of = F.window(F.col(at).cast("timestamp"), span)["start"]
    latest = F.struct(F.col(at).alias("as_of_at"), *values)
    found = right.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, at, span_of.alias("_span"), latest.alias("_row"))
    mine = left.withColumn("_left", F.struct(*left.columns)).withColumn("_span", span_of).select(key, at, "_span", "_left")
    both = mine.withColumn("_row", F.lit(None).cast(found.schema["_row"].dataType)).unionByName(found.withColumn("_left", F.lit(None).cast(mine.schema["_left"].dataType)))
    # a right row at the same time comes first
    order = Window.partitionBy(key, "_span").orderBy(at, F.col("_left").isNotNull(), "_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = both.withColumn("_within", F.last("_row", ignorenulls=True).over(order)).where("_left IS NOT NULL")
    spans = found.groupBy(key, "_span").agg(F.max("_row").alias("_last")).unionByName(mine.select(key, "_span").distinct().withColumn("_last", F.lit(None).cast(found.schema["_row"].dataType)))
    spans = spans.groupBy(key, "_span").agg(F.max("_last").alias("_last"))
    before = Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select(key, "_span", F.last("_last", ignorenulls=True).over(before).alias("_carried"))  # a row for each span
    out = within.join(carried, [key, "_span"], "left").withColumn("_hit", F.coalesce("_within", "_carried"))
    return out.select("_left.*", *[F.col("_hit")[v].alias(v) for v in values], F.col("_hit")["as_of_at"].alias("as_of_at"))


def range_vectors(events: DataFrame, key: str, at: str, value: Column, step_seconds: int, over: int) -> DataFrame:
    """(key, step_end, n, per_second, total, most): at every step of a key's life, over the last ``over`` steps."""
    step = F.floor(F.unix_micros(F.col(at).cast("timestamp")) / (step_seconds * 1_000_000)).cast("long")
    sums = events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(F.col(key).alias("key"), step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max(value).alias("most"))
    life = sums.groupBy("key").agg(F.min("step").alias("first"), F.max("step").alias("last"))
    steps = life.select("key", F.explode(F.sequence("first", "last")).alias("step"))
    frame = Window.partitionBy("key").orderBy("step").rangeBetween(-(over - 1), 0)
    rows = steps.join(sums, ["key", "step"], "left")
    n = F.coalesce(F.sum("n").over(frame), F.lit(0))
    ends = F.timestamp_seconds((F.col("step") + 1) * step_seconds)
    return rows.select("key", ends.alias("step_end"), n.alias("n"), (n / (step_seconds * over)).alias("per_second"), F.sum("total").over(frame).alias("total"), F.max("most").over(frame).alias("most"))


def q_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last purchase of its user at or before each click."""
    events = table(spark, sf_dir, "events")
    clicks = events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    bought = events.where("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("rate"), F.col("event_id").alias("purchase"))
    return as_of(clicks, bought, "user_id", "ts", ["rate", "purchase"]).select("event_id", "user_id", "rate", "purchase")


AS_OF_SQL = """
SELECT c.event_id, c.user_id, p.value AS rate, p.event_id AS purchase FROM (SELECT * FROM events WHERE event_type = 'click') c
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON c.user_id = p.user_id AND c.ts >= p.ts"""


def q_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each type over the last six hours, at every hour."""
    out = range_vectors(table(spark, sf_dir, "events"), "event_type", "ts", F.col("value"), 3600, 6)
    return out.select(F.col("key").alias("event_type"), F.unix_seconds("step_end").alias("step_end"), "n", F.round("per_second", 9).alias("per_second"), F.round("total", 2).alias("total"), "most")


RANGES_SQL = """
WITH e AS (SELECT event_type, epoch_us(ts) // 3600000000 AS step, value FROM events),
steps AS (SELECT event_type, unnest(range(min(step), max(step) + 1)) AS step FROM e GROUP BY event_type)
SELECT s.event_type, (s.step + 1) * 3600 AS step_end, count(e.step) AS n, round(count(e.step) / 21600e0, 9) AS per_second, round(sum(value), 2) AS total, max(value) AS most
FROM steps s LEFT JOIN e ON e.event_type = s.event_type AND e.step BETWEEN s.step - 5 AND s.step GROUP BY s.event_type, s.step"""

QUERIES = {"rate_as_of": q_as_of, "range_vectors": q_ranges}
ORACLES = {"rate_as_of": AS_OF_SQL, "range_vectors": RANGES_SQL}
