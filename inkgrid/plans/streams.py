"""Queries that run a stream to its end, and the SQL of the same outcome over the whole table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.tables import read
from ..streaming import timed
from .registry import query

#: No message of the tables is later than this behind another.
DELAY = "60 days"


@query("""WITH m AS (SELECT user_id, ts, event_id, event_type AS k, 'r' || (event_id % 4) AS region, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL),
s AS (SELECT *, max(CASE WHEN k = 'signup' THEN n END) OVER u AS det, max(CASE WHEN k = 'error' THEN n END) OVER u AS err, max(CASE WHEN k = 'view' THEN n END) OVER r AS reg,
  min(CASE WHEN k = 'signup' THEN n END) OVER ua AS next_det, min(CASE WHEN k = 'error' THEN n END) OVER ua AS next_err, min(CASE WHEN k = 'view' THEN n END) OVER ra AS next_reg
  FROM m WINDOW u AS (PARTITION BY user_id ORDER BY n), r AS (PARTITION BY user_id, region ORDER BY n), ua AS (PARTITION BY user_id ORDER BY n DESC), ra AS (PARTITION BY user_id, region ORDER BY n DESC)),
e AS (SELECT *, CASE WHEN reg IS NOT NULL AND reg > coalesce(det, 0) THEN 'at_once' WHEN det IS NOT NULL AND region <> 'r3' AND coalesce(err, 0) < det THEN 'pending' ELSE 'rejected' END AS state, least(next_det, next_err, next_reg) AS decides FROM s WHERE k IN ('click', 'purchase'))
SELECT e.user_id::VARCHAR AS session, e.event_id AS edit, e.region, CASE WHEN state <> 'pending' THEN state WHEN decides = next_reg THEN 'waited' WHEN decides = next_err THEN 'rejected' ELSE 'dropped' END AS outcome,
  CASE WHEN state = 'pending' THEN (epoch_us(d.ts) - epoch_us(e.ts)) // 1000 ELSE 0 END AS delay_ms
FROM e LEFT JOIN m d ON state = 'pending' AND d.user_id = e.user_id AND d.n = decides WHERE state <> 'pending' OR decides IS NOT NULL""")
def s06_wait_gate_stream(spark, sf_dir):
    """Edits that wait for their region, as a stream in event time: applied at once, after waiting, rejected or dropped."""
    e = read(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "signup", "detected").when(F.col("event_type") == "view", "region").when(F.col("event_type") == "error", "error").otherwise("edit")
    body = F.to_json(F.struct(kind.alias("kind"), F.concat(F.lit("r"), (F.col("event_id") % 4).cast("string")).alias("region"), F.when(kind == "detected", F.array(*[F.lit(f"r{i}") for i in range(3)])).alias("names")))
    messages = e.select(F.col("user_id").cast("string").alias("session"), F.col("ts").alias("at"), F.col("event_id").alias("id"), body.alias("body"))
    return timed.stream_table(messages, timed.Gate(), DELAY)


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE user_id IS NOT NULL), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM g)
SELECT user_id::VARCHAR AS session, arg_max(event_id, (ts, event_id)) AS id, count(*)::BIGINT AS burst FROM b GROUP BY user_id, b.burst""")
def s12_quiet_period_stream(spark, sf_dir):
    """The last message of each burst, sent by a timer when its session has been quiet for half an hour of event time."""
    e = read(spark, sf_dir, "events")
    messages = e.select(F.col("user_id").cast("string").alias("session"), F.col("ts").alias("at"), F.col("event_id").alias("id"), F.lit("{}").alias("body"))
    return timed.stream_table(messages, timed.Quiet(30 * 60_000), DELAY)


@query("""WITH t AS (SELECT conv_id, turn, (length(text) % 40)::BIGINT AS x, (20 + length(text) % 70)::BIGINT AS w, (24 * turn + conv_id % 5)::BIGINT AS y, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
k AS (SELECT *, y - lag(y) OVER (PARTITION BY conv_id ORDER BY y) AS step FROM t WHERE (conv_id + turn) % 11 <> 0),
a AS (SELECT conv_id, count(*)::BIGINT AS lines, any_value(n) AS n, round(var_pop(x), 9) AS l, round(var_pop(x + w / 2), 9) AS c, round(var_pop(x + w), 9) AS r, median(step)::DOUBLE AS line_height FROM k GROUP BY conv_id)
SELECT conv_id::VARCHAR AS session, lines, CASE WHEN lines < 2 OR (l <= c AND l <= r) THEN 'left' WHEN c <= r THEN 'center' ELSE 'right' END AS alignment, line_height, lines = n AS complete FROM a""")
def s14_block_barrier_stream(spark, sf_dir):
    """Layout of a block once all its members are in, by a timer where some never come."""
    size = F.length("text")
    t = read(spark, sf_dir, "conversations").select("conv_id", "turn", (size % 40).alias("x"), (20 + size % 70).alias("w"), (24 * F.col("turn") + F.col("conv_id") % 5).alias("y"), F.count("*").over(Window.partitionBy("conv_id")).alias("n"))
    at = F.timestamp_seconds(1_700_000_000 + F.col("turn") % 60 + 60 * (F.col("conv_id") % 10_000))
    kept = t.filter((F.col("conv_id") + F.col("turn")) % 11 != 0)
    messages = kept.select(F.col("conv_id").cast("string").alias("session"), at.alias("at"), F.col("turn").cast("long").alias("id"), F.to_json(F.struct("x", "y", "w", "n")).alias("body"))
    return timed.stream_table(messages, timed.Barrier(), DELAY)
