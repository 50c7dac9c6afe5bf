"""Streaming jobs run over the log files that exist now, and what their tables hold afterwards."""
import uuid

from pyspark.sql import functions as F

from studyloom.functions.text import token_estimate
from studyloom.plans.memory import WRONG_SQL
from studyloom.plans.registry import query
from studyloom.session import checkpoint_dir
from studyloom.streaming import jobs as J


#: User of the rows that close a log: later than every gap and watermark, each in a delivery of its own.
NOBODY = -1


def delivered(v, job, keys, mode="update", deliveries=4, again=None, **sink):
    """What a job's table holds after the log has come in several deliveries, in order of time.

    Each delivery is written to the log folder and the job runs on from its checkpoint, as it would on a schedule. With ``again`` (an interval) a
    delivery brings the rows of that time before it once more. In append mode closing rows move the watermark past the last attempt, so that
    whatever waits for it is written; nothing is computed in batch.
    """
    base = f"{checkpoint_dir(v.spark)}/stream-{uuid.uuid4().hex}"
    step = lambda: J.write_changes(job(J.read_log(v.spark, base + "/log", "*.parquet", 1_000_000)), base + "/table", base + "/state", keys, mode, **sink)
    events = v.table("events").selectExpr(*[f"cast({c.split()[0]} as {c.split()[1]}) as {c.split()[0]}" for c in J.EVENTS.split(", ")])
    cuts = events.selectExpr(f"percentile_approx(unix_micros(cast(ts as timestamp)), array({', '.join(str(i / deliveries) for i in range(1, deliveries))})) as c", "max(ts) as last").first()
    micros = lambda x: F.expr(f"unix_micros(cast({x} as timestamp))")
    bounds = [None, *sorted(set(cuts.c or [])), None]
    for low, high in zip(bounds, bounds[1:]):
        part = events.where(micros(f"ts + interval {again}" if again else "ts") > low) if low is not None else events
        (part.where(micros("ts") <= high) if high is not None else part).write.mode("append").parquet(base + "/log")
        step()
    for days in (10, 20) if mode == "append" else ():
        row = v.spark.range(1).select(F.lit(NOBODY - days).cast("bigint").alias("event_id"), (F.lit(cuts.last) + F.expr(f"interval {days} days")).cast("timestamp_ntz").alias("ts"),
                                      F.lit(NOBODY).cast("bigint").alias("user_id"), F.lit("").alias("event_type"), F.lit(0.0).alias("value"), F.lit("{}").alias("props"))
        row.write.mode("append").parquet(base + "/log")
        step()
    return J.latest(v.spark, base + "/table", keys)


@query("stream_daily_activity", "SELECT day, count(*) AS questions, sum(correct)::BIGINT AS correct FROM v_attempts GROUP BY day")
def _(v):
    return delivered(v, lambda log: J.daily_activity(J.attempts_of(log)), ["day"], ranges=1)


@query("stream_wrongbook", WRONG_SQL)
def _(v):
    return delivered(v, lambda log: J.wrongbook(J.attempts_of(log)), ["user_id", "qid"])


@query("stream_sessions", """WITH g AS (SELECT *, CASE WHEN created_at < lag(created_at) OVER (PARTITION BY user_id ORDER BY created_at) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM v_attempts),
    s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY created_at) AS k FROM g), t AS (SELECT user_id, k, count(*) AS total, sum(correct)::BIGINT AS correct, sum(seconds)::BIGINT AS duration, min(created_at) AS b, max(created_at) AS e FROM s GROUP BY 1,2)
    SELECT user_id, strftime(b,'%Y-%m-%d %H:%M:%S') AS start, total, correct, duration FROM t""")
def _(v):
    out = delivered(v, lambda log: J.sessions(J.attempts_of(log)), ["user_id", "start", "end"], "append").where(F.col("user_id") != NOBODY)
    return out.select("user_id", F.date_format(J.as_wall(F.col("start")), "yyyy-MM-dd HH:mm:ss").alias("start"), "total", "correct", "duration")


@query("stream_last_write", "SELECT user_id, qid, max(id) AS id, arg_max(correct,id) AS correct, arg_max(module,id) AS module FROM v_attempts GROUP BY 1,2")
def _(v):
    """Deliveries overlap by six hours: repeated rows change nothing."""
    return delivered(v, lambda log: J.last_write(J.attempts_of(log)), ["user_id", "qid"], "append", again="6 hours", order="id").where(F.col("user_id") != NOBODY)


@query("stream_usage_cap", """SELECT user_id, date_trunc('month',day)::DATE AS month, sum(input_tokens+output_tokens)::BIGINT AS tokens, CASE WHEN sum(input_tokens+output_tokens)>=3000 THEN 1 ELSE 0 END AS over_limit FROM v_usage GROUP BY 1,2""")
def _(v):
    """The turns come month by month; January is still open when February begins."""
    base = f"{checkpoint_dir(v.spark)}/stream-{uuid.uuid4().hex}"
    turns = v.table("conversations")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 60).cast("int"))
    for month in (1, 2):
        turns.where(F.month(day) == month).write.mode("append").parquet(base + "/log")
        c = v.spark.readStream.schema(turns.schema).parquet(base + "/log")
        u = c.select((F.col("conv_id") % 25).alias("user_id"), day.alias("day"), token_estimate(F.col("text")).alias("input_tokens"),
                     (F.length("text") % 500).cast("bigint").alias("output_tokens"))
        J.write_changes(J.usage_cap(u, 3000), base + "/table", base + "/state", ["user_id", "month"])
    return J.latest(v.spark, base + "/table", ["user_id", "month"])
