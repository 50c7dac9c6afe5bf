"""Structured Streaming over the attempt log: what the batch operators compute, kept up to date.

Every job reads new files of the log and merges its changes through ``foreachBatch`` into a keyed table (``sources/keyed.py``);
:func:`latest` reads the table's current rows. A batch that runs again merges the same rows again, so restarts are harmless. State
leaves every job in time, by the watermark; the wrong-question book alone keeps its questions, unless it is told when they may leave.
"""
import math
from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from studyloom.functions import fsrs as M
from studyloom.sources.keyed import KeyedTable


def as_instant(wall):
    """Wall-clock time (no zone) as the instant it names in UTC, whatever the session's zone: event time must be an instant."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), wall).cast("timestamp")


def as_wall(instant):
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))


EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_log(spark, folder, pattern="events*.parquet", per_trigger=1):
    """The log as a stream of files."""
    return (spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", pattern).parquet(folder))


def attempts_of(events):
    i, u = F.col("event_id"), F.col("user_id")
    return events.select(
        i.alias("id"), "user_id", F.get_json_object("props", "$.k").cast("bigint").alias("qid"), F.col("event_type").alias("module"),
        F.when((i * 7 + u * 3) % 10 < 5 + i % 3, 1).otherwise(0).cast("bigint").alias("correct"),
        F.floor("value").cast("bigint").alias("seconds"), as_instant(F.col("ts")).alias("created_at"), F.to_date("ts").alias("day"))


STORE = "spark.sql.streaming.stateStore.providerClass"


def write_changes(df, out, checkpoint, keys, mode="update", order=None, ranges=8):
    """Run over all files there are now and merge every micro-batch into the keyed table at ``out``; returns the ended query.

    State is kept by RocksDB, off the executors' heap. A query takes its settings when it starts; the session's own are put back.
    """
    spark = df.sparkSession
    table = KeyedTable(spark, out, keys, ranges)
    table.create(df.schema)
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = (df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
             .foreachBatch(lambda batch, n: KeyedTable(batch.sparkSession, out, keys, ranges).merge(batch, order)).start())
    finally:
        spark.conf.set(STORE, before) if before is not None else spark.conf.unset(STORE)
    q.awaitTermination()
    return q


def latest(spark, out, keys):
    """Current row per key."""
    return KeyedTable(spark, out, keys).read()


def daily_activity(attempts, late="1 day"):
    """Questions and right answers per day of event time."""
    w = F.window("created_at", "1 day")
    return (attempts.withWatermark("created_at", late).groupBy(w).agg(F.count("*").alias("questions"), F.sum("correct").alias("correct"))
            .select(F.to_date(as_wall(F.col("window.start"))).alias("day"), "questions", "correct"))


def sessions(attempts, gap="30 minutes", late="1 day"):
    """Totals of attempts that follow each other within ``gap``, per user. Closed sessions are appended."""
    w = F.session_window("created_at", gap)
    return (attempts.withWatermark("created_at", late).groupBy("user_id", w)
            .agg(F.count("*").alias("total"), F.sum("correct").alias("correct"), F.sum("seconds").alias("duration"))
            .select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "total", "correct", "duration"))


def last_write(attempts, late="1 day"):
    """Answers as they come, each once: a row delivered again within ``late`` of its time is dropped, and its trace with the watermark.

    Merged into a table keyed by user and question in the order of ``id``, this is the newest answer per key: the merge keeps the
    row of the largest id, whenever it comes, so the table needs no state of its own.
    """
    return (attempts.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["id"]).select("user_id", "qid", "id", "correct", "module"))


def usage_cap(usage, limit, late="32 days"):
    """Month-to-date tokens per user and the over-limit flag.

    The event time is the end of the month, so a month leaves the state as a whole, once a row has come whose month ends more than
    ``late`` after it (the default keeps the month before the newest one open); rows of a closed month are dropped.
    """
    tokens = F.sum(F.col("input_tokens") + F.col("output_tokens"))
    ends = as_instant(F.date_add(F.last_day("day"), 1).cast("timestamp_ntz"))
    return (usage.withColumn("month_end", ends).withWatermark("month_end", late).groupBy("user_id", "month_end").agg(tokens.alias("tokens"))
            .select("user_id", F.trunc(F.date_sub(F.to_date(as_wall(F.col("month_end"))), 1), "month").alias("month"), "tokens",
                    F.when((F.lit(limit) > 0) & (F.col("tokens") >= limit), 1).otherwise(0).alias("over_limit")))


# ---- the wrong-question book as keyed state

_FIX = M.D_B[1] / (1 - M.D_A[1])


def _stability(s, d, elapsed, g):
    if elapsed < 1:
        out = s * M.SAME_DAY[g]
    else:
        r = (1 + M.FACTOR * elapsed / s) ** M.DECAY
        if g == M.AGAIN:
            long_term = M.W[11] * d ** -M.W[12] * ((s + 1) ** M.W[13] - 1) * math.exp(M.W[14] * (1 - r))
            out = min(long_term, s / math.exp(M.W[17] * M.W[18]))
        else:
            hard = M.W[15] if g == M.HARD else 1.0
            out = s * (1 + math.exp(M.W[8]) * (11 - d) * s ** -M.W[9] * (math.exp(M.W[10] * (1 - r)) - 1) * hard)
    return max(M.MIN_STABILITY, out)


def _good_days(s, d, elapsed, seed):
    import hashlib
    days = []
    for g in (M.HARD, M.GOOD):
        n = min(M.MAX_INTERVAL, max(1, round(_stability(s, d, elapsed, g) / M.FACTOR * (0.9 ** (1 / M.DECAY) - 1))))
        if n >= 3:
            h = int(hashlib.md5((seed + str(g)).encode()).hexdigest()[:8], 16) / 0xFFFFFFFF
            delta = max(1, round(n * 0.05))
            n = n - delta + round(h * 2 * delta)
        days.append(n)
    return max(days)


EPOCH = date(1970, 1, 1)


def fold_day(state, qid, day, right_first, wrong, master_days=30):
    """One day summary on the state (wrong_count, stage, next, mastered, s, d, last, reps); days count from 1970."""
    n, stage, nxt, mastered, s, d, last, reps = state
    if right_first and n and not mastered and nxt <= day:
        days = _good_days(s, d, day - last, f"{qid}{(EPOCH + timedelta(days=day)).isoformat()}")
        s, d = _stability(s, d, day - last, M.GOOD), min(10.0, max(1.0, d * M.D_A[3] + M.D_B[3]))
        stage, nxt, mastered, last, reps = stage + 1, day + days, int(days >= master_days), day, reps + 1
    if wrong:
        if n:
            s, d = _stability(s, d, day - last, M.AGAIN), min(10.0, max(1.0, d * M.D_A[1] + M.D_B[1]))
        else:
            s, d = M.INIT_S[1], M.INIT_D[1]
        s = max(M.MIN_STABILITY, s * M.SAME_DAY[1] ** (wrong - 1))
        d = _FIX + (d - _FIX) * M.D_A[1] ** (wrong - 1)
        n, stage, nxt, mastered, last, reps = n + wrong, 0, day + 1, 0, day, reps + wrong
    return n, stage, nxt, mastered, s, d, last, reps


BOOK = ("user_id bigint, qid bigint, wrong_count bigint, stage bigint, next_review date, mastered bigint, stability double, "
        "difficulty double, last_review date, reps bigint")


_NAMES = [c.split()[0] for c in BOOK.split(", ")]
DAY_MS = 86_400_000
#: A question in the state of its bucket; ``nulls`` tells which key columns are NULL.
HELD = np.dtype([(c, "i8") for c in ("user_id", "qid", "nulls", "n", "stage", "nxt", "mastered")] + [("s", "f8"), ("d", "f8"), ("last", "i8"), ("reps", "i8")])
_NEW = (0, 0, 0, 0, 0.0, 0.0, 0, 0)


def _days_of(frames):
    """(user_id, qid, nulls) -> day -> (first right id, first wrong id, wrong answers), made while the rows stream by."""
    out = {}
    for pdf in frames:
        for user_id, qid, nulls, i, day, ok in zip(*[pdf[c].tolist() for c in ("user_id", "qid", "nulls", "id", "dayno", "correct")]):
            days = out.setdefault((user_id, qid, nulls), {})
            first_right, first_wrong, wrong = days.get(day, (None, None, 0))
            if ok:
                first_right = i if first_right is None else min(first_right, i)
            else:
                first_wrong, wrong = i if first_wrong is None else min(first_wrong, i), wrong + 1
            days[day] = first_right, first_wrong, wrong
    return out


def _book(idle):
    """Fold of a bucket of questions: those that were wrong once are held, so that one which is wrong again, however late, goes on from its row.

    Only with ``idle`` mastered ones leave after that many days of event time; the table keeps their last row, and one that is answered
    wrong again later starts as a new one.
    """
    def fold(key, frames, state):
        held = np.frombuffer(bytes(state.get[0]), HELD) if state.exists else np.zeros(0, HELD)
        changed = []
        if not state.hasTimedOut:
            at = {k: i for i, k in enumerate(zip(*[held[c].tolist() for c in ("user_id", "qid", "nulls")]))}
            held, new = held.copy(), []
            for k, days in _days_of(frames).items():
                i = at.get(k)
                st = _NEW if i is None else held[i].item()[3:]
                for day in sorted(days):
                    first_right, first_wrong, wrong = days[day]
                    qid = None if k[2] & 1 else k[1]
                    st = fold_day(st, qid, day, first_right is not None and (first_wrong is None or first_right < first_wrong), wrong)
                if st[0]:
                    changed.append((*k, *st))
                    if i is None:
                        new.append(changed[-1])
                    else:
                        held[i] = changed[-1]
            held = np.concatenate([held, np.array(new, HELD)])
        if idle is not None:
            held = held[(held["mastered"] == 0) | ((held["last"] + 1 + idle) * DAY_MS > state.getCurrentWatermarkMs())]
        if len(held):
            state.update((held.tobytes(),))
            if idle is not None and held["mastered"].any():
                state.setTimeoutTimestamp(int((held["last"][held["mastered"] == 1].min() + 1 + idle) * DAY_MS))
        elif state.exists:
            state.remove()
        if changed:
            day = lambda n: EPOCH + timedelta(days=n)
            out = pd.DataFrame([(u, q, n, stage, day(nxt), mastered, round(s, 4), round(d, 4), day(last), reps)
                                for u, q, _, n, stage, nxt, mastered, s, d, last, reps in changed], columns=_NAMES)
            for c, bit in (("user_id", 2), ("qid", 1)):
                out[c] = pd.array([None if x[2] & bit else v for x, v in zip(changed, out[c].tolist())], "Int64")
            yield out
    return fold


def wrongbook(attempts, idle=None, late="1 day", buckets=2048):
    """The wrong-question book kept live. Files arrive in id order; rows inside a batch may come in any order.

    Every answer counts, whatever its time: the state is as large as the table, which has a row for the same questions. Only with ``idle`` (days) is
    there a watermark: mastered questions that nobody answers leave, and answers over ``late`` behind the newest one are dropped.

    Questions are dealt by hash to ``buckets`` that share a call and a state row, as a call costs far more than the fold of one
    question. A bucket should fit a task many times over; their number stays as it is for the life of a checkpoint.
    """
    null = lambda c: F.col(c).isNull().cast("int")
    timed = attempts if idle is None else attempts.withWatermark("created_at", late)
    d = timed.select(
        F.pmod(F.xxhash64("user_id", "qid"), F.lit(buckets)).cast("int").alias("bucket"), F.coalesce("user_id", F.lit(0)).alias("user_id"),
        F.coalesce("qid", F.lit(0)).alias("qid"), (2 * null("user_id") + null("qid")).alias("nulls"), "id", "correct",
        F.datediff("day", F.lit("1970-01-01").cast("date")).cast("bigint").alias("dayno"), "created_at")
    return d.groupBy("bucket").applyInPandasWithState(_book(idle), BOOK, "held binary", "update", "NoTimeout" if idle is None else "EventTimeTimeout")
