"""Aggregations over the attempt log, study log, cards and bank."""
from decimal import Decimal

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from studyloom.functions.numbers import count_if, half_even, half_up, lookup, pack_map, pct, ratio_half_even

DEFAULT_WEIGHT = 0.8
HEAT_BANDS = ((120, 4), (60, 3), (30, 2), (1, 1))


def module_stats(attempts):
    return (attempts.groupBy("module")
            .agg(F.count("*").alias("total"), F.sum("correct").alias("correct"), F.avg("seconds").alias("s"))
            .select("module", "total", "correct", pct("correct", "total", 1).alias("accuracy"),
                    half_even("s").alias("avg_seconds")))


def _counted(attempts):
    return attempts.where("mode <> 'doc_example'")


def recent_accuracy(attempts, bank, n=20, by=()):
    """Accuracy of each topic's newest ``n`` attempts, apart for each value of the ``by`` columns (users).

    The newest n of a topic are among the newest n of its questions, so the log is cut per question first (the rank
    limit runs before the shuffle) and only those rows meet the bank.
    """
    per_q = W.partitionBy(*by, "qid").orderBy(F.desc("id"))
    newest = (_counted(attempts).select(*by, "qid", "id", "correct").withColumn("rq", F.row_number().over(per_q))
              .where(F.col("rq") <= n))
    per_t = W.partitionBy(*by, "topic").orderBy(F.desc("id"))
    return (newest.join(bank.select(F.col("id").alias("qid"), "topic"), "qid")
            .withColumn("rt", F.row_number().over(per_t)).where(F.col("rt") <= n)
            .groupBy(*by, "topic").agg(F.count("*").alias("recent_n"), F.sum("correct").alias("recent_ok"))
            .select(*by, "topic", "recent_n", pct("recent_ok", "recent_n").alias("recent_acc")))


def topic_stats(attempts, bank, topics, recent=20, by=()):
    """One row per topic of ``topics``; attempts are summed per question before they meet the bank.

    With ``by`` (users): one row per user and topic that the user has tried.
    """
    known = bank.where("answer IS NOT NULL")
    per_q = (_counted(attempts).groupBy(*by, "qid")
             .agg(F.count("*").alias("n"), F.sum("correct").alias("ok"), F.sum("seconds").alias("sec"),
                  count_if(F.col("seconds") > 0).alias("timed")))
    asked = known.select(F.col("id").alias("qid"), "topic")
    if by:
        tried = (asked.join(per_q, "qid").groupBy(*by, "topic")
                 .agg(F.sum("n").alias("n"), F.sum("ok").alias("ok"), F.sum("sec").alias("sec"), F.sum("timed").alias("timed")))
        there = asked.groupBy("topic").agg(F.count("*").alias("available")).join(topics, "topic")
        return (tried.join(there, "topic").join(recent_accuracy(attempts, known, recent, by), [*by, "topic"])
                .select(*by, "topic", "n", F.col("ok").alias("correct"), pct("ok", "n").alias("acc"), "recent_acc",
                        F.when(F.col("timed") > 0, half_even(F.col("sec") / F.col("timed"))).alias("avg_sec"), "available"))
    per_t = (asked.join(per_q, "qid", "left").groupBy("topic")
             .agg(F.count("*").alias("available"), F.sum("n").alias("n"), F.sum("ok").alias("ok"),
                  F.sum("sec").alias("sec"), F.sum("timed").alias("timed")))
    return (topics.join(per_t, "topic", "left").join(recent_accuracy(attempts, known, recent), "topic", "left")
            .select("topic", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("ok", F.lit(0)).alias("correct"),
                    F.when(F.col("n") > 0, pct("ok", "n")).alias("acc"), "recent_acc",
                    F.when(F.col("timed") > 0, half_even(F.col("sec") / F.col("timed"))).alias("avg_sec"),
                    F.coalesce("available", F.lit(0)).alias("available")))


def weak_topics(stats, floor=5, below=70, top=8, by=()):
    weak = stats.where((F.col("n") >= floor) & (F.coalesce("recent_acc", F.lit(0)) < below) & (F.col("available") > 0))
    if by:
        rank = F.row_number().over(W.partitionBy(*by).orderBy("recent_acc", F.desc("n"), "topic"))
        return weak.withColumn("rank", rank).where(F.col("rank") <= top)
    return (weak.orderBy("recent_acc", F.desc("n"), "topic").limit(top))


def pace_by_subtype(attempts, bank, sub_targets, module_targets, default=60, by=()):
    """Pace per (module, sub), and per user with ``by``. Equal (question, seconds, correct) attempts are counted before the join."""
    pre = (_counted(attempts).where("seconds > 0").groupBy(*by, "qid", F.col("module").alias("own"), "seconds", "correct")
           .agg(F.count("*").alias("k")))
    b = bank.select(F.col("id").alias("qid"), "module", "sub")
    mod, sub = F.coalesce("module", "own", F.lit("")), F.coalesce("sub", F.lit(""))
    target = F.coalesce(lookup(sub, sub_targets), lookup(mod, module_targets), F.lit(default)).cast("bigint")
    k, ok, slow = F.col("k"), F.col("correct") == 1, F.col("seconds") > F.col("target") * 1.5
    fast = (F.col("seconds") < F.col("target") * 0.4) & ~ok & ~slow
    return (pre.join(b, "qid", "left").select(*by, mod.alias("module"), sub.alias("sub"), "seconds", "correct", "k", target.alias("target"))
            .groupBy(*by, "module", "sub", "target")
            .agg(F.sum("k").alias("n"), F.sum(F.col("correct") * k).alias("ok"), F.sum(F.col("seconds") * k).alias("sec"),
                 F.sum(F.when(slow, k).otherwise(0)).alias("over"),
                 F.sum(F.when(slow & ok, k).otherwise(0)).alias("slow_right"),
                 F.sum(F.when(fast, k).otherwise(0)).alias("fast_wrong"))
            .select(*by, "module", F.when(F.col("sub") == "", F.col("module")).otherwise(F.col("sub")).alias("sub"), "n",
                    pct("ok", "n").alias("acc"), half_even(F.col("sec") / F.col("n")).alias("avg_sec"), "target",
                    pct("over", "n").alias("over_pct"), "slow_right", "fast_wrong"))


def module_order(attempts, weights, floor=10, by=()):
    """Points a minute, 60 * weight * right / seconds, best first. Weights count in thousandths."""
    w = lookup(F.col("module"), {k: round(1000 * x) for k, x in weights.items()})
    return (_counted(attempts).where((F.col("seconds") > 0) & F.col("module").isin(list(weights)))
            .groupBy(*by, "module").agg(F.count("*").alias("n"), F.sum("correct").alias("ok"), F.sum("seconds").alias("sec"))
            .where(F.col("n") >= floor)
            .select(*by, "module", "n", pct("ok", "n").alias("acc"), half_even(F.col("sec") / F.col("n")).alias("avg_sec"),
                    ratio_half_even(60 * w * F.col("ok"), 1000 * F.col("sec"), 2).alias("per_min"))
            .orderBy(*by, F.desc("per_min"), "module"))


def whole_weights(weights):
    """(weights as whole numbers of one unit, the default under ``None``; units in 1)."""
    exact = {k: Decimal(str(w)) for k, w in {**(weights or {}), None: DEFAULT_WEIGHT}.items()}
    unit = 10 ** max(0, *(-w.as_tuple().exponent for w in exact.values()))
    return {k: int(w * unit) for k, w in exact.items()}, unit


def estimate(ok, n, module, weights):
    """Aggregate column: weighted share of right answers in percent, 0 when nothing was answered.

    Both sums are exact before they become doubles, so the order in which rows arrive does not decide how a tie is rounded.
    """
    table, unit = whole_weights(weights)
    w = lookup(module, table, table.pop(None)).cast("decimal(18,0)")
    total = lambda x: F.sum(w * x).cast("double") / unit
    return F.coalesce(F.when(total(n) > 0, F.bround(total(ok) / total(n) * 100, 1)), F.lit(0.0))


def score_estimate(attempts, weights, by=("user_id",)):
    per = attempts.groupBy(*by, "module").agg(F.sum("correct").alias("ok"), F.count("*").alias("n"))
    return per.groupBy(*by).agg(estimate(F.col("ok"), F.col("n"), F.col("module"), weights).alias("score"))


def score_points(attempts, full=75, by=("user_id",)):
    """The other scale: every question counts the same, share of right answers times ``full``."""
    return attempts.groupBy(*by).agg(F.bround(F.sum("correct") / F.count("*") * full, 1).alias("score"))


def session_history(sessions, attempts, weights, last=60, by=("user_id",)):
    """Each user's newest ``last`` sessions (by their first attempt, then id), oldest first; the rank limit runs before the shuffle."""
    newest = W.partitionBy(*by).orderBy(F.desc("started"), F.desc("session_id"))
    top = sessions.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= last).drop("_rank")
    per = (attempts.groupBy("session_id", "module").agg(F.count("*").alias("n"), F.sum("correct").alias("ok")))
    agg = per.groupBy("session_id").agg(
        estimate(F.col("ok"), F.col("n"), F.col("module"), weights).alias("score"),
        pack_map(F.col("module"), F.concat(F.col("ok"), F.lit("/"), F.col("n"))).alias("modules"))
    return top.join(agg, "session_id").select(*by, "session_id", "started", "total", "correct", "duration", "score", "modules").orderBy(*by, "started", "session_id")


def score_trend(history, target):
    return history.select("user_id", "session_id", "score", F.bround(F.col("score") - target, 1).alias("gap"))


def daily_activity(attempts, study, since, by=()):
    """Full outer by day written as union + sum: both logs are reduced to one row per day first."""
    a = (attempts.where(F.col("day") >= F.lit(since).cast("date")).groupBy(*by, "day")
         .agg(F.count("*").alias("questions"), F.sum("correct").alias("correct"), F.lit(0).cast("bigint").alias("minutes")))
    s = (study.where(F.col("day") >= F.lit(since).cast("date")).groupBy(*by, "day")
         .agg(F.lit(0).cast("bigint").alias("questions"), F.lit(0).cast("bigint").alias("correct"), F.sum("minutes").alias("minutes")))
    return a.unionByName(s).groupBy(*by, "day").agg(*[F.sum(c).alias(c) for c in ("questions", "correct", "minutes")])


def dense_calendar(spark, activity, end, days, by=()):
    """Every day of the calendar, zeros where nothing happened; with ``by``, for everybody who is active at any time."""
    cal = spark.range(days).select(F.date_sub(F.lit(end).cast("date"), F.col("id").cast("int")).alias("day"))
    lo = F.date_sub(F.lit(end).cast("date"), days - 1)
    act = activity.where(F.col("day").between(lo, F.lit(end).cast("date")))
    if by:
        cal = activity.select(*by).distinct().select(*by, F.explode(F.sequence(lo, F.lit(end).cast("date"))).alias("day"))
    return cal.join(act, [*by, "day"], "left").select(*by, "day", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("questions", "correct", "minutes")])


def heatmap(study, end, days=182, bands=HEAT_BANDS, by=()):
    level = F.lit(0)
    for least, lv in reversed(bands):
        level = F.when(F.col("minutes") >= least, lv).otherwise(level)
    return (study.where(F.col("day").between(F.date_sub(F.lit(end).cast("date"), days), F.lit(end).cast("date")))
            .groupBy(*by, "day").agg(F.sum("minutes").alias("minutes")).withColumn("level", level))


def minutes_by_module(study):
    return study.groupBy("module").agg(F.sum("minutes").alias("minutes")).orderBy(F.desc("minutes"), "module")


def dashboard_totals(attempts, study, wrong, cards, today, by=()):
    """One row (one per ``by``); every log is folded to one row and the rows are added up, so nothing is paired."""
    day = F.lit(today).cast("date")
    names = ["questions_total", "correct_total", "questions_today", "correct_today", "minutes_total", "minutes_today",
             "due_wrong", "due_cards"]
    parts = [
        attempts.groupBy(*by).agg(F.count("*").alias("questions_total"), F.sum("correct").alias("correct_total"),
                     count_if(F.col("day") == day).alias("questions_today"),
                     count_if((F.col("day") == day) & (F.col("correct") == 1)).alias("correct_today")),
        study.groupBy(*by).agg(F.sum("minutes").alias("minutes_total"),
                  F.sum(F.when(F.col("day") == day, F.col("minutes")).otherwise(0)).alias("minutes_today")),
        wrong.groupBy(*by).agg(count_if((F.col("mastered") == 0) & (F.col("next_review") <= day)).alias("due_wrong")),
        cards.groupBy(*by).agg(count_if(F.col("due") <= day).alias("due_cards")),
    ]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p, allowMissingColumns=True)
    t = u.groupBy(*by).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
    return t.select(*by, *[n for n in names if n != "correct_total"],
                    F.when(F.col("questions_total") > 0, pct("correct_total", "questions_total", 1)).otherwise(0.0).alias("accuracy_total"))


def review_budget(cards, wrong, today, cap=300, new_per_day=30, by=()):
    """What is left for today; the caps hold for each ``by``."""
    day = F.lit(today).cast("date")
    c = cards.groupBy(*by).agg(count_if(F.col("due") <= day).alias("due_cards"),
                  count_if((F.col("last_review") == day) & (F.col("first_review") < day)).alias("cards_reviewed"),
                  count_if(F.col("first_review") == day).alias("new_today"))
    w = wrong.groupBy(*by).agg(count_if((F.col("mastered") == 0) & (F.col("next_review") <= day)).alias("wrong"))
    t = (c.unionByName(w, allowMissingColumns=True)
         .groupBy(*by).agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("due_cards", "cards_reviewed", "new_today", "wrong")])
         .withColumn("cards", F.greatest(F.lit(0), F.least(F.col("due_cards"), cap - F.col("cards_reviewed"))))
         .withColumn("new_left", F.greatest(F.lit(0), new_per_day - F.col("new_today"))))
    return t.select(*by, "wrong", "cards", "cards_reviewed", "new_left", "new_today",
                    half_even(F.col("wrong") * 1.5 + F.col("cards") * 0.2 + F.least("new_left", F.lit(20)) * 0.4).alias("minutes"))


def overview_by_exam(attempts, study, wrong, today):
    day = F.lit(today).cast("date")
    a = attempts.groupBy("exam").agg(F.count("*").alias("questions"), F.sum("correct").alias("ok"))
    s = study.groupBy("exam").agg(F.sum("minutes").alias("minutes"), F.max("day").alias("last_day"),
                                  F.sum(F.when(F.col("day") == day, F.col("minutes")).otherwise(0)).alias("minutes_today"))
    w = wrong.groupBy("exam").agg(count_if((F.col("mastered") == 0) & (F.col("next_review") <= day)).alias("due_wrong"))
    u = a.unionByName(s, allowMissingColumns=True).unionByName(w, allowMissingColumns=True)
    t = u.groupBy("exam").agg(F.max("last_day").alias("last_day"), *[
        F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("questions", "ok", "minutes", "minutes_today", "due_wrong")])
    return t.select("exam", "questions", F.when(F.col("questions") > 0, pct("ok", "questions", 1)).otherwise(0.0).alias("accuracy"),
                    "minutes", "minutes_today", "last_day", "due_wrong")


def _mark_done(bank, attempts):
    done = attempts.select(F.col("qid").alias("id")).distinct().withColumn("done", F.lit(1).cast("bigint"))
    return bank.join(done, "id", "left").withColumn("done", F.coalesce("done", F.lit(0)))


def bank_summary(bank, attempts):
    per = (_mark_done(bank, attempts).groupBy("module", "sub").agg(F.count("*").alias("k"), F.sum("done").alias("d")))
    return per.groupBy("module").agg(F.sum("k").alias("total"), F.sum("d").alias("done"),
                                     pack_map(F.col("sub"), F.col("k")).alias("subs"))


def bank_summary_by_user(bank, attempts, by=("user_id",)):
    """Modules of the bank a user has answered questions of: how many there are and how many are done."""
    done = attempts.select(*by, F.col("qid").alias("id")).distinct().join(bank.select("id", "module"), "id").groupBy(*by, "module").agg(F.count("*").alias("done"))
    return done.join(bank.groupBy("module").agg(F.count("*").alias("total")), "module").select(*by, "module", "total", "done")


def bank_matching(picked, attempts):
    return _mark_done(picked, attempts).agg(F.count("*").alias("matching"), F.coalesce(F.sum("done"), F.lit(0)).alias("matching_done"))


def bank_counts(spark, bank, known):
    zero = spark.createDataFrame([(k, 0) for k in known], "src string, n bigint")
    per = bank.groupBy("src").agg(F.count("*").alias("n"))
    return per.unionByName(zero).groupBy("src").agg(F.sum("n").alias("n"))


def attempt_progress(attempts):
    return attempts.groupBy("qid").agg(F.count("*").alias("n"), F.sum("correct").alias("ok"), F.max("day").alias("last"))


def latest_by_key(df, keys, order, cols):
    """Last row per key as an aggregate (map-side combined, no sort, safe for a hot key)."""
    last = F.max_by(F.struct(*cols), F.struct(*order))
    return df.groupBy(*keys).agg(last.alias("r")).select(*keys, "r.*")


def source_progress(attempts, bank):
    last = latest_by_key(attempts, ["qid"], ["id"], ["correct"])
    return (last.join(bank.select(F.col("id").alias("qid"), "source"), "qid").groupBy("source")
            .agg(F.count("*").alias("done"), F.sum("correct").alias("correct")))


def reason_share(wrong):
    per = wrong.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))
    return per.select("reason", "n", F.bround(F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1))) * 100, 1).alias("share"))


def kind_totals(speed, prefix):
    return (speed.where(F.col("kind").startswith(prefix)).groupBy(F.expr(f"substring(kind, {len(prefix) + 1})").alias("kind"))
            .agg(F.sum("total").alias("n"), F.sum("correct").alias("ok"), F.sum("seconds").alias("sec")))


def usage_month(usage, month, price_in=None, price_out=None, limit=0):
    """Month-to-date use per kind, each row also carrying the month's totals, cost and over-limit flag.

    Like the running bill it stands for, it counts every day from the first of the month on.
    """
    per = (usage.where(F.col("day") >= F.lit(month + "-01").cast("date")).groupBy("kind")
           .agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input"), F.sum("output_tokens").alias("output"),
                F.sum("estimated").alias("estimated")))
    w = W.partitionBy(F.lit(1))
    tin, tout = F.sum("input").over(w), F.sum("output").over(w)
    cost = F.lit(None).cast("double") if price_in is None or price_out is None else F.bround(
        tin / 1e6 * price_in + tout / 1e6 * price_out, 2)
    over = F.when((F.lit(limit) > 0) & (tin + tout >= limit), 1).otherwise(0)
    return per.select("kind", "calls", "estimated", (F.col("input") + F.col("output")).alias("tokens"),
                      tin.alias("month_input"), tout.alias("month_output"), cost.alias("cost"), over.alias("over_limit"))


def record_fold(essays, prefix):
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("id")))
    return (essays.where(F.col("set_id").startswith(prefix)).groupBy(F.expr(f"substring(set_id, {len(prefix) + 1})").alias("item"))
            .agg(F.count("*").alias("n"), F.max("id").alias("last"), last("self_score").alias("self"), last("ai_score").alias("ai")))


def source_rollup(bank):
    per = bank.groupBy("source", "module").agg(F.count("*").alias("k"), F.count("answer").alias("a"), F.max("year").alias("y"))
    return per.groupBy("source").agg(F.sum("k").alias("count"), F.sum("a").alias("answered"), F.max("y").alias("year"),
                                     pack_map(F.col("module"), F.col("k")).alias("modules")).where("count > 0")


def corpus_digest(blocks, key="doc"):
    """Regression fingerprint per document. One document's blocks come out of one text cell, so a group fits a task."""
    line = F.concat_ws("|", "kind", F.col("level").cast("string"), "text")
    return (blocks.groupBy(key)
            .agg(F.count("*").alias("blocks"), count_if(F.col("kind") == "h").alias("headings"),
                 count_if(F.col("kind") == "p").alias("paragraphs"), F.sum(F.length("text")).cast("bigint").alias("chars"),
                 F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))).alias("ls"))
            .select(key, "blocks", "headings", "paragraphs", "chars",
                    F.substring(F.sha1(F.array_join(F.col("ls.line"), "\n")), 1, 16).alias("sha")))


def digest_diff(old, new, fields, key="doc"):
    """Documents whose digest changed, with the names of the changed fields."""
    o = old.select(key, *[F.col(f).alias("old_" + f) for f in fields])
    n = new.select(key, *[F.col(f).alias("new_" + f) for f in fields])
    changed = F.array_compact(F.array(*[F.when(~F.col("old_" + f).eqNullSafe(F.col("new_" + f)), f) for f in fields]))
    return (o.join(n, key, "full").select(key, F.array_join(changed, ",").alias("changed")).where("changed <> ''"))


def pivot_counts(df, row, col, values):
    return df.groupBy(row).agg(F.count("*").alias("n"), *[count_if(F.col(col) == v).alias(str(v)) for v in values])


def storage_usage(files, part, stale):
    """Bytes per part and in all (grouping by rollup), and bytes of files matching the stale pattern."""
    return (files.select(part.alias("part"), "size", F.col("rel").rlike(stale).alias("is_stale")).rollup("part")
            .agg(F.sum("size").alias("bytes"), F.sum(F.when(F.col("is_stale"), F.col("size")).otherwise(0)).alias("stale_bytes"),
                 count_if(F.col("is_stale")).alias("stale_files"))
            .select(F.coalesce("part", F.lit("(all)")).alias("part"), "bytes", "stale_bytes", "stale_files"))


def speed_best(speed):
    best = F.min_by(F.struct("correct", "total", "seconds"), F.struct(-F.col("correct") / F.col("total"), "seconds", "total"))
    return (speed.groupBy("kind").agg(F.count("*").alias("rounds"), best.alias("b"))
            .select("kind", "rounds", F.col("b.correct").alias("correct"), F.col("b.total").alias("total"), F.col("b.seconds").alias("seconds")))


def deck_state(deck_cards, states, today, mature=21, mature_box=4):
    day = F.lit(today).cast("date")
    s = states.select("card", "due", "stability", "box")
    has = F.col("due").isNotNull()
    learned = has & F.when(F.coalesce("stability", F.lit(0.0)) > 0, F.col("stability") >= mature).otherwise(F.col("box") >= mature_box)
    return (deck_cards.join(s, "card", "left").groupBy("deck")
            .agg(F.count("*").alias("cards"), count_if(~has).alias("fresh"), count_if(has & (F.col("due") <= day)).alias("due"),
                 count_if(learned).alias("learned")))


def table_counts(tables):
    u = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        u = one if u is None else u.unionByName(one)
    return u


def weakest_module(attempts, floor=5):
    return (module_stats(attempts).where(F.col("total") >= floor).orderBy("accuracy", "module").limit(1)
            .select("module", "total", "accuracy"))


def streak(checkins, today, key="user_id"):
    """Length of the run of days that ends today, or yesterday when today is missing; 0 when there is none.

    ``checkins`` holds distinct days per key, so a group is bounded by the calendar.
    """
    day = F.lit(today).cast("date")
    isl = F.date_sub("day", F.row_number().over(W.partitionBy(key).orderBy("day")))
    runs = (checkins.where(F.col("day") <= day).select(key, "day", isl.alias("isl")).groupBy(key, "isl")
            .agg(F.max("day").alias("end"), F.count("*").alias("len")))
    return runs.groupBy(key).agg(F.coalesce(F.max(F.when(F.col("end") >= F.date_sub(day, 1), F.col("len"))), F.lit(0)).alias("streak"))


def quiz_report(answers, mode):
    """``answers``: module, chosen (NULL = not answered), correct, seconds. Exam mode counts unanswered as wrong."""
    d = answers if mode == "exam" else answers.where("chosen IS NOT NULL")
    ok = (F.col("chosen").isNotNull() & (F.col("correct") == 1)).cast("bigint")
    return (d.groupBy("module").agg(F.count("*").alias("n"), F.sum(ok).alias("ok"), F.sum("seconds").alias("sec"))
            .select("module", "n", "ok", half_up(F.col("ok") / F.col("n") * 100).alias("acc"), "sec"))


def quiz_wrong(answers, mode):
    miss = F.col("chosen").isNotNull() & (F.col("correct") == 0)
    return answers.where(miss | F.col("chosen").isNull() if mode == "exam" else miss)


def course_progress(lessons, done):
    """``lessons(course, lesson, minutes)``, ``done(lesson)``; last row is the total over all courses."""
    d = done.select("lesson").distinct().withColumn("d", F.lit(1).cast("bigint"))
    return (lessons.join(d, "lesson", "left").rollup("course")
            .agg(F.coalesce(F.sum("d"), F.lit(0)).alias("done"), F.count("*").alias("total"), F.sum("minutes").alias("minutes"))
            .select(F.coalesce("course", F.lit("(all)")).alias("course"), "done", "total",
                    half_up(F.col("done") / F.col("total") * 100).alias("pct"), "minutes"))


def period_counts(items, done):
    d = done.select("id").distinct().withColumn("d", F.lit(1).cast("bigint"))
    return (items.join(d, "id", "left").groupBy(F.year("day").alias("year"), F.month("day").alias("month"))
            .agg(F.count("*").alias("n"), F.coalesce(F.sum("d"), F.lit(0)).alias("done")))


def period_items(items, half_rank, source_rank, kind_rank):
    """Listing order inside a period: half of the month, source, kind, title."""
    return items.orderBy(F.desc("year"), F.desc("month"), half_rank, source_rank, kind_rank, "title", "id")
