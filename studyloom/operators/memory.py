"""Keyed state: progress rows, sessions, the wrong-question book and card reviews.

State per key is an ordered fold. A key may own any share of the log, so its rows are never gathered: they are first
reduced to one fixed-size summary per calendar day (with map-side combining), and only the days of a key are folded.
"""
from pyspark.sql import functions as F

from studyloom.functions import fsrs as M
from studyloom.functions.numbers import count_if, half_even

CHUNK = 4096


def progress_upsert(updates, keys, fields=("seq", "pct", "done", "fav")):
    """Partial updates: the last given value of every field wins, fields never given are 0."""
    last = [F.coalesce(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("id"))), F.lit(0)).alias(c) for c in fields]
    return updates.groupBy(*keys).agg(*last, F.max("id").alias("updated"))


def session_build(attempts):
    """One row per submitted batch; minutes go to its only module, or to 'mixed'."""
    s = attempts.groupBy("session_id").agg(
        F.count("*").alias("total"), F.sum("correct").alias("correct"), F.sum("seconds").alias("duration"),
        F.min("module").alias("lo"), F.max("module").alias("hi"))
    return s.select("session_id", "total", "correct", "duration", half_even(F.col("duration") / 60).alias("minutes"),
                    F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("mixed").alias("module"))


def wrongbook_fold(attempts, keys=("user_id", "qid"), seed="qid", retention=0.9, master_days=30):
    """The wrong-question book after the whole log.

    Wrong: reviewed as "again", due tomorrow, stage 0. Right: counts only for an unmastered row that is due, reviewed as
    "good". Inside one day only two things matter: whether a right answer came before the first wrong one, and how many
    wrong ones there were. Repeated "again" on one day is a power of one step, so the day needs no inner loop.
    """
    wrong = F.col("correct") == 0
    per_day = attempts.groupBy(*keys, "day").agg(
        F.min(F.when(wrong, F.col("id"))).alias("fw"), F.min(F.when(~wrong, F.col("id"))).alias("fr"), count_if(wrong).alias("nw"))
    right_first = F.col("fr").isNotNull() & (F.col("fw").isNull() | (F.col("fr") < F.col("fw")))
    ev = F.array_compact(F.array(F.when(right_first, F.struct("day", F.lit(0).alias("o"), F.lit(0).cast("bigint").alias("n"))),
                                 F.when(F.col("nw") > 0, F.struct("day", F.lit(1).alias("o"), F.col("nw").alias("n")))))
    hist = (per_day.select(*keys, ev.alias("ev")).groupBy(*keys)
            .agg(F.array_sort(F.flatten(F.collect_list("ev"))).alias("ev")).where(F.exists("ev", lambda e: e["o"] == 1)))

    none_day = F.lit("1970-01-01").cast("date")
    start = F.struct(F.lit(0).cast("bigint").alias("wrong_count"), F.lit(0).cast("bigint").alias("stage"), none_day.alias("next_review"),
                     F.lit(0).alias("mastered"), F.lit(0.0).alias("s"), F.lit(0.0).alias("d"), none_day.alias("last_review"),
                     F.lit(0).cast("bigint").alias("reps"))
    fixed_point = M.D_B[1] / (1 - M.D_A[1])

    def move(a, e):
        el, new = F.datediff(e["day"], a["last_review"]), a["wrong_count"] == 0
        days = M.good_days(a["s"], a["d"], el, F.lit(False), F.col(seed), e["day"], retention)
        gs, gd = M.step(a["s"], a["d"], el, F.lit(False), M.GOOD)
        right = F.struct(a["wrong_count"].alias("wrong_count"), (a["stage"] + 1).alias("stage"), F.date_add(e["day"], days).alias("next_review"),
                         F.when(days >= master_days, 1).otherwise(0).alias("mastered"), gs.alias("s"), gd.alias("d"),
                         e["day"].alias("last_review"), (a["reps"] + 1).alias("reps"))
        ws, wd = M.step(a["s"], a["d"], el, new, M.AGAIN)
        more = (e["n"] - 1).cast("double")
        again = F.struct((a["wrong_count"] + e["n"]).alias("wrong_count"), F.lit(0).cast("bigint").alias("stage"),
                         F.date_add(e["day"], 1).alias("next_review"), F.lit(0).alias("mastered"),
                         F.greatest(F.lit(M.MIN_STABILITY), ws * F.pow(F.lit(M.SAME_DAY[1]), more)).alias("s"),
                         (fixed_point + (wd - fixed_point) * F.pow(F.lit(M.D_A[1]), more)).alias("d"),
                         e["day"].alias("last_review"), (a["reps"] + e["n"]).alias("reps"))
        due = ~new & (a["mastered"] == 0) & (a["next_review"] <= e["day"])
        return F.when(e["o"] == 1, again).when(due, right).otherwise(a)

    return (hist.select(*keys, F.aggregate("ev", start, move).alias("m"))
            .select(*keys, "m.wrong_count", "m.stage", "m.next_review", F.col("m.mastered").cast("bigint").alias("mastered"),
                    F.bround("m.s", 4).alias("stability"), F.bround("m.d", 4).alias("difficulty"), "m.last_review", "m.reps"))


def _map(c, ls, a, b, lo, hi):
    return F.struct(c.alias("c"), ls.alias("ls"), a.alias("a"), b.alias("b"), lo.alias("lo"), hi.alias("hi"))


IDENTITY = (1.0, 0.0, 1.0, 0.0, 1.0, 10.0)


def _then(f, g):
    """Apply f, then g. A same-day review is s -> max(ls, c*s), d -> min(hi, max(lo, a*d + b)); such maps compose."""
    keep = lambda x: F.least(g["hi"], F.greatest(g["lo"], g["a"] * x + g["b"]))
    return _map(g["c"] * f["c"], F.greatest(g["ls"], g["c"] * f["ls"]), g["a"] * f["a"], g["a"] * f["b"] + g["b"], keep(f["lo"]), keep(f["hi"]))


def _review_map(g):
    return _map(M.by_grade(g, M.SAME_DAY), F.lit(M.MIN_STABILITY), M.by_grade(g, M.D_A), M.by_grade(g, M.D_B), F.lit(1.0), F.lit(10.0))


def card_fold(reviews, keys=("user_id", "qid"), seed="qid", retention=0.9):
    """Card states after all reviews (grades 1-4 in id order).

    The reviews of one card and day between the first and the last are one composed map. It is built from chunks of at
    most ``CHUNK`` consecutive ids, so no array grows with the number of reviews a card gets.
    """
    ident = lambda: _map(*[F.lit(x) for x in IDENTITY])
    run = lambda arr: F.aggregate(arr, ident(), lambda f, r: _then(f, _review_map(r["grade"])))
    n = F.size("rs")
    part = lambda lo, cut: F.slice("rs", lo, F.greatest(F.lit(0), n - cut))
    chunks = (reviews.groupBy(*keys, "day", F.floor(F.col("id") / CHUNK).alias("chunk"))
              .agg(F.array_sort(F.collect_list(F.struct("id", "grade"))).alias("rs"), F.min_by("deck", "id").alias("deck"))
              .select(*keys, "day", "chunk", "deck", n.cast("bigint").alias("n"), F.expr("rs[0].grade").alias("first"),
                      F.element_at("rs", -1)["grade"].alias("last"), F.expr("cast(size(filter(rs, r -> r.grade = 1)) as bigint)").alias("lapses"),
                      run(F.col("rs")).alias("all"), run(part(2, 1)).alias("tail"), run(part(1, 1)).alias("init"), run(part(2, 2)).alias("mid")))
    cols = ["chunk", "n", "first", "last", "lapses", "all", "tail", "init", "mid", "deck"]
    m = F.size("cs")
    head, end = F.element_at("cs", 1), F.element_at("cs", -1)
    inner = F.aggregate(F.slice("cs", 2, F.greatest(F.lit(0), m - 2)), head["tail"], lambda f, c: _then(f, c["all"]))
    per_day = (chunks.groupBy(*keys, "day").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("cs"), F.sum("n").alias("n"),
                                                F.sum("lapses").alias("lapses"))
               .select(*keys, F.struct("day", "n", "lapses", head["first"].alias("first"), end["last"].alias("last"),
                                       F.when(m == 1, head["mid"]).otherwise(_then(inner, end["init"])).alias("mid"),
                                       head["deck"].alias("deck")).alias("e")))
    hist = per_day.groupBy(*keys).agg(F.array_sort(F.collect_list("e")).alias("days"), F.sum("e.n").alias("reps"), F.sum("e.lapses").alias("lapses"))

    none_day = F.lit("1970-01-01").cast("date")
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("d"), none_day.alias("day"), F.lit(0.0).alias("ps"), F.lit(0.0).alias("pd"),
                     F.lit(0).alias("pel"), F.lit(True).alias("pnew"), F.lit(0).cast("bigint").alias("g"))

    def move(a, e):
        el, new = F.datediff(e["day"], a["day"]), a["g"] == 0
        s1, d1 = M.step(a["s"], a["d"], el, new, e["first"])
        once = F.struct(s1.alias("s"), d1.alias("d"), e["day"].alias("day"), a["s"].alias("ps"), a["d"].alias("pd"), el.alias("pel"),
                        new.alias("pnew"), e["first"].alias("g"))
        x = e["mid"]
        s2 = F.greatest(x["ls"], x["c"] * s1)
        d2 = F.least(x["hi"], F.greatest(x["lo"], x["a"] * d1 + x["b"]))
        s3, d3 = M.step(s2, d2, F.lit(0), F.lit(False), e["last"])
        many = F.struct(s3.alias("s"), d3.alias("d"), e["day"].alias("day"), s2.alias("ps"), d2.alias("pd"), F.lit(0).alias("pel"),
                        F.lit(False).alias("pnew"), e["last"].alias("g"))
        return F.when(e["n"] == 1, once).otherwise(many)

    f = hist.select(*keys, "reps", "lapses", F.expr("days[0].day").alias("first_review"), F.expr("days[0].deck").alias("deck"),
                    F.aggregate("days", start, move).alias("m"))
    p = M.preview(F.col("m.ps"), F.col("m.pd"), F.col("m.pel"), F.col("m.pnew"), F.col(seed), F.col("m.day"), retention)
    f = f.withColumn("p", p).withColumn("g", F.col("m.g"))
    days = F.when(F.col("g") == 1, 0).when(F.col("g") == 2, F.col("p.hard")).when(F.col("g") == 3, F.col("p.good")).otherwise(F.col("p.easy"))
    box = sum([F.when(days >= x, 1).otherwise(0) for x in M.LEITNER_DAYS[1:]], F.lit(1))
    return f.select(*keys, "deck", F.when(F.col("g") == 1, 1).otherwise(F.least(F.lit(len(M.LEITNER_DAYS) - 1), box)).alias("box"),
                    F.date_add("m.day", days).alias("due"), "reps", "lapses", F.bround("m.s", 4).alias("stability"),
                    F.bround("m.d", 4).alias("difficulty"), F.col("m.day").alias("last_review"), "first_review")
