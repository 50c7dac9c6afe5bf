"""The FSRS-5 memory model as column expressions, so that scheduling stays inside generated code.

Arguments are columns unless named ``g`` with a Python int. Dates are DATE columns, intervals whole days.
"""
import math

from pyspark.sql import functions as F

# Default FSRS-5 parameters, forgetting curve and limits.
W = (0.40255, 1.18385, 3.173, 15.69105, 7.1949, 0.5345, 1.4604, 0.0046, 1.54575, 0.1192,
     1.01925, 1.9395, 0.11, 0.29605, 2.2698, 0.2315, 2.9898, 0.51655, 0.6621)
DECAY = -0.5
FACTOR = 0.9 ** (1 / DECAY) - 1
AGAIN, HARD, GOOD, EASY = 1, 2, 3, 4
MAX_INTERVAL = 3650
MIN_STABILITY = 0.1
LEITNER_DAYS = (0, 1, 3, 7, 14, 30)
STAGE_DAYS = (1, 2, 4, 7, 15, 30)

INIT_S = {g: max(W[g - 1], MIN_STABILITY) for g in (1, 2, 3, 4)}
INIT_D = {g: min(10.0, max(1.0, W[4] - math.exp(W[5] * (g - 1)) + 1)) for g in (1, 2, 3, 4)}
SAME_DAY = {g: math.exp(W[17] * (g - 3 + W[18])) for g in (1, 2, 3, 4)}
# Difficulty after grade g is clamp(A[g] * d + B[g]): damping toward 10 and reversion to the easy start are both linear.
D_A = {g: (1 - W[7]) * (1 + W[6] * (g - 3) / 9) for g in (1, 2, 3, 4)}
D_B = {g: W[7] * INIT_D[4] + (1 - W[7]) * (-10 * W[6] * (g - 3) / 9) for g in (1, 2, 3, 4)}


def by_grade(g, table):
    if isinstance(g, int):
        return F.lit(table[g])
    return F.when(g == 1, table[1]).when(g == 2, table[2]).when(g == 3, table[3]).otherwise(table[4])


def clamp_d(d):
    return F.least(F.lit(10.0), F.greatest(F.lit(1.0), d))


def retrievability(elapsed, s):
    return F.when(s <= 0, 0.0).otherwise(F.pow(1 + FACTOR * F.greatest(F.lit(0.0), elapsed.cast("double")) / s, F.lit(DECAY)))


def init_stability(g):
    return by_grade(g, INIT_S)


def init_difficulty(g):
    return by_grade(g, INIT_D)


def next_difficulty(d, g):
    return clamp_d(d * by_grade(g, D_A) + by_grade(g, D_B))


def after_recall(d, s, r, g):
    bonus = by_grade(g, {1: 1.0, 2: W[15], 3: 1.0, 4: W[16]})
    return s * (1 + F.exp(F.lit(W[8])) * (11 - d) * F.pow(s, F.lit(-W[9])) * (F.exp(W[10] * (1 - r)) - 1) * bonus)


def after_forget(d, s, r):
    long_term = W[11] * F.pow(d, F.lit(-W[12])) * (F.pow(s + 1, F.lit(W[13])) - 1) * F.exp(W[14] * (1 - r))
    return F.least(long_term, s / F.exp(F.lit(W[17] * W[18])))


def same_day(s, g):
    return s * by_grade(g, SAME_DAY)


def stability_update(s, d, elapsed, g):
    r = retrievability(elapsed, s)
    recall, forget = after_recall(d, s, r, g), after_forget(d, s, r)
    later = (forget if g == AGAIN else recall) if isinstance(g, int) else F.when(g == AGAIN, forget).otherwise(recall)
    return F.greatest(F.lit(MIN_STABILITY), F.when(elapsed < 1, same_day(s, g)).otherwise(later))


def step(s, d, elapsed, is_new, g):
    """(stability, difficulty) after grade ``g``."""
    return (F.when(is_new, F.greatest(F.lit(MIN_STABILITY), init_stability(g))).otherwise(stability_update(s, d, elapsed, g)),
            F.when(is_new, init_difficulty(g)).otherwise(next_difficulty(d, g)))


def interval(s, retention=0.9):
    days = F.bround(s / FACTOR * (retention ** (1 / DECAY) - 1))
    return F.least(F.lit(MAX_INTERVAL), F.greatest(F.lit(1), days.cast("int")))


def fuzz(days, seed):
    """Move intervals of 3 days and more by up to 5%, by a hash of ``seed`` (card + date + grade)."""
    h = F.conv(F.substring(F.md5(seed), 1, 8), 16, 10).cast("bigint") / float(0xFFFFFFFF)
    delta = F.greatest(F.lit(1), F.bround(days * 0.05).cast("int"))
    return F.when(days < 3, days).otherwise(days - delta + F.bround(h * 2 * delta).cast("int"))


def preview(s, d, elapsed, is_new, seed, day, retention=0.9):
    """Next interval in days of the four grades, as a struct (again, hard, good, easy). Again means later today."""
    text = F.concat(seed.cast("string"), day.cast("string"))
    raw = {g: fuzz(interval(step(s, d, elapsed, is_new, g)[0], retention), F.concat(text, F.lit(str(g)))) for g in (HARD, GOOD, EASY)}
    good = F.greatest(raw[GOOD], raw[HARD])
    easy = F.greatest(raw[EASY], F.least(F.lit(MAX_INTERVAL), good + 1))
    return F.struct(F.lit(0).alias("again"), raw[HARD].alias("hard"), good.alias("good"), easy.alias("easy"))


def good_days(s, d, elapsed, is_new, seed, day, retention=0.9):
    return preview(s, d, elapsed, is_new, seed, day, retention)["good"]


def legacy_card(box, lapses, intervals=LEITNER_DAYS):
    """(stability, difficulty) of a card kept in numbered boxes."""
    b = F.greatest(F.lit(1), F.least(F.coalesce(F.nullif(box, F.lit(0)), F.lit(1)), F.lit(len(intervals) - 1)))
    days = F.element_at(F.array(*[F.lit(x) for x in intervals]), (b + 1).cast("int"))
    return (F.greatest(F.lit(1), days).cast("double"),
            clamp_d(5.0 + 0.6 * F.coalesce(lapses, F.lit(0)) - 0.3 * F.greatest(F.lit(0), b - 2)))


def legacy_wrong(stage, wrong_count, intervals=STAGE_DAYS):
    """(stability, difficulty) of a wrong-book row kept in stages."""
    st = F.greatest(F.lit(0), F.least(F.coalesce(stage, F.lit(0)), F.lit(len(intervals) - 1)))
    return (F.element_at(F.array(*[F.lit(x) for x in intervals]), (st + 1).cast("int")).cast("double"),
            clamp_d(5.0 + 0.5 * F.coalesce(F.nullif(wrong_count, F.lit(0)), F.lit(1))))
