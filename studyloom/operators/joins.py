"""Joins of the log, the bank and the corpus."""
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from studyloom.operators.realign import explanation_actions
from studyloom.operators.scan import asof_backward, row_numbers


def attempt_bank_join(attempts, bank):
    """Attempts with the bank's module, sub-type and topic; the attempt's own module where the question is unknown."""
    b = bank.select(F.col("id").alias("qid"), F.col("module").alias("b_module"), "sub", "topic")
    return attempts.join(b, "qid", "left").withColumn("module", F.coalesce("b_module", "module")).drop("b_module")


def get_by_ids(bank, ids):
    """``ids(pos, id)`` -> the questions in list order; ids nobody knows drop out, repeated ids repeat."""
    return ids.join(bank, "id").orderBy("pos")


def side_rows(table, questions, key, ref):
    """Materials or sources the picked questions refer to."""
    return table.join(questions.select(F.col(ref).alias(key)), key, "left_semi")


def asof_answer_attach(blocks):
    """First-answer form: each answer row takes the nearest preceding question of its document and number."""
    q = blocks.where("kind = 'q'").select("doc", "num", "seq", F.col("seq").alias("q_seq"))
    a = blocks.where("kind = 'a'").select("doc", "num", "seq", "ans")
    return asof_backward(a, q, ["doc", "num"], "seq", "q_seq", name="q_seq").where("q_seq IS NOT NULL")


def position_lookup(starts, offsets, width=1 << 20):
    """Page that holds each offset: the last page start at or before it. ``starts(doc, page, pos)``, ``offsets(doc, pos, ..)``."""
    return asof_backward(offsets, starts, ["doc"], "pos", "page", width, "page")


def interval_phase(rows, day, phases, default):
    """Name of the phase whose [start, end] holds the day. ``phases`` is a short Python list, so it becomes one CASE."""
    case = None
    for name, start, end in phases:
        hit = F.col(day).between(F.lit(start).cast("date"), F.lit(end).cast("date"))
        case = F.when(hit, name) if case is None else case.when(hit, name)
    return rows.withColumn("phase", case.otherwise(default) if case is not None else F.lit(default))


def date_conflict(dates, today, gap=21):
    """Pairs of future exam dates of different exams at most ``gap`` days apart.

    Days fall into cells of ``gap`` + 1 days; a later day lies in the same cell or the next, so an equi-join finds it.
    """
    cell = F.floor(F.datediff("day", F.lit("1970-01-01").cast("date")) / (gap + 1))
    d = dates.where(F.col("day") >= F.lit(today).cast("date")).withColumn("cell", cell)
    a = d.select(F.col("exam").alias("a"), F.col("day").alias("a_date"), F.explode(F.array("cell", F.col("cell") + 1)).alias("cell"))
    b = d.select(F.col("exam").alias("b"), F.col("day").alias("b_date"), "cell")
    days = F.datediff("b_date", "a_date")
    later = (days > 0) | ((days == 0) & (F.col("a") < F.col("b")))
    note = F.when(days == 0, "same day").otherwise(F.concat(days.cast("string"), F.lit(" days apart")))
    return a.join(b, "cell").where((F.col("a") != F.col("b")) & later & (days <= gap)).select("a", "a_date", "b", "b_date", days.alias("days"), note.alias("note"))


def question_answer_mate(files):
    """Question files take the answer files of their folder and month in order, one each. ``files(fid, dir, month, role)``."""
    keys = ["dir", "month"]
    q = row_numbers(files.where("role = 'questions'"), keys, "fid")
    a = row_numbers(files.where("role = 'answers'").select(*keys, F.col("fid").alias("fid")), keys, "fid").select(*keys, "rn", F.col("fid").alias("mate"))
    return q.join(a, [*keys, "rn"], "left").select("fid", "dir", "month", "mate")


def prefix_match(left, right, key, id_left, id_right, block=22, check=40):
    """First right row (smallest id) whose key agrees with the left key: same first ``block`` characters, and one of the
    two first-``check``-character prefixes begins the other key.

    The either-way prefix test becomes plain equality: long keys meet on ``check`` characters, a short one on its own
    length. The right side is reduced to one id per join key first, so copies on either side never multiply.
    """
    lens = F.sequence(F.lit(block), F.lit(check - 1))

    def heads(k):
        return F.transform(F.filter(lens, lambda n: n <= F.length(k)), lambda n: F.substring(k, 1, n))
    k = F.col(key)
    n = F.length(k)
    empty = F.array().cast("array<string>")
    tag = lambda t, arr: F.transform(arr, lambda x: F.concat(F.lit(t), x))
    near = left.select(id_left, k.alias("k")).join(right.select(F.substring(key, 1, block).alias("h")).distinct(),
                                                  F.substring("k", 1, block) == F.col("h"), "left_semi")
    kk, kn = F.col("k"), F.length("k")
    l_keys = F.concat(F.when(kn >= check, tag("Q", F.array(F.substring(kk, 1, check)))).when(kn >= block, tag("P", F.array(kk))).otherwise(empty),
                      F.when(kn >= block, tag("S", heads(kk))).otherwise(tag("S", F.array(kk))))
    r_keys = F.concat(F.when(n >= check, tag("Q", F.array(F.substring(k, 1, check)))).otherwise(tag("S", F.array(k))),
                      F.when(n >= block, tag("P", heads(k))).otherwise(empty))
    r = right.select(id_right, F.explode(r_keys).alias("j")).groupBy("j").agg(F.min(id_right).alias(id_right))
    return (near.select(id_left, F.explode(l_keys).alias("j")).join(r, "j").groupBy(id_left).agg(F.min(id_right).alias(id_right)))


def borrow_from_copies(rows, key, same):
    """Unanswered rows take the answer of the first other document with the same key and the same ``same`` columns.

    Two source documents per key are enough: when the first is the row's own, the second is the first other one.
    """
    keys = [key, *same]
    have = rows.where("ans IS NOT NULL").groupBy(*keys, "doc").agg(F.min_by("ans", "seq").alias("ans"))
    rn = F.row_number().over(W.partitionBy(*keys).orderBy("doc"))
    two = have.withColumn("rn", rn).where(F.col("rn") <= 2).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("doc", "ans"))).alias("c"))
    need = rows.where(f"ans IS NULL AND {key} IS NOT NULL")
    other = F.get(F.filter("c", lambda x: x["doc"] != F.col("doc")), 0)
    return (need.join(two, keys).withColumn("o", other).where("o IS NOT NULL")
            .select("doc", "seq", F.col("o.ans").alias("ans"), F.col("o.doc").alias("src")))


def fill_missing_from_versions(questions, min_key=8):
    """Best version of every paper with missing answers filled from the other versions, in version order.

    ``questions(pid, version, ord, num, key, answer)``. A version offers the question of the same key when the key is long
    enough and it has an answer; else, when it has as many questions as the best one, its question of the same number.
    All offers of the other versions are reduced to the first one per key and per number before they meet the base.
    """
    per = questions.groupBy("pid", "version").agg(F.count("answer").alias("answered"), F.count("*").alias("count"))
    rank = F.row_number().over(W.partitionBy("pid").orderBy(F.desc("answered"), F.desc("count"), "version"))
    ver = per.withColumn("rank", rank)
    best = ver.where("rank = 1").select("pid", F.col("version").alias("best"), F.col("count").alias("best_count"))
    q = questions.join(ver, ["pid", "version"]).join(best, "pid")
    rest = q.where("rank > 1")
    by_key = (rest.where("answer IS NOT NULL").groupBy("pid", "key", "rank").agg(F.max_by("answer", "ord").alias("a"))
              .groupBy("pid", "key").agg(F.min(F.struct("rank", F.lit(0).alias("how"), F.col("a"))).alias("k")))
    by_num = (rest.where("count = best_count").groupBy("pid", "num", "rank").agg(F.max(F.struct("ord", "answer")).alias("o"))
              .where("o.answer IS NOT NULL").groupBy("pid", "num")
              .agg(F.min(F.struct("rank", F.lit(1).alias("how"), F.col("o.answer").alias("a"))).alias("n")))
    base = q.where("rank = 1").join(by_key, ["pid", "key"], "left").join(by_num, ["pid", "num"], "left")
    k = F.when(F.length("key") >= min_key, F.col("k"))
    offer = F.least(k, F.col("n"))
    return base.select("pid", "version", "ord", F.coalesce("answer", offer["a"]).alias("answer"),
                       (F.col("answer").isNull() & offer.isNotNull()).cast("int").alias("filled"))


def next_unfinished(lessons, done):
    """First lesson of every course that is not done. ``lessons(course, lesson, ord)``."""
    return (lessons.join(done.select("lesson").distinct(), "lesson", "left_anti").groupBy("course")
            .agg(F.min(F.struct("ord", "lesson")).alias("m")).select("course", "m.lesson"))


def realign_by_signature(questions, low=0.15, high=0.4, least=6, cap=15, letters=40):
    """Explanations that belong to another question of their document: (doc, seq, to, score).

    ``questions(doc, seq, sig, exp_sig, exp_len)``: token arrays of stem with options and of the explanation. Tokens on more
    than max(3, 8%) of a document's questions count for nothing. An explanation moves when its own question shares little of
    it and another shares much; a question takes the best one, unless its own explanation fits it half as well.
    """
    moves = explanation_actions(questions, low, high, least, cap, letters).where("action = 'moved'")
    return moves.select("doc", "seq", "to", F.bround("score", 4).alias("score"))
