"""Answers taken over from the same question elsewhere: the bank, other documents, explanations that stand under the wrong question.

Questions meet on the beginning of their stem and on the text of an option. Two option lists agree when all but one of the
options (by their first eight characters) are in the other list, so one of any two options must be: joining on the first two of them loses
nothing and keeps stems that every question shares from meeting each other. Letters are mapped by option text, as lists may be shuffled.
"""
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from studyloom.functions import text as T
from studyloom.operators.realign import explanation_actions
from studyloom.operators.segment import prose_answer
from studyloom.session import materialize

LETTERS = "ABCDEFGH"


def option_key(c, keep):
    return F.substring(T.only(c, keep), 1, 8)


def _told(options, keep):
    """Option keys that are not empty, one per option."""
    return F.filter(F.transform(options, lambda o: option_key(o["text"], keep)), lambda k: k != "")


def options_agree(mine, theirs, keep):
    """At least two, and all but one, of my options are among theirs. Without any text on my side only the stem counts.

    ``mine``: array of (letter, text); ``theirs``: array of texts.
    """
    told = _told(mine, keep)
    keys = F.transform(theirs, lambda o: option_key(o, keep))
    common = F.size(F.filter(told, lambda k: F.array_contains(keys, k)))
    some = F.exists(mine, lambda o: F.coalesce(o["text"], F.lit("")) != "")
    return F.when(~F.coalesce(some, F.lit(False)), F.lit(True)).when(F.size(theirs) < 1, F.lit(False)).otherwise(common >= F.greatest(F.lit(2), F.size(told) - 1))


def _either_way(a, b, check):
    return F.startswith(a, F.substring(b, 1, check)) | F.startswith(b, F.substring(a, 1, check))


def _mapped(mine, theirs, at, keep):
    """Letter of my option that says what their option number ``at`` (from 0) says; '' when that is unclear."""
    return T.same_option(mine, F.get(theirs, at), keep)


def bank_answers(questions, bank, key=T.normalize_key, keep=T.CJK + "A-Za-z0-9①-⑳", block=22, check=40, least=12, least_bank=6):
    """Answer of the first bank question that is the same one: (doc, seq, bank_id, ans, original, exp).

    ``questions(doc, seq, stem, options, sig, exp)`` without an answer, ``options`` an array of (letter, text); ``bank(id, stem, options, answer, exp, exp_sig, exp_len)``
    with texts and the answer's place from 0. Tried in turn: the whole stem, its last line, its last two lines. The stems must begin alike
    (either may be the shorter one), the options agree, a long explanation share more than one token with the question. ``original`` is the
    bank's letter, ``exp`` its explanation where the question has none. No row for a question that finds nothing.
    """
    lines = F.filter(F.split("stem", "\n"), lambda x: F.trim(x) != "")
    tail = lambda n: F.when(F.size(lines) > n, F.array_join(F.slice(lines, -n, n), ""))
    keys = F.array(F.struct(F.lit(0).alias("ord"), key(F.col("stem")).alias("k")),
                   *[F.when(F.contains("stem", F.lit("\n")), F.struct(F.lit(i).alias("ord"), key(tail(i)).alias("k"))) for i in (1, 2)])
    b = bank.withColumn("f", key(F.col("stem"))).where((F.length("f") >= least_bank) & F.col("answer").between(0, len(LETTERS) - 1)).withColumn("h", F.substring("f", 1, block))
    # questions that begin like one of the bank, by their stems alone; only these are kept with their options and go on
    asked = (questions.select("doc", "seq", F.explode(keys).alias("x")).where(F.length("x.k") >= least)
             .select("doc", "seq", "x.ord", F.substring("x.k", 1, max(block, check)).alias("k")).withColumn("h", F.substring("k", 1, block)))
    asked = materialize(asked.join(b.select("h").distinct(), "h", "left_semi"))
    q = questions.drop("stem").join(asked.select("doc", "seq").distinct(), ["doc", "seq"], "left_semi")
    told = F.array_distinct(_told(F.col("options"), keep))
    some = F.exists("options", lambda o: F.coalesce(o["text"], F.lit("")) != "")
    q = materialize(q.withColumn("_some", F.coalesce(some, F.lit(False))).withColumn("_told", F.slice(told, 1, 2)))
    asked = asked.join(q.select("doc", "seq", "_some", "_told"), ["doc", "seq"])
    opts = b.select("h", "id", F.explode(F.array_distinct(F.transform("options", lambda o: option_key(o, keep)))).alias("j"))
    met = (asked.where("_some").select("doc", "seq", "ord", "k", "h", F.explode("_told").alias("j")).join(opts, ["h", "j"]).select("doc", "seq", "ord", "k", "id")
           .unionByName(asked.where("NOT _some").join(b.select("h", "id"), "h").select("doc", "seq", "ord", "k", "id")).distinct())
    theirs = b.select("id", "f", F.col("options").alias("_theirs"), "answer", F.col("exp").alias("_exp"), "exp_sig", "exp_len")
    pair = met.join(theirs, "id").where(_either_way(F.col("f"), F.col("k"), check)).join(q.drop("_told"), ["doc", "seq"])
    other = (F.coalesce(F.length("_exp"), F.lit(0)) > 0) & (F.col("exp_len") >= 60) & (F.size("sig") >= 8) & (F.size(F.array_intersect("sig", "exp_sig")) <= 1)
    n = F.size("_theirs")
    original = F.substring(F.lit(LETTERS), F.col("answer") + 1, F.lit(1))
    hit = F.when(F.col("_some") & (n > 0), _mapped(F.col("options"), F.col("_theirs"), F.col("answer"), keep)).otherwise("")
    lost = F.col("_some") & (n > 0) & (F.col("_hit") == "") & (F.size("options") != n)
    ans = F.when(F.col("_hit") != "", F.col("_hit")).otherwise(original)
    good = (pair.where(options_agree(F.col("options"), F.col("_theirs"), keep) & ~F.coalesce(other, F.lit(False)) & ((n <= 0) | (F.col("answer") < n)))
            .withColumn("_hit", hit).where(~lost).withColumn("ans", ans).where(F.exists("options", lambda o: o["letter"] == F.col("ans"))))
    exp = F.when(F.coalesce(F.col("exp"), F.lit("")) == "", F.col("_exp"))
    best = F.min_by(F.struct(F.col("id").alias("bank_id"), "ans", original.alias("original"), exp.alias("exp")), F.struct("ord", "id")).alias("m")
    return good.groupBy("doc", "seq").agg(best).select("doc", "seq", "m.*")


def borrow_answers(rows, key=T.normalize_key, keep=T.CJK + "A-Za-z0-9①-⑳", block=30, check=40, least=12):
    """Unanswered questions take the answer of the first other document that has the same one: (doc, seq, ans, src, exp).

    ``rows(doc, seq, stem, options, ans, exp)``; an answer is a word of letters. Stems must begin alike, options agree and be as many, and every letter
    of the answer must map to a letter of mine. Equal questions are folded on both sides before they meet; two documents per group of
    equal givers are enough, because a taker leaves out only its own.
    """
    k = F.substring(key(F.col("stem")), 1, check)
    # the texts are read once; a filter on what is worked out would work it out again, so it follows the table
    d = materialize(rows.select("doc", "seq", k.alias("k"), "options", F.array_distinct(_told(F.col("options"), keep)).alias("told"), "ans", "exp"))
    d = d.where((F.length("k") >= least) & (F.size("told") > 0))
    has = F.coalesce(F.col("ans"), F.lit("")) != ""
    # beginnings that both givers and takers have; equal hashes of unequal ones only let a few more rows through
    begins = F.xxhash64(F.substring("k", 1, block)).alias("_b")
    both = d.groupBy(begins).agg(F.max(has).alias("g"), F.min(has).alias("n")).where("g AND NOT n").select("_b")
    d = materialize(d.withColumn("_b", begins).join(both, "_b", "left_semi").drop("_b"))
    first = W.partitionBy("k", "options", "ans").orderBy("doc")
    give = (d.where(has).groupBy("k", "options", "ans", "doc").agg(F.min(F.struct("seq", "exp")).alias("r")).withColumn("_n", F.row_number().over(first)).where("_n <= 2")
            .select(F.col("k").alias("f"), F.col("options").alias("o"), F.col("ans").alias("a"), F.col("doc").alias("src"), F.col("r.seq").alias("s"), F.col("r.exp").alias("e"),
                    F.substring("k", 1, block).alias("h")))
    need = d.where(~has)
    groups = need.select("k", "options", "told").distinct().withColumn("h", F.substring("k", 1, block))
    givers = give.withColumn("j", F.explode(F.array_distinct(F.filter(F.transform("o", lambda x: option_key(x["text"], keep)), lambda x: x != ""))))
    met = groups.select("k", "options", "h", F.explode(F.slice("told", 1, 2)).alias("j")).join(givers, ["h", "j"]).drop("h", "j").distinct()
    met = met.where(_either_way(F.col("f"), F.col("k"), check) & (F.size("options") == F.size("o"))
                    & options_agree(F.col("options"), F.transform("o", lambda x: x["text"]), keep))
    said = F.filter("o", lambda x: F.contains(F.col("a"), x["letter"]))
    ans = F.array_join(F.array_sort(F.transform(said, lambda x: T.same_option(F.col("options"), x["text"], keep))), "")
    met = met.withColumn("ans", ans).where(F.length("ans") == F.length("a"))
    per = met.groupBy("k", "options", "src").agg(F.min(F.struct("s", "ans", "e")).alias("r"))
    two = (per.withColumn("_n", F.row_number().over(W.partitionBy("k", "options").orderBy("src"))).where("_n <= 2")
           .groupBy("k", "options").agg(F.array_sort(F.collect_list(F.struct("src", "r"))).alias("c")))
    other = F.get(F.filter("c", lambda x: x["src"] != F.col("doc")), 0)
    return (need.join(two, ["k", "options"]).withColumn("m", other).where("m IS NOT NULL")
            .select("doc", "seq", F.col("m.r.ans").alias("ans"), F.col("m.src").alias("src"), F.col("m.r.e").alias("exp")))


def realign_actions(questions, low=0.15, least=6, letters=40, known=8, long=60, **rules):
    """What becomes of explanations that do not fit their question: (doc, seq, action, to), ``moved`` or ``removed``.

    Moves are those of :func:`realign_by_signature`, one for each question and each explanation. What found no owner, shares nothing with its
    question (of at least ``known`` tokens of its own) and is ``long`` letters or longer is removed.
    """
    actions = explanation_actions(questions, low=low, least=least, letters=letters, known=known, long=long, **rules)
    return actions.select("doc", "seq", "action", "to")


def realign_apply(questions, actions):
    """Questions after their explanations were moved or removed: (doc, seq, exp, ans, how).

    ``questions(doc, seq, letters, exp, ans, how)``. An answer that was read out of an explanation goes with it; the new owner takes the answer that the
    explanation states, if it is one of its letters.
    """
    q = questions.join(actions.select("doc", "seq", F.lit(True).alias("_gone")), ["doc", "seq"], "left")
    said = prose_answer(F.coalesce("exp", F.lit("")))
    new = (q.select("doc", "seq", F.col("exp").alias("_exp"), said.alias("_said")).join(actions.where("action = 'moved'").select("doc", "seq", "to"), ["doc", "seq"])
           .select("doc", F.col("to").alias("seq"), "_exp", "_said"))
    q = q.join(new, ["doc", "seq"], "left")
    drop = F.coalesce("_gone", F.lit(False))
    read = drop & (F.coalesce("ans", F.lit("")) != "") & (said == F.col("ans"))
    given = F.col("_exp").isNotNull()
    fits = given & (F.col("_said") != "") & (F.size(F.array_except(F.filter(F.split("_said", ""), lambda x: x != ""), "letters")) == 0)
    return q.select("doc", "seq", F.when(given, F.col("_exp")).when(drop, F.lit(None)).otherwise(F.col("exp")).alias("exp"),
                    F.when(fits, F.col("_said")).when(read, "").otherwise(F.col("ans")).alias("ans"), F.when(fits, "stated").when(read, "").otherwise(F.col("how")).alias("how"))
