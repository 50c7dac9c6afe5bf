"""Flash cards and per-passage answer keys read out of the ordered lines of a document.

A document's lines come out of one row, so everything here is an expression over its array of lines: no shuffle, no Python.
"""
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from studyloom.functions.text import CJK

# How cards are written, as patterns over a class of letters.
ENTRY = r"^\s*(\d{1,4})\s*[、.．]\s*([%s，、]{2,14})\s*[：:]\s*(.{2,})$"
HEAD = r"^\s*(\d{1,4})\s*[、.．]\s*([%s]{3,8})\s*$"
WORD = r"(?:^|(?<=[。；;）)\s]))([%s]{2,4})\s*[：:]"
EXAMPLE = r"^\s*例\s*[：:]"
GLOSS = r"^\s*(拆解|释义|解析|意思)\s*[：:]\s*"
GLOSS_TAIL = r"(拆解|释义|解析|意思)$"
ANSWER = r"^\s*([^,，]{1,60})"
NUMBER = r"^[\s,，]*(\d{1,5}\s*[.．、])?\s*"

_CARDS = "array<struct<front:string,back:string>>"
_U = "(?U)"


def _strip(c):
    return F.regexp_replace(c, _U + r"^\s+|\s+$", "")


def _once(value, use):
    """``use(value)`` with the value worked out once: inside a lambda Spark works out every mention again."""
    return F.get(F.transform(F.array(value), use), 0)


def _coloned(lines):
    """Lines with a colon of either width, which a search for bytes tells faster than a pattern."""
    return F.filter(lines, lambda p: F.contains(p, F.lit("：")) | F.contains(p, F.lit(":")))


def _card(front, back):
    return F.struct(front.alias("front"), back.alias("back"))


def question_cards(lines, arrow="->"):
    """``question->answer,``: any number in a line; the answer ends at a comma or after 60 characters."""
    def of_line(p):
        parts = F.split(p, arrow)
        # place (from 1) of each arrow: the lengths of what stands before it
        ends = F.transform(F.filter(F.transform(parts, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda x: x["i"] > 0), lambda x: x["i"])
        ends = F.transform(ends, lambda i: F.length(F.array_join(F.slice(F.split(p, arrow), F.lit(1), i), arrow)))

        def step(acc, end):
            rest = F.substr(p, end + 1 + len(arrow), F.lit(1 << 30))
            q = F.substr(p, acc["pos"] + 1, F.greatest(F.lit(0), end - acc["pos"]))
            read = F.struct(F.regexp_extract(rest, _U + ANSWER, 0).alias("taken"), _strip(F.regexp_extract(rest, _U + ANSWER, 1)).alias("a"), _strip(F.regexp_replace(q, _U + NUMBER, "")).alias("q"))

            def taken(r):
                good = (r["taken"] != "") & F.length(r["q"]).between(4, 160) & (r["a"] != "")
                return F.struct(F.when(r["taken"] != "", end + len(arrow) + F.length(r["taken"])).otherwise(acc["pos"]).alias("pos"),
                                F.when(good, F.concat(acc["got"], F.array(_card(r["q"], r["a"])))).otherwise(acc["got"]).alias("got"))
            return _once(read, taken)
        start = F.struct(F.lit(0).alias("pos"), F.array().cast(_CARDS).alias("got"))
        return F.aggregate(ends, start, step)["got"]
    return F.flatten(F.transform(F.filter(lines, lambda p: F.contains(p, F.lit(arrow))), of_line))


def entry_cards(lines, letters=CJK):
    """``12、word：meaning`` on one line."""
    rx = _U + ENTRY % letters
    return F.transform(F.filter(_coloned(lines), lambda p: p.rlike(rx)), lambda p: _card(F.regexp_extract(p, rx, 2), _strip(F.regexp_extract(p, rx, 3))))


def head_cards(lines, letters=CJK):
    """``12．word`` alone on a line; the card's back are the lines below it, three at most, up to the next head or an example."""
    rx = _U + HEAD % letters

    def of_place(i):
        below = F.slice(lines, i + 2, 3)
        stops = F.transform(below, lambda p: p.rlike(rx) | p.rlike(_U + EXAMPLE))
        n = F.when(F.array_contains(stops, True), F.array_position(stops, True) - 1).otherwise(F.size(below)).cast("int")
        body = F.transform(F.slice(below, F.lit(1), n), lambda p: F.regexp_replace(p, _U + GLOSS, ""))
        return F.struct(F.regexp_extract(F.get(lines, i), rx, 2).alias("front"), F.substring(F.array_join(body, " "), 1, 300).alias("back"), n.alias("n"))
    places = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(rx))
    some = F.filter(F.transform(places, of_place), lambda c: c["n"] > 0)
    return F.when(F.size(lines) > 0, F.transform(some, lambda c: _card(c["front"], c["back"]))).otherwise(F.array().cast(_CARDS))


def word_cards(lines, letters=CJK):
    """``word：meaning`` one after the other in a line."""
    def of_line(p):
        marked = F.slice(F.split(F.regexp_replace(p, _U + WORD % letters, "\u0001$1\u0002"), "\u0001"), 2, 1 << 30)
        return F.transform(F.transform(marked, lambda x: F.split(x, "\u0002", 2)), lambda x: _card(F.get(x, 0), _strip(F.get(x, 1))))
    return F.filter(F.flatten(F.transform(_coloned(lines), of_line)), lambda c: F.length(c["back"]).between(2, 200))


def deck_cards(docs, letters=CJK, least=30, lead=1.15, id_col="doc", text_col="text"):
    """Cards (front, back) of every document that is a deck: (doc, pos, front, back).

    Four ways of writing cards are tried in turn; a later one needs ``lead`` times as many cards. Cards with equal front and first 20 characters of the
    back are one; documents with fewer than ``least`` such cards are no decks.
    """
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    found = docs.select(id_col, lines.alias("_l")).select(id_col, F.array(question_cards(F.col("_l")), entry_cards(F.col("_l"), letters),
                                                                         head_cards(F.col("_l"), letters), word_cards(F.col("_l"), letters)).alias("_f"))
    best = F.aggregate("_f", F.array().cast(_CARDS), lambda acc, c: F.when(F.size(c) > F.size(acc) * F.lit(lead), c).otherwise(acc))
    cards = (found.select(id_col, F.posexplode(best).alias("pos", "c")).where(F.col("pos") >= 0)
             .select(id_col, "pos", F.regexp_replace("c.front", GLOSS_TAIL, "").alias("front"), F.col("c.back").alias("back")))
    first = cards.groupBy(id_col, F.concat_ws("|", "front", F.substring("back", 1, 20)).alias("_k")).agg(F.min(F.struct("pos", "front", "back")).alias("c"))
    n = F.count("*").over(W.partitionBy(id_col))
    return first.withColumn("_n", n).where(F.col("_n") >= least).select(id_col, "c.pos", "c.front", "c.back")


# An answer line behind a passage, its pairs, and the number a question had in its source.
PASSAGE_KEY = r"^\s*第\s*\d{1,3}\s*篇\s*(?=\d{1,3}\s*[-－—–]\s*[A-H])"
PASSAGE_PAIR = r"(?<![\d.A-Za-z])(\d{1,3})\s*[-－—–]\s*([A-H]{1,4})(?![A-Za-z])"
INNER_NUMBER = r"^[^\n。]{0,30}?[）)】\]]\s*(\d{1,3})\s*[.．]"


def passage_keys(blocks, key=PASSAGE_KEY, pair=PASSAGE_PAIR, inner=INNER_NUMBER):
    """Answer lines behind passages give the questions back to the previous such line their answers: (doc, seq, k_seq, ans, note).

    ``blocks(doc, seq, kind, text, num, letters, ans)``: questions (``q``) with number and letters as text, everything else with its text; a document's first
    block is its title. A line with fewer than two pairs ends a stretch and gives nothing. Within a stretch the question nearest to the
    line is served first, each number once: by its own number, else by the one in front of its stem. A number also goes to a question that has
    an answer, or does not offer the letters; neither is changed. ``note``: what stands behind the pair.
    """
    back = W.partitionBy("doc").orderBy(F.desc("seq"))
    is_key = F.coalesce(F.col("kind").isin("p", "box", "tbl") & F.col("text").rlike(_U + key), F.lit(False))
    marked = F.split(F.regexp_replace(F.regexp_replace("text", _U + key, ""), _U + pair, "\u0001$1\u0002$2\u0002"), "\u0001")
    parts = F.transform(F.slice(marked, 2, 1 << 30), lambda x: F.split(x, "\u0002", 3))
    own = F.regexp_extract(F.substring("text", 1, 50), _U + inner, 1)
    asks = F.col("kind") == "q"
    # texts end here: a line is its pairs, a question its numbers
    d = blocks.where("doc IS NOT NULL").select("doc", "seq", is_key.alias("_k"), F.coalesce(asks, F.lit(False)).alias("_q"), F.when(is_key, parts).alias("_p"),
                                               F.when(asks, F.filter(F.array(F.col("num"), own), lambda x: x != "")).alias("nums"), "letters", "ans")
    # from the end, the line behind a block is the last one met, and a block that nothing stands before is the title
    k_seq = F.last(F.when(F.col("_k"), F.col("seq")), ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, -1))
    d = d.withColumn("k_seq", k_seq).withColumn("_title", F.lead(F.lit(False), 1, True).over(back))
    asked = F.col("_q") & ~F.col("_title") & F.col("k_seq").isNotNull() & F.col("seq").isNotNull() & (F.size("nums") > 0)
    # a line and the questions that it serves are one row
    stretch = (d.where((F.col("_k") & (F.size("_p") >= 2)) | asked).groupBy("doc", F.when(F.col("_k"), F.col("seq")).otherwise(F.col("k_seq")).alias("k_seq"))
               .agg(F.first(F.when(F.col("_k"), F.col("_p")), ignorenulls=True).alias("_p"),
                    F.sort_array(F.collect_list(F.when(asked, F.struct("seq", "nums", "letters", "ans"))), asc=False).alias("qs"))
               .where(F.col("_p").isNotNull() & (F.size("qs") > 0)))
    stretch = stretch.select("doc", "k_seq", "qs", "_p", F.transform("_p", lambda x: F.get(x, 0)).alias("_n"))
    got = "array<struct<seq:bigint,num:string,letters:string,ans:string>>"

    def serve(acc, x):
        n = F.get(F.filter(x["nums"], lambda y: F.array_contains("_n", y) & ~F.array_contains(acc["num"], y)), 0)
        more = F.transform(F.filter(F.array(n), lambda y: y.isNotNull()), lambda y: F.struct(x["seq"].cast("bigint").alias("seq"), y.alias("num"), x["letters"].alias("letters"), x["ans"].alias("ans")))
        return F.concat(acc, more)
    served = stretch.select("doc", "k_seq", "_p", "_n", F.inline(F.aggregate("qs", F.array().cast(got), serve))).where(F.coalesce(F.col("ans"), F.lit("")) == "")
    served = served.select("doc", "seq", "k_seq", "letters", F.get("_p", (F.array_position("_n", F.col("num")) - 1).cast("int")).alias("r"))
    offered = F.forall(F.filter(F.split(F.get("r", 1), ""), lambda c: c != ""), lambda c: F.contains("letters", c))
    return served.where(offered).select("doc", "seq", "k_seq", F.get("r", 1).alias("ans"), _strip(F.get("r", 2)).alias("note"))
