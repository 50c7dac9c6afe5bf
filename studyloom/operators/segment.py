"""Structure out of text: headings, outlines, questions, answer keys, cards, snippets."""
from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from studyloom.functions.text import CJK, normalize_key, only
from studyloom.operators.blocks import LEVELS, by_doc, heading_path, so_far, whole

# Numbering patterns of headings in order of rank, and the ends and forms that no heading has.
_N = "一二三四五六七八九十百零〇两"
HEAD_PATTERNS = [
    rf"^第[{_N}\d]+(篇|部分|编|模块)",
    rf"^(第[{_N}\d]+(章|讲|课|单元)|专题[{_N}\d]+|模块[{_N}\d]+)",
    rf"^(第[{_N}\d]+节|热点[{_N}\d]+|(考点|知识点归纳|知识点|材料归纳|题型|技巧|方法|秒杀)[{_N}\d]+)",
    rf"^[{_N}]+\s*(?:[、.．]|，(?=\S{{2}}))",
    rf"^[（(]\s*[{_N}]+\s*[）)]",
    r"^\d{1,2}\s*[、.．](?!\d)",
]
END_PUNCT = r"[，,。；;：:？?！!、…]$"
NOT_HEAD = r"[=＝≈]|_{3}|^[A-H]\s*[.．、]|^[A-H]{1,6}\s*。|[.．·…]{5,}\s*\d*\s*$"


def head_rank(text, big, bold, patterns=HEAD_PATTERNS, end=END_PUNCT, never=NOT_HEAD, longest=40):
    """Rank of a heading-like line (0 strongest, 6 bold only, 9 large only), NULL when it is none. ``big``/``bold`` are flags."""
    t = F.trim(text)
    n = F.length(t)
    pat = None
    for i, rx in enumerate(patterns):
        pat = F.when(t.rlike(rx), i) if pat is None else pat.when(t.rlike(rx), i)
    bad = (n == 0) | (n > longest) | t.rlike(never) | (t.rlike(end) & ~F.coalesce(pat <= 1, F.lit(False)))
    return (F.when(bad, F.lit(None).cast("int")).when(big & (n <= 24), F.coalesce(pat, F.lit(9))).when((pat <= 4) & (n <= 30), pat)
            .when((pat == 5) & (n <= 18) & bold, pat).when(bold & (n <= 24), 6))


def _title(c, n):
    t = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.substring(t, 1, n), F.lit("…")))


def make_outline(blocks, numbered, short=16, long=30, least=3, small=30, parts=12, floor=6, sentence=r"(?<=[。；！？])"):
    """Outline entries (doc, seq, level, title) for every document.

    Headings when there are enough; else numbered lines are added; else short lines before long ones too; else the first
    sentence of every max(floor, n / parts)-th block. Adjacent repeats are dropped. ``numbered`` is the rank or NULL.
    """
    d = blocks.withColumn("_num", numbered).withColumn("_len", F.length("text"))
    nxt = F.lead("_len").over(by_doc())
    is_h = F.col("kind") == "h"
    plain = ~is_h & (F.col("_len") <= long) & (F.col("_len") > 0)
    d = d.withColumn("_c1", plain & F.col("_num").isNotNull()).withColumn(
        "_c2", plain & F.col("_num").isNull() & (F.col("_len") <= short) & F.coalesce(nxt > F.greatest(F.lit(long), F.col("_len") * 2), F.lit(False)))
    cnt = lambda c: F.sum(F.when(c, 1).otherwise(0)).over(whole())
    d = (d.withColumn("_n", F.count("*").over(whole())).withColumn("_h", cnt(is_h)).withColumn("_k1", cnt(F.col("_c1")))
         .withColumn("_k2", cnt(F.col("_c1") | F.col("_c2"))))
    few = F.col("_n") <= small
    by_h = (F.col("_h") >= least) | ((F.col("_h") > 0) & few)
    by_1 = ~by_h & ((F.col("_k1") >= 2) | ((F.col("_k1") > 0) & few))
    by_2 = ~by_h & ~by_1 & ((F.col("_k2") >= 2) | ((F.col("_k2") > 0) & few))
    rest = ~by_h & ~by_1 & ~by_2
    d = d.withColumn("_t", F.when(F.col("_len") > 0, 1))
    pos = F.count("_t").over(so_far()) - 1
    ntext = F.count("_t").over(whole())
    d = d.withColumn("_step", F.greatest(F.lit(floor), F.floor(ntext / parts))).withColumn("_pos", pos)
    take = (is_h & ~(rest & (F.col("_h") == 0))) | (by_1 & F.col("_c1")) | (by_2 & (F.col("_c1") | F.col("_c2"))) | (
        rest & (F.col("_h") == 0) & F.col("_t").isNotNull() & (F.col("_pos") % F.col("_step") == 0))
    level = F.when(is_h, F.col("level")).when(F.col("_c1") & ~rest, F.when(F.col("_num") <= 3, 1).when(F.col("_num") == 4, 2).otherwise(3)).otherwise(1)
    title = F.when(is_h, _title(F.col("text"), 60)).when(rest, _title(F.get(F.split("text", sentence), F.lit(0)), 24)).otherwise(_title(F.col("text"), 30))
    e = d.where(take).select("doc", "seq", level.cast("bigint").alias("level"), title.alias("title"))
    same = F.regexp_replace("title", r"(?U)\s", "") == F.regexp_replace(F.lag("title").over(by_doc()), r"(?U)\s", "")
    return e.withColumn("_s", F.coalesce(same, F.lit(False))).where("NOT _s").drop("_s")


def outline_match(blocks, marks, prefix=12, longest=60):
    """External bookmarks ``(doc, mark, page, title)`` to the first block of their page or the next that begins alike.

    A bookmark without a block goes to the start of its page (``hit`` = 0).
    """
    norm = lambda c: F.regexp_replace(c, r"(?U)[\s\W_]", "")
    m = marks.select("doc", "mark", "page", norm(F.col("title")).alias("k"), F.explode(F.array("page", F.col("page") + 1)).alias("p"))
    b = blocks.where((F.length("text") <= longest)).select("doc", F.col("page").alias("p"), "seq", norm(F.col("text")).alias("t"))
    k = F.substring("k", 1, prefix)
    alike = F.startswith("t", k) | ((F.col("t") != "") & F.startswith(k, F.substring("t", 1, prefix)))
    hit = m.where("k <> ''").join(b, ["doc", "p"]).where(alike).groupBy("doc", "mark").agg(F.min("seq").alias("seq"))
    start = blocks.groupBy("doc", "page").agg(F.min("seq").alias("start"))
    out = marks.join(hit, ["doc", "mark"], "left").join(start, ["doc", "page"], "left")
    return out.select("doc", "mark", F.coalesce("seq", "start").alias("seq"), F.col("seq").isNotNull().cast("int").alias("hit"))


def toc_pages(blocks, dotted, least=6, share=0.4):
    """Pages whose lines are mostly "title ... page number"."""
    p = blocks.where(F.length(F.regexp_replace("text", r"(?U)\s", "")) >= 4).groupBy("doc", "page").agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("text").rlike(dotted), 1).otherwise(0)).alias("k"))
    return p.where((F.col("n") >= least) & (F.col("k") >= F.col("n") * share)).select("doc", "page")


def split_glued(c):
    """A line of options cut before each following option letter: 'C.x D.y' -> ['C.x', 'D.y']."""
    return F.filter(F.split(c, r"\s*(?=(?<![A-Za-z])[B-H]\s*[.．、](?!\d))"), lambda x: F.trim(x) != "")


OPTION = r"^\s*([A-H])\s*[.．、:：]\s*"
NUMBERED = r"^\s*(\d{1,3})\s*[.．、]\s*"


def question_segment(lines, option=OPTION, numbered=NUMBERED, least=2):
    """Lines to questions: a run of option lines ends a question, its stem reaches up to the numbered line.

    A segment begins at a numbered line and at the first plain line after options; glued options are cut first.
    """
    d = lines.select("doc", "seq", F.posexplode(F.when(F.col("text").rlike(option), split_glued(F.col("text"))).otherwise(F.array("text"))).alias("part", "text"))
    w = W.partitionBy("doc").orderBy("seq", "part")
    is_o = F.col("text").rlike(option)
    d = d.withColumn("_o", is_o).withColumn("_num", F.col("text").rlike(numbered))
    start = ~F.col("_o") & (F.col("_num") | F.coalesce(F.lag("_o").over(w), F.lit(True)))
    d = d.withColumn("_s", F.sum(F.when(start, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    opt = F.struct("seq", "part", F.regexp_extract("text", option, 1).alias("letter"), F.trim(F.regexp_replace("text", option, "")).alias("text"))
    g = d.groupBy("doc", "_s").agg(
        F.min("seq").alias("seq"), F.array_sort(F.collect_list(F.when(~F.col("_o"), F.struct("seq", "part", "text")))).alias("st"),
        F.array_sort(F.collect_list(F.when(F.col("_o"), opt))).alias("op"))
    stem = F.array_join(F.transform("st", lambda x: x["text"]), "\n")
    g = g.where(F.size("op") >= least).withColumn("stem", stem)
    return g.select("doc", "seq", F.regexp_extract("stem", numbered, 1).try_cast("int").alias("num"), F.regexp_replace("stem", numbered, "").alias("stem"),
                    F.transform("op", lambda x: F.struct(x["letter"].alias("letter"), x["text"].alias("text"))).alias("options"))


def is_fragment(options):
    """Options that do not run A, B, C .. or are fewer than two."""
    letters = F.array_join(F.transform(options, lambda o: o["letter"]), "")
    return (F.size(options) < 2) | (letters != F.substring(F.lit("ABCDEFGH"), F.lit(1), F.size(options)))


def question_unfold(questions):
    """Fragments back to paragraphs (stem lines, then one line per option)."""
    lines = F.concat(F.filter(F.split("stem", "\n"), lambda x: F.trim(x) != ""),
                     F.transform(F.filter("options", lambda o: o["text"] != ""), lambda o: F.concat(o["letter"], F.lit(". "), o["text"])))
    return questions.where(is_fragment(F.col("options"))).select("doc", "seq", F.posexplode(lines).alias("part", "text"))


KEY_RANGE = r"(\d{1,3})(?:\s*[-~—–]\s*(\d{1,3}))?\s*[:：]\s*([A-H]+)(?![A-Za-z])"
KEY_DOT = r"(?<!\d)(\d{1,3})\s*[.．、]\s*([A-H]{1,5})(?![A-Za-z])"


def answer_key_expand(rows):
    """'1-5:BBDDC 6-7:CC' and '1.C 2.B' to (num, ans) rows; a range counts only when it has as many letters. First wins."""
    seg = F.explode(F.regexp_extract_all("text", F.lit(KEY_RANGE), F.lit(0))).alias("s")
    r = rows.select("doc", "seq", seg)
    part = lambda i: F.regexp_extract("s", KEY_RANGE, i)
    lo, hi = part(1).cast("int"), F.coalesce(F.nullif(part(2), F.lit("")).cast("int"), part(1).cast("int"))
    r = r.select("doc", "seq", lo.alias("lo"), hi.alias("hi"), part(3).alias("ls")).where(F.col("hi") - F.col("lo") + 1 == F.length("ls"))
    r = r.select("doc", "seq", "lo", F.posexplode(F.split("ls", "")).alias("i", "ans")).where("ans <> ''").select("doc", "seq", (F.col("lo") + F.col("i")).alias("num"), "ans")
    dots = rows.select("doc", "seq", F.regexp_extract_all("text", F.lit(KEY_DOT), F.lit(0)).alias("ds")).where(F.size("ds") >= 2).select(
        "doc", "seq", F.explode("ds").alias("s"))
    dots = dots.select("doc", "seq", F.regexp_extract("s", KEY_DOT, 1).cast("int").alias("num"), F.regexp_extract("s", KEY_DOT, 2).alias("ans"))
    return r.unionByName(dots)


def answer_key_attach(questions, keys, back=600):
    """Keys ``(doc, seq, num, ans)`` fill unanswered questions of the section right above them, at most ``back`` blocks up.

    A section ends where numbers stop rising. A question takes the first key below it that has its number.
    """
    q = questions.withColumn("_sec", F.sum(F.when(F.col("num") > F.lag("num").over(by_doc()), 0).otherwise(1)).over(so_far()))
    marks = q.select("doc", "seq", F.col("_sec").alias("sec")).unionByName(keys.select("doc", "seq").distinct(), allowMissingColumns=True)
    above = F.last("sec", ignorenulls=True).over(so_far())
    where = marks.withColumn("_sec", above).where("sec IS NULL").select("doc", "seq", "_sec")
    k = keys.join(where, ["doc", "seq"]).select("doc", "_sec", F.col("seq").alias("k_seq"), "num", F.col("ans").alias("key"))
    hit = q.where("ans IS NULL").join(k, ["doc", "_sec", "num"]).where((F.col("k_seq") > F.col("seq")) & (F.col("k_seq") - F.col("seq") <= back))
    return hit.groupBy("doc", "seq").agg(F.min(F.struct("k_seq", "key")).alias("m")).select("doc", "seq", F.col("m.key").alias("ans"), "m.k_seq")


# How explanations state the answer and judge options.
PROSE_ANSWER = (r"(?:正确答案|参考答案|答案)\s*(?:是|为|应选|选|应为)?\s*[:：]?\s*[【\[（(]?\s*([A-H]{1,4})(?![A-Za-z])"
                r"|(?:故|因此|所以|即|则|综上)\s*[，,]?\s*(?:本题)?(?:应|正确答案)?(?:选|为|算)(?:择)?\s*[【\[]?\s*([A-H]{1,4})(?![A-Za-z])\s*(?:项|选项)?"
                r"|秒\s*([A-H])(?![A-Za-z])"
                r"|(?:相加|相减|解|求|公式|即可|可以)得\s*([A-H])(?![A-Za-z])\s*(?:项|选项)?\s*(?:[。．.，,；;]|$)"
                r"|(?:^|[。；;，,\s])选\s*([A-H]{1,4})(?![A-Za-z])\s*[，,]"
                r"|(?:本题|此题|该题)(?:应|的答案)?(?:选|为)(?:择)?\s*[【\[]?\s*([A-H]{1,4})(?![A-Za-z])"
                r"|(?<![A-Za-z])([A-H])\s*(?:项|选项)?\s*(?:最为|最)(?:契合|恰当|合适|准确|符合|贴切|正确)"
                r"|(?<![A-Za-z、，,和与])([A-H])\s*(?:项|选项)\s*当选"
                r"|(?:选|答案)\s*[【\[]\s*([A-H]{1,4})\s*[】\]]"
                r"|(?:只有|仅有|唯有)\s*([A-H])\s*(?:选项|项)\s*(?:符合|正确|满足|当选|是|为)?"
                r"|(?<![A-Za-z、和与])([A-H])\s*(?:选项|项)(?:[^。；;A-H]{0,70})[，,]\s*当选"
                r"|对应\s*([A-H])\s*(?:选项|项)\s*[，,。]"
                r"|(?:最优|最佳|正确)选项(?:为|是)\s*([A-H]{1,4})(?![A-Za-z])"
                r"|答案[^。，,；;A-H]{1,6}(?:为|是)\s*([A-H]{1,4})(?![A-Za-z])"
                r"|(?<![误不可难])(?<!容易)选(?:择)?\s*([A-H]{1,4})(?![A-Za-z])\s*(?:项|选项)?\s*(?:更恰当|更好|最恰当|最好|为宜)?\s*(?:[。．.!！;；]|$)")
CHOSEN = r"([A-D])\s*项[：:][^\n]*?当选"
CLOSING = r"故(?:正确)?答案为\s*([A-D])"
CLOSING_TAIL = r"(?:故|因此|所以)?\s*(?:正确)?答案(?:为|是|选)\s*([A-D])\s*(?:项)?[。.]?\s*$|本题选\s*([A-D])"
JUDGED = (r"([A-H](?:\s*[、,，和与及/]\s*[A-H])*)\s*(?:两|三|四)?\s*(?:项|选项)\s*(?:的)?(?:说法|表述|内容|观点)?\s*(?:均|都|也)?\s*"
          r"(不正确|正确|错误|有误|不符合|符合|不属于|属于|不当选|当选|排除|无误)")
RIGHT_WORDS = ["正确", "符合", "属于", "当选", "无误"]
NEGATIVE_STEM = r"错误|不正确|不属于|不符合|不包括|不是|有误|不能|不应|不得|不对|不准确|不恰当|不可能|不涉及|没有体现|未体现|无关"


def prose_answer(text, pattern="(?U)" + PROSE_ANSWER, lead=r"(?U)^\s*([A-H]{1,4})\s*[。．](?!\d)"):
    """Answer letters an explanation opens with, else those of its first conclusion; '' when there is none.

    No form of a conclusion holds other capitals than the letters, so these are found in it once more without asking for its form.
    """
    first = F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), 0)
    found = F.coalesce(F.regexp_extract(first, r"(?<![A-Za-z])([A-H]{1,4})(?![A-Za-z])", 1), F.lit(""))
    head = F.regexp_extract(text, lead, 1)
    return F.when(head != "", head).otherwise(found)


def chosen_answer(text):
    """The one option that an option-by-option explanation calls the chosen one; '' when none or several are."""
    said = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)" + CHOSEN), F.lit(1)))
    return F.when(F.size(said) == 1, F.get(said, 0)).otherwise("")


def closing_answer(text, more="【拓展】"):
    """The conclusion at the end of an explanation, before the part that goes further; '' when there is none."""
    body = F.regexp_replace(F.get(F.split(F.coalesce(text, F.lit("")), more), 0), r"(?U)^\s+|\s+$", "")
    last = lambda found: F.try_element_at(found, F.lit(-1))
    full = last(F.regexp_extract_all(body, F.lit("(?U)" + CLOSING), F.lit(1)))
    tail = last(F.regexp_extract_all(F.right(body, F.lit(40)), F.lit("(?U)" + CLOSING_TAIL), F.lit(0)))
    return F.coalesce(full, F.regexp_extract(tail, "([A-D])", 1), F.lit(""))


def judged_answer(stem, letters, text, judged=JUDGED, right=RIGHT_WORDS, negative=NEGATIVE_STEM):
    """Answer from per-option verdicts: the right ones, or the wrong ones when the stem asks for those; '' when unclear.

    ``letters`` is the array of option letters.
    """
    said = F.regexp_extract_all(text, F.lit(judged), F.lit(0))
    word = lambda s: F.regexp_extract(s, judged, 2)
    ls = lambda cond: F.array_intersect(F.array_distinct(F.flatten(F.transform(F.filter(said, cond), lambda s: F.regexp_extract_all(
        F.regexp_extract(s, judged, 1), F.lit("([A-H])"), F.lit(1))))), letters)
    yes = ls(lambda s: word(s).isin(right))
    no = ls(lambda s: ~word(s).isin(right))
    neg = F.right(F.coalesce(stem, F.lit("")), F.lit(60)).rlike(negative)
    one_left = lambda have: F.when(F.size(have) == F.size(letters) - 1, F.array_except(letters, have)).otherwise(F.array().cast("array<string>"))
    ans = F.when(neg, F.when(F.size(no) > 0, no).otherwise(one_left(yes))).otherwise(F.when(F.size(yes) > 0, yes).otherwise(one_left(no)))
    clear = (F.size(letters) >= 2) & ~F.arrays_overlap(yes, no)
    return F.when(F.coalesce(clear, F.lit(False)), F.array_join(F.array_sort(ans), "")).otherwise("")


def card_extract(docs, patterns, least=30, lead=1.15, id_col="doc"):
    """Cards (front, back) by the pattern that finds the most, tried in order; a later one needs ``lead`` times as many.

    ``patterns`` have two groups and match inside a line. Decks under ``least`` cards are dropped; cards equal in front and
    first 20 characters of the back are one.
    """
    lines = docs.select(id_col, F.posexplode(F.split("text", "\n")).alias("line", "t"))
    found = None
    for i, rx in enumerate(patterns):
        c = lines.select(id_col, F.lit(i).alias("p"), "line", F.posexplode(F.regexp_extract_all("t", F.lit(rx), F.lit(0))).alias("at", "m"))
        c = c.select(id_col, "p", "line", "at", F.trim(F.regexp_extract("m", rx, 1)).alias("front"), F.trim(F.regexp_extract("m", rx, 2)).alias("back"))
        found = c if found is None else found.unionByName(c)
    n = found.groupBy(id_col).agg(*[F.sum(F.when(F.col("p") == i, 1).otherwise(0)).alias(f"n{i}") for i in range(len(patterns))])
    best, size = F.lit(-1), F.lit(0)
    for i in range(len(patterns)):
        wins = F.col(f"n{i}") > size * lead
        best, size = F.when(wins, i).otherwise(best), F.when(wins, F.col(f"n{i}")).otherwise(size)
    n = n.select(id_col, best.alias("p"), size.alias("n")).where(F.col("n") >= least).select(id_col, "p")
    return (found.join(n, [id_col, "p"]).groupBy(id_col, "front", F.substring("back", 1, 20).alias("b20"))
            .agg(F.min(F.struct("line", "at", "back")).alias("m")).select(id_col, "front", "m.back"))


def snippet_extract(blocks, kinds, default, good, attrib=r"^(.*?[”」』。！？!?])\s*[—–-]{1,2}\s*(.{1,40})$", quote_types=(), levels=LEVELS):
    """Typed snippets out of the paragraphs of titled sections.

    ``kinds`` maps heading patterns to types in order, ``default`` is the document's type; ``good`` the accept rule. A quote
    type gives up its attribution to the note. The first of equal texts per document stays.
    """
    p = heading_path(blocks, levels).where("kind = 'p'")
    typ = None
    for rx, name in kinds:
        typ = F.when(F.col("path").rlike(rx), name) if typ is None else typ.when(F.col("path").rlike(rx), name)
    typ = typ.otherwise(default) if typ is not None else F.lit(default)
    p = p.where(good).withColumn("type", typ)
    quoted = F.col("type").isin(list(quote_types)) & F.col("text").rlike(attrib) if quote_types else F.lit(False)
    p = p.withColumn("note", F.when(quoted, F.concat(F.lit("—"), F.trim(F.regexp_extract("text", attrib, 2)))).otherwise(""))
    p = p.withColumn("text", F.when(quoted, F.trim(F.regexp_extract("text", attrib, 1))).otherwise(F.col("text")))
    first = p.groupBy("doc", F.md5("text").alias("_h")).agg(F.min("seq").alias("seq"))
    return p.join(first.drop("_h"), ["doc", "seq"], "left_semi").select("doc", "seq", "type", "path", "text", "note")


def sentence_split(docs, verbs, excluded, ends=r"(?<=[。；！])", lo=10, hi=90, digits=4, couplet=26, comma="[，,]", tail="[。！]$", id_col="doc"):
    """Sentences of official texts that are worth keeping: begun by a policy verb (phrase) or a balanced couplet (quote)."""
    s = docs.select(id_col, F.posexplode(F.split("text", ends)).alias("pos", "s")).withColumn("text", F.trim("s"))
    t = F.col("text")
    s = s.where(F.length(t).between(lo, hi) & (F.regexp_count(t, F.lit(r"\d")) <= digits) & ~t.rlike(excluded))
    parts = F.filter(F.split(F.regexp_replace(t, tail, ""), comma), lambda x: x != "")
    pair = (F.length(t) <= couplet) & (F.size(parts) == 2) & (F.abs(F.length(F.get(parts, F.lit(0))) - F.length(F.get(parts, F.lit(1)))) <= 2)
    typ = F.when(t.rlike(verbs), "phrase").when(F.coalesce(pair, F.lit(False)), "quote")
    return s.withColumn("type", typ).where("type IS NOT NULL").select(id_col, "pos", "type", "text")


def daily_words(days, sentence=r"(\d{1,2})、", word=r"\((\d{1,2})\)\s*([^:：()\n]{1,30})[:：]", least=6):
    """``days(day, text)`` of numbered sentences and '(n) word: meaning' marks; text belongs to the mark before it.

    Every sentence lists the words it contains. One day is one text cell.
    """
    mark = f"(?:{sentence}|{word})".replace("(\\d{1,2})", "\\d{1,2}").replace("([^", "[^").replace("{1,30})[:", "{1,30}[:")
    seg = rf"(?s)({mark})(.*?)(?={mark}|$)"
    d = days.select("day", F.posexplode(F.regexp_extract_all("text", F.lit(seg), F.lit(0))).alias("i", "s"))
    body = F.trim(F.regexp_replace(F.regexp_replace("s", rf"^(?:{mark})", ""), r"\s*\n\s*", ""))
    d = d.select("day", "i", F.regexp_extract("s", f"^{word}", 2).alias("w"), F.regexp_extract("s", r"^\(?(\d{1,2})", 1).cast("int").alias("n"), body.alias("body"))
    words = d.where("w <> '' AND body <> ''").groupBy("day").agg(F.array_sort(F.collect_list(F.struct("i", "n", F.trim("w").alias("w"), F.col("body").alias("m")))).alias("ws"))
    sents = d.where((F.col("w") == "") & (F.length("body") >= least)).groupBy("day", "n").agg(F.min(F.struct("i", "body")).alias("x"))
    s = sents.join(words, "day", "left").select("day", "n", F.col("x.body").alias("text"), F.transform(
        F.filter(F.coalesce("ws", F.array().cast("array<struct<i:int,n:int,w:string,m:string>>")), lambda w: F.contains(F.col("x.body"), w["w"])), lambda w: w["w"]).alias("words"))
    return s, words.select("day", F.explode("ws").alias("x")).select("day", "x.n", F.col("x.w").alias("word"), F.col("x.m").alias("meaning"))


COLUMN_TESTS = [("num", r"^\d{1,4}$", 0.5), ("ans", r"^[A-D]$", 0.5), ("exp", r"正确答案|当选|排除|故选", 0.3), ("src", r"^(?:19|20)\d\d", 0.5)]


def column_roles(cells, tests=COLUMN_TESTS, option=r"(?:[A-D]\s*[.．、].*){3}", by=()):
    """Role of each column of a table from the share of its cells that pass each test; a column is used once.

    ``cells(.., col, value)``. Counts come first, so the choice runs over a handful of columns.
    """
    v = F.trim("value")
    st = cells.where(v != "").groupBy(*by, "col").agg(
        F.count("*").alias("n"), F.sum(F.length(v)).alias("len"), F.sum(F.when(v.rlike(option), 1).otherwise(0)).alias("opt"),
        *[F.sum(F.when(v.rlike(rx), 1).otherwise(0)).alias(k) for k, rx, _ in tests])
    share = F.struct("col", *[(F.col(k) / F.col("n")).alias(k) for k, _, _ in tests], (F.col("opt") / F.col("n")).alias("opt"), "len")
    d = st.groupBy(*by).agg(F.array_sort(F.collect_list(share)).alias("cs")) if by else st.agg(F.array_sort(F.collect_list(share)).alias("cs"))
    used = []

    def unused(c):
        return reduce(lambda a, u: a & ~F.coalesce(c["col"] == F.col(u), F.lit(False)), used, F.lit(True))

    def best(by_cols, keep):
        free = F.filter("cs", keep)
        return F.array_max(F.transform(free, lambda c: F.struct(*[c[x].alias(f"s{i}") for i, x in enumerate(by_cols)], c["col"].alias("c"))))["c"]

    def pick(k, th):
        return best([k], lambda c: unused(c) & (c[k] >= th))
    for k, _, th in tests:
        d = d.withColumn(k, pick(k, th))
        used.append(k)
    d = d.withColumn("q", best(["opt", "len"], unused))
    return d.drop("cs")


def video_groups(files, course):
    """Files grouped by folder, in the order of the number in the name; ``course`` is a rule column."""
    folder = F.regexp_replace("rel", "/[^/]*$", "")
    name = F.regexp_replace(F.element_at(F.split("rel", "/"), -1), r"\.\w+$", "")
    order = F.coalesce(F.nullif(F.regexp_extract("rel", r"/[^/\d]*(\d{1,3})[^/]*$", 1), F.lit("")).try_cast("int"), F.lit(999))
    return files.select("fid", folder.alias("folder"), name.alias("name"), order.alias("ord"), course.alias("course"))


def letter_answers(blocks, letter):
    """Lines that are only a letter answer the nearest non-heading row above when that is an unanswered question."""
    body = blocks.where("kind <> 'h'").withColumn("_l", letter)
    prev = F.lag(F.struct("kind", "ans", "seq")).over(by_doc())
    d = body.withColumn("_p", prev)
    return d.where(F.col("_l").isNotNull() & (F.col("_p.kind") == "q") & F.col("_p.ans").isNull()).select("doc", F.col("_p.seq").alias("seq"), F.col("_l").alias("ans"))


def fingerprint(stem, options, keep=CJK + "A-Za-z0-9"):
    return F.concat(F.substring(normalize_key(stem, keep), 1, 40), F.lit("|"),
                    F.array_join(F.transform(options, lambda o: F.substring(only(o["text"], keep), 1, 6)), "/"))


def manual_answer_overlay(questions, manual):
    """Unanswered questions take answer and note from ``manual(k, ans, note, notq)`` by fingerprint.

    A bracketed choice in the own explanation comes first; letters that are no option are refused; ``notq`` marks non-questions.
    """
    d = questions.join(manual.select(F.col("k"), F.col("ans").alias("_a"), F.col("note").alias("_n"), F.col("notq").alias("_q")), "k", "left")
    own = F.nullif(F.regexp_extract(F.coalesce("exp", F.lit("")), r"[【\[（(]\s*([A-H]{1,4})\s*[】\]）)]", 1), F.lit(""))
    valid = lambda a: F.when(F.size(F.array_except(F.filter(F.split(a, ""), lambda x: x != ""), F.col("letters"))) == 0, a)
    ans = F.coalesce("ans", valid(own), F.when(F.coalesce("_q", F.lit(0)) == 0, valid(F.col("_a"))))
    return d.select("doc", "seq", ans.alias("ans"), F.when(F.col("ans").isNull(), F.col("_n")).alias("note"),
                    F.when(F.col("ans").isNull(), F.coalesce("_q", F.lit(0))).otherwise(0).cast("int").alias("notq"))
