"""Text column functions. Character classes are parameters, so the same rules serve CJK and Latin text."""
import re
import unicodedata
from functools import reduce

from pyspark.sql import functions as F

CJK = "一-鿿"
LATIN = "A-Za-zÀ-ÿ"

# Filler words of spoken answers, number units, Chinese numerals.
FILLERS = ["嗯", "啊", "那个", "然后", "就是", "这个", "对吧", "其实"]
UNITS = {"万亿": 1e12, "亿": 1e8, "万": 1e4, "千": 1e3}
CN_DIGITS = {"一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
SIG_STOP = ("定位 资料 可知 判定 本题 问题 根据 题干 选项 正确 答案 因此 选择 可得 结合 公式 计算 已知 题目 文段 下列 以下 "
            "说法 表述 内容 符合 属于 排除 当选 故本 故正 确答 案为 项正 项错 错误 易错 错项 确率 正确率").split()


def only(c, keep):
    """Drop every character outside the class ``keep``. Whole runs are taken over, which costs a third of replacing the rest one by one."""
    return F.array_join(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"([{keep}]+)"), F.lit(1)), "")


def squeeze(c):
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "")


def one_space(c):
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def token_estimate(c):
    """Rough token count: CJK characters / 1.5 + all others / 4, plus one."""
    cjk = F.length(F.regexp_replace(c, f"[^{CJK}]", ""))
    return (F.floor(cjk / 1.5 + (F.length(c) - cjk) / 4.0) + 1).cast("bigint")


def chars_per_minute(c, seconds):
    return F.bround(F.length(squeeze(c)) / (seconds / 60.0)).cast("bigint")


def count_word(c, word):
    """Non-overlapping occurrences of a literal word."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(word)))) / len(word)).cast("bigint")


def filler_counts(c, fillers=FILLERS):
    """Map of filler word -> count, only those that occur."""
    t = squeeze(c)
    return F.map_filter(F.map_from_arrays(F.array(*[F.lit(w) for w in fillers]), F.array(*[count_word(t, w) for w in fillers])),
                        lambda k, v: v > 0)


# Labels, item numbers and bracketed sources in front of a stem, stripped in this order.
STEM_PREFIXES = [
    r"^\s*[※*]?\s*(?:[【\[]\s*(?:例\s*题?|练习|习题|真题|典型例题|拓展|巩固|变式)\s*(\d+)?\s*[】\]]|(?:例\s*题?|练习|习题)\s*(\d+)\s*[.．、:：]?|例题\s*[：:])\s*",
    r"^\s*\d{1,3}\s*[.．、]\s*",
    r"^\s*[（(][^）)]{0,20}[）)]\s*",
    r"^\s*\d{1,3}\s*[.．、]\s*(?=\D|\d{4})",
]


def normalize_key(c, keep=CJK + "A-Za-z0-9", prefixes=STEM_PREFIXES):
    """Fingerprint of a stem: no labels, numbers or source brackets in front, only characters of ``keep``."""
    t = F.coalesce(c, F.lit(""))
    for rx in prefixes:
        t = F.regexp_replace(t, "(?U)" + rx, "")
    return F.regexp_replace(t, f"[^{keep}]", "")


def clean_title(c, ads="淘宝|店铺|公众号|微信|小铺"):
    """Titles without bracketed shop ads and timestamp tails; the original where nothing would be left."""
    t = F.regexp_replace(F.regexp_replace(c, rf"[（(][^（）()]*({ads})[^（）()]*[）)]", ""), r"[_\-]\d{8,}$", "")
    t = F.regexp_replace(t, r"^[ _\-]+|[ _\-]+$", "")
    return F.when(t == "", c).otherwise(t)


def parse_score(c, mark="【得分】"):
    """(score, full) in the first 400 characters; NULL when absent, full <= 0 or the score is far above it."""
    head = F.substring(F.coalesce(c, F.lit("")), 1, 400)
    rx = mark + r"\s*(\d+(?:\.\d+)?)\s*/\s*(\d+(?:\.\d+)?)"
    s, f = F.regexp_extract(head, rx, 1).try_cast("double"), F.regexp_extract(head, rx, 2).try_cast("double")
    ok = (f > 0) & (s <= f * 1.05)
    return F.when(ok, F.least(s, f)).alias("score"), F.when(ok, f).alias("full")


def quantity_parse(c):
    """Number with a unit (%, thousands and up, a counted noun) as a double; NULL when the text is anything else."""
    rx = r"^\s*([-+]?\d+(?:\.\d+)?)\s*(%|万亿|亿|万|千)?\s*(?:元|人|个|件|吨|美元|亿元|万元)?\s*$"
    n, u = F.regexp_extract(c, rx, 1).try_cast("double"), F.regexp_extract(c, rx, 2)
    m = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    return F.when(u == "%", n / 100).otherwise(n * F.coalesce(F.try_element_at(m, u), F.lit(1.0)))


def nearest_option(value, options, close=0.03, apart=2.5):
    """Letter of the option (array of doubles) nearest to ``value``; NULL unless it is close and the second is not."""
    errs = F.array_sort(F.transform(options, lambda o, i: F.struct((F.abs(o - value) / F.abs(value)).alias("e"), i.alias("i"))))
    first, second = F.get(errs, 0), F.get(errs, 1)
    ok = (value != 0) & ~F.exists(options, lambda o: o.isNull()) & (F.size(options) >= 2) & (first["e"] < close) & (second["e"] > first["e"] * apart)
    return F.when(ok, F.substring(F.lit("ABCDEFGH"), first["i"] + 1, F.lit(1)))


def percent_to_fraction(p):
    """Simplest fraction with denominator 2-20 within 1.2% of a percentage, as 'n/d'; NULL when there is none."""
    x = p / 100
    cand = F.transform(F.sequence(F.lit(2), F.lit(20)), lambda d: F.struct(F.bround(x * d).cast("int").alias("n"), d.alias("d")))
    low = lambda c: F.forall(F.sequence(F.lit(2), F.lit(20)), lambda k: ~((c["n"] % k == 0) & (c["d"] % k == 0)))
    good = F.filter(cand, lambda c: (c["n"] > 0) & (F.abs(c["n"] / c["d"] - x) / x < 0.012) & low(c))
    best = F.get(good, 0)
    return F.when(best.isNotNull(), F.concat(best["n"].cast("string"), F.lit("/"), best["d"].cast("string")))


def same_option(options, text, keep=CJK + "A-Za-z0-9①-⑳"):
    """Letter whose text is the wanted one: whole, first 16, first 8 characters, or one being the other's beginning.

    Each stage answers only with a single hit; several hits at a stage end the search. ``options``: array of (letter, text).
    """
    want = only(text, keep)
    keys = F.filter(F.transform(options, lambda o: F.struct(o["letter"].alias("letter"), only(o["text"], keep).alias("k"))), lambda o: o["k"] != "")

    def alike(n):
        return F.filter(keys, lambda o: F.substring(o["k"], 1, n) == F.substring(want, 1, n))
    stages = [F.filter(keys, lambda o: o["k"] == want), alike(16), alike(8)]
    last = F.filter(keys, lambda o: o["k"].startswith(want) | F.startswith(want, o["k"]))
    res = F.when(F.size(last) == 1, F.get(last, 0)["letter"]).otherwise("")
    for s in reversed(stages):
        res = F.when(F.size(s) == 1, F.get(s, 0)["letter"]).when(F.size(s) > 1, "").otherwise(res)
    return F.when(want == "", "").otherwise(res)


def cn_numeral(c):
    """Digits (full-width too), one Chinese numeral or ten to nineteen as an int; NULL for the empty text."""
    t = F.translate(c, "０１２３４５６７８９", "0123456789")
    m = F.create_map(*[F.lit(x) for kv in CN_DIGITS.items() for x in kv])
    unit = lambda pos: F.try_element_at(m, F.substring(t, pos, 1))
    return (F.when(F.coalesce(t, F.lit("")) == "", F.lit(None).cast("int")).when(t.rlike("^[0-9]+$"), t.try_cast("int"))
            .when(t == "十", 10).when(t.startswith("十"), 10 + F.coalesce(unit(2), F.lit(0))).otherwise(unit(1)))


def version_parts(c):
    """First four numbers of a version text; arrays compare element by element, as versions should."""
    return F.slice(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(\d+)")), lambda x: x.try_cast("bigint")), 1, 4)


def version_newer(a, b):
    return version_parts(a) > version_parts(b)


def stable_id(c, n=12, prefix=""):
    return F.concat(F.lit(prefix), F.substring(F.md5(c), 1, n))


def _plain_forms():
    odd = [chr(i) for low, high in ((0x2E80, 0x2FFF), (0xF900, 0xFAFF), (0x1D400, 0x1D7FF)) for i in range(low, high + 1)]
    forms = {c: unicodedata.normalize("NFKC", c) for c in odd}
    return {c: f for c, f in forms.items() if f != c}


def unicode_fix(c):
    """Radicals, compatibility ideographs and mathematical letters to their plain forms; other characters stay."""
    forms = _plain_forms()  # one character each
    return F.translate(c, "".join(forms), "".join(forms.values()))


def shingles(c, n):
    """Every run of n characters, by a look-ahead pattern: linear in the length of the text."""
    return F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def char_bigrams(c, letters=CJK, stop=SIG_STOP):
    """Signature tokens: distinct letter bigrams and long or decimal numbers, without the stop list. No blanks inside."""
    t = squeeze(c)
    pairs = F.regexp_extract_all(t, F.lit(f"(?=([{letters}]{{2}}))"), F.lit(1))
    nums = F.regexp_extract_all(t, F.lit(r"(\d+\.\d+|\d{3,})"), F.lit(1))
    return F.array_except(F.array_distinct(F.concat(pairs, nums)), F.array(*[F.lit(w) for w in stop]))


def repair_text(c, masks=(), radicals=("", ""), ads=()):
    """Zero-width characters out, masked words back, look-alike characters translated, inline ads out, blanks collapsed."""
    t = F.regexp_replace(c, "[​‌‍﻿]", "")
    for rx, word in masks:
        t = F.regexp_replace(t, rx, word)
    if radicals[0]:
        t = F.translate(t, *radicals)
    for rx in ads:
        t = F.regexp_replace(t, rx, "")
    return F.trim(F.regexp_replace(t, "[ \t　]+", " "))


# Words that files mask, and what they stand for.
MASKED_WORDS = (("国\\s*[Ww]\\s*院", "国务院"), ("[Zz]\\s*央", "中央"), ("(?<![A-Z.．])D建(?=思想|工作|引领)", "党建"))


def has_all(c, words):
    return reduce(lambda a, b: a & b, [c.contains(w) for w in words], F.lit(True))


def _let(value, body):
    """``body(value)`` with the value worked out once: an expression that a lambda names is worked out again for each of its items."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _pieces(glued, n, marks, lengths, explain, longest):
    """``glued`` in ``n`` pieces of at most ``longest`` letters, no mark inside a piece; NULL if there is no such cut.

    A piece scores 3 when the explanation quotes it, 1 when it names it, and 1 more for the usual length. Piece by piece from
    the end, the best cut of the rest from every place on is kept; of equal ones that with the shorter first piece.
    """
    size = F.length(glued)
    quoted = lambda x: F.exists(F.array(*[F.lit(o) for o in "\"“”「"]), lambda o: F.exists(F.array(*[F.lit(c) for c in "\"“”「"]), lambda c: F.contains(explain, F.concat(o, x, c))))
    nothing = F.struct(F.lit(0).alias("score"), F.array().cast("array<string>").alias("pieces"))
    ends = F.transform(F.sequence(F.lit(0), size), lambda at: F.when(at == size, nothing))

    def longer(rest, k):
        usual = F.element_at(lengths, n - k + 1)

        def cut(at, end):
            x, tail = F.substring(glued, at + 1, end - at), F.element_at(rest, end + 1)
            score = tail["score"] + F.when(F.contains(explain, x), F.when(quoted(x), 3).otherwise(1)).otherwise(0) + F.when(F.length(x) == usual, 1).otherwise(0)
            inside = F.exists(marks, lambda m: (m > at) & (m < end))
            return F.when(tail.isNotNull() & ~inside, F.struct(score.alias("score"), (-end).alias("first"), F.concat(F.array(x), tail["pieces"]).alias("pieces")))

        def best(at):
            top = F.array_max(F.transform(F.sequence(at + 1, F.least(at + longest, size)), lambda end: cut(at, end)))
            return F.when(at < size, _let(top, lambda m: F.when(m.isNotNull(), F.struct(m["score"].alias("score"), m["pieces"].alias("pieces")))))
        return F.transform(F.sequence(F.lit(0), size), best)
    return F.element_at(F.aggregate(F.sequence(F.lit(1), n), ends, longer), 1)["pieces"]


def option_resplit(options, n, explain, letters="", longest=5, per_blank=6):
    """Column of options: glued option words cut into one word for each of ``n`` blanks.

    The usual length of a blank's word is the commonest among the options that have all their words (the shorter of equally
    common ones), else 2. Options with enough words, with other characters or with over ``per_blank`` letters a blank stay.
    """
    n = n.cast("int")
    plain = "^[" + re.escape(letters) + "一-鿿]*$"

    def lengths_of(whole):
        def usual(i):
            lens = F.transform(whole, lambda w: F.length(F.element_at(w, i)))
            votes = _let(lens, lambda ls: F.transform(F.array_distinct(ls), lambda x: F.struct(F.size(F.filter(ls, lambda y: y == x)).alias("n"), (-x).alias("x"))))
            return F.when(F.size(whole) > 0, -F.array_max(votes)["x"]).otherwise(F.lit(2))
        return F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), usual)

    def cut(option, w, lengths, said):
        marks = F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda j: F.length(F.array_join(F.slice(w, 1, j), "")))).otherwise(F.array().cast("array<int>"))
        return _let(F.array_join(w, ""), lambda glued: F.when(
            (F.size(w) < n) & F.length(glued).between(n, per_blank * n) & glued.rlike(plain),
            _let(marks, lambda m: F.coalesce(F.array_join(_pieces(glued, n, m, lengths, said, longest), " "), option))).otherwise(option))

    def resplit(words):
        return _let(lengths_of(F.filter(words, lambda w: F.size(w) == n)), lambda lengths: _let(
            F.coalesce(explain, F.lit("")), lambda said: F.zip_with(options, words, lambda o, w: cut(o, w, lengths, said))))
    words = F.transform(options, lambda o: F.filter(F.split(F.coalesce(o, F.lit("")), r"\s+"), lambda w: w != ""))
    return _let(words, lambda ws: F.when((n < 2) | F.forall(ws, lambda w: F.size(w) == n), options).otherwise(resplit(ws)))
