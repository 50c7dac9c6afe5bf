"""Known facts on hand rows."""
from datetime import date

import pytest
from pyspark.sql import functions as F

from studyloom.functions import fsrs as M
from studyloom.functions import rules as R
from studyloom.functions import text as T
from studyloom.operators import analytics as A
from studyloom.operators import cleaning as C
from studyloom.operators import joins as J
from studyloom.operators import planning as P
from studyloom.operators import segment as G
from studyloom.operators import vacancies as V
from tests.conftest import rows

STEMS = [
    ("资料分析", "资料分析", "2023年该市社会消费品零售总额比2021年增长了约百分之几？", None, "data-gap"),
    ("资料分析", "资料分析", "2024年A省粮食产量占全国的比重比上年约：", None, "data-share"),
    ("资料分析", "资料分析", "能够从上述资料中推出的是：", None, "data-judge"),
    ("数量关系", "数学运算", "甲乙两人同时从A、B两地出发相向而行，速度分别为……几小时后相遇？", None, "math-travel"),
    ("数量关系", "数学运算", "某商品按定价打八折出售，仍可获利20%……", None, "math-profit"),
    ("数量关系", "数字推理", "1, 3, 7, 15, ( )", None, "math-seq"),
    ("判断推理", "逻辑判断", "以下哪项如果为真，最能削弱上述论证？", None, "reason-weaken"),
    ("判断推理", "图形推理", "从所给的四个选项中，选择最合适的一个", None, "reason-fig"),
    ("言语理解与表达", "逻辑填空", "依次填入画横线部分最恰当的一项是：", ["不胫而走", "不翼而飞", "一蹴而就", "按部就班"], "verbal-idiom"),
    ("言语理解与表达", "逻辑填空", "依次填入画横线部分最恰当的一项是：", ["发挥", "发扬", "发展", "发起"], "verbal-word"),
    ("言语理解与表达", "片段阅读", "这段文字意在说明：", None, "verbal-intent"),
    ("言语理解与表达", "语句表达", "将以上6个句子重新排列，语序正确的是：", None, "verbal-order"),
    ("常识判断", "常识判断", "根据《中华人民共和国民法典》，下列说法正确的是", None, "common-law"),
    ("不存在的模块", "", "x", None, ""),
]


def test_topics(spark):
    d = spark.createDataFrame(STEMS, "module string, sub string, stem string, options array<string>, want string")
    t = R.topic_of(F.col("module"), F.col("sub"), F.col("stem"), F.col("options"))
    assert [tuple(r) for r in d.select("want", t.alias("got")).collect() if r[0] != r[1]] == []


def test_score_estimate(spark):
    mods = list(R.SCORE_WEIGHTS)

    def score(answers):
        d = spark.createDataFrame([(1, m, ok) for m, oks in answers.items() for ok in oks], "user_id int, module string, correct int")
        return A.score_estimate(d, R.SCORE_WEIGHTS).first()["score"]
    assert score({m: [1] * 10 for m in mods}) == 100
    assert score({"资料分析": [1] * 10 + [0] * 10}) == 50
    heavy = score({"资料分析": [1] * 10, "常识判断": [0] * 10})
    light = score({"资料分析": [0] * 10, "常识判断": [1] * 10})
    assert heavy > 50 > light


def test_score_of_a_tie_is_the_same_in_every_order(spark):
    """Shares at the end of a half: sums of doubles round them by the order of the modules, exact sums do not."""
    w = {"a": 1.0, "b": 0.8, "c": 0.9, "d": 0.6}
    cases = [([10, 5, 12, 12], [0, 4, 6, 5], 36.2), ([1, 1, 2, 10], [1, 1, 2, 3], 56.3), ([2, 8, 6, 9], [2, 2, 4, 6], 56.3),
             ([7, 2, 4, 1], [0, 1, 0, 0], 6.2), ([3, 11, 2, 4], [1, 6, 0, 4], 51.2), ([6, 2, 2, 11], [4, 0, 0, 9], 58.8)]
    for order in ("abcd", "dcba", "bdac"):
        rows = [(u, m, int(i < oks["abcd".index(m)])) for u, (ns, oks, _) in enumerate(cases) for m in order for i in range(ns["abcd".index(m)])]
        d = spark.createDataFrame(rows, "user_id int, module string, correct int")
        assert {r.user_id: r.score for r in A.score_estimate(d, w).collect()} == {u: s for u, (_, _, s) in enumerate(cases)}


def test_eligibility(spark):
    d = spark.createDataFrame([
        ("a", "本科及以上", "不限", "无限制", "无限制", "不限"), ("b", "仅限硕士研究生", "中共党员", "二年", "大学生村官", "法学类"),
        ("c", "本科或硕士研究生", "中共党员或共青团员", "3年", "", "计算机类、法学类"), ("d", "大专及以下", "共青团员", "五年以上", "不限", "会计")],
        "code string, edu string, politics string, years string, project string, major string")
    prof = {"edu": "本科", "politics": "共青团员", "years": 3, "project": False, "majors": ["法学"]}
    got = {r[0]: r[1] for r in d.select("code", V.blocked_reasons(prof)).collect()}
    assert got == {"a": [], "b": ["学历", "政治面貌", "服务基层项目"], "c": [], "d": ["学历", "基层年限", "专业"]}


def test_keyword_wildcards_are_literal(spark):
    d = spark.createDataFrame([("100%", "x"), ("1000", "x"), ("a_b", "x"), ("aXb", "x")], "t string, region string")
    assert rows(V.keyword_rows(d, "100%", ["t"]), "t") == [("100%",)]
    assert rows(V.keyword_rows(d, "A_B", ["t"]), "t") == [("a_b",)]


def test_ratio_page(spark):
    p = spark.createDataFrame([(1, 3), (2, 2), (3, 1)], "code int, count int")
    a = spark.createDataFrame([(1, 300), (2, 50)], "code int, applicants int")
    rated = V.with_applicants(p, a)
    assert [(r.code, r.ratio) for r in V.page_of(rated, "ratio", 1).collect()] == [(2, 25.0), (1, 100.0), (3, None)]
    assert [r.code for r in V.page_of(rated, "ratio_desc", 1).collect()] == [1, 2, 3]


def test_fsrs(spark):
    one = spark.range(1)
    val = lambda c: one.select(c).first()[0]
    assert val(M.retrievability(F.lit(7), F.lit(7.0))) == pytest.approx(0.9)
    assert val(M.interval(F.lit(7.0))) == 7 and val(M.interval(F.lit(7.0), 0.8)) > 7
    new = val(M.preview(F.lit(0.0), F.lit(0.0), F.lit(0), F.lit(True), F.lit(""), F.lit("2026-10-01")))
    assert (new["again"], new["hard"], new["good"]) == (0, 1, 3) and 14 <= new["easy"] <= 17
    p = val(M.preview(F.lit(10.0), F.lit(6.0), F.lit(10), F.lit(False), F.lit(""), F.lit("2026-10-01")))
    assert 0 == p["again"] < p["hard"] <= p["good"] < p["easy"]
    s, d = 3.173, 5.0
    for _ in range(4):
        grown, _d = val(F.struct(*M.step(F.lit(s), F.lit(d), F.lit(int(s)), F.lit(False), M.GOOD)))
        assert grown > s
        s = grown
    shrunk, harder = val(F.struct(*M.step(F.lit(s), F.lit(d), F.lit(int(s)), F.lit(False), M.AGAIN)))
    assert shrunk < s and harder > d
    assert val(M.legacy_card(F.lit(4), F.lit(1))[0]) == 14.0


def test_text_facts(spark):
    d = spark.createDataFrame([("【得分】14.5 / 20\n总评",), ("【得分】 18/20",), ("没有",), ("【得分】30 / 20",)], "t string")
    assert [tuple(r) for r in d.select(*T.parse_score(F.col("t"))).collect()] == [(14.5, 20.0), (18.0, 20.0), (None, None), (None, None)]
    one = spark.createDataFrame([("嗯，我认为这个问题，然后就是要那个加强监管",)], "t string")
    fill = one.select(T.filler_counts(F.col("t"))).first()[0]
    assert fill["嗯"] == 1 and fill["然后"] == 1 and fill["那个"] == 1
    assert one.select(T.token_estimate(F.lit("一二三"))).first()[0] >= 2
    assert one.select(T.percent_to_fraction(F.lit(33.3)), T.percent_to_fraction(F.lit(12.5))).first()[:] == ("1/3", "1/8")
    assert one.select(T.quantity_parse(F.lit("1.5亿元")), T.quantity_parse(F.lit("20%")), T.quantity_parse(F.lit("x1"))).first()[:] == (1.5e8, 0.2, None)
    assert one.select(T.cn_numeral(F.lit("十二")), T.cn_numeral(F.lit("１５")), T.cn_numeral(F.lit("七"))).first()[:] == (12, 15, 7)
    assert one.select(T.unicode_fix(F.lit("⼀⾔𝟏x"))).first()[0] == "一言1x"
    assert one.select(T.version_newer(F.lit("v1.10.0"), F.lit("1.9.9"))).first()[0]


def test_date_conflicts(spark):
    d = spark.createDataFrame([("a", "2027-03-14"), ("b", "2027-03-20"), ("c", "2027-05-22"), ("d", "2027-05-22")], "exam string, day string")
    d = d.select("exam", F.to_date("day").alias("day"))
    assert rows(J.date_conflict(d, "2026-10-01"), "a", "b", "days") == [("a", "b", 6), ("c", "d", 0)]


def test_one_exam_plan(spark):
    day = lambda s: F.lit(s).cast("date")
    ps = spark.range(1).select(P.phases_one_exam(day("2026-10-11"), day("2027-05-22"))).first()[0]
    assert str(ps[0]["start"]) == "2026-10-11" and str(ps[-2]["end"]) == "2027-05-21" and str(ps[-1]["start"]) == "2027-05-22"
    assert 14 <= (ps[3]["end"] - ps[3]["start"]).days + 1 <= 21
    for a, b in zip(ps, ps[1:]):
        assert (b["start"] - a["end"]).days == 1
    short = spark.range(1).select(P.phases_one_exam(day("2026-10-11"), day("2026-10-20"))).first()[0]
    assert short[-1]["key"] == "after" and str(short[0]["start"]) == "2026-10-11"


def test_ad_blocks_keep_heading(spark):
    b = spark.createDataFrame([(1, 0, "h", "第一章", 0), (1, 1, "p", "微信扫一扫", 0), (1, 2, "p", "立马获取", 0), (1, 3, "p", "扫一扫", 0), (1, 4, "p", "扫一扫", 1)],
                              "doc int, seq int, kind string, text string, page int")
    assert rows(C.ad_blocks(b, "微信扫一扫|立马获取|扫一扫"), "seq") == [(0,), (4,)]


def test_answers_in_prose(spark):
    d = spark.createDataFrame([("故正确答案为B。28.一般……故正确答案为C",), ("B。清明、惊蛰",), ("此题没有",), ("因此，本题选AD项",)], "t string")
    assert [r[0] for r in d.select(G.prose_answer(F.col("t"))).collect()] == ["B", "B", "", "AD"]
    j = spark.createDataFrame([("下列说法错误的是", "A项正确，B项错误，C、D两项正确"), ("下列说法正确的是", "A、B两项错误，D项排除"), ("x", "A项正确，A项错误")], "s string, t string")
    ls = F.array(*[F.lit(x) for x in "ABCD"])
    assert [r[0] for r in j.select(G.judged_answer(F.col("s"), ls, F.col("t"))).collect()] == ["B", "C", ""]


def test_keys_and_questions(spark):
    k = spark.createDataFrame([(1, 5, "答案 1-5:BBDDC 6-7:CC 8-10:AB"), (1, 9, "1.C 2.B")], "doc int, seq int, text string")
    got = rows(G.answer_key_expand(k), "seq", "num", "ans")
    assert got == [(5, i + 1, a) for i, a in enumerate("BBDDCCC")] + [(9, 1, "C"), (9, 2, "B")]
    lines = ["引言", "1. 题干一", "续行", "A. 甲  B. 乙", "C.丙D.丁", "解析文字", "2、题干二", "A. 一", "B. 二"]
    d = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "doc int, seq int, text string")
    q = G.question_segment(d).orderBy("seq").collect()
    assert [(r.num, r.stem, len(r.options)) for r in q] == [(1, "题干一\n续行", 4), (2, "题干二", 2)]
    assert [tuple(o) for o in q[0].options] == [("A", "甲"), ("B", "乙"), ("C", "丙"), ("D", "丁")]


def test_lessons_go_on_in_order(spark):
    day = lambda d: date(2024, 6, d)
    name = P.LESSON
    tasks = spark.createDataFrame([(u, day(d), o, name + m if o == 0 else "其他", m, 40) for u in (1, 2) for d in range(1, 6) for o, m in ((0, "申论"), (1, "申论"), (0, "面试"))],
                                  "user int, day date, ord int, title string, module string, minutes int")
    lessons = spark.createDataFrame([(i, "essay", 10 - i, f"L{i}", 5 + i) for i in range(4)] + [(9, "math", 1, "M", 1)], "lesson int, course string, ord int, title string, minutes int")
    done = spark.createDataFrame([(1, 2), (1, 2), (1, 9), (3, 0)], "user int, lesson int")
    got = P.with_lessons(tasks, lessons, done)
    assert got.count() == tasks.count()
    by = lambda u: [(r.title, r.minutes, r.lesson) for r in got.where((F.col("user") == u) & (F.col("module") == "申论") & (F.col("ord") == 0)).orderBy("day").collect()]
    assert by(1) == [(name + "L3", 8, 3), (name + "L1", 6, 1), (name + "L0", 5, 0)] + [(name + "申论", 40, None)] * 2  # lesson 2 is done
    assert by(2) == [(name + f"L{i}", 5 + i, i) for i in (3, 2, 1, 0)] + [(name + "申论", 40, None)]
    assert got.where("module = '面试' AND title <> '学习教程：面试'").count() == 0
    assert P.with_lessons(tasks, lessons.limit(0), done.limit(0)).where("lesson IS NOT NULL").count() == 0


def test_lessons_meet_tasks_one_by_one(spark):
    """The k-th open lesson by ranks: no task row carries a course's list of lessons."""
    import random
    rng = random.Random(2)
    name, users = P.LESSON, range(12)
    lessons = [(i, "essay" if i % 2 else "math", rng.randrange(1000), f"L{i}", i) for i in range(60)]
    tasks = [(u, date(2024, 6, d + 1), 0, name + m, m, 40) for u in users for d in range(9) for m in (("申论", "数量关系") if d % 2 else ("申论",))]
    done = [(u, i) for u in users for i in rng.sample(range(60), u * 5)]
    got = P.with_lessons(spark.createDataFrame(tasks, "user int, day date, ord int, title string, module string, minutes int"),
                         spark.createDataFrame(lessons, "lesson int, course string, ord int, title string, minutes int"), spark.createDataFrame(done, "user int, lesson int"))
    want = set()
    for u in users:
        for m, c in (("申论", "essay"), ("数量关系", "math")):
            days = [t[1] for t in tasks if t[0] == u and t[4] == m]
            left = [x for x in sorted(lessons, key=lambda x: (x[2], x[0])) if x[1] == c and (u, x[0]) not in done]
            want |= {(u, day, m, left[k][0] if k < len(left) else None) for k, day in enumerate(days)}
    assert {(r.user, r.day, r.module, r.lesson) for r in got.collect()} == want and any(w[3] is None for w in want)
    assert "collect_list(struct" not in got._jdf.queryExecution().executedPlan().toString()


def test_option_resplit_works_out_its_arguments_once(spark):
    """A glued option is cut as before, and the plan names the option's words and the explanation a few times, not once per place."""
    from studyloom.functions import text as T
    d = spark.createDataFrame([(["largering", "bigcog", "old cog"], "item A “large” and “ring” fit")], "o array<string>, e string")
    out = d.select(T.option_resplit(F.col("o"), F.lit(2), F.col("e"), "abcdefghijklmnopqrstuvwxyz").alias("r"))
    assert out.first().r == ["large ring", "big cog", "old cog"]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_unicode_fix_of_every_character_without_python_workers(spark):
    import unicodedata
    odd = "".join(chr(i) for low, high in ((0x2E80, 0x2FFF), (0xF900, 0xFAFF), (0x1D400, 0x1D7FF)) for i in range(low, high + 1))
    texts = spark.createDataFrame([(1, "é ①" + odd + "end"), (2, None), (3, "")], "id int, t string")
    fixed = texts.select("id", T.unicode_fix(F.col("t")).alias("t"))
    want = "é ①" + "".join(unicodedata.normalize("NFKC", c) for c in odd) + "end"
    assert {r.id: r.t for r in fixed.collect()} == {1: want, 2: None, 3: ""}
    assert "Python" not in fixed._jdf.queryExecution().executedPlan().toString()
