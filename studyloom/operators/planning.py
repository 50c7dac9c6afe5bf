"""Study plans: phases by exam dates, the phase of a day, milestones, tasks of a day."""
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from studyloom.session import materialize

# Phase shares before the first exam, between the exams, and weekday rotation (Monday first).
FIRST_PHASES = (("base", 0.35), ("special", 0.4), ("sprint", 0.25))
SECOND_PHASES = (("review", 0.3), ("boost", 0.45), ("final", 0.25))
ROTATION = ["言语理解与表达", "数量关系", "判断推理", "资料分析", "政治理论+常识判断", "申论", "复盘"]
PRACTICE = ["言语理解与表达", "数量关系", "判断推理", "资料分析", "常识判断", "申论", "复盘"]
MILESTONES = [("first", -45, "国考公告、报名"), ("first", 0, "国考笔试"), ("first", 40, "国考成绩公布"), ("first", 80, "国考面试"),
              ("second", -55, "省考公告、报名"), ("second", 0, "省考笔试"), ("second", 50, "省考面试")]

# Daily tasks (phases, weekdays 0-6, title, module, base volume or None, minutes).
# {m} = the weekday's practice module, {r} = its rotation entry, {n} = scaled volume, {k} = second module, {i} = interview questions.
TASKS = [
    ("base review", "01234", "学习教程：{r}", "{r}", None, 40),
    ("base review", "4", "政治理论练习 {n} 题", "政治理论", 10, 15),
    ("base review", "01234", "{m} 专项练习 {n} 题", "{m}", 15, 30),
    ("base review", "01234", "资料分析速算 10 分钟", "资料分析", None, 10),
    ("base review", "01234", "阅读积累：读 1 篇评论文章，摘抄 3 句", "阅读积累", None, 25),
    ("base review", "5", "学习教程：申论", "申论", None, 40),
    ("base review", "5", "申论练习：完成 1 道归纳概括题", "申论", None, 40),
    ("base review", "5", "阅读积累：读 1 篇评论文章，摘抄 3 句", "阅读积累", None, 30),
    ("base review", "6", "复习到期错题，写下错因", "错题", None, 30),
    ("base review", "6", "学习教程：行测做题顺序与时间分配", "综合", None, 15),
    ("base review", "6", "迷你模考 1 套（限时）", "综合", None, 40),
    ("base review", "6", "写本周小结并打卡", "综合", None, 10),
    ("base review", "0123456", "闪卡复习 {n} 张（常识 / 政治 / 成语）", "积累", 20, 15),
    ("special boost", "4", "政治理论专项 {n} 题", "政治理论", 20, 25),
    ("special boost", "01234", "{m} 专项练习 {n} 题", "{m}", 30, 45),
    ("special boost", "01234", "{k} 巩固练习 {n} 题", "{k}", 10, 20),
    ("special boost", "01234", "资料分析速算 10 分钟", "资料分析", None, 10),
    ("special boost", "5", "申论练习：综合分析或提出对策 1 题", "申论", None, 45),
    ("special boost", "5", "申论练习：贯彻执行（公文）1 题", "申论", None, 45),
    ("special boost", "5", "大作文：列 1 个提纲（标题 + 分论点）", "申论", None, 30),
    ("special boost", "6", "迷你模考 1 套（限时）", "综合", None, 40),
    ("special boost", "6", "本周错题全部重做", "错题", None, 40),
    ("special boost", "6", "写本周小结并打卡", "综合", None, 10),
    ("special boost", "0123456", "复习到期错题", "错题", None, 20),
    ("special boost", "0123456", "闪卡复习 {n} 张", "积累", 20, 15),
    ("special boost", "0123456", "阅读积累：读 1 篇评论文章", "阅读积累", None, 20),
    ("sprint final", "5", "申论限时套题：大作文完整成稿（60 分钟）", "申论", None, 70),
    ("sprint final", "5", "对照参考要点自评，补充素材", "申论", None, 20),
    ("sprint final", "6", "限时模考 1 套并复盘", "综合", None, 60),
    ("sprint final", "6", "错题本全部过一遍", "错题", None, 40),
    ("sprint final", "6", "写本周小结并打卡", "综合", None, 10),
    ("sprint final", "024", "迷你模考 1 套（严格计时）", "综合", None, 45),
    ("sprint final", "024", "模考复盘：每道错题写错因", "错题", None, 30),
    ("sprint final", "024", "{m} 查漏练习 {n} 题", "{m}", 15, 20),
    ("sprint final", "13", "{m} 限时专项 {n} 题", "{m}", 20, 30),
    ("sprint final", "13", "申论：1 道小题限时作答", "申论", None, 40),
    ("sprint final", "0123456", "政治理论 / 时政闪卡", "政治理论", None, 15),
    ("sprint final", "0123456", "资料分析速算 10 分钟", "资料分析", None, 10),
    ("interview", "0123456", "学习教程：面试", "面试", None, 40),
    ("interview", "0123456", "面试真题限时作答 {i} 道（每题 3 分钟）", "面试", None, 40),
    ("interview", "0123456", "读 1 篇评论文章，提炼观点用于综合分析题", "阅读积累", None, 25),
    ("interview", "0123456", "把今天的作答录音回听并改进", "面试", None, 20),
]


# The course of a module, the words in front of a lesson, the task of the very first day and its minutes.
COURSES = {"政治理论": "politics", "常识判断": "common", "政治理论+常识判断": "politics", "言语理解与表达": "verbal", "数量关系": "math", "判断推理": "reason",
           "资料分析": "data", "申论": "essay", "面试": "interview", "复盘": "strategy"}
LESSON = "学习教程："
FIRST_DAY = ("备考第一天：学教程《公考全景》，了解考什么、怎么学", "综合", 15)


def task_rows(tasks=TASKS):
    """The template as (phase, weekday, ord, title, module, base, minutes) rows."""
    out = []
    for i, (phases, days, title, module, base, minutes) in enumerate(tasks):
        for ph in phases.split():
            for d in days:
                w = int(d)
                second = "资料分析" if PRACTICE[w] != "资料分析" else "判断推理"
                fill = lambda s: s.replace("{m}", PRACTICE[w]).replace("{r}", ROTATION[w]).replace("{k}", second)
                out.append((ph, w, i, fill(title), fill(module), base, minutes))
    return out


def split_range(start, end, shares):
    """[start, end] cut by shares: every part at least one day, the last takes the rest. Array of (key, start, end)."""
    total = F.datediff(end, start) + 1
    parts, cursor = [], start
    for i, (key, share) in enumerate(shares):
        n = F.greatest(F.lit(1), F.bround(total * share).cast("int"))
        stop = end if i == len(shares) - 1 else F.least(end, F.date_add(cursor, n - 1))
        parts.append(F.when((total > 0) & (cursor <= end), F.struct(F.lit(key).alias("key"), cursor.alias("start"), stop.alias("end"))))
        cursor = F.date_add(stop, 1)
    return F.array_compact(F.array(*parts))


def phases(start, first, second):
    """All phases around two exams and the interview after the second."""
    before = F.when(start < first, split_range(start, F.date_sub(first, 1), FIRST_PHASES))
    again = F.greatest(start, F.date_add(first, 1))
    last = F.date_sub(second, 1)
    close = (start < first) & (F.datediff(second, again) < 21)
    between = F.when(again < second, F.when(close, split_range(again, last, (("final", 1.0),)))
                     .when(start < first, split_range(again, last, SECOND_PHASES)).otherwise(split_range(again, last, FIRST_PHASES)))
    talk = F.array(F.struct(F.lit("interview").alias("key"), F.date_add(second, 1).alias("start"), F.date_add(second, 60).alias("end")))
    none = F.array().cast("array<struct<key:string,start:date,end:date>>")
    return F.concat(F.coalesce(before, none), F.coalesce(between, none), talk)


def phases_one_exam(start, exam):
    """Phases before a single exam: the sprint is the last 14 to 21 days, the rest is cut by shares; short plans halve."""
    last = F.date_sub(exam, 1)
    total = F.datediff(last, start) + 1
    sprint = F.least(F.lit(21), F.greatest(F.lit(14), F.bround(total * 0.1).cast("int")))
    tail = F.array(F.struct(F.lit("sprint").alias("key"), F.date_sub(last, sprint - 1).alias("start"), last.alias("end")))
    long = F.concat(split_range(start, F.date_sub(last, sprint), (("base", 0.45), ("real", 0.28), ("case", 0.27))), tail)
    after = F.array(F.struct(F.lit("after").alias("key"), exam.alias("start"), F.date_add(exam, 60).alias("end")))
    none = F.array().cast("array<struct<key:string,start:date,end:date>>")
    return F.concat(F.when(total >= 28, long).when(total > 0, split_range(start, last, (("real", 0.5), ("sprint", 0.5)))).otherwise(none), after)


def phase_rows(plans, today):
    """``plans(user, phases)`` exploded, with length and status on ``today``."""
    day = F.lit(today).cast("date")
    p = plans.select("user", F.explode("phases").alias("p"))
    return p.select("user", "p.key", "p.start", "p.end", (F.datediff("p.end", "p.start") + 1).alias("days"),
                    F.when(F.col("p.end") < day, "done").when(F.col("p.start") <= day, "now").otherwise("next").alias("status"))


def phase_now(plans, today):
    """The running phase of every plan, else the next one, else the last, with day index and days left."""
    day = F.lit(today).cast("date")
    now = F.filter("phases", lambda p: (p["start"] <= day) & (p["end"] >= day))
    nxt = F.filter("phases", lambda p: p["start"] > day)
    p = F.coalesce(F.get(now, 0), F.get(nxt, 0), F.element_at("phases", -1))
    d = plans.select("user", p.alias("p"))
    return d.select("user", "p.key", (F.greatest(F.lit(0), F.datediff(day, F.col("p.start"))) + 1).alias("day_index"),
                    F.greatest(F.lit(0), F.datediff(F.col("p.end"), day)).alias("days_left"))


def milestones(plans, today):
    """``plans(user, first, second)`` -> dated events and the days left to them."""
    rows = F.explode(F.array(*[F.struct(F.date_add(F.col(which), off).alias("date"), F.lit(title).alias("title")) for which, off, title in MILESTONES]))
    d = plans.select("user", rows.alias("m"))
    return d.select("user", "m.date", "m.title", F.datediff(F.col("m.date"), F.lit(today).cast("date")).alias("days_left"),
                    F.col("m.title").endswith("笔试").cast("int").alias("exam_day"))


def task_expand(spark, plans, first_day, days=7):
    """Tasks of the next ``days`` days. ``plans(user, hours, phases)``; volumes scale with the daily hours.

    The template has a fixed number of rows, so it is broadcast; the phase of a day is found inside the plan's own array.
    """
    tpl = spark.createDataFrame(task_rows(), "phase string, weekday int, ord int, title string, module string, base int, minutes int")
    d = plans.select("user", "hours", "phases", F.explode(F.sequence(F.lit(first_day).cast("date"), F.date_add(F.lit(first_day).cast("date"), days - 1))).alias("day"))
    key = F.coalesce(F.get(F.filter("phases", lambda p: (p["start"] <= F.col("day")) & (p["end"] >= F.col("day"))), 0)["key"], F.lit("base"))
    factor = F.greatest(F.lit(0.5), F.least(F.lit(2.5), F.coalesce("hours", F.lit(4.0)) / 4))
    volume = F.when(F.col("base").isNotNull(), F.greatest(F.lit(5), F.bround(F.col("base") * factor / 5).cast("int") * 5))
    d = d.select("user", "day", "hours", key.alias("phase"), F.weekday("day").alias("weekday"))
    title = F.replace("title", F.lit("{n}"), F.coalesce(volume.cast("string"), F.lit("")))
    title = F.replace(title, F.lit("{i}"), F.when(factor < 1.5, "2").otherwise("3"))
    return (d.join(F.broadcast(tpl), ["phase", "weekday"])
            .select("user", "day", "phase", "ord", title.alias("title"), "module", volume.alias("volume"), "minutes"))


def first_day_task(plans, first_day, days=7):
    """The task of the day on which a plan starts, before all others of that day, where it falls in the days asked for. ``plans(user, start)``."""
    title, module, minutes = FIRST_DAY
    d = plans.where(F.col("start").between(F.lit(first_day).cast("date"), F.date_add(F.lit(first_day).cast("date"), days - 1)))
    return d.select("user", F.col("start").alias("day"), F.lit(-1).alias("ord"), F.lit(title).alias("title"), F.lit(module).alias("module"), F.lit(minutes).alias("minutes"))


def with_lessons(tasks, lessons, done):
    """Lesson tasks name a lesson: the k-th task of a user's course takes the course's k-th lesson that the user has not done.

    ``tasks(user, day, ord, title, module, minutes, ..)``; ``lessons(lesson, course, ord, title, minutes)``; ``done(user, lesson)``. Once the lessons are
    used up, a task names its module as before. Only the ranks of a user's own done lessons meet that user's tasks: the k-th open lesson has
    the rank k plus the number of done ones before it. A course is ranked as far as any task can reach.
    """
    course = F.when(F.col("title") == F.concat(F.lit(LESSON), F.col("module")), F.try_element_at(F.create_map(*[F.lit(x) for kv in COURSES.items() for x in kv]), F.col("module")))
    t = tasks.withColumn("course", course)
    k = F.row_number().over(W.partitionBy("user", "course").orderBy("day", "ord"))
    t2 = materialize(t.where("course IS NOT NULL").withColumn("_k", k))
    had = materialize(done.distinct().join(lessons.select("lesson", "course"), "lesson").join(t2.select("user", "course").distinct(), ["user", "course"], "left_semi"))
    many = had.groupBy("user", "course").agg(F.count("*").alias("_n"))
    reach = t2.groupBy("user", "course").agg(F.max("_k").alias("_k")).join(many, ["user", "course"], "left").agg(F.max(F.col("_k") + F.coalesce("_n", F.lit(0)))).first()[0] or 0
    rank = F.row_number().over(W.partitionBy("course").orderBy("ord", "lesson"))
    listed = materialize(lessons.withColumn("_r", rank).where(F.col("_r") <= reach)
                         .select("course", "lesson", F.col("title").alias("name"), F.col("minutes").alias("takes"), "_r"))
    had = had.join(listed.select("lesson", "course", "_r"), ["lesson", "course"]).groupBy("user", "course").agg(F.array_sort(F.collect_set("_r")).alias("_had"))
    skipped = F.when(F.col("_had").isNull(), 0).otherwise(F.size(F.filter("_had", lambda r, i: r - i <= F.col("_k"))))
    t2 = t2.join(had, ["user", "course"], "left").withColumn("_r", F.col("_k") + skipped).join(listed, ["course", "_r"], "left")
    named = (t2.withColumn("title", F.coalesce(F.concat(F.lit(LESSON), "name"), "title")).withColumn("minutes", F.coalesce("takes", "minutes"))
             .select(*tasks.columns, "lesson"))
    return t.where("course IS NULL").drop("course").withColumn("lesson", F.lit(None).cast(lessons.schema["lesson"].dataType)).unionByName(named)


def replan(tasks, fresh, today):
    """Drop today's open planned tasks and put the newly made ones in their place."""
    stale = (F.col("day") == F.lit(today).cast("date")) & (F.col("source") == "plan") & (F.col("done") == 0)
    return tasks.where(~stale).unionByName(fresh)
