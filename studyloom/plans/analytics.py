"""Queries over the learning log."""
from pyspark.sql import functions as F

from studyloom.operators import analytics as A
from studyloom.plans.registry import query
from studyloom.sources.views import EXAM_TODAY, TODAY

WEIGHTS = {"click": 1.0, "view": 0.8, "purchase": 0.9, "signup": 0.6}
WEIGHT_SQL = "CASE module WHEN 'click' THEN 1.0::DOUBLE WHEN 'view' THEN 0.8::DOUBLE WHEN 'purchase' THEN 0.9::DOUBLE WHEN 'signup' THEN 0.6::DOUBLE ELSE 0.8::DOUBLE END"
SUB_TARGETS = {f"Brand#{i}": 6 + i for i in range(1, 9)}
MODULE_TARGETS = {"ECONOMY": 9, "SMALL": 12, "PROMO": 20}


def topics_of(v):
    return v.bank.select("topic").distinct()


@query("module_stats", """SELECT module, count(*) AS total, sum(correct)::BIGINT AS correct,
    round_even(sum(correct)/count(*)::DOUBLE*100, 1) AS accuracy, round_even(avg(seconds),0)::BIGINT AS avg_seconds
    FROM v_attempts GROUP BY module""")
def _(v):
    return A.module_stats(v.attempts)


TOPIC_SQL = """WITH a AS (SELECT t.*, b.topic FROM v_attempts t JOIN v_bank b ON b.id=t.qid AND b.answer IS NOT NULL WHERE mode<>'doc_example'),
    r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY id DESC) AS rn FROM a),
    st AS (SELECT topic, count(*) AS n, sum(correct)::BIGINT AS correct, round_even(sum(correct)/count(*)::DOUBLE*100,0)::BIGINT AS acc,
      round_even(sum(CASE WHEN rn<=20 THEN correct END)/count(CASE WHEN rn<=20 THEN 1 END)::DOUBLE*100,0)::BIGINT AS recent_acc,
      round_even(avg(CASE WHEN seconds>0 THEN seconds END),0)::BIGINT AS avg_sec FROM r GROUP BY topic),
    tp AS (SELECT topic, count(answer) AS available FROM v_bank GROUP BY topic),
    stats AS (SELECT tp.topic, coalesce(n,0) AS n, coalesce(correct,0) AS correct, acc, recent_acc, avg_sec, available
      FROM tp LEFT JOIN st USING (topic)) """


@query("topic_stats", TOPIC_SQL + "SELECT * FROM stats")
def _(v):
    return A.topic_stats(v.attempts, v.bank, topics_of(v))


@query("recent_n_accuracy", TOPIC_SQL + """SELECT topic, count(*) AS recent_n, round_even(sum(correct)/count(*)::DOUBLE*100,0)::BIGINT AS recent_acc
    FROM r WHERE rn<=20 GROUP BY topic""")
def _(v):
    return A.recent_accuracy(v.attempts, v.bank.where("answer IS NOT NULL"))


@query("weak_topics", TOPIC_SQL + """SELECT * FROM stats WHERE n>=5 AND coalesce(recent_acc,0)<70 AND available>0
    ORDER BY recent_acc, n DESC, topic LIMIT 8""")
def _(v):
    return A.weak_topics(A.topic_stats(v.attempts, v.bank, topics_of(v)))


def _case(col, d):
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {x}" for k, x in d.items()) + " END"


@query("pace_by_subtype", f"""WITH a AS (SELECT coalesce(b.module,t.module,'') AS module, coalesce(b.sub,'') AS sub, t.seconds, t.correct
      FROM v_attempts t LEFT JOIN v_bank b ON b.id=t.qid WHERE mode<>'doc_example' AND seconds>0),
    g AS (SELECT *, coalesce({_case('sub', SUB_TARGETS)},{_case('module', MODULE_TARGETS)},60)::BIGINT AS target FROM a)
    SELECT module, CASE WHEN sub='' THEN module ELSE sub END AS sub, count(*) AS n, round_even(avg(correct)*100,0)::BIGINT AS acc,
      round_even(avg(seconds),0)::BIGINT AS avg_sec, target,
      round_even(count(CASE WHEN seconds>target*1.5 THEN 1 END)/count(*)::DOUBLE*100,0)::BIGINT AS over_pct,
      count(CASE WHEN seconds>target*1.5 AND correct=1 THEN 1 END) AS slow_right,
      count(CASE WHEN seconds<=target*1.5 AND seconds<target*0.4 AND correct=0 THEN 1 END) AS fast_wrong
    FROM g GROUP BY module, sub, target""")
def _(v):
    return A.pace_by_subtype(v.attempts, v.bank, SUB_TARGETS, MODULE_TARGETS)


#: 60 * weight * right / seconds in hundredths, half to even, out of whole numbers
_NUM, _DEN = f"(6000*CAST(round(1000*{WEIGHT_SQL}) AS BIGINT)*sum(correct)::BIGINT)", "(1000*sum(seconds)::BIGINT)"
PER_MIN_SQL = f"({_NUM}//{_DEN} + CASE WHEN 2*({_NUM}%{_DEN})>{_DEN} OR (2*({_NUM}%{_DEN})={_DEN} AND ({_NUM}//{_DEN})%2=1) THEN 1 ELSE 0 END)/100"


@query("module_order", f"""SELECT module, count(*) AS n, round_even(avg(correct)*100,0)::BIGINT AS acc,
    round_even(avg(seconds),0)::BIGINT AS avg_sec,
    {PER_MIN_SQL} AS per_min
    FROM v_attempts WHERE mode<>'doc_example' AND seconds>0 AND module IN ('click','view','purchase','signup')
    GROUP BY module HAVING count(*)>=10""")
def _(v):
    return A.module_order(v.attempts, WEIGHTS)


@query("score_estimate", f"""SELECT user_id, round_even(sum(w*ok)/sum(w*n)*100,1) AS score FROM (
    SELECT user_id, {WEIGHT_SQL} AS w, sum(correct) AS ok, count(*) AS n FROM v_attempts GROUP BY user_id, module) GROUP BY user_id""")
def _(v):
    return A.score_estimate(v.attempts, WEIGHTS)


@query("score_points", "SELECT user_id, round_even(sum(correct)/count(*)::DOUBLE*75,1) AS score FROM v_attempts GROUP BY user_id")
def _(v):
    return A.score_points(v.attempts)


HISTORY_SQL = f"""WITH top AS (SELECT * FROM v_sessions QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY started DESC, session_id DESC) <= 60),
    per AS (SELECT session_id, module, {WEIGHT_SQL} AS w, count(*) AS n, sum(correct)::BIGINT AS ok FROM v_attempts GROUP BY session_id, module),
    hist AS (SELECT top.user_id, top.session_id, total, correct, duration, round_even(sum(w*ok)/sum(w*n)*100,1) AS score,
      string_agg(concat(module,':',ok,'/',n), ',' ORDER BY concat(module,':',ok,'/',n)) AS modules
      FROM top JOIN per USING (session_id) GROUP BY ALL) """


@query("session_history", HISTORY_SQL + "SELECT * FROM hist")
def _(v):
    return A.session_history(v.sessions, v.attempts, WEIGHTS).drop("started")


@query("score_trend", HISTORY_SQL + "SELECT user_id, session_id, score, round_even(score-70,1) AS gap FROM hist")
def _(v):
    return A.score_trend(A.session_history(v.sessions, v.attempts, WEIGHTS), 70)


# The same answers for each user alone.
USER = ("user_id",)
USER_TOPIC_SQL = """WITH a AS (SELECT t.*, b.topic FROM v_attempts t JOIN v_bank b ON b.id=t.qid AND b.answer IS NOT NULL WHERE mode<>'doc_example'),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id, topic ORDER BY id DESC) AS rn FROM a),
    stats AS (SELECT user_id, topic, count(*) AS n, sum(correct)::BIGINT AS correct, round_even(sum(correct)/count(*)::DOUBLE*100,0)::BIGINT AS acc,
      round_even(sum(CASE WHEN rn<=20 THEN correct END)/count(CASE WHEN rn<=20 THEN 1 END)::DOUBLE*100,0)::BIGINT AS recent_acc,
      round_even(avg(CASE WHEN seconds>0 THEN seconds END),0)::BIGINT AS avg_sec, any_value(available) AS available
      FROM r JOIN (SELECT topic, count(answer) AS available FROM v_bank GROUP BY topic) USING (topic) GROUP BY user_id, topic) """


@query("topic_stats_by_user", USER_TOPIC_SQL + "SELECT * FROM stats")
def _(v):
    return A.topic_stats(v.attempts, v.bank, topics_of(v), by=USER)


@query("recent_accuracy_by_user", USER_TOPIC_SQL + """SELECT user_id, topic, count(*) AS recent_n, round_even(sum(correct)/count(*)::DOUBLE*100,0)::BIGINT AS recent_acc
    FROM r WHERE rn<=20 GROUP BY user_id, topic""")
def _(v):
    return A.recent_accuracy(v.attempts, v.bank.where("answer IS NOT NULL"), by=USER)


@query("weak_topics_by_user", USER_TOPIC_SQL + """SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY recent_acc, n DESC, topic)::INT AS rank FROM stats
    WHERE n>=5 AND coalesce(recent_acc,0)<70 AND available>0 QUALIFY rank<=8""")
def _(v):
    return A.weak_topics(A.topic_stats(v.attempts, v.bank, topics_of(v), by=USER), by=USER)


@query("pace_by_user", f"""WITH a AS (SELECT t.user_id, coalesce(b.module,t.module,'') AS module, coalesce(b.sub,'') AS sub, t.seconds, t.correct
      FROM v_attempts t LEFT JOIN v_bank b ON b.id=t.qid WHERE mode<>'doc_example' AND seconds>0),
    g AS (SELECT *, coalesce({_case('sub', SUB_TARGETS)},{_case('module', MODULE_TARGETS)},60)::BIGINT AS target FROM a)
    SELECT user_id, module, CASE WHEN sub='' THEN module ELSE sub END AS sub, count(*) AS n, round_even(avg(correct)*100,0)::BIGINT AS acc,
      round_even(avg(seconds),0)::BIGINT AS avg_sec, target,
      round_even(count(CASE WHEN seconds>target*1.5 THEN 1 END)/count(*)::DOUBLE*100,0)::BIGINT AS over_pct,
      count(CASE WHEN seconds>target*1.5 AND correct=1 THEN 1 END) AS slow_right,
      count(CASE WHEN seconds<=target*1.5 AND seconds<target*0.4 AND correct=0 THEN 1 END) AS fast_wrong
    FROM g GROUP BY user_id, module, sub, target""")
def _(v):
    return A.pace_by_subtype(v.attempts, v.bank, SUB_TARGETS, MODULE_TARGETS, by=USER)


@query("module_order_by_user", f"""SELECT user_id, module, count(*) AS n, round_even(avg(correct)*100,0)::BIGINT AS acc,
    round_even(avg(seconds),0)::BIGINT AS avg_sec,
    {PER_MIN_SQL} AS per_min
    FROM v_attempts WHERE mode<>'doc_example' AND seconds>0 AND module IN ('click','view','purchase','signup')
    GROUP BY user_id, module HAVING count(*)>=3""")
def _(v):
    return A.module_order(v.attempts, WEIGHTS, floor=3, by=USER)


@query("daily_activity_by_user", """SELECT user_id, day, sum(q)::BIGINT AS questions, sum(c)::BIGINT AS correct, sum(m)::BIGINT AS minutes FROM (
    SELECT user_id, day, 1 AS q, correct AS c, 0 AS m FROM v_attempts WHERE day >= DATE '1996-01-01'
    UNION ALL SELECT user_id, day, 0, 0, minutes FROM v_study WHERE day >= DATE '1996-01-01') GROUP BY user_id, day""")
def _(v):
    return A.daily_activity(v.attempts, v.study, "1996-01-01", by=USER)


@query("heatmap_by_user", f"""SELECT user_id, day, sum(minutes)::BIGINT AS minutes, CASE WHEN sum(minutes)>=120 THEN 4 WHEN sum(minutes)>=60 THEN 3
    WHEN sum(minutes)>=30 THEN 2 WHEN sum(minutes)>=1 THEN 1 ELSE 0 END AS level FROM v_study
    WHERE day BETWEEN DATE '{EXAM_TODAY}'-182 AND DATE '{EXAM_TODAY}' GROUP BY user_id, day""")
def _(v):
    return A.heatmap(v.study, EXAM_TODAY, by=USER)


DAILY_SQL = """WITH act AS (SELECT coalesce(a.day,s.day) AS day, coalesce(questions,0) AS questions, coalesce(correct,0) AS correct,
    coalesce(minutes,0) AS minutes FROM (SELECT day, count(*) AS questions, sum(correct)::BIGINT AS correct FROM v_attempts GROUP BY day) a
    FULL JOIN (SELECT day, sum(minutes)::BIGINT AS minutes FROM v_study WHERE day >= DATE '1996-01-01' GROUP BY day) s ON a.day=s.day) """


@query("daily_activity", DAILY_SQL + "SELECT * FROM act")
def _(v):
    return A.daily_activity(v.attempts, v.study, "1996-01-01")


@query("dense_calendar", DAILY_SQL + """, cal AS (SELECT DATE '2024-02-05' - i::INT AS day FROM range(30) t(i))
    SELECT day, coalesce(questions,0) AS questions, coalesce(correct,0) AS correct, coalesce(minutes,0) AS minutes FROM cal LEFT JOIN act USING (day)""")
def _(v):
    return A.dense_calendar(v.spark, A.daily_activity(v.attempts, v.study, "1996-01-01"), "2024-02-05", 30)


@query("heatmap", f"""SELECT day, sum(minutes)::BIGINT AS minutes, CASE WHEN sum(minutes)>=120 THEN 4 WHEN sum(minutes)>=60 THEN 3
    WHEN sum(minutes)>=30 THEN 2 WHEN sum(minutes)>=1 THEN 1 ELSE 0 END AS level FROM v_study
    WHERE day BETWEEN DATE '{EXAM_TODAY}'-182 AND DATE '{EXAM_TODAY}' GROUP BY day""")
def _(v):
    return A.heatmap(v.study, EXAM_TODAY)


@query("minutes_by_module", "SELECT module, sum(minutes)::BIGINT AS minutes FROM v_study GROUP BY module")
def _(v):
    return A.minutes_by_module(v.study)


@query("dashboard_totals", f"""SELECT * FROM (SELECT count(*) AS questions_total, round_even(avg(correct)*100,1) AS accuracy_total,
      count(CASE WHEN day='{TODAY}' THEN 1 END) AS questions_today, count(CASE WHEN day='{TODAY}' AND correct=1 THEN 1 END) AS correct_today FROM v_attempts),
    (SELECT sum(minutes)::BIGINT AS minutes_total, sum(CASE WHEN day='{TODAY}' THEN minutes ELSE 0 END)::BIGINT AS minutes_today FROM v_study),
    (SELECT count(*) AS due_wrong FROM v_wrong WHERE mastered=0 AND next_review<='{TODAY}'),
    (SELECT count(*) AS due_cards FROM v_cards WHERE due<='{TODAY}')""")
def _(v):
    return A.dashboard_totals(v.attempts, v.study, v.wrong, v.cards, TODAY)


@query("review_budget", f"""WITH c AS (SELECT (SELECT count(*) FROM v_cards WHERE due<='{TODAY}') AS due,
      (SELECT count(*) FROM v_cards WHERE last_review='{TODAY}' AND first_review<'{TODAY}') AS cards_reviewed,
      (SELECT count(*) FROM v_cards WHERE first_review='{TODAY}') AS new_today,
      (SELECT count(*) FROM v_wrong WHERE mastered=0 AND next_review<='{TODAY}') AS wrong),
    d AS (SELECT *, greatest(0, least(due, 300-cards_reviewed)) AS cards, greatest(0, 30-new_today) AS new_left FROM c)
    SELECT wrong, cards, cards_reviewed, new_left, new_today,
      round_even(wrong*1.5::DOUBLE+cards*0.2::DOUBLE+least(new_left,20)*0.4::DOUBLE,0)::BIGINT AS minutes FROM d""")
def _(v):
    return A.review_budget(v.cards, v.wrong, TODAY)


@query("overview_by_exam", f"""WITH a AS (SELECT mode AS exam, count(*) AS questions, sum(correct) AS ok FROM v_attempts GROUP BY 1),
    s AS (SELECT ['practice','exam','other'][id%3+1] AS exam, sum(minutes)::BIGINT AS minutes, max(day) AS last_day,
      sum(CASE WHEN day='{EXAM_TODAY}' THEN minutes ELSE 0 END)::BIGINT AS minutes_today FROM v_study GROUP BY 1),
    w AS (SELECT ['practice','exam','doc_example'][qid%3+1] AS exam, count(*) AS due_wrong FROM v_wrong
      WHERE mastered=0 AND next_review<='{EXAM_TODAY}' GROUP BY 1)
    SELECT exam, coalesce(questions,0) AS questions, coalesce(round_even(ok/questions::DOUBLE*100,1),0) AS accuracy,
      coalesce(minutes,0) AS minutes, coalesce(minutes_today,0) AS minutes_today, last_day, coalesce(due_wrong,0) AS due_wrong
    FROM a FULL JOIN s USING (exam) FULL JOIN w USING (exam)""")
def _(v):
    pick = lambda c, xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col(c) % 3 + 1).cast("int"))
    return A.overview_by_exam(v.attempts.withColumn("exam", F.col("mode")),
                              v.study.withColumn("exam", pick("id", ["practice", "exam", "other"])),
                              v.wrong.withColumn("exam", pick("qid", ["practice", "exam", "doc_example"])), EXAM_TODAY)


DONE_SQL = "WITH done AS (SELECT DISTINCT qid FROM v_attempts) "


@query("bank_summary", DONE_SQL + """, per AS (SELECT module, sub, count(*) AS k, count(qid) AS d FROM v_bank LEFT JOIN done ON qid=id GROUP BY 1,2)
    SELECT module, sum(k)::BIGINT AS total, sum(d)::BIGINT AS done, string_agg(concat(sub,':',k), ',' ORDER BY concat(sub,':',k)) AS subs
    FROM per GROUP BY module""")
def _(v):
    return A.bank_summary(v.bank, v.attempts)


@query("bank_matching", DONE_SQL + """SELECT count(*) AS matching, count(qid) AS matching_done FROM v_bank LEFT JOIN done ON qid=id
    WHERE answer IS NOT NULL AND src='real'""")
def _(v):
    return A.bank_matching(v.bank.where("answer IS NOT NULL AND src = 'real'"), v.attempts)


@query("bank_counts", """SELECT src, sum(n)::BIGINT AS n FROM (SELECT src, count(*) AS n FROM v_bank GROUP BY 1
    UNION ALL SELECT unnest(['real','builtin','import','book']), 0) GROUP BY 1""")
def _(v):
    return A.bank_counts(v.spark, v.bank, ["real", "builtin", "import", "book"])


@query("attempt_progress", "SELECT qid, count(*) AS n, sum(correct)::BIGINT AS ok, max(day) AS last FROM v_attempts GROUP BY qid")
def _(v):
    return A.attempt_progress(v.attempts)


@query("latest_by_key", "SELECT qid, arg_max(correct,id) AS correct, arg_max(day,id) AS day FROM v_attempts GROUP BY qid")
def _(v):
    return A.latest_by_key(v.attempts, ["qid"], ["id"], ["correct", "day"])


@query("source_progress", """SELECT source, count(*) AS done, sum(c)::BIGINT AS correct FROM
    (SELECT qid, arg_max(correct,id) AS c FROM v_attempts GROUP BY qid) JOIN v_bank ON id=qid GROUP BY source""")
def _(v):
    return A.source_progress(v.attempts, v.bank)


@query("reason_share", """SELECT reason, count(*) AS n, round_even(count(*)/(sum(count(*)) OVER ())::DOUBLE*100,1) AS share
    FROM v_wrong WHERE reason IS NOT NULL GROUP BY reason""")
def _(v):
    return A.reason_share(v.wrong)


@query("kind_totals", """SELECT substr(kind,4) AS kind, sum(total)::BIGINT AS n, sum(correct)::BIGINT AS ok, sum(seconds)::BIGINT AS sec
    FROM v_speed WHERE starts_with(kind,'rk-') GROUP BY 1""")
def _(v):
    return A.kind_totals(v.speed, "rk-")


@query("usage_month", """WITH p AS (SELECT kind, count(*) AS calls, sum(input_tokens)::BIGINT AS i, sum(output_tokens)::BIGINT AS o,
      sum(estimated)::BIGINT AS estimated FROM v_usage WHERE day>=DATE '2024-02-01' GROUP BY kind),
    t AS (SELECT sum(i)::BIGINT AS ti, sum(o)::BIGINT AS tt FROM p)
    SELECT kind, calls, estimated, i+o AS tokens, ti AS month_input, tt AS month_output,
      round_even(ti/1e6*15+tt/1e6*60,2) AS cost, CASE WHEN ti+tt>=20000 THEN 1 ELSE 0 END AS over_limit FROM p, t""")
def _(v):
    return A.usage_month(v.usage, "2024-02", 15.0, 60.0, 20000)


@query("record_fold", """SELECT substr(set_id,6) AS item, count(*) AS n, max(id) AS last,
    arg_max(self_score,id) FILTER (self_score IS NOT NULL) AS self, arg_max(ai_score,id) FILTER (ai_score IS NOT NULL) AS ai
    FROM v_essays GROUP BY set_id""")
def _(v):
    return A.record_fold(v.essays, "case:")


@query("source_rollup", """WITH p AS (SELECT source, module, count(*) AS k, count(answer) AS a, max(year) AS y FROM v_bank GROUP BY 1,2)
    SELECT source, sum(k)::BIGINT AS count, sum(a)::BIGINT AS answered, max(y) AS year,
    string_agg(concat(module,':',k), ',' ORDER BY concat(module,':',k)) AS modules FROM p GROUP BY source""")
def _(v):
    return A.source_rollup(v.bank)


DIGEST_SQL = """SELECT doc, count(*) AS blocks, count(CASE WHEN kind='h' THEN 1 END) AS headings, count(CASE WHEN kind='p' THEN 1 END) AS paragraphs,
    sum(length(text))::BIGINT AS chars, substr(sha1(string_agg(concat(kind,'|',level,'|',text), chr(10) ORDER BY seq)),1,16) AS sha FROM {} GROUP BY doc"""


@query("corpus_digest", DIGEST_SQL.format("v_blocks"))
def _(v):
    return A.corpus_digest(v.blocks)


@query("digest_diff", f"""WITH o AS ({DIGEST_SQL.format("v_blocks")}), nb AS (SELECT * FROM v_blocks WHERE length(text)%13<>0),
    n AS ({DIGEST_SQL.format("nb")}), j AS (SELECT coalesce(o.doc,n.doc) AS doc, concat_ws(',',
      CASE WHEN o.blocks IS DISTINCT FROM n.blocks THEN 'blocks' END, CASE WHEN o.headings IS DISTINCT FROM n.headings THEN 'headings' END,
      CASE WHEN o.chars IS DISTINCT FROM n.chars THEN 'chars' END, CASE WHEN o.sha IS DISTINCT FROM n.sha THEN 'sha' END) AS changed
      FROM o FULL JOIN n ON o.doc=n.doc) SELECT * FROM j WHERE changed<>''""")
def _(v):
    return A.digest_diff(A.corpus_digest(v.blocks), A.corpus_digest(v.blocks.where(F.length("text") % 13 != 0)),
                         ["blocks", "headings", "chars", "sha"])


@query("library_overview", """SELECT CASE WHEN rel LIKE 'http%' THEN 'web' ELSE split_part(rel,'/',1) END AS cat, count(*) AS n,
    count(CASE WHEN e='pdf' THEN 1 END) AS pdf, count(CASE WHEN e='docx' THEN 1 END) AS docx, count(CASE WHEN e='md' THEN 1 END) AS md
    FROM (SELECT rel, regexp_extract(rel, '[.]([a-z]+)$', 1) AS e FROM v_files) GROUP BY 1""")
def _(v):
    f = v.files.select(F.when(F.col("rel").startswith("http"), "web").otherwise(F.substring_index("rel", "/", 1)).alias("cat"),
                       F.regexp_extract("rel", "[.]([a-z]+)$", 1).alias("ext"))
    return A.pivot_counts(f, "cat", "ext", ["pdf", "docx", "md"])


@query("storage_usage", """SELECT CASE WHEN grouping(part)=1 THEN '(all)' ELSE part END AS part, sum(size)::BIGINT AS bytes,
    sum(CASE WHEN stale THEN size ELSE 0 END)::BIGINT AS stale_bytes, count(CASE WHEN stale THEN 1 END) AS stale_files
    FROM (SELECT CASE WHEN rel LIKE 'http%' THEN 'web' ELSE split_part(rel,'/',1) END AS part, size, rel LIKE '%.tmp' AS stale FROM v_files)
    GROUP BY ROLLUP(part)""")
def _(v):
    part = F.when(F.col("rel").startswith("http"), "web").otherwise(F.substring_index("rel", "/", 1))
    return A.storage_usage(v.files, part, r"(\.bak\.db|\.tmp)$")


@query("speed_best", """SELECT kind, rounds, correct, total, seconds FROM (SELECT kind, correct, total, seconds, count(*) OVER (PARTITION BY kind) AS rounds,
    row_number() OVER (PARTITION BY kind ORDER BY correct/total::DOUBLE DESC, seconds, total) AS rn FROM v_speed) WHERE rn=1""")
def _(v):
    return A.speed_best(v.speed)


@query("deck_state", f"""WITH d AS (SELECT id AS card, module AS deck FROM v_bank),
    s AS (SELECT qid AS card, max(due) AS due, max(CASE WHEN qid%3<>0 THEN stability END) AS stability, qid%6 AS box FROM v_cards GROUP BY qid)
    SELECT deck, count(*) AS cards, count(CASE WHEN due IS NULL THEN 1 END) AS fresh, count(CASE WHEN due<='{TODAY}' THEN 1 END) AS due,
      count(CASE WHEN due IS NOT NULL AND (CASE WHEN coalesce(stability,0)>0 THEN stability>=21 ELSE box>=4 END) THEN 1 END) AS learned
    FROM d LEFT JOIN s USING (card) GROUP BY deck""")
def _(v):
    states = (v.cards.groupBy(F.col("qid").alias("card"))
              .agg(F.max("due").alias("due"), F.max(F.when(F.col("qid") % 3 != 0, F.col("stability"))).alias("stability"))
              .withColumn("box", F.col("card") % 6))
    return A.deck_state(v.bank.select(F.col("id").alias("card"), F.col("module").alias("deck")), states, TODAY)


_T = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark",
      "labels", "conversations"]


@query("table_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _T))
def _(v):
    return A.table_counts({t: v.table(t) for t in _T})


@query("weakest_module", """SELECT module, count(*) AS total, round_even(avg(correct)*100,1) AS accuracy FROM v_attempts
    GROUP BY module HAVING count(*)>=5 ORDER BY accuracy, module LIMIT 1""")
def _(v):
    return A.weakest_module(v.attempts)


@query("streak", """WITH r AS (SELECT user_id, day - (row_number() OVER (PARTITION BY user_id ORDER BY day))::INT AS isl, day FROM v_checkins
      WHERE day<=DATE '2024-01-20'), g AS (SELECT user_id, isl, max(day) AS e, count(*) AS len FROM r GROUP BY 1,2)
    SELECT user_id, coalesce(max(CASE WHEN e>=DATE '2024-01-19' THEN len END),0) AS streak FROM g GROUP BY user_id""")
def _(v):
    return A.streak(v.checkins, "2024-01-20")


def _answers(v):
    return v.attempts.withColumn("chosen", F.when(F.col("id") % 6 != 0, F.col("id") % 4))


ANS_SQL = "WITH ans AS (SELECT *, CASE WHEN id%6<>0 THEN id%4 END AS chosen FROM v_attempts) "
for _mode, _cond in (("exam", "true"), ("practice", "chosen IS NOT NULL")):
    query("quiz_report_" + _mode, ANS_SQL + f"""SELECT module, count(*) AS n, sum(CASE WHEN chosen IS NOT NULL THEN correct ELSE 0 END)::BIGINT AS ok,
        floor(sum(CASE WHEN chosen IS NOT NULL THEN correct ELSE 0 END)/count(*)::DOUBLE*100+0.5)::BIGINT AS acc, sum(seconds)::BIGINT AS sec
        FROM ans WHERE {_cond} GROUP BY module""")(lambda v, m=_mode: A.quiz_report(_answers(v), m))
query("quiz_wrong_list", ANS_SQL + "SELECT id, qid, chosen FROM ans WHERE chosen IS NULL OR correct=0")(
    lambda v: A.quiz_wrong(_answers(v), "exam").select("id", "qid", "chosen"))


@query("course_progress", DONE_SQL + """SELECT CASE WHEN grouping(module)=1 THEN '(all)' ELSE module END AS course, count(qid) AS done, count(*) AS total,
    floor(count(qid)/count(*)::DOUBLE*100+0.5)::BIGINT AS pct, sum(num)::BIGINT AS minutes
    FROM v_bank LEFT JOIN done ON qid=id GROUP BY ROLLUP(module)""")
def _(v):
    return A.course_progress(v.bank.select(F.col("module").alias("course"), F.col("id").alias("lesson"), F.col("num").alias("minutes")),
                             v.attempts.select(F.col("qid").alias("lesson")))


@query("period_counts", """SELECT year(s.day)::INT AS year, month(s.day)::INT AS month, count(*) AS n, count(a.qid) AS done FROM v_study s
    LEFT JOIN (SELECT DISTINCT qid FROM v_attempts) a ON a.qid=s.id GROUP BY 1,2""")
def _(v):
    return A.period_counts(v.study, v.attempts.select(F.col("qid").alias("id")))


@query("period_listing", """SELECT id, year(day)::INT AS year, month(day)::INT AS month, CASE WHEN day(day)<=10 THEN 0 WHEN day(day)<=20 THEN 1 ELSE 2 END AS half,
    (id%4)::BIGINT AS src, CASE WHEN minutes>60 THEN 1 ELSE 0 END AS kind, module AS title FROM v_study""")
def _(v):
    d = F.dayofmonth("day")
    items = v.study.select("id", F.year("day").alias("year"), F.month("day").alias("month"),
                           F.when(d <= 10, 0).when(d <= 20, 1).otherwise(2).alias("half"), (F.col("id") % 4).alias("src"),
                           F.when(F.col("minutes") > 60, 1).otherwise(0).alias("kind"), F.col("module").alias("title"))
    return A.period_items(items, F.col("half"), F.col("src"), F.col("kind"))


@query("dense_calendar_by_user", """WITH act AS (SELECT user_id, day, sum(q)::BIGINT AS questions, sum(c)::BIGINT AS correct, sum(m)::BIGINT AS minutes FROM (
    SELECT user_id, day, 1 AS q, correct AS c, 0 AS m FROM v_attempts UNION ALL SELECT user_id, day, 0, 0, minutes FROM v_study) GROUP BY user_id, day),
    cal AS (SELECT user_id, DATE '2024-02-05' - i::INT AS day FROM (SELECT DISTINCT user_id FROM act), range(30) t(i))
    SELECT user_id, day, coalesce(questions,0) AS questions, coalesce(correct,0) AS correct, coalesce(minutes,0) AS minutes FROM cal LEFT JOIN act USING (user_id, day)""")
def _(v):
    return A.dense_calendar(v.spark, A.daily_activity(v.attempts, v.study, "1900-01-01", by=USER), "2024-02-05", 30, by=USER)


@query("dashboard_totals_by_user", f"""WITH u AS (SELECT user_id, count(*) AS questions_total, sum(correct)::BIGINT AS ok, count(CASE WHEN day='{TODAY}' THEN 1 END) AS questions_today,
      count(CASE WHEN day='{TODAY}' AND correct=1 THEN 1 END) AS correct_today, 0 AS minutes_total, 0 AS minutes_today, 0 AS due_wrong, 0 AS due_cards FROM v_attempts GROUP BY 1
    UNION ALL SELECT user_id, 0,0,0,0, sum(minutes)::BIGINT, sum(CASE WHEN day='{TODAY}' THEN minutes ELSE 0 END)::BIGINT, 0, 0 FROM v_study GROUP BY 1
    UNION ALL SELECT user_id, 0,0,0,0,0,0, count(*), 0 FROM v_wrong WHERE mastered=0 AND next_review<='{TODAY}' GROUP BY 1
    UNION ALL SELECT user_id, 0,0,0,0,0,0,0, count(*) FROM v_cards WHERE due<='{TODAY}' GROUP BY 1),
    t AS (SELECT user_id, {', '.join(f'sum({c})::BIGINT AS {c}' for c in ('questions_total', 'ok', 'questions_today', 'correct_today', 'minutes_total', 'minutes_today', 'due_wrong', 'due_cards'))} FROM u GROUP BY 1)
    SELECT * EXCLUDE (ok), CASE WHEN questions_total>0 THEN round_even(ok/questions_total::DOUBLE*100,1) ELSE 0.0::DOUBLE END AS accuracy_total FROM t""")
def _(v):
    return A.dashboard_totals(v.attempts, v.study, v.wrong, v.cards, TODAY, by=USER)


@query("review_budget_by_user", f"""WITH u AS (SELECT user_id, count(CASE WHEN due<='{TODAY}' THEN 1 END) AS due, count(CASE WHEN last_review='{TODAY}' AND first_review<'{TODAY}' THEN 1 END) AS cards_reviewed,
      count(CASE WHEN first_review='{TODAY}' THEN 1 END) AS new_today, 0 AS wrong FROM v_cards GROUP BY 1
    UNION ALL SELECT user_id, 0, 0, 0, count(CASE WHEN mastered=0 AND next_review<='{TODAY}' THEN 1 END) FROM v_wrong GROUP BY 1),
    t AS (SELECT user_id, sum(due)::BIGINT AS due, sum(cards_reviewed)::BIGINT AS cards_reviewed, sum(new_today)::BIGINT AS new_today, sum(wrong)::BIGINT AS wrong FROM u GROUP BY 1),
    d AS (SELECT *, greatest(0, least(due, 300-cards_reviewed)) AS cards, greatest(0, 30-new_today) AS new_left FROM t)
    SELECT user_id, wrong, cards, cards_reviewed, new_left, new_today, round_even(wrong*1.5::DOUBLE+cards*0.2::DOUBLE+least(new_left,20)*0.4::DOUBLE,0)::BIGINT AS minutes FROM d""")
def _(v):
    return A.review_budget(v.cards, v.wrong, TODAY, by=USER)


@query("bank_summary_by_user", """SELECT user_id, module, total, count(DISTINCT qid) AS done FROM (SELECT user_id, qid FROM v_attempts) a JOIN v_bank b ON b.id=a.qid
    JOIN (SELECT module, count(*) AS total FROM v_bank GROUP BY 1) t USING (module) GROUP BY ALL""")
def _(v):
    return A.bank_summary_by_user(v.bank, v.attempts)
