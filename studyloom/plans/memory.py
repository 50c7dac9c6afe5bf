"""Queries over the memory model, keyed folds and study plans."""
from pyspark.sql import functions as F

from studyloom.functions import fsrs as M
from studyloom.operators import memory as K
from studyloom.operators import planning as P
from studyloom.plans.registry import query
from studyloom.sources.views import EXAM_TODAY, TODAY

# ---- the model as SQL text, for the oracles


def q_grade(g, t):
    return f"(CASE {g} WHEN 1 THEN {t[1]!r}::DOUBLE WHEN 2 THEN {t[2]!r}::DOUBLE WHEN 3 THEN {t[3]!r}::DOUBLE ELSE {t[4]!r}::DOUBLE END)"


def q_ret(el, s):
    return f"pow(1+{M.FACTOR!r}::DOUBLE*greatest(0,{el})/{s}, -0.5::DOUBLE)"


def q_clamp(x):
    return f"least(10.0::DOUBLE, greatest(1.0::DOUBLE, {x}))"


_w = [f"{x!r}::DOUBLE" for x in M.W]
_d0 = {g: f"least(10.0::DOUBLE,greatest(1.0::DOUBLE,{_w[4]}-exp({_w[5]}*({g}-1))+1))" for g in (1, 2, 3, 4)}


def q_next_d(d, g):
    return q_clamp(f"{_w[7]}*{_d0[4]}+(1-{_w[7]})*({d}-{_w[6]}*({g}-3)*(10-{d})/9)")


def q_next_s(s, d, el, g):
    r = q_ret(el, s)
    forget = f"least({_w[11]}*pow({d},-{_w[12]})*(pow({s}+1,{_w[13]})-1)*exp({_w[14]}*(1-{r})), {s}/exp({_w[17]}*{_w[18]}))"
    bonus = f"(CASE {g} WHEN 2 THEN {_w[15]} WHEN 4 THEN {_w[16]} ELSE 1.0::DOUBLE END)"
    recall = f"{s}*(1+exp({_w[8]})*(11-{d})*pow({s},-{_w[9]})*(exp({_w[10]}*(1-{r}))-1)*{bonus})"
    return f"greatest(0.1::DOUBLE, CASE WHEN {el}<1 THEN {s}*exp({_w[17]}*({g}-3+{_w[18]})) WHEN {g}=1 THEN {forget} ELSE {recall} END)"


def q_s(new, s, d, el, g):
    return f"(CASE WHEN {new} THEN {q_grade(g, M.INIT_S)} ELSE {q_next_s(s, d, el, g)} END)"


def q_d(new, d, g):
    init = f"(CASE {g} WHEN 1 THEN {_d0[1]} WHEN 2 THEN {_d0[2]} WHEN 3 THEN {_d0[3]} ELSE {_d0[4]} END)"
    return f"(CASE WHEN {new} THEN {init} ELSE {q_next_d(d, g)} END)"


def q_interval(s, ret=0.9):
    return f"least(3650, greatest(1, round_even({s}/{M.FACTOR!r}::DOUBLE*({ret ** -2 - 1!r}::DOUBLE),0)::INT))"


def q_fuzz(n, seed):
    h = f"(('0x'||substr(md5({seed}),1,8))::BIGINT/4294967295.0::DOUBLE)"
    dl = f"greatest(1, round_even({n}*0.05::DOUBLE,0)::INT)"
    return f"(CASE WHEN {n}<3 THEN {n} ELSE {n}-{dl}+round_even({h}*2*{dl},0)::INT END)"


def q_days(new, s, d, el, seed, day):
    raw = {g: q_fuzz(q_interval(q_s(new, s, d, el, g)), f"concat({seed},{day},'{g}')") for g in (2, 3, 4)}
    good = f"greatest({raw[3]},{raw[2]})"
    return {2: raw[2], 3: good, 4: f"greatest({raw[4]}, least(3650, {good}+1))"}


_el = f"date_diff('day', last_review, DATE '{TODAY}')"


def _elapsed():
    return F.datediff(F.lit(TODAY).cast("date"), "last_review")




@query("retrievability", f"SELECT user_id, qid, round_even({q_ret(_el, 'stability')},4) AS r FROM v_cards")
def _(v):
    return v.cards.select("user_id", "qid", F.bround(M.retrievability(_elapsed(), F.col("stability")), 4).alias("r"))


@query("init_state", f"SELECT id, grade, round_even({q_s('true', '1', '1', '0', 'grade')},4) AS s, round_even({q_d('true', '1', 'grade')},4) AS d FROM v_reviews")
def _(v):
    g = F.col("grade")
    return v.reviews.select("id", "grade", F.bround(M.init_stability(g), 4).alias("s"), F.bround(M.init_difficulty(g), 4).alias("d"))


_g = "(1+(user_id+qid)%4)"


@query("next_difficulty", f"SELECT user_id, qid, round_even({q_next_d('difficulty', _g)},4) AS d FROM v_cards")
def _(v):
    return v.cards.select("user_id", "qid", F.bround(M.next_difficulty(F.col("difficulty"), 1 + (F.col("user_id") + F.col("qid")) % 4), 4).alias("d"))


@query("stability_update", f"SELECT user_id, qid, round_even({q_next_s('stability', 'difficulty', _el, _g)},4) AS s FROM v_cards")
def _(v):
    return v.cards.select("user_id", "qid", F.bround(M.stability_update(F.col("stability"), F.col("difficulty"), _elapsed(), 1 + (F.col("user_id") + F.col("qid")) % 4), 4).alias("s"))


@query("interval_days", f"SELECT user_id, qid, {q_interval('stability')} AS d90, {q_interval('stability', 0.8)} AS d80 FROM v_cards")
def _(v):
    return v.cards.select("user_id", "qid", M.interval(F.col("stability")).alias("d90"), M.interval(F.col("stability"), 0.8).alias("d80"))


@query("fuzz_days", f"SELECT user_id, qid, {q_fuzz(q_interval('stability'), 'concat(qid,last_review)')} AS days FROM v_cards")
def _(v):
    return v.cards.select("user_id", "qid", M.fuzz(M.interval(F.col("stability")), F.concat(F.col("qid"), F.col("last_review").cast("string"))).alias("days"))


_p = q_days("false", "stability", "difficulty", _el, "qid", f"'{TODAY}'")


@query("preview_days", f"SELECT user_id, qid, 0 AS again, {_p[2]} AS hard, {_p[3]} AS good, {_p[4]} AS easy FROM v_cards")
def _(v):
    p = M.preview(F.col("stability"), F.col("difficulty"), _elapsed(), F.lit(False), F.col("qid"), F.lit(TODAY))
    return v.cards.select("user_id", "qid", p.alias("p")).select("user_id", "qid", "p.*")


@query("legacy_state", """SELECT user_id, qid, greatest(1,[0,1,3,7,14,30][greatest(1,least(CASE WHEN reps%8=0 THEN 1 ELSE reps%8 END,5))+1])::DOUBLE AS card_s,
    round_even(least(10.0,greatest(1.0, 5.0+0.6*lapses-0.3*greatest(0,greatest(1,least(CASE WHEN reps%8=0 THEN 1 ELSE reps%8 END,5))-2)))::DOUBLE,4) AS card_d,
    [1,2,4,7,15,30][least(reps%8,5)+1]::DOUBLE AS wrong_s, round_even(least(10.0,greatest(1.0,5.0+0.5*CASE WHEN lapses=0 THEN 1 ELSE lapses END))::DOUBLE,4) AS wrong_d FROM v_cards""")
def _(v):
    cs, cd = M.legacy_card(F.col("reps") % 8, F.col("lapses"))
    ws, wd = M.legacy_wrong(F.col("reps") % 8, F.col("lapses"))
    return v.cards.select("user_id", "qid", cs.alias("card_s"), F.bround(cd, 4).alias("card_d"), ws.alias("wrong_s"), F.bround(wd, 4).alias("wrong_d"))


_due = "(correct=1 AND wc>0 AND mastered=0 AND nxt<=day)"
_days = q_days("false", "s", "d", "el", "qid", "day")
WRONG_SQL = f"""WITH RECURSIVE a AS (SELECT user_id, qid, day, correct, row_number() OVER (PARTITION BY user_id,qid ORDER BY id) AS rn FROM v_attempts),
    st AS (SELECT DISTINCT user_id, qid, 0::BIGINT AS rn, 0::BIGINT AS wc, 0::BIGINT AS stage, DATE '1970-01-01' AS nxt, 0::BIGINT AS mastered, 0.0::DOUBLE AS s,
        0.0::DOUBLE AS d, DATE '1970-01-01' AS last, 0::BIGINT AS reps FROM a
      UNION ALL SELECT user_id, qid, rn, CASE WHEN correct=0 THEN wc+1 ELSE wc END, CASE WHEN correct=0 THEN 0 WHEN {_due} THEN stage+1 ELSE stage END,
        CASE WHEN correct=0 THEN day+1 WHEN {_due} THEN day+{_days[3]} ELSE nxt END,
        CASE WHEN correct=0 THEN 0 WHEN {_due} THEN CASE WHEN {_days[3]}>=30 THEN 1 ELSE 0 END ELSE mastered END,
        CASE WHEN correct=0 THEN {q_s('wc=0', 's', 'd', 'el', '1')} WHEN {_due} THEN {q_next_s('s', 'd', 'el', '3')} ELSE s END,
        CASE WHEN correct=0 THEN {q_d('wc=0', 'd', '1')} WHEN {_due} THEN {q_next_d('d', '3')} ELSE d END,
        CASE WHEN correct=0 OR {_due} THEN day ELSE last END, CASE WHEN correct=0 OR {_due} THEN reps+1 ELSE reps END
      FROM (SELECT st.*, a.day, a.correct, date_diff('day', st.last, a.day) AS el FROM (SELECT * REPLACE (rn+1 AS rn) FROM st) st JOIN a USING (user_id, qid, rn)) x)
    SELECT user_id, qid, wc AS wrong_count, stage, nxt AS next_review, mastered, round_even(s,4) AS stability, round_even(d,4) AS difficulty,
      last AS last_review, reps FROM st WHERE wc>0 QUALIFY row_number() OVER (PARTITION BY user_id, qid ORDER BY rn DESC)=1"""


@query("wrongbook_fold", WRONG_SQL)
def _(v):
    return K.wrongbook_fold(v.attempts)


_dg = q_days("g0=0", "s", "d", "el", "qid", "day")
_pick = f"(CASE grade WHEN 1 THEN 0 WHEN 2 THEN {_dg[2]} WHEN 3 THEN {_dg[3]} ELSE {_dg[4]} END)"
CARD_SQL = f"""WITH RECURSIVE a AS (SELECT user_id, qid, day, grade, module AS deck, row_number() OVER (PARTITION BY user_id,qid ORDER BY id) AS rn FROM v_reviews),
    st AS (SELECT DISTINCT user_id, qid, 0::BIGINT AS rn, 0::BIGINT AS g0, 0::INT AS days, 0.0::DOUBLE AS s, 0.0::DOUBLE AS d, DATE '1970-01-01' AS last,
        0::BIGINT AS lapses, NULL::VARCHAR AS deck, NULL::DATE AS first FROM a
      UNION ALL SELECT user_id, qid, rn, grade, {_pick}, {q_s('g0=0', 's', 'd', 'el', 'grade')}, {q_d('g0=0', 'd', 'grade')}, day,
        lapses+CASE WHEN grade=1 THEN 1 ELSE 0 END, coalesce(deck, dk), coalesce(first, day)
      FROM (SELECT st.*, a.day, a.grade, a.deck AS dk, date_diff('day', st.last, a.day) AS el FROM (SELECT * REPLACE (rn+1 AS rn) FROM st) st JOIN a USING (user_id, qid, rn)) x)
    SELECT user_id, qid, deck, CASE WHEN g0=1 THEN 1 ELSE least(5, 1+(days>=1)::INT+(days>=3)::INT+(days>=7)::INT+(days>=14)::INT+(days>=30)::INT) END AS box,
      last+days AS due, rn AS reps, lapses, round_even(s,4) AS stability, round_even(d,4) AS difficulty, last AS last_review, first AS first_review
    FROM st WHERE rn>0 QUALIFY row_number() OVER (PARTITION BY user_id, qid ORDER BY rn DESC)=1"""


@query("card_fold", CARD_SQL)
def _(v):
    return K.card_fold(v.reviews.withColumn("deck", F.col("module")))


@query("session_build", """SELECT session_id, count(*) AS total, sum(correct)::BIGINT AS correct, sum(seconds)::BIGINT AS duration,
    round_even(sum(seconds)/60.0::DOUBLE,0)::BIGINT AS minutes, CASE WHEN count(DISTINCT module)=1 THEN min(module) ELSE 'mixed' END AS module FROM v_attempts GROUP BY session_id""")
def _(v):
    return K.session_build(v.attempts)


@query("progress_upsert", """SELECT user_id, doc, coalesce(arg_max(seq,id) FILTER (seq IS NOT NULL),0) AS seq, coalesce(arg_max(pct,id) FILTER (pct IS NOT NULL),0) AS pct,
    coalesce(arg_max(done,id) FILTER (done IS NOT NULL),0) AS done, coalesce(arg_max(fav,id) FILTER (fav IS NOT NULL),0) AS fav, max(id) AS updated FROM v_docprog GROUP BY user_id, doc""")
def _(v):
    return K.progress_upsert(v.docprog, ["user_id", "doc"])


# ---- plans: every customer has a start date, two exam dates and daily hours

def plans_of(v):
    k = F.col("c_custkey")
    base = F.lit("2024-01-01").cast("date")
    first = F.date_add(base, (150 + k % 90).cast("int"))
    d = v.table("customer").select(k.alias("user"), F.date_add(base, (k * 7 % 330).cast("int")).alias("start"), first.alias("first"),
                                   F.date_add(first, (5 + k * 13 % 160).cast("int")).alias("second"), (1 + k % 12).cast("double").alias("hours"))
    return d.withColumn("phases", P.phases(F.col("start"), F.col("first"), F.col("second")))


PLAN_DAY = "2024-06-20"


def q_split(start, end, shares, when, tag):
    """Rows of one split as SQL: nested subqueries carry the cursor."""
    out, cur = [], f"({start})"
    total = f"(({end})-({start})+1)"
    for i, (k, r) in enumerate(shares):
        stop = f"({end})" if i == len(shares) - 1 else f"least({end}, {cur}+greatest(1, round_even({total}*{r}::DOUBLE,0)::INT)-1)"
        out.append(f"SELECT u AS user, '{k}' AS key, {cur} AS start, {stop} AS \"end\" FROM c WHERE ({when}) AND {total}>0 AND {cur}<=({end})")
        cur = f"({stop}+1)"
    return out


_again = "greatest(st, f+1)"
PLAN_SQL = ("""WITH c AS (SELECT *, f+(5+u*13%160)::INT AS s FROM (SELECT c_custkey AS u, DATE '2024-01-01'+(c_custkey*7%330)::INT AS st,
    DATE '2024-01-01'+(150+c_custkey%90)::INT AS f, (1+c_custkey%12)::DOUBLE AS hours FROM customer)), ph AS (""" + " UNION ALL ".join(
    q_split("st", "f-1", P.FIRST_PHASES, "st<f", 1)
    + q_split(_again, "s-1", (("final", 1),), f"{_again}<s AND st<f AND s-{_again}<21", 2)
    + q_split(_again, "s-1", P.SECOND_PHASES, f"{_again}<s AND st<f AND s-{_again}>=21", 3)
    + q_split(_again, "s-1", P.FIRST_PHASES, f"{_again}<s AND st>=f", 4)
    + ["SELECT u, 'interview', s+1, s+60 FROM c"]) + ") ")


@query("phase_split", PLAN_SQL + f"""SELECT user, key, start, "end", ("end"-start+1)::INT AS days, CASE WHEN "end"<'{PLAN_DAY}' THEN 'done' WHEN start<='{PLAN_DAY}' THEN 'now' ELSE 'next' END AS status FROM ph""")
def _(v):
    return P.phase_rows(plans_of(v), PLAN_DAY)


@query("phase_split_one_exam", """WITH c AS (SELECT c_custkey AS u, DATE '2024-01-01'+(c_custkey%200)::INT AS st, DATE '2024-01-01'+(180+c_custkey%50)::INT AS e FROM customer),
    t AS (SELECT *, (e-st)::INT AS total, least(21,greatest(14,round_even((e-st)*0.1::DOUBLE,0)::INT)) AS sp FROM c),
    x AS (SELECT u, st, e, total, sp, e-1-sp AS e1, total-sp AS t1 FROM t),
    l AS (SELECT *, st+greatest(1,round_even(t1*0.45::DOUBLE,0)::INT)-1 AS b1, greatest(1,round_even(t1*0.28::DOUBLE,0)::INT) AS n2, st+greatest(1,round_even(total*0.5::DOUBLE,0)::INT)-1 AS h1 FROM x)
    SELECT u AS user, 'base' AS key, st AS start, least(e1,b1) AS "end" FROM l WHERE total>=28
    UNION ALL SELECT u, 'real', b1+1, least(e1,b1+n2) FROM l WHERE total>=28 AND b1+1<=e1
    UNION ALL SELECT u, 'case', b1+n2+1, e1 FROM l WHERE total>=28 AND b1+n2+1<=e1
    UNION ALL SELECT u, 'sprint', e-sp, e-1 FROM l WHERE total>=28
    UNION ALL SELECT u, 'real', st, least(e-1,h1) FROM l WHERE total>0 AND total<28 UNION ALL SELECT u, 'sprint', h1+1, e-1 FROM l WHERE total>0 AND total<28 AND h1+1<=e-1
    UNION ALL SELECT u, 'after', e, e+60 FROM l""")
def _(v):
    k, base = F.col("c_custkey"), F.lit("2024-01-01").cast("date")
    p = P.phases_one_exam(F.date_add(base, (k % 200).cast("int")), F.date_add(base, (180 + k % 50).cast("int")))
    return P.phase_rows(v.table("customer").select(k.alias("user"), p.alias("phases")), PLAN_DAY).select("user", "key", "start", "end")


@query("phase_now", PLAN_SQL + f""", o AS (SELECT *, CASE WHEN start<='{PLAN_DAY}' AND "end">='{PLAN_DAY}' THEN 0 WHEN start>'{PLAN_DAY}' THEN 1 ELSE 2 END AS c FROM ph)
    SELECT user, key, (greatest(0, DATE '{PLAN_DAY}'-start)+1)::INT AS day_index, greatest(0, "end"-DATE '{PLAN_DAY}')::INT AS days_left FROM o
    QUALIFY row_number() OVER (PARTITION BY user ORDER BY c, CASE WHEN c=2 THEN -date_diff('day', DATE '1970-01-01', start) ELSE date_diff('day', DATE '1970-01-01', start) END)=1""")
def _(v):
    return P.phase_now(plans_of(v), PLAN_DAY)


@query("milestones", PLAN_SQL + ", m AS (" + " UNION ALL ".join(
    f"SELECT u AS user, {'f' if w == 'first' else 's'}+({o}) AS date, '{t}' AS title FROM c" for w, o, t in P.MILESTONES)
    + f") SELECT user, date, title, (date-DATE '{PLAN_DAY}')::INT AS days_left, (title LIKE '%笔试')::INT AS exam_day FROM m")
def _(v):
    return P.milestones(plans_of(v), PLAN_DAY)


def _tasks_sql():
    vals = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in P.task_rows())
    return PLAN_SQL + f""", tpl(phase, weekday, ord, title, module, base, minutes) AS (VALUES {vals}),
    d AS (SELECT u, hours, DATE '{PLAN_DAY}'+i::INT AS day FROM c, range(7) t(i)),
    k AS (SELECT d.*, coalesce(ph.key,'base') AS phase FROM d LEFT JOIN ph ON ph.user=d.u AND d.day BETWEEN ph.start AND ph."end"),
    v AS (SELECT u AS user, day, k.phase, ord, replace(title,'{{i}}',CASE WHEN hours/4<1.5 THEN '2' ELSE '3' END) AS title, module, minutes, CASE WHEN base IS NOT NULL THEN greatest(5, round_even(base*greatest(0.5::DOUBLE,least(2.5::DOUBLE,hours/4))/5,0)::INT*5) END AS volume
      FROM k JOIN tpl ON tpl.phase=k.phase AND weekday=(isodow(day)-1))
    SELECT user, day, phase, ord, replace(title,'{{n}}',coalesce(volume::VARCHAR,'')) AS title, module, volume, minutes FROM v"""


@query("task_expand", _tasks_sql())
def _(v):
    return P.task_expand(v.spark, plans_of(v), PLAN_DAY)


_COURSES = sorted(set(P.COURSES.values()))


def _lessons_sql():
    head, select = _tasks_sql().rsplit("\n    SELECT ", 1)
    title, module, minutes = P.FIRST_DAY
    of = " ".join(f"WHEN '{m}' THEN '{c}'" for m, c in P.COURSES.items())
    return head + f""", tk AS (SELECT {select} UNION ALL SELECT u, st, NULL, -1, '{title}', '{module}', NULL, {minutes} FROM c WHERE st BETWEEN DATE '{PLAN_DAY}' AND DATE '{PLAN_DAY}'+6),
    lt AS (SELECT *, row_number() OVER (PARTITION BY user, course ORDER BY day, ord) AS k FROM (SELECT *, CASE WHEN title='{P.LESSON}'||module THEN CASE module {of} END END AS course FROM tk) WHERE course IS NOT NULL),
    ls AS (SELECT p_partkey AS lesson, ['{"','".join(_COURSES)}'][(p_partkey%{len(_COURSES)}+1)::INT] AS course, p_name AS name, p_size AS takes FROM part),
    dn AS (SELECT DISTINCT o_custkey AS user, l_partkey AS lesson FROM orders JOIN lineitem ON l_orderkey=o_orderkey),
    lf AS (SELECT uc.user, ls.*, row_number() OVER (PARTITION BY uc.user, ls.course ORDER BY ls.lesson) AS k FROM (SELECT DISTINCT user, course FROM lt) uc JOIN ls ON ls.course=uc.course LEFT JOIN dn ON dn.user=uc.user AND dn.lesson=ls.lesson WHERE dn.lesson IS NULL)
    SELECT tk.user, tk.day, tk.ord::INT AS ord, coalesce('{P.LESSON}'||lf.name, tk.title) AS title, tk.module, coalesce(lf.takes, tk.minutes)::INT AS minutes, lf.lesson
    FROM tk LEFT JOIN lt ON lt.user=tk.user AND lt.day=tk.day AND lt.ord=tk.ord LEFT JOIN lf ON lf.user=lt.user AND lf.course=lt.course AND lf.k=lt.k"""


@query("task_lessons", _lessons_sql())
def _(v):
    plans = plans_of(v)
    tasks = P.task_expand(v.spark, plans, PLAN_DAY).select("user", "day", "ord", "title", "module", "minutes").unionByName(P.first_day_task(plans, PLAN_DAY))
    k = F.col("p_partkey")
    course = F.element_at(F.array(*[F.lit(c) for c in _COURSES]), (k % len(_COURSES) + 1).cast("int"))
    lessons = v.table("part").select(k.alias("lesson"), course.alias("course"), k.alias("ord"), F.col("p_name").alias("title"), F.col("p_size").cast("int").alias("minutes"))
    done = v.table("orders").join(v.table("lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("lesson"))
    return P.with_lessons(tasks, lessons, done).select("user", "day", "ord", "title", "module", "minutes", "lesson")


@query("replan", f"""WITH t AS (SELECT o_custkey AS user, o_orderdate::DATE AS day, o_orderpriority AS title, CASE WHEN o_orderkey%2=0 THEN 'plan' ELSE 'own' END AS source,
    (o_orderkey%3)::BIGINT AS done FROM orders) SELECT * FROM t WHERE NOT (day=DATE '{EXAM_TODAY}' AND source='plan' AND done=0)
    UNION ALL SELECT c_custkey, DATE '{EXAM_TODAY}', c_mktsegment, 'plan', 0 FROM customer""")
def _(v):
    k = F.col("o_orderkey")
    tasks = v.table("orders").select(F.col("o_custkey").alias("user"), F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("title"),
                                     F.when(k % 2 == 0, "plan").otherwise("own").alias("source"), (k % 3).alias("done"))
    fresh = v.table("customer").select(F.col("c_custkey").alias("user"), F.lit(EXAM_TODAY).cast("date").alias("day"), F.col("c_mktsegment").alias("title"),
                                       F.lit("plan").alias("source"), F.lit(0).cast("bigint").alias("done"))
    return P.replan(tasks, fresh, EXAM_TODAY)
