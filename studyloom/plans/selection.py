"""Queries that filter, classify, rank and pick."""
from pyspark.sql import functions as F

from studyloom.functions import rules as R
from studyloom.functions.text import CJK  # noqa: F401
from studyloom.operators import classify as C
from studyloom.operators import overlay as O
from studyloom.operators import selection as S
from studyloom.operators import vacancies as V
from studyloom.plans.registry import query
from studyloom.sources.views import TODAY

KNOWN = "WITH k AS (SELECT * FROM v_bank WHERE answer IS NOT NULL) "
DONE = ", done AS (SELECT qid AS id, max(created_at) AS last FROM v_attempts GROUP BY qid) "


def done_of(v):
    return v.attempts.groupBy(F.col("qid").alias("id")).agg(F.max("created_at").alias("last"))


@query("bank_filter", KNOWN + "SELECT id FROM k WHERE src='real' AND module='ECONOMY' AND (year=0 OR year>(SELECT max(year) FROM k)-20)")
def _(v):
    return S.bank_filter(v.bank, src="real", years=20, module="ECONOMY").select("id")


PROFILE = {"edu": "本科", "politics": "共青团员", "years": 3, "project": False, "majors": ["法学", "经济"]}
ELIG_SQL = """WITH e AS (SELECT code, concat_ws(',',
    CASE WHEN NOT (CASE WHEN edu='' OR edu LIKE '%不限%' THEN true WHEN edu LIKE '%仅限%' THEN edu LIKE '%本科%'
      WHEN edu LIKE '%以上%' THEN 2>=CASE WHEN edu LIKE '%大专%' OR edu LIKE '%专科%' THEN 1 WHEN edu LIKE '%本科%' THEN 2 ELSE 3 END
      WHEN edu LIKE '%以下%' THEN 2<=CASE WHEN edu LIKE '%博士%' THEN 4 WHEN edu LIKE '%硕士%' OR edu LIKE '%研究生%' THEN 3 WHEN edu LIKE '%本科%' THEN 2 ELSE 1 END
      ELSE edu LIKE '%本科%' END) THEN '学历' END,
    CASE WHEN politics LIKE '%党员%' AND politics NOT LIKE '%团员%' THEN '政治面貌' END,
    CASE WHEN CASE years WHEN '二年' THEN 2 WHEN '五年以上' THEN 5 WHEN '3年' THEN 3 WHEN '两年以上' THEN 2 WHEN '要求10年经历' THEN 10 ELSE 0 END > 3 THEN '基层年限' END,
    CASE WHEN project LIKE '%村官%' THEN '服务基层项目' END,
    CASE WHEN major LIKE '%计算机%' THEN '专业' END) AS blocked FROM v_positions) """


@query("eligibility", ELIG_SQL + "SELECT * FROM e")
def _(v):
    return v.positions.select("code", F.array_join(V.blocked_reasons(PROFILE), ",").alias("blocked"))


@query("edu_ok", """SELECT code, CASE edu WHEN '本科及以上' THEN 1 WHEN '仅限硕士研究生' THEN 1 WHEN '本科或硕士研究生' THEN 1 WHEN '大专及以上' THEN 1
    WHEN '不限' THEN 1 WHEN '硕士研究生及以下' THEN 1 END AS master_ok, CASE edu WHEN '仅限硕士研究生' THEN 0 WHEN '本科或硕士研究生' THEN 0
    WHEN '硕士研究生及以下' THEN 1 WHEN '本科及以上' THEN 0 ELSE 1 END AS college_ok FROM v_positions""")
def _(v):
    return v.positions.select("code", V.edu_ok(F.col("edu"), "硕士").cast("int").alias("master_ok"),
                              V.edu_ok(F.col("edu"), "大专").cast("int").alias("college_ok"))


@query("years_required", """SELECT code, CASE WHEN code%4=0 THEN code%30 WHEN code%4=1 THEN code%6+1 ELSE 0 END::BIGINT AS years FROM v_positions""")
def _(v):
    k = F.col("code")
    digits = F.concat(F.lit("工作"), (k % 30).cast("string"), F.lit(" 年以上"))
    cn = F.concat(F.element_at(F.array(*[F.lit(x) for x in "一二三四五六"]), (k % 6 + 1).cast("int")), F.lit("年"))
    text = F.when(k % 4 == 0, digits).when(k % 4 == 1, cn).when(k % 4 == 2, F.concat(F.lit("无限制"), k.cast("string"), F.lit("年"))).otherwise(F.col("title"))
    return v.positions.select("code", V.years_required(text).alias("years"))


@query("keyword_search_rows", """SELECT code FROM v_positions WHERE (dept ILIKE '%brand#1%' OR unit ILIKE '%brand#1%' OR title ILIKE '%brand#1%' OR region ILIKE '%brand#1%')
    AND (dept ILIKE '%GEAR%' OR unit ILIKE '%GEAR%' OR title ILIKE '%GEAR%' OR region ILIKE '%GEAR%') AND region ILIKE '%R3%'""")
def _(v):
    return V.keyword_rows(v.positions, "brand#1 GEAR", ["dept", "unit", "title", "region"], region="R3").select("code")


@query("due_filter", f"SELECT user_id, qid, next_review FROM v_wrong WHERE mastered=0 AND next_review<='{TODAY}'")
def _(v):
    return v.wrong.where((F.col("mastered") == 0) & (F.col("next_review") <= F.lit(TODAY).cast("date"))).select("user_id", "qid", "next_review")


@query("due_cards", f"SELECT user_id, qid, due FROM v_cards WHERE due<='{TODAY}'")
def _(v):
    return v.cards.where(F.col("due") <= F.lit(TODAY).cast("date")).select("user_id", "qid", "due")


LATIN_TOPICS = [("eco-ring", "ECONOMY", None, "ring"), ("eco-red", "ECONOMY", None, "^red"), ("eco-rest", "ECONOMY", None, ""),
                ("small-b1", "SMALL", "Brand#1", ""), ("small-gear", "SMALL", None, "gear|bolt"), ("promo-hot", "PROMO", None, "hot|cold")]


@query("first_match_class", """SELECT id, CASE WHEN module='ECONOMY' THEN CASE WHEN regexp_matches(stem,'ring') THEN 'eco-ring' WHEN starts_with(stem,'red') THEN 'eco-red' ELSE 'eco-rest' END
    WHEN module='SMALL' AND sub='Brand#1' THEN 'small-b1' WHEN module='SMALL' AND regexp_matches(stem,'gear|bolt') THEN 'small-gear'
    WHEN module='PROMO' AND regexp_matches(stem,'hot|cold') THEN 'promo-hot' ELSE '' END AS topic FROM v_bank""")
def _(v):
    return v.bank.select("id", R.topic_of(F.col("module"), F.col("sub"), F.col("stem"), None, LATIN_TOPICS).alias("topic"))


@query("probe_class", """SELECT id, CASE WHEN regexp_matches(sub,'#1') THEN 'one' WHEN regexp_matches(sub,'#2') THEN 'two' WHEN regexp_matches(stem,'#1|ring') THEN 'one'
    WHEN regexp_matches(stem,'#2|bolt') THEN 'two' ELSE 'rest' END AS topic FROM v_bank""")
def _(v):
    return v.bank.select("id", R.probe_match([F.col("sub"), F.col("stem")], [("one", "#1|ring"), ("two", "#2|bolt")], "rest").alias("topic"))


@query("multi_label", """SELECT doc_id, coalesce(nullif(concat_ws(',', CASE WHEN regexp_matches(text,'tion') THEN 'tion' END,
    CASE WHEN regexp_matches(text,'(?i)the ') THEN 'the' END, CASE WHEN regexp_matches(text,'[0-9]{3,}') THEN 'number' END),''),'other') AS labels FROM documents""")
def _(v):
    rules = [("tion", "tion"), ("the", "(?i)the "), ("number", "[0-9]{3,}")]
    return v.documents.select("doc_id", F.array_join(R.all_matches(F.col("text"), rules, "other"), ",").alias("labels"))


_TH = [("ring", "ing"), ("and", "and|und"), ("ent", "ent"), ("ou", "ou")]


def _theme_sql(t1, t2):
    rows = []
    for i, (n, rx) in enumerate(_TH):
        a, b = f"len(regexp_extract_all({t1},'{rx}'))", f"len(regexp_extract_all({t2},'{rx}'))"
        rows.append(f"SELECT doc_id, 3*{a}+{b} AS s, CASE WHEN {a}>0 THEN 0 WHEN {b}>0 THEN 1 ELSE 2 END AS t, {i} AS i, '{n}' AS n FROM d")
    return " UNION ALL ".join(rows)


@query("weighted_theme", "WITH d AS (SELECT doc_id, split_part(text,chr(10),1) AS title, text FROM documents), s AS (" + _theme_sql("title", "text") + """)
    SELECT doc_id, CASE WHEN s>0 THEN n ELSE 'mixed' END AS theme FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, t, i)=1""")
def _(v):
    title = F.substring_index("text", "\n", 1)
    return v.documents.select("doc_id", R.weighted_theme([title, F.col("text")], [3, 1], _TH, "mixed").alias("theme"))


@query("path_class", """SELECT page_id, CASE WHEN regexp_matches(url,'^https://m[.]') THEN 'mobile' WHEN regexp_matches(url,'/en/') AND regexp_matches(n,'[?]') THEN 'en-list'
    WHEN regexp_matches(url,'/(fr|de|es)/') THEN 'foreign' ELSE 'other' END AS cat,
    concat_ws(',', CASE WHEN regexp_matches(url,'[.]org') THEN 'org' END, CASE WHEN regexp_matches(url,'page=') THEN 'paged' END) AS subjects,
    CASE WHEN regexp_matches(url,'https') THEN 'secure' ELSE '' END AS exam,
    coalesce(try_cast(nullif(regexp_extract(n,'(20[0-9][0-9])',1),'') AS INT),0) AS year
    FROM (SELECT *, list_extract(string_split(url,'/'),-1) AS n FROM pages)""")
def _(v):
    rules = [("mobile", [R.has("t", r"^https://m[.]")]), ("en-list", [R.has("t", "/en/"), R.has("n", "[?]")]), ("foreign", [R.has("t", "/(fr|de|es)/")])]
    cat, subjects, exam, year = C.path_class(F.col("url"), rules, [("secure", "https")], [("org", "[.]org"), ("paged", "page=")], "other")
    d = v.table("pages").select("page_id", cat, subjects, exam, year)
    return d.withColumn("subjects", F.array_join("subjects", ","))


@query("two_level_group", """WITH f AS (SELECT fid, list_extract(string_split(rel,'/'),-1) AS t, rel AS p FROM v_files),
    m AS (SELECT *, list_filter([CASE WHEN regexp_matches(t,'1') THEN 'one' END, CASE WHEN regexp_matches(t,'22') THEN 'two' END], lambda x: x IS NOT NULL) AS a,
      list_filter([CASE WHEN regexp_matches(p,'/en/|src1') THEN 'one' END, CASE WHEN regexp_matches(p,'/fr/|src2') THEN 'two' END], lambda x: x IS NOT NULL) AS b,
      CASE WHEN regexp_matches(t,'5') AND NOT regexp_matches(p,'http') THEN 'five' ELSE '' END AS o FROM f)
    SELECT fid, CASE WHEN len(a)>0 THEN 'subject' WHEN o<>'' THEN 'other' WHEN len(b)>0 THEN 'subject' ELSE 'rest' END AS grp,
      CASE WHEN len(a)=1 THEN a[1] WHEN len(a)>1 THEN 'mixed' WHEN o<>'' THEN o WHEN len(b)=1 THEN b[1] WHEN len(b)>1 THEN 'mixed' ELSE '' END AS sub FROM m""")
def _(v):
    g, s = C.two_level_group(C.base_name(F.col("rel")), F.col("rel"), F.lit(""), [("one", "1"), ("two", "22")],
                             [("one", "/en/|src1"), ("two", "/fr/|src2")], "mixed", [("five", [R.has("t", "5"), R.lacks("p", "http")])])
    return v.files.select("fid", g, s)


@query("content_module", """WITH q AS (SELECT id, regexp_replace(stem,'\\s+','','g') AS s, sub AS o, CASE WHEN material IS NOT NULL THEN repeat(concat('ring',id),6) ELSE '' END AS m FROM v_bank)
    SELECT id, CASE WHEN m<>'' AND regexp_matches(concat(s,substr(m,1,400)),'ring') AND len(regexp_extract_all(m,'[0-9]'))>20 THEN 'data'
      WHEN regexp_matches(s,'gear') THEN 'gears' WHEN regexp_matches(s,'^red') THEN 'reds'
      WHEN len(regexp_extract_all(s,'[0-9]'))>=2 THEN 'count' WHEN regexp_matches(s,'bolt') THEN 'pol' ELSE 'rest' END AS module FROM q""")
def _(v):
    m = F.when(F.col("material").isNotNull(), F.repeat(F.concat(F.lit("ring"), F.col("id")), 6))
    return v.bank.select("id", C.content_module(F.col("stem"), F.col("sub"), m, "ring", [("gears", "gear"), ("reds", "^red")], "[?]", "bolt",
                                                ("data", "count", "pol", "rest")).alias("module"))


@query("date_parts_from_name", """WITH p AS (SELECT page_id, string_split(url,'/') AS a FROM pages), q AS (SELECT page_id, a[-1] AS n, list_reverse(a[:-2]) AS f FROM p),
    r AS (SELECT page_id, n, nullif(regexp_extract(n,'^(\\d{2,3})',1),'')::INT AS y1, nullif(regexp_extract(n,'page=(\\d+)',1),'')::INT AS m1,
      list_filter(list_transform(f, lambda x: nullif(regexp_extract(x,'^(\\d{2,3})',1),'')::INT), lambda x: x IS NOT NULL)[1] AS y2 FROM q),
    s AS (SELECT page_id, n, coalesce(y1,y2,0) AS y, coalesce(m1,0) AS m FROM r)
    SELECT page_id, CASE WHEN y>0 AND y<100 THEN y+2000 ELSE y END AS year, CASE WHEN m BETWEEN 1 AND 12 THEN m ELSE 0 END AS month,
      CASE WHEN regexp_matches(n,'ref=x') THEN 'x' WHEN regexp_matches(n,'#top') THEN 'top' ELSE '' END AS half FROM s""")
def _(v):
    parts = C.date_parts(F.col("url"), [r"^(\d{2,3})"], [r"page=(\d+)"], [("x", [R.has("n", "ref=x")]), ("top", [R.has("n", "#top")])])
    return v.table("pages").select("page_id", *parts)


@query("doc_describe", """SELECT fid, CASE WHEN NOT skip THEN CASE WHEN regexp_matches(rel,'/en/') THEN 'english' WHEN regexp_matches(rel,'pdf$') THEN 'print' ELSE 'rest' END END AS section,
    CASE WHEN skip THEN 'scratch' END AS skip_reason FROM (SELECT *, regexp_matches(rel,'tmp$') AS skip FROM v_files)""")
def _(v):
    sec, skip = C.doc_describe(F.col("rel"), [("skip:scratch", [R.has("n", "tmp$")]), ("english", [R.has("r", "/en/")]), ("print", [R.has("n", "pdf$")])], "rest")
    return v.files.select("fid", sec, skip)


@query("readiness_band", """SELECT conv_id, turn, CASE WHEN cpm<150 THEN 'slow' WHEN cpm>260 THEN 'fast' ELSE 'normal' END AS band
    FROM (SELECT conv_id, turn, round_even(length(regexp_replace(text,'[\\s]+','','g'))/((60+turn*7)/60.0::DOUBLE),0)::BIGINT AS cpm FROM conversations)""")
def _(v):
    from studyloom.functions.text import chars_per_minute
    return v.table("conversations").select("conv_id", "turn", O.speech_band(chars_per_minute(F.col("text"), 60 + F.col("turn") * 7)).alias("band"))


@query("override_overlay", """SELECT id, coalesce(quality, answer) AS answer, CASE WHEN quality IS NOT NULL THEN answer END AS orig_answer,
    CASE WHEN doc_id IS NULL THEN 0 ELSE 1 END AS fixed FROM v_bank LEFT JOIN (SELECT doc_id, CASE WHEN toxic=0 THEN quality END AS quality FROM labels) ON doc_id=id""")
def _(v):
    fixes = v.table("labels").select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 0, F.col("quality")).cast("bigint").alias("answer"))
    return O.override_overlay(v.bank.select("id", "answer"), fixes, ["answer"])


@query("settings_clamp", """SELECT id, CASE WHEN s='' THEN 300 WHEN try_cast(s AS DOUBLE) IS NULL THEN 300 ELSE least(5000, greatest(10, try_cast(s AS DOUBLE))) END::DOUBLE AS cap
    FROM (SELECT id, CASE WHEN id%5=0 THEN stem WHEN id%5=1 THEN '' ELSE (num*id)::VARCHAR END AS s FROM v_bank)""")
def _(v):
    s = F.when(F.col("id") % 5 == 0, F.col("stem")).when(F.col("id") % 5 == 1, "").otherwise((F.col("num") * F.col("id")).cast("string"))
    return v.bank.select("id", O.settings_clamp(s, 300, 10, 5000).alias("cap"))


@query("mask_secret", """SELECT doc_id, CASE WHEN text='' THEN '' WHEN length(text)>8 THEN concat(substr(text,1,3),'****',right(text,4)) ELSE '****' END AS hint FROM documents""")
def _(v):
    return v.documents.select("doc_id", O.mask_secret(F.col("text")).alias("hint"))


@query("last_n", "SELECT id, user_id, module FROM v_attempts ORDER BY id DESC LIMIT 200")
def _(v):
    return S.last_n(v.attempts, 200).select("id", "user_id", "module")


PICK_SQL = KNOWN + DONE + """, d AS (SELECT k.id, CASE WHEN material IS NOT NULL THEN concat('m',material) ELSE concat('q',k.id) END AS g, last, md5(concat_ws('|','s',k.id)) AS h
    FROM k LEFT JOIN done USING (id) {where}), gr AS (SELECT g, count(*) AS size, min(row({key})) AS gk FROM d GROUP BY g),
    c AS (SELECT *, coalesce(sum(size) OVER (ORDER BY gk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS b FROM gr) SELECT id FROM d JOIN c USING (g) WHERE b<{n}"""


@query("pick_new", PICK_SQL.format(where="", key="CASE WHEN last IS NULL THEN 0 ELSE 1 END, coalesce(last, TIMESTAMP '1970-01-01'), h", n=40))
def _(v):
    return S.pick(v.bank.where("answer IS NOT NULL"), done_of(v), "new", 40, "s")


@query("pick_wrong", PICK_SQL.format(where="WHERE k.id IN (SELECT qid FROM v_wrong WHERE mastered=0)", key="h", n=15))
def _(v):
    return S.pick(v.bank.where("answer IS NOT NULL"), done_of(v), "wrong", 15, "s", wrong=v.wrong.where("mastered = 0").select(F.col("qid").alias("id")))


@query("pick_seq", PICK_SQL.format(where="WHERE k.id>=(SELECT min(k2.id) FROM k k2 LEFT JOIN done d2 ON d2.id=k2.id WHERE d2.id IS NULL)", key="k.id".replace("k.", ""), n=25))
def _(v):
    return S.pick(v.bank.where("answer IS NOT NULL"), done_of(v), "seq", 25, "s")


@query("pick_fav", PICK_SQL.format(where="WHERE k.id IN (SELECT doc_id FROM labels WHERE quality=1)", key="h", n=1000000))
def _(v):
    favs = v.table("labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return S.pick(v.bank.where("answer IS NOT NULL"), done_of(v), "fav", 0, "s", favorites=favs)


MOCK = S.mock_quotas({"ECONOMY": 20, "SMALL": 15, "PROMO": 30, "LARGE": 10, "MEDIUM": 35, "STANDARD": 20}, 0.3, "STANDARD")


@query("stratified_compose", KNOWN + """, r AS (SELECT module, id, row_number() OVER (PARTITION BY module ORDER BY md5(concat_ws('|','m',id)), id) AS rn FROM k)
    SELECT * FROM r WHERE rn <= CASE module WHEN 'ECONOMY' THEN 6 WHEN 'SMALL' THEN 5 WHEN 'PROMO' THEN 9 WHEN 'LARGE' THEN 3 WHEN 'MEDIUM' THEN 11 WHEN 'STANDARD' THEN 5 END""")
def _(v):
    return S.compose(v.bank.where("answer IS NOT NULL"), MOCK, "m")


@query("compose_plan", KNOWN + """, p AS (SELECT module, count(*) AS available, CASE module WHEN 'ECONOMY' THEN 6 WHEN 'SMALL' THEN 5 WHEN 'PROMO' THEN 9
    WHEN 'LARGE' THEN 3 WHEN 'MEDIUM' THEN 11 WHEN 'STANDARD' THEN 5 END::BIGINT AS want FROM k GROUP BY module)
    SELECT *, least(want,available) AS got, greatest(10, floor(120*sum(least(want,available)) OVER ()/130.0::DOUBLE+0.5)::BIGINT) AS minutes FROM p""")
def _(v):
    return S.compose_plan(v.bank.where("answer IS NOT NULL"), MOCK, 130)


@query("proportional_quota", """WITH t AS (SELECT p_type AS module, count(*) AS total FROM part GROUP BY 1), r AS (SELECT * FROM t WHERE module<>'PROMO'),
    w AS (SELECT module, total, floor(total/(sum(total) OVER ())::DOUBLE*70+0.5)::BIGINT AS want, row_number() OVER (ORDER BY total DESC, module)-1 AS r FROM r),
    d AS (SELECT *, 70-sum(want) OVER () AS diff FROM w)
    SELECT module, (want + CASE WHEN r<abs(diff) THEN sign(diff) ELSE 0 END)::BIGINT AS want FROM d UNION ALL SELECT 'PROMO', 5""")
def _(v):
    return S.proportional_quota(v.table("part").groupBy(F.col("p_type").alias("module")).agg(F.count("*").alias("total")), 75, "PROMO")


@query("quiz_sample", """WITH q AS (SELECT concat(b.doc,'-',b.seq) AS id, substr(regexp_replace(b.text,'[^0-9A-Za-zÀ-ÿ_]','','g'),1,40) AS k FROM v_qblocks b
      JOIN documents d ON d.doc_id=b.doc AND d.lang='en' WHERE kind='q'), o AS (SELECT k, min(id) AS id FROM q WHERE k<>'' GROUP BY k)
    SELECT id, (SELECT count(*) FROM o) AS total FROM o ORDER BY md5(concat_ws('|','z',id)) LIMIT 50""")
def _(v):
    en = v.documents.where("lang = 'en'").select(F.col("doc_id").alias("doc"))
    q = v.qblocks.where("kind = 'q'").join(en, "doc").select(F.concat("doc", F.lit("-"), "seq").alias("id"), "text")
    k = F.substring(F.regexp_replace("text", "[^0-9A-Za-zÀ-ÿ_]", ""), 1, 40)
    return S.sample_distinct(q.withColumn("key", k).where("key <> ''"), F.col("key"), 50, "z")


@query("positions_page", """SELECT code, count, applicants, CASE WHEN applicants>0 THEN round_even(applicants/count::DOUBLE,1) END AS ratio
    FROM v_positions LEFT JOIN v_applicants USING (code) ORDER BY ratio DESC NULLS LAST, code LIMIT 50 OFFSET 50""")
def _(v):
    return V.page_of(V.with_applicants(v.positions, v.applicants), "ratio_desc", 2).select("code", "count", "applicants", "ratio")


@query("case_listing_sort", """SELECT id, kind, year, half, no FROM (SELECT id, CASE WHEN src='real' THEN 'paper' ELSE 'mock' END AS kind, year,
    CASE WHEN id%2=0 THEN 'first' ELSE 'second' END AS half, num AS no FROM v_bank)""")
def _(v):
    c = v.bank.select("id", F.when(F.col("src") == "real", "paper").otherwise("mock").alias("kind"), "year",
                      F.when(F.col("id") % 2 == 0, "first").otherwise("second").alias("half"), F.col("num").alias("no"))
    return S.case_listing(c)


@query("study_queue", f"""WITH c AS (SELECT b.id AS card, s.due FROM v_bank b LEFT JOIN (SELECT qid, min(due) AS due FROM v_cards GROUP BY qid) s ON s.qid=b.id),
    q AS (SELECT * FROM (SELECT 0 AS part, md5(concat_ws('|','q',card)) AS k, card FROM c WHERE due<='{TODAY}' ORDER BY k LIMIT 60)
      UNION ALL SELECT * FROM (SELECT 1, '', card FROM c WHERE due IS NULL ORDER BY card LIMIT 30))
    SELECT row_number() OVER (ORDER BY part,k,card) AS pos, card FROM q ORDER BY pos LIMIT 80""")
def _(v):
    due = v.cards.groupBy(F.col("qid").alias("card")).agg(F.min("due").alias("due"))
    return S.study_queue(v.bank.select(F.col("id").alias("card")).join(due, "card", "left"), TODAY, 60, 30, 80, "q")


@query("study_queue_by_user", f"""WITH m AS (SELECT user_id, count(CASE WHEN last_review='{TODAY}' AND first_review<'{TODAY}' THEN 1 END) AS reviewed, count(CASE WHEN first_review='{TODAY}' THEN 1 END) AS nw FROM v_cards GROUP BY 1),
    due AS (SELECT user_id, 0 AS part, md5(concat_ws('|','q',qid)) AS k, qid AS card FROM v_cards JOIN m USING (user_id) WHERE due<='{TODAY}' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k, qid)<=6-any_value(reviewed) OVER (PARTITION BY user_id)),
    new AS (SELECT user_id, 1 AS part, '' AS k, b.id AS card FROM m, v_bank b WHERE NOT EXISTS (SELECT 1 FROM v_cards c WHERE c.user_id=m.user_id AND c.qid=b.id) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY b.id)<=3-any_value(nw) OVER (PARTITION BY user_id)),
    q AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY part, k, card) AS pos, card FROM (SELECT * FROM due UNION ALL SELECT * FROM new)),
    f AS (SELECT row_number() OVER (ORDER BY md5(concat_ws('|','q',id)), id) AS pos, id AS card FROM v_bank)
    SELECT * FROM q WHERE pos<=8 UNION ALL SELECT user_id, pos, card FROM m, f WHERE pos<=8 AND user_id NOT IN (SELECT user_id FROM q)""")
def _(v):
    """Small caps, so that every rule shows on the given log."""
    states = v.cards.select("user_id", F.col("qid").alias("card"), "due", "first_review", "last_review")
    return S.study_queue_by_user(v.bank.select(F.col("id").alias("card")), states, TODAY, 6, 3, 8, "q")


@query("pick_wrong_by_user", KNOWN + """, d AS (SELECT DISTINCT user_id, k.id, CASE WHEN material IS NOT NULL THEN concat('m',material) ELSE concat('q',k.id) END AS g, md5(concat_ws('|','s',k.id)) AS h FROM k JOIN v_wrong w ON w.qid=k.id WHERE mastered=0),
    gr AS (SELECT user_id, g, count(*) AS size, min(h) AS gk FROM d GROUP BY 1,2), c AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY user_id ORDER BY gk, g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS b FROM gr)
    SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY gk, g, id) AS pos, id FROM d JOIN c USING (user_id, g) WHERE b<5""")
def _(v):
    return S.pick_by_user(v.bank.where("answer IS NOT NULL"), v.wrong.where("mastered = 0").select("user_id", F.col("qid").alias("id")), 5, "s")


PROG_SQL = """WITH p AS (SELECT user_id, doc, coalesce(arg_max(seq,id) FILTER (seq IS NOT NULL),0) AS seq, coalesce(arg_max(pct,id) FILTER (pct IS NOT NULL),0) AS pct,
    coalesce(arg_max(done,id) FILTER (done IS NOT NULL),0) AS done, coalesce(arg_max(fav,id) FILTER (fav IS NOT NULL),0) AS fav, max(id) AS updated
    FROM v_docprog GROUP BY user_id, doc) """


@query("continue_reading_by_user", PROG_SQL + "SELECT user_id, doc, pct, updated FROM p WHERE done=0 AND pct>0 AND pct<100 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY updated DESC, doc)<=4")
def _(v):
    from studyloom.operators.memory import progress_upsert
    return S.continue_reading(progress_upsert(v.docprog, ["user_id", "doc"]), by=["user_id"]).select("user_id", "doc", "pct", "updated")


@query("continue_reading", PROG_SQL + "SELECT user_id, doc, pct, updated FROM p WHERE done=0 AND pct>0 AND pct<100 ORDER BY updated DESC LIMIT 4")
def _(v):
    from studyloom.operators.memory import progress_upsert
    return S.continue_reading(progress_upsert(v.docprog, ["user_id", "doc"])).select("user_id", "doc", "pct", "updated")


@query("per_group_cap", """SELECT doc, page FROM (SELECT doc, page, row_number() OVER (PARTITION BY doc ORDER BY page) AS rn FROM v_pages_txt WHERE contains(text,'the'))
    WHERE rn<=8 ORDER BY doc, page LIMIT 300""")
def _(v):
    hits = v.pages_txt.where(F.col("text").contains("the")).select("doc", "page")
    return S.per_group_cap(hits, ["doc"], ["page"], 8, 300)


@query("priority_order", """SELECT fid FROM (SELECT fid, rel LIKE '%.pdf' AS has_text, pages%7 AS scanned, fid%30 AS day FROM v_files)""")
def _(v):
    f = v.files.select("fid", F.col("rel").endswith(".pdf").alias("has_text"), (F.col("pages") % 7).alias("scanned"), (F.col("fid") % 30).alias("day"))
    return S.priority_order(f).select("fid")


@query("group_keep_order", """SELECT id, coalesce(min(pos) FILTER (material IS NOT NULL) OVER (PARTITION BY material), pos) AS first FROM
    (SELECT id, material, (id*7919)%100003 AS pos FROM v_bank) QUALIFY true""".replace(" QUALIFY true", "").replace(
    "coalesce(min(pos) FILTER (material IS NOT NULL) OVER (PARTITION BY material), pos)", "CASE WHEN material IS NULL THEN pos ELSE min(pos) OVER (PARTITION BY material) END"))
def _(v):
    b = v.bank.select("id", "material", (F.col("id") * 7919 % 100003).alias("pos"))
    return S.keep_groups_together(b, "material", "pos").select("id", "first")


def _cases(v):
    words = F.split("stem", " ")
    return v.bank.select("id", "year", F.when(F.col("src") == "real", "paper").otherwise("mock").alias("kind"), F.col("num").alias("no"),
                         words.alias("tags"), F.col("answer").isNotNull().alias("answered"))


_TAGS = ["red", "ring", "bolt", "gear", "hot", "small"]


def _tagged_sql(year):
    """The whole rule: the real cases of the year when there are five, else one case per tag, tag by tag."""
    ctes = [f"real AS (SELECT id, num FROM v_bank WHERE src='real' AND year={year} ORDER BY num, id LIMIT 5)",
            "c AS (SELECT id, unnest(string_split(stem,' ')) AS tag FROM v_bank WHERE answer IS NOT NULL)"]
    for i, t in enumerate(_TAGS):
        seen = " AND ".join([f"id NOT IN (SELECT id FROM p{j})" for j in range(i)]) or "true"
        ctes.append(f"p{i} AS (SELECT {i} AS t, id FROM c WHERE tag='{t}' AND {seen} ORDER BY md5(concat_ws('|','t',tag,id)) LIMIT 1)")
    u = " UNION ALL ".join(f"SELECT * FROM p{i}" for i in range(len(_TAGS)))
    return ("WITH " + ", ".join(ctes) + f""" SELECT row_number() OVER (ORDER BY num, id)-1 AS pos, id FROM real WHERE (SELECT count(*) FROM real)=5
        UNION ALL SELECT * FROM (SELECT row_number() OVER (ORDER BY t)-1 AS pos, id FROM ({u}) WHERE (SELECT count(*) FROM real)<5 ORDER BY pos LIMIT 5)""")


@query("tagged_set_year", _tagged_sql(2001))
def _(v):
    return S.tagged_set(_cases(v), "red", _TAGS[1:], 2001, "t")


@query("tagged_set", _tagged_sql(1900))
def _(v):
    return S.tagged_set(_cases(v), "red", _TAGS[1:], 1900, "t")


@query("import_applicants", """SELECT count(b.id) AS matched, count(*) AS rows FROM v_applicants a LEFT JOIN v_bank b ON b.id=a.code AND b.id%2=0""")
def _(v):
    ups = v.table("lineitem").groupBy(F.col("l_partkey").alias("code"), F.col("l_linenumber").alias("seq")).agg(F.count("*").alias("applicants"))
    return V.import_applicants(v.positions.where("code % 2 = 0"), ups)
