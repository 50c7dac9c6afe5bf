"""Queries over joins, dedup and set operations."""
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from studyloom.functions import text as T
from studyloom.operators import dedup as D
from studyloom.operators import joins as J
from studyloom.operators import matching as M
from studyloom.operators import overlay as O
from studyloom.plans.registry import query
from studyloom.plans.text import HID, hidden_copies
from studyloom.sources.views import EXAM_TODAY

L = T.LATIN
KEY = f"regexp_replace(text,'[^{L}0-9]','','g')"


def key_of(c, keep=L + "0-9"):
    return T.only(F.col(c), keep)


@query("attempt_bank_join", "SELECT t.id, t.qid, coalesce(b.module,t.module) AS module, sub, topic, correct FROM v_attempts t LEFT JOIN v_bank b ON b.id=t.qid AND b.answer IS NOT NULL")
def _(v):
    return J.attempt_bank_join(v.attempts, v.bank.where("answer IS NOT NULL")).select("id", "qid", "module", "sub", "topic", "correct")


@query("doc_meta_join", "SELECT doc, seq, kind, lang, source FROM v_blocks JOIN documents ON doc_id=doc WHERE lang<>'de'")
def _(v):
    meta = v.documents.where("lang <> 'de'").select(F.col("doc_id").alias("doc"), "lang", "source")
    return v.blocks.select("doc", "seq", "kind").join(meta, "doc")


@query("lookup_default", """SELECT l.doc_id AS doc, quality, coalesce(substr(text,1,20),'(removed)') AS title FROM labels l LEFT JOIN documents d ON d.doc_id=l.doc_id AND lang='en'""")
def _(v):
    names = v.documents.where("lang = 'en'").select(F.col("doc_id").alias("doc"), F.substring("text", 1, 20).alias("title"))
    return O.lookup_default(v.table("labels").select(F.col("doc_id").alias("doc"), "quality"), names, "doc", "title", "(removed)")


@query("anti_hidden", "WITH " + HID + " SELECT doc_id AS doc, lang FROM documents WHERE doc_id NOT IN (SELECT doc FROM hid)")
def _(v):
    return v.documents.select(F.col("doc_id").alias("doc"), "lang").join(hidden_copies(v), "doc", "left_anti")


@query("semi_wanted", "SELECT id, module FROM v_bank WHERE id IN (SELECT qid FROM v_wrong WHERE mastered=0)")
def _(v):
    return v.bank.select("id", "module").join(v.wrong.where("mastered = 0").select(F.col("qid").alias("id")), "id", "left_semi")


IDS = "WITH i AS (SELECT event_id AS pos, (event_id*7919)%2500 AS id FROM events) "


def _ids(v):
    return v.table("events").select(F.col("event_id").alias("pos"), (F.col("event_id") * 7919 % 2500).alias("id"))


@query("get_by_ids", IDS + "SELECT pos, id, stem, answer FROM i JOIN v_bank USING (id)")
def _(v):
    return J.get_by_ids(v.bank.select("id", "stem", "answer"), _ids(v))


@query("get_by_ids_materials", IDS + "SELECT DISTINCT material AS mid FROM v_bank WHERE material IS NOT NULL AND id IN (SELECT id FROM i)")
def _(v):
    picked = J.get_by_ids(v.bank.select("id", "material"), _ids(v))
    mats = v.bank.select(F.col("material").alias("mid")).where("mid IS NOT NULL").distinct()
    return J.side_rows(mats, picked, "mid", "material")


@query("asof_answer_attach", """SELECT a.doc, a.num, a.seq, a.ans, q.seq AS q_seq FROM (SELECT * FROM v_qblocks WHERE kind='a') a
    ASOF JOIN (SELECT * FROM v_qblocks WHERE kind='q') q ON a.doc=q.doc AND a.num=q.num AND a.seq>=q.seq""")
def _(v):
    return J.asof_answer_attach(v.qblocks)


@query("asof_position_lookup", """WITH s AS (SELECT doc, page, coalesce(sum(length(text)+1) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)::BIGINT AS pos FROM v_pages_txt),
    o AS (SELECT doc_id AS doc, (n_chars*k)//5 AS pos, k FROM documents, range(5) t(k)) SELECT o.doc, o.k, o.pos, s.page FROM o ASOF JOIN s ON o.doc=s.doc AND o.pos>=s.pos""")
def _(v):
    from pyspark.sql import Window as W
    w = W.partitionBy("doc").orderBy("page").rowsBetween(W.unboundedPreceding, -1)
    starts = v.pages_txt.select("doc", "page", F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)).cast("bigint").alias("pos"))
    k = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint"))).alias("k")
    offs = v.documents.select(F.col("doc_id").alias("doc"), "n_chars", k).select("doc", "k", F.floor(F.col("n_chars") * F.col("k") / 5).cast("bigint").alias("pos"))
    return J.position_lookup(starts, offs).select("doc", "k", "pos", "page")


PH = [("base", "1992-01-01", "1994-06-30"), ("special", "1994-07-01", "1996-12-31"), ("sprint", "1997-01-01", "1998-12-31")]


@query("interval_phase", "SELECT o_orderkey, coalesce(phase,'none') AS phase FROM orders LEFT JOIN (VALUES " + ", ".join(
    f"('{n}', DATE '{s}', DATE '{e}')" for n, s, e in PH) + ") p(phase,s,e) ON o_orderdate::DATE BETWEEN s AND e")
def _(v):
    o = v.table("orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return J.interval_phase(o, "day", PH, "none").select("o_orderkey", "phase")


@query("date_conflict", f"""SELECT a.exam AS a, a.day AS a_date, b.exam AS b, b.day AS b_date, (b.day-a.day)::INT AS days,
    CASE WHEN b.day=a.day THEN 'same day' ELSE concat(b.day-a.day,' days apart') END AS note FROM v_exam_dates a JOIN v_exam_dates b
    ON a.exam<>b.exam AND b.day-a.day BETWEEN 0 AND 21 AND (b.day>a.day OR a.exam<b.exam) WHERE a.day>=DATE '{EXAM_TODAY}'""")
def _(v):
    return J.date_conflict(v.exam_dates, EXAM_TODAY)


@query("question_answer_mate", """WITH f AS (SELECT fid, split_part(rel,'/',1) AS dir, fid%12 AS month, CASE WHEN fid%3=0 THEN 'questions' ELSE 'answers' END AS role FROM v_files),
    r AS (SELECT *, row_number() OVER (PARTITION BY dir, month, role ORDER BY fid) AS rn FROM f)
    SELECT q.fid, q.dir, q.month, a.fid AS mate FROM r q LEFT JOIN r a ON a.role='answers' AND a.dir=q.dir AND a.month=q.month AND a.rn=q.rn WHERE q.role='questions'""")
def _(v):
    f = v.files.select("fid", F.substring_index("rel", "/", 1).alias("dir"), (F.col("fid") % 12).alias("month"),
                       F.when(F.col("fid") % 3 == 0, "questions").otherwise("answers").alias("role"))
    return J.question_answer_mate(f)


@query("bank_match", f"""WITH k AS (SELECT doc, seq, {KEY} AS k FROM v_qblocks), b AS (SELECT item_id, {KEY} AS f FROM benchmark UNION ALL
      SELECT 1125899906842624+item_id*1048576+i, {KEY} FROM (SELECT item_id, unnest(range(len(string_split(text,'.')))) AS i, unnest(string_split(text,'.')) AS text FROM benchmark)),
    bb AS (SELECT * FROM b WHERE length(f)>=6)
    SELECT doc, seq, min(item_id) AS item_id FROM k JOIN bb ON substr(k,1,22)=substr(f,1,22) AND (starts_with(f,substr(k,1,40)) OR starts_with(k,substr(f,1,40))) WHERE length(k)>=12 GROUP BY doc, seq""")
def _(v):
    left = v.qblocks.select(F.struct("doc", "seq").alias("b"), key_of("text").alias("k")).where("length(k) >= 12")
    bm = v.table("benchmark")
    parts = bm.select("item_id", F.posexplode(F.split("text", r"\.")).alias("i", "text")).select((F.lit(1 << 50) + F.col("item_id") * 1048576 + F.col("i")).alias("item_id"), "text")
    right = bm.select("item_id", "text").unionByName(parts).select("item_id", key_of("text").alias("k")).where("length(k) >= 6")
    return J.prefix_match(left, right, "k", "b", "item_id").select("b.doc", "b.seq", "item_id")


@query("borrow_from_copies", f"""WITH r AS (SELECT doc, seq, CASE WHEN length({KEY})>=12 THEN substr({KEY},1,40) END AS k, ans AS opts, CASE WHEN doc%2=0 THEN concat(ans,num) END AS a FROM v_qblocks)
    SELECT u.doc, u.seq, arg_min(h.a, (h.doc, h.seq)) AS ans, min(h.doc) AS src FROM r u JOIN r h ON h.k=u.k AND h.opts=u.opts AND h.doc<>u.doc AND h.a IS NOT NULL
    WHERE u.a IS NULL AND u.k IS NOT NULL GROUP BY u.doc, u.seq""")
def _(v):
    k = key_of("text")
    r = v.qblocks.select("doc", "seq", F.when(F.length(k) >= 12, F.substring(k, 1, 40)).alias("k"), F.col("ans").alias("opts"),
                         F.when(F.col("doc") % 2 == 0, F.concat("ans", "num")).alias("ans"))
    return J.borrow_from_copies(r, "k", ["opts"])


def _options(text, turn):
    """Words two to five of a text as options A to D, turned by ``turn`` places. The words behind them stay one piece, as nothing asks for them."""
    words = F.filter(F.split(text, r"\s+", 7), lambda x: x != "")
    at = lambda i: F.coalesce(F.get(words, (F.lit(i) + turn) % 4 + 1), F.lit(""))
    return F.array(*[F.struct(F.lit(a).alias("letter"), at(i).alias("text")) for i, a in enumerate("ABCD")])


@query("bank_answers")
def _(v):
    """Sentences of documents as questions, those of the benchmark as the bank: same words as options, in another order."""
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda x: x != "")
    q = v.qblocks.select("doc", "seq", F.col("text").alias("stem"), _options("text", F.col("seq") % 4).alias("options"), F.array_distinct(words("text")).alias("sig"), F.lit("").alias("exp"))
    b = v.table("benchmark").select("item_id", F.col("text").alias("exp"), F.posexplode(F.split("text", r"\.")).alias("i", "stem"))
    turned = F.transform(_options("stem", F.col("item_id") % 4), lambda o: o["text"])
    b = b.select((F.col("item_id") * 1048576 + F.col("i")).alias("id"), "stem", turned.alias("options"), (F.col("i") % 4).cast("int").alias("answer"), "exp",
                 F.array_distinct(words("exp")).alias("exp_sig"), F.length("exp").alias("exp_len"))
    return M.bank_answers(q, b, key=lambda c: T.only(c, L + "0-9"), keep=L + "0-9").drop("exp")


@query("borrow_answers")
def _(v):
    """Sentences of even documents have an answer; the others take it from the first one that has the same sentence."""
    q = v.qblocks.select("doc", "seq", F.col("text").alias("stem"), _options("text", F.col("doc") % 4).alias("options"), F.when(F.col("doc") % 2 == 0, F.col("ans")).alias("ans"), F.lit("").alias("exp"))
    return M.borrow_answers(q, key=lambda c: T.only(c, L + "0-9"), keep=L + "0-9").drop("exp")


@query("fill_missing_from_versions", """WITH q AS (SELECT module AS pid, source AS version, id AS ord, num, replace(stem,' ','') AS key, answer FROM v_bank),
    ver AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY answered DESC, count DESC, version) AS rank FROM (SELECT pid, version, count(answer) AS answered, count(*) AS count FROM q GROUP BY 1,2)),
    b AS (SELECT q.*, v.count FROM q JOIN ver v USING (pid,version) WHERE rank=1),
    off AS (SELECT b.ord, v.rank, (SELECT arg_max(o.answer,o.ord) FROM q o WHERE o.pid=b.pid AND o.version=v.version AND o.key=b.key AND o.answer IS NOT NULL AND length(b.key)>=8) AS ka,
      CASE WHEN v.count=b.count THEN (SELECT arg_max(struct_pack(a:=o.answer),o.ord).a FROM q o WHERE o.pid=b.pid AND o.version=v.version AND o.num=b.num) END AS na
      FROM b JOIN ver v ON v.pid=b.pid AND v.rank>1 WHERE b.answer IS NULL),
    f AS (SELECT ord, arg_min(coalesce(ka,na),rank) FILTER (coalesce(ka,na) IS NOT NULL) AS a FROM off GROUP BY ord)
    SELECT pid, version, b.ord, coalesce(answer,a) AS answer, CASE WHEN answer IS NULL AND a IS NOT NULL THEN 1 ELSE 0 END AS filled FROM b LEFT JOIN f ON f.ord=b.ord""")
def _(v):
    q = v.bank.select(F.col("module").alias("pid"), F.col("source").alias("version"), F.col("id").alias("ord"), "num", F.replace("stem", F.lit(" "), F.lit("")).alias("key"), "answer")
    return J.fill_missing_from_versions(q)


@query("next_unfinished", """SELECT p_type AS course, arg_min(p_partkey, p_partkey) AS lesson FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity>48) GROUP BY p_type""")
def _(v):
    lessons = v.table("part").select(F.col("p_type").alias("course"), F.col("p_partkey").alias("lesson"), F.col("p_partkey").alias("ord"))
    return J.next_unfinished(lessons, v.table("lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("lesson")))


# ---- set operations and dedup

@query("union_banks", """SELECT id, stem, 'real' AS origin FROM v_bank WHERE src='real' UNION ALL SELECT id, stem, 'builtin' FROM v_bank WHERE src='builtin' UNION ALL SELECT id+1000000, stem, 'pack' FROM v_bank WHERE src='book'""")
def _(v):
    b = v.bank
    parts = [b.where("src = 'real'").select("id", "stem", F.lit("real").alias("origin")), b.where("src = 'builtin'").select("id", "stem", F.lit("builtin").alias("origin")),
             b.where("src = 'book'").select((F.col("id") + 1000000).alias("id"), "stem", F.lit("pack").alias("origin"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("minus_seen", f"WITH s AS (SELECT {KEY} AS k FROM benchmark) SELECT doc, seq FROM v_qblocks WHERE {KEY} NOT IN (SELECT k FROM s UNION SELECT {KEY} FROM v_qblocks WHERE doc%10=0) AND doc%10<>0")
def _(v):
    k = key_of("text")
    seen = v.table("benchmark").select(k.alias("_k")).union(v.qblocks.where("doc % 10 = 0").select(k.alias("_k"))).distinct()
    return D.minus_seen(v.qblocks.where("doc % 10 <> 0").select("doc", "seq", "text"), seen, k).select("doc", "seq")


@query("covers", f"""WITH w AS (SELECT DISTINCT doc_id AS id, unnest(regexp_extract_all(lower(text),'[{L}]+')) AS item FROM documents), o AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text),'[{L}]+')) AS item FROM benchmark)
    SELECT id, round_even(count(o.item)/count(*)::DOUBLE,4) AS share, count(*) AS items FROM w LEFT JOIN o USING (item) GROUP BY id""")
def _(v):
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(f"([{L}]+)")))).alias("item")
    return D.covers(v.documents.select(F.col("doc_id").alias("id"), words), v.table("benchmark").select(words).distinct())


DK = f"""dk AS (SELECT doc_id AS id, n_chars, lang, CASE WHEN length(s)>=12 THEN 's:'||substr(s,1,40) WHEN length(e)>=20 THEN 'e:'||substr(e,1,50) END AS k, s, text FROM
    (SELECT *, regexp_replace(split_part(text,chr(10),1),'[^{L}]','','g') AS s, regexp_replace(text,'[^{L}]','','g') AS e FROM documents))"""


def _dk(v):
    return D.dedup_key(F.substring_index("text", "\n", 1), F.col("text"), L)


def _docs(v):
    return v.documents.withColumnRenamed("doc_id", "id")


@query("dedup_key", "WITH " + DK + " SELECT id, k FROM dk")
def _(v):
    return _docs(v).select("id", _dk(v).alias("k"))


@query("dedup_keep_best", "WITH " + DK + """ SELECT arg_max(id, (CASE WHEN lang='en' THEN 1 ELSE 0 END, n_chars, -id)) AS id, count(*) AS copies FROM dk GROUP BY coalesce(k,'#'||id)""")
def _(v):
    d = _docs(v).withColumn("img", F.when(F.col("lang") == "en", 1).otherwise(0))
    return D.keep_best(d, _dk(v), ["img", "n_chars"], "id")


@query("dedup_first", f"SELECT min(doc*4294967296+seq) AS id, count(*) AS copies FROM (SELECT doc, seq, {KEY} AS k FROM v_qblocks) GROUP BY k")
def _(v):
    d = v.qblocks.select((F.col("doc") * 4294967296 + F.col("seq")).alias("id"), "text")
    return D.keep_first(d, key_of("text"), "id")


@query("dedup_replace_if_better", "WITH " + DK + """, g AS (SELECT coalesce(k,'#'||id) AS g, id, length(text)%3<>0 AS whole, lang='de' AS fig FROM dk)
    SELECT CASE WHEN arg_min(whole,id) THEN min(id) ELSE coalesce(min(CASE WHEN whole AND NOT fig THEN id END), min(id)) END AS id, min(id) AS pos FROM g GROUP BY g""")
def _(v):
    return D.replace_if_better(_docs(v), _dk(v), "id", F.length("text") % 3 != 0, F.col("lang") == "de")


@query("exact_copies", """SELECT size, pages, ext, arg_min(fid, (-d, n, rel)) AS fid, count(*) AS copies FROM (SELECT *, regexp_extract(rel,'[.]([a-z]+)$',1) AS ext,
    len(string_split(rel,'/')) AS d, length(list_extract(string_split(rel,'/'),-1)) AS n FROM v_files) GROUP BY 1,2,3""")
def _(v):
    return D.exact_copies(v.files.withColumn("ext", F.regexp_extract("rel", "[.]([a-z]+)$", 1))).select("size", "pages", "ext", "fid", "copies")


@query("best_version", """SELECT k, arg_min(fid, (CASE WHEN rel LIKE '%.pdf' THEN 0 ELSE 1 END, -(fid%13), -pages, length(rel), fid)) AS fid FROM (SELECT *, regexp_replace(split_part(rel,'?',1),'[0-9]+','','g') AS k FROM v_files) GROUP BY k""")
def _(v):
    k = F.regexp_replace(F.substring_index("rel", "?", 1), "[0-9]+", "")
    order = [F.when(F.col("rel").endswith(".pdf"), 0).otherwise(1), -(F.col("fid") % 13), -F.col("pages"), F.length("rel"), F.col("fid")]
    return D.best_version(v.files, k, order)


@query("superseded_formats", """WITH f AS (SELECT *, substr(rel,1,3) AS course, (fid//4)%300 AS month FROM v_files) SELECT fid FROM f WHERE rel LIKE '%.docx'
    AND (course, month) IN (SELECT (course, month) FROM f WHERE rel LIKE '%.pdf')""")
def _(v):
    f = v.files.withColumn("course", F.substring("rel", 1, 3)).withColumn("month", F.floor(F.col("fid") / 4) % 300)
    return D.superseded(f, F.col("rel").endswith(".docx"), F.col("rel").endswith(".pdf"), ["course", "month"]).select("fid")


@query("memo_dup", "SELECT lang AS book, min(doc_id) AS id, count(*) AS copies FROM documents GROUP BY lang, trim(text)")
def _(v):
    return D.memo_dup(v.documents.select(F.col("lang").alias("book"), F.col("text").alias("content"), F.col("doc_id").alias("id")))


@query("repeat_paragraphs", f"""WITH k AS (SELECT doc, seq, regexp_replace(text,'[^{L}]','','g') AS k, text FROM v_blocks)
    SELECT doc, seq FROM k WHERE NOT (length(k)>=80 AND NOT regexp_matches(text,'[?]')) UNION ALL SELECT doc, min(seq) FROM k WHERE length(k)>=80 AND NOT regexp_matches(text,'[?]') GROUP BY doc, k""")
def _(v):
    return D.repeat_paragraphs(v.blocks, L, exempt="[?]")


RS = f"""q AS (SELECT doc, seq, text, lead(text,2) OVER (PARTITION BY doc ORDER BY seq) AS nx FROM v_qblocks WHERE kind='q'), e AS (SELECT doc, seq, text, CASE WHEN doc%2=0 THEN nx ELSE text END AS ex FROM q),
    n AS (SELECT doc, count(*) AS nq FROM e GROUP BY doc), t0 AS (SELECT DISTINCT doc, seq, unnest(regexp_extract_all(lower(text),'[{L}]{{3,}}')) AS tok FROM e),
    cm AS (SELECT t0.doc, tok FROM t0 JOIN n ON n.doc=t0.doc GROUP BY t0.doc, tok, nq HAVING count(*)>greatest(3, nq*0.08)), t AS (SELECT * FROM t0 WHERE (doc,tok) NOT IN (SELECT (doc,tok) FROM cm)),
    z AS (SELECT doc, seq, count(*) AS size FROM t GROUP BY 1,2 HAVING count(*)>=6), x AS (SELECT DISTINCT e.doc, e.seq, unnest(regexp_extract_all(lower(ex),'[{L}]{{3,}}')) AS tok FROM e JOIN z ON z.doc=e.doc AND z.seq=e.seq WHERE ex IS NOT NULL AND length(ex)>=40),
    k AS (SELECT x.doc, x.seq AS e, t.seq, count(*)/least(max(size),15)::DOUBLE AS sc FROM x JOIN t ON t.doc=x.doc AND t.tok=x.tok JOIN z ON z.doc=t.doc AND z.seq=t.seq GROUP BY 1,2,3),
    o AS (SELECT w.doc, w.seq, coalesce(max(k.sc),0) AS own FROM (SELECT DISTINCT doc, seq FROM x) w LEFT JOIN k ON k.doc=w.doc AND k.e=w.seq AND k.seq=w.seq GROUP BY 1,2),
    b AS (SELECT k.doc, k.e, own, max((sc,k.seq)) AS m FROM k JOIN o ON o.doc=k.doc AND o.seq=k.e AND own<0.15 WHERE k.e<>k.seq GROUP BY 1,2,3)"""


@query("realign_by_signature", "WITH " + RS + """, v AS (SELECT b.doc, b.e, m[2] AS j, m[1] AS sc FROM b WHERE m[1]>=0.4 AND m[1]>=own*3+0.2), w AS (SELECT v.* FROM v LEFT JOIN o ON o.doc=v.doc AND o.seq=v.j WHERE NOT coalesce(own>=sc/2 AND own>=0.15,false))
    SELECT doc, arg_max(e,(sc,e)) AS seq, j AS "to", round_even(max(sc),4) AS score FROM w GROUP BY doc, j""")
def _(v):
    return J.realign_by_signature(_explained(v))


@query("realign_actions", "WITH " + RS + """, v AS (SELECT b.doc, b.e, m[2] AS j, m[1] AS sc FROM b WHERE m[1]>=0.4 AND m[1]>=own*3+0.2), w AS (SELECT v.* FROM v LEFT JOIN o ON o.doc=v.doc AND o.seq=v.j WHERE NOT coalesce(own>=sc/2 AND own>=0.15,false)),
    g AS (SELECT doc, arg_max(e,(sc,e)) AS seq, j FROM w GROUP BY doc, j)
    SELECT doc, seq, 'moved' AS action, j AS "to" FROM g UNION ALL
    SELECT e.doc, e.seq, 'removed', NULL FROM e JOIN z ON z.doc=e.doc AND z.seq=e.seq LEFT JOIN k ON k.doc=e.doc AND k.e=e.seq AND k.seq=e.seq WHERE k.doc IS NULL AND size>=8 AND length(ex)>=60 AND (e.doc, e.seq) NOT IN (SELECT (doc, seq) FROM g)""")
def _(v):
    return M.realign_actions(_explained(v))


def _explained(v):
    """Questions with their explanation: in even documents it is the text two questions further on."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(f"([{L}]{{3,}})")))
    q = v.qblocks.where("kind = 'q'").withColumn("nx", F.lead("text", 2).over(W.partitionBy("doc").orderBy("seq")))
    q = q.withColumn("ex", F.when(F.col("doc") % 2 == 0, F.col("nx")).otherwise(F.col("text")))
    return q.select("doc", "seq", words(F.col("text")).alias("sig"), words(F.coalesce("ex", F.lit(""))).alias("exp_sig"),
                                           F.coalesce(F.length("ex"), F.lit(0)).alias("exp_len"))
