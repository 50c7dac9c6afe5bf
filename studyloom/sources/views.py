"""Binding views: the driver tables read as an attempt log, a question bank, a document corpus and so on.

Every view is written once with DataFrame expressions and once as DuckDB SQL (``VIEW_SQL``), from the same
integer-only arithmetic. ``v_*`` SQL names and ``Views`` properties correspond one to one.
"""
from functools import cached_property

from pyspark.sql import functions as F

from studyloom.functions.text import token_estimate

TODAY = "2024-01-30"
EXAM_TODAY = "1995-01-01"

# Requirement texts of the vacancy view (fixed values), picked by p_size modulo the list length.
POSITION_TEXTS = {
    "edu": ["本科及以上", "仅限硕士研究生", "本科或硕士研究生", "大专及以上", "不限", "硕士研究生及以下"],
    "politics": ["中共党员", "中共党员或共青团员", "不限", "共青团员"],
    "years": ["无限制", "二年", "五年以上", "3年", "两年以上", "要求10年经历", ""],
    "project": ["无限制", "大学生村官", "不限"],
    "major": ["不限", "法学类", "计算机科学与技术", "经济学、金融学类", ""],
}


def _pick(name):
    vals = POSITION_TEXTS[name]
    return F.element_at(F.array(*[F.lit(v) for v in vals]), (F.col("p_size") % len(vals) + 1).cast("int"))


def _pick_sql(name):
    vals = POSITION_TEXTS[name]
    return "[" + ", ".join(f"'{v}'" for v in vals) + f"][p_size % {len(vals)} + 1]"


def spread(df, key):
    """One task per core for the single small file of a local run, where the session asks for it (``local_session`` does).

    A cluster's session does not, so that its plans never depend on the number of splits of an input.
    """
    spark = df.sparkSession
    return df.repartition(spark.sparkContext.defaultParallelism, key) if spark.conf.get("studyloom.spread", "false") == "true" else df


class Views:
    def __init__(self, spark, sf_dir):
        self.spark, self.dir = spark, sf_dir

    def table(self, name):
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # ---- learning log
    @cached_property
    def attempts(self):
        e = self.table("events")
        i, u = F.col("event_id"), F.col("user_id")
        return e.select(
            i.alias("id"), "user_id",
            F.get_json_object("props", "$.k").cast("bigint").alias("qid"),
            F.col("event_type").alias("module"),
            F.when((i * 7 + u * 3) % 10 < 5 + i % 3, 1).otherwise(0).cast("bigint").alias("correct"),
            F.floor("value").cast("bigint").alias("seconds"),
            F.element_at(F.array(F.lit("practice"), F.lit("exam"), F.lit("doc_example")), (i % 3 + 1).cast("int")).alias("mode"),
            (u * 100000 + F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date"))).alias("session_id"),
            F.col("ts").alias("created_at"),
            F.to_date("ts").alias("day"),
        )

    @cached_property
    def bank(self):
        p = self.table("part")
        k = F.col("p_partkey")
        return p.select(
            k.alias("id"), F.col("p_type").alias("module"), F.col("p_brand").alias("sub"), F.col("p_brand").alias("source"),
            F.col("p_name").alias("stem"),
            F.when(F.col("p_size") % 5 == 0, 0).otherwise(F.col("p_size") + 1990).cast("bigint").alias("year"),
            F.when(k % 7 != 0, k % 4).alias("answer"),
            F.when(k % 3 == 0, F.floor(k / 6)).cast("bigint").alias("material"),
            F.element_at(F.array(F.lit("real"), F.lit("builtin"), F.lit("book")), (k % 3 + 1).cast("int")).alias("src"),
            F.col("p_size").cast("bigint").alias("num"),
            F.substring_index("p_name", " ", -1).alias("topic"),
        )

    @cached_property
    def sessions(self):
        return (self.attempts.where("mode = 'exam'").groupBy("session_id", "user_id")
                .agg(F.count("*").alias("total"), F.sum("correct").alias("correct"), F.sum("seconds").alias("duration"),
                     F.min("day").alias("day"), F.min("created_at").alias("started")))

    @cached_property
    def study(self):
        return self.table("orders").select(
            F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("day"), F.col("o_custkey").alias("user_id"),
            F.col("o_orderpriority").alias("module"), F.floor(F.col("o_totalprice") / 5000).cast("bigint").alias("minutes"))

    @cached_property
    def checkins(self):
        return (self.table("events").where("event_type = 'signup'")
                .select("user_id", F.to_date("ts").alias("day")).distinct())

    @cached_property
    def reviews(self):
        return self.attempts.withColumn("grade", 1 + F.col("id") % 4)

    @cached_property
    def cards(self):
        return (self.attempts.groupBy("user_id", "qid")
                .agg(F.count("*").alias("reps"), F.sum(1 - F.col("correct")).alias("lapses"),
                     F.max("day").alias("last_review"), F.min("day").alias("first_review"),
                     (1 + F.max("seconds") / 4.0).alias("stability"), F.max("module").alias("deck"))
                .withColumn("difficulty", (1 + F.col("qid") % 10).cast("double"))
                .withColumn("due", F.date_add("last_review", F.bround("stability").cast("int"))))

    @cached_property
    def wrong(self):
        q = F.col("qid")
        return (self.attempts.where("correct = 0").groupBy("user_id", "qid")
                .agg(F.count("*").alias("wrong_count"), F.max("created_at").alias("last_wrong_at"),
                     F.max("day").alias("last_wrong_day"), F.max("module").alias("module"))
                .withColumn("next_review", F.date_add("last_wrong_day", (1 + q % 5).cast("int")))
                .withColumn("mastered", F.when(q % 4 == 0, 1).otherwise(0).cast("bigint"))
                .withColumn("reason", F.when(q % 4 == 0, "read").when(q % 4 == 1, "calc").when(q % 4 == 2, "time")))

    @cached_property
    def positions(self):
        return self.table("part").select(
            F.col("p_partkey").alias("code"), F.col("p_brand").alias("dept"), F.col("p_type").alias("unit"),
            F.col("p_name").alias("title"), F.concat(F.lit("R"), F.col("p_size") % 7).alias("region"),
            (1 + F.col("p_size") % 5).cast("bigint").alias("count"),
            *[_pick(n).alias(n) for n in POSITION_TEXTS])

    @cached_property
    def applicants(self):
        return self.table("lineitem").groupBy(F.col("l_partkey").alias("code")).agg(F.count("*").alias("applicants"))

    @cached_property
    def speed(self):
        return self.table("lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
            F.concat(F.when(F.col("l_linenumber") % 2 == 0, "").otherwise("rk-"), F.lower("l_returnflag"),
                     F.lower("l_linestatus")).alias("kind"),
            F.lit(10).cast("bigint").alias("total"), (F.col("l_quantity").cast("bigint") % 11).alias("correct"),
            (30 * F.col("l_linenumber")).cast("bigint").alias("seconds"))

    @cached_property
    def usage(self):
        return self.table("conversations").select(
            F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 60).cast("int")).alias("day"),
            F.col("role").alias("kind"), (F.col("conv_id") % 25).alias("user_id"), "conv_id", "turn",
            token_estimate(F.col("text")).alias("input_tokens"),
            (F.length("text") % 500).cast("bigint").alias("output_tokens"), (F.col("turn") % 2).alias("estimated"))

    @cached_property
    def essays(self):
        t = F.col("turn")
        return self.table("conversations").select(
            (F.col("conv_id") * 100 + t).alias("id"), F.concat(F.lit("case:"), F.col("conv_id") % 20).alias("set_id"),
            F.when(t % 2 != 0, t).alias("self_score"), F.when(t % 3 != 0, t * 2).alias("ai_score"))

    @cached_property
    def docprog(self):
        i = F.col("event_id")
        return self.table("events").select(
            i.alias("id"), "user_id", (F.get_json_object("props", "$.k").cast("bigint") % 10).alias("doc"),
            F.when(i % 4 == 0, F.floor("value").cast("bigint")).alias("seq"),
            F.when(i % 4 == 1, i % 111).alias("pct"),
            F.when(i % 4 == 2, F.floor(i / 4).cast("bigint") % 2).alias("done"),
            F.when(i % 4 == 3, F.floor(i / 8).cast("bigint") % 2).alias("fav"))

    @cached_property
    def exam_dates(self):
        return (self.table("orders").select(F.col("o_orderpriority").alias("exam"), F.to_date("o_orderdate").alias("day")).distinct())

    # ---- corpus
    @cached_property
    def documents(self):
        return spread(self.table("documents"), "doc_id")

    @cached_property
    def blocks(self):
        d = self.documents.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("seq", "text"))
        n = F.length("text")
        return d.select("doc", F.col("seq").cast("bigint").alias("seq"), "text",
                        F.floor(F.col("seq") / 10).cast("bigint").alias("page"),
                        F.when(n <= 30, "h").otherwise("p").alias("kind"), (1 + n % 3).cast("bigint").alias("level"))

    @cached_property
    def qblocks(self):
        d = self.documents.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", r"\.")).alias("seq", "text"))
        n = F.length("text")
        num = (n % 20).cast("bigint")
        return d.select("doc", F.col("seq").cast("bigint").alias("seq"), "text",
                        F.floor(F.col("seq") / 50).cast("bigint").alias("page"), num.alias("num"),
                        F.when(n % 7 == 0, "a").when(n % 11 == 0, "h").otherwise("q").alias("kind"),
                        F.element_at(F.array(*[F.lit(x) for x in "ABCD"]), (n % 4 + 1).cast("int")).alias("ans"))

    @cached_property
    def words(self):
        """Every word as a printed line: whole texts in which short lines recur."""
        w = F.filter(F.split("text", "[ \n]+"), lambda x: x != "")
        return self.documents.select(F.col("doc_id").alias("doc"), F.posexplode(w).alias("seq", "text")).withColumn("seq", F.col("seq").cast("bigint"))

    # ---- the same blocks in their document's own row: (doc, b), ``b`` an array of structs in reading order
    @cached_property
    def word_rows(self):
        w = F.filter(F.split("text", "[ \n]+"), lambda x: x != "")
        return self.documents.select(F.col("doc_id").alias("doc"), F.transform(w, lambda x, i: F.struct(
            i.cast("bigint").alias("seq"), x.alias("text"))).alias("b"))

    @cached_property
    def qblock_rows(self):
        def block(x, i):
            n = F.length(x)
            return F.struct(i.cast("bigint").alias("seq"), x.alias("text"), F.when(n % 7 == 0, "a").when(n % 11 == 0, "h").otherwise("q").alias("kind"))
        return self.documents.select(F.col("doc_id").alias("doc"), F.transform(F.split("text", r"\."), block).alias("b"))

    @cached_property
    def pages_txt(self):
        d = self.documents.select(F.col("doc_id").alias("doc"), F.split("text", "\n").alias("lines"))
        page = F.posexplode(F.transform(
            F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / 10).cast("int")),
            lambda p: F.concat_ws("\n", F.slice("lines", p * 10 + 1, 10)))).alias("page", "text")
        return d.select("doc", page).withColumn("page", F.col("page").cast("bigint"))

    @cached_property
    def files(self):
        p = self.table("pages").select(
            F.col("page_id").alias("fid"), F.col("url").alias("rel"), F.length("html").cast("bigint").alias("size"))
        d = self.table("documents").select(
            (F.col("doc_id") + 1000000000).alias("fid"),
            F.concat("source", F.lit("/"), "doc_id",
                     F.element_at(F.array(F.lit(".pdf"), F.lit(".docx"), F.lit(".md"), F.lit(".tmp")),
                                  (F.col("doc_id") % 4 + 1).cast("int"))).alias("rel"),
            F.length("text").cast("bigint").alias("size"))
        return p.unionByName(d).select("fid", "rel", "size", F.col("fid").alias("mtime"),
                                       F.ceil(F.col("size") / 2000).cast("bigint").alias("pages"))

    @cached_property
    def files_next(self):
        return self.files.where(F.col("fid") % 17 != 0).withColumn(
            "mtime", F.when(F.col("fid") % 10 == 0, F.col("mtime") + 1).otherwise(F.col("mtime")))


VIEW_SQL = {
    "v_attempts": """SELECT event_id AS id, user_id, json_extract_string(props, '$.k')::BIGINT AS qid, event_type AS module,
        CASE WHEN (event_id*7+user_id*3)%10 < 5+event_id%3 THEN 1 ELSE 0 END::BIGINT AS correct,
        floor(value)::BIGINT AS seconds, ['practice','exam','doc_example'][event_id%3+1] AS mode,
        user_id*100000+date_diff('day',DATE '1970-01-01',ts::DATE) AS session_id, ts AS created_at, ts::DATE AS day FROM events""",
    "v_bank": """SELECT p_partkey AS id, p_type AS module, p_brand AS sub, p_brand AS source, p_name AS stem,
        CASE WHEN p_size%5=0 THEN 0 ELSE p_size+1990 END::BIGINT AS year,
        CASE WHEN p_partkey%7<>0 THEN p_partkey%4 END AS answer,
        CASE WHEN p_partkey%3=0 THEN p_partkey//6 END AS material,
        ['real','builtin','book'][p_partkey%3+1] AS src, p_size::BIGINT AS num,
        list_extract(string_split(p_name,' '),-1) AS topic FROM part""",
    "v_sessions": """SELECT session_id, user_id, count(*) AS total, sum(correct)::BIGINT AS correct,
        sum(seconds)::BIGINT AS duration, min(day) AS day, min(created_at) AS started FROM v_attempts WHERE mode='exam' GROUP BY session_id, user_id""",
    "v_study": """SELECT o_orderkey AS id, o_orderdate::DATE AS day, o_custkey AS user_id, o_orderpriority AS module,
        floor(o_totalprice/5000)::BIGINT AS minutes FROM orders""",
    "v_checkins": "SELECT DISTINCT user_id, ts::DATE AS day FROM events WHERE event_type='signup'",
    "v_reviews": "SELECT *, 1+id%4 AS grade FROM v_attempts",
    "v_cards": """SELECT *, (1+qid%10)::DOUBLE AS difficulty, last_review+round_even(stability,0)::INT AS due FROM (
        SELECT user_id, qid, count(*) AS reps, sum(1-correct)::BIGINT AS lapses, max(day) AS last_review,
        min(day) AS first_review, (1+max(seconds)/4.0)::DOUBLE AS stability, max(module) AS deck FROM v_attempts GROUP BY user_id, qid)""",
    "v_wrong": """SELECT *, last_wrong_day+(1+qid%5)::INT AS next_review, CASE WHEN qid%4=0 THEN 1 ELSE 0 END::BIGINT AS mastered,
        CASE qid%4 WHEN 0 THEN 'read' WHEN 1 THEN 'calc' WHEN 2 THEN 'time' END AS reason FROM (
        SELECT user_id, qid, count(*) AS wrong_count, max(created_at) AS last_wrong_at, max(day) AS last_wrong_day,
        max(module) AS module FROM v_attempts WHERE correct=0 GROUP BY user_id, qid)""",
    "v_positions": f"""SELECT p_partkey AS code, p_brand AS dept, p_type AS unit, p_name AS title, concat('R', p_size%7) AS region,
        (1+p_size%5)::BIGINT AS count, {", ".join(_pick_sql(n) + " AS " + n for n in POSITION_TEXTS)} FROM part""",
    "v_applicants": "SELECT l_partkey AS code, count(*) AS applicants FROM lineitem GROUP BY 1",
    "v_speed": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
        concat(CASE WHEN l_linenumber%2=0 THEN '' ELSE 'rk-' END, lower(l_returnflag), lower(l_linestatus)) AS kind,
        10::BIGINT AS total, l_quantity::BIGINT%11 AS correct, (30*l_linenumber)::BIGINT AS seconds FROM lineitem""",
    "v_usage": """SELECT DATE '2024-01-01'+(conv_id%60)::INT AS day, role AS kind, conv_id%25 AS user_id, conv_id, turn,
        (floor(length(regexp_replace(text,'[^一-鿿]','','g'))/1.5 + (length(text)-length(regexp_replace(text,'[^一-鿿]','','g')))/4.0)+1)::BIGINT AS input_tokens,
        (length(text)%500)::BIGINT AS output_tokens, turn%2 AS estimated FROM conversations""",
    "v_essays": """SELECT conv_id*100+turn AS id, concat('case:', conv_id%20) AS set_id, CASE WHEN turn%2<>0 THEN turn END AS self_score,
        CASE WHEN turn%3<>0 THEN turn*2 END AS ai_score FROM conversations""",
    "v_docprog": """SELECT event_id AS id, user_id, json_extract_string(props,'$.k')::BIGINT%10 AS doc,
        CASE WHEN event_id%4=0 THEN floor(value)::BIGINT END AS seq, CASE WHEN event_id%4=1 THEN event_id%111 END AS pct,
        CASE WHEN event_id%4=2 THEN (event_id//4)%2 END AS done, CASE WHEN event_id%4=3 THEN (event_id//8)%2 END AS fav FROM events""",
    "v_exam_dates": "SELECT DISTINCT o_orderpriority AS exam, o_orderdate::DATE AS day FROM orders",
    "v_blocks": """SELECT doc, seq, text, seq//10 AS page, CASE WHEN length(text)<=30 THEN 'h' ELSE 'p' END AS kind,
        (1+length(text)%3)::BIGINT AS level FROM (SELECT doc_id AS doc, unnest(range(len(string_split(text,chr(10))))) AS seq,
        unnest(string_split(text,chr(10))) AS text FROM documents)""",
    "v_qblocks": """SELECT doc, seq, text, seq//50 AS page, (length(text)%20)::BIGINT AS num,
        CASE WHEN length(text)%7=0 THEN 'a' WHEN length(text)%11=0 THEN 'h' ELSE 'q' END AS kind,
        ['A','B','C','D'][length(text)%4+1] AS ans FROM (SELECT doc_id AS doc, unnest(range(len(string_split(text,'.')))) AS seq,
        unnest(string_split(text,'.')) AS text FROM documents)""",
    "v_words": """SELECT doc_id AS doc, unnest(range(len(w)))::BIGINT AS seq, unnest(w) AS text
        FROM (SELECT doc_id, list_filter(string_split_regex(text,'[ \n]+'), lambda x: x<>'') AS w FROM documents)""",
    "v_pages_txt": "SELECT doc, page, string_agg(text, chr(10) ORDER BY seq) AS text FROM v_blocks GROUP BY doc, page",
    "v_files": """SELECT fid, rel, size, fid AS mtime, ceil(size/2000)::BIGINT AS pages FROM (
        SELECT page_id AS fid, url AS rel, length(html) AS size FROM pages UNION ALL
        SELECT doc_id+1000000000, concat(source,'/',doc_id,['.pdf','.docx','.md','.tmp'][doc_id%4+1]), length(text) FROM documents)""",
    "v_files_next": """SELECT fid, rel, size, CASE WHEN fid%10=0 THEN mtime+1 ELSE mtime END AS mtime, pages FROM v_files WHERE fid%17<>0""",
}
