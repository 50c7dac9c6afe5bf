"""Queries over structure: headings, outlines, questions, keys, cards, folds per document."""
from pyspark.sql import functions as F

from studyloom.functions import text as T
from studyloom.operators import folds as P
from studyloom.operators import cards as K
from studyloom.operators import segment as S
from studyloom.plans.registry import query

L = T.LATIN


def n_():
    return F.length("text")


def jl(c, sep=","):
    return F.array_join(c, sep)


HEADS = ["^(De|The)", "^(La|Is)", "^En", "^Ei", "^(Th|Un)", "^[A-C]"]


@query("heading_detect", """WITH t AS (SELECT doc, seq, trim(text) AS t FROM v_qblocks), p AS (SELECT *, length(t) AS n, length(t)%4=0 AS big, length(t)%3=0 AS bold,
    CASE WHEN regexp_matches(t,'^(De|The)') THEN 0 WHEN regexp_matches(t,'^(La|Is)') THEN 1 WHEN regexp_matches(t,'^En') THEN 2 WHEN regexp_matches(t,'^Ei') THEN 3 WHEN regexp_matches(t,'^(Th|Un)') THEN 4 WHEN regexp_matches(t,'^[A-C]') THEN 5 END AS pat FROM t)
    SELECT doc, seq, CASE WHEN n=0 OR n>40 OR regexp_matches(t,'sch') OR (regexp_matches(t,'[aeiou]$') AND NOT coalesce(pat<=1,false)) THEN NULL WHEN big AND n<=24 THEN coalesce(pat,9)
      WHEN pat<=4 AND n<=30 THEN pat WHEN pat=5 AND n<=18 AND bold THEN pat WHEN bold AND n<=24 THEN 6 END AS rank FROM p""")
def _(v):
    t = F.trim("text")
    return v.qblocks.select("doc", "seq", S.head_rank(t, F.length(t) % 4 == 0, F.length(t) % 3 == 0, HEADS, "[aeiou]$", "sch").alias("rank"))


@query("make_outline", """WITH b AS (SELECT doc, seq, text, kind, level, length(text) AS len, CASE WHEN regexp_matches(text,'^(De|The)') THEN 1 WHEN regexp_matches(text,'^[A-E]') THEN 4 WHEN regexp_matches(text,'^L') THEN 5 END AS num FROM v_blocks),
    c AS (SELECT *, kind<>'h' AND len<=120 AND len>0 AND num IS NOT NULL AS c1, kind<>'h' AND len<=120 AND len>0 AND num IS NULL AND len<=80 AND coalesce(lead(len) OVER (PARTITION BY doc ORDER BY seq)>greatest(120,len*2),false) AS c2 FROM b),
    n AS (SELECT doc, count(*) AS n, count(*) FILTER (kind='h') AS h, count(*) FILTER (c1) AS k1, count(*) FILTER (c1 OR c2) AS k2, count(*) FILTER (len>0) AS nt FROM c GROUP BY doc),
    m AS (SELECT *, CASE WHEN h>=3 OR (h>0 AND n<=10) THEN 'h' WHEN k1>=2 OR (k1>0 AND n<=10) THEN '1' WHEN k2>=2 OR (k2>0 AND n<=10) THEN '2' ELSE 'r' END AS m FROM n),
    p AS (SELECT c.*, m.m, m.h, CASE WHEN len>0 THEN count(CASE WHEN len>0 THEN 1 END) OVER (PARTITION BY c.doc ORDER BY seq)-1 END AS pos, greatest(6, nt//12) AS step FROM c JOIN m USING (doc)),
    e AS (SELECT doc, seq, CASE WHEN kind='h' THEN level WHEN c1 AND m<>'r' THEN CASE WHEN num<=3 THEN 1 WHEN num=4 THEN 2 ELSE 3 END ELSE 1 END::BIGINT AS level, trim(regexp_replace(text,'\\s+',' ','g')) AS x, kind='h' AS ish, m FROM p
      WHERE (kind='h' AND NOT (m='r' AND h=0)) OR (m='1' AND c1) OR (m='2' AND (c1 OR c2)) OR (m='r' AND h=0 AND len>0 AND pos%step=0)),
    t AS (SELECT *, CASE WHEN ish THEN CASE WHEN length(x)<=60 THEN x ELSE substr(x,1,60)||'…' END WHEN m='r' THEN CASE WHEN length(split_part(x,'.',1))<=24 THEN trim(split_part(x,'.',1)) ELSE substr(trim(split_part(x,'.',1)),1,24)||'…' END
      ELSE CASE WHEN length(x)<=30 THEN x ELSE substr(x,1,30)||'…' END END AS title FROM e)
    SELECT doc, seq, level, title FROM (SELECT *, lag(title) OVER (PARTITION BY doc ORDER BY seq) AS pt FROM t) WHERE pt IS NULL OR regexp_replace(pt,'\\s','','g')<>regexp_replace(title,'\\s','','g')""")
def _(v):
    num = F.when(F.col("text").rlike("^(De|The)"), 1).when(F.col("text").rlike("^[A-E]"), 4).when(F.col("text").rlike("^L"), 5)
    return S.make_outline(v.blocks, num, short=80, long=120, small=10, sentence=r"\.")


@query("outline_match", """WITH b AS (SELECT doc, seq, seq//3 AS page, text FROM v_blocks), m AS (SELECT doc, seq AS mark, greatest(0, page-seq%2) AS page, CASE WHEN seq%4=0 THEN concat('Zz ',text) ELSE text END AS title FROM b WHERE length(text)>0),
    k AS (SELECT *, substr(regexp_replace(title,'[^A-Za-z0-9À-ÖØ-öø-ÿ]','','g'),1,12) AS k FROM m), t AS (SELECT doc, page, seq, regexp_replace(text,'[^A-Za-z0-9À-ÖØ-öø-ÿ]','','g') AS t FROM b WHERE length(text)<=500),
    h AS (SELECT k.doc, k.mark, min(t.seq) AS seq FROM k JOIN t ON t.doc=k.doc AND t.page IN (k.page,k.page+1) AND (starts_with(t.t,k.k) OR (t.t<>'' AND starts_with(k.k,substr(t.t,1,12)))) WHERE k.k<>'' GROUP BY 1,2),
    s AS (SELECT doc, page, min(seq) AS s FROM b GROUP BY 1,2)
    SELECT m.doc, m.mark, coalesce(h.seq, s.s) AS seq, (h.seq IS NOT NULL)::INT AS hit FROM m LEFT JOIN h USING (doc,mark) LEFT JOIN s ON s.doc=m.doc AND s.page=m.page""")
def _(v):
    b = v.blocks.withColumn("page", F.floor(F.col("seq") / 3).cast("bigint"))
    m = b.where(n_() > 0).select("doc", F.col("seq").alias("mark"), F.greatest(F.lit(0), F.col("page") - F.col("seq") % 2).cast("bigint").alias("page"),
        F.when(F.col("seq") % 4 == 0, F.concat(F.lit("Zz "), "text")).otherwise(F.col("text")).alias("title"))
    return S.outline_match(b, m, longest=500)


@query("toc_page_detect", """SELECT doc, page FROM v_qblocks WHERE length(regexp_replace(text,'\\s','','g'))>=4 GROUP BY doc, page HAVING count(*)>=6 AND count(*) FILTER (regexp_matches(text,'[aeiou][a-z]$'))>=count(*)*0.4""")
def _(v):
    return S.toc_pages(v.qblocks, "[aeiou][a-z]$")


def _lines(v):
    """The question stream as printed lines: number and stem, three option lines, the last two options glued."""
    q = v.qblocks.where("kind = 'q'")
    stem = F.concat((F.col("num") + 1).cast("string"), F.lit(". stem "), F.regexp_replace("text", "[ \n]+", " "))
    more = F.concat(F.lit("more of "), F.col("seq").cast("string"))
    ls = F.array(stem, more, F.concat(F.lit("A. "), "ans"), F.lit("B. beta"), F.lit("C. gamma  D. delta"))
    return q.select("doc", "seq", F.posexplode(ls).alias("i", "text")).select("doc", (F.col("seq") * 8 + F.col("i")).alias("seq"), "text")


@query("question_segment", """SELECT doc, seq*8 AS seq, (num+1)::INT AS num, concat(trim(concat('stem ',regexp_replace(text,'[ \n]+',' ','g'))),chr(10),'more of ',seq) AS stem, concat('A=',ans,';B=beta;C=gamma;D=delta') AS options FROM v_qblocks WHERE kind='q'""")
def _(v):
    q = S.question_segment(_lines(v))
    return q.withColumn("options", jl(F.transform("options", lambda o: F.concat(o["letter"], F.lit("="), o["text"])), ";"))


@query("question_unfold", """WITH q AS (SELECT doc, seq, num, CASE WHEN num%2=0 THEN ['B. one','C. two'] ELSE ['A. one','B. two'] END AS o FROM v_qblocks WHERE kind='q'), l AS (SELECT doc, seq, list_concat([concat('stem ',num)], o) AS l FROM q WHERE num%2=0)
    SELECT doc, seq, (unnest(range(len(l))))::INT AS part, unnest(l) AS text FROM l""")
def _(v):
    mk = lambda a, b: F.array(F.struct(F.lit(a).alias("letter"), F.lit("one").alias("text")), F.struct(F.lit(b).alias("letter"), F.lit("two").alias("text")))
    q = v.qblocks.where("kind = 'q'").select("doc", "seq", F.concat(F.lit("stem "), F.col("num")).alias("stem"),
                                             F.when(F.col("num") % 2 == 0, mk("B", "C")).otherwise(mk("A", "B")).alias("options"))
    return S.question_unfold(q)


@query("answer_key_expand", """WITH k AS (SELECT doc, seq, num+1 AS a, CASE WHEN seq%3=0 THEN num+3 ELSE num+2 END AS z, concat(ans,'B') AS ls FROM v_qblocks WHERE kind='a' AND seq%2=0),
    d AS (SELECT doc, seq, num, ans FROM v_qblocks WHERE kind='a' AND seq%2=1)
    SELECT doc, seq, (a+i)::INT AS num, substr(ls,(i+1)::INT,1) AS ans FROM k, range(2) t(i) WHERE z-a+1=2 UNION ALL SELECT doc, seq, (a+40)::INT, 'C' FROM k
    UNION ALL SELECT doc, seq, num::INT, ans FROM d UNION ALL SELECT doc, seq, (num+1)::INT, 'BD' FROM d""")
def _(v):
    n, s = F.col("num"), lambda x: x.cast("string")
    rng = F.concat(s(n + 1), F.lit("-"), s(F.when(F.col("seq") % 3 == 0, n + 3).otherwise(n + 2)), F.lit("："), F.col("ans"), F.lit("B "), s(n + 41), F.lit(": C"))
    dot = F.concat(s(n), F.lit("."), F.col("ans"), F.lit(" "), s(n + 1), F.lit("、BD"))
    return S.answer_key_expand(v.qblocks.where("kind = 'a'").select("doc", "seq", F.when(F.col("seq") % 2 == 0, rng).otherwise(dot).alias("text")))


@query("answer_key_attach", """WITH q AS (SELECT doc, seq, num, CASE WHEN seq%5=0 THEN ans END AS a, sum(CASE WHEN num>p THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY seq) AS sec FROM (SELECT *, lag(num) OVER (PARTITION BY doc ORDER BY seq) AS p FROM v_qblocks WHERE kind='q')),
    k AS (SELECT doc, seq, n AS num, ans FROM v_qblocks, range(20) t(n) WHERE kind='a' AND n%2=num%2), w AS (SELECT k.doc, k.seq, k.num, k.ans, q.sec FROM (SELECT * FROM k) k ASOF JOIN q ON q.doc=k.doc AND k.seq>=q.seq)
    SELECT q.doc, q.seq, arg_min(w.ans, w.seq) AS ans, min(w.seq) AS k_seq FROM q JOIN w ON w.doc=q.doc AND w.sec=q.sec AND w.num=q.num AND w.seq>q.seq AND w.seq-q.seq<=600 WHERE a IS NULL GROUP BY 1,2""")
def _(v):
    q = v.qblocks.where("kind = 'q'").select("doc", "seq", "num", F.when(F.col("seq") % 5 == 0, F.col("ans")).alias("ans"))
    n = F.explode(F.filter(F.sequence(F.lit(0).cast("bigint"), F.lit(19).cast("bigint")), lambda x: x % 2 == F.col("num") % 2)).alias("n")
    k = v.qblocks.where("kind = 'a'").select("doc", "seq", n, "ans").withColumnRenamed("n", "num")
    return S.answer_key_attach(q, k)


#: One sentence per form of a conclusion around the answer's letter, and what is read out of it.
CONCLUSIONS = [("解析……因此正确答案为{a}。下一题故选B", "{a}"), ("{a}。清明是节气", "{a}"), ("综上，本题选AC项", "AC"), ("没有结论", ""), ("故选择{a}项。", "{a}"), ("60/500秒{a}。", "{a}"),
               ("两式相减得{a}选项。", "{a}"), ("计算后，选{a}，其余略", "{a}"), ("该题的答案为【{a}】", "{a}"), ("相比之下{a}项最为贴切", "{a}"), ("推理可知{a}项当选", "{a}"), ("判断后选【BD】", "BD"),
               ("只有{a}项符合要求", "{a}"), ("{a}选项说的是另一回事，当选", "{a}"), ("对应{a}选项，其余不合", "{a}"), ("最优选项是{a}", "{a}"), ("答案看来应是{a}", "{a}"), ("容易选{a}。", ""), ("权衡之后选{a}更好！", "{a}"), ("A项、B项和C项都不能误选{a}。", "")]


def _one_of(texts, by):
    return F.element_at(F.array(*[F.replace(F.lit(t), F.lit("{a}"), F.col("ans")) for t in texts]), (by + 1).cast("int"))


@query("answer_from_prose", f"""SELECT doc, seq, CASE num {' '.join(f"WHEN {i} THEN replace('{w}','{{a}}',ans)" for i, (_, w) in enumerate(CONCLUSIONS))} END AS prose,
    CASE num%3 WHEN 0 THEN ans WHEN 1 THEN CASE WHEN ans='D' THEN 'D' ELSE '' END ELSE '' END AS judged FROM v_qblocks""")
def _(v):
    a = F.col("ans")
    j = F.col("num") % 3
    said = (F.when(j == 0, F.concat(a, F.lit("项正确，其余略"))).when(j == 1, F.when(a == "D", F.lit("A、B两项错误，C项排除")).otherwise(F.lit("A项错误"))).otherwise(F.lit("B项正确，B项错误")))
    letters = F.array(*[F.lit(x) for x in "ABCD"])
    text = _one_of([t for t, _ in CONCLUSIONS], F.col("num"))
    return v.qblocks.select("doc", "seq", S.prose_answer(text).alias("prose"), S.judged_answer(F.col("text"), letters, said, negative="zzz").alias("judged"))


#: The same for explanations option by option, and for the last sentence of an explanation.
CHOSEN = [("A项：无关\n{a}项：与文意相符，当选", "{a}"), ("A项：当选。B项：当选", ""), ("{a}项：排除", ""), ("{a}项：同上，当选；{a}项：当选", "{a}")]
CLOSINGS = [("B项错误。故正确答案为 {a}。【拓展】故正确答案为 C。", "{a}"), ("答案为C。细说如下，因此答案选{a}项。", "{a}"), ("……本题选{a}，略", "{a}"), ("答案是C，这一点要展开来说，" + "说" * 40, "")]


@query("answer_from_closing", f"""SELECT doc, seq, CASE num%4 {' '.join(f"WHEN {i} THEN replace('{w}','{{a}}',ans)" for i, (_, w) in enumerate(CHOSEN))} END AS chosen,
    CASE num%4 {' '.join(f"WHEN {i} THEN replace('{w}','{{a}}',ans)" for i, (_, w) in enumerate(CLOSINGS))} END AS closing FROM v_qblocks""")
def _(v):
    m = F.col("num") % 4
    return v.qblocks.select("doc", "seq", S.chosen_answer(_one_of([t for t, _ in CHOSEN], m)).alias("chosen"), S.closing_answer(_one_of([t for t, _ in CLOSINGS], m)).alias("closing"))


@query("card_extract", """WITH l AS (SELECT doc, seq, unnest(regexp_extract_all(text,'([A-Z][a-zà-ÿ]{3,})( [a-zà-ÿ]+)')) AS m FROM v_blocks), c AS (SELECT doc, split_part(m,' ',1) AS front, split_part(m,' ',2) AS back FROM l),
    n AS (SELECT doc FROM c GROUP BY doc HAVING count(*)>=30) SELECT DISTINCT doc, front, back FROM c WHERE doc IN (SELECT doc FROM n)""")
def _(v):
    d = v.documents.select(F.col("doc_id").alias("doc"), "text")
    c = S.card_extract(d, [r"([A-Z][a-zà-ÿ]{3,})( [a-zà-ÿ]+)", r"(\d+)(->.*)"])
    return c.where("length(back) <= 20").select("doc", "front", "back").unionByName(c.where("length(back) > 20").select("doc", "front", "back"))


@query("deck_cards", f"""WITH x AS (SELECT doc_id AS doc, unnest(w) AS x, unnest(range(len(w))) AS p FROM (SELECT doc_id, regexp_extract_all(text,'[{T.LATIN}]+') AS w FROM documents)),
    g AS (SELECT doc, p//3 AS i, max(x) FILTER (p%3=0) AS a, max(x) FILTER (p%3=1) AS b, max(x) FILTER (p%3=2) AS c FROM x GROUP BY 1,2 HAVING count(*)=3),
    k AS (SELECT doc, i, CASE doc%3 WHEN 0 THEN a||' '||b ELSE a END AS front, CASE doc%3 WHEN 0 THEN substr(c,1,60) ELSE b||' '||c END AS back FROM g
      WHERE CASE doc%3 WHEN 0 THEN length(a||' '||b) BETWEEN 4 AND 160 WHEN 1 THEN length(a) BETWEEN 2 AND 14 ELSE length(a) BETWEEN 2 AND 4 AND length(b||' '||c) BETWEEN 2 AND 200 END),
    n AS (SELECT *, (row_number() OVER (PARTITION BY doc ORDER BY i)-1)::INT AS pos FROM k), d AS (SELECT doc, front, min(pos) AS pos, arg_min(back,pos) AS back FROM n GROUP BY doc, front, substr(back,1,20))
    SELECT * FROM d QUALIFY count(*) OVER (PARTITION BY doc)>=30""")
def _(v):
    """Three words of a text make a line of a deck, written in one of three ways."""
    w = F.regexp_extract_all("text", F.lit(f"([{T.LATIN}]+)"), F.lit(1))
    at = lambda i, k: F.get(F.col("w"), i * 3 + k)
    n = lambda i: (i + 1).cast("string")
    line = lambda i: (F.when(F.col("doc") % 3 == 0, F.concat(n(i), F.lit(". "), at(i, 0), F.lit(" "), at(i, 1), F.lit("->"), at(i, 2), F.lit(",")))
                      .when(F.col("doc") % 3 == 1, F.concat(n(i % 9999), F.lit("、"), at(i, 0), F.lit("："), at(i, 1), F.lit(" "), at(i, 2)))
                      .otherwise(F.concat(at(i, 0), F.lit("："), at(i, 1), F.lit(" "), at(i, 2))))
    d = v.documents.select(F.col("doc_id").alias("doc"), w.alias("w"))
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.size("w") / 3).cast("int") - 1), line), "\n")
    return K.deck_cards(d.select("doc", F.when(F.size("w") >= 3, text).alias("text")), T.LATIN)


@query("passage_keys", """WITH b AS (SELECT doc, seq, kind, num, row_number() OVER (PARTITION BY doc ORDER BY seq) AS i, min(CASE WHEN kind='h' THEN seq END) OVER (PARTITION BY doc ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS k_seq FROM v_qblocks),
    q AS (SELECT *, row_number() OVER (PARTITION BY doc, k_seq, num ORDER BY seq DESC) AS r FROM b WHERE kind='q' AND i>1 AND k_seq IS NOT NULL)
    SELECT doc, seq, k_seq, substr('ABCD',((num+k_seq)%4+1)::INT,1) AS ans, concat('note ',num) AS note FROM q WHERE r=1 AND seq%5<>0""")
def _(v):
    """Every heading stands for an answer line that gives all twenty numbers; every fifth question is answered already."""
    pair = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.concat(i.cast("string"), F.lit("-"), F.substr(F.lit("ABCD"), ((i + F.col("seq")) % 4 + 1).cast("int"), F.lit(1)),
                                                                           F.lit(" note "), i.cast("string")))
    text = F.when(F.col("kind") == "h", F.concat(F.lit("第7篇 "), F.array_join(pair, "  "))).otherwise(F.col("text"))
    b = v.qblocks.select("doc", "seq", F.when(F.col("kind") == "h", "box").otherwise(F.col("kind")).alias("kind"), text.alias("text"), F.col("num").cast("string").alias("num"),
                         F.lit("ABCD").alias("letters"), F.when(F.col("seq") % 5 == 0, F.col("ans")).alias("ans"))
    return K.passage_keys(b)


@query("snippet_extract")
def _(v):
    good = n_().between(30, 400) & F.col("text").rlike(r"\.$")
    out = S.snippet_extract(v.blocks, [("tion", "phrase"), ("the|les", "quote")], "material", good, levels=(1, 2, 3), attrib=r"^(.*\.) (\w{1,12}\.)$", quote_types=("quote",))
    return out.select("doc", "seq", "type", "path", F.md5("text").alias("h"), "note")


@query("sentence_split_policy", """WITH s AS (SELECT doc_id AS doc, (unnest(range(len(string_split(text,'.')))))::INT AS pos, trim(unnest(string_split(text,'.'))) AS text FROM documents),
    k AS (SELECT *, list_filter(string_split(text,', '), lambda x: x<>'') AS p FROM s WHERE length(text) BETWEEN 10 AND 90 AND len(regexp_extract_all(text,'[0-9]'))<=4 AND NOT regexp_matches(text,'sch'))
    SELECT doc, pos, CASE WHEN regexp_matches(text,'^(De|The|En)') THEN 'phrase' ELSE 'quote' END AS type, text FROM k WHERE regexp_matches(text,'^(De|The|En)') OR (length(text)<=60 AND len(p)=2 AND abs(length(p[1])-length(p[2]))<=2)""")
def _(v):
    return S.sentence_split(v.documents.select(F.col("doc_id").alias("doc"), "text"), "^(De|The|En)", "sch", r"\.", couplet=60, comma=", ", tail="$^")


def _days(v):
    w = F.regexp_extract_all("text", F.lit(f"([{L}]{{4,}})"), F.lit(1))
    word = lambda i: F.coalesce(F.get(F.col("w"), F.lit(i)), F.lit("none"))
    d = v.documents.select(F.col("doc_id").alias("day"), w.alias("w"))
    text = F.concat(F.lit("1、 first "), word(0), F.lit(" and "), word(1), F.lit("\n(1) "), word(0), F.lit(": meaning one\n2、 second "), word(2), F.lit(" only\n(2) "),
                    word(2), F.lit("：meaning two"))
    return d.select("day", text.alias("text"), "w")


WD = f"w AS (SELECT doc_id AS day, regexp_extract_all(text,'[{L}]{{4,}}') AS w FROM documents), x AS (SELECT day, coalesce(w[1],'none') AS w0, coalesce(w[2],'none') AS w1, coalesce(w[3],'none') AS w2 FROM w)"


@query("daily_words_sentences", f"""WITH {WD}, s AS (SELECT day, 1 AS n, concat('first ',w0,' and ',w1) AS text, w0, w2 FROM x UNION ALL SELECT day, 2, concat('second ',w2,' only'), w0, w2 FROM x)
    SELECT day, n, text, concat_ws(',', CASE WHEN contains(text,w0) THEN w0 END, CASE WHEN contains(text,w2) THEN w2 END) AS words FROM s""")
def _(v):
    s, _w = S.daily_words(_days(v))
    return s.withColumn("words", jl("words"))


@query("daily_words_meanings", f"WITH {WD} SELECT day, 1 AS n, w0 AS word, 'meaning one' AS meaning FROM x UNION ALL SELECT day, 2, w2, 'meaning two' FROM x")
def _(v):
    return S.daily_words(_days(v))[1]


@query("column_roles", """WITH c AS (SELECT l_returnflag AS grp, UNNEST([{'col':'flag','v':l_returnflag},{'col':'line','v':l_linenumber::VARCHAR},{'col':'note','v':concat('note ',l_linestatus,CASE WHEN l_linenumber>3 THEN ' 排除' ELSE '' END)},{'col':'part','v':concat('part ',l_partkey)},{'col':'ship','v':strftime(l_shipdate,'%Y-%m-%d')}]) AS u FROM lineitem),
    s AS (SELECT grp, u.col AS col, count(*)::DOUBLE AS n, sum(length(u.v)) AS len, count(*) FILTER (regexp_full_match(u.v,'[0-9]{1,4}'))/count(*)::DOUBLE AS num, count(*) FILTER (regexp_full_match(u.v,'[A-D]'))/count(*)::DOUBLE AS ans,
      count(*) FILTER (contains(u.v,'排除'))/count(*)::DOUBLE AS exp, count(*) FILTER (regexp_matches(u.v,'^(19|20)[0-9][0-9]'))/count(*)::DOUBLE AS src FROM c GROUP BY 1,2),
    r AS (SELECT grp, arg_max(col,(num,col)) FILTER (num>=0.5) AS num, arg_max(col,(ans,col)) FILTER (ans>=0.5) AS ans, arg_max(col,(exp,col)) FILTER (exp>=0.3) AS exp, arg_max(col,(src,col)) FILTER (src>=0.5) AS src FROM s GROUP BY grp)
    SELECT r.grp, r.num, r.ans, r.exp, r.src, arg_max(s.col, (s.len, s.col)) FILTER (s.col NOT IN (coalesce(r.num,''),coalesce(r.ans,''),coalesce(r.exp,''),coalesce(r.src,''))) AS q FROM r JOIN s ON s.grp=r.grp GROUP BY 1,2,3,4,5""")
def _(v):
    c = lambda name, e: F.struct(F.lit(name).alias("col"), e.alias("value"))
    note = F.concat(F.lit("note "), "l_linestatus", F.when(F.col("l_linenumber") > 3, " 排除").otherwise(""))
    d = v.table("lineitem").select(F.col("l_returnflag").alias("grp"), F.explode(F.array(
        c("flag", F.col("l_returnflag")), c("line", F.col("l_linenumber").cast("string")), c("note", note), c("part", F.concat(F.lit("part "), "l_partkey")),
        c("ship", F.date_format("l_shipdate", "yyyy-MM-dd")))).alias("c")).select("grp", "c.*")
    return S.column_roles(d, by=["grp"])


@query("video_groups", """SELECT fid, regexp_replace(rel,'/[^/]*$','') AS folder, regexp_replace(list_extract(string_split(rel,'/'),-1),'[.]\\w+$','') AS name, coalesce(nullif(regexp_extract(rel,'/[^/0-9]*([0-9]{1,3})[^/]*$',1),'')::INT,999) AS ord,
    CASE WHEN regexp_matches(rel,'/en/') THEN 'english' WHEN regexp_matches(rel,'src1') THEN 'one' ELSE '' END AS course FROM v_files""")
def _(v):
    course = F.when(F.col("rel").rlike("/en/"), "english").when(F.col("rel").rlike("src1"), "one").otherwise("")
    return S.video_groups(v.files, course)


@query("letter_answer_attach", """WITH b AS (SELECT doc, seq, kind, ans, CASE WHEN kind='q' AND num%3=0 THEN 1 ELSE 0 END AS done FROM v_qblocks WHERE kind<>'h'),
    p AS (SELECT *, lag(kind) OVER w AS pk, lag(done) OVER w AS pd, lag(seq) OVER w AS ps FROM b WINDOW w AS (PARTITION BY doc ORDER BY seq)) SELECT doc, ps AS seq, ans FROM p WHERE kind='a' AND pk='q' AND pd=0""")
def _(v):
    b = v.qblocks.select("doc", "seq", "kind", F.when((F.col("kind") == "q") & (F.col("num") % 3 == 0), F.col("ans")).alias("ans"), F.col("ans").alias("l"))
    return S.letter_answers(b, F.when(F.col("kind") == "a", F.col("l")))


@query("manual_answer_overlay", """WITH q AS (SELECT doc, seq, md5(text) AS k, CASE WHEN seq%4=0 THEN ans END AS ans, CASE WHEN seq%7=0 THEN 'B' END AS own FROM v_qblocks WHERE kind='q'),
    m AS (SELECT md5(text) AS k, min(CASE WHEN length(text)%13=0 THEN 'E' ELSE 'C' END) AS a, min(concat('note ',length(text))) AS n, max(CASE WHEN length(text)%6=0 THEN 1 ELSE 0 END) AS nq FROM v_qblocks WHERE doc%2=0 GROUP BY 1)
    SELECT doc, seq, coalesce(ans, own, CASE WHEN coalesce(nq,0)=0 AND a<>'E' THEN a END) AS ans, CASE WHEN ans IS NULL THEN n END AS note, CASE WHEN ans IS NULL THEN coalesce(nq,0) ELSE 0 END::INT AS notq FROM q LEFT JOIN m USING (k)""")
def _(v):
    q = v.qblocks.where("kind = 'q'").select("doc", "seq", F.md5("text").alias("k"), F.when(F.col("seq") % 4 == 0, F.col("ans")).alias("ans"),
                                             F.when(F.col("seq") % 7 == 0, "so it is (B) here").alias("exp"), F.array(*[F.lit(x) for x in "ABCD"]).alias("letters"))
    m = v.qblocks.where("doc % 2 = 0").groupBy(F.md5("text").alias("k")).agg(
        F.min(F.when(n_() % 13 == 0, "E").otherwise("C")).alias("ans"), F.min(F.concat(F.lit("note "), n_().cast("string"))).alias("note"),
        F.max(F.when(n_() % 6 == 0, 1).otherwise(0)).alias("notq"))
    return S.manual_answer_overlay(q, m)


# ---- folds per document

@query("answer_attach_exact", """WITH e AS (SELECT doc, num, seq, kind, ans, sum(CASE kind WHEN 'q' THEN 1 ELSE -1 END) OVER w AS s FROM v_qblocks WHERE kind IN ('q','a') WINDOW w AS (PARTITION BY doc, num ORDER BY seq)),
    f AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY doc, num ORDER BY seq)) AS d FROM e), g AS (SELECT *, CASE kind WHEN 'q' THEN d ELSE d+1 END AS lv, kind='a' AND s<coalesce(min(s) OVER (PARTITION BY doc,num ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AND s<0 AS floor FROM f),
    h AS (SELECT doc, seq, ans, kind, lag(seq) OVER (PARTITION BY doc, num, lv ORDER BY seq) AS q_seq, lag(kind) OVER (PARTITION BY doc, num, lv ORDER BY seq) AS pk FROM g WHERE NOT floor)
    SELECT doc, seq, q_seq, ans FROM h WHERE kind='a' AND pk='q'""")
def _(v):
    d = v.qblocks.where("kind IN ('q', 'a')").select("doc", "seq", "kind", "num", F.when(F.col("kind") == "a", F.col("ans")).alias("ans"),
                                                     F.lit("ABCD").alias("letters"), F.lit(False).alias("table"))
    return P.attach_exact(d)


@query("anchor_chain")
def _(v):
    w = F.when(n_() % 3 == 0, 0.4).otherwise(1.0)
    d = v.qblocks.select("doc", "seq", (F.col("num") + 1).alias("num"), w.alias("w"), (F.col("kind") == "h").alias("section"))
    return P.fold_documents(d, ["seq"], P.anchor_chain, "doc bigint, seq bigint, num bigint")


@query("run_key_match")
def _(v):
    keys = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(19)), lambda i: F.concat(i.cast("string"), F.lit(":"), F.element_at(
        F.array(*[F.lit(x) for x in "ABCD"]), ((i + F.col("seq")) % 4 + 1).cast("int")))), ",")
    d = v.qblocks.where("kind IN ('q', 'a')").select("doc", "seq", F.when(F.col("kind") == "a", "k").otherwise("q").alias("kind"), "num",
        F.floor(F.col("seq") / 5).alias("page"), F.lit("ABCD").alias("letters"), F.when(F.col("kind") == "a", keys).otherwise("").alias("key"))
    return P.run_key_match(d)


@query("sequence_align")
def _(v):
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(f"([{L}]{{3,}})"), F.lit(1)))
    d = v.blocks.where("text <> ''").select("doc", "seq", F.when(F.col("seq") % 2 == 0, "a").otherwise("b").alias("side"), F.floor(F.col("seq") / 2).alias("idx"),
                                            F.size(words).alias("n"), F.substring("text", 1, 1).alias("label"), words.alias("tokens"))
    fold = lambda rows: P.sequence_align([r[1:] for r in rows])
    return P.fold_documents(d, ["seq"], fold, "doc bigint, idx_a bigint, idx_b bigint, score double")
