"""Queries over near-duplicates and overlapping sets."""
from pyspark.sql import functions as F

from studyloom.functions import text as T
from studyloom.operators import nearcopies as N
from studyloom.plans.registry import query

L = T.LATIN

SIG = f"""d AS (SELECT doc_id AS doc, n_chars, doc_id%7 AS sc, regexp_replace(text,'[^{L}]','','g') AS t FROM documents WHERE n_chars>500),
    c AS (SELECT doc, string_split(t,'') AS c FROM d), g AS (SELECT doc, unnest(list_distinct(list_filter(list_transform(range(1,len(c)-7), lambda i: ('0x'||substr(md5(c[i]||c[i+1]||c[i+2]||c[i+3]||c[i+4]||c[i+5]||c[i+6]||c[i+7]),1,8))::BIGINT), lambda h: h%16=0))) AS h FROM c),
    z AS (SELECT doc, count(*) AS size FROM g GROUP BY doc), m AS (SELECT d.doc, n_chars, sc, length(t) AS n, size FROM d JOIN z USING (doc)),
    ov AS (SELECT a.doc AS a, b.doc AS b, count(*) AS k FROM g a JOIN g b ON a.h=b.h AND a.doc<b.doc GROUP BY 1,2),
    pr AS (SELECT a, b FROM ov JOIN m x ON x.doc=a JOIN m y ON y.doc=b WHERE k>=0.9*least(x.size,y.size) AND greatest(x.n,y.n)<=least(x.n,y.n)*1.12 AND CASE WHEN x.n<=y.n THEN x.size ELSE y.size END>=20)"""


def _sigs(v):
    d = v.documents.where("n_chars > 500").select(F.col("doc_id").alias("doc"), "text", "n_chars")
    return N.signatures(d, L, hash_of=N.md5_hash)


@query("shingle_signatures", "WITH " + SIG + " SELECT doc, n::INT AS n_letters, size::INT AS size FROM m")
def _(v):
    # a filter on the size would be put ahead of the signatures, which would be computed for it once more
    return _sigs(v).select("doc", "n_letters", F.explode(F.filter(F.array(F.size("sig")), lambda n: n > 0)).alias("size"))


@query("near_duplicates", "WITH RECURSIVE " + SIG + """, e AS (SELECT a AS x, b AS y FROM pr UNION ALL SELECT b, a FROM pr),
    p AS (SELECT e.x, arg_max(e.y, (my.sc, my.n_chars, -my.n, -e.y)) AS y FROM e JOIN m mx ON mx.doc=e.x JOIN m my ON my.doc=e.y WHERE (my.sc, my.n_chars, -my.n, -e.y) > (mx.sc, mx.n_chars, -mx.n, -e.x) GROUP BY e.x),
    r AS (SELECT x, y, 1 AS i FROM p UNION ALL SELECT r.x, p.y, i+1 FROM r JOIN p ON p.x=r.y) SELECT x AS doc, arg_max(y,i) AS keep FROM r GROUP BY x""")
def _(v):
    return N.near_duplicates(_sigs(v), [F.col("doc") % 7, F.col("n_chars")])


DECK = """s AS (SELECT DISTINCT doc AS id, trim(text) AS item FROM v_qblocks WHERE length(trim(text))>0), z AS (SELECT id, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, id) AS i FROM s GROUP BY id),
    e AS (SELECT x.i AS i, y.i AS j FROM (SELECT a.id AS a, b.id AS b, count(*) AS k FROM s a JOIN s b ON a.item=b.item AND a.id<>b.id GROUP BY 1,2) JOIN z x ON x.id=a JOIN z y ON y.id=b WHERE y.i<x.i AND k>0.5*least(x.size,y.size)),
    el AS (SELECT i, list(j) AS js FROM e GROUP BY i)"""


@query("deck_overlap", "WITH RECURSIVE " + DECK + """, r AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL SELECT r.i+1, CASE WHEN el.js IS NULL OR NOT list_has_any(el.js, r.kept) THEN list_append(r.kept, r.i+1) ELSE r.kept END
    FROM r LEFT JOIN el ON el.i=r.i+1 WHERE r.i<(SELECT count(*) FROM z)) SELECT id FROM z WHERE i IN (SELECT unnest(kept) FROM r WHERE i=(SELECT count(*) FROM z))""")
def _(v):
    t = F.trim("text")
    return N.deck_overlap(v.qblocks.where(F.length(t) > 0).select(F.col("doc").alias("id"), t.alias("item")))
