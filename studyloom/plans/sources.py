"""Queries over sources and sinks."""
from pyspark.sql import functions as F

from studyloom.plans.registry import query
from studyloom.sources import files as S
from studyloom.sources import sinks as K

NAME = "list_extract(string_split(rel,'/'),-1)"


@query("file_catalog", f"""SELECT substr(md5(rel),1,12) AS id, {NAME} AS name, lower(regexp_extract({NAME},'[.]([A-Za-z0-9]+)$',1)) AS ext, size, mtime FROM v_files
    WHERE lower(regexp_extract({NAME},'[.]([A-Za-z0-9]+)$',1)) IN ('pdf','docx','md') AND NOT regexp_matches({NAME},'77')""")
def _(v):
    return S.file_catalog(v.files, ("pdf", "docx", "md"), "77").drop("rel")


@query("incremental_diff", """SELECT coalesce(o.rel,n.rel) AS rel, CASE WHEN o.rel IS NULL THEN 'new' WHEN n.rel IS NULL THEN 'deleted' WHEN o.mtime=n.mtime AND o.size=n.size THEN 'unchanged' ELSE 'changed' END AS status
    FROM (SELECT concat(fid,':',rel) AS rel, mtime, size FROM v_files WHERE fid%19<>0) o FULL JOIN (SELECT concat(fid,':',rel) AS rel, mtime, size FROM v_files_next) n ON o.rel=n.rel""")
def _(v):
    key = lambda d: d.withColumn("rel", F.concat(F.col("fid").cast("string"), F.lit(":"), "rel"))
    return S.incremental_diff(key(v.files.where("fid % 19 <> 0")), key(v.files_next))


@query("incremental_apply", """SELECT fid, 'rebuild' AS what FROM v_files_next WHERE fid%10=0 UNION ALL SELECT fid, 'keep' FROM v_files_next WHERE fid%10<>0""")
def _(v):
    old, new = v.files, v.files_next
    rebuild, keep = S.apply_diff(old, new, S.incremental_diff(old, new, "fid"), "fid")
    return rebuild.select("fid", F.lit("rebuild").alias("what")).unionByName(keep.select("fid", F.lit("keep").alias("what")))


@query("incremental_rebuild", """SELECT doc, seq, CASE WHEN doc%10=1 THEN text||'!' ELSE text END AS text FROM v_blocks WHERE doc%10<>2""")
def _(v):
    """Blocks of documents after the next catalog: some documents are new, changed or gone, some rows hold a bad glyph."""
    import uuid

    from studyloom.session import checkpoint_dir
    from studyloom.sources.keyed import KeyedTable
    d, by = F.col("doc"), F.col("doc") % 10
    blocks = v.blocks.select("doc", "seq", "text")
    size = v.table("documents").agg(F.sum(F.octet_length("text"))).first()[0]
    table = KeyedTable(v.spark, f"{checkpoint_dir(v.spark)}/blocks-{uuid.uuid4().hex}", ["doc"], KeyedTable.ranges_for(size))
    before = blocks.where(by != 3).withColumn("text", F.when((by == 4) & (F.col("seq") == 0), F.concat("text", F.lit("\ufffd"))).otherwise(F.col("text")))
    table.replace(before.select("doc").distinct(), before)
    docs = v.documents.select(F.col("doc_id").alias("doc"), F.length("text").alias("size")).withColumn("mtime", F.lit(0))
    new = docs.where(by != 2).withColumn("mtime", F.when(by == 1, 1).otherwise(0))
    fresh = blocks.withColumn("text", F.when(by == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    S.rebuild(table, docs.where(by != 3), new, lambda files: fresh.join(files.select("doc"), "doc", "left_semi"), F.contains("text", F.lit("\ufffd")), "doc")
    return table.read().select(d, "seq", "text")


BANKS = """WITH u AS (SELECT id%1200 AS id, stem, 0 AS prio, id AS pos FROM v_bank WHERE src='real' UNION ALL SELECT id%900, stem, 1, id FROM v_bank WHERE src='builtin' UNION ALL SELECT id, stem, 2, id FROM v_bank WHERE src='book') """


def _banks(v):
    b = v.bank
    return (b.where("src = 'real'").select((F.col("id") % 1200).alias("id"), "stem", F.lit(0).alias("prio"), F.col("id").alias("pos"))
            .unionByName(b.where("src = 'builtin'").select((F.col("id") % 900).alias("id"), "stem", F.lit(1).alias("prio"), F.col("id").alias("pos")))
            .unionByName(b.where("src = 'book'").select("id", "stem", F.lit(2).alias("prio"), F.col("id").alias("pos"))))


@query("json_bank_load", BANKS + "SELECT id, arg_min(stem,(prio,pos)) AS stem, min(prio) AS prio FROM u GROUP BY id")
def _(v):
    return S.first_id_wins(_banks(v), ("prio", "pos")).select("id", "stem", "prio")


@query("column_alias_harmonize", """SELECT p_brand AS file, p_partkey::VARCHAR AS code, p_type AS dept, p_name AS title, CASE WHEN p_size%9=0 THEN 1 ELSE p_size END::BIGINT AS count, CASE WHEN p_partkey%2=0 THEN 4 ELSE 5 END AS cells FROM part WHERE p_brand<>'Brand#3'""")
def _(v):
    k = F.col("p_partkey").cast("string")
    size = F.when(F.col("p_size") % 9 == 0, F.lit("若干")).otherwise(F.concat(F.col("p_size").cast("string"), F.lit("人")))
    extra = F.when(F.col("p_partkey") % 2 == 0, "").otherwise("note")
    data = v.table("part").select(F.col("p_brand").alias("file"), (F.col("p_partkey") + 100).alias("i"), F.array("p_type", "p_name", size, k, extra).alias("cells"))
    # sheets with a title row, a header and a total row; one brand has no header that is recognised
    brands = v.table("part").select(F.col("p_brand").alias("file")).distinct()
    name = lambda a, b: F.when(F.length("file") % 2 == 0, a).otherwise(b)
    title = brands.select("file", F.lit(0).cast("bigint").alias("i"), F.array(F.lit("职位表")).alias("cells"))
    head = brands.where("file <> 'Brand#3'").select("file", F.lit(2).cast("bigint").alias("i"), F.array(
        name("部门名称", "招录 机关"), name("招考职位", "职位名称"), name("招考人数", "招录人数（人）"), name("职位代码", "岗位编码"), F.lit("说明")).alias("cells"))
    total = brands.select("file", F.lit(9000000).cast("bigint").alias("i"), F.array(F.lit("合计"), F.lit(""), F.lit("")).alias("cells"))
    rows = title.unionByName(head).unionByName(data).unionByName(total)
    return S.harmonize(rows).select("file", "code", "dept", "title", "count", F.size("raw").alias("cells"))


@query("text_pages", "SELECT doc_id, (unnest(range(len(string_split(text,chr(10))))))::INT AS page, trim(regexp_replace(unnest(string_split(text,chr(10))),'\\s+',' ','g')) AS text FROM documents")
def _(v):
    return S.text_pages(v.documents.select("doc_id", "text"), "doc_id", "\n")


@query("markup_blocks", """WITH b AS (SELECT page_id, regexp_replace(html,'(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->','','g') AS h FROM pages), e AS (SELECT page_id, regexp_extract_all(h,'(?s)<(?:h1|h2|h3|h4|p|li)(?: [^>]*)?>.*?</(?:h1|h2|h3|h4|p|li)>') AS l FROM b),
    x AS (SELECT page_id, unnest(range(len(l))) AS seq, unnest(l) AS el FROM e)
    SELECT page_id, seq, CASE WHEN starts_with(el,'<h') THEN 'h' ELSE 'p' END AS kind, CASE WHEN starts_with(el,'<h') THEN substr(el,3,1)::INT END AS level, trim(regexp_replace(regexp_replace(el,'<[^>]*>','','g'),'\\s+',' ','g')) AS text FROM x""")
def _(v):
    return S.html_blocks(v.table("pages"), "page_id")


@query("markdown_blocks", """WITH l AS (SELECT doc, seq*2 AS s, seq, text, kind, page FROM v_blocks WHERE trim(text)<>'') SELECT doc, seq*2+1 AS seq, CASE WHEN kind='h' THEN 'h' ELSE 'p' END AS kind, CASE WHEN kind='h' THEN (1+seq%4)::INT END AS level, page, trim(text) AS text FROM l""")
def _(v):
    line = F.concat(F.lit("@"), F.col("page").cast("string"), F.lit("\n"), F.when(F.col("kind") == "h", F.concat(F.repeat(F.lit("#"), (1 + F.col("seq") % 4).cast("int")), F.lit(" "))).otherwise(""), F.trim("text"))
    txt = v.blocks.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    return S.markdown_blocks(txt, "doc")


@query("replace_series", """SELECT concat('q-',id%3,'-',id) AS id, stem, num AS seq FROM v_bank WHERE id%3<>1 UNION ALL SELECT concat('q-1-n',id), stem, (SELECT max(num) FROM v_bank WHERE id%3<>1)+1+id FROM v_bank WHERE id%5=0""")
def _(v):
    t = v.bank.select(F.concat(F.lit("q-"), F.col("id") % 3, F.lit("-"), "id").alias("id"), "stem", F.col("num").alias("seq"))
    fresh = v.bank.where("id % 5 = 0").select(F.concat(F.lit("q-1-n"), "id").alias("id"), "stem", F.col("id").alias("ord"))
    return K.replace_series(t, fresh, "q-1-")


@query("upsert_by_key", """SELECT id, CASE WHEN id%4=0 THEN concat('new ',stem) ELSE stem END AS stem, answer FROM v_bank WHERE id%2=0 OR id%4=0 UNION ALL SELECT id+1000000, concat('new ',stem), answer FROM v_bank WHERE id%4=1""")
def _(v):
    cols = ["id", "stem", "answer"]
    current = v.bank.where("id % 2 = 0").select(*cols)
    new = F.concat(F.lit("new "), "stem").alias("stem")
    incoming = v.bank.where("id % 4 = 0").select("id", new, "answer").unionByName(v.bank.where("id % 4 = 1").select((F.col("id") + 1000000).alias("id"), new, "answer"))
    return K.upsert_by_key(current, incoming)


@query("import_validate", """SELECT id AS ord, id, CASE WHEN stem='' THEN 'id or stem missing' WHEN module NOT IN ('ECONOMY','SMALL','PROMO','LARGE','MEDIUM') THEN 'unknown module' WHEN id%11=3 THEN 'needs 4 options'
    WHEN a IS NULL OR a NOT BETWEEN 0 AND 3 THEN 'answer not 0-3' ELSE 'material missing' END AS error FROM (SELECT *, CASE WHEN id%17=0 THEN 7 ELSE answer END AS a FROM v_bank)
    WHERE stem='' OR module NOT IN ('ECONOMY','SMALL','PROMO','LARGE','MEDIUM') OR id%11=3 OR a IS NULL OR a NOT BETWEEN 0 AND 3 OR (material IS NOT NULL AND material%2=1) ORDER BY ord LIMIT 5""")
def _(v):
    opts = F.when(F.col("id") % 11 == 3, F.array(F.lit("a"))).otherwise(F.array(*[F.lit(x) for x in "abcd"]))
    rows = v.bank.select(F.col("id").alias("ord"), "id", "stem", "module", "material", opts.alias("options"), F.when(F.col("id") % 17 == 0, 7).otherwise(F.col("answer")).alias("answer"))
    mats = v.bank.where("material % 2 = 0").select(F.col("material").alias("id"))
    return K.import_validate(rows, mats, ["ECONOMY", "SMALL", "PROMO", "LARGE", "MEDIUM"])


@query("corpus_lint", """WITH h AS (SELECT doc, seq, level, coalesce(lag(level) OVER (PARTITION BY doc ORDER BY seq),0) AS p FROM v_blocks WHERE kind='h'), q AS (SELECT doc, seq, num, ans FROM v_qblocks WHERE kind='q')
    SELECT doc, seq, 'depth jump' AS rule FROM h WHERE level>p+1 UNION ALL SELECT doc, seq, 'no answer' FROM q WHERE num%7=0 UNION ALL SELECT doc, seq, 'too few options' FROM q WHERE num%5=0
    UNION ALL SELECT doc, seq, 'answer not an option' FROM q WHERE num%7<>0 AND ((num%5=0 AND ans<>'A') OR (num%5=1 AND ans='B')) UNION ALL SELECT doc, seq, 'letters not in a row' FROM q WHERE num%5=1
    UNION ALL SELECT doc, seq, 'link without target' FROM v_qblocks WHERE kind='h' AND doc+seq NOT IN (SELECT doc_id FROM labels)""")
def _(v):
    arr = lambda s: F.array(*[F.lit(x) for x in s])
    m = F.col("num") % 5
    q = v.qblocks.where("kind = 'q'").select("doc", "seq", F.when(m == 0, arr("A")).when(m == 1, arr("ACD")).otherwise(arr("ABCD")).alias("letters"), F.when(F.col("num") % 7 != 0, F.col("ans")).alias("ans"))
    links = v.qblocks.where("kind = 'h'").select("doc", "seq", (F.col("doc") + F.col("seq")).alias("target"))
    return K.corpus_lint(v.blocks, q, links, v.table("labels").select(F.col("doc_id").alias("target")))


@query("export_import_tables", """SELECT c_custkey AS id, CASE WHEN c_nationkey=3 THEN '' ELSE c_name END AS name, c_nationkey AS nation, NULL::VARCHAR AS added FROM customer""")
def _(v):
    t = {"customer": v.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("gone")),
         "region": v.table("region")}
    dump = K.dump_rows(t, [("customer", F.col("nation") == 3, "name")])
    return K.load_rows(dump, "customer", "id bigint, name string, nation int, added string")
