"""File sources: catalogs, incremental comparison, JSON banks, messy sheets, page texts, marked-up text."""
from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from studyloom.functions.text import one_space, squeeze, stable_id
from studyloom.session import materialize

# File types that are read, and names of ad pictures.
KNOWN_EXT = ("pdf", "docx", "doc", "pptx", "ppt", "xlsx", "xls", "txt", "md", "jpg", "jpeg", "png")
AD_NAMES = r"公众号|扫码|二维码|淘宝|店铺|加群"


def scan(spark, path, pattern="*"):
    """Catalog input from a folder tree: metadata columns only, file contents are pruned from the scan."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
            .select(F.col("path").alias("rel"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime")))


def file_catalog(files, exts=KNOWN_EXT, ads=AD_NAMES):
    """Known file types without ad pictures: id, name, extension, size, time."""
    name = F.element_at(F.split("rel", r"[/\\]"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return (files.select(stable_id(F.col("rel")).alias("id"), "rel", name.alias("name"), ext.alias("ext"), "size", "mtime")
            .where(F.col("ext").isin(list(exts)) & ~F.col("name").rlike(ads)))


def incremental_diff(old, new, key="rel", same=("mtime", "size")):
    """new / changed / unchanged / deleted for every key of two snapshots."""
    o = old.select(key, F.lit(1).alias("_o"), *[F.col(c).alias("_o_" + c) for c in same])
    n = new.select(key, F.lit(1).alias("_n"), *[F.col(c).alias("_n_" + c) for c in same])
    equal = reduce(lambda a, c: a & F.col("_o_" + c).eqNullSafe(F.col("_n_" + c)), same, F.lit(True))
    status = (F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "deleted").when(equal, "unchanged").otherwise("changed"))
    return o.join(n, key, "full").select(key, status.alias("status"))


def apply_diff(old, new, diff, key="rel"):
    """Rows of the new snapshot that must be rebuilt, and old rows that stay."""
    rebuild = new.join(diff.where("status IN ('new', 'changed')").select(key), key, "left_semi")
    keep = old.join(diff.where("status = 'unchanged'").select(key), key, "left_semi")
    return rebuild, keep


def rebuild(table, old, new, build, bad=None, key="rel", same=("mtime", "size")):
    """Bring a table of derived rows from one catalog to the next and return what was done with every key.

    ``table``: a ``KeyedTable`` dealt by ``key``. Only keys that are new or changed, or whose rows hold what the column condition ``bad`` finds (``repaired``), go through
    ``build(files)``; rows of deleted keys go. Ranges of keys without any of these are neither read nor written.
    """
    status = incremental_diff(old, new, key, same)
    if bad is not None:
        broken = table.read().where(bad).select(key).distinct().withColumn("_b", F.lit(1))
        now = F.when((F.col("status") == "unchanged") & F.col("_b").isNotNull(), "repaired").otherwise(F.col("status"))
        status = status.join(broken, key, "left").select(key, now.alias("status"))
    status = materialize(status)
    todo = new.join(status.where("status IN ('new', 'changed', 'repaired')").select(key), key, "left_semi")
    table.replace(status.where("status IN ('changed', 'deleted', 'repaired')").select(key), build(todo))
    return status


def read_json_banks(spark, paths, schema):
    """Bank files in the given order; ``prio`` is the place of the file in the list."""
    parts = [spark.read.schema(schema).option("multiLine", "true").json(p).withColumn("prio", F.lit(i)) for i, p in enumerate(paths)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def first_id_wins(rows, order=("prio",), id_col="id"):
    """One row per id, from the earliest file (then position)."""
    cols = [c for c in rows.columns if c != id_col]
    best = F.min_by(F.struct(*cols), F.struct(*order))
    return rows.groupBy(id_col).agg(best.alias("r")).select(id_col, "r.*")


# Canonical vacancy columns and the names sheets use for them, in order of preference.
COLUMN_ALIASES = {
    "code": ["职位代码", "职位编码", "职位编号", "岗位代码", "岗位编码"],
    "dept": ["部门名称", "招录机关", "招考单位", "招录单位", "单位名称", "主管部门"],
    "unit": ["用人司局", "用人单位", "内设机构", "具体用人单位"],
    "title": ["招考职位", "职位名称", "岗位名称", "职位"],
    "level": ["机构层级", "职位层级", "单位层级"],
    "region": ["工作地点", "工作地区", "地区", "所在地"],
    "count": ["招考人数", "招录人数", "招录名额", "招考名额", "录用人数"],
    "major": ["专业", "专业条件", "专业要求", "所学专业"],
    "edu": ["学历", "学历要求", "学历（学位）", "学历(学位)"],
    "degree": ["学位", "学位要求"],
    "politics": ["政治面貌"],
    "years": ["基层工作最低年限", "工作经历", "基层工作经历", "工作年限"],
    "project": ["服务基层项目工作经历", "服务基层项目"],
    "notes": ["备注", "其他条件", "其它条件", "其他资格条件"],
}


def harmonize(rows, aliases=COLUMN_ALIASES, head_rows=10, least=4):
    """Sheets ``(file, i, cells array)`` to canonical columns plus all original cells as a map ``raw``.

    The header is the row among the first ``head_rows`` with most known names (exact first, then contained), at least
    ``least``. It is one row per file, so it is joined to the file's rows as a small table. Total and note rows drop out.
    """
    fields = list(aliases)
    c = F.col("c")
    tests = []
    for k, names in enumerate(aliases.values()):
        exact = F.coalesce(*[F.when(c == n, a) for a, n in enumerate(names)])
        part = reduce(lambda x, y: x | y, [c.contains(n) for n in names])
        tests.append(F.when(part, F.struct(F.lit(k).alias("f"), exact.alias("exact"))))
    names = F.transform("cells", lambda x: squeeze(x)).alias("names")
    top = rows.where(F.col("i") < head_rows).select("file", "i", names)
    hits = (top.select("file", "i", F.posexplode("names").alias("j", "c")).select("file", "i", "j", F.explode(F.array_compact(F.array(*tests))).alias("t"))
            .groupBy("file", "i", "t.f").agg(F.min(F.when(F.col("t.exact").isNotNull(), F.struct("t.exact", "j"))).alias("e"), F.array_sort(F.collect_list("j")).alias("js")))
    per_row = hits.groupBy("file", "i").agg(F.array_sort(F.collect_list(F.struct("f", F.col("e.j").alias("e"), "js"))).alias("hs"))
    # a field without an exact name takes the first column that contains one and is not taken yet
    none = F.array().cast("array<struct<f:int,j:int>>")

    def take(got, h):
        free = F.filter(h["js"], lambda j: ~F.exists(got, lambda g: g["j"] == j))
        j = F.coalesce(h["e"], F.get(free, 0))
        return F.when(j.isNotNull(), F.array_append(got, F.struct(h["f"].alias("f"), j.alias("j")))).otherwise(got)
    chosen = per_row.select("file", "i", F.aggregate("hs", none, take).alias("got")).where(F.size("got") >= least)
    best = chosen.groupBy("file").agg(F.max_by(F.struct("i", "got"), F.struct(F.size("got").alias("k"), (-F.col("i")).alias("o"))).alias("h"))
    head = (best.select("file", F.col("h.i").alias("hi"), F.map_from_entries("h.got").alias("at"))
            .join(top.withColumnRenamed("i", "hi"), ["file", "hi"]))
    d = rows.join(head, "file").where(F.col("i") > F.col("hi"))
    val = [F.trim(F.coalesce(F.get(F.col("cells"), F.try_element_at("at", F.lit(k))), F.lit(""))).alias(f) for k, f in enumerate(fields)]
    d = d.select("file", "i", *val, F.map_from_entries(F.filter(
        F.transform(F.arrays_zip("names", "cells"), lambda x: F.struct(x["names"].alias("k"), x["cells"].alias("v"))),
        lambda x, i: (F.coalesce(x["k"], F.lit("")) != "") & (F.coalesce(x["v"], F.lit("")) != "")
        & ~F.array_contains(F.slice("names", i + 2, F.size("names") + 1), x["k"]))).alias("raw"))
    d = d.where(((F.col("title") != "") | (F.col("dept") != "")) & ((F.col("code") != "") | (F.col("count") != "")))
    n = F.coalesce(F.nullif(F.regexp_extract("count", r"(\d+)", 1), F.lit("")).try_cast("bigint"), F.lit(0))
    return d.withColumn("count", F.when(n > 0, n).otherwise(1))


def read_text_pages(spark, path, page_break="\f"):
    """Whole text files to one row per page."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return text_pages(t, "file", page_break)


def text_pages(texts, key, page_break):
    return texts.select(key, F.posexplode(F.split("text", page_break)).alias("page", "text")).select(key, "page", one_space(F.col("text")).alias("text"))


def html_blocks(pages, key, tags=("h1", "h2", "h3", "h4", "p", "li")):
    """Headings, paragraphs and list items of raw HTML in order; scripts, styles and comments are cut first."""
    any_tag = "|".join(tags)
    body = F.regexp_replace("html", r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", "")
    el = F.posexplode(F.regexp_extract_all(body, F.lit(rf"(?s)<(?:{any_tag})(?: [^>]*)?>.*?</(?:{any_tag})>"), F.lit(0))).alias("seq", "el")
    tag = F.regexp_extract("el", "^<([a-z0-9]+)", 1)
    text = F.trim(F.regexp_replace(F.regexp_replace("el", "<[^>]*>", ""), r"(?U)\s+", " "))
    d = pages.select(key, el).select(key, F.col("seq").cast("bigint").alias("seq"), tag.alias("tag"), text.alias("text"))
    return d.select(key, "seq", F.when(F.col("tag").startswith("h"), "h").otherwise("p").alias("kind"),
                    F.when(F.col("tag").startswith("h"), F.substring("tag", 2, 1).cast("int")).alias("level"), "text")


def markdown_blocks(texts, key):
    """Lines to blocks: '# ' to '#### ' headings, '| ' table rows, '@n' page marks (they apply to what follows)."""
    d = texts.select(key, F.posexplode(F.split("text", "\n")).alias("seq", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    mark = F.when(F.col("line").rlike(r"^@\d+$"), F.substring("line", 2, 20).cast("bigint"))
    w = W.partitionBy(key).orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("page", F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit(0))).where(~F.col("line").rlike(r"^@\d+$"))
    level = F.length(F.regexp_extract("line", r"^(#{1,4}) ", 1))
    kind = F.when(level > 0, "h").when(F.col("line").startswith("|"), "tbl").otherwise("p")
    return d.select(key, F.col("seq").cast("bigint").alias("seq"), kind.alias("kind"), F.when(level > 0, level).alias("level"), "page",
                    F.regexp_replace("line", r"^#{1,4} ", "").alias("text"))
