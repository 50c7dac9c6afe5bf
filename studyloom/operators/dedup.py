"""Dedup of rows by keys: who stays is always one ordered aggregate, so a group of copies never meets in one task."""
from pyspark.sql import functions as F

from studyloom.functions.text import CJK, only


def dedup_key(stem, explain, keep=CJK):
    """'s:' + first 40 letters of the stem when it has 12, else 'e:' + first 50 of the explanation when it has 20, else NULL."""
    s, e = only(stem, keep), only(explain, keep)
    return (F.when(F.length(s) >= 12, F.concat(F.lit("s:"), F.substring(s, 1, 40)))
            .when(F.length(e) >= 20, F.concat(F.lit("e:"), F.substring(e, 1, 50))))


def keyed(rows, key, id_col="id"):
    """Rows without a key are kept: the id stands in for it."""
    return rows.withColumn("_k", F.coalesce(key, F.concat(F.lit("#"), F.col(id_col).cast("string"))))


def keep_best(rows, key, score, order, id_col="id"):
    """Id of the row with the highest ``score`` columns per key, the earliest wins ties; with the number of copies."""
    best = F.max_by(F.col(id_col), F.struct(*score, (-F.col(order)).alias("_o")))
    return keyed(rows, key, id_col).groupBy("_k").agg(best.alias(id_col), F.count("*").alias("copies")).drop("_k")


def keep_first(rows, key, order, id_col="id"):
    return keyed(rows, key, id_col).groupBy("_k").agg(F.min_by(id_col, order).alias(id_col), F.count("*").alias("copies")).drop("_k")


def replace_if_better(rows, key, order, whole, figure, id_col="id"):
    """First row per key, unless its options are broken and a later whole copy (no figure question) exists.

    ``pos`` is the place of the first row, which the replacement takes over.
    """
    first = F.min(F.struct(F.col(order).alias("o"), F.col(id_col).alias("id"), whole.alias("whole")))
    better = F.min(F.when(whole & ~figure, F.struct(F.col(order).alias("o"), F.col(id_col).alias("id"))))
    g = keyed(rows, key, id_col).groupBy("_k").agg(first.alias("f"), better.alias("b"))
    return g.select(F.when(F.col("f.whole"), F.col("f.id")).otherwise(F.coalesce("b.id", "f.id")).alias(id_col), F.col("f.o").alias("pos"))


def exact_copies(files):
    """Per (size, extension, pages): the file in the deepest folder with the shortest name stays."""
    depth = F.size(F.split("rel", "/"))
    name = F.length(F.element_at(F.split("rel", "/"), -1))
    pick = F.min_by("fid", F.struct((-depth).alias("a"), name.alias("b"), F.col("rel")))
    return files.groupBy("size", "ext", "pages").agg(pick.alias("fid"), F.count("*").alias("copies"))


def best_version(files, key, order):
    """First file per key by a list of ordering columns (smaller is better)."""
    return files.groupBy(key.alias("k")).agg(F.min_by("fid", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("fid"))


def superseded(files, weaker, stronger, on):
    """Files of the weaker kind whose key also has one of the stronger kind."""
    return files.where(weaker).join(files.where(stronger).select(*on).distinct(), list(on), "left_semi")


def minus_seen(rows, seen, key):
    return rows.withColumn("_k", key).join(seen, "_k", "left_anti").drop("_k")


def covers(sets, other):
    """Share of every set's items that the other set holds. ``sets(id, item)`` distinct, ``other(item)`` distinct."""
    hit = other.withColumn("_h", F.lit(1))
    return (sets.join(hit, "item", "left").groupBy("id")
            .agg(F.bround(F.sum(F.coalesce("_h", F.lit(0))) / F.count("*"), 4).alias("share"), F.count("*").alias("items")))


def memo_dup(items):
    """Same content is stored once per book: the first id stays. Contents meet by hash, not as long texts."""
    return (items.groupBy("book", F.sha2(F.trim("content"), 256).alias("h")).agg(F.min("id").alias("id"), F.count("*").alias("copies")).drop("h"))


def repeat_paragraphs(blocks, keep_class, para=80, table=12, exempt=None):
    """Blocks to keep: later copies of a long paragraph (or table) of the same document go, question-like text stays.

    The text is compared by the hash of its whole key.
    """
    k = only(F.col("text"), keep_class)
    big = F.length(k) >= F.when(F.col("kind") == "tbl", table).otherwise(para)
    if exempt is not None:
        big = big & ~F.col("text").rlike(exempt)
    key = F.when(big, F.md5(k)).otherwise(F.concat(F.lit("#"), F.col("seq").cast("string")))
    return blocks.groupBy("doc", key.alias("k")).agg(F.min("seq").alias("seq")).select("doc", "seq")
