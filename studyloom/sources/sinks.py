"""Sinks and checked writes: partition replacement, series replacement, upserts, import rules, lint, table dumps."""
from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def replace_kind(df, path, kind="kind"):
    """Replace the partitions of the kinds in ``df`` and leave the others alone."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(kind).parquet(path)


def replace_series(table, fresh, prefix, id_col="id", seq="seq"):
    """Rows whose id has the prefix are replaced; new ones are numbered after the largest number left.

    The number of a new row is its place in the list, which arrives as ``ord``, so nothing is ranked.
    """
    kept = table.where(~F.col(id_col).startswith(prefix))
    last = kept.agg(F.coalesce(F.max(seq), F.lit(0))).scalar()
    return kept.unionByName(fresh.withColumn(seq, last + 1 + F.col("ord")).drop("ord"))


def upsert_by_key(current, incoming, key="id", replace=False):
    """Incoming rows win over current ones of the same key; ``replace`` forgets the current rows."""
    u = incoming.withColumn("_p", F.lit(0)) if replace else incoming.withColumn("_p", F.lit(0)).unionByName(current.withColumn("_p", F.lit(1)))
    cols = [c for c in incoming.columns if c != key]
    return u.groupBy(key).agg(F.min_by(F.struct(*cols), "_p").alias("r")).select(key, "r.*")


def import_validate(rows, materials, modules, order="ord", top=5):
    """The first broken rule of every bad row, first ``top`` rows in file order."""
    mats = materials.select(F.col("id").alias("material"), F.lit(1).alias("_m")).distinct()
    d = rows.join(mats, "material", "left")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    err = (F.when(blank("id") | blank("stem"), "id or stem missing").when(~F.coalesce(F.col("module").isin(list(modules)), F.lit(False)), "unknown module")
           .when(F.coalesce(F.size("options"), F.lit(-1)) != 4, "needs 4 options").when(~F.coalesce(F.col("answer").between(0, 3), F.lit(False)), "answer not 0-3")
           .when(F.col("material").isNotNull() & F.col("_m").isNull(), "material missing"))
    return d.select(order, "id", err.alias("error")).where("error IS NOT NULL").orderBy(order).limit(top)


def corpus_lint(blocks, questions, links, targets):
    """Violations of course texts as one table (doc, seq, rule).

    ``questions(doc, seq, letters, ans)``, ``links(doc, seq, target)``, ``targets(target)``.
    """
    w = W.partitionBy("doc").orderBy("seq")
    heads = blocks.where("kind = 'h'").withColumn("_p", F.coalesce(F.lag("level").over(w), F.lit(0)))
    jump = heads.where(F.col("level") > F.col("_p") + 1).select("doc", "seq", F.lit("depth jump").alias("rule"))
    letters = F.array_join("letters", "")
    rules = F.array_compact(F.array(
        F.when(F.col("ans").isNull(), "no answer"), F.when(F.size("letters") < 2, "too few options"),
        F.when(F.col("ans").isNotNull() & (F.size(F.array_except(F.filter(F.split("ans", ""), lambda x: x != ""), "letters")) > 0), "answer not an option"),
        F.when(letters != F.substring(F.lit("ABCDEFGH"), F.lit(1), F.size("letters")), "letters not in a row")))
    quiz = questions.select("doc", "seq", F.explode(rules).alias("rule"))
    dangling = links.join(targets.select("target").distinct(), "target", "left_anti").select("doc", "seq", F.lit("link without target").alias("rule"))
    opened = F.col("text").startswith(":::") & (F.length(F.trim("text")) > 3)
    closed = F.trim("text") == ":::"
    fences = blocks.where(opened | closed).withColumn("_o", opened).withColumn("_n", F.lead(opened).over(w))
    unclosed = fences.where(F.col("_o") & F.coalesce(F.col("_n"), F.lit(True))).select("doc", "seq", F.lit("block not closed").alias("rule"))
    return reduce(lambda a, b: a.unionByName(b), [jump, quiz, dangling, unclosed])


def dump_rows(tables, secrets=()):
    """All tables as (table, row JSON); listed (table, key, column) secrets are blanked."""
    parts = []
    for name, df in tables.items():
        for t, cond, col in secrets:
            if t == name:
                df = df.withColumn(col, F.when(cond, F.lit("")).otherwise(F.col(col)))
        parts.append(df.select(F.lit(name).alias("table"), F.to_json(F.struct(*df.columns)).alias("row")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def export_tables(tables, path, app, exam, secrets=()):
    """One JSON-lines folder per table and a manifest."""
    spark = next(iter(tables.values())).sparkSession
    dump_rows(tables, secrets).write.mode("overwrite").partitionBy("table").text(path + "/rows")
    spark.createDataFrame([(app, exam)], "app string, exam string").coalesce(1).write.mode("overwrite").json(path + "/manifest")


def load_rows(dump, table, schema):
    """Rows of a dumped table under a schema: columns it does not have are NULL, columns it does not know are ignored."""
    return dump.where(F.col("table") == table).select(F.from_json("row", schema).alias("r")).select("r.*")


def import_tables(spark, path, schemas, app, exam):
    """Read a dump back; a dump of another application or exam is refused."""
    m = spark.read.json(path + "/manifest").first()
    if m["app"] != app or m["exam"] != exam:
        raise ValueError(f"dump belongs to {m['app']}/{m['exam']}")
    dump = spark.read.schema(T.StructType([T.StructField("value", T.StringType()), T.StructField("table", T.StringType())])).text(
        path + "/rows").withColumnRenamed("value", "row")
    return {t: load_rows(dump, t, s) for t, s in schemas.items()}
