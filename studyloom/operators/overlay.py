"""Small projections: corrections over originals, settings, secrets, bands."""
from pyspark.sql import functions as F


def override_overlay(rows, fixes, fields, key="id"):
    """Corrections cover the original fields where they are not NULL; what they cover stays in ``orig_<field>``."""
    f = fixes.select(key, F.lit(True).alias("_has"), *[F.col(c).alias("_" + c) for c in fields])
    out = rows.join(f, key, "left")
    for c in fields:
        out = out.withColumn("orig_" + c, F.when(F.col("_" + c).isNotNull(), F.col(c)))
        out = out.withColumn(c, F.coalesce("_" + c, c))
    return out.withColumn("fixed", F.coalesce(F.col("_has"), F.lit(False)).cast("int")).drop("_has", *["_" + c for c in fields])


def settings_clamp(text, default, lo, hi):
    """A number kept inside [lo, hi]; the default when the text is empty or no number."""
    x = F.trim(text).try_cast("double")
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(float(min(hi, max(lo, default))))).when(x.isNull(), F.lit(float(default))).otherwise(
        F.least(F.lit(float(hi)), F.greatest(F.lit(float(lo)), x)))


def mask_secret(c):
    return (F.when(F.coalesce(c, F.lit("")) == "", "").when(F.length(c) > 8, F.concat(F.substring(c, 1, 3), F.lit("****"), F.right(c, F.lit(4))))
            .otherwise("****"))


def speech_band(cpm, slow=150, fast=260):
    return F.when(cpm < slow, "slow").when(cpm > fast, "fast").otherwise("normal")


def lookup_default(rows, names, key, name, default):
    return rows.join(names.select(key, name), key, "left").withColumn(name, F.coalesce(name, F.lit(default)))
