"""Ordered operations that stay parallel when one key holds a large share of the rows.

A window over such a key would run in one task. Here a key is cut into buckets of its (integer) order column; each bucket
is reduced to one row, the short list of buckets is scanned, and the result is carried into the rows of each bucket.
"""
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _bucket(order, width):
    return F.floor(F.col(order) / width).cast("bigint")


def running_last(df, keys, order, values, width=65536, name="prev"):
    """Struct of the last non-NULL ``values`` column at or before each row (``values`` is one struct or scalar column)."""
    d = df.withColumn("_b", _bucket(order, width))
    v = F.col(values)
    ends = d.groupBy(*keys, "_b").agg(F.max_by(v, F.when(v.isNotNull(), F.col(order))).alias("_e"))
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carry = ends.select(*keys, "_b", F.last("_e", ignorenulls=True).over(before).alias("_c"))
    here = W.partitionBy(*keys, "_b").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return (d.join(carry, [*keys, "_b"]).withColumn(name, F.coalesce(F.last(v, ignorenulls=True).over(here), "_c")).drop("_b", "_c"))


def row_numbers(df, keys, order, width=65536, name="rn"):
    """Row number per key in the order of a unique integer column."""
    d = df.withColumn("_b", _bucket(order, width))
    sizes = d.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offs = sizes.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    here = W.partitionBy(*keys, "_b").orderBy(order)
    return (d.join(offs, [*keys, "_b"]).withColumn(name, (F.row_number().over(here) + F.col("_o")).cast("bigint")).drop("_b", "_o"))


def asof_backward(left, right, keys, order, value, width=65536, name="matched"):
    """Every left row gets ``value`` of the nearest right row at or before it within the key (a right row wins a tie).

    Both sides go through one scan: right rows carry their value, left rows receive the last one.
    """
    r = right.select(*keys, (F.col(order) * 2).alias("_o"), F.col(value).alias("_v"), F.lit(None).alias("_row"))
    row = F.struct(*[F.col(c) for c in left.columns])
    lft = left.select(*keys, (F.col(order) * 2 + 1).alias("_o"), F.lit(None).alias("_v"), row.alias("_row"))
    u = r.unionByName(lft)
    out = running_last(u, keys, "_o", "_v", width * 2, name).where(F.col("_row").isNotNull())
    return out.select("_row.*", name)
