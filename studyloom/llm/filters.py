"""Bitmap filters of a fixed size: a cheap first test for membership that never says no to a member.

The bitmap has 2**BITS bits whatever is put in (1 MB), so it may go to every task. Once many keys are in it, it lets more through,
and the join behind it does more of the work; results never depend on it.
"""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

BITS = 23
_PART = 13


def bitmap(keys):
    """Broadcast bitmap of a one-column frame of non-NULL 64-bit hashes."""
    def pack(frames):
        seen = np.zeros(1 << BITS, bool)
        for pdf in frames:
            for at in _places(pdf.iloc[:, 0].to_numpy(np.int64).view(np.uint64)):
                seen[at] = True
        blocks = seen.reshape(-1, 1 << _PART)
        rows = [(int(p), np.packbits(blocks[p]).tobytes()) for p in np.flatnonzero(blocks.any(axis=1))]
        yield pd.DataFrame(rows, columns=["part", "bits"])

    def merge(pdf):
        bits = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in pdf["bits"]])
        return pd.DataFrame([(int(pdf["part"].iloc[0]), bits.tobytes())], columns=["part", "bits"])
    spark = keys.sparkSession
    rows = keys.mapInPandas(pack, "part int, bits binary").groupBy("part").applyInPandas(merge, "part int, bits binary").collect()  # 1 MB at most
    full = np.zeros((1 << BITS - _PART, (1 << _PART) // 8), np.uint8)
    for r in rows:
        full[r.part] = np.frombuffer(r.bits, np.uint8)
    return spark.sparkContext.broadcast(full.ravel())


def _places(h):
    """The two bits of each hash."""
    return [(h >> np.uint64(64 - BITS)).astype(np.int64), (h >> np.uint64(64 - 2 * BITS) & np.uint64((1 << BITS) - 1)).astype(np.int64)]


def hits(bits, h):
    """Which 64-bit hashes (numpy, unsigned) may be members."""
    out = np.ones(len(h), bool)
    for at in _places(h):
        out &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return out


def maybe(shared, column):
    """Column: may this bigint hash be a member of the broadcast bitmap? NULL: no."""
    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        known = h.notna().to_numpy()
        out = np.zeros(len(h), bool)
        out[known] = hits(shared.value, h[known].to_numpy(np.int64).view(np.uint64))
        return pd.Series(out)
    return test(column)


def without(docs, id_col, drop, drop_col):
    """``docs`` less the rows whose id is in ``drop``. Only rows that may be in it are shuffled; NULL ids stay."""
    ids = drop.where(F.col(drop_col).isNotNull()).select(F.xxhash64(F.col(drop_col).cast("bigint")))
    shared = bitmap(ids)
    key = F.col(id_col).cast("bigint")
    flagged = docs.withColumn("__maybe", F.coalesce(maybe(shared, F.when(key.isNotNull(), F.xxhash64(key))), F.lit(False)))
    gone = drop.select(F.col(drop_col).cast("bigint").alias("__gone")).distinct()
    rest = flagged.where("__maybe").join(gone, key == F.col("__gone"), "left_anti")
    return flagged.where(~F.col("__maybe")).unionByName(rest).drop("__maybe")
