"""Exact top-k inner products on a bit-sliced index.

Every attribute of a segment of rows is kept as bitmaps, one per binary digit. For a query the slices of all attributes are
added with bitmap arithmetic (full adders over whole bitmaps, column by column; a negative weight takes the complement), which
gives the slices of every row's score. The top rows are then chosen from the most significant slice downward; rows that tie on
the last place are resolved exactly, by id.

The search is exact. Segments hold a bounded number of rows, chosen by a hash of the id, and meet the queries in blocks.
"""
import math

import numpy as np
import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from studyloom.llm.tables import Scratch

#: A component of this size or more after scaling counts as this size; a score past 64 bits counts as the end of their range.
LARGEST = 1 << 62


def quantise(df, id_col, vec_col, scale=256):
    """(row, id, q array<bigint>): floor(scale * x) of every vector, written once, so that ``row`` tells rows of equal ids apart for good.

    A vector that is NULL or has a NULL or non-finite component takes no part, nor does a NULL id; every other row does.
    """
    x = F.transform(vec_col, lambda v: F.floor(F.least(F.greatest(v.cast("double") * scale, F.lit(-float(LARGEST))), F.lit(float(LARGEST)))))
    finite = F.forall(vec_col, lambda v: F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False)))
    usable = df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).where(finite)
    return Scratch(df.sparkSession).keep(usable.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("id"), x.alias("q")))


def _matrix(rows):
    width = max(map(len, rows), default=0)
    if all(len(r) == width for r in rows):
        return np.array(list(rows), np.int64).reshape(len(rows), width)
    m = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        m[i, :len(r)] = r
    return m


def build_segment(x):
    """(lowest value and number of digits of each attribute, bitmaps) of an integer matrix; bitmaps in rows of 64-bit words."""
    n = len(x)
    words = (n + 63) // 64
    lo = x.min(axis=0) if x.size else np.zeros(x.shape[1], np.int64)
    span = (x.max(axis=0) if x.size else lo) - lo
    digits = np.array([int(s).bit_length() for s in span], np.int32)
    maps = np.zeros((int(digits.sum()), words * 8), np.uint8)
    at = 0
    for j, d in enumerate(digits):
        y = x[:, j] - lo[j]
        for b in range(d):
            got = np.packbits((y >> b) & 1 == 1, bitorder="little")
            maps[at, :len(got)] = got
            at += 1
    return lo, digits, maps.view(np.uint64).reshape(len(maps), words)


def add_slices(digits, maps, q):
    """Score slices, least significant first, up to a constant: each row's sum of |weight| * attribute (or its complement)."""
    first = np.concatenate([[0], np.cumsum(digits)])
    columns = {}
    for j in np.flatnonzero((q != 0) & (digits > 0)):
        w = abs(int(q[j]))
        for t in range(w.bit_length()):
            if w >> t & 1:
                for b in range(digits[j]):
                    columns.setdefault(t + b, []).append((first[j] + b, q[j] < 0))
    out, carries, c = [], [], 0
    while c <= max(columns, default=-1) or carries:
        parts, carries = carries, []
        if c in columns:
            at, flip = map(np.array, zip(*columns[c]))
            parts.append(maps[at] ^ np.where(flip, ~np.uint64(0), np.uint64(0))[:, None])
        s = np.concatenate(parts) if parts else np.zeros((1, maps.shape[1]), np.uint64)
        while len(s) > 1:
            k = len(s) // 3
            if k:
                a, b, d = s[:k], s[k:2 * k], s[2 * k:3 * k]
                half = a ^ b
                carries.append((a & b) | (half & d))
                s = np.concatenate([half ^ d, s[3 * k:]])
            else:
                carries.append(s[:1] & s[1:])
                s = s[:1] ^ s[1:]
        out.append(s[0])
        c += 1
    return out


def _set_bits(bitmap):
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def choose(slices, allowed, k):
    """Row numbers of the k largest scores among ``allowed``: surely chosen rows, then the lowest of those that tie."""
    sure, open_ = np.zeros_like(allowed), allowed.copy()
    for s in reversed(slices):
        top = sure | (open_ & s)
        n = int(np.bitwise_count(top).sum())
        if n > k:
            open_ &= s
        else:
            sure = top
            open_ &= ~s
            if n == k:
                return _set_bits(sure)
    got = _set_bits(sure)
    return np.concatenate([got, _set_bits(open_)[:k - len(got)]])


def _scores(x, q):
    """Inner products; those past 64 bits are set to the end of their range."""
    if not len(x) or float(np.abs(x.astype(float)).max(axis=0, initial=0) @ np.abs(q.astype(float))) < 2.0 ** 62:
        return [int(s) for s in x @ q]
    return [max(-(1 << 63), min((1 << 63) - 1, sum(map(int.__mul__, row, q.tolist())))) for row in x.tolist()]


def search_segment(ids, lo, digits, maps, q_ids, qs, k, rows=None):
    """[(query, row id, score)] of the k best rows of this segment for each query; the row that is the query itself is left out.

    ``rows`` are the rows' own numbers, by which ``q_ids`` name the queries; without them ids stand for rows.
    """
    rows_of = ids if rows is None else rows
    n, dims = len(ids), len(lo)
    full = np.zeros(maps.shape[1] if len(maps) else (n + 63) // 64, np.uint64)
    valid = np.packbits(np.ones(n, bool), bitorder="little")
    full.view(np.uint8)[:len(valid)] = valid
    if not len(maps):
        maps = np.zeros((0, len(full)), np.uint64)
    first = np.concatenate([[0], np.cumsum(digits)]).astype(int)
    out = []
    for qi, q in zip(q_ids, qs):
        q = np.concatenate([q, np.zeros(max(0, dims - len(q)), np.int64)])[:dims]
        allowed = full.copy()
        for own in np.flatnonzero(rows_of == qi).tolist():
            allowed[own >> 6] &= ~np.uint64(1 << (own & 63))
        rows = choose(add_slices(digits, maps, q), allowed, k)
        x = np.tile(lo, (len(rows), 1))
        for j in range(dims):
            for b in range(digits[j]):
                x[:, j] += (maps[first[j] + b][rows >> 6] >> (rows & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64) << b
        out += [(qi, int(ids[r]), s) for r, s in zip(rows, _scores(x, q))]
    return out


def build_index(vectors, segment_rows=32768):
    """One row per segment of at most about ``segment_rows`` vectors: row numbers, ids, lowest values, digits, bitmaps."""
    n = vectors.count()
    parts = max(1, math.ceil(n / segment_rows))

    def build(pdf):
        pdf = pdf.sort_values(["id", "row"])
        lo, digits, maps = build_segment(_matrix(list(pdf["q"])))
        return pd.DataFrame([(int(pdf["seg"].iloc[0]), pdf["row"].to_numpy(np.int64).tobytes(), pdf["id"].to_numpy(np.int64).tobytes(), lo.tobytes(), digits.tobytes(), maps.tobytes())],
                            columns=["seg", "own", "ids", "lo", "digits", "maps"])
    return (vectors.withColumn("seg", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
            .groupBy("seg").applyInPandas(build, "seg int, own binary, ids binary, lo binary, digits binary, maps binary"))


def top_k(spark, rows, queries, k, segment_rows=32768, query_rows=256):
    """(query_id, rank, vec_id, score) of the k best of ``rows`` for each of ``queries`` (both: row, id, q from one ``quantise``).

    Every row is a candidate but the query's own; rows that share an id are rows of their own, and as queries each gets its
    ranks. Vectors of unequal length are multiplied as far as both go. Ties go to the smaller id; fewer than k rows give all. Empty tables give an empty result.
    """
    tables = Scratch(spark)
    index = tables.keep(build_index(rows, segment_rows))
    blocks = max(1, math.ceil(queries.count() / query_rows))

    def pack(pdf):
        return pd.DataFrame([(int(pdf["block"].iloc[0]), pdf["row"].to_numpy(np.int64).tobytes(), pdf["id"].to_numpy(np.int64).tobytes(), [list(map(int, q)) for q in pdf["q"]])],
                            columns=["block", "q_rows", "q_ids", "qs"])
    packed = tables.keep(queries.withColumn("block", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).cast("int"))
                         .groupBy("block").applyInPandas(pack, "block int, q_rows binary, q_ids binary, qs array<array<bigint>>"))
    # each stored segment meets each block of the stated query set
    pairs = (index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(packed, "block")
             .repartition(max(1, index.count()) * blocks, "seg", "block"))

    def search(frames):
        for pdf in frames:
            for r in pdf.itertuples():
                ids, lo = np.frombuffer(r.ids, np.int64), np.frombuffer(r.lo, np.int64)
                digits = np.frombuffer(r.digits, np.int32)
                maps = np.frombuffer(r.maps, np.uint64).reshape(int(digits.sum()), (len(ids) + 63) // 64)
                q_rows, q_ids = np.frombuffer(r.q_rows, np.int64).tolist(), np.frombuffer(r.q_ids, np.int64).tolist()
                got = search_segment(ids, lo, digits, maps, q_rows, [np.array(q, np.int64) for q in r.qs], k, np.frombuffer(r.own, np.int64))
                name = dict(zip(q_rows, q_ids))
                yield pd.DataFrame([(q, name[q], i, s) for q, i, s in got], columns=["query", "query_id", "vec_id", "score"])
    best = (pairs.select("own", "ids", "lo", "digits", "maps", "q_rows", "q_ids", "qs")
            .mapInPandas(search, "query bigint, query_id bigint, vec_id bigint, score bigint"))
    w = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
