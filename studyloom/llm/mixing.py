"""Mixing sources to target weights by temperature.

Each source's share of all tokens is raised to an exponent and normalised. The exponent in [0, 1] is bisected: the largest that
reaches a target entropy, or the smallest that repeats no source more often than a limit (relative to the source repeated
least). The weights are realised as budgets of tokens: a source is passed through whole as often as its budget allows, and
then in part, by blocks of documents in a new pseudo-random order for each pass.

DataFrame operations only. Documents of one source are spread over many blocks, so that a source of any size is no hot key; the
running sums over a source's blocks go through ranges of the order first.
"""
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from studyloom.llm.tables import Scratch

RANGE_BITS = 12


def tokens_of(text):
    """Words of a whole text (runs of what is not white space); 0 for NULL."""
    return F.coalesce(F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")), F.lit(0)).cast("bigint")


def exponent(totals, entropy=None, repeats=None, grid=64, rounds=6):
    """Bisected exponent for ``totals`` (source, n): one small job a round tries ``grid`` exponents at once.

    The result lies within grid**-rounds of the boundary and on its permitted side. Targets that no exponent reaches give 0
    (all sources equal), and targets that are met without any change give 1.
    """
    lo, hi = 0.0, 1.0
    whole = totals.where("n > 0")
    top = whole.agg(F.sum("n").alias("all"), F.max("n").alias("most")).first()  # one row
    if top["all"] is None:
        return 1.0
    shares = whole.select((F.col("n") / top["all"]).alias("p"), F.lit(top["most"] / top["all"]).alias("m"))
    for _ in range(rounds):
        step = (hi - lo) / grid
        tried = shares.select("p", "m", F.posexplode(F.array(*[F.lit(lo + i * step) for i in range(grid + 1)])).alias("i", "a"))
        raised = tried.groupBy("i", "a").agg(F.sum(F.pow("p", "a")).alias("z"), F.sum(F.pow("p", "a") * F.log("p") * F.col("a")).alias("l"),
                                             F.max(F.pow(F.col("p") / F.col("m"), F.col("a") - 1)).alias("most"), F.min(F.pow(F.col("p") / F.col("m"), F.col("a") - 1)).alias("least"))
        seen = raised.select("i", "a", (F.log("z") - F.col("l") / F.col("z")).alias("h"), (F.col("most") / F.col("least")).alias("r")).orderBy("i").collect()  # grid + 1 rows
        if repeats is not None:  # falls as the exponent rises
            good = [x.a for x in seen if x.r <= repeats]
            if not good:
                return 1.0
            hi = good[0]
            lo = max(0.0, hi - step)
        else:  # entropy falls as the exponent rises
            good = [x.a for x in seen if x.h >= entropy]
            if not good:
                return 0.0
            lo = good[-1]
            hi = min(1.0, lo + step)
        if lo >= hi:
            break
    return hi if repeats is not None else lo


def budgets(totals, power, budget=None):
    """(source, n, weight, passes, rest): whole passes through each source and the tokens of the part pass after them.

    Without ``budget`` the sum of tokens is the least that takes every source whole at least once. Sources without tokens have
    no weight and are taken once.
    """
    raised = totals.withColumn("r", F.when(F.col("n") > 0, F.pow(F.col("n").cast("double"), F.lit(power))).otherwise(0.0))
    sums = raised.agg(F.sum("r").alias("z"), F.max(F.when(F.col("n") > 0, F.col("n") / F.col("r"))).alias("u")).first()  # one row
    z, u = sums.z or 1.0, sums.u or 0.0
    # r / z * budget, where the least budget is the largest n * z / r
    quota = F.col("r") * u if budget is None else F.col("r") / z * float(budget)
    w = raised.select("source", "n", (F.col("r") / z).alias("weight"), F.round(quota).cast("bigint").alias("quota"))
    return w.select("source", "n", "weight", F.when(F.col("n") > 0, F.floor(F.col("quota") / F.greatest("n", F.lit(1)))).otherwise(1).cast("int").alias("passes"),
                    F.when(F.col("n") > 0, F.col("quota") % F.greatest("n", F.lit(1))).otherwise(0).alias("rest"))


def _order(seed):
    return F.xxhash64(F.lit(seed), "source", "passes", "block")


def plan(tables, rows, docs_per_block=64, entropy=None, repeats=None, budget=None, seed=17):
    """(source, block, blocks, copies, weight) for every block of ``rows`` (doc_id, source, tokens)."""
    sizes = rows.groupBy("source").agg(F.sum("tokens").alias("n"), F.count("*").alias("docs"))
    sizes = tables.keep(sizes)
    power = exponent(sizes, entropy, repeats)
    quota = budgets(sizes.select("source", "n"), power, budget).join(sizes.select(F.col("source").alias("s"), F.ceil(F.col("docs") / docs_per_block).cast("int").alias("blocks")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    quota = quota.withColumnRenamed("source", "s")
    per_block = (rows.join(quota, F.col("source").eqNullSafe(F.col("s"))).select("source", F.pmod(F.xxhash64("doc_id"), "blocks").alias("block"), "tokens", "blocks", "passes", "rest", "weight")
                 .groupBy("source", "block", "blocks", "passes", "rest", "weight").agg(F.sum("tokens").alias("tokens")))
    per_block = per_block.withColumn("o", _order(seed)).withColumn("g", F.shiftright("o", 64 - RANGE_BITS))
    before = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = per_block.groupBy("source", "g").agg(F.sum("tokens").alias("tokens"))
    ranges = ranges.select(F.col("source").alias("s"), F.col("g").alias("h"), before(W.partitionBy("source").orderBy("g")).alias("a"))  # 2**RANGE_BITS rows a source at most
    inside = per_block.withColumn("b", before(W.partitionBy("source", "g").orderBy("o", "block")))
    placed = inside.join(ranges, F.col("source").eqNullSafe(F.col("s")) & (F.col("g") == F.col("h")))
    part = F.col("a") + F.col("b") + F.col("tokens") <= F.col("rest")
    return placed.select("source", "block", "blocks", (F.col("passes") + F.when((F.col("rest") > 0) & part, 1).otherwise(0)).alias("copies"), "weight")


def copied(spark, docs, id_col="doc_id", source_col="source", text_col="text", **target):
    """Every row of ``docs`` as often as its block is taken, with columns ``__epoch`` and ``__place`` (order within a pass).

    ``target``: docs_per_block, entropy or repeats, budget, seed. NULL sources are one source; NULL ids share a block; NULL
    and empty texts have no tokens and go with their block. Repeated rows are kept apart. Empty tables give an empty result.
    """
    tables = Scratch(spark)
    rows = tables.keep(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), tokens_of(F.col(text_col)).alias("tokens")))
    chosen = tables.keep(plan(tables, rows, **target))
    blocks = chosen.groupBy("source").agg(F.max("blocks").alias("__blocks")).withColumnRenamed("source", "__source")
    per_block = chosen.select(F.col("source").alias("__s"), F.col("block").alias("__b"), F.col("copies").alias("__copies"))
    at = docs.join(blocks, F.col(source_col).eqNullSafe(F.col("__source"))).withColumn("__block", F.pmod(F.xxhash64(F.col(id_col)), "__blocks"))
    got = (at.join(per_block, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__block") == F.col("__b"))).where("__copies > 0")
           .withColumn("__epoch", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1))))
    return got.withColumn("__place", F.xxhash64(F.lit(target.get("seed", 17)), "__source", "__epoch", "__block")).drop("__source", "__blocks", "__s", "__b", "__copies", "__block")
