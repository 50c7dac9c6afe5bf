"""Connected components by randomised contraction, with DataFrame operations only.

Every round each node points at the member of its closed neighbourhood that is first in a hash order of that round; edges are
rewritten between these targets, and loops and repeats go. The number of nodes with edges falls by a constant factor a round,
so rounds grow with its logarithm, also on long chains and stars. A node of very many edges is met by partial aggregation
(its minimum) and by joins that adaptive execution can split. Each round's table is written, so the lineage stays short.
"""
from pyspark.sql import functions as F


def components(tables, edges, a="a", b="b"):
    """(node, component) for every node that has an edge; a component is named by its smallest node. NULL ends are ignored.

    ``tables``: a ``Scratch``. No edges give an empty result.
    """
    e = tables.keep(_tidy(edges.select(F.col(a).alias("a"), F.col(b).alias("b"))))
    first, steps, old = e, [], []
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.xxhash64(F.col(c), F.lit(len(steps) + 1))
        near = both.groupBy("a").agg(F.min(F.struct(rank("b").alias("h"), F.col("b").alias("v"))).alias("m"))
        own = F.struct(rank("a").alias("h"), F.col("a").alias("v"))
        to = tables.keep(near.select(F.col("a").alias("node"), F.least("m", own)["v"].alias("to")))
        steps.append(to)
        e2 = (e.join(to.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a")
              .join(to.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b"))
        e = tables.keep(_tidy(e2.select(F.col("ta").alias("a"), F.col("tb").alias("b"))))
        old.append(e)
    if not steps:
        return first.select(F.col("a").alias("node"), F.col("a").alias("component"))
    # every node of a later round is a target of the round before: follow the targets to the end, last round first
    end = steps[-1]
    for s in reversed(steps[:-1]):
        end = tables.keep(s.join(end.select(F.col("node").alias("to"), F.col("to").alias("last")), "to", "left")
                          .select("node", F.coalesce("last", "to").alias("to")))
    name = end.groupBy("to").agg(F.min("node").alias("component"))
    out = tables.keep(end.join(name, "to").select("node", "component"))
    tables.drop(*old, *steps)
    return out


def _tidy(e):
    return (e.where("a is not null and b is not null and a <> b")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
