"""Order-dependent steps per document: over ordered arrays, or in Arrow batches.

Rows are shuffled by document and sorted; a task streams its partition and hands one document at a time to a small
function. A document comes out of one text cell, so what is held is one document and one batch, whatever the group sizes.
"""
import numpy as np
import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fold_documents(df, order, fn, schema, key="doc"):
    """``fn(list of row tuples of one document) -> list of tuples`` (without the key column, which is put in front)."""
    cols = [c for c in df.columns if c != key]
    names = [f.split()[0] for f in schema.split(",")]

    def run(batches):
        held, held_key = [], None
        for pdf in batches:
            out = []
            for k, *row in zip(pdf[key].tolist(), *[pdf[c].tolist() for c in cols]):
                if k != held_key:
                    if held:
                        out += [(held_key, *r) for r in fn(held)]
                    held, held_key = [], k
                held.append(tuple(row))
            yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame([(held_key, *r) for r in fn(held)], columns=names)

    d = df.select(key, *cols)
    return d.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def attach_exact(rows, near=12, reach=120):
    """Exact answer attachment: (doc, seq, q_seq, ans) for ``rows(doc, seq, kind, num, ans, letters, table)``.

    An answer (``a``) looks for the nearest question (``q``) before it with its number that has no answer yet; an answer from a
    table may also take one that has, at most ``near`` rows back. It is attached if all its letters are among the question's,
    if it says something new, and, from a table, if the question is at most ``reach`` rows back. A document's rows of one number
    are a short array, gone through in order.
    """
    at = F.row_number().over(W.partitionBy("doc").orderBy("seq"))
    row = F.struct(at.alias("pos"), F.col("seq").cast("bigint").alias("seq"), "kind", "ans", "letters", "table")
    lists = rows.select("doc", "num", row.alias("x")).groupBy("doc", "num").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    start = F.struct(F.array().cast("array<struct<pos:int,seq:bigint,ans:string,letters:string>>").alias("asked"),
                     F.array().cast("array<struct<seq:bigint,q_seq:bigint,ans:string>>").alias("got"))

    def step(acc, x):
        back = lambda q: x["pos"] - q["pos"]
        free = F.filter(acc["asked"], lambda q: q["ans"].isNull() | (x["table"] & (back(q) <= near)))
        q = F.get(free, F.size(free) - 1)
        fits = F.forall(F.split(x["ans"], ""), lambda c: F.contains(q["letters"], c)) & ~q["ans"].eqNullSafe(x["ans"]) & ~(x["table"] & (back(q) > reach))
        take = (x["kind"] == "a") & q.isNotNull() & F.coalesce(fits, F.lit(False))
        fresh = F.struct(x["pos"].alias("pos"), x["seq"].alias("seq"), x["ans"].alias("ans"), x["letters"].alias("letters"))
        known = F.transform(acc["asked"], lambda o: F.when(o["pos"] == q["pos"], o.withField("ans", x["ans"])).otherwise(o))
        pair = F.struct(x["seq"].alias("seq"), q["seq"].alias("q_seq"), x["ans"].alias("ans"))
        return F.struct(F.when(x["kind"] == "q", F.concat(acc["asked"], F.array(fresh))).when(take, known).otherwise(acc["asked"]).alias("asked"),
                        F.when(take, F.concat(acc["got"], F.array(pair))).otherwise(acc["got"]).alias("got"))
    return lists.select("doc", F.inline(F.aggregate("xs", start, step)["got"]))


def anchor_chain(rows, gap=0.2, jump=15, restart=0.8, back=400):
    """Best increasing chain of question numbers over candidates (seq, num, weight, section) of one document.

    Missing numbers cost ``gap`` each; numbers may restart at 1 only after a section header. Each candidate looks at the
    window of the ``back`` candidates before it as one array.
    """
    seqs, num = [r[0] for r in rows], np.array([r[1] for r in rows], dtype=float)
    weight, sect = np.array([r[2] for r in rows], dtype=float), np.cumsum([1 if r[3] else 0 for r in rows])
    total = weight - gap * (num - 1) - 0.5 * (num > 1)
    link = np.full(len(rows), -1)
    for j in range(1, len(rows)):
        lo = max(0, j - back)
        rise = num[j] - num[lo:j]
        gain = np.where((rise >= 1) & (rise <= jump), total[lo:j] - gap * (rise - 1), -np.inf)
        if num[j] == 1:
            fresh = (num[lo:j] >= 5) & (sect[lo:j] < sect[j])
            gain = np.where(fresh, total[lo:j] - restart, gain)
        i = int(gain.argmax())
        if gain[i] + weight[j] > total[j]:
            total[j], link[j] = gain[i] + weight[j], lo + i
    chain, at = [], int(total.argmax())
    while at >= 0:
        chain.append((seqs[at], int(num[at])))
        at = int(link[at])
    return chain[::-1]


def run_key_match(rows, share=0.5, valid=0.6):
    """Runs of questions against the answer keys of their document: (doc, seq, k_seq, ans).

    ``rows(doc, seq, kind, num, page, letters, key)``: questions (``q``) form runs in which numbers rise; a key (``k``) holds
    ``num:answer`` pairs. A key on a run's last page or the one after suits it when it has ``share`` of its numbers and
    ``valid`` of its questions offer the answer. Runs in order take the first suitable key behind the last one taken.
    """
    q = rows.where("kind = 'q'")
    before = F.lag("num").over(W.partitionBy("doc").orderBy("seq"))
    starts = q.withColumn("new", F.when(before.isNull() | (F.col("num") <= before), 1).otherwise(0))
    q = starts.withColumn("run", F.sum("new").over(W.partitionBy("doc").orderBy("seq"))).select("doc", "run", "seq", "num", "page", "letters")
    runs = q.groupBy("doc", "run").agg(F.count("*").alias("size"), F.max_by("page", "seq").alias("at"))
    pair = F.split("pair", ":")
    keys = (rows.where("kind = 'k'").select("doc", F.col("seq").alias("k_seq"), F.col("page").alias("k_page"), F.posexplode(F.split("key", ",")).alias("i", "pair"))
            .where("pair <> ''").groupBy("doc", "k_seq", "k_page", F.element_at(pair, 1).cast("bigint").alias("num")).agg(F.max_by(F.element_at(pair, 2), "i").alias("ans")))
    offered = F.forall(F.split("ans", ""), lambda c: F.contains("letters", c))
    near = (q.select("doc", "run", "seq", "num", "letters").join(runs, ["doc", "run"]).join(keys, ["doc", "num"])
            .where(F.col("k_page").between(F.col("at"), F.col("at") + 1)).withColumn("fits", offered))
    suits = (near.groupBy("doc", "run", "size", "k_seq").agg(F.count("*").alias("have"), F.count_if("fits").alias("fit"))
             .where((F.col("have") >= F.greatest(F.lit(1), F.floor(F.col("size") * share))) & (F.col("fit") >= F.col("size") * valid)))
    # a document's runs are a short array: each takes the least suitable key that is behind what has been taken
    listed = (suits.groupBy("doc", "run").agg(F.collect_set("k_seq").alias("ks"))
              .groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("run", "ks"))).alias("runs")))
    start = F.struct(F.lit(-1).cast("bigint").alias("last"), F.array().cast("array<struct<run:bigint,k_seq:bigint>>").alias("got"))

    def take(acc, x):
        k = F.array_min(F.filter(x["ks"], lambda k: k > acc["last"]))
        one = F.struct(x["run"].cast("bigint").alias("run"), k.alias("k_seq"))
        return F.struct(F.coalesce(k, acc["last"]).alias("last"), F.when(k.isNull(), acc["got"]).otherwise(F.concat(acc["got"], F.array(one))).alias("got"))
    taken = listed.select("doc", F.inline(F.aggregate("runs", start, take)["got"]))
    return near.where("fits").join(taken, ["doc", "run", "k_seq"]).select("doc", "seq", "k_seq", "ans")


def sequence_align(rows, skip=1.0):
    """Align two ordered lists of groups of one volume: rows (side, idx, n, label, tokens); skipping costs ``skip``.

    A pair scores by size, label and content overlap; only pairs with a positive score are kept: (idx_a, idx_b, score).
    A row of the alignment table is a running maximum, so it is computed as one array.
    """
    left, right = [r for r in rows if r[0] == "a"], [r for r in rows if r[0] == "b"]
    if not left or not right:
        return []
    na, nb = (np.array([r[2] for r in x]) for x in (left, right))
    off = np.abs(na[:, None] - nb[None, :])
    sc = np.where(off == 0, 3.0, np.where(off <= np.maximum(2, na[:, None] // 5), 1.0, -2.0))
    la, lb = (np.array([r[3] or "" for r in x]) for x in (left, right))
    sc += 1.5 * ((la[:, None] == lb[None, :]) & (la[:, None] != ""))
    ta, tb = [set(r[4]) for r in left], [set(r[4]) for r in right]
    for i, x in enumerate(ta):
        for j, y in enumerate(tb):
            if len(x) >= 5 and len(y) >= 5:
                sc[i, j] += 12 * len(x & y) / min(len(x), len(y)) - 2
    cost = skip * np.arange(len(right) + 1)
    table = [-cost]
    for i in range(len(left)):
        row = table[i] - skip
        row[1:] = np.maximum(row[1:], table[i][:-1] + sc[i])
        table.append(np.maximum.accumulate(row + cost) - cost)
    out, i, j = [], len(left), len(right)
    while i and j:
        here = table[i][j]
        if abs(table[i][j - 1] - skip - here) < 1e-9:
            j -= 1
        elif abs(table[i - 1][j] - skip - here) < 1e-9:
            i -= 1
        else:
            i, j = i - 1, j - 1
            if sc[i, j] > 0:
                out.append((left[i][1], right[j][1], round(float(sc[i, j]), 4)))
    return out[::-1]
