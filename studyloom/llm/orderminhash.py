"""Near-duplicate documents by Order MinHash over five-word shingles, verified by banded alignment.

Shingles are labelled with their occurrence number, so that each labelled shingle is unique in its text. One sketch takes the
SMALLEST labelled shingles with the least values under a random permutation and keeps them in text order; two texts that share
a sketch share shingles in the same order, which follows their edit similarity rather than their sets. SKETCHES sketches are drawn.

Similarity of two texts = L / (n + m - L) with n, m labelled shingles and L the length of their longest common subsequence. At
0.8 or more at most (n + m) / 9 shingles are unmatched, so matches lie in a band of that width; as labelled shingles are unique,
the alignment is the longest increasing run of matched positions inside the band.

Equal word sequences are one node. Nodes with a common sketch first meet the first of them in a hash order, by the first FEW sketches;
those that verify are linked, and by the other sketches only nodes of different components meet. In buckets that still hold several
components all members of different components meet, each pair in its first common bucket; only pairs with enough common shingles
leave that join. A large bucket is cut into parts, and each two parts meet on their own. The classes are the connected components of all
links, so every two alike texts that share a sketch are in one class. Links inside a component are not looked for further.
"""
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from studyloom.llm.components import components
from studyloom.llm.filters import bitmap, hits, without
from studyloom.llm.held import release
from studyloom.llm.tables import Scratch
from studyloom.llm.words import groups, mix, shingles, word_hashes

WIDTH, SKETCHES, SMALLEST, ALIKE = 5, 24, 4, 0.8
#: Sketches whose stars are verified first, and members of a bucket that meet in one place.
FEW, PART = 4, 512
_ODD = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64)) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def labelled(words, width=WIDTH):
    """Occurrence-labelled shingles of one text's word hashes; a text shorter than ``width`` words is one shingle."""
    if not len(words):
        return np.zeros(0, np.uint64)
    s = shingles(words, min(width, len(words)))
    order = np.argsort(s, kind="stable")
    t = s[order]
    new = np.concatenate([[True], t[1:] != t[:-1]])
    count = np.arange(len(t)) - np.maximum.accumulate(np.where(new, np.arange(len(t)), 0))
    out = np.empty_like(s)
    out[order] = np.where(count > 0, mix(t + count.astype(np.uint64) * _STEP), t)
    return out


def sketches(lab):
    """SKETCHES hashes, each of the SMALLEST labelled shingles under its permutation, in text order; all of them if fewer."""
    if not len(lab):
        return np.zeros(0, np.int64)
    least = min(SMALLEST, len(lab))
    out = np.zeros(SKETCHES, np.uint64)
    step = max(1, 1_000_000 // len(lab))
    for a in range(0, SKETCHES, step):
        v = lab[None, :] * _ODD[a:a + step, None]
        at = np.sort(np.argpartition(v, least - 1, axis=1)[:, :least], axis=1)
        h = np.full(len(at), len(lab) if least < SMALLEST else SMALLEST, np.uint64)
        for j in range(least):
            h = mix(h * _STEP + lab[at[:, j]])
        out[a:a + step] = h
    return out.view(np.int64)


def node(words):
    """16 bytes that stand for a word sequence."""
    at = np.arange(1, len(words) + 1, dtype=np.uint64)
    sums = [mix(words ^ mix(at + np.uint64(salt))).sum(dtype=np.uint64) for salt in (0, 1 << 40)]
    return mix(np.array(sums, np.uint64) + np.uint64(len(words))).astype(">u8").tobytes()


def similarity(x, y, alike=ALIKE):
    """L / (n + m - L) inside the band that ``alike`` allows; below ``alike`` it may be too small, never too large."""
    n, m = len(x), len(y)
    if not n or not m:
        return float(n == m)
    if min(n, m) < alike * max(n, m):
        return 0.0
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if len(i) * (1 + alike) < alike * (n + m):
        return 0.0
    band = (n + m) * (1 - alike) / (1 + alike)
    inside = np.abs(i - j) <= band
    i, j = i[inside], j[inside]
    j = j[np.argsort(i)]
    if np.all(j[1:] > j[:-1]):
        length = len(j)
    else:
        tails = []
        for p in j.tolist():
            at = bisect_left(tails, p)
            tails[at:at + 1] = [p]
        length = len(tails)
    return length / (n + m - length)


def _each(texts):
    for first, folded in groups(texts):
        h, offs = word_hashes(folded)
        for i in range(len(folded)):
            yield first + i, h[offs[i]:offs[i + 1]]


def _sketched(frames):
    release()
    for pdf in frames:
        rows = []
        for _, w in _each(pdf["text"]):
            lab = labelled(w)
            rows.append((node(w), len(lab), sketches(lab).tolist()))
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "node": [r[0] for r in rows], "n": [r[1] for r in rows], "keys": [r[2] for r in rows]})


def _verify(pairs, seqs=None):
    """Pairs (a, b) of nodes that are alike; without ``seqs`` the pairs hold the shingles as x and y."""
    def test(frames):
        release()
        for pdf in frames:
            ok = [similarity(x, y) >= ALIKE for x, y in zip(pdf["x"], pdf["y"])]
            yield pdf.loc[ok, ["a", "b"]]
    if seqs is not None:
        pairs = (pairs.join(seqs.select(F.col("node").alias("b"), F.col("seq").alias("y")), "b")
                 .join(seqs.select(F.col("node").alias("a"), F.col("seq").alias("x")), "a"))
    return pairs.select("a", "b", "x", "y").mapInPandas(test, "a binary, b binary")


def _stars(keyed):
    """Pairs of each bucket's members with its first member in a hash order, where the lengths allow similarity."""
    first = F.min(F.struct(F.xxhash64("node").alias("o"), F.col("node").alias("b"), F.col("n").alias("m")))
    centre = keyed.groupBy("band", "key").agg(first.alias("c")).select("band", "key", "c.b", "c.m")
    return keyed.join(centre, ["band", "key"]).where(F.col("node") != F.col("b")).where(F.least("n", "m") >= ALIKE * F.greatest("n", "m"))


def _apart(at, part=PART):
    """Pairs of a bucket's members of different components, once each, with as many common shingles as similarity needs.

    ``at(band, key, size, node, n, component, keys, seq)``. The order of the tests matters, cheap ones first.
    """
    parts = F.ceil(F.col("size") / part).cast("int")
    own, other = F.pmod(F.xxhash64("node", F.lit(part)), parts).cast("int"), F.explode(F.sequence(F.lit(0), parts - 1))
    x, y = at.withColumn("i", own).withColumn("j", other).alias("x"), at.withColumn("j", own).withColumn("i", other).alias("y")
    n, m = F.col("x.n"), F.col("y.n")
    may = (F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component")) & (F.least(n, m) >= ALIKE * F.greatest(n, m))
    here = F.array_position(F.zip_with("x.keys", "y.keys", lambda k, l: k == l), True) == F.col("x.band") + 1
    common = F.size(F.array_intersect("x.seq", "y.seq")) * (1 + ALIKE) >= ALIKE * (n + m) - 1e-6
    test = F.when(may, F.when(here, common).otherwise(False)).otherwise(False)
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("band", "key", "i", "j")]
    return (x.join(y, same[0] & same[1] & same[2] & same[3] & test)
            .select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.seq").alias("x"), F.col("y.seq").alias("y")))


def _ends(pairs, found):
    """``pairs`` with the components of their ends as aa and bb; a node without a link is its own."""
    named_by = lambda end: found.select(F.col("node").alias(end), F.col("component").alias(end + end))
    return (pairs.join(named_by("a"), "a", "left").join(named_by("b"), "b", "left")
            .withColumn("aa", F.coalesce("aa", "a")).withColumn("bb", F.coalesce("bb", "b")))


def _merged(tables, found, links):
    """(node, component) after further links: what these link are components, so these are contracted."""
    merged = components(tables, _ends(links, found).select(F.col("aa").alias("a"), F.col("bb").alias("b")))
    new = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct().join(found, "node", "left_anti")
    every = found.unionByName(new.withColumn("component", F.col("node")))
    merged = merged.select(F.col("node").alias("component"), F.col("component").alias("whole"))
    return tables.keep(every.join(merged, "component", "left").select("node", F.coalesce("whole", "component").alias("component")))


def classes(spark, docs, id_col="doc_id", text_col="text"):
    """(doc_id, node, class_id, links, kept) for every row of ``docs``; node stands for the row's word sequence.

    class_id: the smallest id of the class (NULL if it has none but NULL); links: those links of the row's text to other
    texts that were verified to find the classes (within a component not all are); kept: true for the rows of the class's first text in (id, text) order. NULL and empty texts, and texts of equal
    words, are equal. Repeated rows are returned each. Texts under five words have one shingle, so only equal ones meet.
    """
    tables = Scratch(spark)
    source = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    rows = tables.keep(source.mapInPandas(_sketched, "doc_id string, node binary, n int, keys array<bigint>")
                       .withColumn("doc_id", F.col("doc_id").cast("bigint")))
    nodes = tables.keep(rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("keys").alias("keys")))
    keyed = nodes.select("node", "n", F.posexplode("keys").alias("band", "key"))
    shared = keyed.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1").drop("size")
    keyed = tables.keep(keyed.join(shared, ["band", "key"]))
    seqs = tables.keep(_sequences(source, keyed.select("node").distinct()))
    first = tables.keep(_stars(keyed).groupBy(F.col("node").alias("a"), "b").agg(F.min("band").alias("band")))
    links = tables.keep(_verify(first.where(F.col("band") < FEW), seqs))
    found = components(tables, links)
    rest = tables.keep(_verify(_ends(first.where(F.col("band") >= FEW), found).where("aa <> bb"), seqs))
    found = _merged(tables, found, rest)
    # buckets that hold members of several components: these meet each other
    at = keyed.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = (at.groupBy("band", "key").agg(F.min("component").alias("l"), F.max("component").alias("h"), F.count("*").alias("size"))
             .where("l <> h").select("band", "key", "size"))
    at = at.join(mixed, ["band", "key"]).join(nodes.select("node", "keys"), "node").join(seqs, "node")
    more = tables.keep(_verify(_apart(at)))
    found = _merged(tables, found, more)
    links = tables.keep(links.unionByName(rest).unionByName(more).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    named = (nodes.select("node", "first").join(found, "node", "left").join(degree, "node", "left")
             .select("node", "first", F.coalesce("component", "node").alias("component"), F.coalesce("links", F.lit(0)).alias("links")))
    named = tables.keep(named)
    best = named.groupBy("component").agg(F.min(F.struct(F.col("first").isNull(), "first", "node")).alias("m"))
    named = (named.join(best, "component").select("node", F.col("m.first").alias("class_id"), "links", (F.col("m.node") == F.col("node")).alias("top")))
    out = rows.select("doc_id", "node").join(named, "node").select(
        "doc_id", "node", "class_id", "links", (F.col("top") & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"))
    tables.drop(keyed, seqs, first)
    return out


def first_of_each(spark, docs, id_col="doc_id", text_col="text"):
    """``docs`` with one row of each class: the one with the smallest id (of equal rows, any one).

    Rows are told apart by id; those whose id is NULL or stands on several rows also by their words.
    """
    tables = Scratch(spark)
    told = tables.keep(classes(spark, docs, id_col, text_col).select("doc_id", "node", "kept"))
    ids = told.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("kept").alias("kept"))
    odd = F.col("doc_id").isNull() | (F.col("n") > 1)
    gone = tables.keep(ids.where(odd | ~F.col("kept")).select("doc_id", odd.alias("odd")))
    key = F.col(id_col).cast("bigint")
    rest = without(docs.where(key.isNotNull()), id_col, gone, "doc_id")
    again = gone.where("odd")
    if again.isEmpty():
        return rest

    @F.pandas_udf("binary")
    def node_of(text: pd.Series) -> pd.Series:
        return pd.Series([node(w) for _, w in _each(text)])
    rows = docs.join(again.select(F.col("doc_id").alias("__id")), key.eqNullSafe(F.col("__id")), "left_semi").withColumn("__node", node_of(F.col(text_col)))
    stay = told.where("kept").select(F.col("doc_id").alias("__id"), F.col("node").alias("__kept"))
    rows = rows.dropDuplicates([id_col, "__node"]).join(stay, key.eqNullSafe(F.col("__id")) & (F.col("__node") == F.col("__kept")), "left_semi")
    return rest.unionByName(rows.drop("__node"))


def _sequences(source, wanted):
    """(node, labelled shingles) of the wanted nodes, once each; only texts that may be wanted leave the scan."""
    shared = bitmap(wanted.select(F.conv(F.hex(F.substring("node", 1, 8)), 16, -10).cast("bigint")))

    def cut(frames):
        release()
        for pdf in frames:
            rows, seen = [], set()
            for _, w in _each(pdf["text"]):
                k = node(w)
                if k not in seen and hits(shared.value, np.array([int.from_bytes(k[:8], "big")], np.uint64))[0]:
                    seen.add(k)
                    rows.append((k, labelled(w).view(np.int64)))
            yield pd.DataFrame(rows, columns=["node", "seq"])
    return source.select("text").mapInPandas(cut, "node binary, seq array<bigint>").join(wanted, "node", "left_semi").groupBy("node").agg(F.first("seq").alias("seq"))
