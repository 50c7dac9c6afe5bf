"""Benchmark decontamination by greedy string tiling.

Every test item and document is a sequence of word hashes. Seeds are the hashes of SEED words in a row; a document's seeds are
first held against a bitmap of all seeds of the test items (of a fixed size), what passes is joined with the items' seeds.
Pairs whose shared seeds could cover enough of the item are tiled: the longest match of unmarked words in both texts is marked,
again and again, until no match of SEED words is left; matches are found by Karp-Rabin hashes of windows and then extended word
by word. Since tiles may lie anywhere, a passage with its sentences in another order is covered as well.
"""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from studyloom.llm.filters import bitmap, hits
from studyloom.llm.held import release
from studyloom.llm.orderminhash import node
from studyloom.llm.tables import Scratch
from studyloom.llm.words import groups, shingles, word_hashes

SEED, COVERED = 5, 0.5


def tiles(item, doc, least=SEED, breaks=()):
    """[(start in item, start in doc, length)] of the greedy tiling, longest first, ties by item and then document position.

    ``breaks``: positions of ``doc`` at which a new region starts; no tile reaches across.
    """
    free_i, free_d = np.ones(len(item), bool), np.ones(len(doc), bool)
    stop = np.zeros(len(doc) + 1, bool)
    stop[list(breaks)] = True
    hi, hd = shingles(item, least), shingles(doc, least)
    at = {}
    for p, h in enumerate(hi.tolist()):
        at.setdefault(h, []).append(p)
    near = [(d, p) for d, h in enumerate(hd.tolist()) for p in at.get(h, ())]
    out = []
    while near:
        best, length, left = [], least, []
        for d, p in near:
            n, room = 0, min(len(item) - p, len(doc) - d)
            while n < room and item[p + n] == doc[d + n] and free_i[p + n] and free_d[d + n] and not (n and stop[d + n]):
                n += 1
            if n >= least:
                left.append((d, p))
                if n > length:
                    best, length = [(p, d)], n
                elif n == length:
                    best.append((p, d))
        for p, d in sorted(best):
            if free_i[p:p + length].all() and free_d[d:d + length].all():
                free_i[p:p + length] = free_d[d:d + length] = False
                out.append((p, d, length))
        near = left
    return out


def _items(frames):
    for pdf in frames:
        rows = []
        for first, folded in groups(pdf["text"]):
            h, offs = word_hashes(folded)
            for i in range(len(folded)):
                w = h[offs[i]:offs[i + 1]]
                if len(w) >= SEED:
                    rows.append((pdf["item_id"].iloc[first + i], node(w), w.tobytes(), shingles(w, SEED).view(np.int64).tolist()))
        yield pd.DataFrame(rows, columns=["item_id", "item", "words", "seeds"])


def find(spark, docs, items, id_col="doc_id", text_col="text", item_id="item_id", item_text="text", covered=COVERED):
    """(doc_id, item_id, coverage, tiles, longest, spans) of every document and item with coverage of at least ``covered``.

    coverage: share of the item's words in tiles; spans: [start in item, start in document, length] in words. Items of fewer
    than SEED words (also NULL and empty ones) take no part, as single words prove nothing. Repeated documents and items give
    a row each; NULL ids are returned as such. Empty tables give an empty result.
    """
    tables = Scratch(spark)
    told = tables.keep(items.select(F.col(item_id).cast("string").alias("item_id"), F.col(item_text).alias("text"))
                       .mapInPandas(_items, "item_id string, item binary, words binary, seeds array<bigint>")
                       .withColumn("item_id", F.col("item_id").cast("bigint")))
    known = tables.keep(told.groupBy("item").agg(F.first("words").alias("words"), F.first("seeds").alias("seeds")))
    seeds = known.select("item", F.explode("seeds").alias("seed")).groupBy("item", "seed").agg(F.count("*").alias("times"))
    shared = bitmap(seeds.select("seed").distinct())

    def meet(frames):
        release()
        for pdf in frames:
            rows = []
            for first, folded in groups(pdf["text"]):
                h, offs = word_hashes(folded)
                s = shingles(h, SEED)
                found = np.flatnonzero(hits(shared.value, s))
                doc = np.searchsorted(offs, found, side="right") - 1
                inside = found + SEED <= offs[doc + 1]
                found, doc = found[inside], doc[inside]
                for i in np.unique(doc):
                    at = found[doc == i]
                    take = np.unique((at[:, None] + np.arange(SEED)).ravel())
                    w = h[offs[i]:offs[i + 1]]
                    rows.append((pdf["doc_id"].iloc[first + i], node(w), np.unique(s[at]).view(np.int64).tolist(),
                                 (take - offs[i]).astype(np.int32).tobytes(), h[take].tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "doc", "seeds", "at", "words"])
    met = tables.keep(docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
                      .mapInPandas(meet, "doc_id string, doc binary, seeds array<bigint>, at binary, words binary")
                      .withColumn("doc_id", F.col("doc_id").cast("bigint")))
    texts = met.groupBy("doc").agg(F.first("seeds").alias("seeds"), F.first("at").alias("at"), F.first("words").alias("words"))
    texts = tables.keep(texts)
    # a tile of n words holds n - SEED + 1 seeds, so each shared seed stands for SEED words of the item at most
    pairs = (texts.select("doc", F.explode("seeds").alias("seed")).join(seeds, "seed").groupBy("doc", "item").agg(F.sum("times").alias("n"))
             .join(known.select("item", (F.length("words") / 8).alias("size")), "item").where(F.col("n") * SEED >= covered * F.col("size")))

    def tile(frames):
        release()
        for pdf in frames:
            rows = []
            for r in pdf.itertuples():
                item, doc, at = np.frombuffer(r.item_words, np.uint64), np.frombuffer(r.words, np.uint64), np.frombuffer(r.at, np.int32)
                got = tiles(item, doc, SEED, np.flatnonzero(np.diff(at) > 1) + 1)
                share = sum(n for _, _, n in got) / len(item)
                if share >= covered:
                    rows.append((r.doc, r.item, share, len(got), got[0][2], [[p, int(at[d]), n] for p, d, n in got]))
            yield pd.DataFrame(rows, columns=["doc", "item", "coverage", "tiles", "longest", "spans"])
    tiled = tables.keep(pairs.select("doc", "item").join(texts.drop("seeds"), "doc")
                        .join(known.select("item", F.col("words").alias("item_words")), "item")
                        .mapInPandas(tile, "doc binary, item binary, coverage double, tiles int, longest int, spans array<array<int>>"))
    return (tiled.join(told.select("item_id", "item"), "item").join(met.select("doc_id", "doc"), "doc")
            .select("doc_id", "item_id", "coverage", "tiles", "longest", "spans"))
