"""Ranked lexical search: document intervals best first, bounded by range maxima over posting lists.

Documents are dealt into segments of a bounded number of postings, written once. A segment holds, for every word that a block of queries
asks for, its posting list and a sparse table over its impacts, so the greatest impact of a word within any interval of documents takes
two look-ups. For a query the sum of these maxima bounds every document of an interval. Intervals are opened best bound first, a few
at a time: short ones are scored in full, a longer one is split at the document of its largest maximum, which is scored. The search of
a segment ends when no interval's bound reaches the last place of the ranking held so far; equal scores never stop it, so the answer is
exact. A task carries its rankings from segment to segment and gives them out once.

Queries go in blocks of a bounded size (one block's words are sent to every task); each block reads the documents once.
"""
import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from studyloom.llm.tables import Scratch

#: Postings in a segment; bytes of query texts in a block; postings up to which an interval is scored in full; intervals opened at a time.
SEGMENT, BLOCK, LEAF, TAKEN = 1 << 18, 1 << 22, 512, 8
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_LAST = np.iinfo(np.int64).max


def terms(text):
    """Words of a text's bytes: runs of ASCII letters and digits and of all other non-ASCII characters; only A-Z is folded."""
    return text.translate(_FOLD).split()


def _segments(docs, vocabulary):
    """Rows of posting lists of the words in ``vocabulary`` (broadcast: word -> number)."""
    kinds = pa.schema([("n_docs", pa.int64()), ("n_words", pa.int64()), *((c, pa.binary()) for c in ("docs", "lens", "terms", "counts", "at", "tf"))])

    def row(ids, lens, lists):
        key, tf = np.unique(np.concatenate(lists), return_counts=True)
        term, count = np.unique(key >> 32, return_counts=True)
        packed = {"docs": np.array(ids, np.int64), "lens": np.array(lens, np.int64), "terms": term.astype(np.int32), "counts": count.astype(np.int32),
                  "at": (key & 0xFFFFFFFF).astype(np.int32), "tf": tf.astype(np.int32)}
        return pa.RecordBatch.from_pylist([{"n_docs": sum(map(bool, lens)), "n_words": sum(lens)} | {k: v.tobytes() for k, v in packed.items()}], kinds)

    def run(batches):
        known = vocabulary.value.get
        ids, lens, lists, held = [], [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = terms(text or b"")
                found = np.array([x for x in map(known, words) if x is not None], np.int64)
                lists.append(found << 32 | len(ids))
                ids.append(_LAST if i is None else i)
                lens.append(len(words))
                held += len(found) + 1
                if held >= SEGMENT:
                    yield row(ids, lens, lists)
                    ids, lens, lists, held = [], [], [], 0
        if ids:
            yield row(ids, lens, lists)
    return docs.mapInArrow(run, "n_docs bigint, n_words bigint, docs binary, lens binary, terms binary, counts binary, at binary, tf binary")


class _Segment:
    """Posting lists of one segment one behind the other, in ascending order of document ids, with impacts and a sparse table."""

    def __init__(self, row, weight, n, total):
        get = lambda name, kind: np.frombuffer(row.column(name)[0].as_py(), kind)
        docs, lens, count = get("docs", np.int64), get("lens", np.int64), get("counts", np.int32)
        order = np.argsort(docs, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.docs, self.n = docs[order], len(order)
        length = np.array([75 + 25 * x * n // max(1, total) for x in lens[order].tolist()], np.int64)
        self.rows = {t: i for i, t in enumerate(get("terms", np.int32).tolist())}
        self.ends = np.cumsum(count, dtype=np.int64)
        owner = np.repeat(np.arange(len(count)), count)
        key = owner * self.n + place[get("at", np.int32)]
        by = np.argsort(key)
        self.key = key[by]
        self.at, tf = self.key - owner * self.n, get("tf", np.int32).astype(np.int64)[by]
        self.value = weight[get("terms", np.int32)][owner] * (1000000000 * tf // (1000 * tf + 12 * length[self.at]))
        # level j: where the greatest of the 2**j values from a place on stands, the first of equal ones
        low = np.arange(len(key))
        levels = [low]
        while len(count) and 1 << len(levels) <= count.max():
            half = 1 << len(levels) - 1
            high = np.concatenate([low[half:], low[-half:]])
            low = np.where(self.value[high] > self.value[low], high, low)
            levels.append(low)
        self.table = np.concatenate(levels).astype(np.int32)
        self.log = np.zeros(len(key) + 2, np.int64)
        self.log[1:] = np.log2(np.arange(1, len(key) + 2)).astype(np.int64)

    def greatest(self, a, b):
        """(where the greatest value of the postings [a, b) stands, that value), for arrays of one shape; 0 where there is none."""
        some = b > a
        j = self.log[np.where(some, b - a, 1)]
        last = len(self.key) - 1
        x, y = (self.table[j * len(self.key) + np.clip(p, 0, last)] for p in (a, b - (1 << j)))
        at = np.where(self.value[y] > self.value[x], y, x)
        return at, np.where(some, self.value[at], 0)


def _search(seg, query, best, k):
    """Take one segment into ``best``, a heap of at most ``k`` (score, -doc_id). ``query``: [(word's number, times)]."""
    lists = [(seg.rows[t], times) for t, times in query if t in seg.rows]
    if not lists:
        return
    row, times = (np.array(x, np.int64) for x in zip(*lists))

    def enough(score):
        return len(best) < k or score >= best[0][0]

    def put(score, ordinal):
        entry = (score, -int(seg.docs[ordinal]))
        if len(best) < k:
            heapq.heappush(best, entry)
        elif entry > best[0]:
            heapq.heapreplace(best, entry)

    heap, made = [], 0

    def push(a, b):
        nonlocal made
        at, top = seg.greatest(a, b)
        top = top * times
        where = at[np.arange(len(at)), top.argmax(axis=1)]
        for i, bound in enumerate(top.sum(axis=1).tolist()):
            if bound > 0 and enough(bound):
                made += 1
                heapq.heappush(heap, (-bound, made, a[i], b[i], int(seg.at[where[i]])))

    ends = seg.ends[row]
    push(np.where(row > 0, seg.ends[row - 1], 0)[None, :], ends[None, :])
    last = len(seg.key) - 1
    while heap and enough(-heap[0][0]):
        lefts, rights = [], []
        for _ in range(TAKEN):
            if not heap or not enough(-heap[0][0]):
                break
            _, _, a, b, pivot = heapq.heappop(heap)
            size = b - a
            if size.sum() <= LEAF:
                at = np.arange(size.sum()) + np.repeat(a - np.cumsum(size) + size, size)
                found, which = np.unique(seg.at[at], return_inverse=True)
                score = np.zeros(len(found), np.int64)
                np.add.at(score, which, seg.value[at] * np.repeat(times, size))
                for i in np.flatnonzero(score >= (best[0][0] if len(best) == k else 1)).tolist():
                    put(int(score[i]), found[i])
                continue
            cut = np.searchsorted(seg.key, row * seg.n + pivot)
            inside = (cut < b) & (seg.at[np.minimum(cut, last)] == pivot)
            put(int((seg.value[np.minimum(cut, last)] * inside * times).sum()), pivot)
            lefts += [a, cut + inside]
            rights += [cut, b]
        if lefts:
            push(np.stack(lefts), np.stack(rights))


def search(spark, docs, items, k, doc_id="doc_id", doc_text="text", item_id="item_id", item_text="text"):
    """For each item its ``k`` best documents: item_id, rank (from 1), doc_id, score; only scores above 0, ties by ascending id, NULL ids last.

    A word's weight is floor(1000 ln((2N+2)/(2df+1))); the score sums weight * (10^9 tf div (1000 tf + 12 m)) over the item's words with repeats,
    where m = 75 + 25 n N div L, all of it in whole numbers. Rows that share an id are documents (or items) of their own. NULL and empty texts
    hold no word. Empty tables give no rows.
    """
    tables = Scratch(spark)
    rows = docs.selectExpr(f"cast({doc_id} as bigint) id", f"cast({doc_text} as binary) text")
    asked = tables.keep(items.selectExpr(f"cast({item_id} as bigint) item_id", f"cast({item_text} as binary) text").where("length(text) > 0")
                        .withColumn("q", F.monotonically_increasing_id()))
    blocks = -(-(asked.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK)
    out = [_block(spark, tables, rows, asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i), k) for i in range(blocks)]
    if not out:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    all_ = out[0]
    for more in out[1:]:
        all_ = all_.unionByName(more)
    place = W.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = all_.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return ranked.join(asked.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")


def _block(spark, tables, rows, asked, k):
    """(q, doc_id, score): the rankings that the tasks hold for one block of queries."""
    vocabulary, queries = {}, []
    for q, text in asked.select("q", "text").toLocalIterator():  # about BLOCK bytes of text
        times = {}
        for w in terms(bytes(text)):
            t = vocabulary.setdefault(w, len(vocabulary))
            times[t] = times.get(t, 0) + 1
        queries.append((q, list(times.items())))
    words = spark.sparkContext.broadcast(vocabulary)
    segments = tables.keep(_segments(rows, words))

    def counts(batches):
        for batch in batches:
            for t, c in zip(batch.column(0), batch.column(1)):
                yield pa.record_batch({"term": pa.array(np.frombuffer(t.as_py(), np.int32)), "df": pa.array(np.frombuffer(c.as_py(), np.int32))})

    n, total = segments.agg(F.sum("n_docs"), F.sum("n_words")).first()
    n, total = n or 0, total or 0
    weight = np.zeros(max(1, len(vocabulary)), np.int64)
    for t, df in segments.select("terms", "counts").mapInArrow(counts, "term int, df int").groupBy("term").agg(F.sum("df")).toLocalIterator():
        weight[t] = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
    shared = spark.sparkContext.broadcast((queries, weight))

    def run(batches):
        queries, weight = shared.value
        best = [[] for _ in queries]
        for batch in batches:
            for i in range(batch.num_rows):
                seg = _Segment(batch.slice(i, 1), weight, n, total)
                if len(seg.key):
                    for held, (_, query) in zip(best, queries):
                        _search(seg, query, held, k)
        got = [(q, -d, s) for (q, _), held in zip(queries, best) for s, d in held]
        for a in range(0, len(got), 10000):
            q, d, s = zip(*got[a:a + 10000])
            yield pa.record_batch({"q": pa.array(q, pa.int64()), "doc_id": pa.array([None if x == _LAST else x for x in d], pa.int64()), "score": pa.array(s, pa.int64())})

    found = tables.keep(segments.mapInArrow(run, "q bigint, doc_id bigint, score bigint"))
    tables.drop(segments)
    words.destroy()
    shared.destroy()
    return found
