"""Toxicity by class-conditional Kneser-Ney bigram models.

Each class (toxic, ordinary) has an interpolated absolute-discount bigram model over a class unigram model. Both orders count
contexts, not occurrences: a hundred copies of one document are no more evidence than one. Both classes back off to the same
continuation counts: in how many contexts a word follows anything, gathered over all documents. A word or expression that a
class has hardly seen is thus judged by counts that both classes share, and says nothing either way.

Words and pairs are 64-bit hashes, each counted for itself. Only words of the labelled rows can tell the classes apart: any other
word has the same chance in both, so a model holds the words of the labelled rows and their exact counts over all documents. A document's
features are length-normalised log-likelihood ratios (of the whole text, and of its most suspicious stretch of words); a
logistic curve, fitted on labelled rows that the counts have not seen, turns them into a score.
"""
import uuid
import zlib

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import functions as F

from studyloom.llm.held import keep, release
from studyloom.llm.tables import Scratch
from studyloom.llm.words import groups, mix, owners, word_hashes

#: Buckets of ``context_keys`` and of a model that is filled without a list of words.
WORD_BITS, PAIR_BITS = 20, 22
#: What may be taken off every count (all of it, if it is less); the value that fits unseen labelled rows best is used.
DISCOUNTS = (2, 3, 6, 10)
#: Words in a stretch.
STRETCH = 2


def _pair(before, word):
    return mix((before * np.uint64(0x9E3779B97F4A7C15) + word) * np.uint64(0x9E3779B97F4A7C15))


def _words(texts):
    """Per group of texts: (first, words, words before (0 at the start), pairs of both, text of each word, number of texts), as 64-bit hashes."""
    for first, folded in groups(texts):
        h, offs = word_hashes(folded)
        own = owners(offs)
        before = np.concatenate([h[:1], h[:-1]])
        starts = np.concatenate([[True], own[1:] != own[:-1]])[:len(h)]
        before = np.where(starts, np.uint64(0), before)
        pair = _pair(before, h)
        yield first, h, before, pair, own, len(folded)


def _counted(keys):
    k, n = np.unique(keys, return_counts=True)
    return k.astype(np.int64), n.astype(np.int64)


def _bucket(h, bits=WORD_BITS):
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def index(known):
    """(sorted hashes, first place of each range of hashes, bits of a range): what ``find`` looks in."""
    bits = max(1, len(known)).bit_length() + 2
    return known, np.searchsorted(known >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32), bits


def find(table, h):
    """Place of each hash among the known ones; their number if it is none of them."""
    known, first, bits = table
    out = np.full(len(h), len(known), np.int64)
    span = _bucket(h, bits)
    at, end, open_ = first[span], first[span + 1], np.arange(len(h))
    while len(open_):
        inside = at < end
        at, end, open_ = at[inside], end[inside], open_[inside]
        same = known[at] == h[open_]
        out[open_[same]] = at[same]
        at, end, open_ = at[~same] + 1, end[~same], open_[~same]
    return out


def _rows_of_bytes(k):
    """Sorted keys as differences, compressed. Bytes of one rank stand together: the upper ones are nearly all alike."""
    steps = np.diff(k, prepend=np.uint64(0))
    return zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _keys_of(rows):
    planes = np.frombuffer(zstandard.decompress(rows), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _dealt(keys, part, parts):
    """(part, keys of it) for each part that has any; keys keep their order."""
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
    return [(p, keys[order[a:b]]) for p, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]


def contexts_of(docs, text_col, parts, words):
    """(word, contexts): in how many contexts each of the sorted hashes ``words`` occurs over all documents.

    ``word`` is the place in ``words``; the last place, their number, counts the pairs of all other words. Pairs of two listed
    words are counted by their places, exactly; they are dealt to the cells of a grid over both places, so a common word is
    spread over a row or column of cells, and within a cell the sorted keys differ by little. A pair with another word in it
    has the place of its word and the rest of 64 bits (over 40) of its hash as its key, and is dealt by the hash.
    """
    many = np.uint64(max(1, len(words)))
    side = np.uint64(max(1, round(parts ** 0.5)))
    cells, across = int(side * side), many // side + np.uint64(1)
    width = np.uint64(64 - len(words).bit_length())
    low = (np.uint64(1) << width) - np.uint64(1)
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def seen(frames):
        release()
        both, other, size, table = [], [], 0, index(shared.value)
        begin = find(table, np.zeros(1, np.uint64))[0]
        for pdf in frames:
            for _, h, _, pair, own, _ in _words(pdf["text"]):
                word = find(table, h).astype(np.uint64)
                before = np.where(np.concatenate([[True], own[1:] != own[:-1]])[:len(own)], np.uint64(begin), np.concatenate([word[:1], word[:-1]]))
                listed = (word < len(words)) & (before < len(words))
                both.append(np.unique(word[listed] * many + before[listed]))
                other.append(np.unique(word[~listed] << width | pair[~listed] & low))
                size += len(both[-1]) + len(other[-1])
                if size > 1_000_000:
                    yield from cut(both, other)
                    both, other, size = [], [], 0
        yield from cut(both, other)

    def cut(both, other):
        both, other = (np.unique(np.concatenate(k)) if k else np.zeros(0, np.uint64) for k in (both, other))
        word, before = both // many, both % many
        row, column = word * side // many, before * side // many
        inside = word * across + before - (column * many + side - np.uint64(1)) // side
        rows = [(p, _rows_of_bytes(k)) for p, k in _dealt(inside, row * side + column, cells)]
        part = ((other & low) >> (width - np.uint64(24))) * np.uint64(parts) >> np.uint64(24)
        rows += [(cells + p, _rows_of_bytes(k)) for p, k in _dealt(other, part, parts)]
        if rows:
            yield pd.DataFrame(rows, columns=["part", "keys"])

    def total(pdf):
        keys = np.unique(np.concatenate([_keys_of(k) for k in pdf["keys"]]))
        word, n = _counted(keys // across if pdf["part"].iloc[0] < cells else keys >> width)
        return pd.DataFrame({"word": word, "contexts": n})
    return (docs.select(F.col(text_col).alias("text")).mapInPandas(seen, "part int, keys binary")
            .groupBy("part").applyInPandas(total, "word bigint, contexts bigint").groupBy("word").agg(F.sum("contexts").alias("contexts")))


def _before_that(before, own):
    """The word before the word before; 0 if the text has none."""
    return np.where(np.concatenate([[True], own[1:] != own[:-1]])[:len(own)], before.dtype.type(0), np.concatenate([before[:1], before[:-1]]))


def context_keys(texts, y):
    """[(kind, class, distinct keys in buckets)]: words with the word before (kind 0), pairs with the word before them (kind 1)."""
    out = []
    for first, word, before, pair, own, n in _words(texts):
        cls = np.asarray(y)[first:first + n][own]
        word, before = _bucket(word), _bucket(before)
        for kind, keys in ((0, word << WORD_BITS | before), (1, before << PAIR_BITS + WORD_BITS | _bucket(pair, PAIR_BITS) << WORD_BITS | _before_that(before, own))):
            out += [(kind, c, np.unique(keys[cls == c])) for c in (0, 1)]
    return out


def _vocabulary(rows):
    """The words of the labelled rows as sorted hashes; 0, the start of a text, is one of them."""
    def part(frames):
        for pdf in frames:
            for _, word, *_ in _words(pdf["text"]):
                yield pd.DataFrame({"k": np.unique(word).view(np.int64)})

    def pack_words(pdf):
        return pd.DataFrame([(pdf["k"].to_numpy(np.int64).tobytes(),)], columns=["ks"])
    got = rows.mapInPandas(part, "k bigint").distinct().groupBy(F.pmod("k", F.lit(64))).applyInPandas(pack_words, "ks binary").collect()
    return np.unique(np.concatenate([np.zeros(1, np.uint64), *[np.frombuffer(r.ks, np.uint64) for r in got]]))


def _class_counts(rows, words):
    """Context counts over the labelled rows: (kind, ks, ns) with the counts of both classes per key; of all totals for kind 2.

    Keys are places in ``words``: a word (kinds 0 and 2), or the word before and the word (kind 1).
    """
    shared = rows.sparkSession.sparkContext.broadcast(words)

    def part(frames):
        table = index(shared.value)
        for pdf in frames:
            for first, word, before, _, own, n in _words(pdf["text"]):
                word, before = find(table, word), find(table, before)
                yield pd.DataFrame({"c": pdf["y"].to_numpy()[first:first + n][own], "k": before << 32 | word,
                                    "x": _before_that(before, own)}).drop_duplicates()
    got = rows.mapInPandas(part, "c int, k bigint, x int").distinct().groupBy("c", "k").agg(F.count("*").cast("double").alias("n"))
    by_class = lambda e: [F.coalesce(F.sum(F.when(F.col("c") == c, e)), F.lit(0.0)) for c in (0, 1)]
    # kind 2: all contexts of what follows a word, and what each discount takes off them
    totals = [F.col("n")] + [F.least(F.col("n"), F.lit(float(d))) for d in DISCOUNTS]
    word = got.groupBy(F.lit(0).alias("kind"), F.col("k").bitwiseAND((1 << 32) - 1).alias("k")).agg(F.array(*by_class(F.lit(1.0))).alias("v"))
    # a pair that every discount takes off whole needs no place
    slots = got.where(F.col("n") > min(DISCOUNTS)).groupBy(F.lit(1).alias("kind"), "k").agg(F.array(*by_class(F.col("n"))).alias("v"))
    sides = got.groupBy(F.lit(2).alias("kind"), F.shiftright("k", 32).alias("k")).agg(F.array(*[x for t in totals for x in by_class(t)]).alias("v"))
    return (word.unionByName(slots).unionByName(sides).groupBy("kind", F.pmod("k", F.lit(64)).alias("part"))
            .applyInPandas(_pack, "kind int, ks binary, ns binary"))


def _pack(pdf):
    return pd.DataFrame([(int(pdf["kind"].iloc[0]), pdf["k"].to_numpy(np.int64).tobytes(), np.concatenate(pdf["v"].to_list()).astype(float).tobytes())],
                        columns=["kind", "ks", "ns"])


def fit_counts(rows, contexts):
    """Counts by (kind, class) and shared contexts, packed. rows: (text, y) of the labelled rows; contexts: of a list of words, as ``contexts_of``."""
    words = _vocabulary(rows)
    got = {}
    for r in _class_counts(rows, words).collect():
        k = np.frombuffer(r.ks, np.int64)
        got.setdefault(r.kind, []).append((k, np.frombuffer(r.ns).reshape(len(k), -1)))
    got = {kind: [np.concatenate(x) for x in zip(*many)] for kind, many in got.items()}
    pairs = np.zeros(0, np.uint64)
    if 1 in got:
        k, n = got[1]
        h = _pair(words[k >> 32], words[k & 0xFFFFFFFF])
        order = np.argsort(h)
        pairs, got[1] = h[order], (np.arange(len(h)), n[order])
    counts = [(kind + i // 2, i % 2, k, n[:, i]) for kind, (k, n) in got.items() for i in range(n.shape[1])]
    seen = (contexts(words).groupBy(F.pmod("word", F.lit(64)).alias("part"))  # no more than the words of the labelled rows, and one
            .applyInPandas(_pack_contexts, "ks binary, ns binary").collect())
    return pack(filled(counts, [(np.frombuffer(r.ks, np.int64), np.frombuffer(r.ns, np.int64)) for r in seen], words, pairs))


def _pack_contexts(pdf):
    return pd.DataFrame([(pdf["word"].to_numpy(np.int64).tobytes(), pdf["contexts"].to_numpy(np.int64).tobytes())], columns=["ks", "ns"])


def filled(counts, seen, words=None, pairs=None):
    """Arrays by (kind, class): of places among ``words`` and ``pairs`` and one for all others, or of word buckets and no pairs."""
    size = 1 << WORD_BITS if words is None else len(words) + 1
    pairs = np.zeros(0, np.uint64) if pairs is None else pairs
    m = {(k, c): np.zeros(len(pairs) + 1 if k == 1 else size, np.int32) for k in range(3 + len(DISCOUNTS)) for c in (0, 1)}
    for kind, c, k, n in counts:
        m[kind, c][k] = n
    m["pairs"] = pairs
    if words is not None:
        m["words"] = words
    m["shared"] = np.zeros(size, np.int64)
    for k, n in seen:
        m["shared"][k] = n
    return m


def pack(m):
    """(token, compressed arrays): most counts are 0 or small, and every executor keeps a copy of what is broadcast."""
    return uuid.uuid4().hex, {k: (str(v.dtype), zlib.compress(v.tobytes(), 1)) for k, v in m.items()}


def unpacked(packed, which):
    """The model of packed counts and a discount; a worker keeps the last one it has made."""
    token, arrays = packed
    return keep((token, which), lambda: assemble({k: np.frombuffer(zlib.decompress(z), t) for k, (t, z) in arrays.items()}, which))


def assemble(m, which):
    """The model that takes DISCOUNTS[which] off every count."""
    d = DISCOUNTS[which]
    shared = m["shared"] + 0.5
    shared /= shared.sum()
    # what the discount takes off goes to the shared counts, with one weight for both classes: what neither class knows says nothing
    words = [m[0, c] for c in (0, 1)]
    whole = [max(1.0, float(w.sum(dtype=np.float64))) for w in words]
    spare = sum(float(np.minimum(w, d).sum(dtype=np.float64)) for w in words) / sum(whole) if any(w.any() for w in words) else 1.0
    after = m[2, 0] + m[2, 1]
    model = {"pairs": index(m["pairs"]), "words": index(m["words"]) if "words" in m else None, "rest": np.where(after > 0, (m[3 + which, 0] + m[3 + which, 1]) / np.maximum(after, 1), 1).astype(np.float32)}
    for c in (0, 1):
        model["uni", c] = (np.maximum(words[c] - d, 0) / whole[c] + spare * shared).astype(np.float32)
        model["pair", c] = np.maximum(m[1, c] - d, 0).astype(np.float32)
        model["before", c] = np.maximum(m[2, c], 1).astype(np.float32)
    return model


def ratios(model, word, before, pair):
    """Per word: log of its chance after the word before it in the toxic class, less that in the ordinary class."""
    word, before = (_bucket(h) if model["words"] is None else find(model["words"], h) for h in (word, before))
    place = find(model["pairs"], pair)
    p = [model["pair", c][place] / model["before", c][before] + model["rest"][before] * model["uni", c][word] for c in (0, 1)]
    return np.log(p[1]) - np.log(p[0])


def features(model, texts):
    """Per text: mean log-likelihood ratio of its words, mean over its most suspicious STRETCH of words, log of its length."""
    out = np.zeros((len(texts), 3))
    for first, word, before, pair, own, n in _words(texts):
        r = ratios(model, word, before, pair).astype(float)
        words = np.bincount(own, minlength=n)
        o = out[first:first + n]
        o[:, 0] = np.bincount(own, weights=r, minlength=n) / np.maximum(words, 1)
        if len(r):
            # a stretch never reaches into the next text: there it ends early, but is divided by the full length
            c = np.concatenate([[0], np.cumsum(r)])
            begin = np.concatenate([[0], np.cumsum(words)[:-1]])
            end = np.minimum(np.arange(len(r)) + STRETCH, (begin + words)[own])
            s = (c[end] - c[:-1]) / STRETCH
            some = words > 0
            o[some, 1] = np.maximum(np.maximum.reduceat(s, begin[some]), 0)
        o[:, 2] = np.log1p(words)
    return out


def logistic(x, y, ridge=1e-2, rounds=50):
    """(log loss, mean, deviation, weights) of a ridge logistic regression on standardised columns; the intercept comes last."""
    mean, dev = x.mean(axis=0), np.maximum(x.std(axis=0), (1e-3, 1e-3, 0.5))  # lengths alike in the sample must not decide
    z = np.column_stack([(x - mean) / dev, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(z @ w, -30, 30))), 1e-9, 1 - 1e-9)
    return -float(np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))), mean, dev, w


def _sample(labels, fold, most):
    """The first ``most`` rows of each class in hash order: a bounded, repeatable sample of labelled ids."""
    picks = [labels.where(fold).where(F.col("y") == c).orderBy(F.xxhash64("id"), "id").limit(most) for c in (0, 1)]
    return picks[0].unionByName(picks[1])


def scorer(spark, docs, labels, id_col, text_col, label_col, train, calibrate, most=6000, rows_per_part=4000):
    """A function from a text column to a column of scores (0 to 1, at least 0.5: toxic), fitted on ``docs`` and ``labels``.

    ``train`` and ``calibrate`` take the id column and give a boolean: rows whose labels may be used, and among them those
    that fit the curve rather than the counts. ``most`` bounds the labelled rows per class and use. Labels: 1 or 0 per id
    (several rows of an id: the majority, a tie is 1; NULLs ignored). NULL or empty texts get the features of no words.
    Without labelled rows of both classes every score is 0.5 less a little, and nothing is predicted toxic.
    """
    tables = Scratch(spark)
    key = F.col(id_col).cast("bigint")
    truth = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(key.alias("id"))
             .agg((F.avg(label_col) >= 0.5).cast("int").alias("y")).where(F.coalesce(train(F.col("id")), F.lit(False))))
    tuned = F.coalesce(calibrate(F.col("id")), F.lit(False))
    ids = tables.keep(_sample(truth, ~tuned, most).withColumn("use", F.lit(0)).unionByName(_sample(truth, tuned, most).withColumn("use", F.lit(1))))
    picked = tables.keep(docs.select(key.alias("id"), F.col(text_col).alias("text"))
                         .join(F.broadcast(ids), "id")  # at most 4 * most ids
                         .groupBy("id", "y", "use").agg(F.min("text").alias("text")).select("text", "y", "use"))
    share = truth.where(tuned).agg(F.avg("y")).first()[0]
    have = {(r.y, r.use) for r in picked.select("y", "use").distinct().collect()}
    if len(have) < 4:
        return lambda column: F.lit(0.49)
    parts = max(8, -(-docs.count() // rows_per_part))
    counts = spark.sparkContext.broadcast(fit_counts(picked.where("use = 0").repartition(max(8, most // 500)),
                                                    lambda words: contexts_of(docs, text_col, parts, words)))

    def measure(frames):
        frames = list(frames)  # a share of the bounded sample
        for which in range(len(DISCOUNTS)):
            model = unpacked(counts.value, which)
            for pdf in frames:
                yield pd.DataFrame({"which": which, "y": pdf["y"], "f": list(features(model, pdf["text"]))})
    seen = picked.where("use = 1").mapInPandas(measure, "which int, y int, f array<double>").toPandas()  # at most 2 * most rows for a discount
    fits = []
    for which, part in seen.groupby("which"):
        x, y = np.array(list(part["f"])), part["y"].to_numpy(float)
        # a text without any evidence is ordinary, whatever its length: rows that say so, a twentieth of the sample
        size = max(8, len(x) // 20)
        blank = np.column_stack([np.zeros((size, 2)), np.linspace(0, 12, size)])
        fits.append((*logistic(np.vstack([x, blank]), np.concatenate([y, np.zeros(len(blank))])), which))
        # both classes are sampled apart: put their true shares back
        fits[-1][3][-1] += np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    _, mean, dev, w, which = min(fits, key=lambda f: f[0])

    @F.pandas_udf("double")
    def judge(text: pd.Series) -> pd.Series:
        z = (features(unpacked(counts.value, which), text) - mean) / dev
        return pd.Series(1 / (1 + np.exp(-np.clip(z @ w[:-1] + w[-1], -50, 50))))
    return judge


def classify(spark, docs, labels, id_col, text_col, label_col, train, calibrate, **bounds):
    """(doc_id, held_out, score, predicted) of every row of ``docs``, as ``scorer`` has it; held_out: no row that ``train`` takes."""
    score = scorer(spark, docs, labels, id_col, text_col, label_col, train, calibrate, **bounds)
    key = F.col(id_col).cast("bigint")
    scored = docs.select(key.alias("doc_id"), (~F.coalesce(train(key), F.lit(False))).alias("held_out"), score(F.col(text_col)).alias("score"))
    return scored.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))
