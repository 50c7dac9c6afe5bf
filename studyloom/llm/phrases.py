"""Phrase mining over direct-address tiles of frequency-ranked word numbers.

Words that occur often enough are numbered by descending frequency. Bands of neighbouring numbers cut the plane of pairs into tiles: the
bands are an eighth of an octave wide where words are frequent, so that they hold similar shares of the text, and 4,096 numbers where they are rare. A block of text
counts its own pairs first; a tile then adds up the counts of all blocks, in one dense array where it has about as many entries as cells, and as
sorted coordinates where it is sparse. Frequent pairs are numbered by frequency in turn and take the place of the left word: the same
step counts (pair, word), which are phrases of three words.

Tiles are dealt to parts by hash. A block sends a pair once, however often it holds it, so one very frequent pair is one entry a block.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from studyloom.llm import packed
from studyloom.llm.tables import Scratch
from studyloom.llm.words import mix

#: Entries in a part; cells of a dense tile at most, and entries below which a tile is not worth an array of its own; width of a band of rare words.
PART, CELLS, DENSE, WIDE = 1 << 19, 1 << 20, 256, 1 << 12
#: Ends a piece. No byte of UTF-8 text.
_END = b"\xff"
_MAP = bytes(255 if chr(c) in ".,;:!?\n\v\f\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: First numbers of the bands, as far as their width grows.
_EDGES = np.unique(np.floor(2 ** (np.arange(0, 8 * 15 + 1) / 8)).astype(np.int64) - 1)
_LOW = np.int64((1 << 32) - 1)


def pieces(text):
    """Words of a text's bytes with A-Z folded; ``\\xff`` stands behind every piece."""
    return (text.translate(_MAP).replace(_END, b" \xff ") + b" \xff").split()


def _band(number):
    last = len(_EDGES) - 1
    return np.where(number < _EDGES[-1], np.searchsorted(_EDGES, number, "right") - 1, last + (number - _EDGES[-1]) // WIDE)


def _edges(band):
    """(first number, width) of a band."""
    last = len(_EDGES) - 1
    if band < last:
        return int(_EDGES[band]), int(_EDGES[band + 1] - _EDGES[band])
    return int(_EDGES[-1] + (band - last) * WIDE), WIDE


def _tile(left, right):
    return np.stack([left >> 32, _band(left & _LOW), _band(right)])


def _parts(tag, left, right, n):
    """Part of each entry, by its tile and language."""
    h = np.full(len(left), np.uint64(int.from_bytes(tag.encode()[:8].ljust(8), "little")))
    for x in _tile(left, right):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + x.astype(np.uint64))
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def added(left, right, count, tag):
    """Sum of the counts that stand at each entry's (tag, left, right), tile by tile."""
    keys = np.stack([*_tile(left, right), tag])
    order = np.lexsort(keys)
    new = np.concatenate([[True], (np.diff(keys[:, order], axis=1) != 0).any(axis=0)])
    heads = np.flatnonzero(new)
    out, sparse = np.zeros(len(left), np.int64), []
    for a, b in zip(heads.tolist(), np.append(heads[1:], len(order)).tolist()):
        at = order[a:b]
        (x, w), (y, h) = _edges(int(keys[1, at[0]])), _edges(int(keys[2, at[0]]))
        if b - a >= DENSE and w * h <= min(CELLS, 16 * (b - a)):
            cell = ((left[at] & _LOW) - x) * h + right[at] - y
            out[at] = np.bincount(cell, count[at], w * h).astype(np.int64)[cell]
        else:
            sparse.append(at)
    if sparse:
        at = np.concatenate(sparse)
        at = at[np.lexsort((right[at], left[at], tag[at]))]
        new = np.concatenate([[True], (np.diff(left[at]) != 0) | (np.diff(right[at]) != 0) | (np.diff(tag[at]) != 0)])
        which = np.cumsum(new) - 1
        out[at] = np.bincount(which, count[at]).astype(np.int64)[which]
    return out


_SENT = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("tag", pa.string()), ("left", pa.binary()), ("right", pa.binary()), ("count", pa.binary())])
_SENT_SQL = "part bigint, block bigint, tag string, left binary, right binary, count binary"


class _Ranked:
    """A block's words as numbers by frequency, -1 for rare ones and ends of pieces; its pairs, and its phrases of three words."""

    def __init__(self, row, n):
        get = lambda name: row.column(name)[0].as_py()
        self.block, self.tag, self.n = get("block"), get("tag"), n
        ranks = np.frombuffer(get("ranks"), np.int32).astype(np.int64)
        self.word = ranks[packed.unpacked_ids(get("ids"), get("n_words"), len(ranks))]

    def pairs(self):
        """(entries, for each place the index of its pair among them or -1)."""
        a, b = self.word[:-1], self.word[1:]
        both = np.flatnonzero((a >= 0) & (b >= 0))
        return self._entries(a[both] << 32 | b[both], both, lambda key: key >> 32)

    def _entries(self, key, places, left_of):
        u, which, count = np.unique(key, return_inverse=True, return_counts=True)
        left, right = left_of(u), u & _LOW
        part = _parts(self.tag, left, right, self.n)
        order = np.argsort(part, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        at = np.full(max(0, len(self.word) - 1), -1, np.int64)
        at[places] = back[which]
        return (left[order], right[order], count[order], part[order]), at

    def triples(self, phrase, at):
        """Entries (number of the left pair, word). ``phrase``: number of each pair, -1 where it is rare."""
        first, second = at[:-1], at[1:]
        known = np.flatnonzero((first >= 0) & (second >= 0))
        known = known[(phrase[first[known]] >= 0) & (phrase[second[known]] >= 0)]
        return self._entries(first[known] << 32 | self.word[known + 2], known, lambda key: phrase[key >> 32])[0]

    def rows(self, entries):
        left, right, count, part = entries
        return [{"part": p, "block": self.block, "tag": self.tag, "left": left[s].tobytes(), "right": right[s].astype(np.int32).tobytes(),
                 "count": count[s].astype(np.int32).tobytes()} for p, s in packed.sliced(part)]


def _frequent(least):
    """Step over one part: numbers of the frequent entries for every block that sent some; and these entries themselves as block -1."""
    kinds = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("tag", pa.string()), ("number", pa.binary()), ("left", pa.binary()), ("right", pa.binary()), ("total", pa.binary())])

    def run(table):
        read = lambda name, kind: [np.frombuffer(x.as_py(), kind) for x in table.column(name)]
        left, tags = read("left", np.int64), table.column("tag").to_pylist()
        size = [len(x) for x in left]
        names = sorted(set(tags))
        tag = np.repeat([names.index(t) for t in tags], size)
        left, right, count = np.concatenate(left), np.concatenate(read("right", np.int32)).astype(np.int64), np.concatenate(read("count", np.int32))
        total = added(left, right, count, tag)
        some = np.flatnonzero(total >= least)
        some = some[np.lexsort((right[some], left[some], tag[some], -total[some]))]
        new = np.ones(len(some), bool)
        new[1:] = (np.diff(left[some]) != 0) | (np.diff(right[some]) != 0) | (np.diff(tag[some]) != 0)
        number = np.full(len(left), -1, np.int32)
        number[some] = np.cumsum(new) - 1
        part = table.column("part")[0].as_py()
        rows = [{"part": part, "block": b, "number": x.tobytes()} for b, x in zip(table.column("block").to_pylist(), np.split(number, np.cumsum(size)[:-1]))]
        heads = some[new]
        for i, name in enumerate(names):
            at = heads[tag[heads] == i]
            rows.append({"part": part, "block": -1, "tag": name, "number": number[at].tobytes(), "left": left[at].tobytes(),
                         "right": right[at].tobytes(), "total": total[at].tobytes()})
        return pa.Table.from_pylist(rows, kinds)
    return run


_FOUND_SQL = "part bigint, block bigint, tag string, number binary, left binary, right binary, total binary"


def _listed(found):
    """Rows (tag, id, left, right, a) of the frequent entries."""
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda name, kind: np.frombuffer(batch.column(name)[i].as_py(), kind).astype(np.int64)  # noqa: E731, B023
                number = get("number", np.int32)
                yield pa.record_batch({"tag": pa.array([batch.column("tag")[i].as_py()] * len(number), pa.string()), "id": pa.array(number | batch.column("part")[i].as_py() << 32),
                                       "left": pa.array(get("left", np.int64)), "right": pa.array(get("right", np.int64)), "a": pa.array(get("total", np.int64))})
    return found.where("block = -1").mapInArrow(run, "tag string, id bigint, left bigint, right bigint, a bigint")


def _numbered(counts, tables):
    """Add ``rank`` (from 0 in each tag, by descending count): places in a sorted table, less where the tag begins."""
    kept = tables.keep(counts.orderBy("tag", F.desc("f"), "word").withColumn("__at", F.monotonically_increasing_id()))
    part, at = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    kept = kept.select("tag", "word", "f", part.alias("__part"), at.alias("__at"))
    run = kept.groupBy("tag", "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy("tag").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    run = run.select("tag", "__part", (before - F.col("__first")).alias("__less"))
    return kept.join(run, ["tag", "__part"]).select("tag", "word", "f", (F.col("__at") + F.col("__less")).alias("rank"))


def mine(spark, docs, least=10, share=50, top=2000, text_col="text", lang_col="lang"):
    """Best phrases of two and three words per language: lang, rank, phrase, a, l, r, n, score.

    ``a``: occurrences within pieces (texts are cut at ``.,;:!?`` and line ends), at least ``least``; ``l`` and ``r``: those of the two parts of the cut with the
    lowest floor(10^6 a a / (l r)), the first of equal ones; ``n``: words of the language. A phrase gives way to a longer one that
    holds it and has ``share`` percent of its occurrences. NULL languages are ``und``, NULL texts empty; nothing else is read of the table, and an empty one gives no rows.
    """
    tables = Scratch(spark)
    tagged = docs.selectExpr("cast(null as bigint) id", f"{text_col} text", f"coalesce({lang_col}, 'und') tag")
    blocks = tables.keep(packed.pack(tagged, "id", "text", pieces, "tag"))

    def dictionary(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                b = packed.Block(batch.slice(i, 1))
                count = np.bincount(b.ids, minlength=len(b.words))
                at = np.array([j for j, w in enumerate(b.words) if w != _END], np.int64)
                yield pa.record_batch({"tag": pa.array([b.tag] * len(at), pa.string()), "word": pa.array([b.words[j] for j in at.tolist()], pa.binary()),
                                       "block": pa.array([b.block] * len(at), pa.int64()), "at": pa.array(at), "count": pa.array(count[at])})
    words = blocks.mapInArrow(dictionary, "tag string, word binary, block bigint, at bigint, count bigint")
    counts = tables.keep(words.groupBy("tag", "word").agg(F.sum("count").alias("f")))
    size = counts.groupBy("tag").agg(F.sum("f").alias("n"))
    ranks = tables.keep(_numbered(counts.where(F.col("f") >= least), tables))
    parts = packed.parts(blocks.agg(F.sum("n_words")).first()[0], PART)

    def numbered(block, known):
        b = packed.Block(block)
        rank = np.full(len(b.words), -1, np.int32)
        rank[known.column("at").to_numpy()] = known.column("rank").to_numpy()
        return pa.table({"block": block.column("block"), "tag": block.column("tag"), "n_words": block.column("n_words"), "ids": block.column("ids"), "ranks": pa.array([rank.tobytes()], pa.binary())})
    known = words.select("tag", "word", "block", "at").join(ranks.select("tag", "word", "rank"), ["tag", "word"]).select("block", "at", "rank")
    ranked = tables.keep(blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(numbered, "block bigint, tag string, n_words bigint, ids binary, ranks binary"))
    tables.drop(blocks)

    def pairs(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                b = _Ranked(batch.slice(i, 1), parts)
                yield pa.RecordBatch.from_pylist(b.rows(b.pairs()[0]), _SENT)

    def triples(block, found):
        if not block.num_rows:
            return pa.Table.from_pylist([], _SENT)
        b = _Ranked(block, parts)
        _, at = b.pairs()
        found = found.take(pa.compute.sort_indices(found, sort_keys=[("part", "ascending")]))
        phrase = [np.zeros(0, np.int64)]
        for p, x in zip(found.column("part").to_pylist(), found.column("number")):
            number = np.frombuffer(x.as_py(), np.int32).astype(np.int64)
            phrase.append(np.where(number < 0, -1, number | p << 32))
        return pa.Table.from_pylist(b.rows(b.triples(np.concatenate(phrase), at)), _SENT)

    def totals(sent):
        return tables.keep(sent.groupBy("part").applyInArrow(_frequent(least), _FOUND_SQL))
    two = totals(ranked.mapInArrow(pairs, _SENT_SQL))
    three = totals(ranked.groupBy("block").cogroup(two.where("block >= 0").groupBy("block")).applyInArrow(triples, _SENT_SQL))
    pair = _listed(two).select("tag", "id", F.col("left").alias("i"), F.col("right").alias("j"), "a")
    triple = _listed(three).select("tag", F.col("left").alias("id"), F.col("right").alias("k"), "a")
    return _best(tables, tables.keep(pair), triple, ranks, size, share, top)


def _score(a, l, r):
    """floor(10^6 a a / (l r)) in exact arithmetic."""
    d = lambda c: f"cast({c} as decimal(18,0))"
    return F.expr(f"(cast(1000000 as decimal(7,0)) * {d(a)} * {d(a)}) div ({d(l)} * {d(r)})")


#: Slices of a language whose best phrases are taken before they meet.
SLICES = 64


def _best(tables, pair, triple, ranks, size, share, top):
    times = lambda c: ranks.select("tag", F.col("rank").alias(c), F.col("f").alias(f"f_{c}"))
    whole = (triple.join(pair.select("tag", "id", "i", "j", F.col("a").alias("f_ij")), ["tag", "id"])
             .join(pair.select("tag", F.col("i").alias("j"), F.col("j").alias("k"), F.col("a").alias("f_jk")), ["tag", "j", "k"]))
    inside = (whole.select("tag", "i", "j", "a").unionByName(whole.select("tag", F.col("j").alias("i"), F.col("k").alias("j"), "a"))
              .groupBy("tag", "i", "j").agg(F.max("a").alias("longer")))
    two = (pair.join(inside, ["tag", "i", "j"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
           .join(times("i"), ["tag", "i"]).join(times("j"), ["tag", "j"])
           .select("tag", "i", "j", F.lit(None).cast("bigint").alias("k"), "a", F.col("f_i").alias("l"), F.col("f_j").alias("r"), _score("a", "f_i", "f_j").alias("score")))
    three = (whole.join(times("i"), ["tag", "i"]).join(times("k"), ["tag", "k"])
             .withColumn("one", _score("a", "f_i", "f_jk")).withColumn("two", _score("a", "f_ij", "f_k")))
    early = F.col("one") <= F.col("two")
    three = three.select("tag", "i", "j", "k", "a", F.when(early, F.col("f_i")).otherwise(F.col("f_ij")).alias("l"),
                         F.when(early, F.col("f_jk")).otherwise(F.col("f_k")).alias("r"), F.least("one", "two").alias("score"))
    found = tables.keep(two.unionByName(three))
    # scores are whole numbers up to a million: the least one that can still be among the first comes from a histogram of bounded size
    high = F.sum("n").over(W.partitionBy("tag").orderBy(F.desc("score"))) - F.col("n")
    least = found.groupBy("tag", "score").agg(F.count("*").alias("n")).withColumn("high", high).where(F.col("high") < top).groupBy("tag").agg(F.min("score").alias("least"))
    word = lambda c: ranks.select("tag", F.col("rank").alias(c), F.col("word").cast("string").alias(f"w_{c}"))
    near = found.join(least, "tag").where(F.col("score") >= F.col("least"))
    near = near.join(word("i"), ["tag", "i"]).join(word("j"), ["tag", "j"]).join(word("k"), ["tag", "k"], "left")
    near = near.withColumn("slice", F.pmod(F.xxhash64("i", "j", "k"), F.lit(SLICES))).withColumn("phrase", F.concat_ws(" ", "w_i", "w_j", "w_k"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    near = near.withColumn("rank", F.row_number().over(W.partitionBy("tag", "slice").orderBy(*order))).where(F.col("rank") <= top)
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("tag").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(size, "tag").select(F.col("tag").alias("lang"), "rank", "phrase", "a", "l", "r", "n", "score")
