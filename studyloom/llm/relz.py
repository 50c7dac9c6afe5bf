"""Substring dedup by relative Lempel-Ziv parsing: documents are factored against the text that stands before them.

The reference is dealt into packed blocks. Its index is sparse: of the ten-word grams of every window the one with the smallest hash is the
window's anchor, so equal windows have equal anchors, and only windows whose anchor stands in two places go on. Their 96-bit
hashes meet in parts of equal size, where each block learns the first place of each of its windows. A block then factors its
documents greedily: a factor runs on as long as the next window continues at the next word of the same earlier place. Where it
breaks, the windows across the boundary are judged by their own entries of the index, so none is lost.

A block sends a window once, however often it holds it, and parts are dealt by hash: a passage that every document shares costs one
entry a block. Documents without an id come last; rows that share an id are documents of their own, in no fixed order.
"""
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from studyloom.llm import packed
from studyloom.llm.tables import Scratch
from studyloom.llm.words import mix

#: Words in a window, and in a gram of it. The sums below are written for these two numbers.
WINDOW, GRAM = 20, 10
#: Entries in a part of the exchanges.
PART = 1 << 19
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LAST = np.iinfo(np.int64).max


def _pair(a, b):
    return mix(a * _STEP + b)


def _sums(h):
    """Hashes of the windows and of the grams from every word on, each sum made out of two shorter ones."""
    s2 = _pair(h[:-1], h[1:])
    s4 = _pair(s2[:-2], s2[2:])
    s8 = _pair(s4[:-4], s4[4:])
    s16 = _pair(s8[:-8], s8[8:])
    return _pair(s16[:-4], s4[16:]), _pair(s8[:-2], s2[8:])


def _over11(x, least):
    """Least or greatest of eleven neighbours from each place on."""
    for step in (1, 2, 4, 3):
        x = least(x[:-step], x[step:])
    return x


class _Hashed:
    """What every step derives anew from a block: window hashes, anchors, and the block's distinct anchors."""

    def __init__(self, b):
        n = len(b.ids)
        self.valid = np.zeros(max(0, n - WINDOW + 1), bool)
        self.distinct, self.several = np.zeros(0, np.uint64), np.zeros(0, bool)
        end = np.repeat(b.offs[1:], np.diff(b.offs))[:len(self.valid)]
        self.valid |= np.arange(len(self.valid)) + WINDOW <= end
        if not self.valid.any():
            return
        digest = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in b.words), np.uint64).reshape(-1, 2)
        self.one, grams = _sums(digest[b.ids, 0])
        self.two = digest[b.ids, 1]
        self.anchor = _over11(grams, np.minimum)
        reach = np.where(self.valid, self.anchor, np.uint64(0))
        reach = _over11(np.concatenate([np.zeros(10, np.uint64), reach, np.zeros(10, np.uint64)]), np.maximum)
        self.distinct, times = np.unique(grams[(grams == reach) & (reach > 0)], return_counts=True)
        self.several = times > 1

    def candidates(self, flags):
        """Windows whose anchor is flagged (one flag for each distinct anchor)."""
        if not len(self.distinct):
            return self.valid
        at = np.searchsorted(self.distinct, self.anchor)
        return self.valid & flags[np.minimum(at, len(flags) - 1)]

    def first(self, places):
        """(for each place the index of its window among the distinct ones, place of each distinct one, its two hashes)."""
        if not len(places):
            return np.zeros(0, np.int64), places, np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        one, two = self.one[places], (_sums(self.two)[0][places] >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((two, one))
        new = np.concatenate([[True], (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)])
        which = np.empty(len(places), np.int64)
        which[order] = np.cumsum(new) - 1
        firsts = order[new]
        return which, places[firsts], one[firsts], two[firsts]


def _part(h, n):
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _by_part(table):
    """Rows of one block, in ascending order of their part."""
    return table.take(pa.compute.sort_indices(table, sort_keys=[("part", "ascending")]))


def _starts(b, places):
    """(ordinal of the document, word in the document) of places in a block."""
    doc = np.searchsorted(b.offs, places, "right") - 1
    return doc, places - b.offs[doc]


def factors(spark, docs, id_col="doc_id", text_col="text", spans=True):
    """Per document: doc_id, n_words, n_removed, kept (words left, joined by a space), spans (its factors, in order).

    A span (start, length, ref_doc_id, ref_start) names ``length`` words that stand word for word from ``ref_start`` on in an earlier document, or
    earlier in the same one; spans may overlap across their boundaries. Words are separated by ASCII white space and otherwise taken
    unchanged; NULL texts have none. Whole texts are read; an empty table gives no rows; other columns are not looked at.
    """
    tables = Scratch(spark)
    blocks = tables.keep(packed.pack(docs, id_col, text_col, bytes.split))
    n = packed.parts(blocks.agg(F.sum("n_words")).first()[0], PART)

    def anchors(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                b = packed.Block(batch.slice(i, 1))
                h = _Hashed(b)
                rows = [{"part": p, "block": b.block, "keys": h.distinct[s].tobytes(), "bits": h.several[s].tobytes()}
                        for p, s in packed.sliced(_part(h.distinct, n))]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("part", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("bits", pa.binary())]))

    def shared(table):
        keys = [np.frombuffer(k.as_py(), np.uint64) for k in table.column("keys")]
        several = np.concatenate([np.frombuffer(k.as_py(), bool) for k in table.column("bits")])
        _, which, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        flag = (times > 1) | (np.bincount(which, several) > 0)
        bits = np.split(flag[which], np.cumsum([len(k) for k in keys])[:-1])
        return pa.table({"block": table.column("block"), "part": table.column("part"), "bits": pa.array([np.packbits(x).tobytes() for x in bits], pa.binary())})

    place = pa.schema([("block", pa.int64()), ("part", pa.int64()), ("size", pa.int64()), ("one", pa.binary()), ("two", pa.binary()), ("doc", pa.binary()), ("start", pa.binary())])

    def candidates(h, flags):
        cut = [s for _, s in packed.sliced(_part(h.distinct, n))]
        bits = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=s.stop - s.start).astype(bool) for s, x in zip(cut, _by_part(flags).column("bits"))]
        return np.flatnonzero(h.candidates(np.concatenate(bits) if bits else np.zeros(0, bool)))

    def windows(block, flags):
        """The first place of each candidate window of a block, by part."""
        b = packed.Block(block)
        h = _Hashed(b)
        _, at, one, two = h.first(candidates(h, flags))
        part = _part(one, n)
        order = np.lexsort((at, part))
        doc, start = _starts(b, at[order])
        doc = np.where(b.nulls, _LAST, b.doc_ids)[doc]
        rows = [{"block": b.block, "part": p, "size": s.stop - s.start, "one": one[order[s]].tobytes(), "two": two[order[s]].tobytes(),
                 "doc": packed.packed(doc[s].tobytes()), "start": packed.packed(start[s].astype(np.int32).tobytes())} for p, s in packed.sliced(part[order])]
        return pa.Table.from_pylist(rows, place)

    def read(table, name, kind):
        """Arrays of the rows of a table: hashes as they are, places unpacked."""
        if name in ("one", "two"):
            return [np.frombuffer(x.as_py(), kind) for x in table.column(name)]
        item = np.dtype(kind).itemsize
        return [np.frombuffer(packed.unpacked(x.as_py(), k * item), kind) for x, k in zip(table.column(name), table.column("size").to_pylist())]

    def earliest(table):
        """For each window of a part the first place of all, and nothing (start -1) for the window that stands there."""
        one = read(table, "one", np.uint64)
        two, doc, start = (np.concatenate(read(table, *x)) for x in (("two", np.uint32), ("doc", np.int64), ("start", np.int32)))
        size = np.cumsum([len(x) for x in one])[:-1]
        one = np.concatenate(one)
        order = np.lexsort((start, doc, two, one))
        new = np.concatenate([[True], (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)])
        head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        where, from_ = np.zeros(len(one), np.int64), np.full(len(one), -1, np.int32)
        later = head != order
        where[order[later]], from_[order[later]] = doc[head[later]], start[head[later]]
        cut = lambda x: pa.array([packed.packed(y.tobytes()) for y in np.split(x, size)], pa.binary())
        return pa.table({"block": table.column("block"), "part": table.column("part"), "size": table.column("size"), "bits": pa.nulls(table.num_rows, pa.binary()),
                         "doc": cut(where), "start": cut(from_)})

    result = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()),
                        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("ref_doc_id", pa.int64()), ("ref_start", pa.int64())])))])

    def parsed(block, found):
        b = packed.Block(block)
        h = _Hashed(b)
        is_flags = pa.compute.is_valid(found.column("bits"))
        places = candidates(h, found.filter(is_flags))
        found = _by_part(found.filter(pa.compute.invert(is_flags)))
        which, at, one, _ = h.first(places)
        order = np.lexsort((at, _part(one, n)))
        ref_doc, ref_start = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        ref_doc[order] = np.concatenate([np.zeros(0, np.int64), *read(found, "doc", np.int64)])
        ref_start[order] = np.concatenate([np.zeros(0, np.int32), *read(found, "start", np.int32)])
        # a window that the block itself holds earlier and no other block has before
        own, start = _starts(b, at)
        own = np.where(b.nulls, _LAST, b.doc_ids)[own]
        inner = (ref_start < 0)
        ref_doc, ref_start = np.where(inner, own, ref_doc)[which], np.where(inner, start, ref_start)[which]
        hit = ~inner[which] | (places != at[which])
        places, ref_doc, ref_start = places[hit], ref_doc[hit], ref_start[hit]
        cover = np.zeros(len(b.ids) + 1, np.int64)
        np.add.at(cover, places, 1)
        np.subtract.at(cover, places + WINDOW, 1)
        left = np.cumsum(cover)[:-1] == 0
        rows = _documents(b, left)
        if spans:
            doc, start = _starts(b, places)
            new = np.ones(len(places), bool)
            if len(places):
                new[1:] = (np.diff(places) != 1) | (np.diff(doc) != 0) | (np.diff(ref_doc) != 0) | (np.diff(ref_start) != 1)
            heads = np.flatnonzero(new)
            for k, size in zip(heads.tolist(), np.diff(np.append(heads, len(places))).tolist()):
                rows[doc[k]]["spans"].append({"start": int(start[k]), "length": size + WINDOW - 1,
                                              "ref_doc_id": None if ref_doc[k] == _LAST else int(ref_doc[k]), "ref_start": int(ref_start[k])})
        return pa.Table.from_pylist(rows, result)

    flags = tables.keep(blocks.mapInArrow(anchors, "part bigint, block bigint, keys binary, bits binary").groupBy("part").applyInArrow(shared, "block bigint, part bigint, bits binary"))
    sent = (blocks.groupBy("block").cogroup(flags.groupBy("block"))
            .applyInArrow(windows, "block bigint, part bigint, size bigint, one binary, two binary, doc binary, start binary"))
    back = sent.groupBy("part").applyInArrow(earliest, "block bigint, part bigint, size bigint, bits binary, doc binary, start binary")
    return (blocks.groupBy("block").cogroup(back.unionByName(flags, allowMissingColumns=True).groupBy("block"))
            .applyInArrow(parsed, "doc_id bigint, n_words bigint, n_removed bigint, kept string, "
                          "spans array<struct<start: bigint, length: bigint, ref_doc_id: bigint, ref_start: bigint>>"))


def _documents(b, left):
    """One row per document of a block: its counts and the words that stay."""
    words, ids, offs = b.words, b.ids, b.offs.tolist()
    out = []
    for i, (x, y) in enumerate(zip(offs, offs[1:])):
        stay = ids[x:y][left[x:y]].tolist()
        out.append({"doc_id": None if b.nulls[i] else int(b.doc_ids[i]), "n_words": y - x, "n_removed": y - x - len(stay),
                    "kept": b" ".join([words[j] for j in stay]).decode(), "spans": []})
    return out
