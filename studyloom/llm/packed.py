"""Tokenised documents in packed blocks: a dictionary of the block's words and one small number per word.

A block takes whole documents until about ``BLOCK`` bytes of text are in it, so a task holds one block whatever the table's size. The
blocks are written before anything refers to them: their random numbers are fixed from then on, also when tasks run again.
"""
import numpy as np
import pyarrow as pa

#: Bytes of text in a block (a longer document is a block of its own).
BLOCK = 1 << 21
SCHEMA = "block bigint, tag string, n_words bigint, n_chars bigint, n_distinct bigint, doc_ids binary, nulls binary, offs binary, words binary, ids binary"


class _Numbers(dict):
    """Distinct keys numbered in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def packed(data):
    return pa.compress(data, "zstd", asbytes=True) if data else b""


def unpacked(data, size):
    return pa.decompress(data, size, "zstd", asbytes=True) if size else b""


def _kind(n_distinct):
    return np.uint16 if n_distinct <= 1 << 16 else np.uint32


def unpacked_ids(data, n_words, n_distinct):
    kind = _kind(n_distinct)
    return np.frombuffer(unpacked(data, n_words * np.dtype(kind).itemsize), kind)


class Block:
    """One row of the table: ``words`` (list of bytes), ``ids`` (an index into it per word), ``offs`` (first word of each document)."""

    def __init__(self, row):
        get = lambda name: row.column(name)[0].as_py()
        self.block, self.tag = get("block"), get("tag")
        words = unpacked(get("words"), get("n_chars"))
        self.words = words.split(b" ") if words else []
        self.ids = unpacked_ids(get("ids"), get("n_words"), len(self.words))
        self.offs = np.frombuffer(get("offs"), np.int64)
        self.doc_ids = np.frombuffer(get("doc_ids"), np.int64)
        self.nulls = np.frombuffer(get("nulls"), bool)


def _row(tag, docs, split):
    docs.sort(key=lambda d: (d[0] is None, d[0] or 0))
    numbers, ids, offs = _Numbers(), [], [0]
    number = numbers.__getitem__
    for _, text in docs:
        ids.extend(map(number, split(text)))
        offs.append(len(ids))
    block = int.from_bytes(np.random.default_rng().bytes(8), "little") >> 1
    words = b" ".join(numbers)
    return {"block": block, "tag": tag, "n_words": len(ids), "n_chars": len(words), "n_distinct": len(numbers), "doc_ids": np.array([d[0] or 0 for d in docs], np.int64).tobytes(),
            "nulls": np.array([d[0] is None for d in docs], bool).tobytes(), "offs": np.array(offs, np.int64).tobytes(), "words": packed(words),
            "ids": packed(np.array(ids, _kind(len(numbers))).tobytes())}


def pack(docs, id_col, text_col, split, tag_col=None):
    """Rows of ``SCHEMA``. ``split`` turns the bytes of a text into words (bytes without a space); NULL counts as empty.

    Documents of one block share the value of ``tag_col``, if given, and stand in ascending order of their ids, NULL ids last.
    """
    rows = docs.selectExpr(f"cast({id_col} as bigint) id", f"cast({text_col} as binary) text", f"{tag_col or 'cast(null as string)'} tag")
    kinds = pa.schema([("block", pa.int64()), ("tag", pa.string()), ("n_words", pa.int64()), ("n_chars", pa.int64()), ("n_distinct", pa.int64()), ("doc_ids", pa.binary()), ("nulls", pa.binary()),
                       ("offs", pa.binary()), ("words", pa.binary()), ("ids", pa.binary())])

    def run(batches):
        held, size, total = {}, {}, 0
        out = lambda tag: pa.RecordBatch.from_pylist([_row(tag, held.pop(tag), split)], kinds)
        for batch in batches:
            for i, text, tag in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                held.setdefault(tag, []).append((i, text or b""))
                n = len(text or b"") + 16
                size[tag], total = size.get(tag, 0) + n, total + n
                if size[tag] >= BLOCK or total >= 4 * BLOCK:
                    most = max(size, key=size.get)
                    total -= size.pop(most)
                    yield out(most)
        for tag in list(held):
            yield out(tag)
    return rows.mapInArrow(run, SCHEMA)


def parts(total, each, least=64):
    """Into how many parts ``total`` entries are dealt so that a part has about ``each``."""
    return max(least, -(-int(total or 0) // each))


def sliced(part):
    """(part, slice) for every run of equal values in an ascending array."""
    cuts = np.flatnonzero(np.diff(part)) + 1
    edges = [0, *cuts.tolist(), len(part)] if len(part) else [0]
    return [(int(part[a]), slice(a, b)) for a, b in zip(edges, edges[1:])]
