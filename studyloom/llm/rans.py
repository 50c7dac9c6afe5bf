"""Token ids in binary files, coded by static range asymmetric numeral systems (rANS).

One frequency table, counted over all documents and scaled to 2**bits, is shared by every block. A block holds whole documents
(TOKENS ids or more) and stands alone: LANES coder states are interleaved, state j taking every LANES-th id. Every CHECK steps
the block notes where its words stand and what the states are, so that its parts can be decoded in parallel, and each part has
a checksum of its ids. Blocks are rows of Parquet files (any store that Spark writes), ordered by document id over the files:

    shard, block      place of the block
    docs, sizes       ids of its documents and how many token ids each has (64-bit integers, little-endian); a NULL id is MISSING
    n                 token ids in the block
    payload           32-bit words, little-endian, in the order the decoder takes them
    at, states, crc   for each part: first word, LANES states, crc32 of its ids as 32-bit integers

States are in [2**31, 2**63); a step moves at most one word of 32 bits. Coding runs backward, decoding forward.
"""
import json
import os
import re
import unicodedata
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from studyloom.llm.held import keep, release
from studyloom.llm.tables import Scratch

LANES, CHECK, TOKENS = 256, 256, 1 << 18
MISSING = -(1 << 63)
LOW = 31
_SPACE_LIKE = re.compile("[\x1c-\x1f]")


class _Met(dict):
    """What ``code`` gives for a key, kept for the first ``most`` keys."""
    def __init__(self, code, most):
        super().__init__()
        self.code, self.most = code, most

    def __missing__(self, key):
        got = self.code(key)
        if len(self) < self.most:
            self[key] = got
        return got


def _alphabet():
    """Character that stands for each byte in byte-level vocabularies: printable bytes themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(c) for b, c in [*zip(plain, plain), *zip(rest, range(256, 512))]}


class Tokens:
    """Ids of whole texts by a vocabulary file of the tokenizers library, encoded without special tokens.

    Where the file's splitting drops white space, texts are coded chunk by chunk and chunks piece by piece, by the library's
    model; the ids of chunks and pieces met before are kept (a bounded number). What is not plain goes through the whole
    library: chunks of other scripts or with special tokens, texts with separators on which notions of white space differ,
    and all texts where the file's splitting is another one.
    """
    def __init__(self, path, most=300_000):
        import regex
        from tokenizers import Tokenizer
        self.coder = Tokenizer.from_file(path)
        self.coder.no_padding()
        self.model = self.coder.model
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        steps = lambda x, name: [y["type"] for y in (file.get(x) or {}).get(name, [])]
        split = (file.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        self.chunked = steps("normalizer", "normalizers") == ["NFC", "Replace", "Lowercase"] and steps("pre_tokenizer", "pretokenizers") == ["Split", "ByteLevel"] and split.get("behavior") == "Removed"
        if self.chunked:
            self.cut = regex.compile(split["pattern"]["Regex"]).findall
            self.special = re.compile("|".join(re.escape(t["content"]) for t in file["added_tokens"]) or "(?!)").search
            self.byte = _alphabet()
            self.four = [i.to_bytes(4, "little") for i in range(self.coder.get_vocab_size())]
            self.pieces, self.chunks = _Met(self._piece, most), _Met(self._chunk, most)

    def _whole(self, text):
        return np.array(self.coder.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece):
        if not piece.isascii():
            piece = "".join(map(self.byte.__getitem__, piece.encode()))
        four = self.four
        return b"".join([four[t.id] for t in self.model.tokenize(piece)])

    def _chunk(self, chunk):
        if chunk.isascii():
            if chunk.isalpha():  # one piece
                return self.pieces[chunk.lower()]
            if chunk.isprintable() and not self.special(chunk):
                return b"".join(map(self.pieces.__getitem__, self.cut(chunk.lower())))
        elif max(chunk) <= "\u024f" and not self.special(chunk):
            return b"".join(map(self.pieces.__getitem__, self.cut(unicodedata.normalize("NFC", chunk).lower())))
        return self._whole(chunk)

    def batch(self, texts):
        """Little-endian 32-bit ids of each text."""
        for t in texts:
            if not self.chunked or t and _SPACE_LIKE.search(t):
                yield self._whole(t or "")
            else:
                yield b"".join(map(self.chunks.__getitem__, (t or "").split()))


def table(counts, bits=None):
    """Frequencies of the symbols 0.. that sum to 2**bits; every symbol that occurs keeps at least 1."""
    counts = np.asarray(counts, np.int64)
    kinds = int((counts > 0).sum())
    if bits is None:
        bits = min(24, max(16, int(kinds - 1).bit_length() + 2 if kinds else 16))
    total, full = int(counts.sum()), 1 << bits
    if not total:
        return np.zeros(len(counts), np.int64), bits
    if kinds > full:
        raise ValueError(f"{kinds} symbols do not fit a table of 2**{bits}")
    freq = np.where(counts > 0, np.maximum(1, (counts.astype(float) * full / total).astype(np.int64)), 0)
    over = int(freq.sum()) - full
    order = np.argsort(-freq, kind="stable")
    while over:  # take from or give to the most frequent symbols, none below 1
        for s in order:
            step = min(max(over, -full), max(freq[s] // 2, 1) if over > 0 else over)
            if over > 0:
                step = min(step, freq[s] - 1)
            freq[s] -= step
            over -= int(step)
            if not over:
                break
    return freq, bits


def encode(ids, freq, bits):
    """(payload, word position, states and checksum of each part) of one block."""
    start = (np.cumsum(freq) - freq).astype(np.uint64)
    f = freq.astype(np.uint64)
    n = len(ids)
    steps = -(-n // LANES)
    state = np.full(LANES, 1 << LOW, np.uint64)
    words, at, states, crc = [], [], [], []
    sizes = np.zeros(steps + 1, np.int64)
    limit = f << np.uint64(63 - bits)
    for t in range(steps - 1, -1, -1):
        s = ids[t * LANES:(t + 1) * LANES]
        x = state[:len(s)]
        full = x >= limit[s]
        out = np.flatnonzero(full)
        if len(out):
            words.append((x[out] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            sizes[t] = len(out)
            x[out] >>= np.uint64(32)
        q = x // f[s]
        state[:len(s)] = (q << np.uint64(bits)) + (x - q * f[s]) + start[s]
        if t % CHECK == 0:
            states.append(state.copy())
            crc.append(zlib.crc32(np.ascontiguousarray(ids[t * LANES:(t + CHECK) * LANES], "<u4").tobytes()))
            at.append(t)
    payload = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
    first = np.concatenate([[0], np.cumsum(sizes[:-1])])
    return payload, np.array([first[t] for t in reversed(at)], np.int64), np.array(states[::-1], np.uint64).reshape(-1, LANES), np.array(crc[::-1], np.int64)


def slots(freq, bits):
    """Symbol of every slot of the shared table, and the start of each symbol."""
    return np.repeat(np.arange(len(freq), dtype=np.uint32), freq), (np.cumsum(freq) - freq).astype(np.uint64)


def decode_part(payload, at, state, n, crc, freq, bits, lookup):
    """The n ids of one part, from its own words and states; its checksum must hold."""
    symbol, start = lookup
    f = freq.astype(np.uint64)
    mask = np.uint64((1 << bits) - 1)
    out = np.empty(n, np.uint32)
    x, p = state.copy(), int(at)
    for t in range(0, n, LANES):
        k = min(LANES, n - t)
        y = x[:k]
        slot = y & mask
        s = symbol[slot]
        out[t:t + k] = s
        y = f[s] * (y >> np.uint64(bits)) + slot - start[s]
        low = np.flatnonzero(y < np.uint64(1 << LOW))
        y[low] = (y[low] << np.uint64(32)) | payload[p:p + len(low)]
        p += len(low)
        x[:k] = y
    if zlib.crc32(out.astype("<u4").tobytes()) != crc:
        raise ValueError("checksum of a block part does not hold")
    return out


def decode(payload, at, states, crc, n, freq, bits, lookup):
    """All ids of a block, part by part."""
    parts = [decode_part(payload, at[i], states[i], min(CHECK * LANES, n - i * CHECK * LANES), crc[i], freq, bits, lookup) for i in range(len(at))]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


BLOCK = "shard int, block int, docs binary, sizes binary, n bigint, payload binary, at binary, states binary, crc binary"


def _coder(vocabulary):
    def make():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has its own core
        return Tokens(vocabulary)
    return keep(vocabulary, make)


def _ids(packed, wide):
    import zstandard
    return np.frombuffer(zstandard.decompress(packed), "<u4" if wide else "<u2").astype(np.int64)


def _packed(ids):
    """(compressed ids, whether they need 32 bits)"""
    import zstandard
    wide = bool(ids.max() >= 65536)
    return zstandard.compress(ids.astype("<u4" if wide else "<u2").tobytes(), 1), wide


def _block(shard, number, docs, parts, freq, bits):
    ids = np.concatenate(parts)
    payload, at, states, crc = encode(ids, freq, bits)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return (shard, number, np.array(docs, np.int64).tobytes(), sizes.tobytes(), len(ids), payload.tobytes(), at.tobytes(), states.tobytes(), crc.tobytes())


def write(spark, docs, path, vocabulary, end, id_col="doc_id", text_col="text", rows_per_shard=8000):
    """Code the ids of every text (and ``end`` after each) into block files under ``path``; returns the frequency table and its bits.

    Documents come in ascending id order over shards, blocks and places, NULL ids first; rows with one id in an order of their
    ids' bytes. NULL texts are empty; repeated rows are coded each. No rows give an empty table.
    """
    tables = Scratch(spark)

    def code(frames):
        coder = _coder(vocabulary)
        for pdf in frames:
            got = [_packed(np.append(np.frombuffer(b, "<u4"), np.uint32(end))) for b in coder.batch(pdf["text"])]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": [g[0] for g in got], "wide": [g[1] for g in got]})
    source = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(MISSING)).alias("doc_id"), F.col(text_col).alias("text"))
    coded = tables.keep(source.mapInPandas(code, "doc_id bigint, ids binary, wide boolean"))

    def tally(frames):
        total = np.zeros(0, np.int64)
        for pdf in frames:
            for b, w in zip(pdf["ids"], pdf["wide"]):
                got = np.bincount(_ids(b, w))
                if len(got) > len(total):
                    got[:len(total)] += total
                    total = got
                else:
                    total[:len(got)] += got
        k = np.flatnonzero(total)
        yield pd.DataFrame({"id": k, "n": total[k]})
    seen = coded.select("ids", "wide").mapInPandas(tally, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()  # a row per vocabulary entry
    counts = np.zeros(max([r.id for r in seen], default=0) + 1, np.int64)
    for r in seen:
        counts[r.id] = r.n
    freq, bits = table(counts)

    def blocks(frames):
        release()
        shard, number, held, docs_, size = 0, 0, [], [], 0
        for pdf in frames:
            for r in pdf.itertuples():
                shard = r.shard
                held.append(_ids(r.ids, r.wide))
                docs_.append(r.doc_id)
                size += len(held[-1])
                if size >= TOKENS:
                    yield pd.DataFrame([_block(shard, number, docs_, held, freq, bits)], columns=_COLUMNS)
                    number, held, docs_, size = number + 1, [], [], 0
        if held:
            yield pd.DataFrame([_block(shard, number, docs_, held, freq, bits)], columns=_COLUMNS)
    shards = max(1, -(-coded.count() // rows_per_shard))
    (coded.repartitionByRange(shards, "doc_id", F.xxhash64("ids")).sortWithinPartitions("doc_id", F.xxhash64("ids"), "ids")
     .withColumn("shard", F.spark_partition_id()).mapInPandas(blocks, BLOCK).write.parquet(path))
    tables.drop(coded)
    return freq, bits


_COLUMNS = [c.split()[0] for c in BLOCK.split(", ")]


def read(spark, path, freq, bits):
    """(doc_id, start, n_tokens, ids_crc32) of every coded document, from the files alone.

    start: ids of all documents before it; ids_crc32: unsigned crc32 of its ids as little-endian 32-bit integers.
    """
    shared = spark.sparkContext.broadcast(freq.astype(np.int32))

    def decoded(frames):
        release()
        freq = shared.value.astype(np.int64)
        lookup = slots(freq, bits)
        for pdf in frames:
            for r in pdf.itertuples():
                ids = decode(np.frombuffer(r.payload, "<u4").astype(np.uint64), np.frombuffer(r.at, np.int64), np.frombuffer(r.states, np.uint64).reshape(-1, LANES),
                             np.frombuffer(r.crc, np.int64), r.n, freq, bits, lookup).astype("<u4")
                sizes = np.frombuffer(r.sizes, np.int64)
                begin = np.cumsum(sizes) - sizes
                yield pd.DataFrame({"shard": r.shard, "block": r.block, "doc_id": np.frombuffer(r.docs, np.int64), "start": begin, "n_tokens": sizes,
                                    "ids_crc32": [zlib.crc32(ids[a:a + n].tobytes()) for a, n in zip(begin, sizes)]})
    files = spark.read.schema(BLOCK).parquet(path)
    docs = files.mapInPandas(decoded, "shard int, block int, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    before = starts(files.select("shard", "block", "n"))
    return docs.join(before, ["shard", "block"]).select(F.when(F.col("doc_id") != MISSING, F.col("doc_id")).alias("doc_id"),
                                                        (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def starts(blocks, reach=1024):
    """(shard, block, before): ids in all blocks before each. Sums go over shards, over groups of ``reach`` shards, then within each."""
    up_to = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shards = blocks.groupBy("shard").agg(F.sum("n").alias("n")).withColumn("g", F.floor(F.col("shard") / reach))
    whole = shards.groupBy("g").agg(F.sum("n").alias("n"))
    whole = whole.select("g", up_to(W.orderBy("g")).alias("a"))  # one row per ``reach`` shards
    part = shards.select("g", "shard", up_to(W.partitionBy("g").orderBy("shard")).alias("b"))
    own = blocks.select("shard", "block", up_to(W.partitionBy("shard").orderBy("block")).alias("c"))
    return own.join(part.join(whole, "g"), "shard").select("shard", "block", F.expr("a + b + c").cast("bigint").alias("before"))
