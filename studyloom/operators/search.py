"""Text search over blocks, pages and notes."""
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from studyloom.functions.numbers import count_if
from studyloom.functions.text import count_word, has_all, one_space, shingles
from studyloom.session import materialize


def trigram_index(blocks, keys=("doc", "seq")):
    """Inverted index of lower-cased character trigrams: one row per gram and block. Write it bucketed by ``gram``."""
    return blocks.select(*keys, F.explode(F.array_distinct(shingles(F.lower("text"), 3))).alias("gram"))


#: Bytes of text in a segment of the index.
SEGMENT = 2_000_000


def _listed(doc, seq, text):
    """Posting lists of rows sorted by document and place: arrays (gram, docs, held, seqs), one entry per gram."""
    new = np.ones(len(doc), bool)
    new[1:] = pc.not_equal(doc[1:], doc[:-1]).to_numpy(zero_copy_only=False)
    owner, seq = np.cumsum(new) - 1, seq.to_numpy()
    place = np.ones(len(doc), bool)
    place[1:] = new[1:] | (seq[1:] != seq[:-1])  # rows of one document and place are one block
    block = np.cumsum(place) - 1
    doc, owner, seq, blocks = doc.take(pa.array(np.flatnonzero(new))), owner[place], seq[place], int(place.sum())
    texts = text.to_pylist()
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    ends = np.cumsum(sizes)
    whole = np.ones(len(chars) + 2, bool)
    for left in (1, 2):  # no gram begins at a text's last two characters
        whole[ends[sizes >= left] - left] = False
    here = np.flatnonzero(whole[:len(chars)])
    known = np.zeros(0x110000, bool)
    known[chars] = True
    letters = np.flatnonzero(known)
    rank = np.zeros(0x110000, np.int64)
    rank[letters] = np.arange(len(letters))
    r, a = rank[chars], len(letters)
    gram = (r[here] * a + r[here + 1]) * a + r[here + 2]
    codes = None
    if a ** 3 * max(1, blocks) >= 2 ** 62:
        codes, gram = np.unique(gram, return_inverse=True)
    entry = gram * blocks + np.repeat(block, sizes)[here]
    entry = entry.astype(np.uint32) if codes is None and a ** 3 * blocks < 2 ** 32 else entry
    entry.sort()  # np.unique goes through a hash table, which takes ten times as long
    entry = entry[np.append(True, entry[1:] != entry[:-1])] if len(entry) else entry
    gram, block = np.divmod(entry, max(1, blocks))
    first = np.ones(len(entry), bool)
    first[1:] = gram[1:] != gram[:-1]
    by = owner[block]
    begins = first.copy()
    begins[1:] |= by[1:] != by[:-1]
    begins, first = np.flatnonzero(begins), np.flatnonzero(first)
    code = gram[first].astype(np.int64) if codes is None else codes[gram[first].astype(np.int64)]
    said = np.stack([letters[code // (a * a)], letters[code // a % a], letters[code % a]], 1) if len(code) else np.zeros((0, 3), np.int64)
    said = said.astype("<u4").tobytes().decode("utf-32-le")
    lists = lambda at, values: pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)
    at = np.append(np.searchsorted(begins, first), len(begins))
    return [pa.array([said[i:i + 3] for i in range(0, len(said), 3)], pa.string()), lists(at, doc.take(pa.array(by[begins]))),
            lists(at, pa.array(np.diff(np.append(begins, len(entry))), pa.int32())), lists(np.append(first, len(entry)), pa.array(seq[block], pa.int32()))]


def _segments(batches):
    """Rows of a task, sorted by document, as segments of about ``SEGMENT`` bytes of text; a document is in one segment, unless it has no id."""
    def lists(t):
        nobody = t.column("doc").null_count  # they come first
        for part in (t.slice(0, nobody), t.slice(nobody)):
            if part.num_rows:
                doc, seq, text = (part.column(c).combine_chunks() for c in ("doc", "seq", "text"))
                named = doc.null_count == 0
                gram, *rest = _listed(doc if named else pa.nulls(len(doc), pa.int64()).fill_null(0), seq, text)
                if not named:
                    rest[0] = pa.ListArray.from_arrays(rest[0].offsets, pa.nulls(len(rest[0].values), doc.type))
                yield pa.RecordBatch.from_arrays([gram, pa.array(np.full(len(gram), named)), *rest], ["gram", "named", "docs", "held", "seqs"])
    held, size, due = [], 0, SEGMENT
    for b in batches:
        held.append(b)
        size += b.column("text").nbytes
        if size >= due:
            t = pa.Table.from_batches(held).combine_chunks()
            doc = t.column("doc").combine_chunks()
            last = doc[-1]
            n = t.num_rows if not last.is_valid else max(doc.null_count, int(pc.index(doc, last).as_py()))
            if n:
                yield from lists(t.slice(0, n))
                held = pa.Table.from_batches(held).slice(n).to_batches()
                size = sum(x.column("text").nbytes for x in held)
            due = max(SEGMENT, 2 * size)
    if held:
        yield from lists(pa.Table.from_batches(held))


def trigram_postings(docs):
    """The inverted index as posting lists, one row per gram and segment of documents: (gram, named, docs, held, seqs).

    ``docs(doc, blocks)``: texts of a document's blocks in its own row. ``docs`` are the documents that hold the gram, ``held`` in how many blocks
    each, ``seqs`` these blocks, one document after the other. A gram stands once for a document's block, also where rows share an id, so rows
    are dealt by id; those without one are dealt by text and in lists that are not ``named``. No gram is gathered: a list ends with its segment.
    """
    t = docs.select("doc", F.posexplode("blocks").alias("seq", "text")).where("text IS NOT NULL").select("doc", "seq", F.lower("text").alias("text"))
    t = t.repartition(F.col("doc"), F.when(F.col("doc").isNull(), F.xxhash64("text"))).sortWithinPartitions("doc", "seq")
    return t.mapInArrow(_segments, f"gram string, named boolean, docs array<{docs.schema['doc'].dataType.simpleString()}>, held array<int>, seqs array<int>")


def trigram_counts(docs):
    """What the stored index holds of every gram: (gram, blocks, docs). ``docs`` as in :func:`trigram_postings`.

    Documents without an id are one to the index and none to the count of documents, as ``count(DISTINCT doc)`` has it.
    """
    index = materialize(trigram_postings(docs))
    named = index.where("named").select("gram", F.size("seqs").alias("blocks"), F.size("docs").alias("docs"))
    nobody = index.where("NOT named").select("gram", F.explode("seqs").alias("seq")).distinct().select("gram", F.lit(1).alias("blocks"), F.lit(0).alias("docs"))
    return named.unionByName(nobody).groupBy("gram").agg(F.sum("blocks").alias("blocks"), F.sum("docs").alias("docs"))


def snippet(text, word, before=50, after=90):
    """Text around the first hit of ``word``: with an ellipsis when it does not start at the beginning."""
    pos = F.instr(text, word) - 1
    a = F.greatest(F.lit(0), pos - before)
    return F.concat(F.when(a > 0, "…").otherwise(""), F.substring(text, a + 1, pos + after - a))


def search_blocks(blocks, query, doc=None, hidden=None, limit=200):
    """Blocks holding all words, without the hidden documents (unless one document is asked for), first ``limit`` in order."""
    words = query.split()
    if not words:
        return blocks.limit(0).select("doc", "seq", F.lit("").alias("snippet"))
    hit = blocks.where(has_all(F.col("text"), words))
    if doc is not None:
        hit = hit.where(F.col("doc") == doc)
    elif hidden is not None:
        hit = hit.join(hidden.select("doc"), "doc", "left_anti")
    return hit.orderBy("doc", "seq").limit(limit).select("doc", "seq", snippet(F.col("text"), words[0]).alias("snippet"))


def search_indexed(index, blocks, query, hidden=None, limit=200):
    """The same hits through the index: blocks that hold every gram of the longest word, then the exact check.

    The gram list is short and known, so the index scan is an IN filter and one small aggregation. Words of fewer than three
    letters have no gram; a query of such words alone reads the blocks.
    """
    longest = max(query.split(), key=len, default="").lower()
    if len(longest) < 3:
        return search_blocks(blocks, query, hidden=hidden, limit=limit)
    grams = sorted({longest[i:i + 3] for i in range(len(longest) - 2)})
    cand = (index.where(F.col("gram").isin(grams)).groupBy("doc", "seq").agg(F.count("*").alias("n"))
            .where(F.col("n") == len(grams)).select("doc", "seq"))
    return search_blocks(blocks.join(cand, ["doc", "seq"], "left_semi"), query, hidden=hidden, limit=limit)


def search_pages(pages, query, limit=300, per_file=8):
    """Pages holding all words, at most ``per_file`` per document and ``limit`` overall."""
    from studyloom.operators.selection import per_group_cap
    words = query.split()
    hits = pages.where(has_all(F.col("text"), words)).select("doc", "page", one_space(snippet(F.col("text"), words[0], 90, 90)).alias("snippet"))
    return per_group_cap(hits, ["doc"], ["page"], per_file, limit)


def search_course(lessons, query, markup=r"(?m)^:::.*$|[#*=>|`]", limit=None):
    """Lessons holding all words once markup is gone, most frequent first word first."""
    words = query.split()
    plain = F.regexp_replace("text", markup, "")
    hits = (lessons.withColumn("plain", plain).where(has_all(F.col("plain"), words))
            .select("id", count_word(F.col("plain"), words[0]).alias("n"),
                    F.regexp_replace(F.substring(F.col("plain"), F.greatest(F.lit(0), F.instr("plain", words[0]) - 1 - 50) + 1,
                                                 F.instr("plain", words[0]) - 1 + 90 - F.greatest(F.lit(0), F.instr("plain", words[0]) - 1 - 50)),
                                     r"(?U)\s+", " ").alias("snippet"))).orderBy(F.desc("n"), "id")
    return hits.limit(limit) if limit else hits


def search_memo(items, query, fields):
    """Notes whose joined fields hold all words."""
    return items.where(has_all(F.concat(*[F.coalesce(F.col(f), F.lit("")) for f in fields]), query.split()))


def facet_counts(items, facets, chosen, text_filter=None):
    """Counts per value of every facet under all the other chosen values; one scan, one row per (facet, value)."""
    ok = {f: (F.col(f) == v if v is not None else F.lit(True)) for f, v in chosen.items()}
    base = items if text_filter is None else items.where(text_filter)

    def others(f):
        cond = F.lit(True)
        for g, c in ok.items():
            if g != f:
                cond = cond & c
        return cond
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value"), others(f).alias("keep")) for f in facets]))
    return (base.select(rows.alias("r")).groupBy("r.facet", "r.value").agg(count_if(F.col("r.keep")).alias("n")).where("n > 0"))
