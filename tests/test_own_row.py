"""Blocks in their document's own row: facts on small rows, and plans without a shuffle."""
import random

import pyarrow as pa
from pyspark.sql import functions as F

from studyloom.operators import blocks as B
from studyloom.operators import cleaning as C
from tests.conftest import rows


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_header_footer_in_its_row(spark):
    rng = random.Random(11)
    docs = {i: [(s, s // 4, rng.choice(["Page 1", "Page 22", " Page 3", "top", "a", "b", None])) for s in range(rng.randint(0, 40))] for i in range(40)}
    docs[99] = [(s, s // 4, "Page 7" if s % 4 == 0 else "x" + "y" * s) for s in range(30)]
    d = spark.createDataFrame(list(docs.items()), "doc bigint, b array<struct<seq:bigint,page:bigint,text:string>>")

    def key(t):
        return None if t is None else "Page#" if t.strip().startswith("Page") else t
    want = []
    for doc, b in docs.items():
        edge = {s for s, p, _ in b if s == min(x for x, q, _ in b if q == p) or s == max(x for x, q, _ in b if q == p)}
        pages = {p for _, p, _ in b}
        on = {k: len({p for s, p, t in b if s in edge and key(t) == k}) for k in {key(t) for _, _, t in b}}
        for s, _, t in b:
            want.append((doc, s, int(s in edge and len(pages) > 2 and t is not None and on[key(t)] >= max(2, int(len(pages) * 0.3)))))
    got = C.header_footer(d)
    assert rows(got, "doc", "seq", "hf") == sorted(want) and {x[2] for x in want} == {0, 1}
    assert shuffles(got) == 0


def test_table_covered_in_its_row(spark):
    rng = random.Random(12)
    pages = [(d, p, [(t, [rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))] + [""] * (t % 2)) for t in range(rng.randint(0, 7))]) for d in range(15) for p in range(4)]
    d = spark.createDataFrame(pages, "doc bigint, page bigint, tables array<struct<tbl:bigint,cells:array<string>>>")
    want = []
    for doc, page, tables in pages:
        sets = {t: set(c) - {""} for t, c in tables}
        for t, a in sets.items():
            covered = any(o != t and a & b and len(a - b) <= max(1, len(a) * 0.1) and (len(b) > len(a) or len(b) == len(a) and o < t) for o, b in sets.items())
            want += [(doc, page, t)] if a and not covered else []
    got = C.table_covered(d)
    assert rows(got, "doc", "page", "tbl") == sorted(want)
    assert shuffles(got) == 0


def test_title_repeats_in_its_row(spark):
    docs = [(1, "A title", ["(A title)", "x", "Atitle", "A  title"]), (2, "A title", ["x", "y", "z", "A title"]), (3, "ab", ["ab", "ab"]), (4, None, ["x", None]), (5, "title", [])]
    d = spark.createDataFrame([(i, t, list(enumerate(b))) for i, t, b in docs], "doc bigint, title string, b array<struct<seq:bigint,text:string>>")
    got = C.title_repeats(d)
    assert rows(got, "doc", "seq") == [(1, 0), (1, 1), (2, 0), (2, 1), (2, 2), (3, 0), (3, 1), (4, 0), (4, 1)]
    assert shuffles(got) == 0


def test_outline_dump_in_its_row(spark):
    rng = random.Random(13)
    docs = {i: [(s, rng.choice("hhhp"), rng.choice(["a", "b", "c ", " c", "d", "e"])) for s in range(rng.randint(0, 14))] for i in range(80)}
    d = spark.createDataFrame(list(docs.items()), "doc bigint, b array<struct<seq:bigint,kind:string,text:string>>")
    want, cut = [], 0
    for doc, b in docs.items():
        n = next((s for s, k, _ in b if k != "h"), len(b))
        later = {t.strip() for _, _, t in b[n:]}
        dump = n >= 3 and sum(t.strip() in later for _, _, t in b[:n]) >= n * 0.6
        cut += dump
        want += [(doc, s) for s, _, _ in b if not (dump and s < n)]
    got = C.outline_dump(d)
    assert rows(got, "doc", "seq") == sorted(want) and 0 < cut < 80
    assert shuffles(got) == 0


def test_outline_levels_in_its_row(spark):
    rng = random.Random(14)
    docs = {i: [(s, rng.choice(["h?", "p"]), rng.randint(0, 6), rng.choice([9.0, 10.0, 12.0, 14.0, 15.0, 18.0, 20.0])) for s in range(rng.randint(0, 60))] for i in range(40)}
    d = spark.createDataFrame(list(docs.items()), "doc bigint, b array<struct<seq:bigint,kind:string,pat:int,size:double>>")
    want = []
    for doc, b in docs.items():
        heads, limit = {s: (p, z) for s, k, p, z in b if k == "h?"}, max(12, len(b) * 0.22)
        for weak in (6, 5, 4):
            if len(heads) > limit:
                heads = {s: (p, z) for s, (p, z) in heads.items() if not (p == weak and z < 11.5)}
            else:
                break
        big, small = sorted({z for _, z in heads.values() if z >= 11.5}, reverse=True), sorted({p for p, z in heads.values() if z < 11.5})
        for s, *_ in b:
            p, z = heads.get(s, (0, 0))
            want.append((doc, s, "h", min(4, big.index(z) + 1 if z >= 11.5 else len(big) + small.index(p) + 1)) if s in heads else (doc, s, "p", None))
    got = B.outline_levels(d, lambda x: x["pat"], lambda x: x["size"], F.lit(10))
    assert sorted(map(tuple, got.select("doc", "seq", "kind", "level").collect()), key=str) == sorted(want, key=str)
    assert shuffles(got) == 0


def test_garbled_counts_once(spark):
    texts = [None, "", "�" * 10 + "a" * 30, "�" * 7 + "a" * 33, "a" * 900, "a" * 799 + "w", "axyzqj" * 60, "a" * 250 + "xyzqjx" * 2]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = d.select("id", C.garbled(F.col("t"), "a-z", "xyzqj", "etao", "w").alias("bad"))
    assert rows(got) == [(0, None), (1, False), (2, True), (3, False), (4, True), (5, False), (6, True), (7, True)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 6


def test_trigram_counts_of_own_rows(spark):
    from studyloom.operators import search as S
    docs = [(1, ["abcabc", "ABC", None]), (2, ["bcd", "ab", ""]), (3, None), (4, ["xabc", "abc"])]
    got = S.trigram_counts(spark.createDataFrame(docs, "doc int, blocks array<string>"))
    assert rows(got, "gram", "blocks", "docs") == [("abc", 4, 2), ("bca", 1, 1), ("bcd", 1, 1), ("cab", 1, 1), ("xab", 1, 1)]
    assert shuffles(got) <= 2 and "hashpartitioning(gram#" in got._jdf.queryExecution().executedPlan().toString()


def test_trigram_index_holds_every_gram_of_a_block_once(spark, monkeypatch):
    """Posting lists against a dictionary of sets: ids that come twice, rows without an id, other scripts, several segments."""
    from studyloom.operators import search as S
    rng = random.Random(14)
    docs = [(rng.randrange(60) if rng.random() < 0.9 else None, [rng.choice([None, "", "ab", "x" * 9]) if rng.random() < 0.2 else
             "".join(rng.choice("abcABC é中\U0001f600") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 6))]) for _ in range(150)] + [(7, None)]
    held = {(t.lower()[i:i + 3], d, s) for d, b in docs for s, t in enumerate(b or []) if t for i in range(len(t) - 2)}
    d = spark.createDataFrame(docs, "doc bigint, blocks array<string>").repartition(3)
    index = S.trigram_postings(d).collect()
    got = []
    for r in index:
        assert len(r.docs) == len(r.held) and sum(r.held) == len(r.seqs) and (None in r.docs) != r.named
        at = iter(r.seqs)
        got += [(r.gram, x, next(at)) for x, n in zip(r.docs, r.held) for _ in range(n)]
    assert {x for x in got} == held and len([x for x in got if x[1] is not None]) == len({x for x in held if x[1] is not None})
    want = sorted((g, len({x[1:] for x in held if x[0] == g}), len({x[1] for x in held if x[0] == g} - {None})) for g in {x[0] for x in held})
    assert rows(S.trigram_counts(d), "gram", "blocks", "docs") == want
    monkeypatch.setattr(S, "SEGMENT", 40)
    sorted_ = sorted(((d, s, t.lower()) for d, b in docs for s, t in enumerate(b or []) if t is not None), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    cut = [pa.RecordBatch.from_pylist([dict(zip(("doc", "seq", "text"), x)) for x in sorted_[i:i + 7]], schema=pa.schema([("doc", pa.int64()), ("seq", pa.int32()), ("text", pa.string())])) for i in range(0, len(sorted_), 7)]
    lists = [r for b in S._segments(iter(cut)) for r in b.to_pylist()]
    assert len(lists) > len(index) and {(r["gram"], x) for r in lists for x in r["docs"]} == {x[:2] for x in held}
    named = [(r["gram"], x) for r in lists for x in r["docs"] if r["named"]]
    assert len(named) == len(set(named))
