"""Substring dedup, phrase mining and ranked search against brute force on small tables with planted and odd rows."""
import math
import re
from collections import Counter

import numpy as np
import pytest

from studyloom.llm import intervals, packed, phrases, relz
from tests.llm.test_operators import docs

ODD = [(None, None), (None, "lonely text without an id"), (1, ""), (2, None), (3, "   \n"), (4, "x" * 50_000), (5, " ".join(["long"] * 3_000)), (6, "tie tie"), (7, "Tie, tie!")]


def text(rnd, n, vocabulary):
    return " ".join("w%d" % i for i in rnd.integers(0, vocabulary, n))


# --- op11 -------------------------------------------------------------------

def _lz_rows(rows):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = set()
        for s in range(len(w) - 19):
            key = tuple(w[s:s + 20])
            if key in seen:
                gone.update(range(s, s + 20))
            seen.add(key)
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), kept))
    return sorted(out, key=str)


def _lz_cases():
    rnd = np.random.default_rng(11)
    shared = text(rnd, 60, 10**6)
    hot = [(100 + i, text(rnd, 15, 50) + " " + shared + "  " + text(rnd, 15, 50)) for i in range(40)]
    copies = [(200 + i, text(np.random.default_rng(i % 3), 80, 10**6)) for i in range(30)]
    few = [(300 + i, text(rnd, 400, 2)) for i in range(5)]  # two words only: windows and anchors repeat everywhere
    cut = [(400, " ".join(shared.split()[:20])), (401, " ".join(shared.split()[:19])), (402, "\t".join(shared.split()[30:] + shared.split()[:30])), (403, shared.upper())]
    return ODD + hot + copies + few + cut + [(500, shared.replace(" ", "\x0b")), (501, text(rnd, 300, 10**6))]


@pytest.mark.parametrize("block", [1 << 21, 3000])
def test_substring_dedup(spark, monkeypatch, block):
    rows = _lz_cases()
    monkeypatch.setattr(packed, "BLOCK", block)
    got = relz.factors(spark, docs(spark, rows).repartition(3)).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept) for r in got], key=str) == _lz_rows(rows)
    by = {r[0]: re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows if r[0] is not None}
    for r in got:
        covered = set()
        for s in r.spans:
            covered.update(range(s.start, s.start + s.length))
            if r.doc_id is not None and s.ref_doc_id is not None:
                assert s.length >= 20 and (s.ref_doc_id, s.ref_start) < (r.doc_id, s.start)
                assert by[r.doc_id][s.start:s.start + s.length] == by[s.ref_doc_id][s.ref_start:s.ref_start + s.length]
        assert len(covered) == r.n_removed


def test_substring_dedup_of_nothing(spark):
    assert relz.factors(spark, docs(spark, [])).count() == 0
    got = relz.factors(spark, docs(spark, [(1, None), (2, "a b")])).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept, r.spans) for r in got) == [(1, 0, 0, "", []), (2, 2, 0, "a b", [])]


def test_rows_with_one_id_keep_one_copy(spark):
    same = text(np.random.default_rng(1), 30, 1000)
    got = relz.factors(spark, docs(spark, [(4, same), (4, same), (None, same), (None, same)])).collect()
    assert sorted(r.n_removed for r in got) == [0, 30, 30, 30] and {r.doc_id for r in got if not r.n_removed} == {4}


# --- op12 -------------------------------------------------------------------

def _phrases(rows, least, top):
    f, n, out = Counter(), Counter(), []
    for t, lang in rows:
        lang = "und" if lang is None else lang
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", folded):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    cand = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    for (lang, p), a in cand.items():
        if any(100 * b >= 50 * a for (g, q), b in cand.items() if g == lang and len(q) > len(p) and p in (q[:2], q[1:])):
            continue
        score, k = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    ranked, rank = [], Counter()
    for lang, s, a, p, l, r in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            ranked.append((lang, rank[lang], p.decode(), -a, l, r, n[lang], -s))
    return ranked


def _phrase_rows():
    rnd = np.random.default_rng(12)
    zipf = lambda n: " ".join(f"w{i}" + ("" if i % 7 else rnd.choice([".", ",", "\n", " \t", "!?"])) for i in rnd.zipf(1.4, n) % 5000)
    rows = [(zipf(400), ["en", "fr", None][i % 3]) for i in range(60)]
    rows += [("New York City, big Apple " + zipf(5), "en")] * 30 + [(" ".join(f"tie{i} tied{i}" for i in range(40)).replace(" tie", ". tie"), "de")] * 12
    return rows + [(None, "en"), ("", None), ("same " * 3000, "xx"), ("É É É é é É É É é é é É", "fr"), ("\x01 \x01", "en"), ("x" * 40000, "en")]


@pytest.mark.parametrize("block, least, top", [(1 << 21, 10, 2000), (5000, 3, 17)])
def test_phrases(spark, monkeypatch, block, least, top):
    rows = _phrase_rows()
    monkeypatch.setattr(packed, "BLOCK", block)
    d = spark.createDataFrame([(i, t, g, 1, 2, "x") for i, (t, g) in enumerate(rows)], "doc_id bigint, text string, lang string, rank int, id int, tag string")
    got = [tuple(r) for r in phrases.mine(spark, d.repartition(3), least=least, top=top).collect()]
    assert sorted(got) == _phrases(rows, least, top) and len(got) > 50


def test_phrases_of_nothing(spark):
    d = spark.createDataFrame([], "text string, lang string")
    assert phrases.mine(spark, d).count() == 0
    assert phrases.mine(spark, spark.createDataFrame([(None, None), ("a b", "en")], d.schema)).count() == 0


def test_tiles_add_up(monkeypatch):
    rnd = np.random.default_rng(2)
    left, right, tag = (rnd.zipf(1.3, 20000) % 40000 | rnd.integers(0, 2, 20000) << 32), rnd.zipf(1.3, 20000) % 40000, rnd.integers(0, 2, 20000)
    count = rnd.integers(1, 9, 20000)
    want = Counter()
    for key, c in zip(zip(left.tolist(), right.tolist(), tag.tolist()), count.tolist()):
        want[key] += c
    for dense in (1, 256, 10**9):  # dense arrays everywhere they fit, as set, nowhere
        monkeypatch.setattr(phrases, "DENSE", dense)
        assert phrases.added(left, right, count, tag).tolist() == [want[key] for key in zip(left.tolist(), right.tolist(), tag.tolist())]
    number = np.arange(200000)
    band = phrases._band(number)
    for b in np.unique(band)[:-1].tolist():
        first, width = phrases._edges(b)
        assert number[band == b].tolist() == list(range(first, first + width))


# --- op13 -------------------------------------------------------------------

def _ranking(rows, items, k):
    word = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    held = [(i, word(t)) for i, t in rows]
    n, total = sum(1 for _, w in held if w), sum(len(w) for _, w in held)
    df = Counter(t for _, w in held for t in set(w))
    out = []
    for item, t in items:
        scores = []
        for i, w in held:
            tf, m = Counter(w), 75 + 25 * len(w) * n // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (10**9 * tf[x] // (1000 * tf[x] + 12 * m)) for x in word(t) if x in df)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("segment, leaf, taken, block", [(1 << 18, 512, 8, 1 << 22), (500, 16, 3, 900), (2000, 1, 1, 1 << 22)])
def test_search(spark, monkeypatch, segment, leaf, taken, block):
    rnd = np.random.default_rng(13)
    zipf = lambda n: " ".join(f"w{i}" for i in rnd.zipf(1.3, n) % 3000)
    rows = [(int(i), zipf(int(rnd.integers(1, 60)))) for i in rnd.permutation(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(30)] + [(2000, rows[7][1]), (2000, rows[7][1])] + ODD  # ties of copies, an id that stands twice
    items = [(i, zipf(12)) for i in range(12)] + [(50, rows[5][1]), (51, rows[7][1] + " " + rows[7][1]), (52, "Tie tie TIE"), (53, None), (54, ""), (55, "nowhere"), (None, "tie"), (56, "w1")]
    for name, value in (("SEGMENT", segment), ("LEAF", leaf), ("TAKEN", taken), ("BLOCK", block)):
        monkeypatch.setattr(intervals, name, value)
    q = spark.createDataFrame([(i, t, 9, 8) for i, t in items], "item_id bigint, text string, doc_id int, score int")
    got = intervals.search(spark, docs(spark, rows).repartition(3), q, 20).collect()
    assert sorted([tuple(r) for r in got], key=str) == _ranking(rows, items, 20)


def test_search_of_nothing(spark):
    none, q = docs(spark, []), spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert intervals.search(spark, none, q, 20).count() == 0
    assert intervals.search(spark, none, q.limit(0), 20).count() == 0
    assert intervals.search(spark, docs(spark, [(1, None), (2, "..")]), q, 20).count() == 0
