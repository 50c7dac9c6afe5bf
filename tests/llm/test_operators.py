"""The corpus operators on small tables with planted cases and odd rows, against brute force."""
import zlib

import numpy as np
import pytest

import corpus_pipeline
from studyloom.llm import bitsliced, components, filters, kneserney, licences, mixing, orderminhash, quadratic, queries, rans, redirects, tiling, toolcalls
from studyloom.llm.tables import Scratch

DOCS = "doc_id bigint, text string, lang string, source string, n_chars int, node string, keys string, id string, score int, place int, class_id int"


def docs(spark, rows):
    """Rows (doc_id, text[, source]) among columns whose names the operators use themselves."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 1, "x", "y", "z", 7, 8, 9) for r in rows], DOCS)


def words(n, seed=0):
    rnd = np.random.default_rng(seed)
    return ["w%d" % i for i in rnd.integers(0, 10**6, n)]


ODD = [(None, None), (None, "lonely text without an id"), (1, ""), (2, None), (3, "   \n"), (4, "x" * 50_000), (4, "x" * 50_000), (5, " ".join(["long"] * 30_000)), (6, "tie tie"), (6, "Tie, tie!")]


# --- components and filters -------------------------------------------------

def _classes(pairs):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x
    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {x: top(x) for x in up}


@pytest.mark.parametrize("pairs", [[], [(1, 1)], [(i, i + 1) for i in range(150)], [(0, i) for i in range(1, 200)],
                                   [(int(a), int(b)) for a, b in np.random.default_rng(1).integers(0, 300, (220, 2))]])
def test_components(spark, pairs):
    e = spark.createDataFrame([*pairs, (None, 3)], "a bigint, b bigint")
    got = {r.node: r.component for r in components.components(Scratch(spark), e).collect()}
    assert got == _classes([(a, b) for a, b in pairs if a != b])


def test_without_drops_ids_and_keeps_nulls(spark):
    d = docs(spark, [(i, str(i)) for i in range(50)] + [(None, "n"), (3, "again")])
    left = filters.without(d, "doc_id", spark.createDataFrame([(3,), (7,), (7,), (None,)], "gone bigint"), "gone")
    assert left.columns == d.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted([str(i) for i in range(50) if i not in (3, 7)] + ["None"])
    assert filters.without(d, "doc_id", spark.createDataFrame([], "gone bigint"), "gone").count() == 52


# --- op1 --------------------------------------------------------------------

def _link(spark, calls, results):
    c = spark.createDataFrame(calls, "conv_id string, call_id string, pos bigint, name string, arguments string")
    r = spark.createDataFrame(results, "conv_id string, call_id string, pos bigint, content string")
    schema = {"f": {"type": "object", "properties": {"n": {"type": "number", "minimum": 0}}}}
    return {(x.conv_id, x.call_id): x for x in toolcalls.link(spark, c, r, schema).collect()}


def _use(*ids, n=1):
    return '{"n": %d, "after": [%s]}' % (n, ",".join('{"$ref":"%s"}' % i for i in ids))


def test_tool_calls(spark):
    calls = [("c", "a", 1, "f", _use("b", n=-1)), ("c", "b", 2, "f", _use("d")), ("c", "d", 3, "f", _use()), ("c", "e", 4, "f", _use("a", "zz")),
             ("c", "e", 9, "f", "later"), ("c", "x", 5, "f", _use("y")), ("c", "y", 6, "f", _use("x")), ("c", "s", 7, "f", _use("s")), ("c", "o", None, "g", None),
             (None, "a", 1, "f", "{}"), ("c", None, 1, "f", "{}"), ("k", "a", 1, "f", '{"n": 1, "n": 2}')]
    results = [("c", "a", 2, 'say "hi"\n'), ("c", "a", 1, "first"), ("c", "b", 2, None), ("c", "q", 3, ""), ("k", "a", None, "r"), (None, None, 1, "r")]
    got = _link(spark, calls, results)
    order = [k for k, v in sorted(((k[1], v) for k, v in got.items() if k[0] == "c" and v.place), key=lambda kv: kv[1].place)]
    assert order.index("d") < order.index("b") < order.index("a") < order.index("e") and order[-1] == "o"
    marked = {k[1] for k, v in got.items() if v.cyclic}
    assert marked in ({"x", "s"}, {"y", "s"}) and order.index(*(marked - {"s"})) < order.index(*({"x", "y"} - marked))
    assert got["c", "a"].errors == "$.n: minimum" and not got["c", "a"].valid and got["c", "a"].results == 2
    assert got["c", "a"].line == '{"arguments":{"after":[{"$ref":"b"}],"n":-1},"id":"a","name":"f","result":"first"}'
    assert got["c", "b"].line.endswith('"result":null}') and got["c", "b"].status == "ok"
    assert got["c", "d"].status == "no_result" and got["c", "q"].status == "no_call" and got["c", "q"].place is None
    assert got["c", "e"].dangling == ["zz"] and got["c", "e"].calls == 2
    assert got["c", "o"].errors.startswith("$: not JSON") and not got["k", "a"].valid and len(got) == 10
    assert sorted(v.place for k, v in got.items() if k[0] == "c" and v.place) == list(range(1, 9))
    assert _link(spark, [], []) == {}


def test_random_calls_are_in_topological_order(spark):
    rnd = np.random.default_rng(6)
    to = {i: [int(x) for x in rnd.integers(0, i, 2)] if i else [] for i in range(60)}  # uses lower numbers only
    pos = rnd.permutation(60)
    got = _link(spark, [("c", str(i), int(pos[i]), "f", _use(*map(str, to[i]))) for i in to], [])
    place = {int(k[1]): v.place for k, v in got.items()}
    assert all(place[u] < place[i] for i in to for u in to[i]) and not any(v.cyclic for v in got.values())


# --- op2 --------------------------------------------------------------------

@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def _ids(vocabulary, text):
    from tokenizers import Tokenizer
    return np.array(Tokenizer.from_file(vocabulary).encode(text or "", add_special_tokens=False).ids + [2], "<u4")


@pytest.mark.parametrize("per_shard", [3, 1000])
def test_token_files(spark, tmp_path, vocabulary, per_shard):
    rows = ODD + [(100 - i, " ".join(words(20, i))) for i in range(20)]
    freq, bits = rans.write(spark, docs(spark, rows), str(tmp_path / "f"), vocabulary, 2, rows_per_shard=per_shard)
    got = sorted(rans.read(spark, str(tmp_path / "f"), freq, bits).collect(), key=lambda r: r.start)
    want = sorted((r[0] if r[0] is not None else -1, len(i), zlib.crc32(i.tobytes())) for r in rows for i in [_ids(vocabulary, r[1])])
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids) and [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()


def test_no_tokens(spark, tmp_path, vocabulary):
    freq, bits = rans.write(spark, docs(spark, []), str(tmp_path / "f"), vocabulary, 2)
    assert rans.read(spark, str(tmp_path / "f"), freq, bits).count() == 0


# --- op3 --------------------------------------------------------------------

def test_exponents(spark):
    n = {"a": 1000, "b": 100, "c": 10, "d": 0}
    totals = spark.createDataFrame(list(n.items()), "source string, n bigint")
    a = mixing.exponent(totals, repeats=5.0)
    assert a == pytest.approx(1 - np.log(5) / np.log(100), abs=1e-6)
    h = mixing.exponent(totals, entropy=0.8)
    p = np.array([1000, 100, 10]) / 1110
    w = p ** h / (p ** h).sum()
    assert -(w * np.log(w)).sum() == pytest.approx(0.8, abs=1e-6)
    assert mixing.exponent(totals, repeats=1e9) == 0 and mixing.exponent(totals, repeats=1.0) == pytest.approx(1, abs=1e-6)
    assert mixing.exponent(totals, entropy=9.0) == 0 and mixing.exponent(totals, entropy=0.0) == 1
    assert mixing.exponent(totals.limit(0), repeats=2.0) == 1


def test_mixture(spark):
    rows = [(i, " ".join(words(10, i)), "big") for i in range(600)] + [(1000 + i, " ".join(words(10, i)), "small") for i in range(60)] + [(None, None, None), (5000, "", "empty"), (5001, "one two", None)]
    d = docs(spark, rows)
    got = mixing.copied(spark, d, repeats=2.5, docs_per_block=4)
    seen = got.groupBy("doc_id", "source").count().collect()
    assert {r.doc_id for r in seen} == {r[0] for r in rows}  # every row at least once
    big, small = (sum(r["count"] for r in seen if r.source == s) for s in ("big", "small"))
    passes = 0.1 ** (-np.log(2.5) / np.log(3000))  # the source of two tokens is the one passed through 2.5 times
    assert big == 600 and 60 * passes - 8 <= small <= 60 * passes
    assert got.select(*d.columns).columns == d.columns
    part = mixing.copied(spark, d, repeats=2.5, budget=1000, docs_per_block=4)  # tokens
    n = {s: sum(len(r.text.split()) for r in part.where(f"source = '{s}'").collect()) for s in ("big", "small")}
    assert 840 <= n["big"] <= 885 and 80 <= n["small"] <= 116 and part.where("__epoch > 0").count() == 0
    assert mixing.copied(spark, d.limit(0), repeats=2.5).count() == 0


# --- op4 --------------------------------------------------------------------

def test_licences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\").\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND."
    turned = "\n".join(reversed(mit.split("\n")))
    rows = ODD + [(10, "Text. Licensed under CC BY-NC 4.0."), (11, mit), (12, turned), (13, "All rights reserved.\nReleased under the MIT License.\nReleased under the MIT License"),
                  (14, "Licensed under the GNU General Public License, version 2. Or, at your option, any later version."), (15, "We discuss the MIT License.")]
    got = {(r.doc_id, i): r for i, r in enumerate(licences.scan(docs(spark, rows)).collect())}
    one = {k[0]: v for k, v in got.items()}
    assert len(got) == len(rows)
    assert one[10].licences == "CC-BY-NC-4.0" and one[11].licences == "MIT" and one[12].verdict == "unknown" and one[12].unknown == "asis,mitnotice,mitgrant"
    assert one[13].licences == "MIT,proprietary" and one[13].verdict == "several" and one[13].unknown == "" and one[14].licences == "GPL-2.0-or-later"
    assert one[15].verdict == "none" and one[1].verdict == "none" and one[2].sentences == "" and licences.scan(docs(spark, [])).count() == 0


# --- op5 --------------------------------------------------------------------

def test_redirects(spark):
    link = '<html><LINK href="%s" rel=\'canonical\'>'
    move = "<meta http-equiv='refresh' content=\"0; url=%s\">"
    rows = [(1, "http://x.example.org/p", link % "https://example.com/en/1"), (2, "https://Y.example.org/q#f", move % "http://x.example.org/p"), (3, "http://z.example.org/r", None),
            (4, "https://www.Example.com/en/2", link % "https://example.com/en/1"), (5, "http://a.example.com/en/", ""), (6, None, link % "http://v.net/fr/1"), (7, "nothing", "<p>"),
            (8, "http://w.example.org/", (link % "http://k.net/es/1") + link % "http://k.com/"), (9, "HTTP://K.net/es?x#y", None), (9, "HTTP://K.net/es?x#y", None), (None, "http://notexample.com/en/1", "canonical"),
            (10, "http://e.org/1", "".join(link % f"http://e.org/{i}" for i in range(2, 40)) + link % "http://q.net/fr/")] + [(100 + i, f"http://e.org/{i}", "") for i in range(2, 40)]
    p = spark.createDataFrame([(*r, "clash", "b") for r in rows], "page_id bigint, url string, html string, place string, rule string")
    got = {(r.page_id, i): r for i, r in enumerate(redirects.judge(spark, p).collect())}
    one = {k[0]: (v.host, v.path, v.rule, v.verdict) for k, v in got.items()}
    assert len(got) == len(rows)
    assert one[1] == ("x.example.org", "/p", None, "allow")  # page 4, explicitly allowed, is of its class
    assert one[2] == ("y.example.org", "/q", None, "allow") and one[3][3] == "allow"
    assert one[4] == ("www.example.com", "/en/2", "www.example.com/en/", "allow") and one[5] == ("a.example.com", "/en/", "example.com/en/", "block")
    assert one[6] == ("", "", None, "block") and one[7] == ("", "", None, "allow") and one[8][3] == "allow"
    assert one[9] == ("k.net", "/es", None, "allow") and one[None] == ("notexample.com", "/en/1", "com/", "allow")
    assert all(one[i][3] == "block" for i in (10, *range(102, 140)))
    assert redirects.judge(spark, p.limit(0)).count() == 0


def test_relative_aliases(spark):
    link = "<link rel='alternate canonical' href='%s'>"
    at = "http://a.org/x/y?q"
    want = {"//b.net/fr/1": "http://b.net/fr/1", "/z": "http://a.org/z", "z": "http://a.org/x/z", "../z?u=http://c.org/": "http://a.org/z?u=http://c.org/", "./": "http://a.org/x/",
            "/../k/./z": "http://a.org/k/z", "..": "http://a.org/", "?p": "http://a.org/x/y?p", "/go?u=http://c.org/": "http://a.org/go?u=http://c.org/", "#f": None, "": None, "mailto:x": None, "https://C.org/": "https://C.org/"}
    t = spark.createDataFrame([(at, k) for k in want], "url string, target string")
    assert {r.target: r.to for r in t.select("target", redirects.resolve(t.url, t.target).alias("to")).collect()} == want
    # a chain of relative links ends at a blocked page, and many pages move to one target
    rows = [(i, f"http://e.org/c/{i}", link % f"{i + 1}") for i in range(120)] + [(120, "http://e.org/c/120", link % "//q.net/fr/")]
    rows += [(1000 + i, f"http://f.org/{i}", "<meta http-equiv=refresh content='0; url=//example.com/en/hot'>") for i in range(200)]
    rows += [(5000, "http://g.org/", "<p>canonical"), (5001, None, link % "/x"), (5002, "nothing", link % "/x")]
    got = {r.page_id: r.verdict for r in redirects.judge(spark, spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert len(got) == len(rows) and all((got[r[0]] == "block") == (r[0] < 5000) for r in rows)


# --- op6 --------------------------------------------------------------------

def test_decontamination(spark):
    item = words(40, 1)
    mixed = item[20:30] + ["zz"] + item[0:12] + ["yy"] + item[30:40]
    rows = ODD + [(20, " ".join(words(50, 2) + item + words(50, 3))), (21, " ".join(mixed).upper()), (22, " ".join(item[:15])), (23, " ".join(words(300, 4))), (20, " ".join(item))]
    items = spark.createDataFrame([(1, " ".join(item), "c"), (2, " ".join(item), "c"), (3, "a b", "c"), (4, None, "c"), (None, "", "c"), (5, "long long long long long long", "c")], "item_id bigint, text string, doc string")
    got = sorted((r.doc_id, r.item_id, round(r.coverage, 3), r.tiles) for r in tiling.find(spark, docs(spark, rows), items).collect())
    assert got == [(5, 5, 1.0, 1), (20, 1, 1.0, 1), (20, 1, 1.0, 1), (20, 2, 1.0, 1), (20, 2, 1.0, 1), (21, 1, 0.8, 3), (21, 2, 0.8, 3)]
    assert tiling.find(spark, docs(spark, []), items).count() == 0 and tiling.find(spark, docs(spark, rows), items.limit(0)).count() == 0


# --- op7 --------------------------------------------------------------------

def _near(rows):
    lab = {}
    for i, w in orderminhash._each([r[1] for r in rows]):
        lab[i] = orderminhash.labelled(w)
    pairs = [(i, j) for i in lab for j in lab if i < j and orderminhash.similarity(lab[i], lab[j]) >= 0.8]
    return _classes(pairs) | {}


def test_near_duplicates(spark):
    base, other = words(200, 1), words(150, 2)
    swap = lambda w, *at: [("q%d" % i if i in at else x) for i, x in enumerate(w)]
    rows = ODD + [(30, " ".join(base)), (31, " ".join(swap(base, 3))), (32, " ".join(swap(base, 3, 180))), (33, " ".join(base[100:] + base[:100])), (34, " ".join(other)), (35, " ".join(other[:-8])),
                  (36, " ".join(words(150, 3))), (40, " ".join(words(60, 5) + base[:60])), (41, " ".join(words(60, 6) + base[:60])), (37, " ".join(base)), (30, " ".join(base))]
    rows += [(1000 + i, " ".join(swap(words(120, 9), i % 110))) for i in range(150)]  # a family of near copies
    up = _near(rows)
    of = {}
    for i, r in enumerate(rows):
        of.setdefault(up.get(i, i), []).append(r[0])
    want = {}
    for i, r in enumerate(rows):
        members = [m for m in of[up.get(i, i)] if m is not None]
        want.setdefault((r[0], min(members, default=None)), 0)
        want[r[0], min(members, default=None)] += 1
    out = orderminhash.classes(spark, docs(spark, rows)).collect()
    got = {}
    for r in out:
        got[r.doc_id, r.class_id] = got.get((r.doc_id, r.class_id), 0) + 1
    assert got == want and len(out) == len(rows)
    left = orderminhash.first_of_each(spark, docs(spark, rows))
    assert left.columns == DOCS.replace(",", "").split()[::2] and left.count() == len(of)
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(min([m for m in v if m is not None], default=None)) for v in of.values())
    assert orderminhash.classes(spark, docs(spark, [])).count() == 0 and orderminhash.first_of_each(spark, docs(spark, [])).count() == 0


def test_near_duplicates_among_texts_just_below_the_threshold(spark):
    base = words(120, 9)
    swap = lambda w, i, *at: [f"q{i}" + "abcdefgh"[at.index(j)] if j in at else x for j, x in enumerate(w)]
    strangers = [swap(base, i, 7 + i % 50, 62 + (i * 7 + i // 50 * 11) % 50) for i in range(240)]  # two edits each: four between two of them
    rows = [(i, " ".join(w)) for i, w in enumerate(strangers)] + [(1000 + i, " ".join(swap(strangers[i], 1000 + i, 30 + i % 40))) for i in range(0, 240, 3)]
    up, of = _near(rows), {}
    for i, r in enumerate(rows):
        of.setdefault(up.get(i, i), []).append(r[0])
    want = {m: min(v) for v in of.values() for m in v}
    assert len(set(want.values())) > 100 and {r.doc_id: r.class_id for r in orderminhash.classes(spark, docs(spark, rows)).collect()} == want


# --- op8 and op9 ------------------------------------------------------------

def _labelled(spark):
    rnd = np.random.default_rng(8)
    rows, labels = [], []
    for i in range(400):
        w = [f"w{x}" for x in rnd.integers(0, 300, 60)]
        if i % 4 == 0:
            w[int(rnd.integers(0, 60))] = str(rnd.choice(["vile", "rotten", "filthy"]))
            w[int(rnd.integers(0, 60))] = "vile"
        text = " ".join(w)
        rows.append((i, text.upper() + "!!" * 40 if i % 5 == 0 else text))
        labels.append((i, int(i % 5 != 0), int(i % 4 == 0), 3))
    return rows, spark.createDataFrame(labels + [(0, 1, 1, 3), (0, None, 1, 3), (None, 1, 1, 3), (2, None, None, 3)], "doc_id bigint, quality int, toxic int, score int")


def test_toxicity_on_held_out_rows(spark):
    rows, labels = _labelled(spark)
    got = kneserney.classify(spark, docs(spark, rows + ODD), labels, **queries.TOXICITY).collect()
    assert len(got) == len(rows) + len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.doc_id is not None and 6 < r.doc_id and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert len(held) > 50 and np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.9
    for none in (labels.limit(0), labels.where("toxic = 0")):
        assert {r.predicted for r in kneserney.classify(spark, docs(spark, rows[:30]), none, **queries.TOXICITY).collect()} == {0}
    assert kneserney.classify(spark, docs(spark, []), labels, **queries.TOXICITY).count() == 0


def test_toxicity_counts_are_exact(spark):
    """More than 4,096 contexts of a word, words that share the first 20 bits of their hash, and several pairs in each such range."""
    from studyloom.llm.words import word_hashes
    many = " ".join(f"c{i} hot" for i in range(20_000))
    name = [f"v{i}" for i in range(6000)]
    hashed = word_hashes([" ".join(name).encode()])[0]
    bucket, n = np.unique(kneserney._bucket(hashed), return_counts=True)
    twins = [name[i] for i in np.flatnonzero(np.isin(kneserney._bucket(hashed), bucket[n > 1]))]
    assert len(twins) > 10
    text = [" ".join(f"{a}{j} {w} {w}x" for w in twins for j in range(4)) for a in "pq"]
    rows = [(0, many), (1, many), (2, text[0]), (3, text[1])]
    want = {}
    for _, t in rows:
        w = [""] + t.split()
        for a, b in zip(w, w[1:]):
            want.setdefault(b, set()).add(a)
    known = ["hot", *twins]
    at = word_hashes([" ".join(known).encode()])[0]
    order = np.argsort(at)
    got = {r.word: r.contexts for r in kneserney.contexts_of(docs(spark, rows), "text", 5, at[order]).collect()}
    assert [got[i] for i in range(len(known))] == [len(want[known[j]]) for j in order] and got[0] != got[len(known)]
    assert got[len(known)] == sum(len(v) for k, v in want.items() if k not in known)
    labelled = spark.createDataFrame([(text[0], 1), (text[1], 0)], "text string, y int")
    packed = kneserney.fit_counts(labelled, lambda words: kneserney.contexts_of(docs(spark, rows), "text", 5, words))
    m = {k: np.frombuffer(kneserney.zlib.decompress(z), t) for k, (t, z) in packed[1].items()}
    at = {w: i for w, i in zip(twins, np.searchsorted(m["words"], word_hashes([" ".join(twins).encode()])[0]))}
    assert len(m["pairs"]) == len(twins)  # "w wx" after four words each; no place is taken by another pair
    assert all(m[0, 0][i] == m[0, 1][i] == 4 and m["shared"][i] == 8 for i in at.values()) and sorted(m[1, 1][:-1]) == [4] * len(twins)


def test_quality_on_held_out_rows(spark):
    rows, labels = _labelled(spark)
    run = lambda d, lab: quadratic.classify(spark, d, lab, "doc_id", "text", "quality", queries.bucket("doc_id", 3) != 1).collect()
    got = run(docs(spark, rows + ODD), labels)
    assert len(got) == len(rows) + len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.doc_id is not None and 6 < r.doc_id and r.held_out]
    assert len(held) > 80 and np.mean([r.predicted == (r.doc_id % 5 != 0) for r in held]) > 0.95
    assert {r.score for r in run(docs(spark, rows[:20]), labels.limit(0))} == {0.5} and run(docs(spark, []), labels) == []


# --- op10 -------------------------------------------------------------------

@pytest.mark.parametrize("segment", [16, 10_000])
def test_top_k(spark, segment):
    rnd = np.random.default_rng(10)
    rows = [(int(i), [float(x) for x in rnd.normal(0, 0.2, 6)]) for i in range(130)] + [(200 + i, [0.5] * 6) for i in range(60)]
    odd = [(None, [0.1] * 6), (300, None), (350, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (400, [float("nan")] * 6), (450, [float("inf")] * 6)]
    rows += [(7, rows[7][1]), (100, rows[3][1]), (60, [2.0 ** 21, 0.0, 0.0, 0.0, 0.0, 0.25])]  # repeated ids are rows of their own; large components stay in
    d = spark.createDataFrame([(*r, 1, 2) for r in rows + odd], "vec_id bigint, embedding array<float>, id int, score int")
    v = bitsliced.quantise(d, "vec_id", "embedding")
    got = bitsliced.top_k(spark, v, v.where("id % 50 = 0"), 5, segment_rows=segment, query_rows=2).collect()
    q = [(i, np.floor(256 * np.array(x, np.float32).astype(float)).astype(int)) for i, x in rows]
    want = [(i, n, b, s) for at, (i, x) in enumerate(q) if i % 50 == 0
            for n, (s, b) in enumerate(sorted(((int(x @ y), j) for to, (j, y) in enumerate(q) if to != at), key=lambda t: (-t[0], t[1]))[:5], 1)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(want)
    huge = spark.createDataFrame([(50, [1e300, 0.0]), (1, [2.0 ** 21, 0.0]), (2, [-1e300, 1.0]), (2, [3.0, 3.0]), (3, [0.0, 1.0])], "vec_id bigint, embedding array<double>")
    h = bitsliced.quantise(huge, "vec_id", "embedding")
    told = [(r.rank, r.vec_id, r.score) for r in bitsliced.top_k(spark, h, h.where("id = 50"), 5).orderBy("rank").collect()]
    assert told == [(1, 1, 2 ** 63 - 1), (2, 2, 2 ** 63 - 1), (3, 3, 0), (4, 2, -2 ** 63)]
    few = bitsliced.quantise(d.where("vec_id in (50, 51, 52)"), "vec_id", "embedding")
    assert bitsliced.top_k(spark, few, few.where("id % 50 = 0"), 5).count() == 2
    none = v.limit(0)
    assert bitsliced.top_k(spark, none, none, 5).count() == 0


# --- pipeline ---------------------------------------------------------------

def test_pipeline_stages(spark, tmp_path, vocabulary):
    rows, labels = _labelled(spark)
    item = words(40, 1)
    rows += [(500, " ".join(item)), (502, rows[2][1]), (503, rows[3][1] + " end"), *ODD]
    d = docs(spark, rows)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at, seen = d, []
    for name, stage in corpus_pipeline.STAGES:
        at = Scratch(spark).keep(stage(spark, at, str(tmp_path)))
        seen.append([r.doc_id for r in at.select("doc_id").collect()])
        assert name == "token_ids" or at.columns == d.columns
    toxic, near, clean, mixture, coded = map(set, seen)
    assert len([i for i in range(0, 400, 4) if i in toxic]) < 12 and len([i for i in range(400) if i % 4 and i not in toxic]) < 12
    assert {2, 3} <= near and not {502, 503} & near and toxic - near <= {502, 503, 2, 3, 4, 1, 6}
    assert near - clean == {500} and mixture == clean == coded and len(seen[3]) == len(seen[4]) and None in coded
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(i or 0 for i in seen[4])


def test_a_family_of_near_copies_is_linked_by_few_links(spark):
    base = words(120, 9)
    rows = [(i, " ".join(f"q{i}" if j == i % 110 else w for j, w in enumerate(base))) for i in range(200)]
    out = orderminhash.classes(spark, docs(spark, rows)).collect()
    assert {r.class_id for r in out} == {0} and sum(r.links for r in out) <= 2 * (orderminhash.FEW + 1) * len(rows)


def test_members_of_a_bucket_meet_once_in_whatever_parts(spark):
    at = [(2, 7, 20, bytes([i]), 5, bytes([i // 2]), [-i - 1, i, 3], [1, 2, 3, 4, 5 + i % 2]) for i in range(20)]
    d = spark.createDataFrame(at, "band int, key bigint, size bigint, node binary, n int, component binary, keys array<bigint>, seq array<bigint>")
    want = [(bytes([i]), bytes([j])) for i in range(20) for j in range(i + 1, 20) if i // 2 != j // 2 and i % 2 == j % 2]
    for part in (3, 19, 512):
        assert sorted((bytes(r.a), bytes(r.b)) for r in orderminhash._apart(d, part).collect()) == want
