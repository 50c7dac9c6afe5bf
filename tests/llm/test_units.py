"""The parts of the corpus operators against plain versions of themselves."""
import random
import re
import zlib

import numpy as np
import pytest

from studyloom.llm import bitsliced, kneserney, orderminhash, quadratic, rans, tiling, toolcalls
from studyloom.llm.words import groups, shingles, word_hashes

TEXTS = ["", "Ab c", "  à la  carte, À LA CARTE! ", "x" * 70_000, "a\nb\ta b", None, "one two three four five six", "日本 語、日本"]


def test_word_hashes_follow_words():
    seen, words = {}, {}
    for first, folded in groups(TEXTS, 40):
        h, offs = word_hashes(folded)
        for i, t in enumerate(folded):
            plain = re.findall(rb"[0-9a-z\x80-\xff]+", t)
            got = h[offs[i]:offs[i + 1]].tolist()
            assert len(plain) == len(got)
            for w, x in zip(plain, got):
                assert seen.setdefault(w, x) == x and words.setdefault(x, w) == w


def test_shingles_name_runs_of_words():
    h, _ = word_hashes([b"a b a b a b"])
    s = shingles(h, 3).tolist()
    assert s[0] == s[2] and s[1] == s[3] and s[0] != s[1] and len(shingles(h, 7)) == 0


def _lcs(x, y):
    row = [0] * (len(y) + 1)
    for a in x:
        last = 0
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], last + 1 if a == b else max(row[j], row[j - 1])
    return row[-1]


def test_banded_alignment_is_the_longest_common_subsequence():
    rnd = random.Random(1)
    near = 0
    for _ in range(300):
        x = list(range(rnd.randint(1, 40)))
        y = [v if rnd.random() > 0.06 else 1000 + rnd.randint(0, 10**6) for v in x]
        if rnd.random() < 0.4:
            i = rnd.randrange(len(y))
            y.insert(rnd.randrange(len(y)), y.pop(i))
        n = _lcs(x, y)
        want = n / (len(x) + len(y) - n)
        got = orderminhash.similarity(np.array(x, np.uint64), np.array(y, np.uint64))
        assert got <= want + 1e-12 and (want < 0.8 or got == pytest.approx(want))
        near += want >= 0.8
    assert near > 50


def test_order_minhash_tells_order_from_set():
    h = np.arange(1, 400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a = orderminhash.sketches(h)
    assert (a == orderminhash.sketches(h)).all()
    assert (a == orderminhash.sketches(h[::-1].copy())).sum() == 0  # same set, other order
    edited = h.copy()
    edited[7] += np.uint64(1)
    assert (a == orderminhash.sketches(edited)).sum() > 15


def test_repeated_shingles_are_told_apart():
    h, _ = word_hashes([b"a a a a a a a a"])
    lab = orderminhash.labelled(h)
    assert len(lab) == 4 and len(set(lab.tolist())) == 4
    assert len(orderminhash.labelled(h[:3])) == 1 and len(orderminhash.labelled(h[:0])) == 0


def _tiles_plainly(item, doc, least):
    free_i, free_d, out = [True] * len(item), [True] * len(doc), []
    while True:
        best = []
        top = least
        for p in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while p + n < len(item) and d + n < len(doc) and item[p + n] == doc[d + n] and free_i[p + n] and free_d[d + n]:
                    n += 1
                if n > top:
                    top, best = n, [(p, d)]
                elif n == top:
                    best.append((p, d))
        if not best:
            return out
        for p, d in sorted(best):
            if all(free_i[p:p + top]) and all(free_d[d:d + top]):
                free_i[p:p + top] = free_d[d:d + top] = [False] * top
                out.append((p, d, top))


def test_tiles_are_those_of_the_plain_greedy_tiling():
    rnd = random.Random(2)
    for _ in range(60):
        item = np.array([rnd.randint(0, 5) for _ in range(rnd.randint(3, 30))], np.uint64)
        doc = np.array([rnd.randint(0, 5) for _ in range(rnd.randint(3, 50))], np.uint64)
        assert tiling.tiles(item, doc, 3) == _tiles_plainly(item.tolist(), doc.tolist(), 3)


def test_tiles_cover_a_reordered_passage():
    item = np.arange(30, dtype=np.uint64)
    doc = np.concatenate([item[20:], item[:10], item[10:20]])
    assert sum(n for _, _, n in tiling.tiles(item, doc)) == 30
    assert tiling.tiles(item, np.arange(30, dtype=np.uint64), 5, breaks=[4]) == [(4, 4, 26)]


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 70_000, 200_003])
@pytest.mark.parametrize("kinds", [1, 2, 300, 60_000])
def test_rans_round_trip(n, kinds):
    rnd = np.random.default_rng(n + kinds)
    ids = np.minimum(rnd.geometric(min(0.9, 20 / kinds), n) - 1, kinds - 1).astype(np.int64)
    freq, bits = rans.table(np.bincount(ids, minlength=kinds) if n else np.zeros(kinds))
    assert not n or freq.sum() == 1 << bits
    payload, at, states, crc = rans.encode(ids, freq, bits)
    lookup = rans.slots(freq, bits)
    wide = payload.astype(np.uint64)
    assert (rans.decode(wide, at, states, crc, n, freq, bits, lookup) == ids).all()
    if n > rans.CHECK * rans.LANES:  # any part alone
        size = rans.CHECK * rans.LANES
        assert (rans.decode_part(wide, at[1], states[1], min(size, n - size), crc[1], freq, bits, lookup) == ids[size:2 * size]).all()
    if n > 1000 and kinds > 2:
        freq_bytes = len(payload) * 4
        p = np.bincount(ids) / n
        entropy = -(p[p > 0] * np.log2(p[p > 0])).sum() * n / 8
        assert freq_bytes < entropy * 1.03 + rans.LANES * 8


def test_rans_notices_damage():
    ids = np.arange(5000) % 37
    freq, bits = rans.table(np.bincount(ids))
    payload, at, states, crc = rans.encode(ids, freq, bits)
    payload[len(payload) // 2] ^= 1
    with pytest.raises(ValueError):
        rans.decode(payload.astype(np.uint64), at, states, crc, len(ids), freq, bits, rans.slots(freq, bits))


def test_rans_table_keeps_rare_symbols():
    counts = np.array([10**9] + [1] * 60_000 + [0])
    freq, bits = rans.table(counts)
    assert freq.sum() == 1 << bits and freq[1:-1].min() == 1 and freq[-1] == 0


def test_tokens_are_those_of_the_library():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    path = P.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    texts = [t or "" for t in TEXTS] + ["It's 42 <|endoftext|> a<|startoftext|>b", "Ünïcodé a ́b", "ΣΑΣ İstanbul ǅ", "a\x1cb\x1fc d", " x y　z\x85w", "don't we'll!? 1234", "e\u0301 A\u030a \u0130I \u0149 \u017f \u00df-\u1e9e \u00b2\u00bd \u00aa_\u00ba ~`^ \x7f\x01a \u0080", "<|x|> <| a|>"]
    got = [*rans.Tokens(path, most=5).batch(texts), *rans.Tokens(path).batch(texts)]
    want = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)] * 2
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == want


def test_bit_sliced_search_is_exact():
    rnd = np.random.default_rng(3)
    for n, d, k in ((1, 3, 5), (64, 4, 5), (700, 8, 3), (130, 1, 7)):
        x = rnd.integers(-9, 9, (n, d))
        ids = np.sort(rnd.choice(5000, n, replace=False)).astype(np.int64)
        lo, digits, maps = bitsliced.build_segment(x)
        qs = list(rnd.integers(-200, 200, (6, d))) + [x[0], np.zeros(d, np.int64)]
        q_ids = [int(ids[0]), 9999, 9998, int(ids[-1]), 9997, 9996, int(ids[n // 2]), 9995]
        want = []
        for qi, q in zip(q_ids, qs):
            rows = sorted(((-int(v @ q), int(i)) for v, i in zip(x, ids) if i != qi))[:k]
            want += [(qi, i, -s) for s, i in rows]
        assert sorted(bitsliced.search_segment(ids, lo, digits, maps, q_ids, qs, k)) == sorted(want)


def test_quadratic_discriminant_separates_by_covariance():
    rnd = np.random.default_rng(4)
    x = np.concatenate([rnd.normal(0, 1, (4000, 3)), rnd.normal(0, 4, (4000, 3))])
    n, total, square = [4000, 4000], [x[:4000].sum(0), x[4000:].sum(0)], [x[:4000].T @ x[:4000], x[4000:].T @ x[4000:]]
    s = quadratic.score(quadratic.fit(n, total, square), x)
    assert ((s >= 0.5) == (np.arange(8000) >= 4000)).mean() > 0.85
    assert (quadratic.score(quadratic.fit([0, 5], total, square), x) == 0.5).all()


def test_statistics_of_odd_texts():
    x = quadratic.statistics(TEXTS)
    assert np.isfinite(x).all() and (x[0] == x[5]).all() and (quadratic.statistics([TEXTS[2]])[0] == x[2]).all()


def test_toxic_words_outweigh_copies():
    rnd = random.Random(5)
    common = [f"w{i}" for i in range(80)]
    line = lambda: " ".join(rnd.choices(common, k=40))
    bad = [f"{line()} vile {line()}" for _ in range(40)] + ["odd words that only copies hold " * 3] * 60
    good = [line() for _ in range(100)]
    counts = {}
    for kind, c, k in kneserney.context_keys(bad + good, [1] * 100 + [0] * 100):
        counts.setdefault((kind, c), []).append(k)
    flat = []
    for (kind, c), ks in counts.items():
        k, n = kneserney._counted(np.unique(np.concatenate(ks)) >> kneserney.WORD_BITS)
        if kind == 0:
            flat.append((0, c, k, n))
        else:
            before = k >> kneserney.PAIR_BITS
            flat.append((2, c, np.arange(1 << kneserney.WORD_BITS), np.bincount(before, weights=n, minlength=1 << kneserney.WORD_BITS)))
            for i, d in enumerate(kneserney.DISCOUNTS):
                flat.append((3 + i, c, np.arange(1 << kneserney.WORD_BITS), np.bincount(before, weights=np.minimum(n, d), minlength=1 << kneserney.WORD_BITS)))
    packed = kneserney.pack(kneserney.filled(flat, []))
    f = kneserney.features(kneserney.unpacked(packed, 1), [f"{line()} vile {line()}", line(), "odd words that only copies hold", "", None])
    assert f[0, 1] > 2 * f[1, 1] and f[0, 1] > f[2, 1] and (f[3] == 0).all() and (f[4] == 0).all()


def test_canonical_json():
    v = toolcalls.parse('{"b": [1, 2.50, -0.0, 1e21, 1e-7, 0.00001, 9007199254740993], "a": {"\\u20ac": "\\n\\"", "\\ud83d\\ude00": null}, "\\ufb33": true}')
    assert toolcalls.canonical(v) == '{"a":{"€":"\\n\\"","😀":null},"b":[1,2.5,0,1e+21,1e-7,0.00001,9007199254740992],"\ufb33":true}'
    for bad in ('{"a":1,"a":2}', "NaN", "[1,]", '"\\ud800"', "1e999", "", "[" * 100_000):
        with pytest.raises((ValueError, RecursionError)):
            toolcalls.parse(bad)


def test_schema_errors():
    schema = {"type": "object", "required": ["n", "s"], "additionalProperties": False,
              "properties": {"n": {"type": "integer", "minimum": 1}, "s": {"type": ["string", "null"], "enum": ["x", None]}, "l": {"type": "array", "items": {"type": "number"}, "maxItems": 2}}}
    assert toolcalls.errors({"n": 1, "s": None, "l": [1, 2.5]}, schema) == []
    assert toolcalls.errors({"n": {"$ref": "c"}, "s": "x"}, schema) == []
    assert toolcalls.errors({"n": 0, "l": [True, 1, 2], "q": 1}, schema) == ["$.s: missing", "$.l[0]: type", "$.l: maxItems", "$.n: minimum", "$.q: unknown"]
    assert toolcalls.errors([], schema) == ["$: type"] and toolcalls.references({"a": [{"$ref": "x"}, {"b": {"$ref": "y"}}]}) == ["x", "y"]


def test_checksum_is_that_of_zlib():
    ids = np.array([1, 2, 70_000], "<u4")
    assert zlib.crc32(ids.tobytes()) == zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


def test_tokens_of_other_splittings_go_whole():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    path = P.path("byte_bpe_50k.json")
    texts = ["a  b c\n d", "", "It's  42"]
    assert [np.frombuffer(b, "<u4").tolist() for b in rans.Tokens(path).batch(texts)] == [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_hashes_are_found_at_their_own_places():
    rnd = np.random.default_rng(4)
    known = np.unique(np.concatenate([rnd.integers(0, 2**63, 5000).astype(np.uint64) * np.uint64(2), np.arange(40, dtype=np.uint64)]))  # 40 in one range
    table = kneserney.index(known)
    assert (kneserney.find(table, known) == np.arange(len(known))).all()
    assert (kneserney.find(table, known + np.uint64(1))[~np.isin(known + np.uint64(1), known)] == len(known)).all()
    assert kneserney.find(kneserney.index(known[:0]), known[:3]).tolist() == [0, 0, 0]
