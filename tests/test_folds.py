"""Folds and scans against plain sequential code, with one key that owns most rows."""
import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from studyloom.functions import fsrs as M
from studyloom.operators import folds, joins, memory, nearcopies, scan
from studyloom.streaming import jobs as J
from tests.conftest import rows

D0 = date(2024, 1, 1)


def _log(n, seed, grades=False):
    r = random.Random(seed)
    out = []
    for i in range(n):
        key = (1, 1) if r.random() < 0.6 else (r.randint(1, 3), r.randint(1, 4))
        day = D0 + timedelta(days=i * 60 // n)
        out.append((i, *key, day, r.randint(1, 4) if grades else int(r.random() < 0.6)))
    return out


def test_wrongbook_equals_one_row_at_a_time(spark):
    log = _log(600, 1)
    want = {}
    for _i, u, q, day, ok in log:
        st = want.get((u, q), (0, 0, 0, 0, 0.0, 0.0, 0, 0))
        want[u, q] = J.fold_day(st, q, (day - J.EPOCH).days, bool(ok), 0 if ok else 1)
    d = spark.createDataFrame(log, "id bigint, user_id bigint, qid bigint, day date, correct bigint")
    got = {(r.user_id, r.qid): r for r in memory.wrongbook_fold(d).collect()}
    want = {k: s for k, s in want.items() if s[0]}
    assert set(got) == set(want)
    for k, (n, stage, nxt, mastered, s, dd, last, reps) in want.items():
        r = got[k]
        assert (r.wrong_count, r.stage, r.mastered, r.reps) == (n, stage, mastered, reps)
        assert (r.next_review - J.EPOCH).days == nxt and (r.last_review - J.EPOCH).days == last
        assert abs(r.stability - s) < 1e-3 and abs(r.difficulty - dd) < 1e-3


def test_wrongbook_until_mastered(spark):
    log, day = [(0, 1, 1, D0, 0)], D0 + timedelta(days=1)
    for i in range(1, 9):
        log.append((i, 1, 1, day, 1))
        d = spark.createDataFrame(log, "id bigint, user_id bigint, qid bigint, day date, correct bigint")
        r = memory.wrongbook_fold(d).first()
        if r.mastered:
            break
        day = r.next_review
    assert r.mastered == 1 and (r.next_review - r.last_review).days >= 30


def test_right_before_due_changes_nothing(spark):
    base = [(0, 1, 1, D0, 0)]
    mk = lambda log: memory.wrongbook_fold(spark.createDataFrame(log, "id bigint, user_id bigint, qid bigint, day date, correct bigint")).first()
    assert mk(base) == mk(base + [(1, 1, 1, D0, 1), (2, 1, 1, D0, 1)])
    assert mk(base).next_review == D0 + timedelta(days=1)


def test_card_fold_chunks_compose(spark, monkeypatch):
    log = _log(500, 2, grades=True)
    d = spark.createDataFrame(log, "id bigint, user_id bigint, qid bigint, day date, grade bigint").withColumn("deck", F.lit("d"))
    whole = rows(memory.card_fold(d))
    monkeypatch.setattr(memory, "CHUNK", 3)
    assert rows(memory.card_fold(d)) == whole
    # the hot card, one review at a time
    s = dd = 0.0
    last = None
    for _i, u, q, day, g in log:
        if (u, q) != (1, 1):
            continue
        if last is None:
            s, dd = M.INIT_S[g], M.INIT_D[g]
        else:
            el = (day - last).days
            easy = M.W[16] if g == 4 else 1.0
            if g == 4 and el >= 1:
                import math
                r = (1 + M.FACTOR * el / s) ** M.DECAY
                s = s * (1 + math.exp(M.W[8]) * (11 - dd) * s ** -M.W[9] * (math.exp(M.W[10] * (1 - r)) - 1) * easy)
            else:
                s = J._stability(s, dd, el, g)
            s, dd = max(0.1, s), min(10.0, max(1.0, dd * M.D_A[g] + M.D_B[g]))
        last = day
    r = memory.card_fold(d).where("user_id = 1 AND qid = 1").first()
    assert abs(r.stability - s) < 1e-3 * max(1, s) and abs(r.difficulty - dd) < 1e-3


def test_scans_cross_buckets(spark):
    r = random.Random(3)
    data = [(k, i, (i if r.random() < 0.2 else None)) for k in (1, 2) for i in range(50)]
    d = spark.createDataFrame(data, "k int, o bigint, v bigint")
    got = rows(scan.running_last(d, ["k"], "o", "v", width=7), "k", "o", "prev")
    want, prev = [], {}
    for k, o, v in sorted(data):
        prev[k] = v if v is not None else prev.get(k)
        want.append((k, o, prev[k]))
    assert got == want
    assert rows(scan.row_numbers(d, ["k"], "o", width=7), "k", "o", "rn") == [(k, o, o + 1) for k, o, _ in sorted(data)]
    left = spark.createDataFrame([(1, 5), (1, 9), (3, 1)], "k int, o bigint")
    right = spark.createDataFrame([(1, 5, 50), (1, 8, 80)], "k int, o bigint, v bigint")
    assert {(a, b): c for a, b, c in rows(scan.asof_backward(left, right, ["k"], "o", "v", width=4).na.fill(-1), "k", "o", "matched")} == {(1, 5): 50, (1, 9): 80, (3, 1): -1}


def test_attach_exact(spark):
    q = lambda s, n, a=None: (s, "q", n, a, "ABCD", False)
    a = lambda s, n, x, t=False: (s, "a", n, x, "", t)
    far = [q(0, 1)] + [(i, "x", 0, None, "", False) for i in range(1, 130)] + [a(130, 1, "A", True)]
    docs = [[q(0, 1), q(1, 1), a(2, 1, "A"), a(3, 1, "B"), a(4, 1, "C")],  # two answers with one number go to two questions, nearest first
            [q(0, 1), a(1, 1, "E"), a(2, 1, "D")],  # a letter that is no option is refused and uses nothing up
            [q(0, 1, "B"), a(1, 1, "A", True)],  # a table key right below may correct an answered question,
            [q(0, 1, "B"), a(1, 1, "A")],  # a plain line may not
            far, [q(0, 1), a(1, 1, None), a(2, 2, "A")]]
    d = spark.createDataFrame([(i, *r) for i, rs in enumerate(docs) for r in rs], "doc bigint, seq bigint, kind string, num bigint, ans string, letters string, table boolean")
    got = rows(folds.attach_exact(d), "doc", "seq", "q_seq", "ans")
    assert got == [(0, 2, 1, "A"), (0, 3, 0, "B"), (1, 2, 0, "D"), (2, 1, 0, "A")]


def _best_chain(c):
    """All chains, by brute force."""
    best = (float("-inf"), [])

    def go(i, score, chain):
        nonlocal best
        if score > best[0] + 1e-9:
            best = (score, chain)
        for j in range(i + 1, len(c)):
            step = c[j][1] - c[i][1]
            if 1 <= step <= 15:
                go(j, score + c[j][2] - 0.2 * (step - 1), chain + [c[j][0]])
            elif c[j][1] == 1 and c[i][1] >= 5 and any(x[3] for x in c[i + 1:j + 1]):
                go(j, score + c[j][2] - 0.8, chain + [c[j][0]])
    for i, x in enumerate(c):
        go(i, x[2] - 0.2 * (x[1] - 1) - (0.5 if x[1] > 1 else 0), [x[0]])
    return best


def test_anchor_chain_is_the_best_one():
    r = random.Random(4)
    for _ in range(40):
        c = [(i, r.randint(1, 8), r.choice([0.4, 1.0]), r.random() < 0.2) for i in range(11)]
        chain = [s for s, _n in folds.anchor_chain(c)]
        score, _ = _best_chain(c)
        by = {x[0]: x for x in c}
        got = None
        for p, s in zip([None] + chain, chain):
            x = by[s]
            if p is None:
                got = x[2] - 0.2 * (x[1] - 1) - (0.5 if x[1] > 1 else 0)
            else:
                step = x[1] - by[p][1]
                got += x[2] - (0.2 * (step - 1) if 1 <= step <= 15 else 0.8)
        assert abs(got - score) < 1e-9


def test_sequence_align():
    mk = lambda side, xs: [(side, i, n, lab, []) for i, (n, lab) in enumerate(xs)]
    a = mk("a", [(5, "x"), (7, "y"), (20, "z"), (5, "w")])
    b = mk("b", [(5, "x"), (20, "z"), (5, "w")])
    assert [(i, j) for i, j, _ in folds.sequence_align(a + b)] == [(0, 0), (2, 1), (3, 2)]
    assert folds.sequence_align(a) == []


def test_run_key_match(spark):
    q = lambda s, n, p: (1, s, "q", n, p, "ABCD", "")
    k = lambda s, p, key: (1, s, "k", 0, p, "", key)
    rows_ = [q(0, 1, 0), q(1, 2, 0), k(2, 0, "1:A,2:B"), q(3, 1, 1), q(4, 2, 1), q(5, 3, 2), k(6, 2, "1:C,2:D,3:E")]
    schema = "doc bigint, seq bigint, kind string, num bigint, page bigint, letters string, key string"
    got = folds.run_key_match(spark.createDataFrame(rows_, schema))
    assert rows(got, "seq", "k_seq", "ans") == [(0, 2, "A"), (1, 2, "B"), (3, 6, "C"), (4, 6, "D")]
    assert folds.run_key_match(spark.createDataFrame([], schema)).count() == 0


def test_near_duplicates_brute_force(spark):
    r = random.Random(5)
    base = ["".join(r.choice("abcdefghij") for _ in range(900)) for _ in range(4)]
    docs = []
    for i in range(40):
        t = list(r.choice(base[:2] if i % 3 else base))
        for _ in range(r.choice([0, 0, 1, 2, 5, 40])):
            t[r.randrange(len(t))] = r.choice("abcdefghij")
        docs.append((i, "".join(t)[: 900 - r.choice([0, 0, 30, 150])]))
    d = spark.createDataFrame(docs, "doc bigint, text string")
    sig = nearcopies.signatures(d, "a-z", mod=4)
    s = {x.doc: (x.n_letters, set(x.sig)) for x in sig.collect()}
    rk = {i: (i % 5, -s[i][0], -i) for i in s}
    near = lambda a, b: (max(s[a][0], s[b][0]) <= min(s[a][0], s[b][0]) * 1.12 and len((s[a] if s[a][0] <= s[b][0] else s[b])[1]) >= 20
                         and len(s[a][1] & s[b][1]) >= 0.9 * min(len(s[a][1]), len(s[b][1])))
    up = {}
    for a in s:
        better = [b for b in s if b != a and rk[b] > rk[a] and near(a, b)]
        if better:
            up[a] = max(better, key=rk.get)
    want = {}
    for a in up:
        k = up[a]
        while k in up:
            k = up[k]
        want[a] = k
    assert dict(rows(nearcopies.near_duplicates(sig, [F.col("doc") % 5]))) == want and want


def test_deck_overlap_brute_force(spark):
    r = random.Random(6)
    decks = {}
    for i in range(60):
        src = r.choice([range(0, 30), range(20, 60), range(100, 110)])
        decks[i] = {x for x in src if r.random() < r.choice([0.3, 0.7, 0.95])} | {999}
    kept = []
    for i in sorted(decks, key=lambda i: (-len(decks[i]), i)):
        if not any(len(decks[i] & decks[k]) > 0.5 * min(len(decks[i]), len(decks[k])) for k in kept):
            kept.append(i)
    d = spark.createDataFrame([(i, x) for i, xs in decks.items() for x in xs], "id bigint, item bigint")
    for window in (1, 64):
        assert rows(nearcopies.deck_overlap(d, window=window)) == sorted((k,) for k in kept)


def test_deck_overlap_settles_families_in_few_rounds(spark, monkeypatch):
    """Eighty look-alikes, a hot item that overlaps nothing, a chain where every second deck stays, equal decks, and no decks."""
    decks = {i: set(range(40)) - {i % 40} | {1000 + i} for i in range(80)}
    decks |= {100 + i: {-1} | set(range(5000 + 10 * i, 5004 + 10 * i)) for i in range(90)}
    decks |= {300 + i: set(range(9000 + 6 * i, 9000 + 6 * i + 13 - i % 2)) for i in range(12)} | {400: {7, 8}, 401: {7, 8}}
    kept = []
    for i in sorted(decks, key=lambda i: (-len(decks[i]), i)):
        if not any(len(decks[i] & decks[k]) > 0.5 * min(len(decks[i]), len(decks[k])) for k in kept):
            kept.append(i)
    d = spark.createDataFrame([(i, x) for i, xs in decks.items() for x in xs], "id bigint, item bigint")
    written, real = [], nearcopies.materialize
    monkeypatch.setattr(nearcopies, "materialize", lambda df: written.append(1) or real(df))
    assert rows(nearcopies.deck_overlap(d)) == sorted((k,) for k in kept)
    assert len(written) < 60 and nearcopies.deck_overlap(d.limit(0)).count() == 0


def test_prefix_match_brute_force(spark):
    r = random.Random(7)
    words = ["".join(r.choice("ab") for _ in range(r.randint(2, 9))) for _ in range(60)]
    left = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "l int, k string")
    right = spark.createDataFrame([(i, w) for i, w in enumerate(words[::-1])], "r int, k string")
    got = dict(rows(joins.prefix_match(left, right, "k", "l", "r", block=3, check=6)))
    want = {}
    for i, k in enumerate(words):
        for j, f in enumerate(words[::-1]):
            if k[:3] == f[:3] and (f.startswith(k[:6]) or k.startswith(f[:6])):
                want.setdefault(i, j)
    assert got == want


def test_deck_overlap_keeps_texts_out_of_its_tables(spark, monkeypatch):
    """Texts of items are read once: no table holds them, and items of a single deck are in none but the first."""
    decks = {1: "abcd", 2: "abce", 3: "xyz", 4: "xyz", 5: "pqrs", 6: "pd"}
    d = spark.createDataFrame([(i, x * 30) for i, xs in decks.items() for x in xs] * 2 + [(7, None)], "id bigint, item string")
    tables, real = [], nearcopies.materialize
    monkeypatch.setattr(nearcopies, "materialize", lambda df: (tables.append(real(df)), tables[-1])[1])
    assert rows(nearcopies.deck_overlap(d)) == [(1,), (3,), (5,), (6,)]
    assert not [c for t in tables for c in t.dtypes if "string" in c[1]] and max(t.count() for t in tables[1:]) == 10


def test_shingle_signatures_are_made_once(spark, sf):
    from studyloom.plans import load_all
    from studyloom.plans.registry import REGISTRY
    from studyloom.sources.views import Views
    load_all()
    plan = REGISTRY["shingle_signatures"].plan(Views(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    made = [line for line in plan.splitlines() if "md5" in line]
    assert len(made) == 1 and "Filter" not in made[0]
