"""Files, sinks and streams that need a folder."""
import json
import os
from datetime import date, datetime, timedelta

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from studyloom.operators import analytics, memory
from studyloom.sources import files, sinks
from studyloom.sources.keyed import KeyedTable
from studyloom.sources.views import Views
from studyloom.streaming import jobs as J
from tests.conftest import rows


def test_scan_and_catalog(spark, tmp_path):
    for name, n in (("a.pdf", 3), ("b.TXT", 5), ("c.exe", 1), ("sub/扫码.png", 2)):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(b"x" * n)
    cat = files.file_catalog(files.scan(spark, str(tmp_path)))
    assert rows(cat, "name", "ext", "size") == [("a.pdf", "pdf", 3), ("b.TXT", "txt", 5)]


def test_json_banks_first_id_wins(spark, tmp_path):
    paths = []
    for i, bank in enumerate(([{"id": "1", "stem": "a"}, {"id": "2", "stem": "b"}], [{"id": "2", "stem": "c"}, {"id": "3", "stem": "d"}])):
        p = tmp_path / f"{i}.json"
        p.write_text(json.dumps(bank, indent=1))
        paths.append(str(p))
    b = files.first_id_wins(files.read_json_banks(spark, paths, "id string, stem string"))
    assert rows(b, "id", "stem") == [("1", "a"), ("2", "b"), ("3", "d")]


def test_text_pages(spark, tmp_path):
    (tmp_path / "t.txt").write_text("one  page\n here\ftwo")
    assert rows(files.read_text_pages(spark, str(tmp_path)), "page", "text") == [(0, "one page here"), (1, "two")]


def test_replace_kind_leaves_others(spark, tmp_path):
    path = str(tmp_path / "t")
    mk = lambda data: spark.createDataFrame(data, "id int, kind string")
    sinks.replace_kind(mk([(1, "paper"), (2, "book")]), path)
    sinks.replace_kind(mk([(3, "book")]), path)
    assert rows(spark.read.parquet(path), "id", "kind") == [(1, "paper"), (3, "book")]


def test_export_import(spark, tmp_path):
    path = str(tmp_path / "dump")
    t = {"settings": spark.createDataFrame([("name", "x"), ("api_key", "secret")], "key string, value string")}
    sinks.export_tables(t, path, "app", "e1", [("settings", F.col("key") == "api_key", "value")])
    schema = {"settings": "key string, value string, extra int"}
    assert rows(sinks.import_tables(spark, path, schema, "app", "e1")["settings"]) == [("api_key", "", None), ("name", "x", None)]
    with pytest.raises(ValueError):
        sinks.import_tables(spark, path, schema, "app", "other")


def _split_log(sf, out, parts):
    t = pq.read_table(f"{sf}/events.parquet").sort_by("event_id")
    n = -(-t.num_rows // parts)
    for i in range(parts):
        path = f"{out}/events-{i}.parquet"
        pq.write_table(t.slice(i * n, n), path)
        os.utime(path, (1700000000 + i, 1700000000 + i))  # the file source reads by time


def test_streams_over_several_files_equal_batch(spark, sf, tmp_path):
    log, v = tmp_path / "log", Views(spark, sf)
    log.mkdir()
    _split_log(sf, log, 4)
    a = J.attempts_of(J.read_log(spark, str(log)))
    J.write_changes(J.daily_activity(a), str(tmp_path / "day"), str(tmp_path / "c2"), ["day"], ranges=1)
    got = rows(J.latest(spark, str(tmp_path / "day"), ["day"]), "day", "questions", "correct")
    assert got == rows(analytics.daily_activity(v.attempts, v.study.where("false"), "2000-01-01"), "day", "questions", "correct")
    # files of one batch may be split anywhere: nothing here depends on rows of a batch being in order
    J.write_changes(J.wrongbook(a), str(tmp_path / "wb"), str(tmp_path / "c1"), ["user_id", "qid"])
    assert rows(J.latest(spark, str(tmp_path / "wb"), ["user_id", "qid"])) == rows(memory.wrongbook_fold(v.attempts))


def _held(q):
    return sum(op["numRowsTotal"] for op in q.lastProgress["stateOperators"])


def _log(spark, tmp_path, name, rows_):
    """Attempt rows (id, user, question, correct, day) as the next file of a log, and the log as a stream."""
    at = [(i, u, k, c, datetime(2024, 1, 1) + timedelta(days=d)) for i, u, k, c, d in rows_]
    df = spark.createDataFrame(at, "id bigint, user_id bigint, qid bigint, correct bigint, created_at timestamp")
    df = df.withColumn("module", F.lit("m")).withColumn("day", F.to_date("created_at"))
    df.coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / name))


def test_last_write_takes_repeated_and_late_rows_and_forgets_them(spark, tmp_path):
    first = [(i, 1, i % 5, i % 2, i // 100) for i in range(400)]
    late = [(1000, 1, 3, 1, 3), (390, 1, 0, 0, 3), (2, 1, 2, 0, 2.5)]  # newer; an older row of a key that has newer ones; delivered a second time under an old id
    held, seen = [], []
    for part in (first, first[300:] + late, [(1001, 1, 3, 0, 3.5)], [(1002, 2, 9, 1, 30)], [(1003, 2, 9, 0, 60)]):
        d = _log(spark, tmp_path, "log", part)
        held.append(_held(J.write_changes(J.last_write(d), str(tmp_path / "t"), str(tmp_path / "c"), ["user_id", "qid"], "append", order="id", ranges=4)))
        seen += part
        want = {}
        for i, u, k, c, _ in seen:
            want[u, k] = max(want.get((u, k), (-1, 0)), (i, c))
        got = {(r.user_id, r.qid): (r.id, r.correct) for r in J.latest(spark, str(tmp_path / "t"), ["user_id", "qid"]).collect()}
        assert got == want
    assert held[0] > 90 and held[-1] <= 2  # what was delivered more than a day before the newest row is forgotten
    ranges = [n for v in os.listdir(tmp_path / "t") if v.startswith("v") for n in os.listdir(tmp_path / "t" / v) if n.startswith("__range")]
    assert len(ranges) <= 2 * 4  # at most two versions of a key range, however many merges there were


def test_keyed_table(spark, tmp_path):
    path = str(tmp_path / "t")
    mk = lambda *r: spark.createDataFrame(r, "k int, x string, n bigint")
    t = KeyedTable(spark, path, ["k"], 3)
    t.merge(mk())
    assert t.read().count() == 0
    for i in range(6):
        t.merge(mk((i % 2, f"a{i}", i), (None, "null key", i)))
    assert {tuple(r) for r in t.read().collect()} == {(0, "a4", 4), (1, "a5", 5), (None, "null key", 5)}
    o = KeyedTable(spark, str(tmp_path / "o"), ["k"], 1)
    o.merge(mk((1, "new", 9), (1, "older", 3)), order="n")
    o.merge(mk((1, "late", 4), (2, "x", 1)), order="n")
    o.merge(mk((1, "late", 4), (2, "x", 1)), order="n")  # run again
    assert rows(o.read()) == [(1, "new", 9), (2, "x", 1)]
    (tmp_path / "t" / "v7").mkdir()  # a merge that died before its manifest
    t.merge(mk((5, "on", 1)))
    assert t.read().count() == 4


def test_rebuild_leaves_untouched_files_alone(spark, tmp_path):
    path = tmp_path / "t"
    t = KeyedTable(spark, str(path), ["rel"], 16)
    cat = lambda rows_: spark.createDataFrame(rows_, "rel string, mtime int, size int")
    built = []

    def build(todo):
        built.append(sorted(r.rel for r in todo.collect()))
        return todo.select("rel", F.explode(F.sequence(F.lit(0), F.col("size"))).alias("seq"), F.concat("rel", F.lit("@"), "mtime").alias("text"))
    old = cat([(f"f{i}", 1, 2) for i in range(40)])
    assert {r.status for r in files.rebuild(t, cat([]), old, build).collect()} == {"new"} and t.read().count() == 120
    bad = spark.createDataFrame([("f9", 0, "f9\ufffd")], "rel string, seq int, text string")
    t.replace(bad.select("rel"), bad)
    stamps = lambda: {(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    before = stamps()
    new = cat([(f"f{i}", 2 if i == 3 else 1, 2) for i in range(40) if i != 5] + [("g", 1, 0)])
    status = {r.rel: r.status for r in files.rebuild(t, old, new, build, F.contains("text", F.lit("\ufffd"))).collect()}
    assert {k: s for k, s in status.items() if s != "unchanged"} == {"f3": "changed", "f5": "deleted", "f9": "repaired", "g": "new"} and built[-1] == ["f3", "f9", "g"]
    got = {(r.rel, r.seq): r.text for r in t.read().collect()}
    assert got == {(r, i): f"{r}@{m}" for r, m, n in [tuple(x) for x in new.collect()] for i in range(n + 1)}
    touched = {r[0] for r in spark.createDataFrame([(x,) for x in ("f3", "f5", "f9", "g")], "rel string").select(t._dealt()).collect()}
    same = {k: x for k, x in before.items() if int(k[0].rsplit("=", 1)[1]) not in touched}
    after = stamps()
    assert same and all(after[k] == x for k, x in same.items())
    files.rebuild(t, new, cat([]), build)
    assert t.read().count() == 0  # a range that is empty now has no folder


def test_mastered_questions_leave_the_book(spark, tmp_path):
    log, day, i = [], 0, 0
    d = lambda rows_: spark.createDataFrame([(a, 1, 7, c, date(2024, 1, 1) + timedelta(days=b)) for a, c, b in rows_], "id bigint, user_id bigint, qid bigint, correct bigint, day date")
    log.append((0, 0, 0))
    while True:  # answer on the day it is due until it is mastered
        r = memory.wrongbook_fold(d(log)).first()
        if r.mastered:
            break
        i, day = i + 1, (r.next_review - date(2024, 1, 1)).days
        log.append((i, 1, day))
    keys, held = ["user_id", "qid"], []
    right = [(500, 3, 3, 1, 0)]  # never wrong: no state at all
    for part in (right + [(a, 1, 7, c, b) for a, c, b in log], [(900, 2, 8, 0, day + 10)], [(901, 2, 8, 0, day + 60)], [(902, 2, 8, 0, day + 70)]):
        s = _log(spark, tmp_path, "log", part)
        held.append(_held(J.write_changes(J.wrongbook(s, idle=30), str(tmp_path / "t"), str(tmp_path / "c"), keys)))
    book = {(x.user_id, x.qid): x for x in J.latest(spark, str(tmp_path / "t"), keys).collect()}
    assert set(book) == {(1, 7), (2, 8)} and book[1, 7].mastered == 1 and tuple(book[1, 7]) == tuple(r)
    assert book[2, 8].wrong_count == 3 and held[1] > held[-1]


def test_no_answer_is_left_out_of_the_book(spark, tmp_path):
    """A mastered question that is wrong again after years goes on from its row, and an answer that comes late counts."""
    log, day, keys = [(0, 1, 7, 0, 0)], 0, ["user_id", "qid"]
    fold = lambda part: memory.wrongbook_fold(spark.createDataFrame([(i, u, q, c, date(2024, 1, 1) + timedelta(days=x)) for i, u, q, c, x in part], "id bigint, user_id bigint, qid bigint, correct bigint, day date"))
    while not (r := fold(log).first()).mastered:
        day = (r.next_review - date(2024, 1, 1)).days
        log.append((len(log), 1, 7, 1, day))
    parts = [log, [(500, 2, 8, 0, day + 400)], [(501, 3, 9, 0, day + 380), (502, 1, 7, 0, day + 900), (503, 1, 7, 1, day + 901)]]
    for part in parts:
        J.write_changes(J.wrongbook(_log(spark, tmp_path, "log", part), buckets=4), str(tmp_path / "t"), str(tmp_path / "c"), keys)
    want = rows(fold(sum(parts, [])))
    assert rows(J.latest(spark, str(tmp_path / "t"), keys)) == want and [x[:3] for x in want] == [(1, 7, 2), (2, 8, 1), (3, 9, 1)]


def test_questions_of_a_bucket_share_a_state_row(spark, tmp_path):
    part = [(i, i % 50, i % 120, i // 7 % 2, i // 70) for i in range(600)] + [(700 + i, i, None, 0, 9) for i in range(3)]
    held = [_held(J.write_changes(J.wrongbook(_log(spark, tmp_path, "log", some), buckets=4), str(tmp_path / "t"), str(tmp_path / "c"), ["user_id", "qid"]))
            for some in (part[:300], part[300:])]
    log = spark.createDataFrame([(a, u, q, c, date(2024, 1, 1) + timedelta(days=b)) for a, u, q, c, b in part], "id bigint, user_id bigint, qid bigint, correct bigint, day date")
    got = {tuple(r)[:4] for r in J.latest(spark, str(tmp_path / "t"), ["user_id", "qid"]).collect()}
    want = {tuple(r)[:4] for r in memory.wrongbook_fold(log.where("qid is not null")).collect()} | {(i, None, 1, 0) for i in range(3)}
    assert len(want) > 100 and got == want and held[-1] <= 4


def test_closed_months_leave_the_usage(spark, tmp_path):
    held = []
    for part in ([(u, date(2024, 1, 5), 10) for u in range(50)], [(1, date(2024, 2, 1), 5), (1, date(2024, 1, 31), 7)], [(1, date(2024, 4, 1), 1)], [(2, date(2024, 4, 2), 1)]):
        df = spark.createDataFrame(part, "user_id bigint, day date, input_tokens bigint").withColumn("output_tokens", F.lit(1).cast("bigint"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        u = spark.readStream.schema(df.schema).parquet(str(tmp_path / "log"))
        held.append(_held(J.write_changes(J.usage_cap(u, 15), str(tmp_path / "t"), str(tmp_path / "c"), ["user_id", "month"])))
    got = {(r.user_id, r.month): (r.tokens, r.over_limit) for r in J.latest(spark, str(tmp_path / "t"), ["user_id", "month"]).collect()}
    assert got[1, date(2024, 1, 1)] == (19, 1) and got[1, date(2024, 2, 1)] == (6, 0) and got[2, date(2024, 4, 1)] == (2, 0) and len(got) == 53
    assert held[0] == 50 and held[-1] <= 3


def test_the_callers_state_store_stays(spark, tmp_path):
    spark.conf.unset(J.STORE)
    before = spark.conf.get(J.STORE)
    d = _log(spark, tmp_path, "log", [(1, 1, 1, 1, 0)])
    J.write_changes(J.last_write(d), str(tmp_path / "t"), str(tmp_path / "c"), ["user_id", "qid"], "append", order="id")
    assert spark.conf.get(J.STORE) == before


def test_short_words_and_empty_queries_by_index(spark):
    from studyloom.operators import search as T
    blocks = spark.createDataFrame([(1, 0, "the end of it"), (1, 1, "nothing"), (2, 0, "of")], "doc int, seq int, text string")
    index = T.trigram_index(blocks)
    assert [(r.doc, r.seq) for r in T.search_indexed(index, blocks, "of").collect()] == [(1, 0), (2, 0)]
    assert [(r.doc, r.seq) for r in T.search_indexed(index, blocks, "noth").collect()] == [(1, 1)]
    assert T.search_indexed(index, blocks, "  ").count() == 0


def test_fragments_are_literal(spark):
    from studyloom.operators import cleaning as C
    blocks = spark.createDataFrame([(1, 0, "keep \\E(a|b) 12"), (1, 1, "\\E(a|b) 3"), (1, 2, "ab")], "doc int, seq int, text string")
    cut = C.cut_fragments(blocks, spark.createDataFrame([(1, "\\E(a|b)")], "doc int, fragment string"))
    assert [(r.seq, r.text) for r in cut.orderBy("seq").collect()] == [(0, "keep"), (2, "ab")]


def test_headings_below_level_four(spark):
    from studyloom.operators import blocks as B
    rows = [(1, 0, "h", 1, "a"), (1, 1, "h", 5, "b"), (1, 2, "p", 0, "x"), (1, 3, "h", 7, "c"), (1, 4, "h", 5, "d")]
    d = spark.createDataFrame(rows, "doc int, seq int, kind string, level bigint, text string")
    assert [r.path for r in B.heading_path(d).orderBy("seq").collect()] == ["a", "a > b", "a > b", "a > b > c", "a > d"]
    assert [r.level for r in B.level_renest(d).orderBy("seq").collect()] == [1, 2, 0, 3, 2]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace
    from studyloom.session import checkpoint_dir
    context = SimpleNamespace(master="spark://x:7077", getConf=lambda: SimpleNamespace(get=lambda *a: None), getCheckpointDir=lambda: None)
    with pytest.raises(ValueError):
        checkpoint_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context))


def test_replace_writes_one_range_a_task(spark, tmp_path):
    from studyloom.sources.keyed import KeyedTable
    rows_ = spark.range(400).selectExpr("id AS doc", "'x' AS text")
    table = KeyedTable(spark, f"{tmp_path}/t", ["doc"], 8)
    table.replace(rows_.select("doc"), rows_)
    files = [(f.parent.name, f.name.split("-")[1]) for f in (tmp_path / "t" / "v1").glob("*/*.parquet")]
    assert len(files) == 8 == len({task for _, task in files}) and table.read().count() == 400
    assert [KeyedTable.ranges_for(n) for n in (None, 0, 25_000_000, 1_000_000_000, 6_000_000_000)] == [8, 8, 8, 63, 375]
