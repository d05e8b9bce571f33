import struct

import pytest
from pyspark.sql import functions as F

from tidemark.config import load
from tidemark.schema import ColumnSpec, eligibility, schema_at, schema_versions
from tidemark.sources.copytext import parse_line, plan_ranges, read_copy
from tidemark.plans.engine import Engine
from tidemark.sources.framelog import FrameLog, LogTail, read_segment, verify_log
from tidemark.sources.frames import Decoder, Frame, FrameError, changes_of, crc32c, ddl_events, decode_frame, encode_frame, log_problems, parse_frames, transactions
from tidemark.sources.store import CommitConflict, TableStore
from tidemark.streaming.apply import StreamApply
from tidemark.streaming.ingest import Ingest


def begin(xid):
    return b"B" + struct.pack(">QqI", 1, 0, xid)


def commit(lsn):
    return b"C" + struct.pack(">BQQq", 0, lsn, lsn, 0)


def relation(columns=("id", "name")):
    return b"R" + struct.pack(">I", 7) + b"app\0t\0d" + struct.pack(">H", len(columns)) + b"".join(bytes([k == 0]) + c.encode() + b"\0" + struct.pack(">Ii", 25, -1) for k, c in enumerate(columns))


def cells(*values):
    return struct.pack(">H", len(values)) + b"".join(b"n" if v is None else b"u" if v is ... else b"t" + struct.pack(">I", len(v)) + v.encode() for v in values)


def insert(*values):
    return b"I" + struct.pack(">I", 7) + b"N" + cells(*values)


def update(old, *values):
    return b"U" + struct.pack(">I", 7) + (b"K" + cells(*old) if old else b"") + b"N" + cells(*values)


MESSAGES = [begin(1), relation(), insert("1", "a"), commit(20), begin(2), update(("1", None), "2", ...), insert("3", None), b"T" + struct.pack(">IBI", 1, 0, 7), commit(30)]


def frames(messages=MESSAGES):
    return [Frame(k, k, 20 if k <= 4 else 30, m[:1] == b"C", m) for k, m in enumerate(messages, 1)]


def test_checksum_and_frames():
    assert crc32c(b"123456789") == 0xE3069283
    raw = encode_frame(frames()[0])
    assert decode_frame(raw) == (frames()[0], len(raw))
    for bad, why in ((raw[:5], "truncated header"), (raw[:-3], "truncated payload"), (b"XXXX" + raw[4:], "magic"), (raw[:-1] + bytes([raw[-1] ^ 1]), "checksum")):
        with pytest.raises(FrameError, match=why):
            decode_frame(bad)


def test_decoder_commits_rewinds_and_refuses():
    d = Decoder()
    got = d.feed(frames()[:6])
    assert [(c["lsn"], c["ord"], c["op"], c["new"]) for c in got] == [(20, 1, "I", {"id": ("t", "1"), "name": ("t", "a")})]
    d.abort_open()
    got = d.feed(frames()[4:])
    assert [(c["op"], c["ord"]) for c in got] == [("U", 1), ("I", 2), ("T", 3)] and got[0]["new"]["name"] == ("u", None) and got[0]["old"]["id"] == ("t", "1")
    with pytest.raises(FrameError, match="gap"):
        d.feed([Frame(99, 0, 0, False, begin(3))])
    for bad, why in (([insert("1", "a")], "outside"), ([begin(1), insert("1", "a")], "before its description"), ([b"Z"], "unknown message"), ([commit(1)], "outside")):
        with pytest.raises(FrameError, match=why):
            Decoder().feed(frames(bad))


def test_distributed_decoding(spark):
    parsed = parse_frames(spark.createDataFrame([(bytearray(encode_frame(f)),) for f in frames()], "raw binary")).cache()
    assert log_problems(parsed).count() == 0
    got = [(r["lsn"], r["ord"], r["kind"]) for r in transactions(parsed).orderBy("seq").collect()]
    assert got == [(20, 1, "I"), (30, 1, "U"), (30, 2, "I"), (30, 3, "T")]
    assert [r["problem"] for r in log_problems(parsed.where("seq <> 3")).collect()] == ["gap"]
    assert transactions(parsed.where("seq < 8")).count() == 1


def test_log_resumes_after_the_last_commit(tmp_path):
    log = FrameLog(tmp_path, segment_bytes=80)
    for f in frames():
        log.append(f.lsn_start, f.lsn_end, f.txn_complete, f.payload)
    assert log.durable_lsn == 30 and verify_log(tmp_path) == {"frames": 9, "commits": 2, "last_lsn": 30}
    tail = LogTail(tmp_path)
    assert len(tail.read_new()[0]) == 9
    log.append(31, 31, False, begin(3))
    log.flush()
    assert [f.seq for f in tail.read_new()[0]] == [10]
    again = FrameLog.resume(tmp_path, 80)
    assert (again.next_seq, again.durable_lsn) == (10, 30)
    assert tail.read_new() == ([], True)
    again.set_stalled(True)
    again.append(40, 40, True, commit(40))
    assert again.durable_lsn == 30
    again.set_stalled(False)
    assert again.durable_lsn == 40 and len(tail.read_new()[0]) == 1


def test_copy_text(spark, tmp_path):
    assert parse_line("42\thello\\t\t\\N\t") == ["42", "hello\t", None, ""]
    (tmp_path / "c.txt").write_text("1\tt\ta\\\\nb\\n\n2\tf\t\\N\n")
    got = read_copy(spark, str(tmp_path / "c.txt"), [ColumnSpec("id", 20, True), ColumnSpec("ok", 16), ColumnSpec("s", 25)]).collect()
    assert [tuple(r) for r in got] == [(1, True, "a\\nb\n"), (2, False, None)]
    assert plan_ranges(10, 3) == [(0, 3), (3, 6), (6, None)]


def test_schema_registry(spark):
    two, three = ["a", "b"], ["a", "b", "c"]
    shapes = spark.createDataFrame([(1, "t", 100, two), (1, "t", 150, two), (1, "t", 200, three), (1, "t", 300, two)], "relid bigint, name string, valid_from_lsn bigint, columns array<string>")
    versions = schema_versions(shapes)
    assert versions.count() == 3
    assert [len(r["columns"]) if (r := schema_at(versions, at).first()) else None for at in (99, 100, 150, 200, 250, 300)] == [None, 2, 2, 3, 3, 2]
    assert [eligibility(*a) for a in (("f", False, False), ("n", False, True), ("d", False, True), ("i", False, True))] == ["full (identity FULL inflates the log)", "append-only", "full", "append-only"]


def test_store_commits_closes_and_compacts(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "t")).create("app.t", [ColumnSpec("id", 20, True)])
    head = 2**63 - 1
    rows = lambda *ids, at: spark.createDataFrame([(i, 0, head, at) for i in ids], "id bigint, __ord int, __lsn_to bigint, __lsn bigint")
    store.append(rows(1, 2, 3, at=100), 100)
    store.append(rows(4, at=200), 200)
    store.close(spark.createDataFrame([(2, 300)], "id bigint, at bigint"), ["id"], 300)
    ids = lambda lsn: sorted(r["id"] for r in store.at(lsn).collect())
    for _ in range(2):
        assert (ids(99), ids(100), ids(299), ids(300)) == ([], [1, 2, 3], [1, 2, 3, 4], [1, 3, 4])
        store.compact(1)
    assert store.manifest()["applied_lsn"] == 300 and len(store.manifest()["segments"]) == 1 and store.visible_rows() == 3


def test_a_crash_between_draft_and_commit_changes_nothing(spark, tmp_path, monkeypatch):
    store = TableStore(spark, str(tmp_path / "t")).create("app.t", [ColumnSpec("id", 20, True)])
    head = 2**63 - 1
    rows = lambda *ids, at: spark.createDataFrame([(i, 0, head, at) for i in ids], "id bigint, __ord int, __lsn_to bigint, __lsn bigint")
    store.append(rows(1, 2, at=100), 100)

    def crash(*_):
        raise RuntimeError("crash")

    with monkeypatch.context() as m:
        m.setattr(TableStore, "_rename", crash)
        with pytest.raises(RuntimeError):
            store.append(rows(3, at=200), 200)
    again = TableStore(spark, str(tmp_path / "t"))
    assert again.visible_rows() == 2 and again.applied_lsn == 100 and sorted(r["id"] for r in again.at().collect()) == [1, 2]
    again.append(rows(3, at=200), 200)
    assert sorted(r["id"] for r in again.at().collect()) == [1, 2, 3]
    stale = again.manifest() | {"number": again.manifest()["number"] - 1}
    with pytest.raises(CommitConflict):
        again._commit(stale)


def test_store_applies_changes_once_and_flushes_open_rows(spark, tmp_path):
    ddl = "lsn bigint, ord int, op string, id bigint, name string, old_id bigint, unchanged array<string>"
    log = [
        (10, 1, "I", 1, "a", None, None), (10, 2, "I", 2, "b", None, None), (20, 1, "U", 3, None, 1, ["name"]), (30, 1, "U", 3, None, None, ["name"]),
        (40, 1, "D", 2, None, None, None), (50, 1, "I", 2, "again", None, None), (60, 1, "T", None, None, None, None), (70, 1, "I", 9, "z", None, None),
    ]
    changes = spark.createDataFrame(log, ddl)
    want = {10: {1: "a", 2: "b"}, 25: {3: "a", 2: "b"}, 35: {3: "a", 2: "b"}, 40: {3: "a"}, 55: {3: "a", 2: "again"}, 60: {}, 70: {9: "z"}}
    for n, steps in enumerate(([100], [10, 20, 30, 40, 50, 60, 70], [25, 45, 70])):
        store = TableStore(spark, str(tmp_path / f"t{n}"), flush_rows=3).create("app.t", [ColumnSpec("id", 20, True), ColumnSpec("name", 25)])
        for upto in steps:
            store.apply(changes.where(F.col("lsn") <= upto), upto)
            store.apply(changes.where(F.col("lsn") <= upto), upto)  # again
        for at, state in want.items():
            assert {r["id"]: r["name"] for r in store.at(at).collect()} == state, (steps, at)
            assert {r["id"]: r["name"] for r in store.versions().where(f"__lsn <= {at} and __lsn_to > {at}").collect()} == state
        assert store.visible_rows() == 1 == store.at().count() and store.manifest()["segments"]
    with pytest.raises(Exception, match="unknown key"):
        store.apply(spark.createDataFrame([(80, 1, "D", 77, None, None, None)], ddl), 80)
    plan = store.at(55)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(__lsn,55)" in plan and "GreaterThan(__lsn_to,55)" in plan


def test_stream_applies_once(spark, tmp_path):
    schema = "id bigint, lsn bigint, ord int, sha256 string, deleted boolean"
    source, out = str(tmp_path / "in"), StreamApply(spark, str(tmp_path / "out"), schema)
    put = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    run = lambda ck: out.start(spark.readStream.schema(schema).parquet(source), str(tmp_path / ck), availableNow=True).awaitTermination()
    put((1, 10, 1, "a", False), (2, 20, 1, "b", False))
    run("ck")
    put((1, 30, 1, "c", True))
    run("ck")
    assert (out.rows().count(), out.applied_lsn()) == (3, 30)
    out.apply_batch(spark.createDataFrame([(1, 30, 1, "c", True), (9, 40, 1, "d", False)], schema), 77)
    assert (out.rows().count(), out.applied_lsn()) == (4, 40)
    with pytest.raises(Exception, match="differs"):
        out.apply_batch(spark.createDataFrame([(1, 30, 1, "other", True)], schema), 78)


def test_transactions_span_segments(spark):
    parsed = parse_frames(spark.createDataFrame([(bytearray(encode_frame(f)),) for f in frames()], "raw binary")).cache()
    want = [(20, 1, "I"), (30, 1, "U"), (30, 2, "I"), (30, 3, "T")]
    for cut in ([3], [6], [2, 4, 6, 7], list(range(2, 10))):
        inside = parsed.withColumn("segment", sum((F.when(F.col("seq") >= c, 1).otherwise(0) for c in cut), F.lit(0)))
        assert [(r["lsn"], r["ord"], r["kind"]) for r in transactions(inside).orderBy("seq").collect()] == want
        assert log_problems(inside).count() == 0 and [r["seq"] for r in log_problems(inside.where("seq <> 4")).collect()] == [5]
    named = changes_of(parsed).orderBy("seq").collect()
    assert [(r["table"], r["op"], r["new"], r["old"], r["unchanged"]) for r in named[:2]] == [
        ("app.t", "I", {"id": "1", "name": "a"}, None, []), ("app.t", "U", {"id": "2", "name": None}, {"id": "1", "name": None}, ["name"]),
    ]


def test_a_log_becomes_answers_and_a_restart_in_mid_transaction_changes_nothing(spark, tmp_path):
    specs = [ColumnSpec("id", 20, True), ColumnSpec("name", 25)]
    ddl_relation = b"R" + struct.pack(">I", 8) + b"tidemark\0ddl_log\0d" + struct.pack(">H", 4) + b"".join(b"\0" + c + b"\0" + struct.pack(">Ii", 25, -1) for c in (b"kind", b"command_tag", b"object_identity", b"ddl_text"))
    ddl_insert = b"I" + struct.pack(">I", 8) + b"N" + cells("ddl", "ALTER TABLE", "app.t", "ALTER TABLE app.t ...")
    work = [
        (10, [relation(), insert("1", "a"), insert("2", "b")]), (20, [update(("1", None), "3", ...)]), (30, [update(None, "3", ...), insert("4", None), ddl_relation, ddl_insert]),
        (40, [b"T" + struct.pack(">IBI", 1, 0, 7), insert("9", "z")]),
    ]

    def write(log, steps, last=True):
        for lsn, messages in steps:
            for m in [begin(lsn), *messages]:
                log.append(lsn, lsn, False, m)
            if last or lsn != steps[-1][0]:
                log.append(lsn, lsn, True, commit(lsn))
        log.flush()

    def follow(folder, root, checkpoint):
        tables = Ingest(spark, str(root), {"app.t": specs})
        tables.start(str(folder), str(checkpoint), availableNow=True).awaitTermination()
        return tables

    write(FrameLog(tmp_path / "whole", segment_bytes=100), work)
    whole = follow(tmp_path / "whole", tmp_path / "a", tmp_path / "ca")
    log = FrameLog(tmp_path / "parts", segment_bytes=150)
    write(log, work[:2], last=False)
    assert follow(tmp_path / "parts", tmp_path / "b", tmp_path / "cb").applied_lsn == 10
    again = FrameLog.resume(tmp_path / "parts", 150)  # cut back to the last commit
    write(again, work[1:])
    parts = follow(tmp_path / "parts", tmp_path / "b", tmp_path / "cb")
    fresh = follow(tmp_path / "parts", tmp_path / "b", tmp_path / "other")  # all of it once more
    want = {10: {1: "a", 2: "b"}, 20: {3: "a", 2: "b"}, 30: {3: "a", 2: "b", 4: None}, 40: {9: "z"}}
    for at, state in want.items():
        for tables in (whole, parts, fresh):
            assert {r["id"]: r["name"] for r in tables.stores["app.t"].at(at).collect()} == state
    e = Engine(spark).attach("app.t", parts.stores["app.t"])
    df, proof = e.query("SELECT count(*) AS n FROM app.t", "strong")
    assert df.first()["n"] == 1 and proof.target_lsn == 40
    rows = [f for p in sorted((tmp_path / "whole").glob("*.frames")) for f in read_segment(p)[0]]
    parsed = parse_frames(spark.createDataFrame([(bytearray(encode_frame(f)),) for f in rows], "raw binary"))
    assert [(r["lsn"], r["command_tag"], r["object_identity"]) for r in ddl_events(changes_of(parsed)).collect()] == [(30, "ALTER TABLE", "app.t")]


def test_a_snapshot_begins_a_table(spark, tmp_path):
    tables = Ingest(spark, str(tmp_path / "r"), {"app.t": [ColumnSpec("id", 20, True), ColumnSpec("name", 25)]})
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, name string")
    for _ in range(2):
        tables.snapshot("app.t", rows, 15)
    parsed = parse_frames(spark.createDataFrame([(bytearray(encode_frame(f)),) for f in frames([begin(1), relation(), insert("1", "a"), commit(10)])], "raw binary"))
    tables.apply_batch(parsed.withColumn("lsn_end", F.lit(10).cast("bigint")))
    assert tables.stores["app.t"].at(14).count() == 0 and tables.stores["app.t"].at().count() == 2


def test_config(spark, tmp_path, monkeypatch):
    (tmp_path / "t.toml").write_text('data_dir = "d"\nflush_rows = 5\n')
    monkeypatch.setenv("TIDEMARK_LOG_BUDGET", "9")
    c = load(tmp_path / "t.toml")
    assert (c.data_dir, c.flush_rows, c.log_budget_bytes) == (tmp_path.resolve() / "d", 5, 9)
    assert [c.rung(n) for n in (4, 5, 7)] == [0, 1, 2] and c.ingest(spark, {}).stores == {}


def test_a_batch_of_changes_is_read_once(spark, tmp_path):
    ddl = "lsn bigint, ord int, op string, id bigint, body string"
    table, seen = TableStore(spark, str(tmp_path / "t")).create("app.t", [ColumnSpec("id", 20, True), ColumnSpec("body", 25)]), spark.sparkContext.accumulator(0)

    def counted(batches):
        for rows in batches:
            seen.add(len(rows))
            yield rows

    for lsn, op in ((10, "I"), (20, "U"), (30, "D")):
        table.apply(spark.createDataFrame([(lsn, n, op, n, f"{op}{n}") for n in range(5 if op == "I" else 2)], ddl).mapInPandas(counted, ddl), lsn)
    assert seen.value == 5 + 2 + 2
    assert sorted(tuple(r) for r in table.at(20).select("id", "body").collect()) == [(0, "U0"), (1, "U1"), (2, "I2"), (3, "I3"), (4, "I4")]
    assert sorted(r["id"] for r in table.at(30).collect()) == [2, 3, 4] and not list((tmp_path / "t").glob("draft-*"))
