import datetime as dt
import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.functions import generator as G
from tidemark.functions import measure as M
from tidemark.functions.ledger import Ledger, LedgerError, Oracle, ReplayMap, canonical_digest, checkpoint, multiset_hash
from tidemark.lsn import HEAD
from tidemark.operators.search import build_index, parse_query, search
from tidemark.plans import histories as H
from tidemark.plans.engine import Engine, StalenessError, budget_rung
from tidemark.plans.queries import ORACLES, QUERIES
from tidemark.schema import ColumnSpec
from tidemark.sources.index_store import IndexStore
from tidemark.sources.store import TableStore

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", ["q1_spend_by_customer", "q3_join_regions", "q5_mid_stream", "v3_newest_version_state", "v6_log_to_intervals", "c14_truncate", "c16_changed_keys", "f8_bm25", "d3_search_join", "o7_compare_states"])
def test_queries_match_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    expected = sorted(found.fetchall(), key=repr)
    assert sorted((tuple(r) for r in QUERIES[name](spark, sf_dir).select(*names).collect()), key=repr) == expected


def test_entry(spark):
    assert entry.entry(spark).columns == ["status", "n", "cents"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_classes_and_proof(spark, sf_dir):
    e = H.engine(spark, sf_dir)
    df, proof = e.query("SELECT count(*) AS n FROM app.orders -- app.events\n", "target_lsn=0/64")
    assert proof.target_lsn == 100 and proof.render().startswith("LSN proof: target=0/64 received=0/1312D00 columnar:app.customers@0/1F4")
    assert e.resolve("") is None and e.resolve("eventual") is None
    with pytest.raises(StalenessError):
        e.resolve("target_lsn=1/0")
    with pytest.raises(StalenessError):
        e.resolve("bounded(3s)")
    assert e.resolve("bounded(30s)") == e.applied_lsn == 400
    with pytest.raises(StalenessError):
        e.resolve("strong", timeout=0.2)
    assert e.resolve("read_your_writes(0/10)") == 400
    with pytest.raises(ValueError):
        e.resolve("sometimes")
    e.history_floor = 50
    with pytest.raises(StalenessError):
        e.resolve("target_lsn=0/1")


def test_rewriting(spark, sf_dir):
    e = H.engine(spark, sf_dir)
    text, found = e._rewrite("SELECT 'app.orders VARCHAR', CAST(a AS VARCHAR) FROM app.orders JOIN search('app.documents', 'it''s') s /* VARCHAR */")
    assert text == "SELECT 'app.orders VARCHAR', CAST(a AS STRING) FROM app__orders JOIN __search_0 s /* VARCHAR */"
    assert found == {"__search_0": ("app.documents", "it's")}
    for bad in ("DROP TABLE app.orders", "SELECT * FROM search('a', b)", "INSERT INTO x SELECT 1"):
        with pytest.raises(ValueError):
            e._rewrite(bad)
    with pytest.raises(ValueError):
        e.query("SELECT * FROM search('app.orders', 'x')")


def test_query_language():
    got = parse_query('a AND b NOT c +d -e "two words" f:g^2', ("f",))
    assert [(c.words, c.must, c.must_not, c.field, c.boost) for c in got] == [
        (("a",), True, False, None, 1), (("b",), True, False, None, 1), (("c",), False, True, None, 1), (("d",), True, False, None, 1),
        (("e",), False, True, None, 1), (("two", "words"), False, False, None, 1), (("g",), False, False, "f", 2),
    ]
    (either, c) = parse_query("(a OR b)^2 AND c")
    assert either.must and either.boost == 2 and [x.words for x in either.group] == [("a",), ("b",)] and c.must
    (both, d) = parse_query("a AND b OR d")
    assert [x.must for x in both.group] == [True, True] and d.words == ("d",) and not d.must
    for bad in ("x:y", "xyl*", "(a", "a)"):
        with pytest.raises(ValueError):
            parse_query(bad)


def test_index_follows_its_table_and_answers_as_of_positions(spark, tmp_path):
    ddl = "lsn bigint, ord int, op string, id bigint, body string"
    table = TableStore(spark, str(tmp_path / "t")).create("app.t", [ColumnSpec("id", 20, True), ColumnSpec("body", 25)])
    index = IndexStore(spark, str(tmp_path / "i"), ["body"])
    steps = [(10, [("I", 1, "zephyr quokka runs"), ("I", 2, "marmot runs, quokka zephyr")]), (20, [("U", 1, "xylophone marmot")]), (30, [("D", 2, None)])]
    for lsn, changes in steps:
        table.apply(spark.createDataFrame([(lsn, n, *c) for n, c in enumerate(changes, 1)], ddl), lsn)
        index.apply(table).apply(table)  # the second time there is nothing new
        assert index.applied_lsn == lsn
    find = lambda q, lsn: sorted(r["key"] for r in search(index.index(), q, lsn=lsn).collect())
    assert find("quokka", 10) == ["1", "2"] and find("quokka", 20) == ["2"] and find("quokka", 30) == []
    assert find('"zephyr quokka"', 10) == ["1"] and find('"quokka zephyr"', 10) == ["2"] and find('body:"runs quokka"', 10) == ["2"]
    assert find("(zephyr OR xylophone) AND marmot", 20) == ["1", "2"] and find("(zephyr OR xylophone) AND runs", 20) == ["2"]
    assert find("*", 20) == ["1", "2"] and find("* -marmot", 10) == ["1"] and find("zephyr AND NOT (marmot OR owl)", 10) == ["1"]
    assert [r["n"] for lsn in (9, 10, 30) for r in index.index().num_docs(lsn).collect()] == [0, 2, 1]
    e = Engine(spark).attach("app.t", table, index=index)
    assert [r["id"] for r in e.query("SELECT t.id FROM search('app.t', 'xylophone') s JOIN app.t t ON CAST(t.id AS VARCHAR) = s.key")[0].collect()] == [1]
    table.apply(spark.createDataFrame([(40, 1, "I", 7, "owl")], ddl), 40)
    e.refresh_stored()
    assert e.applied_lsn == 40 == index.applied_lsn and e.query("SELECT key FROM search('app.t', 'owl')")[0].first()["key"] == "7"
    with pytest.raises(Exception, match="DROP|only queries"):
        e.query("DROP TABLE app.t")
    record = e.state()
    assert record["queries"] == 3 and record["errors"] == 1 and record["shapes"] == {"columnar:app.t": "0/28", "search:app.t": "0/28"} and "query failed" in record["events"][0]["event"]


def test_every_hit_is_returned_unless_a_limit_is_asked_for(spark):
    rows = spark.range(10_050).selectExpr("id", "if(id % 2 = 0, 'fox', 'fox owl fox') AS body", "CAST(10 AS BIGINT) AS __lsn")
    index = build_index(rows, F.col("id"), ["body"])
    assert search(index, "fox").count() == 10_050 and search(index, "+fox -owl").count() == 5_025
    assert search(index, "owl fox", 7).count() == 7
    versions = rows.selectExpr("id", "body", "0 AS __ord", f"{HEAD} AS __lsn_to", "__lsn")
    e = Engine(spark).attach("app.t", versions, 10, ("id",), ("body",))
    assert e.query("SELECT t.id FROM search('app.t', 'fox') s JOIN app.t t ON CAST(t.id AS VARCHAR) = s.key")[0].count() == 10_050


def _beside_sql(spark, folder, name):
    """The rows of a query over documents in a folder, and those of its SQL."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    return sorted((tuple(r) for r in QUERIES[name](spark, str(folder)).select(*names).collect()), key=repr), sorted(found.fetchall(), key=repr)


def test_search_queries_give_every_document_of_their_sql(spark, tmp_path):
    docs = spark.range(10_500).selectExpr("id * 41 AS doc_id", "if(id % 100 = 0, 'ononst thatin', 'Thatin ' || id) AS text")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("d3_search_join", "f8_bm25", "f9_required_and_banned"):
        got, expected = _beside_sql(spark, tmp_path, name)
        assert len(got) > 10_000 and got == expected


def test_no_limit_is_planned_where_none_is_asked_for(spark, tmp_path):
    """Whatever the number of hits: no count of rows can show that a larger one would not be cut."""
    spark.range(100).selectExpr("id AS doc_id", "'Thatin ' || id AS text").write.parquet(str(tmp_path / "documents.parquet"))
    cuts = lambda df: [w for w in ("Limit", "Sample", "Tail", "Offset") if w in df._jdf.queryExecution().optimizedPlan().toString()]
    for name in ("d3_search_join", "f8_bm25", "f9_required_and_banned", "f9_groups_and_phrases"):
        assert cuts(QUERIES[name](spark, str(tmp_path))) == []
    assert cuts(search(H.stored_index(spark, str(tmp_path)).index(), "thatin", 7)) == ["Limit"]


def test_missing_texts_do_not_count_in_the_average_length(spark, tmp_path):
    texts = ["thatin a b", "thatin", None, "", "a b c d xylophone thatin", None]
    spark.createDataFrame([(n, t) for n, t in enumerate(texts, 1)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got, expected = _beside_sql(spark, tmp_path, "f8_bm25")
    assert len(got) == 3 and got == expected


def test_a_dotted_capital_does_not_end_a_word(spark, tmp_path):
    texts = ["THAT\u0130N ononsti", "thatin b", "that\u0130n", "ONONST thatin", "thati n", "\u0130\u0130 \u212a xylophone K\u0130"]
    spark.createDataFrame([(n, t) for n, t in enumerate(texts, 1)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for name, n in (("f9_required_and_banned", 3), ("f8_bm25", 5), ("f9_groups_and_phrases", 4)):
        got, expected = _beside_sql(spark, tmp_path, name)
        assert len(got) == n and got == expected
    index = build_index(spark.createDataFrame([(1, "\u0130zmir", 10), (2, "i zmir", 10)], "id bigint, body string, __lsn bigint"), F.col("id"), ["body"])
    assert [r["key"] for r in search(index, "\u0130ZM\u0130R").collect()] == ["1"]


def test_postings_are_made_inside_their_rows_and_lie_sorted_by_term(spark, tmp_path):
    texts = ["b a b", "", None, "a", "Zoo b-a " * 40]
    state = spark.createDataFrame([(n, t, 10) for n, t in enumerate(texts)], "id bigint, body string, __lsn bigint")
    made = build_index(state, F.col("id"), ["body"]).postings
    words = {str(n): (t or "").lower().replace("-", " ").split() for n, t in enumerate(texts)}
    want = {(k, w, len(ws), tuple(i for i, x in enumerate(ws) if x == w)) for k, ws in words.items() for w in ws}
    got = [(r["key"], r["term"], r["len"], tuple(r["at"])) for r in made.collect()]
    assert len(got) == len(want) and set(got) == want
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    ddl = "lsn bigint, ord int, op string, id bigint, body string"
    table = TableStore(spark, str(tmp_path / "t")).create("app.t", [ColumnSpec("id", 20, True), ColumnSpec("body", 25)])
    table.apply(spark.createDataFrame([(10, n, "I", n, f"w{n % 7} v{n} u") for n in range(300)], ddl), 10)
    assert table.stored_bytes() > 0 == table.stored_bytes(10)
    IndexStore(spark, str(tmp_path / "i"), ["body"]).apply(table)
    for file in (tmp_path / "i").glob("part-*/postings/*.parquet"):
        terms = duckdb.sql(f"SELECT term FROM read_parquet('{file}')").fetchnumpy()["term"].tolist()
        assert terms == sorted(terms)


def test_tables_without_a_key_are_searched_by_a_synthetic_one(spark):
    rows = [("red fox", 0, HEAD, 10), ("red fox", 0, HEAD, 10), ("blue fox", 0, HEAD, 20)]
    versions = spark.createDataFrame(rows, "body string, __ord int, __lsn_to bigint, __lsn bigint")
    e = Engine(spark).attach("app.notes", versions, 20, (), ("body",))
    got = [r["key"] for r in e.query("SELECT key FROM search('app.notes', 'fox')")[0].collect()]
    assert len(got) == 2 and {k.split("-")[0] for k in got} == {"10", "20"}


def test_engine_names_functions_as_queries_do(spark, sf_dir):
    e = H.engine(spark, sf_dir)
    one = lambda sql: tuple(e.query(sql)[0].first())
    assert one("SELECT sha256('a') AS s, strpos('abc', 'c') AS p, starts_with('abc', 'ab') AS w, array_length(array(1, 2)) AS n") == (hashlib.sha256(b"a").hexdigest(), 3, True, 2)
    assert sorted(r["x"] for r in e.query("SELECT t.x FROM unnest(array(3, 4)) AS t(x)")[0].collect()) == [3, 4]
    plan = e.query("SELECT status, count(*) AS n FROM app.orders GROUP BY status", "target_lsn=0/190", strict=False)[0]._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "LessThanOrEqual(__lsn,400)" in plan and "GreaterThan(__lsn_to,400)" in plan and plan.count("FileScan") == 1


def test_generator(spark):
    assert int(G.mix64(0)) == 0xE220A8397B1DCDAF and int(G.mix64(np.uint64(0x61C8864680B583EC))) == 0x5692161D100B05E5
    rows = G.rows("orders", range(400), 5)
    assert rows == G.rows("orders", range(400), 5) != G.rows("orders", range(400), 6)
    tenants = set(G.rows("tenants", range(20), 5)["tenant_id"])
    assert set(rows["tenant_id"]) <= tenants and set(rows["customer_id"]) <= set(G.rows("customers", range(100), 5)["customer_id"])
    got = [r["order_id"] for r in G.generate(spark, "orders", 20, 5).orderBy("order_id").collect()]
    assert got == rows["order_id"]
    ops = [G.operation(k) for k in range(5000)]
    assert [sum(o == x for o, _ in ops) for x in ("insert", "update", "delete")] == [4500, 400, 100]
    sizes = G.transaction_rows(range(10_000)).tolist()
    assert [sizes.count(n) for n in (1, 10, 100, 1000)] == [9500, 400, 90, 10]
    assert {t: list(G.rows(t, [0], 5)) for t in ("customers", "orders")}["customers"][3] == "email_domain" and set(G.long_tail_cents([0] * 2400, range(2400))) == set(range(100, 2500))
    events, orders = G.rows("order_events", range(600), 5), G.rows("orders", range(200), 5)
    tenant_of = dict(zip(orders["order_id"], orders["tenant_id"], strict=True))
    assert all(tenant_of[o] == t for o, t in zip(events["order_id"], events["tenant_id"], strict=True))
    assert max(G.zipf_rank(range(100_000)).tolist()) == 64
    b = G.TokenBucket(10, 5)
    assert b.take(5, 0) == 0 and b.take(1, 0) == pytest.approx(0.1)


def test_parameters_render_and_load(spark, tmp_path):
    p = G.query_parameters(7, 3, 1000)
    assert p == G.query_parameters(7, 3, 1000) != G.query_parameters(7, 4, 1000) and len(p["tenant_set"]) == 8 and p["tenant_set"][0] == p["tenant_id"]
    text = G.render_sql("SELECT ':tenant_id', CAST(:window_end - INTERVAL '7' DAY AS STRING) AS w WHERE 5 IN (:tenant_set) OR true AND 1 < :tenant_id", p)
    assert "':tenant_id'" in text and ":window" not in text and spark.sql(text).count() == 1
    with pytest.raises(ValueError, match="unresolved"):
        G.render_sql("SELECT :other", p)
    got = G.load_until(spark, str(tmp_path / "d"), 5, 60_000, step=20)
    assert {t: spark.read.parquet(str(tmp_path / "d" / t)).count() for t in G.TABLES} == got and got["orders"] == 20 * got["tenants"]
    assert spark.read.parquet(str(tmp_path / "d/orders")).select("order_id").distinct().count() == got["orders"]
    hashes = G.batch_hashes(G.generate(spark, "tenants", 3, 5), "tenant_id", 200).orderBy("batch").collect()
    lines = ["\t".join(map(str, r)) + "\n" for r in zip(*G.rows("tenants", range(3), 5).values(), strict=True)]
    assert [r["sha256"] for r in hashes] == [hashlib.sha256("".join(x).encode()).hexdigest() for x in (lines[:2], lines[2:])]


def test_checkpoints_compare_and_always_resume():
    seen = []
    ok = lambda lsn: {"q1": f"d{lsn}"}
    run = lambda **engines: checkpoint(lambda: seen.append("pause"), lambda: 40, ok, engines, lambda d: seen.append(d["lsn"]), lambda: seen.append("resume"))
    assert run(a=ok, b=ok)["engines"] == ["a", "b"] and seen == ["pause", 40, "resume"]
    with pytest.raises(LedgerError, match="b differs at 40 in q1"):
        run(a=ok, b=lambda lsn: {"q1": "other"})
    assert seen == ["pause", 40, "resume", "pause", "resume"]


def test_rules():
    assert (M.percentile([1, 2, 3, 4, 100], 0.5), M.percentile([1, 2, 3, 4, 100], 0.95), M.percentile([0], 0.5)) == (3, 100, 1)
    assert M.rounded_percentile([1, 2, 3, 4], 0.5) == 3
    assert [M.cell(a, (1000, 1000)).value for a in ((940, 990), (1000, 1020), (940, 1100), (1100, 1100))] == ["win", "tie", "conflict", "loss"]
    assert M.cell((0, 0), (0, 0)) is M.Verdict.TIE and M.cell((1000, 1050), (1000, 1000)) is M.Verdict.CONFLICT and M.cell((1000, 1049), (1000, 1000)) is M.Verdict.TIE
    cells = dict(zip(("q1", "q2", "q3", "q4", "q5"), [M.Verdict.WIN] * 4 + [M.Verdict.TIE], strict=True))
    assert M.scorecard(cells, 0.9, 0.8) and not M.scorecard(cells, 0.91, 0.8) and not M.scorecard(cells | {"q5": M.Verdict.LOSS}, 0.9, 0.8)
    assert not M.scorecard(dict(zip("abcde", cells.values(), strict=True)), 0.9, 0.8)
    short = M.Interval(90, 100, 10, 0)
    assert M.stop_reason([short] * 2) is None and M.stop_reason([short] * 3) == "rate"
    assert M.stop_reason([M.Interval(100, 100, 10, (11 << 30) + k) for k in range(3)]) == "backlog"
    assert M.stop_reason([M.Interval(100, 100, 1001, 0)]) == "freshness"
    assert (M.stage_done({"q": 30}, 10, 10), M.stage_done({"q": 3}, 10, 10), M.stage_done({"q": 3}, 20, 10)) == (True, False, None)
    assert M.scaled_capacity(101) == 137 and M.freshness_at([(1, 10), (5, 20)], 4, 50) == 40 and len(M.STAGES) == 15 and len(M.Invalid) == 12
    assert [budget_rung(x, 100) for x in (49, 50, 70)] == [0, 1, 2]


def test_ledgers(tmp_path):
    log = Ledger.open(tmp_path / "l")
    log.append({"op": 1})
    log.append({"op": 2})
    assert Ledger.open(tmp_path / "l").last == log.last
    text = (tmp_path / "l").read_text()
    for broken in (text.replace('"op": 1', '"op": 3'), "".join(text.splitlines(True)[1:]), text + text):
        (tmp_path / "l").write_text(broken)
        with pytest.raises(LedgerError):
            Ledger.verify(tmp_path / "l")
    assert canonical_digest([(1, None), ("a", 2)]) == canonical_digest([("a", 2), (1, None)]) != canonical_digest([(1, "N;"), ("a", 2)])
    assert multiset_hash([b"b", b"a"]) == multiset_hash([b"a", b"b"]) != multiset_hash([b"a", b"b", b"b"])
    m = ReplayMap()
    m.push(1, 10, 100)
    m.push(2, 20, 200)
    assert (m.at(9), m.at(15), m.at(20)) == (None, 100, 200)
    with pytest.raises(LedgerError):
        m.push(4, 30, 300)
    o = Oracle()
    o.apply(1, 10, "x", [("insert", "orders", 1, {"status": "new", "cents": 5})])
    o.apply(2, 20, "y", [("update", "orders", 1, {"status": "paid"})])
    o.apply(3, 30, "z", [("delete", "orders", 1, None)])
    assert [o.at("orders", at) for at in (9, 10, 20, 30)] == [{}, {1: {"status": "new", "cents": 5}}, {1: {"status": "paid", "cents": 5}}, {}]
    for bad in ((5, 40, "q", []), (4, 30, "q", []), (4, 40, "x", []), (4, 40, "q", [("delete", "orders", 1, None)])):
        with pytest.raises(LedgerError):
            o.apply(*bad)


@pytest.mark.parametrize("name", ["sql_percent_rank", "sql_math", "sql_strings", "sql_regexp", "sql_hashing", "sql_varchar_cast"])
def test_queries_give_every_row(spark, name):
    con, path = duckdb.connect(), "/root/testdata/sf0.01"
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    expected = sorted(found.fetchall(), key=repr)
    got = sorted((tuple(r) for r in QUERIES[name](spark, path).select(*names).collect()), key=repr)
    assert got == expected and len(got) == con.execute(f"SELECT count(*) FROM {H.orders_sql(500)} s").fetchone()[0]


def test_freshness_of_every_row(spark, sf_dir, tmp_path):
    first = dt.datetime(2024, 1, 1)
    commits = [(k * 7 % 50, first + dt.timedelta(minutes=41 * k)) for k in range(50)] + [(90, None), (60, first + dt.timedelta(minutes=82))]
    times = [first + dt.timedelta(minutes=13 * k - 30) for k in range(200)] * 2 + [c[1] for c in commits]
    spark.createDataFrame(commits, "event_id bigint, ts timestamp").write.parquet(str(tmp_path / "events.parquet"))
    spark.createDataFrame(list(enumerate(times)), "l_orderkey bigint, l_shipdate timestamp").write.parquet(str(tmp_path / "lineitem.parquet"))
    newest = lambda at: max((k for k, ts in commits if at and ts and ts <= at), default=None)
    got = [tuple(r) for r in QUERIES["o12_freshness"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(((at, newest(at)) for at in times), key=repr)
