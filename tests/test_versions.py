import random

import pytest

from tidemark.lsn import HEAD, format_lsn, parse_lsn
from tidemark.operators import changes as C
from tidemark.operators import versions as V

COLUMNS = ["id", "name"]
DDL = "lsn bigint, ord int, op string, id bigint, name string, old_id bigint, unchanged array<string>"


def log(spark, *rows):
    return spark.createDataFrame([(*r, *([None] * (7 - len(r)))) for r in rows], DDL)


def state(spark, rows, lsn):
    got = V.state_at(C.versions_of(log(spark, *rows), ["id"], COLUMNS), lsn).select(*COLUMNS).collect()
    return sorted((r["id"], r["name"]) for r in got)


GOLDEN = [(100, 1, "I", 1, "one"), (100, 2, "I", 2, "two"), (100, 3, "I", 3, "three"), (200, 1, "U", 2, "TWO"), (300, 1, "D", 3, None)]


def test_time_travel(spark):
    assert state(spark, GOLDEN, 99) == []
    assert state(spark, GOLDEN, 100) == [(1, "one"), (2, "two"), (3, "three")]
    assert state(spark, GOLDEN, 250) == [(1, "one"), (2, "TWO"), (3, "three")]
    assert state(spark, GOLDEN, 300) == [(1, "one"), (2, "TWO")]


@pytest.mark.parametrize(
    "row,problem",
    [((400, 1, "U", 99, "x"), "unknown key"), ((400, 1, "D", 99, None), "unknown key"), ((400, 1, "I", 1, "again"), "is open"), ((400, 1, "U", 3, "gone"), "unknown key")],
)
def test_loud_errors(spark, row, problem):
    with pytest.raises(C.ChangeError, match=problem):
        state(spark, [*GOLDEN, row], 500)


def test_same_transaction_insert_and_delete_is_never_seen(spark):
    rows = [(100, 1, "I", 1, "a"), (100, 2, "D", 1, None), (200, 1, "I", 1, "b")]
    assert state(spark, rows, 100) == [] and state(spark, rows, 200) == [(1, "b")]


def test_changed_key_leaves_no_ghost(spark):
    rows = [(100, 1, "I", 1, "a"), (200, 1, "U", 2, "a", 1)]
    assert state(spark, rows, 200) == [(2, "a")]
    latest = V.latest_at(C.version_rows(log(spark, *rows), ["id"], COLUMNS), ["id"], 200)
    assert [r["id"] for r in latest.collect()] == [2]


def test_unchanged_columns_take_the_value_before_and_nulls_stay(spark):
    rows = [(100, 1, "I", 1, "a"), (200, 1, "U", 1, None, None, ["name"]), (300, 1, "U", 1, None), (400, 1, "U", 5, None, 1, ["name"])]
    assert state(spark, rows, 200) == [(1, "a")] and state(spark, rows, 300) == [(1, None)] and state(spark, rows, 400) == [(5, None)]
    assert state(spark, [rows[0], (150, 1, "U", 7, None, 1, ["name"])], 150) == [(7, "a")]
    with pytest.raises(C.ChangeError, match="without a value"):
        state(spark, [(100, 1, "I", 1, None, None, ["name"])], 100)


def test_unchanged_columns_follow_a_row_through_every_key(spark):
    rows = [(100, 1, "I", 1, "a"), (200, 1, "U", 2, None, 1, ["name"]), (300, 1, "U", 2, None, None, ["name"])]
    assert state(spark, rows, 200) == [(2, "a")] and state(spark, rows, 300) == [(2, "a")]
    rows += [(400, 1, "U", 3, None, 2, ["name"]), (400, 2, "U", 4, None, 3, ["name"]), (500, 1, "I", 1, "other"), (600, 1, "U", 4, "b"), (700, 1, "U", 9, None, 4, ["name"])]
    assert state(spark, rows, 400) == [(4, "a")] and state(spark, rows, 599) == [(1, "other"), (4, "a")] and state(spark, rows, 700) == [(1, "other"), (9, "b")]


def test_a_move_onto_an_open_key_is_an_error(spark):
    with pytest.raises(C.ChangeError, match="onto a key that is open"):
        state(spark, [(100, 1, "I", 1, "a"), (100, 2, "I", 2, "b"), (200, 1, "U", 2, "a", 1)], 200)


def replay(rows, lsn):
    held = {}
    for at, _, op, k, name, old, unchanged in rows:
        if at > lsn:
            break
        if op == "T":
            held = {}
        elif op == "D":
            del held[k]
        else:
            before = held.pop(old) if old is not None and old != k else held.get(k)
            held[k] = before if unchanged else name
    return held


def test_random_histories_with_moves_unchanged_columns_and_truncates(spark):
    rng, rows, held = random.Random(11), [], {}
    for lsn in range(1, 200):
        for ord_ in range(1, rng.randint(1, 3) + 1):
            live, free = sorted(held), [k for k in range(12) if k not in held]
            kind = rng.choices("IUMDT", (5, 5, 4, 2, 0.3))[0]
            if kind == "T":
                row = (lsn, ord_, "T", None, None, None, None)
            elif kind == "I" or not live:
                if not free:
                    continue
                row = (lsn, ord_, "I", rng.choice(free), rng.choice([None, f"v{lsn}.{ord_}"]), None, None)
            elif kind == "D":
                row = (lsn, ord_, "D", rng.choice(live), None, None, None)
            else:
                old = rng.choice(live)
                same = rng.random() < 0.6
                key = rng.choice(free) if kind == "M" and free else old
                row = (lsn, ord_, "U", key, None if same else f"v{lsn}.{ord_}", old if key != old else None, ["name"] if same else None)
            rows.append(row)
            held = replay(rows, lsn)
    changes = spark.createDataFrame(rows, DDL).cache()
    assert C.violations(changes, ["id"], COLUMNS).isEmpty()
    versions, raw = C.versions_of(changes, ["id"], COLUMNS).cache(), C.version_rows(changes, ["id"], COLUMNS).cache()
    spans = V.intervals(raw, ["id"]).cache()
    for lsn in (0, 1, 20, 55, 100, 150, 199):
        want = replay(rows, lsn)
        assert {r["id"]: r["name"] for r in V.state_at(versions, lsn).collect()} == want
        assert {r["id"]: r["name"] for r in V.latest_at(raw, ["id"], lsn).collect()} == want
        assert {r["id"]: r["name"] for r in V.state_at(spans, lsn).collect()} == want


def test_truncate_with_and_without_key(spark):
    rows = [(100, 1, "I", 1, "a"), (200, 1, "T", None, None), (300, 1, "I", 1, "b")]
    assert state(spark, rows, 250) == [] and state(spark, rows, 300) == [(1, "b")]
    keyless = C.versions_of(log(spark, *rows), [], COLUMNS)
    assert V.state_at(keyless, 199).count() == 1 and V.state_at(keyless, 250).count() == 0 and V.state_at(keyless, 300).count() == 1
    with pytest.raises(C.ChangeError):
        C.versions_of(log(spark, (100, 1, "D", 1, None)), [], COLUMNS)


def test_intervals_equal_newest_versions_on_random_histories(spark):
    rng, rows, live = random.Random(7), [], {}
    for lsn in range(1, 120):
        for ord_ in range(1, rng.randint(1, 3) + 1):
            k = rng.randint(1, 12)
            op = rng.choice("UD") if k in live else "I"
            live.pop(k) if op == "D" else live.__setitem__(k, f"v{lsn}.{ord_}")
            rows.append((lsn, ord_, op, k, live.get(k)))
    changes = log(spark, *rows).cache()
    versions, raw = C.versions_of(changes, ["id"], COLUMNS).cache(), C.version_rows(changes, ["id"], COLUMNS).cache()
    for lsn in (0, 1, 30, 77, 119):
        expected = {}
        for at, _, op, k, name in rows:
            if at <= lsn:
                expected.pop(k, None) if op == "D" else expected.__setitem__(k, name)
        by_interval = {r["id"]: r["name"] for r in V.state_at(versions, lsn).collect()}
        assert by_interval == expected == {r["id"]: r["name"] for r in V.latest_at(raw, ["id"], lsn).collect()}
    assert V.multiset_equal(V.state_at(versions, keep_lsn=False), V.state_at(V.intervals(raw, ["id"]), keep_lsn=False))


def test_mutated_states_are_caught(spark):
    good = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id bigint, name string")
    for bad in ([(1, "a"), (2, "b")], [(1, "a"), (2, "b"), (2, "b"), (2, "b")], [(1, "old"), (2, "b"), (2, "b")], []):
        other = spark.createDataFrame(bad, "id bigint, name string")
        assert not V.multiset_equal(good, other)
        assert V.multiset_digest(good).first() != V.multiset_digest(other).first()
    assert V.multiset_equal(good, good)


def test_positions():
    assert parse_lsn("1/2A05F200") == 5_000_000_000 and format_lsn(5_000_000_000) == "1/2A05F200"
    assert format_lsn(0) == "0/0" and parse_lsn(format_lsn(HEAD)) == HEAD
    for bad in ("", "1", "1/", "/2", "x/y", "FFFFFFFF/0"):
        with pytest.raises(ValueError):
            parse_lsn(bad)


def test_filters_reach_the_scan(spark, tmp_path):
    C.versions_of(log(spark, *GOLDEN), ["id"], COLUMNS).write.parquet(str(tmp_path / "v"))
    plan = V.state_at(spark.read.parquet(str(tmp_path / "v")), 250)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(__lsn,250)" in plan and "GreaterThan(__lsn_to,250)" in plan
