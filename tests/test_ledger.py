from datetime import datetime, timedelta

from pyspark.sql import functions as F

from vitrine.operators.ledger import Ledger, p2_found, p2_states

T = lambda d, h=0: datetime(2026, 1, d, h)
MUSEUM = "id bigint, updated_at timestamp, loaded_at timestamp, task string"  # task: a column of a clashing name
SITE = "site string, last_change_at timestamp, loaded_at timestamp"
LOG = "run_no bigint, task string, status string, read_until timestamp, finished_at timestamp"
ITEM = "run_no bigint, record_key string, version_at timestamp"


def found(spark, museums, sites, log, items):
    df = p2_found(spark.createDataFrame(museums, MUSEUM), spark.createDataFrame(sites, SITE), spark.createDataFrame([(*x, x[3]) for x in log], LOG), spark.createDataFrame(items, ITEM))
    return {tuple(r) for r in df.collect()}


def test_new_changed_and_done(spark):
    museums = [(1, T(1), T(1), None), (2, T(1), T(9), None), (3, T(5), T(9), "x"), (None, T(1), T(9), None), (5, None, T(9), None)]
    sites = [("a", T(1), T(1)), ("a", T(3), T(9)), ("a", T(3), T(9)), ("b", None, T(9)), (None, T(2), T(9)), ("c", T(8), T(9))]
    log = [(1, "reindex", "succeeded", T(4)), (2, "reindex", "failed", T(20)), (3, "listing", "succeeded", T(2)), (4, "listing", "crashed", T(30)), (5, "listing", "succeeded", None)]
    items = [(2, "3", T(5)), (2, "3", T(5)), (4, "c", T(7)), (4, None, T(7)), (4, "ghost", T(7)), (99, "2", T(9))]
    assert found(spark, museums, sites, log, items) == {("reindex", "2"), ("listing", "a"), ("listing", "c")}


def test_without_runs_all_is_pending_and_empty_is_empty(spark):
    assert found(spark, [(1, T(1), T(1), None)], [], [], []) == {("reindex", "1")}
    assert found(spark, [], [], [], []) == set()


def test_leases_expire_and_fences_reject(spark, tmp_path):
    led = Ledger(spark, str(tmp_path / "ledger"))
    led.offer("b1", spark.createDataFrame([("x", T(1)), ("y", T(1))], "record_key string, version timestamp"), "t")
    led.offer("b1", spark.createDataFrame([("x", T(1)), ("y", T(1))], "record_key string, version timestamp"), "t")  # a retry
    one, held = led.lease("t", "w1", T(2), timedelta(hours=1))
    assert held.count() == 2
    state = {r.record_key: r.state for r in led.state(T(2)).collect()}
    assert state == {"x": "leased", "y": "leased"}
    led.complete("t", one, held.filter("record_key = 'x'"), "p0")
    assert {r.record_key: r.state for r in led.state(T(2, 2)).collect()} == {"x": "done", "y": "pending"}  # y's lease ran out
    two, again = led.lease("t", "w2", T(2, 2))
    assert two > one and [r.record_key for r in again.collect()] == ["y"]
    led.complete("t", one, held, "late")  # the first worker wakes up: its token is stale for y
    assert {r.record_key: r.state for r in led.state(T(2, 2)).collect()} == {"x": "done", "y": "leased"}
    led.complete("t", two, again)
    led.complete("t", two, again)
    assert led.state(T(3)).filter(F.col("state") != "done").count() == 0
    assert led.events().filter("kind = 'offer'").count() == 2


ITEMS = "record_key string, version timestamp"


def test_a_worker_that_read_before_a_report_takes_nothing(spark, tmp_path):
    led = Ledger(spark, str(tmp_path / "ledger"))
    led.offer("b", spark.createDataFrame([("x", T(1))], ITEMS), "t")
    one, held = led.lease("t", "w1", T(2), timedelta(hours=1))
    slow = Ledger(spark, led.root)
    stale = slow._log()
    seen = [stale]
    fresh = slow._log
    slow._log = lambda: seen.pop() if seen else fresh()  # its first look is from before the report
    led.complete("t", one, held)
    two, taken = slow.lease("t", "w2", T(3))
    assert taken.count() == 0 and two > one
    assert {r.state for r in led.state(T(4)).collect()} == {"done"}


def test_a_crash_before_the_manifest_leaves_no_trace(spark, tmp_path):
    led = Ledger(spark, str(tmp_path / "ledger"))
    rows = spark.createDataFrame([("x", T(1)), ("y", T(1)), ("y", T(1))], ITEMS)
    commit, led._commit = led._commit, lambda n, e: (_ for _ in ()).throw(RuntimeError("lost"))
    try:
        led.offer("b", rows, "t")
    except RuntimeError:
        pass
    assert led.events().count() == 0
    led._commit = commit
    led.offer("b", rows, "t")
    led.offer("b", rows, "t")
    assert {(r.record_key, r.state) for r in led.state(T(2)).collect()} == {("x", "pending"), ("y", "pending")}


def test_compaction_keeps_the_state(spark, tmp_path):
    led = Ledger(spark, str(tmp_path / "ledger"))
    led.compact()
    led.offer("b", spark.createDataFrame([(k, T(1)) for k in "abc"], ITEMS), "t")
    one, held = led.lease("t", "w1", T(2), timedelta(hours=1))
    led.complete("t", one, held.filter("record_key = 'a'"))
    before = {tuple(r) for r in led.state(T(2)).collect()}
    led.compact()
    led.compact()
    assert {tuple(r) for r in led.state(T(2)).collect()} == before and led.events().count() == 7
    two, again = led.lease("t", "w2", T(2, 2))
    assert two == one + 1 and {r.record_key for r in again.collect()} == {"b", "c"}
    led.complete("t", one, held)  # stale by now
    assert {r.record_key for r in led.state(T(2, 2)).filter("state = 'done'").collect()} == {"a"}


def test_states_count_items(spark):
    m = spark.createDataFrame([(1, T(1), T(1), None), (2, T(1), T(9), None)], MUSEUM)
    df = p2_states(m, spark.createDataFrame([], SITE), spark.createDataFrame([(1, "reindex", "succeeded", T(4), T(5))], LOG), spark.createDataFrame([], ITEM))
    assert {tuple(r) for r in df.collect()} == {("reindex", "done", 1), ("reindex", "pending", 1)}
