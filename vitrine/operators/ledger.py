"""Processing only new or changed records: a work-item ledger.

An item is one version of one record of one task; it is *pending*, *leased* or *done*. The ledger is a log of
commits, each a batch of events of one kind:

- ``offer``: the version is there to be processed;
- ``lease``: a worker holds the item until ``lease_until`` under a fencing token; tokens only grow;
- ``done``: the worker that holds the item reports it.

A commit is worked out against the log as it stood at number n and becomes commit n + 1 by renaming its manifest
to a name that must not exist yet; whoever loses that race works his commit out again. So a lease never takes an
item that is done or held, and a report never counts under a token that isn't the newest one of its item: what
stands in the log is valid, done is final, and state is one aggregation in which neither order nor repetition
matter. Events are written before their manifest, to a path made of the operation and the commit number: a crash in
between leaves files that nobody reads and that the next try replaces. An operation that is in the log already is
not done again. ``compact`` writes the state as it stands, so that older commits needn't be read again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "task string, record_key string, version timestamp, kind string, fence bigint, worker string, lease_until timestamp"
_COLUMNS = [c.split()[0] for c in EVENT.split(", ")]


def _events(items: DataFrame, kind: str, task: Column | None = None, fence: Column | None = None, worker: Column | None = None, until: Column | None = None) -> DataFrame:
    """Events of one kind for (record_key, version) items."""
    none = F.lit(None)
    return items.select(
        (F.col("task") if task is None else task).alias("task"), F.col("record_key").cast("string").alias("record_key"), "version", F.lit(kind).alias("kind"),
        (none if fence is None else fence).cast("bigint").alias("fence"), (none if worker is None else worker).cast("string").alias("worker"), (none if until is None else until).cast("timestamp").alias("lease_until"),
    )


def record_versions(rows: DataFrame, task: str, key: Column, version: Column, loaded_at: Column) -> DataFrame:
    """Versions of a task's records; rows without key or version hold no version."""
    return rows.select(
        F.lit(task).alias("task"), key.cast("string").alias("record_key"), version.alias("version"), loaded_at.alias("loaded_at")
    ).filter("record_key IS NOT NULL AND version IS NOT NULL")


def run_events(versions: DataFrame, run_log: DataFrame, run_items: DataFrame) -> DataFrame:
    """The ledger events that a log of runs amounts to; the run number is the fencing token.

    Every version is offered. A succeeded run held and reported all that was loaded up to its ``read_until``, so the
    one that read furthest reports for all (one row a task: that is what is broadcast). Other runs held and reported
    what run_items lists of them, their leases ending with the run.
    """
    marks = run_log.filter("status = 'succeeded' AND read_until IS NOT NULL").groupBy("task").agg(F.max(F.struct("read_until", "run_no")).alias("m"))
    seen = versions.join(F.broadcast(marks), "task", "left").withColumn("read", F.coalesce(F.col("loaded_at") <= F.col("m.read_until"), F.lit(False)))
    done = _events(seen.filter("read"), "done", fence=F.col("m.run_no"))
    runs = run_log.filter("task IS NOT NULL").groupBy("run_no", "task").agg(F.max("finished_at").alias("until"))
    items = run_items.filter("record_key IS NOT NULL AND version_at IS NOT NULL").select("run_no", "record_key", F.col("version_at").alias("version")).join(runs, "run_no")
    held = _events(items, "lease", fence=F.col("run_no"), worker=F.concat(F.lit("run "), F.col("run_no").cast("string")), until=F.col("until"))
    return _events(versions, "offer").unionByName(done).unionByName(held).unionByName(_events(items, "done", fence=F.col("run_no")))


def item_state(events: DataFrame, now: Column) -> DataFrame:
    """Current state of each item: task, record_key, version, offered, state, fence, worker, lease_until.

    ``fence`` is the newest token issued for the item. A lease past its time counts as pending; done is final.
    Items without key or version are none. One pre-aggregated shuffle: a record that fills a third of the rows is
    reduced before it moves.
    """
    lease = F.max_by(F.struct("fence", "worker", "lease_until"), F.when(F.col("kind") == "lease", F.col("fence")))
    return (
        events.filter("record_key IS NOT NULL AND version IS NOT NULL")
        .groupBy("task", "record_key", "version")
        .agg(lease.alias("l"), F.bool_or(F.col("kind") == "done").alias("done"), F.bool_or(F.col("kind") == "offer").alias("offered"))
        .select(
            "task", "record_key", "version", "offered",
            F.when(F.col("done"), "done").when(F.col("l.lease_until") > now, "leased").otherwise("pending").alias("state"),
            F.col("l.fence").alias("fence"), F.col("l.worker").alias("worker"), F.col("l.lease_until").alias("lease_until"),
        )
    )


def to_process(state: DataFrame) -> DataFrame:
    """(task, record_key, version): each record's newest offered version, if it is pending and none as late is done.

    Older pending versions are overtaken by the newest. What is done without an offer offers nothing.
    """
    newest = F.max(F.when(F.col("offered"), F.struct("version", "state")))
    return (
        state.groupBy("task", "record_key")
        .agg(newest.alias("n"), F.max(F.when(F.col("state") == "done", F.col("version"))).alias("done"))
        .filter("n.state = 'pending' AND (done IS NULL OR n.version > done)")
        .select("task", "record_key", F.col("n.version").alias("version"))
    )


def _task_events(museums: DataFrame, site_scrapes: DataFrame, run_log: DataFrame, run_items: DataFrame) -> DataFrame:
    versions = record_versions(museums, "reindex", F.col("id"), F.col("updated_at"), F.col("loaded_at")).unionByName(
        record_versions(site_scrapes, "listing", F.col("site"), F.col("last_change_at"), F.col("loaded_at"))
    )
    return run_events(versions, run_log, run_items)


def p2_found(museums: DataFrame, site_scrapes: DataFrame, run_log: DataFrame, run_items: DataFrame) -> DataFrame:
    """The records of the next 'reindex' and 'listing' runs: task, record_key.

    They are the pending items of the ledger that the run log amounts to. Repeated and late rows change nothing; null
    keys and null versions are no versions; a task without a succeeded run has only its run_items done; an empty
    table gives no rows.
    """
    state = item_state(_task_events(museums, site_scrapes, run_log, run_items), F.current_timestamp())
    return to_process(state).select("task", "record_key")


def p2_states(museums: DataFrame, site_scrapes: DataFrame, run_log: DataFrame, run_items: DataFrame) -> DataFrame:
    """(task, state, items): how many items of each task are in each state."""
    state = item_state(_task_events(museums, site_scrapes, run_log, run_items), F.current_timestamp())
    return state.groupBy("task", "state").agg(F.count(F.lit(1)).alias("items"))


class Ledger:
    """A ledger kept under one folder that all executors and drivers share.

    The file system's rename must refuse a name that exists, at once for all (HDFS does).
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/log"))
        self._fs.mkdirs(self._path(f"{self.root}/tried"))

    def _read(self, path: str) -> dict:
        f = self._fs.open(self._path(path))
        try:
            return json.loads(bytes(f.readAllBytes()).decode())
        finally:
            f.close()

    def _log(self) -> list[dict]:
        """Manifests of all commits in their order."""
        names = sorted(int(s.getPath().getName()) for s in self._fs.listStatus(self._path(f"{self.root}/log")))
        return [self._read(f"{self.root}/log/{n}") for n in names]

    def _commit(self, n: int, entry: dict) -> bool:
        """Make ``entry`` commit n; False if another one is."""
        tried = self._path(f"{self.root}/tried/{uuid.uuid4().hex}")
        f = self._fs.create(tried)
        f.write(bytearray(json.dumps(entry | {"n": n}).encode()))
        f.close()
        none = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._files.rename(tried, self._path(f"{self.root}/log/{n}"), none)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            self._fs.delete(tried, False)
            return False

    def _events_of(self, log: list[dict]) -> DataFrame:
        start = max((i for i, e in enumerate(log) if e["kind"] == "compact"), default=0)
        paths = [f"{self.root}/{e['path']}" for e in log[start:]]
        return self.spark.read.schema(EVENT).parquet(*paths) if paths else self.spark.createDataFrame([], EVENT)

    def events(self) -> DataFrame:
        """The events since the last compaction, with what stood then."""
        return self._events_of(self._log())

    def _act(self, kind: str, op: str, work: Callable[[DataFrame, list[dict]], tuple[DataFrame, dict]]) -> dict:
        """Commit what ``work`` makes of the log as it stands, again and again until no other commit came between."""
        while True:
            log = self._log()
            for e in log:
                if e["op"] == op:
                    return e
            rows, more = work(self._events_of(log), log)
            n = log[-1]["n"] + 1 if log else 1
            path = f"events/{op}/{n}"
            rows.select(*_COLUMNS).write.mode("overwrite").parquet(f"{self.root}/{path}")
            if self._commit(n, entry := {"kind": kind, "op": op, "path": path} | more):
                return entry | {"n": n}

    def offer(self, batch: str, items: DataFrame, task: str) -> None:
        """Offer (record_key, version) items; ``batch`` names the offer, so a retry changes nothing."""
        self._act("offer", f"{task}/offer/{batch}", lambda events, log: (_events(items, "offer", task=F.lit(task)), {}))

    def lease(self, task: str, worker: str, now: datetime, ttl: timedelta = timedelta(minutes=30)) -> tuple[int, DataFrame]:
        """Take every pending item of a task: the token and the items held under it."""

        def work(events: DataFrame, log: list[dict]) -> tuple[DataFrame, dict]:
            token = 1 + max((e.get("fence", 0) for e in log), default=0)
            mine = item_state(events, F.lit(now)).filter((F.col("task") == task) & (F.col("state") == "pending") & F.col("offered"))
            return _events(mine, "lease", fence=F.lit(token), worker=F.lit(worker), until=F.lit(now + ttl)), {"fence": token}

        entry = self._act("lease", f"{task}/lease/{worker}-{uuid.uuid4().hex}", work)
        return entry["fence"], self.spark.read.schema(EVENT).parquet(f"{self.root}/{entry['path']}").select("record_key", "version")

    def complete(self, task: str, token: int, items: DataFrame, part: str = "all") -> None:
        """Report items done under a token; items of which it isn't the newest are left out. Retrying a part is harmless."""

        def work(events: DataFrame, log: list[dict]) -> tuple[DataFrame, dict]:
            held = item_state(events, F.lit(datetime.min.replace(year=1970))).filter((F.col("task") == task) & (F.col("state") != "done") & (F.col("fence") == token)).select("task", "record_key", "version")
            return _events(held.join(items.select("record_key", "version").distinct(), ["record_key", "version"], "left_semi"), "done", fence=F.lit(token)), {}

        self._act("done", f"{task}/done/{token}-{part}", work)

    def compact(self) -> None:
        """Write what stands in the log as events of one commit: at most an offer, a lease and a report for an item."""

        def work(events: DataFrame, log: list[dict]) -> tuple[DataFrame, dict]:
            state = item_state(events, F.lit(datetime.min.replace(year=1970)))
            kept = F.array_compact(F.array(F.when(F.col("offered"), "offer"), F.when(F.col("fence").isNotNull(), "lease"), F.when(F.col("state") == "done", "done")))
            return state.select("task", "record_key", "version", F.explode(kept).alias("kind"), "fence", "worker", "lease_until"), {}

        log = self._log()
        if log and log[-1]["kind"] != "compact":
            self._act("compact", f"compact/{log[-1]['n']}", work)

    def state(self, now: datetime) -> DataFrame:
        return item_state(self.events(), F.lit(now))
