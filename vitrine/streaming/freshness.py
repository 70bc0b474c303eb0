"""Streams: the adaptive schedule as keyed state, and enrichment of notified objects."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vitrine.operators import schedule as S
from vitrine.sources.readers import notified_keys

STATE = "iv double, reads int, failures int"
OUTPUT = "site string, interval_hours double, failures bigint, parked boolean"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ScheduleProcessor(StatefulProcessor):
    """State of one site: interval, good reads, failures in a row. Attempts of a batch are applied in time order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("schedule", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        iv, reads, failures = tuple(self.state.get()) if self.state.exists() else (S.START, 0, 0)
        batch = pd.concat(list(rows)).drop_duplicates(["ts"]).sort_values("ts")
        for outcome in batch["outcome"]:
            if outcome == "failed":
                failures += 1
                continue
            if reads:
                iv = min(S.MOST, max(S.LEAST, iv * (S.FASTER if outcome == "changed" else S.SLOWER)))
            reads, failures = reads + 1, 0
        self.state.update((iv, reads, failures))
        yield pd.DataFrame({"site": [key[0]], "interval_hours": [iv], "failures": [failures], "parked": [failures >= S.PARK_AT]})

    def close(self) -> None:
        pass


def schedule_stream(attempts: DataFrame) -> DataFrame:
    """Stream of (site, ts, outcome) to the site's schedule after each batch. Needs the RocksDB state store."""
    return attempts.groupBy("site").transformWithStateInPandas(statefulProcessor=ScheduleProcessor(), outputStructType=OUTPUT, outputMode="Update", timeMode="None")


def notifications(spark: SparkSession, folder: str, topic: str = "", servers: str = "") -> DataFrame:
    """Notification messages: a Kafka topic where one is named and the source is installed, else a folder of text files."""
    if topic:
        return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load().select(F.col("value").cast("string").alias("value"))
    return spark.readStream.schema("value string").format("text").load(folder)


def enrich_stream(messages: DataFrame, objects: DataFrame, details: DataFrame, sink: str, checkpoint: str):
    """Notified keys joined to the stored objects and their details, written once a batch.

    A batch writes to a path named after its number, so a batch run again replaces itself; an object without details
    is written with what it has, its missing step named in ``errors``.
    """
    keys = notified_keys(messages).filter("key IS NOT NULL")
    full = keys.join(objects, "key").join(details, "key", "left").withColumn("errors", F.when(F.col("detail").isNull(), F.array(F.lit("details"))).otherwise(F.array().cast("array<string>")))

    def store(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(["key"]).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return full.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def checkpointed_store(rows: DataFrame, key: str, sink: str, checkpoint: str, every: str | None = None):
    """Rows of a stream stored as they come: a batch at each trigger (at once to the end if ``every`` is None), each key once
    a batch, under a path named after the batch, so that a batch run again replaces itself."""

    def store(batch: DataFrame, number: int) -> None:
        batch.filter(F.col(key).isNotNull()).dropDuplicates([key]).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    out = rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def site_reads(reads: DataFrame, listings: DataFrame, states: DataFrame, closes: DataFrame, now) -> dict[str, DataFrame]:
    """What a batch of site reads leaves: ``outcomes``, ``plan`` (the next reads), ``touched`` sites and ``retired`` listings.

    ``reads``: site, reached, not_modified, found, fingerprint, began; ``listings``: exhibition_id, site, source, last_seen_at,
    retired_at. A site that says nothing has changed is touched; only a read that found something retires what it didn't see.
    """
    outcomes = S.read_outcomes(reads, states)
    saved = states.select("site", "interval_hours", F.col("consecutive_failures").alias("failures"))
    good = reads.join(outcomes.filter("outcome <> 'failed'").select("site"), "site", "left_semi")
    return {
        "outcomes": outcomes, "plan": S.next_reads(saved, outcomes.select("site", "outcome"), closes, now), "touched": reads.filter("reached AND not_modified").select("site").distinct(),
        "retired": S.retire_unseen(listings, good.filter("NOT coalesce(not_modified, false)").select("site", "began", "found")),
    }
