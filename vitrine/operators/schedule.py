"""Freshness: the adaptive schedule, due sites, retirement, fingerprints, status."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values, in hours: first interval, bounds, factors, back-off, failures that park a site, wait of a parked one.
START, LEAST, MOST, SLOWER, FASTER, BACKOFF, PARK_AT, PARKED = 168.0, 48.0, 1440.0, 1.5, 0.5, 12.0, 6, 1440.0


def attempts(site_scrapes: DataFrame) -> DataFrame:
    """(site, ts, outcome) of each attempt, once: failed, changed or unchanged."""
    outcome = F.when(F.col("consecutive_failures") > 0, "failed").when(F.col("last_change_at") == F.col("last_attempt_at"), "changed").otherwise("unchanged")
    return site_scrapes.filter("site IS NOT NULL AND last_attempt_at IS NOT NULL").groupBy("site", F.col("last_attempt_at").alias("ts")).agg(F.min(outcome).alias("outcome"))


def next_interval(hours: Column, outcome: Column) -> Column:
    """Interval after a read that isn't the first: longer if nothing changed, shorter if something did."""
    return F.greatest(F.lit(LEAST), F.least(F.lit(MOST), hours * F.when(outcome == "changed", FASTER).otherwise(SLOWER)))


def wait_hours(interval: Column, failures: Column) -> Column:
    """Hours to the next read: the interval, or a doubling back-off after failures, or long for a parked site."""
    doubled = F.lit(BACKOFF) * F.pow(F.lit(2.0), F.least(failures - 1, F.lit(5)))
    return F.when(failures >= PARK_AT, PARKED).when(failures > 0, doubled).otherwise(interval)


def schedule(events: DataFrame) -> DataFrame:
    """State of each site after all its attempts: interval_hours, failures, parked, wait_hours.

    A fold over the site's attempts in time order; the first good read learns nothing. A site's attempts are a short
    history; it is the only list gathered.
    """
    # the sort key goes first: structs sort by their fields
    seq = F.array_sort(F.collect_list(F.struct("ts", "outcome")))
    grouped = events.groupBy("site").agg(seq.alias("seq"))
    start = F.struct(F.lit(START).alias("iv"), F.lit(0).alias("reads"), F.lit(0).alias("failures"))
    step = lambda a, x: F.struct(
        F.when((x.outcome == "failed") | (a.reads == 0), a.iv).otherwise(next_interval(a.iv, x.outcome)).alias("iv"),
        F.when(x.outcome == "failed", a.reads).otherwise(a.reads + 1).alias("reads"),
        F.when(x.outcome == "failed", a.failures + 1).otherwise(F.lit(0)).alias("failures"),
    )
    s = grouped.select("site", F.aggregate("seq", start, step).alias("s"))
    return s.select("site", F.col("s.iv").alias("interval_hours"), F.col("s.failures").cast("bigint").alias("failures"), (F.col("s.failures") >= PARK_AT).alias("parked"), wait_hours(F.col("s.iv"), F.col("s.failures")).alias("wait_hours"))


def latest(site_scrapes: DataFrame) -> DataFrame:
    """The newest saved state of each site: by attempt, then load."""
    state = F.struct("last_attempt_at", "last_success_at", "last_change_at", "next_due_at", "parked_reason", "found_count", "consecutive_failures", "interval_hours", "fingerprint")
    order = F.struct(F.coalesce(F.unix_micros("last_attempt_at"), F.lit(-1)).alias("a"), F.unix_micros("loaded_at").alias("b"))
    return site_scrapes.filter("site IS NOT NULL").groupBy("site").agg(F.max_by(state, order).alias("s")).select("site", "s.*")


def due_by_prominence(states: DataFrame, targets: DataFrame, now: datetime) -> DataFrame:
    """``due`` with the site's most prominent museum: never read ones first, then the longest due, then the best known."""
    d = due(states, now).join(targets.groupBy("site").agg(F.max("sitelinks").alias("sitelinks")), "site", "left")
    return d.orderBy(F.desc("never"), "due_us", F.desc_nulls_last("sitelinks"), "site")


def due(states: DataFrame, now: datetime) -> DataFrame:
    """Sites to read: not parked and due; never read ones first, then the longest due."""
    hit = states.filter("parked_reason IS NULL").filter(F.coalesce(F.col("next_due_at") <= F.lit(now), F.lit(True)))
    return hit.select("site", F.col("last_attempt_at").isNull().alias("never"), F.unix_micros("next_due_at").alias("due_us")).orderBy(F.desc("never"), "due_us", "site")


def share(states: DataFrame, workers: int, worker: int) -> DataFrame:
    """A worker's part of the sites: no two workers read the same one."""
    return states.filter(F.pmod(F.xxhash64("site"), F.lit(workers)) == worker)


def status(states: DataFrame, now: datetime) -> DataFrame:
    return states.agg(
        F.count(F.lit(1)).alias("sites"), F.count_if(F.col("last_attempt_at").isNull()).alias("never_read"), F.count_if(F.col("parked_reason").isNotNull()).alias("parked"),
        F.count_if(F.col("parked_reason").isNull() & (F.col("next_due_at") <= F.lit(now))).alias("due"), F.count_if(F.col("consecutive_failures") > 0).alias("failing"),
        F.round(F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY interval_hours) FILTER (WHERE parked_reason IS NULL)"), 4).alias("median_hours"),
    )


def retire_unseen(exhibitions: DataFrame, reads: DataFrame) -> DataFrame:
    """(exhibition_id): live scraped listings of a read site not seen since that read began.

    ``reads``: site, began, found. A read that found nothing retires nothing; submissions are never retired.
    """
    r = reads.filter("found > 0").select("site", "began")
    hit = exhibitions.filter("retired_at IS NULL AND source = 'scraped'").join(r, "site").filter(F.col("last_seen_at") < F.col("began"))
    return hit.select("exhibition_id").distinct()


def fingerprints(exhibitions: DataFrame) -> DataFrame:
    """(site, digest): an order-independent digest of each site's listings.

    Each listing is hashed first and the hashes are added up in two wide sums, so a site with a tenth of all rows is
    summed in parts and never gathered.
    """
    line = F.concat_ws("\0", "url", F.coalesce("title", F.lit("")), F.coalesce(F.col("starts_on").cast("string"), F.lit("")), F.coalesce(F.col("ends_on").cast("string"), F.lit("")))
    h = exhibitions.filter("site IS NOT NULL").select("site", F.sha2(line, 256).alias("h")).distinct()
    part = lambda i: F.sum(F.conv(F.substring("h", 12 * i + 1, 12), 16, 10).cast("decimal(20,0)"))
    return h.groupBy("site").agg(F.count(F.lit(1)).alias("listings"), part(0).cast("string").alias("low"), part(1).cast("string").alias("high"))


def discover(museums_sites: DataFrame, states: DataFrame) -> DataFrame:
    """Sites not scheduled yet."""
    return museums_sites.select("site").filter("site IS NOT NULL").distinct().join(states.select("site"), "site", "left_anti")


def token_bucket(requests: DataFrame, rate: float = 10.0, burst: float = 30.0) -> DataFrame:
    """(client, allowed, refused) of requests (client, at seconds): a fold over each client's ordered requests."""
    seq = requests.groupBy("client").agg(F.array_sort(F.collect_list(F.col("at").cast("double"))).alias("ts"))
    start = F.struct(F.lit(burst).alias("tokens"), F.lit(-1.0).alias("last"), F.lit(0).cast("bigint").alias("ok"), F.lit(0).cast("bigint").alias("no"))

    def step(a: Column, t: Column) -> Column:
        have = F.least(F.lit(burst), a.tokens + F.when(a.last < 0, 0.0).otherwise((t - a.last) * rate))
        pay = have >= 1.0
        return F.struct(F.when(pay, have - 1.0).otherwise(have).alias("tokens"), t.alias("last"), F.when(pay, a.ok + 1).otherwise(a.ok).alias("ok"), F.when(pay, a.no).otherwise(a.no + 1).alias("no"))

    return seq.select("client", F.aggregate("ts", start, step).alias("s")).select("client", F.col("s.ok").alias("allowed"), F.col("s.no").alias("refused"))


def read_outcomes(reads: DataFrame, states: DataFrame) -> DataFrame:
    """(site, outcome, found) of reads (site, reached, not_modified, found, fingerprint) against the saved fingerprints.

    A site of which no page answered has failed; one that says so itself, or whose listings have the saved fingerprint,
    is unchanged.
    """
    r = reads.join(states.select("site", F.col("fingerprint").alias("saved")), "site", "left")
    same = F.coalesce("not_modified", F.lit(False)) | F.coalesce(F.col("fingerprint") == F.col("saved"), F.lit(False))
    return r.select("site", F.when(~F.coalesce("reached", F.lit(False)), "failed").when(same, "unchanged").otherwise("changed").alias("outcome"), F.coalesce("found", F.lit(0)).alias("found"))


def next_reads(states: DataFrame, outcomes: DataFrame, closes: DataFrame, now: datetime) -> DataFrame:
    """(site, interval_hours, failures, parked, due_at, reason) after a read at ``now``.

    ``states``: site, interval_hours (null or 0 before the first good read), failures; ``outcomes``: site, outcome;
    ``closes``: site, closes (the earliest end of its shows, a date). A closing date pulls the next read in to the day after
    it, if that is still to come and earlier; failures and parking go before it.
    """
    j = outcomes.join(states.select("site", "interval_hours", "failures"), "site", "left").join(closes.groupBy("site").agg(F.min("closes").alias("closes")), "site", "left")
    first = F.coalesce("interval_hours", F.lit(0.0)) <= 0
    held = F.when(first, START).otherwise(F.col("interval_hours"))
    failed = F.col("outcome") == "failed"
    failures = F.when(failed, F.coalesce("failures", F.lit(0)) + 1).otherwise(F.lit(0))
    j = j.select("site", "outcome", first.alias("first"), F.when(failed | first, held).otherwise(next_interval(held, F.col("outcome"))).alias("interval_hours"), failures.alias("failures"), F.col("closes").cast("timestamp").alias("closes"))
    after = lambda h: F.lit(now) + F.make_dt_interval(hours=F.floor(h).cast("int"), mins=F.floor((h - F.floor(h)) * 60).cast("int"))
    usual = after(wait_hours(F.col("interval_hours"), F.col("failures")))
    recheck = F.col("closes") + F.make_dt_interval(days=F.lit(1))
    pulled = F.coalesce((F.col("failures") == 0) & (recheck > F.lit(now)) & (recheck < usual), F.lit(False))
    reason = F.when(F.col("failures") >= PARK_AT, F.concat(F.lit("parked after "), F.col("failures").cast("string"), F.lit(" failures"))).when(F.col("failures") > 0, F.concat(F.lit("failure "), F.col("failures").cast("string")))
    reason = reason.when(pulled, F.concat(F.lit("a show closes "), F.date_format("closes", "yyyy-MM-dd"))).when(F.col("first"), "first read").when(F.col("outcome") == "changed", "changed").otherwise("unchanged")
    return j.select("site", "interval_hours", F.col("failures").cast("bigint").alias("failures"), (F.col("failures") >= PARK_AT).alias("parked"), F.when(pulled, recheck).otherwise(usual).alias("due_at"), reason.alias("reason"))


def sweep_totals(outcomes: DataFrame) -> DataFrame:
    """(outcome, sites, found) of a sweep."""
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("sites"), F.sum("found").alias("found"))


def sweep_plan(states: DataFrame, now: datetime, workers: int, worker: int, per_minute: int, minutes: int = 1) -> DataFrame:
    """What a worker would read in the next minutes and why, nothing read: its due sites in order, as many as the pace allows."""
    mine = share(states.join(due(states, now).select("site", "never"), "site"), workers, worker)
    why = F.when(F.col("never"), "never read").otherwise("due")
    return mine.orderBy(F.desc("never"), "next_due_at", "site").limit(per_minute * minutes).select("site", why.alias("reason"))
