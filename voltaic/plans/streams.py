"""Queries that run streams over the events table, and tables kept by appends, changes and deletions, to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltaic.operators import sourcing, steps
from voltaic.plans.registry import query
from voltaic.sources import registry as sources
from voltaic.streaming import jobs, patterns

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark, sf_dir) -> DataFrame:
    """The events table as a stream. Its file or folder is found by a pattern, as streams read folders."""
    return jobs.stream(spark, f"{sf_dir}/events.parqu*t", EVENTS, "ts")


def fresh(spark, name: str) -> str:
    return f"{steps.folder(spark)}/{name}-{uuid.uuid4().hex}"


def plain(c: str):
    return F.col(c).cast("timestamp_ntz").alias(c)


@query("stream_tumbling", "SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n, round(sum(value), 6) AS total, min(value) AS low, max(value) AS high FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    w = jobs.windowed(events(spark, sf_dir), "ts", ["user_id"], "value", "1 day", late="60 days")
    out = jobs.settle(w, ["user_id", "start"], "n", fresh(spark, "tumbling"))
    return out.select("user_id", plain("start"), "n", F.round("total", 6).alias("total"), "low", "high")


@query("stream_sliding", """
SELECT event_type, start, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS start FROM events) GROUP BY 1, 2""")
def stream_sliding(spark, sf_dir):
    w = jobs.windowed(events(spark, sf_dir), "ts", ["event_type"], "value", "12 hours", "6 hours", late="60 days")
    return jobs.settle(w, ["event_type", "start"], "n", fresh(spark, "sliding")).select("event_type", plain("start"), "n")


@query("stream_sessions", """
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, sf_dir):
    s = jobs.sessions(events(spark, sf_dir), "ts", ["user_id"], "2 hours", late="60 days")
    return jobs.settle(s, ["user_id", "start"], "n", fresh(spark, "sessions"), mode="complete").select("user_id", plain("start"), "n")


@query("stream_interval_join", """
SELECT a.event_id, b.event_id AS other FROM events a JOIN events b ON a.user_id = b.user_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 3600000000 WHERE a.event_type = 'purchase' AND b.event_type = 'click'""")
def stream_interval_join(spark, sf_dir):
    a = events(spark, sf_dir).filter("event_type = 'purchase'").select("user_id", "event_id", "ts")
    b = events(spark, sf_dir).filter("event_type = 'click'").select(F.col("user_id").alias("other_user"), F.col("event_id").alias("other"), F.col("ts").alias("other_ts"))
    pairs = jobs.interval_join(a, b, "user_id", "other_user", "ts", "other_ts", 3600, late="60 days")
    return jobs.drain(pairs.select("event_id", "other"), fresh(spark, "pairs"))


@query("stream_rules", """
SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n, count(*) FILTER (event_type = 'error') >= 2 AS many_errors, max(value) > 450 AND bool_or(event_type = 'purchase') AS dear FROM events GROUP BY 1, 2""")
def stream_rules(spark, sf_dir):
    rules = {"many_errors": F.count_if(F.col("event_type") == "error") >= 2, "dear": (F.max("value") > 450) & F.bool_or(F.col("event_type") == "purchase")}
    s = jobs.scored_patterns(events(spark, sf_dir), "ts", ["user_id"], "event_type", "1 day", rules, late="60 days")
    return jobs.settle(s, ["user_id", "start"], "n", fresh(spark, "rules")).select("user_id", plain("start"), "n", "many_errors", "dear")


@query("stream_latest", "SELECT user_id, max(ts) AS ts, arg_max(event_id, ts) AS event_id, arg_max(value, ts) AS value FROM events GROUP BY 1")
def stream_latest(spark, sf_dir):
    """The read model: each user's last event, kept by upserts."""
    s = events(spark, sf_dir).select("user_id", "ts", "event_id", "value")
    return jobs.settle(s, ["user_id"], "ts", fresh(spark, "latest"), mode="append").select("user_id", plain("ts"), "event_id", "value")


def in_slices(spark, sf_dir, run, slices: int = 3) -> DataFrame:
    """Events arrive in slices of time; after each, run(stream) goes on from its checkpoint. What it gives in the end."""
    folder = fresh(spark, "arriving")
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    low, high = e.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).agg(F.min("t"), F.max("t")).first()
    share = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(low)) * F.lit(slices) / F.lit(max(1, (high or 0) - (low or 0) + 1)))
    for k in range(slices):
        e.filter(share == k).write.mode("append").parquet(folder)
        out = run(jobs.stream(spark, folder, EVENTS, "ts"))
    return out


#: Milliseconds that the watermark has reached in the end: ten minutes before the last event.
_PASSED = "(SELECT max(epoch_ms(ts)) - 600000 FROM events)"


@query("stream_sequence", """
WITH s AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
a AS (SELECT user_id, min(n) AS n1 FROM s WHERE event_type = 'signup' GROUP BY 1),
b AS (SELECT a.user_id, min(n) AS n2 FROM a JOIN s ON s.user_id = a.user_id AND n > n1 AND event_type = 'click' GROUP BY 1),
c AS (SELECT b.user_id, min(n) AS n3 FROM b JOIN s ON s.user_id = b.user_id AND n > n2 AND event_type = 'purchase' GROUP BY 1)
SELECT user_id, CAST((n1 IS NOT NULL)::INT + (n2 IS NOT NULL)::INT + (n3 IS NOT NULL)::INT AS INTEGER) AS matched FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN a USING (user_id) LEFT JOIN b USING (user_id) LEFT JOIN c USING (user_id)""")  # fmt: skip
def stream_sequence(spark, sf_dir):
    """What cep_sequence finds in the table, kept up to date while the events arrive."""
    path = fresh(spark, "sequence")

    def run(arriving):
        out = patterns.progress(arriving, ["user_id"], "ts", "event_id", "event_type", ["signup", "click", "purchase"], late="10 minutes")
        with patterns.state_store(spark):
            return jobs.settle(out.select("user_id", "matched"), ["user_id"], "matched", path)

    return in_slices(spark, sf_dir, run)


@query("stream_patterns", f"""
WITH e AS (SELECT user_id, ts, event_id, event_type, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE epoch_ms(ts) <= {_PASSED}),
a AS (SELECT user_id, ts AS started, t, event_id, n FROM e WHERE event_type = 'view'),
b AS (SELECT a.user_id, a.event_id, min(e.n) AS n2 FROM a JOIN e ON e.user_id = a.user_id AND e.n > a.n AND e.event_type = 'click' GROUP BY 1, 2),
b2 AS (SELECT b.*, e.t AS t2 FROM b JOIN e ON e.user_id = b.user_id AND e.n = b.n2),
c AS (SELECT b.user_id, b.event_id, min(e.n) AS n3 FROM b JOIN e ON e.user_id = b.user_id AND e.n > b.n2 AND e.event_type = 'purchase' GROUP BY 1, 2),
c2 AS (SELECT c.*, e.t AS t3, e.ts AS ts3 FROM c JOIN e ON e.user_id = c.user_id AND e.n = c.n3),
r AS (SELECT a.user_id, started, a.event_id, t3 - a.t <= 172800000000 AS complete, ts3, CASE WHEN t3 - a.t <= 172800000000 THEN 3 WHEN t2 - a.t <= 172800000000 THEN 2 ELSE 1 END AS matched, a.t
  FROM a LEFT JOIN b2 USING (user_id, event_id) LEFT JOIN c2 USING (user_id, event_id))
SELECT user_id, started, event_id, CASE WHEN complete THEN ts3 END AS ended, CAST(matched AS INTEGER) AS matched, coalesce(complete, false) AS complete FROM r
WHERE complete OR t + 172800000000 < {_PASSED} * 1000""")  # fmt: skip
def stream_patterns(spark, sf_dir):
    """Every view that a click and then a purchase follow within two days, and how far the others came."""
    path = fresh(spark, "patterns")

    def run(arriving):
        out = patterns.patterns(arriving, ["user_id"], "ts", "event_id", "event_type", ["view", "click", "purchase"], 172_800, late="10 minutes")
        with patterns.state_store(spark):
            return jobs.drain(out, path)

    return in_slices(spark, sf_dir, run).select("user_id", plain("started"), F.col("tie").alias("event_id"), plain("ended"), "matched", "complete")


@query("stream_buffer", f"""
WITH n AS (SELECT *, max(epoch_us(ts)) OVER (PARTITION BY event_type) AS newest, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events),
h AS (SELECT *, k <= 50 AND epoch_us(ts) > newest - 86400000000 AND newest + 86400000000 >= {_PASSED} * 1000 AS held FROM n)
SELECT event_type, count(*) FILTER (held) AS n, round(sum(value) FILTER (held), 6) AS total, min(value) FILTER (held) AS low, max(value) FILTER (held) AS high, min(ts) FILTER (held) AS oldest FROM h GROUP BY 1""")  # fmt: skip
def stream_buffer(spark, sf_dir):
    """Of each type the newest events, 50 at most and none a day older than the newest; one of the two is always at play."""
    path = fresh(spark, "buffer")

    def run(arriving):
        out = patterns.buffered(arriving, ["event_type"], "ts", "event_id", "value", 50, 86_400, late="10 minutes")
        with patterns.state_store(spark):
            return jobs.settle(out, ["event_type"], "revision", path)

    return in_slices(spark, sf_dir, run).select("event_type", "n", F.round("total", 6).alias("total"), "low", "high", plain("oldest"))


@query("source_round_trips", "SELECT kind, event_id, user_id, value FROM events, (SELECT unnest(['csv', 'json', 'orc', 'parquet']) AS kind)")
def source_round_trips(spark, sf_dir):
    """Events written to and read from each kind of file."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "value")
    parts = []
    for kind in ("csv", "json", "orc", "parquet"):
        path = fresh(spark, kind)
        sources.write(e, path, kind, **({"header": True} if kind == "csv" else {}))
        parts.append(sources.read(spark, kind, path=path, schema="event_id long, user_id long, value double").select(F.lit(kind).alias("kind"), "event_id", "user_id", "value"))
    first, *more = parts
    for part in more:
        first = first.unionByName(part)
    return first


@query("evt_append", """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s AS (SELECT * FROM n WHERE i <= 5), w AS (SELECT user_id, max(i) AS have FROM s GROUP BY 1)
SELECT event_id, user_id, i AS version FROM n JOIN w USING (user_id) WHERE i <= 8 AND (i <= 5 OR (user_id % 3 <> 0 AND have = 5))""")
def evt_append(spark, sf_dir):
    """Five events of each user are stored; three more follow, of which every third user's expect a wrong version and are refused."""
    n = sourcing.versioned(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts"), ["user_id"], ["ts", "event_id"])
    store = n.filter("version <= 5")
    new = n.filter("version between 6 and 8").drop("version").withColumn("expected_version", F.when(F.col("user_id") % 3 == 0, 4).otherwise(5).cast("long"))
    accepted, _ = sourcing.append(store, new, ["user_id"], ["ts", "event_id"])
    return store.unionByName(accepted).select("event_id", "user_id", "version")


@query("evt_status", """
SELECT event_id, event_type, CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'processed' ELSE 'pending' END AS status FROM events WHERE NOT (event_type = 'click' AND value > 400)""")
def evt_status(spark, sf_dir):
    """A store partitioned by type: states of one type's events change, some of another's go; other partitions stay as they are."""
    path = fresh(spark, "store")
    spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "value").withColumn("status", F.lit("pending")).write.partitionBy("event_type").parquet(path)
    updates = spark.read.parquet(path).filter("event_type = 'error' and event_id % 2 = 0").select("event_id", F.lit("processed").alias("status"))
    sourcing.rewrite(spark, path, "event_type", lambda part: sourcing.with_status(part, steps.cut(updates), "event_id"), ["error"])
    sourcing.rewrite(spark, path, "event_type", lambda part: part.filter("value is null or value <= 400"), ["click"])
    return spark.read.parquet(path).select("event_id", "event_type", "status")
