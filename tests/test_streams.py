"""Streams over several batches: patterns across batches, bounded buffers, sessions that grow, outer joins, models."""

from datetime import datetime, timedelta

import pytest
from compare import connect, difference
from pyspark.sql import functions as F

from voltaic.plans import streams
from voltaic.plans.registry import ORACLE_SQL, QUERIES
from voltaic.streaming import jobs, patterns

SF = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1)
EVENT = "k int, ts timestamp, id long, kind string, v double"


def at(minutes):
    return T0 + timedelta(minutes=minutes)


class Arrivals:
    """Batches that arrive one after the other, each seen by a run from the same checkpoint."""

    def __init__(self, spark, folder, schema=EVENT):
        self.spark, self.folder, self.schema = spark, str(folder), schema

    def __call__(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        return jobs.stream(self.spark, f"{self.folder}/in", self.schema, "ts")


def test_patterns_across_batches_and_expired_ones(spark, tmp_path):
    arrive = Arrivals(spark, tmp_path)

    def run(rows):
        out = patterns.patterns(arrive(rows), ["k"], "ts", "id", "kind", ["a", "b", "c"], 3600, late="5 minutes")
        with patterns.state_store(spark):
            got = jobs.drain(out, f"{tmp_path}/out").collect()
        return {(r.k, r.tie): (r.matched, r.complete, r.ended) for r in got}

    # key 1: a b | c completes across batches, b and a arrive in the wrong order; key 2 expires after two steps
    assert run([(1, at(10), 3, "b", 1.0), (1, at(0), 1, "a", 1.0), (1, at(5), 2, "x", None), (2, at(1), 4, "a", 1.0), (2, None, 9, "a", 1.0), (2, at(2), 10, None, 1.0)]) == {}
    assert run([(1, at(30), 5, "c", 1.0), (2, at(20), 6, "b", 1.0), (1, at(12), 7, "a", 1.0)]) == {}  # the watermark is at 25
    got = run([(2, at(90), 8, "c", 1.0), (3, at(90), 11, "a", 1.0)])
    assert got == {(1, 1): (3, True, at(30)), (2, 4): (2, False, None), (1, 7): (1, False, None)}
    got = run([(9, at(400), 12, "x", 1.0)])  # all that was open has expired without an event of its key
    assert got[3, 11] == (1, False, None) and len(got) == 4


def test_one_event_is_no_two_steps(spark, tmp_path):
    rows = [(1, at(m), m, "a", 1.0) for m in range(4)] + [(2, at(60), 9, "z", 1.0)]
    out = patterns.patterns(Arrivals(spark, tmp_path)(rows), ["k"], "ts", "id", "kind", ["a", "a"], 600, late="1 minute")
    with patterns.state_store(spark):
        got = {r.tie: (r.matched, r.complete) for r in jobs.drain(out, f"{tmp_path}/out").collect()}
    assert got == {0: (2, True), 1: (2, True), 2: (2, True), 3: (1, False)}


def test_progress_over_late_rows(spark, tmp_path):
    arrive = Arrivals(spark, tmp_path)

    def run(rows):
        out = patterns.progress(arrive(rows), ["k"], "ts", "id", "kind", ["a", "b", "c"], late="1 hour")
        with patterns.state_store(spark):
            return {r.k: r.matched for r in jobs.settle(out, ["k"], "matched", f"{tmp_path}/t").collect()}

    assert run([(1, at(20), 1, "b", 1.0), (2, at(0), 2, "x", 1.0)]) == {1: 0, 2: 0}
    assert run([(1, at(10), 3, "a", 1.0)]) == {1: 2, 2: 0}  # earlier than what was there: both count
    assert run([(3, at(300), 4, "a", 1.0)]) == {1: 2, 2: 0, 3: 1}
    assert run([(1, at(310), 5, "c", 1.0), (1, at(1), 6, "c", 1.0)]) == {1: 3, 2: 0, 3: 1}  # the last row is too late


def test_buffers_are_bounded_and_expire(spark, tmp_path):
    arrive = Arrivals(spark, tmp_path)

    def run(rows):
        out = patterns.buffered(arrive(rows), ["k"], "ts", "id", "v", most=3, age=3600, late="10 minutes")
        with patterns.state_store(spark):
            return {r.k: (r.n, r.total, r.oldest) for r in jobs.settle(out, ["k"], "revision", f"{tmp_path}/t").collect()}

    assert run([(1, at(m), m, "x", float(m)) for m in range(5)] + [(2, at(0), 9, "x", None)]) == {1: (3, 9.0, at(2)), 2: (1, None, at(0))}
    assert run([(1, at(3), 5, "x", 0.5), (1, at(61), 6, "x", 7.0)])[1] == (3, 11.5, at(3)), "the newest three, of which the late one comes after that of its time"
    assert run([(1, at(62), 7, "x", 1.0)])[1] == (3, 12.0, at(4))
    got = run([(3, at(200), 8, "x", 1.0)])
    assert got[1] == (0, None, None) and got[2] == (0, None, None) and got[3][0] == 1  # gone with the watermark at 190
    assert run([(1, at(201), 10, "x", 2.0)])[1] == (1, 2.0, at(201))  # and begun anew


def test_sessions_that_grow_leave_nothing_behind(spark, tmp_path):
    """A session whose beginning moves takes the place of the one it was; the table holds no stale rows."""
    arrive = Arrivals(spark, tmp_path, "k int, ts timestamp")

    def run(rows):
        out = jobs.sessions(arrive(rows), "ts", ["k"], "2 hours", late="60 days")
        return sorted((r.start, r.n) for r in jobs.settle(out, ["k", "start"], "n", f"{tmp_path}/t", mode="complete").collect())

    assert run([(1, at(600))]) == [(at(600), 1)]
    assert run([(1, at(570))]) == [(at(570), 2)]
    assert run([(1, at(100))]) == [(at(100), 1), (at(570), 2)]


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES) if n.startswith("stream_") and n not in ("stream_sequence", "stream_patterns", "stream_buffer")])
def test_queries_over_several_batches(spark, name, monkeypatch, tmp_path):
    """The same results when the events come in four files, one a batch, the latest first."""
    e = spark.read.parquet(f"{SF}/events.parquet")
    for k in (3, 2, 1, 0):
        e.filter(F.floor((F.dayofmonth("ts") - 1) / 8) == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    monkeypatch.setattr(streams, "events", lambda spark, _: jobs.stream(spark, f"{tmp_path}/in", streams.EVENTS, "ts", files_a_batch=1))
    assert difference(QUERIES[name](spark, SF), connect(SF), ORACLE_SQL[name]) is None


@pytest.mark.parametrize("how", ["leftOuter", "rightOuter", "fullOuter"])
def test_outer_interval_joins(spark, tmp_path, how):
    """What has no partner is given once the watermark has passed the time in which one could come."""
    left, right = Arrivals(spark, tmp_path / "l", "k int, ts timestamp"), Arrivals(spark, tmp_path / "r", "o int, ts timestamp")

    def run(a, b):
        other = right(b).withColumnRenamed("ts", "u")
        return {(r.k, r.o) for r in jobs.drain(jobs.interval_join(left(a), other, "k", "o", "ts", "u", 60, "1 minute", how), f"{tmp_path}/out").collect()}

    run([(1, at(0)), (2, at(1))], [(1, at(1)), (3, at(1))])
    got = run([(9, at(500))], [(9, at(500))])
    got = run([(8, at(900))], [(8, at(900))])
    lonely = ({(2, None)} if how != "rightOuter" else set()) | ({(None, 3)} if how != "leftOuter" else set())
    assert got - {(8, 8)} == {(1, 1), (9, 9)} | lonely


def test_a_fitted_model_scores_a_stream(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows = [(k, at(k), k, "x", 3.0 * k + 1) for k in range(20)]
    table = spark.createDataFrame(rows, EVENT)
    model = Pipeline(stages=[VectorAssembler(inputCols=["k"], outputCol="features"), LinearRegression(labelCol="v")]).fit(table)
    source = Arrivals(spark, tmp_path)([*rows, (None, at(30), 30, "x", 0.0)])
    got = jobs.drain(jobs.scored(source, model, ["k"]).select("k", "prediction"), f"{tmp_path}/out").collect()
    assert len(got) == 20 and all(abs(r.prediction - (3 * r.k + 1)) < 1e-6 for r in got)
