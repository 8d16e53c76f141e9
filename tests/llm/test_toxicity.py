"""The toxicity operator against brute force, by its definition, and on held-out rows."""

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voltaic.llm import queries, toxicity


def brute_segments(s):
    """Maximal segments by their definition: split around the best segment again and again."""
    best = max(((sum(s[i:j]), -(j - i), -i, i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=(0,))
    if best[0] <= 0:
        return []
    _, _, _, i, j = best
    return [*brute_segments(s[:i]), (i, j - 1, best[0]), *[(a + j, b + j, x) for a, b, x in brute_segments(s[j:])]]


def test_maximal_segments():
    rng = np.random.default_rng(4)
    for _ in range(200):
        s = rng.integers(-4, 5, rng.integers(1, 14)) + rng.random() * 1e-3
        s = s + rng.random(len(s)) * 1e-3
        got = toxicity.maximal_segments(s)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute_segments(list(s))]


def small_table():
    rng = random.Random(3)
    plain = [f"{a}{b}" for a in ("lorem", "ipsum", "dolor", "sit", "am") for b in ("", "a", "us", "etur")]
    rude = ["Clod!", "clodish", "clodly", "oaf", "oaf,"]
    rows = []
    for i in range(160):
        words = [rng.choice(plain) for _ in range(rng.randrange(1, 30))]
        for _ in range(rng.randrange(2, 5) if i % 4 == 0 else i % 16 == 1):
            words.insert(rng.randrange(len(words) + 1), rng.choice(rude))
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    return rows


def log_odds(texts, prior, least_count, least_z):
    """Scores of tokens and beginnings, straight from the definition."""
    count, parent = collections.defaultdict(lambda: [0, 0]), {}
    for text, y in texts:
        own = collections.Counter()
        for word in text.split():
            line = [w := toxicity.token(word), *(w[:n] + "*" for n in (6, 5, 4, 3) if len(w) >= n)]
            own.update(line)
            parent.update(zip(line, [*line[1:], ""], strict=True))
        for name, n in own.items():
            count[name][y] += min(n, 10)
            if not name.endswith("*"):
                count[""][y] += min(n, 10)
    share, out = count[""][1] / sum(count[""]), {}
    for name in parent:
        (n0, n1), (p0, p1) = count[name], count[parent[name]]
        e = (p1 + prior * share) / (p0 + p1 + prior)
        ratio = 2 * sum(n * math.log(n / ((n0 + n1) * x)) for n, x in ((n1, e), (n0, 1 - e)) if n)
        if n0 + n1 >= least_count and ratio >= least_z**2:
            q = (n1 + prior * e) / (n0 + n1 + prior)
            out[name] = math.log(q / (1 - q)) - math.log(share / (1 - share))
    return out


def test_scores_are_those_of_the_definition(spark):
    rows = small_table()
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, tox_score string")
    model = toxicity.fit(df, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    want = log_odds({(t, y) for _, t, y in rows}, 2.0, 3, 3.0)
    assert model.scores == pytest.approx({k: v - 0.5 for k, v in want.items()}) and "clo*" in want
    clean = [toxicity.token(w) for _, t, y in rows if not y for w in t.split()]
    value = lambda w: next((want[x] for x in (w, *(w[:n] + "*" for n in (6, 5, 4, 3) if len(w) >= n)) if x in want), 0.0) - 0.5
    assert np.mean([math.exp(model.scale * value(w)) for w in clean]) == pytest.approx(1, abs=0.2)
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    for i, text, _ in rows:
        s = [value(toxicity.token(w)) for w in text.split()]
        excess = [model.scale * x - model.shift - math.log(len(s)) for _, _, x in brute_segments(s)]
        x = model.slope * math.log1p(sum(e for e in excess if e > 0)) + model.offset
        assert got[i].tox_score == pytest.approx(1 / (1 + math.exp(-x))) and got[i].tox_predicted == (got[i].tox_score >= 0.7)
    assert np.mean([got[i].tox_predicted == y for i, _, y in rows]) > 0.97


@pytest.mark.parametrize(("sf", "least"), [("sf0.1", 0.88), ("sf0.01", 0.75)])
def test_held_out(spark, sf, least):
    sf = f"/root/testdata/{sf}"
    lang = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = queries.toxicity_scores(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").join(lang, "doc_id").filter("held_out").toPandas()
    flagged, toxic = got["score"] >= 0.7, got["toxic"] == 1
    assert flagged[toxic].mean() >= least and (~flagged[~toxic]).mean() >= 0.98
    if least > 0.8:
        assert all(flagged[toxic & (got["lang"] == x)].mean() >= 0.88 for x in ("en", "de", "fr", "es"))


def test_edges(spark):
    odd = spark.createDataFrame([(1, None, 1.0), (None, "", 2.0), (1, "oaf " * 500, None), (1, "oaf " * 500, None)], "doc_id long, text string, key double")
    model = toxicity.fit(odd.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(odd, model).filter("tox_predicted = 1").count() == 0 and toxicity.score(odd.limit(0), model).count() == 0
    assert toxicity.score(odd, model).columns[:3] == odd.columns
    one = toxicity.fit(odd.withColumn("doc_id", F.lit(5)), spark.createDataFrame([(5, 1), (None, 0), (5, None)], "doc_id long, toxic int"))
    assert one.scores == {}


def test_texts_are_scored_in_parts(spark, monkeypatch):
    """What Python holds doesn't grow with the rows of a batch, nor with its different words."""
    texts = [" ".join(f"w{i}x{k}" for k in range(1000)) + " clod" * (i % 3) for i in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    model = toxicity.Model({"clod": 3.0}, 0.5, slope=1.0)
    taken = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: taken.append(run) or spark.createDataFrame([], schema))
    toxicity.score(df, model)
    rows, known = [], []
    for part in taken[0](iter([pa.RecordBatch.from_pydict({"doc_id": list(range(300)), "text": texts})])):
        rows.append(part)
        known.append(len(model.known))
    assert max(p.num_rows for p in rows) <= 256 and max(known) <= 101_001
    fresh = toxicity.Model({"clod": 3.0}, 0.5, slope=1.0)
    assert [x for p in rows for x in p.column(2).to_pylist()] == [fresh.score(t) for t in texts]
    assert [x for p in rows for x in p.column(0).to_pylist()] == list(range(300))
