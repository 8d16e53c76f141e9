"""The whole pipeline against a brute-force version of its stages."""

import collections
import zlib

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from voltaic.llm import mixing, queries, toxicity
from voltaic.llm._common import comparable, crc_mod

SF = "/root/testdata/sf0.001"


def one_of_each_group(docs):
    """The smallest id of each group of texts that links of Jaccard similarity 0.8 over 5-word shingles connect."""
    words = {i: t.encode().lower().split() for i, t in docs.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    root = {i: i for i in docs}
    ids = sorted(docs)
    for a in ids:
        for b in ids:
            x, y = sets[a], sets[b]
            if a < b and root[a] != root[b] and (x == y or len(x & y) >= 0.8 * len(x | y) - 1e-9):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return {i: docs[i] for i in ids if root[i] == i}


def without_repeats(docs):
    counts, words = collections.Counter(), {i: t.encode().split() for i, t in docs.items()}
    for w in words.values():
        counts.update(tuple(w[k : k + 35]) for k in range(len(w) - 34))
    out = {}
    for i, w in words.items():
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 34):
            gone[k : k + 35] |= counts[tuple(w[k : k + 35])] > 1
        if gone.any():
            text = b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()
        else:
            text = docs[i]
        if not gone.any() or not gone.all():
            out[i] = text
    return out


def copies_in_mix(docs, sources):
    """How often the mix takes each document, by the operator's SQL."""
    documents = pd.DataFrame({"doc_id": list(docs), "text": list(docs.values()), "source": [sources[i] for i in docs]})
    con = duckdb.connect()
    con.register("documents", documents)
    rows = con.sql(mixing.SQL).df()
    return {int(r.doc_id): int(r.taken) // int(r.size) for r in rows.itertuples(index=False) if r.size and r.taken}


def test_run_is_what_its_stages_are(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = table.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    model = toxicity.fit(table, labels.filter(crc_mod("doc_id", 3) != 1))
    docs = {r.doc_id: r.text or "" for r in rows if model.score(r.text or "") < 0.7}
    docs = without_repeats(one_of_each_group(docs))
    copies = copies_in_mix(docs, {r.doc_id: r.source for r in rows})
    library, want = Tokenizer.from_file(queries.PACKING), collections.Counter()
    for i, n in copies.items():
        ids = np.array([*library.encode(docs[i], add_special_tokens=False).ids, 0], "<u4")
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[i, piece, at, len(part), zlib.crc32(part.tobytes())] += n
    got = corpus_pipeline.run(spark, SF).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = collections.defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for held in places.values():
        ends = [0, *np.cumsum([n for _, n in sorted(held)]).tolist()]
        assert [o for o, _ in sorted(held)] == ends[:-1] and ends[-1] <= 2048
    assert len(places) <= -(-sum(r.length for r in got) // 2048) + 3


def test_columns_that_hold_maps(spark):
    """Rows that differ in a map alone, at any depth, stay what they are in every stage that keys whole rows."""
    text = " ".join(f"w{k}" for k in range(12))
    kind = "doc_id long, text string, lang string, source string, n_chars long, m map<string,string>, s struct<m: map<string,int>, a array<map<string,string>>>"
    rows = [(1, text, "en", "a", 5, {"k": "v", "l": "w"}, ({"i": 1}, [{"a": "b"}])), (1, text, "en", "a", 5, {"l": "w", "k": "x"}, ({"i": 1}, [{"a": "b"}])), (2, text, "en", "a", 5, None, (None, [None, {}])), (3, "other words", "en", "a", 5, {}, None)]
    docs = spark.createDataFrame(rows, kind)
    sets = lambda df: sorted((r.doc_id, str(sorted((r.m or {}).items())), str(r.s)) for r in df.collect())
    assert sets(corpus_pipeline.drop_repeated_passages(spark, docs, SF)) == sets(docs)
    mixed = corpus_pipeline.mix(spark, docs, SF)
    assert {x[:2] for x in sets(mixed)} == {x[:2] for x in sets(docs)} and mixed.schema == docs.schema
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert [x[0] for x in sets(kept)] == [1, 3] and sets(kept)[0] in sets(docs)
    same = spark.createDataFrame([({"a": 1, "b": 2},), ({"b": 2, "a": 1},), ({"a": 2, "b": 1},)], "m map<string,int>")
    keys = [r[0] for r in same.select(F.xxhash64(comparable(F.col("m"), same.schema["m"].dataType))).collect()]
    assert keys[0] == keys[1] != keys[2]
