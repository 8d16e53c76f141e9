"""A training corpus from the documents table in five stages; see STAGES.

Every stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and read again for the next.
All but the last return the columns of documents, with whatever further columns docs has: within a stage these have names of their own,
so none can clash with an operator's.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltaic.llm import mixing, packing, similar, substrings, toxicity
from voltaic.llm._common import comparable, crc_mod, cut, drop_cut, table


def _own(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns renamed, and the new names by the old ones."""
    names = {c: f"docs_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """docs with t1 and t2, which stand for its text, and x, for the whole row, maps at any depth too."""
    whole = [comparable(F.col(f.name), f.dataType) for f in docs.schema.fields]
    return docs.withColumns(similar.text_keys(text) | {"x": F.xxhash64(*whole)})


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold stay."""
    own, names = _own(docs)
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").filter(crc_mod("doc_id", 3) != 1))
    scored = toxicity.score(own, model, text_col=names["text"])
    return scored.filter("tox_predicted = 0").select(*names.values()).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies by SimHash fingerprints, pivot distances and components, and an exact search for links beyond their radius.

    Of the documents linked by a Jaccard similarity of 0.8 or more (5 words) one stays, whole: that with the smallest
    id, one without an id only if none has one; of several rows with that id, one by their texts' keys. Different
    texts that share an id and aren't linked all stay."""
    own, names = _own(docs)
    own = _keyed(own, names["text"])
    groups = cut(similar.near_copies(docs.select("text")), "groups")
    rows = own.groupBy("t1", "t2", "x", F.col(names["doc_id"]).alias("id")).agg(F.count("*").alias("n")).join(groups, ["t1", "t2"])
    best = F.min_by(F.struct("t1", "t2", "x", "n"), F.struct(F.col("id").isNull(), "id", "t1", "t2", "x"))
    stay = cut(rows.groupBy("component").agg(best.alias("s")).select("s.*"), "stay")
    kept = own.join(stay, ["t1", "t2", "x"])
    once = kept.filter("n > 1").dropDuplicates(["t1", "t2", "x"])  # rows that are alike in all
    return kept.filter("n = 1").unionByName(once).select(*names.values()).toDF(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the words of repeated passages; a document that loses its last word goes."""
    own, names = _own(docs)
    passages = substrings.repeated_passages(docs.select("doc_id", "text"))
    changed = passages.filter("n_removed > 0").select("t1", "t2", "n_words", "n_removed", "kept_text")
    kept = _keyed(own, names["text"]).join(changed, ["t1", "t2"], "left").filter(F.col("n_removed").isNull() | (F.col("n_removed") < F.col("n_words")))
    new = {names["text"]: F.coalesce(F.col("kept_text"), F.col(names["text"]))}
    if "n_chars" in names:
        new[names["n_chars"]] = F.coalesce(F.char_length("kept_text").cast(docs.schema["n_chars"].dataType), F.col(names["n_chars"]))
    return kept.withColumns(new).select(*names.values()).toDF(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    own, names = _own(docs)
    own = _keyed(own, names["text"])
    mixed = mixing.mix_sources(own, id_col=names["doc_id"], source_col=names["source"], text_col=names["text"], keep=("t1", "t2", "x"))
    taken = mixed.groupBy("t1", "t2", "x").agg(F.sum("copies").alias("copies"), F.count("*").alias("n")).filter("copies > 0")
    rows = own.join(cut(taken, "taken"), ["t1", "t2", "x"])
    rows = rows.filter("n = 1").unionByName(rows.filter("n > 1").dropDuplicates(["t1", "t2", "x"]))
    times = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return rows.select(*names.values(), times.alias("time")).drop("time").toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece, with its place in a sequence of at most 2048 tokens."""
    return packing.pack_documents(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("mix_sources", mix),
    ("best_fit_packing", pack),
]

#: SQL expresses none of the model, the automata and the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        done = cut(stage(spark, docs, sf_dir), f"stage-{name}")
        if k:
            drop_cut(docs)
        docs = done
    return docs
