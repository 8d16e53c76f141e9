"""Personal data in text: detection, masking, pseudonyms, retention."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltaic.operators import steps

#: The detectors, by kind of personal data.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b",
    "phone": r"\b\d{3}[-.]\d{3}[-.]\d{4}\b",
    "ip_address": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    "mac_address": r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b",
    "date_of_birth": r"\b\d{1,2}/\d{1,2}/\d{4}\b",
    "driver_license": r"\b[A-Z]\d{7,8}\b",
    "passport": r"\b[A-Z]{1,2}\d{6,9}\b",
}


#: What a text must hold for a pattern to match in it: a character, or three digits in a row.
NEEDS = {"email": "@", "mac_address": ":-", "ip_address": ".", "date_of_birth": "/"}


def _matches(text: Column, kind: str) -> Column:
    """All matches of a kind; its pattern runs only over texts that hold what it needs."""
    may = reduce(or_, [text.contains(c) for c in NEEDS[kind]]) if kind in NEEDS else text.rlike("[0-9]{3}")
    none = F.array().cast("array<string>")
    return F.when(may, F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))).otherwise(none)


def detect(text: Column) -> dict[str, Column]:
    """How many of each kind a text holds."""
    return {kind: F.size(_matches(text, kind)) for kind in PATTERNS}


def findings(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, match) of every match."""
    found = F.concat(*[F.transform(_matches(F.col(text), kind), lambda m, k=kind: F.struct(F.lit(k).alias("kind"), m.alias("match"))) for kind in PATTERNS])
    return df.select(key, F.explode(found).alias("f")).select(key, "f.kind", "f.match")


def mask(text: Column) -> Column:
    """Every match becomes its kind's name in brackets."""
    for kind, p in PATTERNS.items():
        text = F.regexp_replace(text, p, f"[{kind.upper()}]")
    return text


def anonymise(value: Column, level: str = "high") -> Column:
    """high: eight digits of the SHA-256; medium: the first and last character around stars."""
    if level == "high":
        return F.substring(F.sha2(value, 256), 1, 8)
    short = F.char_length(value) <= 2
    return F.when(short, F.lit("**")).otherwise(F.concat(F.substring(value, 1, 1), F.repeat(F.lit("*"), F.char_length(value) - 2), F.substring(value, -1, 1)))


def pseudonym(value: Column, salt: str) -> Column:
    return F.substring(F.sha2(F.concat(value, F.lit(salt)), 256), 1, 16)


def lineage(edges: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """(start, node, depth) of every node reachable from starts (node) by edges (source, target), in at most depth steps if given.

    One join a step, written, so plans don't grow; a node counts once for each start, at its least depth, so cycles
    end, and steps end when nothing new is reached.
    """
    front = steps.cut(starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth")))
    seen, step = front, 0
    while depth is None or step < depth:
        step += 1
        front = front.join(edges, front["node"] == edges["source"]).select("start", F.col("target").alias("node"), F.lit(step).alias("depth")).distinct()
        front = steps.cut(front.join(seen.select("start", "node"), ["start", "node"], "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def impact(edges: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """(start, downstream, depth, impact): how many nodes follow each start, how far, and whether that is over 10 or 5."""
    reached = lineage(edges, starts, depth).groupBy("start").agg((F.count("*") - 1).alias("downstream"), F.max("depth").alias("depth"))
    return reached.withColumn("impact", F.when(F.col("downstream") > 10, "high").when(F.col("downstream") > 5, "medium").otherwise("low"))


def request_overview(requests: DataFrame, kind: str, subject: str, done: str, due: str, as_of: str) -> DataFrame:
    """Of each kind of request: how many, of how many subjects, completed, overdue on as_of, and the next that is due."""
    late = ~F.col(done) & (F.col(due) < F.lit(as_of).cast("timestamp_ntz"))
    return requests.groupBy(kind).agg(F.count("*").alias("requests"), F.count_distinct(subject).alias("subjects"), F.count_if(done).alias("completed"), F.count_if(late).alias("overdue"), F.min(F.when(~F.col(done), F.col(due))).alias("next_due"))


def erase(df: DataFrame, subjects: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of df without those of the subjects; rows with a null key belong to nobody and stay."""
    return df.join(subjects, keys, "left_anti")


def export_subject(df: DataFrame, key: str, subject, private: list[str] = ()) -> DataFrame:
    """All rows of one subject, without columns that are not the subject's own: for access and portability."""
    return df.filter(F.col(key) == F.lit(subject)).drop(*private)


def risk_points(tests: list[tuple[Column, int]]) -> Column:
    """The points of all tests that hold; null tests give none."""
    parts = [F.when(test, points).otherwise(0) for test, points in tests]
    return sum(parts[1:], parts[0])
