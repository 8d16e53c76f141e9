"""Contracts of data: payload schemas and their versions, table schemas, tests of columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from voltaic.operators.sourcing import migration_path

#: How a JSON type shows in the schema of a variant; whole numbers and truth values are numbers too.
JSON_TYPES = {"string": "^STRING", "integer": "^(BIGINT|BOOLEAN)", "number": "^(BIGINT|BOOLEAN|DOUBLE|FLOAT|DECIMAL)", "boolean": "^BOOLEAN", "array": "^ARRAY", "object": "^OBJECT"}


def payload_fits(payload: Column, required: list[str], types: dict[str, str]) -> Column:
    """Whether a JSON text is an object that has the required fields and, where it has them, fields of these types.

    A field that holds JSON null is present and of no type; unknown types fit everything; null or broken text fails.
    """
    parsed = F.try_parse_json(payload)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(parsed, path, "variant"))
    field = lambda name: kind(f"$['{name}']")
    checks = [kind("$").startswith("OBJECT"), *[field(n).isNotNull() for n in required]]
    checks += [F.coalesce(field(n).rlike(JSON_TYPES[t]), F.lit(True)) for n, t in types.items() if t in JSON_TYPES]
    return F.coalesce(reduce(Column.__and__, checks), F.lit(False))


def compatibility(old: list[str] | None, new: list[str] | None, migration: bool = False) -> str:
    """How two versions' required fields go together; None is an unknown version."""
    if old is None or new is None:
        return "BREAKING_CHANGE"
    if migration:
        return "MIGRATION_REQUIRED"
    return "FORWARD_COMPATIBLE" if set(old) == set(new) else "BREAKING_CHANGE"


def migrated(df: DataFrame, steps: dict[tuple[int, int], dict[str, Column]], goal: int, version: str = "version") -> DataFrame:
    """Rows brought to version goal: step (a, b) says which columns change, and how, from version a to b.

    Rows of version goal or of none stay as they are; a version below goal without a path to it is an error.
    """
    for here in sorted({a for a, _ in steps if a < goal}):
        after = migration_path(set(steps), here, goal)[1]
        mine = F.col(version) == here
        changed = {c: F.when(mine, x).otherwise(F.col(c) if c in df.columns else F.lit(None)) for c, x in steps[here, after].items()}
        df = df.withColumns(changed | {version: F.when(mine, F.lit(after)).otherwise(F.col(version))})
    return df


def schema_differences(actual: StructType, expected: StructType) -> dict[str, list[str]]:
    """Names of fields that are missing, extra, or of another type."""
    have, want = ({f.name: f.dataType for f in s.fields} for s in (actual, expected))
    return {"missing": sorted(want.keys() - have.keys()), "extra": sorted(have.keys() - want.keys()), "mismatched": sorted(n for n in have.keys() & want.keys() if have[n] != want[n])}


def column_tests(df: DataFrame, not_null: list[str] = (), accepted: dict[str, list] | None = None, between: dict[str, tuple[float, float]] | None = None, unique: list[str] = ()) -> DataFrame:
    """(column, test, violations, passed). The row tests take one pass together, each unique test an aggregation.

    Nulls fail only not_null. unique counts the different values that occur more than once.
    """
    bad = {(c, "not_null"): F.col(c).isNull() for c in not_null}
    bad |= {(c, "accepted_values"): ~F.col(c).isin(v) for c, v in (accepted or {}).items()}
    bad |= {(c, "between"): ~F.col(c).between(*b) for c, b in (between or {}).items()}
    row = lambda c, test, n: F.struct(F.lit(c).alias("column"), F.lit(test).alias("test"), n.alias("violations"))
    parts = [df.agg(F.array(*[row(c, test, F.count_if(x)) for (c, test), x in bad.items()]).alias("rows")).select(F.explode("rows").alias("x"))] if bad else []
    for c in unique:
        often = df.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).agg(F.count("*").alias("n"))
        parts.append(often.agg(F.count_if(F.col("n") > 1).alias("n")).select(row(c, "unique", F.col("n")).alias("x")))
    return reduce(DataFrame.unionByName, parts).select("x.*").withColumn("passed", F.col("violations") == 0)
