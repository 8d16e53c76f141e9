"""Privacy of nested columns: structs, arrays and maps are walked when the plan is made, and every leaf gets an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltaic.operators import privacy

#: Parts of names of columns that hold personal data.
PRIVATE = ("name", "email", "phone", "address", "ssn", "birth", "passport", "license", "card", "account")
#: Kinds of personal data that make a text highly sensitive.
HIGH = ("ssn", "credit_card", "driver_license")

Leaf = Callable[[str, Column, T.DataType, bool], Column]


def walk(column: Column, kind: T.DataType, leaf: Leaf, name: str = "", listed: bool = False) -> Column:
    """The column with leaf(name, value, type, listed) in place of every leaf: name is that of the nearest field, listed whether it stands
    in an array or is a map's value. Null structs, arrays and maps stay null; keys of maps stay as they are."""
    if isinstance(kind, T.StructType):
        fields = [walk(column[f.name], f.dataType, leaf, f.name, False).alias(f.name) for f in kind.fields]
        return F.when(column.isNotNull(), F.struct(*fields)) if fields else column
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: walk(x, kind.elementType, leaf, name, True))
    if isinstance(kind, T.MapType):
        return F.transform_values(column, lambda _, v: walk(v, kind.valueType, leaf, name, True))
    return leaf(name, column, kind, listed)


def _all(df: DataFrame, columns: list[str] | None, leaf: Leaf) -> DataFrame:
    wanted = df.columns if columns is None else columns
    return df.select(*[walk(F.col(f.name), f.dataType, leaf, f.name).alias(f.name) if f.name in wanted else F.col(f.name) for f in df.schema.fields])


def anonymise(df: DataFrame, level: str = "medium", columns: list[str] | None = None) -> DataFrame:
    """Columns (all by default) without what tells a person, at any depth: personal data in texts is masked; texts in
    arrays and maps are, by level, eight digits of their hash (high), their ends around stars (medium) or as they are (low); at level
    high numbers become eight digits of the hash of their text. Other values, and nulls, stay."""

    def leaf(name: str, value: Column, kind: T.DataType, listed: bool) -> Column:
        if isinstance(kind, T.StringType):
            if not listed:
                return privacy.mask(value)
            return value if level == "low" else privacy.anonymise(value, level)
        if isinstance(kind, T.NumericType) and level == "high":
            return privacy.anonymise(value.cast("string"), "high")
        return value

    return _all(df, columns, leaf)


def pseudonymise(df: DataFrame, salt: str, private: tuple[str, ...] = PRIVATE, columns: list[str] | None = None) -> DataFrame:
    """Columns whose texts and numbers, where the nearest field's name holds one of private, become 16 digits of a salted hash, at any depth."""

    def leaf(name: str, value: Column, kind: T.DataType, listed: bool) -> Column:
        hidden = any(part in name.lower() for part in private) and isinstance(kind, (T.StringType, T.NumericType))
        return privacy.pseudonym(value.cast("string"), salt) if hidden else value

    return _all(df, columns, leaf)


def _sensitivity(text: Column) -> Column:
    """2, 1 or 0: highly, somewhat or not sensitive."""
    found = privacy.detect(text)
    some = lambda kinds: sum((F.coalesce(found[k], F.lit(0)) for k in kinds), F.lit(0)) > 0
    return F.when(some(HIGH), 2).when(some([k for k in found if k not in HIGH]), 1).otherwise(0)


def classify(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Of every column high, medium or low, by the personal data in its texts, at any depth: a struct's, array's or map's class is
    that of its most sensitive value; what is null or no text is low."""

    def rank(column: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            parts = [rank(column[f.name], f.dataType) for f in kind.fields]
            return F.greatest(*parts) if len(parts) > 1 else parts[0] if parts else F.lit(0)
        if isinstance(kind, T.ArrayType):
            return F.coalesce(F.array_max(F.transform(column, lambda x: rank(x, kind.elementType))), F.lit(0))
        if isinstance(kind, T.MapType):
            return F.coalesce(F.array_max(F.transform(F.map_values(column), lambda x: rank(x, kind.valueType))), F.lit(0))
        return _sensitivity(column) if isinstance(kind, T.StringType) else F.lit(0)

    named = lambda c: F.when(c == 2, "high").when(c == 1, "medium").otherwise("low")
    wanted = df.columns if columns is None else columns
    return df.select(*[named(rank(F.col(f.name), f.dataType)).alias(f.name) if f.name in wanted else F.col(f.name) for f in df.schema.fields])
