"""Rules that are rows of a table, compiled into one plan over the events."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltaic.operators import cep

#: The rows of a table of rules, what a kind doesn't use being null. kind: aggregation, threshold, conditional or sequence.
SCHEMA = """rule_id string, kind string, priority int, enabled boolean, event_types array<string>, field string, aggregation string,
operator string, threshold double, conditions array<struct<field: string, operator: string, value: double>>, sequence array<string>"""
OPERATORS = {
    "gt": lambda a, b: a > b,
    "gte": lambda a, b: a >= b,
    "lt": lambda a, b: a < b,
    "lte": lambda a, b: a <= b,
    "eq": lambda a, b: a == b,
    "ne": lambda a, b: a != b,
}
AGGREGATIONS = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}


def _pick(named: dict, name: str | None, default: str, what: str, rule: str):
    if (name or default) not in named:
        raise ValueError(f"rule {rule}: {what} {name} is none of {', '.join(named)}")
    return named[name or default]


def condition(rule, kind: str) -> Column:
    """A rule as an aggregate condition over a key's events of the rule's types."""
    applies = F.col(kind).isin(*rule.event_types) if rule.event_types else F.lit(True)
    value = lambda field: F.when(applies, F.col(field).cast("double"))
    if rule.kind == "aggregation":
        if not rule.field or rule.threshold is None:
            return F.lit(False)
        total = _pick(AGGREGATIONS, rule.aggregation, "sum", "aggregation", rule.rule_id)(value(rule.field))
        return (F.count(value(rule.field)) > 0) & _pick(OPERATORS, rule.operator, "gte", "operator", rule.rule_id)(total, F.lit(rule.threshold))
    if rule.kind == "threshold":
        if not rule.field or rule.threshold is None:
            return F.lit(False)
        return F.bool_or(_pick(OPERATORS, rule.operator, "gte", "operator", rule.rule_id)(value(rule.field), F.lit(rule.threshold)))
    if rule.kind == "conditional":
        held = [F.bool_or(_pick(OPERATORS, c.operator, "", "operator", rule.rule_id)(value(c.field), F.lit(c.value))) for c in rule.conditions or ()]
        return F.bool_or(applies) & reduce(and_, [F.coalesce(h, F.lit(False)) for h in held], F.lit(True))
    raise ValueError(f"rule {rule.rule_id}: kind {rule.kind} is none of aggregation, threshold, conditional, sequence")


def execute(df: DataFrame, rules: DataFrame, keys: list[str], ts: str, order: str, kind: str, most: int = 1000) -> DataFrame:
    """(keys, rule_id, priority, place) of each rule that holds for a key's events, by falling priority, equal ones by rule_id.

    rules: a table like SCHEMA; rules that aren't enabled (null: they are) don't run. Its rows come to the driver, where they become
    one plan, so more than most of them are refused. An aggregation compares a sum (or avg, min, max, count) of a field over the
    events of the rule's types (none: all) with the threshold, a threshold asks for one such event, a conditional for one for each of its
    conditions, a sequence for its types in this order, with any others between. Aggregations, thresholds and conditionals take one
    pass over the events together, each sequence a step a type (see cep.sequence). Null values and events without a time count for nothing in
    what needs them; an empty sequence holds. Of a rule_id that comes twice both rows count.
    """
    table = rules.filter(F.coalesce("enabled", F.lit(True))).limit(most + 1).collect()
    if len(table) > most:
        raise ValueError(f"over {most} rules")
    table = sorted(table, key=lambda r: (-(r.priority or 0), r.rule_id))
    plain = [(i, r) for i, r in enumerate(table) if r.kind != "sequence"]
    held = [F.when(F.coalesce(condition(r, kind), F.lit(False)), F.lit(i)) for i, r in plain]
    empty = [F.lit(i) for i, r in enumerate(table) if r.kind == "sequence" and not r.sequence]
    out = df.groupBy(*keys).agg(F.array_compact(F.array(*held, *empty).cast("array<int>")).alias("_held"))
    for i, r in enumerate(table):
        if r.kind == "sequence" and r.sequence:
            steps_of = df.filter(F.col(ts).isNotNull() & (F.col(kind).isin(*r.event_types) if r.event_types else F.lit(True)))
            met = cep.sequence(steps_of, keys, ts, order, kind, list(r.sequence)).filter(F.col("matched") == len(r.sequence))
            met = met.select(*[F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)], F.lit(i).alias("_i"))
            same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k{j}")) for j, k in enumerate(keys)])
            out = out.join(met, same, "left").select(*keys, F.when(F.col("_i").isNotNull(), F.array_append("_held", F.col("_i"))).otherwise(F.col("_held")).alias("_held"))
    names = F.array(*[F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.priority or 0).alias("priority")) for r in table]) if table else F.array().cast("array<struct<rule_id: string, priority: int>>")
    ranked = out.select(*keys, F.posexplode(F.array_sort("_held")).alias("_at", "_i"))
    return ranked.select(*keys, F.get(names, F.col("_i"))["rule_id"].alias("rule_id"), F.get(names, F.col("_i"))["priority"].alias("priority"), (F.col("_at") + 1).alias("place"))
