"""Contracts of effects: which variables an effect takes, of which kind, and what is wrong with those that a use gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of variables and how a value's JSON type must begin; a rate is also above zero.
KINDS = {"number": ("BIGINT", "DECIMAL", "DOUBLE"), "rate": ("BIGINT", "DECIMAL", "DOUBLE"), "text": ("STRING",), "flag": ("BOOLEAN",), "list": ("ARRAY",), "object": ("OBJECT",)}


def _fits(value: Column, kind: Column) -> Column:
    """Whether a JSON value is of a kind; any value is of an unnamed kind."""
    told = F.schema_of_variant(value)
    begins = lambda words: F.coalesce(*(F.when(told.startswith(w), F.lit(True)) for w in words), F.lit(False))
    fits = F.lit(True)
    for name, words in KINDS.items():
        fits = F.when(kind == name, begins(words)).otherwise(fits)
    return fits


def violations(uses: DataFrame, contracts: DataFrame) -> DataFrame:
    """(series_id, effect_id, name, problem) for uses (series_id, effect_id, variables JSON) under contracts (effect_id, name, kind, required).

    A contract has a row for each variable, or one with a null name for an effect that takes none. Problems: 'unknown effect' (no contract; its
    variables are not looked at), 'not an object' (variables that are no JSON object), 'unknown' (a variable that the contract lacks), 'missing' (one that
    it requires), 'wrong kind', and 'not above zero' (a rate that is a number but not above zero). Null variables are none given. A null kind allows
    any value; of repeated contract rows the one with the least kind counts.

    An effect's contract is one small map, which each use meets once; everything else happens within the use's row.
    """
    row = F.struct(F.col("kind"), F.col("required"))
    once = contracts.groupBy("effect_id", "name").agg(F.min("kind").alias("kind"), F.bool_or(F.coalesce("required", F.lit(False))).alias("required"))
    maps = once.groupBy("effect_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", row.alias("rule"))))).alias("rules"))
    given = uses.join(maps, "effect_id", "left").withColumn("doc", F.try_parse_json("variables"))
    is_object = F.coalesce(F.schema_of_variant("doc").startswith("OBJECT"), F.lit(False))
    values = F.when(is_object, F.from_json("variables", "map<string, variant>")).otherwise(F.create_map().cast("map<string, variant>"))
    read = given.select("series_id", "effect_id", "rules", F.when(F.col("variables").isNotNull() & ~is_object, F.lit(True)).otherwise(False).alias("broken"), values.alias("values"))
    told = lambda name, problem: F.struct(name.alias("name"), F.lit(problem).alias("problem"))

    def judged(name: Column, value: Column) -> Column:
        rule = F.element_at("rules", name)
        amount = F.try_variant_get(value, "$", "double")
        return (
            F.when(~F.map_contains_key("rules", name), told(name, "unknown"))
            .when(rule["kind"].isNotNull() & ~_fits(value, rule["kind"]), told(name, "wrong kind"))
            .when((rule["kind"] == "rate") & ~(amount > 0), told(name, "not above zero"))
        )

    of_values = F.map_values(F.transform_values("values", judged))
    required = F.map_keys(F.map_filter("rules", lambda name, rule: rule["required"] & ~F.map_contains_key("values", name)))
    missing = F.transform(required, lambda name: told(name, "missing"))
    nothing = F.lit(None).cast("string")
    found = (
        F.when(F.col("rules").isNull(), F.array(told(nothing, "unknown effect")))
        .when(F.col("broken"), F.array(told(nothing, "not an object")))
        .otherwise(F.concat(F.array_compact(of_values), missing))
    )
    return read.select("series_id", "effect_id", F.inline(found))
