"""Recipe and persona lookups (J7, P12); tables of a few fixed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packlake import fixed


def _value(table: dict[str, str], name: Column, kind: str) -> Column:
    """Value for a case-insensitive name; null stays null, unknown names fail."""
    pairs = F.create_map(*[F.lit(x) for item in table.items() for x in item])
    found = F.try_element_at(pairs, F.lower(name))
    known = ", ".join(table)
    failure = F.raise_error(F.concat(F.lit(f"unknown {kind} "), name, F.lit(f"; known: {known}")))
    return F.when(name.isNull(), F.lit(None).cast("string")).when(found.isNotNull(), found).otherwise(
        failure.cast("string")
    )


def recipe_prompt(name: Column) -> Column:
    return _value({n: prompt for n, (_, prompt) in fixed.RECIPES.items()}, name, "recipe")


def recipe_title(name: Column) -> Column:
    return _value({n: title for n, (title, _) in fixed.RECIPES.items()}, name, "recipe")


def persona_header(name: Column) -> Column:
    """Header line for a persona or its alias."""
    table = dict(fixed.PERSONA_HEADERS)
    table.update({slug: fixed.PERSONA_HEADERS[full] for full, slug in fixed.PERSONA_SLUGS.items()})
    return _value(table, name, "persona")


def recipes(spark: SparkSession) -> DataFrame:
    """The recipe library as a table."""
    rows = [(name, title, prompt) for name, (title, prompt) in fixed.RECIPES.items()]
    return spark.createDataFrame(rows, "name string, title string, prompt string")
