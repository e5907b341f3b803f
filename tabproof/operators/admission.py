"""Admission: which checks may run at all, decided from the schema alone."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabproof.functions.guard import columns_reason, expression_reason
from tabproof.functions.naming import is_safe_table_name
from tabproof.functions.text import quote_text
from tabproof.functions.types import type_family


def schema_map(schemas: Mapping[str, T.StructType]) -> Column:
    """A map from each table to its column names, and from those to types and families.

    Schemas are known to the driver, so they travel with the plan and nothing is joined.
    """
    tables = []
    for table, schema in schemas.items():
        names = [quote_text(f.name) for f in schema.fields]
        types = [quote_text(f.dataType.simpleString()) for f in schema.fields]
        families = [quote_text(type_family(f.dataType)) for f in schema.fields]
        pairs = [
            ", ".join(f"{n}, {v}" for n, v in zip(names, values)) for values in (types, families)
        ]
        tables.append(
            f"{quote_text(table)}, named_struct('known', array({', '.join(names)}), "
            f"'types', map({pairs[0]}), 'families', map({pairs[1]}))"
        )
    return F.expr(f"map({', '.join(tables)})")


def table_reason(name: Column, known: Column) -> Column:
    """Why a table is refused, or NULL. ``known`` is NULL for a table nobody has."""
    return F.when(
        known.isNull(), F.concat(F.lit('Unknown table "'), name, F.lit('".'))
    ).when(
        ~is_safe_table_name(name), F.concat(F.lit('Unsafe table name "'), name, F.lit('".'))
    )


def comparable_reason(
    table: Column, columns: Column, types: Column, families: Column,
    ref_table: Column, ref_columns: Column, ref_types: Column, ref_families: Column,
) -> Column:
    """Why two key lists may not be compared, or NULL: each pair must share a family."""
    pairs = F.transform(
        F.arrays_zip(columns.alias("a"), ref_columns.alias("b")),
        lambda p: F.when(
            F.try_element_at(families, p["a"]) != F.try_element_at(ref_families, p["b"]),
            F.concat(
                F.lit("Cannot compare "), table, F.lit("."), p["a"],
                F.lit(" ("), F.try_element_at(types, p["a"]), F.lit(") with "),
                ref_table, F.lit("."), p["b"],
                F.lit(" ("), F.try_element_at(ref_types, p["b"]), F.lit("): types differ."),
            ),
        ),
    )
    return F.try_element_at(F.filter(pairs, lambda r: r.isNotNull()), F.lit(1))


def admit_checks(checks: DataFrame, schemas: Mapping[str, T.StructType]) -> DataFrame:
    """Add ``reason`` to each check: why it may not run, or NULL when it may.

    ``schemas`` describes the tables, see ``Catalog.schemas``.
    """
    described = checks.withColumn("_all", schema_map(schemas)).select(
        *checks.columns,
        F.try_element_at("_all", F.col("table")).alias("_own"),
        F.try_element_at("_all", F.col("references_table")).alias("_other"),
    )
    known, other_known = F.col("_own.known"), F.col("_other.known")
    references = F.coalesce(
        table_reason(F.col("references_table"), other_known),
        columns_reason(F.col("columns"), known),
        columns_reason(F.col("references_columns"), other_known),
        F.when(
            F.size("columns") != F.size("references_columns"),
            F.lit("Referencing and referenced column counts differ."),
        ),
        comparable_reason(
            F.col("table"), F.col("columns"), F.col("_own.types"), F.col("_own.families"),
            F.col("references_table"), F.col("references_columns"),
            F.col("_other.types"), F.col("_other.families"),
        ),
    )
    by_kind = (
        F.when(F.col("kind") == "row_predicate", expression_reason(F.col("expression")))
        .when(F.col("kind") == "unique", columns_reason(F.col("columns"), known))
        .otherwise(references)
    )
    reason = F.coalesce(table_reason(F.col("table"), known), by_kind)
    return described.withColumn("reason", reason).select(*checks.columns, "reason")
