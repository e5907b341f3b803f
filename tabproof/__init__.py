"""Profiling tables and checking invariants over them, as Spark DataFrames."""

from tabproof.operators.checks import Check, checks_frame, normalize_checks, number_round
from tabproof.operators.console import page, run_sql, starter_checks
from tabproof.operators.evaluate import evaluate_checks, violating_rows
from tabproof.operators.findings import bound_findings, known_identifiers, to_findings
from tabproof.operators.narrow import narrow_check, worst_values
from tabproof.operators.profile import (
    column_summary,
    profile_catalog,
    profile_rollup,
    profile_table,
    publish_profile,
    shape_leaks,
)
from tabproof.operators.propose import not_yet_run, propose_checks, reference_candidates
from tabproof.operators.summary import (
    check_details,
    data_inventory,
    falsified,
    falsified_by_round,
    rounds,
    run_round,
    run_totals,
)
from tabproof.sources.catalog import Catalog, Source, SourceError, load_catalog
from tabproof.sources.sinks import write_run

__all__ = [
    "Catalog",
    "Check",
    "Source",
    "SourceError",
    "bound_findings",
    "check_details",
    "checks_frame",
    "column_summary",
    "data_inventory",
    "evaluate_checks",
    "falsified",
    "falsified_by_round",
    "known_identifiers",
    "load_catalog",
    "narrow_check",
    "worst_values",
    "normalize_checks",
    "not_yet_run",
    "number_round",
    "page",
    "profile_catalog",
    "profile_rollup",
    "profile_table",
    "propose_checks",
    "publish_profile",
    "reference_candidates",
    "rounds",
    "run_round",
    "run_sql",
    "run_totals",
    "shape_leaks",
    "starter_checks",
    "to_findings",
    "violating_rows",
    "write_run",
]
