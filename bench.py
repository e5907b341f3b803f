"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from tabproof.operators import checks, evaluate, narrow, profile, propose
from tabproof.session import build_session
from tabproof.sources.catalog import Catalog
from tabproof.suite.derived import LINEITEM_PREDICATES

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def fresh(spark) -> Catalog:
    """A catalog that has counted nothing yet."""
    return Catalog.from_parquet(spark, FOLDER, CATALOG)


CATALOG = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


def full_profile(spark):
    return profile.profile_table(fresh(spark).frame("lineitem"), "lineitem").collect()


def sketched_profile(spark):
    return profile.profile_table(fresh(spark).frame("lineitem"), "lineitem", exact=False).collect()


def many_predicates(spark):
    listed = [dict(table="lineitem", expression=f"l_quantity > {i % 50} OR l_tax < 0.0{i % 9}") for i in range(600)]
    wire = checks.checks_frame(spark, listed)
    return evaluate.evaluate_checks(fresh(spark), checks.normalize_checks(wire)).collect()


def duplicate_rows(spark):
    return evaluate.duplicate_rows(fresh(spark).frame("lineitem"), ["l_orderkey", "l_linenumber"]).count()


def composite_keys(spark):
    return propose.composite_keys(fresh(spark).frame("orders"), "orders", max_columns=2).collect()


def minority_rows(spark):
    return propose.minority_rows(fresh(spark).frame("part"), "p_name").count()


def conditional_rules(spark):
    return propose.conditional_rules(fresh(spark).frame("lineitem"), ["l_quantity < 49"]).collect()


def text_profile(spark):
    return profile.profile_table(fresh(spark).frame("documents"), "documents").collect()


def fused_predicates(spark):
    line = fresh(spark).frame("lineitem")
    return line.selectExpr(
        *[f"count_if({evaluate.violates_sql(p)}) as n{i}" for i, p in enumerate(LINEITEM_PREDICATES)]
    ).collect()


def separate_predicates(spark):
    line = fresh(spark).frame("lineitem")
    return [evaluate.predicate_violations(line, p).collect() for p in LINEITEM_PREDICATES]


def check_batch(spark):
    wire = checks.checks_frame(spark, [dict(table="lineitem", expression=p) for p in LINEITEM_PREDICATES])
    return evaluate.evaluate_checks(fresh(spark), checks.normalize_checks(wire)).collect()


def reference_check(spark):
    c = fresh(spark)
    return evaluate.reference_violations(
        c.frame("lineitem"), ["l_orderkey"], c.frame("orders"), ["o_orderkey"]
    ).collect()


def unique_check(spark):
    return evaluate.unique_violations(fresh(spark).frame("lineitem"), ["l_orderkey", "l_linenumber"]).collect()


def reference_discovery(spark):
    return propose.reference_candidates(fresh(spark)).collect()


def narrow_predicate(spark):
    return narrow.narrow_predicate(fresh(spark).frame("lineitem"), "l_quantity < 49").collect()


def narrow_reference(spark):
    check = checks.Check("h1", "references", "orders", ("o_orderkey",), "", "lineitem", ("l_orderkey",))
    return narrow.narrow_check(fresh(spark), check).collect()


QUERIES = [
    full_profile, text_profile, fused_predicates, separate_predicates, check_batch, reference_check,
    unique_check, reference_discovery, narrow_predicate, narrow_reference, sketched_profile, many_predicates,
    duplicate_rows, composite_keys, minority_rows, conditional_rules,
]


def main() -> None:
    spark = build_session(
        "bench",
        **{
            "spark.master": f"local[{CPUS}]",
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": CPUS,
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    fresh(spark).frame("lineitem").groupBy("l_returnflag").count().collect()  # start the executor threads
    seconds = {}
    for query in QUERIES:
        best = None
        for _ in range(2):
            started = time.perf_counter()
            query(spark)
            took = time.perf_counter() - started
            best = took if best is None else min(best, took)
        seconds[query.__name__] = round(best, 3)
    scale = re.search(r"sf([0-9.]+)", FOLDER)
    print(
        json.dumps(
            {
                "metric": "total seconds, best of two runs per query",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )


if __name__ == "__main__":
    main()
