from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tabproof.operators import checks, evaluate, narrow, propose
from tabproof.sources.catalog import Catalog


@pytest.fixture(scope="module")
def shop(spark):
    customers = spark.range(50).selectExpr("id as customer_id", "concat('c', id) as code", "double(id) as number")
    orders = spark.range(600).selectExpr(
        "id as order_id", "if(id = 13, 999, id % 45) as buyer", "concat('c', id % 50) as code",
        "int(id / 20) as batch", "int(id % 20) as place", "if(id % 3 = 0, 'open', 'done') as status",
        "double(id % 7) as paid", "if(id = 100, -1, int(id % 9)) as rating", "id * 0.37 as price",
        "date_add(date'2024-01-01', int(id % 90)) as ordered",
        "date_add(date'2024-01-01', int(id % 90) + if(id = 5, -3, 2)) as shipped",
    )
    return Catalog.from_frames(spark, {"customers": customers, "orders": orders})


def test_reference_candidates(shop):
    rows = {
        (r["table"], r["column"], r["references_table"], r["references_column"]): r
        for r in propose.reference_candidates(shop).collect()
    }
    buyer = rows["orders", "buyer", "customers", "customer_id"]
    assert (buyer["child_values"], buyer["shared_values"]) == (46, 45)
    assert rows["orders", "code", "customers", "code"]["inclusion"] == 1.0
    assert rows["customers", "code", "orders", "code"]["inclusion"] == 1.0
    # a key kept as a floating-point number is still compared by value
    assert rows["customers", "number", "customers", "customer_id"]["inclusion"] == 1.0
    assert not any("price" in k for k in rows)


def test_only_composite_keys_are_counted_in_full(spark, monkeypatch):
    # (a, b) is unique; the pairs with near ones repeat in 1 of 100 rows or fewer, which sketches do not tell
    near = [f"if(id % 100 < 98, id div 2, id div 4) + {i} as n{i}" for i in range(6)]
    df = spark.range(200_000).selectExpr("id div 400 as a", "id % 400 as b", "id % 2 as few", *near)
    counted, count = [], propose.unique_violations
    monkeypatch.setattr(propose, "unique_violations", lambda df, c: counted.append(tuple(c)) or count(df, c))
    found = {tuple(r["columns"]) for r in propose.composite_keys(df, "t", max_columns=2).collect()}
    pandas = df.toPandas()
    assert found == {c for c in combinations(df.columns, 2) if not pandas.duplicated(list(c)).any()}
    assert ("a", "b") in found and set(counted) == found


def test_shuffles_go_while_checks_are_proposed(shop, monkeypatch):
    flag, seen, stats = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", [], propose.catalog_stats
    monkeypatch.setattr(propose, "catalog_stats", lambda *a, **o: seen.append(shop.spark.conf.get(flag, "false")) or stats(*a, **o))
    assert propose.propose_checks(shop).count() > 0
    assert seen == ["true"] and shop.spark.conf.get(flag, "false") == "false"


def test_nulls_and_zeros_in_composite_keys(spark):
    rows = [(1.0, None, 1), (None, 1, 2), (0.0, 5, 3), (-0.0, 6, 4), (0.0, 6, 1), (1.0, 5, 2)]
    df = spark.createDataFrame(rows, "x double, y long, z long")
    found = {tuple(r["columns"]) for r in propose.composite_keys(df, "t").collect()}
    assert found == {("x", "z"), ("y", "z")}  # -0.0 and 0.0 are one value, (1, NULL) and (NULL, 1) are two


def test_composite_keys_against_brute_force(shop):
    df = shop.frame("orders").drop("order_id", "price")
    found = {tuple(sorted(r["columns"])) for r in propose.composite_keys(df, "orders").collect()}
    pandas = df.toPandas()
    want = set()
    for size in (2, 3):
        for combo in combinations(sorted(df.columns), size):
            if any(set(k) <= set(combo) for k in want):
                continue
            if not pandas.duplicated(list(combo)).any():
                want.add(combo)
    assert found == want and ("batch", "place") in found


def test_minority_rows(spark):
    df = spark.range(1000).selectExpr("id", "if(id % 100 = 7, concat('x-', id), if(id % 3 = 0, 'abc', concat('ab', id % 10))) as s")
    rows = propose.minority_rows(df, "s", threshold=0.05).collect()
    assert sorted(r["id"] for r in rows) == [i for i in range(1000) if i % 100 == 7]
    assert {r["shape"] for r in rows} <= {"a-9", "a-99", "a-9{3}"}


def test_sentinels_orders_rules_and_bounds(shop):
    df = shop.frame("orders")
    hits = {(r["name"], r["sentinel"]): r["hits"] for r in propose.sentinel_counts(df).collect()}
    assert hits["rating", "-1"] == 1 and hits["paid", "0"] == 86 and hits["status", ""] == 0
    order = {(r["low_column"], r["high_column"]): r["violations"] for r in propose.order_invariants(df).collect()}
    assert order["ordered", "shipped"] == 1
    rules = propose.conditional_rules(df, ["rating >= 0", "paid > 0"], ["status", "place"]).collect()
    held = {(r["dim"], r["value"], r["predicate"]) for r in rules}
    pandas = df.toPandas()
    want = set()
    for dim in ("status", "place"):
        for value, part in pandas.groupby(dim):
            if (part["rating"] >= 0).all():
                want.add((dim, str(value), "rating >= 0"))
            if (part["paid"] > 0).all():
                want.add((dim, str(value), "paid > 0"))
    assert held == want
    ends = {r["name"]: r for r in propose.near_bounds(df, "orders").collect()}
    assert ends["rating"]["at_min"] == 1 and ends["order_id"]["at_max"] == 1


def test_numeric_texts(spark):
    df = spark.createDataFrame([("12", "a"), ("x", "b"), ("7", None), (None, None)], "n string, t string")
    rows = {r["name"]: (r["filled"], r["numeric"]) for r in propose.numeric_texts(df).collect()}
    assert rows == {"n": (3, 2), "t": (2, 0)}


def test_narrowing(shop):
    df = shop.frame("orders")
    assert {"status", "rating", "ordered"} <= set(narrow.dimensions(df)) and "order_id" not in narrow.dimensions(df)
    check = checks.Check("h", "references", "orders", ("buyer",), "", "customers", ("customer_id",))
    rows = narrow.narrow_check(shop, check, ["status", "ordered"]).collect()
    by = {(r["dim"], r["value"]): r for r in rows}
    assert by["status", "done"]["violations"] == 1 and by["status", "open"]["lift"] == 0.0
    assert by["status", "done"]["lift"] == pytest.approx(1.5)
    assert sum(r["rows"] for r in rows if r["dim"] == "ordered") == 600
    assert by["ordered", "2024-01-01"]["violations"] == 1
    predicate = checks.Check("h", "row_predicate", "orders", expression="paid > 0")
    rows = narrow.narrow_check(shop, predicate, ["paid"]).collect()
    assert {r["value"]: r["violations"] for r in rows if r["violations"]} == {"0.0": 86}


def test_worst_values_of_ten_thousand(spark):
    rows = spark.range(20_000).selectExpr(
        "id", "if(id % 10000 = 77, null, 'k' || id % 10000) as k", "if(id % 10000 in (5, 77) or id = 9, -1, 1) as amount"
    )
    catalog = Catalog.from_frames(spark, {"big": rows})
    check = checks.Check("h", "row_predicate", "big", expression="amount > 0")
    found = narrow.worst_values(catalog, check, ["k"], keep=2).collect()
    by = {(r["value"], r["rest"]): (r["rows"], r["violations"]) for r in found}
    assert by == {(None, False): (2, 2), ("k5", False): (2, 2), (None, True): (19_996, 1)}
    default = {r["dim"] for r in narrow.worst_values(catalog, check, keep=1).collect()}
    assert default == {"id", "k"}


def test_proposals_run_and_are_not_repeated(shop):
    proposed = propose.propose_checks(shop)
    rows = proposed.collect()
    kinds = {r["kind"] for r in rows}
    assert kinds == {"references", "unique", "row_predicate"}
    texts = {r["title"] for r in rows}
    rule = next(r for r in rows if r["title"] == "when place is 1 then \"rating\" >= 0")
    assert rule["expression"] == "string(\"place\") <> '1' OR \"rating\" >= 0"
    assert "every orders.buyer exists in customers" in texts and "every customers.customer_id is used in orders" in texts
    asked = checks.normalize_checks(proposed)
    assert asked.count() == len(rows)
    flipped = asked.filter("kind = 'unique'").withColumn("columns", F.reverse("columns"))
    results = evaluate.evaluate_checks(shop, asked).collect()
    assert {r["status"] for r in results} <= {"holds", "falsified"}
    left = propose.not_yet_run(asked, flipped)
    assert left.filter("kind = 'unique'").count() == 0 and left.count() == len(rows) - flipped.count()


def test_many_measures_and_none(spark, monkeypatch, shop):
    df = shop.frame("orders")
    whole = sorted(map(tuple, propose.order_invariants(df).collect()))
    monkeypatch.setattr(propose, "EXPRESSION_BUDGET", 5)
    assert sorted(map(tuple, propose.order_invariants(df).collect())) == whole
    flags = spark.createDataFrame([(True,), (False,)], "b boolean")
    for found in (
        propose.sentinel_counts(flags),
        propose.order_invariants(flags),
        propose.numeric_texts(flags),
        propose.near_bounds(flags, "flags"),
        propose.conditional_rules(flags, [], ["b"]),
        propose.composite_keys(flags, "flags"),
    ):
        assert found.count() == 0
    bare = Catalog.from_frames(spark, {"flags": flags, "empty": df.limit(0)})
    assert propose.propose_checks(bare).count() == 0
    bare.close()


@pytest.fixture(scope="module")
def overlapping(spark):
    """Codes of one large list and of lists that share all, most, half or none of their values with it."""
    def codes(n, start, stray, table):
        sql = f"concat('c', id + {start} + if(id % 100 < {stray}, 1000000, 0)) as code"
        return spark.range(n).selectExpr(sql, f"id * 2 + {start} as number", "cast(null as string) as nothing")

    sizes = {"all": (30_000, 0, 0), "most": (9000, 500, 8), "half": (9000, 0, 50), "none": (9000, 0, 100), "few": (40, 0, 5)}
    frames = {t: codes(*size, t) for t, size in sizes.items()} | {"empty": codes(0, 0, 0, "empty")}
    catalog = Catalog.from_frames(spark, frames)
    yield catalog
    catalog.close()


def test_references_told_from_sketches_are_those_of_all_values(overlapping, shop):
    for catalog in (overlapping, shop):
        every = sorted(map(tuple, propose.reference_candidates(catalog).collect()))
        for share in (0.3, 0.9, 1.0):
            held = sorted(map(tuple, propose.reference_candidates(catalog, min_inclusion=share).collect()))
            assert held == [r for r in every if r[-1] >= share] and held


def test_sketches_rule_out_pairs_before_values_are_grouped(overlapping):
    columns = propose._candidates(overlapping, propose.catalog_stats(overlapping, exact=False))
    pairs = [(c, p) for c in columns for p in columns if c.may_reference(p)]
    left = {(c.table, p.table) for c, p in propose._may_hold(overlapping, pairs, 0.9) if c.name == "code"}
    assert {("most", "all"), ("few", "all")} <= left
    for child, parent in (("half", "all"), ("none", "all"), ("all", "half"), ("most", "few"), ("none", "most")):
        assert (child, parent) not in left


def test_bounds_of_sketches_widen_with_less_overlap():
    def column(i, n):
        return propose._Candidate(i, "t", f"c{i}", "text", "text", n, n, True, None, None, True)

    small, large, huge = column(0, 1000), column(1, 10**6), column(2, 10**12)
    assert propose._least_shared(small, column(3, 1500), 0.9) == pytest.approx(810)
    assert propose._least_shared(small, huge, 0.9) == 0  # a sketch of a million times more values says nothing
    assert 0 < propose._least_shared(large, large, 0.9) < 0.81 * 10**6
    assert 0 < propose._least_shared(huge, large, 0.9) < 0.81 * 10**12  # the child's own sample is whole
