import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SECRETS
from tabproof.functions import text as X
from tabproof.functions.types import column_class, common_key_type, type_family
from tabproof.operators import profile as P
from tabproof.operators.propose import composite_keys
from tabproof.operators.profile import profile_table
from tabproof.plans.quantiles import exact_quantiles

AS_OF = dt.datetime(2025, 1, 15)


@pytest.fixture(scope="module")
def clients(catalog):
    rows = P.profile_table(catalog.frame("clients"), "clients", fmt="csv", as_of=AS_OF).collect()
    return {r["name"]: r for r in rows}


def test_classes_and_families():
    cases = [
        (T.LongType(), "numeric", "numeric"), (T.DecimalType(10, 2), "numeric", "numeric"),
        (T.DateType(), "temporal", "temporal"), (T.TimestampNTZType(), "temporal", "temporal"),
        (T.BooleanType(), "boolean", "boolean"), (T.StringType(), "string", "text"),
        (T.ArrayType(T.LongType()), "nested", "other"), (T.BinaryType(), "other", "other"),
        (T.StructType(), "nested", "other"), (T.DayTimeIntervalType(), "other", "other"),
    ]
    for data_type, kind, family in cases:
        assert (column_class(data_type), type_family(data_type)) == (kind, family)
    assert common_key_type(T.LongType(), T.LongType()) is None
    assert common_key_type(T.IntegerType(), T.LongType()) == "bigint"
    assert common_key_type(T.LongType(), T.DoubleType()) == "double"


def test_clients(clients):
    value = clients["value"]["numeric"]
    assert (value["min"], value["max"]) == (-4.25, 35.25)
    assert (value["negative_count"], value["zero_count"], value["non_finite_count"]) == (2, 1, 0)
    seen = clients["seen"]["temporal"]
    assert (seen["epoch_zero_count"], seen["future_count"]) == (2, 1)
    assert seen["min_iso"] == "1970-01-01" and seen["span_days"] == (dt.date(2093, 5, 6) - dt.date(1970, 1, 1)).days
    assert tuple(clients["repeat"]["boolean"]) == (6, 24)
    assert clients["token"]["null_count"] == 2 and clients["kind"]["null_count"] == 0
    kind = clients["kind"]["string"]
    assert (kind["whitespace_only_count"], kind["untrimmed_count"]) == (1, 2)
    assert (clients["kind"]["distinct_count"], kind["distinct_case_insensitive"]) == (7, 6)
    assert clients["client_id"]["is_candidate_key"] and clients["client_id"]["is_exact_key"]
    assert not clients["repeat"]["is_candidate_key"]
    for r in clients.values():
        if r["string"]:
            assert sum(r["string"]["char_class_pct"]) == pytest.approx(100)


def test_no_value_survives(clients):
    text = json.dumps([r.asDict(recursive=True) for r in clients.values()], ensure_ascii=False)
    for secret in SECRETS:
        assert secret not in text
    assert [s["shape"] for s in clients["token"]["string"]["shapes"]] == ["9{5}a", "a{4}99"]


def test_edge_tables(spark):
    schema = "n int, d double, s string, t timestamp_ntz, b boolean, a array<int>, x binary"
    for rows in ([], [(None,) * 7]):
        described = P.profile_table(spark.createDataFrame(rows, schema), "edge").collect()
        assert [r["distinct_count"] for r in described] == [0] * 7
        assert not any(r["is_candidate_key"] for r in described)
        assert {r["null_pct"] for r in described} == ({0.0} if not rows else {100.0})
    one = P.profile_table(spark.createDataFrame([(1, 1.5, "é", None, True, [1], bytearray(b"z"))], schema), "one")
    rows = {r["name"]: r for r in one.collect()}
    assert rows["n"]["is_exact_key"] and rows["n"]["numeric"]["stddev"] is None
    assert rows["s"]["string"]["char_class_pct"]["other"] == 100.0
    assert rows["a"]["distinct_count"] == 0 and rows["x"]["distinct_count"] == 1


def test_non_finite_statistics_are_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (-0.0,), (0.0,)], "d double")
    row = P.profile_table(df, "t").first()
    assert row["numeric"]["non_finite_count"] == 2 and row["numeric"]["max"] is None
    assert row["numeric"]["zero_count"] == 2 and row["distinct_count"] == 4


def test_decimals(spark):
    df = spark.createDataFrame([("7.125",), ("-0.5",), ("-81",), ("19.75",)], "s string").selectExpr("cast(s as decimal(12,3)) fee")
    stats = P.profile_table(df, "t").first()["numeric"]
    assert (stats["min"], stats["max"], stats["negative_count"]) == (-81.0, 19.75, 2)


def test_masks_and_runs(spark):
    texts = ["Qz4_ñ鳥", "zzzz-11111/bbbbb:cc", "k" * 75, "", "५Ǆǅ§"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string").orderBy("i")
    rows = df.select(
        F.expr(X.format_mask("s")), F.expr(X.collapse_runs("s")), F.expr(X.collapse_runs(X.format_mask("s"))), F.expr(X.format_mask("s", 3))
    ).collect()
    assert rows[0][0] == "Aa9_aa" and rows[1][1] == "z{4}-1{5}/b{5}:cc"
    assert rows[2][2] == "a{75}" and rows[2][3] == "aaa" and rows[3][0] == "" and rows[3][1] == ""
    assert rows[4][0] == "9Aaa"
    short = spark.createDataFrame([("xx7:x",)], "s string").select(F.expr(X.collapse_runs("s"))).first()
    assert short[0] == "xx7:x"


def test_a_defect_late_in_a_text_is_seen(spark):
    df = spark.createDataFrame([("a" * 60,)] * 30 + [("a" * 50 + "7" + "a" * 9,)], "s string")
    shapes = [r["shape"] for r in P.shape_histogram(df).orderBy("rank").collect()]
    assert shapes == ["a{60}", "a{50}9a{9}"]


def test_class_counts_agree_for_short_and_long_texts(spark):
    piece = "aZ9 \t\n!~é森0"
    df = spark.createDataFrame([(piece,), (piece * 20,)], "s string")
    counts = df.select(*[F.expr(v).alias(k) for k, v in X.class_lengths("s").items()]).collect()
    assert tuple(counts[0]) == (11, 2, 2, 3, 2)
    assert tuple(counts[1]) == tuple(20 * v for v in counts[0])


def test_trim_rules(spark):
    texts = ["", " ", "　 ", "a", " a", "a ", "a\t", "\n", "a b"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    rows = df.select(F.expr(X.is_blank("s")), F.expr(X.is_untrimmed("s"))).collect()
    assert [r[0] for r in rows] == [t in (" ", "　 ") for t in texts]
    assert [r[1] for r in rows] == [t in (" ", "　 ", " a", "a ") for t in texts]


def test_shape_histogram_keeps_the_top_and_one_pass(spark):
    df = spark.range(2000).selectExpr(
        "if(id % 3 = 0, 'hot', concat(repeat('a', int(id % 30)), '-', id)) as s", "string(id) as t"
    )
    found = P.shape_histogram(df).collect()
    by = {}
    for (s, t) in df.collect():
        for o, v in ((0, s), (1, t)):
            m = "".join("9" if c.isdigit() else "a" if c.islower() else c for c in v)
            by.setdefault(o, {}).setdefault(m, 0)
            by[o][m] += 1
    for o in (0, 1):
        want = sorted(by[o].items(), key=lambda kv: (-kv[1], kv[0]))[:8]
        got = sorted((r for r in found if r["ordinal"] == o), key=lambda r: r["rank"])
        assert [r["n"] for r in got] == [n for _, n in want]
    plan = P.shape_histogram(df)._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2  # kept inside tasks before the shuffle


def test_long_texts_are_grouped_by_digest(spark):
    long = "x" * 100
    df = spark.createDataFrame([(long + "a",), (long + "b",), (long + "a",), ("#short",), (None,)], "s string")
    row = P.profile_table(df, "t").first()
    assert row["distinct_count"] == 3


def test_shape_leaks_and_publishing(spark):
    df = spark.createDataFrame([("a\tb",), ("a\tb",), ("ab",)], "s string")
    described = P.profile_table(df, "t").withColumn("secret", F.lit("x"))
    assert [r["problem"] for r in P.shape_leaks(described).collect()] == ["unmasked characters"]
    published = P.publish_profile(described)
    assert "secret" not in published.columns
    assert [s["shape"] for s in published.first()["string"]["shapes"]] == ["aa"]
    with pytest.raises(P.RedactionError):
        P.publish_profile(described, strict=True)


def test_chunks_do_not_change_the_profile(spark, monkeypatch):
    df = spark.range(50).selectExpr("id", "id * 2 as b", "string(id) as c", "id % 2 = 0 as d")
    whole = sorted(map(str, P.profile_table(df, "t", fmt="csv").collect()))
    monkeypatch.setattr(P, "EXPRESSION_BUDGET", 5)
    assert sorted(map(str, P.profile_table(df, "t", fmt="csv").collect())) == whole
    specs = P.column_specs(df)
    assert [len(c) for c in P.chunk_columns(specs, [3, 3, 9, 1], budget=6)] == [2, 1, 1]


def test_sketches_are_asked_for(spark):
    df = spark.range(20_000).selectExpr("id", "id % 100 as small", "concat('u', id % 5000) as s")
    rows = {r["name"]: r for r in P.profile_table(df, "t", exact=False).collect()}
    assert rows["id"]["distinct_count"] == 20_000  # as high as a key's, so it is counted
    assert rows["small"]["distinct_count"] == pytest.approx(100, rel=0.05)
    assert rows["s"]["distinct_count"] == pytest.approx(5000, rel=0.05)
    exact = {r["name"]: r for r in P.profile_table(df, "t").collect()}
    assert [exact[c]["distinct_count"] for c in ("id", "small", "s")] == [20_000, 100, 5000]
    assert exact["id"]["numeric"]["p25"] == pytest.approx(4999.75)


@pytest.mark.parametrize("exact", [True, False])
def test_keys_of_long_tables(spark, exact):
    keys = [f"xxhash64(id, {i}) as k{i}" for i in range(8)]
    df = spark.range(300_000).selectExpr(*keys, "id % 297000 as near", "if(id = 5, 6, id) as almost", "id % 1000 as few")
    rows = {r["name"]: r for r in P.profile_table(df, "t", exact=exact, shapes=False).collect()}
    assert all(rows[f"k{i}"]["is_exact_key"] and rows[f"k{i}"]["is_candidate_key"] for i in range(8))
    assert [(rows[c]["is_candidate_key"], rows[c]["is_exact_key"]) for c in ("near", "almost", "few")] == [(True, False), (True, False), (False, False)]
    if exact:
        found = composite_keys(df.select("k0", "few", "near"), "t").collect()
        assert found == []  # whatever holds k0 is no smallest key
        pair = spark.range(300_000).selectExpr("id % 600 as a", "id div 600 as b", "id % 7 as c")
        assert [r["columns"] for r in composite_keys(pair, "t").collect()] == [["a", "b"]]


def test_nan_is_the_largest_value_either_way(spark):
    df = spark.range(1000).selectExpr("if(id < 400, double('NaN'), double(id)) as d")
    for exact in (True, False):
        stats = P.profile_table(df, "t", exact=exact).first()["numeric"]
        assert stats["p75"] is None and stats["p25"] == pytest.approx(650, abs=10)


def test_class_counts_of_long_texts_are_exact(spark):
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(list("abcXYZ019 .,;!?\t\né鳥"), 5000))
    df = spark.createDataFrame([(text,)], "s string")
    counts = df.select(*[F.expr(v).alias(k) for k, v in X.class_lengths("s").items()]).first()
    assert tuple(counts) == (
        5000, sum(c in "abcXYZ" for c in text), sum(c in "019" for c in text), sum(c in " \t\n" for c in text), sum(c in ".,;!?" for c in text),
    )


@pytest.mark.parametrize("accuracy,inside", [(20, 10), (100, 500), (10_000, 100_000)])
def test_exact_quantiles_with_hot_values(spark, accuracy, inside):
    rng = np.random.default_rng(7)
    values = np.concatenate([rng.normal(size=3000), np.full(3000, 0.25), rng.integers(0, 5, 3000)])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(5)
    probabilities = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    found = exact_quantiles(df, {0: "v", 1: "-v"}, probabilities, accuracy=accuracy, max_inside=inside)
    assert found[0] == pytest.approx(list(np.quantile(values, probabilities)))
    assert found[1] == pytest.approx(list(np.quantile(-values, probabilities)))


def test_exact_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None, 1)], "v double, w int")
    assert exact_quantiles(df, {0: "v", 1: "w"}, [0.5]) == {0: [None], 1: [1.0]}


def test_summary_and_rollup(catalog):
    described = P.profile_table(catalog.frame("clients"), "clients", fmt="csv", as_of=AS_OF)
    lines = {r[0]: r[1] for r in described.select("name", P.column_summary()).collect()}
    assert lines["repeat"] == "6 true · 24 false"
    assert lines["value"] == "-4.25 … 35.25 · 2 negative · 1 zero"
    assert lines["seen"] == "1970-01-01 … 2093-05-06 · 1 future · 2 at epoch"
    roll = P.profile_rollup(described).first()
    assert (roll["row_count"], roll["column_count"], roll["sparse"]) == (30, 6, False)


def test_sketches_agree_with_exact_statistics(spark):
    df = spark.range(0, 9000, 1, 7).selectExpr(
        "id", "if(id % 10 = 0, null, 1e9 + id * 0.5) as d", "concat('v', id % 900) as s",
        "cast(null as double) as gone", "timestamp_ntz'2024-01-01' + make_dt_interval(0, int(id)) as t",
    )
    found = {r["name"]: r for r in P.profile_table(df, "t", exact=False).collect()}
    exact = {r["name"]: r for r in P.profile_table(df, "t").collect()}
    for name, row in found.items():
        assert row["null_count"] == exact[name]["null_count"]
        assert row["distinct_count"] == pytest.approx(exact[name]["distinct_count"], rel=0.06)
        assert row["temporal"] == exact[name]["temporal"]
        if exact[name]["numeric"]:
            want = exact[name]["numeric"]
            for stat in ("min", "max", "avg", "stddev", "p01", "p25", "p50", "p75", "p99"):
                if want[stat] is None:
                    assert row["numeric"][stat] is None
                elif stat.startswith("p"):
                    assert abs(row["numeric"][stat] - want[stat]) <= 0.01 * (want["max"] - want["min"])
                else:
                    assert row["numeric"][stat] == pytest.approx(want[stat], rel=1e-9)
    assert P.profile_table(df.limit(0), "t", exact=False).select(F.sum("row_count")).first()[0] == 0


def test_a_profile_scans_its_table_a_bounded_number_of_times(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    rows = [(i, i % 7 * 1.5, f"t{i % 40}", None if i % 9 else i) for i in range(2000)]
    df = spark.createDataFrame(rows, "i long, x double, s string, y int")
    plans = []

    def seen(frame):
        plans.append(frame._jdf.queryExecution().optimizedPlan().toString())

    collect = Classic.collect
    monkeypatch.setattr(Classic, "collect", lambda self: (seen(self), collect(self))[1])
    profile_table(df, "t").collect()
    # Bounds, then values (both uses of one shuffle), then statistics of numbers, of texts, and shapes.
    assert len([p for p in plans if "kll_sketch_agg" in p]) == 1
    assert len(plans) <= 4


def test_value_statistics_with_ranges_off_the_mark(spark, monkeypatch):
    from tabproof.plans import quantiles

    rng = np.random.default_rng(3)
    values = rng.integers(-50, 50, 4000) * 0.5
    df = spark.createDataFrame([(float(v), None if v > 20 else f"s{v}") for v in values], "v double, s string").repartition(4)
    bounded = quantiles._bounded

    def off(df, columns, accuracy):
        bounded(df, columns, accuracy)
        for c in columns:
            for t in c.targets:
                t.low = t.high = 999.0

    monkeypatch.setattr(quantiles, "_bounded", off)
    keys = {0: ("xxhash64(v)", "0L"), 5: ("if(s is null, null, xxhash64(s))", "xxhash64(1L, s)")}
    counts, found = quantiles.value_statistics(df, keys, {0: ("v", [0.1, 0.5]), 9: ("length(s)", [0.5])})
    assert counts == {0: len(set(values)), 5: len({v for v in values if v <= 20})}
    assert found[0] == pytest.approx(list(np.quantile(values, [0.1, 0.5])))
    assert found[9] == [np.median([len(f"s{float(v)}") for v in values if v <= 20])]


@pytest.mark.parametrize("n", [0, 1, 50, 2999, 3000, 9999])
def test_a_sample_has_so_many_rows_whatever_the_partitions(spark, n):
    df = spark.range(3000).selectExpr("id", "if(id % 3 = 0, null, concat('t', id % 100)) as s")
    some = sorted(tuple(r) for r in P.sample_rows(df.repartition(7), n).collect())
    assert len(some) == min(n, 3000)
    assert some == sorted(tuple(r) for r in P.sample_rows(df.coalesce(1), n).collect())
    assert len(P.sample_rows(df, n, ["s"]).collect()) == min(n, 3000)


def test_groups_of_values_are_read_once(spark, monkeypatch):
    from tabproof.plans import quantiles as Q

    seen, keep = [], Q.saved
    monkeypatch.setattr(Q, "saved", lambda df: seen.append(keep(df)) or seen[-1])
    df = spark.range(50_000).selectExpr("double(id) as v")
    found = Q.exact_quantiles(df, {0: "v"}, [0.25, 0.5])
    assert found == {0: [12499.75, 24999.5]}
    assert len(seen) == 1 and seen[0].count() < 10_000  # values in the ranges and one row for each part, not all 50,000


def test_ranks_beside_each_other_are_narrowed_once(spark, monkeypatch):
    from tabproof.plans import quantiles as Q
    from tabproof.plans import sketches as S

    asked, aggregate = [], S.aggregate
    monkeypatch.setattr(S, "aggregate", lambda df, stats: asked.append(list(stats)) or aggregate(df, stats))
    df = spark.range(20_000).selectExpr("double(id) as v")
    assert Q.exact_quantiles(df, {0: "v"}, [0.5], accuracy=50, max_inside=100) == {0: [9999.5]}
    assert len(asked) > 1 and sum(name.startswith("g") for name in asked[1]) == 1


def test_sketches_and_plain_aggregates_have_scans_of_their_own(spark):
    from tabproof.plans import sketches as S

    df = spark.range(1000).selectExpr("id % 40 as v")
    stats = {"ndv": S.distinct(["v"]), "n": S.plain("count(v)"), "mid": S.quantiles("v", [0.5]), "avg": S.mean("v")}
    found = S.aggregate(df, stats)
    assert found.columns == list(stats) and found.first().asDict() == {"ndv": 40, "n": 1000, "mid": [19.0], "avg": 19.5}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not any("_sketch_agg" in line and "avg(" in line for line in plan.splitlines())
