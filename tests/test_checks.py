import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import SECRETS
from tabproof.functions import guard
from tabproof.operators import checks, console, evaluate, findings, summary
from tabproof.operators.admission import admit_checks
from tabproof.sources.catalog import Catalog

#: One line each of what a predicate may be made of: lambdas, collections, intervals, nested calls, and quoting.
GOOD = [
    "forall(transform(sequence(1, 3), i -> i * p_size), s -> s > 0)", "aggregate(array(l_tax, l_discount), 0D, (a, x) -> a + x) < 1",
    "element_at(map('a', 1, 'b', 2), 'b') = 2", "named_struct('x', l_tax).x >= 0", "split(p_type, ' ')[2] <> ''",
    "l_shipdate - INTERVAL '3' MONTH < DATE '2030-01-01'", "make_interval(0, 1) IS NOT NULL",
    "try_divide(l_extendedprice, l_quantity) < 1e6", "try_element_at(array(1, 2), 9) IS NULL", "coalesce(try_cast(p_name AS INT), 0) = 0",
    "(((p_size % 7) + 7) % 7) <> -1", "l_tax <=> NULL OR NOT l_tax <=> NULL", "l_quantity NOT BETWEEN -5 AND -1",
    "p_name NOT LIKE '%(%'", "concat('a;b', p_name) <> '-- no comment'", "`order` % 2 = 0 AND \"select\" > 1", "length('/* in quotes */') = 15",
]
#: A literal that seems to open inside a quoted name, and one that seems to close there.
HIDDEN = """exists(array(1), "q'" -> true) AND (SELECT count(*) FROM nation) > 5 AND exists(array(1), "q'" -> true)"""
BAD = {
    "(select min(o_custkey) from orders) = o_custkey": "select",
    HIDDEN: "select",
    "o_totalprice < 5 union all values (2)": "union",
    "read_json('/data/' || o_orderstatus) is null": "external data",
    "orders_scan(o_orderkey) > 0": "external data",
    "o_orderkey > 0; vacuum": "separator",
    "o_orderkey > 0 -- and so on": "marker",
    "o_orderkey /* all */ > 0": "marker",
    "$$a$$ <> o_orderstatus": "marker",
    "current_setting(o_orderstatus) <> ''": "current_setting",
    "java_method('java.lang.Runtime', 'getRuntime') is null": "java_method",
    r"o_orderstatus = 'F\' or rand() > 0": "Backslash",
    "\t\n": "Empty",
    "o_custkey + " * 90 + "1 > 0": "longer",
    "((o_custkey > 0)": "Unbalanced",
    "o_custkey > 0))": "Unbalanced",
    "o_custkey) = (1": "Unbalanced",
    "o_orderstatus = 'F": "Unclosed",
    '"o_orderstatus = 1': "Unclosed",
}


def reasons(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, e string")
    return [r[0] for r in df.orderBy("i").select(guard.expression_reason(F.col("e"))).collect()]


def test_good_expressions(spark):
    assert reasons(spark, GOOD) == [None] * len(GOOD)


def test_refused_expressions(spark):
    for text, reason in zip(BAD, reasons(spark, BAD)):
        assert reason and BAD[text].lower() in reason.lower(), text


def test_long_unclosed_texts_are_scanned_without_trouble(spark):
    texts = ["'" + "a''" * 300, '"' * 999, "(" * 500 + ")" * 500, "a " * 100_000]
    found = reasons(spark, texts)
    assert "Unclosed" in found[1] and found[2] is None and "longer" in found[3]


def test_requoting():
    assert guard.spark_expression('"Order Date" > 0') == "`Order Date` > 0"
    assert guard.spark_expression('"we""ird`" = \'a"b\'') == "`we\"ird``` = 'a\"b'"
    assert guard.spark_expression(r"regexp_like(c, '^\d+$')") == r"regexp_like(c, r'^\d+$')"
    assert guard.spark_expression(r"c = 'it''s \d'") == r"c = 'it''s \\d'"


def run(catalog, *listed):
    wire = checks.checks_frame(catalog.spark, listed)
    rows = evaluate.evaluate_checks(catalog, checks.normalize_checks(wire)).collect()
    assert len(rows) == len(listed)
    return [next(r for r in rows if r["id"] == f"h{i + 1}") for i in range(len(listed))]


def ref(table, columns, parent, parent_columns):
    return dict(kind="references", table=table, columns=columns, references_table=parent, references_columns=parent_columns)


def test_predicates(catalog):
    found = run(
        catalog,
        dict(table="clients", expression="client_id >= 0"),
        dict(table="clients", expression="value >= 0"),
        dict(table="clients", expression="length(token) = 6"),
        dict(table="clients", expression="no_such_column > 0"),
        dict(table="clients", expression="read_csv(token) IS NOT NULL"),
        dict(table="strangers", expression="1 = 1"),
    )
    assert [r["status"] for r in found] == ["holds", "falsified", "holds", "skipped", "skipped", "skipped"]
    assert (found[1]["violations"], found[1]["row_count"]) == (2, 30)
    assert found[1]["pct"] == pytest.approx(200 / 30) and "FROM clients" in found[1]["sql"]
    assert "no_such_column" in found[3]["reason"]
    assert "external data" in found[4]["reason"] and "Unknown table" in found[5]["reason"]


def test_plans_are_inspected_before_they_run(spark, catalog):
    spark.udf.register("twice", lambda x: x * 2, "int")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION thrice(x INT) RETURNS BIGINT RETURN x + (SELECT max(id) FROM range(3))")
    found = run(
        catalog,
        dict(table="clients", expression="twice(client_id) >= 0"),
        dict(table="clients", expression="thrice(client_id) >= 0"),
        dict(table="clients", expression=HIDDEN),
        dict(table="clients", expression="strftime(seen, 'year %Y') <> 'year 1999'"),
        dict(table="clients", expression="regexp_matches(token, '^[0-9ζ]')"),
        dict(table="clients", expression="strftime(seen, '%Q') <> ''"),
    )
    assert [r["status"] for r in found] == ["skipped", "skipped", "skipped", "holds", "holds", "skipped"]
    assert all("not allowed" in r["reason"] for r in found[:3])
    df = catalog.frame("clients")
    for text in ("(SELECT count(*) FROM deals) > 0", "exists(SELECT 1 FROM deals)", "rand() < 2", "reflect('java.lang.Math', 'random') > 0"):
        assert "not allowed" in evaluate.predicate_reason(df, text)


def test_equal_ids_and_quotes_in_ids(spark):
    catalog = Catalog.from_frames(spark, {"t": spark.range(10)})
    asked = spark.createDataFrame(
        [(i, "row_predicate", "t", [], e, "", []) for i, e in (("same", "id > 3"), ("same", "id > 8"), ("it's", "id < 5"), ("", "id >= 0"))],
        "id string, kind string, table string, columns array<string>, expression string, references_table string, references_columns array<string>",
    )
    found = sorted((r["id"], r["violations"]) for r in evaluate.evaluate_checks(catalog, asked).collect())
    assert found == [("", 0), ("it's", 5), ("same", 4), ("same", 9)]
    catalog.close()


def test_errors_of_files_are_raised(spark, tmp_path):
    spark.range(100).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    catalog = Catalog.from_frames(spark, {"t": df})
    for file in (tmp_path / "t").glob("*.parquet"):
        file.write_bytes(b"PAR1 gone PAR1")
    with pytest.raises(Exception, match="(?i)parquet|read"):
        run(catalog, dict(table="t", expression="id >= 0"), dict(table="t", expression="id <> 5"))
    catalog.close()


def test_more_predicates_than_one_aggregate_takes(spark):
    catalog = Catalog.from_frames(spark, {"t": spark.range(50)})
    found = run(catalog, *[dict(table="t", expression=f"id <> {i % 50} OR id > {i}") for i in range(400)])
    assert all(r["violations"] == 1 for r in found[:50]) and len(found) == 400
    catalog.close()


def test_uniqueness(catalog):
    found = run(
        catalog,
        dict(kind="unique", table="clients", columns=["token", "repeat"]),
        dict(kind="unique", table="clients", columns=["client_id"]),
        dict(kind="unique", table="clients", columns=["nope"]),
        dict(kind="unique", table="clients", columns=["repeat", "token"]),
    )
    assert [(r["status"], r["violations"]) for r in found] == [
        ("falsified", 4), ("holds", 0), ("skipped", None), ("falsified", 4)]


def test_null_keys_repeat(spark):
    catalog = Catalog.from_frames(spark, {"t": spark.createDataFrame([(None,), (None,), (1,)], "k int")})
    assert run(catalog, dict(kind="unique", table="t", columns=["k"]))[0]["violations"] == 2
    assert evaluate.duplicate_rows(catalog.frame("t"), ["k"]).count() == 2
    assert evaluate.duplicate_rows(catalog.frame("t"), ["k"], limit=1).count() == 1
    catalog.close()


def test_references(catalog):
    found = run(
        catalog,
        ref("items", ["deal_id"], "deals", ["deal_id"]),
        ref("deals", ["deal_id"], "items", ["deal_id"]),
        ref("deals", ["client_id"], "clients", ["client_id"]),
        ref("items", ["deal_id"], "nowhere", ["deal_id"]),
        ref("coded", ["deal_id"], "deals", ["deal_id"]),
        ref("coded", ["item_id"], "items", ["item_id"]),
        ref("deals", ["total"], "items", ["pieces"]),
    )
    assert [(r["status"], r["violations"]) for r in found[:3]] == [("falsified", 2), ("falsified", 1), ("holds", 0)]
    assert found[0]["row_count"] == 22 and "NOT EXISTS" in found[0]["sql"]
    assert found[3]["status"] == "skipped"
    assert "types differ" in found[4]["reason"] and "string" in found[4]["reason"] and "int" in found[4]["reason"]
    assert not set("'\"") & set(found[4]["reason"])
    assert found[5]["status"] == "holds"
    assert found[6]["violations"] == 12  # double against int


def test_text_compared_with_a_number_is_refused(catalog):
    found = run(
        catalog,
        dict(table="coded", expression="deal_id > 0"),
        dict(table="coded", expression="try_cast(deal_id AS BIGINT) > 0"),
        dict(table="coded", expression="deal_id > '0'"),
        dict(table="clients", expression="seen >= '1970-01-01'"),
    )
    assert "Cannot compare" in found[0]["reason"] and "0042" not in found[0]["reason"]
    assert [r["status"] for r in found] == ["skipped", "holds", "holds", "holds"]


def test_mismatched_key_lengths_are_dropped_as_malformed(spark, catalog):
    wire = checks.checks_frame(spark, [
        ref("items", ["deal_id"], "deals", ["deal_id", "total"]),
        dict(table="  ", expression="1 = 1"), dict(table="items", expression="  "),
        dict(kind="unique", table="items"), dict(kind="mystery", table="items", expression="1 = 1"),
        dict(table=" items ", expression=" pieces > 0 ", title=" t "),
    ])
    kept = checks.normalize_checks(wire).collect()
    assert [(r["id"], r["table"], r["expression"], r["title"]) for r in kept] == [("h6", "items", "pieces > 0", "t")]
    direct = wire.filter("kind = 'references'").withColumn("id", F.lit("x"))
    assert "counts differ" in admit_checks(direct, catalog.schemas()).first()["reason"]


def test_a_bad_check_never_hurts_the_batch(spark):
    df = spark.range(100).selectExpr("id", "string(id) as s", "if(id = 7, 'x', string(id)) as t")
    catalog = Catalog.from_frames(spark, {"a": df, "b": df})
    listed = [dict(table="ab"[i % 2], expression=f"id <> {i}") for i in range(20)]
    listed[3] = dict(table="a", expression="CAST(t AS BIGINT) >= 0")
    listed[8] = dict(table="b", expression="id / (id - 5) >= 0")
    listed[9] = dict(table="b", expression="id / (id - 5) >= 0")
    listed[15] = dict(table="a", expression="nothing > 0")
    found = run(catalog, *listed)
    assert {i for i, r in enumerate(found) if r["status"] == "skipped"} == {3, 8, 9, 15}
    assert all(r["violations"] == 1 for i, r in enumerate(found) if i not in (3, 8, 9, 15))
    assert "CAST_INVALID_INPUT" in found[3]["reason"] and "DIVIDE_BY_ZERO" in found[8]["reason"]
    catalog.close()


def test_keys_spark_cannot_group_are_skipped(spark):
    df = spark.range(3).selectExpr("id", "parse_json('1') as v", "'x' as s", "double(id) as d", "cast(id as decimal(38,0)) as big")
    catalog = Catalog.from_frames(spark, {"t": df})
    found = run(
        catalog,
        dict(kind="unique", table="t", columns=["v"]),
        dict(kind="unique", table="t", columns=["s"]),
        ref("t", ["big"], "t", ["d"]),
        ref("t", ["id"], "t", ["big"]),
    )
    assert [(r["status"], r["violations"]) for r in found] == [("skipped", None), ("falsified", 3), ("holds", 0), ("holds", 0)]
    catalog.close()


def test_one_job_counts_many_predicates(spark):
    catalog = Catalog.from_frames(spark, {"t": spark.range(100)})
    asked = [evaluate._Asked(i, checks.Check("c", "row_predicate", "t", expression=f"id < {i}")) for i in range(30)]
    spark.sparkContext.setJobGroup("fused", "")
    out = {}
    evaluate._count_predicates(catalog, asked, out)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("fused")
    spark.sparkContext._jsc.clearJobGroup()
    assert [out[i].violations for i in range(30)] == [100 - i for i in range(30)]
    assert len(jobs) <= 2  # one query; adaptive execution runs its last stage as a job of its own
    catalog.close()


def test_empty_and_single_batches(catalog):
    assert evaluate.evaluate_checks(catalog, checks.normalize_checks(checks.checks_frame(catalog.spark, []))).count() == 0
    assert run(catalog, dict(table="clients", expression="client_id >= 0"))[0]["status"] == "holds"


@pytest.fixture(scope="module")
def skewed(spark):
    # key 1 holds a third of the child's rows and has no parent; key 2 another third and has one
    child = spark.range(30_000).selectExpr("id", "if(id % 3 = 0, 1, if(id % 3 = 1, 2, int(id))) as k")
    parent = spark.range(0, 30_000, 2).selectExpr("int(id) as p").filter("p <> 1")
    return child, parent


def test_rows_of_hot_keys_are_complete(skewed):
    child, parent = skewed
    pandas, keys = child.toPandas(), set(parent.toPandas()["p"])
    want = set(pandas[~pandas["k"].isin(keys)]["id"])
    rows = evaluate.orphan_rows(child, ["k"], parent, ["p"])
    assert {r["id"] for r in rows.collect()} == want and rows.count() == len(want)
    assert evaluate.reference_violations(child, ["k"], parent, ["p"]).first()[0] == len(want)
    first = evaluate.orphan_rows(child, ["k"], parent, ["p"], limit=200).collect()
    ordered = pandas[pandas["id"].isin(want)].sort_values(["k", "id"])[["id", "k"]].head(200)
    assert [tuple(r) for r in first] == [tuple(map(int, r)) for r in ordered.values]
    sizes = pandas.groupby("k")["id"].transform("size")
    assert evaluate.duplicate_rows(child, ["k"]).count() == int((sizes > 1).sum())


def test_hot_rows_stay_where_they_are(skewed):
    child, parent = skewed
    plan = evaluate.orphan_rows(child, ["k"], parent, ["p"], total_rows=30_000)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "NestedLoop" not in text and "CartesianProduct" not in text


def test_previews(catalog):
    check = checks.Check("x", "references", "items", ("deal_id",), "", "deals", ("deal_id",))
    assert [r["item_id"] for r in evaluate.violating_rows(catalog, check).collect()] == [21, 22]
    check = checks.Check("x", "row_predicate", "clients", expression="value >= 0")
    assert evaluate.violating_rows(catalog, check).columns == catalog.frame("clients").columns
    check = checks.Check("x", "row_predicate", "clients", expression="client_id < 0")
    first = evaluate.violating_rows(catalog, check, limit=3)
    assert [r["client_id"] for r in first.collect()] == [7, 21, 22]  # by the columns in order, kind first
    check = checks.Check("x", "unique", "clients", ("token", "repeat"))
    assert sorted(r["client_id"] for r in evaluate.violating_rows(catalog, check, None).collect()) == [3, 11, 12, 24]


def test_previews_of_columns_without_an_order(spark):
    df = spark.range(6).selectExpr("id % 2 as k", "map('a', id) as m", "parse_json(string(id)) as v", "array(map(1, id)) as a", "-id as n")
    catalog = Catalog.from_frames(spark, {"t": df})
    check = checks.Check("x", "unique", "t", ("k",))
    assert [r["n"] for r in evaluate.violating_rows(catalog, check, limit=3).collect()] == [-4, -2, 0]
    check = checks.Check("x", "row_predicate", "t", expression="k > 5")
    assert [r["n"] for r in evaluate.violating_rows(catalog, check, limit=2).collect()] == [-4, -2]
    catalog.close()


def test_predicate_filter_on_a_stream(spark, tmp_path):
    spark.range(20).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id bigint").parquet(str(tmp_path / "in"))
    bad = evaluate.predicate_rows(stream, "nullif(id, 3) < 15")
    query = bad.writeStream.format("memory").queryName("bad_rows").option(
        "checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r["id"] for r in spark.table("bad_rows").collect()) == [15, 16, 17, 18, 19]


# ------------------------------------------------------- findings and rounds


def notes(spark, known, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, r string")
    return [r[0] for r in df.orderBy("i").select(findings.sanitize_note(F.col("r"), known)).collect()]


KNOWN = ["clients", "deal_id", "items", "token", "value"]


def test_notes_carry_no_values(spark):
    leaky = [
        f"[CAST_INVALID_INPUT] The value '{secret}' of the type \"STRING\" cannot be cast to \"INT\" in value"
        for secret in SECRETS
    ]
    leaky += [f"[DIVIDE_BY_ZERO] Division by zero near `{SECRETS[0]}`", "[UNRESOLVED_COLUMN] " + "y" * 4000]
    for note in notes(spark, KNOWN, *leaky):
        assert len(note) <= 120 and not set("'\"`") & set(note)
        assert not any(s in note for s in SECRETS)


def spark_error(spark, text):
    with pytest.raises(PySparkException) as caught:
        spark.sql(text).collect()
    return evaluate._error_reason(caught.value)


def test_note_categories(spark):
    cases = {
        spark_error(spark, "SELECT l_nothing FROM range(3)"): "unknown column",
        spark_error(spark, "SELECT no_function(id) FROM range(3)"): "unknown function",
        spark_error(spark, "SELECT * FROM no_table_here"): "unknown table",
        spark_error(spark, "SELECT id + FROM range(3)"): "syntax error",
        spark_error(spark, "SELECT CAST(concat('a', id) AS INT) FROM range(3)"): "type mismatch",
        spark_error(spark, "SELECT id / (id - id) FROM range(3)"): "arithmetic error",
        'Unknown table "strangers".': "unknown table",
        'Keyword "union" is not allowed in a row predicate.': "forbidden keyword",
        'Function "java_method" is not allowed.': "forbidden keyword",
        'Identifier "orders_scan" can read external data.': "file or URL access",
        "Statement separator (;) is not allowed.": "separator",
        "Unbalanced parentheses.": "unbalanced",
        "Cannot compare items.pieces (int) with clients.token (string): types differ.": "types differ",
        "Referencing and referenced column counts differ.": "column counts differ",
        "the moon was in the way": "could not be evaluated",
    }
    for text, note in zip(cases, notes(spark, KNOWN, *cases)):
        assert cases[text] in note, text
    named = notes(spark, KNOWN, "[UNRESOLVED_COLUMN] hidden_thing is not in items, items or deal_id")[0]
    assert named == "unknown column (items, deal_id)"


def test_rounds_and_summary(catalog):
    spark = catalog.spark
    first = checks.checks_frame(spark, [
        dict(title="values", table="clients", expression="value >= 0", severity="high"),
        dict(title="ids", table="clients", expression="client_id >= 0"),
        dict(title="cast", table="clients", expression="CAST(kind AS INT) > 0"),
    ])
    second = checks.checks_frame(spark, [dict(title="items", severity="high", **ref("items", ["deal_id"], "deals", ["deal_id"]))])
    runs = summary.run_round(catalog, second, 2, summary.run_round(catalog, first, 1))
    totals = summary.run_totals(runs).first()
    assert (totals["rounds"], totals["checks"], totals["falsified"], totals["held"], totals["not_run"]) == (2, 4, 2, 1, 1)
    assert [r[0] for r in summary.rounds(runs).collect()] == [1, 2]
    assert {r["id"] for r in summary.falsified(runs).collect()} == {"r1h1", "r2h1"}
    details = {r["id"]: r for r in summary.check_details(runs).collect()}
    assert details["r2h1"]["check"] == "items(deal_id) → deals(deal_id)" and details["r2h1"]["cross_table"]
    known = findings.known_identifiers(catalog.columns())
    found = findings.to_findings(runs, known)
    lines = {r[0]: r[1] for r in found.select("id", findings.verdict_line()).collect()}
    assert lines["r1h1"] == "FALSIFIED   values  : 2 rows (6.67%)"
    assert lines["r1h2"] == "HELD        ids  [row_predicate]"
    assert lines["r1h3"].startswith("NOT RUN     cast  : type mismatch")
    assert {"sql", "reason"}.isdisjoint(found.columns)
    assert findings.finding_leaks(found).count() == 0
    with pytest.raises(findings.FindingsLeakError):
        findings.assert_safe(found.withColumn("note", F.lit("Could not convert 'x'")))
    with pytest.raises(ValueError, match="maximum of 3 rounds"):
        summary.run_round(catalog, first, 4)
    starters = console.starter_checks(runs).collect()
    assert len(starters) == 4 and all(spark.sql(r["sql"].replace("coalesce((CAST(kind AS INT) > 0), true)", "true")).count() == 1 for r in starters)


def test_findings_are_shortened_and_none_is_lost(spark):
    df = spark.range(100).selectExpr("int(1 + id % 20) as round", "id as position", "repeat('t', int(if(id = 4, 301, 3))) as title")
    kept = findings.bound_findings(df)
    assert kept.count() == 100 and kept.agg(F.max(F.length("title"))).first()[0] == 300
    few = findings.bound_findings(df, max_findings=2)
    assert {r["count"] for r in few.groupBy("round").count().collect()} == {2}


def test_console(catalog):
    outcome = console.run_sql(catalog, "SELECT deal_id, sum(pieces) AS q FROM items GROUP BY deal_id")
    assert outcome.columns == ["deal_id", "q"] and outcome.row_count == 13 and outcome.ms >= 0
    page = console.page(catalog.frame("clients"), ["client_id"], 1, size=4)
    assert [r["client_id"] for r in page.collect()] == [4, 5, 6, 7]


def test_inventory(catalog):
    rows = {r["table"]: r for r in summary.data_inventory(catalog).collect()}
    assert rows["items"]["column_list"] == "item_id (int), deal_id (int), pieces (int)"
    assert (rows["clients"]["rows"], rows["clients"]["columns"]) == (30, 6)


TOGETHER = [
    "l_quantity > 5 OR l_tax < 0.05", "l_quantity > 0", "l_returnflag > 0", "try_cast(l_returnflag AS INT) > 0", "cast(l_returnflag AS INT) > 0",
    "no_such_column > 1", "sum(l_tax) > 1", "explode(array(1)) > 0", "row_number() OVER (ORDER BY l_tax) > 0", "rand() > 0.5", "l_tax / l_quantity > 0",
    "l_linenumber", "regexp_matches(l_returnflag, '^[A-Z]$')", "(SELECT max(l_tax) FROM lineitem) > 0", "exists(array(l_tax), x -> x > 0)",
    "l_linestatus IN ('O', 'F')", "cast(l_quantity AS INT) > 3", "n0 > 1", "l_shipdate > '1995-01-01'", "length(l_linestatus) = 1", "l_returnflag",
]


def test_predicates_inspected_together_as_alone(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    together = evaluate.inspected_together(df, TOGETHER)
    alone = [evaluate._inspected(df, e) for e in TOGETHER]
    for expression, got, want in zip(TOGETHER, together, alone):
        assert got == want, expression


def test_many_predicates_need_few_analyses(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    alone = []
    slow = evaluate._inspected
    monkeypatch.setattr(evaluate, "_inspected", lambda df, e: (alone.append(e), slow(df, e))[1])
    listed = [f"l_quantity > {i} OR l_tax < 0.0{i % 9}" for i in range(400)] + ["no_column > 0"]
    got = evaluate.inspected_together(df, listed)
    assert got[:400] == [(None, False)] * 400 and "no_column" in got[400][0]
    assert len(alone) <= 2


def test_equal_predicates_are_counted_once_and_reported_each(spark):
    from tabproof.sources.catalog import Catalog

    catalog = Catalog.from_parquet(spark, "/root/testdata/sf0.001", ("lineitem",))
    listed = [dict(table="lineitem", expression=f"l_quantity > {i % 60}") for i in range(130)]
    batch = [evaluate._Asked(i, checks.Check(f"h{i}", "row_predicate", "lineitem", (), d["expression"], "", ())) for i, d in enumerate(listed)]
    assert len(evaluate._predicate_counts(catalog, batch)) == 2
    got = evaluate.evaluate_checks(catalog, checks.normalize_checks(checks.checks_frame(spark, listed))).collect()
    quantities = [r["l_quantity"] for r in catalog.frame("lineitem").select("l_quantity").collect()]
    assert len(got) == 130
    by = {r["id"]: r["violations"] for r in got}
    assert all(by[f"h{i + 1}"] == sum(q <= i % 60 for q in quantities) for i in range(130))


def _scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_bad_keys_are_found_in_one_scan_and_their_rows_in_another(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    rows = evaluate.duplicate_rows(df, ["l_orderkey", "l_linenumber"])
    assert _scans(rows) == 1  # the keys are in the shared folder by now
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    assert _scans(evaluate.orphan_rows(orders, ["o_orderkey"], df, ["l_orderkey"])) == 1


def test_more_keys_than_are_broadcast_give_the_same_rows(spark, skewed):
    from tabproof.plans.keyed_rows import rows_with_keys

    child, _ = skewed
    rows = child.selectExpr("id", "if(k = 2, null, k) as k", "'s' as _salt_", "1 as _hot_")
    keys = rows.groupBy("k").agg(F.count("*").alias("n")).where("n > 1 or k % 5 = 0")
    want = sorted(tuple(r) for r in rows_with_keys(rows, keys, ["k"]).select("id").collect())
    salted = rows_with_keys(rows, keys, ["k"], broadcast_keys=0)
    assert salted.columns == rows.columns
    assert sorted(tuple(r) for r in salted.select("id").collect()) == want and len(want) > 20_000
    text = salted._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "CartesianProduct" not in text
