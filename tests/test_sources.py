import json

import pytest
from pyspark.sql import functions as F

from tabproof.functions.files import file_problem, sniff_format
from tabproof.functions.naming import base_table_name, is_safe_table_name
from tabproof.sources import files, naming, readers, sinks
from tabproof.sources.catalog import Catalog, Source, SourceError, load_catalog


def one(spark, column, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


def test_csv_types_and_padding(catalog):
    types = dict(catalog.frame("clients").dtypes)
    assert types["client_id"] == "int" and types["value"] == "double"
    assert types["seen"] == "date" and types["repeat"] == "boolean"
    # a padded key stays text, a plain one is a number
    assert dict(catalog.frame("coded").dtypes)["deal_id"] == "string"
    assert dict(catalog.frame("deals").dtypes)["deal_id"] == "int"
    rows = catalog.frame("clients").orderBy("client_id").collect()
    assert rows[11]["token"] is None and rows[7]["kind"] == "  " and rows[21]["kind"] == " cart"
    assert catalog.warnings == []


def test_csv_without_a_header(spark, tmp_path):
    (tmp_path / "t.csv").write_text("5,x,2021-03-04\n6,y,2021-03-05\n")
    df = readers.read_csv(spark, str(tmp_path / "t.csv"))
    assert df.columns == ["column0", "column1", "column2"] and df.count() == 2
    assert [t for _, t in df.dtypes] == ["int", "string", "date"]
    assert readers.read_csv(spark, str(tmp_path / "t.csv"), header=True, malformed="keep").count() == 1


def test_csv_with_line_breaks_in_quotes(spark, tmp_path):
    (tmp_path / "t.csv").write_text('k,said\n7,"x\ny, z"\n8,"one ""two"""\n')
    rows = readers.read_csv(spark, str(tmp_path / "t.csv")).orderBy("k").collect()
    assert [tuple(r) for r in rows] == [(7, "x\ny, z"), (8, 'one "two"')]


def test_csv_rows_of_other_lengths(spark, tmp_path):
    (tmp_path / "t.csv").write_text("k,v\n1,a\n2\n3,c,d\n")
    with pytest.raises(readers.MalformedRows, match="2 row"):
        readers.read_csv(spark, str(tmp_path / "t.csv"))
    assert readers.read_csv(spark, str(tmp_path / "t.csv"), malformed="keep").count() == 3
    with pytest.raises(SourceError, match="2 row"):
        load_catalog(spark, [Source(str(tmp_path / "t.csv"))])
    kept = load_catalog(spark, [Source(str(tmp_path / "t.csv"), options={"malformed": "keep"})])
    assert kept.row_counts() == {"t": 3}
    kept.close()


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_csv_separators(spark, tmp_path, sep):
    path = tmp_path / "t.csv"
    path.write_text(f"a{sep}b\n1{sep}x\n2{sep}y\n")
    df = readers.read_csv(spark, str(path))
    assert df.columns == ["a", "b"] and df.count() == 2


def test_json_of_all_kinds_in_one_folder(spark, tmp_path):
    (tmp_path / "lines.json").write_text('{"k": 1, "v": "a"}\n{"k": 2, "v": null}\n')
    (tmp_path / "array.json").write_text(json.dumps([{"k": 3, "v": "c"}, {"k": 4, "w": 0.5}], indent=1))
    (tmp_path / "pretty.json").write_text(json.dumps({"k": 5, "v": "e"}, indent=2))
    (tmp_path / "one.json").write_text('{"k": 6}')
    df = readers.read_json(spark, str(tmp_path))
    assert sorted(r["k"] for r in df.collect()) == [1, 2, 3, 4, 5, 6]
    assert {r["k"]: (r["v"], r["w"]) for r in df.collect()}[4] == (None, 0.5)
    (tmp_path / "broken.json").write_text('{"k": 7}\n{"k": \n')
    with pytest.raises(readers.MalformedRows, match="1 record"):
        readers.read_json(spark, str(tmp_path))
    with pytest.raises(readers.MalformedRows, match="1 record"):
        readers.read_json(spark, str(tmp_path), schema=df.schema)


def test_sniffing(spark):
    heads = [b"PAR1abc", b' [{"a":1}]', b"a,b\n1,2\n", b"a\0,b", b"", b"\xef\xbb\xbf{", b"hello", b"x\ty"]
    df = spark.createDataFrame([(i, bytearray(h)) for i, h in enumerate(heads)], "i int, h binary")
    found = [r[0] for r in df.orderBy("i").select(sniff_format(F.col("h"))).collect()]
    assert found == ["parquet", "json", "csv", None, None, "json", None, "csv"]


def test_file_problems(spark):
    good = b"PAR1....PAR1"
    cases = [
        (good, "parquet", None, None),
        (good, "parquet", len(good), None),
        (good, "parquet", len(good) * 2, "short"),
        (good[:8], "parquet", None, "no_footer"),
        (b"PAR1", "parquet", None, "no_footer"),
        (b"id,name\n1,a\n", "parquet", None, "no_header"),
        (b"", "csv", None, "empty"),
        (b"id\n", "csv", None, None),
        (b"id\n", "json", None, None),
    ]
    df = spark.createDataFrame(
        [(i, len(b), bytearray(b[:1024]), bytearray(b[-4:]), f, e) for i, (b, f, e, _) in enumerate(cases)],
        "i int, length bigint, head binary, tail binary, format string, expected bigint",
    )
    problem = file_problem(*[F.col(c) for c in ("length", "head", "tail", "format", "expected")])
    assert [r[0] for r in df.orderBy("i").select(problem).collect()] == [c[3] for c in cases]


def test_directory_audit(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "good"))
    (tmp_path / "files").mkdir()
    for name, data in {
        "a.csv": b"x,y\n1,2\n", "b.json": b"x,y\n1,2\n", "c.parquet": b"PAR1 cut", "d.jsonl": b'{"a":1}\n', "e.bin": b"\0\1",
    }.items():
        (tmp_path / "files" / name).write_bytes(data)
    ends = files.file_ends(spark, str(tmp_path / "files"))
    rows = {r["path"].split("/")[-1]: r for r in files.detect_formats(ends).collect()}
    assert rows["a.csv"]["format"] == "csv" and not rows["a.csv"]["mismatch"]
    assert rows["b.json"]["format"] == "csv" and rows["b.json"]["mismatch"]
    assert rows["d.jsonl"]["format"] == "json" and not rows["d.jsonl"]["mismatch"]
    assert rows["e.bin"]["format"] is None
    missing = ends.select("path").limit(1).select(F.lit("file:/nowhere").alias("path"))
    manifest = ends.select("path").unionByName(missing).withColumn("format", F.lit("parquet")).withColumn(
        "expected_bytes", F.lit(None).cast("bigint"))
    audited = {r["path"].split("/")[-1]: r["problem"] for r in files.audit_files(ends, manifest).collect()}
    assert audited["c.parquet"] == "no_footer" and audited["a.csv"] == "no_header" and audited["nowhere"] == "missing"
    assert not any(r["large"] for r in files.size_warnings(files.list_files(spark, str(tmp_path / "files"))).collect())


def test_base_names(spark):
    labels = {
        "Suppliers (old).csv": "suppliers_old", "part-2.tar.parquet": "part_2_tar", "Ünit prices.json": "nit_prices",
        "log.jsonl.zst": "log", "http://data.host/x/y/Region%2DNames.csv#top": "region_names",
        "https://data.host/nation+codes.parquet?v=3&w=4": "nation_codes", "order.json": "order_tbl",
        "between.parquet": "between_tbl", "7zip.csv": "t_7zip", "__.csv": "t_table", "漢字.csv": "t_table",
    }
    assert one(spark, base_table_name, *labels) == list(labels.values())
    odd = ["a'b`c.csv", "..\\..\\win.ini", "$(rm).json", "9" * 90, "Z" * 200 + ".parquet", "-- x.csv"]
    assert all(one(spark, lambda c: is_safe_table_name(base_table_name(c)), *odd))
    names = ["events", "events_17", "Events", "_events", "ev ents", "ev-ents", "événements", "e" * 65, "events\t"]
    assert one(spark, is_safe_table_name, *names) == [True, True] + [False] * 7


def test_repeated_labels(spark):
    labels = ["parts.json", "Parts.csv", "z.csv", "PARTS.parquet", "z.json"]
    manifest = spark.createDataFrame(list(enumerate(labels)), "position bigint, label string")
    named = [r["table"] for r in naming.assign_table_names(manifest).orderBy("position").collect()]
    assert named == ["parts", "parts_2", "z", "parts_3", "z_2"]


def test_numbering_crosses_slices(spark):
    from tabproof.plans.numbering import number_within

    df = spark.range(1000).selectExpr("id", "if(id % 3 = 0, 'a', if(id % 3 = 1, 'b', null)) as g")
    rows = number_within(df, ["g"], "id", "n", width=7).collect()
    for g in ("a", "b", None):
        mine = sorted((r["id"], r["n"]) for r in rows if r["g"] == g)
        assert [n for _, n in mine] == list(range(1, len(mine) + 1))


def test_catalog_is_all_or_nothing(spark, folder, tmp_path):
    first = load_catalog(spark, [Source(str(folder / "deals.csv"), label="first.csv")])
    assert first.row_counts() == {"first": 12}
    (tmp_path / "broken.parquet").write_bytes(b"PAR1 cut")
    with pytest.raises(SourceError, match="broken.parquet.*incomplete"):
        load_catalog(
            spark,
            [Source(str(folder / "items.csv"), label="second.csv"), Source(str(tmp_path / "broken.parquet"))],
            replaces=first,
        )
    assert spark.catalog.tableExists("first") and not spark.catalog.tableExists("second")
    second = load_catalog(spark, [Source(str(folder / "items.csv"), label="second.csv")], replaces=first)
    assert second.names == ["second"] and not spark.catalog.tableExists("first")
    info = second.inventory().first()
    assert (info["rows"], info["columns"], info["format"]) == (22, 3, "csv") and info["bytes"] > 0
    second.close()


def test_unknown_and_mixed_contents(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"\0\1\2")
    with pytest.raises(SourceError, match="not Parquet"):
        load_catalog(spark, [Source(str(tmp_path / "x.bin"))])
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "mixed"))
    (tmp_path / "mixed" / "more.csv").write_text("id,x\n1,2\n")
    with pytest.raises(SourceError, match="several formats: csv, parquet"):
        load_catalog(spark, [Source(str(tmp_path / "mixed"))])
    (tmp_path / "list.json").write_text("a,b\n1,2\n")
    odd = load_catalog(spark, [Source(str(tmp_path / "list.json"))])
    assert odd.tables[0].format == "csv" and "list.json" in odd.warnings[0]
    odd.close()


def test_the_next_free_name_is_taken(spark, folder):
    deals = str(folder / "deals.csv")
    catalog = load_catalog(spark, [Source(deals, label=x) for x in ("a.csv", "a.csv", "a_2.csv", "a.json")])
    assert catalog.names == ["a", "a_2", "a_2_2", "a_3"]
    catalog.close()


def test_paths_only_the_session_can_open(spark, folder):
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.here.link./in", f"file://{folder}")
    path = "viewfs://here/in/deals.csv"
    ends = files.file_ends(spark, path).first()
    assert bytes(ends["head"]).startswith(b"deal_id,") and bytes(ends["tail"]) == b".25\n"
    catalog = load_catalog(spark, [Source(path, label="far.csv")])
    assert catalog.row_counts() == {"far": 12}
    catalog.close()


def test_audits_take_a_limit(spark, folder):
    listed = files.list_files(spark, str(folder))
    assert [r["large"] for r in files.size_warnings(listed, 0).collect()] == [True] * 4
    assert not any(r["large"] for r in files.size_warnings(listed).collect())


def test_written_run_reads_back(spark, tmp_path):
    df = spark.range(5)
    paths = sinks.write_run({"a": df, "b": df.filter("id > 2")}, str(tmp_path / "run"), "json")
    assert [spark.read.json(p).count() for p in paths] == [5, 2]


def test_catalog_from_frames(spark):
    catalog = Catalog.from_frames(spark, {"numbers": spark.range(3)})
    assert catalog.row_counts() == {"numbers": 3}
    assert [tuple(r) for r in catalog.columns().collect()] == [("numbers", 0, "id", "bigint", "numeric", "numeric")]
    catalog.close()
