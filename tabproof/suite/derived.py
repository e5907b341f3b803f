"""Frames derived from the driver tables, as SQL both Spark and DuckDB read.

The driver tables hold few NULLs, bad values or checks, so the queries that need such
rows derive them here, one row or more per row of the source table.
"""

from __future__ import annotations

AS_OF = "2024-06-30 00:00:00"

# events with missing, non-finite, epoch, future, padded and mixed-case values
MESSY = """
SELECT event_id,
       nullif(event_type, 'click') AS kind,
       CASE WHEN user_id % 10 = 0 THEN NULL ELSE value END AS value,
       CASE WHEN event_id % 11 = 0 THEN CAST('NaN' AS DOUBLE)
            WHEN event_id % 13 = 0 THEN CAST('Infinity' AS DOUBLE)
            ELSE value - 5 END AS score,
       CASE WHEN event_id % 17 = 0 THEN DATE '1970-01-01'
            WHEN event_id % 19 = 0 THEN DATE '2099-12-31'
            ELSE CAST(ts AS DATE) END AS day,
       event_id % 3 = 0 AS flag,
       CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN '  '
            WHEN 2 THEN concat(' ', event_type, ' ')
            WHEN 3 THEN upper(event_type) ELSE event_type END AS note,
       CAST(user_id AS DECIMAL(10, 2)) AS price
FROM events
"""

_WIRE = """
SELECT o_orderkey + 1 AS position,
       concat('  check ', o_orderpriority, ' ') AS title,
       concat(' because ', o_orderstatus) AS rationale,
       CASE o_orderstatus WHEN 'F' THEN 'high' WHEN 'O' THEN 'medium' ELSE 'low' END AS severity,
       CASE o_orderkey % 3 WHEN 0 THEN 'row_predicate' WHEN 1 THEN 'unique'
            ELSE 'references' END AS kind,
       CASE o_custkey % 7 WHEN 0 THEN '  ' WHEN 1 THEN 'ghost' ELSE ' orders ' END AS tbl,
       CASE WHEN o_orderkey % 3 = 0 THEN {empty}
            WHEN o_custkey % 6 = 0 THEN {empty}
            WHEN o_custkey % 6 = 1 THEN {list}('o_custkey', 'nope')
            WHEN o_custkey % 6 = 2 THEN {list}('o_orderstatus', 'o_custkey')
            ELSE {list}('o_custkey') END AS cols,
       CASE o_custkey % 9 WHEN 0 THEN '   '
            WHEN 1 THEN concat(' o_totalprice > ', o_custkey, ' ')
            WHEN 2 THEN '(select max(o_custkey) from orders) > 0'
            WHEN 3 THEN concat('o_custkey > 0; drop ', o_orderpriority)
            WHEN 4 THEN concat('read_csv(', chr(39), o_orderpriority, chr(39), ') is null')
            WHEN 5 THEN '(o_custkey > 0'
            WHEN 6 THEN 'o_totalprice /* x */ > 0'
            WHEN 7 THEN concat('o_orderpriority <> ', chr(39), 'select from', chr(39))
            ELSE 'getenv(o_orderpriority) is null' END AS expr,
       CASE o_custkey % 5 WHEN 0 THEN ' ' WHEN 1 THEN 'customer' WHEN 2 THEN 'phantom'
            ELSE 'orders' END AS ref_tbl,
       CASE o_custkey % 4 WHEN 0 THEN {list}('c_custkey') WHEN 1 THEN {list}('c_name')
            WHEN 2 THEN {list}('o_orderkey', 'o_custkey')
            ELSE {list}('o_orderkey') END AS ref_cols
FROM orders
"""

_RUNS = """
SELECT CAST(1 + o_orderkey % 3 AS INT) AS round,
       o_orderkey + 1 AS position,
       concat('r', 1 + o_orderkey % 3, 'h', o_orderkey + 1) AS id,
       concat('check ', o_orderpriority) AS title,
       concat('because ', o_orderstatus) AS rationale,
       CASE o_orderstatus WHEN 'F' THEN 'high' WHEN 'O' THEN 'medium' ELSE 'low' END AS severity,
       CASE o_custkey % 3 WHEN 0 THEN 'row_predicate' WHEN 1 THEN 'unique'
            ELSE 'references' END AS kind,
       'orders' AS tbl,
       CASE WHEN o_custkey % 3 = 0 THEN {empty} ELSE {list}('o_custkey', 'o_orderdate') END AS cols,
       CASE WHEN o_custkey % 3 = 0 THEN concat('o_totalprice > ', o_custkey) ELSE '' END AS expr,
       CASE WHEN o_custkey % 3 = 2 AND o_custkey % 2 = 0 THEN 'customer'
            WHEN o_custkey % 3 = 2 THEN 'orders' ELSE '' END AS ref_tbl,
       CASE WHEN o_custkey % 3 = 2 THEN {list}('c_custkey', 'c_name') ELSE {empty} END AS ref_cols,
       CASE o_orderstatus WHEN 'F' THEN 'falsified' WHEN 'O' THEN 'holds' ELSE 'skipped' END AS status,
       CASE o_orderstatus WHEN 'F' THEN o_custkey + 1 WHEN 'O' THEN 0 END AS violations,
       CASE WHEN o_orderstatus <> 'P' THEN o_custkey * 4 + 4 END AS row_count,
       CASE o_orderstatus WHEN 'F' THEN CAST(25 AS DOUBLE) WHEN 'O' THEN CAST(0 AS DOUBLE) END AS pct,
       CASE WHEN o_orderstatus = 'P' THEN
            CASE o_custkey % 5
                 WHEN 0 THEN concat('Unknown table ', chr(34), o_orderpriority, chr(34), '.')
                 WHEN 1 THEN concat('[CAST_INVALID_INPUT] The value ', chr(39), o_orderpriority,
                                    chr(39), ' of o_custkey cannot be cast')
                 WHEN 2 THEN 'Cannot compare orders.o_custkey (bigint) with customer.c_name (string): types differ.'
                 WHEN 3 THEN 'Statement separator (;) is not allowed.'
                 ELSE concat('[DIVIDE_BY_ZERO] Division by zero in ', o_orderpriority) END
       END AS reason,
       o_orderkey % 100 AS ms,
       concat('SELECT count(*) FROM orders WHERE o_custkey = ', o_custkey) AS sql_text
FROM orders
"""

_SPARK = dict(list="array", empty="cast(array() as array<string>)")
_DUCKDB = dict(list="list_value", empty="CAST([] AS VARCHAR[])")

WIRE_SPARK, WIRE_DUCKDB = _WIRE.format(**_SPARK), _WIRE.format(**_DUCKDB)
RUNS_SPARK, RUNS_DUCKDB = _RUNS.format(**_SPARK), _RUNS.format(**_DUCKDB)

# 20 predicates over lineitem that read the same in both dialects
LINEITEM_PREDICATES = [
    "l_quantity > 0 AND l_quantity <= 50",
    "l_discount BETWEEN 0 AND 1",
    "l_tax BETWEEN 0 AND 0.08",
    "l_quantity < 25",
    "l_extendedprice > 1000",
    "l_extendedprice >= l_quantity * 900",
    "l_linenumber <= 7",
    "l_linenumber < 7 OR l_quantity > 1",
    "l_returnflag IN ('A', 'N', 'R')",
    "l_returnflag <> 'R' OR l_linestatus = 'F'",
    "l_linestatus IN ('O', 'F')",
    "l_shipdate >= l_shipdate",
    "l_suppkey > 0",
    "l_partkey > 0",
    "l_orderkey > 0",
    "nullif(l_linenumber, 3) < 5",
    "CASE WHEN l_discount > 0 THEN l_quantity > 1 ELSE TRUE END",
    "abs(l_tax - l_discount) < 0.1",
    "length(l_returnflag) = 1 AND upper(l_returnflag) = l_returnflag",
    "coalesce(l_discount, 0) <> 0 OR l_tax > 0",
]

KEY_CHECKS = [
    dict(kind="unique", table="lineitem", columns=["l_orderkey"]),
    dict(kind="unique", table="lineitem", columns=["l_orderkey", "l_linenumber"]),
    dict(kind="unique", table="orders", columns=["o_orderkey"]),
    dict(kind="unique", table="documents", columns=["text"]),
    dict(kind="references", table="lineitem", columns=["l_orderkey"],
         references_table="orders", references_columns=["o_orderkey"]),
    dict(kind="references", table="orders", columns=["o_orderkey"],
         references_table="lineitem", references_columns=["l_orderkey"]),
    dict(kind="references", table="orders", columns=["o_custkey"],
         references_table="customer", references_columns=["c_custkey"]),
    dict(kind="references", table="customer", columns=["c_custkey"],
         references_table="orders", references_columns=["o_custkey"]),
]

# checks that must be skipped, each for another reason
BROKEN_CHECKS = [
    dict(table="nowhere", expression="1 = 1"),
    dict(table="orders", expression="no_such_column > 0"),
    dict(table="orders", expression="o_orderpriority > 1"),
    dict(table="orders", expression="(SELECT 1) = 1"),
    dict(table="orders", expression="o_totalprice / (o_custkey - o_custkey) > 1"),
    dict(table="orders", expression="CAST(o_orderpriority AS INT) > 1"),
    dict(kind="references", table="orders", columns=["o_custkey"],
         references_table="customer", references_columns=["c_name"]),
]

# predicate functions: (table, Spark expression, DuckDB expression)
SCALARS = {
    "x01_operators": [
        ("orders", "o_totalprice * 2 - 1 > 1000 AND NOT (o_custkey = 3 OR o_custkey <> o_custkey)", None),
        ("orders", "CASE WHEN o_orderstatus LIKE 'F%' THEN o_totalprice BETWEEN 1000 AND 400000 ELSE o_custkey IN (1, 2, 4) END", None),
    ],
    "x02_text": [
        ("documents", "length(trim(text)) > 100 AND lower(lang) = lang", None),
        ("customer", "upper(c_mktsegment) = c_mktsegment AND length(c_name) = 18", None),
    ],
    "x03_substr_replace": [
        ("orders", "substr(o_orderpriority, 1, 1) < '4'", None),
        ("customer", "regexp_replace(c_name, '[0-9]', '') = 'Customer#'", "regexp_replace(c_name, '[0-9]', '', 'g') = 'Customer#'"),
    ],
    "x04_regexp_matches": [
        ("orders", r"regexp_matches(o_orderpriority, '^\d-(LOW|HIGH)$')", r"regexp_matches(o_orderpriority, '^\d-(LOW|HIGH)$')"),
        ("documents", "regexp_matches(text, '[0-9]{3}-[0-9]{2}')", "regexp_matches(text, '[0-9]{3}-[0-9]{2}')"),
    ],
    "x05_abs_round": [
        ("lineitem", "abs(round(l_extendedprice) - l_extendedprice) < 0.25", None),
        ("customer", "round(c_acctbal) > abs(c_acctbal)", None),
    ],
    "x06_coalesce": [("events", "coalesce(nullif(value, 0), 100) < 50", None)],
    "x07_date_diff": [
        ("orders", "datediff(DATE '2000-01-01', o_orderdate) < 1000", "date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') < 1000"),
        ("events", "datediff(ts, DATE '2024-01-01') < 3", "date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) < 3"),
    ],
    "x08_date_part": [
        ("orders", "date_part('year', o_orderdate) <> 1998", None),
        ("events", "date_part('hour', ts) < 12", None),
    ],
    "x09_strftime": [
        ("orders", "strftime(o_orderdate, '%Y-%m') < '1998-07'", None),
        ("orders", "strftime(o_orderdate, 'day %d, %Y-%m-%dT%H%%') < 'day 16, 1995-01-01T00%'", None),
        ("events", "strftime(ts, '%d.%m.%Y %H:%M') <> '01.01.2024 00:00'", None),
    ],
    "x10_now_cast": [
        ("orders", "o_orderdate < now()", None),
        ("orders", "try_cast(substr(o_orderpriority, 1, 1) AS BIGINT) < 4 AND CAST(o_totalprice AS BIGINT) > 1000", None),
    ],
    "x11_nan_inf": [
        ("messy", "NOT isnan(score)", None),
        ("messy", "isnan(score) OR abs(score) < double('Infinity')", "NOT isinf(score)"),
    ],
    "x12_concatenation": [("orders", "o_orderstatus || '-' || o_orderpriority <> 'F-1-URGENT'", None)],
}

# static schema of the driver tables, for generated oracle SQL
SCHEMA = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "messy": "event_id bigint, kind string, value double, score double, day date, flag boolean, note string, price decimal(10,2)",
}
SCHEMA = {t: [tuple(c.split(" ", 1)) for c in s.replace("(10,2)", "(10;2)").split(", ")] for t, s in SCHEMA.items()}
SCHEMA = {t: [(n, ty.replace(";", ",")) for n, ty in cols] for t, cols in SCHEMA.items()}
