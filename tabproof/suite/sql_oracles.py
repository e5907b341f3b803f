"""The same results as plain DuckDB SQL over the same tables."""

from __future__ import annotations

from itertools import combinations

from tabproof.suite import derived as D

ORACLES: dict[str, str] = {}

# What the admission rules, notes and names are stated in, written down again here.
PARQUET_MAGIC = "PAR1"
MAX_EXPRESSION_LENGTH = 1000
MARKERS = ("--", "/*", "*/", "$$")
KEYWORDS = (
    "select", "from", "where", "join", "union", "intersect", "except", "with", "insert", "update", "delete", "merge",
    "drop", "create", "alter", "truncate", "attach", "detach", "copy", "install", "load", "pragma", "set", "reset",
    "call", "export", "import", "checkpoint", "vacuum", "analyze", "explain", "prepare", "execute", "deallocate",
    "describe", "summarize", "pivot", "unpivot", "grant", "revoke", "begin", "commit", "rollback",
)
REFUSED_FUNCTIONS = (
    "glob", "getenv", "shell", "system", "query", "query_table", "sniff_csv", "sql_auto_complete", "duckdb_settings",
    "duckdb_extensions", "which_secret", "current_setting", "gen_random_uuid_v7", "reflect", "java_method",
    "try_reflect", "raise_error", "assert_true", "input_file_name", "input_file_block_start",
    "input_file_block_length", "current_user", "session_user", "user", "current_catalog", "current_database",
    "current_schema", "version", "spark_partition_id", "monotonically_increasing_id", "rand", "randn", "random",
    "uuid", "shuffle", "randstr", "uniform",
)
READER_PREFIXES = ("read_", "scan_", "parquet_", "iceberg_", "delta_", "postgres_", "sqlite_", "mysql_")
READER_SUFFIXES = ("_scan", "_replacement_scan")
RESERVED_NAMES = (
    "table", "select", "from", "where", "group", "order", "by", "join", "union", "all", "and", "or", "not", "null",
    "true", "false", "case", "when", "then", "else", "end", "as", "on", "in", "is", "like", "between", "default",
)
SPACE_SEPARATORS = "\u0020\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
MAX_NOTE_LENGTH, MAX_MENTIONED = 120, 4
NOTES = (
    (r"\[unresolved_column", "unknown column"),
    (r"\[unresolved_routine", "unknown function"),
    (r"\[table_or_view_not_found", "unknown table"),
    (r"\[parse_syntax_error", "syntax error"),
    (r"\[(cast_invalid_input|datatype_mismatch|cast_overflow)", "type mismatch"),
    (r"\[(divide_by_zero|arithmetic_overflow|binary_arithmetic_overflow)", "arithmetic error"),
    ("statement separator|comment or dollar-quote", "rejected by guard: separator or comment"),
    ("can read external data", "rejected by guard: file or URL access"),
    (r"is not allowed in a row predicate|not allowed\.$", "rejected by guard: forbidden keyword or function"),
    ("unbalanced parentheses", "rejected by guard: unbalanced parentheses"),
    ("unknown table", "unknown table"),
    ("unknown column", "unknown column"),
    ("types differ", "column types differ, so the comparison is not meaningful"),
    ("column counts differ", "column counts differ"),
    ("type mismatch", "type mismatch"),
)
OTHER_NOTE = "could not be evaluated"

NUMERIC = ("int", "bigint", "double", "decimal(10,2)")
TEMPORAL = ("timestamp_ntz", "date")
QUANTILES = {"p01": 0.01, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p99": 0.99}
TABLES = [t for t in D.SCHEMA if t != "messy"]


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def lits(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def src(table: str) -> str:
    return f"({D.MESSY})" if table == "messy" else table


def kind(type_: str) -> str:
    if type_ in NUMERIC:
        return "numeric"
    if type_ in TEMPORAL:
        return "temporal"
    return {"string": "string", "boolean": "boolean"}.get(type_, "nested")


def columns(*tables: str, of: str | None = None):
    """(table, ordinal, name, type) of the columns of some tables, of one class."""
    return [
        (t, i, n, ty)
        for t in (tables or TABLES)
        for i, (n, ty) in enumerate(D.SCHEMA[t])
        if of is None or kind(ty) == of
    ]


def union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def per_column(make, *tables: str, of: str | None = None) -> str:
    return union(make(*c) for c in columns(*tables, of=of))


RANK = {name: f"CAST({name} AS BIGINT) AS {name}" for name in ("l_linenumber", "c_nationkey", "p_size")}

# ------------------------------------------------------------------ sources

ORACLES["s01_parquet_scan"] = """
SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity,
       l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
       CAST(l_shipdate AS VARCHAR) AS l_shipdate FROM lineitem"""
ORACLES["s02_csv_scan"] = """
SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment,
       lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS padded FROM customer"""
ORACLES["s03_json_scan"] = """
SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part"""
ORACLES["s04_named_tables"] = """
SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"""

FAMILY = {"numeric": "numeric", "string": "text", "temporal": "temporal", "boolean": "boolean", "nested": "other"}
ORACLES["s05_describe"] = per_column(
    lambda t, i, n, ty: f"SELECT '{t}' AS \"table\", CAST({i} AS BIGINT) AS ordinal, '{n}' AS name, '{ty}' AS type, "
    f"'{kind(ty)}' AS class, '{FAMILY[kind(ty)]}' AS family, count({n}) AS filled FROM {t}"
)
ORACLES["s06_row_counts"] = union(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in TABLES)
ORACLES["s07_load_catalog"] = union(
    f"SELECT '{t}' AS \"table\", '{t}.parquet' AS label, 'parquet' AS format, count(*) AS rows, "
    f"CAST({len(D.SCHEMA[t])} AS BIGINT) AS columns, CAST(0 AS BIGINT) AS warnings FROM {t}"
    for t in ("orders", "lineitem", "customer")
)
_TEXTS = union(
    f"SELECT '{t}' AS origin, {c} AS text FROM {t}"
    for t, c in (("documents", "text"), ("pages", "html"), ("events", "props"), ("conversations", "text"))
)
ORACLES["s08_sniff_formats"] = rf"""
SELECT origin,
       CASE WHEN starts_with(text, '{PARQUET_MAGIC}') THEN 'parquet'
            WHEN regexp_matches(body, '^[{{\[]') THEN 'json'
            WHEN regexp_matches(regexp_extract(body, '^([^\r\n]*)', 1), '[,;\t|]') THEN 'csv' END AS format,
       count(*) AS n
FROM (SELECT origin, text, regexp_replace(text, '^[\s\x0B]+', '') AS body FROM ({_TEXTS}))
GROUP BY ALL"""
ORACLES["s09_payload_audit"] = f"""
SELECT doc_id,
       CASE WHEN strlen(text) = 0 THEN 'empty'
            WHEN strlen(text) < n_chars + doc_id % 2 THEN 'short'
            WHEN lang <> 'en' AND NOT starts_with(text, '{PARQUET_MAGIC}') THEN 'no_header'
            WHEN lang <> 'en' AND NOT ends_with(text, '{PARQUET_MAGIC}') THEN 'no_footer' END AS problem
FROM documents"""
ORACLES["s08_detect_files"] = union(
    f"SELECT '{t}.parquet' AS file, 'parquet' AS sniffed, 'parquet' AS declared, 'parquet' AS format, FALSE AS mismatch"
    for t in TABLES)
ORACLES["s09_audit_files"] = union(f"SELECT '{t}.parquet' AS file, CAST(NULL AS VARCHAR) AS problem" for t in TABLES)
ORACLES["s10_size_warnings"] = union(
    f"SELECT '{t}' AS \"table\", CAST({n} AS BIGINT) AS n, '{limit}' AS limit" for t in TABLES for n, limit in ((1, "100 bytes"), (0, "1 PiB")))
ORACLES["s11_table_names"] = rf"""
WITH slugs AS (
  SELECT page_id, left(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(
           url_decode(replace(list_extract(string_split(
             regexp_extract(url, '^(?i:https?)://[^/?#]*([^?#]*)', 1), '/'), -1), '+', '%2B')),
           '(?i)\.(gz|zst|bz2)$', ''), '\.[^.]+$', '')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 56) AS slug
  FROM pages),
based AS (
  SELECT page_id, CASE WHEN slug = '' THEN 't_table' WHEN regexp_matches(slug, '^[0-9]') THEN 't_' || slug
                       WHEN slug IN {lits(RESERVED_NAMES)} THEN slug || '_tbl' ELSE slug END AS base FROM slugs),
numbered AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY page_id) AS copy FROM based),
named AS (SELECT page_id, base, CASE WHEN copy = 1 THEN base ELSE base || '_' || copy END AS tbl FROM numbered)
SELECT page_id AS position, base, tbl AS "table",
       regexp_matches(tbl, '^[a-z][a-z0-9_]*$') AND length(tbl) <= 64 AS safe FROM named"""
ORACLES["s12_write_run"] = f"""
SELECT CAST(round AS BIGINT) AS round, id, title, violations, row_count, pct
FROM ({D.RUNS_DUCKDB}) WHERE status = 'falsified'"""
ORACLES["s13_driver_manifest"] = union(
    f"SELECT '{t}' AS \"table\", '{t}.parquet' AS label, count(*) AS rows, CAST({len(D.SCHEMA[t])} AS BIGINT) AS columns FROM {t}"
    for t in TABLES
)

# ----------------------------------------------------- filters and admission

ORACLES["f01_violation_filter"] = """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity FROM lineitem
WHERE NOT coalesce((nullif(l_linenumber, 3) < 5 AND l_quantity < 40), true)"""
ORACLES["f02_predicate_count"] = """
SELECT count(*) AS violations FROM lineitem WHERE NOT coalesce((nullif(l_linenumber, 3) < 5), true)"""
ORACLES["f03_predicate_rows"] = """
SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM (SELECT * FROM lineitem
WHERE NOT coalesce((l_quantity < 49 OR l_discount > 0.01), true) ORDER BY ALL LIMIT 200)"""
ORACLES["f04_conditional_counts"] = """
SELECT l_returnflag, count(*) FILTER (WHERE l_discount = 0) AS undiscounted,
       count(*) FILTER (WHERE l_quantity > 25) AS large FROM lineitem GROUP BY l_returnflag"""
ORACLES["f05_keys_not_null"] = f"""
SELECT kind, count(*) AS rows FROM ({D.MESSY}) WHERE kind IS NOT NULL AND value IS NOT NULL GROUP BY kind"""
ORACLES["f06_declared_projection"] = per_column(
    lambda t, i, n, ty: f"SELECT '{t}' AS \"table\", '{n}' AS name, '{kind(ty)}' AS class, count(*) AS row_count, "
    f"count(*) - count({n}) AS null_count, count(DISTINCT {n}) AS distinct_count, FALSE AS leaks, "
    f"CAST(18 AS BIGINT) AS fields FROM {t}",
    "orders",
)


def mask(text: str) -> str:
    out = text
    for pattern, symbol in ((r"\p{N}", "9"), (r"\p{Lu}", "A"), (r"\p{Ll}", "a"), ("[^[:ascii:]]", "a")):
        out = f"regexp_replace({out}, '{pattern}', '{symbol}', 'g')"
    return out


# Runs of one character: every character a mask can hold, each with a plus.
_RUNS = "|".join(rf"\x{c:02x}+" for c in range(1, 128))


def collapse(shape: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({shape}, '{_RUNS}'), lambda r: "
        "CASE WHEN length(r) >= 3 THEN r[1] || '{' || length(r) || '}' ELSE r END), '')"
    )


def top_shapes(table: str, name: str, ordinal: int, k: int = 8) -> str:
    return (
        f"SELECT '{table}' AS \"table\", '{name}' AS name, {ordinal} AS ordinal, {collapse('mask')} AS shape, n, rank FROM ("
        f"SELECT mask, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, mask) AS rank FROM ("
        f"SELECT {mask(name)} AS mask FROM {src(table)} WHERE {name} IS NOT NULL) GROUP BY mask) WHERE rank <= {k}"
    )


ORACLES["f07_shape_leaks"] = rf"""
SELECT "table", name, shape, CASE WHEN length(shape) > 60 THEN 'too long' ELSE 'unmasked characters' END AS problem
FROM ({union(top_shapes(t, n, i) for t, i, n, ty in columns("documents", "conversations", of="string"))})
WHERE length(shape) > 60
   OR NOT regexp_matches(regexp_replace(shape, '\{{\d+\}}', '', 'g'), '^[aA9\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]*$')"""


def trim_all(text: str) -> str:
    return rf"regexp_replace({text}, '^[\s\p{{Z}}\x{{FEFF}}]+|[\s\p{{Z}}\x{{FEFF}}]+$', '', 'g')"


def expression_reason(text: str, alias: str = "reason") -> str:
    """An expression over columns text (trimmed), live, words and parens."""
    banned = list(REFUSED_FUNCTIONS)
    starts = " OR ".join(f"starts_with(w, {lit(p)})" for p in READER_PREFIXES)
    ends = " OR ".join(f"ends_with(w, {lit(s)})" for s in READER_SUFFIXES)
    word = (
        f"CASE WHEN w IN {lits(KEYWORDS)} THEN 'Keyword \"' || w || '\" is not allowed in a row predicate.' "
        f"WHEN w IN {lits(banned)} THEN 'Function \"' || w || '\" is not allowed.' "
        f"WHEN {starts} OR {ends} THEN 'Identifier \"' || w || '\" can read external data.' END"
    )
    markers = " ".join(
        f"WHEN contains(live, {lit(m)}) THEN 'Comment or dollar-quote marker ({m}) is not allowed.'" for m in MARKERS
    )
    depth = "length(replace(parens[1:i], ')', '')) - length(replace(parens[1:i], '(', ''))"
    return (
        f"CASE WHEN {text} = '' THEN 'Empty expression.' "
        f"WHEN length({text}) > {MAX_EXPRESSION_LENGTH} THEN 'Expression longer than {MAX_EXPRESSION_LENGTH} characters.' "
        rf"WHEN regexp_matches({text}, '\\[''\"`]') THEN 'Backslash before a quote is not allowed.' "
        f"WHEN contains(live, ';') THEN 'Statement separator (;) is not allowed.' {markers} "
        "WHEN regexp_matches(live, '[''\"`]') THEN 'Unclosed quote.' "
        "WHEN length(replace(parens, ')', '')) <> length(replace(parens, '(', '')) THEN 'Unbalanced parentheses.' "
        f"WHEN list_min(list_transform(range(1, length(parens) + 1), lambda i: {depth})) < 0 THEN 'Unbalanced parentheses.' "
        f"ELSE list_filter(list_transform(words, lambda w: {word}), lambda r: r IS NOT NULL)[1] END AS {alias}"
    )


def scanned(rows: str, keep: str) -> str:
    """Rows with a column expression, and what the admission rules look at."""
    return rf"""
SELECT *, regexp_replace(live, '[^()]+', '', 'g') AS parens,
       regexp_extract_all(lower(live), '[a-z_][a-z0-9_]*') AS words
FROM (SELECT *, regexp_replace(CASE WHEN length(trimmed) <= {MAX_EXPRESSION_LENGTH} THEN trimmed END,
                  '''[^'']*''|"[^"]*"|`[^`]*`', ' ident ', 'g') AS live
      FROM (SELECT {keep}, {trim_all('expression')} AS trimmed FROM ({rows})))"""


_ASKED = f"""
SELECT 'wire' AS origin, position AS id, expr AS expression FROM ({D.WIRE_DUCKDB})
UNION ALL SELECT 'documents', doc_id, text FROM documents
UNION ALL SELECT 'conversations', conv_id * 1000 + turn, text FROM conversations"""
ORACLES["f08_expression_admission"] = (
    f"SELECT origin, id, {expression_reason('trimmed')} FROM ({scanned(_ASKED, 'origin, id')})"
)

NORMAL = f"""
SELECT 'h' || position AS id, position, trim(title) AS title, trim(rationale) AS rationale, severity, kind,
       trim(tbl) AS tbl,
       CASE WHEN kind <> 'row_predicate' THEN cols ELSE [] END AS cols,
       CASE WHEN kind = 'row_predicate' THEN trim(expr) ELSE '' END AS expr,
       CASE WHEN kind = 'references' THEN trim(ref_tbl) ELSE '' END AS ref_tbl,
       CASE WHEN kind = 'references' THEN ref_cols ELSE [] END AS ref_cols
FROM ({D.WIRE_DUCKDB})
WHERE trim(tbl) <> ''
  AND CASE kind WHEN 'unique' THEN len(cols) > 0
                WHEN 'references' THEN trim(ref_tbl) <> '' AND len(cols) > 0 AND len(cols) = len(ref_cols)
                ELSE trim(expr) <> '' END"""


def _names(table: str) -> str:
    return "[" + ", ".join(lit(n) for n, _ in D.SCHEMA[table]) + "]"


def _types(table: str) -> str:
    return "MAP {" + ", ".join(f"{lit(n)}: {lit(ty)}" for n, ty in D.SCHEMA[table]) + "}"


def _by_table(table: str, make) -> str:
    return f"CASE {table} WHEN 'orders' THEN {make('orders')} WHEN 'customer' THEN {make('customer')} END"


_FAMILIES = "MAP {" + ", ".join(f"'{ty}': '{FAMILY[kind(ty)]}'" for ty in ("int", "bigint", "double", "string", "timestamp_ntz")) + "}"


def _unknown(cols: str, table: str) -> str:
    missing = f"list_filter({cols}, lambda c: NOT list_contains({_by_table(table, _names)}, c))"
    return (
        f"CASE WHEN len({cols}) = 0 THEN 'No columns given.' WHEN len({missing}) > 0 "
        f"THEN 'Unknown column(s): ' || array_to_string({missing}, ', ') || '.' END"
    )


def _no_table(name: str) -> str:
    return f"CASE WHEN {name} NOT IN ('orders', 'customer') THEN 'Unknown table \"' || {name} || '\".' END"


ORACLES["f09_column_admission"] = f"""
SELECT id, coalesce({_no_table('tbl')}, {_unknown('cols', 'tbl')}) AS reason FROM ({NORMAL}) WHERE kind = 'unique'"""
ORACLES["f10_table_admission"] = f"""
SELECT id, {_no_table('tbl')} AS reason FROM ({NORMAL}) WHERE kind = 'row_predicate'"""
_TYPE_A, _TYPE_B = "ta[cols[i]]", "tb[ref_cols[i]]"
ORACLES["f11_comparable_types"] = f"""
SELECT id, coalesce({_no_table('tbl')}, {_no_table('ref_tbl')}, {_unknown('cols', 'tbl')}, {_unknown('ref_cols', 'ref_tbl')},
  list_filter(list_transform(range(1, len(cols) + 1), lambda i:
    CASE WHEN {_FAMILIES}[{_TYPE_A}] <> {_FAMILIES}[{_TYPE_B}]
         THEN 'Cannot compare ' || tbl || '.' || cols[i] || ' (' || {_TYPE_A} || ') with ' || ref_tbl || '.' ||
              ref_cols[i] || ' (' || {_TYPE_B} || '): types differ.' END), lambda r: r IS NOT NULL)[1]) AS reason
FROM (SELECT *, {_by_table('tbl', _types)} AS ta, {_by_table('ref_tbl', _types)} AS tb FROM ({NORMAL}))
WHERE kind = 'references'"""

# -------------------------------------------------------------------- joins


def orphans(child: str, cols: list[str], parent: str, ref_cols: list[str], what: str = "count(*) AS violations") -> str:
    held = " AND ".join(f"c.{c} IS NOT NULL" for c in cols)
    same = " AND ".join(f"p.{r} = c.{c}" for c, r in zip(cols, ref_cols))
    return f"SELECT {what} FROM {child} c WHERE {held} AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE {same})"


ORACLES["j01_orphan_count"] = orphans("orders", ["o_orderkey"], "lineitem", ["l_orderkey"])
ORACLES["j01_orphan_count_null_keys"] = orphans(
    "(SELECT nullif(user_id, 7) AS user_id FROM events)", ["user_id"],
    "(SELECT * FROM customer WHERE c_mktsegment = 'BUILDING')", ["c_custkey"])
ORACLES["j02_orphan_rows"] = orphans(
    "orders", ["o_orderkey"], "lineitem", ["l_orderkey"],
    "o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority")
ORACLES["j02_orphan_preview"] = orphans(
    "orders", ["o_orderkey"], "lineitem", ["l_orderkey"], "o_orderkey, o_custkey") + " ORDER BY o_orderkey LIMIT 200"
ORACLES["j03_reverse_reference"] = orphans("lineitem", ["l_orderkey"], "orders", ["o_orderkey"])
ORACLES["j04_self_reference"] = orphans("part", ["p_partkey"], "part", ["p_size"])
ORACLES["j05_composite_reference"] = union([
    orphans("lineitem", ["l_orderkey", "l_shipdate"], "orders", ["o_orderkey", "o_orderdate"], "'dated' AS keys, count(*) AS violations"),
    orphans("lineitem", ["l_suppkey", "l_linenumber"], "customer", ["c_custkey", "c_nationkey"], "'mixed' AS keys, count(*) AS violations"),
    orphans("lineitem", ["l_linenumber", "l_suppkey"], "customer", ["c_custkey", "c_nationkey"], "'widths' AS keys, count(*) AS violations"),
])

# ------------------------------------------------------------------ profiles

ORACLES["p01_column_classes"] = f"""
SELECT "table", class, count(*) AS columns, CAST(sum(n) AS BIGINT) AS cells FROM (
{per_column(lambda t, i, n, ty: f"SELECT '{t}' AS {chr(34)}table{chr(34)}, '{kind(ty)}' AS class, count(*) AS n FROM {t}")}) GROUP BY ALL"""
ORACLES["p02_null_counts"] = per_column(
    lambda t, i, n, ty: f"SELECT '{n}' AS name, count(*) AS row_count, count(*) - count({n}) AS null_count, "
    f"round((count(*) - count({n})) * 100.0::DOUBLE / count(*), 4) AS null_pct FROM {src(t)}", "messy")
ORACLES["p03_exact_distinct"] = per_column(
    lambda t, i, n, ty: f"SELECT '{n}' AS name, count(DISTINCT {n}) AS distinct_count FROM {src(t)}", "lineitem", "messy")
ORACLES["p04_approximate_distinct"] = per_column(
    lambda t, i, n, ty: f"SELECT '{n}' AS name, count(DISTINCT {n}) AS distinct_count, TRUE AS close FROM {t}", "lineitem")


def _distinct(n: str, ty: str) -> str:
    return f"count(DISTINCT {n})" if kind(ty) != "nested" else "CAST(0 AS BIGINT)"


ORACLES["p05_distinct_share"] = per_column(
    lambda t, i, n, ty: f"SELECT '{t}' AS \"table\", '{n}' AS name, {_distinct(n, ty)} AS distinct_count, "
    f"round({_distinct(n, ty)} * 100.0::DOUBLE / greatest(1, count({n})), 4) AS distinct_pct FROM {t}", "embeddings", "orders")
ORACLES["p06_candidate_keys"] = per_column(
    lambda t, i, n, ty: f"SELECT '{t}' AS \"table\", '{n}' AS name, count(*) = count({n}) AND count({n}) > 0 AND "
    f"{_distinct(n, ty)} >= count({n}) * 0.99::DOUBLE AS is_candidate_key, count(*) = count({n}) AND count({n}) > 0 "
    f"AND {_distinct(n, ty)} = count({n}) AS is_exact_key FROM {t}")


def _numeric(make) -> str:
    return union(make(*c) for c in columns("lineitem", "messy", of="numeric") if c[2] != "score")


ORACLES["p07_numeric_stats"] = _numeric(
    lambda t, i, n, ty: f"SELECT '{t}' AS \"table\", '{n}' AS name, round(min({n})::DOUBLE, 4) AS min, round(max({n})::DOUBLE, 4) AS max, "
    f"round(avg({n}::DOUBLE), 4) AS avg, round(stddev_samp({n}::DOUBLE), 4) AS stddev FROM {src(t)}")


def _quantiles(t: str, n: str) -> str:
    return ", ".join(f"round(quantile_cont({n}::DOUBLE, {q}), 4) AS {p}" for p, q in QUANTILES.items())


ORACLES["p08_quantiles"] = _numeric(lambda t, i, n, ty: f"SELECT '{t}' AS \"table\", '{n}' AS name, {_quantiles(t, n)} FROM {src(t)}")
ORACLES["p08_quantiles_by_ranges"] = union(
    f"SELECT '{n}' AS name, {_quantiles('lineitem', n)} FROM lineitem" for n in ("l_quantity", "l_extendedprice", "l_orderkey", "l_tax"))
ORACLES["p09_zero_negative"] = _numeric(
    lambda t, i, n, ty: f"SELECT '{t}' AS \"table\", '{n}' AS name, count(*) FILTER (WHERE {n} = 0) AS zero_count, "
    f"count(*) FILTER (WHERE {n} < 0) AS negative_count FROM {src(t)}")
ORACLES["p10_non_finite"] = per_column(
    lambda t, i, n, ty: f"SELECT '{n}' AS name, count(*) FILTER (WHERE isnan({n}::DOUBLE) OR isinf({n}::DOUBLE)) AS non_finite_count, "
    f"count(*) FILTER (WHERE {n} < 0) AS negative_count FROM {src(t)}", "messy", of="numeric")


def _temporal(make, *skip: str) -> str:
    return union(make(*c) for c in columns("orders", "lineitem", "events", "messy", of="temporal") if c[0] not in skip)


ORACLES["p11_temporal_range"] = _temporal(
    lambda t, i, n, ty: f"SELECT '{t}' AS \"table\", '{n}' AS name, min({n})::VARCHAR AS min_iso, max({n})::VARCHAR AS max_iso FROM {src(t)}", "events")
ORACLES["p12_span_days"] = _temporal(
    lambda t, i, n, ty: f"SELECT '{t}' AS \"table\", '{n}' AS name, date_diff('day', min({n})::TIMESTAMP, max({n})::TIMESTAMP) AS span_days FROM {src(t)}")
ORACLES["p13_future_count"] = _temporal(
    lambda t, i, n, ty: f"SELECT '{t}' AS \"table\", '{n}' AS name, count(*) FILTER (WHERE {n}::TIMESTAMP > TIMESTAMP '{D.AS_OF}') AS future_count FROM {src(t)}")
ORACLES["p14_epoch_zero"] = _temporal(
    lambda t, i, n, ty: f"SELECT '{t}' AS \"table\", '{n}' AS name, count(*) FILTER (WHERE {n}::DATE = DATE '1970-01-01') AS epoch_zero_count FROM {src(t)}")
ORACLES["p15_boolean_counts"] = f"""
SELECT 'flag' AS name, count(*) FILTER (WHERE flag) AS true_count, count(*) FILTER (WHERE NOT flag) AS false_count FROM ({D.MESSY})"""


def _string(make) -> str:
    return per_column(make, "documents", "pages", "customer", "messy", of="string")


ORACLES["p16_string_lengths"] = _string(
    lambda t, i, n, ty: f"SELECT '{t}' AS \"table\", '{n}' AS name, min(length({n})) AS len_min, max(length({n})) AS len_max, "
    f"round(avg(length({n})), 4) AS len_avg, round(quantile_cont(length({n})::DOUBLE, 0.5), 4) AS len_p50 FROM {src(t)}")
_ZS = lit(SPACE_SEPARATORS)
ORACLES["p17_blank_untrimmed"] = _string(
    lambda t, i, n, ty: f"SELECT '{t}' AS \"table\", '{n}' AS name, count(*) FILTER (WHERE {n} = '') AS empty_count, "
    f"count(*) FILTER (WHERE {n} <> '' AND trim({n}, {_ZS}) = '') AS whitespace_only_count, "
    f"count(*) FILTER (WHERE {n} <> trim({n}, {_ZS})) AS untrimmed_count FROM {src(t)}")
ORACLES["p18_case_insensitive_distinct"] = _string(
    lambda t, i, n, ty: f"SELECT '{t}' AS \"table\", '{n}' AS name, count(DISTINCT {n}) AS distinct_count, "
    f"count(DISTINCT lower({n})) AS distinct_case_insensitive FROM {src(t)}")
_CLASSES = {"alpha": "[^A-Za-z]", "digit": "[^0-9]", "space": "[^[:space:]]", "punct": "[^[:punct:]]"}


def _classes(t: str, n: str) -> str:
    sums = ", ".join(f"coalesce(sum(length(regexp_replace({n}, '{p}', '', 'g'))), 0)::DOUBLE AS {c}" for c, p in _CLASSES.items())
    shares = ", ".join(f"round(CASE WHEN chars = 0 THEN 0 ELSE {c} / chars * 100 END, 4) AS {c}" for c in _CLASSES)
    return (
        f"SELECT '{t}' AS \"table\", '{n}' AS name, {shares}, "
        f"round(CASE WHEN chars = 0 THEN 0 ELSE greatest(0, (chars - alpha - digit - space - punct) / chars * 100) END, 4) AS other "
        f"FROM (SELECT coalesce(sum(length({n})), 0)::DOUBLE AS chars, {sums} FROM {src(t)})"
    )


ORACLES["p19_character_classes"] = _string(lambda t, i, n, ty: _classes(t, n))
ORACLES["p20_format_masks"] = f"""
SELECT doc_id AS id, {mask('text')} AS mask FROM documents
UNION ALL SELECT -c_custkey - 1, {mask('c_name')} FROM customer"""


def _shapes(cols, k: int = 8) -> str:
    return f"SELECT \"table\", name, shape, n, rank FROM ({union(top_shapes(t, n, i, k) for t, i, n, ty in cols)})"


ORACLES["p21_shape_histogram"] = _shapes(columns("documents", "customer", "part", "events", of="string"))
ORACLES["p22_sampled_shapes"] = _shapes(columns("documents", "customer", of="string"))
ORACLES["p22_fixed_sample"] = "WITH sampled AS (SELECT * FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR)) LIMIT 300) " + _shapes(
    columns("documents", of="string")).replace("FROM documents", "FROM sampled")
ORACLES["p23_first_shape_columns"] = _shapes(columns("documents", "customer", "part", of="string"))
ORACLES["p24_collapsed_runs"] = f"""
SELECT p_partkey, {collapse('mask')} AS shape FROM (
  SELECT p_partkey, {mask("(p_name || '---' || p_brand)")} AS mask FROM part)"""
def _wide(k, n, ty):
    ends = f"min({n})::DOUBLE AS low, max({n})::DOUBLE AS high" if kind(ty) == "numeric" else "NULL::DOUBLE AS low, NULL::DOUBLE AS high"
    zero = f"count(*) FILTER (WHERE {n} = 0)" if kind(ty) == "numeric" else "CAST(NULL AS BIGINT)"
    empty = f"count(*) FILTER (WHERE {n} = '')" if kind(ty) == "string" else "CAST(NULL AS BIGINT)"
    return (
        f"SELECT '{n}_{k}' AS name, '{kind(ty)}' AS class, count(*) AS row_count, count(*) - count({n}) AS null_count, "
        f"count(DISTINCT {n}) >= count(*) * 0.99::DOUBLE AS is_candidate_key, {ends}, {zero} AS zero_count, {empty} AS empty_count FROM lineitem"
    )


ORACLES["p25_wide_table"] = union(_wide(k, n, ty) for k in range(4) for _, _, n, ty in columns("lineitem"))


def _table_profile(t, i, n, ty):
    zero = f"count(*) FILTER (WHERE {n} = 0)" if kind(ty) == "numeric" else "CAST(NULL AS BIGINT)"
    empty = f"count(*) FILTER (WHERE {n} = '')" if kind(ty) == "string" else "CAST(NULL AS BIGINT)"
    shapes = f"least(8, count(DISTINCT {mask(n)}))" if kind(ty) == "string" else "CAST(NULL AS BIGINT)"
    return (
        f"SELECT '{t}' AS \"table\", '{t}.parquet' AS label, 'parquet' AS format, CAST({i} AS BIGINT) AS ordinal, '{n}' AS name, "
        f"'{ty}' AS sql_type, '{kind(ty)}' AS class, count(*) AS row_count, count(*) - count({n}) AS null_count, "
        f"count(DISTINCT {n}) AS distinct_count, count(DISTINCT {n}) >= count(*) * 0.99::DOUBLE AS is_candidate_key, "
        f"{zero} AS zero_count, {empty} AS empty_count, {shapes} AS shapes FROM {t}"
    )


ORACLES["p26_table_profile"] = per_column(_table_profile, "customer")
ORACLES["p27_database_profile"] = per_column(
    lambda t, i, n, ty: f"SELECT '{t}' AS \"table\", CAST({i} AS BIGINT) AS ordinal, '{n}' AS name, '{kind(ty)}' AS class, "
    f"count(*) AS row_count, count(*) - count({n}) AS null_count, {_distinct(n, ty)} AS distinct_count FROM {t}")


def _rollup(t: str, source: str, cols) -> str:
    sparse = " OR ".join(f"(count(*) - count({c})) * 100.0 / count(*) > 50" for c in cols)
    return f"SELECT '{t}' AS \"table\", count(*) AS row_count, CAST({len(cols)} AS BIGINT) AS column_count, {sparse} AS sparse FROM {source}"


_RARE = f"(SELECT *, CASE WHEN event_id % 2 = 0 OR flag THEN NULL ELSE note END AS rare FROM ({D.MESSY}))"
ORACLES["p28_profile_rollup"] = union(
    [_rollup("messy", _RARE, [n for n, _ in D.SCHEMA["messy"]] + ["rare"])]
    + [_rollup(t, t, [n for n, _ in D.SCHEMA[t]]) for t in ("customer", "orders")])


def _num(v: str) -> str:
    return (
        f"CASE WHEN {v} IS NULL THEN '-' WHEN {v} = floor({v}) THEN format('{{:,}}', CAST({v} AS BIGINT)) "
        f"WHEN abs({v}) < 1 THEN printf('%.4f', {v}) ELSE printf('%.2f', {v}) END"
    )


def _tail(v: str, word: str) -> str:
    return f"CASE WHEN {v} > 0 THEN format('{{:,}}', CAST({v} AS BIGINT)) || ' {word}' END"


def _summary(t, i, n, ty):
    head = f"SELECT '{t}' AS \"table\", '{n}' AS name, "
    k = kind(ty)
    if k == "numeric":
        finite = f"CASE WHEN isfinite({{}}) THEN {{}} END"
        low, high = (finite.replace("{}", f"{f}({n})::DOUBLE") for f in ("min", "max"))
        text = (
            f"concat_ws(' · ', {_num('lo')} || ' … ' || {_num('hi')}, {_tail('neg', 'negative')}, {_tail('zero', 'zero')}, {_tail('odd', 'NaN/Inf')})"
        )
        odd = f"count(*) FILTER (WHERE NOT isfinite({n}::DOUBLE))"
        return (
            f"{head}{text} AS summary FROM (SELECT {low} AS lo, {high} AS hi, count(*) FILTER (WHERE {n} < 0) AS neg, "
            f"count(*) FILTER (WHERE {n} = 0) AS zero, {odd} AS odd FROM {src(t)})"
        )
    if k == "temporal":
        return (
            f"{head}concat_ws(' · ', lo || ' … ' || hi, {_tail('future', 'future')}, {_tail('epoch', 'at epoch')}) AS summary FROM ("
            f"SELECT min({n})::VARCHAR AS lo, max({n})::VARCHAR AS hi, count(*) FILTER (WHERE {n}::TIMESTAMP > TIMESTAMP '{D.AS_OF}') AS future, "
            f"count(*) FILTER (WHERE {n}::DATE = DATE '1970-01-01') AS epoch FROM {src(t)})"
        )
    if k == "boolean":
        return (
            f"{head}format('{{:,}}', count(*) FILTER (WHERE {n})) || ' true · ' || "
            f"format('{{:,}}', count(*) FILTER (WHERE NOT {n})) || ' false' AS summary FROM {src(t)}"
        )
    first = f"(SELECT string_agg(shape, ', ' ORDER BY rank) FROM ({top_shapes(t, n, i, 3)}))"
    return (
        f"{head}concat_ws(' · ', 'len ' || format('{{:,}}', lo) || '-' || format('{{:,}}', hi), {_tail('empty', 'empty')}, "
        f"{_tail('untrimmed', 'untrimmed')}, 'shapes: ' || {first}) AS summary FROM ("
        f"SELECT min(length({n})) AS lo, max(length({n})) AS hi, count(*) FILTER (WHERE {n} = '') AS empty, "
        f"count(*) FILTER (WHERE {n} <> trim({n}, {_ZS})) AS untrimmed FROM {src(t)})"
    )


ORACLES["p29_column_summary"] = per_column(_summary, "messy", "orders", "customer")

# -------------------------------------------------------- checks and verdicts


def repeated(source: str, cols: list[str], what: str = "") -> str:
    return f"SELECT {what}CAST(coalesce(sum(n), 0) AS BIGINT) AS violations FROM (SELECT count(*) AS n FROM {source} GROUP BY {', '.join(cols)} HAVING count(*) > 1)"


ORACLES["c01_unique"] = union([
    repeated("lineitem", ["l_orderkey", "l_linenumber"], "'line' AS key, "),
    repeated("documents", ["text"], "'text' AS key, "),
    repeated(f"({D.MESSY})", ["kind", "value"], "'nulls' AS key, "),
])


def _verdict(parts: str) -> str:
    return (
        "SELECT id, CASE WHEN violations IS NULL THEN 'skipped' WHEN violations = 0 THEN 'holds' ELSE 'falsified' END AS status, "
        f"violations, row_count, round(violations * 100.0::DOUBLE / row_count, 4) AS pct FROM ({parts})"
    )


def _predicate(i, p: str) -> str:
    return f"SELECT {i} AS id, count(*) FILTER (WHERE NOT coalesce(({p}), true)) AS violations, count(*) AS row_count FROM lineitem"


ORACLES["c02_verdicts"] = "SELECT id, status, violations, pct FROM (" + _verdict(
    union(_predicate(f"CAST({i} AS BIGINT)", p) for i, p in enumerate(D.LINEITEM_PREDICATES))) + ")"
ORACLES["c03_denominators"] = f"""
SELECT id, CASE tbl WHEN 'orders' THEN (SELECT count(*) FROM orders) END AS row_count FROM ({NORMAL})"""


def _key_check(i: str, c: dict) -> str:
    if c["kind"] == "unique":
        counted = repeated(c["table"], c["columns"])
    else:
        counted = orphans(c["table"], c["columns"], c["references_table"], c["references_columns"])
    return f"SELECT {i} AS id, ({counted}) AS violations, (SELECT count(*) FROM {c['table']}) AS row_count"


_N = len(D.LINEITEM_PREDICATES)
ORACLES["c04_check_batch"] = _verdict(union(
    [_predicate(f"'r1h{i + 1}'", p) for i, p in enumerate(D.LINEITEM_PREDICATES)]
    + [_key_check(f"'r1h{_N + i + 1}'", c) for i, c in enumerate(D.KEY_CHECKS)]
    + [
        f"SELECT 'r1h{_N + len(D.KEY_CHECKS) + i + 1}' AS id, CAST(NULL AS BIGINT) AS violations, CAST(NULL AS BIGINT) AS row_count"
        for i in range(len(D.BROKEN_CHECKS))
    ]))
ORACLES["c05_normalized_checks"] = f"""
SELECT id, title, rationale, severity, kind, tbl AS "table", array_to_string(cols, ',') AS columns, expr AS expression,
       ref_tbl AS references_table, array_to_string(ref_cols, ',') AS references_columns FROM ({NORMAL})"""
ORACLES["c06_check_ids"] = f"""
SELECT position, 'r2h' || row_number() OVER (ORDER BY position) AS id FROM ({NORMAL})"""
ORACLES["c07_tables_touched"] = f"""
SELECT id, CASE WHEN kind = 'references' THEN tbl || ',' || ref_tbl ELSE tbl END AS tables,
       kind = 'references' AND tbl <> ref_tbl AS cross_table FROM ({NORMAL})"""


def check_text(cols: str = "cols") -> str:
    return (
        f"CASE kind WHEN 'unique' THEN 'UNIQUE (' || array_to_string({cols}, ', ') || ') in ' || tbl "
        f"WHEN 'references' THEN tbl || '(' || array_to_string({cols}, ', ') || ') → ' || ref_tbl || '(' || "
        "array_to_string(ref_cols, ', ') || ')' ELSE expr END"
    )


ORACLES["c08_check_text"] = f'SELECT id, {check_text()} AS "check" FROM ({NORMAL})'
ORACLES["w01_duplicate_rows"] = """
SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity, l_extendedprice,
       l_discount, l_tax, l_returnflag, l_linestatus, CAST(l_shipdate AS VARCHAR) AS l_shipdate
FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1"""
ORACLES["w01_duplicate_preview"] = """
SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem
QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_suppkey) > 1
ORDER BY l_orderkey, l_suppkey, l_partkey, l_quantity, l_extendedprice LIMIT 200"""

# -------------------------------------------------------------- top-k, paging

ORACLES["t01_top_shapes"] = f"""
SELECT CAST(ordinal AS BIGINT) AS ordinal, shape, n, rank FROM ({union(top_shapes(t, n, i, 3) for t, i, n, ty in columns("part", of="string"))})"""
ORACLES["t02_preview_limit"] = """
SELECT o_orderkey, o_totalprice FROM orders WHERE NOT coalesce((o_totalprice < 100000), true)
ORDER BY o_orderkey, o_custkey LIMIT 200"""
ORACLES["t03_result_page"] = """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100"""
ORACLES["t04_rounds"] = f"SELECT DISTINCT CAST(round AS BIGINT) AS round FROM ({D.RUNS_DUCKDB}) ORDER BY 1"

for _name, _checks in D.SCALARS.items():
    ORACLES[_name] = union(
        f'SELECT CAST({i} AS BIGINT) AS "check", count(*) AS violations FROM {src(t)} WHERE NOT coalesce(({duck or spark}), true)'
        for i, (t, spark, duck) in enumerate(_checks))

# --------------------------------------------------- findings, rounds, summary


def sanitized(reason: str, tables: list[str]) -> str:
    known = sorted(set(tables) | {n for t in tables for n, _ in D.SCHEMA[t]})
    names = "[" + ", ".join(lit(k) for k in known) + "]"
    category = "CASE " + " ".join(
        f"WHEN regexp_matches(lower({reason}), {lit(p)}) THEN {lit(c)}" for p, c in NOTES) + f" ELSE {lit(OTHER_NOTE)} END"
    words = f"list_filter(regexp_extract_all({reason}, '[A-Za-z_][A-Za-z0-9_]*'), lambda w: list_contains({names}, w))"
    first = f"list_filter({words}, lambda w, i: list_position({words}, w) = i)[1:{MAX_MENTIONED}]"
    mentioned = f"array_to_string({first}, ', ')"
    return (
        f"CASE WHEN {reason} IS NOT NULL THEN left({category} || CASE WHEN {mentioned} <> '' THEN ' (' || {mentioned} || ')' ELSE '' END, {MAX_NOTE_LENGTH}) END"
    )


FINDINGS = f"""
SELECT round, position, id, title, kind, CASE status WHEN 'skipped' THEN 'not_run' ELSE status END AS outcome,
       violations, CASE status WHEN 'falsified' THEN pct WHEN 'holds' THEN CAST(0 AS DOUBLE) END AS pct, row_count,
       {sanitized('reason', ['orders', 'customer'])} AS note FROM ({D.RUNS_DUCKDB})"""
ORACLES["r01_findings"] = f"SELECT id, outcome, violations, pct, row_count, note FROM ({FINDINGS})"
_REASONS = """
SELECT 'documents' AS origin, doc_id AS id,
       CASE doc_id % 4 WHEN 0 THEN 'Could not convert string ' || chr(39) || text || chr(39) || ' to DOUBLE'
            WHEN 1 THEN 'Referenced column ' || source || ' not found in documents ' || text
            WHEN 2 THEN 'syntax error at or near ' || text ELSE text END AS reason FROM documents
UNION ALL SELECT 'conversations', conv_id * 1000 + turn, 'No function matches the given name ' || role || ' ' || text FROM conversations"""
ORACLES["r02_sanitized_notes"] = f"SELECT origin, id, {sanitized('reason', TABLES)} AS note FROM ({_REASONS})"
ORACLES["r03_known_identifiers"] = f"""
SELECT name, count(*) AS mentions FROM (SELECT unnest(regexp_extract_all(concat_ws(' ', reason, expr), '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM ({D.RUNS_DUCKDB}))
WHERE name IN {lits(sorted(set(TABLES) | {n for t in TABLES for n, _ in D.SCHEMA[t]}))} GROUP BY name"""
ORACLES["r04_finding_leaks"] = f"""
SELECT id, reason AS note FROM ({D.RUNS_DUCKDB})
WHERE length(reason) > 120 OR contains(reason, chr(39)) OR contains(reason, chr(34)) OR contains(reason, '`')"""
ORACLES["r05_bounded_findings"] = f"""
SELECT CAST(round AS BIGINT) AS round, id, left(title, 12) AS title FROM ({D.RUNS_DUCKDB})"""
ORACLES["r06_round_accumulation"] = "SELECT CAST(round AS BIGINT) AS round, id, status, violations, row_count FROM (" + union([
    "SELECT 1 AS round, * FROM (" + _verdict(union(_predicate(f"'r1h{i + 1}'", p) for i, p in enumerate(D.LINEITEM_PREDICATES[:4]))) + ")",
    "SELECT 2 AS round, * FROM (" + _verdict(union(_key_check(f"'r2h{i + 1}'", c) for i, c in enumerate(D.KEY_CHECKS))) + ")",
]) + ")"
ORACLES["r07_verdict_history"] = f"""
SELECT CAST(round AS BIGINT) AS round, id,
       CASE outcome WHEN 'holds' THEN 'HELD        ' || title || '  [' || kind || ']'
            WHEN 'not_run' THEN 'NOT RUN     ' || title || '  : ' || coalesce(note, 'unknown')
            ELSE 'FALSIFIED   ' || title || '  : ' || coalesce(format('{{:,}}', violations), '?') || ' rows' ||
                 coalesce(' (' || printf('%.2f', pct) || '%)', '') END AS line FROM ({FINDINGS})"""
ORACLES["r08_run_totals"] = f"""
SELECT count(DISTINCT round) AS rounds, count(*) AS checks, count(*) FILTER (WHERE status = 'falsified') AS falsified,
       count(*) FILTER (WHERE status = 'holds') AS held, count(*) FILTER (WHERE status = 'skipped') AS not_run,
       CAST(sum(ms) AS BIGINT) AS ms FROM ({D.RUNS_DUCKDB})"""
ORACLES["r09_falsified"] = ORACLES["s12_write_run"]
ORACLES["r10_falsified_by_round"] = f"""
SELECT CAST(round AS BIGINT) AS round, count(*) FILTER (WHERE status = 'falsified') AS falsified FROM ({D.RUNS_DUCKDB}) GROUP BY round"""
ORACLES["r11_check_details"] = f"""
SELECT CAST(round AS BIGINT) AS round, id,
       CASE status WHEN 'holds' THEN 'HOLDS' WHEN 'falsified' THEN 'FALSIFIED' ELSE 'NOT RUN' END AS verdict,
       title, severity, kind = 'references' AND tbl <> ref_tbl AS cross_table,
       CASE WHEN kind = 'references' THEN tbl || ' · ' || ref_tbl ELSE tbl END AS tables,
       violations, row_count, pct, reason, rationale, {check_text()} AS "check" FROM ({D.RUNS_DUCKDB})"""
ORACLES["r12_data_inventory"] = union(
    f"SELECT '{t}' AS \"table\", '{t}.parquet' AS label, count(*) AS rows, CAST({len(D.SCHEMA[t])} AS BIGINT) AS columns, "
    f"{lit(', '.join(f'{n} ({ty})' for n, ty in D.SCHEMA[t]))} AS column_list FROM {t}"
    for t in TABLES)

# ------------------------------------------------------------------ proposals


def _shared(n: str, ty: str) -> str:
    if ty == "double":
        return f"CASE WHEN abs({n}) < 9e15 AND {n} = floor({n}) THEN CAST(CAST({n} AS BIGINT) AS VARCHAR) ELSE CAST({n} AS VARCHAR) END"
    return f"CAST({n} AS VARCHAR)"


def references(tables: list[str]) -> str:
    cols = [(k, *c) for k, c in enumerate(columns(*tables)) if kind(c[3]) in ("numeric", "string", "temporal")]
    stats = union(
        f"SELECT {k} AS id, '{t}' AS tbl, '{n}' AS col, '{kind(ty)}' AS family, count(DISTINCT {n}) AS ndv, count(*) AS n, "
        f"count({n}) = count(*) AND count(DISTINCT {n}) >= 0.99::DOUBLE * count({n}) AS is_key, "
        + (f"count(*) FILTER (WHERE {n} <> floor({n})) = 0 AS whole, " if ty == "double" else "TRUE AS whole, ")
        + (f"min({n})::DOUBLE AS low, max({n})::DOUBLE AS high" if kind(ty) == "numeric" else "NULL::DOUBLE AS low, NULL::DOUBLE AS high")
        + f" FROM {t}"
        for k, t, i, n, ty in cols)
    values = union(f"SELECT DISTINCT {k} AS id, '{kind(ty)}' AS family, {_shared(n, ty)} AS v FROM {t}" for k, t, i, n, ty in cols)
    return f"""
WITH stats AS MATERIALIZED ({stats}), vals AS MATERIALIZED ({values}),
pairs AS (SELECT c.id AS child, p.id AS parent, c.tbl, c.col, p.tbl AS ref_tbl, p.col AS ref_col, c.ndv, round(c.ndv::DOUBLE / p.n, 4) AS ratio
  FROM stats c JOIN stats p ON c.family = p.family AND c.id <> p.id
  WHERE NOT coalesce(c.high < p.low OR c.low > p.high, false) AND c.ndv > 0
    AND (c.col = p.col OR (c.whole AND p.whole AND p.is_key))),
shared AS (SELECT a.id AS child, b.id AS parent, count(*) AS n FROM vals a JOIN vals b ON a.family = b.family AND a.v = b.v
  WHERE EXISTS (SELECT 1 FROM pairs q WHERE q.child = a.id AND q.parent = b.id) GROUP BY ALL)
SELECT tbl AS "table", col AS "column", ref_tbl AS references_table, ref_col AS references_column, ratio, ndv AS child_values,
       coalesce(n, 0) AS shared_values, round(coalesce(n, 0) / ndv::DOUBLE, 4) AS inclusion
FROM pairs LEFT JOIN shared USING (child, parent)"""


ORACLES["m01_reference_candidates"] = references(TABLES)
ORACLES["m01_held_references"] = f"SELECT * FROM ({references(TABLES)}) WHERE shared_values >= 0.9::DOUBLE * child_values"


def _composite(table: str) -> str:
    names = [n for n, ty in D.SCHEMA[table] if kind(ty) != "nested"]
    counted = union(
        f"SELECT {lit(','.join(c))} AS columns, {size} AS size, [{', '.join(lit(x) for x in c)}] AS parts, "
        f"count(DISTINCT ({', '.join(c)})) = count(*) AND count(*) > 0 AS is_unique, count(*) AS row_count FROM {table}"
        for size in (1, 2, 3) for c in ([(n, n) for n in names] if size == 1 else combinations(names, size)))
    return f"""
WITH counted AS MATERIALIZED ({counted})
SELECT columns, row_count FROM counted a WHERE is_unique AND size > 1
  AND NOT EXISTS (SELECT 1 FROM counted b WHERE b.is_unique AND b.size < a.size AND list_has_all(a.parts, b.parts))"""


ORACLES["m02_composite_keys"] = _composite("lineitem")
ORACLES["m03_minority_shapes"] = f"""
SELECT p_partkey, p_name, {collapse('mask')} AS shape FROM (SELECT p_partkey, p_name, {mask('p_name')} AS mask FROM part)
QUALIFY count(*) OVER (PARTITION BY mask) < 0.05 * count(*) OVER ()"""


def _sentinel(t, i, n, ty):
    tests = {
        "numeric": {v: f"{n} = {v}" for v in ("0", "-1", "9999")},
        "temporal": {"1970-01-01": f"{n}::DATE = DATE '1970-01-01'"},
        "string": {"": f"{n} = ''"},
    }.get(kind(ty), {})
    return [
        f"SELECT '{t}' AS \"table\", '{n}' AS name, '{v}' AS sentinel, count({n}) AS filled, count(*) FILTER (WHERE {test}) AS hits, "
        f"round(CASE WHEN count({n}) = 0 THEN 0 ELSE count(*) FILTER (WHERE {test}) * 100.0::DOUBLE / count({n}) END, 4) AS pct FROM {src(t)}"
        for v, test in tests.items()
    ]


ORACLES["m04_sentinels"] = union(s for c in columns("messy", "orders", "lineitem") for s in _sentinel(*c))
ORACLES["m05_order_invariants"] = "SELECT low_column, high_column, compared, violations, round(share, 6) AS share FROM (" + union(
    f"SELECT '{a}' AS low_column, '{b}' AS high_column, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS compared, "
    f"count(*) FILTER (WHERE {a} > {b}) AS violations, count(*) FILTER (WHERE {a} > {b}) / count(*)::DOUBLE AS share, "
    f"max({a}) <= min({b}) OR min({a}) > max({b}) AS known FROM lineitem"
    for a, ta in D.SCHEMA["lineitem"] for b, tb in D.SCHEMA["lineitem"] if a != b and kind(ta) == kind(tb) == "numeric"
) + ") WHERE NOT known AND share <= 0.05"
_RULES = ["l_extendedprice > 910", "l_quantity > 1", "l_discount < 0.1 OR l_tax < 0.08"]
ORACLES["m06_conditional_rules"] = union(
    f"SELECT '{d}' AS dim, CAST({d} AS VARCHAR) AS value, {lit(p)} AS predicate, count(*) AS rows, "
    f"(SELECT count(*) FROM lineitem WHERE NOT ({p})) AS overall_violations FROM lineitem GROUP BY {d} "
    f"HAVING count(*) FILTER (WHERE NOT ({p})) = 0 AND count(*) >= 5 AND (SELECT count(*) FROM lineitem WHERE NOT ({p})) > 0"
    for d in ("l_suppkey", "l_linenumber", "l_returnflag", "l_partkey") for p in _RULES)
_NUMBERS = r"(SELECT url, regexp_extract(url, '/([0-9]+)', 1) AS number, regexp_extract(url, '[?]page=([0-9]*)', 1) AS page FROM pages)"
ORACLES["m07_numeric_text"] = union(
    f"SELECT '{n}' AS name, count({n}) AS filled, count(*) FILTER (WHERE try_cast({n} AS BIGINT) IS NOT NULL) AS numeric, "
    f"round(count(*) FILTER (WHERE try_cast({n} AS BIGINT) IS NOT NULL) / count({n})::DOUBLE, 4) AS share FROM {_NUMBERS}"
    for n in ("url", "number", "page"))
ORACLES["m08_near_bounds"] = per_column(
    lambda t, i, n, ty: f"SELECT '{n}' AS name, count(*) FILTER (WHERE {n} = lo) AS at_min, count(*) FILTER (WHERE {n} = hi) AS at_max, "
    f"count(*) FILTER (WHERE {n}::DOUBLE <= q1) AS to_p01, count(*) FILTER (WHERE {n}::DOUBLE >= q99) AS from_p99 FROM lineitem, "
    f"(SELECT min({n}) AS lo, max({n}) AS hi, quantile_cont({n}::DOUBLE, 0.01) AS q1, quantile_cont({n}::DOUBLE, 0.99) AS q99 FROM lineitem)",
    "lineitem", of="numeric")


def _proposed(table: str) -> list[str]:
    """(tbl, columns, expression, severity) of the checks of one table."""
    out = [f"SELECT '{table}' AS tbl, columns, '' AS expression, 'medium' AS severity FROM ({_composite(table)})"]

    def predicate(expression: str, rows: str, severity: str = "medium") -> None:
        out.append(f"SELECT '{table}', '', {expression}, '{severity}' FROM ({rows})")

    cols = D.SCHEMA[table]
    for a, ta in cols:
        for b, tb in cols:
            if a != b and kind(ta) == kind(tb) and kind(ta) in ("numeric", "temporal"):
                predicate(lit(f'"{a}" <= "{b}"'), f"""
SELECT count(*) FILTER (WHERE {a} > {b}) AS bad, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM {table}
HAVING n > 0 AND bad / n::DOUBLE <= 0.05::DOUBLE AND NOT (max({a}) <= min({b}) OR min({a}) > max({b}))""")
    for n, ty in cols:
        if kind(ty) != "numeric":
            continue
        for v in (-1, 9999):
            predicate(lit(f'"{n}" <> {v}'), f"""
SELECT count(*) FILTER (WHERE {n} = {v}) AS hits FROM {table} HAVING hits > 0 AND hits * 100.0::DOUBLE / count({n}) < 5""")
        for d, td in cols:
            if kind(td) in ("string", "boolean") or kind(td) == "numeric" and td != "double":
                value = f"""'string("{d}") <> ''' || replace(value, '''', '''''') || ''' OR "{n}" ' || sign"""
                predicate(value, f"""
SELECT CAST({d} AS VARCHAR) AS value, CASE WHEN lo = 0 THEN '> 0' ELSE '>= 0' END AS sign
FROM {table}, (SELECT min({n}) AS lo, count(DISTINCT {d}) AS ndv, count(*) AS total FROM {table})
WHERE lo <= 0 AND ndv <= 50 AND {d} IS NOT NULL GROUP BY {d}, lo, total
HAVING count(*) FILTER (WHERE CASE WHEN lo = 0 THEN {n} <= 0 ELSE {n} < 0 END) = 0
   AND count(*) >= greatest(1, floor(total * 0.05::DOUBLE))""", "low")
    return out


_HELD = f"({ORACLES['m01_held_references']})"
ORACLES["m00_proposed_checks"] = f"""
WITH held AS MATERIALIZED {_HELD}
SELECT 'references' AS kind, "table", columns, '' AS expression, references_table, references_columns, severity FROM (SELECT DISTINCT * FROM (
  SELECT "table", "column" AS columns, references_table, references_column AS references_columns, 'high' AS severity FROM held
  UNION ALL
  SELECT references_table, references_column, "table", "column", 'medium' FROM held))
UNION ALL
SELECT CASE WHEN expression = '' THEN 'unique' ELSE 'row_predicate' END, tbl, columns, expression, '', '', severity
FROM ({union(s for t in TABLES for s in _proposed(t))})"""


def narrowed(rows: str, dims: dict[str, str]) -> str:
    """rows has a boolean column bad; dims maps each dimension to its value's SQL."""
    parts = union(
        f"SELECT '{d}' AS dim, {v} AS value, count(*) AS rows, count(*) FILTER (WHERE bad) AS violations FROM flagged GROUP BY ALL"
        for d, v in dims.items())
    return f"""
WITH flagged AS MATERIALIZED ({rows}), total AS (SELECT count(*) FILTER (WHERE bad) / count(*)::DOUBLE AS overall FROM flagged)
SELECT dim, value, rows, violations, round(violations / rows::DOUBLE, 4) AS rate,
       round(CASE WHEN overall > 0 THEN violations / rows::DOUBLE / overall ELSE 0 END, 4) AS lift FROM ({parts}), total"""


_ORDER_DIMS = {
    "o_orderstatus": "o_orderstatus", "o_orderpriority": "o_orderpriority",
    "o_orderdate": "strftime(date_trunc('month', o_orderdate), '%Y-%m-%d')",
}
ORACLES["m09_narrow_predicate"] = narrowed(
    "SELECT *, NOT coalesce((o_totalprice < 400000 OR o_orderstatus = 'F'), true) AS bad FROM orders", _ORDER_DIMS)
ORACLES["m09_narrow_reference"] = narrowed(
    "SELECT *, NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AS bad FROM orders", _ORDER_DIMS)
ORACLES["m09_narrow_unique"] = narrowed(
    "SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 AS bad FROM lineitem",
    {"l_returnflag": "l_returnflag", "l_linenumber": "CAST(l_linenumber AS VARCHAR)",
     "l_shipdate": "strftime(date_trunc('year', l_shipdate), '%Y-%m-%d')"})


def worst(rows: str, columns: list[str], keep: int) -> str:
    """rows has a boolean column bad; of each column the values with most bad rows, and the rest."""
    parts = union(
        f"SELECT '{c}' AS dim, CAST({c} AS VARCHAR) AS value, count(*) AS n, count(*) FILTER (WHERE bad) AS v FROM flagged GROUP BY ALL"
        for c in columns)
    return f"""
WITH flagged AS MATERIALIZED ({rows}), total AS (SELECT count(*) FILTER (WHERE bad) / count(*)::DOUBLE AS overall FROM flagged),
ranked AS (SELECT *, v = 0 OR row_number() OVER (PARTITION BY dim ORDER BY v DESC, value NULLS FIRST) > {keep} AS rest FROM ({parts})),
summed AS (SELECT dim, CASE WHEN rest THEN NULL ELSE value END AS value, rest, CAST(sum(n) AS BIGINT) AS rows,
                  CAST(sum(v) AS BIGINT) AS violations FROM ranked GROUP BY ALL)
SELECT dim, value, rest, rows, violations, round(violations / rows::DOUBLE, 4) AS rate,
       round(CASE WHEN overall > 0 THEN violations / rows::DOUBLE / overall ELSE 0 END, 4) AS lift FROM summed, total"""


_WIDE = ["o_custkey", "o_orderkey"]
ORACLES["m09_worst_values"] = worst(
    "SELECT *, NOT coalesce((o_totalprice < 400000 OR o_orderstatus = 'F'), true) AS bad FROM orders", _WIDE, 20)
ORACLES["m09_worst_orphans"] = worst(
    "SELECT *, NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AS bad FROM orders", _WIDE, 20)
_KEYED = f"""
SELECT *, concat_ws('|', kind, tbl, CASE kind WHEN 'unique' THEN array_to_string(list_sort(cols), ',')
          WHEN 'references' THEN array_to_string(list_sort(list_transform(range(1, len(cols) + 1), lambda i: cols[i] || '=' || ref_cols[i])), ',')
          ELSE expr END, ref_tbl) AS key FROM ({NORMAL})"""
ORACLES["m10_not_yet_run"] = f"""
SELECT id FROM ({_KEYED}) WHERE key NOT IN (SELECT key FROM ({_KEYED}) WHERE severity = 'high')"""

ORACLES["a01_ad_hoc_sql"] = """
SELECT c_mktsegment, o_orderstatus, count(*) AS orders, count(DISTINCT c_custkey) AS customers,
       CAST(sum(CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END) AS BIGINT) AS large
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment, o_orderstatus"""
ORACLES["a02_starter_checks"] = f"""
SELECT CAST(round AS BIGINT) AS round, id, title, sql_text AS sql FROM ({D.RUNS_DUCKDB}) ORDER BY round, position LIMIT 25"""
