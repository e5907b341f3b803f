"""Evaluating checks: violation counts, verdicts and violating rows."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabproof.functions.guard import called_names, spark_expression
from tabproof.functions.text import group_key, quote_name
from tabproof.functions.types import common_key_type
from tabproof.operators.admission import admit_checks
from tabproof.operators.checks import Check
from tabproof.plans.keyed_rows import first_rows_with_keys, rows_with_keys
from tabproof.session import local_frame

# Fixed value: rows shown of a falsified check.
PREVIEW_ROWS = 200

# Predicates analysed in one plan, and key checks run in one job.
EXPRESSION_BUDGET = 180
KEY_CHECKS_PER_JOB = 40
# Predicates counted in one aggregate. Spark compiles no aggregate of many more, and evaluating
# them uncompiled takes longer than the scans that this many more aggregates need.
COMPILED_TOGETHER = 45

RESULT_SCHEMA = (
    "id string, status string, violations bigint, row_count bigint, pct double, "
    "reason string, ms bigint, sql string"
)


# ---------------------------------------------------------------- row predicates


def violates_sql(expression: str) -> str:
    """SQL that is true for rows that break a predicate. A predicate that is NULL passes."""
    return f"not coalesce(cast(({spark_expression(expression)}) as boolean), true)"


def violates(expression: str) -> Column:
    return F.expr(violates_sql(expression))


def predicate_violations(df: DataFrame, expression: str) -> DataFrame:
    """One row ``violations``: how many rows break the predicate."""
    return df.agg(F.count_if(violates(expression)).alias("violations"))


def predicate_rows(df: DataFrame, expression: str) -> DataFrame:
    """The rows that break the predicate."""
    return df.filter(violates(expression))


# --------------------------------------------------------------------- key sets


def _key_names(count: int) -> list[str]:
    return [f"_k{i}" for i in range(count)]


def _keys(df: DataFrame, columns: Sequence[str], casts: Sequence[str | None]) -> list[Column]:
    """The key columns of a check: cast where two sides must agree, long texts digested."""
    out = []
    for name, column, cast in zip(_key_names(len(columns)), columns, casts):
        sql = group_key(quote_name(column), df.schema[column].dataType)
        out.append(F.expr(f"cast({sql} as {cast})" if cast else sql).alias(name))
    return out


def _key_counts(df: DataFrame, keys: Sequence[Column], skip_nulls: bool) -> DataFrame:
    """Each key once with its number of rows; tasks count their own rows first."""
    names = _key_names(len(keys))
    picked = df.select(*keys)
    if skip_nulls:
        picked = picked.filter(reduce(Column.__and__, [F.col(n).isNotNull() for n in names]))
    return picked.groupBy(*names).agg(F.count("*").alias("n"))


def repeated_keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row counts. NULLs are keys too."""
    keys = _keys(df, columns, [None] * len(columns))
    return _key_counts(df, keys, skip_nulls=False).filter("n > 1")


def _casts(child: DataFrame, columns, parent: DataFrame, parent_columns) -> list[str | None]:
    return [
        common_key_type(child.schema[c].dataType, parent.schema[p].dataType)
        for c, p in zip(columns, parent_columns)
    ]


def orphan_keys(
    child: DataFrame, columns: Sequence[str], parent: DataFrame, parent_columns: Sequence[str]
) -> DataFrame:
    """Child keys that no parent row has, with their row counts.

    Both sides are reduced to distinct keys before they meet, so the join moves keys
    instead of rows and no key is heavier than another. Keys with a NULL are skipped.
    """
    casts = _casts(child, columns, parent, parent_columns)
    names = _key_names(len(columns))
    held = _key_counts(child, _keys(child, columns, casts), skip_nulls=True)
    known = parent.select(*_keys(parent, parent_columns, casts)).distinct()
    return held.join(known, names, "left_anti")


def _total(keys: DataFrame) -> DataFrame:
    return keys.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("violations"))


def unique_violations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row ``violations``: all rows of every repeated key."""
    return _total(repeated_keys(df, columns))


def reference_violations(
    child: DataFrame, columns: Sequence[str], parent: DataFrame, parent_columns: Sequence[str]
) -> DataFrame:
    """One row ``violations``: child rows whose key no parent row has."""
    return _total(orphan_keys(child, columns, parent, parent_columns))


def orderable(df: DataFrame) -> list[Column]:
    """The columns rows can be ordered by, in order: all but maps and variants."""

    def can(data_type: T.DataType) -> bool:
        if isinstance(data_type, T.ArrayType):
            return can(data_type.elementType)
        if isinstance(data_type, T.StructType):
            return all(can(f.dataType) for f in data_type.fields)
        return not isinstance(data_type, (T.MapType, T.VariantType))

    return [F.col(quote_name(f.name)) for f in df.schema.fields if can(f.dataType)]


def _rows_of(
    df: DataFrame, keys: Sequence[Column], found: DataFrame, limit: int | None
) -> DataFrame:
    names = _key_names(len(keys))
    keyed = df.select("*", *keys)
    if limit is None:
        rows = rows_with_keys(keyed, found, names)
    else:
        rows = first_rows_with_keys(keyed, found, names, orderable(df), limit)
    return rows.drop(*names)


def duplicate_rows(
    df: DataFrame, columns: Sequence[str], *, total_rows: int | None = None, limit: int | None = None
) -> DataFrame:
    """All rows whose key occurs more than once, or the first ``limit`` by key.

    The table is read once for its keys and once for the rows. ``total_rows`` is not needed any more.
    """
    keys = _keys(df, columns, [None] * len(columns))
    return _rows_of(df, keys, repeated_keys(df, columns), limit)


def orphan_rows(
    child: DataFrame,
    columns: Sequence[str],
    parent: DataFrame,
    parent_columns: Sequence[str],
    *,
    total_rows: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """All child rows whose key no parent row has, or the first ``limit`` by key.

    The child is read once for its keys and once for the rows. ``total_rows`` is not needed any more.
    """
    keys = _keys(child, columns, _casts(child, columns, parent, parent_columns))
    found = orphan_keys(child, columns, parent, parent_columns)
    return _rows_of(child, keys, found, limit)


def violating_rows(catalog, check: Check, limit: int | None = PREVIEW_ROWS) -> DataFrame:
    """The rows that break a check: a preview, or all of them with ``limit=None``."""
    df = catalog.frame(check.table)
    if check.kind == "row_predicate":
        rows = predicate_rows(df, check.expression)
        # The same rows every time; each task keeps its first ones.
        return rows if limit is None else rows.orderBy(*orderable(df)).limit(limit)
    if check.kind == "unique":
        return duplicate_rows(df, check.columns, limit=limit)
    parent = catalog.frame(check.references_table)
    return orphan_rows(df, check.columns, parent, check.references_columns, limit=limit)


# --------------------------------------------------------------------- verdicts


def with_verdict(counts: DataFrame) -> DataFrame:
    """Add ``status`` and ``pct`` to rows of ``violations``, ``row_count``, ``reason``."""
    skipped = F.col("reason").isNotNull()
    return counts.withColumn(
        "status",
        F.when(skipped, F.lit("skipped"))
        .when(F.col("violations") == 0, F.lit("holds"))
        .otherwise(F.lit("falsified")),
    ).withColumn(
        "pct",
        F.when(skipped, F.lit(None).cast("double"))
        .when(F.col("row_count") == 0, F.lit(0.0))
        .otherwise(F.col("violations") / F.col("row_count") * 100),
    )


def _error_reason(error: PySparkException) -> str:
    """An error as text: its condition first, then the first line of its message."""
    message = str(error).strip().split("\n")[0]
    condition = error.getCondition()
    return message if condition is None or condition in message else f"[{condition}] {message}"


#: Expressions that no value of a row can make fail.
_NEVER_FAIL = frozenset(
    (
        "Alias", "And", "Or", "Not", "Literal", "AttributeReference", "EqualTo", "EqualNullSafe", "LessThan",
        "LessThanOrEqual", "GreaterThan", "GreaterThanOrEqual", "IsNull", "IsNotNull", "IsNaN", "In", "InSet", "Between",
        "Coalesce", "If", "CaseWhen", "NullIf", "Length", "OctetLength", "Upper", "Lower", "StringTrim",
        "StringTrimLeft", "StringTrimRight", "StartsWith", "EndsWith", "Contains", "Like", "Substring", "Concat",
    )
)

#: Names of expressions that a row predicate may not hold, whatever text they came from.
_FORBIDDEN = frozenset(
    (
        "ScalarSubquery", "Exists", "ListQuery", "InSubquery", "LateralSubquery", "ScalaUDF", "ScalaUDAF",
        "ScalaAggregator", "PythonUDF", "PythonUDAF", "HiveSimpleUDF", "HiveGenericUDF", "HiveUDAFFunction",
        "ApplyFunctionExpression", "CallMethodViaReflection", "TryReflect", "InputFileName", "InputFileBlockStart",
        "InputFileBlockLength", "SparkPartitionID", "MonotonicallyIncreasingID", "CurrentUser",
    )
)

#: Words of the grammar that a parenthesis may follow.
_GRAMMAR = frozenset(
    (
        "all", "and", "any", "as", "between", "by", "case", "cast", "distinct", "else", "end", "escape", "except",
        "extract", "filter", "in", "interval", "is", "like", "not", "null", "or", "over", "rlike", "some", "then", "try_cast",
        "when",
    )
)

#: SQL functions of the session that predicates may call.
_OWN_FUNCTIONS = ("regexp_matches", "strftime")


@dataclass
class _Inspected:
    """What the analysed plan of one predicate shows."""

    text_casts: list[str]
    forbidden: list[str]
    can_fail: bool


def inspect_predicate(spark: SparkSession, df: DataFrame) -> _Inspected:
    """Look through the expressions of a frame's last step.

    ``'0001' > 0`` would silently compare numbers, so unasked casts of text are listed.
    Subqueries, user functions and whatever is not deterministic are listed by name. Only the
    analysed plan shows these for certain, and only a classic session shows the plan.
    """
    jvm = spark._jvm.org.apache.spark.sql.catalyst.expressions
    asked_for = jvm.Cast.USER_SPECIFIED_CAST()
    found = _Inspected([], [], False)

    def visit(node) -> None:
        name = node.getClass().getSimpleName()
        if name == "Cast":
            source, target = node.child().dataType(), node.dataType()
            unasked = not node.getTagValue(asked_for).isDefined()
            if unasked and source.typeName() == "string" != target.typeName() and not node.child().foldable():
                found.text_casts.append(target.typeName())
            if not jvm.Cast.canUpCast(source, target) and target.typeName() != "string":
                found.can_fail = found.can_fail or not node.child().foldable()
        elif name == "SQLScalarFunction":
            called = node.function().name().funcName()
            if called not in _OWN_FUNCTIONS:
                found.forbidden.append(called)
            found.can_fail = True
        elif name in _FORBIDDEN:
            found.forbidden.append(name)
        elif name not in _NEVER_FAIL:
            found.can_fail = True
        children = node.children()
        for i in range(children.size()):
            visit(children.apply(i))

    expressions = df._jdf.queryExecution().analyzed().expressions()
    for i in range(expressions.size()):
        node = expressions.apply(i)
        if not node.deterministic():
            found.forbidden.append("a value that changes from run to run")
        visit(node)
    return found


def foreign_function(spark: SparkSession, expression: str, known: dict[str, bool] | None = None) -> str | None:
    """A function the predicate calls that is neither Spark's own nor ours, or None.

    Functions registered in the session or the catalog run whatever their owner wrote; SQL ones
    are inlined before the plan can show them. ``known`` keeps what is found out about names for a batch.
    """
    known = {} if known is None else known
    for name in sorted(called_names(expression) - _GRAMMAR - set(_OWN_FUNCTIONS)):
        if name not in known:
            known[name] = _is_foreign(spark, name)
        if known[name]:
            return name
    return None


def _is_foreign(spark: SparkSession, name: str) -> bool:
    catalog = spark._jsparkSession.sessionState().catalog()
    builtin = spark._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin()
    called = spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name)
    if catalog.isTemporaryFunction(called) or catalog.isPersistentFunction(called) or name == "0q":
        return True
    return not builtin.functionExists(called) and "." in name


def _inspected(df: DataFrame, expression: str) -> tuple[str | None, bool]:
    """Why Spark cannot or may not evaluate a predicate on a table, or None; whether a row can make it fail."""
    if not hasattr(df, "_jdf"):
        return "Predicates are run in classic sessions only, where their plans can be inspected.", False
    foreign = foreign_function(df.sparkSession, expression)
    if foreign is not None:
        return f'Function "{foreign}" is not allowed.', False
    try:
        bound = df.filter(F.expr(spark_expression(expression)).cast("boolean"))
        seen = inspect_predicate(df.sparkSession, bound)
    except PySparkException as error:
        return _error_reason(error), False
    if seen.forbidden:
        return f'Function "{seen.forbidden[0]}" is not allowed.', False
    if seen.text_casts:
        return f"Cannot compare string with {seen.text_casts[0]} without a cast: type mismatch.", False
    return None, seen.can_fail


class _UpCasts:
    """Which casts between types never fail; each pair is asked for once."""

    def __init__(self, spark: SparkSession):
        self._types = spark._jvm.org.apache.spark.sql.types.DataType
        self._cast = spark._jvm.org.apache.spark.sql.catalyst.expressions.Cast
        self._known: dict[tuple[str, str], bool] = {}

    def allows(self, source, target) -> bool:
        pair = json.dumps(source), json.dumps(target)
        if pair not in self._known:
            self._known[pair] = self._cast.canUpCast(*map(self._types.fromJson, pair))
        return self._known[pair]


#: Expressions that yield true, false or NULL.
_TRUTHS = frozenset(
    (
        "And", "Or", "Not", "EqualTo", "EqualNullSafe", "LessThan", "LessThanOrEqual", "GreaterThan", "GreaterThanOrEqual",
        "IsNull", "IsNotNull", "IsNaN", "In", "InSet", "Between", "StartsWith", "EndsWith", "Contains", "Like", "RLike",
    )
)


def _read_tree(tree: list[dict], casts: _UpCasts) -> bool | None:
    """Whether a row can make a predicate fail, from its analysed tree in prefix order.

    None where the tree does not tell enough, or holds something that may be forbidden: such
    a predicate is looked through node by node. That goes for casts from or to text, since
    only the nodes themselves know whether a cast was asked for.
    """
    can_fail = False
    for node, child in zip(tree, [*tree[1:], {"class": ""}]):
        name, below = (n["class"].rpartition(".")[2] for n in (node, child))
        if name == "Cast":
            if below == "Literal" or (below in _TRUTHS and node["dataType"] == "boolean"):
                continue
            source, target = child.get("dataType"), node["dataType"]
            if below != "AttributeReference" or (source == "string") != (target == "string"):
                return None
            can_fail = can_fail or (target != "string" and not casts.allows(source, target))
        elif name in _FORBIDDEN or name == "SQLScalarFunction":
            return None
        elif name not in _NEVER_FAIL:
            can_fail = True
    return can_fail


def inspected_together(df: DataFrame, expressions: Sequence[str]) -> list[tuple[str | None, bool]]:
    """:func:`_inspected` of many predicates of a table, analysed as one plan of which each tree is read once.

    Where the plan as a whole cannot be analysed, or some predicate turns it into more than a
    projection of the table, halves are tried, down to single predicates.
    """
    if not expressions:
        return []
    if len(expressions) == 1 or not hasattr(df, "_jdf"):
        return [_inspected(df, e) for e in expressions]
    spark, known = df.sparkSession, {}
    foreign = [foreign_function(spark, e, known) for e in expressions]
    own = [e for e, name in zip(expressions, foreign) if name is None]
    seen = iter(_inspected_as_one(df, own, _UpCasts(spark)))
    return [next(seen) if name is None else (f'Function "{name}" is not allowed.', False) for name in foreign]


def _inspected_as_one(df: DataFrame, expressions: Sequence[str], casts: _UpCasts) -> list[tuple[str | None, bool]]:
    if len(expressions) <= 1:
        return [_inspected(df, e) for e in expressions]
    if len(expressions) <= EXPRESSION_BUDGET:
        mark = f"_{uuid.uuid4().hex}_"  # names that no predicate can mean
        try:
            listed = [F.expr(spark_expression(e)).cast("boolean").alias(f"{mark}{i}") for i, e in enumerate(expressions)]
            plan = df.select(*listed)._jdf.queryExecution().analyzed()
        except PySparkException:
            plan = None
        whole = plan is not None and plan.getClass().getSimpleName() == "Project"
        if whole and plan.child().equals(df._jdf.queryExecution().analyzed()):
            out = []
            for i, expression in enumerate(expressions):
                node = plan.projectList().apply(i)
                can_fail = _read_tree(json.loads(node.toJSON()), casts) if node.deterministic() else None
                out.append((None, can_fail) if can_fail is not None else _inspected(df, expression))
            return out
    half = len(expressions) // 2
    return _inspected_as_one(df, expressions[:half], casts) + _inspected_as_one(df, expressions[half:], casts)


def predicate_reason(df: DataFrame, expression: str) -> str | None:
    """Why Spark cannot or may not evaluate a predicate on a table, or None. Starts no job."""
    return _inspected(df, expression)[0]


@dataclass
class _Outcome:
    violations: int | None = None
    reason: str | None = None
    ms: int | None = None


@dataclass(frozen=True)
class _Asked:
    """A check to run: its place in the batch, which nothing else shares, and whether a row can make it fail."""

    place: int
    check: Check
    can_fail: bool = False


def _is_the_checks_fault(error: PySparkException) -> bool:
    """Whether an error comes from what a check computes, not from files, executors or the session."""
    try:
        if error.getQueryContext():
            return True
    except Exception:  # some errors carry no context
        pass
    return (error.getSqlState() or "").startswith(("22", "42", "P0"))


def _suspects(error: PySparkException, batch: Sequence[_Asked]) -> set[int]:
    """Places of the checks whose text holds the fragment an error points at."""
    try:
        fragments = [c.fragment() for c in error.getQueryContext()]
    except Exception:  # some errors carry no context
        return set()
    return {a.place for a in batch for f in fragments if f and f in spark_expression(a.check.expression)}


def _predicate_counts(catalog, batch: Sequence[_Asked]) -> list[DataFrame]:
    """Frames ``(place, n)``: one aggregate per table and ``COMPILED_TOGETHER`` different predicates."""
    parts = []
    for table in dict.fromkeys(a.check.table for a in batch):
        asked: dict[str, list[int]] = {}
        for a in batch:
            if a.check.table == table:
                asked.setdefault(violates_sql(a.check.expression), []).append(a.place)
        mine = list(asked.items())
        for at in range(0, len(mine), COMPILED_TOGETHER):
            chunk = mine[at : at + COMPILED_TOGETHER]
            counts = [f"count_if({violated}) as n{i}" for i, (violated, _) in enumerate(chunk)]
            pairs = ", ".join(f"named_struct('place', {p}, 'n', n{i})" for i, (_, places) in enumerate(chunk) for p in places)
            parts.append(catalog.frame(table).selectExpr(*counts).selectExpr(f"inline(array({pairs}))"))
    return parts


def _count_predicates(catalog, batch: Sequence[_Asked], out: dict[int, _Outcome]) -> None:
    """Count all predicates: one job for those that no row can make fail, one for the others.

    When one of the others fails, they are split and run again, so that only that predicate
    is skipped and no finished count is lost. Errors that are not a predicate's fault are raised.
    """
    for can_fail in (False, True):
        _run_predicates(catalog, [a for a in batch if a.can_fail == can_fail], out)


def _run_predicates(catalog, batch: Sequence[_Asked], out: dict[int, _Outcome]) -> None:
    if not batch:
        return
    started = time.monotonic()
    try:
        rows = reduce(DataFrame.unionByName, _predicate_counts(catalog, batch)).collect()
    except PySparkException as error:
        if not _is_the_checks_fault(error):
            raise
        if len(batch) == 1:
            out[batch[0].place] = _Outcome(reason=_error_reason(error))
            return
        suspects = _suspects(error, batch)
        first = [a for a in batch if a.place in suspects]
        rest = [a for a in batch if a.place not in suspects]
        if not first or not rest:
            first, rest = batch[: len(batch) // 2], batch[len(batch) // 2 :]
        _run_predicates(catalog, first, out)
        _run_predicates(catalog, rest, out)
        return
    ms = round((time.monotonic() - started) * 1000 / len(batch))
    for row in rows:
        out[row["place"]] = _Outcome(violations=row["n"], ms=ms)


def _count_keys(catalog, batch: Sequence[_Asked], out: dict[int, _Outcome]) -> None:
    """Count all uniqueness and reference checks, many to a job; equal checks run once."""
    asked: dict[tuple, list[_Asked]] = {}
    for a in batch:
        c = a.check
        columns = tuple(sorted(c.columns)) if c.kind == "unique" else c.columns
        key = (c.kind, c.table, columns, c.references_table, c.references_columns)
        asked.setdefault(key, []).append(a)
    built = []
    for (kind, table, columns, parent, parent_columns), same in asked.items():
        df = catalog.frame(table)
        try:
            if kind == "unique":
                counted = unique_violations(df, columns)
            else:
                counted = reference_violations(df, columns, catalog.frame(parent), parent_columns)
            built.append((counted, same))
        except PySparkException as error:  # a type Spark cannot group or cast
            for a in same:
                out[a.place] = _Outcome(reason=_error_reason(error))
    for at in range(0, len(built), KEY_CHECKS_PER_JOB):
        _run_key_counts(built[at : at + KEY_CHECKS_PER_JOB], out)


def _run_key_counts(built: Sequence[tuple[DataFrame, list[_Asked]]], out: dict[int, _Outcome]) -> None:
    if not built:
        return
    parts = [counted.select(F.lit(i).alias("i"), "violations") for i, (counted, _) in enumerate(built)]
    started = time.monotonic()
    try:
        rows = reduce(DataFrame.unionByName, parts).collect()
    except PySparkException as error:
        if not _is_the_checks_fault(error):
            raise
        if len(built) == 1:
            for a in built[0][1]:
                out[a.place] = _Outcome(reason=_error_reason(error))
            return
        half = len(built) // 2
        _run_key_counts(built[:half], out)
        _run_key_counts(built[half:], out)
        return
    ms = round((time.monotonic() - started) * 1000 / sum(len(same) for _, same in built))
    for row in rows:
        for a in built[row["i"]][1]:
            out[a.place] = _Outcome(violations=row["violations"], ms=ms)


def evaluate_checks(catalog, checks: DataFrame) -> DataFrame:
    """Run a batch of checks; one result row per check, see ``RESULT_SCHEMA``.

    A check that cannot run is ``skipped`` with a reason and never hurts the others. Checks
    are told apart by their place, so ids may repeat and hold any text. The checks and
    their counts pass through the driver; rows of the tables do not.
    """
    spark = catalog.spark
    rows = admit_checks(checks, catalog.schemas()).collect()
    admitted = [Check.from_row(r) for r in rows]
    refused = {i for i, r in enumerate(rows) if r["reason"] is not None}
    out = {i: _Outcome(reason=rows[i]["reason"]) for i in refused}
    can_fail: dict[int, bool] = {}
    predicates: dict[str, list[int]] = {}
    for i, check in enumerate(admitted):
        if i not in out and check.kind == "row_predicate":
            predicates.setdefault(check.table, []).append(i)
    for table, places in predicates.items():
        seen = inspected_together(catalog.frame(table), [admitted[i].expression for i in places])
        for i, (reason, can_fail[i]) in zip(places, seen):
            if reason is not None:
                out[i] = _Outcome(reason=reason)
    todo = [_Asked(i, check, can_fail.get(i, False)) for i, check in enumerate(admitted) if i not in out]
    _count_predicates(catalog, [a for a in todo if a.check.kind == "row_predicate"], out)
    _count_keys(catalog, [a for a in todo if a.check.kind != "row_predicate"], out)

    counts = catalog.row_counts(dict.fromkeys(a.check.table for a in todo))
    results = [
        (
            c.id,
            out[i].violations,
            None if out[i].reason else counts.get(c.table),
            out[i].reason,
            out[i].ms,
            None if i in refused else c.sql(),
        )
        for i, c in enumerate(admitted)
    ]
    frame = local_frame(
        spark,
        results, "id string, violations bigint, row_count bigint, reason string, ms bigint, sql string"
    )
    return with_verdict(frame).select(*[f.split()[0] for f in RESULT_SCHEMA.split(", ")])
