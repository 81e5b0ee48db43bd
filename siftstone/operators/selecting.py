"""Filtered selects, aggregates by name, top-N and guarded SQL."""

from __future__ import annotations

import re
import threading
import time
import uuid
from collections.abc import Mapping, Sequence
from contextlib import contextmanager
from functools import reduce
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import ref
from ..session import cut_lineage
from .quantiles import grouped_quantiles

_COMPARISONS = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "LIKE": lambda c, v: c.like(v),
    "IN": lambda c, v: c.isin(list(v)),
    "IS NULL": lambda c, v: c.isNull(),
    "IS NOT NULL": lambda c, v: c.isNotNull(),
}
_AGGREGATES = {
    "SUM": F.sum,
    "AVG": F.avg,
    "COUNT": F.count,
    "MIN": F.min,
    "MAX": F.max,
    "STDDEV": F.stddev_samp,
    "VAR_POP": F.var_pop,
    "LIST": F.collect_list,
}


def predicate(filters: Sequence[Mapping[str, Any]]) -> Column:
    """All conditions joined by AND. An unknown operator is an error."""
    conditions = []
    for item in filters:
        op = item["op"].upper()
        if op not in _COMPARISONS:
            raise ValueError(f"unsupported operator: {item['op']!r}")
        conditions.append(_COMPARISONS[op](ref(item["column"]), item.get("value")))
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def filter_rows(df, filters=(), columns=None, limit=None) -> DataFrame:
    """All rows that meet the filters; ``limit`` takes any so many of them."""
    out = df.where(predicate(filters)) if filters else df
    out = out.select(*[ref(c) for c in columns]) if columns else out
    return out.limit(limit) if limit else out


def ordering(order_by: Sequence[Mapping[str, Any]]) -> list[Column]:
    return [ref(o["column"]).desc() if o.get("desc") else ref(o["column"]).asc() for o in order_by]


def aggregate(
    df: DataFrame,
    func: str,
    column: str | None = None,
    group_by: Sequence[str] = (),
    filters: Sequence[Mapping[str, Any]] = (),
    order_by: Sequence[Mapping[str, Any]] = (),
    limit: int | None = None,
    order_key: str | None = None,
) -> DataFrame:
    """One aggregate by name, column ``{func}_{column}``.

    FIRST and LAST need ``order_key``: Spark rows have no position. MEDIAN goes
    through the rank search, so a group of any size is fine.
    """
    func = func.upper()
    group_by = list(group_by or [])
    data = df.where(predicate(filters)) if filters else df
    keys = [ref(c) for c in group_by]
    if func == "COUNT_STAR":
        if column is not None:
            raise ValueError("COUNT_STAR takes no column")
        out = data.groupBy(*keys).agg(F.count("*").alias("count_star"))
    else:
        if func not in {*_AGGREGATES, "MEDIAN", "FIRST", "LAST"}:
            raise ValueError(f"unsupported aggregate: {func!r}")
        if column is None:
            raise ValueError(f"{func} needs a column")
        name = f"{func.lower()}_{column}"
        if func == "MEDIAN":
            found = grouped_quantiles(data, group_by, column, [0.5])
            out = found.select(*keys, F.col("q")[0].alias(name))
            if group_by:
                # groups whose values are all null keep a row, with a null median
                groups = data.groupBy(*keys).agg(F.count(ref(column)).alias("_n"))
                empty = groups.where(F.col("_n") == 0).select(*keys, F.lit(None).cast("double").alias(name))
                out = out.unionByName(empty)
        elif func in ("FIRST", "LAST"):
            if order_key is None:
                raise ValueError(f"{func} needs order_key")
            pick = F.min_by if func == "FIRST" else F.max_by
            out = data.groupBy(*keys).agg(pick(ref(column), ref(order_key)).alias(name))
        else:
            out = data.groupBy(*keys).agg(_AGGREGATES[func](ref(column)).alias(name))
    if order_by:
        out = out.orderBy(*ordering(order_by))
    return out.limit(limit) if limit else out


def top_n(
    df: DataFrame,
    rank_column: str,
    n: int = 10,
    columns: Sequence[str] = (),
    ascending: bool = False,
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """The n first rows by a column; ``columns`` only narrows the output."""
    order = ref(rank_column).asc() if ascending else ref(rank_column).desc()
    out = df.orderBy(order, *[ref(c) for c in tie_break]).limit(int(n))
    return out.select(*[ref(c) for c in columns]) if columns else out


def top_n_per_group(
    df: DataFrame,
    group_by: Sequence[str],
    rank_column: str,
    n: int = 10,
    ascending: bool = False,
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """The n first rows of every group. Spark applies the rank limit before the shuffle."""
    order = ref(rank_column).asc() if ascending else ref(rank_column).desc()
    window = Window.partitionBy(*[ref(c) for c in group_by]).orderBy(order, *[ref(c) for c in tie_break])
    return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)


# ── guarded SQL ─────────────────────────────────────────────────────────────

#: Functions that a guarded query may call; none reads files, runs code or tells about the session.
ALLOWED_FUNCTIONS = frozenset(
    """abs acos any_value approx_count_distinct approx_percentile array array_agg array_contains array_distinct array_join array_max
    array_min ascii asin atan atan2 avg between bool_and bool_or btrim cardinality cbrt ceil ceiling char_length coalesce collect_list collect_set concat concat_ws contains corr cos count count_if
    covar_pop covar_samp cume_dist current_date current_timestamp date date_add date_diff date_format date_part date_sub date_trunc
    dateadd datediff datepart day dayname dayofmonth dayofweek dayofyear decimal degrees dense_rank double e element_at endswith equal_null
    every exp explode extract filter first first_value flatten float floor format_number from_unixtime greatest grouping grouping_id
    hour if ifnull ilike initcap instr int isnan isnotnull isnull kurtosis lag last last_day last_value lcase lead least left len length
    levenshtein like ln locate log log10 log2 lower lpad ltrim make_date map map_keys map_values max max_by mean median min min_by minute mod
    mode month monthname months_between named_struct nanvl negative now nth_value ntile nullif nullifzero nvl nvl2 percent_rank percentile
    percentile_approx percentile_cont percentile_disc pi pmod posexplode position positive pow power quarter radians rank
    regexp_count regexp_extract regexp_extract_all regexp_instr regexp_like regexp_replace regexp_substr regr_count regr_intercept regr_r2
    regr_slope repeat replace reverse right rint round row_number rpad rtrim second sequence sign signum sin size skewness slice some
    sort_array split split_part sqrt startswith std stddev stddev_pop stddev_samp string struct substr substring sum tan tanh
    timestamp timestampadd timestampdiff to_char to_date to_number to_timestamp transform translate trim trunc try_add try_avg try_cast
    try_divide try_multiply try_subtract try_sum try_to_date try_to_number try_to_timestamp typeof ucase unix_date unix_timestamp upper var_pop
    var_samp variance weekday weekofyear when width_bucket year zeroifnull""".split()
)
#: Steps that a guarded query may consist of.
_ALLOWED_STEPS = frozenset(
    """Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Join SubqueryAlias UnresolvedRelation Distinct Union Intersect Except
    UnresolvedInlineTable LocalRelation OneRowRelation UnresolvedHaving WithWindowDefinition Generate LateralJoin
    UnresolvedSubqueryColumnAliases""".split()
)


#: Expressions that a parsed query may consist of; names are looked up above. Anything else is refused, known or not.
_ALLOWED_EXPRESSIONS = frozenset(
    """Add AggregateExpression Alias And AnyValue AttributeReference Between BitwiseAnd BitwiseNot BitwiseOr BitwiseXor CaseWhen Cast Concat
    CreateNamedStruct Cube CurrentRow Divide EqualNullSafe EqualTo Exists First GreaterThan GreaterThanOrEqual GroupingSets ILike In
    InSubquery IntegralDivide IsNotNull IsNull LambdaFunction Last LateralSubquery LessThan LessThanOrEqual Like LikeAll LikeAny ListQuery
    Literal Multiply Not NotLikeAll NotLikeAny Or Overlay RLike Remainder Rollup ScalarSubquery SortOrder SpecifiedWindowFrame StringLocate
    StringTrim StringTrimBoth StringTrimLeft StringTrimRight Substring Subtract UnaryMinus UnaryPositive UnboundedFollowing UnboundedPreceding
    UnresolvedAlias UnresolvedAttribute UnresolvedExtractValue UnresolvedFunction UnresolvedGenerator UnresolvedInlineTable
    UnresolvedNamedLambdaVariable UnresolvedOrdinal UnresolvedStar UnresolvedStarExceptOrReplace UnresolvedWindowExpression UnspecifiedFrame
    WindowExpression WindowSpecDefinition""".split()
)
#: What may not stand in a resolved query, by whatever name it got there.
_REFUSED_WHEN_RESOLVED = frozenset(
    """CallMethodViaReflection TryReflect ScalaUDF PythonUDF PythonUDAF ScalaAggregator ScalaUDAF SQLFunctionExpression SQLScalarFunction PythonUDTF
    UserDefinedExpression CurrentUser CurrentCatalog CurrentDatabase CurrentSchema SparkVersion InputFileName InputFileBlockStart
    InputFileBlockLength RaiseError SparkPartitionID MonotonicallyIncreasingID""".split()
)


def _each(scala_seq):
    return [scala_seq.apply(i) for i in range(scala_seq.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


_SUBQUERIES = ("ScalarSubquery", "ListQuery", "Exists", "LateralSubquery")


def _refusal(plan, views: Sequence[str]) -> str | None:
    """Why a parsed, unresolved plan is refused; null if every step, relation, expression and function in it is allowed."""
    steps, expressions = [plan], []
    while steps or expressions:
        if steps:
            node = steps.pop()
            kind = _kind(node)
            if kind not in _ALLOWED_STEPS:
                return f"step {kind}"
            if kind == "UnresolvedRelation":
                name = [str(n) for n in _each(node.multipartIdentifier())]
                if len(name) != 1 or name[0].lower() not in views:
                    return f"relation {'.'.join(name)}"
            steps += _each(node.children())
            expressions += _each(node.expressions())
            if kind == "Generate":
                expressions.append(node.generator())
            continue
        node = expressions.pop()
        kind = _kind(node)
        if kind not in _ALLOWED_EXPRESSIONS:
            return f"expression {kind}"
        if kind in ("UnresolvedFunction", "UnresolvedGenerator"):
            name = [str(n) for n in _each(node.nameParts())] if kind == "UnresolvedFunction" else [str(node.name().funcName())]
            if len(name) != 1 or name[0].lower() not in ALLOWED_FUNCTIONS:
                return f"function {'.'.join(name)}"
        if kind in _SUBQUERIES:
            steps.append(node.plan())
        expressions += _each(node.children())
    return None


def _refusal_when_resolved(plan, own: set[str]) -> str | None:
    """The same of the analysed plan, outside the bound views: no relation but those, and no call into the JVM or the session."""
    steps, expressions = [plan], []
    while steps or expressions:
        if steps:
            node = steps.pop()
            kind = _kind(node)
            if kind == "View":
                if node.desc().identifier().table() not in own:
                    return "another view"
                continue  # what a caller binds is the caller's
            children = _each(node.children())
            if not children and kind not in ("OneRowRelation", "LocalRelation", "CTERelationRef"):
                return f"relation {kind}"
            steps += children
            expressions += _each(node.expressions())
            continue
        node = expressions.pop()
        kind = _kind(node)
        if kind in _REFUSED_WHEN_RESOLVED:
            return f"expression {kind}"
        if kind in _SUBQUERIES:
            steps.append(node.plan())
        expressions += _each(node.children())
    return None


def run_sql(spark: SparkSession, sql: str, views: Mapping[str, DataFrame], row_limit: int | None = None) -> DataFrame:
    """A SELECT over the given views only; at most ``row_limit`` of its rows, if given.

    Spark parses the text, and the plan is checked before anything is resolved: the only relations are the given views, the only functions those in
    ``ALLOWED_FUNCTIONS``, and every step and expression is of a listed kind. The resolved plan is checked again, since a name may turn out to be something
    else. The views are bound under names of their own, so the caller's views stay as they are. Anything else raises ValueError. A fence
    around the text and comments in it are no matter.
    """
    text = re.sub(r"\A\s*```\w*|```\s*\Z", "", sql or "").strip().rstrip(";")
    if not text:
        raise ValueError("empty query")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as exc:
        raise ValueError(f"not one readable SELECT: {str(exc)[:200]}") from exc
    reason = _refusal(plan, [v.lower() for v in views])
    if reason:
        raise ValueError(f"not allowed in a query: {reason}")
    own = {name: f"siftstone_{uuid.uuid4().hex}" for name in views}
    for name, df in views.items():
        df.createTempView(own[name])
    try:
        bound = ", ".join(f"`{name}` AS (SELECT * FROM {view})" for name, view in own.items())
        out = spark.sql(f"WITH {bound} {text}" if own else text)
        reason = _refusal_when_resolved(out._jdf.queryExecution().analyzed(), set(own.values()))
        if reason:
            raise ValueError(f"not allowed in a query: {reason}")
    finally:
        for view in own.values():
            spark.catalog.dropTempView(view)
    return out if row_limit is None else out.limit(row_limit)


@contextmanager
def time_limit(spark: SparkSession, seconds: float | None):
    """Ends what this thread runs in the session after so many seconds, in the executors too; then TimeoutError is raised. Other work goes on.

    The jobs get a tag of their own, and a watcher cancels that tag alone, again and again, as a job may begin just after. It is a tag of the
    context: once a session has had tags of its own, it can no longer be sent along with a forest model, which holds its session.
    """
    if seconds is None:
        yield
        return
    context, tag, over, done = spark.sparkContext, f"siftstone-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def stop():
        over.set()
        while not done.is_set():
            context.cancelJobsWithTag(tag)
            done.wait(0.5)

    watcher = threading.Timer(seconds, stop)
    watcher.daemon = True
    context.addJobTag(tag)
    watcher.start()
    try:
        yield
    except Exception as exc:
        if over.is_set():
            raise TimeoutError(f"over {seconds} seconds") from exc
        raise
    finally:
        done.set()
        watcher.cancel()
        context.removeJobTag(tag)
    if over.is_set():  # between two jobs nothing is there to cancel
        raise TimeoutError(f"over {seconds} seconds")


class SqlPage(NamedTuple):
    rows: DataFrame
    row_count: int
    truncated: bool
    seconds: float


def run_sql_page(spark: SparkSession, sql: str, views: Mapping[str, DataFrame], row_limit: int = 10_000, timeout: float | None = 30) -> SqlPage:
    """A bounded page of the result, run once: its rows, their number, whether the result has more, and how long it took.

    A query that takes longer than ``timeout`` seconds is cancelled and raises TimeoutError.
    """
    begin = time.perf_counter()
    with time_limit(spark, timeout):
        probe = cut_lineage(run_sql(spark, sql, views, row_limit + 1))
        found = probe.count()
    return SqlPage(probe.limit(row_limit), min(found, row_limit), found > row_limit, time.perf_counter() - begin)


def describe(df: DataFrame) -> DataFrame:
    """``column_name, column_type, nullable`` in column order."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(
        rows, "ordinal int, column_name string, column_type string, nullable boolean"
    )


def sample_rows(df: DataFrame, n: int | None = None, fraction: float | None = None, seed: int = 42) -> DataFrame:
    """A row sample for a first look: the first ``n`` rows Spark finds, or a seeded fraction."""
    if (n is None) == (fraction is None):
        raise ValueError("give either n or fraction")
    return df.limit(n) if n is not None else df.sample(fraction=fraction, seed=seed)
