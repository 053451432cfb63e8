"""Read-only contract over the metric tables, checked on the parsed plan without running anything."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from questlake.schema import ALLOWED_DIMS, METRICS

DEFAULT_SCHEMA = "ads"
# The column kinds of the served tables.
COLUMN_TYPES = {
    "dt": "date", "cohort_dt": "date", "server_id": "int", "n_days": "int", "dungeon_id": "int", "metric_id": "string",
    "dau": "bigint", "pay_users": "bigint", "players": "bigint", "total_online_sec": "bigint", "cohort_size": "bigint", "retained_cnt": "bigint",
    "enter_cnt": "bigint", "clear_cnt": "bigint", "active_7d_users": "bigint", "churn_risk_users": "bigint",
    "pay_rate": "double", "revenue_cny": "double", "arpu_cny": "double", "avg_online_sec": "double", "clear_rate": "double", "retention_rate": "double", "churn_risk_rate": "double",
}
#: Served tables have no window_complete: every row that is served is complete.
CATALOG = {m.metric_id: {c: COLUMN_TYPES[c] for c in m.columns if c != "window_complete"} for m in METRICS.values()}
READ_NODES = {
    "Project", "Filter", "Sort", "Aggregate", "Join", "GlobalLimit", "LocalLimit", "SubqueryAlias", "UnresolvedRelation", "Distinct", "Union",
    "UnresolvedHaving", "UnresolvedWith", "WithCTE", "OneRowRelation", "Window", "Offset", "UnresolvedSubqueryColumnAliases", "UnresolvedInlineTable",
}


#: Functions of a read: aggregates, windows, dates, text and numbers, none of which reaches outside of the query.
FUNCTIONS = frozenset(
    "abs add_months any_value approx_count_distinct array avg bool_and bool_or cast ceil ceiling coalesce concat concat_ws count count_if date date_add date_diff "
    "date_format date_sub date_trunc datediff day dayofmonth dense_rank double first first_value floor greatest if ifnull int bigint string isnotnull isnull lag last "
    "last_value lead least length lower max max_by mean median min min_by mod month nullif nvl percentile percentile_approx percent_rank rank replace round row_number "
    "sign stddev substr substring sum to_date trim try_divide upper variance weekofyear when year".split()
)


@dataclass(frozen=True)
class Verdict:
    allowed: bool
    reason: str


def _seq(values):
    return (values.apply(i) for i in range(values.length()))


def _walk(node):
    """All logical nodes, those of subqueries and CTEs included."""
    yield node
    for seq in (node.children(), node.innerChildren(), node.subqueries()):
        for child in _seq(seq):
            if hasattr(child, "children"):
                yield from _walk(child)


def _expressions(node):
    held = list(_seq(node.expressions()))
    while held:
        one = held.pop()
        yield one
        held += list(_seq(one.children()))


def _kind(thing) -> str:
    return thing.getClass().getSimpleName().rstrip("$") or thing.getClass().getName()


def _place(thing) -> tuple[int, int]:
    """Where the parser found it: first and last character."""
    return thing.origin().startIndex().get(), thing.origin().stopIndex().get()


def check(spark: SparkSession, sql: str) -> Verdict:
    """Only SELECTs over allow-listed tables (bare or `ads.` names), known columns and allow-listed functions pass.

    The statement is parsed, never run. Names are then looked up in empty relations with
    the served columns, which take the tables' places at the positions where the parser
    found them, so text in literals and comments is never touched.
    """
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException as e:
        return Verdict(False, f"unreadable: {str(e).splitlines()[0]}")
    nodes = list(_walk(plan))
    own = {cte._1().lower() for node in nodes if _kind(node) == "UnresolvedWith" for cte in _seq(node.cteRelations())}
    aliased = {_place(child) for node in nodes if _kind(node) == "SubqueryAlias" for child in _seq(node.children()) if _kind(child) == "UnresolvedRelation"}
    changes: dict[tuple[int, int], str] = {}
    for node in nodes:
        kind = _kind(node)
        if kind == "UnresolvedRelation":
            name = tuple(p.lower() for p in _seq(node.multipartIdentifier()))
            if len(name) == 1 and name[0] in own:
                continue
            if name[-1] not in CATALOG or name[:-1] not in ((), (DEFAULT_SCHEMA,)):
                return Verdict(False, f"table {'.'.join(name)} is not on the list")
            empty = ", ".join(f"CAST(NULL AS {t}) AS `{c}`" for c, t in CATALOG[name[-1]].items())
            changes[_place(node)] = f"(SELECT {empty} WHERE false)" + ("" if _place(node) in aliased else f" AS {name[-1]}")
        elif kind not in READ_NODES:
            return Verdict(False, f"{kind} is not a read")
        for e in _expressions(node):
            if _kind(e) == "UnresolvedFunction":
                called = [p.lower() for p in _seq(e.nameParts())]
                if len(called) > 1 or called[0] not in FUNCTIONS:
                    return Verdict(False, f"function {'.'.join(called)} is not on the list")
            elif _kind(e) == "UnresolvedAttribute":
                parts = list(_seq(e.nameParts()))
                if len(parts) > 2 and parts[0].lower() == DEFAULT_SCHEMA and parts[1].lower() in CATALOG:
                    changes[_place(e)] = ".".join(f"`{p}`" for p in parts[1:])
    text = sql
    for (first, last), put in sorted(changes.items(), reverse=True):
        text = text[:first] + put + text[last + 1 :]
    try:
        spark.sql(text).schema  # analysis only: every node is a read
    except (AnalysisException, ParseException) as e:
        return Verdict(False, f"analysis: {str(e).splitlines()[0]}")
    return Verdict(True, "ok")


class UnknownDimension(ValueError):
    """A dimension that a metric may not be cut by."""


def allowed_dims(metric_id: str) -> tuple[str, ...]:
    """The dimensions that a metric has and may be filtered or grouped by."""
    return tuple(c for c in METRICS[metric_id].columns if c in ALLOWED_DIMS)


def cut(metric: DataFrame, metric_id: str, by: Sequence[str] = (), **where) -> DataFrame:
    """A metric's rows filtered and ordered by allowed dimensions; any other name is an error."""
    for name in (*by, *where):
        if name not in allowed_dims(metric_id):
            raise UnknownDimension(f"{metric_id} has no dimension {name}")
    for name, value in where.items():
        metric = metric.where(F.col(name) == value)
    return metric.orderBy(*by) if by else metric
