"""SQL for the training-data queries.

`p3_percentiles` and the `p6_` queries are exact where groups fit into a sketch, as they
do at the size of the comparison; `p3_rank_error` and `p6_bounds` put sketches that are
far too small for that beside exact figures, and the SQL says that the stated bounds
hold. Packing, leakage and language can't be told in SQL: `p8_check`, `p9_planted` and
`p10_samples` are properties that must hold, and the tests compare with brute force.
"""

from __future__ import annotations

from questlake.llm.queries import PERCENTILES

_VALUES = """v AS (
  SELECT server_id, CAST(event_time AS DATE) AS dt, 'online_sec' AS metric,
    CAST(COALESCE(online_sec, TRY_CAST(json_extract_string(payload, '$.online_sec') AS INTEGER)) AS BIGINT) AS value FROM ods_player_events
  UNION ALL SELECT server_id, CAST(event_time AS DATE), 'amount_fen',
    COALESCE(amount_fen, TRY_CAST(json_extract_string(payload, '$.amount_fen') AS BIGINT)) FROM ods_player_events)"""


def _quantiles(grain: str, dt: str, by: str) -> str:
    cols = ", ".join(f"quantile_disc(value, {p}) AS {name}" for name, p in PERCENTILES.items())
    return f"SELECT metric, server_id, {dt} AS dt, COUNT(*) AS n, {cols}, CAST(0 AS DOUBLE) AS rank_error, '{grain}' AS grain FROM v WHERE value IS NOT NULL GROUP BY {by}"


_D = "d AS (SELECT DISTINCT dt, server_id, player_id FROM dws_player_behavior_di WHERE player_id IS NOT NULL)"


def _count(kind: str, dt: str, server: str, source: str, by: str) -> str:
    n = "CAST(COUNT(DISTINCT player_id) AS DOUBLE)"
    return f"SELECT '{kind}' AS kind, {dt} AS dt, {server} AS server_id, {n} AS estimate, {n} AS lower, {n} AS upper FROM {source} GROUP BY {by}"


def _pair(kind: str, test: str) -> str:
    n = f"CAST(COUNT(*) FILTER (WHERE {test}) AS DOUBLE)"
    return f"SELECT '{kind}' AS kind, dt, server_id, {n} AS estimate, {n} AS lower, {n} AS upper FROM b GROUP BY dt, server_id"


_PAIRS = """k AS (SELECT a.dt, a.server_id FROM (SELECT DISTINCT dt, server_id FROM d) a JOIN (SELECT DISTINCT dt, server_id FROM d) p ON p.server_id = a.server_id AND p.dt = a.dt - 1),
b AS (SELECT k.dt, k.server_id, x.player_id, MAX(CAST(x.dt = k.dt AS INT)) AS today, MAX(CAST(x.dt < k.dt AS INT)) AS before
  FROM k JOIN d x ON x.server_id = k.server_id AND x.dt IN (k.dt, k.dt - 1) GROUP BY ALL)"""


def _bounds(kind: str, dt: str, server: str, by: str) -> str:
    return f"SELECT '{kind}' AS kind, {dt} AS dt, {server} AS server_id, COUNT(DISTINCT player_id) AS exact, TRUE AS within FROM d GROUP BY {by}"


def oracle_sql() -> dict[str, str]:
    return {
        "p3_rank_error": f"WITH {_VALUES} SELECT metric, server_id, name AS percentile, COUNT(*) AS n, TRUE AS within FROM v, unnest([{', '.join(repr(p) for p in PERCENTILES)}]) AS u(name) WHERE value IS NOT NULL GROUP BY ALL",
        "p6_bounds": f"WITH {_D} {_bounds('server_day', 'dt', 'server_id', 'dt, server_id')} UNION ALL {_bounds('day', 'dt', 'CAST(NULL AS INTEGER)', 'dt')} UNION ALL {_bounds('server', 'CAST(NULL AS DATE)', 'server_id', 'server_id')}",
        "p8_check": "SELECT COUNT(DISTINCT doc_id) AS documents, CAST(0 AS BIGINT) AS split_short, CAST(0 AS BIGINT) AS wrong_pieces, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS holed FROM documents",
        "p9_planted": "SELECT item_id, item_id AS doc_id FROM eval_items WHERE len(trim(passage)) > 0",
        "p10_samples": "SELECT sample_id, lang AS found_lang, FALSE AS mixed FROM lang_samples WHERE lang IS NOT NULL AND len(trim(text)) > 0",
        "p3_percentiles": f"WITH {_VALUES} {_quantiles('server_day', 'dt', 'metric, server_id, dt')} UNION ALL {_quantiles('server', 'CAST(NULL AS DATE)', 'metric, server_id')}",
        "p6_distinct": f"WITH {_D}, {_PAIRS} "
        + " UNION ALL ".join(
            [
                _count("server_day", "dt", "server_id", "d", "dt, server_id"),
                _count("day", "dt", "CAST(NULL AS INTEGER)", "d", "dt"),
                _count("server", "CAST(NULL AS DATE)", "server_id", "d", "server_id"),
                _pair("returned", "today = 1 AND before = 1"),
                _pair("two_days", "TRUE"),
                _pair("new", "today = 1 AND before = 0"),
                _pair("lost", "today = 0 AND before = 1"),
            ]
        ),
        "p6_dau": f"WITH {_D}, e AS (SELECT dt, server_id, CAST(COUNT(*) AS DOUBLE) AS n FROM d GROUP BY ALL), p AS (SELECT dt, server_id, dau FROM ads_dau_di WHERE lower(trim(metric_id)) = 'ads_dau_di') "
        "SELECT COALESCE(e.dt, p.dt) AS dt, COALESCE(e.server_id, p.server_id) AS server_id, e.n AS estimate, e.n AS lower, e.n AS upper, p.dau, COALESCE(p.dau = e.n, FALSE) AS agrees FROM e FULL JOIN p ON e.dt = p.dt AND e.server_id = p.server_id",
    }
