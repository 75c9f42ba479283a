"""SQL of the streaming queries: the same results in one batch."""

from __future__ import annotations

from concord.plans.oracle_sources import SQL as SOURCES

LETTERS = "translate(user_id::VARCHAR, '0123456789', 'abcdefghij')"
_RANKED = f"""WITH e AS (SELECT event_id, event_type, value, year(ts) AS yr, {LETTERS} AS user FROM events),
    c AS (SELECT user, count(*) AS members, min(event_id) AS first_event, count_if(event_type = 'error') AS n0, count_if(event_type = 'click') AS n1,
        min(event_id) FILTER (event_type = 'error') AS h0, min(event_id) FILTER (event_type = 'click') AS h1,
        first(event_type ORDER BY strlen(event_type) DESC, event_id) AS medium, min(value) AS low, max(value) AS high, min(yr) AS first_year
        FROM e GROUP BY user),
    f AS (SELECT (SELECT count(*) FROM e) AS n, count_if(event_id >= h0) AS df0, count_if(event_id >= h1) AS df1 FROM e JOIN c USING (user))"""


def _score(i: int) -> str:
    return f"CASE WHEN df{i} > 0 THEN trunc(100000 * (2.0 * n{i}) * ln((1 + n) / df{i})) ELSE 0 END"


_EVENTS = f"""e AS (SELECT event_id, event_type, {LETTERS} AS user, year(ts) AS yr, floor(value)::BIGINT AS v, event_id % 50 = 0 AS broken,
        event_type IN ('click', 'error', 'view') AS inside FROM events),
    o AS (SELECT *, CASE WHEN broken THEN 'rejected' WHEN NOT inside THEN 'filtered'
        WHEN row_number() OVER (PARTITION BY broken, event_type, user, yr, v ORDER BY event_id) > 1 THEN 'duplicate' ELSE 'kept' END AS outcome FROM e)"""
SQL = {
    "stream_record_files": """SELECT p_size::VARCHAR AS source, count(*) AS fetched, 0 AS filtered, count_if(p_partkey % 50 = 0) AS failures
        FROM part GROUP BY p_size""",
    "stream_expiring": """WITH e AS (SELECT user_id::VARCHAR AS cluster, epoch_us(ts) // 1000 AS at_ms, value FROM events),
    g AS (SELECT *, CASE WHEN at_ms - lag(at_ms) OVER w <= 172800000 THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY cluster ORDER BY at_ms)),
    n AS (SELECT *, sum(fresh) OVER (PARTITION BY cluster ORDER BY at_ms ROWS UNBOUNDED PRECEDING) AS life FROM g),
    l AS (SELECT cluster, life, min(at_ms) AS start, max(at_ms) AS stop, count(*) AS members, min(value) AS low, max(value) AS high FROM n GROUP BY cluster, life)
    SELECT cluster, start, stop, members, low, high, stop + 172800000 <= (SELECT max(at_ms) FROM e) AS expired FROM l""",
    "stream_flow": f"""WITH {_EVENTS} SELECT event_type AS source, count(*) AS records, count_if(outcome = 'kept') AS kept,
        count_if(outcome = 'duplicate') AS duplicate, count_if(outcome = 'filtered') AS filtered, count_if(outcome = 'rejected') AS rejected
        FROM o GROUP BY event_type""",
    "flow_kept": f"""WITH {_EVENTS} SELECT event_id, 'content: title ' || user AS cluster FROM o WHERE outcome = 'kept'
        UNION ALL SELECT count(*), 'colour' FROM o WHERE outcome <> 'rejected' HAVING count(*) > 0""",
    "stream_gated": "SELECT 0 AS stopped_after, 1 AS batches, count(*) > 0 AS any_records FROM events",
    "stream_components": SOURCES["multi_key_clusters"],
    "stream_ranked": f"""{_RANKED} SELECT 'content: title ' || user AS recid, members, ({_score(0)} + {_score(1)})::BIGINT AS relevance,
        first_event, user AS title, medium, low, high, first_year FROM c, f""",
    "stream_facets": f"""WITH terms AS (
        SELECT 'title' AS facet, {LETTERS} AS norm FROM events UNION ALL SELECT 'medium', event_type FROM events
        UNION ALL SELECT 'date', year(ts)::VARCHAR FROM events)
    SELECT facet, norm, norm AS display, count(*) AS frequency FROM terms GROUP BY facet, norm""",
    "stream_status": f"""SELECT event_type AS source, count(*) AS fetched, count_if({LETTERS} NOT IN ('a', 'b', 'ba', 'cd')) AS filtered,
        count_if(value > 40) AS failures FROM events GROUP BY event_type""",
    "stream_dedup": "SELECT event_type AS source, count(DISTINCT user_id) AS users FROM events GROUP BY event_type",
    "stream_clusters": f"""SELECT 'content: title ' || {LETTERS} AS recid, count(*) AS members, {LETTERS} AS title,
        first(event_type ORDER BY strlen(event_type) DESC, ts, event_id) AS medium, min(value) AS low, max(value) AS high,
        first(event_id ORDER BY ts, event_id) AS first_event FROM events GROUP BY user_id""",
    "stream_idle_clusters": f"""SELECT 'content: title ' || {LETTERS} AS cluster, count(*) AS members, min(value) AS low, max(value) AS high
        FROM events GROUP BY user_id""",
    "stream_ready": """WITH s AS (SELECT count(*) AS n, count_if(event_type = 'error') AS e, count_if(event_type = 'click' AND event_type = 'error') AS p FROM events)
    SELECT n > 0 OR e = 0 AS ready, 'any' AS mode FROM s UNION ALL SELECT p = 0, 'preferred' FROM s UNION ALL SELECT e = 0, 'all' FROM s""",
    "stream_intake": """SELECT event_type AS source, count(*) AS fetched, 0 AS filtered, count_if(event_id % 50 = 0) AS failures
        FROM events GROUP BY event_type""",
}
