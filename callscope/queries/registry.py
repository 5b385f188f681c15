from __future__ import annotations

from collections.abc import Callable

from ..sources import adapter

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

#: The adapter's rules in DuckDB SQL. fclass is the failure class, ok is success-like.
CALLS = """WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
base AS (SELECT event_id + 1 AS id, 'inv-' || event_id AS invoke_id, CAST(floor(epoch(ts)) AS BIGINT) AS epoch, user_id, k, value, event_type,
 CASE WHEN event_id % 10 = 0 THEN 'xy' ELSE 'proxy' END AS source, CASE WHEN event_id % 17 <> 0 THEN 'conv-' || user_id END AS conversation,
 CASE WHEN user_id % 11 <> 0 THEN user_id % 7 + 1 END AS account, ['model-a', 'model-b', 'model-c-2026-01-01'][k % 3 + 1] AS model, ['low', 'medium', 'high', NULL][k % 4 + 1] AS effort,
 CASE event_type WHEN 'error' THEN ['http_429', 'http_401', 'http_502', 'failed', 'interrupted'][event_id % 5 + 1] WHEN 'signup' THEN CASE WHEN event_id % 23 = 0 THEN 'running' ELSE 'completed' END
   WHEN 'click' THEN 'http_200' WHEN 'purchase' THEN 'warning_success' ELSE 'success' END AS status,
 CASE WHEN event_type = 'error' THEN ['HTTP 429: Too Many Requests', 'HTTP 401 incorrect api key provided', 'HTTP 502 upstream stream error', '[downstream_closed] user cancelled', ''][event_id % 5 + 1] END AS error_message,
 CAST(floor(value * 100) AS BIGINT) AS input_tokens, CAST(floor(floor(value * 100) * (k % 10) / 10) AS BIGINT) AS cache_tokens, CAST(floor(value * 10) AS BIGINT) AS output_tokens,
 CASE WHEN event_id % 29 <> 0 THEN value * 20 END AS t_total, k * 0.1::DOUBLE AS t_read, 0.5::DOUBLE AS t_parse, CASE WHEN event_id % 13 <> 0 THEN 5.0::DOUBLE END AS t_connect, value * 4 AS t_ttfb,
 value * 12 AS t_stream, CASE WHEN event_type IN ('view', 'purchase') THEN value * 4 + 10 END AS first_token, value * 20000 AS t_long, event_id % 101 = 0 AS broken, k * 0.2::DOUBLE AS t_answer, CASE WHEN event_id % 19 <> 0 THEN 1.5::DOUBLE END AS t_store FROM e),
calls AS (SELECT *, output_tokens // 4 AS reasoning_tokens, input_tokens + output_tokens AS total_tokens,
 CASE WHEN coalesce(error_message, '') = '' AND status IN ('success', 'completed', 'warning_success', 'running', 'pending', 'http_200') THEN 'none' WHEN error_message LIKE '[downstream_closed]%' THEN 'client_abort'
   WHEN status = 'http_429' THEN 'service_failure' WHEN status LIKE 'http_4%' THEN 'client_failure' ELSE 'service_failure' END AS fclass,
 status IN ('success', 'completed', 'warning_success') OR (status = 'http_200' AND coalesce(error_message, '') = '') AS ok, status IN ('running', 'pending') AS flying FROM base),
attempts AS (SELECT id * 2 AS attempt_id, id, invoke_id, epoch, account, 1 AS attempt_index, status, error_message, model, t_ttfb, CASE WHEN k % 2 = 0 THEN 'gzip' ELSE 'br' END AS codec FROM calls
 UNION ALL SELECT id * 2 + 1, id, invoke_id, epoch + 1, account + 1, 2, status, error_message, model, t_ttfb, CASE WHEN k % 2 = 0 THEN 'zstd' END FROM calls WHERE (id - 1) % 4 = 0),
nodes AS (SELECT id, model AS route, 'node-' || user_id % 5 AS proxy_key, epoch, status, event_type <> 'error' AS is_success, value * 4 AS latency_ms, (id - 1) % 50 = 0 AS is_probe, CASE WHEN event_type = 'error' THEN status END AS failure_kind FROM calls),
samples AS (SELECT id, account, epoch AS captured, value % 100 AS short_percent, (value * 3) % 100 AS long_percent, (epoch // 86400 + 1) * 86400 AS resets FROM calls WHERE account IS NOT NULL),
accounts AS (SELECT i AS account, 'Account ' || i AS name, CASE WHEN i % 2 = 1 THEN 'oauth' ELSE 'api_key' END AS kind, 'group-' || i % 3 AS grp, 'shared-' || i // 2 AS identity, i % 4 <> 0 AS enabled, i IN (2, 3, 4) AS team, 'seat-' || i AS seat FROM range(1, 9) r(i)),
prices(price_model, input_price, output_price, read_price, write_price) AS (VALUES ('model-a', 2.5::DOUBLE, 15.0::DOUBLE, 0.25::DOUBLE, NULL::DOUBLE), ('model-b', 5.0, 30.0, 0.5, 6.25), ('model-c', 0.75, 4.5, 0.075, NULL)),
priced AS (SELECT c.*, CASE WHEN NOT broken AND k % 5 = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS tier, CASE WHEN price_model = 'model-a' AND input_tokens > 20000 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS more_in,
 CASE WHEN price_model = 'model-a' AND input_tokens > 20000 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS more_out, p.*, input_tokens + output_tokens > 0 AS billed FROM calls c LEFT JOIN prices p ON p.price_model = regexp_replace(c.model, '-\\d{4}-\\d{2}-\\d{2}$', '')),
costs AS (SELECT *, CASE WHEN billed THEN CASE WHEN write_price IS NULL THEN greatest(input_tokens - cache_tokens, 0) / 1e6 * input_price ELSE 0.0 END * more_in * tier END AS cost_input,
 CASE WHEN billed THEN CASE WHEN write_price IS NOT NULL THEN greatest(input_tokens - cache_tokens, 0) / 1e6 * write_price ELSE 0.0 END * more_in * tier END AS cost_cache_write,
 CASE WHEN billed THEN cache_tokens / 1e6 * read_price * more_in * tier END AS cost_cache_read, CASE WHEN billed THEN output_tokens / 1e6 * output_price * more_out * tier END AS cost_output,
 CASE WHEN billed THEN 0.0::DOUBLE END AS cost_reasoning FROM priced),
paid AS (SELECT *, cost_input + cost_cache_write + cost_cache_read + cost_output + cost_reasoning AS cost FROM costs)
"""


def query(name: str, sql: str | None = None, recursive: bool = False):
    """Registers a query and, if there is one, its oracle: what follows CALLS. State that goes from row to row takes a recursive one."""

    def keep(function: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = function
        if sql:
            ORACLES[name] = (CALLS.replace("WITH", "WITH RECURSIVE", 1) if recursive else CALLS) + sql
        return function

    return keep


#: SQL: the id up to which a reader's snapshot goes, nine tenths of all.
SNAPSHOT = "(SELECT max(id) * 9 // 10 FROM calls)"


def snapshot(rows) -> int:
    """The same for a frame of calls."""
    return (rows.agg({"id": "max"}).first()[0] or 0) * 9 // 10


def calls(spark, d):
    """The calls of a folder.

    HotSpot compiles no method of more than 8000 bytes, and what it leaves to its interpreter is several times slower than Spark's own
    operators one by one; Spark's documentation names this limit for it. The expressions that derive and classify calls would pass it.
    """
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "65535":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return adapter.invocations(spark, d)


def paid(spark, d):
    from ..functions import cost

    return cost.priced(calls(spark, d), adapter.pricing(spark), threshold=20_000)
