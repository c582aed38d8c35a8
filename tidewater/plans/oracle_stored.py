"""DuckDB SQL of the queries over written, exported, streamed and described tables."""

from __future__ import annotations

from tidewater.plans import oracle as base

_COLUMNS = {
    "events": "event_id ts user_id event_type value props".split(),
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority".split(),
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice".split(),
}
_FILLED = " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count({c}) AS filled FROM {t}" for t, columns in _COLUMNS.items() for c in columns)
_NAME = "array_to_string(list_transform(string_split(column_name, '_'), lambda x: upper(x[1]) || x[2:]), ' ')"
_MADE = "CAST(epoch(TIMESTAMP '2024-02-03 00:00:00') AS BIGINT)"


def oracle_sql() -> dict[str, str]:
    shown = "SELECT '{t}' AS table_name, least(count(*), 100) AS shown, count(*) > 100 AS more, least(count(*), 100) AS by_default FROM {t}"
    daily = {"event": ("de", "total_revenue"), "product": ("dpr", "revenue"), "category": ("dc", "revenue"), "brand": ("db", "revenue")}
    asked = [("all", name) for name in daily] + [("brand", "brand")]
    return {
        "csv_exported": f"{base.BASE} SELECT event_fingerprint, count(*) AS n FROM s GROUP BY 1",
        "csv_messages": "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, CAST(p_size AS VARCHAR) AS p_size FROM part",
        "bronze_files": f"""{base.BASE} SELECT CAST(CAST(kafka_ts AS DATE) AS VARCHAR) AS day, count(*) AS rows, count(*) FILTER (kafka_partition > 0) AS with_producer, count(*) AS in_files
            FROM raw GROUP BY 1""",
        "silver_sinks": f"""{base.BASE} SELECT 'valid' AS sink, CAST(event_date AS VARCHAR) AS day, count(*) AS rows, 0 AS with_reason FROM s WHERE is_valid GROUP BY 2
            UNION ALL SELECT 'quarantine', '2024-02-03', count(*), count(invalid_reason) FROM s WHERE NOT is_valid HAVING count(*) > 0""",
        "optional_tables": "SELECT 'events' AS table_name, count(*) AS rows FROM events UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'returns', NULL",
        "listing_limits": " UNION ALL ".join(shown.format(t=t) for t in ("events", "nation", "region")),
        "summaries_selected": f"{base.DAILY} " + " UNION ALL ".join(f"SELECT '{a}' AS asked, '{n}' AS summary, count(*) AS rows, CAST(sum({daily[n][1]}) AS DECIMAL(18,2)) AS revenue FROM {daily[n][0]}" for a, n in asked),
        "json_defaults": """WITH v AS (SELECT event_id, CASE WHEN event_id % 7 IN (1, 2, 3, 4) THEN -1 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events)
            SELECT event_id, k, CASE WHEN k IS NULL THEN '{}' ELSE concat('{"k":', k, '}') END AS again FROM v""",
        "audit_stamps": f"{base.DAILY} " + " UNION ALL ".join(f"SELECT '{n}' AS layer, {_MADE} AS made_at, count(*) AS rows FROM {t}" for n, t in (("silver", "s"), ("fact_events", "fe"), ("dim_product", "dp"), ("daily_brand", "db"))),
        "catalog_columns": f"""WITH f AS ({_FILLED}) SELECT table_name, column_name, CASE column_name WHEN 'user_id' THEN 'User' ELSE {_NAME} END AS display_name,
            CASE column_name WHEN 'user_id' THEN 'User identifier' ELSE {_NAME} END AS meaning, CASE column_name WHEN 'user_id' THEN 'key' ELSE 'attribute' END AS role, filled FROM f""",
        "catalog_search": f"""WITH f AS ({_FILLED}), n AS (SELECT count(*) AS rows FROM orders) SELECT 'orders' AS table_name, NULL AS column_name, 'table' AS kind, rows FROM n
            UNION ALL SELECT table_name, column_name, 'column', rows FROM f, n WHERE contains(column_name, 'order')""",
        "catalog_problems": f"""WITH f AS ({_FILLED}), p AS (SELECT * FROM (VALUES ('events', 'user_id', 'blank'), ('orders', 'o_custkey', 'undefined'), ('part', 'p_brand', 'repeated'), ('part', 'p_gone', 'unknown'))
            v(table_name, column_name, problem)) SELECT table_name, column_name, problem, filled FROM p LEFT JOIN f USING (table_name, column_name)""",
        "streamed_bronze": f"{base.BASE} SELECT CAST(CAST(kafka_ts AS DATE) AS VARCHAR) AS day, kafka_partition, count(*) AS rows FROM raw GROUP BY 1, 2",
        "streamed_distinct": f"{base.BASE} SELECT DISTINCT event_fingerprint, event_type, product_id, price FROM s WHERE is_valid",
        "streamed_counters": f"""{base.BASE} SELECT event_date, count(*) AS total_events, count(*) FILTER (is_view) AS total_view, count(*) FILTER (is_cart) AS total_cart,
            count(*) FILTER (is_remove_from_cart) AS total_remove_from_cart, count(*) FILTER (is_purchase) AS total_purchase,
            CAST(coalesce(sum(price) FILTER (is_purchase), 0) AS DECIMAL(18,2)) AS total_revenue FROM fe GROUP BY 1""",
    }
