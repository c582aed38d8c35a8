"""The registered queries in DuckDB SQL, written independently of the DataFrame code."""

from __future__ import annotations

from tidewater.sources.fixtures import SQL_TEXTS

_INT = "CASE WHEN regexp_matches(trim({c}), '^[+-]?[0-9]+$') THEN TRY_CAST(trim({c}) AS BIGINT) END AS {c}"
_PARTS = ["strftime(event_ts, '%Y-%m-%d %H:%M:%S')", "event_type", "CAST(product_id AS VARCHAR)", "CAST(category_id AS VARCHAR)", "category_code", "brand", "CAST(price AS VARCHAR)", "CAST(user_id AS VARCHAR)", "user_session"]
_PRINT = "sha256(concat_ws('||', " + ", ".join(f"coalesce({p}, '_null_')" for p in _PARTS) + "))"
_REASONS = {
    "missing_event_ts": "event_ts IS NULL",
    "invalid_event_type": "event_type IS NULL OR event_type NOT IN ('view','cart','remove_from_cart','purchase')",
    "missing_product_id": "product_id IS NULL",
    "missing_category_id": "category_id IS NULL",
    "missing_user_id": "user_id IS NULL",
    "missing_user_session": "user_session IS NULL",
    "invalid_price": "price IS NULL OR price < 0",
}
_BAD = " OR ".join(f"({r})" for r in _REASONS.values())
_WHY = "concat_ws('; ', " + ", ".join(f"CASE WHEN {r} THEN '{n}' END" for n, r in _REASONS.items()) + ")"


def _clean(c: str) -> str:
    return f"CASE WHEN lower(trim({c})) NOT IN ('', 'null', 'none', 'nan') THEN lower(trim({c})) END"


BASE = f"""
WITH b AS (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id AS u, event_type AS t, value AS v, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
j AS (SELECT b.*, p_brand, lower(p_type) AS c1, string_split(p_name, ' ')[2] AS c2, string_split(p_name, ' ')[1] AS c3,
        CASE t WHEN 'click' THEN 'cart' WHEN 'signup' THEN 'remove_from_cart' ELSE t END AS m FROM b LEFT JOIN part ON p_partkey = k),
r AS (SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' UTC' AS event_time,
        CASE WHEN event_id % 50 = 7 THEN ' ' || upper(m) || ' ' ELSE m END AS event_type,
        CASE WHEN event_id % 97 = 0 THEN 'abc' ELSE CAST(k AS VARCHAR) END AS product_id,
        CAST(2000000 + k % 7 AS VARCHAR) AS category_id,
        CASE WHEN event_id % 89 = 0 THEN ' NaN ' WHEN k % 5 = 0 THEN c1 WHEN k % 5 = 1 THEN concat(c1, '.', c2)
             WHEN k % 5 = 2 THEN concat(c1, '.', c2, '.', c3, '.x') ELSE concat(c1, '.', c2, '.', c3) END AS category_code,
        CASE WHEN k % 10 = 0 THEN '' ELSE p_brand END AS brand,
        CASE WHEN event_id % 83 = 0 THEN '-1.00' ELSE CAST(CAST(v AS DECIMAL(10,2)) AS VARCHAR) END AS price,
        CASE WHEN event_id % 101 = 0 THEN NULL ELSE CAST(u AS VARCHAR) END AS user_id,
        concat(' ', CAST(u AS VARCHAR), '-', strftime(ts, '%Y%m%d'), ' ') AS user_session,
        ts + INTERVAL 1 SECOND AS kafka_ts, CAST(event_id % 3 AS INTEGER) AS kafka_partition, CAST(event_id // 3 AS BIGINT) AS kafka_offset,
        TIMESTAMP '2024-02-01 00:00:00' AS ingested_at FROM j),
raw AS (SELECT * FROM r UNION ALL
        SELECT * REPLACE (kafka_offset + 1000000000 AS kafka_offset, TIMESTAMP '2024-02-02 00:00:00' AS ingested_at) FROM r WHERE event_id % 20 = 0),
t0 AS (SELECT try_strptime(regexp_replace(event_time, '\\s+UTC$', ''), '%Y-%m-%d %H:%M:%S') AS event_ts, lower(trim(event_type)) AS event_type,
        {_INT.format(c="product_id")}, {_INT.format(c="category_id")}, {_clean("category_code")} AS category_code,
        coalesce({_clean("brand")}, 'unknown') AS brand, TRY_CAST(price AS DECIMAL(10,2)) AS price, {_INT.format(c="user_id")},
        nullif(trim(user_session), '') AS user_session, kafka_ts, kafka_partition, kafka_offset, ingested_at FROM raw),
t1 AS (SELECT *, string_split(category_code, '.') AS parts FROM t0),
s AS (SELECT concat_ws('_', CAST(kafka_partition AS VARCHAR), CAST(kafka_offset AS VARCHAR)) AS source_event_id, {_PRINT} AS event_fingerprint, event_ts,
        CAST(event_ts AS DATE) AS event_date, CAST(year(event_ts) AS INTEGER) AS event_year, CAST(month(event_ts) AS INTEGER) AS event_month,
        CAST(day(event_ts) AS INTEGER) AS event_day, CAST(hour(event_ts) AS INTEGER) AS event_hour, event_type, product_id, category_id, category_code,
        parts[1] AS category_l1, parts[2] AS category_l2, CASE WHEN len(parts) > 2 THEN array_to_string(parts[3:], '.') END AS category_l3,
        brand, price, user_id, user_session, kafka_ts, kafka_partition, kafka_offset, ingested_at,
        NOT ({_BAD}) AS is_valid, nullif({_WHY}, '') AS invalid_reason FROM t1),
stg AS (SELECT event_fingerprint, source_event_id, strftime(event_ts, '%Y%m%d%H') AS time_id, event_ts, event_date, event_year, event_month, event_day, event_hour,
        event_type, product_id, category_id, category_code, category_l1, category_l2, category_l3, brand, CAST(price AS DECIMAL(18,2)) AS price, user_id,
        user_session AS session_id, kafka_partition, kafka_offset FROM s WHERE is_valid
        QUALIFY row_number() OVER (PARTITION BY event_fingerprint ORDER BY ingested_at DESC NULLS LAST, kafka_ts DESC NULLS LAST, kafka_partition DESC NULLS LAST, kafka_offset DESC NULLS LAST) = 1),
fe AS (SELECT event_fingerprint, source_event_id, time_id, event_ts, event_date, event_type, product_id, user_id, session_id, price, event_type = 'view' AS is_view,
        event_type = 'cart' AS is_cart, event_type = 'remove_from_cart' AS is_remove_from_cart, event_type = 'purchase' AS is_purchase, kafka_partition, kafka_offset FROM stg),
fs AS (SELECT event_fingerprint AS sale_id, event_fingerprint, source_event_id, time_id, event_date AS sale_date, product_id, user_id, session_id, price AS unit_price,
        CAST(1 AS INTEGER) AS quantity, price AS gross_amount FROM fe WHERE is_purchase),
dp AS (SELECT product_id, {", ".join(f"first({c} ORDER BY event_ts, event_fingerprint) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in ("category_id", "category_code", "category_l1", "category_l2", "category_l3", "brand"))},
        min(event_ts) AS first_seen_at, max(event_ts) AS last_seen_at, CAST(((2 * sum(CAST(price * 100 AS BIGINT)) + count(*)) // (2 * count(*))) / 100.0 AS DECIMAL(18,2)) AS avg_observed_price,
        min(price) AS min_observed_price, max(price) AS max_observed_price, count(*) AS record_count FROM stg GROUP BY product_id),
du AS (SELECT user_id, min(event_ts) AS first_seen_at, max(event_ts) AS last_seen_at, count(DISTINCT session_id) AS total_sessions, count(*) AS total_events,
        count(*) FILTER (is_view) AS total_views, count(*) FILTER (is_cart) AS total_cart_adds, count(*) FILTER (is_remove_from_cart) AS total_remove_from_carts,
        count(*) FILTER (is_purchase) AS total_purchases, CAST(coalesce(sum(price) FILTER (is_purchase), 0) AS DECIMAL(18,2)) AS total_revenue FROM fe GROUP BY user_id),
dss AS (SELECT session_id, first(user_id ORDER BY event_ts, event_fingerprint) AS user_id, min(event_ts) AS session_start_at, max(event_ts) AS session_end_at,
        CAST(epoch(max(event_ts)) - epoch(min(event_ts)) AS BIGINT) AS session_duration_sec, count(*) AS event_count, count(*) FILTER (is_view) AS view_count,
        count(*) FILTER (is_cart) AS cart_count, count(*) FILTER (is_remove_from_cart) AS remove_from_cart_count, count(*) FILTER (is_purchase) AS purchase_count,
        CAST(coalesce(sum(price) FILTER (is_purchase), 0) AS DECIMAL(18,2)) AS session_revenue, count(*) FILTER (is_purchase) > 0 AS has_purchase FROM fe GROUP BY session_id),
en AS (SELECT fe.*, dp.brand, dp.category_l1, dp.category_l2, dp.category_l3 FROM fe LEFT JOIN dp USING (product_id))
"""

_RATE = "CASE WHEN {d} = 0 THEN 0.0::DOUBLE ELSE {n}::DOUBLE / {d}::DOUBLE END"
_N = {n: f"count(*) FILTER (is_{t})" for n, t in (("view_count", "view"), ("cart_count", "cart"), ("purchase_count", "purchase"), ("remove_from_cart_count", "remove_from_cart"))}
_FOUR = ", ".join(f"{v} AS {k}" for k, v in _N.items())
_REV = "CAST(coalesce(sum(price) FILTER (is_purchase), 0) AS DECIMAL(18,2))"
_AVG = "CAST(((2 * sum(CAST(price * 100 AS BIGINT)) + count(*)) // (2 * count(*))) / 100.0 AS DECIMAL(18,2))"
_BOTH = _RATE.format(n=_N["purchase_count"], d=_N["view_count"]) + " AS conversion_rate, " + _RATE.format(n=_N["purchase_count"], d=_N["cart_count"]) + " AS cart_to_purchase_rate"

DAILY = (
    BASE
    + f""",
de AS (SELECT event_date, count(*) AS total_events, {_N["view_count"]} AS total_views, {_N["cart_count"]} AS total_carts, {_N["remove_from_cart_count"]} AS total_remove_from_carts,
        {_N["purchase_count"]} AS total_purchases, count(DISTINCT user_id) AS unique_users, count(DISTINCT session_id) AS unique_sessions, count(DISTINCT product_id) AS unique_products,
        count(DISTINCT event_fingerprint) AS unique_events, {_REV} AS total_revenue, {_AVG} AS avg_event_price, {_BOTH} FROM fe GROUP BY event_date),
dpr AS (SELECT strftime(event_date, '%Y%m%d') || '_' || CAST(product_id AS VARCHAR) AS summary_id, event_date, product_id, brand, category_l1, category_l2, category_l3, {_FOUR},
        count(DISTINCT event_fingerprint) AS unique_events, count(DISTINCT user_id) AS unique_users, count(DISTINCT session_id) AS unique_sessions, {_REV} AS revenue,
        {_AVG} AS avg_price, min(price) AS min_price, max(price) AS max_price, {_BOTH} FROM en GROUP BY event_date, product_id, brand, category_l1, category_l2, category_l3),
ec AS (SELECT * REPLACE (coalesce(category_l1, 'unknown') AS category_l1, coalesce(category_l2, 'unknown') AS category_l2, coalesce(category_l3, 'unknown') AS category_l3, coalesce(brand, 'unknown') AS brand) FROM en),
dc AS (SELECT concat_ws('_', strftime(event_date, '%Y%m%d'), category_l1, category_l2, category_l3) AS summary_id, event_date, category_l1, category_l2, category_l3, count(*) AS total_events, {_FOUR},
        count(DISTINCT event_fingerprint) AS unique_events, count(DISTINCT user_id) AS unique_users, count(DISTINCT product_id) AS unique_products, {_REV} AS revenue, {_BOTH}
        FROM ec GROUP BY event_date, category_l1, category_l2, category_l3),
db AS (SELECT concat_ws('_', strftime(event_date, '%Y%m%d'), brand) AS summary_id, event_date, brand, {_FOUR}, count(DISTINCT event_fingerprint) AS unique_events,
        count(DISTINCT user_id) AS unique_users, count(DISTINCT product_id) AS unique_products, {_REV} AS revenue, {_BOTH} FROM ec GROUP BY event_date, brand)
"""
)

_SUMS = "CAST(sum(revenue) AS DOUBLE) AS revenue, CAST(sum(view_count) AS BIGINT) AS views, CAST(sum(cart_count) AS BIGINT) AS carts, CAST(sum(purchase_count) AS BIGINT) AS purchases"
_CONV = _RATE.format(n="sum(purchase_count)", d="sum(view_count)") + " AS conversion_rate"
_C2P = _RATE.format(n="sum(purchase_count)", d="sum(cart_count)") + " AS cart_to_purchase_rate"
_LOG = """
WITH lg AS (SELECT event_id AS run_id, user_id, user_id AS session_id, CAST(ts AS TIMESTAMP) AS created_at, CAST(round(value * 100) AS BIGINT) AS latency_ms,
    CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status, event_id % 4 AS retry_count,
    CASE WHEN event_type = 'error' THEN ['SQL guard blocked', 'Trino query failed: X', 'Groq rate limit', 'Persistence failed: X', 'metadata missing', 'boom', NULL][event_id % 7 + 1] END AS error FROM events)
"""
_LE = [0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 20.0, 30.0, 60.0]
_HIST = _LOG + f", le AS (SELECT unnest([{', '.join(map(str, _LE))}, 'inf'::DOUBLE]::DOUBLE[]) AS le), h AS (SELECT status, le, count(*) FILTER (latency_ms / 1000.0::DOUBLE <= le) AS n FROM lg, le GROUP BY status, le)"
_ASK = """
WITH pb AS (SELECT p_partkey AS k, lower(p_brand) AS b FROM part),
q AS (SELECT event_id, b AS brand, substring(b, 1, CAST(event_id % 3 AS INTEGER) + 1) || substring(b, CAST(event_id % 3 AS INTEGER) + 3) AS typo
      FROM events JOIN pb ON k = CAST(json_extract_string(props, '$.k') AS BIGINT)),
fold AS (SELECT event_id, brand, typo, trim(regexp_replace(brand, '[^a-z0-9]+', ' ', 'g')) AS fb, trim(regexp_replace(typo, '[^a-z0-9]+', ' ', 'g')) AS ft FROM q)
"""
_FOLD = "replace(strip_accents(lower(text)), 'đ', 'd')"
_DANGER = "drop delete truncate update insert alter create merge grant revoke".split() + ["xoa bang", "xoa du lieu", "xoa het", "cap nhat du lieu", "sua du lieu", "them du lieu"]
_INJECT = ["ignore previous", "ignore all previous", "ignore instructions", "bypass", "jailbreak", "system prompt", "developer message", "khong can truy van", "khong can query", "tra loi ngay", "answer directly", "answer immediately"]


def _first(terms: list[str]) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN contains(x, '{t}') THEN '{t}' END" for t in terms) + ")"


def _board(table: str, keys: str, more: str = "", where: str = "", tail: str = "") -> str:
    return f"{DAILY} SELECT {keys}, {_SUMS}, {_CONV}{more} FROM {table} {where} GROUP BY ALL {tail}"


_LEV = "coalesce(category_l1, 'unknown') AS category_l1, coalesce(category_l2, '') AS category_l2, coalesce(category_l3, '') AS category_l3"


def _contract(table: str, key: str, label: str) -> str:
    inner = f"(SELECT CAST(count(*) FILTER ({key} IS NULL) AS BIGINT) AS a, CAST(count({key}) - count(DISTINCT {key}) AS BIGINT) AS b FROM {table})"
    return f"SELECT 'null_{key}' AS check_name, '{label}' AS table_name, a AS n_violations FROM {inner} UNION ALL SELECT 'duplicate_{key}', '{label}', b FROM {inner}"


_KINDS = {
    "events": {"event_id": "numeric", "ts": "time", "user_id": "numeric", "event_type": "categorical", "value": "numeric", "props": "categorical"},
    "part": {"p_partkey": "numeric", "p_name": "categorical", "p_brand": "categorical", "p_type": "categorical", "p_size": "numeric", "p_retailprice": "numeric"},
    "orders": {"o_orderkey": "numeric", "o_custkey": "numeric", "o_orderstatus": "categorical", "o_totalprice": "numeric", "o_orderdate": "time", "o_orderpriority": "categorical"},
}
_PRODUCT_KINDS = {
    **dict.fromkeys(("summary_id", "brand", "category_l1", "category_l2", "category_l3"), "categorical"), "event_date": "time", "gold_processed_at": "time",
    **dict.fromkeys(("product_id", "view_count", "cart_count", "remove_from_cart_count", "purchase_count", "unique_events", "unique_users", "unique_sessions", "revenue", "avg_price", "min_price", "max_price", "conversion_rate", "cart_to_purchase_rate"), "numeric"),
}
SILVER_OUT = "source_event_id, event_fingerprint, event_date, event_year, event_month, event_day, event_hour, event_type, product_id, category_id, category_code, category_l1, category_l2, category_l3, brand, price, user_id, user_session, kafka_partition, kafka_offset, is_valid, invalid_reason"


def oracle_sql() -> dict[str, str]:
    from tidewater.plans import oracle_more, oracle_stored

    return {
        **oracle_more.oracle_sql(),
        **oracle_stored.oracle_sql(),
        "bronze_parse": f"{BASE} SELECT event_time, event_type, product_id, category_id, category_code, brand, price, user_id, user_session, kafka_partition, kafka_offset, CAST(kafka_ts AS DATE) AS date_partition FROM raw",
        "offset_high_water": f"""{BASE}, old AS (SELECT kafka_partition AS p, max(kafka_offset) + 1 AS o FROM raw WHERE kafka_offset < 1000000000 AND kafka_partition < 2 GROUP BY 1),
            new AS (SELECT kafka_partition AS p, max(kafka_offset) + 1 AS o FROM raw WHERE kafka_partition > 0 GROUP BY 1)
            SELECT 'events' AS topic, CAST(coalesce(new.p, old.p) AS INTEGER) AS "partition", coalesce(new.o, old.o) AS next_offset FROM new FULL JOIN old ON new.p = old.p""",
        "silver_clean": f"{BASE} SELECT {SILVER_OUT} FROM s",
        "silver_invalid_reasons": f"{BASE} SELECT invalid_reason, count(*) AS n FROM s WHERE NOT is_valid GROUP BY 1",
        "silver_split": f"{BASE} SELECT is_valid, count(*) AS n FROM s GROUP BY 1",
        "silver_dedup": f"{BASE} SELECT event_fingerprint, source_event_id, kafka_offset FROM stg",
        "category_levels": f"{BASE} SELECT DISTINCT category_code, category_l1, category_l2, category_l3 FROM s",
        "fingerprint": f"{BASE} SELECT source_event_id, event_fingerprint FROM s",
        "new_rows_anti": f"{BASE} SELECT event_fingerprint, source_event_id FROM stg WHERE event_fingerprint NOT IN (SELECT event_fingerprint FROM s WHERE is_valid AND kafka_partition = 0)",
        "stg_events": f"{BASE} SELECT * EXCLUDE (event_ts) FROM stg",
        "fact_events": f"{BASE} SELECT * EXCLUDE (event_ts) FROM fe",
        "fact_sales": f"{BASE} SELECT * FROM fs",
        "dim_time": f"{BASE} SELECT DISTINCT time_id, event_date, event_year, event_month, event_day, event_hour, CAST(dayofweek(event_ts) + 1 AS INTEGER) AS day_of_week, strftime(event_ts, '%A') AS day_name, strftime(event_ts, '%B') AS month_name, CAST(quarter(event_ts) AS INTEGER) AS quarter, dayofweek(event_ts) IN (0, 6) AS is_weekend FROM stg",
        "dim_product": f"{BASE} SELECT * FROM dp",
        "dim_user": f"{BASE} SELECT * FROM du",
        "dim_session": f"{BASE} SELECT * FROM dss",
        "star_join": f"{BASE} SELECT dayofweek(sale_date) IN (0, 6) AS is_weekend, dp.brand, count(*) AS sales, CAST(sum(gross_amount) AS DECIMAL(18,2)) AS revenue, count(*) FILTER (has_purchase) AS with_purchase, CAST(sum(total_events) AS BIGINT) AS user_events FROM fs LEFT JOIN dp USING (product_id) LEFT JOIN du ON fs.user_id = du.user_id LEFT JOIN dss ON fs.session_id = dss.session_id GROUP BY 1, 2",
        "revenue_by_date": f"{BASE} SELECT sale_date AS event_date, CAST(sum(gross_amount) AS DECIMAL(18,2)) AS total_revenue FROM fs GROUP BY 1",
        "revenue_by_product": f"{BASE} SELECT sale_date AS event_date, product_id, CAST(sum(gross_amount) AS DECIMAL(18,2)) AS revenue FROM fs GROUP BY 1, 2",
        "revenue_by_category": f"{BASE} SELECT sale_date AS event_date, coalesce(category_l1, 'unknown') AS category_l1, coalesce(category_l2, 'unknown') AS category_l2, coalesce(category_l3, 'unknown') AS category_l3, CAST(sum(gross_amount) AS DECIMAL(18,2)) AS revenue FROM fs LEFT JOIN dp USING (product_id) GROUP BY 1, 2, 3, 4",
        "revenue_by_brand": f"{BASE} SELECT sale_date AS event_date, coalesce(brand, 'unknown') AS brand, CAST(sum(gross_amount) AS DECIMAL(18,2)) AS revenue FROM fs LEFT JOIN dp USING (product_id) GROUP BY 1, 2",
        "daily_event_summary": f"{DAILY} SELECT * FROM de",
        "daily_product_summary": f"{DAILY} SELECT * FROM dpr",
        "daily_category_summary": f"{DAILY} SELECT * FROM dc",
        "daily_brand_summary": f"{DAILY} SELECT * FROM db",
        "summary_reconcile": f"{DAILY} SELECT event_date, NULL::BIGINT AS total_events, NULL::BIGINT AS total_purchases, NULL::DECIMAL(18,2) AS total_revenue, count(*) AS fact_events, count(*) FILTER (is_purchase) AS fact_purchases, CAST(sum(price) FILTER (is_purchase) AS DECIMAL(18,2)) AS fact_revenue FROM fe WHERE day(event_date) = 3 GROUP BY event_date",
        "key_violations": f"{DAILY} {_contract('s', 'event_fingerprint', 'silver')} UNION ALL {_contract('db', 'summary_id', 'daily_brand_summary')}",
        "fact_contract": f"{BASE} {_contract('fe', 'event_fingerprint', 'fact_events')} UNION ALL {_contract('fs', 'sale_id', 'fact_sales')} UNION ALL SELECT 'sales_are_purchases', 'fact_sales', CAST(abs((SELECT count(*) FROM fs) - (SELECT count(*) FROM fe WHERE is_purchase)) AS BIGINT)",
        "dimension_contract": f"{BASE} {_contract('dp', 'product_id', 'dim_product')} UNION ALL {_contract('du', 'user_id', 'dim_user')}",
        "duplicate_keys": f"{BASE} SELECT kafka_partition, event_time, user_id, product_id, count(*) AS n FROM raw GROUP BY 1, 2, 3, 4 HAVING count(*) > 1",
        "orphan_products": f"{BASE} SELECT DISTINCT product_id, brand FROM s WHERE NOT EXISTS (SELECT 1 FROM dp WHERE dp.product_id = s.product_id)",
        "kpi_overview": f"""{DAILY}, l AS (SELECT * FROM de WHERE event_date <= DATE '2024-01-20' ORDER BY event_date DESC LIMIT 1),
            m AS (SELECT CAST(sum(total_events) AS BIGINT) AS mtd_events, CAST(sum(total_revenue) AS DOUBLE) AS mtd_revenue FROM de WHERE event_date BETWEEN (SELECT date_trunc('month', event_date) FROM l) AND (SELECT event_date FROM l)),
            k AS (SELECT brand AS top_brand_mtd, CAST(sum(revenue) AS DOUBLE) AS top_brand_mtd_revenue FROM db WHERE event_date BETWEEN (SELECT date_trunc('month', event_date) FROM l) AND (SELECT event_date FROM l) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)
            SELECT event_date, CAST(total_revenue AS DOUBLE) AS today_revenue, total_events AS today_events, total_purchases AS today_purchases, conversion_rate AS today_conversion_rate, mtd_events, mtd_revenue, top_brand_mtd, top_brand_mtd_revenue FROM m LEFT JOIN l ON true LEFT JOIN k ON true""",
        "mtd_totals": f"{DAILY} SELECT CAST(sum(total_events) AS BIGINT) AS mtd_events, CAST(sum(total_revenue) AS DOUBLE) AS mtd_revenue FROM de WHERE event_date BETWEEN (SELECT date_trunc('month', max(event_date)) FROM de WHERE event_date <= DATE '2024-01-15') AND DATE '2024-01-15'",
        "latest_day": f"{DAILY} SELECT event_date, CAST(total_revenue AS DOUBLE) AS today_revenue, total_events AS today_events, total_purchases AS today_purchases, conversion_rate AS today_conversion_rate FROM de WHERE event_date <= DATE '2024-01-25' ORDER BY event_date DESC LIMIT 1",
        "revenue_series": f"{DAILY} SELECT event_date, CAST(total_revenue AS DOUBLE) AS total_revenue, total_events, total_purchases, conversion_rate, cart_to_purchase_rate FROM de WHERE event_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' ORDER BY event_date LIMIT 366",
        "top_brands": _board("db", "brand", where="WHERE lower(trim(brand)) <> 'unknown'", tail="ORDER BY revenue DESC, brand LIMIT 10"),
        "top_categories": _board("dc", _LEV, f", {_C2P}, CAST(sum(view_count + cart_count + purchase_count + remove_from_cart_count) AS BIGINT) AS total_events", tail="ORDER BY revenue DESC, category_l1, category_l2, category_l3 LIMIT 10"),
        "top_products": _board("dpr", f"CAST(product_id AS VARCHAR) AS product_id, coalesce(brand, 'unknown') AS brand, {_LEV}", tail="ORDER BY revenue DESC, product_id LIMIT 10"),
        "top_brand_with_top_item": f"""{DAILY}, i AS (SELECT brand, product_id, sum(view_count) AS n FROM dpr WHERE coalesce(brand, 'unknown') <> 'unknown' AND event_date BETWEEN DATE '2024-01-01' AND DATE '2024-12-31' GROUP BY 1, 2),
            g AS (SELECT brand, sum(n) AS total FROM i GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8)
            SELECT brand, CAST(total AS BIGINT) AS group_total, product_id AS top_item, CAST(n AS BIGINT) AS top_item_total FROM i JOIN g USING (brand) QUALIFY row_number() OVER (PARTITION BY brand ORDER BY n DESC, product_id) = 1""",
        "brands_by_views_year": f"{DAILY} SELECT brand, CAST(sum(view_count) AS BIGINT) AS views FROM db WHERE year(event_date) = 2024 AND brand <> 'unknown' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8",
        "brands_by_carts": f"{DAILY} SELECT brand, CAST(sum(cart_count) AS BIGINT) AS carts FROM db WHERE brand <> 'unknown' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4",
        "brands_latest_month": f"{DAILY} SELECT brand, CAST(sum(revenue) AS DOUBLE) AS revenue FROM db WHERE date_trunc('month', event_date) = (SELECT date_trunc('month', max(event_date)) FROM db) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
        "revenue_latest_month": f"{DAILY} SELECT event_date, total_revenue FROM de WHERE date_trunc('month', event_date) = (SELECT date_trunc('month', max(event_date)) FROM de)",
        "best_conversion_category": f"{DAILY} SELECT {_LEV}, {_CONV}, CAST(sum(view_count) AS BIGINT) AS views FROM dc GROUP BY dc.category_l1, dc.category_l2, dc.category_l3 ORDER BY conversion_rate DESC, 1, 2, 3 LIMIT 1",
        "most_viewed_product": f"{DAILY} SELECT CAST(product_id AS VARCHAR) AS product_id, CAST(sum(view_count) AS BIGINT) AS views FROM dpr GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1",
        "brand_ci_filter": f"{DAILY} SELECT event_date, brand, view_count FROM db WHERE lower(trim(brand)) IN ('brand#1', 'brand#11')",
        "date_range_filter": f"{DAILY} SELECT event_date, brand, revenue FROM db WHERE event_date >= DATE '2024-01-10'",
        "summary_preview": f"{DAILY} SELECT event_date, brand, view_count, revenue FROM db ORDER BY event_date, brand LIMIT 10",
        "page_offset": f"{DAILY} SELECT event_date, brand, revenue, (SELECT count(*) FROM db) > 60 AS has_next FROM db ORDER BY revenue DESC NULLS LAST, event_date, brand LIMIT 20 OFFSET 40",
        "column_totals": f"{DAILY} SELECT unnest(['view_count', 'cart_count', 'purchase_count', 'revenue']) AS name, unnest([sum(view_count)::DOUBLE, sum(cart_count)::DOUBLE, sum(purchase_count)::DOUBLE, sum(revenue::DOUBLE)]) AS total FROM db",
        "search_rows": f"{DAILY} SELECT category_l1, category_l2, category_l3, total_events FROM dc WHERE total_events > 2 AND contains(lower(concat_ws(' ', category_l1, category_l2, category_l3, CAST(total_events AS VARCHAR))), 'standard')",
        "top_revenue_rows": f"{DAILY} SELECT summary_id, revenue FROM dpr ORDER BY revenue DESC, summary_id LIMIT 20",
        "top_revenue_categories": f"{DAILY} SELECT summary_id, revenue FROM dc ORDER BY revenue DESC, summary_id LIMIT 20",
        "top_revenue_brands": f"{DAILY} SELECT summary_id, revenue FROM db ORDER BY revenue DESC, summary_id LIMIT 20",
        "most_viewed_brand_month": f"{DAILY} SELECT brand, CAST(sum(view_count) AS BIGINT) AS views FROM db WHERE year(event_date) = 2024 AND month(event_date) = 1 AND brand <> 'unknown' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1",
        "event_totals": f"{BASE} SELECT event_type, count(*) AS n, count(*) FILTER (is_purchase) AS purchases, {_REV} AS gross FROM fe GROUP BY ROLLUP (event_type)",
        "brand_not_filter": f"{DAILY} SELECT event_date, brand, view_count FROM db WHERE brand <> 'brand#1'",
        "refresh_counters": f"""{BASE}, k AS (SELECT event_fingerprint AS f, bool_or(kafka_partition = 0) AS have FROM s WHERE is_valid GROUP BY 1)
            SELECT (SELECT count(*) FROM s WHERE is_valid) AS valid, (SELECT count(*) FROM s WHERE NOT is_valid) AS invalid, (SELECT count(*) FROM s WHERE is_valid) - count(*) AS deduped, count(*) FILTER (have) AS skipped, count(*) FILTER (NOT have) AS written FROM k""",
        "sales_to_events": f"{BASE} SELECT fe.event_type, substring(fe.time_id, 9, 2) AS hour, count(*) AS sales, CAST(sum(gross_amount) AS DECIMAL(18,2)) AS revenue, CAST(sum(total_purchases) AS BIGINT) AS user_purchases FROM fs JOIN fe USING (event_fingerprint) LEFT JOIN dss ON fs.session_id = dss.session_id LEFT JOIN du ON dss.user_id = du.user_id GROUP BY 1, 2",
        "failed_runs_page": f"{_LOG}, l AS (SELECT run_id, user_id, latency_ms FROM lg WHERE status = 'failed' AND 'Question ' || run_id ILIKE '%question 1%') SELECT *, (SELECT count(*) FROM l) > 20 AS has_next, (SELECT count(*) FROM l) AS total FROM l ORDER BY run_id DESC LIMIT 10 OFFSET 10",
        "session_context": """WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS q, CASE WHEN turn % 2 = 0 THEN 'SELECT ' || turn ELSE '' END AS s, CASE WHEN turn % 3 > 0 THEN 'event_date, total_revenue' ELSE '' END AS c,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations),
            l AS (SELECT *, concat_ws(chr(10), CASE WHEN trim(q) <> '' THEN 'User asked: ' || trim(q) END, CASE WHEN c <> '' THEN 'Returned columns: ' || c END, CASE WHEN s <> '' THEN 'Executed SQL: ' || s END) AS line FROM t WHERE r <= 4)
            SELECT conv_id, md5(coalesce(string_agg(line, chr(10) ORDER BY turn) FILTER (r <= 3 AND line <> ''), '')) AS summary, md5(max(q) FILTER (r = 1)) AS last_question, max(s) FILTER (r = 1) AS last_sql,
                replace(max(c) FILTER (r = 1), ', ', ',') AS last_columns, max(concat_ws(',', 100 + turn, 200 + turn, 300 + turn)) FILTER (r = 1) AS sample FROM l GROUP BY 1""",
        "sliding_latency": f"""{_LOG}, x AS (SELECT latency_ms / 1000.0::DOUBLE AS sec, CAST(floor(epoch(created_at)) AS BIGINT) // 60 * 60 - 60 * unnest([0, 1, 2, 3, 4]) AS window_start FROM lg),
            le AS (SELECT unnest([{', '.join(map(str, _LE))}, 'inf'::DOUBLE]::DOUBLE[]) AS le), h AS (SELECT window_start, le, count(*) FILTER (sec <= le) AS n FROM x, le GROUP BY 1, 2),
            w AS (SELECT *, coalesce(lag(le) OVER o, 0) AS lo, coalesce(lag(n) OVER o, 0) AS before, max(n) OVER (PARTITION BY window_start) AS total FROM h WINDOW o AS (PARTITION BY window_start ORDER BY le)),
            p AS (SELECT *, 0.95::DOUBLE * total AS rank FROM w WHERE n >= 0.95::DOUBLE * total QUALIFY row_number() OVER (PARTITION BY window_start ORDER BY le) = 1)
            SELECT window_start, round(CASE WHEN isinf(le) THEN 60.0 ELSE lo + (le - lo) * (rank - before) / (n - before) END, 6) AS p95 FROM p""",
        "pipeline_alerts": f"{_LOG} SELECT CAST(created_at AS DATE) AS day, 100.0::DOUBLE * count(*) FILTER (status = 'failed') / count(*) > 20 AS high_error, quantile_cont(latency_ms / 1000.0::DOUBLE, 0.95) > 20 AS slow_p95, max(run_id) * 10 > 86400 AS stale FROM lg GROUP BY 1",
        "catalog_listing": " UNION ALL ".join(
            f"SELECT 'stg_{t}' AS table_name, {len(columns)}::BIGINT AS n_columns, count(*) AS n_rows, concat_ws(',', {', '.join(f"'{c}:{kind}:' || (count(*) - count({c}))" for c, kind in sorted(columns.items()))}) AS columns_found FROM {t}"
            for t, columns in _KINDS.items()
        ),
        "column_kinds": f"{DAILY} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, '{kind}' AS kind, count(*) AS rows, count(*) - count({c if c != 'gold_processed_at' else '*'}) AS nulls FROM dpr" for c, kind in _PRODUCT_KINDS.items()),
        "last_events": f"{_LOG} SELECT run_id, user_id, status FROM lg ORDER BY run_id DESC LIMIT 50",
        "lineitem_brand_month": "SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, p_brand, count(*) AS items, CAST(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DECIMAL(18,2)) AS DOUBLE) AS net FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2",
        "value_counts": f"{BASE} SELECT event_type, count(*) AS n FROM fe GROUP BY 1",
        "null_counts": f"{BASE} SELECT unnest(['event_ts', 'product_id', 'category_code', 'category_l3', 'user_id', 'price', 'invalid_reason']) AS column_name, unnest([count(*) - count(event_ts), count(*) - count(product_id), count(*) - count(category_code), count(*) - count(category_l3), count(*) - count(user_id), count(*) - count(price), count(*) - count(invalid_reason)]) AS nulls FROM s",
        "category_depth": f"{BASE} SELECT CAST(CASE WHEN trim(coalesce(category_code, '')) = '' THEN 0 ELSE len(string_split(trim(category_code), '.')) END AS INTEGER) AS depth, count(*) AS n FROM raw GROUP BY 1",
        "non_digit_ids": f"{BASE} SELECT product_id, count(*) AS n FROM raw WHERE NOT regexp_matches(product_id, '^[0-9]+$') GROUP BY 1",
        "repeated_values": f"{DAILY} SELECT brand, count(*) AS n FROM db GROUP BY 1 HAVING count(*) > 1",
        "text_tags": f"SELECT doc_id, CASE WHEN d IS NOT NULL THEN 'destructive' WHEN i IS NOT NULL THEN 'injection' ELSE 'safe' END AS category, coalesce(d, i) AS term FROM (SELECT doc_id, {_first(_DANGER)} AS d, {_first(_INJECT)} AS i FROM (SELECT doc_id, {_FOLD} AS x FROM documents))",
        "sql_audit": f"""WITH t AS (SELECT '  ' || [{", ".join("'" + x.replace("'", "''") + "'" for x in SQL_TEXTS)}][event_id % 8 + 1] || CASE event_id % 5
                WHEN 1 THEN ' WHERE event_type = ''' || CASE WHEN event_id % 3 = 0 THEN upper(event_type[1]) || event_type[2:] ELSE event_type END || ''''
                WHEN 2 THEN ' /* limit ' || event_type || ' */' WHEN 3 THEN ' LIMIT 10 ;  ' ELSE '' END AS x FROM events),
            p AS (SELECT x, regexp_replace(regexp_replace(x, '^\\s+', ''), '\\s*;?\\s*$', '') AS y FROM t),
            z AS (SELECT x, y, regexp_replace(regexp_replace(regexp_replace(y, '--[^\\n]*', ' ', 'g'), '/\\*.*?\\*/', ' ', 'gs'), '''(?:''''|[^''])*''', '''''', 'g') AS s FROM p)
            SELECT CASE WHEN y = '' THEN 'empty' WHEN contains(y, ';') THEN 'multiple_statements' WHEN NOT regexp_matches(y, '^(SELECT|WITH)\\s', 'i') THEN 'not_select'
                WHEN regexp_matches(s, '\\b(INSERT|UPDATE|DELETE|DROP|ALTER|TRUNCATE|CREATE|MERGE|CALL|GRANT|REVOKE|EXECUTE)\\b', 'i') THEN 'forbidden_keyword' ELSE 'safe' END AS class,
                regexp_matches(s, '\\bLIMIT\\b', 'i') AS has_limit,
                CAST(len(list_filter(regexp_extract_all(x, '\\b(?:brand|category_l1|category_l2|category_l3|event_type)\\b\\s*(?:=|<>|!=)\\s*''([^'']*)''', 1, 'i'), lambda v: v <> lower(trim(v)))) AS BIGINT) AS bad_literals,
                count(*) AS n FROM z GROUP BY 1, 2, 3""",
        "accent_fold": f"SELECT doc_id, md5({_FOLD}) AS folded, CAST(length(trim(regexp_replace({_FOLD}, '[^a-z0-9]+', ' ', 'g'))) AS BIGINT) AS n FROM documents",
        "session_titles": "SELECT conv_id, turn, CASE WHEN length(t) > 80 THEN substring(t, 1, 77) || '...' ELSE t END AS title FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations)",
        "fuzzy_levenshtein": f"{_ASK}, c AS (SELECT DISTINCT typo, ft FROM fold), v AS (SELECT DISTINCT brand, fb FROM fold) SELECT typo AS candidate, brand AS value, CAST(levenshtein(ft, fb) AS BIGINT) AS distance FROM c, v WHERE levenshtein(ft, fb) <= 2",
        "session_rollup": f"{_LOG} SELECT session_id, count(*) AS run_count, arg_max(run_id, (created_at, run_id)) AS last_run_id, arg_max(status, (created_at, run_id)) AS last_status FROM lg GROUP BY 1",
        "turn_index": f"{_LOG} SELECT run_id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY created_at, run_id) AS turn_index FROM lg",
        "session_last_k": "WITH k AS (SELECT *, concat_ws(': ', role, text) AS line FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4) SELECT conv_id, count(*) AS n_turns, md5(string_agg(line, chr(10) ORDER BY turn)) AS context, md5(last(line ORDER BY turn)) AS last_text FROM k GROUP BY 1",
        "favourite_runs": f"{_LOG} SELECT run_id, user_id, status, latency_ms FROM lg WHERE status = 'failed' AND 'Question ' || run_id ILIKE '%question 1%' AND created_at >= TIMESTAMP '2024-01-05' AND run_id % 11 = 0",
        "run_counters": f"{_LOG} SELECT CAST(created_at AS DATE) AS day, count(*) AS requests, round(100.0::DOUBLE * count(*) FILTER (status = 'success') / count(*), 6) AS success_pct, round(100.0::DOUBLE * count(*) FILTER (status = 'failed') / count(*), 6) AS error_pct, CAST(sum(retry_count) AS BIGINT) AS retries FROM lg GROUP BY 1",
        "status_counts": f"{_LOG} SELECT status, count(*) AS n, count(*) FILTER (status = 'success' AND latency_ms > 5000) AS slow FROM lg GROUP BY 1",
        "latency_histogram": f"{_HIST} SELECT status, le, n FROM h",
        "latency_quantile": f"""{_HIST}, w AS (SELECT status, le, n, coalesce(lag(le) OVER o, 0) AS lo, coalesce(lag(n) OVER o, 0) AS before, max(n) OVER (PARTITION BY status) AS total FROM h WINDOW o AS (PARTITION BY status ORDER BY le)),
            qs AS (SELECT unnest([0.5, 0.95]::DOUBLE[]) AS q), p AS (SELECT w.*, q, q * total AS rank FROM w, qs WHERE n >= q * total QUALIFY row_number() OVER (PARTITION BY status, q ORDER BY le) = 1)
            SELECT status, q, round(CASE WHEN total = 0 THEN 'nan'::DOUBLE WHEN isinf(le) THEN 60.0 ELSE lo + (le - lo) * (rank - before) / (n - before) END, 6) AS quantile FROM p""",
        "exact_quantiles": f"{_LOG} SELECT round(quantile_cont(latency_ms / 1000.0::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(latency_ms / 1000.0::DOUBLE, 0.95), 6) AS p95, round(quantile_cont(latency_ms / 1000.0::DOUBLE, 0.99), 6) AS p99 FROM lg",
        "pipeline_freshness": """WITH p AS (SELECT event_id, ['bronze', 'silver', 'gold', 'catalog'][event_id % 4 + 1] AS dag_id, CAST(ts AS TIMESTAMP) AS a, CAST(floor(epoch(CAST(ts AS TIMESTAMP))) AS BIGINT) + CAST(floor(value) AS BIGINT) AS z, event_type <> 'error' AS ok FROM events),
            l AS (SELECT dag_id, count(*) AS runs, arg_max(ok, (a, event_id)) AS ok, arg_max(z, (a, event_id)) AS z, max(a) AS a, max(z) FILTER (ok) AS won FROM p GROUP BY 1)
            SELECT dag_id, runs, CAST(ok AS INTEGER) AS last_state, greatest(z - CAST(floor(epoch(a)) AS BIGINT), 0) AS last_duration_sec, greatest(CAST(epoch(TIMESTAMP '2024-03-01') AS BIGINT) - won, 0) AS stale_sec FROM l""",
        "fixed_window_limit": f"""{_LOG}, w AS (SELECT run_id, user_id, CAST(floor(epoch(created_at)) AS BIGINT) AS e, created_at FROM lg), x AS (SELECT *, e // 86400 * 86400 AS window_start FROM w),
            y AS (SELECT *, row_number() OVER (PARTITION BY user_id, window_start ORDER BY created_at, run_id) AS hit FROM x)
            SELECT run_id, user_id, window_start, hit, hit <= 2 AS allowed, greatest(2 - hit, 0) AS remaining, window_start + 86400 - e AS retry_after FROM y""",
        "sliding_error_rate": f"""{_LOG}, x AS (SELECT status, CAST(floor(epoch(created_at)) AS BIGINT) // 60 * 60 - 60 * unnest([0, 1, 2, 3, 4]) AS window_start FROM lg)
            SELECT window_start, count(*) AS requests, count(*) FILTER (status = 'failed') AS errors, round(count(*) FILTER (status = 'failed')::DOUBLE / count(*), 6) AS error_ratio FROM x GROUP BY 1""",
        "table_kinds": """SELECT table_name, CASE WHEN starts_with(table_name, 'gold.fact_') THEN 'fact' WHEN starts_with(table_name, 'dim_') THEN 'dimension' ELSE 'summary' END AS kind, count(*) AS n FROM (
            SELECT CASE event_id % 3 WHEN 0 THEN 'gold.fact_' WHEN 1 THEN 'dim_' ELSE 'daily_x_summary_' END || event_type AS table_name FROM events) GROUP BY 1, 2""",
    }
