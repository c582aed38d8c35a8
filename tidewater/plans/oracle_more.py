"""DuckDB SQL of the incremental, windowed, alerting, sketch and search queries."""

from __future__ import annotations

from tidewater.plans import oracle as base

_LATE = "(day(kafka_ts) IN (5, 17) AND kafka_offset % 2 = 0)"
_EXACT = "count(DISTINCT user_id) AS exact_users, count(DISTINCT session_id) AS exact_sessions, count(DISTINCT product_id) AS exact_products, true AS users_close, true AS sessions_close, true AS products_close"
#: Lower case, without accents, with single blanks between words of letters and digits.
_FOLD = "trim(regexp_replace(replace(strip_accents(lower({x})), 'đ', 'd'), '[^a-z0-9]+', ' ', 'g'))"
#: The same lists as the functions have.
_STOPS = (
    "ai bao bang cao cho co con cua doanh duoc giu hang hay hieu la loc luot mua nam nao nhan nhat nhieu ngay san sap theo "
    "thang thu thuong top tong trong vao ve xem year month date revenue sales view views"
).split()
_ANCHORS = ["cua", "brand", "hang", "nhan hang", "thuong hieu"]
_FIELDS = {"brand": ["brand", "nhan hang", "thuong hieu", "hang"], "product_id": ["san pham", "product"], "view": ["luot xem", "view"]}
_ERRORS = {
    "sql_guard": ["guard", "read-only", "readonly", "not allowed"], "trino": ["trino"], "llm": ["groq", "llm", "openai", "api key", "rate limit"],
    "persistence": ["persistence failed"], "metadata": ["metadata"],
}


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def oracle_sql() -> dict[str, str]:
    return {
        "refreshed_daily_event": f"{base.DAILY} SELECT * FROM de",
        "refreshed_daily_product": f"{base.DAILY} SELECT * FROM dpr",
        "refreshed_daily_category": f"{base.DAILY} SELECT * FROM dc",
        "refreshed_daily_brand": f"{base.DAILY} SELECT * FROM db",
        "upserted_silver": f"{base.BASE} SELECT DISTINCT event_fingerprint, event_date, event_type, product_id, price FROM s WHERE is_valid",
        "upserted_quarantine": f"{base.BASE} SELECT DISTINCT source_event_id, invalid_reason FROM s WHERE NOT is_valid",
        "upsert_commits": f"""{base.BASE}, n AS (SELECT *, CASE WHEN {_LATE} THEN 1 ELSE 0 END AS batch FROM s), f AS (SELECT event_fingerprint, event_date, min(batch) AS batch FROM n WHERE is_valid GROUP BY 1, 2),
            c AS (SELECT batch, count(*) FILTER (is_valid) AS valid, count(*) FILTER (NOT is_valid) AS invalid, count(DISTINCT event_fingerprint) FILTER (is_valid) AS kept FROM n GROUP BY 1),
            w AS (SELECT batch, count(*) AS written, string_agg(DISTINCT event_date::VARCHAR, ',' ORDER BY event_date::VARCHAR) AS days FROM f GROUP BY 1),
            q AS (SELECT count(*) FILTER (is_valid) AS valid, count(*) FILTER (NOT is_valid) AS invalid, count(DISTINCT event_fingerprint) FILTER (is_valid) AS kept FROM n WHERE kafka_partition = 1)
            SELECT 'a' AS stream, batch::BIGINT AS batch_id, valid, invalid, valid - kept AS deduped, kept - coalesce(written, 0) AS skipped, coalesce(written, 0) AS written, invalid AS quarantined, coalesce(days, '') AS days FROM c LEFT JOIN w USING (batch)
            UNION ALL SELECT 'b', 0, valid, invalid, valid - kept, kept, 0, 0, '' FROM q""",
        "bronze_increment": f"""{base.BASE}, m AS (SELECT * FROM raw WHERE kafka_offset < 1000000000)
            SELECT kafka_partition AS "partition", count(*) AS rows, count(*) FILTER (kafka_partition < 2 AND kafka_offset <= (SELECT max(kafka_offset) // 2 FROM m)) AS first_run,
                min(kafka_offset) AS least, max(kafka_offset) + 1 AS next_offset FROM m GROUP BY 1""",
        "distinct_month": f"{base.BASE} SELECT {_EXACT} FROM en WHERE event_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31'",
        "distinct_brand_month": f"{base.BASE} SELECT coalesce(brand, 'unknown') AS brand, {_EXACT} FROM en WHERE event_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' GROUP BY 1",
        "anchor_ngrams": f"""{base._ASK}, w AS (SELECT event_id, string_split({_FOLD.format(x="'Top ' || brand || ' của ' || typo || ' tháng 1'")}, ' ') AS w FROM q),
            a AS (SELECT unnest({_list(_ANCHORS)}) AS anchor, unnest(range({len(_ANCHORS)})) AS nth),
            m AS (SELECT event_id, w, i, nth, i + len(string_split(anchor, ' ')) AS p FROM w, unnest(range(1, len(w) + 1)) u(i), a
                  WHERE w[i:i + len(string_split(anchor, ' ')) - 1] = string_split(anchor, ' ')),
            g AS (SELECT event_id, i, nth, k, array_to_string(w[p:p + k], ' ') AS phrase FROM m, unnest([0, 1, 2]) v(k) WHERE p + k <= len(w)
                  AND len(list_filter(w[p:p + k], lambda x: list_contains({_list(_STOPS)}, x) OR regexp_matches(x, '^[0-9]+$') OR x = '')) = 0),
            f AS (SELECT event_id, phrase, min((i, nth, k)) AS place FROM g GROUP BY 1, 2)
            SELECT w.event_id, coalesce(string_agg(phrase, '|' ORDER BY place), '') AS phrases FROM w LEFT JOIN f USING (event_id) GROUP BY 1""",
        "missing_result_fields": f"""{base._ASK}, t AS (SELECT event_id, {_FOLD.format(x="'thương hiệu nào có lượt xem cao, Top ' || brand || ' của ' || typo || ' tháng 1'")} AS x,
                CASE WHEN event_id % 2 = 0 THEN ['brand', 'revenue'] ELSE ['revenue'] END AS c FROM q)
            SELECT event_id, concat_ws(',', {", ".join(f"CASE WHEN {_any('x', terms)} AND len(list_filter(c, lambda y: contains(lower(y), '{name}'))) = 0 THEN '{name}' END" for name, terms in _FIELDS.items())}) AS missing FROM t""",
        "error_classes": f"""{base._LOG} SELECT CASE {" ".join(f"WHEN {_any('e', terms)} THEN '{name}'" for name, terms in _ERRORS.items())} WHEN e = '' THEN 'unknown' ELSE 'other' END AS error_class, count(*) AS n
            FROM (SELECT lower(coalesce(error, '')) AS e FROM lg WHERE status = 'failed') GROUP BY 1""",
        "top_brand_with_item_and_category": f"""{base.DAILY}, pr AS (SELECT brand, product_id, concat_ws('.', coalesce(category_l1, 'unknown'), category_l2, category_l3) AS category, view_count FROM dpr
                WHERE coalesce(brand, 'unknown') <> 'unknown' AND year(event_date) = 2024),
            gr AS (SELECT brand, sum(view_count)::BIGINT AS group_total FROM pr GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8),
            it AS (SELECT brand, product_id, sum(view_count)::BIGINT AS n FROM pr GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY brand ORDER BY n DESC, product_id) = 1),
            ca AS (SELECT brand, category, sum(view_count)::BIGINT AS n FROM pr GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY brand ORDER BY n DESC, category) = 1)
            SELECT gr.brand, group_total, it.product_id AS top_product_id, it.n AS top_product_id_total, ca.category AS top_category, ca.n AS top_category_total FROM gr JOIN it USING (brand) JOIN ca USING (brand)""",
        "search_parts": "SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(concat_ws(' ', p_partkey, p_name, p_brand, p_type, p_size, p_retailprice)), 'brand#1')",
        "search_categories": f"{base.DAILY} SELECT category_l1, category_l2, category_l3, total_events FROM dc WHERE total_events > 2 AND contains(lower(concat_ws(' ', category_l1, category_l2, category_l3, total_events::VARCHAR)), 'standard')",
        "first_hit_windows": f"""{base._LOG.replace("WITH lg", "WITH RECURSIVE lg")}, x AS (SELECT run_id, user_id, created_at, floor(epoch(created_at))::BIGINT AS e FROM lg),
            y AS (SELECT DISTINCT user_id, e FROM x), nx AS (SELECT a.user_id, a.e, min(b.e) AS n FROM y a JOIN y b ON a.user_id = b.user_id AND b.e >= a.e + 86400 GROUP BY 1, 2),
            w AS (SELECT user_id, min(e) AS s FROM y GROUP BY 1 UNION ALL SELECT w.user_id, nx.n FROM w JOIN nx ON nx.user_id = w.user_id AND nx.e = w.s),
            z AS (SELECT x.run_id, x.user_id, e, max(s) AS window_start, any_value(created_at) AS c FROM x JOIN w ON w.user_id = x.user_id AND s <= e GROUP BY 1, 2, 3),
            h AS (SELECT *, row_number() OVER (PARTITION BY user_id, window_start ORDER BY c, run_id) AS hit FROM z)
            SELECT run_id, user_id, window_start, hit, hit <= 2 AS allowed, greatest(2 - hit, 0) AS remaining, window_start + 86400 - e AS retry_after FROM h""",
        "held_alerts": f"""{base._LOG}, x AS (SELECT status, latency_ms / 1000.0::DOUBLE AS sec, floor(epoch(created_at))::BIGINT // 3600 * 3600 + 3600 + 3600 * unnest([0, 1, 2, 3, 4, 5]) AS ev FROM lg),
            le AS (SELECT unnest([{", ".join(map(str, base._LE))}, 'inf'::DOUBLE]::DOUBLE[]) AS le), h AS (SELECT ev, le, count(*) FILTER (sec <= le) AS n FROM x, le GROUP BY 1, 2),
            q AS (SELECT *, coalesce(lag(le) OVER o, 0) AS lo, coalesce(lag(n) OVER o, 0) AS before, 0.95::DOUBLE * max(n) OVER (PARTITION BY ev) AS rank FROM h WINDOW o AS (PARTITION BY ev ORDER BY le)),
            p AS (SELECT ev, CASE WHEN isinf(le) THEN 60.0 ELSE lo + (le - lo) * (rank - before) / (n - before) END AS p95 FROM q WHERE n >= rank QUALIFY row_number() OVER (PARTITION BY ev ORDER BY le) = 1),
            r AS (SELECT ev, count(*) FILTER (status = 'failed')::DOUBLE / count(*) AS er FROM x GROUP BY 1),
            t AS (SELECT 'high_error' AS rule, ev, er AS v FROM r WHERE er > 0.2 UNION ALL SELECT 'slow_p95', ev, p95 FROM p WHERE p95 > 1.0),
            g AS (SELECT *, sum(CASE WHEN ev - before = 3600 THEN 0 ELSE 1 END) OVER (PARTITION BY rule ORDER BY ev) AS run FROM (SELECT *, lag(ev) OVER (PARTITION BY rule ORDER BY ev) AS before FROM t))
            SELECT rule, min(ev) AS active_at, min(ev) + 10800 AS firing_at, max(ev) + 3600 AS resolved_at, count(*) AS evaluations, round(max(v), 6) AS worst FROM g GROUP BY rule, run HAVING count(*) > 3""",
        "counter_increase": """WITH e AS (SELECT (user_id % 8)::VARCHAR AS instance, CAST(ts AS TIMESTAMP) AS ev, event_id FROM events),
            l AS (SELECT *, sum(CASE WHEN event_id % 41 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY instance, ev::DATE ORDER BY ev, event_id ROWS UNBOUNDED PRECEDING) AS life FROM e),
            s AS (SELECT instance, floor(epoch(ev))::BIGINT AS t, row_number() OVER (PARTITION BY instance, ev::DATE, life ORDER BY ev, event_id)::DOUBLE AS v FROM l),
            d AS (SELECT instance, t, max(v) AS v FROM s GROUP BY 1, 2),
            k AS (SELECT *, CASE WHEN b IS NULL THEN 0 WHEN v < b THEN v ELSE v - b END AS inc FROM (SELECT *, lag(v) OVER (PARTITION BY instance ORDER BY t) AS b FROM d)),
            c AS (SELECT *, (t + 3599) // 3600 * 3600 + 3600 * unnest([0, 1, 2, 3, 4, 5]) AS "end" FROM k),
            w AS (SELECT instance, "end", count(*) AS samples, min(t) AS t0, max(t) AS t1, arg_min(v, t) AS v0, sum(inc) - arg_min(inc, t) AS known FROM c WHERE "end" - t < 21600 GROUP BY 1, 2 HAVING count(*) > 1),
            m AS (SELECT *, (t1 - t0)::DOUBLE AS whole, (t1 - t0)::DOUBLE / (samples - 1) AS mean, (t0 - ("end" - 21600))::DOUBLE AS l, ("end" - t1)::DOUBLE AS r FROM w),
            n AS (SELECT *, CASE WHEN l >= 1.1::DOUBLE * mean THEN mean / 2 ELSE l END AS l2, CASE WHEN r >= 1.1::DOUBLE * mean THEN mean / 2 ELSE r END AS r2 FROM m),
            o AS (SELECT *, CASE WHEN known > 0 AND whole * v0 / known < l2 THEN whole * v0 / known ELSE l2 END AS l3 FROM n)
            SELECT instance, "end", samples, round(known * (whole + l3 + r2) / whole, 6) AS increase, round(known * (whole + l3 + r2) / whole / 21600 * 3600, 6) AS per_hour FROM o""",
    }
