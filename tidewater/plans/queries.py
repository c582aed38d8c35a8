"""The registered queries: each takes (spark, sf_dir) and works on whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import columns as fn
from tidewater import schemas
from tidewater.operators import alerts, catalog, clean, distinct, logs, matching, profile, quality, ratelimit, search, serving, star, summaries
from tidewater.operators.refresh import DailyTables
from tidewater.sources import fixtures as fx
from tidewater.sources import tables
from tidewater.sources.scratch import drop_at_exit, shared_path
from tidewater.streaming import upsert
from tidewater.streaming.rates import sliding_quantiles

AS_OF = "2024-02-03 00:00:00"
_AUDIT = ("silver_processed_at", "gold_processed_at", "created_at", "updated_at")


def _at() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def _plain(df: DataFrame) -> DataFrame:
    """Without audit columns."""
    return df.drop(*_AUDIT)


#: By application, folder and name: what the input's files were, and where the layer lies.
_LAYERS: dict[tuple[str, str, str], tuple[int, str]] = {}


def _layer(spark: SparkSession, sf_dir: str, name: str, make: Callable[[str], object]) -> str:
    """The path of a written layer, made when first asked for and again when the files it comes from have changed;
    the outdated one is removed, the last when the application ends."""
    stamp = hash(tuple(f for t in ("events", "part") for f in tables.listing(spark, f"{sf_dir}/{t}.parquet")))
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key in _LAYERS:
        found, path = _LAYERS[key]
        if found == stamp:
            return path
        tables.remove(spark, path)
    path = shared_path(spark, f"gold-{name}")
    make(path)
    drop_at_exit(spark, path)
    _LAYERS[key] = (stamp, path)
    return path


def forget_layers(spark: SparkSession) -> None:
    """Removes the written layers of this application; they are made again when asked for."""
    for key in [k for k in _LAYERS if k[0] == spark.sparkContext.applicationId]:
        tables.remove(spark, _LAYERS.pop(key)[1])


class Gold:
    """The layers over one folder of tables.  Staging, the product dimension and the summaries are written
    when first asked for, and served from there."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.raw = fx.raw_events(spark, sf_dir)
        self.silver = clean.silver(self.raw, _at())

    def _stored(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        return self.spark.read.parquet(_layer(self.spark, self.sf_dir, name, lambda path: make().write.parquet(path)))

    @property
    def stg(self) -> DataFrame:
        return self._stored("stg_events", lambda: star.staging(self.silver, _at()))

    @property
    def events(self) -> DataFrame:
        return star.fact_events(self.stg, _at())

    @property
    def sales(self) -> DataFrame:
        return star.fact_sales(self.events, _at())

    @property
    def product(self) -> DataFrame:
        return self._stored("dim_product", lambda: star.dim_product(self.stg, _at()))

    def daily(self, which: str) -> DataFrame:
        return self._stored(f"daily_{which}", lambda: summaries.build(which, self.events, self.product, _at())[which])


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    _QUERIES[f.__name__] = f
    return f


def _gold(name: str, make: Callable[[Gold], DataFrame]) -> None:
    _QUERIES[name] = lambda spark, sf_dir: make(Gold(spark, sf_dir))


# ---------------------------------------------------------------- bronze and silver


@_query
def bronze_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fx.raw_events(spark, sf_dir)
    fields = ["event_time", "event_type", "product_id", "category_id", "category_code", "brand", "price", "user_id", "user_session"]
    messages = raw.select(F.to_json(F.struct(*fields)).alias("value"), F.col("kafka_ts").alias("timestamp"), F.col("kafka_partition").alias("partition"), F.col("kafka_offset").alias("offset"))
    return tables.bronze(messages, _at()).drop("ingested_at", "kafka_ts")


@_query
def offset_high_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fx.raw_events(spark, sf_dir)
    stored = tables.next_offsets(raw.where("kafka_offset < 1000000000 AND kafka_partition < 2"), "events")
    return tables.next_offsets(raw.where("kafka_partition > 0"), "events", stored)


_gold("silver_clean", lambda g: _plain(g.silver).drop("kafka_ts", "bronze_ingested_at", "event_ts"))
_gold("silver_invalid_reasons", lambda g: g.silver.where("NOT is_valid").groupBy("invalid_reason").agg(F.count(F.lit(1)).alias("n")))
_gold("silver_split", lambda g: g.silver.groupBy("is_valid").agg(F.count(F.lit(1)).alias("n")))
_ARRIVED = ("event_fingerprint", "source_event_id", *clean.ARRIVAL)
_gold("silver_dedup", lambda g: clean.keep_latest(g.silver.where("is_valid").select(*_ARRIVED), ["event_fingerprint"]).select("event_fingerprint", "source_event_id", "kafka_offset"))
_gold("category_levels", lambda g: g.silver.select("category_code", "category_l1", "category_l2", "category_l3").distinct())
_gold("fingerprint", lambda g: g.silver.select("source_event_id", "event_fingerprint"))


@_query
def new_rows_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    silver = Gold(spark, sf_dir).silver.where("is_valid").select(*_ARRIVED)
    fresh = clean.new_rows(clean.keep_latest(silver, ["event_fingerprint"]), silver.where(F.col("kafka_partition") == 0))
    return fresh.select("event_fingerprint", "source_event_id")


@_query
def refresh_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    silver = Gold(spark, sf_dir).silver.select("event_fingerprint", "is_valid", "kafka_partition")
    return quality.refresh_counters(silver, silver.where("is_valid AND kafka_partition = 0"))


# ---------------------------------------------------------------- incremental silver and gold


def _incremental(spark: SparkSession, sf_dir: str) -> str:
    """Silver and daily summaries from three batches of two streams: most events and a summary of all; the rest of two
    days, late, and their refresh; a part of both again under another stream's numbers, which adds nothing."""

    def make(path: str) -> None:
        raw = schemas.conform(fx.raw_events(spark, sf_dir), schemas.BRONZE)
        late = F.dayofmonth("kafka_ts").isin(5, 17) & (F.col("kafka_offset") % 2 == 0)
        daily = DailyTables(spark, f"{path}/silver", f"{path}/gold")
        for stream, number, rows in (("a", 0, raw.where(~late)), ("a", 1, raw.where(late)), ("b", 0, raw.where("kafka_partition = 1"))):
            done = upsert.upsert(rows, stream, number, f"{path}/silver", f"{path}/quarantine", _at())
            daily.refresh(done.days, _at())

    return _layer(spark, sf_dir, "incremental", make)


def _refreshed(which: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _incremental(spark, sf_dir)
        return _plain(DailyTables(spark, f"{path}/silver", f"{path}/gold").read(which))

    return run


for _which in ("event", "product", "category", "brand"):
    _QUERIES[f"refreshed_daily_{_which}"] = _refreshed(_which)


@_query
def upserted_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(schemas.SILVER).parquet(f"{_incremental(spark, sf_dir)}/silver").select("event_fingerprint", "event_date", "event_type", "product_id", "price")


@_query
def upserted_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(schemas.QUARANTINE).parquet(f"{_incremental(spark, sf_dir)}/quarantine").select("source_event_id", "invalid_reason")


@_query
def upsert_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = upsert.commits(spark, f"{_incremental(spark, sf_dir)}/silver")
    return found.select("stream", "batch_id", "valid", "invalid", "deduped", "skipped", "written", "quarantined", F.concat_ws(",", F.transform("days", lambda d: d.cast("string"))).alias("days"))


@_query
def bronze_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over a message log that grows between them: what each partition has in Bronze, and the offsets stored."""

    def make(path: str) -> None:
        raw = fx.raw_events(spark, sf_dir).where("kafka_offset < 1000000000")
        fields = ["event_time", "event_type", "product_id", "category_id", "category_code", "brand", "price", "user_id", "user_session"]
        messages = raw.select(F.to_json(F.struct(*fields)).alias("value"), F.col("kafka_ts").alias("timestamp"), F.col("kafka_partition").alias("partition"), F.col("kafka_offset").alias("offset"))
        last = raw.agg(F.max("kafka_offset")).first()[0] or 0
        half, segment = last // 2, max(100, -(-last // 16))  # a long log has wider segments, not more folders
        for run, rows in (("first", messages.where((F.col("offset") <= half) & (F.col("partition") < 2))), ("second", messages.where((F.col("offset") > half) | (F.col("partition") >= 2)))):
            tables.append_messages(rows, f"{path}/log", segment=segment)
            tables.ingest_messages(spark, f"{path}/log", f"{path}/offsets", "events", f"{path}/bronze", F.lit("2024-02-01" if run == "first" else "2024-02-02").cast("timestamp"), segment=segment)

    path = _layer(spark, sf_dir, "bronze-increment", make)
    held = spark.read.schema(schemas.BRONZE).parquet(f"{path}/bronze").groupBy(F.col("kafka_partition").alias("partition")).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.dayofmonth("ingested_at") == 1).alias("first_run"), F.min("kafka_offset").alias("least"))
    return held.join(spark.read.parquet(f"{path}/offsets").select("partition", "next_offset"), "partition")


# ---------------------------------------------------------------- star

_gold("stg_events", lambda g: _plain(g.stg).drop("event_ts", "kafka_ts"))
_gold("fact_events", lambda g: _plain(g.events).drop("event_ts", "kafka_ts"))
_gold("fact_sales", lambda g: _plain(g.sales).drop("sale_ts"))
_gold("dim_time", lambda g: _plain(star.dim_time(g.stg, _at())))
_gold("dim_product", lambda g: _plain(g.product))
_gold("dim_user", lambda g: _plain(star.dim_user(g.events, g.sales, _at())))
_gold("dim_session", lambda g: _plain(star.dim_session(g.events, g.sales, _at())))


@_query
def star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Gold(spark, sf_dir)
    wide = star.star_join(
        g.sales, (star.dim_time(g.stg), "time_id", ["day_of_week", "is_weekend"]), (g.product, "product_id", ["brand", "category_l1"]),
        (star.dim_user(g.events, g.sales), "user_id", ["total_events"]), (star.dim_session(g.events, g.sales), "session_id", ["has_purchase"]),
    )
    return wide.groupBy("is_weekend", "brand").agg(F.count(F.lit(1)).alias("sales"), fn.money(F.sum("gross_amount")).alias("revenue"), F.count_if("has_purchase").alias("with_purchase"), F.sum("total_events").alias("user_events"))


@_query
def sales_to_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales with their events and the user of their session, by type and hour."""
    g = Gold(spark, sf_dir)
    wide = star.star_join(g.sales.select("event_fingerprint", "session_id", "gross_amount"), (g.events, "event_fingerprint", ["event_type", "time_id"]), (star.dim_session(g.events, g.sales), "session_id", ["user_id"]))
    wide = star.star_join(wide, (star.dim_user(g.events, g.sales), "user_id", ["total_purchases"]))
    return wide.groupBy("event_type", F.substring("time_id", 9, 2).alias("hour")).agg(F.count(F.lit(1)).alias("sales"), fn.money(F.sum("gross_amount")).alias("revenue"), F.sum("total_purchases").alias("user_purchases"))


# ---------------------------------------------------------------- summaries

_gold("revenue_by_date", lambda g: summaries.revenue_by_date(g.sales))
_gold("revenue_by_product", lambda g: summaries.revenue_by_product(g.sales))
_gold("revenue_by_category", lambda g: summaries.revenue_by_category(g.sales, g.product))
_gold("revenue_by_brand", lambda g: summaries.revenue_by_brand(g.sales, g.product))
_gold("daily_event_summary", lambda g: _plain(g.daily("event")))
_gold("daily_product_summary", lambda g: _plain(g.daily("product")))
_gold("daily_category_summary", lambda g: _plain(g.daily("category")))
_gold("daily_brand_summary", lambda g: _plain(g.daily("brand")))

# ---------------------------------------------------------------- contracts

_gold("summary_reconcile", lambda g: quality.reconcile(g.daily("event").where(F.dayofmonth("event_date") != 3), g.events, g.sales))
_gold("key_violations", lambda g: quality.key_contract(g.silver, "event_fingerprint", "silver").unionByName(quality.key_contract(g.daily("brand"), "summary_id", "daily_brand_summary")))
_gold("fact_contract", lambda g: quality.fact_contract(g.events, g.sales))
_gold("dimension_contract", lambda g: quality.key_contract(g.product, "product_id", "dim_product").unionByName(quality.key_contract(star.dim_user(g.events, g.sales), "user_id", "dim_user")))
_gold("duplicate_keys", lambda g: quality.duplicate_keys(g.raw, ["kafka_partition", "event_time", "user_id", "product_id"]))
_gold("orphan_products", lambda g: quality.orphans(g.silver.select("product_id", "brand").distinct(), g.product, ["product_id"]))

# ---------------------------------------------------------------- serving

_gold("kpi_overview", lambda g: serving.overview(g.daily("event"), g.daily("brand"), "2024-01-20"))
_gold("mtd_totals", lambda g: serving.month_to_date(g.daily("event"), "2024-01-15"))
_gold("latest_day", lambda g: serving.latest_day(g.daily("event"), "2024-01-25"))
_gold("revenue_series", lambda g: serving.revenue_series(g.daily("event"), "2024-01-05", "2024-01-25"))
_gold("top_brands", lambda g: serving.top(serving.brands(g.daily("brand"), exclude_unknown=True), "revenue", 10, "brand"))
_gold("top_categories", lambda g: serving.top(serving.categories(g.daily("category")), "revenue", 10, "category_l1", "category_l2", "category_l3"))
_gold("top_products", lambda g: serving.top(serving.products(g.daily("product")), "revenue", 10, "product_id"))
_gold("top_brand_with_top_item", lambda g: serving.top_related(serving.between_dates(g.daily("product").where(fn.known_member(fn.or_unknown(F.col("brand")))), start="2024-01-01", end="2024-12-31"), "brand", "product_id", "view_count", 8))
_gold("top_brand_with_item_and_category", lambda g: serving.top_with_best(serving.between_dates(g.daily("product").where(fn.known_member(fn.or_unknown(F.col("brand")))), start="2024-01-01", end="2024-12-31").withColumn("category", F.concat_ws(".", fn.or_unknown(F.col("category_l1")), "category_l2", "category_l3")), "brand", ["product_id", "category"], "view_count", 8))
_gold("brands_by_views_year", lambda g: serving.top(serving.brands(serving.between_dates(g.daily("brand"), start="2024-01-01", end="2024-12-31"), True).select("brand", "views"), "views", 8, "brand"))
_gold("brands_by_carts", lambda g: serving.top(serving.brands(g.daily("brand"), True).select("brand", "carts"), "carts", 4, "brand"))
_gold("brands_latest_month", lambda g: serving.top(serving.brands(serving.latest_month(g.daily("brand"))).select("brand", "revenue"), "revenue", 10, "brand"))
_gold("revenue_latest_month", lambda g: serving.latest_month(g.daily("event")).select("event_date", "total_revenue"))
_gold("best_conversion_category", lambda g: serving.top(serving.categories(g.daily("category")).select("category_l1", "category_l2", "category_l3", "conversion_rate", "views"), "conversion_rate", 1, "category_l1", "category_l2", "category_l3"))
_gold("most_viewed_product", lambda g: serving.top(serving.products(g.daily("product")).select("product_id", "views"), "views", 1, "product_id"))
_gold("brand_ci_filter", lambda g: g.daily("brand").where(fn.ci_equals(F.col("brand"), " BRAND#1 ") | fn.ci_equals(F.col("brand"), "Brand#11")).select("event_date", "brand", "view_count"))
_gold("date_range_filter", lambda g: serving.between_dates(g.daily("brand"), start="2024-01-10", end="not a date").select("event_date", "brand", "revenue"))
_gold("summary_preview", lambda g: serving.preview(g.daily("brand"), 10, "event_date", "brand").select("event_date", "brand", "view_count", "revenue"))
_gold("page_offset", lambda g: serving.page(g.daily("brand").select("event_date", "brand", "revenue"), 3, 20, F.col("revenue").desc_nulls_last(), F.col("event_date").asc_nulls_last(), F.col("brand").asc_nulls_last()))
_gold("column_totals", lambda g: serving.column_totals(g.daily("brand").select("brand", "view_count", "cart_count", "purchase_count", "revenue", "unique_users")))
_gold("search_rows", lambda g: serving.search_all(g.daily("category").select("category_l1", "category_l2", "category_l3", "total_events").where("total_events > 2"), "standard"))
_gold("top_revenue_rows", lambda g: serving.top(g.daily("product").select("summary_id", "revenue"), "revenue", 20, "summary_id"))
_gold("top_revenue_categories", lambda g: serving.top(g.daily("category").select("summary_id", "revenue"), "revenue", 20, "summary_id"))
_gold("top_revenue_brands", lambda g: serving.top(g.daily("brand").select("summary_id", "revenue"), "revenue", 20, "summary_id"))
_gold("most_viewed_brand_month", lambda g: serving.top(serving.brands(serving.between_dates(g.daily("brand"), start="2024-01-01", end="2024-01-31"), True).select("brand", "views"), "views", 1, "brand"))
_gold("event_totals", lambda g: g.events.rollup("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_purchase").alias("purchases"), F.coalesce(fn.money(F.sum(F.when(F.col("is_purchase"), F.col("price")))), fn.money(0)).alias("gross")))
_gold("brand_not_filter", lambda g: g.daily("brand").where(fn.ci_not_equals(F.col("brand"), " BRAND#1 ")).select("event_date", "brand", "view_count"))


def _month(g: Gold, *keys: str) -> DataFrame:
    """Distinct counts of January from the sketches of its days, and whether they are as near to the exact ones as stated."""
    sketches = g._stored("daily_sketches" + "".join(f"_{k}" for k in keys), lambda: distinct.daily_sketches(summaries.with_product(g.events, g.product).withColumn("brand", fn.or_unknown(F.col("brand"))), *keys))
    near = distinct.united(sketches, *keys, start="2024-01-01", end="2024-01-31")
    exact = summaries.with_product(serving.between_dates(g.events, start="2024-01-01", end="2024-01-31"), g.product).withColumn("brand", fn.or_unknown(F.col("brand")))
    names = list(distinct.MEASURES)
    exact = exact.groupBy(*keys).agg(*[F.count_distinct(distinct.MEASURES[n]).alias(f"exact_{n}") for n in names])
    both = near.join(exact, list(keys)) if keys else near.crossJoin(F.broadcast(exact))  # one row each
    close = [(F.abs(F.col(n) - F.col(f"exact_{n}")) <= F.ceil(F.col(f"exact_{n}") * distinct.BOUND)).alias(f"{n}_close") for n in names]
    return both.select(*keys, *[f"exact_{n}" for n in names], *close)


_gold("distinct_month", lambda g: _month(g))
_gold("distinct_brand_month", lambda g: _month(g, "brand"))


@_query
def search_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that hold a text in any column, by the trigram index."""

    def make(path: str) -> None:
        search.TrigramIndex.write(fx.table(spark, sf_dir, "part"), path)

    return search.TrigramIndex(spark, _layer(spark, sf_dir, "part-index", make)).search("Brand#1").select("p_partkey", "p_name", "p_brand")


@_query
def search_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as ``search_rows``, by the trigram index."""

    def make(path: str) -> None:
        rows = Gold(spark, sf_dir).daily("category").select("category_l1", "category_l2", "category_l3", "total_events").where("total_events > 2")
        search.TrigramIndex.write(rows, path)

    return search.TrigramIndex(spark, _layer(spark, sf_dir, "category-index", make)).search("STANDARD")


@_query
def last_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.last_n(fx.query_log(spark, sf_dir).select("run_id", "user_id", "status"), "run_id", 50)


@_query
def lineitem_brand_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaderboard on the sales star: items and net price by month and brand, in exact decimals."""
    net = F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))
    items = fx.table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", net.alias("net"))
    part = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    month = F.trunc("l_shipdate", "month")
    return items.join(part, "l_partkey").groupBy(month.alias("month"), "p_brand").agg(F.count(F.lit(1)).alias("items"), F.sum("net").cast("decimal(18,2)").cast("double").alias("net"))


# ---------------------------------------------------------------- profiles

_gold("value_counts", lambda g: profile.value_counts(g.events, "event_type"))
_gold("null_counts", lambda g: profile.null_counts(g.silver.select("event_ts", "product_id", "category_code", "category_l3", "user_id", "price", "invalid_reason")))
_gold("category_depth", lambda g: profile.category_depth(g.raw))
_gold("non_digit_ids", lambda g: g.raw.where(fn.not_digits(F.col("product_id"))).groupBy("product_id").agg(F.count(F.lit(1)).alias("n")))
_gold("repeated_values", lambda g: profile.repeated_values(g.daily("brand"), "brand"))
_gold("column_kinds", lambda g: profile.profile(g.daily("product")).drop("distinct_values"))

# ---------------------------------------------------------------- text


@_query
def text_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag, term = fn.tag_terms(fn.fold_accents(F.col("text")), fn.RISKY_TERMS)
    return fx.table(spark, sf_dir, "documents").select("doc_id", tag.alias("category"), term.alias("term"))


@_query
def sql_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("sql_text")
    audited = fx.sql_texts(spark, sf_dir).select(fn.readonly_class(t).alias("class"), fn.has_limit(t).alias("has_limit"), F.size(fn.unnormalised_literals(t, fn.TEXT_COLUMNS)).cast("bigint").alias("bad_literals"))
    return audited.groupBy("class", "has_limit", "bad_literals").agg(F.count(F.lit(1)).alias("n"))


@_query
def accent_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(fn.fold_accents(F.col("text"))).alias("folded"), F.length(fn.fold_words(F.col("text"))).cast("bigint").alias("n"))


@_query
def session_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", fn.session_title(F.col("text")).alias("title"))


def _typos(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    asked = fx.questions(spark, sf_dir)
    return asked.select(F.col("typo").alias("candidate")).distinct(), asked.select(F.col("brand").alias("value")).distinct()


@_query
def fuzzy_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.near_pairs(*_typos(spark, sf_dir)).select("candidate", "value", F.col("distance").cast("bigint").alias("distance"))


@_query
def fuzzy_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.best_matches(*_typos(spark, sf_dir))


@_query
def anchor_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = fx.questions(spark, sf_dir)
    return asked.select("event_id", F.concat_ws("|", fn.anchor_phrases(F.col("question"), fn.BRAND_ANCHORS, fn.PHRASE_STOPS)).alias("phrases"))


@_query
def missing_result_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = fx.questions(spark, sf_dir)
    columns = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("brand"), F.lit("revenue"))).otherwise(F.array(F.lit("revenue")))
    words = F.concat(F.lit("thương hiệu nào có lượt xem cao, "), "question")
    return asked.select("event_id", F.concat_ws(",", fn.missing_fields(words, columns, fn.EXPECTED_FIELDS)).alias("missing"))


# ---------------------------------------------------------------- logs


@_query
def session_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.session_rollup(fx.query_log(spark, sf_dir), "run_id", "status")


@_query
def turn_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.turn_index(fx.query_log(spark, sf_dir), "session_id", "created_at", "run_id").select("run_id", "session_id", F.col("turn_index").cast("bigint").alias("turn_index"))


@_query
def session_last_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(": ", "role", "text")
    found = logs.last_turns(fx.table(spark, sf_dir, "conversations"), "conv_id", "turn", 4, text)
    return found.select("conv_id", "n_turns", F.md5("context").alias("context"), F.md5("last_text").alias("last_text"))


@_query
def favourite_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fx.query_log(spark, sf_dir).withColumn("question", F.concat(F.lit("Question "), F.col("run_id").cast("string")))
    found = logs.search_runs(log, ["failed"], "question 1", F.lit("2024-01-05").cast("timestamp"), None, fx.favourites(spark, sf_dir))
    return found.select("run_id", "user_id", "status", "latency_ms")


@_query
def failed_runs_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a filtered listing with the listing's total."""
    log = fx.query_log(spark, sf_dir).withColumn("question", F.concat(F.lit("Question "), F.col("run_id").cast("string")))
    listing = logs.search_runs(log, ["failed"], "question 1").select("run_id", "user_id", "latency_ms")
    return serving.with_total(serving.page(listing, 2, 10, F.col("run_id").desc()), listing)


@_query
def session_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn")
    turns = fx.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.coalesce("text", F.lit("")).alias("question"), F.when(turn % 2 == 0, F.concat(F.lit("SELECT "), turn.cast("string"))).otherwise("").alias("sql"),
        F.when(turn % 3 > 0, F.array(F.lit("event_date"), F.lit("total_revenue"))).otherwise(F.array().cast("array<string>")).alias("columns"),
        F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: i * 100 + turn).alias("rows"),
    )
    found = logs.session_context(turns, "conv_id", "turn")
    return found.select("conv_id", F.md5("conversation_summary").alias("summary"), F.md5("last_question").alias("last_question"), "last_sql", F.array_join("last_result_columns", ",").alias("last_columns"), F.array_join(F.transform("last_result_sample", lambda x: x.cast("string")), ",").alias("sample"))


@_query
def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.errors_by_class(fx.query_log(spark, sf_dir))


@_query
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = logs.run_counters(fx.query_log(spark, sf_dir), F.to_date("created_at").alias("day"))
    return out.select("day", "requests", F.round("success_pct", 6).alias("success_pct"), F.round("error_pct", 6).alias("error_pct"), "retries")


@_query
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.status_counts(fx.query_log(spark, sf_dir))


@_query
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.latency_histogram(fx.query_log(spark, sf_dir), "status")


@_query
def latency_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = logs.latency_histogram(fx.query_log(spark, sf_dir), "status")
    parts = [logs.bucket_quantile(h, q, "status").select("status", F.lit(q).alias("q"), F.round("quantile", 6).alias("quantile")) for q in (0.5, 0.95)]
    return parts[0].unionByName(parts[1])


@_query
def exact_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = logs.exact_quantiles(fx.query_log(spark, sf_dir), 0.5, 0.95, 0.99)
    return one.select(*[F.round(c, 6).alias(c) for c in one.columns])


@_query
def pipeline_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.pipeline_state(fx.pipeline_runs(spark, sf_dir), F.lit("2024-03-01").cast("timestamp")).drop("last_success")


@_query
def fixed_window_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = fx.query_log(spark, sf_dir).select("run_id", "user_id", "created_at")
    return logs.fixed_window_limit(hits, "user_id", "created_at", 2, 86400, "run_id").drop("created_at")


@_query
def sliding_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = logs.sliding_latency(fx.query_log(spark, sf_dir))
    return out.select(F.unix_timestamp("window_start").alias("window_start"), F.round("quantile", 6).alias("p95"))


@_query
def pipeline_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fx.query_log(spark, sf_dir)
    day = F.to_date("created_at").alias("day")
    p95 = log.groupBy(day).agg(F.percentile(F.col("latency_ms") / 1000.0, 0.95).alias("p95"), (F.max("run_id") * 10).alias("stale_sec"))
    found = logs.alerts(logs.run_counters(log, day).join(p95, "day"), F.col("p95"), F.col("stale_sec"))
    return found.select("day", "high_error", "slow_p95", "stale")


@_query
def sliding_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = logs.sliding_error_rate(fx.query_log(spark, sf_dir))
    return out.select(F.unix_timestamp("window_start").alias("window_start"), "requests", "errors", F.round("error_ratio", 6).alias("error_ratio"))


@_query
def first_hit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate limit whose window starts at a user's first hit after the last one's end."""
    hits = fx.query_log(spark, sf_dir).select("run_id", "user_id", "created_at")
    return ratelimit.first_hit_windows(hits, "user_id", "created_at", 2, 86400, "run_id").drop("created_at")


@_query
def held_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Firings of two rules over six hours, evaluated every hour, that hold for three: failed share, and slow p95."""
    rates = sliding_quantiles(fx.query_log(spark, sf_dir), 0.95, size="6 hours", slide="1 hour")
    end = rates.withColumn("at", F.col("window_start") + F.expr("INTERVAL 6 HOURS"))
    rules = {"high_error": (F.col("error_ratio") > 0.2, F.col("error_ratio")), "slow_p95": (F.col("p95") > 1.0, F.col("p95"))}
    found = [alerts.held(end, "at", c, 3 * 3600, 3600, value=v).withColumn("rule", F.lit(name)) for name, (c, v) in rules.items()]
    both = reduce(DataFrame.unionByName, found)
    return both.select("rule", *[F.unix_timestamp(c).alias(c) for c in ("active_at", "firing_at", "resolved_at")], "evaluations", F.round("worst", 6).alias("worst"))


@_query
def counter_increase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth over six hours, every hour, of request counters that begin again when their process restarts."""
    found = alerts.counter_increase(fx.request_counters(spark, sf_dir), "at", "value", 6 * 3600, 3600, "instance")
    return found.select("instance", F.unix_timestamp("end").alias("end"), "samples", F.round("increase", 6).alias("increase"), F.round(F.col("rate") * 3600, 6).alias("per_hour"))


# ---------------------------------------------------------------- catalog


@_query
def catalog_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested catalog of live tables: columns with their nulls, and the rows of each table."""
    live = {f"stg_{n}": fx.table(spark, sf_dir, n) for n in ("events", "part", "orders")}
    schemas_ = {n: d.schema for n, d in live.items()}
    found = catalog.nested(catalog.visible(catalog.table_catalog(spark, schemas_, hidden=())), catalog.column_catalog(spark, schemas_))
    counted = reduce(DataFrame.unionByName, [profile.profile(d).select(F.lit(n).alias("table_name"), "column_name", "kind", "rows", "nulls") for n, d in live.items()])
    nulls = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "column_name", "kind", F.col("nulls").cast("string")))), ",")
    return found.join(counted.groupBy("table_name").agg(F.max("rows").alias("n_rows"), nulls.alias("columns_found")), "table_name").select("table_name", "n_columns", "n_rows", "columns_found")


@_query
def table_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = fx.table(spark, sf_dir, "events").select(F.concat(F.when(F.col("event_id") % 3 == 0, "gold.fact_").when(F.col("event_id") % 3 == 1, "dim_").otherwise("daily_x_summary_"), "event_type").alias("table_name"))
    return kinds.groupBy("table_name", fn.table_kind(F.col("table_name")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from tidewater.plans import stored

    return {**_QUERIES, **stored.queries()}
