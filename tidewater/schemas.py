"""One StructType per table: the order of columns, their types, and the contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(), "date": T.DateType(), "price": T.DecimalType(10, 2), "money": T.DecimalType(18, 2),
}


def _table(**groups: str) -> T.StructType:
    """Fields by name; a group ``_1='name name: type; name: type'`` keeps the order of columns."""
    fields = []
    for part in groups["columns"].split(";"):
        names, kind = part.split(":")
        fields += [T.StructField(n, _TYPES[kind.strip()]) for n in names.split()]
    return T.StructType(fields)


_CATEGORY = "category_code category_l1 category_l2 category_l3 brand: string"
_CALENDAR = "event_date: date; event_year event_month event_day event_hour: int"
_OFFSETS = "kafka_ts: timestamp; kafka_partition: int; kafka_offset: bigint"
_RATES = "conversion_rate cart_to_purchase_rate: double; gold_processed_at: timestamp"

RAW_EVENT = _table(columns="event_time event_type product_id category_id category_code brand price user_id user_session: string")
BRONZE = _table(columns="event_time event_type product_id category_id category_code brand price user_id user_session: string;" + _OFFSETS + "; ingested_at: timestamp; date_partition: date")
SILVER = _table(columns=f"source_event_id event_fingerprint: string; event_ts: timestamp; {_CALENDAR}; event_type: string; product_id category_id: bigint; {_CATEGORY}; price: price; user_id: bigint; user_session: string; {_OFFSETS}; bronze_ingested_at silver_processed_at: timestamp; is_valid: boolean; invalid_reason: string")
QUARANTINE = T.StructType([*SILVER.fields, T.StructField("processing_date", T.DateType())])
STG_EVENTS = _table(columns=f"event_fingerprint source_event_id time_id: string; event_ts: timestamp; {_CALENDAR}; event_type: string; product_id category_id: bigint; {_CATEGORY}; price: money; user_id: bigint; session_id: string; {_OFFSETS}; silver_processed_at gold_processed_at: timestamp")
FACT_EVENTS = _table(columns="event_fingerprint source_event_id time_id: string; event_ts: timestamp; event_date: date; event_type: string; product_id user_id: bigint; session_id: string; price: money; is_view is_cart is_remove_from_cart is_purchase: boolean; kafka_partition: int; kafka_offset: bigint; kafka_ts silver_processed_at gold_processed_at: timestamp")
FACT_SALES = _table(columns="sale_id event_fingerprint source_event_id time_id: string; sale_ts: timestamp; sale_date: date; product_id user_id: bigint; session_id: string; unit_price: money; quantity: int; gross_amount: money; gold_processed_at: timestamp")
DIM_TIME = _table(columns=f"time_id: string; {_CALENDAR}; day_of_week: int; day_name month_name: string; quarter: int; is_weekend: boolean; created_at updated_at: timestamp")
DIM_PRODUCT = _table(columns=f"product_id category_id: bigint; {_CATEGORY}; first_seen_at last_seen_at: timestamp; avg_observed_price min_observed_price max_observed_price: money; record_count: bigint; created_at updated_at: timestamp")
DIM_USER = _table(columns="user_id: bigint; first_seen_at last_seen_at: timestamp; total_sessions total_events total_views total_cart_adds total_remove_from_carts total_purchases: bigint; total_revenue: money; created_at updated_at: timestamp")
DIM_SESSION = _table(columns="session_id: string; user_id: bigint; session_start_at session_end_at: timestamp; session_duration_sec event_count view_count cart_count remove_from_cart_count purchase_count: bigint; session_revenue: money; has_purchase: boolean; created_at updated_at: timestamp")
DAILY_EVENT = _table(columns=f"event_date: date; total_events total_views total_carts total_remove_from_carts total_purchases unique_users unique_sessions unique_products unique_events: bigint; total_revenue avg_event_price: money; {_RATES}")
DAILY_PRODUCT = _table(columns=f"summary_id: string; event_date: date; product_id: bigint; brand category_l1 category_l2 category_l3: string; view_count cart_count purchase_count remove_from_cart_count unique_events unique_users unique_sessions: bigint; revenue avg_price min_price max_price: money; {_RATES}")
DAILY_CATEGORY = _table(columns=f"summary_id: string; event_date: date; category_l1 category_l2 category_l3: string; total_events view_count cart_count purchase_count remove_from_cart_count unique_events unique_users unique_products: bigint; revenue: money; {_RATES}")
DAILY_BRAND = _table(columns=f"summary_id: string; event_date: date; brand: string; view_count cart_count purchase_count remove_from_cart_count unique_events unique_users unique_products: bigint; revenue: money; {_RATES}")
OFFSETS = _table(columns="topic: string; partition: int; next_offset: bigint")
TABLE_CATALOG = _table(columns="table_name display_name purpose grain use_for notes: string; is_agent_visible: boolean")
COLUMN_CATALOG = _table(columns="table_name column_name data_type display_name meaning role: string; is_agent_visible: boolean")

GOLD = {
    "stg_events": STG_EVENTS, "fact_events": FACT_EVENTS, "fact_sales": FACT_SALES, "dim_time": DIM_TIME, "dim_product": DIM_PRODUCT,
    "dim_user": DIM_USER, "dim_session": DIM_SESSION, "daily_event_summary": DAILY_EVENT, "daily_product_summary": DAILY_PRODUCT,
    "daily_category_summary": DAILY_CATEGORY, "daily_brand_summary": DAILY_BRAND,
}


def conform(df: DataFrame, schema: T.StructType, **named: Column | str) -> DataFrame:
    """``df`` in the order and types of ``schema``; ``named`` gives columns made or renamed here."""
    made = {k: F.col(v) if isinstance(v, str) else v for k, v in named.items()}
    return df.select(*[made.get(f.name, F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
