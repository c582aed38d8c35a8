"""E-commerce events and logs derived from the driver's tables, by fixed rules, over all their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze-shaped events with dirt of every kind, and one event in twenty delivered again."""
    c, n = F.col, F.col("event_id")
    events = table(spark, sf_dir, "events").select(
        "event_id", c("ts").cast("timestamp").alias("ts"), c("user_id").cast("string").alias("u"), "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        F.when(c("event_type") == "click", "cart").when(c("event_type") == "signup", "remove_from_cart").otherwise(c("event_type")).alias("m"),
    )
    part = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    part = part.select(c("p_partkey").alias("k"), "p_brand", F.lower("p_type").alias("c1"), F.get(words, F.lit(1)).alias("c2"), F.get(words, F.lit(0)).alias("c3"))
    dot, k = F.lit("."), F.col("k")
    code = (
        F.when(n % 89 == 0, " NaN ").when(k % 5 == 0, c("c1")).when(k % 5 == 1, F.concat("c1", dot, "c2"))
        .when(k % 5 == 2, F.concat("c1", dot, "c2", dot, "c3", F.lit(".x"))).otherwise(F.concat("c1", dot, "c2", dot, "c3"))
    )
    raw = events.join(part, "k", "left").select(
        "event_id",
        F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")).alias("event_time"),
        F.when(n % 50 == 7, F.concat(F.lit(" "), F.upper("m"), F.lit(" "))).otherwise(c("m")).alias("event_type"),
        F.when(n % 97 == 0, "abc").otherwise(k.cast("string")).alias("product_id"),
        (2000000 + k % 7).cast("string").alias("category_id"),
        code.alias("category_code"),
        F.when(k % 10 == 0, "").otherwise(c("p_brand")).alias("brand"),
        F.when(n % 83 == 0, "-1.00").otherwise(c("value").cast("decimal(10,2)").cast("string")).alias("price"),
        F.when(n % 101 != 0, c("u")).alias("user_id"),
        F.concat(F.lit(" "), "u", F.lit("-"), F.date_format("ts", "yyyyMMdd"), F.lit(" ")).alias("user_session"),
        (c("ts") + F.expr("INTERVAL 1 SECOND")).alias("kafka_ts"),
        (n % 3).cast("int").alias("kafka_partition"),
        F.floor(n / 3).cast("bigint").alias("kafka_offset"),
        F.lit("2024-02-01 00:00:00").cast("timestamp").alias("ingested_at"),
    )
    raw = raw.withColumn("again", F.explode(F.when(n % 20 == 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    raw = raw.withColumn("kafka_offset", c("kafka_offset") + F.when(c("again"), 1000000000).otherwise(0))
    raw = raw.withColumn("ingested_at", F.when(c("again"), F.lit("2024-02-02 00:00:00").cast("timestamp")).otherwise(c("ingested_at"))).drop("again")
    return raw.withColumn("date_partition", F.to_date("kafka_ts"))


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, failed = F.col("event_id"), F.col("event_type") == "error"
    errors = ["SQL guard blocked", "Trino query failed: X", "Groq rate limit", "Persistence failed: X", "metadata missing", "boom", None]
    text = F.get(F.array(*[F.lit(e).cast("string") for e in errors]), (n % 7).cast("int"))
    return table(spark, sf_dir, "events").select(
        n.alias("run_id"), "user_id", F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("created_at"),
        F.round(F.col("value") * 100).cast("bigint").alias("latency_ms"), F.when(failed, "failed").otherwise("success").alias("status"),
        (n % 4).cast("bigint").alias("retry_count"), F.when(failed, text).alias("error"),
    )


def favourites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_id % 11 = 0").select("user_id", F.col("event_id").alias("run_id"))


def pipeline_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    dags = F.array(*[F.lit(x) for x in ("bronze", "silver", "gold", "catalog")])
    return table(spark, sf_dir, "events").select(
        n.alias("run_id"), F.get(dags, (n % 4).cast("int")).alias("dag_id"), ts.alias("start_ts"),
        F.timestamp_seconds(F.unix_timestamp(ts) + F.floor("value")).alias("end_ts"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("state"),
    )


def request_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of a request counter of eight instances, one at each request; an instance restarts every day, and
    again before each request whose id is divisible by 41, so its counter begins again."""
    n, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 8).cast("string").alias("instance"), ts.alias("at"), n)
    day = Window.partitionBy("instance", F.to_date("at")).orderBy("at", "event_id")
    life = rows.withColumn("life", F.sum(F.when(n % 41 == 0, 1).otherwise(0)).over(day))
    value = F.row_number().over(Window.partitionBy("instance", F.to_date("at"), "life").orderBy("at", "event_id"))
    return life.select("instance", "at", value.cast("double").alias("value"))


SQL_TEXTS = [
    "SELECT brand FROM t WHERE brand = 'Samsung';", "WITH a AS (SELECT 1) SELECT * FROM a", "select brand from t limit 5", "DROP TABLE t",
    "SELECT 1; SELECT 2", "SELECT 'a drop' AS x", "-- c\nSELECT 1", "",
]


def sql_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of eight kinds, with a literal, a comment and blanks that follow from the event."""
    texts = F.array(*[F.lit(t) for t in SQL_TEXTS])
    text = F.get(texts, (F.col("event_id") % 8).cast("int"))
    word = F.when(F.col("event_id") % 3 == 0, F.initcap("event_type")).otherwise(F.col("event_type"))
    tail = F.when(F.col("event_id") % 5 == 1, F.concat(F.lit(" WHERE event_type = '"), word, F.lit("'"))).when(F.col("event_id") % 5 == 2, F.concat(F.lit(" /* limit "), "event_type", F.lit(" */"))).when(F.col("event_id") % 5 == 3, " LIMIT 10 ;  ").otherwise("")
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("  "), text, tail).alias("sql_text"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that name the event's brand and a misspelt one (one letter dropped)."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.lower("p_brand").alias("b"))
    rows = table(spark, sf_dir, "events").select("event_id", k.alias("k")).join(part, "k")
    typo = F.concat(F.expr("substring(b, 1, cast(event_id % 3 as int) + 1)"), F.expr("substring(b, cast(event_id % 3 as int) + 3)"))
    return rows.select("event_id", F.col("b").alias("brand"), typo.alias("typo"), F.concat(F.lit("Top "), "b", F.lit(" của "), typo, F.lit(" tháng 1")).alias("question"))
