"""Substring search by an inverted index of character trigrams, with verification.

The index is three tables: the rows with an id and their text in lower case, the *postings* (trigram, id), one for each
distinct trigram of a row, and how many rows hold each trigram.  Postings lie in partitions by a hash of the trigram, so
a search reads those of its trigrams only, and of these the ``RAREST`` that fewest rows hold.  Rows that hold all of them
are candidates; the text itself decides, so the result equals that of a scan.

A text of fewer than three letters has no trigram: it is looked for by a scan of the texts.  An empty one is in
every row.  Null columns are left out of a row's text; equal rows share an id and stay rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = 64
RAREST = 3


def row_text(names: list[str]) -> Column:
    """The columns as one text in lower case."""
    return F.lower(F.concat_ws(" ", *[F.col(f"`{c}`").cast("string") for c in names]))


def _grams(text: Column) -> Column:
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1)))
    return F.when(F.length(text) > 2, F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def _shard(gram: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(shards)).cast("int")


class TrigramIndex:
    """An index below ``path``; ``write`` makes it, ``search`` reads it."""

    def __init__(self, spark: SparkSession, path: str, shards: int = SHARDS):
        self.spark, self.path, self.shards = spark, path.rstrip("/"), shards

    @classmethod
    def write(cls, df: DataFrame, path: str, names: list[str] | None = None, shards: int = SHARDS) -> TrigramIndex:
        """Indexes the rows of ``df`` by the text of the columns ``names`` (all by default)."""
        made = cls(df.sparkSession, path, shards)
        text = row_text(names if names is not None else df.columns)
        row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
        rows = df.select(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("id"), text.alias("text"), row.alias("row"))
        rows.write.mode("overwrite").parquet(f"{made.path}/rows")
        posted = made.rows().select("id", F.explode(_grams(F.col("text"))).alias("gram")).distinct()
        posted.withColumn("shard", _shard(F.col("gram"), shards)).repartition("shard", "gram").sortWithinPartitions("shard", "gram").write.mode("overwrite").partitionBy("shard").parquet(f"{made.path}/postings")
        made.postings().groupBy("shard", "gram").count().repartition("shard").sortWithinPartitions("gram").write.mode("overwrite").partitionBy("shard").parquet(f"{made.path}/sizes")
        return made

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def postings(self) -> DataFrame:
        return self._sharded("postings", "id long")

    def sizes(self) -> DataFrame:
        return self._sharded("sizes", "count long")

    def _sharded(self, table: str, more: str) -> DataFrame:
        return self.spark.read.schema(f"gram string, {more}, shard int").parquet(f"{self.path}/{table}")

    def _of(self, df: DataFrame, grams: list[str]) -> DataFrame:
        """Rows of some trigrams, as filters on partitions and on the sorted column."""
        made = self.spark.createDataFrame([(g,) for g in grams], "gram string").select("gram", _shard(F.col("gram"), self.shards).alias("s")).collect()
        return df.where(F.col("shard").isin(sorted({r["s"] for r in made})) & F.col("gram").isin(grams))

    def rarest(self, text: str) -> list[str] | None:
        """The trigrams of a text to look up, or None where some trigram is in no row."""
        grams = sorted({text[i : i + 3] for i in range(len(text) - 2)})
        found = {r["gram"]: r["count"] for r in self._of(self.sizes(), grams).collect()}  # one row per trigram of the text
        return None if len(found) < len(grams) else sorted(grams, key=lambda g: (found[g], g))[:RAREST]

    def candidates(self, grams: list[str]) -> DataFrame:
        """Ids of rows that hold all these trigrams; the postings are distinct."""
        return self._of(self.postings(), grams).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams)).select("id")

    def search(self, text: str) -> DataFrame:
        """The rows whose text holds ``text``, without regard to case."""
        q = self.spark.range(1).select(F.lower(F.lit(text))).first()[0]
        held = self.rows().where(F.col("text").contains(q))
        if len(q) > 2:
            grams = self.rarest(q)
            held = held.where("false") if grams is None else held.join(self.candidates(grams), "id", "left_semi")
        return held.select("row.*")
