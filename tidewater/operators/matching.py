"""Matching misspelt names with a dictionary of values."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions import columns as fn

MAX_DISTANCE = 2


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio; only for pairs that the distance has left."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def near_pairs(candidates: DataFrame, values: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Pairs (candidate, value) at edit distance up to ``max_distance``.

    A distance of d leaves one of d + 1 equal cuts of the candidate whole, moved by at most d places,
    so pairs meet on a cut's text, its number and the value's length; no pair is lost and lengths
    alone never make a group.
    """
    d = max_distance
    left = candidates.select("candidate", fn.fold_words(F.col("candidate")).alias("__c")).where("__c <> ''")
    right = values.select("value", fn.fold_words(F.col("value")).alias("__v")).where("__v <> ''")
    n = F.length("__c")
    pieces = F.array(*[F.struct(F.lit(k).alias("k"), F.floor(n * k / (d + 1)).cast("int").alias("at"), (F.floor(n * (k + 1) / (d + 1)) - F.floor(n * k / (d + 1))).cast("int").alias("len")) for k in range(d + 1)])
    left = left.withColumn("p", F.explode(pieces)).withColumn("piece", F.expr("substring(__c, p.at + 1, p.len)")).withColumn("vlen", F.explode(F.sequence(F.greatest(n - d, F.lit(1)), n + d)))
    left = left.select("candidate", "__c", F.length("__c").alias("clen"), F.col("p.k").alias("k"), "piece", "vlen")
    # each value offers, for every candidate length within d and each cut, its text at the shifted places
    m = F.length("__v")
    right = right.withColumn("clen", F.explode(F.sequence(F.greatest(m - d, F.lit(1)), m + d)))
    total = F.col("clen")

    def shifted(k: int) -> Column:
        at, size = F.floor(total * k / (d + 1)), F.floor(total * (k + 1) / (d + 1)) - F.floor(total * k / (d + 1))
        moves = F.sequence(F.lit(-d), F.lit(d))
        return F.transform(moves, lambda s: F.struct(F.lit(k).alias("k"), (at + s).cast("int").alias("at"), size.cast("int").alias("len")))

    cuts = F.flatten(F.array(*[shifted(k) for k in range(d + 1)]))
    right = right.withColumn("p", F.explode(F.filter(cuts, lambda x: (x["at"] >= 0) & (x["at"] + x["len"] <= m))))
    right = right.select("value", "__v", "clen", F.col("p.k").alias("k"), F.expr("substring(__v, p.at + 1, p.len)").alias("piece"), m.alias("vlen")).distinct()
    pairs = left.join(right, ["clen", "vlen", "k", "piece"]).select("candidate", "value", "__c", "__v").distinct()
    return pairs.withColumn("distance", F.levenshtein("__c", "__v")).where(F.col("distance") <= d)


def matches(candidates: DataFrame, values: DataFrame) -> DataFrame:
    """Pairs that count as a match, with score and type."""
    near = near_pairs(candidates, values).withColumn("ratio", similarity("__c", "__v"))
    score = F.greatest("ratio", 1 - F.col("distance") / F.greatest(F.length("__c"), F.length("__v")))
    kind = (
        F.when(F.col("__c") == F.col("__v"), "exact")
        .when((F.length("__c") >= 4) & (F.col("ratio") >= 0.82), "fuzzy")
        .when((F.length("__c") >= 5) & (score >= 0.78), "fuzzy")
    )
    return near.select("candidate", "value", "distance", F.round(score, 4).alias("score"), kind.alias("match_type")).where("match_type IS NOT NULL")


def best_matches(candidates: DataFrame, values: DataFrame) -> DataFrame:
    """One value per candidate: highest score, then least distance, then the smaller value."""
    order = F.struct(-F.col("score"), F.col("distance"), F.col("value"))
    return matches(candidates, values).groupBy("candidate").agg(F.min_by(F.struct("value", "score", "distance", "match_type"), order).alias("m")).select("candidate", "m.*")
