"""Importance resampling towards a target distribution, in Spark SQL.

Each document's n-grams (runs of 1 to ``max_n`` words) are exploded and hashed to ``buckets`` by crc32. A
bucket's gain is the floored thousandfold logarithm of how much likelier it is among the target's
features than among all documents', both smoothed by one a bucket; a document's weight is the floored mean
of its features' gains. Weight plus Gumbel noise, derived from the id alone, orders the documents, and the
highest are drawn, which samples without replacement in proportion to the exponential of the weight.

The table of gains has at most ``buckets`` rows, so it can be sent to all tasks. Everything else is grouped with
partial sums: one row a bucket and one a document leave each task. Ranks are places in ranges of the
order plus the sizes of the ranges before, so no task orders all documents.

Defined results: a null text, or one without words, has no features and weight 0; a null id draws its noise as an
empty one and comes last among equal scores; repeated rows each get a row and a rank of their own; an empty table
gives an empty result, an empty target the same gains as a target without features; other columns aren't read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import Scratch
from tidegrid.llm.ordering import with_positions

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
#: Fixed value: what parts words, once A-Z are in lower case.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text, A-Z in lower case; none for null."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, NO_WORD), "")


def ngrams(found: Column, max_n: int) -> Column:
    """All runs of 1 to ``max_n`` consecutive words, each joined by a space."""

    def runs(n: int) -> Column:
        starts = F.when(F.size(found) >= n, F.sequence(F.lit(1), F.size(found) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(found, i, n), " "))

    return found if max_n == 1 else F.flatten(F.array(found, *[runs(n) for n in range(2, max_n + 1)]))


def bucket_of(feature: Column, buckets: int) -> Column:
    return (F.crc32(feature.cast("binary")) % buckets).cast("int")


def bucket_counts(rows: DataFrame, text_col: str, max_n: int, buckets: int) -> DataFrame:
    """(bucket, n): how many features of all texts fall in each bucket."""
    features = rows.select(F.explode(ngrams(words(F.col(text_col)), max_n)).alias("feature"))
    return features.groupBy(bucket_of(F.col("feature"), buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str, max_n: int, buckets: int) -> DataFrame:
    """(bucket, gain) of each bucket that documents have features in; at most ``buckets`` rows."""
    own = bucket_counts(docs, text_col, max_n, buckets).withColumnRenamed("n", "s")
    aim = bucket_counts(target, text_col, max_n, buckets).withColumnRenamed("n", "t")
    both = own.join(aim, "bucket", "full").select("bucket", F.coalesce("s", F.lit(0)).cast("double").alias("s"), F.coalesce("t", F.lit(0)).cast("double").alias("t"))
    # One list of at most ``buckets`` entries holds the sums too, without a second pass or a join.
    total = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"), F.collect_list(F.struct("bucket", "s", "t")).alias("rows"))
    rows = total.select("all_s", "all_t", F.explode("rows").alias("r")).where(F.col("r.s") > 0)
    odds = (F.col("r.t") + 1.0) * (F.col("all_s") + float(buckets)) / ((F.col("r.s") + 1.0) * (F.col("all_t") + float(buckets)))
    return rows.select("r.bucket", F.floor(F.lit(1000.0) * F.log(odds)).cast("long").alias("gain"))


def floor_div(a: Column, b: Column) -> Column:
    """Whole quotient of two integers, rounded down, for b > 0."""
    return F.call_function("div", a - F.pmod(a, b), b)


def noise(doc_id: Column, seed: int) -> Column:
    """Thousandfold standard Gumbel noise of an id, floored."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_n: int = 1, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_features, weight, score, rank (null where it isn't drawn).

    Of the documents with at least ``min_words`` words, ``percent`` of a hundred are drawn.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        gain = scratch.put(gains(docs, target.select(F.col(text_col)), text_col, max_n, buckets), "resample-gains")
        # A row is known by its id and 128 bits of its text; equal rows are counted, and made rows again below.
        text = F.coalesce(F.col(text_col), F.lit(""))
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.lit(1), text).alias("h1"), F.xxhash64(F.lit(2), text).alias("h2"), words(text).alias("words"))
        features = rows.select("doc_id", "h1", "h2", F.size("words").alias("n_words"), F.posexplode_outer(ngrams(F.col("words"), max_n)).alias("at", "feature"))
        features = features.withColumn("bucket", bucket_of(F.col("feature"), buckets))
        one = F.when(F.coalesce("at", F.lit(0)) == 0, 1)
        scored = features.join(F.broadcast(gain), "bucket", "left").groupBy("doc_id", "h1", "h2").agg(F.max("n_words").alias("n_words"), F.count("feature").alias("n"), F.sum("gain").alias("gain"), F.count(one).alias("copies"))
        n, total = floor_div(F.col("n"), F.col("copies")), floor_div(F.coalesce("gain", F.lit(0)), F.col("copies"))
        scored = scored.select("doc_id", "h1", "h2", (F.col("n_words") >= min_words).alias("may"), n.alias("n_features"), F.when(n > 0, floor_div(total, n)).otherwise(0).alias("weight"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
        scored = scratch.keep(scratch.put(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "resample-scores", gather=False))

        order = [F.col("may").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("h1"), F.col("h2"), F.col("copy")]
        placed = with_positions(scratch, scored, order, "place", "resample-order")
        drawn = floor_div(scored.agg(F.count_if("may").alias("n")).scalar() * percent, F.lit(100))
        rank = F.when(F.col("may") & (F.col("place") < drawn), F.col("place") + 1)
        return placed.select("doc_id", "n_features", "weight", "score", rank.cast("long").alias("rank"))
