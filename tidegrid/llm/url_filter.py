"""URL filter: blocked Bloom filter of listed URLs, then an exact hash join.

Every listed entry is a host and a path prefix in canonical form (``example.com/en/7``). An entry fits a
url whose host is that host or a subdomain of it and whose path starts with that prefix. A url's
candidates are its host suffixes combined with its path prefixes of the lengths that occur in the list;
the filter drops nearly all that are not listed, a hash join with the list drops the rest exactly, and the
longest fitting entry decides (of equally long ones, the one with the longer host, then the smaller text).

Defined results: a null url or one without ``://`` has empty host and path and fits nothing; repeated
rows each get a row; an empty table gives an empty result; the default verdict is ``allow``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import materialize

#: A block is four 64-bit words; each entry sets one bit in each word of its block.
WORDS = 4
BITS_PER_ENTRY = 16
#: Largest filter that is sent to all tasks; a longer list has a denser filter, and the join stays exact.
MAX_FILTER_BYTES = 8_388_608


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url, both empty for null or no ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def canonical(entries: DataFrame, entry_col: str = "entry") -> DataFrame:
    """Listed entries as (entry, entry_host, entry_path, action), without repeats; block wins over allow for one entry."""
    e = entries.where(F.col(entry_col).isNotNull()).withColumn("cut", F.instr(F.col(entry_col), "/"))
    host = F.when(F.col("cut") > 0, F.substring(F.col(entry_col), F.lit(1), F.col("cut") - 1)).otherwise(F.col(entry_col))
    path = F.when(F.col("cut") > 0, F.substring(F.col(entry_col), F.col("cut"), F.length(entry_col))).otherwise(F.lit(""))
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return e.select(F.concat(host, path).alias("entry"), host.alias("entry_host"), path.alias("entry_path"), "action").groupBy("entry", "entry_host", "entry_path").agg(F.max("action").alias("action"))


def _place(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    h = F.xxhash64(key)
    bits = [F.pmod(F.shiftrightunsigned(h, 6 * i), F.lit(64)).cast("int") for i in range(WORDS)]
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(blocks)).cast("int"), bits


def bloom_words(listed: DataFrame, blocks: int) -> DataFrame:
    """One row with the filter's words as an array<bigint> of ``blocks * WORDS``."""
    block, bits = _place(F.col("entry"), blocks)
    set_bits = listed.select(block.alias("block"), *[b.alias(f"b{i}") for i, b in enumerate(bits)])
    words = set_bits.select("block", *[F.expr(f"shiftleft(1L, b{i})").alias(f"w{i}") for i in range(WORDS)]).groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])
    entry = F.map_from_entries(F.collect_list(F.struct("block", F.array(*[f"w{i}" for i in range(WORDS)]))))
    zero = F.array(*[F.expr("0L")] * WORDS)
    return words.agg(entry.alias("m")).select(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: F.coalesce(F.try_element_at("m", i), zero))).alias("words"))


def url_filter(pages: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judge each row's url by ``entries`` (entry, action): page_id, host, path, rule, verdict."""
    spark = pages.sparkSession
    listed = materialize(canonical(entries), "url-list")
    facts = listed.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.length("entry_path")).alias("lengths")).first()
    host, path = host_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    if not facts["n"]:
        return rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    blocks = max(1, min(facts["n"] * BITS_PER_ENTRY // (64 * WORDS) + 1, MAX_FILTER_BYTES // (8 * WORDS)))
    bloom = materialize(bloom_words(listed, blocks), "url-bloom")

    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, sorted(facts["lengths"]))), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    candidates = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    words = bloom.select("words").scalar()

    def possible(key: Column) -> Column:
        block, bits = _place(key, blocks)
        test = F.lit(True)
        for i, b in enumerate(bits):
            word = F.element_at(words, block * WORDS + F.lit(i + 1))
            test = test & (F.call_function("getbit", word, b) == 1)
        return test

    # One row for each distinct host and path: a hot url is counted once before the join.
    urls = rows.where(F.col("host") != "").select("host", "path").distinct()
    hits = urls.select("host", "path", F.explode(candidates).alias("entry")).where(possible(F.col("entry")))
    order = F.struct(F.length("entry"), F.length("entry_host"), F.col("entry"))
    judged = hits.join(listed, "entry").groupBy("host", "path").agg(F.max(order).alias("o"), F.max_by(F.struct("entry", "action"), order).alias("r"))
    judged = materialize(judged.select("host", "path", F.col("r.entry").alias("rule"), F.col("r.action").alias("verdict")), "url-judged")
    return rows.join(judged, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
