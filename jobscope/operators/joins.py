"""Join size, pre-filtered joins and missing join indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_volume(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows ``left JOIN right`` gives per key, without producing them.

    The joined rows of a key are its left rows times its right rows, so both sides are
    counted first and only the counts are joined.
    """
    return join_report(left, right, key).select(key, "joined_rows")


def join_report(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``join_volume`` with the rows of each side and the growth of the left side."""
    lefts = left.groupBy(key).agg(F.count(F.lit(1)).alias("left_rows"))
    rights = right.groupBy(key).agg(F.count(F.lit(1)).alias("right_rows"))
    return lefts.join(rights, key).select(
        key,
        "left_rows",
        "right_rows",
        (F.col("left_rows") * F.col("right_rows")).alias("joined_rows"),
    )


def prefilter(fact: DataFrame, dim: DataFrame, key: str, wanted: Column) -> DataFrame:
    """Fact rows whose key exists among the wanted dimension rows."""
    return fact.join(dim.where(wanted).select(key), key, "left_semi")


def prefilter_join(fact: DataFrame, dim: DataFrame, key: str, wanted: Column) -> DataFrame:
    """Join with the dimension filtered first.

    No strategy is forced: Spark broadcasts the filtered side only below its size threshold,
    and otherwise AQE splits partitions of a hot fact key.
    """
    return fact.join(dim.where(wanted), key)


# Bits of a Bloom filter per key and bits a key sets; one word holds all bits of a key.
BITS_PER_KEY = 16
_BITS_SET = 4
# The most words of a filter: 2^21 rows of 16 bytes are broadcast, enough for 8 million keys.
MOST_WORDS = 1 << 21


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(words)).cast("int")


def _bits(key: Column) -> Column:
    """The bits a key sets in its word: four places from a second hash, six bits each."""
    places = F.xxhash64(key, F.lit("bits"))
    mask = F.lit(0).cast("bigint")
    for i in range(_BITS_SET):
        at = F.shiftrightunsigned(places, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), at))
    return mask


def bloom_words(keys: DataFrame, key: str, words: int) -> DataFrame:
    """A Bloom filter of the keys as a table: one row per word that is not empty.

    Equal words are combined where keys are read: one aggregate, no key is moved.
    """
    return keys.groupBy(_word(F.col(key), words).alias("_word")).agg(F.bit_or(_bits(F.col(key))).alias("_set"))


def bloom_join(
    fact: DataFrame, dim: DataFrame, key: str, wanted: Column, broadcast_keys: int = 100_000, most_words: int = MOST_WORDS
) -> DataFrame:
    """``prefilter_join`` for dimensions that are too large to broadcast.

    The wanted keys are counted first.  Up to ``broadcast_keys`` of them, the join is left to
    Spark.  Beyond that a Bloom filter of the keys, 16 bits for each, goes to the tasks that read
    the facts: about one in a hundred facts without a partner passes it and the rest never reach
    the shuffle; the exact join follows, so the rows are those of the plain join.  A filter is
    at most ``most_words`` rows; for more keys than it can hold, the plain join does.
    """
    chosen = dim.where(wanted)
    n = chosen.agg(F.count(F.col(key))).first()[0]
    words = -(-n * BITS_PER_KEY // 64)
    if n <= broadcast_keys or words > most_words:
        return fact.join(chosen, key)
    taken = [*fact.columns, "_word", "_set"]
    at, word, held = (name + "_" * max(map(len, taken)) for name in ("_at", "_word", "_set"))  # no column is called so
    sieve = bloom_words(chosen.where(F.col(key).isNotNull()), key, words)
    sieve = F.broadcast(sieve.select(F.col("_word").alias(word), F.col("_set").alias(held)))
    near = fact.where(F.col(key).isNotNull()).withColumn(at, _word(F.col(key), words)).join(sieve, F.col(at) == F.col(word))
    bits = _bits(F.col(key))
    return near.where(F.col(held).bitwiseAND(bits) == bits).select(*fact.columns).join(chosen, key)


def bloom_split(fact: DataFrame, keys: DataFrame, key: str, most_words: int = MOST_WORDS) -> tuple[DataFrame, DataFrame]:
    """Fact rows whose key may be among ``keys``, and those whose key surely is not.

    For semi and anti joins that follow on the first part: about one in a hundred rows without a
    partner stands there, with those that have one, and the rest is never moved.  Both parts read
    the facts.  ``keys`` is a stored table; for more than ``most_words`` can hold, the first part is all rows.
    """
    words = max(1, -(-keys.count() * BITS_PER_KEY // 64))
    if words > most_words:
        return fact, fact.where(F.lit(False))
    taken = [*fact.columns, "_word", "_set"]
    at, word, held = (name + "_" * max(map(len, taken)) for name in ("_at", "_word", "_set"))  # no column is called so
    sieve = bloom_words(keys.where(F.col(key).isNotNull()), key, words)
    sieve = F.broadcast(sieve.select(F.col("_word").alias(word), F.col("_set").alias(held)))
    marked = fact.withColumn(at, _word(F.col(key), words)).join(sieve, F.col(at) == F.col(word), "left")
    bits = _bits(F.col(key))
    may = F.coalesce(F.col(key).isNotNull() & (F.col(held).bitwiseAND(bits) == bits), F.lit(False))
    columns = [F.col(f"`{c}`") for c in fact.columns]
    return marked.where(may).select(*columns), marked.where(~may).select(*columns)


def leading_column(indexdef: Column) -> Column:
    """First column of ``CREATE INDEX ... (a, b)``."""
    return F.lower(F.regexp_extract(indexdef, r'\(\s*"?([^,\s")]+)', 1))


def missing_indexes(join_keys: DataFrame, indexes: DataFrame) -> DataFrame:
    """Distinct (tablename, column_name) join keys that no index starts with."""
    covered = indexes.select(
        "tablename", leading_column(F.col("indexdef")).alias("column_name")
    ).distinct()
    wanted = join_keys.select("tablename", F.lower("column_name").alias("column_name")).distinct()
    return wanted.join(covered, ["tablename", "column_name"], "left_anti")
