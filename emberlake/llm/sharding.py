"""Sharding by a keyed permutation of global row numbers.

Rows get gapless global numbers in id order. A Feistel network permutes these numbers;
numbers that leave the range walk on along their cycle until they fall inside it, so the
result is a permutation of exactly the rows there are. Position modulo the shard count is
the shard, the quotient the slot: both can be computed from a row number alone, can be
inverted, and depend on nothing but the seed and the number of rows. Counts differ by one
at most.

Only DataFrame functions are used. The network's halves are residues modulo two numbers
whose product just covers the row count, so hardly any number walks; its round function
stays below 2**62 in plain integer arithmetic and inside generated code.

Null ids sort first, null texts have size 8 and the checksum of no bytes, repeated rows
each get a position of their own, an empty table gives an empty result. Other columns are
not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlake.llm.common import text_bytes
from emberlake.session import cut_lineage, drop_cut

PRIME = 2147483647
ROUNDS = 4


def halves(n: int) -> tuple[int, int]:
    """Two moduli whose product is ``n`` or a little more."""
    a = math.isqrt(max(0, n - 1)) + 1
    return a, max(1, -(-n // a))


def round_keys(seed: int) -> list[int]:
    return [(seed * 7919 + 104729 * (i + 1)) % PRIME for i in range(ROUNDS)]


def _shift(df: DataFrame, half: str, other: str, key: int, modulus: int, sign: int) -> DataFrame:
    """Add the round function of one half to the other; every step is used twice, so it gets a column."""
    df = df.withColumn("_t", (F.col(other) % PRIME * 48271 + key) % PRIME)
    df = df.withColumn("_f", (F.col("_t") * F.col("_t") % PRIME * 69621 + F.col("_t")) % PRIME % modulus)
    return df.withColumn(half, (F.col(half) + sign * F.col("_f") + modulus) % modulus)


def network(df: DataFrame, column: str, n: int, seed: int, inverse: bool = False) -> DataFrame:
    """Apply the network, or its inverse, once to the numbers of ``column`` that lie in the covered range."""
    a, b = halves(n)
    df = df.withColumn("_l", F.expr(f"{column} div {b}")).withColumn("_r", F.col(column) % b)
    rounds = list(enumerate(round_keys(seed)))
    for i, key in reversed(rounds) if inverse else rounds:
        half, other, modulus = ("_l", "_r", a) if i % 2 == 0 else ("_r", "_l", b)
        df = _shift(df, half, other, key, modulus, -1 if inverse else 1)
    return df.withColumn("_next", F.col("_l") * b + F.col("_r")).drop("_l", "_r", "_t", "_f")


def permute(df: DataFrame, column: str, n: int, seed: int = 0, inverse: bool = False, label: str = "positions") -> DataFrame:
    """Replace the numbers 0 to n - 1 of ``column`` by their permuted positions, or back.

    Walks until no row is left outside the range: a cycle leaves it at most as often as
    there are numbers outside, so the loop ends for every input.
    """
    df, last = df.withColumn("_walking", F.lit(True)), None
    while True:
        df = network(df, column, n, seed, inverse)
        df = df.withColumn(column, F.when(F.col("_walking"), F.col("_next")).otherwise(F.col(column)))
        df = df.withColumn("_walking", F.col("_walking") & (F.col(column) >= n)).drop("_next")
        before, df = last, cut_lineage(df, label)
        if before is not None:
            drop_cut(before)
        last = df
        if not df.filter("_walking").agg(F.count(F.lit(1))).first()[0]:
            return df.drop("_walking")


def numbered(df: DataFrame, order: list[str], column: str = "row_number") -> tuple[DataFrame, int]:
    """Gapless numbers from 0 in the given order, and how many there are.

    Equal rows are counted before the shuffle and dealt out again afterwards, so a row
    repeated any number of times spreads over the ranges. Each range is sorted and
    numbered by itself; only one count per range is summed up globally.
    """
    rows = (
        df.groupBy(*order).agg(F.count(F.lit(1)).alias("_copies"))
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).drop("_copies")
    )
    keys = [F.col(c).asc_nulls_first() for c in [*order, "_copy"]]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = cut_lineage(
        rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_copy")
        .withColumn("_at", F.monotonically_increasing_id()),
        "numbered",
    )
    ranges = ranges.withColumn("_range", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(2**33 - 1))
    counts = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    n = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    # One row per range of the shuffle goes through this window, whatever the number of rows.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    out = ranges.join(F.broadcast(starts), "_range").withColumn(column, F.col("_at") + F.col("_start"))
    return out.drop("_range", "_at", "_start"), n


def shards(df: DataFrame, shard_count: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """Shard and slot of every row under the law of equal row counts.

    Returns the id as ``doc_id``, size, text_crc32, row_number, position, shard, slot.
    """
    raw = text_bytes(text_col)
    rows = df.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32")
    )
    rows, n = numbered(rows, ["doc_id", "text_crc32", "size"])
    out = permute(rows.withColumn("position", F.col("row_number")), "position", n, seed)
    return out.select(
        "doc_id", "size", "text_crc32", "row_number", "position",
        (F.col("position") % shard_count).cast("int").alias("shard"),
        F.expr(f"position div {shard_count}").cast("long").alias("slot"),
    )


def row_number_at(df: DataFrame, shard_count: int, n: int, seed: int = 0) -> DataFrame:
    """Global row number behind every (shard, slot) of ``df``, without touching the rows themselves."""
    at = df.withColumn("row_number", F.col("slot").cast("long") * shard_count + F.col("shard"))
    return permute(at, "row_number", n, seed, inverse=True, label="row-numbers")


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    out = shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), shard_count=24)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


SQL = """
WITH RECURSIVE texts AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
nibbles AS (
  SELECT doc_id, octet_length(raw) + 8 AS size,
    flatten(list_transform(regexp_extract_all(hex(raw), '..'), lambda h: [strpos('123456789ABCDEF', h[2]), strpos('123456789ABCDEF', h[1])])) AS l
  FROM texts),
table16 AS (SELECT list_transform(range(16), lambda v: list_reduce([v, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
sums AS (
  SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, l), lambda c, v: xor(c >> 4, t[(xor(c, v) & 15) + 1])), 4294967295) AS crc FROM nibbles, table16),
ordered AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, crc, size) - 1 AS x, count(*) OVER () AS n FROM sums),
walk AS (
  SELECT doc_id, crc, size, n, a, b, 0 AS i, x // b AS l, x % b AS r
  FROM (SELECT *, ceil(sqrt(n))::BIGINT AS a, ceil(n / ceil(sqrt(n)))::BIGINT AS b FROM ordered)
  UNION ALL
  SELECT doc_id, crc, size, n, a, b, i + 1,
    CASE WHEN i % 2 = 0 THEN (l + (t * t % 2147483647 * 69621 + t) % 2147483647 % a) % a ELSE l END,
    CASE WHEN i % 2 = 1 THEN (r + (t * t % 2147483647 * 69621 + t) % 2147483647 % b) % b ELSE r END
  FROM (SELECT *, ((CASE WHEN i % 2 = 0 THEN r ELSE l END) * 48271 + 104729 * (i % 4 + 1)) % 2147483647 AS t FROM walk)
  WHERE NOT (i > 0 AND i % 4 = 0 AND l * b + r < n))
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, ((l * b + r) % 24)::INTEGER AS shard, (l * b + r) // 24 AS slot,
  NULL::INTEGER AS grown_shard
FROM walk WHERE i > 0 AND i % 4 = 0 AND l * b + r < n
"""

QUERIES = {"op4_sharding": op4_sharding}
ORACLE = {"op4_sharding": SQL}
