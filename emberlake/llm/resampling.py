"""Importance resampling of documents towards a target distribution.

Features are runs of consecutive words, hashed into a fixed number of buckets. One pass
over the documents and one over the target texts count the buckets; a bucket's gain is the
logarithm of its smoothed frequency in the target over that in the documents. A second
pass adds up the gains of every document from an array and adds noise taken from a hash of
the id, so that the highest scores are a sample without replacement by weight.

The cutoff is found by weighted median-of-medians selection. Partitions report the median
of the keys that remain to them and how many there are; the median of these medians,
weighted by the sizes, is a pivot that at least a quarter of all keys lies on either side
of, so every round discards a guaranteed fraction. A round reports medians of both sides
of its pivot, so one job finds the side and the next pivot. Keys end with a row number and
are distinct: the cutoff is exact whatever the ties. Only the winners are sorted, by
ranges, and numbered from the counts of the ranges.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A to Z. Null and empty
texts have no features and weight 0; a null id counts as an empty one in the hash and as
the smallest in ties; repeated rows are drawn as rows of their own; an empty table gives an
empty result, an empty target smoothed gains. Texts are read in slices that end between
words, so a very long text needs no more memory than its own bytes. Other columns are not
read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.llm.common import small_batches, text_bytes
from emberlake.session import cut_lineage, drop_cut

WORD, GAP = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")
#: Bytes of a text taken at once, and features whose bucket a task remembers.
SLICE, REMEMBERED, REMEMBERED_BYTES = 1 << 20, 1 << 18, 64
#: Keys that give one median, and keys few enough to be sorted by the driver at the end.
CHUNK, FINISH = 1 << 20, 4096
KEY = ["_low", "_id", "n_features", "_row"]


class Buckets(dict):
    """Bucket of a feature, remembered up to a fixed number of features."""

    def __init__(self, count: int):
        self.count = count

    def __missing__(self, feature: bytes) -> int:
        found = zlib.crc32(feature) % self.count
        if len(feature) <= REMEMBERED_BYTES:
            if len(self) >= REMEMBERED:
                self.clear()
            self[feature] = found
        return found


def slices(data: bytes) -> Iterator[bytes]:
    start = 0
    while start < len(data):
        cut = GAP.search(data, min(start + SLICE, len(data)))
        end = cut.start() if cut else len(data)
        yield data[start:end]
        start = end


def features(raw: bytes, longest: int, buckets: Buckets) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the runs that end in them) for every slice of a text."""
    held: list[bytes] = []
    for part in slices(raw.lower()):
        fresh = WORD.findall(part)
        found = [buckets[w] for w in fresh]
        for length in range(2, longest + 1):
            words = held[len(held) - (length - 1) :] + fresh if len(held) >= length - 1 else held + fresh
            found += [buckets[b" ".join(run)] for run in zip(*(words[i:] for i in range(length)))]
        held = (held + fresh)[-(longest - 1) :] if longest > 1 else []
        yield len(fresh), np.array(found, np.int64)


def bucket_counts(df: DataFrame, text_col: str, longest: int, count: int) -> np.ndarray:
    """Occurrences of every bucket in all texts; the driver receives one number a bucket."""

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buckets, total = Buckets(count), np.zeros(count, np.int64)
        for frame in frames:
            for raw in frame["raw"]:
                for _, found in features(raw, longest, buckets):
                    total += np.bincount(found, minlength=count)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    sums = df.select(text_bytes(text_col).alias("raw")).mapInPandas(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(count, np.int64)
    for row in sums.toLocalIterator():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the natural logarithm of smoothed target frequency over source frequency, rounded down."""
    count = len(source)
    s_all, t_all = float(source.sum() + count), float(target.sum() + count)
    return np.array([math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(id_col: str, seed: int) -> Column:
    """Gumbel noise in thousandths from the hash of ``seed:id``."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weighed(df: DataFrame, gain: np.ndarray, longest: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, and the parts of the key) of every row."""
    whole = dict(df.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint")
    kind = "long" if whole else "string"
    smallest = F.lit(-(2**63)) if whole else F.lit("")

    def weigh(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buckets = Buckets(len(gain))
        for frame in frames:
            out = np.zeros((len(frame), 3), np.int64)
            for i, raw in enumerate(frame["raw"]):
                for words, found in features(raw, longest, buckets):
                    out[i] += words, len(found), gain[found].sum()
            yield pd.DataFrame({"_id": frame["_id"], "_void": frame["_void"], "n_words": out[:, 0], "n_features": out[:, 1], "weight": out[:, 2]})

    ids = df.select(
        F.coalesce(F.col(id_col).cast(kind), smallest).alias("_id"), F.col(id_col).isNull().alias("_void"), text_bytes(text_col).alias("raw")
    )
    out = ids.mapInPandas(weigh, f"_id {kind}, _void boolean, n_words long, n_features long, weight long")
    out = out.withColumn("doc_id", F.when(~F.col("_void"), F.col("_id"))).withColumn("score", F.col("weight") + noise("doc_id", seed))
    return out.drop("_void").withColumn("_low", -F.col("score")).withColumn("_row", F.monotonically_increasing_id())


def at_most(frame: pd.DataFrame, key: tuple) -> np.ndarray:
    """Rows whose key is ``key`` or comes before it."""
    out = (frame[KEY[-1]] <= key[-1]).to_numpy()
    for column, value in list(zip(KEY, key))[-2::-1]:
        out = (frame[column] < value).to_numpy() | ((frame[column] == value).to_numpy() & out)
    return out


def _key(key: tuple, kind: str) -> Column:
    return F.struct(*[F.lit(v).cast(kind if c == "_id" else "long").alias(c) for c, v in zip(KEY, key)])


def _medians(keys: DataFrame, pivot: tuple | None, kind: str) -> list:
    """(below the pivot, size, median key) of every chunk of keys on both sides of the pivot."""

    def report(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        low = at_most(part, pivot) if pivot else np.ones(len(part), bool)
        for below in (True, False):
            side = part[low == below]
            if len(side):
                middle = side.sort_values(KEY).iloc[[(len(side) - 1) // 2]]
                yield middle.assign(below=below, size=len(side))[["below", "size", *KEY]]

    def chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for frame in frames:
            held.append(frame)
            size += len(frame)
            if size >= CHUNK:
                yield from report(pd.concat(held))
                held, size = [], 0
        if size:
            yield from report(pd.concat(held))

    return keys.mapInPandas(chunks, f"below boolean, size long, _low long, _id {kind}, n_features long, _row long").collect()


def cutoff(keys: DataFrame, wanted: int, total: int) -> tuple | None:
    """The key of the ``wanted``-th of ``total`` distinct keys.

    The driver receives one row for each chunk of up to ``CHUNK`` remaining keys in each
    round. What remains is written anew when it has shrunk eightfold, so that all rounds
    together read a small multiple of the keys.
    """
    if not 0 < wanted <= total:
        return None
    kind = dict(keys.dtypes)["_id"]
    order = F.struct(*KEY)
    keys, written, stored, low, high = keys.select(*KEY), None, total, None, None
    pivot, left = None, total
    while True:
        rest = keys
        if low:
            rest = rest.filter((F.col("_low") >= low[0]) & (order > _key(low, kind)))
        if high:
            rest = rest.filter((F.col("_low") <= high[0]) & (order <= _key(high, kind)))
        if left <= FINISH:
            last = sorted(tuple(r) for r in rest.collect())[wanted - 1]
            if written is not None:
                drop_cut(written)
            return last
        if left * 8 < stored:
            before, written = written, cut_lineage(rest, "keys")
            if before is not None:
                drop_cut(before)
            keys, rest, stored, low, high = written, written, left, None, None
        found = _medians(rest, pivot, kind)
        if pivot:
            below = sum(r["size"] for r in found if r["below"])
            side = wanted <= below
            low, high = (low, pivot) if side else (pivot, high)
            wanted, left = (wanted, below) if side else (wanted - below, left - below)
            found = [r for r in found if r["below"] == side]
        ordered = sorted((tuple(r[c] for c in KEY), r["size"]) for r in found)
        passed, half = 0, sum(size for _, size in ordered) / 2
        for pivot, size in ordered:
            passed += size
            if passed >= half:
                break


def ranked(winners: DataFrame) -> DataFrame:
    """``winners`` with their rank from 1 in key order: ranges are sorted apart and start where the one before ends."""
    parts = int(winners.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = cut_lineage(
        winners.repartitionByRange(parts, *KEY).sortWithinPartitions(*KEY).withColumn("_at", F.monotonically_increasing_id()), "winners"
    )
    ranges = ranges.withColumn("_range", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(2**33 - 1))
    # One row per range of the shuffle goes through this window, whatever the number of rows.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return ranges.join(F.broadcast(starts), "_range").withColumn("rank", F.col("_start") + F.col("_at") + 1)


def resampled(
    df: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, longest: int = 1, buckets: int = 10000, seed: int = 2024,
    id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row; drawn rows have a rank.

    Draws ``percent`` of a hundred, rounded down, of the documents with ``min_words`` words.
    """
    small_batches(df.sparkSession)
    gain = gains(bucket_counts(df, text_col, longest, buckets), bucket_counts(target, target_text, longest, buckets))
    scored = cut_lineage(weighed(df, gain, longest, seed, id_col, text_col), "scored")
    fit = F.col("n_words") >= min_words
    total = scored.filter(fit).count()
    last = cutoff(scored.filter(fit), percent * total // 100, total)
    out = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    none = F.lit(None).cast("long").alias("rank")
    if last is None:
        return scored.select(*out[:-1], none)
    drawn = fit & (F.struct(*KEY) <= _key(last, dict(scored.dtypes)["_id"]))
    return ranked(scored.filter(drawn)).select(*out).unionByName(scored.filter(~drawn).select(*out[:-1], none))


def op11_resampling(spark, sf_dir: str) -> DataFrame:
    out = resampled(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


SQL = """
WITH words AS (
  SELECT 's' AS side, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM documents
  UNION ALL
  SELECT 't', NULL, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) FROM benchmark),
counted AS (SELECT side, doc_id, w, count(*) AS c FROM words GROUP BY ALL),
table16 AS (SELECT list_transform(range(16), lambda v: list_reduce([v, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
nibbles AS (
  SELECT w, flatten(list_transform(regexp_extract_all(hex(encode(w)), '..'), lambda h: [strpos('123456789ABCDEF', h[2]), strpos('123456789ABCDEF', h[1])])) AS l
  FROM (SELECT DISTINCT w FROM counted)),
buckets AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, l), lambda c, v: xor(c >> 4, t[(xor(c, v) & 15) + 1])), 4294967295) % 10000 AS b FROM nibbles, table16),
freq AS (
  SELECT b, coalesce(sum(c) FILTER (side = 's'), 0)::DOUBLE AS s, coalesce(sum(c) FILTER (side = 't'), 0)::DOUBLE AS t
  FROM counted JOIN buckets USING (w) GROUP BY b),
totals AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM freq),
gain AS (SELECT b, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS g FROM freq, totals),
weights AS (
  SELECT doc_id, sum(c)::BIGINT AS n_features, sum(c * g)::BIGINT AS weight
  FROM counted JOIN buckets USING (w) JOIN gain USING (b) WHERE side = 's' GROUP BY doc_id),
hashed AS (
  SELECT doc_id, list_reduce(list_prepend(0::BIGINT, list_transform(regexp_extract_all(substr(sha256('2024:' || doc_id), 1, 8), '.'),
    lambda x: strpos('123456789abcdef', x)::BIGINT)), lambda a, x: a * 16 + x) AS h FROM documents),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM hashed LEFT JOIN weights USING (doc_id)),
ordered AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN ordered USING (doc_id)
"""

QUERIES = {"op11_resampling": op11_resampling}
ORACLE = {"op11_resampling": SQL}
