"""Near copies among texts: n-gram Jaccard join by a MinHash LSH forest with exact verification.

Shingles are runs of five words (ASCII lower case, words are runs without ASCII white
space); a text of one to four words is one shingle. Two texts are linked when the Jaccard
similarity of their shingle sets is 0.8 or more. Another threshold moves every bound; one
that the forest cannot serve with the target probability is an error.

Equal texts are folded first. Every text gets ``TREES * DEPTH`` min-hashes of one byte, a
tree of the forest being a run of ``DEPTH`` of them; texts under one node share a prefix of
it. One length of prefixes is computed from the threshold, before any text is read: the longest
at which a pair at the threshold meets in some tree with at least the target probability. No
sorted trie is walked; texts meet by grouping. Whole runs and shortened prefixes give tight clusters: each text is tied to
the first text under its node where a sketch of 256 bits leaves the threshold possible; the sketch bound is over five standard deviations wide. Clusters only organise
the work. Candidates are then all pairs inside a cluster and all pairs of clusters that
meet under a shortened prefix and whose sketches leave a link possible.

Every candidate pair is verified on its exact shingle sets, in units of two chunks of texts
by products of shingle matrices. A unit returns the number of links of each text and a
spanning forest, never the pairs, so a group of near copies costs rows in proportion to its
members and no task sees more than two chunks of it. Nothing is capped.

Texts without words (null, empty, white space) link with nothing. Rows of equal id and text
are one document. Of a class the document with the smallest id stays, null ids last, the
smaller digest of the text where ids are equal. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.llm.common import components, forest, small_batches, text_bytes
from emberlake.session import cut_lineage

WORDS = 5
THRESHOLD = 0.8
TREES, DEPTH = 32, 8
HASHES = TREES * DEPTH
TARGET_RECALL = 0.9999
#: Deviations above the mean of differing sketch bits up to which two texts may be links.
DEVIATIONS = 5.3
#: Texts in a chunk: small while a cluster has few chunks, never more than the larger bound on average.
SMALL_CHUNK, LARGE_CHUNK = 32, 128


#: Candidate texts whose digests (32 bytes and an id each) are broadcast to fetch the texts.
BROADCAST_ROWS = 500_000


def depth_for(threshold: float = THRESHOLD, recall: float = TARGET_RECALL) -> int:
    """Longest prefix at which a pair at the threshold shares one in some tree with the target probability.

    A threshold that no prefix serves is an error.
    """
    if not 0 < threshold <= 1 or 1 - (1 - threshold) ** TREES < recall:
        raise ValueError(f"threshold {threshold}: {TREES} trees do not reach a recall of {recall}")
    depth = DEPTH
    while depth > 1 and 1 - (1 - threshold**depth) ** TREES < recall:
        depth -= 1
    return depth


def possible_bits(threshold: float = THRESHOLD) -> int:
    """Differing bits of 256 up to which two texts may be links: similarity 0.8 differs in 25.6 bits with a deviation of 4.8, so up to 51."""
    p = (1 - threshold) / 2
    return int(HASHES * p + DEVIATIONS * (HASHES * p * (1 - p)) ** 0.5)


def words(text: bytes) -> list[bytes]:
    return text.lower().split()


@cache
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20240229)
    return random.integers(0, 2**31, HASHES, np.uint32) * np.uint32(2) + np.uint32(1), random.integers(0, 2**32, HASHES, np.uint32)


@cache
def _bytes() -> tuple[np.ndarray, np.ndarray]:
    """Value of each byte in lower case, and which bytes are part of words."""
    value = np.frombuffer(bytes(range(256)).lower(), np.uint8).astype(np.uint64) + np.uint64(1)
    solid = np.ones(256, bool)
    solid[[9, 10, 11, 12, 13, 32]] = False
    return value, solid


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as many as the longest text needs."""

    BASE = 0x5851F42D4C957F2D

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << n.bit_length()
            steps = [np.full(size, x % 2**64, np.uint64) for x in (self.BASE, pow(self.BASE, -1, 2**64))]
            for x in steps:
                x[0] = 1
            self.up, self.down = (np.cumprod(x, dtype=np.uint64) for x in steps)
        return self.up[:n], self.down[:n]


def word_hashes(raw: bytes, powers: Powers) -> np.ndarray:
    """64-bit hash of every word, from differences of one running sum over the bytes."""
    value, solid = _bytes()
    x = np.frombuffer(raw, np.uint8)
    edge = np.flatnonzero(np.diff(solid[x].astype(np.int8), prepend=0, append=0))
    start, end = edge[::2], edge[1::2]
    up, down = powers.upto(len(x) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value[x] * up[:-1], dtype=np.uint64)])
    out = (total[end] - total[start]) * down[start]
    return (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def shingle_hashes(hashes: np.ndarray) -> np.ndarray:
    """32-bit hash of every shingle from the hashes of the words."""
    n = max(1, len(hashes) - WORDS + 1)
    code = np.full(n, len(hashes) if len(hashes) < WORDS else WORDS, np.uint64)
    for j in range(min(WORDS, len(hashes))):
        code = (code ^ hashes[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(31)
    return (code >> np.uint64(32)).astype(np.uint32)


def signature(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One long per tree (its run of byte min-hashes, first byte highest) and a sketch of four longs."""
    a, b = _permutations()
    low = np.full(HASHES, 2**32 - 1, np.uint32)
    for i in range(0, len(shingles), 256):
        value = np.multiply.outer(shingles[i : i + 256], a)
        value += b
        np.minimum(low, value.min(0), out=low)
    low ^= low >> np.uint32(15)
    low *= np.uint32(0x2C1B3C6D)
    low ^= low >> np.uint32(12)
    tries = (low & np.uint32(255)).astype(np.uint8).view(">u8").astype(np.uint64).view(np.int64)
    bits = np.packbits((low >> np.uint32(20) & np.uint32(1)).astype(np.uint8)).view(">u8").astype(np.uint64).view(np.int64)
    return tries, bits


def _signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, n, tries, bits); ``n`` is the number of distinct shingle hashes, 0 without words."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = Powers()
        for frame in frames:
            rows = []
            for raw in frame["raw"]:
                found = word_hashes(bytes(raw), powers)
                if not len(found):
                    rows.append((0, None, None))
                    continue
                shingles = np.unique(shingle_hashes(found))
                rows.append((len(shingles), *signature(shingles)))
            n, tries, bits = zip(*rows)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "digest": frame["digest"], "n": n, "tries": tries, "bits": bits})

    return docs.mapInPandas(run, f"doc_id {kind}, digest binary, n int, tries array<long>, bits array<long>")


def _bits(prefix: str) -> list[str]:
    return [f"{prefix}{i}" for i in range(4)]


def _differing(a: str, b: str) -> Column:
    """Bits that differ between two sketches."""
    return sum((F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(_bits(a), _bits(b))), F.lit(0))


def _ties(shared: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(u, v): texts much like the first text under one of their trie nodes."""
    whole = shared.groupBy("tree", "run").agg(F.min("node").alias("first")).join(shared.select("tree", "run", "node"), ["tree", "run"])
    stars = shared.select("node", "lead").union(whole.select("node", F.col("first").alias("lead"))).filter("node <> lead").distinct()
    sketch = nodes.select("node", *_bits("b"))
    lead = sketch.toDF("lead", *_bits("c"))
    met = stars.join(sketch, "node").join(lead, "lead")
    return met.filter(_differing("b", "c") <= possible_bits(threshold)).select(F.col("node").alias("u"), F.col("lead").alias("v"))


def _cluster_pairs(shared: DataFrame, nodes: DataFrame, clusters: DataFrame, threshold: float) -> DataFrame:
    """(a, b) with a < b: clusters that meet under a prefix and may hold a link there.

    Of the members under one trie node only the bits that all of them share and their
    smallest and largest sizes count, so a large cluster is one row of a node.
    """
    owned = shared.select("tree", "prefix", "node").join(clusters, "node", "left").withColumn("cluster", F.coalesce("cluster", "node"))
    mixed = owned.groupBy("tree", "prefix").agg(F.min("cluster").alias("x"), F.max("cluster").alias("y")).filter("x < y")
    some = owned.join(mixed.select("tree", "prefix"), ["tree", "prefix"]).join(nodes.select("node", "n", *_bits("b")), "node")
    sides = cut_lineage(
        some.groupBy("tree", "prefix", "cluster").agg(
            F.min("n").alias("low"), F.max("n").alias("high"),
            *[F.bit_and(c).alias(f"all{i}") for i, c in enumerate(_bits("b"))], *[F.bit_or(c).alias(f"any{i}") for i, c in enumerate(_bits("b"))],
        ),
        "trie-sides",
    )
    a, b = sides.alias("a"), sides.alias("b")
    apart, least = F.lit(0), threshold * (1 - 1e-9)  # a product just above a whole number drops no pair at the threshold
    for i in range(4):
        one = F.col(f"a.all{i}").bitwiseAND(F.bitwise_not(F.col(f"b.any{i}")))
        two = F.col(f"b.all{i}").bitwiseAND(F.bitwise_not(F.col(f"a.any{i}")))
        apart = apart + F.bit_count(one.bitwiseOR(two))
    possible = (
        (F.col("a.tree") == F.col("b.tree")) & (F.col("a.prefix") == F.col("b.prefix")) & (F.col("a.cluster") < F.col("b.cluster")) & (apart <= possible_bits(threshold))
        & (F.col("a.high") >= least * F.col("b.low")) & (F.col("b.high") >= least * F.col("a.low"))
    )
    return a.join(b, possible).select(F.col("a.cluster").alias("a"), F.col("b.cluster").alias("b")).distinct()


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Exact shingle sets as sorted numbers that are equal for equal shingles across ``texts``."""
    number: dict[bytes, int] = {}
    ids = [np.array([number.setdefault(w, len(number)) for w in words(t)], np.int64) + 1 for t in texts]
    base = len(number) + 1
    spans = []
    for x in ids:
        n = max(1, len(x) - WORDS + 1)
        grams = np.zeros((n, WORDS), np.int64)  # 0 fills up short texts
        for j in range(min(WORDS, len(x))):
            grams[:, j] = x[j : j + n]
        spans.append(grams if len(x) else grams[:0])
    every = np.concatenate(spans)
    code = every[:, 0]
    for j in range(1, WORDS):
        if code.max(initial=0) >= (2**62) // base:
            code = np.unique(code, return_inverse=True)[1].astype(np.int64)
        code = code * base + every[:, j]
    ends = np.cumsum([len(s) for s in spans])[:-1]
    return [np.unique(part) for part in np.split(code, ends)]


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of two lists."""
    if len(left) * len(right) <= 4:
        return np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in right] for a in left], np.int64).reshape(len(left), len(right))
    common = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)))
    for lo in range(0, len(common), 4096):
        part = common[lo : lo + 4096]
        sides = []
        for sets in (left, right):
            m = np.zeros((len(sets), len(part)), np.float32)
            for i, s in enumerate(sets):
                inside = s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], "right")]
                at = np.searchsorted(part, inside)
                m[i, at[part[at] == inside]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return np.rint(out).astype(np.int64)


def verify(texts: list[bytes], left: np.ndarray, right: np.ndarray, copies: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each text, weighted by copies, and a spanning forest's labels.

    ``left`` and ``right`` are positions; equal arrays compare a chunk with itself.
    """
    sets = shingle_sets(texts)
    size = np.array([len(s) for s in sets])
    same = np.array_equal(left, right)
    shared = overlaps([sets[i] for i in left], [sets[i] for i in right])
    union = size[left][:, None] + size[right] - shared
    hit = (shared > 0) & (shared / np.maximum(union, 1) >= threshold)
    if same:
        hit = np.triu(hit, 1)
    i, j = np.nonzero(hit)
    links = np.zeros(len(texts), np.int64)
    np.add.at(links, left[i], copies[right[j]])
    np.add.at(links, right[j], copies[left[i]])
    return links, forest(left[i], right[j], len(texts))


def _chunked(rows: DataFrame, key: str) -> DataFrame:
    """Rows with the size ``m`` of their group, its number of ``chunks`` and their own ``chunk``."""
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("m"))
    sizes = sizes.withColumn("chunks", F.ceil(F.col("m") / F.least(F.lit(LARGE_CHUNK), F.greatest(F.lit(SMALL_CHUNK), F.col("m") / 32))).cast("int"))
    return rows.join(sizes, key).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))


def _verified(members: DataFrame, pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(node, links, root) from all pairs inside clusters and between paired clusters.

    ``members``: (cluster, node, copies). A unit is two chunks of the same or of two clusters.
    """
    rows = _chunked(members, "cluster")
    every = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("x")
    inside = rows.filter("m > 1").select("node", "copies", "cluster", "chunk", every).select(
        "node", "copies", F.col("cluster").alias("a"), F.lit(False).alias("crossed"), F.least("chunk", "x").alias("i"), F.greatest("chunk", "x").alias("j"),
        (F.col("chunk") > F.col("x")).alias("side"),
    )
    # Of two paired clusters the larger is the host; all texts paired with a host are its guests
    # and share chunks, so a large cluster isn't repeated for every small one beside it.
    size = rows.select("cluster", "m", "chunks").distinct()
    both = pairs.join(size.select(F.col("cluster").alias("a"), F.col("m").alias("ma")), "a").join(size.select(F.col("cluster").alias("b"), F.col("m").alias("mb")), "b")
    turned = F.col("mb") > F.col("ma")
    hosts = both.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("host"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("cluster"))
    guests = _chunked(hosts.join(members, "cluster").select("host", "node", "copies"), "host")
    tables = guests.select("host", F.col("chunks").alias("tables")).distinct()
    first = rows.join(tables, F.col("cluster") == F.col("host")).select(
        "node", "copies", F.col("host").alias("a"), F.lit(True).alias("crossed"), F.col("chunk").alias("i"), F.explode(F.sequence(F.lit(0), F.col("tables") - 1)).alias("j"), F.lit(False).alias("side")
    )
    second = guests.join(size.select(F.col("cluster").alias("host"), F.col("chunks").alias("places")), "host").select(
        "node", "copies", F.col("host").alias("a"), F.lit(True).alias("crossed"), F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("i"), F.col("chunk").alias("j"), F.lit(True).alias("side")
    )
    units = inside.unionByName(first).unionByName(second).join(texts, "node")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        side = frame["side"].to_numpy(bool)
        everything = np.arange(len(frame))
        one = not frame["crossed"].iat[0] and frame["i"].iat[0] == frame["j"].iat[0]
        left, right = (everything, everything) if one else (everything[~side], everything[side])
        node, copies = frame["node"].to_numpy(np.int64), frame["copies"].to_numpy(np.int64)
        if not len(left) or not len(right):
            return pd.DataFrame({"node": node[:0], "links": copies[:0], "root": node[:0]})
        links, label = verify([bytes(t) for t in frame["raw"]], left, right, copies, threshold)
        at = np.flatnonzero(links)
        return pd.DataFrame({"node": node[at], "links": links[at], "root": node[label[at]]})

    return units.groupBy("a", "crossed", "i", "j").applyInPandas(run, "node long, links long, root long")


def classes(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, n_links, class_id, kept) of every document; ``digest`` is the SHA-256 of its text.

    ``n_links`` counts all other documents linked directly, ``class_id`` is the smallest id
    reachable by links.
    """
    small_batches(docs.sparkSession)
    raw = docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("raw")).withColumn("digest", F.unhex(F.sha2("raw", 256)))
    signed = cut_lineage(_signatures(raw), "signatures")
    rows = signed.select("doc_id", "digest", "n").distinct()
    ids = rows.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    sketches = signed.filter("n > 0").groupBy("digest").agg(F.first("n").alias("n"), F.first("tries").alias("tries"), F.first("bits").alias("bits"))
    nodes = cut_lineage(
        sketches.join(ids, "digest").withColumn("node", F.monotonically_increasing_id())
        .select("node", "digest", "first_id", "copies", "n", "tries", *[F.col("bits")[i].alias(c) for i, c in enumerate(_bits("b"))]),
        "texts",
    )
    depth = depth_for(threshold)
    runs = nodes.select("node", F.posexplode("tries").alias("tree", "run")).withColumn("prefix", F.shiftrightunsigned("run", 8 * (DEPTH - depth)))
    runs = runs.withColumn("tree", F.col("tree").cast("byte"))
    meeting = runs.groupBy("tree", "prefix").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m")
    shared = cut_lineage(runs.join(meeting, ["tree", "prefix"]), "trie-nodes")
    clusters = cut_lineage(components(_ties(shared, nodes, threshold)).toDF("node", "cluster"), "clusters")
    pairs = cut_lineage(_cluster_pairs(shared, nodes, clusters, threshold), "cluster-pairs")

    lone = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct().join(clusters, "node", "left_anti")
    members = clusters.union(lone.select("node", F.col("node").alias("cluster")))
    members = cut_lineage(members.join(nodes.select("node", "copies", "digest", "first_id"), "node"), "members")
    wanted = members.select("node", "digest", "first_id")
    if wanted.count() <= BROADCAST_ROWS:  # else texts are shuffled by digest
        wanted = F.broadcast(wanted)
    found = raw.join(wanted, (raw["digest"] == wanted["digest"]) & raw["doc_id"].eqNullSafe(wanted["first_id"]))
    texts = cut_lineage(found.select("node", "raw").dropDuplicates(["node"]), "member-texts")
    links = cut_lineage(_verified(members.select("cluster", "node", "copies"), pairs, texts, threshold), "links")

    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(links.select(F.col("node").alias("u"), F.col("root").alias("v")))
    labelled = nodes.select("node", "digest", "first_id", "copies").join(counted, "node", "left").join(roots, "node", "left").select(
        "digest", "first_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")
    )
    best = labelled.groupBy("component").agg(F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "digest")).alias("best"))
    labelled = labelled.join(best, "component").select("digest", "n_links", "best")
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("first_id"), "digest")
    # Texts without words keep to themselves; nulls on the other side of the join say so.
    return rows.join(labelled, "digest", "left").select(
        "doc_id", "digest", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.first_id")).alias("class_id"), (F.col("best").isNull() | (own == F.col("best"))).alias("kept"),
    )


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one document of each class.

    Repeated rows (equal id and text) are one document; one of them stays.
    """
    found = cut_lineage(classes(docs, threshold, id_col, text_col).filter("kept").select("doc_id", "digest"), "kept")
    keys = [F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text_bytes(text_col), 256)).alias("digest")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *keys)
    kept = rows.alias("r").join(found.alias("k"), F.col("r.digest").eqNullSafe(F.col("k.digest")) & F.col("r.doc_id").eqNullSafe(F.col("k.doc_id")), "left_semi")
    repeated = docs.select(*keys).groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    if repeated.limit(1).count():
        kept = kept.dropDuplicates(["doc_id", "digest"])
    return kept.select("doc.*")


def op1_ngram_join(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_links", "class_id", "kept")


SQL = """
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) < 5 THEN [list_aggregate(w, 'string_agg', ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i + 4], 'string_agg', ' ')) END) AS s
  FROM worded WHERE len(w) > 0),
shingles AS (SELECT doc_id, unnest(s) AS g FROM sets),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (
  SELECT a, b FROM met JOIN sets sa ON sa.doc_id = a JOIN sets sb ON sb.doc_id = b WHERE n_both / (len(sa.s) + len(sb.s) - n_both) >= 0.8),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a),
grouped AS (SELECT doc_id, min(other) AS class_id FROM reach GROUP BY doc_id),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_links, class_id, doc_id = class_id AS kept FROM grouped LEFT JOIN counted ON a = doc_id
"""

QUERIES = {"op1_ngram_join": op1_ngram_join}
ORACLE = {"op1_ngram_join": SQL}
