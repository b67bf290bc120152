"""Mixing sources to target weights by temperature.

A source with share p of all tokens gets the weight p**a / sum(p**a). An exponent of 1 keeps
the natural shares, 0 makes all sources equal. The exponent is the flattest one that meets
the target: either a least entropy is reached from above, or no source is repeated more
often than allowed. It is found by bisection over aggregates of the per-source table.

Weights become documents by budgets: a source's epochs are its weight times the token budget
over its own tokens. Whole epochs take every document; the last, partial block takes the
beginning of a permutation of the source's documents up to the token budget that is left.
The permutation orders documents by a keyed hash of id and text. Where the budget of a source ends
is found by counting tokens per interval of hash values, twice, so no task sorts a whole
source; only documents of one narrow interval are ordered one by one.

By default the budget is the smallest that gives every source at least one epoch, so no
document is lost; with a smaller budget large sources are sampled, which is then asked for.

Tokens are runs of non-white-space. Null and empty texts have none and cost nothing; a
source without tokens is taken once. A null source is a source of its own. Repeated rows are
counted together and share one decision. An empty table gives an empty result. Other columns
are not read. Only DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.session import cut_lineage

PRIME = 2147483647
#: Intervals of hash values per step, steps: 2048 * 2048 intervals of 512 hash values.
FIRST, SECOND = 1 << 20, 1 << 9
BISECTIONS = 60
WORDS = r"[^\x20\x09-\x0D]+"


def permutation_key(id_col: str, text_len: Column, seed: int) -> Column:
    """Pseudo-random number below ``PRIME`` from id and length; equal keys are ordered by id."""
    x = (F.coalesce(F.col(id_col), F.lit(0)) % PRIME + PRIME) % PRIME
    t = (x * 48271 + text_len * 7919 + (seed * 104729 + 12345) % PRIME) % PRIME
    return (t * t % PRIME * 69621 + t) % PRIME


def _entropy(shares: DataFrame, a: float) -> float:
    """Entropy of the weights p**a as a share of the highest possible one."""
    r = shares.agg(F.sum(F.pow("p", F.lit(a))).alias("z"), F.sum(F.pow("p", F.lit(a)) * F.log("p") * a).alias("e"), F.count(F.lit(1)).alias("n")).first()
    return 1.0 if r["n"] < 2 else (math.log(r["z"]) - r["e"] / r["z"]) / math.log(r["n"])


def exponent(shares: DataFrame, max_epochs: float | None, target_entropy: float | None) -> float:
    """Exponent by bisection; ``shares`` has one row per source with tokens and its share ``p``.

    With ``max_epochs`` the smallest exponent at which the smallest source has at most that
    many epochs when the largest has one; with ``target_entropy`` the largest exponent with
    at least this share of the highest entropy. Both fall with the exponent.
    """
    ends = shares.agg(F.min("p").alias("low"), F.max("p").alias("high")).first()
    if ends["low"] is None or ends["low"] == ends["high"]:
        return 1.0

    def too_flat(a: float) -> bool:
        if target_entropy is not None:
            return _entropy(shares, a) >= target_entropy
        return (ends["high"] / ends["low"]) ** (1 - a) > max_epochs

    low, high = 0.0, 1.0
    if too_flat(high) or not too_flat(low):
        return high if too_flat(high) else low
    for _ in range(BISECTIONS):
        mid = (low + high) / 2
        low, high = (mid, high) if too_flat(mid) else (low, mid)
    return low if target_entropy is not None else high


def _facts(source_col: str, text_col: str, id_col: str, seed: int) -> list[Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("null")).alias("_group"),
        permutation_key(id_col, F.octet_length(text), seed).alias("_key"), F.col(id_col).alias("_id"), F.octet_length(text).alias("_bytes"),
    ]


def plan(docs: DataFrame, max_epochs: float | None = 2.0, target_entropy: float | None = None, budget: int | None = None, seed: int = 0,
         id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per source: its weight, epochs, whole epochs and where the partial block ends."""
    if (max_epochs is None) == (target_entropy is None):
        raise ValueError("give either max_epochs or target_entropy")
    words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORDS)).cast("long").alias("tokens")
    rows = cut_lineage(docs.select(*_facts(source_col, text_col, id_col, seed), words), "mix-rows")
    total = rows.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    sources = cut_lineage(rows.groupBy("_group").agg(F.sum("tokens").alias("all")).withColumn("p", F.col("all") / F.lit(max(1, total))), "mix-sources")
    shares = sources.filter("p > 0")
    a = exponent(shares, max_epochs, target_entropy)
    z, top = shares.agg(F.coalesce(F.sum(F.pow("p", F.lit(a))), F.lit(1.0)), F.coalesce(F.max("p"), F.lit(1.0))).first()
    weight = F.when(F.col("p") > 0, F.pow("p", F.lit(a)) / z).otherwise(0.0)
    # Without a budget the largest share gets one epoch and all others get at least that.
    epochs = F.pow(F.lit(top) / F.col("p"), F.lit(1 - a)) if budget is None else F.col("weight") * float(budget) / F.col("all")
    plans = sources.withColumn("weight", weight).withColumn("epochs", F.when(F.col("p") > 0, F.round(epochs, 9)).otherwise(1.0))
    plans = plans.withColumn("full", F.floor("epochs")).withColumn("rest", (F.col("epochs") - F.col("full")) * F.col("all"))
    return cut_lineage(_cuts(rows, plans), "mix-plan")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, **target) -> DataFrame:
    """(doc, weight, epochs, copies): every row of ``docs`` as a struct and how often it is taken.

    The decision needs a row's own columns and its source's plan only: texts don't move.
    ``target`` goes to ``plan``.
    """
    plans = plan(docs, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col, **target)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *_facts(source_col, text_col, id_col, seed))
    at = F.struct("_key", "_id", "_bytes")
    partial = F.when(F.col("cut").isNotNull() & (at <= F.col("cut")), 1).otherwise(0)
    return rows.join(plans, "_group").select(
        "doc", F.round("weight", 9).alias("weight"), F.round("epochs", 6).alias("epochs"), (F.col("full") + partial).cast("int").alias("copies")
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as it is taken."""
    taken = mix(docs, **options).filter("copies > 0")
    return taken.select("doc", F.explode(F.sequence(F.lit(1), "copies"))).select("doc.*")


def _cuts(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """``plans`` with ``cut``, the last (key, id, bytes) of the partial block of each source; null without a block."""
    ordered = Window.partitionBy("_group").orderBy("i")

    def boundary(counted: DataFrame, name: str) -> DataFrame:
        """First interval in which the running tokens of a source pass what is left of its budget, and that rest at its start."""
        run = F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
        over = counted.withColumn("_run", run).filter("_run > rest").withColumn("_nth", F.row_number().over(ordered)).filter("_nth = 1")
        return over.select("_group", F.col("i").alias(name), (F.col("rest") - F.col("_run") + F.col("n")).alias("rest"))

    coarse = rows.groupBy("_group", F.expr(f"_key div {FIRST}").alias("i")).agg(F.sum("tokens").alias("n"))
    one = boundary(coarse.join(plans.filter("rest > 0").select("_group", "rest"), "_group"), "_one")
    inside = rows.join(one, "_group").filter(F.expr(f"_key div {FIRST}") == F.col("_one"))
    fine = inside.groupBy("_group", "rest", F.expr(f"_key div {SECOND}").alias("i")).agg(F.sum("tokens").alias("n"))
    two = cut_lineage(boundary(fine, "_two"), "mix-intervals")
    last = rows.join(two, "_group").filter(F.expr(f"_key div {SECOND}") == F.col("_two"))
    # Equal rows add up first, so repeated rows are one entry of the interval.
    few = last.groupBy("_group", "rest", F.struct("_key", "_id", "_bytes").alias("i")).agg(F.sum("tokens").alias("n"))
    within = few.withColumn("_run", F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, 0))).filter("_run <= rest")
    within = within.groupBy("_group").agg(F.max("i").alias("within"))

    def edge(key: Column) -> Column:
        """Just before every row with this key."""
        return F.struct(key.cast("long").alias("_key"), F.lit(None).cast(rows.schema["_id"].dataType).alias("_id"), F.lit(None).cast("int").alias("_bytes"))

    found = two.join(within, "_group", "left").select("_group", F.coalesce("within", edge(F.col("_two") * SECOND)).alias("found"))
    cut = F.when(F.col("rest") > 0, F.coalesce("found", edge(F.lit(PRIME))))
    return plans.join(found, "_group", "left").select("_group", "weight", "epochs", "full", cut.alias("cut"))


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), max_epochs=2.0)
    return out.select("doc.doc_id", "doc.source", "weight", "epochs", "copies")


SQL = """
WITH facts AS (
  SELECT doc_id, source, coalesce('s' || source, 'null') AS g, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens,
    octet_length(encode(coalesce(text, ''))) AS bytes
  FROM documents),
keyed AS (
  SELECT *, (t * t % 2147483647 * 69621 + t) % 2147483647 AS k
  FROM (SELECT *, ((coalesce(doc_id, 0) % 2147483647 + 2147483647) % 2147483647 * 48271 + bytes * 7919 + 12345) % 2147483647 AS t FROM facts)),
sources AS (SELECT g, sum(tokens)::BIGINT AS n, sum(tokens) / (SELECT sum(tokens) FROM facts) AS p FROM facts GROUP BY g),
target AS (SELECT max(p) AS top, CASE WHEN max(p) = min(p) THEN 1 ELSE greatest(0, 1 - ln(2) / ln(max(p) / min(p))) END AS a FROM sources WHERE p > 0),
plans AS (
  SELECT g, n, CASE WHEN p > 0 THEN pow(p, a) / (SELECT sum(pow(p, a)) FROM sources, target WHERE p > 0) ELSE 0 END AS weight,
    CASE WHEN p > 0 THEN round(pow(top / p, 1 - a), 9) ELSE 1 END AS epochs
  FROM sources, target),
ordered AS (
  SELECT keyed.*, weight, epochs, floor(epochs) AS full_epochs, (epochs - floor(epochs)) * n AS rest,
    sum(tokens) OVER (PARTITION BY g ORDER BY k, doc_id NULLS FIRST, bytes RANGE UNBOUNDED PRECEDING) AS run
  FROM keyed JOIN plans USING (g))
SELECT doc_id, source, round(weight, 9) AS weight, round(epochs, 6) AS epochs,
  (full_epochs + CASE WHEN rest > 0 AND run <= rest THEN 1 ELSE 0 END)::INTEGER AS copies
FROM ordered
"""

QUERIES = {"op10_mixing": op10_mixing}
ORACLE = {"op10_mixing": SQL}
