"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation.

Tokens are words in ASCII lower case and one end per text. Counts of all training tokens
come first. The most frequent words and the end are the model's units, all other words
share one unit; inside it a word has its smoothed share of the unit's tokens, so every
token of every text, seen or not, has a normalised probability:

    p(word | context) = p(unit | context) * (1 if the unit is a word of its own
                        else (count + 1) / (rare tokens + distinct rare words + 1))

The log-bilinear model predicts a unit's vector from the two units before it (a text starts
after ends): the context vectors, scaled per position and dimension, are added and multiplied
with the target vectors, plus a bias. It is trained in numpy on the counts of all
training trigrams of units: each partition counts its trigrams and goes through all of its
contexts in each round with gradient steps of the noise-contrastive objective against unigram
noise, a context's steps weighing its count; parameters are averaged over partitions by their
token counts, over ``ROUNDS`` rounds. No training text and no trigram is left out.

Scoring multiplies matrices in batches: context by target scores per position are two small
tables, and the normaliser of each distinct context is one log-sum-exp over all units.

Words outside the dictionary of ``HEAD`` frequent words get their counts through a join, so
no table that grows with the corpus is broadcast.

Null and empty texts are one end token. Rows with a null id hash like an empty id. Repeated
rows are scored (and counted) each. With no training rows every token is unknown: the base
is uniform over one token and the model uniform over its units. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.llm.common import crc_of_id, small_batches, text_bytes
from emberlake.session import cut_lineage

#: Gradient steps of a partition's round are those that its contexts take, ``STEPS`` at least.
#: Units of the model with the end (0) and the unit of all rare words (1), its dimensions.
UNITS, DIM = 512, 32
#: Most words in the dictionary every task holds, and the longest of them in bytes: 20 MB at most.
HEAD, HEAD_BYTES = 1 << 18, 64
ROUNDS, STEPS, BATCH, NOISE, RATE = 2, 300, 1024, 64, 0.02
#: Words counted in a task before they are passed on.
COUNTED = 1_000_000
END, RARE = 0, 1


def tokens(raw: bytes) -> list[bytes]:
    return raw.lower().split()


class Head(NamedTuple):
    """Frequent words with their counts, most frequent first, and totals of the training tokens."""

    ids: dict[bytes, int]
    counts: np.ndarray
    ends: int
    total: int
    distinct: int

    @property
    def units(self) -> int:
        return min(UNITS, len(self.ids) + 2)

    def rare(self) -> tuple[int, int]:
        """Tokens and distinct words that are no unit of their own."""
        own = self.counts[: self.units - 2]
        return self.total - self.ends - int(own.sum()), self.distinct - (self.ends > 0) - len(own)


def count_words(raw: DataFrame) -> DataFrame:
    """(word, n) over all texts; the end is not a word."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for frame in frames:
            for text in frame["raw"]:
                held.update(tokens(bytes(text)))
            if len(held) >= COUNTED:
                yield pd.DataFrame({"word": list(held.keys()), "n": list(held.values())})
                held = Counter()
        yield pd.DataFrame({"word": list(held.keys()), "n": list(held.values())})

    return raw.mapInPandas(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head_of(counts: DataFrame, texts: int) -> Head:
    """The bounded dictionary and the totals; only these reach the driver."""
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    # A histogram over powers of two in sixteenths tells from which count on the words fit.
    short = counts.filter(F.octet_length("word") <= HEAD_BYTES).withColumn("step", F.floor(F.log2("n") * 16).cast("int"))
    least, fit = None, 0
    for r in sorted(short.groupBy("step").agg(F.count(F.lit(1)).alias("v")).collect(), reverse=True):
        fit += r["v"]
        if fit > HEAD:
            break
        least = r["step"]
    top = short.filter(F.col("step") >= (least if least is not None else 1 << 20)).select("word", "n").toPandas()
    top = top.assign(word=[bytes(w) for w in top["word"]]).sort_values(["n", "word"], ascending=[False, True])
    words = top["word"].tolist()
    return Head({w: i for i, w in enumerate(words)}, top["n"].to_numpy(np.int64), texts, int(sums["n"]) + texts, int(sums["v"]) + (texts > 0))


class Model(NamedTuple):
    context: np.ndarray  # units x DIM
    target: np.ndarray  # units x DIM
    scale: np.ndarray  # positions x DIM
    bias: np.ndarray  # units

    @staticmethod
    def start(share: np.ndarray) -> Model:
        random = np.random.default_rng(7)
        n = len(share)
        return Model(random.normal(0, 0.1, (n, DIM)), random.normal(0, 0.1, (n, DIM)), np.ones((2, DIM)), np.log(share))

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Score of every unit after every unit one and two positions before it."""
        return tuple((self.context * self.scale[k]) @ self.target.T for k in (0, 1))


def train(model: Model, share: np.ndarray, trigrams: np.ndarray, weight: np.ndarray, rate: float, seed: int, steps: int | None = None) -> Model:
    """Steps of noise-contrastive estimation over distinct trigrams (one before, two before, unit) and their counts.

    ``trigrams`` are sorted by context. Steps go through a random order of all contexts, see
    ``turns``, so there are as many as it takes, ``steps`` (``STEPS``) at least. A step takes for
    each context the observed units against ``NOISE`` noise units per observation; both are
    expectations over all units, so only the order of contexts is random. Steps follow Adam.
    """
    random = np.random.default_rng(seed)
    n = len(share)
    key = trigrams[:, 0] * n + trigrams[:, 1]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    length = np.diff(np.append(start, len(key)))
    mass = np.add.reduceat(weight, start)
    turn, load = turns(mass, (steps or STEPS) * BATCH, random)
    last = -(-len(turn) // BATCH)
    one, two = trigrams[start, 0], trigrams[start, 1]
    part = (weight / np.repeat(mass, length)).astype(np.float32)
    params = [x.astype(np.float32).copy() for x in model]
    first, second = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    noise = (NOISE * share).astype(np.float32)
    for step in range(1, last + 1):
        r, q, c, b = params
        drawn = turn[(step - 1) * BATCH : step * BATCH]
        at, times = np.unique(drawn, return_counts=True)
        rows = np.repeat(np.arange(len(at)), length[at])
        flat = np.arange(length[at].sum()) - np.repeat(np.cumsum(length[at]) - length[at], length[at]) + np.repeat(start[at], length[at])
        times = (times * load[at]).astype(np.float32)[:, None]
        seen = np.zeros((len(at), n), np.float32)
        seen[rows, trigrams[flat, 2]] = part[flat]
        r1, r2 = r[one[at]], r[two[at]]
        guess = r1 * c[0] + r2 * c[1]
        real = 1 / (1 + noise * np.exp(-np.clip(guess @ q.T + b, -60, 60)))  # posterior of being observed
        up = (seen * (1 - real) - noise * real) * (times / BATCH)
        d_guess = up @ q
        d_r = _sums(one[at], d_guess * c[0], n) + _sums(two[at], d_guess * c[1], n)
        d_c = np.stack([(d_guess * r1).sum(0), (d_guess * r2).sum(0)])
        now = rate * min(1, 4 * (1 - step / (last + 1)))
        for x, m, v, d in zip(params, first, second, (d_r, up.T @ guess, d_c, up.sum(0))):
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            x += now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-5)
    return Model(*params)


def turns(mass: np.ndarray, least: int, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Contexts in random order, ``least`` turns at least, and the weight of one turn of each, 1 on average.

    Every context has one turn at least and turns in proportion to its count at most rounded up;
    its turns weigh its count together, so a whole pass has the gradient of all trigrams.
    """
    often = np.ceil(mass * (max(least, len(mass)) / mass.sum())).astype(np.int64).clip(1)
    turn = random.permutation(np.repeat(np.arange(len(mass), dtype=np.int32), often))
    return turn, mass / often * (len(turn) / mass.sum())


def _sums(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum of ``rows`` by index."""
    order = np.argsort(index, kind="stable")
    ordered = index[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    out[ordered[starts]] = np.add.reduceat(rows[order], starts, axis=0)
    return out


def unit_ids(found: list[bytes], head: Head) -> np.ndarray:
    """Position of each word in the dictionary, its length for words outside, as an array."""
    get, none = head.ids.get, len(head.ids)
    return np.fromiter((get(w, none) for w in found), np.int64, len(found))


def contexts(ids: np.ndarray, head: Head) -> np.ndarray:
    """(one before, two before, unit) of every token of a text, its end included."""
    units = np.where(ids < head.units - 2, ids + 2, RARE)
    row = np.concatenate([[END, END], units, [END]])
    return np.stack([row[1:-1], row[:-2], row[2:]], axis=1)


def unit_share(head: Head) -> np.ndarray:
    """Smoothed share of each unit, for noise and first biases."""
    rare, _ = head.rare()
    n = np.concatenate([[head.ends, rare], head.counts[: head.units - 2]]) + 1.0
    return n / n.sum()


def fit(raw: DataFrame, head: Head) -> Model:
    """Rounds of training in all partitions and averaging; only the model's parameters are gathered."""
    share = unit_share(head)
    model = Model.start(share)
    n = head.units
    context = raw.sparkSession.sparkContext
    shared = context.broadcast(head)  # bounded by HEAD words of HEAD_BYTES bytes
    for k in range(ROUNDS):
        start, rate = model, RATE / (k + 1)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = np.zeros(0, np.int64)
            counts = np.zeros(0, np.int64)
            for frame in frames:
                parts = [contexts(unit_ids(tokens(bytes(t)), shared.value), shared.value) for t in frame["raw"]]
                if parts:
                    x = np.concatenate(parts)
                    held, counts = _merge(held, counts, (x[:, 0] * n + x[:, 1]) * n + x[:, 2])
            if not len(held):
                return
            trigrams = np.stack([held // (n * n), held // n % n, held % n], axis=1)
            end = train(start, share, trigrams, counts.astype(np.float64), rate, k)
            weight = float(counts.sum())
            flat = np.concatenate([x.ravel() for x in end])
            yield pd.DataFrame({"i": np.arange(len(flat)), "x": flat * weight, "w": weight})

        sums = raw.mapInPandas(run, "i int, x double, w double").groupBy("i").agg((F.sum("x") / F.sum("w")).alias("x")).toPandas()
        if not len(sums):
            return model
        flat = sums.sort_values("i")["x"].to_numpy()
        cuts = np.cumsum([x.size for x in model])[:-1]
        model = Model(*(part.reshape(x.shape) for part, x in zip(np.split(flat, cuts), model)))
    return model


def _merge(held: np.ndarray, counts: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.unique(new, return_counts=True)
    every, inverse = np.unique(np.concatenate([held, keys]), return_inverse=True)
    return every, np.bincount(inverse, np.concatenate([counts, n])).astype(np.int64)


class Scorer:
    """Log10 probabilities of units in context; normalisers are computed once per distinct context."""

    def __init__(self, model: Model, head: Head):
        self.head, self.n = head, head.units
        self.first, self.second = (t.astype(np.float32) for t in model.tables())
        self.bias = model.bias.astype(np.float32)
        self.norm = np.full(self.n * self.n, np.nan, np.float32)

    def normalisers(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        at = one * self.n + two
        new = np.unique(at[np.isnan(self.norm[at])])
        for lo in range(0, len(new), 2048):
            part = new[lo : lo + 2048]
            z = self.first[part // self.n] + self.second[part % self.n] + self.bias
            top = z.max(1)
            self.norm[part] = top + np.log(np.exp(z - top[:, None]).sum(1))
        return self.norm[at]

    def logs(self, x: np.ndarray) -> np.ndarray:
        one, two, unit = x.T
        z = self.first[one, unit] + self.second[two, unit] + self.bias[unit]
        return (z - self.normalisers(one, two)).astype(np.float64) / math.log(10)


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Rows where ``held_out`` holds are scored only; all others are also learned from.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("raw"), held_out.alias("held_out"))
    training = rows.filter(~F.col("held_out"))
    counts = cut_lineage(count_words(training.select("raw")), "word-counts")
    head = head_of(counts, training.count())
    model = fit(training.select("raw"), head)
    shared = docs.sparkSession.sparkContext.broadcast((head, model))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, model = shared.value
        scorer, none = Scorer(model, head), len(head.ids)
        rare_tokens, rare_words = head.rare()
        base_all, rare_all = math.log10(head.total + head.distinct + 1), math.log10(rare_tokens + rare_words + 1)
        log_counts = np.append(np.log10(head.counts + 1), 0.0)  # the last: words outside, added by the join
        for frame in frames:
            out = []
            for raw in frame["raw"]:
                found = tokens(bytes(raw))
                ids = unit_ids(found, head)
                x = contexts(ids, head)
                inside = ids < none
                outside = [found[i] for i in np.flatnonzero(~inside)]
                n = len(found) + 1
                known = int(inside.sum()) + (head.ends > 0)
                base = log_counts[ids].sum() + math.log10(head.ends + 1) - n * base_all
                rare = ids >= head.units - 2
                own = scorer.logs(x).sum() + log_counts[ids[rare]].sum() - int(rare.sum()) * rare_all
                few = Counter(outside)
                out.append((n, known, float(base), float(own), list(few.keys()), list(few.values())))
            n, known, base, own, words, times = zip(*out) if out else [()] * 6
            yield pd.DataFrame({"doc_id": frame["doc_id"], "held_out": frame["held_out"], "n_tokens": n, "known": known, "base": base, "own": own, "words": words, "times": times})

    scored = rows.mapInPandas(
        run, f"doc_id {kind}, held_out boolean, n_tokens long, known long, base double, own double, words array<binary>, times array<long>"
    )
    scored = cut_lineage(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    # Words outside the dictionary are each at most one in HEAD of all tokens: no key here is hot.
    outside = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    seen = outside.join(counts, "word").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("logs"))
    return scored.drop("words", "times").join(seen, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(head.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("logs", F.lit(0.0))).alias("base_score"), (F.col("own") + F.coalesce("logs", F.lit(0.0))).alias("score"),
    )


def op7_lm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, F.pmod(crc_of_id("doc_id"), F.lit(7)) == 2)


QUERIES = {"op7_lm": op7_lm}
