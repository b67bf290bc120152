"""Language identification by string kernels.

Two texts are compared by the character n-grams that occur in both: for every length from 1
to ``LONGEST`` the number of shared n-grams over the geometric mean of the two counts, and
the mean of these (a blended spectrum kernel on presence). N-grams are taken from the whole
text in lower case; every run of characters that aren't letters counts as one space.
They are numbered by a hash, separately per length.

Landmark texts turn the kernel into features (Nystroem): similarity to the landmarks times
the inverse square root of the landmarks' own kernel matrix. One ridge regression per
language against all others is solved on these features. A batch of texts is scored by two
matrix products: presence by landmarks, then landmarks by languages.

The classifier is fitted on a sample of labelled rows, chosen by a hash of the text: at
most ``PER_LANGUAGE`` texts of each language and about ``SAMPLE`` in all, but ``LEAST`` of each
language where it has them. Every language is learned: each has a landmark and a regression,
so the model grows with the number of languages. Everything else covers all rows.

A text that is null or has no letter is ``und`` with score 0, as is every text when there
is nothing to learn from. The score is the best regression value, kept in 0 to 1; targets
are 1 for a language's own texts and 0 for others, so a text unlike all landmarks gets 0.
Equal scores go to the language that sorts first. Repeated rows are scored each. Other
columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from emberlake.llm.common import crc_of_id, small_batches

LONGEST = 4
#: Hash buckets of n-grams of each length.
BUCKETS = 1 << 15
PER_LANGUAGE, LEAST, SAMPLE = 384, 16, 6144
LANDMARKS = 256
RIDGE = 1e-3
#: Texts scored by one product.
BATCH = 32


@cache
def letters() -> np.ndarray:
    """Lower-case code point of every letter, 0 for all others."""
    out = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if unicodedata.category(c)[0] == "L":
            low = c.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
    return out


def grams(text: str) -> list[np.ndarray] | None:
    """Distinct hashed n-grams of each length; None without a letter."""
    x = letters()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    solid = x != 0
    if not solid.any():
        return None
    keep = solid.copy()
    keep[1:] |= solid[:-1]
    x = np.concatenate([[0], x[keep], [0]]).astype(np.uint64)
    if x[-2] == 0:
        x = x[:-1]
    out, code = [], np.zeros(len(x), np.uint64)
    for n in range(1, LONGEST + 1):
        code = code[: len(x) - n + 1] * np.uint64(0x100000001B3) + x[n - 1 :] + np.uint64(n)
        mixed = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        flags = np.zeros(BUCKETS, bool)
        flags[(mixed >> np.uint64(64 - 15)).astype(np.int64)] = True
        out.append(np.flatnonzero(flags))
        if len(x) == n:
            break
    return out


def presence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the kernel's feature space and which texts have letters; products of rows are kernel values."""
    out = np.zeros((len(texts), LONGEST * BUCKETS), np.float32)
    some = np.zeros(len(texts), bool)
    for i, text in enumerate(texts):
        found = grams(text)
        if found:
            some[i] = True
            for n, g in enumerate(found):
                out[i, n * BUCKETS + g] = 1 / np.sqrt(len(g) * LONGEST)
    return out, some


class Model(NamedTuple):
    languages: list[str]
    columns: np.ndarray  # n-grams that landmarks have
    landmarks: np.ndarray  # n-grams x landmarks
    weights: np.ndarray  # landmarks x languages

    def values(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        x, some = presence(texts)
        return x[:, self.columns] @ self.landmarks @ self.weights, some


def fit(texts: list[str], langs: list[str]) -> Model | None:
    """Kernel ridge regression on Nystroem features; the first texts of each language are the landmarks."""
    kept = [(t, y) for t, y in zip(texts, langs) if grams(t)]
    names = sorted({y for _, y in kept})
    if not names:
        return None
    texts, langs = [t for t, _ in kept], np.array([names.index(y) for _, y in kept])
    chosen = np.concatenate([np.flatnonzero(langs == k)[: max(1, LANDMARKS // len(names))] for k in range(len(names))])
    marks = np.concatenate([presence([texts[i]])[0] for i in chosen])
    columns = np.flatnonzero(marks.any(0))
    marks = marks[:, columns].T.copy()
    near = np.concatenate([presence(texts[i : i + BATCH])[0][:, columns] @ marks for i in range(0, len(texts), BATCH)]).astype(np.float64)
    own = (marks.T @ marks).astype(np.float64)
    value, vector = np.linalg.eigh(own)
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    features = near @ root
    # Every language weighs the same in every regression, however many texts it has.
    share = 1 / np.bincount(langs, minlength=len(names))[langs]
    target = (langs[:, None] == np.arange(len(names))).astype(np.float64)
    gram = (features * share[:, None]).T @ features + RIDGE * np.eye(features.shape[1])
    weights = root @ np.linalg.solve(gram, (features * share[:, None]).T @ target)
    return Model(names, columns, marks, weights.astype(np.float32))


def learn(docs: DataFrame, use: Column, text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Fit on a sample of the labelled texts of every language where ``use`` holds; text and label alone decide what is taken."""
    rows = docs.filter(use & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.pmod(F.xxhash64(F.col(text_col)), F.lit(1 << 40)).alias("at")
    )
    # Texts are told apart by their hash, so a text that is repeated very often counts once.
    counts = rows.select("lang", "at").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    if not counts:
        return None
    each = min(PER_LANGUAGE, max(LEAST, SAMPLE // len(counts)))
    # One more pass: only rows below their language's hash bound go on, about twice as many texts as are kept.
    bounds = [(r["lang"], (1 << 40) if r["n"] <= 4 * each else int((1 << 40) * 2 * each / r["n"])) for r in counts]
    bounds = docs.sparkSession.createDataFrame(bounds, StructType([rows.schema["lang"], StructField("bound", LongType())]))
    near = rows.join(F.broadcast(bounds), "lang").filter("at < bound").groupBy("lang", "at").agg(F.min("text").alias("text"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("at"))
    sample = near.withColumn("nth", nth).filter(F.col("nth") <= each).orderBy("lang", "nth").select("text", "lang").collect()
    return fit([r["text"] for r in sample], [r["lang"] for r in sample])


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most LONGEST * BUCKETS numbers for each of LANDMARKS texts, or of as many as there are languages
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            langs, scores = predictions([t or "" for t in frame["text"]], shared.value)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "lang_pred": langs, "score": scores})

    return rows.mapInPandas(run, f"doc_id {kind}, lang_pred string, score double")


def predictions(texts: list[str], model: Model | None) -> tuple[list[str], list[float]]:
    langs, scores = [], []
    for i in range(0, len(texts), BATCH):
        part = texts[i : i + BATCH]
        if model is None:
            langs += ["und"] * len(part)
            scores += [0.0] * len(part)
            continue
        value, some = model.values(part)
        best = value.argmax(1)
        top = np.clip(value[np.arange(len(part)), best].astype(np.float64), 0, 1)
        langs += [model.languages[b] if s else "und" for b, s in zip(best, some)]
        scores += np.where(some, top, 0.0).tolist()
    return langs, scores


#: Below this score no language claims a text.
REJECTED = 0.1


def accepted(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", least: float = REJECTED) -> DataFrame:
    """The rows of ``docs`` whose text is in one of the learned languages.

    Texts without a letter and texts that resemble no language go; a declared language is
    not held against a text. Without a model nothing is rejected but texts without letters.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)

    @F.pandas_udf("boolean")
    def kept(texts: pd.Series) -> pd.Series:
        whole = [t or "" for t in texts]
        if shared.value is None:
            return pd.Series([bool(grams(t)) for t in whole])
        langs, scores = predictions(whole, shared.value)
        return pd.Series([y != "und" and s >= least for y, s in zip(langs, scores)])

    return docs.filter(kept(F.col(text_col)))


def op2_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.pmod(crc_of_id("doc_id"), F.lit(5)) == 0
    out = identify(docs, learn(docs, ~held_out))
    return out.select("doc_id", (F.pmod(crc_of_id("doc_id"), F.lit(5)) == 0).alias("held_out"), "lang_pred", "score")


QUERIES = {"op2_language": op2_language}
