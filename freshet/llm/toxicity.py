"""Toxicity: a character n-gram linear classifier with naive Bayes log-count ratios (NB-weighted logistic regression).

Method: presence of hashed character n-grams (3 to 6 bytes of lower-cased text, inside a word or touching its ends) is
counted in toxic and clean labelled texts; each n-gram's log-count ratio scales its feature; a logistic regression is
trained on the scaled features. Whole texts are scored, in blocks.

Bounds: labels are learnt from at most about `max_rows` rows (a hash of the id decides, so the choice is the same
everywhere and spreads over all rows), and `max_features` n-grams with the strongest evidence are used. Training is
one task over that bounded sample; everything else is distributed. The model has at most `max_features` weights.

Defined cases: null or empty text scores like a text without any n-gram (the model's base rate); null labels and
labels without a document teach nothing; of several labels of one id the highest counts; without both classes every
score is the share of toxic labels (0 if there are none); input columns that bear a result's name are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from freshet.llm.common import packed, pick, stored, unpacked

SIZES = (3, 4, 5, 6)
BITS = 18
BLOCK = 1 << 20
RESULTS = ("score", "predicted")
MAX_ROWS, MAX_FEATURES = 12_000, 6_000
_CLEAN = bytes(x if x >= 128 or chr(x).isalnum() else 32 for x in range(256))


def ngrams(raw: bytes) -> Iterator[np.ndarray]:
    """Hashed n-grams of a text, repeated ones included, block by block."""
    for at in range(0, len(raw), BLOCK):
        part = b" " * (at == 0) + raw[max(0, at - max(SIZES) + 1):at + BLOCK] + b" " * (at + BLOCK >= len(raw))
        data = np.frombuffer(part.lower().translate(_CLEAN), np.uint8)
        gaps = np.concatenate(([0], np.cumsum(data == 32)))
        code = np.zeros(len(data), np.uint64)
        for n in range(1, max(SIZES) + 1):
            if len(data) < n:
                break
            code = code[:len(data) - n + 1] | (data[n - 1:].astype(np.uint64) << np.uint64(8 * n - 8))
            if n in SIZES:
                whole = gaps[n - 1:-1] == gaps[1:len(gaps) - n + 1]  # no gap but at the ends
                with np.errstate(over="ignore"):
                    yield (code[whole] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64)


def present(raw: bytes, numbers: np.ndarray | None = None) -> np.ndarray:
    """The different n-grams of a text, or the numbers of those among them that have one (others are -1)."""
    parts = []
    for grams in ngrams(raw):
        if numbers is not None:
            grams = numbers[grams]
            grams = grams[grams >= 0]
        parts.append(np.unique(grams))
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.int64)


def ngram_counts(rows: DataFrame) -> DataFrame:
    """(gram, toxic, clean): labelled texts (text, label) that hold each n-gram."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << BITS), np.int64)
        for part in parts:
            for raw, label in zip(part.column(0), part.column(1)):
                seen[label.as_py(), present(raw.as_py() or b"")] += 1
        at = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[1, at]), pa.array(seen[0, at])],
                                         names=["gram", "toxic", "clean"])

    found = rows.mapInArrow(batches, "gram bigint, toxic bigint, clean bigint")
    return found.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def evidence(counts: DataFrame, toxic: int, clean: int, limit: int) -> list[tuple[int, float]]:
    """(n-gram, log-count ratio) of the n-grams that tell the classes apart best: at most `limit` of them."""
    p, q = (F.col("toxic") + 1) / (toxic + 2), (F.col("clean") + 1) / (clean + 2)
    share = (F.col("toxic") + F.col("clean")) / (toxic + clean)
    spread = F.sqrt(share * (1 - share) * (1 / toxic + 1 / clean))
    z = F.abs(F.col("toxic") / toxic - F.col("clean") / clean) / (spread + 1e-9)
    best = counts.where(F.col("toxic") + F.col("clean") >= 3).select("gram", F.log(p / q).alias("r"), z.alias("z"))
    rows = best.orderBy(F.desc("z"), "gram").limit(limit).select("gram", "r").collect()
    return [(x["gram"], x["r"]) for x in rows]


def fit(docs: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, steps: int = 300,
        ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights of present features and the bias: logistic regression on ratio-scaled features (Adam, full batches)."""
    length = np.array([len(x) for x in docs])
    at = np.concatenate(docs) if len(docs) else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(docs)), length)
    share = labels.mean()
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    weight /= weight.sum()
    theta, m, v = np.zeros(len(ratios) + 1), np.zeros(len(ratios) + 1), np.zeros(len(ratios) + 1)
    for t in range(1, steps + 1):
        w = theta[:-1] * ratios
        z = np.bincount(row, w[at], len(docs)) + theta[-1]
        error = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels)
        grad = np.append(np.bincount(at, error[row], len(ratios)) * ratios + ridge * theta[:-1], error.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta - 0.02 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return theta[:-1] * ratios, float(theta[-1])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES) -> dict:
    """The model from docs (id, text) and labels (id, label): bounded arrays, and the base rate."""
    known = labels.where(F.col("label").isNotNull() & F.col("id").isNotNull()).groupBy("id").agg(
        F.max(F.col("label").cast("int")).alias("label"))
    total = known.count()
    share = min(1.0, max_rows / max(total, 1))
    chosen = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    # At most about max_rows short rows: safe to send to all tasks, so that the texts do not move.
    # One text of each id, so that repeated ids do not enlarge the sample; only these rows move.
    rows = docs.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    rows = stored(rows.select(F.col("text").cast("binary").alias("text"), "label").repartition(16), "labelled")
    sizes = {x["label"]: x["count"] for x in rows.groupBy("label").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    model = {"base": toxic / max(toxic + clean, 1), "numbers": None}
    if not toxic or not clean:
        return model
    strong = evidence(ngram_counts(rows), toxic, clean, max_features)
    if not strong:
        return model
    numbers = np.full(1 << BITS, -1, np.int32)
    numbers[[g for g, _ in strong]] = np.arange(len(strong))
    ratios = np.array([r for _, r in strong])

    def features(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            own = [present(x.as_py() or b"", numbers).astype(np.int32) for x in part.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int32())), part.column(1)],
                                             names=["own", "label"])

    def learn(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, y = [], []
        for part in parts:
            own += [np.asarray(x.values) for x in part.column(0)]
            y += part.column(1).to_pylist()
        w, bias = fit(own, np.array(y, float), ratios)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(w, bias))], names=["w"])

    bag = rows.mapInArrow(features, "own array<int>, label int").orderBy("label", F.hash("own"), F.size("own"))
    learnt = bag.coalesce(1).mapInArrow(learn, "w double").collect()
    theta = np.array([x["w"] for x in learnt])
    return model | {"numbers": numbers, "w": theta[:-1], "bias": theta[-1]}


def scorer(model: dict):
    """A pandas UDF over binary texts."""
    shared = dict(model)

    def score(texts: pd.Series) -> pd.Series:
        if shared["numbers"] is None:
            return pd.Series(np.full(len(texts), float(shared["base"])))
        z = [shared["w"][present(x or b"", shared["numbers"])].sum() + shared["bias"] for x in texts]
        return pd.Series(1 / (1 + np.exp(-np.clip(np.array(z, float), -40, 40))))

    return F.pandas_udf(score, "double")


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
             label_id: str | None = None, learn_from: Column | None = None, max_rows: int = MAX_ROWS,
             max_features: int = MAX_FEATURES) -> DataFrame:
    """The input's columns with score and predicted; learn_from (over the labels' columns) limits what is learnt."""
    taught = labels if learn_from is None else labels.where(learn_from)
    model = train(pick(docs, id=doc_id, text=text), pick(taught, id=label_id or doc_id, label=label), max_rows,
                  max_features)
    scored = docs.select(packed(docs), scorer(model)(docs[f"`{text}`"].cast("binary")).alias("score"))
    return scored.select(*unpacked(docs.columns, replaced=set(RESULTS)), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
