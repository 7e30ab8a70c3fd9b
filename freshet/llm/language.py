"""Language identification: words first, then progressively shorter character n-grams.

Method: each known word of a text adds its log frequency in every language; a word that was not learnt falls back to
the longest character n-grams (5 down to 1, the word's ends marked) of which any was learnt, and adds the mean of
their log frequencies. Counts come from a bounded sample of the labelled rows (about `max_rows`, chosen by a hash of
the id); the model keeps the `max_words` most frequent words and the `max_grams` most frequent n-grams, so it has a
fixed size and is sent to the workers. Whole texts are scored, in blocks.

Defined cases: null text or text without a letter is `und` with score 0; with nothing to learn from every text is
`und`; equal likelihoods go to the first language in order; rows are judged one by one; input columns that bear a
result's name are replaced.
"""

from __future__ import annotations

import functools
import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from freshet.llm.circulant import mix, powers
from freshet.llm.common import packed, pick, stored, unpacked

LONGEST = 5
SLOTS = 1 << 20
BLOCK = 1 << 18
RESULTS = ("lang_pred", "score")
MAX_ROWS, MAX_WORDS, MAX_GRAMS = 20_000, 60_000, 60_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def blocks(text: str) -> Iterator[np.ndarray]:
    """Lower-cased code points, every word between single gaps (0), in blocks that end at gaps."""
    low = text.lower()
    at = 0
    while at < len(low):
        end = min(len(low), at + BLOCK)
        while end < len(low) and low[end].isalpha():
            end += 1
        points = np.frombuffer(low[at:end].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[points]
        letter_before = np.concatenate(([False], letter[:-1]))
        keep = letter | letter_before
        yield np.concatenate(([0], np.where(letter, points, 0)[keep], [0])).astype(np.uint64)
        at = end


def words_of(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the words in a block."""
    edges = np.diff(np.concatenate(([0], (points != 0).view(np.int8), [0])))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def gram_keys(points: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, first position, key) of all n-grams inside a word or touching its ends, the longest first."""
    gaps = np.concatenate(([0], np.cumsum(points == 0)))
    for n in range(min(LONGEST, len(points)), 0, -1):
        first = np.arange(len(points) - n + 1)
        inner = gaps[n - 1:len(gaps) - 1] - gaps[1:len(gaps) - n + 1] if n > 1 else gaps[1:] - gaps[:-1]
        first = first[inner == 0]
        key = np.full(len(first), np.uint64(n))
        with np.errstate(over="ignore"):
            for i in range(n):
                key = key * _ODD + points[first + i] + np.uint64(1)
            yield n, first, mix(key)


def word_keys(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = powers(1 << max(BLOCK.bit_length(), (len(points)).bit_length()))
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(points + np.uint64(7)) * up[:len(points)])))
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def counts(rows: DataFrame) -> DataFrame:
    """(n, key, lang, times) of words (n = 0) and n-grams in rows (text, lang)."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found: dict[tuple[int, str], list[np.ndarray]] = {}
            for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                for points in blocks(text or ""):
                    starts, ends = words_of(points)
                    found.setdefault((0, lang), []).append(word_keys(points, starts, ends))
                    for n, _, keys in gram_keys(points):
                        found.setdefault((n, lang), []).append(keys)
            for (n, lang), keys in found.items():
                key, times = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(key), n, np.int32)), pa.array(key.view(np.int64)),
                     pa.array([lang] * len(key), pa.string()), pa.array(times)], names=["n", "key", "lang", "times"])

    found = rows.mapInArrow(batches, "n int, key bigint, lang string, times bigint")
    return found.groupBy("n", "key", "lang").agg(F.sum("times").alias("times"))


class Table:
    """Log frequencies per language, found by key.

    A key has one slot by its first bits; keys whose slot is taken are looked up among the sorted rest.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray, total: np.ndarray) -> None:
        order = np.argsort(total, kind="stable")  # the most frequent key of a slot gets it
        self.key = np.zeros(SLOTS, np.uint64)
        self.at = np.full(SLOTS, -1, np.int32)
        slot = self.slot(keys[order])
        self.key[slot], self.at[slot] = keys[order], order
        rest = np.flatnonzero(self.at[self.slot(keys)] != np.arange(len(keys)))
        rest = rest[np.argsort(keys[rest])]
        self.rest_key, self.rest_at = keys[rest], rest.astype(np.int32)
        self.shared = np.zeros(SLOTS, bool)
        self.shared[self.slot(self.rest_key)] = True
        self.values = values.astype(np.float32)

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(44)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self.slot(keys)
        found = np.where(self.key[slot] == keys, self.at[slot], -1)
        open_keys = np.flatnonzero((found < 0) & self.shared[slot])
        if len(open_keys):
            place = np.minimum(np.searchsorted(self.rest_key, keys[open_keys]), len(self.rest_key) - 1)
            found[open_keys] = np.where(self.rest_key[place] == keys[open_keys], self.rest_at[place], -1)
        return found


def train(rows: DataFrame, max_rows: int, max_words: int, max_grams: int) -> dict | None:
    """The model from rows (id, text, lang), or None without any."""
    known = rows.where(F.col("lang").isNotNull())
    total = known.count()
    if not total:
        return None
    share = math.ceil(min(1.0, max_rows / total) * (1 << 20))
    sample = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share).select("text", "lang")
    table = stored(counts(sample.repartition(32)), "counts")
    sums = {(r["kind"], r["lang"]): r["times"] for r in table.groupBy(
        (F.col("n") > 0).alias("kind"), "lang").agg(F.sum("times").alias("times")).collect()}
    langs = sorted({lang for _, lang in sums})
    if not langs:
        return None
    model = {"langs": langs}
    for kind, limit in ((False, max_words), (True, max_grams)):
        part = table.where(F.col("n") > 0 if kind else F.col("n") == 0)
        wide = part.groupBy("key").agg(F.sum("times").alias("all"), *[
            F.sum(F.when(F.col("lang") == x, F.col("times")).otherwise(0)).alias(f"c{i}") for i, x in enumerate(langs)])
        best = wide.where("all > 1").orderBy(F.desc("all"), "key").limit(limit).toPandas()
        c = best[[f"c{i}" for i in range(len(langs))]].to_numpy(float)
        of = np.array([sums.get((kind, x), 0) for x in langs], float)
        logs = np.log((c + 0.5) / (of + 0.5 * max(len(best), 1)))
        model["grams" if kind else "words"] = Table(best["key"].to_numpy(np.int64).view(np.uint64), logs,
                                                    best["all"].to_numpy(float))
    return model


def likelihoods(text: str, model: dict) -> np.ndarray | None:
    """Summed log frequencies by language; None for a text without letters."""
    words, grams = model["words"], model["grams"]
    total, any_word = np.zeros(len(model["langs"])), False
    for points in blocks(text):
        starts, ends = words_of(points)
        if not len(starts):
            continue
        any_word = True
        at = words.find(word_keys(points, starts, ends))
        total += words.values[at[at >= 0]].sum(axis=0)
        open_words = at < 0
        if not open_words.any():
            continue
        # A gap belongs to the word after it in n-grams that begin with the gap.
        owner = np.searchsorted(ends, np.arange(len(points)), side="right")
        owner = np.minimum(owner, len(starts) - 1)
        for _, first, keys in gram_keys(points):
            mine = open_words[owner[first]]
            place, whose = grams.find(keys[mine]), owner[first[mine]]
            known = place >= 0
            if not known.any():
                continue
            place, whose = place[known], whose[known]
            n = np.bincount(whose, minlength=len(starts))
            for i in range(len(total)):
                sums = np.bincount(whose, grams.values[place, i], len(starts))
                total[i] += (sums[n > 0] / n[n > 0]).sum()
            open_words &= n == 0
            if not open_words.any():
                break
    return total if any_word else None


def identifier(model: dict | None):
    def predict(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            total = likelihoods(text, model) if model and text else None
            if total is None:
                out.append(("und", 0.0))
                continue
            best = int(np.argmax(total))
            out.append((model["langs"][best], float(1 / np.exp(np.clip(total - total[best], -700, 0)).sum())))
        return pd.DataFrame(out, columns=list(RESULTS))

    return F.pandas_udf(predict, "lang_pred string, score double")


def identify_language(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
                      learn_from=None, max_rows: int = MAX_ROWS, max_words: int = MAX_WORDS,
                      max_grams: int = MAX_GRAMS) -> DataFrame:
    """The input's columns with lang_pred and score; learn_from (over its columns) limits what is learnt."""
    taught = docs if learn_from is None else docs.where(learn_from)
    model = train(pick(taught, id=doc_id, text=text, lang=lang), max_rows, max_words, max_grams)
    said = docs.select(packed(docs), identifier(model)(docs[f"`{text}`"]).alias("said"))
    return said.select(*unpacked(docs.columns, replaced=set(RESULTS)), "said.*")
