"""Quality rules of documents and of the hosts they come from.

Method: each document is measured once; failures of the rules are added up by host; each host's failure rate is shrunk
towards the rate of all hosts with a beta prior whose mean and weight are estimated from the hosts themselves (method
of moments); a host whose shrunken rate of any rule exceeds `host_limit` is rejected, and the verdict is joined back to
its documents. A document is kept if it passes its own base rules and its host is not rejected.

Defined cases: a null or empty text has no words (it fails the base rule); a null host is a host of its own; an empty
table gives an empty table; rows are judged one by one, so repeated rows each get a verdict; input columns that bear a
result's name are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from freshet.llm.common import SPACES, packed, same, stored, unpacked

SYMBOLS = "#*$%&|<>"
RULES = ("short", "repeats", "symbols", "dup_lines")
#: At most these shares of a document's words or lines.
MAX_SYMBOLS = 0.2
MAX_DUP_LINES = 0.3
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RESULTS = (*MEASURES, "n_lines", "base_failed", "host_rate", "host_rejected", "kept")


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that stand twice or more in the text, the first one included."""
    n = len(words)
    if n < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    if len(numbers) == n:
        return 0
    pairs = ids[:-1] * len(numbers) + ids[1:]
    if len(numbers) > 2_000_000:  # three numbers would not fit into 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    codes = pairs[:-1] * len(numbers) + ids[2:]
    order = np.argsort(codes, kind="stable")
    ordered = codes[order]
    twice = np.zeros(n - 2, bool)
    equal = ordered[1:] == ordered[:-1]
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    inside = np.zeros(n, bool)
    for shift in range(3):
        inside[shift:n - 2 + shift] |= twice
    return int(inside.sum())


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the number of lines with a word."""
    text = text or ""
    words = text.encode("utf-8").split()  # of bytes: exactly the six white-space characters
    chars = len(text) - sum(text.count(c) for c in SPACES)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (len(words), chars, sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)),
            repeated_words(words), len(lines))


def measured(docs: DataFrame) -> DataFrame:
    """(row, host, measures) of every document (row, host, text), in Arrow batches."""
    names = (*MEASURES, "n_lines")
    kinds = T.StructType([*docs.schema.fields[:-1], *[T.StructField(n, T.LongType()) for n in names]])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            values = np.array([measure(x) for x in part.column(2).to_pylist()], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), *[pa.array(values[:, i]) for i in range(len(names))]],
                names=["row", "host", *names])

    return docs.mapInArrow(batches, kinds)


def prior(hosts: DataFrame) -> dict[str, tuple[float, float]]:
    """(a, b) of each rule's beta prior, from the mean and the spread of the hosts' rates: one row of sums."""
    row = hosts.agg(*[f for r in RULES for f in (
        F.sum(r).alias(f"f_{r}"),
        F.sum(F.col(r) * F.col(r) / F.col("n")).alias(f"s_{r}"))],
        F.sum("n").alias("n"), F.count("*").alias("hosts")).first()
    out = {}
    for r in RULES:
        if not row["n"]:
            out[r] = (1.0, 1.0)
            continue
        n, k = row["n"], row["hosts"]
        mean = min(max(row[f"f_{r}"] / n, 1e-6), 1 - 1e-6)
        # Spread of the rates, weighted by size, less what chance alone gives.
        spread = row[f"s_{r}"] / n - (row[f"f_{r}"] / n) ** 2 - mean * (1 - mean) * k / n
        weight = mean * (1 - mean) / spread - 1 if spread > 0 else float(n)
        weight = min(max(weight, 1.0), float(n))
        out[r] = (mean * weight, (1 - mean) * weight)
    return out


def quality_rules(docs: DataFrame, host: str = "source", text: str = "text", min_words: int = 50,
                  max_repeat_percent: int = 50, host_limit: float = 0.5) -> DataFrame:
    """The input's columns without the text, with the measures, base_failed, host_rate, host_rejected and kept.

    Measures are stored once (numbers only); the host table meets them by equality, and adaptive execution splits a
    host that holds a large share of the rows or sends the host table to all tasks when it is small.
    """
    left = [c for c in docs.columns if c != text]
    only = docs.select(packed(docs.select([F.col(f"`{c}`") for c in left])), docs[f"`{host}`"].cast("string").alias("host"),
                       docs[f"`{text}`"].alias("text"))
    raw = measured(only)
    words = F.col("n_words")
    rules = {
        "short": words < min_words,
        "repeats": F.col("n_repeat_words") * 100 > words * max_repeat_percent,
        "symbols": F.col("n_symbols") > words * MAX_SYMBOLS,
        "dup_lines": F.col("n_dup_lines") > F.col("n_lines") * MAX_DUP_LINES,
    }
    base = stored(raw.withColumns({f"r_{k}": v for k, v in rules.items()}), "measures")
    hosts = base.groupBy("host").agg(F.count("*").alias("n"), *[
        F.sum(F.col(f"r_{k}").cast("long")).alias(k) for k in RULES])
    ab = prior(hosts)
    rate = F.greatest(*[(F.col(k) + ab[k][0]) / (F.col("n") + sum(ab[k])) for k in RULES])
    verdicts = hosts.select(F.col("host").alias("their_host"), rate.alias("host_rate"))
    joined = base.join(verdicts, same(F.col("host"), F.col("their_host")), "left")
    failed = F.col("r_short") | F.col("r_repeats")
    rejected = F.col("host_rate") > host_limit
    return joined.select(
        *unpacked(left, replaced=set(RESULTS)), *MEASURES, "n_lines", failed.alias("base_failed"), "host_rate",
        rejected.alias("host_rejected"), (~failed & ~rejected).alias("kept"))
