"""Line de-duplication: lines found in many documents go from all of them.

Method: explode normalised lines, hash, count documents per hash, drop lines over the threshold, reassemble by
position. Defined cases: a null or empty text is one empty line; lines whose key is shorter than `min_chars` always
stay; rows that share an id are one document when lines are counted, rows without an id are documents of their own;
an empty table gives an empty table; columns of the input that bear a result's name are replaced.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from freshet.llm.common import SPACES, ascii_lower, packed, pick, same, stored, unpacked

RESULTS = ("n_lines", "n_dropped", "kept_text")


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def row_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(id, key) for each different line of each row, without a shuffle; the key is a 128-bit hash."""
    keys = F.transform(
        F.array_distinct(F.transform(lines_of(F.col("text")),
                                     lambda x: ascii_lower(F.btrim(x, F.lit(SPACES))))),
        lambda x: F.when(F.char_length(x) >= max(min_chars, 0), F.unhex(F.md5(x))))
    return docs.select("id", F.explode(keys).alias("key")).where(F.col("key").isNotNull())


def common_keys(docs: DataFrame, keys: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """Keys that stand in `min_docs` documents or more.

    Rows are counted, which adds up in each task before the shuffle; what rows of the same id count too often is taken
    off again, so only rows whose id repeats are met by (key, id).
    """
    twice = stored(docs.where(F.col("id").isNotNull()).groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"),
                   "repeated_ids")
    again = row_keys(docs.join(twice, "id", "left_semi"), min_chars).groupBy("key", "id").agg(F.count("*").alias("n"))
    counted = keys.groupBy("key").agg(F.count("*").alias("n")).unionByName(
        again.where("n > 1").groupBy("key").agg((F.count("*") - F.sum("n")).alias("n")))
    return counted.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs).select("key")


def reassemble(texts: pd.Series, hot: pd.Series) -> pd.DataFrame:
    """The lines of each text whose keys are not in its list, in their order."""
    out = []
    for text, keys in zip(texts, hot):
        text = text or ""
        lines = text.split("\n")
        if keys is None:
            out.append((len(lines), 0, text))
            continue
        gone = {bytes(k) for k in keys}
        kept = [x for x in lines if hashlib.md5(_key(x)).digest() not in gone]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return pd.DataFrame(out, columns=list(RESULTS))


def _key(line: str) -> bytes:
    return line.encode("utf-8").strip(SPACES.encode()).lower()  # bytes: A-Z only


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 10,
               min_chars: int = 1) -> DataFrame:
    """The input's columns with n_lines, n_dropped and kept_text.

    Only hashes move to be counted. The common ones are stored, so that Spark knows their size: small enough, they are
    broadcast; otherwise both sides of the join are plain shuffles, which the adaptive join splits at a hot hash. Each
    text moves once, to meet the list of its own common lines; ids that repeat share one list.
    """
    plain = pick(docs, id=doc_id, text=text)
    keys = row_keys(plain, min_chars)
    hot = keys.join(stored(common_keys(plain, keys, min_chars, min_docs), "common_lines"), "key", "left_semi")
    lists = hot.groupBy(F.col("id").alias("hot_id")).agg(F.collect_set("key").alias("hot"))
    rows = docs.select(packed(docs), docs[f"`{doc_id}`"].alias("id"), docs[f"`{text}`"].alias("body"))
    joined = rows.join(lists, same(F.col("id"), F.col("hot_id")), "left")
    assembled = F.pandas_udf(reassemble, "n_lines bigint, n_dropped bigint, kept_text string")
    done = joined.select("row", assembled("body", "hot").alias("done"))
    return done.select(*unpacked(docs.columns, replaced=set(RESULTS)), "done.*")
