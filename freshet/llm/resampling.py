"""Target-distribution importance resampling: draw the documents that look most like a target collection.

Method: every run of 1 to `most_words` words is a feature; its bucket is the CRC-32 of its bytes, taken from position
tables (`spans`), modulo `buckets`. A bucket's gain is the log ratio of its smoothed shares in the target and in the
documents; a document's weight is the sum of the gains of its features. Gumbel noise from a hash of the document's id
is added, and the highest scores are drawn: a sample without replacement in proportion to the weights' exponentials.

Scale: texts are read once, and only numbers are kept. Counts of buckets are added up in each task before they are
shuffled; the table of gains has `buckets` entries, whatever the input (a parameter, so a proven bound for driver and
tasks). The draw orders documents by ranges of (score, id), with the place in the stored table as the last key, so
that equal documents are split as well; ranks are a range's offset and the place inside it. No task sees all rows.

Defined cases: a null or empty text has no features, a weight of 0 and no rank; a null id is hashed as the empty
string and comes last among equal scores; repeated rows are documents of their own (equal scores, ranks in any order);
an empty table gives an empty table, an empty target counts as nothing seen; texts of any length are read whole; input
columns that bear a result's name are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from freshet.llm.common import packed, stored, unpacked
from freshet.llm.spans import span_crc32, words

RESULTS = ("n_words", "n_features", "weight", "score", "rank")
FEATURES = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_features", T.LongType()),
                         T.StructField("buckets", T.ArrayType(T.IntegerType()))])


def text_buckets(column: pa.Array, buckets: int, most_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of words and of features of each text, and the buckets of all features, text by text."""
    data, starts, lengths, count = words(column)
    if most_words == 1:
        return count, count, (span_crc32(data, starts, lengths) % buckets).astype(np.int32)
    # Words with one space after each, so that a run of words is one span.
    begins = np.cumsum(lengths + 1) - lengths - 1
    joined = np.full(int((lengths + 1).sum()), ord(" "), np.uint8)
    inside = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    joined[np.repeat(begins, lengths) + inside] = data[np.repeat(starts, lengths) + inside]
    text_of = np.repeat(np.arange(len(count)), count)
    found, owner = [], []
    for size in range(1, most_words + 1):
        first = np.flatnonzero(text_of[size - 1:] == text_of[:len(text_of) - size + 1]) if len(text_of) >= size else []
        first = np.asarray(first, np.int64)
        last = first + size - 1
        found.append(span_crc32(joined, begins[first], begins[last] + lengths[last] - begins[first]) % buckets)
        owner.append(text_of[first])
    owners = np.concatenate(owner)
    return (count, np.bincount(owners, minlength=len(count)),
            np.concatenate(found)[np.argsort(owners, kind="stable")].astype(np.int32))


def featurised(docs: DataFrame, buckets: int, most_words: int) -> DataFrame:
    """(row, text) to (row, n_words, n_features, buckets), in Arrow batches."""
    kinds = T.StructType([docs.schema.fields[0], *FEATURES.fields])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            n_words, n_features, found = text_buckets(part.column(1), buckets, most_words)
            ends = np.concatenate([[0], np.cumsum(n_features)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()),
                 pa.ListArray.from_arrays(ends, pa.array(found, pa.int32()))],
                names=["row", "n_words", "n_features", "buckets"])

    return docs.mapInArrow(batches, kinds)


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs; a task sends each of its buckets once."""

    def added(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in parts:
            total += np.bincount(part.column(0).flatten(), minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen])], names=["bucket", "n"])

    sums = features.select("buckets").mapInArrow(added, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in sums.collect():  # one row for each bucket
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of the smoothed shares) of each bucket."""
    size = len(source)
    of_source, of_target = float(source.sum() + size), float(target.sum() + size)
    return np.array([math.floor(1000 * math.log((float(t) + 1) * of_source / ((float(s) + 1) * of_target)))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weighted(base: DataFrame, gain: np.ndarray) -> DataFrame:
    """(row, n_words, n_features, weight): the sum of the gains of each document's buckets."""
    kinds = T.StructType([*[f for f in base.schema.fields if f.name != "buckets"], T.StructField("weight", T.LongType())])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            lists = part.column(3)
            sums = np.concatenate([[0], np.cumsum(gain[np.asarray(lists.flatten())])]).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths())]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(3)], pa.array(sums[ends[1:]] - sums[ends[:-1]])],
                                             names=["row", "n_words", "n_features", "weight"])

    return base.mapInArrow(batches, kinds)


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first eight hexadecimal digits of a hash of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(F.lit(-1000.0) * F.log(-F.log(share))).cast("long")


def ranked(scored: DataFrame, drawn: int) -> DataFrame:
    """`rank` of the `drawn` highest scores, equal ones by id; null for the others."""
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("place")]
    ranges = scored.repartitionByRange(*order).sortWithinPartitions(*order)
    # The number holds the range and the row's place in it; the table is written once, so both stay as they are.
    numbered = stored(ranges.withColumn("at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("at", 33)
    sizes = numbered.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rank = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    return numbered.withColumn("part", part).join(offsets, "part").withColumn("rank", F.when(rank <= drawn, rank))


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
             buckets: int = 10_000, most_words: int = 1, percent: int = 10, min_words: int = 20,
             seed: int = 2024) -> DataFrame:
    """The input's columns without the text, with n_words, n_features, weight, score and rank (null if not drawn).

    Of the documents with `min_words` words or more, `percent` per cent are drawn, rounded down.
    """
    left = [c for c in docs.columns if c != text]
    only = docs.select(packed(docs.select([F.col(f"`{c}`") for c in left])), docs[f"`{text}`"].cast("string").alias("text"))
    base = stored(featurised(only, buckets, most_words), "features")
    aims = target.select(F.lit(0).alias("row"), target[f"`{target_text}`"].cast("string").alias("text"))
    gain = gains(bucket_counts(base, buckets), bucket_counts(featurised(aims, buckets, most_words), buckets))
    key = F.col("row").getField(doc_id)
    scored = weighted(base, gain).withColumn("score", F.col("weight") + noise(key, seed))
    able = F.col("n_words") >= min_words
    drawn = base.where(able).count() * percent // 100
    first = ranked(scored.where(able).withColumns({"id": key, "place": F.monotonically_increasing_id()}), drawn)
    names = ["row", *RESULTS]
    rest = scored.where(~able).withColumn("rank", F.lit(None).cast("long"))
    return first.select(*names).unionAll(rest.select(*names)).select(*unpacked(left, replaced=set(RESULTS)), *RESULTS)


def drawn_documents(docs: DataFrame, judged: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows of `docs` whose id was drawn, texts included."""
    chosen = judged.where(F.col("rank").isNotNull()).select(F.col(f"`{doc_id}`").alias("_drawn")).distinct()
    return docs.join(chosen, docs[f"`{doc_id}`"].eqNullSafe(chosen["_drawn"]), "left_semi")
