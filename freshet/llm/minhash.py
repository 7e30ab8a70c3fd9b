"""Near-duplicate documents with circulant MinHash, banding and exact Jaccard verification.

Method: one permutation places the shingles on a circle; a second one, shifted by k places, gives coordinate k of the
signature (C-MinHash). Coordinates are kept as bytes; bands of them are bucket keys. Documents with equal shingle sets
are one class and go on as one representative. Links are confirmed on full shingle sets:

1. In every bucket each member is compared with the least member (linear in the bucket), and components are formed.
2. In every bucket that still holds several components, members of different components are compared by their whole
   signatures, in cells of bounded size; pairs that could reach the threshold are confirmed on full sets at once.

Members of one component need no further link, so nothing is lost by leaving those pairs out. With 48 bands of 7 rows
a pair at a similarity of exactly 0.8 shares no bucket with a probability of about 1e-5, and the signature estimate of
step 2 lets it go with about 2e-6; higher similarities are safer still.

Defined cases: text without words has an empty set and links with nothing; with fewer words than a shingle the whole
sequence is the only shingle; rows of one id are one node (linked through it); a row with a null id links with
nothing, has a null component and is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from freshet.llm.circulant import shingle_set, signature
from freshet.llm.common import packed, pick, stored, unpacked
from freshet.llm.components import components

BANDS, ROWS = 48, 7
#: Members of one side of a cell.
CELL = 256
#: Ids of up to this many documents (16 MB) are broadcast; more are joined by shuffling.
BROADCAST_IDS = 1_000_000


def set_digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, size: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, n, digest, sig) of each document (id, text); digest and sig are null for an empty set."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            n, digests, sigs = [], [], []
            for raw in part.column(1):
                own = shingle_set(raw.as_py() or b"", size)
                n.append(len(own))
                digests.append(set_digest(own) if len(own) else None)
                sigs.append(signature(own, bands * rows).astype(np.uint8).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())],
                names=["id", "n", "digest", "sig"])

    raw = docs.select("id", F.col("text").cast("binary").alias("text"))
    return raw.mapInArrow(batches, f"id {dict(docs.dtypes)['id']}, n bigint, digest binary, sig binary")


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """(id, digest, own) with the sorted shingle hashes of each document (id, text)."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sets = [shingle_set(x.as_py() or b"", size) for x in part.column(1)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([set_digest(x) for x in sets], pa.binary()),
                 pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["id", "digest", "own"])

    raw = docs.select("id", F.col("text").cast("binary").alias("text"))
    return raw.mapInArrow(batches, f"id {dict(docs.dtypes)['id']}, digest binary, own array<bigint>")


def bucket_keys(reps: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, rep, n): one row per band of each representative."""
    band = F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band")
    cut = reps.select("rep", "n", "sig", band)
    return cut.select(F.xxhash64("band", F.substring("sig", F.col("band") * rows + 1, F.lit(rows))).alias("key"), "rep", "n")


def near_sizes(a: str, b: str, percent: int):
    """Sets of too different sizes cannot reach the threshold."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def full_sets(ids: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(id, digest, own) with the whole shingle sets of the documents of these ids, one row per different set."""
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return stored(shingle_sets(docs.join(side, "id", "left_semi"), size).dropDuplicates(["id", "digest"]), "sets")


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    pairs = stored(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    sets = full_sets(stored(ids, "ids"), docs, size)
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("own").alias("s")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("own").alias("t")), "b")
    common = both.select("a", "b", F.size(F.array_intersect("s", "t")).alias("i"), (F.size("s") + F.size("t")).alias("n"))
    return common.where(F.col("i") * 100 >= (F.col("n") - F.col("i")) * percent).select("a", "b").distinct()


def crossing(cells: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) between components, from cells (key, x, y, side, rep, n, root, sig, own).

    Signatures say which pairs could reach the threshold; those are confirmed on their full sets, unless a link found
    in the cell already joins their components. Rows of a cell follow each other in a sorted partition; no more than
    one cell (2 x CELL rows or so) is held.
    """
    def links_of(block: list[pa.Table]) -> tuple[list[int], list[int]]:
        t = pa.concat_tables(block)
        x, y, side = t["x"][0].as_py(), t["y"][0].as_py(), np.array(t["side"])
        rep, root, n = (np.array(t[c].to_pylist()) for c in ("rep", "root", "n"))
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint8).reshape(len(rep), -1)
        own = [v.values.to_numpy() for v in t["own"]]
        least = int(sig.shape[1] * (percent - 10) / 100)
        out_a, out_b = [], []
        for i in range(len(rep)):
            other = np.arange(i + 1, len(rep)) if x == y else np.flatnonzero(side == y) if side[i] == x else np.empty(0, int)
            other = other[(root[other] != root[i]) & (np.minimum(n[other], n[i]) * 100 >= np.maximum(n[other], n[i]) * percent)]
            other = other[(sig[other] == sig[i]).sum(axis=1) >= least]
            for j in other.tolist():
                if root[j] == root[i]:
                    continue
                common = len(np.intersect1d(own[i], own[j], assume_unique=True))
                if common * 100 >= (len(own[i]) + len(own[j]) - common) * percent:
                    out_a.append(min(rep[i], rep[j]))
                    out_b.append(max(rep[i], rep[j]))
                    root[root == root[j]] = root[i]
        return out_a, out_b

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        last = None

        def made() -> pa.RecordBatch:
            a, b = links_of(held)
            kind = held[0]["rep"].type
            return pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], names=["a", "b"])

        for part in parts:
            t = pa.Table.from_batches([part])
            if not len(t):
                continue
            place = np.stack([np.array(t[c]) for c in ("key", "x", "y")])
            cuts = [0, *(np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1).tolist(), len(t)]
            for lo, hi in zip(cuts, cuts[1:]):
                here = tuple(place[:, lo].tolist())
                if held and here != last:
                    yield made()
                    held.clear()
                held.append(t.slice(lo, hi - lo))
                last = here
        if held:
            yield made()

    of = cells.schema["rep"].dataType.simpleString()
    return cells.mapInArrow(batches, f"a {of}, b {of}")


def unresolved(keys: DataFrame, reps: DataFrame, docs: DataFrame, roots: DataFrame, size: int, cell: int) -> DataFrame:
    """Cells of the buckets that hold several components, members dealt into sides of about `cell`."""
    known = keys.join(roots, keys.rep == roots.node, "left").select(
        "key", "rep", "n", F.coalesce("root", "rep").alias("root"))
    many = known.groupBy("key").agg(F.count("*").alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    many = many.where(F.col("lo") != F.col("hi")).select("key", F.ceil(F.col("m") / cell).cast("int").alias("sides"))
    members = known.join(many, "key").withColumn("side", F.pmod(F.xxhash64("rep"), F.col("sides")).cast("int"))
    spread = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    cells = spread.select("key", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "side",
                          "rep", "n", "root")
    cells = stored(cells, "cells")
    sets = full_sets(stored(cells.select(F.col("rep").alias("id")).distinct(), "ids"), docs, size)
    signed = reps.select("rep", "digest", "sig").join(sets.withColumnRenamed("id", "rep"), ["rep", "digest"])
    return cells.join(signed.drop("digest"), "rep").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5,
                    percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept), one row per row of the input."""
    plain = pick(docs, id=doc_id, text=text)
    named = plain.where(F.col("id").isNotNull())
    signed = stored(signatures(plain, shingle), "signatures")
    sets = signed.where(F.col("id").isNotNull() & F.col("digest").isNotNull())
    reps = stored(sets.groupBy("digest").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")),
                  "classes")
    keys = bucket_keys(reps)
    shared = keys.groupBy("key").agg(F.count("*").alias("m"), F.min(F.struct("rep", "n")).alias("hub"))
    shared = shared.where("m > 1").select("key", "hub")
    held = stored(keys.join(shared, "key"), "buckets")
    star = held.where((F.col("hub.rep") != F.col("rep")) & near_sizes("hub.n", "n", percent)).select(
        F.col("hub.rep").alias("a"), F.col("rep").alias("b")).distinct()
    links = stored(confirmed(star, named, shingle, percent), "links")
    # Ids that stand in several classes link them.
    member = sets.join(reps.select("digest", "rep"), "digest").select("id", "rep").distinct()
    ties = member.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a != z")
    ties = ties.join(member, "id").select("a", F.col("rep").alias("b")).where("a != b")
    links = stored(links.unionByName(ties).distinct(), "links")
    cells = unresolved(held.select("key", "rep", "n"), reps, named, components(links), shingle, CELL)
    more = crossing(cells, percent).distinct()
    roots = components(links.unionByName(more))
    placed = reps.join(roots, reps.rep == roots.node, "left").select(
        "digest", F.coalesce("root", "rep").alias("component"))
    labelled = signed.join(placed, "digest", "left")
    component = F.coalesce("component", "id")
    return labelled.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                           F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5,
                     percent: int = 80) -> DataFrame:
    """The input's rows without those of a component that are not its least id."""
    gone = near_duplicates(docs, doc_id, text, shingle, percent).where(~F.col("kept")).select(
        F.col("id").alias("gone")).distinct()
    rows = docs.select(packed(docs), docs[f"`{doc_id}`"].alias("id"))
    return rows.join(gone, F.col("id") == F.col("gone"), "left_anti").select(*unpacked(docs.columns))
