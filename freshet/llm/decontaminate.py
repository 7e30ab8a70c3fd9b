"""Benchmark decontamination with a distributed positional inverted index. DataFrame functions only.

Method: document frequencies of the benchmark's terms are counted over all documents; every window of an item is
looked up by its two rarest terms only. The postings (term, document, position) of those terms are stored, and their
lists are intersected after subtracting each term's offset in the item: where both rare terms of a window agree on
where the item would begin in a document, the window is a candidate, which is then compared with the document's words.
A window can only occur where both of its rarest terms agree, so no occurrence is lost. Places of an item are carried
as its number and an offset, a candidate holds one window, so the work grows in proportion to an item's length.

Proximity: the same places are intersected with some play. An item is near in a document if, in some band of
2 * `play` successive beginnings (bands start at the multiples of `play`), at least two and at least half of its rare
places stand in the document. So a passage is found though words were put in, left out or replaced inside every window.

Words are maximal runs of ASCII letters, digits and non-ASCII characters, with A-Z lower-cased. Defined cases: a null
or empty text has no words; an item without words has no window, one with fewer words than a window is one window; a
null item id is named by an empty string; items of one id count as one; an item of one word is never near; rows with
equal id and text (repeated rows) each get the same result; an empty benchmark hits nothing; clashing columns of the
input are replaced by the results. Items and texts may be of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from freshet.llm.common import alnum_words, ascii_lower, packed, pick, same, stored, unpacked

#: A side of up to this many bytes of values is broadcast; a larger one is joined by shuffling.
BROADCAST_BYTES = 32 * 2**20
RESULTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
NEAR = "near_items"


def item_words(items: DataFrame) -> DataFrame:
    """(k, item, words) of different items with words, numbered by k and stored; items has id and text."""
    words = F.transform(alnum_words(F.col("text")), ascii_lower)
    different = (items.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("item"), words.alias("words"))
                 .where(F.size("words") > 0).distinct())
    return stored(different.withColumn("k", F.monotonically_increasing_id()), "items")


def row_key(docs: DataFrame) -> DataFrame:
    """Adds h: rows that share id and h have equal results."""
    return docs.withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))


def doc_tokens(docs: DataFrame) -> DataFrame:
    """(id, h, pos, term) of every word of every document."""
    tokens = docs.select("id", "h", F.posexplode(alnum_words(F.col("text"))).alias("pos", "term"))
    return tokens.withColumn("term", ascii_lower(F.col("term")))


def checked(small: DataFrame) -> DataFrame:
    """Broadcast a side only if the bytes of its values allow it: its terms and 16 for each row's numbers."""
    held = small.agg(F.sum(F.octet_length("term") + 16).alias("held")).first()["held"]
    return F.broadcast(small) if (held or 0) <= BROADCAST_BYTES else small


def item_windows(items: DataFrame, frequencies: DataFrame, length: int) -> DataFrame:
    """(k, item, n, start, size, text, rarest) of every window of every item, stored.

    n counts the item's words; rarest holds (df, offset, term) of the window's two rarest words, offsets in the item.
    """
    words = items.select("k", "item", F.size("words").alias("n"), F.posexplode("words").alias("offset", "term"))
    weighed = words.join(checked(frequencies), "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    ahead = Window.partitionBy("k").orderBy("offset").rowsBetween(0, length - 1)
    size = F.least(F.lit(length), F.col("n"))
    inside = weighed.select("k", "item", "n", F.col("offset").alias("start"), size.alias("size"),
                            F.collect_list(F.struct("df", "offset", "term")).over(ahead).alias("inside"))
    return stored(inside.where(F.col("start") <= F.col("n") - F.col("size")).select(
        "k", "item", "n", "start", "size", F.array_join(F.col("inside.term"), " ").alias("text"),
        F.slice(F.sort_array("inside"), 1, 2).alias("rarest")), "windows")


def rare_places(windows: DataFrame) -> DataFrame:
    """(k, n, rare, term, offset): the places of the rarest words of each item's windows, and their number."""
    places = windows.select("k", "n", F.explode("rarest").alias("r")).select("k", "n", "r.term", "r.offset").distinct()
    return stored(places.withColumn("rare", F.count("*").over(Window.partitionBy("k"))), "places")


def term_frequencies(tokens: DataFrame, items: DataFrame) -> DataFrame:
    """How often each term of the items stands in the documents; stored, as its bytes are counted before it is joined."""
    terms = stored(items.select(F.explode("words").alias("term")).distinct(), "terms")
    counted = tokens.join(checked(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    return stored(counted, "frequencies")


def postings(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """The stored index (term, id, h, pos) of the given terms."""
    return stored(tokens.join(checked(terms), "term", "left_semi").select("term", "id", "h", "pos"), "postings")


def meetings(index: DataFrame, places: DataFrame) -> DataFrame:
    """(id, h, k, n, rare, offset, shift): a rare place of an item in a document, and where the item would begin.

    Postings are dealt by document first, so that with few places all that follows stays in the partition.
    """
    met = index.repartition("id", "h").join(checked(places), "term")
    return met.select("id", "h", "k", "n", "rare", "offset", (F.col("pos") - F.col("offset")).alias("shift"))


def window_starts(offsets: Column, n: Column, size: Column) -> Column:
    """(start, found) of the windows that hold two of the sorted offsets; found: those from the window's first one on.

    A window is listed with the first two offsets in it only, and with at most `size` of them, so that the list grows
    in proportion to the offsets.
    """
    def listed(low: Column, high: Column, first: Column) -> Column:
        one = lambda start: F.struct(start.alias("start"), F.slice(offsets, first + 1, size).alias("found"))
        return F.transform(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>")), one)

    def pair(i: Column) -> Column:
        before, left, right = F.get(offsets, i - 2), F.get(offsets, i - 1), F.get(offsets, i)
        return listed(F.greatest(F.lit(0), right - size + 1, before + 1), F.least(left, n - size), i - 1)

    alone = F.transform(offsets, lambda o: F.struct(o.alias("start"), F.array(o).alias("found")))
    return F.when(size == 1, alone).otherwise(F.flatten(F.transform(F.sequence(F.lit(1), F.size(offsets) - 1), pair)))


def candidates(met: DataFrame, windows: DataFrame, length: int) -> DataFrame:
    """(id, h, item, begin, size, text): windows whose rarest words agree on where they begin in a document."""
    size = F.least(F.lit(length), F.col("n"))
    agreed = met.groupBy("id", "h", "k", "n", "shift").agg(F.sort_array(F.collect_set("offset")).alias("offsets"))
    agreed = agreed.where(F.size("offsets") >= F.least(F.lit(2), size))
    starts = agreed.select("id", "h", "k", "shift", F.explode(window_starts(F.col("offsets"), F.col("n"), size)).alias("s"))
    starts = starts.select("id", "h", "k", "shift", "s.start", "s.found").where(F.col("shift") + F.col("start") >= 0)
    own = windows.select("k", "item", "start", "size", "text", F.col("rarest.offset").alias("rarest"))
    meant = starts.join(own, ["k", "start"]).where(F.size(F.array_except("rarest", "found")) == 0)
    return meant.select("id", "h", "item", (F.col("shift") + F.col("start")).alias("begin"), "size", "text")


def near_items(met: DataFrame, items: DataFrame, play: int) -> DataFrame:
    """(id, h, item) of items that are near in a document."""
    band = F.floor(F.col("shift") / play)
    spread = met.select("id", "h", "k", "rare", "offset", F.explode(F.array(band - 1, band)).alias("band"))
    counted = spread.groupBy("id", "h", "k", "rare", "band").agg(F.count_distinct("offset").alias("found"))
    near = counted.where((F.col("found") >= 2) & (2 * F.col("found") >= F.col("rare")))
    return near.join(items.select("k", "item"), "k").select("id", "h", "item").distinct()


def _let(value: Column, use) -> Column:
    """Evaluate a value once and use it many times."""
    return F.element_at(F.transform(F.array(value), use), 1)


def covered(hits: Column) -> Column:
    """Number of different word positions inside any window."""
    spans = F.sort_array(F.transform(hits, lambda x: F.struct(x["begin"].alias("b"), (x["begin"] + x["size"]).alias("e"))))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return F.aggregate(spans, zero, lambda acc, s: F.struct(
        F.greatest(acc["end"], s["e"]).alias("end"),
        (acc["n"] + F.greatest(F.lit(0), s["e"] - F.greatest(acc["end"], s["b"]))).alias("n")))["n"]


def evidence(plain: DataFrame, items: DataFrame, window: int, play: int | None) -> DataFrame:
    """(found_id, found_h, found, near): candidate windows and near items of the documents that have any."""
    tokens = doc_tokens(plain)
    windows = item_windows(items, term_frequencies(tokens.select("term"), items), window)
    places = rare_places(windows)
    met = meetings(postings(tokens, places.select("term").distinct()), places)
    rows = candidates(met, windows, window).select("id", "h", F.struct("item", "begin", "size", "text").alias("found"))
    if play is not None:
        near = near_items(met, items, play).withColumnRenamed("item", "near")
        rows = rows.unionByName(near, allowMissingColumns=True)
    else:
        rows = rows.withColumn("near", F.lit(None).cast("string"))
    return rows.groupBy(F.col("id").alias("found_id"), F.col("h").alias("found_h")).agg(
        F.collect_list("found").alias("found"), F.sort_array(F.collect_set("near")).alias("near"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = 13,
                  one_in: int = 20, play: int | None = 5) -> DataFrame:
    """The input's columns with n_words, n_hit, n_items, items_sha256 and contaminated, which tell of exact windows.

    near_items (sorted ids) tells of proximity; it is left out, and not computed, where `play` is None.
    """
    items = item_words(pick(benchmark, id=item_id, text=item_text))
    found = evidence(row_key(pick(docs, id=doc_id, text=text)), items, window, play)
    body = docs[f"`{text}`"]
    rows = docs.select(
        packed(docs), docs[f"`{doc_id}`"].alias("id"), F.xxhash64(F.coalesce(body, F.lit(""))).alias("h"),
        F.size(alnum_words(body)).cast("long").alias("n_words"), body.alias("body"))
    joined = rows.join(found, same(F.col("id"), F.col("found_id")) & (F.col("h") == F.col("found_h")), "left")
    hits = F.when(F.size("found") > 0, _let(
        F.transform(alnum_words(F.col("body")), ascii_lower),
        lambda words: F.filter("found", lambda c: F.array_join(F.slice(words, c["begin"] + 1, c["size"]), " ") == c["text"])))
    near = F.coalesce("near", F.array().cast("array<string>"))
    judged = joined.select("row", "n_words", hits.alias("hits"), near.alias(NEAR))
    n_hit = F.coalesce(covered(F.col("hits")), F.lit(0)).cast("long")
    names = F.coalesce(F.array_sort(F.array_distinct(F.transform("hits", lambda x: x["item"]))),
                       F.array().cast("array<string>"))
    counted = judged.select("row", "n_words", n_hit.alias("n_hit"), names.alias("names"), NEAR)
    extra = () if play is None else (NEAR,)
    return counted.select(
        *unpacked(docs.columns, replaced={*RESULTS, *extra}), "n_words", "n_hit",
        F.size("names").cast("long").alias("n_items"), F.sha2(F.array_join("names", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words"))).alias("contaminated"), *extra)
