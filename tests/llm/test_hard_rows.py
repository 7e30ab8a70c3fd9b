"""Rows that once failed, were lost or met in one group: blank runs, equal rows, null times, repeated ids, text ids."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from freshet.llm import language, line_dedup, minhash, packing, toxicity, warc


@pytest.fixture(scope="module")
def plain_ids():
    import public_tokenizers

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: whole.encode(text, add_special_tokens=False).ids


def test_long_white_space_is_encoded_as_the_tokenizer_does(plain_ids, monkeypatch):
    import re

    coder = packing.encoding(packing.ranks_path())
    for run in (" " * 5000, "\n" * 5000 + "x", "a" + " \n" * 3000 + " b", "\t" * 4096, "a" + "　" * 4096 + "é c"):
        assert packing.token_ids(coder, run).tolist() == plain_ids(run)
    monkeypatch.setattr(packing, "RUNS", re.compile(f"[{packing.WHITE}]{{3,}}"))
    rng = random.Random(2)
    some = [" ", "\n", "\t", "    ", "\n\n\n", "a", "Hello", "42", "...", "　", "\x1c", "\x85", "\xa0", "é", "'s"]
    for _ in range(500):
        text = "".join(rng.choices(some, k=rng.randint(1, 25)))
        assert packing.token_ids(coder, text).tolist() == plain_ids(text), repr(text)
    monkeypatch.undo()
    assert len(packing.token_ids(coder, " " * 1_200_000 + "end")) > 0


def test_equal_rows_are_dealt_to_different_groups(spark):
    pieces = spark.createDataFrame([(None, 300)] * 3000, "doc_id bigint, length bigint").coalesce(1)
    packed = packing.pack(pieces, group=500).collect()
    bins = {}
    for r in packed:
        bins.setdefault(r["sequence_id"], []).append(r["offset"])
    assert len(packed) == 3000 and all(sorted(o) == [300 * i for i in range(len(o))] for o in bins.values())
    assert len({s >> 24 for s in bins}) >= 5 and len(bins) <= 3000 // 6 + 6


def test_local_search_ends_in_a_local_optimum():
    rng = np.random.default_rng(3)
    for _ in range(20):
        lengths = rng.integers(1, 60, 60)
        bins = packing.local_search(packing.best_fit(lengths, 100), lengths, 100)
        fill = [int(lengths[b].sum()) for b in bins]
        assert sorted(i for b in bins for i in b) == list(range(60)) and max(fill) <= 100
        for x, own in enumerate(bins):
            for y, other in enumerate(bins):
                if x == y or fill[y] < fill[x] or fill[x] == 100:
                    continue
                gap = 100 - fill[y]
                pairs = [(i,) for i in own] + [(i, j) for k, i in enumerate(own) for j in own[k + 1:]]
                assert all(lengths[i] > gap for i in own), "a move is left"
                for given in pairs:
                    total = sum(lengths[i] for i in given)
                    assert not any(lengths[o] < total <= gap + lengths[o] for o in other), "an exchange is left"


def test_rows_of_one_id_are_one_document_for_lines(spark):
    rows = [(1, "same\nown")] * 10 + [(i, "often\nrare %d" % i) for i in range(2, 12)] + [(2, "often")] * 3 + [(None, "nameless")] * 10
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
    assert len(got) == len(rows)
    assert {r["kept_text"] for r in got if r["doc_id"] == 1} == {"same\nown"}  # ten rows, one document
    assert {r["kept_text"] for r in got if r["doc_id"] == 5} == {"rare 5"}  # ten documents
    assert {r["kept_text"] for r in got if r["doc_id"] is None} == {""}  # documents of their own


def test_a_page_without_a_time_keeps_its_record(spark):
    rows = [(1, "http://a.org/", "x" * 200, None), (2, "http://b.org/", "y" * 200, "2024-01-01 00:00:00")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, at string").withColumn("at", F.to_timestamp("at"))
    got = warc.capture_history(spark, pages, captured="at").collect()
    assert sorted((r["page_id"], r["captured"][:10]) for r in got) == [("1", "1970-01-01"), ("2", "2024-01-01")]


def test_every_key_of_a_table_is_found():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2 ** 63, 60_000)).astype(np.uint64)
    table = language.Table(keys, np.zeros((len(keys), 2)), rng.random(len(keys)))
    assert (table.find(keys) == np.arange(len(keys))).all()
    others = np.setdiff1d(rng.integers(0, 2 ** 63, 1000).astype(np.uint64), keys)
    assert (table.find(others) == -1).all()


def test_training_scans_follow_the_input(spark):
    """The few rows are dealt anew; the scan above them keeps its tasks."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("good words "), F.col("id").cast("string")).alias("text"),
                                   F.lit("en").alias("lang")).repartition(9)
    rows = language.counts(docs.where("lang IS NOT NULL").select("text", "lang").repartition(32))
    assert "Coalesce" not in rows._jdf.queryExecution().executedPlan().toString()
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    twice = docs.unionByName(docs.where("doc_id < 50")).select("doc_id", "text")
    model = toxicity.train(twice.withColumnRenamed("doc_id", "id"), labels.select(F.col("doc_id").alias("id"), F.col("toxic").alias("label")))
    assert model["base"] == 0.5


def test_text_ids_in_crossing_cells(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CELL", 3)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for g in range(6):
        own = base[:30] + [f"g{g}x{i}" for i in range(40)]
        rows += [(f"d{g}{k}", " ".join([*own[:k], f"new{g}{k}", *own[k + 1:]])) for k in range(5)]
    rng.shuffle(rows)
    as_text = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string"), shingle=3).collect()
    number = {name: i for i, name in enumerate(sorted(n for n, _ in rows))}
    as_number = minhash.near_duplicates(spark.createDataFrame([(number[n], t) for n, t in rows], "doc_id bigint, text string"), shingle=3).collect()
    assert {(number[r["id"]], number[r["component_id"]], r["kept"]) for r in as_text} == {(r["id"], r["component_id"], r["kept"]) for r in as_number}
    kept = minhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id string, text string"), shingle=3)
    assert kept.count() == sum(r["kept"] for r in as_text)


def test_pipeline_with_clashing_columns_nulls_and_empty_tables(spark):
    import os

    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no tables")
    docs = corpus_pipeline.table(corpus_pipeline.prepared(spark), folder, "documents")
    empty = docs.limit(0)
    names = ("score", "predicted", "n_lines", "n_words", "contaminated", "row", "id", "held", "kept_text", "key")
    docs = docs.withColumns({c: F.lit("mine") for c in names})
    docs = docs.unionByName(docs.where("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit(None).cast("string")))
    for name, stage in corpus_pipeline.STAGES:
        was, docs, empty = docs, *(corpus_pipeline.stored(stage(spark, x, folder), name) for x in (docs, empty))
        assert empty.count() == 0 and docs.count() > 0
        if name != "packing":
            assert docs.columns == was.columns
            assert all(r[c] == "mine" for r in docs.select(*names).distinct().collect() for c in names)
            assert docs.where("doc_id IS NULL").count() == 1


def test_host_rates_are_shrunk_by_a_beta_prior(spark):
    """Rates of the short-text rule against the method of moments, written out."""
    from freshet.llm import quality

    rng = random.Random(6)
    sizes = {"a": 60, "b": 40, "c": 3, "d": 1, None: 20}
    bad = {"a": 0.1, "b": 0.95, "c": 1.0, "d": 1.0, None: 0.3}
    rows = []
    for host, n in sizes.items():
        for _ in range(n):
            words = 5 if rng.random() < bad[host] else 60
            rows.append((len(rows), host, " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(words))))
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id bigint, source string, text string").repartition(3)).collect()
    failures = {h: sum(len(t.split()) < 50 for _, s, t in rows if s == h) for h in sizes}
    total, all_failed = sum(sizes.values()), sum(failures.values())
    mean = all_failed / total
    spread = sum(f * f / sizes[h] for h, f in failures.items()) / total - mean ** 2 - mean * (1 - mean) * len(sizes) / total
    weight = min(max(mean * (1 - mean) / spread - 1, 1.0), total)
    rates = {h: (failures[h] + mean * weight) / (sizes[h] + weight) for h in sizes}
    for r in got:
        assert abs(r["host_rate"] - rates[r["source"]]) < 1e-9
        assert r["host_rejected"] == (rates[r["source"]] > 0.5) and r["kept"] == (not r["base_failed"] and not r["host_rejected"])
    assert rates["d"] < 1.0  # one document does not make a rate of one
