"""Importance resampling, whitening and URL filters against brute force, with nulls, ties, repeats and empty tables."""

import fnmatch
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from freshet.llm.contour import count_above, eigenpairs_inside, interval_of_largest, largest_eigenpairs, tridiagonal
from freshet.llm.resampling import drawn_documents, resample, text_buckets
from freshet.llm.spans import BLOCK, CHUNK, span_crc32, words
from freshet.llm.url_filter import Automaton, GlobRule, HostRule, filter_urls
from freshet.llm.whitening import MOST_ENTRY, exact_products, whiten

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


# Checksums of spans


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=700), st.lists(st.tuples(st.integers(0, 700), st.integers(0, 700)), max_size=20))
def test_span_checksums(data, cuts):
    spans = [(min(a, len(data)), min(b, len(data))) for a, b in cuts]
    spans = [(min(s), abs(s[1] - s[0])) for s in spans]
    got = span_crc32(np.frombuffer(data, np.uint8), [s for s, _ in spans], [n for _, n in spans])
    assert got.tolist() == [zlib.crc32(data[s:s + n]) for s, n in spans]


def test_span_checksums_fold_long_spans():
    data = np.random.default_rng(3).integers(0, 256, 3 * CHUNK + 17).astype(np.uint8)
    lengths = [BLOCK - 1, BLOCK, BLOCK + 1, 2 * BLOCK, 5 * BLOCK + 3, CHUNK, CHUNK + 1, len(data) - 5, 0, 1]
    got = span_crc32(data, [5] * len(lengths), lengths)
    assert got.tolist() == [zlib.crc32(data[5:5 + n].tobytes()) for n in lengths]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aZ9 .\nüß漢", max_size=30)), max_size=12), st.integers(1, 3))
def test_features_of_texts(texts, most):
    n_words, n_features, found = text_buckets(pa.array(texts, pa.string()), 97, most)
    at = 0
    for text, words_here, features in zip(texts, n_words, n_features):
        own = plain_words(text)
        runs = [" ".join(own[i:i + k]) for k in range(1, most + 1) for i in range(len(own) - k + 1)]
        assert (words_here, features) == (len(own), len(runs))
        assert sorted(found[at:at + features]) == sorted(zlib.crc32(r.encode()) % 97 for r in runs)
        at += features


def test_words_of_a_slice_of_a_column():
    column = pa.array(["skip me", "one two", None, "three"]).slice(1)
    assert words(column)[3].tolist() == [2, 0, 1]


# Resampling


def brute_resample(docs, target, buckets, most, percent, least, seed):
    def features(text):
        own = plain_words(text)
        return len(own), [zlib.crc32(" ".join(own[i:i + k]).encode()) % buckets
                          for k in range(1, most + 1) for i in range(len(own) - k + 1)]

    s, t = np.zeros(buckets), np.zeros(buckets)
    parsed = [(i, *features(x)) for i, x in docs]
    for _, _, own in parsed:
        for b in own:
            s[b] += 1
    for x in target:
        for b in features(x)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets)))) for b in range(buckets)]
    out = []
    for i, n, own in parsed:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in own)
        out.append([i, n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    for rank, r in enumerate(able[:percent * len(able) // 100], 1):
        r[5] = rank
    return sorted(map(tuple, out), key=str)


def test_resampling_equals_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["alpha", "Beta", "gamma7", "straße", "delta", "漢字" * 40]
    texts = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 12)))) for i in range(120)]
    texts += [(500 + i, "alpha Beta gamma7 delta alpha") for i in range(40)] + [(600, None), (601, ""), (None, "delta " * 9)]
    target = ["alpha alpha beta", None, "delta zulu"]
    docs = spark.createDataFrame([(i, x, "s") for i, x in texts], "doc_id long, text string, score string").repartition(5)
    aims = spark.createDataFrame([(x,) for x in target], "text string")
    for most in (1, 2):
        got = resample(docs, aims, buckets=50, most_words=most, percent=30, min_words=3, seed=7)
        assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute_resample(texts, target, 50, most, 30, 3, 7)
    drawn = drawn_documents(docs, got)
    assert drawn.columns == docs.columns and drawn.count() == got.where("rank IS NOT NULL").count()


def test_resampling_of_repeated_rows_and_empty_tables(spark):
    aims = spark.createDataFrame([("a b c",)], "text string")
    same = spark.createDataFrame([(1, "a b c d")] * 300, "doc_id long, text string").repartition(4)
    got = resample(same, aims, min_words=4, percent=10)
    assert got.count() == 300
    assert sorted(r["rank"] for r in got.where("rank IS NOT NULL").collect()) == list(range(1, 31))
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample(none, aims).collect() == []
    assert {r["weight"] for r in resample(same, aims.limit(0)).collect()} != {0}


# Contour integration


def test_eigenpairs_of_many_spectra():
    rng = np.random.default_rng(2)
    for trial in range(24):
        size = int(rng.integers(1, 30))
        turn = np.linalg.qr(rng.standard_normal((size, size)))[0]
        spectrum = rng.uniform(0, 1, size) if trial % 3 else np.repeat(rng.uniform(1, 2, size), 3)[:size]  # clusters as well
        matrix = turn * spectrum @ turn.T
        matrix = (matrix + matrix.T) / 2
        values, vectors = largest_eigenpairs(matrix, 4)
        assert np.allclose(values, np.sort(spectrum)[::-1][:4], rtol=1e-11, atol=1e-13)
        assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)
        assert np.allclose(matrix @ vectors, vectors * values, atol=1e-13)
        for shift in rng.uniform(-0.5, 2.5, 5):
            assert count_above(tridiagonal(matrix), shift) == (spectrum > shift).sum()


def test_eigenpairs_of_a_nearly_even_spectrum():
    """Hardly any gap between the last component and the next one."""
    x = np.random.default_rng(7).standard_normal((40_000, 64))
    matrix = np.cov(np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True)).T, bias=True)
    for wanted in (1, 4, 11, 64):
        values, vectors = largest_eigenpairs(matrix, wanted)
        assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1][:wanted], rtol=1e-13)
        assert np.abs(matrix @ vectors - vectors * values).max() < 1e-13 * values[0] * 64


def test_inertia_counts_indefinite_pivots_and_missed_pairs_are_noticed():
    assert count_above(tridiagonal(np.array([[0.0, 1.0], [1.0, 0.0]])), 0.0) == 1
    assert count_above(tridiagonal(np.zeros((3, 3))), 0.0) == 0 and count_above(tridiagonal(np.zeros((3, 3))), -1.0) == 3
    matrix = np.diag([5.0, 4.0, 1.0, 0.5])
    low, high, count = interval_of_largest(matrix, 2)
    assert count == 2 and 1 < low < 4
    with pytest.raises(ArithmeticError):
        eigenpairs_inside(matrix, low, high, 3)  # the count says three, the interval holds two


# Whitening


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 45), st.integers(1, 9), st.integers(0, 2 ** 31))
def test_products_are_exact(bits, rows, seed):
    y = np.random.default_rng(seed).integers(-(1 << bits), (1 << bits) + 1, (rows, 3))
    whole = y.astype(object)
    assert (exact_products(y) == whole.T @ whole).all()


def brute_whiten(rows, components):
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [(i, tuple(math.floor(256 * c) for c in v)) for i, v in kept]
    distinct = np.array(sorted({v for _, v in x}), float)
    n, mean = len(distinct), distinct.mean(0)
    covariance = (distinct - mean).T @ (distinct - mean) / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    sums = [int(s) for s in distinct.sum(0)]
    out = {}
    for i, v in x:
        exact = sum((n * a - s) ** 2 for a, s in zip(v, sums))
        for c in range(len(values)):
            out[(i, c + 1)] = (n, exact, abs((np.array(v) - mean) @ vectors[:, c]) / math.sqrt(values[c]), values[c] / np.trace(covariance))
    return out


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(v)) for v in rng.standard_normal(6) * [3, 2, 1, 0.5, 0.2, 9]]) for i in range(150)]
    rows += [(1000 + i, rows[0][1]) for i in range(80)]  # one vector many times
    rows += [(2000, None), (2001, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (2002, [math.nan] + [0.0] * 5), (2003, [math.inf] + [0.0] * 5),
             (2004, []), (2005, [1.0, 2.0])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, whitened string").repartition(4)
    got = whiten(table, components=4).collect()
    want = brute_whiten([r for r in rows if r[0] != 2005], 4)
    assert len(got) == len(want) and {(r["vec_id"], r["component"]) for r in got} == set(want)
    for r in got:
        n, exact, projected, explained = want[(r["vec_id"], r["component"])]
        assert (r["n"], r["deviation"], int(r["deviation_exact"])) == (n, exact, exact)
        assert abs(abs(r["whitened"]) - projected) < 1e-9 and abs(r["explained"] - explained) < 1e-12
        assert r["identity_error"] < 1e-10
    first = {r["vec_id"]: r["whitened"] for r in got if r["component"] == 1}
    assert len({first[1000 + i] for i in range(80)} | {first[0]}) == 1


def test_whitening_without_variance_and_without_rows(spark):
    kinds = "vec_id long, embedding array<double>"
    assert whiten(spark.createDataFrame([(1, None), (2, [])], kinds)).collect() == []
    got = whiten(spark.createDataFrame([(None, [1.0, 2.0]), (2, [1.0, 2.0])], kinds)).collect()
    assert sorted((str(r["vec_id"]), r["component"]) for r in got) == [("2", 1), ("2", 2), ("None", 1), ("None", 2)]
    assert {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got} == {(1, 0, None, 0.0, None)}
    line = whiten(spark.createDataFrame([(i, [float(i), 0.0]) for i in range(4)], kinds)).collect()
    assert {(r["component"], r["whitened"] is None) for r in line} == {(1, False), (2, True)}


def test_whitening_of_large_entries(spark):
    kinds = "vec_id long, embedding array<double>"
    big = float(MOST_ENTRY // 1024)
    got = whiten(spark.createDataFrame([(i, [big * i, 1.0]) for i in range(3)], kinds), components=1).collect()
    exact = {r["vec_id"]: int(r["deviation_exact"]) for r in got}
    x = [math.floor(256 * big * i) for i in range(3)]
    assert exact == {i: (3 * x[i] - sum(x)) ** 2 for i in range(3)}
    assert all(r["deviation"] is None or r["deviation"] == exact[r["vec_id"]] for r in got)
    assert any(r["deviation"] is None for r in got)
    with pytest.raises(Exception, match="too large"):
        whiten(spark.createDataFrame([(1, [1e300])], kinds)).collect()


# URL filters


def brute_host_rule(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ab/.*?", max_size=12), min_size=1, max_size=30), st.lists(st.text(alphabet="ab/.", max_size=25), max_size=30))
def test_automaton_equals_glob_matching(globs, subjects):
    data = np.frombuffer("".join(subjects).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in subjects])]).astype(np.int64)
    got = Automaton([GlobRule("block", g) for g in globs]).run(data, offsets)
    assert got.tolist() == [[fnmatch.fnmatchcase(s, g) for g in globs] for s in subjects]


def test_url_filter_equals_brute_force(spark):
    rng = random.Random(8)
    rules = [HostRule("allow", "org", "/"), HostRule("block", "example.org", "/es/"), HostRule("block", "example.org", "/en/1"),
             HostRule("allow", "com", "/fr/"), HostRule("block", "com", "/de/"), HostRule("block", "b" * 70 + ".net", "/" + "x" * 70)]
    hosts = ["Example.org", "www.example.ORG", "notexample.org", "org", "a.com", "com", "b" * 70 + ".net", "x." + "b" * 70 + ".net",
             "example.org:80", "u@example.org", "", "ü.org", "a.com.evil"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12?x=/es/", "/en/#/es/", "/fr/a", "/de/", "/x.example.org/es/", "/" + "x" * 90,
             "/?://y.org/", "/login", "/a.zip", "/a.zip#b", "/q?sessionid=4", "\n/es/"]
    urls = [None, "", "example.org/es/", "://", "x://", "mailto:a@b.org", "http://a.com/" + "y" * 30_000 + "/login"]
    urls += [f"{rng.choice(['http', 'https', ''])}://{h}{p}" for h in hosts for p in paths]
    table = spark.createDataFrame([(i, u, i) for i, u in enumerate(urls)], "page_id int, url string, rule int").repartition(3)
    got = {r["page_id"]: r for r in filter_urls(table, rules).collect()}
    assert len(got) == len(urls) and "glob" in filter_urls(table, rules).columns
    for i, u in enumerate(urls):
        host, path, query = "", "", ""
        known = u is not None and "://" in u
        if known:
            host, path, query = re.match(r"([^/?#]*)([^?#]*)((?:\?[^#]*)?)", u.split("://", 1)[1]).groups()
            host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        best = brute_host_rule(host, path, rules) if known else None
        whole = f".{host}{path}{query}"
        blocked = known and (any(x in whole for x in ("/login", "/cart/", "/wp-admin/")) or whole.endswith((".exe", ".zip"))
                             or re.search("(?s).sessionid=", whole) is not None)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, best and best.text), u
        assert got[i]["verdict"] == (best.action if best else "block" if blocked else "allow"), u


def test_url_filter_without_rules_and_rows(spark):
    table = spark.createDataFrame([(1, "http://a.org/")] * 3, "page_id int, url string")
    got = filter_urls(table, [], [], default="block")
    assert [(r["rule"], r["verdict"]) for r in got.collect()] == [(None, "block")] * 3
    assert filter_urls(table.limit(0), [HostRule("allow", "org", "/")]).collect() == []
    tie = [HostRule("block", "a.org", "/"), HostRule("allow", "a.org", "/")]
    assert {r["verdict"] for r in filter_urls(table, tie).collect()} == {"block"}
