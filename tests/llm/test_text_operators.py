"""The text operators against brute force, round trips and hard cases on small tables."""

import gzip
import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from check import TABLES, normal
from freshet.llm import circulant, components, decontaminate, language, licences, line_dedup, minhash, packing, quality
from freshet.llm import queries, toxicity, warc, wrappers

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_words string, row string"
HARD = [(1, None, "en", "a", "x", "y"), (2, "", None, "a", None, None), (3, "one two", "en", None, "x", None),
        (3, "one two", "en", None, "x", None), (None, "one two three four five six", None, None, None, None),
        (4, " \n\t\r\n ", "de", "b", "x", "y"), (5, "word " * 30_000 + "\nEnd", "de", "b", "x", "y")]


@pytest.fixture(scope="module")
def hard(spark):
    queries.prepared(spark)
    return spark.createDataFrame(HARD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    mine = sorted(tuple(normal(r[c]) for c in columns) for r in df.collect())
    cur = con.execute(queries.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == columns
    assert mine == sorted(tuple(normal(r[names.index(c)]) for c in columns) for r in cur.fetchall())


# Packing


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(1)
    sizes = [rng.choice([rng.randint(1, 2048), rng.randint(1, 300), 2048]) for _ in range(9000)]
    pieces = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "doc_id bigint, length bigint")
    rows = packing.pack(pieces, group=1000).collect()
    assert sorted((r.doc_id, r.length) for r in rows) == list(enumerate(sizes))
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(bins) <= -(-sum(sizes) // 2048) + 2


def test_local_search_raises_squared_fill_and_empties_bins():
    lengths = np.array([6, 3, 5, 4, 2, 7, 1, 2])
    start = [[0, 1], [2, 4], [5], [3], [6, 7]]
    done = packing.local_search([list(b) for b in start], lengths, 10)
    assert sorted(i for b in done for i in b) == list(range(8))
    fills = [int(lengths[b].sum()) for b in done]
    assert max(fills) <= 10 and len(done) < len(start)
    assert sum(f * f for f in fills) > sum(int(lengths[b].sum()) ** 2 for b in start)


def test_pieces_have_the_tokenizer_ids(spark, hard):
    import public_tokenizers
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    coder.encode_special_tokens = True
    texts = ["", "Ein Text, hübsch! 123\n\n  <|endoftext|> don't", "x" * 5000, "\u00a0\u2028 日本語 😀" * 700]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = packing.token_pieces(df, with_ids=True).collect()
    for i, text in enumerate(texts):
        ids = coder.encode(text, add_special_tokens=False).ids + [0]
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [x for r in mine for x in r.ids] == ids
        assert all(r.length == 2048 for r in mine[1:]) and mine[0].length == (len(ids) - 1) % 2048 + 1
        for r in mine:
            assert r.ids == ids[r.start:r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert packing.token_pieces(hard).where("doc_id = 3").count() == 2
    packed = packing.pack(packing.token_pieces(df, with_ids=True))
    assert sorted(len(r.ids) for r in packing.sequences(packed).collect())[-1] <= 2048


def test_packing_of_nothing(spark, empty):
    assert packing.pack(packing.token_pieces(empty)).count() == 0


# Pages


def page(paragraphs, extra="", head="h"):
    inner = "".join(f"<p>{p}</p>" for p in paragraphs)
    return (f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><ul><li><a>m</a></li><li><a>n</a></li></ul>"
            f"</nav><div class='ad'>buy</div><div class=\"cookie-notice\">ok?</div><article><h1>{head}</h1>{inner}</article>"
            f"{extra}<footer>&copy; x</footer></body></html>")


def test_main_text_of_pages(spark):
    comments = "<section class='comments'><p>first!</p></section><aside>more</aside><form><p>f</p></form>"
    rows = [(1, "https://a.org/1", page(["A &amp; B", "x  <b>y</b>z<br>w"])), (2, "https://a.org/2", page(["one"], comments)),
            (3, "https://a.org/3", page([], head="only")), (4, "https://b.org/", "<body><div>Hi<p>there<p>you</div><nav>no</nav>"),
            (5, None, None), (6, "https://a.org/1", ""), (7, "https://a.org/9", "<article><p>cut <script>if (a<b)</script>off")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: (r.text, r.n_chars) for r in wrappers.extract_main_text(df).collect()}
    want = {1: "h A & B x yz w", 2: "h one", 3: "only", 4: "Hi there you", 5: "", 6: "", 7: "cut off"}
    assert got == {k: (v, len(v)) for k, v in want.items()}
    assert wrappers.extract_main_text(df.limit(0)).count() == 0


def test_wrapper_inference_folds_runs_and_options():
    a = wrappers.tree_stream("<ul><li>1</li><li>2</li></ul><div>x</div>")
    b = wrappers.tree_stream("<ul><li>1</li></ul><h2>q</h2><div>y</div>")
    made = wrappers.align(a, b)
    assert made == [["<", "ul", [["+", ["<", "li", ["#"]]]]], ["?", ["<", "h2", ["#"]]], ["<", "div", ["#"]]]
    assert wrappers.slots(made) == {("ul", "li"), ("h2",), ("div",)}
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert len(wrappers.slots(wrappers.tree_stream(deep))) == 1


def test_repeated_texts_of_a_host_are_template(spark):
    def plain(i):
        return (f"<body><div class='x7'>we value you</div><div>own {i}<p>more {i}</p></div><article><p>read our rules</p>"
                f"<p>story {i}</p><p>end {i}</p></article></body>")

    rows = [(i, f"https://a.org/{i}", plain(i)) for i in range(30)]
    rows += [(100 + i, f"https://b.org/{i}", plain(i).replace("article", "section")) for i in range(30)]
    rows += [(200 + i, f"https://c.org/{i}", plain(7)) for i in range(3)]  # copies of a page are no sign of a template
    rows.append((300, "https://b.org/odd", "<body><div>odd</div></body>"))
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in wrappers.extract_main_text(df).collect()}
    for i in range(30):
        assert got[i] == f"story {i} end {i}"
        assert got[100 + i] == f"own {i} more {i} story {i} end {i}"
    assert {got[200 + i] for i in range(3)} == {"read our rules story 7 end 7"} and got[300] == "odd"
    only = spark.createDataFrame([("a.org", r[2]) for r in rows[:30]], "host string, html string")
    same = [wrappers.host_wrappers(only, group).collect()[0].rules for group in (2000, 7)]
    assert same[0] == same[1] and len(wrappers.json.loads(same[0])) == 2


def test_each_page_chooses_its_main_region(spark):
    rows = [(1, "https://a.org/1", page(["one"])), (2, "https://a.org/2", "<body><nav>m</nav><div>two<p>more</p></div></body>"),
            (3, "https://a.org/3", "<article><nav>n</nav></article><div>three</div>"),
            (4, None, "<div>shared</div><article>four</article>"), (5, "/x", "<div>shared</div><p>five</p>"),
            (6, "", "<div>shared</div><p>six</p>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in wrappers.extract_main_text(df).collect()}
    assert got == {1: "h one", 2: "two more", 3: "three", 4: "four", 5: "shared five", 6: "shared six"}


@pytest.mark.parametrize("html, want", [
    ("<html class='no-cookies'><body class='has-sidebar no-sidebar menu'><p>a</p></body></html>", "a"),
    ("<div class='page with-menu'><article>a</article></div>", "a"), ("<main class='with-sidebar'>a</main>b", "a"),
    ("<article class='promo-free promo'>a</article>b", "a"), ("<div class='site-footer'>f</div><p class='Footer x'>g</p>a", "a"),
    ("<div class='comment-list'>c</div><div id='main_nav'>n</div>a", "a"),
    ("<html><head><title>t</title><script>s</script><body><p>a</p>", "a"), ("<head><title>t</title><p>a</p><div>b</div>", "a b"),
    ("<head><meta charset=x> a", "a"), ("<head><noscript>n<body>a", "a"), ("<head><noscript>n</noscript></head>a", "a")])
def test_no_page_is_lost_by_names_or_an_open_head(html, want):
    assert " ".join(wrappers.main_texts(html, {})) == want


# Lines


def test_line_dedup_by_brute_force(spark, hard, empty):
    rng = random.Random(2)
    pool = [f" Line {i}\t" for i in range(12)] + ["", "  ", "É x", "é x", "LINE 3"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 6)))) for i in range(60)]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().lower()
    n = Counter(k for _, t in rows for k in {key(x) for x in t.split("\n")})
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), min_docs=15).collect()
    for r in got:
        lines = dict(rows)[r.doc_id].split("\n")
        kept = [x for x in lines if not key(x) or n[key(x)] < 15]
        assert (r.n_lines, r.n_dropped, r.kept_text) == (len(lines), len(lines) - len(kept), "\n".join(kept))
    assert line_dedup.line_dedup(hard, min_docs=2).count() == len(HARD)
    assert line_dedup.line_dedup(empty).count() == 0


# WARC


def test_archives_round_trip(spark, tmp_path):
    long = "x" * 150
    rows = [(5, "http://www.A.org/b?q", long), (2, "http://a.org/\r\nX: y", long), (9, None, long), (1, "http://b.org", "\r\n\r\nWARC/1.1\r\n\r\n"),
            (3, "http://b.org", "é" * 100 + "\r\n"), (4, "http://b.org", None), (6, "http://b.org", ""), (None, "http://c.org", long),
            (7, "x://[", "\r\n" * 80)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    folder = str(tmp_path / "warc")
    got = warc.capture_history(spark, df, folder=folder).collect()
    by = {r.page_id: r for r in got}
    for i, _, html in rows:
        raw = (html or "").encode()
        r = by["" if i is None else str(i)]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        again = html == long and i != 2
        assert (r.record_type, r.refers_to) == (("revisit", "2") if again else ("response", None))
    keys = [(r.url_key, r.captured, r.page_id) for r in sorted(got, key=lambda r: r.place)]
    assert keys == sorted(keys) and len(got) == len(rows)
    archives = [f for f in os.listdir(folder) if f.endswith(".gz")]
    assert b"".join(gzip.open(f"{folder}/{f}").read() for f in archives).count(b"WARC-Type:") == len(rows)
    assert warc.capture_history(spark, df.limit(0)).count() == 0


def test_loser_tree_merges():
    rng = random.Random(3)
    for k in range(9):
        runs = [sorted((rng.randint(0, 20), i) for i in range(rng.randint(0, 15))) for _ in range(k)]
        assert [x for x in warc.LoserTree(runs)] == sorted(x for run in runs for x in run)


# Language and toxicity


def test_language(spark, hard, empty):
    words = {"aa": ["lana", "bolo", "mira"], "bb": ["strunk", "wolfen", "kraft"]}
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(words[x]) + rng.choice(["", "s"]) for _ in range(20)), x) for i in range(80) for x in ["aa", "bb"][i % 2:][:1]]
    rows += [(100, "strunkfen wolkraft", None), (101, "123 !", "aa"), (102, None, "aa"), (103, "lanabolo", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in language.identify_language(df).collect()}
    assert all(got[i].lang_pred == x for i, _, x in rows[:80]) and all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (100, 101, 102, 103)] == ["bb", "und", "und", "aa"]
    assert language.identify_language(hard).count() == len(HARD)
    assert language.identify_language(hard, learn_from=F.lit(False)).where("lang_pred = 'und'").count() == len(HARD)
    assert language.identify_language(empty).count() == 0


def test_toxicity(spark, hard, empty):
    rng = random.Random(5)
    clean = ["tree", "river", "stone", "cloud", "meadow", "and", "the"]
    rows, labels = [], []
    for i in range(300):
        bad = i % 4 == 0
        rows.append((i, " ".join(rng.choice(clean) for _ in range(40)) + (" vilewort" if bad else "") + " the end"))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame([*rows, (500, None), (501, "the Vilewort stone"), (None, "river")], "doc_id bigint, text string")
    known = spark.createDataFrame([*labels, (500, None), (None, 1), (999, 1)], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, known, learn_from=F.col("doc_id") % 3 != 0).collect()}
    assert all(got[i].predicted == y for i, y in labels) and got[501].predicted == 1
    assert all(0 <= r.score <= 1 for r in got.values())
    assert toxicity.toxicity(hard, known).count() == len(HARD)
    assert {r.score for r in toxicity.toxicity(hard, known.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(empty, known).count() == 0


# Near-duplicates


def brute_components(rows, size, percent):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("cell", [256, 8])
def test_near_duplicates_by_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(minhash, "CELL", cell)
    rng = random.Random(6)
    word = lambda: f"w{rng.randint(0, 5000)}"
    rows = []
    for g in range(6):
        base = [word() for _ in range(rng.randint(60, 150))]
        for _ in range(25):  # chains of copies around the threshold
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = word()
            base = copy if rng.random() < 0.3 else base
            rows.append(" ".join(copy))
    passage = " ".join(word() for _ in range(60))
    rows += [passage + " " + " ".join(word() for _ in range(40)) for _ in range(40)]
    rows += ["", None, "a b", "A  b", "a b c", " ".join(word() for _ in range(200))] + rows[:10]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    got = {r.id: r for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle=4).collect()}
    want = brute_components(rows, 4, 80)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_near_duplicates_hard_cases(spark, hard, empty):
    got = minhash.near_duplicates(hard).collect()
    assert len(got) == len(HARD) and {r.component_id for r in got if r.id == 3} == {3}
    assert [(r.component_id, r.kept) for r in got if r.id is None] == [(None, True)]
    assert minhash.near_duplicates(empty).count() == 0
    kept = minhash.keep_one_of_each(spark.createDataFrame([(1, "x y z", "p"), (2, "x y z", "q")], "doc_id int, text string, id string"))
    assert [tuple(r) for r in kept.collect()] == [(1, "x y z", "p")]


def test_signature_estimates_similarity():
    rng = np.random.default_rng(7)
    a = np.unique(circulant.mix(rng.integers(0, 1 << 60, 500).astype(np.uint64)))
    b = np.concatenate([a[:400], circulant.mix(rng.integers(0, 1 << 60, 100).astype(np.uint64))])
    same = (circulant.signature(a, 336) == circulant.signature(b, 336)).mean()
    assert abs(same - 400 / 600) < 0.1


def test_word_hashes_do_not_depend_on_blocks(monkeypatch):
    text = (" Alpha\tbeta gamma\n" * 500 + "x" * 3000 + " END").encode()
    whole = circulant.word_hashes(text)
    monkeypatch.setattr(circulant, "BLOCK", 64)
    assert (circulant.word_hashes(text) == whole).all() and len(whole) == 1502
    assert whole[0] == circulant.word_hashes(b"alpha")[0]


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(90)] + [(200 + i, 201 + i) for i in range(40)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


# Licences


def test_licences(spark, hard, empty):
    rows = [(1, "x " * 30 + "Licensed under the Apache License, Version 2.0."), (2, "Released under the MIT License. mit license"),
            (3, "Licensed under CC BY-NC 4.0."), (4, "gnu general public licence"), (5, "the license by mit and cc"),
            (6, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"),
            (7, None), (8, "")]
    rows += [(i, "plain words of the text and by with under") for i in range(20, 80)]
    got = {r.doc_id: r for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    for i, text in rows:
        words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower().decode()) if w]
        at = [(k, y) for p, y in phrases.items() for k in range(len(words)) if words[k:k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(words), len(at))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r.base_labels == ",".join(sorted({y for _, y in at})) and set(r.base_labels.split(",")) <= {*r.labels.split(","), ""}
    assert [got[i].labels for i in (1, 2, 3, 4, 5, 6, 7)] == ["apache", "mit", "cc-by,cc-by-nc", "", "", "bsd", ""]
    assert licences.scan_licences(hard).count() == len(HARD) and licences.scan_licences(empty).count() == 0


def test_every_notice_is_found_however_common(spark):
    def brute(text):
        words, found = text.lower().replace("-", " ").replace(",", " ").replace(".", " ").split(), set()
        for label, key, notice in licences.NOTICES:
            key, notice = key.split(), notice.split()
            first = next(k for k in range(len(notice)) if notice[k:k + len(key)] == key)
            for at in range(len(words)):
                if words[at:at + len(key)] == key:
                    here = [at - first + k for k in range(len(notice))]
                    same = sum(0 <= i < len(words) and words[i] == w for i, w in zip(here, notice))
                    if same >= 0.5 * len(notice):
                        found.add(label)
        return found | {y for p, y in licences.PHRASES if p in " ".join(words)}

    texts = {label: notice for label, _, notice in licences.NOTICES}
    rows = [(i, f"file {i} " + texts[("bsd", "mpl", "cc-by-nc", "mit")[i % 4]]) for i in range(60)]
    several = " ".join(f"{n} end" for n in (t for _, _, t in licences.NOTICES))
    rows += [(100, several), (101, "compliance obtain except file copy " * 9 + texts["bsd"] + " then " + texts["mpl"])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in licences.scan_licences(docs).collect()}
    assert {i: set(r.labels.split(",")) for i, r in got.items()} == {i: brute(t) for i, t in rows}
    assert all(got[i].score == 1.0 for i in range(60)) and sum(x.share == 1.0 for x in got[100].places) == len(licences.NOTICES)
    few = {r.doc_id: r for r in licences.scan_licences(docs.where("doc_id in (0, 1, 100)")).collect()}
    assert all(few[i] == got[i] for i in (0, 1, 100))


# Decontamination


def test_decontamination_by_brute_force(spark, hard, empty):
    rng = random.Random(9)
    word = lambda: rng.choice("the of a".split()) if rng.random() < 0.4 else f"w{rng.randint(0, 60)}"
    items = [(i, [word() for _ in range(rng.choice([1, 5, 13, 14, 30]))]) for i in range(12)]
    docs = []
    for d in range(60):
        text = [word() for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 2)):
            _, own = rng.choice(items)
            at = rng.randint(0, len(text))
            cut = rng.randint(0, max(0, len(own) - 13))
            text[at:at] = own[cut:]
        docs.append((d, text))
    bench = spark.createDataFrame([(i, ", ".join(w).upper()) for i, w in items] + [(50, None), (51, "--")], "item_id int, text string")
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id int, text string")
    for r in decontaminate.decontaminate(frame, bench).collect():
        words = dict(docs)[r.doc_id]
        hit, named = set(), set()
        for i, own in items:
            n = min(13, len(own))
            wins = {tuple(own[k:k + n]) for k in range(len(own) - n + 1)}
            for k in range(len(words) - n + 1):
                if tuple(words[k:k + n]) in wins:
                    hit |= set(range(k, k + n))
                    named.add(str(i))
        digest = hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (len(words), len(hit), len(named), digest)
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(words))
    assert decontaminate.decontaminate(hard, bench).count() == len(HARD)
    assert decontaminate.decontaminate(hard, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminate(empty, bench).count() == 0


def test_proximity_by_brute_force(spark, hard):
    rng = random.Random(3)
    word = lambda: rng.choice("the of a".split()) if rng.random() < 0.4 else f"w{rng.randint(0, 90)}"
    items = [[word() for _ in range(n)] for n in (1, 2, 8, 13, 20, 40)]
    texts = []
    for d in range(60):
        own = list(rng.choice(items))
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(own) + 1)
            own[at:at + rng.randint(0, 1)] = [word()] * rng.randint(0, 2)
        texts.append([word() for _ in range(rng.randint(0, 30))] + own + [word() for _ in range(rng.randint(0, 30))])
    df = Counter(w for t in texts for w in t)

    def near(text: list[str], own: list[str]) -> bool:
        size = min(13, len(own))
        rare = {at for s in range(len(own) - size + 1) for at in sorted(range(s, s + size), key=lambda k: (df[own[k]], k))[:2]}
        bands = defaultdict(set)
        for at in rare:
            for p, w in enumerate(text):
                if w == own[at]:
                    bands[(p - at) // 5].add(at)
                    bands[(p - at) // 5 - 1].add(at)
        most = max((len(b) for b in bands.values()), default=0)
        return most >= 2 and 2 * most >= len(rare)

    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id int, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id int, text string")
    got = {r.doc_id: r.near_items for r in decontaminate.decontaminate(docs, bench).collect()}
    want = {d: [str(i) for i, own in enumerate(items) if near(t, own)] for d, t in enumerate(texts)}
    assert got == want and any(want.values()) and not all(want.values())
    assert "near_items" not in decontaminate.decontaminate(hard, bench, play=None).columns


def test_passage_changed_inside_every_window_is_near(spark):
    own = [f"t{k}" for k in range(60)]
    changed = [w for k, w in enumerate(own) for w in ([w, "and"] if k % 9 == 5 else [w])]
    docs = spark.createDataFrame([(1, " ".join(["x"] * 20 + changed)), (2, " ".join(own[::-1]))], "doc_id int, text string")
    bench = spark.createDataFrame([(7, " ".join(own))], "item_id int, text string")
    got = {r.doc_id: (r.n_hit, r.near_items) for r in decontaminate.decontaminate(docs, bench).collect()}
    assert got == {1: (0, ["7"]), 2: (0, [])}


def test_long_benchmark_item(spark):
    """An item of 100,000 words; one document holds 5,000 of them, one all, one repeats a single word."""
    rng = random.Random(5)
    own = [f"q{rng.randint(0, 3000)}" for _ in range(100_000)]
    docs = spark.createDataFrame([(1, " ".join(["x"] * 7 + own[40_000:45_000])), (2, " ".join(own)), (3, "q5 " * 20_000)],
                                 "doc_id int, text string")
    bench = spark.createDataFrame([(7, " ".join(own)), (8, "q5 " * 14)], "item_id int, text string")
    got = {r.doc_id: (r.n_hit, r.n_items) for r in decontaminate.decontaminate(docs, bench, play=None).collect()}
    assert got == {1: (5_000, 1), 2: (100_000, 1), 3: (20_000, 1)}


# Quality


def test_quality_by_brute_force(spark, hard, empty):
    rng = random.Random(10)
    texts = ["", None, "a b c a b c", "#x $y\n#x $y\n\n  \n#x $y"] + [" ".join(rng.choice("abcde") for _ in range(n)) for n in (3, 60, 80)]
    texts += [" ".join(f"w{rng.randint(0, 9999)}" for _ in range(70)) for _ in range(20)]
    rows = [(i, t, "bad" if i < 7 else "good") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    for i, t, _ in rows:
        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        n = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
        rep = {k + d for k in range(len(w) - 2) if n[tuple(w[k:k + 3])] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(rep))
        assert (r.n_symbols, r.n_dup_lines) == (len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 50 or 100 * len(rep) > 50 * len(w))
        assert not (r.kept and r.base_failed)
    assert all(got[i].kept for i in range(7, 27)) and all(got[i].host_rejected for i in range(7))
    assert quality.quality_rules(hard).count() == len(HARD) and quality.quality_rules(empty).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
def test_pipeline_runs_all_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    queries.prepared(spark)
    sizes = [docs.count()]
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, FOLDER)
        assert now.columns == docs.columns
        sizes.append(now.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    packed = corpus_pipeline.run(spark, FOLDER)
    assert packed.select("doc_id").distinct().count() == sizes[-1]
