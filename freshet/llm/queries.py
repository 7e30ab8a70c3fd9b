"""The queries of the text operators and their SQL texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from freshet.llm.common import table
from freshet.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Python workers get texts in batches of bounded bytes.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM_WORDS = (f"list_filter(regexp_split_to_array({LOWER.format('coalesce(text, chr(32))')}, "
               r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')")
SPACE_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ' '), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def prepared(spark: SparkSession) -> SparkSession:
    configure(spark)
    for key, value in BATCHES.items():
        spark.conf.set(key, value)
    return spark


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(prepared(spark), folder)

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


@query("op3_line_dedup", rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT *, {LOWER.format(r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")} AS key FROM lines),
hot AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(hot.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE hot.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN hot USING (key) GROUP BY doc_id""")
def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from freshet.llm.line_dedup import line_dedup

    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op9_decontaminate", rf"""
WITH d AS (SELECT doc_id, {ALNUM_WORDS} AS w FROM documents),
i AS (SELECT item_id, {ALNUM_WORDS} AS w FROM benchmark),
wins AS (SELECT item_id, unnest(list_transform(range(0, len(w) - least(13, len(w)) + 1),
           lambda s: array_to_string(w[s + 1 : s + least(13, len(w))], ' '))) AS win, least(13, len(w)) AS size
         FROM i WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM wins),
own AS (SELECT doc_id, size, unnest(range(0, len(w) - size + 1)) AS s,
          unnest(list_transform(range(0, len(w) - size + 1), lambda s: array_to_string(w[s + 1 : s + size], ' '))) AS win
        FROM d JOIN sizes ON len(w) >= size),
hits AS (SELECT doc_id, s, own.size, item_id FROM own JOIN wins ON own.win = wins.win AND own.size = wins.size),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM hits) GROUP BY 1),
names AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1),
numbered AS (SELECT row_number() OVER () AS k, item, w, len(w) AS n, least(13, len(w)) AS size
             FROM (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, w FROM i WHERE len(w) > 0)),
terms AS (SELECT k, size, unnest(range(0, n)) AS o, unnest(w) AS term FROM numbered),
starts AS (SELECT k, unnest(range(0, n - size + 1)) AS s FROM numbered),
own_words AS (SELECT doc_id, unnest(range(0, len(w))) AS p, unnest(w) AS term FROM d),
df AS (SELECT term, count(*) AS df FROM own_words GROUP BY 1),
ranked AS (SELECT k, o, term, row_number() OVER (PARTITION BY k, s ORDER BY coalesce(df, 0), o) AS r
           FROM terms JOIN starts USING (k) LEFT JOIN df USING (term) WHERE o >= s AND o < s + size),
places AS (SELECT DISTINCT k, o, term FROM ranked WHERE r <= 2),
rare AS (SELECT k, count(*) AS rare FROM places GROUP BY 1),
bands AS (SELECT doc_id, k, o, unnest([floor((p - o) / 5.0), floor((p - o) / 5.0) - 1]) AS band
          FROM own_words JOIN places USING (term)),
agreed AS (SELECT doc_id, k, band, count(DISTINCT o) AS c FROM bands GROUP BY 1, 2, 3),
near AS (SELECT doc_id, count(DISTINCT item) AS n_near FROM agreed JOIN rare USING (k) JOIN numbered USING (k)
         WHERE c >= 2 AND 2 * c >= rare GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN names USING (doc_id) LEFT JOIN near USING (doc_id)""")
def op9_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    from freshet.llm.decontaminate import RESULTS, decontaminate

    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, folder, "benchmark"))
    return found.select("doc_id", *RESULTS, F.size("near_items").cast("long").alias("n_near"))


@query("op10_quality_rules")
def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    from freshet.llm.quality import RESULTS, quality_rules

    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return quality_rules(docs).select("doc_id", *RESULTS)


@query("op7_minhash_dedup", rf"""
WITH RECURSIVE d AS (SELECT doc_id, {SPACE_WORDS.replace("coalesce(text, ' ')", LOWER.format("coalesce(text, ' ')"))} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(0, len(w) - 3), lambda i: array_to_string(w[i + 1 : i + 4], ' ')) END) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS node, doc_id AS seen FROM d UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.seen) AS component_id, d.doc_id = min(r.seen) AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.node = d.doc_id GROUP BY d.doc_id""")
def op7_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from freshet.llm.minhash import near_duplicates

    docs = table(spark, folder, "documents").select("doc_id", "text")
    return near_duplicates(docs, shingle=4).withColumnRenamed("id", "doc_id")


def fold(column: str, parts: int):
    return F.crc32(F.col(column).cast("string")) % parts


@query("op5_language")
def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    from freshet.llm.language import identify_language

    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    found = identify_language(docs, learn_from=fold("doc_id", 4) != 2)
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from freshet.llm.toxicity import toxicity

    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = toxicity(docs, table(spark, folder, "labels"), learn_from=fold("doc_id", 5) != 0)
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


@query("op1_packing")
def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    from freshet.llm.packing import pack, token_pieces

    return pack(token_pieces(table(spark, folder, "documents").select("doc_id", "text")))


@query("op2_html_text")
def op2_html_text(spark: SparkSession, folder: str) -> DataFrame:
    from freshet.llm.wrappers import extract_main_text

    return extract_main_text(table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


@query("op8_licences")
def op8_licences(spark: SparkSession, folder: str) -> DataFrame:
    from freshet.llm.licences import scan_licences

    return scan_licences(table(spark, folder, "documents").select("doc_id", "text")).drop("text", "places")


@query("op4_warc", """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND payload_bytes >= 100""")
def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    from freshet.llm.warc import capture_history

    pages = table(spark, folder, "pages")
    kind = pages.schema["page_id"].dataType
    found = capture_history(spark, pages)
    return found.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                        F.col("refers_to").cast(kind).alias("refers_to"))


@query("op11_resampling", rf"""
WITH table_ AS (SELECT list(v ORDER BY b) AS t FROM (
  SELECT b, list_reduce(range(0, 8), lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, b) AS v
  FROM (SELECT unnest(range(0, 256)) AS b))),
d AS (SELECT doc_id, {ALNUM_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, unnest(w) AS f FROM d),
bw AS (SELECT unnest(w) AS f FROM (SELECT {ALNUM_WORDS} AS w FROM benchmark)),
vocabulary AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM dw UNION SELECT f FROM bw)),
buckets AS (SELECT f, xor(4294967295, list_reduce(
    list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)),
    lambda r, x: xor(t[(xor(r, x) & 255) + 1], r >> 8), CAST(4294967295 AS BIGINT))) % 10000 AS bucket
  FROM vocabulary, table_),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN buckets USING (f) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN buckets USING (f) GROUP BY 1),
sums AS (SELECT (SELECT count(*) FROM dw) AS all_s, (SELECT count(*) FROM bw) AS all_t),
gains AS (SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * (all_s + 10000)
            / (CAST(s + 1 AS DOUBLE) * (all_t + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), sums),
weights AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM dw JOIN buckets USING (f) JOIN gains USING (bucket) GROUP BY 1),
scored AS (SELECT doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
    (CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE)))
    AS BIGINT) AS score FROM d LEFT JOIN weights USING (doc_id)),
places AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, 10 * count(*) OVER () // 100 AS drawn
           FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank
FROM scored LEFT JOIN places USING (doc_id)""")
def op11_resampling(spark: SparkSession, folder: str) -> DataFrame:
    from freshet.llm.resampling import resample

    docs = table(spark, folder, "documents").select("doc_id", "text")
    judged = resample(docs, table(spark, folder, "benchmark"), buckets=10_000, most_words=1, percent=10, min_words=20, seed=2024)
    return judged.select("doc_id", "n_features", "weight", "score", "rank")


@query("op12_whitening")
def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    from freshet.llm.whitening import whiten

    return whiten(table(spark, folder, "embeddings"), components=4)


#: Rules on hosts and paths of the url query.
HOST_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
              ("block", "com", "/de/"))
FITS = " UNION ALL ".join(
    f"SELECT '{h}{p}' AS rule, '{a}' AS action, {len(h + p)} AS size, '{h}' AS h, '{p}' AS p" for a, h, p in HOST_RULES)


@query("op13_url_filter", rf"""
WITH parts AS (SELECT page_id, regexp_extract(rest, '^([^/?#]*)', 1) AS raw_host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
                 regexp_extract(rest, '^[^?#]*((?:\?[^#]*)?)', 1) AS query, known
  FROM (SELECT page_id, coalesce(position('://' IN url) > 0, false) AS known,
          CASE WHEN known THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages)),
seen AS (SELECT *, {LOWER.format('raw_host')} AS host FROM parts),
rules AS ({FITS}),
best AS (SELECT page_id, arg_max(rule, size) AS rule, arg_max(action, size) AS action
         FROM seen JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY 1),
own AS (SELECT *, '.' || host || path || query AS u FROM seen)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN known AND (contains(u, '/login') OR contains(u, '/cart/')
  OR contains(u, '/wp-admin/') OR ends_with(u, '.exe') OR ends_with(u, '.zip') OR u LIKE '%_sessionid=%') THEN 'block' ELSE 'allow' END) AS verdict
FROM own LEFT JOIN best USING (page_id)""")
def op13_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    from freshet.llm.url_filter import HostRule, filter_urls

    pages = table(spark, folder, "pages").select("page_id", "url")
    return filter_urls(pages, [HostRule(*r) for r in HOST_RULES]).select("page_id", "host", "path", "rule", "verdict")
