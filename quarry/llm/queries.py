"""The queries of this subpackage over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir
from .decontam import contamination
from .html import main_text
from .langid import languages
from .license import licenses
from .minhash import near_duplicates
from .mixing import mix
from .phrases import collocations
from .quality import quality
from .search import search
from .substring import remove_repeats_in_batches
from .toxicity import toxicity
from .trie import ends_digest, numbered, prefix_trie, rebuilt
from .urlfilter import url_verdicts

#: Production rules: host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
TOP_K = 10
#: Batches in which substring dedup takes the documents into its index.
BATCHES = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark, sf_dir):
    out = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op2_url_filters(spark, sf_dir):
    return url_verdicts(table(spark, sf_dir, "pages"), URL_RULES)


def op3_language_id(spark, sf_dir):
    return languages(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark, sf_dir):
    digest = ("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
    return remove_repeats_in_batches(table(spark, sf_dir, "documents").select("doc_id", "text"), f"{shared_dir(spark)}/substring-{uuid.uuid4().hex}", BATCHES, columns=digest)


def op5_license_scan(spark, sf_dir):
    out = licenses(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", F.size("matches").cast("long").alias("n_licenses"), F.array_join(F.transform("matches", lambda m: m["license"]), ",").alias("licenses"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)).alias("containment"),
    )


def op6_html_extraction(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages"))


def op7_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op8_minhash_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("source")


def op10_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search(docs, docs.where(F.col("doc_id") % 50 == 0), TOP_K)


def op11_prefix_trie(spark, sf_dir):
    turns = numbered(table(spark, sf_dir, "conversations"))
    nodes, ends = prefix_trie(rebuilt(turns), turns)
    none = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # SHA-256 of nothing
    out = nodes.join(ends_digest(ends), "node", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def op12_quality(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op13_phrases(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_url_filters, op3_language_id, op4_substring_dedup, op5_license_scan, op6_html_extraction, op7_toxicity, op8_minhash_dedup, op9_mixing, op10_search, op11_prefix_trie, op12_quality, op13_phrases, pipeline)}

_RULE_CASE = "CASE " + " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for h, p, _ in sorted(URL_RULES, key=lambda r: -len(r[0] + r[1]))
) + " END"
_VERDICT_CASE = "CASE " + " ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for h, p, v in URL_RULES) + " ELSE 'allow' END"

ORACLE = {
    "op2_url_filters": f"""
WITH p AS (SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r AS (SELECT *, {_RULE_CASE} AS rule FROM p)
SELECT page_id, host, path, rule, {_VERDICT_CASE} AS verdict FROM r""",
    "op8_minhash_dedup": """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, w, least(len(w), 5) AS n, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + n - 1], ' ') AS t FROM g),
z AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.t = y.t AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN z u ON u.doc_id = a JOIN z v ON v.doc_id = b WHERE 100 * shared >= 75 * (u.size + v.size - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS reached FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached),
c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(z.size, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM d JOIN c USING (doc_id) LEFT JOIN z USING (doc_id)""",
    "op9_mixing": """
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '/' || text, '')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rnk FROM s),
w AS (SELECT *, CAST([3.0, 1.0, 2.0][rnk % 3 + 1] AS DOUBLE) AS weight, CAST([-0.5, 0.0, 0.5][rnk % 3 + 1] AS DOUBLE) AS ramp,
    CAST(source_size AS DOUBLE) * CAST(2 AS DOUBLE) AS lim, CAST(sum(source_size) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE) AS goal FROM r),
l AS (SELECT *, (goal - coalesce(sum(lim) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level FROM w
    WINDOW b AS (ORDER BY lim / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, lim / weight <= level AS filled FROM l),
x AS (SELECT *, (SELECT level FROM f WHERE NOT filled ORDER BY lim / weight, rnk LIMIT 1) AS shared FROM f),
t AS (SELECT source, source_size, ramp, CASE WHEN filled THEN lim ELSE weight * shared END AS target FROM x),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.ramp,
    CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - d.size AS pos,
    CAST(floor(t.target + 0.5) AS BIGINT) AS goal FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, greatest(0, least(size, goal - pos)) AS one, greatest(0, least(size, goal - source_size - pos)) AS two FROM c)
SELECT doc_id, size, source_size, target, CAST(one + two AS BIGINT) AS taken,
    CASE WHEN one > 0 THEN 2 * (pos / target) / ((1 - ramp) + sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * (pos / target))) END AS position,
    CASE WHEN two > 0 THEN 2 * ((pos + source_size) / target) / ((1 - ramp) + sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * ((pos + source_size) / target))) END AS position2
FROM e""",
    "op4_substring_dedup": """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
h AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS t FROM g),
m AS (SELECT t, min(doc_id) AS first_doc FROM h GROUP BY t),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM h JOIN m USING (t) WHERE first_doc < doc_id),
r AS (SELECT doc_id, list(p) AS gone, count(*) AS n FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed,
    sha256(array_to_string(CASE WHEN r.n IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda k: NOT list_contains(gone, k)), lambda k: w[k]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN r ON d.doc_id = r.doc_id""",
    "op1_decontamination": """
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM benchmark),
bw AS (SELECT item, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i, w FROM b WHERE len(w) > 0 AND item IS NOT NULL),
t AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM bw),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents),
n AS (SELECT DISTINCT n FROM t),
g AS (SELECT doc_id, n.n, unnest(range(1, len(w) - n.n + 2)) AS i, w FROM d JOIN n ON len(w) >= n.n),
h AS (SELECT g.doc_id, g.i, t.n, t.item FROM g JOIN t ON t.n = g.n AND t.t = array_to_string(g.w[g.i:g.i + g.n - 1], ' ')),
c AS (SELECT doc_id, count(DISTINCT p) AS k FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
e AS (SELECT doc_id, string_agg(item, ',' ORDER BY item) AS items, count(*) AS k FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(c.k, 0) AS BIGINT) AS n_hit, CAST(coalesce(e.k, 0) AS BIGINT) AS n_items, sha256(coalesce(e.items, '')) AS items_sha256,
    coalesce(c.k, 0) > 0 AND 20 * coalesce(c.k, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN e ON e.doc_id = d.doc_id""",
    "op13_phrases": """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w WHERE len(w) > 0),
s AS (SELECT lang, k, w[i:i + k - 1] AS w FROM g, range(1, 6) AS t(k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, w, count(*) AS f FROM s GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, w, f AS a FROM f WHERE k >= 2 AND f >= 100),
x AS (SELECT c.lang, c.w, c.a, c.k, n.n, unnest(range(1, c.k)) AS j FROM c JOIN n USING (lang)),
y AS (SELECT x.lang, x.w, x.a, x.n, x.j, l.f AS l, r.f AS r, (1000::HUGEINT * x.a * x.n) // (l.f::HUGEINT * r.f) AS score
    FROM x JOIN f l ON l.lang = x.lang AND l.w = x.w[1:x.j] JOIN f r ON r.lang = x.lang AND r.w = x.w[x.j + 1:x.k]),
b AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, j) = 1),
z AS (SELECT DISTINCT lang, w[i:i + m - 1] AS w, a AS longer FROM c, range(1, 5) AS t(i), range(2, 5) AS u(m) WHERE m < k AND i + m - 1 <= k),
d AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM z WHERE z.lang = b.lang AND z.w = b.w AND 100 * z.longer >= 100 * b.a)),
o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(w, ' ')) AS rank, array_to_string(w, ' ') AS phrase, a, l, r, n, score::BIGINT AS score FROM d)
SELECT lang, rank, phrase, a, l, r, n, score FROM o WHERE rank <= 2000""",
    "op11_prefix_trie": """
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda a, b: xor(a >> 1, CASE WHEN a % 2 = 1 THEN 3988292384 ELSE 0 END))) AS tab),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role, sha256(strlen(role) || ':' || role || text)) AS w FROM t GROUP BY conv_id),
h AS (SELECT conv_id, w, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: ascii(c))), lambda a, b: xor(a >> 8, tab[xor(a, b) % 256 + 1])), 4294967295) % 9 AS h FROM o, crc),
r AS (SELECT h.conv_id, list_concat(coalesce(b.w[1:h.h], []), h.w[h.h + 1:]) AS w FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, unnest(range(len(w) + 1)) AS d, w FROM r),
m AS (SELECT w[1:d] AS n, d, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CASE WHEN len(w) = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ends FROM p GROUP BY ALL),
k AS (SELECT n[1:d - 1] AS n, count(*) AS n_children FROM m WHERE d > 0 GROUP BY 1),
v AS (SELECT m.*, coalesce(k.n_children, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (m.n_convs - 1) * strlen(m.n[m.d].t) END AS saved FROM m LEFT JOIN k ON k.n = m.n),
a AS (SELECT n, d, unnest(range(d + 1)) AS e, n_children, saved FROM v),
s AS (SELECT n[1:e] AS n, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM a GROUP BY 1)
SELECT v.conv_id, v.d AS depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM v JOIN s ON s.n = v.n LEFT JOIN m u ON v.d > 0 AND u.n = v.n[1:v.d - 1]""",
}
