"""Registered queries of the corpus operators, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changerisk.llm import (
    alignment,
    ctph,
    gumbel,
    hilbert,
    langid,
    linededup,
    media,
    mixing,
    negatives,
    quality,
    simhash,
    toxicity,
    urlfilter,
)
from changerisk.llm.columns import held_out
from changerisk.llm.shipping import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_simhash_near_duplicates")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose fingerprints differ in two bits at most."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, distance=2)
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"),
                        "component_id")


@query("op2_language_id")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by the profiles of those not held out."""
    return langid.train_and_identify(table(spark, sf_dir, "documents"), held_out(F.col("doc_id")))


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w,
         row_number() OVER (ORDER BY source NULLS LAST) AS nth
  FROM d GROUP BY source),
r AS (
  SELECT *, CAST(3 * source_size AS DOUBLE) AS bound, CAST(3 * source_size AS DOUBLE) / w AS ratio
  FROM s),
l AS (
  SELECT *, row_number() OVER (ORDER BY ratio, nth) AS place,
         (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(bound) OVER (
            ORDER BY ratio, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(w) OVER () - coalesce(sum(w) OVER (
            ORDER BY ratio, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM r),
lv AS (SELECT arg_min(level, place) AS level FROM l WHERE ratio >= level),
t AS (
  SELECT source, source_size,
         CASE WHEN ratio < lv.level THEN bound ELSE w * lv.level END AS target
  FROM l, lv),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT)
              ELSE 0 END AS e,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CAST(floor(target) AS BIGINT) - e * source_size AS rest FROM p)
SELECT doc_id, size, source_size, target,
       e * size + greatest(0, least(size, rest - before)) AS taken,
       e + CASE WHEN before < rest THEN 1 ELSE 0 END AS passes
FROM q
"""


@query("op3_mix_sources", MIX_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document; sources weigh 1, 2, 3 in turn."""
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(1, 2, 3), most=3)


URL_RULES = [
    urlfilter.Rule(True, "com", "/en/"), urlfilter.Rule(False, "example.com", "/en/7"),
    urlfilter.Rule(False, "net", "/de/"), urlfilter.Rule(True, "example.net", "/de/8"),
    urlfilter.Rule(True, "org", "/es/"),
]

URL_SQL = r"""
WITH RECURSIVE u AS (
  SELECT page_id, url, html,
         translate(CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)
              ELSE '' END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1)
              ELSE '' END AS path,
         regexp_replace(regexp_replace(regexp_extract(
           coalesce(url, ''), '(?s)^.*?://[^/?#]*[^?#]*\?([^#]*)', 1),
           '(^|&)(utm_[a-z]+|ref|gclid|fbclid)=[^&]*', '', 'g'), '^&+', '') AS asked
  FROM pages),
rules(block, rhost, rpath) AS (VALUES
  (true, 'com', '/en/'), (false, 'example.com', '/en/7'), (false, 'net', '/de/'),
  (true, 'example.net', '/de/8'), (true, 'org', '/es/')),
n AS (
  SELECT *, host || regexp_replace(path, '/+$', '')
         || CASE WHEN asked <> '' THEN '?' || asked ELSE '' END AS node FROM u),
own AS (
  SELECT page_id, url, host, path, node, arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
         arg_max(block, length(rhost || rpath)) AS block
  FROM n LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost))
                        AND starts_with(path, rpath)
  GROUP BY ALL),
tags AS (
  SELECT host, node, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\s[^>]*>')) AS tag FROM n),
targets AS (
  SELECT host, node AS a, CASE
    WHEN regexp_matches(tag, '(?is)[\s"''/]rel\s*=\s*["'']?[^"''>]*canonical')
      THEN regexp_extract(tag, '(?is)[\s"''/]href\s*=\s*["'']?([^\s"''>]+)', 1)
    WHEN regexp_matches(tag, '(?is)[\s"''/]http-equiv\s*=\s*["'']?refresh')
      THEN regexp_extract(tag, '(?is)url\s*=\s*["'']?([^''"\s>]+)', 1) END AS t
  FROM tags),
full_targets AS (
  SELECT a, CASE WHEN t LIKE '%://%' THEN t WHEN t LIKE '//%' THEN 'http:' || t
                 WHEN t LIKE '/%' THEN 'http://' || host || t END AS t FROM targets WHERE t <> ''),
edges AS (
  SELECT DISTINCT a, lower(regexp_extract(t, '(?s)^.*?://([^/?#]*)', 1))
         || regexp_replace(regexp_extract(t, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '/+$', '') AS b
  FROM full_targets WHERE a <> '' AND t IS NOT NULL),
both_ways AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
reach(a, b) AS (
  SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
-- a node counts with the longest rule that fits it; its alias decides where no rule does
judged AS (
  SELECT r.a, bool_and(o.block) AS blocked
  FROM (SELECT a, b FROM reach UNION SELECT a, a FROM reach) r
  JOIN (SELECT DISTINCT node, block FROM own WHERE block IS NOT NULL) o ON o.node = r.b
  GROUP BY r.a)
SELECT page_id, host, path, rule,
       CASE WHEN coalesce(block, blocked, false) THEN 'block' ELSE 'allow' END AS verdict
FROM own LEFT JOIN judged ON judged.a = own.node
"""


@query("op4_url_filter", URL_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url, by rules and by the aliases that its html names."""
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES, keep=["page_id"])


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a grammar learned from labelled ones not held out."""
    docs = table(spark, sf_dir, "documents")
    grammar = toxicity.train(docs, table(spark, sf_dir, "labels"), held_out(F.col("doc_id")))
    return (toxicity.score(docs.select("doc_id", "text"), grammar)
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted",
                    F.size("clauses").alias("n_clauses")))


@query("op6_piecewise_hashes")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are."""
    return ctph.fingerprint_and_edit(table(spark, sf_dir, "documents"))


@query("op7_media_columns")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a grey map, read back, reduced and hashed."""
    found = media.media_features(media.text_images(table(spark, sf_dir, "documents")))
    return found.select(
        F.col("key").alias("doc_id"), "n_bytes", F.col("samples").alias("payload_bytes"),
        F.col("samples_sha256").alias("payload_sha256"), "tail_crc32", "media_bytes",
        "media_sha256", "feature", F.sha2("tile", 256).alias("tile_sha256"))


@query("op8_hilbert_shards")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of equal counts along a curve over language, source and size."""
    docs = table(spark, sf_dir, "documents")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    sharded = hilbert.shard(
        docs, {"lang": hilbert.category(F.col("lang"), 5),
               "source": hilbert.category(F.col("source"), 5), "size": hilbert.octave(size)},
        24, bits=5, tie=[F.col("doc_id"), crc.alias("crc")],
        carry=[F.col("doc_id"), size.alias("size"), crc.alias("text_crc32")])
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                          "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


LINES_SQL = r"""
WITH l AS (
  SELECT doc_id, s.pos, s.line, regexp_extract_all(s.line, '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)),
               lambda x, i: {'line': x, 'pos': i})) AS s FROM documents)),
o AS (SELECT *, row_number() OVER (ORDER BY doc_id, pos) AS rn FROM l),
c AS (SELECT line, any_value(w) AS w, min(rn) AS id FROM o WHERE len(w) > 0 GROUP BY line),
t AS (
  SELECT DISTINCT id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS sh
  FROM c),
n AS (SELECT id, count(*) AS n FROM t GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS overlap
      FROM t a JOIN t b ON a.sh = b.sh AND a.id < b.id GROUP BY ALL),
near AS (SELECT DISTINCT p.b AS id FROM p JOIN n x ON x.id = p.a JOIN n y ON y.id = p.b
         WHERE 9 * p.overlap >= 4 * (x.n + y.n)),
f AS (
  SELECT o.doc_id, o.pos, o.line, len(o.w) = 0 AS blank, o.rn = c.id AS is_first,
         near.id IS NOT NULL AS is_near
  FROM o LEFT JOIN c ON c.line = o.line LEFT JOIN near ON near.id = o.rn)
SELECT doc_id, count(*) AS n_lines,
       count(*) FILTER (blank OR (is_first AND NOT is_near)) AS n_kept,
       count(*) FILTER (NOT blank AND NOT is_first) AS n_equal,
       count(*) FILTER (NOT blank AND is_first AND is_near) AS n_similar,
       md5(coalesce(string_agg(line, chr(10) ORDER BY pos)
           FILTER (blank OR (is_first AND NOT is_near)), '')) AS text_md5
FROM f GROUP BY doc_id
"""


@query("op9_line_dedup", LINES_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document when later matches of its lines are removed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.remove_lines(docs).select(
        "doc_id", "n_lines", "n_kept", "n_equal", "n_similar",
        F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("op10_sampled_segmentations")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three distinct segmentations of every document, drawn without replacement and decoded."""
    docs = table(spark, sf_dir, "documents")
    vocabulary = gumbel.Vocabulary.load(gumbel.MODEL)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    encoded = gumbel.encode(docs.select("doc_id", "text", crc.alias("text_crc32")), vocabulary,
                            keep=["doc_id", "text_crc32"], k=3)
    return gumbel.decode(encoded, vocabulary).select(
        "doc_id", "sample", F.size("ids").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"),
        "log_prob", "perturbed", "inclusion",
        (F.crc32(F.col("decoded").cast("binary")) == F.col("text_crc32")).alias("round_trip"))


@query("op11_token_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of a byte-level and a piece vocabulary align in every document."""
    return alignment.aligned_counts(
        table(spark, sf_dir, "documents"), alignment.ByteBpe.load(alignment.BYTE_BPE),
        alignment.PieceModel.load(alignment.PIECES), keep=["doc_id"])


@query("op12_quality")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by a regression learned from labelled ones not held out."""
    return quality.train_and_score(table(spark, sf_dir, "documents"),
                                   table(spark, sf_dir, "labels"), held_out(F.col("doc_id")))


NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id,
         CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT * FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)
            AS INTEGER) AS rank,
       n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same
               AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10
"""


@query("op13_hard_negatives", NEGATIVES_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives of every hundredth vector, between 0.3 and 0.9 times a positive's score."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = negatives.whole_vectors(table(spark, sf_dir, "embeddings"), key="vec_id",
                                      vector="embedding", label=label)
    return negatives.mine(vectors, F.col("id") % 100 == 0)
