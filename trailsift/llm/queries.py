"""The queries of this subpackage over the driver tables, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailsift.llm import (
    byte_bpe,
    embedding_dedup,
    exact_dedup,
    hard_negatives,
    html_extract,
    language_id,
    license_scan,
    mixing,
    order_minhash,
    periodic_runs,
    secrets,
    sharding,
    suffix_dedup,
)
from trailsift.llm.common import Query, table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


@query(
    "op1_sharding",
    """
WITH RECURSIVE crc_step(n, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_step WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY n) AS entries FROM crc_step WHERE k = 8),
k AS (
  SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) + 16 AS size, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents
), c AS (
  SELECT *, 2 * sum(size) OVER w - size AS centre, row_number() OVER w AS n, sum(size) OVER () AS total
  FROM k WINDOW w AS (ORDER BY h, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING)
), s AS (SELECT *, CAST((centre * 40) // (2 * total) AS INTEGER) AS shard FROM c)
SELECT doc_id, CAST(size AS BIGINT) AS size,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda p: ('0x' || p)::BIGINT)),
    lambda a, b: xor(a >> 8, entries[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32,
  'bytes' AS law, shard, CAST(n - min(n) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s, crc_table
""",
)
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.place(table(spark, sf_dir, "documents"), 40)
    return placed.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "held_out", "lang_pred", "score")


@query("op3_order_minhash")
def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = order_minhash.report(table(spark, sf_dir, "documents"))
    kept = F.coalesce(F.col("id") == F.col("keep_id"), F.col("keep_id").isNull())
    return found.select(F.col("id").alias("doc_id"), F.col("keep_id").alias("group_id"), "group_size", kept.alias("kept"))


RANK_FILE = "byte_bpe_multi_50k.tiktoken"


@query("op4_byte_bpe")
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = byte_bpe.read_ranks(public_tokenizers.path(RANK_FILE))
    coded = byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, with_ids=False)
    return coded.withColumnRenamed("id", "doc_id")


@query(
    "op5_secret_scan",
    r"""
WITH kinds(kind, name, pattern, part, least) AS (VALUES
  (0, 'assign', '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 8),
  (1, 'access', 'AKIA[A-Z0-9]+', 0, 16), (2, 'hex', '[0-9a-f]+', 0, 32), (3, 'live', '[A-Za-z0-9+/_-]{24,}', 0, 24)
), texts AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repository FROM documents
), cut AS (
  SELECT doc_id, owner, repository, kind, least, string_split_regex(t, pattern) AS gaps, regexp_extract_all(t, pattern, 0) AS hits,
    CASE part WHEN 2 THEN regexp_extract_all(t, pattern, 2) ELSE regexp_extract_all(t, pattern, 0) END AS vals
  FROM texts, kinds
), places AS (
  SELECT *, list_transform(gaps, lambda x: length(x)) AS g, list_transform(hits, lambda x: length(x)) AS h, unnest(range(1, len(hits) + 1)) AS i FROM cut
), found AS (
  SELECT doc_id, owner, repository, kind, vals[i] AS val, CAST(list_sum(g[1:i]) + coalesce(list_sum(h[1:i - 1]), 0) AS BIGINT) AS a, h[i] AS size
  FROM places WHERE length(vals[i]) >= least
), spans AS (SELECT doc_id, owner, repository, kind, val, a, a + size AS b FROM found),
base AS (SELECT * FROM spans WHERE kind < 3),
tokens AS (
  SELECT * FROM spans s WHERE kind = 3 AND regexp_matches(val, '[a-z]') AND regexp_matches(val, '[A-Z]') AND regexp_matches(val, '[0-9]')
    AND len(list_distinct(string_split(val, ''))) >= 12
    AND NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = s.doc_id AND base.a < s.b AND s.a < base.b)
), both_kinds AS (SELECT * FROM base UNION ALL SELECT * FROM tokens),
counts AS (SELECT val, count(DISTINCT owner) AS n_owners, count(DISTINCT (owner, repository)) AS n_repositories FROM both_kinds GROUP BY val),
owners AS (SELECT *, n_owners > 3 OR (n_owners > 1 AND n_repositories > 8) AS copied FROM counts),
judged AS (SELECT b.*, copied, n_owners, n_repositories FROM both_kinds b JOIN owners USING (val)),
sums AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
    coalesce(string_agg(name || ':' || a || ':' || b, ',' ORDER BY a, kind) FILTER (WHERE kind < 3), '') AS base_text,
    coalesce(string_agg(name || ':' || a || ':' || b, ',' ORDER BY a, kind) FILTER (WHERE kind < 3 OR NOT copied), '') AS spans,
    CAST(count(*) FILTER (WHERE kind = 3 AND NOT copied) AS INTEGER) AS n_live, CAST(count(*) FILTER (WHERE kind < 3 AND copied) AS INTEGER) AS n_copied,
    max(n_owners) AS most_owners, max(n_repositories) AS most_repositories
  FROM judged JOIN kinds USING (kind) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base_text, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied,
  coalesce(most_owners, 0) AS most_owners, coalesce(most_repositories, 0) AS most_repositories
FROM texts LEFT JOIN sums USING (doc_id)
""",
)
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, F.col("source"), F.concat_ws("/", "source", "lang"))
    return found.select(
        F.col("id").alias("doc_id"), *(secrets.count_of(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")),
        F.sha2("base_text", 256).alias("base_sha256"), F.col("spans_text").alias("spans"), "n_live", "n_copied",
        *(F.coalesce(F.array_max(f"held.{kind}"), F.lit(0).cast("long")).alias(f"most_{kind}") for kind in ("owners", "repositories")),
    )


@query(
    "op6_exact_dedup",
    r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
), w AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
    first_value(doc_id) OVER g AS keep_id, row_number() OVER g AS n
  FROM d WINDOW g AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, n = 1 AS kept, text_sha256 FROM w
""",
)
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = exact_dedup.dedup_report(table(spark, sf_dir, "documents"))
    return report.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


# Domains of the label table, and the share of all tokens that each is to have.
TARGETS = {"good": 0.93, "poor": 0.06, "toxic": 0.01}
# Domains that are never thinned out for want of the others.
KEPT = ("good",)


def labelled_domains(labels: DataFrame) -> DataFrame:
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return labels.select("doc_id", domain.alias("domain"))


@query("op7_mixing")
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = mixing.report(table(spark, sf_dir, "documents"), labelled_domains(table(spark, sf_dir, "labels")), TARGETS, kept=KEPT)
    shares = [(F.col("steps")[k] / F.lit(float(mixing.STEPS))).alias(f"p_{name}") for k, name in enumerate(TARGETS)]
    return rated.select(F.col("id").alias("doc_id"), F.col("tokens").alias("n_tokens"), *shares, "rate", "copies")


@query("op8_embedding_dedup")
def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_dedup.dedup(table(spark, sf_dir, "embeddings"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", kept.alias("kept"))


@query("op10_html_extraction")
def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op9_suffix_dedup")
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def _values(rows: list[tuple[object, ...]]) -> str:
    plain = lambda v: str(v) if isinstance(v, int) else "'" + str(v) + "'"
    return ", ".join("(" + ", ".join(map(plain, row)) + ")" for row in rows)


def _template_words() -> str:
    index = license_scan.Index(license_scan.TEMPLATES, [])
    return _values([(t, label, q, w.decode()) for t, (label, text) in enumerate(zip(index.labels, index.texts, strict=True)) for q, w in enumerate(text)])


def _phrase_words(phrases: list[tuple[object, str]]) -> str:
    """(number, owner, place, word) of every word of the phrases."""
    return _values([(n, owner, q, w) for n, (owner, phrase) in enumerate(phrases) for q, w in enumerate(phrase.split())])


_KEYS = [(t, key) for t, template in enumerate(license_scan.TEMPLATES) for key in template.keys]
_BASE = [(label, phrase) for phrase, label in license_scan.PHRASES]


@query(
    "op11_license_scan",
    rf"""
WITH template_words(t, label, q, word) AS (VALUES {_template_words()}),
key_words(n, t, q, word) AS (VALUES {_phrase_words(_KEYS)}),
base_words(n, label, q, word) AS (VALUES {_phrase_words(_BASE)}),
texts AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), vocabulary AS (SELECT DISTINCT word FROM template_words UNION SELECT DISTINCT word FROM base_words),
places AS (SELECT rid, p - 1 AS p, word FROM (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM texts) SEMI JOIN vocabulary USING (word)),
holding AS (SELECT word, count(DISTINCT rid) AS n FROM places GROUP BY word),
weights AS (
  SELECT word, coalesce(n, 0) AS n, CAST(1 + floor(1000 * ln(((SELECT count(*) FROM texts) + 1) / (coalesce(n, 0) + 1))) AS BIGINT) AS weight
  FROM (SELECT DISTINCT word FROM template_words) LEFT JOIN holding USING (word)
), base AS (
  SELECT rid, label, p - q AS start FROM places JOIN base_words USING (word)
  GROUP BY rid, n, label, p - q HAVING count(*) = (SELECT count(*) FROM base_words b WHERE b.n = base_words.n)
), phrases AS (
  SELECT rid, n, t, p - q AS start FROM places JOIN key_words USING (word)
  GROUP BY rid, n, t, p - q HAVING count(*) = (SELECT count(*) FROM key_words k WHERE k.n = key_words.n)
), held AS (SELECT DISTINCT rid, t, word FROM (SELECT DISTINCT rid, word FROM places) JOIN template_words USING (word)),
rare AS (
  SELECT rid, t, word, least({license_scan.AGREE}, count(*) OVER (PARTITION BY rid, t)) AS agree FROM (
    SELECT rid, t, word, row_number() OVER (PARTITION BY rid, t ORDER BY n, word) AS k FROM held JOIN weights USING (word)
  ) WHERE k <= {license_scan.RARE}
), starts AS (
  SELECT rid, t, p - q AS start FROM rare JOIN places USING (rid, word) JOIN template_words USING (t, word)
  GROUP BY rid, t, p - q HAVING count(DISTINCT word) >= min(agree)
), lengths AS (SELECT t, label, count(*) AS m, sum(weight) AS total FROM template_words JOIN weights USING (word) GROUP BY t, label),
verified AS (
  SELECT s.rid, s.t, s.start, any_value(l.label) AS label, any_value(l.total) AS total
  FROM starts s JOIN lengths l USING (t) JOIN phrases f ON f.rid = s.rid AND f.t = s.t AND f.start BETWEEN s.start - {license_scan.SLACK} AND s.start + l.m + {license_scan.SLACK}
  GROUP BY s.rid, s.t, s.start HAVING count(DISTINCT f.n) = (SELECT count(DISTINCT k.n) FROM key_words k WHERE k.t = s.t)
), scored AS (
  SELECT v.rid, v.label, CAST(sum(weight) AS DOUBLE) / CAST(min(total) AS DOUBLE) AS score
  FROM verified v JOIN template_words tw USING (t) JOIN places p ON p.rid = v.rid AND p.p = v.start + tw.q AND p.word = tw.word JOIN weights w ON w.word = tw.word
  GROUP BY v.rid, v.t, v.start, v.label
), finds AS (SELECT rid, label, start, 1.0::DOUBLE AS score FROM base UNION ALL SELECT rid, label, NULL, score FROM scored),
sums AS (
  SELECT rid, count(start) AS n_base, min(start) AS first_word, max(start) AS last_word, max(score) AS score,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE start IS NOT NULL) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM finds GROUP BY rid
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM texts LEFT JOIN sums USING (rid)
""",
)
def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    starts, base = F.col("places.start"), F.array_distinct("places.label")
    every = F.array_sort(F.array_distinct(F.concat(F.col("places.label"), F.col("notices.label"))))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max("notices.score"), F.lit(0.0))).alias("score"),
    )


@query(
    "op12_hard_negatives",
    """
WITH u AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.rid AS anchor, a.vec_id AS anchor_id, b.rid, b.vec_id, a.label = b.label AS same,
    CAST(coalesce(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])), 0) AS BIGINT) AS score
  FROM u a JOIN u b ON a.rid <> b.rid AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0
), positives AS (SELECT * FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST, rid) <= 5),
hard AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.rid ORDER BY s.score DESC, s.vec_id NULLS LAST, s.rid) AS rank
  FROM positives p JOIN scores s ON s.anchor = p.anchor AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM hard WHERE rank <= 5
""",
)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """The contract's rows: where crc32 of the id ends in 0, the words from one place on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.size(words)
    a = F.pmod(g, n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
    turns = F.ceil((n - a) / p).cast("int")
    repeated = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), turns)), F.lit(1), n - a)
    return docs.withColumn("text", F.when((F.pmod(h, F.lit(10)) == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a), repeated), " ")).otherwise(F.col("text")))


@query(
    "op13_periodic_runs",
    r"""
WITH RECURSIVE crc_step(n, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_step WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY n) AS entries FROM crc_step WHERE k = 8),
texts AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
hashed AS (
  SELECT rid, ws, len(ws) AS n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
    lambda a, b: xor(a >> 8, entries[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM texts, crc_table
), planted AS (
  SELECT rid, ws, n, h % 10 = 0 AS moved, (h // 10) % n AS a, 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) AS p FROM hashed WHERE n > 0
), numbered AS (SELECT *, unnest(range(n)) AS i FROM planted),
words AS (SELECT rid, n, i, ws[1 + CASE WHEN moved AND i >= a THEN a + (i - a) % p ELSE i END] AS word FROM numbered),
grams AS (
  SELECT rid, n, i, concat_ws(' ', word, lead(word, 1) OVER w, lead(word, 2) OVER w, lead(word, 3) OVER w, lead(word, 4) OVER w) AS gram
  FROM words WINDOW w AS (PARTITION BY rid ORDER BY i) QUALIFY lead(word, 4) OVER w IS NOT NULL
), equal AS (
  SELECT f.rid, f.i, s.i - f.i AS q FROM grams f JOIN grams s ON s.rid = f.rid AND s.gram = f.gram AND s.i > f.i AND 4 * (s.i - f.i) <= f.n
), islands AS (
  SELECT rid, q, min(i) AS start, max(i) - min(i) + 5 + q AS length
  FROM (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM equal) GROUP BY rid, q, island
), periodic AS (SELECT * FROM islands WHERE length >= greatest(6, 4 * q)),
runs AS (
  SELECT * FROM periodic r WHERE NOT EXISTS (
    SELECT 1 FROM periodic s WHERE s.rid = r.rid AND s.q < r.q AND r.q % s.q = 0 AND s.start <= r.start AND s.start + s.length >= r.start + r.length)
), dropped AS (SELECT DISTINCT rid, unnest(range(start + q, start + length)) AS i FROM runs),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN dropped USING (rid, i) GROUP BY rid),
listed AS (
  SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines,
    first(struct_pack(s := start, l := length, q := q) ORDER BY length DESC, start, q) AS longest
  FROM runs GROUP BY rid
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, longest.s AS start, longest.l AS length, longest.q AS period,
  CAST(1000 * longest.l // longest.q AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM texts LEFT JOIN listed USING (rid) LEFT JOIN kept USING (rid)
""",
)
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(with_planted_periods(table(spark, sf_dir, "documents").select("doc_id", "text")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    length = -longest["less"]
    return found.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), longest["start"].alias("start"), length.alias("length"), longest["period"].alias("period"),
        F.floor(1000 * length / longest["period"]).alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
