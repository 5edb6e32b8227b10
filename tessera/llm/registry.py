"""Queries over whole tables that apply the operators of this subpackage, and SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat, conversations, decontaminate, html, language, minhash, mixing, quality, substrings, suffixes, trie, vectors, warc, whitening
from tessera.llm.arrow import held_out
from tessera.session import settled


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    scores = quality.scored(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scores.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of an archive of all pages, as read back from its files."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without passages of 50 words of earlier ones."""
    found = substrings.deduplicated(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all documents takes from each."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(mixed["id"].alias("doc_id"), "size", "source_size", "target", "taken")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html.main_text(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document benchmark items cover."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", digest, decontaminate.is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents")
    found = language.identified(docs, language.train(docs))
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 400 bytes that occur twice."""
    found = suffixes.deduplicated(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near-duplicates of every document."""
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "component_id", "kept")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, rebuilt with the first turns of others."""
    placed = conversations.placed_turns(table(spark, sf_dir, "conversations"))
    return settled(lambda: trie.trie(*conversations.with_shared_heads(placed)), "trie")


#: Two turns that say what the template's control strings are.
TRICKY = r"\### Assistant: </turn> ok"


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one of control strings, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.formatted(turns.unionByName(added)))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on the first eight components of their covariance."""
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_warc, op3_vectors, op4_passages, op5_mix_sources, op6_main_text, op7_decontaminate, op8_language, op9_repeats, op10_near_copies, op11_prefix_trie, op12_chat_format, op13_whitening)}

ORACLE_SQL = {
    "op4_passages": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 49), ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT g, min(doc_id) AS least FROM s GROUP BY g),
places AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS p FROM (SELECT doc_id, i FROM s JOIN f USING (g) WHERE least < doc_id)),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS rest
  FROM (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM d) ANTI JOIN places USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op2_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha256(h) AS digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f""",
    "op5_mix_sources": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
keyed AS (
  SELECT doc_id, source, size::BIGINT AS size,
    -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':mix'), 1, 12))::BIGINT + 1) / 281474976710656.0::DOUBLE)
      / CASE WHEN size > 0 THEN size::DOUBLE / (size + length(t) - length(regexp_replace(t, '[^\p{L}\p{N}\s.,]', '', 'g'))) ELSE 1.0 END AS key
  FROM sized),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
ranked AS (
  SELECT *, 3 * source_size AS cap, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM totals),
capped AS (
  SELECT *, ((sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) * weight) > cap AS is_capped
  FROM ranked WINDOW before AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, CASE WHEN is_capped THEN cap::DOUBLE ELSE
    (sum(source_size) OVER () - sum(CASE WHEN is_capped THEN cap ELSE 0 END) OVER ())::DOUBLE / sum(CASE WHEN is_capped THEN 0 ELSE weight END) OVER () * weight END AS target
  FROM capped),
run AS (
  SELECT k.doc_id, k.size, t.source_size, t.target,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS reached,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN size > 0 AND reached + size / 2.0 <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM run""",
    "op7_decontaminate": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, g)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op11_prefix_trie": r"""
WITH t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, key) AS p
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x, sha256(strlen(r) || ':' || r || x) AS key FROM conversations WHERE conv_id IS NOT NULL)),
sizes AS (SELECT conv_id, count(*) AS size, conv_id::VARCHAR AS id FROM t GROUP BY conv_id),
crc AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(list_transform(range(1, len(id) + 1), lambda i: ascii(substr(id, i, 1))::BIGINT),
    lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda y, bit: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END, xor(c, b)), 4294967295), 4294967295) % 9 AS h
  FROM sizes),
c AS (SELECT crc.*, least(h, coalesce(size, 0)) AS shared FROM crc LEFT JOIN (SELECT conv_id AS base, size FROM sizes) USING (base)),
s AS (
  SELECT c.conv_id, p - h + shared AS d, key, x FROM c JOIN t USING (conv_id) WHERE p > h
  UNION ALL SELECT c.conv_id, p, key, x FROM c JOIN t ON t.conv_id = c.base WHERE p <= shared),
k AS (
  SELECT conv_id, d, x, string_agg(key, '') OVER (PARTITION BY conv_id ORDER BY d) AS path FROM s
  UNION ALL SELECT conv_id, 0, '', '' FROM c),
nodes AS (SELECT d, path, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(strlen(x)) AS own FROM k GROUP BY d, path),
parents AS (SELECT n.d, n.path, k.path AS up FROM nodes n JOIN k ON k.conv_id = n.conv_id AND k.d = n.d - 1),
children AS (SELECT up AS path, count(*) AS n_children FROM parents GROUP BY up),
below AS (
  SELECT k.path, count(*) FILTER (c.path IS NULL) AS n_leaves, sum(n.own) AS saved
  FROM nodes n LEFT JOIN children c USING (path) JOIN k ON k.conv_id = n.conv_id AND k.d <= n.d GROUP BY k.path),
ends AS (SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM k JOIN (SELECT conv_id, max(d) AS d FROM k GROUP BY conv_id) USING (conv_id, d) GROUP BY path)
SELECT n.conv_id, n.d::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes n LEFT JOIN parents p USING (path) LEFT JOIN nodes u ON u.path = p.up LEFT JOIN children USING (path) JOIN below USING (path) LEFT JOIN ends USING (path)""",
    "op12_chat_format": r"""
WITH t AS (
  SELECT *, strlen(r) || ':' || r || x AS whole, replace(replace(replace(x, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>') AS shown,
    replace(replace(replace(replace(r, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>'), ':', '\:') AS head
  FROM (
    SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL
    UNION ALL SELECT -7, turn, role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(turn, role)))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, r, sha256(whole))) AS turns_sha256,
  coalesce(sum(len(x)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, r, sha256(whole)) FILTER (r = 'assistant'), '')) AS loss_sha256,
  sum(len(head) + len(shown) + 14)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id""",
}
