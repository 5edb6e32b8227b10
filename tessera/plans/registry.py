"""The queries that the entry file offers, and the SQL that they are held against."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.functions.values import is_datetime, parse_numeric
from tessera.operators import catalog, chunks, groups, index, profile, prompts
from tessera.session import run_dir
from tessera.sources.delimited import ROW, read_delimited
from tessera.streaming.profile import hourly_profile

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (read, spark), where ``read`` gives a table by name, with its SQL."""

    def register(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark)

        run.__name__, run.__doc__ = function.__name__, function.__doc__
        QUERIES[function.__name__] = run
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    """Doubles that depend on the order of summing, rounded."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


# SQL of the scalar functions, for the statements below
def trim_sql(v: str) -> str:
    return rf"regexp_replace({v}, '^[\s\x{{85}}\p{{Z}}]+|[\s\x{{85}}\p{{Z}}]+$', '', 'g')"


def number_sql(v: str) -> str:
    s = f"trim(replace(replace({trim_sql(v)}, '%', ''), chr(160), ' '))"
    plain = f"""CASE WHEN instr({s}, ',') > 0 AND instr({s}, '.') > 0 THEN CASE WHEN instr(reverse({s}), ',') < instr(reverse({s}), '.') THEN replace(replace({s}, '.', ''), ',', '.') ELSE replace({s}, ',', '') END
      WHEN instr({s}, ',') > 0 THEN replace(replace(replace({s}, '.', ''), ' ', ''), ',', '.') ELSE replace(replace({s}, ',', ''), ' ', '') END"""
    return rf"CASE WHEN regexp_matches({plain}, '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$') AND abs(try_cast({plain} AS DOUBLE)) < 'inf'::DOUBLE THEN try_cast({plain} AS DOUBLE) END"


def prompt_tokens_sql(v: str) -> str:
    return f"greatest(CASE WHEN length({v}) > 0 THEN 1 ELSE 0 END, length({v}) * 3 // 10)::INT"


def long_sql(table: str, columns: list[str]) -> str:
    """Long-form cells: pos, name, value."""
    return " UNION ALL ".join(f"SELECT {i} AS pos, '{c}' AS name, coalesce(CAST({c} AS VARCHAR), '') AS value FROM {table}" for i, c in enumerate(columns))


CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
DATE = r"^\d{4}-\d{2}-\d{2}( \d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$"
KIND_SQL = rf"CASE WHEN {trim_sql('value')} = '' THEN 'missing' WHEN {number_sql('value')} IS NOT NULL THEN 'numeric' WHEN regexp_matches({trim_sql('value')}, '{DATE}') THEN 'datetime' ELSE 'text' END"
VOTES_SQL = f"SELECT pos, name, value, {KIND_SQL} AS kind, {number_sql('value')} AS number FROM"


@query("SELECT count(*) AS rows, least(count(*), 1000) AS processed FROM orders")
def row_counts(read, spark):
    return profile.row_counts(read("orders").select("o_orderkey"), 1000)


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 1000")
def row_cap(read, spark):
    return profile.first_rows(read("orders").select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_orderkey"], 1000)


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def column_cap(read, spark):
    return profile.capped_columns(read("customer"), 3)[0]


@query("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation ORDER BY nation.n_nationkey LIMIT 5")
def head_sample(read, spark):
    return profile.head_sample(read("nation"), ["n_nationkey"])


@query(f"SELECT pos, name, count(*) FILTER (kind <> 'missing') AS non_null, count(*) FILTER (kind = 'missing') AS missing FROM ({VOTES_SQL} ({long_sql('(SELECT event_type, CASE WHEN event_id % 7 = 0 THEN chr(9) || chr(32) ELSE user_id::VARCHAR END AS who FROM events)', ['event_type', 'who'])})) GROUP BY pos, name")
def missing_counts(read, spark):
    table = read("events").select("event_type", F.when(F.col("event_id") % 7 == 0, "\t ").otherwise(F.col("user_id").cast("string")).alias("who"))
    return profile.column_summary(profile.cells(table)).select("pos", "name", "non_null", "missing")


@query(f"SELECT pos, name, count(*) FILTER (kind = 'numeric') AS n_numeric, count(*) FILTER (kind = 'datetime') AS n_datetime, count(*) FILTER (kind = 'text') AS n_text FROM ({VOTES_SQL} ({long_sql('customer', CUSTOMER)})) GROUP BY pos, name")
def type_votes(read, spark):
    return profile.column_summary(profile.cells(read("customer").select(CUSTOMER))).select("pos", "name", "n_numeric", "n_datetime", "n_text")


@query(f"""SELECT pos, name, CASE WHEN a > 0 AND a >= b AND a >= c THEN 'numeric' WHEN b > 0 AND b >= c THEN 'datetime' WHEN d > 0 THEN 'categorical' WHEN c > 0 THEN 'text' ELSE 'unknown' END AS kind
FROM (SELECT pos, name, count(*) FILTER (kind = 'numeric') AS a, count(*) FILTER (kind = 'datetime') AS b, count(*) FILTER (kind = 'text') AS c, count(*) FILTER (kind = 'text' AND strlen({trim_sql('value')}) <= 64) AS d
  FROM ({VOTES_SQL} ({long_sql("(SELECT event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, value, props FROM events)", ['event_type', 'ts', 'value', 'props'])})) GROUP BY pos, name)""")
def column_kinds(read, spark):
    table = read("events").select("event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "value", "props")
    return profile.column_summary(profile.cells(table)).select("pos", "name", "kind")


@query(" UNION ALL ".join(f"SELECT {i} AS pos, '{c}' AS name, count({c}) AS non_null, min({c}) AS min, max({c}) AS max, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std FROM lineitem" for i, c in enumerate(LINE)))
def numeric_profile(read, spark):
    found = profile.column_summary(profile.cells(read("lineitem").select(LINE)))
    return rounded(found.select("pos", "name", "non_null", "min", "max", "mean", "std"), "mean", "std")


SPELLED = """CASE o_orderkey % 8 WHEN 0 THEN ' 1,234.5' || (o_orderkey % 10) WHEN 1 THEN '1.234,5' || (o_orderkey % 10) WHEN 2 THEN '1,' || (o_orderkey % 1000) WHEN 3 THEN '12.5%'
  WHEN 4 THEN '1 ' || (o_orderkey % 1000) WHEN 5 THEN '1,2,' || o_orderkey WHEN 6 THEN o_orderkey || 'e2' ELSE o_orderkey || 'd' END"""


@query(f"SELECT o_orderkey, spelled, {number_sql('spelled')} AS number FROM (SELECT o_orderkey, {SPELLED} AS spelled FROM orders)")
def numeric_parse_locale(read, spark):
    return read("orders").select("o_orderkey", F.expr(SPELLED).alias("spelled")).withColumn("number", parse_numeric(F.col("spelled")))


DATED = """CASE o_orderkey % 7 WHEN 0 THEN y || '-' || m || '-' || d WHEN 1 THEN y || '/' || m || '/' || d WHEN 2 THEN d || '/' || m || '/' || y WHEN 3 THEN y || '-' || m || '-' || d || ' 09:3' || (o_orderkey % 10)
  WHEN 4 THEN y || '-02-' || d WHEN 5 THEN '8/5/' || y ELSE y || '-' || m || '-' || d || 'T10:00:00Z' END"""


@query(rf"""SELECT o_orderkey, dated, CASE WHEN o_orderkey % 7 = 5 THEN false WHEN o_orderkey % 7 = 4 THEN try_cast(dated AS DATE) IS NOT NULL ELSE true END AS is_date
FROM (SELECT o_orderkey, {DATED} AS dated FROM (SELECT o_orderkey, year(o_orderdate)::VARCHAR AS y, lpad(month(o_orderdate)::VARCHAR, 2, '0') AS m, lpad(day(o_orderdate)::VARCHAR, 2, '0') AS d FROM orders))""")
def datetime_test(read, spark):
    parts = read("orders").select("o_orderkey", F.year("o_orderdate").cast("string").alias("y"), F.lpad(F.month("o_orderdate").cast("string"), 2, "0").alias("m"), F.lpad(F.dayofmonth("o_orderdate").cast("string"), 2, "0").alias("d"))
    return parts.select("o_orderkey", F.expr(DATED).alias("dated")).withColumn("is_date", is_datetime(F.col("dated")))


@query("""SELECT name, unit, round(min(x), 4) AS min, round(max(x), 4) AS max, round(avg(x), 4) AS mean FROM (
  SELECT 'Dose' AS name, 'mg/L' AS unit, p_retailprice * 1000 AS x FROM part UNION ALL SELECT 'Trace', 'mg/L', p_size / 1000.0::DOUBLE FROM part UNION ALL SELECT 'Heat', '°C', (p_size - 32) * 5.0::DOUBLE / 9.0::DOUBLE FROM part) GROUP BY name, unit""")
def unit_convert(read, spark):
    table = read("part").select(F.col("p_retailprice").alias("Dose (g/L)"), F.col("p_size").alias("Trace [ug/L]"), F.col("p_size").alias("Heat_°F"))
    return rounded(profile.column_summary(profile.cells(table)).select("name", "unit", "min", "max", "mean"), "min", "max", "mean")


MAD_SQL = """WITH m AS (SELECT o_orderpriority, count(*) AS n, quantile_cont(o_totalprice, 0.5) AS median FROM orders GROUP BY 1),
a AS (SELECT o_orderpriority, n, median, quantile_cont(abs(o_totalprice - median), 0.5) AS mad FROM orders JOIN m USING (o_orderpriority) GROUP BY ALL)"""


@query(f"{MAD_SQL} SELECT o_orderpriority, n, round(median, 4) AS median, round(mad, 4) AS mad FROM a")
def median_mad(read, spark):
    return rounded(profile.median_mad(read("orders").select("o_orderpriority", "o_totalprice"), ["o_orderpriority"], "o_totalprice"), "median", "mad")


@query(f"""{MAD_SQL}, z AS (SELECT o_orderpriority, n, abs(0.6745::DOUBLE * (o_totalprice - median) / mad) AS z FROM orders JOIN a USING (o_orderpriority))
SELECT o_orderpriority, n, count(*) FILTER (z > 1.5) AS n_outliers, round(max(z), 4) AS max_abs_z, 1.5::DOUBLE AS threshold FROM z GROUP BY o_orderpriority, n""")
def robust_outliers(read, spark):
    return rounded(profile.robust_outliers(read("orders").select("o_orderpriority", "o_totalprice"), ["o_orderpriority"], "o_totalprice", 1.5), "max_abs_z")


PART = ["p_brand", "p_type", "p_name"]
COUNTS_SQL = f"SELECT pos, name, {trim_sql('value')} AS value, count(*) AS n FROM ({long_sql('part', PART)}) WHERE {trim_sql('value')} <> '' AND {number_sql('value')} IS NULL AND strlen({trim_sql('value')}) <= 64 GROUP BY ALL"


@query(COUNTS_SQL)
def category_counts(read, spark):
    return profile.category_counts(profile.cells(read("part").select(PART)))


@query(f"SELECT pos, name, count(*) AS n_unique FROM ({COUNTS_SQL}) GROUP BY pos, name")
def category_unique(read, spark):
    return profile.category_unique(profile.cells(read("part").select(PART)))


@query(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY n DESC, value)::INT AS place FROM ({COUNTS_SQL})) WHERE place <= 8")
def top_values(read, spark):
    return profile.top_values(profile.cells(read("part").select(PART)))


@query("SELECT doc_id, value FROM (SELECT doc_id, " + trim_sql("text") + " AS value FROM documents) WHERE value <> '' ORDER BY doc_id LIMIT 3")
def text_examples(read, spark):
    return profile.text_examples(read("documents"), "text", ["doc_id"])


KEY_SQL = "'o_orderstatus=' || o_orderstatus || ' | o_orderpriority=' || o_orderpriority"


def keyed(read):
    orders = read("orders")
    return orders.withColumn("group_key", groups.group_key(orders, ["O_OrderStatus", "nothing", "o_orderpriority"]))


@query(f"SELECT o_orderkey, {KEY_SQL} AS group_key FROM orders")
def group_key(read, spark):
    return keyed(read).select("o_orderkey", "group_key")


@query(f"SELECT {KEY_SQL} AS group_key, count(*) AS n FROM orders GROUP BY 1")
def group_sizes(read, spark):
    return groups.group_sizes(keyed(read))


@query(f"SELECT {KEY_SQL} AS group_key, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, group_key LIMIT 20")
def top_groups(read, spark):
    return groups.top_groups(keyed(read))


METRICS = ["o_orderkey", "o_custkey", "o_totalprice"]
METRICS_SQL = " UNION ALL ".join(f"SELECT {KEY_SQL} AS group_key, '{c}' AS name, count({c}) AS n, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}), 4) AS mean FROM orders GROUP BY 1" for c in METRICS)


def metrics(read):
    long = profile.cells(keyed(read).select("group_key", *METRICS), keep=("group_key",))
    return rounded(groups.group_numeric(long), "mean")


@query(METRICS_SQL)
def group_numeric(read, spark):
    return metrics(read)


@query(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY name)::INT AS place FROM ({METRICS_SQL})) WHERE place <= 2")
def group_metric_top(read, spark):
    return groups.group_metrics_top(metrics(read), most=2)


def pair_sql(by: str = "") -> str:
    named = [(a, b) for i, a in enumerate(LINE) for b in LINE[i + 1 :]]
    key = f"{by} AS group_key, " if by else ""
    part = lambda a, b: f"SELECT {key}'{a}' AS a, '{b}' AS b, count(*) AS n, CASE WHEN min({a}) <> max({a}) AND min({b}) <> max({b}) THEN corr({a}, {b}) END AS r FROM lineitem" + (" GROUP BY 1" if by else "")
    return " UNION ALL ".join(part(a, b) for a, b in named)


@query(f"SELECT a, b, n, round(coalesce(r, 0), 4) AS r FROM ({pair_sql()})")
def corr_pairs(read, spark):
    return rounded(groups.correlation_pairs(read("lineitem").select(LINE), LINE), "r")


@query(f"WITH p AS ({pair_sql()}) SELECT a, b, round(coalesce(r, 0), 4) AS r FROM p UNION ALL SELECT b, a, round(coalesce(r, 0), 4) FROM p UNION ALL SELECT c, c, 1.0::DOUBLE FROM (SELECT unnest({LINE}) AS c)")
def corr_matrix(read, spark):
    return rounded(groups.correlation_matrix(read("lineitem").select(LINE), LINE), "r")


@query(f"SELECT a, b, n, round(coalesce(r, 0), 4) AS r FROM ({pair_sql()}) ORDER BY abs(r) DESC NULLS LAST, a || b LIMIT 3")
def top_corr_pairs(read, spark):
    return rounded(groups.top_correlations(groups.correlation_pairs(read("lineitem").select(LINE), LINE), 3), "r")


@query(f"SELECT group_key, a, b, round(r, 4) AS r, place FROM (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY abs(r) DESC, a || b)::INT AS place FROM ({pair_sql('l_returnflag')}) WHERE r IS NOT NULL) WHERE place <= 10")
def corr_per_group(read, spark):
    table = read("lineitem").select(F.col("l_returnflag").alias("group_key"), *LINE)
    return rounded(groups.correlations_per_group(table, LINE), "r")


@query(f"SELECT doc_id, {prompt_tokens_sql('text')} AS prompt_tokens, (length(text) // 4)::INT AS chunk_tokens FROM documents")
def token_count(read, spark):
    return read("documents").select("doc_id", t.prompt_tokens(F.col("text")).alias("prompt_tokens"), t.chunk_tokens(F.col("text")).alias("chunk_tokens"))


@query("SELECT doc_id, substr(text, 1, 333) AS head FROM documents")
def truncate_tokens(read, spark):
    return read("documents").select("doc_id", t.truncate_to_tokens(F.col("text"), 100).alias("head"))


@query("SELECT doc_id, sha1(text) AS hash, 'sim_' || substr(sha1(text), 1, 12) AS dry_run FROM documents")
def content_hash(read, spark):
    return read("documents").select("doc_id", F.sha1("text").alias("hash"), t.dry_run_id(F.col("text")).alias("dry_run"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview FROM documents")
def text_preview(read, spark):
    return read("documents").select("doc_id", t.preview(F.col("text")).alias("preview"))


@query("SELECT c_custkey, substr(c_name, 1, 3) || '****' || substr(c_name, -3) AS masked FROM customer")
def mask_secret(read, spark):
    return read("customer").select("c_custkey", t.mask(F.col("c_name")).alias("masked"))


@query("SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(lower(p_type), '[ _-]', '-', 'g'), '[^a-z0-9-]', '', 'g'), '^-+|-+$', '', 'g'), ''), 'sheet') AS slug FROM part")
def name_slug(read, spark):
    return read("part").select("p_partkey", t.slug(F.col("p_type")).alias("slug"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(replace(text, chr(10), chr(13) || chr(10) || chr(10)), '\r\n?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS content FROM documents")
def md_normalize(read, spark):
    return read("documents").select("doc_id", t.normalize_markdown(F.replace("text", F.lit("\n"), F.lit("\r\n\n"))).alias("content"))


STRIPPED_SQL = r"regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')"


@query(f"SELECT page_id, {trim_sql(STRIPPED_SQL)} AS content FROM pages")
def strip_tags(read, spark):
    return read("pages").select("page_id", t.strip_tags(F.col("html")).alias("content"))


@query("SELECT doc_id, contains(lower(text), 'license') AS some_license, contains(lower(text), 'apache') AND contains(lower(text), 'license') AS both FROM documents")
def contains_fold(read, spark):
    text = F.col("text")
    return read("documents").select("doc_id", t.contains_any_fold(text, ["LICENSE"]).alias("some_license"), t.contains_all_fold(text, ["Apache", "licensE"]).alias("both"))


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, '^https://[^/]*/[^/]*/[^/]*$') AND NOT regexp_matches(url, '^[^/]*//blog[^/]*/[^/]*/[^/]*$')")
def doc_glob_filter(read, spark):
    return read("pages").where(t.allowed(F.col("url"), ["https://*/*/*"], ["*//blog*/*/*", ""])).select("page_id", "url")


@query("""SELECT doc_id, contains(lower(text), 'dataset') OR contains(lower(text), 'summary') OR source LIKE '%.summary.md' AS is_dataset FROM documents""")
def dataset_doc_flag(read, spark):
    return read("documents").select("doc_id", t.is_dataset_document(F.col("source"), F.col("text")).alias("is_dataset"))


PARAGRAPHS_SQL = rf"""p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, part, length(part) // 4 AS size
  FROM (SELECT doc_id, unnest(generate_series(1, len(parts))) AS i, unnest(parts) AS part FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: {trim_sql('x')}) AS parts FROM documents)) WHERE part <> '')"""
GREEDY_SQL = f"""WITH RECURSIVE {PARAGRAPHS_SQL}, g AS (
  SELECT doc_id, i, part, size AS total, 0 AS chunk_id FROM p WHERE i = 1
  UNION ALL SELECT p.doc_id, p.i, p.part, CASE WHEN g.total + p.size > 400 THEN p.size ELSE g.total + p.size END, g.chunk_id + CASE WHEN g.total + p.size > 400 THEN 1 ELSE 0 END
  FROM g JOIN p ON p.doc_id = g.doc_id AND p.i = g.i + 1),
c AS (SELECT doc_id, chunk_id::INT AS chunk_id, string_agg(part, chr(10) || chr(10) ORDER BY i) AS text FROM g GROUP BY ALL)"""


def versioned(read) -> DataFrame:
    """Documents whose lines are paragraphs."""
    return read("documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))


@query(f"{GREEDY_SQL} SELECT * FROM c")
def chunk_greedy(read, spark):
    return versioned(read).select("doc_id", F.posexplode(chunks.greedy_chunks(F.col("text"))).alias("chunk_id", "text"))


# a: first and b: last of the paragraphs that are held, numbered without those of more than 400 tokens; sums up to each
OVERLAP_SQL = f"""WITH RECURSIVE {PARAGRAPHS_SQL}, o AS (
  SELECT *, count(*) FILTER (size <= 400) OVER seen AS k, coalesce(sum(size) FILTER (size <= 400) OVER seen, 0) AS upto FROM p WINDOW seen AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT doc_id, k, part, upto, upto - size AS before FROM o WHERE size <= 400),
g AS (
  SELECT doc_id, 0::BIGINT AS i, 1::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS ended_a, 0::BIGINT AS ended_b FROM (SELECT DISTINCT doc_id FROM p)
  UNION ALL
  SELECT doc_id, i, CASE WHEN full_up THEN coalesce((SELECT min(s.k) FROM s WHERE s.doc_id = x.doc_id AND s.k <= b AND s.k >= a AND held_upto - s.before <= 60), b) ELSE a END,
    CASE WHEN size > 400 THEN b ELSE k END, CASE WHEN full_up THEN a ELSE 0 END, CASE WHEN full_up THEN b ELSE 0 END
  FROM (
    SELECT g.doc_id, o.i, g.a, g.b, o.k, o.size, l.upto AS held_upto, g.a <= g.b AND (o.size > 400 OR l.upto - f.before + o.size > 400) AS full_up
    FROM g JOIN o ON o.doc_id = g.doc_id AND o.i = g.i + 1 LEFT JOIN s f ON f.doc_id = g.doc_id AND f.k = g.a LEFT JOIN s l ON l.doc_id = g.doc_id AND l.k = g.b) AS x),
last AS (SELECT doc_id, max(i) AS i FROM g GROUP BY doc_id),
ranges AS (
  SELECT doc_id, i, 0 AS step, ended_a AS a, ended_b AS b FROM g WHERE ended_b > 0
  UNION ALL SELECT doc_id, i + 1, 0, a, b FROM g JOIN last USING (doc_id, i) WHERE a <= b),
found AS (
  SELECT r.doc_id, r.i, 0 AS step, string_agg(s.part, chr(10) || chr(10) ORDER BY s.k) AS text FROM ranges r JOIN s ON s.doc_id = r.doc_id AND s.k BETWEEN r.a AND r.b GROUP BY r.doc_id, r.i
  UNION ALL SELECT doc_id, i, 1 + unnest(generate_series(0, (length(part) - 1) // 1600)), substr(part, 1 + 1600 * unnest(generate_series(0, (length(part) - 1) // 1600)), 1600) FROM o WHERE size > 400)
SELECT f.doc_id, d.source AS doc_name, (row_number() OVER (PARTITION BY f.doc_id ORDER BY i, step) - 1)::INT AS chunk_id, f.text, sha1(f.text) AS chunk_hash FROM found f JOIN documents d USING (doc_id)"""


@query(OVERLAP_SQL)
def chunk_overlap(read, spark):
    """Chunks as builds cut them: paragraphs of 400 tokens at most, the last of one chunk (60 tokens, one at least) before the next, longer ones in pieces."""
    return chunks.chunks(versioned(read), most=400, overlap=60)


@query(f"SELECT doc_id, chunk_id, text FROM ({OVERLAP_SQL}) WHERE chunk_id < 2")
def chunk_cap(read, spark):
    """The first two chunks of each document."""
    return chunks.chunks(versioned(read), most=400, overlap=60, per_document=2).select("doc_id", "chunk_id", "text")


LINES_SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, source, TRIMMED AS text FROM (SELECT doc_id, source, regexp_replace(text, '\n+', chr(10), 'g') AS value FROM documents)),
l AS (
  SELECT doc_id, i, line, length(line) // 4 AS size
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM d WHERE length(text) // 4 > 100)),
g AS (
  SELECT doc_id, i, size AS total, 0 AS part, size > 100 AS long FROM l WHERE i = 1
  UNION ALL SELECT l.doc_id, l.i, CASE WHEN g.long OR g.total + l.size > 100 THEN l.size ELSE g.total + l.size END, g.part + CASE WHEN g.long OR g.total + l.size > 100 THEN 1 ELSE 0 END, l.size > 100
  FROM g JOIN l ON l.doc_id = g.doc_id AND l.i = g.i + 1),
w AS (SELECT doc_id, part, bool_or(long) AS long, string_agg(line, chr(10) ORDER BY i) AS text FROM g JOIN l USING (doc_id, i) GROUP BY doc_id, part),
found AS (
  SELECT doc_id, part, 0 AS step, text FROM w WHERE NOT long
  UNION ALL SELECT doc_id, part, unnest(generate_series(0, (length(line) - 1) // 400)), substr(line, 1 + 400 * unnest(generate_series(0, (length(line) - 1) // 400)), 400) FROM (SELECT doc_id, part, TRIMMED AS line FROM (SELECT doc_id, part, text AS value FROM w WHERE long))
  UNION ALL SELECT doc_id, 0, 0, text FROM d WHERE length(text) // 4 <= 100 AND text <> '')
SELECT f.doc_id, d.source AS doc_name, (row_number() OVER (PARTITION BY f.doc_id ORDER BY part, step) - 1)::INT AS chunk_id, f.text, sha1(f.text) AS chunk_hash FROM found f JOIN d USING (doc_id)""".replace("\\n", "\n").replace("TRIMMED", trim_sql("value"))


@query(LINES_SQL)
def chunk_hard_split(read, spark):
    """Texts that are one paragraph each: by lines of 100 tokens together, longer lines in pieces of 400 characters."""
    return chunks.chunks(read("documents").withColumn("text", F.regexp_replace("text", "\n+", "\n")), most=100)


@query(f"SELECT doc_id, i::INT AS place, substr(t, 1 + 250 * i, 250) AS piece FROM (SELECT doc_id, t, unnest(generate_series(0, (length(t) - 1) // 250)) AS i FROM (SELECT doc_id, {trim_sql('text')} AS t FROM documents) WHERE t <> '')")
def char_split(read, spark):
    return read("documents").select("doc_id", F.posexplode(t.fixed_pieces(F.col("text"), 250)).alias("place", "piece"))


@query("""SELECT pos, name, unit, round(avg(x), 4) AS mean FROM (
  SELECT 0 AS pos, 'share' AS name, CASE WHEN (SELECT bool_or(l_linenumber % 3 = 0) FROM lineitem) THEN '%' ELSE '' END AS unit, round(l_discount * 100, 1)::DOUBLE AS x FROM lineitem
  UNION ALL SELECT 1, 'rate', 'mg/L', l_quantity::DOUBLE FROM lineitem UNION ALL SELECT 2, 'plain', '', l_tax::DOUBLE FROM lineitem) GROUP BY pos, name, unit""")
def percent_units(read, spark):
    """A per cent sign in any cell is the unit of a column whose header names none."""
    share = F.round(F.col("l_discount").cast("double") * 100, 1).cast("string")
    table = read("lineitem").select(F.concat(share, F.when(F.col("l_linenumber") % 3 == 0, "%").otherwise("")).alias("share"), F.col("l_quantity").cast("double").alias("rate (mg/L)"), F.col("l_tax").cast("double").alias("plain"))
    return rounded(profile.column_summary(profile.cells(table)).select("pos", "name", "unit", "mean"), "mean")


@query(f"SELECT doc_id, CASE WHEN {trim_sql('n')} = '' THEN '(unnamed)' ELSE {trim_sql('n')} END AS name, replace(replace(text, chr(10), ' '), '|', '/') AS value FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN chr(9) || ' ' ELSE ' ' || source || chr(160) END AS n, text || '|' || source AS text FROM documents)")
def safe_names(read, spark):
    name = F.when(F.col("doc_id") % 4 == 0, "\t ").otherwise(F.concat(F.lit(" "), "source", F.lit("\u00a0")))
    return read("documents").select("doc_id", t.safe_name(name).alias("name"), t.safe_value(F.concat("text", F.lit("|"), "source")).alias("value"))


def written_as_csv(table: DataFrame, spark) -> str:
    """Where the table lies as delimited text, every cell in quotes."""
    path = f"{run_dir(spark)}/csv-{uuid.uuid4().hex}"
    table.write.option("header", True).option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


@query("SELECT doc_id::VARCHAR AS doc_id, text FROM documents")
def csv_records(read, spark):
    """Documents, whose texts have line feeds, back from delimited files."""
    return read_delimited(spark, written_as_csv(read("documents").select("doc_id", "text"), spark), ",").select("doc_id", "text")


@query(f"SELECT pos, name, count(*) FILTER (kind <> 'missing') AS non_null, count(*) FILTER (kind = 'numeric') AS n_numeric, count(*) FILTER (kind = 'text') AS n_text, round(avg(number), 4) AS mean FROM ({VOTES_SQL} ({long_sql('part', ['p_name', 'p_size', 'p_retailprice'])})) GROUP BY pos, name")
def csv_profile(read, spark):
    """The profile of delimited files: all cells are strings there."""
    table = read_delimited(spark, written_as_csv(read("part").select("p_name", "p_size", "p_retailprice"), spark), ",").drop(ROW)
    return rounded(profile.column_summary(profile.cells(table)).select("pos", "name", "non_null", "n_numeric", "n_text", "mean"), "mean")


NEAR_SQL = "SELECT vec_id, label, coalesce(nullif(list_cosine_similarity(embedding::DOUBLE[], q), 'nan'::DOUBLE), 0) AS score FROM embeddings, (SELECT embedding::DOUBLE[] AS q FROM embeddings ORDER BY vec_id LIMIT 1)"


def first_vector(read) -> list[float]:
    row = read("embeddings").orderBy("vec_id").select("embedding").first()
    return list(row["embedding"]) if row else []


@query(f"SELECT vec_id, label, round(score, 6) AS score FROM (SELECT * FROM ({NEAR_SQL}) WHERE score >= 0 ORDER BY score DESC, vec_id LIMIT 6)")
def cosine_topk(read, spark):
    found = index.search(read("embeddings"), first_vector(read), k=6, vector_col="embedding", ties=("vec_id",))
    return rounded(found.select("vec_id", "label", "score"), "score", digits=6)


@query(f"SELECT vec_id, round(score, 6) AS score FROM ({NEAR_SQL}) WHERE score >= 0.2")
def cosine_min_score(read, spark):
    found = index.scored(read("embeddings"), first_vector(read), "embedding").where("score >= 0.2")
    return rounded(found.select("vec_id", "score"), "score", digits=6)


@query("""SELECT query_id, vec_id, place FROM (SELECT q.vec_id AS query_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id)::INT AS place
FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q) WHERE place <= 6""")
def embedding_search(read, spark):
    queries = read("embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return index.search_many(read("embeddings"), queries, k=6, min_score=-1.0, vector_col="embedding", ties=("vec_id",)).select("query_id", "vec_id", "place")


@query(f"SELECT (row_number() OVER (ORDER BY score DESC, vec_id))::INT AS rank, vec_id, round(score, 6) AS score FROM (SELECT * FROM ({NEAR_SQL}) ORDER BY score DESC, vec_id LIMIT 6)")
def evidence_rank(read, spark):
    found = index.search(read("embeddings"), first_vector(read), k=6, vector_col="embedding", ties=("vec_id",)).select("vec_id", "score", F.lit("").alias("doc_name"), F.col("vec_id").alias("chunk_id"), F.lit("").alias("text"))
    return rounded(prompts.evidence_items(found).select("rank", "vec_id", "score"), "score", digits=6)


def whole_chunks(read, changed: bool) -> DataFrame:
    """Documents as one chunk each; of the old version, every third text and every fifth document differs."""
    docs = read("documents").select("doc_id", F.col("source").alias("doc_name"), F.lit(0).alias("chunk_id"), "text")
    if not changed:
        docs = docs.where("doc_id % 5 <> 0").withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return docs.withColumn("chunk_hash", F.sha1("text"))


def old_index(read) -> DataFrame:
    return whole_chunks(read, False).withColumn("vector", F.array(F.length("text").cast("float")))


REUSED_SQL = "doc_id % 5 <> 0 AND doc_id % 3 <> 0"


@query(f"SELECT doc_id, sha1(text) AS chunk_hash, {REUSED_SQL} AS reused FROM documents")
def index_reuse_left(read, spark):
    return index.reusable(whole_chunks(read, True), old_index(read)).select("doc_id", "chunk_hash", F.col("vector").isNotNull().alias("reused"))


@query(f"SELECT doc_id, sha1(text) AS chunk_hash FROM documents WHERE NOT ({REUSED_SQL})")
def index_to_embed_anti(read, spark):
    return index.to_embed(whole_chunks(read, True), old_index(read)).select("doc_id", "chunk_hash")


def embed_length(texts: list[str]) -> list[list[float]]:
    """A stand-in for a model: a text's length."""
    return [[float(len(text))] for text in texts]


@query("SELECT doc_id, source AS doc_name, 0 AS chunk_id, length(text)::DOUBLE AS first FROM documents")
def index_merge_union(read, spark):
    found = index.merged(whole_chunks(read, True), old_index(read), embed_length)
    return found.select("doc_id", "doc_name", "chunk_id", F.col("vector")[0].cast("double").alias("first"))


@query(rf"SELECT doc_id, source AS doc_name, sha1(t) AS chunk_hash, length(t)::DOUBLE AS first FROM (SELECT doc_id, source, {trim_sql('text')} AS t FROM (SELECT doc_id, source, regexp_replace(text, '\n+', chr(10), 'g') AS text FROM documents)) WHERE t <> ''")
def index_update(read, spark):
    """An index on disk of older documents, brought up to date by writing what differs."""
    docs = read("documents").select("doc_id", "source", F.regexp_replace("text", "\n+", "\n").alias("text"))
    old = docs.where("doc_id % 50 <> 0").withColumn("text", F.when(F.col("doc_id") % 20 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    path, meta = f"{run_dir(spark)}/index-{uuid.uuid4().hex}", index.IndexMeta(most_tokens=1 << 30)
    index.update(old.unionByName(docs.limit(3).withColumn("doc_id", -F.col("doc_id") - 1)), embed_length, meta, path)
    index.update(docs, embed_length, meta, path)
    return index.load(spark, path)[0].select("doc_id", "doc_name", "chunk_hash", F.col("vector")[0].cast("double").alias("first"))


@query("SELECT source AS doc_name, 0 AS chunk_id, doc_id FROM documents ORDER BY 1, 2, 3")
def index_order(read, spark):
    return index.ordered(whole_chunks(read, True)).select("doc_name", "chunk_id", "doc_id")


def paths(read, old: bool) -> DataFrame:
    found = read("documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), "doc_id")
    return found.where("doc_id % 4 = 0").select("path") if old else found


@query("SELECT source || '/' || doc_id AS path, doc_id FROM documents WHERE doc_id % 4 = 0")
def dup_docs_semi(read, spark):
    return prompts.known_documents(paths(read, False), paths(read, True))


@query("SELECT source || '/' || doc_id AS path, doc_id FROM documents WHERE doc_id % 4 <> 0")
def new_docs_anti(read, spark):
    return prompts.new_documents(paths(read, False), paths(read, True))


@query("SELECT DISTINCT source FROM documents ORDER BY source")
def dedup_sources(read, spark):
    return prompts.unique_paths(read("documents"), "source")


MODELS_SQL = "(VALUES " + ", ".join(f"('{n}', {c}, {i}::DOUBLE, {o}::DOUBLE)" for n, c, i, o in catalog.MODELS) + ") AS m(name, context_tokens, input_per_k, output_per_k)"
UPDATE = [("openai/gpt-4o", 64000, 0.004, 0.02), ("local/new", 4096, 0.0, 0.0)]


@query(f"SELECT * FROM {MODELS_SQL} ORDER BY name")
def catalog_list(read, spark):
    return catalog.listed(catalog.builtin(spark))


@query(f"SELECT * FROM {MODELS_SQL} WHERE name <> 'openai/gpt-4o' UNION ALL SELECT 'openai/gpt-4o', 64000, 0.004::DOUBLE, 0.02::DOUBLE UNION ALL SELECT 'local/new', 4096, 0::DOUBLE, 0::DOUBLE")
def catalog_merge(read, spark):
    return catalog.merge(catalog.builtin(spark), spark.createDataFrame(UPDATE, catalog.SCHEMA))


PROVIDER, TIER = "CASE conv_id % 5 WHEN 0 THEN 'openai' WHEN 1 THEN 'gemini' WHEN 2 THEN 'local' WHEN 3 THEN 'google' ELSE 'nobody' END", "CASE turn % 4 WHEN 0 THEN 'cheap' WHEN 1 THEN 'balanced' WHEN 2 THEN 'high-context' ELSE 'none' END"
RECOMMENDED_SQL = "(VALUES " + ", ".join(f"('{tier}', '{provider}', '{model}')" for tier, models in catalog.TIERS.items() for provider, model in models.items()) + ") AS r(tier, provider, model)"


@query(f"SELECT conv_id, turn, r.model AS model, context_tokens FROM (SELECT conv_id, turn, {PROVIDER} AS p, {TIER} AS tier FROM conversations) c LEFT JOIN {RECOMMENDED_SQL} ON r.tier = c.tier AND r.provider = CASE c.p {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in catalog.ALIASES.items())} ELSE c.p END LEFT JOIN {MODELS_SQL} ON m.name = r.model")
def model_recommendation(read, spark):
    """The model that each request's provider and tier recommend, with its context."""
    asked = read("conversations").select("conv_id", "turn", F.expr(PROVIDER).alias("provider"), F.expr(TIER).alias("tier"))
    return catalog.with_prices(catalog.recommendations(asked), catalog.builtin(spark)).select("conv_id", "turn", "model", "context_tokens")


MODEL = "CASE conv_id % 4 WHEN 0 THEN 'openai/gpt-4o' WHEN 1 THEN 'google/gemini-1.5-pro' WHEN 2 THEN 'phi3:mini-4k-instruct' ELSE 'unknown/model' END"


def requests(read, spark) -> DataFrame:
    asked = read("conversations").select("conv_id", "turn", t.prompt_tokens(F.col("text")).alias("tokens"), F.expr(MODEL).alias("model"))
    return catalog.with_prices(asked, catalog.builtin(spark))


REQUESTS_SQL = f"SELECT conv_id, turn, {prompt_tokens_sql('text')} AS tokens, {MODEL} AS model, m.* FROM conversations LEFT JOIN {MODELS_SQL} ON m.name = {MODEL}"
COST_SQL = "coalesce(tokens / 1000.0::DOUBLE * input_per_k + 512 / 1000.0::DOUBLE * output_per_k, 0)"


@query(f"SELECT conv_id, turn, model, round({COST_SQL}, 8) AS cost FROM ({REQUESTS_SQL})")
def cost_estimate(read, spark):
    found = requests(read, spark).select("conv_id", "turn", "model", catalog.cost(F.col("tokens"), F.lit(512)).alias("cost"))
    return rounded(found, "cost", digits=8)


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN role WHEN conv_id % 3 = 0 THEN 'configured' ELSE 'default' END AS model FROM conversations")
def model_precedence(read, spark):
    flag, config = F.when(F.col("turn") % 2 == 1, F.col("role")).otherwise(""), F.when(F.col("conv_id") % 3 == 0, "configured")
    return read("conversations").select("conv_id", "turn", catalog.chosen_model(flag, F.lit(""), config, "default").alias("model"))


@query(f"SELECT conv_id, turn, {COST_SQL} > 0 AND {COST_SQL} > 0.0077::DOUBLE AS exceeded FROM ({REQUESTS_SQL})")
def budget_guard(read, spark):
    return requests(read, spark).select("conv_id", "turn", catalog.budget_exceeded(catalog.cost(F.col("tokens"), F.lit(512)), F.lit(0.0077)).alias("exceeded"))


@query(f"SELECT conv_id, turn, CASE WHEN NOT coalesce(context_tokens > 0 AND tokens + 4090 > context_tokens, false) THEN 'ok' WHEN model LIKE 'phi3%' THEN 'error' ELSE 'warn' END AS state FROM ({REQUESTS_SQL})")
def context_guard(read, spark):
    local = F.startswith("model", F.lit("phi3"))
    return requests(read, spark).select("conv_id", "turn", catalog.context_state(F.col("tokens"), F.lit(4090), F.col("context_tokens"), local).alias("state"))


TOTALS_SQL = f"SELECT source, sum({prompt_tokens_sql('text')})::BIGINT AS tokens, count(*) AS documents FROM documents GROUP BY source"


@query(TOTALS_SQL)
def token_breakdown(read, spark):
    return prompts.token_totals(read("documents"), "source")


@query(f"SELECT conv_id, turn, part, {prompt_tokens_sql('t')} AS tokens FROM (SELECT conv_id, turn, unnest(['role', 'text', 'empty']) AS part, unnest([role, text, '']) AS t FROM conversations)")
def token_parts(read, spark):
    parts = F.create_map(F.lit("role"), F.col("role"), F.lit("text"), F.col("text"), F.lit("empty"), F.lit(""))
    return read("conversations").select("conv_id", "turn", F.explode(t.token_breakdown(parts)).alias("part", "tokens"))


@query(f"SELECT source, tokens, CASE WHEN tokens > 200000 THEN 'error' WHEN tokens > 100000 THEN 'warn' ELSE 'ok' END AS state FROM ({TOTALS_SQL})")
def project_quota(read, spark):
    return prompts.project_quota(read("documents"), project="source")


@query(f"""SELECT source, summaries, tokens, CASE WHEN summaries >= 20 THEN 'error' WHEN tokens >= 150000 THEN 'warn' ELSE 'ok' END AS state FROM (
  SELECT source, count(*) FILTER (lang = 'fr') AS summaries, coalesce(sum({prompt_tokens_sql('text')}) FILTER (lang = 'fr'), 0)::BIGINT AS tokens FROM documents GROUP BY source)""")
def dataset_quota(read, spark):
    docs = read("documents").select("source", "text", F.lit("x").alias("name"), F.when(F.col("lang") == "fr", "A Dataset").otherwise("").alias("description"))
    return prompts.dataset_quota(docs, project="source")


@query("SELECT conv_id, string_agg('--- Document: ' || role || ' (turn ' || turn || ') ---' || chr(10) || text || chr(10), chr(10) ORDER BY turn) AS prompt_docs FROM conversations GROUP BY conv_id")
def prompt_docs(read, spark):
    docs = read("conversations").withColumn("description", F.concat(F.lit("turn "), F.col("turn").cast("string")))
    return prompts.prompt_documents(docs, project="conv_id", id_="turn", name="role")


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, '--- Document: ' || role || ' (turn ' || turn || ') ---' || chr(10) || text || chr(10) AS block FROM conversations")
def prompt_blocks(read, spark):
    docs = read("conversations").withColumn("description", F.concat(F.lit("turn "), F.col("turn").cast("string")))
    return prompts.prompt_blocks(docs, project="conv_id", id_="turn", name="role")


@query(f"SELECT * FROM (SELECT source, doc_id, row_number() OVER seen AS place, sum({prompt_tokens_sql('text')}) OVER seen AS tokens_so_far FROM documents WINDOW seen AS (PARTITION BY source ORDER BY doc_id)) WHERE tokens_so_far <= 20000")
def prompt_budget(read, spark):
    """The first documents of each source that a budget of tokens holds."""
    return prompts.within_tokens(read("documents"), 20_000, project="source", id_="doc_id").select("source", "doc_id", "place", "tokens_so_far")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS place, role = 'user' AS is_derived FROM conversations")
def evidence_documents(read, spark):
    docs = read("conversations").withColumn("path", F.when(F.col("role") == "user", "").otherwise(F.col("role")))
    return prompts.evidence_documents(docs, project="conv_id", id_="turn").select("conv_id", "turn", "place", "is_derived")


@query("""SELECT date_trunc('hour', ts) AS hour, event_type, count(value) AS n, min(value) AS min, max(value) AS max, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std FROM events GROUP BY ALL""")
def hourly_events(read, spark):
    return rounded(hourly_profile(read("events")), "mean", "std")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column profile of lineitem."""
    return profile.column_summary(profile.cells(spark.read.parquet(f"{sf_dir}/lineitem.parquet")))
