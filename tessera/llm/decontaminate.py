"""Benchmark decontamination by winnowing, in DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize, settled

#: Words after A-Z are lower-cased: runs of digits, a-z and everything outside ASCII.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
GRAM = 7
#: Benchmarks of at most so many words are looked up where the documents lie; larger ones are joined by their fingerprints.
LOOKED_UP_WORDS = 100_000


def words(text: Column) -> Column:
    """The words of a text; null has none. Only A-Z change case: ``lower`` where all is ASCII."""
    text = F.coalesce(text, F.lit(""))
    plain = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.filter(F.split(plain, BETWEEN_WORDS), lambda w: w != "")


def meeting(array: Column, ahead: int, f) -> Column:
    """f(entry, entry ``ahead`` places on) for every entry that has one."""
    n = F.greatest(F.size(array) - ahead, F.lit(0))
    return F.zip_with(F.slice(array, 1, n), F.slice(array, ahead + 1, n), f)


def hashed(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """``rows`` (with words w) and g1, g2 .. of each length: the hash of every so many consecutive words.
    A hash of twice as many words is made of two hashes, one of any number between of two that overlap."""
    rows, have = rows.withColumn("g1", F.transform("w", lambda x: F.xxhash64(x))), [1]
    while 2 * have[-1] <= max(lengths, default=1):
        n = have[-1]
        rows = rows.withColumn(f"g{2 * n}", meeting(F.col(f"g{n}"), n, lambda a, b: F.xxhash64(a, b)))
        have.append(2 * n)
    for n in set(lengths) - set(have):
        half = max(x for x in have if x < n)
        rows = rows.withColumn(f"g{n}", meeting(F.col(f"g{half}"), n - half, lambda a, b: F.xxhash64(a, b)))
    return rows


def with_smallest(rows: DataFrame, k: int, w: int) -> DataFrame:
    """``rows`` with m: the smallest of every w consecutive hashes of k words, again from two that overlap."""
    rows, n = rows.withColumn("m", F.col(f"g{k}")), 1
    while n < w:
        step = min(n, w - n)
        rows, n = rows.withColumn("m", meeting(F.col("m"), step, lambda a, b: F.least(a, b))), n + step
    return rows


def place_of(i: Column, key: Column, g: Column, w: int) -> Column:
    """Where in the window of w entries from i on the entry ``key`` is first."""
    return (i - 1 + F.array_position(F.slice(g, i, w), key)).cast("int")


def found_places(array: str, n: int, keys: list[int] | None, wanted: str = "true") -> Column:
    """(n, i, key) of the entries of ``array`` that are among ``keys`` (None: all) and ``wanted``."""
    among = "true" if keys is None else f"x IN ({', '.join(map(str, keys))})" if keys else "false"
    return F.expr(f"filter(transform({array}, (x, j) -> if({among} and {wanted}, struct({n} as n, j + 1 as i, x as key), null)), x -> x is not null)")


def same_for(a: Column, b: Column) -> Column:
    """How many entries two arrays of one length have in common from their start on."""
    first = F.array_position(F.zip_with(a, b, lambda x, y: x == y), False)
    return F.when(first > 0, first - 1).otherwise(F.size(a)).cast("int")


def grown(seed: Column, window: int) -> Column:
    """(start, stop) of the longest run of equal words around the place p of w that is the place q of
    item_w (all from 1); null if it is shorter than a window and than the item."""
    p, q, w, item = seed["p"], seed["q"], F.col("w"), F.col("item_w")
    back, ahead = F.least(p, q) - 1, F.least(F.size(w) - p, F.size(item) - q) + 1
    left = same_for(F.reverse(F.slice(w, p - back, back)), F.reverse(F.slice(item, q - back, back)))
    right = same_for(F.slice(w, p, ahead), F.slice(item, q, ahead))
    return F.when(left + right >= F.least(F.lit(window), F.size(item)), F.struct((p - left).alias("start"), (p + right).alias("stop")))


def fingerprints(items: DataFrame, lengths: list[int], window: int, k: int) -> DataFrame:
    """(n, key, item_id, q): of every window of an item the smallest hash of k words, n being ``window``; of
    an item of n words, which is fewer, the hash of all of them."""
    rows, w = with_smallest(hashed(items.withColumn("w", F.col("item_w")), [k, *lengths]), k, window - k + 1), window - k + 1
    long = rows.where(F.size("w") >= window).select("item_id", F.col(f"g{k}").alias("g"), F.posexplode_outer("m").alias("i", "key"))
    long = long.select(F.lit(window).alias("n"), "key", "item_id", place_of(F.col("i") + 1, F.col("key"), F.col("g"), w).alias("q")).distinct()
    short = F.coalesce(*(F.when(F.size("w") == n, F.element_at(f"g{n}", 1)) for n in lengths), F.lit(None).cast("long"))
    return long.unionByName(rows.where(F.size("w") < window).select(F.size("w").alias("n"), short.alias("key"), "item_id", F.lit(1).alias("q")))


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, k: int = GRAM, looked_up_words: int = LOOKED_UP_WORDS) -> DataFrame:
    """(id, row_key, n_words, n_hit, n_items, items): the words that benchmark items cover.

    Of every window - k + 1 consecutive k-gram hashes the smallest is kept, in documents and items
    alike, so any shared window has a shared fingerprint at the same place. Fingerprints are
    joined, and each seed is extended over equal words both ways; runs of a window or more count. An item
    of fewer words (but not none) is one window and is looked up by the hash of all its words.

    Documents are split and hashed once, whatever the benchmark's size. Up to ``looked_up_words`` words of
    benchmark, places are looked up where the documents lie and only hits leave them (the
    fingerprints that are broadcast are no more than those words); beyond, the fingerprints of
    documents are joined with the benchmark's by a shuffle. Documents with seeds are read again.

    Null texts have no words. Null items ids count as the id ''. Items with equal ids are one
    item. Rows equal in id and text come out as often as they came in (each row is its own document).
    No rows: no rows; no items: no hits. Other columns are not read.
    """
    of, w = F.col(text_col), window - k + 1
    read = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(of, F.lit(""))).alias("row_key"), of.alias("text"))
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), words(F.col(item_text_col)).alias("item_w")).where(F.size("item_w") > 0).distinct()
    items = items.withColumn("item_id", F.concat_ws(":", F.xxhash64("item_w").cast("string"), "item"))
    sizes = {r["n"]: r["total"] for r in items.groupBy(F.least(F.size("item_w"), F.lit(window)).alias("n")).agg(F.sum(F.size("item_w")).alias("total")).collect()}
    lengths, bounded = sorted(set(sizes) - {window}), sum(sizes.values()) <= looked_up_words
    small = F.broadcast if bounded else lambda df: df
    prints = materialize(fingerprints(items, lengths, window, k), "fingerprints")
    keys: dict[int, list[int] | None] = {n: [] if bounded else None for n in [*lengths, window]}
    for r in prints.select("n", "key").distinct().collect() if bounded else []:
        keys[r["n"]].append(r["key"])

    # the place of a smallest hash is a new one if it is another hash or its place has dropped out
    new = f"(j = 0 or x <> element_at(m, cast(j as int)) or element_at(g{k}, cast(j as int)) = element_at(m, cast(j as int)))" if not bounded else "true"
    places = [found_places("m", window, keys[window], new), *(found_places(f"g{n}", n, keys[n]) for n in lengths)]
    # explode_outer: the filter that Spark derives from explode would spell all hashes out again, nested
    # one row a document (n = 0) in front, so that the same scan tells the number of words
    whole = F.array(F.struct(F.lit(0).alias("n"), F.lit(0).alias("i"), F.lit(0).cast("long").alias("key")))
    rows = with_smallest(hashed(read.select("id", "row_key", words(F.col("text")).alias("w")), [k, *lengths]), k, w)
    rows = rows.select("id", "row_key", F.size("w").cast("long").alias("n_words"), F.col(f"g{k}").alias("g"), F.explode_outer(F.concat(whole, *places)).alias("at"))
    p = F.when(F.col("at.n") == window, place_of(F.col("at.i"), F.col("at.key"), F.col("g"), w)).otherwise(F.col("at.i"))
    rows = rows.select("id", "row_key", "n_words", F.col("at.n").alias("n"), F.col("at.key").alias("key"), p.alias("p"))
    if not bounded:
        rows = materialize(rows, "document-fingerprints")
    seeds = rows.join(small(prints), ["n", "key"], "left").where("n = 0 or item_id is not null")
    seeds = materialize(seeds.select("id", "row_key", "n_words", "n", "item_id", "p", "q"), "seeds")

    hits = seeds.where("n > 0").groupBy(F.col("id").alias("of"), F.col("row_key").alias("of_key"), "item_id").agg(F.collect_set(F.struct("p", "q")).alias("seeds"))
    met = read.join(materialize(hits, "hits"), F.col("id").eqNullSafe(F.col("of")) & (F.col("row_key") == F.col("of_key"))).withColumn("w", words(F.col("text"))).join(small(items), "item_id")
    runs = met.select("id", "row_key", "item", F.filter(F.transform("seeds", lambda s: grown(s, window)), lambda x: x.isNotNull()).alias("spans")).where(F.size("spans") > 0)
    by_doc = runs.groupBy(F.col("id").alias("of"), F.col("row_key").alias("of_key")).agg(F.array_sort(F.collect_set("item")).alias("items"), F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans"))
    state = F.struct(F.lit(0).cast("long").alias("covered"), F.lit(0).alias("reach"))
    covered = F.aggregate(
        "spans",
        state,
        lambda s, x: F.struct((s["covered"] + F.greatest(F.lit(0), x["stop"] - F.greatest(x["start"], s["reach"]))).cast("long").alias("covered"), F.greatest(s["reach"], x["stop"]).alias("reach")),
        lambda s: s["covered"],
    )
    by_doc = by_doc.select("of", "of_key", "items", covered.alias("n_hit"))
    each = seeds.where("n = 0").join(by_doc, F.col("id").eqNullSafe(F.col("of")) & (F.col("row_key") == F.col("of_key")), "left")
    none = F.array().cast("array<string>")
    return each.select("id", "row_key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", none).alias("items"))


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """A twentieth of the words or more are covered."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def clean_documents(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``contamination`` finds contaminated; columns and repeats stay."""
    contaminated = is_contaminated(F.col("n_hit"), F.col("n_words"))
    bad = settled(lambda: contamination(docs, benchmark, id_col=id_col, text_col=text_col).where(contaminated).select("id", "row_key").distinct(), "contaminated")
    packed = docs.select(docs[id_col].alias("of"), F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("of_key"), F.struct("*").alias("row"))
    clean = packed.join(bad, F.col("of").eqNullSafe(F.col("id")) & (F.col("of_key") == F.col("row_key")), "left_anti")
    return clean.select(*(F.col("row")[c].alias(c) for c in docs.columns))
