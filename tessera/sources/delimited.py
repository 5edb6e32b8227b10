"""Delimited text files as tables of strings, read in splits even where quoted cells hold line feeds."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

ROW = "__row"
QUOTE = '"'
#: A record is whole in its split, is left open by it, is closed by it, or goes through it.
WHOLE, OPENED, CLOSED, THROUGH = range(4)
#: Lines and their characters that go on to Spark at once (one record at least).
LINES, CHARACTERS = 4096, 8 << 20


def delimiter(path: str) -> str:
    """A tab for .tsv files, else a comma."""
    return "\t" if path.lower().endswith(".tsv") else ","


def ends_inside(line: str, inside: bool, opening: re.Pattern) -> bool:
    """Whether a line ends inside a quoted cell, if it began inside one or not. Outside, a quote opens a cell
    only where one begins (``opening`` matches what is before it); inside, two quotes are one of the text."""
    state, before = int(inside), "" if inside else None  # 0: outside, 1: inside, 2: a quote has just ended the inside
    for part in line.split(QUOTE)[:-1]:
        if before is None or state != 1:
            again = state == 2 and part == "" and before is not None
            state = 1 if again or opening.search(part if before is not None else "\n" + part) else 0
        else:
            state = 2
        before = part
    return state == 1


def _opening(sep: str, trimmed: bool) -> re.Pattern:
    return re.compile(f"(?:\n|{re.escape(sep)}){'[ \t]*' if trimmed else ''}\\Z")


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], str]]:
    for batch in batches:
        yield from (((key, start), line) for key, start, line in zip(*(c.to_pylist() for c in batch.columns), strict=True))


def split_functions(batches: Iterator[pa.RecordBatch], opening: re.Pattern) -> Iterator[pa.RecordBatch]:
    """(key, start, from_out, from_in, odd) of each split's lines with quotes: how it ends if it begins outside a cell and
    inside one, and whether any line of it ends inside if it begins outside, or has nothing but white space."""
    for (key, start), lines in groupby(_lines(batches), lambda x: x[0]):
        out, within, odd = False, True, False
        for _, line in lines:
            out, within = ends_inside(line, out, opening), ends_inside(line, within, opening)
            odd |= out or QUOTE not in line
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (key, start, out, within, odd)], ["key", "start", "from_out", "from_in", "odd"])


def split_records(batches: Iterator[pa.RecordBatch], opening: re.Pattern, begun: dict[int, list[tuple[int, int | None]]]) -> Iterator[pa.RecordBatch]:
    """(key, start, seq, part, text): the records of each split in order without the file's first, and the parts of those that
    cross its borders; seq is -1 if such a part is of the first. ``begun`` has for each file the
    ranges of splits that begin inside a cell."""
    out: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["key", "start", "seq", "part", "text"])

    for (key, start), lines in groupby(_lines(batches), lambda x: x[0]):
        entered = inside = any(lo < start and (hi is None or start <= hi) for lo, hi in begun.get(key, []))
        held: list[str] = []
        head = start == 0
        seq = first = 0
        for _, line in lines:
            seq += 1
            if not (held or inside or line):
                continue
            if not held:
                first = -1 if head else seq
            held.append(line)
            inside = ends_inside(line, inside, opening) if QUOTE in line else inside
            if not inside:
                if entered or not head:
                    out.append((key, start, first, CLOSED if entered else WHOLE, "\n".join(held)))
                    size += len(out[-1][-1])
                held, entered, head = [], False, False
                if len(out) >= LINES or size >= CHARACTERS:
                    yield flush()
                    out, size = [], 0
        if held:
            out.append((key, start, first, THROUGH if entered else OPENED, "\n".join(held)))
    if out:
        yield flush()


def header_record(lines: DataFrame, opening: re.Pattern) -> str | None:
    """The first record of some lines; only as many are read as it takes."""
    most = 100
    while True:
        held: list[str] = []
        inside = False
        taken = lines.take(most)
        for row in taken:
            if held or row["value"]:
                held.append(row["value"])
                inside = ends_inside(row["value"], inside, opening)
                if not inside:
                    return "\n".join(held)
        if len(taken) < most:
            return "\n".join(held) if held else None
        most *= 10


def read_delimited(spark: SparkSession, path: str | list[str], sep: str | None = None) -> DataFrame:
    """All columns as strings, in file order by the column ``__row``, files in the order of their paths. Each file's first
    record is its header; the first file's names the columns. Short rows are filled with nulls, cells beyond the header are
    dropped, blank lines are no rows. Empty cells of .tsv rows keep their place.

    Quoted cells may hold line feeds, and a file is read by many tasks all the same. A first pass over the lines
    with quotes finds how each split ends if it begins inside a quoted cell or outside of one; put after one
    another, these tell where every split begins. If no record has a line feed, Spark reads lines. Else each task
    joins its lines to records, and only parts of records that cross a border between splits (two a split at most)
    are shuffled; Spark's own parser takes the records apart. Files without a record: no columns but ``__row``."""
    sep = sep or delimiter(path if isinstance(path, str) else path[0])
    trimmed = sep != "\t"
    opening = _opening(sep, trimmed)
    options = {"sep": sep, "quote": QUOTE, "escape": QUOTE, "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": str(trimmed).lower()}
    source = spark.read.text(path)
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path"), F.xxhash64("_metadata.file_path").alias("key"))  # contents are not read
    place = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("seq"))
    header = None
    for file in files.orderBy("path").toLocalIterator():
        header = header_record(source.where((F.col("_metadata.file_path") == file["path"]) & (F.col("_metadata.file_block_start") == 0)), opening)
        if header is not None:
            break
    if header is None:
        return source.where("false").select(place.alias(ROW))
    named = spark.read.options(**options).option("header", True).csv(spark.sparkContext.parallelize([header], 1)).columns
    schema = StructType([StructField(f"c{i}", StringType()) for i in range(len(named))])
    cells = [F.col(f"cells.c{i}").alias(name) for i, name in enumerate(named)]

    lines = source.select(F.xxhash64("_metadata.file_path").alias("key"), F.col("_metadata.file_block_start").alias("start"), "value")
    telling = lines.where(F.contains("value", F.lit(QUOTE)) | F.col("value").rlike(r"\A[\x00-\x20]+\z"))
    ends = telling.mapInArrow(lambda batches: split_functions(batches, opening), "key long, start long, from_out boolean, from_in boolean, odd boolean")
    # a split that ends alike whatever came before it settles the state; those that swap it are counted
    by_file = W.partitionBy("key").orderBy("start")
    swaps = (F.sum((F.col("from_out") & ~F.col("from_in")).cast("int")).over(by_file) % 2).cast("int")
    placed = ends.withColumn("swaps", swaps).withColumn("value", F.when(F.col("from_out") == F.col("from_in"), F.col("from_out").cast("int").bitwiseXOR(F.col("swaps"))))
    inside = F.coalesce(F.last("value", True).over(by_file), F.lit(0)).bitwiseXOR(F.col("swaps")) == 1
    ranges = placed.withColumn("inside", inside).withColumn("next", F.lead("start").over(by_file)).where("inside or odd")
    found = ranges.agg(F.collect_list(F.when(F.col("inside"), F.struct("key", "start", "next"))).alias("begun"), F.count(F.lit(1)).alias("n")).first()
    if not found["n"]:
        return spark.read.options(**options).option("header", True).schema(schema).csv(path).select(*(F.col(f"c{i}").alias(name) for i, name in enumerate(named)), place.alias(ROW))

    begun: dict[int, list[tuple[int, int | None]]] = {}
    for r in found["begun"]:
        begun.setdefault(r["key"], []).append((r["start"], r["next"]))
    parts = lines.mapInArrow(lambda batches: split_records(batches, opening, begun), "key long, start long, seq long, part int, text string")
    crossing = parts.where(F.col("part") != WHOLE).withColumn("record", F.sum((F.col("part") == OPENED).cast("int")).over(W.partitionBy("key").orderBy("start", F.col("part") == OPENED)))
    pieces = F.array_sort(F.collect_list(F.struct("start", "seq", "text")))
    joined = crossing.groupBy("key", "record").agg(pieces.alias("pieces")).select("key", F.col("pieces")[0]["start"].alias("start"), F.col("pieces")[0]["seq"].alias("seq"), F.array_join(F.transform("pieces", lambda p: p["text"]), "\n").alias("text"))
    records = parts.where(F.col("part") == WHOLE).select("key", "start", "seq", "text").unionByName(joined.where("seq >= 0"))
    parsed = F.from_csv("text", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options | {"multiLine": "true"})
    return records.withColumn("cells", parsed).join(F.broadcast(files), "key").select(*cells, F.struct("path", "start", "seq").alias(ROW))
