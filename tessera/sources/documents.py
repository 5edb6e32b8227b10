"""Documents of several formats as one table (path, name, content), and lists of input files."""

from __future__ import annotations

import glob
import io
import os
import zipfile
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions.text import normalize_markdown, strip_tags
from tessera.operators import projects, report
from tessera.operators.profile import ProfileOptions
from tessera.sources.delimited import ROW, read_delimited
from tessera.sources.workbooks import read_workbook

TABLES = (".csv", ".tsv", ".xlsx")
#: Bytes of a table's report that may stand for it as a document.
MOST_REPORT = 100_000


@F.pandas_udf(StringType())
def _word_xml(contents: pd.Series) -> pd.Series:
    def xml(content: bytes) -> str:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            return archive.read("word/document.xml").decode("utf-8", "replace")

    return contents.map(xml)


def read_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, name, content) of text, Markdown and .docx files, a file a row, read in parallel."""
    files = spark.read.format("binaryFile").load(paths)
    word = files.where(F.lower(F.col("path")).endswith(".docx")).select("path", strip_tags(_word_xml("content")).alias("content"))
    other = files.where(~F.lower(F.col("path")).endswith(".docx"))
    text = F.when(F.lower(F.col("path")).rlike(r"\.(md|markdown)$"), normalize_markdown(F.col("content").cast("string"))).otherwise(F.col("content").cast("string"))
    both = word.unionByName(other.select("path", text.alias("content")))
    return both.withColumn("name", F.regexp_extract("path", "([^/]*)$", 1))


def read_table(spark: SparkSession, path: str, sep: str | None = None, sheet: str = "", index: int = 1) -> DataFrame:
    return read_workbook(spark, path, sheet, index) if path.lower().endswith(".xlsx") else read_delimited(spark, path, sep)


def table_document(spark: SparkSession, path: str) -> str:
    """A table as a document: its report with the default options. A very large report is an error."""
    text = report.markdown(report.analyze(read_table(spark, path), [ROW], os.path.basename(path), ProfileOptions()))
    if len(text.encode()) > MOST_REPORT:
        raise ValueError(f"the report of {path} exceeds {MOST_REPORT} bytes")
    return text


def matched_files(patterns: list[str]) -> list[str]:
    """The files of some glob patterns, each once, in the order of their paths."""
    return sorted({path for pattern in patterns for path in (glob.glob(pattern) or ([pattern] if os.path.exists(pattern) else []))})


def kind_of(path: str) -> str:
    """What reads a file: ``table`` for .csv, .tsv and .xlsx in any case, else ``document``; a suffix that nobody knows is text."""
    return "table" if path.lower().endswith(TABLES) else "document"


def _documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``read_documents`` of some matched files; empty ones too, which Spark passes over."""
    empty = [p for p in paths if not os.path.getsize(p)]
    found = spark.createDataFrame([(f"file:{p}", "", os.path.basename(p)) for p in empty], "path string, content string, name string")
    some = [p for p in paths if p not in empty]
    return found.unionByName(read_documents(spark, some)) if some else found


def _at_once(spark: SparkSession, work: list, function, tasks: int) -> list:
    """``function`` of each thing of ``work``, as concurrent Spark jobs, in order."""
    with ThreadPoolExecutor(max(1, min(tasks, len(work)))) as pool:
        return list(pool.map(inheritable_thread_target(spark)(function), work))


def parse_files(spark: SparkSession, patterns: list[str], tasks: int = 4) -> DataFrame:
    """(path, name, kind, content) of every matched file, none left out: tables as their report, .docx and
    Markdown as text, whatever else as it is. Documents are read by one job in parallel, tables by jobs of their
    own, ``tasks`` at a time."""
    paths = matched_files(patterns)
    tables, others = ([p for p in paths if (kind_of(p) == "table") == wanted] for wanted in (True, False))
    schema = "path string, name string, kind string, content string"
    reports = _at_once(spark, tables, lambda p: table_document(spark, p), tasks)
    found = spark.createDataFrame([(f"file:{p}", os.path.basename(p), "table", text) for p, text in zip(tables, reports, strict=True)], schema)
    if not others:
        return found
    return found.unionByName(_documents(spark, others).select("path", "name", F.lit("document").alias("kind"), "content"))


@dataclass(frozen=True)
class Analyzed:
    """What became of a file: its kind, the summary's path (tables), and whether the project has it now."""

    path: str
    kind: str
    summary: str = ""
    added: bool = False


def analyze_files(spark: SparkSession, patterns: list[str], folder: str, options: ProfileOptions = ProfileOptions(), project: str = "", tasks: int = 4) -> list[Analyzed]:
    """Write a summary of every table among the files into a folder, and say what became of each file, in the order of
    their paths. Tables are profiled by concurrent jobs, ``tasks`` at a time; summaries are named in order.

    With a ``project`` (its path) the summaries and the files that are no tables are added to it as documents, in one
    step: either all are or, if a path is known already or the quota is exceeded, none. Without one, files
    that are no tables are listed, not added."""
    paths = matched_files(patterns)
    tables = [p for p in paths if kind_of(p) == "table"]
    texts = dict(zip(tables, _at_once(spark, tables, lambda p: report.markdown(report.analyze(read_table(spark, p), [ROW], os.path.basename(p), options)), tasks), strict=True))
    summaries = {p: report.write_summary(text, folder, os.path.splitext(os.path.basename(p))[0]) for p, text in texts.items()}
    if project:
        new = spark.createDataFrame([(summaries[p], os.path.basename(summaries[p]), f"dataset summary of {os.path.basename(p)}", texts[p]) for p in tables], "path string, name string, description string, text string")
        if len(tables) < len(paths):
            plain = _documents(spark, [p for p in paths if p not in texts])
            new = new.unionByName(plain.select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), "name", F.lit("").alias("description"), F.col("content").alias("text")))
        if paths:
            projects.append(new, project)
    return [Analyzed(p, kind_of(p), summaries.get(p, ""), bool(project)) for p in paths]
