import statistics
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.operators import catalog, chunks, groups, index, profile, prompts, report
from tessera.sources import documents, workbooks
from tessera.sources.delimited import ROW, read_delimited
from tessera.streaming.profile import hourly_profile

EUROPE = """Group;Concentration (g/L);Temp (°F);Score;LocaleNumber;Category
A;0,5;68;10,0;1.000,0;alpha
A;0,6;70;10,5;1.050,0;alpha
B;0,7;72;9,5;950,0;beta
B;;73;9,9;990,0;beta

A;3,0;95;50,0;5.000,0;gamma
A;0,65;71;10,1;;alpha
"""
OPTIONS = profile.ProfileOptions(max_rows=5, group_by=("group", "none"), correlations=True, correlations_per_group=True, outliers=True, decimal=",", thousands=".", sample_rows=2)


@pytest.fixture(scope="module")
def europe(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("csv") / "europe.csv"
    path.write_text(EUROPE, encoding="utf-8")
    return read_delimited(spark, f"file://{path}", ";")


def test_report(europe):
    found = report.analyze(europe, [ROW], "europe.csv", OPTIONS)
    assert (found.rows, found.processed, len(found.samples)) == (6, 5, 2)
    by = {c["name"]: c for c in found.columns}
    assert [by[n]["kind"] for n in ("Group", "Concentration", "Temp", "Score", "Category")] == ["categorical", "numeric", "numeric", "numeric", "categorical"]
    grams = [500.0, 600.0, 700.0, 3000.0]
    assert (by["Concentration"]["unit"], by["Concentration"]["missing"], by["Temp"]["unit"]) == ("mg/L", 1, "°C")
    assert by["Concentration"]["mean"] == pytest.approx(statistics.mean(grams)) and by["Concentration"]["std"] == pytest.approx(statistics.stdev(grams))
    assert by["Category"]["top"][:2] == [("alpha", 2), ("beta", 2)]
    assert [(g["key"], g["n"]) for g in found.groups] == [("Group=A", 3), ("Group=B", 2)]
    text = report.markdown(found)
    for part in ("[DATASET SUMMARY]", "Rows: ~6 (processed 5)", "- Concentration [mg/L]: numeric (non-null 4, missing 20.0%)", "[GROUP-BY SUMMARY]", "[PER-GROUP CORRELATIONS]", "[CORRELATIONS]", "[HEAD AND SAMPLE ROWS]", "processed only 5/6 rows due to MaxRows"):
        assert part in text


def test_examples_of_texts(spark):
    rows = [(i, "" if i % 3 == 0 else f" text {i} " + "x" * 70, None if i < 4 else f"other {i} " + "y" * 70, i) for i in range(20)]
    table = spark.createDataFrame(rows, "__row int, `a b` string, c string, n int").repartition(3)
    for most in (1000, 0):
        by = {c["name"]: c for c in report.analyze(table, ["__row"], options=profile.ProfileOptions(max_rows=most)).columns}
        assert [e.split(" x")[0][:6] for e in by["a b"]["examples"]] == ["text 1", "text 2", "text 4"] and [e[:7] for e in by["c"]["examples"]] == ["other 4", "other 5", "other 6"]


def test_column_cap(europe):
    found = report.analyze(europe, [ROW], options=profile.ProfileOptions(max_columns=3))
    assert len(found.columns) == 3 and found.warnings == ["dropped 3 column(s) due to MaxColumns limit"]


def test_outliers(spark):
    numbers = [float(x) for x in (1, 2, 2, 3, 3, 3, 4, 50)]
    table = spark.createDataFrame([("a", x) for x in numbers] + [("few", 1.0)] * 7 + [("flat", 5.0)] * 8, "k string, x double")
    found = {r["k"]: r for r in profile.robust_outliers(table, ["k"], "x", 0).collect()}
    assert set(found) == {"a", "flat"} and found["flat"]["max_abs_z"] == 0
    median = statistics.median(numbers)
    mad = statistics.median(abs(x - median) for x in numbers)
    assert found["a"]["n_outliers"] == 1 and found["a"]["max_abs_z"] == pytest.approx(0.6745 * (50 - median) / mad)


def test_missing_and_kinds(spark):
    table = spark.createDataFrame([("", "1", "2024-01-01", "x" * 70), (None, "a", "b", "y" * 70), (" \t", "2", "2024-01-02", None)], "e string, tie string, d string, long string")
    found = {r["name"]: r for r in profile.column_summary(profile.cells(table)).collect()}
    assert [found[c]["kind"] for c in ("e", "tie", "d", "long")] == ["unknown", "numeric", "datetime", "text"]
    assert found["e"]["missing"] == 3 and found["tie"]["std"] == pytest.approx(statistics.stdev([1, 2]))


def test_correlations_of_constants(spark):
    table = spark.createDataFrame([(0.1, float(i), 2.0 * i, None) for i in range(5)], "c double, x double, y double, n double")
    found = {(r["a"], r["b"]): r["r"] for r in groups.correlation_pairs(table, ["c", "x", "y", "n"]).collect()}
    assert found[("c", "x")] == 0 and found[("x", "y")] == pytest.approx(1) and ("x", "n") not in found


def test_group_key_of_awkward_headers(spark):
    table = spark.createDataFrame([("y", None, "a|b")], "`Who (x)` string, Where string, WHO2 string").withColumnRenamed("WHO2", "WHO")
    assert table.select(groups.group_key(table, ["who", " where ", "none"]).alias("k")).first()["k"] == "WHO=a/b | Where="
    assert groups.group_key(table, ["nothing"]) is None


P = ["x" * 40, "y" * 40, "z" * 40]


@pytest.mark.parametrize(
    ("parts", "most", "overlap", "expected"),
    [
        (P, 20, 0, [[0, 1], [2]]),
        (P, 20, 5, [[0, 1], [1, 2]]),
        (["a" * 1200, "b" * 1200], 400, 60, [[0], [0, 1]]),
        (["a" * 400, "b" * 200, "c" * 3600], 400, 60, [[0, 1], "c1600", "c1600", "c400", [1]]),
    ],
)
def test_chunk_rules(parts, most, overlap, expected):
    found = chunks.split_text("\n\n".join(parts), most, overlap)
    assert found == [e[0] * int(e[1:]) if isinstance(e, str) else "\n\n".join(parts[i] for i in e) for e in expected]


def test_greedy_fold_equals_rules(spark):
    text = "\n\n".join("p" * (40 * (i % 5 + 1)) for i in range(40))
    df = spark.createDataFrame([(1, "n", text), (2, "n", ""), (3, "n", None)], "doc_id int, source string, text string")
    folded = df.select(F.explode(chunks.greedy_chunks(F.col("text"), 50)).alias("c")).collect()
    assert [r["c"] for r in folded] == chunks.split_text(text, 50)
    assert [r["chunk_id"] for r in chunks.chunks(df, most=50, per_document=2).orderBy("chunk_id").collect()] == [0, 1]


def test_index_reuse(spark, tmp_path):
    # functions of a test module can't be sent to tasks by name
    def fake_embed(texts):
        return [[float(len(x)), 1.0] for x in texts]

    def no_embed(texts):
        raise AssertionError("nothing should be embedded")

    docs = spark.createDataFrame([(1, "a.txt", "one\n\ntwo"), (2, "b.md", "three"), (3, "c.log", "four")], "doc_id long, source string, text string")
    built, meta = index.build(docs, fake_embed, index.IndexMeta(model="m"), exclude=["*.log"])
    assert built.count() == 2 and meta.dim == 2
    index.save(built, meta, f"file://{tmp_path}/index")
    old, old_meta = index.load(spark, f"file://{tmp_path}/index")
    assert old_meta.model == "m" and old.count() == 2
    again, again_meta = index.build(docs, no_embed, index.IndexMeta(model="m"), old=old, old_meta=old_meta, exclude=["*.log"])
    assert again.count() == 2 and again_meta.created == meta.created
    forced, _ = index.build(docs, fake_embed, index.IndexMeta(model="other"), old=old, old_meta=old_meta)
    assert forced.count() == 3
    assert index.search(again, [5.0, 1.0], k=1).first()["doc_name"] == "b.md"
    queries = spark.createDataFrame([(1, [5.0, 1.0])], "query_id int, query array<double>")
    assert index.search_many(again, queries, k=1).first()["doc_name"] == "b.md"


def test_search_of_many_queries_in_blocks(spark):
    """More queries than a block may have give what one block gives."""
    records = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(40)], "vec_id long, vector array<double>")
    queries = spark.createDataFrame([(i, [1.0, float(i), 0.5]) for i in range(23)] + [(None, [1.0, 1.0, 1.0])], "query_id long, query array<double>")
    search = lambda most: sorted(index.search_many(records, queries, k=3, ties=("vec_id",), most_queries=most).select("query_id", "place", "vec_id").collect(), key=str)
    assert search(5) == search(100) and len(search(5)) == 24 * 3


def test_catalog(spark):
    models = catalog.builtin(spark)
    assert models.count() == 17 and catalog.preset(spark, "gemini").count() == 2 and catalog.preset(spark, "x") is None
    assert catalog.recommended("", "cheap") == "deepseek/deepseek-r1:free" and catalog.recommended("local", "cheap") is None
    asked = spark.createDataFrame([("openai/gpt-4o", 1000), ("?", 1000)], "model string, n int")
    found = catalog.with_prices(asked, models).select("model", catalog.cost(F.col("n"), F.lit(1000)).alias("cost")).collect()
    assert {r["model"]: r["cost"] for r in found} == {"openai/gpt-4o": pytest.approx(0.02), "?": 0.0}


def test_prompt(spark):
    docs = spark.createDataFrame([("p", "2", "b", "", "B", ""), ("p", "1", "a", "first", "A", "x")], "project string, id string, name string, description string, text string, path string")
    blocks = prompts.prompt_documents(docs).first()["prompt_docs"]
    assert blocks.index("--- Document: a (first) ---") < blocks.index("--- Document: b ---")
    prompt = prompts.build_prompt("Do it", blocks)
    assert prompts.with_context(prompt, [("a", 0, "chunk")]).index("[RETRIEVED CONTEXT]") < prompt.index("[TASK]")
    with pytest.raises(ValueError):
        prompts.build_prompt("x", "")
    assert prompts.retrieval_settings() == (6, 0.0) and prompts.retrieval_settings(0, -1, 3, 0.2) == (3, 0.2)
    found = prompts.evidence_documents(docs).orderBy("place").collect()
    assert [r["is_derived"] for r in found] == [False, True]
    text = report.evidence_markdown({"name": "p", "model": "m"}, [r.asDict() | {"tokens": 1} for r in found], [])
    assert "1. a — first" in text and "(derived/analysis artifact)" in text


def workbook(path):
    sheets = '<sheet name="Ignore" sheetId="1" r:id="rId1"/><sheet name="Data" sheetId="2" r:id="rId2"/>'
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{sheets}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>name</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData/></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet xmlns="{main}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>n</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>5</v></c></row><row/></sheetData></worksheet>')


def test_workbook(spark, tmp_path):
    workbook(tmp_path / "w.xlsx")
    for choice in ({"sheet": "DATA"}, {"index": 2}):
        found = workbooks.read_workbook(spark, f"file://{tmp_path}/w.xlsx", **choice)
        assert found.columns == ["name", "", "n", ROW]
        assert [tuple(r)[:3] for r in found.orderBy(ROW).collect()] == [("rich", "", "5"), ("", "", "")]
    with pytest.raises(Exception, match="no sheet"):
        workbooks.read_workbook(spark, f"file://{tmp_path}/w.xlsx", "nope")
    assert workbooks.read_workbook(spark, f"file://{tmp_path}/w.xlsx").columns == [ROW]


def test_paths_and_references():
    cases = {"worksheets/sheet1.xml": "xl/worksheets/sheet1.xml", "/xl/worksheets/sheet1.xml": "xl/worksheets/sheet1.xml", "xl/worksheets/sheet1.xml": "xl/worksheets/sheet1.xml", "../xl/a.xml": "xl/a.xml"}
    assert [workbooks.part_path(x) for x in cases] == list(cases.values())
    assert [workbooks.column_index(x) for x in ("A1", "Z9", "AA10", "7")] == [0, 25, 26, -1]
    assert workbooks.leading_int("12ab") == 12 and workbooks.leading_int("x") == 0


def test_documents(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"x\r\n\r\n\r\n\r\ny")
    (tmp_path / "b.txt").write_bytes(b"raw\r\n")
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        z.writestr("word/document.xml", "<w:p>Hello</w:p><w:p>World</w:p>")
    found = {r["name"]: r["content"] for r in documents.read_documents(spark, f"file://{tmp_path}").collect()}
    assert found == {"a.md": "x\n\ny", "b.txt": "raw\r\n", "c.docx": "HelloWorld"}


def test_files_in_a_row(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "metrics.csv").write_text("date,share\n2024-01-01,12.5%\n2024-01-02,13%\n")
    written = documents.analyze_files(spark, [str(tmp_path / "*/*.csv"), str(tmp_path / "a/metrics.csv")], str(tmp_path / "out"))
    assert [w.summary.rsplit("/", 1)[1] for w in written] == ["metrics.summary.md", "metrics__2.summary.md"]
    assert "- share [%]: numeric" in open(written[0].summary).read() and "- date: datetime" in documents.table_document(spark, str(tmp_path / "a/metrics.csv"))


def test_stream_equals_table(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(2).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/in")
    run = hourly_profile(stream).writeStream.format("memory").queryName("hourly").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    key = lambda df: sorted((r["hour"], r["event_type"], r["n"], r["min"], r["max"]) for r in df.collect())
    assert key(spark.table("hourly")) == key(hourly_profile(events))


def test_typed_cells_need_no_parsing(spark):
    rows = [(1, 1.5, "1,5"), (None, float("nan"), " 2,5 "), (3, float("inf"), ""), (4, -2.5, "x")]
    table = spark.createDataFrame(rows, "whole long, real double, spelled string")
    found = profile.cells(table, profile.ProfileOptions(decimal=",", thousands="."))
    kinds = {(r["name"], r["value"]): (r["kind"], r["number"]) for r in found.collect()}
    assert kinds["whole", "1"] == ("numeric", 1.0) and kinds["whole", ""] == ("missing", None)
    assert kinds["real", "1.5"] == ("numeric", 1.5) and kinds["real", "-2.5"] == ("numeric", -2.5)  # no locale
    assert kinds["real", "Infinity"][1] == float("inf") and kinds["real", "NaN"][0] == "numeric"
    assert kinds["spelled", "1,5"] == ("numeric", 1.5) and kinds["spelled", "2,5"] == ("numeric", 2.5)
    assert kinds["spelled", "x"] == ("text", None) and kinds["spelled", ""] == ("missing", None)
