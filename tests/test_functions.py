import pytest
from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.functions.values import convert_unit, is_datetime, parse_numeric, split_unit
from tessera.functions.vectors import cosine


def column(spark, values, make, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r["x"] for r in df.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("options", "cases"),
    [
        ({}, {"1,000": 1.0, "1,234,567": None, "1.234.567": None, "1,234.56": 1234.56, "1.234,56": 1234.56, "1 234": 1234.0, "12.5%": 12.5, " 7 ": 7.0, " 1 234 ": 1234.0, "1d": None, "1.5f": None, "1e3": 1000.0, "1e400": None, "-.5": -0.5, "": None, "1_000": None, "abc": None}),
        ({"decimal": ","}, {"10.5": 105.0, "1,5": 1.5}),
        ({"decimal": ",", "thousands": "."}, {"1.000,0": 1000.0}),
        ({"thousands": ","}, {"1,000": 1.0}),
    ],
)
def test_parse_numeric(spark, options, cases):
    assert column(spark, list(cases), lambda v: parse_numeric(v, **options)) == list(cases.values())


def test_special_numbers(spark):
    found = column(spark, ["inf", "-Infinity", "+Inf"], parse_numeric)
    assert found == [float("inf"), float("-inf"), float("inf")]
    assert str(column(spark, ["NaN"], parse_numeric)[0]) == "nan"


def test_is_datetime(spark):
    yes = ["2024-02-29", "2024/01/31", "31/12/2024", "12/31/2024", "2024-01-01 5:04", "2024-01-01 05:04:06.25", "8/5/2024 9:30", "2024-01-01T00:00:00Z", "2024-01-01T10:00:00.5+02:00"]
    no = ["2024-02-30", "2023-02-29", "8/5/2024", "31/31/2024", "2024-01-01T00:00:00", "2024-01-01 24:00", "2024-1-1", "x", "", "13/31/2024 10:00"]
    assert column(spark, yes + no, is_datetime) == [True] * len(yes) + [False] * len(no)


def test_split_unit():
    assert split_unit("Concentration (g/L)") == ("Concentration", "g/L")
    assert split_unit("Temp [°F]") == ("Temp", "°F")
    assert split_unit("sugar_Brix") == ("sugar", "Brix")
    assert split_unit("Dose__mg/L") == ("Dose", "mg/L") and split_unit("Trace - mg/L") == ("Trace", "mg/L")
    assert split_unit("Price (net)") == ("Price", "net")
    assert split_unit("(g/L)") == ("(g/L)", "") and split_unit(" plain ") == ("plain", "")


def test_convert_unit(spark):
    assert column(spark, [212.0], lambda v: convert_unit(v, "°F")[0], "double") == [100.0]
    assert convert_unit(F.lit(1), "kg")[1] == "kg"


def test_tokens_and_cuts(spark):
    texts = ["", "a", "x" * 40, "x" * 399]
    assert column(spark, texts, t.prompt_tokens) == [0, 1, 12, 119]
    assert column(spark, texts, t.chunk_tokens) == [0, 0, 10, 99]
    assert column(spark, ["x" * 500], lambda v: F.length(t.truncate_to_tokens(v, 100))) == [333]
    assert column(spark, ["x"], lambda v: t.truncate_to_tokens(v, 0)) == [""]
    assert column(spark, ["abc", "é" * 201], t.preview) == ["abc", "é" * 200 + "..."]
    assert column(spark, ["", "secret", "sk-12345"], t.mask) == ["", "******", "sk-****345"]
    assert column(spark, ["Q1 Data_2024!", "---", "é"], t.slug) == ["q1-data-2024", "sheet", "sheet"]


def test_text_shapes(spark):
    assert column(spark, ["a\r\nb\rc\n\n\n\nd"], t.normalize_markdown) == ["a\nb\nc\n\nd"]
    assert column(spark, [" <p>a</p><p>b</p> "], t.strip_tags) == ["ab"]
    assert column(spark, [" a \n\n\n\n b\n\n \n\n"], t.paragraphs) == [["a", "b"]]
    assert column(spark, ["abcde", ""], lambda v: t.fixed_pieces(v, 2)) == [["ab", "cd", "e"], []]
    assert column(spark, [{"a": "x" * 40}], t.token_breakdown, "map<string,string>") == [{"a": 12}]


@pytest.mark.parametrize(("glob", "name", "match"), [("*.txt", "report.txt", True), ("*.md", "report.txt", False), ("*.txt", "a/b.txt", False), ("[^a]?.x", "bc.x", True), ("[^a]?.x", "ac.x", False), (r"\*.x", "*.x", True), ("[a", "a", False), ("a+(b)", "a+(b)", True)])
def test_globs(spark, glob, name, match):
    assert column(spark, [name], lambda v: t.allowed(v, [glob])) == [match]
    assert column(spark, [name], lambda v: t.allowed(v, [], [glob])) == [not match]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0]), ([], [])], "a array<float>, b array<float>")
    found = [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()]
    assert found == [pytest.approx(2**-0.5), 0.0, 0.0, 0.0]
