"""Delimited files read in splits, against Spark's own reader of whole files."""

import random

import pytest

from tessera.sources.delimited import ROW, _opening, ends_inside, read_delimited


@pytest.fixture
def small_splits(spark):
    """Splits of a few lines, so that many tasks read one file."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda size: [spark.conf.set(k, v) for k, v in zip(held, (str(size), "1"), strict=True)]
    for k, v in held.items():
        spark.conf.set(k, v)


def whole(spark, path, sep):
    """A file read by one task."""
    return spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", True).option("ignoreLeadingWhiteSpace", sep != "\t").csv(path)


def ordered(df):
    return [tuple(r)[:-1] for r in df.orderBy(ROW).collect()]


@pytest.mark.parametrize(("seed", "size", "sep", "eol"), [(1, 97, ",", "\n"), (2, 331, ",", "\r\n"), (3, 97, "\t", "\n"), (4, 1024, ",", "\n"), (5, 41, ",", "\n")])
def test_quoted_line_feeds_over_split_borders(spark, tmp_path, small_splits, seed, size, sep, eol):
    r = random.Random(seed)

    def cell():
        quoted = ["", "q", "a\nb", "\n\n", 'say ""hi""', f"x{sep}y", '""', "line\n\nmore\n" * r.randint(1, 20)]
        return r.choice([r.choice(["", "x", "12", " a b", "é", '5" pipe', 'a"b"c', 'x"']), f'"{r.choice(quoted)}"', "w" * r.randint(0, 9)])

    rows = [sep.join(cell() for _ in range(r.choice([3, 3, 3, 2, 4]))) if r.random() < 0.95 else "" for _ in range(200)]
    path = tmp_path / "some file.csv"
    path.write_bytes(eol.join(["", sep.join(["h1", "h 2", "h3" if eol == "\r\n" else '"h\n3"']), *rows]).encode() + eol.encode() * (seed % 2))
    small_splits(size)
    found = read_delimited(spark, f"file://{path}", sep)
    assert spark.read.text(f"file://{path}").rdd.getNumPartitions() > 3
    expected = whole(spark, f"file://{path}", sep)
    assert found.columns == [*expected.columns, ROW]
    assert ordered(found) == [tuple(x) for x in expected.collect()]


def test_lines_stay_lines(spark, tmp_path, small_splits):
    """Without line feeds in cells nothing goes through Python, and the file is read in splits."""
    path = tmp_path / "plain.csv"
    path.write_text("a,b\n" + "".join(f'{i},"x{i}"\n' for i in range(500)))
    small_splits(400)
    found = read_delimited(spark, f"file://{path}")
    assert ordered(found) == [(str(i), f"x{i}") for i in range(500)] and found.rdd.getNumPartitions() > 3
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()


def test_several_files_and_empty_ones(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text('x,y\n1,"p\nq"\n  \n2,\n')
    (tmp_path / "b.csv").write_text("x,y\n3,r\n")
    (tmp_path / "c.csv").write_text("")
    small_splits(6)
    assert ordered(read_delimited(spark, f"file://{tmp_path}/*.csv")) == [("1", "p\nq"), (None, None), ("2", None), ("3", "r")]
    assert read_delimited(spark, f"file://{tmp_path}/c.csv").columns == [ROW] and read_delimited(spark, f"file://{tmp_path}/c.csv").count() == 0
    (tmp_path / "d.csv").write_text('x,y\n1,"never closed\n2,z\n')
    assert ordered(read_delimited(spark, f"file://{tmp_path}/d.csv")) == [("1", "never closed\n2,z")]
    (tmp_path / "e.tsv").write_text("x\ty\tz\n\t\t\n\t2\t\n")
    assert ordered(read_delimited(spark, f"file://{tmp_path}/e.tsv")) == [(None, None, None), (None, "2", None)]


def test_where_lines_end():
    comma = _opening(",", True)
    cases = {('a,"b', False): True, ('a,"b""', False): True, ('a,"b"', False): False, ('5" x', False): False, ('b",c', True): False, ('b"",c', True): True, ('b","c', True): True, ("b", True): True, ('"', False): True, ('""', False): False, ('"""', False): True, (' "x', False): True}
    assert {k: ends_inside(*k, comma) for k in cases} == cases
    assert not ends_inside(' "x', False, _opening("\t", False))
