"""From files to a project, and from a project to its prompt."""

import zipfile

import pytest

from tessera.operators import generate, projects, versions
from tessera.operators.projects import Project
from tessera.sources import documents

DOCS = "id string, path string, name string, description string, text string, tokens int, added_at timestamp"
NEW = "path string, name string, description string, text string"


def letters():
    def embed(texts):
        return [[float(x.lower().count(c)) for c in "abcdefghijklmnopqrstuvwxyz"] for x in texts]

    return embed


def test_from_project_to_prompt(spark, tmp_path):
    project, index = f"file://{tmp_path}/p", f"file://{tmp_path}/i"
    projects.save(spark.createDataFrame([], DOCS), Project("p", instructions="zebra zoo"), project)
    with pytest.raises(ValueError, match="no documents"):
        generate.prepare(spark, project, index, letters())
    projects.append(spark.createDataFrame([("a", "animals", "", "zebra zoo zone"), ("b", "birds", "", "eee eee"), ("c", "none", "", "zz")], NEW), project)
    first = generate.prepare(spark, project, index, letters(), generate.Retrieval(k=2, exclude=("none",)))
    assert (first.written, first.removed) == (2, 0) and [r["doc_name"] for r in first.evidence] == ["animals", "birds"]
    assert first.prompt.index("-- 1) animals (chunk 0) --\nzebra zoo zone") < first.prompt.index("[REFERENCE DOCUMENTS]") < first.prompt.index("--- Document: animals ---")
    assert first.tokens == len(first.prompt) * 3 // 10

    def instructions_only(texts):
        assert texts == ["zebra zoo"], "nothing else should be embedded"
        return letters()(texts)

    again = generate.prepare(spark, project, index, instructions_only, generate.Retrieval(k=2, exclude=("none",)))
    assert (again.prompt, again.written, again.removed) == (first.prompt, 0, 0) and versions.latest(spark, index)[0] == 1
    # another document: its chunk alone is embedded
    projects.append(spark.createDataFrame([("d", "zebras", "", "zebra zebra zoo")], NEW), project)
    later = generate.prepare(spark, project, index, letters(), generate.Retrieval(k=1, exclude=("none",)))
    assert (later.written, later.removed) == (1, 0) and [r["doc_name"] for r in later.evidence] == ["zebras"]
    assert generate.prepare(spark, project, index, letters(), generate.Retrieval(min_score=1.5, exclude=("none",))).prompt == generate.prepare(spark, project, index, letters(), None).prompt


def test_content_digests(spark):
    rows = [("1", "a", "x"), ("2", "b", None), ("3", None, "y")]
    digest = lambda r: generate.content_digest(spark.createDataFrame(r, "id string, name string, text string"))
    assert digest(rows) == digest(rows[::-1]) and digest([]) == digest([])
    assert len({digest(r) for r in (rows, rows[:2], [*rows, rows[0], rows[0]], [("1", "a", "z"), *rows[1:]], [])}) == 5


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.CSV").write_text("date,share\n2024-01-01,12.5%\n")
    (tmp_path / "in/b.tsv").write_text("x\ty\n1\t2\n")
    (tmp_path / "in/c.md").write_bytes(b"x\r\n\r\n\r\n\r\ny")
    (tmp_path / "in/d.unknown").write_text("as it is <b>")
    (tmp_path / "in/e").write_text("")
    with zipfile.ZipFile(tmp_path / "in/f.docx", "w") as z:
        z.writestr("word/document.xml", "<w:p>Hello</w:p>")
    return tmp_path


def test_every_file_is_a_table_or_a_document(spark, folder):
    found = {r["name"]: (r["kind"], r["content"]) for r in documents.parse_files(spark, [f"{folder}/in/*"]).collect()}
    assert set(found) == {"a.CSV", "b.tsv", "c.md", "d.unknown", "e", "f.docx"}
    assert found["c.md"] == ("document", "x\n\ny") and found["d.unknown"] == ("document", "as it is <b>") and found["e"] == ("document", "") and found["f.docx"] == ("document", "Hello")
    assert found["a.CSV"][0] == found["b.tsv"][0] == "table" and "- share [%]: numeric" in found["a.CSV"][1]
    assert documents.parse_files(spark, [f"{folder}/in/c.md"]).count() == 1 and documents.parse_files(spark, [f"{folder}/none"]).count() == 0


def test_batches_go_into_a_project(spark, folder):
    listed = documents.analyze_files(spark, [f"{folder}/in/*"], str(folder / "out"))
    assert [(a.path.rsplit("/", 1)[1], a.kind, bool(a.summary), a.added) for a in listed][:3] == [("a.CSV", "table", True, False), ("b.tsv", "table", True, False), ("c.md", "document", False, False)] and len(listed) == 6
    project = f"file://{folder}/p"
    projects.save(spark.createDataFrame([], DOCS), Project("p"), project)
    assert all(a.added for a in documents.analyze_files(spark, [f"{folder}/in/*"], str(folder / "out2"), project=project))
    docs = {r["name"]: r for r in projects.load(spark, project)[0].collect()}
    assert set(docs) == {"a.summary.md", "b.summary.md", "c.md", "d.unknown", "e", "f.docx"} and docs["c.md"]["path"] == f"{folder}/in/c.md"
    with pytest.raises(ValueError, match="already"):
        documents.analyze_files(spark, [f"{folder}/in/c.md"], str(folder / "out3"), project=project)
