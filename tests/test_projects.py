import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

import pytest

from tessera.operators import projects, versions
from tessera.operators.projects import Project

DOCS = "id string, path string, name string, description string, text string, tokens int, added_at timestamp"
NEW = "path string, name string, description string, text string"


def test_save_and_load(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    docs = projects.add_documents(spark.createDataFrame([], DOCS), spark.createDataFrame([("a.txt", "a", "", "x" * 40)], NEW))
    projects.save(docs, Project("p", instructions="sum up", max_tokens=5), path)
    found, project = projects.load(spark, path)
    assert found.first()["tokens"] == 12 and (project.instructions, project.max_tokens) == ("sum up", 5)
    with pytest.raises(ValueError, match="already"):
        projects.add_documents(found, spark.createDataFrame([("a.txt", "b", "", "y")], NEW))
    with pytest.raises(ValueError, match="exceed"):
        projects.add_documents(found, spark.createDataFrame([("b.txt", "b", "", "y" * 700_000)], NEW))
    projects.save(projects.add_documents(found, spark.createDataFrame([("b.txt", "b", "", "y")], NEW)), project, path)
    assert projects.load(spark, path)[0].count() == 2


def test_request(spark):
    project = Project("p", model="openai/gpt-4o")
    asked = projects.request(spark, "x" * 4000, project)
    assert (asked.model, asked.tokens, asked.max_tokens, asked.temperature) == ("openai/gpt-4o", 1200, 1024, 0.7)
    assert asked.cost == pytest.approx(1.2 * 0.005 + 1.024 * 0.015)
    assert projects.request(spark, "x" * 4000, project, prompt_limit=100).tokens <= 100
    with pytest.raises(ValueError, match="budget"):
        projects.request(spark, "x" * 4000, project, budget=0.001, dry_run=True)
    assert projects.request(spark, "x", project, context_cap=10).warnings
    with pytest.raises(ValueError, match="context"):
        projects.request(spark, "x" * 40_000, project, model="llama3:latest", local=True)
    assert projects.request(spark, "x" * 40_000, project, model="?", local=True, budget=1e-9).cost == 0
    assert json.loads(projects.written("hi", asked, "json"))["output"] == "hi" and projects.written("hi", asked) == "hi"


def test_two_writers_lose_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    projects.save(spark.createDataFrame([], DOCS), Project("p"), path)
    new = [spark.createDataFrame([(f"{w}-{i}.txt", "n", "", "x") for i in range(3)], NEW) for w in range(6)]
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda d: projects.append(d, path), new))
    docs, project = projects.load(spark, path)
    assert sorted(r["path"] for r in docs.collect()) == sorted(f"{w}-{i}.txt" for w in range(6) for i in range(3)) and project.version == "7"
    # who rewrites an old version learns of it; of two who add one path, one does
    with pytest.raises(versions.Conflict):
        projects.save(docs, replace(project, version="6"), path)
    with ThreadPoolExecutor(2) as pool:
        both = [pool.submit(projects.append, spark.createDataFrame([("same.txt", "n", "", "x")], NEW), path) for _ in range(2)]
    assert sorted(type(f.exception()).__name__ for f in both) == ["NoneType", "ValueError"]
    versions.vacuum(spark, path)
    assert projects.load(spark, path)[0].count() == 19


def test_a_number_is_given_once(spark, tmp_path):
    folder = f"file://{tmp_path}/v"
    with ThreadPoolExecutor(8) as pool:
        given = list(pool.map(lambda i: versions.put(spark, folder, 1, {"folders": [], "by": i}), range(8)))
    assert given.count(True) == 1 and versions.latest(spark, folder) == (1, {"folders": [], "by": given.index(True)})
    made = versions.commit(spark, folder, lambda n, record: {"folders": [], "n": n})
    assert made == (2, {"folders": [], "n": 1}) and versions.numbers(spark, folder) == [1, 2]
    with pytest.raises(FileNotFoundError):
        projects.load(spark, f"file://{tmp_path}/none")
