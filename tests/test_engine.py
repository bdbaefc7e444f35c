"""Indexing and asking end to end, the services' retries, the stream, and the entry module."""

import importlib
import os
import subprocess
import sys

import pytest

from codexmill import errors, services
from codexmill.plans.index import Engine, report
from codexmill.sources import project, store
from codexmill.streaming import incremental

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def source(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    (root / "pay.py").write_text("def pay(amount):\n    check(amount)\n    return send(amount)\n\ndef check(amount):\n    return amount > 0\n")
    (root / "bank.sol").write_text("contract Bank { function put(uint a) public { log(a); } function log(uint a) private {} }")
    (root / "bad.py").write_bytes(b"def ok():\n    pass  # \xff\n")
    (root / ".git").mkdir()
    (root / ".git" / "x.py").write_text("def hidden(): pass\n")
    return str(root)


@pytest.fixture(scope="module")
def engine(spark, source, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("index")), embedder=services.HashEmbedder(128))
    with pytest.raises(errors.IndexMissingError):
        e.query("anything")
    result = e.index(source)
    assert result.success and (result.functions, result.chunks, result.embeddings) == (5, 5, 5)
    return e


def test_index_and_query(spark, engine):
    assert sorted(r.name for r in engine.functions().collect()) == ["Bank.log", "Bank.put", "bad.ok", "pay.check", "pay.pay"]
    result = engine.query("pay amount check send", rerank_top_k=2)
    assert result.success and len(result.reranked) == 2 and result.prompt.endswith("Question: pay amount check send") and result.answer
    assert result.reranked[0]["node_id"].split(":")[2].startswith("pay.")
    text = report(result, when="now")
    assert "## Matches" in text and result.reranked[0]["node_id"] in text


def test_failures_that_do_not_end_a_query(engine):
    class Broken:
        def generate(self, prompt, config):
            raise ValueError("no")

    engine, engine.generator = engine, Broken()
    result = engine.query("pay")
    engine.generator = services.ExtractiveGenerator()
    assert not result.success and result.prompt and "no" in result.message


def test_store_rules(spark, engine):
    before = engine.vectors().count()
    engine.store.save_vectors(spark.createDataFrame([], "vector array<float>, text string, node_id string, filename string"))
    assert engine.vectors().count() == before
    with pytest.raises(errors.StorageError):
        engine.store.save_vectors(spark.createDataFrame([([1.0], "t", "", "f")], "vector array<float>, text string, node_id string, filename string"))


def test_empty_and_missing_projects(spark, tmp_path):
    with pytest.raises(errors.ExtractionError):
        Engine(spark, str(tmp_path / "i")).index(str(tmp_path / "none"))
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "readme.md").write_text("nothing to parse")
    result = Engine(spark, str(tmp_path / "j")).index(str(tmp_path / "p"))
    assert (result.functions, result.nodes, result.chunks) == (0, 0, 0)


def test_languages_of_a_project(spark, source):
    assert {r.language: r.n for r in project.project_languages(project.list_files(spark, source)).collect()} == {"python": 2, "solidity": 1}


def test_stream_appends_each_file_once(spark, source, tmp_path):
    out, checkpoint = str(tmp_path / "functions"), str(tmp_path / "checkpoint")
    for _ in range(2):
        incremental.append_functions(spark, source, out, checkpoint).awaitTermination(120)
    assert spark.read.parquet(out).where("file_path NOT LIKE '%.git%'").count() == 5


def test_clear_keeps_vectors(spark, engine):
    assert "functions" in engine.clear() and not engine.is_indexed() and engine.vectors().count() == 5
    assert store.exists(spark, engine.store.path("vectors"))


def test_retries():
    slept, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("HTTP 503 unavailable")
        return "ok"

    assert services.retrying(flaky, slept.append)() == "ok" and slept == [2, 4]
    with pytest.raises(RuntimeError):
        services.retrying(lambda: (_ for _ in ()).throw(RuntimeError("generate failed")), slept.append)()
    assert slept == [2, 4]
    always = lambda: (_ for _ in ()).throw(services.Transient("x"))
    with pytest.raises(services.Transient):
        services.retrying(always, slept.append)()
    assert slept == [2, 4, 2, 4, 8, 16]
    assert "".join(services.stream_answer(services.ExtractiveGenerator(), "[Chunk 1]\nx\nQuestion: q")) == "Question: q\n[Chunk 1] x\n"


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and len(names) >= 44


def test_entry_without_the_training_data_subpackage(tmp_path):
    """The rest imports, and registers its queries, when that folder is gone."""
    for x in ("codexmill", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", os.path.join(ROOT, x), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "codexmill" / "llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'knn_l2' in q and not any(x.startswith('op') or x == 'pipeline' for x in q), q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_it():
    for folder, _, files in os.walk(os.path.join(ROOT, "codexmill")):
        if os.sep + "llm" not in folder:
            for name in files:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name)) as f:
                        assert "codexmill.llm" not in f.read() and importlib
