import json

import pytest

from quillon.cli import answer, grid, main
from quillon.engine import Engine
from quillon.web import application

DOCS = [
    {"doc_ord": 0, "doc_id": "arxiv:1", "title": "Graph <neural> networks", "abstract": "Message passing on graphs. " * 20, "authors": ["A", "B", "C", "D"], "year": 2020, "venue": "V", "citation_count": 1234, "url": "u0", "sources": ["arxiv", "s2"]},
    {"doc_ord": 1, "doc_id": "arxiv:2", "title": "Quantum graphs", "abstract": "Qubits.", "authors": [], "year": None, "venue": None, "citation_count": 0, "url": None, "sources": ["s2"]},
    {"doc_ord": 2, "doc_id": "arxiv:3", "title": "Cooking", "abstract": "Bread and dough", "authors": ["E"], "year": 2021, "venue": None, "citation_count": None, "url": "u2", "sources": []},
]
SCHEMA = "doc_ord long, doc_id string, title string, abstract string, authors array<string>, year int, venue string, citation_count long, url string, sources array<string>"


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([tuple(d.values()) for d in DOCS], SCHEMA)


@pytest.fixture(scope="module")
def engine(corpus):
    return Engine.over(corpus)


def test_models(engine):
    for model in ("bm25", "tfidf", "boolean"):
        assert {r["doc_id"] for r in engine.search("graphs", model).collect()} == {"arxiv:1", "arxiv:2"}
    assert engine.statistics()["documents"] == 3


def test_lines(engine):
    text = answer(engine, "graph", "boolean", 1)
    assert text.startswith("boolean: 2 found, 1 shown in the order of the corpus")
    assert "  1. [2020] Graph <neural> networks  (arxiv+s2)" in text
    assert answer(engine, "(graph", "boolean", 5) == "cannot read this query: missing closing parenthesis"
    assert answer(engine, "nothing", "bm25", 5).startswith("bm25: 0 found, 0 shown")
    assert answer(engine, "graph", "bm25", 0).startswith("bm25: 2 found, 0 shown")


def test_grid():
    assert grid(("a", "number"), [("x", 1234), ("long", None)]).splitlines() == ["a    | number", "-----+-------", "x    |  1,234", "long |"]


def get(app, query):
    status = []
    return b"".join(app({"QUERY_STRING": query}, lambda s, h: status.append(s))).decode(), status[0]


def test_page(engine):
    app = application(engine)
    home, status = get(app, "")
    assert status == "200 OK"
    assert "3 documents" in home
    assert "<tr><th>s2<td>2" in home
    assert "Graph &lt;neural&gt; networks" in home
    body, _ = get(app, "q=graphs&model=unknown")
    assert "<mark>Graph</mark> &lt;neural&gt; networks" in body
    assert "A, B, C et al." in body
    assert "cited 1,234" in body
    assert "n.d." in body
    assert "width:100%" in body
    assert "Query error: missing closing parenthesis" in get(app, "q=(graph&model=boolean")[0]
    assert "No matches for &ldquo;zzz&rdquo;" in get(app, "q=zzz")[0]


def test_commands(spark, corpus, tmp_path, capsys):
    path, index = str(tmp_path / "corpus"), str(tmp_path / "index")
    corpus.write.parquet(path)
    (tmp_path / "j.json").write_text(json.dumps([{"query": "graphs", "relevant": ["arxiv:1"]}, {"query": "dough", "relevant": ["arxiv:3"]}]))
    main(["index", "--corpus", path, "--out", index], spark)
    main(["search", "--corpus", path, "--index", index, "--query", "graphs"], spark)
    main(["evaluate", "--corpus", path, "--judgments", str(tmp_path / "j.json"), "--per-query"], spark)
    main(["cluster", "--corpus", path, "--k", "2"], spark)
    out = capsys.readouterr().out
    assert "documents        | 3.0000" not in out
    assert "documents" in out
    assert "bm25: 2 found" in out
    assert "dough" in out
    assert "#0" in out
