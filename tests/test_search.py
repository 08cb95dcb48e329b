import math
import random

import pytest
from pyspark.sql import functions as F

from quillon.operators.boolean import QuerySyntaxError, boolean_matches, boolean_search, holds, parse, terms_of
from quillon.operators.graph import Scratch
from quillon.operators.index import Index, build_index, counted_index, seek
from quillon.operators.metrics import model_metrics, query_metrics
from quillon.operators.ranking import bm25_scores, bm25_search, ranked, tfidf_scores, tfidf_search


def corpus(spark, *docs):
    return spark.createDataFrame([(k, *(d if isinstance(d, tuple) else (d, None))) for k, d in enumerate(docs)], "doc_ord long, title string, abstract string")


def hits(df):
    return {r["doc_ord"]: r["score"] for r in df.collect()}


@pytest.fixture(scope="module")
def small(spark):
    return build_index(corpus(spark, ("Neural networks for image classification", "Deep neural networks classify images."), ("Quantum computing", "Qubits and entanglement."), ("Graph neural networks", "Message passing on graphs."))).persist()


@pytest.fixture(scope="module")
def boolean_docs(spark):
    return build_index(corpus(spark, ("Deep learning for vision", "convolutional networks"), ("Reinforcement learning agents", "reward optimization"), ("Quantum error correction", "stabilizer codes"), ("Deep reinforcement learning", "policy gradients"))).persist()


@pytest.fixture(scope="module")
def fruit(spark):
    return build_index(corpus(spark, "shared banana", "shared cherry kiwi", "shared cherry cherry cherry kiwi", "shared cherry kiwi mango papaya guava lychee durian")).persist()


@pytest.fixture(scope="module")
def cats(spark):
    fill = iter(f"filler{k:03d}x" for k in range(500))
    pad = lambda n: " ".join(next(fill) for _ in range(n))
    return build_index(corpus(spark, f"cat {pad(9)}", f"cat cat {pad(8)}", f"cat cat cat {pad(7)}", "cat " + " ".join(f"zd{k:02d}" for k in range(39)), f"dog bird {pad(8)}", f"bird {pad(9)}", f"bird {pad(9)}")).persist()


def test_index(small):
    post = {(r["term"], r["doc_ord"]): r["tf"] for r in small.postings.collect()}
    assert {d: n for (t, d), n in post.items() if t == "neural"} == {0: 2, 2: 1}
    assert {d for t, d in post if t == "network"} == {0, 2}
    assert {d for t, d in post if t == "graph"} == {2}
    assert not {"networks", "for", "and", "on"} & {t for t, _ in post}
    assert small.corpus_stats.first()["n"] == 3
    assert small.vocabulary_size().first()["terms"] == len({t for t, _ in post})


def test_empty_documents_count(spark):
    index = build_index(corpus(spark, "the of", None, "word"))
    assert index.corpus_stats.first().asDict() == {"n": 3, "avgdl": pytest.approx(1 / 3)}
    assert {r["doc_ord"] for r in boolean_matches(index, "NOT word").collect()} == {0, 1}
    empty = build_index(corpus(spark, "x").where("false"))
    assert empty.corpus_stats.first().asDict() == {"n": 0, "avgdl": 0.0}
    assert bm25_search(empty, "x").count() == 0


def test_index_files(spark, small, tmp_path):
    small.write(str(tmp_path / "index"))
    again = Index.read(spark, str(tmp_path / "index"))
    assert sorted(again.postings.collect()) == sorted(small.postings.collect())
    assert hits(bm25_search(again, "graph")) == hits(bm25_search(small, "graph"))


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        ("learning", {0, 1, 3}), ("deep learning", {0, 3}), ("deep AND learning", {0, 3}), ("deep and learning", {0, 3}), ("quantum OR vision", {0, 2}),
        ("learning AND NOT reinforcement", {0}), ("NOT learning", {2}), ("quantum OR deep AND reinforcement", {2, 3}), ("(quantum OR deep) AND reinforcement", {3}),
        ("agent", {1}), ("agents", {1}), ("the of a", set()), ("blockchain", set()), ("the AND learning", {0, 1, 3}), ("learning AND NOT the", {0, 1, 3}), ("", set()),
        ("NOT NOT learning", {0, 1, 3}), ("NOT deep-learning", {1, 2}),
    ],
)
def test_boolean(boolean_docs, query, expected):
    assert {r["doc_ord"] for r in boolean_matches(boolean_docs, query).collect()} == expected


@pytest.mark.parametrize(("query", "message"), [("deep AND (learning", "missing closing"), ("AND deep", "expected a term, found 'AND'"), ("deep OR", "expected a term, found None"), ("()", r"found '\)'"), ("NOT", "found None"), ("x AND OR y", "found 'OR'"), ("x )", r"unexpected '\)'")])
def test_boolean_errors(query, message):
    with pytest.raises(QuerySyntaxError, match=message):
        parse(query)


def test_boolean_order_and_limit(boolean_docs):
    got = boolean_search(boolean_docs, "learning", 2).collect()
    assert [(r["rank"], r["doc_ord"], r["score"], r["total"]) for r in got] == [(1, 0, None, 3), (2, 1, None, 3)]
    with pytest.raises(ValueError, match="negative"):
        boolean_search(boolean_docs, "x", -1)


def test_boolean_against_sets(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta"]
    docs = [" ".join(w for w in words if rng.random() < 0.5) for _ in range(30)]
    index = build_index(corpus(spark, *docs), stem=False).persist()
    everything = frozenset(range(30))

    def query(depth):
        kind = rng.randrange(5) if depth else 0
        if kind < 2:
            return rng.choice([*words, "the"])
        if kind == 2:
            return f"NOT {query(depth - 1)}"
        return f"({query(depth - 1)} {rng.choice(['AND', 'OR', ''])} {query(depth - 1)})"

    for _ in range(12):
        q = query(3)
        tree = parse(q, lambda w: [] if w == "the" else [w])
        sets = {t: frozenset(k for k, d in enumerate(docs) if t in d.split()) for t in terms_of(tree)}
        expected = holds(tree, sets.__getitem__, lambda a, b: a & b, lambda a, b: a | b, lambda a: everything - a) if tree else frozenset()
        assert {r["doc_ord"] for r in boolean_matches(index, q).collect()} == expected, q


def test_tfidf(fruit):
    assert hits(tfidf_search(fruit, "bananas")) == {0: pytest.approx(1.0)}
    assert hits(tfidf_search(fruit, "shared")) == {} == hits(tfidf_search(fruit, "blockchain"))
    assert hits(tfidf_search(fruit, "cherry")) == {2: pytest.approx(0.828083, abs=1e-6), 1: pytest.approx(0.707107, abs=1e-6), 3: pytest.approx(0.092016, abs=1e-6)}
    got = tfidf_search(fruit, "cherry banana").orderBy("rank").collect()
    assert [(r["doc_ord"], round(r["score"], 6)) for r in got] == [(0, 0.979139), (2, 0.168258), (1, 0.143677), (3, 0.018697)]
    two = tfidf_search(fruit, "cherry", 2).collect()
    assert len(two) == 2
    assert two[0]["total"] == 3
    norms = {r["doc_ord"]: round(r["norm"], 6) for r in fruit.doc_norms().collect()}
    assert norms == {0: 0.60206, 1: 0.17669, 2: 0.222864, 3: 1.357793}


def test_bm25(cats):
    assert hits(bm25_search(cats, "cat")) == {d: pytest.approx(s, abs=1e-6) for d, s in {0: 0.665161, 1: 0.909667, 2: 1.036692, 3: 0.317881}.items()}
    assert hits(bm25_search(cats, "cat", b=0.0)) == {d: pytest.approx(s, abs=1e-6) for d, s in {0: 0.575364, 1: 0.821949, 2: 0.958940, 3: 0.575364}.items()}
    assert hits(bm25_search(cats, "dog bird")) == {d: pytest.approx(s, abs=1e-6) for d, s in {4: 2.890931, 5: 0.955698, 6: 0.955698}.items()}
    assert bm25_search(cats, "blockchain cats").first()["total"] == 4
    assert bm25_search(cats, "blockchain").count() == 0
    twice, once = hits(bm25_search(cats, "cat cat")), hits(bm25_search(cats, "cat"))
    assert all(math.isclose(twice[d], 2 * once[d], abs_tol=1e-9) for d in once)


def test_batches_are_single_queries(cats):
    queries = {1: "cat", 2: "dog bird", 3: "nothing"}
    batch = ranked(bm25_scores(cats, queries), 2).collect()
    for q, text in queries.items():
        assert [(r["rank"], r["doc_ord"], r["score"]) for r in sorted(batch) if r["qid"] == q] == [(r["rank"], r["doc_ord"], r["score"]) for r in sorted(bm25_search(cats, text, 2).collect())]
    assert {r["qid"] for r in tfidf_scores(cats, queries).collect()} == {1, 2}
    with pytest.raises(ValueError, match="negative"):
        ranked(bm25_scores(cats, queries), -1)


def test_metrics(spark):
    ranks = spark.createDataFrame([(1, k + 1, d) for k, d in enumerate("abcde")] + [(2, 1, "x"), (2, 2, "y")], "qid long, rank long, doc string")
    wanted = spark.createDataFrame([(1, ["a", "c", "f", "a"]), (2, ["x", "y"]), (3, ["q"]), (4, [])], "qid long, relevant array<string>")
    got = {r["qid"]: r for r in query_metrics(ranks, wanted).collect()}
    assert got[1]["p5"] == pytest.approx(0.4)
    assert got[1]["r10"] == pytest.approx(2 / 3)
    assert got[1]["ap"] == pytest.approx((1 + 2 / 3) / 3)
    assert got[2]["ap"] == 1.0
    assert (got[3]["p5"], got[3]["r10"], got[3]["ap"]) == (0, 0, 0)
    assert (got[4]["r10"], got[4]["ap"]) == (0, 0)
    means = model_metrics({"m": ranks}, wanted).first()
    assert means["map"] == pytest.approx(sum(r["ap"] for r in got.values()) / 4)
    with pytest.raises(ValueError, match="no judgments"):
        model_metrics({"m": ranks}, wanted.where(F.lit(False)))


def test_counts_shuffle_texts_and_seek_no_words(spark):
    """Words are counted where their text is: the one exchange is that of the texts. What a query needs comes from one pass without any."""
    docs = corpus(spark, *[f"alpha beta word{k} word{k % 3}" for k in range(20)])
    for stem in (False, True):
        plan = build_index(docs, stem=stem).postings._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1
        assert "Join" not in plan
    whole, some = build_index(docs), seek(docs, ["alpha", "word1"], Scratch(spark))
    assert sorted(some.postings.collect()) == sorted(r for r in whole.postings.collect() if r["term"] in ("alpha", "word1"))
    assert sorted(some.doc_stats.collect()) == sorted(whole.doc_stats.collect())
    assert hits(bm25_search(some, "alpha word1", 30)) == hits(bm25_search(whole, "alpha word1", 30))
    assert seek(docs, [], Scratch(spark)).corpus_stats.first() == whole.corpus_stats.first()


def test_df_of_common_and_rare_terms(spark, monkeypatch):
    """The df of common terms is broadcast, that of the others joined; together all counts keep theirs."""
    from quillon.operators import index as module

    monkeypatch.setattr(module, "COMMON", 3)
    docs = corpus(spark, *[f"alpha beta word{k} word{k % 3}" for k in range(20)])
    built = counted_index(docs, Scratch(spark), stem=False)
    df = {r["term"]: r["df"] for r in built.term_stats.collect()}
    got = module.with_df(built.postings, built.term_stats, 2).collect()
    assert sorted((r["term"], r["doc_ord"], r["df"]) for r in got) == sorted((r["term"], r["doc_ord"], df[r["term"]]) for r in built.postings.collect() if df[r["term"]] > 1)
