import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import mixing, quality

from . import brute

SF = "/root/testdata/sf0.001"


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "mixing_to_target_weights"]


def test_run_is_the_plain_pipeline(spark):
    docs, labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    got = corpus_pipeline.run(spark, SF).toPandas().set_index("doc_id")

    model = quality.learn(docs, labels)
    rows = docs.toPandas().set_index("doc_id")
    good = quality.judge(model, rows["text"]) >= 0.5
    rows = rows[good]
    lines = brute.line_dedup(list(rows["text"].items()))
    rows = rows.loc[[i for i in rows.index if not lines[i][1] or lines[i][0].strip()]].copy()
    rows["text"] = [lines[i][0] for i in rows.index]
    rows["n_chars"] = rows["text"].str.len()
    groups = brute.near_components(list(rows["text"].items()))
    rows = rows.loc[[i for i in rows.index if groups[i][1] == i]]
    leaked = {i for i, _ in brute.leaks(list(rows["text"].items()), [(r["item_id"], r["text"]) for r in items.collect()])}
    rows = rows.drop(index=list(leaked))

    rest = spark.createDataFrame(rows.reset_index(), docs.schema)
    topics = {r["doc_id"]: r["topic"] for r in mixing.mixed(rest, mixing.TARGETS).collect()}  # learned; the plain version takes them as they are
    cells = {}
    for r in rows.itertuples():
        cell, tokens = (r.source, r.lang, topics[r.Index]), len(r.text.encode().split())
        if tokens:
            cells[cell] = cells.get(cell, 0) + tokens
    names = sorted(cells)
    _, p = brute.rake(names, [cells[c] for c in names], [mixing.TARGETS.get(d) for d in mixing.DIMENSIONS], mixing.BUDGET)
    u = {r["doc_id"]: r["h"] % (1 << 53) / (1 << 53) for r in rest.select("doc_id", F.xxhash64("doc_id", "text").alias("h")).collect()}
    chance = {r.Index: p.get((r.source, r.lang, topics[r.Index]), 0.0) for r in rows.itertuples()}
    kept = {i for i, q in chance.items() if u[i] < q}
    border = {i for i, q in chance.items() if abs(u[i] - q) < 1e-3}
    assert set(got.index) - border == kept - border
    assert all(got["text"][i] == rows["text"][i] for i in set(got.index) & kept)
    assert set(docs.columns) - {"doc_id"} < set(got.columns)


def test_run_on_odd_documents(spark, tmp_path):
    """Nulls in all columns, repeated rows, one id over unequal texts, empty and long texts, and columns whose names are used inside."""
    text = "Plain words of a first document that says something.\nAnd a second line of it, which nobody else has."
    rows = [(1, text, "en", "a"), (1, text, "en", "a"), (1, "Quite another text under the same number, with words of its own.", None, "b"), (2, None, "en", "a"), (3, "", None, None), (None, "A text that has no number, but words enough to be kept by all.", "de", "b"), (4, "long word " * 20_000, "en", "a"), (5, " \n\t", "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs = docs.withColumns({c: F.lit(k) for k, c in enumerate(["row", "id", "mix", "_doc", "_text", "maybe", "hash", "gone", "tokens", "topic", "h", "kept", "line"])})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").where("false").write.parquet(str(tmp_path / f"{t}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = out.collect()
    assert out.columns == [*docs.columns, "mix_"]
    known = {t for _, t, *_ in rows}
    assert {r["text"] for r in got} <= known
    assert len({(r["doc_id"], r["text"]) for r in got}) == len(got)


@pytest.mark.parametrize("k", range(5))
def test_stages_of_empty_documents(spark, k):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, SF)
    assert out.count() == 0
    assert k == 4 or out.columns == docs.columns
