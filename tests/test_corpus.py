import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators.cluster import assignments, cluster_sizes, fit_topics, representatives, silhouette_scan, top_terms, vectorize
from quillon.operators.corpus import corpus_summary, source_counts, top_categories
from quillon.operators.merge import RECORD, in_file_order, in_order, merge_records
from quillon.sources import collectors
from quillon.sources.records import SCHOLAR_RECORD, atom_entries, atom_records, read_atom, read_judgments, read_jsonl, scholar_records, write_jsonl
from quillon.streaming.refresh import latest, refresh_corpus

FEED = """<?xml version="1.0" encoding="UTF-8"?><feed xmlns="http://www.w3.org/2005/Atom"><updated>2020-05-06</updated>
<entry><published>2019-11-30T10:00:00Z</published><category term="stat.ME"/><author><name>Ada Quint</name></author><author><name>Bo Rask</name></author>
<title>Counting  tides
 by night</title><id>http://arxiv.org/abs/1911.07777v3</id><summary> Water that comes and goes. </summary></entry>
<entry><id>http://arxiv.org/abs/hep-th/9905111v1</id><title>On strings of beads</title><summary>Beads on a wire.</summary><published>1999-05-14T00:00:00Z</published><category term="hep-th"/><category term="math.CO"/><author><name>Cy Tan</name></author></entry>
<entry><title>Too many requests</title><id>http://arxiv.org/api/wait</id><summary>later</summary></entry></feed>"""

SCHOLAR = {"paperId": "s1", "title": "Counting tides by night", "abstract": "word " * 40, "year": 2023, "authors": [{"authorId": "1", "name": "Ada Quint"}], "externalIds": {"ArXiv": "1911.07777", "DOI": "10.5555/Tide.9"}, "url": "u", "citationCount": 42, "fieldsOfStudy": ["CS"], "venue": "Shorelines"}


def scholar(spark, *raw):
    return spark.read.schema(SCHOLAR_RECORD).json(spark.sparkContext.parallelize([json.dumps(r) for r in raw]))


def test_atom(spark, tmp_path):
    (tmp_path / "a.xml").write_text(FEED)
    pages = spark.createDataFrame([(FEED,)], "page string")
    for entries in (read_atom(spark, str(tmp_path / "a.xml")), atom_entries(pages)):
        got = {r["arxiv_id"]: r for r in atom_records(entries).collect()}
        assert set(got) == {"1911.07777", "hep-th/9905111"}
        assert got["1911.07777"]["title"] == "Counting tides by night"
        assert got["1911.07777"]["authors"] == ["Ada Quint", "Bo Rask"]
        assert got["hep-th/9905111"]["categories"] == ["hep-th", "math.CO"]
        assert got["hep-th/9905111"]["year"] == 1999
        assert got["1911.07777"]["url"] == "https://arxiv.org/abs/1911.07777"


def test_scholar(spark):
    got = scholar_records(scholar(spark, SCHOLAR, SCHOLAR | {"paperId": "s2", "abstract": "too short"}, SCHOLAR | {"paperId": "s3", "title": None})).collect()
    assert [r["s2_id"] for r in got] == ["s1"]
    assert got[0]["doi"] == "10.5555/tide.9"


def test_merge_sources(spark):
    feed = atom_records(atom_entries(spark.createDataFrame([(FEED,)], "page string")).withColumn("ord", F.col("n")))
    got = {r["doc_id"]: r for r in merge_records(in_order(feed, scholar_records(scholar(spark, SCHOLAR).withColumn("ord", F.lit(0)))), 10).collect()}
    assert set(got) == {"arxiv:1911.07777", "arxiv:hep-th/9905111"}
    both = got["arxiv:1911.07777"]
    assert (both["citation_count"], both["venue"], both["sources"], both["categories"], both["s2_id"]) == (42, "Shorelines", ["arxiv", "semantic_scholar"], ["stat.ME"], "s1")
    assert sorted(r["doc_ord"] for r in got.values()) == [0, 1]


def test_merge_by_title_rescues_a_short_abstract(spark):
    rows = [(0, "Sparse Retrieval: A Survey!", "a" * 50), (1, "sparse retrieval - a survey", "b" * 80), (2, None, "c" * 90), (3, None, "c" * 90)]
    got = merge_records(spark.createDataFrame(rows, "ord long, title string, abstract string"), 60).orderBy("doc_ord").collect()
    assert [(r["title"], len(r["abstract"])) for r in got] == [("Sparse Retrieval: A Survey!", 80), (None, 90), (None, 90)]


def plain_documents(rows):
    """Documents as lists of places of records, one record after the other."""
    homes, docs = [], []  # (key, number of document); {places, keys by kind}
    for place, r in enumerate(rows):
        own = {"a": r["arxiv_id"], "d": r["doi"], "t": "".join(c for c in (r["title"] or "").lower() if c.isascii() and c.isalnum())}
        own = {kind: v for kind, v in own.items() if v}
        meets = [n for key in own.items() for k, n in homes if k == key]
        if meets:
            doc = docs[meets[0]]
            doc["keys"] = {k: v for k, v in own.items() if k != "t"} | doc["keys"]
        else:
            docs.append(doc := {"places": [], "keys": own, "n": len(docs)})
        doc["places"].append(place)
        homes += [(key, doc["n"]) for key in doc["keys"].items() if key not in [k for k, _ in homes]]
    return [d["places"] for d in docs]


@pytest.mark.parametrize("keys", [60, 12])
def test_merge_is_the_plain_one(spark, keys):
    rng = random.Random(keys)
    names = [f.name for f in RECORD.fields]
    rows = []
    for k in range(300):
        r = dict.fromkeys(names)
        r |= {"arxiv_id": rng.choice([None, "", f"a{rng.randrange(keys)}"]), "doi": rng.choice([None, f"d{rng.randrange(keys)}"]), "title": rng.choice([None, f"T {rng.randrange(keys)}", f"t{rng.randrange(keys)}!"]), "abstract": "x" * rng.randrange(5) + str(k), "year": rng.choice([None, 0, 2000 + k % 9]), "authors": rng.choices("pqr", k=3), "citation_count": rng.choice([None, k]), "sources": [rng.choice("uv")]}
        rows.append(r)
    df = spark.createDataFrame([(k, *r.values()) for k, r in enumerate(rows)], "ord long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RECORD.fields))
    expected = []
    for places in plain_documents(rows):
        mine = [rows[p] for p in places]
        first = lambda c: next((r[c] for r in mine if r[c]), mine[0][c])  # noqa: E731, B023
        authors = list(mine[0]["authors"])
        for a in (a for r in mine[1:] for a in r["authors"]):
            authors += [a] if a not in authors else []
        longest = max(mine, key=lambda r: len(r["abstract"]))["abstract"]
        expected.append((first("arxiv_id"), first("doi"), mine[0]["title"], longest, first("year"), authors, max((r["citation_count"] for r in mine if r["citation_count"] is not None), default=None), sorted({s for r in mine for s in r["sources"]})))
    expected = [e for e in expected if len(e[3]) >= 3]
    got = merge_records(df, 3).orderBy("doc_ord").collect()
    assert [tuple(r[c] for c in ("arxiv_id", "doi", "title", "abstract", "year", "authors", "citation_count", "sources")) for r in got] == expected


def test_rows_keep_the_order_of_their_files(spark, tmp_path):
    for name in ("b", "a", "c"):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"x": f"{name}{k}"}) + "\n" for k in (3, 1, 2)))
    got = in_file_order(read_jsonl(spark, str(tmp_path))).orderBy("ord").collect()
    assert [r["x"] for r in got] == [f"{n}{k}" for n in "abc" for k in (3, 1, 2)]


def test_stats(spark):
    df = spark.createDataFrame([(["a"], ["x", "y"], 2000, "aa"), (["a", "b"], ["x"], 0, "aaaa"), (["b"], [], None, "")], "sources array<string>, categories array<string>, year int, abstract string")
    assert corpus_summary(df).first().asDict() == {"documents": 3, "in_several_sources": 1, "first_year": 2000, "last_year": 2000, "mean_abstract": 2.0}
    assert {r["source"]: r["documents"] for r in source_counts(df).collect()} == {"a": 2, "b": 2}
    assert [tuple(r) for r in top_categories(df).collect()] == [("x", 2), ("y", 1)]


def test_json_files(spark, tmp_path):
    df = spark.createDataFrame([("é", None), ("b", 2)], "a string, b long")
    write_jsonl(df, str(tmp_path / "x"))
    assert sorted(map(tuple, read_jsonl(spark, str(tmp_path / "x"), df.schema).collect()), key=str) == sorted([("é", None), ("b", 2)], key=str)
    (tmp_path / "bad.jsonl").write_text('{"a": "x"}\n\n{"a": ')
    with pytest.raises(Exception, match="(?i)malformed"):
        read_jsonl(spark, str(tmp_path / "bad.jsonl"), df.schema).collect()
    (tmp_path / "j.json").write_text(json.dumps([{"query": "q0", "relevant": ["a"]}, {"query": "q1", "relevant": []}], indent=1))
    assert [(r["qid"], r["query"], r["relevant"]) for r in read_judgments(spark, str(tmp_path / "j.json")).orderBy("qid").collect()] == [(0, "q0", ["a"]), (1, "q1", [])]


def test_feed_pages():
    asked, slept = [], []
    pages = iter([(500, "down"), (200, FEED), (200, "<feed/>"), (200, FEED), (200, "<feed/>"), (200, "<feed/>")])
    got = list(collectors.feed_pages("cs.IR", 600, sleep=slept.append, get=lambda url: asked.append(url) or next(pages)))
    assert len(got) == 2
    assert "start=200" in asked[-1]
    with pytest.raises(RuntimeError):
        collectors.feed_page("u", lambda _: None, lambda _: (0, "no"))


def test_bulk_records():
    answers = iter([(429, ""), (200, json.dumps({"data": [SCHOLAR, SCHOLAR | {"abstract": ""}], "token": "t"})), (200, json.dumps({"data": [SCHOLAR] * 3}))])
    got = list(collectors.bulk_records("q", 2019, 3, sleep=lambda _: None, get=lambda *_: next(answers)))
    assert len(got) == 4
    with pytest.raises(RuntimeError, match="answered 500"):
        collectors.bulk_answer({}, sleep=lambda _: None, get=lambda *_: (500, ""))
    with pytest.raises(RuntimeError, match="limiting"):
        collectors.bulk_answer({}, sleep=lambda _: None, get=lambda *_: (429, ""))


def test_collectors_over_http(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from urllib.parse import parse_qs, urlparse

    class Service(BaseHTTPRequestHandler):
        def do_GET(self):
            q = parse_qs(urlparse(self.path).query)
            text = (FEED if q["start"] == ["0"] else "<feed/>") if "start" in q else json.dumps({"data": [SCHOLAR, SCHOLAR]})
            self.send_response(200)
            self.end_headers()
            self.wfile.write(text.encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    feed = collectors.collect_feed(spark, ["cs.IR", "cs.DL"], 200, url=url, delay=0)
    assert sorted(r["arxiv_id"] for r in feed.collect()) == ["1911.07777", "hep-th/9905111"]
    bulk = collectors.collect_bulk(spark, ["q"], 5, url=url, delay=0)
    assert [r["s2_id"] for r in bulk.collect()] == ["s1"]
    server.shutdown()


COOKING = ["knead the dough with flour and yeast", "bake bread dough in the oven with flour", "flour, yeast and dough for baking bread", "oven baked bread with flour dough yeast"]
STARS = ["telescopes observe distant galaxies and stars", "galaxies and stars in the night sky telescope", "a telescope in 2024 saw galaxies and stars in 2024", "stars of galaxies observed by telescopes 2024"]


def test_topics(spark):
    docs = spark.createDataFrame([(k, t, None) for k, t in enumerate(COOKING + STARS + [""])], "doc_ord long, title string, abstract string")
    v = vectorize(docs)
    assert v.vectors.count() == 9
    model = fit_topics(v.vectors.where("doc_ord < 8"), 2, starts=4)
    found = assignments(model, v.vectors.where("doc_ord < 8"))
    label = {r["doc_ord"]: r["cluster"] for r in found.collect()}
    assert len({label[k] for k in range(4)}) == len({label[k] for k in range(4, 8)}) == 1
    assert label[0] != label[4]
    terms = {}
    for r in top_terms(model, v.vocabulary).collect():
        terms.setdefault(r["cluster"], []).append(r["term"])
    assert {"galaxi", "telescop"} & set(terms[label[4]])
    assert {"dough", "flour"} & set(terms[label[0]])
    assert not any("2024" in t for t in terms.values())
    assert all(label[r["doc_ord"]] == r["cluster"] for r in representatives(found).collect())
    assert [r["documents"] for r in cluster_sizes(found).collect()] == [4, 4]
    scan = silhouette_scan(v.vectors.where("doc_ord < 8"), 2, 3, starts=1)
    assert scan["silhouette"][0] > 0


def test_refresh(spark, tmp_path):
    folder, corpus = tmp_path / "in", str(tmp_path / "corpus")
    folder.mkdir()
    text = "word " * 30
    (folder / "a.json").write_text(json.dumps({"arxiv_id": "1", "title": "One", "abstract": text, "sources": ["arxiv"], "ord": 0}) + "\n")
    refresh_corpus(spark, str(folder), corpus, str(tmp_path / "c")).awaitTermination()
    (folder / "b.json").write_text("\n".join(json.dumps(r) for r in ({"arxiv_id": "1", "title": "1", "abstract": text, "venue": "V", "sources": ["s2"], "ord": 1}, {"s2_id": "9", "title": "Two", "abstract": text, "sources": ["s2"], "ord": 2})) + "\n")
    refresh_corpus(spark, str(folder), corpus, str(tmp_path / "c")).awaitTermination()
    got = {r["doc_id"]: r for r in latest(spark, corpus).collect()}
    assert set(got) == {"arxiv:1", "s2:9"}
    assert (got["arxiv:1"]["venue"], got["arxiv:1"]["doc_ord"], got["arxiv:1"]["sources"]) == ("V", 0, ["arxiv", "s2"])
    assert latest(spark, str(tmp_path / "none")) is None


def test_topics_are_plain_kmeans_and_the_silhouette_is_of_all_pairs(spark, monkeypatch):
    """Lloyd's fixed point, the least cost, and silhouettes of all rows whatever the blocks: against plain numpy."""
    from quillon.operators import cluster

    rng = np.random.default_rng(1)
    rows = [(int(i), [0, 1 + int(i) % 3, 4 + int(i) % 5], [float(x) for x in rng.random(3) + [0, 3, 0]]) for i in range(60)] + [(60, [], [])]
    vectors = spark.createDataFrame(rows, "doc_ord long, places array<int>, values array<double>").repartition(3)
    x = np.zeros((61, 9))
    for i, p, v in rows:
        x[i, p] = v
    monkeypatch.setattr(cluster, "SHARED", 9 * 4 * 8 * 2)
    model = fit_topics(vectors, 4, starts=5)
    d = np.sqrt(((x[:, None] - model.centers[None]) ** 2).sum(axis=2))
    got = {r["doc_ord"]: (r["cluster"], r["distance"]) for r in assignments(model, vectors).collect()}
    assert all(got[i] == (d[i].argmin(), pytest.approx(d[i].min())) for i in range(61))
    label = d.argmin(axis=1)
    assert np.allclose(model.centers, [x[label == c].mean(axis=0) for c in range(4)], atol=1e-3)
    assert model.cost == pytest.approx((d.min(axis=1) ** 2).sum(), rel=1e-3)
    monkeypatch.setattr(cluster, "BLOCK", 16)
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    each = []
    for i in range(61):
        a = far[i][(label == label[i]) & (np.arange(61) != i)]
        b = min(far[i][label == c].mean() for c in set(label) - {label[i]})
        each.append((b - a.mean()) / max(a.mean(), b) if len(a) else 0.0)
    assert cluster.silhouettes(vectors, [model, model]) == [pytest.approx(np.mean(each))] * 2
