"""A search page over an engine, as a WSGI application of the standard library."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from html import escape
from urllib.parse import parse_qs, urlencode

from pyspark.sql import functions as F

from quillon.engine import Engine, card
from quillon.operators.boolean import QuerySyntaxError
from quillon.operators.corpus import corpus_summary, source_counts

PAGE = 20
#: Suggestions of the empty page.
EXAMPLES = ("graph neural networks", "retrieval augmented generation", "federated learning and privacy", "reinforcement learning from human feedback", "query expansion", "speech translation", "object detection", "causal inference", "time series forecasting", "few shot learning", "knowledge distillation", "model compression")
STYLE = "body{font:16px/1.5 system-ui;max-width:52rem;margin:2rem auto;padding:0 1rem}li{margin:1rem 0}small{color:#555}.bar{height:4px;background:#47a}"


def answer(engine: Engine, query: str, model: str = "bm25") -> dict:
    """What the page shows: hits (as card() has them), total, ms, error. An empty query has neither hits nor error."""
    model = model if model in engine.models else "bm25"
    out = {"query": query.strip(), "model": model, "hits": None, "total": 0, "ms": 0.0, "error": None}
    if out["query"]:
        start = time.perf_counter()
        try:
            out["hits"] = [r.asDict() for r in engine.search(out["query"], model, PAGE).select(*card(out["query"])).orderBy("rank").collect()]
            out["total"] = out["hits"][0]["total"] if out["hits"] else 0
        except QuerySyntaxError as e:
            out["error"] = f"Query error: {e}"
        out["ms"] = (time.perf_counter() - start) * 1000
    return out


def glance(engine: Engine, samples: int = 4) -> dict:
    """What the empty page says of the corpus: how many documents each source has, its years, and some papers of different places in it."""
    summary = corpus_summary(engine.corpus).first().asDict()
    sources = {r["source"]: r["documents"] for r in source_counts(engine.corpus).orderBy(F.desc("documents"), "source").limit(12).collect()}
    some = engine.corpus.orderBy(F.xxhash64("doc_ord")).limit(samples).select("title").collect()
    return {"summary": summary, "sources": sources, "samples": [r["title"] or "(untitled)" for r in some]}


def page(found: dict, statistics: dict) -> str:
    model_options = "".join(f"<option{' selected' if m == found['model'] else ''}>{m}</option>" for m in ("bm25", "tfidf", "boolean"))
    parts = [f"<!DOCTYPE html><meta charset=utf-8><title>Paper search</title><style>{STYLE}</style><form><input name=q size=50 value=\"{escape(found['query'])}\"> <select name=model>{model_options}</select> <button>Search</button></form>"]
    if found["error"]:
        parts.append(f"<p role=alert>{escape(found['error'])}</p>")
    elif found["hits"] is None:
        parts.append("<ul>" + "".join(f'<li><a href="?q={escape(e)}">{escape(e)}</a></li>' for e in EXAMPLES) + "</ul>")
        if about := statistics.get("glance"):
            years = f"{about['summary']['first_year']} to {about['summary']['last_year']}"
            parts.append(f"<table><tr><th>years<td>{years}" + "".join(f"<tr><th>{escape(s)}<td>{n:,}" for s, n in about["sources"].items()) + "</table>")
            parts.append("<p>Some papers:</p><ul>" + "".join(f'<li><a href="?{escape(urlencode({"q": t}))}">{escape(t)}</a></li>' for t in about["samples"]) + "</ul>")
    elif not found["hits"]:
        parts.append(f"<p>No matches for &ldquo;{escape(found['query'])}&rdquo;</p>")
    else:
        note = " · unranked" if found["model"] == "boolean" else ""
        parts.append(f"<p><b>{found['total']:,}</b> match{'es' if found['total'] != 1 else ''} in {found['ms']:.1f} ms{note}</p><ol>")
        for h in found["hits"]:
            line = " · ".join(x for x in (h["year"], escape(h["venue"]), escape(" ".join(h["sources"])), h["cited"]) if x)
            score = f"<div class=bar style='width:{h['bar']:.0f}%' title='relevance score {h['score']:.4f}'></div>" if h["score"] is not None else ""
            parts.append(f"<li><a href=\"{escape(h['url'])}\">{h['title']}</a><br><small>{escape(h['authors'])}</small><br>{h['snippet']}<br><small>{line}</small>{score}</li>")
        parts.append("</ol>")
    parts.append(f"<footer><small>{statistics['documents']:,} documents · {statistics['terms']:,} index terms</small></footer>")
    return "".join(parts)


def application(engine: Engine) -> Callable[[dict, Callable], Iterable[bytes]]:
    statistics = engine.statistics() | {"glance": glance(engine)}

    def run(environ: dict, start_response: Callable) -> Iterable[bytes]:
        asked = parse_qs(environ.get("QUERY_STRING", ""))
        body = page(answer(engine, asked.get("q", [""])[0], asked.get("model", ["bm25"])[0]), statistics).encode()
        start_response("200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(body)))])
        return [body]

    return run
