import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.functions.analyzer import analyze, terms
from quillon.functions.porter import stem


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Up-and-coming (2nd try)?", ["up", "and", "coming", "2nd", "try"]),
        ("x86_64, ARM64;", ["x86", "64", "arm64"]),
        ("", []),
        (None, []),
        ("naïve", ["na", "ve"]),
    ],
)
def test_tokenize(spark, text, expected):
    assert one(spark, tx.tokenize(F.lit(text).cast("string"))) == expected


def test_analyzer_flags(spark):
    cases = [
        ("a bridge over the river", {"stem": False}, ["bridge", "river"]),
        ("Index, indexes; indexing", {}, ["index"] * 3),
        ("Sampling from samples, sampled by a sampler", {}, ["sampl", "sampl", "sampl", "sampler"]),
        ("An Orchard", {"stem": False, "remove_stopwords": False}, ["an", "orchard"]),
        ("An Orchard", {"stem": False}, ["orchard"]),
    ]
    for text, flags, expected in cases:
        assert analyze(text, **flags) == expected
        assert one(spark, terms(F.lit(text), **flags)) == expected


def test_stopwords():
    assert len(tx.STOPWORDS) == len(set(tx.STOPWORDS)) == 127


@pytest.mark.parametrize(("word", "expected"), [x.split(":") for x in "caresses:caress ponies:poni ties:tie skies:sky dying:die news:news agreed:agre plastered:plaster motoring:motor hopping:hop falling:fall hissing:hiss filing:file happy:happi say:say enjoy:enjoy relational:relat conditional:condit digitizer:digit vietnamization:vietnam hopefulness:hope electriciti:electr allowance:allow adoption:adopt probate:probat rate:rate cease:ceas controll:control roll:roll galaxies:galaxi telescopes:telescop analysis:analysi technology:technolog at:at".split()])
def test_stem(word, expected):
    assert stem(word) == expected


@given(st.text(max_size=60))
def test_clean_whitespace_is_pythons(spark, text):
    # surrogates cannot be UTF-8, and a NUL ends nothing
    if any(0xD800 <= ord(c) < 0xE000 for c in text):
        return
    assert one(spark, tx.clean_whitespace(F.lit(text))) == " ".join(text.split())


def test_clean_whitespace_null(spark):
    assert one(spark, tx.clean_whitespace(F.lit(None).cast("string"))) == ""
    assert one(spark, tx.document_text(F.lit("A"), F.lit(None).cast("string"))) == "A"


def test_ids_and_years(spark):
    for raw, expected in (("http://arxiv.org/abs/2401.00001v2", "2401.00001"), ("x/abs/cs/0112017v1", "cs/0112017"), ("x/abs/math.CV/0601001v3", "math.CV/0601001")):
        assert one(spark, tx.id_from_url(F.lit(raw))) == expected
    assert one(spark, tx.year_of(F.lit("2024-01-02"))) == 2024
    assert one(spark, tx.year_of(F.lit("n.d."))) is None
    assert one(spark, tx.normalize_title(F.lit("Sparse Retrieval: A Survey!"))) == "sparseretrievalasurvey"
    none = F.lit(None).cast("string")
    assert one(spark, tx.document_id(F.lit("1.2"), F.lit("s"), F.lit("T"))) == "arxiv:1.2"
    assert one(spark, tx.document_id(F.lit(""), F.lit("s"), F.lit("T"))) == "s2:s"
    assert one(spark, tx.document_id(none, none, F.lit("T " * 60))) == "title:" + "t" * 40


def test_formatting(spark):
    line = tx.hit_line(F.lit(1), F.lit("x" * 100), F.lit(None).cast("int"), F.array(F.lit("a"), F.lit("b")), F.lit(1.5))
    assert one(spark, line) == f"  1. [----] {'x' * 87}...  (a+b)  score=1.5000"
    assert one(spark, tx.hit_line(F.lit(12), F.lit(""), F.lit(2020), F.lit(None).cast("array<string>"), F.lit(None).cast("double"))) == " 12. [2020] (untitled)  (?)"
    assert one(spark, tx.author_line(F.array(*map(F.lit, "abcd")))) == "a, b, c et al."
    assert one(spark, tx.highlight(F.lit("Graphs and graph"), "graphs")) == "<mark>Graphs</mark> and <mark>graph</mark>"
