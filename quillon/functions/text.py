"""Scalar text functions as Columns of the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that the analyzer leaves out.
STOPWORDS = tuple(
    """a about above after again against all am an and any are as at be because been before being below between both but by
    can cannot could did do does doing down during each few for from further had has have having he her here hers herself him
    himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our
    ours ourselves out over own same she should so some such than that the their theirs them themselves then there these they
    this those through to too under until up very was we were what when where which while who whom why will with would you
    your yours yourself yourselves""".split()
)

#: White space as Python's str.split() has it; Java's \s is ASCII only.
SPACE = r"[\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def or_empty(c: Column | str) -> Column:
    return F.coalesce(_c(c), F.lit(""))


def tokenize(text: Column | str) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text; other letters split words. A null has none."""
    return F.regexp_extract_all(F.lower(or_empty(text)), F.lit("[a-z0-9]+"), F.lit(0))


def without_stopwords(tokens: Column | str) -> Column:
    return F.filter(_c(tokens), lambda t: ~t.isin(*STOPWORDS))


def clean_whitespace(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(or_empty(text), SPACE, " "))


def document_text(title: Column | str, abstract: Column | str) -> Column:
    """Title and abstract as one cleaned text; either may be null."""
    return clean_whitespace(F.concat_ws(" ", _c(title), _c(abstract)))


def strip_version(paper_id: Column | str) -> Column:
    return F.regexp_replace(_c(paper_id), "v[0-9]+$", "")


def id_from_url(url: Column | str) -> Column:
    return strip_version(F.substring_index(_c(url), "/abs/", -1))


def normalize_title(title: Column | str) -> Column:
    return F.regexp_replace(F.lower(or_empty(title)), "[^a-z0-9]+", "")


def year_of(date: Column | str) -> Column:
    """The year a date text begins with, else null."""
    head = F.substring(or_empty(date), 1, 4)
    return F.when(head.rlike("^[0-9]{1,4}$"), head.try_cast("int"))


def null_if_empty(c: Column | str) -> Column:
    return F.nullif(_c(c), F.lit(""))


def document_id(arxiv_id: Column | str, s2_id: Column | str, title: Column | str) -> Column:
    first, second = null_if_empty(arxiv_id), null_if_empty(s2_id)
    return F.when(first.isNotNull(), F.concat(F.lit("arxiv:"), first)).when(second.isNotNull(), F.concat(F.lit("s2:"), second)).otherwise(F.concat(F.lit("title:"), F.left(normalize_title(title), F.lit(40))))


def is_number(term: Column | str) -> Column:
    return _c(term).rlike("^[0-9]+$")


def clip(text: Column | str, most: int, mark: str = "...") -> Column:
    """A text of more than `most` characters cut to that length, mark included."""
    c = _c(text)
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most - len(mark))), F.lit(mark))).otherwise(c)


def hit_line(rank: Column | str, title: Column | str, year: Column | str, sources: Column | str, score: Column | str) -> Column:
    """A hit as one line of a terminal."""
    shown = clip(F.trim(F.coalesce(null_if_empty(title), F.lit("(untitled)"))), 90)
    when = F.when(F.coalesce(_c(year), F.lit(0)) != 0, _c(year).cast("string")).otherwise(F.lit("----"))
    where = F.when(F.size(F.coalesce(_c(sources), F.array().cast("array<string>"))) > 0, F.array_join(_c(sources), "+")).otherwise(F.lit("?"))
    points = F.when(_c(score).isNull(), F.lit("")).otherwise(F.format_string("  score=%.4f", _c(score)))
    return F.concat(F.format_string("%3d. [", _c(rank)), when, F.lit("] "), shown, F.lit("  ("), where, F.lit(")"), points)


def author_line(authors: Column | str, shown: int = 3) -> Column:
    names = F.coalesce(_c(authors), F.array().cast("array<string>"))
    return F.concat(F.array_join(F.slice(names, 1, shown), ", "), F.when(F.size(names) > shown, F.lit(" et al.")).otherwise(F.lit("")))


def truncate(text: Column | str, most: int, leeway: int = 5) -> Column:
    """Cut to `most` characters, mark included, if a text is longer than that and some more, as page templates do."""
    c = or_empty(text)
    return F.when(F.length(c) <= most + leeway, c).otherwise(F.concat(F.left(c, F.lit(most - 3)), F.lit("...")))


# Words that are not marked in a hit.
_UNMARKED = ("and", "or", "not", "the", "of", "for", "with", "in", "on", "to", "a")


def highlight(text: Column | str, query: str) -> Column:
    """The query's longer words, and words that share their beginning, inside <mark>."""
    import re

    words = [w for w in re.findall("[a-z0-9]+", query.lower()) if len(w) > 2 and w not in _UNMARKED]
    heads = sorted({w if len(w) <= 4 else w[: max(4, len(w) - 2)] for w in words})
    return or_empty(text) if not heads else F.regexp_replace(or_empty(text), rf"(?i)\b((?:{'|'.join(heads)})\w*)", "<mark>$1</mark>")
