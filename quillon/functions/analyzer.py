"""The analyzer: tokenize, leave out stopwords, stem. Each part can be switched off."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.porter import stem as stem_word
from quillon.functions.text import STOPWORDS, tokenize, without_stopwords


def analyze(text: str | None, remove_stopwords: bool = True, stem: bool = True) -> list[str]:
    """On the driver, for queries."""
    words = re.findall("[a-z0-9]+", (text or "").lower())
    if remove_stopwords:
        words = [w for w in words if w not in STOPWORDS]
    return [stem_word(w) for w in words] if stem else words


def stemmed(words: Column) -> Column:
    """Stems of single words, by an Arrow-batched function; apply it to distinct words."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(stem_word, na_action="ignore")

    return run(words)


def stemmed_all(tokens: Column) -> Column:
    """Stems of arrays of words, by an Arrow function; each distinct word of a batch is stemmed once, the others are looked up by Arrow."""

    @F.arrow_udf("array<string>")
    def run(words: pa.Array) -> pa.Array:
        coded = words.flatten().dictionary_encode()
        stems = pa.array([stem_word(w) for w in coded.dictionary.to_pylist()], pa.string())
        sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
        offsets = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
        return pa.ListArray.from_arrays(offsets, stems.take(coded.indices), mask=pc.is_null(words))

    return run(tokens)


def terms(text: Column | str, remove_stopwords: bool = True, stem: bool = True) -> Column:
    """An array of terms in order, repeats kept. Without stemming it stays in the JVM."""
    out = tokenize(text)
    if remove_stopwords:
        out = without_stopwords(out)
    return stemmed_all(out) if stem else out
