"""Strata of source code: a label for every character, from a whole file at a time.

These need a tokenizer with state over the file, so they are Arrow-batched Python functions; a file is
the unit, and nothing depends on other files.
"""

from __future__ import annotations

import io
import keyword
import re
import tokenize
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_KINDS = {
    tokenize.NUMBER: "numeric", tokenize.STRING: "string", tokenize.COMMENT: "comment", tokenize.OP: "syntax",
    tokenize.NEWLINE: "whitespace", tokenize.NL: "whitespace", tokenize.INDENT: "whitespace", tokenize.DEDENT: "whitespace",
}

#: A comment, a quoted run (closed or to the end) or anything else, in this order.
_JS = re.compile(r"""(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>(?P<q>["'`])(?:\\.|(?!(?P=q)).)*(?:(?P=q)|\Z))""", re.S)


#: Every stratum; in texts' strata each is a letter, from a on in this order.
NAMES = ("syntax", "keyword", "identifier", "string", "comment", "numeric", "whitespace", "other", "code")
_LETTER = {name: chr(ord("a") + i) for i, name in enumerate(NAMES)}


def _python(code: str) -> bytes:
    """Letters of ``python_strata``."""
    labels = bytearray(_LETTER["other"].encode() * len(code))
    starts = [0, *(m.end() for m in re.finditer("\n", code))]
    try:
        found = list(tokenize.generate_tokens(io.StringIO(code).readline))
    except (tokenize.TokenError, SyntaxError):
        return bytes(labels)
    for token in found:
        if token.type == tokenize.NAME:
            kind = "keyword" if keyword.iskeyword(token.string) else "identifier"
        else:
            kind = _KINDS.get(token.type, "other")
        first, last = (min(starts[row - 1] + col, len(code)) if row <= len(starts) else len(code) for row, col in (token.start, token.end))
        labels[first:last] = _LETTER[kind].encode() * (last - first)
    return bytes(labels)


def _javascript(code: str) -> bytes:
    """Letters of ``js_strata``."""
    labels = bytearray(_LETTER["code"].encode() * len(code))
    for m in _JS.finditer(code):
        labels[m.start() : m.end()] = _LETTER["comment" if m.lastgroup == "comment" else "string"].encode() * (m.end() - m.start())
    return bytes(labels)


def python_strata(code: str) -> list[str]:
    """syntax, keyword, identifier, string, comment, numeric, whitespace or other for every character.
    A file that the tokenizer gives up on is other throughout."""
    return [NAMES[x - ord("a")] for x in _python(code)]


def js_strata(code: str) -> list[str]:
    """code, string or comment for every character. Regular-expression literals and template
    substitutions are not told apart."""
    return [NAMES[x - ord("a")] for x in _javascript(code)]


_LETTERS = {"python": _python, "javascript": _javascript}


def _column(fn) -> Column:
    @F.pandas_udf(StringType())
    def each(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else fn(t).decode())

    return each


def with_strata(documents: str | Column, language: str) -> Column:
    """A letter (see ``NAMES``) for each character of the text column."""
    return _column(_LETTERS[language])(documents)


def counted_strata(documents: DataFrame, language: str | None = None) -> DataFrame:
    """stratum, n of the characters of documents with strata. With a ``language`` strata are made and counted text
    by text, and none are sent or held for others."""
    fn = None if language is None else _LETTERS[language]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(NAMES), np.int64)
        for batch in batches:
            for value in batch.column(0):
                shown = value.as_py().encode() if fn is None else fn(value.as_py())
                n += np.bincount(np.frombuffer(shown, np.uint8) - ord("a"), minlength=len(NAMES))
        yield pa.RecordBatch.from_arrays([pa.array(NAMES), pa.array(n)], names=["stratum", "n"])

    rows = documents.select("strata" if fn is None else "text").mapInArrow(run, "stratum string, n long")
    return rows.groupBy("stratum").agg(F.sum("n").alias("n")).where("n > 0")
