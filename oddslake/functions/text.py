"""Text helpers with the Unicode behaviour the label rules need.

Spark has no NFKC or full case folding of its own. Texts that are not ASCII go to an Arrow function;
for the others, the common case, only a null crosses to the worker. The function is deterministic, so
filters on other columns still reach the scan.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}\p{N}_"
# Fixed value: the line ends that split a text into lines.
LINE_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def ascii_only(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def _arrow_text(change: Callable[[str], str]) -> Callable[[Column], Column]:
    """A text function over Arrow batches; it is sent by value, so workers need no package."""

    def run(texts: pa.Array) -> pa.Array:
        if texts.null_count == len(texts):
            return pa.nulls(len(texts), pa.string())
        return pa.array([None if t is None else change(t) for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")


def _beyond_ascii(text: Column, change: Callable[[str], str], ascii_form: Column) -> Column:
    other = F.when(~ascii_only(text), text)
    return F.when(other.isNotNull(), _arrow_text(change)(other)).otherwise(ascii_form)


def nfkc(text: Column) -> Column:
    from unicodedata import normalize

    return _beyond_ascii(text, lambda t: normalize("NFKC", t), text)


def casefold(text: Column) -> Column:
    return _beyond_ascii(text, lambda t: t.casefold(), F.lower(text))


def python_lines(text: Column) -> Column:
    return F.split(text, LINE_ENDS)


def term_body(term: str) -> str:
    """A term as a pattern: words joined by any run of blanks, underscores or hyphens."""
    words = re.split(r"[\s_-]+", term.casefold())
    return r"[\s\x1c-\x1f_-]+".join(re.sub(r"([^\w])", r"\\\1", word) for word in words)


def term_pattern(*terms: str) -> str:
    """Whole-word, case-insensitive pattern matching any of the terms."""
    return rf"(?iuUd)(?<![{WORD}])(?:{'|'.join(term_body(t) for t in terms)})(?![{WORD}])"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits.

    A text can only hold a term if the term's runs follow one another among its tokens, which is far
    cheaper to test than the pattern. The few letters whose lower case is not what a
    case-insensitive pattern compares are mapped by hand, where there are any.
    """
    special = text.contains("İ") | text.contains("ı") | F.lower(text).contains("ς") | text.contains("Σ")
    mapped = F.translate(F.lower(F.translate(text, "İı", "ii")), "ς", "σ")
    lowered = F.when(~ascii_only(text) & special, mapped).otherwise(F.lower(text))
    # A pattern in split is compiled for every row.
    return F.split(F.regexp_replace(lowered, r"[^\p{L}\p{N}]+", " "), " ")


def term_tokens(term: str) -> list[str]:
    """The runs of letters and digits of a term, as :func:`tokens` gives them."""
    return re.findall(r"[^\W_]+", term.casefold().replace("ς", "σ"))
