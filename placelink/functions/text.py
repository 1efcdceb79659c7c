"""Text expressions, all evaluated on the JVM."""

from __future__ import annotations

import hashlib
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Combining marks that a token drops without being split.
MARKS = "̧̨̛̣̤̥̦̭̮̰̱̀́̂̃̄̆̇̈̉̊̋̌̏̑"
#: Letters, digits and private-use characters, and the full stop.
TOKEN = "[\\p{L}\\p{N}\\p{Co}.]+"
#: Fixed values of the ranking function.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


@lru_cache(maxsize=1)
def _plain_letters() -> tuple[str, str]:
    """Lower-case letters with marks over an ASCII letter, and those letters."""
    marked, plain = [], []
    for point in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        low = chr(point).lower()
        base = "".join(c for c in unicodedata.normalize("NFD", low) if unicodedata.category(c) != "Mn")
        if len(low) == 1 and len(base) == 1 and base.isascii() and base != low and low not in marked:
            marked.append(low)
            plain.append(base)
    return "".join(marked), "".join(plain)


def fold(text: Column) -> Column:
    """Lower case without the marks of ASCII letters; other scripts keep theirs."""
    return F.translate(F.regexp_replace(F.lower(text), f"[{MARKS}]", ""), *_plain_letters())


def tokens(text: Column) -> Column:
    """Tokens of a name or query; null for null."""
    return F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0))


def query_text(text: Column) -> Column:
    """A search string without double quotes and outer spaces."""
    return F.trim(F.replace(text, F.lit('"'), F.lit("")))


def soundex(text: Column) -> Column:
    """American Soundex; what is no letter is ignored, '' without letters or for null.

    Letters beyond A-Z act as vowels, but stay if they come first.
    """
    letters = F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), "[^\\p{L}]", "")
    foreign = F.concat(F.substring(letters, 1, 1), F.substring(F.soundex(F.concat(F.lit("A"), letters.substr(F.lit(2), F.length(letters)))), 2, 3))
    return F.when(letters == "", F.lit("")).when(letters.rlike("^[A-Z]"), F.soundex(letters)).otherwise(foreign)


def _processed(text: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "[^\\p{L}\\p{N}_]", " ")))


def levenshtein(a: Column, b: Column) -> Column:
    """Edit distance after lower-casing, with other characters as spaces; null counts as ''."""
    return F.levenshtein(_processed(a), _processed(b))


def phrase_count(held: Column, phrase: Column) -> Column:
    """How often the tokens ``phrase`` stand in a row in ``held``."""
    last = F.size(held) - F.size(phrase) + 1
    places = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.when(F.size(phrase) == 0, 0).otherwise(F.size(F.filter(places, lambda i: F.slice(held, i, F.size(phrase)) == phrase)))


def idf(n_rows: Column, n_with: Column) -> Column:
    raw = F.ln((n_rows - n_with + 0.5) / (n_with + 0.5))
    return F.when(raw <= 0, F.lit(LEAST_IDF)).otherwise(raw)


def impact(tf: Column, length: Column, mean_length: Column) -> Column:
    """What a phrase adds to the score of a name, but for its weight."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))


def bm25(weight: Column, tf: Column, length: Column, mean_length: Column) -> Column:
    """One phrase's part of the score; the more negative the better."""
    return -(weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length)))


def newlines(text: Column) -> Column:
    """CRLF and CR as LF."""
    return F.regexp_replace(text, "\r\n?", "\n")


def span_text(text: Column, start: Column, end: Column) -> Column:
    """``text[start:end]`` in code points, clamped to the text."""
    return text.substr(F.greatest(start, F.lit(0)) + 1, F.greatest(F.least(end, F.length(text)) - F.greatest(start, F.lit(0)), F.lit(0)))


def snippet(text: Column, start: Column, end: Column, around: int = 30) -> Column:
    """The span with ``around`` code points on either side, with dots where text is left out."""
    a, b = F.greatest(start - around, F.lit(0)), F.least(end + around, F.length(text))
    return F.concat(F.when(a > 0, F.lit("...")).otherwise(F.lit("")), text.substr(a + 1, b - a), F.when(b < F.length(text), F.lit("...")).otherwise(F.lit("")))


def description(name: Column, kind: Column, levels: list[Column]) -> Column:
    """``name (kind) in level3, level2, level1`` from what is there; levels come from the top down."""
    some = lambda c: F.nullif(c.cast("string"), F.lit(""))
    named = [some(c) for c in reversed(levels)]
    where = F.concat_ws(", ", *named)
    return F.concat_ws(" ", some(name), F.concat(F.lit("("), some(kind), F.lit(")")), F.when(where != "", F.concat(F.lit("in "), where)))


def escape_html(text: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; norms count as at least 1e-8."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    return dot(a, b) / (F.greatest(F.sqrt(dot(a, a)), F.lit(1e-8)) * F.greatest(F.sqrt(dot(b, b)), F.lit(1e-8)))


def module_text(name: str, config: dict) -> str:
    """A module's canonical text: its name and its settings in order of their keys."""
    return f"{name}({', '.join(f'{k}={config[k]!r}' for k in sorted(config))})"


def module_id(name: str, config: dict) -> str:
    """The first eight hex digits of the digest of a module's canonical text."""
    return hashlib.sha256(module_text(name, config).encode()).hexdigest()[:8]
