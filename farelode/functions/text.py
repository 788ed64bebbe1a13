"""Text expressions: columns in, columns out, nothing leaves the JVM.

White space means the white space of all scripts; words and word boundaries are those of all letters and digits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
LEFT, RIGHT = rf"(?<!{WORD})", rf"(?!{WORD})"
STRINGS = "array<string>"


def none_of(kind: str = STRINGS) -> Column:
    """A typed empty array."""
    return F.array().cast(kind)


def squeezed(text: Column) -> Column:
    """White space runs as one space, null as empty; ends not trimmed."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"{SPACE}+", " ")


def lowered(text: Column) -> Column:
    """Squeezed, trimmed and in lower case: the form that classifiers look at."""
    return F.lower(F.trim(squeezed(text)))


def bare_clause(text: Column) -> Column:
    """Squeezed, without spaces, hyphens and bullets at the ends."""
    return F.regexp_replace(squeezed(text), r"^[ \t\r\n\-•]+|(?<![ \t\r\n\-•])[ \t\r\n\-•]+$", "")


def or_null(text: Column) -> Column:
    """Trimmed, blank as null."""
    return F.nullif(F.regexp_replace(text, rf"^{SPACE}+|(?<!{SPACE}){SPACE}+$", ""), F.lit(""))


def number_or_zero(value: Column) -> Column:
    """A number, also one written as text; 0 where there is none."""
    return F.coalesce(value.cast("string").try_cast("double"), F.lit(0.0))


def words(text: Column) -> Column:
    """The parts between white space, without empty ones."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), rf"{SPACE}+"), lambda w: w != "")


def search_tokens(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9 with at least two characters; other letters part them."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0), lambda t: F.length(t) > 1)


def gram_words(text: Column) -> Column:
    """Lower-case runs of at least two letters, digits or underscores of any script: the words of the vector model."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"{WORD}{{2,}}"), 0)


def with_pairs(w: Column) -> Column:
    """Words and pairs of neighbouring words. The words are used several times, so they should stand in a column."""
    pairs = F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(none_of())
    return F.concat(w, pairs)


def grams(text: Column) -> Column:
    """The words of the vector model and pairs of neighbouring ones."""
    return with_pairs(gram_words(text))


def distinct_ignoring_case(items: Column) -> Column:
    """The items in order, each spelling's first; nulls are dropped."""

    def add(seen: Column, x: Column) -> Column:
        return F.when(x.isNull() | F.exists(seen, lambda y: F.lower(y) == F.lower(x)), seen).otherwise(F.array_append(seen, x))

    return F.aggregate(F.coalesce(items, none_of()), none_of(), add)


def split_clauses(text: Column) -> Column:
    """Candidate clauses of a chunk, as an array.

    Semicolons and line breaks part clauses; so does white space after ``. ! ?`` before a capital or digit of the Latin
    alphabet. Parts without content are dropped; a part of at most two words joins the clause before it. Where nothing is
    left but the whole text has content, that is the clause. Null and blank texts have none.
    """
    raw = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n|\r", "\n")
    parts = F.filter(F.transform(F.split(raw, rf"[;\n]+|(?<=[.!?]){SPACE}+(?=[A-Z0-9])"), bare_clause), lambda p: p != "")

    def add(clauses: Column, part: Column) -> Column:
        joined = F.concat(F.slice(clauses, 1, F.size(clauses) - 1), F.array(F.concat_ws(" ", F.element_at(clauses, -1), part)))
        short = F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit(""))) < 2  # a part is squeezed: words are one space apart
        return F.when((F.size(clauses) > 0) & short, joined).otherwise(F.array_append(clauses, part))

    def or_whole(clauses: Column) -> Column:
        return F.when(F.size(clauses) > 0, clauses).otherwise(F.filter(F.array(bare_clause(text)), lambda w: w != ""))

    return F.aggregate(parts, none_of(), add, or_whole)


def token_windows(text: Column, size: int = 150, overlap: int = 30) -> Column:
    """Windows of ``size`` white-space tokens, each starting ``overlap`` before the end of the last, as an array of
    ``start_token, end_token, text``. The last window is the first that reaches the end. Texts without tokens have none.

    The starts follow from the count alone, so no window depends on another.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    step = size - overlap
    tokens = words(text)
    n = F.size(tokens)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - F.lit(size)) / F.lit(step))).cast("int"))

    def window(k: Column) -> Column:
        start = k * step
        return F.struct(start.alias("start_token"), F.least(start + size, n).alias("end_token"), F.array_join(F.slice(tokens, start + 1, F.lit(size)), " ").alias("text"))

    return F.when(n > 0, F.transform(starts, window)).otherwise(none_of("array<struct<start_token:int,end_token:int,text:string>>"))
