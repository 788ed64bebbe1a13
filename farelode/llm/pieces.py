"""Splitting of oversized texts at natural boundaries, with overlap.

The separators form a hierarchy: section, paragraph (block or line), sentence, word, character. A text is split at the
highest separators and its parts are packed greedily: a part joins the open piece if it fits, else it opens the next one.
Only a part that fits into no piece is split again, at the next separators, down to single tokens; before a sentence or a
word is split, the open piece is closed at the boundary before it. Each piece begins with the last ``overlap`` tokens of
the one before, so it takes at most ``limit - overlap`` new tokens.

Tokens: each character in U+0E00-0E7F, U+3040-30FF or U+4E00-9FFF is one; any other run of characters that are neither
these nor white space is one.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farelode.llm.sentences import Openings, sentences

TOKEN = re.compile(r"[฀-๿぀-ヿ一-鿿]|[^\s฀-๿぀-ヿ一-鿿]+")
LEVELS = ("section", "paragraph", "sentence", "word", "character")
SECTION, PARAGRAPH, SENTENCE, WORD, CHARACTER = range(5)
PIECE_COLUMNS = "piece_no int, start_token int, end_token int, start_char int, end_char int, overlap_tokens int, cut_level string, cut_kind string"
_BREAK = re.compile(r"\n[ \t\r]*\n")
_ENDED = re.compile(r"[.!?؟।。！？…:;,»”\"')]$")


def count_tokens(text: str) -> int:
    return sum(1 for _ in TOKEN.finditer(text))


def _separators(text: str, units: list[tuple[int, int]], starts: list[int], ends: list[int], lines: bool, heading: int) -> list[int]:
    """For every token the level of the separator before it.

    A block of at most ``heading`` characters without an end mark, which another block follows, is a heading and opens a
    section; a longer one is a paragraph. That only ranks the boundary before it, which stays a natural one.
    """
    levels = [WORD if i and ends[i - 1] < starts[i] else CHARACTER for i in range(len(starts))]
    for k, (a, b) in enumerate(units):
        i = bisect_left(starts, a)
        if i >= len(starts):
            continue
        if k == 0:
            levels[i] = SECTION
            continue
        between = text[units[k - 1][1] : a]
        if "\n" in between if lines else _BREAK.search(between):
            titled = b - a <= heading and not _ENDED.search(text[a:b]) and k + 1 < len(units) and "\n" in text[b : units[k + 1][0]] and text[a] not in "•-–*("
            levels[i] = SECTION if titled else PARAGRAPH
        else:
            levels[i] = PARAGRAPH if "\n" in between and text[a] in "•-–*(0123456789" else SENTENCE
    return levels


def _pack(n: int, levels: list[int], limit: int, overlap: int) -> list[int]:
    """The ends of the pieces of ``n`` tokens, after a leading 0."""
    cuts, begin, stop = [0], 0, 0  # begin: where the open piece starts, repeated tokens included; stop: its end so far
    todo = [(0, n, SECTION)]  # parts, with the separators at which they would be split
    while todo:
        start, end, level = todo.pop()
        if end - begin > limit and stop > cuts[-1]:
            fresh = max(begin, stop - overlap)
            if end - fresh <= limit or level >= WORD:
                cuts.append(stop)
                begin = fresh
        if end - begin <= limit:
            stop = end
        elif level > CHARACTER:  # tokens are never cut
            while end - begin > limit:
                stop = begin + limit
                cuts.append(stop)
                begin = stop - overlap
            stop = end
        else:
            inner = [start, *(i for i in range(start + 1, end) if levels[i] <= level), end]
            todo += [(a, b, level + 1) for a, b in zip(inner, inner[1:])][::-1]
    cuts.append(n)
    return cuts


def split_text(text: str | None, lines: bool = False, limit: int = 150, overlap: int = 30, heading: int = 60, openings: Openings | None = None) -> list[tuple]:
    """The pieces of one text as ``PIECE_COLUMNS``; none where it is null or has at most ``limit`` tokens.

    ``cut_level`` names the separator at the end of a piece (``end`` for the last one). ``cut_kind`` is the same for all
    pieces of a text: ``forced`` if one of its sentence units alone exceeds the limit, else ``natural``.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    if not isinstance(text, str) or len(text) <= limit:
        return []
    starts, ends = [], []
    for m in TOKEN.finditer(text):
        starts.append(m.start())
        ends.append(m.end())
    n = len(starts)
    if n <= limit:
        return []
    units = sentences(text, lines, openings)
    kind = "forced" if any(b - a > limit and count_tokens(text[a:b]) > limit for a, b in units) else "natural"
    levels = _separators(text, units, starts, ends, lines, heading)
    pieces, cuts = [], _pack(n, levels, limit, overlap)
    begin = 0
    for k in range(1, len(cuts)):
        own = cuts[k - 1] - begin if k > 1 else 0
        repeated = min(overlap, own)
        start = cuts[k - 1] - repeated
        level = LEVELS[levels[cuts[k]]] if cuts[k] < n else "end"
        pieces.append((k - 1, start, cuts[k], starts[start], ends[cuts[k] - 1], repeated, level, kind))
        begin = start
    return pieces


def split_oversized(df: DataFrame, text: str | Column, lines: str | Column | None = None, keep: tuple[str, ...] = (), limit: int = 150, overlap: int = 30, openings: Openings | None = None) -> DataFrame:
    """One row per piece of every text with more than ``limit`` tokens: the ``keep`` columns and ``PIECE_COLUMNS``.

    Positions count tokens and characters of the whole text from 0; ends are exclusive. Texts within the limit, null and
    empty ones have no rows; repeated rows are split each. Other columns of the input are not read.
    """
    split_text("", limit=limit, overlap=overlap)
    column = F.col(text) if isinstance(text, str) else text
    by_line = F.lit(False) if lines is None else F.col(lines) if isinstance(lines, str) else lines
    # a token has at least one character, so shorter texts need not reach Python
    source = df.select(*keep, column.alias("_text"), F.coalesce(by_line, F.lit(False)).alias("_lines")).where(F.length("_text") > limit)
    schema = ", ".join([f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keep] + [PIECE_COLUMNS])
    names = [c.split()[0] for c in PIECE_COLUMNS.split(", ")]

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, pieces = [], []
            for i, (t, by) in enumerate(zip(batch["_text"].tolist(), batch["_lines"].tolist())):
                found = split_text(t, by, limit, overlap, openings=openings)
                pieces += found
                rows += [i] * len(found)
            result = batch[list(keep)].iloc[rows].reset_index(drop=True)
            yield pd.concat([result, pd.DataFrame(pieces, columns=names)], axis=1)

    return source.mapInPandas(split, schema)
