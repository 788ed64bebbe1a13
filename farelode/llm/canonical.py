"""Mapping of freely typed values to a reference list.

Issuers (carriers, suppliers) are a small fixed list: one trie per kind holds each name's alias paths - whole, turned
around, first word, code - and is searched with a Levenshtein automaton whose distance depends on the length.

File names stand for entries of a list that grows with the data. A typed name is first taken apart with small tries
(issuer names and codes, document types, topics, scopes, dates), in any order of its parts; what remains is its own
key. Names and entries are then routed to shards by issuer and topic, or by segments of the key, one of which every name
within the distance shares with the entry. A task streams the shards it was given: the entries of a shard come first and
make its trie, the names follow and are looked up; only one trie is in memory. Names of a hot shard are spread over
several copies of it, and a shard with very many entries is split into several tries that each of its names visits. All
entries within the distance come back (``name_candidates``); the other parts decide between them, and a name that
contradicts all of them stands for nothing listed.

Values of any length are looked up; a trie rejects at once what is longer than all of its spellings and the distance.
"""

from __future__ import annotations

import re
import unicodedata
import urllib.parse
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farelode.llm.trie import Trie, allowed_distance
from farelode.operators.skew import hot_keys, hot_share_of, spread_join
from farelode.tables import stored

UNMATCHED = "UNMATCHED"
TRIE_ENTRIES = 50_000  # entries of one trie, by the memory of a task; shards with more have several tries
# ---------------------------------------------------------------------------------------------------------------------
# Fixed values.
LEGAL_FORMS = frozenset("ltd limited gmbh inc incorporated corp corporation co company llc plc pvt ag kg sa sas srl bv nv oy ab as sarl spa pte pty group holding intl".split())
FILLERS = frozenset("the ms messrs mr mrs dba by of sales stn station office branch agency desk via".split())
EMPTY_WORDS = frozenset("unknown tbd na none null various multiple misc other notstated nonegiven seenotes sameasabove tobeconfirmed tba allcarriers pending test".split())
# letters of other scripts that look like Latin ones
LOOKALIKES = str.maketrans("аеорсухіјѕԁһкмтвнАЕОРСУХІЈЅКМТВНοαεικνρτυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhkmtbnAEOPCYXIJSKMTBHoaeikvptuABEZHIKMNOPTYX")
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
NOISE = re.compile(r"(?i)^\s*(?:copy of|kopie von|copie de|fwd?:|re:)\s+|[\s_-]*(?:\((?:\d+|copy)\)|[\s_-]+(?:scan|final|draft|revised|signed|v\d+|copy\d*|new))\s*$|[_\s-][copy]{3,6}\d+\s*$")
EXTENSION = re.compile(r"(?i)\.(?:pdf|html?|docx?|txt)\s*$")
# ---------------------------------------------------------------------------------------------------------------------


_LEGAL_TRIE = Trie((w, w) for w in LEGAL_FORMS if len(w) > 2)
_LONG_GAPS = re.compile(r"[\s_-]{9,}")


def abbreviates(short: str, word: str) -> bool:
    """Whether ``short`` begins like ``word`` and its letters stand in it in the same order."""
    if short[:1] != word[:1] or len(short) >= len(word):
        return False
    rest = iter(word)
    return all(c in rest for c in short)


def fold(text: str) -> str:
    """Without accents, invisible characters and look-alikes of other scripts; digits and case stay."""
    text = unicodedata.normalize("NFKD", text.translate(LOOKALIKES))
    return "".join(c for c in text if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")


def _words(text: str) -> list[str]:
    return re.findall(r"[a-z]+|\d+|[a-z]+\d+", text.lower())


@dataclass(frozen=True)
class Issuer:
    kind: str
    name: str
    code: str
    country: str


class IssuerIndex:
    """The tries of one kind of issuers."""

    def __init__(self, issuers: Iterable[Issuer]) -> None:
        self.issuers = [i for i in issuers if i.code and i.name]
        self.codes = {i.code.lower(): i for i in self.issuers}
        self.exact = {x for i in self.issuers for x in (i.name, i.code)}
        self.whole, self.turned, self.first = Trie(), Trie(), Trie()
        self.kinds = {w for i in self.issuers for w in fold(i.name).lower().split()[1:]}
        self.kind_words = Trie((w, w) for w in self.kinds)
        self.known = self.kinds | {w for i in self.issuers for w in fold(i.name).lower().split()[:1]}
        self.read_as: dict[str, str] = {}
        for i in self.issuers:
            words = fold(i.name).lower().split() or [i.code.lower()]
            self.whole.add("".join(words), i)
            if len(words) > 1:
                self.turned.add("".join(words[1:] + words[:1]), i)
                self.first.add(words[0], i)

    def read(self, typed: str) -> tuple[str, set[str], list[str]]:
        """The folded text, the codes in it, and the words that are left for a name."""
        text = " ".join(fold(typed).split())
        codes = {w for w in re.findall(r"[a-z0-9]+", text.lower()) if w in self.codes}
        plain = re.sub(r"\b[aA]/[lL]\b", "airlines", text)
        bare = re.sub(r"\b[sS]\.\s?[aA]\.?(?![a-z])|\b[mM]/[sS]\b\.?|\b[A-Za-z]/[A-Za-z]\b", " ", plain)
        bare = re.sub(r"(?i)[(\[][^()\[\]]*[)\]]", lambda m: " " if self._aside(m[0]) else m[0], bare)
        bare = re.sub(r"(?i)\s?(?:[/,-]|\s)\s?[A-Z]{2}\s(?:stn|station|office|sales|branch)\b.*$|[,/]\s?[A-Z]{2}(?:\s\w{1,7})?\s?$", " ", bare)
        words = [w for w in re.findall(r"[a-z]*\d+[a-z0-9]*|[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", bare).lower().replace("'", "")) if w not in codes]
        if any(w.isalpha() for w in words):  # a code with a slip of the hand beside a name tells nothing
            words = [w for w in words if w.isalpha()]
        words = [w for w in words if w not in FILLERS - self.kinds and (w not in LEGAL_FORMS or w in self.kinds)]
        if len(words) > 2 and words[-1] not in self.kinds and len(words[-1]) > 2 and _LEGAL_TRIE.search(words[-1], 1):
            words.pop()
        return plain, codes, words

    def candidates(self, typed: str) -> dict[Issuer, int]:
        """All issuers whose name, whole or turned around, is within the distance of the typed one, with their distance."""
        return self._near(self.read(typed)[2])

    def resolve(self, typed: str) -> str | None:
        """The code that a typed value means, or None.

        A code in the value decides if the rest does not contradict it; else the nearest name within the distance, whole or
        turned around; else the first word of a name alone. Two names equally near give None, unless the country tells.
        """
        squeezed = re.sub("[^a-z0-9]", "", fold(typed).lower())
        if squeezed in self.codes:  # a code with marks or gaps in it
            return self.codes[squeezed].code
        text, codes, words = self.read(typed)
        rest = "".join(words)
        if not rest:
            return self.codes[next(iter(codes))].code if len(codes) == 1 else None
        if rest in EMPTY_WORDS or "".join(_words(text)) in EMPTY_WORDS:
            return None
        found = self._near(words)
        if codes:
            own = self.codes[next(iter(codes))] if len(codes) == 1 else None
            if own and (own in found or self._near_first(own, words)):
                return own.code
        if found:
            least = min(found.values())
            best = [i for i, e in found.items() if e == least]
            if len(best) > 1:
                best = [i for i in best if re.search(rf"\b{i.country}\b", text)] or best
            # a whole name outweighs a code that is another's
            if len(best) == 1 and (not codes or least <= 1 or best[0].code.lower() in codes):
                return best[0].code
            return None
        kindless = [w for w in words if w not in self.kinds]
        if len(words) == 1 or kindless and len(kindless) == 1 and len(words) == len(kindless):
            word = words[0]
            near = {i: e for i, e in self.first.search(word, 2).items() if e <= allowed_distance(len(i.name.split()[0]))}
            near = near or self.first.search(word, 1 if len(word) < 6 else 2, exchange=True)
            if near:
                least = min(near.values())
                best = [i for i, e in near.items() if e == least]
                if len(best) == 1:
                    return best[0].code
        return None

    def _written_out(self, word: str) -> str:
        """The word of a name's kind that an abbreviation stands for, which may have a letter too many."""
        if word in self.known or not 3 <= len(word) <= self.kind_words.longest:
            return word
        told = self.read_as.get(word)
        if told is None:
            near = {k for k in self.kinds if abbreviates(word, k)}
            if not near and len(word) > 3:
                near = {k for k in self.kinds for i in range(1, len(word)) if abbreviates(word[:i] + word[i + 1 :], k)}
            if len(self.read_as) > 100_000:
                self.read_as.clear()
            told = self.read_as[word] = near.pop() if len(near) == 1 else word
        return told

    def _near(self, words: list[str]) -> dict[Issuer, int]:
        """Issuers whose whole or turned name is within the distance that its length allows; abbreviations count one error."""
        found: dict[Issuer, int] = {}
        plain, full = "".join(words), "".join(map(self._written_out, words))
        readings = {plain: 0}
        if full != plain:  # what is near a word of a kind may be an abbreviation or a slip of the hand
            near = "".join([w if self.kind_words.search(w, 1, exchange=True) else self._written_out(w) for w in words])
            readings = {full: 1, near: 1, plain: 0}
        for reading, more in readings.items():
            for trie in (self.whole, self.turned):
                for i, e in trie.search(reading, 3, exchange=True).items():
                    if e <= allowed_distance(len(i.name.replace(" ", ""))):
                        found[i] = min(e + more, found.get(i, e + more))
        return found

    def _aside(self, bracket: str) -> bool:
        """Whether a bracket holds only a remark: a code, a country, a sales office, a legal form."""
        words = re.findall(r"[a-z0-9]+", bracket.lower())
        return all(w in self.codes or w in LEGAL_FORMS or w in FILLERS or len(w) <= 2 or re.fullmatch(r"[a-z]{1,3}\d", w) for w in words)

    def _near_first(self, issuer: Issuer, words: list[str]) -> bool:
        first = (fold(issuer.name).lower().split() or [""])[0]
        return any(issuer in self.first.search(w, allowed_distance(len(first))) for w in words)


def whole_key(filename: str) -> str:
    return re.sub("[^a-z]", "", EXTENSION.sub("", fold(filename)).lower())


# File names ----------------------------------------------------------------------------------------------------------


@dataclass
class NameParts:
    """The parts of a file name; None where it does not show them."""

    code: str | None = None
    doc_type: str | None = None
    topic: str | None = None
    scope: str | None = None
    day: str | None = None  # YYYY-MM-DD, or YYYY-MM where no day stands
    key: str = ""


_DATE_FORMS = (
    (re.compile(r"(?<!\d)(20\d\d)[-_. ]?(0[1-9]|1[0-2])[-_. ]?([0-3]\d)(?!\d)"), lambda m: f"{m[1]}-{m[2]}-{m[3]}"),
    (re.compile(r"(?<!\d)([0-3]?\d)[-_./ ](0[1-9]|1[0-2])[-_./ ](20\d\d)(?!\d)"), lambda m: f"{m[3]}-{m[2]}-{int(m[1]):02d}"),
    (re.compile(r"(?i)(?<!\d)([0-3]?\d)[\s_.-]*(" + "|".join(MONTHS) + r")[a-z]{0,6}[\s_.,-]*(20\d\d|\d\d)(?!\d)"), lambda m: f"20{m[3][-2:]}-{MONTHS.index(m[2].lower()) + 1:02d}-{int(m[1]):02d}"),
    (re.compile(r"(?i)(" + "|".join(MONTHS) + r")[a-z]{0,6}[\s_.,-]*(20\d\d)(?!\d)"), lambda m: f"{m[2]}-{MONTHS.index(m[1].lower()) + 1:02d}"),
)
# a month with a slip of the hand, behind a day and before a year, or before a whole year
_DATE_SLIPS = (re.compile(r"(?i)(?<!\d)([0-3]?\d)[\s_.-]*([a-z]{2,4})[\s_.,-]*(20\d\d|\d\d)(?!\d)"), re.compile(r"(?i)(?<!\d)()(?<![a-z])([a-z]{2,4})[\s_.,-]*(20\d\d)(?!\d)"), re.compile(r"()((?:[a-z][A-Z][a-z]|[a-z]{3}|[A-Z]{3}))(20\d\d)(?!\d)"))
_MONTH_TRIE = Trie((m, m) for m in MONTHS)


def find_date(text: str) -> tuple[str | None, str]:
    """The date in a file name, and the name without it."""
    for form, say in _DATE_FORMS:
        m = form.search(text)
        if m:
            return say(m), text[: m.start()] + " " + text[m.end() :]
    for form in _DATE_SLIPS:
        for m in form.finditer(text):
            typed = m[2].lower()
            near = _MONTH_TRIE.search(typed, 1, exchange=True)
            if near and int(m[1] or 1) <= 31:
                bare = text[: m.start()] + " " + text[m.end() :]
                if len(near) > 1:  # a date, but which?
                    return None, bare
                month = MONTHS.index(next(iter(near))) + 1
                return f"20{m[3][-2:]}-{month:02d}" + (f"-{int(m[1]):02d}" if m[1] else ""), bare
    return None, text


class NameParser:
    """Takes file names apart with the vocabularies of the reference list."""

    def __init__(self, issuers: Iterable[Issuer], doc_types: Iterable[str], topics: Iterable[str], scopes: Iterable[str]) -> None:
        issuers = list(issuers)
        self.codes = {i.code.lower(): i.code for i in issuers}
        names = [("".join(re.findall("[a-z]+", fold(i.name).lower())), i.code) for i in issuers]
        self.names, self.names_back = Trie(names), Trie((n[::-1], c) for n, c in names)
        self.name_length = {}
        for n, c in names:
            self.name_length[c] = len(n)
        squeeze = {t: re.sub("[^a-z]", "", t) for t in {*doc_types, *topics, *scopes}}
        self.types = Trie((squeeze[t], t) for t in doc_types)
        self.topics, self.topics_back = Trie((squeeze[t], t) for t in topics), Trie((squeeze[t][::-1], t) for t in topics)
        self.scopes_back = Trie((squeeze[t][::-1], t) for t in scopes)
        self.size = {t: len(s) for t, s in squeeze.items()}

    def listed(self, filename: str) -> NameParts:
        """The parts of an entry; one with a type, topic or scope outside the vocabulary counts as of another form."""
        parts = self.entry(filename)
        if parts.code and not (parts.doc_type in self.size and parts.topic in self.size and parts.scope in self.size):
            return NameParts(key=whole_key(filename))
        return parts

    @staticmethod
    def entry(filename: str) -> NameParts:
        """The parts of a clean entry: type_CODE_date_topic-words-scope.ext, the key being the two words before the scope.

        An entry of another form has only a key.
        """
        m = re.fullmatch(r"([a-z_]+)_([A-Z0-9]+)_(\d{4}-\d\d-\d\d)_([a-z-]+)\.\w+", filename)
        words = m[4].split("-") if m else []
        if not m or len(words) < 4:
            return NameParts(key=whole_key(filename))
        return NameParts(m[2], m[1], "-".join(words[:-3]), words[-1], m[3], "".join(words[-3:-1]))

    @staticmethod
    def _best(hits: list[tuple[int, int, str]], size: dict, limit) -> tuple[int, int, str] | None:
        """The hit with the fewest errors for its length; hits beyond their own allowed distance don't count."""
        good = [h for h in hits if h[0] <= limit(size[h[2]])]
        return min(good, key=lambda h: (h[0] - size[h[2]] / 4, h[0], h[2])) if good else None

    def parse(self, typed: str, with_type: bool = False) -> NameParts:
        """The parts of a typed name; ``with_type``: it may begin with a document type, as entries do."""
        parts = NameParts()
        text = _LONG_GAPS.sub(" ", fold(urllib.parse.unquote(typed))).strip()
        text = EXTENSION.sub("", text)
        for _ in range(3):
            text = NOISE.sub("", text)
            text = EXTENSION.sub("", text)
        text = re.sub(r"^[\s_-]+|[\s_-]+$", "", text)
        parts.day, text = find_date(text)
        # codes stand as words; in glued names at an end
        for m in re.finditer(r"[A-Za-z]{2,3}\d(?![0-9])", text):
            code = m[0].lower()
            before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
            if code in self.codes and (not before.isalnum() or m.start() == 0) and (not after.isalnum() or after.isupper() or after.islower()):
                parts.code = self.codes[code]
                text = text[: m.start()] + " " + text[m.end() :]
                break
        else:
            m = re.search(r"[A-Za-z]{9}\d$", text.rstrip())
            for n in (4, 3):
                if m and text.rstrip()[-n:].lower() in self.codes:
                    parts.code = self.codes[text.rstrip()[-n:].lower()]
                    text = text.rstrip()[:-n]
                    break
        if parts.code is None:  # a code with a slip of the hand tells nothing
            text = re.sub(r"(?<![A-Za-z0-9])[A-Za-z]{1,4}\d{1,2}(?![A-Za-z0-9])", " ", text)
        c = re.sub("[^a-z]", "", text.lower())
        hit = self._best(self.types.prefixes(c, 3), self.size, allowed_distance) if with_type else None
        if hit:
            parts.doc_type, c = hit[2], c[hit[1] :]
        if parts.code is None:
            limit = lambda n: 2 if n <= 14 else 3
            ahead = self._best(self.names.prefixes(c, 3), self.name_length, limit)
            behind = self._best(self.names_back.prefixes(c[::-1], 3), self.name_length, limit)
            if ahead and (not behind or ahead[0] <= behind[0]):
                parts.code, c = ahead[2], c[ahead[1] :]
            elif behind:
                parts.code, c = behind[2], c[: len(c) - behind[1]]
        hit = self._best(self.scopes_back.prefixes(c[::-1], 3), self.size, lambda n: 2 if n < 10 else 3)
        if hit:
            parts.scope, c = hit[2], c[: len(c) - hit[1]]
        limit = lambda n: 2 if n <= 13 else 3
        ahead = self._best(self.topics.prefixes(c, 3), self.size, limit)
        behind = self._best(self.topics_back.prefixes(c[::-1], 3), self.size, limit)
        if ahead and (not behind or ahead[0] <= behind[0]):
            parts.topic, c = ahead[2], c[ahead[1] :]
        elif behind:
            parts.topic, c = behind[2], c[: len(c) - behind[1]]
        parts.key = c
        return parts


def choose_entry(parts: NameParts, candidates: list[tuple[int, str, NameParts]]) -> str | None:
    """The entry that the parts mean, of candidates (distance of the keys, entry, its parts), or None.

    A part that the name shows must agree with the entry's: issuer, topic, scope, date (a month agrees with its days) and
    type. Of those left the nearest key counts; if several are as near, none is meant.
    """
    best, _ = nearest_fitting(parts, candidates)
    return next(iter(best)) if len(best) == 1 else None


def nearest_fitting(parts: NameParts, candidates: list[tuple[int, str, NameParts]]) -> tuple[set[str], int]:
    """The entries with the nearest key of those that agree with the parts, and their distance."""
    fit = [
        (e, entry)
        for e, entry, p in candidates
        if (not parts.code or p.code == parts.code)
        and (not parts.topic or p.topic == parts.topic)
        and (not parts.scope or p.scope == parts.scope)
        and (not parts.day or p.day is not None and p.day.startswith(parts.day))
        and (not parts.doc_type or p.doc_type == parts.doc_type)
    ]
    least = min((e for e, _ in fit), default=0)
    return {entry for e, entry in fit if e == least}, least


def key_distance(key: str) -> int:
    return allowed_distance(len(key))


@cache
def segments(length: int) -> list[tuple[int, int]]:
    """The (start, end) of the segments of an entry's key, so many that one stays whole in every name within the distance.

    Each error spoils one segment; an exchange of neighbours, which counts as one error, may spoil two.
    """
    most = max((allowed_distance(n) for n in range(max(0, length - 3), length + 4) if abs(n - length) <= allowed_distance(n)), default=0)
    count = most + 2 if most else 1
    return [(length * i // count, length * (i + 1) // count) for i in range(count)]


def entry_seeds(key: str) -> list[str]:
    """The shards of an entry by its key: its length, and the number and letters of each segment."""
    return [f"{len(key)}:{i}:{key[a:b]}" for i, (a, b) in enumerate(segments(len(key)))]


@dataclass(frozen=True)
class Lengths:
    """The lengths that keys have: those up to ``bound`` one by one, beyond it whether there are any."""

    known: frozenset[int]
    longer: bool = False
    bound: int = 1_000

    def __contains__(self, length: int) -> bool:
        return length in self.known if length <= self.bound else self.longer

    def __bool__(self) -> bool:
        return bool(self.known) or self.longer


def name_seeds(key: str, lengths: Lengths) -> set[str]:
    """The shards of all entries with keys of one of ``lengths`` that may be within the distance of a name's key.

    A segment that is whole stands where the letters gained and lost before it put it; those behind it make up the rest of
    the difference in length, and both together are no more than the distance.
    """
    k, n, found = key_distance(key), len(key), set()
    for m in range(max(0, n - k), n + k + 1):
        if m not in lengths:
            continue
        shifts = [d for d in range(-k, k + 1) if abs(d) + abs(n - m - d) <= k]
        for i, (a, b) in enumerate(segments(m)):
            found |= {f"{m}:{i}:{key[a + d : b + d]}" for d in shifts if a + d >= 0 and b + d <= n}
    return found


def whole_keys(typed: str, entry: bool) -> set[tuple[str, str]]:
    """(digits, letters) of a name as a whole, to compare with entries of another form; a typed one also without noise."""
    text = EXTENSION.sub("", _LONG_GAPS.sub(" ", fold(typed if entry else urllib.parse.unquote(typed))).strip())
    texts = {text}
    for _ in range(0 if entry else 3):
        text = EXTENSION.sub("", NOISE.sub("", text))
        texts.add(text)
    return {(re.sub("[^0-9]", "", t), re.sub("[^a-z]", "", t.lower())) for t in texts} - {("", "")}


def shards_of_entry(entry: str, parts: NameParts) -> list[str]:
    """The shards that an entry stands in: by issuer and topic, and by the segments of its key.

    Entries of another form stand by the segments of the whole name and its digits, which must be the same.
    """
    if parts.code and parts.topic:
        return [f"{parts.code}|{parts.topic}", *entry_seeds(parts.key)]
    return [f"{digits}#{s}" for digits, key in whole_keys(entry, True) for s in entry_seeds(key)]


def shards_of_name(typed: str, parts: NameParts, lengths: Lengths, other_lengths: Lengths) -> list[tuple[str, NameParts]]:
    """The shards that a name is looked up in, each with the parts that count there.

    ``lengths``: of the entries' keys; ``other_lengths``: of those of another form. A name that shows issuer and topic meets
    all entries that agree with it in their shard; others go by the segments of their key.
    """
    if parts.key and parts.code and parts.topic:
        found = [(f"{parts.code}|{parts.topic}", parts)]
    else:
        found = [(s, parts) for s in name_seeds(parts.key, lengths)]
    if other_lengths:
        found += [(f"{digits}#{s}", NameParts(key=key)) for digits, key in whole_keys(typed, False) for s in name_seeds(key, other_lengths)]
    return found


def key_lengths(entries: DataFrame, parser: NameParser) -> tuple[Lengths, Lengths]:
    """The lengths that the keys of the entries have, and those of entries of another form; the driver gets no more than
    twice ``Lengths.bound`` rows and two."""
    bound = Lengths.bound

    def lengths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = set()
            for entry in batch["entry"].tolist():
                parts = parser.listed(entry)
                found.add((not parts.code, min(len(parts.key), bound + 1)))
            yield pd.DataFrame(sorted(found), columns=["other", "length"])

    rows = entries.select("entry").mapInPandas(lengths, "other boolean, length int").distinct().collect()
    own, other = ({r["length"] for r in rows if r["other"] == o} for o in (False, True))
    return Lengths(frozenset(own - {bound + 1}), bound + 1 in own), Lengths(frozenset(other - {bound + 1}), bound + 1 in other)


VOCABULARY = 20_000  # document types, topics and scopes that names are taken apart with, by the memory of a task


def name_vocabulary(entries: DataFrame, most: int = VOCABULARY) -> dict[str, list[str]]:
    """The document types, topics and scopes that the entries use: ``doc_type``, ``topic``, ``scope``, each sorted.

    They are words that many entries share. Should there be more than ``most``, those of the most entries are taken; entries
    with others are looked up as a whole (``NameParser.listed``), so none is lost.
    """

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: Counter = Counter()
            for entry in batch["entry"].tolist():
                parts = NameParser.entry(entry)
                found.update((p, getattr(parts, p)) for p in ("doc_type", "topic", "scope") if getattr(parts, p))
            yield pd.DataFrame([(*k, n) for k, n in found.items()], columns=["part", "word", "n"])

    counted = entries.select("entry").mapInPandas(words, "part string, word string, n bigint").groupBy("part", "word").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.desc("n"), "part", "word").limit(most).collect()
    return {p: sorted(r["word"] for r in rows if r["part"] == p) for p in ("doc_type", "topic", "scope")}


def _meet(names: DataFrame, entries: DataFrame, parser: NameParser, every: bool) -> DataFrame:
    """``name_id, found, distance, agrees``: of the entries within the distance of each name all (``every``), or the nearest
    that agree with its parts, of which two are enough to show that none is meant. One entry may come from several shards.
    """
    lengths, other_lengths = key_lengths(entries, parser)

    def parse_names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, typed, with_type in zip(batch["name_id"].tolist(), batch["typed"].tolist(), batch["with_type"].tolist()):
                parts = parser.parse(typed, with_type)
                rows += [(s, i, _pack(shown)) for s, shown in shards_of_name(typed, parts, lengths, other_lengths)]
            yield pd.DataFrame(rows, columns=["shard", "name_id", "parts"])

    def parse_entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for entry in batch["entry"].tolist():
                parts = parser.listed(entry)
                rows += [(s, entry, _pack(parts)) for s in shards_of_entry(entry, parts)]
            yield pd.DataFrame(rows, columns=["shard", "entry", "parts"])

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, trie, known = None, Trie(), {}
        for batch in batches:
            rows = []
            for s, split, copy, is_name, i, entry, packed in batch.itertuples(index=False, name=None):
                if (s, split, copy) != shard:
                    shard, trie, known = (s, split, copy), Trie(), {}
                parts = _unpack(packed)
                if not is_name:
                    trie.add(parts.key, entry)
                    known[entry] = parts
                    continue
                if not known:
                    continue
                near = trie.search(parts.key, key_distance(parts.key), exchange=True)
                best, least = nearest_fitting(parts, [(e, x, known[x]) for x, e in near.items()])
                if every:
                    rows += [(i, x, e, bool(nearest_fitting(parts, [(e, x, known[x])])[0])) for x, e in near.items()]
                else:
                    rows += [(i, x, least, True) for x in sorted(best)[:2]]
            yield pd.DataFrame(rows, columns=["name_id", "found", "distance", "agrees"])

    # a fixed number of partitions: the rows are few bytes but much work, so they must not be gathered into few tasks
    parts = max(2, int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parsed = stored(names.select("name_id", "typed", "with_type").repartition(parts).mapInPandas(parse_names, "shard string, name_id bigint, parts string"))
    listed = stored(entries.select("entry").mapInPandas(parse_entries, "shard string, entry string, parts string"))
    # at most 1 / share rows, and at most one row for each TRIE_ENTRIES of the list
    hot = F.broadcast(hot_keys(parsed.select("shard"), hot_share_of(parsed)).withColumnRenamed("hot_key", "shard"))
    large = F.broadcast(listed.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / TRIE_ENTRIES).cast("int").alias("splits")).where("splits > 1"))

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(hot, "shard", "left").join(large, "shard", "left").fillna(1, ["salts", "splits"])

    def one_of(column: str, count: str) -> Column:
        return F.pmod(F.xxhash64(column), F.col(count)).cast("int")

    def each_of(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    visiting = placed(parsed).select("shard", each_of("splits").alias("split"), one_of("name_id", "salts").alias("copy"), F.lit(True).alias("is_name"), "name_id", F.lit(None).cast("string").alias("entry"), "parts")
    standing = placed(listed).select("shard", one_of("entry", "splits").alias("split"), each_of("salts").alias("copy"), F.lit(False).alias("is_name"), F.lit(None).cast("bigint").alias("name_id"), "entry", "parts")
    met = visiting.unionAll(standing).repartition(parts, "shard", "split", "copy").sortWithinPartitions("shard", "split", "copy", "is_name")
    return met.mapInPandas(look_up, "name_id bigint, found string, distance int, agrees boolean")


def map_names(names: DataFrame, entries: DataFrame, parser: NameParser) -> DataFrame:
    """Every name with the entry it means: the columns of ``names`` and ``canonical`` (``UNMATCHED`` where it means none).

    ``names``: ``name_id`` (unique), ``typed``, ``with_type``; ``entries``: one column ``entry``, without repetitions or
    nulls. Both are parsed row by row, then meet in shards: rows of one trie come to one task, sorted so that the entries
    precede the names, and are streamed. Candidates of a name from several shards are folded into one verdict.
    """
    found = _meet(names, entries, parser, every=False)
    # several entries may come, from one shard or more: then the nearer counts, and none if they are as near
    least = found.groupBy("name_id").agg(F.min(F.struct("distance", "found")).alias("_first"), F.max(F.struct(-F.col("distance"), F.col("found"))).alias("_last"))
    agreed = least.select(F.col("name_id").alias("_id"), F.when(F.col("_first.found") == F.col("_last.found"), F.col("_first.found")).alias("canonical"))
    return names.join(agreed.hint("merge"), F.col("name_id") == F.col("_id"), "left").drop("_id").withColumn("canonical", F.coalesce("canonical", F.lit(UNMATCHED)))


def name_candidates(names: DataFrame, entries: DataFrame, parser: NameParser) -> DataFrame:
    """All entries within the distance of each name: ``name_id``, ``candidate``, ``distance``, ``agrees`` (whether no part that
    the name shows contradicts the entry). A name that shows issuer and topic meets the entries that have both.
    """
    found = _meet(names, entries, parser, every=True)
    return found.groupBy("name_id", F.col("found").alias("candidate")).agg(F.min("distance").alias("distance"), F.bool_or("agrees").alias("agrees"))


_PARTS = ("code", "doc_type", "topic", "scope", "day", "key")


def _pack(parts: NameParts) -> str:
    return "\t".join(getattr(parts, p) or "" for p in _PARTS)


def _unpack(packed: str) -> NameParts:
    *known, key = packed.split("\t")
    return NameParts(*[x or None for x in known], key)


def _look_up_issuers(values: DataFrame, issuers: list[Issuer], schema: str, rows_of: Callable[[IssuerIndex, str], list[tuple]]) -> DataFrame:
    """``_key`` and the rows that ``rows_of`` gives for each different (kind, typed) of the values, each looked up once."""
    parts = max(2, int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    columns = [c.split()[0] for c in schema.split(", ")]

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = {k: IssuerIndex([i for i in issuers if i.kind == k]) for k in {i.kind for i in issuers}}
        for batch in batches:
            rows = [(key, *r) for key, k, t in zip(batch["_key"].tolist(), batch["kind"].tolist(), batch["typed"].tolist()) if k in index for r in rows_of(index[k], t)]
            yield pd.DataFrame(rows, columns=["_key", *columns])

    # rows are few bytes but much work, so the number of tasks is fixed
    different = values.where("kind IS NOT NULL AND typed IS NOT NULL").select(_issuer_key().alias("_key"), "kind", "typed").distinct().repartition(parts)
    return different.mapInPandas(look_up, f"_key string, {schema}")


def _issuer_key() -> Column:
    return F.concat_ws("\x01", "kind", "typed")


def map_issuers(values: DataFrame, issuers: list[Issuer]) -> DataFrame:
    """Typed issuers with the code they mean: the columns of ``values``, ``canonical`` and ``verbatim``.

    ``values`` has ``kind`` and ``typed``. ``issuers`` is a fixed list, so each task builds its tries. ``verbatim``: the
    value is a name or code of its kind as it stands. Null and blank values, and values that mean no issuer of their kind,
    give ``UNMATCHED``. Equal values are folded before the shuffle, looked up once and joined back, common ones spread.
    """
    told = _look_up_issuers(values, issuers, "canonical string, verbatim boolean", lambda index, t: [(index.resolve(t) or UNMATCHED, t in index.exact)])
    joined = spread_join(values.withColumn("_typed_key", F.when(F.col("kind").isNotNull() & F.col("typed").isNotNull(), _issuer_key())), told, "_typed_key", "_key", "left")
    return joined.drop("_typed_key", "_key").withColumns({"canonical": F.coalesce("canonical", F.lit(UNMATCHED)), "verbatim": F.coalesce("verbatim", F.lit(False))})


def issuer_candidates(values: DataFrame, issuers: list[Issuer]) -> DataFrame:
    """All issuers of its kind within the distance of each typed value: the columns of ``values``, ``candidate``, ``distance``.

    At most as many rows for a value as the fixed list has issuers.
    """
    told = _look_up_issuers(values, issuers, "candidate string, distance int", lambda index, t: [(i.code, e) for i, e in index.candidates(t).items()])
    grouped = told.groupBy("_key").agg(F.collect_list(F.struct("candidate", "distance")).alias("_near"))
    joined = spread_join(values.withColumn("_typed_key", _issuer_key()), grouped, "_typed_key", "_key")
    return joined.select(*values.columns, F.explode("_near").alias("_x")).select(*values.columns, "_x.candidate", "_x.distance")
