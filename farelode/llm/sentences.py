"""Sentence boundaries across languages and scripts.

A text is cut into blocks (blank lines), blocks into list items, headings and running text, and running text into
sentences:

* Spaced scripts: every terminator with its closing marks is a node of a lattice over the text. An edge between two
  nodes is a possible sentence. Nodes are left out that stand in a quotation or bracket, that end in an abbreviation
  which never ends a sentence, a decimal, an ordinal or a date, or after which the text goes on in lower case or with a
  continuation of the quotation; edges, where the start of a sentence excludes its end. The path of the most weight is
  taken (``_Lattice``).
* Scripts with full stops of their own (Khmer, Burmese, Tibetan, Ethiopic, Armenian and others): these end sentences.
* Chinese and Japanese: the same lattice with full-width terminators, which need no space behind them; a quotation is
  followed by its continuation unless a lead-in stood before it. Gaps between terminators are classified through a
  lattice of words that end a sentence before a gap or open one behind it.
* Thai and Lao have no terminator: each run of letters is cut into words by the cheapest path through a lattice of
  dictionary words, then each gap (white space) is classified through the word before it and the word behind it: opening
  words start a sentence unless the word before it still demands a complement; final particles end one. Besides the listed
  opening words, those that the corpus shows count: ``learn_openings`` compares how often a beginning stands at the start of
  a block, where a sentence surely begins, with how often it stands behind a gap inside one.

A quotation or bracket that is not closed reaches to the end of its block, as one that was cut off does; a straight mark
behind a digit without a partner is an inch mark. Everything is a pure function of one text, so rows are handled in Arrow
batches without a shuffle; words, tokens and texts may have any length, and a text is read in time proportional to it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------------------------------
# Public linguistic knowledge, by language.

# Abbreviations that are always followed by the rest of their phrase (compared in lower case, without the last period).
NEVER_FINAL = frozenset(
    """
    mr mrs ms dr prof st messrs mt ft rev hon gen col sec secs no nos para paras art arts cf annex fig figs vol p pp ch approx
    ca vs i.e e.g viz resp ref incl excl tel ext
    abs nr z d bspw bzw vgl gem ggf inkl exkl zzgl str u bd s mind höchst evtl lt
    m mm mme mlle mgr n° no env av bd chap al
    sr sra srta ud uds núm n.º nº pág págs aprox ej p.ej dto dpto d.ª
    """.split()
)
# Abbreviations that end a sentence where a new one visibly begins.
MAYBE_FINAL = frozenset(
    """
    inc ltd co corp pvt llc plc bros jr sr s.a s.l s.r.l a.m p.m a.c d.c etc et hr hrs yr yrs in lb lbs oz kg km ft u.s u.k u.s.a
    e.u d.h std stdn mio usw gmbh kg ag cie h min sek tgl
    """.split()
)
MONTHS = frozenset(
    """
    january february march april may june july august september october november december jan feb mar apr jun jul aug sep sept oct nov dec
    januar februar märz april mai juni juli august september oktober november dezember jän mär okt dez
    janvier février mars avril mai juin juillet août septembre octobre novembre décembre janv févr avr juil déc
    enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre ene abr ago set dic
    """.split()
)
# Legal forms that go on a name after another legal form's period.
LEGAL_FORMS = frozenset("KG KGaA OHG AG Ltd Ltd. Inc Inc. LLC PLC".split())
# Words that go on with a sentence after a quotation, where letters have no case.
CONTINUES_AFTER_QUOTE = ("و", "ف", "और", "तथा", "并", "且", "而", "以及", "लिखा", "と", "という", "って", "は", "が", "を", "に", "の", "で", "，", "、", "；", ",", ";", "และ")
# Thai: words that open a sentence, words that can't, and words behind which a phrase must go on.
THAI_OPENING = frozenset(
    """
    หาก ถ้า เมื่อ กรุณา โปรด ผู้โดยสาร บัตรโดยสาร ตั๋ว ค่าธรรมเนียม น้ำหนัก ภาษี สายการบิน เงื่อนไข ประกาศ การ ทั้งนี้ อย่างไรก็ตาม นอกจากนี้ สัมภาระ
    เที่ยวบิน ใช้ ห้าม ลูกค้า บริษัท ผู้ถือ ราคา เด็ก ทารก
    เรา พวกเรา ท่าน คุณ เขา พวกเขา ดิฉัน ผม ดังนั้น แม้ว่า
    """.split()
)
THAI_JOINING = frozenset("เว้นแต่ ยกเว้น และ หรือ แต่ ที่ ซึ่ง ของ ใน ภายใน ก่อน หลัง จะ ไม่ มี มีผล ต่อ เท่านั้น ขอ ตาม เพื่อ โดย จาก ถึง กับ".split())
THAI_DEMANDING = frozenset("ประกาศ ฉบับ ฉบับที่ ประเภท เส้นทาง สายการบิน ภายใน ไม่เกิน ถึง วันที่ ถึงวันที่ ที่ กับ ของ ต่อ และ หรือ โดย จาก ใน คืนให้ ค่าธรรมเนียม ยกเว้น เว้นแต่ หาก".split())
# Particles that end a sentence.
THAI_FINAL = frozenset("ครับ ครับผม ค่ะ คะ นะ นะครับ นะคะ จ้ะ จ๊ะ เถอะ หรอก ล่ะ".split())
THAI_WORDS = THAI_OPENING | THAI_JOINING | THAI_DEMANDING | THAI_FINAL | frozenset(
    """
    ชนะ สถานะ ฐานะ คุณภาพ คุณสมบัติ ขอบคุณ ท่านอื่น
    นี้ ใช้ ติดต่อ เคาน์เตอร์ ออก ออกเดินทาง เดินทาง ได้ สามารถ เปลี่ยน เปลี่ยนแปลง วัน วันเดินทาง คืน คืนเงิน เงิน ยกเลิก ออกตั๋ว ใหม่ ตั๋วหมู่คณะ หมู่คณะ
    ถูก เรียกเก็บ เก็บ คิด ค่าปรับ ปรับ ยัง ไม่ได้ ที่นั่ง ว่าง ไม่เกิน กิโลกรัม ใบ คน เที่ยว ให้ มูลค่า สนามบิน สงวน สิทธิ์ ขอสงวนสิทธิ์ ชม วันที่ ผล
    """.split()
)
# Chinese and Japanese: words that end a sentence before a gap, words that open one behind it, and words in which these are
# only parts, or which go on.
CJK_FINAL = frozenset("です ます でした ました ません ませんでした ましょう でしょう ください 下さい である であった ですか ますか ましたか ませんか でしょうか ですね ますね ですよ ますよ 吗 呢 吧 啊 呀 啦 嘛 了".split())
CJK_OPENING = frozenset("ただし なお さらに しかし そのため したがって 従って また 如果 因此 此外 另外 但是".split())
CJK_WORDS = CJK_FINAL | CJK_OPENING | frozenset("ますます または またがる なおさら なおす 除了 为了 酒吧 网吧 ですが ますが ので から けれども が と し".split())
# ---------------------------------------------------------------------------------------------------------------------

# opening marks with what closes them; German and English quotation marks share signs
PAIR = {
    "“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "‹": "›", "‚": "‘",
    "(": ")", "（": "）", "[": "]", "【": "】", "《": "》", "〈": "〉",
}
# full stops of other scripts, which need no space behind them: Arabic, Devanagari, Armenian, Ethiopic, Burmese, Khmer, Tibetan
_OWN_STOPS = "।॥۔؟։።፧။។៕།༎"
EVENT = re.compile(rf"[\"“”„«»「」『』()（）\[\]【】]|[!?。！？｡…‥{_OWN_STOPS}]+|\.+")
BLANK = re.compile(r"\n(?:[ \t\r\f\v\u00a0\u3000]*\n)+")
_VISIBLE = re.compile(r"\S")
BULLET = re.compile(r"\s*(?:([•‣◦▪●∙·○–—*-])|\(?(?:(\d{1,3})(\)|\.)|([a-zA-Z]|[ivxIVX]{1,4})\)))[ \t ]+(?=\S)")
BULLET_AT = re.compile(r"(?m)^[ \t]*(?:[•‣◦▪●∙·○–—*-]|\(?(?:\d{1,3}[.)]|(?:[a-zA-Z]|[ivxIVX]{1,4})\)))[ \t ]+(?=\S)")
THAI = re.compile(r"[\u0e00-\u0eff]")  # and Lao
THAI_RUN = re.compile(r"[\u0e00-\u0eff]+")
THAI_GAP = re.compile(r"\s+")
_WIDE = "。！？｡"


def _cheapest(run: str, dictionary: frozenset[str]) -> tuple[str, ...]:
    """The cheapest path through the lattice of dictionary words over a run of letters.

    A dictionary word costs 1, a letter that no word covers 2; adjoining uncovered letters form one word of their own.
    """
    n = len(run)
    cost, back = [0.0] + [1e9] * n, [0] * (n + 1)
    for i in range(n):
        here = cost[i]
        if here + 2 < cost[i + 1]:
            cost[i + 1], back[i + 1] = here + 2, i
        for j in range(i + 1, min(n, i + 14) + 1):
            if run[i:j] in dictionary and here + 1 <= cost[j]:
                cost[j], back[j] = here + 1, i
    words, j, loose = [], n, n
    while j > 0:
        i = back[j]
        if run[i:j] in dictionary:
            if loose > j:
                words.append(run[j:loose])
            words.append(run[i:j])
            loose = i
        j = i
    if loose > 0:
        words.append(run[:loose])
    return tuple(reversed(words))


@lru_cache(maxsize=65_536)
def thai_words(run: str) -> tuple[str, ...]:
    """The words of a run of Thai letters."""
    return _cheapest(run, THAI_WORDS)


@lru_cache(maxsize=65_536)
def cjk_words(run: str) -> tuple[str, ...]:
    """The words of a run of Chinese or Japanese letters; what no listed word covers stays together."""
    return _cheapest(run, CJK_WORDS)


_COUNTED = re.compile(r"\d[\d.,]*\s+[a-zà-ÿ]{4,}\s")
_AMOUNT = re.compile(r"[A-Z]{3}\s\d|[$€£¥]\s?\d")


def _starts_unit(text: str, at: int) -> bool:
    """Whether what stands at ``at`` can open a sentence of a script with case."""
    while at < len(text) and text[at] in "\"'“„«‹‚(¡¿[‘—–-":
        at += 1
        while at < len(text) and text[at] in "   ":
            at += 1
    if at >= len(text):
        return True
    c = text[at]
    if c.isalpha():
        return not c.islower() or (at + 1 < len(text) and text[at + 1].isupper())  # eTickets
    return True


_OPENERS = "(\"'“„«[¿¡/"
_LONGEST = max(map(len, NEVER_FINAL | MAYBE_FINAL | MONTHS)) + 1
_ADDRESS = re.compile(r"(?i)[(\"“]*(?:https?:|www\.|[^\s@]+@)")


class _Words:
    """What looking back from a mark needs of the word before it, carried forward, so that a text is read once.

    Marks are asked for from left to right. No word is cut: of longer ones than all abbreviations it is enough to know that.
    """

    def __init__(self, text: str, start: int) -> None:
        self.text, self.begin, self.seen = text, start, start
        self.core = self.core_of = self.address_of = -1
        self.is_address = False
        self.dotted, self.initials = -1, True  # the last period of the word, and whether only single letters stood between its periods

    def at(self, mark: int, sentence: int) -> int:
        """Where the word before ``mark`` begins, in the sentence that begins at ``sentence``."""
        if mark > self.seen:
            found = max(self.text.rfind(" ", self.seen, mark), self.text.rfind("\n", self.seen, mark)) + 1
            self.begin = found or self.begin
            for gap in _BLANK_RUN.finditer(self.text, found or self.seen, mark):  # white space of other kinds
                self.begin = gap.end()
            self.seen = mark
        return self.begin if self.begin > sentence else sentence

    def bare(self, mark: int, sentence: int) -> str:
        """The word before ``mark`` in lower case, without opening marks; only its end where it is longer than any abbreviation."""
        at = self.at(mark, sentence)
        if at != self.core_of:
            self.core_of = self.core = at
            while self.core < mark and self.text[self.core] in _OPENERS:
                self.core += 1
        return self.text[max(min(self.core, mark), mark - _LONGEST - 1) : mark].lower()

    def single_letters(self, dot: int) -> bool:
        """Whether the word that ``bare`` gave last is of single letters with periods between them; asked at each of its periods."""
        core = self.core
        if dot - core != 1 and self.text[dot - 2] != ".":
            return False
        first = self.dotted < core  # the first period of the word
        self.initials = (first or self.initials) and dot - (core - 1 if first else self.dotted) == 2 and self.text[dot - 1].isalpha()
        self.dotted = dot
        return self.initials and not first

    def address(self, mark: int, sentence: int) -> bool:
        """Whether the word is a web or mail address as far as ``mark``."""
        at = self.at(mark, sentence)
        if at != self.address_of:
            self.address_of = at
            m = _ADDRESS.match(self.text, at)
            self.is_address, self.address_end = m is not None, m.end() if m else 0
        return self.is_address and self.address_end <= mark


class _Ahead:
    """The next place of a pattern from a position on; positions are asked for from left to right, so a text is read once."""

    def __init__(self, pattern: re.Pattern, text: str, end: int) -> None:
        self.find, self.text, self.end, self.place = pattern.search, text, end, -1

    def of(self, at: int) -> int:
        if self.place < at:
            m = self.find(self.text, at, self.end)
            self.place = m.start() if m else self.end
        return self.place


def _word_before(text: str, start: int, at: int) -> str:
    """The word before the white space that ends at ``at``."""
    while at > start and text[at - 1].isspace():
        at -= 1
    i = at
    while i > start and not text[i - 1].isspace():
        i -= 1
    return text[i:at]


def _period_ends(text: str, start: int, dot: int, after: int, words: _Words) -> bool:
    """Whether the single period at ``dot``, with the next word at ``after``, may end a sentence; no space parts the text from
    ``start`` on from what is before it."""
    word = words.bare(dot, start)
    initials = words.single_letters(dot)
    nxt = text[after]
    if nxt.isalpha() and nxt.islower() and not (after + 1 < len(text) and text[after + 1].isupper()):
        return False
    if word == "m" and text[max(start, dot - 9) : dot].rstrip("m").rstrip()[-2:] in ("p.", "a."):  # Spanish: p. m.
        return True
    if word in ("min", "max"):  # before an amount; in upper case it is part of a name
        return text[dot - 3].isupper()
    if len(word) == 1 and word.isalpha():
        before = _word_before(text, start, dot - 1)
        if word == "h" and before[-1:].isdigit():  # hours
            return not nxt.isdigit()
        # a class letter behind its noun, not an initial
        return text[dot - 1].isupper() and len(before) > 3 and before.isalpha() and before.islower() and not nxt.isdigit()
    if word in NEVER_FINAL or word.replace("’", "'").rsplit("'", 1)[-1] in NEVER_FINAL:
        return False
    if initials and word not in MAYBE_FINAL:
        return not (nxt.isdigit() or nxt.isalpha() and not nxt.isupper())
    tail = word.rsplit("-", 1)[-1] if "." in word else word
    if word in MAYBE_FINAL or tail in MAYBE_FINAL:
        following = text[after : after + 6].split(None, 1)
        if _AMOUNT.match(text, after):
            return False
        if nxt.isdigit():  # a number that a noun follows begins a sentence: 2 pieces
            return _COUNTED.match(text, after) is not None
        return not (following and following[0].rstrip(".,;") in LEGAL_FORMS) and not (nxt.isdigit() or nxt in "&")
    if word in MONTHS:
        return not nxt.isdigit()
    if word.isdigit() and len(word) <= 2:
        m = re.match(r"[^\W\d_]+", text[after:after + 12])
        if m and m[0].lower() in MONTHS:
            return False
    return True


_CJK = re.compile(r"[぀-ヿ㐀-鿿「『【《]")
_LATIN_START = re.compile(r"[A-ZÀ-Þ](?:[a-zß-ÿ'’]|\s)|[A-Z][A-Z][a-z]")
_SMALL = re.compile(r"[a-zß-ÿ]{3}")
_WIDE_END = re.compile(r"[。！？｡\n]|[.!?]\s")
_BLANK_RUN = re.compile(r"\s+")


def _joined(text: str, start: int, mark: int, after: int, words: _Words, cjk: _Ahead, wide_end: _Ahead) -> bool:
    """Whether a sentence begins without a space behind the terminator at ``mark``: in another script, or the space was lost."""
    nxt = text[after]
    if nxt.isupper() and _LATIN_START.match(text, after):  # the space was lost
        i = mark
        while i > start and text[i - 1] in "\"”»)":
            i -= 1
        ends_in_word = i - 3 >= words.at(mark, start) and _SMALL.match(text, i - 3)
        if (ends_in_word or text[mark - 1] in ")%" or text[mark - 1].isdigit() and text[mark] == ".") and mark > start and not words.address(mark, start):
            return words.bare(mark, start) not in NEVER_FINAL
    if _CJK.match(nxt):
        return True
    if nxt in "“（":  # what is quoted tells the script
        return cjk.of(after) < wide_end.of(after)
    if not nxt.isupper() or not (text[mark - 1].islower() or text[mark - 1].isdigit() or text[mark - 1] in ")%"):
        return False
    return cjk.of(after) < wide_end.of(after)


# Scripts without letter case in which a full stop only abbreviates
_DANDA = re.compile(r"[ऀ-෿]")
_CASELESS = re.compile(r"[֐-ࣿऀ-෿]")


class _Lattice:
    """The boundaries of running text as a lattice: nodes are possible ends of sentences, edges possible sentences.

    A path's score is the sum of its nodes' weights. An edge is missing only where the sentence would start at a place that
    excludes its end: a number that leads a sentence does not end it, and a quotation that opens a sentence goes on with what
    follows it. So of the paths to a node only the best two with different starts matter, and the best path is found in one
    pass. Of equal paths the one with the earlier ends is taken.
    """

    def __init__(self, start: int) -> None:
        self.nodes: list[tuple[int, int, int]] = []  # boundary, start of what follows, the node before on the best path to it
        self.best = self.second = (0.0, start, -1)  # score, start of the open sentence, its last node

    def add(self, boundary: int, after: int, weight: float, not_from: int = -1) -> None:
        """A node; no sentence that starts at ``not_from`` ends here."""
        score, begin, last = self.best if self.best[1] != not_from else self.second
        if begin == not_from:
            return
        self.nodes.append((boundary, after, last))
        path = (score + weight, after, len(self.nodes) - 1)
        if path[0] > self.best[0]:
            self.best, self.second = path, self.best
        elif path[0] > self.second[0]:
            self.second = path

    def path(self) -> list[tuple[int, int]]:
        """(boundary, start of what follows) of the nodes on the best path."""
        found, at = [], self.best[2]
        while at >= 0:
            boundary, after, at = self.nodes[at]
            found.append((boundary, after))
        return found[::-1]


# weights of nodes: a terminator outside quotations; one that a number precedes; a quotation that holds one
STOP, NUMBERED, QUOTED = 1.0, 0.9, 0.75


def _paragraph(text: str, start: int, end: int, out: list[tuple[int, int]]) -> None:
    """Appends the sentences of running text, without surrounding white space."""
    if EVENT.search(text, start, end) is None:
        _emit(text, start, end, [], out)
        return
    depth: list[str] = []
    opened = start
    devanagari: bool | None = None
    straight = False
    marks: int | None = None
    pos = piece = start  # piece: where text began that no space parts from what is before
    words: _Words | None = None
    cjk = wide_end = None
    lattice = _Lattice(start)
    find = EVENT.search

    def joined(mark: int, after: int) -> bool:
        nonlocal words, cjk, wide_end
        if cjk is None:
            cjk, wide_end = _Ahead(_CJK, text, end), _Ahead(_WIDE_END, text, end)
        words = words or _Words(text, start)
        return _joined(text, piece, mark, after, words, cjk, wide_end)

    while True:
        m = find(text, pos, end)
        if m is None:
            break
        c = m[0]
        pos = m.end()
        first = c[0]
        if first == '"':
            marks = text.count('"', pos, end) if marks is None else marks - 1  # those behind it
            if straight:
                straight = False
                closed = True
            elif marks % 2 == 0 and text[m.start() - 1 : m.start()].isdigit():
                continue  # an inch mark: it follows a digit, and the marks behind it are pairs
            else:
                straight, closed, opened = True, False, m.start()
        elif first in "“”„«»「」『』()（）[]【】":
            if depth and first in depth[-1]:
                depth.pop()
                closed = first not in ")）]】"
            elif first in PAIR:
                depth.append(PAIR[first])
                closed = False
                if first not in "(（[【":
                    opened = m.start()
            else:
                closed = False  # an unmatched closing mark
        else:
            closed = False
        if depth or straight:
            continue
        quoted = closed
        if first in '"“”„«»「」『』()（）[]【】':
            if not closed:
                continue
            # a closed quotation ends the sentence if a terminator stands in it and the text does not go on
            i = m.start()
            while i > start and text[i - 1].isspace() and text[i - 1] != "\n":
                i -= 1
            if i <= start or text[i - 1] not in ".!?。！？｡…" + _OWN_STOPS:
                continue
        after = pos
        while after < end and text[after].isspace():
            after += 1
        if after >= end:
            continue
        spaced = after > pos
        nxt = text[after]
        weight, not_from = STOP, -1
        if quoted:
            weight = QUOTED
            if nxt.isalpha() and (nxt.islower() or nxt.isupper()):
                if not spaced or not _starts_unit(text, after):
                    continue
            elif nxt in ".,;:!?؟،。，、；：！？…":
                continue
            elif nxt.isalpha():
                if text.startswith(CONTINUES_AFTER_QUOTE, after):
                    continue
                not_from = opened
        elif first in _WIDE:
            if nxt in "”」』）)】":
                continue
        elif first in _OWN_STOPS:
            pass
        elif first == ".":
            words = words or _Words(text, start)
            if not spaced and not (len(c) == 1 and joined(m.start(), after)):
                continue
            if len(c) > 1:  # dots that stand for something left out
                if not nxt.isupper() or text[m.start() - 1 : m.start()].isspace():
                    continue
            else:
                if devanagari is None:
                    devanagari = _DANDA.search(text, start, end) is not None
                if devanagari and _DANDA.match(text[m.start() - 1]):
                    continue  # there a period only abbreviates
                if _CASELESS.match(nxt):
                    word = words.bare(m.start(), piece)
                    if len(word) == 1 and word.isalpha() or word in NEVER_FINAL:
                        continue
                else:
                    if not _period_ends(text, piece, m.start(), after, words):
                        continue
                    if text[m.start() - 1].isdigit():
                        word = words.bare(m.start(), piece)
                        if len(word) <= 2 and word.isdigit():
                            weight, not_from = NUMBERED, m.start() - len(word)
        elif first == "…":
            if not spaced or not nxt.isupper():
                continue
        elif not (_starts_unit(text, after) if spaced else joined(m.start(), after)):  # ! or ?
            continue
        lattice.add(pos, after, weight, not_from)
        if not spaced:
            piece = after
    _emit(text, start, end, lattice.path(), out)


def _emit(text: str, start: int, end: int, path: list[tuple[int, int]], out: list[tuple[int, int]]) -> None:
    """The units of a path, parted at gaps where the script may have such."""
    gaps = _CJK_GAP.search(text, start, end) is not None
    for boundary, after in [*path, (end, end)]:
        if start < boundary:
            if gaps:
                _part_at_gaps(text, start, boundary, out)
            else:
                out.append((start, boundary))
        start = after


_CJK_RUN = re.compile(r"[぀-ヿ㐀-鿿]+")
_CJK_GAP = re.compile(r"(?<=[぀-ヿ㐀-鿿])\s+(?=[぀-ヿ㐀-鿿「『【《])")


def _part_at_gaps(text: str, start: int, end: int, out: list[tuple[int, int]]) -> None:
    """A unit between terminators; in Chinese and Japanese its gaps part it where a word before ends or one behind opens a sentence."""
    begin, seen, depth = start, start, 0
    for gap in _CJK_GAP.finditer(text, start, end):
        for c in text[seen : gap.start()]:
            depth += (c in "「『（(【《“") - (c in "」』）)】》”")
        seen = gap.start()
        if depth > 0:
            continue
        i = gap.start()
        while i > begin and _CJK_RUN.match(text[i - 1]):
            i -= 1
        last = cjk_words(text[i : gap.start()])[-1]
        run = _CJK_RUN.match(text, gap.end(), end)
        first = cjk_words(run[0])[0] if run else ""
        if last in CJK_FINAL and first not in CJK_WORDS - CJK_FINAL - CJK_OPENING or first in CJK_OPENING:
            out.append((begin, gap.start()))
            begin = gap.end()
    out.append((begin, end))


Openings = dict[str, bool]  # beginnings of runs, with "$" behind a whole run: whether a sentence opens with them
SHORTEST, LONGEST_OPENING = 4, 12  # letters of a beginning that is told apart


def opens_sentence(run: str, openings: Openings | None) -> bool:
    """Whether a sentence opens with this run behind a gap: with a listed word, or by the longest beginning that was learned."""
    if thai_words(run)[0] in THAI_OPENING:
        return True
    if not openings:
        return False
    marked = f"{run}$"
    return next((openings[marked[:k]] for k in range(min(len(marked), LONGEST_OPENING), SHORTEST - 1, -1) if marked[:k] in openings), False)


def learn_openings(df: DataFrame, text: str | Column, least: int = 5, share: float = 0.3, most: int = 20_000) -> Openings:
    """What all texts of ``df`` show of the beginnings of runs in scripts without terminators.

    A beginning of 4 to 12 letters opens sentences if at least ``share`` of its places that could open one (behind a gap, or
    at the start of a block) are starts of blocks; ``least`` such places are needed to tell. Of two beginnings the longer
    decides, so only those are kept that decide otherwise than the one a letter shorter, at most ``most`` (the size of the
    model), those of the most places first. Texts without such letters are left out before Python; counts are folded per batch.
    """
    column = F.col(text) if isinstance(text, str) else text
    source = df.select(column.alias("_text")).where(F.col("_text").rlike(r"[\x{0e00}-\x{0eff}]"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            starts: Counter = Counter()
            gaps: Counter = Counter()
            for t in batch["_text"].tolist():
                for block in BLANK.split(t):
                    for i, m in enumerate(_GAPPED_RUN.finditer(block.strip())):
                        marked = f"{m[1]}$"
                        into = starts if i == 0 and m.start() == 0 else gaps
                        into.update(marked[:k] for k in range(SHORTEST, min(len(marked), LONGEST_OPENING) + 1))
            keys = list(starts.keys() | gaps.keys())
            yield pd.DataFrame({"opening": pd.Series(keys, dtype=object), "starts": pd.Series([starts[k] for k in keys], dtype="int64"), "places": pd.Series([starts[k] + gaps[k] for k in keys], dtype="int64")})

    counted = source.mapInPandas(count, "opening string, starts bigint, places bigint").groupBy("opening").agg(F.sum("starts").alias("starts"), F.sum("places").alias("places"))
    told = counted.where(F.col("places") >= least).select("opening", "places", (F.col("starts") >= share * F.col("places")).alias("opens"))
    shorter = told.select(F.col("opening").alias("_shorter"), F.col("opens").alias("_opens"))
    changed = told.join(shorter, F.expr("left(opening, length(opening) - 1)") == F.col("_shorter"), "left").where(F.col("_opens").isNull() & F.col("opens") | (F.col("_opens") != F.col("opens")))
    return {r["opening"]: r["opens"] for r in changed.orderBy(F.desc("places"), "opening").limit(most).collect()}


_GAPPED_RUN = re.compile(r"(?:^|(?<=[\u0e00-\u0eff])\s+)([\u0e00-\u0eff]+)")


def _thai_paragraph(text: str, start: int, end: int, out: list[tuple[int, int]], openings: Openings | None) -> None:
    """Running text in Thai: the gaps that a sentence begins behind; stretches of another script go the usual way."""
    begin = start
    for gap in THAI_GAP.finditer(text, start, end):
        after = gap.end()
        before = gap.start()
        thai_before = THAI.match(text[before - 1]) is not None if before > begin else False
        run = THAI_RUN.match(text, after, end)
        if thai_before and _last_thai(text, begin, before) in THAI_FINAL and after < end and (text[after].isalnum() or run is not None):
            pass  # whatever follows
        elif run is None:
            # a foreign sentence: capital letter, small words, its own terminator before the next Thai letter
            if not (thai_before or text[before - 1].isdigit()) or not text[after : after + 1].isupper() or _demands(text, begin, before):
                continue
            stretch = _FOREIGN.match(text, after, end)
            if stretch is None or not _starts_unit(text, after):
                continue
        else:
            if not opens_sentence(run[0], openings) or thai_before and _demands(text, begin, before):
                continue
        _foreign(text, begin, before, out)
        begin = after
    if begin < end:
        _foreign(text, begin, end, out)


_FOREIGN = re.compile(r"[A-ZÀ-Þ¿¡][^\u0E00-\u0EFF]*?[a-zß-ÿ]{2,}[^\u0E00-\u0EFF]*?\s[a-zß-ÿ]{2,}[^\u0E00-\u0EFF]*?[.!?](?=\s|$)")


def _demands(text: str, begin: int, end: int) -> bool:
    """Whether the Thai word before ``end`` still demands a complement."""
    return _last_thai(text, begin, end) in THAI_DEMANDING


def _last_thai(text: str, begin: int, end: int) -> str:
    """The Thai word before ``end``, or an empty text."""
    i = end
    while i > begin and "\u0e00" <= text[i - 1] <= "\u0eff":
        i -= 1
    return thai_words(text[i:end])[-1] if i < end else ""


def _foreign(text: str, start: int, end: int, out: list[tuple[int, int]]) -> None:
    """A unit of a Thai paragraph; one without Thai letters may hold several sentences."""
    if THAI.search(text, start, end):
        out.append((start, end))
    else:
        _paragraph(text, start, end, out)


def _trim(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and text[start].isspace():
        start += 1
    while end > start and text[end - 1].isspace():
        end -= 1
    return start, end


_LABEL = re.compile(r"^\S{0,12}\s?(?:\d{1,3}(?:\.\d+)*|[A-Z])\.$")  # Section 3.
_END_MARK = ".!?。！？｡…\"”“»」』)）" + _OWN_STOPS


def _block(text: str, start: int, end: int, out: list[tuple[int, int]], openings: Openings | None) -> None:
    start, end = _trim(text, start, end)
    if start >= end:
        return
    cuts = []
    if BULLET.match(text, start, end):
        cuts = [m.start() for m in BULLET_AT.finditer(text, start, end) if m.start() > start]
        cuts = _consistent(text, start, cuts, end)
        for a, b in zip([start, *cuts], [*cuts, end]):
            a, b = _trim(text, a, b)
            if a < b:
                out.append((a, b))
        return
    if "\n" in text[start:end]:
        # a list may follow its paragraph without a blank line
        first = next((m.start() for m in BULLET_AT.finditer(text, start, end) if _opens_list(text, m.start(), end)), None)
        if first is not None and first > start:
            _block(text, start, first, out, openings)
            _block(text, first, end, out, openings)
            return
    elif text[end - 1] not in _END_MARK and not THAI.search(text, start, end):
        # a heading, or running text whose last sentence has no end
        units: list[tuple[int, int]] = []
        _paragraph(text, start, end, units)
        if len(units) == 2 and end - start <= 60 and _LABEL.search(text[units[0][0] : units[0][1]]):
            units = [(start, end)]
        out.extend(units)
        return
    if THAI.search(text, start, end):
        _thai_paragraph(text, start, end, out, openings)
    else:
        _paragraph(text, start, end, out)


def _number(text: str, at: int) -> tuple[str, int] | None:
    """The kind and the value of the list marker at ``at``."""
    m = BULLET.match(text, at)
    if not m:
        return None
    if m[1]:
        return m[1], 0
    kind = "(" if "(" in m[0] else ""
    return (kind + m[3] + "1", int(m[2])) if m[2] else (kind + "a)", ord(m[4][0].lower()) - 96)


def _consistent(text: str, start: int, cuts: list[int], end: int) -> list[int]:
    """The line starts that go on with the list: the same bullet, or the next number of the same kind."""
    kind, value = _number(text, start) or ("", 0)
    good = []
    for at in cuts:
        k, v = _number(text, at) or ("", 0)
        if k == kind and (v == 0 or v == value + 1):
            good.append(at)
            value = v
        elif k != kind and v in (0, 1) and _opens_list(text, at, end):
            kind, value = k, v
            good.append(at)
    return good


def _opens_list(text: str, at: int, end: int) -> bool:
    """Whether a list begins at the line start ``at``: a bullet, or number one, and a complete line before it."""
    found = _number(text, at)
    if found is None or found[1] > 1:
        return False
    i = at
    while i > 0 and text[i - 1].isspace():
        i -= 1
    return i == 0 or text[i - 1] in _END_MARK + ":：" or found[0] in "•‣◦▪●"


def sentences(text: str | None, lines: bool = False, openings: Openings | None = None) -> list[tuple[int, int]]:
    """The (start, end) of every sentence unit, in order, from 0 and exclusive, without surrounding white space.

    ``lines``: every line is split by itself, as in web pages; else only blank lines part blocks, and a line break within
    a block is white space. ``openings``: what ``learn_openings`` found. Null, empty and blank texts have no units. Any text is covered: only white space lies
    between units.
    """
    out: list[tuple[int, int]] = []
    if not isinstance(text, str):
        return out
    pos, n = 0, len(text)
    if lines:
        while pos < n:
            stop = text.find("\n", pos)
            stop = n if stop < 0 else stop
            _block(text, pos, stop, out, openings)
            pos = stop + 1
        return out
    if "\n" not in text:
        _block(text, 0, n, out, openings)
        return out
    for gap in BLANK.finditer(text):
        _block(text, pos, gap.start(), out, openings)
        pos = gap.end()
    _block(text, pos, n, out, openings)
    return out


def sentence_units(df: DataFrame, text: str | Column, lines: str | Column | None = None, keep: tuple[str, ...] = (), openings: Openings | None = None) -> DataFrame:
    """One row per sentence: the ``keep`` columns, ``unit_no`` from 0, ``start_char``, ``end_char``.

    ``text`` and ``lines`` (true where each line is split by itself; null counts as false) are columns or expressions.
    Rows with null, empty or blank text have no units. ``keep`` may not hold the three added names; other columns of the
    input are not read.
    """
    column = F.col(text) if isinstance(text, str) else text
    by_line = F.lit(False) if lines is None else F.col(lines) if isinstance(lines, str) else lines
    source = df.select(*keep, column.alias("_text"), F.coalesce(by_line, F.lit(False)).alias("_lines"))
    kept = [source.schema[k] for k in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["unit_no int", "start_char int", "end_char int"])

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, numbers, starts, ends = [], [], [], []
            for i, (t, by) in enumerate(zip(batch["_text"].tolist(), batch["_lines"].tolist())):
                for k, (a, b) in enumerate(sentences(t, by, openings)):
                    rows.append(i)
                    numbers.append(k)
                    starts.append(a)
                    ends.append(b)
            result = batch[list(keep)].iloc[rows].reset_index(drop=True)
            yield result.assign(unit_no=pd.Series(numbers, dtype="int32"), start_char=pd.Series(starts, dtype="int32"), end_char=pd.Series(ends, dtype="int32"))

    return source.mapInPandas(split, schema)
