"""Main content of web pages: flat text blocks classified by a small decision tree.

A page is a sequence of lines, the text blocks. Each block is described by shallow features of its own and of its
neighbours: word count, link density, marks, amounts, and how many of its words belong to the site's name. Flat text has
no anchors any more, so link density is the share of a block's characters that lie in anchor-like segments: short
segments between separators (``|``, ``·``, ``/``, ``>``, ``»``) and phrases of site navigation. A CART decision tree is
trained on the small labelled table below (``LABELLED``, under 200 blocks, read once per query on the driver) and sent to
the executors as a few dozen nodes; pages are then classified independently, in Arrow batches, without a shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------------------------------
# Words of site navigation and of boilerplate, by language.
ANCHORS = """
home|book|manage booking|check-in|flight status|baggage|offers|destinations|help centre|contact us|about us|careers|sign in|loyalty club|agents|cargo|seats and meals|media room|login|register|menu|search
startseite|buchen|meine buchung|gepäck|angebote|reiseziele|hilfe|kontakt|anmelden|karriere|suche
accueil|réserver|ma réservation|bagages|offres|aide|contact|connexion|recherche
inicio|reservar|mi reserva|ofertas|destinos|ayuda|contacto|entrar|empresa|buscar
首页|预订|我的订单|行李|优惠|目的地|帮助中心|联系我们|登录|搜索
ホーム|予約|予約確認|キャンペーン|就航地|ヘルプ|お問い合わせ|ログイン|検索
หน้าแรก|จองตั๋ว|จัดการการจอง|โปรโมชั่น|จุดหมาย|ช่วยเหลือ|ติดต่อเรา|เข้าสู่ระบบ|ค้นหา
الرئيسية|احجز|حجوزاتي|العروض|الوجهات|المساعدة|اتصل بنا|تسجيل الدخول|بحث
होम|बुक करें|मेरी बुकिंग|ऑफ़र|गंतव्य|सहायता|संपर्क|लॉग इन|खोजें
"""
CUES = """
cookie|cookies|tracker|trackers|privacy|consent|accept all|allow all|preferences|settings|newsletter|e-mail address|subscribe|follow us|social channels|share this|share|print|back to top|most read|related pages|you may also like|read more|popular now|top routes|advertisement|sponsored|download our app|sign up|bonus points|chat with us|was this article useful|people are looking|rights reserved|copyright|©|terms of use|accessibility|imprint|sitemap|legal notice|registered in|call centre|next:|previous:|a night|right now|need help|process data|your device
diese website|einstellungen|datenschutz|impressum|agb|alle rechte vorbehalten|nach oben|teilen|meistgelesen|das könnte sie interessieren|folgen sie uns|weiterlesen|speichert daten
traceurs|mentions légales|plan du site|tous droits réservés|haut de page|partager|les plus consultés|à lire aussi|suivez-nous|partenaires utilisent|paramétrer
aviso legal|privacidad|mapa del sitio|todos los derechos reservados|volver arriba|compartir|lo más leído|le puede interesar|síganos|configurar|rechazar
隐私政策|隐私|法律声明|网站地图|版权所有|返回顶部|分享到|相关推荐|关注我们|热门|特价|接受|继续浏览
クッキー|プライバシー|サイトマップ|個人情報保護|無断転載|ページ上部|シェアする|関連ページ|人気の|フォロー|同意
คุกกี้|ความเป็นส่วนตัว|แผนผังเว็บไซต์|สงวนลิขสิทธิ์|กลับด้านบน|แชร์หน้านี้|บทความที่เกี่ยวข้อง|ยอดนิยม|ติดตามเรา|ยอมรับ
ملفات تعريف الارتباط|الخصوصية|خريطة الموقع|جميع الحقوق|العودة للأعلى|مشاركة|قد يهمك|الأكثر قراءة|تابعنا|موافق|أوافق
कुकीज़|गोपनीयता|साइटमैप|सर्वाधिकार|ऊपर जाएँ|साझा करें|यह भी पढ़ें|सबसे लोकप्रिय|फ़ॉलो|स्वीकार
"""
POLICY = """
fare|fares|fee|fees|fee|charge|charges|charged|ticket|tickets|refund|refunds|refundable|rebook|rebooking|reissue|cancellation|passenger|passengers|coupon|coupons|waiver|voucher|penalty|departure|no-show|infants|taxes|tax|counter|surcharge|claims
kupon|kupons|tarif|gebühr|gebührenpflichtig|strafe|ticket|erstattung|umbuchung|stornierung|abflug|kulanz
billet|frais|tarif|pénalité|remboursement|départ|taxe|coupon|guichet
billete|tarifa|reembolso|cupones|salida|impuestos|pasajero|canje|ventanilla
票价|票联|退票|罚金|客票|手续费|税费|起飞|行李限额|改签|退还
運賃|払い戻し|手数料|手荷物|航空券|窓口|変更
ตั๋ว|ค่าธรรมเนียม|คืนเงิน|สัมภาระ|เคาน์เตอร์|บัตรโดยสาร|ค่าปรับ
رسوم|الاسترداد|التذكرة|الغرامة|القسائم|المغادرة|السعر
शुल्क|टिकट|किराये|धनवापसी|कूपन|प्रस्थान|सामान
"""
# Labelled blocks: a page per paragraph, a block per line, B for boilerplate and P for policy text; the first line of a
# page is its site name.
LABELLED = """
pelpel jet
B Pelpel Jet
B Home | Book | Baggage | Offers | Sign in
B We use cookies to make this site work. Accept all | Settings
B Home » Fees And Charges » Northern
P Fees and charges
P Reissue is not allowed after departure. As set out in para. 12, infants pay 30% of the economy penalty.
P 1. adults: EUR 40
P 2. No. 12, QAB-QCD
P 3. QAB-QCD, 25 %
B Most read this week
P Refunds
P Do not mail coupons for Core tickets!
B Advertisement
P Local taxes are added where they apply.
B Was this article useful? Yes / No
P Baggage notes
P Refund vs. voucher: the passenger chooses after no-show.
P The notice of 2 Mar. 2026 reads: "Fees may vary."
P Two pieces of up to 20 kg are included, and approx. 12 in. of extra length is tolerated.
B Related pages
B © 2024 Pelpel Jet. All rights reserved.
B Legal notice · Privacy · Sitemap

ulovis wings
B Baggage
B Cargo
B Help centre
P Waivers
P The waiver covers QAB-QCD and ends on 2 Mar. 2026.
B Next: Travel with pets
P - Lite Go - 34.5% of the fare
P - children: PKR 21
P Claims must reach the desk of Ulovis Wings by 9 p.m.
P Check-in closes early at some stations.
B 12 people are looking at QAB-QCD right now
P Annex 2
P Contact us by phone before you change a group booking.
P Taxes
P Cookies and snacks on board are not part of the fare.
B Popular now: Core fares from EUR 99
B Top routes: QAB-QCD, QAF-QAH
B Sponsored: stay near Osthaven from $99 a night
P The rights of groups are reserved to the group desk.
P Call the refund desk Mon-Fri 9 a.m.-5 p.m.
B Follow Ulovis Wings on social channels
B Get our newsletter: enter your e-mail address
B Your privacy matters to Ulovis Wings. Manage preferences
B Some features need your consent. Ulovis Wings and its partners process data about your device.
B Copyright Ulovis Wings 2024
B Call centre +44 20 7946 0000
B Ulovis Wings, Hangar Road 4, Osthaven
B Ulovis Wings, Hangar Road 12, Port Velim
B Registered in Osthaven under number 12-345
B Terms of use / Accessibility / Imprint

lefsorjup skyways
B Startseite
B Meine Buchung / Kontakt / Gepäck
B Wir verwenden Cookies. Alle akzeptieren | Einstellungen
B Startseite > Name Correction > Zorvek
P Umbuchung
P Gemäß Abs. 44 Nr. 38 gilt ab dem 3. März eine Gebühr von 1.250,00 EUR.
P • Flexi Max: 374 EUR
P • QAB-QCD, 22 %
P Erstattungen
P „Keine Erstattung. Bitte am Schalter fragen.“ steht auf dem Kupon.
B Meine Buchung
P Bitte keine Kupons einsenden! Ist die Stornierung nach Abflug möglich?
B Ab EUR 99: QAB-QCD
P § 4 Gebühren
P Kinder zahlen 28.5%, d. h. höchstens 342 EUR.
B Das könnte Sie interessieren
B Nach oben
B Folgen Sie uns
B © 2024 Lefsorjup Skyways. Alle Rechte vorbehalten.
B Impressum · Datenschutz · AGB

quizor airlines
B Accueil Offres Contact Aide
B Ce site dépose des traceurs. Tout accepter | Paramétrer
P Remboursements
P Si le vol est annulé, le billet Flexi Max est réémis sans frais. Attention au délai de 40 h !
P Art. 5 Frais
P (a) Core : 40 EUR
P (b) QAB-QCD, 12%
B Les plus consultés
P L'avis n° 41 couvre QAB-QCD, etc.
P La taxe, env. 40 EUR, reste acquise à Quizor Airlines.
B Quizor Airlines et ses partenaires utilisent des cookies.
B Dès 99 EUR : QAB-QCD
B Partager
P Modifications
P Le report est-il possible sous 70 h ?
B À lire aussi
B Haut de page
B Suivez-nous
B © 2025 Quizor Airlines. Tous droits réservés.
B Mentions légales · Plan du site

vekire travel
B Inicio > Ayuda > Ofertas > Reservar
B Usamos cookies propias y de terceros. Aceptar | Rechazar
B Vekire Travel respeta su privacidad. Configurar
B Inicio
B Equipaje
B Mi reserva
P Equipaje
P Los impuestos de 6,1 kg no se devuelven, salvo grupos. ¡No envíe cupones por correo!
P 1) Core: 262,64 EUR
P 2) Early Leaf: EUR 76
P Cambios
P La nota dice: «Sin reembolso. Consulte en ventanilla.» y vale hasta el 3 de marzo de 2026.
P El permiso de Vekire Travel S.A. cubre QAB-QCD.
B Lo más leído
P Art. 3 Tasas
P Según el art. 8 de la circular n.º 27, el pasajero paga 175 EUR.
B Desde EUR 99: QAB-QCD
P Reembolsos
P ¿Se admite el canje antes de la salida?
B Compartir
B Le puede interesar
B Volver arriba
B Síganos en las redes
B Aviso legal · Privacidad · Mapa del sitio

thakal airlines
B 行李
B 我的订单
B 本网站使用Cookie。接受 | 设置
B 首页
P 退票规定
P 请勿邮寄票联！根据第57.1条，退票罚金为票价的99%。
P * Core：EUR 40
P * 误机后：52 %
P 改签
P “票价不退！”柜台人员如此答复。行李限额为12公斤，超出部分另行计费。
B 热门航线：QAB-QCD
B 特价USD 99起
P 第三条 税费
P Core票价起飞前不予退还，但团体票不适用。
B 分享到
B 相关推荐
B 返回顶部
B 关注我们
B © 2024 Thakal Airlines 版权所有
B 法律声明 · 隐私政策 · 网站地图

yamnaxvis jet
B 予約 / ヘルプ / ホーム
B 当サイトはクッキーを使用しています。同意する
P 払い戻し
P 郵送はご遠慮ください！出発後の払い戻しは可能ですか？
P – 発券後0時間以内：12%
P 手数料一覧
P 手荷物は23キロまでです。「変更不可。」という表示はCore運賃だけに付きます。
B 人気の路線：QAB-QCD
P 変更
P 航空券ごとにEUR 40の手数料がかかります。
B シェアする
B 関連ページ
B ページ上部へ
B © 2025 Yamnaxvis Jet 無断転載を禁じます
B サイトマップ｜個人情報保護方針

mippel air
B หน้าแรก
B จองตั๋ว
B เว็บไซต์นี้ใช้คุกกี้ ยอมรับทั้งหมด
P การคืนเงิน
P กรุณาติดต่อเคาน์เตอร์ก่อนออกเดินทาง หากมีที่นั่งว่างจะไม่คิดค่าปรับ
P การเปลี่ยนแปลง
P น้ำหนักสัมภาระไม่เกิน 12 กิโลกรัมต่อใบ
B แชร์หน้านี้
B บทความที่เกี่ยวข้อง
B กลับด้านบน
B สงวนลิขสิทธิ์ 2024 Mippel Air
B แผนผังเว็บไซต์ · นโยบายความเป็นส่วนตัว

ostkalpel wings
B الرئيسية / الوجهات / العروض
B يستخدم هذا الموقع ملفات تعريف الارتباط. موافق
P الاسترداد
P لا ترسلوا القسائم بالبريد! هل الاسترداد ممكن بعد المغادرة؟
P - تذكرة: EUR 40
P الرسوم
P وفق المادة 4، تبلغ الغرامة 12% من السعر.
B مشاركة
P التغيير
P إذا أُلغيت الرحلة، تُلغى رسوم EUR 40.
B الأكثر قراءة
B قد يهمك أيضا
B العودة للأعلى
B © 2025 Ostkalpel Wings جميع الحقوق محفوظة

naxkalrin airways
B होम > Cancellation Terms > Wexvaz
B यह साइट कुकीज़ का उपयोग करती है। स्वीकार करें
P शुल्क
P प्रति यात्री रु. 6700 का शुल्क लिया जाएगा। कूपन डाक से न भेजें!
P परिवर्तन
P क्या प्रस्थान से पहले धनवापसी संभव है?
B साझा करें
P धनवापसी
P धारा 9 के अनुसार किराये का 12% काटा जाएगा।
B यह भी पढ़ें
B ऊपर जाएँ
B साइटमैप · गोपनीयता
"""
# ---------------------------------------------------------------------------------------------------------------------

FEATURES = (
    "words", "link_density", "cue_density", "cues", "policy_words", "ends_sentence", "list_item", "amount", "separators", "site_name", "colon", "sentences",
    "words_before", "words_after", "link_before", "link_after", "cue_before", "cue_after",
)
_WORD = re.compile(r"[฀-๿]{1,5}|[぀-ヿ一-鿿]{1,2}|[^\W_]+(?:[-'’.][^\W_]+)*")
_SEPARATOR = re.compile(r"\s*[|·｜>»/]\s+|\s+[|·｜>»/]\s*|｜")
_END = re.compile(r"[.!?؟।。！？…][\"”“»」』)]*\s*$")
_INNER = re.compile(r"[.!?؟।。！？][\"”“»」』)]*(?:\s|$|(?<=[。！？])|(?<=[。！？]”)|(?<=[。！？]」))")
_LIST = re.compile(r"^\s*(?:[•‣▪*–-]\s|\(?(?:\d{1,2}|[a-z])[.)]\s)")
_AMOUNT = re.compile(r"\d\s?%|[A-Z]{3}\s?\d|\d\s(?:EUR|USD|GBP)\b|[$€£]\s?\d")


def _phrases(table: str) -> ahocorasick.Automaton:
    """An automaton over a word table; its values tell the phrase and whether it must stand as whole words."""
    automaton = ahocorasick.Automaton()
    for w in {w for line in table.split("\n") for w in line.split("|") if w}:
        whole = not re.search(r"[฀-๿぀-ヿ一-鿿©]|\W$", w)
        automaton.add_word(w, (w, whole))
    automaton.make_automaton()
    return automaton


def _matches(automaton: ahocorasick.Automaton, low: str) -> Iterator[str]:
    """The phrases in a text, longest first and without overlap; scripts without spaces match anywhere."""
    for end, (phrase, whole) in automaton.iter_long(low):
        if whole:
            before = end - len(phrase)
            if before >= 0 and (low[before].isalnum() or low[before] == "_") or end + 1 < len(low) and (low[end + 1].isalnum() or low[end + 1] == "_"):
                continue
        yield phrase


ANCHOR_WORDS, CUE_WORDS, POLICY_WORDS = _phrases(ANCHORS), _phrases(CUES), _phrases(POLICY)


@lru_cache(maxsize=2_000)
def _letters(phrase: str) -> int:
    return len("".join(_WORD.findall(phrase)))


def _plain(word: str) -> str:
    """Without accents."""
    return word if word.isascii() else "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


def _ascii(word: str) -> str:
    """Without letters that have accents, as some addresses spell names."""
    return word if word.isascii() else word.encode("ascii", "ignore").decode()


@lru_cache(maxsize=100_000)
def _own(line: str, site: frozenset[str]) -> tuple:
    """The features that need no neighbours."""
    low = " ".join(line.lower().split())
    words = _WORD.findall(low)
    n = len(words)
    if not n:
        return (0, 0.0, 0.0, 0, 0, 0, 0, 0, 0, 0.0, 0, 0)
    item = bool(_LIST.match(line))
    parts = [p for p in _SEPARATOR.split(low.strip("|·｜>»/ ")) if p] if not item else [low]
    lettered = [w for w in words if not w[0].isdigit()] or words
    chars = sum(map(len, lettered))
    if len(parts) > 1 and all(len(p.split()) <= 4 for p in parts):
        linked = chars
    else:
        linked = sum(map(_letters, _matches(ANCHOR_WORDS, low)))
    cues = [_letters(m) or 3 for m in _matches(CUE_WORDS, low)]
    policy = sum(1 for _ in _matches(POLICY_WORDS, low))
    ends = bool(_END.search(low))
    named = sum(1 for w in lettered if _plain(w) in site or _ascii(w) in site) / len(lettered)
    return (n, min(1.0, linked / chars), min(1.0, sum(cues) / chars), min(3, len(cues)), min(4, policy), ends, item, bool(_AMOUNT.search(line)), len(parts) - 1, named, ":" in low or "：" in low, len(_INNER.findall(low)))


def page_features(lines: list[str], site: frozenset[str]) -> np.ndarray:
    """One row of ``FEATURES`` per non-blank line; ``site`` holds the words of the site's name."""
    own = [_own(line, site) for line in lines]
    none = (0,) * 5
    rows = []
    for i, f in enumerate(own):
        b = own[i - 1] if i else none
        a = own[i + 1] if i + 1 < len(own) else none
        rows.append((*f, min(b[0], 8), min(a[0], 8), b[1], a[1], b[2], a[2]))
    return np.array(rows, dtype=np.float64).reshape(len(rows), len(FEATURES))


def site_words(name: str | None) -> frozenset[str]:
    """The words of a site's name, from its address or as plain words."""
    if not isinstance(name, str):
        return frozenset()
    host = re.sub(r"^\w+://", "", name.strip().lower()).split("/", 1)[0]
    return frozenset(_plain(w) for w in re.split(r"[^\w]+", host) if w not in ("www", "m", "example", "com", "org", "net", ""))


def grow_tree(x: np.ndarray, y: np.ndarray, depth: int = 12, least: int = 4) -> list[tuple]:
    """A CART tree by Gini impurity: nodes (feature, threshold, left, right) or (-1, share of positives, 0, 0)."""
    nodes: list[tuple] = []

    def grow(rows: np.ndarray, left: int) -> int:
        at = len(nodes)
        nodes.append((-1, float(y[rows].mean()), 0, 0))
        if left == 0 or len(rows) < 2 * least or y[rows].min() == y[rows].max():
            return at
        best = (1e-9, -1, 0.0)
        n, total = len(rows), y[rows].sum()
        base = 2 * total * (n - total) / n
        for f in range(x.shape[1]):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, hits = x[order, f], np.cumsum(y[order])[:-1]
            k = np.arange(1, n)
            gini = 2 * hits * (k - hits) / k + 2 * (total - hits) * ((n - k) - (total - hits)) / (n - k)
            gini[(v[1:] == v[:-1]) | (k < least) | (n - k < least)] = np.inf
            i = int(np.argmin(gini))
            if base - gini[i] > best[0] + 1e-9:
                best = (base - gini[i], f, (v[i] + v[i + 1]) / 2)
        if best[1] < 0:
            return at
        low = x[rows, best[1]] <= best[2]
        a, b = grow(rows[low], left - 1), grow(rows[~low], left - 1)
        nodes[at] = (best[1], float(best[2]), a, b)
        return at

    grow(np.arange(len(y)), depth)
    return nodes


def apply_tree(nodes: list[tuple], x: np.ndarray) -> np.ndarray:
    """The share of positives in the leaf of every row."""
    out = np.zeros(len(x))
    todo = [(0, np.arange(len(x)))]
    while todo:
        at, rows = todo.pop()
        f, value, a, b = nodes[at]
        if f < 0:
            out[rows] = value
        elif len(rows):
            low = x[rows, f] <= value
            todo += [(a, rows[low]), (b, rows[~low])]
    return out


def labelled_pages() -> list[tuple[frozenset[str], list[str], list[int]]]:
    """The labelled table as (site, lines, labels), 1 for boilerplate."""
    pages = []
    for page in LABELLED.strip().split("\n\n"):
        site, *blocks = page.split("\n")
        pages.append((site_words(site.replace(" ", "-")), [b[2:] for b in blocks], [int(b[0] == "B") for b in blocks]))
    return pages


def arranged_pages(variants: int, seed: int = 7) -> list[tuple[frozenset[str], list[str], list[int]]]:
    """The labelled pages and ``variants`` other arrangements of each.

    Policy blocks keep their order; a menu may stand before them; all other boilerplate falls between any two blocks, as
    in real pages. This frees the tree from the accidental neighbours of a small table; no label changes.
    """
    pages = labelled_pages()
    draw = np.random.default_rng(seed)
    for site, lines, labels in labelled_pages():
        policy = [line for line, y in zip(lines, labels) if not y]
        other = [line for line, y in zip(lines, labels) if y]
        for _ in range(variants):
            menu = [str(m) for m in draw.permutation([x for x in other if x.lower() in ANCHOR_WORDS])]
            rest = [str(x) for x in draw.permutation([x for x in other if x not in menu])]
            cut = int(draw.integers(0, len(policy)))
            body = [(line, 0) for line in [*policy[cut:], *policy[:cut]]]
            for line in rest:
                body.insert(int(draw.integers(0, len(body) + 1)), (line, 1))
            if draw.random() < 0.3 and menu:  # a single menu entry between the text
                body.insert(int(draw.integers(0, len(body) + 1)), (menu.pop(), 1))
            page = [(m, 1) for m in menu] + body
            pages.append((site, [line for line, _ in page], [y for _, y in page]))
    return pages


@lru_cache(maxsize=4)
def boilerplate_tree(depth: int = 12, variants: int = 20) -> tuple:
    """The tree that the labelled table, in ``variants`` further arrangements, gives."""
    pages = arranged_pages(variants)
    x = np.concatenate([page_features(lines, site) for site, lines, _ in pages])
    return tuple(grow_tree(x, np.concatenate([np.array(y) for *_, y in pages]), depth))


def label_lines(text: str | None, site: frozenset[str], nodes: list[tuple]) -> list[tuple[int, float]]:
    """(line number, probability of boilerplate) of every non-blank line."""
    if not isinstance(text, str):
        return []
    numbered = [(i, line) for i, line in enumerate(text.split("\n")) if line.strip()]
    if not numbered:
        return []
    scores = apply_tree(nodes, page_features([line for _, line in numbered], site))
    return [(i, float(s)) for (i, _), s in zip(numbered, scores)]


def classify_lines(df: DataFrame, text: str | Column, url: str | Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per non-blank line: the ``keep`` columns, ``line_no`` (lines split at line feeds, from 0), ``line``,
    ``boilerplate`` (probability) and ``is_boilerplate`` (more than one half).

    Null, empty and blank texts have no rows; a null address gives no site name. Repeated rows are classified each.
    """
    column = F.col(text) if isinstance(text, str) else text
    address = F.col(url) if isinstance(url, str) else url
    source = df.select(*keep, column.alias("_text"), address.cast("string").alias("_url"))
    schema = ", ".join([f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keep] + ["line_no int", "line string", "boilerplate double"])
    nodes = boilerplate_tree()

    def classify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, numbers, lines, features = [], [], [], []
            for i, (t, address) in enumerate(zip(batch["_text"].tolist(), batch["_url"].tolist())):
                if not isinstance(t, str):
                    continue
                numbered = [(k, line) for k, line in enumerate(t.split("\n")) if line.strip()]
                if not numbered:
                    continue
                features.append(page_features([line for _, line in numbered], site_words(address)))
                rows += [i] * len(numbered)
                numbers += [k for k, _ in numbered]
                lines += [line for _, line in numbered]
            scores = apply_tree(nodes, np.concatenate(features)) if features else np.zeros(0)
            result = batch[list(keep)].iloc[rows].reset_index(drop=True)
            yield result.assign(line_no=pd.Series(numbers, dtype="int32"), line=pd.Series(lines, dtype="object"), boilerplate=scores)

    return source.mapInPandas(classify, schema).withColumn("is_boilerplate", F.col("boilerplate") > 0.5)


def main_content(lines: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The policy text of each page as one ``content`` string, its lines in order. Pages with none have no row.

    The lines of a page are gathered by page, so a task holds one page at a time, never more.
    """
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return lines.where("NOT is_boilerplate").groupBy(*keep).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("content"))
