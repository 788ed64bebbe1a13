import random

import pytest

from farelode.llm import canonical
from farelode.llm.canonical import UNMATCHED, Issuer, IssuerIndex, Lengths, NameParser, abbreviates, choose_entry, entry_seeds, find_date, fold, issuer_candidates, map_issuers, map_names, name_candidates, name_seeds, name_vocabulary
from farelode.llm.trie import Trie, allowed_distance


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_search_against_all_entries():
    draw = random.Random(1)
    words = {"".join(draw.choices("abc", k=draw.randint(0, 9))) for _ in range(200)}
    trie = Trie((w, w) for w in words)
    for _ in range(600):
        q, k = "".join(draw.choices("abcd", k=draw.randint(0, 10))), draw.randint(0, 3)
        assert trie.search(q, k) == {w: d for w in words if (d := distance(q, w)) <= k}
        ends = {w: min(distance(q[:i], w) for i in range(len(q) + 1)) for w in words}
        found = trie.prefixes(q, k)
        assert {x: e for e, _, x in found} == {w: d for w, d in ends.items() if d <= k}
        assert all(distance(q[:n], x) == e for e, n, x in found)


def exchanged(a, b):
    """The distance with at most one exchange of neighbours counted as one error: every place of it parts both words in two."""
    places = [(i, j) for i in range(len(a) - 1) for j in range(len(b) - 1) if a[i] == b[j + 1] != a[i + 1] == b[j]]
    return min([distance(a, b), *(distance(a[:i], b[:j]) + 1 + distance(a[i + 2 :], b[j + 2 :]) for i, j in places)])


def test_search_with_an_exchange_against_all_entries():
    draw = random.Random(2)
    words = {"".join(draw.choices("abc", k=draw.randint(0, 8))) for _ in range(150)}
    trie = Trie((w, w) for w in words)
    for _ in range(600):
        q, k = "".join(draw.choices("abcd", k=draw.randint(0, 9))), draw.randint(0, 3)
        assert trie.search(q, k, exchange=True) == {w: d for w in words if (d := exchanged(q, w)) <= k}


def test_aliases_and_swaps():
    trie = Trie([("north air", 1), ("air north", 1), ("north air", 2)])
    assert trie.search("nort air", 1) == {1: 1, 2: 1} and trie.search("air north", 0) == {1: 0} and trie.search("x", 2) == {}
    assert Trie([("abcdef", 1)]).search("abdcef", 1) == {} and Trie([("abcdef", 1)]).search("abdcef", 1, exchange=True) == {1: 1}
    assert Trie().search("abc", 3) == {} and [allowed_distance(n) for n in (3, 7, 11, 40)] == [0, 1, 2, 3]


ISSUERS = [
    Issuer("carrier", "Leffenqui Air", "LF9", "OM"), Issuer("carrier", "Sorrin Aviation", "SQ3", "FR"), Issuer("carrier", "Sorrin Express Link", "SQ8", "MY"), Issuer("carrier", "Vázsoryam Air Lines", "VN5", "MX"),
    Issuer("supplier", "Zordrodro Trade Desk", "ZRP3", "CA"), Issuer("supplier", "Jupchosor Travel Services", "JNT5", "CA"),
]


@pytest.mark.parametrize(
    "kind, typed, code",
    [
        ("carrier", "lEFFENQUI aIR", "LF9"), ("carrier", "Air, Leffenqui", "LF9"), ("carrier", "LEFFENQUI-AIR", "LF9"), ("carrier", "LeffenquiAir", "LF9"), ("carrier", "Leffeqnui Air​", "LF9"), ("carrier", "Leffenqui", "LF9"),
        ("carrier", "Leffenqui Air (OM sales)", "LF9"), ("carrier", "Leffenqui Air Ltd / OM stn", "LF9"), ("carrier", " lf9.", "LF9"), ("carrier", "LF-9", "LF9"), ("carrier", "[lf9] leffenqui air", "LF9"), ("carrier", "Leffenqui\xa0Air, OM", "LF9"),
        ("carrier", "Vazsoryam Air Lnies", "VN5"), ("carrier", "Lеffеnqui Аir", "LF9"), ("carrier", "Sorrin", None), ("carrier", "Sorrin Aviaton", "SQ3"), ("carrier", "unknown", None), ("carrier", "n/a", None), ("carrier", "-", None),
        ("carrier", "Martevire Air Lines", None), ("carrier", "ZRP3", None), ("carrier", "", None), ("supplier", "Jupchosor Travel Svcs", "JNT5"), ("supplier", "The Zordrodro Trade Desk Group", "ZRP3"), ("supplier", "Trade Desk Zordrordo", "ZRP3"),
        ("supplier", "x" * 50_000, None), ("carrier", "Leffenqui Air" + " " * 2_500, "LF9"), ("carrier", "(" * 50_000, None), ("carrier", " a/" * 20_000, None), ("carrier", "LF9" + "-" * 50_000, "LF9"),
        ("supplier", "Zordrodro Trd Dsk", "ZRP3"), ("supplier", "Jupchosor Trvl Svc", "JNT5"), ("carrier", "Sorrin Avn", "SQ3"),
    ],
)
def test_issuers(kind, typed, code):
    assert IssuerIndex([i for i in ISSUERS if i.kind == kind]).resolve(typed) == code


def test_issuer_operator(spark):
    rows = [(1, "carrier", "Leffenqui Air", "x"), (2, "carrier", None, "x"), (3, "carrier", "leffenqui air", "x"), (3, "carrier", "leffenqui air", "x"), (4, "nothing", "leffenqui air", "x")]
    got = map_issuers(spark.createDataFrame(rows, "row_no bigint, kind string, typed string, shard string"), ISSUERS)
    assert sorted((r["row_no"], r["canonical"], r["verbatim"]) for r in got.collect()) == [(1, "LF9", True), (2, UNMATCHED, False), (3, "LF9", False), (3, "LF9", False), (4, UNMATCHED, False)]
    assert map_issuers(spark.createDataFrame([], "kind string, typed string"), ISSUERS).count() == 0
    assert map_issuers(spark.createDataFrame([("carrier", "x")], "kind string, typed string"), []).first()["canonical"] == UNMATCHED


ENTRIES = [
    "supplier_offer_LF9_2025-12-08_name-correction-mippel-tevwexlum-regional.pdf", "supplier_offer_LF9_2025-12-08_name-correction-mippel-tevwexlum-domestic.pdf", "terms_page_SQ3_2026-03-04_reissue-guide-drovek-irelefpel-general.html",
    "waiver_notice_JNT5_2026-04-09_waiver-notice-juplem-fenlumpel-international.html", "odd name.pdf",
]


@pytest.fixture(scope="module")
def names():
    parts = [NameParser.entry(e) for e in ENTRIES]
    return NameParser(ISSUERS, {p.doc_type for p in parts if p.doc_type}, {p.topic for p in parts if p.topic}, {p.scope for p in parts if p.scope})


TYPED = {
    "Copy of Leffenqui Air - NAME CORRECTION MIPPEL TEVWEXLUM REGONAL 8 Dec 25 (2).pdf": 0, "LF9_-_mippel_tevwexlun_name_correction_domestic_20251208": 1, "LeffenquiAirNameCorrectionMippelTevwexlumDomestic.PDF": 1,
    "Leffenqui%20Air,%20mippel%20tevwexlum%20name%20correction%20regional%20Dec%202025": 0, "Leffenqui Air name correction mippel tevwexlum": None, "Leffenqui Air name correction mippel tevwexlum general": None,
    "reissue guide drovek irelefpel, Sorrin Aviation REVISED.html": 2, "reissue guide drovek irelefpel 5 Mar 26, Sorrin Aviation": None, "SQ3 reissue guide drovek irelefpel eMar 2026": 2, "reissue guide drovek irelefpel": 2, "scan3010.pdf": None,
    "Waiver Notice Juplem Fenlumpel International - Jupchosor Travel Services": 3, "LF9 reissue guide drovek irelefpel": None, "": None, "x" * 3000: None,
    "reissue guide drovek irelefpel" + " " * 2_500 + ".html": 2, "_" * 40_000 + "odd name.pdf": 4, "-1" * 20_000: None,
}


def test_file_names(spark, names):
    rows = [(i, t, False, "extra") for i, t in enumerate(TYPED)]
    df, entries = spark.createDataFrame(rows, "name_id bigint, typed string, with_type boolean, parts string"), spark.createDataFrame([(e,) for e in ENTRIES], "entry string")
    got = {r["typed"]: r["canonical"] for r in map_names(df, entries, names).collect()}
    assert got == {t: UNMATCHED if n is None else ENTRIES[n] for t, n in TYPED.items()}
    assert {r["canonical"] for r in map_names(df, entries.limit(0), names).collect()} == {UNMATCHED} and map_names(df.limit(0), entries, names).count() == 0


@pytest.mark.parametrize("typed, n", [("supplier-offer-LF9-2025-12-08-name-correction-mippel-tevwexlum-regional", 0), ("TERMS_PAGE_Sorrin-Aviation_04-03-2026_REISSUE-GUIDE-DROVEK-IRELEFPEL-GENERAL.HTML", 2), ("circular_SQ3_2026-03-04_reissue-guide-drovek-irelefpel-general.html", None)])
def test_written_names(names, typed, n):
    parts = names.parse(typed, with_type=True)
    known = [(0, e, NameParser.entry(e)) for e in ENTRIES if NameParser.entry(e).key == parts.key]
    assert choose_entry(parts, known) == (None if n is None else ENTRIES[n])


def test_dates():
    assert [find_date(t)[0] for t in ("a 20260102 b", "a 02-01-2026", "a 2 JAN 26", "a Jan 2026", "a 2 Jna 26", "a 12345", "nothing", "a 2 Jux 26")] == ["2026-01-02", "2026-01-02", "2026-01-02", "2026-01", "2026-01-02", None, None, None]
    assert fold("Vázsoryаm​") == "Vazsoryam"


def test_all_keys_within_the_distance_share_a_shard():
    draw = random.Random(4)
    for _ in range(6000):
        key = "".join(draw.choices("abcdefgh", k=draw.randint(1, 20)))
        name, swapped = key, False
        for _ in range(draw.randint(0, 3)):
            i = draw.randrange(len(name) + 1)
            kind = draw.randrange(4)
            if kind == 3 and not swapped and i + 1 < len(name):
                name, swapped = name[:i] + name[i + 1] + name[i] + name[i + 2 :], True
            elif kind < 3:
                name = name[:i] + draw.choice("xyz") * (kind != 0) + name[i + (kind != 2) :]
        k = allowed_distance(len(name))
        trie = Trie([(key, key)])
        if name and trie.search(name, k, exchange=True):
            assert name_seeds(name, Lengths(frozenset([3, len(key)]))) & set(entry_seeds(key)), (key, name)


def test_names_without_issuer_and_topic(spark):
    listed = [f"terms_page_SQ3_2026-03-04_reissue-guide-{k}-general.html" for k in ("drovek-irelefpel", "abc-de", "mippel-tevwexlum", "mippel-tevwexlud")] + ["odd name.pdf", "LF9 name correction plan 7.pdf", "20.pdf"]
    parser = NameParser(ISSUERS, ["terms_page"], ["reissue-guide", "name-correction"], ["general"])
    typed = {
        "dxovek irelefxel": 0, "rdovek irelefxel": 0, "drovxk iryelefxel": 0, "abcde": 1, "abxde": 1, "mippel tevwexluq": None, "xippel tevwexluq": None, "Odd Name (2).PDF": 4, "od name": 4, "od name 3": None,
        "LF9_name-correction_plan_7": 5, "LF9 nmae correction plan 7": 5, "LF9 name correction plan 8": None, "20 (2).PDF": 6, "21": None,
    }
    names = spark.createDataFrame([(i, n, False) for i, n in enumerate(typed)], "name_id bigint, typed string, with_type boolean")
    got = {r["typed"]: r["canonical"] for r in map_names(names, spark.createDataFrame([(e,) for e in listed], "entry string"), parser).collect()}
    assert got == {n: UNMATCHED if e is None else listed[e] for n, e in typed.items()}


def test_candidates_are_all_entries_within_the_distance(spark):
    """Random keys of 4 to 20 letters without issuer and topic, against brute force: no pair within the distance is missing."""
    draw = random.Random(6)
    keys = {"".join(draw.choices("abcdefghij", k=draw.randint(4, 20))) for _ in range(150)}
    keys |= {k[:i] + draw.choice("xyz") + k[i + 1 :] for k in list(keys)[:60] for i in [draw.randrange(len(k))]}
    listed = {f"terms_page_SQ3_2026-03-04_reissue-guide-{k[:2]}-{k[2:]}-general.html": k for k in keys}
    typed = []
    for k in draw.choices(sorted(keys), k=120):
        for _ in range(draw.randint(0, 3)):
            i = draw.randrange(len(k))
            k = draw.choice([k[:i] + "q" + k[i:], k[:i] + k[i + 1 :], k[:i] + "v" + k[i + 1 :], k[:i] + k[i : i + 2][::-1] + k[i + 2 :]])
        typed.append(k)
    parser = NameParser([], ["terms_page"], ["reissue-guide"], ["general"])
    names = spark.createDataFrame([(i, n, False) for i, n in enumerate(typed)], "name_id bigint, typed string, with_type boolean")
    got = {(r["name_id"], listed[r["candidate"]], r["distance"]) for r in name_candidates(names, spark.createDataFrame([(e,) for e in listed], "entry string"), parser).collect()}
    assert got == {(i, k, d) for i, n in enumerate(typed) for k in keys if (d := exchanged(n, k)) <= allowed_distance(len(n))} and len(got) > 100


def test_hot_and_large_shards_and_a_short_vocabulary_change_nothing(spark, names, monkeypatch):
    typed = [t for t in TYPED] * 40
    df = spark.createDataFrame([(i, t, False) for i, t in enumerate(typed)], "name_id bigint, typed string, with_type boolean")
    entries = spark.createDataFrame([(e,) for e in ENTRIES], "entry string")
    monkeypatch.setattr(canonical, "TRIE_ENTRIES", 1)
    got = {(r["typed"], r["canonical"]) for r in map_names(df, entries, names).collect()}
    assert got == {(t, UNMATCHED if n is None else ENTRIES[n]) for t, n in TYPED.items()}
    words = name_vocabulary(entries, most=1)
    assert sum(map(len, words.values())) == 1 and name_vocabulary(entries.limit(0)) == {"doc_type": [], "topic": [], "scope": []}
    few = NameParser(ISSUERS, words["doc_type"], words["topic"], words["scope"])
    whole = spark.createDataFrame([(0, ENTRIES[2].replace("-guide-", " guide "), False), (1, "nothing of these", False)], "name_id bigint, typed string, with_type boolean")
    assert {r["name_id"]: r["canonical"] for r in map_names(whole, entries, few).collect()} == {0: ENTRIES[2], 1: UNMATCHED}


def test_abbreviations_and_issuer_candidates(spark):
    assert abbreviates("tkt", "ticketing") and abbreviates("arlns", "airlines") and not abbreviates("xprs", "express") and not abbreviates("link", "link") and not abbreviates("", "link")
    values = spark.createDataFrame([(1, "carrier", "Sorrin Aviatoin"), (2, "carrier", "none"), (3, "carrier", None), (4, "carrier", "Sorrin Aviatoin")], "row_no bigint, kind string, typed string")
    assert sorted(map(tuple, issuer_candidates(values, ISSUERS).select("row_no", "candidate", "distance").collect())) == [(1, "SQ3", 1), (4, "SQ3", 1)]
