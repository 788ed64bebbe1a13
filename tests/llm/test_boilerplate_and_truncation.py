import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from farelode.llm import boilerplate as B
from farelode.llm import truncation as X


def test_tree_learns_and_applies():
    draw = np.random.default_rng(3)
    x = draw.random((400, 4))
    y = ((x[:, 1] > 0.5) & (x[:, 3] < 0.3)).astype(int)
    tree = B.grow_tree(x, y)
    assert (B.apply_tree(tree, x) > 0.5).astype(int).tolist() == y.tolist()
    z = draw.random((400, 4))
    assert ((B.apply_tree(tree, z) > 0.5) == ((z[:, 1] > 0.5) & (z[:, 3] < 0.3))).mean() > 0.95
    assert B.apply_tree(B.grow_tree(x[:3], np.zeros(3)), x).tolist() == [0.0] * 400


def test_held_out_pages():
    """Trained without one page, the tree still tells its lines apart."""
    pages = B.labelled_pages()
    assert sum(len(lines) for _, lines, _ in pages) < 200
    right = total = 0
    for i, (site, lines, labels) in enumerate(pages):
        rest = [p for j, p in enumerate(pages) if j != i]
        x = np.concatenate([B.page_features(t, s) for s, t, _ in rest])
        tree = B.grow_tree(x, np.concatenate([np.array(y) for *_, y in rest]))
        right += int(((B.apply_tree(tree, B.page_features(lines, site)) > 0.5) == np.array(labels)).sum())
        total += len(labels)
    assert right / total > 0.85


def test_page():
    site = B.site_words("https://www.north-air-na1.example/help?x=1")
    text = "North Air\nHome | Book | Sign in\n\nRefunds\nDo not mail coupons for Core tickets! A waiver is not permitted after departure.\n- children: EUR 21\nCookies and snacks on board are not part of the fare.\n© 2024 North Air. All rights reserved."
    assert [n for n, p in B.label_lines(text, site, B.boilerplate_tree()) if p > 0.5] == [0, 1, 7]
    assert B.label_lines(None, site, B.boilerplate_tree()) == [] and B.label_lines(" \n", site, B.boilerplate_tree()) == [] and B.site_words(None) == frozenset()


def test_page_operator(spark):
    df = spark.createDataFrame([(1, "Home\nBook\nRefund is not permitted after departure, as the coupon says.", None, "x"), (2, None, "http://a.example", "x"), (3, "", None, "x"), (4, "Home | Book\n" * 5000, None, "x")], "row_no bigint, text string, url string, line string")
    lines = B.classify_lines(df, "text", "url", keep=("row_no",))
    assert lines.where("row_no = 4 AND NOT is_boilerplate").count() == 0 and lines.where("row_no IN (2, 3)").count() == 0
    assert [(r["row_no"], r["content"]) for r in B.main_content(lines, ("row_no",)).collect()] == [(1, "Refund is not permitted after departure, as the coupon says.")]
    assert B.classify_lines(df.limit(0), "text", "url", keep=("row_no",)).count() == 0


def test_stored_lengths():
    import html

    for t in ("a<b & \"c\" 'd'\n\r\né\U0001f600\\", "", "plain", "x\ty"):
        got = dict(zip(X.REPRESENTATIONS, X.stored_lengths(t)))
        assert got["characters"] == len(t) and got["utf8"] == len(t.encode()) and got["utf16"] == len(t.encode("utf-16-le")) // 2
        assert got["entities"] == len(html.escape(t)) and got["entities_without_quotes"] == len(html.escape(t, quote=False)) and got["entities_utf8"] == len(html.escape(t).encode())
        assert got["json"] == len(json.dumps(t, ensure_ascii=False)) - 2 and got["json_ascii"] == len(json.dumps(t)) - 2
        assert got["crlf"] == len(t.replace("\r\n", "\n").replace("\n", "\r\n"))


WORDS = "the refund of each ticket is due before departure when seats remain and any fee applies to infants or groups unless they rebook".split()


def corpus(n, seed=1):
    """Documents of whole sentences; every fifth of source short is cut at 200 stored bytes as JSON, every ninth of source torn anywhere."""
    draw = random.Random(seed)
    rows, cut = [], set()
    for i in range(n):
        source = ["short", "torn", "whole"][i % 3]
        text = ""
        while len(text) < draw.randint(120, 500):
            text += draw.choice(["\n", " ", " "]) * bool(text) + " ".join(draw.sample(WORDS, draw.randint(6, 12))).capitalize() + "." + ' He said "no".' * (draw.random() < 0.3)
        if source == "short" and len(json.dumps(text)) - 2 > 200:
            t = text
            while len(json.dumps(t)) - 2 > 200:
                t = t[:-1]
            if t.rstrip()[-1] not in '."' or t.rstrip().endswith(('said "', 'no"')):  # between two sentences is no cut
                cut.add(i)
            text = t
        elif source == "torn" and i % 9 == 1:
            at = draw.randint(40, len(text) - 5)
            if text[at - 1].isalpha() and text[at].isalpha() and at > 3:
                text = text[:at] + draw.choice(["", "...", " (more)"])
                cut.add(i)
        rows.append((i, text, draw.choice([source, source.upper(), f" {source}"])))
    return rows, cut


def test_truncated_texts(spark):
    rows, cut = corpus(900)
    df = spark.createDataFrame([(*r, "x") for r in rows] + [(9000, None, "whole", "x"), (9001, " ", "whole", "x"), (9002, "word " * 20_000 + "end.", None, "x")], "doc_id bigint, text string, source string, ending string")
    got = {r["doc_id"]: r for r in X.find_truncated(df, "doc_id", "text", "source").collect()}
    assert set(got) == {r[0] for r in rows} | {9002} and got[9002]["source"] == "unknown" and not got[9002]["truncated"]
    found = {i for i, r in got.items() if r["truncated"]}
    assert len(found & cut) >= 0.97 * len(cut) and len(found - cut) <= 0.03 * len(cut) + 2
    facts = X._facts(X._scan(df, "doc_id", "text", "source"))
    limits = X.hidden_limits(facts).collect()
    assert {r["source"] for r in limits} == {"short"} and 200 in {r["stored"] for r in limits if X.REPRESENTATIONS[r["representation"]] in ("json", "json_ascii", "json_utf8")}
    rates = {r["source"]: r["rate"] for r in X.truncation_rates(spark.createDataFrame(list(got.values()))).collect()}
    assert rates["short"] > 0.5 > rates["torn"] > 0.1 and rates["whole"] < 0.02


def test_truncation_edges(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert X.find_truncated(df, "doc_id", "text", "source").count() == 0
    same = spark.createDataFrame([(i, "The fee is due before depar", "s") for i in range(3)] + [(9, "The fee is due before departure.", "s")], "doc_id bigint, text string, source string")
    assert {r["doc_id"] for r in X.find_truncated(same, "doc_id", "text", "source").where("truncated").collect()} == {0, 1, 2}


@pytest.mark.parametrize("text, bare, mark", [("abc...", "abc", True), ("abc …", "abc", True), ("abc (more)", "abc", True), ("abc [...]", "abc", True), ("abc.", "abc.", False), ("...", "...", False), ("a (min. 5)", "a (min. 5)", False), ("abc" + "." * 300, "abc", True), ("abc" + " " * 300 + "…" + " " * 300, "abc", True), ("abc [ ...]", "abc [ ...]", False)])
def test_marks(text, bare, mark):
    assert X.split_mark(text) == (bare, mark)


def test_broken_characters_are_cuts(spark):
    rows = [(1, "Bitte keine Kupons einsenden. Die Geb\ufffd"), (2, "Bitte keine Kupons einsenden."), (3, "กรุณาติดต่อเคาน์เตอร์ ผู้โดยสารสามารถคืนเ"), (4, "กรุณาติดต่อเคาน์เตอร์ ผู้โดยสารสามารถคืนเ")]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id bigint, text string, source string")
    got = {r["doc_id"]: r["truncated"] for r in X.find_truncated(df, "doc_id", "text", "source").collect()}
    assert got == {1: True, 2: False, 3: True, 4: True}


def test_limits_need_many_different_texts(spark):
    rows = [(i, "s", i % 7, list(range(i % 40, i % 40 + len(X.REPRESENTATIONS)))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text_hash bigint, lengths array<int>")
    assert X.hidden_limits(df).count() == 0
    many = spark.createDataFrame([(i, "s", i, [100 if i % 2 else 30 + i] * len(X.REPRESENTATIONS)) for i in range(60)], "doc_id bigint, source string, text_hash bigint, lengths array<int>")
    assert {r["stored"] for r in X.hidden_limits(many).select("stored").distinct().where(F.col("stored") == 100).collect()} == {100}


@pytest.mark.parametrize("at, above", [({2046: 6, 2047: 1, 2048: 4}, 0), ({2046: 60, 2047: 10, 2048: 40}, 0), ({2045: 30, 2046: 30, 2047: 30, 2048: 5}, 0), ({2047: 1, 2048: 130}, 8), ({2046: 60, 2047: 50, 2048: 40}, 8)])
def test_byte_limit_covers_texts_that_end_below_it(spark, at, above):
    lengths = [n for n, texts in at.items() for _ in range(texts)] + [300 + 17 * i for i in range(90)] + [2049 + 5 * i for i in range(above)]
    utf8 = X.REPRESENTATIONS.index("utf8")
    rows = [(i, "s", i, [n if r == utf8 else 10 * i + r for r in range(len(X.REPRESENTATIONS))]) for i, n in enumerate(lengths)]
    limits = X.hidden_limits(spark.createDataFrame(rows, "doc_id bigint, source string, text_hash bigint, lengths array<int>")).collect()
    assert [(r["representation"], r["stored"], r["texts"]) for r in limits] == [(utf8, 2048, sum(at.values()))]


def test_texts_cut_in_a_script_of_three_bytes(spark):
    draw = random.Random(5)
    letters = "払戻手数料搭乗券変更予約便名出発到着規定運賃座席荷物追加航空会社旅行代理店発行有効期限"
    rows = []
    for i in range(120):
        text = ""
        while len(text) < 60 + i % 40 or i % 3 == 0 and len(text.encode()) < 401:
            text += "".join(draw.choices(letters, k=draw.randint(6, 14))) + str(draw.randint(1, 999)) * draw.randint(0, 1) + "。"
        rows.append((i, text if i % 3 else text.encode()[:400].decode(errors="ignore"), "ja"))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r["doc_id"] for r in X.find_truncated(df, "doc_id", "text", "source").where("at_limit").collect()}
    assert {len(rows[i][1].encode()) for i in range(0, 120, 3)} == {398, 399, 400} and got >= set(range(0, 120, 3))


def test_small_limits_of_a_large_source_and_second_limits_count(spark):
    characters, utf8, ascii_json = map(X.REPRESENTATIONS.index, ("characters", "utf8", "json_ascii"))
    n = len(X.REPRESENTATIONS)
    large = [[500 if i < 200 else 100 + i * 7 % 2000] * n for i in range(10_000)]
    # both limits are in characters; a third of the texts has two accents, which make smaller spikes in other representations
    two = [[m + (2 if r == utf8 else 10 if r == ascii_json else 0) * (i % 3 == 0) for r in range(n)] for m, k in ((300, 120), (700, 30)) for i in range(k)] + [[20 + 13 * i] * n for i in range(60)]
    rows = [(s, i, x) for s, lengths in (("large", large), ("two", two)) for i, x in enumerate(lengths)]
    limits = X.hidden_limits(spark.createDataFrame(rows, "source string, text_hash bigint, lengths array<int>")).collect()
    assert {(r["source"], r["stored"]) for r in limits if r["representation"] == characters} == {("large", 500), ("two", 300), ("two", 700)}
    assert not [r for r in limits if r["source"] == "two" and r["representation"] == ascii_json]


def test_long_words_that_were_cut_are_fragments(spark):
    word = "Umbuchungsgebührenerstattungsantragsformular"
    texts = [f"Bitte senden Sie uns heute das {word} zu."] * 3 + [f"Hier steht nun {word[:30]} anders.", f"Bitte senden Sie uns heute das {word[:30]}", f"Bitte senden Sie uns heute das {word[:20]}", f"Hier steht nun {word[:20]} anders."]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, source string")
    got = {r["doc_id"]: r["ending"] for r in X.find_truncated(df, "doc_id", "text", "source").collect()}
    assert got[4] == got[5] == "fragment"


def test_terminators_stand_before_any_number_of_closing_marks():
    assert X._ends_with_terminator("He said no." + '"' * 500) and X._ends_with_terminator("Nein.“)") and not X._ends_with_terminator("no" + ")" * 500) and not X._ends_with_terminator("")


def test_a_third_of_all_rows_in_one_source_one_text_and_one_ending(spark):
    """Hot groups give the same verdicts as the same texts in small groups."""
    rows, cut = corpus(300)
    hot = [(10_000 + i, "The fee is due before departure.", "hot") for i in range(150)] + [(20_000 + i, "The refund of each ticket is due bef", "hot") for i in range(150)]
    df = spark.createDataFrame(rows + hot, "doc_id bigint, text string, source string")
    got = {r["doc_id"]: r for r in X.find_truncated(df, "doc_id", "text", "source").collect()}
    assert len(got) == 600 and not any(got[10_000 + i]["truncated"] for i in range(150)) and all(got[20_000 + i]["truncated"] for i in range(150))
