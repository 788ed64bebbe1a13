import random

import pytest

from farelode.llm.pieces import count_tokens, split_oversized, split_text
from farelode.llm.sentences import learn_openings, opens_sentence, sentence_units, sentences, thai_words

TEXTS = [
    ["The waiver covers QAB-QCD (see Sec. 5.66; cf. Annex 50.31) and ends on Jan. 21, 2026.", "Fees may vary."],
    ["Agents of A Pvt. Ltd. are excluded, i.e. at St. Vek terminal 18.", "Documents are reissued through B & Co.", "Do not mail coupons!"],
    ["The residual value ... where there is any ... is kept.", "eTickets issued by C stay valid."],
    ['"Keep this coupon. Is it unused?" is the wording.', 'The notice reads: "Fees may vary."', "Next one."],
    ["Claims must reach us by 9 a.m.", "Two pieces of 12 in. of extra length.", "For Flexi Max.", "Use (min. EUR 5) it."],
    ["Gemäß Abs. 44 Nr. 38 gilt ab dem 3. März eine Gebühr von 1.250,00 EUR.", "Das Büro der X GmbH & Co. KG schließt um 18.30 Uhr.", "Je Ticket fallen binnen 9 Std. USD 49 an.", "„Keine Erstattung. Bitte fragen.“ steht da."],
    ["M. le chef et Mme la caissière signent le 1er avr. 2026.", "« Aucun remboursement. Voir le guichet. » figure ici.", "Attention au délai de 40 h !", "L'avis n° 41 couvre tout, etc."],
    ["Según el art. 8 de la circular n.º 27, se paga.", "La Sra. agente atiende hasta las 6 p. m.", "¿Se admite el canje?", "La nota dice: «Sin reembolso. Consulte.» y vale."],
]
SPACELESS = [
    ["“票价不退！”柜台如此答复。", "通告写明：“概不退款。请到柜台办理。”并适用于此。", "可以吗？"],
    ["案内には「払い戻しはできません。窓口へ。」と書かれています。", "郵送はご遠慮ください！", "手荷物は33.2キロまでです。"],
]
OTHERS = [
    ["ورد في الإشعار: «لا استرداد. راجع المكتب.» وهو سارٍ.", "يوقّع د. مدير المكتب على التعميم رقم 4.", "هل الإلغاء ممكن؟"],
    ['नोटिस में लिखा है, "धनवापसी बंद है। पूछें।" और यह लागू है।', "सीमा 12 कि.ग्रा. है।", "डॉ. का प्रमाणपत्र रु. 700 देना होगा।"],
    ["กรุณาติดต่อเคาน์เตอร์ภายใน 40 ชม. หลังออกตั๋ว", "ประกาศฉบับที่ 40 มีผลถึงวันที่ 21 มี.ค. 2569", "บัตรโดยสารประเภท Lite Go ไม่สามารถคืนเงินได้ เว้นแต่ยังไม่ได้ใช้ตั๋ว", "หากมีที่นั่งว่างจะไม่คิดค่าปรับ"],
]


def pieces(text, lines=False):
    return [text[a:b] for a, b in sentences(text, lines)]


@pytest.mark.parametrize("units", TEXTS + OTHERS)
@pytest.mark.parametrize("space", [" ", "  ", "\n"])
def test_spaced_scripts(units, space):
    assert pieces(space.join(units)) == units


@pytest.mark.parametrize("units", SPACELESS)
def test_spaceless_scripts(units):
    assert pieces("".join(units)) == units
    assert pieces("Fees may vary." + units[0] + "Cookies are no fare.") == ["Fees may vary.", units[0], "Cookies are no fare."]


def test_thai_and_foreign_sentences():
    assert pieces("กรุณาติดต่อเคาน์เตอร์ก่อนออกเดินทาง All fees are per sector. Contact us by phone. ภาษีสนามบินจะคืนให้ 5% ของมูลค่าตั๋ว") == ["กรุณาติดต่อเคาน์เตอร์ก่อนออกเดินทาง", "All fees are per sector.", "Contact us by phone.", "ภาษีสนามบินจะคืนให้ 5% ของมูลค่าตั๋ว"]
    assert "".join(thai_words("กรุณาติดต่อกกก")) == "กรุณาติดต่อกกก" and thai_words("กรุณาติดต่อ") == ("กรุณา", "ติดต่อ")


def test_blocks_and_lists():
    text = "Section 3. Reissue\n\nOne is here. Two\nis there.\n\n1. First. Item\n2. No. 12, QAB\n\n• a; b\n• c\nwraps\n\nA. General\n\n\n(a) x\n(b) y"
    assert pieces(text) == ["Section 3. Reissue", "One is here.", "Two\nis there.", "1. First. Item", "2. No. 12, QAB", "• a; b", "• c\nwraps", "A. General", "(a) x", "(b) y"]
    assert pieces("One is\nhere.\nMenu", lines=True) == ["One is", "here.", "Menu"]


@pytest.mark.parametrize("text", [None, "", " \n\n ", 5])
def test_nothing(text):
    assert sentences(text) == []


def test_every_character_but_white_space_is_covered():
    draw = random.Random(4)
    marks = list(" \n.!?。！？।\"“”«»()「」•-1aAéไก字の،؟…") + ["\n\n", "No.", "Mr. ", "http://x.y "]
    for _ in range(3000):
        text = "".join(draw.choices(marks, k=draw.randint(1, 40)))
        for lines in (False, True):
            end = 0
            for a, b in sentences(text, lines):
                assert end <= a < b and not text[end:a].strip() and text[a:b] == text[a:b].strip()
                end = b
            assert not text[end:].strip()


def test_operator(spark):
    rows = [(1, "One. Two", False, "x"), (1, "One. Two", False, "x"), (2, None, None, "x"), (3, "a\nb", True, "x"), (4, "Word. " * 20_000, False, "x")]
    df = spark.createDataFrame(rows, "row_no bigint, body string, web boolean, start_char string")
    got = sentence_units(df, "body", "web", keep=("row_no",)).collect()
    assert sorted(tuple(r) for r in got if r["row_no"] < 4) == [(1, 0, 0, 4), (1, 0, 0, 4), (1, 1, 5, 8), (1, 1, 5, 8), (3, 0, 0, 1), (3, 1, 2, 3)]
    assert sum(r["row_no"] == 4 for r in got) == 20_000
    assert sentence_units(df.limit(0), "body", keep=("row_no",)).count() == 0


def test_tokens():
    assert [count_tokens(t) for t in ("a b,c", "字字 a", "ไทย", "", " \n", "aカb")] == [2, 3, 3, 0, 0, 3]


@pytest.mark.parametrize("limit, overlap", [(150, 30), (10, 0), (10, 9), (7, 3), (1, 0)])
def test_pieces_keep_the_rules(limit, overlap):
    draw = random.Random(limit)
    for _ in range(60):
        text = "".join(draw.choice(["word ", "word. Next ", "字", "\n\n", "\n- item ", "longer "]) for _ in range(draw.randint(1, 400)))
        found, n = split_text(text, draw.random() < 0.3, limit, overlap), count_tokens(text)
        if n <= limit:
            assert found == []
            continue
        assert found[0][1] == 0 and found[-1][2] == n and found[-1][6] == "end"
        for p, q in zip(found, found[1:]):
            assert q[5] == min(overlap, p[2] - p[1]) == p[2] - q[1] and q[2] > p[2]
        assert all(0 < p[2] - p[1] <= limit and count_tokens(text[p[3] : p[4]]) == p[2] - p[1] for p in found)


def test_cuts_at_natural_boundaries():
    text = "\n\n".join(" ".join(f"w{i}" for i in range(30)) + "." for _ in range(12))
    assert {p[6] for p in split_text(text)} == {"paragraph", "end"} and {p[7] for p in split_text(text)} == {"natural"}
    assert {p[7] for p in split_text(" ".join(["w"] * 151) + ".")} == {"forced"} and split_text(" ".join(["w"] * 150)) == []
    with pytest.raises(ValueError):
        split_text("x", limit=5, overlap=5)


@pytest.mark.parametrize("limit, overlap", [(150, 30), (20, 5), (10, 0)])
def test_no_natural_boundary_is_passed_over(limit, overlap):
    """A piece that ends inside a unit has begun with that unit, or with what was left of it; and a piece closed at a boundary had no room for the next part."""
    draw = random.Random(overlap)
    for _ in range(150):
        units = [" ".join(["Fees", *["due"] * (draw.choice([1, 2, limit // 3, limit - overlap, limit - 1, limit, limit + 1, 3 * limit]) - 1)]) + "." for _ in range(draw.randint(2, 9))]
        text = " ".join(units)
        starts, at = {0}, 0
        for u in units:
            at += count_tokens(u)
            starts.add(at)
        found = split_text(text, limit=limit, overlap=overlap)
        new = 0
        for p in found:
            if p[2] not in starts:
                assert not any(new < s < p[2] for s in starts), (p, sorted(starts))
            elif p[6] != "end":
                following = min(s for s in starts if s > p[2])
                assert following - p[1] > limit
            new = p[2]


def test_a_unit_is_split_only_where_it_fits_no_piece():
    two = " ".join(["Fees " + "due " * 138 + "now."] * 2)
    assert [p[2] for p in split_text(two)] == [140, 260, 280] and [p[6] for p in split_text(two)] == ["sentence", "word", "end"]
    assert [p[2] for p in split_text("字" * 400)] == [150, 270, 390, 400]
    assert [p[2] for p in split_text("字" * 20 + " " + "字" * 200)] == [20, 150, 220]


def test_piece_operator(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "w " * 400, "x"), (4, "w " * 150, "x")], "row_no bigint, text string, cut_kind string")
    got = split_oversized(df, "text", keep=("row_no",)).collect()
    assert {r["row_no"] for r in got} == {3} and len(got) == 4 and split_oversized(df.limit(0), "text", keep=("row_no",)).count() == 0


@pytest.mark.parametrize(
    "units",
    [["Fees are due on the date of issue.", "What happens then?", "Mipel waives it."], ["It costs EUR 254.", "Do not mail it."], ["See www.kal.example/rules.v53.html and entry FXN*15."], ["The code is C-5175/25.", "A waiver is due."], ["By 6 p.m.", "「変更不可。」という。"]],
)
def test_lost_spaces(units):
    assert pieces("".join(units)) == units
    assert pieces(" ".join(units)) == units


@pytest.mark.parametrize("units", [["Si hay plazas en clase Q.", "La nota dice que sí."], ["Des frais sont dus sous 40 h.", "D'après l'art. 17, la pénalité atteint 40%."], ["Documents are reissued through A Inc.", "70 pieces of up to 2 kg are included."], ["As J. Smith said, it is so."]])
def test_short_words_before_a_period(units):
    assert pieces(" ".join(units)) == units


@pytest.mark.parametrize("unit", ["Ab.", "A. ", '"a." ', " \n", "- a\n", "-", "字。", "กรุณา", "(", "http://a.B", "| ", ".", '1"', "A.", "字 ", "a@b.C", "(No."])
def test_very_long_texts_take_time_in_proportion(unit):
    import time

    start = time.process_time()
    for lines in (False, True):
        sentences("x" + unit * (60_000 // len(unit)) + "y", lines)
    split_text("x" + unit * (60_000 // len(unit)) + "y")
    assert time.process_time() - start < 20  # quadratic work would take minutes


@pytest.mark.parametrize(
    "units",
    [
        ["กรุณาติดต่อเคาน์เตอร์ค่ะ", "สิทธิ์นี้ใช้ได้"], ["ตั๋วคืนเงินได้ครับ", "20 กิโลกรัมต่อคน"], ["ตั๋วนี้คืนเงินได้", "เราขอสงวนสิทธิ์"], ["ตั๋วนี้มีสถานะ มูลค่า"],
        ["手数料がかかります", "変更はできません", "払戻は7日です"], ["航空券は変更できます ので確認が必要"], ["料金 手数料"], ["ますます 料金が上がる"], ["退票已经办理了", "旅客须支付费用"], ["为了 旅客"], ["手续费另收", "如果航班取消则全额退款"], ["変更は可能", "ただし手数料が必要"], ["「無料です 変更できます」と言った"],
    ],
)
def test_gaps_of_scripts_without_spaces(units):
    text = " ".join(units)
    assert [text[a:b] for a, b in sentences(text)] == units


@pytest.mark.parametrize("unit", ["x" * 400 + ".", "http://a.example/" + "b." * 400 + "Cd", "(" * 400 + "x" * 400 + ")" * 400 + "."])
def test_words_of_any_length_are_whole(unit):
    """What stands more than 300 characters before a mark counts as what stands nearer."""
    assert pieces(f"See {unit} The next one.") == ([f"See {unit}", "The next one."] if unit[-1] == "." else [f"See {unit} The next one."])
    assert pieces(f"{'y' * 400} No. 12 is due.") == [f"{'y' * 400} No. 12 is due."]
    assert pieces("A.B" * 200 + ". The next one.") == ["A.B" * 200 + ".", "The next one."]


@pytest.mark.parametrize(
    "units",
    [["សំបុត្រនេះមិនអាចប្តូរបានទេ។", "សូមទាក់ទងការិយាល័យ៕"], ["လက်မှတ်ကို ပြောင်းလဲနိုင်သည်။", "ရုံးသို့ ဆက်သွယ်ပါ။"], ["འདི་ནི་དེབ་ཡིན།", "ང་འགྲོ་གི་ཡིན།"], ["ትኬቱ አይመለስም።", "እባክዎ ቢሮውን ያነጋግሩ።"], ["Տոմսը չի վերադարձվում։", "Դիմեք գրասենյակ։"]],
)
def test_full_stops_of_other_scripts(units):
    assert pieces(" ".join(units)) == units


def test_inch_marks_are_no_quotations():
    assert pieces('Bags of 12" are fine. Others of 20 in. are not. He said "no. Never."') == ['Bags of 12" are fine.', "Others of 20 in. are not.", 'He said "no. Never."']
    assert pieces('The size is "12" here. "Keep this. Now." is the wording.') == ['The size is "12" here.', '"Keep this. Now." is the wording.']


def test_openings_are_learned_from_the_corpus(spark):
    """Lao, for which nothing is listed, and Thai openers that are not listed; words that only stand inside sentences open none."""
    openers, middles = ["ຂ້ອຍຢາກ", "ມື້ນີ້ເຮົາ", "สำนักงานจะ", "วันพรุ่งนี้"], ["ແລະຕໍ່ໄປ", "ที่สนามบิน", "ในกรณีนั้น"]
    draw = random.Random(3)
    say = lambda: " ".join([draw.choice(openers) + draw.choice(["ໄປ", "มาก", "ດີ"]), *draw.choices(middles, k=draw.randint(0, 3))])
    told = [[say() for _ in range(draw.randint(1, 4))] for _ in range(400)]
    df = spark.createDataFrame([(" ".join(u),) for u in told[:300]] + [(None,), ("",), ("no such letters",)], "text string")
    learned = learn_openings(df, "text")
    assert all(opens_sentence(f"{o}ດີ", learned) for o in openers) and not any(opens_sentence(m, learned) for m in middles) and not opens_sentence("ที่อื่น", learned)
    held_out = [(" ".join(u), u) for u in told[300:]]
    assert all([t[a:b] for a, b in sentences(t, openings=learned)] == u for t, u in held_out)
    assert learn_openings(df.limit(0), "text") == {} and len(learn_openings(df, "text", most=2)) == 2
    assert sentence_units(df, "text", openings=learned).count() == sum(map(len, told[:300])) + 1
