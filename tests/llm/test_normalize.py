import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st

from veilspark.llm import normalize as N

ALIKE = [
    ("Ｒｅｍｏｖｅ ｐａｙｍｅｎｔ", "Remove payment"), ("R⁠é​sumé　up‎lօ\xadad", "Résumé upload"), ("Crédit approuvé", "Crédit approuvé"), ("Conﬁrm ﬃle", "Confirm ffile"), ("Ꮯonﬁrm cарturе", "Confirm capture"),
    ("Sign‐οff\xa0sһeet", "Sign-off sheet"), ("𝖱𝖾𝗆𝗈𝗏𝖾", "Remove"), ("Approⅴe stateⅿent", "Approve statement"), ("﻿Έλεγχos στoιχείων".replace("s", "ς"), "Έλεγχος στοιχείων"), ("Прoверкa данныx", "Проверка данных"), ("Grο̈ße", "Größe"), ("e​́", "é"),
]
OTHER = [("Updaté claim", "Update claim"), ("проверка данных", "Проверка данных"), ("Open file…", "Open file"), ("x²", "x2"), ("①", "1"), ("ſave", "save"), ("ﬁle ", "file"), ("l0ad", "load"), ("Mаsk!", "Mask"), ("два", "2ва")]


@pytest.mark.parametrize("text, plain", ALIKE)
def test_alike(text, plain):
    assert N.skeleton(text) == N.skeleton(plain)
    assert N.canonical(text) == plain and N.canonical(plain) == plain


@pytest.mark.parametrize("text, plain", OTHER)
def test_other(text, plain):
    assert N.skeleton(text) != N.skeleton(plain)


@given(st.text(max_size=80))
def test_forms_are_stable(text):
    s, c = N.skeleton(text), N.canonical(text)
    assert N.skeleton(s) == s
    assert N.skeleton(c) == s
    # splicing segments equals folding the whole text at once
    assert unicodedata.normalize("NFC", s) == unicodedata.normalize("NFC", "".join(map(N._latin, text)))
    folded, places = N.aligned_fold(text)
    assert places is None and folded == text or len(places) == len(folded)


def test_quick_check():
    assert N.quick_check("a") == N.quick_check("é") == N.quick_check("ж") == "yes"
    assert N.quick_check("́") == "maybe"
    assert N.quick_check("​") == N.quick_check("Ａ") == N.quick_check("а") == "no"


def test_null_empty_long():
    assert N.skeleton(None) is None and N.canonical(None) is None
    assert N.skeleton("") == "" and N.canonical("") == ""
    assert N.skeleton("ａ" * 300_000) == "a" * 300_000 and N.canonical("\ud800а") is not None


def test_lookalikes_equal_brute_force(spark, rows):
    known = [(1, "Open file"), (2, "Café"), (3, None), (4, "Ⅳ")]
    texts = ["Open file", "Оpen file", "Open  file", "Café", "Café", None, "", "IV", "open file", "Оpen file", "x" * 100_000]
    t = spark.createDataFrame([(i, x, "k", "c", 7) for i, x in enumerate(texts)], "record_id INT, text STRING, key STRING, known_text STRING, string_id INT")
    k = spark.createDataFrame(known, "string_id BIGINT, text STRING")
    want = sorted((i, x, s) for i, x in enumerate(texts) if x for s, u in known if u and x != u and N.skeleton(x) == N.skeleton(u))
    assert rows(N.lookalikes(t, k).select("record_id", "text", "string_id")) == want and len(want) == 4
    assert N.lookalikes(t.limit(0), k).count() == 0 and N.lookalikes(t, k.limit(0)).count() == 0


def test_columns(spark, rows):
    t = spark.createDataFrame([("Ａb",), ("plain",), (None,), ("",)], "text STRING")
    assert [tuple(r) for r in t.select(N.canonical_text(t.text), N.skeleton_text(t.text)).collect()] == [("Ab", "Ab"), ("plain", "plain"), (None, None), ("", "")]


@pytest.mark.parametrize("text", ["Отправьте SMS через API на HTTP порт", "CPU по HTTP — Wi-Fi, COM, TCP, POST", "Το SMS και PIN", "Удалить маску now", "Оплатить счёт again", "Νέα αίτηση again", "роса на траве", "Удалить mаску", "这是 API 测试"])
def test_canonical_leaves_genuine_words(text):
    assert N.canonical(text) == text


@pytest.mark.parametrize("text, plain", [("сору", "copy"), ("the сору button", "the copy button"), ("Оpen nоw", "Open now"), ("Ρassword again", "Password again"), ("Прoвеpка PC", "Проверка PC")])
def test_canonical_respells_look_alikes(text, plain):
    assert N.canonical(text) == plain


@given(st.text(alphabet="aopce Аорсеѕнт Αορϲκ Աոսօ -", max_size=40))
def test_no_word_becomes_mixed(text):
    mixed = lambda t: {w for w in N._WORD.findall(t) if len(N._alphabets(w)) > 1}
    assert mixed(N.canonical(text)) <= mixed(N._splice(text, False))


def test_segments_are_short():
    """Only what is unstable, and the starter before it, is normalised, in any script."""
    assert N._segments(True).findall("这是一个测试Ａ句子é́。") == ["试Ａ", "é́"]
    assert N._segments(True).findall("यह एक वाक्य") == ["वा", "क्"] and N._segments(True).findall("यह Ａ") == [" Ａ"]
    assert N._segments(True).findall("这是一个测试句子") == N._segments(False).findall("Проверка данных") == []
    assert N.skeleton("한") == "한" and N.skeleton("각") == "각"


def test_characters_outside_the_checked_ranges_are_stable():
    outside = [c for c in (*range(0x80, 0xD800, 3), *range(0xE000, 0x110000, 11)) if not any(a <= c <= b for a, b in N._CHECKED)]
    assert all(N.quick_check.__wrapped__(chr(c)) == N.quick_check.__wrapped__(chr(c), False) == "yes" for c in outside)
