import copy
import os
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilspark.functions.checks import verhoeff_ok
from veilspark.llm import pii
from veilspark.llm.crf import SkipChainCRF

sys.path.insert(0, os.path.dirname(__file__))
import pii_sentences  # noqa: E402

PEOPLE = [("Ravi", "Oldenwick"), ("Greta", "Marlstead"), ("Tomas", "Fennard"), ("Noor", "Halbrook"), ("Imran", "Westcol"), ("Petra", "Lundale"), ("Viggo", "Harmont"), ("Meenal", "Dravik")]


@pytest.fixture(scope="module")
def model():
    return pii.train(PEOPLE, ["Open payment", "Review mask settings"], texts=4000)


def kinds(model, text):
    return {k for k, _, _ in pii.find_mentions(model, [text])[0]}


ID = next(str(n) for n in range(412_345_678_900, 412_345_679_000) if verhoeff_ok(str(n)))


@pytest.mark.parametrize(
    "text, want",
    [
        ("Receipt sent to greta.marlstead@post.example", {"EMAIL"}), ("type email: noor [at] mail [dot] example", {"EMAIL"}), ("OTP sent to +91-98765-43210", {"PHONE"}), ("Call ８７８.５５５.０１７２ for help", {"PHONE"}),
        (f"ID on file: {ID}", {"ID_NUMBER"}), ("PAN ABCDE1234F (verified)", {"ID_NUMBER"}), ("Enter national id: 912-34-5678", {"ID_NUMBER"}), ("passport B4119341 (verified)", {"ID_NUMBER"}),
        ("Deliver to 12 Harmont Street, Apt 4, Lundale 40213", {"ADDRESS"}), ("Billing: P.O. Box 4021, Westcol 40213", {"ADDRESS"}), ("Payee: Greta Marlstead", {"NAME"}), ("Signed in as Oldenwick, Ravi", {"NAME"}),
        ("Fill the kyc form: name Tomas Fennard; id 912-34-5678; address 12 Dravik Rd., Lundale", {"NAME", "ID_NUMBER", "ADDRESS"}),
        (f"Order no. {ID}", set()), ("Track shipment 162330649992232770", set()), ("@greta", set()), ("v54.24.697 build 6454", set()), ("Balance 49,874.00", set()), ("Model XT-9049-254", set()), ("Name (A to Z)", set()), ("Open payment", set()), ("", set()), ("   ", set()),
    ],
)
def test_kinds(model, text, want):
    assert kinds(model, text) == want


def test_held_out_accuracy(model):
    composer = pii._Composer(PEOPLE, ["Open payment"], seed=99)
    hit = total = wrong = 0
    for _ in range(1500):
        text, spans = composer.sentence()
        want, got = {k for k, _, _ in spans}, kinds(model, text)
        hit, total, wrong = hit + len(want & got), total + len(want), wrong + len(got - want)
    assert hit / total > 0.97 and wrong / total < 0.03


def test_placeholders_keep_the_rest(model):
    text = "Ｃall +91 98765​43210​, or greta@post.example !"
    mentions = pii.find_mentions(model, [text])[0]
    clean = pii.redact_text(text, mentions)
    assert clean.startswith("Ｃall [PHONE]") and clean.endswith("or [EMAIL] !")
    assert "".join(text[a:b] for _, a, b in mentions) not in clean


def test_nulls_repeats_and_long_texts(model):
    long = "The frame is masked. " * 20_000 + "Payee: Greta Marlstead"
    found = pii.find_mentions(model, [None, "Payee: Greta Marlstead", "", "Payee: Greta Marlstead", long, "a" * 200_000, "7" * 200_000])
    assert found[0] == found[2] == [] and found[1] == found[3] != [] and found[4] and found[5] == found[6] == []


def test_columns(spark, model):
    df = spark.createDataFrame([(1, "Payee: Greta Marlstead", "x"), (2, None, "x"), (3, "Open payment", "x")], "id INT, text STRING, kinds STRING")
    out = df.select("id", pii.kinds_column(F.col("text"), model).alias("k"), pii.redacted_column(F.col("text"), model).alias("r"), pii.mentions_column(F.col("text"), model).alias("m")).orderBy("id").collect()
    assert [r.k for r in out] == [["NAME"], None, None]
    assert [r.r for r in out] == ["Payee: [NAME]", None, "Open payment"] and len(out[0].m) == 1 and out[1].m == []
    assert df.limit(0).select(pii.kinds_column(F.col("text"), model)).count() == 0


def test_same_input_same_model():
    a, b = (SkipChainCRF(("O", "X"), lambda k: [k]).fit([["a", "b"], ["b", "c"]] * 20, [[0, 1], [1, 0]] * 20, [[], []] * 20, rounds=20) for _ in range(2))
    assert np.array_equal(a.weights, b.weights)
    assert [x.tolist() for x in a.label([["a", "b"], []], [[], []])] == [[0, 1], []]


def test_loopy_inference_equals_enumeration():
    """One skip link closes one loop: loopy messages come near the exact marginals."""
    rng = np.random.default_rng(5)
    crf = SkipChainCRF(("O", "A", "B"), lambda k: [k])
    crf.transition, crf.skip = rng.normal(0, 0.5, (3, 3)).astype(np.float32), np.array([0, 1.2, 0.8], np.float32)
    e = rng.normal(0, 1, (4, 3)).astype(np.float32)
    exact = np.zeros((4, 3))
    for y in np.ndindex(3, 3, 3, 3):
        w = np.exp(sum(e[i, y[i]] for i in range(4)) + sum(crf.transition[y[i], y[i + 1]] for i in range(3)) + (crf.skip[y[0]] if y[0] == y[3] else 0))
        for i in range(4):
            exact[i, y[i]] += w
    exact /= exact.sum(1, keepdims=True)
    assert np.abs(crf.loopy(e, [(0, 3)], rounds=50) - exact).max() < 0.05
    assert np.allclose(crf.marginals(e[None])[0], crf.loopy(e, []), atol=1e-5)


def test_skip_links_share_labels(model):
    keys, _ = pii.tokens("Ask Greta Marlstead about it. Marlstead knows; Marlstead's form is open")
    links = pii.skip_links(keys)
    assert len(links) == 2 and {keys[i] for pair in links for i in pair} <= {"Marlstead", "Marlstead's"}
    assert all(links[i][1] == links[i + 1][0] for i in range(len(links) - 1))  # a chain of occurrences, not all pairs


def test_links_by_word_and_value():
    link = lambda text: pii.skip_links(pii.tokens(text)[0], [text[a:b] for a, b in pii.tokens(text)[1]])
    assert len(link("Ask Greta Sandoval, then sandoval again")) == 1  # any case, if one of them is capitalised
    assert len(link("Bela Okonjo knows Okonjo-Stern")) == 1  # part of a double name
    assert len(link("call +91 98765 43210 or 9876543210")) == 1 and len(link("Mail A.B@x.example or a.b@X.example")) == 1
    assert link("open the page and open the list") == link("call 415 555 0133 or 415 555 0134") == link("") == []


def test_links_decide(model):
    """On texts the model has not seen, labels of linked tokens are right more often with the links, and some only with them."""
    alone = copy.deepcopy(model)
    alone.skip = np.zeros_like(model.skip)
    composer = pii._Composer(PEOPLE, ["Open payment"], 77)
    texts = [x for x in (composer.labelled(True) for _ in range(3000)) if x[2]]
    keys, gold, links = zip(*texts)
    ends = [(k, i) for k, ls in enumerate(links) for i in {i for pair in ls for i in pair}]
    with_links, without = model.label(keys, links), alone.label(keys, links)
    right = [sum(out[k][i] == gold[k][i] for k, i in ends) / len(ends) for out in (with_links, without)]
    assert right[0] > right[1] + 0.04 and right[0] > 0.9
    text = "We met Marlene Obuya yesterday near the river and Obuya asked for a copy"
    spans = lambda m: [text[a:b] for _, a, b in pii.find_mentions(m, [text])[0]]
    assert spans(model) == ["Marlene Obuya", "Obuya"] != spans(alone)


def test_labels_do_not_depend_on_the_batch(model):
    texts = ["Ask Greta Marlstead. Marlstead knows", "Payee: Noor Halbrook", "", "Call 415 555 0133 now, 4155550133 later", "Mr Westcol, Westcol's note and Imran Westcol " * 30, "x", "Tell Petra Lundale"] * 3
    keys = [pii.tokens(t)[0] for t in texts]
    links = [pii.skip_links(k) for k in keys]
    together = model.label(keys, links)
    for k, ls, got in zip(keys, links, together):
        assert np.array_equal(got, model.label([k], [ls])[0])


def test_odd_digits_brackets_and_accents(model):
    texts = ["२३४५ ६७८९ ०१२३ note", "Ring me (+1 415-555-0133) soon", "x²³¹²³¹²³¹²³¹", "Señal móvil >"]
    found = pii.find_mentions(model, texts)
    assert [texts[1][a:b] for _, a, b in found[1]] == ["+1 415-555-0133"] and found[3] == []
    assert pii.tokens("Zürich")[0] == ["Zürich"] and pii._mixed_key("AB" * 40) != pii._mixed_key("AB" * 39)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data here")
def test_sentences_outside_the_composer():
    """The production model on sentences written by hand."""
    people, ui = pd.read_parquet("/root/testdata/sf0.001/known_people.parquet"), pd.read_parquet("/root/testdata/sf0.001/ui_strings.parquet")
    production = pii.train(list(zip(people.given_name, people.family_name)), list(ui.text))
    for sentences in (pii_sentences.SEEN, pii_sentences.HELD_OUT):
        got = [kinds(production, t) for t, _ in sentences]
        wanted = [(k, g) for (_, want), g in zip(sentences, got) for k in want]
        assert sum(k in g for k, g in wanted) / len(wanted) > 0.9
        assert sum(len(g - want) for (_, want), g in zip(sentences, got)) / len(sentences) < 0.04
