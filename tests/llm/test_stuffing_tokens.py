import os
import random

import pytest
from pyspark.sql import functions as F

from veilspark.llm import stuffing, tokens

WORDS = "frame mask viewer consent panel label field record overlay audit scanner reviewer placeholder session viewport budget selector detector screen layer".split()


def _prose(r, n):
    return " ".join(f"The {r.choice(WORDS)} {r.choice(WORDS)} {r.choice(('keeps', 'drops', 'covers', 'moves', 'reads'))} the {r.choice(WORDS)} {r.choice(('when', 'after', 'because', 'unless'))} the {r.choice(WORDS)} {r.choice(('closes', 'opens', 'fails', 'waits'))} {r.randrange(9, 999)} times." for _ in range(n))


def _stuffed(r, kind, n):
    a, b = r.sample(("card sleeve", "privacy film", "blur tool", "form filler"), 2)
    item = {"words": lambda: f"{r.choice((a, b))} {r.choice(('cheap', 'best', 'online', 'buy'))},", "links": lambda: f"Buy {a} - https://shop{r.randrange(999)}.example/x/{r.randrange(9999)}\n", "tags": lambda: f"#{a.replace(' ', '')} #{b.replace(' ', '')}{r.choice(('cheap', ''))}"}[kind]
    return " ".join(item() for _ in range(n))


def test_pages(spark):
    r = random.Random(8)
    docs, want = [], set()
    for i in range(150):
        docs.append((i, _prose(r, r.randrange(4, 60)), r.choice(("en", "en", None)), "c"))
    for i, kind in enumerate(("words", "links", "tags") * 6):
        docs.append((1000 + i, _prose(r, 1) + "\n" + _stuffed(r, kind, 60), "en", "c"))
        want.add(1000 + i)
    docs += [(2000, None, "en", "c"), (2001, "", None, "c"), (2002, "  \n ", "xx", "c"), (2003, _prose(r, 4000), "en", "c"), (2004, docs[150][1], "de", "c"), (2005, _prose(r, 30) + "\n" + _stuffed(r, "words", 25), "en", "c"), (None, "x", "en", "c")]
    docs += docs[:5]
    want.add(2004)
    df = spark.createDataFrame(docs, "doc_id BIGINT, text STRING, lang STRING, chars STRING")
    out = stuffing.stuffed_pages(df)
    assert {x.doc_id for x in out.where("stuffed").collect()} == want
    assert out.count() == out.select("doc_id").distinct().count() == 150 + 18 + 3
    assert stuffing.stuffed_pages(df.limit(0)).count() == 0


def test_blocks_cover_whole_texts():
    for n in (1, 599, 600, 901, 35_000):
        assert sum(c for _, c, _, _ in stuffing.block_figures("ab c" * n)) == 4 * n
    assert stuffing.language_of("यह एक वाक्य है", "en") == "hi" and stuffing.language_of("plain", "hi") == "und" and stuffing.language_of("plain", None) == "und" and stuffing.language_of("plain", " DE ") == "de"


@pytest.mark.skipif(not os.path.exists(tokens.DEFAULT_PATH), reason="no public tokenizer here")
def test_token_counts(spark):
    texts = ["hello world", "", None, "<|endoftext|>", "नमस्ते", "\ud800x".encode("utf-8", "replace").decode(), "hello world"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, text STRING")
    got = [x[0] for x in df.orderBy("i").select(tokens.token_count(F.col("text"))).collect()]
    assert got[0] == got[6] == 2 and got[1] == got[2] == 0 and got[3] > 1 and got[4] > 1
    assert df.limit(0).select(tokens.token_count(F.col("text"))).count() == 0


@pytest.mark.skipif(not os.path.exists(tokens.DEFAULT_PATH), reason="no public tokenizer here")
def test_long_texts_count_the_same_in_pieces():
    count = tokens.counter(tokens.DEFAULT_PATH)
    text = "".join(f"line {i} of the log\n\n  indented {i}\n" for i in range(12_000))
    assert "".join(tokens._pieces(text)) == text and len(list(tokens._pieces(text))) > 1
    in_pieces = count(text)
    limit, tokens._WHOLE = tokens._WHOLE, 10**9
    try:
        assert count(text) == in_pieces
    finally:
        tokens._WHOLE = limit
    assert count("a" * 400_000) > 0


@pytest.mark.skipif(not os.path.exists(tokens.DEFAULT_PATH), reason="no public tokenizer here")
@pytest.mark.parametrize("gap", ["\n\n", " \n", "\r\n\r\n", "\n\n  ", "\u3000\n\n", " "])
def test_pieces_split_as_the_whole(monkeypatch, gap):
    count = tokens.counter(tokens.DEFAULT_PATH)
    text = "".join(f"para {i} ends here!{gap}" for i in range(400))
    whole = count(text)
    monkeypatch.setattr(tokens, "_WHOLE", 50)
    assert "".join(tokens._pieces(text)) == text and len(list(tokens._pieces(text))) > 20
    assert count(text) == whole


def test_json_tokenizers_agree_roughly():
    path = "/opt/tokenizers/byte_bpe_50k.json"
    if not os.path.exists(path):
        pytest.skip("no public tokenizer here")
    text = "The masked frame is released after the audit."
    assert tokens.counter(path)(text) == tokens.counter(tokens.DEFAULT_PATH)(text)


def _notes(r, n):
    """Words without sentences and hardly any repeats: an index, not stuffing."""
    made = ["".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(r.randrange(2, 5))) for _ in range(n)]
    return "\n".join(" ".join(made[i : i + 4]) for i in range(0, n, 4))


def test_both_conditions_decide(spark):
    """An index has no sentences but is not redundant, a list of like sentences is redundant but has sentences: neither alone makes a page stuffed."""
    r = random.Random(3)
    docs = [(i, _prose(r, r.randrange(6, 40)), "en") for i in range(120)]
    index = {500 + i: _notes(r, 160) for i in range(4)}
    alike = {600 + i: "The frame is masked before the audit. " * 30 for i in range(4)}
    phrases = ("Our blur tool is the {} blur tool for blur tool buyers.", "Buy blur tool here, blur tool {}, because blur tool beats blur tool.", "Blur tool {}: blur tool and blur tool deal with blur tool.")
    stuffed = {700 + i: " ".join(r.choice(phrases).format(r.choice(("best", "cheap", "free", "online"))) for _ in range(20)) for i in range(4)}
    links = {800 + i: "\n".join(f"Cheap Card Sleeve - https://shop{r.randrange(99)}.example/x/{r.randrange(9999)}" for _ in range(30)) for i in range(4)}
    docs += [(i, t, "en") for d in (index, alike, stuffed, links) for i, t in d.items()]
    df = spark.createDataFrame(docs, "doc_id BIGINT, text STRING, lang STRING")
    found = lambda **kw: {x.doc_id for x in stuffing.stuffed_pages(df, **kw).where("stuffed").collect()}
    want = set(stuffed) | set(links)
    assert found() == want
    assert found(redundant_below=1e9) == want | set(index)
    assert found(silent_below=1e9) == want | set(alike)
    redundant = stuffing.judged_blocks(stuffing.blocks(df.where("doc_id < 500"))).selectExpr("avg(cast(redundancy < 0.8 as int))").first()[0]
    assert redundant < 0.1  # of blocks of genuine pages


def test_sentence_ends_and_languages():
    assert stuffing.sentence_ends("The frame is masked. Why blur tool? Blur tool sale is cheap blur tool. It was sent to the audit!") == 2
    assert stuffing.sentence_ends("画面を確認してから保存します。") == 1 and stuffing.sentence_ends("") == 0
    assert [stuffing.language_of("plain", x) for x in ("en-US", "pt_BR", "english", "e", "12")] == ["en", "pt", "und", "und", "und"]
    assert stuffing.compressed_size("") >= 0 and stuffing.compressed_size("blur tool " * 60) < stuffing.compressed_size(_notes(random.Random(1), 120)) / 3


def test_many_languages_and_hot_ones(spark):
    r = random.Random(5)
    docs = [(i, _prose(r, 8), "en" if i % 3 else f"{chr(97 + i % 26)}{chr(97 + i % 7)}") for i in range(200)]
    figures = stuffing.blocks(spark.createDataFrame(docs, "doc_id BIGINT, text STRING, lang STRING"))
    norms = stuffing.norms_of(figures)
    assert norms.count() == norms.select("language", "band").distinct().count()
    judged = stuffing.judged_blocks(figures)
    assert judged.count() == figures.count() and judged.where("redundancy IS NULL OR silence IS NULL").count() == 0
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
