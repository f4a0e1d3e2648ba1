"""Pages of stuffed keywords, lists of links or product tags.

Each text is cut into blocks of about ``BLOCK`` characters. A block's
compression ratio is the size of its compressed shape over its number of
characters. The shape (lower case, addresses and tags taken out, digits alike)
is compressed as its distinct words, deflated, and codes for the order in which
they come, so that a small vocabulary counts in whatever order it comes. A block's redundancy is
its ratio over what blocks of that language and length usually have: the
median over the whole collection, drawn towards a reference where there are
few. It is flagged if it is extremely redundant, below ``redundant_below`` of
the usual; of blocks of genuine pages that is one in twenty or so: logs, texts
of few patterns, menus. A flagged block is confirmed if its density of sentence
ends is far below the usual of its language. An end counts if the words before
it make a sentence: ``SENTENCE`` words at least, of which few come twice, so
that stuffing behind full stops is none. A page is stuffed if most of its
characters lie in confirmed blocks.

The first pass writes one small row per block to the shared folder; norms come
from it by aggregation and go to the tasks as a table of at most ten rows for
each two- or three-letter language code, so texts are read once.

Defined results: null, empty and blank texts are not stuffed; texts of any
length are judged whole; a missing or unlikely language counts as ``und`` or by
its script; a language written without sentence ends is judged by redundancy;
repeated rows of one id give one row; texts repeated under other ids are judged
alike.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

BLOCK = 600
BLOCKS = "doc_id BIGINT, block INT, language STRING, band INT, chars INT, ratio DOUBLE, ends DOUBLE"
SENTENCE = 4
#: So many blocks weigh as much as what is usual elsewhere.
_PRIOR_BLOCKS = 30
_ADDRESS = re.compile(r"(?:https?://|www\.)[^\s<>\"')\]]+|<[^<>]*>")
_DIGITS = re.compile(r"\d+")
_END = re.compile(r"(?<=[^\s.,;:|»>#*-])[.!?।。！？]+(?=[\"'»”’)\]]*(?:\s|$))")
#: Words; signs of scripts without spaces stand alone, vowel signs stay with their letters.
_UNSPACED = re.compile(r"[぀-ヿ一-鿿]")
_WORD = re.compile(r"[぀-ヿ一-鿿]|[\w\u0900-\u0903\u093a-\u094f]+")
_ASCII_WORD = re.compile(r"\w+", re.ASCII)
_CODE = re.compile(r"[a-z]{2,3}")
_SCRIPTS = (("hi", re.compile("[ऀ-ॿ]")), ("ru", re.compile("[Ѐ-ӿ]")), ("el", re.compile("[Ͱ-Ͽ]")), ("ar", re.compile("[؀-ۿ]")), ("zh", re.compile("[぀-ヿ一-鿿]")))


def language_of(text: str, lang: str | None) -> str:
    """The stated language if the script agrees with it."""
    for code, letters in _SCRIPTS:
        if len(letters.findall(text)) > 0.15 * len(text):
            return code
    lang = re.split("[-_]", (lang or "").strip().lower())[0]
    return lang if _CODE.fullmatch(lang) and all(lang != code for code, _ in _SCRIPTS) else "und"


def _words(text: str) -> list[str]:
    return (_ASCII_WORD if text.isascii() else _WORD).findall(text)


def compressed_size(shape: str) -> float:
    """Bytes of a shape under dictionary coding: its distinct words, deflated, and a code of fixed width for each word of the text."""
    words = _words(shape)
    distinct = dict.fromkeys(words)
    return len(zlib.compress(" ".join(distinct).encode("utf-8", "replace"), 6, -15)) + len(words) * math.log2(max(2, len(distinct))) / 8


def sentence_ends(block: str) -> int:
    """Ends of proper sentences: at least ``SENTENCE`` words, three quarters of them different."""
    n = at = 0
    block = block.lower()
    spaced = block.isascii() or not _UNSPACED.search(block)
    for m in _END.finditer(block):
        words = block[at : m.start()].split() if spaced else _words(block[at : m.start()])
        at = m.end()
        n += len(words) >= SENTENCE and 4 * len(set(words)) >= 3 * len(words)
    return n


def block_figures(text: str) -> Iterator[tuple[int, int, float, float]]:
    """(block, characters, compressed size per character, sentence ends per 100 characters)."""
    n = max(1, round(len(text) / BLOCK))
    step = -(-len(text) // n)
    for k, at in enumerate(range(0, len(text), step)):
        block = text[at : at + step]
        shape = _DIGITS.sub("0", _ADDRESS.sub("", block.lower()))
        yield k, len(block), compressed_size(shape) / len(block), 100 * sentence_ends(block) / len(block)


def blocks(documents: DataFrame) -> DataFrame:
    """``BLOCKS`` of ``documents(doc_id, text, lang)``."""
    schema = pa.schema([("doc_id", pa.int64()), ("block", pa.int32()), ("language", pa.string()), ("band", pa.int32()), ("chars", pa.int32()), ("ratio", pa.float64()), ("ends", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text, lang in zip(*(c.to_pylist() for c in batch.columns)):
                if text and (text := text.strip()):
                    language = language_of(text, lang)
                    rows.extend((i, k, language, min(chars // 100, 9), chars, ratio, ends) for k, chars, ratio, ends in block_figures(text))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.col("lang").cast("string")).where("doc_id IS NOT NULL").mapInArrow(run, BLOCKS)


def _reference(band: Column) -> Column:
    """Usual ratio of prose by length: short blocks compress less."""
    return 0.49 + 0.33 / (band + 0.5)


def norms_of(figures: DataFrame) -> DataFrame:
    """(language, band, usual_ratio, usual_ends): at most ten rows for each of the 18,252 codes of two or three letters, and for ``und``."""
    drawn = lambda value, n, prior: (value * n + prior * _PRIOR_BLOCKS) / (n + _PRIOR_BLOCKS)
    n, band = F.col("n"), F.col("band")
    median = lambda c: F.percentile_approx(c, F.lit(0.5), F.lit(1000))
    level = figures.groupBy("language").agg(median(F.col("ratio") / _reference(band)).alias("level"), median(F.col("ends")).alias("ends"), F.count("*").alias("n"))
    level = level.select("language", drawn(F.col("level"), n, F.lit(1.0)).alias("level"), drawn(F.col("ends"), n, F.lit(1.1)).alias("usual_ends"))
    ratios = figures.groupBy("language", "band").agg(median(F.col("ratio")).alias("ratio"), F.count("*").alias("n"))
    return ratios.join(F.broadcast(level), "language").select("language", "band", drawn(F.col("ratio"), n, F.col("level") * _reference(band)).alias("usual_ratio"), "usual_ends")


def judged_blocks(figures: DataFrame) -> DataFrame:
    """Blocks with ``redundancy`` (their ratio over the usual) and ``silence`` (sentence ends over the usual)."""
    j = figures.join(F.broadcast(norms_of(figures)), ["language", "band"])  # bounded, so that no task gets all blocks of a language
    return j.withColumn("redundancy", F.col("ratio") / F.col("usual_ratio")).withColumn("silence", F.col("ends") / F.col("usual_ends"))


def stuffed_pages(documents: DataFrame, redundant_below: float = 0.8, silent_below: float = 0.6, most: float = 0.5) -> DataFrame:
    """(doc_id, chars, stuffed_share, stuffed) of every document with text."""
    figures = materialise(blocks(documents), "stuffing-blocks")
    bad = (F.col("redundancy") < redundant_below) & (F.col("silence") < silent_below)
    j = judged_blocks(figures).groupBy("doc_id", "block").agg(F.max("chars").alias("chars"), F.max(bad).alias("bad"))
    pages = j.groupBy("doc_id").agg(F.sum("chars").alias("chars"), (F.sum(F.when(F.col("bad"), F.col("chars")).otherwise(0)) / F.sum("chars")).alias("stuffed_share"))
    return pages.withColumn("stuffed", F.col("stuffed_share") > most)
