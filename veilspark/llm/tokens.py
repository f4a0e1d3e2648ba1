"""Sizes of texts in tokens of a public tokenizer.

The vocabulary is read where it lies (``path`` is a parameter, never a copy):
``*.tiktoken`` rank files and ``*.json`` tokenizer files. It is loaded once per
Python worker. Null and empty texts have 0 tokens; special-token strings
within a text are ordinary text; whole texts are counted.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the public tokenizers' files lie, unless the caller names another path.
DEFAULT_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The splitting pattern published with the byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WHOLE = 200_000
_CUT = re.compile(r"(?<=\S)[ \t\r\n]")


@lru_cache(maxsize=4)
def counter(path: str) -> Callable[[str], int]:
    """A function from text to its number of tokens."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

        def count(text: str) -> int:
            text = text.encode("utf-8", "replace").decode("utf-8")  # lone surrogates can't be encoded
            if len(text) <= _WHOLE:
                return len(encoding.encode_ordinary(text))
            # very long texts are counted in parts that split as the whole does
            return sum(len(encoding.encode_ordinary(part)) for part in _pieces(text))

        return count
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda text: len(tokenizer.encode(text.encode("utf-8", "replace").decode("utf-8"), add_special_tokens=False).ids)


def _pieces(text: str) -> Iterator[str]:
    """Parts of about ``_WHOLE`` characters, cut between a character that is no white space and the white space that follows it.

    The pattern never joins these two, and a run of white space stays whole in its part, so the parts split as the whole text does.
    """
    start = 0
    while start < len(text):
        cut = _CUT.search(text, start + _WHOLE)
        stop = cut.start() if cut else len(text)
        yield text[start:stop]
        start = stop


def token_count(text: Column, path: str = DEFAULT_PATH) -> Column:
    """Number of tokens of a text column; equal texts of a batch are counted once."""

    @F.pandas_udf(T.LongType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(path)
        for s in batches:
            sizes = {t: count(t) for t in s.dropna().unique()}
            yield s.map(sizes).fillna(0).astype("int64")

    return run(text)
