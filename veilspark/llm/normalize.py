"""One consistent form for text that looks the same but is made of other characters.

Each character has a quick-check property: *yes* (it stands in the canonical
form and combines with nothing), *maybe* (a mark that may combine with what
precedes it) or *no* (it has another form). The characters that are not *yes*
make up one character class, computed once per process; runs of them, each with
the one starter before it as boundary context, are the unstable segments. Only
these are normalised (and memoised), then spliced into the unchanged text,
which is never touched where it is *yes*, whatever its alphabet. ASCII text is
stable as a whole and never leaves the JVM.

Folded: invisible characters go; spaces of any kind become a space and hyphens
of the same look a hyphen; width, font and ligature forms become plain letters
(super- and subscripts, circled letters, the long s and other forms that look
different stay); accents are composed (NFC); letters of other alphabets that
are drawn alike become the letters of the word's own alphabet
(:func:`canonical`) or of one alphabet for comparison (:func:`skeleton`).
Case, visible accents, punctuation and the number of signs stay.

:func:`canonical` respells words of mixed alphabets only, and those that are
made of look-alikes altogether in a text of another alphabet. A word of ASCII
letters and one that is whole in the text's alphabet stay as they are, and no
word becomes mixed: what no one alphabet can spell stays as it was.

Defined results: null stays null; empty text stays empty; lone surrogates and
unassigned code points stay; texts of any length take one pass.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters drawn like Latin letters, by alphabet: each letter is followed by its Latin twin.
_DRAWN_ALIKE = {
    "CYRILLIC": "АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ЅS ІI ЈJ ԚQ ԜW ҮY Ӏl аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ҽe ѵv ӏl",
    "GREEK": "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ϳj ϲc αa ιi κk νv οo ρp υu",
    "ARMENIAN": "ՍU ՏS ՕO Լl հh ոn սu օo ցg զq յj",
    "CHEROKEE": "ᎠD ᎡR ᎢT ᎥI ᎪA ᎫJ ᎬE ᎳW ᎷM ᎻH ᎽY ᎾO ᏀG ᏃZ ᏏB ᏔW ᏙV ᏚS ᏞL ᏟC ᏢP ᏦK ᏒR ᏴB ᎦS",
    "LISU": "ꓐB ꓑP ꓓD ꓔT ꓖG ꓗK ꓙJ ꓚC ꓜZ ꓝF ꓟM ꓠN ꓡL ꓢS ꓣR ꓦV ꓧH ꓪW ꓫX ꓬY ꓮA ꓰE ꓲI ꓳO ꓴU",
    "COPTIC": "ⲞO ⲟo ⲢP ⲣp ⲤC ⲥc ⲦT ⲘM ⲚN ⲎH ⲔK ⲬX",
    "LATIN": "ɡg ɑa ɩi ᴏo ᴄc ᴠv ᴡw ᴢz ꜱs",
}
# Fixed here because their kind alone doesn't tell their look.
_LOOKS_OTHER = set("ſﬅ℡™℠")
_HYPHENS = set("‐‑﹣－­")
_BLANK = {chr(c) for r in ((0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0xFE00, 0xFE0F), (0xE0100, 0xE01EF)) for c in range(r[0], r[1] + 1)} | {"͏", "ㅤ", "ﾠ"}
_KEPT_TAGS = {"<super>", "<sub>", "<circle>", "<square>", "<fraction>", "<vertical>"}

_TO_LATIN = {pair[0]: pair[1] for pairs in _DRAWN_ALIKE.values() for pair in pairs.split()}
_LATIN_VARIANTS = {pair[0] for pair in _DRAWN_ALIKE["LATIN"].split()}
_FROM_LATIN = {script: {p[1]: p[0] for p in reversed(pairs.split())} for script, pairs in _DRAWN_ALIKE.items() if script in ("CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE", "LISU", "COPTIC")}


@lru_cache(maxsize=65536)
def plain_form(ch: str) -> str:
    """A character's decomposed plain form: canonical, width, font and ligature mappings only; ``""`` if it is invisible."""
    if ch < "\x7f":
        return ch
    category = unicodedata.category(ch)
    if ch in _BLANK or category == "Cf":
        return ""
    if category == "Zs":
        return " "
    if ch in _HYPHENS:
        return "-"
    d = unicodedata.decomposition(ch)
    if not d or ch in _LOOKS_OTHER:
        return ch
    tag, *codes = d.split() if d[0] == "<" else ("", *d.split())
    parts = [chr(int(c, 16)) for c in codes]
    if tag in _KEPT_TAGS or (tag and parts[0] == " "):
        return ch
    return "".join(map(plain_form, parts))


@lru_cache(maxsize=65536)
def _latin(ch: str) -> str:
    return "".join(_TO_LATIN.get(c, c) for c in plain_form(ch))


@lru_cache(maxsize=65536)
def quick_check(ch: str, latin: bool = True) -> str:
    """``yes``, ``maybe`` or ``no``, for :func:`skeleton` or (``latin=False``) for the plain form."""
    if ch < "\x7f":
        return "yes"
    joins = "\u1161" <= ch <= "\u1175" or "\u11a8" <= ch <= "\u11c2"  # vowels and finals of Hangul syllables
    if joins or unicodedata.combining(ch) or unicodedata.category(ch) in ("Mn", "Mc", "Me") or not unicodedata.is_normalized("NFC", "a" + ch):
        return "no" if not plain_form(ch) else "maybe"
    return "yes" if unicodedata.normalize("NFC", (_latin if latin else plain_form)(ch)) == ch else "no"


#: Code points outside of these are *yes*: they have no other form (a test goes through all of them).
_CHECKED = ((0x7F, 0x33FF), (0xA000, 0xABFF), (0xD7B0, 0xD7FF), (0xF900, 0x1FFFF), (0x2F800, 0x2FA1F), (0xE0000, 0xE01EF))


@lru_cache(maxsize=2)
def _segments(latin: bool) -> re.Pattern:
    """A starter, if there is one, and the run of characters after it that are not *yes*."""
    unstable = [c for a, b in _CHECKED for c in range(a, b + 1) if quick_check.__wrapped__(chr(c), latin) != "yes"]
    runs: list[list[int]] = []
    for c in unstable:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    members = "".join(f"\\U{a:08x}" if a == b else f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)
    return re.compile(f"[^{members}]?[{members}]+")


@lru_cache(maxsize=65536)
def _short_segment(segment: str, latin: bool) -> str:
    return _long_segment(segment, latin)


def _long_segment(segment: str, latin: bool) -> str:
    return unicodedata.normalize("NFC", "".join(map(_latin if latin else plain_form, segment)))


def _splice(text: str, latin: bool) -> str:
    return text if text.isascii() else _segments(latin).sub(lambda m: (_short_segment if m.end() - m.start() <= 64 else _long_segment)(m[0], latin), text)


def skeleton(text: str | None) -> str | None:
    """Equal for texts that look the same: twins of all alphabets become Latin letters."""
    return None if text is None else _splice(text, True)


@lru_cache(maxsize=65536)
def _script(ch: str) -> str:
    """The alphabet of a letter without a twin in another alphabet; ``""`` for all others."""
    if not ch.isalpha() or ch in _TO_LATIN:
        return ""
    base = unicodedata.normalize("NFD", ch)[0]
    if base in _TO_LATIN or any(base in m for m in _FROM_LATIN.values()):
        return ""
    return unicodedata.name(ch, "").split(" ")[0]


_WORD = re.compile(r"(?:[^\W\d_][\u0300-\u036f]*)+")


def _alphabet(word: str) -> str:
    found: dict[str, int] = {}
    for ch in word:
        if s := _script(ch):
            found[s] = found.get(s, 0) + 1
    return max(found, key=found.get) if found else ""


@lru_cache(maxsize=65536)
def _letters_of(ch: str) -> str:
    """The alphabet a character belongs to by its name; ``""`` for marks."""
    return unicodedata.name(unicodedata.normalize("NFD", ch)[0], "").split(" ")[0] if ch.isalpha() else ""


def _alphabets(word: str) -> set[str]:
    return {s for ch in word if (s := _letters_of(ch))}


def _respell(word: str, alphabet: str) -> str:
    twins = _FROM_LATIN.get(alphabet)
    latin = "".join(_TO_LATIN.get(c, c) for c in unicodedata.normalize("NFD", word))
    return unicodedata.normalize("NFC", "".join(twins.get(c, c) for c in latin) if twins else latin)


def _spelled(word: str, whole: str, latin_beside: bool) -> str:
    """A word in one alphabet: its own, the text's or Latin, the first that can spell all of it."""
    own, found = _alphabet(word), _alphabets(word)
    if len(found) < 2 and (own or whole in found or not whole and latin_beside) and not any(c in _LATIN_VARIANTS for c in word):
        return word
    for alphabet in (own, whole, "LATIN"):
        if alphabet and _alphabets(out := _respell(word, alphabet)) <= {alphabet}:
            return out
    return word


def canonical(text: str | None) -> str | None:
    """The consistent form: plain, composed, every word in its own alphabet (in doubt the text's, then Latin)."""
    if text is None or text.isascii():
        return text
    plain = _splice(text, False)
    if plain.isascii():
        return plain
    whole = _alphabet(plain)
    latin_beside = not whole and any(w.isascii() for w in _WORD.findall(plain))  # nothing tells which of the words are not what they seem
    return _WORD.sub(lambda m: m[0] if m[0].isascii() else _spelled(m[0], whole, latin_beside), plain)


def aligned_fold(text: str) -> tuple[str, list[int] | None]:
    """Plain Latin-twin text and, for each of its characters, the place it has in ``text``; ``None`` if nothing moved."""
    if text.isascii():
        return text, None
    out, at = [], []
    for i, ch in enumerate(text):
        for c in unicodedata.normalize("NFC", _latin(ch)):
            out.append(c)
            at.append(i)
    return "".join(out), at


@F.pandas_udf(T.StringType())
def _canonical_udf(text: pd.Series) -> pd.Series:
    return text.map(canonical)


@F.pandas_udf(T.StringType())
def _skeleton_udf(text: pd.Series) -> pd.Series:
    return text.map(skeleton)


def _unstable(text: Column) -> Column:
    return F.when(text.rlike(r"[^\x00-\x7e]"), text)


def canonical_text(text: Column) -> Column:
    """Consistent form of a column; only text that isn't ASCII goes to Python."""
    return F.coalesce(_canonical_udf(_unstable(text)), text)


def skeleton_text(text: Column) -> Column:
    """Comparison key of a column; only text that isn't ASCII goes to Python."""
    return F.coalesce(_skeleton_udf(_unstable(text)), text)


def lookalikes(texts: DataFrame, known: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``texts`` that look like a text of ``known(string_id, text)`` but are made of other characters."""
    k = known.where("text IS NOT NULL").select("string_id", F.col("text").alias("known_text"), skeleton_text(F.col("text")).alias("key"))
    t = texts.where(F.length(text) > 0).select(F.struct(*texts.columns).alias("row"), F.col(text).alias("own_text"), skeleton_text(F.col(text)).alias("key"))
    kept = [F.col("row")[c].alias(c) for c in texts.columns if c.lower() != "string_id"]
    return t.join(k, "key").where("own_text <> known_text").select(*kept, "string_id")
