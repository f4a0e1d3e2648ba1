"""Personal information inside free text, found by a skip-chain CRF and replaced by typed placeholders.

Text is folded for reading only (full-width digits, invisible characters and
look-alike letters), split into tokens, labelled by :class:`SkipChainCRF`, and
runs of one label become mentions; an exact check (check digits, formats)
may reject a mention, never add one. Words that come again, in any case, with
a possessive or as part of a double name, and numbers and addresses of the same
value are linked, however far apart, so that a clear mention labels an unclear
one. :func:`redact_text` splices placeholders such as ``[EMAIL]`` into the
original text and leaves every other character as it is.

The model is trained at first use, in seconds and deterministically, on
sentences composed from the patterns below with the names of ``known_people``
and invented ones (``TRAINING_TEXTS`` sentences: the documented bound). A third
of them are general: mentions among words drawn at random, so that the model
does not depend on the wording around them. It then goes to the executors with
the task; every text is labelled in whole.

Defined results: null, empty and blank texts hold nothing and stay as they
are; texts of any length are labelled as one sequence; a text repeated within a
batch is labelled once; other columns pass through.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.checks import verhoeff_ok
from .crf import SkipChainCRF
from .normalize import aligned_fold

LABELS = ("O", "EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME")
TRAINING_TEXTS = 14_000
MENTIONS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))

# Every branch is linear in the text: runs are taken whole (possessively) or bounded by what a mail address allows.
_LABEL = r"[^\W_](?:[\w-]{0,61}[^\W_])?"
_TOKEN = re.compile(
    rf"(?P<email>(?<![^\W_])[^\W_][\w.%+-]{{0,63}}+(?:@|\s?[\[(]\s?at\s?[\])]\s?){_LABEL}(?:(?:\.|\s?[\[(]\s?dot\s?[\])]\s?){_LABEL})+)"
    r"|(?P<handle>@\w++)"
    r"|(?P<amount>\d{1,3}(?:,\d{2,3})++(?:\.\d+)?(?!\d))"
    r"|(?P<code>[A-Za-z]{1,8}\d{0,4}(?:-[A-Z]{0,8}\d++)++(?![\w-]))"
    r"|(?P<mixed>(?>[^\W\d_]+)\d\w*+|\d++[^\W\d_]\w*+)"
    r"|(?P<number>\+?\(?\d++\)?(?:(?:[ .-]{1,2}\(?|\(|(?<=\)))\d++\)?(?![^\W\d_]))*+)"
    r"|(?P<initial>[^\W\d_]\.)"
    r"|(?P<abbreviation>[A-Z][^\W\d_]{1,3}\.(?=\s?[,\w]))"
    r"|(?P<word>(?:[^\W\d_][\u0300-\u036f]*+)++(?:['’-](?:[^\W\d_][\u0300-\u036f]*+)++)*+)"
    r"|(?P<other>\S)"
)
_TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "shri", "smt", "sri", "herr", "frau", "señor", "señora", "sr", "sra", "don", "doña"}
_DIGIT = re.compile(r"\d")


_RUN = re.compile(r"([9Aa])\1*")


@lru_cache(maxsize=100_000)
def _mixed_key(token: str) -> str:
    """The shape of the whole token as runs: ``AB123`` is ``$A2.93.``."""
    return "$" + _RUN.sub(lambda m: f"{m[1]}{len(m[0])}.", "".join("9" if c.isdigit() else "A" if c.isupper() else "a" for c in token))


def _digits(text: str) -> str:
    """The decimal digits of a text, of whatever script, as ASCII."""
    return "".join(c if c.isascii() else str(unicodedata.decimal(c)) for c in text if c.isdecimal())


def _number_key(token: str) -> str:
    shape = _DIGIT.sub("9", token)
    digits = shape.count("9")
    if digits == 12 and verhoeff_ok(_digits(token)):
        return "#v" + shape
    return "#" + (shape if digits <= 14 else f"long{min(digits, 21)}")


_SPELLED = {"word", "initial", "abbreviation", "other"}  # these tokens are their own key


def tokens(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Keys and places of a folded text's tokens."""
    keys, at = [], []
    for m in _TOKEN.finditer(text):
        kind, t = m.lastgroup, m[0]
        if kind in _SPELLED:
            keys.append(t if t.isascii() else unicodedata.normalize("NFC", t))
        elif kind == "number":
            keys.append(_number_key(t))
        elif kind == "mixed":
            keys.append(_mixed_key(t))
        else:
            keys.append(f"<{kind}>")
        at.append(m.span())
    return keys, at


_COMMON = {"the", "this", "that", "and", "for", "you", "your", "our", "not", "was", "with", "from", "when", "der", "die", "das", "und", "los", "las", "una"}


def skip_links(keys: Sequence[str], values: Sequence[str] | None = None) -> list[tuple[int, int]]:
    """Each token that repeats an earlier one, or is like it, linked to its last occurrence.

    Words: the same in any case, with or without a possessive, or a part of a
    double name; at least one of the two is capitalised. With ``values`` (the
    tokens' own text) also numbers that end alike (seven digits, or all of
    fewer), codes and mail addresses of one value.
    """
    last: dict[str, int] = {}
    out = []
    for i, k in enumerate(keys):
        c = k[0]
        if c.isalpha():
            if len(k) < 3:
                continue
            stem = k.lower()
            if "'" in k or "’" in k:
                stem = stem.removesuffix("'s").removesuffix("’s")
            if stem in _COMMON:
                continue
            parts = [stem, *(p for p in stem.split("-") if len(p) > 3)] if "-" in stem else [stem]
            if c.isupper():
                before = [last[p] for p in parts if p in last]
                for p in parts:
                    last[p] = i
            elif len(k) > 3 and stem in last:
                before, last[stem] = [last[stem]], i
            else:
                continue
        elif values is None or c not in "#$<":
            continue
        else:
            v = values[i]
            ident = (_digits(v)[-7:] if c == "#" else v.upper())
            if len(ident) < 5:
                continue
            before, last[c + ident] = ([last[c + ident]] if c + ident in last else []), i
        if before:
            out.append((max(before), i))
    return out


class _Features:
    """Feature names of a token key."""

    def __init__(self, given: frozenset[str], family: frozenset[str]) -> None:
        self.given, self.family = given, family

    def __call__(self, key: str) -> list[str]:
        if key[0] == "#":
            digits = key.count("9")
            return ["number", f"n={key}", f"nd={digits}", *(["checked"] if key[1] == "v" else []), *(["plus"] if "+" in key else []), *(["paren"] if "(" in key else []), f"ng={'-'.join(str(len(g)) for g in re.findall('9+', key))}"]
        if key[0] == "$":
            return ["mixed", f"m={key}", f"ml={min(1 + sum(int(r[1:]) for r in key[1:].split('.') if r), 12)}"]
        if key[0] == "<":
            return [key]
        if not key[0].isalpha():
            return [f"p={key}"]
        low = key.lower()
        shape = "initial" if key.endswith(".") and len(key) == 2 else "upper" if key.isupper() and len(key) > 1 else "title" if key[0].isupper() else "lower"
        out = ["word", shape, f"w={low}"]
        if len(key) > 3:
            out += [f"s3={low[-3:]}", f"s3={low[-3:]}/{shape}", f"s2={low[-2:]}"]
        parts = low.split("-")
        if low in self.given:
            out += ["given", f"given/{shape}"]
        if any(p in self.family for p in parts):
            out += ["family", f"family/{shape}"]
        if low.rstrip(".") in _TITLES:
            out.append("title_word")
        if "-" in key:
            out.append("hyphen")
        return out


# ------------------------------------------------------------- training texts

_STREETS = "{w} Street|{w} Rd.|{w} Road|{w} Lane|{w} Avenue|{w} Ave.|{w} Drive|{w} Court|{w} St."
_ADDRESSES = (
    "{n3} {street}, {place}", "{n3} {w} Rd., {place}", "{n2} {w} Rd., {place}", "{n3} {street}, Apt {n2}, {place} {n5}", "{n3} {street}, {place} {n5}", "Flat {n2}{letter}, {n3} {w} Lane, {place} {n6}",
    "Plot {n3}, {w} Nagar, 2nd Cross, {place} - {n33}", "Plot {n2}, {w} Nagar, 4th Cross, {place} {n6}", "H.No. {n1}-{n2}-{n3}, Sector {n2}, {place}", "H.No. {n1}-{n1}-{n3}, Sector {n2}, {place}",
    "P.O. Box {n4}, {place} {n5}", "PO Box {n4}, {place} {n5}", "{w_}weg {n3}, {n5} {place}", "{w_}straße {n2}, {n5} {place}", "Postfach {n4}, {n5} {place}",
    "Calle {w} {n3}, 3º B, {n5} {place}", "Calle {w} {n2}, {n5} {place}", "Avenida {w} {n2}, 1º A, {n5} {place}", "Unit {n2}, {n3} {street}, {place}",
)
_PHONES = "+91 {i10}|{i10}|+91-{i5}-{n5}|+91 ({n2}) {n4} {n4}|0{n5} {n5}|({n3}) 555-{n4}|{n3}.555.{n4}|{n3}-555-{n4}|+1 {n3} 555 {n4}|+44 7700 {n6}|+44 {n4} {n6}|0491 570 {n3}|07700 {n6}|+49 {n3} {n7}|+34 {n3} {n3} {n3}".split("|")
_IDS = "{aadhaar}|{aadhaar4}|{aadhaar-}|{pan}|PAN {pan}|{ssn}|{ssn }|SSN {ssn}|SSN {ssn }|passport {passport}|{passport}|Passport no. {passport}|Aadhaar {aadhaar4}".split("|")
_NAMES = "{g} {f}|{g} {f}|{g} {f}|{g} {f}|{g} {i}. {f}|{i}. {f}|{f}, {g}|{t} {f}|{t} {g} {f}|{g} {f}-{f}|{G} {F}|{G} {F}|{g} {i}. {f}|{g}|{f}".split("|")
#: {name} {email} {phone} {id} {addr} are mentions, all else is none.
_SENTENCES = """{name}
{full}
{full}
{full}
{full}
{email}
{phone}
{id}
{addr}
{addr}
Tel {phone}
Call {phone} for help
Phone: {phone}
Mobile {phone}
OTP sent to {phone}
{id} (verified)
{id} (verified)
ID on file: {id}
ID on file: {id}
Enter national id: {id}
verify using {id} and click Confirm
{id} is wrong, use {id}
{full} · {id}
{full} · {id}
{full} · {id}
{full} · {id}
{full} · {phone}
{addr}
Deliver to {addr}
E-mail opt-in
E-mail address
Re-enter code
Sign-off sheet
Co-payer view
Two-step check-in
{full}, {addr}
{full}, {addr}
{full}, {addr}
Deliver to {addr}
Billing: {addr}
Ship it to {addr}
set delivery address as {addr}.
the account belongs to {full} of {addr}
the account belongs to {full} of {addr}
{full} lives at {addr}
Contact: {email}, {phone}
Contact: {email}
Receipt sent to {email}
Update contact {full} <{email}> and save
Update contact {full} <{email}> and save
type email: {email}
Log in as {email} then open the claims tab
reply to {email} / {phone} that the mask is fine
cc {email} and {email} on the receipt
Please send the code to {phone}, not to the old number
replace {phone} by {phone}
Fill mobile with {phone}
Book a visit for {full}, call back on {phone}
Book a visit for {full}, call back on {phone}
Signed in as {full}
Signed in as {full}
Welcome back, {full}
Welcome back, {full}
Welcome back, {g1}
Reviewed by {full} on {n2} May
Reviewed by {full} on {n2} May
Payee: {full}
Payee: {full}
Tell {full} the transfer went through
Tell {full} the transfer went through
Fill full_name with {full}
Fill full_name with {full}
enter applicant as {full} and press continue
enter applicant as {full} and press continue
Fill the kyc form: name {full}; id {id}; address {addr}
Fill the kyc form: name {full}; id {id}; address {addr}
Ask {full} about it. {g1} knows; {g1} signed the form.
{full} called on {n2} May. {f1} asked for a copy
Order no. {n12}
Order no. {n444}
Order no. {v12}
Order no. {v444}
Order {n15}
Order {n16}
Order {n18}
Order {n20}
Track shipment {n15}
Track shipment {n16}
Track shipment {n18}
Track shipment {n20}
select order no. {n12}
select order no. {n444}
select order no. {v12}
select order no. {v444}
Check order {n16} and print it
Check order {n18} and print it
Invoice {v12} was paid
Ticket {v12}
Reference {v444}
Booking {n12}
REF-{n4}-{n3}
type reference as REF-{n4}-{n3}
Fill coupon with SAVE-{n3}
Model XT-{n4}-{n3}
Balance {n2},{n3}.00
Balance {n1},{n3}.{n2}
set the limit to {n2},{n3} and confirm
v{n2}.{n2}.{n3} build {n4}
switch the panel to build {n1}.{n2}.{n3}
Frame {n4}
Lot {n4}/{n3}
{n3} boxes masked
{n3} to {n4} hours
Showing {n2} of {n3}
Policy section {n2}
compare frame {n4} with frame {n3}
go to step {n2} of {n3}
Step {n2} of {n2}
Page {n2}
Level {n2} review
Form {n2} copy
Enter quantity: {n2}
Will call pickup: choose slot {n2}
wait until masked boxes reach {n2} then synced
Last {verb} {n2} min ago
Tier {n1} access
Batch {n3} export
@{handle}
@{handle}
Follow @{handle} updates on the status board
Mention @{handle} in the note
Street view
Address book
Will call pickup
Grant access
Grant access to {thing} for {n2} days
Mark complete
Rose gold theme
Name (A to Z)
Sort {thing} by date, newest first
Scroll down to the {thing}
Scroll down
Open {thing}
Open {thing} and {verb} it
Close {thing}
{Act} {thing}
{Act} {thing}
{Act} {thing}
{Act} {thing} ({n1})
{Act} {thing} now
{Act} {thing} again
{Act} {thing} >
{act} {thing}
{ACT} {THING}
{ACT} {THING}
{Thing}
{Typo} {thing}
{Act} {typo} {thing}
{Ui}
{Ui}
{Ui}
{UI}
{UI}
{UI}
{UI}
{ui}
{Ui} ({n1})
{Ui} now""".split("\n")  # fmt: skip
#: Mentions among words of any kind: {x} is a run of words drawn at random, {X} one that begins a sentence.
_GENERAL = """{x} {email} {x}
{X} {email}
{email} {x}
{X} {email}, {x}
{X} ({email}) {x}
{X}: {email}.
{X} {phone} {x}
{X} ({phone}) {x}
{X} {phone}.
{phone} {x}
{X} {phone}, {x}
{X} {id} {x}
{X} {id}.
{X} {id}, {x}
{X} ({id})
{x} {addr}
{X} {addr}.
{X} {addr} {x}
{X} {addr}, {x}
{X} {full} {x}
{X} {full} {x}
{X} {full}.
{X} {full}, {x}
{x} {full} {x}
{full} {x}
{full} {x}
{full}, {x}
{X} {full} {x} {phone}
{X} {full} ({email}) {x}
{X} {full} {x} {email}, {x}
{X} {full} {x} {id}.
{X} {full} {x} {addr}.
{full}, {addr}
{full}, {addr}
{full}, {addr}
{name}, {addr}
{full}
{full}
{full}
{X} {full} {x}
{X} {full} {x}
{x} {full} {x}, {x}
{X} {full}, {x}
{X} {full} {x}. {X}
{X} {addr0} {x}
{X} {addr0}, {x}
{X} {addr0}.
{full} and {name} {x}
{X} {full} and {full} {x}
{X}. {full} {x}. {X}
{full} {said} {x}
{f1} {said} {x} {full} {x}
{X} {full} {x}. {f1} {said} {x}
{X} {full} {x} and {f1} {said} {x}
{X} {full} {x}. {X} {g1} {x}
{X} {full} {x} {f1}'s {x}
{g1} {said} {x}; {X} {full} {x}
{X} {full} {x}, {x} {f1}
Dear {full}, {x}
Hi {g1}, {x} {full}
Kind regards, {full}
My name is {full} {x}
I am {full} {x}
{X} my neighbour {full} {x} {phone}.
{X} by {full} {x}
{X} from {full} {x}
Mein Name ist {full} {x}
Frau {full} {x}
Herr {f} {x}
{X} mit {full} {x}
Me llamo {full} {x}
{X} con {full} {x}
{X} señora {full} {x}
{X} {phone1} {x}. {X} {phone1} {x}
{X} {email1}, {x}. {X} {email1}
{X} {id1} {x}; {x} {id1}
{X} {n3} {x}
{X} {n5}, {x}
{X} order {n12} {x}
{X} order no. {n16} {x}
{X} reference {v12}.
{X} reference REF-{n4}-{n3} {x}
{X} version {n1}.{n2}.{n3} {x}
{X} build {n4} {x}
{X} {n2},{n3} {x}
{X} @{handle} {x}
{X} in {place} {x}
{X} near {place} {x}
{X} to {place}, {x}
{X} at {place} {org} {x}
The {place} {org} {x}
{X} the {place} {org} {x}
{X} on {day} {x}
{X} in {month} {x}
{X} since {month} {n4}
{X} {day} and {day} {x}
{X} "{Thing}" {x}
{X} the {Thing} {x}
{X} the {Act} button {x}
{X} {Act} {Thing} {x}
Der {Noun} {x} die {Noun} {x}
Die {Noun} {x} {Noun} {x}
{X} das {Noun} {x}
{X}. {X}. {X}
{X}, {x}? {X}
{X} {x} {x}
{CAPS}
{CAPS}
{UI}
{UI}
{CAPS}, {x}""".split("\n")
_WORDS = "a about after again all also always an and any are as asked at back be because been before but by call came can copy could day did do down each email even every few find first for form from gave get go had has have he help her here him his how i if in into is it its just keep know last later left letter like line long look made make man many may me meet met more most much must my near need new next no not note now number of off old on once one only open or other our out over page paid part people place please reach read reply river said same saw see send sent she should show sign since so some still such take talk than that the their them then there these they thing this those through time to today told too two under until up use used very wait want was way we week well went were what when where which while who why will with work would write year yes yesterday you your".split()
_WORDS_OTHER = "der die das und ist ich wir ein eine zu mit von auf für nicht bitte heute wohne el la los las que y es un una por para con su mi favor hoy vivo gracias ke hai aur".split()
_SAID = "said asked called wrote knows agreed answered signed replied paid left thinks wants has was is will may".split()
_DAYS, _MONTHS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split(), "January February March April May June July August September October November December".split()
_ORGS = "Bank,Hotel,University,Museum,Insurance,Hospital,School,Station,Airport,Group,Ltd,Inc.,GmbH,Council,Times,Park,Bridge,Library,Court".split(",")
_NOUNS = "Rechnung Brief Antrag Vorgang Seite Nummer Straße Woche Frage Antwort Konto Karte Termin Bericht Haus Tag Name Adresse Kunde Stadt".split()
_ACTS = "open close save submit review confirm cancel update print share download archive approve remove verify resume export retry expand continue refresh edit view send show hide copy reset search select click check".split()
_THINGS = "address book,account access,claim form,transfer limit,profile card,final report,capture frame,payment,statement,office file,face proxy,mask settings,consent record,overlay switch,device list,limit panel,verification form,billing cycle,session banner,mask preview,field legend,audit trail,receipt list,privacy summary,frame viewer,transfer queue,plan chooser,notice board,upload box,download tray,claims table,status board,main menu,help page,street map,order history,contact sheet,name field".split(",")
_VERBS = "reviewed checked masked updated loaded synced saved closed printed".split()
_ONSETS = "b br c ch d dr f g gr h j k kr l m n p pr r s sh st t th tr v w y z".split()
_VOWELS = "a e i o u ai ea ia io".split()
_CODAS = "n r l s th m k d nd st rt".split() + [""] * 6


def _check_digit(eleven: str) -> str:
    return next(eleven + c for c in "0123456789" if verhoeff_ok(eleven + c))


class _Composer:
    def __init__(self, people: Sequence[tuple[str, str]], ui: Sequence[str], seed: int) -> None:
        self.r, self.people, self.ui = random.Random(seed), people or [("Mara", "Oldwin")], ui or ["Open menu"]
        self.ends = sorted({f[-4:].lower() for _, f in self.people if len(f) > 5})
        self.starts = sorted({f[:4].lower() for _, f in self.people if len(f) > 5})
        self.loose = False
        self.plain = [w for t in (*_THINGS, *_VERBS, *_ACTS) for w in t.split()]

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def syllables(self, n: int) -> str:
        r = self.r
        return "".join(r.choice(_ONSETS) + r.choice(_VOWELS) + r.choice(_CODAS) for _ in range(n))

    def invented(self) -> str:
        """A surname-like or place-like word."""
        r = self.r
        return ((r.choice(self.starts) if r.random() < 0.6 else self.syllables(1)) + (r.choice(self.ends) if r.random() < 0.7 else self.syllables(1))).title()

    def place(self) -> str:
        """Streets and towns are often called as people are."""
        return self.r.choice(self.people)[1] if self.r.random() < 0.4 else self.invented()

    def given(self) -> str:
        return self.r.choice(self.people)[0] if self.r.random() < (0.3 if self.loose else 0.6) else self.syllables(self.r.choice((1, 2, 2, 3))).title()

    def family(self) -> str:
        if self.r.random() < (0.2 if self.loose else 0.5):
            return self.r.choice(self.people)[1]
        return self.syllables(self.r.choice((1, 2, 2, 3))).title() if self.loose and self.r.random() < 0.8 else self.invented()

    def number(self, code: str) -> str:
        r = self.r
        if code == "n33":
            return f"{self.digits(3)} {self.digits(3)}"
        if code == "n444":
            return f"{self.digits(4)} {self.digits(4)} {self.digits(4)}"
        if code[0] == "v":
            d = _check_digit(r.choice("23456789") + self.digits(10))
            return d if code == "v12" else f"{d[:4]} {d[4:8]} {d[8:]}"
        if code[0] == "i":
            return r.choice("6789") + self.digits(int(code[1:]) - 1)
        n = int(code[1:])
        return str(r.randint(1, 10**n - 1)) if n <= 3 and r.random() < 0.5 else self.digits(n)

    def id_part(self, code: str) -> str:
        r, up = self.r, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        letters = lambda n: "".join(r.choice(up) for _ in range(n))
        if code.startswith("aadhaar"):
            d, sep = _check_digit(r.choice("23456789") + self.digits(10)), {"aadhaar": "", "aadhaar4": " ", "aadhaar-": "-"}[code]
            return sep.join((d[:4], d[4:8], d[8:]))
        if code == "pan":
            return letters(5) + self.digits(4) + letters(1)
        if code == "passport":
            return letters(1) + self.digits(7)
        return (" " if code.endswith(" ") else "-").join((r.choice("123456789") + self.digits(2), self.digits(2), self.digits(4)))

    def email(self) -> str:
        r, g, f = self.r, self.given().lower(), self.family().lower()
        local = r.choice((f"{g}.{f}", f"{g[0]}{f}", f"{g}{self.digits(2)}", f"{g}+{r.choice(_VERBS)}", f"{f}_{g}{self.digits(2)}", f"{g}-{f}"))
        host = f"{r.choice(('', 'mx.', 'in.', 'post.'))}{self.invented().lower()}{r.choice(('', '-mail'))}{r.choice(('.example', '.test', '.invalid', '.co.example', '.com', '.org'))}"
        x = r.random()
        if x < 0.1:
            return f"{local} [at] {host.replace('.', ' [dot] ')}"
        return f"{local}(at){host}" if x < 0.2 else f"{local}@{host}".upper() if x < 0.3 else f"{local}@{host}"

    def words(self, start: bool = False) -> str:
        """One to six words: common ones, those of the interface and made-up ones."""
        r = self.r
        pick = lambda: r.choice(_WORDS) if r.random() < 0.55 else r.choice(_WORDS_OTHER) if r.random() < 0.2 else r.choice(self.plain) if r.random() < 0.4 else self.syllables(r.choice((2, 2, 3)))
        text = " ".join(pick() for _ in range(r.choice((1, 1, 2, 2, 3, 4, 6))))
        return text[:1].upper() + text[1:] if start else text

    def fill(self, pattern: str) -> str:
        return re.sub(r"\{([^}]+)\}", lambda m: self.slot(m[1]), pattern)

    def slot(self, s: str) -> str:
        r = self.r
        if re.fullmatch(r"[nvi]\d+", s):
            return self.number(s)
        if s.rstrip(" -4") in ("aadhaar", "pan", "ssn", "passport"):
            return self.id_part(s)
        if s == "street":
            return self.fill(r.choice(_STREETS.split("|")))
        word = {"w": self.place, "w_": self.place, "place": self.place, "letter": lambda: r.choice("ABCD"), "g": self.given, "f": self.family, "i": lambda: r.choice("ABCDEGHIJKLMNPRSTUVXYZ"), "t": lambda: r.choice(("Mr", "Mrs", "Ms", "Dr.", "Mrs.", "Mr.", "Shri", "Smt.", "Prof.")), "handle": lambda: self.invented().lower(), "verb": lambda: r.choice(_VERBS), "act": lambda: r.choice(_ACTS), "thing": lambda: r.choice(_THINGS), "ui": lambda: r.choice(self.ui), "typo": self.typo}
        if s in ("x", "X"):
            return self.words(s == "X")
        if s == "CAPS":
            return self.words().upper()
        listed = {"said": _SAID, "day": _DAYS, "month": _MONTHS, "org": _ORGS, "Noun": _NOUNS}
        if s in listed:
            return r.choice(listed[s])
        if s.lower() in word:
            text = word[s.lower()]()
            return text.lower() if s == "ui" else text if s in word or s == "Ui" else text.upper() if s.isupper() and len(s) > 1 or s in "GF" else text[:1].upper() + text[1:]
        raise KeyError(s)

    def typo(self) -> str:
        w = self.r.choice([x for t in (*_THINGS, *_ACTS) for x in t.split() if len(x) > 4])
        at = self.r.randrange(1, len(w))
        return w[:at] + self.r.choice("abcdefghijklmnopqrstuvwxyz") + w[at + 1 :]

    def mention(self, s: str) -> tuple[str, str] | None:
        r = self.r
        if s in ("name", "full"):
            pattern = r.choice(_NAMES if s == "name" else _NAMES[:-2])
            return "NAME", self.fill(pattern)
        make = {"email": ("EMAIL", self.email), "phone": ("PHONE", lambda: self.fill(r.choice(_PHONES))), "id": ("ID_NUMBER", lambda: self.fill(r.choice(_IDS))), "addr": ("ADDRESS", lambda: self.fill(r.choice(_ADDRESSES))), "addr0": ("ADDRESS", lambda: self.fill(r.choice(("{n3} {street}, {place}", "{n2} {street}, {place}", "{n2} {street}"))))}
        return (make[s][0], make[s][1]()) if s in make else None

    def sentence(self, general: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
        self.loose = general  # people of any name
        pattern = self.r.choice(_GENERAL if general else _SENTENCES)
        text, spans, people, again = "", [], {}, {}
        for lit, s in re.findall(r"([^{]*)(?:\{([^}]+)\})?", pattern):
            text += lit
            if not s:
                continue
            if s in ("g1", "f1"):
                first = people.setdefault("p", (self.given(), self.family()))
                found = "NAME", first[s == "f1"]
            elif s == "full" and ("{g1}" in pattern or "{f1}" in pattern):
                people.setdefault("p", (self.given(), self.family()))
                found = "NAME", " ".join(people["p"])
            elif s in ("phone1", "email1", "id1"):
                found = again[s] = again.get(s) or self.mention(s[:-1])
            else:
                found = self.mention(s)
            part = found[1] if found else self.slot(s)
            if found:
                spans.append((found[0], len(text), len(text) + len(part)))
            text += part
        return text, spans

    def labelled(self, general: bool) -> tuple[list[str], list[int], list[tuple[int, int]]]:
        """Keys, label numbers and links of a composed text."""
        return self.read(*self.sentence(general))

    def read(self, text: str, spans: Sequence[tuple[str, int, int]] = ()) -> tuple[list[str], list[int], list[tuple[int, int]]]:
        folded, _ = aligned_fold(text)
        keys, at = tokens(folded := folded if len(folded) == len(text) else text)
        labels = [next((LABELS.index(kind) for kind, a, b in spans if a < stop and start < b), 0) for start, stop in at]
        return keys, labels, skip_links(keys, [folded[a:b] for a, b in at])


_MODELS: dict[tuple, SkipChainCRF] = {}


def train(people: Sequence[tuple[str, str]], ui: Sequence[str] = (), texts: int = TRAINING_TEXTS, seed: int = 20) -> SkipChainCRF:
    """The model for the given people and interface texts; the same input gives the same model, kept per process."""
    people, ui = sorted({(g, f) for g, f in people if g and f}), sorted({u for u in ui if u})
    memo = (hash(tuple(people)), hash(tuple(ui)), texts, seed)
    if memo not in _MODELS:
        composer = _Composer(people, ui, seed)
        # only half of the people count as known while training, so that the model also learns from context
        half = people[::2]
        features = _Features(frozenset(g.lower() for g, _ in half), frozenset(f.lower() for _, f in half))
        # every interface text in each case, as far as a tenth of the texts allows
        shown = ui if 30 * len(ui) <= texts else random.Random(seed).sample(ui, texts // 30)
        plain = [composer.read(u) for x in shown for u in (x, x.upper(), x.lower())]
        keys, labels, links = zip(*plain, *(composer.labelled(i % 14 >= 9) for i in range(texts - len(plain))))
        model = SkipChainCRF(LABELS, features).fit(keys, labels, links)
        # what links are worth shows on texts that the chain has not seen
        fresh = _Composer(people, ui, seed + 1)
        linked = [x for x in (fresh.labelled(True) for _ in range(texts // 4)) if x[2]]
        if linked:
            model.fit_skip(*zip(*linked))
        model.features = _Features(frozenset(g.lower() for g, _ in people), frozenset(f.lower() for _, f in people))
        _MODELS[memo] = model
    return _MODELS[memo]


# ------------------------------------------------------------------ mentions

_ID_FORMATS = re.compile(r"(?<!\w)(?:[A-Za-z]{5}\d{4}[A-Za-z]|\d{3}([ -])\d{2}\1\d{4}|[A-Za-z]\d{7})(?!\w)")
_AT = re.compile(r"[^\W_]\s?(?:@|[\[(]\s?at\s?[\])])\s?[^\W_]")
_TWELVE = re.compile(r"(?<!\d)(?:\d{12}|\d{4}([ -])\d{4}\1\d{4})(?!\d)")


def _holds(kind: str, text: str) -> bool:
    """The exact check of a mention's text."""
    if kind == "ID_NUMBER":
        return bool(_ID_FORMATS.search(text)) or any(verhoeff_ok(_digits(m[0])) for m in _TWELVE.finditer(text))
    if kind == "EMAIL":
        return bool(_AT.search(text))
    if kind == "PHONE":
        return 7 <= sum(map(str.isdigit, text)) <= 15
    if kind == "ADDRESS":
        return any(map(str.isdigit, text)) and any(map(str.isalpha, text))
    if kind == "NAME":
        return sum(map(str.isalpha, text)) > 1
    return True


def _without_loose_bracket(text: str, kind: str, start: int, stop: int) -> tuple[str, int, int]:
    """A bracket that the mention opens or closes alone belongs to the sentence."""
    inner = text[start:stop]
    if inner.endswith(")") and inner.count(")") > inner.count("("):
        stop -= 1
    if inner.startswith("(") and inner.count("(") > inner.count(")"):
        start += 1
    return kind, start, stop


def find_mentions(model: SkipChainCRF, texts: Sequence[str | None]) -> list[list[tuple[str, int, int]]]:
    """(kind, start, stop) of each text's mentions, in places of the text as recorded."""
    distinct = list(dict.fromkeys(t for t in texts if t))
    read = []
    for t in distinct:
        folded, places = aligned_fold(t)
        keys, at = tokens(folded)
        read.append((folded, places, keys, at))
    best = model.label([x[2] for x in read], [skip_links(keys, [folded[a:b] for a, b in at]) for folded, _, keys, at in read])
    found: dict[str, list[tuple[str, int, int]]] = {}
    for t, (folded, places, _, at), labels in zip(distinct, read, best):
        if not labels.any():
            continue
        out: list[list] = []
        previous = 0
        for k, (start, stop) in zip(labels.tolist(), at):
            if k and k == previous:
                out[-1][2] = stop
            elif k:
                out.append([LABELS[k], start, stop])
            previous = k
        kept = [(kind, a, b) for kind, a, b in (_without_loose_bracket(folded, *m) for m in out) if _holds(kind, folded[a:b])]
        found[t] = [(kind, places[a], places[b - 1] + 1) for kind, a, b in kept] if places else kept
    model.trim()
    return [found.get(t, []) if t else [] for t in texts]


def redact_text(text: str, mentions: Sequence[tuple[str, int, int]]) -> str:
    out, last = [], 0
    for kind, start, stop in mentions:
        out += [text[last:start], f"[{kind}]"]
        last = stop
    return "".join(out) + text[last:]


def mentions_column(text: Column, model: SkipChainCRF) -> Column:
    """The mentions of a text column as an array of (kind, start, stop)."""

    @F.pandas_udf(MENTIONS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([[{"kind": k, "start": a, "stop": b} for k, a, b in m] for m in find_mentions(model, [None if x is None or x != x else x for x in s])])

    return run(text)


def kinds_column(text: Column, model: SkipChainCRF) -> Column:
    """The distinct kinds of a text's mentions, for those who need no places; null if there are none."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([sorted({k for k, _, _ in m}) or None for m in find_mentions(model, [None if x is None or x != x else x for x in s])], dtype=object)

    return run(text)


def redacted_column(text: Column, model: SkipChainCRF) -> Column:
    """The text with typed placeholders."""

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts = [None if x is None or x != x else x for x in s]
            yield pd.Series([t if not m else redact_text(t, m) for t, m in zip(texts, find_mentions(model, texts))], dtype=object)

    return run(text)


def model_for(known_people: DataFrame, ui_strings: DataFrame) -> SkipChainCRF:
    """The model for two fixed tables of a few hundred rows (checked: at most 20,000)."""
    bound = 20_000
    people, ui = known_people.select("given_name", "family_name").limit(bound + 1).collect(), ui_strings.select("text").limit(bound + 1).collect()
    if max(len(people), len(ui)) > bound:
        raise ValueError(f"known people and interface texts are collected for training and must not exceed {bound} rows")
    return train([tuple(p) for p in people], [u[0] for u in ui])
