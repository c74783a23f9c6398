"""Text expressions: white space, words, normalisers, scripts. JVM-side but for case folding and the normalisers that compose or fold."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Classes of characters, as Java regular expressions.
#: White space as Python's str.split has it. Java looks single characters below 256 up in a bit set and tries any
#: range in turn, so the low ones are listed and the others stand behind one range: a third of the time.
SPACE = r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x85\xa0[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]]"
#: The same characters.
SPACE_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
#: Letters and digits; with the underscore, the characters of a word.
ALNUM = r"[\p{L}\p{N}]"
WORD = r"[\p{L}\p{N}_]+"
#: Arabic-script block.
ARABIC = r"[\x{0600}-\x{06FF}]"


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


#: Characters that composition leaves as they are, in any company: ASCII, inverted marks and quotes, Latin letters with marks.
STABLE = r"\x00-\x7F\x{A1}\x{AB}\x{BB}\x{BF}-\x{131}\x{134}-\x{13E}\x{141}-\x{148}\x{14A}-\x{17E}"


#: Characters whose folded case is their lower case: ASCII, Latin letters with marks but for sharp s and a few more, Arabic script, CJK.
FOLDED_AS_LOWER = r"\x00-\x7F\x{A0}-\x{B4}\x{B6}-\x{DE}\x{E0}-\x{12F}\x{131}-\x{148}\x{14A}-\x{17E}\x{600}-\x{6FF}\x{2010}-\x{2027}\x{3000}-\x{9FFF}"


@F.pandas_udf(T.StringType())
def _casefold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else x.casefold())


def casefold(text: Column) -> Column:
    """Case folding, which Spark has no function for; texts whose lower case is the same don't leave the JVM."""
    return F.coalesce(_casefold(F.when(text.rlike(f"[^{FOLDED_AS_LOWER}]"), text)), F.lower(text))


def nfkc(text: Column) -> Column:
    """Compatibility composition; texts of stable characters only are passed by, so Python sees nulls for them."""
    return F.coalesce(_nfkc(F.when(text.rlike(f"[^{STABLE}]"), text)), text)


def squeeze(text: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def strip(text: Column) -> Column:
    """Without white space at the ends."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def blank(text: Column) -> Column:
    """Whether there is nothing but white space; a null is blank."""
    return ~F.coalesce(text.rlike(f"[^{SPACE[1:-1]}]"), F.lit(False))


def compact(text: Column) -> Column:
    """Without white space."""
    return F.regexp_replace(text, f"{SPACE}+", "")


def split_words(text: Column) -> Column:
    """Words between white space; none for a blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda w: w != "")


def word_tokens(text: Column) -> Column:
    """Runs of word characters."""
    return F.filter(F.split(text, f"[^{WORD[1:-2]}]+"), lambda w: w != "")


def count_matches(text: Column, pattern: str) -> Column:
    """Characters of text in a one-character class."""
    return F.length(text) - F.length(F.regexp_replace(text, f"{pattern}+", ""))


# Characters that are written as others, or not at all.
_VARIANTS = (("\u064a", "\u06cc"), ("\u0649", "\u06cc"), ("\u0643", "\u06a9"), ("\u0640", ""), ("\u200d", ""), ("\ufeff", ""), ("\u00ad", ""))
_ROUTER = (*_VARIANTS[:3], ("\u200c", " "), ("\xa0", " "), *_VARIANTS[4:])
_COMPARED = (("\u064a", "\u06cc"), ("\u0649", "\u06cc"), ("\u0643", "\u06a9"), ("\u200c", " "), ("\u0640", ""))
#: Runs that normalising changes; what it leaves as it is doesn't match. One of the last strings stands in each text that matches, and is found much faster.
_LINES = ((re.compile("\r\n?"), "\n", ("\r",)), (re.compile("[ \t\xa0]{2,}|[\t\xa0]"), " ", ("  ", "\t", "\xa0")), (re.compile(" \n ?|\n "), "\n", (" \n", "\n ")), (re.compile("\n{3,}"), "\n\n", ("\n\n\n",)))
_MARKS = re.compile("[\u064b-\u065f\u0670]")
#: What is no word character and no Arabic script.
ODD = re.compile(r"[^\w\u0600-\u06ff]+")


def _replaced(text: str, pairs: tuple[tuple[str, str], ...]) -> str:
    for old, new in pairs:
        if old in text:
            text = text.replace(old, new)
    return text


def _reduced(text: str) -> str:
    for pattern, to, signs in _LINES:
        if any(x in text for x in signs):
            text = pattern.sub(to, text)
    return text.strip()


def ocr_normalized(text: str) -> str:
    """What normalize_ocr gives, in Python."""
    if not text.isascii():
        text = _replaced(unicodedata.normalize("NFKC", text), _VARIANTS)
    return _reduced(text)


def router_normalized(text: str) -> str:
    """What normalize_router gives, in Python."""
    return _reduced(text if text.isascii() else _replaced(text, _ROUTER))


def _evaluated(text: str) -> str:
    text = ocr_normalized(text)
    return " ".join((text if text.isascii() else _MARKS.sub("", text).replace("\u200c", " ")).split())


def _agreed(text: str) -> str:
    return " ".join(ODD.sub(" ", router_normalized(text).casefold()).split())


def _compared(text: str) -> str:
    text = text.lower() if text.isascii() else _replaced(unicodedata.normalize("NFKC", text).casefold(), _COMPARED)
    return " ".join(text.split())


def _squeezed_fold(text: str) -> str:
    return " ".join(text.casefold().split())


def _part(text: str) -> str:
    return _squeezed_fold(unicodedata.normalize("NFKC", text))


def _in_python(f: Callable[[str], str]) -> Callable[[Column], Column]:
    """f over batches, a null as an empty text: a normaliser is one pass here and a regular expression a rule in the JVM."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([f(x) if x else "" for x in texts], dtype=object)

    return run


_ocr_texts, _evaluation_texts, _agreement_texts, _comparison_texts = map(_in_python, (ocr_normalized, _evaluated, _agreed, _compared))
#: Case folded, blanks reduced; and composed before that.
squeezed_fold, composed_fold = map(_in_python, (_squeezed_fold, _part))


@F.arrow_udf(T.ArrayType(T.StringType()))
def normalize_ocr_all(texts: pa.Array) -> pa.Array:
    """normalize_ocr of each text of an array; a null stays one."""
    return pa.array([row and [x and ocr_normalized(x) for x in row] for row in texts.to_pylist()], pa.list_(pa.string()))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value worked out once however often f names it."""
    return F.transform(F.array(value), f)[0]


def normalize_chars(text: Column, *, swap_ligature: bool = True, compose: bool = True) -> Column:
    """Arabic yeh and kaf to their Persian forms, zero-width non-joiner to a space; the swap of lam-alef is optional."""
    out = nfkc(text) if compose else text
    out = F.translate(out, "\u064a\u0643", "\u06cc\u06a9")
    out = F.replace(out, F.lit("\u0644\u0627"), F.lit("\u0627\u0644")) if swap_ligature else out
    return F.replace(out, F.lit("\u200c"), F.lit(" "))


def normalize_ocr(text: Column, *, compose: bool = True) -> Column:
    """Presentation variants folded, line ends unified, blanks and blank lines reduced."""
    if compose:
        return _ocr_texts(text)
    out = F.coalesce(text, F.lit(""))
    folded = F.translate(out, "\u064a\u0649\u0643\u0640\u200d\ufeff\u00ad", "\u06cc\u06cc\u06a9")  # the last four go
    out = F.when(out.rlike(r"[\x{064A}\x{0649}\x{0643}\x{0640}\x{200D}\x{FEFF}\x{AD}]"), folded).otherwise(out)
    out = F.regexp_replace(out, r"\r\n?", "\n")
    out = F.regexp_replace(out, r"[ \t\x{a0}]+", " ")
    out = F.regexp_replace(out, r" *\n *", "\n")
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def normalize_for_evaluation(text: Column, *, compose: bool = True) -> Column:
    """As normalize_ocr folds, without vowel marks and joiners, blanks to single spaces."""
    if compose:
        return _evaluation_texts(text)
    out = normalize_ocr(text, compose=False)
    out = F.regexp_replace(out, r"[\x{064B}-\x{065F}\x{0670}]", "")
    return squeeze(F.replace(out, F.lit("\u200c"), F.lit(" ")))


def normalize_router(text: Column) -> Column:
    """As normalize_ocr, but without composition, with the zero-width non-joiner as a space and the stroke of kashida kept."""
    out = F.translate(F.coalesce(text, F.lit("")), "\u064a\u0649\u0643\u200c\xa0\u200d\ufeff\u00ad", "\u06cc\u06cc\u06a9  ")  # the last three go
    out = F.regexp_replace(out, r"\r\n?", "\n")
    out = F.regexp_replace(out, r"[ \t]+", " ")
    out = F.regexp_replace(out, r" *\n *", "\n")
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def normalize_for_agreement(text: Column) -> Column:
    """normalize_router with case folded, everything that is no word character or Arabic script to a space."""
    return _agreement_texts(text)


def normalize_for_comparison(text: Column, *, compose: bool = True) -> Column:
    """What two layers of a page are compared by: composed, case folded, variants folded, all blanks to single spaces."""
    if compose:
        return _comparison_texts(text)
    out = casefold(F.coalesce(text, F.lit("")))
    out = F.translate(out, "\u064a\u0649\u0643\u200c\u0640", "\u06cc\u06cc\u06a9 ")  # the last one goes
    return squeeze(out)


def persian_ratio(text: Column) -> Column:
    """Share of Arabic-script characters in what isn't white space; 0 for none."""
    # a text without such a character is told by one search
    share = bound(compact(text), lambda held: count_matches(held, ARABIC) / F.length(held))
    return F.when(F.coalesce(text.rlike(ARABIC), F.lit(False)), share).otherwise(F.lit(0.0))


def language(text: Column) -> Column:
    return F.when(persian_ratio(text) > 0.5, "fa").otherwise("en")


def direction(text: Column) -> Column:
    """rtl where right-to-left letters are there and no fewer than Latin ones."""
    rtl = count_matches(text, r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]")
    return F.when((rtl > 0) & (rtl >= count_matches(text, "[A-Za-z]")), "rtl").otherwise("ltr")


def preview(text: Column, most: int) -> Column:
    """At most so many characters, with an ellipsis where it was cut."""
    flat = squeeze(text)
    return F.when(F.length(flat) > most, F.concat(F.rtrim(F.left(flat, F.lit(most))), F.lit("…"))).otherwise(flat)


def score_band(score: Column) -> Column:
    """strong from 60 per cent, good from 45, else weak."""
    percent = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)) * 100)
    return F.when(percent >= 60, "strong").when(percent >= 45, "good").otherwise("weak")


def human_bytes(n: Column) -> Column:
    kb, mb, gb = n / 1024, n / 1024**2, n / 1024**3
    # ties at the digit go to the even one, as printf has it; Java's format takes them up
    show = lambda v, unit: F.concat(F.when(v < 10, F.format_string("%.1f", F.bround(v, 1))).otherwise(F.round(v).cast("long").cast("string")), F.lit(f" {unit}"))
    return F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B"))).when(kb < 1024, show(kb, "KB")).when(mb < 1024, show(mb, "MB")).otherwise(show(gb, "GB"))


def location_text(location: Column) -> Column:
    """A place for readers: sheet and row of a cell, number of a page, else the place's type."""
    cell = F.concat(location["sheet"], F.lit(", row "), location["row"].cast("string"))
    page = F.concat(F.lit("page "), location["num"].cast("string"))
    kind = location["type"]
    return F.when(location.isNull(), "\u2014").when(kind == "cell", cell).when(kind == "page", page).otherwise(F.coalesce(kind, F.lit("location")))


def clock(seconds: Column) -> Column:
    """m:ss"""
    return F.format_string("%d:%02d", F.floor(seconds / 60), F.floor(seconds) % 60)


def required_languages(profiles: Column) -> Column:
    """Distinct languages of profiles like a+b, in order."""
    return F.array_distinct(F.flatten(F.transform(profiles, lambda p: F.filter(F.transform(F.split(p, r"\+"), F.trim), lambda x: x != ""))))
