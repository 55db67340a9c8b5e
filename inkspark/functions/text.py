"""String functions on markings, as column expressions.

A marking is a short code such as ``F5.5``, ``P-10`` or ``T=12``. Readings of it come with look-alike characters, full-width
forms, several dashes and stray white space.
"""

from __future__ import annotations

import json
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# Characters that stand for digits, digits that stand for a leading letter, dash-like characters.
DIGIT_FROM, DIGIT_TO = "ODQIL|!ZSGB", "00011112568"
LETTER_FROM, LETTER_TO = "50182", "SOIBZ"
DASHES = "‐‑‒–—―−_"
# Arrow characters, patterns of markings, limits of a leg length.
ARROWS = r"[\x{2190}-\x{21ff}\x{2794}\x{279c}\x{27a1}\x{25b6}\x{25ba}\x{25c0}\x{25c4}]"

CODE_VALUE = r"^([A-Z]+)([0-9]+(?:\.[0-9]+)?)$"
DIMENSION = r"^[0-9]{2,5}(?:\.[0-9]+)?$"
PART_LIKE = r"^[A-Z]{1,3}-[0-9]+[A-Z]?$"
# Characters read as the letter of a leg marking, and as its digits.
LEG_LETTER_FROM, LEG_LETTER_TO = "fFEPTvVuUYysS5$§", "FFFFFVVVVVVSSSSS"
LEG_DIGIT_FROM, LEG_DIGIT_TO = "OoDQIl|i!ZzBbGSs$qgAT/,·", "0000111112286655599477.."
THICKNESS = r"^(?:T[=:]?([0-9]+(?:\.[0-9]+)?)(?:MM)?|([0-9]+(?:\.[0-9]+)?)(?:MM)?T)$"
POSITION = r"(?<![0-9A-Za-z])([1-4][FG])(?![0-9A-Za-z])"

LEG_MIN_MM, LEG_MAX_MM = 2.0, 25.0

def _compatible() -> tuple[str, str, dict[str, str]]:
    """Characters that NFKC turns into one other character, those, and the ones that it turns into several."""
    one, several = {}, {}
    for c in map(chr, (*range(0xA0, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1F251))):
        to = unicodedata.normalize("NFKC", c)
        if to != c:
            (one if len(to) == 1 else several)[c] = to
    return "".join(one), "".join(one.values()), several


def _ranges(chars) -> str:
    """A pattern's class of characters, neighbours as ranges: a class of single ones is tried one by one."""
    out: list[list[int]] = []
    for n in sorted(map(ord, chars)):
        if out and out[-1][1] == n - 1:
            out[-1][1] = n
        else:
            out.append([n, n])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out)


_WIDE, _NARROW, _SEVERAL = _compatible()
_SEVERAL_CLASS = _ranges(_SEVERAL)
# a translate without surrogate pairs costs nothing for plain text; texts with characters that become several take a slower way


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Unicode NFKC, which has no built-in function."""
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """The matching-blocks ratio 2 * M / T of two strings; not an edit distance."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it; an expression is repeated otherwise."""
    return F.get(F.transform(F.array(value), body), 0)


def _ascii(value: Column) -> Column:
    """Whether every character is of one byte."""
    return F.octet_length(value) == F.length(value)


def compatible(value: Column) -> Column:
    """Each character in its compatibility form."""
    plain = _ascii(value)
    names = F.from_json(F.lit(json.dumps(_SEVERAL, ensure_ascii=False)), "map<string,string>")
    # the list of names is long: only characters that are in it are looked up
    one = lambda c: F.when((c < "\xa0") | ~c.rlike(f"[{_SEVERAL_CLASS}]"), c).otherwise(F.coalesce(F.try_element_at(names, c), c))
    slow = lambda folded: F.when(folded.rlike(f"[{_SEVERAL_CLASS}]"), F.array_join(F.transform(F.split(folded, ""), one), "")).otherwise(folded)
    return F.when(plain, value).otherwise(bound(F.translate(value, _WIDE, _NARROW), slow))


def normalize(value: Column | str, full: bool = False) -> Column:
    """Compatibility forms folded (full width, circled and roman numbers, ligatures), upper case, dash-like characters to ``-``, white
    space dropped.

    ``full`` applies all of NFKC (a pandas UDF), which also composes letters with combining marks; otherwise characters are folded
    one by one, which stays in the JVM.
    """
    v = nfkc(_c(value)) if full else compatible(_c(value))
    any_text = F.regexp_replace(F.translate(F.upper(v), DASHES, "-" * len(DASHES)), r"[\s\p{Z}]+", "")
    # plain text, nearly all of it, needs no pattern: white space is dropped with the dash
    return F.when(_ascii(_c(value)), F.translate(F.upper(_c(value)), "_ \t\n\x0b\f\r", "-")).otherwise(any_text)


def same_reading(a: Column | str, b: Column | str) -> Column:
    """Whether two readings agree but for case, width, dashes, white space and arrows; null reads as empty."""
    key = lambda v: normalize(F.regexp_replace(F.coalesce(_c(v), F.lit("")), ARROWS, ""))
    return key(a) == key(b)


def same_text(value: Column | str) -> Column:
    """Upper case without white space."""
    return F.upper(F.regexp_replace(_c(value), r"\s+", ""))


def digitize(value: Column | str) -> Column:
    """Look-alike letters to digits, comma to point."""
    return F.translate(_c(value), DIGIT_FROM + ",", DIGIT_TO + ".")


def _variants(key: Column) -> Column:
    """Repaired forms of a normalised reading."""
    found = F.regexp_extract_all(key, F.lit(r"^([A-Z]+)([-=:]?)"), F.lit(1))
    letters, sep = F.coalesce(F.get(found, 0), F.lit("")), F.regexp_extract(key, r"^[A-Z]+([-=:]?)", 1)

    def prefixed(m):
        tail = digitize(F.substring(key, F.length(m.letters) + F.length(m.sep) + 1, F.length(key)))
        return F.transform(
            F.sequence(F.lit(0), F.greatest(F.length(m.letters) - 1, F.lit(0))),
            lambda i: F.concat(F.substring(m.letters, F.lit(1), F.length(m.letters) - i), digitize(F.substring(m.letters, F.length(m.letters) - i + 1, F.length(m.letters))), m.sep, tail),
        )

    none = F.array().cast("array<string>")
    first = F.substring(key, 1, 1)
    lettered = F.when(
        (F.length(key) >= 2) & first.isin(*LETTER_FROM),
        F.array(F.concat(F.translate(first, LETTER_FROM, LETTER_TO), digitize(F.substring(key, 2, 1 << 20)))),
    ).otherwise(none)
    by_letters = bound(F.struct(letters.alias("letters"), sep.alias("sep")), lambda m: F.when(m.letters != "", prefixed(m)).otherwise(none))
    return F.array_remove(F.array_distinct(F.concat(by_letters, F.array(F.replace(key, F.lit(","), F.lit("."))), lettered)), key)


def ocr_variants(value: Column | str) -> Column:
    """Repaired forms of a reading in order of preference, without the normalised reading itself.

    The leading letters are kept from the longest run down to one, with the rest read as digits; then commas as
    points; then a leading digit as the letter it looks like.
    """
    return bound(normalize(value), lambda key: F.when(key.isNotNull(), _variants(key)))


def code_part(value: Column | str) -> Column:
    """The letters of a code with a number, else empty."""
    return F.regexp_extract(normalize(value), CODE_VALUE, 1)


def number_part(value: Column | str) -> Column:
    """The digits of a code with a number, else empty."""
    return F.regexp_extract(normalize(value), CODE_VALUE, 2)


def plausible_leg(digits: Column | str) -> Column:
    """The digits as a leg length of 2 to 25 mm, with a lost decimal point restored in two digits; null if neither fits."""
    d = _c(digits)
    size = d.try_cast("double")
    pointed = F.concat(F.substring(d, 1, 1), F.lit("."), F.substring(d, 2, 1))
    return F.when(size.between(LEG_MIN_MM, LEG_MAX_MM), d).when(
        d.rlike("^[0-9]{2}$") & pointed.try_cast("double").between(LEG_MIN_MM, LEG_MAX_MM), pointed
    )


def read_thickness(value: Column | str) -> Column:
    """struct(mm, read_as) of the first of the reading and its repaired forms that is a plate thickness, else null."""

    def read(key: Column) -> Column:
        hit = F.try_element_at(F.filter(F.concat(F.array(key), _variants(key)), lambda v: v.rlike(THICKNESS)), F.lit(1))
        return bound(hit, lambda h: F.when(h.isNotNull(), F.struct(F.coalesce(F.nullif(F.regexp_extract(h, THICKNESS, 1), F.lit("")), F.nullif(F.regexp_extract(h, THICKNESS, 2), F.lit(""))).cast("double").alias("mm"), h.alias("read_as"))))

    return bound(normalize(value), read)


def constrain(value: Column | str, allowed: str, similar: dict[str, str]) -> Column:
    """Keeps allowed characters, maps look-alikes of others, drops the rest."""
    v = _c(value)
    mapped = {k: t for k, t in similar.items() if k not in allowed}
    if mapped:
        v = F.translate(v, "".join(mapped), "".join(mapped.values()))
    return F.regexp_replace(v, "[^" + "".join("\\" + c if not c.isalnum() and c != " " else c for c in allowed) + "]", "")


def to_marking(value: Column | str) -> Column:
    """The first ``[FVS]d{1,2}(.d)?`` that a reading holds after repair of the letter and the digit places, else null.

    A reading of one character that stands for a letter is that letter; a digit isn't.
    """
    key = F.regexp_replace(_c(value), r"[\s\p{Z}]+", "")
    n = F.length(key)
    letter = lambda c: F.when(F.lit(LEG_LETTER_FROM).contains(c) & (c != ""), F.translate(c, LEG_LETTER_FROM, LEG_LETTER_TO)).otherwise("")
    starts = F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: F.regexp_extract(F.concat(letter(F.substring(key, i, F.lit(1))), F.translate(F.substring(key, i + 1, n), LEG_DIGIT_FROM, LEG_DIGIT_TO)), r"^([FVS][0-9]{1,2}(?:\.[0-9])?)", 1),
    )
    alone = (n == 1) & (letter(key) != "") & ~key.rlike("^[0-9]$")
    return F.when(alone, letter(key)).otherwise(F.try_element_at(F.filter(starts, lambda v: v != ""), F.lit(1)))


def natural_key(path: Column | str, width: int = 12) -> Column:
    """Sort key of a ``/`` path in which numbers inside a segment compare by value (``P-2`` before ``P-10``)."""
    pieces = lambda seg: F.regexp_extract_all(seg, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    return F.transform(
        F.split(_c(path), "/"),
        lambda seg: F.array_join(F.transform(pieces(seg), lambda p: F.when(p.rlike("^[0-9]+$"), F.lpad(p, width, "0")).otherwise(p)), ""),
    )


def collated(path: Column | str) -> Column:
    """The text with the order that people expect in lists: letters before their capitals, accents beside their letters, scripts apart."""
    return F.collate(_c(path), "UNICODE")


def suffix(path: Column | str) -> Column:
    """What follows the last ``/``."""
    return F.substring_index(_c(path), "/", -1)


def split_of(name: Column | str, share: float = 0.2) -> Column:
    """``eval`` for about ``share`` of the names, by SHA-1 as a whole number modulo 1000; else ``train``."""
    rest = F.aggregate(
        F.sequence(F.lit(1), F.lit(40)),
        F.lit(0).cast("long"),
        lambda acc, k: F.pmod(acc * 16 + F.conv(F.substring(F.sha1(_c(name)), k, F.lit(1)), 16, 10).cast("long"), F.lit(1000)),
    )
    return F.when(rest < int(share * 1000), "eval").otherwise("train")


def spans(tokens: Column | str, longest: int = 3) -> Column:
    """All runs of up to ``longest`` neighbouring tokens, joined by a space, each once."""

    def of(t: Column, k: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(t) - (k - 1), F.lit(1)))
        found = F.transform(starts, lambda i: F.array_join(F.slice(t, i, k), " "))
        return F.when(F.size(t) >= k, found).otherwise(F.array().cast("array<string>"))

    # bound: the tokens may be an expression, which each run would evaluate again
    return bound(_c(tokens), lambda t: F.array_distinct(F.concat(*[of(t, k) for k in range(1, longest + 1)])))


def leg_values(text: Column | str) -> Column:
    """The leg markings (F, V or S with a number) among the tokens of a text."""
    tokens = F.transform(F.split(F.upper(_c(text)), r"\s+"), lambda t: F.regexp_replace(t, r"[^A-Z0-9.]", ""))
    return F.array_distinct(F.filter(tokens, lambda t: t.rlike(r"^[FVS][0-9]{1,2}(\.[0-9])?$")))


def parse_aliases(text: Column | str) -> Column:
    """A comma list as trimmed, non-empty aliases."""
    return F.filter(F.transform(F.split(_c(text), ","), lambda a: F.trim(a)), lambda a: a != "")


def masked_url(url: Column | str) -> Column:
    """A connection URL with its password hidden."""
    return F.regexp_replace(_c(url), r":[^:@/]+@", ":***@")
