"""Small value functions: number and label texts, times, ids, JSON, arrays and maps, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkspark.functions.text import bound

_KEEP_NULLS = {"ignoreNullFields": "false"}


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


# --- texts -------------------------------------------------------------------


def short_number(value: Column | str) -> Column:
    """A number with at most six significant digits and without closing zeros (``%g``): 1234.5678 is ``1234.57``, 1234567 is ``1.23457e+06``."""
    return bound(bound(_c(value).cast("double"), _six_digits), _plain_digits)


def _six_digits(x: Column) -> Column:
    """``d.ddddde+xx`` as C rounds it: by the exact binary value, halves to the even digit (``format_number`` sends halves up)."""
    six, seven = (F.call_function("format_number", x, F.lit(f"0.{'0' * n}E00")) for n in (5, 6))
    digits = F.regexp_replace(F.regexp_extract(seven, r"([0-9.]+)E", 1), r"\.", "").try_cast("long")
    k = F.regexp_extract(seven, "E(.*)$", 1).try_cast("int") - 6
    # odd digits times ten to the k are a double of their own if five to the k divides them, or leaves at most 53 bits
    whole = F.when(k < 0, F.pmod(digits, F.pow(F.lit(5.0), F.least(-k, F.lit(12))).cast("long")) == 0).otherwise(digits * F.pow(F.lit(5.0), F.least(k, F.lit(30))) < float(1 << 53))
    half = seven.rlike("[02468]5E") & (seven.try_cast("double") == x) & whole
    text = F.when(half, F.regexp_replace(seven, "5E", "E")).otherwise(six)
    return F.replace(F.regexp_replace(text, "E([0-9])", "e+$1"), F.lit("E"), F.lit("e"))


def _plain_digits(text: Column) -> Column:
    """``d.ddddde+xx`` with the point at its place, or with the exponent where that is below -4 or above 5."""
    sign, digits = F.regexp_extract(text, "^(-?)", 1), F.replace(F.regexp_extract(text, r"([0-9]\.[0-9]{5})", 1), F.lit("."), F.lit(""))
    power = F.regexp_extract(text, "e(.*)$", 1).try_cast("int")
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    below = F.concat(F.lit("0."), F.repeat(F.lit("0"), -1 - power), digits)
    within = F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.lit(6)))
    return (
        F.when(power.isNull(), F.lower(F.replace(text, F.lit("∞"), F.lit("inf"))))
        .when((power < -4) | (power > 5), F.concat(sign, bare(F.regexp_extract(text, r"([0-9]\.[0-9]{5})", 1)), F.regexp_extract(text, "(e.*)$", 1)))
        .otherwise(F.concat(sign, bare(F.when(power < 0, below).otherwise(within))))
    )


def whole_percent(share: Column | str) -> Column:
    """0.815 as ``82%``; halves go to the even number."""
    return F.concat(F.bround(_c(share) * 100).cast("long").cast("string"), F.lit("%"))


def padded(number: Column | str, width: int = 6) -> Column:
    return F.lpad(_c(number).cast("string"), width, "0")


def span(low: Column | str, high: Column | str) -> Column:
    """``5`` if both ends are equal, else ``5~8``; null if an end is null."""
    lo, hi = _c(low), _c(high)
    return F.when(lo == hi, short_number(lo)).otherwise(F.concat(short_number(lo), F.lit("~"), short_number(hi)))


def standard_line(joint_type, thick_low, thick_high, leg_low, leg_high, process, position) -> Column:
    """One line about a standard; ranges that are null are left out."""
    ranged = lambda name, a, b: F.when(_c(a).isNotNull(), F.concat(F.lit(f"{name} "), span(a, b), F.lit("mm")))
    return F.concat_ws(" ", _c(joint_type), ranged("thickness", thick_low, thick_high), ranged("leg", leg_low, leg_high), _c(process), _c(position))


def labelled(code: Column | str, labels: dict[str, str], unit: str = "") -> Column:
    """The label of a code, or the code itself, with a unit behind it; null stays null."""
    names = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    out = F.coalesce(F.try_element_at(names, _c(code)), _c(code))
    return F.concat(out, F.lit(unit)) if unit else out


def sides_summary(left: Column | str, right: Column | str, names: tuple[str, str] = ("left", "right")) -> Column:
    """``left a/b, right c`` of two lists; an empty side isn't named, null if both are empty."""
    part = lambda name, a: F.when(F.size(_c(a)) > 0, F.concat(F.lit(f"{name} "), F.array_join(_c(a), "/")))
    return F.nullif(F.concat_ws(", ", part(names[0], left), part(names[1], right)), F.lit(""))


def first_text(*values: Column | str) -> Column:
    """The first text that is neither null nor blank, else the empty text."""
    return F.coalesce(*[F.when(F.trim(_c(v)) != "", _c(v)) for v in values], F.lit(""))


def joined_errors(errors: Column | str) -> Column:
    """array<struct<field, message>> as ``field: message / ...``; an error without a field is its message."""
    return F.array_join(F.transform(_c(errors), lambda e: F.when(e.field.isNull(), e.message).otherwise(F.concat(e.field, F.lit(": "), e.message))), " / ")


def json_tokens(text: Column | str) -> Column:
    """The tokens of a JSON text with their kinds: key, string, number, word or mark."""
    string = r'"(?:[^"\\]|\\.)*"'
    tokens = F.regexp_extract_all(_c(text), F.lit(rf'({string}\s*:?|-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null|[{{}}\[\],])'), F.lit(1))
    kind = lambda t: F.when(t.rlike(r'^".*:$'), "key").when(t.startswith('"'), "string").when(t.rlike("^[-0-9]"), "number").when(t.rlike("^[tfn]"), "word").otherwise("mark")
    return F.transform(tokens, lambda t: F.struct(F.regexp_replace(t, r"\s*:$", "").alias("token"), kind(t).alias("kind")))


# --- times ---------------------------------------------------------------------


def utc_text(ts: Column | str) -> Column:
    """A timestamp as ISO text in UTC with ``Z``, whatever the session's zone."""
    return F.date_format(F.to_utc_timestamp(_c(ts).cast("timestamp"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def from_utc_text(text: Column | str) -> Column:
    """ISO text with an offset as a timestamp; null if it isn't one."""
    return F.try_to_timestamp(_c(text))


def relative_day(ts: Column | str, now: Column | str) -> Column:
    """``today``, ``yesterday`` or the date, by calendar days."""
    days = F.datediff(F.to_date(_c(now)), F.to_date(_c(ts)))
    return F.when(days == 0, "today").when(days == 1, "yesterday").otherwise(F.date_format(_c(ts), "yyyy-MM-dd"))


# --- ids and hashes ----------------------------------------------------------------


def natural_id(prefix: str, *parts: Column | str) -> Column:
    """``prefix_`` and twelve hex digits of a hash of the natural key: the same id for the same key, on every run and retry."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws("|", *[_c(p).cast("string") for p in parts]), 256), 1, 12))


def is_ref(value: Column | str) -> Column:
    """Whether a text is a reading's id: t, s or v and digits."""
    return F.coalesce(_c(value).rlike("^[tsv][0-9]+$"), F.lit(False))


def seed_of(name: Column | str, condition: Column | str) -> Column:
    """CRC-32 of ``name|condition``."""
    return F.crc32(F.concat(_c(name), F.lit("|"), _c(condition)))


# --- JSON ----------------------------------------------------------------------------


def json_text(value: Column | str) -> Column:
    """JSON with all fields, nulls included."""
    return F.to_json(_c(value), _KEEP_NULLS)


def changed_fields(old: Column | str, new: Column | str, names: list[str]) -> Column:
    """Names of the fields that differ between two structs; nulls equal nulls, arrays compare in order."""
    a, b = _c(old), _c(new)
    return F.array_compact(F.array(*[F.when(~a[n].eqNullSafe(b[n]), F.lit(n)) for n in names]))


# --- arrays and maps -------------------------------------------------------------------


def other_candidates(candidates: Column | str, label: Column | str) -> Column:
    """Candidates behind the first that aren't the chosen label."""
    c = _c(candidates)
    return F.filter(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(1))), lambda x: x != _c(label))


def overridden(base: Column | str, over: Column | str) -> Column:
    """Union of two maps; the second wins."""
    a, b = _c(base), _c(over)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def by_ref(values: Column | str, ref: Column | str, default: Column | str) -> Column:
    """The map's value of a ref, else the default."""
    return F.coalesce(F.try_element_at(_c(values), _c(ref)), _c(default))


def toggled(chosen: Column | str, item: Column | str, order: tuple[str, ...]) -> Column:
    """The chosen set with an item added or taken away, in canonical order."""
    c, i = _c(chosen), _c(item)
    has = lambda x: F.when(x == i, ~F.array_contains(c, x)).otherwise(F.array_contains(c, x))
    return F.filter(F.array(*map(F.lit, order)), has)


def in_order(chosen: Column | str, order: tuple[str, ...]) -> Column:
    """The members of a fixed list that a set has, in the list's order."""
    return F.filter(F.array(*map(F.lit, order)), lambda x: F.array_contains(_c(chosen), x))


def renamed(values: Column | str, names: dict[str, str], fallback: str) -> tuple[Column, Column]:
    """(values with their new names, each once; the first of them or the fallback)."""
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    out = F.array_distinct(F.transform(_c(values), lambda v: F.coalesce(F.try_element_at(m, v), v)))
    return out, F.coalesce(F.try_element_at(out, F.lit(1)), F.lit(fallback))


def doubtful(chars: Column | str, probs: Column | str, least: float = 0.8) -> Column:
    """Each character of a text with whether its probability is under ``least``."""
    letters = F.filter(F.split(_c(chars), ""), lambda c: c != "")
    return F.transform(F.arrays_zip(letters.alias("c"), _c(probs).alias("p")), lambda x: F.struct(x["c"].alias("char"), (x["p"] < least).alias("doubtful")))


def smallest_free(used: Column | str) -> Column:
    """The smallest positive whole number that isn't in an array."""
    u = _c(used)
    return F.array_min(F.array_except(F.sequence(F.lit(1), F.size(F.array_distinct(u)) + 1), u))
