"""Literal values inside prose, found with spans by one JVM regex instead of a per-row parser.

The patterns are joined in priority order: a regex engine takes the leftmost match and, at one position, the first
alternative, which is the wanted rule (earliest start, then kind priority, then longest). Impossible calendar
dates are excluded inside the pattern, so their digits stay available as plain numbers.
"""

from __future__ import annotations

import calendar

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import vocab
from factloom.functions.text import let, nfkc, squash

_CODES = "|".join(vocab.CURRENCY_CODES)
_SIGNS = "".join(vocab.CURRENCY_SIGNS)
#: Digits with optional groups of thousands and decimal places.
_FIGURE = r"\d+(?:,\d{3})*(?:\.\d+)?"
_CURRENCY = rf"(?:[{_SIGNS}]|\b(?:{_CODES})\b)"
_UNIT_BEFORE, _UNIT_AFTER = rf"{_CURRENCY}\s*", rf"\s*(?:{_CODES})\b"
_ALONE = r"(?<![\w.])"  # not inside a word or a dotted number
MONEY = rf"[-+]?\s*{_UNIT_BEFORE}[-+]?{_FIGURE}|[-+]?{_FIGURE}{_UNIT_AFTER}"
PERCENT = rf"{_ALONE}[-+]?{_FIGURE}\s*%"


def _month_names(days: int) -> str:
    """The months with so many days (in no leap year), each written out or as its first three letters; September also with four."""
    own = [m for k, m in enumerate(vocab.MONTHS, 1) if calendar.monthrange(2001, k)[1] == days]
    return "(?:" + "|".join(f"{m[:3]}t?(?:ember)?" if m == "september" else m if len(m) == 3 else f"{m[:3]}(?:{m[3:]})?" for m in own) + ")"


def _month_numbers(days: int) -> str:
    return "(?:" + "|".join(f"{k:02d}" for k in range(1, 13) if calendar.monthrange(2001, k)[1] == days) + ")"


def _days(last: int, pad: str) -> str:
    """1 to ``last`` (28 to 31), with a leading zero as ``pad`` asks."""
    tens = {28: "1\\d|2[0-8]", 30: "[12]\\d|30", 31: "[12]\\d|3[01]"}[last]
    return f"(?:{pad}[1-9]|{tens})"


# years whose last two digits, or whose first two before 00, divide by four
_FOURS = "|".join(f"{k:02d}" for k in range(4, 100, 4))
_LEAP = rf"(?:\d\d(?:{_FOURS})|(?:00|{_FOURS})00)"
_SOME_YEAR = r"(?!0000)"
ISO_DATE = rf"\b{_SOME_YEAR}(?:\d{{4}}-(?:" + "|".join(f"{_month_numbers(n)}-{_days(n, '0')}" for n in (31, 30, 28)) + rf")|{_LEAP}-02-29)\b"
_REST = rf"(?:st|nd|rd|th)?,?\s+{_SOME_YEAR}"
MONTH_DATE = r"\b(?:" + "|".join(rf"{_month_names(n)}\.?\s+{_days(n, '0?')}{_REST}\d{{4}}" for n in (31, 30, 28)) + rf"|{_month_names(28)}\.?\s+29{_REST}{_LEAP})\b"
EMAIL = r"\b[\w.%+-]+@[\w.-]+\.\p{Alpha}{2,}\b"
URL = r"\bhttps?://[^<>\s]+"
#: Runs of letters and digits joined by - _ or /, the first of which begins with a letter; it counts only with a digit in it.
_JOINED = r"\b\p{Alpha}\p{Alnum}*(?:[/_-]\p{Alnum}+)+\b"
NUMBER = rf"{_ALONE}[-+]?{_FIGURE}(?![\w.])"

KINDS = ("money", "percent", "date", "email", "url", "identifier", "number")
ANY_LITERAL = "(?i)(?:" + "|".join([MONEY, PERCENT, ISO_DATE, MONTH_DATE, EMAIL, URL, _JOINED, NUMBER]) + ")"

#: Longer phrases first, so that none hides behind its beginning.
STATUS = r"\b(?:" + "|".join(p.replace(" ", r"\s+") for p in sorted(vocab.STATUS_PHRASES, key=len, reverse=True)) + r")\b"
_PLAIN_MONEY = rf"{_UNIT_BEFORE}{_FIGURE}|{_FIGURE}{_UNIT_AFTER}"
_PLAIN_PERCENT = rf"\b{_FIGURE}\s*%"
#: A number that its groups or its decimal places set apart from a mere count.
_FORMATTED = r"\b(?=\d+[.,]\d)\d{1,3}(?:,\d{3})+(?:\.\d+)?\b|\b\d+\.\d+\b"
_ANY_ISO = r"\b\d{4}-\d\d-\d\d\b"
_ANY_MONTH_DATE = rf"\b(?:{_month_names(31)}|{_month_names(30)}|{_month_names(28)})\.?\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}}\b"
COMPARABLE = "(?i)(?:" + "|".join([_PLAIN_MONEY, _PLAIN_PERCENT, _ANY_ISO, _ANY_MONTH_DATE, _JOINED, _FORMATTED, STATUS]) + ")"
IDENTIFIER = rf"(?=[\w/-]*\d){_JOINED}"


def plain_decimal(c: Column) -> Column:
    """Digits text without group commas, trailing zeros or a plus sign."""
    t = F.regexp_replace(c, r",|^\+", "")
    t = F.regexp_replace(t, r"^(-?)0+(?=[0-9])", "$1")
    t = F.regexp_replace(t, r"(\.[0-9]*?)0+$", "$1")
    return let(F.regexp_replace(t, r"\.$", ""), lambda x: F.when(x.isin("", "-0"), F.lit("0")).otherwise(x))


def date_of(raw: Column) -> Column:
    """ISO text of a matched date literal."""
    flat = F.regexp_replace(raw, r"(?i)([0-9])(?:st|nd|rd|th)", "$1")
    flat = F.regexp_replace(F.trim(F.regexp_replace(flat, r"[.,\s]+", " ")), "^(?i)sept ", "Sep ")
    written = let(flat, lambda x: F.coalesce(F.try_to_date(x, "MMMM d yyyy"), F.try_to_date(x, "MMM d yyyy")))
    return F.when(raw.rlike("^[0-9]{4}-"), raw).otherwise(F.date_format(written, "yyyy-MM-dd"))


_ANY_MONTH = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"


def literal_kind(raw: Column) -> Column:
    """Kind of a matched literal, told by the cheapest mark that sets it apart from the others."""
    return (
        F.when(raw.rlike("^[+-]?[0-9][0-9,.]*$"), "number")
        .when(raw.rlike("(?i)^https?://"), "url")
        .when(raw.contains("@"), "email")
        .when(raw.endswith("%"), "percent")
        .when(raw.rlike(rf"(?i)[$€£]|^[+-]?\s*(?:{_CODES})\s*[+-]?[0-9][0-9,.]*$|^[+-]?[0-9][0-9,.]*\s*(?:{_CODES})$"), "money")
        .when(raw.rlike(rf"(?i)^[0-9]|^(?:{_ANY_MONTH})[a-z]*\.?\s"), "date")
        .otherwise("identifier")
    )


def literal_norm(raw: Column, kind: Column) -> Column:
    amount = plain_decimal(F.regexp_replace(F.regexp_replace(raw, rf"(?i)[$€£\s]|{_CODES}", ""), r"^\+-", "-"))
    currency = F.upper(F.regexp_extract(raw, rf"(?i)([$€£]|{_CODES})", 1))
    return (
        F.when(kind == "money", F.concat_ws(" ", currency, amount))
        .when(kind == "percent", F.concat(plain_decimal(F.regexp_replace(raw, r"[\s%]", "")), F.lit("%")))
        .when(kind == "date", date_of(raw))
        .when(kind == "number", plain_decimal(raw))
        .otherwise(squash(nfkc(raw)))
    )


_OPEN, _CLOSE = "\x01", "\x02"


def regex_spans(text: Column, pattern: str) -> Column:
    """All matches as ``array<struct<start,stop,raw>>`` (0-based, end exclusive).

    One pass of the regex brackets every match with two control characters; the rest is cutting at those.
    """
    spans = "array<struct<start:int,stop:int,raw:string>>"
    clean = F.translate(text, _OPEN + _CLOSE, "  ")
    parts = F.split(F.regexp_replace(clean, pattern, f"{_OPEN}$0{_CLOSE}"), _OPEN)

    def step(acc: Column, part: Column) -> Column:
        n = F.locate(_CLOSE, part) - 1
        item = F.struct(acc["pos"].alias("start"), (acc["pos"] + n).alias("stop"), F.left(part, n).alias("raw"))
        return F.struct((acc["pos"] + F.char_length(part) - 1).alias("pos"), F.concat(acc["out"], F.array(item)).alias("out"))

    def walk(pieces: Column) -> Column:
        zero = F.struct(F.char_length(F.get(pieces, F.lit(0))).alias("pos"), F.array().cast(spans).alias("out"))
        return F.aggregate(F.slice(pieces, 2, F.size(pieces)), zero, step, lambda acc: acc["out"])

    return F.when(text.isNull(), F.lit(None).cast(spans)).otherwise(let(parts, walk))


LITERALS = "array<struct<start:int,stop:int,kind:string,raw:string,norm:string>>"


def extract_literals(text: Column) -> Column:
    """``array<struct<start,stop,kind,raw,norm>>`` of the literals in a text, in order of appearance."""

    def kinded(s: Column) -> Column:
        bare = F.trim(s["raw"])
        return let(F.struct(s["start"].alias("start"), s["raw"].alias("raw"), literal_kind(bare).alias("kind")), finish)

    def finish(s: Column) -> Column:
        raw = F.when(s["kind"].isin("email", "url", "identifier"), F.rtrim(s["raw"], F.lit(".,"))).otherwise(s["raw"])
        return let(F.struct(s["start"].alias("start"), s["kind"].alias("kind"), raw.alias("raw"), F.trim(raw).alias("bare")), place)

    def place(s: Column) -> Column:
        lead = F.char_length(s["raw"]) - F.char_length(F.ltrim(s["raw"]))
        return F.struct(
            (s["start"] + lead).alias("start"),
            (s["start"] + F.char_length(s["raw"])).alias("stop"),
            s["kind"].alias("kind"),
            s["bare"].alias("raw"),
            literal_norm(s["bare"], s["kind"]).alias("norm"),
        )

    none = F.array().cast(LITERALS)
    spans = F.filter(regex_spans(text, ANY_LITERAL), lambda s: s["raw"].rlike("[0-9@:]"))  # joined words without a digit are none
    return F.when(text.rlike("[0-9@]|://"), F.transform(spans, kinded)).otherwise(none)


def comparable_values(text: Column) -> Column:
    """The coarser vocabulary for cross-source conflict: ``array<struct<kind,raw,norm>>``."""

    def finish(raw: Column) -> Column:
        return let(F.struct(raw.alias("raw"), (
            F.when(raw.rlike(rf"(?i)^(?:{_PLAIN_MONEY})$"), "currency")
            .when(raw.endswith("%"), "percent")
            .when(raw.rlike(rf"(?i)^(?:{_ANY_ISO}|{_ANY_MONTH_DATE})$"), "date")
            .when(raw.rlike(rf"(?i)^(?:{IDENTIFIER})$"), "identifier")
            .when(raw.rlike("^[0-9.,]+$"), "number")
            .otherwise("status")
        ).alias("kind")), place)

    def place(s: Column) -> Column:
        raw, kind = s["raw"], s["kind"]
        amount = plain_decimal(F.regexp_replace(raw, rf"(?i)[$€£\s]|{_CODES}", ""))
        norm = (
            F.when(kind == "currency",
                   F.concat_ws(":", F.upper(F.regexp_extract(raw, rf"(?i)([$€£]|{_CODES})", 1)), amount))
            .when(kind == "percent", F.replace(raw, F.lit(" "), F.lit("")))
            .when(kind == "number", F.replace(raw, F.lit(","), F.lit("")))
            .otherwise(F.lower(raw))
        )
        return F.struct(kind.alias("kind"), raw.alias("raw"), norm.alias("norm"))

    hits = F.transform(F.regexp_extract_all(text, F.lit(COMPARABLE), F.lit(0)), lambda h: F.trim(h))
    return F.transform(F.filter(hits, lambda h: h.rlike("[0-9]") | ~h.rlike("[/_-]")), finish)
