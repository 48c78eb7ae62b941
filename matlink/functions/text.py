"""Normalised item texts, tokens, hashes and lenient parsing, as Column expressions.

Only the fixed-point normaliser needs Python (NFKC and spelling have no built-in).
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from matlink.sources.policy import Dictionary, dictionary, literal_map

#: The ordered rewriting rules: pattern, replacement. Fixed values.
REWRITES = [
    (r'["“”]', " IN "),
    (r"[,;()]", " "),
    (r"/(?=[A-Z])", " "),
    (r"(\d)\s*(?:INCHES|INCH|IN)\b", "$1 IN"),
    (r"\bDN\s*(\d+)\b", "$1 NB"),
    (r"(\d)\s*NB\b", "$1 NB"),
    (r"(\d+)\s*#", "CL$1"),
    (r"\bCLASS\s*(\d+)", "CL$1"),
    (r"\bCL\s+(\d+)", "CL$1"),
    (r"\bSCH(?:EDULE)?\.?\s*(\d+S?|STD|XS|XXS)\b", "SCH$1"),
    (r"\bGR(?:ADE)?\.?\s*([A-Z0-9][A-Z0-9.]*)", "GR$1"),
]
TOKEN = r"[A-Z0-9][A-Z0-9.\-]*"
_MOST_PASSES = 8
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def spellings(d: Dictionary) -> dict[str, str]:
    """Every repairable misspelling and its only neighbour in the vocabulary.

    Made from the vocabulary: swaps of neighbours for all, and single changed, added or
    removed letters where the misspelling has five letters or more.
    """
    near: dict[str, set[str]] = {}
    for word in d.vocabulary:
        cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
        swaps = {a + b[1] + b[0] + b[2:] for a, b in cuts if len(b) > 1}
        others = {a + b[1:] for a, b in cuts if b} | {a + c + b[1:] for a, b in cuts if b for c in _LETTERS} | {a + c + b for a, b in cuts for c in _LETTERS}
        for typo in swaps | {o for o in others if len(o) >= 5}:
            near.setdefault(typo, set()).add(word)
    known = d.vocabulary | d.protected | set(d.abbreviations)
    return {typo: next(iter(words)) for typo, words in near.items() if len(words) == 1 and len(typo) >= 4 and typo not in known}


def rewritten(text: Column, d: Dictionary | None = None) -> Column:
    """One pass of the rewriting rules and abbreviations over upper-case text, as an expression."""
    for pattern, to in REWRITES:
        text = F.regexp_replace(text, pattern, to)
    for short, full in (d or dictionary()).abbreviations.items():
        text = F.regexp_replace(text, rf"\b{short}\b", full)
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normaliser(d: Dictionary | None = None):
    """A function of texts: struct(text, repairs), at the fixed point of cleaning, repair and rewriting."""
    d = d or dictionary()
    repairs = spellings(d)
    rules = [(re.compile(p), to.replace("$1", r"\1")) for p, to in REWRITES]
    rules += [(re.compile(rf"\b{re.escape(short)}\b"), full) for short, full in d.abbreviations.items()]
    word = re.compile(r"\b[A-Z]{4,}\b")

    @F.pandas_udf("text string, repairs array<string>")
    def normal(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            if text is None:
                out.append((None, []))
                continue
            found: dict[str, None] = {}

            def fix(m: re.Match, found=found) -> str:
                new = repairs.get(m[0])
                if new:
                    found[f"{m[0]} -> {new}"] = None
                return new or m[0]

            before = None
            for _ in range(_MOST_PASSES):
                if text == before:
                    break
                before = text
                text = unicodedata.normalize("NFKC", "".join(c for c in unicodedata.normalize("NFKC", text) if c.isprintable() or c.isspace()).upper())
                text = word.sub(fix, text)
                for rx, to in rules:
                    text = rx.sub(to, text)
                text = " ".join(text.split())
            out.append((text, list(found)))
        return pd.DataFrame(out, columns=["text", "repairs"])

    return normal


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.upper(text), F.lit(TOKEN), F.lit(0))


def numeric_tokens(text: Column) -> Column:
    return F.array_sort(F.regexp_extract_all(F.upper(text), F.lit(r"\d+(?:\.\d+)?"), F.lit(0)))


def record_text(long_text: Column, short_text: Column) -> Column:
    """The long text if it says anything, else the short one."""
    return F.coalesce(F.when(F.trim(long_text) != "", long_text), short_text)


def short_text(short: Column, long: Column, limit: int = 40) -> Column:
    """The short text if it says anything, else the head of the long one without white space at its end."""
    return F.coalesce(F.when(F.trim(short) != "", short), F.regexp_replace(F.substring(long, 1, limit), r"\s+$", ""))


def content_hash(**fields: Column) -> Column:
    """SHA-256 of name=value of all fields in their order; a null is empty."""
    parts = [F.concat(F.lit(f"{name}="), F.coalesce(value.cast("string"), F.lit(""))) for name, value in fields.items()]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def vendor_hash(salt: Column, vendor: Column) -> Column:
    return F.when(F.trim(vendor) != "", F.sha2(F.concat(salt, F.trim(vendor)), 256))


def lenient_number(text: Column) -> Column:
    """Digits, dots and signs of a text as a number that isn't negative, or null."""
    number = F.regexp_replace(text, r"[^0-9.\-]", "").try_cast("decimal(38,6)")
    return F.when(number >= 0, number)


def lenient_date(text: Column) -> Column:
    """The first of four formats that fits. A text is parsed only in a format whose shape it has, since each failure costs an exception."""
    shape = lambda f: "^" + f.replace("yyyy", "[+-]?[0-9]{4,19}").replace("MM", "[0-9]{2}").replace("dd", "[0-9]{2}") + "$"
    t = F.trim(text)
    return F.coalesce(*(F.when(t.rlike(shape(f)), F.try_to_timestamp(t, F.lit(f)).cast("date")) for f in ("yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "yyyy/MM/dd")))


def criticality(text: Column) -> Column:
    """True, false or null of Y/N-like texts."""
    t = F.upper(F.trim(text))
    return F.when(t.isin("Y", "YES", "TRUE", "1"), True).when(t.isin("N", "NO", "FALSE", "0"), False)


def unit(text: Column, d: Dictionary | None = None) -> Column:
    """struct(unit, ambiguous): the canonical unit of an alias."""
    d = d or dictionary()
    key = F.upper(F.trim(text))
    ambiguous = key.isin(*d.ambiguous_units)
    return F.struct(F.when(~ambiguous, literal_map(d.units)[key]).alias("unit"), F.coalesce(ambiguous, F.lit(False)).alias("ambiguous"))


def safe_cell(text: Column) -> Column:
    """A text that a spreadsheet won't take for a formula."""
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def luhn_digit(digits: Column) -> Column:
    """Check digit of a text of digits: every second digit from the right counts double."""

    def worth(i: Column) -> Column:
        n = F.substring(digits, i, F.lit(1)).cast("int")
        twice = n * 2
        return F.when((F.length(digits) - i) % 2 == 0, F.floor(twice / 10).cast("int") + twice % 10).otherwise(n)

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + worth(i))
    return ((10 - total % 10) % 10).cast("string")


def item_code(number: Column) -> Column:
    """NMC- and ten digits with their check digit."""
    digits = F.lpad(number.cast("string"), 10, "0")
    return F.concat(F.lit("NMC-"), digits, luhn_digit(digits))


def code_valid(code: Column) -> Column:
    return code.rlike(r"^NMC-\d{11}$") & F.coalesce(F.call_function("luhn_check", F.substring(code, 5, 11)), F.lit(False))
