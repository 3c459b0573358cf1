"""Text expressions: stripping, normalisation, the statistics that filters look at."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space of Unicode text, as str.strip() takes it.
SPACE_RANGES = ((0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
SPACES = "".join(chr(c) for a, b in SPACE_RANGES for c in range(a, b + 1))
SPACE_CLASS = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in SPACE_RANGES)
URL = rf"(?i)^(?:https?://|www\.)[^{SPACE_CLASS}]+\z"
CONTROLS = r"[\x00-\x08\x0B-\x1F\x7F-\x9F]"
SAMPLE, LEAST_SAMPLE, LONGEST_PERIOD = 4096, 20, 16
REASONS = ("empty_or_invalid", "link_only", "no_letters", "corrupted", "repetitive")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.btrim(F.regexp_replace(c, f"[{SPACE_CLASS}]+", " "), F.lit(" "))


def first_text(*columns: Column) -> Column:
    """The first that isn't blank, stripped; else the empty string."""
    return F.coalesce(*(F.nullif(strip(c), F.lit("")) for c in columns), F.lit(""))


def join_parts(*parts: Column) -> Column:
    """Parts that aren't blank, stripped, with an empty line between; null if there are none."""
    return F.nullif(F.concat_ws("\n\n", *(F.nullif(strip(p), F.lit("")) for p in parts)), F.lit(""))


def _composed(c: Column) -> Column:
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "string")(c)


def compose(c: Column) -> Column:
    """NFC. Characters below U+0300 are composed already, so only texts with others leave the JVM."""
    return F.coalesce(_composed(F.when(c.rlike(r"[\x{300}-\x{10FFFF}]"), c)), c)


def normalise(c: Column, nfc: bool = True) -> Column:
    """Line ends, composition, byte-order marks, control characters, stripping, in this order."""
    c = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    c = compose(c) if nfc else c
    return strip(F.regexp_replace(F.replace(c, F.lit("﻿"), F.lit("")), CONTROLS, ""))


@functools.cache
def plug(name: str):
    """Optional converters by name: mojibake repair and simplification, if their packages are installed."""
    import importlib

    if name == "repair":
        fix = importlib.import_module("ftfy").fix_text
    elif name == "simplify":
        fix = importlib.import_module("opencc").OpenCC("tw2sp").convert
    else:
        raise KeyError(name)
    return F.pandas_udf(lambda s: s.map(fix, na_action="ignore"), "string")


def compact(c: Column) -> Column:
    return F.regexp_replace(c, f"[{SPACE_CLASS}]+", "")


def sample(c: Column) -> Column:
    """The first letters and digits, lower-cased."""
    return F.lower(F.substring(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""), 1, SAMPLE))


def dominant(s: Column) -> Column:
    """How often the most frequent character of s occurs."""
    chars = F.array_distinct(F.filter(F.split(s, ""), lambda c: c != ""))
    return F.coalesce(F.array_max(F.transform(chars, lambda c: F.length(s) - F.length(F.replace(s, c, F.lit(""))))), F.lit(0))


def periodic(s: Column) -> Column:
    """Whether s repeats with a period of 2 to 16, a quarter of its length at most."""
    n, most = F.length(s), F.least(F.lit(LONGEST_PERIOD), F.floor(F.length(s) / 4).cast("int"))
    periods = F.when(most >= 2, F.sequence(F.lit(2), most)).otherwise(F.array().cast("array<int>"))
    return F.exists(periods, lambda p: F.substring(s, p + 1, n) == F.substring(s, F.lit(1), n - p))
