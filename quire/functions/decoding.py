"""Bytes to text, and repairs that regular expressions can't express."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import text as T

# Encodings that are tried in this order where UTF-8 fails.
FALLBACKS = ("windows-1255", "iso-8859-8", "windows-1256", "iso-8859-6", "windows-1252", "cp1251")
#: The patterns of broken characters, in Python's spelling of code points.
CONTROL, REPLACEMENT, COMBINING = (re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: chr(int(m[1], 16)), p) for p in (T.CONTROL, T.REPLACEMENT, T.COMBINING))
BROKEN = re.compile("|".join((CONTROL, REPLACEMENT, COMBINING)))
RUN = re.compile(r"[A-Za-z][A-Za-z\s]*")


def confidence(text: str) -> float:
    """Share of printable ASCII and white space in the bytes, less penalties."""
    if not text:
        return 0.0
    n = len(text.encode())
    readable = sum(c.isspace() or "!" <= c <= "~" for c in text)
    penalty = (len(re.findall(REPLACEMENT, text)) + 2 * len(re.findall(CONTROL, text))) / n
    cyrillic = sum(len(m.encode()) for m in re.findall("[Ѐ-ӿ]{3,}", text))
    return max(0.0, min(1.0, readable / n - penalty - (0.3 if cyrillic > 0.1 * n else 0.0)))


def decode(data: bytes | None, label: str | None = None) -> str | None:
    """By label if it is a known one, else UTF-8 or UTF-16 by its mark, else the first
    fallback that decodes and reads well, else Windows-1252 with replacements;
    broken characters are dropped."""
    if data is None:
        return None
    tried = [label] if label else []
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        tried.append("utf-16")
    for name in [*tried, "utf-8-sig"]:
        try:
            return BROKEN.sub("", data.decode(name))
        except (UnicodeDecodeError, LookupError):
            continue
    for name in FALLBACKS:
        try:
            text = data.decode(name)
        except UnicodeDecodeError:
            continue
        if confidence(text) > 0.5:
            return BROKEN.sub("", text)
    return BROKEN.sub("", data.decode("windows-1252", "replace"))


def safe_decode(data: Column, label: Column | None = None) -> Column:
    """A detector needs to try encodings, so this is a vectorised UDF."""

    @F.pandas_udf("string")
    def run(rows: pd.Series, labels: pd.Series) -> pd.Series:
        return pd.Series([decode(None if d is None else bytes(d), x) for d, x in zip(rows, labels, strict=True)], dtype=object)

    return run(data, label if label is not None else F.lit(None).cast("string"))


def collapse(text: str | None) -> str | None:
    """In ASCII text, letters set apart by white space (three at least, as many gaps
    as letters less one) join, in lower case and with a space after. Of a
    run that is only in part so wide, the longest end that is."""
    if text is None or not text.isascii():
        return text

    def joined(m: re.Match) -> str:
        run = m[0]
        letters = [i for i, c in enumerate(run) if c.isalpha()]
        n = len(letters)
        for k, at in enumerate(letters):
            if n - k < 3:
                break
            if len(run) - at >= 2 * (n - k) - 1:
                return run[:at] + "".join(run[i].lower() for i in letters[k:]) + " "
        return run

    return RUN.sub(joined, text)


def collapse_scattered(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(collapse)

    return run(text)
