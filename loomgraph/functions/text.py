"""Text normal forms used by several operators.

Unicode composition has no built-in expression in Spark, so the forms below are Arrow UDFs that
work on whole column batches; everything that Catalyst can express stays in SQL functions.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


class _Keep(dict):
    """str.translate table filled on first use of a character."""

    def __init__(self, rule):
        super().__init__()
        self.rule = rule

    def __missing__(self, cp: int):
        self[cp] = v = self.rule(chr(cp))
        return v


def _letter_digit_mark(ch: str):
    return ch if ch.isalnum() or unicodedata.category(ch)[0] == "M" else None


def _folded(ch: str):
    """Lower-case letters and digits without accents; marks and format characters vanish, all else is a space."""
    if unicodedata.category(ch) in ("Mn", "Me", "Cf"):
        return None
    base = "".join(c for c in unicodedata.normalize("NFD", _BASE.get(ch, ch)) if unicodedata.category(c) not in ("Mn", "Me")).lower()
    out = "".join(c for c in unicodedata.normalize("NFD", base) if unicodedata.category(c) not in ("Mn", "Me"))
    return out if out and all(c.isalnum() for c in out) else "".join(c if c.isalnum() else " " for c in out) or " "


_BASE = {"đ": "d", "Đ": "D", "ð": "d", "ı": "i"}
_KEY, _FOLD = _Keep(_letter_digit_mark), _Keep(_folded)


def compare_key(text: str | None) -> str | None:
    """Lower-case letters, digits and accents in composed form: case, spaces, punctuation and invisible
    characters are gone. None stays None, text without any letter or digit gives ""."""
    if text is None:
        return None
    if text.isascii():
        return text.lower().translate(_KEY)
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).lower().translate(_KEY))


def fold(text: str | None) -> str | None:
    """Lower-case words of letters and digits without accents, joined by one space; đ becomes d. None stays None."""
    return None if text is None else " ".join(text.translate(_FOLD).split())


def text_udf(fn):
    """Arrow UDF that maps a text function over a string column."""

    def run(v: pa.Array) -> pa.Array:
        return pa.array([fn(x) for x in v.to_pylist()], pa.string())

    run.__annotations__ = {"v": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")


def compare_key_col(c: Column) -> Column:
    return text_udf(compare_key)(c)


def fold_col(c: Column) -> Column:
    return text_udf(fold)(c)


def nfc(text: str | None) -> str | None:
    return text if text is None or text.isascii() else unicodedata.normalize("NFC", text)


def nfc_col(c: Column) -> Column:
    return text_udf(nfc)(c)


#: White space in the Unicode sense, as a character class of both Java and RE2.
SPACE = r"[ \t\n\r\x{0B}\x{0C}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip(c: Column) -> Column:
    """Outer white space removed, in the Unicode sense (trim() only knows the plain space)."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def strip_sql(c: str) -> str:
    """The same in DuckDB."""
    return f"regexp_replace({c}, '^{SPACE}+|{SPACE}+$', '', 'g')"
