"""Text column expressions: pre-tokenisers, normalisers, previews, name rules.

Everything here returns a ``Column`` and stays JVM-side, except Unicode
normalisation, for which Spark has no built-in: it is an Arrow ``pandas_udf``
over ``unicodedata`` (one vectorised batch per call).
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigError

# --- fixed values: pre-tokeniser patterns -----------------------------------
# "whitespace": runs of word characters, or runs of other non-space characters,
# by the Unicode definitions of both classes.
PATTERN_WHITESPACE = r"(?U)\w+|[^\w\s]+"
# "digits": runs of digits, and runs of everything else (spaces kept).
PATTERN_DIGITS = r"\p{N}+|[^\p{N}]+"
# "whitespace_digits": as "whitespace", then every digit on its own.
PATTERN_WHITESPACE_DIGITS = r"(?U)\p{N}|[\w&&[^\p{N}]]+|[^\w\s\p{N}]+"
# "byte_level": the GPT-2 split rule, applied after a prefix space unless the text starts with one.
PATTERN_BYTE_LEVEL = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Names of the options.
PRE_TOKENIZERS = ("whitespace", "byte_level", "digits", "whitespace_digits")
NORMALIZERS = ("nfc", "nfd", "nfkc", "nfkd", "lowercase", "nfc_lowercase", "none")


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _extract(c: str | Column, pattern: str) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(pattern), 0)


def pretokenize(c: str | Column, kind: str = "whitespace") -> Column:
    """ARRAY<STRING> of pre-tokens of a text column."""
    if kind == "whitespace":
        return _extract(c, PATTERN_WHITESPACE)
    if kind == "digits":
        return _extract(c, PATTERN_DIGITS)
    if kind == "whitespace_digits":
        return _extract(c, PATTERN_WHITESPACE_DIGITS)
    if kind == "byte_level":
        text = F.when(_col(c).startswith(" "), _col(c)).otherwise(F.concat(F.lit(" "), _col(c)))
        pieces = _extract(text, PATTERN_BYTE_LEVEL)
        return F.transform(pieces, byte_level_chars)
    raise ConfigError(f"Unknown pre-tokenizer {kind!r}; choose one of {', '.join(PRE_TOKENIZERS)}")


_COUNT_PATTERNS = {"whitespace": PATTERN_WHITESPACE, "digits": PATTERN_DIGITS,
                   "whitespace_digits": PATTERN_WHITESPACE_DIGITS}


def pretoken_count(c: str | Column, kind: str = "whitespace") -> Column:
    """Number of pre-tokens, counted without building the array."""
    if kind in _COUNT_PATTERNS:
        return F.regexp_count(_col(c), F.lit(_COUNT_PATTERNS[kind]))
    return F.size(pretokenize(c, kind))


# --- byte-level alphabet -------------------------------------------------------
def byte_alphabet() -> str:
    """The 256-character printable alphabet of byte-level BPE, index = byte value.

    Rule (public GPT-2 encoder): bytes that are printable Latin-1 map to
    themselves; the others map, in byte order, to code points 256, 257, ...
    """
    keep = set(range(ord("!"), ord("~") + 1)) | set(range(0xA1, 0xAC + 1)) | set(range(0xAE, 0xFF + 1))
    out, extra = [], 0
    for b in range(256):
        if b in keep:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return "".join(out)


_BYTE_ALPHABET = byte_alphabet()


# Bytes whose stand-in is another character than Latin-1 has for them, and their stand-ins.
_MOVED = "".join(chr(b) for b, ch in enumerate(_BYTE_ALPHABET) if ch != chr(b))
_MOVED_TO = "".join(ch for b, ch in enumerate(_BYTE_ALPHABET) if ch != chr(b))


def byte_level_chars(piece: Column) -> Column:
    """Map each UTF-8 byte of ``piece`` to its printable stand-in, JVM-side: read as Latin-1, then translated."""
    return F.translate(F.decode(F.encode(piece, "UTF-8"), "ISO-8859-1"), _MOVED, _MOVED_TO)


# --- normalisation -------------------------------------------------------------
def _lower_keep_sigma(s: str) -> str:
    # per-character lowering: a final capital sigma becomes U+03C3, like the
    # tokenizer library, not U+03C2 as context-aware lowering would give
    return "".join(ch.lower() for ch in s)


def _normalizer_fn(kind: str):
    if kind in ("nfc", "nfd", "nfkc", "nfkd"):
        form = kind.upper()
        return lambda s: unicodedata.normalize(form, s)
    if kind == "lowercase":
        return _lower_keep_sigma
    if kind == "nfc_lowercase":
        return lambda s: _lower_keep_sigma(unicodedata.normalize("NFC", s))
    if kind == "none" or kind is None:
        return None
    raise ConfigError(f"Unknown normalizer {kind!r}; choose one of {', '.join(NORMALIZERS)}")


def normalize(c: str | Column, kind: str | None = "nfc") -> Column:
    """Unicode normalisation of a text column (Arrow batches)."""
    fn = _normalizer_fn(kind or "none")
    if fn is None:
        return _col(c)

    @F.pandas_udf(T.StringType())
    def _norm(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else fn(x))

    return _norm(_col(c))


def normalize_parts(c: Column, kind: str | None, keep: list[str]) -> Column:
    """:func:`normalize` on each string of an array, except those in ``keep``."""
    fn = _normalizer_fn(kind or "none")
    if fn is None:
        return c
    fixed = frozenset(keep)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def _norm(s: pd.Series) -> pd.Series:
        return s.map(lambda parts: None if parts is None else [p if p in fixed else fn(p) for p in parts])

    return _norm(c)


# --- previews and names --------------------------------------------------------
def preview(c: str | Column, width: int = 100, keep: int | None = None) -> Column:
    """``text[:keep] + '...'`` when longer than ``width`` characters, else the text."""
    keep = width if keep is None else keep
    col = _col(c)
    return F.when(F.length(col) > width, F.concat(F.substring(col, 1, keep), F.lit("..."))).otherwise(col)


def strip_text(c: str | Column) -> Column:
    """Python ``str.strip()`` on Unicode white space."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def short_name(c: str | Column) -> Column:
    """Last path component without a ``.json`` suffix."""
    return F.regexp_replace(F.element_at(F.split(_col(c), "/"), -1), r"\.json$", "")


# --- fixed values: marker clean-up after decoding ------------------------------
# byte-level markers: G-dot -> space, C-dot / C-caron-like newline markers -> "\n",
# C with caron -> carriage return
DECODE_MARKERS_FROM = "ĠĊĈĉČč"
DECODE_MARKERS_TO = " \n\n\n\r\r"


def clean_markers(c: str | Column) -> Column:
    return F.translate(_col(c), DECODE_MARKERS_FROM, DECODE_MARKERS_TO)
