"""String semantics of the document model: one explicit white-space class, labels, slugs, decoding, UTF-16 lengths.

Plain functions serve the parser; those that end in ``_col`` are Column expressions with the same results.
"""

from __future__ import annotations

import re
import unicodedata
from urllib.parse import unquote_to_bytes

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that count as white space.
WS = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: The same as the inside of a character class, for Python and Java.
WS_CLASS = r"\t\n\x0b\x0c\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: What a dot matches.
DOT = r"[^\n\r\u2028\u2029]"
#: Characters that a backslash escapes.
ESCAPABLE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_ESCAPED = re.compile(r"\\([%s])" % re.escape(ESCAPABLE))
_GAP = re.compile(r"[ \t\r\n]+")
_SPACE = re.compile(f"[{WS_CLASS}]")
_NOT_IN_SLUG = re.compile(r"[^a-z0-9_\t\n\x0b\x0c\r -]")


def trim(s: str) -> str:
    return s.strip(WS)


def unescape(s: str) -> str:
    return _ESCAPED.sub(r"\1", s)


def label_key(label: str) -> str:
    return _GAP.sub(" ", trim(label)).lower()


def slug(text: str) -> str:
    if text.isascii():
        return _SPACE.sub("-", _NOT_IN_SLUG.sub("", trim(text).lower()))
    kept = (c for c in trim(text).lower() if c in "_-" or c in WS or unicodedata.category(c)[0] in "LMN")
    return _SPACE.sub("-", "".join(kept))


def safe_decode(s: str) -> str:
    """Percent-decoding; the string itself where an escape or its UTF-8 is malformed."""
    if "%" not in s:
        return s
    if re.search(r"%(?![0-9A-Fa-f]{2})", s):
        return s
    try:
        return unquote_to_bytes(s).decode("utf-8")
    except UnicodeDecodeError:
        return s


def utf16_length(s: str) -> int:
    return len(s) if s.isascii() else len(s) + sum(c > "\uffff" for c in s)


def is_space(c: str) -> bool:
    return c in WS


def is_mark(c: str) -> bool:
    """Punctuation or symbol; characters beyond the basic plane are neither, as they are looked at by halves."""
    return c <= "\uffff" and unicodedata.category(c)[0] in "PS"


# ---- columns ----------------------------------------------------------------------------------------------------------


def trim_col(c: Column) -> Column:
    return F.btrim(c, F.lit(WS))


def slug_col(c: Column) -> Column:
    kept = F.regexp_replace(F.lower(trim_col(c)), rf"[^\p{{L}}\p{{M}}\p{{N}}{WS_CLASS}_-]", "")
    return F.regexp_replace(kept, f"[{WS_CLASS}]", "-")


def label_key_col(c: Column) -> Column:
    return F.lower(F.regexp_replace(trim_col(c), r"[ \t\r\n]+", " "))


def unescape_col(c: Column) -> Column:
    return F.regexp_replace(c, r"\\([!-/:-@\[-`{-~])", "$1")


def utf16_length_col(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("long")


def safe_decode_col(c: Column) -> Column:
    """As safe_decode, from built-in functions: a plus is kept, and malformed input comes back as it is."""
    decoded = F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    bad = decoded.isNull() | (F.instr(decoded, F.lit("\ufffd")) > 0) & ~c.rlike("(?i)%EF%BF%BD")
    return F.when(F.instr(c, F.lit("%")) == 0, c).when(bad, c).otherwise(decoded)


def resolve_path_col(base_dir: Column, rel: Column) -> Column:
    """Absolute path of ``rel`` against ``base_dir``: dots resolved, an absolute ``rel`` as it is.

    Most paths have nothing to resolve but one step up; they are joined without looking at every part."""
    joined = F.when(rel.startswith("/"), rel).otherwise(F.concat_ws("/", base_dir, rel))

    def step(parts: Column, x: Column) -> Column:
        up = F.when(F.size(parts) > 0, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
        return F.when((x == "") | (x == "."), parts).when(x == "..", up).otherwise(F.concat(parts, F.array(x)))

    parts = F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(joined, "/", -1), F.expr("cast(array() as array<string>)"), step), "/"))
    plain, tidy = r"[^/.][^/]*(?:/[^/.][^/]*)*\z", base_dir.rlike(r"^(?:/[^/.][^/]*)+\z")
    above = F.concat(F.regexp_replace(base_dir, r"/[^/]*\z", ""), F.substr(rel, F.lit(3)))
    return F.when(tidy & rel.rlike(f"^{plain}"), F.concat(base_dir, F.lit("/"), rel)).when(tidy & rel.rlike(rf"^\.\./{plain}"), above).otherwise(parts)
