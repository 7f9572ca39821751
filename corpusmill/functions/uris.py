"""One name per file: canonical ``file://`` URIs, and digests however they are written."""

from __future__ import annotations

import base64
import binascii
import re
import unicodedata
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names that need no work: the plain form, ASCII without escapes, fragments or empty and dotted segments.
_PLAIN = r"^file:///(?!.*(//|/\.{1,2}(/|$)))[!$&->@-\[\]^-~ ]*[!$&-.0->@-\[\]^-~]$"
_SCHEME = re.compile(r"^([A-Za-z][A-Za-z0-9+.-]+):")


def canonical_name(name: str | None) -> str | None:
    """``file://`` + absolute path, unescaped, NFC, letter case kept, no query or fragment.

    Null and blank name nothing (None). What is not a file name (another scheme, a relative
    name such as ``stdin``) stays as it is, trimmed and composed.
    """
    if name is None or not (name := name.strip()):
        return None
    scheme = _SCHEME.match(name)
    if scheme and scheme[1].lower() != "file" or not scheme and not name.startswith("/"):
        return unicodedata.normalize("NFC", name)
    path = name
    if scheme:
        path = re.split(r"[?#]", name[scheme.end() :], maxsplit=1)[0]
        if path.startswith("//"):
            host, _, rest = path[2:].partition("/")
            path = "/" + rest if host.lower() in ("", "localhost") else "/" + path[2:]
        raw = unquote_to_bytes(path)
        try:
            path = raw.decode("utf-8")
        except UnicodeDecodeError:
            pass
    out: list[str] = []
    for part in path.split("/"):
        if part == "..":
            del out[-1:]
        elif part not in ("", "."):
            out.append(part)
    return unicodedata.normalize("NFC", "file:///" + "/".join(out)).rstrip() if out else None


@F.pandas_udf(T.StringType())
def _canonical(names: pd.Series) -> pd.Series:
    return names.map(canonical_name, na_action="ignore")


def file_name(col: Column) -> Column:
    """Canonical name of the file; null where none is named. Plain names never reach Python."""
    plain = F.coalesce(col.rlike(_PLAIN), F.lit(True))
    return F.when(plain, col).otherwise(_canonical(F.when(~plain, col)))


def digest_text(text: str | None) -> str | None:
    """The bytes of a ``sha256-<base64>`` digest as hex; None if it is none."""
    if text is None:
        return None
    body = text.strip()[7:]
    try:
        raw = base64.b64decode(body + "=" * (-len(body) % 4), altchars=b"-_" if set(body) & set("-_") else None)
    except (binascii.Error, ValueError):
        return None
    return raw.hex() or None


@F.pandas_udf(T.StringType())
def _from_base64(texts: pd.Series) -> pd.Series:
    return texts.map(digest_text, na_action="ignore")


def digest(col: Column) -> Column:
    """Lower-case hex of a digest written as hex or base64, with or without an algorithm's name.

    Blank means unknown (null). Anything that is no digest is compared as trimmed text.
    """
    trimmed = F.regexp_replace(col, r"^\s+|\s+$", "")
    hexed = F.lower(F.regexp_replace(trimmed, r"(?i)^sha-?256\s*[:=]\s*|^sha-?256-(?=[0-9a-f]{64}$)|^0x", ""))
    coded = trimmed.rlike(r"(?i)^sha-?256[-:=]") & ~hexed.rlike("^[0-9a-f]{64}$")
    bare = F.regexp_replace(trimmed, r"(?i)^sha-?256[-:=]\s*", "sha256-")
    return F.when(trimmed == "", None).when(coded, F.coalesce(_from_base64(F.when(coded, bare)), trimmed)).otherwise(hexed)


def basename(uri: Column) -> Column:
    return F.regexp_extract(uri, r"([^/]*)$", 1)


def parent(uri: Column) -> Column:
    """The folder of a name; the name itself where it has none."""
    return F.when(uri.rlike(r"^.+/[^/]+$"), F.regexp_extract(uri, r"^(.+)/[^/]+$", 1)).otherwise(uri)
