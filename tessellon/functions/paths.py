"""Paths as columns: names, parts, placeholders, destinations."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessellon.functions import bases


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def directory_name(path: Column) -> Column:
    """All before the last slash, or nothing."""
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise("")


def extension(path: Column) -> Column:
    """From the last dot of the name on; a lone dot is no extension."""
    name = file_name(path)
    return F.when(name == ".", "").otherwise(F.regexp_extract(name, r"\.[^.]*$", 0))


def stem(path: Column) -> Column:
    name = file_name(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(extension(path)))


def full_path(path: str, cwd: str | None = None) -> str:
    """Absolute, with . and .. folded."""
    return os.path.normpath(os.path.join(cwd or os.getcwd(), path))


# The patterns of placeholders.
_PLACEHOLDER = re.compile(r"\$\{([A-Za-z0-9.-]+)\}")
_HASH = re.compile(r"(?i)^Hash-(.+)-(2|4|8|10|16|32|32Hex|32Z|36|62|64)-(UC|LC|OC)$")
_HASH_STRICT = re.compile(r"^Hash-([^-]+)-(\d+|32Hex|32Z)-(UC|LC|OC)$")


def hash_token(token: str, hashes: dict[str, Column], strict: bool = False) -> Column | None:
    """Hash-<name>-<base>-<UC|LC|OC>: a digest's digits in upper, lower or their own case. strict: no hyphen in a name."""
    m = (_HASH_STRICT if strict else _HASH).match(token)
    if not m or m[2] not in bases.ALPHABETS:
        return None
    found = next((c for n, c in hashes.items() if n.lower() == m[1].lower()), None)
    if found is None:
        return None
    text = bases.bytes_in_base(found, m[2])
    return {"UC": F.upper(text), "LC": F.lower(text)}.get(m[3].upper(), text)


def file_tokens(path: Column, length: Column | None = None) -> dict[str, Column]:
    """The columns that placeholders about a file stand for."""
    out = {"FullName": path, "FileName": file_name(path), "FileExtension": extension(path), "FileNameWithoutExtension": stem(path), "DirectoryName": directory_name(path)}
    return out | ({"FileSize": length.cast("string")} if length is not None else {})


def expand(pattern: str, tokens: dict[str, Column], hashes: dict[str, Column] | None = None, strict: bool = False) -> Column:
    """pattern with ${Token} replaced by columns; unknown tokens are empty. Split once, on the driver."""
    parts, at = [], 0
    for m in _PLACEHOLDER.finditer(pattern):
        if m.start() > at:
            parts.append(F.lit(pattern[at : m.start()]))
        value = tokens.get(m[1])
        if value is None and m[1].startswith("SuggestedExtension"):
            value = tokens.get("SuggestedExtension")
        if value is None:
            value = hash_token(m[1], hashes or {}, strict)
        parts.append(F.lit("") if value is None else F.coalesce(value, F.lit("")))
        at = m.end()
    parts.append(F.lit(pattern[at:]))
    return F.concat(*parts)


def destination(path: Column, expanded: Column, replacements: list[tuple[str, str]] = (), keep_directory: bool = False, keep_name: bool = False) -> Column:
    """Where a file goes: literal replacements in order, then the old directory or name where moves or renames are off."""
    out = expanded
    for old, new in replacements:
        out = F.replace(out, F.lit(old), F.lit(new))
    folder = directory_name(path) if keep_directory else directory_name(out)
    name = file_name(path) if keep_name else file_name(out)
    return F.when(folder == "", name).otherwise(F.concat(folder, F.lit("/"), name)) if keep_directory or keep_name else out


def moves(path: Column, to: Column) -> Column:
    """Whether a file is to be moved at all."""
    return (to != "") & (to != path)
