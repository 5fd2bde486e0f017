"""The identifier codec: ``repo:path``, ``repo:path#qualified`` and ``repo:path#qualified~N``."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from thicket.errors import ValidationError

# What each part of an id may look like.
REPO = r"^[A-Za-z0-9][A-Za-z0-9._-]*$"
PATH = r"^[^#:\\~/][^#:\\~]*$"
QUALIFIED = r"^[^#:~]+$"


def content_hash(text: Column) -> Column:
    """First 16 hex digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def point_id(text: Column) -> Column:
    """SHA-1 in the shape of a UUID."""
    h = F.sha1(text)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def file_id(repo: Column, path: Column) -> Column:
    """``repo:path``, or null where a part isn't allowed."""
    return F.when(repo.rlike(REPO) & path.rlike(PATH), F.concat(repo, F.lit(":"), path))


def symbol_id(repo: Column, path: Column, qualified: Column) -> Column:
    return F.when(qualified.rlike(QUALIFIED), F.concat(file_id(repo, path), F.lit("#"), qualified))


def repo_of(any_id: Column) -> Column:
    return F.substring_index(any_id, ":", 1)


def file_of(any_id: Column) -> Column:
    """The file's id within a symbol's or chunk's; symbol ids split at the first '#'."""
    return F.substring_index(any_id, "#", 1)


def path_of(any_id: Column) -> Column:
    return F.regexp_extract(file_of(any_id), "^[^:]*:(.*)$", 1)


def symbol_of(chunk_id: Column) -> Column:
    """A chunk's symbol: the id up to the last '~' before digits."""
    return F.regexp_replace(chunk_id, r"~\d+$", "")


def part_of(chunk_id: Column) -> Column:
    """A chunk's part, null where the symbol is whole."""
    return F.nullif(F.regexp_extract(chunk_id, r"~(\d+)$", 1), F.lit("")).cast("int")


def qualified_of(any_id: Column) -> Column:
    return F.nullif(F.regexp_extract(symbol_of(any_id), "^[^#]*#(.*)$", 1), F.lit(""))


def format_symbol_id(repo: str, path: str, qualified: str) -> str:
    """The same on the driver; raises ValidationError."""
    for value, pattern, what in ((repo, REPO, "repository"), (path, PATH, "path"), (qualified, QUALIFIED, "qualified name")):
        if not re.match(pattern, value):
            raise ValidationError(f"invalid {what}: {value!r}")
    return f"{repo}:{path}#{qualified}"


def parse_symbol_id(text: str) -> tuple[str, str, str]:
    head, sign, qualified = text.partition("#")
    repo, colon, path = head.partition(":")
    if not sign or not colon or format_symbol_id(repo, path, qualified) != text:
        raise ValidationError(f"not a symbol id: {text!r}")
    return repo, path, qualified


def format_chunk_id(symbol: str, part: int | None = None) -> str:
    if part is not None and part < 0:
        raise ValidationError(f"invalid part: {part}")
    return symbol if part is None else f"{symbol}~{part}"


def parse_chunk_id(text: str) -> tuple[str, int | None]:
    symbol, sign, part = text.rpartition("~")
    if not sign:
        return text, None
    if not part.isdigit():
        raise ValidationError(f"not a chunk id: {text!r}")
    return symbol, int(part)
