"""Edits: line patches, plans, the journal's states, and the cycle from proposal to files."""

from __future__ import annotations

import datetime as dt
import difflib
import hashlib
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.errors import ConflictError, NotFoundError, ValidationError

TTL_SECONDS = 3_600
# Which state may follow which.
NEXT = {"pending": {"applied", "rejected", "expired"}, "applied": {"reverted"}, "rejected": set(), "expired": set(), "reverted": set()}


def apply_patch(text: str, start: int, end: int, replacement: str) -> str:
    """Lines ``start`` to ``end`` (from 1, both included) replaced; a range outside of the text raises ValidationError."""
    lines = text.split("\n")
    if not 1 <= start <= end <= len(lines):
        raise ValidationError(f"lines {start}-{end} are outside of 1-{len(lines)}")
    return "\n".join([*lines[: start - 1], *([] if replacement == "" else replacement.split("\n")), *lines[end:]])


def patched(source: Column, start: Column, end: Column, replacement: Column) -> Column:
    """The same as a column expression; null where the range is outside of the text."""
    lines = F.split(source, "\n")
    n = F.size(lines)
    middle = F.when(replacement == "", F.array().cast("array<string>")).otherwise(F.split(replacement, "\n"))
    whole = F.concat(F.slice(lines, F.lit(1), start - 1), middle, F.slice(lines, end + 1, F.greatest(n - end, F.lit(0))))
    return F.when((start >= 1) & (start <= end) & (end <= n), F.array_join(whole, "\n"))


def unified_diff(path: str, old: str, new: str) -> str:
    return "".join(difflib.unified_diff(old.splitlines(True), new.splitlines(True), f"a/{path}", f"b/{path}"))


def transition(state: str, to: str) -> str:
    """The new state, or ConflictError where it can't follow."""
    if to not in NEXT.get(state, set()):
        raise ConflictError(f"an edit that is {state} can't become {to}")
    return to


def current_states(journal: DataFrame, hashes: DataFrame, now: Column, ttl: int = TTL_SECONDS) -> DataFrame:
    """``journal(id, state, created_at, file_id, content_hash)`` with pending edits expired: older than ``ttl`` or of files that changed."""
    there = hashes.select("file_id", F.col("content_hash").alias("_now")).dropDuplicates(["file_id"])
    old = F.unix_seconds(now) - F.unix_seconds(F.col("created_at").cast("timestamp")) > ttl
    drifted = ~F.col("content_hash").eqNullSafe(F.col("_now"))
    state = F.when((F.col("state") == "pending") & (old | drifted), "expired").otherwise(F.col("state"))
    return journal.join(there, "file_id", "left").withColumn("state", state).drop("_now").select(*journal.columns)


def _patch(text: str, params: dict) -> str:
    return apply_patch(text, params["start_line"], params["end_line"], params["replacement"])


#: Plug-ins by name: how an operation makes a file's new text out of its old one and parameters.
OPERATIONS: dict[str, Callable[[str, dict], str]] = {"apply_patch": _patch}


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def syntax_error(path: str, text: str) -> str | None:
    """The first error of a source's text, or None; files of other languages have none."""
    from thicket.parse.extract import BY_SUFFIX, Reader

    return Reader(path, text).error if path.rsplit(".", 1)[-1].lower() in BY_SUFFIX else None


def write_all(root: str, texts: dict[str, str | None]) -> None:
    """Writes all files or none: each through a file beside it; after a failure what was written is put back. None removes a file."""
    before: dict[str, str | None] = {}
    try:
        for path, text in texts.items():
            whole = os.path.join(root, path)
            if not os.path.realpath(whole).startswith(os.path.realpath(root) + os.sep):
                raise ValidationError(f"{path!r} is outside of the repository")
            before[path] = _read(whole)
            _put(whole, text)
    except BaseException:
        for path, text in before.items():
            _put(os.path.join(root, path), text)
        raise


def _read(whole: str) -> str | None:
    if not os.path.exists(whole):
        return None
    with open(whole, encoding="utf-8", newline="") as f:
        return f.read()


def _put(whole: str, text: str | None) -> None:
    if text is None:
        if os.path.exists(whole):
            os.remove(whole)
        return
    os.makedirs(os.path.dirname(whole), exist_ok=True)
    beside = f"{whole}.{uuid.uuid4().hex}"
    with open(beside, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    os.replace(beside, whole)


@dataclass
class Edit:
    """A proposed change of files with what they held."""

    id: str
    operation: str
    params: dict
    created: dt.datetime
    old: dict[str, str | None]
    new: dict[str, str | None]
    state: str = "pending"
    diagnostics: list[str] = field(default_factory=list)

    @property
    def diff(self) -> str:
        return "".join(unified_diff(p, self.old[p] or "", t or "") for p, t in self.new.items())


class Edits:
    """Proposals for one repository's working tree. An edit is written only once it is approved, while its files are as they were."""

    def __init__(self, root: str, ttl: int = TTL_SECONDS, now: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.timezone.utc)):
        self.root, self.ttl, self.now = root, ttl, now
        self.journal: dict[str, Edit] = {}

    def propose(self, operation: str, path: str, params: dict) -> Edit:
        """A pending edit with its plan; syntax errors of the new text are told, not refused."""
        if operation not in OPERATIONS:
            raise ValidationError(f"unknown operation {operation!r}")
        old = _read(os.path.join(self.root, path))
        if old is None:
            raise NotFoundError(path)
        new = OPERATIONS[operation](old, params)
        error = syntax_error(path, new)
        edit = Edit(uuid.uuid4().hex, operation, params, self.now(), {path: old}, {path: new}, diagnostics=[f"{path}: {error}"] if error else [])
        self.journal[edit.id] = edit
        return edit

    def get(self, edit_id: str) -> Edit:
        if edit_id not in self.journal:
            raise NotFoundError(edit_id)
        edit = self.journal[edit_id]
        if edit.state == "pending" and ((self.now() - edit.created).total_seconds() > self.ttl or not self._unchanged(edit.old)):
            edit.state = transition(edit.state, "expired")
        return edit

    def approve(self, edit_id: str) -> Edit:
        edit = self.get(edit_id)
        state = transition(edit.state, "applied")
        write_all(self.root, edit.new)
        edit.state = state
        return edit

    def reject(self, edit_id: str) -> Edit:
        edit = self.get(edit_id)
        edit.state = transition(edit.state, "rejected")
        return edit

    def revert(self, edit_id: str) -> Edit:
        """Puts an applied edit's files back; refused where they changed since."""
        edit = self.get(edit_id)
        state = transition(edit.state, "reverted")
        if not self._unchanged(edit.new):
            raise ConflictError(f"files of {edit_id} changed after it was applied")
        write_all(self.root, edit.old)
        edit.state = state
        return edit

    def _unchanged(self, texts: dict[str, str | None]) -> bool:
        there = {p: _read(os.path.join(self.root, p)) for p in texts}
        return all((a is None) == (b is None) and (a is None or _hash(a) == _hash(b)) for a, b in ((there[p], t) for p, t in texts.items()))
