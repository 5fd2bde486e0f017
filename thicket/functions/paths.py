"""Path functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def dirname(path: Column) -> Column:
    """The folder, '' at the root."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def ancestor_dirs(path: Column) -> Column:
    """All folders above a path, the nearest last."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) < 2, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    )


def normalized(path: Column) -> Column:
    """A relative path without './' and with each 'x/..' resolved; what climbs beyond the root keeps its '..'."""
    empty = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        climbs = (part == "..") & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")) != "..")
        return F.when(part.isin("", "."), done).when(climbs, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(
            F.concat(done, F.array(part))
        )

    return F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/")


def glob_pattern(glob: str) -> str:
    """A regular expression of the whole path for ``*``, ``**``, ``?``, ``{a,b}`` and ``[...]``; dot files match as others."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out += "(?:.*/)?"
            i += 3
            continue
        if glob.startswith("/**", i) and i + 3 == len(glob):
            out += "(?:/.*)?"
            i += 3
            continue
        if glob.startswith("**", i):
            out += ".*"
            i += 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "{":
            out += "(?:"
            depth += 1
        elif c == "}" and depth:
            out += ")"
            depth -= 1
        elif c == "," and depth:
            out += "|"
        elif c == "[":
            end = glob.find("]", i + 1)
            if end > 0:
                inner = glob[i + 1 : end]
                out += "[" + ("^" + inner[1:] if inner[:1] == "!" else inner) + "]"
                i = end
            else:
                out += r"\["
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"
