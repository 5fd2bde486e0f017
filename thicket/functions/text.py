"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with marks and their plain forms, for folding as full-text indexes do.
MARKED = "áàâäãåāăąçćčďéèêëēėęěíìîïīįñńňóòôöõøōőřśšșťțúùûüūůűýÿźżž"
PLAIN = "aaaaaaaaacccdeeeeeeeeiiiiiinnnoooooooorsssttuuuuuuuyyzzz"


def fold(text: Column) -> Column:
    """Lower case without marks."""
    return F.translate(F.lower(text), MARKED, PLAIN)


def index_tokens(text: Column) -> Column:
    """Tokens of the full-text index: runs of letters, digits, '_' and '$', folded.

    Marks are looked up only in the tokens that aren't plain ASCII, which are few.
    """
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_$\p{L}\p{N}]+"), F.lit(0))
    return F.transform(tokens, lambda t: F.when(t.rlike(r"[^\x00-\x7F]"), F.translate(t, MARKED, PLAIN)).otherwise(t))


def split_identifiers(text: Column) -> Column:
    """Words and the parts of camel- and snake-case words, lower-cased, each once in order of appearance; parts of one letter don't count."""
    words = F.regexp_extract_all(text, F.lit(r"[A-Za-z$_][A-Za-z0-9$_]*"), F.lit(0))

    def parts(word: Column) -> Column:
        spaced = F.regexp_replace(F.regexp_replace(word, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
        split = F.split(F.regexp_replace(spaced, r"[_$ ]+", " "), " ")
        return F.concat(F.array(F.lower(word)), F.transform(F.filter(split, lambda p: F.length(p) > 1), lambda p: F.lower(p)))

    return F.array_distinct(F.flatten(F.transform(words, parts)))


def embed_tokens(text: Column) -> Column:
    """Tokens of the hash embedder and the overlap reranker."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z$_][a-z0-9$_]*"), F.lit(0))


def estimated_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4)


def snippet(content: Column, lines: int = 4) -> Column:
    """The first lines that aren't header comments, trimmed."""
    kept = F.filter(F.split(content, "\n"), lambda x: ~x.startswith("// "))
    return F.trim(F.array_join(F.slice(kept, 1, lines), "\n"))
