"""Problem 8: the subjects that a text treats."""

from __future__ import annotations

import functools
import marshal
import math
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.subject_terms import TERMS
from thicket.session import cut_lineage, spread

#: Score of a window of WINDOW units from which on it treats a subject, where the labels don't tell better, and the number of units that
#: must carry it. Windows of one length make scores comparable, however long a text is: one passing sentence scores at most 1.
THRESHOLD, LEAST_UNITS, WINDOW = 1.7, 2, 8
#: Thresholds are calibrated within this reach of THRESHOLD on all labelled documents. One step of the calibration away from THRESHOLD
#: must save so many errors, a second one three times as many, and so on.
REACH, STEP, STIFFNESS = 0.4, 0.1, 1.0
STEPS = range(-round(REACH / STEP), round(REACH / STEP) + 1)
#: Units without a subject's term that a passage may hold between two that have one.
GAP = 2
#: Weight of a term that only supports, and of any term in a line of code without prose.
SUPPORT, CODE = 0.4, 0.6
#: Weight of two supporting terms together, where no other subject has both.
PAIR = 0.8
#: What marks a remark in passing; such a unit counts half.
ASIDE = 0.5
ASIDE_MARK = -1
_ASIDE = """by the way, incidentally, in passing, as an aside, on a side note, speaking of which, a kind of, a sort of, not to be confused, nebenbei, übrigens, apropos,
    eine art, nicht zu verwechseln, nicht verwechseln, au passage, soit dit en passant, une sorte de, une espèce de, ne pas confondre, por cierto, de paso,
    una especie de, no confundir"""

_TAG = re.compile(r"</?(?:p|h\d|li|ul|ol|div|footer|br|body|html|td|tr|table|title|head)[^>]*>", re.I)
_OTHER_TAG = re.compile(r"</?[a-z][^<>]{0,80}>", re.I)
_PATH = re.compile(r"(?:https?://\S+)|(?:\b[\w.@-]+/)+[\w.@:-]*\w|\S+\.(?:tsx?|jsx?|mjs|mts|json|md|css|py|sql|ya?ml)\b(?::\d+)?")
_SUFFIX = re.compile(r"\.(?:tsx?|jsx?|mjs|mts|json|md|css|py|sql|ya?ml)\b")
_HIDDEN = re.compile("[\xad\u200b-\u200d\u2060\ufeff]")
_ODD_SPACE = re.compile("[\t\x0b\x0c\x1c-\x1f\x85\u1680\u2028\u2029]")
_SENTENCE = re.compile(r"(?<=[.!?。！？;])[\"'”’)\]]*\s+(?=\S)")
_CODE = re.compile(r"^\s*(?:(?:export|import|const|let|var|return|function|if|for|while|class|async|await)\b.*[;{(=]|[\w.]+\(.*\);?$|[\w.$]+ *[=:] .*[;,{]$|[{}()\[\];]+$)")
_CAMEL = re.compile(r"(?<=[a-zà-ÿ0-9])(?=[A-ZÀ-Þ])|[_$.]")
_COMMENT = re.compile(r"//\s?(.*)$|^\s*/?\*+\s?(.*?)(?:\*/)?\s*$|/\*+(.*?)\*/|^\s*#\s(.*)$|^\s*--\s(.*)$")
_ROLE = re.compile(r"^\s*[\w.-]{2,20}: (?=\S)")
_SPACES = re.compile(r"\s+")


def _variants(term: str) -> set[str]:
    forms = {term, term + "s", term + "es"}
    if term.endswith("y"):
        forms.add(term[:-1] + "ies")
    return forms


def described(subjects: Iterable[tuple[str, str | None]]) -> tuple[tuple[str, str], ...]:
    """Terms for listed subjects that the curated vocabulary lacks: their own name is strong, the words of their description support it."""
    out = []
    for name, text in sorted({(n, d) for n, d in subjects if n and n not in TERMS}, key=str):
        words = [w for w in re.findall(r"[^\W\d_]{4,}", (text or "").lower()) if w not in ("their", "that", "with", "from", "other")]
        out.append((name, f"{name} ~ {', '.join(words)}"))
    return tuple(out)


@functools.cache
def automaton(extra: tuple[tuple[str, str], ...] = ()):
    """(automaton, terms): each form of a term with the index of its term; a term is [(subject, strong), ...]."""
    import ahocorasick

    owners: dict[str, dict[str, bool]] = {}
    for subject, block in [*TERMS.items(), *extra]:
        strong, _, weak = block.partition("~")
        for part, own in ((strong, True), (weak, False)):
            for line in part.split("\n"):
                for term in filter(None, (t.strip() for t in line.split(","))):
                    owners.setdefault(term, {})[subject] = own and owners.get(term, {}).get(subject, True)
    # A term that is strong for several subjects only supports each of them.
    terms = []
    forms: dict[str, int] = {}
    ordered = sorted(owners.items(), key=lambda x: (-len(x[0]), x[0]))
    for k, (term, held) in enumerate(ordered):
        alone = len(held) == 1
        terms.append([(s, own and alone) for s, own in held.items()])
        for form in _variants(term):
            forms.setdefault(form, k)
    for k, (term, _) in enumerate(ordered):
        forms[term] = k
    found = ahocorasick.Automaton()
    for form, k in forms.items():
        found.add_word(form, (k, len(form)))
    for mark in _ASIDE.split(","):
        found.add_word(" ".join(mark.split()), (ASIDE_MARK, len(" ".join(mark.split()))))
    found.make_automaton()
    return found, terms


def _comment(line: str, stripped: str) -> re.Match[str] | None:
    return _COMMENT.search(line) if stripped[0] in "#-*/" or "//" in line or "/*" in line else None


def units(text: str) -> list[list[tuple[str, bool]]]:
    """Passages of units (text, whether it is code): sentences, entries and lines; blank lines, tags and headings part passages."""
    text = unicodedata.normalize("NFKC", text).replace("\r\n", "\n").replace("\r", "\n")
    text = _ODD_SPACE.sub(" ", _HIDDEN.sub("", text))
    if "/" in text or _SUFFIX.search(text):
        text = "\n".join(_PATH.sub(" ", line) if "/" in line or _SUFFIX.search(line) else line for line in text.split("\n"))
    if "<" in text:
        text = _OTHER_TAG.sub(" ", _TAG.sub("\n\n", text))
    passages: list[list[tuple[str, bool]]] = []
    held: list[tuple[str, bool]] = []

    def close() -> None:
        nonlocal held
        if held:
            passages.append(held)
        held = []

    prose: list[str] = []

    def flush() -> None:
        if prose:
            held.extend((s, False) for s in _SENTENCE.split(" ".join(prose)) if s.strip())
            prose.clear()

    for line in text.split("\n"):
        stripped = line.strip()
        if not stripped:
            flush()
            close()
        elif _CODE.match(line) or (m := _comment(line, stripped)) and not re.match(r"\s*(?:#{1,6} |\*\*?\w|\* )", line):
            flush()
            m = _comment(line, stripped)
            said = next((g for g in m.groups() if g), "") if m else ""
            code = line[: m.start()] if m else line
            if said.strip():
                held.extend((s, False) for s in _SENTENCE.split(said) if s.strip())
            if code.strip():
                held.append((_CAMEL.sub(" ", code), True))
        elif re.match(r"(?:#{1,6} |=+$|-{3,}$|\*{3,}$)", stripped):
            flush()
            close()
        elif re.match(r"(?:[-*+•] |\d+[.)] |\||>)", stripped) or _ROLE.match(line):
            flush()
            entry = _ROLE.sub("", stripped.strip("|> -*+•")).replace("|", " ")
            held.extend((s, False) for s in _SENTENCE.split(entry) if s.strip())
        else:
            prose.append(stripped)
    flush()
    close()
    return passages


def matches(unit: str, extra: tuple[tuple[str, str], ...] = ()) -> list[int]:
    """Indices of the longest terms at word boundaries, from left to right; first ``ASIDE_MARK`` where a remark in passing is marked."""
    found, _ = automaton(extra)
    low = unit.lower()
    if "’" in low:
        low = low.replace("’", "'")
    if "  " in low:
        low = _SPACES.sub(" ", low)
    hits = []
    last = len(low) - 1
    out: list[int] = []
    for end, (k, n) in found.iter(low):
        start = end - n + 1
        if start and low[start - 1].isalnum() or end < last and low[end + 1].isalnum():
            continue
        if k < 0:
            out = [ASIDE_MARK]
        else:
            hits.append((start, -n, k))
    if len(hits) < 2:
        return out + [h[2] for h in hits]
    hits.sort()
    upto = -1
    for start, n, k in hits:
        if start > upto:
            out.append(k)
            upto = start - n - 1
    return out


Passages = list[list[tuple[int, float, list[int]]]]


def passages_of(text: str, extra: tuple[tuple[str, str], ...] = ()) -> Passages:
    """(place, weight, terms) of each unit with terms, by passage."""
    out = []
    for passage in units(text):
        row = []
        for i, (unit, code) in enumerate(passage):
            found = matches(unit, extra)
            aside = bool(found) and found[0] == ASIDE_MARK
            if len(found) > aside:
                row.append((i, CODE if code else ASIDE if aside else 1.0, sorted(set(found[aside:]))))
        if row:
            out.append(row)
    return out


def scores_of(passages: Passages, rarity: dict[int, float] | None = None, extra: tuple[tuple[str, str], ...] = ()) -> dict[str, tuple[float, int]]:
    """(score, units) of the best window by subject.

    A unit gives a subject the weight of its best strong term by its rarity, or a bit for terms that only support. The score is the
    sum over ``WINDOW`` units in a row, the same for texts of any length, in which at most ``GAP`` units without the subject lie between
    two with it; no window passes over the end of a passage. Text outside of the window doesn't matter.
    """
    _, terms = automaton(extra)
    weights = (rarity or {}).get
    best: dict[str, tuple[float, int]] = {}
    for passage in passages:
        runs: dict[str, list[tuple[int, float, int]]] = {}
        for i, weight, found in passage:
            strong: dict[str, float] = {}
            weak: dict[str, float] = {}
            shared: dict[str, int] = {}
            for k in found:
                w = weights(k, 1.0) * weight
                for subject, own in terms[k]:
                    shared[subject] = shared.get(subject, 0) + 1
                    if own:
                        if w > strong.get(subject, 0.0):
                            strong[subject] = w
                    elif w * SUPPORT > weak.get(subject, 0.0):
                        weak[subject] = w * SUPPORT
            # Two ambiguous terms in one unit that only one subject explains together show it.
            if len(found) > 1:
                most = max(shared.values())
                leading = [subject for subject, n in shared.items() if n == most]
                if most > 1 and len(leading) == 1:
                    strong.setdefault(leading[0], PAIR * weight)
            for subject in shared:
                run = runs.setdefault(subject, [])
                if run and i - run[-1][0] > GAP + 1:
                    run.clear()
                while run and i - run[0][0] >= WINDOW:
                    del run[0]
                run.append((i, strong[subject], 1) if subject in strong else (i, weak[subject], 0))
                now = (sum(x[1] for x in run), sum(x[2] for x in run))
                if now > best.get(subject, (0.0, 0)):
                    best[subject] = now
    return best


def subject_scores(text: str, rarity: dict[int, float] | None = None) -> dict[str, tuple[float, int]]:
    """(score, units) of the best window of a text by subject."""
    return scores_of(passages_of(text), rarity)


def match_terms(documents: DataFrame, extra: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """(doc_id, found, terms): what was found in each text by passage, and its distinct terms; texts are read this once.

    Null and empty texts, and those without terms, give no row. It is written to the shared folder: a few bytes for each unit with a term.
    """

    def matched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                passages = passages_of(text, extra)
                if passages:
                    out.append((doc, marshal.dumps(passages), sorted({k for p in passages for _, _, found in p for k in found})))
            yield pd.DataFrame(out, columns=["doc_id", "found", "terms"])

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("doc_id is not null and text is not null and text <> ''")
    return cut_lineage(spread(rows).mapInPandas(matched, "doc_id bigint, found binary, terms array<int>"))


def term_rarity(matched: DataFrame, extra: tuple[tuple[str, str], ...] = ()) -> dict[int, float]:
    """Weight of each term by its share of documents: 1 at the median share, between 0.75 and 1.25, over all documents.

    What reaches the driver is one count for each term of the curated list, whatever the number of documents.
    """
    _, terms = automaton(extra)
    counted = matched.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    counts = {r["term"]: r["n"] for r in counted.collect()} if terms else {}
    if not counts:
        return {}
    middle = sorted(counts.values())[len(counts) // 2]
    return {k: min(1.25, max(0.75, 1 + 0.1 * math.log(middle / n))) for k, n in counts.items()}


def _score_rows(matched: DataFrame, rarity: dict[int, float], extra: tuple[tuple[str, str], ...]) -> DataFrame:
    """(doc_id, subject, score, units) of all subjects with any evidence."""

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, found in zip(batch["doc_id"], batch["found"]):
                out += [(doc, subject, score, n) for subject, (score, n) in scores_of(marshal.loads(found), rarity, extra).items()]
            yield pd.DataFrame(out, columns=["doc_id", "subject", "score", "units"])

    return matched.select("doc_id", "found").mapInPandas(scored, "doc_id bigint, subject string, score double, units int")


def thresholds_of(scores: Iterable[tuple[int, str, float]], labels: Iterable[tuple[int, str]]) -> dict[str, float]:
    """For each subject the threshold with the fewest errors against the labels, drawn to ``THRESHOLD`` as labels may be wrong or missing.

    ``scores`` are (document, subject, score) of subjects with enough units, ``labels`` (document, subject); documents without label don't count.
    """
    said: dict[str, set[int]] = {}
    for doc, subject in labels:
        said.setdefault(subject, set()).add(doc)
    labelled = set().union(*said.values()) if said else set()
    seen: dict[str, dict[int, float]] = {}
    for doc, subject, score in scores:
        if doc in labelled:
            own = seen.setdefault(subject, {})
            own[doc] = max(score, own.get(doc, 0.0))
    out = {}
    for subject, docs in said.items():
        own = seen.get(subject, {})
        out[subject] = _threshold([len({doc for doc, score in own.items() if score >= THRESHOLD + k * STEP - 1e-9} ^ docs) for k in STEPS])
    return out


def _threshold(errors: Iterable[int]) -> float:
    """The threshold of the step with the fewest errors, those of ``STEPS`` in order."""
    return THRESHOLD + min(zip(errors, STEPS), key=lambda x: (x[0] + STIFFNESS * x[1] * x[1], abs(x[1]), x[1]))[1] * STEP


def calibrated(scores: DataFrame, labels: DataFrame) -> dict[str, float]:
    """Thresholds as ``thresholds_of`` has them, by all labels. ``scores`` are (doc_id, subject, score); only the errors of each step are collected, a row a subject."""
    said = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lower(F.trim("subject")).alias("subject")).filter("doc_id is not null and subject is not null").distinct()
    own = scores.join(said.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id", "subject").agg(F.max("score").alias("score"))
    both = own.join(said.withColumn("said", F.lit(True)), ["doc_id", "subject"], "full")
    found = [F.coalesce(F.col("score") >= THRESHOLD + k * STEP - 1e-9, F.lit(False)) for k in STEPS]
    is_said = F.coalesce("said", F.lit(False))
    errors = both.groupBy("subject").agg(F.array(*[F.count_if(f != is_said) for f in found]).alias("errors"), F.count("said").alias("n"))
    return {r["subject"]: _threshold(r["errors"]) for r in errors.filter("n > 0").collect()}


def listed(subjects: DataFrame | None) -> tuple[tuple[str, str], ...]:
    """Terms of listed subjects that the vocabulary lacks. The list is what people wrote, as small as the vocabulary that it stands for."""
    if subjects is None:
        return ()
    return described((r[0], r[1]) for r in subjects.select(F.lower(F.trim("subject")), "description").filter("subject is not null").distinct().collect())


def assign_matched(matched: DataFrame, labels: DataFrame | None = None, extra: tuple[tuple[str, str], ...] = (), least_units: int = LEAST_UNITS) -> DataFrame:
    """(doc_id, subject, score) by what was found in the texts."""
    rarity = term_rarity(matched, extra)
    rows = _score_rows(matched, rarity, extra).filter(F.col("units") >= least_units)
    limits = {}
    if labels is not None:
        # Read twice: a short row for each document and subject with evidence.
        rows = cut_lineage(rows)
        limits = calibrated(rows, labels)
    limit = reduce(lambda c, x: F.when(F.col("subject") == x[0], x[1]).otherwise(c), sorted(limits.items()), F.lit(THRESHOLD))
    return rows.filter(F.col("score") >= limit - 1e-9).groupBy("doc_id", "subject").agg(F.max("score").alias("score"))


def assign_subjects(documents: DataFrame, labels: DataFrame | None = None, subjects: DataFrame | None = None) -> DataFrame:
    """(doc_id, subject, score): each subject that a passage of a document's text treats; a document may have none.

    ``labels`` (doc_id, subject) calibrate the thresholds, ``subjects`` (subject, description) name what is looked for; a subject unknown to the
    curated vocabulary is found by its name and description. Null, empty and blank texts have no subject. Texts of any length
    are read as a whole, extra columns are ignored, and rows that repeat a doc_id give each subject once with its best score. Without
    labels, and for subjects without label, ``THRESHOLD`` holds. Texts are read once and aren't shuffled; what reaches the driver is one
    count a term and the errors of each threshold.
    """
    extra = listed(subjects)
    return assign_matched(match_terms(documents, extra), labels, extra)


def subject_shares(assigned: DataFrame, documents: DataFrame) -> DataFrame:
    """(subject, documents, share): how many documents treat each subject, and their share of all documents."""
    return assigned.groupBy("subject").agg(F.countDistinct("doc_id").alias("documents")).crossJoin(
        F.broadcast(documents.agg(F.count("*").alias("total")))
    ).select("subject", "documents", (F.col("documents") / F.col("total")).alias("share"))
