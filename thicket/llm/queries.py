"""The queries pN_... and their SQL, as far as SQL expresses them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm import conversations as talk
from thicket.llm import docpairs, faults, mixing, provenance, splitting, subjects, tokens
from thicket.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    verdict = talk.judge_sessions(table(spark, folder, "chat_messages"), table(spark, folder, "chat_sessions"))
    return verdict.filter("not kept").select("session_id")


def p1_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return talk.conversations(table(spark, folder, "chat_messages"))


def p2_flags(spark: SparkSession, folder: str) -> DataFrame:
    return faults.parse_flags(table(spark, folder, "files"), table(spark, folder, "file_sources"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_flags(spark, folder).filter("not valid").select("file_id")


def p2_rates(spark: SparkSession, folder: str) -> DataFrame:
    return faults.fault_rates(p2_flags(spark, folder))


def p3_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return provenance.machine_made(table(spark, folder, "files"), table(spark, folder, "file_sources"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_reasons(spark, folder).select("file_id")


def p4_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs for training: without descriptions that more than one in 200 documented functions have."""
    return docpairs.documented_functions(table(spark, folder, "symbols"), table(spark, folder, "chunks"), most_share=0.005)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return docpairs.documented_functions(table(spark, folder, "symbols"), table(spark, folder, "chunks"), with_code=False).select("symbol_id")


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_oversized(table(spark, folder, "chunks"), table(spark, folder, "symbols"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_pieces(spark, folder).filter("piece = 0").select("chunk_id").distinct()


def p5_whole(spark: SparkSession, folder: str) -> DataFrame:
    """Of each oversized chunk the hash of its pieces put together again, and whether they keep to limit and overlap."""
    pieces = p5_pieces(spark, folder)
    # A chunk's own pieces, as long together as the chunk that a row held.
    held = pieces.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("piece", "start", "content"))).alias("p"))
    size, joint = splitting.LIMIT, splitting.OVERLAP
    rest = F.transform("p", lambda x: F.when(x["piece"] == 0, x["content"]).otherwise(x["content"].substr(joint + 1, size)))
    begins = F.forall(
        F.sequence(F.lit(1), F.greatest(F.size("p") - 1, F.lit(1))),
        lambda k: F.get("p", k).isNull() | (F.left(F.get("p", k)["content"], F.lit(joint)) == F.right(F.get("p", k - 1)["content"], F.lit(joint))),
    )
    small = F.forall("p", lambda x: F.length(x["content"]) <= size)
    return held.select("chunk_id", F.left(F.sha2(F.array_join(rest, ""), 256), F.lit(16)).alias("hash"), (begins & small).alias("sound"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_ids(table(spark, folder, "documents"))


def p6_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Of each document the hash of the text that its ids stand for."""
    return tokens.decoded(p6_ids(spark, folder)).select("doc_id", F.left(F.sha2("text", 256), F.lit(16)).alias("hash"))


def _mixture(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mixture, measured documents, targets)."""
    targets = table(spark, folder, "mix_targets")
    measured = mixing.measure(table(spark, folder, "documents"), table(spark, folder, "subject_labels"), table(spark, folder, "subjects"))
    return mixing.plan_mixture(measured, targets), measured, targets


def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder)[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    mixture, _, targets = _mixture(spark, folder)
    return mixing.reached_shares(mixture, targets)


def p7_reached(spark: SparkSession, folder: str) -> DataFrame:
    """Of each source with a target: whether its share is within 0.02 of what is due to it and no document is used too often."""
    shares = p7_shares(spark, folder).filter("target_share > 0")
    # One row: the shares of the targets that have documents.
    due = shares.filter("documents > 0").agg(F.sum("target_share").alias("met"))
    goal = F.when(F.col("documents") > 0, F.col("target_share") / F.col("met")).otherwise(0.0)
    near = F.abs(F.col("actual_share") - goal) <= 0.02
    return shares.crossJoin(F.broadcast(due)).select("source", (near & (F.col("most_repeats") <= F.coalesce("max_repeats", F.lit(1)))).alias("reached"))


def p7_marginals(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.reached_marginals(*_mixture(spark, folder))


def p8_subjects(spark: SparkSession, folder: str) -> DataFrame:
    """Subjects spelt as in the table ``subjects``; a subject that it lacks isn't reported."""
    wanted = table(spark, folder, "subjects")
    spelt = wanted.select(F.col("subject").alias("spelt"), F.lower(F.trim("subject")).alias("subject")).distinct()
    found = subjects.assign_subjects(table(spark, folder, "documents"), table(spark, folder, "subject_labels"), wanted)
    # The table of subjects is fixed and small; a broadcast is left to the session's size threshold.
    return found.join(spelt, "subject").select("doc_id", F.col("spelt").alias("subject"), "score")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_subjects(spark, folder).select("doc_id", "subject")


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return subjects.subject_shares(p8_subjects(spark, folder), table(spark, folder, "documents"))


QUERIES = {
    f.__name__: f for f in (p1_found, p1_conversations, p2_found, p2_flags, p2_rates, p3_found, p3_reasons, p4_found, p4_pairs, p5_found, p5_pieces, p5_whole, p6_ids, p6_texts, p7_mixture, p7_shares, p7_reached, p7_marginals, p8_found, p8_subjects, p8_shares)
}



def _in(names: list[str]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _re(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_SAID = f"regexp_replace(content, {_re(talk.AROUND)}, '', 'g')"
_TURNS = f"""m AS (SELECT DISTINCT id, session_id, role, content, citations_json, created_at AS moment FROM chat_messages WHERE session_id IS NOT NULL),
s AS (SELECT *, lower(trim(regexp_replace(role, '[\\s\\p{{Z}}\\p{{Cf}}]+', ' ', 'g'))) AS speaker, content IS NOT NULL AND NOT regexp_matches(content, {_re(talk.BLANK)}) AS is_full,
    coalesce((regexp_matches(lower({_SAID}), {_re(talk.FAILED)}) OR regexp_matches({_SAID}, {_re(talk.ERROR_CODE)})) AND NOT regexp_matches(content, {_re(talk.CITED)}), false) AS failed FROM m),
t AS (SELECT session_id, moment, is_full, CASE WHEN speaker IN {_in(talk.ASKING)} THEN 'q' WHEN speaker IN {_in(talk.REPLYING)} THEN CASE WHEN failed THEN 'x' ELSE 'r' END WHEN speaker IN {_in(talk.BESIDE)} THEN 'x' END AS who FROM s),
o AS (SELECT session_id, who, lead(who) OVER w AS next, lag(who) OVER w AS prior FROM t WHERE who IN ('q', 'r') WINDOW w AS (PARTITION BY session_id ORDER BY moment, who))"""

SQL = {
    "p1_found": f"""WITH {_TURNS} SELECT session_id FROM (SELECT id AS session_id FROM chat_sessions WHERE id IS NOT NULL UNION SELECT session_id FROM m) WHERE session_id NOT IN (SELECT session_id FROM o WHERE who = 'q')
OR session_id IN (SELECT session_id FROM t WHERE moment IS NULL OR who IS NULL OR (who IN ('q', 'r') AND NOT is_full)) OR session_id IN (SELECT session_id FROM o WHERE (who = 'r' AND prior IS NULL) OR (who = 'q' AND (next IS NULL OR next = 'q')))""",
    "p7_reached": "SELECT DISTINCT regexp_replace(lower(trim(source)), '[\\s_-]+', '-', 'g') AS source, true AS reached FROM mix_targets WHERE source IS NOT NULL AND target_share > 0",
    "p5_whole": "SELECT DISTINCT id AS chunk_id, substr(sha256(content), 1, 16) AS hash, true AS sound FROM chunks WHERE length(content) > 4000",
    "p6_texts": "SELECT doc_id, substr(sha256(coalesce(text, '')), 1, 16) AS hash FROM documents",
    "p5_found": "SELECT DISTINCT id AS chunk_id FROM chunks WHERE length(content) > 4000",
}
