"""Problem 1: conversations out of message rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.llm.components import connected_components
from thicket.session import cut_lineage, wide_partitions

# How speakers are named, in lower case without outer white space.
ASKING = ["user", "human", "client", "customer", "visitor", "prompter", "question", "me"]
REPLYING = ["assistant", "ai", "bot", "model", "agent", "chatbot", "llm", "gpt", "answer"]
BESIDE = ["system", "tool", "function", "developer", "tool_result", "tool_call"]

#: White space of any kind and characters without width.
BLANK = r"^[\s\p{Z}\p{Cc}\p{Cf}\x{2800}\x{3164}\x{115F}\x{1160}]*$"
#: An answer refers to its sources like this; what has it isn't a placeholder.
CITED = r"\[S\d+\]"
#: What takes the place of a reply after a failed request; matched against the trimmed content in lower case.
FAILED = "|".join(
    [
        r"^(null|undefined|nan|none|nil|void|n/a|-+|\.+|…|error|failed|timeout)$",
        r"^\[object \w+\]$",
        r"^[45]\d\d$",
        r"^(http[ /]?[\d.]* ?)?(status )?[45]\d\d( [a-z ]{1,40})?$",
        r"^data: ?\[done\]$",
        r"^<[^<>]{1,60}>$",
        r"^\[[^\[\]]*(abort|cancel|interrupt|no (response|answer|reply|content|output)|time[d -]*out|disconnect|closed|failed|error|empty|truncated)[^\[\]]*\]$",
        r'^\{.{0,200}"(error|errors|errorcode|errormessage)" ?:',
        r'^\{.{0,200}"(type|status|kind)" ?: ?"(error|failed|failure|rate_limited|timeout)"',
        r"^([a-z]+\.)*[a-z]*(error|exception|failure)( \d+)?: [^.]{1,80}$",
        r"^([a-z]+\.)*[a-z]*(error|exception)(: [^\n]{0,200})?\n\s+at ",
        r"^traceback \(most recent call last\)",
        r"^(the |your )?(request|generation|stream|response|operation|call|completion|connection|session) (was |has been |is |got )?(cancell?ed|aborted|interrupted|timed out|lost|closed|failed|rejected|terminated|reset)\b[^.]{0,80}\.?$",
        r"^(the )?(token|rate|request|context|usage|quota|time) ?limit (was |has been )?(exceeded|reached|hit)\b",
        r"^(sorry, |oops[,!]? |we are sorry, )?(something|an (unexpected |internal )?error) (went wrong|occurred|has occurred|happened)\b",
        r"^(⚠️?|❌|✖|🚫)\x{FE0F}? ?.{0,40}(fail|error|abort|unavailable|time ?out|interrupt)",
        r"^(internal server error|bad gateway|gateway time-?out|service (is )?(temporarily )?unavailable|too many requests|socket hang up|fetch failed|network error|upstream timeout|model (is )?overloaded)\b.{0,60}$",
    ]
)


def speaker(role: Column) -> Column:
    """'q', 'r', 'x' (beside the talk) or null, where the speaker can't be told."""
    name = F.lower(F.trim(F.regexp_replace(role, r"[\s\p{Z}\p{Cf}]+", " ")))
    return F.when(name.isin(ASKING), "q").when(name.isin(REPLYING), "r").when(name.isin(BESIDE), "x")


def has_content(content: Column) -> Column:
    return content.isNotNull() & ~content.rlike(BLANK)


#: Error codes of systems, in capitals.
ERROR_CODE = r"^E[A-Z]{4,14}$"
#: White space around a text.
AROUND = r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$"


def is_placeholder(content: Column) -> Column:
    """Whether a reply's text only reports a failed request."""
    text = F.regexp_replace(content, AROUND, "")
    return F.coalesce((F.lower(text).rlike(FAILED) | text.rlike(ERROR_CODE)) & ~content.rlike(CITED), F.lit(False))


def message_links(messages: DataFrame) -> DataFrame:
    """(a, b): a message and the one that it replies to or quotes, as far as ``citations_json`` names messages.

    Broken JSON and entries without a message give no link.
    """
    entries = F.from_json("citations_json", "array<struct<replyTo:string,quote:string,messageId:string>>")
    return (
        messages.filter(F.col("citations_json").rlike('"(replyTo|quote|messageId)"'))
        .select(F.col("id").alias("a"), F.explode(entries).alias("e"))
        .select("a", F.explode(F.array("e.replyTo", "e.quote", "e.messageId")).alias("b"))
        .filter("a is not null and b is not null")
    )


def assign_sessions(messages: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """``messages`` with the column ``conversation``: session_id or, where it lacks, that of the component of linked messages.

    A component that reaches a message with a session joins the least such session; another one is named after its least
    message. Messages without session and without link get null: nothing tells what they belong to.
    """
    links = message_links(messages) if links is None else links
    lone = messages.filter("session_id is null and id is not null").select(F.col("id").alias("a"))
    if lone.isEmpty() or links.isEmpty():
        return messages.withColumn("conversation", F.col("session_id"))
    parts = connected_components(links)
    known = (
        parts.join(messages.select(F.col("id").alias("node"), "session_id"), "node")
        .groupBy("component")
        .agg(F.min("session_id").alias("joined"))
    )
    found = parts.join(known, "component", "left").select(
        F.col("node").alias("id"), F.coalesce("joined", "component").alias("found")
    )
    return (
        messages.join(found.join(lone.distinct().withColumnRenamed("a", "id"), "id", "left_semi"), "id", "left")
        .withColumn("conversation", F.coalesce("session_id", "found"))
        .drop("found")
    )


def judge_sessions(messages: DataFrame, sessions: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """(session_id, kept): one row for each session; kept if its messages form a whole conversation.

    Kept needs a question, and that each message has a time and a known speaker, the talk starts with a question, each
    question has a reply before the next one and before the end, and questions and replies have content. Whole-row copies
    count once, placeholders of failed replies not at all; in one instant questions come before replies. Extra columns are
    ignored, empty tables give no rows, sessions without messages aren't kept.

    Order matters only between neighbouring instants. Messages are first counted by session and instant, which no hot
    session can unbalance, then cut into ranges of (session, time) of about equal size; each range is judged by itself and
    what remains for a session is one row a range, that is, its first and last turn.
    """
    spark = messages.sparkSession
    rows = assign_sessions(messages, links).filter("conversation is not null")
    who = speaker(F.col("role"))
    turns = (
        rows.select(
            F.col("conversation").alias("session_id"),
            F.col("created_at").alias("at"),
            "id",
            F.xxhash64("content", "role", "citations_json").alias("h1"),
            F.hash("content", "role", "citations_json").alias("h2"),
            F.when((who == "r") & is_placeholder(F.col("content")), "x").otherwise(who).alias("who"),
            has_content(F.col("content")).alias("full"),
        )
        .distinct()
        .groupBy("session_id", "at")
        .agg(
            F.count_if(F.col("who") == "q").alias("nq"),
            F.count_if(F.col("who") == "r").alias("nr"),
            F.max(F.col("at").isNull() | F.col("who").isNull() | (~F.col("full") & F.col("who").isin("q", "r"))).alias("bad"),
        )
    )
    ranged = turns.repartitionByRange(wide_partitions(spark), "session_id", "at").withColumn("part", F.spark_partition_id())
    spoken = F.col("nq") + F.col("nr") > 0
    before = Window.partitionBy("session_id", "part").orderBy("at")
    quiet = F.when(spoken, F.struct(F.col("nr") > 0))
    judged = (
        ranged.withColumn("before", F.last(quiet, ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1)))
        .groupBy("session_id", "part")
        .agg(
            F.max(F.col("bad") | (F.col("nq") > 1) | ((F.col("nq") > 0) & F.col("before.col1").eqNullSafe(False))).alias("bad"),
            F.sum("nq").alias("nq"),
            F.min_by(F.col("nq") > 0, F.when(spoken, F.col("at"))).alias("starts_q"),
            F.max_by(F.col("nr") > 0, F.when(spoken, F.col("at"))).alias("ends_r"),
        )
    )
    # One row a range: joined in order, a range that starts with a question needs one before it that ends with a reply.
    edges = Window.partitionBy("session_id").orderBy("part")
    prior = F.last(F.when(F.col("starts_q").isNotNull(), F.struct("ends_r")), ignorenulls=True).over(
        edges.rowsBetween(Window.unboundedPreceding, -1)
    )
    verdict = (
        judged.withColumn("prior", prior)
        .groupBy("session_id")
        .agg(
            F.max(
                F.col("bad")
                | F.coalesce(F.col("starts_q") & F.col("prior").isNotNull() & ~F.col("prior.ends_r"), F.lit(False))
                | F.coalesce(~F.col("starts_q") & F.col("prior").isNull(), F.lit(False))
            ).alias("bad"),
            F.sum("nq").alias("nq"),
            F.max_by("ends_r", F.when(F.col("starts_q").isNotNull(), F.col("part"))).alias("ends_r"),
        )
        .select("session_id", (~F.col("bad") & (F.col("nq") > 0) & F.coalesce("ends_r", F.lit(False))).alias("kept"))
    )
    if sessions is None:
        return verdict
    listed = sessions.select(F.col("id").alias("session_id")).filter("session_id is not null").distinct()
    return listed.join(verdict, "session_id", "full_outer").select("session_id", F.coalesce("kept", F.lit(False)).alias("kept"))


def conversations(messages: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(session_id, turn, role, created_at, content): kept conversations as numbered turns of 'user' and 'assistant'.

    Numbers start at 1. They are counted in ranges of (session, time), so that no session has to fit into one task.
    Copies are removed and placeholders left out. Turns of one kind in the same instant follow the order of their ids.
    """
    spark = messages.sparkSession
    named = assign_sessions(messages, links)
    kept = judge_sessions(messages, None, links).filter("kept").select(F.col("session_id").alias("conversation"))
    who = speaker(F.col("role"))
    turns = (
        named.select(F.col("conversation"), "id", "role", "content", "citations_json", "created_at")
        .distinct()
        .join(kept, "conversation")
        .withColumn("who", who)
        .filter("who in ('q', 'r')")
        .filter((F.col("who") == "q") | ~is_placeholder(F.col("content")))
        .select("conversation", "created_at", "who", "id", "content")
    )
    order = ["created_at", "who", "id", "content"]
    # Written once: read twice, it must not be ranged twice.
    ranged = cut_lineage(
        turns.repartitionByRange(wide_partitions(spark), "conversation", *order).withColumn("part", F.spark_partition_id())
    )
    sizes = ranged.groupBy("conversation", "part").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("conversation").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("conversation", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("conversation", "part").orderBy(*order))
    return (
        ranged.withColumn("n", within)
        .join(offsets, ["conversation", "part"])
        .select(
            F.col("conversation").alias("session_id"),
            (F.col("base") + F.col("n")).alias("turn"),
            F.when(F.col("who") == "q", "user").otherwise("assistant").alias("role"),
            "created_at",
            "content",
        )
    )
