"""Pattern jobs over whole turns of a conversation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def whole_words(pattern: str) -> str:
    """Pattern that starts and ends at a word edge, whatever letters stand outside ASCII."""
    return r"(^|[^\p{L}\p{M}\p{N}])(" + pattern + r")($|[^\p{L}\p{M}\p{N}])"


# Wording that marks a promise and a date said with it.
PROMISE = whole_words("i will|i'll|we will|we'll|i can get|we can send|let me send")
DUE = r"(by|until) (monday|tuesday|wednesday|thursday|friday|tomorrow|next week|end of [a-z]+)"

# Wording behind each tag.
SIGNAL_PATTERNS = {
    "risk": whole_words("no budget|on hold|blocking|blocker|not a priority|legal concern"),
    "positive": whole_words("exactly what we|my vp|love this|looking forward"),
    "churn": whole_words("consolidating|consolidation|unused seats|budget review|cancel"),
    "expansion": whole_words("more seats|another team|roll out|additional licences"),
}


def phrase_search(turns: DataFrame, phrase: str, meetings: DataFrame | None = None) -> DataFrame:
    """What was said on a topic: the quote, who said it, when, in which meeting, and where it stands.

    Turns are searched, and the summary and key quote of `meetings`, whose rows name no turn or speaker.
    """
    said = turns.select("meeting_id", "turn", F.col("role").alias("speaker"), "day", F.col("text").alias("quote"), F.lit("turn").alias("found_in"))
    if meetings is not None:
        cells = F.explode(F.array(*[F.struct(F.col(c).alias("quote"), F.lit(c).alias("found_in")) for c in ("summary", "key_quote")]))
        noted = meetings.select("meeting_id", F.lit(None).cast(turns.schema["turn"].dataType).alias("turn"), F.lit(None).cast("string").alias("speaker"), "day", cells.alias("_c"))
        said = said.unionByName(noted.select("meeting_id", "turn", "speaker", "day", "_c.quote", "_c.found_in"))
    return said.filter(F.contains(F.lower("quote"), F.lit(phrase.lower())))


def commitment_extract(turns: DataFrame, promise: str = PROMISE, due: str = DUE) -> DataFrame:
    """Turns that hold a promise; without a stated date the row goes to review."""
    said = F.lower("text")
    when_said = F.nullif(F.regexp_extract(said, due, 2), F.lit(""))
    return turns.filter((F.col("role") != "system") & said.rlike(promise)).select(
        "meeting_id", "turn", F.col("role").alias("speaker"),
        F.when(F.col("role") == "assistant", "ours").otherwise("theirs").alias("direction"),
        F.col("text").alias("quote"), when_said.alias("due_words"), when_said.isNull().alias("needs_review"),
    )


def signal_phrases(turns: DataFrame, patterns: Mapping[str, str] = SIGNAL_PATTERNS) -> DataFrame:
    """One row per turn and tag, keeping the quote."""
    said = F.lower("text")
    tags = F.array_compact(F.array(*[F.when(said.rlike(p), F.lit(tag)) for tag, p in patterns.items()]))
    return turns.select(
        "meeting_id", "turn", F.col("role").alias("speaker"), F.explode(tags).alias("tag"), F.col("text").alias("quote")
    )
