"""Decisions harvested out of message text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import archive_url, confidence, extract_matches, uuid_v5
from .filters import promotable

#: The default keywords.
KEYWORDS = ["decided", "we should", "let's go with", "we'll use", "we're going with", "i think we should", "proposal", "agreed", "consensus", "approved"]


def extract(df: DataFrame, text: str, keywords: list[str] = KEYWORDS) -> DataFrame:
    """Adds n_matches, extracted_decision (the first, or '') and confidence."""
    found = df.withColumn("_m", F.coalesce(extract_matches(F.col(text), keywords), F.array().cast("array<string>")))
    return found.withColumns({"n_matches": F.size("_m"), "extracted_decision": F.coalesce(F.try_element_at("_m", F.lit(1)), F.lit("")), "confidence": confidence(F.col("_m"))}).drop("_m")


def extract_with_context(df: DataFrame, text: str, prior: str, keywords: list[str] = KEYWORDS) -> DataFrame:
    """A prior decision, where there is one, wins with 0.85."""
    has = F.coalesce(F.col(prior), F.lit("")) != ""
    return extract(df, text, keywords).withColumns({"extracted_decision": F.when(has, F.col(prior)).otherwise(F.col("extracted_decision")), "confidence": F.when(has, F.lit(0.85)).otherwise(F.col("confidence"))})


def harvest(messages: DataFrame, keywords: list[str] = KEYWORDS, min_confidence: float = 0.7, source_type: str = "chat") -> DataFrame:
    """Rows for messages (channel_id, ts, text) whose confidence reaches the least one."""
    found = extract(messages.filter(F.coalesce("text", F.lit("")) != ""), "text", keywords).filter(F.col("confidence") >= min_confidence)
    source_id = F.concat(F.col("channel_id"), F.lit(":"), F.col("ts"))
    return found.select(uuid_v5(source_id).alias("id"), F.lit(source_type).alias("source_type"), source_id.alias("source_id"), archive_url(F.col("channel_id"), F.col("ts")).alias("source_url"), F.col("text").alias("raw_text"), "extracted_decision", "confidence", F.lit(False).alias("human_validated"), F.lit(None).cast("string").alias("decision_id"))


def promote(harvested: DataFrame, threshold: float, actor: str, tenant: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """(new draft decisions, harvested rows with their back-reference) for unvalidated rows at or above the threshold."""
    chosen = promotable(harvested, threshold).withColumn("_new", uuid_v5(F.concat(F.lit("promoted|"), F.col("id"))))
    decisions = chosen.select(F.lit(tenant).alias("tenant_id"), F.col("_new").alias("id"), F.col("extracted_decision").alias("title"), F.col("extracted_decision").alias("statement"), F.lit("draft").alias("status"), F.lit("harvested").alias("scope_domain"), F.col("source_type").alias("scope_system"), F.lit(actor).alias("owner"), "confidence", now.alias("created_at"))
    marked = harvested.join(chosen.select("id", "_new"), "id", "left")
    return decisions, marked.withColumns({"human_validated": F.col("human_validated") | F.col("_new").isNotNull(), "decision_id": F.coalesce("_new", "decision_id")}).select(*harvested.columns)
