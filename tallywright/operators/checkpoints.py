"""Agent checkpoints and their hand-off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import uuid_v5
from ..schemas import CHECKPOINT_DATA
from ..sources.tables import upsert
from .temporal import with_expiry

COLUMNS = ["tenant_id", "id", "agent_id", "task_id", "checkpoint_data", "status", "created_at", "updated_at", "expires_at"]


def save_checkpoints(requests: DataFrame, target: DataFrame | None = None) -> DataFrame:
    """Requests (tenant_id, agent_id, task_id, checkpoint_data, ttl_seconds, created_at) as active checkpoints (P01). Ids are derived from what was saved, so a rerun makes the same rows."""
    named = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("tenant_id", "agent_id", "task_id", "created_at", "checkpoint_data")])
    rows = with_expiry(requests.withColumn("id", uuid_v5(named)).withColumn("status", F.lit("active")).withColumn("updated_at", F.col("created_at"))).select(*COLUMNS)
    return rows if target is None else upsert(target.select(*COLUMNS), rows, ["tenant_id", "id"], ["updated_at"])


def resume(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The checkpoints of the asked (tenant_id, id)."""
    return df.join(ids.select("tenant_id", "id").distinct(), ["tenant_id", "id"], "left_semi")


def handoff(df: DataFrame, requests: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(new rows, rejected requests): a copy of the checkpoint for the new agent, active and without expiry; the source stays."""
    asked = requests.select("tenant_id", F.col("checkpoint_id").alias("_c"), "to_agent_id")
    made = asked.join(df.withColumnRenamed("id", "_c"), ["tenant_id", "_c"]).withColumn("from_agent_id", F.col("agent_id"))
    made = made.withColumns({"id": uuid_v5(F.concat_ws("|", "tenant_id", F.col("_c"), "to_agent_id", now.cast("string"))), "agent_id": F.col("to_agent_id"), "status": F.lit("active"), "created_at": now, "updated_at": now, "expires_at": F.lit(None).cast("timestamp")})
    rejected = requests.join(df.select("tenant_id", F.col("id").alias("checkpoint_id")), ["tenant_id", "checkpoint_id"], "left_anti")
    return made.select(*COLUMNS, "from_agent_id"), rejected


def decoded(df: DataFrame) -> DataFrame:
    return df.withColumn("ir", F.from_json("checkpoint_data", CHECKPOINT_DATA))


def explode_facts(df: DataFrame) -> DataFrame:
    return decoded(df).select("tenant_id", "id", F.explode("ir.discovered_facts").alias("f")).select("tenant_id", F.col("id").alias("checkpoint_id"), "f.*")


def explode_steps(df: DataFrame) -> DataFrame:
    return decoded(df).select("tenant_id", "id", F.posexplode("ir.pending_steps").alias("pos", "step"))


def explode_files(df: DataFrame) -> DataFrame:
    return decoded(df).select("tenant_id", "id", F.posexplode("ir.files_touched").alias("pos", "file"))
