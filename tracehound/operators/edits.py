"""Analysts' edits of stored findings, merged on read.

Findings are written once by their run.  What an analyst decides about one
(its status, a note) is appended to a table of edits, keyed by the finding's
run and id, and joined when findings are read: the latest edit of each field
wins.  A finding's id is a function of its run and fingerprint, so a repeated
run keeps its edits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["execution_id", "finding_id"]
FIELDS = ["status", "analyst_notes"]


def latest_edits(edits: DataFrame) -> DataFrame:
    """One row per edited finding: each field's latest value that is not null
    (of edits at one time, the greatest) and the time of the last edit."""
    def last(field: str) -> Column:
        return F.max(F.when(F.col(field).isNotNull(), F.struct("edited_at", field)))[field].alias(f"_{field}")
    return edits.groupBy(*KEYS).agg(*[last(f) for f in FIELDS], F.max("edited_at").alias("_edited_at"))


def with_edits(findings: DataFrame, edits: DataFrame) -> DataFrame:
    """The findings as edited, same columns.  The edits hold one row per
    edited finding; findings are never grouped."""
    e = latest_edits(edits).select(*[F.col(k).alias(f"_e_{k}") for k in KEYS], *[f"_{f}" for f in FIELDS], "_edited_at")
    joined = findings.join(e, [F.col(k) == F.col(f"_e_{k}") for k in KEYS], "left")
    changed = {f: F.coalesce(F.col(f"_{f}"), F.col(f)) if f in findings.columns else F.col(f"_{f}") for f in FIELDS}
    if "updated_at" in findings.columns:
        changed["updated_at"] = F.greatest("updated_at", F.col("_edited_at").cast(findings.schema["updated_at"].dataType))
    return joined.withColumns(changed).select(*findings.columns)
