"""Evidence, decisions and loss registers: checks and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import BLOCKING, DECISION_STATUSES, EVIDENCE_KINDS, LOSS_CATEGORIES, LOSS_CODE_PATTERN, LOSS_SEVERITIES
from ..functions.identity import is_digest


def _failed(*checks: tuple[str, Column]) -> Column:
    """Names of the checks that hold, in order."""
    return F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks)), lambda x: x.isNotNull())


def check_evidence(evidence: DataFrame) -> DataFrame:
    """evidence with `violations`: digest (not 64 lower-case hexadecimal digits), kind (not a known one)."""
    return evidence.withColumn("violations", _failed(("digest", ~is_digest(F.col("source_sha256"))), ("kind", ~F.coalesce(F.col("kind").isin(*EVIDENCE_KINDS), F.lit(False)))))


def check_decisions(decisions: DataFrame) -> DataFrame:
    """decisions with `violations`: confidence outside 0 to 1, accepted without evidence or without an actor, unknown status.

    A null confidence is allowed; an empty actor counts as none.
    """
    accepted = F.col("status") == "accepted"
    return decisions.withColumn(
        "violations",
        _failed(
            ("confidence", ~F.col("confidence").between(0, 1)),
            ("evidence", accepted & (F.coalesce(F.size("evidence_ids"), F.lit(0)) <= 0)),
            ("actor", accepted & (F.coalesce(F.col("decided_by"), F.lit("")) == "")),
            ("status", ~F.coalesce(F.col("status").isin(*DECISION_STATUSES), F.lit(False))),
        ),
    )


def dangling_evidence(decisions: DataFrame, evidence: DataFrame) -> DataFrame:
    """(identity, evidence_id) of decisions' evidence that is in no evidence row (an extension)."""
    used = decisions.select("identity", F.explode("evidence_ids").alias("evidence_id")).distinct()
    return used.join(evidence.select(F.col("identity").alias("evidence_id")), "evidence_id", "left_anti").select("identity", "evidence_id")


def check_losses(records: DataFrame) -> DataFrame:
    """Loss records with `violations`: code, category, severity."""
    known = lambda c, values: ~F.coalesce(F.col(c).isin(*values), F.lit(False))
    return records.withColumn("violations", _failed(("code", ~F.coalesce(F.col("code").rlike(LOSS_CODE_PATTERN), F.lit(False))), ("category", known("category", LOSS_CATEGORIES)), ("severity", known("severity", LOSS_SEVERITIES))))


def blocks(severity: Column) -> Column:
    """Aggregate: whether any severity blocks; false for no rows."""
    return F.coalesce(F.bool_or(severity.isin(*BLOCKING)), F.lit(False))


def roll_up(registers: DataFrame, records: DataFrame) -> DataFrame:
    """registers with n_records and blocks_commit, recomputed; consistent, if they say blocks_commit, whether it agrees."""
    by = records.groupBy("register_id").agg(F.count("*").alias("n_records"), blocks(F.col("severity")).alias("_blocks"))
    joined = registers.join(by, "register_id", "left").withColumns({"n_records": F.coalesce("n_records", F.lit(0)), "_blocks": F.coalesce("_blocks", F.lit(False))})
    if "blocks_commit" in registers.columns:
        joined = joined.withColumn("consistent", F.col("blocks_commit").eqNullSafe(F.col("_blocks")))
    return joined.drop("blocks_commit").withColumnRenamed("_blocks", "blocks_commit")


def register_json(registers: DataFrame, records: DataFrame, language: str = "graphloom") -> DataFrame:
    """(register_id, json) of each register with its records in order; nulls are kept. The schema bears the language's name."""
    fields = ["code", "category", "severity", "subject", "message", "source_capability", "target_capability", "mitigation", "reversible"]
    listed = records.groupBy("register_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", *fields))), lambda r: F.struct(*(r[f].alias(f) for f in fields))).alias("records"))
    whole = roll_up(registers, records).join(listed, "register_id", "left")
    shown = F.struct(F.lit(f"{language}.loss-register/0.1").alias("schema"), "operation", "source_backend", "target_backend", "blocks_commit", F.coalesce("records", F.array().cast(dict(listed.dtypes)["records"])).alias("records"))
    return whole.select("register_id", F.to_json(shown, {"ignoreNullFields": "false"}).alias("json"))
