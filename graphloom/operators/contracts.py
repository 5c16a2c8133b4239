"""Contracts of graphs, loss registers and manifests, checked on JSON text by column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import BLOCKING, DIGEST_PATTERN, EXECUTION_CONTRACT, FORMAT_VERSION, LOSS_CATEGORIES, LOSS_CODE_PATTERN, LOSS_SEVERITIES
from .shapes import with_faults
from .trust import _failed

# Fields that a graph, a loss register and a manifest must have.
GRAPH_FIELDS = ("format", "format_version", "source_language", "namespace", "imports", "models", "execution_contract", "semantic_sha256")
REGISTER_FIELDS = ("schema", "operation", "source_backend", "target_backend", "blocks_commit", "records")
MANIFEST_FIELDS = (
    "format", "format_version", "status", "id", "name", "backend_version", "backend_types", "entrypoint", "capabilities",
    "profiles", "operations", "formats", "execution", "license", "security", "qualification",
)


def _keys(text: Column) -> Column:
    return F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))


def _fields(text: Column, wanted: tuple[str, ...], closed: bool = True) -> list[tuple[str, Column]]:
    names = F.array(*map(F.lit, wanted))
    checks = [("missing", F.size(F.array_except(names, _keys(text))) > 0)]
    return checks + ([("unknown", F.size(F.array_except(_keys(text), names)) > 0)] if closed else [])


#: The execution contract as a type.
_CONTRACT = "authority string, explicit_result_required boolean, ambiguity_policy string, numeric_mode string, step_anchor array<string>"
# What an entry point of each mode must have one of; what a candidate's qualification must have all of.
ENTRY_FIELDS = {"in_process": ("python_module", "native_library"), "worker": ("command",), "service": ("endpoint",)}
CANDIDATE_FIELDS = ("suite_version", "report_uri", "tested_at")


def _contract(text: Column) -> Column:
    """Whether the execution contract is the one of the format, whole and with nothing else."""
    said = F.from_json(text, _CONTRACT)
    same = [said[k].eqNullSafe(F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)) for k, v in EXECUTION_CONTRACT.items()]
    every = F.size(_keys(text)) == len(EXECUTION_CONTRACT)
    for one in same:
        every &= one
    return F.coalesce(every, F.lit(False))


def check_graphs(graphs: DataFrame, column: str = "canonical_json") -> DataFrame:
    """graphs with `violations`: missing and unknown fields, version, digest, models, contract (the whole of it), order (a
    name twice), shape (a part at any depth that has other fields or types than the format says, see shapes)."""
    text = F.col(column)
    order = F.from_json(F.get_json_object(text, "$.models[*].dependency_order"), "array<array<string>>")
    one = F.from_json(F.get_json_object(text, "$.models[0].dependency_order"), "array<string>")
    twice = F.exists(F.coalesce(F.filter(order, lambda x: x.isNotNull()), F.array(one)), lambda x: F.size(F.array_distinct(x)) != F.size(x))
    checks = [
        *_fields(text, GRAPH_FIELDS),
        ("version", ~F.get_json_object(text, "$.format_version").eqNullSafe(F.lit(FORMAT_VERSION))),
        ("digest", ~F.coalesce(F.get_json_object(text, "$.semantic_sha256").rlike(DIGEST_PATTERN), F.lit(False))),
        ("models", F.coalesce(F.json_array_length(F.get_json_object(text, "$.models")), F.lit(0)) < 1),
        ("contract", ~_contract(F.get_json_object(text, "$.execution_contract"))),
        ("order", twice),
        ("shape", F.col("_fault").isNotNull()),
    ]
    return with_faults(graphs, column, "graph", "_fault").withColumn("violations", _failed(*checks)).drop("_fault")


def check_registers(registers: DataFrame, column: str = "json") -> DataFrame:
    """registers with `violations`: fields, shape (of the records too), records whose code, category or severity is none,
    and blocks_commit that disagrees with the records' severities."""
    text, kind = F.col(column), "array<struct<code: string, category: string, severity: string>>"
    records = F.coalesce(F.from_json(F.get_json_object(text, "$.records"), kind), F.array().cast(kind))
    stops = F.exists(records, lambda r: r["severity"].isin(*BLOCKING))
    known = lambda r: r["code"].rlike(LOSS_CODE_PATTERN) & r["category"].isin(*LOSS_CATEGORIES) & r["severity"].isin(*LOSS_SEVERITIES)
    odd = F.exists(records, lambda r: ~F.coalesce(known(r), F.lit(False)))
    checks = [*_fields(text, REGISTER_FIELDS), ("shape", F.col("_fault").isNotNull()), ("records", odd), ("blocks", F.get_json_object(text, "$.blocks_commit") != stops.cast("string"))]
    return with_faults(registers, column, "register", "_fault").withColumn("violations", _failed(*checks)).drop("_fault")


def check_manifests(manifests: DataFrame, column: str = "json") -> DataFrame:
    """manifests with `violations`: missing and unknown sections; an approximate or fallback operation without a loss code;
    an entry point or a candidate's qualification without what its mode or status asks for."""
    text = F.col(column)
    kind = "array<struct<support: string, loss_code: string>>"
    operations = F.coalesce(F.from_json(F.get_json_object(text, "$.operations"), kind), F.array().cast(kind))
    silent = F.exists(operations, lambda o: o["support"].isin("approximate", "fallback") & o["loss_code"].isNull())
    of = lambda part: _keys(F.get_json_object(text, f"$.{part}"))
    names = lambda fields: F.array(*map(F.lit, fields))
    mode, entry = F.get_json_object(text, "$.entrypoint.mode"), F.lit(False)
    for said, fields in ENTRY_FIELDS.items():
        entry |= (mode == said) & ~F.arrays_overlap(of("entrypoint"), names(fields))
    candidate = (F.get_json_object(text, "$.qualification.status") == "candidate") & (F.size(F.array_except(names(CANDIDATE_FIELDS), of("qualification"))) > 0)
    return manifests.withColumn("violations", _failed(*_fields(text, MANIFEST_FIELDS), ("loss code", silent), ("entry", entry), ("qualification", candidate)))


def unsupported(requested: DataFrame, supported: DataFrame) -> DataFrame:
    """Requested (backend, operation) that the backend doesn't support (an extension)."""
    return requested.join(supported, ["backend", "operation"], "left_anti")


def drift(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """(key, change) of rows that are added, removed or changed, by a digest of each row (an extension)."""
    sign = lambda df, name: df.select(*key, F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256).alias(name))
    both = sign(old, "_old").join(sign(new, "_new"), key, "full_outer")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    return both.select(*key, change.alias("change")).where("change is not null")
