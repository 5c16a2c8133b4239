"""Shapes of nested JSON: which fields a part may and must have, and what they hold, to any depth."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fields of each part of a graph and of a loss register. "!" marks those that must be there, "?" those
# that may be null; [x] is a list of x and {x} an object of x by any names.
SHAPES = {
    "graph": {
        "format": "string!", "format_version": "string!", "source_language": "string!", "namespace": "string!", "imports": "[import]!",
        "models": "[model]!", "execution_contract": "object!", "semantic_sha256": "string!",
    },
    "import": {"source": "string!", "alias": "string"},
    "model": {"id": "string!", "name": "string!", "attributes": "{expression}!", "dependency_order": "[string]!", "declarations": "[node]!"},
    "node": {
        "id": "string!", "kind": "string!", "name": "string", "type": "string", "value": "expression", "context": "expression",
        "attributes": "{expression}", "body": "[node]",
    },
    "expression": {
        "kind": "literal|reference|call|unary|binary|list!", "value": "any", "numeric_encoding": "decimal", "unit": "string", "path": "string",
        "operation": "string", "arguments": "[expression]", "keywords": "{expression}", "operator": "string", "operand": "expression",
        "left": "expression", "right": "expression", "items": "[expression]",
    },
    "register": {"schema": "string!", "operation": "string!", "source_backend": "string!", "target_backend": "string!", "blocks_commit": "boolean!", "records": "[record]!"},
    "record": {
        "code": "string!", "category": "string!", "severity": "string!", "subject": "string!", "message": "string!", "source_capability": "string!?",
        "target_capability": "string!?", "mitigation": "string!?", "reversible": "boolean!",
    },
}
_TYPES = {"string": str, "boolean": bool, "object": dict}


def first_fault(value: object, shape: str) -> str | None:
    """The place of the first part, from the top, that has not its shape; None if all have. Depth is bounded by memory only."""
    todo: list[tuple[str, object, str]] = [(shape, value, "$")]
    while todo:
        shape, value, place = todo.pop(0)
        if shape == "any":
            continue
        if shape in _TYPES:
            if not isinstance(value, _TYPES[shape]):
                return place
        elif shape[0] in "[{":
            if not isinstance(value, list if shape[0] == "[" else dict):
                return place
            parts = enumerate(value) if shape[0] == "[" else value.items()
            todo += [(shape[1:-1], x, f"{place}[{k}]" if shape[0] == "[" else f"{place}.{k}") for k, x in parts]
        elif shape not in SHAPES:
            if value not in shape.split("|"):
                return place
        else:
            fields = SHAPES[shape]
            if not isinstance(value, dict) or set(value) - set(fields) or any("!" in what and name not in value for name, what in fields.items()):
                return place
            todo += [(fields[name].rstrip("!?"), x, f"{place}.{name}") for name, x in value.items() if not (x is None and "?" in fields[name])]
    return None


def with_faults(df: DataFrame, column: str, shape: str, name: str = "fault") -> DataFrame:
    """df with a column of the first fault of the JSON text in `column`: "$" for text that is no JSON, null for null and for no fault."""
    schema = df.select(*df.columns, F.lit("").alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(column).to_pylist():
                try:
                    found.append(None if text is None else first_fault(json.loads(text), shape))
                except ValueError:
                    found.append("$")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, name])

    schema[name].nullable = True
    return df.mapInArrow(run, schema)
