"""Fixed values of the source language and of the graph format, each as plain text in its natural order."""

from __future__ import annotations

# Unit and the dimension that it names.
UNITS = {
    "nm": "length", "um": "length", "mm": "length", "cm": "length", "m": "length", "in": "length", "ft": "length",
    "rad": "angle", "deg": "angle", "mg": "mass", "g": "mass", "kg": "mass", "ms": "time", "s": "time", "min": "time",
    "N": "force", "Pa": "pressure", "MPa": "pressure",
}
# Other names of types.
TYPE_ALIASES = {"real": "scalar", "number": "scalar", "float": "scalar", "int": "integer", "bool": "boolean", "str": "string"}
# Functions with a known type of result.
CALL_TYPES = {
    "rectangle": "profile", "circle": "profile", "polygon": "profile", "distance": "length", "angle": "angle",
    "select": "entity", "vec2": "vector2", "vec3": "vector3", "manifold": "boolean", "valid": "boolean",
    "resolves": "boolean", "within": "boolean", "interference_free": "boolean",
}
# Kinds of nodes that declare a symbol.
DECLARATIONS = ("parameter", "constant", "datum", "sketch", "feature", "reference", "material", "assembly", "pmi", "tolerance")
# Names that need no declaration.
BUILTINS = (
    "world", "origin", "x", "y", "z", "xy", "xz", "yz", "true", "false", "null", "unique", "one", "many", "missing", "solid", "surface",
    "face", "edge", "vertex", "profile", "blind", "through_all", "symmetric", "new_body", "join", "subtract", "intersect", "observed",
    "certain", "hypothesis", "ambiguous", "inferred", "unknown",
)
# The four tolerance types.
TOLERANCES = ("kernel_tolerance", "measurement_uncertainty", "dimensional_tolerance", "gdt_zone")
# Operations that each profile adds to the ones before it.
PROFILES = {
    "P1": ("extrude", "cut", "revolve", "boolean", "hole", "pattern", "mirror", "fillet", "chamfer"),
    "P2": ("thread",),
    "P3": (),
    "P4": ("sweep", "loft", "blend", "shell", "draft"),
}
# Keywords of a selection that count as evidence; statuses that need evidence.
SELECT_EVIDENCE = ("normal", "surface", "area", "radius", "adjacent", "signature")
UNPROVEN = ("hypothesis", "ambiguous", "inferred")
# Binding strengths of binary operators; "^" alone groups to the right.
STRENGTH = {
    "or": 10, "||": 10, "and": 20, "&&": 20, "==": 30, "!=": 30, "<": 30, "<=": 30, ">": 30, ">=": 30, "~=": 30,
    "+": 40, "-": 40, "*": 50, "/": 50, "^": 60,
}
COMPARISONS = ("==", "!=", "<", "<=", ">", ">=", "~=", "and", "or", "&&", "||")
# Loss categories and severities (the last two block), evidence kinds, decision statuses.
LOSS_CATEGORIES = ("geometry", "topology", "parametric_history", "constraint", "pmi", "material", "assembly", "provenance", "identity", "behavior")
LOSS_SEVERITIES = ("info", "warning", "error", "fatal")
BLOCKING = ("error", "fatal")
EVIDENCE_KINDS = ("drawing", "pmi", "cad_model", "image", "point_cloud", "mesh", "text", "human_decision", "derived_rule")
DECISION_STATUSES = ("candidate", "accepted", "rejected", "abstained")
# Patterns of digests and of loss codes.
DIGEST_PATTERN = "^[0-9a-f]{64}$"
LOSS_CODE_PATTERN = "^[A-Z][A-Z0-9_.-]{2,63}$"
# The namespace of stable ids, the language version, and the graph's constant parts.
ID_NAMESPACE = "22b8aa1e-a037-5d7b-89f8-b7af0c8fc2ad"
LANGUAGE_VERSION = "0.1"
FORMAT_VERSION = "0.1"
FORMAT_NAME = "canonical-construction-graph"
EXECUTION_CONTRACT = {
    "authority": "semantic-construction-graph",
    "explicit_result_required": True,
    "ambiguity_policy": "error-or-human-decision",
    "numeric_mode": "backend-profile-locked",
    "step_anchor": ["ISO-10303-42", "ISO-10303-55", "ISO-10303-108", "ISO-10303-109", "ISO-10303-111", "ISO-10303-112", "ISO-10303-113", "ISO-10303-242"],
}


def profile_operations() -> list[tuple[str, int, str]]:
    """(profile, rank, operation) with the operations of earlier profiles in later ones."""
    ranked = list(enumerate(PROFILES.items(), 1))
    return [(name, rank, op) for rank, (name, _) in ranked for r, (_, ops) in ranked if r <= rank for op in ops]
