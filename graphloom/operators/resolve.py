"""Three-state resolution of references: unique, ambiguous or missing, and never a pick among several."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUS = ("unique", "ambiguous", "missing")


def status_of(count: Column) -> Column:
    return F.when(count == 0, "missing").when(count == 1, "unique").otherwise("ambiguous")


def resolve(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, status, n_candidates, candidates) of each query.

    queries: query_id, kind, producer, role, signature map<string, string>, adjacent_to array<string>;
    candidates: identity, kind, producer, role, signature, adjacency. A candidate fits if kind, producer
    and role are equal, each required signature value is equal (a required null fits a key that is
    absent or null) and each required neighbour is among its own. Values are compared as strings. The
    same identity twice is ambiguous. Candidates are listed by identity. A null signature or list of
    neighbours, of either side, is empty.

    An equi-join with the rest as its condition, then a grouping by query: Catalyst picks broadcast or
    shuffle by size, and splits a hot key.
    """
    none, nobody = F.create_map().cast("map<string,string>"), F.array().cast("array<string>")
    q = queries.select(
        "query_id", F.col("kind").alias("qk"), F.col("producer").alias("qp"), F.col("role").alias("qr"), F.coalesce("signature", none).alias("qs"), F.coalesce("adjacent_to", nobody).alias("qa")
    )
    c = candidates.select("identity", "kind", "producer", "role", F.coalesce("signature", none).alias("signature"), F.coalesce("adjacency", nobody).alias("adjacency"))
    same = F.forall(F.map_keys("qs"), lambda k: F.element_at("signature", k).eqNullSafe(F.element_at("qs", k)))
    near = F.forall("qa", lambda x: F.array_contains("adjacency", x))
    equal = (F.col("qk") == F.col("kind")) & (F.col("qp") == F.col("producer")) & (F.col("qr") == F.col("role"))
    n = F.count("identity")
    found = q.join(c, equal & same & near, "left").groupBy("query_id")
    return found.agg(status_of(n).alias("status"), n.alias("n_candidates"), F.sort_array(F.collect_list("identity")).alias("candidates"))


def unique_entities(resolution: DataFrame) -> DataFrame:
    """(query_id, entity) of the references that resolve to one candidate."""
    return resolution.where("status = 'unique'").select("query_id", F.element_at("candidates", 1).alias("entity"))


def entity_of(resolution: DataFrame, query_id: str) -> str:
    """The one entity of a query; LookupError if there is none or more than one."""
    row = resolution.where(F.col("query_id") == query_id).first()
    if row is None or row["status"] != "unique":
        raise LookupError(f"reference {query_id!r} is {row['status'] if row else 'unknown'}")
    return row["candidates"][0]
