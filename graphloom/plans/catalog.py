"""Queries that apply the operators to the star-schema tables, and DuckDB SQL with the same results.

Names ending in _ext go beyond what the reference computes.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.constants import BUILTINS, EXECUTION_CONTRACT, TOLERANCES, UNITS, profile_operations
from ..functions.identity import is_digest, stable_uuid
from ..functions.quantities import value_digest
from ..operators import contracts, graph, ledger, quality, resolve, rules, scenarios, trust
from ..sources.documents import parse_documents, part, tokens

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# References: parts as candidates, every brand, type and size as a query


def _part_references(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Queries for each brand, type and size from 1 to 50; candidates from parts."""
    part = _table(spark, sf_dir, "part")
    kinds = part.agg(F.collect_set("p_brand").alias("brands"), F.collect_set("p_type").alias("types"))  # a few of each, whatever the size
    asked = kinds.select(F.explode("brands").alias("p_brand"), "types").select("p_brand", F.explode("types").alias("p_type")).withColumn("size", F.explode(F.sequence(F.lit(1), F.lit(50))))
    wanted = asked.select(
        F.concat_ws("|", "p_brand", "p_type", F.col("size").cast("string")).alias("query_id"), F.lit("part").alias("kind"), F.col("p_brand").alias("producer"), F.col("p_type").alias("role"),
        F.create_map(F.lit("size"), F.col("size").cast("string")).alias("signature"), F.array().cast("array<string>").alias("adjacent_to"),
    )
    found = part.select(
        F.col("p_partkey").cast("string").alias("identity"), F.lit("part").alias("kind"), F.col("p_brand").alias("producer"), F.col("p_type").alias("role"),
        F.create_map(F.lit("size"), F.col("p_size").cast("string")).alias("signature"), F.array().cast("array<string>").alias("adjacency"),
    )
    return wanted, found


_ASKED = """WITH asked AS (SELECT b.p_brand, t.p_type, s.size FROM (SELECT DISTINCT p_brand FROM part) b, (SELECT DISTINCT p_type FROM part) t, (SELECT unnest(range(1, 51)) AS size) s),
hits AS (SELECT a.p_brand || '|' || a.p_type || '|' || a.size AS query_id, count(p.p_partkey) AS n_candidates, coalesce(string_agg(CAST(p.p_partkey AS VARCHAR), ',' ORDER BY CAST(p.p_partkey AS VARCHAR)), '') AS listed
FROM asked a LEFT JOIN part p ON p.p_brand = a.p_brand AND p.p_type = a.p_type AND p.p_size = a.size GROUP BY 1) """


@_query(_ASKED + "SELECT query_id, CASE n_candidates WHEN 0 THEN 'missing' WHEN 1 THEN 'unique' ELSE 'ambiguous' END AS status, n_candidates FROM hits")
def resolve_part_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve(*_part_references(spark, sf_dir)).select("query_id", "status", "n_candidates")


@_query(_ASKED + "SELECT query_id, listed AS candidates FROM hits")
def resolve_candidates_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve(*_part_references(spark, sf_dir)).select("query_id", F.array_join("candidates", ",").alias("candidates"))


@_query(_ASKED + "SELECT query_id, listed AS entity FROM hits WHERE n_candidates = 1")
def unique_entity_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.unique_entities(resolve.resolve(*_part_references(spark, sf_dir)))


@_query("""WITH near AS (SELECT l_partkey, list(DISTINCT CAST(l_suppkey AS VARCHAR)) AS suppliers FROM lineitem GROUP BY 1),
c AS (SELECT p.p_partkey, p.p_brand, coalesce(n.suppliers, []) AS suppliers FROM part p LEFT JOIN near n ON n.l_partkey = p.p_partkey),
q AS (SELECT b.p_brand, s.s FROM (SELECT DISTINCT p_brand FROM part) b, (SELECT unnest(range(1, 11)) AS s) s)
SELECT q.p_brand || '|' || q.s AS query_id, CASE count(c.p_partkey) WHEN 0 THEN 'missing' WHEN 1 THEN 'unique' ELSE 'ambiguous' END AS status, count(c.p_partkey) AS n_candidates
FROM q LEFT JOIN c ON c.p_brand = q.p_brand AND list_has_all(c.suppliers, [CAST(q.s AS VARCHAR), CAST(q.s + 1 AS VARCHAR)]) GROUP BY 1, q.p_brand, q.s""")
def resolve_with_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand that two given suppliers both deliver."""
    part, lines = _table(spark, sf_dir, "part"), _table(spark, sf_dir, "lineitem")
    pairs = lines.select("l_partkey", F.col("l_suppkey").cast("string").alias("s")).distinct()
    near = pairs.groupBy("l_partkey").agg(F.collect_list("s").alias("adjacency"))
    found = part.join(near, part["p_partkey"] == near["l_partkey"], "left").select(
        F.col("p_partkey").cast("string").alias("identity"), F.lit("part").alias("kind"), F.col("p_brand").alias("producer"), F.lit("any").alias("role"), F.lit(None).cast("map<string,string>").alias("signature"), "adjacency"
    )
    asked = part.select("p_brand").distinct().withColumn("s", F.explode(F.sequence(F.lit(1), F.lit(10))))
    wanted = asked.select(
        F.concat_ws("|", "p_brand", F.col("s").cast("string")).alias("query_id"), F.lit("part").alias("kind"), F.col("p_brand").alias("producer"), F.lit("any").alias("role"),
        F.lit(None).cast("map<string,string>").alias("signature"), F.array(F.col("s").cast("string"), (F.col("s") + 1).cast("string")).alias("adjacent_to"),
    )
    return resolve.resolve(wanted, found).select("query_id", "status", "n_candidates")


# Rules as relational queries


@_query("SELECT p_partkey, p_brand, p_type, p_size, rn AS occurrence FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type, p_size ORDER BY p_partkey) AS rn FROM part) WHERE rn > 1")
def duplicate_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("p_brand", "p_type", "p_size").orderBy("p_partkey"))
    return _table(spark, sf_dir, "part").withColumn("occurrence", n.cast("long")).where("occurrence > 1").select("p_partkey", "p_brand", "p_type", "p_size", "occurrence")


@_query("""SELECT 'events.user_id' AS rule, CAST(user_id AS VARCHAR) AS ref, count(*) AS n FROM events e WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = e.user_id) GROUP BY 2
UNION ALL SELECT 'lineitem.l_orderkey', CAST(l_orderkey AS VARCHAR), count(*) FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey) GROUP BY 2
UNION ALL SELECT 'documents.doc_id', CAST(doc_id AS VARCHAR), count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY 2""")
def unknown_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: _table(spark, sf_dir, name)
    checks = [("events", "user_id", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("documents", "doc_id", "labels", "doc_id")]
    found = None
    for rows, key, owner, own in checks:
        unknown = t(rows).select(F.col(key).alias("ref")).join(t(owner).select(F.col(own).alias("ref")), "ref", "left_anti")
        one = unknown.groupBy("ref").agg(F.count("*").alias("n")).select(F.lit(f"{rows}.{key}").alias("rule"), F.col("ref").cast("string").alias("ref"), "n")
        found = one if found is None else found.unionByName(one)
    return found


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: _table(spark, sf_dir, name)
    tag = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    parts = [
        t("orders").select(tag("c", "o_custkey").alias("src"), F.concat(F.lit("s"), "o_orderstatus").alias("dst")),
        t("customer").select(tag("c", "c_custkey").alias("src"), tag("n", "c_nationkey").alias("dst")),
        t("nation").select(tag("n", "n_nationkey").alias("src"), tag("r", "n_regionkey").alias("dst")),
        t("region").select(tag("r", "r_regionkey").alias("src"), F.lit("world").alias("dst")),
    ]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.distinct()


_EDGES = """WITH RECURSIVE e AS (SELECT DISTINCT 'c' || o_custkey AS src, 's' || o_orderstatus AS dst FROM orders UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION SELECT 'r' || r_regionkey, 'world' FROM region)"""


@_query(_EDGES + " SELECT src, dst FROM e")
def reference_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


@_query(_EDGES + ", p AS (SELECT src, dst FROM e UNION SELECT p.src, e.dst FROM p JOIN e ON e.src = p.dst) SELECT src, dst FROM p")
def dependency_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.closure(_edges(spark, sf_dir))


@_query(_EDGES + ", w AS (SELECT dst AS node, 0 AS level FROM e WHERE dst NOT IN (SELECT src FROM e) UNION SELECT e.src, w.level + 1 FROM w JOIN e ON e.dst = w.node) SELECT node, max(level) AS level FROM w GROUP BY node")
def dependency_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.levels(_edges(spark, sf_dir))


# Which event type asks for which operation, and under which profile a user works.
_OPERATIONS = [("signup", "extrude"), ("view", "thread"), ("purchase", "sweep"), ("error", "weld"), ("click", "fillet")]
_VALUES = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


@_query(f"""WITH ops(event_type, op) AS (VALUES {_VALUES(_OPERATIONS)}), allowed(profile, rank, op) AS (VALUES {_VALUES(profile_operations())})
SELECT event_id, 'P' || (1 + user_id % 4) AS profile, ops.op AS operation FROM events JOIN ops USING (event_type)
WHERE NOT EXISTS (SELECT 1 FROM allowed a WHERE a.rank = 1 + user_id % 4 AND a.op = ops.op)""")
def profile_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = F.broadcast(spark.createDataFrame(_OPERATIONS, "event_type string, operation string"))
    allowed = F.broadcast(spark.createDataFrame([(p, o) for p, _, o in profile_operations()], "profile string, operation string"))
    asked = _table(spark, sf_dir, "events").join(ops, "event_type").withColumn("profile", F.concat(F.lit("P"), (1 + F.col("user_id") % 4).cast("string")))
    return asked.join(allowed, ["profile", "operation"], "left_anti").select("event_id", "profile", "operation")


_PRIORITIES = "CASE o_orderpriority WHEN '1-URGENT' THEN 'kernel_tolerance' WHEN '2-HIGH' THEN 'gdt_zone' WHEN '3-MEDIUM' THEN 'dimensional_tolerance' WHEN '5-LOW' THEN NULL ELSE o_orderpriority END"


@_query(f"SELECT o_orderkey, {_PRIORITIES} AS tolerance FROM orders WHERE coalesce({_PRIORITIES} NOT IN ({', '.join(repr(t) for t in TOLERANCES)}), true)")
def tolerance_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.expr(_PRIORITIES)
    return _table(spark, sf_dir, "orders").select("o_orderkey", kind.alias("tolerance")).where(~F.coalesce(F.col("tolerance").isin(*TOLERANCES), F.lit(False)))


@_query("SELECT d.doc_id, d.lang FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE d.lang IN ('fr', 'es') AND l.doc_id IS NULL")
def missing_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return docs.where(F.col("lang").isin("fr", "es")).join(labels.select("doc_id"), "doc_id", "left_anti").select("doc_id", "lang")


@_query(f"""SELECT 'E101' AS code, CAST(p_partkey AS VARCHAR) AS subject FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand, p_type, p_size ORDER BY p_partkey) AS rn FROM part) WHERE rn > 1
UNION ALL SELECT 'E140', CAST(o_orderkey AS VARCHAR) FROM orders WHERE coalesce({_PRIORITIES} NOT IN ({', '.join(repr(t) for t in TOLERANCES)}), true)
UNION ALL SELECT 'E150', CAST(d.doc_id AS VARCHAR) FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE d.lang IN ('fr', 'es') AND l.doc_id IS NULL""")
def rule_diagnostics_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = [("E101", duplicate_declarations, "p_partkey"), ("E140", tolerance_category, "o_orderkey"), ("E150", missing_evidence, "doc_id")]
    found = [q(spark, sf_dir).select(F.lit(code).alias("code"), F.col(key).cast("string").alias("subject")) for code, q, key in sources]
    return found[0].unionByName(found[1]).unionByName(found[2])


_NAMES = [("width", 1), ("mm", 1), ("mm.x", 2), ("origin", 1), ("world.xy", 2), ("missing", 1), ("missing.top", 2), ("BUILDING", 1), ("AUTOMOBILE.faces", 2)]


@_query(f"""WITH refs(path, n) AS (VALUES {_VALUES(_NAMES)}), builtin(name) AS (VALUES {_VALUES([(b,) for b in BUILTINS])}), units(name) AS (VALUES {_VALUES([(u,) for u in UNITS])})
SELECT path FROM refs r WHERE split_part(path, '.', 1) NOT IN (SELECT DISTINCT c_mktsegment FROM customer) AND split_part(path, '.', 1) NOT IN (SELECT name FROM units)
AND NOT EXISTS (SELECT 1 FROM builtin b WHERE b.name = split_part(r.path, '.', 1) AND (r.n = 1 OR b.name = 'world'))""")
def unknown_names_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The side condition on built-in names as an anti-join with a theta condition."""
    refs = spark.createDataFrame(_NAMES, "path string, n int").withColumn("root", F.substring_index("path", ".", 1))
    symbols = _table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("root")).distinct()
    builtin = spark.createDataFrame([(b,) for b in BUILTINS], "name string")
    free = refs.join(symbols, "root", "left_anti").where(~F.col("root").isin(*UNITS))
    known = (F.col("name") == F.col("root")) & ((F.col("n") == 1) | (F.col("name") == "world"))
    return free.join(F.broadcast(builtin), known, "left_anti").select("path")


# Trust


_SEVERITY = "CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warning' ELSE 'info' END"


@_query(f"SELECT user_id AS register_id, count(*) AS n_records, bool_or({_SEVERITY} IN ('error', 'fatal')) AS blocks_commit FROM events GROUP BY 1")
def loss_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _table(spark, sf_dir, "events").select(F.col("user_id").alias("register_id"), F.expr(_SEVERITY).alias("severity"))
    return trust.roll_up(records.select("register_id").distinct(), records)


@_query("SELECT doc_id, sha256(text) AS digest, regexp_full_match(sha256(text), '[0-9a-f]{64}') AS valid FROM documents UNION ALL SELECT doc_id, upper(sha256(text)), regexp_full_match(upper(sha256(text)), '[0-9a-f]{64}') FROM documents")
def evidence_digest_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    digests = _table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    both = digests.unionByName(digests.withColumn("digest", F.upper("digest")))
    return both.withColumn("valid", is_digest(F.col("digest")))


_DECISIONS = """SELECT doc_id, CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'accepted' ELSE 'proposed' END AS status, CAST(doc_id % 13 - 1 AS DOUBLE) / 10 AS confidence,
doc_id % 3 AS n_evidence, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'reviewer' END AS actor FROM labels"""


@_query(f"""WITH d AS ({_DECISIONS}) SELECT doc_id, concat_ws(',', CASE WHEN confidence < 0 OR confidence > 1 THEN 'confidence' END, CASE WHEN status = 'accepted' AND n_evidence = 0 THEN 'evidence' END,
CASE WHEN status = 'accepted' AND actor = '' THEN 'actor' END, CASE WHEN status = 'proposed' THEN 'status' END) AS violations FROM d""")
def decision_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels")
    status = F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "accepted").otherwise("proposed")
    ids = F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array_repeat(F.lit("e"), (F.col("doc_id") % 3).cast("int")))
    decisions = labels.select("doc_id", status.alias("status"), ((F.col("doc_id") % 13 - 1) / 10).alias("confidence"), ids.alias("evidence_ids"), F.when(F.col("doc_id") % 5 == 0, "").otherwise("reviewer").alias("decided_by"))
    return trust.check_decisions(decisions).select("doc_id", F.array_join("violations", ",").alias("violations"))


# Identities


_UUID = """substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + instr('0123456789abcdef', substr(h, 17, 1)) % 4 - CASE WHEN instr('0123456789abcdef', substr(h, 17, 1)) % 4 = 0 THEN -3 ELSE 1 END, 1)
|| substr(h, 18, 3) || '-' || substr(h, 21, 12)"""


@_query(f"""WITH p AS (SELECT 'local/' || r_name AS path FROM region UNION ALL SELECT 'local/' || r_name || '/' || n_name FROM nation JOIN region ON r_regionkey = n_regionkey),
h AS (SELECT path, sha1(unhex('22b8aa1ea0375d7b89f8b7af0c8fc2ad') || encode(path)) AS h FROM p) SELECT path, {_UUID} AS id FROM h""")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation = _table(spark, sf_dir, "region"), _table(spark, sf_dir, "nation")
    tops = region.select(F.concat(F.lit("local/"), "r_name").alias("path"))
    below = nation.join(F.broadcast(region), F.col("r_regionkey") == F.col("n_regionkey")).select(F.concat(F.lit("local/"), "r_name", F.lit("/"), "n_name").alias("path"))
    return tops.unionByName(below).select("path", stable_uuid(F.col("path")).alias("id"))


@_query("SELECT c_custkey, sha256(concat_ws('#', CAST(c_custkey AS VARCHAR), c_mktsegment, c_name, CAST(c_nationkey AS VARCHAR))) AS digest FROM customer")
def canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["c_custkey", "c_mktsegment", "c_name", "c_nationkey"]  # by name
    return _table(spark, sf_dir, "customer").select("c_custkey", F.sha2(F.concat_ws("#", *fields), 256).alias("digest"))


# Revisions


@_query("SELECT user_id, event_id, row_number() OVER w - 1 AS number, lag(event_id) OVER w AS base_event FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def revision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _table(spark, sf_dir, "events").select("user_id", "event_id", (F.row_number().over(w) - 1).cast("long").alias("number"), F.lag("event_id").over(w).alias("base_event"))


@_query("SELECT user_id, event_id FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NOT NULL AND before <> event_type")
def revision_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return _table(spark, sf_dir, "events").withColumn("before", before).where("before <> event_type").select("user_id", "event_id")


@_query("SELECT user_id AS store_id, event_id, event_type AS message FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def current_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("r")
    return _table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("store_id")).agg(latest).select("store_id", F.col("r.event_id").alias("event_id"), F.col("r.event_type").alias("message"))


# Sources: one small document per part, parsed and checked


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    text = F.format_string('lang 0.1;\nmodel m%d [profile = "P1"] {\n  parameter size: length = %d mm;\n  parameter twice: length = size + size;\n  feature f: %s { distance = twice; }\n}\n', "p_partkey", "p_size", F.when(F.col("p_size") > 40, "sweep").otherwise("extrude"))
    return part.select(F.col("p_partkey").cast("string").alias("doc_id"), F.lit(None).cast("string").alias("uri"), text.alias("source_text"))


@_query("SELECT CAST(p_partkey AS VARCHAR) AS doc_id, 'LANG-E120' AS code FROM part WHERE p_size > 40")
def document_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.diagnostics(parse_documents(_sources(spark, sf_dir))).select("doc_id", "code")


@_query("SELECT CAST(p_partkey AS VARCHAR) AS doc_id, p_size <= 40 AS ok FROM part")
def document_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.validity(parse_documents(_sources(spark, sf_dir)))


@_query("SELECT CAST(p_partkey AS VARCHAR) AS doc_id, x.src, x.dst FROM part, (VALUES ('twice', 'size'), ('f', 'twice')) x(src, dst)")
def document_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.edges(parse_documents(_sources(spark, sf_dir))).select("doc_id", "src", "dst")


@_query("SELECT CAST(p_partkey AS VARCHAR) AS doc_id, CAST(40 AS BIGINT) AS n_tokens FROM part")
def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(_sources(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("n_tokens"))


_CONTRACT = json.dumps(EXECUTION_CONTRACT, sort_keys=True, separators=(",", ":"))


@_query(f"""WITH p AS (SELECT p_partkey, p_size, unnest(['', '/size', '/twice', '/f', '/f/distance']) AS tail FROM part),
h AS (SELECT *, sha1(unhex('22b8aa1ea0375d7b89f8b7af0c8fc2ad') || encode('local/m' || p_partkey || tail)) AS h FROM p), u AS (SELECT *, {_UUID} AS id FROM h),
d AS (SELECT p_partkey, p_size, max(id) FILTER (tail = '') AS m, max(id) FILTER (tail = '/size') AS s, max(id) FILTER (tail = '/twice') AS t, max(id) FILTER (tail = '/f') AS f, max(id) FILTER (tail = '/f/distance') AS a FROM u GROUP BY 1, 2)
SELECT CAST(p_partkey AS VARCHAR) AS doc_id, sha256('{{"execution_contract":{_CONTRACT},"format":"lang.canonical-construction-graph","format_version":"0.1","imports":[],"models":[{{"attributes":{{"profile":{{"kind":"literal","value":"P1"}}}},"declarations":['
|| '{{"id":"' || s || '","kind":"parameter","name":"size","type":"length","value":{{"kind":"literal","unit":"mm","value":' || p_size || '}}}},'
|| '{{"id":"' || t || '","kind":"parameter","name":"twice","type":"length","value":{{"kind":"binary","left":{{"kind":"reference","path":"size"}},"operator":"+","right":{{"kind":"reference","path":"size"}}}}}},'
|| '{{"body":[{{"id":"' || a || '","kind":"assign","name":"distance","value":{{"kind":"reference","path":"twice"}}}}],"id":"' || f || '","kind":"feature","name":"f","type":"' || CASE WHEN p_size > 40 THEN 'sweep' ELSE 'extrude' END || '"}}'
|| '],"dependency_order":["size","twice","f"],"id":"' || m || '","name":"m' || p_partkey || '"}}],"namespace":"local","source_language":"lang/0.1"}}') AS semantic_sha256, '' AS violations FROM d""")
def document_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and contract checks of canonical graphs."""
    parsed = parse_documents(_sources(spark, sf_dir))
    return contracts.check_graphs(parsed).select("doc_id", "semantic_sha256", F.array_join("violations", ",").alias("violations"))


# Faults: a document with each, and the code, line and column of each diagnostic that it must have

_FAULTS = [
    ('lang 0.1;\nmodel m {\n  a = "x\n; }', [("E000", 3, 7)]), ("lang 0.1;\nmodel m {\n  parameter size length;\n}", [("E010", 3, 18)]),
    ("lang 0.2;\nmodel m { }", [("E001", 1, 1)]), ('lang 0.1;\nmodel m [profile = "P0"] { }', [("E100", 2, 1)]),
    ("lang 0.1;\nmodel m {\n  constant a = 1;\n  datum a = 2;\n}", [("E101", 4, 3)]), ("lang 0.1;\nmodel m {\n  feature f: hole { x = missing.top; }\n}", [("E102", 3, 25)]),
    ("lang 0.1;\nmodel m {\n  constant a = b;\n  constant b = a;\n}", [("E103", 4, 3)]), ("lang 0.1;\nmodel m {\n  parameter a: length = 3 deg;\n}", [("E110", 3, 25)]),
    ("lang 0.1;\nmodel m {\n  feature f: thread { }\n}", [("E120", 3, 3)]), ("lang 0.1;\nmodel m {\n  reference r: face = 3;\n}", [("E130", 3, 3)]),
    ('lang 0.1;\nmodel m {\n  reference r: face = select(z, role = "a", area = 1);\n}', [("E131", 3, 23)]),
    ('lang 0.1;\nmodel m {\n  reference r: face = select(role = "a", area = 1, cardinality = one);\n}', [("E132", 3, 23)]),
    ("lang 0.1;\nmodel m {\n  reference r: face = select(z, area = 1, cardinality = one);\n}", [("E133", 3, 23)]),
    ('lang 0.1;\nmodel m {\n  reference r: face = select(z, role = "a", cardinality = one);\n}', [("E134", 3, 23)]),
    ("lang 0.1;\nmodel m {\n  tolerance t = 1 mm;\n}", [("E140", 3, 3)]), ("lang 0.1;\nmodel m {\n  material a [status = inferred];\n}", [("E150", 3, 3)]),
    ("lang 0.1;\n/* all is well */ model m { // here too\n  constant a = -2.5e1 * 3;\n}", []),
    ("lang 0.1;\nmodel m {\n  parameter a: length = b;\n  parameter a: length = 1;\n  feature f: weld { x = q.y; }\n}", [("E101", 4, 3), ("E102", 3, 25), ("E102", 5, 25), ("E120", 5, 3)]),
]
_FAULT_ROWS = [(k, code, line, column) for k, (_, found) in enumerate(_FAULTS) for code, line, column in found]


def _faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each order, with one fault or several by its key."""
    texts = F.array(*(F.lit(text) for text, _ in _FAULTS))
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("doc_id"), F.lit(None).cast("string").alias("uri"), F.get(texts, (F.col("p_partkey") % len(_FAULTS)).cast("int")).alias("source_text"))


@_query(f"""SELECT CAST(p_partkey AS VARCHAR) AS doc_id, CASE WHEN code IN ('E000', 'E010') THEN 'SOURCE-' ELSE 'LANG-' END || code AS code, line, "column"
FROM part JOIN (VALUES {_VALUES(_FAULT_ROWS)}) x(k, code, line, "column") ON p_partkey % {len(_FAULTS)} = k""")
def rule_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sixteen codes, with their places."""
    found = rules.diagnostics(parse_documents(_faulty(spark, sf_dir)))
    return found.select("doc_id", "code", F.col("span.line").alias("line"), F.col("span.column").alias("column"))


@_query(f"""SELECT code, count(*) AS n FROM (SELECT CASE WHEN code IN ('E000', 'E010') THEN 'SOURCE-' ELSE 'LANG-' END || code AS code
FROM part JOIN (VALUES {_VALUES(_FAULT_ROWS)}) x(k, code, line, "column") ON p_partkey % {len(_FAULTS)} = k) GROUP BY 1""")
def rule_code_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.diagnostics(parse_documents(_faulty(spark, sf_dir))).groupBy("code").agg(F.count("*").alias("n"))


# The ledger: a store for each customer, and what must come of each event (seq, transaction, action, message, what the
# graph holds beyond the customer's key; outcome, number, position, what the current graph holds)
_SCRIPT = [
    (1, "", "init", "", 0, "ok", 0, 0, 0), (2, "t1", "begin", "", -1, "ok", 0, 0, 0), (3, "t2", "begin", "", -1, "ok", 0, 0, 0), (4, "t1", "commit", "one", 1, "ok", 1, 1, 1),
    (5, "t2", "commit", "two", 5, "conflict", 1, 1, 1), (6, "", "undo", "", -1, "ok", 0, 0, 0), (7, "", "undo", "", -1, "error", 0, 0, 0), (8, "", "redo", "", -1, "ok", 1, 1, 1),
    (9, "t3", "begin", "", -1, "ok", 1, 1, 1), (10, "", "undo", "", -1, "ok", 0, 0, 0), (11, "t4", "begin", "", -1, "ok", 0, 0, 0), (12, "t4", "commit", "other", 2, "ok", 1, 1, 2),
    (13, "", "redo", "", -1, "error", 1, 1, 2), (14, "t3", "commit", "stale", 6, "conflict", 1, 1, 2), (15, "t3", "rollback", "", -1, "ok", 1, 1, 2), (16, "t3", "rollback", "", -1, "error", 1, 1, 2),
    (17, "t9", "commit", "unknown", 7, "error", 1, 1, 2), (18, "t5", "begin", "", -1, "ok", 1, 1, 2), (19, "t5", "commit", "  ", 8, "error", 1, 1, 2), (20, "t5", "commit", "kept", -1, "ok", 2, 2, 2),
]


@_query(f"""WITH s(seq, txn, act, msg, held, outcome, num, pos, now) AS (VALUES {_VALUES(_SCRIPT)}), e AS (SELECT * FROM customer, s WHERE NOT (seq = 1 AND c_custkey % 5 = 0))
SELECT CAST(c_custkey AS VARCHAR) AS store_id, CAST(seq AS BIGINT) AS seq, CASE WHEN c_custkey % 5 = 0 THEN 'error' ELSE outcome END AS outcome, CASE WHEN c_custkey % 5 <> 0 THEN num END AS number,
CASE WHEN c_custkey % 5 <> 0 THEN pos END AS position, CASE WHEN c_custkey % 5 <> 0 THEN sha256('{{"v":' || (c_custkey + now) || '}}') END AS semantic_sha256 FROM e""")
def ledger_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores of customers whose key 5 divides have no first event."""
    kinds = "seq long, txn_id string, action string, message string, held int, outcome string, number int, position int, now int"
    script = F.broadcast(spark.createDataFrame(_SCRIPT, kinds).select("seq", "txn_id", "action", "message", "held"))
    stores = _table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(len(_SCRIPT)).cast("long"))).alias("seq"))
    graph_json = F.when(F.col("held") >= 0, F.format_string('{"v": %d}', F.col("c_custkey") + F.col("held")))
    events = stores.join(script, "seq").where("not (seq = 1 and c_custkey % 5 = 0)").withColumn("graph_json", graph_json)
    return ledger.replay(events.select(F.col("c_custkey").cast("string").alias("store_id"), *ledger.EVENT[1:]))


# Contracts with faults


def _varied(key: str, texts: list[str]):
    return F.get(F.array(*map(F.lit, texts)), (F.col(key) % len(texts)).cast("int"))


def _register(records: list[dict], blocks: object = False, **more) -> str:
    return json.dumps({"schema": "lang.loss-register/0.1", "operation": "export", "source_backend": "a", "target_backend": "b", "blocks_commit": blocks, "records": records} | more)


_LOSS = {"code": "LOSS.X", "category": "geometry", "severity": "warning", "subject": "s", "message": "m", "source_capability": None, "target_capability": None, "mitigation": None, "reversible": True}
_REGISTERS = [
    (_register([]), ""), (_register([_LOSS, _LOSS | {"severity": "fatal"}], True), ""), (_register([_LOSS | {"severity": "error"}]), "blocks"), (_register([], extra=1), "unknown,shape"),
    (_register([_LOSS | {"more": 1}]), "shape"), (_register([{k: v for k, v in _LOSS.items() if k != "reversible"}]), "shape"), (_register([_LOSS | {"code": "x"}]), "records"),
    (_register([_LOSS | {"category": "weather"}]), "records"), (_register([_LOSS | {"reversible": "no"}], None), "shape"), ('{"records": []}', "missing,shape"),
]


@_query(f"SELECT o_orderkey, violations FROM orders JOIN (VALUES {_VALUES([(k, v) for k, (_, v) in enumerate(_REGISTERS)])}) x(k, violations) ON o_orderkey % {len(_REGISTERS)} = k")
def register_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", _varied("o_orderkey", [t for t, _ in _REGISTERS]).alias("json"))
    return contracts.check_registers(rows).select("o_orderkey", F.array_join("violations", ",").alias("violations"))


def _graph(contract: dict | None = None, expression: dict | None = None, order: tuple[str, ...] = ("a",), node: dict | None = None, **more) -> str:
    value = expression or {"kind": "unary", "operator": "-", "operand": {"kind": "literal", "value": 1, "unit": "mm"}}
    declared = {"id": "n", "kind": "feature", "name": "a", "body": [{"id": "i", "kind": "assign", "name": "x", "value": value}]} | (node or {})
    model = {"id": "m", "name": "m", "attributes": {}, "dependency_order": list(order), "declarations": [declared]}
    whole = {"format": "lang.canonical-construction-graph", "format_version": "0.1", "source_language": "lang/0.1", "namespace": "local", "imports": [{"source": "x"}], "models": [model]}
    return json.dumps(whole | {"execution_contract": contract or EXECUTION_CONTRACT, "semantic_sha256": "0" * 64} | more)


_DEEP: dict = {"kind": "literal", "value": 1}
for _ in range(40):
    _DEEP = {"kind": "list", "items": [{"kind": "binary", "operator": "+", "left": _DEEP, "right": {"kind": "reference", "path": "p"}}]}
_GRAPHS = [
    (_graph(), ""), (_graph(expression=_DEEP), ""), (_graph(expression={"kind": "guess"}), "shape"), (_graph(expression={"kind": "unary", "operator": "-", "operand": {"value": 1}}), "shape"),
    (_graph(node={"extra": 1}), "shape"), (_graph(node={"body": [{"kind": "assign"}]}), "shape"), (_graph(EXECUTION_CONTRACT | {"numeric_mode": "any"}), "contract"),
    (_graph(EXECUTION_CONTRACT | {"more": 1}), "contract"), (_graph(order=("a", "a")), "order"), (_graph(models=[]), "models"), (_graph(semantic_sha256="A" * 64), "digest"),
    (_graph(format_version="0.2"), "version"), (_graph(imports=[{"alias": "y"}]), "shape"), ("not json", "missing,version,digest,models,contract,shape"),
]


@_query(f"SELECT s_suppkey, violations FROM supplier JOIN (VALUES {_VALUES([(k, v) for k, (_, v) in enumerate(_GRAPHS)])}) x(k, violations) ON s_suppkey % {len(_GRAPHS)} = k")
def graph_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "supplier").select("s_suppkey", _varied("s_suppkey", [t for t, _ in _GRAPHS]).alias("canonical_json"))
    return contracts.check_graphs(rows).select("s_suppkey", F.array_join("violations", ",").alias("violations"))


def _manifest(entry: dict, qualification: dict, operations: tuple = ()) -> str:
    return json.dumps(dict.fromkeys(contracts.MANIFEST_FIELDS, 1) | {"entrypoint": entry, "qualification": qualification, "operations": list(operations)})


_WORKER, _DRAFT = {"mode": "worker", "command": ["x"]}, {"status": "draft"}
_MANIFESTS = [
    (_manifest(_WORKER, _DRAFT), ""), (_manifest({"mode": "worker"}, _DRAFT), "entry"), (_manifest({"mode": "in_process", "native_library": "l"}, _DRAFT), ""), (_manifest({"mode": "in_process", "command": []}, _DRAFT), "entry"),
    (_manifest({"mode": "service", "endpoint": "e"}, {"status": "candidate", "suite_version": "1", "report_uri": "u"}), "qualification"), (_manifest({"mode": "service"}, {"status": "candidate", "suite_version": "1", "report_uri": "u", "tested_at": "t"}), "entry"),
    (_manifest(_WORKER, _DRAFT, ({"support": "fallback"}, {"support": "exact"})), "loss code"), (_manifest(_WORKER, _DRAFT, ({"support": "approximate", "loss_code": "LOSS.X"},)), ""),
]


@_query(f"SELECT c_custkey, violations FROM customer JOIN (VALUES {_VALUES([(k, v) for k, (_, v) in enumerate(_MANIFESTS)])}) x(k, violations) ON c_custkey % {len(_MANIFESTS)} = k")
def manifest_violations_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").select("c_custkey", _varied("c_custkey", [t for t, _ in _MANIFESTS]).alias("json"))
    return contracts.check_manifests(rows).select("c_custkey", F.array_join("violations", ",").alias("violations"))


# Beyond the reference


@_query("SELECT d.lang, count(*) AS n, CAST(sum(l.quality) AS BIGINT) AS passed, CAST(sum(l.quality) * 100 >= 95 * count(*) AS BOOLEAN) AS gate FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1")
def gate_pass_rates_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = _table(spark, sf_dir, "documents").select("doc_id", "lang").join(_table(spark, sf_dir, "labels"), "doc_id")
    by = joined.groupBy("lang").agg(F.count("*").alias("n"), F.sum("quality").cast("long").alias("passed"))
    return by.withColumn("gate", F.col("passed") * 100 >= 95 * F.col("n"))


@_query("SELECT DISTINCT source, lang FROM documents t WHERE doc_id % 7 = 0 AND EXISTS (SELECT 1 FROM documents o WHERE o.source = t.source AND o.lang = t.lang AND o.doc_id % 7 <> 0)")
def split_leakage_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families (source and language) that stand on both sides of a split by id."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    test, train = docs.where("doc_id % 7 = 0").select("source", "lang").distinct(), docs.where("doc_id % 7 <> 0").select("source", "lang").distinct()
    return test.join(train, ["source", "lang"], "left_semi")


@_query("SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'removed' ELSE 'changed' END AS change FROM part WHERE p_partkey % 7 = 0 OR p_size > 45")
def drift_compare_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    new = old.where("p_partkey % 7 <> 0").withColumn("p_size", F.when(F.col("p_size") > 45, 0).otherwise(F.col("p_size")))
    return contracts.drift(old, new, ["p_partkey"])


@_query("SELECT x.backend, x.operation FROM (SELECT DISTINCT c_mktsegment AS backend, o_orderpriority AS operation FROM customer JOIN orders ON o_custkey = c_custkey) x WHERE NOT (length(x.backend) >= 9 OR x.operation LIKE '1%')")
def unsupported_operations_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    asked = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("backend"), F.col("o_orderpriority").alias("operation")).distinct()
    return contracts.unsupported(asked, asked.where("length(backend) >= 9 OR operation LIKE '1%'"))


_OUTCOME = "CASE event_type WHEN 'error' THEN 'fail' WHEN 'click' THEN 'skipped' WHEN 'signup' THEN 'warning' WHEN 'view' THEN 'not_applicable' ELSE 'pass' END"


@_query(f"""SELECT report_id, CASE WHEN bool_or(o = 'fail' OR (o = 'skipped' AND mandatory)) THEN 'fail' WHEN bool_or(o = 'warning') THEN 'warning' WHEN bool_or(o <> 'not_applicable') THEN 'pass' ELSE 'not_applicable' END AS verdict, count(*) AS n
FROM (SELECT event_id // 3 AS report_id, {_OUTCOME} AS o, event_id % 2 = 0 AS mandatory FROM events) GROUP BY 1""")
def report_verdicts_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = _table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 3).alias("report_id"), F.expr(_OUTCOME).alias("outcome"), (F.col("event_id") % 2 == 0).alias("mandatory"))
    return quality.verdicts(checks)


@_query("SELECT lang, source, count(*) AS n, count(*) FILTER (n_chars > 1000) AS passed, CAST(grouping(lang, source) AS BIGINT) AS level FROM documents GROUP BY CUBE (lang, source)")
def qualification_matrix_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.matrix(_table(spark, sf_dir, "documents").select("lang", "source", "n_chars"), ["lang", "source"], F.col("n_chars") > 1000)


@_query("SELECT o_orderpriority, quantile_cont(o_custkey, 0.5) AS p50, quantile_cont(o_custkey, 0.95) AS p95, count(*) AS n FROM orders GROUP BY 1")
def gate_percentiles_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.latencies(_table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_custkey")


@_query("SELECT count(*) AS n, count(*) FILTER (hit) AS hits FROM (SELECT p_brand, bool_or(place <= 5 AND p_size > 45) AS hit FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS place FROM part) GROUP BY 1)")
def recall_at_five_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _table(spark, sf_dir, "part").select(F.col("p_brand").alias("query_id"), F.col("p_partkey").alias("identity"), F.col("p_retailprice").alias("score"), (F.col("p_size") > 45).alias("relevant"))
    return quality.recall_at(ranked, 5)


@_query("SELECT CAST(p_partkey AS VARCHAR) AS doc_id, 'size' AS name FROM part WHERE p_size > 40 OR p_size < 10")
def parameter_domains_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes in millimetres against bounds in centimetres and metres."""
    text = F.format_string("lang 0.1;\nmodel m { parameter size: length = %d mm [min = 1 cm, max = 0.04 m]; }\n", "p_size")
    docs = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("doc_id"), text.alias("source_text"))
    return quality.out_of_domain(parse_documents(docs)).select("doc_id", "name")


@_query("SELECT c_custkey FROM customer WHERE c_custkey % 11 = 0 OR c_custkey % 5 = 0")
def backend_differences_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    two = one.where("c_custkey % 11 <> 0").withColumn("c_acctbal", F.col("c_acctbal") + F.when(F.col("c_custkey") % 5 == 0, 1.0).otherwise(0.001))
    return quality.differences(one, two, ["c_custkey"], "c_acctbal", 0.01).select("c_custkey")


def _scenario_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string("lang 0.1;\nmodel m { parameter size: length = %d mm; parameter twice: length = size * 2 + 1 cm; validate { assert twice < 9 cm; scenario Large { set size = 45 mm; expect twice == 10 cm; } } }\n", "p_size")
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("doc_id"), text.alias("source_text"))


@_query("SELECT CAST(p_partkey AS VARCHAR) AS doc_id, CAST(2 * p_size + 10 AS BIGINT) AS millimetres, 'length' AS dimension FROM part")
def parameter_values_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scenarios.values(_scenario_sources(spark, sf_dir)).where("name = 'twice'")
    return found.select("doc_id", (F.col("value").cast("decimal(38,18)") * 1000).cast("long").alias("millimetres"), "dimension")


@_query("SELECT CAST(p_partkey AS VARCHAR) AS doc_id, '' AS scenario, CASE WHEN 2 * p_size + 10 < 90 THEN 'pass' ELSE 'fail' END AS verdict FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'Large', 'pass' FROM part")
def scenario_verdicts_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenarios.run_scenarios(_scenario_sources(spark, sf_dir)).select("doc_id", F.coalesce("scenario", F.lit("")).alias("scenario"), "verdict")


@_query(_EDGES + f""", w AS (SELECT dst AS node, 0 AS level FROM e WHERE dst NOT IN (SELECT src FROM e) UNION SELECT e.src, w.level + 1 FROM w JOIN e ON e.dst = w.node), l AS (SELECT node, max(level) AS level FROM w GROUP BY node),
h AS (SELECT *, sha1(unhex('22b8aa1ea0375d7b89f8b7af0c8fc2ad') || encode(node)) AS h FROM l), u AS (SELECT node, level, {_UUID} AS id FROM h) SELECT node, level, id FROM u""")
def commit_order_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    ids = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("id", stable_uuid(F.col("node")))
    return graph.commit_order(edges, ids)


@_query("""WITH v AS (SELECT p_partkey, rtrim(rtrim(CAST(CAST(p_size * CAST(0.001 AS DECIMAL(4, 3)) AS DECIMAL(38, 20)) AS VARCHAR), '0'), '.') AS v FROM part), x AS (SELECT p_partkey, unnest(['a', 'b']) AS name, v FROM v)
SELECT CAST(p_partkey AS VARCHAR) AS doc_id, name, sha256('6:length;' || length(v) || ':' || v || ';') AS digest FROM x""")
def value_digests_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same length in millimetres and in centimetres has one digest."""
    text = F.format_string("lang 0.1;\nmodel m { constant a = %d.0 mm; constant b = %s cm; }\n", "p_size", (F.col("p_size").cast("decimal(10,0)") / 10).cast("decimal(10,1)").cast("string"))
    docs = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("doc_id"), text.alias("source_text"))
    return part(parse_documents(docs), "nodes").select("doc_id", "name", value_digest(F.col("value")).alias("digest"))


@_query("""WITH p AS (SELECT (event_id % 100) / 100.0 AS c, CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS a FROM events), b AS (SELECT least(floor(c * 10), 9) AS bin, count(*) AS m, avg(c) AS c, avg(a) AS a FROM p GROUP BY 1)
SELECT round(sum(m * abs(c - a)) / sum(m), 6) AS ece, CAST(sum(m) AS BIGINT) AS n FROM b""")
def calibration_error_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select(((F.col("event_id") % 100) / 100).alias("confidence"), (F.col("user_id") % 3 == 0).alias("correct"))
    return quality.calibration_error(rows).select(F.round("ece", 6).alias("ece"), "n")


@_query("""WITH RECURSIVE c AS (SELECT p_partkey AS src, p_partkey + 1 AS dst FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 5 = 0 UNION SELECT p_partkey, p_partkey + 2 FROM part WHERE p_partkey % 5 = 0), s AS (SELECT src FROM c UNION SELECT p_partkey FROM part WHERE p_partkey % 11 = 0),
p AS (SELECT src, dst FROM c UNION SELECT p.src, c.dst FROM p JOIN c ON c.src = p.dst), n AS (SELECT s.src AS origin, count(DISTINCT p.dst) AS n FROM s LEFT JOIN p ON p.src = s.src AND p.dst NOT IN (SELECT src FROM s) GROUP BY 1)
SELECT origin, CASE n WHEN 0 THEN 'missing' WHEN 1 THEN 'unique' ELSE 'ambiguous' END AS status, n AS n_candidates FROM n""")
def lineage_successors_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that were changed, split in two, or deleted."""
    key, rows = F.col("p_partkey"), _table(spark, sf_dir, "part")
    to = F.when(key % 5 == 0, F.array(key + 1, key + 2)).when(key % 3 == 0, F.array(key + 1))
    changed = rows.where(to.isNotNull()).select(key.alias("source"), F.explode(to).alias("target"))
    gone = rows.where(key % 11 == 0).select(key.alias("source"), F.lit(None).cast(dict(changed.dtypes)["target"]).alias("target"))
    return graph.successors(changed.unionByName(gone))
