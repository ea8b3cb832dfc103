"""Queries of content governance and of log integrity."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import scratch
from ..operators import events as E
from ..operators import governance as G
from ..operators import integrity as I
from ..operators import listed as L
from .catalog import query
from .views import EVENTS_SQL, audit_events, table

#: Filler of the samples.
_HEX = hashlib.sha256(b"ledgerloom sample").hexdigest()
#: Made-up secrets of every shape, put after each document (the documents hold few shapes).
PARTS = {
    "private key": f"-----BEGIN TEST PRIVATE KEY-----\n{_HEX}\n-----END TEST PRIVATE KEY-----",
    "bearer": f"Authorization: Bearer {_HEX[:12]}.",
    "conn": f"postgres://bob:{_HEX[:8]}@db/x",
    "gh": f"ghp_{'A' * 24}",
    "sk": f"sk-{_HEX[:22]}",
    "jwt": f"eyJ{'a' * 8}.eyJ{'b' * 8}.{'c' * 10}",
    "google": f"AIza{'D' * 35}",
    "slack": f"xoxb-{'1' * 10}-abc",
    "aws": f"AKIA{'B' * 16}",
    "json": '"api_key": "top secret value"',
    "plain": f"token: short password={_HEX[:7]}",
}
SAMPLES = " ; ".join(PARTS.values())


def _bodies(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", "text")


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _re2(pattern: str) -> str:
    return _sql(pattern)


def _shapes_sql(text: str) -> str:
    for _, pattern, marker in G.SHAPES:
        text = f"regexp_replace({text}, {_re2(pattern)}, {_sql(marker.replace('$1', chr(92) + '1'))}, 'g')"
    return text


SHAPED = _shapes_sql("concat(text, ' ; ', " + _sql(SAMPLES) + ")")


@query("SELECT doc_id, " + SHAPED + " AS text FROM documents")
def r_known_shapes(s: SparkSession, d: str) -> DataFrame:
    """r2 to r6 on whole texts, each followed by samples of every shape; r_known_shapes_whole has the texts alone."""
    return _bodies(s, d).select("doc_id", G.known_shapes(F.concat("text", F.lit(" ; " + SAMPLES))).alias("text"))


@query("SELECT doc_id, " + _shapes_sql("text") + " AS text FROM documents")
def r_known_shapes_whole(s: SparkSession, d: str) -> DataFrame:
    """r2 to r6: every shape of secret in order, over whole texts."""
    return _bodies(s, d).select("doc_id", G.known_shapes(F.col("text")).alias("text"))


@query("SELECT doc_id, length(text) - length(replace(text, ' the ', '')) AS n, replace(replace(text, 'password=', '[REDACTED:env]'), 'token = ', '[REDACTED:env]') AS text FROM documents")
def r1_literal_secrets(s: SparkSession, d: str) -> DataFrame:
    """Listed values only, longest first."""
    text = F.col("text")
    n = F.length(text) - F.length(F.replace(text, F.lit(" the "), F.lit("")))
    return _bodies(s, d).select("doc_id", n.cast("long").alias("n"), G.literal_secrets(text, ("token = ", "password=", "short")).alias("text"))


@query("SELECT doc_id, replace(replace(text, 'password=', '[REDACTED:env]'), 'token = ', '[REDACTED:env]') AS text FROM documents")
def r1_listed_values(s: SparkSession, d: str) -> DataFrame:
    """A list of 20,002 values over whole texts, two of which occur."""
    return L.redact_listed(_bodies(s, d), "text", ["token = ", "password=", "short", *(f"no such value {k}" for k in range(20_000))])


@query("SELECT doc_id, regexp_replace(regexp_replace(text, 'password=([^\\s\"'']+)[\"'']?', 'password=[REDACTED:secret]', 'g'), 'token = \"([0-9a-f]{40})\"', 'token=[REDACTED:secret]', 'g') AS text FROM (SELECT doc_id, regexp_replace(text, 'AKIA[0-9A-Z]{16}', '[REDACTED:aws-access-key]', 'g') AS text FROM documents)")
def r8_assignments(s: SparkSession, d: str) -> DataFrame:
    """r7 to r9: all rules over whole texts; the SQL names the two assignment forms that the documents hold."""
    return _bodies(s, d).select("doc_id", G.redacted(F.col("text")).alias("text"))


@query("SELECT doc_id, len(regexp_extract_all(text, 'password=[^\\s]+')) + len(regexp_extract_all(text, 'token = \"[0-9a-f]{40}\"')) + len(regexp_extract_all(text, 'AKIA[0-9A-Z]{16}')) AS hits FROM documents")
def r10_hit_count(s: SparkSession, d: str) -> DataFrame:
    return _bodies(s, d).select("doc_id", G.hits(F.col("text")).alias("hits"))


@query("SELECT * FROM (SELECT doc_id, len(regexp_extract_all(text, 'AKIA[0-9A-Z]{16}')) AS aws_access_key, len(regexp_extract_all(text, 'password=[^\\s]+')) + len(regexp_extract_all(text, 'token = \"[0-9a-f]{40}\"')) AS secret FROM documents) WHERE aws_access_key + secret > 0")
def r11_secret_scan(s: SparkSession, d: str) -> DataFrame:
    return G.secret_scan(_bodies(s, d), "text").select("doc_id", "aws_access_key", "secret")


@query("SELECT CAST(sum(len(regexp_extract_all(text, 'AKIA[0-9A-Z]{16}'))) AS BIGINT) AS aws_access_key, CAST(sum(len(regexp_extract_all(text, 'password=[^\\s]+'))) + sum(len(regexp_extract_all(text, 'token = \"[0-9a-f]{40}\"'))) AS BIGINT) AS secret FROM documents")
def a26_redaction_summary(s: SparkSession, d: str) -> DataFrame:
    clean = _bodies(s, d).select(G.redacted(F.col("text")).alias("t"))
    count = lambda kind: F.sum(F.regexp_count("t", F.lit(rf"\[REDACTED:{kind}\]"))).alias(kind.replace("-", "_"))
    return clean.agg(count("aws-access-key"), count("secret"))


@query("SELECT doc_id, concat('sha256:', sha256(text)) AS hash FROM documents")
def b1_content_hash(s: SparkSession, d: str) -> DataFrame:
    return _bodies(s, d).select("doc_id", G.content_hash(F.col("text")).alias("hash"))


@query("SELECT doc_id, CASE WHEN strlen(text) < 1024 THEN text ELSE concat('sha256:', sha256(text)) END AS body, text AS command, CASE WHEN strlen(text) < 1024 THEN '' ELSE concat('sha256:', sha256(text)) END AS refs FROM documents")
def b2_externalize_threshold(s: SparkSession, d: str) -> DataFrame:
    moved = _bodies(s, d).select("doc_id", G.externalize_fields(F.create_map(F.lit("body"), "text", F.lit("command"), "text")).alias("m"))
    return moved.select("doc_id", F.col("m")["body"].alias("body"), F.col("m")["command"].alias("command"), F.array_join(G.blob_refs(F.col("m")), ",").alias("refs"))


@query("SELECT doc_id, CASE WHEN strlen(text) <= 4096 THEN text END AS \"inline\", CASE WHEN strlen(text) > 4096 THEN concat('sha256:', sha256(text)) END AS blob_hash, CAST(strlen(text) AS BIGINT) AS byte_len FROM documents")
def b3_externalize_or_inline(s: SparkSession, d: str) -> DataFrame:
    one = _bodies(s, d).select("doc_id", G.externalize_or_inline(F.col("text"), "text").alias("e"))
    return one.select("doc_id", "e.inline", "e.blob_hash", "e.byte_len")


@query("SELECT concat('sha256:', sha256(text)) AS hash, any_value(text) AS content, count(*) AS refs, CAST(strlen(any_value(text)) AS BIGINT) AS byte_len FROM documents GROUP BY sha256(text)")
def b4_content_dedup(s: SparkSession, d: str) -> DataFrame:
    return G.dedup_blobs(_bodies(s, d), "text")


@query("SELECT DISTINCT concat('sha256:', sha256(text)) AS hash FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en')")
def u3_anti_existing_blobs(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents")
    return G.new_blobs(G.dedup_blobs(docs, "text"), G.dedup_blobs(docs.where("lang = 'en'"), "text")).select("hash")


@query("SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN length(text) END AS n FROM documents")
def s13_blob_load(s: SparkSession, d: str) -> DataFrame:
    docs = _bodies(s, d)
    refs = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit("0" * 64)).when(F.col("doc_id") % 3 == 1, F.sha2("text", 256)).otherwise(G.content_hash(F.col("text"))).alias("ref"))
    return G.load_blobs(refs, G.dedup_blobs(docs, "text")).select("doc_id", F.length("content").cast("long").alias("n"))


@query("SELECT CAST(sum(CASE WHEN strlen(text) < 1024 THEN strlen(text) ELSE 0 END) AS BIGINT) AS inline_bytes, CAST(sum(CASE WHEN strlen(text) >= 1024 THEN strlen(text) ELSE 0 END) AS BIGINT) AS external_bytes, count(DISTINCT CASE WHEN strlen(text) >= 1024 THEN sha256(text) END) AS blobs FROM documents")
def a27_storage_summary(s: SparkSession, d: str) -> DataFrame:
    return G.storage_summary(_bodies(s, d), "text")


def _byte_cut_sql(n: int) -> str:
    chars = f"(SELECT coalesce(max(k), 0) FROM (SELECT unnest(generate_series(0, {n})) AS k) WHERE strlen(left(text, CAST(k AS INTEGER))) <= {n})"
    return f"CASE WHEN strlen(text) <= {n} THEN text ELSE left(text, CAST({chars} AS INTEGER)) END"


@query(f"SELECT doc_id, {_byte_cut_sql(101)} AS short, CASE WHEN strlen(text) > 101 THEN concat({_byte_cut_sql(101)}, '...') ELSE text END AS preview FROM documents")
def b6_preview(s: SparkSession, d: str) -> DataFrame:
    """Also n15, the cut at a byte limit."""
    return _bodies(s, d).select("doc_id", G.cut_bytes(F.col("text"), 101).alias("short"), G.preview(F.col("text"), 101).alias("preview"))


# --- integrity

MERKLE = EVENTS_SQL + ", n0 AS (SELECT 0 AS level, log_index AS idx, event_hash AS hash FROM ev)" + "".join(
    f", n{k} AS (SELECT {k} AS level, idx // 2 AS idx, sha256(unhex('01') || unhex(max(CASE WHEN idx % 2 = 0 THEN hash END)) || unhex(max(CASE WHEN idx % 2 = 1 THEN hash END))) AS hash FROM n{k - 1} GROUP BY idx // 2 HAVING count(*) = 2)" for k in range(1, 21)
) + ", nodes AS (" + " UNION ALL ".join(f"SELECT * FROM n{k}" for k in range(21)) + ")"


def _leaves(s: SparkSession, d: str) -> DataFrame:
    return audit_events(s, d).select("log_index", "event_hash")


@query("WITH " + MERKLE + " SELECT level, idx, hash FROM nodes")
def i2_merkle_build(s: SparkSession, d: str) -> DataFrame:
    """Also i1, the node hash."""
    return I.merkle_build(_leaves(s, d))


@query("WITH " + EVENTS_SQL + " SELECT log_index AS idx, 3 AS level, 2 * ((log_index + 1) * 8 - 1) - bit_count((log_index + 1) * 8 - 1) + 3 AS stored FROM ev")
def i3_stored_index(s: SparkSession, d: str) -> DataFrame:
    return _leaves(s, d).select(F.col("log_index").alias("idx"), F.lit(3).alias("level"), I.stored_index(F.lit(3), F.col("log_index")).alias("stored"))


def _sizes(s: SparkSession, d: str) -> DataFrame:
    return audit_events(s, d).select((F.col("log_index") + 1).alias("tree_size")).where("tree_size % 250 = 0 OR tree_size IN (1, 7)")


# The root of a size: complete subtrees by binary digit, folded from the lowest up.
ROOTS = MERKLE + """, RECURSIVE_PARTS AS (SELECT s.tree_size, n.level, n.hash, row_number() OVER (PARTITION BY s.tree_size ORDER BY n.level) AS k, count(*) OVER (PARTITION BY s.tree_size) AS total
   FROM (SELECT log_index + 1 AS tree_size FROM ev WHERE (log_index + 1) % 250 = 0 OR log_index + 1 IN (1, 7)) s JOIN nodes n ON (s.tree_size >> n.level) & 1 = 1 AND n.idx = (s.tree_size >> n.level) - 1),
 f1 AS (SELECT tree_size, total, 1 AS k, hash FROM RECURSIVE_PARTS WHERE k = 1)""" + "".join(
    f", f{k} AS (SELECT f.tree_size, f.total, {k} AS k, CASE WHEN p.hash IS NULL THEN f.hash ELSE sha256(unhex('01') || unhex(p.hash) || unhex(f.hash)) END AS hash FROM f{k - 1} f LEFT JOIN RECURSIVE_PARTS p ON p.tree_size = f.tree_size AND p.k = {k})" for k in range(2, 19)
) + ", roots AS (SELECT tree_size, hash AS root FROM f18)"
ROOTS = ROOTS.replace("RECURSIVE_PARTS", "parts")


@query("WITH " + ROOTS + " SELECT tree_size, root FROM roots")
def i4_root_at_size(s: SparkSession, d: str) -> DataFrame:
    return I.root_at_size(I.merkle_build(_leaves(s, d)), _sizes(s, d))


@query("WITH " + ROOTS + " SELECT tree_size, root, concat('ledger/1', chr(10), tree_size, chr(10), root, chr(10)) AS checkpoint_text FROM roots")
def i5_checkpoint_row(s: SparkSession, d: str) -> DataFrame:
    return I.checkpoint_rows(i4_root_at_size(s, d), "ledger/1")


@query("WITH " + ROOTS + ", rc AS (SELECT session_id, count(*) AS events FROM ev GROUP BY 1) SELECT session_id, events, (SELECT max(tree_size) FROM roots) AS tree_size, (SELECT concat('0x', left(r, 8), '...', right(r, 8)) FROM (SELECT arg_max(root, tree_size) AS r FROM roots)) AS root FROM rc")
def a8_receipt_with_root(s: SparkSession, d: str) -> DataFrame:
    """The receipts' tree size and root."""
    receipts = E.session_receipt(audit_events(s, d)).select("session_id", "events")
    return E.with_checkpoint(receipts, i4_root_at_size(s, d))


def _stored_tree(s: SparkSession, d: str, *ends: int) -> str:
    """A tree of the log, to which the events came in parts that end at these indices, and the rest."""
    leaves, path = _leaves(s, d), scratch(s, "tree")
    for low, high in zip((0, *ends), (*ends, None), strict=True):
        I.append_leaves(s, leaves.where(F.col("log_index") >= low) if high is None else leaves.where(F.col("log_index").between(low, high - 1)), path)
    return path


@query("WITH " + MERKLE + " SELECT level, idx, hash FROM nodes")
def i2_merkle_append(s: SparkSession, d: str) -> DataFrame:
    """A tree that grew by parts of 1, 250 and 5,000 events and the rest: its nodes are those of the whole."""
    return I.stored_nodes(s, _stored_tree(s, d, 1, 251, 5251))


@query("WITH " + ROOTS + " SELECT tree_size, root FROM roots")
def i4_root_of_a_grown_tree(s: SparkSession, d: str) -> DataFrame:
    return I.root_at_size(I.stored_nodes(s, _stored_tree(s, d, 777)), _sizes(s, d))


@query("""WITH """ + EVENTS_SQL + """ SELECT log_index + 1 AS first_size, ((log_index + 1) // 250 + 1) * 250 AS second_size, CASE (log_index + 1) % 1000 WHEN 250 THEN 'first root differs' WHEN 500 THEN 'second root differs' ELSE 'consistent' END AS status
 FROM ev WHERE ((log_index + 1) % 250 = 0 OR log_index + 1 IN (1, 7)) AND ((log_index + 1) // 250 + 1) * 250 <= (SELECT max(log_index) + 1 FROM ev)""")
def i8_consistency_proofs(s: SparkSession, d: str) -> DataFrame:
    """Each stored size against the next multiple of 250, from roots and proofs alone; some roots are forged."""
    nodes = I.stored_nodes(s, _stored_tree(s, d))
    roots = I.root_at_size(nodes, _sizes(s, d))
    pairs = roots.withColumn("second_size", F.expr("(tree_size DIV 250 + 1) * 250"))
    both = pairs.select(F.col("tree_size").alias("first_size"), F.col("root").alias("first_root"), "second_size").join(roots.select(F.col("tree_size").alias("second_size"), F.col("root").alias("second_root")), "second_size")
    forged, k = F.sha2(F.lit("forged"), 256), F.col("first_size") % 1000
    proofs = I.consistency_proofs(nodes, both).withColumns({"first_root": F.when(k == 250, forged).otherwise(F.col("first_root")), "second_root": F.when(k == 500, forged).otherwise(F.col("second_root"))})
    return I.verify_consistency(proofs).select("first_size", "second_size", "status")


def _proofs(s: SparkSession, d: str) -> DataFrame:
    """Proofs of every event in the tree of the whole log, from a stored tree."""
    leaves = _leaves(s, d)
    size = leaves.agg((F.max("log_index") + 1).alias("tree_size"))
    nodes = I.stored_nodes(s, _stored_tree(s, d))
    # Leaves carry their hashes along, and the one root comes last: no proof goes through a shuffle.
    wanted = leaves.join(F.broadcast(size))
    return I.inclusion_proofs(nodes, wanted).join(F.broadcast(I.root_at_size(nodes, size)), "tree_size")


@query("WITH " + EVENTS_SQL + " SELECT log_index, 'verified' AS status FROM ev")
def i7_verify_inclusion(s: SparkSession, d: str) -> DataFrame:
    """i6 proofs (joined by j9) and their verification: all of an untouched log verify."""
    return I.verify_inclusion(_proofs(s, d)).select("log_index", "status")


@query("WITH " + MERKLE + ", m AS (SELECT max(log_index) + 1 AS n FROM ev) SELECT log_index, n.hash AS sibling FROM ev, m JOIN n0 n ON n.idx = xor(ev.log_index, 1)")
def j9_node_sibling_join(s: SparkSession, d: str) -> DataFrame:
    """First step of each proof: the leaf's sibling."""
    leaves = _leaves(s, d)
    return leaves.select("log_index", F.col("log_index").bitwiseXOR(F.lit(1).cast("long")).alias("idx")).join(leaves.select(F.col("log_index").alias("idx"), F.col("event_hash").alias("sibling")), "idx").select("log_index", "sibling")


@query("WITH " + ROOTS + " SELECT tree_size, CASE WHEN tree_size % 500 = 0 THEN root ELSE 'forged' END AS root, tree_size % 500 = 0 AS consistent FROM roots")
def i8_consistency_check(s: SparkSession, d: str) -> DataFrame:
    nodes = I.merkle_build(_leaves(s, d))
    stored = I.root_at_size(nodes, _sizes(s, d)).withColumn("root", F.when(F.col("tree_size") % 500 == 0, F.col("root")).otherwise("forged"))
    return I.consistency(nodes, stored)


@query("WITH " + EVENTS_SQL + " SELECT log_index, 'leaf differs' AS problem FROM ev WHERE log_index % 1000 = 1 UNION ALL SELECT log_index, 'duplicate' FROM ev WHERE log_index % 1000 = 2 UNION ALL SELECT log_index, 'missing' FROM ev WHERE log_index % 1000 = 3")
def i9_tamper_scan(s: SparkSession, d: str) -> DataFrame:
    leaves = _leaves(s, d)
    k = F.col("log_index") % 1000
    bad = leaves.where(k != 3).withColumn("event_hash", F.when(k == 1, F.sha2("event_hash", 256)).otherwise(F.col("event_hash"))).union(leaves.where(k == 2))
    return I.tamper_scan(bad, leaves.select(F.col("log_index").alias("idx"), F.col("event_hash").alias("hash")))


@query("WITH " + EVENTS_SQL + " SELECT log_index - 1 AS after, log_index + 1 AS before FROM ev WHERE log_index % 777 = 5 AND log_index < (SELECT max(log_index) FROM ev)")
def i9_index_gaps(s: SparkSession, d: str) -> DataFrame:
    return I.index_gaps(_leaves(s, d).where("log_index % 777 <> 5"), 1000)


@query("WITH " + EVENTS_SQL + " SELECT log_index + 1 AS tree_size FROM ev WHERE (log_index + 1) % 100 = 0 AND (log_index + 1) % 300 > 0")
def i10_anchor_due(s: SparkSession, d: str) -> DataFrame:
    points = audit_events(s, d).select((F.col("log_index") + 1).alias("tree_size")).where("tree_size % 100 = 0")
    return I.anchors_due(points, points.where("tree_size % 300 = 0"))


@query("WITH " + EVENTS_SQL + " SELECT log_index + 1 AS tree_size, (log_index + 1) % 600 = 0 AS matches FROM ev WHERE (log_index + 1) % 300 = 0")
def i11_anchor_hash_match(s: SparkSession, d: str) -> DataFrame:
    points = audit_events(s, d).select((F.col("log_index") + 1).alias("tree_size"), F.col("event_hash").alias("root")).where("tree_size % 100 = 0")
    anchors = points.where("tree_size % 300 = 0").select("tree_size", F.when(F.col("tree_size") % 600 == 0, F.col("root")).otherwise("other").alias("message_hash"))
    return I.anchor_matches(anchors, points)
