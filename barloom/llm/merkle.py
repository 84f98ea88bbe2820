"""Merkle manifest of a table: postorder append logs, and proofs read from them by position.

Every row is a leaf of its source's tree, and the sources' roots are the leaves
of one more tree, whose root stands for the table.  A tree is built in tiers of
``LEVELS`` levels:

* leaves get their rank in the tree: rows are dealt by range of (tree, id),
  numbered there, and ranges are added up by one row each, so that a hot tree
  is as many tasks as it has ranges;
* an aligned builder takes 16**LEVELS consecutive nodes and appends each, and
  each parent as soon as its last child is there: completion order, which is
  postorder.  What it appended is one segment of the tier's log;
* the tops of the segments are the leaves of the next tier.

Where a node stands in its log follows from its level and number alone, as a
full subtree has a known size (``position``): the siblings of a leaf are read
from the segment by that, and what lies above the segment comes from the next
tier, segment by segment.  A segment has at most 4,369 nodes; no task and no
message holds more than some of them.  Only the root reaches the driver.

H is SHA-256 over the hex digests of a run of up to 16 nodes.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import freed, lower_az, table, written

ARITY, LEVELS = 16, 3
SPAN = ARITY**LEVELS  # leaves of a full segment
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def leaf_position(i: int) -> int:
    """Place of leaf ``i`` in its tier's log: the leaves and the finished parents before it."""
    return i + sum(i // ARITY**k for k in range(1, LEVELS + 1))


def position(level: int, i: int, n: int) -> int:
    """Place of node ``i`` of a level in the log of a tier with ``n`` leaves: it is written ``level`` nodes after its last leaf."""
    return leaf_position(min((i + 1) * ARITY**level, n) - 1) + level


def height(n: int) -> int:
    """Levels above the leaves in one segment of a tier with ``n`` leaves: one node alone gets no parent."""
    return next(k for k in range(LEVELS + 1) if k == LEVELS or n <= ARITY**k)


def parent(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def build(digests: list[str], start: int, n: int) -> list[str]:
    """The segment of the leaves from number ``start`` on, in completion order."""
    log: list[str] = []
    top = height(n)
    for i, digest in enumerate(digests, start):
        log.append(digest)
        for level in range(1, top + 1):
            if (i + 1) % ARITY**level and i + 1 != n:
                break
            first = i // ARITY**level * ARITY
            last = i // ARITY ** (level - 1)
            log.append(parent([log[position(level - 1, j, n) - leaf_position(start)] for j in range(first, last + 1)]))
    return log


def runs_above(log: list[str], i: int, start: int, n: int, low: int = 0) -> list[tuple[int, list[str]]]:
    """From level ``low`` of the segment up: (place of leaf ``i``'s ancestor, its siblings in order)."""
    out, base = [], leaf_position(start)
    for level in range(low, height(n)):
        at = i // ARITY**level
        run = range(at // ARITY * ARITY, min(at // ARITY * ARITY + ARITY, -(-n // ARITY**level)))
        out.append((at - run.start, [log[position(level, j, n) - base] for j in run if j != at]))
    return out


def fold(digest: str, path: list[tuple[int, list[str]]]) -> str:
    """The root that a leaf and the siblings of its path give."""
    for place, others in path:
        digest = parent([*others[:place], digest, *others[place:]])
    return digest


# ---------------------------------------------------------------- the log


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[encoded(v) for v in values]), 256))


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``rank`` in their tree and its size ``n``, by (id, leaf); of rows that tie in both any order gives the same tree.

    Null ids come first.  ``rows`` has the columns tree, id, leaf and others.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["tree", "id", "leaf", "from"]
    dealt = rows.withColumn("from", F.spark_partition_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("from")
    # Spark numbers rows from 2**33 times the partition's number on
    placed = written(dealt.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "ranked")
    ranges = placed.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    tree = Window.partitionBy("tree")
    ranges = ranges.select(
        "tree", "part", (F.sum("rows").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("before"), "first", F.sum("rows").over(tree).alias("n")
    )
    out = placed.join(ranges.hint("shuffle_hash"), ["tree", "part"])
    return out.withColumn("rank", F.col("at") - F.col("first") + F.coalesce("before", F.lit(0))).drop("at", "part", "first", "before")


def segments(rows: DataFrame) -> DataFrame:
    """The written log of a tier: (tree, block, n, ids, log, claims), one row a segment.

    ``claims`` has 32 bytes a leaf, or is null where no leaf of the segment has
    a claimed digest of its own; a leaf without one stands with its own digest.
    """

    def append(tab: pa.Table) -> pa.Table:
        tab = tab.sort_by("rank")
        start, n = tab["rank"][0].as_py(), tab["n"][0].as_py()
        digests = [x.hex() for x in tab["leaf"].to_pylist()]
        claims = tab["claim"].to_pylist()
        held = None if tab["claim"].null_count == len(claims) else b"".join(c or bytes.fromhex(d) for c, d in zip(claims, digests, strict=True))
        ids = tab["id"].combine_chunks()
        return pa.table(
            {
                "tree": pa.array([tab["tree"][0].as_py()]), "block": pa.array([start // SPAN], pa.int64()), "n": pa.array([n], pa.int64()),
                "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), "log": pa.array([bytes.fromhex("".join(build(digests, start, n)))], pa.binary()),
                "claims": pa.array([held], pa.binary()),
            }
        )

    schema = T.StructType([*T.StructType.fromDDL("tree string, block long, n long").fields, T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)), *T.StructType.fromDDL("log binary, claims binary").fields])
    rows = rows.select("tree", "rank", "n", "id", "leaf", "claim").withColumn("block", F.floor(F.col("rank") / SPAN))
    return written(rows.groupBy("tree", "block").applyInArrow(append, schema), "segments")


def blocks() -> Column:
    """Segments of a tree's tier."""
    return F.ceil(F.col("n") / SPAN)


def tiers(rows: DataFrame) -> list[DataFrame]:
    """Segments tier by tier: those of a tree's tier are the leaves of its next, until there is one; a tier takes 4,096 to one."""
    out = [segments(rows)]
    while True:
        up = out[-1].filter(blocks() > 1).select(
            "tree", F.col("block").alias("rank"), blocks().alias("n"), F.col("block").alias("id"), F.substring("log", -32, 32).alias("leaf"), F.lit(None).cast("binary").alias("claim")
        )
        if up.isEmpty():
            return out
        out.append(segments(up))


def tops(levels: list[DataFrame]) -> DataFrame:
    """(tree, root) of every tree."""
    found = [t.filter(blocks() == 1).select("tree", F.substring("log", -32, 32).alias("root")) for t in levels]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


class Manifest(NamedTuple):
    """Logs of the sources' trees and of the tree over them, and the table's root (hex; None if it is empty)."""

    sources: list[DataFrame]
    forest: list[DataFrame]
    root: str | None

    def nodes(self) -> DataFrame:
        """(tree, tier, position, digest): the logs, node by node; ``tree`` is null for the tree over the sources, else ``+`` and the source's name, or empty for the null source."""
        found = []
        for over, levels in ((True, self.forest), (False, self.sources)):
            for k, t in enumerate(levels):
                tree = F.lit(None).cast("string") if over else F.col("tree")
                at = F.posexplode(F.transform(F.sequence(F.lit(0), (F.length("log") / 32 - 1).cast("int")), lambda i: F.lower(F.hex(F.substring("log", i * 32 + 1, F.lit(32)))))).alias("at", "digest")
                found.append(t.select(tree.alias("tree"), F.lit(k).alias("tier"), "block", at).select("tree", "tier", (F.col("block") * leaf_position(SPAN) + F.col("at")).alias("position"), "digest"))
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out


def manifest(docs: DataFrame, *, fields: list[str] = FIELDS, source: str = "source", doc_id: str = "doc_id", claim: Column | None = None) -> Manifest:
    """The manifest of a table.  Texts are hashed where they are read; only digests travel.

    A null field counts as ``-``; a null source has a tree of its own, the
    first; null ids come first in their tree.  Rows that tie on the id go by
    their digests, repeated rows are leaves of their own.  Columns not among
    ``fields`` count for nothing.  An empty table has no root.  ``claim`` is a
    digest that someone holds in place of the row's own (null: the same).
    """
    name = F.col(f"`{source}`").cast("string")
    rows = docs.select(
        F.coalesce(F.concat(F.lit("+"), name), F.lit("")).alias("tree"), F.col(f"`{doc_id}`").alias("id"), leaf([F.col(f"`{c}`") for c in fields]).alias("leaf"),
        (F.lit(None).cast("binary") if claim is None else claim).alias("claim"),
    )
    sources = tiers(ranked(rows))
    roots = tops(sources).select(F.lit("").alias("tree"), F.col("tree").alias("id"), F.col("root").alias("leaf"), F.lit(None).cast("binary").alias("claim"))
    forest = tiers(ranked(roots))
    top = tops(forest).first()
    return Manifest(sources, forest, None if top is None else bytes(top.root).hex())


# ---------------------------------------------------------------- proofs

PATH = "places array<int>, siblings array<binary>"


def _with_paths(levels: list[DataFrame], ends: DataFrame) -> DataFrame:
    """The first tier's segments with what lies above them (places, siblings) and ``subroot``; ``ends`` has that for each tree's root."""
    above = None
    for k in range(len(levels) - 1, -1, -1):
        t = levels[k]
        have = t.filter(blocks() == 1).join(ends.hint("shuffle_hash"), "tree")
        if above is not None:
            have = have.unionByName(t.filter(blocks() > 1).join(above.hint("shuffle_hash"), ["tree", "block"]))
        if k == 0:
            return have
        above = written(leaf_paths(have).select("tree", F.col("id").alias("block"), "places", "siblings", "subroot"), "paths")
    raise AssertionError("no tier")


def leaf_paths(have: DataFrame) -> DataFrame:
    """(tree, id, digest, places, siblings, subroot) of each leaf of the given segments: its siblings up to the table's root."""

    def extract(batches):
        for b in batches:
            for row in b.to_pylist():
                log = _hexes(row["log"])
                start, ids = row["block"] * SPAN, row["ids"]
                own = [runs_above(log, start + j, start, row["n"]) for j in range(len(ids))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["tree"]] * len(ids), pa.string()), pa.array(ids, b.schema.field("ids").type.value_type),
                        pa.array([bytes.fromhex(log[leaf_position(start + j) - leaf_position(start)]) for j in range(len(ids))], pa.binary()),
                        pa.array([[p for p, _ in path] + row["places"] for path in own], pa.list_(pa.int32())),
                        pa.array([[bytes.fromhex("".join(s)) for _, s in path] + row["siblings"] for path in own], pa.list_(pa.binary())), pa.array([row["subroot"]] * len(ids), pa.binary()),
                    ], ["tree", "id", "digest", "places", "siblings", "subroot"],
                )

    kind = have.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("tree", T.StringType()), T.StructField("id", kind), *T.StructType.fromDDL(f"digest binary, {PATH}, subroot binary").fields])
    return have.mapInArrow(extract, schema)


def _hexes(raw: bytes) -> list[str]:
    text = raw.hex()
    return [text[i : i + 64] for i in range(0, len(text), 64)]


def proofs(m: Manifest) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of the manifest's table.

    The proof is the siblings' digests in order, level by level to the root; of
    it the digest is given.  The fold starts from the claimed digest.
    """
    spark = m.forest[0].sparkSession
    none = spark.createDataFrame([("", [], [], None)], f"tree string, {PATH}, subroot binary")
    ends = leaf_paths(_with_paths(m.forest, none)).select(F.col("id").alias("tree"), "places", "siblings", F.col("digest").alias("subroot"))
    have = _with_paths(m.sources, written(ends, "ends"))
    root = m.root

    def check(batches):
        for b in batches:
            for row in b.to_pylist():
                log, n, start = _hexes(row["log"]), row["n"], row["block"] * SPAN
                claims = row["claims"] and _hexes(row["claims"])
                upper = [(p, _hexes(s)) for p, s in zip(row["places"], row["siblings"], strict=True)]
                low = min(1, height(n))
                leaves, digests, folds = [], [], []
                for first in range(0, len(row["ids"]), ARITY):  # the leaves of a run share all above their parent
                    shared = [*runs_above(log, start + first, start, n, low), *upper]
                    tail = "".join(x for _, s in shared for x in s)
                    for j in range(first, min(first + ARITY, len(row["ids"]))):
                        own = runs_above(log, start + j, start, n)[:low]
                        leaves.append(log[leaf_position(start + j) - leaf_position(start)])
                        digests.append(hashlib.sha256(("".join(own[0][1] if low else []) + tail).encode()).hexdigest())
                        folds.append(fold(claims[j] if claims else leaves[-1], [*own, *shared]))
                size = len(leaves)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["ids"], b.schema.field("ids").type.value_type), pa.array(leaves), pa.array([row["subroot"].hex()] * size), pa.array([root] * size), pa.array(digests),
                        pa.array(folds), pa.array([f == root for f in folds]),
                    ], ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
                )

    kind = have.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("id", kind), *T.StructType.fromDDL("leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean").fields])
    return have.mapInArrow(freed(check), schema)


def op11_merkle(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    changed = leaf([lower_az(F.col(c)) if c == "text" else F.col(c) for c in FIELDS])
    claim = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, changed)
    return proofs(manifest(docs, claim=claim)).withColumnRenamed("id", "doc_id")


def _sql(levels: int = 6, upper: int = 5) -> str:
    """The same in SQL, level by level: enough for 16**levels rows a source and 16**upper sources."""
    crc = (
        "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), "
        "lambda i: [ascii(CAST(doc_id AS VARCHAR)[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), "
        "lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295)"
    )
    part = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
    most = " || ".join(part.format(c) for c in FIELDS[:-1])
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def up(k: int, t: str, p: str) -> str:
        before, run = f"{t}{k}", "t.m[:p.i % 16] || {0}t.m[p.i % 16 + 2:]"
        return f"""
{t}{k + 1} AS MATERIALIZED (SELECT tree, i // 16 AS i, (n + 15) // 16 AS n, n AS below, CASE WHEN n = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, list(h ORDER BY i) AS m
  FROM {before} GROUP BY tree, i // 16, n),
{p}{k + 1} AS (SELECT p.rid, p.tree, p.i // 16 AS i, CASE WHEN t.below = 1 THEN p.f ELSE sha256(array_to_string({run.format("[p.f] || ")}, '')) END AS f,
  CASE WHEN t.below = 1 THEN p.proof ELSE p.proof || array_to_string({run.format("")}, '') END AS proof FROM {p}{k} p JOIN {t}{k + 1} t ON t.tree = p.tree AND t.i = p.i // 16)"""

    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce('+' || source, '') AS tree, sha256({most} || {part.format("text")}) AS leaf,
  CASE WHEN {crc} % 5 = 0 THEN sha256({most} || {part.format(lower)}) END AS claim FROM documents),
r0 AS (SELECT rid, doc_id, tree, leaf AS h, coalesce(claim, leaf) AS f, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM d),
t0 AS (SELECT tree, i, n, h FROM r0), p0 AS (SELECT rid, tree, i, f, '' AS proof FROM r0), {",".join(up(k, "t", "p") for k in range(levels))},
s AS MATERIALIZED (SELECT tree AS source_tree, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM t{levels}),
u0 AS (SELECT '' AS tree, i, n, h FROM s), q0 AS (SELECT p.rid, '' AS tree, s.i, p.f, p.proof FROM p{levels} p JOIN s ON s.source_tree = p.tree), {",".join(up(k, "u", "q") for k in range(upper))}
SELECT d.doc_id, d.leaf, s.h AS subroot, (SELECT h FROM u{upper}) AS root, sha256(q.proof) AS proof_sha256, q.f AS folded_root, q.f = (SELECT h FROM u{upper}) AS verified
FROM d JOIN s ON s.source_tree = d.tree JOIN q{upper} q ON q.rid = d.rid
"""


OP11_SQL = _sql()
