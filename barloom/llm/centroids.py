"""Lloyd's clustering on whole numbers, sharded by dimension.

Vectors are cut into chunks of ``CHUNK`` rows and these into column blocks of
``block`` components.  A row of the written table is one column block of one
chunk, and files hold one shard each.  A round is one shuffle:

* a column-block task computes the exact partial distances of its rows to its
  slice of the centroids, which is all it gets of them;
* the blocks of a chunk are added by its key, and the smallest sum (ties: the
  smaller number) is each vector's cluster;
* every shard sums its own columns by cluster, and replaces its own slice.

Centroids are k x components numbers, bounded by the parameters whatever the
table's size; these and their sums are all that reaches the driver.  Nothing is
grouped by vector, so repeated vectors are as good as others.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import freed, table, written

CHUNK = 2048
#: Components are held to this, so that a squared distance fits in 64 bits.
MOST = 1 << 27


class Layout(NamedTuple):
    components: int = 64
    block: int = 32

    @property
    def shards(self) -> int:
        return -(-self.components // self.block)

    def columns(self, shard: int) -> slice:
        return slice(shard * self.block, min((shard + 1) * self.block, self.components))


def whole_numbers(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", components: int = 64, scale: int = 256) -> DataFrame:
    """(id, q): vectors of that many components, none null or non-finite, as floor(scale * x)."""
    e = F.col(embedding).cast("array<double>")
    fine = (F.size(e) == components) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    held = F.transform(e, lambda x: F.greatest(F.least(F.floor(x * F.lit(float(scale))).cast("long"), F.lit(MOST)), F.lit(-MOST)).cast("int"))
    return vectors.filter(F.coalesce(fine, F.lit(False))).select(F.col(vec_id).alias("id"), held.alias("q"))


def _narrow(x: np.ndarray, kinds: str) -> np.ndarray:
    """The same numbers in the first of these types that holds them all."""
    low, top = (int(x.min()), int(x.max())) if x.size else (0, 0)
    return x.astype(next(k for k in kinds.split() if np.iinfo(k).min <= low and top <= np.iinfo(k).max))


def _array(raw: bytes, width: int, columns: int) -> np.ndarray:
    return np.frombuffer(raw, f"i{width}").reshape(-1, columns).astype(np.int64)


def column_blocks(numbers: DataFrame, layout: Layout) -> DataFrame:
    """The written table (chunk, shard, n, width, cells, ids): ids stand in the rows of shard 0."""

    def cut(batches):
        task, count = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            for start in range(0, b.num_rows, CHUNK):
                part = b.slice(start, CHUNK)
                q = part.column(1).flatten().to_numpy().reshape(part.num_rows, layout.components)
                for s in range(layout.shards):
                    cells = _narrow(q[:, layout.columns(s)], "int8 int16 int32")
                    ids = part.column(0) if s == 0 else part.column(0).slice(0, 0)
                    at = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([task + count]), pa.array([s], pa.int32()), pa.array([part.num_rows], pa.int32()), pa.array([cells.itemsize], pa.int32()),
                         pa.array([cells.tobytes()], pa.binary()), at], ["chunk", "shard", "n", "width", "cells", "ids"],
                    )
                count += 1

    schema = T.StructType([*T.StructType.fromDDL("chunk long, shard int, n int, width int, cells binary").fields, T.StructField("ids", T.ArrayType(numbers.schema["id"].dataType))])
    return written(numbers.mapInArrow(cut, schema), "blocks", "shard")


def partial_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to centroid slices."""
    bound = int(max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))) ** 2 * x.shape[1]
    kind = np.float64 if bound < 1 << 50 else np.int64  # below, doubles hold every sum exactly
    a, b = x.astype(kind), c.astype(kind)
    return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)


def assigned(blocks: DataFrame, centroids: np.ndarray, layout: Layout, last: bool) -> DataFrame:
    """Per chunk and shard: sums of the shard's columns by cluster and members; or, at the end, ids with clusters and distances."""
    k = len(centroids)
    slices = {s: np.ascontiguousarray(centroids[:, layout.columns(s)]) for s in range(layout.shards)}

    def partial(batches):
        for b in batches:
            col = {f.name: b.column(i).to_pylist() for i, f in enumerate(b.schema) if f.name != "ids"}
            names = ["chunk", "shard", "width", "cells", "wide", "sums"] + (["ids"] if last else [])
            for i in range(b.num_rows):
                s = col["shard"][i]
                c = slices[s]
                d = _narrow(partial_distances(_array(col["cells"][i], col["width"][i], c.shape[1]), c), "int32 int64")
                one = [pa.array([col["chunk"][i]]), pa.array([s], pa.int32()), pa.array([col["width"][i]], pa.int32()), pa.array([None if last else col["cells"][i]], pa.binary()),
                       pa.array([d.itemsize], pa.int32()), pa.array([d.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(one + ([b.column(b.schema.get_field_index("ids")).slice(i, 1)] if last else []), names)

    def nearest(tab: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        total = sum(_array(raw, w, k) for raw, w in zip(tab["sums"].to_pylist(), tab["wide"].to_pylist(), strict=True))
        label = total.argmin(1)
        return label, total[np.arange(len(label)), label]

    def sums(tab: pa.Table) -> pa.Table:
        label, _ = nearest(tab)
        shard, at, value = [], [], []
        members = np.bincount(label, minlength=k)
        for s, w, cells in zip(tab["shard"].to_pylist(), tab["width"].to_pylist(), tab["cells"].to_pylist(), strict=True):
            width = slices[s].shape[1]
            into = np.zeros((k, width + 1), np.int64)
            np.add.at(into[:, :width], label, _array(cells, w, width))
            into[:, width] = members
            found = np.flatnonzero(np.repeat(members > 0, width + 1))
            shard.append(np.full(len(found), s)), at.append(found), value.append(into.ravel()[found])
        return pa.table({"shard": pa.array(np.concatenate(shard), pa.int32()), "cell": pa.array(np.concatenate(at), pa.int32()), "value": pa.array(np.concatenate(value), pa.int64())})

    def labels(tab: pa.Table) -> pa.Table:
        label, d = nearest(tab)
        first = tab["shard"].to_pylist().index(0)
        ids = tab["ids"].combine_chunks()
        return pa.table({"id": ids.slice(first, 1).flatten(), "cluster": pa.array(label, pa.int32()), "distance": pa.array(d, pa.int64())})

    fields = [*T.StructType.fromDDL("chunk long, shard int, width int, cells binary, wide int, sums binary").fields, *([blocks.schema["ids"]] if last else [])]
    parts = blocks.mapInArrow(freed(partial), T.StructType(fields)).groupBy("chunk")
    if last:
        return parts.applyInArrow(labels, T.StructType([T.StructField("id", blocks.schema["ids"].dataType.elementType), *T.StructType.fromDDL("cluster int, distance long").fields]))
    return parts.applyInArrow(sums, "shard int, cell int, value long")


def update(blocks: DataFrame, centroids: np.ndarray, layout: Layout) -> np.ndarray:
    """One round: each shard's slice becomes the floor of its columns' sums by the number of members; empty clusters stay."""
    cells = assigned(blocks, centroids, layout, False).groupBy("shard", "cell").agg(F.sum("value").alias("value")).collect()  # k x (components + shards) rows at most
    new = centroids.copy()
    for s in range(layout.shards):
        own = {r.cell: r.value for r in cells if r.shard == s}
        at = layout.columns(s)
        width = at.stop - at.start
        for c in {cell // (width + 1) for cell in own}:
            n = own[c * (width + 1) + width]
            new[c, at] = [own[c * (width + 1) + j] // n for j in range(width)]
    return new


def cluster(
    vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 40, rounds: int = 5, seed: int = 2, scale: int = 256, components: int = 64, block: int = 32
) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of every vector kept, and the final centroids.

    Vectors that are null, have another number of components or a null or
    non-finite one are left out.  Whole numbers beyond +-2**27 are held there.
    The first centroids are the vectors with the smallest SHA-256 of
    ``seed:id``; ids that tie go by their numbers, null ids come last.  With
    fewer vectors than ``k`` there are as many centroids as vectors; an empty
    table gives no rows.  Repeated rows are vectors of their own.
    """
    layout = Layout(components, block)
    numbers = whole_numbers(vectors, vec_id=vec_id, embedding=embedding, components=components, scale=scale)
    first = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    starts = numbers.select(first.alias("at"), "q").orderBy(F.col("at").asc_nulls_last(), "q").limit(k).collect()
    centroids = np.array([r.q for r in starts], np.int64).reshape(len(starts), components)
    if not len(starts):
        return numbers.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), centroids
    blocks = column_blocks(numbers, layout)
    for _ in range(rounds):
        centroids = update(blocks, centroids, layout)
    return assigned(blocks, centroids, layout, True), centroids


def with_inertia(labels: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``labels`` with ``cluster_inertia``, ``inertia`` and ``centroid_sha256``; the joined side has a row a centroid."""
    spark: SparkSession = labels.sparkSession
    labels = written(labels, "labels")
    digests = [(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    shas = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    one = labels.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    one = one.withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy(F.lit(0)))).join(shas.hint("broadcast"), "cluster")
    return labels.join(one.hint("broadcast"), "cluster")


def op13_centroids(spark, sf_dir) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    labels, centroids = cluster(vectors)
    return with_inertia(labels, centroids).select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = 40, rounds: int = 5, components: int = 64) -> str:
    """The same in SQL, a pair of tables a round."""
    square = "list_sum(list_transform(range(1, {n}), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))".format(n=components + 1)
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT v.rid, v.vec_id, v.q, min({{'d': CAST({square} AS BIGINT), 'c': c.c}}) AS m FROM kept v, c{r} c GROUP BY v.rid, v.vec_id, v.q)""")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT m.c AS c, i, CAST(sum(q[i]) AS BIGINT) AS s, count(*) AS n FROM a{r}, range(1, {components + 1}) g(i) GROUP BY 1, 2),
c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.q, o.q) AS q FROM c{r} o LEFT JOIN
  (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS q FROM s{r} GROUP BY c) n ON n.c = o.c)""")
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = {components} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {components}),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id), q) - 1 AS INT) AS c, q FROM kept ORDER BY sha256('2:' || vec_id), q LIMIT {k}),
{", ".join(steps)},
i AS (SELECT m.c AS c, CAST(sum(m.d) AS BIGINT) AS cluster_inertia FROM a{rounds} GROUP BY 1)
SELECT a.vec_id, a.m.c AS cluster, a.m.d AS distance, i.cluster_inertia, CAST((SELECT sum(cluster_inertia) FROM i) AS BIGINT) AS inertia,
  sha256(array_to_string(e.q, ',')) AS centroid_sha256
FROM a{rounds} a JOIN i ON i.c = a.m.c JOIN c{rounds} e ON e.c = a.m.c
"""


OP13_SQL = _sql()
