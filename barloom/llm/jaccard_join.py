"""Documents linked by the Jaccard similarity of their word shingles: a grouped prefix join.

Shingles are ordered by how common their rarest word is in the corpus, then by
hash.  Two sets of sizes n, m and similarity t or more share a shingle among
their first ``n - ceil(t n) + 1`` and ``m - ceil(t m) + 1`` (prefix filter), have
sizes within t of each other (length filter), and share so many s of those first
ones that the others can make up the overlap; so they share one of the
``p - s + 1`` rarest of the p first ones (the prefix filter once more, now in
order of how many prefixes hold a shingle).

1. Equal sets are one *node*; nodes with identical prefixes and size one *group*.
2. *Star*: of the groups at a prefix shingle the one that meets most others leads.
   Every node is compared with the leader its group meets most often (or with its
   group's first node): one pair per node, however large the groups.
3. *Families*: nodes compared with the same leader are compared with each other
   by their few differences from it, joined on those (see ``_family_links``).
4. *Rest*: wherever a prefix shingle joins different families, all pairs across
   them pass the filters, are expanded to nodes and compared in full.

So no link between components is lost, while a large family of near copies is
not expanded into its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, freed, mix, table, text_slices, written
from .components import connected_components
from .packed_counts import count_hashes, frequent, layout

#: At most so many common words are known by count on every worker (12 bytes each); all others are rare.
COMMON_WORDS = 1 << 17
#: Nodes to verify are found in the second scan by a broadcast of their ids up to this many, by a shuffle beyond it.
BROADCAST_NODES = 1_000_000
#: Pairs with one leader beyond which they are spread over ``SPREAD`` tasks, each with a copy of the leader's set.
HOT_PAIRS, SPREAD = 1_000, 64


def _shingle_sets(part: pa.RecordBatch, k: int, common: np.ndarray, counts: np.ndarray):
    """For each text of a slice its distinct shingle codes, in order: 6 bits of commonness, 58 of hash."""
    w = Words(part.column(part.schema.get_field_index("text")), lower=True)
    h = w.hashes()
    rank = np.zeros(len(h), U64)
    if len(common) and len(h):
        slot = np.minimum(np.searchsorted(common, h), len(common) - 1)
        rank = np.where(common[slot] == h, np.log2(counts[slot]).astype(U64) + U64(1), U64(0))
    at, hk = w.windows(h, k)
    cls = rank[at] if len(at) else np.zeros(0, U64)
    for j in range(1, k):
        cls = np.minimum(cls, rank[at + j])
    code = (cls << U64(58)) | (hk >> U64(6))
    bounds = np.searchsorted(at, w.bounds)
    n_words = np.diff(w.bounds)
    for i in range(len(n_words)):
        if n_words[i] >= k:
            yield np.unique(code[bounds[i] : bounds[i + 1]])
        elif n_words[i]:
            whole = np.full(1, n_words[i], U64)
            for j in range(w.bounds[i], w.bounds[i + 1]):
                whole = mix(whole * U64(5) + h[j : j + 1])
            yield whole >> U64(6)
        else:
            yield np.zeros(0, U64)


def _node(codes: np.ndarray) -> int:
    """Id of a set: all its codes, in any order."""
    return int(mix(np.sum(mix(codes), keepdims=True) + U64(len(codes))).view(np.int64)[0])


def shingle_prefix(n: int, threshold: int) -> int:
    return n - -(-threshold * n // 100) + 1


def jaccard_components(docs: DataFrame, *, k: int = 5, threshold: int = 80, doc_id: str = "doc_id", text: str = "text", inner: bool = False) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id``; ``inner`` adds the text's ``digest`` and the component's node ``comp``.

    Two documents link when ``100 * intersection >= threshold * union`` over
    their distinct ``k``-word shingles (texts with fewer words: the whole
    sequence as one), after lower-casing A-Z.  ``component_id`` is the smallest
    id reachable by links, null if none of the reachable rows has an id.  Texts
    without words and null texts link with nothing.  Repeated rows each give a
    row.
    """
    if not 1 <= threshold <= 100 or k < 1:
        raise ValueError("threshold must be from 1 to 100 per cent and k at least 1")
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    given = rows.withColumn("digest", F.xxhash64("text"))
    buckets = layout(rows).buckets
    tally = count_hashes(rows.select("text"), lambda p: {0: Words(p.column(p.schema.get_field_index("text")), lower=True).hashes()}, buckets=buckets, name="words")
    common, counts, _ = frequent(tally, 0, COMMON_WORDS)
    known = spark.sparkContext.broadcast((common, counts))

    def sign(batches):
        for part in text_slices(batches):
            ns, nodes, prefixes = [], [], []
            for codes in _shingle_sets(part, k, *known.value):
                n = len(codes)
                ns.append(n)
                nodes.append(_node(codes))
                prefixes.append(codes[: shingle_prefix(n, threshold)].view(np.int64) if n else codes.view(np.int64))
            off = np.concatenate(([0], np.cumsum([len(p) for p in prefixes]))).astype(np.int32)
            flat = pa.array(np.concatenate([np.zeros(0, np.int64), *prefixes]))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("digest"), pa.array(ns, pa.int64()), pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(pa.array(off), flat)],
                ["doc_id", "digest", "n", "node", "prefix"],
            )

    signed = written(given.mapInArrow(freed(sign), f"doc_id {id_type}, digest long, n long, node long, prefix array<long>"), "signed")
    nodes = written(
        signed.filter("n > 0").groupBy("node", "n").agg(F.first("prefix").alias("prefix"), F.min("doc_id").alias("low"))
        .withColumn("grp", F.xxhash64("n", "prefix")), "nodes"
    )
    groups = nodes.groupBy("grp", "n").agg(F.first("prefix").alias("prefix"), F.min("node").alias("hub"), F.count("*").alias("size"))
    spread = groups.select("grp", "size", F.explode("prefix").alias("tok"))
    meets = written(spread.groupBy("tok").agg(F.sum("size").alias("c")).filter("c > 1"), "meets")
    shared = spread.drop("size").join(meets.hint("merge"), "tok")
    # the prefix's shingles again, now from the rarest in prefixes on; those of one group alone come first and need no row
    ranked = shared.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("c", "tok"))).alias("r"))
    size = F.expr(f"n - cast(ceil(n * {threshold} / 100.0BD) as long) + 1")
    posts = groups.select("grp", "n", "hub", size.alias("p")).join(ranked.hint("shuffle_hash"), "grp").select("grp", "n", "hub", "p", F.size("r").alias("m"), F.posexplode("r").alias("at", "x"))
    posts = written(posts.select("x.tok", "x.c", "grp", "n", "hub", "p", (F.col("p") - F.col("m") + F.col("at")).alias("pos")), "posts")

    def sized(x: str, y: str):
        return (100 * F.least(x, y) >= threshold * F.greatest(x, y))

    # the original of a family of near copies meets more others at its prefix than any copy does: let it lead
    met_by = posts.groupBy("grp").agg(F.sum("c").alias("met"))
    ranked = posts.join(met_by.hint("shuffle_hash"), "grp")
    lead = ranked.groupBy("tok").agg(F.max(F.struct("met", "n", "grp", "hub")).alias("top")).select("tok", "top.*").toDF("tok", "l_met", "l_n", "l_grp", "l_hub")
    met = posts.join(written(lead, "leaders").hint("merge"), "tok").filter((F.col("grp") != F.col("l_grp")) & sized("n", "l_n"))
    # a leader met at less than a quarter of the prefix is left to the last step
    star = met.groupBy("grp", "p", "l_hub").agg(F.count("*").alias("c"), F.max("l_met").alias("m")).filter("4 * c >= p").groupBy("grp").agg(F.max(F.struct("c", "m", "l_hub")).alias("top"))
    led = star.select("grp", F.col("top.l_hub").alias("b"))
    many = groups.filter("size > 1").select("grp", "hub").join(led.hint("shuffle_hash"), "grp", "full_outer").select("grp", F.coalesce("b", "hub").alias("b"))
    pairs = written(nodes.select("node", "grp").join(many.hint("shuffle_hash"), "grp").filter("node <> b").select(F.col("node").alias("a"), "b"), "star")
    told = written(_compared(rows, pairs, k, known, deltas=True), "told")
    links = told.filter(_linked(threshold)).select("a", "b")
    roots = written(connected_components(links), "roots")

    anchors = told.filter("delta is not null").select(F.col("a").alias("node"), F.col("b").alias("anchor"))
    placed = written(
        nodes.select("node", "grp", "n").join(roots.hint("shuffle_hash"), "node", "left").join(anchors.hint("shuffle_hash"), "node", "left")
        .select("node", "grp", "n", F.coalesce("root", "node").alias("comp"), F.coalesce("anchor", "node").alias("anchor")), "placed"
    )
    links = links.union(_family_links(told, placed, threshold))

    cells = placed.select("grp", "comp", "anchor").distinct()
    at = posts.select("tok", "grp", "n", "p", "pos").join(cells.hint("shuffle_hash"), "grp")
    mixed = at.groupBy("tok").agg(F.min("anchor").alias("x"), F.max("anchor").alias("y")).filter("x <> y").select("tok")
    at = written(at.join(mixed.hint("shuffle_hash"), "tok"), "cells")
    one, two = (at.select("tok", F.col("anchor").alias(f"f{i}"), *(F.col(x).alias(f"{x}{i}") for x in ("grp", "n", "p", "pos", "comp"))) for i in (1, 2))
    # any shared shingle outside the prefixes comes after the prefix of one of the two, so so many of the prefix must be shared
    least = F.expr(f"cast(ceil({threshold} * (n1 + n2) / {100 + threshold}.0BD) as long) - greatest(n1 - p1, n2 - p2)")
    early = (F.col("pos1") <= F.col("p1") - least) & (F.col("pos2") <= F.col("p2") - least)
    ends = ["grp1", "comp1", "f1", "grp2", "comp2", "f2"]
    cross = one.join(two.hint("merge"), "tok").filter((F.col("f1") < F.col("f2")) & (F.col("comp1") != F.col("comp2")) & sized("n1", "n2") & early).select(*ends).distinct()
    cell = [placed.select(F.col("grp").alias(f"grp{i}"), F.col("comp").alias(f"comp{i}"), F.col("anchor").alias(f"f{i}"), F.col("node").alias(x)) for i, x in ((1, "a"), (2, "b"))]
    rest = written(cross.join(cell[0], ["grp1", "comp1", "f1"]).join(cell[1], ["grp2", "comp2", "f2"]).select("a", "b"), "rest")
    links = links.union(_compared(rows, rest, k, known).filter(_linked(threshold)).select("a", "b"))
    roots = connected_components(links)

    labelled = nodes.select("node", "low").join(roots.hint("shuffle_hash"), "node", "left").select("node", "low", F.coalesce("root", "node").alias("comp"))
    lows = labelled.groupBy("comp").agg(F.min("low").alias("component_id"))
    named = labelled.join(lows.hint("shuffle_hash"), "comp").select("node", "comp", "component_id")
    out = signed.filter("n > 0").select("doc_id", "digest", "n", "node").join(named, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "digest", "comp")
    out = out.union(signed.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), "digest", F.lit(None).cast("long")))
    return out if inner else out.drop("digest", "comp")


def one_of_each_component(docs: DataFrame, *, k: int = 5, threshold: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component one row, that with the smallest id (no id comes last), then the smallest text digest.

    Rows are told apart by id and text, so other rows of the same id keep their
    own fate.  Texts without words and null texts all stay.  Of equal rows of a
    component one stays.
    """
    told = written(jaccard_components(docs, k=k, threshold=threshold, doc_id=doc_id, text=text, inner=True), "told")
    order = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "digest")
    best = told.filter("comp is not null").groupBy("comp").agg(F.min(order).alias("best"))
    rows = told.filter("comp is not null").groupBy("comp", "doc_id", "digest").agg(F.count("*").alias("n"))
    rows = written(rows.join(best.hint("shuffle_hash"), "comp").withColumn("stays", order == F.col("best")).select("doc_id", "digest", "n", "stays"), "fates")
    repeated = rows.filter("stays and n > 1")

    def without(left: DataFrame, fates: DataFrame, how: str) -> DataFrame:
        right = fates.select(F.col("doc_id").alias("_i"), F.col("digest").alias("_d"))
        return left.join(right.hint("shuffle_hash"), F.col(doc_id).eqNullSafe(right["_i"]) & F.xxhash64(text).eqNullSafe(right["_d"]), how)

    out = without(docs, rows.filter("not stays"), "left_anti")
    if repeated.isEmpty():
        return out
    twice = without(docs, repeated, "left_semi").dropDuplicates([doc_id, text])
    return without(out, repeated, "left_anti").unionByName(twice)


def _linked(threshold: int):
    return F.col("both") * 100 >= threshold * (F.col("n_a") + F.col("n_b") - F.col("both"))


def _compared(rows: DataFrame, pairs: DataFrame, k: int, known, deltas: bool = False) -> DataFrame:
    """Pairs (a, b) of nodes with the sizes of their whole sets and of what both have; with ``delta``, what one of them has, if that is little (at most half of a)."""
    wanted = written(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "wanted")

    def sets(batches):
        for part in text_slices(batches):
            found = {}
            for codes in _shingle_sets(part, k, *known.value):
                if len(codes):
                    found.setdefault(_node(codes), codes.view(np.int64))
            if found:
                off = np.concatenate(([0], np.cumsum([len(v) for v in found.values()]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(found), pa.int64()), pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(list(found.values()))))], ["node", "items"]
                )

    every = rows.select("text").mapInArrow(freed(sets), "node long, items array<long>")
    few = wanted.count() <= BROADCAST_NODES
    held = every.join(wanted.hint("broadcast" if few else "shuffle_hash"), "node", "left_semi").dropDuplicates(["node"])
    # a leader of very many nodes meets them in several tasks: its pairs are counted by cells of (b, salt), so no step has them all under one key
    salted = pairs.distinct().withColumn("s", F.pmod(F.xxhash64("a"), F.lit(SPREAD)).cast("int"))
    cells = salted.groupBy("b", "s").agg(F.count("*").alias("c"))
    size = cells.groupBy("b").agg(F.sum("c").alias("c"))
    cells = cells.select("b", "s").join(size.hint("shuffle_hash"), "b").select("b", "s", F.when(F.col("c") > HOT_PAIRS, F.col("s")).otherwise(-1).alias("t"))
    leaders = cells.select("b", "t").distinct().join(held.select(F.col("node").alias("b"), F.col("items").alias("y")).hint("merge"), "b")
    one = salted.join(cells.hint("shuffle_hash"), ["b", "s"]).join(held.select(F.col("node").alias("a"), F.col("items").alias("x")).hint("merge"), "a")
    two = one.join(leaders.hint("merge"), ["b", "t"])
    delta = F.concat(F.array_except("x", "y"), F.array_except("y", "x"))
    more = [F.when(2 * F.size(delta) <= F.size("x"), delta).alias("delta")] if deltas else []
    return two.select("a", "b", F.size("x").alias("n_a"), F.size("y").alias("n_b"), F.size(F.array_intersect("x", "y")).alias("both"), *more)


def _family_links(told: DataFrame, placed: DataFrame, threshold: int) -> DataFrame:
    """Links among the nodes of one anchor that the anchor does not connect.

    With D the items that a node has and the anchor has not, or the other way
    round, two nodes differ by ``|D1| + |D2| - 2 |D1 and D2|``.  If one of them
    is not linked to the anchor, a link needs s >= 1 common items of D, so they
    meet at one of the first ``|D| - s + 1`` items of both, rarest first.
    """
    d = told.join(placed.select(F.col("node").alias("a"), F.col("anchor").alias("b"), "comp").hint("shuffle_hash"), ["a", "b"]).select(F.col("a").alias("node"), F.col("b").alias("anchor"), "comp", F.col("n_a").alias("n"), "delta")
    item = d.select("anchor", "node", F.explode("delta").alias("tok"))
    item = item.join(item.groupBy("anchor", "tok").agg(F.count("*").alias("c")).hint("shuffle_hash"), ["anchor", "tok"])
    ranked = item.groupBy("anchor", "node").agg(F.sort_array(F.collect_list(F.struct("c", "tok"))).alias("r"))
    at = ranked.join(d.drop("anchor", "delta").hint("shuffle_hash"), "node").select("anchor", "node", "comp", "n", F.size("r").alias("m"), F.posexplode("r").alias("pos", "x")).filter("x.c > 1")
    at = written(at.select("anchor", F.col("x.tok").alias("tok"), "node", "comp", "n", "m", "pos"), "family")
    one, two = (at.select("anchor", "tok", *(F.col(c).alias(f"{c}{i}") for c in ("node", "comp", "n", "m", "pos"))) for i in (1, 2))
    need = F.expr(f"cast(ceil((m1 + m2 - floor((n1 + n2) * {100 - threshold} / {100 + threshold}.0BD)) / 2.0BD) as int)")
    near = one.join(two, ["anchor", "tok"]).filter((F.col("node1") < F.col("node2")) & (F.col("comp1") != F.col("comp2")) & (F.col("pos1") <= F.col("m1") - need) & (F.col("pos2") <= F.col("m2") - need))
    near = near.select(F.col("node1").alias("a"), F.col("node2").alias("b"), F.col("n1").alias("n_a"), F.col("n2").alias("n_b")).distinct()
    side = [d.select(F.col("node").alias(x), F.col("delta").alias(f"d_{x}")) for x in "ab"]
    apart = F.size("d_a") + F.size("d_b") - 2 * F.size(F.array_intersect("d_a", "d_b"))
    out = near.join(side[0].hint("merge"), "a").join(side[1].hint("merge"), "b").withColumn("both", F.expr("n_a + n_b").cast("long") - apart)
    return written(out.withColumn("both", F.col("both") / 2).filter(_linked(threshold)).select("a", "b"), "links")


def op8_jaccard_join(spark, sf_dir) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=3, threshold=90)
