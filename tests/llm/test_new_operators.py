"""Merkle manifests, repeated passages and centroid clusters: against SQL, plain Python, and awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import centroids, merkle, registry, substrings
from tests.compare import same
from tests.llm.test_corpus import AWKWARD, FOLDER, SCHEMA

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA).withColumns({"root": F.lit(1), "leaf": F.lit("x"), "tree": F.lit(2.0), "doc": F.lit(3), "seed": F.lit(None), "a.b": F.lit(1)})


# ------------------------------------------------------------------ manifest


def plain_leaf(row, fields):
    parts = [None if row[c] is None else str(row[c]) for c in fields]
    return sha("".join("-" if p is None else f"{len(p.encode())}:{p}" for p in parts))


def plain_levels(nodes):
    """All levels of a tree, from its leaves to its root."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def plain_path(levels, i):
    path = []
    for level in levels[:-1]:
        run = level[i // 16 * 16 : i // 16 * 16 + 16]
        path.append((i % 16, run[: i % 16] + run[i % 16 + 1 :]))
        i //= 16
    return path


def plain_proofs(rows, fields, claim=lambda r: r):
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r, fields))
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted((r for r in rows if r["source"] == s), key=key) for s in sources}
    levels = {s: plain_levels([plain_leaf(r, fields) for r in own]) for s, own in trees.items()}
    top = plain_levels([levels[s][-1][0] for s in sources])
    for n, s in enumerate(sources):
        for i, r in enumerate(trees[s]):
            path = plain_path(levels[s], i) + plain_path(top, n)
            f = plain_leaf(claim(r), fields)
            for at, others in path:
                f = sha("".join([*others[:at], f, *others[at:]]))
            yield (r["doc_id"], levels[s][0][i], levels[s][-1][0], top[-1][0], sha("".join(x for _, o in path for x in o)), f, f == top[-1][0])


def found(df):
    cols = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_positions_in_a_log_are_those_of_appending():
    for n in (1, 2, 15, 16, 17, 255, 256, 257, 4095, 4096):
        log = merkle.build([f"{i:064x}" for i in range(n)], 0, n)
        levels = plain_levels([f"{i:064x}" for i in range(n)])
        assert len(log) == sum(map(len, levels)) if n > 1 else log == levels[0]
        for k, level in enumerate(levels):
            assert [log[merkle.position(k, i, n)] for i in range(len(level))] == level
    n = 3 * merkle.SPAN + 77  # the last segment of four, and a full one
    for b in (1, 3):
        own = [f"{i:064x}" for i in range(b * merkle.SPAN, min((b + 1) * merkle.SPAN, n))]
        log = merkle.build(own, b * merkle.SPAN, n)
        assert log[-1] == plain_levels(own)[-1][0] if b == 1 else len(log) == 77 + 5 + 1 + 1
        assert all(log[merkle.position(0, b * merkle.SPAN + i, n) - merkle.leaf_position(b * merkle.SPAN)] == x for i, x in enumerate(own))


def test_manifest_in_small_segments_is_the_plain_one(spark, monkeypatch):
    rng = random.Random(5)
    rows = [{"doc_id": i, "source": rng.choice(["hot", "hot", "b", None, "ä", "B"]), "lang": None if i % 7 == 0 else "en", "n_chars": i % 5 or None, "text": "Text é" * (i % 4) if i % 9 else None} for i in range(700)]
    rows += [{"doc_id": 9999, "source": f"lone{i}", "lang": "x", "n_chars": 1, "text": "t"} for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    lower = merkle.leaf([merkle.lower_az(F.col(c)) if c == "text" else F.col(c) for c in merkle.FIELDS])
    claim = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, lower)

    def changed(r):
        return r | {"text": r["text"] and r["text"].translate(SMALL)} if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 else r

    want = sorted(plain_proofs(rows, merkle.FIELDS, changed), key=str)
    assert found(merkle.proofs(merkle.manifest(docs, claim=claim))) == want
    assert {r[-1] for r in want} == {True, False}
    m = merkle.manifest(docs)
    nodes = m.nodes()
    assert nodes.filter("tree is null").count() > 40 and nodes.filter("tree = '+hot'").select("position").distinct().count() == nodes.filter("tree = '+hot'").count()
    assert {r[-1] for r in found(merkle.proofs(m))} == {True}


def test_trees_of_several_tiers(spark):
    n = 9000  # three segments in the first tier
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") < n - 3, "hot").otherwise(F.concat(F.lit("s"), "id")).alias("source"), F.lit(None).cast("string").alias("lang"), F.lit(1).alias("n_chars"), F.col("id").cast("string").alias("text"))
    rows = [r.asDict() for r in docs.collect()]
    assert found(merkle.proofs(merkle.manifest(docs))) == sorted(plain_proofs(rows, merkle.FIELDS), key=str)


def test_manifest_of_awkward_rows(spark, awkward):
    rows = [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in AWKWARD]
    assert found(merkle.proofs(merkle.manifest(awkward))) == sorted(plain_proofs(rows, merkle.FIELDS), key=str)
    one = awkward.filter("doc_id = 1")
    only = found(merkle.proofs(merkle.manifest(one)))
    assert len(only) == 1 and only[0][1] == only[0][2] == only[0][3] and only[0][4] == sha("")  # a lone leaf has no siblings
    empty = merkle.manifest(awkward.limit(0))
    assert empty.root is None and merkle.proofs(empty).count() == 0


# ------------------------------------------------------------------ repeated passages


def plain_removed(rows, size):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (d, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - size + 1):
            x = tuple(w[i : i + size])
            if d is not None:
                least[x] = min(least.get(x, d), d)
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if d is not None and least[tuple(w[i : i + size])] < d:
                gone[i : i + size] = [True] * size
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=str)


def removed(df):
    rows = df.collect()
    for r in rows:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed and all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in rows), key=str)


@pytest.mark.parametrize("seed,size,k", [(1, 6, 2), (2, 6, 6), (3, 9, 3), (4, 5, 1)])
def test_repeats_by_brute_force(spark, seed, size, k):
    rng = random.Random(seed)
    bank = [[rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(3, 40))] for _ in range(12)]
    rows = []
    for i in range(120):
        w = [x for _ in range(rng.randint(0, 6)) for x in (rng.choice(bank) if rng.random() < 0.6 else [rng.choice("xyzuvw") for _ in range(rng.randint(1, 9))])]
        for at in range(len(w)):
            if rng.random() < 0.02:
                w[at] = "edit"
        rows.append((rng.choice([i, i, i, None, i // 2]), rng.choice([" ", "\n", " \t "]).join(w)))
    rows += [(500 + i, "a " * n) for i, n in enumerate((3, 200, 90, 200))] + [(600, None), (601, ""), (602, "é " * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = removed(substrings.without_repeats(docs, size=size, k=k))
    want = plain_removed(rows, size)
    assert got == want and sum(x[2] for x in want) > 300


def test_a_passage_in_every_document_and_texts_of_awkward_rows(spark, awkward):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"own{i} before{i} {passage} after{i} " + "z " * (i % 3)) for i in range(300)]
    got = removed(substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == plain_removed(rows, 50) and [x[2] for x in got].count(60) == 299
    rows = [(r[0], r[1]) for r in AWKWARD] + [(9, "long word " * 100), (5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"doc": F.lit(1), "seed": F.lit("x"), "a.b": F.lit(2), "n_words": F.lit(0)})
    assert removed(substrings.without_repeats(docs)) == plain_removed(rows, 50)
    assert substrings.without_repeats(awkward.limit(0)).count() == 0


# ------------------------------------------------------------------ clusters


def plain_clusters(vectors, k, rounds):
    """vectors: (id, list) that count, in order of their first centroid's rank."""
    x = np.array([v for _, v in vectors], np.int64)
    c = x[: min(k, len(x))].copy()
    for r in range(rounds + 1):
        d = ((x[:, None, :] - c[None]) ** 2).sum(2)
        label = d.argmin(1)
        if r < rounds:
            for j in range(len(c)):
                if (label == j).any():
                    c[j] = [s // int((label == j).sum()) for s in x[label == j].sum(0).tolist()]
    return label, d[np.arange(len(x)), label], c


@pytest.mark.parametrize("wide", [1.0, 3e4])
def test_clusters_by_plain_lloyd(spark, wide):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(0, wide, 7)]) for i in range(300)] + [(300 + i, [wide] * 7) for i in range(200)]  # a hot vector
    rows += [(900, None), (901, []), (902, [1.0] * 6), (903, [1.0] * 6 + [None]), (904, [1.0] * 6 + [float("nan")]), (905, [float("inf")] * 7), (0, rows[0][1]), (None, [0.5] * 7)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit(1), "cluster": F.lit(2), "a.b": F.lit(3)})
    got, centres = centroids.cluster(v.repartition(3), k=9, rounds=4, components=7, block=3)
    kept = [(i, np.floor(256 * np.array(x, np.float32).astype(float)).astype(np.int64).tolist()) for i, x in rows if x and len(x) == 7 and all(y is not None and np.isfinite(y) for y in x)]
    kept.sort(key=lambda r: (r[0] is None, sha(f"2:{r[0]}") if r[0] is not None else "", r[1]))
    label, d, c = plain_clusters(kept, 9, 4)
    assert np.array_equal(centres, c)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(((i, int(a), int(b)) for (i, _), a, b in zip(kept, label, d, strict=True)), key=str)
    full = centroids.with_inertia(got, centres).collect()
    assert {r.inertia for r in full} == {int(d.sum())} and all(r.cluster_inertia == int(d[label == r.cluster].sum()) for r in full)
    assert all(r.centroid_sha256 == sha(",".join(map(str, c[r.cluster].tolist()))) for r in full)


def test_clusters_of_few_vectors_and_of_none(spark):
    v = spark.createDataFrame([(i, [float(i)] * 64) for i in range(3)], "vec_id long, embedding array<double>")
    got, c = centroids.cluster(v)
    assert len(c) == 3 and got.count() == 3 and {r.distance for r in got.collect()} == {0}
    got, c = centroids.cluster(v.limit(0))
    assert got.count() == 0 and centroids.with_inertia(got, c).count() == 0
    big, c = centroids.cluster(spark.createDataFrame([(1, [1e30] * 64), (2, [-1e30] * 64)], "vec_id long, embedding array<double>"), k=1)
    assert sorted(r.distance for r in big.collect()) == [64 * (1 << 54)] * 2  # held at 2**27


@pytest.mark.parametrize("block", [64, 16, 7])
def test_distances_do_not_depend_on_the_shards(spark, block):
    v = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    got, c = centroids.cluster(v, block=block)
    ids = got.agg(F.sum(F.xxhash64("id", "cluster", "distance").cast("decimal(20,0)"))).first()[0]
    if not hasattr(test_distances_do_not_depend_on_the_shards, "seen"):
        test_distances_do_not_depend_on_the_shards.seen = ids
    assert ids == test_distances_do_not_depend_on_the_shards.seen


def test_new_queries_are_registered_with_sql():
    assert {"op11_merkle", "op12_substrings", "op13_centroids"} <= set(registry.QUERIES) & set(registry.SQL)
    assert same is not None
