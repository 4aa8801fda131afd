"""Brute-force versions of the Merkle manifest, the centroid clustering and the SimHash components."""

import hashlib
import math
import random
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from assay.llm.centroids import centroid_clusters
from assay.llm.merkle import folded, merkle_manifest, proof_digest
from assay.llm.simhash import covering_masks, fingerprint, half_way_flips, near_links, simhash_components

SPACES = " \t\n\x0b\x0c\r"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def words_of(text):
    out, word = [], ""
    for c in lowered(text or "") + " ":
        if c in SPACES:
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out


def plain_fingerprint(text):
    w = words_of(text)
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, linked):
    """nodes: {id: [fingerprints]}; least id reachable."""
    ids = list(nodes)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(linked(x, y) for x in nodes[a] for y in nodes[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    least = {}
    for i in ids:
        least[find(i)] = min(least.get(find(i), i), i)
    return {i: least[find(i)] for i in ids}


def test_every_pair_within_the_radius_collides():
    masks = covering_masks(2)
    assert len(masks) == 7
    for i in range(64):
        for j in range(i + 1):
            assert any(not (m >> i & 1 or m >> j & 1) for m in masks)
    for m in masks:
        flips = half_way_flips(m, 2)
        assert all(x & m == 0 for x in flips) and len(flips) == 1 + 64 - m.bit_count()


def test_links_of_crowded_buckets(spark):
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    fps = set(seeds)
    for s in seeds:
        for _ in range(60):
            x = s
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4])):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    links = near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), 2).collect()
    assert all(bin((r.a ^ r.b) % 2**64).count("1") <= 2 for r in links)
    got = plain_components({x: [x] for x in signed}, lambda a, b: False)
    parent = dict(got)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in links:
        x, y = sorted((find(r.a), find(r.b)))
        parent[y] = x
    want = plain_components({x: [x] for x in signed}, lambda a, b: bin((a ^ b) % 2**64).count("1") <= 2)
    assert {x: find(x) for x in signed} == want
    assert len(set(want.values())) < len(fps) - 50


def check_simhash(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    nodes = {}
    for i, t in rows:
        if i is not None:
            nodes.setdefault(i, []).append(plain_fingerprint(t))
    least = plain_components(nodes, lambda a, b: (a ^ b).bit_count() <= 2)
    want = sorted(((str(i), f"{plain_fingerprint(t):016x}", str(least.get(i))) for i, t in rows))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash_components(docs).collect())
    assert got == want


def test_simhash_against_brute_force(docs, odd):
    check_simhash(docs)
    check_simhash(odd)


def test_simhash_with_text_ids_pieces_and_no_rows(spark, rows, empty):
    check_simhash(spark.createDataFrame([(f"d{i}", t) for i, t, *_ in rows], "doc_id string, text string"))
    assert simhash_components(empty).count() == 0
    with pytest.raises(ValueError):
        simhash_components(empty, radius=3)
    rng = random.Random(5)
    text = " ".join("".join(rng.choice("aBcé ") for _ in range(rng.randint(1, 9))) for _ in range(400_000))
    assert len(text) > 2 << 20
    w = words_of(text)
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(len(w) - 2)]
    assert fingerprint(text.encode(), 3) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_clusters(rows, k, rounds, dims):
    kept = []
    most = math.isqrt(2**60 // dims)
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [max(-most, min(most, math.floor(1024 * x))) for x in v]))
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(x) for _, x in start[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        members = {}
        for _, x in kept:
            members.setdefault(nearest(x)[1], []).append(x)
        for n, xs in members.items():
            centroids[n] = [sum(c) // len(xs) for c in zip(*xs)]
    out = [(i, *nearest(x)) for i, x in kept]
    total = sum(d for _, d, _ in out)
    return sorted(
        (str(i), c, d, sum(e for _, e, b in out if b == c), total, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, d, c in out
    )


VECTORS = "vec_id long, embedding array<double>, cluster int, x string, distance long"


def vectors(rng, n, dims):
    rows = [(i, [rng.gauss(i % 5, 0.3) for _ in range(dims)]) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(40)]  # a common vector
    rows += [(0, rows[1][1]), (0, rows[1][1]), (None, rows[2][1]), (None, rows[3][1])]
    rows += [(900, None), (901, []), (902, [1.0] * (dims - 1)), (903, [1.0] * (dims + 1)), (904, [float("nan")] + [0.0] * (dims - 1))]
    rows += [(905, [float("-inf")] + [0.0] * (dims - 1)), (906, [None] + [0.0] * (dims - 1)), (907, [1e300] + [0.0] * (dims - 1)), (908, [-1e9] * dims)]
    return rows


@pytest.mark.parametrize("dims,k", [(64, 8), (3, 8), (3, 400)])
def test_clusters_against_brute_force(spark, dims, k):
    rows = vectors(random.Random(dims), 90, dims)
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], VECTORS).repartition(3)
    out = centroid_clusters(df, clusters=k, rounds=4, dims=dims)
    got = sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in out.collect())
    want = plain_clusters(rows, k, 4, dims)
    assert [g[:3] for g in got] == [w[:1] + (w[1],) + (w[2],) for w in want]
    assert got == [(*w[:3], min(w[3], 2**63 - 1), min(w[4], 2**63 - 1), w[5]) for w in want]


def test_clusters_of_nothing(spark):
    out = centroid_clusters(spark.createDataFrame([], VECTORS))
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and out.count() == 0
    assert centroid_clusters(spark.createDataFrame([(1, [1.0], 1, "x", 1)], VECTORS)).count() == 0
    floats = spark.createDataFrame([(1, [0.1] * 64)], "vec_id long, embedding array<float>")
    assert [r.distance for r in centroid_clusters(floats).collect()] == [0]


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(*values):
    texts = [None if v is None else str(v) for v in values]
    return H(*("-" if v is None else f"{len(v.encode())}:{v}" for v in texts))


def plain_tree(leaves):
    """Root, and the path of each leaf: pairs of left and right."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, p in enumerate(paths):
            run = at[i] // 16 * 16
            p.append(("".join(level[run : at[i]]), "".join(level[at[i] + 1 : run + 16])))
            at[i] //= 16
        level = [H(*level[i : i + 16]) for i in range(0, len(level), 16)]
    return level[0], paths


def plain_manifest(rows):
    sources = {}
    for r in rows:
        sources.setdefault(r[3], []).append(r)
    keys = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in keys:
        rs = sorted(sources[s], key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, plain_leaf(r[0], r[3], r[2], r[4], r[1])))
        built[s] = (rs, *plain_tree([plain_leaf(r[0], r[3], r[2], r[4], r[1]) for r in rs]))
    root, top = plain_tree([built[s][1] for s in keys])
    out = []
    for s, above in zip(keys, top):
        rs, subroot, paths = built[s]
        for r, path in zip(rs, paths):
            i, text, lang, source, n = r[:5]
            leaf = plain_leaf(i, source, lang, n, text)
            tampered = zlib.crc32(str("" if i is None else i).encode()) % 5 == 0 and text is not None
            h = plain_leaf(i, source, lang, n, lowered(text)) if tampered else leaf
            for left, right in path + above:
                h = H(left, h, right)
            proof = H(*(a + b for a, b in path + above))
            out.append((str(i), leaf, subroot, root, proof, h, h == root))
    return sorted(out)


def manifest(docs):
    found = F.when(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    out = merkle_manifest(docs, found=F.coalesce(found, F.col("text")))
    out = out.withColumn("proof", proof_digest()).withColumn("folded", folded(F.coalesce("found_leaf", "leaf")))
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof, r.folded, r.folded == r.root) for r in out.collect())


def test_manifest_against_brute_force(spark, docs, odd, rows, empty):
    assert manifest(docs) == plain_manifest(rows)
    assert manifest(odd) == plain_manifest([tuple(r)[:5] for r in odd.collect()])
    assert manifest(empty) == []
    # three levels in one source, single leaves, many sources
    rng = random.Random(2)
    many = [(i, f"Text {i} " * rng.randint(0, 3), "en", None if i % 9 == 0 else "hot" if i < 700 else f"s{i % 90}" if i < 850 else f"\U0001f600{i}" if i % 2 else f"é{i}", i) for i in range(900)]
    rng.shuffle(many)
    df = spark.createDataFrame(many, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = manifest(df)
    assert got == plain_manifest(many)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_orders_text_ids_and_folds_the_original(spark):
    rows = [(f"{i}", "A" * i, None, "s", i) for i in range(40)]
    out = merkle_manifest(spark.createDataFrame(rows, "doc_id string, text string, lang string, source string, n_chars long"))
    got = out.withColumn("ok", folded(F.col("leaf")) == F.col("root")).collect()
    assert len(got) == 40 and all(r.ok and r.found_leaf is None and r.subroot == r.root for r in got)
    want, _ = plain_tree([plain_leaf(r[0], r[3], r[2], r[4], r[1]) for r in sorted(rows)])
    assert {r.root for r in got} == {want}
