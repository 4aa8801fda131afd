import re
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.llm import blocks, jaccard_join
from assay.llm.components import connected_components
from assay.llm.jaccard_join import jaccard_components, one_per_group, share_prefixes, similar_sets
from assay.llm.storage import thinned


def shingle_set(text, k):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall("[^\x20\x09-\x0d]+", text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, percent):
    sets = {i: shingle_set(t, k) for i, t in rows}
    head = {i: i for i in sets}

    def find(a):
        while head[a] != a:
            a = head[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                head[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("k", "percent", "bits"), [(4, 85, 2**26), (5, 80, 1024), (1, 50, 64)])
def test_equals_brute_force(docs, rows, k, percent, bits, monkeypatch):
    monkeypatch.setattr(jaccard_join, "thinned", partial(thinned, bits=bits))  # 64: full, so that nothing leaves
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, k, percent).collect()}
    assert got == brute([(r[0], r[1]) for r in rows], k, percent)
    assert any(i != c for i, (_, c) in got.items())


def test_chain_of_near_copies(spark):
    words = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(30):  # each step changes one word, so neighbours link and ends do not
        words = [*words[:i], f"new{i}", *words[i + 1 :]]
        rows.append((100 - i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df, 4, 85).collect()}
    assert got == brute(rows, 4, 85)
    assert {c for _, c in got.values()} == {71}


def test_odd_and_empty(odd, empty):
    got = jaccard_components(odd, 4, 85).collect()
    assert len(got) == odd.count()
    assert {r.component_id for r in got if r.doc_id == 0} == {0}
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert jaccard_components(empty).count() == 0


def test_one_per_group(docs, rows, odd):
    heads = {c for _, c in brute([(r[0], r[1]) for r in rows], 5, 80).values()}
    kept = one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(heads)
    ids = [r.doc_id for r in one_per_group(odd).collect()]
    assert ids.count(None) == 2 and ids.count(0) == 2  # unlike texts under one id both stay, repeated rows go
    named = docs.withColumn("doc_id", F.format_string("d%03d", "doc_id"))
    assert sorted(r.doc_id for r in one_per_group(named).select("doc_id").collect()) == [f"d{i:03d}" for i in sorted(heads)]


def test_order_3_prunes_before_sets_are_fetched(spark, monkeypatch):
    percent, n = 80, 40
    sets = {0: [*range(n)], 1: [*range(2, n + 2)], 2: [*range(n - 6, 2 * n - 6)], 3: [*range(500, 500 + n)]}
    df = spark.createDataFrame([(i, n, t) for i, t in sets.items()], "id long, n long, tokens array<long>")
    ordered = F.array_sort(F.transform("tokens", lambda x: F.xxhash64(x)))
    df = df.withColumn("prefix_3", F.slice(ordered, 1, n - 32 + 32 // 8 + 1)).cache()
    pairs = spark.createDataFrame([(a, b) for a in sets for b in sets if a > b], "a long, b long")
    near = {tuple(r) for r in share_prefixes(pairs, df, percent).collect()}
    exact = {tuple(r) for r in similar_sets(pairs, df, percent).collect()}
    monkeypatch.setattr(jaccard_join, "thinned", lambda rows, *_: rows)
    assert near == {tuple(r) for r in share_prefixes(pairs, df, percent).collect()}
    assert exact == {tuple(r) for r in similar_sets(pairs, df, percent).collect()}
    assert exact == {(1, 0)} and exact <= near and len(near) < pairs.count()


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 99), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 51)) and got[100] == got[101] == 99
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_long_texts_in_pieces(rows, monkeypatch):
    hasher = blocks.WordHasher()
    data = np.frombuffer(max((r[1] or "" for r in rows), key=len).encode() + b"x" * 900, np.uint8)
    whole = hasher.words(data, np.array([0, len(data)]))[0]
    monkeypatch.setattr(blocks, "_PIECE", 100)
    got, at = hasher.words(data, np.array([0, len(data)]))
    assert got.tolist() == whole.tolist() and at.tolist() == [0, len(whole)]
