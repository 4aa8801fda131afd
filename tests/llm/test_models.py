import zlib

import numpy as np
import pyarrow as pa
import pytest

from assay.llm import toxicity
from assay.llm.lang_id import _long_code_lengths, fit_language_trees, identify_language
from assay.llm.quality_ensemble import RuleEnsemble, fit_quality_ensemble, score_quality, train
from assay.llm.quality_rules import apply_quality_rules, fit_quality_rules
from assay.llm.statistics import base_statistics, ratios
from assay.llm.toxicity import ToxicityModel, fit_toxicity, score_toxicity

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def given(spark):
    return tuple(spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))


def code_length(train_texts, text):
    """Bits of a text after texts, by prediction by partial matching as its definition says."""
    from collections import Counter, defaultdict

    follow = defaultdict(Counter)
    for t in train_texts:
        for k in range(4):
            for i in range(k, len(t)):
                follow[t[i - k : i]][t[i]] += 1
    bits = 0.0
    for i in range(len(text)):
        k = min(3, i)
        while k >= 0:
            seen = follow.get(text[i - k : i])
            if seen:
                n, d = sum(seen.values()), len(seen)
                if text[i] in seen:
                    bits -= np.log2(seen[text[i]] / (n + d))
                    break
                bits -= np.log2(d / (n + d))
            k -= 1
        else:
            bits += 8
    return bits


def test_code_lengths_are_exact(spark):
    texts = ["banana band and a ban", "abba cadabra", "zéro été"]
    ids = [i for i in range(50) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(ids[0], texts[0], "x"), (ids[1], texts[1], "x"), (ids[2], texts[2], "y")]
    trees = fit_language_trees(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    for text in ["banana", "cadabra été ☃", "q", "ban" * 100]:
        data = np.frombuffer(text.encode(), np.uint8)
        got = trees.code_lengths(data, np.array([0, len(data)]))[0]
        want = [code_length([t.encode() for t in texts[:2]], text.encode()), code_length([texts[2].encode()], text.encode())]
        assert got == pytest.approx(want, rel=1e-4)
        assert np.ravel(_long_code_lengths(trees, data, np.array([0, len(data)]), 7)) == pytest.approx(want, rel=1e-4)


def test_language_accuracy_and_odd_rows(given, docs, odd, empty):
    documents, _ = given
    trees = fit_language_trees(documents)
    got = identify_language(documents, trees).join(documents.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    small = {r.doc_id: r for r in identify_language(docs, trees).collect()}
    for r in docs.collect():
        assert (small[r.doc_id].lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
        assert small[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    assert identify_language(odd, trees).count() == odd.count() and identify_language(empty, trees).count() == 0
    assert fit_language_trees(empty) is None
    assert {r.lang_pred for r in identify_language(docs, None).collect()} == {"und"}


def test_toxicity(given, docs, odd, empty):
    documents, labels = given
    model = fit_toxicity(documents, labels)
    got = score_toxicity(documents, model).join(labels, "doc_id").where("held_out").collect()
    toxic = np.array([r.score for r in got if r.toxic])
    clean = np.array([r.score for r in got if not r.toxic])
    assert np.mean(toxic[:, None] > clean[None, :]) > 0.85 and np.mean(clean >= 0.5) < 0.05
    assert score_toxicity(odd, model).count() == odd.count() and score_toxicity(empty, model).count() == 0
    assert fit_toxicity(documents, labels.limit(0)) is None
    assert all(r.predicted == int(r.score >= 0.5) for r in score_toxicity(docs, model).collect())
    assert score_toxicity(docs, None).where("score <> 0").count() == 0


def brute_grams(text):
    text = f" {text.lower()} "
    return [text[i : i + n] for n in range(3, 7) for i in range(len(text) - n + 1)]


def hashes_of(text):
    """All n-gram hashes of a text, each hashed alone."""
    out = []
    for g in brute_grams(text):
        *_, (_, h) = toxicity._hashes([(0, g, len(g))])
        out.append(int(h[0]))
    return out


@pytest.mark.parametrize("piece", [50, 1 << 17])
def test_toxicity_scores_equal_definition(monkeypatch, piece):
    texts = ["", "ab", "Some text that is longer than one piece. " * 9, "short one", "été ☃ 日本語 " * 7]
    each = [hashes_of(t) for t in texts]
    known = np.array(sorted({h for x in each for h in x})[::3], np.uint64)
    weights = np.random.default_rng(0).normal(size=len(known)).astype(np.float32)
    by_hash = dict(zip(known.tolist(), weights.tolist(), strict=True))
    monkeypatch.setattr(toxicity, "_PIECE", piece)
    got = ToxicityModel(known, weights, 0.25).scorer()(pa.array(texts))
    want = [1 / (1 + np.exp(-(0.25 + 300 * sum(by_hash.get(h, 0.0) for h in x) / max(len(x), 1)))) for x in each]
    assert got == pytest.approx(want, rel=1e-4, abs=1e-9)
    assert ToxicityModel(known, weights, 0.25).scorer()(pa.array([None, ""])) == pytest.approx([1 / (1 + np.exp(-0.25))] * 2)


def test_ridge_fit_is_optimal():
    rng = np.random.default_rng(3)
    dense = rng.random((60, 8)) * (rng.random((60, 8)) > 0.5)
    y = (dense[:, 0] + 0.5 * rng.random(60) > 0.6).astype(int)
    rows, columns = np.nonzero(dense)
    weights = np.where(y == 1, 2.0, 1.0)
    w, b = toxicity.train(rows, columns, dense[rows, columns], y, weights, 8, ridge=0.01)
    share = np.where(y == 1, weights / weights[y == 1].sum() / 3, weights / weights[y == 0].sum() * 2 / 3)

    def loss(w, b):
        z = dense @ w + b
        return share @ np.logaddexp(0, np.where(y == 1, -z, z)) + 0.005 * w @ w

    best = loss(w, b)
    for _ in range(200):
        step = rng.normal(size=9) * 0.02
        assert loss(w + step[:8], b + step[8]) >= best - 1e-5


def test_gram_ratios_equal_brute_force(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 != 0][:40]
    texts = {i: ("you vile fool " if k % 2 else "a kind word ") + "and so on " * (k % 3) for k, i in enumerate(ids)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, toxic int")
    model = fit_toxicity(docs, labels)
    toxic, other = ({i: set(hashes_of(t)) for i, t in texts.items() if k == (ids.index(i) % 2)} for k in (1, 0))
    every = set().union(*toxic.values(), *other.values())
    want = set()
    for h in every:
        a, b = sum(h in x for x in toxic.values()), sum(h in x for x in other.values())
        ratio = np.log((a + 1) / (len(toxic) + 2)) - np.log((b + 1) / (len(other) + 2))
        if a + b >= 3 and abs(ratio) >= 2 * np.sqrt(1 / (a + 1) + 1 / (b + 1)):
            want.add(h)
    assert want and set(model.hashes.tolist()) == want


def test_quality(given, docs, odd, empty):
    documents, labels = given
    model = fit_quality_ensemble(documents, labels)
    got = score_quality(documents, model).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    assert score_quality(odd, model).count() == odd.count() and score_quality(empty, model).count() == 0
    none = score_quality(docs, fit_quality_ensemble(docs, labels.limit(0)))
    assert none.where("predicted = 0").count() == 0


def test_lasso_keeps_few_rules():
    rng = np.random.default_rng(1)
    x = rng.random((1500, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 1] > 0.3)).astype(float)
    model = train(x, y, np.ones(len(y)), list("abcd"))
    z = model.bias + sum(w * r.holds(x, list("abcd")) for r, w in zip(model.rules, model.weights, strict=True))
    assert np.mean((z > 0) == y) > 0.97 and len(model.rules) < 40


def test_lasso_is_optimal_and_compiled_as_trained(spark):
    rng = np.random.default_rng(1)
    x = rng.random((400, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] > 0.3)).astype(float)
    penalty = 0.01
    model = train(x, y, np.ones(len(y)), list("abc"), penalty=penalty, rounds=4000)
    assert model.rules
    r = np.column_stack([k.holds(x, list("abc")) for k in model.rules]).astype(float)
    p = 1 / (1 + np.exp(-(model.bias + r @ np.array(model.weights))))
    gradient = r.T @ (p - y) / len(y)
    # conditions of optimality: the loss pulls each kept weight with exactly the penalty
    assert gradient == pytest.approx(-penalty * np.sign(model.weights), abs=2e-4) and abs((p - y).mean()) < 2e-4
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "i int, a double, b double, c double")
    got = [v.score for v in df.select("i", model.score().alias("score")).orderBy("i").collect()]
    assert got == pytest.approx(p.tolist())


def test_quality_score_equals_brute_force(given, spark):
    documents, labels = given
    model = fit_quality_ensemble(documents, labels)
    rows, names = ratios(base_statistics(documents))
    statistics = {r.doc_id: np.array([[r[n] for n in names]]) for r in rows.select("doc_id", *names).collect()}
    for r in score_quality(documents, model).collect():
        z = model.bias + sum(w for rule, w in zip(model.rules, model.weights, strict=True) if rule.holds(statistics[r.doc_id], names)[0])
        assert r.score == pytest.approx(1 / (1 + np.exp(-z))) and r.predicted == int(r.score >= 0.3)


def test_other_columns_stay(spark):
    clash = spark.createDataFrame([(1, "some words here", 7.5, 8, 9)], "doc_id long, text string, s_length double, n_words long, id long")
    out = score_quality(clash, RuleEnsemble(0.0, (), ())).first()
    assert (out.s_length, out.n_words, out.id) == (7.5, 8, 9)
    out = apply_quality_rules(clash, []).first()
    assert (out.s_length, out.n_words, out.id) == (7.5, 3, 9)


def test_decision_list_verdict_equals_brute_force(given):
    documents, labels = given
    rules = fit_quality_rules(documents, labels)
    assert rules
    rows, names = ratios(base_statistics(documents))
    statistics = {r.doc_id: r for r in rows.select("doc_id", "n_words", "n_repeat_words", *names).collect()}
    meets = lambda r, c: r[c.statistic] > c.threshold if c.above else r[c.statistic] <= c.threshold
    for r in apply_quality_rules(documents.select("doc_id", "text"), rules).collect():
        s = statistics[r.doc_id]
        first = next((i for i, rule in enumerate(rules, 1) if all(meets(s, c) for c in rule.conditions)), None)
        failed = s.n_words < 20 or 100 * s.n_repeat_words > 30 * s.n_words
        assert (r.rule, r.base_failed, r.kept) == (first, failed, not failed and first is None)
