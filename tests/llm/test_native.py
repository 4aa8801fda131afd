import hashlib
import itertools
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from assay.llm.decontamination import contaminated, decontaminate
from assay.llm.line_dedup import dedup_lines
from assay.llm.mixing import apportion, mix_sources, source_targets
from assay.llm.quality_rules import Condition, Rule, apply_quality_rules, learn_decision_list, verdict
from assay.llm.sharding import balanced_shards
from assay.llm.statistics import base_statistics

WORD = re.compile("[^\x20\x09-\x0d]+")


def test_shards_are_contiguous_and_balanced(docs, rows):
    got = sorted(balanced_shards(docs, 5).select("doc_id", "size", "shard", "slot").collect())
    assert [r.size for r in got] == [len((r[1] or "").encode()) + 1 for r in rows]
    assert [r.shard for r in got] == sorted(r.shard for r in got)
    total, upto, seen = sum(r.size for r in got), 0, Counter()
    for r in got:
        assert r.shard == min(4, 5 * (2 * upto + r.size) // (2 * total)) and r.slot == seen[r.shard]
        upto += r.size
        seen[r.shard] += 1


def test_shards_of_odd_tables(odd, empty, spark):
    got = balanced_shards(odd, 3)
    assert got.columns.count("size") == got.columns.count("shard") == 1 and got.count() == odd.count()
    assert balanced_shards(empty, 3).count() == 0
    same = spark.createDataFrame([(1, "abc")] * 90, "doc_id long, text string")
    assert Counter(r.shard for r in balanced_shards(same, 3).collect()) == {0: 30, 1: 30, 2: 30}


def webster(weights, seats):
    won = [0] * len(weights)
    for _ in range(seats):
        i = max(range(len(weights)), key=lambda i: (weights[i] / (2 * won[i] + 1), -i))
        won[i] += 1
    return won


@pytest.mark.parametrize("weights", [[5, 3, 1], [100, 1, 1, 1, 1, 1], [7, 7, 7], [0, 4, 0, 9], [1]])
@pytest.mark.parametrize("seats", [0, 1, 2, 10, 37, 1000])
def test_apportionment_is_sainte_lague(spark, weights, seats):
    df = spark.createDataFrame([(i, float(w), seats, 1) for i, w in enumerate(weights)], "i int, w double, seats long, g int")
    got = {r.i: r.quota for r in apportion(df, "w", "seats", ["g"], "i").collect()}
    assert [got[i] for i in range(len(weights))] == webster(weights, seats)


def test_targets_stop_at_the_limit(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 5), (None, 200)], "source string, source_size long")
    got = {r.source: r.target for r in source_targets(sizes).collect()}
    assert got["a"] == 30 and got["c"] == 15 and got[None] == pytest.approx((1215 - 45) / 3) and got["b"] == pytest.approx((1215 - 45) * 2 / 3)
    zero = spark.createDataFrame([("a", 0), ("b", 0)], "source string, source_size long")
    assert [r.target for r in source_targets(zero).collect()] == [0, 0]


def test_mix(docs, rows, odd, empty):
    got = mix_sources(docs).collect()
    by = {}
    for r in got:
        assert r.size == len(WORD.findall(r.text or "")) and 0 <= r.taken <= 3 * r.size
        by.setdefault(r.source, [0, r.target, r.source_size])[0] += r.taken
    assert all(abs(taken - target) <= 2 for taken, target, _ in by.values())
    assert sum(x[1] for x in by.values()) == pytest.approx(sum(x[2] for x in by.values()))
    assert sorted((r.doc_id, r.taken) for r in mix_sources(docs.repartition(3)).collect()) == sorted((r.doc_id, r.taken) for r in got)
    assert mix_sources(odd).count() == odd.count() and mix_sources(empty).count() == 0


def brute_lines(rows, run=3):
    seen, out = set(), {}
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = set()
        for p in range(len(lines) - run + 1):
            key = tuple(lines[p : p + run])
            if key in seen:
                gone |= set(range(p, p + run))
            seen.add(key)
        out[i] = (len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


def test_lines_equal_brute_force(docs, rows, odd, empty):
    expected = brute_lines([(r[0], r[1]) for r in rows])
    got = {r.doc_id: (r.n_removed, r.text or "") for r in dedup_lines(docs).collect()}
    assert got == expected and any(n for n, _ in got.values())
    assert dedup_lines(odd).count() == odd.count() and dedup_lines(empty).count() == 0
    assert dedup_lines(docs).where("text IS NULL").count() == 1


ITEM = "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def leak_cases(spark):
    w = ITEM.split()
    swapped = list(w)
    swapped[3], swapped[12] = "wrong", "wrong"
    noise = [f"n{i}" for i in range(40)]
    texts = {
        1: " ".join(noise + w + noise),
        2: " ".join(noise + [x.upper() for x in swapped] + noise),
        3: " ".join(noise),
        4: " ".join(w[2:] + noise),
        5: None,
        6: "",
        7: " ".join(noise + w[:9] + noise),
        8: "say short item here",
        9: " ".join(w[::-1]),
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame([(10, ITEM), (11, "Short item"), (12, None), (13, ""), (None, ITEM)], "item_id long, text string")
    return docs, bench


def test_leaks(spark, docs, empty, odd):
    cases, bench = leak_cases(spark)
    got = {(r.doc_id, r.item_id): (r.matched, r.compared, r.start) for r in contaminated(cases, bench).collect()}
    assert set(got) == {(1, 10), (2, 10), (4, 10), (8, 11)}
    assert got[1, 10] == (20, 20, 40) and got[2, 10] == (18, 20, 40) and got[4, 10] == (18, 18, -2)
    kept = decontaminate(cases.withColumn("row_id", F.lit("x")), bench)
    assert kept.columns == ["doc_id", "text", "row_id"] and sorted(r.doc_id for r in kept.collect()) == [3, 5, 6, 7, 9]
    assert contaminated(docs, bench).count() == 0 and contaminated(empty, bench).count() == 0
    assert contaminated(cases, bench.limit(0)).count() == 0
    assert decontaminate(odd, bench).count() == odd.count()


def brute_statistics(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + j for i in range(len(words) - 7) if n[tuple(words[i : i + 8])] > 1 for j in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_statistics_equal_brute_force(docs, rows, spark):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = {r[0]: tuple(r[1:]) for r in base_statistics(docs).select("doc_id", *names).collect()}
    assert got == {r[0]: brute_statistics(r[1]) for r in rows}
    more = ["a|b <c> #*$%&\n\x0b\n \na|b <c> #*$%&", "w " * 30, " ".join("abcdefghij" * 2), "日本 " * 9 + "x"]
    df = spark.createDataFrame(list(enumerate(more)), "doc_id long, text string")
    assert {r[0]: tuple(r[1:]) for r in base_statistics(df).select("doc_id", *names).collect()} == dict(enumerate(map(brute_statistics, more)))


def test_rules_are_learned_and_applied(spark, docs, rows, odd, empty):
    sample = [{"y": int(i % 4 > 0), "order": i, "a": float(i % 4 > 0) + i / 1e4, "b": float(i % 7)} for i in range(400)]
    rules = learn_decision_list(sample, ["a", "b"], {0: 1.0, 1: 1.0})
    assert rules and all(c.statistic == "a" for r in rules for c in r.conditions)
    df = spark.createDataFrame([(float(x),) for x in (0, 2)], "a double").withColumn("b", F.lit(0.0))
    assert [r.kept for r in df.select(verdict(rules).alias("kept")).collect()] == [False, True]
    assert learn_decision_list([], ["a"], {}) == []
    got = {r.doc_id: r for r in apply_quality_rules(docs, [Rule((Condition("__s_upper", True, 0.5),))]).collect()}
    for r in rows:
        n, _, _, _, repeats = brute_statistics(r[1])
        assert got[r[0]].base_failed == (n < 20 or 100 * repeats > 30 * n)
        assert not (got[r[0]].kept and got[r[0]].base_failed)
    assert apply_quality_rules(odd, []).count() == odd.count() and apply_quality_rules(empty, []).count() == 0


def test_line_digest(docs):
    r = dedup_lines(docs).select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"), "text").first()
    assert r.h == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_long_runs_of_one_or_two_lines_go(spark):
    line = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    long, left, right, short = line("a", 51), line("b", 30), line("c", 21), line("d", 50)
    texts = [f"{long}\nx1", f"x2\n{long}\nx3", long, f"{left}\n{right}", f"y\n{left}\n{right}\nz", f"{left}\n{right}", short, short, f"{long} e\n{right}", f"{right}\n{left}"]
    got = {r.doc_id: (r.n_removed, r.text) for r in dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    gone = {1: (1, "x2\nx3"), 2: (1, ""), 4: (2, "y\nz"), 5: (2, "")}
    assert got == {i: gone.get(i, (0, t)) for i, t in enumerate(texts)}


def test_small_sources_of_a_large_corpus_get_their_targets(spark):
    large = spark.range(8).select("id", F.lit("a").alias("source"), F.repeat(F.lit("w "), 2_000_000).alias("text"))
    small = spark.range(100, 121).select("id", F.when(F.col("id") < 120, "b").otherwise("c").alias("source"), F.when(F.col("id") < 120, "w x y z").otherwise("w x").alias("text"))
    got = mix_sources(large.unionByName(small).withColumnRenamed("id", "doc_id")).groupBy("source", "target").agg(F.sum("taken").alias("taken"), F.max(F.expr("taken - 3 * size")).alias("over"))
    by = {r.source: r for r in got.collect()}
    assert by["b"].target == 240 and by["c"].target == 6 and all(abs(r.taken - r.target) <= 2 and r.over <= 0 for r in by.values())


@pytest.mark.parametrize("weights", [[60_000, 600_000, 4_999_340_000], [15_000_000_000, 1, 2]])
def test_apportionment_of_billions_of_seats(spark, weights):
    seats = sum(weights)
    df = spark.createDataFrame([(i, float(w), seats, 1) for i, w in enumerate(weights)], "i int, w double, seats long, g int")
    assert [r.quota for r in apportion(df, "w", "seats", ["g"], "i").orderBy("i").collect()] == weights


def test_no_allowed_substitutions_hide_a_leak(spark):
    """Every placement of substitutions, against an aligned comparison that uses no masks."""
    noise = lambda i: [f"n{i}x{j}" for j in range(20)]
    items, texts, expected = {}, {}, set()
    for n, k, step in ((16, 3, 1), (16, 2, 1), (16, 4, 20), (20, 4, 7), (12, 1, 1), (12, 2, 1), (12, 3, 9), (13, 2, 1), (14, 2, 1), (15, 3, 1), (15, 4, 60)):
        items[n] = [f"t{n}y{j}" for j in range(n)]
        for gone in itertools.islice(itertools.combinations(range(n), k), 0, None, step):
            i, w = len(texts), min(16, n)
            words = [f"s{i}z{j}" if j in gone else x for j, x in enumerate(items[n])]
            texts[i] = " ".join(noise(i) + words + noise(-i)) if i % 2 else " ".join(words)
            if any(100 * sum(j not in gone for j in range(a, a + w)) >= 80 * w for a in range(n - w + 1)):
                expected.add((i, n))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()} == expected
    long = {(i, n) for i, n in expected if n >= 16}
    assert {(r.doc_id, r.item_id) for r in contaminated(docs, bench.where("item_id >= 16")).collect()} == long


def test_lines_keep_other_columns_and_take_any_id(spark):
    text = "one\ntwo\nthree"
    df = spark.createDataFrame([("b", text, 1, "mine"), ("a", text, 2, "too"), (None, "x", 3, None)], "doc_id string, text string, row_id int, row_hash string")
    got = {r.doc_id: r for r in dedup_lines(df).collect()}
    assert (got["a"].text, got["a"].row_id, got["a"].row_hash) == (text, 2, "too")
    assert (got["b"].n_removed, got["b"].row_id, got["b"].row_hash) == (3, 1, "mine") and got[None].text == "x"


def test_fingerprints_are_window_minima(docs, rows):
    """Each run of three lines has exactly one chosen line, and only chosen lines are rows."""
    from assay.llm.line_dedup import fingerprints

    keyed = docs.where("text IS NOT NULL").select(F.col("doc_id").alias("__row_id"), F.lit(0).alias("__row_hash"), "text")
    chosen = Counter()
    n = 0
    for r in fingerprints(keyed).collect():
        n += 1
        for x in r.reach:
            if x and x.lines == 3:
                chosen[r["__row_id"], r.pos - x.before] += 1
    runs = {(r[0], i) for r in rows if r[1] is not None for i in range(len(r[1].split("\n")) - 2)}
    assert set(chosen) == runs and set(chosen.values()) == {1} and n < 0.8 * sum(len((r[1] or "").split("\n")) for r in rows)


def test_mix_with_more_shards(docs):
    got = mix_sources(docs, shards=1, shard_rows=2).collect()
    by = {}
    for r in got:
        by.setdefault(r.source, [0, r.target])[0] += r.taken
    assert all(abs(taken - target) <= 2 for taken, target in by.values())


def test_seeds_that_are_not_broadcast(spark):
    cases, bench = leak_cases(spark)
    shuffled = contaminated(cases, bench, broadcast_seeds=0).collect()
    assert sorted(shuffled) == sorted(contaminated(cases, bench).collect()) and shuffled
    twice = contaminated(cases.union(cases), bench).collect()
    assert sorted(twice) == sorted(shuffled)


def test_very_long_text(spark):
    """Texts of several megabytes through every operator of Spark functions alone."""
    line = "many words stand on this line of a very long text "
    long = "\n".join(f"{line}{i}" for i in range(40_000))
    df = spark.createDataFrame([(1, long + "\n" + ITEM, "s"), (2, long, "s"), (3, "short", None)], "doc_id long, text string, source string")
    bench = spark.createDataFrame([(10, ITEM)], "item_id long, text string")
    assert [r.doc_id for r in contaminated(df, bench).collect()] == [1]
    got = {r.doc_id: r for r in dedup_lines(df).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[2].n_lines) == (0, 40_000, 40_000)
    assert sum(r.taken for r in mix_sources(df).collect()) > 0
    assert base_statistics(df).where("doc_id = 2").first().n_words == 12 * 40_000
    assert balanced_shards(df, 2).where("doc_id = 2").first().size == len(long) + 1
