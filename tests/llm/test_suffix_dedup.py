import hashlib

import numpy as np
import pytest

from assay.llm import suffix_dedup
from assay.llm.suffix_dedup import remove_repeated_strings


def brute(texts, length):
    """doc index -> (n_bytes, n_removed, n_spans, sha256)."""
    data = [(t or "").encode() for t in texts]
    seen = {}
    for b in data:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def result(df):
    return sorted((r.doc_id is not None, r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


@pytest.mark.parametrize("length", [200, 400])
def test_equals_brute_force(docs, rows, length):
    expected = sorted((True, r[0], *x) for r, x in zip(rows, brute([r[1] for r in rows], length), strict=True))
    assert result(remove_repeated_strings(docs, length)) == expected
    assert any(x[3] for x in expected) and any(x[3] == 0 for x in expected)


def test_segments_of_long_texts(docs, rows, monkeypatch):
    # whole tasks see the smaller segment only where they fork from this process, so call the helpers
    monkeypatch.setattr(suffix_dedup, "_SEGMENT", 512)
    text = np.frombuffer(max((r[1] or "" for r in rows), key=len).encode(), np.uint8)
    starts = [x for a, x1, x2, *_ in suffix_dedup._anchors(text, 400) for lo, hi in zip(x1, x2, strict=True) for x in range(lo, hi + 1)]
    assert starts == list(range(len(text) - 399))


def test_odd_and_empty(odd, empty, spark):
    got = remove_repeated_strings(odd)
    data = [r.text for r in odd.select("text").collect()]
    assert sorted(r[2:] for r in result(got)) == sorted(brute(data, 400))
    assert remove_repeated_strings(empty).count() == 0
    periodic = spark.createDataFrame([(1, "a" * 3000), (2, "ab" * 700 + "c" * 399)], "doc_id long, text string")
    assert [r[1:] for r in result(remove_repeated_strings(periodic))] == [(i, *x) for i, x in zip((1, 2), brute(["a" * 3000, "ab" * 700 + "c" * 399], 400), strict=True)]


def test_short_length_is_refused(docs):
    with pytest.raises(ValueError):
        remove_repeated_strings(docs, 100)
