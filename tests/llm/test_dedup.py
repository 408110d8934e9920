import hashlib
import random
import re

import pytest

from meshwright.llm.block_dedup import dedup_windows
from meshwright.llm.suffix_dedup import dedup_bytes, merge_runs

from .corpus import SCHEMA, frame, rows


def removed(items, width):
    """Positions covered by a window that starts in a document with a smaller id too."""
    first = {}
    for i in sorted(items):
        for k in range(len(items[i]) - width + 1):
            first.setdefault(tuple(items[i][k : k + width]), i)
    out = {}
    for i, seq in items.items():
        gone = [False] * len(seq)
        for k in range(len(seq) - width + 1):
            if first[tuple(seq[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        out[i] = gone
    return out


def test_windows_against_brute_force(spark):
    data = rows()
    words = {r[0]: re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in data}
    gone = removed(words, 50)
    want = {i: (len(w), sum(gone[i]), " ".join(x for x, g in zip(w, gone[i], strict=True) if not g)) for i, w in words.items()}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in dedup_windows(frame(spark, data)).collect()}
    assert got == want


def test_bytes_against_brute_force(spark):
    data = [(*r[:1], (r[1] or "")[:1500] if r[1] is not None else None, *r[2:]) for r in rows(36)]
    raw = {r[0]: (r[1] or "").encode() for r in data}
    gone = removed(raw, 50)
    want = {}
    for i, b in raw.items():
        g = gone[i]
        spans = sum(x and not (k and g[k - 1]) for k, x in enumerate(g))
        want[i] = (len(b), sum(g), spans, hashlib.sha256(bytes(x for x, y in zip(b, g, strict=True) if not y)).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in dedup_bytes(frame(spark, data)).collect()}
    assert got == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert dedup_windows(none).count() == 0
    assert dedup_bytes(none).count() == 0


def expected_bytes(data, width=50):
    """Brute force where ids repeat or are missing: a null id is larger than all others."""
    rank = lambda i: float("inf") if i is None else i
    first = {}
    for i, t in data:
        raw = (t or "").encode()
        for k in range(len(raw) - width + 1):
            s = raw[k : k + width]
            first[s] = min(first.get(s, float("inf")), rank(i))
    out = []
    for i, t in data:
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for k in range(len(raw) - width + 1):
            if first[raw[k : k + width]] < rank(i):
                gone[k : k + width] = [True] * width
        out.append((i, sum(gone), bytes(x for x, g in zip(raw, gone, strict=True) if not g)))
    return sorted(out, key=str)


def expected_words(data, width=50):
    rank = lambda i: float("inf") if i is None else i
    first, split = {}, [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in data]
    for i, w in split:
        for k in range(len(w) - width + 1):
            s = tuple(w[k : k + width])
            first[s] = min(first.get(s, float("inf")), rank(i))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < rank(i):
                gone[k : k + width] = [True] * width
        out.append((i, sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=str)


def awkward(seed):
    """Null and repeated ids, repeated rows, runs of one symbol, parts cut at any place."""
    rng = random.Random(seed)
    long = "".join(rng.choice("ab ") for _ in range(1500)) + "x" * 120 + " né\0 " * 30
    lines = " ".join(rng.choice("ab") for _ in range(400)) + " z" * 130
    data = [(None, long[:700]), (None, long[:700]), (3, None), (3, ""), (4, "é" * 24 + "a"), (5, "é" * 25), (6, "é" * 25)]
    for _ in range(40):
        source = rng.choice([long, lines])
        a = rng.randrange(len(source))
        b = rng.randrange(a, min(len(source), a + 500))
        data.append((rng.choice([None, *range(12)]), rng.choice(["", "q "]) + source[a:b] + rng.choice(["", " end", source[:80]])))
    return data


@pytest.mark.parametrize("seed", [1, 2])
def test_awkward_rows_against_brute_force(spark, seed):
    data = awkward(seed)
    docs = frame(spark, [(i, t, None, None, None, "", 1) for i, t in data])
    assert sorted(((r.doc_id, r.n_removed, bytes(r.kept)) for r in dedup_bytes(docs).collect()), key=str) == expected_bytes(data)
    assert sorted(((r.doc_id, r.n_removed, r.kept_text) for r in dedup_windows(docs).collect()), key=str) == expected_words(data)


def test_merge_keeps_order_and_shared_prefixes():
    rng = random.Random(5)
    runs, every = [], []
    for k in range(7):
        keys = sorted({bytes(rng.choice(b"\0ab\xf4") for _ in range(6)) for _ in range(rng.choice([0, 1, 60]))})
        shared = bytes(0 if j == 0 else next(n for n in range(6) if keys[j][n] != keys[j - 1][n]) for j in range(len(keys)))
        runs.append((shared, b"".join(x[n:] for x, n in zip(keys, shared, strict=True))))
        every += [(x, k) for x in keys]
    from_run, lcp, merged = merge_runs(runs, 6)
    assert merged == sorted(x for x, _ in every) and sorted(zip(merged, from_run, strict=True)) == sorted(every)
    for a, b, n in zip(merged, merged[1:], lcp[1:], strict=False):
        assert a[:n] == b[:n] and (n == 6 or a[n] != b[n])
