import random
import re

import numpy as np
import pytest

from meshwright.llm import ngram_join
from meshwright.llm.ngram_join import keep_one_of_each, product_links, similar_documents

from .corpus import SCHEMA, frame, rows


def shingles(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not w:
        return set()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def brute(data):
    sets = {r[0]: shingles(r[1]) for r in data}
    label = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    linked = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {i: (len(sets[i]), label[i]) for i in ids}


@pytest.mark.parametrize("seed", [3, 4])
def test_against_brute_force(spark, seed):
    data = rows(90, seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_documents(frame(spark, data)).collect()}
    assert got == brute(data)


def test_keeps_the_smallest_of_each_group(spark):
    data = rows()
    want = {i for i, (_, label) in brute(data).items() if i == label}
    assert {r.doc_id for r in keep_one_of_each(frame(spark, data)).collect()} == want


def test_empty_table(spark):
    assert similar_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{k}" for k in range(30))
    data = [(5, text, None, None, 1, "", 1), (5, text, None, None, 1, "", 1), (None, text, None, None, 1, "", 1)]
    assert sorted((r.n_shingles, r.component_id) for r in similar_documents(frame(spark, data)).collect()) == [(26, 5)] * 3


def test_decides_by_row_not_by_id(spark):
    text, other, third = (" ".join(f"{x}{k}" for k in range(30)) for x in "wvu")
    row = lambda i, t: (i, t, None, None, None if t is None else len(t), "", 1)
    data = [
        *[row(5, text)] * 3, row(None, text), row(7, text),  # one group: one row of 5 stays
        row(None, "a clean document without an id"), row(7, "a clean document that shares the id of a copy"),
        *[row(None, other)] * 2, row(9, third), row(9, third + " more"),  # two groups of equal ids
        row(None, None), row(None, ""), row(7, ""),
    ]
    left = [(r.doc_id, r.text) for r in keep_one_of_each(frame(spark, data)).collect()]
    assert len(left) == 8
    want = [(5, text), (None, data[5][1]), (7, data[6][1]), (None, other), (None, None), (None, ""), (7, "")]
    assert all(left.count(w) == 1 for w in want)
    assert sum(i == 9 for i, _ in left) == 1


def test_products_of_blocks_against_sets():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 40, 60)
    rows = [np.unique(np.where(rng.random(60) < k / 40, rng.integers(0, 1 << 40, 60), base)).astype(np.uint64)[: rng.integers(20, 61)] for k in range(24)]
    got = product_links(rows[:14], rows[10:], columns=16)
    for i, a in enumerate(rows[:14]):
        for j, b in enumerate(rows[10:]):
            n = len(np.intersect1d(a, b))
            assert got[i, j] == (n if 100 * n >= 80 * (len(a) + len(b) - n) else 0)


def test_many_rows_of_one_column(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PAIRED_ROWS", 3)
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 4)
    rng = random.Random(9)
    base, data = [f"b{k}" for k in range(80)], []
    for i in range(70):
        words = list(base)
        for _ in range(rng.randrange(1, 7)):
            words[rng.randrange(80)] = f"x{rng.randrange(10**6)}"
        data.append((i, " ".join(words), None, None, 1, "", 1))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_documents(frame(spark, data)).collect()}
    assert got == brute(data)
