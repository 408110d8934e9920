import numpy as np
from pyspark.sql import functions as F

from meshwright.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(data, k, divisor):
    ints = []
    for i, x, _ in data:
        if i is not None and x is not None and all(v is not None and np.isfinite(v) for v in x):
            ints.append((i, [int(np.floor(256 * float(np.float32(v)))) for v in x]))
    out = []
    for q in sorted({i for i, _ in ints if i % divisor == 0}):
        asked = min(v for i, v in ints if i == q)
        scored = sorted((-sum(a * b for a, b in zip(asked, v, strict=True)), i) for i, v in ints if i != q and len(v) == len(asked))
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def found(spark, data, k=5, divisor=5):
    vectors = topk.quantised(spark.createDataFrame(data, SCHEMA).repartition(3))
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(vectors, vectors.filter(F.col("vec_id") % divisor == 0), k).collect())


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "GROUP_ROWS", 40)
    monkeypatch.setattr(topk, "QUERY_ROWS", 7)
    rng = np.random.default_rng(1)
    data = [(k, [float(x) for x in rng.normal(size=6).round(1)], 0) for k in range(150)]
    data += [(7, data[3][1], 0), (10, data[4][1], 0), (10, data[5][1], 0), (10**12, data[6][1], 0)]  # repeated and far ids, equal vectors
    data += [(None, data[0][1], 0), (200, None, 0), (205, [], 0), (210, [1.0, None] + [0.0] * 4, 0), (215, [float("nan")] * 6, 0), (220, [float("inf")] * 6, 0), (225, [1.0, 2.0], 0)]
    assert found(spark, data) == brute(data, 5, 5)


def test_few_and_no_vectors(spark):
    assert found(spark, [(0, [1.0], 0), (1, [2.0], 0)]) == [(0, 1, 1, 256 * 512)]
    assert found(spark, [(0, [1.0], 0)]) == [] == found(spark, [])


def test_scores_beyond_floats(spark):
    big = float(2**21)
    data = [(5, [1.0] * 4, 0), (1, [big, big, big, 1.0], 0), (10, [big] * 4, 0), (2, [big, big, big, 2.0], 0)]
    assert found(spark, data) == brute(data, 5, 5)


def test_near_rows_share_blocks_and_far_blocks_are_left_out():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(16, 8)) * 400
    rows = np.concatenate([rng.normal(size=(64, 8)) * 10 + c for c in centres]).astype(np.int64)
    mixed = rng.permutation(len(rows))
    rows = rows[mixed]
    blocks = [topk.Block(part, rows[part]) for part in topk.neighbours(rows.astype(float), np.arange(len(rows)))]
    assert sorted(np.concatenate([b.ids for b in blocks]).tolist()) == list(range(len(rows)))
    shares = []
    for q in range(0, len(rows), 50):
        scores, ids, scored = topk.search_blocks(blocks, rows[q], q, 5)
        s = rows @ rows[q]
        assert sorted(zip((-s).tolist(), range(len(s)), strict=True))[:6] == sorted([(-a, b) for a, b in zip(scores.tolist(), ids.tolist(), strict=True)] + [(-s[q], q)])[:6] or q not in np.argsort(-s)[:6]
        assert sorted(ids.tolist()) == sorted([i for i in np.lexsort((np.arange(len(s)), -s)).tolist() if i != q][:5])
        shares.append(scored / len(blocks))
    assert np.mean(shares) < 0.5
