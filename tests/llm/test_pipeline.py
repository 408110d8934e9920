"""The whole pipeline on a small corpus, each stage against what it may keep."""


import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from meshwright.llm.quality import judge
from meshwright.llm.secret_scan import all_spans, field

from .corpus import frame, rows
from .test_ngram_join import brute
from .test_others import base_counts


@pytest.fixture(scope="module")
def corpus():
    key = "db_password = 'Zx81!Spectrum48k', and "
    data = [(i, t if t is None or i % 4 else key + t, l, s, n, "", 1) for i, t, l, s, n, *_ in rows(80, 11)]
    return data + [(None, data[9][1], None, "a.org", 1, "", 1), (data[20][0], data[40][1], None, None, None, "", 1)]


def test_stages_end_to_end(spark, tmp_path, corpus):
    docs = frame(spark, corpus).drop("sign", "chunk_id")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "n-gram join", "secret scan", "mixing sources", "packing"]
    kept = stages["quality rules"](spark, docs, str(tmp_path))
    verdict = judge(docs).filter("kept").count()
    want = [r for r in corpus if not base_counts(r[1])[5]]
    left = [tuple(r) for r in kept.collect()]
    assert kept.columns == docs.columns and len(left) == verdict and {r[:5] for r in want} >= set(left)
    # One document of each group of near copies, told by row.
    numbered = [(k, r[1]) for k, r in enumerate(left)]
    groups = {label for _, label in brute([(k, t, None) for k, t in numbered]).values()}
    single = stages["n-gram join"](spark, kept, str(tmp_path))
    found = [tuple(r) for r in single.collect()]
    assert len(found) == len(groups) and set(found) <= set(left) and single.columns == docs.columns
    clean = stages["secret scan"](spark, single, str(tmp_path))
    texts = {r.text for r in clean.collect()}
    assert clean.count() == len(found) and not any("Spectrum48k" in t for t in texts)
    assert {t for _, t, *_ in found if not all_spans([t], field())[0]} <= texts
    mixed = stages["mixing sources"](spark, clean, str(tmp_path))
    assert sorted(r.position for r in mixed.collect()) == list(range(len(found)))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = sum(len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in clean.collect())
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(r.length for r in pieces) == ids
    ends: dict[int, int] = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096
