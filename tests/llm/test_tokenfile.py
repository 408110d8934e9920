import io

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from meshwright.llm.tokenfile import ShardReader, ShardWriter, read_tokens, write_tokens
from meshwright.llm.tokens import END_ID

from .corpus import SCHEMA, frame, rows


class Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def written(monkeypatch, docs, frame_ids=50, most=70):
    monkeypatch.setattr("meshwright.llm.tokenfile.FRAME_IDS", frame_ids)
    monkeypatch.setattr("meshwright.llm.tokenfile.MOST_FRAME_IDS", most)
    sink = io.BytesIO()
    writer = ShardWriter(sink)
    for i, ids in docs:
        writer.add(i, np.array(ids, np.uint32))
    assert writer.close()[:2] == (len(docs), sum(len(x) for _, x in docs))
    return sink.getvalue()


def test_single_documents_and_their_frames(monkeypatch):
    rng = np.random.default_rng(1)
    docs = [(k, rng.integers(0, 70_000, n).tolist()) for k, n in enumerate([0, 5, 300, 1, 40, 20, 0, 69, 70, 71])]
    reader = ShardReader(Source(written(monkeypatch, docs)))
    read = []
    frame_of = reader.frame
    reader.frame = lambda k: read.append(k) or frame_of(k)
    for k in rng.permutation(len(docs)).tolist():
        assert next(reader.documents([k])).tolist() == docs[k][1]
    read.clear()
    next(reader.documents([4]))
    assert len(read) <= 2 < len(reader.table)


def test_damage_is_found(monkeypatch):
    data = bytearray(written(monkeypatch, [(1, list(range(60))), (2, list(range(60)))]))
    data[12] ^= 1
    reader = ShardReader(Source(bytes(data)))
    assert next(reader.documents([1])).tolist() == list(range(60))
    with pytest.raises(Exception):  # noqa: B017 - the frame's own checksum or the table's
        next(reader.documents([0]))


def test_round_trip(spark, tmp_path):
    data = rows(30) + [(3, "a repeated id", None, None, 1, "", 1), (None, None, None, None, 1, "", 1)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    manifest = write_tokens(frame(spark, data), f"file://{tmp_path}/tokens", path)
    found = read_tokens(manifest).collect()
    want = sorted((str(i), library.encode(t or "", add_special_tokens=False).ids + [END_ID]) for i, t, *_ in data)
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in found) == want
    at = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(found, key=lambda r: r.start) if r.doc_id is not None]
    assert ids == sorted(ids)
    assert read_tokens(write_tokens(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/none", path)).count() == 0
