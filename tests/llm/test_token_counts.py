import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from meshwright.llm.token_counts import Counter, count_tokens, in_batches

from .corpus import SCHEMA, frame, rows

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def lengths(name):
    path = public_tokenizers.path(name)
    if name.endswith(".json"):
        library = Tokenizer.from_file(path)
        return lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda t: len(library.encode(t or ""))


def odd_texts():
    rng = random.Random(5)
    parts = ["word", " ", "  ", "\n", "\t", "▁", "<s>", "</s>", "<|endoftext|>", "中文", "é", "á", "🙂", "\x1c", "\xa0", "'s", "12", "--", "　", "x", "\0"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 400))) for _ in range(60)]


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_counts_against_the_library(spark, name):
    count = lengths(name)
    data = rows(12) + [(1000 + k, t, None, None, 1, "", 1) for k, t in enumerate(odd_texts())]
    data += [(7, "one row twice " * 30, None, None, 1, "", 1)] * 2 + [(None, "no id " * 40, None, None, 1, "", 1), (None, None, None, None, 1, "", 1)]
    found = count_tokens(frame(spark, data), public_tokenizers.path(name), limit=100, segment=64).collect()
    key = lambda r: (str(r[0]), *r[1:])
    want = [(i, len((t or "").encode()), count(t), count(t) > 100) for i, t, *_ in data]
    assert sorted(map(tuple, found), key=key) == sorted(want, key=key)


def test_empty_table(spark):
    assert count_tokens(spark.createDataFrame([], SCHEMA), PIECES).count() == 0


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_segments_give_the_same_ids(name):
    with open(public_tokenizers.path(name), "rb") as f:
        code = Counter(f.read(), name.endswith(".json"))
    assert code.cuts
    for text in odd_texts() + ["plain words of a text " * 50]:
        parts = list(code.segments(text, 20))
        assert sum((code._ids(p) for p in parts), []) == code._ids(text)
    assert len(list(code.segments("plain words of a text " * 50, 20))) > 20
    assert list(code.segments("x" * 500, 20)) == ["x" * 500]


def test_batches_are_filled_by_size():
    calls = []

    def count(texts):
        calls.append(list(map(len, texts)))
        return [len(t) for t in texts]

    sizes = [3, 3, 3, 30, 1, 9, 2]
    assert list(in_batches(("x" * n for n in sizes), count, 10)) == sizes
    assert calls == [[3, 3, 3], [30], [1, 9], [2]]
