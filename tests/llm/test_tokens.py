"""Ids by pieces against the library's ids of whole texts."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from meshwright.llm import tokens

ODD = ["", " ", "\n\n", "Don't é café, X.ª µm İstanbul \n\n a  b\tc", "ΣΑΣ it's I'm", "a.b,c 12 34.5, Àß.", "e\u0301 \u00a0x", "<|endoftext|> y", "\0 z", "'s 'S"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_give_the_ids_of_whole_texts(name):
    rng = random.Random(5)
    letters = "abcdeéñóßÀÿAZ .,'\n-19µªİΣ中"
    texts = ODD + ["".join(rng.choices(letters, weights=[9 if x == " " else 5 if x.isalpha() else 1 for x in letters], k=rng.randrange(80))) for _ in range(2000)]
    code = tokens.PieceTokenizer(tokens.definition(public_tokenizers.path(name)))
    assert code.model is not None
    library = Tokenizer.from_file(public_tokenizers.path(name))
    want = [np.array(x.ids, np.uint32).tobytes() for x in library.encode_batch(texts, add_special_tokens=False)]
    assert list(code.encode(texts)) == want
    assert list(code.encode(texts)) == want  # now from what was seen
