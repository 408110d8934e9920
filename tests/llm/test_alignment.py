import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from meshwright.llm.alignment import align, pair_table

from .corpus import SCHEMA, frame, rows
from .test_token_counts import odd_texts

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def byte_of():
    """The byte-level alphabet, as published."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    table, n = {chr(b): b for b in shown}, 0
    for b in range(256):
        if b not in shown:
            table[chr(256 + n)] = b
            n += 1
    return table


def brute(texts):
    library, pieces, table = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_of()
    library.encode_special_tokens = True
    aligned, counts = [], Counter()
    for text in texts:
        a = b = []
        if text:
            a, b = library.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
        spell_a = [bytes(table[x] for x in library.id_to_token(k)) for k in a]
        spell_b = [bytes([int(pieces.id_to_piece(k)[3:5], 16)]) if pieces.is_byte(k) else pieces.id_to_piece(k).replace("▁", " ").encode() for k in b]
        if not text or not b"".join(spell_a) == b"".join(spell_b) == (" " + text).encode():
            aligned.append(None)
            continue
        spans = []
        for ids, spell in ((a, spell_a), (b, spell_b)):
            at, side = 0, []
            for k, s in zip(ids, spell, strict=True):
                side.append((at, at + len(s), k))
                at += len(s)
            spans.append(side)
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
        counts.update(links)
        cuts = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]})
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(k) for i, j, k in side if low <= i and j <= cut) for side in spans))
            low = cut
        aligned.append((len(a), len(b), groups, links))
    most = defaultdict(int)
    for (_, k), n in counts.items():
        most[k] = max(most[k], n)
    out = []
    for x in aligned:
        if x is None:
            out.append((0,) * 6 + ("",))
            continue
        n_a, n_b, groups, links = x
        best = sum(counts[k] == most[k[1]] for k in links)
        out.append((n_a, n_b, len(groups), len(links), best, sum(counts[k] for k in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out, counts, most


def data():
    texts = [t for _, t, *_ in rows(14) if not t or len(t) < 3000] + odd_texts()[:30]
    texts += ["plain words of a longer text, cut at spaces " * 20, "plain words and then ▁ a mark " * 20, "x" * 700, "<|endoftext|> and <s> are text", "same", "same"]
    out = [(k, t, "en", "s", 1, "sign", k) for k, t in enumerate(texts)]
    return out + [(None, "no id", None, None, 1, "", 1), (3, "an id twice", None, None, 1, "", 1), (None, None, None, None, 1, "", 1)]


def test_against_brute_force(spark):
    given = data()
    want, counts, most = brute([r[1] for r in given])
    key = lambda r: (str(r[0]), *r[1:])
    for block in (200, 1 << 20):
        found = align(frame(spark, given), A, B, block).collect()
        assert sorted([(r.doc_id, *(r[k] for k in FIELDS)) for r in found], key=key) == sorted([(r[0], *w) for r, w in zip(given, want, strict=True)], key=key)
    table = pair_table(frame(spark, given), A, B).collect()
    assert {(r.a, r.b): (r.links, r.best) for r in table} == {k: (n, n == most[k[1]]) for k, n in counts.items()}


def test_no_rows_and_no_tokens(spark):
    assert align(spark.createDataFrame([], SCHEMA), A, B).count() == 0
    found = align(frame(spark, [(1, None, None, None, 1, "", 1), (2, "", None, None, 1, "", 1)]), A, B).collect()
    assert {(r.doc_id, *(r[k] for k in FIELDS)) for r in found} == {(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")}
