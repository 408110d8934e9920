"""Token ids by a given tokenizer, each distinct piece of text encoded once per task.

A tokenizer that never merges across the start of a run of blanks gives a text the same
ids as its pieces one after the other.  Both public vocabularies used here have that
property for pieces cut before a space or line feed, so a piece's ids are looked up and
only unseen pieces go to the library: pieces of letters straight to its model, others as texts.  Texts to which the argument doesn't apply (other
white space, spellings of special tokens) are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np

#: Ends every document.
END_ID = 2
#: Pieces that one worker remembers; beyond that only those still in use are carried over.
CACHE_PIECES = 400_000
#: Holds pieces apart in one call of the library; texts that hold it are encoded whole.
MARK = "\0"
#: Text whose unseen pieces go to the library together.
BATCH_CHARS = 1 << 20

_KEEP_SPACE = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_ODD_SPACE = re.compile(r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
#: Letters that no normal form changes and that turn to lower case one by one, after a space or not.
_PLAIN = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
_PROBES = ["word", "Words", "A", "don", "tHe", "Straße", "ÀÖØöøÿ", "cioónñé", "internationalisation"]
#: Byte-level vocabularies write a byte as itself if it is printable, else as the next character from 256 on.
_UNPRINTED = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
_BYTE_SYMBOLS = {b: 256 + k for k, b in enumerate(_UNPRINTED)}
_made: dict[bytes, "PieceTokenizer"] = {}


class PieceTokenizer:
    """Encodes texts to little-endian unsigned 32-bit ids, as bytes."""

    def __init__(self, definition: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        # A tokenizer that drops white space sees no difference between pieces with and without it.
        self.drops_space = not self._ids([" \n"])[0]
        # Unseen pieces go to the library as one text, held apart by a character that no merge holds.
        mark = self.library.encode(MARK, add_special_tokens=False)
        own = {x[0] for x in mark.tokens}
        self.mark = mark.ids[0] if len(mark.ids) == 1 and sum(x[0] in own or x[-1] in own for x in self.library.get_vocab()) <= 2 else None
        self.lowers = self._ids(["A"]) == self._ids(["a"])
        self.seen: dict[str, bytes] = {}
        self.model = self.library.model if self._model_takes_words(definition) else None
        self.older: dict[str, bytes] = {}

    def _model_takes_words(self, definition: str) -> bool:
        """Whether a piece of letters is one word of byte symbols to the model, without the steps before it."""
        spec = json.loads(definition)
        before = spec.get("pre_tokenizer") or {}
        kinds = {x.get("type") for x in [before, *before.get("pretokenizers", [])]}
        if spec["model"].get("type") != "BPE" or "ByteLevel" not in kinds or not all(x["content"].startswith("<|") for x in spec.get("added_tokens", [])):
            return False
        self.model = self.library.model
        probes = [*_PROBES, *([] if self.drops_space else [f" {p}" for p in _PROBES])]
        return not self._plain_words(probes) and [self.seen[p] for p in probes] == self._ids(probes)

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, np.uint32).tobytes() for x in found]

    def _pieces(self, text: str) -> list[str] | None:
        if "<|" in text or MARK in text:
            return None
        if self.drops_space:
            return text.replace("\n", " ").split(" ")
        return None if _ODD_SPACE.search(text) else _KEEP_SPACE.findall(text)

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of every text, without the end id, in order."""
        held: list[tuple[str, list[str] | None]] = []
        size = 0
        for text in texts:
            held.append((text, self._pieces(text)))
            size += len(text)
            if size >= BATCH_CHARS:
                yield from self._encoded(held)
                held, size = [], 0
        yield from self._encoded(held)

    def _plain_words(self, pieces: list[str]) -> list[str]:
        """Learn pieces of letters alone, which are one word to the model; returns the other pieces."""
        tokens, seen, others = self.model.tokenize, self.seen, []
        for p in pieces:
            if not _PLAIN.fullmatch(p) or (self.drops_space and p[0] == " "):
                others.append(p)
                continue
            word = p.lower() if self.lowers else p
            if not word.isascii() or word[0] == " ":
                word = word.encode().decode("latin-1").translate(_BYTE_SYMBOLS)
            seen[p] = array("I", [x.id for x in tokens(word)]).tobytes()
        return others

    def _learn(self, pieces: list[str]) -> None:
        if self.model is not None:
            pieces = self._plain_words(pieces)
        if self.mark is None:
            self.seen.update(zip(pieces, self._ids(pieces), strict=True))
            return
        # Blanks at a text's end are one token there, and an apostrophe may begin a contraction.
        alone = [p for p in pieces if not p or p[0] == "'" or p.isspace()]
        self.seen.update(zip(alone, self._ids(alone), strict=True))
        joined = [p for p in pieces if p and p[0] != "'" and not p.isspace()]
        for a in range(0, len(joined), 4096):
            part = joined[a : a + 4096]
            glue = f" {MARK} " if self.drops_space else MARK
            ids = np.array(self.library.encode_batch_fast([glue.join(part)], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(ids == self.mark)
            raw, ends = ids.tobytes(), [*(4 * cuts).tolist(), 4 * len(ids)]
            starts = [0, *(4 * cuts + 4).tolist()]
            for p, i, j in zip(part, starts, ends, strict=True):
                self.seen[p] = raw[i:j]

    def _encoded(self, held: list[tuple[str, list[str] | None]]) -> Iterator[bytes]:
        if len(self.seen) > CACHE_PIECES:
            self.seen, self.older = {}, self.seen
        seen, older = self.seen, self.older
        found: list[list[bytes | None]] = []
        gaps: list[list[int]] = []
        new: set[str] = set()
        for _, pieces in held:
            ids = list(map(seen.get, pieces or ()))
            unseen = [k for k, x in enumerate(ids) if x is None]
            new.update([pieces[k] for k in unseen])
            found.append(ids)
            gaps.append(unseen)
        fresh, ended = set(), []
        for p in new:
            if p in older:
                seen[p] = older[p]
            elif len(p) > 2 and p[-1] in ".," and p[-2].lower().isalpha():
                # A full stop or comma after a letter (that stays one in lower case) always starts a token of its own.
                ended.append(p)
            else:
                fresh.add(p)
        for p in ended:
            for q in (p[:-1], p[-1]):
                if q not in seen:
                    if q in older:
                        seen[q] = older[q]
                    else:
                        fresh.add(q)
        if fresh:
            self._learn(list(fresh))
        for p in ended:
            seen[p] = seen[p[:-1]] + seen[p[-1]]
        for (text, pieces), ids, unseen in zip(held, found, gaps, strict=True):
            if pieces is None:
                yield self._ids([text])[0]
                continue
            for k in unseen:
                ids[k] = seen[pieces[k]]
            yield b"".join(ids)


def tokenizer(definition: str) -> PieceTokenizer:
    """The worker's tokenizer for this definition; made once per worker."""
    key = hashlib.sha256(definition.encode()).digest()
    if key not in _made:
        _made.clear()
        _made[key] = PieceTokenizer(definition)
    return _made[key]


def definition(path: str) -> str:
    """A tokenizer file's content, read on the driver and sent to the tasks (a few MB by its vocabulary)."""
    with open(path, encoding="utf-8") as f:
        return f.read()
