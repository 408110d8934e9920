"""Secret scans: fixed patterns, and a linear-chain conditional random field for the rest.

Tokens are runs of characters other than blanks, quotes, brackets and separators.  The
field tags every token as begin, inside or outside of a secret from its shape, the words and
marks beside it and features of its file, and is decoded by Viterbi.  Features and scores of all tokens are
worked out together in arrays.  Where "outside" leads by more than any labels of the neighbours can
make up for, it is part of the best path, so a text splits there into short runs that are decoded one by
one - the result is that of decoding the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_rows

# Fixed patterns: kind, pattern, group that is tested, fewest characters of it.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]{16,}"), 0, 16),
)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = tuple(k for k, *_ in BASE)

SPANS = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Matches of the fixed patterns as (start, order of kind, end, kind), in that order."""
    found = []
    for k, (kind, pattern, group, fewest) in enumerate(BASE):
        # Cheap tests that no match can fail come first.
        if kind == "assign":
            if "=" not in text and ":" not in text:
                continue
            low = text.lower()
            if not any(w in low for w in ASSIGN_WORDS):
                continue
        elif kind == "access" and "AKIA" not in text:
            continue
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= fewest:
                found.append((m.start(), k, m.end(), kind))
    found.sort()
    return found


# ---------------------------------------------------------------- the field

DELIMITERS = b" \t\n\r\x0b\x0c\"'`<>(){}[],;:|="
#: Words that announce a secret.
KEYWORDS = re.compile(rb"key|secret|token|passw|passph|pwd|auth|bearer|credential|private|signature|cert")
OUT, BEGIN, INSIDE = 0, 1, 2
#: Text whose tokens are scored together.
SLICE_BYTES = 1 << 20
LENGTHS, SHARES = (4, 6, 8, 12, 16, 24, 40), (0.0, 0.2, 0.5, 0.999)


def _table(characters: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(characters)] = True
    return found


_DELIMITER, _LOWER, _UPPER, _DIGIT = (_table(x) for x in (DELIMITERS, bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789"))
_HEX, _CONSONANT, _SEPARATOR, _QUOTE, _STOP = (_table(x) for x in (b"0123456789abcdef", b"bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ", b"=:", b"\"'`", b".!?"))
_HIGH = np.arange(256) >= 128
_BEGINS = (np.arange(256) & 0xC0) != 0x80
_CLASS = np.where(_DIGIT, 1, np.where(_LOWER | _HIGH, 2, np.where(_UPPER, 3, 4))).astype(np.uint8)


class Tokens:
    """Tokens of some texts and their features, as arrays; places are in bytes."""

    def __init__(self, texts: list[bytes]) -> None:
        ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
        self.raw = raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        self.text_at = np.concatenate([[0], ends])
        n = len(raw)
        solid = ~_DELIMITER[raw]
        step = np.diff(np.concatenate([[0], solid.view(np.int8), [0]]))
        start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        for _ in range(3):  # a full stop at the end isn't part of a token
            end = end - ((end - start > 1) & _STOP[raw[end - 1]])
        self.start, self.end = start, end
        self.owner = np.searchsorted(ends, start, "right")

        def inside(flags: np.ndarray, a: np.ndarray = start, b: np.ndarray = end) -> np.ndarray:
            total = np.zeros(n + 1, np.int32)
            np.cumsum(flags, out=total[1:])
            return total[b] - total[a]

        def pairs(flags: np.ndarray) -> np.ndarray:
            """Neighbours inside the token for which ``flags`` (of the second one) hold."""
            return inside(flags, np.minimum(start + 1, end))

        kind = _CLASS[raw]
        change = np.zeros(n, bool)
        change[1:] = kind[1:] != kind[:-1]
        rise, fall = np.zeros(n, bool), np.zeros(n, bool)
        rise[1:] = _LOWER[raw[:-1]] & _UPPER[raw[1:]]
        fall[1:] = _UPPER[raw[:-1]] & _LOWER[raw[1:]]
        hard = np.cumsum(_CONSONANT[raw], dtype=np.int32)
        five = np.zeros(n, bool)
        five[5:] = hard[5:] - hard[:-5] == 5
        size = np.maximum(1, inside(_BEGINS[raw]))
        digits, lower, upper, high = (inside(t[raw]) for t in (_DIGIT, _LOWER, _UPPER, _HIGH))
        marks = size - digits - lower - upper
        hexes, changes, rises = inside(_HEX[raw]), pairs(change), pairs(rise)
        falls = pairs(fall)
        count = lambda c: inside(raw == ord(c))
        dots, slashes, ats = count("."), count("/"), count("@")
        low = raw.copy()
        low[_UPPER[raw]] += 32
        found = np.zeros(n, bool)
        found[[m.start() for m in KEYWORDS.finditer(low.tobytes())]] = True
        keyword = inside(found) > 0
        # What stands before: the words of the two tokens ahead and the marks of the gap.
        ahead = np.arange(len(start)) - 1
        same = np.zeros(len(start), bool)
        same[1:] = self.owner[1:] == self.owner[:-1]
        before = np.where(same, end[np.maximum(ahead, 0)] if len(end) else 0, start)
        split = same & (inside(_SEPARATOR[raw], before, start) > 0)
        after_key = same & keyword[np.maximum(ahead, 0)] if len(start) else same
        second = np.zeros(len(start), bool)
        second[2:] = keyword[:-2] & same[2:] & same[1:-1]
        quoted = (start > 0) & _QUOTE[raw[np.maximum(start - 1, 0)]] & _QUOTE[raw[np.minimum(end, n - 1)]]
        blank = same & (start - before <= 2) & ~split
        length = np.diff(self.text_at)
        code = inside(_table(b"{};=")[raw], self.text_at[:-1], self.text_at[1:]) * 100 > length
        share = digits / size
        mixed = (lower > 0) & (upper > 0)
        told = after_key & split
        random = (changes * 4 >= size) & (size >= 8)
        plain = digits + marks + upper == 0
        columns = [np.ones(len(start), bool)]
        columns += [np.searchsorted(LENGTHS, size, "right") == k for k in range(len(LENGTHS) + 1)]
        columns += [np.searchsorted(SHARES, share, "left") == k for k in range(len(SHARES) + 1)]
        columns += [
            hexes == size, mixed, mixed & (rises + falls > 2), upper + digits == size, plain, high > 0, ats > 0, dots >= 2, slashes >= 2, marks > 0,
            changes >= 2, changes >= 4, changes >= 8, random, inside(five) > 0, keyword, after_key, second, split, told, quoted, blank,
            told & (digits > 0), told & (size >= 8), told & plain, told & mixed, told & random, told & (marks > 0), told & (inside(five) > 0),
            (size >= 16) & random & mixed, (size >= 16) & (digits > 0) & mixed, (size >= 16) & (hexes == size), (size >= 20) & random,
            (share > 0) & (share < 1) & (lower + upper > 0), (length < 400)[self.owner], code[self.owner],
            split & (digits > 0) & (lower > 0), (rises > 0) & (digits == 0), (count("-") >= 2) & (digits == 0), (count("-") > 0) & (share > 0.5),
        ]
        self.x = np.stack(columns, 1).astype(np.float32)


class Field:
    """Weights of the field: label by feature, and label by next label."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray) -> None:
        self.weights, self.moves = weights.astype(np.float32), moves
        # The most that neighbours can add to a label compared with "outside".
        self.help = (moves - moves[:, [OUT]]).max(0) + (moves - moves[[OUT]]).max(1)

    def best_path(self, score: np.ndarray) -> list[int]:
        """Best labels of a run of tokens with outside on both sides (Viterbi)."""
        best = self.moves[OUT] + score[0]
        back = []
        for s in score[1:]:
            via = best[:, None] + self.moves
            back.append(via.argmax(0))
            best = via.max(0) + s
        best = best + self.moves[:, OUT]
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]

    def tags(self, tokens: Tokens) -> np.ndarray:
        """Label of every token."""
        score = tokens.x @ self.weights.T
        sure = ((score[:, [OUT]] - score > self.help) | (np.arange(3) == OUT)).all(1)
        tags = np.full(len(score), OUT, np.int8)
        unsure = np.flatnonzero(~sure)
        cut = np.flatnonzero((np.diff(unsure) > 1) | (tokens.owner[unsure[1:]] != tokens.owner[unsure[:-1]])) + 1
        for run in np.split(unsure, cut):
            if len(run):
                tags[run] = self.best_path(score[run])
        return tags

    def spans(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """Secrets of every text: begin with the inside tokens after it, in code points."""
        found: list[list[tuple[int, int]]] = []
        held: list[bytes] = []
        size = 0
        for text in texts:
            held.append(text.encode("utf-8", "replace"))
            size += len(held[-1])
            if size >= SLICE_BYTES:
                found += self._spans(held)
                held, size = [], 0
        return found + self._spans(held)

    def _spans(self, texts: list[bytes]) -> list[list[tuple[int, int]]]:
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        if not texts:
            return out
        tokens = Tokens(texts)
        tags = self.tags(tokens)
        last = -2
        for t in np.flatnonzero(tags != OUT).tolist():
            d, base = int(tokens.owner[t]), int(tokens.text_at[tokens.owner[t]])
            a, b = (int(_BEGINS[tokens.raw[base : base + int(e) - base]].sum()) for e in (tokens.start[t], tokens.end[t]))
            if tags[t] == INSIDE and last == t - 1 and out[d]:
                out[d][-1] = (out[d][-1][0], b)
            else:
                out[d].append((a, b))
            last = t
        return out


# ---------------------------------------------------------------- training


def _token(rng: np.random.Generator, alphabet: str, low: int, high: int) -> str:
    return "".join(rng.choice(list(alphabet), rng.integers(low, high)))


def _word(rng: np.random.Generator) -> str:
    return _token(rng, "etaoinshrdlu", 2, 9)


def _words(rng: np.random.Generator) -> str:
    """A long word, or words joined by hyphens."""
    return str(rng.choice(["", "-"])).join(_word(rng) for _ in range(int(rng.integers(2, 4))))


def example(rng: np.random.Generator) -> tuple[str, list[tuple[int, int]]]:
    """A made-up passage and its secrets: keys in several forms, or words and numbers that are none."""
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    pick = lambda *a: a[int(rng.integers(0, len(a)))]
    stop = lambda: pick("", "", "", ".", ",")
    words = lambda k: " ".join((_word(rng).title() if rng.random() < 0.15 else _word(rng)) + stop() for _ in range(k))
    name = pick("key", "api-key", "secret_key", "auth", "Authorization", "pwd", "db pwd", "credential", "private", "access_token", "client-secret", "passphrase", "PASSWORD")
    sep, quote = pick("=", ": ", " = ", ":", ": "), pick("", "", '"', "'")
    told = lambda secret: f"{name}{sep}{quote}{secret}{quote}"
    alone = lambda secret: secret if rng.random() < 0.5 else told(secret)
    secret = ""
    kind = int(rng.integers(0, 30))
    if kind == 0:
        body = told(secret := _token(rng, low + up + dig, 8, 48))
    elif kind == 1:
        body = told(secret := _token(rng, low[:6] + dig, 12, 64))
    elif kind == 2:
        body = alone(secret := pick("ghp_", "sk_live_", "xoxb-", "pk-") + _token(rng, low + up + dig, 20, 40))
    elif kind == 3:
        body = alone(secret := _token(rng, low + up + dig + "+/", 28, 64))
    elif kind == 4:
        secret = ".".join(_token(rng, low + up + dig + "_-", 20, 40) for _ in range(3))
        body = pick(f"Bearer {secret}", told(secret))
    elif kind == 5:
        secret = " ".join(_token(rng, low + up + dig + "+/", 12, 40) for _ in range(int(rng.integers(2, 4))))
        body = f"{pick('private key', 'secret', name)}: {secret}"
    elif kind == 6:
        body = told(secret := pick(_word(rng), _word(rng).title()) + _token(rng, dig, 2, 5))
    elif kind == 7:
        body = told(secret := _word(rng) + pick(*"!$#%&*") + _token(rng, low + up + dig, 3, 9) + pick(*"!$#%&*", ""))
    elif kind == 8:
        body = told(secret := _token(rng, low + up, 16, 40))
    elif kind == 9:
        body = told(secret := _token(rng, "bcdfghjklmnpqrstvwxz" + low, 14, 40))
    elif kind == 10:
        body = _token(rng, dig, 1, 20)
    elif kind == 11:
        body = ".".join(_token(rng, dig, 1, 4) for _ in range(4)) + pick("", ":8080", "/24")
    elif kind == 12:
        body = f"+{rng.integers(1, 99)} ({_token(rng, dig, 3, 4)}) {_token(rng, dig, 3, 4)}-{_token(rng, dig, 4, 5)} {_token(rng, dig, 3, 4)}-{_token(rng, dig, 6, 9)}"
    elif kind == 13:
        body = f"{_word(rng)}.{_word(rng)}{rng.integers(1, 999)}@{_word(rng)}{pick('', rng.integers(1, 9))}.{_word(rng)}.com"
    elif kind == 14:
        body = f"https://www.{_word(rng)}.com/{_word(rng)}-{_word(rng)}/{rng.integers(1000, 9999)}?page={rng.integers(1, 99)}"
    elif kind == 15:
        body = f"{rng.integers(1990, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 28)}T{rng.integers(10, 23)}-{rng.integers(10, 59)} {_word(rng)}{_word(rng)}{rng.integers(1, 99)}"
    elif kind == 16:
        body = f"{_word(rng)}_{_word(rng)}_{rng.integers(1, 9)} {_word(rng)}{rng.integers(100, 999)}{_word(rng)}.txt version-{rng.integers(1, 9)}.{rng.integers(1, 99)}.0"
    elif kind == 17:
        body = f"{name}{pick(' ', ' of the ', ': the ', ', ', sep)}{_words(rng)} {_words(rng)}"
    elif kind == 18:
        body = f"{_word(rng)}{''.join(_word(rng).title() for _ in range(int(rng.integers(1, 5))))} {_word(rng).title()}{_word(rng).title()}.{_word(rng)}{_word(rng).title()}"
    elif kind == 19:
        body = f"{name}{sep}{quote}{_word(rng)}{''.join(_word(rng).title() for _ in range(int(rng.integers(1, 4))))}{quote} {_words(rng)}"
    elif kind == 20:
        body = f"id: {_token(rng, dig, 6, 12)} {pick('***', '%%%', '###', '!!')}{_word(rng)}{rng.integers(10, 99)}{_word(rng)}"
    elif kind == 21:
        body = f"{_word(rng)}{sep}{quote}{pick(_word(rng), _token(rng, dig, 2, 6), _word(rng) + _token(rng, dig, 1, 3))}{quote}"
    elif kind == 22:
        body = " ".join(w.upper() + pick("!!", "", "!") for w in words(4).split())
    elif kind == 23:
        body = f"{name}{pick(' ', ', ', ': ')}{words(2)} {rng.integers(1, 9999)}"
    elif kind == 24:
        body = " ".join(_token(rng, "aeiouéèñßüçóêlrstnd", 2, 18) for _ in range(5))
    elif kind == 25:
        body = f"{_word(rng)}:{_word(rng)} | {_word(rng)} | {_words(rng)}: {rng.integers(1, 99)}%"
    else:
        body = words(12)
    text = " ".join(x for x in (words(rng.integers(0, 8)), body + (stop() if not secret else ""), words(rng.integers(0, 8))) if x)
    spans = []
    if secret:
        at = text.index(secret)
        spans = [(at, at + len(secret))]
    return text, spans


def labelled(examples: list[tuple[str, list[tuple[int, int]]]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features and labels of the tokens of each passage."""
    tokens = Tokens([t.encode() for t, _ in examples])
    y = np.zeros(len(tokens.start), int)
    for d, (text, spans) in enumerate(examples):
        base = tokens.text_at[d]
        for a, b in spans:
            a, b = (base + len(text[:k].encode()) for k in (a, b))
            mine = np.flatnonzero((tokens.start < b) & (tokens.end > a))
            y[mine], y[mine[:1]] = INSIDE, BEGIN
    cuts = np.searchsorted(tokens.owner, np.arange(1, len(examples)))
    return [(x, z) for x, z in zip(np.split(tokens.x, cuts), np.split(y, cuts), strict=True) if len(z)]


def fit(examples: int = 2000, steps: int = 120, seed: int = 7, decay: float = 1e-3) -> Field:
    """Maximum likelihood on ``examples`` made-up passages, by gradient ascent over all of them at once."""
    rng = np.random.default_rng(seed)
    runs = labelled([example(rng) for _ in range(examples)])
    width, n_features = max(len(y) for _, y in runs), runs[0][0].shape[1]
    x = np.zeros((len(runs), width, n_features), np.float32)
    y = np.zeros((len(runs), width), int)
    live = np.zeros((len(runs), width), bool)
    for k, (a, b) in enumerate(runs):
        x[k, : len(b)], y[k, : len(b)], live[k, : len(b)] = a, b, True
    last = live.sum(1) - 1
    rows = np.arange(len(runs))
    w, t = np.zeros((3, n_features)), np.zeros((3, 3))
    gw, gt = np.full_like(w, 1e-6), np.full_like(t, 1e-6)

    def lse(a: np.ndarray, axis: int) -> np.ndarray:
        top = a.max(axis, keepdims=True)
        return (top + np.log(np.exp(a - top).sum(axis, keepdims=True))).squeeze(axis)

    hot = np.eye(3)[y] * live[:, :, None]
    flat = x.reshape(-1, n_features)
    seen_w = hot.reshape(-1, 3).T @ flat
    seen_t = np.einsum("nla,nlb->ab", hot[:, :-1], hot[:, 1:])
    seen_t[OUT] += hot[:, 0].sum(0)
    seen_t[:, OUT] += hot[rows, last].sum(0)
    for _ in range(steps):
        s = (x @ w.T.astype(np.float32)).astype(float)
        f, b = np.zeros_like(s), np.zeros_like(s)
        f[:, 0] = t[OUT] + s[:, 0]
        for l in range(1, width):
            f[:, l] = lse(f[:, l - 1, :, None] + t[None], 1) + s[:, l]
        for l in range(width - 1, -1, -1):
            onward = lse(t[None] + (b[:, l + 1] + s[:, l + 1])[:, None, :], 2) if l + 1 < width else np.zeros_like(b[:, l])
            b[:, l] = np.where((last == l)[:, None], t[:, OUT], onward)
        z = lse(f[rows, last] + t[:, OUT], 1)
        p = np.exp(f + b - z[:, None, None]) * live[:, :, None]
        q = np.exp(f[:, :-1, :, None] + t + (s + b)[:, 1:, None, :] - z[:, None, None, None]) * live[:, 1:, None, None]
        want_t = q.sum((0, 1))
        want_t[OUT] += p[:, 0].sum(0)
        want_t[:, OUT] += p[rows, last].sum(0)
        dw = (seen_w - p.reshape(-1, 3).T.astype(np.float32) @ flat) / len(runs) - decay * w
        dt = (seen_t - want_t) / len(runs) - decay * t
        gw, gt = gw + dw**2, gt + dt**2
        w, t = w + 0.5 * dw / np.sqrt(gw), t + 0.5 * dt / np.sqrt(gt)
    return Field(w, t)


@lru_cache(maxsize=1)
def field() -> Field:
    """The model, fitted once per driver."""
    return fit()


# ---------------------------------------------------------------- the operator


def all_spans(texts: list[str], model: Field) -> list[list[tuple[int, int, int, str]]]:
    """For each text base spans, and those of the field that don't lie wholly inside one, by start and kind; they may overlap."""
    out = []
    for text, spans in zip(texts, model.spans(texts), strict=True):
        base = base_spans(text)
        more = [(a, len(KINDS), b, "field") for a, b in spans if not any(s <= a and b <= e for s, _, e, _ in base)]
        out.append(sorted(base + more))
    return out


def scan(docs: DataFrame, model: Field | None = None) -> DataFrame:
    """``doc_id, spans`` for every row: kind, start and end (code points, end exclusive).

    A null or empty text has no spans; repeated rows are scanned each; other columns are not read. A text is
    scanned whole, whatever its length, which takes some 60 bytes of memory a byte of it.
    """
    model = model or field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            spans = [
                [{"kind": k, "start": a, "end": b} for a, _, b, k in found]
                for found in all_spans(batch.column("text").to_pylist(), model)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    return text_rows(docs).mapInArrow(run, SPANS)


def redact(docs: DataFrame, model: Field | None = None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark`` and n_chars, where there is one, counted anew.

    Overlapping spans make one. Null texts stay null; all other columns are unchanged.
    """
    model = model or field()
    schema = docs.schema

    def clean(text: str | None, spans: list) -> str | None:
        parts, at = [], 0
        for a, _, b, _ in spans:
            if a >= at:
                parts += [text[at:a], mark]
            at = max(at, b)
        return "".join([*parts, text[at:]]) if parts else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column("text").to_pylist()
            new = [clean(t, found) for t, found in zip(old, all_spans([t or "" for t in old], model), strict=True)]
            at = batch.schema.get_field_index("text")
            batch = batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))
            at = batch.schema.get_field_index("n_chars")
            if at >= 0:
                counts = batch.column("n_chars").to_pylist()
                counts = [n if o == t else len(t) for n, o, t in zip(counts, old, new, strict=True)]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(counts, batch.schema.field(at).type))
            yield batch

    return docs.mapInArrow(run, schema)


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    told = lambda s: F.concat_ws(",", F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))
    base = F.filter("spans", lambda x: x["kind"].isin(*KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(told(base), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
    )
