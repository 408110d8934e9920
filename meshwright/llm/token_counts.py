"""Token counts: whole batches go to the library inside Arrow functions, and only lengths come back.

A task fills its batches by bytes, not by rows.  A text longer than a segment is cut at *safe boundaries*: a space
between two characters that are no white space, across which the tokenizer neither merges nor splits.  Segments are dealt
to all tasks by Spark's rebalancing, which goes by bytes, and their counts are added up; so a very long text
neither fills a worker nor holds up the others.  Short texts are counted where they are read, without a shuffle.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_rows

#: Bytes of text that go to the library in one call (a single segment may be longer, if it has no boundary).
BATCH_BYTES = 1 << 20
#: Texts of more bytes are cut; segments have about so many characters.
SEGMENT = 1 << 16
LIMIT = 4096

#: A space that no other white space touches: both kinds of library begin a new token at it.
_BOUNDARY = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")
_PROBES = ["word", "Words.", "a", "don't", "x7", "12", "(b)", "ñandú", "中文", "--", "\"q\"", "#!", "é"]
_made: dict[bytes, "Counter"] = {}


class Counter:
    """Counts tokens with the library of one tokenizer file; made once a worker.

    A ``.json`` file is read by tokenizers, any other by sentencepiece, each with its default handling of
    special strings inside texts.
    """

    def __init__(self, content: bytes, is_json: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if is_json:
            from tokenizers import Tokenizer

            library = Tokenizer.from_str(content.decode())
            library.no_truncation()
            library.no_padding()
            self.lengths: Callable[[list[str]], list[int]] = lambda texts: [len(x) for x in library.encode_batch_fast(texts, add_special_tokens=False)]
            self._ids = lambda text: library.encode(text, add_special_tokens=False).ids
        else:
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_proto=content)
            self.lengths = lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
            self._ids = pieces.encode
        # Whether the space of a boundary belongs to the next segment, or stands before every text anyhow.
        self.keeps_space = self._safe(True)
        self.cuts = self.keeps_space or self._safe(False)

    def _safe(self, keep: bool) -> bool:
        """Whether texts give the ids of their segments, one after the other."""
        space = " " if keep else ""
        return all(self._ids(f"{a} {b}") == self._ids(a) + self._ids(space + b) for a in _PROBES for b in _PROBES)

    def segments(self, text: str, size: int = SEGMENT) -> Iterator[str]:
        """``text`` in segments of about ``size`` characters, cut at safe boundaries alone."""
        at, n = 0, len(text)
        while self.cuts and n - at > size:
            found = _BOUNDARY.search(text, at + size)
            if not found:
                break
            yield text[at : found.start()]
            at = found.start() if self.keeps_space else found.end()
        yield text[at:]


def counter(content: bytes, is_json: bool) -> Counter:
    key = hashlib.sha256(content).digest()
    if key not in _made:
        _made.clear()
        _made[key] = Counter(content, is_json)
    return _made[key]


def in_batches(texts: Iterator[str], lengths: Callable[[list[str]], list[int]], most: int = BATCH_BYTES) -> Iterator[int]:
    """A length for every text, in order; calls take up to ``most`` characters."""
    held: list[str] = []
    size = 0
    for text in texts:
        if held and size + len(text) > most:
            yield from lengths(held)
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield from lengths(held)


def _counting(content: bytes, is_json: bool):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = counter(content, is_json).lengths
        for batch in batches:
            at = batch.schema.get_field_index("text")
            found = in_batches((x.as_py() for x in batch.column(at)), lengths)
            yield batch.set_column(at, "n_tokens", pa.array(list(found), pa.int64()))

    return count


def _cutting(content: bytes, is_json: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = counter(content, is_json)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                parts = list(code.segments(row.column("text")[0].as_py()))
                many = pa.array([0] * len(parts))
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": row.column("doc_id").take(many),
                        "n_bytes": row.column("n_bytes").take(many),
                        "sign": row.column("sign").take(many),
                        "part": pa.array(range(len(parts)), pa.int64()),
                        "text": pa.array(parts, pa.string()),
                    }
                )

    return cut


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, segment: int = SEGMENT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs`` (``doc_id, text``).

    A null text counts as empty, with no bytes and no tokens; a null doc_id stays null; repeated rows have a row each;
    an empty table gives an empty result; other columns aren't read. A text of any length is counted whole:
    beyond ``segment`` bytes in segments, of which the library sees some at a time. A text without a safe boundary, or for a tokenizer
    that fails the test for them, goes to the library in one piece. One row has to fit a worker's memory.
    """
    with open(tokenizer_path, "rb") as f:
        content = f.read()
    is_json = tokenizer_path.endswith(".json")
    rows = text_rows(docs).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    schema = "doc_id long, n_bytes long, n_tokens long"
    short = rows.filter(F.col("n_bytes") <= segment).mapInArrow(_counting(content, is_json), schema)
    long = rows.filter(F.col("n_bytes") > segment).withColumn("sign", F.sha2("text", 256))
    parts = long.mapInArrow(_cutting(content, is_json), "doc_id long, n_bytes long, sign string, part long, text string").hint("rebalance")
    counted = parts.mapInArrow(_counting(content, is_json), "doc_id long, n_bytes long, sign string, part long, n_tokens long")
    # Rows equal in id and text have equal segments: their sum is shared among as many rows as have a first segment.
    copies = F.sum((F.col("part") == 0).cast("long"))
    whole = counted.groupBy("doc_id", "n_bytes", "sign").agg(F.sum("n_tokens").alias("all"), copies.alias("copies"))
    whole = whole.select("doc_id", "n_bytes", F.expr("all div copies").alias("n_tokens"), F.explode(F.sequence(F.lit(1), F.col("copies"))))
    counts = short.unionByName(whole.select("doc_id", "n_bytes", "n_tokens"))
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)


def op11_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
