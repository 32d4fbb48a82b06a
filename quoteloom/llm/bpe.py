"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is halved again and again down to leaves of ``LEAF`` characters, a few
matches of the split pattern long, and neighbours are joined on the way up.  A
span's value is the ids of its *settled* middle and its two open ends: the
middle begins and ends at borders at which the pattern always ends a match,
whatever lies around the span, so its tokens are final.  Joining two spans
encodes the window between the left one's last and the right one's first such
border, and only there; where a span has none, its whole text stays open and
the window grows with it up the tree until one is found on either side.  So no
character is encoded twice, however long a match is.  The empty span is the
unit and the join is associative; decoding concatenates byte strings up the
same kind of tree.

A border is certain between a character that is not white space and one that
is, and between an ASCII letter, digit or mark and one of another of these
three kinds, but for a letter behind an apostrophe.  No match holds both sides
of such a border, the pattern never looks back, and its one look ahead concerns
white space only, of which there is none in front of the border.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, small_batches

LEAF = 128
#: Ids decoded at once at a leaf of the decoding tree.
DECODE_LEAF = 8192
_BORDER = re.compile(r"(?<=\S)(?=[ \n])|(?<=[A-Za-z])(?=[0-9!-/:-@\[-`{-~])|(?<=[0-9])(?=[A-Za-z!-/:-@\[-`{-~])|(?<=[!-/:-@\[-`{-~])(?=[0-9])|(?<=[!-&(-/:-@\[-`{-~])(?=[A-Za-z])")


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """The tiktoken encoding of a rank file (one ``base64 rank`` pair a line), without special tokens."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@dataclass(slots=True)
class Span:
    """``text[low:high]``: settled from ``first`` to ``last`` with the ids of that part; without a border, ``first`` and ``last`` are None and all is open."""

    low: int
    high: int
    first: int | None = None
    last: int | None = None
    ids: list[int] = field(default_factory=list)


def leaf_span(enc, text: str, low: int, high: int) -> Span:
    """The span of a leaf: its first and last border inside it, and the ids between them."""
    found = _BORDER.search(text, low + 1, high)
    if found is None:
        return Span(low, high)
    first = last = found.start()
    tail = max(first, high - 32)
    for found in _BORDER.finditer(text, tail, high):
        last = found.start()
    if last == first:  # none in the tail
        for found in _BORDER.finditer(text, first, tail):
            last = found.start()
    return Span(low, high, first, last, enc.encode_ordinary(text[first:last]))


def join_spans(enc, text: str, left: Span, right: Span) -> Span:
    """The span of two neighbours; takes over the left one's list of ids."""
    if left.low == left.high or right.low == right.high:
        return right if left.low == left.high else left
    middle = left.high
    border = _BORDER.match(text, middle) is not None
    begin, end = left.last, right.first
    if begin is None and end is None:
        return Span(left.low, right.high, middle, middle) if border else Span(left.low, right.high)
    if begin is None:
        return Span(left.low, right.high, middle, right.last, enc.encode_ordinary(text[middle:end]) + right.ids) if border else Span(left.low, right.high, end, right.last, right.ids)
    ids = left.ids
    if end is None:
        if border:
            ids += enc.encode_ordinary(text[begin:middle])
        return Span(left.low, right.high, left.first, middle if border else begin, ids)
    ids += enc.encode_ordinary(text[begin:middle]) + enc.encode_ordinary(text[middle:end]) if border else enc.encode_ordinary(text[begin:end])
    ids += right.ids
    return Span(left.low, right.high, left.first, right.last, ids)


def reduce_tree(enc, text: str, low: int, high: int, leaf: int = LEAF) -> Span:
    """The span of ``text[low:high]`` by halves."""
    if high - low <= max(leaf, 1):
        return leaf_span(enc, text, low, high)
    middle = (low + high) // 2
    return join_spans(enc, text, reduce_tree(enc, text, low, middle, leaf), reduce_tree(enc, text, middle, high, leaf))


def encode_tree(enc, text: str, leaf: int = LEAF) -> list[int]:
    """Token ids of the whole text: the reduction's settled ids and, at last, its two open ends."""
    whole = reduce_tree(enc, text, 0, len(text), leaf)
    if whole.first is None:
        return enc.encode_ordinary(text)
    return enc.encode_ordinary(text[: whole.first]) + whole.ids + enc.encode_ordinary(text[whole.last :])


def decode_tree(enc, ids: list[int], leaf: int = DECODE_LEAF) -> bytes:
    if len(ids) <= leaf:
        return enc.decode_bytes(ids)
    middle = len(ids) // 2
    return decode_tree(enc, ids[:middle], leaf) + decode_tree(enc, ids[middle:], leaf)


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """``id, ids``: the token ids of every whole text.

    ``leaf`` is the length of the tree's leaves in characters.  Defined cases:
    null and empty texts give an empty list; repeated rows and null ids are
    encoded one by one; texts of one long match are encoded once, as a whole; other columns are ignored.
    """
    schema = f"id {df.schema[id_col].dataType.simpleString()}, ids array<int>"

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in batches:
            for part in small_batches(batch, "text"):
                ids = [encode_tree(enc, t or "", leaf=leaf) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    return arrow_map(_plain(df, id_col, text_col), schema, step)


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "id", ids_col: str = "ids", leaf: int = DECODE_LEAF) -> DataFrame:
    """``id, bytes``: the decoded bytes of every list of ids (null: empty)."""
    schema = f"id {df.schema[id_col].dataType.simpleString()}, bytes binary"

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in batches:
            out = [decode_tree(enc, ids or [], leaf) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], ["id", "bytes"])

    return arrow_map(df.selectExpr(f"`{id_col}` as id", f"`{ids_col}` as ids"), schema, step)


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256`` in one pass: encodes every text, decodes the ids, keeps digests only."""
    schema = f"id {df.schema[id_col].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        names = [str(i) for i in range(enc.n_vocab)]
        for batch in batches:
            for part in small_batches(batch, "text"):
                counts, digests, decoded = [], [], []
                for t in part.column("text").to_pylist():
                    ids = encode_tree(enc, t or "", leaf=leaf)
                    counts.append(len(ids))
                    digests.append(hashlib.sha256(" ".join([names[i] for i in ids]).encode()).hexdigest())
                    decoded.append(hashlib.sha256(decode_tree(enc, ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_map(_plain(df, id_col, text_col), schema, step)


def _plain(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.selectExpr(f"`{id_col}` as id", f"cast(`{text_col}` as string) as text")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.withColumnRenamed("id", "doc_id")
