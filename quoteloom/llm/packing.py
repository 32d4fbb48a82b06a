"""Order-preserving packing by dynamic programming.

Documents are read in the table's order, tokenised, and laid end to end; the
token stream is then cut into windows of at most ``WINDOW`` tokens.  Cuts fall
at the end of a document or behind a sentence.  Only in a stretch of more than
``WINDOW`` tokens without such a place may one fall elsewhere, at every
``STRIDE`` tokens of the stretch.  With ``f(j)`` the least cost of cutting the
stream up to cut point ``j``,

    f(j) = penalty(j) + SEQUENCE + min over i of f(i) + padding(j - i)

where the padding of a window of length n is 0 at a power of two and
``WINDOW - n`` otherwise.  The second kind turns into ``f(i) + place(i)``, whose
minimum over the sliding range of reachable ``i`` a monotone queue gives in
constant time; windows at a power of two are a handful of direct look-ups.

Every scan partition is packed by itself, as a stream: whenever ``BLOCK``
tokens have come together they are cut, all windows but the last two are
given out, and the rest goes on to the next block.  So memory is bounded, no
text is shuffled, a lost task gives the same windows again, and each partition
has one last, possibly short, window.  A document longer than a block enters it
in slices.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, small_batches

WINDOW = 1024
STRIDE = 32
BLOCK = 1 << 18
END_ID = 0

# Costs in tokens: of a window, of a cut behind a sentence, of a cut elsewhere.
SEQUENCE, SENTENCE, INSIDE = 64, 1, 8

SCHEMA_TAIL = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids array<int>"


# Fixed value: how a byte-level pre-tokenizer divides a text.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _is_plain(spec: dict) -> bool:
    """Whether a ``tokenizer.json`` is byte-level BPE with nothing around it, and its added tokens are plain strings."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    odd = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")]
    byte_level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    tokens_plain = not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", []))
    merged = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model["merges"]]
    ranked = all(a < b for a, b in zip([-1, *merged], merged, strict=False))  # ids in merge order serve as ranks
    return model["type"] == "BPE" and byte_level and not any(odd) and spec.get("normalizer") is None and tokens_plain and ranked


class Encoder:
    """Token ids as ``tokenizers`` gives them for a ``tokenizer.json``, without the special tokens a template would add.

    Added tokens that stand in a text are found there, as by default.  A plain
    byte-level vocabulary is run on tiktoken's engine, which gives the same ids
    in a third of the time; any other file is run by ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        # byte-level vocabularies write each byte as a printable character: the printable ones as themselves, the others as U+0100 and on in byte order
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
        vocab = spec["model"]["vocab"]
        if _is_plain(spec):
            import tiktoken

            ranks = {bytes(back[c] for c in token): i for token, i in vocab.items() if token not in added}
            engine = tiktoken.Encoding("bytes", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=added)
            self.encode = lambda text: engine.encode(text, allowed_special="all", disallowed_special=())
            self.tokens = {i: token for token, i in ranks.items()}
        else:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(path)
            self.encode = lambda text: whole.encode(text, add_special_tokens=False).ids
            self.tokens = {i: whole.decode([i], skip_special_tokens=False).encode() for i in range(whole.get_vocab_size())}
        # what says that a sentence may end behind a token: a line break or full-width stop at its end, or a stop followed by white space
        self.ends, self.stops, self.blank = (np.zeros(max([*self.tokens, *added.values(), END_ID]) + 1, bool) for _ in range(3))
        for i, token in self.tokens.items():
            self.ends[i] = re.search(rb"(\n|\xe3\x80\x82|\xef\xbc[\x81\x9f])$", token) is not None
            self.stops[i] = re.search(rb"[.!?][\"')\]]*$", token) is not None
            self.blank[i] = token[:1].isspace()

    def sentence_ends(self, ids: np.ndarray) -> np.ndarray:
        """Places in a stream of ids behind which a sentence may have ended."""
        out = self.ends[ids]
        out[:-1] |= self.stops[ids[:-1]] & self.blank[ids[1:]]
        return np.flatnonzero(out) + 1


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def candidates(size: int, doc_ends: np.ndarray, sentence_ends: np.ndarray, window: int = WINDOW, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Cut points of a stream of ``size`` tokens (places 0 to ``size``) and their penalties."""
    penalty = np.full(size + 1, INSIDE, np.int64)
    chosen = np.zeros(size + 1, bool)
    penalty[sentence_ends] = SENTENCE
    chosen[sentence_ends] = True
    penalty[doc_ends] = 0
    chosen[doc_ends] = True
    penalty[0] = 0
    chosen[[0, size]] = True
    at = np.flatnonzero(chosen)
    for i in np.flatnonzero(np.diff(at) > window).tolist():
        chosen[at[i] + stride : at[i + 1] : stride] = True
    at = np.flatnonzero(chosen)
    return at, penalty[at]


def best_cuts(at: np.ndarray, penalty: np.ndarray, window: int = WINDOW) -> list[int]:
    """The cheapest sequence of cut points from the first to the last; neighbours are at most ``window`` apart."""
    n = len(at)
    places, costs = at.tolist(), penalty.tolist()
    exact: dict[int, list[int]] = {}
    k = 1
    while k <= window:
        found = np.searchsorted(at, at - k)
        hit = at[np.minimum(found, n - 1)] == at - k
        for j in np.flatnonzero(hit).tolist():
            exact.setdefault(j, []).append(int(found[j]))
        k *= 2
    f = [0] * n
    came = [0] * n
    line: deque[tuple[int, int]] = deque([(places[0], 0)])  # (f(i) + place(i), i), both rising
    for j in range(1, n):
        place = places[j]
        least = place - window
        while places[line[0][1]] < least:
            line.popleft()
        best, source = line[0][0] + window - place, line[0][1]
        for i in exact.get(j, ()):
            if f[i] <= best:
                best, source = f[i], i
        f[j] = value = best + SEQUENCE + costs[j]
        came[j] = source
        value += place
        while line and line[-1][0] >= value:
            line.pop()
        line.append((value, j))
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(came[cuts[-1]])
    return [places[i] for i in reversed(cuts)]


class Packer:
    """Cuts a growing stream of documents and gives out the pieces of finished windows."""

    def __init__(self, enc: Encoder, first_sequence: int, window: int = WINDOW, block: int = BLOCK):
        self.enc, self.window, self.block, self.sequence = enc, window, block, first_sequence
        self.parts: list[tuple[object, int, int, np.ndarray]] = []  # id, tokens of the document, place in it, ids
        self.size = 0

    def add(self, doc_id: object, ids: np.ndarray) -> Iterator[tuple]:
        for begin in range(0, len(ids), self.block):
            piece = ids[begin : begin + self.block]
            self.parts.append((doc_id, len(ids), begin, piece))
            self.size += len(piece)
            if self.size >= self.block:
                yield from self.flush(last=False)

    def flush(self, last: bool = True) -> Iterator[tuple]:
        if not self.parts:
            return
        stream = np.concatenate([p[3] for p in self.parts])
        bounds = np.cumsum([0, *(len(p[3]) for p in self.parts)])
        doc_ends = np.array([end for end, (_, total, skipped, ids) in zip(bounds[1:], self.parts, strict=True) if skipped + len(ids) == total], np.int64)
        cuts = best_cuts(*candidates(len(stream), doc_ends, self.enc.sentence_ends(stream), self.window), self.window)
        if not last:
            cuts = cuts[:-2] if len(cuts) > 3 else cuts[:1]
        k = 0
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            while k < len(self.parts) and bounds[k] < high:
                begin, end = max(low, bounds[k]), min(high, bounds[k + 1])
                doc_id, total, skipped, ids = self.parts[k]
                piece = ids[begin - bounds[k] : end - bounds[k]]
                yield doc_id, int(skipped + begin - bounds[k]), len(piece), zlib.crc32(piece.tobytes()), total, self.sequence, int(begin - low), piece
                if end < bounds[k + 1]:
                    break
                k += 1
            self.sequence += 1
        done = cuts[-1]
        rest = []
        for i, (doc_id, total, skipped, ids) in enumerate(self.parts):
            if bounds[i + 1] > done:
                drop = max(0, int(done - bounds[i]))
                rest.append((doc_id, total, skipped + drop, ids[drop:]))
        self.parts = rest
        self.size = int(bounds[-1] - done)


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """One row per piece: ``id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids``.

    ``ids`` (null without ``with_ids``) are the piece's tokens.  A document is
    its ids and ``END_ID``.  A sequence's id is the scan partition's number
    times 2**32 plus a running number.  The optimum is that of a block of
    ``BLOCK`` tokens.  Defined cases: null and empty texts are one token long;
    added tokens of the vocabulary that stand in a text count as such; repeated rows and null ids are documents of their own; very
    long texts are cut into many pieces; an empty table gives no rows; other
    columns are ignored.
    """
    schema = f"id {df.schema[id_col].dataType.simpleString()}, {SCHEMA_TAIL}"
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    kind = pa.schema([pa.field("start", pa.int64())] * 6)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(path)
        packer = Packer(enc, TaskContext.get().partitionId() << 32, window)

        def rows(pieces: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*pieces, strict=True))
            ids = pa.array([p.astype(np.int32) if with_ids else None for p in columns[7]], pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *(pa.array(c, kind.field(0).type) for c in columns[1:7]), ids], names)

        id_type = None
        for batch in batches:
            id_type = batch.schema.field("id").type
            for part in small_batches(batch, "text"):
                out = []
                for doc_id, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = np.array([*enc.encode(text or ""), END_ID], np.uint32)
                    out += packer.add(doc_id, ids)
                if out:
                    yield rows(out, id_type)
        if out := list(packer.flush()):
            yield rows(out, id_type)

    return arrow_map(df.selectExpr(f"`{id_col}` as id", f"cast(`{text_col}` as string) as text"), schema, step)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
    return out.drop("ids").withColumnRenamed("id", "doc_id")
