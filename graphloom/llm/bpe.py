"""Byte-level BPE: overlapping chunks pre-tokenised in parallel, stitched where their boundaries meet, then encoded."""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


@functools.lru_cache(2)
def encoding(path: str, pattern: str):
    """The tokenizer of a ``.tiktoken`` file, and the decimal text of each id."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return own, [str(i) for i in range(max(ranks.values()) + 1)]


@functools.lru_cache(2)
def scanner(pattern: str):
    import regex

    return regex.compile(pattern)


def boundaries(text: str, pattern: str) -> list[int]:
    """Starts of pre-tokens at which a text can be cut: behind something that isn't white space.

    (Of a run of white space the last character belongs to what follows; a cut before it would change the run.)
    """
    return [i for m in scanner(pattern).finditer(text) if (i := m.start()) and not text[i - 1].isspace()]


def chunks(text: str, size: int, overlap: int):
    """``(begin, piece)``: each but the first begins ``overlap`` characters before the end of the one before."""
    begin = 0
    while True:
        yield begin, text[begin : begin + size]
        if begin + size >= len(text):
            return
        begin += size - overlap


class Stitcher:
    """Takes the chunks of one text in order and hands out pieces that can be encoded one by one.

    A chunk's scan is right from the first boundary that it shares with the scan before it; from there on both see the
    same text.  The last boundaries of a scan are not used, as they may hang on what follows (``guard`` characters).
    Where a chunk shares none (one endless word), it is joined to what is pending, which is scanned again each time that
    it has doubled.
    """

    def __init__(self, pattern: str, overlap: int, guard: int = 16):
        self.pattern, self.overlap, self.guard = pattern, overlap, guard
        self.pending, self.begin, self.sure, self.scanned = "", 0, [], 0

    def add(self, begin: int, piece: str, marks: list[int]):
        """marks: boundaries of the chunk's own scan, in characters from the text's start.  Yields pieces."""
        if self.pending:
            head = {m for m in marks if m < begin + self.overlap}
            meet = [m for m in self.sure if m in head]
            end = self.begin + len(self.pending)
            if meet:
                yield self.pending[: meet[0] - self.begin]
                self.begin, self.pending = meet[0], piece[meet[0] - begin :]
                self.scanned = len(self.pending)
                marks = [m for m in marks if m > meet[0]]
            else:
                self.pending += piece[end - begin :]
                marks = []
                if len(self.pending) >= 2 * self.scanned:
                    self.scanned = len(self.pending)
                    marks = [self.begin + m for m in boundaries(self.pending, self.pattern)]
        else:
            self.begin, self.pending, self.scanned = begin, piece, len(piece)
        end = self.begin + len(self.pending)
        self.sure = [m for m in marks if end - self.overlap <= m <= end - self.guard]

    def close(self):
        if self.pending:
            yield self.pending
        self.pending, self.sure = "", []


class Digest:
    """Number of tokens and running hashes of a text's ids and of its decoded bytes."""

    def __init__(self):
        self.n, self.ids, self.bytes = 0, hashlib.sha256(), hashlib.sha256()

    def add(self, ids: list[int], own, names: list[str]) -> None:
        if ids:
            self.ids.update(((","[: self.n]) + ",".join([names[i] for i in ids])).encode())
            self.bytes.update(own.decode_bytes(ids))
            self.n += len(ids)

    def row(self) -> tuple:
        return self.n, self.ids.hexdigest(), self.bytes.hexdigest()


class Ids:
    """A text's token ids, as packed integers."""

    def __init__(self, with_bytes: bool = False):
        self.n, self.ids, self.bytes = 0, [], [] if with_bytes else None

    def add(self, ids: list[int], own, _) -> None:
        self.ids.append(np.array(ids, np.int32))
        self.n += len(ids)
        if self.bytes is not None:
            self.bytes.append(own.decode_bytes(ids))

    def row(self) -> tuple:
        ids = np.concatenate(self.ids) if self.ids else np.zeros(0, np.int32)
        return (ids,) if self.bytes is None else (ids, b"".join(self.bytes))


#: Tokens that a task holds as output before it hands them on.
HELD = 400_000
OUTPUTS = {
    "ids": ("doc_id long, ids array<int>", Ids),
    "bytes": ("doc_id long, ids array<int>, decoded binary", lambda: Ids(True)),
    "digests": ("doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", Digest),
}
ARROW = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "binary": pa.binary()}


def encode(docs: DataFrame, path: str, pattern: str, size: int = 32_768, overlap: int = 1024, output: str = "ids") -> DataFrame:
    """Token ids of every row of ``docs(doc_id, text)``: ``(doc_id, ids array<int>)``, without special tokens.

    With output ``bytes`` also ``decoded``, the bytes of the ids; with ``digests``
    ``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` instead of both, hashed piece by piece.
    Texts of up to ``size`` characters are one chunk and are encoded where they are read.  Longer ones are cut into
    overlapping chunks, which are dealt to all tasks and pre-tokenised there; their boundaries and texts then meet by
    row, in order, and are stitched and encoded as a stream, so no task holds more than two chunks of a text.
    A null text counts as empty: no ids, and the hashes of nothing.  Repeated rows and null ids stay as they are.
    Other columns, whatever their names, are not read; an empty table gives an empty result.
    """
    schema, made = OUTPUTS[output]
    names, types = zip(*[(x.split()[0], ARROW[x.split()[1]]) for x in schema.split(", ")])

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def short(batches):
        own, words = encoding(path, pattern)
        for b in batches:
            rows, held = [], 0
            for k in range(b.num_rows):
                d = made()
                d.add(own.encode_ordinary(b.column(1)[k].as_py() or ""), own, words)
                rows.append((b.column(0)[k].as_py(), *d.row()))
                held += d.n
                if held > HELD:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)

    def cut(batches):
        for b in batches:
            for row, i, text in zip(*(c.to_pylist() for c in b.columns)):
                for k, (begin, piece) in enumerate(chunks(text, size, overlap)):
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((row, pa.int64()), (i, pa.int64()), (k, pa.int32()), (begin, pa.int64()), (piece, pa.string()))], names=["row", "doc_id", "k", "begin", "piece"])

    def scan(batches):
        for b in batches:
            marks = []
            for begin, piece in zip(b.column(3).to_pylist(), b.column(4).to_pylist()):
                found = boundaries(piece, pattern)
                marks.append([begin + m for m in found if m < overlap or m > len(piece) - overlap])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(marks, pa.list_(pa.int64()))], names=["row", "doc_id", "k", "begin", "piece", "marks"])

    def stitch(batches):
        own, words = encoding(path, pattern)
        at, rows, held = None, [], 0

        def finish():
            for x in stitcher.close():
                out.add(own.encode_ordinary(x), own, words)
            rows.append((doc, *out.row()))
            return out.n

        for b in batches:
            for row, i, begin, piece, marks in zip(*(b.column(c).to_pylist() for c in ("row", "doc_id", "begin", "piece", "marks"))):
                if row != at:
                    held += finish() if at is not None else 0
                    if held > HELD:
                        yield batch(rows)
                        rows, held = [], 0
                    at, doc, out, stitcher = row, i, made(), Stitcher(pattern, overlap)
                for x in stitcher.add(begin, piece, marks):
                    out.add(own.encode_ordinary(x), own, words)
        if at is not None:
            finish()
            yield batch(rows)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    long = F.coalesce(F.length("text") > size, F.lit(False))
    pieces = texts.where(long).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    pieces = common.mapped(pieces, cut, "row long, doc_id long, k int, begin long, piece string")
    scanned = pieces.repartition("row", "k").mapInArrow(scan, "row long, doc_id long, k int, begin long, piece string, marks array<long>")
    stitched = scanned.repartition("row").sortWithinPartitions("row", "k").mapInArrow(stitch, schema)
    return common.mapped(texts.where(~long), short, schema).unionByName(stitched)


def decode(ids: list[int], path: str, pattern: str) -> bytes:
    """The bytes of token ids, one token's after the other's."""
    return encoding(path, pattern)[0].decode_bytes(ids)


def production() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(common.table(spark, sf_dir, "documents"), *production(), output="digests")
