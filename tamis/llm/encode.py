"""Encoding of a corpus with content-defined chunk reuse.

Texts are cut where a rolling hash of the last bytes meets a mask, so the same passage gives the same chunks in
every document. Each different chunk of the corpus is encoded once. The ids of a text are those of its chunks in
order, after the joins are repaired: where the tokenizer's splitting rule doesn't part the text at a join, the
window from the last sure split before it to the first after it is encoded again, so both sides agree exactly.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.tokens import FOLDER, encoding

#: One cut in 2 ** MASK_BITS bytes on average, chunks of at least LEAST and at most MOST bytes.
MASK_BITS, LEAST, MOST = 9, 192, 8192
_BATCH_BYTES = 2 << 20
_M = [np.uint32(pow(0x9E3779B1, 2**k, 1 << 32)) for k in range(4)]


def marks(data: bytes) -> list[int]:
    """Places where the rolling hash of the 16 bytes before them has MASK_BITS leading zero bits."""
    h = np.frombuffer(data, np.uint8).astype(np.uint32)
    h += np.uint32(1)
    for k, m in enumerate(_M):  # windows of 2, 4, 8 and 16 bytes, each from two halves
        step = 1 << k
        if len(h) <= step:
            return []
        h = h[step:] + h[:-step] * m
    return (np.flatnonzero(h * _M[0] < np.uint32(1 << (32 - MASK_BITS))) + 16).tolist()


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks: marks moved on to the next space that follows an ASCII character other than white space."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    at, ends, last = marks(data), [], 0
    while n - last > LEAST:
        i = bisect_left(at, last + LEAST)
        limit = last + MOST
        end = at[i] if i < len(at) else n
        while True:
            end = data.find(b" ", end, limit + 1)
            if end < 0 or 32 < data[end - 1] < 128:
                break
            end += 1
        if end < 0:
            if limit >= n:
                break
            end = limit
            while data[end] & 0xC0 == 0x80:  # never inside a character
                end -= 1
        ends.append(end)
        last = end
    if last < n:
        ends.append(n)
    return ends


def _cut(batches: Iterator[pa.RecordBatch], with_chunks: bool) -> Iterator[tuple[list, ...]]:
    size, out = 0, ([], [], [], [])
    for batch in batches:
        texts = batch.column(0) if with_chunks else batch.column(2)
        for row, text in enumerate(texts.cast(pa.binary())):
            data, last = text.as_py(), 0
            if not data:
                continue
            for k, end in enumerate(cut_points(data)):
                chunk = data[last:end]
                last = end
                if with_chunks:
                    out[0].append(chunk)
                else:
                    out[0].append(batch.column(0)[row].as_py())
                    out[1].append(batch.column(1)[row].as_py())
                    out[2].append(k)
                    out[3].append(xxhash.xxh3_128_digest(chunk))
            size += len(data)
            if size > _BATCH_BYTES:
                yield out
                size, out = 0, ([], [], [], [])
    if out[0]:
        yield out


def _distinct_in_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for out in _cut(batches, True):
        yield pa.RecordBatch.from_arrays([pa.array(dict.fromkeys(out[0]), pa.binary())], ["chunk"])


def _references(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
    for out in _cut(batches, False):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["doc_id", "text_key", "pos", "chunk_id"])


def _width(enc) -> type:
    return np.uint16 if enc.n_vocab <= 1 << 16 else np.uint32


def _encode_chunks(name: str, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(name, folder)
        kind = _width(enc)
        for batch in batches:
            chunks = batch.column(0).to_pylist()
            ids = [np.array(enc.encode_ordinary(str(c, "utf-8")), kind).tobytes() for c in chunks]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(c) for c in chunks], pa.binary()), pa.array(ids, pa.binary())], ["chunk_id", "ids"])

    return run


def sure_split(left: bytes, right: bytes) -> bool:
    """True where the splitting rule always parts: a space after an ASCII character that isn't white space."""
    return right[:1] == b" " and 32 < left[-1] < 128


def repaired(parts: list[list[int]], enc) -> list[int]:
    """The ids of the whole text from those of its consecutive chunks; each unsure stretch is encoded once more, whole."""
    one = enc.decode_single_token_bytes
    sure = lambda a, b: sure_split(one(a), one(b))
    again = lambda ids: enc.encode_ordinary(str(b"".join(map(one, ids)), "utf-8"))
    done: list[int] = []
    unsure: list[int] = []
    for ids in parts:
        if unsure and sure(unsure[-1], ids[0]):
            done += again(unsure)
            unsure = []
        if not unsure:
            if not done or sure(done[-1], ids[0]):
                done += ids
                continue
            i = len(done) - 1
            while i and not sure(done[i - 1], done[i]):
                i -= 1
            unsure = done[i:]
            del done[i:]
        j = next((j for j in range(1, len(ids)) if sure(ids[j - 1], ids[j])), len(ids))
        unsure += ids[:j]
        if j < len(ids):
            done += again(unsure)
            unsure = []
            done += ids[j:]
    return done + (again(unsure) if unsure else [])


def _assemble(name: str, folder: str):
    """Over rows sorted by document and position: one row for each document, as many times as its first chunk occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(name, folder)
        kind = _width(enc)
        first, last = _ends(enc)
        key, parts, copies, pos = None, [], 0, -1
        out: list[tuple[int, np.ndarray]] = []
        size = 0

        def finish() -> None:
            nonlocal size
            if all(last[a[-1]] and first[b[0]] for a, b in zip(parts, parts[1:])):
                ids = np.concatenate(parts) if len(parts) > 1 else parts[0]
            else:
                ids = np.array(repaired([p.tolist() for p in parts], enc), np.int32)
            out.extend([(key[0], ids)] * copies)
            size += len(ids) * copies

        for batch in batches:
            for doc, text_key, k, ids in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if key != (doc, text_key):
                    if key is not None:
                        finish()
                    key, parts, copies, pos = (doc, text_key), [], 0, -1
                if k != pos:
                    parts.append(np.frombuffer(ids, kind))
                    pos = k
                copies += k == 0
                if size > 1 << 20:
                    yield _lists(out)
                    out, size = [], 0
        if key is not None:
            finish()
        if out:
            yield _lists(out)

    return run


def _ends(enc) -> tuple[np.ndarray, np.ndarray]:
    """For each id: does it begin with a space; does it end with an ASCII character that isn't white space."""
    first, last = np.zeros(enc.n_vocab, bool), np.zeros(enc.n_vocab, bool)
    for token in enc.token_byte_values():
        i = enc.encode_single_token(token)
        first[i], last[i] = token[0] == 32, 32 < token[-1] < 128
    return first, last


def _lists(out: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    ends = np.cumsum([0, *(len(ids) for _, ids in out)]).astype(np.int32)
    flat = pa.array(np.concatenate([ids for _, ids in out]).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array([d for d, _ in out], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), flat)], ["doc_id", "ids"])


def encode_corpus(df: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """(doc_id, ids): one row for each row of df, the ids of its text by a byte-level tokenizer, without special tokens.

    Null and empty texts give an empty list; strings that look like special tokens are ordinary text. doc_id is an
    integer; rows with a null one or one that occurs again are kept, each with the ids of its own text. Other columns
    are ignored. A text is assembled in one task, so a single text must fit there; nothing else has to.
    """
    docs = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    full = docs.filter(F.length("text") > 0)
    # one pass dedupes the chunks (inside each task first), another names the chunks of each text; the texts are never shuffled
    chunks = full.select("text").mapInArrow(_distinct_in_batch, "chunk BINARY").distinct()
    encoded = chunks.mapInArrow(_encode_chunks(tokenizer, folder), "chunk_id BINARY, ids BINARY")
    uses = full.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(_references, "doc_id BIGINT, text_key BIGINT, pos INT, chunk_id BINARY")
    parts = uses.join(encoded, "chunk_id").select("doc_id", "text_key", "pos", "ids")
    ordered = parts.repartition("doc_id", "text_key").sortWithinPartitions("doc_id", "text_key", "pos")
    texts = ordered.mapInArrow(_assemble(tokenizer, folder), "doc_id BIGINT, ids ARRAY<INT>")
    empty = docs.filter(F.col("text").isNull() | (F.length("text") == 0)).select("doc_id", F.array().cast("array<int>").alias("ids"))
    return texts.unionByName(empty)
