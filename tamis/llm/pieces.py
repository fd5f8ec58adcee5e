"""Oversized texts cut into pieces under a token limit, at natural boundaries, with an overlap.

A text becomes a string with one letter for each token, the kind of boundary at the token's end. A regular
expression with bounded quantifiers consumes that string up to the limit: its alternatives are ordered by the
strength of the boundary they end on, with a fallback to any character. A lookback from each cut gives the
overlap. The limit so counts tokens, not characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.tokens import FOLDER, encoding

LIMIT, OVERLAP = 2000, 100
#: Tokens a piece stays under the limit, as the splitting rule may see the white space at its two ends otherwise.
MARGIN = 8

#: The letters of the boundary kinds - end of a paragraph, line, sentence or word, any character, inside one.
PARAGRAPH, LINE, SENTENCE, WORD, CHARACTER, INSIDE = "PLSWCx"
_RULES = (
    (SENTENCE, regex.compile(r"[.!?…؟。！？]+[\"'»”’)\]]*(?=\s)")),
    (LINE, regex.compile(r"\n[^\S\n]*(?=\S)")),
    (PARAGRAPH, regex.compile(r"\n[^\S\n]*\n\s*(?=\S)")),
)
_SPACES = np.array([9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
_BATCH_BYTES = 2 << 20


def classes(text: str, lengths: np.ndarray) -> tuple[str, np.ndarray]:
    """The boundary letters of the tokens of a text, and the place in characters where each ends; lengths: bytes of each token."""
    data = np.frombuffer(text.encode(), np.uint8)
    begins = (data & 0xC0) != 0x80
    at = np.cumsum(lengths)
    places = np.concatenate(([0], np.cumsum(begins)))[at].astype(np.int32)
    whole = np.append(begins, True)[at]
    chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    blank = np.isin(chars, _SPACES)
    kind = np.full(len(chars) + 1, ord(CHARACTER), np.uint8)
    kind[np.flatnonzero(~blank[:-1] & blank[1:]) + 1] = ord(WORD)
    for letter, rule in _RULES:
        # a single space belongs to the word after it, so the cut is before it
        kind[[m.end() - (text[m.end() - 1] == " ") for m in rule.finditer(text)]] = ord(letter)
    kind[len(chars)] = ord(PARAGRAPH)
    letters = np.where(whole, kind[places], ord(INSIDE)).astype(np.uint8)
    return letters.tobytes().decode("ascii"), places


def pattern(limit: int = LIMIT, overlap: int = OVERLAP) -> str:
    """Alternatives by strength: all that is left, a paragraph, line or sentence that fills a quarter, a word, a character."""
    most = limit - overlap - MARGIN
    least = most // 4
    strong = "|".join(f".{{{least},{most - 1}}}{letter}" for letter in (PARAGRAPH, f"[{PARAGRAPH}{LINE}]", f"[{PARAGRAPH}{LINE}{SENTENCE}]"))
    return f".{{1,{most}}}$|{strong}|.{{0,{most - 1}}}[{PARAGRAPH}{LINE}{SENTENCE}{WORD}]|.{{0,{most - 1}}}[^{INSIDE}]"


def _classify(limit: int, name: str, folder: str):
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_tokens", pa.int32()), ("classes", pa.string()), ("places", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(name, folder)
        widths = np.zeros(enc.n_vocab, np.int64)
        for token in enc.token_byte_values():
            widths[enc.encode_single_token(token)] = len(token)
        rows, size = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = text.as_py()
                ids = enc.encode_ordinary(t)
                letters, places = classes(t, widths[ids]) if len(ids) > limit else ("", None)
                rows.append((doc, t, len(ids), letters, places))
                size += len(t)
                if size > _BATCH_BYTES:
                    yield _rows(rows, schema)
                    rows, size = [], 0
        if rows:
            yield _rows(rows, schema)

    return run


def _count(name: str, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(name, folder)
        for batch in batches:
            counts = [len(enc.encode_ordinary(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int32())], ["doc_id", "text", "n_tokens"])

    return run


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def fitting(text: str, a: int, z: int, limit: int, overlap: int, enc) -> Iterator[tuple[int, int, int]]:
    """(start, end, tokens) of parts of text[a:z] that fit the limit when encoded alone: the whole, or halves of it with overlap."""
    n = len(enc.encode_ordinary(text[a:z]))
    if n <= limit or z - a < 2:
        yield a, z, n
        return
    middle = (a + z) // 2
    back = min((z - a) // 4, overlap)  # a character has a token at least where a run doesn't merge
    yield from fitting(text, a, middle, limit, overlap, enc)
    yield from fitting(text, middle - back, z, limit, overlap, enc)


def _slice(limit: int, overlap: int, name: str, folder: str):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("n_pieces", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("n_tokens", pa.int32()), ("piece_text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(name, folder)
        for batch in batches:
            rows, size = [], 0
            for i, (doc, n, ranges) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 2, 4)))):
                text = batch.column(1)[i].as_py()
                if not ranges:
                    parts = [(0, len(text), n)]
                else:  # a piece is counted as it is encoded alone: a cut may change how its two sides are
                    at = np.concatenate(([0], batch.column(3)[i].values.to_numpy()))
                    parts = [p for r in ranges for p in fitting(text, int(at[r["a"]]), int(at[r["z"]]), limit, overlap, enc)]
                for k, (a, z, tokens) in enumerate(parts, 1):
                    rows.append((doc, k, len(parts), a, z, tokens, text[a:z]))
                    size += z - a
                if size > _BATCH_BYTES:
                    yield _rows(rows, schema)
                    rows, size = [], 0
            if rows:
                yield _rows(rows, schema)

    return run


def split_oversized(df: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, tokenizer: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """(doc_id, piece, n_pieces, start, stop, n_tokens, piece_text): the pieces of each text in order, start and stop in characters.

    A text of at most `limit` tokens is one piece. The pieces of a larger one have at most `limit` tokens each; every
    piece after the first begins with about the last `overlap` tokens of the one before; without the overlaps they give
    the text. n_tokens is the count of the piece, encoded alone. Null and empty texts
    give no piece; rows that repeat, or have a null id, give the pieces of each. Other columns are ignored. Cuts are
    single-row work: no shuffle.
    """
    docs = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).filter(F.length("text") > 0)
    # a token has a byte at least, so these texts are one piece: whoever asks for cut texts only doesn't have them encoded
    small = docs.filter(F.octet_length("text") <= limit).mapInArrow(_count(tokenizer, folder), "doc_id BIGINT, text STRING, n_tokens INT")
    one = F.lit(1)
    small = small.select("doc_id", one.alias("piece"), one.alias("n_pieces"), F.lit(0).alias("start"), F.length("text").alias("stop"), "n_tokens", F.col("text").alias("piece_text"))
    marked = docs.filter(F.octet_length("text") > limit).mapInArrow(_classify(limit, tokenizer, folder), "doc_id BIGINT, text STRING, n_tokens INT, classes STRING, places ARRAY<INT>")
    cores = F.transform(F.regexp_extract_all("classes", F.lit(pattern(limit, overlap)), F.lit(0)), F.length)
    ends = F.aggregate(cores, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))

    def piece(i):
        cut, end = F.element_at("ends", i), F.element_at("ends", i + 1)
        back = F.least(cut, F.lit(overlap))
        window = F.substring(F.col("classes"), cut - back + 1, back)
        lead = F.length(F.regexp_extract(window, f"^(?:[{INSIDE}{CHARACTER}]{{0,{overlap // 2}}}[{PARAGRAPH}{LINE}{SENTENCE}{WORD}]|{INSIDE}*[^{INSIDE}])", 0))
        start = F.when(cut == 0, 0).when(back < overlap, 0).otherwise(cut - back + lead)
        return F.struct(start.cast("int").alias("a"), end.cast("int").alias("z"))

    big = F.col("n_tokens") > limit
    cut = marked.withColumn("ends", F.when(big, ends)).withColumn("pieces", F.when(big, F.transform(F.sequence(F.lit(1), F.size("ends") - 1), piece)))
    cut = cut.select("doc_id", "text", "n_tokens", "places", F.col("pieces").alias("ranges"))
    large = cut.mapInArrow(_slice(limit, overlap, tokenizer, folder), "doc_id BIGINT, piece INT, n_pieces INT, start INT, stop INT, n_tokens INT, piece_text STRING")
    return large.unionByName(small)
