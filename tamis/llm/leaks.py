"""Evaluation items that leak into a corpus, found with a generalised suffix automaton of the items' words.

The automaton has one transition for each word; every state keeps the items in which its strings, or
long enough ends of them, occur. The words of a document are streamed through it while the longest matching length is tracked, so
every shared run of at least `least` words is found with all items that have it, whatever its length or place.
Stretches of a document without any run of `least` - 1 word pairs that occur in an item can't reach that length;
they are skipped by array operations before the stream.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Consecutive words that make a leak.
LEAST = 12
#: Words of items in one automaton, and automata that a worker holds at once. More items make more blocks; the result is the same.
BLOCK_WORDS, HELD_BLOCKS = 100_000, 8

_WORD = re.compile(r"[^\W_]+")


@lru_cache(maxsize=2)
def _marks(astral: bool) -> re.Pattern:
    """All combining marks of the basic plane, or all others: one class over all planes is ten times slower."""
    points = range(0x10000, sys.maxunicode + 1) if astral else range(0x10000)
    return re.compile("[" + "".join(chr(c) for c in points if unicodedata.category(chr(c))[0] == "M") + "]+")


def words(text: str) -> list[str]:
    """The longest runs of letters and digits after lower-casing, decomposing and dropping combining marks."""
    text = text.lower()
    if not text.isascii():
        text = _marks(False).sub("", unicodedata.normalize("NFD", text))
        if not text.isascii() and max(text) > "\uffff":
            text = _marks(True).sub("", text)
    return _WORD.findall(text)


class Automaton:
    """Generalised suffix automaton over lists of words."""

    def __init__(self, items: list[tuple[int, list[str]]], least: int = LEAST):
        self.least = least
        self.vocabulary: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: list[set[int]] = [set()]
        pairs = set()
        for item, tokens in items:
            last = 0
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in tokens]
            pairs.update(zip(ids, ids[1:]))
            for w in ids:
                last = self._extend(last, w, own)
                own[last].add(item)
        size = len(self.vocabulary)
        self.pairs = np.unique(np.array([a * size + b for a, b in pairs], np.int64))
        # items go up the suffix links, longest strings first; their longest runs then come down them
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        for v in reversed(order):
            if self.link[v] > 0:
                own[self.link[v]] |= own[v]
        #: (item, length of its longest string that ends any string of the state), for lengths of at least `least`
        self.runs: list[dict[int, int]] = [{}] * len(own)
        for v in order:
            if self.length[v] >= least:
                self.runs[v] = self.runs[self.link[v]] | dict.fromkeys(own[v], self.length[v])

    def _extend(self, last: int, w: int, own: list[set[int]]) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q, own)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        own.append(set())
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q, own)
        return cur

    def _clone(self, p: int, w: int, q: int, own: list[set[int]]) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        own.append(set())
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = clone
            p = link[p]
        link[q] = clone
        return clone

    def stretches(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Word ranges whose word pairs all occur in items, of at least `least` words."""
        if len(ids) < self.least or not len(self.pairs):
            return []
        known = (ids[:-1] >= 0) & (ids[1:] >= 0)
        codes = ids[:-1] * len(self.vocabulary) + ids[1:]
        at = np.minimum(np.searchsorted(self.pairs, codes), len(self.pairs) - 1)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (known & (self.pairs[at] == codes)).view(np.int8), [0]))))
        return [(int(a), int(z) + 1) for a, z in edges.reshape(-1, 2) if z - a + 1 >= self.least]

    def matches(self, tokens: list[str]) -> Iterator[tuple[int, int, dict[int, int]]]:
        """(end, length, runs) wherever the longest match that ends there has at least `least` words; end is exclusive."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in tokens), np.int64, len(tokens))
        for a, z in self.stretches(ids):
            v = matched = 0
            for i, w in enumerate(ids[a:z].tolist(), a):
                while v and w not in self.next[v]:
                    v = self.link[v]
                    matched = self.length[v]
                if w in self.next[v]:
                    v = self.next[v][w]
                    matched += 1
                if matched >= self.least:
                    yield i + 1, matched, self.runs[v]


def leaked(automaton: Automaton, text: str) -> dict[int, list[int]]:
    """Each leaked item of a text: [longest shared run in words, words of the text that lie in shared runs]."""
    found: dict[int, list[int]] = {}
    last: dict[int, int] = {}
    for end, matched, runs in automaton.matches(words(text)):
        for item, length in runs.items():
            length = min(length, matched)
            run = found.setdefault(item, [0, 0])
            run[0] = max(run[0], length)
            run[1] += end - max(last.get(item, 0), end - length)
            last[item] = end
    return found


def spans(automata: Iterable[Automaton], text: str) -> list[tuple[int, int]]:
    """Word ranges of a text that lie in runs shared with any of the automata, merged."""
    tokens = words(text)
    found = sorted((end - length, end) for automaton in automata for end, length, _ in automaton.matches(tokens))
    out: list[list[int]] = []
    for a, z in found:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def _blocks(items: DataFrame, item_id: str, text: str, least: int, block_words: int) -> Iterator[list[tuple[int, list[str]]]]:
    """The items of at least `least` words in blocks of about block_words words; the driver holds one block at a time."""
    block, size = [], 0
    for row in items.select(F.col(item_id).cast("bigint"), F.col(text).cast("string")).distinct().toLocalIterator():
        tokens = words(row[1] or "")
        if row[0] is None or len(tokens) < least:
            continue
        block.append((row[0], tokens))
        size += len(tokens)
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


@lru_cache(maxsize=HELD_BLOCKS)
def _automaton(key: tuple, least: int) -> Automaton:
    return Automaton([(i, list(t)) for i, t in key], least)


def _automata(shared: list, least: int) -> Iterator[Automaton]:
    """One automaton after the other; a worker keeps HELD_BLOCKS of them and builds further ones again for each batch."""
    return (_automaton(block.value, least) for block in shared)


_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("longest", pa.int32()), ("covered", pa.int32())])
_CLEAN = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("removed", pa.int32()), ("n_words", pa.int32())])


def _find(shared: list, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for automaton in _automata(shared, least):
                rows = [(doc, item, *hit) for doc, text in zip(ids, batch.column(1)) for item, hit in leaked(automaton, text.as_py()).items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FOUND)], schema=_FOUND)

    return run


def _cut(shared: list, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc, *without_shared(lambda: _automata(shared, least), t.as_py())) for doc, t in zip(batch.column(0).to_pylist(), batch.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_CLEAN)], schema=_CLEAN)

    return run


def word_places(text: str) -> list[tuple[int, int]]:
    """Place in the text of each of its words(), by mapping every character to what it becomes."""
    built, origin = [], []
    for i, c in enumerate(text):
        # lower-casing is by character here; the few whole-text rules of str.lower() don't change what is a letter
        for d in unicodedata.normalize("NFD", c.lower()):
            if unicodedata.category(d)[0] != "M":
                built.append(d)
                origin.append(i)
    return [(origin[m.start()], origin[m.end() - 1] + 1) for m in _WORD.finditer("".join(built))]


def without_spans(automaton: Automaton, text: str | None) -> tuple[str | None, int, int]:
    """without_shared() of one automaton."""
    return without_shared(lambda: [automaton], text)


def without_shared(automata: Callable[[], Iterable[Automaton]], text: str | None) -> tuple[str | None, int, int]:
    """The text without the spans that it shares with any automaton, how many words went, how many there were.

    What is left on both sides of a span may form a new run, with an item of any automaton, so all are asked again until
    none finds a span. How the items are spread over automata makes no difference.
    """
    if text is None:
        return None, 0, 0
    removed = 0
    while True:
        found = spans(automata(), text)
        if not found:
            return text, removed, len(words(text)) + removed
        places = word_places(text)
        out, last = [], 0
        for a, z in found:
            out.append(text[last : places[a][0]])
            last = places[z - 1][1]
            while last < len(text) and unicodedata.category(text[last])[0] == "M":  # the marks of the last letter
                last += 1
        text = " ".join((*out, text[last:]))
        removed += sum(z - a for a, z in found)


def _shared(spark: SparkSession, blocks: Iterator[list[tuple[int, list[str]]]]) -> list:
    return [spark.sparkContext.broadcast(tuple((i, tuple(t)) for i, t in block)) for block in blocks]


def find_leaks(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = LEAST, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """(doc_id, item_id, longest, covered): each document with each item of which it has `least` consecutive words.

    longest is the longest shared run in words, covered how many words of the document lie in runs shared with the item.
    Null and empty texts match nothing, nor do items shorter than `least` words or without an id. Repeated rows give one
    row; items with equal texts are all reported. Extra columns are ignored. The corpus is read once, whatever the
    number of items.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).filter(F.length("text") > 0)
    shared = _shared(spark, _blocks(items, item_id, item_text, least, block_words))
    if not shared:
        return spark.createDataFrame([], "doc_id BIGINT, item_id BIGINT, longest INT, covered INT")
    found = rows.mapInArrow(_find(shared, least), "doc_id BIGINT, item_id BIGINT, longest INT, covered INT")
    return found.groupBy("doc_id", "item_id").agg(F.max("longest").alias("longest"), F.max("covered").alias("covered"))


def remove_leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    least: int = LEAST,
    most_coverage: float = 0.5,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(doc_id, text, removed, dropped): each document without the spans of `least` or more words that it shares with an item.

    Where the spans hold more than most_coverage of the words, the whole text goes: text is null and dropped true. Null
    texts stay null. One row for each row of docs. No text that is left has a run of `least` words of any item.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    shared = _shared(docs.sparkSession, _blocks(items, item_id, item_text, least, block_words))
    done = rows.mapInArrow(_cut(shared, least), "doc_id BIGINT, text STRING, removed INT, n_words INT")
    dropped = F.col("removed") > F.col("n_words") * most_coverage
    return done.select("doc_id", F.when(~dropped, F.col("text")).alias("text"), "removed", dropped.alias("dropped"))
