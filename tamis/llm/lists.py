"""Free-entered values mapped to the closest entry of a reference list, or reported as unmatched.

The words of the entries, and their alias paths (other gender, plural), form a trie; so do the whole entries written
without spaces, and their sigles. A Levenshtein automaton, with swaps, runs over a trie and returns everything within
a distance that depends on the length. An entry's score is the
weighted share of its words that the value's words cover, rare words counting more; words that are abbreviated count
as paths to each entry word that they shorten, and initials to the words they begin.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.names import fold, letters, tokens

UNMATCHED = "SANS_CORRESPONDANCE"
#: Entries in one broadcast block; a longer list is searched in more blocks, with the same result.
BLOCK_ENTRIES = 20_000
#: Weighted share of an entry that must be covered, and what a word costs that belongs to no entry or addition.
LEAST_COVERED, STRANGE_WORD = 0.72, 0.1
#: Letters of the value that must take part, unless they are a sigle: fewer are a mark such as "cf. p. 2".
LEAST_LETTERS = 4
#: Values whose result each worker keeps.
CACHE = 50_000

#: Words without weight in French entries, and endings of other genders.
STOP_WORDS = frozenset("a au aux d de des du en et l la le les sur the of and".split())
#: Words that are added to a title or a bank, those after which all is added, and other words for an entry's.
ADDITIONS = frozenset("cdi cdd siege confirme confirmee principal principale senior junior stagiaire interim poste qualite sa ste societe".split())
PLACES = frozenset("agence agences succursale guichet".split())
SYNONYMS = {"medecin": ("dr", "docteur")}
SAME = {"bank": "banque"}
GENDERS = (("eur", "rice"), ("eur", "euse"), ("teur", "trice"), ("ier", "iere"), ("er", "ere"), ("ien", "ienne"), ("ant", "ante"), ("ent", "ente"), ("if", "ive"), ("al", "ale"), ("el", "elle"), ("e", "ee"), ("in", "ine"), ("ain", "aine"), ("on", "onne"))


def allowed(length: int) -> int:
    """Edits allowed for a word of some length."""
    return 0 if length < 4 else 1 if length < 6 else 2 if length < 12 else 3


class Trie:
    """Strings with the things they lead to; search() is a Levenshtein automaton over it."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, target: object) -> None:
        node = self.root
        for c in word:
            node = node.setdefault(c, {})
        node.setdefault("", set()).add(target)

    def search(self, word: str, most: int) -> dict[object, int]:
        """Every target within `most` edits of the word, with the fewest edits; a swap of neighbours is one edit."""
        found: dict[object, int] = {}
        n = len(word)
        stack = [(self.root, list(range(n + 1)), None, "")]
        while stack:
            node, row, before, last = stack.pop()
            if "" in node and row[n] <= most:
                for t in node[""]:
                    if found.get(t, most + 1) > row[n]:
                        found[t] = row[n]
            for c, child in node.items():
                if not c:
                    continue
                left = row[0] + 1
                new = [left]
                least = left
                for j in range(1, n + 1):
                    x = word[j - 1]
                    cost = row[j - 1] + (x != c)
                    if row[j] < cost:
                        cost = row[j] + 1
                    if left < cost:
                        cost = left + 1
                    if before is not None and j > 1 and x == last and word[j - 2] == c and before[j - 2] + 1 < cost:
                        cost = before[j - 2] + 1
                    new.append(cost)
                    left = cost
                    if cost < least:
                        least = cost
                if least <= most:
                    stack.append((child, new, row, c))
        return found


def shortens(short: str, word: str) -> float:
    """How far a shortened form stands for a word, 0 to 1: its beginning, or letters of it in order from the first."""
    if len(short) >= len(word) or not short or short[0] != word[0]:
        return 1.0 if len(short) > 3 and word.endswith(short) else 0.85 if len(short) == 3 and len(word) > 5 and word[-4:].startswith(short[:1]) and word.endswith(short[1:]) else 0.0
    if word.startswith(short):
        return 0.97 if len(short) > 2 else 0.9
    it = iter(word)
    if 1 < len(short) < 5 and all(c in it for c in short):
        return 0.9 if len(short) > 2 else 0.8
    return 0.0


class Matcher:
    """The entries of one list, or of a block of one.

    vocabulary: every word of the whole list with the number of its entries, and total the number of all entries; they are
    those of `entries` where they aren't given. What a word may stand for and what it weighs go by the whole list.
    """

    def __init__(self, entries: list[tuple[str, str, str | None]], vocabulary: dict[str, int] | None = None, total: int | None = None):
        self.words: list[tuple[str, ...]] = []
        self.codes: list[str] = []
        self.word_trie, self.whole_trie, self.added = Trie(), Trie(), Trie()
        for w in ADDITIONS:
            self.added.add(w, "addition")
        for w in PLACES:
            self.added.add(w, "place")
        self.sigles: dict[str, int] = {}
        self.initials: dict[str, set[tuple[int, tuple[str, ...]]]] = {}
        self.of_word: dict[str, set[int]] = {}
        self.cache: dict[str, tuple[str, float]] = {}
        self.seen: dict[tuple[str, bool], dict[str, float]] = {}
        for code, label, sigle in entries:
            own = entry_words(label)
            if not own:
                continue
            at = len(self.codes)
            self.codes.append(code)
            self.words.append(own)
            for w in own:
                self.of_word.setdefault(w, set()).add(at)
            for i in range(len(own)):
                for j in range(i + 2, len(own) + 1):
                    self.initials.setdefault("".join(w[0] for w in own[i:j]), set()).add((at, own[i:j]))
            self.whole_trie.add("".join(tokens(label)), at)
            self.whole_trie.add("".join(t for t in tokens(label) if t not in STOP_WORDS), at)
            if sigle:
                self.sigles.setdefault("".join(tokens(sigle)), at)
        self.total = len(self.codes) if total is None else total
        self.vocabulary = {w: len(own) for w, own in self.of_word.items()} if vocabulary is None else vocabulary
        self.by_first: dict[str, list[str]] = {}
        self.by_last: dict[str, list[str]] = {}
        for w in self.vocabulary:
            self.by_first.setdefault(w[0], []).append(w)
            self.by_last.setdefault(w[-1], []).append(w)
            for alias in (*aliases(w), *SYNONYMS.get(w, ())):
                self.word_trie.add(alias, w)

    def weight(self, word: str) -> float:
        """Words that few entries have count more."""
        return log(self.total / self.vocabulary[word]) + 0.1

    def candidates(self, token: str, dotted: bool) -> dict[str, float]:
        """Entry words that a token may stand for, with a likeness of at most 1."""
        key = (token, dotted)
        if key not in self.seen:
            if len(self.seen) > CACHE:
                self.seen.clear()
            out: dict[str, float] = {}
            for form in {token, letters(token)}:
                for w, edits in self.word_trie.search(form, allowed(len(form))).items():
                    out[w] = max(out.get(w, 0), 1 - edits / max(len(w), len(form)) * 0.7)
                if not out or dotted:
                    # a word that the form shortens begins or ends with the same letter
                    for w in {*self.by_first.get(form[0], ()), *self.by_last.get(form[-1], ())}:
                        if (s := shortens(form, w)) and (dotted or len(form) > 1):
                            out[w] = max(out.get(w, 0), s)
            self.seen[key] = out
        return self.seen[key]

    def best(self, value: str) -> tuple[str, float]:
        """The code and score of the entry meant; of equal scores the smallest code."""
        if value not in self.cache:
            if len(self.cache) > CACHE:
                self.cache.clear()
            code, score = next(iter(self.ranked(value)), (UNMATCHED, 0.0))
            self.cache[value] = (code, score) if score >= LEAST_COVERED else (UNMATCHED, score)
        return self.cache[value]

    def ranked(self, value: str) -> list[tuple[str, float]]:
        """Every entry that the automata reach from the value's words, with its score, the best first."""
        folded = re.sub(r"\((.*?)\)", r" \1 ", fold(value))
        found = [(letters_of, dot == ".") for letters_of, dot in re.findall(r"([^\W_]+)(\.?)", folded)]
        joined, run = [], ""
        for t, _ in [*found, ("", False)]:  # letters with dots between them are a sigle
            if len(t) == 1:
                run += t
            else:
                if len(run) > 1:
                    joined.append(run)
                run = ""
        scores: dict[int, float] = {}
        for t in [*(t for t, _ in found), *joined]:
            for form in {t, letters(t)}:
                if form in self.sigles:
                    scores[self.sigles[form]] = 1.0
        content = []
        for t, dotted in found:
            added = self.added.search(t, len(t) > 4)
            if "place" in added:
                break
            if t not in STOP_WORDS:
                content.append((SAME.get(t, t), dotted, bool(added)))
        matched: dict[int, dict[str, tuple[float, int]]] = {}
        for k, (t, dotted, _) in enumerate(content):
            for w, s in self.candidates(t, dotted).items():
                for at in self.of_word.get(w, ()):
                    slot = matched.setdefault(at, {})
                    if s > slot.get(w, (0, 0))[0] and not any(j == k and s <= x for v, (x, j) in slot.items() if v != w):
                        for v in [v for v, (x, j) in slot.items() if j == k and v != w]:
                            del slot[v]
                        slot[w] = (s, k)
            for at, run in self.initials.get(t, ()):
                slot = matched.setdefault(at, {})
                for w in run:
                    if slot.get(w, (0, 0))[0] < 0.9:
                        slot[w] = (0.9, k)
        for at, slot in matched.items():
            own = self.words[at]
            covered = sum(self.weight(w) * slot[w][0] for w in own if w in slot) / sum(map(self.weight, own))
            used = {k for _, k in slot.values()}
            if sum(len(content[k][0]) for k in used) < LEAST_LETTERS:
                continue
            strange = sum(k not in used and not added for k, (_, _, added) in enumerate(content))
            scores[at] = max(scores.get(at, 0), covered - STRANGE_WORD * min(strange, 3))
        compact = "".join(t for t, _ in found)
        for form in {compact, letters(compact)}:
            for at, edits in self.whole_trie.search(form, allowed(len(form)) + (len(form) > 18)).items():
                scores[at] = max(scores.get(at, 0), 1 - edits / len(form))
        return sorted(((self.codes[at], score) for at, score in scores.items()), key=lambda x: (-x[1], x[0]))


def entry_words(label: str) -> tuple[str, ...]:
    """The words of an entry that have weight."""
    return tuple(SAME.get(t, t) for t in tokens(label) if t not in STOP_WORDS)


def aliases(word: str) -> set[str]:
    """The word, its forms of the other gender, and their plural and singular."""
    out = {word}
    for end, other in GENDERS:
        if len(word) > len(end) + 2 and word.endswith(end):
            out.add(word[: -len(end)] + other)
    out |= {w[:-1] if w.endswith("s") else w + "s" for w in out if len(w) > 4}
    return out


@lru_cache(maxsize=4)
def _matcher(entries: tuple, vocabulary: tuple, total: int) -> Matcher:
    return Matcher(list(entries), dict(vocabulary), total)


_MAPPED = pa.schema([("row_id", pa.string()), ("kind", pa.string()), ("value", pa.string()), ("code", pa.string()), ("score", pa.float64())])
_ROWS = "row_id STRING, kind STRING, value STRING, code STRING, score DOUBLE"


def _lookup(shared, words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = {kind: _matcher(entries, *words.value[kind]) for kind, entries in shared.value.items()}
        for batch in batches:
            codes, scores = [], []
            for kind, value, code, score in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                if kind in matchers:
                    # a better entry than that of the blocks before; of equal scores the smaller code
                    new, s = matchers[kind].best(value)
                    if new == UNMATCHED:
                        score = max(score, s) if code == UNMATCHED else score
                    elif code == UNMATCHED or (-s, new) < (-score, code):
                        code, score = new, s
                codes.append(code)
                scores.append(score)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(codes, pa.string()), pa.array(scores, pa.float64())], schema=_MAPPED)

    return run


def _reach(shared, words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = {kind: _matcher(entries, *words.value[kind]) for kind, entries in shared.value.items()}
        for batch in batches:
            rows = [
                (row_id, kind, value, code, score)
                for row_id, kind, value in zip(*(batch.column(i).to_pylist() for i in range(3)))
                if kind in matchers
                for code, score in matchers[kind].ranked(value)
            ]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _MAPPED)], schema=_MAPPED)

    return run


def _words_of_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(kind, code, label, w) for kind, code, label in zip(*(batch.column(i).to_pylist() for i in range(3))) for w in {"", *entry_words(label)}]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["kind", "code", "label", "word"])


def _blocks(entries: DataFrame, kind: str, code: str, label: str, sigle: str, block_entries: int) -> Iterator[tuple]:
    """(broadcast entries by kind, broadcast vocabulary by kind) of each block. The vocabulary is that of the whole list: it is
    counted once, by kind, and belongs to every block."""
    spark = entries.sparkSession
    columns = {kind: "kind", code: "code", label: "label", sigle: "sigle"}
    listed = entries.select(*(F.col(c).cast("string").alias(name) for c, name in columns.items())).filter("code IS NOT NULL AND label IS NOT NULL").distinct()
    counted = listed.select("kind", "code", "label").mapInArrow(_words_of_entries, "kind STRING, code STRING, label STRING, word STRING").groupBy("kind", "word").agg(F.count("*").alias("n"))
    vocabulary: dict[str, dict[str, int]] = {}
    for r in counted.toLocalIterator():
        vocabulary.setdefault(r.kind, {})[r.word] = r.n
    totals = {k: v.pop("", 0) for k, v in vocabulary.items()}
    words = spark.sparkContext.broadcast({k: (tuple(sorted(v.items())), totals[k]) for k, v in vocabulary.items()})
    block: dict[str, list] = {}
    size = 0
    for r in listed.toLocalIterator():
        block.setdefault(r.kind, []).append((r.code, r.label, r.sigle))
        size += 1
        if size >= block_entries:
            yield spark.sparkContext.broadcast({k: tuple(sorted(v, key=lambda e: (e[0], e[1]))) for k, v in block.items()}), words
            block, size = {}, 0
    if size:
        yield spark.sparkContext.broadcast({k: tuple(sorted(v, key=lambda e: (e[0], e[1]))) for k, v in block.items()}), words


def _rows(values: DataFrame, row_id: str, kind: str, value: str) -> DataFrame:
    rows = values.select(F.col(row_id).cast("string").alias("row_id"), F.col(kind).cast("string").alias("kind"), F.col(value).cast("string").alias("value"))
    return rows.filter(F.col("value").rlike(r"[^\s\p{Z}]"))


def map_to_list(
    values: DataFrame,
    entries: DataFrame,
    row_id: str = "champ_id",
    kind: str = "nom_source",
    value: str = "valeur",
    code: str = "ref_code",
    label: str = "libelle",
    sigle: str = "sigle",
    block_entries: int = BLOCK_ENTRIES,
) -> DataFrame:
    """(row_id, kind, value, code, score): each non-blank value with the entry of its kind that it means, or SANS_CORRESPONDANCE.

    Null and blank values give no row; null ids are kept; repeated rows give a row each. Kinds without entries are unmatched,
    entries without a code or label are left out. Of entries with the same score the smallest code counts. Values are looked
    up where their rows are, with a cache of results, so a value that holds a third of the rows moves nothing. Extra columns
    are ignored. The result doesn't depend on block_entries.
    """
    rows = _rows(values, row_id, kind, value).withColumns({"code": F.lit(UNMATCHED), "score": F.lit(0.0)})
    for shared, words in _blocks(entries, kind, code, label, sigle, block_entries):
        rows = rows.mapInArrow(_lookup(shared, words), _ROWS)
    return rows


def entries_within(
    values: DataFrame,
    entries: DataFrame,
    row_id: str = "champ_id",
    kind: str = "nom_source",
    value: str = "valeur",
    code: str = "ref_code",
    label: str = "libelle",
    sigle: str = "sigle",
    block_entries: int = BLOCK_ENTRIES,
) -> DataFrame:
    """(row_id, kind, value, code, score): each non-blank value with every entry of its kind that an automaton reaches from one of
    its words within the distance for the word's length, whatever the score. Values that reach none give no row; for the rest
    as map_to_list, whose entry is the first of them by score and code."""
    rows, out = _rows(values, row_id, kind, value), None
    for shared, words in _blocks(entries, kind, code, label, sigle, block_entries):
        part = rows.mapInArrow(_reach(shared, words), _ROWS)
        out = part if out is None else out.unionByName(part)
    return rows.withColumns({"code": F.lit(None).cast("string"), "score": F.lit(None).cast("double")}).limit(0) if out is None else out
