"""Postal addresses of the same place, written differently.

An address is read into its number, its street name and the words of its quarter, town and code; floors, flats and the
country go, abbreviations are resolved by dictionaries. MinHash bands over the name and its q-grams, each joined with
the number, bring similar streets of the same number together. Inside a band bucket, candidates are held against the
leaders found so far and verified by an affine-gap alignment of their words, so a place with very many writings costs
one comparison each. The links are consolidated into classes, whose members must also agree on quarter and town.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.groups import consolidate
from tamis.llm.names import fold, letters, osa
from tamis.session import durable, spread

#: MinHash: bands and rows of each. Two streets that share half their shingles meet with a probability above 0.99.
BANDS, ROWS = 40, 3
#: Affine gaps: a missing part costs little, and hardly more if it is long; a word in common is worth a gap on both sides.
GAP_OPEN, GAP_EXTEND, MISMATCH, REWARD, MOST_COST = 0.3, 0.05, 1.5, 0.6, 0.9

#: Abbreviations of streets, buildings, quarters, floors and flats.
STREETS = {
    "rue": "rue r zankat zanqat", "avenue": "avenue av ave", "boulevard": "boulevard bd bld boul bvd blvd", "route": "route rte", "impasse": "impasse imp", "place": "place pl",
    "lotissement": "lotissement lot lotiss", "residence": "residence res resid", "allee": "allee all", "passage": "passage pass", "chemin": "chemin che chem",
}
BUILDINGS = frozenset("villa imm immeuble bloc lot parcelle batiment bat".split())
QUARTERS = frozenset("quartier qrt qt q hay qu quart".split())
FLATS = frozenset("appartement appt app apt ap etage et etg porte".split())
IGNORED = frozenset("maroc morocco de du des la le les d l".split())
REPEATED = frozenset("bis ter quater".split())
_STREET = {form: name for name, forms in STREETS.items() for form in forms.split()}
_TOKEN = re.compile(r"[^\W_]+")
_LONG_STREETS = [w for w in _STREET if len(w) > 5]
_LONG_FLATS = [w for w in FLATS if len(w) > 4]


def _words(text: str) -> list[str]:
    out = []
    for t in _TOKEN.findall(fold(text)):
        if m := re.fullmatch(r"n?(\d{1,4})(bis|ter|quater)", t):
            out += [m[1], m[2]]
        elif m := re.fullmatch(r"(\d{1,3})(?:e|er|eme)", t):
            out.append(m[1] + "e")
        elif m := re.fullmatch(r"n(?:o)?(\d{1,4})", t):
            out += ["n", m[1]]
        else:
            out.append(letters(t))
    return out


def _near(word: str, words: list[str]) -> str | None:
    return next((w for w in words if len(word) > 4 and word[0] == w[0] and osa(word, w, 1) <= 1), None)


def read(text: str) -> tuple[str, str, tuple[str, ...]]:
    """(number with its bis, street name, other words in canonical order) of an address; '' for what is missing."""
    words = _words(text)
    kept: list[str] = []
    i = 0
    while i < len(words):  # floors and flats go with their number, before or after
        w = words[i]
        following = words[i + 1] if i + 1 < len(words) else ""
        if (w in FLATS or _near(w, _LONG_FLATS)) and following[:1].isdigit() and len(following) < 4:
            i += 2
        elif re.fullmatch(r"\d{1,3}e", w) and (following in FLATS or _near(following, _LONG_FLATS)):
            i += 2
        else:
            kept.append(w)
            i += 1
    kinds = [_STREET.get(w) or _STREET.get(_near(w, _LONG_STREETS) or "") for w in kept]
    spots = [k for k, kind in enumerate(kinds) if kind and k + 1 < len(kept) and not kept[k + 1].isdigit()]
    spot = spots[0] if spots else None
    name_at = None
    if spot is not None:
        name_at = spot + 1
        while name_at + 1 < len(kept) and kept[name_at] in IGNORED:
            name_at += 1
    small = [k for k, w in enumerate(kept) if w.isdigit() and len(w) < 5]

    def number_at() -> int | None:
        before = lambda k: kept[k - 1] if k else ""
        for k in small:
            if before(k) in ("n", "no", "num", "numero"):
                return k
        for k in small:
            if before(k) in BUILDINGS:
                return k
        if name_at is not None:
            for k in small:
                if k == name_at + 1:
                    return k
            for k in reversed(small):
                if k < spot and all(w in REPEATED for w in kept[k + 1 : spot]):
                    return k
        return small[0] if small and small[0] == 0 else None

    at = number_at()
    number = "" if at is None else kept[at].lstrip("0") or "0"
    used = {name_at, spot, at} - {None}
    if at is not None and at + 1 < len(kept) and kept[at + 1] in REPEATED:
        number += kept[at + 1]
        used.add(at + 1)
    rest = [w for k, w in enumerate(kept) if k not in used and w not in QUARTERS and w not in IGNORED and w not in BUILDINGS and w not in ("n", "no", "num", "numero")]
    name = kept[name_at] if name_at is not None else rest.pop(0) if rest and not rest[0].isdigit() else ""
    return number, name, tuple(sorted(set(rest), key=lambda w: (w[0].isdigit(), w)))


_QUARTER = re.compile(r"(?:\b(?:" + "|".join(sorted(QUARTERS, key=len, reverse=True)) + r")\b[\s.]*)+([^,;/|\d–—-]*)([,;/|\d–—-]?)")


def quarter_words(text: str) -> frozenset[str]:
    """The words written as a quarter: after its sign, up to a separator or figure; the first only where none follows."""
    out: set[str] = set()
    for found, end in _QUARTER.findall(fold(text)):
        words = [letters(w) for w in _TOKEN.findall(found) if w not in IGNORED and w not in QUARTERS]
        out.update(words if end else words[:1])
    return frozenset(out)


def edits_allowed(length: int) -> int:
    return 0 if length < 4 else 1 if length < 8 else 2


def same_word(a: str, b: str) -> float:
    """Cost of writing one word for another: nothing for dictionary forms, little for a misreading, else MISMATCH."""
    if a == b or (a in _STREET and _STREET[a] == _STREET.get(b)):
        return 0.0
    if a[0].isdigit() or b[0].isdigit():
        return MISMATCH
    most = edits_allowed(min(len(a), len(b)))
    edits = osa(a, b, most)
    if edits <= most:
        return 0.25 * edits
    short, long = sorted((a, b), key=len)
    return 0.1 if len(short) > 2 and long.startswith(short) else MISMATCH


@lru_cache(maxsize=100_000)
def align(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[float, int]:
    """(cost, matched words) of the cheapest affine-gap alignment of two lists of words."""
    far = (float("inf"), 0)
    n = len(b)
    gap = lambda k: (GAP_OPEN + GAP_EXTEND * (k - 1), 0) if k else (0.0, 0)
    best = [gap(j) for j in range(n + 1)]
    up = [far] * (n + 1)
    add = lambda x, c, m=0: (x[0] + c, x[1] - m)  # matches are negative, so that min() prefers more of them
    for i, x in enumerate(a, 1):
        new, left = [gap(i)], far
        for j, y in enumerate(b, 1):
            up[j] = min(add(best[j], GAP_OPEN), add(up[j], GAP_EXTEND))
            left = min(add(new[j - 1], GAP_OPEN), add(left, GAP_EXTEND))
            c = same_word(x, y)
            new.append(min(add(best[j - 1], c - REWARD, 1) if c < MISMATCH else add(best[j - 1], c), up[j], left))
        best = new
    return best[n][0], -best[n][1]


@lru_cache(maxsize=100_000)
def likeness(a: tuple[str, ...], b: tuple[str, ...], quarter_a: frozenset[str] = frozenset(), quarter_b: frozenset[str] = frozenset()) -> float | None:
    """How much two lists of quarter, town and code words have in common; None where they oppose each other.

    A side without any word allows all, and so does a code beside words. Two different codes oppose each other. So do words
    that have no partner on either side, such as two towns, unless one side's were written as a quarter (quarter_a,
    quarter_b) and the other's weren't: then each side misses what the other has.
    """
    if not a or not b:
        return 0.0
    (words_a, code_a), (words_b, code_b) = _split(a), _split(b)
    same_code = bool(code_a and code_b)
    if same_code and osa(code_a, code_b, 1) > 1:
        return None
    if not words_a or not words_b:
        return float(same_code)
    left, right = _alone(words_a, words_b), _alone(words_b, words_a)
    if (left - quarter_a and right - quarter_b) or (left & quarter_a and right & quarter_b):
        return None
    cost, _ = align(words_a, words_b)
    if left and right and not same_code and cost > MOST_COST:
        return None
    return same_code + sum(max(0.0, 1 - min(same_word(w, x) for x in words_b)) for w in words_a)


def _alone(words: tuple[str, ...], others: tuple[str, ...]) -> frozenset[str]:
    """Words of three letters or more that no other word may stand for."""
    return frozenset(w for w in words if len(w) > 2 and all(same_word(w, x) >= MISMATCH and osa(w, x, 1) > 1 for x in others))


def agree(a: tuple[str, ...], b: tuple[str, ...], quarter_a: frozenset[str] = frozenset(), quarter_b: frozenset[str] = frozenset()) -> bool:
    """Do two lists of quarter, town and code words allow the same place? Missing parts do, opposed ones don't."""
    return likeness(a, b, quarter_a, quarter_b) is not None


def _split(rest: tuple[str, ...]) -> tuple[tuple[str, ...], str]:
    """(words, postal code or '')"""
    return tuple(w for w in rest if not w.isdigit() or len(w) != 5), next((w for w in rest if w.isdigit() and len(w) == 5), "")


def same_street(a: str, b: str, rest_a: tuple[str, ...], rest_b: tuple[str, ...], quarter_a: frozenset[str] = frozenset(), quarter_b: frozenset[str] = frozenset()) -> bool:
    """Names of streets with the same number: equal, or misread and not in opposed towns."""
    most = edits_allowed(min(len(a), len(b)))
    return a == b or (osa(a, b, most) <= most and agree(rest_a, rest_b, quarter_a, quarter_b))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch.column(0).to_pylist()
        parts = [read(v) for v in values]
        quarters = [" ".join(sorted(quarter_words(v) & set(rest))) for v, (_, _, rest) in zip(values, parts)]
        columns = [[n for n, _, _ in parts], [s for _, s, _ in parts], [" ".join(r) for _, _, r in parts], quarters]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns)], ["value", "number", "name", "rest", "quarter"])


def shingles(number: str, name: str, rest: str = "") -> list[str]:
    """The name, its q-grams of 2 and 3 letters with marked ends, and the words of quarter and town; all with the number. A word
    of the town is one shingle beside some twenty of the name, so an address without it still meets the others."""
    padded = f"^{name}$"
    grams = {padded[i : i + q] for q in (2, 3) for i in range(len(padded) - q + 1)}
    return [f"{number}|{g}" for g in (*grams, padded, *(f"^{w}$" for w in rest.split() if w != name))]


_RANDOM = np.random.default_rng(20)
_A = (_RANDOM.integers(1, 1 << 62, BANDS * ROWS, np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def bands(number: str, name: str, rest: str = "") -> list[int]:
    """One signed 64-bit bucket for each band."""
    h = np.array([xxhash.xxh3_64_intdigest(s) for s in shingles(number, name, rest)], np.uint64)
    least = (h[:, None] * _A + _B).min(axis=0)
    return [xxhash.xxh3_64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) - (1 << 63) for k in range(BANDS)]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        numbers, names, rests = (batch.column(i).to_pylist() for i in range(3))
        found = np.array([bands(*street) for street in zip(numbers, names, rests)], np.int64).reshape(-1)
        rows = pa.array(np.repeat(np.arange(len(names)), BANDS))
        yield pa.RecordBatch.from_arrays([pa.array(found), *(batch.column(i).take(rows) for i in range(5))], ["bucket", "number", "name", "rest", "quarter", "support"])


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by bucket, support and street: each street is linked to the nearest leader that one of its rests agrees
    with, or leads. Leaders keep all of their rests."""
    bucket, leaders = None, {}
    for batch in batches:
        found = {}
        for b, number, name, rest, quarter in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if b != bucket:
                bucket, leaders = b, {}
            words, own = tuple(rest.split()), frozenset(quarter.split())
            fits = [x for (n, x), rests in leaders.items() if n == number and x != name and any(same_street(x, name, r, words, q, own) for r, q in rests)]
            if fits:
                lead = min(fits, key=lambda x: (osa(x, name, 3), x))
                found[f"{number} {lead}", f"{number} {name}"] = None
            if not fits or (number, name) in leaders:
                leaders.setdefault((number, name), []).append((words, own))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.string())], ["a", "b"])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over different rests of classes, sorted by class and fullness: members that oppose each other on quarter or town part into
    places; of several places a member joins the one it has most in common with. Place -1 is for a rest that several allow alike."""
    group, leaders = None, []
    for batch in batches:
        places = []
        for g, rest, quarter in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if g != group:
                group, leaders = g, []
            words, own = tuple(rest.split()), frozenset(quarter.split())
            fits = sorted(((x, k) for k, (r, q) in enumerate(leaders) if (x := likeness(r, words, q, own)) is not None), reverse=True)
            if not fits:
                leaders.append((words, own))
            places.append(len(leaders) - 1 if not fits else fits[0][1] if len(fits) == 1 or fits[0][0] > fits[1][0] else -1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int32())], ["class", "rest", "quarter", "place"])


def address_classes(values: DataFrame, value: str = "valeur") -> DataFrame:
    """(value, place_id): every different non-blank address with an identifier of its place.

    Null and blank values give no row; repeated rows count once. Addresses without a number share a place only with others
    without one. An address whose quarter and town several places of its number and street allow, or that has none where
    there are several, is a place of its own. Extra columns are ignored. An empty table gives no rows. Of a street and
    number, the different writings of quarter and town come together in one task; the addresses themselves don't.
    """
    rows = values.select(F.col(value).cast("string").alias("value")).filter(F.col("value").rlike(r"[^\s\p{Z}]")).distinct()
    parsed = durable(spread(rows, "value").mapInArrow(_parse, "value STRING, number STRING, name STRING, rest STRING, quarter STRING"))
    # a street of several towns has a row for each: a misread name may be of any of them
    total = parsed.groupBy("number", "name").agg(F.count("*").alias("support"))
    streets = parsed.select("number", "name", "rest", "quarter").distinct().join(total, ["number", "name"])
    signed = spread(streets, "rest", "name", "number").mapInArrow(_sign, "bucket BIGINT, number STRING, name STRING, rest STRING, quarter STRING, support BIGINT")
    ordered = signed.repartition("bucket").sortWithinPartitions("bucket", F.desc("support"), "number", "name", F.desc(F.length("rest")), "rest", "quarter").drop("support")
    edges = ordered.mapInArrow(_link, "a STRING, b STRING")
    classes = consolidate(edges)
    key = F.concat_ws(" ", "number", "name")
    named = parsed.withColumn("v", key).join(classes, "v", "left").select(F.coalesce("r", "v").alias("class"), "rest", "quarter", "value")
    rests = named.select("class", "rest", "quarter").distinct()
    ordered = rests.repartition("class").sortWithinPartitions("class", F.desc(F.size(F.split("rest", " "))), F.desc(F.length("rest")), "rest", "quarter")
    placed = ordered.mapInArrow(_places, "class STRING, rest STRING, quarter STRING, place INT")
    own = F.when(F.col("place") >= 0, F.concat_ws("#", "class", "place")).otherwise(F.concat_ws("|", F.lit("?"), "value"))
    return named.join(placed, ["class", "rest", "quarter"]).select("value", own.alias("place_id"))


def class_pairs(classes: DataFrame, group: str, value: str = "value", keep: list[str] = ()) -> DataFrame:
    """(group, keep..., value_a, value_b): all pairs of different values of a group, the smaller first."""
    a = classes.select(F.col(group), *keep, F.col(value).alias("value_a"))
    b = classes.select(F.col(group), F.col(value).alias("value_b"))
    return a.join(b, group).filter("value_a < value_b")
