"""Nested JSON records into flat tables that keep their parent and child positions.

Each record is decoded once and walked as a stream of (path, ordinals, value) triples, the triples are grouped by
their repeated ancestor and every group becomes one row. All triples of a record arise in one task, one record
after the other, so the grouping needs no shuffle and holds one object at a time. A record is decoded whole: one that is
cut off must give no row at all, and of members with the same name the last counts, so no row is sure before the end.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = "record_id BIGINT, niveau STRING, pos1 INT, pos2 INT, pos3 INT, vals MAP<STRING,STRING>"
_ARROW = pa.schema([("record_id", pa.int64()), ("niveau", pa.string()), ("pos1", pa.int32()), ("pos2", pa.int32()), ("pos3", pa.int32()), ("vals", pa.map_(pa.string(), pa.string()))])
_FLUSH = 4096


@dataclass(frozen=True)
class Level:
    """A repeated ancestor: the first of `sources` in the parent that isn't null, if the parent has `when`."""

    name: str
    sources: tuple[str, ...]
    when: tuple[str, str] | None = None
    children: tuple["Level", ...] = field(default=())

    def reaches(self, wanted: frozenset[str] | None) -> bool:
        """Is this level wanted, or one below it?"""
        return wanted is None or self.name in wanted or any(c.reaches(wanted) for c in self.children)


#: Dossier payloads: documents, their fields, and the transactions of the field of that name.
DOSSIER = Level("document", ("documents",), children=(Level("field", ("fields",), children=(Level("transaction", ("normalized_value", "raw_value"), when=("field_name", "transactions")),)),))


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _utf8(text: str) -> str:
    return text.encode("utf-8", "replace").decode("utf-8") if re.search("[\ud800-\udfff]", text) else text


def parse(payload: str | None) -> object:
    """The JSON value, or None where the payload isn't valid JSON (NaN and Infinity aren't)."""
    if payload is None:
        return None
    try:
        return json.loads(payload, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return None


def _text(value: object) -> str | None:
    if value is None:
        return None
    return _utf8(value) if isinstance(value, str) else json.dumps(value, ensure_ascii=True)


def triples(obj: dict, level: Level, ordinals: tuple[int, ...] = (), wanted: frozenset[str] | None = None) -> Iterator[tuple[str, tuple[int, ...], str | None, str | None]]:
    """(level, ordinals, path below the repeated ancestor, value) of every leaf under one level of a parent.

    Each object first gives a triple with an empty path, so that an object without members still gives a row.
    A single object stands for a list of one; elements that aren't objects count in the ordinals only. The member that
    the objects of a level below are taken from gives no leaf of its own; its other sources do. Of levels that aren't wanted
    nothing is read but what the way to a wanted one needs.
    """
    if not level.reaches(wanted):
        return
    if level.when and obj.get(level.when[0]) != level.when[1]:
        return
    found = next((obj[s] for s in level.sources if obj.get(s) is not None), None)
    for i, item in enumerate([found] if isinstance(found, dict) else found if isinstance(found, list) else (), 1):
        if not isinstance(item, dict):
            continue
        at = (*ordinals, i)
        if wanted is None or level.name in wanted:
            yield level.name, at, "", None
            yield from ((level.name, at, path, value) for path, value in _leaves(item, level))
        for child in level.children:
            yield from triples(item, child, at, wanted)


def _leaves(item: dict, level: Level) -> Iterator[tuple[str, str | None]]:
    """(dotted path, value) of the leaves of an object that don't belong to a level below."""
    used = [next((s for s in c.sources if item.get(s) is not None), None) for c in level.children if not c.when or item.get(c.when[0]) == c.when[1]]
    below = {s for s in used if isinstance(item.get(s), (dict, list))}
    stack = [("", item)]
    while stack:
        prefix, node = stack.pop()
        for key, value in node.items():
            if not prefix and key in below:
                continue
            if isinstance(value, dict):
                stack.append((f"{prefix}{key}.", value))
            else:
                yield _utf8(prefix + key), _text(value)


def rows(record: object, level: Level, wanted: frozenset[str] | None = None) -> Iterator[tuple[str, tuple[int, ...], dict[str, str | None]]]:
    """One row for each repeated ancestor: its triples pivoted into one mapping."""
    if isinstance(record, dict):
        for (name, at), group in groupby(triples(record, level, (), wanted), key=lambda t: t[:2]):
            yield name, at, {path: value for _, _, path, value in group if path}


def _run(level: Level, wanted: frozenset[str] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for record_id, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                for name, at, vals in rows(parse(payload.as_py()), level, wanted):
                    out.append((record_id, name, *(*at, 0, 0)[:3], list(vals.items())))
                    if len(out) >= _FLUSH:
                        yield _batch(out)
                        out = []
        if out:
            yield _batch(out)

    return run


def _batch(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _ARROW)], schema=_ARROW)


def shred(df: DataFrame, record_id: str = "raw_id", payload: str = "payload", level: Level = DOSSIER, wanted: tuple[str, ...] | None = None) -> DataFrame:
    """One row for each object of every level, or of the wanted ones: positions of it and its ancestors (0 below its level) and its leaves.

    Null, empty, cut-off and otherwise invalid payloads, and payloads whose root isn't an object, give no rows.
    A row with a null id gives rows with a null id; repeated ids give the rows of each payload. Other columns are
    ignored. Members of the same name: the last counts. Nested objects get dotted paths, other lists JSON text.
    """
    return df.select(F.col(record_id).cast("bigint"), F.col(payload).cast("string")).mapInArrow(_run(level, None if wanted is None else frozenset(wanted)), ROWS)


def write_levels(shredded: DataFrame, path: str) -> dict[str, DataFrame]:
    """The rows of every level, written below `path` by level in one pass over the records; the tables that were written, by level."""
    shredded.write.mode("overwrite").partitionBy("niveau").parquet(path)
    written = shredded.sparkSession.read.schema(shredded.schema).parquet(path)
    return {r.niveau: written.filter(F.col("niveau") == r.niveau) for r in written.select("niveau").distinct().collect()}


def level_table(shredded: DataFrame, niveau: str, positions: list[str], columns: dict[str, str], rest: str | None = None) -> DataFrame:
    """The flat table of one level; columns: output name to path. Paths that are absent come out null. `rest` names a column for
    a map of all other paths."""
    others = [F.map_filter("vals", lambda k, _: ~k.isin(*columns.values())).alias(rest)] if rest else []
    return shredded.filter(F.col("niveau") == niveau).select(
        "record_id", *(F.col(f"pos{i}").alias(p) for i, p in enumerate(positions, 1)), *(F.col("vals")[path].alias(name) for name, path in columns.items()), *others
    )
