import datetime as dt

import pytest

from tamis.operators.orphans import Reference, orphans, reference_rows, target_rows

T = lambda m, d=1: dt.datetime(2025, m, d)
REFS = (Reference("child", "parent_id", "id", "parent", "pid"),)


def tables(spark, children, parents):
    return {
        "child": spark.createDataFrame(children, "id STRING, parent_id STRING, loaded_at TIMESTAMP, cle STRING"),
        "parent": spark.createDataFrame(parents, "pid STRING, loaded_at TIMESTAMP, supprime_at TIMESTAMP, cible STRING"),
    }


def run(spark, children, parents, **kw):
    t = tables(spark, children, parents)
    return sorted(tuple(r) for r in orphans(reference_rows(t, REFS), target_rows(t, REFS), **kw).collect())


CHILDREN = [
    ("a", "P1", T(3), "x"), ("b", "P2", T(3), "x"), ("c", "P3", T(3), "x"), ("d", "none", T(4), "x"), ("d", "none", T(5), "x"), ("e", None, T(3), "x"), ("f", "   ", T(3), "x"), ("g", "DOSSIER_UNKNOWN", T(3), "x"),
    ("h", "P3", T(6), "x"), ("h", "P3", T(7), "x"), ("i", "p1", T(3), "x"), ("j", "none", None, "x"), (None, "none", T(4), "x"), ("k", "P3", T(6), "x"), ("k", "P3", T(3), "x"),
]
PARENTS = [("P1", T(1), None, "x"), ("P2", T(1), T(9), "x"), ("P3", T(5), None, "x"), ("P3", T(8), None, "x"), (None, T(1), None, "x")]
EXPECTED = [
    ("child", "b", "parent_id", "SUPPRIME", "2025-03"), ("child", "c", "parent_id", "TARDIF", "2025-03"), ("child", "d", "parent_id", "ABSENT", "2025-04"), ("child", "i", "parent_id", "ABSENT", "2025-03"),
    ("child", "k", "parent_id", "TARDIF", "2025-03"), ("child", None, "parent_id", "ABSENT", "2025-04"), ("child", "j", "parent_id", "ABSENT", None),
]


@pytest.mark.parametrize("heavy_rows", [1, 2, 10_000])
def test_all_reasons_by_broadcast_and_by_shuffle(spark, heavy_rows):
    key = lambda r: tuple(str(x) for x in r)
    got = tables(spark, CHILDREN, PARENTS)
    for few_keys in (0, 100):
        rows = orphans(reference_rows(got, REFS), target_rows(got, REFS), heavy_rows=heavy_rows, few_keys=few_keys).collect()
        assert sorted(map(key, rows)) == sorted(map(key, EXPECTED))


def test_list_of_heavy_keys_is_bounded(spark):
    from tamis.operators.orphans import heavy_keys

    t = tables(spark, [(str(i), f"K{i % 20}", T(1), "x") for i in range(200)], [])
    assert heavy_keys(reference_rows(t, REFS), heavy=3, heavy_rows=1).count() == 3
    assert len(run(spark, [(str(i), f"K{i % 20}", T(1), "x") for i in range(200)], [], heavy=3, heavy_rows=1, few_keys=2)) == 200


def test_empty_tables(spark):
    assert run(spark, [], PARENTS) == []
    assert run(spark, [("a", "P1", T(3), "x")], []) == [("child", "a", "parent_id", "ABSENT", "2025-03")]
