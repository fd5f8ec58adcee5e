import __spark_entry__ as e


def test_every_sql_has_a_query_and_names_are_distinct():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_gives_rows(spark):
    df = e.entry(spark)
    assert df.columns == ["table_nom", "ligne_id", "colonne", "motif", "periode"] and df.count() > 0


def test_nothing_outside_llm_imports_it():
    import pathlib
    import re

    root = pathlib.Path(e.__file__).parent / "tamis"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"(from|import) tamis\.llm", p.read_text()), p
