import json

from tamis.operators.shred import DOSSIER, level_table, parse, rows, shred


def found(payload):
    return [(n, at, v) for n, at, v in rows(parse(payload), DOSSIER)]


def test_positions_count_elements_that_are_not_objects():
    p = json.dumps({"documents": [1, {"doc_id": "A", "fields": [None, {"field_name": "x"}, "s", {"field_name": "y"}]}, []]})
    assert [(n, at) for n, at, _ in found(p)] == [("document", (2,)), ("field", (2, 2)), ("field", (2, 4))]


def test_single_object_is_a_list_of_one_and_lists_may_be_empty_or_absent():
    assert [(n, at) for n, at, _ in found('{"documents": {"doc_id": "A", "fields": {"field_name": "f"}}}')] == [("document", (1,)), ("field", (1, 1))]
    assert found('{"documents": []}') == found("{}") == found('{"documents": null}') == found('{"documents": "text"}') == []


def test_transactions_come_from_the_normalised_value_else_the_raw_one():
    f = lambda **x: json.dumps({"documents": [{"fields": [{"field_name": "transactions", **x}]}]})
    labels = lambda p: [v.get("libelle") for n, _, v in found(p) if n == "transaction"]
    assert labels(f(normalized_value=[{"libelle": "a"}], raw_value=[{"libelle": "b"}])) == ["a"]
    assert labels(f(normalized_value=None, raw_value={"libelle": "b"})) == ["b"]
    assert labels(f(raw_value=[{"libelle": "b"}, 3, {}])) == ["b", None]
    assert labels(f(normalized_value="text", raw_value=[{"libelle": "b"}])) == []
    assert labels(f(normalized_value=[{"libelle": "a"}]).replace("transactions", "other")) == []


def test_invalid_payloads_give_no_rows():
    for p in (None, "", " ", '{"documents": [', '{"documents": [{"a": NaN}]}', "[1, 2]", "3", "{'a': 1}", "[" * 200_000):
        assert found(p) == []


def test_leaves_keep_types_as_text_and_nested_objects_get_paths():
    p = json.dumps({"documents": [{"doc_id": 7, "ok": True, "empty": None, "c": {"s": "x", "d": {"e": 1.5}}, "box": [1, 2], "u": "é\ud800"}]})
    (_, _, v), = found(p)
    assert v == {"doc_id": "7", "ok": "true", "empty": None, "c.s": "x", "c.d.e": "1.5", "box": "[1, 2]", "u": "é?"}


def test_member_that_occurs_twice_counts_last():
    (_, _, v), = found('{"documents": [{"doc_id": "a", "doc_id": "b"}]}')
    assert v["doc_id"] == "b"


def test_table_with_nulls_repeats_and_clashing_columns(spark):
    p = json.dumps({"documents": [{"doc_id": "A", "fields": [{"field_name": "n", "raw_value": "v" * 100_000}]}]})
    df = spark.createDataFrame([(1, p, "x"), (1, p, "y"), (None, p, "z"), (2, None, None)], "raw_id BIGINT, payload STRING, niveau STRING")
    out = shred(df)
    assert sorted((r.record_id or 0, r.niveau) for r in out.collect()) == sorted([(1, "document"), (1, "field")] * 2 + [(0, "document"), (0, "field")])
    t = level_table(out, "field", ["doc_pos", "field_pos"], {"raw": "raw_value", "absent": "nothing"}).filter("record_id IS NULL").collect()
    assert [(r.doc_pos, r.field_pos, len(r.raw), r.absent) for r in t] == [(1, 1, 100_000, None)]
    assert shred(df.limit(0)).count() == 0


def test_source_that_is_not_used_and_other_leaves_are_kept(spark):
    f = {"field_name": "transactions", "normalized_value": [{"libelle": "a", "ocr_confidence": 0.5, "detail": {"x": 1}}], "raw_value": [{"libelle": "A"}], "validation_messages": ["m"]}
    p = json.dumps({"documents": [{"doc_id": "D", "extraction_validation": {"ok": True}, "fields": [f, {"field_name": "transactions", "normalized_value": "text", "raw_value": [{"libelle": "b"}]}]}]})
    out = shred(spark.createDataFrame([(1, p)], "raw_id BIGINT, payload STRING"))
    of = lambda *a: level_table(out, *a, rest="others").orderBy("record_id", *a[1]).collect()
    assert [(r.raw, r.others) for r in of("field", ["doc_pos", "field_pos"], {"name": "field_name", "raw": "raw_value"})] == [('[{"libelle": "A"}]', {"validation_messages": '["m"]'}), ('[{"libelle": "b"}]', {"normalized_value": "text"})]
    assert [(r.l, r.others) for r in of("transaction", ["a", "b", "c"], {"l": "libelle"})] == [("a", {"ocr_confidence": "0.5", "detail.x": "1"})]
    assert [r.others for r in of("document", ["a"], {"doc_id": "doc_id"})] == [{"extraction_validation.ok": "true"}]


def test_registered_tables_have_all_leaves(spark, tmp_path):
    import __spark_entry__ as e

    p = json.dumps({"documents": [{"doc_id": "D", "v": 1, "fields": [{"field_name": "transactions", "w": 2, "raw_value": [{"libelle": "a", "x": 3}]}]}]})
    spark.createDataFrame([(1, p)], "raw_id BIGINT, payload STRING").write.parquet(str(tmp_path / "dossier_brut.parquet"))
    got = [e.queries()[n](spark, str(tmp_path)).first().others for n in ("p2_documents_all", "p2_fields", "p2_transactions_all")]
    assert got == [{"v": "1"}, {"w": "2"}, {"x": "3"}]


def test_wanted_levels_are_those_of_all_levels(spark, tmp_path):
    from tamis.operators.shred import shred, write_levels

    payloads = ['{"documents": [{"doc_id": "a", "fields": [{"field_name": "transactions", "raw_value": [{"libelle": "x"}, 3]}, {"field_name": "y"}]}, 7]}', '{"documents": {"doc_id": "b"}}', "{", None]
    df = spark.createDataFrame(list(enumerate(payloads)), "raw_id BIGINT, payload STRING")
    rows = lambda d: sorted((r.record_id, r.niveau, r.pos1, r.pos2, r.pos3, sorted(r.vals.items())) for r in d.collect())
    whole = rows(shred(df))
    assert len(whole) == 5
    written = write_levels(shred(df), str(tmp_path / "levels"))
    for level in ("document", "field", "transaction"):
        own = [r for r in whole if r[1] == level]
        assert own and rows(shred(df, wanted=(level,))) == own and rows(written[level]) == own
