"""Empty tables, nulls, repeated rows and columns with clashing names."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cloakstone.functions import ids
from cloakstone.operators import audit, columns, conversation, detect, known, mask
from cloakstone.sources import chats, sinks
from cloakstone.sources.tables import written

KEY = ids.Key(b"0123456789abcdef0123456789abcdef")


def test_positions_and_memory_of_awkward_rows(spark):
    rows = spark.createDataFrame([(None, 0, None, None, "h"), (1, None, "user", "a", "h"), (1, 0, "user", "a", "h"), (1, 0, "user", "a", "h")], "conv int, turn int, role string, text string, position string")
    out = conversation.positions(rows, "conv", "turn")
    assert out.count() == 4 and len({r.position for r in out.where("conv = 1").collect()}) == 3
    assert conversation.positions(rows.limit(0), "conv", "turn").count() == 0
    names = conversation.memory(spark.createDataFrame([(1, "obj.table", "pens_9", 0, 0, "w")], "conv int, type string, real string, ord int, start int, word string"), "conv")
    texts = spark.createDataFrame([(1, 5, "see pens_9, PENS_9 and pens_99", "x"), (1, 6, None, None), (None, 7, "pens_9", None), (2, 8, "pens_9", None)], "conv int, ord int, text string, word string")
    got = {(r.ord, r.start, r.real) for r in conversation.remembered(texts, names, "conv", "ord").collect()}
    assert got == {(5, 4, "pens_9"), (5, 12, "PENS_9")}
    assert conversation.remembered(texts.limit(0), names, "conv", "ord").count() == 0


def test_requests_of_awkward_rows(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "[]"), (4, "{}"), (5, json.dumps({"messages": []})), (6, json.dumps({"messages": [{"role": "user", "content": None}, {"role": "user", "content": ""}]}))], "ord int, body string")
    texts, bad = chats.flatten(rows.withColumnRenamed("ord", "id"), "id")
    assert {(r.id, r.text) for r in texts.collect()} == {(6, "")} and {r.id for r in bad.collect()} == {1, 2, 3}
    assert chats.flatten(rows.withColumnRenamed("ord", "id").limit(0), "id")[0].count() == 0
    with pytest.raises(ValueError, match="ord"):
        chats.flatten(rows, "ord")


def test_people_and_columns_of_awkward_rows(spark):
    none = spark.createDataFrame([], "name string, email string, code string")
    assert known.import_people(none, KEY).count() == 0
    registry = known.import_people(spark.createDataFrame([(None, None, None), ("Rosa Prado", None, None), ("Rosa Prado", None, None)], none.schema), KEY)
    texts = spark.createDataFrame([(1, "rosa prado", "x"), (2, None, None), (None, "Rosa Prado", None)], "id int, text string, hash string")
    assert {(r.id, r.candidate) for r in known.find_people(texts, registry, KEY, "id").collect()} == {(1, "ROSA PRADO"), (None, "ROSA PRADO")}
    df = spark.createDataFrame([(None, None), ("", " ")], "nome string, cpf string")
    assert [tuple(r) for r in columns.mask_columns(df, KEY).collect()] == [(None, None), ("", " ")] and columns.mask_columns(df.limit(0), KEY).count() == 0


def test_detection_keeps_the_callers_columns(spark):
    df = spark.createDataFrame([(1, "a@stall.dev", "L", "M")], "id int, text string, _low string, _map string")
    out = mask.mask(df, KEY)
    assert out.first()._low == "L" and detect.detect(df.limit(0)).count() == 0
    masked = written(out, "masked")
    back = mask.unmask(masked.drop("edits"), mask.reverse_table(mask.mapping(masked, "id"), "id"), "id").first()
    assert (back.text, back._low, back._map) == ("a@stall.dev", "L", "M")


def test_calls_of_tools_that_carry_values_away_stay_masked(spark):
    calls = spark.createDataFrame([(1, "bash", "cat T_x"), (1, "WebFetch", "get T_x"), (1, "mcp__mail", "T_x"), (1, None, "T_x"), (2, "bash", "T_x")], "conv int, tool string, text string")
    reverse = spark.createDataFrame([(1, "T_x", "pens_9")], "conv int, pseudo string, real string")
    assert sorted((r.conv, str(r.tool), r.text) for r in mask.unmask_calls(calls, reverse, "conv").collect()) == [(1, "None", "T_x"), (1, "WebFetch", "get T_x"), (1, "bash", "cat pens_9"), (1, "mcp__mail", "T_x"), (2, "bash", "T_x")]


def test_log_and_people_are_written_and_read(spark, tmp_path):
    entries = spark.createDataFrame([(datetime(2026, 1, 2, 3, 4, 5), 200, 3, 1, None, {"cpf": 2, "name": 1}), (datetime(2026, 1, 2, 3, 5, 5), 500, 0, 0, 'no "key"', {}), (datetime(2026, 1, 3), 200, None, None, "", None)], "ts timestamp, status long, replacements long, collisions long, refused string, types map<string,int>")
    sinks.write_log(entries, f"file://{tmp_path}/log")
    log = audit.read_log(spark.read.text(f"file://{tmp_path}/log"))
    assert tuple(audit.summary(log).first()) == (3, 1, 3, 1, 1) and {(r.status, r.n) for r in audit.by_status(log).collect()} == {(200, 2), (500, 1)}
    assert [tuple(r) for r in audit.masked_by_type(log).collect()] == [("cpf", 2), ("name", 1)] and [r.refused for r in audit.refusals(log).collect()] == ["no 'key'"]
    registry = known.import_people(spark.createDataFrame([("Rosa Prado", "r@stall.dev", None)], "name string, email string, code string"), KEY)
    saved = sinks.save_people(registry, f"file://{tmp_path}/people")
    assert sorted(map(tuple, saved.collect())) == sorted(map(tuple, registry.select("kind", "hash", "person").collect()))
    assert sinks.prune_sent(spark.createDataFrame([(1, 10), (2, 70)], "id int, day int"), "day", F.lit(80)).count() == 1


def test_remembered_names_keep_their_case(spark):
    decisions = [(1, "obj.service", "lepa", 0, 0), (1, "obj.table", "Pens", 0, 9)]
    names = conversation.memory(spark.createDataFrame(decisions, "conv int, type string, real string, ord int, start int"), "conv")
    texts = spark.createDataFrame([(1, 1, "lepa Lepa LEPA pens Pens PENS")], "conv int, ord int, text string")
    got = sorted((r.start, r.type, r.real) for r in conversation.remembered(texts, names, "conv", "ord").collect())
    assert got == [(0, "obj.service", "lepa"), (15, "obj.table", "pens"), (20, "obj.table", "Pens"), (25, "obj.table", "PENS")]
