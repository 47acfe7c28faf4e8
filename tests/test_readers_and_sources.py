import json
import random
import time

import pytest
from pyspark.sql import functions as F

from cloakstone.catalog_readers import CASES
from cloakstone.operators import audit, conversation
from cloakstone.operators.mask import _replace, restore
from cloakstone.readers.fields import describe, recovery_phrase
from cloakstone.readers.stage import find_names, read_names, visible
from cloakstone.sources import chats
from cloakstone.streaming.events import Answer, unmask_answers
from cloakstone.streaming.unmask import Chunks, unmask_stream, windowed_audit

NOTHING = [
    "please select one item of the menu", "update your notes and set an alarm", "from dataclasses import dataclass\nwith open(path) as f:\n    rows = f.read()", "use the query editor when you create tables", "user = current_user()\ndb = open_db()",
    "p=1;q=2;r=3", "host=localhost user=admin", "for (k=0; k<m; k++) { u=v; }", "title,year,city\nDune,1965,Rome\n", "| Flag | Meaning |\n|---|---|\n| v | verbose |\n", "host: localhost\nport: 80\nuser: guest\ndebug: false\n",
    "host: ${HOST}\nuser: {{ .Values.owner }}\n", "host: api.openai.com\nendpoint: https://example.org/v1\n", "user_limit: 12\nserver_port: 9090\n", "    user = models.CharField(max_length=3)\n    host = this.host\n", "c = open_conn(host=the_host, user=the_user)\n",
    "def g(host: str, db: str = None):\n", "see https://github.com/python/cpython/pull/1", "http://localhost:3000/ and http://127.0.0.1", "/home/runner/a and /home/user/.cache", "a module of this kind is rare\n", "SELECT tablename FROM pg_tables", "delete the rows you do not need from the list",
]


@pytest.mark.parametrize("rule", CASES)
def test_reader(rule):
    text, expected = CASES[rule]
    filled = lambda x: x.replace("{k4}", "1007").replace("{k}", "7")
    text = filled(text)
    found = find_names(text, (rule,))
    assert {(t, filled(n)) for t, n in expected} == {(f[2], f[3]) for f in found}
    assert all(text[f[0] : f[1]] == f[3] for f in found)


@pytest.mark.parametrize("text", NOTHING)
def test_no_names(text):
    assert find_names(text) == []


def test_names_far_into_a_text_and_behind_escapes():
    line = "host: db-x-1.interno\n"
    text = "".join(f"note {i} about nothing\n" for i in range(6000))
    for at in (0, 47_000, 90_000, len(text)):
        at = text.rfind("\n", 0, at) + 1
        got = find_names(text[:at] + line + text[at:], ("key-value",))
        assert [(f[0], f[3]) for f in got] == [(at + 6, "db-x-1.interno")]
    assert [(f[0], f[3]) for f in find_names("\x1b[32mhost:\x1b[0m db-x-1.interno", ("key-value",))] == [(15, "db-x-1.interno")]


def test_a_header_holds_for_its_whole_table():
    n = 6000
    catalog = "table_schema,table_name,column_name\n" + "".join(f"herd_{i % 9},ewes_{i},wool_g{i}\n" for i in range(n))
    assert len(catalog) > 150_000 and len({f[3] for f in find_names(catalog, ("table",)) if f[2] == "obj.table"}) == n
    people = "login\tsetor\n" + "".join(f"QX{i}Z\tsul\n" for i in range(20_000))
    assert len({f[3] for f in find_names(people, ("delimited",)) if f[2] == "user"}) == 20_000
    manifest = "apiVersion: v1\nkind: Config\nitems:\n" + "".join(f"- namespace: fold-{i}\n" for i in range(5000))
    assert len({f[3] for f in find_names(manifest, ("devops-yaml",))}) == 5000
    query = "SELECT " + ", ".join(f"wool_g{i}" for i in range(4000)) + " FROM herd_7.ewes_7 WHERE " + " AND ".join(f"shorn_{i} = 1" for i in range(4000))
    assert {"herd_7", "ewes_7", "wool_g3999", "shorn_3999"} <= {f[3] for f in find_names(query, ("sql",))}
    line = "error: " + "x " * 3000 + 'relation "herd_9.rams_9" does not exist'
    assert {f[3] for f in find_names(line, ("error",))} == {"herd_9", "rams_9"}
    block = 'resource "aws_sqs_queue" "q" {\n' + "".join(f"  tag{i} = 1\n" for i in range(900)) + '  name = "shear-9"\n}\n'
    assert {f[3] for f in find_names(block, ("terraform",))} == {"shear-9"}


LAYOUTS = {
    "frame": "   table_name  table_schema\n0  ewe_pens7   fold_north7\n1     rams_7  fold_south7\n",
    "short frame": "   table_name  table_schema\n0  ewe_pens7   fold_north7\n..       ...           ...\n9     rams_7  fold_south7\n\n[10 rows x 2 columns]\n",
    "box": "┌────────────┬──────────────┐\n│ table_name ┆ table_schema │\n│ ---        ┆ ---          │\n│ str        ┆ str          │\n╞════════════╪══════════════╡\n│ ewe_pens7  ┆ fold_north7  │\n│ rams_7     ┆ fold_south7  │\n└────────────┴──────────────┘\n",
    "tibble": "# A tibble: 2 × 2\n  table_name table_schema\n  <chr>      <chr>\n1 ewe_pens7  fold_north7\n2 rams_7     fold_south7\n",
    "html": "<TABLE><tr class=h><th>table_name</th><th><b>table_schema</b></th></tr>\n<tr><td>ewe_pens7</td><td> fold_north7 </td></tr><tr><td>rams_7</td><td>fold_south7</td></tr></TABLE>",
    "tuples": "('table_name', 'table_schema')\n('ewe_pens7', 'fold_north7')\n('rams_7', 'fold_south7')\n",
    "list of lists": '[["table_name","table_schema"],["ewe_pens7","fold_north7"],["rams_7","fold_south7"]]',
    "records": "-[ RECORD 1 ]+------------\ntable_name   | ewe_pens7\ntable_schema | fold_north7\n-[ RECORD 2 ]+------------\ntable_name   | rams_7\ntable_schema | fold_south7\n",
    "rows": "********** 1. row **********\n  table_name: ewe_pens7\ntable_schema: fold_north7\n********** 2. row **********\n  table_name: rams_7\ntable_schema: fold_south7\n",
    "semicolons": "table_name;table_schema\r\newe_pens7;fold_north7\r\nrams_7;fold_south7\r\n",
    "quoted commas": 'note,table_name,table_schema\n"a, b",ewe_pens7,fold_north7\n"c, d","rams_7","fold_south7"\n',
    "bars": "| table_name | table_schema |\n|:--|--:|\n| `ewe_pens7` | fold_north7 |\n| rams_7 | fold_south7 |\n",
    "dashes": "table_name           table_schema\n-------------------- ------------\newe_pens7            fold_north7\nrams_7               fold_south7\n\n(2 rows affected)\n",
    "fixed width": "TABLE_NAME    TABLE_SCHEMA\newe_pens7     fold_north7\nrams_7        fold_south7\n",
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_table_layouts(layout):
    want = {("obj.table", "ewe_pens7"), ("obj.schema", "fold_north7"), ("obj.table", "rams_7"), ("obj.schema", "fold_south7")}
    text = "the result:\n\n" + LAYOUTS[layout] + "\nthat was all, thanks\n"
    found = find_names(text, ("table",))
    assert {(f[2], f[3]) for f in found} == want and all(text[f[0] : f[1]] == f[3] for f in found)


def test_tables_of_names_and_types():
    for text in ("+---------+--------------+\n| Field   | Type         |\n+---------+--------------+\n| wool_g7 | decimal(9,2) |\n| ewe_no7 | int          |\n", "name    | type   | null?\n--------+--------+------\nwool_g7 | NUMBER | N\newe_no7 | BIGINT | Y\n"):
        assert {(f[2], f[3]) for f in find_names(text, ("table",))} == {("obj.column", "wool_g7"), ("obj.column", "ewe_no7")}
    assert find_names("name | type | size\nApple | fruit | big\nLeek | plant | long\n") == []


def test_personal_tables():
    both = {("cpf", "314.159.265-90"), ("name", "Rosa Prado"), ("cpf", "529.982.247-25"), ("name", "Davi de Melo")}
    for text in (
        "nome completo  cpf             setor\nRosa Prado     314.159.265-90  sul\nDavi de Melo   529.982.247-25  norte\n", "<tr><th>nome</th><th>cpf</th></tr><tr><td>Rosa Prado</td><td>314.159.265-90</td></tr><tr><td>Davi de Melo</td><td>529.982.247-25</td></tr>",
        "| cpf | titular |\n|---|---|\n| 314.159.265-90 | Rosa Prado |\n| 529.982.247-25 | Davi de Melo |\n", "[('nome', 'cpf'), ('Rosa Prado', '314.159.265-90'), ('Davi de Melo', '529.982.247-25')]",
    ):
        assert {(f[2], f[3]) for f in find_names(text, ("delimited",))} == both, text
    assert {(f[2], f[3]) for f in find_names("12,Rosa Prado,rosa@stall.dev\n", ("names-in-line",))} == {("name", "Rosa Prado")}
    assert find_names("12,Rosa Prado,blue\nPaid, World Cup, yes\n", ("names-in-line", "delimited")) == []


MORE = [
    ("WITH recent_x1 AS (SELECT gate_n1 FROM dock.crates_1), last_x2 AS (SELECT 1 FROM recent_x1) SELECT * FROM recent_x1 JOIN last_x2 z ON z.gate_n1 = recent_x1.gate_n1", {("schema", "dock"), ("table", "crates_1"), ("column", "gate_n1")}),
    ("helm upgrade --install barge-r7 ./c -n pier-7", {("service", "barge-r7"), ("namespace", "pier-7")}), ("group = 'net.dockco7.ferry7'\nversion = '1'\n", {("package", "dockco7"), ("package", "ferry7")}),
    ("    at net.dockco.tolls.FerryClerk.countFares(FerryClerk.java:9)\n", {("package", "dockco"), ("package", "tolls"), ("package", "FerryClerk"), ("procedure", "countFares")}), ("jdbc:oracle:thin:clerk_7/pw@wharf-7:1521/TOLLS7", {("user", "clerk_7"), ("server", "wharf-7"), ("database", "TOLLS7")}),
]


@pytest.mark.parametrize("text,names", MORE)
def test_names_of_other_shapes(text, names):
    assert {(f[2][4:], f[3]) for f in find_names(text)} == names


def test_long_lines_take_linear_time():
    for unit in ("a=b ", "SELECT ", "host=", "/home/a/", "x.y.", '"a": ', "((((", "<a>"):
        began = time.process_time()
        find_names(unit * (40_000 // len(unit)))
        assert time.process_time() - began < 12, unit


def test_transport():
    text = json.dumps({"t": 'a: 1\nqueue: fila-9\n# "x"\n'})
    assert {(f[2], f[3], text[f[0] : f[1]]) for f in find_names(text, ("key-value",))} == {("obj.queue", "fila-9", "fila-9")}
    text = "  1\ta: b\n  2\tbucket: bkt-77\n"
    assert [(f[3], text[f[0] : f[1]]) for f in find_names(text, ("key-value",))] == [("bkt-77", "bkt-77")]
    assert visible("plain\ntext") == ("plain\ntext", None)


def test_codes_phrases_and_fields():
    words = [f"w{chr(97 + i // 676 % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}" for i in range(2048)]
    phrase = [words[0]] * 11
    good = next(w for w in words if list(recovery_phrase(" ".join([*phrase, w]), words)))
    text = "so: " + " ".join([*phrase, good]) + " end"
    assert [(text[n.start : n.end].split()[-1], n.entity) for n in recovery_phrase(text, words)] == [(good, "=secret")]
    assert sum(bool(list(recovery_phrase(" ".join([*phrase, w]), words))) for w in words[:256]) <= 32
    assert describe("nome;cpf;status\n1;2;3") == [("nome", "name_loose"), ("cpf", "cpf"), ("status", "")]
    assert describe('{"login": "x", "size": 3}') == [("login", "user"), ("size", "")]


def test_restoring_in_json_and_in_known_networks():
    pairs = {"T_a": 'q"r', "242.1.2.9": "10.5.6.9"}
    assert restore('{"x": "T_a", "y": "242.1.2.77 241.1.2.3"}', pairs, in_json=True) == '{"x": "q\\"r", "y": "10.5.6.77 241.1.2.3"}'


def test_stage(spark):
    df = spark.createDataFrame([(1, "queue: fila-9\n"), (2, None), (3, "x")], "id int, text string")
    assert {r.id: [(n.type, n.real) for n in r.names] for r in read_names(df).collect()} == {1: [("obj.queue", "fila-9")], 2: [], 3: []}


def test_chat_shapes(spark):
    bodies = {
        "messages": {"system": "s", "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": [{"type": "text", "text": "a"}, {"type": "tool_use", "id": "t", "name": "bash", "input": {"command": "ls"}}]}, {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t", "content": "out"}]}]},
        "completions": {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "q"}, {"role": "assistant", "content": "a", "tool_calls": [{"id": "t", "function": {"name": "bash", "arguments": "ls"}}]}, {"role": "tool", "tool_call_id": "t", "content": "out"}]},
        "responses": {"instructions": "s", "input": [{"role": "user", "content": "q"}, {"role": "assistant", "content": [{"type": "output_text", "text": "a"}]}, {"type": "function_call", "call_id": "t", "name": "bash", "arguments": "ls"}, {"type": "function_call_output", "call_id": "t", "output": "out"}]},
        "contents": {"systemInstruction": {"parts": [{"text": "s"}]}, "contents": [{"role": "user", "parts": [{"text": "q"}]}, {"role": "model", "parts": [{"text": "a"}, {"functionCall": {"id": "t", "name": "bash", "args": {"command": "ls"}}}]}, {"role": "user", "parts": [{"functionResponse": {"id": "t", "name": "bash", "response": {"o": "out"}}}]}]},
    }
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in bodies.items()] + [("bad", "{")], "conv string, body string")
    rows, bad = chats.flatten(df, "conv")
    want = [("system", "s"), ("user", "q"), ("assistant", "a"), ("assistant", "ls"), ("tool", "out")]
    for k in bodies:
        assert [(r.role, r.text) for r in rows.where(F.col("conv") == k).orderBy("ord").collect()] == want, k
    assert [r.conv for r in bad.collect()] == ["bad"]
    joined = conversation.calls_and_results(rows, "conv").collect()
    assert len(joined) == 4 and {(r.call_tool, r.call_text) for r in joined} == {("bash", "ls")}


def test_files(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"type":"user","message":{"role":"user","content":"oi"},"timestamp":"2026-01-02T03:04:05Z"}\nnot json\n\n')
    good, bad = chats.read_transcript(spark, str(tmp_path / "s.jsonl"))
    assert [(r.role, json.loads(r.content)) for r in good.collect()] == [("user", "oi")] and bad.count() == 1
    (tmp_path / "p.csv").write_text("﻿cod,nome,mail,cod2,nome2\nU1,Ana Lima / X,a@b.c,U2,Beto\n,,,,\n")
    people = chats.read_people(spark, str(tmp_path / "p.csv"), [("cod", "nome", "mail"), ("cod2", "nome2", "none")], "/")
    assert {tuple(r) for r in people.collect()} == {("Ana Lima", "a@b.c", "U1"), ("X", "a@b.c", "U1"), ("Beto", None, "U2")}
    (tmp_path / "l.log").write_text("2026/01/02 03:04:05 request status=200 replacements=3 collisions=1 types=cpf:2,name:1\n2026/01/02 03:05:05 refused=\"no key\"\nrest\n")
    log = audit.read_log(spark.read.text(str(tmp_path / "l.log")))
    assert tuple(audit.summary(log).first()) == (1, 0, 3, 1, 1)
    assert [tuple(r) for r in audit.masked_by_type(log).collect()] == [("cpf", 2), ("name", 1)]


PAIRS = {"CPF-o5c4344k": "529", "CPF-o5c4344kx": "zz", "p.ab@d1.invalid": "q@r", "T_n7": "tb"}


def test_chunks_at_every_cut():
    rng = random.Random(1)
    for _ in range(800):
        text = "".join(rng.choice([*PAIRS, "C", "p.", "x", "T_n", "CPF-o5", ". "]) for _ in range(rng.randint(0, 8)))
        c, out, i = Chunks(PAIRS), "", 0
        while i < len(text):
            n = rng.randint(1, 5)
            out += c.push(text[i : i + n])
            i += n
        assert out + c.close() == _replace(text, PAIRS)


def cut(rng, text):
    out, i = [], 0
    while i < len(text):
        n = rng.randint(1, 5)
        out.append(text[i : i + n])
        i += n
    return out


SHAPED = {
    "messages": (lambda x: {"type": "content_block_delta", "index": 0, "delta": {"type": "text_delta", "text": x}}, {"type": "content_block_stop", "index": 0}), "completions": (lambda x: {"choices": [{"index": 0, "delta": {"content": x}}]}, {"choices": [{"index": 0, "delta": {}, "finish_reason": "stop"}]}),
    "responses": (lambda x: {"type": "response.output_text.delta", "item_id": "i", "content_index": 0, "delta": x}, {"type": "response.completed"}), "contents": (lambda x: {"candidates": [{"content": {"parts": [{"text": x}]}}]}, {"candidates": [{"content": {"parts": []}, "finishReason": "STOP"}]}),
}


@pytest.mark.parametrize("shape", SHAPED)
def test_answers_at_every_cut(shape):
    rng, (make, end) = random.Random(3), SHAPED[shape]
    for _ in range(200):
        text = "".join(rng.choice([*PAIRS, "C", "p.", "x", "T_n", "CPF-o5", ". "]) for _ in range(rng.randint(0, 8)))
        answer, out = Answer(PAIRS), ""
        for e in [*map(make, cut(rng, text)), end]:
            for line in answer.push(json.dumps(e)).split("\n"):
                out += "".join(p.holder[p.key] for p in chats.pieces(json.loads(line))[0])
        assert out == _replace(text, PAIRS)


def test_answers_whole_values_arguments_and_ends():
    a = Answer({"T_n7": 'a"b'})
    assert json.loads(a.push(json.dumps({"type": "response.output_text.done", "item_id": "i", "text": "T_n7"})))["text"] == 'a"b'
    got = [a.push(json.dumps({"type": "content_block_delta", "index": 1, "delta": {"type": "input_json_delta", "partial_json": x}})) for x in ('{"q": "T_', 'n7"}')]
    assert json.loads("".join(json.loads(x)["delta"]["partial_json"] for x in got)) == {"q": 'a"b'}
    assert a.push("[DONE]") == "[DONE]" and a.push("3") == "3"


def test_answers_as_a_stream_out_of_order(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    make, end = SHAPED["completions"]
    events = [json.dumps(e) for e in [*map(make, cut(random.Random(5), "case CPF-o5c4344k and T_n7 end")), end]]
    order = list(range(len(events)))
    random.Random(2).shuffle(order)
    for part in (order[:4], order[4:]):
        spark.createDataFrame([("s", i, events[i]) for i in part], "stream string, seq long, event string").coalesce(1).write.mode("append").parquet(str(source))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = spark.readStream.schema("stream string, seq long, event string").option("maxFilesPerTrigger", 1).parquet(str(source))
    q = unmask_answers(rows, PAIRS).writeStream.format("memory").queryName("answers").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    lines = "\n".join(r.event for r in spark.table("answers").orderBy("seq").collect()).split("\n")
    assert "".join(p.holder[p.key] for x in lines for p in chats.pieces(json.loads(x))[0]) == "case 529 and tb end"


def test_requests_are_written_back_or_not_at_all(spark):
    body = {"model": "m", "max_tokens": 5, "system": [{"type": "text", "text": "s", "cache_control": {"type": "x"}}], "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": [{"type": "thinking", "thinking": "t", "signature": "z"}, {"type": "tool_use", "id": "i", "name": "n", "input": {"a": ["x", {"b": "y"}]}}]}]}
    df = spark.createDataFrame([(1, json.dumps(body)), (2, "{"), (3, json.dumps(body))], "id int, body string")
    rows, _ = chats.flatten(df, "id")
    new = rows.where("id <> 3 or ord > 0").withColumn("text", F.upper("text"))
    got = {r.id: r.body for r in chats.rewrite(df, new, "id").collect()}
    body["system"][0]["text"], body["messages"][0]["content"] = "S", "Q"
    body["messages"][1]["content"][1]["input"] = {"a": ["X", {"b": "Y"}]}
    assert json.loads(got[1]) == body and got[2] is None and got[3] is None


def test_stream_out_of_order(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    text = "caso CPF-o5c4344k e T_n7 fim"
    pieces = [text[i : i + 4] for i in range(0, len(text), 4)]
    order = list(range(len(pieces)))
    random.Random(2).shuffle(order)
    for n, part in enumerate((order[:3], order[3:])):
        rows = [("s", "b", i, pieces[i], i == len(pieces) - 1) for i in part]
        spark.createDataFrame(rows, "stream string, block string, seq long, chunk string, final boolean").coalesce(1).write.mode("append").parquet(str(source))
        _ = n
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    chunks = spark.readStream.schema("stream string, block string, seq long, chunk string, final boolean").option("maxFilesPerTrigger", 1).parquet(str(source))
    q = unmask_stream(chunks, PAIRS).writeStream.format("memory").queryName("unmasked").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = "".join(r.text for r in spark.table("unmasked").orderBy("seq").collect())
    assert got == "caso 529 e tb fim"


def test_windowed_audit(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")
    q = windowed_audit(stream, by="event_type").writeStream.format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "c")).outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == events.count()


def test_answers_share_the_tables_of_their_pairs():
    from cloakstone.streaming.events import Answer

    pairs = {"CPF-o5c4344k": '5"29', "CPF-o5c4344kx": "long", "p": "q"}
    first = Answer(pairs)
    event = lambda x: json.dumps({"type": "content_block_delta", "index": 0, "delta": {"type": "input_json_delta", "partial_json": x}})
    for like in (None, first, first):
        a = Answer(pairs, like=like)
        out = [json.loads(x) for piece in ("a CPF-o5c4", "344k", " CPF-o5c4344kx p") for x in a.push(event(piece)).split("\n")]
        out += [json.loads(x) for x in a.push(json.dumps({"type": "content_block_stop", "index": 0})).split("\n")]
        assert "".join(next(v for k, v in e["delta"].items() if k != "type") for e in out if "delta" in e) == 'a 5\\"29 long q'
    assert first._tables.keys() == {True} and a._tables is first._tables
