import pytest
from pyspark.sql import functions as F

from cloakstone.functions import ids
from cloakstone.operators import audit, columns, conversation, detect, known, mask
from cloakstone.plans.config import Config
from cloakstone.sources import sinks
from cloakstone.sources.tables import written

KEY = ids.Key(b"0123456789abcdef0123456789abcdef")
CONFIG = Config(internal_domains=("firma-inventada",), extra_patterns=(("badge", r"\bKQ\d{4}\b"),), terms=(("project", "Project Heron"),))
FOUND = [
    ("write to vera.nunes@firma-inventada.net today", "email", "vera.nunes@firma-inventada.net"), ("node 172.21.9.40:8080 is down", "ip", "172.21.9.40"), ("restart kafka-7.firma-inventada.lan now", "host", "kafka-7.firma-inventada.lan"),
    ("paid by 314.159.265-90 in cash", "cpf", "314.159.265-90"), ("cpf do titular 31415926590", "cpf", "31415926590"), ("supplier 27.182.818/0002-00", "cnpj", "27.182.818/0002-00"), ("recado: (21) 99876-1234, obrigado", "phone", "(21) 99876-1234"),
    ("cep 70040-020", "cep", "70040-020"), ("card 5500 0000 0000 0004 refused", "card", "5500 0000 0000 0004"), ("rg 45.678.901-2", "rg", "45.678.901-2"), ("agência 4321-0 e conta 765432-1", "account", "4321-0"),
    ("pix: 0f8fad5b-d9cb-469f-a165-70867728950e", "pix", "0f8fad5b-d9cb-469f-a165-70867728950e"), ("entrega na Avenida Central, 456 fundos", "address", "Avenida Central, 456"), ("nasc. 31/12/1999", "birthdate", "31/12/1999"),
    ("badge KQ4455 lost", "x:badge", "KQ4455"), ("release of Project Heron slips", "t:project", "Project Heron"), ("ela é budista", "sensitive", "budista"), ("diagnóstico: E11.9", "sensitive", "E11.9"), ("filiada ao PSB", "sensitive", "PSB"),
    ("the password is tr0ub4dor&3", "secret", "tr0ub4dor&3"), ("APP_PASSWORD=hunter2!x", "secret", "hunter2!x"), ("redis://svc:p4ssw0rd@cache-1/0", "secret", "p4ssw0rd"), ("to DE89 3704 0044 0532 0130 00 today", "iban", "DE89 3704 0044 0532 0130 00"),
    ("mysqldump --single-transaction -pz9!kelp shop", "secret", "z9!kelp"), ("sshpass -p 'k3lp forest' ssh x", "secret", "k3lp"), ("curl -s -u bot:s3a-weed https://x.dev", "secret", "s3a-weed"), ("run --password=Kelp-77 now", "secret", "Kelp-77"),
    ("Authorization: Bearer kelp.77.forest", "secret", "kelp.77.forest"), ("Cookie: sid=kelpforest77; x=1", "secret", "kelpforest77"), ('my pwd for the shop "kelp77x"', "secret", "kelp77x"), ("seu código de verificação é 778899", "secret", "778899"),
    ("frase secreta: kelp grows in cold water", "secret", "kelp grows in cold water"), ("título de eleitor nº 1024 0000 0183", "doc", "1024 0000 0183"), ("passaporte nº FZ123456", "doc", "FZ123456"), ("placa: KLP7F77", "doc", "KLP7F77"), ("chassi 9BWZZZ377VT004251", "doc", "9BWZZZ377VT004251"),
    ("IMEI 490154203237518", "doc", "490154203237518"), ("user_id: 0f8fad5b-d9cb-469f-a165-70867728950e", "doc", "0f8fad5b-d9cb-469f-a165-70867728950e"), ("carteira de identidade nº SP-12.345.678-9", "rg", "SP-12.345.678-9"), ("conta corrente nº 99887-6", "account", "99887-6"),
    ("CIDs: F32.1, G40 e Z99", "sensitive", "G40"), ("data de nascimento: 2001-02-03", "birthdate", "2001-02-03"), ("na Praça da Sé, nº 12, hoje", "address", "Praça da Sé, nº 12"), ("parcel BR271828189PT left", "tracking", "BR271828189PT"), ("cvc 907", "secret", "907"), ("if de:ad:be:ef:00:01 joins", "mac", "de:ad:be:ef:00:01"),
]
CLEAN = [
    "release 3.14.159 listens on 8443 at 127.0.0.1, resolver 1.1.1.1", "oid 1.2.840.113549.1.1.11 of a certificate", "trace 0f8fad5b-d9cb-469f-a165-70867728950e finished", "ask the rg column owner", "mail nobody@example.org",
    "revision 0123456789abcdef0123456789abcdef on 2025-11-30", "Avenida Central is closed", "epoch 1700000000123 for order 12345678901", "p.zzzzzzzz@dabcd.invalid is masked", "240.7.8.9 is masked", "done (1700000000 epoch)",
    "receptor accepts 20251130-101500", "cep of the sample: 20251130", "client_id: 0f8fad5b-d9cb-469f-a165-70867728950e", "mysql -h box -P 3306", "the password policy is strict", "password: string", "curl -u x", "rua sem número", "cidade A10 norte", "", None,
]


@pytest.fixture(scope="module")
def masked(spark):
    rows = [(i, t) for i, (t, _, _) in enumerate(FOUND)] + [(100 + i, t) for i, t in enumerate(CLEAN)]
    df = spark.createDataFrame(rows, "id int, text string")
    return df, written(detect.detect(df, config=CONFIG), "found"), written(mask.mask(df, KEY, config=CONFIG), "masked")


def test_detectors(masked):
    found = {r.id: r.findings for r in masked[1].collect()}
    for i, (text, kind, real) in enumerate(FOUND):
        assert any(f.type == kind and f.real == real and text[f.start : f.end] == real for f in found[i]), (text, found[i])
    for i, text in enumerate(CLEAN):
        assert found[100 + i] == [], text


def test_round_trip_and_clean_rows(masked):
    df, _, out = masked
    source = {r.id: r.text for r in df.collect()}
    sent = {r.id: r.text for r in out.collect()}
    assert all(sent[i] != source[i] for i in range(len(FOUND))) and all(sent[i] == source[i] for i in source if i >= 100)
    back = mask.unmask(out.select("id", "text"), mask.reverse_table(mask.mapping(out, "id"), "id"), "id")
    assert {r.id: r.text for r in back.collect()} == source
    assert mask.leftovers(back, mask.mapping(out, "id"), "id").count() == 0


def test_overlaps(spark):
    span = "array<struct<start:int,end:int,type:string,real:string,rule:string,strong:boolean>>"
    rows = [(1, [(0, 4, "a", "v", "r", True), (0, 6, "b", "v", "r", True), (5, 9, "c", "v", "r", True), (6, 8, "d", "v", "r", True)]), (2, [(3, 5, "obj.x", "v", "r", True), (3, 5, "z", "v", "r", True), (3, 5, "y", "v", "r", True)]), (3, [])]
    df = spark.createDataFrame(rows, f"id int, findings {span}")
    got = {r.id: [(f.start, f.end, f.type) for f in r.f] for r in df.select("id", mask.resolved(F.col("findings")).alias("f")).collect()}
    assert got == {1: [(0, 6, "b"), (6, 8, "d")], 2: [(3, 5, "y")], 3: []}
    long = {r.id: [(f.start, f.end) for f in r.f] for r in df.select("id", mask.longest_first(F.col("findings")).alias("f")).collect()}
    assert long[1] == [(0, 6), (6, 8)]


def test_bad_scripts_are_rejected(spark):
    script = "array<struct<start:int,end:int,type:string,pseudo:string,real:string>>"
    df = spark.createDataFrame([(1, "abc", [(0, 9, "t", "P", "r")]), (2, "abc", [(1, 2, "t", "P", "b")])], f"id int, text string, edits {script}")
    out = df.withColumn("text", mask.spliced(F.col("text"), F.col("edits")))
    good, bad = mask.quarantined(out, "id")
    assert [r.text for r in good.collect()] == ["aPc"] and [r.id for r in bad.collect()] == [1]


def test_collisions_stay_masked(spark):
    t = spark.createDataFrame([("IP-1", "10.0.0.1", "ip"), ("IP-1", "10.0.0.2", "ip"), ("CPF-a", "529.982.247-25", "cpf"), ("CPF-a", "52998224725", "cpf"), ("T_abcdefgh", "TB", "obj.table")], "pseudo string, real string, type string")
    assert [r.pseudo for r in mask.collisions(t).collect()] == ["IP-1"]
    pairs = {r.pseudo: r.real for r in mask.reverse_table(t).collect()}
    assert "IP-1" not in pairs and pairs["CPF-a"] == "529.982.247-25" and pairs["t_abcdefgh"] == "TB" and pairs["T_ABCDEFGH"] == "TB"


def test_masked_distinct_equals_masked(spark):
    df = spark.createDataFrame([(1, "cpf 529.982.247-25"), (2, "cpf 529.982.247-25"), (3, None)], "id int, text string")
    assert {(r.id, r.text) for r in mask.mask_distinct(df, KEY).collect()} == {(r.id, r.text) for r in mask.mask(df, KEY).collect()}


def test_columns(spark):
    df = spark.createDataFrame([("Ana Lima", "529.982.247-25", "x"), (None, "", "y")], "nome string, cpf string, status string")
    out = columns.mask_columns(df, KEY).collect()
    assert out[0].nome.startswith("Person ") and out[0].cpf == "CPF-o5c4344k" and out[0].status == "x" and out[1].nome is None and out[1].cpf == ""
    assert columns.describe(["nome", "status"]) == {"nome": "", "status": ""}
    assert {r["column"]: r["class"] for r in columns.profile(df).collect()} == {"nome": "name", "cpf": "cpf", "status": ""}


def test_learning(spark):
    rows = [("obj.table", "tb_x1", "sql", False, 1, 5), ("obj.table", "TB_X1", "table", False, 2, 9), ("obj.table", "tb_y1", "sql", False, 1, 7), ("obj.server", "srv-1", "connection", True, 1, 3), ("obj.column", "id_x", "sql", True, 1, 1), ("user", "abcd", "f", True, 1, 1), ("user", "ab12", "f", True, 1, 1)]
    found = spark.createDataFrame(rows, "type string, real string, rule string, strong boolean, ord int, start int")
    got = {r.key: (r.type, r.real, r.n) for r in known.known_values(found, "ord").collect()}
    assert got == {"o:tb_x1": ("obj.table", "tb_x1", 2), "o:srv-1": ("obj.server", "srv-1", 1), "u:AB12": ("user", "ab12", 1)}
    texts = spark.createDataFrame([(1, "carga da TB_X1 no SRV-1."), (2, "nada")], "id int, text string")
    assert {(r.id, r.key) for r in known.occurrences(texts, known.known_values(found, "ord"), "id").collect()} == {(1, "o:tb_x1"), (1, "o:srv-1")}


def test_people(spark):
    people = spark.createDataFrame([("João Carlos Silva", "joao.silva@x.com.br", "U1001"), ("Ana Lima", None, "U1001")], "name string, email string, code string")
    reg = known.import_people(people, KEY)
    assert {r.person for r in reg.collect()} and reg.select("person").distinct().count() == 1
    texts = spark.createDataFrame([(1, "falar com JOAO SILVA hoje"), (2, "ninguém")], "id int, text string")
    assert {(r.id, r.candidate) for r in known.find_people(texts, reg, KEY, "id").collect()} == {(1, "JOAO SILVA")}


def test_mail_and_software(spark):
    found = spark.createDataFrame([("email", "maria.souza@acme.com.br"), ("email", "x@gmail.com"), ("email", "info.team@acme.com.br")], "type string, real string")
    assert {tuple(r) for r in known.mail_names(found).collect()} == {("domain", "acme.com.br"), ("name", "Maria Souza")}
    texts = spark.createDataFrame([("pip install polars\nimport polars\ndef acme_tool(): pass\nimport acme_tool",)], "text string")
    assert {r.name for r in known.software_proofs(texts).collect()} == {"polars"}


def test_state_of_runs(spark, tmp_path):
    path = f"file://{tmp_path}/seen"
    a = spark.createDataFrame([("a", "cpf", 1, 1)], "id string, type string, learned_day int, seen_day int")
    b = spark.createDataFrame([("a", "cpf", 5, 5), ("b", "rg", 5, 5)], "id string, type string, learned_day int, seen_day int")
    sinks.save_seen(spark, a, path, "1")
    for _ in range(2):  # a repeated run changes nothing
        assert {tuple(r) for r in sinks.save_seen(spark, b, path, "2").collect()} == {("a", "cpf", 1, 5), ("b", "rg", 5, 5)}
    assert [r.id for r in known.valid_names(sinks.save_seen(spark, b, path, "2"), F.lit(95), 90).collect()] == ["a", "b"]


def test_config():
    assert Config.from_json('{"disabled": ["rg"], "terms": [["a", "b"]]}') == Config(disabled=("rg",), terms=(("a", "b"),))
    with pytest.raises(ValueError, match="unknown"):
        Config.from_json('{"disable": []}')


def test_many_matches_have_their_places(spark):
    text = " ".join(f"u{i}@mail{i % 7}.dev" + "é" * (i % 3) for i in range(3000))
    found = detect.detect(spark.createDataFrame([(text,)], "text string"), config=CONFIG, only=("email",)).first().findings
    assert len(found) == 3000 and all(text[f.start : f.end] == f.real for f in found)


def test_detection_is_in_the_plan_once(spark):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all")
    docs = spark.createDataFrame([(1, "a@b.dev")], "id int, text string").repartition(2)
    found = detect.detect(docs, config=CONFIG, only=("email", "ip"))
    assert plan(detect.exploded(found, "id").groupBy("type").count()) == plan(found) > 0


def test_percentiles_and_positions(spark):
    values = [5.0, 1.0, 1.0, 9.0, None, 3.0, 3.0, 3.0, 7.5]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    known_values = sorted(v for v in values if v is not None)
    assert {(r.p, r.value) for r in audit.percentiles(df, "v", (0.0, 0.4, 0.5, 1.0)).collect()} == {(p, known_values[int((len(known_values) - 1) * p)]) for p in (0.0, 0.4, 0.5, 1.0)}
    assert audit.percentiles(df.limit(0), "v").count() == 0
    turns = [("a", 0, "user", "hi"), ("a", 1, "assistant", "yo"), ("b", 0, "user", "hi"), ("b", 1, "assistant", "no"), ("c", 0, "assistant", "yo"), ("c", 1, "user", "hi"), (None, 0, None, None)]
    got = {(r.conv, r.turn): r.position for r in conversation.positions(spark.createDataFrame(turns, "conv string, turn int, role string, text string"), "conv", "turn").collect()}
    assert got["a", 0] == got["b", 0] and len({got["a", 1], got["b", 1], got["c", 1], got["a", 0], got["c", 0], got[None, 0]}) == 6
