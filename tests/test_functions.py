import pytest
from pyspark.sql import functions as F

from cloakstone.functions import ids, labels
from cloakstone.functions import text as T
from cloakstone.functions import validators as V
from cloakstone.operators import detect

KEY = ids.Key(b"0123456789abcdef0123456789abcdef")
# Pseudonyms of values under the test key.
PSEUDONYMS = [
    ("account", "12345-6", "ACCOUNT-2fvokcvq"), ("address", "Rua das Flores, 123", "Address-pjkbkp6j"), ("birthdate", "12/03/1985", "BIRTHDATE-4eylalr2"), ("card", "4111 1111 1111 1111", "CARD-qwh3vz4d"),
    ("cep", "01310-100", "CEP-fygm7r5p"), ("cnh", "02650306461", "CNH-5o4pl5bz"), ("cnpj", "11.222.333/0001-81", "CNPJ-6p336eb6"), ("cnpj", "12.ABC.345/01DE-35", "CNPJ-tuq2w5td"), ("cpf", "529.982.247-25", "CPF-o5c4344k"),
    ("doc", "AB1234567", "DOC-grc4whkb"), ("email", "maria.souza@empresa-ficticia.com.br", "p.7bymwuxe@dt3sr.invalid"), ("host", "db01.empresa-ficticia.com.br", "hzpmtsuje.invalid"), ("host", "mysql.empresa-ficticia.com.br", "mysql-jwxb.invalid"),
    ("iban", "DE89370400440532013000", "IBAN-cljkfogd"), ("ip", "10.42.7.15", "242.12.159.15"), ("mac", "00:1a:2b:3c:4d:5e", "mac-z2x3ate3"), ("name", "Maria Fernanda Souza", "Person jdsxwsjr"), ("name", "maria fernanda souza", "person jdsxwsjr"),
    ("obj.table", "PEDIDO_ITEM", "T_n7avzasi"), ("obj.table", "PedidoItem", "T_b2qtWt76"), ("obj.table", "pedido_item", "t_n7avzasi"), ("obj.bucket", "PedidoItem", "Bkt_q52uIuXp"), ("obj.server", "PedidoItem", "Host_C3pc4o52"),
    ("phone", "(11) 98765-4321", "PHONE-6x6fjtkg"), ("pix", "maria@pix.com.br", "pix-xrf6f5gm"), ("rg", "12.345.678-9", "RG-rwivwfws"), ("secret", "Xk8pq2vR9zLm4Tw7", "SECRET-mudhjv7e"), ("sensitive", "evangélico", "sensitive-3vsxdfjr"),
    ("t:projeto", "Projeto Fenix", "Projeto-omr7ync2"), ("t:projeto", "PROJETO FENIX", "PROJETO-omr7ync2"), ("tracking", "RR473124829BR", "TRACKING-yad6bj7y"), ("user", "jsilva", "user-zdyot3pz"), ("x:matricula", "MAT123456", "MATRICULA-mof75git"),
]


def test_pseudonyms(spark):
    df = spark.createDataFrame(PSEUDONYMS, "t string, r string, p string").withColumn("got", ids.pseudonym(KEY, F.col("t"), F.col("r")))
    assert [(r.t, r.r, r.got) for r in df.collect()] == [(t, r, p) for t, r, p in PSEUDONYMS]


def test_a_person_has_one_id(spark):
    row = spark.range(1).select(ids.pseudonym(KEY, F.lit("name"), F.lit("JOÃO SILVA"), F.lit("vtcayyx2")).alias("a"), ids.pseudonym(KEY, F.lit("user"), F.lit("U1001"), F.lit("vtcayyx2")).alias("b")).first()
    assert (row.a, row.b) == ("PERSON VTCAYYX2", "USER-vtcayyx2")


def test_addresses_keep_their_spelling(spark):
    got = spark.createDataFrame([("10-42-7-15",), ("15.7.42.10.in-addr.arpa",), ("7.42.10.in-addr.arpa",)], "r string").select(ids.fake_ip(KEY, F.col("r")).alias("p"))
    assert [r.p for r in got.collect()] == ["242-12-159-15", "15.159.12.242.in-addr.arpa", "159.12.242.in-addr.arpa"]


@pytest.mark.parametrize(
    "name, value, valid",
    [
        ("cpf", "529.982.247-25", True), ("cpf", "529.982.247-26", False), ("cpf", "111.111.111-11", False), ("cnpj", "11.222.333/0001-81", True), ("cnpj", "11.222.333/0001-82", False), ("luhn", "4111 1111 1111 1111", True),
        ("luhn", "378282246310005", True), ("luhn", "4111 1111 1111 1112", False), ("luhn", "0000000000000000", False), ("iban", "GB82 WEST 1234 5698 7654 32", True), ("iban", "BR1500000000000010932840814P2", True),
        ("iban", "GB82 WEST 1234 5698 7654 33", False), ("alpha_cnpj", "12.ABC.345/01DE-35", True), ("alpha_cnpj", "12.ABC.345/01DE-36", False), ("alpha_cnpj", "11.222.333/0001-81", False), ("cnh", "02650306461", True),
        ("tracking", "RR473124829BR", True), ("tracking", "RR473124828BR", False), ("certificate", "104539 01 55 2013 1 00012 021 0000123-45", True), ("certificate", "104539 01 56 2013 1 00012 021 0000123-45", False),
        ("cpf", None, False), ("luhn", "", False), ("fiscal_key", "3524", False), ("boleto", "1", False), ("barcode", "x", False), ("bill", "", False),
    ],
)
def test_validators(spark, name, value, valid):
    assert spark.createDataFrame([(value,)], "v string").select(getattr(V, f"valid_{name}")(F.col("v")).alias("ok")).first().ok is valid


def test_names_numbers_and_case(spark):
    row = spark.createDataFrame([("  João   da Ção ",)], "v string").select(T.norm_name(F.col("v")).alias("a"), T.canonical_number(F.lit("12.345-X")).alias("b"), T.letter_case(F.lit("aB")).alias("c"), T.letter_case(F.lit("12")).alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == ("JOAO DA CAO", "12345x", "M", "")


LABELS = {
    "NOME_TITULAR": "name", "ownerName": "name", "Nome do Paciente": "name", "cpf_socio": "cpf", "NUM_CNPJ": "cnpj", "data_nascimento": "birthdate", "fone_comercial": "phone", "codFuncionario": "user", "login": "user", "religion": "sensitive",
    "vida sexual": "sensitive", "nome_usu": "user", "passport_number": "doc", "social_security": "doc", "logradouro": "address", "zip_code": "cep", "identidade": "rg", "num_cartao": "card", "conta_corrente": "account", "schema_title": "", "nm": "name_loose",
    "Paciente": "name_full", "RG/CPF": "rg", "users_total": "", "tipo_cliente": "", "path_name": "", "color": "", "account": "", "tax_id": "doc", "one two three four five six": "",
}


def test_labels():
    assert {k: labels.label_class(k) for k in LABELS} == LABELS
    assert labels.label_class("sexo") == "" and labels.label_class("sexo", quasi=True) == "quasi"


def test_internal_and_public_addresses(spark):
    rows = [("10.1.2.3", True, False), ("172.20.0.1", True, False), ("172.32.0.1", False, True), ("100.64.0.1", True, False), ("8.8.8.8", False, False), ("192.0.2.10", False, False), ("34.120.10.5", False, True), ("240.1.2.3", False, False), ("10.01.2.3", False, False), ("300.1.1.1", False, False)]
    got = spark.createDataFrame([r[:1] for r in rows], "ip string").select("ip", detect.internal_ip(F.col("ip")).alias("i"), detect.public_ip(F.col("ip")).alias("p")).collect()
    assert [(r.ip, r.i, r.p) for r in got] == rows
