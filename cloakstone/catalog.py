"""The library's registered queries, with equivalent SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import ids
from .functions import text as T
from .functions import validators as V
from .operators import audit, columns, corpus, detect, known, mask
from .plans import sql as Q
from .plans.config import Config
from .sources.tables import spread, written

#: A key for tests and comparisons; real keys come from a secret store.
TEST_KEY = ids.Key(b"0123456789abcdef0123456789abcdef")
#: The test tables' mail is all at example domains, and their addresses are public.
OPEN = Config(allowed_email_domains=(), public_ip=True)

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _all_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.mask_corpus(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), TEST_KEY, config=OPEN, order=("doc_id",))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents masked by all parts (detectors, readers, learned values), with the number of replacements."""
    return _all_parts(spark, sf_dir).select("doc_id", "text", "n_replacements")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- detectors -------------------------------------------------------------------------------------------------------------------------


def _found(spark: SparkSession, sf_dir: str, kind: str, rule: str | None = None, config: Config = OPEN) -> DataFrame:
    rows = detect.exploded(detect.detect(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), config=config, only=(kind,)), "doc_id")
    rows = rows.where(F.col("rule") == rule) if rule else rows
    return rows.groupBy("doc_id", "real").agg(F.count("*").alias("n"))


def _matches(pattern: str, where: str = "true", source: str = "documents", key: str = "doc_id", text: str = "text", group: int = 0) -> str:
    return f"SELECT {key}, real, count(*) AS n FROM (SELECT {key}, unnest(regexp_extract_all({text}, '{pattern}', {group})) AS real FROM {source}) WHERE {where} GROUP BY ALL"


EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+"
IPV4 = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"


@query(_matches(EMAIL, "real NOT LIKE '%.invalid'"))
def detect_email(spark, sf_dir):
    return _found(spark, sf_dir, "email")


HEX_TOKEN = r"(?i)(?:token|api_?key|secret|access_?key)[\"'']?\s*[:=]\s*[\"'']([0-9a-f]{32,64})[\"'']"


@query(_matches(HEX_TOKEN, group=1))
def detect_token_attr(spark, sf_dir):
    return _found(spark, sf_dir, "secret", "hex-token")


_PUBLIC = (
    "a BETWEEN 1 AND 223 AND a <> 127 AND b <= 255 AND c <= 255 AND d <= 255 AND NOT (a = 169 AND b = 254) AND NOT (a = 192 AND b = 0 AND c IN (0, 2)) AND NOT (a = 198 AND b = 51 AND c = 100) "
    "AND NOT (a = 203 AND b = 0 AND c = 113) AND NOT (a = 198 AND b IN (18, 19)) AND real NOT IN ('8.8.8.8', '8.8.4.4', '1.1.1.1', '1.0.0.1', '9.9.9.9', '208.67.222.222', '208.67.220.220') "
    "AND NOT regexp_matches('.' || real, '[.]0[0-9]')"
)


#: Addresses in documents, as (doc_id, real, a, b, c, d).
_IPS = f"""m AS (SELECT doc_id, unnest(regexp_extract_all(' ' || text || '  ', '(?:[^0-9.]|[^0-9][.])({IPV4})(?:[^0-9.]|[.][^0-9])', 1)) AS real FROM documents),
o AS (SELECT *, split_part(real, '.', 1)::INT a, split_part(real, '.', 2)::INT b, split_part(real, '.', 3)::INT c, split_part(real, '.', 4)::INT d FROM m)"""
#: All findings in documents (doc_id, type, rule, real): nothing but these three kinds occurs there.
_ALL = f"""{_IPS},
f AS (
  SELECT doc_id, 'email' AS type, 'email' AS rule, real FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{EMAIL}')) AS real FROM documents) WHERE real NOT LIKE '%.invalid'
  UNION ALL SELECT doc_id, 'secret', 'hex-token', unnest(regexp_extract_all(text, '{HEX_TOKEN}', 1)) FROM documents
  UNION ALL SELECT doc_id, 'ip', 'ip', real FROM o WHERE {_PUBLIC})"""


@query(f"WITH {_IPS} SELECT doc_id, real, count(*) AS n FROM o WHERE {_PUBLIC} GROUP BY ALL")
def detect_ipv4(spark, sf_dir):
    return _found(spark, sf_dir, "ip", "ip")


@query(f"WITH {_ALL} SELECT doc_id, real, count(*) AS n FROM f WHERE type = 'secret' GROUP BY ALL")
def detect_secret(spark, sf_dir):
    return _found(spark, sf_dir, "secret")


def _with_made(spark: SparkSession, sf_dir: str, made) -> DataFrame:
    """The documents, which hold no such value, and a made text for each customer, under negative ids."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.unionByName(table(spark, sf_dir, "customer").select((-1 - F.col("c_custkey")).alias("doc_id"), made.alias("text")))


def _counted(found: DataFrame, kind: str) -> DataFrame:
    return detect.exploded(detect.detect(found, config=OPEN, only=(kind,)), "doc_id").groupBy("doc_id", "real").agg(F.count("*").alias("n"))


@query("SELECT -1 - c_custkey AS doc_id, '5500 0000 0000 0004' AS real, 2 AS n FROM customer WHERE c_custkey % 2 = 0")
def detect_card_luhn(spark, sf_dir):
    """A number with a right check digit twice, or one with a wrong one."""
    made = F.when(F.col("c_custkey") % 2 == 0, "paid with 5500 0000 0000 0004, card 5500 0000 0000 0004").otherwise("paid with 5500 0000 0000 0005, card 5500 0000 0000 0013")
    return _counted(_with_made(spark, sf_dir, made), "card")


@query("SELECT -1 - c_custkey AS doc_id, '(' || (11 + c_custkey % 88) || ') 9' || (1000 + c_custkey % 9000) || '-' || (1000 + c_custkey * 7 % 9000) AS real, 1 AS n FROM customer")
def detect_phone(spark, sf_dir):
    k = F.col("c_custkey")
    number = F.concat(F.lit("("), k % 88 + 11, F.lit(") 9"), k % 9000 + 1000, F.lit("-"), k * 7 % 9000 + 1000)
    return _counted(_with_made(spark, sf_dir, F.concat(F.lit("ring "), number, F.lit(" or 555-1234 ext 9"))), "phone")


@query(f"WITH {_ALL} SELECT type, rule, count(*) AS n FROM f GROUP BY ALL")
def detect_all_types(spark, sf_dir):
    """type, rule, n over all detectors."""
    rows = detect.exploded(detect.detect(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), config=OPEN), "doc_id")
    return rows.groupBy("type", "rule").agg(F.count("*").alias("n"))


@query(_matches(r"https?://[^\s\"''<>]+", source="pages", key="page_id", text="html"))
def url_values(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"https?://[^\s\"'<>]+"), F.lit(0))).alias("real"))
    return pages.groupBy("page_id", "real").agg(F.count("*").alias("n"))


@query("SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, count(*) AS n FROM pages GROUP BY ALL")
def url_hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.lower(F.expr("try_parse_url(url, 'HOST')")).alias("host")).groupBy("host").agg(F.count("*").alias("n"))


# --- pseudonyms ------------------------------------------------------------------------------------------------------------------------


def _kid(domain: str, value: str) -> str:
    return Q.keyed_id(TEST_KEY.secret, domain, value)


@query(f"""
WITH m AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{EMAIL}')) AS real FROM documents)
SELECT real, 'p.' || {_kid('email', 'lower(real)')} || '@d' || substr({_kid('dominio', "lower(regexp_extract(real, '@([^@]*)$', 1))")}, 1, 4) || '.invalid' AS pseudo FROM m WHERE real NOT LIKE '%.invalid'""")
def pseudonymize_email(spark, sf_dir):
    return _found(spark, sf_dir, "email").select("real").distinct().select("real", ids.pseudonym(TEST_KEY, F.lit("email"), F.col("real")).alias("pseudo"))


_NET = Q.hmac(TEST_KEY.secret, "rede24", "net")


@query(f"""
WITH o AS (SELECT o_orderkey, '10.' || (o_custkey % 256) || '.' || (o_orderkey % 256) || '.' || (o_orderkey % 251) AS real, '10.' || (o_custkey % 256) || '.' || (o_orderkey % 256) AS net FROM orders),
h AS (SELECT *, {_NET} AS h FROM o)
SELECT o_orderkey, (240 | (('0x' || substr(h, 1, 2))::INT & 15)) || '.' || ('0x' || substr(h, 3, 2))::INT || '.' || ('0x' || substr(h, 5, 2))::INT || '.' || (o_orderkey % 251) AS pseudo FROM h""")
def pseudonymize_ip(spark, sf_dir):
    real = F.concat_ws(".", F.lit("10"), F.col("o_custkey") % 256, F.col("o_orderkey") % 256, F.col("o_orderkey") % 251)
    return table(spark, sf_dir, "orders").select("o_orderkey", ids.fake_ip(TEST_KEY, real).alias("pseudo"))


@query(f"SELECT c_custkey, 'Person ' || {_kid('nome', 'upper(c_name)')} AS name, c_mktsegment FROM customer")
def mask_customer_columns(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), "c_mktsegment")
    return columns.mask_columns(df, TEST_KEY, {"name": "name"})


@query(f"SELECT s_suppkey, CASE WHEN upper(s_name) = s_name THEN 'USER-' ELSE 'User-' END || {_kid('usuario', 'upper(s_name)')} AS code, s_nationkey FROM supplier")
def mask_supplier_columns(spark, sf_dir):
    df = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("code"), "s_nationkey")
    return columns.mask_columns(df, TEST_KEY, {"code": "user"})


@query(f"SELECT p_partkey, 'CPF-' || {_kid('cpf', 'lpad(p_partkey::VARCHAR, 11, ' + chr(39) + '0' + chr(39) + ')')} AS pseudo FROM part")
def pseudonymize_number(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", ids.pseudonym(TEST_KEY, F.lit("cpf"), F.lpad(F.col("p_partkey").cast("string"), 11, "0")).alias("pseudo"))


@query(f"SELECT DISTINCT lower(c_mktsegment) AS name, 't_' || {Q.keyed_id(TEST_KEY.secret, 'objeto', chr(39) + 'tabela' + chr(39) + ' || chr(0) || lower(c_mktsegment)')} AS pseudo FROM customer")
def pseudonymize_object(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(F.lower("c_mktsegment").alias("name")).distinct()
    return names.select("name", ids.pseudonym(TEST_KEY, F.lit("obj.table"), F.col("name")).alias("pseudo"))


# --- masking ---------------------------------------------------------------------------------------------------------------------------


def _masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(_all_parts(spark, sf_dir), "masked")


@query("SELECT doc_id, true AS same FROM documents")
def roundtrip_exact(spark, sf_dir):
    """Masked and unmasked documents are the source."""
    docs, masked = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("source")), _masked(spark, sf_dir)
    back = mask.unmask(masked.select("doc_id", "text"), mask.reverse_table(mask.mapping(masked, "doc_id"), "doc_id"), "doc_id")
    return back.join(docs, "doc_id").select("doc_id", (F.col("text") == F.col("source")).alias("same"))


@query("SELECT doc_id, true AS same FROM documents")
def mask_idempotent(spark, sf_dir):
    """Masking masked documents changes nothing."""
    once = _masked(spark, sf_dir).select("doc_id", "text", F.col("text").alias("first"))
    return corpus.mask_corpus(once, TEST_KEY, config=OPEN).select("doc_id", (F.col("text") == F.col("first")).alias("same"))


#: Each distinct finding with its pseudonym, and the domain within an address.
_PSEUDO = f"""{_ALL},
v AS (SELECT DISTINCT type, real, split_part(real, '.', 1) || '.' || split_part(real, '.', 2) || '.' || split_part(real, '.', 3) AS net FROM f),
h AS (SELECT *, {_NET} AS h FROM v),
p AS (SELECT type, real, CASE type
    WHEN 'email' THEN 'p.' || {_kid('email', 'lower(real)')} || '@d' || substr({_kid('dominio', "lower(regexp_extract(real, '@([^@]*)$', 1))")}, 1, 4) || '.invalid'
    WHEN 'secret' THEN 'SECRET-' || {_kid('segredo', 'real')}
    ELSE (240 | (('0x' || substr(h, 1, 2))::INT & 15)) || '.' || ('0x' || substr(h, 3, 2))::INT || '.' || ('0x' || substr(h, 5, 2))::INT || '.' || split_part(real, '.', 4) END AS pseudo FROM h),
each AS (SELECT DISTINCT doc_id, type, real, pseudo FROM f JOIN p USING (type, real)
  UNION SELECT DISTINCT doc_id, 'domain', regexp_extract(real, '@([^@]*)$', 1), regexp_extract(pseudo, '@([^@]*)$', 1) FROM f JOIN p USING (type, real) WHERE type = 'email')"""


@query(f"""
WITH RECURSIVE {_PSEUDO},
l AS (SELECT doc_id, real, pseudo, row_number() OVER (PARTITION BY doc_id ORDER BY length(real) DESC, real) AS i FROM each WHERE type <> 'domain'),
r AS (SELECT doc_id, 0::BIGINT AS i, text FROM documents UNION ALL SELECT r.doc_id, l.i, replace(r.text, l.real, l.pseudo) FROM r JOIN l ON l.doc_id = r.doc_id AND l.i = r.i + 1),
last AS (SELECT doc_id, arg_max(text, i) AS text FROM r GROUP BY 1)
SELECT doc_id, text, (SELECT count(*) FROM f WHERE f.doc_id = last.doc_id)::INT AS n_replacements FROM last""")
def masked_documents(spark, sf_dir):
    return flagship(spark, sf_dir)


@query(f"WITH {_PSEUDO} SELECT type, count(DISTINCT pseudo) AS n_distinct, 0 AS n_collided FROM each GROUP BY type")
def collisions_and_mapping(spark, sf_dir):
    m = mask.mapping(_masked(spark, sf_dir), "doc_id")
    return audit.by_type(m).join(mask.collisions(m, "doc_id").agg(F.count("*").alias("n_collided")))


@query(f"WITH {_PSEUDO} SELECT type, count(*) AS n FROM each GROUP BY type")
def top_types(spark, sf_dir):
    return audit.top_counts(mask.mapping(_masked(spark, sf_dir), "doc_id"), "type")


@query("SELECT doc_id, (4 + CASE WHEN doc_id % 7 = 6 THEN 6 ELSE 0 END)::BIGINT AS total FROM documents")
def resolve_overlaps(spark, sf_dir):
    """Sum of the starts that greedy resolution keeps, of fixed spans and one that moves."""
    span = lambda s, e: F.struct(s.cast("int").alias("start"), e.cast("int").alias("end"), F.lit("x").alias("type"), F.lit("v").alias("real"), F.lit("r").alias("rule"), F.lit(True).alias("strong"))
    d = F.col("doc_id") % 7
    fixed = [span(F.lit(a), F.lit(b)) for a, b in ((0, 4), (2, 9), (4, 6), (4, 5))]
    kept = mask.resolved(F.array(*fixed, span(d, d + 2)).cast(T.SPANS))
    return table(spark, sf_dir, "documents").select("doc_id", F.aggregate(kept, F.lit(0).cast("long"), lambda a, f: a + f["start"]).alias("total"))


# --- validators over numbers made from keys ----------------------------------------------------------------------------------------------


def _synthetic(n: int, factor: int) -> tuple[str, Callable]:
    """n digits from the order key: SQL and column."""
    return f"lpad(((o_orderkey * {factor}) % {10**n})::VARCHAR, {n}, '0')", lambda: F.lpad(((F.col("o_orderkey") * factor) % (10**n)).cast("string"), n, "0")


def _validator(name: str, n: int, factor: int, sql: str, check) -> None:
    text, column = _synthetic(n, factor)

    def run(spark, sf_dir):
        return table(spark, sf_dir, "orders").select("o_orderkey", column().alias("v")).select("o_orderkey", "v", check(F.col("v")).alias("valid"))

    run.__name__ = name
    query(f"SELECT o_orderkey, v, ({sql}) AND NOT {Q.all_equal('v')} AS valid FROM (SELECT o_orderkey, {text} AS v FROM orders)")(run)


_W = Q.weighted
_PIS = [3, 2, 9, 8, 7, 6, 5, 4, 3, 2]
_CNPJ = [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]
_validator("validate_cpf", 11, 7919, f"{Q.mod11(_W('v', list(range(10, 1, -1))))} = {Q.digits_at('v', 9)} AND {Q.mod11(_W('v', list(range(11, 1, -1))))} = {Q.digits_at('v', 10)}", V.valid_cpf)
_validator("validate_cnpj", 14, 104729, f"{Q.mod11(_W('v', _CNPJ[1:]))} = {Q.digits_at('v', 12)} AND {Q.mod11(_W('v', _CNPJ))} = {Q.digits_at('v', 13)} AND substr(v, 9, 4) <> '0000'", V.valid_cnpj)
_validator("validate_pis", 11, 7907, f"{Q.mod11(_W('v', _PIS))} = {Q.digits_at('v', 10)}", V.valid_pis)
_validator("validate_cns", 15, 15485863, f"{_W('v', list(range(15, 0, -1)))} % 11 = 0 AND ({Q.digits_at('v', 0)} IN (1, 2) OR {Q.digits_at('v', 0)} >= 7)", V.valid_cns)
_validator("validate_renavam", 11, 7901, f"{_W('v', _PIS)} * 10 % 11 % 10 = {Q.digits_at('v', 10)}", V.valid_renavam)
_CNH_A, _CNH_B = (f"({_W('v', w)} % 11)" for w in (list(range(9, 0, -1)), list(range(1, 10))))
_CNH_SECOND = f"(({_CNH_B} - CASE WHEN {_CNH_A} = 10 THEN 2 ELSE 0 END + 11) % 11)"
_validator("validate_cnh", 11, 7919, f"{_CNH_A} % 10 = {Q.digits_at('v', 9)} AND {_CNH_SECOND} % 10 = {Q.digits_at('v', 10)}", V.valid_cnh)
_validator(
    "validate_luhn", 16, 982451653,
    "(" + " + ".join(f"(CASE WHEN {2 if i % 2 == 0 else 1} * {Q.digits_at('v', i)} > 9 THEN {2 if i % 2 == 0 else 1} * {Q.digits_at('v', i)} - 9 ELSE {2 if i % 2 == 0 else 1} * {Q.digits_at('v', i)} END)" for i in range(16)) + ") % 10 = 0",
    V.valid_luhn,
)
_validator(
    "validate_tracking", 9, 7877,
    f"(CASE 11 - {_W('v', [8, 6, 4, 2, 3, 5, 9, 7])} % 11 WHEN 10 THEN 0 WHEN 11 THEN 5 ELSE 11 - {_W('v', [8, 6, 4, 2, 3, 5, 9, 7])} % 11 END) = {Q.digits_at('v', 8)}",
    lambda v: V.valid_tracking(v) & ~v.rlike(r"^(.)\1*$"),
)
_validator(
    "validate_voter", 12, 86028121,
    f"""substr(v, 9, 2)::INT BETWEEN 1 AND 28
    AND (CASE WHEN {_W('v', list(range(2, 10)))} % 11 = 10 THEN 0 WHEN {_W('v', list(range(2, 10)))} % 11 = 0 AND substr(v, 9, 2)::INT IN (1, 2) THEN 1 ELSE {_W('v', list(range(2, 10)))} % 11 END) = {Q.digits_at('v', 10)}
    AND (CASE WHEN ({_W('v', [7, 8, 9], 8)}) % 11 = 10 THEN 0 WHEN ({_W('v', [7, 8, 9], 8)}) % 11 = 0 AND substr(v, 9, 2)::INT IN (1, 2) THEN 1 ELSE ({_W('v', [7, 8, 9], 8)}) % 11 END) = {Q.digits_at('v', 11)}""",
    V.valid_voter,
)


@query("""
SELECT o_orderkey, v, (CAST(substr(v, 5) || (ascii(substr(v, 1, 1)) - 55) || (ascii(substr(v, 2, 1)) - 55) || substr(v, 3, 2) AS HUGEINT) % 97) = 1 AS valid
FROM (SELECT o_orderkey, 'DE' || lpad((o_orderkey % 97)::VARCHAR, 2, '0') || lpad((o_orderkey * 7919)::VARCHAR, 18, '0') AS v FROM orders)""")
def validate_iban(spark, sf_dir):
    v = F.concat(F.lit("DE"), F.lpad((F.col("o_orderkey") % 97).cast("string"), 2, "0"), F.lpad((F.col("o_orderkey") * 7919).cast("string"), 18, "0"))
    return table(spark, sf_dir, "orders").select("o_orderkey", v.alias("v")).select("o_orderkey", "v", V.valid_iban(F.col("v")).alias("valid"))


@query("SELECT o_orderkey, repeat((o_orderkey % 10)::VARCHAR, 11) AS v, false AS valid FROM orders")
def validate_cnh_negatives(spark, sf_dir):
    """No number of equal digits is a valid licence."""
    v = F.repeat((F.col("o_orderkey") % 10).cast("string"), 11)
    return table(spark, sf_dir, "orders").select("o_orderkey", v.alias("v"), V.valid_cnh(v).alias("valid"))


# --- names, numbers, places --------------------------------------------------------------------------------------------------------------


@query("SELECT n_nationkey, upper(trim(n_name)) AS name, CASE WHEN upper(n_name) = n_name THEN 'A' WHEN lower(n_name) = n_name THEN 'a' ELSE 'M' END AS letter_case FROM nation")
def normalized_names(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", T.norm_name(F.col("n_name")).alias("name"), T.letter_case(F.col("n_name")).alias("letter_case"))


@query("SELECT c_custkey, regexp_replace(c_name || '-x', '[^0-9]', '', 'g') || 'x' AS canonical FROM customer")
def canonical_numbers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.canonical_number(F.concat("c_name", F.lit("-x"))).alias("canonical"))


@query(r"""
SELECT o_orderkey, a = 10 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 100 AND b BETWEEN 64 AND 127) AS internal
FROM (SELECT o_orderkey, (o_orderkey % 256) AS a, (o_custkey % 256) AS b FROM orders)""")
def internal_ips(spark, sf_dir):
    ip = F.concat_ws(".", F.col("o_orderkey") % 256, F.col("o_custkey") % 256, F.lit("3"), F.lit("4"))
    return table(spark, sf_dir, "orders").select("o_orderkey", detect.internal_ip(ip).alias("internal"))


@query("""
SELECT page_id, CASE WHEN len(p) < 2 THEN lower(h) WHEN p[len(p) - 1] IN ('com', 'co', 'org', 'net', 'gov', 'edu', 'ac') AND length(p[len(p)]) = 2 AND len(p) >= 3 THEN p[len(p) - 2] ELSE p[len(p) - 1] END AS label
FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS h, string_split(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '.') AS p FROM pages)""")
def registrable_labels(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", known.registrable_label(F.expr("try_parse_url(url, 'HOST')")).alias("label"))


# --- learning, evidence, precedence --------------------------------------------------------------------------------------------------------


@query("""
WITH w AS (SELECT DISTINCT conv_id, unnest(regexp_extract_all(text, '[A-Za-z0-9](?:[A-Za-z0-9_.\\-]*[A-Za-z0-9])?')) AS word FROM conversations),
k AS (SELECT DISTINCT 'u:' || upper(c_mktsegment) AS key FROM customer UNION SELECT 'u:' || upper(n_name) FROM nation UNION SELECT 'u:THE' UNION SELECT 'u:WITH')
SELECT DISTINCT conv_id, key FROM w JOIN k ON k.key = 'u:' || upper(word) WHERE length(word) BETWEEN 3 AND 40""".replace("\\\\", "\\"))
def known_value_join(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("v")).unionByName(table(spark, sf_dir, "nation").select(F.col("n_name").alias("v"))).unionByName(spark.sql("SELECT explode(array('the', 'with')) AS v"))
    values = names.select(F.concat(F.lit("u:"), T.norm_name(F.col("v"))).alias("key"), F.lit("user").alias("type")).distinct()
    return known.occurrences(table(spark, sf_dir, "conversations"), values, "conv_id").select("conv_id", "key")


@query("SELECT 'u:' || l_shipmode AS key, count(DISTINCT rule) AS n_rules FROM (SELECT l_returnflag || l_linestatus AS l_shipmode, (l_quantity::INT % 3)::VARCHAR AS rule FROM lineitem) GROUP BY 1 HAVING count(DISTINCT rule) >= 2")
def two_rule_evidence(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    found = li.select(F.lit("user").alias("type"), F.concat("l_returnflag", "l_linestatus").alias("real"), (F.col("l_quantity").cast("int") % 3).cast("string").alias("rule"), F.lit(False).alias("strong"))
    return known.two_rules(found)


@query("SELECT user_id, event_type AS decision FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id, event_type) AS r FROM events) WHERE r = 1")
def first_decision_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumnRenamed("event_type", "decision")
    return known.first_decision(e, [], "user_id", "event_id", "decision")


@query("SELECT user_id, max(ts)::DATE::VARCHAR AS seen FROM events GROUP BY user_id HAVING max(ts)::DATE >= (SELECT max(ts)::DATE FROM events) - 10")
def validity_days(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    seen = e.groupBy("user_id").agg(F.max(F.to_date("ts")).alias("seen")).withColumn("seen_day", F.unix_date("seen"))
    last = F.lit(e.agg(F.unix_date(F.max(F.to_date("ts")))).first()[0])
    return known.valid_names(seen, last, 10).select("user_id", F.col("seen").cast("string").alias("seen"))


@query("""
WITH w AS (SELECT conv_id, turn, role <> 'assistant' AS from_data, lower(unnest(regexp_extract_all(text, '[A-Za-z]{3,}'))) AS word FROM conversations)
SELECT conv_id, word FROM w GROUP BY 1, 2 HAVING min(turn) FILTER (NOT from_data) IS NOT NULL AND (min(turn) FILTER (from_data) IS NULL OR min(turn) FILTER (NOT from_data) < min(turn) FILTER (from_data))""")
def model_first_words(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    words = c.select("conv_id", F.col("turn").alias("ord"), (F.col("role") != "assistant").alias("from_data"), F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0))).alias("word"))
    return known.public_first(words, "conv_id")


@query("SELECT word, min(user_id) AS type FROM (SELECT user_id, event_type AS word FROM events) GROUP BY 1")
def one_name_one_type(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("real"), F.lit(0).alias("start"), F.concat(F.lit("obj."), F.lpad(F.col("user_id").cast("string"), 12, "0")).alias("type"))
    out = known.unify_types(e)
    return out.select(F.col("real").alias("word"), F.regexp_extract("type", "([0-9]+)$", 1).cast("long").alias("type")).distinct()


@query("SELECT least(a.id, a.id) AS id, min(t) AS type, min(l) AS learned_day, max(s) AS seen_day FROM (SELECT o_custkey AS id, 'a' AS t, 5 AS l, 7 AS s FROM orders UNION ALL SELECT c_custkey, 'b', 3, 6 FROM customer) a GROUP BY a.id")
def merge_seen_tables(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.lit("a").alias("type"), F.lit(5).alias("learned_day"), F.lit(7).alias("seen_day"))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("b").alias("type"), F.lit(3).alias("learned_day"), F.lit(6).alias("seen_day"))
    return known.merge_seen(a, b)


# --- profiles and audit ----------------------------------------------------------------------------------------------------------------------


@query("""
SELECT 'c_custkey' AS "column", count(c_custkey) AS n, count(DISTINCT c_custkey) AS "distinct", true AS identity FROM customer
UNION ALL SELECT 'c_mktsegment', count(c_mktsegment), count(DISTINCT c_mktsegment), false FROM customer
UNION ALL SELECT 'c_nationkey', count(c_nationkey), count(DISTINCT c_nationkey), false FROM customer""")
def identity_columns(spark, sf_dir):
    return columns.identity_columns(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"))


@query("""
SELECT 'customer' AS source, "column", CASE "column" WHEN '' THEN '' ELSE '' END AS class, n FROM (UNPIVOT (SELECT count(c_custkey) AS c_custkey, count(c_name) AS c_name, count(c_nationkey) AS c_nationkey, count(c_acctbal) AS c_acctbal, count(c_mktsegment) AS c_mktsegment FROM customer) ON COLUMNS(*) INTO NAME "column" VALUE n)
UNION ALL SELECT 'events' AS source, "column", CASE "column" WHEN 'user_id' THEN 'user' ELSE '' END AS class, n FROM (UNPIVOT (SELECT count(event_id) AS event_id, count(ts) AS ts, count(user_id) AS user_id, count(event_type) AS event_type, count(value) AS value, count(props) AS props FROM events) ON COLUMNS(*) INTO NAME "column" VALUE n)
UNION ALL SELECT 'orders' AS source, "column", CASE "column" WHEN '' THEN '' ELSE '' END AS class, n FROM (UNPIVOT (SELECT count(o_orderkey) AS o_orderkey, count(o_custkey) AS o_custkey, count(o_orderstatus) AS o_orderstatus, count(o_totalprice) AS o_totalprice, count(o_orderdate) AS o_orderdate, count(o_orderpriority) AS o_orderpriority FROM orders) ON COLUMNS(*) INTO NAME "column" VALUE n)""")
def profile_columns(spark, sf_dir):
    """What the names of real columns say, with the number of their values."""
    out = None
    for name in ("customer", "events", "orders"):
        one = columns.profile(table(spark, sf_dir, name)).select(F.lit(name).alias("source"), "column", "class", "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT event_type, ts::DATE::VARCHAR AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def audit_by_day(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("SELECT p, list_sort(list(value))[floor((count(value) - 1) * p)::INT + 1] AS value FROM events, (VALUES (0.5::DOUBLE), (0.95::DOUBLE), (1.0::DOUBLE)) t(p) WHERE value IS NOT NULL GROUP BY p")
def latency_percentiles(spark, sf_dir):
    return audit.percentiles(table(spark, sf_dir, "events"), "value").select("p", "value")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type")
def top_counts(spark, sf_dir):
    return audit.top_counts(table(spark, sf_dir, "events"), "event_type")


@query("SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY 1")
def fields_in_json(spark, sf_dir):
    keys = table(spark, sf_dir, "events").select(F.explode(F.json_object_keys("props")).alias("key"))
    return keys.groupBy("key").agg(F.count("*").alias("n"))


@query("""
SELECT o_orderkey, n * CASE u WHEN 'd' THEN 86400 WHEN 'm' THEN 60 WHEN 's' THEN 1 ELSE 3600 END AS seconds
FROM (SELECT o_orderkey, o_orderkey % 90 + 1 AS n, ['d', 'm', 's', 'h'][(o_orderkey % 4 + 1)::INT] AS u FROM orders)""")
def period_parse(spark, sf_dir):
    unit = F.element_at(F.array(*map(F.lit, "dmsh")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    period = F.concat((F.col("o_orderkey") % 90 + 1).cast("string"), unit)
    return table(spark, sf_dir, "orders").select("o_orderkey", audit.period_seconds(period).alias("seconds"))
