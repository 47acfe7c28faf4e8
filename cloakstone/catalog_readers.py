"""Queries of the readers over rows made from keys, with the names that are expected as SQL; and of conversations, streams and sources."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import catalog
from .catalog import query, table
from .operators import conversation, corpus, deciders, intervals, known, mask, origins
from .plans import sql as Q
from .readers.fields import crc16
from .readers.stage import read_names, register
from .sources import chats, sinks
from .sources.tables import shared_dir, spread, written
from .streaming.decisions import first_decisions, run_once

#: Reader: (text, expected (type, name)); {k} is the row's key. Invented samples.
CASES: dict[str, tuple[str, list[tuple[str, str]]]] = {
    "image": ("kind: worker\nimage: hub{k}.orchard.lan:5000/pressing-{k}/cider-api{k}:beta\n", [("obj.server", "hub{k}.orchard.lan"), ("obj.organization", "pressing-{k}"), ("obj.repository", "cider-api{k}")]),
    "git": ("remote add fork git@forge-{k}.orchard.lan:millers{k}/grain-sorter{k}", [("obj.server", "forge-{k}.orchard.lan"), ("obj.organization", "millers{k}"), ("obj.repository", "grain-sorter{k}")]),
    "k8s-dns": ("curl -s http://kiln{k}.pottery-{k}.svc:9090/healthz", [("obj.service", "kiln{k}"), ("obj.namespace", "pottery-{k}")]),
    "sql": (
        "UPDATE loom_{k}.warp_{k} w SET w.tension_n{k} = 4 FROM weft_{k} f WHERE f.spool_{k} = w.spool_{k}",
        [("obj.schema", "loom_{k}"), ("obj.table", "warp_{k}"), ("obj.column", "tension_n{k}"), ("obj.table", "weft_{k}"), ("obj.column", "spool_{k}")],
    ),
    "error": ("sqlstate 42703: error, column \"glaze_{k}\" of table 'pots_{k}' not found", [("obj.column", "glaze_{k}"), ("obj.table", "pots_{k}")]),
    "connection": ("mongodb://reader_{k}:qwe@grove-{k}/harvest_{k}?tls=true", [("obj.user", "reader_{k}"), ("obj.server", "grove-{k}"), ("obj.database", "harvest_{k}")]),
    "dsn": ("$pdo = new PDO('pgsql:host=barn-{k};dbname=fodder_{k}', $u, $p);", [("obj.server", "barn-{k}"), ("obj.database", "fodder_{k}")]),
    "table": ("owner|table_name|rows\nreeve_{k}|hives_{k}|12\nreeve_{k}|combs_{k}|90\n\nend", [("obj.user", "reeve_{k}"), ("obj.table", "hives_{k}"), ("obj.table", "combs_{k}")]),
    "schema": ("hive_no{k}: string,\nhoney_kg{k}: double,\nqueen_seen{k}: boolean,\n", [("obj.column", "hive_no{k}"), ("obj.column", "honey_kg{k}"), ("obj.column", "queen_seen{k}")]),
    "lists": ("topics = [swarm.in{k}, swarm.out{k}, swarm.dead{k}]", [("obj.queue", "swarm.in{k}"), ("obj.queue", "swarm.out{k}"), ("obj.queue", "swarm.dead{k}")]),
    "key-value": (
        "bootstrap.servers=quay{k}-a.dock.lan:9092,quay{k}-b.dock.lan:9092\ntopic.name = cargo-in-{k}\nconsumer_group: gulls-{k}\n",
        [("obj.server", "quay{k}-a.dock.lan"), ("obj.server", "quay{k}-b.dock.lan"), ("obj.queue", "cargo-in-{k}"), ("obj.service", "gulls-{k}")],
    ),
    "address": ("gsutil ls gs://tide-{k}/charts_{k}/ ; open http://beacon-{k}.dock.intra/map", [("obj.bucket", "tide-{k}"), ("obj.folder", "charts_{k}"), ("obj.server", "beacon-{k}.dock.intra")]),
    "package": ("<project><groupId>net.harbourco{k}.ferry{k}</groupId></project>", [("obj.package", "harbourco{k}"), ("obj.package", "ferry{k}")]),
    "path": ("C:\\Users\\pilot{k}\\berths_{k}\\log.txt", [("obj.user", "pilot{k}"), ("obj.folder", "berths_{k}")]),
    "system-path": ("tail -f /var/data/moorings_{k}/east{k}/today", [("obj.folder", "moorings_{k}"), ("obj.folder", "east{k}")]),
    "network-user": ("rsync -a ./out keeper{k}@lamp-{k}:/tmp", [("obj.user", "keeper{k}"), ("obj.server", "lamp-{k}")]),
    "cloud": ("see arn:aws:dynamodb:eu-west-3:90817263{k4}:table/ledger-{k}", [("obj.cloud_account", "90817263{k4}"), ("obj.table", "ledger-{k}")]),
    "cloud-url": ("GET https://anvil{k}.vault.azure.net/keys", [("obj.cloud_account", "anvil{k}")]),
    "code-name": ('const QUEUE_NAME = "sparks-{k}"; let x = 3', [("obj.queue", "sparks-{k}")]),
    "code-call": ('frame.write.saveAsTable("forge_{k}.nails_{k}")', [("obj.schema", "forge_{k}"), ("obj.table", "nails_{k}")]),
    "command-line": ("mysqldump -u smith{k} -h bellows-{k} --single-transaction", [("obj.user", "smith{k}"), ("obj.server", "bellows-{k}")]),
    "internal-ip": ("route fd9c:77aa:12:{k4}::1 via eth1", [("obj.server", "fd9c:77aa:12:{k4}::1")]),
    "traceback": ('Traceback\n  File "/code/quench_{k}.py", line 40, in cool_{k}\n    x()\n', [("obj.package", "quench_{k}"), ("obj.procedure", "cool_{k}")]),
    "devops-yaml": ("kind: ServiceAccount\napiVersion: v1\nmetadata:\n  namespace: tannery-{k}\n  name: dyer-{k}\n", [("obj.namespace", "tannery-{k}"), ("obj.user", "dyer-{k}")]),
    "terraform": ('resource "google_pubsub_topic" "t" {\n  name = "hides-{k}"\n  labels = {}\n}\n', [("obj.queue", "hides-{k}")]),
    "bicep": ("resource vat 'Microsoft.Web/sites@2022-09-01' = {\n  name: 'soak-{k}'\n}", [("obj.service", "soak-{k}")]),
    "ansible-ini": ("[vats]\nvat-{k}-1 ansible_host=tub{k}.tan.lan\n", [("obj.server", "vat-{k}-1"), ("obj.server", "tub{k}.tan.lan")]),
    "jenkins": ("stage('x') { node('press-{k}') { sh 'true' } }", [("obj.server", "press-{k}")]),
    "cli-output": ("me@box:~$ oc get namespaces\nNAME   PHASE   AGE\nsaddle-{k}   Active   9d\nharness-{k}   Active   9d\n", [("obj.namespace", "saddle-{k}"), ("obj.namespace", "harness-{k}")]),
    "field": ("titular=Rosa Prado; cracha: Q{k}55", [("name", "Rosa Prado"), ("user", "Q{k}55")]),
    "insert": ("insert into roster (login, nome_titular) values ('Q{k}55', 'Rosa Prado')", [("user", "Q{k}55"), ("name", "Rosa Prado")]),
    "xml-field": ("<row><login>Q{k}55</login></row>", [("user", "Q{k}55")]),
    "name-context": ("streams:\n  - name: kelp-in-{k}\n    size: 2\n  - name: kelp-out-{k}\n", [("obj.queue", "kelp-in-{k}"), ("obj.queue", "kelp-out-{k}")]),
    "infra-ip": ("NAME     TYPE    EXTERNAL-IP\nkelp{k4}  LB      198.18.7.4\n", [("ip", "198.18.7.4")]),
    "names-in-line": ("7;Rosa Prado;rosa.{k}@stall.dev;open\n", [("name", "Rosa Prado")]),
    "pix-code": ("scan 00020101021126330014br.gov.bcb.pix0111314159265905204000053039865802BR5905Stall6006Olinda62070503***6304{crc} now", [("pix", "00020101021126330014br.gov.bcb.pix0111314159265905204000053039865802BR5905Stall6006Olinda62070503***6304{crc}")]),
    "delimited": ("setor\tlogin\ttitular\nsul\tQ{k}55\tRosa Prado\n", [("user", "Q{k}55"), ("name", "Rosa Prado")]),
}

_CODE = CASES["pix-code"][1][0][1]
_SUM = f"{crc16(_CODE.replace('{crc}', '')):04X}"
CASES["pix-code"] = (CASES["pix-code"][0].replace("{crc}", _SUM), [("pix", _CODE.replace("{crc}", _SUM))])


def _literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql(name: str) -> str:
    return f"replace(replace({_literal(name)}, '{{k}}', c_custkey::VARCHAR), '{{k4}}', (1000 + c_custkey % 9000)::VARCHAR)" if "{k" in name else _literal(name)


def rows_of(spark, sf_dir, template: str) -> DataFrame:
    key, four = F.col("c_custkey").cast("string"), (F.col("c_custkey") % 9000 + 1000).cast("string")
    return spread(table(spark, sf_dir, "customer").select("c_custkey")).select("c_custkey", F.replace(F.replace(F.lit(template), F.lit("{k}"), key), F.lit("{k4}"), four).alias("text"))


#: Further shapes: name of the query, (reader, text, expected names); nothing expected: a text that only looks like one.
MORE: dict[str, tuple[str, str, list[tuple[str, str]]]] = {
    "sql_grants": (
        "sql", "GRANT SELECT, INSERT ON TABLE mill_{k}.flour_{k}, mill_{k}.bran_{k} TO ROLE baker_{k};\nREVOKE ALL ON mill_{k}.rye_{k} FROM clerk_{k};\ngrant oven_role{k} to stoker_{k};\ngrant usage on schema attic_{k} to baker_{k}",
        [("obj.schema", "mill_{k}"), ("obj.table", "flour_{k}"), ("obj.table", "bran_{k}"), ("obj.user", "baker_{k}"), ("obj.table", "rye_{k}"), ("obj.user", "clerk_{k}"), ("obj.user", "oven_role{k}"), ("obj.user", "stoker_{k}"), ("obj.schema", "attic_{k}")],
    ),
    "sql_no_grants": ("sql", "we grant access on monday to item_{k}; they revoke nothing from desk_{k}\ngrant me time to rest_{k} a while", []),
    "error_owners": (
        "error", "ORA-00942: table or view \"MILLS{k}\".\"GRAIN_T{k}\" does not exist\nORA-01031: denied on \"MILLS{k}\".\"BRAN_T{k}\".\"SACKS_{k}\"\nERROR: relation \"fold_{k}.pens_{k}\" does not exist",
        [("obj.schema", "MILLS{k}"), ("obj.table", "GRAIN_T{k}"), ("obj.table", "BRAN_T{k}"), ("obj.column", "SACKS_{k}"), ("obj.schema", "fold_{k}"), ("obj.table", "pens_{k}")],
    ),
    "error_none": ("error", "the error in \"Chapter{k}\" and \"Verse{k}\" was found; table \"of {k}\" contents", []),
    "table_records": (
        "table", "-[ RECORD 1 ]------\nschemaname | fold_{k}\ntablename  | ewes_{k}\nrows       | 12\n-[ RECORD 2 ]------\nschemaname | fold_{k}\ntablename  | rams_{k}\nrows       | 7\n",
        [("obj.schema", "fold_{k}"), ("obj.table", "ewes_{k}"), ("obj.table", "rams_{k}")],
    ),
    "table_rows": ("table", "*************************** 1. row ***************************\ntable_name: hives_{k}\n      rows: 12\n*************************** 2. row ***************************\ntable_name: combs_{k}\n      rows: 3\n", [("obj.table", "hives_{k}"), ("obj.table", "combs_{k}")]),
    "table_no_records": ("table", "-[ RECORD 1 ]------\ncolour | red_{k}\nsize   | big_{k}\n", []),
    "arm": (
        "arm", '{{"resources":[{{"type":"Microsoft.Storage/storageAccounts","tags":{{"name":"not_{k}"}},"name":"millstore{k}"}},{{"name":"chute{k}/spout-{k}","type":"Microsoft.ServiceBus/namespaces/queues"}}]}}'.replace("{{", "{").replace("}}", "}"),
        [("obj.cloud_account", "millstore{k}"), ("obj.namespace", "chute{k}"), ("obj.queue", "spout-{k}")],
    ),
    "template_paths": (
        "sql", "render {{ flock{k}.ewes_{k} | count }}\nSELECT wool_g{k} FROM flock{k}.rams_{k} WHERE shorn_{k} = 1;\nSELECT a_{k} FROM fold_{k}.pens_{k} WHERE b_{k} = 2",
        [("obj.column", "wool_g{k}"), ("obj.column", "shorn_{k}"), ("obj.column", "a_{k}"), ("obj.schema", "fold_{k}"), ("obj.table", "pens_{k}"), ("obj.column", "b_{k}")],
    ),
    "template_connections": ("connection", "postgres://user1:x@host1/dbName or mysql://user:p@dbHost/db01 but mongodb://reader_{k}:q@grove-{k}/harvest_{k}", [("obj.user", "reader_{k}"), ("obj.server", "grove-{k}"), ("obj.database", "harvest_{k}")]),
    "arm_none": ("arm", '{"type":"Microsoft.Web/sites","name":"[parameters(\'site{k}\')]"} {"type": "other/x", "name": "plain-{k}"}', []),
}


def _reader_query(rule: str, name: str | None = None) -> None:
    rule, text, expected = MORE[name] if name else (rule, *CASES[rule])

    def run(spark, sf_dir):
        return read_names(rows_of(spark, sf_dir, text), readers=(rule,)).select("c_custkey", F.inline("names")).select("c_custkey", "type", "real").distinct()

    run.__name__ = "read_" + (name or rule.replace("-", "_"))
    query(" UNION ".join(f"SELECT c_custkey, {_literal(t)} AS type, {_sql(n)} AS real FROM customer" for t, n in expected) or "SELECT c_custkey, '' AS type, '' AS real FROM customer WHERE false")(run)


for _rule in CASES:
    _reader_query(_rule)
for _name in MORE:
    _reader_query("", _name)


@query("SELECT doc_id, type, real || doc_id || '.dock.lan' AS real FROM documents, (VALUES ('obj.server', 'relay-'), ('obj.server', 'buoy-')) t(type, real)")
def read_documents(spark, sf_dir):
    """All readers over whole documents, each with a line of configuration in front of it and one behind it: these names, and no other."""
    line = lambda name: F.concat(F.lit(f"host: {name}-"), F.col("doc_id").cast("string"), F.lit(".dock.lan\n"))
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", F.concat(line("relay"), F.coalesce("text", F.lit("")), F.lit("\n"), line("buoy")).alias("text")))
    return read_names(docs).select("doc_id", F.inline("names")).select("doc_id", "type", "real").distinct()


@query("SELECT 'pages' AS source, count(*) AS n_texts, 0::BIGINT AS n_names FROM pages UNION ALL SELECT 'conversations', count(*), 0 FROM conversations UNION ALL SELECT 'events', count(*), 0 FROM events")
def read_nothing(spark, sf_dir):
    """All readers over whole tables of prose, markup and JSON without a name in it."""
    out = None
    for name, column in (("pages", "html"), ("conversations", "text"), ("events", "props")):
        one = read_names(spread(table(spark, sf_dir, name).select(F.lit(name).alias("source"), F.col(column).alias("text"))))
        one = one.groupBy("source").agg(F.count("*").alias("n_texts"), F.coalesce(F.sum(F.size("names")), F.lit(0)).cast("long").alias("n_names"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT c_custkey, true AS same FROM customer")
def mask_objects_roundtrip(spark, sf_dir):
    """Configuration text with its names masked and put back."""
    source = rows_of(spark, sf_dir, "\n".join(CASES[r][0] for r in ("key-value", "sql", "address")))
    found = read_names(source).withColumn("findings", F.col("names").cast(mask.T.SPANS)).drop("names")
    masked = written(mask.mask(found, catalog.TEST_KEY), "masked-names")
    back = mask.unmask(masked.select("c_custkey", "text"), mask.reverse_table(mask.mapping(masked, "c_custkey"), "c_custkey"), "c_custkey")
    return back.join(source.withColumnRenamed("text", "source"), "c_custkey").select("c_custkey", (F.col("text") == F.col("source")).alias("same"))


# --- conversations ---------------------------------------------------------------------------------------------------------------------------


@query("SELECT conv_id, count(*) AS n, count(DISTINCT turn) AS positions FROM conversations GROUP BY 1")
def position_chain(spark, sf_dir):
    """Each turn has a position of its own."""
    p = conversation.positions(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return p.groupBy("conv_id").agg(F.count("*").alias("n"), F.count_distinct("position").alias("positions"))


def _bodies(spark, sf_dir) -> DataFrame:
    """Each conversation as a request of the completions shape."""
    message = F.struct("turn", F.col("role"), F.coalesce("text", F.lit("")).alias("content"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(message)), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))).alias("body"))


@query("SELECT conv_id, role, count(*) AS n, coalesce(sum(length(text)), 0)::BIGINT AS chars FROM conversations GROUP BY 1, 2")
def flatten_requests(spark, sf_dir):
    """Conversations as requests of the completions shape, and back as rows."""
    rows, _ = chats.flatten(_bodies(spark, sf_dir), "conv_id")
    return rows.groupBy("conv_id", "role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("""
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, coalesce(text, '')) - 1)::INT AS ord, role, '<' || coalesce(text, '') || '>' AS text FROM conversations""")
def requests_rewritten(spark, sf_dir):
    """Changed texts written back into their requests, and read again."""
    bodies = written(_bodies(spark, sf_dir), "bodies")
    rows, _ = chats.flatten(bodies, "conv_id")
    back, _ = chats.flatten(chats.rewrite(bodies, rows.withColumn("text", F.concat(F.lit("<"), "text", F.lit(">"))), "conv_id"), "conv_id")
    return back.select("conv_id", "ord", "role", "text")


@query("SELECT conv_id, count(*) AS n, true AS same FROM conversations GROUP BY 1")
def requests_masked_and_restored(spark, sf_dir):
    """Requests masked by all parts, each conversation a scope, written back, and unmasked."""
    bodies = written(_bodies(spark, sf_dir), "bodies")
    rows, _ = chats.flatten(bodies, "conv_id")
    rows = written(rows, "rows")
    masked = written(corpus.mask_corpus(rows, catalog.TEST_KEY, config=catalog.OPEN, scope="conv_id", order=("conv_id", "ord")), "masked")
    sent, _ = chats.flatten(chats.rewrite(bodies, masked.select("conv_id", "ord", "text"), "conv_id"), "conv_id")
    back = mask.unmask(sent.select("conv_id", "ord", "text"), mask.reverse_table(mask.mapping(masked, "conv_id"), "conv_id"), "conv_id")
    both = back.join(rows.select("conv_id", "ord", F.col("text").alias("source")), ["conv_id", "ord"])
    return both.groupBy("conv_id").agg(F.count("*").alias("n"), F.bool_and(F.col("text") == F.col("source")).alias("same"))


@query("SELECT c_custkey, shape, 'kelp ' || c_custkey || ' 529.982.247-25 end' AS text FROM customer, (VALUES ('messages'), ('completions'), ('responses'), ('contents')) s(shape)")
def answers_of_four_shapes(spark, sf_dir):
    """Streamed answers in pieces, unmasked event by event in each shape."""
    from .streaming.events import Answer

    make = {
        "messages": lambda x: {"type": "content_block_delta", "index": 0, "delta": {"type": "text_delta", "text": x}}, "completions": lambda x: {"choices": [{"index": 0, "delta": {"content": x}}]},
        "responses": lambda x: {"type": "response.output_text.delta", "item_id": "i", "content_index": 0, "delta": x}, "contents": lambda x: {"candidates": [{"content": {"parts": [{"text": x}]}}]},
    }
    ends = {
        "messages": {"type": "content_block_stop", "index": 0}, "completions": {"choices": [{"index": 0, "delta": {}, "finish_reason": "stop"}]}, "responses": {"type": "response.completed"}, "contents": {"candidates": [{"content": {"parts": []}, "finishReason": "STOP"}]},
    }

    def run(batches):
        import pyarrow as pa

        pairs = {"CPF-o5c4344k": "529.982.247-25"}
        like = Answer(pairs)
        for b in batches:
            keys, shapes, texts = [], [], []
            for k in b.column(0).to_pylist():
                text, step = f"kelp {k} CPF-o5c4344k end", k % 5 + 1
                for shape, event in make.items():
                    answer = Answer(pairs, like=like)
                    lines = [x for i in range(0, len(text), step) for x in answer.push(json.dumps(event(text[i : i + step]))).split("\n")] + answer.push(json.dumps(ends[shape])).split("\n")
                    keys.append(k)
                    shapes.append(shape)
                    texts.append("".join(p.holder[p.key] for x in lines for p in chats.pieces(json.loads(x))[0]))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(shapes), pa.array(texts)], ["c_custkey", "shape", "text"])

    return spread(table(spark, sf_dir, "customer").select("c_custkey")).mapInArrow(run, "c_custkey long, shape string, text string")


@query("SELECT c_custkey, 'login' AS label, 'QX' || c_custkey || v AS value FROM customer, (VALUES ('Z'), ('Y')) t(v)")
def cut_columns(spark, sf_dir):
    """Values cut out of a file, under the header that the conversation saw before."""
    k = F.col("c_custkey").cast("string")
    turns = F.array(
        F.struct(F.lit(1).alias("ord"), F.lit("head -n 2 herd.csv").alias("call_text"), F.lit("no;login;sector\n1;a;b").alias("text")),
        F.struct(F.lit(2).alias("ord"), F.lit("cut -d';' -f2 herd.csv | tail -n +2").alias("call_text"), F.concat(F.lit("QX"), k, F.lit("Z\nQX"), k, F.lit("Y\n")).alias("text")),
        F.struct(F.lit(3).alias("ord"), F.lit("awk -F, '{print $2}' other.csv").alias("call_text"), F.lit("unseen").alias("text")),
    )
    calls = table(spark, sf_dir, "customer").select("c_custkey", F.inline(turns))
    return conversation.cut_columns(calls, "c_custkey").select("c_custkey", "label", "value")


@query("SELECT c_custkey, 'obj.queue' AS type, name || c_custkey AS name FROM customer, (VALUES ('kelp_in'), ('kelp_out')) t(name)")
def anchored_lists(spark, sf_dir):
    """Items of a list take the type of its known member; tuples, calls and lists of words don't."""
    texts = rows_of(spark, sf_dir, "use ['kelp_mid{k}', 'kelp_in{k}', 'kelp_out{k}'] but call(['red', 'kelp_mid{k}']) and ('kelp_mid{k}', 'kelp_no{k}')")
    names = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("kelp_mid"), "c_custkey").alias("name"), F.lit("obj.queue").alias("type"))
    return conversation.anchored_lists(conversation.listed(texts, "c_custkey"), names, "c_custkey").select("c_custkey", "type", "name")


@query("SELECT o_orderkey % 10 AS name, CASE WHEN o_orderkey % 10 < 5 THEN 'a' ELSE 'b' END AS type FROM orders GROUP BY ALL")
def first_decider(spark, sf_dir):
    """Of several deciders the first that knows a name decides."""
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 10).alias("name"))
    return conversation.decided(o.where("name < 5").withColumn("type", F.lit("a")), o.withColumn("type", F.lit("b")))


@query("SELECT o_orderkey, ['namespace', 'table', 'service', NULL][(o_orderkey % 4 + 1)::INT] AS entity FROM orders")
def requested_entities(spark, sf_dir):
    commands = F.array(*map(F.lit, ("kubectl get ns", "SHOW TABLES", "kubectl get pods -o wide", "make build")))
    return table(spark, sf_dir, "orders").select("o_orderkey", conversation.requested_entity(F.element_at(commands, (F.col("o_orderkey") % 4 + 1).cast("int"))).alias("entity"))


@query("""
WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[A-Za-z]{4,}')) AS real FROM conversations),
names AS (SELECT conv_id, min(real) AS name FROM w WHERE turn = 0 GROUP BY 1)
SELECT conv_id, name, count(DISTINCT turn) AS turns FROM names JOIN (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_][\\p{L}\\p{N}_.\\-]*[\\p{L}\\p{N}_]')) AS word FROM conversations) x USING (conv_id) WHERE word = name GROUP BY 1, 2""".replace("\\\\", "\\"))
def conversation_memory(spark, sf_dir):
    """In how many turns a name decided in the first turn stands."""
    c = table(spark, sf_dir, "conversations")
    words = c.where("turn = 0").select("conv_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0))).alias("real"))
    names = words.groupBy("conv_id").agg(F.min("real").alias("real")).select("conv_id", "real", F.lit("obj.service").alias("type"), F.lit(0).alias("ord"), F.lit(0).alias("start"))
    known = conversation.memory(names, "conv_id")
    found = conversation.remembered(c, known, "conv_id", "turn")
    return found.groupBy("conv_id", F.col("real").alias("name")).agg(F.count_distinct("turn").alias("turns"))


@query("""
WITH s AS (SELECT user_id, event_id, length(event_type) AS n, lag(length(event_type)) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)
SELECT user_id, count(*) FILTER (p IS NULL OR abs(n - p) > 1) AS blocks FROM s GROUP BY 1""")
def record_blocks(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.length("event_type").alias("n"))
    return conversation.line_blocks(e, "user_id", "event_id", "n").groupBy("user_id").agg(F.max("block").alias("blocks"))


@query("""
WITH i AS (SELECT c_nationkey AS block, c_custkey, CASE WHEN c_custkey % 3 > 0 THEN 'table' END AS type FROM customer),
s AS (SELECT block, count(*) AS size, count(type) AS n FROM i GROUP BY 1)
SELECT c_custkey, 'table' AS type FROM i JOIN s USING (block) WHERE type IS NULL AND size >= 3 AND 2 * n >= size""")
def homogeneous_lists(spark, sf_dir):
    items = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("block"), "c_custkey", F.when(F.col("c_custkey") % 3 > 0, "table").alias("type"))
    return conversation.homogeneous(items, "block").select("c_custkey", "type")


@query("""
WITH i AS (SELECT o_custkey % 50 AS block, o_orderkey % 4 AS ord, 'n' || (o_orderkey % 40) AS name, CASE WHEN o_orderkey % 8 < 2 THEN 'table' END AS type FROM orders),
k AS (SELECT block, ord FROM i WHERE type IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT name) >= 2)
SELECT block, ord, count(*) AS n FROM i JOIN k USING (block, ord) WHERE type IS NULL GROUP BY 1, 2""")
def anchor_positions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("block"), (F.col("o_orderkey") % 4).alias("ord"), F.concat(F.lit("n"), F.col("o_orderkey") % 40).alias("name"), F.when(F.col("o_orderkey") % 8 < 2, "table").alias("type"))
    return conversation.anchored(o, "block", "ord").groupBy("block", "ord").agg(F.count("*").alias("n"))


@query("SELECT doc_id, true AS same FROM documents")
def frozen_replay(spark, sf_dir):
    """What was sent for a text comes out the same from its stored edits."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    masked = written(mask.mask(docs, catalog.TEST_KEY, config=catalog.OPEN), "masked")
    at = docs.select("doc_id", F.sha2("text", 256).alias("position"))
    back = sinks.replay(docs.join(at, "doc_id"), sinks.record_sent(masked, at, "doc_id"), "doc_id")
    return back.join(masked.select("doc_id", F.col("text").alias("first")), "doc_id").select("doc_id", (F.col("frozen") == F.col("first")).alias("same"))


@query("SELECT o_orderkey, 'image/png' AS media, length('x' || o_orderkey)::INT AS n FROM orders")
def data_urls(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("data:image/png;base64,"), F.base64(F.concat(F.lit("x"), F.col("o_orderkey").cast("string")).cast("binary"))).alias("u"))
    return o.select("o_orderkey", chats.data_url("u").alias("d")).select("o_orderkey", "d.media", F.octet_length("d.data").alias("n"))


@query("SELECT c_custkey, 'caiu em ' || c_custkey || ' 529.982.247-25 fim' AS text FROM customer")
def unmask_stream_batch(spark, sf_dir):
    """Pieces of masked texts through the streaming operator's chunk logic, as one text again."""
    from .streaming.unmask import Chunks

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for k in b.column(0).to_pylist():
                c, text = Chunks({"CPF-o5c4344k": "529.982.247-25"}), f"caiu em {k} CPF-o5c4344k fim"
                step = k % 7 + 1
                out.append("".join(c.push(text[i : i + step]) for i in range(0, len(text), step)) + c.close())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], ["c_custkey", "text"])

    return spread(table(spark, sf_dir, "customer").select("c_custkey")).mapInArrow(run, "c_custkey long, text string")


REQUEST = json.dumps({"system": "s", "messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": [{"type": "tool_use", "id": "t1", "name": "bash", "input": {"command": "kubectl get pods"}}]}, {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": "pod-x-1 Running\n"}]}]})


@query("SELECT c_custkey, 'service' AS entity, 'pod-x-1' AS name FROM customer")
def call_hints(spark, sf_dir):
    """Names in a tool's output, typed by the command that printed them."""
    rows, _ = chats.flatten(table(spark, sf_dir, "customer").select("c_custkey", F.lit(REQUEST).alias("body")), "c_custkey")
    return conversation.hinted_names(conversation.calls_and_results(rows, "c_custkey"), "c_custkey").select("c_custkey", "entity", "name")


@query("SELECT c_custkey, 'obj.queue' AS type, 'fila-' || c_custkey AS real FROM customer")
def sensitive_udtf(spark, sf_dir):
    """Readers as a table function of SQL."""
    register(spark)
    rows_of(spark, sf_dir, "queue: fila-{k}\n").createOrReplaceTempView("cloakstone_rows")
    return spark.sql("SELECT c_custkey, f.type, f.real FROM cloakstone_rows, LATERAL find_sensitive(text) f")


@query("SELECT c_custkey, 'obj.server' AS type, 'db-x-' || c_custkey || '.interno' AS real, 14 AS start FROM customer")
def read_through_transport(spark, sf_dir):
    """Names behind line numbers and terminal colours, at their places in the source."""
    found = read_names(rows_of(spark, sf_dir, "1\tport: 9\n2\thost: \x1b[1mdb-x-{k}.interno\x1b[0m\n"), readers=("key-value",))
    return found.select("c_custkey", F.inline("names")).select("c_custkey", "type", "real", (F.col("start") - 8).alias("start"))


# --- people, mail, software, collisions, quarantine ---------------------------------------------------------------------------------------------


@query("SELECT c_custkey, 'ANA LIMA ' || chr((65 + c_custkey % 26)::INT) || 'X' AS candidate FROM customer")
def people_match(spark, sf_dir):
    """Registered names in texts, met by their hashes."""
    people = spark.range(26).select(F.concat(F.lit("Ana Lima "), F.char(F.col("id") + 65), F.lit("x")).alias("name"), F.concat(F.lit("p"), "id", F.lit("@acme.dev")).alias("email"), F.concat(F.lit("C"), "id").alias("code"))
    registry = known.import_people(people, catalog.TEST_KEY)
    texts = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("fale com Ana Lima "), F.char(F.col("c_custkey") % 26 + 65), F.lit("x; ok")).alias("text"))
    return known.find_people(texts, registry, catalog.TEST_KEY, "c_custkey").where(F.size(F.split("candidate", " ")) == 3).select("c_custkey", "candidate")


@query(r"SELECT DISTINCT 'domain' AS type, regexp_extract(lower(m), '@([^@]*)$', 1) AS real FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+')) AS m FROM documents) WHERE regexp_extract(lower(m), '@([^@]*)$', 1) NOT LIKE '%.invalid'")
def mail_domains(spark, sf_dir):
    found = catalog.detect.exploded(catalog.detect.detect(table(spark, sf_dir, "documents").select("doc_id", "text"), config=catalog.OPEN, only=("email",)), "doc_id")
    return known.mail_names(found).where("type = 'domain'")


@query("SELECT DISTINCT 'lib' || (c_custkey % 40) AS name, 'install' AS kind FROM customer WHERE c_custkey % 40 <> 7")
def software_evidence(spark, sf_dir):
    """Installed packages, but not the one that some text defines itself."""
    texts = table(spark, sf_dir, "customer").select(F.concat(F.lit("pip install lib"), F.col("c_custkey") % 40, F.when(F.col("c_custkey") % 40 == 7, "\ndef lib7():\n").otherwise("\n")).alias("text"))
    return known.software_proofs(texts).select("name", "kind")


@query("SELECT 'P' || (o_orderkey % 100) AS pseudo, count(DISTINCT o_custkey % 3) AS n_values FROM orders GROUP BY 1 HAVING count(DISTINCT o_custkey % 3) > 1")
def collided_pseudonyms(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select(F.concat(F.lit("P"), F.col("o_orderkey") % 100).alias("pseudo"), (F.col("o_custkey") % 3).cast("string").alias("real"), F.lit("secret").alias("type"))
    return mask.collisions(t).select("pseudo", "n_values")


@query("SELECT o_orderkey, 'edit script does not fit the text' AS reason FROM orders WHERE o_orderkey % 10 = 0")
def quarantined_rows(spark, sf_dir):
    """Rows whose edits don't fit their text are rejected, never passed on."""
    e = F.struct(F.lit(1).alias("start"), F.when(F.col("o_orderkey") % 10 == 0, 99).otherwise(2).alias("end"), F.lit("t").alias("type"), F.lit("P").alias("pseudo"), F.lit("b").alias("real"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.lit("abc").alias("text"), F.array(e).alias("edits"))
    return mask.quarantined(rows.withColumn("text", mask.spliced(F.col("text"), F.col("edits"))), "o_orderkey")[1]


# --- all parts together -------------------------------------------------------------------------------------------------------------------------


def _parted(spark, sf_dir, *templates: str) -> DataFrame:
    """c_custkey, part, text: each template as a text of its own."""
    texts = None
    for i, t in enumerate(templates):
        one = rows_of(spark, sf_dir, t).withColumn("part", F.lit(i))
        texts = one if texts is None else texts.unionByName(one)
    return texts


def _object_sql(prefix: str, domain: str, name: str) -> str:
    return f"'{prefix}_' || {Q.keyed_id(catalog.TEST_KEY.secret, 'objeto', f"'{domain}' || chr(0) || {name}")}"


_BARREL = "'barrel-' || c_custkey || 'x'"


@query(f"""
SELECT c_custkey, 0 AS part, 'queue: ' || {_object_sql("top", "fila", _BARREL)} || chr(10) AS text FROM customer
UNION ALL SELECT c_custkey, 1, 'please drain ' || {_object_sql("top", "fila", _BARREL)} || ' today' FROM customer
UNION ALL SELECT c_custkey, 2, 'a barrel and a queue' FROM customer""")
def mask_corpus_names(spark, sf_dir):
    """A name that a reader finds in one text is masked in others, where nothing but its spelling tells."""
    texts = _parted(spark, sf_dir, "queue: barrel-{k}x\n", "please drain barrel-{k}x today", "a barrel and a queue")
    return corpus.mask_corpus(texts, catalog.TEST_KEY, order=("c_custkey", "part")).select("c_custkey", "part", "text")


_COLUMN = "'tension_n' || c_custkey"


@query(f"""
SELECT c_custkey AS conv, 0 AS part, 'what is ' || {_object_sql("c", "coluna", _COLUMN)} || ' for?' AS text FROM customer
UNION ALL SELECT -1 - c_custkey, 0, 'what is tension_n' || c_custkey || ' for?' FROM customer""")
def mask_corpus_memory(spark, sf_dir):
    """A column's name counts in the conversation that brought it, and in no other."""
    k = F.col("c_custkey")
    first = rows_of(spark, sf_dir, "SELECT tension_n{k} FROM warp_9 WHERE spool_9 = 1").select(k.alias("conv"), F.lit(-1).alias("part"), "text")
    later = rows_of(spark, sf_dir, "what is tension_n{k} for?").select(F.explode(F.array(k, -1 - k)).alias("conv"), F.lit(0).alias("part"), "text")
    out = corpus.mask_corpus(first.unionByName(later), catalog.TEST_KEY, scope="conv", order=("conv", "part"))
    return out.where("part = 0").select("conv", "part", "text")


@query(f"""SELECT c_custkey, 'ask Person ' || {Q.keyed_id(catalog.TEST_KEY.secret, 'email', "'p' || (c_custkey % 26) || '@stall.dev'")} || ' or USER-' || {Q.keyed_id(catalog.TEST_KEY.secret, 'email', "'p' || (c_custkey % 26) || '@stall.dev'")} || ' now' AS text FROM customer""")
def mask_corpus_people(spark, sf_dir):
    """Registered people by name and by code, under one id for each."""
    people = spark.range(26).select(F.concat(F.lit("Rosa Prado "), F.char(F.col("id") + 65), F.lit("x")).alias("name"), F.concat(F.lit("p"), "id", F.lit("@stall.dev")).alias("email"), F.concat(F.lit("QX"), "id", F.lit("Z")).alias("code"))
    texts = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("ask Rosa Prado "), F.char(F.col("c_custkey") % 26 + 65), F.lit("x or QX"), F.col("c_custkey") % 26, F.lit("Z now")).alias("text"))
    return corpus.mask_corpus(texts, catalog.TEST_KEY, registry=known.import_people(people, catalog.TEST_KEY), order=("c_custkey",)).select("c_custkey", "text")


@query("SELECT doc_id, true AS same FROM documents")
def mask_corpus_roundtrip(spark, sf_dir):
    """Conversations' and documents' texts as one corpus, masked by all parts and put back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\nhost: relay-"), F.col("doc_id").cast("string"), F.lit(".dock.lan\nlink to relay-"), (F.col("doc_id") + 1).cast("string"), F.lit(".dock.lan\n")).alias("text"))
    masked = written(corpus.mask_corpus(docs, catalog.TEST_KEY, config=catalog.OPEN, order=("doc_id",)), "masked")
    back = mask.unmask(masked.select("doc_id", "text"), mask.reverse_table(mask.mapping(masked, "doc_id"), "doc_id"), "doc_id")
    return back.join(docs.withColumnRenamed("text", "source"), "doc_id").select("doc_id", (F.col("text") == F.col("source")).alias("same"))


_GRAIN = "'grain_' || c_custkey || 'x'"
_MASKED_GRAIN = _object_sql("db", "database", _GRAIN)
#: Places in which a learned name stands whole, and words that only hold it.
SURROUNDINGS = ("see fin.{} now", "{}/part-0", "{}.ewes", "[{}]", "({})", "a, {}; b", "über.{}", "<{}>", "x|{}|y", "line\\n{} in a log", "is it {}?", "**{}**")
NEAR_MISSES = ("{}y", "my-{}", "{}_old", "{}-b", "a{}", "{}$", "#{}", "é{}", "{}é", "{}7", "_{}", "x_{}")


def _all_of(templates: tuple[str, ...], name: str) -> str:
    return " || chr(10) || ".join("(" + " || ".join([_literal(t.split("{}")[0]), name, _literal(t.split("{}")[1])]) + ")" for t in templates)


@query(f"""
SELECT c_custkey, 1 AS part, {_all_of(SURROUNDINGS, _MASKED_GRAIN)} AS text FROM customer
UNION ALL SELECT c_custkey, 2, {_all_of(NEAR_MISSES, _GRAIN)} FROM customer""")
def mask_corpus_surroundings(spark, sf_dir):
    """A learned name within qualified names, paths, brackets and beside other letters; names that only contain it stay."""
    lines = lambda ts: "\n".join(t.format("grain_{k}x") for t in ts)
    texts = _parted(spark, sf_dir, "database: grain_{k}x\n", lines(SURROUNDINGS), lines(NEAR_MISSES))
    return corpus.mask_corpus(texts, catalog.TEST_KEY, order=("c_custkey", "part"), readers=("key-value",)).where("part > 0").select("c_custkey", "part", "text")


@query(f"SELECT c_custkey, 'then ' || CASE WHEN c_custkey % 2 = 0 THEN {_GRAIN} ELSE {_MASKED_GRAIN} END || ' again' AS text FROM customer")
def mask_corpus_second_run(spark, sf_dir):
    """What an earlier run learned, from its table of hashes alone; names that were last seen too long ago stay."""
    kept = f"{shared_dir(spark)}/seen-{uuid.uuid4().hex}"
    first = lambda part, day, seen, to: corpus.find_corpus(rows_of(spark, sf_dir, "database: grain_{k}x\n").where(f"c_custkey % 2 = {part}"), catalog.TEST_KEY, order=("c_custkey",), today=day, seen=seen, remember=to)
    first(0, 100, None, kept + "-a")
    first(1, 180, spark.read.parquet(kept + "-a"), kept + "-b")
    return corpus.mask_corpus(rows_of(spark, sf_dir, "then grain_{k}x again"), catalog.TEST_KEY, order=("c_custkey",), seen=spark.read.parquet(kept + "-b"), today=200).select("c_custkey", "text")


@query(f"""
SELECT c_custkey, 1 AS conv, 'so ' || {_GRAIN} || ' it is' AS text FROM customer
UNION ALL SELECT c_custkey, 2, 'so ' || {_object_sql("db", "database", "'silo_' || c_custkey || 'x'")} || ' it is' FROM customer""")
def mask_corpus_origin(spark, sf_dir):
    """A name that the model wrote before the data had it teaches nothing; one that the data brought does."""
    rows = (
        ("1", 1, "assistant", "try grain_{k}x"), ("1", 2, "user", "database: grain_{k}x\n"), ("1", 3, "user", "so grain_{k}x it is"), ("2", 1, "user", "database: silo_{k}x\n"), ("2", 2, "assistant", "try silo_{k}x"),
        ("2", 3, "user", "so silo_{k}x it is"),
    )
    texts = None
    for conv, turn, role, text in rows:
        one = rows_of(spark, sf_dir, text).select("c_custkey", F.concat_ws("-", "c_custkey", F.lit(conv)).alias("conv"), F.lit(turn).alias("turn"), F.lit(role).alias("role"), "text")
        texts = one if texts is None else texts.unionByName(one)
    out = corpus.mask_corpus(texts, catalog.TEST_KEY, scope="conv", order=("conv", "turn"), origin="role")
    return out.where("turn = 3").select("c_custkey", F.split("conv", "-")[1].cast("int").alias("conv"), "text")


def _svc(name: str) -> str:
    return _object_sql("svc", "servico", f"'{name}' || c_custkey || 'x'")


@query(f"""
SELECT c_custkey, 0 AS part, 'service: ' || {_svc('kiln')} || chr(10) || chr(10) || {_svc('kiln')} || ' up 3' || chr(10) || {_svc('wheel')} || ' up 5' || chr(10) || {_svc('clay')} || ' up 3' || chr(10) AS text FROM customer
UNION ALL SELECT c_custkey, 1, 'restart ' || {_svc('clay')} || ' now' FROM customer
UNION ALL SELECT c_custkey, 2, 'service: ' || {_svc('kiln')} || chr(10) || 'pens = [' || chr(39) || {_svc('kiln')} || chr(39) || ', ' || chr(39) || {_svc('oven')} || chr(39) || ']' FROM customer""")
def mask_corpus_deciders(spark, sf_dir):
    """Parallel records and lists beside a known name: what they decide is masked there and in other texts."""
    texts = _parted(spark, sf_dir, "service: kiln{k}x\n\nkiln{k}x up 3\nwheel{k}x up 5\nclay{k}x up 3\n", "restart clay{k}x now", "service: kiln{k}x\npens = ['kiln{k}x', 'oven{k}x']")
    decide = deciders.in_order(deciders.by_identity, deciders.by_list)
    return corpus.mask_corpus(texts, catalog.TEST_KEY, order=("c_custkey", "part"), readers=("key-value",), more=(decide,)).select("c_custkey", "part", "text")


@query(f"""SELECT c_custkey, {_object_sql("t", "tabela", "'barley'")} || '.load()  # of barley' AS text FROM customer""")
def mask_corpus_words(spark, sf_dir):
    """A table's name that is a plain word: within its conversation it's masked in code, and stays in a comment."""
    texts = _parted(spark, sf_dir, "SELECT acres_{k} FROM barley WHERE acres_{k} > 2", "barley.load()  # of barley")
    out = corpus.mask_corpus(texts, catalog.TEST_KEY, order=("c_custkey", "part"), scope="c_custkey", words=True, readers=("sql",))
    return out.where("part = 1").select("c_custkey", "text")


@query("""
WITH p AS (SELECT DISTINCT o_custkey % 3 AS doc, o_orderkey * 37 % 200000 AS a, o_orderkey * 37 % 200000 + 1 + o_orderkey % 50 AS z FROM orders),
s AS (SELECT c_custkey % 3 AS doc, c_custkey * 7919 % 200000 AS a, c_custkey * 7919 % 200000 + 1 + CASE WHEN c_custkey % 50 = 0 THEN 30000 ELSE c_custkey % 300 END AS z, c_custkey AS tag FROM customer)
SELECT p.doc, p.a, p.z, max_by(s.tag, (s.a, s.z, s.tag)) AS tag FROM p JOIN s ON s.doc = p.doc AND s.a < p.z AND p.a < s.z GROUP BY ALL""")
def last_overlapping_spans(spark, sf_dir):
    """The last of the spans of a document that overlaps each place, without all pairs: three documents hold all rows."""
    o, c = F.col("o_orderkey"), F.col("c_custkey")
    places = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 3).alias("doc"), (o * 37 % 200000).alias("start"), (o * 37 % 200000 + 1 + o % 50).alias("end")).distinct()
    spans = table(spark, sf_dir, "customer").select((c % 3).alias("doc"), (c * 7919 % 200000).alias("start"), (c * 7919 % 200000 + 1 + F.when(c % 50 == 0, 30000).otherwise(c % 300)).alias("end"), c.alias("tag"))
    return intervals.last_overlapping(places, spans, "doc", carry=("tag",)).where("tag is not null").select("doc", F.col("start").alias("a"), F.col("end").alias("z"), "tag")


_TOKEN_SQL = "'ghp_' || lpad(c_custkey::VARCHAR, 8, '0') || 'abcdefghijABCDEFGHIJ0123456789'"


@query(f"SELECT c_custkey, to_base64(encode({_TOKEN_SQL})) AS real FROM customer UNION ALL SELECT c_custkey, {_TOKEN_SQL} FROM customer")
def read_encoded(spark, sf_dir):
    """Tokens inside base64 and percent escapes, and encoded words without one."""
    token = F.concat(F.lit("ghp_"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"), F.lit("abcdefghijABCDEFGHIJ0123456789"))
    coded = lambda v: F.base64(F.encode(v, "UTF-8"))
    text = F.concat(F.lit("data: "), coded(F.concat(F.lit("user: "), token, F.lit(" and more"))), F.lit(" or q=%20"), token, F.lit("%26b or "), coded(F.concat(F.lit("plain words of "), "c_name")))
    return read_names(table(spark, sf_dir, "customer").select("c_custkey", text.alias("text")), readers=("encoded",)).select("c_custkey", F.inline("names")).select("c_custkey", "real")


@query("""
WITH e AS (SELECT user_id, event_id, ts, 'obj.' || event_type AS type FROM events)
SELECT 'a' AS scope, user_id::VARCHAR AS name, event_id AS ord, first_value(type) OVER (PARTITION BY user_id ORDER BY ts, event_id, type) AS type FROM e""")
def decisions_stream(spark, sf_dir):
    """A streaming query over all events: of each user, what was decided first counts for all later rows."""
    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")
    found = stream.select(F.lit("a").alias("scope"), F.col("user_id").alias("name"), "ts", F.col("event_id").alias("ord"), F.concat(F.lit("obj."), "event_type").alias("type"))
    at = f"{shared_dir(spark)}/decisions-{uuid.uuid4().hex}"
    run_once(first_decisions(found, "3650 days"), at, at + "-state")
    return spark.read.parquet(at).where("state <> 'expired'").select("scope", "name", "ord", "type")


@query(f"""
SELECT c_custkey, part, CASE WHEN part = 2 THEN 'why ' || {_object_sql("c", "coluna", _COLUMN)} || '?' ELSE 'why tension_n' || c_custkey || '?' END AS text FROM customer, (VALUES (2), (3)) v(part)""")
def mask_corpus_sources(spark, sf_dir):
    """What a file's output teaches reaches the outputs of its copies, and of no other file."""
    steps = (("cat warp.sql", "SELECT tension_n{k} FROM warp_9 WHERE spool_9 = 1"), ("cp warp.sql weft.sql", ""), ("grep n weft.sql", "why tension_n{k}?"), ("cat yarn.sql", "why tension_n{k}?"))
    texts = None
    for part, (command, text) in enumerate(steps):
        one = rows_of(spark, sf_dir, text).select("c_custkey", F.lit(part).alias("part"), F.lit(command).alias("call_text"), "text")
        texts = one if texts is None else texts.unionByName(one)
    out = corpus.mask_corpus(origins.with_source(texts, "c_custkey"), catalog.TEST_KEY, scope="source", order=("c_custkey", "part"), readers=("sql",))
    return out.where("part > 1").select("c_custkey", "part", "text")
