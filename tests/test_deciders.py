import random

from pyspark.sql import functions as F

from cloakstone.functions import ids
from cloakstone.operators import corpus, deciders, intervals

KEY = ids.Key(b"0123456789abcdef0123456789abcdef")


def test_last_overlapping_span_by_brute_force(spark):
    """One key holds most rows, spans are of all lengths, some cover everything, some are equal."""
    rng = random.Random(1)
    key = lambda: rng.choice([1, 1, 1, 2, None])
    places = list({(key(), a := rng.randrange(50_000), a + rng.choice([1, 5, 3000])) for _ in range(400)})
    spans = [(key(), a := rng.randrange(50_000), a + rng.choice([1, 40, 1024, 2000, 70_000]), rng.randrange(5)) for _ in range(300)]
    got = intervals.last_overlapping(spark.createDataFrame(places, "k long, start long, end long"), spark.createDataFrame(spans, "k long, start long, end long, tag int"), "k", carry=("tag",)).collect()
    want = {}
    for k, a, b in places:
        over = [(s, e, t) for q, s, e, t in spans if q == k and s < b and a < e]
        want[k, a, b] = max(over)[2] if over else None
    assert len(got) == len(places) and {(r.k, r.start, r.end): r.tag for r in got} == want
    none = intervals.last_overlapping(spark.createDataFrame(places, "k long, start long, end long"), spark.createDataFrame([], "k long, start long, end long, tag int"), "k", carry=("tag",))
    assert none.where("tag is null").count() == len(places)


def test_segments_and_brakes(spark):
    text = "SELECT barley FROM fold_1 -- barley of the year\nx = 'barley # no comment' # barley\nwe sold the barley and rye today\nsort --barley=3 #3 barley/x"
    texts = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")
    parts = intervals.segments(texts, "id")
    got = {(r.kind, text[r.start : r.end]) for r in parts.collect()}
    assert ("comment", "-- barley of the year") in got and ("quoted", "'barley # no comment'") in got and ("comment", "# barley") in got and ("prose", "we sold the barley and rye today") in got
    assert not any("--barley" in x or x.startswith("#3") for k, x in got if k == "comment")
    at = [i for i in range(len(text)) if text.startswith("barley", i)]
    spans = spark.createDataFrame([(1, i, i + 6, t, "barley") for i in at for t in ("obj.column", "obj.table")] + [(1, 24, 30, "obj.table", "fold_1")], "id int, start int, end int, type string, real string")
    kept = {(r.start, r.type) for r in intervals.braked(spans, parts, "id").collect()}
    code, noted, quoted, noted2, prose, option, path = at
    assert {s for s, t in kept if t == "obj.table"} == {code, quoted, prose, option, path, 24} and {s for s, t in kept if t == "obj.column"} == {code, quoted, option, path}
    _ = noted, noted2


def found(spark, *texts):
    """_id, text, findings: the words between double angle brackets are known services."""
    rows = []
    for i, t in enumerate(texts):
        spans, clean = [], ""
        for k, part in enumerate(t.replace(">>", "<<").split("<<")):
            if k % 2:
                spans.append((len(clean), len(clean) + len(part), "obj.service", part, "r", True))
            clean += part
        rows.append((i, clean, spans))
    return spark.createDataFrame(rows, "_id long, text string, findings array<struct<start:int,end:int,type:string,real:string,rule:string,strong:boolean>>")


def said(df, texts):
    return sorted((r._id, texts[r._id][r.start : r.end], r.type) for r in df.collect())


def test_identity_of_parallel_records(spark):
    texts = [
        "run <<kiln-7>>\n\nNAME STATE AGE\nkiln-7 ready 3d\nwheel-8 ready 4d\nclay-9 down 9d\n", "<<kiln-7>>\nwheel-8\nclay-9\nthen something else happens here\n", "a-1 ready 3\nb-2 ready 4\nc-3 ready 5\n",
        "<<kiln-7>> up\nkiln-7 up\nwheel-8 up\n", "--- | ---\n<<kiln-7>> | up | 3 x\n\"wheel-8\", | up | 4\n2024-01-02 | up | 4\nclay-9 | down | 5\n", "<<kiln-7>> up\nwheel-8 up\n", "",
    ]
    df = found(spark, *texts)
    plain = [t.replace("<<", "").replace(">>", "") for t in texts]
    got = said(deciders.by_identity(df), plain)
    assert got == [(0, "clay-9", "obj.service"), (0, "wheel-8", "obj.service"), (1, "clay-9", "obj.service"), (1, "wheel-8", "obj.service"), (4, "clay-9", "obj.service"), (4, "wheel-8", "obj.service")]
    with_command = df.withColumn("cmd", F.lit("get wheel-8"))
    assert ("wheel-8" not in {x for _, x, _ in said(deciders.by_identity(with_command, command="cmd"), plain)}) and said(deciders.by_identity(df.limit(0)), plain) == []


def test_lists_commands_and_their_order(spark):
    texts = ["pens = ['<<kiln-7>>', 'wheel-8', 'clay-9']", "- <<kiln-7>>\n- wheel-8\n", "f('kiln-7', 'wheel-8')", "x = ['<<kiln-7>>', 'plain words']"]
    df = found(spark, *texts)
    plain = [t.replace("<<", "").replace(">>", "") for t in texts]
    assert said(deciders.by_list(df), plain) == [(0, "clay-9", "obj.service"), (0, "wheel-8", "obj.service"), (1, "wheel-8", "obj.service")]
    out = found(spark, "NAME AGE\npay-db-1 9d\npay-db-2 8d\n").withColumn("cmd", F.lit("kubectl get nodes"))
    both = deciders.in_order(deciders.by_command("cmd"), deciders.by_identity)(out)
    assert said(both, [out.first().text]) == [(0, "pay-db-1", "obj.server"), (0, "pay-db-2", "obj.server")]


def test_what_deciders_say_is_masked_and_learned(spark):
    rows = [(1, "service: kiln7-a\n\nkiln7-a ready 3\nwheel7-b ready 5\nclay7-c ready 3\n"), (2, "restart clay7-c now"), (3, "pens = ['kiln7-a', 'oven7-d']\nservice: kiln7-a\n")]
    df = spark.createDataFrame(rows, "id long, text string")
    plain = {r.id: r.text for r in corpus.mask_corpus(df, KEY, order=("id",)).collect()}
    assert "wheel7-b" in plain[1] and plain[2] == rows[1][1] and "oven7-d" in plain[3]
    got = {r.id: r.text for r in corpus.mask_corpus(df, KEY, order=("id",), more=(deciders.in_order(deciders.by_identity, deciders.by_list),)).collect()}
    assert "wheel7-b" not in got[1] and "clay7-c" not in got[1] + got[2] and "oven7-d" not in got[3]
