import random

from pyspark.sql import functions as F

from cloakstone.functions import ids
from cloakstone.operators import corpus, known, mask
from cloakstone.sources.tables import written

KEY = ids.Key(b"0123456789abcdef0123456789abcdef")


def masked(spark, rows, **options):
    df = spark.createDataFrame(rows, "id long, conv string, text string")
    return {r.id: r.text for r in corpus.mask_corpus(df, KEY, order=("id",), **options).collect()}


def test_what_one_text_teaches_all_texts_lose(spark):
    got = masked(spark, [(1, "a", "database: grain_7x\nhost: silo-44.dock.lan\n"), (2, "b", "copy grain_7x from SILO-44.dock.lan, not grain_7xy"), (3, "c", "a grain of salt"), (4, "d", None), (5, "e", ""), (6, "f", "grain_7x")])
    assert "grain_7x " not in got[2] and "SILO-44" not in got[2] and got[2].endswith("not grain_7xy") and got[3] == "a grain of salt" and got[4] is None and got[5] == ""
    assert got[2].split()[1] == got[6]


def test_weak_evidence_of_one_rule_teaches_nothing_elsewhere(spark):
    got = masked(spark, [(1, "a", "topics = [swarm.in7, swarm.out7, swarm.dead7]"), (2, "b", "drop swarm.in7")])
    assert "swarm.in7" not in got[1] and got[2] == "drop swarm.in7"


def test_names_of_a_scope_stay_in_it(spark):
    rows = [(1, "a", "SELECT wool_g7 FROM pens_9 WHERE shorn_9 = 1"), (2, "a", "why wool_g7?"), (3, "b", "why wool_g7?"), (4, None, "why wool_g7?")]
    got = masked(spark, rows, scope="conv")
    assert "wool_g7" not in got[2] and got[3] == got[4] == "why wool_g7?"
    assert masked(spark, rows)[2] == "why wool_g7?"


def test_people_over_several_records_are_one(spark):
    people = spark.createDataFrame([("Rosa Prado", None, "QX1Z"), ("Rosa P Prado", "rosa@stall.dev", "QX1Z"), (None, "rosa@stall.dev", "QX9Z"), ("Davi de Melo", "davi@stall.dev", None)], "name string, email string, code string")
    registry = written(known.import_people(people, KEY), "registry")
    assert registry.select("person").distinct().count() == 2
    got = masked(spark, [(1, "a", "Rosa Prado, QX9Z and ROSA  P PRADO met davi DE melo"), (2, "b", "rosa and prado")], registry=registry)
    one = got[1].split()[1].rstrip(",")
    assert got[1] == f"Person {one}, USER-{one} and PERSON {one.upper()} met {got[1].split(' met ')[1]}" and "davi" not in got[1] and got[2] == "rosa and prado"
    assert {r.hash for r in registry.where("kind = 'name'").collect()} >= {corpus.name_hash(KEY.secret, "nome", "ROSA PRADO")}


def test_no_rows_repeated_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "host: silo-44.dock.lan", "x", 2, "y"), (1, "host: silo-44.dock.lan", "x", 2, "y"), (None, "silo-44.dock.lan", None, None, None)], "id long, text string, key string, start int, coarse string")
    out = corpus.mask_corpus(df, KEY).collect()
    assert len(out) == 3 and all("silo" not in r.text for r in out) and {r.key for r in out} == {"x", None}
    assert corpus.mask_corpus(df.limit(0), KEY).count() == 0


def test_masked_texts_come_back_and_mask_no_more(spark):
    rng = random.Random(4)
    bits = ["host: silo-{}.dock.lan\n", "mail a{}@stall.dev ", "SELECT wool_g{} FROM fold_{}.ewes_{} WHERE shorn_1 = 2;\n", "plain words ", "token: 'abcdefabcdefabcdefabcdefabcdef{}'\n", "silo-3.dock.lan "]
    rows = [(i, "".join(rng.choice(bits).replace("{}", str(rng.randrange(9))) for _ in range(6))) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, text string")
    out = written(corpus.mask_corpus(df, KEY), "masked")
    back = mask.unmask(out.select("id", "text"), mask.reverse_table(mask.mapping(out, "id"), "id"), "id")
    assert {r.id: r.text for r in back.collect()} == dict(rows)
    assert out.agg(F.sum("n_replacements")).first()[0] > 100
