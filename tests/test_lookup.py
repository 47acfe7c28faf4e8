import numpy as np
import pytest

from cloakstone.functions import ids
from cloakstone.operators import corpus, known, lookup
from cloakstone.sources.tables import written

KEY = ids.Key(b"0123456789abcdef0123456789abcdef")
AROUND = ["see fin.{} now", "{}/part-0", "{}.ewes", "s3://{}/dir", "({})", '"{}",', "a, {}; b", "[{}]", "über.{}", "<{}>", "{}:3", "x|{}|y", "C:\\herd\\{}", "line\\n{} in a log", "is it {}?"]
OTHERS = ["{}y", "my-{}", "{}_old", "{}-b", "a{}", "{}$", "#{}", "é{}", "{}é", "{}7", "_{}"]


def masked(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return [r.text for r in corpus.mask_corpus(df, KEY, order=("id",), **options).orderBy("id").collect()]


def test_a_learned_name_in_any_surroundings_and_near_misses(spark):
    name = "grain_7x"
    got = masked(spark, [f"database: {name}\n", *[a.format(name) for a in AROUND], *[o.format(name) for o in OTHERS], "grain-7x", "grain_7"])
    assert [a for a, g in zip(AROUND, got[1:], strict=False) if name in g] == []
    rest = got[1 + len(AROUND) :]
    assert [o for o, g in zip(OTHERS, rest, strict=False) if g != o.format(name)] == [] and rest[-2:] == ["grain-7x", "grain_7"]


@pytest.mark.parametrize("name", ["x1-" + "long_" * 22 + "end", "cevada_são_2", "_".join(f"p{i}" for i in range(30))])
def test_long_names_names_of_many_pieces_and_accents(spark, name):
    got = masked(spark, [f"database: {name}\n" if name.isascii() else f"SELECT a_1 FROM fold_1.{name} WHERE b_1 = 2", f"then {name} again", f"then {name}s again"])
    taught = name not in got[0]
    assert taught and name not in got[1] and got[2] == f"then {name}s again"


def found(spark, values, texts):
    """(text, start, end) of values (type, real) in texts, through index, filter and check."""
    index = written(lookup.indexed(spark.createDataFrame([(t, v, None) for t, v in values], "type string, real string, scope string"), KEY), "index")
    f, hasher = lookup.filter_of(index), lookup.Hasher(KEY.secret)
    rows = [(i, None, *c) for i, t in enumerate(texts) for c in lookup.candidates(t, f, hasher)]
    df = spark.createDataFrame(rows, "i long, _scope string, " + lookup.CANDIDATE)
    return {(r.i, texts[r.i][r.start : r.end]) for r in lookup.verified(df, index, KEY).collect()}


def test_secrets_with_signs_numbers_with_blanks_and_codes(spark):
    values = [("secret", "!pa$s#7w0rd!"), ("secret", "k" * 300), ("cpf", "111.444.777-35"), ("phone", "+55 (11) 98765-4321"), ("user", "Ab-12345x"), ("account", "4321-0"), ("rg", "12.345.678-X"), ("secret", "$$$$")]
    texts = ["k=!pa$s#7w0rd!&b", "k=!pa$s#7w0rd", "xpa$s#7w0rd!", "k" * 300, "k" * 301, "111 444 777 35", "11144477735", "5.111.444.777-35", "111444777356", "call 55 11 987654321", "AB-12345X", "ab-12345xy", "at 4321-0,", "at 43210,", "12345678x", "RG 12 345 678-x.", "112345678x", "$$$$"]
    got = found(spark, values, texts)
    assert got == {(0, "!pa$s#7w0rd!"), (3, "k" * 300), (5, "111 444 777 35"), (6, "11144477735"), (7, "111.444.777-35"), (9, "55 11 987654321"), (10, "AB-12345X"), (12, "4321-0"), (14, "12345678x"), (15, "12 345 678-x")}


def test_windows_equal_hashes_of_their_pieces():
    h = lookup.Hasher(b"k")
    x = np.random.default_rng(1).integers(0, 1 << 63, 3000, dtype=np.uint64)
    for k in (1, 2, 7, lookup.WIDE, lookup.LONGER):
        n = min(k, lookup.WIDE)
        w = h.windows(x, k)
        assert len(w) == len(x) - n + 1
        for i in (0, 5, len(w) - 1):
            assert int(w[i]) == sum(int(v) * pow(lookup._BASE, j, 1 << 64) for j, v in enumerate(x[i : i + n])) % (1 << 64)


def test_a_second_run_masks_what_only_the_first_learned(spark, tmp_path):
    """The kept table holds hashes only; what wasn't seen for long doesn't apply but stays in it."""
    first, second = f"file://{tmp_path}/first", f"file://{tmp_path}/second"
    masked(spark, ["database: grain_7x\n", "queue: barrel-9x\n"], remember=first, today=100)
    kept = spark.read.parquet(first)
    assert not any("grain" in str(v) or "barrel" in str(v) for r in kept.collect() for v in r) and kept.count() == 2
    later = masked(spark, ["use fin.grain_7x", "database: silo_44\n"], seen=kept, remember=second, today=150)
    assert "grain_7x" not in later[0]
    both = {r.learned_day: r.seen_day for r in spark.read.parquet(second).collect()}
    assert both == {100: 100, 150: 150} and spark.read.parquet(second).count() == 3
    assert masked(spark, ["use fin.grain_7x and silo_44"], seen=spark.read.parquet(second), today=200)[0].startswith("use fin.grain_7x and db_")


def test_what_a_model_or_the_web_wrote_first_teaches_nothing(spark):
    rows = [
        (1, "a", 1, "assistant", "try grain_7x then"), (2, "a", 2, "user", "database: grain_7x\n"), (3, "a", 3, "user", "and grain_7x?"),
        (4, "b", 1, "user", "database: silo_44\n"), (5, "b", 2, "assistant", "I see silo_44"), (6, "b", 3, "web", "silo_44 of the web"), (7, "c", 1, "user", "grain_7x and silo_44"), (8, "d", 1, None, "silo_44"), (9, "d", 2, "user", "silo_44"),
    ]
    df = spark.createDataFrame(rows, "id long, conv string, ord int, role string, text string")
    out = {r.id: r.text for r in corpus.mask_corpus(df, KEY, scope="conv", order=("conv", "ord"), origin="role").collect()}
    assert "grain_7x" not in out[2]  # its place tells, whoever wrote it first
    assert out[1] == "try grain_7x then" and out[3] == "and grain_7x?"
    assert all("silo_44" not in out[i] for i in (4, 5, 6)) and out[7].startswith("grain_7x and db_")
    assert out[8] == out[9] == "silo_44"  # no one known wrote it there first


def test_people_of_many_words(spark):
    name = "Ana Bia Cora Dora Eva Flor Gal Hilda"
    registry = known.import_people(spark.createDataFrame([(name, "ana@stall.dev", None)], "name string, email string, code string"), KEY)
    got = masked(spark, [f"ask {name.upper()} now", "ask Ana Hilda", "ask Ana Bia"], registry=written(registry, "registry"))
    assert "HILDA" not in got[0] and "Hilda" not in got[1] and got[2] == "ask Ana Bia"


def test_the_filter_grows_with_the_index(spark):
    few, many = (written(lookup.indexed(spark.range(n).selectExpr("'secret' AS type", "concat('v', id, 'x') AS real", "CAST(null AS string) AS scope"), KEY), "index") for n in (10, 20_000))
    a, b = lookup.filter_of(few), lookup.filter_of(many)
    assert len(a.bits) * 64 == lookup.LEAST_BITS and len(b.bits) * 64 >= 16 * 20_000
    assert np.bitwise_count(b.bits).sum() <= 20_000 and b.holds(np.array([r[0] for r in many.select("window").limit(100).collect()], np.int64).view(np.uint64)).all()
    empty = lookup.filter_of(few.limit(0))
    assert lookup.candidates("grain_7x 12345678", empty, lookup.Hasher(b"k")) == []


def test_names_of_many_scopes_meet_only_their_own(spark):
    # each of 300 scopes has learned the same name, which stands in a text of each: 300 hits, of a join that doesn't hold all scopes against each other
    values = spark.range(300).selectExpr("'obj.column' AS type", "'warp_9' AS real", "concat('c', id) AS scope")
    index = lookup.indexed(values, KEY)
    window = index.first()["window"]
    found = spark.range(301).selectExpr("id AS _id", "if(id = 300, null, concat('c', id)) AS _scope", "0 AS start", "6 AS end", f"{window}L AS window", "2 AS pieces", "'' AS left", "'warp_9' AS body", "'' AS right")
    out = lookup.verified(found, index, KEY)
    got = [(r["_id"], r["scope"], r["real"]) for r in out.collect()]
    assert sorted(got) == [(i, f"c{i}", "warp_9") for i in range(300)]
    joins = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x]
    assert joins and all("_of" in x for x in joins)
