from pyspark.sql import functions as F

from cloakstone.functions import ids
from cloakstone.operators import corpus, origins

KEY = ids.Key(b"0123456789abcdef0123456789abcdef")


def test_what_commands_read_and_move(spark):
    cases = {
        "cat ./herd.csv": ["herd.csv"], "head -n 5 'my file.txt' | sort": ["my file.txt"], "grep -i ewe flock.log": ["flock.log"], "awk '{print $2}' pens.txt": ["pens.txt"], "psql -h x -d wool_1 -c 'select 1'": ["db:wool_1"],
        "aws s3 cp s3://bkt-1/a.csv -": ["s3://bkt-1/a.csv"], "curl -s https://api.fold.lan/v1?x=1": ["https://api.fold.lan/v1"], "echo hi": [], "": [], "cat a.txt; cat b.txt": ["a.txt", "b.txt"],
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, c string").select("c", origins.sources_of(F.col("c")).alias("s")).collect()
    assert {r.c: r.s for r in rows} == cases
    moves = spark.createDataFrame([("cp -r a.csv ./b.csv && mv b.csv 'c d.csv'",), ("ls -l",)], "c string").select(origins.moves_of(F.col("c")).alias("m")).collect()
    assert [[tuple(x) for x in r.m] for r in moves] == [[("a.csv", "b.csv"), ("b.csv", "c d.csv")], []]


def test_contagion_stays_within_a_source(spark):
    """A name of one file is masked in its copies' outputs, and not in those of another file, another conversation or no file."""
    rows = [
        (1, "x", "cat herd.sql", "SELECT wool_g7 FROM pens_9 WHERE shorn_9 = 1"), (2, "x", "cp herd.sql old.sql; mv old.sql older.sql", ""), (3, "x", "grep wool older.sql", "why wool_g7?"), (4, "x", "cat other.sql", "why wool_g7?"),
        (5, "y", "cat herd.sql", "why wool_g7?"), (6, "x", None, "why wool_g7?"), (7, "x", "echo", "why wool_g7?"), (8, None, "cat herd.sql", "why wool_g7?"),
    ]
    df = origins.with_source(spark.createDataFrame(rows, "id int, conv string, call_text string, text string"), "conv")
    assert df.count() == len(rows) and {r.source for r in df.where("id in (1, 3)").collect()} == {"x\0herd.sql"} and df.where("source is null").count() == 3
    out = {r.id: r.text for r in corpus.mask_corpus(df, KEY, scope="source", order=("id",)).collect()}
    assert "wool_g7" not in out[3] and all(out[i] == "why wool_g7?" for i in (4, 5, 6, 7, 8))
    assert origins.with_source(df.drop("source").limit(0), "conv").count() == 0
