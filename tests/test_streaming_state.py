from cloakstone.streaming.decisions import first_decisions, run_once
from cloakstone.streaming.unmask import unmask_stream

KIND = "scope string, name string, ts timestamp, ord long, type string"


def stream_of(spark, path):
    return spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(path)


def test_decisions_survive_a_restart_and_expire(spark, tmp_path):
    """Two runs with a restart between them give what one run gives; a name unseen for longer than the ttl is decided anew, and its state is gone."""
    batches = [
        [("a", "x_1", "2024-01-01", 1, "obj.table"), ("a", "y_1", "2024-01-01", 2, "obj.queue"), ("b", "x_1", "2024-01-02", 1, "obj.schema")],
        [("a", "x_1", "2024-01-05", 3, "obj.queue"), (None, "x_1", "2024-01-05", 3, "obj.user")],
        [("a", "x_1", "2024-01-09", 4, "obj.server")],
        [("a", "z_1", "2024-03-01", 5, "obj.table")],
        [("a", "x_1", "2024-03-02", 6, "obj.server"), ("b", "x_1", "2024-03-02", 2, "obj.server")],
    ]
    source = tmp_path / "in"

    def add(part):
        for rows in part:
            spark.createDataFrame(rows, "scope string, name string, t string, ord long, type string").selectExpr("scope", "name", "CAST(t AS timestamp) AS ts", "ord", "type").coalesce(1).write.mode("append").parquet(str(source))

    def run(name):
        run_once(first_decisions(stream_of(spark, str(source)), "10 days", "1 day"), f"file://{tmp_path}/{name}", f"file://{tmp_path}/{name}-c")
        return sorted((str(r.scope), r.name, str(r.ts)[:10], r.ord or 0, r.type, r.state) for r in spark.read.parquet(f"{tmp_path}/{name}").collect())

    add(batches[:2])
    run("two")
    add(batches[2:])
    two, one = run("two"), run("one")
    assert two == one
    got = {(s, n, o): (t, state) for s, n, _, o, t, state in two if state != "expired"}
    assert got["a", "x_1", 3] == got["a", "x_1", 4] == ("obj.table", "kept") and got["b", "x_1", 1] == ("obj.schema", "new")
    assert got["a", "x_1", 6] == ("obj.server", "new") and got["None", "x_1", 3] == ("obj.user", "new")
    assert {(s, n, d) for s, n, d, _, _, state in two if state == "expired"} >= {("a", "y_1", "2024-01-01")}


def test_each_stream_has_its_own_mapping(spark, tmp_path):
    kind = "stream string, block string, seq long, chunk string, final boolean"
    rows = [("s", "1", 1, "_7 and", False), ("s", "1", 0, "see db", False), ("t", "1", 0, "see db_7", True), ("u", "1", 0, "see db_7", True), ("s", "1", 2, " end", True)]
    for r in rows:
        spark.createDataFrame([r], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    pairs = spark.createDataFrame([("s", "db_7", "grain"), ("t", "db_7", "silo")], "stream string, pseudo string, real string")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run_once(unmask_stream(stream, pairs), f"file://{tmp_path}/out", f"file://{tmp_path}/c")
    out = {}
    for r in spark.read.parquet(f"{tmp_path}/out").orderBy("seq").collect():
        out[r.stream] = out.get(r.stream, "") + r.text
    assert out == {"s": "see grain and end", "t": "see silo", "u": "see db_7"}
