"""Small tables with every awkward row, and plain words and shingles."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: A column of each name that the operators use inside.
CLASHING = "doc_id long, text string, source string, score double, kept string, shard string, node long, hash string, label string, grp long, part long, spans string, n long, held_out string, ids string"


def words(text):
    return (text or "").encode().lower().split()


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def awkward():
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    base = " ".join(f"alpha{i}" for i in range(40))
    return [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", "a", 4), (4, "one two", "en", "b", 7), (5, long, "en", None, len(long)),
        (6, base, "en", "a", 1), (6, base, "en", "a", 1), (7, base + " tail", "de", "b", 2), (8, base.upper(), "de", "c", 3), (None, base, "fr", "a", 5), (9, "ééé ñ 日本 " * 20, "es", "a", 9),
        (10, "the the the the the the the the the the the the " * 6, "en", "a", 1),
    ]


def clashing(spark):
    one = " ".join(f"beta{i}" for i in range(60))
    return spark.createDataFrame([(1, one, "s", 0.5, "k", "x", 1, "h", "l", 1, 2, "sp", 3, "y", "z"), (2, None, None, None, None, None, None, None, None, None, None, None, None, None, None)], CLASHING)
