import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from cloakstone.llm import queries, spelling

from .util import DOCS, awkward, clashing


def brute_words(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def brute_variants(n):
    """Near words by deletions: two words are near if they share a deletion of one letter at one place, or one is a deletion of the other."""
    near = defaultdict(set)
    holes = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            holes[w[:i], w[i + 1 :]].add(w)
            if (d := w[:i] + w[i + 1 :]) in n:
                near[w].add(d)
                near[d].add(w)
    for some in holes.values():
        for w in some:
            near[w] |= some - {w}
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            if n[best] >= 5 * n[w]:
                form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def answered(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_variants_by_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    got = queries.op13_spelling_variants(spark, sf_dir).collect()
    assert len(got) == len({r.word for r in got}) > 1000
    want = brute_variants(brute_words(rows))
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want
    assert sum(x[1] is not None for x in want) > 5 and any(x[4] > 1 for x in want)


@pytest.mark.parametrize("part", [7, 100, 16384])
def test_many_near_words_in_small_parts(spark, monkeypatch, part):
    """Prefixes of more words than a part holds are split; blocks of few questions; no pair is lost or met twice."""
    for k, v in (("PART", part), ("BLOCK", 50), ("PAIRS", 1000)):
        monkeypatch.setattr(spelling, k, v)
    rng = random.Random(part)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(6, 8))) for _ in range(1500)}
    long = ["x" * 30 + "abcdefgh" * 4, "x" * 30 + "abcdefgh" * 4 + "y", "x" * 200, "x" * 199, "x" * 199 + "y", "ab" * 24, "ab" * 24 + "c", "ab" * 23 + "b", "ab" * 23 + "a" * 2]
    n = {w: rng.choice([5, 6, 30, 200, 2000]) for w in [*words, *long]}
    near = spelling.near_words(spark.createDataFrame(list(n.items()), "word string, n long").repartition(3))
    want = {x[0]: x[4] for x in brute_variants(n) if x[4]}
    assert {r.word: r.n_near for r in near.collect()} == want


def test_chains_of_forms_end_at_their_root(spark):
    text = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125}
    chain = spark.createDataFrame([(w, f) for w, f in zip(text, [*text][1:], strict=False)], "word string, form string")
    assert {(r.word, r.root) for r in spelling.roots(chain).collect()} == {(w, "aabbbb") for w in [*text][:-1]}
    assert spelling.roots(chain.limit(0)).count() == 0


def test_ties_damage_and_letters_of_both_cases(spark):
    # two forms of one count: the smaller word; only A-Z are lowered; one letter of other runs parts words
    docs = [(i, "Kestral KESTRAL kestrbl kestrcl ÉCLAIRÉ éclairé") for i in range(40)] + [(100 + i, "kestrxl") for i in range(5)]
    got = spelling.variants(spark.createDataFrame(docs, "doc_id long, text string"))
    assert answered(got) == brute_variants(brute_words(docs))


def test_awkward_empty_and_clashing_tables(spark):
    docs = spark.createDataFrame(awkward() * 3, DOCS)
    assert answered(spelling.variants(docs)) == brute_variants(brute_words([("" if r[0] is None else r[0], r[1]) for r in awkward() * 3]))
    assert spelling.variants(docs.limit(0)).count() == 0
    assert spelling.variants(docs.where("text is null")).count() == 0
    assert spelling.variants(clashing(spark)).columns == ["word", "form", "root", "n", "n_near", "form_n"]
