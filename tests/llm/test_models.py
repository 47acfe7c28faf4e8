import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cloakstone.llm import common as C
from cloakstone.llm import decontaminate, lm_score, piece_transducer, quality_classifier, queries, token_counts

from .util import DOCS, awkward, clashing, words


def disc(n):
    y = n[0] / (n[0] + 2 * n[1])
    return [0, 1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]


def test_language_model_by_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in queries.table(spark, sf_dir, "documents").collect()}
    tok = {d: [*words(t), None] for d, t in texts.items()}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in tok}
    uni, bi = collections.Counter(), collections.Counter()
    for d, w in tok.items():
        if not held[d]:
            uni.update(w)
            bi.update(zip(["<s>", *w[:-1]], w, strict=True))
    n, v = sum(uni.values()), len(uni)
    cont = collections.Counter(b for _, b in bi)
    d1, d2 = (disc([sum(c == k for c in x.values()) for k in (1, 2, 3, 4)]) for x in (cont, bi))
    total = sum(cont.values())
    over = sum(d1[min(c, 3)] for c in cont.values()) / total
    of, left = collections.Counter(), collections.Counter()
    for (a, _), c in bi.items():
        of[a] += c
        left[a] += d2[min(c, 3)]

    def low(b):
        return max(cont[b] - d1[min(cont[b], 3)], 0) / total + over / (v + 1)

    def p(a, b):
        return low(b) if a not in of else max(bi[a, b] - d2[min(bi[a, b], 3)], 0) / of[a] + left[a] / of[a] * low(b)

    for r in queries.op4_lm_score(spark, sf_dir).collect():
        w = tok[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w), sum(uni[x] > 0 for x in w), n)
        assert r.score == pytest.approx(sum(math.log10(p(a, b)) for a, b in zip(["<s>", *w[:-1]], w, strict=True)), rel=1e-9)
        assert r.base_score == pytest.approx(sum(math.log10((uni[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel=1e-9)


def test_language_model_of_awkward_and_no_rows(spark):
    docs = spark.createDataFrame(awkward(), DOCS)
    rows = lm_score.score(docs, lm_score.train(docs.where(~lm_score.held_out()))).collect()
    assert len(rows) == len(awkward()) and all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    empty = lm_score.train(docs.limit(0))
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in lm_score.score(docs, empty).collect())
    assert lm_score.score(docs.limit(0), empty).count() == 0
    lm_score.score(clashing(spark), empty).collect()


def plant(rng, item, docs, k):
    w = item.split()
    for _ in range(k):
        at = rng.randrange(len(w))
        kind = rng.choice("sid")
        if kind == "s":
            w[at] = "qq" + w[at]
        elif kind == "i":
            w.insert(at, f"zz{rng.randrange(99)}")
        elif len(w) > 1:
            del w[at]
    d = rng.choice(docs).split()
    at = rng.randrange(len(d) + 1)
    return " ".join(d[:at] + w + d[at:])


@pytest.mark.parametrize("share", [0, 10, 20])
def test_planted_items_are_found_at_the_stated_recall(spark, sf_dir, share):
    items = queries.table(spark, sf_dir, "benchmark").collect()
    docs = [r.text for r in queries.table(spark, sf_dir, "documents").collect()]
    index = decontaminate.Index([r.item_id for r in items], [r.text.encode() for r in items])
    rng = random.Random(share)
    planted = [rng.choice(items) for _ in range(120)]
    texts = [plant(rng, x.text, docs, int(index.m[index.ids.index(x.item_id)]) * share // 100) for x in planted]
    rows = decontaminate.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items)).collect()
    hit = {(r.doc_id, r.item_id): r.distance for r in rows}
    assert sum((i, x.item_id) in hit for i, x in enumerate(planted)) >= (120 if not share else 119)
    for (d, item), distance in hit.items():  # the distance is the least of all windows
        q = index.ids.index(item)
        w = decontaminate.words_of(*C.buffers(pa.array([texts[d].encode()], pa.binary())))
        assert distance == index.best(q, w.hashes.tolist())[0] <= decontaminate.edits(int(index.m[q]))


@pytest.mark.parametrize("m", [80, 120, 200, 400])
def test_long_items_are_found_with_all_edits_in_one_part(spark, m):
    k = decontaminate.edits(m)
    items = [[f"w{i}x{j}" for j in range(m)] for i in range(20)]
    other = lambda i: [f"q{i}x{j}" for j in range(k)]
    changed = (
        lambda i, t: other(i) + t[k:],
        lambda i, t: [x for p in zip(other(i), t[1 : 2 * k : 2], strict=True) for x in p] + t[2 * k :],
        lambda i, t: t[k:],
        lambda i, t: [x for p in zip(other(i), t, strict=False) for x in p] + t[k:],
        lambda i, t: t[: m - k] + other(i),
    )
    texts = [(c * 100 + i, f"before {i} " * 30 + " ".join(f(i, t)) + f" after {i}" * 30) for c, f in enumerate(changed) for i, t in enumerate(items)]
    rows = decontaminate.find(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")).collect()
    hit = {(r.doc_id, r.item_id) for r in rows}
    for c in range(len(changed)):
        assert sum((c * 100 + i, i) in hit for i in range(20)) >= 19, c


def test_edit_search_by_brute_force():
    rng = random.Random(8)
    for _ in range(300):
        p = [rng.randrange(4) for _ in range(rng.randint(1, 9))]
        t = [rng.randrange(4) for _ in range(rng.randint(0, 14))]
        peq = {}
        for i, x in enumerate(p):
            peq[x] = peq.get(x, 0) | 1 << i
        row = list(range(len(p) + 1))
        best = len(p)
        for x in t:
            new = [0]
            for i, y in enumerate(p):
                new.append(min(row[i] + (x != y), row[i + 1] + 1, new[i] + 1))
            row = new
            best = min(best, row[-1])
        assert decontaminate.search(peq, len(p), t)[0] == best


def test_decontamination_of_awkward_rows_and_items(spark):
    docs = spark.createDataFrame(awkward(), DOCS)
    items = spark.createDataFrame([(1, " ".join(f"alpha{i}" for i in range(3, 25))), (2, None), (3, "..."), (4, "one two"), (5, " ".join(f"alpha{i}" for i in range(3, 25)))], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find(docs, items).collect()}
    assert {(6, 1), (7, 1), (8, 5), (4, 4), (None, 5)} <= got and not any(i in (2, 3) for _, i in got) and not any(d in (1, 2, 3, 10) for d, _ in got)
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == {1, 2, 3, 5, 9, 10}
    assert decontaminate.find(docs, items.limit(0)).count() == 0 and decontaminate.drop_contaminated(docs.limit(0), items).count() == 0
    c = clashing(spark)
    assert decontaminate.drop_contaminated(c, items).columns == c.columns


def test_items_in_slices_find_the_same(spark, sf_dir, monkeypatch):
    docs, items = queries.table(spark, sf_dir, "documents"), queries.table(spark, sf_dir, "benchmark")
    whole = sorted(tuple(r) for r in decontaminate.find(docs, items).collect())
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", items.agg(F.sum(F.octet_length("text"))).first()[0] // 12)
    assert decontaminate.Slices(items).count >= 10
    plan = decontaminate.find(docs, items)._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("MapInArrow") == 1  # one Python stage for all slices
    kept = {r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - {x[0] for x in whole}
    assert sorted(tuple(r) for r in decontaminate.find(docs, items).collect()) == whole


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in queries.table(spark, sf, "labels").collect()}
    rows = [r for r in queries.op5_quality_classifier(spark, sf).collect()]
    test = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(test) > 50 and np.mean([a == b for a, b in test]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_classifier_edges(spark):
    docs = spark.createDataFrame(awkward(), DOCS)
    labels = spark.createDataFrame([(6, 1), (7, 1), (10, 0), (10, 0), (None, 1), (5, None)], "doc_id long, label int")
    rows = quality_classifier.score(docs, quality_classifier.fit(docs, labels)).collect()
    assert len(rows) == len(awkward()) and all(0 <= r.score <= 1 for r in rows)
    assert {r.predicted for r in rows if r.doc_id == 10} == {0} and {r.predicted for r in rows if r.doc_id == 6} == {1}
    for only, score in (("label = 1", 1.0), ("label = 0", 0.0), ("false", 0.0)):
        assert quality_classifier.fit(docs, labels.where(only)) == score
    assert quality_classifier.score(docs.limit(0), 0.0).count() == 0
    assert quality_classifier.score(clashing(spark), 1.0).count() == 2


def test_votes_by_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = queries.table(spark, sf, "documents")
    labels = queries.table(spark, sf, "labels").selectExpr("doc_id", "quality as label").where(~quality_classifier.held_out())
    model = quality_classifier.fit(docs, labels, per_class=25)
    assert np.bincount(model.y.astype(int)).max() <= 25
    rows = {r.doc_id: r.score for r in quality_classifier.score(docs, model).collect()}
    for r in docs.limit(60).collect():
        x = quality_classifier.terms(pa.RecordBatch.from_arrays([pa.array([(r.text or "").encode()], pa.binary())], ["text"]))
        z = model.latent(quality_classifier.weighted(x, model.idf))[0]
        cos = [round(float(sum(a * b for a, b in zip(z.tolist(), v.tolist(), strict=True))), quality_classifier.PLACES) for v in model.vectors]
        near = sorted(range(len(cos)), key=lambda i: (-cos[i], i))[: quality_classifier.NEIGHBOURS]
        w = [max(cos[i], 0) ** quality_classifier.POWER * model.weight[int(model.y[i])] + 1e-12 for i in near]
        assert rows[r.doc_id] == pytest.approx(sum(a * model.y[i] for a, i in zip(w, near, strict=True)) / sum(w), abs=2e-3)


def test_equal_neighbours_go_to_the_lower_position():
    rng = np.random.default_rng(3)
    one = np.abs(rng.standard_normal((1, quality_classifier.TERMS + quality_classifier.SHAPES))).astype(np.float32)
    x, y = np.repeat(one, 60, 0), np.array([1] * 24 + [0] * 36)
    model = quality_classifier.Model(x, y, (0.5, 0.5))
    assert model.score(one)[0] == pytest.approx(1.0, abs=1e-6)
    assert len(set(np.round(model.score(np.repeat(one, 700, 0)), 9))) == 1


def test_counts_over_32_bits_are_kept():
    for most in (3, 255, 256, 65_535, 1 << 16, (1 << 32) - 1, 1 << 32, 5 << 40):
        c = np.array([1, most, 2], np.int64)
        raw = np.frombuffer(b"x" + lm_score._narrow(c).tobytes(), np.uint8, offset=1)
        assert lm_score._wide(raw, 3).tolist() == c.tolist()
    assert len(lm_score._wide(np.zeros(0, np.uint8), 0)) == 0


def test_no_document_that_holds_an_item_is_missed(spark, sf_dir):
    """Every document against every item by the exact search."""
    docs, items = (queries.table(spark, sf_dir, t).collect() for t in ("documents", "benchmark"))
    index = decontaminate.Index([r.item_id for r in items], [r.text.encode() for r in items])
    want = set()
    for r in docs:
        w = decontaminate.words_of(*C.buffers(pa.array([(r.text or "").encode()], pa.binary())))
        tokens = w.hashes.tolist()
        for i, item in enumerate(index.ids):
            if index.best(i, tokens)[0] <= decontaminate.edits(int(index.m[i])):
                want.add((r.doc_id, item))
    assert want and {(r.doc_id, r.item_id) for r in queries.op1_decontamination(spark, sf_dir).collect()} == want
    assert decontaminate.find(clashing(spark), spark.createDataFrame([(1, " ".join(f"beta{i}" for i in range(9)), "x")], "item_id long, text string, hits string")).count() == 1


def test_transducer_is_the_library(spark, sf_dir):
    path = queries.piece_model()
    sp = token_counts.processor(path)
    rng = random.Random(5)
    texts = ["".join(rng.choice(" \t\n▁ab<>s日本é😀") for _ in range(rng.randint(0, 60))) for _ in range(600)]
    texts += [" " * k for k in range(50)] + ["x" + " " * k + "the" for k in range(40)] + ["=" * k + "a" * k for k in range(40)] + ["supercalifragilistic" * 300]
    df = spark.createDataFrame([*awkward(), *((100 + i, t, None, None, 0) for i, t in enumerate(texts))], DOCS)
    encoded = piece_transducer.encode(df, path)
    by = collections.defaultdict(list)
    for r in encoded.collect():
        assert r.round_trip and r.n_ids == len(r.ids)
        by[r.doc_id].append(r.ids)
    for r in df.collect():
        assert sp.encode(r.text or "") in by[r.doc_id]
    for r in piece_transducer.decode(encoded, path).collect():
        assert r.text == sp.decode(r.ids)
    for r in queries.op10_sentencepiece(spark, sf_dir).join(queries.table(spark, sf_dir, "documents"), "doc_id").collect():
        assert r.ids == sp.encode(r.text)
    assert piece_transducer.encode(df.limit(0), path).count() == 0 and piece_transducer.encode(clashing(spark), path).count() == 2


def test_one_path_is_finite():
    fst = piece_transducer.transducer(queries.piece_model())
    for text in ("hello", "  world", "unbelievable!", "ab\ncd", "", "a" * 300, "日本😀x"):
        ids = np.frombuffer(fst.paths([text])[0], np.int32).tolist()
        assert fst.merged(("▁" + text).replace(" ", "▁"))[0] == ids
        known = np.array([i for i in ids if i in fst.plain])
        weights = fst.stable(known[:-1], known[1:])
        assert weights.all() or "\n" in text or "😀" in text  # a fallback character is a border


def test_no_piece_follows_another_but_by_merging():
    """Weights of pairs by their definition: merging the two pieces' characters leaves the two."""
    fst = piece_transducer.transducer(queries.piece_model())
    rng = random.Random(9)
    pieces = sorted(fst.ids.values())
    some = np.array([(rng.choice(pieces), rng.choice(pieces)) for _ in range(3000)])
    near = [i for i in pieces if fst.text[i].isalpha() and len(fst.text[i]) < 4]
    some = np.concatenate([some, [(rng.choice(near), rng.choice(near)) for _ in range(6000)]])
    got = fst.stable(some[:, 0], some[:, 1])
    assert got.tolist() == [fst.merged(fst.text[a] + fst.text[b])[0] == [a, b] for a, b in some.tolist()]
    assert fst.finite(some[:, 0], some[:, 1]).tolist() == got.tolist() == fst.finite(some[:, 0], some[:, 1]).tolist()


def test_pre_tokens_may_be_swept_again(monkeypatch):
    path = queries.piece_model()
    monkeypatch.setattr(piece_transducer, "TABLE", 3)
    fst, sp = piece_transducer.Transducer(path), token_counts.processor(path)
    for text in ("the quick brown fox", "jumps over the lazy dog " * 3, "the end", ""):
        assert fst.encode(text).tolist() == sp.encode(text)
