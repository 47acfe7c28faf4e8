import random
import re

import numpy as np
import pyarrow as pa

from cloakstone.llm import common as C
from cloakstone.llm.textblock import Words, gram_of


def block(texts):
    return C.buffers(pa.array([t.encode() for t in texts], pa.binary()))


def test_words_like_a_regular_expression():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abC é\x0b\x1f \t\n日") for _ in range(rng.randint(0, 40))) for _ in range(400)] + ["", " ", "x"]
    w = Words(*block(texts), lower=True)
    seen = {}
    for i, t in enumerate(texts):
        want = [x.lower() for x in re.findall(rb"[^\x20\x09-\x0D]+", t.encode())]
        got = [bytes(w.data[a:b]) for a, b in zip(w.starts[w.first[i] : w.first[i + 1]], w.ends[w.first[i] : w.first[i + 1]], strict=True)]
        assert got == want
        for x, h in zip(want, w.hashes[w.first[i] : w.first[i + 1]].tolist(), strict=True):
            assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)


def test_grams_stay_inside_a_row_and_do_not_depend_on_the_block():
    w = Words(*block(["a b c d e f", "a b", "a b c d e"]), lower=True)
    g, at = w.grams(5)
    assert w.doc[at].tolist() == [0, 0, 2] and g[0] == g[2] == gram_of(w.hashes[:5])[0]


def test_words_longer_than_a_chunk():
    big = "x" * 2_500_000
    w = Words(*block([big + " y", "z " + big]), lower=False)
    assert w.hashes[0] == w.hashes[3] and len(w) == 4 and len(np.unique(w.hashes)) == 3


def test_words_that_polynomials_confuse_differ():
    thue = ["a"]
    for _ in range(11):
        thue.append(thue[-1] + thue[-1].translate(str.maketrans("ab", "ba")))
    texts = [t for x in thue for t in (x, x.translate(str.maketrans("ab", "ba")))]
    rng = random.Random(6)
    texts += ["".join(rng.choice("xy") for _ in range(n)) for n in range(1, 60) for _ in range(40)] + ["\x00" * n for n in range(1, 40)] + ["swap8byt" + "eslanes!", "eslanes!" + "swap8byt"]
    w = Words(*block(texts), lower=False)
    assert len(set(w.hashes.tolist())) == len(set(texts))
    for shift in range(9):  # a hash doesn't depend on where the word lies
        assert Words(*block([" " * shift + t for t in texts]), lower=False).hashes.tolist() == w.hashes.tolist()
