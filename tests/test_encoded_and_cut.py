import base64
import random
import time
import urllib.parse

from cloakstone.readers.encoded import encoded
from cloakstone.readers.stage import find_names, visible

TOKEN = "ghp_" + "a1B2c3D4e5F6" * 3


def spans(text):
    return [text[n.start : n.end] for n in encoded(text)]


def b64(x, safe=False):
    return (base64.urlsafe_b64encode if safe else base64.b64encode)(x.encode()).decode()


def test_tokens_inside_encoded_text_at_any_alignment():
    for lead in ("", "x", "xy", "user: "):
        for safe in (False, True):
            text = "data: " + b64(f"{lead}?>{TOKEN} and more", safe) + " end"
            got = spans(text)
            assert len(got) == 1
            at = text.index(got[0])
            run = text[6:-4]
            whole = base64.b64decode(run.replace("-", "+").replace("_", "/"))
            first, last = (at - 6) * 3 // 4, (at - 6 + len(got[0])) * 3 // 4
            assert TOKEN.encode() in whole[first : last + 1] and len(got[0]) <= len(TOKEN) * 4 / 3 + 4


def test_layers_within_layers_and_percent_escapes():
    assert len(spans("x=" + b64("y=" + b64(f"k {TOKEN} z")))) == 1
    escaped = "q=" + urllib.parse.quote(f"a {TOKEN}&b=2") + " end"
    assert spans(escaped) == [TOKEN]
    assert spans("q=" + urllib.parse.quote("password=Ab12345x&b") + " end") == ["Ab12345x"]
    assert len(spans("v: " + b64('{"password": "Ab12345x"}'))) == 1


def test_what_holds_no_token_stays():
    rng = random.Random(1)
    for text in ("deadbeef" * 8, "a/long/path/of/some/words/that/go/on", b64("just plain words of no interest"), "%20%41bc", "".join(rng.choice("ABCDEFGHabcdefgh0123456789+/") for _ in range(4000)), ""):
        assert spans(text) == []


def test_work_follows_the_length():
    def took(n):
        text = " ".join([b64("some plain words and " + TOKEN), "word"] * n)
        t = time.process_time()
        assert len(spans(text)) == n
        return time.process_time() - t

    took(200)
    assert took(4000) < 5 * took(2000) + 0.2


def test_names_over_cut_strings_are_found_in_their_place():
    text = 'q = "SELECT a_1 FROM fold_7." +\n    "ewes_7 WHERE b_1 = 2"\n'
    clean, places = visible(text)
    assert '"SELECT a_1 FROM fold_7.ewes_7 WHERE b_1 = 2"' in clean and len(places) == len(clean) + 1
    got = {(x[2], x[3]) for x in find_names(text, ("sql",))}
    assert {("obj.schema", "fold_7"), ("obj.table", "ewes_7")} <= got
    split = 'q = ("SELECT a_1 FROM fold_7.ew"\n     "es_77 WHERE b_1 = 2")\n'
    assert ("obj.table", 'ew"\n     "es_77') in {(x[2], x[3]) for x in find_names(split, ("sql",))}
    back = "x = 'host: silo' \\\n 's-44'"
    assert "host: silos-44" in visible(back)[0]


def test_quoted_lines_and_lists_are_not_joined():
    for text in ('"a","b"\n"c","d"\n', "x = ['a',\n 'b']", '"one"\n"two"\n', "it's one\n's two", ""):
        assert visible(text)[0] == text
