"""Token counts of whole texts without token ids: pieces are counted once for each distinct pre-token, joined to the document's
pre-token frequencies, and summed.

The model's pieces hold U+2581 (its space) only at their beginning and its normaliser is the identity, so no merge crosses from a word
into the space before the next one: a text, led by the dummy space, is exactly the run of its pre-tokens (some spaces, then
non-spaces), and the tokens of a text are the sum of the tokens of its pre-tokens. `splits_at_spaces` checks that of a model.

The join is local to a task: a document's pre-token frequencies meet a table of pre-token -> pieces that the worker fills once for each
distinct pre-token and keeps between documents and tasks, at most TABLE entries (then it starts anew; results do not depend on
it). Nothing is shuffled.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows repeat; a null doc_id stays null; an empty table gives no
rows; other columns are ignored. Texts are never cut."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

LIMIT = 4096
TABLE = 400_000
SPACE = "▁"
_PARTS = re.compile(" +[^ ]*")


@lru_cache(maxsize=2)
def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def splits_at_spaces(path: str) -> bool:
    """Whether pre-tokens of this model can be counted apart."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    n = m.normalizer_spec
    plain = n.add_dummy_prefix and not n.remove_extra_whitespaces and not n.precompiled_charsmap and not m.trainer_spec.treat_whitespace_as_suffix
    return plain and all(SPACE not in p.piece.lstrip(SPACE) for p in m.pieces if p.type in (1, 4))


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens in order, each without its first space; with it, their concatenation is the text led by one space."""
    if not text:
        return []
    text = text.replace(SPACE, " ")
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [x[1:] for x in _PARTS.findall(" " + text)]
    return text.split(" ")


_tables: dict[str, dict[str, int]] = {}


def count_texts(path: str, texts: list[str]) -> list[int]:
    table, sp = _tables.setdefault(path, {}), processor(path)
    frequencies = [Counter(pre_tokens(x)) for x in texts]
    new = list({k for f in frequencies for k in f if k not in table})
    if len(table) + len(new) > TABLE:
        table.clear()
        new = list({k for f in frequencies for k in f})
    table.update(zip(new, map(len, sp.encode(new, num_threads=1)), strict=True))  # the library adds the first space
    table[""] = 1  # the library gives nothing for an empty text, but a lone space is a piece
    return [sum(map(int.__mul__, map(table.__getitem__, f), f.values())) for f in frequencies]


def count(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of docs (doc_id, text)."""
    C.arrow_limits(docs.sparkSession)
    if not splits_at_spaces(path):
        raise ValueError("this model's pieces cross spaces; its pre-tokens can't be counted apart")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.text_blocks(batches, limit=1 << 20):
            text = C.column(b, "text")
            n = count_texts(path, text.cast(pa.string()).to_pylist())
            _, off = C.buffers(text)
            yield pa.RecordBatch.from_arrays([C.column(b, "doc_id"), pa.array(off[1:] - off[:-1]), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", C.text_bytes()).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
