"""SentencePiece encoding and decoding as a weighted finite-state transducer over the tropical semiring.

The machine is the composition of
* the normaliser: a space becomes U+2581 and the text is led by one (the model's rule map is empty, its normaliser the identity);
* the pieces: from every position an arc for each piece that begins there; and byte fallback: a character that is no piece has an arc
  that emits its bytes' pieces;
* the merge order: states are the piece last emitted, and the arc from piece a to piece b weighs 0 if a|b is stable, that is if merging
  the characters of ab in order of score leaves exactly a, b; else infinity.
Merging has one result for every prefix of a text, and prefixes of a result are results; so of the arcs that end at a position exactly one
continues the path of finite weight to where it begins. The tropical shortest-distance sweep (positions in order, one state each) therefore needs
no search: `paths` runs it over all positions of many pre-tokens at once, on arrays. A pre-token without a path of finite weight is an error.

Stability comes from the merge trees: going back in time along the right edge of a's tree and the left edge of b's, no pair that ever faced
each other across the border may be a piece of better score than the merge that ended it. The trees of a few pieces aren't ordered by score (the
runs of spaces, which tie): the weights of their arcs are taken from the definition above.

No piece holds U+2581 after another character, so a pre-token (spaces, then non-spaces) is composed on its own, once for each distinct
one that a worker meets (two generations of TABLE of them are kept; results do not depend on it). Texts are never cut and nothing is shuffled.

Defined results: null and empty texts have no ids and decode to the empty string; strings like "<s>" are ordinary characters; U+2581 in a
text decodes as a space; repeated rows repeat; an empty table gives no rows; other columns are ignored. Bytes that aren't UTF-8 when decoded
become U+FFFD, as in the library."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from . import common as C
from .token_counts import SPACE, pre_tokens, splits_at_spaces

TABLE = 60_000
#: Slots of the table of pairs' weights; a pair that finds its slot taken is weighed anew.
PAIRS = 1 << 19
#: Pre-tokens that are swept at once, and characters of one that is swept on its own.
SWEEP, LONG = 1 << 13, 64
#: Letters that have a column each in the table of steps; steps by others are searched.
COMMON = 128
INF = float("inf")


class Transducer:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        if m.trainer_spec.model_type != 2 or not splits_at_spaces(path) or not m.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with byte fallback and an identity normaliser is expected")
        self.text = [p.piece for p in m.pieces]
        self.ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type == 1}
        self.score = [p.score for p in m.pieces]
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == 6}
        self.output = [p.piece.replace(SPACE, " ").encode() for p in m.pieces]
        for value, i in self.bytes.items():
            self.output[i] = bytes([value])
        for i, p in enumerate(m.pieces):
            if p.type in (2, 3):
                self.output[i] = b" \xe2\x81\x87 " if p.type == 2 else b""
        if any(len(c) > 1 and x not in self.ids for c in self.ids for x in c):
            raise ValueError("a piece has a character that is no piece")
        order = {s: i for i, s in enumerate(sorted({self.score[i] for i in self.ids.values()}, reverse=True))}
        self.rank = {i: order[self.score[i]] if len(p) > 1 else -1 for p, i in self.ids.items()}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.plain: dict[int, bool] = {}  # trees ordered by score; pieces that merging can't yield are left out
        for p, i in sorted(self.ids.items(), key=lambda x: len(x[0])):
            self._tree(p, i)
        self._arrays()
        self.table: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _arrays(self) -> None:
        """The machine as arrays: the pieces' trie, the merge trees, and the weights of pairs met so far."""
        of_letter = Counter(c for p in self.ids for c in p)
        letters = sorted(of_letter, key=lambda c: (-of_letter[c], c))
        self.letter = np.full(0x110000, -1, np.int32)  # of each code point; -1: byte fallback
        self.letter[[ord(c) for c in letters]] = np.arange(len(letters))
        number = {c: i for i, c in enumerate(letters)}
        # (node, letter) -> node; 0 is the root, and nodes that are left by some letter have the first numbers
        inner = {p[:k]: None for p in self.ids for k in range(len(p))}
        node = {p: i for i, p in enumerate([*inner, *(p for p in self.ids if p not in inner)])}
        nodes = {(node[p[:-1]], number[p[-1]]): i for p, i in node.items() if p}
        ends = {node[p]: i for p, i in self.ids.items()}
        self.n_letters, self.longest = len(letters), max(map(len, self.ids))
        steps = np.array([(a * len(letters) + c, b) for (a, c), b in nodes.items()], np.int64)
        steps = steps[np.argsort(steps[:, 0])]
        self.arc, self.target = np.ascontiguousarray(steps[:, 0]), np.ascontiguousarray(steps[:, 1])
        self.n_inner, self.step = len(inner), np.full((len(inner), COMMON), -1, np.int32)
        common = self.arc % len(letters) < COMMON
        self.step[self.arc[common] // len(letters), self.arc[common] % len(letters)] = self.target[common]
        self.step = self.step.ravel()
        self.first = np.full(len(letters), -1, np.int32)
        self.first[self.arc[self.arc < len(letters)]] = self.target[self.arc < len(letters)]
        self.piece_at = np.array([ends.get(i, -1) for i in range(len(nodes) + 1)], np.int32)
        v = len(self.text)
        self.lefts, self.rights, self.ranks, self.plains = np.full(v, -1, np.int64), np.full(v, -1, np.int64), np.full(v, -1, np.int64), np.zeros(v, bool)
        for into, of in ((self.lefts, self.left), (self.rights, self.right), (self.ranks, self.rank), (self.plains, self.plain)):
            into[list(of)] = list(of.values())
        del self.left, self.right, self.rank  # the arrays stay
        self.possible = np.zeros(v, bool)
        self.possible[list(self.plain)] = True
        # two pieces whose concatenation is a piece
        joins = np.array(sorted((self.ids[p[:k]] * v + self.ids[p[k:]], int(self.ranks[i])) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids), np.int64).reshape(-1, 2)
        self.joined, self.joined_rank = np.ascontiguousarray(joins[:, 0]), np.ascontiguousarray(joins[:, 1])
        self.pair, self.pair_stable = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)
        self.byte_ids = np.array([self.bytes[i] for i in range(256)], np.int32)
        self.out_size = np.array([len(x) for x in self.output], np.int64)
        self.out_start = np.cumsum(self.out_size) - self.out_size
        self.out_bytes = np.frombuffer(b"".join(self.output), np.uint8)

    def _tree(self, piece: str, i: int) -> None:
        if len(piece) == 1:
            self.plain[i] = True
            return
        got, last = self.merged(piece)
        if got == [i]:
            a, b = last
            self.left[i], self.right[i] = a, b
            # ties between different pieces, or a part of worse score: not ordered
            self.plain[i] = self.plain.get(a, False) and self.plain.get(b, False) and self.rank[a] < self.rank[i] and self.rank[b] < self.rank[i]

    def merged(self, text: str) -> tuple[list[int], tuple[int, int]]:
        """Ids that merging yields by score and then from the left, and the last merge."""
        sym: list[str | None] = list(text)
        after, before = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(sym):
                s = sym[i] + sym[j]
                if (k := self.ids.get(s)) is not None:
                    heapq.heappush(heap, (-self.score[k], i, j, s))

        for i in range(len(sym) - 1):
            offer(i, i + 1)
        last = (-1, -1)
        while heap:
            _, i, j, s = heapq.heappop(heap)
            if sym[i] is None or sym[j] is None or after[i] != j or sym[i] + sym[j] != s:
                continue
            last = (self.ids[sym[i]], self.ids[sym[j]])
            sym[i], sym[j] = s, None
            after[i] = after[j]
            if after[i] < len(sym):
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        out: list[int] = []
        for s in sym:
            if s is not None:
                out += [self.ids[s]] if s in self.ids else [self.bytes[x] for x in s.encode()]
        return out, last

    def stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the arcs from pieces a to pieces b weigh 0; distinct pairs."""
        out = self.possible[a] & self.possible[b]
        for i in np.flatnonzero(out & ~(self.plains[a] & self.plains[b])).tolist():
            out[i] = self.merged(self.text[a[i]] + self.text[b[i]])[0] == [a[i], b[i]]
        live = np.flatnonzero(out & self.plains[a] & self.plains[b])
        a, b, limit = a[live].copy(), b[live].copy(), np.full(len(live), 1 << 60)
        while len(live):
            key = a * len(self.text) + b
            at = np.minimum(np.searchsorted(self.joined, key), len(self.joined) - 1)
            broken = (self.joined[at] == key) & (self.joined_rank[at] < limit)
            out[live[broken]] = False
            ra, rb = self.ranks[a], self.ranks[b]
            go = np.flatnonzero(~broken & ((ra >= 0) | (rb >= 0)))
            live, a, b, ra, rb = live[go], a[go], b[go], ra[go], rb[go]
            back = ra > rb  # the later merge is undone
            limit = np.where(back, ra, rb + 1)
            a, b = np.where(back, self.rights[a], a), np.where(back, b, self.lefts[b])
        return out

    def finite(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the arcs from a (negative: the start, or after a fallback character) to pieces b weigh 0."""
        out = self.possible[b]
        some = np.flatnonzero(a >= 0)
        key = a[some] * len(self.text) + b[some]
        slot = (key * 0x9E3779B1 >> 9) & (PAIRS - 1)
        new = self.pair[slot] != key
        good = self.pair_stable[slot]
        if new.any():
            fresh, back = np.unique(key[new], return_inverse=True)
            weights = self.stable(fresh // len(self.text), fresh % len(self.text))
            good[new] = weights[back]
            slot = (fresh * 0x9E3779B1 >> 9) & (PAIRS - 1)
            slot, first = np.unique(slot, return_index=True)  # one pair a slot
            self.pair[slot], self.pair_stable[slot] = fresh[first], weights[first]
        out[some] = good
        return out

    def _lattice(self, letters: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, length, piece) of all arcs of all positions; end: of each position's pre-token."""
        at = np.flatnonzero(letters >= 0)
        node = self.first[letters[at]]
        found = []
        for n in range(1, self.longest + 1):
            piece = self.piece_at[node]
            here = np.flatnonzero(piece >= 0)
            found.append((at[here], np.full(len(here), n, np.int16), piece[here]))
            more = np.flatnonzero((at + n < end[at]) & (node < self.n_inner))
            at, node = at[more], node[more]
            c = letters[at + n]
            to = self.step[node * COMMON + np.minimum(c, COMMON - 1)]
            rare = np.flatnonzero(c >= COMMON)
            if len(rare):
                key = node[rare].astype(np.int64) * self.n_letters + c[rare]
                k = np.minimum(np.searchsorted(self.arc, key), len(self.arc) - 1)
                to[rare] = np.where(self.arc[k] == key, self.target[k], -1)
            ok = np.flatnonzero((to >= 0) & (c >= 0))
            at, node = at[ok], to[ok]
            if not len(at):
                break
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def paths(self, tokens: list[str]) -> list[bytes]:
        """Ids (int32 bytes) along the path of finite weight of each pre-token, given without its first space."""
        text = SPACE + SPACE.join(tokens).replace(" ", SPACE)
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        size = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
        stop = np.cumsum(size)
        start, local = stop - size, np.arange(len(code)) - np.repeat(stop - size, size)
        letters = self.letter[code]
        begin, n, piece = self._lattice(letters, np.repeat(stop, size))
        reached = local[begin] + n
        order = np.argsort(reached.astype(np.uint16) if len(reached) and reached.max() < 1 << 16 else reached, kind="stable")  # 16 bits are sorted by radix
        begin, n, piece = begin[order], n[order].astype(np.int64), piece[order].astype(np.int64)
        cut = np.searchsorted(reached[order], np.arange(1, int(size.max()) + 2))
        # state of the place before each character, of the start and of the end: last id (-1 start, -2 fallback, -3 unreached) and its length;
        # a token's end lies before the next one's start, so the places are one more a token
        place = np.arange(len(code)) + np.repeat(np.arange(len(tokens)), size)
        last, length = np.full(len(code) + len(tokens), -3, np.int64), np.ones(len(code) + len(tokens), np.int64)
        last[place[start]] = -1
        alone = np.flatnonzero(letters < 0)
        last[place[alone] + 1] = -2  # a fallback character ends in its one arc
        for k in range(len(cut) - 1):
            x = slice(cut[k], cut[k + 1])
            p = place[begin[x]]
            before, b, step = last[p], piece[x], n[x]
            good = np.flatnonzero(before > -3)
            good = good[self.finite(before[good], b[good])]
            to = p[good] + step[good]
            last[to], length[to] = b[good], step[good]
        if (last == -3).any() and (last[place[stop - 1] + 1] == -3).any():
            raise ValueError("a pre-token has no path of finite weight")
        # back along the paths, all at once
        at, begins = place[stop - 1] + 1, place[start]
        on = np.zeros(len(last), bool)
        while len(at):
            on[at] = True
            at = at - length[at]
            more = np.flatnonzero(at > begins)
            at, begins = at[more], begins[more]
        back = np.flatnonzero(on)  # in order
        of = np.repeat(np.arange(len(tokens)), size + 1)[back]
        ids = last[back]
        # a fallback character is as many ids as it has bytes
        char = back - of - 1
        low = code[char]
        width = np.where(ids >= 0, 1, 1 + (low > 0x7F) + (low > 0x7FF) + (low > 0xFFFF))
        flat = np.repeat(ids, width).astype(np.int32)
        if (some := np.flatnonzero(ids < 0)).size:
            flat[flat < 0] = self.byte_ids[np.frombuffer("".join(map(chr, low[some].tolist())).encode(), np.uint8)]
        to = 4 * np.cumsum(np.bincount(of, weights=width, minlength=len(tokens))).astype(np.int64)
        raw = flat.tobytes()
        return [raw[a:b] for a, b in zip([0, *to[:-1].tolist()], to.tolist(), strict=True)]

    def _sweep(self, tokens: list[str]) -> None:
        """Adds the paths of pre-tokens to the table."""
        short = [x for x in tokens if len(x) <= LONG]
        parts = [short[i : i + SWEEP] for i in range(0, len(short), SWEEP)] + [[x] for x in tokens if len(x) > LONG]
        for part in parts:
            self.table.update(zip(part, self.paths(part), strict=True))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids (int32 bytes) of each text."""
        each = [pre_tokens(x) for x in texts]
        new = set().union(*each).difference(self.table)
        if len(self.table) + len(new) > TABLE:
            self.older, self.table = self.table, {}
            new = set().union(*each)
        # what the generation before has is kept on; a pre-token that doesn't come again goes with its generation
        again = new.intersection(self.older)
        self.table.update(zip(again, map(self.older.__getitem__, again), strict=True))
        self._sweep(list(new - again))
        return [b"".join(map(self.table.__getitem__, x)) for x in each]

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_all([text])[0], np.int32)

    def decode_all(self, ids: np.ndarray, n: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bytes, end of each) of rows of n ids each, one after another; a row's first space is left in."""
        size = self.out_size[ids]
        stop = np.cumsum(size)
        at = np.repeat(self.out_start[ids] - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)
        return self.out_bytes[at].tobytes(), np.concatenate([[0], stop])[np.cumsum(n)]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        out, _ = self.decode_all(ids, np.array([len(ids)]))
        return out[1:] if out[:1] == b" " else out

    def decode(self, ids) -> str:
        return self.decode_bytes(np.asarray(ids, np.int32)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """Compiled once in each process (32,000 pieces: about two seconds)."""
    return Transducer(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_ids, ids, round_trip (the ids decode to the text, U+2581 as a space) of each row of docs (doc_id, text)."""
    C.arrow_limits(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = transducer(path)
        for b in C.text_blocks(batches, limit=1 << 19):
            texts = C.column(b, "text").cast(pa.string()).to_pylist()
            rows = fst.encode_all(texts)
            n = np.fromiter(map(len, rows), np.int64, len(rows)) // 4
            ids = np.frombuffer(b"".join(rows), np.int32)
            got, stop = fst.decode_all(ids, n)
            want = [x and (" " + x.replace(SPACE, " ")).encode() for x in texts]
            same = [(got[i:j] == w) if w else i == j for i, j, w in zip([0, *stop[:-1].tolist()], stop.tolist(), want, strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([C.column(b, "doc_id"), pa.array(n), lists, pa.array(same)], ["doc_id", "n_ids", "ids", "round_trip"])

    return docs.select("doc_id", C.text_bytes()).mapInArrow(run, "doc_id long, n_ids long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded (with ids array<int>) with text; null ids decode to the empty string. Unknown ids fail."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = transducer(path)
        for b in batches:
            text = [fst.decode(x or []) for x in C.column(b, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], [*b.schema.names, "text"])

    source = encoded.drop("text")
    schema = StructType([*source.schema.fields, StructField("text", StringType())])
    C.arrow_limits(encoded.sparkSession)
    return source.mapInArrow(run, schema)


