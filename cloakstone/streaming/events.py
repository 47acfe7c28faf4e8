"""Unmasking of streamed answers of the four chat shapes: events in order, pseudonyms put back within each block although they come in pieces."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.mask import _replace
from ..sources.chats import pieces
from .unmask import Chunks

OUT = "stream string, seq long, event string"
_dense = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode


class Answer:
    """One streamed answer: each block's text is held back while it may be the beginning of a pseudonym."""

    def __init__(self, pairs: dict[str, str], held: dict[str, str] | None = None, like: Answer | None = None):
        """like: another of the same pairs, whose tables are taken over."""
        self.pairs, self.held = pairs, dict(held or {})
        self._tables = like._tables if like else {}

    def _chunks(self, escaped: bool, held: str = "") -> Chunks:
        """A block's text; the tables of pairs are made once, and once more with real values escaped to fit in a JSON string."""
        if (like := self._tables.get(escaped)) is None:
            pairs = {p: json.dumps(r, ensure_ascii=False)[1:-1] for p, r in self.pairs.items()} if escaped else self.pairs
            like = self._tables[escaped] = Chunks(pairs)
        return Chunks(like.pairs, held, like)

    def push(self, event: str) -> str:
        """The event with its pieces unmasked. What is held of a block that ends is put into its last piece, or into a piece of its own form
        in front of the end (joined by a line break). Events that aren't JSON (such as [DONE]) pass."""
        try:
            e = json.loads(event)
        except ValueError:
            return event
        if not isinstance(e, dict):
            return event
        found, ended = pieces(e)
        escaped = lambda key: key in ("partial_json", "arguments") or key == "delta" and "arguments" in e.get("type", "")
        last: dict[str, tuple] = {}
        for p in found:
            if not p.block:
                p.holder[p.key] = _replace(p.holder[p.key], self.pairs)
                continue
            chunks = self._chunks(escaped(p.key), self.held.get(p.block, ""))
            p.holder[p.key] = chunks.push(p.holder[p.key])
            self.held[p.block] = chunks.held
            last[p.block] = (p, chunks)
        before = []
        for block in [b for b in self.held if b in ended or "*" in ended]:
            rest = self.held.pop(block)
            if not rest:
                continue
            if block in last:
                p, chunks = last[block]
                p.holder[p.key] += chunks.close()
            else:
                before.append(_own_event(e, block, _replace(rest, self.pairs)))
        return "\n".join([*before, _dense(e)])


def _own_event(end: dict, block: str, text: str) -> str:
    """An event of the answer's shape that carries the rest of a block."""
    if end.get("type") == "content_block_stop":
        out = {"type": "content_block_delta", "index": end.get("index"), "delta": {"type": "text_delta", "text": text}}
    elif str(end.get("type", "")).startswith("response."):
        item, _, part = block.partition("/")
        out = {"type": "response.output_text.delta", "item_id": item, "content_index": int(part or 0), "delta": text}
    elif "choices" in end:
        i, _, call = block.partition("/")
        delta = {"tool_calls": [{"index": int(call), "function": {"arguments": text}}]} if call else {"content": text}
        out = {"choices": [{"index": int(i), "delta": delta}]}
    else:
        out = {"candidates": [{"index": int(block), "content": {"parts": [{"text": text}]}}]}
    return _dense(out)


class AnswerProcessor(StatefulProcessor):
    """Rows (stream, seq, event) of one answer; events out of order wait for the ones before."""

    def __init__(self, pairs: dict[str, str]):
        self.pairs, self.like = pairs, None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "seq long")
        self.held = handle.getMapState("held", "block string", "text string")
        self.waiting = handle.getMapState("waiting", "seq long", "event string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        upcoming = int(self.next.get()[0]) if self.next.exists() else 0
        pending = {int(r.seq): r.event for frame in rows for r in frame.itertuples()}
        for (seq,), (event,) in list(self.waiting.iterator()):
            pending[int(seq)] = event
            self.waiting.removeKey((seq,))
        answer, out = Answer(self.pairs, {b[0]: t[0] for b, t in self.held.iterator()}, self.like), []
        self.like = self.like or answer
        while upcoming in pending:
            out.append((*key, upcoming, answer.push(pending.pop(upcoming))))
            upcoming += 1
        self.next.update((upcoming,))
        for block in [b[0] for b, _ in self.held.iterator()]:
            self.held.removeKey((block,))
        for block, text in answer.held.items():
            self.held.updateValue((block,), (text,))
        for seq, event in pending.items():
            self.waiting.updateValue((seq,), (event,))
        yield pd.DataFrame(out, columns=["stream", "seq", "event"])

    def close(self) -> None:
        pass


def unmask_answers(events: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Streaming rows (stream, seq from 0, event as JSON) with pseudonyms put back. pairs: what one conversation's mapping holds."""
    return events.groupBy("stream").transformWithStateInPandas(AnswerProcessor(pairs), outputStructType=OUT, outputMode="append", timeMode="none")
