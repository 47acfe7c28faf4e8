"""Unmasking of texts that arrive in pieces: a piece that may be the beginning of a pseudonym is held back until it is whole."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.mask import _replace, lengths_of

OUT = "stream string, block string, seq long, text string"


class Chunks:
    """The text of one block: push() gives what is settled, close() the rest."""

    def __init__(self, pairs: dict[str, str], held: str = "", like: Chunks | None = None):
        """like: another of the same pairs, whose tables are taken over."""
        self.pairs, self.held = pairs, held
        self.starts = like.starts if like else {p[:k] for p in pairs for k in range(1, len(p))}
        self.longest = like.longest if like else max(map(len, pairs), default=0)
        self.lengths = like.lengths if like else lengths_of(pairs)

    def push(self, piece: str) -> str:
        text = self.held + piece
        # what stands behind the last whole pseudonym may be the beginning of one
        settled = 0
        i = 0
        while i < len(text):
            n = next((n for n in self.lengths.get(text[i : i + 2], ()) if n <= len(text) - i and text[i : i + n] in self.pairs), 0)
            i += n or 1
            settled = i if n else settled
        keep = next((k for k in range(min(self.longest - 1, len(text) - settled), 0, -1) if text[-k:] in self.starts), 0)
        # a whole pseudonym at the end may still be the beginning of a longer one
        for k in range(min(self.longest - 1, len(text)), keep, -1):
            if text[-k:] in self.starts and text[-k:] in self.pairs:
                keep = k
                break
        self.held = text[len(text) - keep :]
        return _replace(text[: len(text) - keep], self.pairs, self.lengths)

    def close(self) -> str:
        out, self.held = _replace(self.held, self.pairs, self.lengths), ""
        return out


class UnmaskProcessor(StatefulProcessor):
    """Rows (stream, block, seq, chunk, final, pairs) of one key (stream, block); pieces out of order wait for the ones before. The mapping of a stream comes with its
    first pieces and stays in the state; or one for all streams is given."""

    def __init__(self, pairs: dict[str, str] | None):
        self.pairs, self.like = pairs, None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", StructType([StructField("text", StringType()), StructField("next", StringType())]))
        self.waiting = handle.getMapState("waiting", "seq long", "chunk string, final boolean")
        self.mapping = handle.getMapState("mapping", "pseudo string", "real string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        text, upcoming = ("", 0)
        if self.held.exists():
            got = self.held.get()
            text, upcoming = got[0], int(got[1])
        pending = {}
        for frame in rows:
            for r in frame.itertuples():
                pending[int(r.seq)] = (r.chunk, bool(r.final))
                if self.pairs is None and r.pairs is not None:
                    for pseudo, real in dict(r.pairs).items():
                        self.mapping.updateValue((pseudo,), (real,))
        for (seq,), (chunk, final) in list(self.waiting.iterator()):
            pending[int(seq)] = (chunk, bool(final))
            self.waiting.removeKey((seq,))
        if self.pairs is None:
            state = Chunks({p: r for (p,), (r,) in self.mapping.iterator()}, text)
        else:
            state = Chunks(self.pairs, text, self.like)
            self.like = self.like or state
        out, closed = [], False
        while upcoming in pending and not closed:
            chunk, closed = pending.pop(upcoming)
            done = state.push(chunk or "") + (state.close() if closed else "")
            out.append((*key, upcoming, done))
            upcoming += 1
        if closed:
            self.held.clear()
            self.mapping.clear()
        else:
            self.held.update((state.held, str(upcoming)))
            for seq, value in pending.items():
                self.waiting.updateValue((seq,), value)
        yield pd.DataFrame(out, columns=["stream", "block", "seq", "text"])

    def close(self) -> None:
        pass


def unmask_stream(chunks: DataFrame, pairs: dict[str, str] | DataFrame) -> DataFrame:
    """Streaming rows (stream, block, seq from 0, chunk, final) with pseudonyms put back. pairs: a table (stream, pseudo, real), of which each stream gets its own part with the first piece
    of a block; or one small mapping for all streams."""
    if isinstance(pairs, dict):
        rows = chunks.select("stream", "block", "seq", "chunk", "final", F.lit(None).cast("map<string,string>").alias("pairs"))
        one = pairs
    else:
        maps = pairs.groupBy("stream").agg(F.map_from_entries(F.collect_list(F.struct("pseudo", "real"))).alias("pairs")).withColumn("seq", F.lit(0).cast("long"))  # of one stream
        rows, one = chunks.join(maps, ["stream", "seq"], "left").select("stream", "block", "seq", "chunk", "final", "pairs"), None
    return rows.groupBy("stream", "block").transformWithStateInPandas(UnmaskProcessor(one), outputStructType=OUT, outputMode="append", timeMode="none")


def windowed_audit(events: DataFrame, time: str = "ts", late: str = "1 hour", width: str = "1 day", by: str = "type") -> DataFrame:
    """Counts of a stream by time window and type; rows later than the watermark are left out."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")
