"""Chat requests of four public shapes as rows of one: conv_id, ord, role, block, tool_id, text. Also transcripts, logs, plain texts and people."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "ord int, role string, block string, tool_id string, tool string, text string"
#: Keys whose strings are never texts.
UNTOUCHED = {"signature", "id", "tool_use_id", "type", "name", "model", "cache_control", "media_type", "mime_type", "role", "call_id"}

class Text(NamedTuple):
    """A text of a request: what it is, and where it stands (holder[key])."""

    role: str
    block: str
    tool_id: str | None
    tool: str | None
    holder: Any
    key: Any

    @property
    def text(self) -> str:
        return self.holder[self.key]


def _leaves(holder: Any, key: Any) -> Iterator[tuple[Any, Any]]:
    """Places of the strings below holder[key], in order."""
    v = holder[key] if isinstance(holder, list) else holder.get(key)
    if isinstance(v, str):
        yield holder, key
    elif isinstance(v, list):
        for i in range(len(v)):
            yield from _leaves(v, i)
    elif isinstance(v, dict):
        for k in sorted(v):
            if k not in UNTOUCHED:
                yield from _leaves(v, k)


def _of(role: str, block: str, tool_id: str | None, tool: str | None, holder: Any, key: Any) -> Iterator[Text]:
    for at in _leaves(holder, key):
        yield Text(role, block, tool_id, tool, *at)


def _blocks(role: str, holder: dict, key: str) -> Iterator[Text]:
    """A message's content: a string, or blocks."""
    content = holder.get(key)
    if isinstance(content, str):
        yield Text(role, "text", None, None, holder, key)
        return
    for i, b in enumerate(content or []):
        if not isinstance(b, dict):
            yield from _of(role, "text", None, None, content, i)
            continue
        kind = b.get("type", "text")
        if kind == "tool_use":
            yield from _of(role, "tool_use", b.get("id"), b.get("name"), b, "input")
        elif kind.endswith("tool_result"):
            yield from _of("tool", "tool_result", b.get("tool_use_id"), None, b, "content")
        elif kind not in ("thinking", "redacted_thinking"):  # signed: never changed
            for k in sorted(b):
                if k != "source" and k not in UNTOUCHED:
                    yield from _of(role, kind, None, None, b, k)


def messages_shape(r: dict) -> Iterator[Text]:
    """system, tools and messages of content blocks."""
    for i, t in enumerate(r.get("tools") or []):
        yield from _of("system", "tool", None, t.get("name"), r["tools"], i)
    yield from _blocks("system", r, "system")
    for m in r.get("messages") or []:
        yield from _blocks(m.get("role", "user"), m, "content")


def completions_shape(r: dict) -> Iterator[Text]:
    """messages with tool_calls and tool messages."""
    for m in r.get("messages") or []:
        role = "system" if m.get("role") == "developer" else m.get("role", "user")
        if role == "tool":
            yield from _of("tool", "tool_result", m.get("tool_call_id"), None, m, "content")
            continue
        yield from _blocks(role, m, "content")
        for c in m.get("tool_calls") or []:
            f = c.get("function") or {}
            if f.get("arguments"):
                yield Text(role, "tool_use", c.get("id"), f.get("name"), f, "arguments")


def responses_shape(r: dict) -> Iterator[Text]:
    """instructions and input items."""
    yield from _blocks("system", r, "instructions")
    if isinstance(r.get("input"), str):
        yield Text("user", "text", None, None, r, "input")
        return
    for i in r.get("input") or []:
        kind = i.get("type", "message")
        if kind == "function_call" and i.get("arguments"):
            yield Text("assistant", "tool_use", i.get("call_id"), i.get("name"), i, "arguments")
        elif kind == "function_call_output":
            yield from _of("tool", "tool_result", i.get("call_id"), None, i, "output")
        elif kind == "message":
            yield from _blocks("system" if i.get("role") == "developer" else i.get("role", "user"), i, "content")


def contents_shape(r: dict) -> Iterator[Text]:
    """systemInstruction and contents of parts; also wrapped in "request"."""
    r = r.get("request", r)
    yield from _of("system", "text", None, None, r.get("systemInstruction") or {}, "parts")
    for c in r.get("contents") or []:
        role = "assistant" if c.get("role") == "model" else c.get("role", "user")
        for p in c.get("parts") or []:
            if call := p.get("functionCall"):
                yield from _of(role, "tool_use", call.get("id"), call.get("name"), call, "args")
            elif got := p.get("functionResponse"):
                yield from _of("tool", "tool_result", got.get("id"), got.get("name"), got, "response")
            elif isinstance(p.get("text"), str):
                yield Text(role, "text", None, None, p, "text")


def shape_of(r: dict) -> str:
    if "contents" in r or "contents" in (r.get("request") or {}):
        return "contents"
    if "input" in r:
        return "responses"
    first = (r.get("messages") or [{}])[0]
    return "completions" if "system" not in r and (first.get("role") in ("system", "developer") or any("tool_calls" in m or m.get("role") == "tool" for m in r.get("messages") or [])) else "messages"


SHAPES = {"messages": messages_shape, "completions": completions_shape, "responses": responses_shape, "contents": contents_shape}


def flatten(requests: DataFrame, *keys: str, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(rows of texts in order, rejected rows: keys and reason). body: a request's JSON. What can't be read is never passed on. Keys may not be named as
    the columns that come out."""
    if taken := set(keys) & {x.split()[0] for x in SCHEMA.split(", ")}:
        raise ValueError(f"rename the keys {sorted(taken)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, text in enumerate(b.column(b.schema.get_field_index(body)).to_pylist()):
                try:
                    r = json.loads(text)
                    found = [(o, t.role, t.block, t.tool_id, t.tool, t.text) for o, t in enumerate(SHAPES[shape_of(r)](r))]
                except (ValueError, TypeError, AttributeError, KeyError):
                    found = [(None, None, None, None, None, "not a readable request")]
                rows += found
                at += [i] * len(found)
            cols = [b.column(b.schema.get_field_index(k)).take(pa.array(at, pa.int64())) for k in keys]
            kinds = (pa.int32(), *[pa.string()] * 5)
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds, strict=True))], [*keys, "ord", "role", "block", "tool_id", "tool", "text"])

    from pyspark.sql.types import StructType

    schema = StructType([requests.schema[k] for k in keys])
    out = requests.select(*keys, body).mapInArrow(run, StructType([*schema.fields, *StructType.fromDDL(SCHEMA).fields]))
    return out.where("ord is not null"), out.where("ord is null").select(*keys, F.col("text").alias("reason"))


def rewrite(requests: DataFrame, masked: DataFrame, *keys: str, body: str = "body", text: str = "text") -> DataFrame:
    """requests with the masked texts (rows of flatten(): keys, ord, text) written back where they came from; everything else stays as it is.
    A request that can't be read, or whose rows aren't all there or are null, gets a null body: it must not be sent."""
    texts = masked.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("ord", text))).alias("_texts"))  # of one request
    joined = requests.join(texts, list(keys), "left")

    def put(value: str, new: dict[int, str | None]) -> str | None:
        r = json.loads(value)
        for o, t in enumerate(SHAPES[shape_of(r)](r)):
            if new.get(o) is None:
                return None
            t.holder[t.key] = new[o]
        return json.dumps(r, ensure_ascii=False, separators=(",", ":"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(body)
            out = []
            for value, new in zip(b.column(at).to_pylist(), b.column(b.schema.get_field_index("_texts")).to_pylist(), strict=True):
                try:
                    out.append(put(value, dict(new or ())))
                except (ValueError, TypeError, AttributeError, KeyError):
                    out.append(None)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if i == at else c for i, c in enumerate(b.columns) if b.schema.names[i] != "_texts"], [n for n in b.schema.names if n != "_texts"])

    return joined.mapInArrow(run, joined.drop("_texts").schema)


class Piece(NamedTuple):
    """A piece of a streamed answer: the block it belongs to, where it stands, and whether it's the block's last."""

    block: str
    holder: Any
    key: Any


def pieces(event: dict) -> tuple[list[Piece], list[str]]:
    """(pieces of text in an event of a streamed answer, blocks that end with it; "*": all), of the four shapes."""
    found, ended = [], []
    kind = event.get("type", "")
    if kind.startswith("response.") and not kind.endswith(".delta"):  # what ends or sums up has whole values: no block
        found += [Piece("", h, k) for part in ("text", "arguments", "part", "item", "response") for h, k in _leaves(event, part)]
    if kind == "content_block_delta":
        d = event.get("delta") or {}
        found += [Piece(str(event.get("index")), d, k) for k in ("text", "partial_json") if isinstance(d.get(k), str)]
    elif kind == "content_block_stop":
        ended.append(str(event.get("index")))
    elif kind.startswith("response."):
        block = f"{event.get('item_id')}/{event.get('content_index', 0)}"
        if kind.endswith(".delta") and isinstance(event.get("delta"), str):
            found.append(Piece(block, event, "delta"))
        elif kind.endswith(".done") and kind != "response.done":
            ended.append(block)
        elif kind in ("response.completed", "response.done", "response.failed", "response.incomplete"):
            ended.append("*")
    for c in event.get("choices") or []:
        d, i = c.get("delta") or {}, c.get("index", 0)
        if isinstance(d.get("content"), str):
            found.append(Piece(f"{i}", d, "content"))
        found += [Piece(f"{i}/{t.get('index', 0)}", t["function"], "arguments") for t in d.get("tool_calls") or [] if isinstance((t.get("function") or {}).get("arguments"), str)]
        if c.get("finish_reason"):
            ended.append("*")
    r = event.get("response") if isinstance(event.get("response"), dict) and "candidates" in event["response"] else event
    for i, c in enumerate(r.get("candidates") or []):
        for p in (c.get("content") or {}).get("parts") or []:
            if isinstance(p.get("text"), str):
                found.append(Piece(f"{c.get('index', i)}", p, "text"))
            elif call := p.get("functionCall"):
                found += [Piece("", h, k) for h, k in _leaves(call, "args")]  # whole values: no block
        if c.get("finishReason"):
            ended.append("*")
    return found, ended


def data_url(c):
    """media type and bytes of a data: URL; null if it isn't one."""
    media = F.regexp_extract(c, r"^data:([\w.+\-]+/[\w.+\-]+);base64,", 1)
    return F.when(media != "", F.struct(media.alias("media"), F.expr(f"try_to_binary(regexp_extract({c}, 'base64,(.*)$', 1), 'base64')").alias("data")))


def read_transcript(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, invalid lines) of a session in JSON lines: line, role, content as JSON, ts."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    parsed = lines.select("value", F.try_parse_json("value").alias("v"))
    good = parsed.where("v is not null").select(
        F.expr("try_variant_get(v, '$.type', 'string')").alias("type"), F.expr("coalesce(try_variant_get(v, '$.message.role', 'string'), try_variant_get(v, '$.role', 'string'))").alias("role"),
        F.expr("to_json(coalesce(try_variant_get(v, '$.message.content', 'variant'), try_variant_get(v, '$.content', 'variant')))").alias("content"), F.expr("try_variant_get(v, '$.timestamp', 'timestamp')").alias("ts"),
    )
    return good, parsed.where("v is null").select("value")


def read_people(spark: SparkSession, path: str, groups: list[tuple[str, str, str]], separator: str | None = None) -> DataFrame:
    """name, email, code from a CSV with a header; groups: columns (code, name, email) of each person on a row. A cell may hold several names."""
    df = spark.read.csv(path, header=True, mode="PERMISSIVE", multiLine=False, encoding="UTF-8")
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    out = None
    for code, name, email in groups:
        col = lambda c: F.trim(F.col(f"`{c}`")) if c in df.columns else F.lit(None).cast("string")  # noqa: B023, E731
        one = df.select(col(name).alias("name"), col(email).alias("email"), col(code).alias("code"))
        if separator:  # each name of the cell is a record with the row's code and mail
            one = one.withColumn("name", F.explode_outer(F.split("name", re.escape(separator)))).withColumn("name", F.trim("name"))
        out = one if out is None else out.unionByName(one)
    return out.where("coalesce(name, email, code, '') <> ''").distinct()


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
