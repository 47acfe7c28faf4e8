"""Conversations: positions, calls and results, names that a whole conversation shares, contagion to what the model wrote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def positions(rows: DataFrame, conv: str, order: str, text: str = "text", role: str = "role") -> DataFrame:
    """rows with position: 128 bits of all turns up to each one, so equal histories have equal positions.

    Each turn's hash with its number in the conversation; the running exclusive or of these is one pass of a window, in memory of one row."""
    own = F.sha2(F.concat_ws("\x00", F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))), 256)
    hashed = rows.withColumn("__own", own).withColumn("__turn", F.row_number().over(Window.partitionBy(conv).orderBy(order, "__own")))
    upto = Window.partitionBy(conv).orderBy(order, "__own").rowsBetween(Window.unboundedPreceding, 0)
    half = lambda *x: F.lpad(F.hex(F.bit_xor(F.xxhash64(*x)).over(upto)), 16, "0")
    return hashed.withColumn("position", F.concat(half("__turn", "__own"), half("__own", F.lit("position"), "__turn"))).drop("__own", "__turn")


def calls_and_results(rows: DataFrame, conv: str) -> DataFrame:
    """Tool results with their call's tool and text, by the id they share."""
    call = rows.where("block = 'tool_use'").select(conv, "tool_id", F.col("tool").alias("call_tool"), F.col("text").alias("call_text"))
    result = rows.where("block = 'tool_result'").drop("tool", "block")
    return result.join(call, [conv, "tool_id"], "left")


# Nouns of listing commands and the entity of what they list.
NOUNS = {"pods": "service", "pod": "service", "services": "service", "svc": "service", "deployments": "service", "deploy": "service", "namespaces": "namespace", "ns": "namespace", "nodes": "server", "databases": "database", "tables": "table", "schemas": "schema", "buckets": "bucket", "queues": "queue", "topics": "queue", "users": "user", "roles": "user", "repos": "repository", "clusters": "server", "instances": "server"}


def requested_entity(command: Column) -> Column:
    """The entity that a command asks for: SHOW or list verbs with a noun, or the columns of a catalog query."""
    noun = F.lower(F.regexp_extract(command, r"(?i)\b(?:get|list|ls|show|describe)[ -]+(?:all +)?([a-z]+)", 1))
    table = F.create_map(*[F.lit(x) for kv in NOUNS.items() for x in kv])
    catalog = F.lower(F.regexp_extract(command, r"(?i)\bselect\s+(?:distinct\s+)?\w*?\.?(table|schema|column|database|user)_?name\b", 1))
    return F.coalesce(F.element_at(table, noun), F.when(catalog != "", catalog))


def hinted_names(results: DataFrame, *keys: str, text: str = "text", command: str = "call_text") -> DataFrame:
    """keys, entity, name: the first word of each line that a listing command printed (not headers)."""
    typed = results.withColumn("__entity", requested_entity(F.col(command))).where("__entity is not null")
    lines = typed.select(*keys, F.col("__entity").alias("entity"), F.explode(F.split(text, "\n")).alias("line"))
    name = F.regexp_extract("line", r"^\s*(?:\|\s*)?([A-Za-z0-9][\w.\-]{2,100})", 1)
    return lines.where(name.rlike(r"[_.0-9\-]") & ~F.col("line").rlike(r"^[A-Z0-9 _()\-|]+$")).select(*keys, "entity", name.alias("name")).distinct()


# --- columns that a command cuts out of a file ------------------------------------------------------------------------------------------------


def cut_field(command: Column) -> Column:
    """(file, separator, field) of a command that prints one field of a file: cut -d, -f2 FILE, or awk -F, '{print $2}' FILE; null for others."""
    cut = lambda g: F.regexp_extract(command, r"\bcut\s+(?:-s\s+)?(?:-d\s*['\"]?([^'\"\s])['\"]?\s+)?-f\s*([0-9]+)\s+(?:--\s+)?([^\s|;&<>]+)", g)
    awk = lambda g: F.regexp_extract(command, r"\bawk\s+(?:-F\s*['\"]?([^'\"\s])['\"]?\s+)?'\s*(?:NR\s*>\s*1\s*)?\{\s*print\s+\$([0-9]+)\s*;?\s*\}'\s+([^\s|;&<>]+)", g)
    one = lambda get, default: F.struct(get(3).alias("file"), F.when(get(1) == "", default).otherwise(get(1)).alias("separator"), get(2).cast("int").alias("field"))
    return F.when(cut(3) != "", one(cut, "\t")).when(awk(3) != "", one(awk, " "))


def shown_file(command: Column) -> Column:
    """The file whose beginning a command prints; null for others."""
    got = F.regexp_extract(command, r"^\s*(?:head(?:\s+-n?\s*[0-9]+)?|cat|less|more)\s+([^\s|;&<>-][^\s|;&<>]*)\s*$", 1)
    return F.when(got != "", got)


def cut_columns(results: DataFrame, conv: str, order: str = "ord", text: str = "text", command: str = "call_text") -> DataFrame:
    """conv, order, label, value: the lines that a command cut out of a file, under the header that the conversation saw last before (an as-of join: a
    running last value over the file's shows and cuts, in order)."""
    cut = cut_field(F.col(command))
    rows = results.select(conv, order, text, cut.alias("_cut"), shown_file(F.col(command)).alias("_shown")).where("_cut is not null or _shown is not null")
    header = F.when(F.col("_shown").isNotNull(), F.substring_index(text, "\n", 1))
    seen = Window.partitionBy(conv, "_file").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    asof = rows.withColumn("_file", F.coalesce("_shown", "_cut.file")).withColumn("_header", F.last(header, True).over(seen)).where("_cut is not null and _header is not null")
    label = F.get(F.split("_header", F.concat(F.lit("\\Q"), F.col("_cut.separator"), F.lit("\\E"))), F.col("_cut.field") - 1)
    lines = asof.select(conv, order, F.trim(F.translate(label, "\"'`", "")).alias("label"), F.explode(F.split(text, "\n")).alias("value"))
    return lines.where("label is not null and trim(value) <> '' and value <> label")


# --- lists with a known member ------------------------------------------------------------------------------------------------------------------

_LITERALS = r"(?<![\w)\]])\[\s*(?:'[^'\n]{1,100}'|\"[^\"\n]{1,100}\")(?:\s*,\s*(?:'[^'\n]{1,100}'|\"[^\"\n]{1,100}\"))+\s*,?\s*\]"
_DASHED = r"(?m)(?:^[ \t]*-[ \t]+[\w.\-]{1,100}[ \t]*\n?){2,}"


def listed(texts: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """keys, block, name of the items of literal lists and of dashed lists in texts. Tuples and arguments of calls are no lists."""
    blocks = F.concat(F.regexp_extract_all(text, F.lit(_LITERALS), F.lit(0)), F.regexp_extract_all(text, F.lit(_DASHED), F.lit(0)))
    each = texts.select(*keys, F.posexplode(blocks).alias("block", "_list"))
    return each.select(*keys, "block", F.explode(F.array_distinct(F.regexp_extract_all("_list", F.lit(r"[\w.][\w.\-]*"), F.lit(0)))).alias("name"))


def anchored_lists(items: DataFrame, names: DataFrame, *keys: str) -> DataFrame:
    """keys, block, name, type of unknown items of lists (listed()) whose known members (names: keys, name, type) are all of one type, and all of whose
    items have the shape of a name."""
    typed = items.join(names.select(*keys, "name", "type"), [*keys, "name"], "left")
    shape = F.length("name").between(3, 128) & F.col("name").rlike(r"[_.0-9]|[A-Za-z]-[A-Za-z0-9]|[a-z][A-Z]")
    of = typed.groupBy(*keys, "block").agg(F.count_distinct("type").alias("_types"), F.min("type").alias("_type"), F.bool_and(shape).alias("_names")).where("_types = 1 and _names")
    return typed.where("type is null").join(of, [*keys, "block"]).select(*keys, "block", "name", F.col("_type").alias("type"))


def decided(*deciders: DataFrame, by: tuple[str, ...] = ("name",)) -> DataFrame:
    """by, type of each name: what the first decider in order says (ties within one: the least type). Each has the columns by and type."""
    every = None
    for rank, d in enumerate(deciders):
        one = d.select(*by, "type", F.lit(rank).alias("_rank"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy(*by).agg(F.min(F.struct("_rank", "type"))["type"].alias("type"))


# Types whose names are the same in any case.
CASELESS = ("obj.database", "obj.schema", "obj.table", "obj.column", "obj.procedure", "obj.index", "obj.server")


def memory(decisions: DataFrame, conv: str) -> DataFrame:
    """conv, word, type, name of each name decided in a conversation: of one word, the first decision."""
    g = decisions.where(F.length("real") >= 3)
    word = F.when(F.col("type").isin(*CASELESS), F.lower("real")).otherwise(F.col("real"))
    return g.groupBy(conv, word.alias("word")).agg(F.min_by("type", F.struct("ord", "start", "type")).alias("type"), F.min_by("real", F.struct("ord", "start", "real")).alias("name"))


def remembered(texts: DataFrame, names: DataFrame, conv: str, *keys: str, text: str = "text", most: int = 128) -> DataFrame:
    """keys, start, end, type, real, rule, strong: whole words of a conversation's texts that are its names, wherever they were decided (names of CASELESS types in
    any case, others as they are written)."""
    word = r"[\p{L}\p{N}_][\p{L}\p{N}_.\-]*[\p{L}\p{N}_]"
    found = F.filter(T.located(text_ := F.col(text), word, 0, lambda x, at: F.struct(at.alias("start"), x["match"].alias("real"))), lambda w: F.length(w["real"]).between(3, most))
    words = texts.where(text_.isNotNull()).select(conv, *keys, F.explode(found).alias("w")).select(conv, *keys, "w.start", "w.real")
    forms = words.withColumn("word", F.explode(F.array_distinct(F.array("real", F.lower("real")))))
    found = forms.join(names.select(conv, "word", "type"), [conv, "word"]).where((F.col("word") == F.col("real")) | F.col("type").isin(*CASELESS))
    return found.groupBy(conv, *keys, "start", "real").agg(F.min("type").alias("type")).select(conv, *keys, "start", (F.col("start") + F.length("real")).alias("end"), "type", "real", F.lit("memory").alias("rule"), F.lit(True).alias("strong"))


def anchored(items: DataFrame, block: str, ordinal: str) -> DataFrame:
    """block, ordinal, type of columns in which two or more distinct names of one type are known: the column's other names are of that type."""
    known = items.where("type is not null").groupBy(block, ordinal, "type").agg(F.count_distinct("name").alias("n"))
    best = known.where("n >= 2").groupBy(block, ordinal).agg(F.max_by("type", F.struct("n", "type")).alias("type"))
    return items.where("type is null").join(best.withColumnRenamed("type", "_type"), [block, ordinal]).withColumn("type", F.col("_type")).drop("_type")


def homogeneous(items: DataFrame, block: str, least: int = 3) -> DataFrame:
    """Items without a type, in lists of at least three, with the type that covers half of their list (ties by name)."""
    size = items.groupBy(block).agg(F.count("*").alias("size"))
    per = items.where("type is not null").groupBy(block, "type").agg(F.count("*").alias("n"))
    top = per.withColumn("_r", F.row_number().over(Window.partitionBy(block).orderBy(F.desc("n"), "type"))).where("_r = 1").drop("_r")
    good = top.join(size, block).where(f"size >= {least} and 2 * n >= size").select(block, F.col("type").alias("_type"))
    return items.where("type is null").join(good, block).withColumn("type", F.col("_type")).drop("_type")


def line_blocks(lines: DataFrame, doc: str, line: str, n_words: str) -> DataFrame:
    """lines with block: a new one begins where the number of words changes by more than one (gaps and islands)."""
    w = Window.partitionBy(doc).orderBy(line)
    new = F.when(F.abs(F.col(n_words) - F.lag(n_words).over(w)) <= 1, 0).otherwise(1)
    return lines.withColumn("_new", new).withColumn("block", F.sum("_new").over(w)).drop("_new")
