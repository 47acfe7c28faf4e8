"""Deciders: what a text as a whole says about words that no detector or reader knows. Each takes texts (with _id, text and findings) and gives further findings
(_id, start, end, type, real, rule, strong); corpus.mask_corpus runs them by its option `more`, so what they decide is learned and masked like the rest.

What a decider says rests on names that are known already (findings of the same text, by their spelling): an anchor. Numbers, dates, durations, hashes, public words
and short common words are never decided."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..readers.base import PUBLIC
from . import conversation, known

RULES = ("call", "list", "column")
_EDGES = r"^[\"'`(\[{,;:|]+|[\"'`)\]},;:|.]+$"


def decidable(word: Column) -> Column:
    """May be a name: a letter in it, of four characters and more or the shape of an identifier; no number with a unit, date, hash, path or assignment, no public word."""
    low = F.lower(word)
    other = word.rlike(r"^[+\-]?[0-9][0-9.,:/\-]*[\p{L}%]{0,3}$|^[0-9a-fA-F]{32,64}$|^[0-9]{4}-[0-9]{2}|[=<>{}()$\\/@]|://|^-") | low.isin(*sorted(PUBLIC))
    return word.rlike(r"\p{L}") & ((F.length(word) >= 4) | known.identifier_shape(word)) & (F.length(word) <= 128) & ~other


def _spans(words: DataFrame, kind: Column, rule: str) -> DataFrame:
    return words.select("_id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), kind.alias("type"), F.col("word").alias("real"), F.lit(rule).alias("rule"), F.lit(True).alias("strong"))


def names_of(found: DataFrame) -> DataFrame:
    """_id, word, type of the object names that a text's findings hold: of one spelling, the first."""
    each = found.select("_id", F.inline("findings")).where(F.col("type").startswith("obj."))
    return each.groupBy("_id", F.col("real").alias("word")).agg(F.min_by("type", F.struct("start", "type")).alias("type"))


def words_of(found: DataFrame, text: str = "text") -> DataFrame:
    """_id, line, n_words, pos (from the left), word, start, end of the words of each line, without signs around them."""
    line = lambda x, at: F.when(x["match"].isNotNull(), F.struct(at.alias("at"), x["match"].alias("line_text")))
    lines = found.where(F.col(text).isNotNull()).select("_id", F.posexplode(F.array_compact(T.located(F.col(text), r"[^\n]*[^\s][^\n]*", 0, line))).alias("line", "l")).select("_id", "line", "l.at", "l.line_text")
    word = lambda x, at: F.when(x["match"].isNotNull(), F.struct(at.alias("at"), x["match"].alias("raw")))
    listed = lines.withColumn("_words", F.array_compact(T.located(F.col("line_text"), r"\S+", 0, word)))
    each = listed.select("_id", "line", "at", "line_text", F.size("_words").alias("n_words"), F.posexplode("_words").alias("pos", "w"))
    bare = F.regexp_replace("w.raw", _EDGES, "")
    lead = F.length(F.regexp_extract("w.raw", r"^[\"'`(\[{,;:|]*", 0))
    start = F.col("at") + F.col("w.at") + lead
    return each.select("_id", "line", "line_text", "n_words", "pos", bare.alias("word"), start.alias("start"), (start + F.length(bare)).alias("end"))


def parallel_records(found: DataFrame, text: str = "text", least: int = 3) -> DataFrame:
    """Words of texts in blocks of parallel records: lines one below the other whose numbers of words differ by one at most. Lines of dashes and headers in capitals part blocks. Each word comes with its
    block and its places from the left and from the right (a record may have one word more)."""
    words = words_of(found, text)
    ruled = F.col("line_text").rlike(r"^[\s\-=+|]*-{3,}[\s\-=+|]*$|^[^a-z]*[A-Z]{2}[^a-z]*$")
    lines = words.groupBy("_id", "line").agg(F.max("n_words").alias("n_words"), F.max(ruled).alias("ruled"))
    w = Window.partitionBy("_id").orderBy("line")  # the lines of one text
    new = F.when(F.col("ruled") | F.coalesce(F.lag("ruled").over(w), F.lit(True)) | (F.abs(F.col("n_words") - F.lag("n_words").over(w)) > 1) | (F.col("line") - F.lag("line").over(w) > 1), 1).otherwise(0)
    blocks = lines.withColumn("_new", new).withColumn("block", F.sum("_new").over(w)).where(~F.col("ruled"))
    sizes = blocks.groupBy("_id", "block").agg(F.count("*").alias("records")).where(F.col("records") >= least)
    return words.join(blocks.select("_id", "line", "block"), ["_id", "line"]).join(sizes, ["_id", "block"]).withColumn("back", F.col("n_words") - F.col("pos"))


def by_identity(found: DataFrame, text: str = "text", command: str | None = None) -> DataFrame:
    """Decider of calls: in a block of parallel records, the place where all values differ, beside one with values that repeat, says which record it is (a list of one word a line says so too). Its words are names if some
    place of the block holds a known one: of the type that is most frequent among the known ones at that place (from either side), else of the one in the block. Words of the command (a column) didn't come from the data."""
    words = parallel_records(found, text).where(F.col("word") != "").join(names_of(found), ["_id", "word"], "left")
    sides = words.select("*", F.explode(F.array(F.struct(F.lit("left").alias("side"), F.col("pos").alias("place")), F.struct(F.lit("right").alias("side"), F.col("back").alias("place")))).alias("s")).select("*", "s.side", "s.place")
    stats = sides.groupBy("_id", "block", "side", "place", "records").agg(F.count("*").alias("n"), F.count_distinct("word").alias("n_words_here"), F.mode("type", True).alias("here"))
    whole = stats.groupBy("_id", "block").agg(F.max(F.col("n_words_here") < F.col("n")).alias("repeats"), F.max(F.col("place")).alias("places"), F.max(F.struct(F.col("here").isNotNull().alias("known"), F.col("here").alias("type"))).alias("any"))
    good = stats.where((F.col("n") == F.col("records")) & (F.col("n_words_here") == F.col("n"))).join(whole, ["_id", "block"]).where(F.col("any.known") & (F.col("repeats") | (F.col("records") == F.col("n")) & (F.col("places") <= 1)))
    # the leftmost such place, by the side that has it
    first = good.groupBy("_id", "block").agg(F.min(F.struct(F.when(F.col("here").isNotNull(), 0).otherwise(1).alias("without"), (F.col("side") == "right").alias("from_right"), "place", "side", F.coalesce("here", "any.type").alias("type"))).alias("best"))
    chosen = sides.where("type is null").drop("type").join(first, ["_id", "block"]).where((F.col("side") == F.col("best.side")) & (F.col("place") == F.col("best.place")) & decidable(F.col("word")))
    if command:
        said = found.select("_id", F.col(command).alias("_said"))
        chosen = chosen.join(said, "_id").where(F.col("_said").isNull() | ~F.expr("contains(_said, word)"))
    return _spans(chosen, F.col("best.type"), "call")


def by_list(found: DataFrame, text: str = "text") -> DataFrame:
    """Decider of lists: unknown items of a literal or dashed list whose known items are all of one type, and all of whose items have the shape of a name."""
    one = lambda x, at: F.when(x["match"].isNotNull(), F.struct(at.alias("at"), x["match"].alias("m")))
    lists = F.concat(F.array_compact(T.located(F.col(text), conversation._LITERALS, 0, one)), F.array_compact(T.located(F.col(text), conversation._DASHED, 0, one)))
    each = found.where(F.col(text).isNotNull()).select("_id", F.explode(lists).alias("l")).select("_id", F.col("l.at").alias("block"), "l.m")
    items = each.select("_id", "block", F.explode(F.array_compact(T.located(F.col("m"), r"[\w.][\w.\-]*", 0, one))).alias("i")).select("_id", "block", F.col("i.m").alias("word"), (F.col("block") + F.col("i.at")).alias("start"))
    items = items.withColumn("end", F.col("start") + F.length("word")).join(names_of(found), ["_id", "word"], "left")
    of = items.groupBy("_id", "block").agg(F.count_distinct("type").alias("_types"), F.min("type").alias("_type"), F.bool_and(known.identifier_shape(F.col("word"))).alias("_names")).where("_types = 1 and _names")
    return _spans(items.where("type is null").drop("type").join(of, ["_id", "block"]).where(decidable(F.col("word"))), F.col("_type"), "list")


def by_command(command: str, text: str = "text") -> Callable[[DataFrame], DataFrame]:
    """Decider of hints: the first word of each line that a listing command (a column with the call's text) printed is a name of what the command asks for."""

    def decide(found: DataFrame) -> DataFrame:
        asked = found.withColumn("_entity", conversation.requested_entity(F.col(command))).where("_entity is not null")
        words = words_of(asked, text).where((F.col("pos") == 0) & ~F.col("line_text").rlike(r"^[A-Z0-9 _()\-|]+$")).join(asked.select("_id", "_entity"), "_id")
        return _spans(words.where(known.identifier_shape(F.col("word")) & decidable(F.col("word"))), F.concat(F.lit("obj."), "_entity"), "hint")

    return decide


def in_order(*deciders: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """One decider of several: for each place, what the first of them says."""

    def decide(found: DataFrame) -> DataFrame:
        every = None
        for rank, d in enumerate(deciders):
            one = d(found).withColumn("_rank", F.lit(rank))
            every = one if every is None else every.unionByName(one)
        first = every.groupBy("_id", "start", "end").agg(F.min(F.struct("_rank", "type", "real", "rule", "strong")).alias("d"))
        return first.select("_id", "start", "end", "d.type", "d.real", "d.rule", "d.strong")

    return decide
