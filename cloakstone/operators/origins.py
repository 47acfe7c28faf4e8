"""Where a result comes from: the files and resources that a command reads, under one name through renames and copies. With it as its scope, what one result teaches reaches
only results of the same source (contagion within a source)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import dropped, written
from . import graph

_ARG = r"(?:\"[^\"\n]{1,300}\"|'[^'\n]{1,300}'|[^\s|;&<>\"']{1,300})"
#: A command that prints a file: its last argument without options before it.
_PRINTS = rf"(?:^|[|;&]\s*|\bsudo\s+)(?:cat|head|tail|less|more|bat|tac|nl|zcat|jq|xxd|grep|awk|sed|cut|sort|uniq|wc)\b[^|;&<>\n]*?[ \t]({_ARG})[ \t]*(?=$|[|;&>\n])"
#: A client of a database or a store, by the option or address that says which.
_CLIENTS = (
    (rf"\bpsql\b[^|;&\n]*?[ \t](?:-d[ \t]*|--dbname[= ])({_ARG})", "db:"), (rf"\bmysql\b[^|;&\n]*?[ \t](?:-D[ \t]*|--database[= ])({_ARG})", "db:"), (rf"\bsqlcmd\b[^|;&\n]*?[ \t]-d[ \t]*({_ARG})", "db:"),
    (rf"\bsqlite3[ \t]+({_ARG})", ""), (r"\b((?:s3|gs|abfss?|hdfs)://[^\s\"'|;&]{1,300})", ""), (r"\b(?:curl|wget|http)\b[^|;&\n]*?(https?://[^\s\"'|;&?#]{1,300})", ""),
)
_MOVES = rf"(?:^|[|;&]\s*|\bsudo\s+)(?:cp|mv|ln|install)\b(?:[ \t]+-[\w\-]+)*[ \t]+({_ARG})[ \t]+({_ARG})[ \t]*(?=$|[|;&>\n])"


def _bare(c: Column) -> Column:
    """Without quotes, and without ./ before it."""
    return F.regexp_replace(F.regexp_replace(c, r"^([\"'])(.*)\1$", "$2"), r"^(?:\./)+", "")


def sources_of(command: Column) -> Column:
    """The files and resources that a command reads (distinct, in order of their kind); options and patterns are none."""
    files = F.filter(F.regexp_extract_all(command, F.lit(_PRINTS), F.lit(1)), lambda x: ~x.rlike(r"^-|^['\"]?[^/'\"]*[*{}$()\\]") & x.rlike(r"[./_]|^[\"']?\w+[\"']?$"))
    found = lambda pattern, kind: F.transform(F.regexp_extract_all(command, F.lit(pattern), F.lit(1)), lambda x: F.concat(F.lit(kind), _bare(x)))
    named = [found(p, k) for p, k in _CLIENTS]
    return F.array_distinct(F.concat(F.transform(files, _bare), *named))


def moves_of(command: Column) -> Column:
    """array<struct<a, b>> of the files that a command copies, renames or links."""
    a, b = (F.regexp_extract_all(command, F.lit(_MOVES), F.lit(g)) for g in (1, 2))
    return F.zip_with(a, b, lambda x, y: F.struct(_bare(x).alias("a"), _bare(y).alias("b")))


def with_source(rows: DataFrame, conv: str, command: str = "call_text", into: str = "source") -> DataFrame:
    """rows with the source of each: its conversation, and the first thing that its command reads, by the least name that copies and renames of the conversation give it. Null where the command
    reads nothing, so it shares with no other."""
    key = lambda c: F.concat(F.coalesce(F.col(conv).cast("string"), F.lit("")), F.lit("\0"), c)
    pairs = written(rows.where(F.col(command).isNotNull()).select(conv, F.explode(moves_of(F.col(command))).alias("m")).select(key(F.col("m.a")).alias("a"), key(F.col("m.b")).alias("b")), "moves")
    roots = written(graph.components(pairs), "sources")
    dropped(pairs)
    own = rows.withColumn("_own", key(F.get(sources_of(F.col(command)), F.lit(0))))
    return own.join(roots.withColumnRenamed("node", "_own"), "_own", "left").withColumn(into, F.coalesce("root", "_own")).drop("_own", "root")
