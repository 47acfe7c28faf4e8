"""Columns of real tables: what each holds by its name, and masking a table's columns in one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as T
from ..functions.labels import label_class


def describe(names: list[str], quasi: bool = False) -> dict[str, str]:
    """Class of each column name ('' if none). A name alone counts only beside another personal column."""
    found = {n: label_class(n, quasi) for n in names}
    personal = sum(c not in ("", "name_loose", "email") for c in found.values())
    return {n: ("name" if personal else "") if c == "name_loose" else c for n, c in found.items()}


def profile(df: DataFrame, quasi: bool = False) -> DataFrame:
    """column, class, n (values), n_distinct, n_dates of each column: one pass over the table."""
    classes = describe(df.columns, quasi)
    stats = [
        F.struct(F.lit(c).alias("column"), F.lit(classes[c]).alias("class"), F.count(df[c]).alias("n"), F.approx_count_distinct(df[c].cast("string")).alias("n_distinct"), F.count_if(df[c].cast("string").rlike(r"^\d{4}-\d{2}-\d{2}")).alias("n_dates"))
        for c in df.columns
    ]
    return df.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def masked_value(key: ids.Key, kind: str, value: Column) -> Column:
    kind = "name" if kind == "name_full" else kind
    text = value.cast("string")
    return F.when(text.isNull() | (F.trim(text) == ""), text).otherwise(ids.pseudonym(key, F.lit(kind), text))


def mask_columns(df: DataFrame, key: ids.Key, kinds: dict[str, str] | None = None) -> DataFrame:
    """df with sensitive columns replaced by pseudonyms. kinds: column -> type; by default by the columns' names."""
    kinds = {c: k for c, k in (describe(df.columns) if kinds is None else kinds).items() if k}
    return df.select(*[masked_value(key, kinds[c], df[c]).alias(c) if c in kinds else df[c] for c in df.columns])


def identity_columns(df: DataFrame, least: int = 3) -> DataFrame:
    """column, n, distinct, identity: a column identifies records if all its values differ beside one that repeats, over at least `least` records."""
    stats = [F.struct(F.lit(c).alias("column"), F.count(df[c]).alias("n"), F.count_distinct(df[c]).alias("distinct")) for c in df.columns]
    rows = df.agg(F.array(*stats).alias("s")).select("s", F.exists("s", lambda x: x["distinct"] < x["n"]).alias("repeats")).select("repeats", F.inline("s"))
    return rows.select("column", "n", "distinct", ((F.col("n") == F.col("distinct")) & F.col("repeats") & (F.col("n") >= least)).alias("identity"))


def column_types(df: DataFrame) -> DataFrame:
    """column, share of values that are names of data types: at least half makes the column beside it one of names."""
    kinds = r"(?i)^(var)?char|^n?varchar|^text|^string|^(big|small|tiny)?int(eger)?|^bigint|^decimal|^numeric|^float|^double|^bool(ean)?|^date(time)?|^timestamp|^binary|^uuid|^json|^array|^map|^struct"
    stats = [F.struct(F.lit(c).alias("column"), F.avg(F.when(df[c].cast("string").rlike(kinds), 1.0).otherwise(0.0)).alias("share")) for c in df.columns]
    return df.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def normalised_name(value: Column) -> Column:
    return T.norm_name(value)
