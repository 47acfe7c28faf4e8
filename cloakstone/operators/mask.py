"""Resolve overlapping findings, replace them by pseudonyms, keep the mapping, and undo the replacement."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as T
from ..plans.config import Config
from .detect import built, detect


#: In front of the id of a registered person, as the rule of a finding.
PERSON = "person:"


def resolved(findings: Column) -> Column:
    """The findings that are replaced: by start, then length (longest first), personal before object, then type; greedy without overlap."""
    key = F.transform(findings, lambda f: F.struct(f["start"].alias("start"), (f["start"] - f["end"]).alias("short"), f["type"].startswith("obj.").alias("object"), f["type"].alias("kind"), f.alias("f")))

    def step(acc: Column, k: Column) -> Column:
        f = k["f"]
        free = f["start"] >= acc["pos"]
        return F.struct(F.when(free, f["end"]).otherwise(acc["pos"]).alias("pos"), F.when(free, F.concat(acc["out"], F.array(f))).otherwise(acc["out"]).alias("out"))

    # parts of CHUNK findings are folded into arrays of their own: one growing array for all would be copied at each finding
    none = F.array().cast(T.SPANS)
    some = lambda ordered, i, pos: F.aggregate(F.slice(ordered, i * T.CHUNK + 1, F.lit(T.CHUNK)), F.struct(pos.alias("pos"), none.alias("out")), step)
    onward = lambda acc, r: F.struct(r["pos"].alias("pos"), F.concat(acc["out"], r["out"]).alias("out"))
    parts = lambda ordered: F.sequence(F.lit(0), F.floor((F.size(ordered) - 1) / T.CHUNK).cast("int"))
    greedy = lambda ordered: F.aggregate(parts(ordered), F.struct(F.lit(0).alias("pos"), none.alias("out")), lambda acc, i: T.let(some(ordered, i, acc["pos"]), lambda r: onward(acc, r)), lambda acc: acc["out"])
    return F.when(F.size(findings) < 2, findings).otherwise(T.let(F.array_sort(key), greedy))


def longest_first(findings: Column) -> Column:
    """Another resolution: the longest finding wins wherever it begins."""
    key = F.array_sort(F.transform(findings, lambda f: F.struct((f["start"] - f["end"]).alias("short"), f["start"].alias("start"), f["type"].alias("kind"), f.alias("f"))))
    zero = F.array().cast(T.SPANS)
    step = lambda acc, k: F.when(F.exists(acc, lambda o: (o["start"] < k["f"]["end"]) & (k["f"]["start"] < o["end"])), acc).otherwise(F.concat(acc, F.array(k["f"])))
    return F.array_sort(F.aggregate(key, zero, step))


def edits(findings: Column, pseudo) -> Column:
    """(start, end, type, pseudo, real) of each resolved finding. pseudo(type, real, person): the person that a registry names, or null."""
    person = lambda f: F.when(f["rule"].startswith(PERSON), F.substr(f["rule"], F.lit(len(PERSON) + 1)))
    return F.transform(findings, lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"), f["type"].alias("type"), pseudo(f["type"], f["real"], person(f)).alias("pseudo"), f["real"].alias("real")))


def spliced(text: Column, script: Column) -> Column:
    """The text with an edit script applied; a script with spans that overlap or leave the text gives null."""
    ends = F.concat(F.array(F.lit(0)), F.transform(script, lambda e: e["end"]))
    good = F.zip_with(script, F.slice(ends, 1, F.size(script)), lambda e, p: (e["start"] >= p) & (e["end"] > e["start"]) & (F.length(e["pseudo"]) > 0))
    fits = F.forall(good, lambda x: x) & (F.element_at(ends, -1) <= F.length(text))
    return F.when(F.size(script) == 0, text).when(fits, T.spliced(text, script, lambda e: e["pseudo"]))


def mask(df: DataFrame, key: ids.Key, text: str = "text", config: Config | None = None) -> DataFrame:
    """df with its text masked, n_replacements and edits. Detection runs once a row; all steps are expressions."""
    found = df if "findings" in df.columns else detect(df, text, config)
    script = built(lambda: edits(resolved(F.col("findings")), lambda kind, real, person: ids.pseudonym(key, kind, real, person)), "edits", key)
    out = found.withColumn("edits", script)
    out = out.withColumn(text, built(lambda: spliced(F.col(text), F.col("edits")), "spliced", text)).withColumn("n_replacements", F.size("edits"))
    return out.drop("findings")


def mask_distinct(df: DataFrame, key: ids.Key, text: str = "text", config: Config | None = None) -> DataFrame:
    """As mask(), but each distinct text is worked on once and joined back; worth it where texts repeat."""
    once = mask(df.select(text).distinct().withColumn("_source", F.col(text)), key, text, config).withColumnRenamed(text, "_masked")
    return df.join(once, df[text].eqNullSafe(once["_source"]), "left").drop(text, "_source").withColumnRenamed("_masked", text)


def mapping(masked: DataFrame, *scope: str) -> DataFrame:
    """scope, pseudo, real, type of each replacement, and of the domain within each e-mail."""
    each = masked.select(*scope, F.explode("edits").alias("e")).select(*scope, "e.pseudo", "e.real", "e.type")
    domain = each.where("type = 'email'").select(*scope, F.substring_index("pseudo", "@", -1).alias("pseudo"), F.substring_index("real", "@", -1).alias("real"), F.lit("domain").alias("type"))
    return each.unionByName(domain).distinct()


def same_value(kind: Column, real: Column) -> Column:
    """The form by which spellings under one pseudonym are one value; secrets and addresses only as they are."""
    entity = F.substr(kind, F.lit(5))
    return (
        F.when(kind.startswith("obj."), ids.canonical_object(entity, real)).when(kind.isin("secret", "ip"), real).when(kind.isin("email", "host", "pix", "domain"), F.lower(real))
        .when(kind.isin(*ids.NUMERIC), T.canonical_number(real)).when(kind == "name", F.lit("")).otherwise(T.norm_name(real))
    )


def collisions(table: DataFrame, *scope: str) -> DataFrame:
    """Pseudonyms that stand for more than one value: they stay masked."""
    return table.groupBy(*scope, "pseudo").agg(F.count_distinct(same_value(F.col("type"), F.col("real"))).alias("n_values"), F.count_distinct("real").alias("n_spellings")).where("n_values > 1")


def case_variants(table: DataFrame, *scope: str) -> DataFrame:
    """Other cases of labelled and object pseudonyms, where no replacement has them, so a pseudonym whose case was changed still comes back."""
    kind, pseudo = F.col("type"), F.col("pseudo")
    sep = F.when(kind.startswith("obj."), "_").otherwise("-")
    cased = ~kind.isin("email", "name", "ip", "host", "secret", "domain", *ids.NUMERIC)
    at = F.length(pseudo) - F.locate("\x01", F.reverse(F.translate(pseudo, "_-", "\x01\x01")))
    prefix, rest = F.substr(pseudo, F.lit(1), at), F.substr(pseudo, at + 1)
    other = F.array(F.concat(F.upper(prefix), rest), F.lower(pseudo), F.upper(pseudo), F.concat(T.capitalised(prefix), rest))
    more = table.where(cased & pseudo.contains("_") | cased & pseudo.contains("-")).select(*scope, F.explode(F.array_distinct(other)).alias("pseudo"), "real", "type", sep.alias("_sep")).drop("_sep")
    return more.join(table.select(*scope, "pseudo"), [*scope, "pseudo"], "left_anti").groupBy(*scope, "pseudo").agg(F.min_by("real", F.struct("real", "type")).alias("real"), F.min(F.struct("real", "type"))["type"].alias("type")).select(*scope, "pseudo", "real", "type")


def reverse_table(table: DataFrame, *scope: str) -> DataFrame:
    """scope, pseudo, real: one real value a pseudonym (the least spelling), without collisions, with case variants."""
    clean = table.join(collisions(table, *scope).select(*scope, "pseudo"), [*scope, "pseudo"], "left_anti")
    whole = clean.unionByName(case_variants(clean, *scope))
    return whole.groupBy(*scope, "pseudo").agg(F.min("real").alias("real"))


def lengths_of(pairs: dict[str, str]) -> dict[str, list[int]]:
    """Lengths of pseudonyms, the longest first, by their first two characters."""
    lengths: dict[str, list[int]] = {}
    for p in pairs:
        lengths.setdefault(p[:2], []).append(len(p))
    return {k: sorted(set(v), reverse=True) for k, v in lengths.items()}


def _replace(text: str, pairs: dict[str, str], lengths: dict[str, list[int]] | None = None) -> str:
    """Longest match at each position, left to right. Pseudonyms are tried by length, the lengths by first two characters (lengths_of(pairs), if it's there)."""
    lengths = lengths_of(pairs) if lengths is None else lengths
    out, last, i = [], 0, 0
    while i < len(text):
        for n in lengths.get(text[i : i + 2], ()):
            if (real := pairs.get(text[i : i + n])) is not None:
                out += (text[last:i], real)
                i = last = i + n
                break
        else:
            i += 1
    return "".join([*out, text[last:]])


_FAKE = re.compile(r"(?<![0-9.])(24[0-9]|25[0-5])\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})(?![0-9.])")


def _networks(pairs: dict[str, str]) -> dict[str, str]:
    """Fake /24 -> real /24 of the addresses in a mapping; one that stands for two is left out."""
    out: dict[str, str | None] = {}
    for pseudo, real in pairs.items():
        if _FAKE.fullmatch(pseudo) and re.fullmatch(r"[0-9.]+", real):
            a, b = pseudo.rsplit(".", 1)[0], real.rsplit(".", 1)[0]
            out[a] = b if out.get(a, b) == b else None
    return {a: b for a, b in out.items() if b}


def restore(text: str, pairs: dict[str, str], in_json: bool = False) -> str:
    """A text with its pseudonyms put back, also other addresses of a known fake network. in_json: real values are escaped to fit in a JSON string."""
    networks = _networks(pairs)
    if in_json:
        pairs = {p: json.dumps(r, ensure_ascii=False)[1:-1] for p, r in pairs.items()}
    out = _replace(text, pairs)
    return _FAKE.sub(lambda m: f"{networks[m[0].rsplit('.', 1)[0]]}.{m[4]}" if m[0].rsplit(".", 1)[0] in networks else m[0], out) if networks else out


def unmask(df: DataFrame, reverse: DataFrame, scope: str, text: str = "text", in_json: bool = False) -> DataFrame:
    """df with pseudonyms of its scope (a document, a conversation) put back. The scope's table comes to its rows by a join, as one map a scope,
    so nothing is broadcast or collected; a scope is what one reader sees."""
    maps = reverse.groupBy(scope).agg(F.map_from_entries(F.collect_list(F.struct("pseudo", "real"))).alias("__map"))
    joined = df.join(maps, scope, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text)
            new = [x if x is None or not m else restore(x, dict(m), in_json) for x, m in zip(b.column(at).to_pylist(), b.column(b.schema.get_field_index("__map")).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == at else c for i, c in enumerate(b.columns) if b.schema.names[i] != "__map"], [n for n in b.schema.names if n != "__map"])

    return joined.mapInArrow(run, joined.drop("__map").schema)


def unmask_calls(calls: DataFrame, reverse: DataFrame, scope: str, config: Config | None = None, tool: str = "tool", text: str = "text") -> DataFrame:
    """Tool calls with real values put back, but for tools that carry them away (config.no_unmask_tools: beginnings of names): those stay masked. A call
    of no known tool stays masked too."""
    stays = F.col(tool).isNull()
    for name in (config or Config()).no_unmask_tools:
        stays |= F.col(tool).startswith(name)
    return calls.where(stays).unionByName(unmask(calls.where(~stays), reverse, scope, text))


def leftovers(unmasked: DataFrame, table: DataFrame, scope: str, text: str = "text", most: int = 20) -> DataFrame:
    """Pseudonyms of ours that still stand in unmasked texts, up to `most` a scope (a report)."""
    seen = unmasked.select(scope, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"[A-Za-z]+[-_][a-zA-Z2-7]{8}|p\.[a-z2-7]{8}@d[a-z2-7]{4}\.invalid|[Pp]erson [a-z2-7]{8}"), F.lit(0)))).alias("pseudo"))
    return seen.join(table.select(scope, "pseudo").distinct(), [scope, "pseudo"], "left_semi").groupBy(scope).agg(F.slice(F.array_sort(F.collect_set("pseudo")), 1, most).alias("left"))


def quarantined(masked: DataFrame, *keys: str, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows that may go on, rejected rows with a reason): a text that couldn't be masked is never passed on."""
    bad = F.col(text).isNull() & (F.size("edits") > 0)
    return masked.where(~bad), masked.where(bad).select(*keys, F.lit("edit script does not fit the text").alias("reason"))
