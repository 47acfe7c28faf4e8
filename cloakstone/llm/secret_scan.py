r"""Secret scans with corpus-wide ownership frequency, in Spark expressions only.

Base candidates are assignments to secret-like names, access-key ids and long hexadecimal runs; further candidates are provider-prefixed
tokens, private keys (header, body and footer) and mixed-case tokens with digits. The hash of each candidate is counted over the whole
corpus by distinct repositories (documents) and owners (sources): one that more than MAX_OWNERS owners carry is a widely copied example,
any other is owner-specific and looks live. A private key's hash is that of its body; a header without a body always looks live. Base
spans always stay; further spans stay only if they look live. Candidates inside a private key are part of it.

Positions come from splitting a text by a pattern: the piece and match lengths add up to code-point offsets. Counts are aggregated before
each shuffle; a hash that a third of all rows hold is one row of the table of verdicts, which is written before the join so that
Spark can split the hot side.

Defined results: null text is empty and has no spans; a null source is an owner of its own (""); repeated rows count once as repositories
and each get a row; an empty table gives no rows; other columns are ignored by find() and kept by redact(). Texts are never cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import common as C

#: More distinct owners than this make a candidate a copied example.
MAX_OWNERS = 2

_NAME = r"(password|passwd|secret|token|api_?key)"
ASSIGN = rf"""(?i){_NAME}["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # the maximal runs of 18 and more
HEX = r"[0-9a-f]{16,}"
#: A private key: header, body (group 2) and footer; a key without a footer ends with its last long base64 line, and its body may be empty.
PEM = (
    r"-----BEGIN ([A-Z ]{0,30})PRIVATE KEY-----((?:[^-]|-(?!----))*+(?=-----END \1PRIVATE KEY-----)|(?:(?:\s|\\[nr])*+[A-Za-z0-9+/]{32,}+=*+)*+)"
    r"(?:-----END \1PRIVATE KEY-----)?"
)
#: (kind, pattern), in the order of ties. Prefixes of public token formats.
FURTHER = (
    ("provider", r"(?:gh[opsu]_[A-Za-z0-9]{20,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{30,})"),
    ("private_key", PEM),
    ("opaque", r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{24,}+"),
)
SPANS = "array<struct<start:int,kind:int,end:int,hash:string>>"
KINDS = ("assign", "access", "hex", *(k for k, _ in FURTHER))
PRIVATE_KEY = KINDS.index("private_key")
#: In place of a hash: a candidate without a value to compare, which no owner shares with another.
NO_VALUE = ""


def _hashed(v: Column) -> Column:
    return F.sha2(v, 256)


def _body_hash(v: Column) -> Column:
    """Of a key's body without line breaks, plain or escaped: differently wrapped copies are equal."""
    body = F.regexp_replace(v, r"\s|\\[nr]", "")
    return F.when(body == "", F.lit(NO_VALUE)).otherwise(_hashed(body))


def _spans(text: Column, kind: int, pattern: str, keep=None, group: int = 0, hashed=_hashed) -> Column:
    """array<struct<start, kind, end, hash>> of the pattern's matches whose group passes keep, leftmost and without overlap."""
    def one(x: Column, at: Column) -> Column:
        return F.when(x["match"].isNotNull(), F.struct(at.alias("start"), (at + F.length(x["match"])).alias("end"), x["value"].alias("value")))

    good = lambda e: e.isNotNull() & keep(e["value"]) if keep else e.isNotNull()
    span = lambda e: F.struct(e["start"].alias("start"), F.lit(kind).alias("kind"), e["end"].alias("end"), hashed(e["value"]).alias("hash"))
    return F.when(text.rlike(pattern), F.transform(F.filter(T.located(text, pattern, group, one), good), span).cast(SPANS)).otherwise(F.array().cast(SPANS))


def _live_shape(v: Column) -> Column:
    return v.rlike("[0-9]") & v.rlike("[a-z]") & v.rlike("[A-Z]")


def apart(some: Column, taken: Column) -> Column:
    """The spans of some that overlap none of taken, in one pass: both in one array, in order of the place where a span of some ends and one of taken begins; a span overlaps
    if the greatest end of those that begin before its end lies behind its start."""
    ends = F.transform(some, lambda s: F.struct(s["end"].alias("at"), F.lit(0).alias("takes"), s.alias("span")))
    starts = F.transform(taken, lambda s: F.struct(s["start"].alias("at"), F.lit(1).alias("takes"), s.alias("span")))
    reach = lambda es: T.prefix_max(F.transform(es, lambda e: F.when(e["takes"] == 1, e["span"]["end"]).otherwise(0)))
    free = lambda es: F.filter(F.zip_with(es, reach(es), lambda e, r: F.when((e["takes"] == 0) & (r <= e["span"]["start"]), e["span"])), lambda s: s.isNotNull())
    return F.when((F.size(some) == 0) | (F.size(taken) == 0), some).otherwise(T.let(F.array_sort(F.concat(ends, starts)), free))


def scan(docs: DataFrame, owner: str = "source", *kept: str) -> DataFrame:
    """doc_id, owner, base and further candidates of each row, and its columns kept."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.concat(_spans(text, 0, ASSIGN, lambda v: F.length(v) >= 12, 2), _spans(text, 1, ACCESS), _spans(text, 2, HEX))
    options = {"private_key": {"group": 2, "hashed": _body_hash}, "opaque": {"keep": _live_shape}}
    more = F.concat(*[_spans(text, 3 + i, p, **options.get(k, {})) for i, (k, p) in enumerate(FURTHER)])
    found = docs.select(*kept, "doc_id", F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"), F.array_sort(base).alias("base"), more.alias("_more"))
    key = lambda m: m["kind"] == PRIVATE_KEY
    keys = F.filter("_more", key)  # a key stays whole, whatever its body looks like
    others = F.filter("_more", lambda m: ~key(m))
    further = F.when(F.size("_more") == 0, F.col("_more")).otherwise(F.array_sort(F.concat(keys, apart(others, F.concat("base", keys)))))
    return found.withColumn("further", further).drop("_more")


def ownership(found: DataFrame) -> DataFrame:
    """hash, repositories, owners: over how many distinct documents and owners each candidate is spread."""
    each = found.select("doc_id", "owner", F.explode(F.concat(F.transform("base", lambda s: s["hash"]), F.transform("further", lambda s: s["hash"]))).alias("hash"))
    repositories = each.groupBy("hash", "owner", "doc_id").agg(F.lit(1).alias("one"))
    owners = repositories.groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    return owners.groupBy("hash").agg(F.sum("repositories").alias("repositories"), F.count("*").alias("owners"))


def _text_of(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def judged(found: DataFrame, max_owners: int = MAX_OWNERS) -> DataFrame:
    """found (with a unique _id) and spans (base, and further ones that look live), n_live and n_copied candidates."""
    verdicts = C.written(ownership(found), "ownership").select("hash", ((F.col("owners") > max_owners) & (F.col("hash") != NO_VALUE)).alias("copied"))
    each = found.select("_id", F.explode(F.concat("base", "further")).alias("span")).select("_id", "span", F.col("span.hash").alias("hash"))
    seen = each.join(verdicts, "hash").groupBy("_id").agg(
        F.collect_list(F.when(~F.col("copied") & (F.col("span.kind") >= 3), F.col("span"))).alias("_live"),
        F.sum(F.when(F.col("copied"), 0).otherwise(1)).alias("n_live"), F.sum(F.when(F.col("copied"), 1).otherwise(0)).alias("n_copied"),
    )
    empty = F.array().cast(SPANS)
    out = found.join(seen, "_id", "left").withColumn("spans", F.array_sort(F.concat("base", F.coalesce("_live", empty))))
    return out.withColumn("n_live", F.coalesce("n_live", F.lit(0)).cast("long")).withColumn("n_copied", F.coalesce("n_copied", F.lit(0)).cast("long")).drop("_live")


def find(docs: DataFrame, owner: str = "source", max_owners: int = MAX_OWNERS) -> DataFrame:
    """A row for each row of docs (doc_id, text, owner): doc_id, base, further, spans (arrays), n_live, n_copied."""
    found = C.written(scan(docs, owner).withColumn("_id", F.monotonically_increasing_id()), "candidates")  # small, and _id is fixed from here on
    return judged(found, max_owners)


def digests(found: DataFrame) -> DataFrame:
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_text_of("base"), 256).alias("base_sha256"), _text_of("spans").alias("spans"), "n_live", "n_copied")


def redact(docs: DataFrame, owner: str = "source", mark: str = "[SECRET]", max_owners: int = MAX_OWNERS) -> DataFrame:
    """docs with each span of a secret replaced by mark, and n_chars (if there) counted anew; other columns as they are."""
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), "doc_id", "text", F.col(owner).alias("_owner"))
    found = C.written(scan(packed, "_owner", "_row").withColumn("_id", F.monotonically_increasing_id()), "candidates")
    # base spans need no verdict: only rows with further candidates meet the table of verdicts
    spans = judged(found.drop("_row"), max_owners).where(F.size("further") > 0).select("_id", "spans")
    both = found.where(F.size("further") > 0).select("_id", "_row").join(spans, "_id").select("_row", F.col("spans").alias("_spans"))
    both = both.unionByName(found.where(F.size("further") == 0).select("_row", F.col("base").alias("_spans")))
    text = F.col("_row.text")
    # spans that overlap the one before are one with it
    reach = T.prefix_max(F.transform("_spans", lambda s: s["end"]))
    first = lambda s, r: F.when(s["start"] >= r, s["start"])
    starts = F.array_compact(F.zip_with("_spans", reach, first))
    behind = F.concat(F.array_compact(F.slice(F.zip_with("_spans", reach, lambda s, r: F.when(s["start"] >= r, r)), F.lit(2), F.size("_spans"))), F.array(F.array_max(F.transform("_spans", lambda s: s["end"]))))
    merged = F.zip_with(starts, behind, lambda a, z: F.struct(a.alias("start"), z.alias("end")))
    new = T.spliced(text, merged, lambda _: F.lit(mark))
    both = both.select("_row", F.size("_spans").alias("_n"), F.when(F.size("_spans") == 0, text).otherwise(new).alias("_text"))
    changed = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("_n") == 0, F.col("_row.n_chars")).otherwise(F.length("_text").cast(docs.schema["n_chars"].dataType))
    return both.select(*[changed.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
