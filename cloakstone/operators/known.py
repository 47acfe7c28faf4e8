"""Learning names and applying them: known values, two-rule evidence, people, mail domains, validity and precedence, all as joins and aggregates.

A run learns from all texts first and applies to all then, so results don't depend on the order of arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as T
from ..sources.tables import written
from . import graph

# Types whose values are remembered, and entities whose names apply outside their place.
CONTEXTUAL = ("account", "birthdate", "card", "cep", "cnh", "cnpj", "cpf", "doc", "phone", "pis", "pix", "rg", "secret", "user")
PROPAGATES = ("bucket", "cloud_account", "database", "folder", "namespace", "organization", "package", "procedure", "queue", "repository", "schema", "server", "service", "table", "user")
# Mail domains that say nothing of an organisation, and mailboxes that are no person.
PUBLIC_MAIL = ("gmail.com", "googlemail.com", "hotmail.com", "outlook.com", "live.com", "msn.com", "yahoo.com", "yahoo.com.br", "icloud.com", "proton.me", "protonmail.com", "uol.com.br", "bol.com.br", "terra.com.br", "ig.com.br", "aol.com", "gmx.com", "gmx.de", "web.de", "mail.com", "zoho.com")
ROLES = ("admin", "contact", "contato", "help", "info", "no", "noreply", "office", "sales", "suporte", "support", "team", "vendas", "webmaster")


def identifier_shape(v: Column) -> Column:
    """Looks like a name of something technical: _ . digit, inner hyphen or camel case; no version, id or hash; 3 to 128 characters."""
    shaped = v.rlike(r"[_.0-9]|[A-Za-z]-[A-Za-z0-9]|[a-z][A-Z]")
    other = v.rlike(r"^v?[0-9]+(\.[0-9]+)*$|^[0-9a-fA-F]{32,64}$|^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
    return F.length(v).between(3, 128) & shaped & ~other


def learnable(found: DataFrame) -> DataFrame:
    """Findings (type, real, rule, strong) that teach: contextual values, and object names with evidence."""
    value = F.col("type").isin(*CONTEXTUAL) & (F.length("real") >= 4) & (~F.col("type").isin("user", "doc") | F.col("real").rlike("[0-9]"))
    entity = F.regexp_extract("type", r"^obj\.(.*)$", 1)
    name = entity.isin(*PROPAGATES) & (F.length("real") >= 4) & identifier_shape(F.col("real"))
    return found.where(value | name)


def two_rules(found: DataFrame) -> DataFrame:
    """key, n_rules of each value: a strong finding teaches alone, a weak one with a second, different rule."""
    key = ids.canonical_key(F.col("type"), F.col("real"))
    g = found.groupBy(key.alias("key")).agg(F.count_distinct("rule").alias("n_rules"), F.max("strong").alias("strong"))
    return g.where("strong or n_rules >= 2").select("key", "n_rules")


def known_values(found: DataFrame, *order: str) -> DataFrame:
    """key, type, real, n of each learned value: one type for one value, the first by order, start and type."""
    key = ids.canonical_key(F.col("type"), F.col("real"))
    taught = learnable(found).withColumn("key", key)
    return taught.join(two_rules(found).select("key"), "key", "left_semi").groupBy("key").agg(
        F.min_by("type", F.struct(*order, "start", "type")).alias("type"), F.min_by("real", F.struct(*order, "start", "real")).alias("real"), F.count("*").alias("n")
    )


def codes(text: Column) -> Column:
    """Words of 3 to 40 characters that can be a value: letters, digits, _ . -, without punctuation at the end."""
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9](?:[A-Za-z0-9_.\-]*[A-Za-z0-9])?"), F.lit(0)), lambda w: F.length(w).between(3, 40)))


def occurrences(texts: DataFrame, known: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """keys, key, type of each known single-word value within each text: distinct words join the known values, so nothing is searched text by text."""
    words = texts.select(*keys, F.explode(codes(F.col(text))).alias("word"))
    forms = words.select(*keys, F.explode(F.array_distinct(F.array(*[F.concat(F.lit(p), f) for p, f in (("s:", F.col("word")), ("O:", F.col("word")), ("o:", F.lower("word")), ("u:", T.norm_name(F.col("word"))), ("n:", T.canonical_number(F.col("word"))), ("c:", F.lower("word")))]))).alias("key"))
    return forms.join(known.select("key", "type"), "key").select(*keys, "key", "type").distinct()


def unify_types(found: DataFrame, *scope: str) -> DataFrame:
    """Object findings of a scope with one type for one name: of the first occurrence (by start, then type)."""
    name = F.lower(ids.unquoted(F.col("real")))
    w = Window.partitionBy(*scope, name)
    return found.withColumn("type", F.when(F.col("type").startswith("obj."), F.min_by("type", F.struct("start", "type")).over(w)).otherwise(F.col("type")))


def first_decision(decisions: DataFrame, scope: list[str], key: str, order: str, value: str) -> DataFrame:
    """scope, key and the value of the first decision by order (then value)."""
    return decisions.groupBy(*scope, key).agg(F.min_by(value, F.struct(order, value)).alias(value))


def valid_names(seen: DataFrame, today: Column, days: int = 90) -> DataFrame:
    """Names seen within the last days (seen_day: days since the epoch); others keep their id but don't apply."""
    return seen.where(F.col("seen_day") >= today - days)


def prune_oldest(seen: DataFrame, order: str, share: float = 0.1) -> DataFrame:
    """seen without its oldest share, by approximate quantile: no global sort."""
    cut = seen.select(F.percentile_approx(order, share, 10_000).alias("cut"))
    return seen.crossJoin(F.broadcast(cut)).where(F.col(order) >= F.col("cut")).drop("cut")  # one row of one number


def merge_seen(disk: DataFrame, run: DataFrame) -> DataFrame:
    """Two writers' tables (id, type, learned_day, seen_day) as one: earliest learned, last seen, a type by the least name."""
    return disk.unionByName(run).groupBy("id").agg(F.min("type").alias("type"), F.min("learned_day").alias("learned_day"), F.max("seen_day").alias("seen_day"))


def mail_names(found: DataFrame) -> DataFrame:
    """type, real learned from e-mail findings: an organisation's domain, and first.last as a person's name."""
    mail = found.where("type = 'email'").select(F.lower("real").alias("mail")).distinct()
    domain, box = F.substring_index("mail", "@", -1), F.substring_index("mail", "@", 1)
    public = domain.isin(*PUBLIC_MAIL) | domain.endswith(".invalid")
    domains = mail.where(~public).select(F.lit("domain").alias("type"), domain.alias("real"))
    parts = F.split(box, r"\.")
    person = (F.size(parts) == 2) & box.rlike(r"^[a-z]{3,}\.[a-z]{3,}$") & ~F.get(parts, F.lit(0)).isin(*ROLES)
    return domains.unionByName(mail.where(person).select(F.lit("name").alias("type"), F.initcap(F.replace(box, F.lit("."), F.lit(" "))).alias("real"))).distinct()


def registrable_label(domain: Column) -> Column:
    """The organisation's label of a domain."""
    parts = F.split(F.lower(domain), r"\.")
    n = F.size(parts)
    second = F.get(parts, n - 2)
    two = second.isin("com", "co", "org", "net", "gov", "edu", "ac") & (F.length(F.get(parts, n - 1)) == 2) & (n >= 3)
    return F.when(n < 2, F.lower(domain)).when(two, F.get(parts, n - 3)).otherwise(second)


def import_people(people: DataFrame, key: ids.Key) -> DataFrame:
    """kind (name, email, code), hash, person, words (of a name) of each identifier of a table (name, email, code): identifiers of one record are one person, and so are
    records that share any; a person's id is the least of its mail addresses, else of its identifiers. Full name, and first with last name, both count."""
    norm = T.norm_name(F.col("name"))
    words = F.split(norm, " ")
    short = F.when(F.size(words) > 2, F.concat_ws(" ", F.get(words, F.lit(0)), F.element_at(words, -1)))
    pairs = F.array(
        F.struct(F.lit("name").alias("kind"), norm.alias("v"), F.lit("nome").alias("d")), F.struct(F.lit("name").alias("kind"), short.alias("v"), F.lit("nome").alias("d")),
        F.struct(F.lit("email").alias("kind"), F.lower("email").alias("v"), F.lit("email").alias("d")), F.struct(F.lit("code").alias("kind"), T.norm_name(F.col("code")).alias("v"), F.lit("usuario").alias("d")),
    )
    rows = people.withColumn("_record", F.xxhash64("name", "email", "code")).select("_record", F.inline(pairs)).where("v is not null and trim(v) <> ''")
    each = rows.select("_record", "kind", key.id(F.col("d"), F.col("v")).alias("hash"), F.when(F.col("kind") == "name", F.size(F.split("v", " "))).alias("words"))
    # records and their identifiers are the nodes: whatever is joined by shared identifiers, over any number of records, is one person
    each = written(each.distinct(), "identifiers")
    record, own = F.concat(F.lit("r:"), F.col("_record").cast("string")), F.concat_ws(":", F.lit("i"), "kind", "hash")
    roots = written(graph.components(each.select(record.alias("a"), own.alias("b"))), "persons")
    of = each.join(roots.withColumnRenamed("root", "_root"), own == F.col("node"))
    person = of.groupBy("_root").agg(F.coalesce(F.min(F.when(F.col("kind") == "email", F.col("hash"))), F.min("hash")).alias("person"))
    return of.join(person, "_root").select("kind", "hash", "person", "words").distinct()


def name_candidates(text: Column, most: int = 6) -> Column:
    """Runs of 2 to most words that may be a name, in normalised form."""
    words = F.regexp_extract_all(T.norm_name(text), F.lit("[A-Z'\\-]+"), F.lit(0))
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(2), F.lit(most)), lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.flatten(runs))


def find_people(texts: DataFrame, registry: DataFrame, key: ids.Key, *keys: str, text: str = "text") -> DataFrame:
    """keys, candidate, person of each registered name within each text: hashes meet hashes, the registry holds no name."""
    names = texts.select(*keys, F.explode(name_candidates(F.col(text))).alias("candidate")).withColumn("hash", key.id("nome", F.col("candidate")))
    return names.join(registry.where("kind = 'name'").select("hash", "person"), "hash").select(*keys, "candidate", "person")


def software_proofs(texts: DataFrame, text: str = "text") -> DataFrame:
    """name, kind of public software that texts prove (an install, an import, an image run), except names that some text defines itself."""
    rules = (("install", r"(?m)\b(?:pip3?|npm|yarn|apt(?:-get)?|brew|gem|cargo|go) (?:install|add|get|i)\s+(?:-[-\w]+\s+)*([A-Za-z][\w.\-]{1,60})"), ("import", r"(?m)^\s*(?:import|from)\s+([A-Za-z_]\w{1,60})"), ("image", r"\bdocker (?:run|pull)\s+(?:-[-\w]+(?:[= ]\S+)?\s+)*([a-z][\w.\-/]{1,80})"))
    found = texts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all(text, F.lit(p), F.lit(1)).alias("names")) for k, p in rules])).alias("r")).select("r.kind", F.explode("r.names").alias("name"))
    local = texts.select(F.explode(F.regexp_extract_all(text, F.lit(r"(?m)^\s*(?:def|class|func|function|package|module)\s+([A-Za-z_]\w{1,60})"), F.lit(1))).alias("name")).distinct()
    return found.withColumn("name", F.lower("name")).distinct().join(local.withColumn("name", F.lower("name")), "name", "left_anti")


def public_first(words: DataFrame, scope: str) -> DataFrame:
    """scope, word of words that the model wrote before data brought them. words: scope, ord, from_data, word."""
    g = words.where("length(word) >= 3").groupBy(scope, F.lower("word").alias("word")).agg(F.min(F.when(F.col("from_data"), F.col("ord"))).alias("data"), F.min(F.when(~F.col("from_data"), F.col("ord"))).alias("model"))
    return g.where("model is not null and (data is null or model < data)").select(scope, "word")
