"""Keyed pseudonyms as Spark expressions: HMAC-SHA256 from nested sha2, base-32 ids, and the pseudonym of a value by type.

The key's pads stand in the plan as literals; use the expressions with keys that may appear there, or set spark.redaction.string.regex."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from .text import let
from .validators import valid_alpha_cnpj

ALPHABET = "abcdefghijklmnopqrstuvwxyz234567"

# The HMAC domain of each type whose domain isn't its own name.
DOMAINS = {
    "account": "conta", "address": "endereco", "birthdate": "nascimento", "card": "cartao", "certificate": "certidao", "cloud_account": "conta_nuvem",
    "column": "coluna", "domain": "dominio", "folder": "pasta", "index": "indice", "lawsuit": "processo", "name": "nome", "object": "objeto",
    "organization": "organizacao", "package": "pacote", "phone": "telefone", "quasi": "quase", "queue": "fila", "repository": "repositorio",
    "secret": "segredo", "sensitive": "sensivel", "server": "servidor", "service": "servico", "table": "tabela", "tracking": "rastreio", "user": "usuario",
}
# The prefix of each object entity.
PREFIXES = {
    "bucket": "BKT", "cloud_account": "ACC", "column": "C", "database": "DB", "folder": "DIR", "index": "IDX", "namespace": "NS", "object": "OBJ",
    "organization": "ORG", "package": "PKG", "procedure": "PROC", "queue": "TOP", "repository": "REPO", "schema": "SCH", "server": "HOST",
    "service": "SVC", "table": "T", "user": "USR",
}
# Entities whose names have no case, and types whose pseudonym comes from the digits.
CASELESS = ("column", "database", "index", "procedure", "schema", "server", "table")
NUMERIC = ("account", "card", "cep", "cnh", "cnpj", "cpf", "phone", "pis", "rg")


@dataclass(frozen=True)
class Key:
    """A 32-byte key, and the host roles that a host's pseudonym keeps."""

    secret: bytes
    roles: tuple[str, ...] = field(default=("mysql", "postgres", "redis", "kafka", "mongo", "oracle", "elastic", "rabbitmq", "airflow", "spark"))

    def hmac(self, message: Column) -> Column:
        """Hexadecimal HMAC-SHA256 of a binary column."""
        pad = self.secret.ljust(64, b"\0")
        inner, outer = bytes(b ^ 0x36 for b in pad), bytes(b ^ 0x5C for b in pad)
        return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), message), 256))), 256)

    def bits(self, domain: Column | str, value: Column, n: int) -> Column:
        """The first n bytes of HMAC(domain, 0, value), hexadecimal."""
        domain = F.lit(domain) if isinstance(domain, str) else domain
        return F.substring(self.hmac(F.concat(F.encode(domain, "UTF-8"), F.lit(b"\0"), F.encode(value, "UTF-8"))), 1, 2 * n)

    def id(self, domain: Column | str, value: Column) -> Column:
        """Eight base-32 characters (40 bits)."""
        letter = lambda v, i: F.substr(F.lit(ALPHABET), (F.shiftright(v, 35 - 5 * i).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1))
        return let(F.conv(self.bits(domain, value, 5), 16, 10).cast("long"), lambda v: F.concat(*[letter(v, i) for i in range(8)]))


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def hmac_domain(kind: Column) -> Column:
    return F.coalesce(_lookup(DOMAINS, kind), kind)


def unquoted(c: Column) -> Column:
    """Without brackets, quotes or backticks around it."""
    t = F.trim(c)
    return F.when(t.rlike(r'^(\[.*\]|".*"|`.*`)$') & (F.length(t) >= 2), F.substr(t, F.lit(2), F.length(t) - 2)).otherwise(t)


def canonical_object(entity: Column, real: Column) -> Column:
    return F.when(entity.isin(*CASELESS), F.lower(unquoted(real))).otherwise(unquoted(real))


def canonical_key(kind: Column, real: Column) -> Column:
    """The form by which two values are the same whatever their spelling: prefix by family, then the value."""
    entity = F.substr(kind, F.lit(5))
    obj = F.concat(F.when(entity.isin(*CASELESS), "o:").otherwise("O:"), canonical_object(entity, real))
    return (
        F.when(kind.startswith("obj."), obj).when(kind == "secret", F.concat(F.lit("s:"), real)).when(kind.isin("user", "doc"), F.concat(F.lit("u:"), T.norm_name(real)))
        .when(kind == "pix", F.concat(F.lit("c:"), F.lower(real))).when(kind.isin(*NUMERIC), F.concat(F.lit("n:"), T.canonical_number(real))).otherwise(F.concat(F.lit("p:"), T.norm_name(real)))
    )


def fake_ip(key: Key, real: Column) -> Column:
    """The address in a reserved network that stands for its /24; the last octet and the spelling (dots, hyphens, reverse name) stay."""
    suffix = F.regexp_extract(real, r"(?i)(\.in-addr\.arpa)$", 1)
    body = F.regexp_replace(real, r"(?i)\.in-addr\.arpa$", "")
    sep = F.when(body.contains("-"), "-").otherwise(".")
    parts = F.split(F.translate(body, "-", "."), r"\.")
    octets = F.when(suffix != "", F.reverse(parts)).otherwise(parts)
    byte = lambda h, i: F.conv(F.substring(h, 2 * i + 1, 2), 16, 10).cast("int")
    network = let(key.bits("rede24", F.array_join(F.slice(octets, 1, 3), "."), 3), lambda h: F.array((F.lit(240) + byte(h, 0).bitwiseAND(F.lit(15))).cast("string"), byte(h, 1).cast("string"), byte(h, 2).cast("string")))
    fake = F.concat(network, F.slice(octets, 4, 1))
    return let(F.when(suffix != "", F.reverse(fake)).otherwise(fake), lambda shown: F.concat(F.when(sep == "-", F.array_join(shown, "-")).otherwise(F.array_join(shown, ".")), suffix))


def object_pseudonym(key: Key, entity: Column, real: Column) -> Column:
    """Prefix and id; a mixed-case name flips letters of the id by an HMAC of its spelling, at least one."""
    prefix = F.coalesce(_lookup(PREFIXES, entity), F.lit("OBJ"))
    value = F.concat(hmac_domain(entity), F.lit("\0"), canonical_object(entity, real))
    return let(key.id("objeto", value), lambda ident: _object_shape(key, prefix, ident, real))


def _object_shape(key: Key, prefix: Column, ident: Column, real: Column) -> Column:
    letter = lambda i: F.substr(ident, F.lit(i + 1), F.lit(1))
    odd = lambda flips, i: F.conv(F.substring(flips, 2 * i + 2, 1), 16, 10).cast("int").bitwiseAND(F.lit(1)) == 1
    flipped = let(key.bits("caixa", real, 8), lambda flips: F.concat(*[F.when(odd(flips, i), F.upper(letter(i))).otherwise(letter(i)) for i in range(8)]))
    at_least = F.concat(F.regexp_extract(ident, "^([2-7]*)", 1), F.upper(F.regexp_extract(ident, "^[2-7]*([a-z]?)", 1)), F.regexp_extract(ident, "^[2-7]*[a-z]?(.*)$", 1))
    mixed = let(flipped, lambda f: F.concat(T.capitalised(prefix), F.lit("_"), F.when(f == ident, at_least).otherwise(f)))
    return F.when(F.lower(real) == real, F.concat(F.lower(prefix), F.lit("_"), ident)).when(F.upper(real) == real, F.concat(prefix, F.lit("_"), ident)).otherwise(mixed)


def _labelled(label: Column, ident: Column, real: Column) -> Column:
    case = T.letter_case(real)
    return F.concat(F.when(case == "a", F.lower(label)).when(case == "M", T.capitalised(label)).otherwise(label), F.lit("-"), ident)


def pseudonym(key: Key, kind: Column, real: Column, person: Column | None = None) -> Column:
    """The stable pseudonym of a value. person: the id of the registered person that the value names, if any."""
    low = F.lower(real)
    domain = F.when(kind == "email", "email").when(kind == "host", "host").otherwise(hmac_domain(kind))
    value = F.when(kind.isin("email", "host", "domain"), low).when(kind == "secret", real).when(kind.isin(*NUMERIC) & ~((kind == "cnpj") & valid_alpha_cnpj(real)), T.canonical_number(real)).otherwise(T.norm_name(real))
    ident = key.id(domain, value)
    known = ident if person is None else F.when(kind.isin("email", "name", "user"), F.coalesce(person, ident)).otherwise(ident)
    mail = F.substring(key.id("dominio", F.substring_index(low, "@", -1)), 1, 4)

    def shape(i: Column) -> Column:
        case, role = T.letter_case(real), F.substring_index(low, ".", 1)
        return (
            F.when(kind == "email", F.concat(F.lit("p."), i, F.lit("@d"), mail, F.lit(".invalid")))
            .when(kind == "name", F.when(case == "A", F.concat(F.lit("PERSON "), F.upper(i))).when(case == "a", F.concat(F.lit("person "), i)).otherwise(F.concat(F.lit("Person "), i)))
            .when(kind == "domain", F.concat(F.lit("d"), F.substring(i, 1, 4), F.lit(".invalid")))
            .when(kind == "host", F.when(role.isin(*key.roles), F.concat(role, F.lit("-"), F.substring(i, 1, 4), F.lit(".invalid"))).otherwise(F.concat(F.lit("h"), i, F.lit(".invalid"))))
            .when(kind == "secret", F.concat(F.lit("SECRET-"), i))
            .when(kind.isin(*NUMERIC), F.concat(F.upper(kind), F.lit("-"), i))
            .otherwise(_labelled(F.upper(F.regexp_replace(kind, "^[xt]:", "")), i, real))
        )

    return F.when(kind.startswith("obj."), object_pseudonym(key, F.substr(kind, F.lit(5)), real)).when(kind == "ip", fake_ip(key, real)).otherwise(let(known, shape))
