"""Readers of data languages: SQL, its errors, connection strings, catalog tables, schemas."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

from .base import PUBLIC, Name, group, identifier, internal_host, ownerless, parts, public_host, reader
from .tables import grids

# Words of SQL that are no names.
KEYWORDS = set(
    """select from where join inner left right full outer cross on using group by order having limit offset union all distinct as and or not in is null like ilike between exists case when then
    else end insert into values update set delete merge create replace alter drop truncate table view index schema database procedure function trigger sequence column constraint primary foreign
    key references unique check default cascade with recursive over partition rows range preceding following current row asc desc nulls first last top fetch next only for grant revoke to exec
    execute call use begin commit rollback declare cast convert interval date timestamp time true false if temporary temp materialized external add rename unlogged returning conflict do nothing
    any some lateral unnest qualify window filter within tablesample array struct cluster sort distribute count sum avg min max""".split()
)
_PART = r"(?:\[[^\]\n]{1,128}\]|\"[^\"\n]{1,128}\"|`[^`\n]{1,256}`|[A-Za-z_À-ÿ#@][\w$#À-ÿ]{0,127}(?:-[\w]{1,60})*)"
_QUALIFIED = rf"{_PART}(?:\.{_PART}){{0,3}}"
#: Where a statement begins; of a query and its common table expressions, a FROM must follow.
_HEAD = re.compile(
    r"\b(?:(?P<query>WITH\s+(?:RECURSIVE\s+)?[\w\"`\[\]]+\s*(?:\([^()]{0,500}\)\s*)?AS\s*(?:NOT\s+MATERIALIZED\s*|MATERIALIZED\s*)?\(|SELECT\b)|INSERT\s+INTO\b|UPDATE\s+\S{1,300}(?:\s+(?:AS\s+)?(?!SET\b)\w{1,60})?\s+SET\b|DELETE\s+FROM\b|MERGE\s+INTO\b|(?:CREATE|ALTER|DROP|TRUNCATE)\s+(?:OR\s+REPLACE\s+)?(?:\w+\s+){0,3}?(?:TABLE|VIEW|INDEX|SCHEMA|DATABASE|PROCEDURE|PROC|FUNCTION)\b|EXEC(?:UTE)?\s+(?=[\w\[]+[._])|CALL\s+[\w.]+\s*\()",
    re.I,
)
_FROM = re.compile(r"\bFROM\b", re.I)
_HARD = re.compile(r";|\n\s*\n|\nGO\b")
_STOP = re.compile(r";|\n\s*\n|\nGO\b|[\"']\s*[,)]")


def _statements(s: str) -> Iterator[tuple[int, int]]:
    """Places of statements, each up to its end whatever its length."""
    froms, hards, stops = ([m.start() for m in p.finditer(s)] for p in (_FROM, _HARD, _STOP))
    following = lambda places, at: places[k] if (k := bisect.bisect_left(places, at)) < len(places) else len(s)
    done = 0
    for m in _HEAD.finditer(s):
        if m.start() < done:
            continue
        at = m.end()
        if m["query"]:
            at = following(froms, at)
            if at >= following(hards, m.end()):
                continue
        done = following(stops, at)
        yield m.start(), done


_PLACE = re.compile(
    rf"\b(?P<kind>FROM|JOIN|INTO|UPDATE|USING|REFERENCES|TABLE(?:\s+IF\s+(?:NOT\s+)?EXISTS)?|VIEW(?:\s+IF\s+(?:NOT\s+)?EXISTS)?|ON(?=\s+{_QUALIFIED}\s*\()|EXEC(?:UTE)?|CALL|PROC(?:EDURE)?|FUNCTION|INDEX(?:\s+IF\s+NOT\s+EXISTS)?|DATABASE|SCHEMA)\s+(?P<name>{_QUALIFIED})",
    re.I,
)
_ENTITIES = {"exec": "procedure", "execute": "procedure", "call": "procedure", "proc": "procedure", "procedure": "procedure", "function": "procedure", "index": "index", "database": "database", "schema": "schema"}
_BLANK = re.compile(r"'(?:[^'\n]|''){0,2000}'|--[^\n]*|/\*[\s\S]{0,4000}?\*/|\{\{[^}]{0,200}\}\}")
_WORD = re.compile(rf"(?P<q>{_PART}\.)?(?P<n>{_PART})(?P<call>\s*\()?")
_SYSTEM = re.compile(r"(?i)\b(?:information_schema|pg_catalog|pg_tables|sys|all_tables|account_usage|performance_schema)\b")


def _blanked(s: str) -> str:
    return _BLANK.sub(lambda m: " " * len(m[0]), s)


def _prose(statement: str) -> bool:
    """Lower-case words alone, without a shape that only SQL has."""
    if re.search(r"[*=;(),]|\bwhere\b.*[<>=]|[_\d]", statement) and not re.search(r"(?i)\b(?:the|from the|o|os|as|seus|please)\s+\w+\s+\w+", statement[:120]):
        return False
    return not re.match(r"[A-Z]{4,}\b", statement)


_LIST = rf"{_QUALIFIED}(?:\s*,\s*{_QUALIFIED}){{0,50}}"
#: Rights on objects, or roles, given to or taken from someone; both lists may be long.
_RIGHTS = re.compile(
    rf"\b(?P<verb>GRANT|REVOKE)\s+(?:(?:GRANT|ADMIN)\s+OPTION\s+FOR\s+)?(?P<what>[A-Za-z_\"`\[][\w\s,\"`.()\[\]]{{0,2000}}?)\s+(?:ON\s+(?P<kind>(?:ALL\s+|FUTURE\s+)?[A-Za-z]+(?:\s+IN\s+SCHEMA)?(?=\s+{_QUALIFIED}\s*(?:,|\(|TO\b|FROM\b)))?\s*(?P<on>{_LIST})(?:\s*\([^()\n]{{0,200}}\))?\s+)?(?P<way>TO|FROM)\s+(?:(?:ROLE|USER|GROUP|SHARE|APPLICATION)\s+)?(?P<who>{_LIST})",
    re.I,
)
_PRIVILEGES = re.compile(r"(?i)\s*(?:ALL|SELECT|INSERT|UPDATE|DELETE|TRUNCATE|REFERENCES|TRIGGER|USAGE|CREATE|CONNECT|TEMP|EXECUTE|OWNERSHIP|MODIFY|MONITOR|OPERATE|ALTER|DROP|INDEX|READ|WRITE|CONTROL|VIEW)\b")


def _listed(s: str, start: int, end: int, entities: list[str]) -> Iterator[Name]:
    for m in re.finditer(_QUALIFIED, s[start:end]):
        if m[0].lower() not in KEYWORDS and not _SYSTEM.search(m[0]):
            yield from parts(s, start + m.start(), start + m.end(), entities)


def _rights(s: str) -> Iterator[Name]:
    """The objects of GRANT and REVOKE, those who get or lose them, and roles that are granted like rights."""
    for m in _RIGHTS.finditer(s):
        if (m["verb"].upper() == "GRANT") != (m["way"].upper() == "TO"):
            continue
        if m["on"]:
            if not _PRIVILEGES.match(m["what"]):
                continue
            kind = (m["kind"] or "table").lower()
            last = "schema" if "in schema" in kind or kind == "schema" else "table" if kind.split()[-1] not in _RIGHT_KINDS else _RIGHT_KINDS[kind.split()[-1]]
            yield from _listed(s, *m.span("on"), [last, "database"] if last in ("schema", "database") else [last, "schema", "database", "server"])
        elif re.fullmatch(rf"{_LIST}", m["what"]) and not _PRIVILEGES.match(m["what"]) and all(identifier(x) for x in re.findall(_PART, m["what"])):
            yield from _listed(s, *m.span("what"), ["user"])
        else:
            continue
        yield from _listed(s, *m.span("who"), ["user"])


_RIGHT_KINDS = {"database": "database", "function": "procedure", "procedure": "procedure", "routine": "procedure", "warehouse": "service", "sequence": "table", "view": "table", "bucket": "bucket", "queue": "queue", "topic": "queue"}


@reader("sql", "select", "insert", "update", "delete", "merge", "create", "alter", "drop", "truncate", "exec", "call", "grant", "revoke")
def sql(s: str) -> Iterator[Name]:
    """Names by their position in a statement: four-part names, aliases and common table expressions apart; other identifiers are columns."""
    if re.search(r"(?i)\b(?:grant|revoke)\s", s):
        yield from _rights(s)
    for begin, stop in _statements(s):
        body = s[begin:stop]
        if _prose(body) or _SYSTEM.search(body):
            continue
        clean = _blanked(body)
        ctes = {x.lower() for x in re.findall(r"(?i)(?:\bWITH\b(?:\s+RECURSIVE\b)?|,)\s*(\w+)\s*(?:\([^()]{0,500}\)\s*)?AS\s*(?:NOT\s+MATERIALIZED\s*|MATERIALIZED\s*)?\(", clean)}
        used: list[tuple[int, int]] = []
        aliases = set()
        for p in _PLACE.finditer(clean):
            name = p["name"]
            if name.lower() in KEYWORDS or name.lower() in ctes:
                continue
            kind = p["kind"].split()[0].lower()
            last = _ENTITIES.get(kind, "table")
            around = ["schema", "database", "server"] if last not in ("database", "schema") else ["database", "server"]
            a = p.start("name")
            if name[0] == "`" and "." in name:  # one quoted path
                yield from parts(s, begin + a + 1, begin + a + len(name) - 1, [last, "schema", "cloud_account"])
            else:
                yield from parts(s, begin + a, begin + a + len(name), [last, *around])
            used.append((a, a + len(name)))
            if after := re.match(r"(?i)\s+(?:AS\s+)?([A-Za-z_]\w{0,60})\b", clean[p.end("name") :]):
                aliases.add(after[1].lower())
        for w in _WORD.finditer(clean):
            a, b = w.start("n"), w.end("n")
            n = clean[a:b].strip('[]"`')
            free = not any(x < b and a < y for x, y in used)
            if free and not w["call"] and n.lower() not in KEYWORDS | PUBLIC | aliases | ctes and len(n) > 2 and (identifier(n) or clean[a] in '["`'):
                shift = clean[a] in '["`'
                yield Name(begin + a + shift, begin + b - shift, "column", False)


def _quoted(words: str) -> re.Pattern:
    """A name in quotes behind one of the words, or several joined by dots, each in quotes of its own."""
    return re.compile(rf"(?i)\b(?:{words})\s+((?P<quote>[\"'`])[\w$#.\-]{{3,200}}(?P=quote)(?:\.(?P=quote)[\w$#\-]{{1,200}}(?P=quote)){{0,3}})")


_ERRORS = (
    (_quoted("relation|table|view|object(?: name)?|synonym"), ["table", "schema", "database"]), (_quoted("column"), ["column", "table", "schema"]), (_quoted("database"), ["database"]),
    (_quoted("schema"), ["schema", "database"]), (_quoted("user|role|login"), ["user"]),
)
#: Owners and tables of a database that quotes all parts: the last one is the table, whatever word stands before.
_OWNED = re.compile(r"(?<![\w\"])\"([A-Z][\w$#]{2,127})\"\.\"([A-Z][\w$#]{2,127})\"(?:\.\"([A-Z][\w$#]{2,127})\")?")


@reader("error")
def error(s: str) -> Iterator[Name]:
    """Quoted names of database errors; project:dataset of a warehouse."""
    for line in re.finditer(r"[^\n]+", s):
        if not re.search(r"(?i)error|msg \d|does not exist|doesn't exist|not found|invalid|unknown|denied|cannot|violates", line[0]):
            continue
        for pattern, entities in _ERRORS:
            for m in pattern.finditer(line[0]):
                pieces = [p.span() for p in re.finditer(r"[^\"'`]+", m[1]) if p[0] != "."]
                if len(pieces) == 1:
                    yield from parts(s, line.start() + m.start(1) + pieces[0][0], line.start() + m.start(1) + pieces[0][1], entities)
                for (a, b), entity in zip(reversed(pieces), entities, strict=False) if len(pieces) > 1 else ():
                    if not ownerless(m[1][a:b]):
                        yield Name(line.start() + m.start(1) + a, line.start() + m.start(1) + b, entity)
        for m in _OWNED.finditer(line[0]):
            for g, entity in zip([g for g in (1, 2, 3) if m[g]], ("schema", "table", "column"), strict=False):
                if not ownerless(m[g]):
                    yield Name(line.start() + m.start(g), line.start() + m.end(g), entity)
        for m in re.finditer(r"(?i)\b(?:dataset|table)\s+([a-z][a-z0-9-]{4,40}):([\w]{2,100})(?:\.([\w]{2,100}))?", line[0]):
            for g, e in ((1, "cloud_account"), (2, "schema"), (3, "table")):
                if m[g] and not ownerless(m[g]):
                    yield Name(line.start() + m.start(g), line.start() + m.end(g), e)


_KEYS = {
    "server": "server", "data source": "server", "host": "server", "hostname": "server", "addr": "server", "address": "server", "database": "database", "initial catalog": "database", "dbname": "database",
    "databasename": "database", "service_name": "database", "sid": "database", "user": "user", "user id": "user", "uid": "user", "username": "user", "warehouse": "service", "schema": "schema", "role": "user", "account": "cloud_account",
}
_PAIR = re.compile(r"(?i)(?<![\w.])(" + "|".join(sorted(map(re.escape, _KEYS), key=len, reverse=True)) + r")\s*=\s*(?:tcp:|//)?([\w.\\\-]{2,120})")
_URI = re.compile(r"(?i)\b(?:jdbc:)?(?:postgres(?:ql)?|mysql|mariadb|mongodb(?:\+srv)?|redis|rediss|sqlserver|mssql(?:\+\w+)?|oracle(?::thin)?|snowflake|clickhouse|cockroachdb|db2|hive2|trino|presto)(?:\+\w+)?:(?:@?//)(?:([\w.\-]{2,80})(?::[^\s@/]{0,200})?@)?([\w.\-]{2,200})(?::\d+)?(?:/([\w\-]{2,120}))?")


@reader("connection", "=", "://", "urn:li:", "{{", "jdbc:")
def connection(s: str) -> Iterator[Name]:
    """Two pairs of different keys near each other, database URIs, TNS, dataset URNs, dbt references, connection ids."""
    pairs = [m for m in _PAIR.finditer(s)]
    for i, m in enumerate(pairs):
        near = [n for n in pairs[max(0, i - 6) : i + 7] if abs(n.start() - m.start()) < 300 and _KEYS[n[1].lower()] != _KEYS[m[1].lower()]]
        if near and not re.match(r"[(.),]", s[m.end() : m.end() + 1]) or near and re.match(r",\d", s[m.end() : m.end() + 2]):
            name = m[2].split("\\")[0]
            entity = _KEYS[m[1].lower()]
            strong = any(identifier(x[2].split("\\")[0]) for x in [m, *near])
            if not ownerless(name) and strong and not re.match(r"(?:self|this|request|cfg|config|os|models|ctx|args)\.", m[2]):
                if not (entity == "server" and public_host(name)):
                    yield Name(m.start(2), m.start(2) + len(name), entity)
                if "\\" in m[2] and entity == "server":
                    yield Name(m.start(2) + len(name) + 1, m.end(2), "server")
    for m in _URI.finditer(s):
        yield from group(m, 1, "user")
        if not public_host(m[2]):
            yield from group(m, 2, "server")
        yield from group(m, 3, "database")
    for m in re.finditer(r"(?i)\bjdbc:oracle:(?:thin|oci8?):(?:([\w$.\-]{2,80})/[^\s@/]{0,200})?@(?:ldap:)?/{0,2}([\w.\-]{2,200}):\d{1,5}[:/]([\w$.\-]{2,120})", s):
        yield from group(m, 1, "user")
        if not public_host(m[2]):
            yield from group(m, 2, "server")
        yield from group(m, 3, "database")
    for m in re.finditer(r"(?i)\(\s*(HOST|SERVICE_NAME|SID)\s*=\s*([\w.\-]{2,120})\s*\)", s):
        yield from group(m, 2, "server" if m[1].upper() == "HOST" else "database")
    for m in re.finditer(r"urn:li:dataset:\(urn:li:dataPlatform:\w+,([\w.\-]{3,250}),", s):
        yield from parts(s, m.start(1), m.end(1), ["table", "schema", "database", "server"])
    for m in re.finditer(r"\{\{\s*(ref|source)\(\s*'([\w\-]{2,120})'(?:\s*,\s*'([\w\-]{2,120})')?", s):
        yield from group(m, 2, "schema" if m[1] == "source" else "table")
        yield from group(m, 3, "table")
    for m in re.finditer(r"\b\w{0,40}conn_id\s*=\s*[\"']([\w\-]{3,100})[\"']", s):
        yield from group(m, 1, "service")


@reader("dsn", "@tcp(", "mysql:", "pgsql:", "sqlsrv:", "oci:", "dblib:")
def dsn(s: str) -> Iterator[Name]:
    for m in re.finditer(r"\b([\w.\-]{2,80}):[^@\s\"']{0,100}@tcp\(([\w.\-]{2,200})(?::\d+)?\)/([\w\-]{2,120})", s):
        yield from group(m, 1, "user")
        yield from group(m, 2, "server")
        yield from group(m, 3, "database")
    for m in re.finditer(r"\b(?:mysql|pgsql|sqlsrv|oci|dblib):((?:[\w ]+=[^;\"']{1,200};?){1,8})", s):
        for p in re.finditer(r"(?i)(host|server|dbname|database)=(?://)?([\w.\-]{2,120})(?::\d+/([\w\-]{2,60}))?", m[1]):
            e = "server" if p[1].lower() in ("host", "server") or p[3] else "database"
            for g, entity in ((2, e), (3, "database")):
                if p[g] and not ownerless(p[g]):
                    yield Name(m.start(1) + p.start(g), m.start(1) + p.end(g), entity)


# Headers of catalogs and listings and the entity of the cells below them.
_HEADERS = {
    "table_name": "table", "tablename": "table", "table": "table", "table_schema": "schema", "schemaname": "schema", "schema": "schema", "schema_name": "schema", "column_name": "column", "table_catalog": "database", "database": "database",
    "database_name": "database", "owner": "user", "tableowner": "user", "grantee": "user", "index_name": "index", "view_name": "table", "routine_name": "procedure", "procedure_name": "procedure", "server": "server", "host": "server",
    "hostname": "server", "namespace": "namespace", "bucket": "bucket", "topic": "queue", "queue": "queue", "user_name": "user", "role_name": "user",
}


#: Headers that only a catalog has, although they're one word.
_JOINED = {"tablename", "schemaname", "tableowner", "viewname", "indexname", "dbname", "datname", "relname", "rolname", "usename"}
_HEADERS |= {"viewname": "table", "indexname": "index", "dbname": "database", "datname": "database", "relname": "table", "rolname": "user", "usename": "user"}


def _entities(heads: list[str]) -> list[str | None]:
    """The entity of each column, or none at all if the header isn't a catalog's."""
    low = [h.strip("\"'`* ").lower() for h in heads]
    known = [_HEADERS.get(h) or ("table" if h.startswith("tables_in_") else None) for h in low]
    if {"name", "type"} <= set(low):
        known[low.index("name")] = "table" if "schema" in low else "column?"
    elif {"field", "type"} <= set(low):
        known[low.index("field")] = "column?"
    sure = any("_" in h or h in _JOINED for h, k in zip(low, known, strict=True) if k) or {"schema", "name", "owner"} <= set(low) or "column?" in known
    return known if sure else [None] * len(known)


@reader("table", "_name", "name", "_schema", "_in_", "field", "owner", "_catalog", "grantee")
def table(s: str) -> Iterator[Name]:
    """Cells under catalog headers, in tables of any layout; a column of names beside one of data types; Tables_in_<database>."""
    for m in re.finditer(r"Tables_in_([\w$]{2,100})", s):
        yield Name(m.start(1), m.end(1), "database")
    for grid in grids(s, lambda heads: sum(e is not None for e in _entities(heads)) if len(heads) > 1 or heads[0].lower().startswith("tables_in_") else 0):
        entities = _entities(grid.heads)
        if "column?" in entities:
            at = next(i for i, h in enumerate(grid.heads) if h.lower() == "type")
            typed = [bool(re.match(rf"(?i)(?:{_TYPES})\b", s[r[at][0] : r[at][1]])) for r in grid.rows if len(r) > at]
            entities = [("column" if 2 * sum(typed) >= len(typed) else None) if e == "column?" else e for e in entities]
        for row in grid.rows:
            for (a, b), entity in zip(row, entities, strict=False):
                v = s[a:b]
                if entity and v and not ownerless(v) and " " not in v and v.lower() not in _HEADERS:
                    yield Name(a, b, entity)


_TYPES = r"(?:var)?char2?|n?varchar|text|string|(?:big|small|tiny)?int(?:eger)?|bigint|decimal|numeric|number|float|double|bool(?:ean)?|date|datetime2?|timestamp(?:tz)?|time|binary|varbinary|uuid|jsonb?|array|map|struct|long|short"


@reader("schema")
def schema(s: str) -> Iterator[Name]:
    """Name and data type lines (two or more), and tree prints."""
    run: list[Name] = []
    for m in re.finditer(r"[^\n]*\n?", s):
        if not m[0]:
            break
        got = re.match(rf"(?i)\s*(?:\|-- )?[\"`\[]?([A-Za-z_]\w{{1,100}})[\"`\]]?\s*:?\s+(?:{_TYPES})(?:\([\d, ]+\))?(?:\s+(?:not\s+null|null|primary\s+key|default\s+\S+))*\s*(?:\(nullable = \w+\))?\s*,?\s*$", m[0].rstrip("\n"))
        if got and identifier(got[1]):
            run.append(Name(m.start() + got.start(1), m.start() + got.end(1), "column", False))
        else:
            if len(run) >= 2:
                yield from run
            run = []
    if len(run) >= 2:
        yield from run


@reader("lists")
def lists(s: str) -> Iterator[Name]:
    """Comma lists of qualified names behind a word that says what they are."""
    for m in re.finditer(r"(?i)\b(tables?|tabelas?|schemas?|servers?|servidores|buckets?|topics?|queues?|filas?|namespaces?)\s*[:=]\s*\[?((?:[\"']?[\w.\-]{3,100}[\"']?\s*,\s*){2,50}[\"']?[\w.\-]{3,100}[\"']?)", s):
        entity = {"t": "table", "s": "schema", "b": "bucket", "q": "queue", "f": "queue", "n": "namespace"}[m[1][0].lower()]
        entity = "server" if m[1].lower().startswith("serv") else "queue" if m[1].lower().startswith("topic") else entity
        for v in re.finditer(r"[\w.\-]{3,100}", m[2]):
            if identifier(v[0]) and not (entity == "server" and not internal_host(v[0]) and "." in v[0]):
                yield Name(m.start(2) + v.start(), m.start(2) + v.end(), entity, False)
