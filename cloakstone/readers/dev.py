"""Readers of configuration and development text: key-value pairs, addresses, remotes, packages, paths, users, clouds, code, command lines, tracebacks."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator

from .base import PUBLIC, Name, group, identifier, internal_host, ownerless, parts, placeholder, public_host, reader
from .tables import grids

# The entity that the last piece of a key names.
KEY_ENTITY = {
    "server": "host hostname server servidor endpoint address addr fqdn broker bootstrap bootstrapservers servername servers cluster instance hosts brokers servidores",
    "service": "warehouse service servico app application group consumergroup",
    "database": "database db dbname databasename catalog databases bancos",
    "schema": "schema dataset schemaname schemas",
    "table": "table tabela collection tablename view tables tabelas views",
    "user": "user username usuario login principal role users roles usuarios",
    "namespace": "namespace namespaces",
    "bucket": "bucket container buckets",
    "queue": "queue topic fila topico exchange stream subject queues topics filas topicos streams subjects exchanges",
    "repository": "repo repository repos repositories",
    "organization": "org organization",
    "cloud_account": "account tenant subscription projectid accounts",
    "column": "column coluna field columns fields colunas",
    "procedure": "procedure routine procedures routines",
}
_ENTITY = {w: e for e, ws in KEY_ENTITY.items() for w in ws.split()}
# Pieces before name or id that give the entity, besides those above.
BEFORE_NAME = {"owner": "user", "function": "procedure", "index": "index", "constraint": "index", "project": "cloud_account"}
# Cloud providers in front of "project".
CLOUDS = {"gcp", "gcloud", "google", "bq", "bigquery", "cloud", "billing", "firebase", "gke", "dataproc"}


def key_pieces(key: str) -> list[str]:
    return [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", key)]


def key_entity(key: str) -> tuple[str, bool] | None:
    """(entity, strong) that a key's name says its value is."""
    ps = key_pieces(key)
    if not ps or len(ps) > 16:
        return None
    last, before = ps[-1], ps[-2] if len(ps) > 1 else ""
    if last in _ENTITY:
        return _ENTITY[last], True
    if last == "project":
        return "cloud_account", before in CLOUDS
    if last in ("name", "names", "id", "ids"):
        if before == "account" and len(ps) > 2 and ps[-3] == "service":
            return "user", True
        e = BEFORE_NAME.get(before) or _ENTITY.get(before)
        return (e, True) if e else None
    for suffix in ("names", "name", "nome", "path"):
        stem = last.removesuffix(suffix)
        if stem != last and (e := BEFORE_NAME.get(stem) or _ENTITY.get(stem)):
            return e, True
    return None


_CODE = re.compile(r"^(?:self|this|request|os|sys|cfg|config|models?|process|env|u|c|ctx|args|options?|settings)\b[.\[]|\w\(|=>|->")


def resource(value: str, entity: str) -> bool:
    """A value that may be a client's resource: no expression, path, number, file or public address."""
    if ownerless(value) or len(value) > 256 or _CODE.search(value) or re.search(r"^[/~.]|://|[\s;]|\.(?:py|js|go|json|ya?ml|txt|csv|conf|ini|sql|sh)$", value):
        return False
    return not (entity == "server" and public_host(value))


def _marked(base: int, value: str, entity: str, strong: bool) -> Iterator[Name]:
    """A value, a list of hosts with ports, or a qualified name."""
    if entity == "server":
        for v in re.finditer(r"[^,\s]+", value):
            host = re.match(r"(?:tcp:)?([\w.\-]+?)(?::\d+)?$", v[0])
            if host and resource(host[1], entity):
                yield Name(base + v.start() + host.start(1), base + v.start() + host.end(1), entity, strong)
    elif entity in ("table", "schema") and "." in value and resource(value, entity):
        entities = ["table", "schema", "database"] if entity == "table" else ["schema", "database"]
        for n in parts(value, 0, len(value), entities):
            yield Name(base + n.start, base + n.end, n.entity, strong)
    elif resource(value, entity):
        yield Name(base, base + len(value), entity, strong)


_LINE = re.compile(r"^[ \t]*(?:export[ \t]+|-[ \t]+|set[ \t]+)?([A-Za-z][\w.\-]{0,63})[ \t]*(:[ \t]+|=[ \t]*)(\"[^\"\n]{1,256}\"|'[^'\n]{1,256}'|[^\s#,;{}()\"']+(?:,[^\s#,;{}()\"']+)*)[ \t]*(?:#.*)?$", re.M)
_JSON = re.compile(r"[\"']([A-Za-z][\w.\-]{0,63})[\"'][ \t]*:[ \t]*[\"']([^\"'\n]{1,256})[\"']")
_ATTRIBUTE = re.compile(r"\s([A-Za-z][\w.\-]{0,63})=\"([^\"\n<>]{1,256})\"")
_ELEMENT = re.compile(r"<([A-Za-z][\w.\-]{0,63})>([^<>\n]{1,256})</\1>")
_OPTION = re.compile(r"(?<!\S)--([a-z][\w\-]{1,40})(?:=|[ ])([\w.\-:/,]{2,200})(?!\S)")
_QUOTED = re.compile(r"\b([A-Za-z][\w.]{0,63})[ \t]*=[ \t]*\"([^\"\n]{2,256})\"")


@reader("key-value")
def key_value(s: str) -> Iterator[Name]:
    """The type word at the end of a key decides; configuration lines, JSON, XML and long options."""
    for m in _LINE.finditer(s):
        key, sep, value = m[1], m[2], m[3]
        quoted = value[0] in "\"'"
        v = value[1:-1] if quoted else value
        at = m.start(3) + quoted
        found = key_entity(key)
        if key == "group" and re.fullmatch(r"[a-z][\w\-]*(?:\.[\w\-]+)+", v):  # a build's group id: the package reader's
            continue
        if not found or key[0].isupper() and not key.isupper() and "_" not in key and not re.search(r"[a-z][A-Z]", key):
            continue
        spaced = " " in sep and "=" in sep
        if not quoted and (spaced and not identifier(v) or s[m.start() : m.start(1)].startswith(("\t", " ")) and "=" in sep and spaced):
            continue
        yield from _marked(at, v, *found)
    for pattern in (_JSON, _ATTRIBUTE, _ELEMENT, _QUOTED):
        for m in pattern.finditer(s):
            found = None if m[1] == "group" and "." in m[2] else key_entity(m[1])
            if found and (identifier(m[2]) or found[0] == "server"):
                yield from _marked(m.start(2), m[2], *found)
    for m in _OPTION.finditer(s):
        found = key_entity(m[1])
        if found and identifier(m[2]):
            yield from _marked(m.start(2), m[2], *found)
    for m in re.finditer(r"-[ \t]+name:[ \t]*([A-Z][A-Z0-9_]{1,60})[ \t]*\n[ \t]+value:[ \t]*[\"']?([\w.\-:,]{2,200})", s):
        if found := key_entity(m[1]):
            yield from _marked(m.start(2), m[2], *found)
    for m in re.finditer(r"\$\{([A-Z][A-Z0-9_]{1,60}):-([\w.\-]{2,200})\}", s):
        if found := key_entity(m[1]):
            yield from _marked(m.start(2), m[2], *found)


_URL = re.compile(r"\b([a-z][a-z0-9+.\-]{1,15})://(?:([\w.\-]{1,80})(?::[^\s@/]{0,200})?@)?([\w.\-]{1,200})(?::\d+)?((?:/[^\s\"'<>`)\]},;]{0,500})?)")


@reader("address", "://", ".internal", ".intra", ".interno", ".corp", ".lan")
def address(s: str) -> Iterator[Name]:
    """URLs by scheme: buckets, containers, file systems, brokers, code hosts; internal hosts otherwise, also without a scheme."""
    for m in _URL.finditer(s):
        scheme, host, path = m[1], m[3], m[4]
        if scheme in ("s3", "s3a", "s3n", "gs", "gcs", "oss"):
            if not placeholder(host):
                yield Name(m.start(3), m.end(3), "bucket")
            yield from _folders(m.start(4), path)
        elif scheme in ("abfs", "abfss", "wasb", "wasbs"):
            yield from group(m, 2, "bucket")
            yield Name(m.start(3), m.start(3) + host.index(".") if "." in host else m.end(3), "cloud_account")
            yield from _folders(m.start(4), path)
        elif scheme in ("hdfs", "webhdfs", "viewfs"):
            yield from group(m, 3, "server")
            yield from _folders(m.start(4), path)
        elif scheme in ("amqp", "amqps", "kafka", "mqtt", "nats", "pulsar"):
            yield from group(m, 2, "user")
            if not public_host(host):
                yield from group(m, 3, "server")
            if q := re.match(r"/([\w.\-]{2,100})", path):
                yield Name(m.start(4) + 1, m.start(4) + 1 + len(q[1]), "queue")
        else:
            line = s[s.rfind("\n", 0, m.start()) + 1 : m.start()]
            git = scheme in ("git", "ssh") or path.endswith(".git") or re.search(r"\bgit (?:clone|remote|pull|push|fetch)\b|\burl = ?$", line)
            if internal_host(host):
                yield from group(m, 3, "server")
                if m[2] != "git":
                    yield from group(m, 2, "user")
            elif git and "." not in host:
                yield from group(m, 3, "server")
            if git and path:
                yield from _repository(m.start(4) + 1, path[1:])
    for m in re.finditer(r"(?<![\w@./:\-])([a-z0-9][\w\-]{0,62}(?:\.[\w\-]{1,62}){0,4}\.(?:internal|intra|interno|corp|lan|intranet))(?![\w(.])", s):
        if re.search(r"[0-9-]", m[1]) or s[m.end() : m.end() + 1] == ":":
            yield from group(m, 1, "server")


def _folders(base: int, path: str) -> Iterator[Name]:
    pieces = list(re.finditer(r"[^/]+", path))
    for p in pieces:
        file = p is pieces[-1] and not path.endswith("/")
        if not file and identifier(p[0]) and "=" not in p[0] and not ownerless(p[0]):
            yield Name(base + p.start(), base + p.end(), "folder", False)


def _repository(base: int, path: str) -> Iterator[Name]:
    pieces = list(re.finditer(r"[\w.\-]+", path.removesuffix(".git")))
    if len(pieces) >= 2:
        for p in pieces[:-1]:
            yield Name(base + p.start(), base + p.end(), "organization")
        yield Name(base + pieces[-1].start(), base + pieces[-1].end(), "repository")


@reader("git", "git@")
def git(s: str) -> Iterator[Name]:
    for m in re.finditer(r"\bgit@([\w.\-]{2,200}):([\w.\-]{1,100}(?:/[\w.\-]{1,100}){1,5})", s):
        if not public_host(m[1]):
            yield Name(m.start(1), m.end(1), "server")
        yield from _repository(m.start(2), m[2])


@reader("package", "module ", "groupid", "group", '"name"', "gradle")
def package(s: str) -> Iterator[Name]:
    """Private modules, group ids and scopes."""
    for m in re.finditer(r"(?m)^module ([\w.\-]{3,100})/([\w.\-/]{1,200})$", s):
        if not public_host(m[1]):
            if internal_host(m[1]):
                yield Name(m.start(1), m.end(1), "server")
            for p in re.finditer(r"[^/]+", m[2]):
                if not re.fullmatch(r"v\d+", p[0]):
                    yield Name(m.start(2) + p.start(), m.start(2) + p.end(), "package")
    for m in re.finditer(r"<groupId>([\w.\-]{3,150})</groupId>|(?m:^group\s*=\s*['\"]([\w.\-]{3,150})['\"])", s):
        g = 1 if m[1] else 2
        pieces = list(re.finditer(r"[^.]+", m[g]))
        if re.match(r"(?:org\.(?:springframework|apache|junit|hibernate|slf4j|eclipse|jetbrains|mockito)|io\.(?:netty|grpc|micrometer|quarkus)|com\.(?:google|fasterxml|amazonaws|microsoft|oracle|github)|javax|jakarta)\b", m[g]):
            continue
        for p in pieces:
            if p[0] not in ("br", "com", "org", "net", "io", "de", "fr", "es", "uk", "co", "dev"):
                yield Name(m.start(g) + p.start(), m.start(g) + p.end(), "package")
    for m in re.finditer(r"\"name\"\s*:\s*\"@([\w\-]{2,60})/([\w.\-]{2,100})\"", s):
        if m[1] not in ("types", "babel", "angular", "vue", "nestjs", "aws-sdk", "google-cloud", "azure", "mui", "reduxjs"):
            yield from group(m, 1, "organization")
            yield from group(m, 2, "package")


_HOMES = re.compile(r"(?<![\w.])(?:/home/|/Users/|[A-Za-z]:\\{1,2}Users\\{1,2})([A-Za-z][\w.\-]{1,60})((?:[/\\]{1,2}[\w .\-]{1,80}){0,12})")
_STOCK = {"public", "default", "runner", "ubuntu", "user", "shared", "all users", "ec2-user", "vagrant", "node", "app", "root", "circleci", "jovyan", "vscode"}


@reader("path", "/home/", "/users/", "\\users")
def path(s: str) -> Iterator[Name]:
    """The user and folders of home directories."""
    for m in _HOMES.finditer(s):
        if m[1].lower() in _STOCK:
            continue
        yield Name(m.start(1), m.end(1), "user")
        pieces = list(re.finditer(r"[^/\\]+", m[2]))
        for p in pieces:
            last = p is pieces[-1] and s[m.end() : m.end() + 1] not in ("/", "\\")
            if identifier(p[0]) and not p[0].startswith(".") and not (last and re.search(r"\.\w{1,5}$", p[0])) and p[0].lower() not in ("pkg", "appdata"):
                if re.search(r"[/\\](?:node_modules|site-packages|mod)[/\\]", m[2][: p.start() + 1]):
                    break
                yield Name(m.start(2) + p.start(), m.start(2) + p.end(), "folder", False)


@reader("system-path", "/srv", "/opt", "/mnt", "/data", "/dados", "/var/", "/export", "\\\\")
def system_path(s: str) -> Iterator[Name]:
    """Folders of data roots, and network shares."""
    for m in re.finditer(r"(?<![\w./:])/(?:srv|opt|mnt|data|dados|var/(?:www|data)|export)((?:/[\w.\-]{1,80}){1,10})/?", s):
        for p in re.finditer(r"[^/]+", m[1]):
            if identifier(p[0]) and not re.search(r"\.\w{1,5}$", p[0]) and not ownerless(p[0]):
                yield Name(m.start(1) + p.start(), m.start(1) + p.end(), "folder", False)
    for m in re.finditer(r"(?<![\w\\])\\\\([A-Za-z][\w.\-]{1,60})\\([\w$.\-]{1,80})", s):
        if identifier(m[1]):
            yield from group(m, 1, "server")
            yield Name(m.start(2), m.end(2), "folder", False)


@reader("network-user", "\\", "ssh", "scp", "sftp", "rsync", "@")
def network_user(s: str) -> Iterator[Name]:
    """DOMAIN\\user, ssh and scp targets, shell prompts."""
    for m in re.finditer(r"(?<![\w\\.])([A-Z][A-Z0-9\-]{2,15})\\{1,2}([a-z][\w.\-]{2,40})\b(?![\\(])", s):
        if m[1] not in ("BUILTIN", "HKLM", "HKCU", "AUTHORITY") and s[m.end(1) + 1 : m.end(1) + 2] not in ("n", "t", "r") or "\\\\" in m[0]:
            yield from group(m, 2, "user")
    for m in re.finditer(r"\b(?:ssh|scp|sftp|rsync)\b[^\n]{0,200}?(?<![\w.])([a-z_][\w.\-]{1,40})@([\w.\-]{2,200})", s):
        if m[1] not in ("git", "root", "ubuntu", "ec2-user", "admin", "debian", "centos"):
            yield from group(m, 1, "user")
        if not public_host(m[2]):
            yield from group(m, 2, "server")
    for m in re.finditer(r"(?m)^\[?([a-z_][\w.\-]{1,40})@([\w\-]{2,60})[ :][~/][^\n$#]{0,100}[$#] ", s):
        if m[1] not in ("root", "user"):
            yield from group(m, 1, "user")
        yield from group(m, 2, "server")


_ARN = {"s3": "bucket", "sqs": "queue", "sns": "queue", "kinesis": "queue", "dynamodb": "table", "lambda": "service", "rds": "database", "eks": "server", "ecs": "service", "iam": "service", "secretsmanager": "service", "glue": "database", "ecr": "repository"}
_GCP = {"topics": "queue", "subscriptions": "queue", "datasets": "schema", "tables": "table", "buckets": "bucket", "instances": "server", "functions": "service", "services": "service", "clusters": "server", "repositories": "repository", "databases": "database"}


@reader("cloud", "arn:aws", "/subscriptions/", "projects/")
def cloud(s: str) -> Iterator[Name]:
    """Resource names of three clouds."""
    for m in re.finditer(r"\barn:aws[\w-]*:([a-z0-9\-]+):[a-z0-9\-]*:(\d{12})?:([^\s\"',;)\]}<>]{1,300})", s):
        if m[2]:
            yield Name(m.start(2), m.end(2), "cloud_account")
        if m[3].startswith("policy/") and not m[2]:
            continue
        pieces = re.split(r"[:/]", m[3])
        entity = _ARN.get(m[1], "service")
        kinds = {"user": "user", "role": "service", "table": "table", "function": "service", "cluster": "server", "db": "database", "secret": "service", "repository": "repository", "policy": "service", "stream": "queue", "topic": "queue"}
        name, kind = (pieces[-1], pieces[0]) if m[1] == "iam" and len(pieces) > 1 else (pieces[1], pieces[0]) if len(pieces) > 1 and pieces[0] in kinds else (pieces[0], "")
        at = m.start(3) + m[3].find(name, len(kind))
        if not placeholder(name):
            yield Name(at, at + len(name), kinds.get(kind, entity))
    for m in re.finditer(r"/subscriptions/([0-9a-fA-F\-]{36})(?:/resource[gG]roups/([\w.\-()]{1,90}))?(?:/providers/[\w.]+/[\w]+/([\w.\-]{1,120}))?", s):
        yield Name(m.start(1), m.end(1), "cloud_account")
        yield from group(m, 2, "namespace")
        yield from group(m, 3, "cloud_account" if "storageAccounts" in m[0] else "service")
    for m in re.finditer(r"(?<![\w/~])projects/([a-z][a-z0-9\-]{4,40})((?:/[a-z]+/[\w.\-]{1,120}){1,4})", s):
        yield Name(m.start(1), m.end(1), "cloud_account")
        for p in re.finditer(r"/([a-z]+)/([\w.\-]+)", m[2]):
            if p[1] in _GCP and not placeholder(p[2]):
                yield Name(m.start(2) + p.start(2), m.start(2) + p.end(2), _GCP[p[1]])


_MANAGED = re.compile(
    r"(?<![\w.\-])([a-z0-9][a-z0-9\-]{1,61})\.(?:(blob|dfs|table|queue|file|servicebus|database|redis\.cache|vault|azurewebsites|search|documents|mongo\.cosmos)\.(?:core\.)?(?:windows|azure)\.(?:net|com)|(snowflakecomputing\.com)|(azuredatabricks\.net)|([a-z0-9]{8,16}\.[a-z0-9\-]{4,20}\.rds\.amazonaws\.com)|(s3(?:[.\-][a-z0-9\-]+)?\.amazonaws\.com)|(dkr\.ecr\.[a-z0-9\-]+\.amazonaws\.com))", re.I
)


@reader("cloud-url", "windows.net", "azure", "snowflakecomputing", "databricks", "amazonaws")
def cloud_url(s: str) -> Iterator[Name]:
    """The client's label of managed hosts, queues by URL."""
    for m in _MANAGED.finditer(s):
        entity = "bucket" if m[6] else "server" if m[5] or (m[2] or "").startswith(("database", "redis")) else "cloud_account"
        yield from group(m, 1, entity)
    for m in re.finditer(r"\bsqs\.[a-z0-9\-]+\.amazonaws\.com/(\d{12})/([\w\-]{1,80})", s):
        yield Name(m.start(1), m.end(1), "cloud_account")
        yield from group(m, 2, "queue")


@reader("code-name")
def code_name(s: str) -> Iterator[Name]:
    """A literal assigned to, or passed as, a name that says what it is."""
    for m in re.finditer(r"\b([A-Za-z_]\w{1,60})\s*(?::=|=|:)\s*(?:[rbuf]{0,2})(?:\"([^\"\n]{3,200})\"|'([^'\n]{3,200})')", s):
        g = 2 if m[2] else 3
        found = None if m[1] == "group" and "." in m[g] else key_entity(m[1])
        if found and identifier(m[g]):
            yield from _marked(m.start(g), m[g], found[0], found[1])


_CALLS = {
    "table": "table|read_table|saveAsTable|insertInto|to_sql|from_table", "bucket": "Bucket|get_bucket|bucket|create_bucket", "queue": "Queue|get_queue|queue_declare|subscribe|send_to|Topic|topic", "database": "get_database|use_database|Database",
    "server": "connect|create_connection|Dial|HTTPConnection|gethostbyname", "schema": "setSchema|use_schema|Dataset|dataset",
}


@reader("code-call", "(")
def code_call(s: str) -> Iterator[Name]:
    """The first literal argument of a function that takes such a name."""
    for entity, names in _CALLS.items():
        for m in re.finditer(rf"(?<!\w)(?:{names})\(\s*(?:\"([\w.\-/]{{3,150}})\"|'([\w.\-/]{{3,150}})')", s):
            g = 1 if m[1] else 2
            if identifier(m[g]) and not (entity == "server" and (public_host(m[g]) or not re.match(r"\s*,\s*\d|\s*\)", s[m.end() : m.end() + 12]))):
                yield from _marked(m.start(g), m[g], entity, True)


_CLI = {"h": "server", "S": "server", "d": "database", "D": "database", "U": "user", "u": "user"}


@reader("command-line")
def command_line(s: str) -> Iterator[Name]:
    """Short options of database clients (two different ones), and namespaces of cluster tools."""
    for m in re.finditer(r"(?m)\b(psql|mysql|mysqldump|pg_dump|sqlcmd|bcp|mongosh?|mariadb)\b([^\n|;&]{3,})", s):
        options = list(re.finditer(r"(?<!\S)-([hSdDUu])[ =]?([\w.\-]{2,100})", m[2]))
        if len({o[1] for o in options}) >= 2:
            for o in options:
                if resource(o[2], _CLI[o[1]]):
                    yield Name(m.start(2) + o.start(2), m.start(2) + o.end(2), _CLI[o[1]])
    for m in re.finditer(r"\b(?:kubectl|helm|oc|istioctl)\b[^\n|;&]{0,300}?\s-n[ =]([\w\-]{2,63})", s):
        yield from group(m, 1, "namespace")
    for m in re.finditer(r"\bhelm\s+(?:install|upgrade|uninstall|delete|rollback|status|history)\s+(?:(?:--?[\w\-]+)(?:=\S+)?\s+)*([a-z0-9][\w\-]{1,52})(?=\s|$)", s):
        yield from group(m, 1, "service", identifier(m[1]))
    for m in re.finditer(r"\b(?:kubectl|oc)\s+(?:get|describe|delete|logs|edit|rollout \w+|exec)\s+(?:-\S+\s+)*(deploy(?:ment)?s?|svc|services?|pods?|po|statefulsets?|ns|namespaces?|cm|configmaps?)[/ ]([a-z0-9][\w\-]{2,100})", s):
        if identifier(m[2]):
            yield Name(m.start(2), m.end(2), "namespace" if m[1] in ("ns", "namespace", "namespaces") else "service")


@reader("internal-ip")
def internal_ip(s: str) -> Iterator[Name]:
    """Unique-local IPv6 addresses and their reverse names."""
    for m in re.finditer(r"(?<![\w:.])([0-9a-fA-F]{0,4}(?::[0-9a-fA-F]{0,4}){2,7})(?![\w:.])", s):
        try:
            a = ipaddress.ip_address(m[1])
        except ValueError:
            continue
        if a in ipaddress.ip_network("fc00::/7") and int(a) >> 64 & ((1 << 56) - 1):
            yield Name(m.start(1), m.end(1), "server")
    for m in re.finditer(r"\b((?:[0-9a-f]\.){16,32}ip6\.arpa)\b", s):
        if re.search(r"[cd]\.f\.ip6\.arpa$", m[1]):
            yield from group(m, 1, "server")


@reader("traceback", 'file "', "at ")
def traceback(s: str) -> Iterator[Name]:
    """Modules, functions and folders of a client's frames; third-party frames stay."""
    for m in re.finditer(r"File \"([^\"\n]{3,300})\", line \d+, in ([\w<>]+)", s):
        if re.search(r"site-packages|dist-packages|/lib/python|<frozen|node_modules|/usr/lib", m[1]):
            continue
        file = re.search(r"([\w\-]+)\.py$", m[1])
        if file and identifier(file[1]):
            yield Name(m.start(1) + file.start(1), m.start(1) + file.end(1), "package", False)
        if identifier(m[2]) and "<" not in m[2] and not m[2].startswith("__"):
            yield Name(m.start(2), m.end(2), "procedure", False)
    for m in re.finditer(r"(?m)^\s+at ((?:[a-z]\w*\.){2,8})([A-Z][\w$]*)\.([\w$]+|<init>)\(", s):
        if not re.match(r"(?:java|javax|jakarta|sun|jdk|scala|kotlin|org\.(?:apache|springframework|junit|hibernate)|com\.(?:sun|google|fasterxml)|io\.netty)\.", m[1]):
            for p in list(re.finditer(r"\w+", m[1]))[1:]:
                if p[0] not in PUBLIC:
                    yield Name(m.start(1) + p.start(), m.start(1) + p.end(), "package", False)
            outer = m[2].split("$")[0]
            if identifier(outer):
                yield Name(m.start(2), m.start(2) + len(outer), "package", False)
            if identifier(m[3]) and m[3][0] != "<":
                yield Name(m.start(3), m.end(3), "procedure", False)


# What the items of a container with this key are.
CONTAINERS = {k: e for e, ks in KEY_ENTITY.items() for k in ks.split() if k.endswith("s")} | {"tables": "table", "columns": "column", "fields": "column", "indexes": "index", "constraints": "index", "projects": "cloud_account"}
_YAML_KEY = re.compile(r"(?m)^([ ]*)((?:- +)*)([\w\-]{1,60})[ ]*:[ ]*([^\n#]*?)[ ]*(?:#[^\n]*)?$")
_JSON_TOKEN = re.compile(r"\"((?:[^\"\\\n]|\\.){0,300})\"(\s*:)?|[\[\]{}]")


@reader("name-context", "name")
def name_context(s: str) -> Iterator[Name]:
    """`name` of an item, where the nearest key around it is that of a list of tables, columns, queues and the like."""
    stack: list[tuple[int, str]] = []
    for m in _YAML_KEY.finditer(s):
        at = len(m[1]) + len(m[2])
        while stack and stack[-1][0] >= (len(m[1]) if m[2] else at):
            stack.pop()
        key, value = m[3], m[4].strip("\"'")
        if key == "name" and value and stack and (entity := CONTAINERS.get(key_pieces(stack[-1][1])[-1] if key_pieces(stack[-1][1]) else "")):
            a = m.start(4) + m[4].index(value)
            if identifier(value) and resource(value, entity):
                yield Name(a, a + len(value), entity, False)
        if not m[4]:
            stack.append((at, key))
    if '"name"' not in s:
        return
    keys: list[str] = []  # the key of each open bracket
    key = ""
    for m in _JSON_TOKEN.finditer(s):
        if m[0] in "[{":
            keys.append(key)
            key = ""
        elif m[0] in "]}":
            if keys:
                keys.pop()
            key = ""
        elif m[2]:
            key = m[1]
        else:
            around = next((k for k in reversed(keys) if k), "")
            pieces = key_pieces(around)
            if key == "name" and pieces and (entity := CONTAINERS.get(pieces[-1])) and identifier(m[1]) and resource(m[1], entity):
                yield Name(m.start(1), m.end(1), entity, False)


_ADDRESSES = {"EXTERNAL-IP", "INTERNAL-IP", "NODE-IP", "LB-IP", "IP ADDRESS"}


@reader("infra-ip", "-ip", "ip address", ".elb.")
def infra_ip(s: str) -> Iterator[Name]:
    """Addresses of nodes and load balancers, under their headers and by their public names."""
    for grid in grids(s, lambda heads: sum(h in _ADDRESSES for h in heads) if len(heads) > 1 else 0):
        for row in grid.rows:
            for (a, b), head in zip(row, grid.heads, strict=False):
                if head in _ADDRESSES:
                    for v in re.finditer(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])", s[a:b]):
                        yield Name(a + v.start(), a + v.end(), "=ip")
    for m in re.finditer(r"(?<![\w.\-])([a-z0-9][a-z0-9\-]{2,62})\.(?:elb\.[a-z0-9\-]{4,20}|[a-z0-9\-]{4,20}\.elb)\.amazonaws\.com", s):
        yield from group(m, 1, "server")
