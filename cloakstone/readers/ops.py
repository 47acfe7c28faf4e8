"""Readers of deployment text: Kubernetes, compose, Terraform, Ansible, images, cluster DNS, tool output, CI."""

from __future__ import annotations

import re
from collections.abc import Iterator

from .base import Name, group, identifier, ownerless, placeholder, public_host, reader

# Entity of a manifest's name by its kind; others are services.
KINDS = {"Namespace": "namespace", "ServiceAccount": "user", "User": "user", "Role": "user", "ClusterRole": "user", "Node": "server", "Cluster": "server", "Config": "server"}
# Manifest keys that hold the name of another resource.
REFERENCES = {"namespace": "namespace", "serviceAccountName": "user", "serviceName": "service", "secretName": "service", "claimName": "service", "configMapName": "service", "nodeName": "server", "ingressClassName": "", "cluster": "server", "user": "user", "current-context": "server", "storageClassName": ""}
_PAIR = re.compile(r"^([ ]*)(?:- )*\"?([\w\-./]{1,80})\"?:[ ]*(?:\"([^\"\n]*)\"|'([^'\n]*)'|([^\s#\"'][^\n#]*?))?[ ]*(?:#.*)?$", re.M)
_ITEM = re.compile(r"[{,\s]\"(namespace|serviceAccountName|secretName|serviceName|claimName|name)\"\s*:\s*\"([^\"\n]{1,253})\"")


def _value(m: re.Match) -> tuple[int, str]:
    g = 3 if m[3] is not None else 4 if m[4] is not None else 5
    return (m.start(g), m[g]) if m[g] else (m.end(), "")


@reader("devops-yaml", "apiversion", "services:")
def manifests(s: str) -> Iterator[Name]:
    """Manifests: apiVersion and kind decide; metadata names, references and hosts of each document."""
    for doc in re.finditer(r"(?:^|(?<=\n))(?!---)[\s\S]+?(?=\n---|\Z)", s):
        text, base = doc[0], doc.start()
        kind = re.search(r"(?m)^[ {\"]*\"?kind\"?:\s*\"?([A-Z]\w{2,40})\"?", text) or re.search(r"\"kind\"\s*:\s*\"([A-Z]\w{2,40})\"", text)
        version = re.search(r"\"?apiVersion\"?\s*:\s*\"?(v\d\w*|[\w.\-]+/v\d\w*)\"?", text)
        if version and text.lstrip().startswith("{"):
            for m in _ITEM.finditer(text):
                if not ownerless(m[2]) and (m[1] != "name" or identifier(m[2])):
                    yield Name(base + m.start(2), base + m.end(2), REFERENCES.get(m[1]) or "service")
        elif version and kind:
            path: list[tuple[int, str]] = []
            for m in _PAIR.finditer(text):
                indent = len(m[1]) + (2 if m[0].lstrip().startswith("- ") else 0)
                path = [p for p in path if p[0] < indent]
                at, v = _value(m)
                parents = [p[1] for p in path]
                entity = None
                if m[2] == "name" and parents[-1:] == ["metadata"]:
                    entity = KINDS.get(kind[1], "service")
                elif m[2] == "name" and parents[-1:] and (parents[-1].endswith(("Ref", "Selector")) or parents[-1] in ("service", "configMap", "secret", "imagePullSecrets", "clusters", "contexts", "users")):
                    entity = {"users": "user"}.get(parents[-1], "server" if parents[-1] in ("clusters", "contexts") else "service")
                elif m[2] in REFERENCES:
                    entity = REFERENCES[m[2]]
                elif m[2] in ("app", "app.kubernetes.io/name", "app.kubernetes.io/instance"):
                    entity = "service"
                elif m[2] == "host" and not public_host(v):
                    entity = "server"
                if entity and v and not ownerless(v):
                    yield Name(base + at, base + at + len(v), entity, identifier(v))
                if not v:
                    path.append((indent, m[2]))
        elif version and re.search(r"(?m)^type: (?:application|library)", text):
            if m := re.search(r"(?m)^name: ([\w\-]{2,100})", text):
                yield Name(base + m.start(1), base + m.end(1), "service")
        elif m := re.search(r"(?m)^services:[ ]*\n", text):
            if re.search(r"(?m)^[ ]{4,}(?:image|build|depends_on|container_name|ports):", text):
                yield from _compose(text, base, m.end())


def _compose(text: str, base: int, start: int) -> Iterator[Name]:
    for m in re.finditer(r"(?m)^([ ]{2})([\w.\-]{2,63}):[ ]*$|^[ ]{4,}(container_name|hostname):[ ]*([\w.\-]{2,100})|^\S", text[start:]):
        if m[0][0] not in " ":
            break
        g = 2 if m[2] else 4
        if not ownerless(m[g]):
            yield Name(base + start + m.start(g), base + start + m.end(g), "server" if m[3] == "hostname" else "service", identifier(m[g]))


@reader("terraform", "resource")
def terraform(s: str) -> Iterator[Name]:
    """Names in typed blocks."""
    kinds = (("bucket|storage_container", "bucket"), ("db_|rds|sql_database|database", "database"), ("queue|topic|sqs|sns|pubsub|kinesis", "queue"), ("table", "table"), ("instance|vm|server|cluster", "server"), ("namespace|resource_group", "namespace"), ("user|service_account|role", "user"))
    for m in re.finditer(r"(?m)^[ ]*resource[ ]+\"([\w\-]+)\"[ ]+\"([\w\-]+)\"[ ]*\{", s):
        entity = next((e for k, e in kinds if re.search(k, m[1])), "service")
        stop = s.find("\n}", m.end())
        block = s[m.end() : stop if stop >= 0 else len(s)]
        for a in re.finditer(r"(?m)^[ ]*(name|bucket|identifier|cluster_name|function_name|table_name|account_id|namespace|database_name|queue_name|topic)[ ]*=[ ]*\"([^\"\n$]{2,200})\"", block):
            if not placeholder(a[2]):
                yield Name(m.end() + a.start(2), m.end() + a.end(2), {"namespace": "namespace", "bucket": "bucket", "table_name": "table", "account_id": "user"}.get(a[1], entity))


_ARM = re.compile(r"\"type\"\s*:\s*\"(Microsoft\.[A-Za-z.]{2,60}/[A-Za-z/]{2,120})\"")
_ARM_NAME = re.compile(r"\"name\"\s*:\s*\"([^\"\n]{2,200})\"")


def _own(s: str, at: int) -> tuple[int, str]:
    """(place, text) of the object around a place, with the objects and lists inside it left blank."""
    depth, start = 0, at
    while start and depth < 1:
        start -= 1
        depth += {"{": 1, "}": -1}.get(s[start], 0)
    out, depth, i = [], 0, start
    while i < len(s):
        c = s[i]
        depth += (c in "{[") - (c in "}]")
        out.append(c if depth == 1 else " ")
        i += 1
        if depth < 1:
            break
    return start, "".join(out)


@reader("arm", "microsoft.")
def arm(s: str) -> Iterator[Name]:
    """Resources of a deployment template: the name beside a resource's type; of a nested one, a part for each level. Expressions are no names."""
    for m in _ARM.finditer(s):
        start, own = _own(s, m.start())
        if not (n := _ARM_NAME.search(own)) or n[1].startswith("["):
            continue
        levels = m[1].split("/")[1:]
        for k, p in enumerate(re.finditer(r"[^/]+", n[1])):
            kind = levels[min(k, len(levels) - 1)].lower()
            entity = next((e for w, e in _ARM_KINDS if w in kind), "service")
            if not ownerless(p[0]):
                yield Name(start + n.start(1) + p.start(), start + n.start(1) + p.end(), entity)


# Words of resource types and the entity of their names.
_ARM_KINDS = (("storageaccount", "cloud_account"), ("container", "bucket"), ("database", "database"), ("queue", "queue"), ("topic", "queue"), ("eventhub", "queue"), ("table", "table"), ("virtualmachine", "server"), ("server", "server"), ("cluster", "server"), ("namespace", "namespace"), ("identit", "user"))


@reader("bicep", "resource")
def bicep(s: str) -> Iterator[Name]:
    for m in re.finditer(r"(?m)^resource[ ]+\w+[ ]+'([\w./]+)@[\d\-\w]+'[ ]*=[ ]*\{[^}]{0,300}?\bname:[ ]*'([\w.\-]{2,120})'", s):
        yield from group(m, 2, "cloud_account" if "storageAccounts" in m[1] else "service")


@reader("ansible-ini", "[")
def ansible(s: str) -> Iterator[Name]:
    """Hosts under inventory sections."""
    section = ""
    for m in re.finditer(r"(?m)^(?:\[([\w:.\-]{1,80})\]|([\w.\-\[\]:]{3,120})((?:[ ]+\w+=\S+)*))[ ]*$", s):
        if m[1]:
            section = m[1]
        elif section and not section.endswith((":vars", ":children")) and ("ansible_" in m[3] or re.search(r"[\d-]", m[2]) and "." not in m[2][-4:]) and not public_host(m[2]):
            yield Name(m.start(2), m.end(2), "server", "ansible_" in m[3])
            for v in re.finditer(r"ansible_(host|user)=([\w.\-]{2,100})", m[3]):
                if not ownerless(v[2]) and not re.fullmatch(r"[\d.]+", v[2]):
                    yield Name(m.start(3) + v.start(2), m.start(3) + v.end(2), "server" if v[1] == "host" else "user")


@reader("jenkins", "label", "node", "runs-on", "pool", "environment")
def ci(s: str) -> Iterator[Name]:
    """Runner labels of pipelines."""
    pipeline = re.search(r"\b(?:pipeline|agent|stage)\b", s)
    for m in re.finditer(r"\b(?:label|node)\s*[( ]\s*['\"]([\w\-]{3,80})['\"]", s):
        if pipeline and identifier(m[1]):
            yield Name(m.start(1), m.end(1), "server", False)
    for m in re.finditer(r"(?m)^[ ]*(?:runs-on|pool|environment):[ ]*([\w\-]{3,80})[ ]*$", s):
        if identifier(m[1]) and not re.match(r"(?:ubuntu|windows|macos)-", m[1]):
            yield Name(m.start(1), m.end(1), "server", False)


@reader("k8s-dns", ".svc")
def cluster_dns(s: str) -> Iterator[Name]:
    for m in re.finditer(r"\b([a-z0-9][\w\-]{0,62})\.([a-z0-9][\w\-]{0,62})\.svc(?:\.cluster\.local)?\b", s):
        if m[2] not in ("default", "kube-system") or m[1] != "kubernetes":
            yield from group(m, 1, "service")
            yield from group(m, 2, "namespace")


# Registries and owners of public images.
REGISTRIES = "docker.io registry.k8s.io k8s.gcr.io gcr.io ghcr.io quay.io mcr.microsoft.com public.ecr.aws registry.hub.docker.com".split()
OWNERS = "library bitnami prometheus grafana nginxinc hashicorp jetstack istio elastic confluentinc apache redis argoproj fluent".split()


@reader("image", "image", "from ", "docker ")
def image(s: str) -> Iterator[Name]:
    """Private registries and owners of container images."""
    for m in re.finditer(r"(?:\bimage:[ ]*[\"']?|\"image\"\s*:\s*\"|\bFROM[ ]+|\bdocker (?:pull|push|run)[ ]+(?:-\S+[ ]+)*)((?:[\w.\-]+(?::\d+)?/)+)([\w.\-]+)(?::[\w.\-]+)?", s):
        pieces = list(re.finditer(r"[\w.\-]+(?::\d+)?", m[1]))
        first = pieces[0][0]
        registry = "." in first or ":" in first
        host = first.split(":")[0]
        if registry and host in REGISTRIES or not registry and first in OWNERS:
            rest = pieces[1:]
            if not registry or rest and rest[0][0] in OWNERS or not rest:
                continue
        elif registry:
            yield Name(m.start(1) + pieces[0].start(), m.start(1) + pieces[0].start() + len(host), "server")
            rest = pieces[1:]
        else:
            rest = pieces
        for p in rest:
            yield Name(m.start(1) + p.start(), m.start(1) + p.end(), "organization")
        yield from group(m, 2, "repository")


_LISTING = re.compile(r"\b(?:kubectl|oc|docker|helm|gcloud|az|aws)\s+(?:get|list|ls|ps|describe)?\s*([a-z]*)")


@reader("cli-output", "kubectl", "oc ", "docker", "helm", "gcloud", "az ", "aws")
def tool_output(s: str) -> Iterator[Name]:
    """Rows under an upper-case header, up to three lines below the command that prints it."""
    lines = [(m.start(), m[0]) for m in re.finditer(r"[^\n]+", s)]
    for i, (_, line) in enumerate(lines):
        got = _LISTING.search(line)
        if not got:
            continue
        for j in range(i + 1, min(i + 4, len(lines))):
            heads = list(re.finditer(r"[A-Z][A-Z ()\-]*?[A-Z](?=\s{2,}|\s*$)|[A-Z]{2,}", lines[j][1]))
            if len(heads) < 2 or not re.fullmatch(r"[A-Z0-9 ()\-%/.]+", lines[j][1]):
                continue
            named = {"NAME": "namespace" if got[1] in ("ns", "namespace", "namespaces") else "service", "NAMESPACE": "namespace", "NODE": "server", "NAMES": "service", "CLUSTER": "server"}
            for base, row in lines[j + 1 :]:
                if re.match(r"[$#>]|\S+@\S+[:~]", row) or _LISTING.search(row):
                    break
                for h in heads:
                    at = h.start()
                    while 0 < at < len(row) and not row[at - 1].isspace():
                        at -= 1
                    m = re.compile(r"\S+").match(row, at) if at < len(row) else None
                    if m and h[0] in named and identifier(m[0]) and not ownerless(m[0]):
                        yield Name(base + m.start(), base + m.end(), named[h[0]], False)
            break
