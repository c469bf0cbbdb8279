"""From files to chunk rows and graph events: one pass over the files, two projections of it."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.config import DEFAULTS, EngineConfig
from sextant.functions import text as T
from sextant.functions import vectors as V
from sextant.operators import java_source, markdown
from sextant.schema import CHUNKS, GRAPH_EVENTS
from sextant.sources import store

try:
    import yaml
except ImportError:  # specifications in JSON are read without it
    yaml = None

# Annotations that make components, and those that map requests, with their methods.
COMPONENTS = frozenset(("Service", "Component", "Repository", "Controller", "RestController", "Configuration"))
MAPPINGS = {"RequestMapping": "ANY", "GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH"}
HTTP_METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH")


def digest(text: str | None) -> str:
    return hashlib.sha256((text or "").encode("utf-8", "surrogatepass")).hexdigest()[:16]


def _chunk(**given) -> dict:
    base = dict.fromkeys(("id", "path", "domain", "type", "fqn", "title", "section", "lang", "text", "content_hash"))
    return base | {"symbols": []} | given


def _node(id_: str, label: str, tags: list[str], signature: str | None, javadoc: str | None) -> dict:
    return {"kind": "N", "id": id_, "label": label, "tags": tags, "signature": signature, "javadoc": javadoc}


def _edge(src: str, dst: str, type_: str) -> dict:
    return {"kind": "E", "src": src, "dst": dst, "edge_type": type_}


def parse_markdown(repo: str | None, path: str, content: str | None, most: int = DEFAULTS.max_section_chars) -> tuple[list[dict], list[dict]]:
    chunks = []
    for heading, text in markdown.sections(content):
        for part, piece in enumerate(markdown.pack(text, most)):
            id_ = f"{path}#{markdown.slug(heading)}" + (f"-{part}" if part else "")
            chunks.append(_chunk(id=id_, path=path, domain="KNOWLEDGE", type="MD_SECTION", title=heading, lang="markdown", text=piece, content_hash=digest(piece)))
    return chunks, []


class _Visible(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        if tag in ("p", "br", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "table"):
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def html_text(content: str | None) -> str:
    """The visible text of an HTML document, blank lines folded."""
    reader = _Visible()
    reader.feed(content or "")
    reader.close()
    lines = (" ".join(x.split()) for x in "".join(reader.out).split("\n"))
    return "\n".join(x for x in lines if x)


def parse_document(repo: str | None, path: str, content: str | None) -> tuple[list[dict], list[dict]]:
    text = (content or "").strip()
    extension = path.rpartition(".")[2].lower() if "." in path else ""
    return [_chunk(id=f"{path}#body", path=path, domain="KNOWLEDGE", type="DOCUMENT", lang=extension, text=text, content_hash=digest(text))], []


def _tags(notes: list[java_source.Annotation]) -> list[str]:
    tags = set()
    for a in notes:
        if a.name in COMPONENTS:
            tags.add("BEAN")
        if a.name in ("RestController", "Controller"):
            tags.add("REST_CONTROLLER")
        if a.name == "Repository":
            tags.add("REPOSITORY")
        if a.name in MAPPINGS:
            tags.add("ENDPOINT")
        if a.name == "KafkaListener":
            tags.add("KAFKA_CONSUMER")
    return sorted(tags)


def annotation_value(note: java_source.Annotation) -> str:
    """The single value, or that of value, path or topics, the first of an array; the annotation's name if there is none."""
    text = note.text
    if text is None or not text.strip():
        return note.name
    text = text.strip()
    if re.match(r"[A-Za-z_]\w*\s*=(?!=)", text):
        m = re.search(r"\b(?:value|path|topics)\s*=\s*(\{.*?\}|\"(?:[^\"\\]|\\.)*\"|[^,]+)", text, re.DOTALL)
        if m is None:
            return note.name
        text = m[1].strip()
    if text.startswith("{"):
        inner = text[1:-1].strip()
        if not inner:
            return "/"
        first = re.match(r'"(?:[^"\\]|\\.)*"|[^,]+', inner)
        text = first[0] if first else inner
    return re.sub(r'^[{\[\s"]+|[}\]\s"]+$', "", text)


def endpoint_key(note: java_source.Annotation) -> str:
    raw = annotation_value(note)
    path = "/" if raw in MAPPINGS else raw if raw.startswith("/") else "/" + raw
    return f"{MAPPINGS[note.name]} {path}"


def is_bean(type_name: str) -> bool:
    simple = type_name.split("<")[0].rpartition(".")[2]
    return simple[:1].isupper() and simple not in T.NOT_BEANS


def parse_java(repo: str | None, path: str, content: str | None) -> tuple[list[dict], list[dict]]:
    parsed = java_source.parse(content)
    if parsed is None:
        return [], []
    package, types = parsed
    chunks, events = [], []
    for t in types:
        fqn = f"{package}.{t.name}" if package else t.name
        doc = java_source.comment_text(t.doc)
        events.append(_node(fqn, t.kind, _tags(t.annotations), t.name, doc))
        symbols = ["@" + a.name for a in t.annotations]
        chunks.append(_chunk(id=fqn, path=path, domain="CODE", type="CLASS", fqn=fqn, symbols=symbols, lang="java", text=f"{fqn}\n{doc or ''}", content_hash=digest(t.source)))
        events += [_edge(fqn, p, "DEPENDS_ON") for c in t.constructors for p in c if is_bean(p)]
        for m in t.methods:
            own = f"{fqn}#{m.name}({', '.join(m.types)})"
            events.append(_node(own, "Method", _tags(m.annotations), m.declaration, java_source.comment_text(m.doc)))
            events.append(_edge(fqn, own, "DECLARES"))
            for a in m.annotations:
                if a.name in MAPPINGS:
                    key = endpoint_key(a)
                    events += [_node(key, "Endpoint", ["ENDPOINT", f"REPO:{repo}"], key, own), _edge(own, key, "EXPOSES")]
                if a.name == "KafkaListener":
                    topic = annotation_value(a)
                    events += [_node(topic, "Topic", ["TOPIC"], topic, None), _edge(own, topic, "CONSUMES")]
            events += [_edge(own, c, "CALLS") for c in m.calls]
            text = f"{m.declaration}\n{m.body}"
            chunks.append(_chunk(id=own, path=path, domain="CODE", type="METHOD", fqn=own, symbols=["@" + a.name for a in m.annotations], lang="java", text=text, content_hash=digest(text)))
    return chunks, events


def parse_openapi(repo: str | None, path: str, content: str | None) -> tuple[list[dict], list[dict]]:
    spec = None
    try:
        spec = json.loads(content or "")
    except ValueError:
        if yaml is not None:
            try:
                spec = yaml.load(content or "", Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
            except (yaml.YAMLError, ValueError, RecursionError):
                spec = None
    if not isinstance(spec, dict) or not str(spec.get("openapi", "")).startswith("3") or not isinstance(spec.get("paths"), dict):
        return [], []
    say = lambda x: None if x is None else str(x)
    chunks, events = [], []
    for api_path, item in spec["paths"].items():
        for method in HTTP_METHODS:
            op = item.get(method.lower()) if isinstance(item, dict) else None
            if not isinstance(op, dict):
                continue
            fqn = f"{method} {api_path}"
            summary = say(op.get("summary")) or fqn
            lines = [fqn, summary]
            if op.get("description") is not None:
                lines.append(say(op["description"]))
            for p in op.get("parameters") or []:
                if isinstance(p, dict):
                    lines.append("param:" + " ".join(filter(None, (say(p.get("name")), say(p.get("description"))))))
            body = op.get("requestBody")
            if isinstance(body, dict) and body.get("description") is not None:
                lines.append(f"request:{body['description']}")
            for code, r in (op.get("responses") or {}).items():
                if isinstance(r, dict) and r.get("description") is not None:
                    lines.append(f"response:{code} {r['description']}")
            text = "\n".join(lines).strip()
            id_ = f"{path}#{fqn.replace(' ', '-').replace('/', '_')}"
            chunks.append(_chunk(id=id_, path=path, domain="KNOWLEDGE", type="OPENAPI_OP", fqn=fqn, title=summary, section=str(api_path), lang="openapi", text=text, content_hash=digest(text)))
            events += [_node(fqn, "Endpoint", ["ENDPOINT", f"REPO:{repo}"], fqn, summary), _edge(path, fqn, "SPECIFIES")]
    return chunks, events


PARSERS = {"JAVA": parse_java, "MARKDOWN": parse_markdown, "API_SPEC": parse_openapi, "DOCUMENT": parse_document}
_CHUNK = [c.split()[0] for c in CHUNKS.split(", ")]
_EVENT = [c.split()[0] for c in GRAPH_EVENTS.split(", ")]
_BOTH = (
    "kind string, seq long, ord int, repo string, branch string, git_sha string, id string, path string, domain string, type string, fqn string, title string, section string, symbols array<string>, "
    "content_hash string, lang string, text string, label string, tags array<string>, signature string, javadoc string, src string, dst string, edge_type string"
)


def parse_files(files: DataFrame) -> DataFrame:
    """Chunks (kind C) and graph events (kinds N, E) of files (seq, repo, branch, path, git_sha, content).

    Each row carries the file's seq and its order in the file. Files of unknown kind, with a
    null path or null content, and Java or specifications that do not parse, give nothing.
    """
    cols = [c.split()[0] for c in _BOTH.split(", ")]
    typed = files.withColumn("source_class", T.source_class(F.col("path"))).filter("source_class != 'IGNORE' and content is not null")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for f in pdf.itertuples(index=False):
                chunks, events = PARSERS[f.source_class](f.repo, f.path, f.content)
                for n, row in enumerate([{"kind": "C", **c} for c in chunks] + events):
                    out.append(row | {"seq": f.seq, "ord": n, "repo": f.repo, "branch": f.branch, "git_sha": f.git_sha})
            yield pd.DataFrame(out, columns=cols).astype(object).where(lambda x: x.notna(), None) if out else pd.DataFrame(columns=cols)

    return typed.select("seq", "repo", "branch", "path", "git_sha", "content", "source_class").mapInPandas(parse, _BOTH)


def chunk_rows(parsed: DataFrame, config: EngineConfig = DEFAULTS, embed: bool = True) -> DataFrame:
    """Chunk rows, the last of each key kept (file order, files of one time by path, then order in the file)."""
    rows = parsed.filter("kind = 'C'").withColumn("seq", F.col("seq") * 1_000_000 + F.col("ord"))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*config.chunk_key).orderBy(F.desc("seq"), F.desc("path")))).filter("_n = 1")
    vector = V.embedder(config.model_dir, config.dim)(F.col("text")) if embed else F.lit(None).cast("array<float>")
    return rows.withColumn("vector", vector).select(*_CHUNK)


def event_rows(parsed: DataFrame) -> DataFrame:
    rows = parsed.filter("kind != 'C'").withColumn("seq", F.col("seq") * 1_000_000 + F.col("ord")).withColumn("tag", F.lit(None).cast("string"))
    return rows.select(*_EVENT)


def apply_changes(chunks: DataFrame, changes: DataFrame, fresh: DataFrame, branch: str | None = None, config: EngineConfig = DEFAULTS) -> DataFrame:
    """Incremental index: rows of changed paths go, rows of the fresh chunks come in; deletions need no acceptance.

    Without a branch, an unchanged path (the stored chunk path#body has the fresh hash) is skipped.
    """
    touched = changes.select("path").distinct()
    if branch is None:
        bodies = fresh.filter(F.endswith("id", F.lit("#body")))
        same = store.unchanged(bodies.select("id", "content_hash", "path"), chunks).select("path").distinct()
        kept = changes.filter("kind = 'DELETE'").select("path")
        touched = touched.join(same.join(kept, "path", "left_anti"), "path", "left_anti")
    incoming = fresh.join(touched, "path", "left_semi")
    return store.upsert(store.delete_by_path(chunks, touched, branch), incoming, config.chunk_key)
