"""Interface descriptions and XML documents as whole Markdown documents.

A reader gives a document's blocks in order, as an array of texts; ``document`` puts a
blank line between them.  Tables and lists are built by array expressions; what nests
without bound (folders, messages, elements) is flattened by a small function for each document.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.text import bound
from docweave.shipping import ship
from docweave.sources.specs import METHODS, SCALARS, _type
from docweave.tables import dealt

#: headings of XML elements: fixed values
HEADINGS = {
    "book": 1, "article": 1, "part": 1, "set": 1, "chapter": 2, "section": 2, "sect1": 2, "sect2": 3, "sect3": 4, "appendix": 2, "preface": 2, "glossary": 2,
    "bibliography": 2, "refentry": 2, "refsect1": 3, "refsect2": 4, "topic": 1, "concept": 1, "task": 1, "reference": 1,
}
#: what each element of a document is: fixed values
SKIPPED = ["index", "indexterm", "mediaobject", "imageobject", "imagedata", "inlinemediaobject", "include"]
INLINE_CODE = [
    "code", "literal", "command", "filename", "option", "varname", "type", "classname", "function", "parameter", "constant", "computeroutput", "userinput",
    "systemitem",
]
BLOCK_CODE = ["programlisting", "screen", "synopsis", "literallayout"]
LIST_ITEMS = ["listitem", "member", "step"]
#: root elements that speak for and against a document, and the size from which an unknown one counts: fixed values
DOC_ROOTS = [
    "book", "article", "chapter", "section", "refentry", "set", "part", "appendix", "preface", "glossary", "bibliography", "index", "topic", "concept", "task",
    "reference", "map", "bookmap", "ditamap", "learningContent", "troubleshooting", "schema", "definitions", "TEI", "page", "specification", "standard",
    "document", "spec", "rfc",
]
NOISE_ROOTS = [
    "stylesheet", "transform", "svg", "html", "HTML", "Project", "project", "build", "target", "ivy", "assembly", "pom", "settings", "plugin", "metadata",
    "configuration", "appSettings", "connectionStrings", "web", "beans", "context", "resources", "xliff", "translations", "root", "data", "rss", "feed", "plist",
    "mime-info", "manifest", "selector", "shape", "vector", "layer-list", "RelativeLayout", "LinearLayout", "ConstraintLayout", "FrameLayout",
]
LEAST_XML = 5000


def document(blocks: Column) -> Column:
    """The blocks with a blank line between them; null and empty ones are left out."""
    return F.array_join(F.filter(blocks, lambda b: b.isNotNull() & (b != "")), "\n\n")


def grid(head: list[str], rows: Column) -> Column:
    """A table of rows, which are arrays of cells; null without rows."""
    top = f"| {' | '.join(head)} |\n|{'---|' * len(head)}\n"
    lines = F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |")))
    return bound(lines, lambda x: F.when(F.size(x) > 0, F.concat(F.lit(top), F.array_join(x, "\n"))))


def _strings(*cells: Column | str) -> Column:
    return F.array(*[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cells])


def code(text: Column) -> Column:
    return F.concat(F.lit("`"), text, F.lit("`"))


def _texts(one: Callable[[str], list[str]], text: Column) -> Column:
    """one, for a column: an array of texts, empty for what cannot be read."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: one(t or ""))

    return run(text)


def json_of_yaml(text: Column) -> Column:
    """YAML as JSON; JSON stays.  Null for what is neither.  Without a YAML parser this raises at once, on the driver."""
    import yaml

    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)  # the same loader in C, where it is built

    def one(value: str | None) -> str | None:
        try:
            return json.dumps(json.loads(value or ""))
        except ValueError:
            pass
        try:
            parsed = yaml.load(value or "", Loader=loader)
        except yaml.YAMLError:
            return None
        return json.dumps(parsed, default=str) if isinstance(parsed, dict) else None

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(one)

    return run(text)


_SPEC = """openapi string, host string, basePath string, schemes array<string>, info struct<title: string, version: string, description: string, contact: struct<email: string>>,
  servers array<struct<url: string>>, tags array<struct<name: string, description: string>>, paths map<string, map<string, string>>, definitions map<string, string>,
  components struct<schemas: map<string, string>, securitySchemes: map<string, struct<type: string, `in`: string, name: string>>>,
  securityDefinitions map<string, struct<type: string, `in`: string, name: string>>"""
_OPERATION = """summary string, description string, tags array<string>, security array<map<string, string>>, responses map<string, struct<description: string>>,
  parameters array<struct<name: string, `in`: string, type: string, format: string, required: boolean, description: string, schema: string>>,
  requestBody struct<description: string, required: boolean, content: map<string, struct<schema: string>>>"""


def openapi_markdown(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, markdown): server, operations by tag, models and security schemes of JSON descriptions, version 2 or 3.

    Parsed parts are columns of their own, so that each is read once.
    """
    rows = df.select(id_col, F.from_json(text_col, _SPEC).alias("_spec"))
    spec = F.col("_spec")
    title = F.concat(F.lit("# "), F.coalesce(spec["info"]["title"], F.lit("API")), F.lit(" v"), F.coalesce(spec["info"]["version"], F.lit("")))
    url = F.concat(F.coalesce(F.get(spec["schemes"], 0), F.lit("https")), F.lit("://"), spec["host"], F.coalesce(spec["basePath"], F.lit("")))
    server = F.coalesce(F.concat(F.lit("**Server:** "), F.get(spec["servers"], 0)["url"]), F.concat(F.lit("**Base URL:** "), url))
    contact = F.concat(F.lit("**Contact:** "), spec["info"]["contact"]["email"])
    calls = F.flatten(
        F.transform(
            F.map_entries(spec["paths"]),
            lambda p: F.transform(
                F.filter(F.array(*map(F.lit, METHODS)), lambda m: F.map_contains_key(p["value"], m)),
                lambda m: F.struct(F.concat(F.upper(m), F.lit(" "), p["key"]).alias("call"), F.from_json(F.try_element_at(p["value"], m), _OPERATION).alias("op")),
            ),
        )
    )
    rows = rows.withColumn("_calls", calls)
    calls = F.col("_calls")
    tags_of = lambda c: F.coalesce(c["op"]["tags"], F.array(F.lit("default")))
    tags = F.array_distinct(F.flatten(F.transform(calls, tags_of)))
    known = F.map_from_entries(F.transform(spec["tags"], lambda t: F.struct(t["name"], F.coalesce(t["description"], F.lit("")))))
    shown = F.transform(calls, lambda c: F.struct(tags_of(c).alias("tags"), _operation(c["call"], c["op"]).alias("text")))
    rows = rows.withColumns({"_tags": tags, "_known": known, "_shown": shown})
    by_tag = F.transform(
        F.col("_tags"),
        lambda t: document(
            F.concat(
                F.array(F.concat(F.lit("## "), t), F.try_element_at("_known", t)),
                F.transform(F.filter("_shown", lambda c: F.array_contains(c["tags"], t)), lambda c: c["text"]),
            )
        ),
    )
    schemas = F.array_sort(F.map_entries(F.coalesce(spec["definitions"], spec["components"]["schemas"])))
    models = F.transform(schemas, lambda e: _model(e["key"], e["value"]))
    keys = F.transform(
        F.map_entries(F.coalesce(spec["securityDefinitions"], spec["components"]["securitySchemes"])),
        lambda e: F.concat(F.lit("- **"), e["key"], F.lit("**: "), e["value"]["type"], F.lit(" (in: "), F.coalesce(e["value"]["in"], F.lit("")), F.lit(", name: "), F.coalesce(e["value"]["name"], F.lit("")), F.lit(")")),
    )
    rows = rows.withColumns({"_by_tag": by_tag, "_models": models, "_keys": keys})
    by_tag, models, keys = F.col("_by_tag"), F.col("_models"), F.col("_keys")
    none = F.array().cast("array<string>")
    blocks = F.concat(
        F.array(title, spec["info"]["description"], server, contact, F.lit("---")),
        F.coalesce(by_tag, none),
        F.when(F.size(models) > 0, F.concat(F.array(F.lit("---"), F.lit("## Models")), models)).otherwise(none),
        F.when(F.size(keys) > 0, F.array(F.lit("---"), F.lit("## Security Schemes"), F.array_join(keys, "\n"))).otherwise(none),
    )
    return rows.select(id_col, F.when(spec["info"].isNotNull() | spec["paths"].isNotNull(), document(blocks)).alias("markdown"))


def _typed(schema: Column) -> Column:
    """As specs has it, with a link for a reference."""
    name = F.regexp_extract(F.get_json_object(schema, "$['$ref']"), r"([^/]+)$", 1)
    return F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit("["), name, F.lit("](#"), F.lower(name), F.lit(")"))).otherwise(_type(schema))


def _operation(call: Column, op: Column) -> Column:
    own = F.transform(
        op["parameters"],
        lambda p: _strings(
            p["name"], p["in"], F.when(p["schema"].isNotNull(), _typed(p["schema"])).when(p["format"].isNotNull(), F.concat(p["type"], F.lit(" ("), p["format"], F.lit(")"))).otherwise(p["type"]),
            F.when(p["required"], "yes").otherwise("no"), p["description"],
        ),
    )
    body = op["requestBody"]
    sent = F.transform(F.map_values(body["content"]), lambda c: _strings(F.lit("body"), F.lit("body"), _typed(c["schema"]), F.when(body["required"], "yes").otherwise("no"), F.coalesce(body["description"], F.lit("Request body"))))
    none = F.array().cast("array<array<string>>")
    answers = F.transform(F.array_sort(F.map_entries(op["responses"])), lambda e: F.concat(e["key"], F.lit(" ("), F.coalesce(e["value"]["description"], F.lit("")), F.lit(")")))
    keys = F.flatten(F.transform(op["security"], F.map_keys))
    return document(
        F.array(
            F.concat(F.lit("### "), call),
            F.concat(F.lit("**"), F.nullif(op["summary"], F.lit("")), F.lit("**")),
            F.when(~op["description"].eqNullSafe(op["summary"]), op["description"]),
            grid(["Parameter", "In", "Type", "Required", "Description"], F.concat(F.coalesce(own, none), F.coalesce(sent, none))),
            F.when(F.size(answers) > 0, F.concat(F.lit("**Responses:** "), F.array_join(answers, ", "))),
            F.when(F.size(keys) > 0, F.concat(F.lit("**Security:** "), F.array_join(keys, ", "))),
        )
    )


def _model(name: Column, raw: Column) -> Column:
    m = F.from_json(raw, "description string, properties map<string, string>, required array<string>")

    def described(field: Column) -> Column:
        text, example = F.get_json_object(field, "$.description"), F.get_json_object(field, "$.example")
        return F.when(example.isNull(), text).when(F.coalesce(text, F.lit("")) == "", F.concat(F.lit("example: "), example)).otherwise(F.concat(text, F.lit(" (example: "), example, F.lit(")")))

    rows = F.transform(F.map_entries(m["properties"]), lambda e: _strings(e["key"], _typed(e["value"]), F.when(F.array_contains(m["required"], e["key"]), "yes"), described(e["value"])))
    return document(F.array(F.concat(F.lit("### "), name), m["description"], grid(["Field", "Type", "Required", "Description"], rows)))


# nested ones ---------------------------------------------------------------------------------------------


#: characters of a saved response that are shown: a fixed value
MOST_RESPONSE = 2000


def _credentials(auth: object) -> str:
    """How a request or a collection authenticates, with what is set for it."""
    if not isinstance(auth, dict) or not auth:
        return ""
    kind = auth.get("type", "unknown")
    own = auth.get(kind)
    pairs = [(x.get("key"), x.get("value")) for x in own if isinstance(x, dict)] if isinstance(own, list) else [(k, v) for k, v in own.items() if not k.startswith("_")] if isinstance(own, dict) else []
    return "\n".join([f"**Authentication:** {kind}", *(f"- `{k}`: `{v}`" for k, v in pairs if k and v)])


def _saved_responses(responses: object) -> Iterator[str]:
    """Examples of answers, each with its status and body."""
    held = [r for r in responses if isinstance(r, dict)] if isinstance(responses, list) else []
    if held:
        yield "**Example Responses:**"
    for r in held:
        status = " ".join(str(x) for x in (r.get("code"), r.get("status")) if x)
        yield f"##### {r.get('name', 'Response')}" + (f" ({status})" if status else "")
        body = r.get("body") or ""
        if isinstance(body, str) and body:
            cut = f"{body[:MOST_RESPONSE]}\n... (truncated)" if len(body) > MOST_RESPONSE else body
            yield f"```json\n{cut}\n```"


def _postman_blocks(text: str) -> list[str]:
    def plain(value: object) -> str:
        return value.get("content") or "" if isinstance(value, dict) else value if isinstance(value, str) else ""

    def walk(items: list, depth: int) -> Iterator[str]:
        mark = "#" * min(depth + 2, 6)
        for item in filter(lambda x: isinstance(x, dict), items):
            if isinstance(item.get("item"), list):
                yield from (f"{mark} {item.get('name', 'Folder')}", plain(item.get("description")))
                yield from walk(item["item"], depth + 1)
                continue
            request = item.get("request", {})
            request = {"url": request} if isinstance(request, str) else request
            if not isinstance(request, dict):
                continue
            url, method = request.get("url") or "", request.get("method", "GET")
            url = url.get("raw", "") if isinstance(url, dict) else url
            yield from (f"{mark} {method} {item.get('name', 'Unnamed Request')}", f"`{method} {url}`" if url else "", plain(request.get("description")) or plain(item.get("description")), _credentials(request.get("auth")))
            heads = [h for h in request.get("header") or [] if isinstance(h, dict) and h.get("key")]
            if heads:
                yield "| Header | Value |\n|---|---|\n" + "\n".join(f"| `{h['key']}` | `{h.get('value', '')}` |" for h in heads)
            body = request.get("body") or {}
            if isinstance(body, dict) and body.get("raw"):
                yield f"```json\n{body['raw']}\n```"
            yield from _saved_responses(item.get("response"))

    try:
        data = json.loads(text)
    except ValueError:
        return []
    if not isinstance(data, dict):
        return []
    info = data.get("info") or {}
    known = [v for v in data.get("variable") or [] if isinstance(v, dict) and (v.get("key") or v.get("id"))]
    rows = "\n".join(f"| `{v.get('key') or v['id']}` | `{v.get('value', '')}` |" for v in known)
    return [f"# {info.get('name', 'API Collection')}", plain(info.get("description")), _credentials(data.get("auth")), *(["## Variables", f"| Variable | Value |\n|---|---|\n{rows}"] if known else []), *walk(data.get("item") or [], 0)]


_PROTO = re.compile(r"\s*(?:(message|enum|service|oneof|extend)\s+([\w.]+)\s*\{|(rpc\s[^;{]*?\))\s*(?:;|\{[^}]*\})|(\})|([^;{}]+);|(\{))", re.DOTALL)
_FIELD = re.compile(r"(?:(repeated|optional|required)\s+)?(map\s*<[^>]*>|[\w.]+)\s+(\w+)\s*=\s*(\d+)")


def _proto_blocks(text: str) -> list[str]:
    """Package, services, messages, enums and the types and files from elsewhere."""
    text = re.sub(r"//[^\n]*|/\*.*?\*/", "", text, flags=re.DOTALL)
    top: dict[str, list[str]] = {"service": [], "message": [], "enum": []}
    facts, imports, used, declared, stack = [], [], set(), set(), []
    for m in _PROTO.finditer(text):
        kind, name, rpc, close, statement, brace = m.groups()
        if kind or brace:
            stack.append((kind or "block", name or "", []))
            declared.add(name)
        elif close and stack:
            kind, name, lines = stack.pop()
            if kind in top:
                depth = sum(k == "message" for k, _, _ in stack)
                top[kind].append((f"{'#' * (2 if kind == 'service' else 3 + depth)} {kind.capitalize()} `{name}`", kind, name, lines))
            elif kind == "oneof" and stack:
                stack[-1][2].extend(f"{line} [{name}]" for line in lines)
        elif stack and (rpc or statement):
            words = " ".join((rpc or statement).split())
            field = _FIELD.match(words)
            if field and stack[-1][0] in ("message", "oneof"):
                label, of, name, number = field.groups()
                used.update(re.findall(r"[\w.]+", of[3:]) if of.startswith("map") else [of])
                stack[-1][2].append(f"{label + ' ' if label else ''}{of} {name} = {number}")
            elif not words.startswith(("option", "reserved", "extensions")):
                stack[-1][2].append(words)
        elif statement:
            words = statement.split()
            if words[0] == "import":
                imports.append(words[-1].strip("\"'"))
            elif words[0] in ("package", "syntax"):
                facts.append(f"**{words[0].capitalize()}:** `{words[-1].strip(chr(34) + '=')}`")
    out = [*facts]
    for kind, head in (("service", ""), ("message", "## Messages"), ("enum", "## Enums")):
        out += [head] if top[kind] else []
        for title, _, name, lines in top[kind]:
            shown = "\n".join(f"- `{x}`" for x in lines) if kind == "enum" else f"```protobuf\n{kind} {name} {{\n" + "\n".join(f"  {x};" for x in lines) + "\n}\n```"
            out += [title, shown if lines else ""]
    away = sorted(t for t in used if t not in declared and t not in SCALARS and ("." in t or t[:1].isupper()))
    if imports or away:
        out += ["## Cross-References", "**Imported files:**\n" + "\n".join(f"- `{i}`" for i in imports) if imports else "", "**External types used:**\n" + "\n".join(f"- `{t}`" for t in away) if away else ""]
    return out


def _local(name: str) -> str:
    return name.rsplit("}", 1)[-1].rsplit(":", 1)[-1]


class _Markdown:
    """Blocks of an XML document, from its events: a stack of what is open, and what each kind of element does when it closes.

    An element of a kind in ``CLOSES`` collects the text below it (``captures``) and becomes
    one block, or one piece of the paragraph around it.  All others are sections: what they
    hold stands for itself, and a bare text without blocks or title is a block of its own.
    """

    CLOSES = (
        dict.fromkeys(SKIPPED, "drop")
        | dict.fromkeys(BLOCK_CODE, "code")
        | dict.fromkeys(LIST_ITEMS, "item")
        | {"title": "title", "table": "plain", "informaltable": "plain", "para": "paragraph", "simpara": "paragraph"}
    )
    WRAP = dict.fromkeys(INLINE_CODE, "`{}`")

    def __init__(self) -> None:
        self.blocks: list[str] = []
        #: open elements: name, attributes, kind (None: a section), texts, places of the heading and of the first block
        self.open: list[dict] = []
        self.captures: list[dict] = []

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        name = _local(tag)
        kind = "inside" if self.captures else self.CLOSES.get(name)
        own = {"name": name, "attributes": attributes, "kind": kind, "texts": [], "at": len(self.blocks), "title": "", "untouched": True}
        if self.open:
            self.open[-1]["untouched"] = False
        self.open.append(own)
        if kind not in (None, "inside"):
            self.captures.append(own)

    def data(self, text: str) -> None:
        if not self.open:
            return
        if self.captures:
            own = self.captures[-1]
            if own["kind"] == "paragraph" and len(self.open) > 1 and self.open[-1] is not own:
                self.open[-1]["texts"].append(text)
            else:
                own["texts"].append(text)
        elif self.open[-1]["untouched"]:
            self.open[-1]["texts"].append(text)

    def end(self, tag: str) -> None:
        own = self.open.pop()
        said = "".join(own["texts"]).strip()
        if own["kind"] == "inside":
            paragraph = self.captures[-1]
            if paragraph["kind"] == "paragraph":
                # only an element right below the paragraph has signs of its own
                outer = self.open[-1]
                outer["texts"].append(self.piece(own, said) if outer is paragraph else "".join(own["texts"]))
        elif own["kind"] is None:
            heading = f"{'#' * HEADINGS[own['name']]} {own['title']}" if own["name"] in HEADINGS and own["title"] else ""
            if len(self.blocks) == own["at"] and not own["title"] and said:
                self.blocks.append(said)
            elif heading:
                self.blocks.insert(own["at"], heading)
        else:
            self.captures.pop()
            self.close(own, said)

    def close(self, own: dict, said: str) -> None:
        if own["kind"] == "title" and self.open:
            self.open[-1]["title"] = self.open[-1]["title"] or said
        elif own["kind"] == "code" and said:
            self.blocks.append(f"```\n{said}\n```")
        elif own["kind"] == "item" and said:
            self.blocks.append(f"- {said}")
        elif own["kind"] == "plain" and said:
            self.blocks.append(said)
        elif own["kind"] == "paragraph":
            pieces = [p.strip() for p in own["texts"]]
            if any(pieces):
                self.blocks.append(" ".join(p for p in pieces if p))

    def piece(self, own: dict, said: str) -> str:
        """An element of a paragraph as Markdown."""
        attributes = own["attributes"]
        if own["name"] == "xref":
            return f"[{attributes.get('linkend', '')}]"
        if not said:
            return ""
        if own["name"] == "emphasis":
            return f"**{said}**" if attributes.get("role") in ("bold", "strong") else f"*{said}*"
        if own["name"] in ("link", "ulink"):
            to = attributes.get("url") or {_local(k): v for k, v in attributes.items()}.get("href")
            return f"[{said}]({to})" if to else said
        return self.WRAP.get(own["name"], "{}").format(said)


def _xml_blocks(text: str) -> list[str]:
    """Sections, paragraphs, code and lists of DocBook-like documents; tags are stripped from what is no XML."""
    reader = _Markdown()
    parser = ET.XMLParser(target=_Events(reader))
    try:
        parser.feed(re.sub(r"<!(?:DOCTYPE|ENTITY)[^>]*>", "", text))
        parser.close()
    except ET.ParseError:
        return [re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", text)).strip()]
    return reader.blocks


class _Events:
    """Hands a parser's events on, with the texts between two tags as one."""

    def __init__(self, reader: _Markdown) -> None:
        self.reader, self.held = reader, []

    def _flush(self) -> None:
        if self.held:
            self.reader.data("".join(self.held))
            self.held.clear()

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        self._flush()
        self.reader.start(tag, attributes)

    def end(self, tag: str) -> None:
        self._flush()
        self.reader.end(tag)

    def data(self, text: str) -> None:
        self.held.append(text)

    def close(self) -> None:
        self._flush()


def postman_blocks(text: Column) -> Column:
    return _texts(_postman_blocks, text)


def proto_blocks(text: Column) -> Column:
    return _texts(_proto_blocks, text)


def xml_blocks(text: Column) -> Column:
    return _texts(_xml_blocks, text)


def is_document_xml(head: Column) -> Column:
    """Whether an XML text is documentation, by its first element within 500 characters; an unknown one counts if it is long."""
    body = F.regexp_replace(head, F.lit(r"(?s)\A\s*(?:<\?.*?\?>\s*)?(?:<![^>]*>\s*)*"), F.lit(""))
    root = F.regexp_extract(F.left(body, F.lit(500)), r"<(?:\w+:)?(\w+)[\s/>]", 1)
    return F.when(root == "", False).when(root.isin(DOC_ROOTS), True).when(root.isin(NOISE_ROOTS), False).otherwise(F.octet_length(head) >= LEAST_XML)


# WSDL and apiDoc: flat enough for expressions ------------------------------------------------------------------


def wsdl_markdown(text: Column) -> Column:
    """Services with ports, port types with operations, bindings with actions, messages with parts, types with elements."""
    return bound(F.regexp_replace(text, F.lit(r"(?s)<!--.*?-->"), F.lit("")), _wsdl_markdown)


def _wsdl_markdown(bare: Column) -> Column:
    tag = lambda name: rf"(?s)<(?:\w+:)?{name}\b[^>]*?(?:/>|>.*?</(?:\w+:)?{name}\s*>)"
    found = lambda c, name: F.regexp_extract_all(c, F.lit(tag(name)), F.lit(0))
    attribute = lambda c, name: F.regexp_extract(c, rf"""^<[^>]*?\b{name}\s*=\s*["']([^"']*)""", 1)
    local = lambda c: F.regexp_extract(c, r"([^:]*)$", 1)
    of = lambda c, child, name: local(attribute(F.get(found(c, child), 0), name))
    namespace = F.regexp_extract(bare, r"""targetNamespace\s*=\s*["']([^"']*)""", 1)
    ports = found(bare, "portType")
    outside = F.regexp_replace(bare, F.lit(tag("portType")), F.lit(""))
    title = lambda services: F.coalesce(F.nullif(attribute(F.get(services, 0), "name"), F.lit("")), F.lit("Service"))

    def service(s: Column) -> Column:
        lines = F.transform(found(s, "port"), lambda p: F.concat_ws("\n", F.concat(F.lit("- **Port** "), code(attribute(p, "name")), F.lit(", binding "), code(local(attribute(p, "binding")))), F.concat(F.lit("  - Address: "), code(F.nullif(attribute(F.get(found(F.regexp_replace(p, F.lit(r"^<[^>]*>"), F.lit("")), "address"), 0), "location"), F.lit(""))))))
        return document(F.array(F.concat(F.lit("### "), attribute(s, "name")), F.array_join(lines, "\n")))

    def inner(c: Column) -> Column:
        return F.regexp_replace(c, F.lit(r"\A<[^>]*>"), F.lit(""))

    def port_type(p: Column) -> Column:
        operations = found(inner(p), "operation")
        rows = F.transform(operations, lambda o: F.array(code(attribute(o, "name")), code(F.coalesce(of(o, "input", "message"), F.lit(""))), code(F.coalesce(of(o, "output", "message"), F.lit("")))))
        faults = F.transform(operations, lambda o: F.array_join(F.transform(found(o, "fault"), lambda f: F.concat(F.lit("- **Fault** "), code(attribute(f, "name")), F.lit(" of "), code(attribute(o, "name")), F.lit(": "), code(local(attribute(f, "message"))))), "\n"))
        return document(F.array(F.concat(F.lit("## Port Type: "), attribute(p, "name")), F.coalesce(grid(["Operation", "Input", "Output"], rows), F.lit("No operations defined.")), F.array_join(F.filter(faults, lambda f: f != ""), "\n")))

    def binding(b: Column) -> Column:
        rows = F.transform(F.filter(found(inner(b), "operation"), lambda o: o.rlike(r"^<[^>]*\bname\s*=")), lambda o: F.array(code(attribute(o, "name")), code(F.regexp_extract(o, r"""soapAction\s*=\s*["']([^"']*)""", 1))))
        return document(F.array(F.concat(F.lit("### "), attribute(b, "name")), F.concat(F.lit("- Port type: "), code(local(attribute(b, "type")))), grid(["Operation", "SOAP Action"], rows)))

    def message(m: Column) -> Column:
        rows = F.transform(found(inner(m), "part"), lambda p: F.array(code(attribute(p, "name")), code(F.coalesce(F.nullif(local(attribute(p, "element")), F.lit("")), local(attribute(p, "type"))))))
        return document(F.array(F.concat(F.lit("### "), attribute(m, "name")), F.coalesce(grid(["Part", "Element / Type"], rows), F.lit("No parts."))))

    def kind(t: Column) -> Column:
        rows = F.transform(found(inner(t), "element"), lambda e: F.array(code(attribute(e, "name")), code(local(attribute(e, "type"))), attribute(e, "minOccurs"), attribute(e, "maxOccurs")))
        return document(F.array(F.concat(F.lit("### "), attribute(t, "name")), grid(["Element", "Type", "Min", "Max"], rows)))

    def part(head: str, items: Column) -> Column:
        return bound(items, lambda x: F.when(F.size(x) > 0, F.concat(F.array(F.lit(head)), x)).otherwise(F.array().cast("array<string>")))

    def outer(x: Column) -> Column:
        """Bindings and messages, which stand outside of port types."""
        bindings = F.filter(found(x, "binding"), lambda b: b.rlike(r"(?s)^<[^>]*\btype\s*="))
        return F.concat(part("## Bindings", F.transform(bindings, binding)), part("## Messages", F.array_sort(F.transform(found(x, "message"), message))))

    types = F.transform(F.filter(found(bare, "complexType"), lambda t: attribute(t, "name") != ""), kind)
    first = lambda s: F.array(F.concat(F.lit("# "), title(s)), F.concat(F.lit("**Target namespace**: "), code(F.nullif(namespace, F.lit("")))))
    head = bound(found(bare, "service"), lambda s: F.concat(first(s), part("## Services", F.transform(s, service))))
    return document(F.concat(head, F.transform(ports, port_type), bound(outside, outer), part("## Types", types)))


_ENTRIES = """array<struct<type: string, url: string, title: string, name: string, description: string, `group`: string, groupTitle: string,
  parameter: struct<fields: map<string, array<struct<type: string, optional: boolean, field: string, description: string>>>>>>"""


def apidoc_markdown(script: Column) -> Column:
    """The calls of a script of the documentation tool, by group; null for what holds no list of calls."""
    listed = F.coalesce(F.nullif(F.regexp_extract(script, r"(?s)define\(\s*(\{.*\})\s*\)\s*;?\s*$", 1), F.lit("")), F.nullif(F.regexp_extract(script, r"(?s)=\s*(\[.*\])\s*;?\s*$", 1), F.lit("")), script)
    return bound(F.from_json(bound(listed, lambda x: F.coalesce(F.get_json_object(x, "$.api"), x)), _ENTRIES), _apidoc_markdown)


def _apidoc_markdown(calls: Column) -> Column:
    bare = lambda c: F.btrim(F.regexp_replace(c, F.lit("</?p>"), F.lit("")), F.lit(" \t\r\n"))
    group = lambda c: F.coalesce(c["group"], F.lit("default"))

    def call(c: Column) -> Column:
        title = F.coalesce(c["title"], c["name"], F.lit(""))
        fields = F.transform(
            F.map_entries(c["parameter"]["fields"]),
            lambda e: F.concat(
                F.when(e["key"] == "Parameter", "**Parameters**\n\n").otherwise(F.concat(F.lit("**Parameters, "), e["key"], F.lit("**\n\n"))),
                grid(["Field", "Type", "Required", "Description"], F.transform(e["value"], lambda f: _strings(code(f["field"]), f["type"], F.when(f["optional"], "no").otherwise("yes"), bare(f["description"])))),
            ),
        )
        said = bare(c["description"])
        return document(F.concat(F.array(F.concat(F.lit("### "), F.upper(F.coalesce(c["type"], F.lit("get"))), F.lit(" "), c["url"]), F.concat(F.lit("**"), F.nullif(title, F.lit("")), F.lit("**")), F.when(said != title, said)), F.coalesce(fields, F.array().cast("array<string>"))))

    groups = F.array_distinct(F.transform(calls, group))
    titled = lambda g: F.coalesce(F.get(F.filter(calls, lambda c: (group(c) == g) & c["groupTitle"].isNotNull()), 0)["groupTitle"], g)
    blocks = F.transform(groups, lambda g: document(F.concat(F.array(F.concat(F.lit("## "), titled(g))), F.transform(F.filter(calls, lambda c: group(c) == g), call))))
    return F.when(F.size(calls) > 0, document(F.concat(F.array(F.lit("# API Documentation"), F.lit("---")), blocks)))


# queries: each part as a file of every kind -----------------------------------------------------------------


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return dealt(spark, sf_dir, "part")


def q_openapi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version 3 as JSON and as YAML, version 2 with a host, and a text that is neither."""
    k = F.col("p_partkey") % 4
    three = F.format_string(
        '{"openapi":"3.0.1","info":{"title":"%s","version":"1","contact":{"email":"a@b.c"}},"servers":[{"url":"http://h/%d"}],"tags":[{"name":"%s","description":"About"}],"paths":{"/p":{"post":{"summary":"Add","tags":["%s"],'
        '"security":[{"key":[]}],"requestBody":{"content":{"application/json":{"schema":{"$ref":"#/components/schemas/Part"}}}},"responses":{"200":{"description":"ok"}}},"get":{"description":"Read"}}},'
        '"components":{"schemas":{"Part":{"required":["size"],"properties":{"size":{"type":"integer","format":"int32","example":%d}}}},"securitySchemes":{"key":{"type":"apiKey","in":"header","name":"X"}}}}',
        "p_name", "p_partkey", "p_brand", "p_brand", "p_size",
    )
    yaml = F.format_string("openapi: 3.0.0\ninfo:\n  title: %s\n  version: '2'\npaths:\n  /a:\n    get:\n      summary: Read %d\n", "p_brand", "p_size")
    two = F.format_string('{"swagger":"2.0","host":"h%d","basePath":"/v1","info":{"version":"3"},"paths":{"/x":{"get":{"parameters":[{"name":"q","in":"query","type":"integer","format":"int64","required":true}]}}},"definitions":{"M":{"description":"A model"}}}', "p_size")
    text = F.when(k == 0, three).when(k == 1, yaml).when(k == 2, two).otherwise("no description: [")
    read = _parts(spark, sf_dir).select("p_partkey", json_of_yaml(text).alias("spec"))
    return openapi_markdown(read, "p_partkey", "spec")


OPENAPI_SQL = r"""
SELECT p_partkey, replace(CASE p_partkey % 4 WHEN 0 THEN '# ' || p_name || ' v1~~**Server:** http://h/' || p_partkey || '~~**Contact:** a@b.c~~---~~## default~~### GET /p~~Read~~## ' || p_brand || '~~About~~### POST /p~~**Add**~~| Parameter | In | Type | Required | Description |~|---|---|---|---|---|~| body | body | [Part](#part) | no | Request body |~~**Responses:** 200 (ok)~~**Security:** key~~---~~## Models~~### Part~~| Field | Type | Required | Description |~|---|---|---|---|~| size | integer (int32) | yes | example: ' || p_size || ' |~~---~~## Security Schemes~~- **key**: apiKey (in: header, name: X)'
  WHEN 1 THEN '# ' || p_brand || ' v2~~---~~## default~~### GET /a~~**Read ' || p_size || '**'
  WHEN 2 THEN '# API v3~~**Base URL:** https://h' || p_size || '/v1~~---~~## default~~### GET /x~~| Parameter | In | Type | Required | Description |~|---|---|---|---|---|~| q | query | integer (int64) | yes |  |~~---~~## Models~~### M~~A model' END, '~', chr(10)) AS markdown FROM part"""


def q_postman(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string(
        '{"info":{"name":"%s","description":{"content":"About"}},"auth":{"type":"basic","basic":{"user":"u","_x":"y"}},"variable":[{"key":"base","value":"%d"}],"item":[{"name":"F","item":[{"name":"G","item":[{"name":"Get it","request":{"method":"POST","url":{"raw":"http://h/%d"},"header":[{"key":"A","value":"b"}],"auth":{"type":"bearer","bearer":[{"key":"token","value":"t%d"},{"key":"empty","value":""}]},"body":{"raw":"{}"}},"response":[{"name":"Fine","code":200,"status":"OK","body":"{1}"},{"name":"None"}]}]}]},{"name":"Top","request":"http://h/top","description":"Said"}]}',
        "p_brand", "p_size", "p_partkey", "p_size",
    )
    return _parts(spark, sf_dir).select("p_partkey", document(postman_blocks(F.when(F.col("p_size") == 1, "broken").otherwise(text))).alias("markdown"))


POSTMAN_SQL = """
SELECT p_partkey, CASE WHEN p_size = 1 THEN '' ELSE replace('# ' || p_brand || '~~About~~**Authentication:** basic~- `user`: `u`~~## Variables~~| Variable | Value |~|---|---|~| `base` | `' || p_size || '` |~~## F~~### G~~#### POST Get it~~`POST http://h/' || p_partkey || '`~~**Authentication:** bearer~- `token`: `t' || p_size || '`~~| Header | Value |~|---|---|~| `A` | `b` |~~```json~{}~```~~**Example Responses:**~~##### Fine (200 OK)~~```json~{1}~```~~##### None~~## GET Top~~`GET http://h/top`~~Said', '~', chr(10)) END AS markdown FROM part"""


def q_proto(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string(
        'syntax = "proto3";\npackage a.b;\nimport "x/y.proto";\n// message Hidden { }\nmessage M%d {\n  string a = 1; /* c */\n  repeated Other%d b = 2;\n  map<string, far.T> c = 3;\n  message In { bool z = 1; }\n  oneof pick { int32 p = 4; In q = 5; }\n}\nenum E { X = 0; Y = 1; }\nservice S {\n  rpc Get (M%d) returns (stream M%d) {}\n  rpc Put (M%d) returns (M%d);\n}\n',
        "p_partkey", "p_size", "p_partkey", "p_partkey", "p_partkey", "p_partkey",
    )
    return _parts(spark, sf_dir).select("p_partkey", document(F.concat(F.array(F.concat(F.lit("# "), "p_brand")), proto_blocks(text))).alias("markdown"))


PROTO_SQL = """
SELECT p_partkey, replace(replace('# ' || p_brand || '~~**Syntax:** `proto3`~~**Package:** `a.b`~~## Service `S`~~```protobuf~service S {~  rpc Get (M@) returns (stream M@);~  rpc Put (M@) returns (M@);~}~```~~## Messages~~#### Message `In`~~```protobuf~message In {~  bool z = 1;~}~```~~### Message `M@`~~```protobuf~message M@ {~  string a = 1;~  repeated Other' || p_size ||
  ' b = 2;~  map<string, far.T> c = 3;~  int32 p = 4 [pick];~  In q = 5 [pick];~}~```~~## Enums~~### Enum `E`~~- `X = 0`~- `Y = 1`~~## Cross-References~~**Imported files:**~- `x/y.proto`~~**External types used:**~- `Other' || p_size || '`~- `far.T`', '@', CAST(p_partkey AS VARCHAR)), '~', chr(10)) AS markdown FROM part"""


def bundles(files: DataFrame, least: int = 50) -> DataFrame:
    """(bundle, markdown): Protobuf files by their last folder, folders of few lines as one, each with a heading for every file."""
    domain = F.coalesce(F.nullif(F.regexp_extract("path", r"([^/]+)/[^/]*$", 1), F.lit("")), F.lit("root"))
    rows = files.select(domain.alias("domain"), "path", proto_blocks(F.col("text")).alias("blocks"), (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).alias("lines"))
    small = rows.groupBy("domain").agg(F.sum("lines").alias("all")).select("domain", F.when(F.col("all") < least, "auxiliary").otherwise(F.col("domain")).alias("bundle"))
    shown = rows.join(small, "domain").select("bundle", "path", document(F.concat(F.array(F.concat(F.lit("## "), F.regexp_extract("path", r"([^/]*)$", 1))), F.col("blocks"))).alias("m"))
    one = F.transform(F.array_sort(F.collect_list(F.struct("path", "m"))), lambda x: x["m"])  # a bundle is one document
    return shown.groupBy("bundle").agg(document(F.concat(F.array(F.concat(F.lit("# gRPC API: "), F.first("bundle"))), one)).alias("markdown"))


def q_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("message M"), F.col("p_partkey"), F.lit(" { bool z = 1; }"), F.repeat(F.lit("\n"), F.col("p_size")))
    files = _parts(spark, sf_dir).select(F.format_string("api/%s%d/%08d.proto", "p_brand", F.col("p_partkey") % 20, "p_partkey").alias("path"), text.alias("text"))
    return bundles(files).select("bundle", F.sha2("markdown", 256).alias("markdown_sha256"))


BUNDLES_SQL = """
WITH f AS (SELECT p_brand || p_partkey % 20 AS domain, printf('%08d', p_partkey) AS name, p_partkey AS k, p_size FROM part), b AS (SELECT domain, CASE WHEN sum(p_size) < 50 THEN 'auxiliary' ELSE domain END AS bundle FROM f GROUP BY domain)
SELECT bundle, sha256('# gRPC API: ' || bundle || string_agg(replace('~~## ' || name || '.proto~~## Messages~~### Message `M' || k || '`~~```protobuf~message M' || k || ' {~  bool z = 1;~}~```', '~', chr(10)), '' ORDER BY 'api/' || f.domain || '/' || name)) AS markdown_sha256
FROM f JOIN b ON b.domain = f.domain GROUP BY bundle"""


def q_wsdl(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string(
        '<w:definitions xmlns:w="http://schemas.xmlsoap.org/wsdl/" targetNamespace="urn:%d"><w:types><x:schema><x:complexType name="T"><x:sequence><x:element name="e" type="x:int" minOccurs="0"/></x:sequence></x:complexType></x:schema></w:types>'
        '<w:message name="In"><w:part name="p" element="t:E"/></w:message><w:message name="Out"/><w:portType name="P%d"><w:operation name="Get"><w:input message="t:In"/><w:output message="t:Out"/><w:fault name="f" message="t:Bad"/></w:operation></w:portType><w:portType name="Q"></w:portType>'
        '<w:binding name="B" type="t:P"><s:binding style="document"/><w:operation name="Get"><s:operation soapAction="urn:get"/></w:operation></w:binding><w:service name="S%d"><w:port name="O" binding="t:B"><s:address location="http://h"/></w:port></w:service></w:definitions>',
        "p_size", "p_partkey", "p_partkey",
    )
    return _parts(spark, sf_dir).select("p_partkey", wsdl_markdown(text).alias("markdown"))


WSDL_SQL = """
SELECT p_partkey, replace('# S' || p_partkey || '~~**Target namespace**: `urn:' || p_size || '`~~## Services~~### S' || p_partkey || '~~- **Port** `O`, binding `B`~  - Address: `http://h`~~## Port Type: P' || p_partkey ||
  '~~| Operation | Input | Output |~|---|---|---|~| `Get` | `In` | `Out` |~~- **Fault** `f` of `Get`: `Bad`~~## Port Type: Q~~No operations defined.~~## Bindings~~### B~~- Port type: `P`~~| Operation | SOAP Action |~|---|---|~| `Get` | `urn:get` |~~## Messages~~### In~~| Part | Element / Type |~|---|---|~| `p` | `E` |~~### Out~~No parts.~~## Types~~### T~~| Element | Type | Min | Max |~|---|---|---|---|~| `e` | `int` | 0 |  |', '~', chr(10)) AS markdown FROM part"""


def q_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string(
        '<?xml version="1.0"?><!DOCTYPE book><book xmlns:k="http://www.w3.org/1999/xlink"><title>%s</title><index>no</index><chapter><title>C</title><para>Use <code>x%d</code> and <emphasis role="bold">this</emphasis>, see <link k:href="http://h">it</link>.</para><programlisting>a = 1</programlisting><itemizedlist><listitem><para>one</para></listitem></itemizedlist></chapter><note>text</note></book>',
        "p_brand", "p_size",
    )
    return _parts(spark, sf_dir).select("p_partkey", document(xml_blocks(F.when(F.col("p_size") == 1, "<a>no  <b>xml</a>").otherwise(text))).alias("markdown"))


XML_SQL = """
SELECT p_partkey, CASE WHEN p_size = 1 THEN 'no xml' ELSE replace('# ' || p_brand || '~~## C~~Use `x' || p_size || '` and **this** , see [it](http://h) .~~```~a = 1~```~~- one~~text', '~', chr(10)) END AS markdown FROM part"""


def q_xml_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = ["<?xml version='1.0'?>\n<!DOCTYPE x>\n<book>", "<d:article x='1'>", "<svg/>", "<project>", "<strange>", "no element", "<!-- c --><schema >"]
    head = F.get(F.array(*map(F.lit, roots)), (F.col("p_partkey") % 7).cast("int"))
    text = F.when(F.col("p_size") % 2 == 0, F.rpad(head, 6000, " ")).otherwise(head)
    return _parts(spark, sf_dir).select("p_partkey", is_document_xml(text).alias("is_document"))


XML_KINDS_SQL = "SELECT p_partkey, p_partkey % 7 IN (0, 1, 6) OR (p_partkey % 7 = 4 AND p_size % 2 = 0) AS is_document FROM part"


def q_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives, of which those with four fifths of Protobuf files or more are bundles."""
    path = F.concat(F.lit("a/"), "p_name", F.when(F.col("p_partkey") % 10 < F.col("p_size") % 4 + 6, ".PROTO").otherwise(".md"))
    entries = _parts(spark, sf_dir).select((F.col("p_size") % 8).alias("archive"), F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)).alias("ext"))
    return entries.groupBy("archive").agg(F.count(F.lit(1)).alias("files"), (F.avg(F.when(F.col("ext") == ".proto", 1.0).otherwise(0.0)) >= 0.8).alias("is_bundle"))


ARCHIVES_SQL = "SELECT p_size % 8 AS archive, count(*) AS files, avg(CASE WHEN p_partkey % 10 < p_size % 4 + 6 THEN 1e0 ELSE 0e0 END) >= 0.8e0 AS is_bundle FROM part GROUP BY 1"


def q_apidoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = F.format_string(
        '[{"type":"post","url":"/p/%d","title":"Add","description":"<p>Adds %s</p>","group":"G","groupTitle":"Group","parameter":{"fields":{"Parameter":[{"type":"String","optional":true,"field":"name","description":"<p>The name</p>"}]}}},{"type":"get","url":"/q","name":"Read"}]',
        "p_partkey", "p_brand",
    )
    k = F.col("p_partkey") % 3
    script = F.when(k == 0, F.concat(F.lit('define({ "api": '), calls, F.lit(" });"))).when(k == 1, F.concat(F.lit("var api = "), calls, F.lit(";"))).otherwise("nothing")
    return _parts(spark, sf_dir).select("p_partkey", apidoc_markdown(script).alias("markdown"))


APIDOC_SQL = """
SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN replace('# API Documentation~~---~~## Group~~### POST /p/' || p_partkey || '~~**Add**~~Adds ' || p_brand || '~~**Parameters**~~| Field | Type | Required | Description |~|---|---|---|---|~| `name` | String | no | The name |~~## default~~### GET /q~~**Read**', '~', chr(10)) END AS markdown FROM part"""

_ALL = {
    "openapi_markdown": (q_openapi, OPENAPI_SQL),
    "postman_markdown": (q_postman, POSTMAN_SQL),
    "proto_markdown": (q_proto, PROTO_SQL),
    "proto_bundle_markdown": (q_bundles, BUNDLES_SQL),
    "wsdl_markdown": (q_wsdl, WSDL_SQL),
    "xml_markdown": (q_xml, XML_SQL),
    "xml_document_or_noise": (q_xml_kinds, XML_KINDS_SQL),
    "archive_kinds": (q_archives, ARCHIVES_SQL),
    "apidoc_markdown": (q_apidoc, APIDOC_SQL),
}
QUERIES = {k: q for k, (q, _) in _ALL.items()}
ORACLES = {k: s for k, (_, s) in _ALL.items()}
