"""Interface descriptions to sections: OpenAPI, Protobuf, WSDL, Postman, and what kind a file is.

OpenAPI is read with from_json, where a field declared as a string keeps its raw
JSON; Protobuf and WSDL with regular expressions.  Postman folders nest
without bound, so a small recursive function lists one collection's requests.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.text import bound
from docweave.tables import dealt

#: order of methods in a section list, and formats by extension: fixed values
METHODS = ["get", "post", "put", "patch", "delete", "options", "head"]
FORMATS = {
    "md": "markdown", "txt": "markdown", "html": "html", "htm": "html", "pdf": "pdf", "docx": "docx", "proto": "proto", "wsdl": "wsdl", "xml": "markdown",
}
#: Protobuf's own types: fixed values
SCALARS = [
    "double", "float", "int32", "int64", "uint32", "uint64", "sint32", "sint64", "fixed32", "fixed64", "sfixed32", "sfixed64", "bool", "string", "bytes",
]
#: newlines below which a domain joins the auxiliary one: fixed value
LEAST_LINES = 50

_SPEC = """openapi string, info struct<title: string, version: string, description: string>, paths map<string, string>,
  definitions map<string, string>, components struct<schemas: map<string, string>>"""
_PARAMETER = "array<struct<name: string, `in`: string, type: string, required: boolean, description: string, schema: string>>"
_OPERATION = f"""summary string, description string, tags array<string>, parameters {_PARAMETER},
  requestBody struct<description: string, required: boolean, content: map<string, struct<schema: string>>>, responses map<string, struct<description: string>>"""


def detect_format(path: Column, content: Column) -> Column:
    """By extension; JSON and YAML by what they hold."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    head = F.coalesce(content, F.lit(""))
    postman = head.rlike(r'"_postman_id"|schema\.getpostman\.com')
    swagger = head.rlike(r"""(?m)(^|[{,]\s*)["']?(swagger|openapi)["']?\s*:""")
    out = F.when((ext == "json") & postman, "postman").when(ext.isin("json", "yaml", "yml") & swagger, "swagger").when(ext.isin("yaml", "yml"), "swagger")
    for known, name in FORMATS.items():
        out = out.when(ext == known, name)
    return out.otherwise("markdown")


def _type(schema: Column) -> Column:
    """A schema's type in words: for an array its innermost items, behind as many "array of" as there are levels.

    An array's items are what its JSON holds behind ``items``, so the levels are taken off one by one
    until none is left: as many as the text of the schema can hold.
    """
    levels = F.size(F.regexp_extract_all(F.coalesce(schema, F.lit("")), F.lit('"items"'), F.lit(0)))
    start = F.struct(schema.alias("schema"), F.lit("").alias("words"))

    def inner(state: Column, _: Column) -> Column:
        held = F.get_json_object(state["schema"], "$.items")
        plain = (_named(state["schema"]) == "") & (F.get_json_object(state["schema"], "$.type") == "array")
        return F.when(plain, F.struct(F.coalesce(held, F.lit("{}")).alias("schema"), F.concat(state["words"], F.lit("array of ")).alias("words"))).otherwise(state)

    last = F.aggregate(F.sequence(F.lit(0), levels), start, inner)
    return F.transform(F.array(last), lambda x: F.concat(x["words"], _simple_type(x["schema"])))[0]


def _named(schema: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.get_json_object(schema, "$['$ref']"), r"([^/]+)$", 1), F.lit(""))


def _simple_type(schema: Column) -> Column:
    get = lambda key: F.get_json_object(schema, f"$.{key}")
    kind = F.coalesce(get("type"), F.lit(""))
    values = F.from_json(get("enum"), "array<string>")
    listed = bound(values, lambda v: F.when(F.size(v) > 0, F.concat(kind, F.lit(" (enum: "), F.array_join(v, ", "), F.lit(")"))))
    plain = F.coalesce(listed, F.concat(kind, F.lit(" ("), get("format"), F.lit(")")), kind)
    return bound(_named(schema), lambda n: F.when(n != "", n).otherwise(plain))


def _some(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def openapi_sections(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, heading_path, heading_level, content): the overview, each operation, each model; a text that is no such JSON gives none."""
    spec = F.from_json(F.col(text_col), _SPEC)
    # kept as a column of its own, so that no filter on what it holds parses a text again, before the rows are dealt
    held = F.filter(F.array(spec), lambda s: s["info"].isNotNull() | s["paths"].isNotNull())
    docs = df.select(F.col(id_col).alias("_id"), F.explode_outer(held).alias("s")).where("s IS NOT NULL")
    docs = docs.withColumn("title", F.coalesce("s.info.title", F.lit("API")))
    about = F.concat_ws("\n\n", F.concat(F.lit("# "), "title", F.lit(" v"), F.coalesce("s.info.version", F.lit(""))), _some(F.col("s.info.description")))
    overview = docs.select("_id", F.col("title").alias("heading_path"), F.lit(1).alias("heading_level"), about.alias("content"))

    paths = docs.select("_id", "title", F.explode("s.paths").alias("path", "item")).withColumn("item", F.from_json("item", "map<string, string>"))
    calls = paths.select("_id", "title", "path", "item", F.explode(F.array(*map(F.lit, METHODS))).alias("method")).withColumn("raw", F.try_element_at("item", "method"))
    calls = calls.where("raw IS NOT NULL").withColumn("op", F.from_json("raw", _OPERATION)).withColumn("call", F.concat(F.upper("method"), F.lit(" "), F.col("path")))
    body = F.transform(
        F.coalesce(F.map_entries("op.requestBody.content"), F.array()),
        lambda e: _row(F.lit("body"), F.lit("body"), _type(e["value"]["schema"]), F.col("op.requestBody.required"), F.coalesce("op.requestBody.description", F.lit("Request body"))),
    )
    own = F.transform(
        F.coalesce("op.parameters", F.from_json(F.lit("[]"), _PARAMETER)),
        lambda p: _row(p["name"], p["in"], F.when(p["schema"].isNotNull(), _type(p["schema"])).otherwise(p["type"]), p["required"], p["description"]),
    )
    rows = F.concat(own, body)
    lines = F.concat(F.lit("\n| Parameter | In | Type | Required | Description |\n|---|---|---|---|---|\n"), F.array_join(rows, "\n"))
    answers = F.transform(F.array_sort(F.map_entries("op.responses")), lambda e: F.concat(e["key"], F.lit(" ("), F.coalesce(e["value"]["description"], F.lit("")), F.lit(")")))
    content = F.concat_ws(
        "\n",
        F.concat(F.lit("### "), "call"),
        F.concat(F.lit("\n**"), _some(F.col("op.summary")), F.lit("**")),
        F.when(~F.col("op.description").eqNullSafe(F.col("op.summary")), F.concat(F.lit("\n"), _some(F.col("op.description")))),
        F.when(F.size(rows) > 0, lines),
        F.when(F.size("op.responses") > 0, F.concat(F.lit("\n**Responses:** "), F.array_join(answers, ", "))),
    )
    tag = F.coalesce(F.get("op.tags", 0), F.lit("default"))
    operations = calls.select("_id", F.concat_ws(" > ", "title", tag, "call").alias("heading_path"), F.lit(3).alias("heading_level"), content.alias("content"))

    models = docs.select("_id", "title", F.explode(F.coalesce("s.definitions", "s.components.schemas")).alias("model", "raw"))
    models = models.withColumn("m", F.from_json("raw", "description string, properties map<string, string>, required array<string>"))
    fields = F.transform(
        F.map_entries("m.properties"),
        lambda e: F.concat(
            F.lit("| "), e["key"], F.lit(" | "), _type(e["value"]), F.lit(" | "),
            F.when(F.coalesce(F.array_contains("m.required", e["key"]), F.lit(False)), "yes").otherwise(""),
            F.lit(" | "), F.coalesce(F.get_json_object(e["value"], "$.description"), F.lit("")), F.lit(" |"),
        ),
    )
    content = F.concat_ws(
        "\n",
        F.concat(F.lit("### "), "model"),
        F.concat(F.lit("\n"), _some(F.col("m.description"))),
        F.when(F.size("m.properties") > 0, F.concat(F.lit("\n| Field | Type | Required | Description |\n|---|---|---|---|\n"), F.array_join(fields, "\n"))),
    )
    models = models.select("_id", F.concat_ws(" > ", "title", F.lit("Models"), "model").alias("heading_path"), F.lit(3).alias("heading_level"), content.alias("content"))
    return overview.union(operations).union(models).withColumnRenamed("_id", id_col)


def _row(name: Column, place: Column, kind: Column, required: Column, description: Column) -> Column:
    cells = [F.coalesce(c, F.lit("")) for c in (name, place, kind, F.when(required, "yes").otherwise("no"), description)]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"(?s)//[^\n]*|/\*.*?\*/"), F.lit(""))


def proto_items(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, kind, name) of each message, enum and service that a file declares."""
    found = F.regexp_extract_all(_bare(F.col(text_col)), F.lit(r"\b(?:message|enum|service)\s+\w+\s*\{"), F.lit(0))
    out = df.select(id_col, F.explode(found).alias("_d"))
    return out.select(id_col, F.regexp_extract("_d", r"^(\w+)", 1).alias("kind"), F.regexp_extract("_d", r"^\w+\s+(\w+)", 1).alias("name"))


def proto_external_types(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, type): types of fields and calls that the file itself doesn't declare."""
    text = _bare(F.col(text_col))
    field = r"[{};]\s*(?:repeated\s+|optional\s+|required\s+)?([A-Za-z_][\w.]*)\s+\w+\s*=\s*\d+"
    # neighbouring fields share a semicolon, so it is doubled first
    used = F.regexp_extract_all(F.regexp_replace(text, F.lit(r"([;{}])"), F.lit(r"$1$1")), F.lit(field), F.lit(1))
    mapped = F.regexp_extract_all(text, F.lit(r"map\s*<\s*\w+\s*,\s*([\w.]+)\s*>"), F.lit(1))
    calls = [F.regexp_extract_all(text, F.lit(r"rpc\s+\w+\s*\(\s*(?:stream\s+)?([\w.]+)\s*\)\s*returns\s*\(\s*(?:stream\s+)?([\w.]+)"), F.lit(g)) for g in (1, 2)]
    types = df.select(id_col, F.explode(F.array_distinct(F.concat(used, mapped, *calls))).alias("type")).where(~F.col("type").isin(*SCALARS, "returns", "option"))
    declared = proto_items(df, id_col, text_col).where("kind <> 'service'").select(id_col, F.col("name").alias("type")).distinct()
    return types.join(declared, [id_col, "type"], "left_anti")


def proto_bundles(df: DataFrame, path_col: str, text_col: str, least: int = LEAST_LINES) -> DataFrame:
    """(bundle, files, lines): files by their last folder, folders with few lines together; texts stay where they are."""
    domain = F.coalesce(F.nullif(F.regexp_extract(path_col, r"([^/]+)/[^/]*$", 1), F.lit("")), F.lit("root"))
    lines = (F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit("")))).cast("long")
    folders = df.groupBy(domain.alias("domain")).agg(F.count(F.lit(1)).alias("files"), F.sum(lines).alias("lines"))
    bundle = F.when(F.col("lines") < least, "auxiliary").otherwise(F.col("domain"))
    return folders.groupBy(bundle.alias("bundle")).agg(F.sum("files").alias("files"), F.sum("lines").alias("lines"))


def wsdl_operations(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, service, port_type, operation) of each operation of a port type; the first service names all."""
    service = F.xpath_string(F.col(text_col), F.lit("//*[local-name()='service']/@name"))
    blocks = F.regexp_extract_all(F.col(text_col), F.lit(r"(?s)<(?:\w+:)?portType\b.*?</(?:\w+:)?portType\s*>"), F.lit(0))
    ports = df.select(id_col, service.alias("service"), F.explode(blocks).alias("_b"))
    name = r"""[^>]*\bname\s*=\s*["']([^"']*)"""
    operations = F.regexp_extract_all("_b", F.lit(rf"<(?:\w+:)?operation\b{name}"), F.lit(1))
    return ports.select(id_col, "service", F.regexp_extract("_b", rf"^<(?:\w+:)?portType\b{name}", 1).alias("port_type"), F.explode(operations).alias("operation"))


_REQUEST = "array<struct<folder: string, level: int, name: string, method: string, url: string>>"


def postman_requests(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, folder, level, name, method, url) of each request; heading levels end at six, a broken text gives none."""

    def listed(items: list, folder: tuple, depth: int) -> Iterator[dict]:
        for item in items:
            if not isinstance(item, dict):
                continue
            name = item.get("name") or ""
            if isinstance(item.get("item"), list):
                yield from listed(item["item"], (*folder, name), depth + 1)
            elif request := item.get("request"):
                request = {"url": request} if isinstance(request, str) else request
                url = request.get("url") or ""
                yield {"folder": " > ".join(folder), "level": min(depth + 2, 6), "name": name, "method": request.get("method") or "GET", "url": url.get("raw", "") if isinstance(url, dict) else url}

    def collection(text: str | None) -> list[dict]:
        try:
            parsed = json.loads(text or "")
        except ValueError:
            return []
        return list(listed(parsed.get("item") or [], (), 0)) if isinstance(parsed, dict) else []

    @F.pandas_udf(_REQUEST)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(collection)

    return df.select(id_col, F.explode(run(text_col)).alias("_r")).select(id_col, "_r.*")


# each part as a file of every kind, so that what a reader finds can be told from the table ----------------------------


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark, sf_dir, "part")


def q_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["md", "TXT", "html", "htm", "pdf", "docx", "proto", "wsdl", "xml", "json", "yaml", "json", "json", ""]
    k = F.col("p_partkey") % len(kinds)
    path = F.concat(F.lit("docs/"), F.col("p_name"), F.when(F.get(F.array(*map(F.lit, kinds)), k.cast("int")) != "", F.concat(F.lit("."), F.get(F.array(*map(F.lit, kinds)), k.cast("int")))).otherwise(""))
    content = F.when(k == 11, '{"openapi": "3.0.0"}').when(k == 12, '{"info": {"_postman_id": "1"}}').when(k == 10, "a: b").otherwise("{}")
    return _parts(spark, sf_dir).select("p_partkey", detect_format(path, content).alias("format"))


FORMATS_SQL = """
SELECT p_partkey, CASE p_partkey % 14 WHEN 2 THEN 'html' WHEN 3 THEN 'html' WHEN 4 THEN 'pdf' WHEN 5 THEN 'docx' WHEN 6 THEN 'proto' WHEN 7 THEN 'wsdl'
  WHEN 10 THEN 'swagger' WHEN 11 THEN 'swagger' WHEN 12 THEN 'postman' ELSE 'markdown' END AS format FROM part"""


def q_openapi(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = F.format_string(
        '{"openapi":"3.0.1","info":{"title":"%s","version":"%d","description":"About"},"paths":{"/parts/%d":{"post":{"summary":"Add","tags":["%s"],'
        '"requestBody":{"required":true,"content":{"application/json":{"schema":{"$ref":"#/components/schemas/Part"}}}},"responses":{"201":{"description":"made"},"200":{}}},'
        '"get":{"summary":"Read","description":"Read","parameters":[{"name":"id","in":"query","required":true,"schema":{"type":"array","items":{"type":"integer","format":"int64"}}}]}}},'
        '"components":{"schemas":{"Part":{"description":"A part","required":["size"],"properties":{"size":{"type":"string","enum":["a","%d"]},"kind":{"type":"string","description":"%s"}}}}}}',
        "p_name", "p_partkey", "p_partkey", "p_brand", "p_size", "p_type",
    )
    return openapi_sections(_parts(spark, sf_dir).select("p_partkey", spec.alias("spec")), "p_partkey", "spec")


OPENAPI_SQL = r"""
SELECT p_partkey, p_name AS heading_path, 1 AS heading_level, '# ' || p_name || ' v' || p_partkey || chr(10) || chr(10) || 'About' AS content FROM part
UNION ALL SELECT p_partkey, p_name || ' > default > GET /parts/' || p_partkey, 3, replace('### GET /parts/' || p_partkey ||
  '~~**Read**~~| Parameter | In | Type | Required | Description |~|---|---|---|---|---|~| id | query | array of integer (int64) | yes |  |', '~', chr(10)) FROM part
UNION ALL SELECT p_partkey, p_name || ' > ' || p_brand || ' > POST /parts/' || p_partkey, 3, replace('### POST /parts/' || p_partkey ||
  '~~**Add**~~| Parameter | In | Type | Required | Description |~|---|---|---|---|---|~| body | body | Part | yes | Request body |~~**Responses:** 200 (), 201 (made)', '~', chr(10)) FROM part
UNION ALL SELECT p_partkey, p_name || ' > Models > Part', 3, replace('### Part~~A part~~| Field | Type | Required | Description |~|---|---|---|---|~| size | string (enum: a, ' || p_size ||
  ') | yes |  |~| kind | string |  | ' || p_type || ' |', '~', chr(10)) FROM part"""


def _protos(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string(
        "syntax = \"proto3\";\n// message Hidden { }\nmessage M%d {\n  string a = 1;\n  repeated Other%d b = 2;\n  map<string, M%d> c = 3;\n}\nenum E { X = 0; }\nservice S { rpc Get (M%d) returns (stream far.Reply); }\n",
        "p_partkey", "p_size", "p_partkey", "p_partkey",
    )
    return _parts(spark, sf_dir).select("p_partkey", F.concat(F.lit("api/"), "p_brand", F.lit("/"), "p_partkey", F.lit(".proto")).alias("path"), text.alias("text"))


PROTO_ITEMS_SQL = """
SELECT p_partkey, 'message' AS kind, 'M' || p_partkey AS name FROM part UNION ALL SELECT p_partkey, 'enum', 'E' FROM part UNION ALL SELECT p_partkey, 'service', 'S' FROM part"""
PROTO_TYPES_SQL = "SELECT p_partkey, 'Other' || p_size AS type FROM part UNION ALL SELECT p_partkey, 'far.Reply' FROM part"
PROTO_BUNDLES_SQL = """
SELECT CASE WHEN lines < 50 THEN 'auxiliary' ELSE p_brand END AS bundle, CAST(sum(files) AS BIGINT) AS files, CAST(sum(lines) AS BIGINT) AS lines
FROM (SELECT p_brand, count(*) AS files, count(*) * 9 AS lines FROM part GROUP BY p_brand) f GROUP BY 1"""


def q_wsdl(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string(
        '<w:definitions xmlns:w="http://schemas.xmlsoap.org/wsdl/"><w:portType name="P%d"><w:operation name="Get"/><w:operation name="Put%d"/></w:portType><w:portType name="Q"><w:operation name="Drop"/></w:portType><w:binding><w:operation name="no"/></w:binding><w:service name="S%d"/></w:definitions>',
        "p_partkey", "p_size", "p_partkey",
    )
    return wsdl_operations(_parts(spark, sf_dir).select("p_partkey", text.alias("x")), "p_partkey", "x")


WSDL_SQL = """
SELECT p_partkey, 'S' || p_partkey AS service, 'P' || p_partkey AS port_type, 'Get' AS operation FROM part
UNION ALL SELECT p_partkey, 'S' || p_partkey, 'P' || p_partkey, 'Put' || p_size FROM part UNION ALL SELECT p_partkey, 'S' || p_partkey, 'Q', 'Drop' FROM part"""


def q_postman(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string(
        '{"item":[{"name":"%s","item":[{"name":"deep","item":[{"name":"Get it","request":{"method":"POST","url":{"raw":"http://h/%d"}}}]}]},{"name":"Top","request":"http://h/top"}]}', "p_brand", "p_partkey"
    )
    return postman_requests(_parts(spark, sf_dir).select("p_partkey", text.alias("t")), "p_partkey", "t")


POSTMAN_SQL = """
SELECT p_partkey, p_brand || ' > deep' AS folder, 4 AS level, 'Get it' AS name, 'POST' AS method, 'http://h/' || p_partkey AS url FROM part
UNION ALL SELECT p_partkey, '', 2, 'Top', 'GET', 'http://h/top' FROM part"""

QUERIES = {
    "detect_formats": q_formats,
    "openapi_sections": q_openapi,
    "proto_declarations": lambda spark, sf_dir: proto_items(_protos(spark, sf_dir), "p_partkey", "text"),
    "proto_external_types": lambda spark, sf_dir: proto_external_types(_protos(spark, sf_dir), "p_partkey", "text"),
    "proto_bundles": lambda spark, sf_dir: proto_bundles(_protos(spark, sf_dir), "path", "text"),
    "wsdl_operations": q_wsdl,
    "postman_requests": q_postman,
}
ORACLES = {
    "detect_formats": FORMATS_SQL,
    "openapi_sections": OPENAPI_SQL,
    "proto_declarations": PROTO_ITEMS_SQL,
    "proto_external_types": PROTO_TYPES_SQL,
    "proto_bundles": PROTO_BUNDLES_SQL,
    "wsdl_operations": WSDL_SQL,
    "postman_requests": POSTMAN_SQL,
}
