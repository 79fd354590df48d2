"""JSON payloads, entities, names and links: what a model's or a user's text is turned into.

Everything is an expression, but for three small functions that Spark has none for:
Unicode decomposition, JSON with blanks as a model's prompt wants it, and label
cleaning inside matches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.functions.text import bound, quoted
from docweave.shipping import ship
from docweave.tables import dealt, table

BLANK = " \t\r\n"
#: kinds of documents, and keys of a chunk's entities: fixed values
DOC_TYPES = ["api_reference", "user_guide", "configuration", "changelog", "release_notes", "troubleshooting", "protocol", "model_schema", "overview"]
ENTITY_KEYS = ["api_endpoints", "config_params", "error_codes", "protocols", "keywords"]
#: signs of code by language: fixed values
CODE_MARKS = {
    "csharp": ["```csharp", "```cs", "```c#", "using System", "namespace "],
    "python": ["```python", "```py", "import ", "def ", "class "],
    "java": ["```java", "import java.", "public class ", "public static void main"],
    "javascript": ["```javascript", "```js", "```typescript", "```ts", "const ", "function "],
    "curl": ["```bash", "```shell", "curl ", "curl\n"],
    "xml": ["```xml", "<?xml", "</ "],
    "json": ["```json", '{"', "[\n  {"],
    "php": ["```php", "<?php"],
    "go": ["```go", "package main", "func main"],
    "cpp": ["```cpp", "```c++", "#include"],
}
#: files that a link may lead to: fixed values
DOWNLOADS = [".pdf", ".wsdl", ".yaml", ".yml", ".proto", ".md", ".txt"]
JSON_NAMES, XML_NAMES = ["swagger", "openapi", "api-docs", "collection"], ["schema", "spec", "types", "wsdl"]
LINK_FORMATS = {".pdf": "pdf", ".wsdl": "wsdl", ".yaml": "swagger", ".yml": "swagger", ".proto": "proto", ".json": "swagger"}


# what a model answers ---------------------------------------------------------------------------------


def unfenced(raw: Column) -> Column:
    """The text without a code fence around it."""
    return bound(F.btrim(raw, F.lit(BLANK)), lambda text: F.when(F.startswith(text, F.lit("```")), _inside(text)).otherwise(text))


def _inside(text: Column) -> Column:
    body = F.when(F.locate("\n", text) > 0, F.regexp_replace(text, F.lit(r"(?s)\A[^\n]*\n"), F.lit(""))).otherwise("")
    return bound(body, lambda b: F.when(F.endswith(b, F.lit("```")), F.btrim(F.left(b, F.length(b) - 3), F.lit(BLANK))).otherwise(b))


def answered_list(raw: Column) -> Column:
    """The elements of a JSON list, as JSON each; an object alone is a list of one, anything broken an empty one."""
    return bound(unfenced(raw), _listed)


def _listed(text: Column) -> Column:
    listed = F.from_json(text, "array<string>")
    alone = F.when(F.startswith(text, F.lit("{")) & F.from_json(text, "map<string, string>").isNotNull(), F.array(text))
    return F.coalesce(F.when(F.startswith(text, F.lit("[")), listed), alone, F.array().cast("array<string>"))


def metadata(raw: Column, expected: Column) -> Column:
    """An array of ``expected`` (doc_type, entities): unknown kinds are other, entities hold the fixed keys."""

    def one(item: Column) -> Column:
        kind = F.when(item["doc_type"].isin(DOC_TYPES), item["doc_type"]).otherwise("other")
        return bound(F.from_json(item["entities"], "map<string, string>"), lambda held: with_entities(kind, held))

    def with_entities(kind: Column, held: Column) -> Column:
        values = [F.filter(F.coalesce(F.from_json(held[k], "array<string>"), F.array().cast("array<string>")), lambda v: v != "") for k in ENTITY_KEYS]
        return F.struct(kind.alias("doc_type"), *[v.alias(k) for k, v in zip(ENTITY_KEYS, values, strict=True)])

    def of(items: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), expected - 1), lambda i: bound(F.from_json(F.get(items, i), "doc_type string, entities string"), one))

    return bound(answered_list(raw), of)


def scores(content: Column, expected: Column) -> Column:
    """A JSON list of the expected length; else as many plain numbers, cut to 0 to 1; else null."""
    listed = F.from_json(content, "array<double>", {"mode": "PERMISSIVE"})
    exact = (F.size(listed) == expected) & F.forall(listed, lambda x: x.isNotNull())
    found = F.regexp_extract_all(content, F.lit(r"[0-9]+\.?[0-9]*"), F.lit(0))
    cut = F.transform(found, lambda x: F.least(F.greatest(x.cast("double"), F.lit(0.0)), F.lit(1.0)))
    return F.when(exact, listed).when(F.size(found) == expected, cut)


def sanitised(item: Column, keys: list[str]) -> Column:
    """The JSON object with lists and objects under keys as JSON text; other values and texts stay."""

    def one(text: str | None) -> str | None:
        try:
            row = json.loads(text or "")
        except ValueError:
            return text
        if isinstance(row, dict):
            row |= {k: json.dumps(row[k], ensure_ascii=False) for k in keys if isinstance(row.get(k), dict | list)}
        return json.dumps(row, ensure_ascii=False)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(one)

    return run(item)


#: signs of a diagram's own syntax, which its labels may not hold: fixed values
LABEL_SIGNS = "(){}|<>\""
_BARE = str.maketrans("", "", LABEL_SIGNS)
_ARROW = re.compile(r"<?-[-.]+>?")
_SAID = re.compile(r"--[ \t]+(?P<label>[^-\s>][^>\n]*?)[ \t]*-->")


def _shape_end(line: str, at: int) -> int:
    """Where the bracket that opens at a place closes: brackets inside a node's label nest or stand alone."""
    depth = 0
    for k in range(at, len(line)):
        depth += (line[k] == "[") - (line[k] == "]")
        if not depth:
            return k
    return -1


def _label_line(line: str) -> str:
    """One line of a diagram, read from left to right: arrows with labels, nodes in brackets, all else as it is."""
    out, at = [], 0
    while at < len(line):
        said = _SAID.match(line, at)
        arrow = _ARROW.match(line, at)
        if said:  # a label between two halves of an arrow goes behind it
            out.append(f"-->|{said['label'].translate(_BARE)}|")
            at = said.end()
        elif arrow:
            out.append(arrow[0])
            at = arrow.end()
            close = line.find("|", at + 1) if line[at : at + 1] == "|" else -1
            if close > at + 1:
                out.append(f"|{line[at + 1 : close].translate(_BARE)}|")
                at = close + 1
        elif line[at] == "[" and (end := _shape_end(line, at)) > at + 1:
            out.append(f"[{line[at + 1 : end].replace('[', '').replace(']', '').translate(_BARE)}]")
            at = end + 1
        else:
            out.append(line[at])
            at += 1
    return "".join(out)


def mermaid_cleaned(diagram: Column) -> Column:
    """A diagram whose labels hold no sign of the diagram's own syntax, without link styles.

    A line is scanned once.  A round node keeps its outer signs, as they stand outside of the
    brackets; a link style leaves an empty line.
    """

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        return "\n".join("" if line.split()[:1] == ["linkStyle"] and len(line.split()) > 1 else _label_line(line) for line in text.split("\n"))

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(one)

    return run(diagram)


# entities ------------------------------------------------------------------------------------------------


def flat_entities(entities: Column) -> Column:
    """The values of the lists of a JSON object, in its order; null and empty ones are left out."""
    lists = F.transform(F.map_values(F.from_json(entities, "map<string, string>")), lambda v: F.when(F.startswith(v, F.lit("[")), F.from_json(v, "array<string>")))
    return F.filter(F.flatten(F.filter(lists, lambda x: x.isNotNull())), lambda v: v.isNotNull() & (v != ""))


def entity_keys(chunks: DataFrame, doc_col: str, order_col: str, *list_cols: str) -> DataFrame:
    """(doc, pos, key): a document's entities in order, once each whatever their case, as first written."""
    def listed(field: int, name: str) -> Column:
        return F.transform(name, lambda v, i: F.struct(F.lit(field).alias("field"), i.alias("at"), F.btrim(v, F.lit(BLANK)).alias("key")))

    values = [listed(k, c) for k, c in enumerate(list_cols)]
    rows = chunks.select(doc_col, order_col, F.explode(F.concat(*values)).alias("v")).where("v.key <> ''")
    first = rows.groupBy(doc_col, F.lower("v.key").alias("_low")).agg(F.min(F.struct(order_col, "v.field", "v.at", "v.key")).alias("f"))
    return first.select(doc_col, F.row_number().over(Window.partitionBy(doc_col).orderBy("f")).alias("pos"), F.col("f.key").alias("key"))


def granted(permissions: Column, changes: dict[str, bool]) -> Column:
    """Permissions with some set anew, the others as they were."""
    new = F.create_map(*[F.lit(x) for pair in changes.items() for x in pair])
    return F.map_concat(F.map_filter(permissions, lambda k, v: ~k.isin(*changes)), new)


# names and windows ----------------------------------------------------------------------------------------


def top_heading(path: Column) -> Column:
    return F.split_part(path, F.lit(" > "), F.lit(1))


def title_from_path(path: Column) -> Column:
    return F.replace(F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), F.lit(r"\.md$"), F.lit("")), F.lit("-"), F.lit(" "))


def parent_window(parent: Column, content: Column, most: int) -> Column:
    """As much of a section as fits, from a third of that before the chunk's first 100 characters on."""
    at = F.instr(parent, F.left(content, F.lit(100)))
    cut = F.substr(parent, F.when(at > 0, F.greatest(F.lit(1), at - most // 3)).otherwise(1), F.lit(most))
    return F.when(F.length(parent) <= most, parent).otherwise(F.concat(cut, F.lit("\n...")))


def slug(text: Column) -> Column:
    """Letters and digits of the decomposed text, lower-cased, joined by dashes; ``product`` if nothing is left."""

    @F.pandas_udf("string")
    def decomposed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii")

    plain = F.btrim(F.regexp_replace(F.lower(decomposed(text)), F.lit("[^a-z0-9]+"), F.lit("-")), F.lit("-"))
    return F.coalesce(F.nullif(plain, F.lit("")), F.lit("product"))


def minute_of(iso: Column) -> Column:
    """An ISO date to the minute, in its own zone; anything else as it is."""
    return F.when(iso.isNull(), "").when(iso.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:\d\d)?$"), F.concat(F.left(iso, F.lit(10)), F.lit(" "), F.substring(iso, 12, 5))).otherwise(iso)


def unit_vector(v: Column) -> Column:
    """Divided by its length; a zero vector stays."""
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.when(size == 0, 1.0).otherwise(size))


def hmac_sha256(secret: str, message: Column) -> Column:
    """Of a secret of at most 64 bytes, in hexadecimal; plain SHA-256 without one."""
    if not secret:
        return F.sha2(message, 256)
    key = secret.encode().ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in key) for pad in (0x36, 0x5C))
    digest = F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(outer), digest), 256)


def language(text: Column) -> Column:
    """en, ru or other by script and frequent words of the first 3000 characters; short texts are other."""
    sample = F.lower(F.left(text, F.lit(3000)))
    letters = F.regexp_count(sample, F.lit(r"[a-z\u0430-\u044f\u0451]"))
    russian = F.regexp_count(sample, F.lit("[\u0430-\u044f\u0451]"))
    words = F.regexp_count(sample, F.lit("[a-z]+"))
    common = F.regexp_count(sample, F.lit(r"\b(?:the|and|of|to|is|that|with|for|was|from)\b"))
    long = F.length(F.btrim(text, F.lit(BLANK))) >= 50
    return F.when(~F.coalesce(long, F.lit(False)), "other").when(2 * russian > letters, "ru").when(20 * common > words, "en").otherwise("other")


def link_extension(url: Column) -> Column:
    path = F.regexp_replace(F.regexp_replace(url, F.lit(r"[?#].*$"), F.lit("")), F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*"), F.lit(""))
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]*)$", 1))


def is_download(url: Column) -> Column:
    ext = link_extension(url)
    name = F.lower(F.regexp_extract(F.regexp_replace(url, F.lit(r"[?#].*$"), F.lit("")), r"([^/]*)$", 1))
    holds = lambda words: name.rlike("|".join(map(re.escape, words)))
    return ext.isin(DOWNLOADS) | ((ext == ".json") & holds(JSON_NAMES)) | ((ext == ".xml") & holds(XML_NAMES))


def has_code(content: Column, parent: Column, code_language: str) -> Column:
    """Whether a chunk or its section shows code of a language."""
    text = F.concat(F.coalesce(content, F.lit("")), F.coalesce(parent, F.lit("")))
    out = F.lit(False)
    for mark in CODE_MARKS.get(code_language.lower(), [f"```{code_language.lower()}"]):
        out = out | F.contains(text, F.lit(mark))
    return out


# queries --------------------------------------------------------------------------------------------------


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return dealt(spark, sf_dir, "part")


def q_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 6
    item = F.format_string('{"doc_type":"%s","entities":{"keywords":["%s","","%d"],"protocols":"none","other":["x"]}}', F.when(k == 1, "novel").otherwise("protocol"), "p_brand", "p_size")
    raw = F.when(k == 0, F.concat(F.lit("  ["), item, F.lit(', "text"]\n'))).when(k == 1, F.concat(F.lit("```json\n["), item, F.lit("]\n```"))).when(k == 2, F.concat(F.lit("```\n"), item, F.lit("\n```")))
    raw = raw.when(k == 3, F.concat(F.lit("Here: "), item)).when(k == 4, F.concat(F.lit("["), item)).otherwise("```")
    rows = _parts(spark, sf_dir).select("p_partkey", F.posexplode(metadata(raw, F.lit(2))).alias("pos", "m"))
    return rows.select("p_partkey", "pos", "m.doc_type", F.array_join("m.keywords", "|").alias("keywords"), F.size("m.protocols").cast("long").alias("n_protocols"))


METADATA_SQL = """
SELECT p_partkey, pos, CASE WHEN pos = 0 AND p_partkey % 6 IN (0, 2) THEN 'protocol' ELSE 'other' END AS doc_type,
  CASE WHEN pos = 0 AND p_partkey % 6 IN (0, 1, 2) THEN p_brand || '|' || p_size ELSE '' END AS keywords, 0 AS n_protocols
FROM part CROSS JOIN (SELECT unnest([0, 1]) AS pos) n"""


def q_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey") % 4, F.col("p_size")
    text = F.when(k == 0, F.format_string("[%d, 0.5]", size)).when(k == 1, F.format_string("first 0.%d second %d.5", size, size)).when(k == 2, F.format_string("[%d]", size)).otherwise("[0.25, true]")
    return _parts(spark, sf_dir).select("p_partkey", F.array_join(F.transform(scores(text, F.lit(2)), lambda x: F.format_string("%.4f", x)), " ").alias("scores"))


SCORES_SQL = """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN printf('%.4f 0.5000', CAST(p_size AS DOUBLE)) WHEN 1 THEN printf('%.4f %.4f', CAST('0.' || p_size AS DOUBLE), least(p_size + 0.5e0, 1e0)) END AS scores FROM part"""


def q_sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    item = F.format_string('{"name":"%s","notes":%s,"rest":[1]}', "p_brand", F.when(k == 0, F.format_string('{"a":[%d,"\u00e9"]}', "p_size")).when(k == 1, F.format_string("%d", "p_size")).otherwise("null"))
    return _parts(spark, sf_dir).select("p_partkey", sanitised(F.when(F.col("p_size") == 1, "not json").otherwise(item), ["name", "notes"]).alias("item"))


SANITISED_SQL = r"""
SELECT p_partkey, CASE WHEN p_size = 1 THEN 'not json' ELSE '{"name": "' || p_brand || '", "notes": ' || CASE p_partkey % 3
  WHEN 0 THEN '"{\"a\": [' || p_size || ', \"é\"]}"' WHEN 1 THEN CAST(p_size AS VARCHAR) ELSE 'null' END || ', "rest": [1]}' END AS item FROM part"""


def q_mermaid(spark: SparkSession, sf_dir: str) -> DataFrame:
    diagram = F.format_string('graph TD\n  A[%s (x)] -->|"call" {%d}| B([store <%d>])\n  linkStyle 0 stroke:red\n  B -- go (%s) --> C[end]', "p_brand", "p_size", "p_size", "p_brand")
    return _parts(spark, sf_dir).select("p_partkey", mermaid_cleaned(diagram).alias("diagram"))


MERMAID_SQL = """
SELECT p_partkey, replace('graph TD~  A[' || p_brand || ' x] -->|call ' || p_size || '| B([store ' || p_size || '])~~  B -->|go ' || p_brand || '| C[end]', '~', chr(10)) AS diagram FROM part"""


def _entities() -> Column:
    return F.format_string('{"keywords":["%s","","%s"],"note":"text","protocols":["%s"],"empty":[]}', "p_brand", "p_type", F.get(F.split("p_name", " "), 0))


def q_entity_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = flat_entities(_entities())
    return _parts(spark, sf_dir).select("p_partkey", F.concat(F.lit(" "), F.array_join(flat, " ")).alias("entity_text"), F.concat(F.lit("Entities: "), F.array_join(F.slice(flat, 1, 2), ", ")).alias("entity_line"))


ENTITY_TEXT_SQL = """
SELECT p_partkey, ' ' || p_brand || ' ' || p_type || ' ' || split_part(p_name, ' ', 1) AS entity_text, 'Entities: ' || p_brand || ', ' || p_type AS entity_line FROM part"""


def q_entity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    chunks = _parts(spark, sf_dir).select("p_size", "p_partkey", F.split(name, " ").alias("keywords"), F.array(F.concat(F.lit(" "), F.lower("p_brand"))).alias("protocols"))
    return entity_keys(chunks, "p_size", "p_partkey", "keywords", "protocols")


ENTITY_KEYS_SQL = """
WITH v AS (
  SELECT p_size, p_partkey, 0 AS f, unnest(string_split(CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END, ' ')) AS key, generate_subscripts(string_split(p_name, ' '), 1) AS nth FROM part
  UNION ALL SELECT p_size, p_partkey, 1, lower(p_brand), 1 FROM part
), r AS (SELECT *, row_number() OVER (PARTITION BY p_size, lower(key) ORDER BY p_partkey, f, nth) AS rn FROM v WHERE key <> '')
SELECT p_size, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey, f, nth) AS pos, key FROM r WHERE rn = 1"""


def q_granted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    had = F.create_map(F.lit("documents.upload"), F.col("c_acctbal") > 0, F.lit("debug"), F.col("c_nationkey") % 2 == 0)
    now = granted(had, {"debug": True, "lifecycle.run": True})
    listed = F.array_sort(F.transform(F.map_entries(now), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))
    return rows.select("c_custkey", F.array_join(listed, ",").alias("permissions"))


GRANTED_SQL = "SELECT c_custkey, 'debug=true,documents.upload=' || CASE WHEN c_acctbal > 0 THEN 'true' ELSE 'false' END || ',lifecycle.run=true' AS permissions FROM customer"


def q_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.format_string("docs/%s/%s-part-%d.md", "p_brand", F.lower("p_type"), "p_size")
    heading = F.concat_ws(" > ", "p_type", "p_brand", F.when(F.col("p_size") > 20, F.col("p_name")))
    meta = F.format_string("[%d] %s | %d | %s > %s%s", "p_partkey", "p_type", "p_size", "p_brand", "p_name", F.when(F.col("p_size") % 2 == 0, " [protocol]").otherwise(""))
    level = F.concat(F.repeat(F.lit("  "), (F.col("p_size") % 4).cast("int")), F.lit("- "), F.col("p_name"))
    return _parts(spark, sf_dir).select("p_partkey", title_from_path(path).alias("title"), top_heading(heading).alias("top"), meta.alias("meta"), level.alias("outline"))


NAMES_SQL = """
SELECT p_partkey, replace(lower(p_type), '-', ' ') || ' part ' || p_size AS title, p_type AS top,
  '[' || p_partkey || '] ' || p_type || ' | ' || p_size || ' | ' || p_brand || ' > ' || p_name || CASE WHEN p_size % 2 = 0 THEN ' [protocol]' ELSE '' END AS meta,
  repeat('  ', p_size % 4) || '- ' || p_name AS outline FROM part"""


def q_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window of a document around a piece of it, and around a piece that it doesn't hold."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text", F.when(F.col("doc_id") % 5 == 0, "\u0001").otherwise(F.substr("text", F.col("n_chars") / 2 + 1, F.lit(400))).alias("piece"))
    return docs.select("doc_id", F.sha2(parent_window(F.col("text"), F.col("piece"), 900), 256).alias("window_sha256"))


WINDOWS_SQL = """
SELECT doc_id, sha256(CASE WHEN length(text) <= 900 THEN text WHEN pos > 0 THEN substr(text, greatest(1, pos - 300), 900) || chr(10) || '...' ELSE substr(text, 1, 900) || chr(10) || '...' END) AS window_sha256
FROM (SELECT doc_id, text, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE strpos(text, substr(text, CAST(floor(n_chars / 2 + 1) AS BIGINT), 100)) END AS pos FROM documents WHERE text IS NOT NULL) d"""


def q_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return table(spark, sf_dir, "documents").select("doc_id", slug(F.concat_ws(" ", F.left("text", F.lit(60)), "source", F.lit("\u2122"))).alias("slug"), slug(F.lit(" \u4e2d ")).alias("default_slug"))


SLUGS_SQL = r"""
SELECT doc_id, trim(regexp_replace(lower(regexp_replace(strip_accents(concat_ws(' ', left(text, 60), source, 'TM')), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '-') AS slug, 'product' AS default_slug FROM documents"""


def q_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("ts").cast("timestamp_ntz")
    k = F.col("event_id") % 4
    iso = F.when(k == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'+02:00'")).when(k == 2, F.lit("soon"))
    return table(spark, sf_dir, "events").select("event_id", minute_of(iso).alias("shown"))


MINUTES_SQL = "SELECT event_id, CASE event_id % 4 WHEN 2 THEN 'soon' WHEN 3 THEN '' ELSE strftime(ts, '%Y-%m-%d %H:%M') END AS shown FROM events"


def q_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("vec_id") % 7 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", unit_vector(v).alias("u"))
    return rows.select("vec_id", F.round(F.get("u", 0), 6).alias("first"), F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x), 6).alias("size"))


UNITS_SQL = """
SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 0 ELSE round(CAST(embedding[1] AS DOUBLE) / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) END AS first,
  CASE WHEN vec_id % 7 = 0 THEN 0e0 ELSE 1e0 END AS size FROM embeddings"""


def q_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", hmac_sha256("secret", F.col("c_name")).alias("keyed"), hmac_sha256("", F.col("c_name")).alias("plain"))


_PADS = ["".join(f"{b ^ pad:02x}" for b in b"secret".ljust(64, b"\0")) for pad in (0x36, 0x5C)]
KEYS_SQL = f"SELECT c_custkey, sha256(unhex('{_PADS[1]}' || sha256(unhex('{_PADS[0]}' || hex(encode(c_name)))))) AS keyed, sha256(c_name) AS plain FROM customer"


def q_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("\u041d\u0430\u0441\u0442\u0440\u043e\u0439\u043a\u0430 \u0443\u0441\u0442\u0440\u043e\u0439\u0441\u0442\u0432\u0430 \u0438 \u043f\u0440\u043e\u0442\u043e\u043a\u043e\u043b\u0430 \u043e\u0431\u043c\u0435\u043d\u0430 \u0434\u0430\u043d\u043d\u044b\u043c\u0438 "), F.left("text", F.lit(20)))).otherwise(F.col("text")).alias("text"))
    return docs.select("doc_id", language(F.col("text")).alias("lang"))


LANGUAGE_SQL = r"""
SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'ru' WHEN text IS NULL OR length(trim(text, E' \t\r\n')) < 50 THEN 'other'
  WHEN 20 * len(regexp_extract_all(s, '\b(?:the|and|of|to|is|that|with|for|was|from)\b')) > len(regexp_extract_all(s, '[a-z]+')) THEN 'en' ELSE 'other' END AS lang
FROM (SELECT doc_id, text, lower(left(text, 3000)) AS s FROM documents) d"""


def q_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = ["/a.PDF?x=1", "/v1/openapi.json", "/data.json", "/types.xml#top", "/feed.xml", "/.hidden", "/x.tar.gz", "", "/spec.d/readme"]
    url = F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.get(F.array(*map(F.lit, ends)), (F.col("page_id") % len(ends)).cast("int")))
    ext = link_extension(url)
    kind = F.lit("markdown")
    for known, name in LINK_FORMATS.items():
        kind = F.when(ext == known, name).otherwise(kind)
    return table(spark, sf_dir, "pages").where("url LIKE '%://%/%' AND url NOT LIKE '%.%.%/%.%'").select("page_id", ext.alias("extension"), is_download(url).alias("download"), kind.alias("format"))


LINKS_SQL = """
SELECT page_id, coalesce(['.pdf', '.json', '.json', '.xml', '.xml', '', '.gz', CASE WHEN regexp_matches(p, '/[^/.][^/]*[.][^./]*$') THEN lower(regexp_extract(p, '([.][^./]*)$', 1)) ELSE '' END, ''][page_id % 9 + 1], '') AS extension,
  page_id % 9 IN (0, 1, 3) OR (page_id % 9 = 7 AND regexp_matches(lower(p), '/[^/.][^/]*[.](pdf|wsdl|yaml|yml|proto|md|txt)$')) AS download,
  CASE WHEN page_id % 9 = 0 OR (page_id % 9 = 7 AND regexp_matches(lower(p), '[.]pdf$')) THEN 'pdf' WHEN page_id % 9 IN (1, 2) OR (page_id % 9 = 7 AND regexp_matches(lower(p), '[.](yaml|yml|json)$')) THEN 'swagger' ELSE 'markdown' END AS format
FROM (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', '') AS p FROM pages WHERE url LIKE '%://%/%' AND url NOT LIKE '%.%.%/%.%') x"""


def q_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    shown = F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit("\n```py\nx = 1\n```"))).when(F.col("turn") % 3 == 1, F.concat("text", F.lit("\n```rust\nfn main() {}\n```"))).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", "role", *[has_code(shown, F.col("role"), x).alias(x) for x in ("python", "rust", "cpp")])


CODE_SQL = f"""
SELECT conv_id, turn, role, turn % 3 = 0 OR {" OR ".join(f"contains(coalesce(text, '') || coalesce(role, ''), {quoted(m)})" for m in CODE_MARKS["python"])} AS python,
  turn % 3 = 1 OR contains(coalesce(text, ''), '```rust') AS rust, {" OR ".join(f"contains(coalesce(text, ''), {quoted(m)})" for m in CODE_MARKS["cpp"])} AS cpp FROM conversations"""

_ALL = {
    "metadata_parse": (q_metadata, METADATA_SQL),
    "score_list_parse": (q_scores, SCORES_SQL),
    "sanitised_fields": (q_sanitised, SANITISED_SQL),
    "mermaid_labels": (q_mermaid, MERMAID_SQL),
    "entity_text": (q_entity_text, ENTITY_TEXT_SQL),
    "entity_keys": (q_entity_keys, ENTITY_KEYS_SQL),
    "permission_upkeep": (q_granted, GRANTED_SQL),
    "names_and_headings": (q_names, NAMES_SQL),
    "parent_windows": (q_windows, WINDOWS_SQL),
    "name_slugs": (q_slugs, SLUGS_SQL),
    "iso_minutes": (q_minutes, MINUTES_SQL),
    "unit_vectors": (q_units, UNITS_SQL),
    "api_key_hashes": (q_keys, KEYS_SQL),
    "language_guess": (q_language, LANGUAGE_SQL),
    "link_kinds": (q_links, LINKS_SQL),
    "code_language_filter": (q_code, CODE_SQL),
}
QUERIES = {k: q for k, (q, _) in _ALL.items()}
ORACLES = {k: s for k, (_, s) in _ALL.items()}
