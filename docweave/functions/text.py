"""Text rules as expressions that read the same in Spark and in the oracle.

A rule is a pattern and its replacement ($1 for a group).  ``Rules`` renders a list
of them as nested replacements for either engine, so that one list is both the
query and what it is compared with.  Patterns keep to what both regular-expression
engines know: no look-around, explicit letter classes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.tables import table

Rules = list[tuple[str, str]]

#: Markdown marks and what remains of them: fixed values, in this order
INLINE: Rules = [
    (r"!\[([^\]]*)\]\([^)]+\)", ""),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"<(https?://[^>]+)>", "$1"),
    (r"```([^`\n]+)```", "$1"),
    (r"``([^`\n]+)``|`([^`\n]+)`", "$1$2"),
    (r"\*{1,3}([^\n*]+?)\*{1,3}", "$1"),
    (r"_{1,3}([^\n_]+?)_{1,3}", "$1"),
    (r"~~([^\n~]+?)~~", "$1"),
    (r"</?[a-zA-Z][^>]*>", ""),
]
#: the same for whole sections outside fenced code: fixed values
BODY: Rules = [
    *INLINE[:3],
    (r"(^|[^(])https?://[^ \t\r\n\f]+", "$1"),
    INLINE[8],
    *INLINE[4:8],
    (r"(?m)^#{1,6}[ \t\r\n\f]+", ""),
    (r"(?m)^>[ \t\r\n\f]?", ""),
    (r"(?m)^([\t ]*)(?:[-*+]|[0-9]+\.)[ \t\r\n\f]", "$1"),
]
SPACING: Rules = [(r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " ")]
#: signs of an answer that found nothing: fixed values
NO_ANSWER = [
    r"не[ \t\r\n]+(удалось|смог|нашёл|нашла|могу)[ \t\r\n]+(найти|обнаружить)",
    r"нет[ \t\r\n]+(информации|данных|сведений)",
    r"в[ \t\r\n]+(предоставленн|доступн)[\p{L}\p{N}_]+[ \t\r\n]+(документ|контекст|данн)",
    r"i[ \t\r\n]+(don.t|couldn.t|wasn.t able to)[ \t\r\n]+find",
    r"no[ \t\r\n]+(information|data|relevant)[ \t\r\n]+(found|available)",
    r"not[ \t\r\n]+found[ \t\r\n]+in[ \t\r\n]+the[ \t\r\n]+(provided|available)",
]
#: characters on which a finished answer may end: fixed values
ENDING = r"""[.!?,;:)\]>|`"'’”*#—–-][ \t\r\n]*$"""
#: what looks like an endpoint in a text: fixed values
ENDPOINT = r"""(?i)(?:GET|POST|PUT|PATCH|DELETE|OPTIONS|HEAD)[ \t\r\n]+/[^ \t\r\n,;)"']+|/[a-zA-Z0-9][a-zA-Z0-9_/{}.:=-]+"""
ENDPOINT_FORM: Rules = [
    (r"^[A-Za-z]+[ \t\r\n]+", ""),
    (r"\?.*$", ""),
    (r"/+$", ""),
    (r"\{[^}]+\}", "{id}"),
    (r"/[0-9]+(/|$)", "/{id}$1"),
    (r"/[0-9]+(/|$)", "/{id}$1"),  # neighbours share a slash, so every second number is left
]
#: words that speak for a protocol, and for a vendor: fixed values
PROTOCOL_WORDS = [
    "cgi", "onvif", "rtsp", "sip", "isapi", "modbus", "bacnet", "opc", "mqtt", "snmp", "psia", "gb/t", "gb28181", "wsdl", "soap",
    "common gateway interface", "generic", "protocol specification",
]
VENDOR_WORDS = ["api key", "api_key", "sdk", "cloud", "saas", "platform", "dashboard"]


def replaced(text: Column, rules: Rules) -> Column:
    for pattern, put in rules:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(put.replace("{", r"\{")))
    return text


def duck(text: str, rules: Rules) -> str:
    """The same replacements in the oracle's words."""
    for pattern, put in rules:
        put = re.sub(r"\$(\d)", r"\\\1", put)
        text = f"regexp_replace({text}, {quoted(pattern)}, {quoted(put)}, 'g')"
    return text


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value): what ``then`` names several times is formed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def any_of(text: Column, patterns: list[str]) -> Column:
    return text.rlike("(?iu)" + "|".join(f"(?:{p})" for p in patterns))


def clean_heading(text: Column) -> Column:
    """A heading as plain text."""
    return F.btrim(replaced(text, INLINE), F.lit(" \t\r\n"))


def clean_body(text: Column) -> Column:
    """Markdown without marks; fenced code, also unclosed, stays as it is."""
    parts = F.split(F.regexp_replace(text, F.lit(r"```([^`\n]+)```"), F.lit("$1")), "```", -1)
    last = F.size(parts) - 1
    kept = F.transform(parts, lambda x, i: F.when(i % 2 == 1, F.concat(F.lit("```"), x, F.when(i < last, "```").otherwise(""))).otherwise(replaced(x, BODY)))
    return F.btrim(replaced(F.array_join(kept, ""), SPACING), F.lit(" \t\r\n"))


def endpoints(text: Column) -> Column:
    """Normalised endpoints of a text, sorted, once each."""
    found = F.regexp_extract_all(text, F.lit(ENDPOINT), F.lit(0))
    forms = F.transform(found, lambda x: F.lower(replaced(x, ENDPOINT_FORM)))
    return F.array_sort(F.array_distinct(F.filter(forms, lambda x: F.length(x) > 1)))


def front_matter(text: Column, *keys: str) -> list[Column]:
    """The body, and the value of each key of a leading block between lines of three dashes (null where it is missing)."""
    block = F.regexp_extract(text, r"(?s)\A---[ \t]*\n(.*?\n)---[ \t]*(?:\n|\z)", 1)
    body = F.regexp_replace(text, F.lit(r"(?s)\A---[ \t]*\n.*?\n---[ \t]*(?:\n|\z)"), F.lit(""))
    return [body.alias("body")] + [F.nullif(F.regexp_extract(block, rf"""(?m)^{k}:[ \t]*["']?(.*?)["']?[ \t]*$""", 1), F.lit("")).alias(k) for k in keys]


def titled(heading_path: Column, title: Column, layer: Column, topic: Column) -> Column:
    """Generic headings replaced by the title, then headed by ``[layer] topic`` if there is one."""
    generic = heading_path.isin("Document", "Preamble")
    prefix = F.nullif(F.concat_ws(" ", F.concat(F.lit("["), layer, F.lit("]")), topic), F.lit(""))
    plain = F.when(heading_path == "Document", title).when(heading_path == "Preamble", F.concat(title, F.lit(" > Preamble"))).otherwise(heading_path)
    return F.when(prefix.isNull(), plain).when(generic, prefix).otherwise(F.concat_ws(" > ", prefix, heading_path))


def words_estimate(text: Column) -> Column:
    n = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.greatest(F.lit(1), F.floor(n * F.lit(1.3)).cast("int"))


def enriched(content: Column, heading_path: Column, doc_type: Column, entities: Column, most: int = 768, most_entities: int = 20) -> Column:
    """What is embedded: heading, type and entities in brackets, then the cleaned text, cut at the model's budget."""
    kind = F.when(doc_type.isNotNull() & (doc_type != "other"), F.concat(F.lit("[type: "), doc_type, F.lit("]")))
    named = F.slice(F.filter(entities, lambda e: e != ""), 1, most_entities)
    names = F.when(F.size(named) > 0, F.concat(F.lit("[entities: "), F.array_join(named, ", "), F.lit("]")))
    path = F.when(heading_path != "", F.concat(F.lit("["), heading_path, F.lit("]")))
    prefix = F.concat_ws("\n", path, kind, names)
    head = F.when(prefix != "", F.concat(prefix, F.lit("\n"))).otherwise("")
    cleaned = clean_body(content)
    whole = F.concat(head, cleaned)
    room = F.greatest(F.lit(1), F.floor((F.lit(most) - F.when(head != "", words_estimate(head)).otherwise(0)) / F.lit(1.3)).cast("int"))
    cut = F.concat(head, F.array_join(F.slice(F.filter(F.split(cleaned, r"\s+"), lambda w: w != ""), F.lit(1), room), " "))
    return F.when(words_estimate(whole) > most, cut).otherwise(whole)


def nfkc(text: Column) -> Column:
    """Compatibility-composed Unicode, which Spark has no function for."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.str.normalize("NFKC")

    return run(text)


def human_size(n: Column) -> Column:
    """Bytes in the largest unit that leaves one or more, rounded down to a tenth."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate(["KB", "MB", "GB", "TB"], 1):
        out = F.when(n >= 1024**k, F.format_string(f"%.1f {unit}", F.floor(n * 10 / F.lit(float(1024**k))) / 10)).otherwise(out)
    return out


def q_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(clean_body(text), 256).alias("body_sha256"), F.sha2(clean_heading(text), 256).alias("heading_sha256"))


_TRIMMED = "rtrim(ltrim({}, E' \\t\\r\\n'), E' \\t\\r\\n')"
_DUCK_BODY = f"""array_to_string(list_transform(parts, lambda x, i: CASE WHEN i % 2 = 0 THEN '```' || x || CASE WHEN i < len(parts) THEN '```' ELSE '' END ELSE {duck("x", BODY)} END), '')"""
CLEAN_SQL = f"""
SELECT doc_id, sha256({_TRIMMED.format(duck(_DUCK_BODY, SPACING))}) AS body_sha256, sha256({_TRIMMED.format(duck("text", INLINE))}) AS heading_sha256
FROM (SELECT doc_id, text, string_split({duck("text", [INLINE[3]])}, '```') AS parts FROM documents) d"""


def q_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = endpoints(F.concat_ws(" ", "html", "url"))
    return table(spark, sf_dir, "pages").select("page_id", F.size(found).cast("long").alias("n"), F.array_join(found, "|").alias("endpoints"))


ENDPOINTS_SQL = f"""
SELECT page_id, len(e) AS n, array_to_string(e, '|') AS endpoints FROM (
  SELECT page_id, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(concat_ws(' ', html, url), {quoted(ENDPOINT)}), lambda x: lower({duck("x", ENDPOINT_FORM)})), lambda x: length(x) > 1))) AS e FROM pages) p"""


def q_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that found nothing, and answers cut off: an open fence, or no closing sign in 60 characters and more."""
    body = F.regexp_replace("text", r"[ \t\r\n]+$", "")
    open_fence = (F.size(F.split(body, "```", -1)) - 1) % 2 == 1
    cut = (F.length("text") >= 60) & (body != "") & (open_fence | ~body.rlike(ENDING))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", any_of(F.substring("text", 1, 500), NO_ANSWER).alias("no_answer"), cut.alias("incomplete"))


def q_no_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By role, how many texts say that nothing was found."""
    found = any_of(F.substring("text", 1, 500), NO_ANSWER)
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_if(found).alias("no_answer"))


NO_ANSWER_SQL = f"""
SELECT role, count(*) AS n, count(*) FILTER (WHERE regexp_matches(substr(text, 1, 500), {quoted("(?i)" + "|".join(f"(?:{p})" for p in NO_ANSWER))})) AS no_answer FROM conversations GROUP BY role"""


ANSWERS_SQL = f"""
SELECT conv_id, turn, regexp_matches(substr(text, 1, 500), {quoted("(?i)" + "|".join(f"(?:{p})" for p in NO_ANSWER))}) AS no_answer,
  length(text) >= 60 AND body <> '' AND ((len(string_split(body, '```')) - 1) % 2 = 1 OR NOT regexp_matches(body, {quoted(ENDING)})) AS incomplete
FROM (SELECT conv_id, turn, text, regexp_replace(text, '[ \\t\\r\\n]+$', '') AS body FROM conversations) c"""


#: chunks that the scope is read from; a document's lines are its chunks here
SCOPE_CHUNKS = 20


def _signals(words: list[str]) -> Column:
    head = F.lower(F.array_join(F.slice(F.split("text", "\n"), 1, SCOPE_CHUNKS), " "))
    return sum((F.contains(head, F.lit(w)).cast("long") for w in words), F.lit(0).cast("long"))


def q_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text describes a protocol or one vendor's product, by words in its source's name and in its first chunks."""
    named = F.coalesce(F.lower("source").rlike("|".join(re.escape(w) for w in PROTOCOL_WORDS)), F.lit(False))
    scope = F.when(named | ((F.col("p") >= 3) & (F.col("v") < 2)), "industry_protocol").when(F.col("v") >= 2, "vendor_specific").otherwise("unknown")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", _signals(PROTOCOL_WORDS).alias("p"), _signals(VENDOR_WORDS).alias("v"))
    return docs.select("doc_id", F.col("p").alias("protocol_words"), F.col("v").alias("vendor_words"), scope.alias("scope"))


def _duck_signals(words: list[str]) -> str:
    return " + ".join(f"CAST(contains(head, {quoted(w)}) AS BIGINT)" for w in words)


SCOPE_SQL = f"""
SELECT doc_id, p AS protocol_words, v AS vendor_words, CASE
  WHEN {" OR ".join(f"coalesce(contains(lower(source), {quoted(w)}), false)" for w in PROTOCOL_WORDS)} OR (p >= 3 AND v < 2) THEN 'industry_protocol'
  WHEN v >= 2 THEN 'vendor_specific' ELSE 'unknown' END AS scope
FROM (SELECT doc_id, source, {_duck_signals(PROTOCOL_WORDS)} AS p, {_duck_signals(VENDOR_WORDS)} AS v
  FROM (SELECT doc_id, source, lower(array_to_string((string_split(text, chr(10)))[1:{SCOPE_CHUNKS}], ' ')) AS head FROM documents) h) d"""


def q_nfkc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(nfkc(F.col("text")), 256).alias("nfkc_sha256"))


#: the test texts hold composed letters and no compatibility forms, for which both norms agree; a test has one
NFKC_SQL = "SELECT doc_id, sha256(nfc_normalize(text)) AS nfkc_sha256 FROM documents"


def q_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars") * F.col("doc_id") * 7
    return table(spark, sf_dir, "documents").select("doc_id", human_size(n).alias("size"), F.add_months(F.trunc(F.lit("2024-01-15").cast("date"), "MM"), (F.col("doc_id") % 24).cast("int")).alias("month"))


_N = "n_chars * doc_id * 7"
SIZES_SQL = f"""
SELECT doc_id, CASE {" ".join(f"WHEN {_N} >= {1024**k} THEN printf('%.1f {u}', floor({_N} * 10 / {float(1024**k)}) / 10)" for k, u in [(4, "TB"), (3, "GB"), (2, "MB"), (1, "KB")])} ELSE ({_N}) || ' B' END AS size,
  CAST(DATE '2024-01-01' + to_months(CAST(doc_id % 24 AS INTEGER)) AS DATE) AS month FROM documents"""

def q_headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with front matter, some of it broken: bodies, and headings under their title, layer and topic."""
    k = F.col("doc_id") % 4
    head = F.format_string('---\ntitle: "%s"\nlayer: api\n%s---\n', "source", F.when(k == 0, "topic: 'Start here'\n").otherwise(""))
    text = F.when(k < 2, F.concat(head, F.col("text"))).when(k == 2, F.concat(F.lit("---\nlayer: api\n"), F.col("text"))).otherwise(F.col("text"))
    body, *values = front_matter(text, "title", "layer", "topic")
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL AND text NOT LIKE '%---%'").select("doc_id", body, *values)
    path = F.when(F.col("doc_id") % 3 == 0, "Document").when(F.col("doc_id") % 3 == 1, "Preamble").otherwise("A > B")
    heading = titled(path, F.coalesce("title", F.lit("untitled")), F.col("layer"), F.col("topic"))
    return docs.select("doc_id", F.sha2("body", 256).alias("body_sha256"), heading.alias("heading"))


HEADED_SQL = """
SELECT doc_id, sha256(CASE doc_id % 4 WHEN 2 THEN '---' || chr(10) || 'layer: api' || chr(10) || text ELSE text END) AS body_sha256, CASE
  WHEN doc_id % 4 = 0 THEN '[api] Start here' || CASE WHEN doc_id % 3 = 2 THEN ' > A > B' ELSE '' END WHEN doc_id % 4 = 1 THEN '[api]' || CASE WHEN doc_id % 3 = 2 THEN ' > A > B' ELSE '' END
  WHEN doc_id % 3 = 0 THEN 'untitled' WHEN doc_id % 3 = 1 THEN 'untitled > Preamble' ELSE 'A > B' END AS heading FROM documents WHERE text IS NOT NULL AND text NOT LIKE '%---%'"""

QUERIES = {
    "front_matter_headings": q_headed,
    "no_answer_classifier": q_no_answer,
    "clean_markdown_rules": q_clean,
    "endpoint_extract": q_endpoints,
    "answer_flags": q_answers,
    "doc_scope": q_scope,
    "unicode_nfkc": q_nfkc,
    "sizes_and_months": q_sizes,
}
ORACLES = {"unicode_nfkc": NFKC_SQL, "front_matter_headings": HEADED_SQL, "no_answer_classifier": NO_ANSWER_SQL, "clean_markdown_rules": CLEAN_SQL, "endpoint_extract": ENDPOINTS_SQL, "answer_flags": ANSWERS_SQL, "doc_scope": SCOPE_SQL, "sizes_and_months": SIZES_SQL}
