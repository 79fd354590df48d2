"""From pages and texts to Markdown, sections and chunks.

HTML is reduced with built-in regular expressions.  Splitting Markdown into
sections and chunks is a fold over one document's lines, so it is one function per
document whose rows are exploded by position; the oracle folds with recursive queries.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.text import BODY, INLINE, SPACING, duck, enriched
from docweave.shipping import ship
from docweave.tables import table

#: chunk sizes in estimated tokens, and blocks repeated from the piece before: fixed values
MOST_TOKENS, LEAST_TOKENS, OVERLAP = 512, 50, 2
#: bytes of text that a worker cuts at a time, beyond those of the last text
PORTION = 1 << 20

_TAGS = [
    (r"(?is)<script\b.*?</script>|<style\b.*?</style>|<nav\b.*?</nav>|<footer\b.*?</footer>", ""),
    (r"(?s)<!--.*?-->", ""),
    *[(rf"(?is)<h{n}[^>]*>(.*?)</h{n}>", f"\n\n{'#' * n} $1\n\n") for n in range(1, 7)],
    (r"""(?is)<pre[^>]*>[ \t\r\n]*<code[^>]*class=["'][^"']*language-([a-z0-9+#]+)[^"']*["'][^>]*>(.*?)</code>[ \t\r\n]*</pre>""", "\n\n```$1\n$2\n```\n\n"),
    (r"(?is)<pre[^>]*>(?:[ \t\r\n]*<code[^>]*>)?(.*?)(?:</code>[ \t\r\n]*)?</pre>", "\n\n```\n$1\n```\n\n"),
    (r"(?is)<code[^>]*>(.*?)</code>", "`$1`"),
    (r"(?is)[ \t\r\n]*<t[hd](?:[ \t\r\n][^>]*)?>[ \t\r\n]*(.*?)[ \t\r\n]*</t[hd]>[ \t\r\n]*", "| $1 "),
    (r"(?i)[ \t\r\n]*</tr>[ \t\r\n]*", " |\n"),
    (r"(?i)<tr\b[^>]*>", ""),
    (r"(?is)<li[^>]*>(.*?)</li>", "\n- $1"),
    (r"""(?is)<a\b[^>]*href=["']([^"']*)["'][^>]*>(.*?)</a>""", "[$2]($1)"),
    (r"(?is)</?(b|strong)\b[^>]*>", "**"),
    (r"(?is)</?(i|em)\b[^>]*>", "*"),
    (r"(?i)<br[ \t\r\n]*/?>", "\n"),
    (r"(?i)</?(p|div|article|section|ul|ol|table|thead|tbody)\b[^>]*>", "\n\n"),
    (r"(?s)<[^>]+>", ""),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&nbsp;", " "),
    ("&amp;", "&"),
    (r"[ \t]+\n", "\n"),
    (r"\n{3,}", "\n\n"),
]


def html_to_markdown(html: Column) -> Column:
    """Without scripts, styles, navigation, footers and comments; at most one blank line in a row."""
    for pattern, put in _TAGS:
        html = F.regexp_replace(html, F.lit(pattern), F.lit(put))
    return F.btrim(html, F.lit(" \n\t"))


def estimated_tokens(text: str) -> int:
    words = len(text.split())
    return max(1, int(words * 1.3)) if words else 1


def sections(text: str) -> list[tuple[str, int, str]]:
    """(heading path, level, content) by headings outside fences; empty ones are left out."""
    out: list[tuple[str, int, str]] = []
    stack: list[tuple[int, str]] = []
    lines: list[str] = []
    path, level, fenced, any_heading = "Preamble", 0, False, False

    def close() -> None:
        if body := "\n".join(lines).strip():
            out.append((path, level, body))
        lines.clear()

    for line in text.split("\n"):
        fenced ^= line.lstrip().startswith(("```", "~~~"))
        m = None if fenced else re.match(r"(#{1,6})\s+(.+?)\s*$", line)
        if not m:
            lines.append(line)
            continue
        close()
        any_heading, level = True, len(m[1])
        stack = [s for s in stack if s[0] < level] + [(level, m[2])]
        path = " > ".join(name for _, name in stack)
    close()
    return out if any_heading else [("Document", 1, body) for _, _, body in out]


_BLOCK = re.compile(r"```.*?(?:```|\Z)|(?:^\|[^\n]*(?:\n|\Z))+", re.DOTALL | re.MULTILINE)


def blocks(text: str) -> list[str]:
    """Fenced code, tables and paragraphs, none of which is cut."""
    out: list[str] = []
    at = 0
    for m in _BLOCK.finditer(text):
        out += re.split(r"\n\s*\n", text[at : m.start()]) + [m[0]]
        at = m.end()
    out += re.split(r"\n\s*\n", text[at:])
    return [b.strip() for b in out if b.strip()]


def pieces(text: str, most: int = MOST_TOKENS) -> list[str]:
    """Blocks packed greedily; each piece but the first starts with the last blocks of the one before."""
    packed: list[list[str]] = []
    used = 0
    for block in blocks(text):
        cost = estimated_tokens(block)
        if not packed or used + cost > most:
            packed.append([])
            used = 0
        packed[-1].append(block)
        used += cost
    return ["\n\n".join((packed[i - 1][-OVERLAP:] if i else []) + own) for i, own in enumerate(packed)]


def parent_heading(path: str) -> str:
    first = path.split(" + ")[0]
    return first.rsplit(" > ", 1)[0]


Chunk = tuple[str, int, str, int, str | None]


def chunks(text: str, most: int = MOST_TOKENS, least: int = LEAST_TOKENS) -> list[Chunk]:
    """(heading path, level, content, tokens, parent content): large sections in parts, small neighbours merged."""
    out: list[Chunk] = []
    for path, level, body in sections(text):
        if estimated_tokens(body) <= most:
            out.append((path, level, body, estimated_tokens(body), None))
        else:
            parts = pieces(body, most)
            several = len(parts) > 1
            out += [(f"{path} (part {k})" if several else path, level, p, estimated_tokens(p), body if several else None) for k, p in enumerate(parts, 1)]
    merged: list[Chunk] = []
    for c in out:
        if merged and (b := merged[-1])[3] < least and parent_heading(b[0]) == parent_heading(c[0]) and b[3] + c[3] <= most:
            body = f"{b[2]}\n\n{c[2]}"
            merged[-1] = (b[0] if b[0] == c[0] else f"{b[0]} + {c[0]}", b[1], body, estimated_tokens(body), b[4] or c[4])
        else:
            merged.append(c)
    return merged


CHUNK = ("heading_path", "heading_level", "content", "token_count", "parent_content")


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches (id, text) in portions of about ``PORTION`` bytes of text, so that a worker holds no more of them as Python objects."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(size) - size) // PORTION
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for a, b in itertools.pairwise(cuts):
            yield batch.slice(a, b - a)


def chunked(df: DataFrame, id_col: str, markdown_col: str) -> DataFrame:
    """(id, chunk_index, heading_path, heading_level, content, token_count, parent_content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches):
            own = [chunks(t or "") for t in batch.column(1).to_pylist()]
            size = np.array([len(c) for c in own], np.int64)
            flat = [c for cs in own for c in cs]
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(own)), size)))
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([ids, pa.array(place, pa.int32()), *(pa.array([c[k] for c in flat], t) for k, t in enumerate(kinds))], names=[id_col, "chunk_index", *CHUNK])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, markdown_col).mapInArrow(run, f"`{id_col}` {kind}, chunk_index int, heading_path string, heading_level int, content string, token_count int, parent_content string")


def as_markdown(docs: DataFrame) -> DataFrame:
    """Documents as Markdown: the source as title, a section for every tenth line, lines as paragraphs."""
    lines = F.split("text", "\n")
    body = F.array_join(F.transform(lines, lambda x, i: F.concat(F.when(i % 10 == 0, F.concat(F.lit("## Part "), i.cast("string"), F.lit("\n\n"))).otherwise(""), x)), "\n\n")
    return docs.select("doc_id", F.concat(F.lit("# "), F.coalesce("source", F.lit("none")), F.lit("\n\n"), body).alias("markdown"))


def sectioned(df: DataFrame, id_col: str, markdown_col: str) -> DataFrame:
    """(id, section_index, heading_path, heading_level, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches):
            own = [sections(t or "") for t in batch.column(1).to_pylist()]
            size = np.array([len(c) for c in own], np.int64)
            flat = [c for cs in own for c in cs]
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(own)), size)))
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            kinds = (pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([ids, pa.array(place, pa.int32()), *(pa.array([c[k] for c in flat], t) for k, t in enumerate(kinds))], names=[id_col, "section_index", *CHUNK[:3]])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, markdown_col).mapInArrow(run, f"`{id_col}` {kind}, section_index int, heading_path string, heading_level int, content string")


def preview(chunk_rows: DataFrame, id_col: str) -> DataFrame:
    """(id, markdown): a document's chunks in order, a blank line between them."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "content")))
    return chunk_rows.groupBy(id_col).agg(F.array_join(F.transform(ordered, lambda c: c["content"]), "\n\n").alias("markdown"))


def q_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return sectioned(as_markdown(table(spark, sf_dir, "documents")), "doc_id", "markdown")


#: as_markdown gives a section for every tenth line of a text, whose lines are its paragraphs
SECTIONS_SQL = """
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS section_index, title || ' > Part ' || part * 10 AS heading_path, 2 AS heading_level, body AS content FROM (
  SELECT doc_id, title, part, regexp_replace(regexp_replace(body, '^[ \\t\\r\\n\\f\\v]+', ''), '[ \\t\\r\\n\\f\\v]+$', '') AS body FROM (
    SELECT doc_id, title, i // 10 AS part, string_agg(line, chr(10) || chr(10) ORDER BY i) AS body FROM (
      SELECT doc_id, coalesce(source, 'none') AS title, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents) l
    GROUP BY doc_id, title, i // 10) p) s WHERE body <> ''
"""


def q_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = F.split("source", "[^A-Za-z0-9]+")
    text = enriched(F.col("content"), F.col("heading_path"), F.when(F.col("doc_id") % 3 == 0, "api_reference").otherwise("other"), entities)
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return q_chunks(spark, sf_dir).join(docs, "doc_id").select("doc_id", "chunk_index", text.alias("text"))


def q_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preview(q_chunks(spark, sf_dir), "doc_id")


def q_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html_to_markdown(F.col("html")).alias("markdown"))


def q_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return chunked(as_markdown(table(spark, sf_dir, "documents")), "doc_id", "markdown")


def q_chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = q_chunks(spark, sf_dir).groupBy("doc_id")
    return stats.agg(
        F.count(F.lit(1)).alias("total_chunks"),
        F.sum("token_count").alias("tokens"),
        F.min("token_count").alias("least"),
        F.max("token_count").alias("most"),
        F.round(F.avg("token_count"), 1).alias("mean"),
        F.element_at(F.array_sort(F.collect_list("token_count")), (F.count(F.lit(1)) / 2).cast("int") + 1).alias("upper_median"),  # one document's chunks
        F.count("parent_content").alias("with_parent"),
    )


_BLANKS = "E' \\t\\r\\n\\f\\v'"


def _tokens_sql(text: str) -> str:
    return f"CAST(greatest(1, floor(len(list_filter(regexp_split_to_array({text}, '[ \\t\\r\\n\\f\\v]+'), lambda w: w <> '')) * 1.3e0)) AS INTEGER)"


#: sections of ten lines, blocks packed greedily, two blocks repeated, small neighbours merged: both folds as recursions
_CHUNKS_SQL = f"""
WITH RECURSIVE l AS (
  SELECT doc_id, coalesce(source, 'none') AS title, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents
), s AS (
  SELECT *, {_tokens_sql("body")} AS tokens FROM (
    SELECT doc_id, title, i // 10 AS part, trim(string_agg(line, chr(10) || chr(10) ORDER BY i), {_BLANKS}) AS body FROM l GROUP BY doc_id, title, i // 10) x WHERE body <> ''
), b AS (
  SELECT l.doc_id, l.i // 10 AS part, row_number() OVER (PARTITION BY l.doc_id, l.i // 10 ORDER BY l.i) AS k, trim(l.line, {_BLANKS}) AS block, {_tokens_sql("l.line")} AS cost
  FROM l JOIN s ON s.doc_id = l.doc_id AND s.part = l.i // 10 AND s.tokens > {MOST_TOKENS} WHERE trim(l.line, {_BLANKS}) <> ''
), packed AS (
  SELECT doc_id, part, k, block, 1 AS piece, cost AS used FROM b WHERE k = 1
  UNION ALL SELECT b.doc_id, b.part, b.k, b.block, CASE WHEN p.used + b.cost > {MOST_TOKENS} THEN p.piece + 1 ELSE p.piece END, CASE WHEN p.used + b.cost > {MOST_TOKENS} THEN b.cost ELSE p.used + b.cost END
  FROM packed p JOIN b ON b.doc_id = p.doc_id AND b.part = p.part AND b.k = p.k + 1
), own AS (
  SELECT doc_id, part, piece, list(block ORDER BY k) AS blocks FROM packed GROUP BY doc_id, part, piece
), cut AS (
  SELECT doc_id, part, piece, count(*) OVER (PARTITION BY doc_id, part) AS n,
    array_to_string(list_concat(coalesce(lag(blocks) OVER (PARTITION BY doc_id, part ORDER BY piece), [])[-{OVERLAP}:], blocks), chr(10) || chr(10)) AS content FROM own
), c AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part, piece) AS seq, path, content, {_tokens_sql("content")} AS tokens, parent FROM (
    SELECT doc_id, part, 0 AS piece, title || ' > Part ' || part * 10 AS path, body AS content, NULL AS parent FROM s WHERE tokens <= {MOST_TOKENS}
    UNION ALL SELECT s.doc_id, s.part, cut.piece, s.title || ' > Part ' || s.part * 10 || CASE WHEN cut.n > 1 THEN ' (part ' || cut.piece || ')' ELSE '' END, cut.content, CASE WHEN cut.n > 1 THEN s.body END
    FROM s JOIN cut ON cut.doc_id = s.doc_id AND cut.part = s.part) u
), m AS (
  SELECT doc_id, seq, 1 AS chunk, path, content, tokens, parent FROM c WHERE seq = 1
  UNION ALL SELECT c.doc_id, c.seq, CASE WHEN joins THEN m.chunk ELSE m.chunk + 1 END, CASE WHEN joins AND m.path <> c.path THEN m.path || ' + ' || c.path WHEN joins THEN m.path ELSE c.path END,
    CASE WHEN joins THEN m.content || chr(10) || chr(10) || c.content ELSE c.content END,
    CASE WHEN joins THEN {_tokens_sql("m.content || chr(10) || c.content")} ELSE c.tokens END, CASE WHEN joins THEN coalesce(m.parent, c.parent) ELSE c.parent END
  FROM m JOIN c ON c.doc_id = m.doc_id AND c.seq = m.seq + 1, LATERAL (SELECT m.tokens < {LEAST_TOKENS} AND m.tokens + c.tokens <= {MOST_TOKENS} AS joins) j
), chunks AS (
  SELECT doc_id, chunk - 1 AS chunk_index, path AS heading_path, 2 AS heading_level, content, tokens AS token_count, parent AS parent_content FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, chunk ORDER BY seq DESC) AS rn FROM m) r WHERE rn = 1
)"""
CHUNKS_SQL = f"{_CHUNKS_SQL} SELECT * FROM chunks"
CHUNK_STATS_SQL = f"""{_CHUNKS_SQL}
SELECT doc_id, count(*) AS total_chunks, CAST(sum(token_count) AS BIGINT) AS tokens, min(token_count) AS least, max(token_count) AS most, round(avg(token_count), 1) AS mean,
  max(token_count) FILTER (WHERE nth = n // 2 + 1) AS upper_median, count(parent_content) AS with_parent
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY token_count) AS nth, count(*) OVER (PARTITION BY doc_id) AS n FROM chunks) x GROUP BY doc_id"""
PREVIEW_SQL = f"{_CHUNKS_SQL} SELECT doc_id, string_agg(content, chr(10) || chr(10) ORDER BY chunk_index) AS markdown FROM chunks GROUP BY doc_id"
_WORDS = "list_filter(regexp_split_to_array({}, '[ \\t\\r\\n\\f\\v]+'), lambda w: w <> '')"
_CLEAN = f"""trim({duck(f"array_to_string(list_transform(string_split({duck('content', [INLINE[3]])}, '```'), lambda x, i: CASE WHEN i % 2 = 0 THEN '```' || x || CASE WHEN i < len(string_split({duck('content', [INLINE[3]])}, '```')) THEN '```' ELSE '' END ELSE {duck('x', BODY)} END), '')", SPACING)}, E' \\t\\r\\n')"""
ENRICHED_SQL = f"""{_CHUNKS_SQL}, h AS (
  SELECT c.doc_id, c.chunk_index, {_CLEAN} AS cleaned, '[' || c.heading_path || ']' || chr(10) || CASE WHEN c.doc_id % 3 = 0 THEN '[type: api_reference]' || chr(10) ELSE '' END
    || CASE WHEN d.source IS NULL THEN '' ELSE '[entities: ' || array_to_string(list_filter(regexp_split_to_array(d.source, '[^A-Za-z0-9]+'), lambda w: w <> ''), ', ') || ']' || chr(10) END AS head
  FROM chunks c JOIN documents d ON d.doc_id = c.doc_id)
SELECT doc_id, chunk_index, CASE WHEN {_tokens_sql("head || cleaned")} > 768
  THEN head || array_to_string(({_WORDS.format("cleaned")})[1:CAST(greatest(1, floor((768 - {_tokens_sql("head")}) / 1.3e0)) AS INTEGER)], ' ') ELSE head || cleaned END AS text FROM h"""
HTML_SQL = f"SELECT page_id, trim({duck('html', _TAGS)}, E' \\n\\t') AS markdown FROM pages"

QUERIES = {"html_to_markdown": q_html, "chunk_documents": q_chunks, "chunk_token_stats": q_chunk_stats, "markdown_sections": q_sections, "enrich_chunks": q_enriched, "markdown_preview": q_preview}
ORACLES = {
    "html_to_markdown": HTML_SQL,
    "chunk_documents": CHUNKS_SQL,
    "chunk_token_stats": CHUNK_STATS_SQL,
    "markdown_sections": SECTIONS_SQL,
    "enrich_chunks": ENRICHED_SQL,
    "markdown_preview": PREVIEW_SQL,
}
