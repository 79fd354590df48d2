"""HTML to Markdown by a stack of open elements, in one pass.

The tokens are those of Python's own HTML tokenizer.  Each open element collects its text
and its finished blocks; when it ends, by its tag or because another element implies it, it
becomes text or blocks of the element around it.  Nothing is built twice and nothing
recurses, so nesting has no limit.

* Implied ends: blocks end an open paragraph and the inline elements in it; list items, table
  cells, rows and definition terms end their likes; an end tag without its element is ignored
  and none reaches beyond a table, cell or list item that it is not meant for.
* Lists nest with an indent as wide as their marker; a list item may hold several blocks.
* Tables have a separator below their first row; rows are filled up to the widest.
* Links may stand in headings and cells; preformatted code keeps its blanks, with its language
  if a class names one; other white space is one blank.
* Rows and cells outside of a table have one of their own; text between cells goes ahead of it.
* Scripts, styles, heads, navigation and footers are left out.  If less than
  ``LEAST`` characters remain, the page is read again with navigation and footer kept.

Null stays null; an empty page is empty; broken tags are read as browsers would, as far as the
rules above go.  A character reference ends with its semicolon: one that was cut off is text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.shipping import ship
from docweave.tables import table

LEAST = 200
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
NEVER = frozenset("script style head noscript template svg".split())
ASIDE = frozenset("nav footer".split())
INLINE = frozenset("a abbr b big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
CELLS, ROWGROUPS = frozenset(("td", "th")), frozenset(("thead", "tbody", "tfoot"))
LISTS = frozenset(("ul", "ol", "menu", "dl"))
#: an element ends the nearest open one of these, unless one of the others lies between
IMPLIED = {
    "li": (frozenset(("li",)), LISTS | {"table"}),
    "dt": (frozenset(("dt", "dd")), LISTS | {"table"}),
    "dd": (frozenset(("dt", "dd")), LISTS | {"table"}),
    "td": (CELLS, frozenset(("tr", "table"))),
    "th": (CELLS, frozenset(("tr", "table"))),
    "tr": (frozenset(("tr",)), frozenset(("table",))),
    **{g: (ROWGROUPS, frozenset(("table",))) for g in ROWGROUPS},
    "option": (frozenset(("option",)), frozenset(("select",))),
    "body": (frozenset(("head",)), frozenset()),
}
#: end tags do not reach beyond these, but for elements of a table or list of their own
WALLS = CELLS | {"table", "li", "dd", "button"}
MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "del": "~~", "s": "~~", "strike": "~~"}
SPACE = re.compile(r"[ \t\r\n\f]+")
#: an ampersand that begins no whole reference
LOOSE = re.compile(r"&(?!#?[0-9A-Za-z]+;)")


class Element:
    """An open element: its running text, its finished blocks and, in tables, its rows."""

    __slots__ = ("attributes", "blocks", "cells", "count", "hidden", "pre", "rows", "tag", "text")

    def __init__(self, tag: str, attributes: dict[str, str], pre: bool = False, hidden: bool = False):
        self.tag, self.attributes, self.pre, self.hidden = tag, attributes, pre, hidden
        self.text: list[str] = []
        self.blocks: list[str] = []
        self.rows: list[list[str]] = []
        self.cells: list[str] = []
        self.count = 0

    def paragraph(self) -> None:
        """The running text as a block."""
        lines = [SPACE.sub(" ", line).strip() for line in "".join(self.text).split("\n")]
        self.text.clear()
        if said := "\n".join(lines).strip():
            self.blocks.append(said)

    def all_blocks(self) -> list[str]:
        if not self.pre:
            self.paragraph()
        return self.blocks


def wrapped(said: str, mark: str) -> str:
    """Text between marks, with its outer blanks outside of them."""
    core = said.strip()
    if not core or core in ("\n",):
        return said
    lead, tail = said[: len(said) - len(said.lstrip())], said[len(said.rstrip()) :]
    return f"{lead}{mark}{core}{mark}{tail}"


def indented(block: str, width: int) -> str:
    return "\n".join(" " * width + line if line else line for line in block.split("\n"))


def table_block(rows: list[list[str]]) -> str:
    width = max(map(len, rows))
    shown = ["| " + " | ".join(row + [""] * (width - len(row))) + " |" for row in rows]
    return "\n".join([shown[0], "|" + " --- |" * width, *shown[1:]])


class Reader(HTMLParser):
    def __init__(self, aside: bool):
        super().__init__(convert_charrefs=True)
        self.drop = NEVER if aside else NEVER | ASIDE
        self.open = [Element("", {})]

    # tokens

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._imply(tag)
        attributes = {k: v or "" for k, v in attrs}
        if tag in VOID:
            self._void(tag, attributes)
            return
        if tag in CELLS and self.open[-1].tag != "tr":
            self.handle_starttag("tr", [])
        elif (tag == "tr" and self.open[-1].tag not in ROWGROUPS | {"table"}) or (tag in ROWGROUPS and self.open[-1].tag != "table"):
            self.handle_starttag("table", [])
        around = self.open[-1]
        self.open.append(Element(tag, attributes, around.pre or tag in ("pre", "listing", "textarea"), around.hidden or tag in self.drop))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("script", "style", "svg"):
            self._end(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag == "p" and not any(e.tag == "p" for e in self.open):
            return
        for k in range(len(self.open) - 1, 0, -1):
            own = self.open[k].tag
            if own == tag:
                self._end(k)
                return
            if tag in INLINE and own not in INLINE:
                return  # an inline end does not end blocks
            if own in WALLS and not (tag in LISTS and own in ("li", "dd")) and tag not in ("table", "tr", *ROWGROUPS, *CELLS, "body", "html"):
                return

    def handle_data(self, data: str) -> None:
        own = self.open[-1]
        if not own.hidden:
            own.text.append(data if own.pre else data.replace("\n", " "))

    # the stack

    def _imply(self, tag: str) -> None:
        if tag in IMPLIED:
            ends, walls = IMPLIED[tag]
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag in ends:
                    self._end(k)
                    break
                if self.open[k].tag in walls:
                    break
        if tag not in INLINE and tag not in VOID | NEVER or tag == "hr":
            # a block ends the inline elements around it, and the paragraph they are in
            k = len(self.open)
            while k > 1 and self.open[k - 1].tag in INLINE and not self.open[k - 1].pre:
                k -= 1
            if k > 1 and self.open[k - 1].tag == "p":
                k -= 1
            if k < len(self.open):
                self._end(k)

    def _end(self, k: int) -> None:
        """Ends the elements from the k-th on."""
        while len(self.open) > k:
            own = self.open.pop()
            if not own.hidden:
                self._close(own, self.open[-1])

    def _void(self, tag: str, attributes: dict[str, str]) -> None:
        own = self.open[-1]
        if own.hidden:
            return
        if tag == "br":
            own.text.append("\n")
        elif tag == "img" and (attributes.get("src") or attributes.get("alt")):
            own.text.append(f"![{attributes.get('alt', '')}]({attributes.get('src', '')})")
        elif tag == "hr" and not own.pre:
            own.paragraph()
            own.blocks.append("---")

    def _close(self, own: Element, around: Element) -> None:
        tag = own.tag
        if tag in INLINE and not own.blocks:
            around.text.append(self._inline(own))
            return
        if own.pre and around.pre:
            around.text.append("".join(own.text) if tag not in INLINE else self._inline(own))
            return
        if tag in ("pre", "listing"):
            if said := "".join(own.text).strip("\n"):
                around.paragraph()
                around.blocks.append(f"```{own.attributes.get('language', '')}\n{said}\n```")
            return
        if own.pre:
            around.text.append("".join(own.text))
            return
        if tag in CELLS:
            around.cells.append(" ".join(" ".join(own.all_blocks()).split()).replace("|", "\\|"))
            return
        if tag == "tr" or tag in ROWGROUPS:
            around.rows += [own.cells] if own.cells else own.rows
            around.blocks += own.all_blocks()  # what should not be there goes ahead of the table
            return
        blocks = own.all_blocks()
        if tag == "table":
            around.paragraph()
            around.blocks += blocks  # captions, and what should not be there
            if own.rows:
                around.blocks.append(table_block(own.rows))
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            around.paragraph()
            if said := " ".join(" ".join(blocks).split()):
                around.blocks.append(f"{'#' * int(tag[1])} {said}")
        elif tag in ("li", "dd", "dt"):
            self._item(own, around, blocks)
        elif tag in LISTS:
            around.paragraph()
            if blocks:
                around.blocks.append("\n".join(blocks))
        elif tag == "blockquote":
            around.paragraph()
            if blocks:
                around.blocks.append("\n".join(f"> {line}".rstrip() for line in "\n\n".join(blocks).split("\n")))
        else:
            around.paragraph()
            around.blocks += blocks

    def _inline(self, own: Element) -> str:
        said = "".join(own.text)
        if own.tag == "code" or own.tag in ("kbd", "samp", "tt"):
            if own.pre:
                language = re.search(r"(?:language|lang|highlight)-([\w+#.-]+)", own.attributes.get("class", ""))
                if language:
                    self.open[-1].attributes["language"] = language[1]
                return said
            return wrapped(said, "`")
        if own.pre:
            return said
        if own.tag == "a" and own.attributes.get("href"):
            core = SPACE.sub(" ", said).strip()
            return f"[{core}]({own.attributes['href']})" if core else ""
        return wrapped(said, MARKS[own.tag]) if own.tag in MARKS else said

    def _item(self, own: Element, around: Element, blocks: list[str]) -> None:
        around.paragraph()  # text between items, if there is any
        if not blocks:
            return
        if own.tag == "dt":
            around.blocks.append("\n\n".join(blocks))
            return
        around.count += 1
        marker = f"{int(around.attributes['start']) + around.count - 1 if around.attributes.get('start', '').isdigit() else around.count}. " if around.tag == "ol" else "- "
        lines = blocks[0]
        for block in blocks[1:]:
            nested = block.lstrip().startswith(("- ", "1. "))
            lines += ("\n" if nested else "\n\n") + block
        around.blocks.append(marker + indented(lines, len(marker))[len(marker) :])

    def result(self) -> str:
        self.close()
        self._end(1)
        text = "\n\n".join(self.open[0].all_blocks())
        return re.sub(r"\n{3,}", "\n\n", "\n".join(line.rstrip() for line in text.split("\n"))).strip()


def markdown(html: str | None, least: int = LEAST) -> str | None:
    if html is None:
        return None
    out = ""
    html = LOOSE.sub("&amp;", html)
    for aside in (False, True):
        reader = Reader(aside)
        reader.feed(html)
        out = reader.result()
        if len(out) >= least:
            break
    return out


def tree_markdown(html: Column, least: int = LEAST) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: markdown(t, least))

    return run(html)


def q_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as Markdown, short ones too without their navigation: headings and a digest of all letters in order."""
    ship(spark)
    rows = table(spark, sf_dir, "pages").select("page_id", tree_markdown(F.col("html"), least=0).alias("markdown"))
    blocks = F.split("markdown", "\n\n")
    heads = F.filter(blocks, lambda b: b.rlike("^#{1,6} "))
    return rows.select(
        "page_id",
        F.size(heads).cast("long").alias("n_headings"),
        F.regexp_replace(F.array_join(heads, " "), F.lit(r"[^\p{L}]"), F.lit("")).alias("heading_letters"),
        F.sha2(F.regexp_replace("markdown", F.lit(r"[^\p{L}]"), F.lit("")), 256).alias("letters_sha256"),
    )


#: what a browser shows of these pages: no tags, no references, and so the same letters in the same order
_SHOWN = r"""regexp_replace(regexp_replace(regexp_replace(html, '(?is)<head\b.*?</head>|<script\b.*?</script>|<style\b.*?</style>|<nav\b.*?</nav>|<footer\b.*?</footer>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '(?is)<a\b[^>]*href="([^"]*)"[^>]*>(.*?)</a>', '\2 \1', 'g')"""
TREE_SQL = rf"""
WITH s AS (SELECT page_id, {_SHOWN} AS html FROM pages),
plain AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<[^>]+>', ' ', 'g'), '&(amp|lt|gt|quot|nbsp|#39);', ' ', 'g'), '[^\p{{L}}]', '', 'g') AS letters, regexp_extract_all(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1) AS heads FROM s)
SELECT page_id, len(heads) AS n_headings, regexp_replace(regexp_replace(regexp_replace(array_to_string(heads, ' '), '(?s)<[^>]+>', ' ', 'g'), '&(amp|lt|gt|quot|nbsp|#39);', ' ', 'g'), '[^\p{{L}}]', '', 'g') AS heading_letters, sha256(letters) AS letters_sha256 FROM plain"""

QUERIES = {"html_tree": q_tree}
ORACLES = {"html_tree": TREE_SQL}
