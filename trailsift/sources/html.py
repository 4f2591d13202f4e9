"""Web pages as node tables and as markdown.

Parsing is the one step that needs Python.  It runs per page inside ``mapInArrow``, without a
shuffle; everything after it is relational.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from trailsift.plans.lookup import spread

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# An opening tag that ends an open element of these names, unless a boundary lies between.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"),
}
BOUNDARY = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",)}
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav "
    "ol p pre section table ul".split()
)
TEXT = "#text"
COMMENT = "#comment"


class _Nodes(HTMLParser):
    """Nodes in document order: (parent index, tag, attributes, text)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[int, str, dict[str, str], str | None]] = []
        self.open: list[int] = []

    def _add(self, tag: str, attrs: dict[str, str], text: str | None) -> int:
        self.rows.append((self.open[-1] if self.open else -1, tag, attrs, text))
        return len(self.rows) - 1

    def _end_open(self, names: tuple[str, ...], boundary: tuple[str, ...]) -> None:
        for depth in range(len(self.open) - 1, -1, -1):
            tag = self.rows[self.open[depth]][1]
            if tag in boundary:
                return
            if tag in names:
                del self.open[depth:]
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in CLOSES:
            for name in reversed(CLOSES[tag]):
                self._end_open((name,), BOUNDARY.get(tag, ("table",)))
        elif tag in ENDS_P:
            self._end_open(("p",), ("button", "table"))
        kept: dict[str, str] = {}
        for name, value in attrs:
            kept.setdefault(name, value or "")
        index = self._add(tag, kept, None)
        if tag not in VOID:
            self.open.append(index)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[depth]][1] == tag:
                del self.open[depth:]
                return

    def handle_data(self, data: str) -> None:
        self._add(TEXT, {}, data)

    def handle_comment(self, data: str) -> None:
        self._add(COMMENT, {}, data)


def parse(html: str) -> list[tuple[int, str, dict[str, str], str | None]]:
    parser = _Nodes()
    parser.feed(html or "")
    parser.close()
    return parser.rows


NODE_SCHEMA = pa.schema(
    [
        ("page_id", pa.int64()), ("node_id", pa.int64()), ("parent_id", pa.int64()), ("ord", pa.int64()),
        ("depth", pa.int32()), ("anc_ids", pa.list_(pa.int64())), ("path", pa.list_(pa.string())), ("tag", pa.string()),
        ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()),
    ]
)
NODE_COLUMNS = (
    "page_id bigint, node_id bigint, parent_id bigint, ord bigint, depth int, anc_ids array<bigint>, "
    "path array<string>, tag string, attrs map<string,string>, text string"
)


def node_rows(page: int, html: str) -> Iterator[tuple]:
    """One row per node; ``node_id`` is the document order within the page."""
    lineage: list[tuple[list[int], list[str]]] = []
    for i, (parent, tag, attrs, text) in enumerate(parse(html)):
        above, path = lineage[parent] if parent >= 0 else ([], [])
        own = path if tag.startswith("#") else [*path, tag]
        lineage.append(([*above, i], own))
        yield page, i, (parent if parent >= 0 else None), i, len(above), above, own, tag, list(attrs.items()), text


# Small pages go out together: a batch of its own costs each more than its parsing.
NODES_TOGETHER = 5_000


def _node_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows), NODE_SCHEMA)], schema=NODE_SCHEMA)


def node_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node rows of batches of (page, html)."""
    for batch in batches:
        waiting: list[tuple] = []
        for page_id, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            waiting.extend(node_rows(page_id, source))
            if len(waiting) >= NODES_TOGETHER:
                yield _node_batch(waiting)
                waiting = []
        if waiting:
            yield _node_batch(waiting)


def html_nodes(pages: DataFrame, page: str = "page_id", html: str = "html") -> DataFrame:
    """Node table of the pages: elements, texts and comments with their ancestry."""
    return spread(pages.selectExpr(f"cast({page} as bigint)", html)).mapInArrow(node_batches, NODE_COLUMNS)


def stored_nodes(pages: DataFrame, path: str, page: str = "page_id", html: str = "html") -> DataFrame:
    """The node table, parsed once and stored; every later operator reads the columns it needs."""
    html_nodes(pages, page, html).write.mode("overwrite").parquet(path)
    return pages.sparkSession.read.schema(NODE_COLUMNS).parquet(path)


# ---- markdown ------------------------------------------------------------------------------------

# Elements without readable content.
SKIPPED = frozenset("style script head meta link title".split())
ROW_GROUPS = frozenset("tr thead tbody tfoot".split())
HEADINGS = {f"h{i}": "#" * i for i in range(1, 7)}
BLOCKS = frozenset("address article aside body div dl dt dd fieldset figure footer form header html main nav p section".split())


def skipped(tag: str, attrs: dict[str, str]) -> bool:
    """Elements left out: no content, hidden JSON state in ``code``, inline image data."""
    if tag in SKIPPED or tag == COMMENT:
        return True
    if tag == "code":
        style, ident = attrs.get("style", "").replace(" ", ""), attrs.get("id", "")
        return "display:none" in style or any(w in ident for w in ("bpr-guid", "data", "state"))
    return tag == "img" and attrs.get("src", "").startswith("data:image/")


class _Markdown:
    """Markdown of one parsed page: ``#`` headings, ``-`` bullets, nothing escaped."""

    def __init__(self, html: str, links: bool) -> None:
        self.rows = parse(html)
        self.links = links
        self.below: list[list[int]] = [[] for _ in self.rows]
        self.top: list[int] = []
        for i, row in enumerate(self.rows):
            (self.below[row[0]] if row[0] >= 0 else self.top).append(i)

    def text(self) -> str:
        """Children stand behind their parent, so going backwards every node finds its children written: no recursion, any depth."""
        self.levels = [0] * len(self.rows)
        for i, (parent, tag, _, _) in enumerate(self.rows):
            if parent >= 0:
                self.levels[i] = self._level_below(parent)
        self.done = [""] * len(self.rows)
        for i in range(len(self.rows) - 1, -1, -1):
            self.done[i] = self.node(i)
            if self.rows[i][1] not in ROW_GROUPS:  # cells are still wanted by their table
                for c in self.below[i]:
                    self.done[c] = ""
        return "".join(self.done[i] for i in self.top).strip()

    def _level_below(self, i: int) -> int:
        parent, tag, _, _ = self.rows[i]
        around = self.rows[parent][1] if parent >= 0 else ""
        if tag in HEADINGS or (tag in ("td", "th") and around == "tr"):
            return 0
        return self.levels[i] + (tag == "li" and around in ("ul", "ol"))

    def inner(self, i: int) -> str:
        return self.done[i] or "".join(self.done[c] for c in self.below[i])

    def flat(self, i: int) -> str:
        return " ".join(self.inner(i).split())

    def node(self, i: int) -> str:
        _, tag, attrs, text = self.rows[i]
        if tag == TEXT:
            return self.plain(text or "")
        if skipped(tag, attrs):
            return ""
        if tag in HEADINGS:
            return f"\n\n{HEADINGS[tag]} {self.flat(i)}\n\n"
        if tag in ("b", "strong", "i", "em"):
            return self.wrapped(self.inner(i), "**" if tag in ("b", "strong") else "*")
        if tag == "a":
            inside = self.inner(i)
            href = attrs.get("href", "")
            return f"[{inside.strip()}]({href})" if self.links and href and inside.strip() else inside
        if tag == "br":
            return "  \n"
        if tag == "hr":
            return "\n\n---\n\n"
        if tag == "img":
            return f"![{attrs.get('alt', '')}]({attrs.get('src', '')})"
        if tag == "pre":
            return "\n\n```\n" + self.raw(i).strip("\n") + "\n```\n\n"
        if tag == "code":
            inside = self.raw(i)
            return f"`{inside}`" if inside else ""
        if tag in ("ul", "ol"):
            return self.listing(i, tag)
        if tag == "table":
            return self.table(i)
        if tag == "blockquote":
            lines = self.inner(i).strip().split("\n")
            return "\n\n" + "\n".join("> " + line for line in lines) + "\n\n"
        inside = self.inner(i)
        return f"\n\n{inside.strip()}\n\n" if tag in BLOCKS else inside

    @staticmethod
    def plain(text: str) -> str:
        folded = " ".join(text.split())
        if not folded:
            return " " if text and "\n" not in text else ""
        return (" " if text[0].isspace() else "") + folded + (" " if text[-1].isspace() else "")

    @staticmethod
    def wrapped(text: str, mark: str) -> str:
        inside = text.strip()
        if not inside or "\n\n" in inside:
            return text
        head = text[: len(text) - len(text.lstrip())]
        tail = text[len(text.rstrip()):]
        return f"{head}{mark}{inside}{mark}{tail}"

    def raw(self, i: int) -> str:
        texts, stack = [], [i]
        while stack:
            at = stack.pop()
            if self.rows[at][1] == TEXT:
                texts.append(self.rows[at][3] or "")
            stack.extend(reversed(self.below[at]))
        return "".join(texts)

    def listing(self, i: int, kind: str) -> str:
        lines, number = [], 0
        for c in self.below[i]:
            if self.rows[c][1] != "li":
                continue
            number += 1
            body = self.inner(c).strip()
            mark = "-" if kind == "ul" else f"{number}."
            indent = " " * (len(mark) + 1)
            lines.append(f"{mark} " + body.replace("\n", "\n" + indent))
        joined = "\n".join(lines)
        return "\n" + joined if self.levels[i] else f"\n\n{joined}\n\n"

    def table(self, i: int) -> str:
        rows = []
        stack = list(reversed(self.below[i]))
        while stack:
            c = stack.pop()
            tag = self.rows[c][1]
            if tag == "tr":
                rows.append([self.flat(x).replace("|", r"\|") for x in self.below[c] if self.rows[x][1] in ("td", "th")])
            elif tag in ("thead", "tbody", "tfoot"):
                stack.extend(reversed(self.below[c]))
        rows = [r for r in rows if r]
        if not rows:
            return ""
        width = max(map(len, rows))
        shown = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
        return "\n\n" + "\n".join([shown[0], "| " + " | ".join(["---"] * width) + " |", *shown[1:]]) + "\n\n"


def markdown_of(html: str, links: bool = False) -> str:
    return _Markdown(html, links).text()


def html_to_markdown(pages: DataFrame, page: str = "page_id", html: str = "html", extract_links: bool = False) -> DataFrame:
    """``page_id`` and ``markdown`` of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [markdown_of(source or "", extract_links) for source in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["page_id", "markdown"])

    return spread(pages.selectExpr(f"cast({page} as bigint) as page_id", html)).mapInArrow(run, "page_id bigint, markdown string")
