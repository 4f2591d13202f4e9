"""HTML extraction by consensus of a host's pages on where the main text is.

Each page names the container that holds its running text, as a path of tags and classes with numbers generalised.  Spark counts the
paths per host, combining before the shuffle, so a host of any size is one row per path and task.  Every page is then read again and
gives the text below its host's winning path.  The winners are a written table: Spark knows its size and broadcasts it if it is small,
else it joins by shuffle and splits large hosts.

A page's own container is the lowest that holds all of its running text and headings outside furniture; link lists may lie outside.  A page
without the host's path, or on which the path holds less than all of that, is read by its own container.

Furniture is told by tags, by roles, and by class names and ids, token by token.  A header is furniture unless it stands in a main
element, or holds a heading and stands in the container of the text or beside it.

Defined results: a null or empty page has the empty text, and so has one that is all furniture; a null address is a host of its own; a
page that is cut off ends where it ends; text outside any tag belongs to the body; a very long page is read whole, as one row of one
task; repeated rows each get the full result; an empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailsift.llm.common import pieces, stored

# Names of HTML and of page furniture (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
FURNITURE_TAGS = frozenset(
    "aside button canvas datalist dialog fieldset footer form head iframe input menu nav noembed noframes noscript object option script search select "
    "style svg template textarea title".split()
)
# Class names and ids are judged token by token.  A token is furniture if all its words but fillers are of the first list, if its last
# word is of the second, or if it speaks of comments; never if it tells a state ("has-sidebar").
FURNITURE_WORDS = frozenset(
    "ad ads adsbygoogle advert adverts advertisement advertisements advertising aside banner breadcrumb breadcrumbs consent "
    "cookie cookies disclaimer footer form gdpr login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination "
    "popup promo promotion promotions rail recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe teaser toolbar widget".split()
)
FURNITURE_NOUNS = frozenset(
    "ad ads advert adverts advertisement breadcrumb breadcrumbs footer menu nav navbar navigation newsletter pager pagination popup share sharing sidebar toolbar widget".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus".split())
STATE_WORDS = frozenset("has hide hidden is no not show toggle uses with without".split())
FILLER_WORDS = frozenset(
    "a area articles bar block bottom box boxes button buttons container desktop element fixed floating global group holder icon icons inner item items left "
    "link links list main mobile module outer page panel posts primary reading right secondary section site slot sticky stories text the top unit widgets wrap wrapper".split()
)
# On a single block of text only these words count.
BLOCK_WORDS = frozenset("ad ads adsbygoogle advert advertisement cookie cookies gdpr sponsored".split())
TEXT_TAGS = frozenset("blockquote caption center dd dt figcaption figure li p pre table tbody td th tr".split())
FURNITURE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article body center div main section td".split())
# A start tag closes these open elements (up to the nearest element of the second set).
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S
)
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(?=[\s/]|$))""", re.I)
_WORD = re.compile(r"[a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

LINKED = 0.5  # a block with a larger share of its letters in links is not running text
HARD, COMMENTS, SOFT, HEADER = 4, 3, 2, 1  # furniture by tag, reader comments, furniture by name, a header that may belong to the text


def _judged(token: str) -> int:
    """What a class name or id says its element is."""
    words = _WORD.findall(token)
    if not words or STATE_WORDS.intersection(words):
        return 0
    if COMMENT_WORDS.intersection(words):
        return COMMENTS
    core = [w for w in words if w not in FILLER_WORDS]
    if core == ["header"] and len(words) > 1 and words[0] != "page":
        return SOFT  # site-header, top-header
    if words[-1] == "header":
        return HEADER
    return SOFT if words[-1] in FURNITURE_NOUNS or (core and FURNITURE_WORDS.issuperset(core)) else 0


class Page:
    """Containers of a page, and its blocks of text in order."""

    def __init__(self, html: str) -> None:
        self.tags, self.parents, self.labels, self.furniture, self.main = ["body"], [-1], ["body"], [0], [False]
        self.own = [0]  # furniture by the element's own tag and names
        self.blocks: list[tuple[int, str, float]] = []  # container, text, share of it in links
        self._read(html)
        if not any(self.furniture[at] == 0 for at, _, _ in self.blocks):
            self._unwrap()
        self.totals = self._held()
        self._take_headers()

    def _unwrap(self) -> None:
        """On a page that is all furniture, a name on an element around a main element tells the layout."""
        around = set()
        for k in range(len(self.tags)):
            if self.main[k] and self.furniture[k] == SOFT:
                up = k
                while up > 0 and self.furniture[up] == SOFT:
                    around.add(up)
                    up = self.parents[up]
        for k in range(1, len(self.tags)):
            if self.furniture[k] == SOFT and (k in around or (self.own[k] < SOFT and self.furniture[self.parents[k]] < SOFT)):
                self.furniture[k] = self.own[k] if k not in around else 0

    def _held(self) -> list[int]:
        """Letters of running text and its headings below each element, outside furniture."""
        totals = [0] * len(self.tags)
        after = False  # is the next block outside furniture running text?
        for at, text, linked in reversed(self.blocks):
            if self.furniture[at] == 0:
                running = linked < LINKED
                # A heading that is a link belongs to the text it stands over.
                if running or (after and self._heading(at)):
                    totals[at] += len(text)
                after = running
        for at in range(len(self.tags) - 1, 0, -1):
            totals[self.parents[at]] += totals[at]
        return totals

    def _take_headers(self) -> None:
        """A header that holds a heading belongs to the text if it stands in the text's container, or beside it in an element without navigation."""
        if not self.totals[0]:
            return
        own = self.container()
        above, up = set(), own
        while up > 0:
            up = self.parents[up]
            above.add(up)
        inside = [False] * len(self.tags)
        for k in range(1, len(self.tags)):
            inside[k] = k == own or inside[self.parents[k]]
        headed = {at for at, _, _ in self.blocks if self.furniture[at] == HEADER and self._heading(at)}
        for k in range(len(self.tags) - 1, 0, -1):
            if k in headed and self.furniture[self.parents[k]] == HEADER:
                headed.discard(k)
                headed.add(self.parents[k])
        navigated = {self.parents[k] for k in range(len(self.tags)) if self.tags[k] in ("nav", "footer", "aside") or self.furniture[k] == HARD and self.furniture[self.parents[k]] == HEADER}
        taken = set()
        for k in headed:
            up = self.parents[k]
            if inside[k] or (up in above and up > 0 and not {up, k} & navigated):
                taken.add(k)
        if taken:
            for k in range(1, len(self.tags)):
                if self.furniture[k] == HEADER and (k in taken or (self.own[k] <= HEADER and self.furniture[self.parents[k]] == 0 and self.parents[k] in taken)):
                    self.furniture[k] = 0
                    taken.add(k)
            self.totals = self._held()

    def _read(self, html: str) -> None:
        open_tags: list[tuple[str, int]] = [("body", 0)]
        words: list[str] = []
        links = in_link = 0

        def flush() -> None:
            nonlocal links
            if words:
                text = " ".join("".join(words).split())
                if text:
                    self.blocks.append((open_tags[-1][1], text, links / max(1, len(text))))
                words.clear()
            links = 0

        def say(raw: str) -> None:
            nonlocal links
            if raw and self.furniture[open_tags[-1][1]] < HARD:
                text = unescape(raw) if "&" in raw else raw
                words.append(text)
                if in_link:
                    links += len(text)

        def close(to: int) -> None:
            nonlocal in_link
            if any(tag in BLOCKS for tag, _ in open_tags[to:]) or open_tags[to - 1][1] != open_tags[-1][1]:
                flush()
            in_link -= sum(tag == "a" for tag, _ in open_tags[to:])
            del open_tags[to:]

        def nearest(wanted: set | frozenset, until: set | frozenset) -> int:
            for k in range(len(open_tags) - 1, 0, -1):
                if open_tags[k][0] in wanted:
                    return k
                if open_tags[k][0] in until:
                    return 0
            return 0

        at, end = 0, len(html)
        while at < end:
            found = _TAG.search(html, at)
            say(html[at : found.start()] if found else html[at:])
            if not found:
                break
            at = found.end()
            ends, tag, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
            if not tag:
                continue
            tag = tag.lower()
            if ends:
                if tag == "p" and not nearest({"p"}, BLOCKS):
                    flush()
                elif tag not in ("html", "body") and (k := nearest({tag}, frozenset())):
                    close(k)
                continue
            if tag in RAW:
                # Raw text goes to its end tag, whatever it looks like; none of it is page text.
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
                at = stop.end() if stop else end
                continue
            if tag in ("br", "hr"):
                flush() if tag == "hr" else say(" ")
                continue
            if tag in VOID or tag in ("html", "body"):
                continue
            if tag in BLOCKS:
                if k := nearest({"p"}, BLOCKS):
                    close(k)
                flush()
            if tag in CLOSES and (k := nearest(*CLOSES[tag])):
                close(k)
            own = open_tags[-1][1]
            named, label, is_main = self._kind(tag, attributes, own)
            kind = max(named, self.furniture[own])
            if tag in BLOCKS or kind > self.furniture[own]:
                self.tags.append(tag)
                self.parents.append(own)
                self.labels.append(label)
                self.furniture.append(kind)
                self.own.append(named)
                self.main.append(is_main)
                own = len(self.tags) - 1
                flush() if tag in BLOCKS else None
            if not attributes.endswith("/") or tag in BLOCKS:
                in_link += tag == "a"
                open_tags.append((tag, own))
        flush()

    def _kind(self, tag: str, attributes: str, parent: int) -> tuple[int, str, bool]:
        kind = HARD if tag in FURNITURE_TAGS else HEADER if tag == "header" else 0
        is_main = tag in ("article", "main")
        values: dict[str, str] = {}
        if attributes.strip(" /"):
            values = {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(attributes)}
            if kind < HARD and tag not in HEADINGS and tag != "main":
                tokens = f"{values.get('class', '')} {values.get('id', '')}".lower().split()
                if tag in TEXT_TAGS:
                    kind = SOFT if any(BLOCK_WORDS.intersection(_WORD.findall(t)) and _judged(t) for t in tokens) else kind
                else:
                    kind = max([kind, *map(_judged, tokens)])
                if values.get("role", "").lower() in FURNITURE_ROLES:
                    kind = max(kind, SOFT)
            if "hidden" in values or values.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(values.get("style", "")):
                kind = HARD
        if kind == HEADER and self.main[self._main_above(parent)]:
            kind = 0
        classes = sorted({re.sub(r"\d+", "#", c) for c in values.get("class", "").lower().split()})
        return kind, ".".join([tag, *classes]), is_main or values.get("role", "").lower() == "main" or values.get("itemprop") == "articleBody"

    def _main_above(self, at: int) -> int:
        """The nearest main element that holds this one, itself included, else the body."""
        while at > 0 and not self.main[at]:
            at = self.parents[at]
        return at

    def path(self, at: int) -> str:
        steps = []
        while at >= 0:
            steps.append(self.labels[at])
            at = self.parents[at]
        return ">".join(reversed(steps))

    def container(self) -> int:
        """The lowest element that holds all of the page's running text."""
        holding = [k for k in range(len(self.tags)) if (self.tags[k] in CONTAINERS or self.main[k]) and self.totals[k] == self.totals[0]]
        return holding[-1] if self.totals[0] else 0  # each holds the next, as they hold the same text

    def _heading(self, at: int) -> bool:
        while at > 0 and self.tags[at] not in CONTAINERS:
            if self.tags[at] in HEADINGS:
                return True
            at = self.parents[at]
        return False

    def text(self, winning: str | None) -> str:
        """The blocks below the winning path, or below the page's own container."""
        own = self.container()
        chosen = {own}
        if winning is not None:
            steps = winning.split(">")
            along = [-1] * len(self.tags)  # how many steps of the path lead to the element, less one
            for k, label in enumerate(self.labels):
                before = along[self.parents[k]] if k else -1
                if (k == 0 or before >= 0) and before + 1 < len(steps) and steps[before + 1] == label:
                    along[k] = before + 1
            matched = {k for k, step in enumerate(along) if step == len(steps) - 1}
            if matched and sum(self.totals[k] for k in matched) >= self.totals[own]:
                chosen = matched
        inside = [False] * len(self.tags)
        for k in range(len(self.tags)):
            inside[k] = k in chosen or (k > 0 and inside[self.parents[k]])
        return "\n\n".join(text for at, text, _ in self.blocks if inside[at] and self.furniture[at] == 0)


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        paths, held = [], []
        for html in batch["html"].to_pylist():
            page = Page(html or "")
            at = page.container()
            paths.append(page.path(at))
            held.append(page.totals[at])
        yield pa.RecordBatch.from_arrays([batch["host"], pa.array(paths, pa.string()), pa.array(held, pa.int64())], ["host", "path", "held"])


def winning_paths(pages: DataFrame) -> DataFrame:
    """Per host: the path that most pages with text name, then the one that holds more."""
    votes = pages.select("host", "html").mapInArrow(_votes, "host string, path string, held long").filter("held > 0")
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("pages"), F.sum("held").alias("held"))
    return counted.groupBy("host").agg(F.max_by("path", F.struct("pages", "held", "path")).alias("path"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: ``id``, ``url``, ``text``, and ``path``, the winning path of its host."""
    host = F.coalesce(F.lower(F.regexp_extract(url_col, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    named = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).alias("html"))
    winners = stored(winning_paths(named), "host-paths")
    asked = named.join(winners, "host", "left").select("id", "url", "path", "html")
    schema = T.StructType([asked.schema["id"], asked.schema["url"], *T.StructType.fromDDL("path string, text string").fields])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = [Page(html or "").text(path) for html, path in zip(batch["html"].to_pylist(), batch["path"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["url"], batch["path"], pa.array(texts, pa.string())], schema.names)

    return asked.mapInArrow(read, schema)
