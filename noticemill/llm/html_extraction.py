"""Main text of web pages by tag-path ratios.

A page becomes a list of blocks in page order, each with the path of block tags from the root to it. For every path the
lengths of text, of linked text and the punctuation of all its blocks are added up; a path's two ratios (text per block
and punctuation per text, both damped by the linked share) are smoothed over the page order with the neighbouring blocks
and fused into one score, which counts ``CONTAINER_FACTOR`` times inside an article or main element. A path whose score reaches
``threshold`` times the mean over the page's paths is content, and so is a heading right before content. Menus, forms, notices and the like that say so in their tags,
classes or roles take no part.

Defined cases: a null or empty page gives an empty text; broken markup (unclosed or stray tags) is read as a browser would
close paragraphs and list items; a page without any tag is one block of text; rows are read one by one whatever their ids;
nothing is dropped or cut for its length; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticemill.functions.markup import LenientParser
from noticemill.llm.tables import table

# Fixed values of HTML and of the words that pages use to name their parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var".split())
SKIPPED = frozenset("script style noscript template head nav header footer aside form button select option textarea menu dialog "
                    "iframe object svg canvas video audio math map".split())
RAW = frozenset(("script", "style"))
NOISE = frozenset("""ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments comentarios
 consent cookie cookies disqus footer gdpr header masthead menu menus modal nav navbar navigation newsletter notice notices
 notification pager pagination popup promo promoted promotion recommended related reply replies respond share sharing sidebar
 sidebars social sponsor sponsored subscribe subscription toolbar topbar widget widgets""".split())
#: A class that begins so says something about a part, not that it is one: has-sidebar, no-header.
MODIFIERS = frozenset("has no with without is".split())
NOISE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
CONTENT = frozenset(("article", "main"))
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main "
                     "menu nav ol p pre section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open element of the second kind ends where one of the first opens, up to the nearest of the third.
ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
        "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
        "option": (("option",), ("select",))}
#: White space of HTML; a no-break space stays.
SPACE = re.compile(r"[ \t\n\r\f\v]+")
PUNCTUATION = re.compile("[.,;:!?…。，；：！？、]")
THRESHOLD = 0.35
#: What the score of a path inside an article or main element is multiplied by; the ratios can outweigh it.
CONTAINER_FACTOR = 2


def is_noise(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    """Whether an element names itself a part beside the content."""
    if tag in SKIPPED:
        return True
    for name, value in attrs:
        if tag == "article" and name == "class" and value:
            # By what a name begins with: comment-body or related-post, not has-comments or category-notice.
            if not NOISE.isdisjoint(re.split(r"[^a-z0-9]", x)[0] for x in value.lower().split()):
                return True
        elif name in ("class", "id") and value and tag not in ("html", "body") and tag not in CONTENT:
            names = [re.split(r"[^a-z0-9]+", x) for x in value.lower().split()]
            if any(x[0] not in MODIFIERS and not NOISE.isdisjoint(x) for x in names):
                return True
        elif name == "role" and value and value.lower() in NOISE_ROLES:
            return True
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            return True
    return False


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int
    content: bool


@dataclass
class _Open:
    tag: str
    noise: bool
    content: bool


class Blocks(LenientParser):
    """Reads a page into blocks."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self._stack: list[_Open] = []
        self._parts: list[str] = []
        self._linked = 0
        self._links = 0

    def updatepos(self, i, j):  # line numbers are not needed
        return j

    def _flush(self) -> None:
        if self._parts:
            text = SPACE.sub(" ", "".join(self._parts)).strip(" \t\n\r\f\v ")
            if text:
                self.blocks.append(Block(tuple(x.tag for x in self._stack), text, self._linked,
                                         bool(self._stack) and self._stack[-1].content))
            self._parts = []
        self._linked = 0

    def _close_to(self, depth: int) -> None:
        self._flush()
        del self._stack[depth:]

    def _close_open(self, tags: tuple[str, ...], limits: tuple[str, ...]) -> None:
        lowest = None
        for i in range(len(self._stack) - 1, -1, -1):
            if self._stack[i].tag in tags:
                lowest = i
            elif self._stack[i].tag in limits:
                break
        if lowest is not None:
            self._close_to(lowest)

    def handle_starttag(self, tag, attrs):
        if tag in INLINE:
            self._links += tag == "a"
            if is_noise(tag, attrs):
                self._stack.append(_Open(tag, True, False))
            return
        if tag == "br":
            self._parts.append(" ")
            return
        if tag in CLOSES_P:
            self._close_open(("p",), ("table", "td", "th", "button", "object", "body"))
        if tag in HEADINGS and self._stack and self._stack[-1].tag in HEADINGS:
            self._close_to(len(self._stack) - 1)
        if tag in ENDS:
            self._close_open(*ENDS[tag])
        if tag in VOID:
            if tag == "hr":
                self._flush()
            return
        self._flush()
        above = self._stack[-1] if self._stack else _Open("", False, False)
        if tag == "body":  # whatever the head left open
            self._stack = [x for x in self._stack if x.tag == "html"]
            above = _Open("", False, False)
        noise = above.noise or is_noise(tag, attrs)
        main = tag in CONTENT or ("role", "main") in attrs or ("itemprop", "articleBody") in attrs
        self._stack.append(_Open(tag, noise, above.content or main))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in INLINE and self._stack and self._stack[-1].tag == tag and tag in RAW | {"svg"}:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag == "a":
            self._links = max(0, self._links - 1)
        if tag == "br":
            self._parts.append(" ")
            return
        for i in range(len(self._stack) - 1, -1, -1):
            if self._stack[i].tag == tag:
                self._close_to(i)
                return
            if self._stack[i].tag in ("td", "th", "table") and tag in INLINE | {"p", "li"}:
                return

    def handle_data(self, data):
        if self._stack and self._stack[-1].noise:
            return
        self._parts.append(data)
        if self._links:
            self._linked += len(data.strip())

    def close(self):
        super().close()
        self._flush()


@dataclass
class _Path:
    text: int = 0
    linked: int = 0
    marks: int = 0
    blocks: list[int] = field(default_factory=list)
    content: bool = False


def content_paths(blocks: list[Block], threshold: float = THRESHOLD) -> set[tuple[str, ...]]:
    """The paths whose blocks are content."""
    paths: dict[tuple[str, ...], _Path] = {}
    for i, b in enumerate(blocks):
        p = paths.setdefault(b.path, _Path())
        p.text += len(b.text)
        p.linked += min(b.linked, len(b.text))
        p.marks += len(PUNCTUATION.findall(b.text))
        p.blocks.append(i)
        p.content |= b.content
    raw = {}
    for path, p in paths.items():
        free = 1 - p.linked / p.text
        raw[path] = (p.text / len(p.blocks) * free, (p.marks + 1) / (p.text + 20) * free)
    per_block = [raw[b.path] for b in blocks]
    smooth = []
    for i in range(len(blocks)):
        near = per_block[max(0, i - 1):i + 2]
        smooth.append(tuple((per_block[i][k] + sum(x[k] for x in near) / len(near)) / 2 for k in (0, 1)))
    fused = {path: sum(smooth[i][0] * smooth[i][1] ** 0.5 for i in p.blocks) / len(p.blocks) for path, p in paths.items()}
    fused = {path: score * (CONTAINER_FACTOR if paths[path].content else 1) for path, score in fused.items()}
    least = threshold * sum(fused.values()) / max(1, len(fused))
    return {path for path, score in fused.items() if score >= least and 2 * paths[path].linked < paths[path].text}


def main_text(page: str | None, threshold: float = THRESHOLD) -> str:
    if not page:
        return ""
    reader = Blocks()
    reader.feed(page)
    reader.close()
    keep = content_paths(reader.blocks, threshold)
    found: list[Block] = []
    below = None  # the block after, if it is content
    for b in reversed(reader.blocks):
        # A heading is short whatever it leads, so it goes with the content that follows it within its parent.
        leads = (below is not None and b.path[-1:] and b.path[-1] in HEADINGS and 2 * b.linked < len(b.text)
                 and below.path[:len(b.path) - 1] == b.path[:-1])
        below = b if b.path in keep or leads else None
        if below:
            found.append(b)
    return "\n".join(b.text for b in reversed(found))


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), threshold: float = THRESHOLD) -> DataFrame:
    """The kept columns and ``text`` of every row."""
    names = [*keep, "text"]

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(h, threshold) for h in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(texts, pa.string())], names)

    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in keep)
    return pages.select(*keep, F.col("html").cast("string").alias("html")).mapInArrow(work, f"{kinds}, text string")


# --- query ---------------------------------------------------------------------------------------------------------

def op10_html_extraction(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


ENTRIES = {"op10_html_extraction": (op10_html_extraction, None)}
