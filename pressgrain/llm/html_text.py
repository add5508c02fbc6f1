"""Main text of HTML pages by scoring the tree: paragraphs pass points to the containers above them."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pressgrain.llm.common import slices, table

# Element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset(
    "script style noscript template nav header footer aside form button select option textarea input dialog menu iframe object embed svg canvas "
    "video audio head title".split())
BLOCK = frozenset(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre "
    "section summary table tbody td tfoot th thead tr ul br".split())
ENDS_P = BLOCK - {"br", "body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"} | {"form", "nav", "header", "footer", "aside", "menu", "dialog"}
SAME_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = frozenset("ul ol dl table tbody thead tfoot td th div section article main body aside nav header footer form blockquote figure select".split())
UNLIKELY = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|"
    r"subscri\w+|signup|login|paywall|sidebar\w*|side|rail|widgets?|menus?|nav|navbar|navigation|breadcrumbs?|pager|pagination|toolbar|masthead|header|footer|"
    r"copyright|legal|disclaimer|comments?|commentlist|disqus|replies|responses|discussion|shar(?:e|ing)|social|related|recommend\w*|trending|outbrain|taboola|"
    r"skip|tags?|meta|byline|hidden|print|search)(?:$|[\s_-])", re.I)
UNLIKELY_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_BEGINS = re.compile(r"<(?=[a-zA-Z/!?])")
KEPT = frozenset("html body article main".split())


class Node:
    __slots__ = ("tag", "parent", "parts", "depth", "fence", "points", "near", "far", "score", "reached", "chars", "linked", "commas")

    def __init__(self, tag: str, parent: "Node | None"):
        self.tag, self.parent = tag, parent
        self.parts: list[Node | str] = []
        self.depth = parent.depth + 1 if parent else 0
        # depth of the nearest element that the end of an inner one can't pass
        self.fence = self.depth if tag in STOPS or parent is None else parent.fence
        self.points = self.near = self.far = self.score = 0.0
        self.reached = False
        self.chars = self.linked = self.commas = 0


def _unwanted(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    if tag in DROPPED:
        return True
    if not attrs or tag in KEPT:
        return False
    have = {k: v or "" for k, v in attrs}
    return (
        "hidden" in have or have.get("aria-hidden") == "true" or have.get("role", "").lower() in UNLIKELY_ROLES
        or bool(HIDDEN.search(have.get("style", ""))) or bool(UNLIKELY.search(have.get("class", "") + " " + have.get("id", ""))))


class TreeBuilder(HTMLParser):
    """Tree of what may be content; unwanted elements are left out while parsing, with all they hold.

    Open elements are kept in one stack for each tag, so that no tag is looked for along the open elements and the time
    follows the length of the page however deep it is.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", None)
        self.open: dict[str, list[Node]] = {}
        self.skipping: list[str] = []  # open elements inside an unwanted one, that one first
        self.skipped: Counter[str] = Counter()

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Unknown sections ``<![...]>`` are comments, as browsers see them, and end at the first bracket."""
        mark = "]]>" if self.rawdata.startswith("<![CDATA[", i) else ">"
        end = self.rawdata.find(mark, i + 3)
        return -1 if end < 0 else end + len(mark)

    def _top(self, tag: str) -> Node | None:
        nodes = self.open.get(tag)
        return nodes[-1] if nodes else None

    def _close(self, node: Node) -> None:
        """End ``node`` and all that is open inside it."""
        while self.at.depth >= node.depth:
            self.open[self.at.tag].pop()
            self.at = self.at.parent

    def _skip(self, tag: str) -> None:
        self.skipping.append(tag)
        self.skipped[tag] += 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.skipping:
            if tag not in VOID:
                self._skip(tag)
            return
        if tag in ENDS_P:
            p = self._top("p")
            if p and p.depth > self.at.fence:
                self._close(p)
        if tag in SAME_ENDS:
            same = max((n for t in SAME_ENDS[tag] if (n := self._top(t))), key=lambda n: n.depth, default=None)
            if same and same.depth >= self.at.fence:
                self._close(same)
        if tag in VOID:
            if tag in ("br", "hr"):
                self.at.parts.append(Node(tag, self.at))
        elif _unwanted(tag, attrs):
            self._skip(tag)
        else:
            node = Node(tag, self.at)
            self.at.parts.append(node)
            self.open.setdefault(tag, []).append(node)
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # a slash at the end closes nothing in HTML; only void elements and drawings use it
        if tag not in DROPPED:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.skipping:
            # an element left open inside ends with the one around it
            if self.skipped[tag]:
                while True:
                    ended = self.skipping.pop()
                    self.skipped[ended] -= 1
                    if ended == tag:
                        break
            elif tag in ("body", "html", "article", "main") or tag in STOPS and self._top(tag):
                self.skipping = []
                self.skipped.clear()
                self.handle_endtag(tag)
            return
        node = self._top(tag)
        if node and (tag in STOPS or node.depth > self.at.fence):
            self._close(node)

    def handle_data(self, data: str) -> None:
        if not self.skipping:
            self.at.parts.append(data)


def _walk(root: Node) -> list[Node]:
    """Nodes in page order, without recursion."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(p for p in reversed(node.parts) if isinstance(p, Node))
    return out


def _measure(nodes: list[Node]) -> None:
    """Length of text, length of linked text and commas below each node."""
    for node in reversed(nodes):
        for part in node.parts:
            if isinstance(part, str):
                node.chars += len(part.strip())
                node.commas += part.count(",") + part.count("，") + part.count("、") + part.count("،")
            else:
                node.chars += part.chars
                node.linked += part.linked
                node.commas += part.commas
        if node.tag == "a":
            node.linked = node.chars


def _score(nodes: list[Node]) -> list[Node]:
    """Containers with points: one for a paragraph, one a comma, one for each 100 characters up to three; all of them
    go to its parent, half to the next above, a sixth to the third, and two thirds of that to each further one.

    Nodes hand on what they hold once, the last of the page first, so the work follows their number.
    """
    for node in nodes:
        own = node.tag in ("p", "pre", "blockquote", "h1", "h2", "h3", "li", "td", "dd") or node.tag in ("div", "section", "article", "main", "body", "#root") and any(isinstance(p, str) and p.strip() for p in node.parts)
        above = node if node.tag in STOPS and node.tag != "td" else node.parent
        if own and node.chars and above:
            above.points += (1 + node.commas + min(node.chars / 100, 3)) * (1 - node.linked / node.chars)
            above.reached = True
    for node in reversed(nodes):
        node.score = node.points + node.near / 2 + node.far
        if node.parent is not None:
            node.parent.near += node.points
            node.parent.far += node.near / 6 + node.far * 2 / 3
            node.parent.reached |= node.reached
    return [n for n in nodes if n.reached]


def _text(roots: list[Node]) -> str:
    """Words of all blocks; inline elements add no white space, blocks and line breaks do."""
    out: list[str] = []
    for root in roots:
        stack: list[Node | str] = [root]
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                out.append(item)
                continue
            if item.tag in BLOCK:
                stack.append(" ")
                out.append(" ")
            stack.extend(reversed(item.parts))
    return " ".join("".join(out).split())


def main_text(html: str | None) -> str:
    """Main text of one page; '' for null, empty and contentless pages."""
    if not html:
        return ""
    builder = TreeBuilder()
    # behind the last bracket no tag can end; the parser would search the rest anew from each of its beginnings
    end = html.rfind(">") + 1
    builder.feed(html[:end] + _BEGINS.split(html[end:], 1)[0])
    builder.close()
    nodes = _walk(builder.root)
    _measure(nodes)
    containers = _score(nodes)
    if not containers:
        return _text([builder.root])

    def weight(node: Node) -> float:
        return node.score * (1 - node.linked / node.chars if node.chars else 0)

    best = max(containers, key=weight)
    # the element that says it is the article is a container as a whole
    node = best
    while node is not None:
        if node.tag in ("article", "main"):
            best = node
        node = node.parent
    if best.parent is None:
        return _text([best])
    enough = max(10.0, weight(best) / 5)
    chosen = []
    for part in best.parent.parts:
        if not isinstance(part, Node):
            continue
        density = part.linked / part.chars if part.chars else 1.0
        if part is best or weight(part) >= enough or part.tag == "p" and (part.chars > 80 and density < 0.25):
            chosen.append(part)
    return _text(chosen)


def extract_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Main text of every page, from the whole html: page_id, url, text, n_chars (code points).

    Scripts, styles, forms and elements whose kind, role, class or id mark them as menus, headers, footers, sidebars,
    notices, adverts or comments are left out while the tree is built. Paragraphs then pass points for length and commas
    to their ancestors, discounted by the share of linked text. The container with the most points is kept, widened to
    the article element around it, with siblings that score a fifth as much. Pages are independent of each other; the
    parser is one pass and the walks are not recursive, so deep and very long pages are fine. Null or empty html gives
    ''; repeated rows are extracted each; further columns are dropped.
    """
    kind = pages.schema[page_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    chosen = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    return chosen.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
