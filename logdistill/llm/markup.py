"""Text blocks of a web page with the region they stand in, and line alignment."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from math import isqrt

ARTICLE, OTHER, AROUND, READERS = 0, 1, 2, 3

# Elements whose text is no text of the page at all.
HIDDEN = frozenset("script style noscript template head title svg iframe object canvas math".split())
# Elements around an article.
FRAME = frozenset("nav header footer aside form menu dialog button select textarea".split())
BLOCKS = frozenset(
    """address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul
    video audio""".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Words in class, id or role that mark menus, notices, adverts, sidebars and reader comments.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notice|popup|modal|newsletter|"
    r"subscribe|sidebar|side-?bar|menu|nav|navbar|navigation|breadcrumbs?|header|masthead|footer|comments?|"
    r"comment-?list|respond|disqus|share|sharing|social|related|recommend\w*|widget|login|signup|"
    r"complementary|contentinfo|search)(?:$|[\s_-])",
    re.I,
)

# Words of layout ("has-sidebar") and of titles and content, which mark nothing.
LAYOUT = re.compile(r"(?:has|no|not|with|without|hide|show)[_-]", re.I)
CONTENT = re.compile(r"(?:article|chapter|content|entry|page|post|section|story)[_-]?(?:header|body|content)|related[_-]works?", re.I)


def _marked(value: str, inside: bool) -> bool:
    """Whether a class, id or role marks its element; ``inside`` an article titles do not."""
    return any(
        MARKS.search(word) and not LAYOUT.match(word) and not (inside and CONTENT.fullmatch(word))
        for word in value.split()
    )


class _Blocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, int]] = []
        self.parts: list[str] = []
        self.articles = 0
        # Open elements that hide or frame their text: [tag, depth of that tag, hidden, readers'].
        self.open: list[list] = []

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts = []
            if text:
                framed = any(not o[2] for o in self.open)
                readers = any(o[3] for o in self.open)
                region = READERS if readers else AROUND if framed else ARTICLE if self.articles else OTHER
                self.found.append((text, region))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.flush()
        elif tag == "br" or tag == "td" or tag == "th":
            self.parts.append(" ")
        if tag in VOID:
            return
        if tag in ("article", "main"):
            # What was left open before an article does not reach into it, but a comment
            # list may be made of article elements.
            if not any(o[3] for o in self.open):
                self.open = []
                self.articles += 1
                return
        elif tag == "body":
            self.open = [o for o in self.open if o[0] not in ("head", "title")]
        for o in self.open:
            if o[0] == tag:
                o[1] += 1
                return
        hidden = tag in HIDDEN
        framed = tag in FRAME and not (tag == "header" and self.articles)
        marked = False
        if tag not in ("html", "body") and not hidden:
            for name, value in attrs:
                if name in ("class", "id", "role") and value and _marked(value, self.articles > 0):
                    marked = True
                elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                    marked = True
        if hidden or framed or marked:
            if not hidden:
                self.flush()
            reader = marked and any(v and re.search("comment|respond|disqus", v, re.I) for _, v in attrs)
            self.open.append([tag, 1, hidden, reader])

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        for i, o in enumerate(self.open):
            if o[0] == tag:
                o[1] -= 1
                if not o[1]:
                    if not o[2]:
                        self.flush()
                    # Elements opened inside end with it.
                    del self.open[i:]
                return
        if tag in ("article", "main") and self.articles:
            self.flush()
            self.articles -= 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.flush()
        elif tag == "br":
            self.parts.append(" ")

    def handle_data(self, data: str) -> None:
        if not any(o[2] for o in self.open):
            self.parts.append(data)


def blocks(html: str) -> list[tuple[str, int]]:
    """(text, region) of every block, in page order; white space is folded."""
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.found


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence of ``a`` and ``b``.

    Bit-parallel rows; only every root-th row is kept and the rest is made anew on the way
    back, so memory stays small for long pages.
    """
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < len(a) - head and tail < len(b) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    found = list(range(head)) + list(range(len(a) - tail, len(a)))
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    if not x or not y:
        return sorted(found)
    at: dict[int, int] = {}
    for j, v in enumerate(y):
        at[v] = at.get(v, 0) | 1 << j
    every = isqrt(len(x)) + 1
    ones = (1 << len(y)) - 1

    def after(row: int, v: int) -> int:
        m = at.get(v, 0)
        return ((row + (row & m)) | (row & ~m)) & ones

    kept, row = [ones], ones
    for i, v in enumerate(x):
        row = after(row, v)
        if (i + 1) % every == 0:
            kept.append(row)
    i, j = len(x), len(y)
    base, rows = -1, []
    while i > 0 and j > 0:
        if (i - 1) // every != base:
            base = (i - 1) // every
            rows = [kept[base]]
            for v in x[base * every : min(len(x), (base + 1) * every)]:
                rows.append(after(rows[-1], v))
        here, above = rows[i - base * every], rows[i - 1 - base * every]
        if here >> (j - 1) & 1:
            j -= 1
        elif not above >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            found.append(head + i)
    return sorted(found)
