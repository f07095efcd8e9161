"""Title, main region and code blocks of one page, from one pass of parser events.

A per-row helper of :func:`siftwork.operators.pages.extract_pages`: regular
expressions cannot follow nested or unclosed elements.  Elements are a stack of
names, and a region is a span of the text pieces collected so far, so nothing is
built up as a tree and no depth of nesting takes recursion.  Cleaning of the text
and of code blocks stays with the column expressions of :mod:`.html`.
"""

from __future__ import annotations

from html.parser import HTMLParser

# Fixed values that must equal the reference rules.
DROPPED_TAGS = ["script", "style", "nav", "header", "footer", "aside", "iframe", "noscript"]
MAIN_SELECTORS = ["main", "article", ".content", ".post-content", ".entry-content", ".article-body", "#content"]
CODE_TAGS = ["code", "pre"]
#: Elements without an end.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class PageEvents(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.names: list[str] = []
        self.data: list[str] = []
        self.pieces: list[str] = []
        self.codes: dict[int, list[str]] = {}     # by place among the pieces
        self.spans: dict[str, list[int]] = {}     # selector -> first piece, end (-1: open), depth
        self.headings: dict[str, list[str]] = {}
        self.dropped = self.code = 0              # depth of the element that began it
        self.heading: tuple[str, int] | None = None

    def flush(self) -> None:
        """Text between two tags is one piece, stripped; blank text is none."""
        text = "".join(self.data)
        self.data = []
        if not text:
            return
        if self.heading:
            self.headings[self.heading[0]].append(text)
        if self.dropped:
            return
        if self.code:
            self.codes[len(self.pieces)].append(text)
        elif text.strip():
            self.pieces.append(text.strip())

    def handle_data(self, data: str) -> None:
        self.data.append(data)

    def handle_comment(self, data: str) -> None:
        self.flush()

    def handle_decl(self, decl: str) -> None:
        self.flush()

    def handle_pi(self, data: str) -> None:
        self.flush()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.start(tag, attrs, tag in VOID)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.start(tag, attrs, True)

    def start(self, tag: str, attrs: list, empty: bool) -> None:
        self.flush()
        depth = len(self.names) + 1
        if tag in ("title", "h1") and tag not in self.headings:
            self.headings[tag] = []
            self.heading = self.heading or (tag, depth)
        if not self.dropped:
            if tag in DROPPED_TAGS:
                self.dropped = 0 if empty else depth
            else:
                values = dict(attrs)
                for name in (tag, "#" + (values.get("id") or ""),
                             *("." + c for c in (values.get("class") or "").split())):
                    if name == "body" or name in MAIN_SELECTORS:
                        self.spans.setdefault(name, [len(self.pieces), len(self.pieces) if empty else -1, depth])
                if tag in CODE_TAGS and not self.code and not empty:
                    self.code = depth
                    self.codes[len(self.pieces)] = []
        if not empty:
            self.names.append(tag)

    def handle_endtag(self, tag: str) -> None:
        self.flush()
        if tag in self.names:
            at = len(self.names) - 1
            while self.names[at] != tag:
                at -= 1
            self.leave(at)

    def leave(self, depth: int) -> None:
        """End all elements deeper than ``depth``."""
        while len(self.names) > depth:
            here = len(self.names)
            if self.code == here:
                self.code = 0
                self.pieces.append("")
            if self.dropped == here:
                self.dropped = 0
            if self.heading and self.heading[1] == here:
                self.heading = None
            for span in self.spans.values():
                if span[1] < 0 and span[2] == here:
                    span[1] = len(self.pieces)
            self.names.pop()

    def region(self) -> tuple[int, int]:
        """The first selector that has an element; if that is empty, the body or all."""
        for selector in MAIN_SELECTORS:
            if selector in self.spans:
                start, end, _ = self.spans[selector]
                if start < end:
                    return start, end
                break
        start, end, _ = self.spans.get("body", (0, len(self.pieces), 0))
        return start, end


def read_page(html: str | None) -> tuple[str, str, list[str]]:
    """(title, text with a mark in place of each code block, code blocks as they are)."""
    page = PageEvents()
    page.feed(html or "")
    page.close()
    page.flush()
    page.leave(0)
    heading = page.headings.get("title", page.headings.get("h1", []))
    start, end = page.region()
    codes = [i for i in range(start, end) if i in page.codes and not page.pieces[i]]
    place = {i: k for k, i in enumerate(codes)}
    text = " ".join(f"__CODE_BLOCK_{place[i]}__" if i in place else page.pieces[i] for i in range(start, end))
    return "".join(heading).strip(), text, ["".join(page.codes[i]) for i in codes]
