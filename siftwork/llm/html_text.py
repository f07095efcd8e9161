"""HTML main text: parser events to lines, text-to-tag ratios, smoothing, clustering.

The standard library's streaming parser gives events.  Block elements start a new
line; a line has its text, its tags, its link text, the sections it stands in, and
whether it stands inside boilerplate by nature (menu, header, footer, aside, form,
script, style, hidden parts) or by name (class, id or role such as ``sidebar``, ``ad``
or ``comments``), which has ratio zero.  An element that holds more than half of the
page's unlinked text is no boilerplate for its name, nor is such a form.  A headline in the header of an article is
content, and so is an article in a wrapper that only its name makes boilerplate.  An id
names boilerplate only as a whole, and no class or id does so for a heading.  The ratio of a line is its unlinked text
length per tag.  Ratios are smoothed over neighbouring lines by a Gaussian, and a
threshold between the two clusters of the smoothed logarithms splits content from
the rest.  A line of content makes a region: the article or main section around
it if there is one, else the lines around it up to boilerplate.  The only article
of a main section is one region with what else is in the section.  The page's text is
the lines of the heaviest region and of regions of its kind that are not teasers: an
article under half its weight is one if its heading or last line is a link.  Without
sections, lines of links between two lines of content belong to the text.

Defined cases: null or empty html gives an empty text; unclosed elements end where
their parents do; character references are decoded, also without semicolon;
white space inside a line is one space; lines are joined by one newline.  Rows are
independent, so repeated rows and ids are no matter; whole pages are read, and nesting of any
depth takes no recursion.  Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Elements that begin and end lines.
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary
table tbody td tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never content.
SILENT = frozenset("""head script style noscript template svg math canvas iframe object video audio select button
textarea datalist title""".split())
#: Fields whose choices are blocks of their own, but part no line.
CHOICES = frozenset(["select", "datalist"])
BOILER = frozenset("nav header footer aside form menu dialog fieldset".split())
SECTIONS = frozenset(["article", "main"])
#: Elements that end an open one of the same kind (as HTML's implied end tags do).
IMPLIED = {"p": BLOCKS - {"html", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"},
           "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}}
#: Words of class, id or role that name boilerplate.
NAMES = frozenset("""ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments
complementary contentinfo cookie cookies consent copyright dialog discussion disqus footer gdpr header masthead menu modal nav
navbar navigation newsletter notice notices pagination pager popup promo promoted promotion related replies reply
respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toc toolbar
widget""".split())
#: Those whose articles are not the page's own.
READERS = frozenset("comment comments discussion disqus replies reply respond".split())
#: Words that say where or in what shape something is on the page, not what.
LAYOUT = frozenset("""area bar block bottom box container element global inner left list main outer overlay page panel
primary right secondary section site top wrap wrapper""".split())
#: Words that change nothing in a name inside an article: "related posts" is boilerplate, "related work" is not.
KINDS = LAYOUT | frozenset("""actions ads article articles button buttons card content count entry form icon icons item items
label link links module news post posts prompt slot stories story text title tools unit user""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that only usually are boilerplate: one that holds most of a page's text is not.
LIFTED = frozenset("form fieldset dialog".split())
#: Linked lines in a row that do not end a run of text.
LINKS = 2
#: What a line stands in: content, boilerplate by the name of a wrapper, an article's header, boilerplate.
#: by an element or its name, and boilerplate whatever it holds.
CONTENT, WRAPPED, HEADER, BOILERPLATE, READER = range(5)
NAME_PART = re.compile(r"[a-z]+|[0-9]+")
GAPS = re.compile(r"\s+")
SIGMA, REACH = 1.5, 4


def words_of(value: str) -> list[str]:
    return NAME_PART.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())


def named(tag: str, attrs: list, section: int) -> int:
    """The standing that an element's attributes give to what is inside."""
    heading = tag in HEADINGS
    for name, value in attrs:
        if name in ("class", "id", "role") and value:
            if heading and name != "role":
                continue
            words = words_of(value)
            if name == "id" and not all(w in NAMES or w in LAYOUT or w.isdigit() for w in words):
                continue
            parts = NAMES.intersection(words)
            if section and name == "class":
                parts = set().union(*(NAMES.intersection(ws) for ws in map(words_of, value.split())
                                      if all(w in NAMES or w in KINDS or w.isdigit() for w in ws)))
                if tag == "section":
                    parts -= {"discussion"}  # of results, unless a wrapper says otherwise
            if parts:
                if section and parts == {"header"}:
                    return HEADER
                return READER if parts & READERS else BOILERPLATE if section else WRAPPED
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            return READER
        elif name == "style" and value and "display:none" in value.replace(" ", "").lower():
            return READER
    return CONTENT


class Line:
    __slots__ = ("parts", "tags", "linked", "section", "boiler", "text", "heading", "mark")

    def __init__(self, section: int, boiler: int, mark: int):
        self.parts: list[str] = []
        self.tags = self.linked = 0
        self.heading = False
        self.section, self.boiler, self.text, self.mark = section, boiler, "", mark


class Lines(HTMLParser):
    """Events to lines; the stack has (tag, silent, boilerplate, section, link, mark).  A mark is the
    nearest element around that is boilerplate only if it holds little: ``marks`` has the one
    around it, and the standing that its inside has without it."""

    def __init__(self, lifted: frozenset[int] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int, int, bool, int]] = [("", False, CONTENT, 0, False, 0)]
        self.marks: list[int] = [0]
        self.lifted = lifted
        self.open: dict[str, int] = {}
        self.kinds, self.outer = [""], [0]  # of each section: its element, the section around it
        self.lines = [Line(0, CONTENT, 0)]

    def new_line(self) -> None:
        _, silent, boiler, section, _, mark = self.stack[-1]
        if silent:
            return  # choices of a form field, for one, do not part the line that they stand in
        if self.lines[-1].parts:
            self.lines.append(Line(section, boiler, mark))
        else:
            line = self.lines[-1]
            line.section, line.boiler, line.mark = section, boiler, mark

    def handle_starttag(self, tag: str, attrs: list) -> None:
        for other in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
            if self.open.get(other) and tag in IMPLIED[other] and (not self.stack[-1][1] or other == "option"):
                self.close_near(other, tag)
        if tag in VOID:
            self.void(tag)
            return
        _, silent, boiler, section, link, mark = self.stack[-1]
        if tag in SECTIONS:
            self.kinds.append(tag)
            self.outer.append(section)
            section = len(self.outer) - 1
            if boiler == WRAPPED:
                boiler = CONTENT
        if tag in HEADINGS and boiler == HEADER:
            boiler = CONTENT
        own = CONTENT
        if tag in BOILER:
            own = HEADER if tag == "header" and section else BOILERPLATE if tag in LIFTED else READER
        if tag not in ("html", "body"):
            own = max(own, named(tag, attrs, section))
        if own in (WRAPPED, BOILERPLATE) and not silent:
            self.marks.append(mark)
            mark = len(self.marks) - 1
            if mark in self.lifted:
                own = CONTENT
        self.stack.append((tag, silent or tag in SILENT, max(boiler, own), section, link or tag == "a", mark))
        self.open[tag] = self.open.get(tag, 0) + 1
        if tag in BLOCKS:
            self.new_line()
        self.lines[-1].tags += 1

    def void(self, tag: str) -> None:
        if tag == "hr":
            self.new_line()
        self.lines[-1].tags += 1
        if tag in ("br", "wbr") and not self.stack[-1][1] and tag == "br":
            self.lines[-1].parts.append(" ")

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            self.void(tag)
        else:  # the slash means nothing in HTML
            self.handle_starttag(tag, attrs)

    def close_near(self, tag: str, opener: str) -> None:
        """An implied end tag: not through an element that may hold its own kind."""
        for i in range(len(self.stack) - 1, 0, -1):
            held = self.stack[i][0]
            if held == tag:
                self.cut(i)
                return
            if held in ("ul", "ol", "dl", "table", "select") or held in BLOCKS and held != "p" and tag != "tr":
                return

    def cut(self, i: int) -> None:
        for held in self.stack[i:]:
            self.open[held[0]] -= 1
        del self.stack[i:]
        self.new_line()

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID or not self.open.get(tag):
            if tag == "br":
                self.void("br")
            return
        inline = tag not in BLOCKS
        for i in range(len(self.stack) - 1, 0, -1):
            held = self.stack[i][0]
            if held == tag:
                if tag in CHOICES:
                    for inner in self.stack[i:]:
                        self.open[inner[0]] -= 1
                    del self.stack[i:]
                    self.relink()
                elif inline:
                    self.open[tag] -= 1
                    del self.stack[i]
                    self.relink()
                else:
                    self.cut(i)
                return
            if inline and held in BLOCKS and tag not in CHOICES:
                return

    def relink(self) -> None:
        tag, silent, boiler, section, link, mark = self.stack[-1]
        self.lines[-1].tags += 1
        if link and not self.open.get("a"):
            self.stack[-1] = (tag, silent, boiler, section, False, mark)

    def handle_data(self, data: str) -> None:
        _, silent, boiler, section, link, mark = self.stack[-1]
        if silent:
            return
        line = self.lines[-1]
        if not line.parts:
            line.section, line.boiler, line.mark = section, boiler, mark
        elif boiler != line.boiler and not data.isspace():
            self.lines.append(line := Line(section, boiler, mark))
        line.parts.append(data)
        line.heading = line.heading or any(self.open.get(h) for h in HEADINGS)
        if link:
            line.linked += len(data)


def parsed(html: str, lifted: frozenset[int] = frozenset()) -> Lines:
    parser = Lines(lifted)
    parser.feed(html)
    parser.close()
    return parser


def holding_most(parser: Lines) -> frozenset[int]:
    """Marks of the elements that hold more than half of the page's unlinked text, apart from
    what is boilerplate by nature: such a one is a wrapper, whatever it is named.  Of nested
    ones the inner is judged first, and the outer by what is left to it."""
    held = [0] * len(parser.marks)
    for line in parser.lines:
        if line.boiler != READER:
            held[line.mark] += max(0, sum(map(len, line.parts)) - line.linked)
    total = sum(held)
    lifted = set()
    for mark in range(len(held) - 1, 0, -1):
        if 2 * held[mark] > total:
            lifted.add(mark)
            held[parser.marks[mark]] += held[mark]
    return frozenset(lifted)


def lines_of(html: str) -> tuple[list[Line], set[int]]:
    """The lines with text, and the main sections; the only article in one is part of it."""
    parser = parsed(html)
    if len(parser.marks) > 1 and (lifted := holding_most(parser)):
        parser = parsed(html, lifted)
    out = []
    for line in parser.lines:
        line.text = GAPS.sub(" ", "".join(line.parts)).strip()
        if line.text:
            out.append(line)
    mains = {k for k, tag in enumerate(parser.kinds) if tag == "main"}
    inside: dict[int, set[int]] = {}
    for k in {line.section for line in out if not line.boiler}:
        if k and parser.outer[k] in mains:
            inside.setdefault(parser.outer[k], set()).add(k)
    joins = {next(iter(ks)): main for main, ks in inside.items() if len(ks) == 1}
    for line in out:
        line.section = joins.get(line.section, line.section)
    return out, mains


def ratios(lines: list[Line]) -> np.ndarray:
    """Unlinked text per tag; zero in boilerplate."""
    return np.array([0.0 if x.boiler else max(0, len(x.text) - x.linked) / max(1, x.tags) for x in lines])


def smoothed(values: np.ndarray) -> np.ndarray:
    weights = np.exp(-np.arange(-REACH, REACH + 1) ** 2 / (2 * SIGMA ** 2))
    share = np.convolve(np.ones(len(values)), weights, "full")[REACH:-REACH]
    return np.convolve(values, weights, "full")[REACH:-REACH] / share


def threshold(values: np.ndarray) -> float:
    """Between the means of the two clusters of 2-means in one dimension; below all if there is one."""
    low, high = values.min(), values.max()
    if high - low < 1e-9:
        return low - 1
    for _ in range(32):
        cut = (low + high) / 2
        new = values[values <= cut].mean(), values[values > cut].mean()
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def main_text(html: str) -> str:
    lines, mains = lines_of(html)
    if not lines:
        return ""
    score = smoothed(np.log1p(ratios(lines)))
    cut = threshold(score)
    content = [not x.boiler and s > cut and x.linked <= 0.5 * len(x.text) for x, s in zip(lines, score)]
    # regions: a section's lines together, other lines by runs between boilerplate
    regions: list[list[int]] = []
    by_section: dict[int, int] = {}
    run, links = None, []  # linked lines between two lines of a run belong to it, if they are few
    for i, line in enumerate(lines):
        if line.boiler:
            run, links = None, []
        elif not line.section and line.linked > 0.5 * len(line.text):
            links.append(i)
            if len(links) > LINKS:
                run = None
        elif line.section:
            if line.section not in by_section:
                by_section[line.section] = len(regions)
                regions.append([])
            regions[by_section[line.section]].append(i)
        else:
            if run is None:
                run, links = len(regions), []
                regions.append([])
            regions[run] += [*links, i]
            links = []
    weights = [sum(len(lines[i].text) for i in r if content[i]) for r in regions]
    if not weights:
        return ""
    if not max(weights):  # nothing stands out: what is not boilerplate, sections first
        weights = [sum(len(lines[i].text) for i in r) * (2 if lines[r[0]].section else 1) for r in regions]
    best = max(range(len(regions)), key=lambda k: (bool(lines[regions[k][0]].section), weights[k]))
    in_sections = bool(lines[regions[best][0]].section)
    linked = [x.linked > 0.5 * len(x.text) for x in lines]
    chosen: set[int] = set()
    for r, w in zip(regions, weights):
        section = lines[r[0]].section
        if bool(section) != in_sections:
            continue
        if r is regions[best] or w >= 0.5 * weights[best] or not in_sections and w:
            chosen.update(r)
        elif section in mains:
            chosen.update(i for i in r if not linked[i])
        elif in_sections and not linked[r[-1]] and not any(linked[i] and lines[i].heading for i in r):
            chosen.update(r)
    if not in_sections:  # what lies between content lines, with no boilerplate between, is text too
        before = None
        for i, line in enumerate(lines):
            if line.boiler:
                before = None
            elif content[i]:
                if before is not None:
                    chosen.update(range(before, i))
                before = i
    return "\n".join(lines[i].text for i in sorted(chosen))


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    source = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"),
                          F.coalesce(F.col(html), F.lit("")).alias("html"))
    schema = StructType([source.schema["page_id"], source.schema["url"], StructField("text", StringType()),
                         StructField("n_chars", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], schema.names)

    return source.mapInArrow(run, schema)
