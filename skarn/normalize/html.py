"""HTML bodies to the semantic tree, on a small tree builder over the standard parser.

Rules of recovery: void elements have no content, an end tag closes what is open up to its element, and one without an open
element is ignored; nothing is closed by implication, so that unclosed paragraphs nest.
"""

from __future__ import annotations

from html.parser import HTMLParser

from skarn.normalize import model

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style head meta link title iframe object embed".split())
BLOCKS = frozenset("p div section article blockquote figure details summary".split())


class Element:
    """``box`` and ``picture``: the first checkbox and image below, which the builder finds on its way."""

    __slots__ = ("attrs", "box", "children", "name", "picture")

    def __init__(self, name: str, attrs: dict | None = None):
        self.name, self.attrs, self.children = name, attrs or {}, []
        self.box: Element | None = None
        self.picture: Element | None = None

    def find_all(self, *names: str):
        """All elements of these names below, in document order."""
        stack = list(reversed(self.children))
        while stack:
            now = stack.pop()
            if isinstance(now, Element):
                if now.name in names:
                    yield now
                stack.extend(reversed(now.children))

    def text(self) -> str:
        out, stack = [], list(reversed(self.children))
        while stack:
            now = stack.pop()
            if isinstance(now, str):
                out.append(now)
            else:
                stack.extend(reversed(now.children))
        return "".join(out)


class Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("")
        self.open = [self.root]

    def add(self, tag, attrs) -> Element:
        element = Element(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(element)
        kind = "picture" if tag == "img" else "box" if tag == "input" and element.attrs.get("type") == "checkbox" else None
        if kind:
            for outer in reversed(self.open):
                if getattr(outer, kind) is not None:
                    break  # and so have all around it
                setattr(outer, kind, element)
        return element

    def handle_starttag(self, tag, attrs):
        element = self.add(tag, attrs)
        if tag not in VOID:
            self.open.append(element)

    def handle_startendtag(self, tag, attrs):
        self.add(tag, attrs)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].name == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        self.open[-1].children.append(data)


def build(html: str) -> Element:
    builder = Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


class Reader:
    """Blocks of an element's children; text and links between blocks gather in one run.

    Methods that go down the tree are generators for ``model.unwound``, so that bodies may nest to any depth.
    """

    def __init__(self, resources: dict[str, str]):
        self.resources = resources
        self.out: list[dict] = []
        self.run: list[tuple[str, str]] = []
        self.hrefs: list[str] = []

    def flush(self, level: int = 0) -> None:
        """The run as a block; a link without any text is a block too."""
        text, spans = model.text_with_spans(self.run)
        hrefs, self.run, self.hrefs = self.hrefs, [], []
        if text or hrefs:
            more = {"level": level} if level else {}
            self.out.append(model.textual("heading" if level else "paragraph", text, hrefs, spans, **more))

    def nested(self, element: Element):
        inner = Reader(self.resources)
        for child in element.children:
            yield inner.block(child)
        inner.flush()
        return inner.out

    def block(self, node):
        if isinstance(node, str):
            self.run.append((node, ""))
            return
        name = node.name
        if name in SKIPPED:
            return
        if len(name) == 2 and name[0] == "h" and name[1] in "123456":
            self.flush()
            yield self.inside(node, "")
            self.flush(int(name[1]))
        elif name == "br":
            self.run.append(("\n", ""))
        elif name == "hr":
            self.flush()
        elif name in ("ul", "ol"):
            self.flush()
            self.out.append((yield self.list_of(node)))
        elif name == "table":
            self.flush()
            self.out.append((yield self.table_of(node)))
        elif name == "pre":
            self.flush()
            code = next(node.find_all("code"), None)
            classes = (code.attrs.get("class", "") if code else "").split()
            language = next((c[9:] for c in classes if c.startswith("language-")), "")
            self.out.append({"kind": "code", "language": language, "text": model.block_text((code or node).text())})
        elif name == "img":
            self.flush()
            self.out.append(self.image(node))
        elif name in BLOCKS:
            self.flush()
            self.out += yield self.nested(node)
        elif name == "a":
            yield self.link(node)
        else:
            yield self.inside(node, "")

    def inside(self, element: Element, href: str):
        """Inline content; blocks in it are flattened without a break, and an image ends the paragraph before it."""
        for child in element.children:
            if isinstance(child, str):
                self.run.append((child, href))
            elif child.name in SKIPPED:
                continue
            elif child.name == "br":
                self.run.append(("\n", href))
            elif child.name == "img":
                self.flush()
                self.out.append(self.image(child))
            elif child.name == "a":
                yield self.link(child)
            else:
                yield self.inside(child, href)

    def link(self, element: Element):
        href = element.attrs.get("href", "").strip()
        if href.startswith(":/") and element.picture is None:
            self.flush()
            name = model.inline_text(element.text())
            self.out.append({"kind": "attachment", "hash": self.resources.get(href[2:]), "name": name, "reference": href})
        else:
            if href:
                self.hrefs.append(href)
            yield self.inside(element, href)

    def image(self, element: Element) -> dict:
        source = element.attrs.get("src", "").strip()
        found = self.resources.get(source.removeprefix(":/"))
        return {"kind": "image", "hash": found, "alt": model.inline_text(element.attrs.get("alt", "")), "reference": source}

    def list_of(self, element: Element):
        items = []
        for li in element.children:
            if isinstance(li, Element) and li.name == "li":
                box, task = li.box, "task-list-item" in li.attrs.get("class", "").split()
                checked = None if box is None and not task else box is not None and "checked" in box.attrs
                items.append({"kind": "list_item", "checked": checked, "children": (yield self.nested(li))})
        return {"kind": "list", "ordered": element.name == "ol", "items": items}

    def table_of(self, element: Element):
        rows = []
        stack = list(reversed(element.children))
        while stack:  # rows of this table, not of one inside a cell; a row without cells is none
            now = stack.pop()
            if not isinstance(now, Element) or now.name == "table":
                continue
            if now.name == "tr":
                cells = []
                for c in now.children:
                    if isinstance(c, Element) and c.name in ("td", "th"):
                        cells.append({"kind": "cell", "children": (yield self.nested(c))})
                if cells:
                    rows.append(cells)
            stack.extend(reversed(now.children))
        return {"kind": "table", "rows": rows}


def parse(html: str, resources: dict[str, str] | None = None) -> dict:
    """The tree of an HTML body, or of the whole text where it has none."""
    root = build(html)
    body = next(root.find_all("body"), root)
    return model.doc(model.unwound(Reader(resources or {}).nested(body)))


def fragment(html: str, resources: dict[str, str] | None = None) -> tuple[str, list[str], list[dict], list[dict]]:
    """Text of a piece of HTML (its paragraphs and headings, a line each), its links, their spans, and all other blocks."""
    lines, hrefs, spans, others, at = [], [], [], [], 0
    for block in model.unwound(Reader(resources or {}).nested(build(html))):
        if block["kind"] not in ("paragraph", "heading"):
            others.append(block)
            continue
        hrefs += block["links"]
        if block["text"]:
            spans += [span | {"start": span["start"] + at, "end": span["end"] + at} for span in block["link_spans"]]
            lines.append(block["text"])
            at += len(block["text"]) + 1
    return "\n".join(lines), hrefs, spans, others
