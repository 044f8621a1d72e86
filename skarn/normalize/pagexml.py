"""Page XML to the semantic tree, and the hierarchy XML to rows."""

from __future__ import annotations

import xml.etree.ElementTree as ET

from skarn.normalize import html, model

#: Elements that have no form in other formats, and what they are called (fixed values).
PLACEHOLDERS = {
    "InkDrawing": "ink", "InkParagraph": "ink", "InkWord": "ink", "MediaFile": "media", "FutureObject": "unknown-object",
    "EmbeddedPrintout": "printout", "PrintoutFile": "printout",
}
#: Elements that describe a line and are no content of it (fixed values).
DESCRIBING = ("List", "Tag", "MediaIndex", "Meta")


def local(element: ET.Element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def children(element: ET.Element, *names: str) -> list[ET.Element]:
    return [c for c in element if local(c) in names]


def references(root: ET.Element) -> dict[int, str]:
    """``image:N`` and ``file:N`` in document order, from 1."""
    counts, out = {"image": 0, "file": 0}, {}
    for element in root.iter():
        kind = {"Image": "image", "InsertedFile": "file"}.get(local(element))
        if kind:
            counts[kind] += 1
            out[id(element)] = f"{kind}:{counts[kind]}"
    return out


class PageReader:
    """Blocks of a page; methods that go down are generators for ``model.unwound``."""

    def __init__(self, root: ET.Element, resources: dict[str, str]):
        self.resources, self.refs, self.warnings = resources, references(root), []

    def outline(self, element: ET.Element):
        out: list[dict] = []
        for group in children(element, "OEChildren"):
            out += yield self.lines(children(group, "OE"))
        return out

    def lines(self, elements: list[ET.Element]):
        """Neighbouring list lines make one list.

        Bullets and numbers in turn make a new one; a task without a mark of its own joins the list that is open.
        """
        out: list[dict] = []
        listed = None  # whether the last block is an open list, and if it is ordered
        for oe in elements:
            marker = next(iter(children(oe, "List")), None)
            states = [t.attrib["completed"] == "true" for t in children(oe, "Tag") if "completed" in t.attrib]
            own = yield self.line(oe)
            if marker is None and not states:
                listed = None
                out += own
                continue
            ordered = marker is not None and bool(children(marker, "Number"))
            if listed is None or (marker is not None and listed != ordered):
                out.append({"kind": "list", "ordered": ordered, "items": []})
                listed = ordered
            out[-1]["items"].append({"kind": "list_item", "checked": states[0] if states else None, "children": own})
        return out

    def line(self, oe: ET.Element):
        out: list[dict] = []
        for child in oe:
            kind = local(child)
            if kind == "T":
                text, hrefs, spans, others = html.fragment(child.text or "", self.resources)
                if text or hrefs:
                    out.append(model.textual("paragraph", text, hrefs, spans))
                out += others
            elif kind == "Image":
                ref = self.refs[id(child)]
                out.append({"kind": "image", "hash": self.resources.get(ref), "alt": model.block_text(child.attrib.get("alt", "")), "reference": ref})
            elif kind == "InsertedFile":
                ref = self.refs[id(child)]
                out.append({"kind": "attachment", "hash": self.resources.get(ref), "name": child.attrib.get("preferredName", ""), "reference": ref})
            elif kind == "Table":
                rows = []
                for row in children(child, "Row"):
                    cells = []
                    for cell in children(row, "Cell"):
                        cells.append({"kind": "cell", "children": (yield self.outline(cell))})
                    rows.append(cells)
                out.append({"kind": "table", "rows": rows})
            elif kind == "OEChildren":
                out += yield self.lines(children(child, "OE"))
            elif kind in PLACEHOLDERS:
                out.append({"kind": "placeholder", "object": PLACEHOLDERS[kind]})
            elif kind not in DESCRIBING:
                out.append({"kind": "unsupported", "tag": kind})
                self.warnings.append(f"unsupported element: {kind}")
        return out


def parse(xml: str, resources: dict[str, str] | None = None) -> tuple[dict, list[str]]:
    """The tree of a page's outlines, without its title, and warnings; an empty tree where the XML is broken.

    Markup that declares a document type or entities is not read: it can only be an attack on the parser.
    """
    if not xml:
        return model.doc([]), []
    if "<!DOCTYPE" in xml or "<!ENTITY" in xml:
        return model.doc([]), ["page XML cannot be parsed: it declares a document type"]
    try:
        root = ET.fromstring(xml)
    except ET.ParseError as error:
        return model.doc([]), [f"page XML cannot be parsed: {error}"]
    reader = PageReader(root, resources or {})
    found: list[dict] = []
    for outline in children(root, "Outline"):
        found += model.unwound(reader.outline(outline))
    return model.doc(found), reader.warnings


def hierarchy(xml: str) -> list[dict]:
    """One row a page: ids, titles, groups, level, order in its section, times, recycle flag."""
    rows: list[dict] = []

    def visit(element: ET.Element, notebook: dict, groups: list[str], recycled: bool) -> None:
        for child in element:
            kind, own = local(child), child.attrib
            gone = recycled or own.get("isRecycleBin") == "true" or own.get("isInRecycleBin") == "true"
            if kind == "SectionGroup":
                visit(child, notebook, [*groups, own.get("name", "")], gone)
            elif kind == "Section":
                pages = [p for p in child if local(p) == "Page" and p.attrib.get("ID")]
                for order, page in enumerate(pages):
                    rows.append(
                        notebook | {
                            "section_id": own.get("ID", ""), "section_title": own.get("name", ""), "groups": groups,
                            "page_id": page.attrib["ID"], "page_title": page.attrib.get("name", ""),
                            "page_level": int(page.attrib.get("pageLevel", 1)), "page_order": order,
                            "created_at": page.attrib.get("dateTime"), "updated_at": page.attrib.get("lastModifiedTime"),
                            "in_recycle_bin": gone or page.attrib.get("isInRecycleBin") == "true",
                        }
                    )

    for book in (e for e in ET.fromstring(xml).iter() if local(e) == "Notebook"):
        visit(book, {"notebook_id": book.attrib.get("ID", ""), "notebook_title": book.attrib.get("name", "")}, [], False)
    return rows
