"""Markdown bodies to the semantic tree: headings, paragraphs, lists, tasks, tables, code, quotes, HTML
blocks, and inline links, images, code, emphasis, strikethrough and breaks."""

from __future__ import annotations

import html as entities
import re

from skarn.normalize import html, model

HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
FENCE = re.compile(r" {0,3}(`{3,}|~{3,})[ \t]*([^`\n]*)$")
ITEM = re.compile(r"( {0,3})([-*+]|\d{1,9}[.)])([ \t]+|$)")
QUOTE = re.compile(r" {0,3}> ?")
SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
DIVIDER = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
#: Elements that begin an HTML block wherever a line begins with their tag (fixed values).
BLOCK_NAMES = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search "
    "section summary table tbody td tfoot th thead title tr track ul"
).split()
BLOCK_TAG = re.compile(rf" {{0,3}}</?(?:{'|'.join(BLOCK_NAMES)})(?:[ \t]|/?>|$)", re.IGNORECASE)
#: Openings of HTML blocks that end with a line that holds their end, and that end.
RAW = [
    (re.compile(r" {0,3}<(?:script|pre|style|textarea)(?:[ \t>]|$)", re.IGNORECASE), re.compile(r"</(?:script|pre|style|textarea)>", re.IGNORECASE)),
    (re.compile(r" {0,3}<!--"), re.compile("-->")), (re.compile(r" {0,3}<\?"), re.compile(r"\?>")),
    (re.compile(r" {0,3}<!\[CDATA\["), re.compile(r"\]\]>")), (re.compile(r" {0,3}<![A-Za-z]"), re.compile(">")),
]
LONE_TAG = re.compile(r""" {0,3}(?:<[a-zA-Z][a-zA-Z0-9-]*(?:\s+[a-zA-Z_:][\w.:-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?)*\s*/?>|</[a-zA-Z][a-zA-Z0-9-]*\s*>)[ \t]*$""")
TASK = re.compile(r"\[([ xX])\][ \t]+")
INLINE = re.compile(
    r"\\([!-/:-@\[-`{-~])"  # 1: escaped mark
    r"|(`+)(.+?)(?<!`)\2(?!`)"  # 2, 3: code
    r"|<([a-zA-Z][a-zA-Z0-9+.-]{1,31}:[^\s<>]*)>"  # 4: autolink
    r"|(</?[a-zA-Z][^<>]*>|<!--.*?-->)"  # 5: inline HTML
    r"|(?: {2,}|\\)\n"  # hard break
    r"|(\n)"  # 6: soft break
    r"|(!?)\[((?:[^\[\]\\]|\\.|\[[^\[\]]*\])*)\]\(\s*(<[^<>\n]*>|[^\s()]*(?:\([^\s()]*\)[^\s()]*)*)(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?\s*\)"  # 7-9
    r"|(\*+|_+|~~)",  # 10: emphasis
    re.DOTALL,
)


def inline(text: str, resources: dict[str, str], href: str = "") -> tuple[list[tuple[str, str]], list[dict], list[str]]:
    """Runs (text, href), the media between them, and link targets in order."""
    runs: list[tuple[str, str]] = []
    media: list[dict] = []
    hrefs: list[str] = []
    at = 0
    marks: list[str] = []
    for m in INLINE.finditer(text):
        runs.append((entities.unescape(text[at : m.start()]), href))
        at = m.end()
        if m[1]:
            runs.append((m[1], href))
        elif m[2]:
            runs.append((m[3].replace("\n", " "), href))
        elif m[4]:
            hrefs.append(m[4])
            runs.append((m[4], m[4]))
        elif m[5]:
            _, targets, _, found = html.fragment(m[5], resources)  # one tag: it holds no text
            if m[5].lower().startswith("<br"):
                runs.append(("\n", href))
            hrefs += targets
            media += found
        elif m[6]:
            runs.append((" ", href))
        elif m[9] is not None:
            target = entities.unescape(m[9].strip("<>"))
            inner, found, targets = inline(m[8], resources, target)
            label = model.inline_text("".join(t for t, _ in inner))
            if m[7]:
                known = resources.get(target.removeprefix(":/"))
                media.append({"kind": "image", "hash": known, "alt": label, "reference": target})
            elif target.startswith(":/") and not found:
                known = resources.get(target[2:])
                media.append({"kind": "attachment", "hash": known, "name": label, "reference": target})
            else:
                hrefs += ([target] if target else []) + targets
                runs += inner
                media += found
        elif m[10]:
            left = text[m.start() - 1 : m.start()]
            right = text[m.end() : m.end() + 1]
            word = m[10][0] == "_" and left.isalnum() and right.isalnum()
            opens, closes = bool(right.strip()), bool(left.strip())
            if word or not (opens or closes):
                runs.append((m[10], href))
            elif closes and m[10] in marks:
                while marks.pop() != m[10]:
                    pass
            elif opens and m[10] in text[m.end() :]:
                marks.append(m[10])
            else:
                runs.append((m[10], href))
        else:
            runs.append(("\n", href))
    runs.append((entities.unescape(text[at:]), href))
    return runs, media, hrefs


def textual(text: str, resources: dict[str, str], level: int = 0) -> list[dict]:
    runs, media, hrefs = inline(text.strip(), resources)
    value, spans = model.text_with_spans(runs)
    out = []
    if value or hrefs or level:
        more = {"level": level} if level else {}
        out.append(model.textual("heading" if level else "paragraph", value, hrefs, spans, **more))
    return out + media


def cells(line: str) -> list[str]:
    parts = re.split(r"(?<!\\)\|", line.strip())
    if parts and not parts[0].strip():
        parts = parts[1:]
    if parts and not parts[-1].strip():
        parts = parts[:-1]
    return [p.strip().replace("\\|", "|") for p in parts]


def html_block(lines: list[str], k: int, in_paragraph: bool) -> int:
    """The line after the HTML block that begins at line k; k if none does."""
    for opening, ending in RAW:
        if opening.match(lines[k]):
            end = k
            while end < len(lines) and not ending.search(lines[end]):
                end += 1
            return min(end + 1, len(lines))
    end = k
    if BLOCK_TAG.match(lines[k]) or (not in_paragraph and LONE_TAG.match(lines[k])):
        while end < len(lines) and lines[end].strip():
            end += 1
    return end


def blocks(lines: list[str], resources: dict[str, str]) -> list[dict]:
    out: list[dict] = []
    paragraph: list[str] = []

    def close(level: int = 0) -> None:
        if paragraph:
            out.extend(textual("\n".join(line.lstrip() for line in paragraph), resources, level))
            paragraph.clear()

    k = 0
    while k < len(lines):
        line = lines[k]
        if not line.strip():
            close()
            k += 1
        elif m := FENCE.match(line):
            close()
            end = k + 1
            stop = re.compile(rf" {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}[ \t]*$")
            while end < len(lines) and not stop.match(lines[end]):
                end += 1
            out.append({"kind": "code", "language": m[2].strip(), "text": model.block_text("\n".join(lines[k + 1 : end]))})
            k = end + 1
        elif m := HEADING.match(line):
            close()
            out.extend(textual(m[2] or "", resources, len(m[1])))
            k += 1
        elif paragraph and (m := SETEXT.match(line)):
            close(1 if m[1][0] == "=" else 2)
            k += 1
        elif RULE.match(line):
            close()
            k += 1
        elif QUOTE.match(line):
            close()
            end = k
            while end < len(lines) and lines[end].strip():
                end += 1
            out.extend(blocks([QUOTE.sub("", x, count=1) for x in lines[k:end]], resources))
            k = end
        elif (m := ITEM.match(line)) and (not paragraph or m[3].strip("\n") and m[2] in "-*+1.1)"):
            close()
            k = list_from(lines, k, out, resources)
        elif k + 1 < len(lines) and "|" in line and DIVIDER.match(lines[k + 1]) and len(cells(lines[k + 1])) == len(cells(line)):
            close()
            rows, width, end = [cells(line)], len(cells(line)), k + 2
            while end < len(lines) and lines[end].strip() and "|" in lines[end]:
                rows.append((cells(lines[end]) + [""] * width)[:width])
                end += 1
            out.append({"kind": "table", "rows": [[{"kind": "cell", "children": textual(c, resources)} for c in row] for row in rows]})
            k = end
        elif (end := html_block(lines, k, bool(paragraph))) > k:
            close()
            out.extend(html.parse("\n".join(lines[k:end]), resources)["children"])
            k = end
        elif not paragraph and line.startswith("    "):
            end = k
            while end < len(lines) and (lines[end].startswith("    ") or not lines[end].strip()):
                end += 1
            out.append({"kind": "code", "language": "", "text": model.block_text("\n".join(x[4:] for x in lines[k:end]))})
            k = end
        else:
            paragraph.append(line)
            k += 1
    close()
    return out


def list_from(lines: list[str], k: int, out: list[dict], resources: dict[str, str]) -> int:
    """Reads a list that begins at line k; returns the line after it."""
    first = ITEM.match(lines[k])
    mark = first[2][-1]
    items = []
    while k < len(lines) and (m := ITEM.match(lines[k])) and m[2][-1] == mark:
        inside = len(m[0]) if len(m[3]) <= 4 and m[3] else len(m[1]) + len(m[2]) + 1
        own = [lines[k][inside:]]
        k += 1
        while k < len(lines):
            line = lines[k]
            indent = len(line) - len(line.lstrip(" "))
            if not line.strip():
                rest = next((x for x in lines[k:] if x.strip()), "")
                if len(rest) - len(rest.lstrip(" ")) < inside:
                    break
                own.append("")
            elif indent >= inside:
                own.append(line[inside:])
            elif ITEM.match(line) or not own[-1].strip() or HEADING.match(line) or FENCE.match(line) or RULE.match(line):
                break
            else:
                own.append(line.lstrip())
            k += 1
        task = TASK.match(own[0])
        if task:
            own[0] = own[0][task.end() :]
        items.append({"kind": "list_item", "checked": task[1] in "xX" if task else None, "children": blocks(own, resources)})
        while k < len(lines) and not lines[k].strip():
            after = next((x for x in lines[k:] if x.strip()), "")
            following = ITEM.match(after)
            if not following or following[2][-1] != mark:
                break
            k += 1
    out.append({"kind": "list", "ordered": mark in ".)", "items": items})
    return k


def parse(text: str, resources: dict[str, str] | None = None) -> dict:
    lines = (text or "").replace("\r\n", "\n").replace("\r", "\n").expandtabs(4).split("\n")
    return model.doc(blocks(lines, resources or {}))
