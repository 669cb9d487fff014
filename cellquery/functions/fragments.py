"""HTML reading for one string at a time, used inside pandas UDFs only.

Two readers share one element stack: an end tag closes everything above its start tag, an end tag
without a start is ignored, and whatever is still open at the end is closed there.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from html import unescape
from html.parser import HTMLParser

# Elements without content, and elements whose text is not page text.
VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
    "track", "wbr",
}
RAW_TEXT = {"script", "style"}
SILENT = {"script", "style", "template"}

#: Elements whose content no version of Python's parser reads as markup, or not all.
OPAQUE = {
    "script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext",
}

#: Plain tags: names of letters and digits, values in double quotes and without entities.
_TAG = re.compile(
    r'<(?:([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n\r\f]+[a-zA-Z][-a-zA-Z0-9_]*="[^"&]*")*)[ \t\n\r\f]*>'
    r"|/([a-zA-Z][a-zA-Z0-9]*)[ \t\n\r\f]*>)"
)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_VALUE = re.compile(r'([a-zA-Z][-a-zA-Z0-9_]*)="([^"]*)"')
_TABLE = re.compile("<table", re.IGNORECASE)
_SPACE = re.compile(r"\s")
_CELL_SPACE = re.compile(r"[\r\n]+|\s{2,}")


def _escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


class _Elements(HTMLParser):
    """Calls ``on_open`` and ``on_close`` in balanced pairs, ``on_text`` between them.

    Plain tags and the text between them are read here, which takes a fraction of the parser's time;
    any other tag or comment is left to the parser, and so is all that follows what it can't end.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.count: defaultdict = defaultdict(int)

    def read(self, html: str):
        self.feed(html[self._read_plain(html) :])
        self.close()
        while self.stack:
            self._pop()
        return self

    def _read_plain(self, html: str) -> int:
        """Read up to what only the parser can; where that starts."""
        at, end = 0, len(html)
        while at < end:
            mark = html.find("<", at)
            if mark != at:
                data = html[at:] if mark < 0 else html[at:mark]
                self.on_text(unescape(data) if "&" in data else data)
                if mark < 0:
                    return end
            tag = _TAG.match(html, mark)
            if tag is None:
                at = self._read_other(html, mark)
                if at < 0:
                    return mark
            elif name := tag[3]:
                self.handle_endtag(name.lower())
                at = tag.end()
            elif (name := tag[1].lower()) not in OPAQUE:
                self.handle_starttag(name, [(k.lower(), v) for k, v in _VALUE.findall(tag[2])] if tag[2] else [])
                at = tag.end()
            else:
                return mark
        return end

    def _read_other(self, html: str, mark: int) -> int:
        """The end of an unusual tag or a comment, read by the parser; negative where it stays with it."""
        name = _NAME.match(html, mark)
        if html.startswith("<!--", mark):
            read = self.parse_comment
        elif name is None or name[1].lower() in OPAQUE:
            return -1
        else:
            read = self.parse_endtag if html[mark + 1] == "/" else self.parse_starttag
        self.rawdata = html
        try:
            return read(mark)
        finally:
            self.rawdata = ""

    def _pop(self) -> str:
        name = self.stack.pop()
        self.count[name] -= 1
        self.on_close(name)
        return name

    def handle_starttag(self, tag, attrs):
        self.on_open(tag, attrs)
        if tag not in VOID:
            self.stack.append(tag)
            self.count[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._pop()

    def handle_endtag(self, tag):
        while self.count[tag]:
            if self._pop() == tag:
                break

    def handle_data(self, data):
        self.on_text(data)

    def updatepos(self, i, j):
        return j  # line numbers are not used

    def on_open(self, tag, attrs): ...

    def on_close(self, tag): ...

    def on_text(self, data): ...


class ParagraphTexts(_Elements):
    """Text of every ``p`` element in order of their start tags; an inner ``p`` counts for both."""

    def __init__(self) -> None:
        super().__init__()
        self.texts: list[list[str]] = []
        self.open: list[list[str]] = []
        self.silent = 0

    def on_open(self, tag, attrs):
        if tag == "p":
            self.texts.append([])
            self.open.append(self.texts[-1])
        self.silent += tag in SILENT

    def on_close(self, tag):
        if tag == "p":
            self.open.pop()
        self.silent -= tag in SILENT

    def on_text(self, data):
        if not self.silent:
            for text in self.open:
                text.append(data)


class _Table:
    """Rows of one ``table`` element as they arrive, then its header and body as text grids."""

    def __init__(self) -> None:
        self.rows = {"thead": [], "tbody": [], "tfoot": []}
        self.part = "tbody"
        self.row: list | None = None
        self.cell: dict | None = None

    def start_part(self, part: str) -> None:
        self.end_row()
        self.part = part

    def start_row(self) -> None:
        self.end_row()
        self.row = []
        self.rows[self.part].append(self.row)

    def start_cell(self, tag: str, attrs: dict) -> None:
        self.end_cell()
        if self.row is None:
            self.start_row()
        self.cell = {
            "th": tag == "th",
            "text": [],
            "across": _span(attrs.get("colspan")),
            "down": _span(attrs.get("rowspan")),
        }
        self.row.append(self.cell)

    def end_cell(self) -> None:
        self.cell = None

    def end_row(self) -> None:
        self.end_cell()
        self.row = None

    def result(self) -> dict | None:
        head, body = self.rows["thead"], self.rows["tbody"]
        if not head:
            lead = 0
            while lead < len(body) and all(c["th"] for c in body[lead]):
                lead += 1
            head, body = body[:lead], body[lead:]
        head, body = _grid(head), _grid(body) + _grid(self.rows["tfoot"])
        width = max((len(r) for r in head + body), default=0)
        if not any(text for row in head + body for text in row):
            return None
        head = [r + [""] * (width - len(r)) for r in head]
        body = [r + [""] * (width - len(r)) for r in body]
        if width == 1:
            body = [r for r in body if r[0].strip()]
        return {"header": column_names(head, width), "rows": body}


def _span(value: str | None) -> int:
    return int(value) if value and value.strip().isdigit() and int(value) > 0 else 1


def _cell_text(pieces: list[str]) -> str:
    return _CELL_SPACE.sub(" ", "".join(pieces).strip())


def _grid(rows: list) -> list[list[str]]:
    """Text rows with row and column spans copied out; spans past the last row make rows of their own."""
    if all(cell["across"] == 1 and cell["down"] == 1 for row in rows for cell in row):
        return [[_cell_text(cell["text"]) for cell in row] for row in rows]
    grid, below = [], {}
    pending = rows[::-1]
    while pending or below:
        carried, below, line = below, {}, []

        def place(text: str, more: int) -> None:
            if more > 0:
                below[len(line)] = (text, more)
            line.append(text)

        for cell in pending.pop() if pending else []:
            while len(line) in carried:
                text, more = carried.pop(len(line))
                place(text, more - 1)
            text = _cell_text(cell["text"])
            for _ in range(cell["across"]):
                place(text, cell["down"] - 1)
        for at in sorted(carried):
            text, more = carried[at]
            place(text, more - 1)
        grid.append(line)
    return grid


def column_names(head: list[list[str]], width: int) -> list[str]:
    """Names from the header rows: levels joined by a space, blanks ``Unnamed: k``, repeats ``.1``."""
    if not head:
        return [str(k) for k in range(width)]
    levels = head if len(head) == 1 else [row for row in head if any(row)]
    seen: Counter = Counter()
    names: dict[str, None] = {}
    for k in range(width):
        name = " ".join(dict.fromkeys(row[k] for row in levels if row[k])) or f"Unnamed: {k}"
        fresh = name
        while fresh in names:
            seen[name] += 1
            fresh = f"{name}.{seen[name]}"
        names[fresh] = None
    return list(names)


class SectionReader(_Elements):
    """A fragment without its citation marks, written out again if asked for, and the tables in it."""

    def __init__(self, written: bool = True) -> None:
        super().__init__()
        self.written = written
        self.out: list[str] = []
        self.removed = 0
        self.hidden = 0
        self.open_tables: list[_Table] = []
        self.tables: list[_Table] = []

    @property
    def html(self) -> str:
        return "".join(self.out)

    def grids(self) -> list[dict]:
        return [g for g in (t.result() for t in self.tables) if g]

    def on_open(self, tag, attrs):
        if self.removed:
            self.removed += tag not in VOID
            return
        values = {k: v or "" for k, v in attrs} if attrs else {}
        classes = values["class"].split() if "class" in values else ()
        citation = "cite-bracket" in classes or (tag == "sup" and "reference" in classes)
        if citation:
            self.removed += tag not in VOID
            return
        if self.written:
            self.out.append(_start_tag(tag, attrs))
        unseen = tag in SILENT or ("style" in values and "display:none" in _SPACE.sub("", values["style"]))
        if self.hidden or unseen:
            self.hidden += tag not in VOID
            return
        if tag == "table":
            self.tables.append(_Table())
            self.open_tables.append(self.tables[-1])
        elif self.open_tables:
            table = self.open_tables[-1]
            if tag in table.rows:
                table.start_part(tag)
            elif tag == "tr":
                table.start_row()
            elif tag in ("td", "th"):
                table.start_cell(tag, values)
            elif tag == "br":
                self._cell_text("\n")

    def on_close(self, tag):
        if self.removed:
            self.removed -= 1
            return
        if self.written:
            self.out.append(f"</{tag}>")
        if self.hidden:
            self.hidden -= 1
        elif self.open_tables:
            table = self.open_tables[-1]
            if tag == "table":
                self.open_tables.pop()
            elif tag in table.rows:
                table.start_part("tbody")
            elif tag == "tr":
                table.end_row()
            elif tag in ("td", "th"):
                table.end_cell()

    def on_text(self, data):
        if self.removed:
            return
        if self.written:
            raw = self.stack and self.stack[-1] in RAW_TEXT
            self.out.append(data if raw else _escape(data))
        if not self.hidden:
            self._cell_text(data)

    def _cell_text(self, data: str) -> None:
        for table in self.open_tables:
            if table.cell is not None:
                table.cell["text"].append(data)

    def handle_comment(self, data):
        if self.written and not self.removed:
            self.out.append(f"<!--{data}-->")


def grids(html: str) -> list[dict]:
    """The tables of a fragment alone; one without a table's tag is not read at all."""
    return SectionReader(written=False).read(html).grids() if _TABLE.search(html) else []


def _start_tag(tag: str, attrs: list) -> str:
    if not attrs:
        return f"<{tag}/>" if tag in VOID else f"<{tag}>"
    parts = [tag]
    for name, value in attrs:
        if value is None:
            parts.append(name)
        elif '"' in value and "'" not in value:
            parts.append(f"{name}='{_escape(value)}'")
        else:
            parts.append(f'{name}="{_escape(value).replace(chr(34), "&quot;")}"')
    return f"<{' '.join(parts)}{'/' if tag in VOID else ''}>"
