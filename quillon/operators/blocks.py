"""Top-level Markdown blocks of a stream of lines.

A page's lines pass one after the other; what is kept between two lines is the open block and, of a list or quote, where its content begins and
whether a paragraph is open in it. So a page of any length takes constant memory, and no line is looked at twice. Only the outermost blocks are told apart: what
stands in a list item or a quote belongs to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# The element names that begin a block of HTML, and those whose block ends with their own end tag.
HTML_BLOCKS = set("address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul".split())
HTML_WHOLE = ("script", "pre", "style", "textarea")
HTML_ENDS = [("<!--", "-->"), ("<?", "?>"), ("<![cdata[", "]]>")]
CODE_INDENT = 4
# A line that begins or ends a container, one that only ends it, a heading: white space and ends of a line are those of Java's patterns.
CONTAINER = re.compile("/{3,}(?:\\s|[\x85\u2028\u2029]?\\Z)", re.ASCII)
CONTAINER_END = re.compile("/{3,}\\s*[\x85\u2028\u2029]?\\Z", re.ASCII)
HEADING = re.compile(r"#{1,6}\s+\S", re.ASCII)


def indent_of(line: str) -> tuple[int, str]:
    """Columns of white space a line begins with (a tab goes to the next multiple of four), and the rest."""
    columns, at = 0, 0
    for c in line:
        if c == " ":
            columns += 1
        elif c == "\t":
            columns += CODE_INDENT - columns % CODE_INDENT
        else:
            break
        at += 1
    return columns, line[at:].rstrip()


def heading_level(body: str) -> int:
    size = len(body) - len(body.lstrip("#"))
    return size if 1 <= size <= 6 and body[size : size + 1] in ("", " ", "\t") else 0


def fence_of(body: str) -> tuple[str, int] | None:
    """(sign, size) of an opening fence."""
    sign = body[:1]
    size = len(body) - len(body.lstrip(sign)) if sign in ("`", "~") and sign else 0
    return (sign, size) if size >= 3 and not (sign == "`" and "`" in body[size:]) else None


def closes(body: str, fence: tuple[str, int]) -> bool:
    return len(body) >= fence[1] and not body.strip(fence[0])


def is_rule(body: str) -> bool:
    signs = body.replace(" ", "").replace("\t", "")
    return len(signs) >= 3 and signs[0] in "-_*" and not signs.strip(signs[0])


def item_of(indent: int, body: str) -> tuple[str, int, int, str] | None:
    """(kind of list, number, column where the content begins, content) of a line that opens a list item."""
    digits = len(body) - len(body.lstrip("0123456789"))
    mark = body[: digits + 1] if 0 < digits <= 9 and body[digits : digits + 1] in (".", ")") else body[:1] if body[:1] in ("-", "+", "*") else ""
    rest = body[len(mark) :]
    if indent >= CODE_INDENT or not mark or rest and rest[0] not in " \t" or is_rule(body):
        return None
    inner, content = indent_of(rest)
    wide = inner if 1 <= inner <= CODE_INDENT and content else 1
    return mark[-1], int(mark[:-1] or 1), indent + len(mark) + wide, content


def html_end(body: str) -> str | None:
    """What ends the block of HTML that a line begins: a text, or an empty one for a blank line; None if it begins none."""
    lower = body.lower()
    for first, last in HTML_ENDS:
        if lower.startswith(first):
            return last
    name = lower[1:].lstrip("/").split(">")[0].split(" ")[0].rstrip("/") if lower.startswith("<") else ""
    if name in HTML_WHOLE and not lower.startswith("</"):
        return f"</{name}>"
    if lower.startswith("<!") and lower[2:3].isalpha():
        return ">"
    return "" if name in HTML_BLOCKS else None


def is_tag_alone(body: str) -> bool:
    """Whether a line is one start or end tag of any name."""
    return body.startswith("<") and body.endswith(">") and body.count("<") == body.count(">") == 1 and body[1:].lstrip("/")[:1].isalpha() and ":" not in body.split(" ")[0] and "@" not in body


def cells(row: str) -> int:
    inner = row.strip().replace("\\|", "")
    return len(inner.removeprefix("|").removesuffix("|").split("|"))


def is_delimiter(row: str) -> bool:
    """Whether a line divides a table's head from its body."""
    parts = [x.strip() for x in row.strip().removeprefix("|").removesuffix("|").split("|")]
    return "|" in row and all("-" in x and x.removeprefix(":").removesuffix(":").strip("-") == "" for x in parts)


def begins_table(row: str, ahead: str | None) -> bool:
    return ahead is not None and "|" in row and indent_of(ahead)[0] < CODE_INDENT and is_delimiter(ahead) and cells(row) == cells(ahead)


def interrupts(indent: int, body: str) -> bool:
    """Whether a line ends a paragraph before it."""
    if indent >= CODE_INDENT:
        return False
    item = item_of(indent, body)
    return bool(heading_level(body) or fence_of(body) or is_rule(body) or body.startswith(">") or item and item[3] and item[1] == 1) or html_end(body) is not None


class PageFold:
    """The open block of a page; ``step`` takes its lines in order."""

    def __init__(self) -> None:
        self.no = 0
        self.close()

    def close(self) -> None:
        self.kind = ""
        self.fence: tuple[str, int] | None = None  # of the page, or within a list item or quote
        self.mark, self.offset = "", 0  # of the list and its last item
        self.paragraph = False  # open in the list item or quote
        self.until = ""

    def open(self, kind: str) -> tuple[int, str]:
        self.close()
        self.no, self.kind = self.no + 1, kind
        return self.no, kind

    def step(self, line: str, ahead: str | None) -> tuple[int | None, str]:
        """(block, kind) of a line; no block for lines that are none's. A blank line within a list or code has its block."""
        indent, body = indent_of(line)
        if self.kind == "fence":
            found = self.no, "fence"
            if indent < CODE_INDENT and closes(body, self.fence):
                self.close()
            return found
        if self.kind == "html" and self.until:
            found = self.no, "html"
            if self.until in line.lower():
                self.close()
            return found
        if not body or body.startswith("{%") and body.endswith("%}"):
            self.paragraph = False
            if self.kind in ("list", "indented"):
                return self.no, self.kind
            self.close()
            return None, ""
        if self.continues(indent, body, line, ahead):
            return self.no, self.kind or "heading"
        return self.begins(indent, body, line, ahead)

    def continues(self, indent: int, body: str, line: str, ahead: str | None) -> bool:
        """Whether a line belongs to the open block; keeps what is known of its inside."""
        if self.kind == "indented":
            return indent >= CODE_INDENT
        if self.kind in ("html", "table"):
            return self.kind == "html" or not interrupts(indent, body) and indent < CODE_INDENT
        if self.kind == "paragraph":
            if indent < CODE_INDENT and body and not body.strip(body[0]) and body[0] in "=-":
                self.kind = ""  # underlined: the block is a heading and ends
                return True
            return not interrupts(indent, body) and not begins_table(line, ahead)
        if self.kind == "list":
            item = item_of(indent, body)
            if indent >= self.offset:
                self.within(indent - self.offset, body)
                return True
            if item and item[0] == self.mark:
                self.offset, self.fence, self.paragraph = item[2], None, False
                self.within(0, item[3])
                return True
            return self.paragraph and self.fence is None and not interrupts(indent, body) and not item
        if self.kind == "quote":
            if indent < CODE_INDENT and body.startswith(">"):
                self.within(*indent_of(body[1:].removeprefix(" ")))
                return True
            return self.paragraph and self.fence is None and not interrupts(indent, body)
        return False

    def within(self, indent: int, body: str) -> None:
        """What a line of a list item or quote leaves open in it."""
        if self.fence:
            if closes(body, self.fence):
                self.fence = None
            return
        if not body or indent >= CODE_INDENT and not self.paragraph:
            self.paragraph = False
        elif indent < CODE_INDENT and fence_of(body):
            self.fence, self.paragraph = fence_of(body), False
        elif item := item_of(indent, body):
            self.paragraph = False
            self.within(0, item[3])
        elif body.startswith(">"):
            self.within(*indent_of(body[1:].removeprefix(" ")))
        else:
            self.paragraph = not heading_level(body) and not is_rule(body)

    def begins(self, indent: int, body: str, line: str, ahead: str | None) -> tuple[int | None, str]:
        if indent >= CODE_INDENT:
            return self.open("indented")
        if heading_level(body):
            found = self.open("heading")
            self.close()
            return found
        if fence := fence_of(body):
            found = self.open("fence")
            self.fence = fence
            return found
        if is_rule(body):
            self.close()
            return None, ""
        if item := item_of(indent, body):
            found = self.open("list")
            self.mark, self.offset = item[0], item[2]
            self.within(0, item[3])
            return found
        if body.startswith(">"):
            found = self.open("quote")
            self.within(*indent_of(body[1:].removeprefix(" ")))
            return found
        until = html_end(body)
        if until is not None or is_tag_alone(body):
            found = self.open("html")
            self.until = until or ""
            if self.until and self.until in line.lower()[2:]:
                self.close()
            return found
        return self.open("table" if begins_table(line, ahead) else "paragraph")


def block_lines(lines: DataFrame) -> DataFrame:
    """lines (source_path, line_no, line) with block (null for lines that are no block's) and kind."""

    def folded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, fold, held = None, PageFold(), None  # a line waits for the next one, which may make it a table's head

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["source_path", "line_no", "line", "block", "kind"])

        for batch in batches:
            rows = []
            for path, no, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is not None:
                    rows.append((*held, *fold.step(held[2], line if held[0] == path else None)))
                if path != page:
                    page, fold = path, PageFold()
                held = path, no, line
            yield out(rows)
        if held is not None:
            yield out([(*held, *fold.step(held[2], None))])

    rows = lines.selectExpr("source_path", "cast(line_no as int) as line_no", "line")
    return rows.repartition("source_path").sortWithinPartitions("source_path", "line_no").mapInArrow(folded, "source_path string, line_no int, line string, block long, kind string")


def container_of(lines: list[tuple[int, str]], kinds: list[str]) -> dict[int, int]:
    """From the place of each line in a closed container of prose to the number of the container's first line."""
    spans, at, size = [], None, 0
    for k, (_, line) in enumerate(lines):
        if kinds[k] != "fence" and CONTAINER.match(line):
            slashes = len(line) - len(line.lstrip("/"))
            if at is None:
                at, size = (None, 0) if CONTAINER_END.match(line) else (k, slashes)
            elif slashes == size and CONTAINER_END.match(line):
                spans.append((at, k))
                at = None
    prose = [(a, b) for a, b in spans if not any(kinds[k] == "fence" or HEADING.match(lines[k][1]) for k in range(a, b + 1))]
    return {k: lines[a][0] for a, b in prose for k in range(a, b + 1)}


def page_blocks(lines: list[tuple[int, str]]) -> list[tuple[int, str, str, int, str]]:
    """(block_no, block_type, kind, level, markdown) of a page's (line_no, line) in order: what ``corpus.blocks`` finds in a table of lines."""
    fold = PageFold()
    steps = [fold.step(line, ahead) for (_, line), (_, ahead) in zip(lines, [*lines[1:], (0, None)][: len(lines)], strict=True)]
    inside = container_of(lines, [kind for _, kind in steps])
    groups: dict[tuple, list[int]] = {}
    for k, (block, _) in enumerate(steps):
        if block is not None or k in inside:
            groups.setdefault(("container", inside[k]) if k in inside else ("block", block), []).append(k)
    found = []
    for (what, _), places in groups.items():
        kind = "container" if what == "container" else steps[places[-1]][1]
        markdown = "\n".join(lines[k][1] for k in places).rstrip(" \t\r\n")
        if kind == "html" and (markdown.startswith("<!--") and markdown.endswith("-->") or "{%" in markdown or "{{" in markdown):
            continue
        signs = markdown.lstrip(" ")
        level = 0 if kind != "heading" else len(signs) - len(signs.lstrip("#")) if signs.startswith("#") else 1 if markdown.split("\n")[-1].startswith("=") else 2
        block_type = "heading" if kind == "heading" else "code" if kind in ("fence", "indented") else "text"
        found.append((lines[places[0]][0], block_type, kind, level, markdown))
    return sorted(found)
