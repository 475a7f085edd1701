"""HTML table discovery and cell extraction (C1, C7): the only markup code.

``parse_html(df)`` is one Arrow-batched Python pass (``mapInArrow``) that turns each message's
HTML into one nested row:

    segments ARRAY<STRUCT<kind, html, start, end, table_idx, rows ARRAY<ARRAY<STRING>>>>

``kind`` is ``text`` or ``table``; the table segments are the top-level tables (no ``<table>``
ancestor) with their source span and their grid. Everything after this pass (masking, thread
cut, detection, normalisation) runs as native Spark expressions on that row, so a message is
parsed exactly once and nothing is shuffled.

Tree semantics follow a lenient HTML tree builder without implied end tags:
  * void elements close at once; an end tag closes the most recent open element of that
    name (and everything opened after it); an unmatched end tag is ignored;
  * ``<p>`` or ``<td>`` left open nest instead of closing, so outer cells repeat inner text;
  * comments and the text of script/style/template/rt/rp are not cell text.
Grid rules: every ``tr`` below the table (nested tables included), every ``td`` below that
row; the cell text is the ``<p>`` texts joined by a newline when there are several, the single
``<p>`` text unstripped, else the stripped strings of the cell concatenated.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from html import unescape as html_unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Void elements of the tree builder; their start tag is closed immediately.
VOID_TAGS = frozenset(
    "area base br col embed hr img input keygen link menuitem meta param source track wbr "
    "basefont bgsound command frame image isindex nextid spacer".split()
)
# Strings inside these elements are not text of their ancestors.
NON_TEXT_TAGS = frozenset("script style template rt rp".split())
# Whitespace-only strings are kept as they are inside these elements only;
# elsewhere a string of ASCII whitespace becomes "\n" if it has a newline, else " ".
PRESERVE_WS_TAGS = frozenset(("pre", "textarea"))
ASCII_WS = " \n\t\f\r"

SEGMENT_TYPE = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("html", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("table_idx", T.IntegerType()),
        T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType()))),
    ]
)
SEGMENTS_TYPE = T.ArrayType(SEGMENT_TYPE)

_NEWLINE = re.compile("\n")


class _Node:
    __slots__ = ("tag", "kids", "start", "end")

    def __init__(self, tag: str, start: int):
        self.tag = tag
        self.kids: list = []
        self.start = start
        self.end = -1


def _attr_value(v: str) -> str:
    v = v.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    if '"' not in v:
        return f'"{v}"'
    if "'" not in v:
        return f"'{v}'"
    return '"' + v.replace('"', "&quot;") + '"'


def serialise_start_tag(tag: str, attrs, void: bool) -> str:
    """A start tag as the re-serialised document shows it: name, ``key="value"`` pairs separated
    by single spaces, ``/>`` for void elements (only used for tags wrapped over lines)."""
    parts = [tag] + [f"{k}={_attr_value(v or '')}" for k, v in dict(attrs or ()).items()]
    return "<" + " ".join(parts) + ("/>" if void else ">")


class _TreeBuilder(HTMLParser):
    """Builds element nodes only inside tables (the only place cells come from) and keeps the
    names of every open element, so end tags close exactly what the tree builder would close.
    Source offsets are computed only for top-level table starts and ends."""

    def __init__(self, src: str):
        super().__init__(convert_charrefs=True)
        self.src = src
        self._line_starts: list[int] | None = None
        self.tags: list[str] = ["#root"]
        self.nodes: list[_Node | None] = [None]
        self.hidden = 0
        self.preserve = 0
        self.depth = 0  # open <table> elements
        self.tables: list[_Node] = []
        self.pending: list[str] = []
        # (offset, length, text): start tags wrapped over lines, as the re-serialised document
        # has them on one line (line structure decides the quoted-reply cut)
        self.rewrites: list[tuple[int, int, str]] = []

    track_end_tags = False  # set when the document has an end tag wrapped over lines
    track_entities = False  # set when the document has a line-break or colon reference

    def _note_entities(self, data: str) -> None:
        # text outside tables: references that decode to a line break or colon become the
        # characters (chunks starting with "<" are bogus markup passed as text: left as is)
        if data.startswith("<"):
            return
        at = self._offset()
        end = self.src.find("<", at)
        raw = self.src[at : len(self.src) if end < 0 else end]
        for m in _LINE_ENTITY.finditer(raw):
            self.rewrites.append((at + m.start(), len(m.group()), html_unescape(m.group())))

    def _note_wrapped_end(self, tag: str, matched: bool) -> None:
        # a wrapped end tag is one line after re-serialisation; an unmatched one is dropped
        at = self._offset()
        close = self.src.find(">", at)
        raw = self.src[at : len(self.src) if close < 0 else close + 1]
        if "\n" in raw or "\r" in raw:
            self.rewrites.append((at, len(raw), f"</{tag}>" if matched else ""))

    def _note_wrapped(self, tag: str, attrs, void: bool) -> None:
        raw = self.get_starttag_text() or ""
        if "\n" in raw or "\r" in raw or (self.track_entities and _LINE_ENTITY.search(raw)):
            # (attribute values are re-serialised decoded: a line-break reference breaks the line)
            self.rewrites.append((self._offset(), len(raw), serialise_start_tag(tag, attrs, void)))

    def _offset(self) -> int:
        if self._line_starts is None:
            self._line_starts = [0] + [m.end() for m in _NEWLINE.finditer(self.src)]
        line, col = self.getpos()
        return self._line_starts[line - 1] + col

    def _flush(self) -> None:
        """Adjacent data chunks form one string (collapsed when whitespace-only)."""
        text = "".join(self.pending)
        self.pending.clear()
        if not self.preserve and not text.strip(ASCII_WS):
            text = "\n" if "\n" in text else " "
        self.nodes[-1].kids.append(text)

    def _node(self, tag: str) -> _Node | None:
        if self.pending:
            self._flush()
        if self.depth:
            node = _Node(tag, 0)
            self.nodes[-1].kids.append(node)
            return node
        if tag == "table":
            node = _Node(tag, self._offset())
            self.tables.append(node)
            return node
        return None

    def handle_starttag(self, tag, attrs):
        self._note_wrapped(tag, attrs, tag in VOID_TAGS)
        node = self._node(tag)
        if tag in VOID_TAGS:
            return
        self.tags.append(tag)
        self.nodes.append(node)
        if tag in NON_TEXT_TAGS:
            self.hidden += 1
        if tag in PRESERVE_WS_TAGS:
            self.preserve += 1
        if tag == "table":
            self.depth += 1

    def handle_startendtag(self, tag, attrs):
        self._note_wrapped(tag, attrs, True)
        node = self._node(tag)
        if node is not None and not self.depth:  # a self-closed top-level table ends at its own tag
            node.end = node.start + len(self.get_starttag_text() or "")

    def _pop(self, end: int) -> None:
        tag = self.tags.pop()
        node = self.nodes.pop()
        if tag in NON_TEXT_TAGS:
            self.hidden -= 1
        if tag in PRESERVE_WS_TAGS:
            self.preserve -= 1
        if tag == "table":
            self.depth -= 1
            if self.depth == 0:
                node.end = end

    def handle_endtag(self, tag):
        tags = self.tags
        if self.track_end_tags:
            self._note_wrapped_end(tag, tag in tags[1:] and tag not in VOID_TAGS)
        if tags[-1] == tag and tag != "table":  # the common case: closes the innermost element
            if self.pending:
                self._flush()
            self._pop(-1)
            return
        for i in range(len(tags) - 1, 0, -1):
            if tags[i] == tag:
                if self.pending:
                    self._flush()
                # an offset is needed only when the top-level table is among the closed elements
                at = self._offset() if self.depth and "table" in tags[i:] else -1
                while len(tags) > i + 1:
                    self._pop(at)  # closed implicitly: ends where this end tag starts
                close = self.src.find(">", at) if at >= 0 else -1
                self._pop(len(self.src) if close < 0 else close + 1)
                return

    def handle_data(self, data):
        if self.depth and not self.hidden and data:
            self.pending.append(data)
        elif self.track_entities and not self.depth and not self.hidden and data:
            self._note_entities(data)

    def _break_text(self, _data=None) -> None:
        # comments, declarations and processing instructions end the current string
        if self.pending:
            self._flush()

    handle_comment = handle_decl = handle_pi = _break_text

    def unknown_decl(self, data):
        # a CDATA section is text of its own; other declarations are not text
        self._break_text()
        if data.upper().startswith("CDATA[") and self.depth and not self.hidden:
            self.pending.append(data[len("CDATA["):])
            self._flush()

    def finish(self) -> None:
        self.close()
        if self.pending:
            self._flush()
        while len(self.tags) > 1:
            self._pop(len(self.src))


def _descendants(node: _Node, tag: str):
    """Elements named ``tag`` below ``node`` in document order."""
    todo = list(reversed(node.kids))
    while todo:
        n = todo.pop()
        if isinstance(n, _Node):
            if n.tag == tag:
                yield n
            todo.extend(reversed(n.kids))


def _strings(node: _Node):
    todo = list(reversed(node.kids))
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            yield n
        else:
            todo.extend(reversed(n.kids))


def _cell_text(td: _Node) -> str:
    paragraphs = ["".join(_strings(p)) for p in _descendants(td, "p")]
    if len(paragraphs) > 1:
        return "\n".join(paragraphs)
    if paragraphs:
        return paragraphs[0]
    return "".join(s.strip() for s in _strings(td))


def table_grid(table: _Node, th_as_td: bool = False) -> list[list[str]]:
    """Rows of ``td`` texts of one table (nested rows and cells included).

    Same result as "for every ``tr`` below the table, every ``td`` below that ``tr``", in one
    pre-order walk: a cell's text is computed once and appended to every enclosing row.
    ``th`` cells are ignored as in the source unless ``th_as_td`` (then a ``<th>`` header row
    can make a rate table)."""
    cell_tags = ("td", "th") if th_as_td else ("td",)
    rows: list[list[str]] = []
    todo = [(k, ()) for k in reversed(table.kids) if isinstance(k, _Node)]
    while todo:
        node, open_rows = todo.pop()
        if node.tag == "tr":
            row: list[str] = []
            rows.append(row)
            open_rows = open_rows + (row,)
        elif node.tag in cell_tags and open_rows:
            text = _cell_text(node)
            for r in open_rows:
                r.append(text)
        todo.extend((k, open_rows) for k in reversed(node.kids) if isinstance(k, _Node))
    return rows


_TABLE_OPEN = re.compile(r"<table", re.IGNORECASE)
_WRAPPED_END_TAG = re.compile(r"</[a-zA-Z][^>]*[\r\n]")
# Character references that decode to a line break or a colon: in the re-serialised document
# they are plain characters, and both decide where a quoted-reply header matches.
_LINE_ENTITY = re.compile(
    r"&#0*(?:10|13|58)(?![0-9]);?|&#[xX]0*(?:[aAdD]|3[aA])(?![0-9a-fA-F]);?|&(?:NewLine|colon);"
)


def _reply_header():
    from rateflow.operators.thread import REPLY_HEADER_EN, REPLY_HEADER_RU

    return re.compile("^(?:" + REPLY_HEADER_EN + "|" + REPLY_HEADER_RU + ")", re.IGNORECASE | re.MULTILINE)


_REPLY_HEADER = None
# The first word of a header, which its first line holds.
_HEADER_WORD = re.compile("sent:|отправлено:", re.IGNORECASE)


def _first_header(html: str) -> re.Match | None:
    global _REPLY_HEADER
    if _REPLY_HEADER is None:
        _REPLY_HEADER = _reply_header()
    folded = html.casefold()  # superset test: every header's first line has one of these
    if "sent:" not in folded and "отправлено:" not in folded:
        return None
    line = -1
    for word in _HEADER_WORD.finditer(html):  # only lines with such a word can begin a header
        start = html.rfind("\n", 0, word.start()) + 1
        if start > line:
            line = start
            if found := _REPLY_HEADER.match(html, start):
                return found
    return None


def _feed_newest(html: str, builder: _TreeBuilder) -> None:
    """Feed ``builder`` the newest message only, when its end can be proven; else everything.

    A quoted-reply header can never span a table placeholder line, so the first header of the
    raw html is also the first one of the masked text when no table is open where it starts,
    no table starts inside its lines, no start tag before or inside it is wrapped over lines,
    and the parser has consumed everything up to its end. Then nothing after it is needed. Otherwise the rest is fed too (the parser is incremental, so
    nothing is parsed twice).
    """
    m = _first_header(html)
    if m is None or _TABLE_OPEN.search(html, m.start(), m.end()):
        builder.feed(html)
        return
    builder.feed(html[: m.start()])
    if builder.depth or builder.rawdata or builder.rewrites:
        builder.feed(html[m.start():])
        return
    # the header lines themselves: a tag wrapped inside them would join lines once
    # re-serialised (the header might then not match there), an unfinished token is unknown
    builder.feed(html[m.start() : m.end()])
    if builder.rewrites or builder.rawdata:
        builder.feed(html[m.end():])


def _text_between(html: str, a: int, b: int, rewrites) -> str:
    """Source text ``html[a:b]`` with wrapped start tags inside it put on one line."""
    if not rewrites:
        return html[a:b]
    out, pos = [], a
    for off, n, text in rewrites:
        if off >= a and off + n <= b:
            out.append(html[pos:off])
            out.append(text)
            pos = off + n
    out.append(html[pos:b])
    return "".join(out)


# Plain markup: one-line tags with quoted attributes, no element that changes how its text is read.
_ATTRS = r'(?: [a-z][a-z0-9-]*+="[^"<>&\r\n]*+")*+'
_OTHER_TEXT = "script|style|template|rt|rp|pre|textarea|title|xmp|iframe|noembed|noframes|noscript|plaintext|svg|math"
_NOT_PLAIN = re.compile(
    rf"<(?!/?(?:t[dr]|p|br?)>|(?:/(?!(?:{_OTHER_TEXT})>)[a-z][a-z0-9]*+|(?!(?:{_OTHER_TEXT})[ />])[a-z][a-z0-9]*+{_ATTRS} ?/?)>)", re.I | re.A
)
# A table of closed rows and cells that hold text or paragraphs of text only.
_PLAIN_CELL = rf"<td{_ATTRS}>[^<]*+(?:<p{_ATTRS}>[^<]*+</p>[^<]*+)*+</td>[^<]*+"
_PLAIN_TABLE = re.compile(rf"<table{_ATTRS}>[^<]*+(?:<tr{_ATTRS}>[^<]*+(?:{_PLAIN_CELL})*+</tr>[^<]*+)*+</table>", re.I | re.A)
_TABLE_TAG = re.compile("</?table", re.I | re.A)
_ROW_START = re.compile("<tr[^>]*>", re.I | re.A)
_CELL = re.compile("<td[^>]*+>([^<]*+(?:<(?!/td>)[^<]*+)*+)</td>", re.I | re.A)
_PARAGRAPH = re.compile("<p[^>]*>([^<]*)</p>", re.I | re.A)


def _plain_string(text: str) -> str:
    if "&" in text:
        text = html_unescape(text)
    if text and not text.strip(ASCII_WS):
        return "\n" if "\n" in text else " "
    return text


def _plain_text(cell: str) -> str:
    if "<" not in cell:
        return (html_unescape(cell) if "&" in cell else cell).strip()
    return "\n".join(_plain_string(p) for p in _PARAGRAPH.findall(cell))


def _plain_tables(html: str, newest_only: bool) -> list[tuple[int, int, list[list[str]]]] | None:
    """(start, end, rows) of the tables, as the tree builder finds them, where the whole document is
    plain: tags of the common form only, every table closed and without other elements in its cells.
    None: anything else, which is left to the tree builder."""
    if _NOT_PLAIN.search(html) or ("&" in html and _LINE_ENTITY.search(html)):
        return None
    found = [(m.start(), m.end()) for m in _PLAIN_TABLE.finditer(html)]
    if len(_TABLE_TAG.findall(html)) != 2 * len(found):
        return None
    header = _first_header(html) if newest_only else None
    if header is not None and not _TABLE_OPEN.search(html, header.start(), header.end()):
        if "&" in header.group():
            return None
        at = header.start()
        if not any(a < at < b for a, b in found):
            found = [t for t in found if t[1] <= at]
    return [(a, b, [[_plain_text(c) for c in _CELL.findall(r)] for r in _ROW_START.split(html[a:b])[1:]]) for a, b in found]


def split_segments(
    html: str, newest_only: bool = False, th_as_td: bool = False, keep_table_html: bool = True
) -> list[dict]:
    """Alternate text / top-level-table segments covering ``html`` end to end.

    Text segments are source text, except that a start tag wrapped over several lines is put on
    one line as the re-serialised document has it (``start``/``end`` stay source offsets).
    With ``newest_only`` the document is parsed only up to the end of the newest message when
    that end can be proven from the raw text (see ``_feed_newest``); the rest is one text
    segment. The newest message's tables are the same; tables of the quoted thread are then
    not listed.
    """
    if not _TABLE_OPEN.search(html):
        # no table start tag anywhere: nothing to find, skip the tree build
        return [{"kind": "text", "html": html, "start": 0, "end": len(html), "table_idx": None, "rows": None}]
    rewrites: list[tuple[int, int, str]] = []
    tables = _plain_tables(html, newest_only)
    if tables is None:
        builder = _TreeBuilder(html)
        builder.track_end_tags = _WRAPPED_END_TAG.search(html) is not None
        builder.track_entities = _LINE_ENTITY.search(html) is not None
        if newest_only and not builder.track_entities:
            _feed_newest(html, builder)
        else:
            builder.feed(html)
        builder.finish()
        rewrites = builder.rewrites
        tables = [(t.start, t.end if t.end >= t.start else len(html), table_grid(t, th_as_td)) for t in builder.tables]
    segments: list[dict] = []
    pos = 0
    for idx, (start, end, rows) in enumerate(tables):
        segments.append(
            {"kind": "text", "html": _text_between(html, pos, start, rewrites),
             "start": pos, "end": start, "table_idx": None, "rows": None}
        )
        segments.append(
            {"kind": "table", "html": html[start:end] if keep_table_html else None,
             "start": start, "end": end, "table_idx": idx, "rows": rows}
        )
        pos = end
    segments.append(
        {"kind": "text", "html": _text_between(html, pos, len(html), rewrites), "start": pos,
         "end": len(html), "table_idx": None, "rows": None}
    )
    return segments


def segments_to_arrow(all_segments: list, arrow_type: pa.DataType) -> pa.Array:
    """Segments of a batch of messages as one Arrow array, built column-wise from flat lists and
    offsets (about ten times cheaper than converting nested Python dicts)."""
    seg_off, seg_null = [0], []
    kinds, htmls, starts, ends, tidx = [], [], [], [], []
    rows_off, rows_null, cell_off, cells = [0], [], [0], []
    for segs in all_segments:
        seg_null.append(segs is None)
        for s in segs or ():
            kinds.append(s["kind"])
            htmls.append(s["html"])
            starts.append(s["start"])
            ends.append(s["end"])
            tidx.append(s["table_idx"])
            rows = s["rows"]
            rows_null.append(rows is None)
            for r in rows or ():
                cells.extend(r)
                cell_off.append(len(cells))
            rows_off.append(len(cell_off) - 1)
        seg_off.append(len(kinds))
    inner = pa.ListArray.from_arrays(pa.array(cell_off, pa.int32()), pa.array(cells, pa.string()))
    rows_arr = pa.ListArray.from_arrays(pa.array(rows_off, pa.int32()), inner, mask=pa.array(rows_null, pa.bool_()))
    struct = pa.StructArray.from_arrays(
        [
            pa.array(kinds, pa.string()),
            pa.array(htmls, pa.string()),
            pa.array(starts, pa.int32()),
            pa.array(ends, pa.int32()),
            pa.array(tidx, pa.int32()),
            rows_arr,
        ],
        fields=list(arrow_type.value_type),
    )
    out = pa.ListArray.from_arrays(pa.array(seg_off, pa.int32()), struct, mask=pa.array(seg_null, pa.bool_()))
    return out.cast(arrow_type)


def slices(batches, rows: int = 512):
    """Arrow batches of at most ``rows`` messages: those of the session may hold 10,000, which as Python
    objects take many times their bytes in every worker."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _arrow_field(field: T.StructField) -> pa.Field:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.field(field.name, to_arrow_type(field.dataType), nullable=True)


def parse_html(
    df: DataFrame,
    html_col: str = "html",
    newest_only: bool = False,
    th_as_td: bool = False,
    keep_table_html: bool = True,
) -> DataFrame:
    """One row per message: input columns without ``html_col``, plus ``has_html``,
    ``segments`` and ``parse_error`` (null when the markup parsed).

    ``newest_only`` skips tree building for a provably quoted tail (see ``split_segments``);
    the extraction uses it, the full-document views (restore, parts, cells) do not.
    ``keep_table_html=False`` leaves the html text of table segments out (the grid and span
    stay): the extraction masks tables and never needs their source text."""
    from rateflow.session import ship_package

    ship_package(df.sparkSession)
    return df.mapInArrow(*markup_pass(df.schema, html_col, newest_only, th_as_td, keep_table_html))


def markup_pass(
    schema: T.StructType, html_col: str = "html", newest_only: bool = False, th_as_td: bool = False, keep_table_html: bool = True
) -> tuple[Callable, T.StructType]:
    """``parse_html`` on Arrow batches of ``schema``, and the schema it gives."""
    keep = [f for f in schema.fields if f.name != html_col]
    out_schema = T.StructType(
        keep
        + [
            T.StructField("has_html", T.BooleanType()),
            T.StructField("segments", SEGMENTS_TYPE),
            T.StructField("parse_error", T.StringType()),
        ]
    )
    keep_names = [f.name for f in keep]
    arrow_schema = pa.schema([_arrow_field(f) for f in out_schema.fields])

    def run(batches):
        for batch in slices(batches):
            htmls = batch.column(html_col).to_pylist()
            segs, errors, has = [], [], []
            for h in htmls:
                has.append(bool(h))
                if not h:
                    segs.append(None)
                    errors.append(None)
                    continue
                try:
                    segs.append(split_segments(h, newest_only, th_as_td, keep_table_html))
                    errors.append(None)
                except Exception as exc:  # isolate the message (J1)
                    segs.append(None)
                    errors.append(f"{type(exc).__name__}: {exc}")
            cols = [
                batch.column(n).cast(arrow_schema.field(n).type) for n in keep_names
            ]
            cols += [
                pa.array(has, pa.bool_()),
                segments_to_arrow(segs, arrow_schema.field("segments").type),
                pa.array(errors, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(cols, schema=arrow_schema)

    return run, out_schema


def html_segments(parsed: DataFrame, key: str = "message_id") -> DataFrame:
    """``html_segments`` view: one row per text/table segment (``seg_idx`` in document order)."""
    from pyspark.sql import functions as F

    return parsed.select(key, F.posexplode("segments").alias("seg_idx", "s")).select(
        key, "seg_idx", "s.kind", "s.html", "s.start", "s.end", "s.table_idx"
    )


def table_cells(parsed: DataFrame, key: str = "message_id", tables_col: str = "segments") -> DataFrame:
    """``cells`` view: ``(key, table_idx, row_idx, col_idx, text)`` of top-level tables.

    ``row_idx`` 0 is the header row; two ``posexplode`` after one parse, no shuffle.
    """
    from pyspark.sql import functions as F

    tables = F.filter(tables_col, lambda s: s["kind"] == "table")
    t = parsed.select(key, F.explode(tables).alias("t"))
    r = t.select(key, F.col("t.table_idx").alias("table_idx"), F.posexplode("t.rows").alias("row_idx", "cells"))
    return r.select(key, "table_idx", "row_idx", F.posexplode("cells").alias("col_idx", "text"))


class HtmlTableCells:
    """SQL table function ``html_table_cells(html)`` -> cells of the top-level tables.

    Register with ``register_udtfs(spark)`` and use as
    ``SELECT m.message_id, c.* FROM mail m, LATERAL html_table_cells(m.html) c``.
    """

    def eval(self, html: str):
        if not html:
            return
        for seg in split_segments(html):
            if seg["kind"] != "table":
                continue
            for r, cells in enumerate(seg["rows"]):
                for c, text in enumerate(cells):
                    yield seg["table_idx"], r, c, text


def register_udtfs(spark) -> None:
    from pyspark.sql.functions import udtf

    from rateflow.session import ship_package

    ship_package(spark)

    fn = udtf(
        HtmlTableCells, returnType="table_idx: int, row_idx: int, col_idx: int, text: string", useArrow=False
    )  # a lateral call has few rows: an Arrow batch for each costs more than the parse
    spark.udtf.register("html_table_cells", fn)
