"""Notice pages: a small element tree over html.parser, and list and detail pages as tables.

Only the walk over the tree runs in Python, Arrow batch by Arrow batch. Ids, dates, categories, issues, cleaning and
the first-wins rule are Column expressions on what it returns.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import date_issue, source_date
from tidemark.functions.text import clean_body, clean_category, clean_department, clean_title
from tidemark.functions.urls import BoardSite, detail_url, duid_from_href, parse_duid
from tidemark.operators.merge import first_by_key
from tidemark.operators.schema import category_id_of, category_issue

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset(("script", "style", "template"))

# Where the fields of a notice are; of a tuple the first with text counts.
TITLE = (".title", ".notice-title", "[data-title]")
CATEGORY = (".category", "[data-category]")
POSTED = (".posted-date", ".reg-date", "[data-posted-date]")
UPDATED = (".updated-date", ".modify-date", "[data-updated-date]")
DEPARTMENT = (".department", ".writer", "[data-department]")
BODY = (".body", ".board-body", ".view-content", "[data-body]")
BOX, ROWS, LINK = ".board-list-box", ("li", "tr", ".board-row"), "a[href]"
KEYED = ("a[href*=DUID]", "[data-duid]")
ROOTS = ("article", "main", "body")
REMOVED = ("a", "iframe", "embed", "object", ".attachment", ".file", ".download")
ATTACHED = ("a[href]", "iframe[src]", "embed[src]", "object[data]", ".attachment")


class Element:
    """A tag with its attributes and children: elements, text, and marked sections as (kind, text). No walk recurses, so depth is no danger."""

    __slots__ = ("attrs", "children", "name")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs = name, attrs
        self.children: list[Element | str | tuple[str, str]] = []

    def walk(self) -> Iterator[Element]:
        """Descendants in document order."""
        todo = [c for c in reversed(self.children) if isinstance(c, Element)]
        while todo:
            own = todo.pop()
            yield own
            todo.extend(c for c in reversed(own.children) if isinstance(c, Element))

    def matches(self, selector: str) -> bool:
        """Selectors of the forms tag, .class, [attr], tag[attr] and tag[attr*=part]."""
        if selector.startswith("."):
            return selector[1:] in self.attrs.get("class", "").split()
        name, _, rest = selector.partition("[")
        if name and name != self.name:
            return False
        if not rest:
            return True
        attr, _, part = rest[:-1].partition("*=")
        return attr in self.attrs and part in self.attrs[attr]

    def all(self, *selectors: str) -> list[Element]:
        return [e for e in self.walk() if any(e.matches(s) for s in selectors)]

    def first(self, *selectors: str) -> Element | None:
        return next((e for e in self.walk() if any(e.matches(s) for s in selectors)), None)

    def text(self) -> str:
        """Stripped pieces of text joined by one space; no comments, scripts or styles of others."""
        out: list[str] = []
        todo: list[Element | str | tuple[str, str]] = list(reversed(self.children))
        while todo:
            own = todo.pop()
            if isinstance(own, Element):
                if own.name not in _HIDDEN:
                    todo.extend(reversed(own.children))
            else:
                piece = (own if isinstance(own, str) else own[1] if own[0] == "cdata" else "").strip()
                if piece:
                    out.append(piece)
        return " ".join(out)

    def own_text(self) -> str:
        """Pieces of plain text that are direct children."""
        return " ".join(p for c in self.children if isinstance(c, str) and (p := c.strip()))

    def first_text(self, selectors: tuple[str, ...]) -> str:
        for s in selectors:
            found = self.first(s)
            if found is not None and (value := found.text()):
                return value
        return ""

    def without(self, *selectors: str) -> Element:
        """A copy without the descendants that match."""
        copy = Element(self.name, self.attrs)
        todo = [(self, copy)]
        while todo:
            old, new = todo.pop()
            for c in old.children:
                if not isinstance(c, Element):
                    new.children.append(c)
                elif not any(c.matches(s) for s in selectors):
                    below = Element(c.name, c.attrs)
                    new.children.append(below)
                    todo.append((c, below))
        return copy


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.top = Element("", {})
        self.open = [self.top]
        self.names: Counter[str] = Counter()  # of open elements, so that an end tag without a start costs nothing

    def handle_starttag(self, tag, attrs):
        own = Element(tag, {k: v or "" for k, v in attrs})  # of repeated attributes the last one counts
        self.open[-1].children.append(own)
        if tag not in _VOID:
            self.open.append(own)
            self.names[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        while self.names[tag]:
            closed = self.open.pop().name
            self.names[closed] -= 1
            if closed == tag:
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)

    def handle_comment(self, data):
        self.open[-1].children.append(("comment", data))

    def unknown_decl(self, data):
        kind, text = ("cdata", data[6:]) if data.startswith("CDATA[") else ("declaration", data)
        self.open[-1].children.append((kind, text))


def parse_html(html: str) -> Element:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.top


# Lists


def list_rows(html: str) -> list[dict] | None:
    """Raw fields of each row of a list page; None if it has no list box."""
    top = parse_html(html)
    boxes = top.all(BOX)
    if not boxes:
        return None
    rows: list[Element] = []
    for box in boxes:
        inner = [r for r in box.all(*ROWS) if r.first(LINK) is not None]
        rows += inner or ([box] if box.text() else [])
    return [_list_row(r) for r in rows]


def _list_row(row: Element) -> dict:
    link = row.first(*KEYED)
    category = row.first_text(CATEGORY)
    if category.startswith("[") and category.endswith("]"):
        category = category[1:-1].strip()
    info = next((p for p in row.all("p") if p.matches(".info")), None)
    parts = [p.strip() for p in (info.text() if info is not None else "").split("|")] + [""] * 4
    kind = row.first(".kind")
    marks = f"{row.attrs.get('class', '')} {kind.text() if kind is not None else ''}".lower()
    return {
        "href": link.attrs.get("href", "") if link is not None else "",
        "data_duid": link.attrs.get("data-duid", "") if link is not None else "",
        "title": row.first_text(TITLE) or (link.own_text() if link is not None else ""),
        "category": category,
        "posted": row.first_text(POSTED) or parts[1],
        "updated": row.first_text(UPDATED) or parts[2],
        "department": row.first_text(DEPARTMENT) or parts[3],
        "attachments": row.first(".ico-file") is not None,
        "pinned": "notice" in marks or "pinned" in marks,
    }


_FIELDS = [("href", pa.string()), ("data_duid", pa.string()), ("title", pa.string()), ("category", pa.string()), ("posted", pa.string()), ("updated", pa.string()), ("department", pa.string()), ("attachments", pa.bool_()), ("pinned", pa.bool_())]
_RAW = "page_id long, row_index int, page_issue string, href string, data_duid string, title string, category string, posted string, updated string, department string, attachments boolean, pinned boolean"


def _raw_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "row_index", "page_issue", *(n for n, _ in _FIELDS)]
    types = [pa.int64(), pa.int32(), pa.string(), *(t for _, t in _FIELDS)]
    for batch in batches:
        out: list[list] = []
        for page, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            html = cell.as_py()
            rows = list_rows(html) if html else None
            if rows is None:
                out.append([page, -1, "list" if html else "html", *[None] * len(_FIELDS)])
            else:
                out += [[page, i, None, *(r[n] for n, _ in _FIELDS)] for i, r in enumerate(rows)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)


def list_page_rows(pages: DataFrame, site: BoardSite = BoardSite(), id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Every row of list pages, with the fields of a notice, or issue and location. Of a row's faults the first by
    key, title, category, posted date counts. A fault of the page is a row with index -1.

    A null or empty page is malformed (location html), so is one without a list box (location list).
    """
    raw = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html")).mapInArrow(_raw_lists, _RAW)
    duid = F.coalesce(duid_from_href(F.col("href")), parse_duid(F.col("data_duid")))
    place = F.concat(F.lit("list-row-"), F.col("row_index"))
    no_key = F.when((F.col("data_duid") == "") & ~F.contains(F.col("href"), F.lit("DUID=")), "missing_duid").otherwise("malformed_duid")
    found: Column = (
        F.when(F.col("page_issue").isNotNull(), F.struct(F.lit("malformed_markup").alias("code"), F.col("page_issue").alias("location")))
        .when(duid.isNull(), F.struct(no_key.alias("code"), place.alias("location")))
        .when(F.col("title") == "", F.struct(F.lit("missing_title").alias("code"), place.alias("location")))
        .when(category_issue(F.col("category")).isNotNull(), F.struct(category_issue(F.col("category")).alias("code"), place.alias("location")))
        .when(date_issue(F.col("posted")).isNotNull(), F.struct(date_issue(F.col("posted")).alias("code"), F.concat(place, F.lit("-posted")).alias("location")))
    )
    posted = source_date(F.col("posted"))
    return raw.select(
        "page_id",
        "row_index",
        found.alias("issue"),
        duid.alias("duid"),
        clean_title(F.col("title")).alias("title"),
        category_id_of(F.col("category")).alias("category_id"),
        clean_category(F.trim("category")).alias("category_name"),
        posted.alias("posted_date"),
        F.coalesce(source_date(F.col("updated")), posted).alias("updated_date"),
        clean_department(F.col("department")).alias("department"),
        detail_url(duid, site).alias("source_url"),
        F.col("attachments").alias("attachments_present"),
        "pinned",
    )


def list_records(rows: DataFrame) -> DataFrame:
    """Records without an issue; of those with one id on a page the first."""
    return first_by_key(rows.where(F.col("issue").isNull()), ["page_id", "duid"], ["row_index"]).drop("issue")


def list_issues(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("issue").isNotNull()).select("page_id", "row_index", "issue.code", "issue.location")


# Details


def detail_fields(html: str) -> dict | None:
    """Raw fields of a detail page; None if it has no root."""
    root = parse_html(html).first(*ROOTS)
    if root is None:
        return None
    body = root.first(*BODY)
    return {
        "title": root.first_text(TITLE),
        "category": root.first_text(CATEGORY),
        "posted": root.first_text(POSTED),
        "updated": root.first_text(UPDATED),
        "department": root.first_text(DEPARTMENT),
        "body": body.without(*REMOVED).text() if body is not None else "",
        "attachments": body is not None and bool(body.all(*ATTACHED)),
    }


_DETAIL = [("title", pa.string()), ("category", pa.string()), ("posted", pa.string()), ("updated", pa.string()), ("department", pa.string()), ("body", pa.string()), ("attachments", pa.bool_())]


def _raw_details(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(detail_fields(h), None) if (h := cell.as_py()) else (None, "html") for cell in batch.column(1)]
        columns = [batch.column(0), pa.array([None if f else place or "detail" for f, place in found], pa.string())]
        columns += [pa.array([f[n] if f else None for f, _ in found], t) for n, t in _DETAIL]
        yield pa.RecordBatch.from_arrays([*columns, *batch.columns[2:]], names=["raw_duid", "page_issue", *(n for n, _ in _DETAIL), *batch.schema.names[2:]])


def detail_pages(pages: DataFrame, site: BoardSite = BoardSite(), duid_col: str = "duid", html_col: str = "html", order: Column | None = None) -> DataFrame:
    """A row for each detail page: the fields of a notice with its body, or issue (code, location). An empty page comes
    first among the faults, then key, root, title, category, posted date. With ``order`` each row has it as seq."""
    seq = [] if order is None else ["seq"]
    raw = pages.select(F.col(duid_col).cast("string").alias("raw_duid"), F.col(html_col).cast("string").alias("html"), *([] if order is None else [order.cast("long").alias("seq")])).mapInArrow(
        _raw_details, "raw_duid string, page_issue string, title string, category string, posted string, updated string, department string, body string, attachments boolean" + "".join(f", {c} long" for c in seq)
    )
    duid = parse_duid(F.col("raw_duid"))

    def fault(code: Column, place: str | Column) -> Column:
        return F.struct(code.alias("code"), (F.lit(place) if isinstance(place, str) else place).alias("location"))

    found = (
        F.when(F.col("page_issue") == "html", fault(F.lit("malformed_markup"), "html"))
        .when(duid.isNull(), fault(F.when(F.coalesce("raw_duid", F.lit("")) == "", "missing_duid").otherwise("malformed_duid"), "detail"))
        .when(F.col("page_issue").isNotNull(), fault(F.lit("malformed_markup"), "detail"))
        .when(F.col("title") == "", fault(F.lit("missing_title"), "detail"))
        .when(category_issue(F.col("category")).isNotNull(), fault(category_issue(F.col("category")), "detail"))
        .when(date_issue(F.col("posted")).isNotNull(), fault(date_issue(F.col("posted")), "detail-posted"))
    )
    posted = source_date(F.col("posted"))
    return raw.select(
        "raw_duid",
        found.alias("issue"),
        duid.alias("duid"),
        clean_title(F.col("title")).alias("title"),
        category_id_of(F.col("category")).alias("category_id"),
        clean_category(F.trim("category")).alias("category_name"),
        posted.alias("posted_date"),
        F.coalesce(source_date(F.col("updated")), posted).alias("updated_date"),
        clean_department(F.col("department")).alias("department"),
        detail_url(duid, site).alias("source_url"),
        F.col("attachments").alias("attachments_present"),
        F.lit(False).alias("pinned"),
        clean_body(F.col("body")).alias("body"),
        *seq,
    )


# Any page


def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for page, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            top = parse_html(cell.as_py() or "")
            title = top.first("title")
            body = top.first("body") or top
            rows.append((page, title.text() if title is not None else None, [a.attrs["href"] for a in top.all("a[href]")], body.text()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.list_(pa.string()), pa.string()))], names=["page_id", "title", "links", "text"])


def page_contents(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, title, links, text) of any page; title is null without a title element, a null page has no text."""
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html")).mapInArrow(_plain, "page_id long, title string, links array<string>, text string")
