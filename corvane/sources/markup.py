"""Structured acts in XHTML, as provisions.

One event pass over each file builds a small tree; provisions are the ``div`` elements whose id is a known prefix, an
underscore and a number. A document type that declares anything, and any entity, is refused, so a file can't expand or fetch anything;
a plain document type is passed over. A file that can't be read is a row of ``failures`` and ends no job.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import PROVISIONS

# Ids and classes of the format.
PREFIXES = {"rct": "Recital ({})", "art": "Article {}", "anx": "Annex {}"}
HEADINGS = {"oj-ti-art", "oj-doc-ti"}
NOTE, NOTE_TAG, TITLE_BOX = "oj-note", "oj-note-tag", "eli-title"
ARTICLE_TITLE, ANNEX_TITLE, PART_LABEL, PART_NAME = "oj-sti-art", "oj-doc-ti", "oj-ti-section-1", "oj-ti-section-2"
DASH = " — "
_NUMBERED = re.compile(r"\d{3}\.\d{3}\Z")


@dataclass
class Node:
    name: str
    attributes: dict[str, str]
    parent: Node | None = None
    content: list[Node | str] = field(default_factory=list)

    @property
    def id(self) -> str:
        return self.attributes.get("id", "")

    @property
    def css(self) -> str:
        return self.attributes.get("class", "")

    def children(self, name: str | None = None, css: str | None = None) -> list[Node]:
        return [c for c in self.content if isinstance(c, Node) and (name is None or c.name == name) and (css is None or c.css == css)]

    def walk(self) -> Iterator[Node]:
        """This element and all below, in document order."""
        todo: list[Node] = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += reversed(node.children())

    def text(self) -> str:
        out: list[str] = []
        todo: list[Node | str] = [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            elif not _is_footnote(x):
                todo += reversed(x.content)
        return " ".join("".join(out).split())

    def above(self) -> Iterator[Node]:
        node = self.parent
        while node:
            yield node
            node = node.parent


def _is_footnote(node: Node) -> bool:
    """Footnote bodies, and the links that carry their marks; text after them stays."""
    if node.name == "p" and node.css == NOTE:
        return True
    return node.name == "a" and any(n.name == "span" and NOTE_TAG in n.css for n in node.walk() if n is not node)


def tree(raw: bytes) -> Node:
    root = Node("", {})
    at = [root]
    parser = expat.ParserCreate(namespace_separator=" ")
    parser.buffer_text = True

    def start(name: str, attributes: dict[str, str]) -> None:
        node = Node(name.rpartition(" ")[2], attributes, at[-1])
        at[-1].content.append(node)
        at.append(node)

    def refuse(*_: object) -> None:
        raise ValueError("declarations and entities are not read")

    def document_type(_name: str, _system: str | None, _public: str | None, declares: int) -> None:
        if declares:
            refuse()

    parser.StartElementHandler = start
    parser.EndElementHandler = lambda _: at.pop()
    parser.CharacterDataHandler = lambda s: at[-1].content.append(s)
    parser.EntityDeclHandler = refuse
    parser.StartDoctypeDeclHandler = document_type
    parser.Parse(raw, True)
    return root


def labelled_blocks(node: Node, skip: bool = False, compat_nested_rows: bool = False) -> list[tuple[str | None, str]]:
    """(label, text) blocks below an element. The left of two cells labels the first block of the right one.

    Rows of a table inside a cell come once; ``compat_nested_rows`` gives them a second time, as rows of the outer table.
    """
    out: list[tuple[str | None, str]] = []
    for child in node.children():
        if _is_footnote(child):
            continue
        if child.name == "p" and not (skip and child.css in HEADINGS):
            out += [(None, t)] if (t := child.text()) else []
        elif child.name == "div" and not (skip and child.css == TITLE_BOX):
            out += labelled_blocks(child, skip, compat_nested_rows)
        elif child.name == "table":
            out += _rows(child, compat_nested_rows)
    return out


def _rows(table: Node, compat: bool) -> list[tuple[str | None, str]]:
    out: list[tuple[str | None, str]] = []
    for row in (n for n in table.walk() if n.name == "tr"):
        inner = next((a for a in row.above() if a.name == "table"), None)
        if inner is not table and not compat:
            continue
        cells = row.children("td")
        if len(cells) != 2:
            for cell in cells:
                out += labelled_blocks(cell, False, compat)
            continue
        blocks = labelled_blocks(cells[1], False, compat)
        if blocks:
            out += [(cells[0].text() or blocks[0][0], blocks[0][1]), *blocks[1:]]
    return out


def paragraphs(node: Node, kind: str, compat: bool = False) -> list[dict[str, str | None]]:
    numbered = [c for c in node.children("div") if _NUMBERED.match(c.id)]
    if numbered:
        out = []
        for c in numbered:
            lines = [f"{label} {text}" if label else text for label, text in labelled_blocks(c, False, compat)]
            out.append({"label": str(int(c.id[4:])), "text": re.sub(r"^\d+\.\s+", "", "\n".join(lines).strip())})
        return out
    return [{"label": None if kind == "rct" else label, "text": text} for label, text in labelled_blocks(node, True, compat) if text]


def provisions(raw: bytes, source_id: str, language: str, short_title: str, compat: bool = False) -> list[dict]:
    """Rows of an act (see ``schemas.PROVISIONS``), in document order."""
    out: list[dict] = []
    for node in tree(raw).walk():
        kind, _, number = node.id.partition("_")
        if node.name != "div" or kind not in PREFIXES or "." in node.id or not number:
            continue
        title = None
        if kind == "art":
            title = next((n.text() for n in node.walk() if n.name == "p" and n.css == ARTICLE_TITLE), None)
        elif kind == "anx":
            titles = node.children("p", ANNEX_TITLE)
            title = titles[1].text() if len(titles) > 1 else None
        trail = []
        for part in node.above():
            if part.name == "div" and part.id.startswith("cpt_"):
                label = next((p.text() for p in part.children("p", PART_LABEL)), "")
                name = next((p.text() for box in part.children("div", TITLE_BOX) for p in box.children("p", PART_NAME)), "")
                trail.append(DASH.join(x for x in (label, name) if x))
        own = DASH.join(x for x in (PREFIXES[kind].format(number), title) if x)
        out.append({
            "provision_id": f"{source_id}:{kind}:{number}", "document_id": f"{source_id}:{language}", "source_id": source_id, "language": language, "kind": kind, "number": number, "title": title,
            "breadcrumb": [short_title, *(x for x in reversed(trail) if x), own], "paragraphs": paragraphs(node, kind, compat), "ord": len(out),
        })
    return out


def _parsed(files: DataFrame, compat_nested_rows: bool) -> DataFrame:
    """Provisions with a further column ``error``; a file that can't be read is one row with its error."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = T.StructType([*PROVISIONS.fields, T.StructField("error", T.StringType())])
    kinds = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, source, language, title in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                try:
                    if content is None:
                        raise ValueError("no content")
                    rows = provisions(content, source, language, title, compat_nested_rows)
                except (expat.ExpatError, ValueError) as e:
                    rows = [{"document_id": f"{source}:{language}", "source_id": source, "language": language, "error": f"{type(e).__name__}: {e}"}]
                if rows:
                    yield pa.RecordBatch.from_pylist([{f.name: r.get(f.name) for f in out.fields} for r in rows], kinds)

    return files.select("content", "source_id", "language", "short_title").mapInArrow(run, out)


def parse_acts(files: DataFrame, compat_nested_rows: bool = False) -> DataFrame:
    """Provisions of files (content, source_id, language, short_title); one file is one row and is parsed in one task. Files that
    can't be read have none: see ``failures``."""
    return _parsed(files, compat_nested_rows).where("error is null").drop("error")


def failures(files: DataFrame) -> DataFrame:
    """(document_id, source_id, language, error) of files that can't be read."""
    return _parsed(files, False).where("error is not null").select("document_id", "source_id", "language", "error")


class ActBlocks:
    """The blocks of an act as rows, for a lateral join with the files: one row a paragraph, or one with the error."""

    def eval(self, content: bytes, compat_nested_rows: bool) -> Iterator[tuple]:
        try:
            if content is None:
                raise ValueError("no content")
            found = provisions(bytes(content), "", "", "", bool(compat_nested_rows))
        except (expat.ExpatError, ValueError) as e:
            yield None, None, None, None, None, None, f"{type(e).__name__}: {e}"
            return
        for p in found:
            for k, own in enumerate(p["paragraphs"]):
                yield p["ord"], p["kind"], p["number"], k, own["label"], own["text"], None


def act_blocks(files: DataFrame, compat_nested_rows: bool = False) -> DataFrame:
    """``files`` (content, ...) with a row for each block of each act: ord, kind, number, part, label, text, or error."""
    walk = F.udtf(ActBlocks, returnType="ord int, kind string, number string, part int, label string, text string, error string")
    return files.lateralJoin(walk(F.col("content").outer(), F.lit(compat_nested_rows))).drop("content")
