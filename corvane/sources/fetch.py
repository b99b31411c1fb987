"""Fetching sources into the raw folder, and the lines of PDF files."""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import write_downloads


@dataclass(frozen=True)
class FetchResult:
    record: dict
    changed: bool


def open_url(url: str, headers: dict[str, str]) -> bytes:
    import urllib.request

    with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=60) as reply:
        return reply.read()


def chosen(sources: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """The sources asked for, all if none are named; an unknown id is a KeyError."""
    if not ids:
        return sources
    known = {r["id"] for r in sources.select("id").collect()}  # a manifest is a handful of rows
    if missing := sorted(set(ids) - known):
        raise KeyError(f"unknown sources {', '.join(missing)}; known: {', '.join(sorted(known))}")
    return sources.where(F.col("id").isin(list(ids)))


def fetch(wanted: DataFrame, folder: str, opener: Callable[[str, dict[str, str]], bytes] = open_url, force: bool = False) -> list[FetchResult]:
    """Files of ``files.downloads_wanted`` below ``folder``. What the folder's manifest has, with its file unchanged, isn't asked for again
    unless ``force``; the manifest is written once all are there. An empty reply is an error."""
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/manifest.json"
    known = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            known = json.load(f)
    out = []
    for r in wanted.orderBy("filename").toLocalIterator():
        target, had = f"{folder}/{r['filename']}", known.get(r["filename"])
        if had and not force and os.path.exists(target) and hashlib.sha256(_read(target)).hexdigest() == had["sha256"]:
            out.append(FetchResult(had, False))
            continue
        content = opener(r["url"], {k: v for k, v in (("Accept", r["accept"]), ("Accept-Language", r["accept_language"])) if v})
        if not content:
            raise ValueError(f"{r['url']} gave nothing")
        digest = hashlib.sha256(content).hexdigest()
        own = f"{target}.new"
        with open(own, "wb") as f:
            f.write(content)
        os.replace(own, target)
        record = {"source_id": r["source_id"], "language": r["language"], "url": r["url"], "filename": r["filename"], "sha256": digest, "size_bytes": len(content), "fetched_at": datetime.now(UTC).isoformat()}
        out.append(FetchResult(record, had is None or had["sha256"] != digest))
    write_downloads([*(v for k, v in known.items() if k not in {x.record["filename"] for x in out}), *(x.record for x in out)], path)
    return out


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


_STREAM = re.compile(rb"<<(?P<head>(?:[^<>]|<<.*?>>|<[^<>]*>)*?)>>\s*stream\r?\n(?P<data>.*?)\r?\nendstream", re.S)
_SHOWN = re.compile(rb"\((?P<text>(?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*)\)|<(?P<hex>[0-9A-Fa-f\s]*)>|(?P<gap>-?\d+(?:\.\d+)?)(?=[^\[\]]*\]\s*TJ)|(?P<op>T\*|TD|Td|Tm|ET|'|\")", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _literal(raw: bytes) -> str:
    plain = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPES.get(m[1], b"" if m[1].strip() == b"" else m[1]), raw, flags=re.S)
    return plain.decode("utf-16") if plain[:2] in (b"\xfe\xff", b"\xff\xfe") else plain.decode("cp1252", "replace")


def pdf_pages(content: bytes) -> list[list[str]]:
    """Lines of the text streams of a PDF file, stream by stream: of plain and deflated ones, in standard encodings. Text in
    fonts with encodings of their own, and in object streams, isn't read."""
    out = []
    for m in _STREAM.finditer(content):
        data = m["data"]
        if b"FlateDecode" in m["head"]:
            try:
                data = zlib.decompressobj().decompress(data)
            except zlib.error:
                continue
        elif b"/Filter" in m["head"]:
            continue
        if b"BT" not in data or not re.search(rb"T[jJ]|'", data):
            continue
        lines, line = [], ""
        for block in re.findall(rb"BT\b(.*?\bET)\b", data, re.S):
            for x in _SHOWN.finditer(block):
                if x["text"] is not None:
                    line += _literal(x["text"])
                elif x["hex"] is not None:
                    line += _literal(bytes.fromhex("".join(x["hex"].decode().split()).ljust(2, "0")))
                elif x["gap"] is not None:
                    line += " " * (float(x["gap"]) < -200 and not line.endswith(" "))
                elif line.strip():
                    lines.append(line.rstrip())
                    line = ""
                else:
                    line = ""
        if line.strip():
            lines.append(line.rstrip())
        if lines:
            out.append(lines)
    return out


def pdf_lines(files: DataFrame) -> DataFrame:
    """(filename, page, line, text, error) of PDF files (filename, content): a file that can't be read is one row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    if not content or not content.lstrip().startswith(b"%PDF"):
                        raise ValueError("not a PDF file")
                    rows = [(p, k, text) for p, lines in enumerate(pdf_pages(content), 1) for k, text in enumerate(lines, 1)]
                    error = None if rows else "no text that can be read"
                except ValueError as e:
                    rows, error = [], str(e)
                rows = rows or [(None, None, None)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.string()))), pa.array([error] * len(rows), pa.string())], ["filename", "page", "line", "text", "error"])

    return files.select("filename", "content").mapInArrow(run, "filename string, page int, line int, text string, error string")
