"""Deeply nested documents to flat tables of pages, blocks, cells and pairs.

The tree is flattened on Arrow buffers: at each level list offsets give the child array, parent-index kernels give every
child its parent, and the keys of the parents reach the children by a vectorised take. No row is walked in Python for the
typed column; JSON payloads are parsed once each into the same Arrow type and then flattened by the same kernels.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL = pa.struct([("text", pa.string()), ("uncertain", pa.bool_()), ("struck", pa.bool_())])
PAIR = pa.struct([("key", pa.string()), ("value", pa.string()), ("uncertain", pa.bool_())])
BLOCK = pa.struct(
    [
        ("type", pa.string()), ("text", pa.string()), ("level", pa.int32()), ("items", pa.list_(pa.string())),
        ("ordered", pa.bool_()), ("pairs", pa.list_(PAIR)), ("checked", pa.bool_()), ("uncertain", pa.bool_()),
        ("confidence", pa.float64()), ("header_rows", pa.int32()), ("rows", pa.list_(pa.list_(CELL))),
    ]
)
PAGE = pa.struct([("page_number", pa.int32()), ("notes", pa.string()), ("blocks", pa.list_(BLOCK))])
PAGES = pa.list_(PAGE)

#: The flat columns in order; a kind fills its own and leaves the others null.
KEYS = [("kind", pa.string()), ("page_pos", pa.int32()), ("block_pos", pa.int32()), ("row_pos", pa.int32()), ("col_pos", pa.int32())]
FIELDS = [
    ("page_number", pa.int32()), ("notes", pa.string()), ("type", pa.string()), ("text", pa.string()), ("level", pa.int32()),
    ("items", pa.list_(pa.string())), ("ordered", pa.bool_()), ("checked", pa.bool_()), ("uncertain", pa.bool_()),
    ("struck", pa.bool_()), ("confidence", pa.float64()), ("header_rows", pa.int32()), ("key", pa.string()), ("value", pa.string()),
]
SQL_TYPE = {pa.string(): "string", pa.int32(): "int", pa.bool_(): "boolean", pa.float64(): "double", pa.list_(pa.string()): "array<string>"}


class Members(dict):
    """A JSON object that also keeps its members as written, repeated names included."""

    def __init__(self, members: list[tuple[str, object]]):
        super().__init__(members)
        self.members = members


def _number(x: object, kind: type) -> object:
    try:
        return None if x is None or isinstance(x, (dict, list)) else kind(float(x))
    except (TypeError, ValueError, OverflowError):
        return None


def _int(x: object) -> int | None:
    n = _number(x, int)
    return n if n is not None and -(2**31) <= n < 2**31 else None


def _text(x: object) -> str | None:
    if x is None:
        return None
    s = x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)
    return s.encode("utf-8", "replace").decode() if not s.isascii() else s


def _flag(x: object) -> bool | None:
    return x if isinstance(x, bool) else {"true": True, "false": False}.get(str(x).strip().lower())


def _parse(s: str) -> object:
    return json.loads(s.lstrip("﻿ \t\r\n"), object_pairs_hook=Members)


def _list(x: object) -> list | None:
    """An array, also where it was written as JSON text or as its only element without an array around it."""
    if isinstance(x, str):
        try:
            x = _parse(x)
        except (ValueError, RecursionError):
            return None
    return x if isinstance(x, list) else [x] if isinstance(x, dict) else None


def _cell(x: object) -> dict | None:
    if x is None:
        return None
    if not isinstance(x, dict):
        return {"text": _text(x)}
    return {"text": _text(x.get("text")), "uncertain": _flag(x.get("uncertain")), "struck": _flag(x.get("struck"))}


def _pair(x: object) -> dict | None:
    if x is None:
        return None
    if not isinstance(x, dict):
        return {"value": _text(x)}
    return {"key": _text(x.get("key")), "value": _text(x.get("value")), "uncertain": _flag(x.get("uncertain"))}


def _pairs(x: object) -> list | None:
    if isinstance(x, str):
        try:
            x = _parse(x)
        except (ValueError, RecursionError):
            return None
    if isinstance(x, Members):
        return [{"key": _text(k), "value": _text(v)} for k, v in x.members]
    return [_pair(p) for p in x] if isinstance(x, list) else None


def _row(x: object) -> list | None:
    if isinstance(x, dict) and "cells" in x:
        x = x["cells"]
    return None if (cells := _list(x)) is None else [_cell(c) for c in cells]


def _block(x: object) -> dict | None:
    if x is None:
        return None
    if not isinstance(x, dict):
        return {"text": _text(x)}
    rows, items = _list(x.get("rows")), x.get("items")
    return {
        "type": _text(x.get("type")), "text": _text(x.get("text")), "level": _int(x.get("level")),
        "items": [_text(i) for i in items] if isinstance(items, list) else None, "ordered": _flag(x.get("ordered")),
        "pairs": _pairs(x.get("pairs")), "checked": _flag(x.get("checked")), "uncertain": _flag(x.get("uncertain")),
        "confidence": _number(x.get("confidence"), float), "header_rows": _int(x.get("header_rows")),
        "rows": None if rows is None else [_row(r) for r in rows],
    }


def _page(x: object) -> dict | None:
    if x is None:
        return None
    if not isinstance(x, dict):
        return {}
    blocks = _list(x.get("blocks"))
    return {"page_number": _int(x.get("page_number")), "notes": _text(x.get("notes")), "blocks": None if blocks is None else [_block(b) for b in blocks]}


def pages_of(payload: str | None) -> list | None:
    """The pages of a JSON payload in the typed shape; None for one that is null or not complete JSON."""
    if payload is None:
        return None
    try:
        doc = _parse(payload)
        for _ in range(8):  # wrappers and JSON text within JSON text
            if isinstance(doc, str):
                doc = _parse(doc)
            elif isinstance(doc, dict) and "pages" not in doc:
                inner = next((doc[k] for k in ("document", "result") if doc.get(k) is not None), None)
                if inner is None:
                    return None
                doc = inner
            else:
                break
        pages = _list(doc.get("pages")) if isinstance(doc, dict) else doc if isinstance(doc, list) else None
        return None if pages is None else [_page(p) for p in pages]
    except (ValueError, RecursionError):
        return None


def _children(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Parent index, position and value of each element of a list array, null elements left out but counted."""
    parent = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    values = lists.flatten()
    position = np.arange(len(parent)) - np.searchsorted(parent, parent)
    there = values.is_valid().to_numpy(zero_copy_only=False)
    if not there.all():
        parent, position, values = parent[there], position[there], values.filter(pa.array(there))
    return parent, position.astype(np.int32), values


def flatten_arrays(ids: pa.Array, pages: pa.Array, id_name: str, fields: bool) -> Iterator[pa.RecordBatch]:
    """The flat rows of one batch of documents, kind after kind."""
    minus = lambda n: np.full(n, -1, np.int32)

    def emit(kind: str, owner: pa.Array, keys: list[np.ndarray], values: pa.Array) -> pa.RecordBatch:
        n = len(values)
        columns = [owner, pa.repeat(pa.scalar(kind), n), *map(pa.array, keys)]
        names = [id_name, *(k for k, _ in KEYS)]
        if fields:
            own = {f.name for f in values.type}
            columns += [pc.struct_field(values, name) if name in own else pa.nulls(n, t) for name, t in FIELDS]
            names += [name for name, _ in FIELDS]
        return pa.RecordBatch.from_arrays(columns, names)

    up, page_pos, page = _children(pages)
    owner = ids.take(pa.array(up))
    yield emit("page", owner, [page_pos, minus(len(page)), minus(len(page)), minus(len(page))], page)

    up, block_pos, block = _children(pc.struct_field(page, "blocks"))
    owner, page_pos = owner.take(pa.array(up)), page_pos[up]
    yield emit("block", owner, [page_pos, block_pos, minus(len(block)), minus(len(block))], block)

    up, pair_pos, pair = _children(pc.struct_field(block, "pairs"))
    yield emit("pair", owner.take(pa.array(up)), [page_pos[up], block_pos[up], pair_pos, minus(len(pair))], pair)

    up, row_pos, row = _children(pc.struct_field(block, "rows"))
    above, col_pos, cell = _children(row)
    at = up[above]
    yield emit("cell", owner.take(pa.array(at)), [page_pos[at], block_pos[at], row_pos[above], col_pos], cell)


def flatten(df: DataFrame, id_col: str = "upload_id", pages_col: str = "pages", payload_col: str = "payload", fields: bool = True) -> DataFrame:
    """One row for each page, block, cell and pair of `df`, with the document's id and the positions of its parents.

    Result: id, kind (page, block, cell, pair), page_pos, block_pos, row_pos, col_pos (-1 where a kind has none) and, with
    `fields`, the columns of FIELDS. Positions are those in the arrays; null elements are counted but give no row.

    A document with `pages` is taken from there; else from `payload`, JSON in any of these shapes: the document itself,
    or inside document or result.document; pages, blocks or rows as an array, as JSON text of one, or as a single element
    (position 0); cells as objects or plain texts; pairs as an array or an object (in written order, repeated names
    included). Numbers and booleans written as text are read, what can't be read is null. Null documents, broken JSON,
    empty tables: no rows. Repeated documents each count. Extra columns of `df` are ignored, whatever their names.
    A document is one row, so it is held by one task; nothing else is gathered, and there is no shuffle.
    """
    id_type = df.schema[id_col].dataType
    schema = f"{id_col} {id_type.simpleString()}, " + ", ".join(f"`{n}` {SQL_TYPE[t]}" for n, t in [*KEYS, *(FIELDS if fields else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, typed, text = b.column(0), b.column(1), b.column(2)
            has = typed.is_valid()
            if pc.any(has).as_py():
                yield from flatten_arrays(ids.filter(has), typed.filter(has).cast(PAGES), id_col, fields)
            other = pc.and_(pc.invert(has), text.is_valid())
            if pc.any(other).as_py():
                parsed = pa.array([pages_of(s) for s in text.filter(other).to_pylist()], PAGES)
                yield from flatten_arrays(ids.filter(other), parsed, id_col, fields)

    return df.select(F.col(id_col), F.col(pages_col).alias("pages"), F.col(payload_col).alias("payload")).mapInArrow(run, schema)


def tables(flat: DataFrame) -> dict[str, DataFrame]:
    """The four related tables of a flattened result, each with its own columns. Write `flat` partitioned by kind first
    (write_tables) if more than one is used, so the documents are read once."""
    key = flat.columns[0]
    own = {
        "page": ["page_pos", "page_number", "notes"],
        "block": ["page_pos", "block_pos", "type", "text", "level", "items", "ordered", "checked", "uncertain", "confidence", "header_rows"],
        "cell": ["page_pos", "block_pos", "row_pos", "col_pos", "text", "uncertain", "struck"],
        "pair": ["page_pos", "block_pos", "row_pos", "key", "value", "uncertain"],
    }
    return {k: flat.where(F.col("kind") == k).select(key, *c) for k, c in own.items()}


def write_tables(flat: DataFrame, folder: str) -> dict[str, DataFrame]:
    """Write the flat rows once, partitioned by kind, and return the four tables read from there."""
    flat.write.mode("overwrite").partitionBy("kind").parquet(folder)
    return tables(flat.sparkSession.read.parquet(folder).select(flat.columns))
