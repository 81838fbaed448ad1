import json

import pytest

from scriptorium.operators import flatten
from scriptorium.schema import PAGE

SCHEMA = f"upload_id bigint, pages array<{PAGE}>, payload string, page_pos string"


def cell(t):
    return (t, False, False)


def block(**kw):
    names = ["type", "text", "level", "items", "ordered", "pairs", "checked", "uncertain", "confidence", "header_rows", "rows"]
    return tuple(kw.get(n) for n in names)


def run(spark, rows):
    return {tuple(r) for r in flatten.flatten(spark.createDataFrame(rows, SCHEMA), fields=False).collect()}


def brute(uid, doc):
    """The same by plain loops over parsed JSON."""
    out, pages = set(), doc["pages"]
    for p, page in enumerate(pages if isinstance(pages, list) else [pages]):
        if page is None:
            continue
        out.add((uid, "page", p, -1, -1, -1))
        for b, blk in enumerate(page.get("blocks") or []):
            if blk is None:
                continue
            out.add((uid, "block", p, b, -1, -1))
            pairs = blk.get("pairs") or []
            for i, x in enumerate(pairs):
                if x is not None:
                    out.add((uid, "pair", p, b, i, -1))
            for r, row in enumerate(blk.get("rows") or []):
                for c, x in enumerate(row or []):
                    if x is not None:
                        out.add((uid, "cell", p, b, r, c))
    return out


def test_typed_with_nulls_at_every_level(spark):
    pages = [None, (1, None, [None, block(type="table", rows=[None, [], [cell("a"), None, cell("")]], pairs=[None, ("k", "v", False)])]), (2, "n", None)]
    assert run(spark, [(1, pages, None, "clash")]) == {
        (1, "page", 1, -1, -1, -1), (1, "page", 2, -1, -1, -1), (1, "block", 1, 1, -1, -1),
        (1, "cell", 1, 1, 2, 0), (1, "cell", 1, 1, 2, 2), (1, "pair", 1, 1, 1, -1),
    }


@pytest.mark.parametrize("wrap", [lambda d: d, lambda d: {"document": d}, lambda d: {"status": "ok", "result": {"document": d}}])
def test_payload_shapes_match_brute_force(spark, wrap):
    doc = {"pages": [{"blocks": [{"type": "table", "rows": [["a", {"text": "b"}], None, [None, "c"]], "pairs": {"x": "1", "y": "2"}}, None]}, None, {"page_number": "7", "blocks": []}]}
    rows = [(5, None, "﻿" + json.dumps(wrap(doc)), None)]
    assert run(spark, rows) == brute(5, doc)


def test_single_page_json_text_and_repeated_names(spark):
    inner = json.dumps([{"pairs": [{"key": "a", "value": "b"}]}])
    payload = '{"pages": {"page_number": 1, "blocks": ' + json.dumps(inner) + "}}"
    assert run(spark, [(1, None, payload, None)]) == {(1, "page", 0, -1, -1, -1), (1, "block", 0, 0, -1, -1), (1, "pair", 0, 0, 0, -1)}
    twice = '{"pages": [{"blocks": [{"pairs": {"a": "1", "a": "2"}}]}]}'
    assert {r[4] for r in run(spark, [(1, None, twice, None)]) if r[1] == "pair"} == {0, 1}


def test_broken_empty_and_null(spark):
    rows = [(1, None, '{"pages": [{"blocks": [', None), (2, None, "", None), (3, None, None, None), (4, [], None, None), (5, None, "[[[", None), (6, None, '"x"', None)]
    assert run(spark, rows) == set()
    assert run(spark, []) == set()


def test_fields_reach_the_tables(spark, tmp_path):
    doc = {"pages": [{"page_number": 3, "notes": "n", "blocks": [{"type": "table", "confidence": "0.5", "header_rows": "1", "rows": [["a"]], "pairs": [{"key": "k", "value": "v"}]}]}]}
    flat = flatten.flatten(spark.createDataFrame([(9, None, json.dumps(doc), None)], SCHEMA))
    t = flatten.write_tables(flat, str(tmp_path / "t"))
    assert t["page"].first().page_number == 3 and t["block"].first().confidence == 0.5 and t["block"].first().header_rows == 1
    assert t["cell"].first().text == "a" and t["pair"].first().value == "v"


def test_repeated_documents_and_long_texts(spark):
    doc = json.dumps({"pages": [{"blocks": [{"text": "x" * 300_000}]}]})
    rows = flatten.flatten(spark.createDataFrame([(1, None, doc, None)] * 3, SCHEMA), fields=False).collect()
    assert len(rows) == 6
