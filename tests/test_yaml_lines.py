"""YAML whose values are JSON: written so by export.spdx_yaml, read as JSON, and no differently from a YAML loader."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from bomweave.plans import catalog
from bomweave.sources import export, files, star

yaml = pytest.importorskip("yaml")

HEAD = 'spdxVersion: "SPDX-2.3"\nSPDXID: "SPDXRef-DOCUMENT"\nname: "n"\ndocumentNamespace: "urn:n"\n'
SAME = [
    'a: "x"', 'a: [1, -0, 1e5, 1.50, NaN, "b"]\nb: {"c": {"d": [], "e": {}}}\n', 'a: "q\\"\\\\\\/\\b\\f\\n\\r\\t\\u00e9 # : - {"', 'a: {"k": 1, "k": 2}\na: 3', 'a: "中文 \U0001F600 é"', 'a:   [ "b" , "c" ]  ',
    'true: "a"', 'a: {"<<": {"b": "c"}, "=": "d"}', 'a: {"": "*x &y !z"}', 'a: "untrue nullify"\n\n',
]
OTHER = [
    "a: b", "a: true", "a: [false]", 'a: {"b":null}', "a: 012", "a: 'b'", 'a: "b" # c', 'a: "b"\n  "c"', 'a: "b\x85c"', 'a: "b c"', 'a: "b\x7fc"', 'a: "b\tc"', 'a: [\n1]', '- "a"', "a: &x 1\nb: *x", 'a: "b"\r\nc: "d"',
    '---\na: "b"', '"a": "b"', 'a: {b: "c"}', 'a: "﻿"', 'a: [1,]', 'a: ', "", "a: !!str 1", 'a: "b": "c"', "a: [1] [2]", 'a: "\xa0"',
]


@pytest.mark.parametrize("source", SAME)
def test_same_as_a_yaml_loader(source):
    assert files.json_lines(source) == yaml.load(source, Loader=yaml.BaseLoader)


@pytest.mark.parametrize("source", OTHER)
def test_all_other_texts_are_left_to_it(source):
    assert files.json_lines(source) is None


def test_random_values():
    draw = random.Random(7)
    letters = 'ab"\\/:,#[]{}&*!|>%@`\' -?~\n\r\t\x01é中\U0001F600'

    def value(depth):
        kind = draw.randrange(7 if depth else 5)
        if kind < 3:
            return "".join(draw.choices(letters, k=draw.randrange(8)))
        if kind < 5:
            return draw.choice([0, -1, 1.5, 1e300, True, None])
        if kind == 5:
            return [value(depth - 1) for _ in range(draw.randrange(4))]
        return {f"k{draw.choice(letters)}": value(depth - 1) for _ in range(draw.randrange(4))}

    read = 0
    for _ in range(2_000):
        source = "\n".join(f"k{i}: {json.dumps(value(3), ensure_ascii=draw.random() < 0.5)}" for i in range(3))
        if "\\ud" in source:  # a loader leaves halves of surrogate pairs apart
            continue
        found = files.json_lines(source)
        read += found is not None
        assert found is None or found == yaml.load(source, Loader=yaml.BaseLoader), source
    assert read > 500


def test_no_yaml_loader_takes_part(monkeypatch):
    source = HEAD + 'packages: [{"SPDXID":"SPDXRef-a","name":"a","versionInfo":"1"}]\nrelationships: [{"spdxElementId":"SPDXRef-a","relationshipType":"DEPENDS_ON","relatedSpdxElement":"NONE"}]'
    want = files.parse_text(source.replace("\n", "\r\n"), "x")  # by the loader
    monkeypatch.setattr(files, "_load_yaml", None)
    own = files.parse_text(source, "x")
    assert own == want and own.elements[0]["version"] == "1" and not own.failed


def test_only_what_is_wanted():
    source = (HEAD + 'packages: [{"SPDXID":"a","name":"a"},{"SPDXID":"b","versionInfo":"2"}]\nfiles: [{"SPDXID":"c","fileName":"./c"}]').encode()
    (whole,), (part,) = files.parse_file("x", source), files.parse_file("x", source, ["document", "elements"])
    assert "relationships" not in part and part["document"] == whole["document"] and whole["diagnostics"]
    assert [{k: e.get(k) for k in w} for e, w in zip(part["elements"], whole["elements"], strict=True)] == whole["elements"]
    fields = files.fields(document=["name"], elements=["spdx_id", "version"])
    assert [f.name for f in fields["elements"].dataType.elementType] == ["spdx_id", "version"]


@pytest.mark.parametrize("write", [export.spdx_json, export.spdx_yaml])
def test_texts_that_look_like_values(spark, small, write):
    """Names with brackets, quotes and line ends come back, and absent values give no entry."""
    ws = star.workspace(spark, small)
    names = ['[x] y: "z"', "{", ' {"a": 1}', "a\\b\nc\té", None]
    odd = ws.document.where("doc_id like 'r%'").withColumn("name", F.get(F.array(*map(F.lit, names)), F.col("ord").cast("int")))
    rows = files.scan(write(ws.with_tables(document=odd)))
    found = {r.doc_id: (r.failed, r.document.name) for r in rows.select("doc_id", "failed", "document").collect()}
    assert found == {f"urn:td:r{i}": (False, n or f"r{i}.spdx.{'json' if write is export.spdx_json else 'yaml'}") for i, n in enumerate(names)}


def test_fields_of_the_round_trip(spark, small):
    """What the query takes of its files is what it would take of whole rows."""
    want = catalog._elements(catalog._parsed(spark, small, export.spdx_yaml))
    own = catalog.spdx_yaml_roundtrip(spark, small)
    assert own.exceptAll(want).isEmpty() and want.exceptAll(own).isEmpty() and want.count() > 0
