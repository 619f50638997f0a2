"""The data source of paged collections: all kinds, declared files, and inputs that must not be empty."""

import json

import pytest

from sparkloom.sources import collections as C


def rows(spark, path, kind, **options):
    return [tuple(r) for r in C.collection(spark, str(path), kind, **options).orderBy("file", "item").collect()]


def test_kinds(spark, tmp_path):
    for k in ("j", "x", "h"):
        (tmp_path / k / "_temporary").mkdir(parents=True)
    (tmp_path / "j/p1.json").write_text(json.dumps({"page": 1, "total": "3", "notes": [], "rows": [{"a": "é", "b": {"c": [1]}}, {"a": None, "n": 2}]}))
    (tmp_path / "j/p2.json").write_text(json.dumps([{"a": "last"}]))
    (tmp_path / "j/.p1.json.crc").write_text("not read")
    assert rows(spark, tmp_path / "j", "json", required="p1,p2.json") == [("p1.json", 1, 3, 0, {"a": "é", "b": '{"c": [1]}'}), ("p1.json", 1, 3, 1, {"a": None, "n": "2"}), ("p2.json", None, None, 0, {"a": "last"})]
    (tmp_path / "x/a.xml").write_text("<r page='7'><g><row id='1'><t> x &amp; <b>y</b></t><t>second</t><e/></row></g><row id='2'/></r>")
    assert rows(spark, tmp_path / "x", "xml", item="row") == [("a.xml", 7, None, 0, {"id": "1", "t": "x & y", "e": None}), ("a.xml", 7, None, 1, {"id": "2"})]
    (tmp_path / "h/a.html").write_text("<meta name=total content=2><p>out: side</p><article>k: v<br>k: w<style>s: t</style><p>url : a:b</article><article><p>none</article>")
    assert rows(spark, tmp_path / "h", "html") == [("a.html", None, 2, 0, {"k": "v", "url": "a:b"}), ("a.html", None, 2, 1, {})]


def test_what_is_missing_stops(spark, tmp_path):
    with pytest.raises(Exception, match="no files"):
        rows(spark, tmp_path, "json")
    (tmp_path / "a.json").write_text('{"rows": []}')
    with pytest.raises(Exception, match="b.json"):
        rows(spark, tmp_path, "json", required="a.json,b.json")
    with pytest.raises(Exception, match="has no items"):
        rows(spark, tmp_path, "json")
    with pytest.raises(Exception, match="kind must be"):
        rows(spark, tmp_path, "csv")


def test_partitions_are_files(tmp_path, monkeypatch):
    for k in range(6):
        (tmp_path / f"{k}.json").write_text("x" * 10)
    monkeypatch.setattr(C, "PART_BYTES", 25)
    parts = C.CollectionReader({"path": str(tmp_path), "kind": "json"}).partitions()
    assert [len(p.names) for p in parts] == [2, 2, 2]
