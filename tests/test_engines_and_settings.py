"""Engines for images, orders of boxes, settings, hooks and the command line."""

import io
import json

import numpy as np
import pytest

from sheafspark import callbacks, cli, config
from sheafspark.operators import boxes as B
from sheafspark.operators import ocr


def stub(*blocks, width=900, height=1000) -> bytes:
    return json.dumps({"width": width, "height": height, "blocks": blocks}).encode()


class Broken(ocr.Stub):
    def texts(self, crops):
        if any("bad" in json.loads(i)["blocks"][0][7] for i, _, _ in crops):
            raise RuntimeError("no")
        return super().texts(crops)


def test_engine(spark):
    page = stub(["text", 0.9, 0, 500, 400, 600, 2, "second"], ["doc_title", 0.9, 0, 0, 400, 100, 1, "first"], ["text", 0.2, 0, 700, 400, 800, 3, "unsure"], ["image", 0.8, 0, 0, 900, 1000, 4, "whole"], ["header", 0.9, 500, 0, 990, 90, 0, "head"])
    small = stub(["text", 0.9, 1, 1, 5, 5, 1, "a"], ["text", 0.9, 6, 6, 9, 9, 2, "b"], width=100, height=80)
    pdf = json.dumps({"pages": [json.loads(page) | {"width": 324, "height": 360}, json.loads(small) | {"width": 36, "height": 28.8}]}).encode()
    files = spark.createDataFrame([("p.png", "image", page), ("s.png", "image", small), ("d.pdf", "pdf", pdf), ("x.pdf", "pdf", b"broken")], "path string, category string, content binary")
    rows = {(r.doc_id, r.page_id): r for r in ocr.pages(files, ocr.Stub).collect()}
    assert (rows["d.pdf", 1].width, rows["d.pdf", 2].height) == (900, 80) and "JSON" in rows["x.pdf", 1].error
    got = {(r.doc_id, r.page_id): r.content for r in ocr.read(files, ocr.Stub, turn=True, drop=("header",)).collect()}
    assert got == {("p.png", 1): "# first\nsecond", ("s.png", 1): "a\nb", ("d.pdf", 1): "# first\nsecond", ("d.pdf", 2): "a\nb", ("x.pdf", 1): ""}
    found = ocr.layout(ocr.pages(files, ocr.Stub), ocr.Stub, use_layout=False).collect()
    assert {(r.label, r.x2, r.y2) for r in found if r.doc_id == "p.png"} == {("text", 900.0, 1000.0)}
    bad = spark.createDataFrame([("b.png", "image", stub(["text", 0.9, 0, 0, 600, 100, 1, "bad"])), ("g.png", "image", stub(["text", 0.9, 0, 0, 600, 100, 1, "good"]))], "path string, category string, content binary").coalesce(1)
    images = ocr.pages(bad, ocr.Stub)
    done = {r.doc_id: r for r in ocr.recognised(ocr.arranged(ocr.layout(images, ocr.Stub), images), images, Broken, batch=1).collect()}
    assert done["b.png"].content == "" and "RuntimeError" in done["b.png"].error and done["g.png"].content == "good" and done["g.png"].error is None
    clips = spark.createDataFrame([("a.wav", b"hello")], "path string, content binary")
    assert ocr.transcribed(clips, ocr.Stub).first().content == "hello"
    with pytest.raises(NotImplementedError):
        ocr.Engine().layout([])
    assert ocr.size_of(b"\x89PNG\r\n\x1a\n" + bytes(8) + (7).to_bytes(4, "big") + (9).to_bytes(4, "big")) == (7, 9) and ocr.size_of(b"?") == (0, 0)
    assert json.loads(ocr.request(b"x", "table", "m", 5))["messages"][0]["content"][1]["text"] == "Table Recognition:"
    assert ocr.ctc_lines(np.array([[0.1, 0.9, 0], [0.2, 0.8, 0], [0.9, 0.1, 0], [0.1, 0.7, 0.2], [0, 0.1, 0.9]]), "ab") == ("aab", pytest.approx((0.9 + 0.7 + 0.9) / 3))


def test_nested_boxes(spark):
    rows = [(1, 0, "text", 0.0, 0.0, 10.0, 10.0), (1, 1, "text", 1.0, 1.0, 5.0, 5.0), (1, 2, "image", 2.0, 2.0, 4.0, 4.0), (1, 3, "text", 20.0, 0.0, 30.0, 9.0)]
    df = spark.createDataFrame(rows, "page int, k int, label string, x1 double, y1 double, x2 double, y2 double")
    keep = lambda how: {r.k for r in B.without_nested(df, ["page"], "k", how, ("image",)).collect()}
    assert keep("large") == {0, 2, 3} and keep("small") == {1, 2, 3}


def test_orders():
    own = [(0, 0, 100, 10), (0, 20, 45, 100), (55, 20, 100, 100)]
    assert B.projected_order(own) == B.merged_order(own) == [0, 1, 2] and B.projected_order([]) == []
    assert B.quad_order([(50, 0), (0, 5), (20, 30)]) == [1, 0, 2]
    # with a beta that lets some lie across, they stand before what begins under them
    assert B.crossing(own, 0.9) == [0] and B.merged_order([(0, 50, 100, 60), (0, 0, 45, 40), (55, 0, 100, 40), (0, 70, 45, 99), (55, 70, 100, 99)], 0.9) == [1, 2, 0, 3, 4]
    assert B.union_area([(0, 0, 10, 10), (5, 5, 15, 15)]) == 175 and B.union_area([]) == 0


def test_settings(tmp_path):
    data = {"a": {"n": 3, "x": "${n}", "y": "v${a.n}"}, "env": "${oc.env:NO_SUCH,5}", "q": "${oc.env:NO_SUCH,'5'}", "home": "at ${oc.env:SHEAF}", "gone": "${no.where}", "list": ["${a.n}"], "chain": "${a.x}"}
    out = config.resolved(data, env={"SHEAF": "true"})
    assert out == {"a": {"n": 3, "x": 3, "y": "v3"}, "env": 5, "q": "5", "home": "at true", "gone": "${no.where}", "list": [3], "chain": 3}
    assert [config.scalar(x) for x in ("true", "7", "1.5", "[1]", "[x", "a")] == [True, 7, 1.5, [1], "[x", "a"]
    assert config.merged({"a": {"b": 1, "c": 2}, "d": 1}, {"a": {"c": 3}, "d": {"e": 1}}) == {"a": {"b": 1, "c": 3}, "d": {"e": 1}}
    assert config.lookup(data, "a.n") == 3 and config.lookup(data, "a.z.b") is None
    assert config.payload({"encoding": "x", "k": 1}, {"k": 2, "j": None}, "utf-8") == {"encoding": "utf-8", "k": 2}
    assert config.equal({"a": 1, "created": 2}, {"a": 1, "created": 3}) and not config.equal({"a": 1}, {"a": 2})
    own = {"name": "x y", "n": 3, "f": 1.5, "on": True, "list": [1, 2], "in": {"k": "v", "deep": {"z": 1}}}
    for suffix in ("json", "yaml", "toml"):
        config.save(own, tmp_path / f"c.{suffix}")
        assert config.load(tmp_path / f"c.{suffix}") == own
        assert config.load(io.BytesIO((tmp_path / f"c.{suffix}").read_bytes())) == own
    assert config.plain_yaml("# c\na:\n  b: 'x # y'\n  l:\n  - 1\n  - two\nc: null") == {"a": {"b": "x # y", "l": [1, "two"]}, "c": None}
    assert config.plain_yaml(config.dump_yaml(own)) == own
    for bad, error in (("[1]", TypeError), ("a b", (ValueError, TypeError))):
        with pytest.raises(error):
            config.loads(bad)
    with pytest.raises(ValueError):
        config.load("x.ini")
    assert config.imported("sheafspark.config.lookup") is config.lookup and config.bucket_key("s3://b/k/x") == ("b", "k/x")
    assert str(config.ParseError(415)) == "415: file type not supported" and config.STATUS[2000] == "success"


def test_hooks_and_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.txt").write_text("hello\n\n\nworld")
    (tmp_path / "b.xlsx").write_bytes(b"broken")
    assert cli.run(spark, ["types"]) == 0 and "csv: csv tsv" in capsys.readouterr().out
    assert cli.run(spark, ["parse", str(tmp_path / "a.txt")]) == 0 and capsys.readouterr().out == "hello\nworld\n"
    assert cli.run(spark, ["parse", str(tmp_path), "--out", str(tmp_path / "out"), "--quiet"]) == 1
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    with pytest.raises(SystemExit):
        cli.arguments([])

    class Seen(callbacks.Callback):
        def __init__(self):
            self.all = []

        def on_started(self, what):
            self.all.append(what)

        def on_finished(self, what, seconds, counts):
            self.all.append(counts)

    own = Seen()
    pages = spark.createDataFrame([(1, None), (2, "e")], "page int, error string")
    assert callbacks.observed("run", pages, lambda df: df.collect(), own) == {"pages": 2, "errors": 1} == own.all[1]
    listener = callbacks.watch(spark, own)
    spark.streams.removeListener(listener)
