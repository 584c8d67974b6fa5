"""Archives of exports: formats in one ZIP, streamed records, sniffed members, pruned columns."""

import io
import json
import random
import zipfile

import pytest

from wayfold.sources import browsers, takeout


def record(i):
    return {"url": f"https://a.org/{i}", "time_usec": 1_700_000_000_000_000 + i, "title": f'T "{i}" é\n[,]'}


def archive(path):
    other = {"Session": [1, {"x": "]}"}], "Browser History": [record(i) for i in range(5)], "After": None}
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("Takeout/Chrome/BrowserHistory.json", json.dumps({"Browser History": [record(i) for i in range(10, 13)]}, indent=1))
        z.writestr("Takeout/Chrome/History.json", json.dumps([record(i) for i in range(20, 22)]))
        z.writestr("Takeout/lines.jsonl", "\n".join(json.dumps(record(i)) for i in (30, 31)) + "\n\n")
        z.writestr("Takeout/Chrome/renamed.json", json.dumps(other))
        z.writestr("Takeout/Chrome/Bookmarks.html", "<html>")
        z.writestr("Takeout/Drive/photo.json", '{"a": 1}')
        z.writestr("Takeout/Chrome/Typed URL.json", "[]")


@pytest.mark.parametrize("chunk", [1, 2, 7, 1000])
def test_records_are_streamed_whatever_the_chunks(chunk):
    r = random.Random(chunk)
    values = [record(i) for i in range(20)] + [12, "a]b", None, [1, [2]], {"n": {"m": []}}]
    r.shuffle(values)
    read = lambda text, lines=False: [json.loads(x) for x in takeout.records(io.StringIO(text), lines, chunk)]
    assert read(json.dumps(values)) == values and read(" ﻿" + json.dumps({"x": {"BrowserHistory": 1}, "BrowserHistory": values}, indent=2)) == values
    assert read("\n".join(map(json.dumps, values)) + "\n \n", True) == values
    assert read("") == read("[]") == read("{}") == read('{"other": [1]}') == read('{"Browser History": {}}') == []
    with pytest.raises(json.JSONDecodeError):
        read('[{"a": 1}, {"b"')


def test_a_zip_of_all_formats(spark, tmp_path):
    archive(tmp_path / "one.zip")
    archive(tmp_path / "two.zip")
    found = {r.path: (r.family, r.disposition) for r in takeout.members(spark, str(tmp_path / "one.zip")).collect()}
    assert found["Takeout/Chrome/renamed.json"] == ("browser-json", "will-import") and found["Takeout/Drive/photo.json"][1] == "known-ignored" and len(found) == 7
    rows = takeout.read(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() == 8  # one a member
    got = sorted((r.archive.rsplit("/", 1)[1], r.path.rsplit("/", 1)[1], r.ordinal, json.loads(r.value)["url"]) for r in rows.collect())
    one = [("BrowserHistory.json", i, 10 + i) for i in range(3)] + [("History.json", i, 20 + i) for i in range(2)] + [("lines.jsonl", i, 30 + i) for i in range(2)] + [("renamed.json", i, i) for i in range(5)]
    assert got == sorted((z, name, i, f"https://a.org/{u}") for z in ("one.zip", "two.zip") for name, i, u in one)
    assert takeout.read(spark, str(tmp_path / "one.zip"), "ordinal").columns == ["ordinal"]
    visits = browsers.takeout(takeout.read(spark, str(tmp_path / "one.zip"), "ordinal", "value"))
    assert visits.where("url IS NOT NULL").count() == 12
