import json

from pyspark.sql import functions as F

from dealweave.sources.pages import SourceColumn, convert, extract_properties, load_source, read_pages

PROPS = {
    "title": {"type": "title", "title": [{"plain_text": "A"}, {"plain_text": "B"}]},
    "rich": {"type": "rich_text", "rich_text": []},
    "select": {"type": "select", "select": {"name": "S"}},
    "noselect": {"type": "select", "select": None},
    "status": {"type": "status", "status": {"name": "T"}},
    "multi": {"type": "multi_select", "multi_select": [{"name": "x"}, {"name": "y"}]},
    "date": {"type": "date", "date": {"start": "2024-01-02"}},
    "check": {"type": "checkbox", "checkbox": None},
    "number": {"type": "number", "number": 45},
    "fraction": {"type": "number", "number": 4.5},
    "url": {"type": "url", "url": "u"},
    "email": {"type": "email", "email": "e"},
    "phone": {"type": "phone_number", "phone_number": "p"},
    "people": {"type": "people", "people": [{"id": "1"}]},
    "relation": {"type": "relation", "relation": [{"id": "a-b"}]},
    "created": {"type": "created_time", "created_time": "2024-01-01T00:00:00Z"},
    "edited": {"type": "last_edited_time", "last_edited_time": "2024-01-03T00:00:00Z"},
    "creator": {"type": "created_by", "created_by": {"id": "7"}},
    "editor": {"type": "last_edited_by", "last_edited_by": None},
    "files": {"type": "files", "files": [{"name": "f"}]},
    "code": {"type": "unique_id", "unique_id": {"number": 3, "prefix": "D"}},
    "bare": {"type": "unique_id", "unique_id": {"number": 4}},
    "nocode": {"type": "unique_id", "unique_id": {"prefix": "D"}},
    "fdate": {"type": "formula", "formula": {"type": "date", "date": {"start": "2024-05-05"}}},
    "fnum": {"type": "formula", "formula": {"type": "number", "number": 2}},
    "fbool": {"type": "formula", "formula": {"type": "boolean", "boolean": True}},
    "ftext": {"type": "formula", "formula": {"type": "string", "string": "z"}},
    "roll": {"type": "rollup", "rollup": {"type": "array", "array": [
        {"type": "select", "select": {"name": "r"}}, {"type": "rich_text", "rich_text": []},
        {"type": "multi_select", "multi_select": [{"name": "s"}, {"name": ""}]}]}},
    "rdate": {"type": "rollup", "rollup": {"type": "date", "date": {"start": "2024-06-06"}}},
    "rnum": {"type": "rollup", "rollup": {"type": "number", "number": 8}},
    "other": {"type": "button"},
}
WANT = {
    "title": ["AB"], "rich": None, "select": ["S"], "noselect": None, "status": ["T"], "multi": ["x", "y"], "date": ["2024-01-02"],
    "check": ["false"], "number": ["45"], "fraction": ["4.5"], "url": ["u"], "email": ["e"], "phone": ["p"], "people": ["user://1"],
    "relation": ["https://pages.example/ab"], "created": ["2024-01-01T00:00:00Z"], "edited": ["2024-01-03T00:00:00Z"],
    "creator": ["user-7"], "editor": None, "files": ["f"], "code": ["D-3"], "bare": ["4"], "nocode": None, "fdate": ["2024-05-05"],
    "fnum": ["2"], "fbool": ["true"], "ftext": ["z"], "roll": ["r", "s"], "rdate": ["2024-06-06"], "rnum": ["8"], "other": None,
}


def page_file(tmp_path, *pages):
    path = tmp_path / "pages.json"
    path.write_text("\n".join(json.dumps(p) for p in pages))
    return str(path)


def page(page_id, props, **extra):
    return {"object": "page", "id": page_id, "in_trash": False, "archived": False, "properties": props, **extra}


def test_every_property_type(spark, tmp_path):
    pages = read_pages(spark, page_file(tmp_path, page("p-1", PROPS)))
    columns = [SourceColumn(name, name, "arr") for name in PROPS]
    got = extract_properties(pages, columns).first().asDict()
    assert {k: v for k, v in got.items() if k != "id"} == WANT


def test_load_source_keeps_live_pages_and_types(spark, tmp_path):
    props = {"N": PROPS["title"], "Q'uote": PROPS["number"], "D": PROPS["created"], "L": PROPS["multi"], "B": PROPS["check"]}
    pages = read_pages(spark, page_file(
        tmp_path, page("a-1", props), page("a-2", props, in_trash=True), page("a-3", props, archived=True),
        page("a-4", props, object="database"), page("a-5", {})))
    columns = [SourceColumn("N", "name", "text"), SourceColumn("Q'uote", "n", "num"), SourceColumn("D", "d", "date"),
               SourceColumn("L", "l", "arr"), SourceColumn("B", "b", "bool"), SourceColumn("none", "none", "text")]
    rows = {r.id: r for r in load_source(pages, columns, F.lit("2024-01-01").cast("timestamp")).collect()}
    assert set(rows) == {"a-1", "a-5"}
    a = rows["a-1"]
    assert (a.url, a.name, a.n, str(a.d), a.l, a.b, a.none) == (
        "https://pages.example/a1", "AB", 45.0, "2024-01-01", ["x", "y"], False, None)
    assert rows["a-5"].name is None and rows["a-5"].l is None


def test_convert_kinds(values):
    def run(kind, *texts):
        return values([(t,) for t in texts], "t string", convert("t", kind))

    assert run("arr", '["a","","b"]', "plain", "", None, "[broken") == [["a", "", "b"], ["plain"], None, None, ["[broken"]]
    assert run("arrsplit", "a ; b;;", '["c;d"]', None) == [["a", "b"], ["c", "d"], None]
    assert run("bool", "__YES__", "true", "1", "True", "no", "") == [True, True, False, False, False, None]
    assert values([("1",)], "t string", convert("t", "bool", F.lit(True))) == [True]
    assert run("num", "4.5", "x", "NaN", "Infinity", "") == [4.5, None, None, None, None]
    assert [str(v) for v in run("date", "2024-01-02T03:04:05Z", "bad", None)] == ["2024-01-02", "None", "None"]
    assert run("text", '["a"]', "x", "") == ['["a"]', "x", None]
