from pyspark.sql import functions as F

from dealweave.functions.hashing import content_hash, request_key, short_digest
from dealweave.functions.json import compact_json, json_contains
from dealweave.functions.text import (
    blank_to_null, company_part, first_name_token, holds, holds_any, labelled_lines, name_key, profile_slug,
    question_key, split_parts, squeeze, title_part)


def test_name_key_edges(values):
    rows = [("Foo.AI",), (" foo ai ",), ("Foo & Co",), ("Foo Pvt Ltd",), ("Foo Labs India",), ("India",), ("",), (None,),
            ("foo.ai\n",), ("foo.co.in",), ("Café",)]
    assert values(rows, "n string", name_key("n")) == [
        "foo", "fooai", "fooandco", "foo", "foolabs", None, None, None, "fooai", "fooco", "caf"]


def test_name_key_is_applied_once(spark):
    df = spark.createDataFrame([("Foo Labs India",)], "n string").select(name_key("n").alias("k"))
    assert df.select(name_key("k")).first()[0] == "foo"


def test_profile_slug(values):
    rows = [("https://www.LinkedIn.com/in/Jo-Do?trk=1",), ("linkedin.com/in/x/",), ("https://x.org/in/y",), (None,), ("",)]
    assert values(rows, "l string", profile_slug("l")) == ["jo-do", "x", None, None, None]


def test_title_and_company(values):
    rows = [("CTO - A - B",), ("A",), ("Vice-President",), ("x - ",), ("CEO - line\nbreak - Z",), (None,)]
    assert values(rows, "e string", title_part("e"), company_part("e")) == [
        ("CTO - A", "B"), (None, "A"), (None, "Vice-President"), (None, "x -"), ("CEO - line\nbreak", "Z"), (None, None)]


def test_split_parts(values):
    rows = [("a, b;c\nd",), (",,",), ("  ",), (None,), (" x ",)]
    assert values(rows, "t string", split_parts("t")) == [["a", "b", "c", "d"], [], [], [], ["x"]]


def test_question_key_and_first_name(values):
    assert values([("What  IS\nit ?! .",), (None,)], "q string", question_key("q")) == ["what is it", ""]
    rows = [("Dr. Ann Lee",), ("ms Bo",), ("Drake M",), ("Solo",)]
    assert values(rows, "n string", first_name_token("n")) == ["ann", "bo", "drake", "solo"]


def test_lines_skip_absent_values(values):
    line = labelled_lines(("A: ", F.col("a")), ("B: ", F.col("b")))
    assert values([("1", None), (None, "2"), (None, None)], "a string, b string", line) == ["A: 1", "B: 2", ""]


def test_blank_squeeze_and_array_tests(values):
    assert values([("  ",), (" a ",), ("\t",)], "a string", blank_to_null("a")) == [None, "a", "\t"]
    assert values([("a \n b" + "c" * 90,)], "a string", squeeze("a", 6)) == ["a bc"]
    rows = [(["x"],), ([],), (None,)]
    assert values(rows, "a array<string>", holds("a", "x")) == [True, False, False]
    assert values(rows, "a array<string>", holds_any("a", "x", "y")) == [True, False, False]


def test_json_contains(values):
    doc = '{"a":1,"b":["x","y"],"c":{"d":"e"},"t":true}'
    def check(wanted):
        return values([(doc,), (None,)], "j string", json_contains("j", wanted))
    assert check({"a": 1}) == [True, False]
    assert check({"b": ["y", "x"]})[0] and not check({"b": ["x", "z"]})[0]
    assert check({"c": {"d": "e"}})[0] and not check({"c": {"d": "f"}})[0]
    assert check({"t": True})[0] and not check({"missing": "q"})[0]
    assert check({}) == [True, False]
    assert check({"a": 1.0})[0] and not check({"a": "1"})[0] and not check({"a": True})[0]
    assert not check({"gone": None})[0] and not check({"b": {}})[0] and check({"c": {}})[0] and not check({"t": 1})[0]
    typed = '{"n":null,"l":[1,{"k":"v","w":2}],"s":"1"}'
    assert values([(typed,)], "j string", json_contains("j", {"n": None, "l": [{"k": "v"}, 1.0], "s": "1"})) == [True]
    assert values([(typed,), ("no json",)], "j string", json_contains("j", {"l": ["1"]})) == [False, False]


def test_compact_json_leaves_out_nulls(values):
    got = values([(None, "x")], "a string, b string", compact_json(a=F.col("a"), b=F.col("b")))
    assert got == ['{"b":"x"}']


def test_hashes(values):
    rows = [("t", "b"), (None, "b"), ("", "b"), ("t", None)]
    hashes = values(rows, "t string, b string", content_hash("t", "b"))
    assert hashes[1] == hashes[2] and len({*hashes}) == 3
    keys = values([("Why?",), ("why ",)], "q string", request_key("q", F.lit("v1")))
    assert keys[0] == keys[1]


def test_short_digest(values):
    assert values([("a", 1), (None, 2)], "c string, n int", F.hex(short_digest("c"))) == ["CA978112CA1BBDCAFAC231B39A23DC4D", None]
