from __future__ import annotations

import glob
import gzip
import hashlib
import re

import pytest

from dealweave.llm import url_filter, warc
from dealweave.llm.common import shared_folder
from dealweave.llm.queries import RULES

URLS = [
    None, "", "no scheme", "http://", "https://WWW.Example.NET/en/1?x#y", "http://example.net/de/1", "http://badexample.net/en/2",
    "http://a.b.example.com/de/", "http://example.com/DE/7", "http://x.org/fr/é?q=/a", "http://x.org/fr", "http://org/fr/1",
    "ftp://net", "http://net/", "http://h.example.com/a.html", "https://m.h.example.com/a/", "http://h.example.com/a?u=1",
    "http://h.example.com/b", "x://y://z/w", "http://É.org/a", "http://q.example.com#f/en/", "a://b?c://d",
]


def brute_parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def brute_rule(host, path):
    fitting = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fitting, key=lambda r: len(r.name), default=None)


def test_rules_and_list(spark):
    listed = spark.createDataFrame([("h.example.com/a",), ("h.example.com/a",), (None,), ("",), ("other/x",)], "key string")
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(URLS)] * 2, "page_id int, url string, host string")
    rows = url_filter.judge(pages, RULES, listed).collect()
    assert len(rows) == 2 * len(URLS)
    for r in rows:
        host, path = brute_parts(URLS[r.page_id])
        rule = brute_rule(host, path)
        bare = re.sub(r"^(www|m|blog)\.", "", host) + re.sub(r"(\.html)?/*$", "", path) if host else ""
        verdict = rule.verdict if rule else "block" if bare == "h.example.com/a" else "allow"
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule.name if rule else None, verdict), r
    assert url_filter.judge(pages, RULES, listed.limit(0)).where("verdict = 'block' and rule is null").count() == 0
    assert url_filter.judge(pages.limit(0), RULES, listed).count() == 0


@pytest.mark.parametrize("limit", [0, 1 << 25])
def test_filter_never_misses_and_join_is_exact(spark, monkeypatch, limit):
    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", limit)
    keys = spark.range(3000).selectExpr("concat('host/', id * 7) as key")
    urls = spark.range(20000).selectExpr("id", "concat('host/', id) as key", "id as w0x", "'n' as listed_")
    got = {r.id for r in url_filter.in_list(urls, keys).where("listed").collect()}
    assert got == set(range(0, 20000, 7))
    bloom = url_filter.bloom_table(keys, 188)
    assert bloom.count() <= 188 and len(bloom.columns) == 9


def test_plan_has_no_python(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x")], "page_id int, url string")
    listed = spark.createDataFrame([("a.org/x",)], "key string")
    plan = url_filter.judge(pages, RULES, listed)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def pages_with_copies(spark):
    long, other = "<p>é" + "x" * 200 + "\r\n\r\nWARC/1.1\r\n", "y" * 99 + "é"
    rows = [(5, "u5", long), (2, "u2", long), (9, "a\r\nb", long), (3, None, "short"), (1, "u1", "short"), (7, "u7", None),
            (8, "u8", ""), (4, "u4", other), (6, "u6", other), (2, "u2", long), (None, "n", long), (None, "n", "z" * 150),
            (None, "n2", "z" * 150)]
    return rows, spark.createDataFrame(rows, "page_id bigint, url string, html string")


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_archives_round_trip(spark, compression):
    rows, pages = pages_with_copies(spark)
    folder = shared_folder(spark)
    warc.write_archives(pages, folder, compression=compression)
    got = sorted(map(str, warc.read_resolved(spark, folder).drop("url").collect()))
    want = []
    for page_id, _, html in rows:
        body = (html or "").encode()
        first = min((p for p, _, h in rows if (h or "") == (html or "") and p is not None), default=None)
        again = len(body) >= 100 and first is not None and page_id != first
        want.append(f"Row(page_id={page_id}, record_type={'revisit' if again else 'response'!r}, payload_bytes={len(body)}, "
                    f"payload_digest={hashlib.sha256(body).hexdigest()!r}, refers_to={first if again else None})")
    assert got == sorted(want)
    held = warc.read_archives(spark, folder).where("record_type = 'response'").select("payload").collect()
    assert sorted(r.payload for r in held) == sorted(h or "" for p, _, h in rows if not (
        len((h or "").encode()) >= 100 and (m := min((q for q, _, g in rows if g == h and q is not None), default=None)) and p != m))
    files = glob.glob(folder.removeprefix("file://").removeprefix("file:") + "/part-*")
    assert sum((gzip.open if compression == "gzip" else open)(f, "rb").read().count(b"WARC-Type: ") for f in files) == len(rows)
    ids = [r.record_id for r in warc.read_archives(spark, folder).where("page_id <> 2").collect()]
    assert len(ids) == len(set(ids))


def test_empty_archive(spark):
    _, pages = pages_with_copies(spark)
    folder = shared_folder(spark)
    warc.write_archives(pages.limit(0), folder)
    assert warc.read_resolved(spark, folder).count() == 0
