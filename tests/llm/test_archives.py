import hashlib

import pytest

from panelforge.llm import archives as a


def test_both_versions_round_trip():
    for version in (1, 2):
        first = f"{version} 0 pages\n{a.FIELDS[version]}\n".encode()
        middle = "" if version == 1 else " 200 - - 0 n"
        head = f"filedesc://n 0.0.0.0 20000101000000 text/plain{middle} {len(first)}\n".encode() + first + b"\n"
        body = b"<p>\r\n\r\nWARC/1.1\n\xc3\xa9</p>"
        content = head + a.legacy_record(version, -7, "http://x/ y\n", body, 0, "n") + a.legacy_record(version, None, "", b"", 0, "n")
        (f, one), (g, two) = a.legacy_records(content)
        assert f["URL"] == "http://x/%20y%0A" and one.endswith(b"\r\n\r\n" + body) and b"X-Page-Id: -7" in one and g["URL"] == "-"
        with pytest.raises(ValueError):
            list(a.legacy_records(content[:-3]))
    with pytest.raises(ValueError):
        list(a.legacy_records(b"filedesc://n 0 0 text/plain 8\n9 0 page\n"))


def test_equal_pages_are_revisits(spark, prose):
    long = "<p>" + prose(1, 400) + "é</p>\r\n\r\nWARC/1.1"
    rows = [(1, "u v", long, "x"), (5, "u", long, "x"), (3, None, long, "x"), (2, "u", "short", "x"), (4, "u", "short", "x"), (6, "u", None, "x"),
            (7, "u", "", None), (5, "u", long, "x"), (None, "u", long, "x"), (8, "u", prose(2, 90000), "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, refers_to string")
    got = a.archived(df).collect()
    assert len(got) == len(rows)
    want = []
    for page, _, html, _ in rows:
        raw = (html or "").encode()
        old = html == long and page not in (5, None)
        want.append((str(page), len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if old else "response", 5 if old else None))
    assert sorted((str(r.page_id), *r[1:5]) for r in got) == sorted(want)
    assert {r.uri for r in got} >= {"u%20v", "-"} and all(len(r.date) == 20 for r in got)
    assert a.archived(df.limit(0)).collect() == []
