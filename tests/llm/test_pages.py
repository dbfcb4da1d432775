import fnmatch
import io
import re
import zipfile

import pytest

from wordloom.llm import wildcard, zipwarc


class Bytes(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def package(rows, comment=b""):
    out = Bytes()
    with zipfile.ZipFile(out, "w") as z:
        z.comment = comment
        lines, data = [], b""
        import gzip
        import json

        for r in rows:
            x = gzip.compress(zipwarc.record(*r))
            lines.append(json.dumps({"offset": len(data), "length": len(x)}))
            data += x
        z.writestr("archive/data.warc.gz", data)
        z.writestr("indexes/index.cdxj", "\n".join(lines))
        z.writestr("notes.txt", "n", zipfile.ZIP_DEFLATED)
    return out


ROWS = [(1, "http://a/\r\nb", b"<p>1</p>", None), (2, None, b"", None), (None, "u", b"\r\n\r\nx", None), (3, "http://c", b"<p>1</p>", 1)]


@pytest.mark.parametrize("comment", [b"", b"PK\x05\x06 in a comment"])
def test_records_come_back(comment):
    got = list(zipwarc.Package(package(ROWS, comment)).records())
    assert [(r["page_id"], r["payload"], r["payload_bytes"], r["refers_to"]) for r in got] == [(1, b"<p>1</p>", 8, None), (2, b"", 0, None), (None, b"\r\n\r\nx", 5, None), (3, None, 8, 1)]
    assert got[0]["payload_digest"] == got[3]["payload_digest"] == zipwarc.digest(b"<p>1</p>")


def test_zip64_directories(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    data = package(ROWS)
    assert b"PK\x06\x06" in data.getvalue() and len(list(zipwarc.Package(data).records())) == 4


def test_compressed_members_and_damage_are_refused():
    out = Bytes()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/data.warc.gz", b"a" * 1000)
    with pytest.raises(ValueError, match="stored"):
        zipwarc.Package(out)
    with pytest.raises(ValueError, match="no end record"):
        zipwarc.Package(Bytes(b"nothing"))
    with pytest.raises(ValueError, match="digest"):
        zipwarc.parse_record(zipwarc.record(1, None, b"abc", None).replace(b"abc", b"abd"))


PAGES = "page_id long, url string, html string, payload string, key int"


def test_responses_revisits_and_odd_pages(spark, monkeypatch):
    rows = [(1, "http://a", "same", "p", 1), (9, None, "same", "p", 1), (9, None, "same", "p", 1), (None, "u", "same", "p", 1), (3, "http://b", None, "p", 1), (4, "x", "", "p", 1), (None, None, "alone", "p", 1), (5, "long", "é" * 200_000, "p", 1)]
    pages = spark.createDataFrame(rows, PAGES)
    monkeypatch.setattr(zipwarc, "PACKAGE_BYTES", 1)  # a package for each record
    got = zipwarc.read_packages(zipwarc.write_packages(pages)).collect()
    assert sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got), key=str) == sorted(
        [(1, "revisit", 9, 4), (9, "response", None, 4), (9, "response", None, 4), (None, "revisit", 9, 4), (3, "revisit", 4, 0), (4, "response", None, 0), (None, "response", None, 5), (5, "response", None, 400_000)], key=str
    )
    small = zipwarc.read_packages(zipwarc.write_packages(pages, min_bytes=5)).collect()
    assert all(r.record_type == "response" for r in small)
    assert zipwarc.read_packages(zipwarc.write_packages(pages.limit(0))).count() == 0


def test_automaton_equals_regular_expressions():
    globs = ["^.net/*", "*.exe", "a*b*c", "*", "", "^.example.org/x*y", "*?page=*", "é*", *(f"*{k}{k}/*" for k in range(40))]
    urls = [".a.net/x", ".net/", ".net?/", ".a.net", ".x/a.net/", "setup.exe", "abc", "axbxc", "", "é", ".b.example.org/x1y", "/?page=2", "/7/77/", "x" * 3000 + "3939/", ".q#.net/"]
    turn = lambda g: re.compile("".join(".*" if c == "*" else "[^/?#]*" if c == "^" else re.escape(c) for c in g), re.S)
    got = wildcard.Automaton(globs).matches([u.encode() for u in urls])
    assert got.tolist() == [[turn(g).fullmatch(u) is not None for g in globs] for u in urls]
    assert wildcard.Automaton(globs).matches([]).shape == (0, len(globs))
    assert fnmatch.fnmatchcase("setup.exe", "*.exe")


def test_pages_are_judged(spark):
    urls = [None, "", "no scheme", "HTTP://A.Example.NET/en/x?page=2", "http://example.net/de/", "http://net", "http://org/fr/", "http://x.org/fr?/", "https://b.example.com/de/a#f", "ftp://x.com/a.exe", "http://ÄB.com/ads/", "http://x.com/" + "a" * 50_000]
    rows = spark.createDataFrame([(k if k else None, u, "h", "r") for k, u in enumerate(urls)] + [(3, urls[3], "h", "r")], "page_id long, url string, host string, rule string")
    got = wildcard.judge(rows).collect()
    assert len(got) == len(urls) + 1
    by = {r.page_id: r for r in got}
    assert (by[3].host, by[3].path, by[3].rule, by[3].verdict) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert (by[4].rule, by[4].verdict) == ("net/", "block")
    assert (by[5].host, by[5].path, by[5].rule, by[5].verdict) == ("net", "", None, "allow")
    assert by[6].rule == "org/fr/" and by[7].rule is None and by[8].rule == "example.com/de/"
    assert (by[9].rule, by[9].verdict, by[9].pattern) == (None, "block", "program")
    assert by[10].host == "Äb.com" and by[10].pattern == "advert"
    assert all((by[k].host, by[k].path, by[k].verdict) == ("", "", "allow") for k in (None, 1, 2))
    assert wildcard.judge(rows.limit(0)).count() == 0
