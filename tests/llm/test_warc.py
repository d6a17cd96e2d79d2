import gzip
import hashlib
import random

from pyspark.sql import functions as F

from walkloom.llm.warc import PERMITTED, canonical_url, read_warc, resolve_revisits

KIND = "record_id long, url string, time long, status int, headers map<string,string>, payload_sha256 string, payload_chars long, verdict string"


def bare(tag):
    tag = tag.strip()
    return (tag[2:] if tag[:2].lower() == "w/" else tag).strip('"')


def brute(rows):
    out = []
    for r in rows:
        if r[3] != 304:
            continue
        full = [x for x in rows if x[3] == 200 and x[1] is not None and x[1] == r[1] and x[2] is not None and r[2] is not None and x[2] < r[2]]
        if not full:
            out.append((r[0], "no_earlier_response", None, None))
            continue
        f = max(full, key=lambda x: (x[2], x[0]))
        a, b = ({k.lower(): v for k, v in (x[4] or {}).items()} for x in (r, f))
        ok = bare(a["etag"]) == bare(b["etag"]) if "etag" in a and "etag" in b else a["last-modified"] == b["last-modified"] if "last-modified" in a and "last-modified" in b else True
        head = {**b, **{k: v for k, v in a.items() if k in PERMITTED}} if ok else None
        out.append((r[0], "resolved" if ok else "validators_differ", f[0] if ok else None, str(sorted(head.items())) if head is not None else None))
    return sorted(out, key=str)


def test_resolve(spark):
    rng, rows = random.Random(2), []
    for i in range(700):
        url = f"h/{0 if i % 3 else rng.randrange(40)}"  # one URL has two thirds of the rows
        tag = rng.choice(['"a"', 'W/"a"', '"b"', None])
        h = {k.title() if rng.random() < 0.5 else k: v for k, v in {"etag": tag, "last-modified": rng.choice(["x", "x", "y", None]), "content-type": f"t{i}", "date": str(i)}.items() if v}
        status = rng.choice([200, 304, 304, 404])
        rows.append((i, url, rng.randrange(300), status, h if i % 50 else None, f"p{i}" if status == 200 else None, i, "clash"))
    rows += [(900, None, 5, 304, {}, None, None, ""), (901, "h/1", None, 304, {}, None, None, ""), (902, "h/1", None, 200, {}, "p", 1, ""), (903, None, 1, 200, {}, "p", 1, "")]
    got = resolve_revisits(spark.createDataFrame(rows, KIND).repartition(6)).collect()
    ours = sorted([(r.record_id, r.verdict, r.response_id, str(sorted(r.headers.items())) if r.headers is not None else None) for r in got], key=str)
    assert ours == brute(rows)
    assert resolve_revisits(spark.createDataFrame([], KIND)).count() == 0


def test_canonical_url(spark):
    urls = {
        "HTTP://WWW.Example.com:80/a/?utm_source=x&b=2&a=1#top": "example.com/a?a=1&b=2", "https://example.com": "example.com", "http://u:p@m.example.org/x.html?ref=1&gclid=2": "m.example.org/x.html?ref=1",
        "example.com./": "example.com", None: None, "": "",
    }
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", canonical_url(F.col("u")).alias("c")).collect()
    assert {r.u: r.c for r in rows} == urls


def record(kind, ident, url, date, http, length=None):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{ident}>\r\nWARC-Target-URI: {url}\r\nWARC-Date: {date}\r\ncontent-length: {len(http) if length is None else length}\r\n\r\n"
    return head.encode() + http + b"\r\n\r\n"


def test_read_warc(spark, tmp_path):
    body = "né\r\n\r\nmore".encode() + bytes([0xFF, 0xFE, 0])
    day = "2024-01-0{}T00:00:00Z".format
    records = [
        record("warcinfo", "i", "x", day(1), b"software: x"),
        record("response", "a", "http://www.h.org/p/", day(1), b"HTTP/1.1 200 OK\r\nETag: \"v1\"\r\nContent-Type: text/html\r\n\r\n" + body),
        record("response", "b", "http://h.org/p", day(2), b"HTTP/1.1 404 Not Found\r\n\r\nno"),
        record("revisit", "c", "https://h.org/p", day(3), b"HTTP/1.1 304 Not Modified\r\nETAG: W/\"v1\"\r\nDate: today\r\n\r\n"),
        record("revisit", "d", "http://h.org/q", day(3), b"HTTP/1.1 304 Not Modified\r\n\r\n"),
        record("response", "e", "http://h.org/p", day(2), b"HTTP/1.1 200 OK\r\n\r\ncut", 900),
    ]
    (tmp_path / "plain.warc").write_bytes(b"".join(records))
    (tmp_path / "packed.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    for name in ("plain.warc", "packed.warc.gz"):
        captures = read_warc(spark, str(tmp_path / name))
        full = captures.filter("status = 200").collect()
        assert captures.count() == 4 and len(full) == 1 and full[0].payload_sha256 == hashlib.sha256(body).hexdigest() and full[0].payload_chars == len(body)
        got = {r.url: r for r in resolve_revisits(captures).collect()}
        assert got["http://h.org/q"].verdict == "no_earlier_response" and got["https://h.org/p"].verdict == "resolved"
        assert got["https://h.org/p"].headers == {"etag": 'W/"v1"', "content-type": "text/html", "date": "today"} and got["https://h.org/p"].payload_sha256 == full[0].payload_sha256
