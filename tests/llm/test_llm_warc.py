import pytest
from pyspark.sql import functions as F

import llm_cases as C
from ragtab.llm import warc as X

PAGES = "page_id long, url string, html string"


def rows():
    long = "<html>" + "x" * 200 + "</html>"
    return [(1, "http://a/é b\r\nX: y", long), (2, None, long), (3, "http://c", None), (4, "http://d", ""), (5, "u", "short"), (6, "u", "short"),
            (7, "u", "ß" * 50), (8, "u", "ß" * 50), (None, "u", long), (9, "u", "WARC/1.1\r\n\r\n" * 30), (9, "u", "WARC/1.1\r\n\r\n" * 30),
            (10, "u", "z" * 3_000_000), (11, "u", "y" * 99), (12, "u", "y" * 99)]


def test_oracle_on_odd_pages(spark):
    import pandas as pd

    data = rows()
    con = C.duck(pages=pd.DataFrame(data, columns=["page_id", "url", "html"]).astype({"page_id": "Int64", "url": object, "html": object}))
    C.same_rows(X.warc_roundtrip(spark.createDataFrame(data, PAGES).withColumn("n", F.lit(1)).withColumn("payload", F.lit("x"))), con.execute(X.ORACLE))


def test_empty_table(spark):
    assert X.warc_roundtrip(spark.createDataFrame([], PAGES)).count() == 0


def test_payloads_come_back_from_files(spark, tmp_path):
    data = [(i, f"http://h/{i}", f"<p>{'text ' * (i % 40)}{i}</p>") for i in range(300)]
    archives = X.write_warc(spark.createDataFrame(data, PAGES).repartition(2), archive_bytes=4000)
    assert archives.count() > 4
    assert X.export_files(archives, f"file://{tmp_path}").count() == archives.count()
    files = spark.read.format("binaryFile").load(f"file://{tmp_path}/*.zst").select("path", "content")
    got = {r["target_uri"]: bytes(r["payload"]).decode() for r in X.read_warc(files, "path").collect()}
    assert got == {u: h for _, u, h in data}


def test_broken_archives(spark):
    whole = X.write_warc(spark.createDataFrame(rows(), PAGES).coalesce(1)).first()["content"]
    good = list(X.frames(bytes(whole)))
    assert len(good) == len(rows())
    broken = {"cut": whole[:-3], "no frame": whole[:8 + int.from_bytes(whole[4:8], "little")] + b"xxxx", "none": b""}
    df = spark.createDataFrame(list(broken.items()), "name string, content binary")
    errors = {r["archive"] for r in X.read_warc(df, strict=False).filter("error is not null").collect()}
    assert errors == {"cut", "no frame"}
    with pytest.raises(Exception, match="no frame at byte"):
        X.read_warc(df.filter("name = 'no frame'")).collect()


@pytest.mark.parametrize("change", [lambda r: r.replace(b"WARC/1.1", b"HTTP/1.1", 1), lambda r: r + b"x",
                                    lambda r: r.replace(b"hello", b"hullo"), lambda r: r.replace(b"WARC-Date", b"Date", 1)])
def test_records_are_checked(change):
    rec = X.record("urn:page:1", "http://a", b"hello", __import__("hashlib").sha256(b"hello").hexdigest(), None, "2000-01-01T00:00:00Z")
    assert X.parse(rec)["payload"] == b"hello"
    with pytest.raises(ValueError):
        X.parse(change(rec))


def made(fields, block):
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n"
RESPONSE = {"WARC-Type": "response", "WARC-Record-ID": "<urn:uuid:1>", "WARC-Date": "2024-02-29T01:02:03Z", "WARC-Target-URI": "http://a/",
            "Content-Type": "application/http; msgtype=response"}


def test_digests_of_ordinary_archives():
    import base64
    import hashlib

    block = HTTP + b"\r\nhello"
    sha1 = base64.b32encode(hashlib.sha1(b"hello").digest()).decode()
    for value in ("sha1:" + sha1, "sha1:" + sha1.lower(), "SHA-256:" + hashlib.sha256(b"hello").hexdigest().upper(), "md5:" + hashlib.md5(b"hello").hexdigest(),
                  "sha256:" + base64.b32encode(hashlib.sha256(b"hello").digest()).decode(), "unheard:of"):
        whole = "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
        got = X.parse(made(RESPONSE | {"WARC-Payload-Digest": value, "WARC-Block-Digest": whole}, block))
        assert got["payload"] == b"hello" and got["payload_digest"] == hashlib.sha256(b"hello").hexdigest()
    for field, value in (("WARC-Payload-Digest", "sha1:" + sha1[::-1]), ("WARC-Block-Digest", "sha1:" + sha1), ("WARC-Payload-Digest", "sha1")):
        with pytest.raises(ValueError, match="digest"):
            X.parse(made(RESPONSE | {field: value}, block))


@pytest.mark.parametrize("date, good", [("2024", True), ("2024-02", True), ("2024-02-29", True), ("2024-02-29T23:59Z", True), ("2016-12-31T23:59:60Z", True),
                                        ("2024-02-29T01:02:03.123456789Z", True), ("yesterday", False), ("2023-02-29", False), ("2024-02-29T01:02:03", False),
                                        ("2024-13", False), ("2024-02-29T24:00:00Z", False), ("", False)])
def test_dates_are_checked(date, good):
    rec = made(RESPONSE | {"WARC-Date": date}, HTTP + b"\r\n")
    if good:
        assert X.parse(rec)["warc_date"] == date
    else:
        with pytest.raises(ValueError):
            X.parse(rec)


def test_coded_truncated_and_folded():
    assert X.parse(made(RESPONSE, HTTP + b"Transfer-Encoding: chunked\r\nContent-Length: 99\r\n\r\n5\r\nhello\r\n0\r\n\r\n"))["payload_bytes"] == 15
    cut = HTTP + b"Content-Length: 99\r\n\r\nhello"
    assert X.parse(made(RESPONSE | {"WARC-Truncated": "length", "WARC-Payload-Digest": "sha1:XYZ"}, cut))["payload"] == b"hello"
    with pytest.raises(ValueError, match="HTTP Content-Length"):
        X.parse(made(RESPONSE, cut))
    assert X.parse(made(RESPONSE | {"WARC-Target-URI": "http://a/\r\n  x"}, HTTP + b"\r\n"))["target_uri"] == "http://a/ x"


def test_revisits_by_uri_and_date(spark):
    import zstandard

    revisit = {"WARC-Type": "revisit", "WARC-Date": "2024-03-01", "WARC-Target-URI": "http://a/", "WARC-Profile": X.REVISIT,
               "WARC-Payload-Digest": "sha1:ABCDEF", "Content-Type": "application/http; msgtype=response"}
    by = lambda uri, date: {"WARC-Refers-To-Target-URI": uri, "WARC-Refers-To-Date": date}
    day = RESPONSE["WARC-Date"]
    recs = [made(RESPONSE, HTTP + b"\r\nhello"), made(RESPONSE | {"WARC-Record-ID": "<urn:uuid:0>"}, HTTP + b"\r\nhello"),
            made(revisit | {"WARC-Record-ID": "<urn:uuid:2>"} | by("http://a/", day), HTTP + b"\r\n"),
            made(revisit | {"WARC-Record-ID": "<urn:uuid:3>"} | by("http://b/", day), b""),
            made(revisit | {"WARC-Record-ID": "<urn:uuid:4>", "WARC-Refers-To": "<urn:uuid:1>"} | by("http://a/", day), HTTP + b"\r\n")]
    content = b"".join(zstandard.ZstdCompressor().compress(r) for r in recs)
    read = X.read_warc(spark.createDataFrame([("a", content)], "name string, content binary"))
    out = X.with_targets(read)
    assert out.columns == read.columns
    assert {r["record_id"][-1]: r["refers_to"] and r["refers_to"][-1] for r in out.collect()} == {"0": None, "1": None, "2": "0", "3": None, "4": "1"}
    assert {r["payload_digest"] for r in out.filter("record_type = 'revisit'").collect()} == {"sha1:ABCDEF"}
    for fields in (revisit, revisit | by("http://a/", "soon"), revisit | {"WARC-Refers-To-Date": day}):
        with pytest.raises(ValueError):
            X.parse(made(fields | {"WARC-Record-ID": "<urn:uuid:5>"}, b""))
