import base64
import gzip
import hashlib
import io

from pyarrow import fs

from isochord.llm import warc
from isochord.session import scratch_path

PAGES = [(5, "http://www.example.com/a?b=c", "same"), (3, "http://example.com/a", "same"),
         (9, "https://Example.COM:8080/x", "same"), (1, None, None), (2, "", ""),
         (7, "no url\r\nat all 100%0A", "é" * 1000), (None, "http://b.org/", "same"),
         (None, "http://b.org/", "lonely"), (3, "http://example.com/a", "same"),
         (11, "http://[bad/", "x"), (12, "http://b.org/", "HTTP/1.1\r\n\r\nbody\r\n\r\n"),
         (13, "http://long.org/" + "p" * 3000, "z" * 300_000)]


def want(pages):
    rows = []
    for id_, _, html in pages:
        data = (html or "").encode()
        ids = [i for i, _, h in pages if (h or "") == (html or "") and i is not None]
        first = min(ids) if ids else None
        revisit = first is not None and id_ != first
        rows.append((id_, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                     "revisit" if revisit else "response", first if revisit else None))
    return sorted(rows, key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr(
        "*", "'c' AS `first`", "1 AS `key`", "NULL AS file")


def test_round_trip(spark):
    got = warc.archive_round_trip(frame(spark, PAGES), spark).selectExpr(
        "id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == want(PAGES)
    assert warc.archive_round_trip(frame(spark, []), spark).count() == 0


def test_files_hold_the_records_and_urls(spark):
    folder = scratch_path(spark, "warc-test")
    captures = warc.write_archives(frame(spark, PAGES).repartition(3), folder, file_bytes=400)
    store, path = fs.FileSystem.from_uri(folder)
    names = {r.file for r in captures.select("file").distinct().collect()}
    assert len(names) > 3
    text = b"".join(gzip.GzipFile(fileobj=io.BytesIO(store.open_input_file(
        f"{path}/{n}").readall())).read() for n in names)
    assert text.count(b"WARC/1.1\r\n") == len(PAGES)
    back = warc.fetch(captures, folder).collect()
    assert sorted(map(str, [r.url for r in back])) == sorted(str(u) for _, u, _ in PAGES)
    payloads = {r.id: bytes(r.payload) for r in back if r.record_type == "response" and r.id}
    assert payloads[12] == PAGES[10][2].encode() and payloads[13] == b"z" * 300_000


def test_lookup_reads_only_what_is_asked(spark):
    rows = [(i, f"http://h{i % 7}.com/p{i % 500}", f"body {i}") for i in range(3000)]
    rows += [(5000 + i, "http://hot.com/", f"hot {i}") for i in range(1500)]
    folder = scratch_path(spark, "warc-test")
    captures = warc.write_archives(frame(spark, rows), folder)
    directory = warc.build_index(captures, folder, lines_per_block=50)
    assert directory.count() >= 90
    asked = ["com,h3)/p3", "com,hot)/", "com,none)/", "", "com,h3)/p3"]
    keys = spark.createDataFrame([(k,) for k in asked] + [(None,)], "key string")
    found = warc.lookup(keys, directory, folder).collect()
    expected = sorted(i for i, u, _ in rows if warc.url_key(u) in asked)
    assert sorted(r.id for r in found) == expected and len(expected) > 1500


def test_url_keys():
    assert warc.url_key("http://www.example.com/a?b") == "com,example,www)/a?b"
    assert warc.url_key("https://u@Example.com:443") == "com,example)/"
    assert warc.url_key("http://example.com:81/") == "com,example:81)/"
    assert warc.url_key(None) == "" and warc.url_key("x") == ")x"
