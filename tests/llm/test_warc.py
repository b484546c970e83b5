import base64
import hashlib

import zstandard

from stratafold.llm import warc


def brute(rows, least=0):
    first, out = {}, []
    for p, _, h in rows:
        h = h or ""
        if len(h.encode()) >= least:
            first[h] = min((first.get(h, p), p), key=lambda x: (x is None, x))
    for p, _, h in rows:
        b = (h or "").encode()
        same = len(b) >= least and first[h or ""] != p
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if same else "response", first[h or ""] if same else None))
    return sorted(out, key=str)


ROWS = [(5, "http://a", "<p>x</p>"), (3, "http://b\r\nX: y", "<p>x</p>"), (9, None, None), (8, "u", ""), (7, "u", "é" * 100_000), (7, "u", "é" * 100_000), (1, "u", "<p>x</p>\r\n\r\nWARC/1.1"), (None, "u", "<p>x</p>"), (12, "u", "y" * 700_000)]


def test_round_trip(spark):
    pages = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], "page_id long, url string, html string, digest string, size int")
    for least in (0, 5, 100):
        assert sorted(map(tuple, warc.read(warc.write(pages, least, 300, 2000)).collect()), key=str) == brute(ROWS, least)
    assert warc.read(warc.write(pages.limit(0))).count() == 0


def test_table(spark, tables):
    rows = [tuple(r) for r in tables["pages"].select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, warc.read(warc.write(tables["pages"])).collect()), key=str) == brute(rows)


def test_seek_and_files(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"u{i}", f"<b>{i}</b>" * 50) for i in range(200)], "page_id long, url string, html string").coalesce(1)
    bundles = warc.write(pages, frame_bytes=2000, bundle_bytes=20_000)
    rows = bundles.collect()
    assert len(rows) > 1 and sum(r["records"] for r in rows) == 200
    for r in rows:
        bundle = warc.Bundle(bytes(r["content"]))
        whole = zstandard.ZstdDecompressor().stream_reader(bytes(r["content"]), read_across_frames=True).read()
        assert whole == b"".join(bundle.frame(k) for k in range(len(bundle.frames) - 1))
        for name, k, at, size in bundle.index():
            record = bundle.record(name)
            assert record == bundle.frame(k)[at : at + size] and f"<{name}>".encode() in record
            (headers, _, payload), = warc.records(record)
            assert payload.decode().startswith(f"<b>{name.split(':')[2]}</b>")
    paths = warc.export(bundles, str(tmp_path / "out"))
    assert len(paths) == len(rows) and all(warc.Bundle(open(p, "rb").read()).index() for p in paths)
