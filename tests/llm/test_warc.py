"""WARC: write, index, ranged reads, revisits."""

import zlib

from pyspark.sql import functions as F

from ledgerline.llm import warc


def pages(spark):
    data = [(k, f"http://x.org/{k}", f"<p>{k % 7}</p>", "s") for k in range(60)]
    data += [(100, None, None, "s"), (101, "", "", "s"), (102, "http://x/ a\r\nb%20é", "WARC/1.1\r\n\r\nnested\r\n\r\n", "s"), (None, "u", "<p>1</p>", "s"),
             (103, "u", "é" * 50_000, "s"), (3, "again", "<p>3</p>", "s"), (3, "again", "<p>3</p>", "s")]
    return spark.createDataFrame(data, "page_id long, url string, html string, sha string").repartition(4), data


def test_round_trip(spark):
    df, data = pages(spark)
    for min_bytes, archive_bytes in ((0, 1 << 20), (9, 300)):
        index = warc.write_archives(df, min_bytes=min_bytes, archive_bytes=archive_bytes)
        assert index.count() == len(data)
        got = sorted(((r["page_id"], r["url"], r["record_type"], r["refers_to"], r["payload_digest"], r["payload_bytes"], bytes(r["payload"]))
                      for r in warc.read_records(index, range_bytes=2000, gap_bytes=100).collect()), key=str)
        first = {}
        for i, _, html, _ in data:
            if i is not None:
                first[html or ""] = min(first.get(html or "", i), i)
        want = []
        for i, url, html, _ in data:
            body = (html or "").encode()
            to = first[html or ""] if len(body) >= min_bytes and i is not None and first[html or ""] != i else None
            want.append((i, url, "response" if to is None else "revisit", to, warc.base32_digest(body), len(body), body if to is None else b""))
        assert got == sorted(want, key=str)


def test_selection_reads_only_its_records(spark):
    df, _ = pages(spark)
    index = warc.write_archives(df)
    some = index.filter("page_id in (3, 102)")
    assert sorted(r["page_id"] for r in warc.read_records(some).collect()) == [3, 3, 3, 102]
    assert warc.read_records(index.limit(0)).count() == 0
    assert warc.write_archives(df.limit(0)).count() == 0


def test_archives_are_plain_gzip_members(spark):
    df, data = pages(spark)
    index = warc.write_archives(df.coalesce(1))
    file = index.first()["file"].removeprefix("file:")
    raw, n = open(file, "rb").read(), 0
    while raw:
        member = zlib.decompressobj(31)
        record = member.decompress(raw)
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
        raw, n = member.unused_data, n + 1
    assert n == index.filter(F.col("file") == index.first()["file"]).count() == len(data)
