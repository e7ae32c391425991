import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from priceloom.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, first string"
ROWS = [
    (5, "http://e/5", "same"), (2, "http://e/2", "same"), (9, None, "same"), (1, "u", None), (3, "u", ""),
    (7, "a\r\nWARC-Type: x", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n"), (8, "u", "é\r\n\r\n𝒳\n"),
    (4, "u", "x" * 300_000), (6, "u", "tie"), (6, "u", "tie"), (None, "n", "same"), (None, "n", "no id"),
]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def expected(rows, min_bytes=0):
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        first = min(same) if same else None
        again = len(raw) >= min_bytes and first != page
        out.append((str(page), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(),
                    "revisit" if again else "response", str(first if again else None)))
    return sorted(out)


@pytest.mark.parametrize("min_bytes", [0, 4, 10])
def test_round_trip(spark, min_bytes):
    found = warc.archive_report(spark, pages(spark), min_bytes).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to))
                  for r in found) == expected(ROWS, min_bytes)


def test_archives_are_plain_warc(spark, tmp_path):
    folder = str(tmp_path / "warc")
    warc.write_archives(pages(spark), folder, date=F.lit("2024-01-02T03:04:05Z"))
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "warc").glob("part-*.gz"))
    assert raw.count(b"WARC-Date: 2024-01-02T03:04:05Z\r\n") == len(ROWS) and raw.count(b"x" * 300_000) == 1
    records = warc.read_archives(spark, folder).collect()
    assert sorted(bytes(r.payload) for r in records if r.record_type == "response") == sorted(
        (h or "").encode() for h in ["same", None, ROWS[5][2], ROWS[6][2], ROWS[7][2], "tie", "tie", "no id"])
    assert all(bytes(r.payload) == b"" and r.refers_to for r in records if r.record_type == "revisit")
    assert len({r.record_id for r in records}) == len(ROWS) - 1


def test_text_keys_come_back_as_they_were(spark):
    keys = [" a ", "b\n", "b%0A", "%", "c\r\nd", "", "\t\u00a0", "é:%25", "a"]
    df = spark.createDataFrame([(k, None, "same") for k in keys], "page_id string, url string, html string")
    found = {r.page_id: (r.record_type, r.refers_to) for r in warc.archive_report(spark, df).collect()}
    assert found == {k: ("revisit", "") if k else ("response", None) for k in keys}


def test_damage_is_noticed():
    import io

    with pytest.raises(ValueError):
        list(warc._records(io.BytesIO(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")))
    with pytest.raises(ValueError):
        list(warc._records(io.BytesIO(b"junk\r\n")))


def test_empty(spark):
    assert warc.archive_report(spark, pages(spark, [])).count() == 0
