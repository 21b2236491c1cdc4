import hashlib
from collections import defaultdict

from tagloom.llm import warc

BIG, TINY = "<p>é</p>\r\n\r\nWARC/1.1\r\n" * 60, "<p>small</p>"
PAGES = [(1, "http://a", BIG), (5, "http://b", BIG), (3, None, BIG), (7, "http://c\r\nX: y", TINY), (8, "http://d", TINY), (9, "http://e", None), (10, "http://f", ""), (11, "http://g", "x" * 999), (12, "http://h", "x" * 999), (13, "http://i", "y" * 1000), (14, "http://j", "y" * 1000), (15, "http://k", "z" * 300_000), (9, "http://e", None), (5, "http://b", BIG)]


def brute(pages):
    groups = defaultdict(list)
    for page, _, html in pages:
        groups[(html or "").encode()].append(page)
    out = []
    for payload, members in groups.items():
        for page in members:
            revisit = len(payload) >= 1000 and page != max(members)
            out.append((page, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", max(members) if revisit else None))
    return sorted(out, key=str)


def frame(spark, pages):
    return spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, digest string")


def test_round_trip(spark):
    for options in ({}, {"compression": "gzip", "file_records": 2}):
        assert sorted(map(tuple, warc.archive(frame(spark, PAGES), **options).collect()), key=str) == brute(PAGES)


def test_hot_payload(spark):
    pages = [(i, f"http://x/{i}", BIG if i % 3 else BIG + str(i)) for i in range(600)]
    assert sorted(map(tuple, warc.archive(frame(spark, pages)).collect()), key=str) == brute(pages)


def test_empty_table(spark):
    assert warc.archive(frame(spark, [])).collect() == []


def test_files_are_archives(spark, tmp_path):
    warc.write(frame(spark, PAGES), f"{tmp_path}/out")
    records = [r for f in sorted((tmp_path / "out").glob("part-*")) for r in warc._records(f.read_bytes())]
    assert len(records) == len(PAGES)
    assert all(f["WARC-Record-ID"].startswith("<urn:uuid:") and "\n" not in f.get("WARC-Target-URI", "") for f, _ in records)
    ids = {f["WARC-Record-ID"] for f, _ in records if f["WARC-Type"] == "response"}
    assert all(f["WARC-Refers-To"] in ids for f, _ in records if f["WARC-Type"] == "revisit")


def test_archives_of_many_members_and_missing_responses(spark, tmp_path):
    import gzip

    warc.write(frame(spark, PAGES), f"{tmp_path}/out", file_records=1)
    parts = sorted(p.read_bytes() for p in (tmp_path / "out").glob("part-*"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/part-0.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    assert sorted(map(tuple, warc.resolved(warc.read(spark, f"{tmp_path}/in")).collect()), key=str) == brute(PAGES)
    (tmp_path / "some").mkdir()
    (tmp_path / "some/part-0.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts if b"Page-Id: 5\r\n" not in p))
    left = {r.page_id: r for r in warc.resolved(warc.read(spark, f"{tmp_path}/some")).collect()}
    digest = hashlib.sha1(BIG.encode()).hexdigest()
    assert set(left) == {p[0] for p in PAGES} - {5}
    assert (left[1].record_type, left[1].refers_to, left[1].payload_bytes, left[1].payload_digest) == ("revisit", None, None, digest)


def test_files_hold_few_bytes(spark, tmp_path):
    """Small and large pages side by side: no file has more payload than it may, but for one record."""
    pages = [(i, f"http://x/{i}", f"{i} " + "a" * (60_000 if i % 50 == 0 else 9_000 if i % 5 == 0 else 200)) for i in range(300)]
    warc.write(frame(spark, pages).coalesce(1), str(tmp_path / "w"), file_records=100, file_bytes=20_000)
    found = 0
    for file in (tmp_path / "w").glob("part-*"):
        blocks = [len(b) for _, b in warc._records(file.read_bytes())]
        found += len(blocks)
        assert len(blocks) <= 100 and (len(blocks) == 1 or sum(blocks) <= 20_000 + 100 * len(blocks))
    assert found == 300
    assert sorted(map(tuple, warc.archive(frame(spark, pages), file_records=100, file_bytes=20_000).collect()), key=str) == brute(pages)


def test_bands_leave_no_gap():
    for records, size in ((2000, 1 << 28), (2, 1 << 28), (1, 1 << 28), (5, 3), (100, 20_000)):
        cuts = warc.bands(records, size)
        assert cuts[0][0] == 0 and cuts[-1][1] is None and cuts[-1][2] == 1
        assert all(a[1] == b[0] for a, b in zip(cuts, cuts[1:]))
        assert all(1 <= n <= records and (over - 1) * n <= size for _, over, n in cuts[:-1])
