import gzip
import hashlib
import io
import zipfile

import pytest

from matchloom.llm import warc


class Ranges(io.BytesIO):
    def size(self):
        return len(self.getbuffer())


def test_frames(spark, monkeypatch):
    monkeypatch.setattr(warc, "MEMBER_BYTES", 2000)
    monkeypatch.setattr(warc, "PACKAGE_BYTES", 5000)
    rows = [(i, f"http://h/{i}\r\nx", f"<p>{i}</p>" * (i % 50)) for i in range(200)]
    rows += [(300 + i, None, "é" * 60) for i in range(50)] + [(400 + i, "u", "short") for i in range(3)] + [(500, "u", None), (501, "u", ""), (-7, "u", "é" * 60), (502, "u", "é" * 60), (502, "u", "é" * 60)]
    df = spark.createDataFrame([*rows, (None, "u", "no id")], "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS id")
    packages = warc.write_archives(df)
    assert packages.count() > 4
    got = warc.read_archives(packages).collect()
    first = {}
    for i, _, h in sorted(rows):
        first.setdefault(h or "", i)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        again = len(raw) >= 100 and first[h] != i
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == sorted(want, key=repr)
    payload = {r.page_id: bytes(r.payload) for r in got if r.payload is not None}
    assert all(payload[i] == (h or "").encode() for i, _, h in rows if i in payload) and len(payload) > 150
    path = packages.first().path.removeprefix("file://")
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


@pytest.mark.parametrize("zip64", [False, True])
def test_packages_of_others(zip64, monkeypatch):
    if zip64:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 50)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    out = Ranges()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.comment = b"with a comment"
        for name in ("a.txt", "dir/ü.bin"):
            z.writestr(name, name.encode() * 20)
        z.writestr("packed", b"x" * 100, zipfile.ZIP_DEFLATED)
    assert zip64 == (b"PK\6\6" in out.getvalue())
    r = warc.Reader(out)
    assert set(r.members) == {"a.txt", "dir/ü.bin"}
    for name, (_, size) in r.members.items():
        assert r.read(r.data_offset(name), size) == name.encode() * 20
    assert list(r.records()) == []


def record(i, text=b"abc", kind="response"):
    return warc.write_record(i, f"http://a.org/{i}", text, hashlib.sha256(text).hexdigest(), None)


def cdxj(name, at, size):
    return f'org,a)/x 20240101000000 {{"url": "http://a.org/x", "filename": "{name}", "offset": "{at}", "length": {size}, "status": "200"}}\n'


@pytest.mark.parametrize("gz", [False, True])
@pytest.mark.parametrize("packed", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
def test_indexes_of_others(gz, packed, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 37)
    one, two = record(1), record(2, b"x" * 500)
    lines = "!meta 0 no record\n" + cdxj("data.warc.gz", 0, len(one)) + cdxj("archive/data.warc.gz", len(one), len(two)) + cdxj("data.warc.gz", 3, 9) + cdxj("gone.warc.gz", 0, 5) + cdxj("data.warc.gz", 0, 10**9) + "org,a)/y 2024 {broken\n"
    data = gzip.compress(lines[:200].encode()) + gzip.compress(lines[200:].encode()) if gz else lines.encode()
    out = Ranges()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("archive/data.warc.gz", one + two)
        z.writestr("indexes/index.cdx" + ".gz" * gz, data, packed)
    rows = list(warc.Reader(out).records())
    assert [(r["page_id"], r["payload_bytes"]) for r in rows if r["error"] is None] == [(1, 3), (2, 500)]
    assert sum(r["error"] is not None for r in rows) == 4


@pytest.mark.parametrize("gz", [False, True])
def test_archives_without_an_index(gz, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 53)
    raw = [gzip.decompress(record(i, b"y" * (40 * i))) for i in range(1, 6)]
    bad = raw[2].replace(b"sha256:", b"sha256:0")
    foreign = raw[3].replace(raw[3].split(b"urn:uuid:")[1][:36], b"9f3b7c1e-aaaa-4bbb-8ccc-123456789abc").replace(b"sha256:" + hashlib.sha256(b"y" * 160).hexdigest().encode(), b"blake3:unknown")
    whole = [raw[0], raw[1], bad, foreign, raw[4]]
    out = Ranges()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.warc" + ".gz" * gz, b"".join(gzip.compress(x) for x in whole) if gz else b"".join(whole))
        z.writestr("b.warc.gz", b"x" * 50, zipfile.ZIP_DEFLATED)
    rows = list(warc.Reader(out).records())
    assert [r["page_id"] for r in rows] == [1, 2, None, None, 5, None]
    assert [r["error"] is None for r in rows] == [True, True, False, True, True, False] and rows[3]["payload_bytes"] == 160


def test_broken_packages_are_rows(spark, tmp_path):
    (tmp_path / "no.wacz").write_bytes(b"nothing of the kind")
    with zipfile.ZipFile(tmp_path / "one.wacz", "w") as z:
        z.writestr("archive/a.warc.gz", record(7))
    paths = spark.createDataFrame([(f"file://{tmp_path}/{n}",) for n in ("no.wacz", "one.wacz")], "path string")
    got = warc.read_archives(paths)
    assert sorted((r.page_id or 0, r.error is None) for r in got.collect()) == [(0, False), (7, True)]
    assert got.rdd.getNumPartitions() == 2  # as many tasks as packages


def test_sort_keys():
    assert warc.sort_key("https://www.Example.com/A/b?Q=1") == "com,example)/a/b?q=1" and warc.sort_key(None) == ")/"


def test_broken_input_is_refused():
    with pytest.raises(ValueError, match="not a ZIP"):
        warc.Reader(Ranges(b"no package"))
    good = warc.write_record(5, None, b"abc", hashlib.sha256(b"abc").hexdigest(), None)
    assert warc.read_record(good)["payload"] == b"abc"
    with pytest.raises(ValueError, match="digest"):
        warc.read_record(warc.write_record(5, None, b"abc", "0" * 64, None))
