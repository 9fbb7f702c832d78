"""Web archives in ZIP packages: written as stored members with an index, read by ranges without extraction."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import session_tables
from .common import cut

#: Bytes of compressed records of one member, and of members of one package, after which the next one begins.
MEMBER_BYTES, PACKAGE_BYTES = 8 << 20, 256 << 20
#: Payloads below this size are never revisits.
LEAST_REVISIT = 100
INDEX = "indexes/index.cdxj"
IS_INDEX = re.compile(r"\.cdxj?(\.gz)?$")
IS_ARCHIVE = re.compile(r"\.warc(\.gz)?$")
#: Bytes that are read of a member at once.
CHUNK = 1 << 20
#: What a record or an index line that can't be read raises.
BROKEN = (ValueError, KeyError, EOFError, zlib.error, gzip.BadGzipFile, struct.error)
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WARC_DATE = "2024-01-01T00:00:00Z"


# --- records -----------------------------------------------------------------------------------------------------------


def record_urn(page_id: int) -> str:
    """A record id that names the page: its number is the UUID's."""
    return f"<urn:uuid:{uuid.UUID(int=page_id % (1 << 128))}>"


def urn_page(urn: str) -> int | None:
    """The page that a record id names; null for ids that others gave, which name none."""
    try:
        n = uuid.UUID(urn.strip("<> ").removeprefix("urn:uuid:")).int
    except ValueError:
        return None
    n = n - (1 << 128) if n >> 127 else n
    return n if -(1 << 63) <= n < 1 << 63 else None


def sort_key(url: str | None) -> str:
    """The key that indexes are sorted by: the host's labels from the last, and the path."""
    parts = urlsplit("".join((url or "").split()))
    host = (parts.hostname or "").removeprefix("www.")
    query = "?" + parts.query if parts.query else ""
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/").lower() + query.lower()


def write_record(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC 1.1 record, gzipped by itself; a revisit holds the response's HTTP header but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_urn(page_id)}", f"WARC-Date: {WARC_DATE}"]
    if url:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_urn(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"
    return gzip.compress(raw, 1, mtime=0)


def _headers(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _sound(named: str, payload: bytes) -> bool:
    """Whether a payload has the digest that its record names; digests of other kinds are taken as they are."""
    kind, _, value = named.partition(":")
    if kind not in ("sha256", "sha1", "md5"):
        return True
    made = hashlib.new(kind, payload)
    return value in (made.hexdigest(), base64.b32encode(made.digest()).decode().rstrip("="), base64.b32encode(made.digest()).decode())


def read_record(data: bytes) -> dict:
    """Fields of a record, gzipped or not. The digest is the SHA-256 of the payload read; of a revisit, the one it names."""
    raw = gzip.decompress(data) if data.startswith(b"\x1f\x8b") else data
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *fields = head.decode("utf-8", "replace").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    h = _headers(fields)
    size = int(h["content-length"])
    if len(rest) < size:
        raise ValueError(f"{h.get('warc-record-id')} is cut off")
    block = rest[:size]
    http, _, payload = block.partition(b"\r\n\r\n") if h.get("content-type", "").startswith("application/http") else (b"", b"", block)
    named, kind = h.get("warc-payload-digest", ""), h.get("warc-type", "")
    revisit = kind == "revisit"
    if not revisit and named and not _sound(named, payload):
        raise ValueError(f"payload of {h.get('warc-record-id')} doesn't have its digest")
    told = _headers(http.decode("latin-1").split("\r\n")[1:]).get("content-length", "") if revisit else ""
    return {
        "page_id": urn_page(h.get("warc-record-id", "")), "record_id": h.get("warc-record-id"), "url": h.get("warc-target-uri"), "payload": None if revisit else payload,
        "payload_bytes": len(payload) if not revisit else int(told) if told.isdigit() else None, "payload_digest": hashlib.sha256(payload).hexdigest() if not revisit else named.removeprefix("sha256:") or None,
        "record_type": kind, "refers_to": urn_page(h.get("warc-refers-to", "")) if revisit else None, "error": None,
    }


def _failed(where: str, why: Exception) -> dict:
    return dict.fromkeys(("page_id", "record_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to")) | {"error": f"{where}: {why}"[:500]}


# --- packages ----------------------------------------------------------------------------------------------------------


def _open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class Package:
    """Writes one ZIP package: members of gzipped records, stored, and at its end an index of the records' ranges, in CDXJ lines."""

    def __init__(self, uri: str):
        self.uri = uri
        files, path = _open_fs(uri)
        files.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = files.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member, self.size, self.n, self.bytes, self.index = [], 0, 0, 0, []

    def add(self, url: str | None, digest: str, record: bytes) -> None:
        at = {"url": url, "digest": f"sha256:{digest}", "mime": "text/html", "status": "200", "filename": f"{self.n:05d}.warc.gz", "offset": str(self.size), "length": str(len(record))}
        self.index.append(f"{sort_key(url)} {re.sub('[^0-9]', '', WARC_DATE)} {json.dumps(at)}")
        self.member.append(record)
        self.size += len(record)
        self.bytes += len(record)
        if self.size >= MEMBER_BYTES:
            self._end_member()

    def _end_member(self) -> None:
        if self.member:
            self.zip.writestr(f"archive/{self.n:05d}.warc.gz", b"".join(self.member))
            self.member, self.size, self.n = [], 0, self.n + 1

    def close(self) -> dict:
        self._end_member()
        self.zip.writestr(INDEX, "".join(f"{line}\n" for line in sorted(self.index)))
        self.zip.close()
        self.out.close()
        return {"path": self.uri, "records": len(self.index), "bytes": self.bytes}


def _zip64(extra: bytes, values: list[int]) -> list[int]:
    """values, with those that are all ones replaced from the ZIP64 extra field, in order."""
    while len(extra) >= 4:
        kind, size = struct.unpack("<HH", extra[:4])
        if kind == 1:
            wide = list(struct.unpack(f"<{size // 8}Q", extra[4 : 4 + size // 8 * 8]))
            return [wide.pop(0) if v == 0xFFFFFFFF and wide else v for v in values]
        extra = extra[4 + size :]
    return values


class Reader:
    """A ZIP package by its directories: where each stored member's bytes are, and ranges of them."""

    def __init__(self, file):
        self.file = file
        self.packed: dict[str, tuple[int, int]] = {}
        self.members = self._directory()

    def read(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(length)

    def _directory(self) -> dict[str, tuple[int, int]]:
        """Name to (offset of the local header, size) of stored members, from the central directory; deflated ones are in packed."""
        size = self.file.size()
        start = max(0, size - 22 - 0xFFFF)
        tail = self.read(start, size - start)
        at = tail.rfind(b"PK\5\6")
        if at < 0:
            raise ValueError("no end of central directory: not a ZIP package")
        count, length, offset = struct.unpack("<10xHII", tail[at : at + 20])
        where = start + at - 20
        if where >= 0 and (mark := self.read(where, 20)).startswith(b"PK\6\7"):
            end = self.read(struct.unpack("<8xQ", mark[:16])[0], 56)
            if not end.startswith(b"PK\6\6"):
                raise ValueError("the ZIP64 locator doesn't point to a ZIP64 end of central directory")
            count, length, offset = struct.unpack("<32xQQQ", end)
        data, out, p = self.read(offset, length), {}, 0
        for _ in range(count):
            if data[p : p + 4] != b"PK\1\2":
                raise ValueError("broken central directory")
            method, packed, plain, n, e, c, local = struct.unpack("<10xH8xIIHHH8xI", data[p : p + 46])
            name = data[p + 46 : p + 46 + n].decode("utf-8")
            plain, packed, local = _zip64(data[p + 46 + n : p + 46 + n + e], [plain, packed, local])
            if method == 0:
                out[name] = (local, plain)
            else:  # can't be read by ranges: only indexes are
                self.packed[name] = (local, packed)
            p += 46 + n + e + c
        return out

    def data_offset(self, name: str) -> int:
        """Where a member's bytes begin: after its local header, whose lengths may differ from the directory's."""
        local = (self.members.get(name) or self.packed[name])[0]
        mark, n, e = struct.unpack("<4s22xHH", self.read(local, 30))
        if mark != b"PK\3\4":
            raise ValueError(f"no local header of {name}")
        return local + 30 + n + e

    def _pieces(self, name: str) -> Iterator[bytes]:
        """A member's bytes, part by part, inflated if it is deflated, and unzipped if its name says so."""
        start, size = self.data_offset(name), (self.members.get(name) or self.packed[name])[1]
        undo = [zlib.decompressobj(-15)] if name in self.packed else []
        for at in range(start, start + size, CHUNK):
            data = self.read(at, min(CHUNK, start + size - at))
            for d in undo:
                data = d.decompress(data)
            yield data

    def lines(self, name: str) -> Iterator[str]:
        """The lines of an index."""
        pieces = _gunzipped(self._pieces(name)) if name.endswith(".gz") else self._pieces(name)
        rest = b""
        for piece in pieces:
            *whole, rest = (rest + piece).split(b"\n")
            yield from (x.decode("utf-8", "replace") for x in whole)
        if rest:
            yield rest.decode("utf-8", "replace")

    def _place(self, name: str) -> str:
        """The member that an index means: its whole name, or that under archive/."""
        for n in (name, f"archive/{name}"):
            if n in self.members:
                return n
        raise ValueError(f"no stored member {name}")

    def records(self) -> Iterator[dict]:
        """Every record that any index names, each by its own range; archives that no index names are read from end to end. What
        can't be read is a row with an error, and the rest goes on."""
        starts: dict[str, int] = {}
        for index in sorted(n for n in (*self.members, *self.packed) if IS_INDEX.search(n)):
            try:
                for k, line in enumerate(self.lines(index), 1):
                    if "{" not in line:  # a header, or nothing
                        continue
                    try:
                        at = json.loads(line[line.index("{") :])
                        name = self._place(at["filename"])
                        if name not in starts:
                            starts[name] = self.data_offset(name)
                        offset, length = int(at["offset"]), int(at["length"])
                        if not 0 <= offset <= offset + length <= self.members[name][1]:
                            raise ValueError("a range beyond the member")
                        yield read_record(self.read(starts[name] + offset, length))
                    except BROKEN as e:
                        yield _failed(f"{index}, line {k}", e)
            except BROKEN as e:
                yield _failed(index, e)
        for name in sorted(n for n in self.members if IS_ARCHIVE.search(n) and n not in starts):
            try:
                yield from self._scan(name)
            except BROKEN as e:
                yield _failed(name, e)
        for name in sorted(n for n in self.packed if IS_ARCHIVE.search(n)):
            yield _failed(name, ValueError("a deflated archive can't be read by ranges"))

    def _scan(self, name: str) -> Iterator[dict]:
        """The records of an archive without an index, one after another."""
        held = b""
        for piece in _gunzipped(self._pieces(name)) if name.endswith(".gz") else self._pieces(name):
            held += piece
            while (end := held.find(b"\r\n\r\n")) >= 0:
                size = end + 4 + int(_headers(held[:end].decode("utf-8", "replace").split("\r\n")[1:])["content-length"]) + 4
                if len(held) < size:
                    break
                try:
                    yield read_record(held[:size])
                except BROKEN as e:
                    yield _failed(name, e)
                held = held[size:]
        if held.strip():
            raise ValueError("it ends within a record")


def _gunzipped(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The contents of gzip members that follow each other."""
    d = zlib.decompressobj(31)
    for piece in pieces:
        while piece:
            yield d.decompress(piece)
            piece = d.unused_data
            if d.eof:
                d = zlib.decompressobj(31)


# --- operators -----------------------------------------------------------------------------------------------------------


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes a record per page and returns the packages: (path, records, bytes), as a written table.

    Null payloads are empty. Of pages with equal payloads of LEAST_REVISIT bytes or more, that with the smallest id is a
    response, the others revisit it; rows that repeat that id are responses too. Rows with a null id have no record.
    Payloads are compared by SHA-256; digests are combined before the shuffle. Only revisits' ids, written first, go back to
    pages: Spark sends them to the payloads where their size is under its broadcast threshold, and else joins by id, so that
    a hot payload is no hot key. Extra columns play no part; an empty table gives no packages. Each task writes packages of its own names to the shared
    folder: those of failed attempts are in no table and play no part.
    """
    folder = folder or session_tables(pages.sparkSession).path("warc")
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha2(payload.cast("binary"), 256).alias("digest"))
    narrow = cut(rows.select("id", "digest", F.octet_length("payload").alias("size")))
    large = narrow.where(F.col("size") >= LEAST_REVISIT)
    first = large.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    revisits = large.join(first, "digest").where("id <> first").select(F.col("id").alias("rid"), F.col("digest").alias("rdigest"), "first").distinct()
    revisits = cut(revisits)
    joined = rows.join(revisits, (F.col("id") == F.col("rid")) & (F.col("digest") == F.col("rdigest")), "left").select("id", "url", "payload", "digest", "first")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        name, k, package, done = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}", 0, None, []
        for b in batches:
            for i, url, text, digest, first in zip(b["id"], b["url"], b["payload"], b["digest"], b["first"]):
                if package is None:
                    package, k = Package(f"{name}-{k:04d}.wacz"), k + 1
                package.add(url, digest, write_record(int(i), url, text.encode("utf-8"), digest, None if pd.isna(first) else int(first)))
                if package.bytes >= PACKAGE_BYTES:
                    done.append(package.close())
                    package = None
        if package is not None:
            done.append(package.close())
        if done:
            yield pd.DataFrame(done)

    return cut(joined.mapInPandas(run, "path string, records long, bytes long"))


def read_archives(packages: DataFrame, payloads: bool = True) -> DataFrame:
    """Rows of the records in packages (path): page_id, record_id, url, payload (null for revisits), payload_bytes, payload_digest,
    record_type, refers_to, error. A record, an index line or a whole package that can't be read is a row with an error and
    nothing else. Packages are dealt evenly over as many tasks as there are packages, 20,000 at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def out(rows: list[dict]) -> pd.DataFrame:
            made = pd.DataFrame(rows)
            for c in ("page_id", "payload_bytes", "refers_to"):
                made[c] = pd.array(made[c].tolist(), "Int64")
            return made if payloads else made.drop(columns="payload")

        for b in batches:
            for uri in b["path"]:
                rows: list[dict] = []
                held = 0
                try:
                    files, path = _open_fs(uri)
                    with files.open_input_file(path) as f:
                        for r in Reader(f).records():
                            rows.append(r)
                            held += r["payload_bytes"] or 0
                            if held > MEMBER_BYTES or len(rows) >= 5000:
                                yield out(rows)
                                rows, held = [], 0
                except BROKEN as e:  # not what can't be reached: such a task is tried again
                    rows.append(_failed(uri, e))
                if rows:
                    yield out(rows)

    schema = "page_id long, record_id string, url string, " + "payload binary, " * payloads + "payload_bytes long, payload_digest string, record_type string, refers_to long, error string"
    paths = cut(packages.select("path"))
    return paths.repartition(min(20_000, max(1, paths.count()))).mapInPandas(run, schema)
