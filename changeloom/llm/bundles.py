"""Seekable Zstandard bundles of WARC records.

Records are grouped into frames that are compressed on their own, so one can be read without the others. A bundle ends with
a seek table in a skippable frame: the compressed and the decompressed size of each frame, the number of frames and a magic
number, so a reader finds any frame from the file's end alone. An index maps each record's id to its bundle, frame and place in the frame.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.llm import kernels as K
from changeloom.llm.common import bounded_batches

SKIPPABLE, FOOTER = 0x184D2A5E, 0x8F92EAB1
FRAME, BUNDLE = 256 << 10, 64 << 20
INDEX = "page_id long, bundle string, frame int, frame_start long, frame_size long, offset long, length long, sha1 string"


def record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    """A WARC/1.1 resource record. A null url or page is an empty one; line ends in a url are dropped."""
    body = (html or "").encode()
    target = "".join((url or "").split("\r")).replace("\n", "")
    digest = hashlib.sha1(body).hexdigest()
    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>\r\nWARC-Target-URI: {target}\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Block-Digest: sha1:{digest}\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record; raises ValueError if its digest or length is wrong."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    if len(rest) != len(body) + 4 or fields["WARC-Block-Digest"] != "sha1:" + hashlib.sha1(body).hexdigest():
        raise ValueError("broken WARC record")
    return fields, body


def write_bundle(out: BinaryIO, records: Iterator[tuple[int | None, bytes]], frame: int = FRAME, level: int = 3) -> list[tuple]:
    """Writes frames of about `frame` bytes and the seek table. Returns (id, frame, frame start, frame size, offset in the frame, length)."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=level, write_checksum=True)
    entries, sizes, at = [], [], 0
    buf, waiting = bytearray(), []

    def flush() -> None:
        nonlocal at
        z = pack.compress(bytes(buf))
        out.write(z)
        entries.extend((i, len(sizes), at, len(z), o, n) for i, o, n in waiting)
        sizes.append((len(z), len(buf)))
        at += len(z)
        buf.clear()
        waiting.clear()

    for key, raw in records:
        if buf and len(buf) + len(raw) > frame:
            flush()
        waiting.append((key, len(buf), len(raw)))
        buf += raw
    if buf:
        flush()
    table = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, FOOTER)
    out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
    return entries


def seek_table(f: BinaryIO) -> list[tuple[int, int, int]]:
    """(start, compressed size, decompressed size) of each frame, read from the end of the file."""
    f.seek(0, 2)
    end = f.tell()
    f.seek(end - 9)
    n, descriptor, magic = struct.unpack("<IBI", f.read(9))
    if magic != FOOTER:
        raise ValueError("no seek table")
    entry = 12 if descriptor & 0x80 else 8
    f.seek(end - 9 - n * entry)
    raw, at, out = f.read(n * entry), 0, []
    for i in range(n):
        c, d = struct.unpack_from("<II", raw, i * entry)
        out.append((at, c, d))
        at += c
    return out


def read_record(f: BinaryIO, frame_start: int, frame_size: int, offset: int, length: int) -> bytes:
    """One record: only its frame is read and decompressed."""
    import zstandard

    f.seek(frame_start)
    return zstandard.ZstdDecompressor().decompress(f.read(frame_size))[offset : offset + length]


def _open(uri: str, write: bool = False) -> BinaryIO:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri) if "://" in uri else fs.FileSystem.from_uri(uri if uri.startswith("file:") else f"file://{uri}")
    return system.open_output_stream(path) if write else system.open_input_file(path)


def _move(a: str, b: str) -> None:
    from pyarrow import fs

    system, x = fs.FileSystem.from_uri(a)
    system.move(x, fs.FileSystem.from_uri(b)[1])


def bundle(pages: DataFrame, out_dir: str, frame: int = FRAME, bundle_bytes: int = BUNDLE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes all pages into bundles under out_dir, and returns the index, one row for each page.

    A page's bundle follows from its hash, and a bundle's records are sorted, so a task that runs again writes the same file; it writes under
    a name of its own and then renames. Bundles hold about bundle_bytes of pages before compression. Null urls and pages are written as empty, a null id as an
    empty one; repeated rows become records of their own. A page longer than a frame gets a frame of its own. No page: no bundle and an empty index. Other columns are ignored.
    """
    bounded_batches(pages)
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    total = src.agg(F.sum(F.coalesce(F.octet_length("html"), F.lit(0)) + 512)).first()[0] or 0
    n = max(1, -(-total // bundle_bytes))
    local = pages.sparkSession.sparkContext.master.startswith("local[")
    if "://" not in out_dir and not out_dir.startswith("file:") and not local:
        raise ValueError("name a folder that all executors share, with its scheme")
    root = out_dir if "://" in out_dir else "file://" + out_dir.removeprefix("file:")

    @K.lean
    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(root)
        system.create_dir(folder, recursive=True)

        def rows() -> Iterator[tuple[int, int | None, bytes]]:
            for b in it:
                for k, i, u, h in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                    yield k, i, record(i, u, h)

        import itertools

        for k, group in itertools.groupby(rows(), key=lambda r: r[0]):
            name = f"{root}/pages-{k:06d}.warc.zst"
            own = f"{name}.{uuid.uuid4().hex}"
            digests: list[str] = []

            def records(group=group, digests=digests) -> Iterator[tuple[int | None, bytes]]:
                for _, i, raw in group:
                    digests.append(hashlib.sha1(raw).hexdigest())
                    yield i, raw

            with _open(own, True) as f:
                got = write_bundle(f, records(), frame)
            _move(own, name)
            cols = list(zip(*got, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array([name] * len(got), pa.string()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:]), pa.array(digests, pa.string())],
                names=["page_id", "bundle", "frame", "frame_start", "frame_size", "offset", "length", "sha1"],
            )

    key = F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(n)).cast("int")
    parted = src.select(key.alias("k"), "page_id", "url", "html").repartitionById(n, F.col("k")).sortWithinPartitions("k", "page_id", "url", F.xxhash64("html"))
    return parted.mapInArrow(write, INDEX)


def fetch(index: DataFrame) -> DataFrame:
    """The index's rows with url, html and intact, each record read from its frame alone; a frame's records are read together.

    intact says whether the record's digest and the index's are right; a broken record has a null url and page.
    """
    names = [x.split()[0] for x in INDEX.split(", ")]

    def read(pdf: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        pdf = pdf.sort_values("offset")
        with _open(pdf["bundle"].iloc[0]) as f:
            f.seek(int(pdf["frame_start"].iloc[0]))
            raw = zstandard.ZstdDecompressor().decompress(f.read(int(pdf["frame_size"].iloc[0])))
        out = []
        for o, n, sha in zip(pdf["offset"], pdf["length"], pdf["sha1"], strict=True):
            one = raw[o : o + n]
            try:
                fields, body = parse(one)
                out.append((fields["WARC-Target-URI"], body.decode(), hashlib.sha1(one).hexdigest() == sha))
            except (ValueError, KeyError):
                out.append((None, None, False))
        url, html, ok = zip(*out, strict=True)
        return pdf.assign(url=url, html=html, intact=ok)

    return index.select(*names).groupBy("bundle", "frame").applyInPandas(read, f"{INDEX}, url string, html string, intact boolean")
