"""WARC archives: a writer with revisit records and a splittable reader.

Archives are files of concatenated gzip members, one record each.  A reading
task gets a byte range and no index: it looks for gzip magic, accepts a place
as the start of a record only if the member there inflates to a WARC header,
and owns every record that starts inside its range, also one that ends beyond.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isopleth.session import pinned

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 16

MANIFEST = "file string, bytes long, records long"
RECORDS = """id string, url string, record_type string, refers_to string, payload_digest string, payload binary,
    file string, offset long, length long, number int, problem string"""


def base32_of_hex(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def _uri(key: str | None) -> str:
    """A record id; null has a form of its own."""
    return "<urn:row:null>" if key is None else f"<urn:row:key:{quote(key, safe='')}>"


def _key(uri: str | None) -> str | None:
    """The key in a record id made by :func:`_uri`; ids of other writers stay as they are."""
    own = "<urn:row:key:"
    if uri is None or uri == "<urn:row:null>":
        return None
    return unquote(uri[len(own) : -1]) if uri.startswith(own) else uri


def record(key: str | None, url: str | None, refers_to: str | None, revisit: bool, digest: str, payload: bytes) -> bytes:
    """One gzip member: a response with its payload, or a revisit with HTTP headers only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_uri(key)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe='/:?#[]@!$&()*+,;=-._~')}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {_uri(refers_to)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def with_revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", min_bytes: int = 0) -> DataFrame:
    """Rows to write: id, url, payload (null: empty), digest, refers_to, revisit.

    Of rows with equal payloads of at least ``min_bytes`` those with the
    largest id are responses and the others revisit it; smaller payloads are
    all responses.  Rows that repeat the largest id are all responses; a null
    id revisits where another row of its payload has an id, else it is a
    response.  One skinny aggregation finds the targets; a payload that very
    many rows share is one row of it, and the join back may be split.
    """
    rows = pages.select(
        F.col(id_col).alias("id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col).cast("binary"), F.encode(F.lit(""), "UTF-8")).alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    last = rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.max("id").alias("refers_to"))
    revisit = F.coalesce(~F.col("id").eqNullSafe(F.col("refers_to")), F.lit(False)) & F.col("refers_to").isNotNull()
    return (
        rows.join(last, "digest", "left")
        .withColumn("revisit", revisit)
        .select(
            F.col("id").cast("string").alias("id"),
            "url",
            F.when(~F.col("revisit"), F.col("payload")).alias("payload"),
            "digest",
            F.when(F.col("revisit"), F.col("refers_to")).cast("string").alias("refers_to"),
            "revisit",
        )
    )


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write :func:`with_revisits` rows as archives below ``folder``, one file per task; the manifest of what counts.

    ``folder`` is a path or URI that Arrow's file systems can reach from every
    executor.  Each attempt of a task writes a file of its own name and only
    the attempt whose manifest row arrives counts, so lost executors and
    speculative attempts leave no double records.
    """

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        size = n = 0
        with store.open_output_stream(f"{base}/{name}", compression=None) as out:
            for frame in frames:
                for key, url, payload, digest, refers_to, revisit in frame.itertuples(index=False, name=None):
                    made = record(key, url, refers_to, revisit, base32_of_hex(digest), payload or b"")
                    out.write(made)
                    size, n = size + len(made), n + 1
        yield pd.DataFrame({"file": [f"{folder}/{name}"], "bytes": [size], "records": [n]})

    return pinned(rows.mapInPandas(write, MANIFEST))


def splits(files: DataFrame, split_bytes: int = 8 << 20) -> DataFrame:
    """Byte ranges ``file, bytes, start, end`` that cover each file of ``file, bytes``."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long")))
    ranges = files.where("bytes > 0").select("file", "bytes", starts.alias("start"))
    return ranges.withColumn("end", F.least(F.col("start") + F.lit(split_bytes), F.col("bytes")))


class _Window:
    """Forward reads of a file that keep only what is still needed."""

    def __init__(self, f, size: int):
        self.f, self.size, self.at, self.data = f, size, 0, b""

    def read(self, pos: int, n: int) -> bytes:
        """Up to ``n`` bytes at ``pos``."""
        if pos < self.at or pos + n > self.at + len(self.data):
            self.f.seek(pos)
            self.at, self.data = pos, self.f.read(min(max(n, CHUNK), self.size - pos))
        return self.data[pos - self.at : pos - self.at + n]


def _starts_record(w: _Window, pos: int) -> bool:
    """Whether the bytes at ``pos`` begin a gzip member whose content begins like a WARC header."""
    try:
        return zlib.decompressobj(31).decompress(w.read(pos, CHUNK), len(VERSION)) == VERSION
    except zlib.error:
        return False


def _member(w: _Window, pos: int) -> tuple[bytes, int] | None:
    """Content of the member at ``pos`` and where it ends; None if it does not inflate to its end."""
    unpack, out, at = zlib.decompressobj(31), [], pos
    try:
        while not unpack.eof:
            data = w.read(at, CHUNK)
            if not data:
                return None
            out.append(unpack.decompress(data))
            at += len(data)
    except zlib.error:
        return None
    return b"".join(out), at - len(unpack.unused_data)


def _next_record(w: _Window, pos: int, end: int) -> tuple[bytes, int, int] | None:
    """Content, start and end of the first member that starts in [pos, end), by its magic."""
    while pos < end:
        data = w.read(pos, CHUNK)
        found = data.find(MAGIC)
        if found < 0 or pos + found >= end:
            if len(data) < CHUNK and pos + len(data) >= w.size:
                return None
            pos += max(1, len(data) - len(MAGIC) + 1) if found < 0 else end
            continue
        pos += found
        if _starts_record(w, pos) and (whole := _member(w, pos)):
            return whole[0], pos, whole[1]
        pos += 1
    return None


def members_in_range(f, size: int, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Content, start and end of every member of records that starts in [start, end) of an open file."""
    w, pos = _Window(f, size), start
    while pos < end:
        whole = _member(w, pos) if _starts_record(w, pos) else None
        found = (whole[0], pos, whole[1]) if whole else _next_record(w, pos, end)
        if found is None:
            return
        yield found
        pos = found[2]


def records_in_range(f, size: int, start: int, end: int) -> Iterator[bytes]:
    """Content of every member that starts in [start, end) of an open file."""
    return (raw for raw, _, _ in members_in_range(f, size, start, end))


def _fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; folded lines belong to the one before, lines without a colon are passed over."""
    fields, name = {}, None
    for line in head.decode(errors="replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            fields[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            fields[name] = value.strip()
    return fields


def _digest_problem(stated: str | None, payload: bytes, digest: str) -> str | None:
    """What is wrong with a stated digest; those of an unknown algorithm or spelling are not judged."""
    name, _, value = (stated or "").partition(":")
    if name.lower() == "sha1":
        same = value.upper() == digest or value.lower() == hashlib.sha1(payload).hexdigest()
    elif name.lower() in ("md5", "sha256", "sha512") and value.isalnum():
        raw = hashlib.new(name.lower(), payload)
        same = value.lower() == raw.hexdigest() or value.upper().rstrip("=") == base64.b32encode(raw.digest()).decode().rstrip("=")
    else:
        return None
    return None if same else f"payload digest is {digest}, header says {stated}"


def parse(raw: bytes) -> tuple[tuple, bytes]:
    """A record's id, url, type, refers_to, payload digest, payload and problem, and the bytes behind it.

    Any type is a row.  The payload is the block, behind the HTTP header where
    the block has one; a revisit has none.  A missing digest, or one of another
    algorithm, becomes the SHA-1 of the payload; a revisit keeps its own.  A
    header without a right length, and a digest that differs, are problems.
    """
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    kind, stated, length = fields.get("warc-type"), fields.get("warc-payload-digest"), fields.get("content-length", "")
    own = fields.get("warc-record-id")
    url = fields.get("warc-target-uri")
    named = _key(own), url and unquote(url.removeprefix("<").removesuffix(">")), kind, _key(fields.get("warc-refers-to"))
    if not (length.isascii() and length.isdigit()) or int(length) > len(rest):
        return (*named, None, None, f"content length {length or 'missing'}, {len(rest)} bytes follow"), b""
    size = int(length)
    block, behind = rest[:size], rest[size:].removeprefix(b"\r\n\r\n")
    if kind == "revisit":
        return (*named, stated and stated.partition(":")[2], None, None), behind
    http = fields.get("content-type", "").lower().startswith("application/http")
    payload = block.partition(b"\r\n\r\n")[2] if http else block
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    problem = _digest_problem(stated, payload, digest) if kind is not None else "no record type"
    return (*named, digest, payload, problem), behind


def _rows(file: str, members: Iterator[tuple[bytes, int, int]]) -> Iterator[tuple]:
    """The rows of members of ``file``; the first record of a member carries its length, the others 0."""
    for raw, start, end in members:
        number = 0
        while raw or not number:
            (*row, problem), behind = parse(raw)
            if not problem and behind and not behind.startswith(VERSION):
                problem, behind = f"{len(behind)} bytes behind the record", b""
            yield (*row, file, start, 0 if number else end - start, number, problem)
            raw, number = behind, number + 1


def read_archives(files: DataFrame, split_bytes: int = 8 << 20, most_tasks: int = 50_000) -> DataFrame:
    """Records of the gzip archives in ``file, bytes``, of any writer and type.

    Besides id, url, record_type, refers_to, payload_digest and payload a row
    has its member's place (file, offset, length), its number in the member and
    its problem, if any.  Ranges are dealt to tasks by a shuffle of their
    numbers only, one task for each up to ``most_tasks``.  Bytes that are no
    record are passed over here; :func:`losses` finds them.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        names = [part.split()[0] for part in RECORDS.split(",")]
        for frame in frames:
            for file, size, start, end in frame.itertuples(index=False, name=None):
                store, path = fs.FileSystem.from_uri(file)
                rows, held = [], 0
                with store.open_input_file(path) as f:
                    for row in _rows(file, members_in_range(f, size, start, end)):
                        rows.append(row)
                        held += len(row[5] or b"") + 500
                        if held > 16 << 20:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
                yield pd.DataFrame(rows, columns=names)

    ranges = splits(files, split_bytes)
    # A number of its own, since the few bytes of these rows say nothing about the work behind them.
    tasks = max(1, min(ranges.count(), most_tasks))
    return ranges.repartition(tasks, F.col("file"), F.col("start")).mapInPandas(read, RECORDS)


def losses(files: DataFrame, records: DataFrame) -> DataFrame:
    """Files not read whole: file, bytes, read_bytes, records, problems.

    The members that were read must tile the file from its first byte to its
    last, hold no problem and, where ``files`` has ``records``, be that many.
    """
    seen = records.groupBy("file").agg(
        F.sum("length").alias("read_bytes"), F.count(F.lit(1)).alias("_records"), F.count("problem").alias("problems")
    )
    expected = F.col("records") if "records" in files.columns else F.lit(None).cast("long")
    rows = files.select("file", "bytes", expected.alias("_expected")).join(seen, "file", "left")
    rows = rows.fillna(0, ["read_bytes", "_records", "problems"])
    wrong = (F.col("read_bytes") != F.col("bytes")) | (F.col("problems") > 0) | F.coalesce(F.col("_expected") != F.col("_records"), F.lit(False))
    return rows.where(wrong).select("file", "bytes", "read_bytes", F.col("_records").alias("records"), "problems")


def resolved(records: DataFrame, id_type: str = "bigint", files: DataFrame | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of responses and revisits; a revisit's size is its target's.

    With ``files``, archives that were not read whole are an error that names some of them.
    Sizes of targets are aggregated first, so repeated records do not multiply
    revisits and a target of very many revisits is one row of the smaller side.
    """
    # Written, so that the archives are read once and joins see real sizes.
    rows = pinned(records.select(
        F.col("id").cast(id_type).alias("page_id"),
        F.octet_length("payload").cast("long").alias("own"),
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(id_type).alias("refers_to"),
        "file",
        "length",
        "problem",
    ))
    if files is not None and (lost := losses(files, rows).limit(5).collect()):
        raise ValueError(f"archives not read whole: {', '.join(map(str, lost))}")
    rows = rows.where("record_type IN ('response', 'revisit')")
    targets = (
        rows.where("record_type = 'response' AND page_id IS NOT NULL")
        .groupBy(F.col("page_id").alias("refers_to"), "payload_digest")
        .agg(F.max("own").alias("theirs"))
    )
    return rows.join(targets, ["refers_to", "payload_digest"], "left").select(
        "page_id", F.coalesce("own", "theirs").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"
    )
