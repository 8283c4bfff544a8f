"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames; a footer frame, which plain
decoders skip, holds the seek table (compressed and plain size of every frame,
the layout of the public seekable format). The index that the writer returns
maps each record to its bundle, its frame and the offset inside the frame, so a
single record costs one ranged read and the decoding of one frame.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import common

# Fixed values of the public seekable format: the skippable frame's magic number and the footer's.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1

INDEX = ("page_id long, record_id string, record_type string, bundle string, frame int, frame_offset long, "
         "frame_size long, offset long, length long")


def _open(path: str):
    """(file system, path in it) of any URI that the cluster's storage has."""
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.FileSystem.from_uri("file://" + path if path.startswith("/") else re.sub("^file:/+", "file:///", path))


def record_id(page_id) -> str:
    return f"<urn:x-page:{page_id}>"


def page_of(uri: str | None) -> int | None:
    m = re.fullmatch(r"<urn:x-page:(-?\d+)>", uri or "")
    return int(m[1]) if m else None


def encode_record(page_id, url, payload: bytes, response_id, date: str = "1970-01-01T00:00:00Z") -> tuple[str, bytes]:
    """(record type, bytes). A revisit holds the HTTP header only and names the response record."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    revisit = response_id is not None and response_id != page_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Refers-To: {record_id(response_id)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return ("revisit" if revisit else "response"), "\r\n".join(head).encode() + body + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header, block) of each record in plain WARC bytes."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(head["content-length"])
        block = data[end + 4 : end + 4 + n]
        if len(block) < n or data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} is cut off")
        yield at, head, block
        at = end + 8 + n


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """frames: compressed and plain size of each."""
    body = b"".join(struct.pack("<II", c, p) for c, p in frames) + struct.pack("<IBI", len(frames), 0, SEEK_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(f, size: int) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of each frame, from the end of an open file."""
    f.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEK_MAGIC:
        raise ValueError("no seek table")
    each = 8 + 4 * bool(flags & 0x80)
    f.seek(size - 9 - n * each)
    table, at, out = f.read(n * each), 0, []
    for k in range(n):
        c, p = struct.unpack_from("<II", table, k * each)
        out.append((at, c, p))
        at += c
    return out


def write_bundles(pages: DataFrame, out_dir: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  min_bytes: int = 0, frame_bytes: int = 1 << 20, bundle_bytes: int = 256 << 20, level: int = 3) -> DataFrame:
    """Writes bundles under out_dir (shared storage) and returns their index, itself written there.

    Of rows with equal payloads of at least min_bytes, those with the largest id
    are responses and the others revisit them; smaller payloads are all
    responses. Null html is an empty payload; a null url writes no target; a row
    with a null id is a response with the id `None`; repeated rows write repeated
    records; an empty table writes no bundle.

    A task writes each bundle to a name of its own and only the names that the
    committed index holds count, so lost executors and repeated tasks leave
    unread files at worst.
    """
    common.tune(pages.sparkSession)
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("_k", F.concat(F.sha2("payload", 256), F.lit("-"), F.length("payload")))
    # Ids and hashes alone find the revisits. The payloads meet them by id, so no payload's copies share
    # a task; where few pages repeat, Spark sends the revisits to the payloads and these aren't shuffled.
    ids = rows.filter((F.length("payload") >= min_bytes) & F.col("page_id").isNotNull()).select("page_id", "_k")
    several = ids.groupBy("_k").agg(F.max("page_id").alias("response_id"), F.min("page_id").alias("_least"))
    several = common.materialize(several.filter("_least < response_id").drop("_least"), "repeated")
    # both sides of this join are plain exchanges, so that adaptive execution splits a hot payload's rows
    revisits = common.materialize(ids.join(several, "_k").filter("page_id < response_id"), "revisits")
    revisits = revisits.groupBy("page_id", "_k").agg(F.max("response_id").alias("response_id"))
    rows = rows.join(revisits, ["page_id", "_k"], "left").select("page_id", "url", "payload", "response_id")
    fs_dir = out_dir

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        fs, root = _open(fs_dir)
        fs.create_dir(root, recursive=True)
        packer = zstandard.ZstdCompressor(level=level, write_content_size=True)
        state: dict = {"out": None}
        plain, held, done = bytearray(), [], []

        def begin() -> None:
            state.update(name=f"bundle-{uuid.uuid4().hex}.warc.zst", frames=[], at=0)
            state["out"] = fs.open_output_stream(f"{root}/{state['name']}", compression=None)  # frames are packed here

        def flush() -> None:
            if not held:
                return
            if state["out"] is None:
                begin()
            z = packer.compress(bytes(plain))
            state["out"].write(z)
            done.extend((p, record_id(p), kind, state["name"], len(state["frames"]), state["at"], len(z), o, n) for p, kind, o, n in held)
            state["frames"].append((len(z), len(plain)))
            state["at"] += len(z)
            plain.clear()
            held.clear()
            if state["at"] >= bundle_bytes:
                close()

        def close() -> None:
            if state["out"] is not None:
                state["out"].write(seek_table(state["frames"]))
                state["out"].close()
                state["out"] = None

        def index() -> pa.RecordBatch:
            cols = list(zip(*done))
            out = pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(cols, fields)], names=[n for n, _ in fields])
            done.clear()
            return out

        fields = [c.split() for c in INDEX.split(", ")]
        types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
        for batch in batches:
            # a payload at a time: the batch's buffers hold them, no second copy of all
            for p, url, body, resp in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                kind, record = encode_record(p, url, body.as_py(), resp)
                if held and len(plain) + len(record) > frame_bytes:
                    flush()
                held.append((p, kind, len(plain), len(record)))
                plain.extend(record)
            if done:
                yield index()
        flush()
        close()
        if done:
            yield index()

    rows.mapInArrow(write, INDEX).write.parquet(f"{out_dir}/index")
    return pages.sparkSession.read.schema(INDEX).parquet(f"{out_dir}/index")


#: Compressed bytes of a bundle that a task reads back, and tasks at most (a task takes several slices then).
SLICE_BYTES = 32 << 20
MAX_TASKS = 50_000

RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _read_frame(f, offset: int, size: int) -> bytes:
    import zstandard

    f.seek(offset)
    return zstandard.ZstdDecompressor().decompress(f.read(size))


def read_bundles(spark: SparkSession, out_dir: str, index: DataFrame | None = None, payloads: bool = False) -> DataFrame:
    """Every record of the bundles that the index names, read back from the bytes.

    Responses are measured from their own block, and the digest in the header
    must match it. A revisit's figures are those its headers hold. The unit of
    work is a slice of a bundle, whole frames that its footer locates; there are
    as many tasks as slices.
    """
    index = index if index is not None else spark.read.schema(INDEX).parquet(f"{out_dir}/index")
    slices = index.select("bundle", F.expr(f"frame_offset div {SLICE_BYTES}").alias("slice")).distinct()
    n = min(max(1, slices.count()), MAX_TASKS)

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        fs, root = _open(out_dir)
        for batch in batches:
            for name, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_file(f"{root}/{name}") as f:
                    for offset, size, _ in read_seek_table(f, f.size()):
                        if offset // SLICE_BYTES == at:
                            rows = [_row(head, block, payloads) for _, head, block in parse_records(_read_frame(f, offset, size))]
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[c.split()[0] for c in RECORDS.split(", ")])

    # by number and not by key: neither joined with the distinct's exchange nor shrunk
    return slices.repartition(n).mapInArrow(read, RECORDS)


def _row(head: dict[str, str], block: bytes, payloads: bool) -> tuple:
    http, _, body = block.partition(b"\r\n\r\n")
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    n = int(re.search(rb"(?i)^Content-Length: (\d+)", http, re.M)[1])
    kind = head["warc-type"]
    if kind == "response" and (len(body) != n or base64.b32encode(hashlib.sha1(body).digest()).decode() != digest):
        raise ValueError(f"record {head['warc-record-id']} does not match its digest")
    return page_of(head["warc-record-id"]), n, digest, kind, page_of(head.get("warc-refers-to")), body if payloads and kind == "response" else None


def read_record(out_dir: str, bundle: str, frame_offset: int, frame_size: int, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record by its index row: one ranged read, one frame decoded."""
    fs, root = _open(out_dir)
    with fs.open_input_file(f"{root}/{bundle}") as f:
        data = _read_frame(f, frame_offset, frame_size)
    _, head, block = next(parse_records(data[offset : offset + length]))
    return head, block
