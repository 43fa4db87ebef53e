"""WARC archives: written by Spark's text writer, read back by boundary-chain verification.

Writing. A record ends with CR LF CR LF; rows hold a record up to its last byte, and the writer's line separator is
that byte. So Spark's own writer (any file system, committed as a whole, tasks may be lost) makes valid WARC 1.1 files.
Of records with equal payloads of at least REVISIT_FROM bytes, that with the largest page_id is stored (response); the
others are revisits, which name it and carry no payload.

Reading. The files are split at each magic line, wherever it stands. Each split begins a candidate record, whose headers tell
where its successor begins. Within a block of the file a task follows candidates to the first successor beyond the block.
Chains of blocks are then joined by pointer jumping from the file's start. Only what this chain reaches is a record; a
magic line inside a payload begins none, even if well-formed headers follow it, and its bytes go back to the payload.

Headers may be of any length, and a magic line may stand among them (as in a url of a foreign archive): they are read up to their
blank line, into the next block if need be. Headers that go on over a whole block of the file begin no record.

Defined results. Null html: an empty payload. Null url: no target. Null page_id: a record without an id; if one
of equal payload has an id it revisits that, else it is stored, as it can't be named. Rows with equal page_id and payload: all of them
response or revisit alike. Very long html: one record, in pieces of a block's size when it is read. Extra columns, whatever
their names: left out.
Blanks, control characters and line separators in a url are percent-encoded, and the last byte of one that ends in the magic.
Empty table: no records. A file whose chain of records ends before the file does (cut off, or not an archive) is an error, so
that nothing is lost in silence; with strict=False what the chain reaches is read.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, written

#: Fixed values of the format.
MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of fewer bytes are always stored.
REVISIT_FROM = 1000
_DATE = "2020-01-01T00:00:00Z"
#: Characters that a header can't hold as they are.
_ODD = r"[\x00-\x20\x7F\u0085\u2028\u2029]"


def with_revisits(pages: DataFrame, least: int = REVISIT_FROM) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, refers_to) of every page."""
    html = F.coalesce(pages["html"].cast("string"), F.lit(""))
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha1(F.col("html").cast("binary")))
    large = rows.where(F.col("payload_bytes") >= least)
    # only payloads that occur more than once: a few narrow rows
    kept = large.groupBy("payload_digest").agg(F.max("page_id").alias("target"), F.count("*").alias("n")).where("n > 1 and target is not null").select("payload_digest", "target")
    kept = written(kept, "revisits")
    out = rows.join(kept, "payload_digest", "left")
    revisit = (F.col("payload_bytes") >= least) & F.col("target").isNotNull() & F.coalesce(F.col("page_id") < F.col("target"), F.lit(True))
    return out.select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when(revisit, F.col("target")).alias("refers_to"))


def encoded(url: Column) -> Column:
    """A url as a header can hold it."""
    each = F.transform(F.split(url, ""), lambda c: F.when(c.rlike(_ODD), F.regexp_replace(F.hex(c.cast("binary")), "(..)", "%$1")).otherwise(c))
    return F.regexp_replace(F.when(url.rlike(_ODD), F.concat_ws("", each)).otherwise(url), r"WARC/1\.1$", "WARC/1.%31")


def records(pages: DataFrame, least: int = REVISIT_FROM) -> DataFrame:
    """(record): the text of each page's record, without its last byte."""
    rows = with_revisits(pages, least)
    is_revisit = F.col("refers_to").isNotNull()
    url = encoded(F.col("url"))
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    head = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(is_revisit, "revisit").otherwise("response"), F.lit("\r\n"),
        line("WARC-Record-ID", urn(F.col("page_id"))), line("WARC-Target-URI", url), F.lit(f"WARC-Date: {_DATE}\r\n"),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest"), F.lit("\r\n"),
        line("WARC-Refers-To", urn(F.col("refers_to"))), F.when(is_revisit, F.lit(f"WARC-Profile: {PROFILE}\r\n")).otherwise(""),
        F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.when(is_revisit, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string"), F.lit(END),
    )
    return rows.select(F.concat(head, F.when(is_revisit, "").otherwise(F.col("html")), F.lit(END[:-1])).alias("record"))


def write(pages: DataFrame, path: str, least: int = REVISIT_FROM) -> None:
    """Archives of all pages under path, a file for each task."""
    records(pages, least).write.option("lineSep", END[-1]).text(path)


_LENGTH = re.compile(rb"(?i)(?:\A|\r\n)content-length:[ \t]*(\d+)[ \t]*\r\n")
_M = len(MAGIC)


def _head(piece: bytes) -> tuple[int | None, int | None]:
    """Where headers that run into this piece end in it (behind their blank line), and the first Content-Length before that."""
    if piece[:2] == b"\r\n":
        return 2, None
    at = piece.find(b"\r\n\r\n")
    found = _LENGTH.search(piece, 0, at + 2 if at >= 0 else len(piece))
    return at + 4 if at >= 0 else None, int(found[1]) if found else None


def _beyond(end: int, length: int) -> int:
    """The place behind the magic line of the successor of a record whose headers end here."""
    return end + length + len(END) + _M


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, n, piece): what stands between magic lines. n orders the pieces of a block of the file."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), F.col("value").cast("binary").alias("piece"))


def _runs(batches, keys: int):
    """(key, pieces) for runs of rows that are equal in the first columns; the last column holds the pieces."""
    for batch in batches:
        rows = list(zip(*[batch.column(k).to_pylist() for k in range(keys)], strict=True))
        at = 0
        while at < len(rows):
            upto = at
            while upto < len(rows) and rows[upto] == rows[at]:
                upto += 1
            yield rows[at], batch.column(batch.num_columns - 1).slice(at, upto - at)
            at = upto


_SEEN = "file string, block long, start long, leave long, open boolean, length long, head_end long"


def _survey(batches):
    """Of each block its size, and from each candidate in it the first successor's place that lies beyond the block.

    Places count from the block's first piece and are those of the bytes behind magic lines. A few numbers are held for each
    candidate of one block. The row of the block itself (start null) also tells where headers that run into it would end.
    """
    last, size, starts, leaves, bare, told, open_end, open_length = None, 0, [], [], [], [], None, None

    def rows():
        inside = {s: k for k, s in enumerate(starts)}
        for k in range(len(starts) - 1, -1, -1):
            beyond = leaves[inside[leaves[k]]] if leaves[k] in inside else None
            if beyond is not None:
                leaves[k] = beyond
        n, unended = len(starts), dict(told) | dict.fromkeys(bare)
        columns = [[last[0]] * (n + 1), [last[1]] * (n + 1), [*starts, None], [*leaves, size], [*(k in unended for k in range(n)), False], [*map(unended.get, range(n)), open_length], [None] * n + [open_end]]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "block", "start", "leave", "open", "length", "head_end"])

    for key, pieces in _runs(batches, 2):
        if key != last:
            if last is not None:
                yield rows()
            last, size, starts, leaves, bare, told, open_end, open_length = key, 0, [], [], [], [], None, None
        for piece in pieces:
            data = piece.as_buffer().to_pybytes() if piece.is_valid else b""
            end, length = _head(data)
            if open_end is None:
                open_length = length if open_length is None else open_length
                open_end = None if end is None else size + end
            bare.append(len(starts))
            starts.append(size)
            leaves.append(None)
            if length is not None:
                told += [(k, length) for k in bare]
                bare = []
            if end is not None:
                for k, n in told:
                    leaves[k] = _beyond(size + end, n)
                bare, told = [], []
            size += len(data) + _M
    if last is not None:
        yield rows()


def chain(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(file, block, base, first, entry, owner) of each block: its place in the file, where its first piece and its first record begin.

    entry is null if no record begins in the block; owner is the block where the record begins that what stands before entry
    belongs to. Pointer jumping doubles the reach of every candidate at each round, so the rounds are logarithmic in the blocks
    of a file.
    """
    seen = written(_pieces(spark, path).select("file", "block", "piece").mapInArrow(_survey, _SEEN), "candidates")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("file").orderBy("block").rowsBetween(1, 1)
    base = F.coalesce(F.sum("leave").over(earlier), F.lit(0))
    sizes = seen.where("start is null").select("file", "block", base.alias("base"), "leave", "length", "head_end")
    follows = F.first(F.struct((F.col("base") + F.col("head_end")).alias("end"), "length")).over(later)
    blocks = written(sizes.select("file", "block", "base", (F.col("base") + F.col("leave")).alias("upto"), follows.alias("next")), "blocks")
    placed = seen.where("start is not null").join(blocks, ["file", "block"])
    run_on = F.col("next.end") + F.coalesce("length", "next.length") + len(END) + _M
    leave = F.when(F.col("open"), run_on).otherwise(F.col("base") + F.col("leave"))
    placed = written(placed.select("file", "block", (F.col("base") + F.col("start")).alias("at"), leave.alias("to")), "placed")
    jumps = placed.where("to is not null").select("file", "at", "to")
    reached = written(blocks.where("block = 0").select("file", F.lit(_M).cast("long").alias("at")), "reached")
    count = reached.count()
    while True:
        more = written(reached.unionByName(reached.join(jumps, ["file", "at"]).select("file", F.col("to").alias("at"))).distinct(), "reached")
        if (now := more.count()) == count:
            break
        reached, count = more, now
        over = jumps.select("file", F.col("at").alias("to"), F.col("to").alias("beyond"))
        jumps = written(jumps.join(over, ["file", "to"], "left").select("file", "at", F.coalesce("beyond", "to").alias("to")), "jumps")
    if strict:
        ends = blocks.groupBy("file").agg(F.max("upto").alias("at"))
        broken = ends.join(reached, ["file", "at"], "left_anti").select("file").limit(3).collect()
        if broken:
            raise ValueError(f"the chain of records ends before the file does: {[r['file'] for r in broken]}")
    entries = placed.join(reached, ["file", "at"]).groupBy("file", "block").agg(F.min("at").alias("entry"))
    first = F.when(F.col("block") == 0, _M).otherwise(F.col("base")).cast("long")
    owner = F.last(F.when(F.col("entry").isNotNull(), F.col("block")), ignorenulls=True).over(earlier)
    return written(blocks.join(entries, ["file", "block"], "left").select("file", "block", "base", first.alias("first"), "entry", owner.alias("owner")), "chain")


_WHOLE = "head string, bytes binary"
_SPLIT = "file string, block long, place long, bytes binary"


def _cut(data: bytes) -> tuple[str, bytes]:
    at = data.find(b"\r\n\r\n")
    return data[:at].decode("utf-8", "replace"), data[at + 4 :]


def _batches(rows, schema: pa.Schema):
    """Record batches of rows, of bounded size."""
    out, held = [], 0
    for row in rows:
        out.append(row)
        held += len(row[-1])
        if held > 1 << 24 or len(out) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _records(whole: bool):
    """Follow the chain through each block, from its entry. Yields whole records, or else the parts of those split between blocks."""
    schema = pa.schema([("head", pa.string()), ("bytes", pa.binary())] if whole else [("file", pa.string()), ("block", pa.int64()), ("place", pa.int64()), ("bytes", pa.binary())])

    def rows(batches):
        last, place, due, now, rest, owner = None, 0, None, None, [], None

        def close():
            if rest and not whole and owner is not None:  # what stands before the block's first record
                yield last[0], owner, last[2], b"".join(rest)
            if now is not None:
                at, upto, _, parts = now
                data = b"".join(parts)
                if upto is not None and len(data) == upto - at - _M:
                    if whole:
                        yield _cut(data)
                elif not whole:
                    yield last[0], last[1], at, data

        for key, pieces in _runs(batches, 5):
            if key != last:
                yield from close()
                last, place, due, owner, now, rest = key, key[2], key[3], key[4], None, []
            for piece in pieces:
                data = piece.as_buffer().to_pybytes()
                if place == due and due is not None:
                    yield from close()
                    now, rest, due = [place, None, None, [data]], [], None
                elif now is not None:  # a magic line within the record
                    now[3].append(MAGIC.encode() + data)
                elif place > _M:
                    rest.append(MAGIC.encode() + data)
                if now is not None and now[1] is None:  # its headers haven't ended before
                    end, length = _head(data)
                    now[2] = length if now[2] is None else now[2]
                    if end is not None and now[2] is not None:
                        due = now[1] = _beyond(place + end, now[2])
                place += len(data) + _M
        yield from close()

    def run(batches):
        yield from _batches(rows(batches), schema)

    return run


def _joined(batches):
    """Split records put together: their parts in order. One whose end is missing gives nothing."""

    def rows():
        for batch in batches:
            for parts in batch.column(0):
                data = b"".join(p["bytes"].as_buffer().to_pybytes() for p in parts)
                head, body = _cut(data)
                _, length = _head(data)
                if length is not None and len(body) >= length:
                    yield head, body

    yield from _batches(rows(), pa.schema([("head", pa.string()), ("bytes", pa.binary())]))


#: Blocks up to which their table is broadcast (some 100 bytes each); beyond, the pieces are joined with it by a shuffle.
BROADCAST_BLOCKS = 100_000


def read(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload, payload_bytes, payload_digest) of every record of the archives under path.

    payload is null for revisits, whose payload_bytes and payload_digest are those of what they refer to.
    """
    blocks = chain(spark, path, strict)
    table = blocks.select("file", "block", "base", "entry", "owner")
    pieces = _pieces(spark, path)
    if blocks.count() <= BROADCAST_BLOCKS:
        rows = pieces.join(F.broadcast(table), ["file", "block"])
    else:
        rows = pieces.join(table, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "n")
    rows = rows.select("file", "block", "base", "entry", "owner", "piece")
    found = rows.mapInArrow(_records(True), _WHOLE)
    if not blocks.where("entry is null or entry > first").isEmpty():
        split = written(rows.mapInArrow(_records(False), _SPLIT), "split")
        parts = split.groupBy("file", "block").agg(F.sort_array(F.collect_list(F.struct("place", "bytes"))).alias("parts"))
        found = found.unionByName(parts.select("parts").mapInArrow(_joined, _WHOLE))
    field = lambda name: F.nullif(F.regexp_extract("head", rf"(?imd)^{name}:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1), F.lit(""))
    page = lambda name: F.regexp_extract(field(name), r"<urn:page:(-?\d+)>", 1).try_cast("long")
    revisit = field("WARC-Type") == "revisit"
    payload = F.substring("bytes", F.lit(1), field("Content-Length").cast("int"))
    parsed = found.select(page("WARC-Record-ID").alias("page_id"), field("WARC-Target-URI").alias("url"), field("WARC-Type").alias("record_type"), page("WARC-Refers-To").alias("refers_to"), F.when(~revisit, payload).alias("payload"), field("X-Payload-Length").cast("long").alias("told_bytes"), F.regexp_extract(field("WARC-Payload-Digest"), "sha1:([0-9a-f]{40})", 1).alias("told_digest"))
    return parsed.select("page_id", "url", "record_type", "refers_to", "payload", F.coalesce(F.octet_length("payload").cast("long"), "told_bytes").alias("payload_bytes"), F.coalesce(F.sha1("payload"), "told_digest").alias("payload_digest"))


def round_trip(pages: DataFrame, least: int = REVISIT_FROM) -> DataFrame:
    """Write archives of all pages into the shared folder and read them back."""
    path = fresh_path(pages.sparkSession, "warc")
    write(pages, path, least)
    return read(pages.sparkSession, path)
