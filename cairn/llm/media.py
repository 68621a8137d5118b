"""Media columns: content-defined chunking, deduplicated chunk store, verified reconstruction.

A rolling gear hash (each byte's random number is added to the hash shifted by one bit) over the last 32 bytes is computed for a
whole batch by doubling. A payload is cut where the hash's high bits are zero, with least and greatest chunk lengths; so
equal passages give equal chunks wherever they stand. Chunks are named by their SHA-256 digest. The owner of a
chunk is the least (id, digest of the payload, place) that has it; the store keeps each chunk once, compressed. A payload is its ordered
list of chunks. ``reconstruct`` joins the lists with the store, expands, concatenates and compares the digest of the whole.

``media_chunks`` puts every payload together as well: the store's chunks go to the payloads whose lists name them, are expanded,
compared with their names and joined in order, and the digest of the whole is compared. Which row owns a chunk is found from the lists
alone, and a chunk is stored where its owner is put together; so the bytes cross the network once, and only chunks that occur again
go from their owner to the other places that name them.

A null payload has a null list; an empty one has an empty list and is verified by its digest. Rows with equal ids are one
medium each only if the ids are distinct: repeated ids are told apart by the payload's digest, so exact repeats count once
and others are media of their own; a null id is an id. Ties: equal chunks of one payload belong to the first place. Payloads are chunked
whole; very long ones are hashed in blocks, beside the payload itself nothing of its size is held. An empty table gives an empty result.
Of the frame only key and payload are read, whatever its other columns are called.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.llm import common, textops
from cairn.session import by_ids, stored

LEAST, AVERAGE_BITS, GREATEST = 512, 11, 16_384
WINDOW = 32
#: Bytes that are hashed in one pass; compression level of chunks.
BLOCK, LEVEL = 1 << 20, 9
PRIME = (1 << 127) - 1
#: Rows that meet where a payload is put together: its list, chunks that it owns, chunks of others.
LISTED, OWN, OTHERS = 0, 1, 2
_GEAR = np.append(textops.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) & np.uint64(0xFFFFFFFF), 0).astype(np.uint32)


def gear(symbols: np.ndarray) -> np.ndarray:
    """Rolling gear hash over the last WINDOW symbols at every place; symbol 256 counts nothing."""
    h, width = _GEAR[symbols], 1
    while width < WINDOW:
        shifted = np.zeros_like(h)
        shifted[width:] = h[:-width] << np.uint32(width)
        h = h + shifted
        width *= 2
    return h


def cut_places(payloads: list[bytes], bits: int) -> np.ndarray:
    """Places in the concatenation of the payloads, WINDOW empty symbols after each, behind which the hash allows a cut."""
    gap = np.full(WINDOW, 256, np.uint16)
    hash_ = gear(np.concatenate([x for p in payloads for x in (np.frombuffer(p, np.uint8), gap)]))
    return np.flatnonzero((hash_ >> np.uint32(32 - bits)) == 0) + 1  # high bits depend on the whole window


def chunk_ends(payloads: list[bytes], least: int = LEAST, bits: int = AVERAGE_BITS, greatest: int = GREATEST) -> list[list[int]]:
    """For each payload the ends of its chunks, the last being its length."""
    small = [p for p in payloads if len(p) <= BLOCK]
    cuts, at = cut_places(small, bits) if small else np.zeros(0, np.int64), 0
    out = []
    for p in payloads:
        if len(p) <= BLOCK:
            mine = (cuts[np.searchsorted(cuts, at + 1) : np.searchsorted(cuts, at + len(p))] - at).tolist()
            at += len(p) + WINDOW
        else:  # in blocks, each with the window before it
            mine = []
            for a in range(0, len(p), BLOCK):
                before = min(a, WINDOW)
                found = cut_places([p[a - before : a + BLOCK]], bits) + (a - before)
                mine += [x for x in found.tolist() if a < x <= a + BLOCK and x < len(p)]
        ends, last, i = [], 0, 0
        while last < len(p):
            while i < len(mine) and mine[i] < last + least:
                i += 1
            if i < len(mine) and mine[i] <= last + greatest:
                end = mine[i]
            else:
                end = min(last + greatest, len(p))
            ends.append(end)
            last = end
        out.append(ends)
    return out


def fingerprint(data: bytes, before: int = 0) -> int:
    """The bytes, behind those whose fingerprint is ``before``, as one number modulo the prime."""
    for a in range(0, len(data), BLOCK):
        part = data[a : a + BLOCK]
        before = joined(before, int.from_bytes(part, "big") % PRIME, len(part))
    return before


def joined(x: int, y: int, length: int) -> int:
    """The fingerprint of what has x followed by what has y, which is ``length`` bytes long."""
    return (x * pow(256, length, PRIME) + y) % PRIME


_LIST = pa.schema([("id", pa.int64()), ("whole", pa.binary()), ("size", pa.int64()), ("place", pa.int32()), ("digest", pa.binary()), ("length", pa.int32())])
_LIST_DDL = "id long, whole binary, size long, place int, digest binary, length int"


def _media(media: DataFrame, key: str, payload: str) -> DataFrame:
    return media.select(F.col(key).cast("long").alias("id"), F.col(payload).cast("binary").alias("payload")).where(F.col("payload").isNotNull())


def _payloads(batches, bits: int):
    """Lists of (id, payload, ends of its chunks), of about 2 MB."""
    for batch in batches:
        ids, payloads = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for a, b in textops.passes(payloads, 2_000_000):
            yield list(zip(ids[a:b], payloads[a:b], chunk_ends(payloads[a:b], bits=bits)))


def _record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def chunk_lists(media: DataFrame, key: str, payload: str, bits: int = AVERAGE_BITS) -> DataFrame:
    """One row a chunk: id, digest and size of the payload, place, digest and length of the chunk; place -1 for empty payloads."""

    def run(batches):
        for part in _payloads(batches, bits):
            rows = []
            for i, p, ends in part:
                whole = hashlib.sha256(p).digest()
                for k, (a, b) in enumerate(zip([0, *ends], ends)):
                    rows.append((i, whole, len(p), k, hashlib.sha256(p[a:b]).digest(), b - a))
                if not ends:
                    rows.append((i, whole, 0, -1, None, 0))
            yield _record(rows, _LIST)

    return _media(media, key, payload).mapInArrow(run, _LIST_DDL)


def owned(lists: DataFrame) -> DataFrame:
    """The lists with ``mine``: whether the row is the chunk's owner, the least (id, whole, place) of those with its digest."""
    place = F.struct("id", "whole", "place")
    return lists.withColumn("mine", F.col("digest").isNotNull() & (F.min(place).over(W.partitionBy("digest")) == place))


def chunk_rows(media: DataFrame, key: str, payload: str, bits: int = AVERAGE_BITS) -> DataFrame:
    """(digest, data, owner): chunks, compressed, with the least (id, whole, place) that a task has seen.

    A task sends a chunk once, and again only if a lesser owner turns up. So the row of the least owner of all is among them, and a
    chunk that very many media share is reduced before any shuffle.
    """
    schema = pa.schema([("digest", pa.binary()), ("data", pa.binary()), ("id", pa.int64()), ("whole", pa.binary()), ("place", pa.int32())])

    def run(batches):
        compress = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=True).compress
        least: dict[bytes, tuple] = {}
        for part in _payloads(batches, bits):
            rows = []
            for i, p, ends in sorted(part, key=lambda r: (r[0] is not None, r[0] or 0)):
                whole = hashlib.sha256(p).digest()
                for k, (a, b) in enumerate(zip([0, *ends], ends)):
                    c = p[a:b]
                    digest, mine = hashlib.sha256(c).digest(), (i is not None, i or 0, whole, k)
                    known = least.get(digest)
                    if known is None or mine < known:
                        least[digest] = mine
                        rows.append((digest, compress(c), i, whole, k))
            yield _record(rows, schema)
        textops.tidy()

    found = _media(media, key, payload).mapInArrow(run, "digest binary, data binary, id long, whole binary, place int")
    return found.select("digest", "data", F.struct("id", "whole", "place").alias("owner"))


def chunk_store(media: DataFrame, key: str, payload: str, bits: int = AVERAGE_BITS) -> DataFrame:
    """(digest, data, owner): each chunk once, compressed. The owner is (id, whole, place)."""
    return chunk_rows(media, key, payload, bits).groupBy("digest").agg(F.first("data").alias("data"), F.min("owner").alias("owner"))


def _lists(media: DataFrame, key: str, payload: str, bits: int) -> DataFrame:
    common.bounded_batches()
    return stored(owned(chunk_lists(media, key, payload, bits)), "lists")


def chunk(media: DataFrame, key: str, payload: str, bits: int = AVERAGE_BITS) -> tuple[DataFrame, DataFrame]:
    """The store (a plan: write it as a table to keep it), and the stored lists."""
    lists = _lists(media, key, payload, bits)
    return chunk_store(media, key, payload, bits), lists


def reconstruct(store: DataFrame, lists: DataFrame) -> DataFrame:
    """(id, whole, payload, verified): the payloads, put together from the chunks; verified if the digest is the expected one."""
    schema = pa.schema([("id", pa.int64()), ("whole", pa.binary()), ("payload", pa.binary()), ("verified", pa.bool_())])

    def put(table: pa.Table) -> pa.Table:
        places, data, expand = table.column("place").to_numpy(), table.column("data").to_pylist(), zstandard.ZstdDecompressor().decompress
        first = np.unique(places, return_index=True)[1]  # in order, repeated rows once
        p = b"".join(expand(data[i]) for i in first if data[i] is not None)
        whole = table.column("whole")[0].as_py()
        return pa.table({"id": [table.column("id")[0].as_py()], "whole": [whole], "payload": [p], "verified": [hashlib.sha256(p).digest() == whole]}, schema=schema)

    return lists.select("id", "whole", "place", "digest").join(store.select("digest", "data"), "digest", "left").groupBy("id", "whole").applyInArrow(put, "id long, whole binary, payload binary, verified boolean")


def assembled(store: DataFrame, lists: DataFrame) -> DataFrame:
    """(id, whole, bytes, n_chunks, new_bytes, chunks, verified) of all media, put together from the store's chunks.

    A chunk goes from the store to its owner, and to the other places that name it by a join of these few by digest; the store may be
    ``chunk_rows``, of which a list takes its owner's. ``verified``: every chunk has the digest that the list names, and the payload that
    they give in order has the list's size and digest. A task streams its media; only the current one is held.
    """
    schema = pa.schema([("id", pa.int64()), ("whole", pa.binary()), ("bytes", pa.int64()), ("n_chunks", pa.int64()), ("new_bytes", pa.int64()), ("chunks", pa.list_(pa.string())), ("verified", pa.bool_())])

    def put(batches):
        expand = zstandard.ZstdDecompressor().decompress
        now, head, names, parts, new, at, wanted = None, None, [], [], 0, -2, None

        def close() -> list[tuple]:
            if head is None:  # chunks of a medium that has no list
                return []
            i, whole, size = head
            p = b"".join(parts)
            return [(i, whole, size, len(names), new, names, len(p) == size and hashlib.sha256(p).digest() == whole)]

        for batch in batches:
            out: list[tuple] = []
            for i, k, place, kind, whole, size, digest, length, mine, data in zip(*(batch.column(j).to_pylist() for j in range(10))):
                if (i, k) != now:
                    if now is not None:
                        out += close()
                    now, head, names, parts, new, at, wanted = (i, k), None, [], [], 0, -2, None
                if kind == LISTED:
                    if head is None:
                        head = (i, whole, size)
                    if place >= 0 and place != at:  # repeated rows count once
                        names.append(digest.hex())
                        parts.append(b"")
                        new += length if mine else 0
                        wanted = (OWN if mine else OTHERS, digest)
                    at = place
                elif place == at and wanted is not None and kind == wanted[0]:  # the store's chunk for this place
                    try:
                        c = expand(data)
                    except zstandard.ZstdError:
                        continue
                    if hashlib.sha256(c).digest() == wanted[1]:
                        parts[-1], wanted = c, None
            yield _record(out, schema)
        if now is not None:
            yield _record(close(), schema)
        textops.tidy()

    def rows(df: DataFrame, kind: int, data) -> DataFrame:
        """Rows of one kind; what belongs to the payload travels with its first chunk only, names with the lists only."""
        head = F.lit(kind == LISTED) & (F.col("place") <= 0)
        listed = [F.when(head, F.col(c)).alias(c) for c in ("whole", "size")] + [F.col(c) for c in ("digest", "length", "mine")]
        none = [F.lit(None).cast(t).alias(c) for c, t in (("whole", "binary"), ("size", "long"), ("digest", "binary"), ("length", "int"), ("mine", "boolean"))]
        return df.select("id", F.xxhash64("whole").alias("key"), "place", F.lit(kind).alias("kind"), *(listed if kind == LISTED else none), data.alias("data"))

    name = F.xxhash64("digest").alias("name")
    again = lists.where(~F.col("mine") & F.col("digest").isNotNull())
    # a superset by the names' hashes, then by the digests themselves
    shared = by_ids(store.select("digest", "data", name), again.select(name).distinct(), "name", "left_semi").groupBy("digest").agg(F.first("data").alias("data"))
    own = store.select("owner.*", "data")
    parts = rows(lists, LISTED, F.lit(None).cast("binary")).union(rows(own, OWN, F.col("data"))).union(rows(again.join(shared, "digest"), OTHERS, F.col("data")))
    return parts.repartition("id", "key").sortWithinPartitions("id", "key", "place", "kind").mapInArrow(put, "id long, whole binary, bytes long, n_chunks long, new_bytes long, chunks array<string>, verified boolean")


def media_chunks(media: DataFrame, key: str, payload: str, bits: int = AVERAGE_BITS) -> DataFrame:
    """(id, bytes, n_chunks, new_bytes, chunks, verified) of every medium.

    ``new_bytes``: of the chunks whose owner it is; ``chunks``: hexadecimal digests in order. A null payload has nulls.
    """
    lists = _lists(media, key, payload, bits)
    done = assembled(chunk_rows(media, key, payload, bits), lists).drop("whole")
    nulls = media.where(F.col(payload).isNull()).select(F.col(key).cast("long").alias("id"), *[F.lit(None).cast(t).alias(c) for c, t in (("bytes", "long"), ("n_chunks", "long"), ("new_bytes", "long"), ("chunks", "array<string>"), ("verified", "boolean"))])
    return done.union(nulls)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' payloads as fetched (their HTML as bytes)."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return media_chunks(pages, "page_id", "html").withColumnRenamed("id", "page_id")
