"""Encoding of a whole corpus with a public tokenizer by a global shuffle of its distinct words.

Texts are cut into words with positions, chunk by chunk.  What a chunk keeps is its skeleton: the sequence of word
numbers, that is, every position.  Only the chunk's distinct words travel to the place of the word, where each is
encoded once, and their ids travel back to the chunk, where the texts are put together by position.  A frequent word
thus travels once a chunk, not once an occurrence, and neither shuffle carries a text.  The words that a chunk has for
one place are packed into one row, so that the work of moving rows does not grow with the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .units import TOKENIZERS, ByteUnits, cut, tokenizer

#: Bytes of text in a chunk (a longer text is a chunk of its own).
CHUNK_BYTES = 2 << 20
#: Words of which a task remembers the ids.
REMEMBERED = 1_000_000
#: Places of words, at the least and per shuffle partition.  The words of a chunk at one place travel as one row.
PLACES, PLACES_PER_PARTITION = 64, 4
_MOVED = pa.schema([("chunk", pa.int64()), ("place", pa.int32()), ("spread", pa.int32()), ("docs", pa.list_(pa.int64())), ("body", pa.large_binary())])
_MOVED_DDL = "chunk bigint, place int, spread int, docs array<bigint>, body binary"
_SKELETON = -1


def pieces_of(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with at most limit bytes of text (or one row)."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        base = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _packed(lengths: np.ndarray, body: bytes) -> bytes:
    """Items laid end to end, with their lengths before them."""
    return np.int64([len(lengths)]).tobytes() + lengths.astype("<i4").tobytes() + body


def _unpacked(pack: bytes) -> tuple[np.ndarray, bytes]:
    n = int(np.frombuffer(pack, np.int64, 1)[0])
    return np.frombuffer(pack, "<i4", n, 8), pack[8 + 4 * n :]


def _take_apart(places: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard
        from pyspark import TaskContext

        squeeze = zstandard.ZstdCompressor(level=1)
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in pieces_of(batch, "text"):
                forms, codes, counts = cut(part.column("text"))
                used, codes = np.unique(codes, return_inverse=True)
                words = [forms[i] for i in used]
                # words are numbered in order of their places, so that the numbers need not travel
                place = np.fromiter((xxhash.xxh3_64_intdigest(w) % places for w in words), np.int64, len(words))
                order = np.argsort(place, kind="stable")
                number = np.empty(len(words), np.int64)
                number[order] = np.arange(len(words))
                laid = pa.array([words[i] for i in order], pa.large_string())
                offsets, text = np.frombuffer(laid.buffers()[1], np.int64, len(words) + 1), laid.buffers()[2]
                text = b"" if text is None else text.to_pybytes()
                used_places, first = np.unique(place[order], return_index=True)
                edges = np.r_[first, len(words)]
                packs = [_packed(np.diff(offsets[i : j + 1]), text[offsets[i] : offsets[j]]) for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                skeleton = np.int64([len(counts)]).tobytes() + counts.astype("<i4").tobytes() + number[codes].astype("<u2" if len(words) < 65536 else "<u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(packs) + 1, chunk)),
                        pa.array(np.r_[used_places, _SKELETON].astype(np.int32)),
                        pa.array(np.r_[used_places, (chunk + (chunk >> 32)) % places].astype(np.int32)),  # skeletons go anywhere
                        pa.array([None] * len(packs) + [part.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                        pa.array([*packs, squeeze.compress(skeleton)], pa.large_binary()),
                    ],
                    schema=_MOVED,
                )
                chunk += 1

    return run


def _encode_words(name: str, folder: str, width: str):
    """Packs of words to packs of their ids; a word is encoded once, and again only if the task has met REMEMBERED others since."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = None, {}
        size = np.dtype(width).itemsize
        for b in batches:
            bodies = b.column("body").to_pylist()
            for i, place in enumerate(b.column("place").to_pylist()):
                if place == _SKELETON:
                    continue
                lengths, text = _unpacked(bodies[i])
                ends = np.cumsum(lengths).tolist()
                found, at = [], 0
                for end in ends:
                    w = text[at:end]
                    at = end
                    ids = known.get(w)
                    if ids is None:
                        own = own or tokenizer(name, folder)
                        if len(known) >= REMEMBERED:
                            known.clear()
                        ids = known[w] = np.asarray(own.ids(w.decode()), width).tobytes()
                    found.append(ids)
                bodies[i] = _packed(np.fromiter(map(len, found), np.int64, len(found)) // size, b"".join(found))
            yield pa.RecordBatch.from_arrays([b.column("chunk"), b.column("place"), b.column("docs"), pa.array(bodies, pa.large_binary())], ["chunk", "place", "docs", "body"])

    return run


def _put_together(width: str):
    def run(group: pa.Table) -> pa.Table:
        import zstandard

        order = np.argsort(group.column("place").to_numpy(), kind="stable")  # the skeleton first
        bodies = group.column("body").to_pylist()
        skeleton, packs = zstandard.ZstdDecompressor().decompress(bodies[order[0]]), [_unpacked(bodies[i]) for i in order[1:]]
        docs = group.column("docs").take(pa.array(order[:1])).to_pylist()[0]
        lengths = np.concatenate([np.zeros(0, np.int64), *(n for n, _ in packs)]).astype(np.int64)
        n = int(np.frombuffer(skeleton, np.int64, 1)[0])
        counts = np.frombuffer(skeleton, "<i4", n, 8).astype(np.int64)
        codes = np.frombuffer(skeleton, "<u2" if len(lengths) < 65536 else "<u4", offset=8 + 4 * n).astype(np.int64)
        flat = np.frombuffer(b"".join(ids for _, ids in packs), width).astype(np.int32)
        starts = np.cumsum(lengths) - lengths
        each = lengths[codes]
        ends = np.cumsum(each)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(starts[codes] - (ends - each), each) + np.arange(total)]
        edges = np.r_[0, ends][np.r_[0, np.cumsum(counts)]]
        return pa.table({"doc_id": pa.array(docs, pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids))})

    return run


def encode_corpus(docs: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, ids array<int>), one row for each row of docs, without special tokens.

    A null or empty text has an empty list; rows with a null or repeated doc_id stay rows; only doc_id and text are read.
    Strings of special tokens are ordinary text.  folder holds the tokenizer files on every machine.
    """
    places = max(PLACES, PLACES_PER_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_take_apart(places), _MOVED_DDL)
    width = "<u2" if tokenizer(name, folder).size <= 65536 else "<i4"  # of an id while it travels
    encoded = parts.repartition("spread").mapInArrow(_encode_words(name, folder, width), "chunk bigint, place int, docs array<bigint>, body binary")
    return encoded.groupBy("chunk").applyInArrow(_put_together(width), "doc_id bigint, ids array<int>")


def token_bytes(spark, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(id, bytes) of a byte-level vocabulary; its size is fixed by the tokenizer (50,256 rows)."""
    ranks = ByteUnits(name, folder).encoding._mergeable_ranks
    return spark.createDataFrame([(i, bytearray(b)) for b, i in ranks.items()], "id int, bytes binary")


def decode_corpus(encoded: DataFrame, tokens: DataFrame) -> DataFrame:
    """(doc_id, text): ids joined with the token table and put together by position; an empty list gives an empty text.

    doc_id must be unique; a null list gives a null text.  Ids outside the table are left out.
    """
    at = encoded.select("doc_id", F.posexplode_outer("ids").alias("pos", "id"), F.col("ids").isNull().alias("none"))
    # the token table has the fixed size of a vocabulary
    found = at.join(F.broadcast(tokens.withColumnRenamed("bytes", "_bytes")), "id", "left")
    held = found.groupBy("doc_id").agg(F.max("none").alias("none"), F.sort_array(F.collect_list(F.when(F.col("_bytes").isNotNull(), F.struct("pos", F.hex("_bytes").alias("h"))))).alias("parts"))
    return held.select("doc_id", F.when(~F.col("none"), F.decode(F.unhex(F.array_join(F.transform("parts", lambda p: p["h"]), "")), "UTF-8")).alias("text"))
