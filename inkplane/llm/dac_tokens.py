"""Token ids as directly addressable codes.

An id is split into chunks of CHUNK bits, low chunk first. Level k holds the k-th chunk of every id that has one, a byte
each, and a bitmap that tells which of them go on; a rank directory holds the number of ones before each block of the
bitmap. The i-th id is read from a segment by one byte a level: where the bit says it goes on, its place on the next
level is the rank of the bit. No block is decoded for it.

Tasks take ranges of doc_id, encode whole texts and write segments, which are rows of Parquet files: first and last
document, counts, and the bytes of the segment. Files are committed by Spark, so a task that is run again leaves one
copy. Segments stand in ascending order by (part, seq).

Defined results: a null text is empty and has the end id alone; a null doc_id stands first; rows of one doc_id stand
in the order of a hash of their text; an empty table gives no segments; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkplane.llm.common import row_key, shared_dir, stored, worker_cache

MAGIC, CHUNK, BLOCK = b"DAC1", 8, 512
END_ID = 1
#: Ids of a segment, but for a longer document; words that a worker remembers the ids of; texts encoded at a time.
SEGMENT_IDS, REMEMBERED, AT_ONCE = 1 << 20, 400_000, 4096
SEGMENTS = "part int, seq int, doc_ids array<bigint>, n_ids bigint, content binary"
#: Words that the tokenizer's rules cut at letters, single digits and runs of other signs, and nowhere else.
_PIECE = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[!-&(-/:-;=-@\[-`{-~]+")
_ITEM, _SIMPLE = re.compile(_PIECE.pattern + "| "), rf"\A(?:{_PIECE.pattern})+\z"

#: str.split() also cuts at these; the tokenizer's rules do not.
_NO_SPACE = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def split(text: str) -> list[str]:
    """The text's words between white space, as the tokenizer takes it."""
    return [w for w in _SPACE.split(text) if w] if _NO_SPACE.search(text) else text.split()


def pack(ids: np.ndarray, doc_lengths: np.ndarray) -> bytes:
    """A segment: magic, number of documents and levels, lengths, then for each level its size, chunks, bitmap, ranks."""
    levels, rest = [], ids.astype(np.uint64)
    while True:
        goes_on = rest >> CHUNK > 0
        bits = np.packbits(goes_on, bitorder="little")
        ones = np.add.reduceat(goes_on, np.arange(0, len(goes_on), BLOCK), dtype=np.uint32) if len(goes_on) else np.empty(0, np.uint32)
        ranks = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u4") if len(ones) else ones
        levels.append(struct.pack("<Q", len(rest)) + (rest & (2**CHUNK - 1)).astype(np.uint8).tobytes() + bits.tobytes() + ranks.tobytes())
        rest = rest[goes_on] >> CHUNK
        if not len(rest):
            break
    return MAGIC + struct.pack("<II", len(doc_lengths), len(levels)) + doc_lengths.astype("<u8").tobytes() + b"".join(levels)


class Segment:
    """A packed segment, read in place."""

    def __init__(self, content: bytes):
        if content[:4] != MAGIC:
            raise ValueError("not a segment")
        docs, levels = struct.unpack_from("<II", content, 4)
        self.lengths, at = np.frombuffer(content, "<u8", docs, 12), 12 + 8 * docs
        self.levels = []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", content, at)
            chunks, at = np.frombuffer(content, np.uint8, n, at + 8), at + 8 + n
            bits, at = np.frombuffer(content, np.uint8, -(-n // 8), at), at + -(-n // 8)
            ranks, at = np.frombuffer(content, "<u4", -(-n // BLOCK), at), at + 4 * -(-n // BLOCK)
            self.levels.append((chunks, bits, ranks))

    def __getitem__(self, i: int) -> int:
        """The i-th id, by one chunk and at most one rank a level."""
        out = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            out |= int(chunks[i]) << CHUNK * k
            if not bits[i >> 3] >> (i & 7) & 1:
                return out
            first = i // BLOCK * BLOCK // 8
            i = int(ranks[i // BLOCK]) + int(np.bitwise_count(bits[first : i >> 3]).sum()) + (int(bits[i >> 3]) & (1 << (i & 7)) - 1).bit_count()
        raise ValueError("an id goes on beyond the last level")

    def ids(self) -> np.ndarray:
        """All ids."""
        out, at = None, None
        for k, (chunks, bits, _) in enumerate(self.levels):
            if out is None:
                out, at = chunks.astype(np.uint32), np.arange(len(chunks))
            else:
                out[at] |= chunks.astype(np.uint32) << np.uint32(CHUNK * k)
            at = at[np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)]
        return out


def gathered(flat: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs that stand one after the other in ``flat``, those named, one after the other; and the size of each."""
    n = size[which]
    stop = np.cumsum(n)
    places = np.repeat((np.cumsum(size) - size)[which] - (stop - n), n)
    return flat[places + np.arange(len(places))], n


class Encoder:
    """Whole texts to ids by the library. Words between white space are encoded apart, as its rules cut there anyway.

    A worker remembers words and the ids of all of them in one array, so that texts are put together by places in it.
    New words of plain letters, digits and signs are cut into the pieces that the rules make of them, in lower case
    where the library folds it, and pieces not yet known are handed to the library many at a time. Each ends in an id
    that ends a word, so their ids are told apart. Where the count does not come out, and for all other words, they are
    encoded one by one. Of too many words, those that were not met again are forgotten.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.ends = np.zeros(max(self.library.get_vocab().values()) + 1, bool)
        self.ends[[i for t, i in self.library.get_vocab().items() if t.endswith("</w>")]] = True
        #: Whether this library cuts words as _PIECE does, and takes capitals like small letters.
        probe = "Ab1é2.,c-É3x[]"
        self.cuts = self.one(probe) == b"".join(map(self.one, _PIECE.findall(probe)))
        self.folds = all(self.one(c) == self.one(c.lower()) for c in map(chr, range(0x100)) if c != c.lower())
        self.words, self.flat, self.size = pa.array(["", " "]), np.empty(0, "<u4"), np.zeros(2, np.int64)  # both without ids
        self.again = np.ones(2, bool)

    def one(self, word: str) -> bytes:
        return np.array(self.library.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def forget(self) -> None:
        kept = np.flatnonzero(self.again)
        kept = np.concatenate([[0, 1], kept[kept > 1][-REMEMBERED // 2 :]])
        self.words = self.words.take(pa.array(kept))
        self.flat, self.size = gathered(self.flat, self.size, kept)
        self.again = np.arange(len(kept)) < 2

    def recall(self, words: pa.Array) -> np.ndarray:
        """Places of words among those remembered, or -1."""
        return pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

    def add(self, words: pa.Array, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Remember words; their places."""
        start = len(self.words)
        self.words = pa.concat_arrays([self.words, words])
        self.flat, self.size = np.concatenate([self.flat, flat]), np.concatenate([self.size, size])
        self.again = np.concatenate([self.again, np.zeros(len(words), bool)])
        return np.arange(start, len(self.words))

    def add_singly(self, words: pa.Array) -> np.ndarray:
        ids = [self.one(w) for w in words.to_pylist()]
        return self.add(words, np.frombuffer(b"".join(ids), "<u4"), np.array([len(x) // 4 for x in ids], np.int64))

    def add_pieces(self, pieces: pa.Array) -> np.ndarray:
        places = []
        for i in range(0, len(pieces), 1000):
            part = pieces.slice(i, 1000)
            ids = np.array(self.library.encode_batch_fast([" ".join(part.to_pylist())], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            told = len(stops) == len(part) and stops[-1] == len(ids)
            places.append((part, ids, np.diff(stops, prepend=0)) if told else None)
        if all(places):
            return self.add(pieces, np.concatenate([x[1] for x in places]), np.concatenate([x[2] for x in places])) if places else np.empty(0, np.int64)
        return np.concatenate([self.add(*x) if x else self.add_singly(pieces.slice(1000 * i, 1000)) for i, x in enumerate(places)])

    def learn(self, words: pa.Array) -> np.ndarray:
        """Places of words that are not remembered, each given once; from now on they are."""
        plain = pc.match_substring_regex(words, _SIMPLE).to_numpy(zero_copy_only=False) & self.cuts
        out = np.empty(len(words), np.int64)
        out[~plain] = self.add_singly(words.filter(pa.array(~plain)))
        words = words.filter(pa.array(plain))
        text = "".join([w + " " for w in words.to_pylist()])
        items = pa.array(_ITEM.findall(text.lower() if self.folds else text), pa.string()).dictionary_encode()
        places = self.recall(items.dictionary)
        new = places < 0
        places[new] = self.add_pieces(items.dictionary.filter(pa.array(new)))
        which = places[items.indices.to_numpy(zero_copy_only=False)]
        flat, n = gathered(self.flat, self.size, which)
        size = np.diff(np.cumsum(n)[which == 1], prepend=0)  # a space follows each word
        # Words that are one piece are among the pieces.
        piece = pc.index_in(words, value_set=items.dictionary).fill_null(-1).to_numpy(zero_copy_only=False)
        rest = np.flatnonzero(piece < 0)
        mine = places[piece] if len(places) else np.empty(0, np.int64)
        mine[rest] = self.add(words.take(pa.array(rest)), *gathered(flat, size, rest))
        out[plain] = mine
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id, one after the other; and the number of each text's."""
        if len(self.words) > REMEMBERED:
            self.forget()
        texts = texts.cast(pa.string())
        if pc.any(pc.match_substring_regex(texts, _NO_SPACE.pattern)).as_py():
            words = pa.array([split(t) for t in texts.to_pylist()], pa.list_(pa.string()))
        else:
            words = pc.utf8_split_whitespace(texts)  # cuts at the same places else; a space at an end leaves an empty word
        coded = words.flatten().dictionary_encode()
        places = self.recall(coded.dictionary)
        new = places < 0
        self.again[places[~new]] = True
        places[new] = self.learn(coded.dictionary.filter(pa.array(new)))
        flat, size = gathered(self.flat, self.size, places)
        # The words' places among the distinct ones, and after each text that of the end id.
        last = np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        which = np.full(int(last[-1]), len(places), np.int64)
        inner = np.ones(len(which), bool)
        inner[last - 1] = False
        which[inner] = coded.indices.to_numpy(zero_copy_only=False)
        ids, n = gathered(np.append(flat, np.uint32(END_ID)), np.append(size, 1), which)
        return ids, np.diff(np.cumsum(n)[last - 1], prepend=0)


def encoder(path: str) -> Encoder:
    cache = worker_cache()
    if path not in cache:
        cache[path] = Encoder(path)
    return cache[path]


def pieces_of(sizes: list[int], most: int = 8_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of these sizes that hold so many bytes together, but for larger ones, and AT_ONCE texts at most."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and (total + n > most or i - start >= AT_ONCE):
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def write(docs: DataFrame, tokenizer: str, path: str) -> None:
    """Encode docs in ascending doc_id order and write segments at ``path``."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        size = 0

        def row() -> pa.RecordBatch:
            content = pack(np.concatenate(ids), np.concatenate(lengths))
            columns = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([size], pa.int64()), pa.array([content], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "seq", "doc_ids", "n_ids", "content"])

        for batch in batches:
            texts, keys = batch.column("text"), batch.column("doc_id").to_pylist()
            for a, b in pieces_of(pc.binary_length(texts).to_pylist()):
                flat, n = encoder(tokenizer).encode(texts.slice(a, b - a))
                at, stops = 0, np.cumsum(n)
                while at < b - a:
                    before = int(stops[at - 1]) if at else 0
                    stop = min(int(np.searchsorted(stops, before + SEGMENT_IDS - size)) + 1, b - a)
                    ids.append(flat[before : stops[stop - 1]]), lengths.append(n[at:stop]), doc_ids.extend(keys[a + at : a + stop])
                    size, at = size + int(stops[stop - 1]) - before, stop
                    if size >= SEGMENT_IDS:
                        yield row()
                        seq, ids, lengths, doc_ids, size = seq + 1, [], [], [], 0
        if doc_ids:
            yield row()

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), row_key(F.col("text")).alias("_key"))
    rows = rows.repartitionByRange("doc_id", "_key").sortWithinPartitions("doc_id", "_key")
    rows = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows.mapInArrow(segments, SEGMENTS).write.option("compression", "zstd").parquet(path)


def read(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the segments' bytes."""
    files = spark.read.schema(SEGMENTS).parquet(path)
    sums = files.select("part", "seq", "n_ids")
    before = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    inner = sums.withColumn("inner", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    parts = sums.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row for each task that wrote
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("outer"))
    # Written, so that the planner knows its size and moves the segments only where this is too large to broadcast.
    starts = stored(inner.join(parts, "part").select("part", "seq", (F.col("inner") + F.col("outer")).alias("base")), "starts")

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for base, keys, content in zip(batch["base"], batch["doc_ids"], batch["content"], strict=True):
                segment = Segment(bytes(content))
                flat, n = memoryview(segment.ids().astype("<u4").tobytes()), segment.lengths.astype(np.int64)
                start = np.concatenate([[0], np.cumsum(n)])
                crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]
                ids = pd.array([None if k is None or k != k else int(k) for k in keys], dtype="Int64")
                yield pd.DataFrame({"doc_id": ids, "start": base + start[:-1], "n_tokens": n, "ids_crc32": crc})

    rows = files.join(starts, ["part", "seq"]).select("doc_ids", "base", "content")
    return rows.mapInPandas(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    path = shared_dir(docs.sparkSession, "tokens")
    write(docs, tokenizer, path)
    return read(docs.sparkSession, path)
