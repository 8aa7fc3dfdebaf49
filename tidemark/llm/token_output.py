"""Token ids as files of coded blocks, in ascending id order of their documents, and back.

Documents are dealt out by ranges of their id and sorted, so the files, in the order of their `shard`, hold one
stream of ids. Each task encodes its documents and packs whole documents into segments of about `SEGMENT` ids (a longer
document makes a longer one). The files are Parquet tables, so that any store that Spark can write to will do and a
failed task leaves nothing behind; a row is a segment: shard, place in it, documents, their lengths, and
the ids as coded by `id_coder` in blocks that are reset and checksummed one by one.

Words are encoded once and kept, by 64-bit hash, in a bounded store of each worker: the
tokenizer must split text at white space before its merges, so a text's ids are those of its words in their order
(`words=False` encodes whole texts, for tokenizers that don't). Where the tokenizer normalises and splits as `SPLITS` says, words of printable
ASCII and the letters of Latin-1 are cut into its own pieces in lower case (letters, one digit, other signs); these are what is kept, and they go
straight to the library's merges.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import common, id_coder, kernels as K

SEGMENT = id_coder.LANES * id_coder.MOST
KEPT = 1_000_000  # pieces and words of a worker's store, some 45 bytes each
LIBRARY = 2048  # words that the library encodes at a time
PLAIN = re.compile(r"[!-&(-;=-~À-ÖØ-öø-ÿ]+")  # printable ASCII but ' and <, which begin the contractions and the added tokens; letters of Latin-1
PIECE = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
KIND = np.zeros(256, np.uint8)  # of the bytes of PLAIN words: 1 letters, 2 digits, 3 other signs; × and ÷ apart
KIND[33:127] = 3
KIND[[*b"'<"]] = 0
KIND[48:58] = 2
KIND[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = 1
SPLITS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
)
FIELDS = "shard int, segment int, first long, n_ids long, doc_ids array<long>, lengths array<long>, ids binary"


class WordIds:
    """Ids of words, by their hashes. The store is emptied before it would hold more than `KEPT` words and those of one piece of text."""

    def __init__(self, tokenizer):
        self.tokenizer, self.model = tokenizer, tokenizer.model
        parts = (tokenizer.normalizer, tokenizer.pre_tokenizer)
        added = tokenizer.get_added_tokens_decoder().values()
        self.plain = None not in parts and tuple(json.loads(p.__getstate__()) for p in parts) == SPLITS and tokenizer.post_processor is None and all(t.content.startswith("<") for t in added)
        printed = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]  # bytes that the byte level writes as themselves
        self.written = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in printed)}
        self.clear()

    def clear(self) -> None:
        self.keys, self.begin, self.length, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def piece(self, piece: str) -> list[int]:
        return [t.id for t in self.model.tokenize(piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.written))]

    def encode(self, words: list[str], pieces: list[bool] | None = None) -> list[list[int]]:
        """`pieces` tells which of the words are pieces in lower case already."""
        out = [self.piece(w) if p else None for w, p in zip(words, pieces or [False] * len(words))]
        for at, w in enumerate(words):
            if out[at] is None and self.plain and PLAIN.fullmatch(w):
                out[at] = [i for p in PIECE.findall(w.lower()) for i in self.piece(p)]
        odd = [i for i, ids in enumerate(out) if ids is None]
        for at in range(0, len(odd), LIBRARY):
            some = odd[at : at + LIBRARY]
            for i, e in zip(some, self.tokenizer.encode_batch_fast([words[i] for i in some], add_special_tokens=False)):
                out[i] = e.ids
        return out

    def places(self, hashes: np.ndarray, texts) -> np.ndarray:
        """Places in the store of the words with these distinct, sorted hashes; texts(i) are the words of the places i among them, and
        which of them are pieces."""
        at = K.find(self.keys, hashes)
        new = np.flatnonzero(at < 0)
        if len(new) and len(self.keys) + len(new) > KEPT:
            self.clear()
            new = np.arange(len(hashes))
        if len(new):
            each = self.encode(*texts(new))
            length = np.fromiter(map(len, each), np.int64, len(each))
            to = np.searchsorted(self.keys, hashes[new])
            self.begin = np.insert(self.begin, to, len(self.pool) + np.cumsum(length) - length)
            self.length = np.insert(self.length, to, length)
            self.keys = np.insert(self.keys, to, hashes[new])
            self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(each), np.uint32, int(length.sum()))])
            at = K.find(self.keys, hashes)
        return at


@lru_cache(1)
def _store(tokenizer_path: str) -> WordIds:
    """A worker's store, kept for its next tasks."""
    from tokenizers import Tokenizer

    return WordIds(Tokenizer.from_file(tokenizer_path))


def _texts(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> list[str]:
    """The UTF-8 texts from bytes s to e."""
    off = np.append(0, np.cumsum(e - s))
    bytes_ = data[np.repeat(s - off[:-1], e - s) + np.arange(off[-1])]
    return pa.Array.from_buffers(pa.large_string(), len(s), [None, pa.py_buffer(off), pa.py_buffer(bytes_)]).to_pylist()


def _pieces(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, PLAIN words in lower case, the start and end of their pieces and of whole other words, and which are pieces; s and
    e are those of the words."""
    kind, latin = KIND[data], np.zeros(len(data), bool)
    latin[1:] = data[:-1] == 0xC3
    kind[latin & ((data == 0x97) | (data == 0xB7))] = 0
    odd = np.append(0, np.cumsum(kind == 0, dtype=np.int32))
    odd = odd[e] > odd[s]
    within = np.zeros(len(data) + 1, np.int8)
    within[s[odd]] += 1
    within[e[odd]] -= 1
    plain = np.cumsum(within[:-1], dtype=np.int8) == 0
    begins = plain & (kind > 0)
    begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    begins[s] = True
    upper = plain & ((data >= 65) & (data <= 90) | latin & (data <= 0x9E))
    at = np.flatnonzero(begins)
    word = np.searchsorted(s, at, "right") - 1
    return data + (upper.view(np.uint8) << 5), at, np.minimum(np.append(at[1:], len(data)), e[word]), ~odd[word]


def _flat(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def encoded(batches: Iterator[pa.RecordBatch], tokenizer_path: str, end_id: int, words: bool) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(document ids, ids of all their texts, number of ids of each), the end id included, for each piece of text."""
    store = _store(tokenizer_path)
    for batch, data, off in K.chunks(batches):
        docs, n = batch.column("doc_id").to_pylist(), batch.num_rows
        if not words:
            each = [np.array(e.ids + [end_id], np.uint32) for e in store.tokenizer.encode_batch_fast([t or "" for t in batch.column("text").to_pylist()], add_special_tokens=False)]
            yield docs, _flat(each), np.array([len(e) for e in each])
            continue
        s, e, first = K.words(data, off)
        known = np.zeros(len(s), bool)
        if store.plain and len(s):
            data, s, e, known = _pieces(data, s, e)
            first = np.searchsorted(s, off)
        hashes, which = np.unique(K.word_hashes(data, s, e), return_inverse=True)
        one = np.zeros(len(hashes), np.int64)
        one[which] = np.arange(len(s))
        place = store.places(hashes, lambda i: (_texts(data, s[one[i]], e[one[i]]), known[one[i]].tolist()))[which]  # noqa: B023
        many = store.length[place]
        upto = np.append(0, np.cumsum(many))
        total = np.diff(upto[first]) + 1  # the end id
        out = np.full(int(total.sum()), end_id, np.uint32)
        real = np.ones(len(out), bool)
        real[np.cumsum(total) - 1] = False
        out[real] = store.pool[np.repeat(store.begin[place] - upto[:-1], many) + np.arange(upto[-1])]
        yield docs, out, total


def _segments(tokenizer_path: str, end_id: int, words: bool):
    def run(batches):
        shard, number, before = TaskContext.get().partitionId(), 0, 0
        docs, parts, lengths, held = [], [], [], 0

        def record():
            ids = _flat(parts)
            row = {"shard": [shard], "segment": [number], "first": [before], "n_ids": [len(ids)], "doc_ids": [docs], "lengths": [lengths], "ids": [id_coder.encode(ids)]}
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            return pa.record_batch({k: pa.array(v, t) for (k, v), t in zip(row.items(), kinds)})

        for ids_of, ids, length in encoded(batches, tokenizer_path, end_id, words):
            if held and held + len(ids) > SEGMENT:
                yield record()
                number, before, docs, parts, lengths, held = number + 1, before + held, [], [], [], 0
            docs, parts, lengths, held = docs + ids_of, [*parts, ids], lengths + length.tolist(), held + len(ids)
        if docs:
            yield record()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, words: bool = True, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all documents, each ended by `end_id`, to `path`.

    Null and empty texts are the end id alone. Rows of one id stand beside each other, each a document of its own; those without an
    id come last. Texts of any length are encoded whole. Other columns are not read. An empty table writes no segment.
    """
    rows = common.texts(docs, id_col, text_col)
    order = [F.asc_nulls_last("doc_id"), F.xxhash64("text").asc()]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.mapInArrow(_segments(tokenizer_path, end_id, words), FIELDS).write.parquet(path)


def _documents(with_ids: bool):
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].as_py() for c in ("shard", "first", "doc_ids", "lengths", "ids")}
                ids = id_coder.decode(row["ids"])
                ends = np.cumsum(np.array(row["lengths"], np.int64))
                if not len(ends) or ends[-1] != len(ids):
                    raise ValueError("a segment's documents don't add up to its ids")
                starts = ends - row["lengths"]
                cut = [ids[a:z] for a, z in zip(starts, ends)]
                out = {"shard": pa.array([row["shard"]] * len(cut), pa.int32()), "doc_id": pa.array(row["doc_ids"], pa.int64()), "at": pa.array(starts + row["first"]), "n_tokens": pa.array(row["lengths"], pa.int64()), "ids_crc32": pa.array([zlib.crc32(c.tobytes()) for c in cut], pa.int64())}
                if with_ids:
                    out["ids"] = pa.array([c.tolist() for c in cut], pa.list_(pa.int32()))
                yield pa.record_batch(out)

    return run


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document of the files at `path`: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of its ids as
    little-endian 32-bit integers) and, if asked for, ids. Every block is decoded and checked; a damaged one is an error."""
    files = spark.read.schema(FIELDS).parquet(path)
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))  # one row a file
    rows = files.select("shard", "first", "doc_ids", "lengths", "ids").mapInArrow(_documents(with_ids), "shard int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
    return rows.join(F.broadcast(before), "shard").select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def token_output(docs: DataFrame, tokenizer_path: str, path: str | None = None, **options) -> DataFrame:
    """What `read_tokens` has of the files that `write_tokens` wrote to `path`, a new one in the checkpoint folder if none is given."""
    spark = docs.sparkSession
    common.shared_dir(spark)
    path = path or f"{spark.sparkContext.getCheckpointDir()}/tokens/{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer_path, **options)
    return read_tokens(spark, path)
