"""Token ids in binary shards with a minimal perfect hash index from document key to place.

A shard is two files. ``.ids`` holds the raw ids of its documents one after another, each document closed by the end id, as
little-endian unsigned integers of the smallest width that fits the vocabulary. ``.idx`` holds, for its documents in order,
keys and ends (in ids), and the index: for every distinct key a slot with a 32-bit fingerprint and the key's first record.
The slot comes from a minimal perfect hash: level by level, keys that are alone in their bit of a bit array keep it, the
others go to the next level; a key's slot is the number of set bits before its own. A lookup reads a few words, whatever the
shard's size, and a key that is not there is told by its fingerprint.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stampbook.llm.common import shared_path, written
from stampbook.llm.textbytes import mix, slices

NO_ID = (1 << 63) - 1
MAGIC = b"STKIDX01"
#: Distinct words whose ids a task keeps; beyond that it starts anew.
CACHE_WORDS = 800_000


class _Numbering(dict):
    """Numbers keys in the order in which they are first asked for; ``new`` lists those not encoded yet."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, key):
        self[key] = n = len(self)
        self.new.append(key)
        return n


def _gathered(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    stop = np.cumsum(size)
    return flat[np.repeat(begin - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)]


class _Pieces:
    """Ids of pieces of text that the tokenizer never joins, each encoded once.

    A run of letters and the marks after it are separate to a byte-level pre-tokenizer, so such a piece takes its ids from both.
    """

    MARKS = ".,;:!?"

    def __init__(self, tokenizer, lead: str, marks: _Pieces | None = None):
        self.tokenizer, self.lead, self.marks = tokenizer, lead, marks
        self.clear()

    def clear(self):
        self.place = _Numbering()
        self.flat, self.end = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def numbers(self, pieces: list[str]) -> np.ndarray:
        out = np.fromiter(map(self.place.__getitem__, pieces), np.int64, len(pieces))
        if self.place.new:
            self._encode_new()
        return out

    def _encode_new(self):
        place, first = self.place, len(self.end) - 1
        whole, plain, parts = [], [], []
        for n, p in enumerate(place.new, first):  # stems join the list on the way
            stem = p.rstrip(self.MARKS) if self.marks else p
            if len(stem) < len(p) and stem.isalpha():
                parts.append((n, place[stem], p[len(stem) :]))
            else:
                whole.append(self.lead + p)
                plain.append(n)
        count = len(place.new)
        place.new.clear()
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)]
        size = np.zeros(count, np.int64)
        size[np.asarray(plain, np.int64) - first] = np.fromiter(map(len, ids), np.int64, len(ids))
        one = np.fromiter((i for x in ids for i in x), np.uint32, int(size.sum()))
        one_end = np.cumsum(size)  # plain pieces alone: composed ones have no ids yet
        if not parts:
            self.flat, self.end = np.concatenate([self.flat, one]), np.concatenate([self.end, self.end[-1] + one_end])
            return
        n, stem, tails = zip(*parts, strict=True)
        tail = self.marks.numbers(list(tails))
        flat = np.concatenate([self.flat, one, self.marks.flat])
        begin = np.concatenate([self.end[:-1], len(self.flat) + one_end - size])
        sizes = np.concatenate([np.diff(self.end), size])
        # two parts for every new piece, the second one empty for plain pieces
        at, left = np.asarray(n) - first, np.asarray(stem)
        starts, lengths = np.zeros((count, 2), np.int64), np.zeros((count, 2), np.int64)
        starts[:, 0], lengths[:, 0] = begin[first:], sizes[first:]
        starts[at, 0], lengths[at, 0] = begin[left], sizes[left]
        starts[at, 1] = len(self.flat) + len(one) + self.marks.end[tail]
        lengths[at, 1] = np.diff(self.marks.end)[tail]
        self.flat = np.concatenate([self.flat, _gathered(flat, starts.ravel(), lengths.ravel())])
        self.end = np.concatenate([self.end, self.end[-1] + np.cumsum(lengths.sum(axis=1))])


class Encoder:
    """Whole texts to ids, as the tokenizer gives them without adding special tokens.

    A byte-level pre-tokenizer always cuts before a blank that is followed by something else, so a text is cut there and every
    distinct piece is encoded once per task. With ``added`` a text that holds one of the tokenizer's added tokens is encoded
    whole by the plain tokenizer, which gives that token its own id; without, such a token is text like any other.
    """

    def __init__(self, path: str, end_id: int, added: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        t.no_truncation()
        t.no_padding()
        self.plain = None
        if added and (tokens := [x.content for x in t.get_added_tokens_decoder().values()]):
            self.plain = Tokenizer.from_file(path)
            self.plain.no_truncation()
            self.plain.no_padding()
            self.holds = re.compile("|".join(map(re.escape, tokens)), re.IGNORECASE)  # wider than the tokenizer's own search, never narrower
        self.heads, self.rest, self.end_id = _Pieces(t, ""), _Pieces(t, " ", _Pieces(t, "")), end_id

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with its end id; number of ids of each)."""
        for cache in (self.heads, self.rest, self.rest.marks):
            if len(cache.place) > CACHE_WORDS:
                cache.clear()
        heads, rest, n, apart = [], [], [], []
        for k, text in enumerate(texts):
            if self.plain and self.holds.search(text):
                apart.append(k)
                text = ""
            if re.search(r" \s", text):
                first, *more = re.split(r"(?= \S)", text)
                pieces = [p[1:] for p in more]
            else:
                first, *pieces = text.split(" ")
            heads.append(first)
            rest += pieces
            n.append(len(pieces))
        n = np.asarray(n, np.int64)
        h, r = self.heads.numbers(heads), self.rest.numbers(rest)
        # one table of pieces: heads, then the rest, then the end id
        flat = np.concatenate([self.heads.flat, self.rest.flat, np.asarray([self.end_id], np.uint32)])
        begin = np.concatenate([self.heads.end[:-1], self.rest.end[:-1] + len(self.heads.flat), [len(flat) - 1]])
        size = np.concatenate([np.diff(self.heads.end), np.diff(self.rest.end), [1]])
        at = np.cumsum(n + 2) - 1  # place of each text's end
        order = np.empty(int((n + 2).sum()), np.int64)
        order[at] = len(begin) - 1
        order[at - n - 1] = h
        inner = np.ones(len(order), bool)
        inner[at] = inner[at - n - 1] = False
        order[inner] = r + len(self.heads.end) - 1
        ids = _gathered(flat, begin[order], size[order])
        if not len(at):
            return ids, at
        stop = np.cumsum(size[order])[at]
        count = np.diff(np.concatenate(([0], stop)))
        if apart:  # each stands as its end id alone
            whole = [np.asarray(e.ids, ids.dtype) for e in self.plain.encode_batch_fast([texts[k] for k in apart], add_special_tokens=False)]
            more = np.fromiter(map(len, whole), np.int64, len(whole))
            ids = np.insert(ids, np.repeat(stop[apart] - 1, more), np.concatenate(whole))
            count[apart] += more
        return ids, count


class KeyIndex:
    """Minimal perfect hash over distinct 64-bit keys, with fingerprints."""

    def __init__(self, levels: list[np.ndarray], fingerprints: np.ndarray, records: np.ndarray):
        self.levels, self.fingerprints, self.records = levels, fingerprints, records
        self.before, base = [], 0
        for bits in levels:
            ones = np.bitwise_count(bits).astype(np.int64)
            self.before.append(base + np.cumsum(ones) - ones)
            base += int(ones.sum())

    @staticmethod
    def _bit(keys: np.ndarray, level: int, words: int) -> np.ndarray:
        return mix(keys ^ mix(np.full(1, level + 1, np.uint64))) % np.uint64(words * 64)

    @staticmethod
    def _fingerprint(keys: np.ndarray) -> np.ndarray:
        return (mix(keys + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(32)).astype(np.uint32)

    @classmethod
    def build(cls, keys: np.ndarray, records: np.ndarray) -> KeyIndex:
        levels, left = [], keys
        while len(left):
            words = len(left) // 32 + 1  # about two bits a key
            bit = cls._bit(left, len(levels), words)
            alone = np.bincount(bit.astype(np.int64), minlength=words * 64)[bit.astype(np.int64)] == 1
            bits = np.zeros(words, np.uint64)
            np.bitwise_or.at(bits, (bit[alone] >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit[alone] & np.uint64(63)))
            levels.append(bits)
            left = left[~alone]
        index = cls(levels, np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.uint32))
        slot = index.slots(keys)
        index.fingerprints[slot] = cls._fingerprint(keys)
        index.records[slot] = records
        return index

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of every key; -1 where no level holds it."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            bit = self._bit(keys[open_], level, len(bits))
            word = (bit >> np.uint64(6)).astype(np.int64)
            mask = np.uint64(1) << (bit & np.uint64(63))
            held = (bits[word] & mask) != 0
            out[open_[held]] = (self.before[level][word] + np.bitwise_count(bits[word] & (mask - np.uint64(1))))[held]
            open_ = open_[~held]
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """First record of every key, -1 where the fingerprint tells that the key is not there."""
        if not len(self.records):
            return np.full(len(keys), -1, np.int64)
        slot = self.slots(keys)
        known = (slot >= 0) & (self.fingerprints[np.maximum(slot, 0)] == self._fingerprint(keys))
        return np.where(known, self.records[np.maximum(slot, 0)].astype(np.int64), -1)


def _place(path: str):
    """File system and path of a shared file; paths without a scheme are local ones, as on a mounted share."""
    if re.match(r"\w+:", path):
        return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
    return pafs.LocalFileSystem(), path


def _publish(folder: str, name: str, write) -> None:
    """Writes under a name of this attempt and moves it into place, so that a rerun task leaves one whole file."""
    fs, base = _place(folder)
    fs.create_dir(base, recursive=True)
    context = TaskContext.get()
    attempt = f"{base}/_{name}-{context.taskAttemptId() if context else 0}"
    with fs.open_output_stream(attempt) as out:
        write(out)
    fs.move(attempt, f"{base}/{name}")


class Shard:
    """One shard read back: keys, ends, index and raw ids."""

    def __init__(self, folder: str, name: str):
        fs, base = _place(folder)
        with fs.open_input_stream(f"{base}/{name}.idx") as f:
            raw = f.read()
        if raw[:8] != MAGIC:
            raise ValueError(f"{name}.idx is not an index of this format")
        size = int(np.frombuffer(raw, "<u4", 1, 8)[0])
        head, at = json.loads(raw[12 : 12 + size]), 12 + size

        def take(kind, n):
            nonlocal at
            a = np.frombuffer(raw, kind, n, at)
            at += a.nbytes
            return a

        n, keys = head["documents"], head["keys"]
        self.keys, self.ends = take("<i8", n), take("<i8", n)
        fingerprints, records = take("<u4", keys), take("<u4", keys)
        self.index = KeyIndex([take("<u8", w) for w in head["levels"]], fingerprints, records)
        self.width, self.fs, self.path = head["width"], fs, f"{base}/{name}.ids"

    def ids(self, record: int) -> np.ndarray:
        """Ids of one document: one seek, one read."""
        a, b = int(self.ends[record - 1]) if record else 0, int(self.ends[record])
        with self.fs.open_input_file(self.path) as f:
            return np.frombuffer(f.read_at((b - a) * self.width, a * self.width), f"<u{self.width}").astype(np.uint32)

    def get(self, key: int) -> np.ndarray | None:
        """Ids of the first document under a key, or None."""
        record = int(self.index.find(np.asarray([key], np.int64).view(np.uint64))[0])
        return None if record < 0 else self.ids(record)

    def documents(self, wanted: np.ndarray):
        """(record, ids) of every record of the wanted keys; records are found by the index, the payload is read once."""
        with self.fs.open_input_stream(self.path) as f:
            payload = np.frombuffer(f.read(), f"<u{self.width}")
        first = self.index.find(wanted.view(np.uint64))
        repeat = np.arange(len(wanted)) - np.searchsorted(wanted, wanted)  # equal keys stand together, in file order
        for record in first + repeat:
            yield int(record), payload[int(self.ends[record - 1]) if record else 0 : int(self.ends[record])]


@lru_cache(2)
def _encoder(path: str, end_id: int) -> Encoder:
    return Encoder(path, end_id, added=True)


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, vocabulary: int = 50_257, shards: int | None = None) -> DataFrame:
    """Encodes every whole text (missing: empty) and writes shards in ascending doc_id order; returns the manifest.

    Ids are those of the library's ``encode(text, add_special_tokens=False)``, also for texts that hold an added token.
    Manifest: shard, name, documents, ids, start (ids in all shards before). The folder must be one that driver and executors
    share. A missing doc_id is the largest key; rows that repeat a doc_id are records of one key, ordered by text hash. An empty
    table gives an empty manifest. Other columns are ignored.
    """
    width = 2 if max(vocabulary, end_id + 1) <= 1 << 16 else 4
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(shards, "doc_id") if shards else rows.repartitionByRange("doc_id")
    rows = rows.sortWithinPartitions("doc_id", F.xxhash64("text"))

    def write(batches):
        encoder, keys, counts = _encoder(tokenizer, end_id), [], []
        number = TaskContext.get().partitionId()
        name = f"shard-{number:06d}"

        def payload(out):
            for batch in batches:
                for part in slices(batch):
                    ids, n = encoder.encode(part.column("text").to_pylist())
                    out.write(ids.astype(f"<u{width}").tobytes())
                    keys.append(part.column("doc_id").to_numpy())
                    counts.append(n)

        _publish(folder, f"{name}.ids", payload)
        if not keys:
            return
        key, end = np.concatenate(keys), np.cumsum(np.concatenate(counts))
        distinct, first = np.unique(key, return_index=True)
        index = KeyIndex.build(distinct.view(np.uint64), first.astype(np.uint32))
        head = json.dumps({"documents": len(key), "keys": len(distinct), "levels": [len(b) for b in index.levels], "width": width}).encode()
        parts = [MAGIC, np.asarray([len(head)], "<u4").tobytes(), head, key.astype("<i8").tobytes(), end.astype("<i8").tobytes(), index.fingerprints.tobytes(), index.records.tobytes(), *(b.tobytes() for b in index.levels)]
        _publish(folder, f"{name}.idx", lambda out: [out.write(p) for p in parts])
        yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([name]), pa.array([len(key)]), pa.array([int(end[-1])])], ["shard", "name", "documents", "ids"])

    manifest = written(rows.mapInArrow(write, "shard long, name string, documents long, ids long"), "manifest")
    before = F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # one row per shard
    return manifest.withColumn("start", F.coalesce(before, F.lit(0)))


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """Every document of the shards, found by its key through the index: doc_id, start, n_tokens, ids_crc32."""
    n = manifest.count()

    def read(batches):
        for batch in batches:
            for name, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist(), strict=True):
                shard = Shard(folder, name)
                rows = []
                for record, ids in shard.documents(shard.keys):
                    key = int(shard.keys[record])
                    rows.append((None if key == NO_ID else key, start + int(shard.ends[record]) - len(ids), len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                cols = zip(*rows, strict=True) if rows else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.repartition(max(1, n), "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_shards(spark, folder: str) -> DataFrame:
    """The whole of documents to shards and back."""
    import public_tokenizers

    target = shared_path(spark, "shards")
    manifest = write_shards(spark.read.parquet(f"{folder}/documents.parquet"), target, public_tokenizers.path("byte_bpe_50k.json"))
    return read_documents(manifest, target)
