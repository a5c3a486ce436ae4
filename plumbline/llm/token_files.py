"""Token ids in Parquet files: list columns, controlled row groups, page indexes.

Texts are dealt into ranges of ascending doc_id and sorted, so each file holds a run of documents and
the files' order is that of the ids. Ids are an int list column: dictionary pages where they fit,
else binary-packed deltas (format version 2). Readers take the metadata columns without touching the
ids, or the ids of some documents by the column and page indexes. Files are written by Spark's own
committer, so a lost executor leaves no half-written file behind.

A byte-level pre-split never joins a space with what stands before it, so a text may be cut before
any space that an ASCII sign or a Latin-1 letter follows. A worker encodes each distinct piece once
and then looks it up by its 64-bit hash; the pieces it remembers are bounded. Texts that
hold an added token, which the library takes out before the pre-split, are encoded as a whole, as all
texts are with a tokenizer whose pre-split isn't this one.

Defined cases: a null or empty text has the end mark alone; null ids come first; repeated ids are
in order of their texts' hash; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plumbline.llm.store import new_path, small, written
from plumbline.llm.textkit import column_bytes, span_hashes

END = 0
#: Pieces a worker remembers, and the longest that a hash stands for.
MEMORY, LONG_PIECE = 1_000_000, 1 << 12
#: Bytes encoded at a time, and rows taken from a batch at a time.
RUN, ROWS = 1 << 19, 500
FILES = {"compression": "zstd", "parquet.block.size": str(32 << 20), "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(2 << 20)}

_FOLLOWS = np.zeros(256, bool)
_FOLLOWS[0x21:0x7F] = True
_FOLLOWS[0xC3] = True
_CUT = re.compile(rb" (?=[\x21-\x7e\xc3])")


class Pieces:
    """Ids of pieces by hash: an open-addressed table of keys, with where each piece's ids start and how many they are."""

    def __init__(self) -> None:
        self.size, self.filled = 0, 0
        self.keys, self.starts, self.lengths = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32)
        self.ids = np.zeros(1 << 14, np.int32)
        self._slots(1 << 14)

    def _slots(self, n: int) -> None:
        self.mask, self.table, self.entry = np.int64(n - 1), np.zeros(n, np.uint64), np.zeros(n, np.int32)
        self._place(np.arange(self.size, dtype=np.int32))

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(20)).astype(np.int64) & self.mask

    def _place(self, entries: np.ndarray) -> None:
        keys = self.keys[entries]
        slot = self._first(keys)
        while len(entries):
            free = self.table[slot] == 0
            self.table[slot[free]] = keys[free]
            self.entry[slot[free]] = entries[free]
            left = self.entry[slot] != entries
            left |= self.table[slot] != keys
            keys, entries, slot = keys[left], entries[left], (slot[left] + 1) & self.mask

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The entry of each key, or -1."""
        slot = self._first(wanted)
        held = self.table[slot]
        out = np.where(held == wanted, self.entry[slot], np.int32(-1))
        left = np.flatnonzero((held != wanted) & (held != 0))
        while len(left):
            slot = (slot if len(slot) == len(left) else slot[left]) + 1 & self.mask
            held, keys = self.table[slot], wanted[left]
            hit = held == keys
            out[left[hit]] = self.entry[slot[hit]]
            more = ~hit & (held != 0)
            left, slot = left[more], slot[more]
        return out

    def add(self, keys: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        """Adds distinct keys that aren't in the table; ids holds their ids one after the other."""
        n, total = self.size + len(keys), self.filled + len(ids)
        while n > len(self.keys):
            self.keys, self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.keys, self.starts, self.lengths))
        while total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.keys[self.size : n], self.lengths[self.size : n] = keys, lengths
        self.starts[self.size : n] = self.filled + np.cumsum(lengths) - lengths
        self.ids[self.filled : total] = ids
        entries = np.arange(self.size, n, dtype=np.int32)
        self.size, self.filled = n, total
        if 2 * n > len(self.table):
            self._slots(1 << (2 * n).bit_length())
        else:
            self._place(entries)


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The worker's encoder: it stays from task to task, with the pieces it remembers."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Encoder:
    """Encodes texts by a tokenizer file, remembering what distinct pieces give."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.widths = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of each id; a vocabulary string has a sign for each
        self.widths[list(vocabulary.values())] = [len(x) for x in vocabulary]
        split = json.loads(self.tokenizer.pre_tokenizer.__getstate__()) if self.tokenizer.pre_tokenizer else {}
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        #: Whether texts may be cut into pieces.
        self.cuts = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and self.tokenizer.normalizer is None
        self.cuts = self.cuts and not any(t.single_word or t.lstrip or t.rstrip for t in added)
        self.added = re.compile(b"|".join(sorted((re.escape(t.content.encode()) for t in added), key=len, reverse=True)) or rb"(?!)")
        self.forget()

    def forget(self) -> None:
        self.known = Pieces()

    def whole(self, text: bytes) -> bool:
        """Whether the text has to be encoded as it is."""
        return not self.cuts or self.added.search(text) is not None

    def raw(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def joined(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that all start with a space, encoded as one text, and how many each has."""
        ids = np.array(self.raw([b"".join(pieces).decode("utf-8")])[0], np.int32)
        ends = np.searchsorted(np.cumsum(self.widths[ids]), np.cumsum([len(p) for p in pieces])) + 1
        return ids, np.diff(ends, prepend=0)

    def learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        order = np.argsort([p[:1] != b" " for p in pieces], kind="stable")
        keys, pieces = keys[order], [pieces[i] for i in order]
        spaced = sum(p[:1] == b" " for p in pieces)
        ids, lengths = [], []
        for at in range(0, spaced, 20_000):
            i, n = self.joined(pieces[at : min(spaced, at + 20_000)])
            ids.append(i)
            lengths.append(n)
        for x in self.raw([p.decode("utf-8") for p in pieces[spaced:]]) if spaced < len(pieces) else ():
            ids.append(np.array(x, np.int32))
            lengths.append(np.array([len(x)]))
        self.known.add(keys, np.concatenate(lengths), np.concatenate(ids))

    def encode(self, buf: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts that start at cuts in buf (the last one ends with it), and how many each has."""
        if not len(buf):
            return np.zeros(0, np.int32), np.zeros(len(cuts), np.int64)
        first = np.zeros(len(buf), bool)
        first[:-1] = (buf[:-1] == 32) & _FOLLOWS[buf[1:]]
        first[cuts[cuts < len(buf)]] = True
        starts = np.flatnonzero(first)
        ends = np.r_[starts[1:], len(buf)]
        keys = span_hashes(buf, starts, ends)
        for a, z, k in ((a, z, k) for k, (a, z) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)) if z - a > LONG_PIECE) if (ends - starts).max() > LONG_PIECE else ():
            keys[k] ^= np.uint64(zlib.crc32(buf[a:z].tobytes()))
        keys[keys == 0] = np.uint64(1)  # an empty slot's key
        if self.known.size > MEMORY:
            self.forget()
        at = self.known.find(keys)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            fresh, first_at, back = np.unique(keys[missing], return_index=True, return_inverse=True)
            spans = missing[first_at]
            self.learn(fresh, [buf[a:z].tobytes() for a, z in zip(starts[spans].tolist(), ends[spans].tolist(), strict=True)])
            at[missing] = self.known.find(fresh)[back]
        n = self.known.lengths[at].astype(np.int64)
        total = np.r_[0, np.cumsum(n)]
        ids = self.known.ids[np.arange(total[-1]) + np.repeat(self.known.starts[at] - total[:-1], n)]
        edges = total[np.searchsorted(starts, np.r_[cuts, len(buf)])]
        return ids, np.diff(edges)

    def long_text(self, text: bytes) -> np.ndarray:
        if self.whole(text):
            return np.array(self.raw([text.decode("utf-8")])[0], np.int32)
        parts, at = [], 0
        while at < len(text):
            cut = _CUT.search(text, at + RUN)
            end = cut.start() if cut else len(text)
            if end - at > 8 * RUN:
                parts.append(np.array(self.raw([text[at:end].decode("utf-8")])[0], np.int32))
            else:
                parts.append(self.encode(np.frombuffer(text[at:end], np.uint8), np.zeros(1, np.int64))[0])
            at = end
        return np.concatenate(parts)


ENCODED = "doc_id long, part int, pos long, n_tokens long, ids array<int>"


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, pos = encoder_of(path), TaskContext.get().partitionId(), 0

        def made(ids: pa.Array, values: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
            nonlocal pos
            n, total = len(lengths), np.r_[0, np.cumsum(lengths + 1)]
            out = np.full(total[-1], END, np.int32)
            keep = np.ones(len(out), bool)
            keep[total[1:] - 1] = False
            out[keep] = values
            batch = pa.RecordBatch.from_arrays(
                [ids, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(pos, pos + n)), pa.array(lengths + 1), pa.ListArray.from_arrays(pa.array(total.astype(np.int32)), pa.array(out))],
                names=["doc_id", "part", "pos", "n_tokens", "ids"],
            )
            pos += n
            return batch

        for b in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            ids, (offsets, data) = b.column(0), column_bytes(b.column(1))
            row, n = 0, len(ids)
            while row < n:
                size = offsets[row + 1] - offsets[row]
                if size > RUN:
                    values = encoder.long_text(data[offsets[row] : offsets[row + 1]].tobytes())
                    yield made(ids.slice(row, 1), values, np.array([len(values)]))
                    row += 1
                    continue
                last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + RUN, "right")) - 1)
                yield made(ids.slice(row, last - row), *_by_text(encoder, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]))
                row = last

    return run


def _by_text(encoder: Encoder, buf: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    full = np.flatnonzero(np.diff(edges))
    lengths = np.zeros(len(edges) - 1, np.int64)
    if encoder.whole(buf.tobytes()):
        found = encoder.raw([buf[a:z].tobytes().decode("utf-8") for a, z in zip(edges[:-1][full].tolist(), edges[1:][full].tolist(), strict=True)])
        lengths[full] = [len(x) for x in found]
        return np.array([i for x in found for i in x], np.int32), lengths
    values, lengths[full] = encoder.encode(buf, edges[:-1][full])
    return values, lengths


def write_tokens(docs: DataFrame, tokenizer: str) -> str:
    """Writes the ids of docs (doc_id long, text string) in ascending doc_id order; returns the folder."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    # Few enough ranges to sort in memory, enough to keep a large text from standing beside many others.
    dealt = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    path = new_path(docs.sparkSession, "tokens")
    dealt.mapInArrow(_encoded(tokenizer), ENCODED).write.options(**FILES).parquet(path)
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, part, pos, n_tokens, ids); select what is needed, and only those columns are read."""
    return spark.read.schema(ENCODED).parquet(path)


def starts(tokens: DataFrame) -> DataFrame:
    """(part, pos, start): ids of all documents before each. The unpartitioned window runs over the files alone."""
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    bases = written(totals.select(F.col("part").alias("p"), F.coalesce(F.sum("total").over(before(Window.orderBy("part"))), F.lit(0)).alias("base")), "token-bases")
    run = F.coalesce(F.sum("n_tokens").over(before(Window.partitionBy("part").orderBy("pos"))), F.lit(0))
    return tokens.select("part", "pos", "doc_id", "n_tokens", "ids_crc32", run.alias("run")).join(small(bases), F.col("part") == F.col("p")).withColumn("start", F.col("base") + F.col("run"))


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column("ids")
        values, edges = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4"), np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
        crc = [zlib.crc32(values[a:z].tobytes()) for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        n = np.diff(edges)
        if (n != b.column("n_tokens").to_numpy()).any():
            raise ValueError("a list's length differs from its metadata")
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), b.column("pos"), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "part", "pos", "n_tokens", "ids_crc32"])


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    # The ids are decoded once: what starts() reads twice is the digests.
    checked = written(read_tokens(spark, path).mapInArrow(_checked, "doc_id long, part int, pos long, n_tokens long, ids_crc32 long"), "token-digests")
    return starts(checked).select("doc_id", "start", "n_tokens", "ids_crc32")
