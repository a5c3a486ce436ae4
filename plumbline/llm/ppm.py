"""Language-model scoring by partial matching (PPM) over bytes.

A document is coded as one stream: its lower-cased words, each with the space after it, and an end
mark. Each byte is predicted from up to ``ORDER`` bytes before it, across the ends of words, back to
the space before the document. The trie of byte contexts is pretrained on the streams of the training
documents. A context predicts the symbols it has seen by their counts, and an escape to the next
shorter context, where the symbols that the longer one has seen are excluded. The escape's probability
is estimated from all contexts of the order with about the same counts, by leaving out each occurrence
in turn. Shorter contexts count the distinct longer ones in which a symbol was new (update exclusion).

Streams are written once, some ``CHUNK`` bytes of them to a row. A chunk gives each distinct symbol
with its longest context once, with its count, and each distinct word: as sorted keys, packed in one
binary for each bucket of keys, so what is shuffled is a few rows of packed keys and not a row for each
symbol. Buckets are merged (by groups of ``GROUP`` chunks first, where there are more), which makes the
trie; each bucket's keys then get their code lengths, group by group of chunks, and these go back
to the chunks, whose symbols look them up.

The trie holds every context of the training texts and grows with them, so no task holds it whole.
Contexts with the same newest ``LOW + 1`` bytes lie in one bucket, as all their shorter ones but the
shortest do; they are at most 2**24 symbols, as those of up to ``LOW`` bytes are, which are broadcast.

Defined cases: null, empty and white-space texts have the end mark as their one token; a null doc_id
is scored and trains; repeated rows are rows of their own, and each of them trains; without any
training token each symbol has the same chance; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm.store import drop, written
from plumbline.llm.textkit import LONG_WORD, SPACE as IS_SPACE, mix, span_hashes, spans, word_spans

#: Bytes of the longest context; of up to six, they fit a 64-bit key with the symbol and a length.
ORDER = 5
#: Contexts of up to so many bytes are in tables that each task holds.
LOW = 2
#: Symbols laid out at a time.
PIECE = 1 << 20
#: Bytes of streams in a chunk; buckets of symbols and of words at least, and bytes of streams for each further one; chunks whose keys one task scores.
CHUNK, LEAST, BUCKET, GROUP = 8 << 20, (32, 4), (128 << 20, 512 << 20), 256
SPACE, STOP, SYMBOLS = 0x20, 0x0A, 257
#: The end mark's key among those of words.
END = np.uint64(0)

CODED = "chunk long, size long, stream binary, doc_id array<long>, held_out array<boolean>, ends array<long>"


def packed(x: np.ndarray) -> bytes:
    """64-bit values, byte by byte, compressed."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T)
    return len(x).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(b: bytes, kind=np.uint64) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    planes = np.frombuffer(pa.decompress(b[8:], 8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view(kind).reshape(n)


def packed_keys(x: np.ndarray) -> bytes:
    """Ascending keys, as differences."""
    return packed(np.diff(x, prepend=np.uint64(0)))


def unpacked_keys(b: bytes) -> np.ndarray:
    return np.cumsum(unpacked(b), dtype=np.uint64)


def merged(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending keys of all parts (ascending keys, counts) with their counts, merged two of about the same size at a time."""

    def two(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([a[0], b[0]])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], np.concatenate([a[1], b[1]])[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.add.reduceat(counts, first) if len(first) else counts

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for part in parts:
        held.append(part)
        while len(held) > 1 and 2 * len(held[-1][0]) >= len(held[-2][0]):
            held[-2:] = [two(*held[-2:])]
    while len(held) > 1:
        held[-2:] = [two(*held[-2:])]
    return held[0] if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def stream(offsets: np.ndarray, buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Streams of documents with the words offsets[i] to offsets[i + 1], which stand at s to e in buf, and where each stream ends."""
    n, body = len(offsets) - 1, np.r_[0, np.cumsum(e - s + 1)]
    ends = body[offsets[1:]] + 2 * np.arange(1, n + 1)
    out = np.full(body[-1] + 2 * n, SPACE, np.uint8)
    ink = np.ones(len(out), bool)
    ink[np.r_[0, ends[:-1]][:n]] = ink[ends - 1] = False
    ink[body[1:] + 2 * np.repeat(np.arange(n), np.diff(offsets))] = False  # the space after each word
    out[ink] = buf[~IS_SPACE[buf]]
    out[ends - 1] = STOP
    return out, ends


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of streams."""
    ids, held, found, size = [], [], [], 0

    def chunk() -> pa.RecordBatch:
        base = np.cumsum([0, *(len(b) for b, _ in found)])
        lists = lambda x, t: pa.array([x], pa.list_(t))
        body = pa.Codec("zstd", compression_level=6).compress(np.concatenate([b for b, _ in found]), asbytes=True)  # written once, shuffled once
        ends = np.concatenate([e + o for (_, e), o in zip(found, base, strict=False)])
        return pa.RecordBatch.from_arrays(
            [pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([base[-1]], pa.int64()), pa.array([body], pa.binary()), lists(ids, pa.int64()), lists(held, pa.bool_()), lists(ends, pa.int64())],
            names=["chunk", "size", "stream", "doc_id", "held_out", "ends"],
        )

    for b in batches:
        for first, rows, offsets, _, buf, s, e in word_spans(b.column("text")):
            ids += b.column("doc_id").slice(first, rows).to_pylist()
            held += b.column("held_out").slice(first, rows).to_pylist()
            found.append(stream(offsets, buf, s, e))
            size += len(found[-1][0])
            if size >= CHUNK:
                yield chunk()
                ids, held, found, size = [], [], [], 0
    if found:
        yield chunk()


def _chunks(batches: Iterator[pa.RecordBatch] | pa.Table) -> Iterator[tuple[int, np.ndarray, list, np.ndarray, np.ndarray]]:
    """(chunk, stream, doc_ids, held_out, ends) of each row."""
    for b in batches:
        for i in range(b.num_rows):
            get = lambda name, b=b, i=i: b.column(name)[i]
            buf = np.frombuffer(pa.decompress(get("stream").as_buffer(), get("size").as_py(), codec="zstd"), np.uint8)
            yield get("chunk").as_py(), buf, get("doc_id").as_py(), get("held_out").values.to_numpy(zero_copy_only=False), get("ends").values.to_numpy()


def keys(buf: np.ndarray, order: int) -> np.ndarray:
    """Key of each symbol with the order bytes before it; the newest byte is lowest, the length highest."""
    out = np.zeros(len(buf), np.uint64)
    for t in range(order + 1):
        out[t:] |= buf[: len(buf) - t].astype(np.uint64) << np.uint64(8 * t)
    return out | np.uint64(order + 1) << np.uint64(56)


_MASKS = np.array([(1 << 8 * (k + 1)) - 1 for k in range(ORDER + 1)], np.uint64)


def longest(buf: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Key of each symbol with its longest context: the ORDER bytes before it, or those from the document's first space on."""
    order = np.minimum(place, ORDER)
    return (keys(buf, ORDER) & _MASKS[order]) | (order + 1).astype(np.uint64) << np.uint64(56)


def symbols(buf: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys with the longest contexts, documents) of a stream's symbols, PIECE at a time."""
    for a in range(0, len(buf), PIECE):
        back, z = max(0, a - ORDER), min(len(buf), a + PIECE)
        first, last = np.searchsorted(ends, [back, z - 1], "right").tolist()
        sizes = np.diff(np.r_[back, ends[first:last], z])
        place = np.arange(back, z) - np.repeat(np.r_[0, ends][first : last + 1], sizes)
        g = longest(buf[back:z], place)
        there = place > 0
        there[: a - back] = False
        yield g[there], np.repeat(np.arange(first, last + 1), sizes)[there]


def word_keys(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, documents) of a stream's words and end marks."""
    s, e = spans(buf, np.zeros(0, np.int64))
    h = np.empty(len(s), np.uint64)
    long = np.flatnonzero(e - s > LONG_WORD)
    for i in long.tolist():
        h[i] = int.from_bytes(hashlib.blake2b(buf[s[i] : e[i]].tobytes(), digest_size=8).digest(), "little")
    for a, z in zip(np.r_[0, long + 1].tolist(), np.r_[long, len(s)].tolist(), strict=True):
        while a < z:
            to = min(z, max(a + 1, int(np.searchsorted(s, s[a] + PIECE))))
            h[a:to] = span_hashes(buf[s[a] : e[to - 1]], s[a:to] - s[a], e[a:to] - s[a])
            a = to
    h[h == END] = 1
    each = np.arange(len(ends))
    return np.r_[h, np.full(len(ends), END)], np.r_[np.repeat(each, np.diff(np.searchsorted(s, ends), prepend=0)), each]


def bucket_of(k: np.ndarray, buckets: int, words: bool) -> np.ndarray:
    """Words by their hash; symbols by that of the newest LOW + 1 bytes of context."""
    h = k if words else mix((k >> np.uint64(8)) & np.uint64((1 << 8 * (LOW + 1)) - 1))
    return ((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)


HELD = "bucket int, part int, home long, keys binary, n binary"


def _held(n_grams: int, n_words: int, parts: int):
    """Rows (bucket, part, home, keys, n): each distinct symbol with its longest context, and each word, of a chunk, with its training count."""

    def counted_once(g: np.ndarray, trains: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield np.unique(g[trains], return_counts=True)
        other = np.unique(g[~trains])
        yield other, np.zeros(len(other), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for home, buf, _, held, ends in _chunks(batches):
            pieces = (part for g, owner in symbols(buf, ends) for part in counted_once(g, ~held[owner]))
            words, owner = word_keys(buf, ends)
            for found, buckets, base in ((merged(pieces), n_grams, 0), (merged(counted_once(words, ~held[owner])), n_words, n_grams)):
                b = bucket_of(found[0], buckets, base > 0)
                order = np.argsort(b.astype(np.uint16) if buckets < 1 << 16 else b, kind="stable")
                k, n, b = found[0][order], found[1][order], b[order]
                cuts = np.r_[np.flatnonzero(np.diff(b, prepend=-1)), len(b)]
                rows = [(int(b[x]) + base, home % parts, home, packed_keys(k[x:z]), packed(n[x:z])) for x, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                types = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["bucket", "part", "home", "keys", "n"])

    return run


def shorter(g: np.ndarray, order: int) -> np.ndarray:
    """Keys of longer contexts' symbols, cut to contexts of this order."""
    return (g & _MASKS[order]) | np.uint64(order + 1) << np.uint64(56)


def contexts(g: np.ndarray, order: int) -> np.ndarray:
    return (g & _MASKS[ORDER]) >> np.uint64(8) | np.uint64(order) << np.uint64(56)


def counted(grams: np.ndarray, counts: np.ndarray, top: int, lowest: int) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], tuple[np.ndarray, np.ndarray]]:
    """Symbols of contexts and their counts by order, from symbols with their longest contexts; and what they add to the order below."""
    length = (grams >> np.uint64(56)).astype(np.int64)
    out, new, times = {}, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for order in range(top, lowest - 1, -1):
        own = length == order + 1
        both, back = np.unique(np.concatenate([grams[own], new]), return_inverse=True)
        out[order] = both, np.bincount(back, np.concatenate([counts[own], times]), len(both)).astype(np.int64)
        new, times = np.unique(shorter(both, order - 1), return_counts=True) if order else (new[:0], times[:0])
    return out, (new, times)


def totals(g: np.ndarray, c: np.ndarray, order: int) -> tuple[np.ndarray, ...]:
    """Contexts of these symbols; each symbol's context; and of each context its count, its symbols, and those that stood there once."""
    names, back = np.unique(contexts(g, order), return_inverse=True)
    size = len(names)
    return names, back, np.bincount(back, c, size).astype(np.int64), np.bincount(back, minlength=size), np.bincount(back, c == 1, size).astype(np.int64)


def state(total: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Contexts are alike that have about the same count and number of symbols."""
    level = lambda x: np.where(x <= 12, x, 12 + np.floor(2 * np.log2(np.maximum(x, 1) / 12))).astype(np.int64)
    return level(total) * 64 + level(kinds)


def outcomes(total: np.ndarray, kinds: np.ndarray, once: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """States, and how often the next symbol was an escape or not in each.

    This is learned by leaving out each occurrence in turn: it was an escape if its symbol stood
    there once.
    """
    at, back = np.unique(np.concatenate([state(total - 1, kinds - 1), state(total - 1, kinds)]), return_inverse=True)
    return at, np.bincount(back[: len(total)], once, len(at)).astype(np.int64), np.bincount(back[len(total) :], total - once, len(at)).astype(np.int64)


def escapes(total: np.ndarray, kinds: np.ndarray, learned: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The chance that a context's next symbol is new to it, for contexts with these counts."""
    known, new, old = learned
    new, old = np.append(new, 0), np.append(old, 0)
    now = state(total, kinds)
    at = np.minimum(np.searchsorted(known, now), len(known))
    at[np.append(known, -1)[at] != now] = len(known)
    return np.clip((new[at] + kinds / (total + kinds)) / (new[at] + old[at] + 1), 1e-6, 0.98)


class Trie:
    """Probabilities of seen symbols and escape weights of contexts, for each order up to top, as sorted arrays.

    Orders that ``below`` has are taken from it; states' outcomes by order are those ``learned``, or else
    from these contexts alone.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray, top: int = ORDER, below: Trie | None = None, learned: dict | None = None) -> None:
        self.seen: list[tuple[np.ndarray, np.ndarray]] = list(below.seen) if below else []
        self.escape: list[tuple[np.ndarray, np.ndarray]] = list(below.escape) if below else []
        tables, _ = counted(grams, counts, top, len(self.seen))
        for order in range(len(self.seen), top + 1):
            g, c = tables[order]
            if not len(g):
                self.seen.append((g, np.zeros(0)))
                self.escape.append((g, np.zeros(0)))
                continue
            names, back, total, kinds, once = totals(g, c, order)
            escape = escapes(total, kinds, learned[order] if learned else outcomes(total, kinds, once))
            less = self.log_p(g, order - 1, order) if order else np.full(len(g), -np.log(SYMBOLS))
            excluded = np.bincount(back, np.exp(less), len(names))
            self.seen.append((g, np.log((1 - escape[back]) * c / total[back])))
            self.escape.append((names, np.log(np.minimum(escape / np.maximum(1 - excluded, 1e-9), 1.0))))

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        names, values = table
        if not len(names):
            return np.zeros(len(wanted), bool), np.zeros(len(wanted))
        at = np.searchsorted(names, wanted)
        at[at == len(names)] = 0
        return names[at] == wanted, values[at]

    def log_p(self, g: np.ndarray, order: int, given: int) -> np.ndarray:
        """Natural log probability of the symbols of keys g (made with given bytes of context), by contexts of order or less."""
        out, left = np.zeros(len(g)), np.arange(len(g))
        for k in range(order, -1, -1):
            if not len(left):
                return out
            key = shorter(g[left], k)
            hit, p = self._find(self.seen[k], key)
            out[left[hit]] += p[hit]
            left, key = left[~hit], key[~hit]
            known, weight = self._find(self.escape[k], contexts(key, k))
            out[left[known]] += weight[known]
        out[left] -= np.log(SYMBOLS)
        return out


def _tables(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Trained keys and their counts of each row."""
    for k, n in zip(t.column("keys"), t.column("n"), strict=True):
        found, counts = unpacked_keys(k.as_py()), unpacked(n.as_py(), np.int64)
        yield found[counts > 0], counts[counts > 0]


def _merged(key, t):
    found, n = merged(_tables(t))
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "keys": [packed_keys(found)], "n": [packed(n)]})


TRAINED = "bucket int, keys binary, n binary, what int, at array<long>, x array<long>, y array<long>"
#: Rows of a bucket besides its table: counts of symbols of the shortest contexts; words in all and distinct ones; outcomes of an order's states (the order).
TABLE, SHORT, WORDS = -1, -2, -3


def _trained(n_grams: int):
    """A bucket's merged table; what its symbols add to shorter contexts; its states' outcomes by order, or its words' totals."""

    def run(key, t):
        bucket = key[0].as_py()
        found, n = merged(_tables(t))
        rows = [(TABLE, packed_keys(found), packed(n), [], [], [])]
        more = lambda what, *columns: rows.append((what, None, None, *(c.astype(np.int64).tolist() for c in columns)))
        if bucket >= n_grams:
            more(WORDS, np.zeros(1), np.array([n.sum()]), np.array([len(n)]))
        else:
            tables, (new, times) = counted(found, n, ORDER, LOW + 1)
            short = found >> np.uint64(56) <= LOW + 1
            more(SHORT, np.r_[new, found[short]].view(np.int64), np.r_[times, n[short]], np.zeros(len(new) + short.sum()))
            for order, (g, c) in tables.items():
                if len(g):
                    more(order, *outcomes(*totals(g, c, order)[2:]))
        what, k, c, at, x, y = zip(*rows)
        lists = lambda v: pa.array(v, pa.list_(pa.int64()))
        return pa.table({"bucket": pa.array([bucket] * len(rows), pa.int32()), "keys": pa.array(k, pa.binary()), "n": pa.array(c, pa.binary()), "what": pa.array(what, pa.int32()), "at": lists(at), "x": lists(x), "y": lists(y)})

    return run


def _short_trie(rows: pa.Table) -> tuple[Trie, dict]:
    """The trie of contexts of LOW bytes or less, and the outcomes of states of each longer order."""
    what, at, x, y = (rows.column(c).to_numpy() for c in ("what", "at", "x", "y"))
    learned = {}
    for order in range(LOW + 1, ORDER + 1):
        mine = np.flatnonzero(what == order)
        mine = mine[np.argsort(at[mine])]
        learned[order] = at[mine], x[mine], y[mine]
    own = what == SHORT
    return Trie(at[own].view(np.uint64), x[own], LOW), learned


SCORED = "home long, words boolean, keys binary, scores binary"


def _scores(known, n_grams: int):
    """Rows (home, words, keys, scores) for a bucket's rows of some chunks: words' training counts, or natural log probabilities of symbols after their longest contexts."""

    def run(key, t: pa.Table, table: pa.Table) -> pa.Table:
        words = key[0].as_py() >= n_grams
        trained, n = merged(_tables(table))
        each = [unpacked_keys(k.as_py()) for k in t.column("keys")]
        every = np.unique(np.concatenate(each)) if each else np.zeros(0, np.uint64)
        value = np.zeros(len(every))
        if words:
            _, here, there = np.intersect1d(every, trained, assume_unique=True, return_indices=True)
            value[here] = n[there]
        else:
            low, learned = known.value
            far = trained >> np.uint64(56) > LOW + 1
            trie, length = Trie(trained[far], n[far], ORDER, low, learned), (every >> np.uint64(56)).astype(np.int64)
            for order in range(1, ORDER + 1):
                at = np.flatnonzero(length == order + 1)
                value[at] = trie.log_p(every[at], order, order)
        out = [packed(value[np.searchsorted(every, k)]) if words else value[np.searchsorted(every, k)].astype(np.float32).tobytes() for k in each]
        return pa.table({"home": t.column("home"), "words": pa.array([words] * len(each), pa.bool_()), "keys": t.column("keys"), "scores": pa.array(out, pa.binary())})

    return run


def _documents(n: int, v: int):
    """Scores of a chunk's documents: their words' base and their symbols' code lengths, summed."""

    def looked_up(found: pa.Table, words: bool) -> tuple[np.ndarray, np.ndarray]:
        mine = found.filter(found.column("words") if words else pc.invert(found.column("words")))
        k = [unpacked_keys(x.as_py()) for x in mine.column("keys")]
        s = [unpacked(x.as_py(), np.float64) if words else np.frombuffer(x.as_py(), np.float32) for x in mine.column("scores")]
        k, s = np.concatenate(k) if k else np.zeros(0, np.uint64), np.concatenate(s) if s else np.zeros(0)
        order = np.argsort(k)
        return k[order], s[order]

    def run(key, coded: pa.Table, found: pa.Table) -> pa.Table:
        names, log_p = looked_up(found, False)
        words, counts = looked_up(found, True)
        out = []
        for _, buf, ids, held, ends in _chunks(coded.to_batches()):
            score = np.zeros(len(ends))
            for g, owner in symbols(buf, ends):
                if not len(g):
                    continue
                order = np.argsort(g)
                sums = np.bincount(owner[order] - owner[0], log_p[np.searchsorted(names, g[order])])
                score[owner[0] : owner[0] + len(sums)] += sums
            k, owner = word_keys(buf, ends)
            c = counts[np.searchsorted(words, k)]
            add = lambda x, owner=owner, m=len(ends): np.bincount(owner, x, m)
            out.append(pa.table({
                "doc_id": pa.array(ids, pa.int64()), "held_out": held, "n_tokens": np.bincount(owner, minlength=len(ends)), "n_known": add((c > 0).astype(float)).round().astype(np.int64),
                "train_tokens": np.full(len(ends), n), "base_score": add(np.log10((c + 1) / (n + v + 1))), "score": score / math.log(10),
            }))
        return pa.concat_tables(out)

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scored(docs: DataFrame) -> DataFrame:
    """Trains on the rows of docs (doc_id long, text string, held_out boolean) that aren't held out; scores all."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "held_out")
    coded = written(rows.mapInArrow(_coded, CODED), "ppm-coded", compression="none")
    size, chunks = coded.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    n_grams, n_words = (least + size // each for least, each in zip(LEAST, BUCKET, strict=True))
    parts = math.ceil((chunks + 1) / GROUP)
    dealt, back = (n_grams + n_words) * parts, max(1, chunks)  # a task for each bucket of a group of chunks, and for each chunk
    held = written(coded.mapInArrow(_held(n_grams, n_words, parts), HELD), "ppm-held", compression="none")
    whole = held.select("bucket", "part", "keys", "n")
    if parts > 1:
        whole = whole.repartition(dealt, "bucket", "part").groupBy("bucket", "part").applyInArrow(_merged, "bucket int, keys binary, n binary")
    trained = written(whole.repartition(dealt, "bucket").groupBy("bucket").applyInArrow(_trained(n_grams), TRAINED), "ppm-trained", compression="none")
    added = trained.where(F.col("what") != TABLE).select("what", F.explode(F.arrays_zip("at", "x", "y")).alias("r")).groupBy("what", F.col("r.at").alias("at")).agg(F.sum("r.x").alias("x"), F.sum("r.y").alias("y"))
    stats = added.toArrow()
    n, v = next(((r["x"], r["y"]) for r in stats.filter(pc.equal(stats.column("what"), WORDS)).to_pylist()), (0, 0))
    short = spark.sparkContext.broadcast(_short_trie(stats))
    tables = trained.where(F.col("what") == TABLE).select("bucket", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "keys", "n")
    left = held.select("bucket", "part", "home", "keys").repartition(dealt, "bucket", "part").groupBy("bucket", "part")
    right = tables.repartition(dealt, "bucket", "part").groupBy("bucket", "part")
    scores = written(left.cogroup(right).applyInArrow(_scores(short, n_grams), SCORED), "ppm-scores", compression="none")
    drop(held)
    drop(trained)
    texts = coded.withColumnRenamed("chunk", "home").withColumn("chunk", F.col("home")).repartition(back, "home").groupBy("home")
    return texts.cogroup(scores.repartition(back, "home").groupBy("home")).applyInArrow(_documents(n, v), SCORES)


def op3_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))
    return scored(docs.withColumn("held_out", held))
