"""Small fixtures and brute force for each operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import chat, imatch, lattice, mixing, ngram_join, packing, ppm, textkit, token_files, toxicity, warc
from plumbline.llm.components import components
from plumbline.llm.store import written

WORDS = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    out = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 120))) for _ in range(n)]
    for i in range(0, n, 3):  # near copies
        words = out[i].split()
        words[rng.randrange(len(words))] = "changed"
        out.append(" ".join(words))
    return [None, "", " \t\n", "One Two", "one two", *out, out[0], out[0], "x" * 3000, " ".join(vocabulary * 40)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], ["b", "a", None, "c"][i % 4], i) for i, t in enumerate(texts())]
    rows += [(None, "a null id", "en", "a", 0), (5, rows[5][1], "en", "a", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size long")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, size long")


def test_word_hashes_agree_with_regex():
    column = pa.array(["Ab c\tD ab", None, "", "é É", "ab " * 600_000])
    got = {}
    for first, rows, offsets, hashes in textkit.word_hashes(column):
        for i in range(rows):
            got[first + i] = hashes[offsets[i] : offsets[i + 1]].tolist()
    assert [len(got[i]) for i in range(5)] == [4, 0, 0, 2, 600_000]
    assert got[0][0] == got[0][3] == got[4][0] == got[4][-1] and len(set(got[4])) == 1
    assert got[3][0] != got[3][1]  # only A-Z are lower-cased


def test_components(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)]
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    assert got == {x: root(x) for x in up if x in got} and all(root(x) == x for x in up if x not in got)


def test_warc(spark):
    big = "é" * 600
    rows = [(1, "http://a", big), (2, None, big), (3, "http://c\nx", "small"), (4, "u", "small"), (5, "u", None), (None, "u", big), (-7, "u", "z" * 200_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    folder, manifest = warc.write_archives(pages)
    got = {r["page_id"]: r for r in warc.read_archives(spark, folder, manifest).collect()}
    assert len(got) == len(rows)
    for page_id, _, html in rows:
        body = (html or "").encode()
        assert got[page_id]["payload_bytes"] == len(body) and got[page_id]["payload_digest"] == hashlib.sha1(body).hexdigest()
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items() if r["record_type"] == "revisit"} == {1: ("revisit", 2), None: ("revisit", 2)}
    assert warc.read_archives(spark, *warc.write_archives(pages.limit(0))).count() == 0


def test_many_archives(spark):
    rng = random.Random(13)
    rows = [(i, f"http://{i}", "".join(rng.choices("ab <>é", k=rng.choice([0, 10, 1500])))) for i in range(300)]
    rows += [(1000 + i, None, rows[i][2]) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(9)
    folder, manifest = warc.write_archives(pages)
    assert manifest.count() >= 2
    got = {r["page_id"]: r for r in warc.read_archives(spark, folder, manifest).collect()}
    largest = {}
    for i, _, html in rows:
        largest[html] = max(i, largest.get(html, i))
    for i, _, html in rows:
        copy = len(html.encode()) >= 1000 and largest[html] != i
        assert got[i]["payload_digest"] == hashlib.sha1(html.encode()).hexdigest() and (got[i]["record_type"], got[i]["refers_to"]) == (("revisit", largest[html]) if copy else ("response", None))


def test_warc_rejects_broken_archives():
    body = b"payload"
    raw = warc.record(9, "u", body, hashlib.sha1(body).hexdigest(), len(body), None, False)
    assert warc.digest_row(*warc.parse(raw))["page_id"] == 9 and warc.page_id_of(warc.record_id(-5)) == -5 and warc.page_id_of(warc.record_id(None)) is None
    for bad in (raw[:-1], raw.replace(b"payload", b"paylord"), raw.replace(b"WARC/1.1", b"ARC/1.1"), raw.replace(b"WARC-Date", b"X-Date")):
        with pytest.raises(warc.WarcError):
            warc.digest_row(*warc.parse(bad))


def brute_sets(rows):
    out = []
    for t in rows:
        w = WORDS.findall((t or "").translate(LOW))
        out.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    return out


def test_ngram_join(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    sets = brute_sets([r["text"] for r in rows])
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                up[root(i)] = root(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[root(i)].append(r["doc_id"])
    want = Counter((r["doc_id"], len(sets[i]), min((x for x in least[root(i)] if x is not None), default=None)) for i, r in enumerate(rows))
    assert Counter(map(tuple, ngram_join.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect())) == want
    assert ngram_join.near_duplicates(empty(spark)).count() == 0 and ngram_join.one_of_each(empty(spark)).count() == 0
    kept = ngram_join.one_of_each(docs).collect()
    assert Counter(r["doc_id"] for r in kept) == Counter({d: 1 for d, n, c in want if d is None or d == c or n == 0})


def test_one_row_of_each_component_stays(spark):
    rng = random.Random(12)
    a, b, c = ([f"{x}{rng.random()}" for _ in range(60)] for x in "abc")
    near = lambda w, i: " ".join([*w[:i], "changed", *w[i + 1 :]])
    rows = [
        (5, " ".join(a)), (5, near(b, 0)), (5, ""), (5, None), (2, " ".join(b)), (7, near(a, 59)), (8, near(a, 0)), (7, "a text of its own that nothing else is near to"),
        (None, " ".join(c)), (None, near(c, 0)), (None, near(b, 59)), (None, ""), (9, "x y"), (9, "x y"), (9, "X  y"),
    ]
    clash = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id long, text string, seen int, other int, named int, doc int")
    kept = ngram_join.one_of_each(clash)
    assert kept.columns == clash.columns
    have = Counter(map(tuple, kept.select("doc_id", "text").collect()))
    assert sum(n for (i, t), n in have.items() if i is None and t) == 1
    assert have[9, "x y"] + have[9, "X  y"] == (1 if brute_sets(["x y"])[0] else 3)
    rest = Counter({k: n for k, n in have.items() if k[0] != 9 and not (k[0] is None and k[1])})
    assert rest == Counter([rows[0], rows[2], rows[3], rows[4], rows[7], rows[11]])


def test_ngram_join_of_a_large_group(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(400):  # near copies of one text, some too far from most of the others
        w = base[:]
        for _ in range(rng.choice([1, 2, 4, 6])):
            w[rng.randrange(150)] = f"e{i}x{rng.random()}"
        rows.append((i, " ".join(w)))
    sets = brute_sets([t for _, t in rows])
    up = list(range(400))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(400):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: root(i) for i in range(400)}


def test_divide_skip_finds_what_counting_finds():
    rng = random.Random(8)
    arrays = []
    for _ in range(80):
        a = set(rng.sample(range(60), 40))
        arrays.append(np.array(sorted(a)))
    index = ngram_join.BlockIndex(arrays)
    for i, a in enumerate(arrays):
        want = {j for j in range(i) if 9 * len(set(a) & set(arrays[j])) >= 4 * (len(a) + len(arrays[j]))}
        assert set(index.search(a.tolist(), len(a), i, lambda x: False)) == want


def test_ppm(spark, docs):
    held = F.coalesce(F.pmod(F.col("doc_id"), F.lit(4)) == 2, F.lit(False))
    got = ppm.scored(docs.withColumn("held_out", held).withColumn("chunk", F.lit(1)).withColumn("home", F.lit(1))).collect()
    rows = [(r["doc_id"], [*WORDS.findall((r["text"] or "").translate(LOW)), None]) for r in docs.collect()]
    count = Counter(w for i, words in rows if i is None or i % 4 != 2 for w in words)
    n, v = sum(count.values()), len(count)
    want = Counter((i, len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 4)) for i, w in rows)
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert ppm.scored(empty(spark).select("doc_id", "text", F.lit(False).alias("held_out"))).count() == 0
    untrained = ppm.scored(docs.limit(9).withColumn("held_out", F.lit(True))).collect()
    assert len(untrained) == 9 and all(r["train_tokens"] == 0 == r["n_known"] for r in untrained)


def brute_stream(text):
    return b" " + b"".join(w.encode() + b" " for w in WORDS.findall((text or "").translate(LOW))) + b"\n"


def grams_of(body):
    buf = np.frombuffer(body, np.uint8)
    return ppm.longest(buf, np.arange(len(buf)))[1:]


@pytest.mark.parametrize("small", [False, True])
def test_ppm_tries_are_those_of_all_contexts(spark, docs, monkeypatch, small):
    """Scores by tries that lie in buckets, from chunks in groups, equal those by one whole trie."""
    if small:  # the driver's numbers only: chunks of the workers stay as they are
        monkeypatch.setattr(ppm, "GROUP", 1)
        monkeypatch.setattr(ppm, "LEAST", (5, 3))
    held = F.coalesce(F.pmod(F.col("doc_id"), F.lit(4)) == 2, F.lit(False))
    got = ppm.scored(docs.repartition(3).withColumn("held_out", held)).collect()
    rows = [(r["doc_id"], brute_stream(r["text"])) for r in docs.collect()]
    grams = Counter()
    for i, body in rows:
        if i is None or i % 4 != 2:
            grams.update(grams_of(body).tolist())
    trie = ppm.Trie(np.array(list(grams), np.uint64), np.array(list(grams.values()), np.int64))
    want = []
    for i, body in rows:
        g = grams_of(body)
        order = (g >> np.uint64(56)).astype(int) - 1
        want.append((-1 if i is None else i, sum(trie.log_p(g[order == k], k, k).sum() for k in range(1, ppm.ORDER + 1)) / np.log(10)))
    have = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["score"]) for r in got)
    assert len(have) == len(want)
    for (i, x), (j, y) in zip(have, sorted(want)):
        assert i == j and x == pytest.approx(y, rel=1e-4, abs=1e-3)


def test_ppm_streams():
    some = texts()
    column = pa.array([*some, "long " * 500_000])
    for at in (0, 7):
        bodies = []
        for _, _, offsets, _, buf, s, e in textkit.word_spans(column.slice(at)):
            body, ends = ppm.stream(offsets, buf, s, e)
            bodies += [body[a:z].tobytes() for a, z in zip([0, *ends[:-1].tolist()], ends.tolist())]
        assert bodies == [brute_stream(t) for t in column.slice(at).to_pylist()]
    buf, ends = np.frombuffer(b"".join(bodies), np.uint8), np.cumsum([len(b) for b in bodies])
    pieces = list(ppm.symbols(buf, ends))
    assert len(pieces) > 1
    assert np.concatenate([g for g, _ in pieces]).tolist() == [x for b in bodies for x in grams_of(b).tolist()]
    assert np.bincount(np.concatenate([o for _, o in pieces])).tolist() == [len(b) - 1 for b in bodies]
    words, owner = ppm.word_keys(buf, ends)
    assert np.bincount(owner).tolist() == [b.count(b" ") for b in bodies]


def test_ppm_packing_and_merging():
    rng = np.random.default_rng(3)
    parts = [(np.unique(rng.integers(0, 500, 80)).astype(np.uint64), rng.integers(0, 9, 80)) for _ in range(7)]
    parts = [(k, n[: len(k)]) for k, n in parts] + [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    want = Counter()
    for k, n in parts:
        for x, c in zip(k.tolist(), n.tolist()):
            want[x] += c
    got = ppm.merged(iter(parts))
    assert got[0].tolist() == sorted(want) and got[1].tolist() == [want[x] for x in sorted(want)]
    for k, n in (got, parts[-1]):
        assert ppm.unpacked_keys(ppm.packed_keys(k)).tolist() == k.tolist() and ppm.unpacked(ppm.packed(n), np.int64).tolist() == n.tolist()


def test_ppm_contexts_cross_words(spark):
    """A shuffle of a trained passage's words is less likely than the passage."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(200)]
    passage = " ".join(words)
    rows = [(0, passage, False), (1, passage, False), (2, passage, True), (3, " ".join(rng.sample(words, len(words))), True)]
    got = {r["doc_id"]: r for r in ppm.scored(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")).collect()}
    assert got[2]["base_score"] == pytest.approx(got[3]["base_score"])
    assert got[2]["score"] > got[3]["score"] + 50


def test_ppm_is_a_distribution():
    body = brute_stream("the then a that \u00e9 " * 3 + "these")
    g = grams_of(body)
    grams = Counter(g.tolist())
    trie = ppm.Trie(np.array(list(grams), np.uint64), np.array(list(grams.values())))
    for head in (b" ", b" t", b" the", b" zz"):
        k = len(head)
        every = np.array([ppm.keys(np.frombuffer(head + bytes([s]), np.uint8), k)[-1] for s in range(256)], np.uint64)
        total = np.exp(trie.log_p(every, k, k)).sum()
        assert 0.9 < total <= 1.0001


def test_packing(spark, docs):
    rng = random.Random(2)
    sizes = [rng.choice([3, 70, 200, 511, 900, 4000, 8192]) for _ in range(700)]
    put, fill = packing.pack(sizes), defaultdict(int)
    spans = defaultdict(list)
    for size, (b, offset, capacity) in zip(sizes, put):
        fill[b] += size
        spans[b].append((offset, offset + size))
        assert capacity in packing.LENGTHS
    for size, (b, _, capacity) in zip(sizes, put):
        assert fill[b] <= capacity and capacity == min(c for c in packing.LENGTHS if c >= fill[b])
    for x in spans.values():
        x.sort()
        assert x[0][0] == 0 and all(a[1] == b[0] for a, b in zip(x, x[1:]))
    assert packing.pack([]) == []
    assert packing.cost(put) <= min(packing.cost(packing.best_fit(sizes, packing.LENGTHS, o)) for o in [packing.LENGTHS, (1024,), (8192,)])
    for _ in range(30):  # against every way to part a few pieces
        few = [rng.choice([100, 300, 400, 600, 900, 2000]) for _ in range(5)]

        def parted(rest):
            if not rest:
                yield []
                return
            for groups in parted(rest[1:]):
                yield [[rest[0]], *groups]
                for i in range(len(groups)):
                    yield [*groups[:i], [rest[0], *groups[i]], *groups[i + 1 :]]

        least = min(sum(min(c for c in packing.LENGTHS if c >= sum(g)) + packing.OVERHEAD for g in groups) for groups in parted(few) if all(sum(g) <= 8192 for g in groups))
        assert least <= packing.cost(packing.pack(few)) <= 1.4 * least
    got = packing.packed(docs).collect()
    want = Counter({i: n for i, n in Counter().items()})
    for r in docs.collect():
        want[r["doc_id"]] += len(WORDS.findall(r["text"] or "")) + 1
    have = Counter()
    for r in got:
        have[r["doc_id"]] += r["length"]
    assert have == want and max(r["length"] for r in got) <= packing.LENGTHS[-1]
    assert packing.packed(empty(spark)).count() == 0


def test_packed_contents(spark, docs):
    """Bins hold every token once, in order, and the pieces' texts are those of the documents."""
    long = spark.createDataFrame([(7000, " ".join(f"w{i}" for i in range(20_000)))], "doc_id long, text string")
    some = docs.select("doc_id", "text").union(long)
    plan = packing.packed(some, texts=True).collect()
    parts = defaultdict(list)
    for r in plan:
        parts[r["doc_id"]].append((r["piece"], r["text"], r["length"]))
    assert [n for _, _, n in sorted(parts[7000])] == [8192, 8192, 20_001 - 2 * 8192]
    assert " ".join(t for _, t, _ in sorted(parts[7000])) == long.first()["text"]
    texts_of = defaultdict(Counter)
    for r in some.collect():
        texts_of[r["doc_id"]][r["text"]] += 1
    assert all(Counter(t for _, t, _ in parts[i]) == c for i, c in texts_of.items() if all(len((t or "").split()) < 8192 for t in c))
    rows = some.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", F.split(F.coalesce("text", F.lit("")), " ").alias("tokens"))
    rows = written(rows, "test-lists")
    back, lengths = defaultdict(list), (64, 256, 1024)
    for b in packing.bins(rows, lengths).collect():
        assert b["n_tokens"] == len(b["tokens"]) <= b["capacity"] and b["capacity"] in lengths
        at = 0
        for p in b["parts"]:
            assert p["offset"] == at
            at += p["length"]
            back[p["doc_id"]].append((p["piece"], b["tokens"][p["offset"] : at]))
    want, have = defaultdict(list), {i: sorted(t for _, x in ps for t in x) for i, ps in back.items()}
    for r in rows.collect():
        want[r["doc_id"]] += r["tokens"]
    assert have == {i: sorted(t) for i, t in want.items()}
    assert [t for _, x in sorted(back[7000]) for t in x] == long.first()["text"].split(" ")
    full = packing.filling(packing.packed(docs)).first()
    assert 0.5 < full["fill"] <= 1 and full["least"] <= full["cost"] <= 1.3 * full["least"]
    assert packing.bins(rows.limit(0)).count() == 0 and packing.filling(packing.packed(empty(spark))).first()["fill"] == 1.0


def test_tokens(spark, docs):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    assert tokenizer.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    odd = [(905, "z  <|endoftext|>" + " word" * 200_000), (906, "<|endof text|>  "), (907, "a  <|endoftext|>  <|endoftext|> b"), (900, "a  b  c\n\n d  \t e "), (901, "<|endoftext|> it's 3.5  x"), (902, "日本 語 " * 50), (903, " word" * 300_000), (904, "y" * 700_000)]
    all_docs = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    tokens = token_files.read_tokens(spark, token_files.write_tokens(all_docs, path))
    got = Counter((r["doc_id"], r["n_tokens"], tuple(r["ids"])) for r in tokens.collect())
    want = Counter()
    for r in all_docs.collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        want[(r["doc_id"], len(ids), tuple(ids))] += 1
    assert got == want
    checked = tokens.mapInArrow(token_files._checked, "doc_id long, part int, pos long, n_tokens long, ids_crc32 long")
    rows = sorted(token_files.starts(checked).collect(), key=lambda r: r["start"])
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i)
    assert token_files.read_tokens(spark, token_files.write_tokens(empty(spark), path)).count() == 0


def test_pieces_hold_what_a_dictionary_holds():
    rng = np.random.default_rng(9)
    pieces, wanted = token_files.Pieces(), {}
    for step in range(12):
        keys = np.setdiff1d(rng.integers(1, 1 << 62, 3000, dtype=np.uint64) >> np.uint64(step % 3 * 20), np.array([0, *wanted], np.uint64))
        lengths = rng.integers(0, 4, len(keys))
        ids = rng.integers(0, 1000, lengths.sum()).astype(np.int32)
        pieces.add(keys, lengths, ids)
        wanted |= dict(zip(keys.tolist(), np.split(ids, np.cumsum(lengths)[:-1]), strict=True))
    asked = np.array([*wanted, *(k for k in range(1 << 40, (1 << 40) + 500) if k not in wanted)], np.uint64)
    at = pieces.find(asked)
    assert (at[len(wanted) :] == -1).all()
    for k, e in zip(asked[: len(wanted)].tolist(), at.tolist()):
        assert pieces.ids[pieces.starts[e] : pieces.starts[e] + pieces.lengths[e]].tolist() == wanted[k].tolist()


def test_chat(spark):
    said = [(1, 2, "assistant", "b & <|turn|> &lt;|"), (1, 1, "user", "<|end|>"), (1, 3, "assistant", None), (1, 3, "user", "tail <"), (2, 1, None, "|x"), (2, 1, None, "|x"), (None, None, "assistant", "")]
    rows = spark.createDataFrame([(*r, 1) for r in said], "conv_id long, turn long, role string, text string, turns int")
    out = {r["conv_id"]: r for r in chat.formatted(rows).collect()}
    back = {r["conv_id"]: r for r in chat.read_back(chat.formatted(rows)).collect()}
    for conv in (1, 2, None):
        turns = sorted(((t, r or "", x or "") for c, t, r, x in said if c == conv), key=lambda t: (t[0] or 0, t[1], t[2]))
        assert [(t["role"], t["text"]) for t in back[conv]["turns"]] == [t[1:] for t in turns]
        assert back[conv]["loss_text"] == "".join(x for _, r, x in turns if r == "assistant")
    assert out[1]["formatted"].count("<|turn|>") == 3  # two assistant turns were merged
    assert chat.formatted(rows.limit(0)).count() == 0


def test_segments_against_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(1, 40)
        hits = sorted(rng.sample(range(n), rng.randint(0, n)))
        odds = [rng.choice([0.5, 1.0, 3.0]) for _ in hits]
        scores = [-0.75] * n
        for i, s in zip(hits, odds):
            scores[i] = s

        def whole(a, z):  # all maximal-scoring segments: the best one, then those on its left and right
            best = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(a, z) for j in range(i + 1, z + 1)), default=(0,))
            if best[0] <= 0:
                return []
            _, _, _, i, j = best
            return [*whole(a, i), (i, j - 1), *whole(j, z)]

        got = toxicity.segments(hits, odds, -0.75)
        apart = [o + rng.random() for o in odds]  # no two sums are the same: the places are determined
        for i, s in zip(hits, apart):
            scores[i] = s
        assert [(a, z) for a, z, _ in toxicity.segments(hits, apart, -0.75)] == whole(0, n)
        for i, s in zip(hits, odds):
            scores[i] = s
        assert math.isclose(max((s for *_, s in got), default=0), max([0, *(sum(scores[i:j]) for i in range(n) for j in range(i + 1, n + 1))]), abs_tol=1e-9)
        assert sum(s for *_, s in got) == pytest.approx(sum(sum(scores[a : z + 1]) for a, z in whole(0, n)))
        assert all(a[1] < b[0] for a, b in zip(got, got[1:]))


def test_segments_take_linear_time():
    """Hits so far apart that each sum before is lower than the last; and nested ones that link far back."""
    import time

    for gap, n in ((4, 200_000), (1, 200_000)):
        began = time.time()
        got = toxicity.segments(list(range(0, gap * n, gap)), [1.0] * n, -0.75)
        assert time.time() - began < 5 and len(got) == (n if gap == 4 else 1)


def test_toxicity(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(1500):
        w = [f"w{rng.randrange(400)}" for _ in range(rng.randint(20, 80))]
        toxic = i % 8 == 0
        for _ in range(4 if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["vile", "foul", "nasty"]))
        rows.append((i, " ".join(w), 1))
        labels.append((i, int(toxic)))
    rows += [(5000, None, 1), (5001, "", 1), (None, "vile foul nasty vile", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    m = toxicity.fit(docs, spark.createDataFrame([*labels, (None, 1), (9999, None)], "doc_id long, toxic int"))
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, m).collect()}
    wrong = sum((got[i] >= toxicity.THRESHOLD) != bool(y) for i, y in labels if zlib.crc32(str(i).encode()) % 4 == 2)
    assert wrong <= 4 and got[5000] < toxicity.THRESHOLD and got[5001] == got[5000] and got[None] >= toxicity.THRESHOLD
    assert toxicity.without_toxic(docs, m).count() == sum(s < toxicity.THRESHOLD for s in got.values())
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r["score"] for r in toxicity.scored(docs, none).collect()] == pytest.approx([toxicity.THRESHOLD / 2] * len(rows))
    assert toxicity.scored(docs.limit(0), m).count() == 0


def test_mixing(spark, docs):
    plan = mixing.planned(docs).collect()
    by = {r["doc"]["source"]: (r["source_size"], r["target"]) for r in plan}
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = sum(x for x, _ in by.values()), set()
    while True:  # the rule, step by step
        free = [s for s in order if s not in full]
        level = (total - sum(3 * by[s][0] for s in full)) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * by[s][0]}
        if not over:
            break
        full |= over
    for s in order:
        assert by[s][1] == pytest.approx(3 * by[s][0] if s in full else weight[s] * level)
    assert all(r["size"] == len(WORDS.findall(r["doc"]["text"] or "")) and 0 <= r["copies"] <= 3 for r in plan)
    assert Counter(r["doc_id"] for r in mixing.mixed(docs).collect()) == Counter({i: n for i, n in sum((Counter({r["doc"]["doc_id"]: r["copies"]}) for r in plan), Counter()).items() if n})
    assert mixing.mixed(docs).columns == docs.columns and mixing.mixed(empty(spark)).count() == 0


def brute_prints(words):
    """Subset hashes of distinct words' hashes, by the rule."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    out = []
    for level in reversed(range(imatch.LEVELS)):
        for slot in range(imatch.SLOTS):
            there = sorted(signed(h) for h in words if h % 4**level == 0 and h >> imatch.BITS - 4 == slot)
            mark = 42
            for h in there:
                mark = xxhash.xxh64(h.to_bytes(8, "little", signed=True), seed=mark).intdigest()
            out.append(max(1, mark & 0x7FFFFFFF) if there else 0)
    return out


def brute_likeness(a, b, same):
    if a == b and (any(a) or same):
        return 1.0
    seen = [x == y for x, y in zip(a, b) if x or y][: imatch.AIM]
    return sum(seen) / len(seen) if seen else 0.0


def test_imatch(spark, docs):
    rng = random.Random(11)
    rare = [(1000 + i, " ".join(f"r{rng.randrange(5000)}" for _ in range(rng.randint(5, 150)))) for i in range(150)]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame([*rare, (2000, rare[-1][1]), (2001, rare[-1][1])], "doc_id long, text string"))
    got = imatch.fingerprints(docs.select("doc_id", "text", *[F.lit(1).alias(c) for c in ("row", "bucket", "h", "a", "words")])).collect()
    rows = sorted(((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in docs.collect()), reverse=True)
    of = lambda t: {xxhash.xxh64(w.encode(), seed=42).intdigest() % (1 << imatch.BITS) for w in WORDS.findall(t.lower())}
    df = Counter(h for _, t in rows for h in of(t))
    band = {h for h, n in df.items() if imatch.LEAST_DOCS <= n <= max(imatch.LEAST_DOCS, imatch.MOST_SHARE * len(rows))}
    want, prints = Counter(), defaultdict(set)
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        edit = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, b, c = (brute_prints(of(x) & band) for x in (t, edit, after))
        near = [round(brute_likeness(a, x, of(t) == of(y)), 6) for x, y in ((b, edit), (c, after))]
        want[(i, len(t), hashlib.sha256(edit.encode()).hexdigest(), *near)] += 1
        prints[tuple(a) if any(a) else frozenset(of(t))].add(t)
    have = Counter((-1 if r["doc_id"] is None else r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 6), round(r["near_next"], 6)) for r in got)
    assert sum((have - want).values()) <= 2  # rows that repeat a doc_id stand in the order of their texts' hash
    assert len(band) > 50 and len({r["fingerprint"] for r in got}) == len(prints)
    one = imatch.fingerprints(spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert imatch.fingerprints(empty(spark).select("doc_id", "text")).count() == 0


def test_imatch_buckets(spark):
    """Neighbours across many buckets of the id's range."""
    keys = [*range(0, 4000, 3), *range(-50, 0)]
    firsts = sorted(keys[::7] + [max(keys)], reverse=True)
    got = {r["id"]: r["b"] for r in spark.createDataFrame([(k,) for k in keys], "id long").select("id", imatch.bucket_of(F.col("id"), firsts).alias("b")).collect()}
    assert got == {k: max(0, sum(f >= k for f in firsts) - 1) for k in keys}


def test_lattice_ties_and_clashing_names(spark):
    rng = np.random.default_rng(5)
    c = rng.normal(size=8)
    near = c + rng.normal(size=8) * 0.01
    rows = [(None, c.tolist()), (7, c.tolist()), (7, c.tolist()), (9, near.tolist()), (None, [1.0] * 8), (-3, None)]
    names = "vec_id long, embedding array<double>, cid long, key string, unit int, cell int, component int, label int"
    got = sorted(map(tuple, lattice.near_duplicates(spark.createDataFrame([(*r, 1, "k", 1, 1, 1, 1) for r in rows], names)).select("vec_id", "n_links", "component_id", "kept").collect()), key=str)
    assert got == sorted([(None, 3, 7, False), (7, 3, 7, True), (7, 3, 7, True), (9, 3, 7, False), (None, 0, None, True), (-3, 0, -3, True)], key=str)


def test_a_pair_is_decided_alike_in_every_block():
    rng = np.random.default_rng(6)
    a = np.array([1.0, 0.0, 0.0, 0.0])
    b = np.stack([np.array([lattice.COSINE, *(np.sqrt(1 - lattice.COSINE**2) * (v := rng.normal(size=3)) / np.linalg.norm(v))]) for _ in range(200)])
    alone = [bool(lattice.linked(a[None], x[None])[0, 0]) for x in b]
    assert lattice.linked(b, np.stack([a, a]))[:, 0].tolist() == alone == lattice.linked(a[None], b)[0].tolist()


def test_lattice(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 24))
    vectors = [c + rng.normal(size=24) * 0.12 for c in centres for _ in range(6)] + [rng.normal(size=24) for _ in range(100)]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(1000, rows[0][1]), (1001, None), (1002, [0.0] * 24), (1003, [1.0, None]), (1004, [float("nan")] * 24), (1005, []), (1006, [1.0, 2.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    good = [(i, np.array(v)) for i, v in rows if i <= 1000]
    unit = np.stack([v / np.linalg.norm(v) for _, v in good])
    hit = unit @ unit.T >= lattice.COSINE
    np.fill_diagonal(hit, False)
    links = sum(got[i][0] for i, _ in good)
    assert links <= hit.sum() and links >= 0.9 * hit.sum()
    for k, (i, _) in enumerate(good):
        assert got[i][0] <= hit[k].sum()
    assert all(got[i] == (0, i, True) for i in (1001, 1002, 1003, 1004, 1005, 1006))
    assert links == hit.sum()  # then the components are those of all links
    up = list(range(len(good)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in zip(*np.nonzero(np.triu(hit))):
        a, b = sorted((root(a), root(b)))
        up[b] = a
    for k, (i, _) in enumerate(good):
        assert got[i][1:] == (good[root(k)][0], root(k) == k)
    assert lattice.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_e8_decoding_is_nearest():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8))
    first, _ = lattice.decode_e8(x)
    p = first / 2
    whole = np.all(p == np.rint(p), axis=1) | np.all(p - 0.5 == np.rint(p - 0.5), axis=1)
    assert whole.all() and (p.sum(axis=1) % 2 == 0).all()
    assert (((x - p) ** 2).sum(axis=1) <= 1 + 1e-9).all()  # the covering radius is 1


def test_pipeline_of_nothing(spark, tmp_path):
    """Each stage on a table without rows, and on one of texts without words under odd column names."""
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long, seen int, h int, size long, target double, block long"
    blank = [(i, t, None, s, 0, 1, 1, 1, 1.0, 1) for i, (t, s) in enumerate([(None, "a"), ("", None), (" \n", "b"), ("", "a")])]
    for data in ([], blank, [(None, "x y", "en", "a", 3, 1, 1, 1, 1.0, 1)]):
        current = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, current, str(tmp_path))
            assert name == "packing" or after.columns == current.columns
            assert after.count() == len(data), name
            current = written(after, "test-stage")


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    rows = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).withColumnRenamed("size", "n_chars")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    current = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, current, str(tmp_path))
        assert name == "packing" or after.columns == rows.columns
        current = written(after, "test-stage")
    assert current.count() and {r["doc_id"] for r in current.select("doc_id").collect()} <= {r["doc_id"] for r in rows.select("doc_id").collect()}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == current.count()
