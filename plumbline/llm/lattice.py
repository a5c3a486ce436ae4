"""Near duplicates of embeddings by E8 lattice hashing.

A table projects unit vectors on sixteen orthonormal random directions and decodes each eight of them
to the nearest point of the E8 lattice; the two points are the cell. A vector stands in its own cell and
probes the neighbouring ones that its second-nearest points make. Cosines are verified in double
precision, so no link is below the threshold.

Equal vectors are one class. In a cell, members are first compared with its least member; then only
pairs of different components are left, and no pair is made within one. Last, direct links are counted
within each component, block against block, which also finds links that no cell held.

Defined cases: vectors that are null, zero, or hold null or non-finite components link with nothing;
vectors of another length than most share no component with these; a null vec_id takes part but
names no component unless all ids of it are null; equal vectors of several rows link with each other;
an empty table gives an empty result; other columns, labels included, are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm.components import components
from plumbline.llm.store import small, written
from plumbline.llm.textkit import mix

COSINE = 0.95
TABLES, BLOCKS, SCALE, SEED = 16, 2, 0.2, 17
#: Vectors of a component that are compared with as many others at a time.
SIDE = 256


def decode_e8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Twice the nearest lattice point of each row, and twice the nearest one of the other coset."""

    def d8(y: np.ndarray) -> np.ndarray:
        near = np.rint(y)
        off = y - near
        odd = np.flatnonzero(near.sum(axis=1).astype(np.int64) & 1)
        worst = np.abs(off[odd]).argmax(axis=1)
        near[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
        return near

    a, b = d8(x), d8(x - 0.5) + 0.5
    swap = (((x - a) ** 2).sum(axis=1) > ((x - b) ** 2).sum(axis=1))[:, None]
    return (2 * np.where(swap, b, a)).astype(np.int64), (2 * np.where(swap, a, b)).astype(np.int64)


def directions(d: int, table: int) -> np.ndarray:
    """8 * BLOCKS orthonormal directions as columns; vectors of fewer dimensions are padded with zeros."""
    rng = np.random.default_rng([SEED, d, table])
    return np.linalg.qr(rng.normal(size=(max(d, 8 * BLOCKS), max(d, 8 * BLOCKS))))[0][:d, : 8 * BLOCKS]


def cells(u: np.ndarray, table: int) -> list[np.ndarray]:
    """Cell keys of unit vectors (rows): their own cell first, then the cells they probe."""
    p = u @ directions(u.shape[1], table) / SCALE
    first, second = zip(*[decode_e8(p[:, 8 * i : 8 * i + 8]) for i in range(BLOCKS)], strict=True)
    weights = mix(np.arange(1, 8 * BLOCKS + 1, dtype=np.uint64)) | np.uint64(1)
    out = []
    for choice in range(1 << BLOCKS):
        point = np.concatenate([(second if choice >> i & 1 else first)[i] for i in range(BLOCKS)], axis=1).astype(np.int64).view(np.uint64)
        out.append(mix((point * weights).sum(axis=1, dtype=np.uint64) + np.uint64(table * 0x1F3D5B79 + u.shape[1])).view(np.int64))
    return out


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, key, unit): the class of equal vectors and the unit vector; null where nothing links."""
    for b in batches:
        keys, units = [], []
        for v in b.column(1):
            x = np.array([np.nan if y is None else y for y in v.as_py()], np.float64) if v.is_valid else np.zeros(0)
            top = np.abs(x).max() if len(x) and np.isfinite(x).all() else 0.0
            if not top:
                keys.append(None)
                units.append(None)
                continue
            keys.append(hashlib.blake2b((x + 0.0).tobytes(), digest_size=16).hexdigest())
            x = x / top
            units.append(x / np.sqrt(x @ x))
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(keys, pa.string()), pa.array(units, pa.list_(pa.float64()))], names=["vec_id", "key", "unit"])


def _matrix(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    return [np.asarray(x.values) for x in column]


def _cell_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        units, ids = _matrix(b.column("unit")), b.column("cid").to_numpy()
        for d in sorted({len(u) for u in units}):
            at = np.array([i for i, u in enumerate(units) if len(u) == d])
            m = np.stack([units[i] for i in at])
            for table in range(TABLES):
                for k, cell in enumerate(cells(m, table)):
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(ids[at]), pa.array(np.full(len(at), k == 0))], names=["cell", "cid", "own"])


#: Cosines so close to the threshold are summed again, exactly, so that each pair is decided alike wherever it is met.
CLOSE = 1e-9


def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each unit vector of a (rows) links with each of b."""
    cosine = a @ b.T
    hit = cosine >= COSINE
    for i, j in zip(*np.nonzero(np.abs(cosine - COSINE) < CLOSE), strict=True):
        hit[i, j] = math.fsum((a[i] * b[j]).tolist()) >= COSINE
    return hit


def _verify(t: pa.Table) -> pa.Table:
    """Of rows (a, cid, unit) with the vector of a among them, the pairs that link."""
    ids, hub, units = t.column("cid").to_numpy(), t.column("a").to_numpy(), _matrix(t.column("unit"))
    home = {int(h): units[i] for i, (h, c) in enumerate(zip(hub, ids, strict=True)) if h == c}
    pairs = [(int(h), int(c)) for h, c, u in zip(hub, ids, units, strict=True) if h != c and len(u) == len(home[int(h)]) and linked(u[None], home[int(h)][None])[0, 0]]
    a = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.table({"a": a[:, 0], "b": a[:, 1]})


def _linked(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """Pairs (a, cid), distinct, that link. A hub of many pairs is split, its vector going to each part."""
    parts = 16
    rows = pairs.select("a", "cid", F.pmod(F.xxhash64("cid"), F.lit(parts)).alias("part"))
    hubs = rows.select("a", F.col("a").alias("cid"), "part").distinct()
    return rows.union(hubs).join(units, "cid").groupBy("a", "part").applyInArrow(_verify, "a long, b long")


def _count_block(t: pa.Table) -> pa.Table:
    """(cid, n) links of a component's side 0 with its side 1, or within side 0 where there is no other."""
    label, side = t.column("label").to_numpy(), t.column("side").to_numpy()
    ids, weight, units = t.column("cid").to_numpy(), t.column("copies").to_numpy(), _matrix(t.column("unit"))
    out_id, out_n = [], []
    for x in np.unique(label):
        zero, one = np.flatnonzero((label == x) & (side == 0)), np.flatnonzero((label == x) & (side == 1))
        if not len(zero):
            continue
        a = np.stack([units[i] for i in zero])
        if len(one):
            hit = linked(a, np.stack([units[i] for i in one]))
            out_id += [ids[zero], ids[one]]
            out_n += [hit @ weight[one], hit.T @ weight[zero]]
        else:
            hit = linked(a, a)
            np.fill_diagonal(hit, False)
            out_id.append(ids[zero])
            out_n.append(hit @ weight[zero])
    return pa.table({"cid": np.concatenate(out_id).astype(np.int64) if out_id else np.zeros(0, np.int64), "n": np.concatenate(out_n).astype(np.int64) if out_n else np.zeros(0, np.int64)})


def _counts(classes: DataFrame, labels: DataFrame) -> DataFrame:
    """(cid, links): direct links with other classes, weighted by their copies, within each component."""
    each = classes.join(labels.withColumnRenamed("node", "cid").withColumnRenamed("component", "label"), "cid").select("cid", "copies", "label", "unit")
    sizes = written(each.groupBy("label").agg(F.ceil(F.count("*") / SIDE).alias("parts"), F.count("*").alias("size")), "lattice-sizes")
    placed = written(each.join(small(sizes), "label"), "lattice-placed")
    tasks = max(1, math.ceil(placed.count() / SIDE))
    one = placed.where("parts = 1").select("cid", "copies", "label", "unit", F.lit(0).alias("side"), F.pmod(F.xxhash64("label"), F.lit(tasks)).alias("i"), F.lit(-1).cast("long").alias("j"))
    # A large component: parts i <= j meet; a part is side 0 in its pairs with later ones and itself.
    cut = placed.where("parts > 1").withColumn("mine", F.pmod(F.xxhash64("cid"), "parts"))
    met = cut.select("cid", "copies", "label", "unit", "mine", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")).select(
        "cid", "copies", "label", "unit", (F.col("mine") > F.col("other")).cast("int").alias("side"),
        F.xxhash64("label", F.least("mine", "other")).alias("i"), F.xxhash64("label", F.greatest("mine", "other")).alias("j"),
    )
    return one.union(met).groupBy("i", "j").applyInArrow(_count_block, "cid long, n long").groupBy("cid").agg(F.sum("n").alias("links"))


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id long, embedding array)."""
    rows = written(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_units, "vec_id long, key string, unit array<double>").withColumn("row_id", F.monotonically_increasing_id()), "lattice-rows")
    light = rows.select("row_id", "vec_id", "key")
    names = written(light.where("key IS NOT NULL").groupBy("key").agg(F.min("row_id").alias("cid"), F.min("vec_id").alias("first_id"), F.count("*").alias("copies")), "lattice-classes")
    classes = written(rows.select("row_id", "unit").join(names.select(F.col("cid").alias("row_id"), "copies"), "row_id").select(F.col("row_id").alias("cid"), "copies", "unit"), "lattice-units")
    units = classes.select("cid", "unit")
    held = written(classes.mapInArrow(_cell_rows, "cell long, cid long, own boolean"), "lattice-cells")
    hubs = written(held.groupBy("cell").agg(F.min(F.when(F.col("own"), F.col("cid"))).alias("a"), F.count_if("own").alias("k")).where("a IS NOT NULL").select("cell", "a"), "lattice-hubs")
    star = held.join(hubs, "cell").where("a <> cid").select("a", "cid").distinct()
    edges = written(_linked(star, units), "lattice-edges")
    labels = components(edges)
    # What is left: cells whose members are in different components, compared across them.
    named = written(held.join(small(labels.withColumnRenamed("node", "cid")), "cid", "left").select("cell", "cid", "own", F.coalesce("component", "cid").alias("label")), "lattice-named")
    mixed = written(named.groupBy("cell").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("cell"), "lattice-mixed")
    still = named.join(mixed, "cell")
    left, right = still.where("own").select("cell", F.col("cid").alias("x"), F.col("label").alias("lx")), still.select("cell", F.col("cid").alias("y"), F.col("label").alias("ly"))
    pairs = left.join(right, "cell").where("lx <> ly").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("cid")).distinct()
    more = written(_linked(pairs, units), "lattice-more")
    if not more.isEmpty():
        labels = components(edges.union(more))
    counts = written(_counts(classes, labels), "lattice-counts")
    known = names.join(labels.withColumnRenamed("node", "cid"), "cid", "left").join(counts, "cid", "left").select("key", "first_id", "copies", F.coalesce("component", "cid").alias("label"), F.coalesce("links", F.lit(0)).alias("links"))
    known = written(known, "lattice-known")
    firsts = written(known.groupBy("label").agg(F.min("first_id").alias("least")), "lattice-firsts")
    known = written(known.join(firsts, "label").select("key", "copies", "links", "least"), "lattice-result")
    component = F.coalesce("least", "vec_id")
    return light.join(known, "key", "left").select(
        "vec_id", F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")
    )


def op10_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: Every pair compared: equal to the operator's result where no pair at the threshold escapes its cells.
OP10_SQL = f"""WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT r, vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.r <> b.r AND len(a.e) = len(b.e) AND a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= {COSINE}),
t AS (SELECT r, r AS o FROM v UNION SELECT t.r, l.b FROM t JOIN l ON l.a = t.o), m AS (SELECT t.r, min(v.vec_id) AS least FROM t JOIN v ON v.r = t.o GROUP BY t.r), c AS (SELECT a AS r, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(c.n, 0)::BIGINT AS n_links, least AS component_id, vec_id = least AS kept FROM v JOIN m USING (r) LEFT JOIN c USING (r)"""
