"""Volumes of scans as tables: pages, seeds, regions and indexes read, annotations and records written, runs archived and compared.

Files are listed and read by Spark (binaryFile, JSON), so a volume of any size, or many at once, is one
scan. A run is archived as a folder of Parquet tables; its manifest is written last, so a folder without one
is no run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plumbline.functions import documents as docs, geo, keys
from plumbline.sources.sidecars import RING, SCHEMAS, documents, page_of

#: Fixed value: megapixels from which a key map's numbers are read whole.
KEY_MAP_MP = 35.0


def images(spark: SparkSession, *patterns: str) -> DataFrame:
    """(page, path, bytes, rank) of image files; a file that several patterns match comes once, by the first."""
    found = None
    for rank, pattern in enumerate(patterns):
        rows = spark.read.format("binaryFile").load(pattern).select("path", F.col("length").alias("bytes"), F.lit(rank).alias("rank"))
        found = rows if found is None else found.union(rows)
    return found.groupBy("path").agg(F.min("rank").alias("rank"), F.first("bytes").alias("bytes")).select(page_of(F.col("path")).alias("page"), "path", "bytes", "rank")


def list_pages(pages: DataFrame) -> DataFrame:
    """Pages (page, ...) that count: panels stand in for the sheet they were cut from."""
    cut = pages.where(F.contains("page", F.lit("__"))).select(keys.sheet_of(F.col("page")).alias("page")).distinct()
    return pages.join(cut, "page", "left_anti")


def whole_pages(pages: DataFrame, key_maps: DataFrame) -> DataFrame:
    """Sheets (page, ...) with a number, without panels and key maps (key)."""
    numbered = pages.where(~F.contains("page", F.lit("__")) & keys.page_key(F.col("page")).isNotNull())
    return numbered.join(key_maps.select(F.upper("key").alias("key")).distinct(), keys.page_key(F.col("page")) == F.col("key"), "left_anti")


def page_keys(pages: DataFrame) -> DataFrame:
    """(key): distinct keys of sheets."""
    return pages.where(~F.contains("page", F.lit("__"))).select(keys.page_key(F.col("page")).alias("key")).dropna().distinct()


def image_sizes(spark: SparkSession, pattern: str) -> DataFrame:
    """(page, width, height) of JPEG files, by their headers."""
    rows = spark.read.format("binaryFile").load(pattern).select(page_of(F.col("path")).alias("page"), docs.jpeg_size(F.col("content")).alias("s"))
    return rows.select("page", "s.width", "s.height")


def key_map_candidates(pages: DataFrame) -> DataFrame:
    """(page, rank): letter pages, then those numbered 0 and 1; panels of a cut page in place of it."""
    ranked = list_pages(pages.select("page")).select("page", keys.may_be_key_map(keys.sheet_of(F.col("page"))).alias("rank"))
    return ranked.where("rank IS NOT NULL")


def seeds(spark: SparkSession, pattern: str) -> DataFrame:
    """(page, i, text, box: x0, y0, x1, y1, x, y): numbers read on key maps, with their boxes and centres."""
    each = documents(spark, "streets", pattern).select("page", F.posexplode("streets").alias("i", "s"))
    x0, y0, x1, y1 = geo.ring_bbox(F.col("s.polygon"))
    mean = lambda k: F.aggregate(F.transform(F.col("s.polygon"), lambda p: p[k]), F.lit(0.0), lambda t, v: t + v) / F.size("s.polygon")
    return each.where(F.size("s.polygon") > 0).select("page", "i", "s.text", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), mean(0).alias("x"), mean(1).alias("y"))


def point_labels(spark: SparkSession, pattern: str) -> DataFrame:
    """(page, width, height, x, y, text): points labelled by hand."""
    return documents(spark, "labels", pattern).select("page", "width", "height", F.inline("labels"))


def regions(spark: SparkSession, pattern: str) -> DataFrame:
    """(page, key, ring of [lon, lat]): regions of a key map (rings of pixels by key), mapped through its corners."""
    schema = f"width DOUBLE, height DOUBLE, corners {RING}, regions MAP<STRING, ARRAY<{RING}>>"
    each = spark.read.schema(schema).option("multiLine", True).json(pattern).select(page_of(F.col("_metadata.file_path")).alias("page"), "width", "height", "corners", F.explode("regions").alias("key", "rings"))
    at = lambda p: F.array(*geo.through_corners(F.col("corners"), F.col("width"), F.col("height"), p[0], p[1]))
    return each.where(F.size("corners") == 4).select("page", "key", "width", "height", "corners", F.explode("rings").alias("ring")).select("page", "key", F.transform("ring", at).alias("ring"))


def above_floor(width: Column, height: Column, megapixels: float = KEY_MAP_MP) -> Column:
    """Whether a key map is large enough to be trusted; one of unknown size is."""
    return F.coalesce(width * height / 1e6 >= megapixels, F.lit(True))


def panel_rings(panels: DataFrame, sources: DataFrame) -> DataFrame:
    """(page, panel, ring): panels (page, panel, ring, width, height) scaled to their source's size (page, source_width, source_height)."""
    both = panels.join(sources, "page", "left")
    kx, ky = F.coalesce(F.col("source_width") / F.col("width"), F.lit(1.0)), F.coalesce(F.col("source_height") / F.col("height"), F.lit(1.0))
    return both.select("page", "panel", F.transform("ring", lambda p: F.array(p[0] * kx, p[1] * ky)).alias("ring"))


def by_source(items: DataFrame) -> DataFrame:
    """(page, items): annotations (source, label, ...) by the sheet their image service or label names."""
    key = keys.sheet_of(keys.source_page_key(F.col("source"), F.coalesce("label", F.lit(""))))
    return items.withColumn("page", key).where("page <> ''").groupBy("page").agg(F.collect_list(F.struct(*items.columns)).alias("items"))


def filled_sources(items: DataFrame) -> DataFrame:
    """Items (volume, page, source) whose volume names its services in one way, the missing ones by that way."""
    pattern = r"^(.*)-(\d+)([A-Za-z]*)$"
    known = items.where(F.coalesce("source", F.lit("")) != "").select("volume", F.regexp_extract("source", pattern, 1).alias("prefix"), F.length(F.regexp_extract("source", pattern, 2)).alias("width"), F.col("source").rlike(pattern).alias("dashed"))
    way = known.groupBy("volume").agg(F.countDistinct("prefix", "width").alias("ways"), F.min("dashed").alias("dashed"), F.min("prefix").alias("prefix"), F.min("width").alias("width")).where("ways = 1 AND dashed").select("volume", "prefix", "width")
    number, letter = F.regexp_extract("page", r"^p(\d+)([a-z]?)$", 1), F.regexp_extract("page", r"^p(\d+)([a-z]?)$", 2)
    made = F.when(number != "", F.concat(F.col("prefix"), F.lit("-"), F.when(F.length(number) >= F.col("width"), number).otherwise(F.lpad(number, F.col("width"), F.lit("0"))), F.upper(letter)))
    return items.join(way, "volume", "left").select("volume", "page", F.coalesce(F.nullif("source", F.lit("")), made).alias("source"))


def manifest_canvases(spark: SparkSession, pattern: str) -> DataFrame:
    """(label, service, width, height, position) of a manifest's canvases, at full size where it names a smaller one by percent."""
    schema = "label STRING, sequences ARRAY<STRUCT<canvases: ARRAY<STRUCT<label: STRING, images: ARRAY<STRUCT<resource: STRUCT<`@id`: STRING, width: DOUBLE, height: DOUBLE, service: STRUCT<`@id`: STRING>>>>>>>>"
    each = spark.read.schema(schema).option("multiLine", True).json(pattern).select(F.col("label").alias("volume"), F.posexplode(F.col("sequences")[0]["canvases"]).alias("position", "c"))
    r = F.col("c.images")[0]["resource"]
    scale = F.coalesce(100 / F.nullif(F.regexp_extract(r["@id"], r"/pct:(\d+)/", 1), F.lit("")).cast("double"), F.lit(1.0))
    return each.select(F.concat_ws(" | ", "volume", "c.label").alias("label"), r["service"]["@id"].alias("service"), F.bround(r["width"] * scale).cast("int").alias("width"), F.bround(r["height"] * scale).cast("int").alias("height"), "position")


def download_targets(canvases: DataFrame, folder: Column) -> DataFrame:
    """(folder, page, service, position): a file for each canvas (service, label, position); keys that stand twice in a folder get letters that no other key has taken.

    More than 26 of one key are an error.
    """
    named = canvases.select(folder.alias("folder"), keys.canvas_page_key(F.col("service"), F.col("label")).alias("base"), "service", "position")
    n = Window.partitionBy("folder", "base")
    named = named.withColumn("n", F.count("*").over(n)).withColumn("at", F.row_number().over(n.orderBy("position")))
    letters = F.array(*[F.lit(chr(97 + i)) for i in range(26)])
    taken = named.select("folder", F.col("base").alias("other")).distinct()
    tried = named.where("n > 1").select("folder", "base").distinct().select("folder", "base", F.explode(letters).alias("letter")).withColumn("other", F.concat("base", "letter"))
    free = tried.join(taken, ["folder", "other"], "left_anti").withColumn("at", F.row_number().over(Window.partitionBy("folder", "base").orderBy("letter"))).select("folder", "base", "at", "other")
    both = named.join(free, ["folder", "base", "at"], "left")
    page = F.when(F.col("n") == 1, F.col("base")).when(F.col("other").isNotNull(), F.col("other")).otherwise(F.raise_error(F.concat(F.lit("more than 26 canvases collide on "), F.col("base"))).cast("string"))
    return both.select("folder", page.alias("page"), "service", "position")


def sheet_units(pages: DataFrame, sizes: DataFrame, poses: DataFrame, truth: DataFrame, key_map: DataFrame) -> DataFrame:
    """A row for each page (page) with its size (page, width, height), pose (page, corners, status), truth (page, truth) and place on the key map (page, lon, lat), null where there is none."""
    rows = pages.select("page")
    for other in (sizes, poses, truth, key_map):
        rows = rows.join(other.dropDuplicates(["page"]), "page", "left")
    return rows


def channel_records(snap: DataFrame, street: DataFrame) -> DataFrame:
    """(page, snap, street): the two channels' records (target, ...) of each page."""
    one = lambda df, name: df.select(F.col("target").alias("page"), F.struct(*df.columns).alias(name))
    return one(snap, "snap").join(one(street, "street"), "page", "full")


def published(pages: DataFrame, chosen: DataFrame) -> DataFrame:
    """(page, corners, status): exactly one row for each page (page): its chosen pose (page, corners), or none, as a decision."""
    return pages.select("page").distinct().join(chosen.dropDuplicates(["page"]), "page", "left").select("page", "corners", F.when(F.col("corners").isNotNull(), "fitted").otherwise("unplaced").alias("status"))


def annotation(page: Column, source: Column, label: Column, width: Column, height: Column, points: Column, mask: Column, metadata: Column) -> Column:
    """A IIIF annotation: points (array of px, py, lon, lat) on a source of a size, masked by a ring of its pixels (the whole where null)."""
    panel = keys.split_index(page)
    canvas = F.concat(F.regexp_replace(source, "(/info\\.json)?/?$", ""), F.when(panel.isNotNull(), F.concat(F.lit("__"), panel)).otherwise(""))
    corner = lambda x, y: F.array(x.cast("double"), y.cast("double"))
    whole = F.array(corner(F.lit(0), height), corner(F.lit(0), F.lit(0)), corner(width, F.lit(0)), corner(width, height), corner(F.lit(0), height))
    feature = lambda p: F.struct(F.lit("Feature").alias("type"), F.struct(F.array(F.round(p["px"], 1), F.round(p["py"], 1)).alias("resourceCoords")).alias("properties"), F.struct(F.lit("Point").alias("type"), F.array(p["lon"], p["lat"]).alias("coordinates")).alias("geometry"))
    target = F.struct(F.struct(source.alias("id"), F.lit("ImageService2").alias("type"), width.alias("width"), height.alias("height")).alias("source"), F.struct(F.lit("SvgSelector").alias("type"), docs.svg_polygon(F.coalesce(mask, whole)).alias("value")).alias("selector"))
    body = F.struct(F.lit("FeatureCollection").alias("type"), F.struct(F.lit("helmert").alias("type")).alias("transformation"), F.transform(points, feature).alias("features"))
    return F.struct(F.concat(canvas, F.lit("/georef")).alias("id"), F.lit("Annotation").alias("type"), label.alias("label"), metadata.alias("metadata"), target.alias("target"), body.alias("body"))


def panel_points(points: Column, box: Column, width: Column, height: Column) -> Column:
    """Points (px, py, lon, lat) of a panel of some size, as pixels of the sheet on which it fills the box (x, y, w, h)."""
    return F.transform(points, lambda p: F.struct((box["x"] + p["px"] * box["w"] / width).alias("px"), (box["y"] + p["py"] * box["h"] / height).alias("py"), p["lon"].alias("lon"), p["lat"].alias("lat")))


def write_page_documents(rows: DataFrame, path: str) -> None:
    """Rows (volume, page, ...) as JSON, a folder for each volume and page; those there before are replaced."""
    rows.write.mode("overwrite").partitionBy("volume", "page").json(path)


def write_panels(panels: DataFrame, path: str) -> None:
    """Panels (volume, page, panel, ring, width, height) as a document for each page, in reading order: rows of 50 pixels, then from the left."""
    _, y0, _, _ = geo.ring_bbox(F.col("ring"))
    x0 = geo.ring_bbox(F.col("ring"))[0]
    each = F.sort_array(F.collect_list(F.struct(F.rint(y0 / 50).alias("row"), x0.alias("x"), F.col("panel"), F.col("ring"))))
    write_page_documents(panels.groupBy("volume", "page").agg(F.first("width").alias("width"), F.first("height").alias("height"), F.transform(each, lambda p: p["ring"]).alias("panels")), path)


def write_report(rows: DataFrame, missing: DataFrame, path: str) -> None:
    """Compared pages, then missing ones, as tab-separated text with a header."""
    both = rows.withColumn("missing", F.lit(False)).unionByName(missing.withColumn("missing", F.lit(True)), allowMissingColumns=True)
    both.repartitionByRange("missing", "page").sortWithinPartitions("missing", "page").write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_key_maps(found: DataFrame, path: str) -> None:
    """(volume, keys): each volume's key maps in page order."""
    at = F.array_sort(F.collect_list(F.struct(keys.sort_key(F.col("key")).alias("at"), F.col("key"))))
    found.groupBy("volume").agg(F.transform(at, lambda s: s["key"]).alias("keys")).write.mode("overwrite").json(path)


def demoted(poses: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Poses (page, ..., status, status_detail) with the verdicts (page, verdict, detail map) of some recorded; details add to those there."""
    both = poses.join(verdicts.dropDuplicates(["page"]), "page", "left")
    none = F.create_map().cast("map<string,string>")
    detail = F.when(F.col("detail").isNotNull(), F.map_from_entries(F.concat(F.filter(F.map_entries(F.coalesce("status_detail", none)), lambda e: ~F.map_contains_key("detail", e["key"])), F.map_entries("detail")))).otherwise(F.col("status_detail"))
    return both.withColumn("status", F.coalesce("verdict", "status")).withColumn("status_detail", detail).drop("verdict", "detail")


def with_rejected(poses: DataFrame, rejected: DataFrame) -> DataFrame:
    """Poses (page, ..., rejected array of JSON) with further set-aside poses (page, pose JSON) after those there, in order of their text."""
    more = rejected.groupBy("page").agg(F.sort_array(F.collect_list("pose")).alias("more"))
    none = F.array().cast("array<string>")
    return poses.join(more, "page", "left").withColumn("rejected", F.concat(docs.rejected_poses(F.col("rejected")), F.coalesce("more", none))).drop("more")


def file_digests(spark: SparkSession, pattern: str) -> DataFrame:
    """(page, name, digest) of files by their contents."""
    rows = spark.read.format("binaryFile").load(pattern)
    return rows.select(page_of(F.col("path")).alias("page"), F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("digest"))


def gathered_inputs(digests: DataFrame, pages: DataFrame) -> DataFrame:
    """(n, digest): one digest of the files (page, name, digest) of the pages that count (page); of all files where there is no page."""
    used = digests.join(list_pages(pages).select("page").distinct(), "page", "left_semi")
    used = digests if pages.isEmpty() else used
    return used.agg(F.count("*").alias("n"), keys.files_digest(F.col("name"), F.col("digest")).alias("digest"))


def archive_run(tables: dict[str, DataFrame], manifest: DataFrame, path: str) -> None:
    """A run's tables, then its manifest: a folder without one is no run."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def archive_streets(contents: DataFrame, store: str) -> DataFrame:
    """Writes the contents (name, digest, content) that the store doesn't hold; (name, digest) tells what each name stands for."""
    spark = contents.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(store)
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    new = contents.dropDuplicates(["digest"]).select("digest", "content")
    if there:
        new = new.join(spark.read.schema("digest string, content binary").parquet(store).select("digest"), "digest", "left_anti")
    new.write.mode("append").parquet(store)
    return contents.select("name", "digest")


def is_complete(spark: SparkSession, path: str) -> bool:
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def archive_differs(manifests: DataFrame, inputs: Column, commit: Column, flags: Column) -> DataFrame:
    """manifests (run, inputs, commit, flags) with why each can't stand for a run of these: null where it can."""
    why = F.when(F.col("run").isNull(), "an unreadable manifest").when(~F.col("inputs").eqNullSafe(inputs), "inputs (reads, centerlines or truth)")
    why = why.when((F.col("commit") != "") & (commit != "") & (F.col("commit") != commit), F.concat(F.lit("a different commit ("), F.substring("commit", 1, 8), F.lit(")")))
    return manifests.withColumn("differs", why.when(~keys.flags_for_hash(F.coalesce("flags", F.array().cast("array<string>"))).eqNullSafe(keys.flags_for_hash(flags)), "different flags"))


def pending(pages: DataFrame, done: DataFrame) -> DataFrame:
    """Pages (page, modified) whose output (page, modified) is missing or older."""
    old = done.select("page", F.col("modified").alias("made"))
    return pages.join(old, "page", "left").where(F.col("made").isNull() | (F.col("made") < F.col("modified"))).drop("made")


def is_fresh(record: Column, params: Column, needed: Column) -> Column:
    """Whether a record made with some parameters (map) can be used where others are needed: it agrees in all of them."""
    agrees = lambda e: record.isNotNull() & F.try_element_at(params, e["key"]).eqNullSafe(e["value"])
    return F.forall(F.map_entries(needed), agrees)


def parse_compare(lines: DataFrame) -> DataFrame:
    """(page, rmse, rotation, scale) of a comparison report's lines (line): rows that start with a page and hold numbers."""
    parts = F.split(F.trim("line"), r"\s+")
    number = lambda i: F.regexp_replace(F.get(parts, F.lit(i)), "[^0-9.eE+-]", "").try_cast("double")
    rows = lines.select(F.get(parts, F.lit(0)).alias("page"), number(1).alias("rmse"), number(2).alias("rotation"), number(3).alias("scale"))
    return rows.where(F.col("page").rlike(r"^p\d+\w*$") & F.col("rmse").isNotNull())


def schema_of(kind: str) -> str:
    return SCHEMAS[kind]
