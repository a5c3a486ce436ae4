"""Page keys, page specs and text filters as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

#: A page number with its letters.
KEY = r"^(\d+)([A-Za-z]*)"
#: The printed scale note, the feet an inch it may name, and the least confidence of a read.
NOTE, NOTE_FEET, NOTE_CONFIDENCE = r"(?i)\b([0-9IO]{2,3})\s*FT\.?\s*TO\s*ONE\s*INCH", (25, 50, 100, 200, 300, 400, 600), 0.2


def sort_key(key: Column) -> Column:
    """Struct (number, letters) that sorts 35 < 35A < 36; what is no page number comes last, as text."""
    number = F.nullif(F.regexp_extract(key, KEY, 1), F.lit("")).cast("long")
    return F.struct(F.coalesce(number, F.lit(1 << 31)).alias("number"), F.when(number.isNull(), key).otherwise(F.regexp_extract(key, KEY, 2)).alias("letters"))


def page_spec(spec: Column) -> Column:
    """Sorted distinct keys of a spec as 1-3,5,33A; an invalid part raises an error, an empty spec gives no keys."""
    parts = F.filter(F.transform(F.split(spec, ","), lambda p: F.trim(p)), lambda p: p != "")
    bound = lambda p, i: F.trim(F.element_at(F.split(p, "-", 2), i)).cast("long")
    span = lambda p: F.transform(F.sequence(F.least(bound(p, 1), bound(p, 2)), F.greatest(bound(p, 1), bound(p, 2))), lambda n: n.cast("string"))
    single = lambda p: F.when(p.rlike(r"^\d+[A-Za-z]{0,2}$"), F.array(F.upper(p))).otherwise(F.raise_error(F.concat(F.lit("invalid page token: "), p)).cast("array<string>"))
    keys = F.array_distinct(F.flatten(F.transform(parts, lambda p: F.when(F.contains(p, F.lit("-")), span(p)).otherwise(single(p)))))
    return F.transform(F.array_sort(F.transform(keys, lambda k: F.struct(sort_key(k).alias("at"), k.alias("key")))), lambda s: s["key"])


def sheet_of(key: Column) -> Column:
    return F.substring_index(key, "__", 1)


def split_index(key: Column) -> Column:
    """The panel's number in p59__2; null for an unsplit page and for what is no number."""
    return F.when(F.contains(key, F.lit("__")), F.split(key, "__").getItem(1).try_cast("int"))


def svg_points(svg: Column) -> Column:
    """Points [x, y] of a polygon's points="x,y x,y"; those that don't parse are left out."""
    tokens = F.split(F.trim(F.regexp_extract(svg, 'points="([^"]*)"', 1)), r"\s+")
    point = lambda t: F.array(*[F.trim(F.get(F.split(t, ",", 2), F.lit(i))).try_cast("double") for i in (0, 1)])
    return F.filter(F.transform(tokens, point), lambda p: p[0].isNotNull() & p[1].isNotNull())


def matches_query(text: Column, query: str) -> Column:
    """Whether any of the terms, split at commas, stands in the text as words, whatever its case; no terms match all."""
    terms = [t for t in map(str.strip, query.split(",")) if t]
    word = "[A-Za-z0-9_]"  # a word's edge is one of ASCII, unlike Java's
    ends = lambda t: f"(?<!{word})" * bool(re.match(word, t)) + re.escape(t) + f"(?!{word})" * bool(re.search(f"{word}$", t))
    return text.rlike("(?iu)" + "|".join(map(ends, terms))) if terms else F.lit(True)


def scale_note(text: Column, confidence: Column) -> Column:
    """Feet an inch that a printed note names; null where the text is none, the number unknown or the read unsure."""
    feet = F.translate(F.upper(F.regexp_extract(text, NOTE, 1)), "IO", "10").try_cast("int")
    return F.when(feet.isin(*NOTE_FEET) & (F.coalesce(confidence, F.lit(0.0)) >= NOTE_CONFIDENCE), feet)


def combined_digest(digests: Column) -> Column:
    """Aggregate: one digest of a group's digests, whatever their order."""
    return F.sha2(F.array_join(F.sort_array(F.collect_list(digests)), ""), 256)


#: Flags whose value doesn't change a run's output; numbers of pages that may be key maps.
RUN_FLAGS, KEY_MAP_NUMBERS = ("--num-workers",), (0, 1)


def _or_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def page_number(stem: Column) -> Column:
    return _or_null(F.regexp_extract(stem, r"\d+", 0)).cast("long")


def page_key(stem: Column) -> Column:
    """The digits and up to two letters of a page id or printed text, upper case; null without digits."""
    return _or_null(F.upper(F.regexp_extract(stem, r"\d+[A-Za-z]{0,2}", 0)))


def key_stem(key: Column) -> Column:
    return F.coalesce(_or_null(F.regexp_extract(key, r"^\d+", 0)), key)


def georef_variant(name: Column) -> Column:
    """Struct (stem, variant) of a pose file; null for other names."""
    pattern = r"^(p\w+)\.georef(?:-(\w+))?\.json$"
    stem = _or_null(F.regexp_extract(name, pattern, 1))
    return F.when(stem.isNotNull(), F.struct(stem.alias("stem"), F.coalesce(_or_null(F.regexp_extract(name, pattern, 2)), F.lit("canonical")).alias("variant")))


def sheet_label(stem: Column) -> Column:
    """Struct (label, panel) of a page image's stem; null for what is no page."""
    pattern = r"(?i)^p(\d+[a-z]?)(?:__(\d+))?$"
    label = _or_null(F.upper(F.regexp_extract(stem, pattern, 1)))
    return F.when(label.isNotNull(), F.struct(label.alias("label"), _or_null(F.regexp_extract(stem, pattern, 2)).cast("int").alias("panel")))


def normalize_label(text: Column) -> Column:
    return F.upper(F.trim(text))


def without_signs(label: Column) -> Column:
    """What a label would be without stray signs; null if it has none."""
    bare = F.regexp_replace(label, "[^0-9A-Z]", "")
    return F.when(bare != label, bare)


def label_page_key(label: Column) -> Column:
    """The page that an annotation's label ends with, as p428__2; null if it names none."""
    last = F.trim(F.substring_index(label, "|", -1))
    pattern = r"(?i)\b(p\d+[a-z]?|p[a-z]{1,2})(?:\s*\[(\d+)\])?$"
    page, panel = _or_null(F.lower(F.regexp_extract(last, pattern, 1))), _or_null(F.regexp_extract(last, pattern, 2))
    return F.when(panel.isNotNull(), F.concat(page, F.lit("__"), panel)).otherwise(page)


def source_page_key(source_id: Column, label: Column) -> Column:
    """The page of an image service: its number of five digits and a sign, its number after a dash, or what follows the last dash; else that of the label."""
    panel = F.coalesce(F.concat(F.lit("__"), _or_null(F.regexp_extract(label, r"\[(\d+)\]$", 1))), F.lit(""))
    source = F.regexp_replace(source_id, "/info\\.json$", "")
    number = lambda pattern: F.regexp_extract(source, pattern, 1).try_cast("long").cast("string")
    coded, dashed = r"(?i):sb(\d{5})([a-z0-9])$", r"-(\d+)([a-zA-Z]?)$"
    letter = F.lower(F.regexp_extract(source, coded, 2))
    last = F.substring_index(F.substring_index(source, ":", -1), "-", -1)
    key = F.when(source.rlike(coded), F.concat(F.lit("p"), number(coded), F.when(letter == "0", "").otherwise(letter)))
    key = key.when(source.rlike(dashed), F.concat(F.lit("p"), number(dashed), F.regexp_extract(source, dashed, 2))).otherwise(last)
    return F.when(F.coalesce(source_id, F.lit("")) == "", F.coalesce(label_page_key(label), F.lit(""))).otherwise(F.concat(key, panel))


def service_page_key(url: Column, label: Column) -> Column:
    """The same, with the letter of a dashed number in lower case."""
    key = source_page_key(url, label)
    return F.when(key.rlike(r"^p\d+[A-Z](__|$)"), F.lower(key)).otherwise(key)


def canvas_page_key(canvas: Column, label: Column) -> Column:
    last = F.substring_index(canvas, ":", -1)
    return F.when(last.rlike(r"(?i)-\d|^sb\d"), source_page_key(canvas, label)).otherwise(last)


def two_page_number(name: Column) -> Column:
    """The left page's number of a scan of two pages; null for other names."""
    stem = F.substring_index(F.substring_index(name, "/", -1), ".", 1)
    n = _or_null(F.regexp_extract(stem, r"^sb(\d+)$", 1)).try_cast("long")
    return F.when(stem.rlike("^sb0+1d$"), F.lit(1).cast("long")).when(F.pmod(n, F.lit(10)) == 0, F.floor(n / 10))


def georef_page_key(path: Column) -> Column:
    """The page of a pose file, whatever its variant; null for other files."""
    pattern = r"(?i)(?:\b|_)(p\d+)([a-z]*)((?:__\d+)?)(?:\.[^.]+)?\.georef(?:2|-[a-z0-9-]+)?\.json$"
    part = lambda i: F.regexp_extract(path, pattern, i)
    return F.when(path.rlike(pattern), F.concat(part(1), F.lower(part(2)), part(3)))


def is_text_veto(letters: Column, letter_confidence: Column, digit_confidence: Column) -> Column:
    """Whether a read with letters shows that a box holds text and no number."""
    compact = F.replace(letters, F.lit(" "), F.lit(""))
    n = F.char_length(F.regexp_replace(compact, r"[^\p{L}]", ""))
    return (compact != "") & (letter_confidence > digit_confidence) & ((n >= 3) | (n / F.nullif(F.char_length(compact), F.lit(0)) >= 0.7))


def is_lost_digits(read: Column, key: Column) -> Column:
    """Whether a key's digits hold those of a read in order, and more."""
    digits = lambda c: F.regexp_replace(c, r"\D", "")
    pattern = F.regexp_replace(digits(read), r"(\d)", "$1.*")
    return (digits(read) != "") & (F.char_length(digits(key)) > F.char_length(digits(read))) & F.rlike(digits(key), pattern)


def page_spec_text(keys: Column) -> Column:
    """Distinct keys as a spec: runs of whole numbers as 1-3, then lettered keys in page order."""
    once = lambda value, made: F.transform(F.array(value), made)[0]
    whole = F.array_sort(F.array_distinct(F.transform(F.filter(keys, lambda k: k.rlike(r"^\d+$")), lambda k: k.cast("long"))))
    lettered = F.array_distinct(F.transform(F.filter(keys, lambda k: ~k.rlike(r"^\d+$")), F.upper))
    rest = F.transform(F.array_sort(F.transform(lettered, lambda k: F.struct(sort_key(k).alias("at"), k.alias("key")))), lambda s: s["key"])
    name = lambda a, z: F.when(a == z, a.cast("string")).otherwise(F.concat_ws("-", a.cast("string"), z.cast("string")))

    def runs(ns: Column) -> Column:
        ends = F.filter(F.transform(ns, lambda n, i: F.when(F.coalesce(F.get(ns, i + 1) == n + 1, F.lit(False)), F.lit(None)).otherwise(i)), lambda i: i.isNotNull())
        return once(ends, lambda es: F.transform(es, lambda z, j: name(F.get(ns, F.when(j == 0, 0).otherwise(F.get(es, j - 1) + 1)), F.get(ns, z))))

    return F.array_join(F.concat(once(whole, runs), rest), ",")


def without_skeletons(keys: Column) -> Column:
    """Keys without those of a stripped copy (201S) whose page (201) is there."""
    return F.filter(keys, lambda k: ~(k.rlike(r"(?i)^\d+S$") & F.array_contains(keys, F.regexp_replace(k, ".$", ""))))


def flags_for_hash(flags: Column) -> Column:
    """A run's flags without those, and their values, that don't change its output."""
    dropped = F.aggregate(
        flags, F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("skip")),
        lambda s, t: F.when(s["skip"], F.struct(s["kept"].alias("kept"), F.lit(False).alias("skip")))
        .when(t.isin(*RUN_FLAGS), F.struct(s["kept"].alias("kept"), F.lit(True).alias("skip")))
        .otherwise(F.struct(F.concat(s["kept"], F.array(t)).alias("kept"), F.lit(False).alias("skip"))),
    )
    return dropped["kept"]


def config_hash(flags: Column, inputs: Column) -> Column:
    """Eight hex digits over a run's flags and its inputs (a map of names to digests) in order of names."""
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries(inputs)), lambda e: F.concat(quoted(e["key"]), F.lit(": "), quoted(e["value"]))), ", ")
    body = F.concat(F.lit('{"flags": ['), F.array_join(F.transform(flags_for_hash(flags), quoted), ", "), F.lit('], "inputs": {'), pairs, F.lit("}}"))
    return F.substring(F.sha2(body, 256), 1, 8)


def files_digest(name: Column, digest: Column) -> Column:
    """Aggregate: one digest of files by their names and contents, whatever their order."""
    parts = F.concat(name, F.decode(F.unhex(F.lit("00")), "UTF-8"), F.regexp_replace(digest, "^sha256:", ""))
    return F.concat(F.lit("sha256:"), F.sha2(F.array_join(F.sort_array(F.collect_list(parts)), "\n"), 256))


def may_be_key_map(stem: Column) -> Column:
    """Order among candidates for key maps: letter pages first, then those numbered 0 and 1; null for panels and other pages."""
    return F.when(F.contains(stem, F.lit("__")), F.lit(None)).when(stem.rlike("^p[A-Za-z]+$"), -1).when(page_number(stem).isin(*KEY_MAP_NUMBERS), page_number(stem).cast("int"))


def is_key_map(valid: Column, pages: Column, coverage: float = 0.3, least: int = 6) -> Column:
    """Whether a sheet's distinct valid reads cover enough of its volume."""
    return (pages > 0) & (valid >= least) & (valid / F.nullif(pages, F.lit(0)) >= coverage)
