"""Street names as column expressions: normal form, families, and how printed labels match known names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Abbreviations of street types, directions and the prefix of names; types that have none.
TYPE_OF = {
    "ST": "STREET", "AVE": "AVENUE", "AV": "AVENUE", "BLVD": "BOULEVARD", "PL": "PLACE", "DR": "DRIVE", "RD": "ROAD", "CT": "COURT", "LN": "LANE", "TER": "TERRACE", "TERR": "TERRACE",
    "HWY": "HIGHWAY", "PKWY": "PARKWAY", "CIR": "CIRCLE", "EXPY": "EXPRESSWAY",
}
DIRECTION_OF = {"N": "NORTH", "S": "SOUTH", "E": "EAST", "W": "WEST", "NE": "NORTHEAST", "NW": "NORTHWEST", "SE": "SOUTHEAST", "SW": "SOUTHWEST"}
WHOLE_TYPES = ["WAY", "TRAIL", "ALLEY", "SQUARE", "PLAZA", "PIKE", "TURNPIKE", "LOOP", "ROW", "WALK", "CROSSING", "TRACE", "PASS"]
#: Ordinals of 1 to 19, of tens, and the tens before another ordinal.
ONES = "FIRST SECOND THIRD FOURTH FIFTH SIXTH SEVENTH EIGHTH NINTH TENTH ELEVENTH TWELFTH THIRTEENTH FOURTEENTH FIFTEENTH SIXTEENTH SEVENTEENTH EIGHTEENTH NINETEENTH".split()
TENS = "TENTH TWENTIETH THIRTIETH FORTIETH FIFTIETH SIXTIETH SEVENTIETH EIGHTIETH NINETIETH".split()
BEFORE = "TEN TWENTY THIRTY FORTY FIFTY SIXTY SEVENTY EIGHTY NINETY".split()
#: Letters of a printed part of a name that is long enough to stand for the whole.
FRAGMENT = 5

TYPES = sorted({*TYPE_OF.values(), *WHOLE_TYPES})
DIRECTIONS = sorted(DIRECTION_OF.values())
_SUFFIXES = ("ST", "ND", "RD", "TH")


def _lookup(table: dict[str, str], word: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), word), word)


def _pick(words: list[str], i: Column) -> Column:
    return F.get(F.array(*map(F.lit, words)), i)


def words_of(name: Column) -> Column:
    return F.filter(F.split(name, r"\s+"), lambda w: w != "")


def ordinal_word(n: Column) -> Column:
    """The ordinal of 1 to 99 in words; null for other numbers."""
    n = n.cast("int")
    spoken = F.when(n <= 19, _pick(ONES, n - 1)).when(F.pmod(n, F.lit(10)) == 0, _pick(TENS, F.floor(n / 10).cast("int") - 1))
    return F.when(n.between(1, 99), spoken.otherwise(F.concat_ws(" ", _pick(BEFORE, F.floor(n / 10).cast("int") - 1), _pick(ONES, F.pmod(n, F.lit(10)) - 1))))


def ordinal_suffix(n: Column) -> Column:
    last = F.pmod(n, F.lit(10))
    return F.when(F.pmod(n, F.lit(100)).between(11, 13), "TH").when(last == 1, "ST").when(last == 2, "ND").when(last == 3, "RD").otherwise("TH")


def normalize_street(text: Column) -> Column:
    """Upper case without signs; a number joins its ordinal ending and is spoken; the first word's direction, then SAINT, then types are written out."""
    raw = words_of(F.regexp_replace(F.upper(text), r"(?U)[^\w\s]", " "))

    def joined(ws: Column) -> Column:
        number = lambda i: F.coalesce(F.get(ws, i).rlike(r"^\d+$"), F.lit(False))
        ending = lambda i: F.coalesce(F.get(ws, i).isin(*_SUFFIXES), F.lit(False))
        each = F.transform(ws, lambda w, i: F.when(number(i) & ending(i + 1), F.concat(w, F.get(ws, i + 1))).when(ending(i) & (i > 0) & number(i - 1), F.lit(None)).otherwise(w))
        return F.filter(each, lambda w: w.isNotNull())

    spoken = lambda w: F.when(w.rlike("^[1-9][0-9]?(ST|ND|RD|TH)$"), F.split(ordinal_word(F.regexp_extract(w, "^([0-9]+)", 1).try_cast("int")), " ")).otherwise(F.array(w))
    first = lambda w: F.when(_lookup(DIRECTION_OF, w) == "ST", "SAINT").otherwise(_lookup(DIRECTION_OF, w))
    full = lambda ws: F.transform(ws, lambda w, i: _lookup(TYPE_OF, F.when(i == 0, first(w)).otherwise(w)))
    once = lambda value, made: F.transform(F.array(value), made)[0]
    return F.array_join(once(once(raw, joined), lambda ws: full(F.flatten(F.transform(ws, spoken)))), " ")


def base_name(name: Column) -> Column:
    """The name without a direction at its end."""
    words = words_of(name)
    return F.when((F.size(words) > 1) & F.element_at(words, -1).isin(*DIRECTIONS), F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " ")).otherwise(name)


def name_family(name: Column) -> Column:
    """What halves and renamings of a street share: the name without directions at its ends and without its type."""
    less = lambda ws, cut: F.transform(F.array(ws), cut)[0]
    head = lambda ws: F.when((F.size(ws) > 1) & F.get(ws, F.lit(0)).isin(*DIRECTIONS), F.slice(ws, F.lit(2), F.size(ws))).otherwise(ws)
    tail = lambda ws: F.when((F.size(ws) > 1) & F.element_at(ws, -1).isin(*TYPES), F.slice(ws, F.lit(1), F.size(ws) - 1)).otherwise(ws)
    return F.array_join(less(less(words_of(base_name(name)), head), tail), " ")


def is_number_only(text: Column) -> Column:
    return ~text.rlike("[a-zA-Z]")


def hint_type(text: Column) -> Column:
    """STREET or AVENUE for a printed type word, however it is dotted or spaced; null for other words."""
    full = _lookup(TYPE_OF, F.regexp_replace(F.upper(text), "[. ]", ""))
    return F.when(full.isin("STREET", "AVENUE"), full)


def is_bare_letter(text: Column) -> Column:
    return F.trim(text).rlike(r"^\p{L}$")


def printed_letters(text: Column) -> Column:
    """Letters and digits as printed, before anything is written out."""
    return F.char_length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def match_candidates(name: Column) -> Column:
    """The name, and what stands after a direction or SAINT at its head."""
    rest = F.regexp_extract(name, r"(?s)^(\S+) (.*)$", 2)
    return F.when(F.regexp_extract(name, r"(?s)^(\S+) (.*)$", 1).isin(*DIRECTIONS, "SAINT"), F.array(name, rest)).otherwise(F.array(name))


def covers_whole_name(label: Column, candidate: Column, letters: Column) -> Column:
    """Whether a label that a candidate starts with names all of it: only types and directions are left, or the label is long enough."""
    rest = words_of(F.substring(candidate, F.char_length(label) + 2, F.lit(1 << 30)))
    return F.startswith(candidate, F.concat(label, F.lit(" "))) & (F.forall(rest, lambda w: w.isin(*TYPES, *DIRECTIONS)) | (letters >= FRAGMENT))


def compatible(label: Column, candidate: Column, letters: Column) -> Column:
    longer = (F.size(words_of(candidate)) >= 2) & F.startswith(label, F.concat(candidate, F.lit(" ")))
    return (label == candidate) | longer | covers_whole_name(label, candidate, letters)


def matches(labels: DataFrame, names: DataFrame) -> DataFrame:
    """(label, names) for each distinct label: the names (normal form) that it may stand for, ascending; none is an empty array.

    A label as printed that is itself a name stands for that alone. A bare direction stands for itself and
    for names whose next word is a type. Labels and names meet by their first two words, so that a
    common first word doesn't bring all its names together; a label of one word meets them by it.
    """
    text = F.col("label")
    asked = labels.select("label").dropna().distinct().select("label", F.trim(F.upper(text)).alias("raw"), normalize_street(text).alias("norm"), printed_letters(text).alias("letters"))
    two = lambda c: F.array_join(F.slice(words_of(c), 1, 2), " ")
    one = lambda c: F.element_at(words_of(c), 1)
    known = names.select("name").dropna().distinct()
    alias = asked.where("raw <> norm").join(known, F.col("raw") == F.col("name")).select("label", "name")
    rest = asked.join(alias.select("label"), "label", "left_anti").withColumn("key", two(F.col("norm")))
    direction = F.col("norm").isin(*DIRECTIONS)
    parts = known.select("name", F.explode(match_candidates(F.col("name"))).alias("candidate"))
    keyed = parts.select("name", "candidate", F.explode(F.array_distinct(F.array(two(F.col("candidate")), one(F.col("candidate"))))).alias("key"))
    named = rest.where(~direction).join(keyed, "key").where(compatible(F.col("norm"), F.col("candidate"), F.col("letters"))).select("label", "name")
    after = F.get(words_of(F.col("name")), F.lit(1))
    heads = known.select("name", one(F.col("name")).alias("key")).where((F.size(words_of(F.col("name"))) == 1) | after.isin(*TYPES))
    directed = rest.where(direction).join(heads, "key").select("label", "name")
    found = alias.union(named).union(directed).groupBy("label").agg(F.sort_array(F.collect_set("name")).alias("names"))
    return asked.select("label").join(found, "label", "left").select("label", F.coalesce("names", F.array().cast("array<string>")).alias("names"))


def matches_any(labels: DataFrame, names: DataFrame) -> DataFrame:
    """(label) of the labels that stand for some name by their words, whatever the rules of aliases and bare directions."""
    text = F.col("label")
    asked = labels.select("label").dropna().distinct().select("label", normalize_street(text).alias("norm"), printed_letters(text).alias("letters"))
    two = lambda c: F.array_join(F.slice(words_of(c), 1, 2), " ")
    parts = names.select(F.explode(match_candidates(F.col("name"))).alias("candidate"))
    keyed = parts.select("candidate", F.explode(F.array_distinct(F.array(two(F.col("candidate")), F.element_at(words_of(F.col("candidate")), 1)))).alias("key")).distinct()
    met = (two(F.col("norm")) == F.col("key")) & compatible(F.col("norm"), F.col("candidate"), F.col("letters"))
    return asked.join(keyed, met, "left_semi").select("label")


def vocabulary(names: DataFrame) -> DataFrame:
    """(text, name): each name written with its first direction and its type in full, short, dotted, or left out."""
    shorts = {}
    for short, full in [*DIRECTION_OF.items(), *TYPE_OF.items()]:
        shorts.setdefault(full, []).append(short)
    forms = F.create_map(*[x for full, found in shorts.items() for x in (F.lit(full), F.array(F.lit(full), *[F.lit(s + dot) for s in found for dot in ("", ".")]))])
    ws = words_of(F.col("name"))
    split = names.select("name").dropna().distinct().select("name", ws.alias("ws"), (F.size(ws) > 1).alias("many"))
    split = split.withColumn("head", F.when(F.col("many") & F.col("ws")[0].isin(*DIRECTIONS), F.col("ws")[0])).withColumn("tail", F.when(F.col("many") & F.element_at("ws", -1).isin(*TYPES), F.element_at("ws", -1)))
    core = F.slice("ws", F.when(F.col("head").isNull(), 1).otherwise(2), F.greatest(F.lit(0), F.size("ws") - F.col("head").isNotNull().cast("int") - F.col("tail").isNotNull().cast("int")))
    none = F.array(F.lit(""))
    options = lambda c: F.when(F.col(c).isNull(), none).otherwise(F.array_union(F.coalesce(F.try_element_at(forms, F.col(c)), F.array(F.col(c))), none))
    each = split.select("name", F.explode(options("head")).alias("a"), core.alias("core"), "tail").select("name", "a", "core", F.explode(options("tail")).alias("z"))
    text = F.concat_ws(" ", F.nullif("a", F.lit("")), F.nullif(F.array_join("core", " "), F.lit("")), F.nullif("z", F.lit("")))
    return each.select(text.alias("text"), "name").where("text <> ''").distinct()
