"""Normalisation of categorical calls and parsing of composite type labels. All are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The known subtypes, by type, and the class of each type.
KNOWN_SUBTYPES = (
    "I-A I-B I-B1 I-B2 I-C I-D I-E I-E2 I-E3 I-E4 I-E5 I-F I-F1 I-F2 I-F3 I-F4 I-G I-H "
    "III-A III-A2 III-B III-C III-D III-E III-F III-G III-H III-I "
    "IV-A IV-A2 IV-A3 IV-B IV-C IV-D IV-E VII "
    "II-A II-B II-C II-C2 II-D "
    "V-A V-A2 V-B V-B1 V-B2 V-B3 V-C V-D V-E V-F V-F1 V-F2 V-F3 V-F4 V-G V-H V-I V-J V-K V-L V-M V-N V-O V-P "
    "VI-A VI-B VI-B1 VI-B2 VI-B3 VI-C VI-D VI-E VI-F"
).split()
TYPE_CLASS = {"I": "Class1", "III": "Class1", "IV": "Class1", "VII": "Class1", "II": "Class2", "V": "Class2", "VI": "Class2"}
UNKNOWN = "Unknown"
_TYPE = r"(?i)(?:Subtype|Type)[_-]?([IVX]+(?:-[A-Z0-9]+)?)"


def fill(x: Column, value: str = UNKNOWN) -> Column:
    return F.coalesce(x, F.lit(value))


def parse_type_label(raw: Column) -> Column:
    """struct<canonical, cas_class, cas_type, cas_subtype, status> of a label such as `x_CAS_Class1-Subtype-I-E_1`."""
    text = fill(raw, "")
    at = F.instr(text, "_CAS_")
    tail = F.when(at > 0, F.substring(text, at + 5, F.length(text))).otherwise(text)
    bare = F.regexp_replace(tail, "_[0-9]+$", "")
    canonical = F.when(bare == "", F.lit("<EMPTY>")).otherwise(bare)
    stated = F.regexp_extract(canonical, "(?i)Class([12])", 1)
    found = F.upper(F.regexp_extract(canonical, _TYPE, 1))
    kind = F.when(found == "", UNKNOWN).otherwise(F.substring_index(found, "-", 1))
    derived = F.element_at(F.create_map(*[F.lit(x) for pair in TYPE_CLASS.items() for x in pair]), kind)
    cas_class = F.when(stated != "", F.concat(F.lit("Class"), stated)).otherwise(fill(derived))
    known_type = kind.isin(*TYPE_CLASS)
    subtype = F.when(found.isin(*KNOWN_SUBTYPES) | found.isin(*TYPE_CLASS), found).otherwise(UNKNOWN)
    coarse = subtype.isin(*TYPE_CLASS) & canonical.rlike("(?i)Type[_-][IVX]+(?:$|[_-])") & ~canonical.rlike("(?i)Subtype")
    status = (
        F.when(~known_type, "unknown_type").when(coarse, "coarse_type_only").when(subtype == UNKNOWN, "unknown_subtype").otherwise("ok")
    )
    return F.struct(
        canonical.alias("canonical"), cas_class.alias("cas_class"), kind.alias("cas_type"), subtype.alias("cas_subtype"), status.alias("status")
    )


def coarse_type(raw: Column) -> Column:
    """The type token alone, upper case, not checked against the known ones; Unknown if none."""
    found = F.upper(F.split(F.regexp_extract(fill(raw, ""), _TYPE, 1), "-")[0])
    return F.when(found == "", UNKNOWN).otherwise(found)


def direction_a(raw: Column) -> Column:
    """+, F or `F ...` is Forward; -, R or `R ...` Reverse; the rest Unknown."""
    t = F.trim(raw)
    return (
        F.when((t == "+") | (t == "F") | t.startswith("F "), "Forward").when((t == "-") | (t == "R") | t.startswith("R "), "Reverse").otherwise(UNKNOWN)
    )


def direction_b(raw: Column) -> Column:
    """forward and reverse in any case; the rest Unknown."""
    t = F.lower(F.trim(raw))
    return F.when(t == "forward", "Forward").when(t == "reverse", "Reverse").otherwise(UNKNOWN)


def flip(direction: Column) -> Column:
    return F.when(direction == "Forward", "Reverse").when(direction == "Reverse", "Forward").otherwise(direction)


def agreement(a: Column, b: Column) -> Column:
    """Unknown and null calls are not comparable; any other two are compared as they are."""
    return F.when((fill(a) == UNKNOWN) | (fill(b) == UNKNOWN), "not_comparable").when(a == b, "agree").otherwise("disagree")


def direction_label(direction: Column) -> Column:
    """Forward is 1, Reverse 0; anything else is an error, so filter first."""
    wrong = F.raise_error(F.concat(F.lit("no label for direction "), fill(direction, "null"))).cast("int")
    return F.when(direction == "Forward", 1).when(direction == "Reverse", 0).otherwise(wrong)


def label_direction(label: Column) -> Column:
    return F.when(label == 1, "Forward").when(label == 0, "Reverse").otherwise(F.raise_error(F.lit("no direction for label")).cast("string"))


def parse_bool(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x)).isin("1", "true", "yes", "y"), F.lit(False))


def subtype_key(x: Column) -> Column:
    """Trimmed, Unknown if null or blank."""
    return fill(F.nullif(F.trim(x), F.lit("")))
