"""Column functions over names, identifiers and lists."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(term: str) -> str:
    """``term`` as a pattern for Java's regular expressions."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", term)


def stripped(c: Column) -> Column:
    """Without white space at both ends; Spark's own trim takes spaces only."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def collapsed(c: Column) -> Column:
    return stripped(F.regexp_replace(c, r"\s+", " "))


def from_file_name(c: Column) -> Column:
    """The source in a coordinate file's name: between _min<n>_ and _seed_, else a capitalised genus_species before _seed_, else null."""
    stem = F.regexp_replace(F.regexp_extract(c, r"([^/]*)$", 1), r"\.[^.]*$", "")
    part = lambda pattern: F.nullif(F.regexp_extract(stem, pattern, 1), F.lit(""))
    return F.coalesce(part(r"_min\d+_(.+?)_seed_"), part(r"_([A-Z][a-z]+_[a-z]+(?:_[a-z]+)*)_seed_"))


def mid_of_row_name(row: Column, src: Column) -> Column:
    """The part of a quoted row name before -<src>, else before its last hyphen, else all of it."""
    plain = F.regexp_replace(stripped(row), '^"+|"+$', "")
    suffix = F.concat(F.lit("-"), src)
    at = F.position(suffix, plain)
    last = F.regexp_extract(plain, r"(?s)^(.*)-[^-]*$", 1)
    return F.when(at > 0, F.left(plain, at - 1)).when(F.contains(plain, F.lit("-")), last).otherwise(plain)


def split_pair(c: Column) -> Column:
    """struct(mid, src): cut at the last hyphen that has an underscore to its right; src is Unknown if there is none."""
    pattern = r"(?s)^(.+)-(.*_.*)$"
    fits = c.rlike(pattern)
    return F.struct(F.when(fits, F.regexp_extract(c, pattern, 1)).otherwise(c).alias("mid"), F.when(fits, F.regexp_extract(c, pattern, 2)).otherwise("Unknown").alias("src"))


def without_suffix(c: Column, suffix: str) -> Column:
    return F.regexp_replace(c, f"{quoted('-' + suffix)}$", "")


# four normal forms of a name, each used by a family of operators: they don't agree


def underscored(c: Column) -> Column:
    """a: trimmed, lower case, spaces and hyphens as underscores."""
    return F.translate(stripped(F.lower(c)), " -", "__")


def spaced(c: Column) -> Column:
    """b: trimmed, lower case, underscores and hyphens as spaces."""
    return stripped(F.translate(F.lower(c), "_-", "  "))


def dotless(c: Column) -> Column:
    """c: lower case, spaces as underscores, dots removed."""
    return F.translate(F.lower(c), " .", "_")


def node_id(c: Column) -> Column:
    """d: lower case, every run of other characters one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def salt_variants(c: Column) -> Column:
    """An acid's salts and a salt's acids: X-ic_acid and X-ate, X-ous_acid and X-ite, of names in form a."""
    stem = lambda n: F.left(c, F.greatest(F.length(c) - n, F.lit(0)))
    ends = lambda s: F.endswith(c, F.lit(s))
    return F.array_compact(
        F.array(
            F.when(ends("ic_acid"), F.concat(stem(7), F.lit("ate"))),
            F.when(ends("ous_acid"), F.concat(stem(8), F.lit("ite"))),
            F.when(ends("ate"), F.concat(stem(3), F.lit("ic_acid"))),
            F.when(ends("ite"), F.concat(stem(3), F.lit("ous_acid"))),
        )
    )


def lookup_variants(c: Column) -> Column:
    """Names to try in turn when an entity is looked up: as it is, with spaces, with underscores, and without hyphens."""
    return distinct_in_order(F.array(c, F.replace(c, F.lit("_"), F.lit(" ")), F.replace(c, F.lit(" "), F.lit("_")), F.replace(c, F.lit("-"), F.lit("_"))))


def search_term(node: Column, src: Column, mid: Column) -> Column:
    """The search term for a node: the source's name if the node is it or its first word, the intermediate's as it is written, else the id with spaces."""
    plain = F.replace(F.lower(node), F.lit("_"), F.lit(" "))
    source = F.translate(F.lower(src), "_-", "  ")
    return (
        F.when((plain == source) | (plain == F.element_at(F.split(stripped(source), r"\s+"), 1)), F.replace(src, F.lit("_"), F.lit(" ")))
        .when(plain == F.translate(F.lower(mid), "_-", "  "), mid)
        .otherwise(F.replace(node, F.lit("_"), F.lit(" ")))
    )


def all_of(terms: Column, field: str = "") -> Column:
    """A query text: every term that isn't blank quoted, with spaces for underscores, joined by AND; ``field`` follows each."""
    some = F.filter(terms, lambda x: stripped(x) != "")
    return F.array_join(F.transform(some, lambda x: F.concat(F.lit('"'), stripped(F.replace(x, F.lit("_"), F.lit(" "))), F.lit('"' + field))), " AND ")


def fingerprint(c: Column) -> Column:
    return F.md5(c)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once a row, also where ``use`` looks at it for each item of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def distinct_in_order(items: Column) -> Column:
    """Trimmed items without blanks and without repeats, whatever their case; the first of each stays."""
    clean = F.filter(F.transform(items, stripped), lambda x: x != "")
    return bound(clean, lambda c: bound(F.transform(c, F.lower), lambda low: F.filter(c, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)))


def aliases(c: Column) -> Column:
    """Names under which an entity is searched for: as it is, with spaces, and its first word."""
    words = F.replace(stripped(c), F.lit("_"), F.lit(" "))
    return distinct_in_order(F.array(stripped(c), words, F.element_at(F.split(stripped(words), r"\s+"), 1)))


def strict_aliases(c: Column, is_species: bool = False) -> Column:
    """Names under which an entity counts as mentioned: never the first word alone; of a species also A. name and A.name."""
    words = collapsed(F.replace(c, F.lit("_"), F.lit(" ")))
    names = [stripped(c), words]
    if is_species:
        first, second = F.regexp_extract(words, r"^(\S)\S*\s(\S+)", 1), F.regexp_extract(words, r"^(\S)\S*\s(\S+)", 2)
        names += [F.when(second != "", F.concat(first, F.lit(dot), second)).otherwise("") for dot in (". ", ".")]
    return distinct_in_order(F.array(*names))


def group_aliases(c: Column, groups: Mapping[str, Sequence[str]]) -> Column:
    """The name, its form with spaces, the members of the synonym group it belongs to, and its acronym of two to eight characters."""
    low = F.replace(F.lower(stripped(c)), F.lit("_"), F.lit(" "))
    members = F.array().cast("array<string>")
    for key, names in groups.items():
        known = {key.lower(), *(n.lower() for n in names)}
        members = F.when(low.isin(*sorted(known)), F.array(*map(F.lit, names))).otherwise(members)
    tokens = F.regexp_extract_all(F.replace(c, F.lit("_"), F.lit(" ")), F.lit(r"([A-Za-z]+|\d+)"), F.lit(1))
    counted = F.filter(tokens, lambda x: ~F.lower(x).isin("of", "and", "the"))
    acronym = F.upper(F.array_join(F.transform(counted, lambda x: F.when(x.rlike(r"^\d"), x).otherwise(F.left(x, F.lit(1)))), ""))
    usable = (F.length(acronym) >= 2) & (F.length(acronym) <= 8) & (F.length(F.regexp_replace(acronym, "[^A-Z]", "")) >= 2)
    return distinct_in_order(F.concat(F.array(c, F.replace(c, F.lit("_"), F.lit(" "))), members, F.when(usable, F.array(acronym)).otherwise(F.array().cast("array<string>"))))


def keywords(text: Column, stop: Sequence[str], limit: int = 8) -> Column:
    """The first ``limit`` distinct words of three letters or more that aren't stop words."""
    words = F.regexp_extract_all(text, F.lit(r"([A-Za-z][A-Za-z0-9_\-/+]{2,})"), F.lit(1))
    clean = lambda x: F.lower(F.regexp_replace(x, r"^[ _\-/+]+|[ _\-/+]+$", ""))
    return F.slice(distinct_in_order(F.filter(words, lambda x: (clean(x) != "") & ~clean(x).isin(*stop))), 1, limit)


def ids_of(field: Column) -> Column:
    """A list of ids from a field that separates them by commas or semicolons."""
    return F.filter(F.transform(F.split(F.replace(field, F.lit(";"), F.lit(",")), ","), stripped), lambda x: x != "")


def first_number(field: Column) -> Column:
    return F.nullif(F.regexp_extract(field, r"(\d+)", 1), F.lit(""))


def allowed_only(ids: Column, allowed: Column) -> Column:
    return F.filter(ids, lambda x: F.array_contains(allowed, x))


def mapped(c: Column, table: Mapping[str, str], valid: Sequence[str] | None, default: str) -> Column:
    """A status in its vocabulary: aliases mapped, anything that isn't valid the default; without ``valid`` unknown values stay."""
    low = F.lower(stripped(F.coalesce(c, F.lit(""))))
    status = low
    for alias, name in table.items():
        status = F.when(low == alias, name).otherwise(status)
    if valid is None:
        return F.when(status == "", default).otherwise(status)
    return F.when(status.isin(*valid), status).otherwise(default)


#: Aliases of a module's result and design status, and what is valid.
RESULT_ALIASES = {"complete_positive": "positive", "passed": "positive", "pass": "positive", "complete_negative": "negative", "failed": "negative", "fail": "negative", "equivocal": "inconclusive", "ambiguous": "inconclusive"}
RESULTS = ["not_run", "positive", "negative", "inconclusive"]
DESIGN_ALIASES = {"complete": "execution_complete", "ready": "execution_complete", "protocol_complete": "execution_complete", "outline_only": "decision_complete", "blueprint": "decision_complete", "degraded": "needs_resolution", "incomplete": "needs_resolution"}
DESIGNS = ["execution_complete", "decision_complete", "needs_resolution"]


def result_status(c: Column) -> Column:
    return mapped(c, RESULT_ALIASES, RESULTS, "not_run")


def design_status(c: Column) -> Column:
    return mapped(c, DESIGN_ALIASES, DESIGNS, "")


def method_group(c: Column, endings: Sequence[tuple[str, str]], default: str = "other") -> Column:
    """The label of the first ending that the trimmed, lower-cased name has."""
    out = F.lit(default)
    for ending, label in reversed(endings):
        out = F.when(F.endswith(F.lower(stripped(c)), F.lit(ending)), label).otherwise(out)
    return out


def slug(c: Column, most: int = 24) -> Column:
    """Runs of other than word characters as one underscore, none at the ends, cut, lower case; "run" if nothing is left."""
    s = F.left(F.regexp_replace(F.regexp_replace(stripped(F.coalesce(c, F.lit("run"))), r"\W+", "_"), "^_+|_+$", ""), F.lit(most))
    return F.lower(F.when(s == "", "run").otherwise(s))


def run_id(at: Column, source: Column, target: Column) -> Column:
    return F.concat(F.lit("run_"), F.date_format(at, "yyyyMMdd_HHmmss"), F.lit("_"), slug(source, 20), F.lit("_"), slug(target, 12))


def any_pattern(c: Column, patterns: Sequence[str]) -> Column:
    """Whether any of the patterns is found, whatever the case."""
    return c.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def count_of(counts: Column, key: str) -> Column:
    """The value of a map, 0 where it has none."""
    return F.coalesce(F.try_element_at(counts, F.lit(key)), F.lit(0))
