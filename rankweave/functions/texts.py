"""Column functions over running text: terms, negation, windows, markers, clean-up."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import collapsed, distinct_in_order, quoted

#: Words that negate what follows them.
NEGATORS = ["no", "not", "without", "neither", "nor", "did not", "was not", "were not", "is not", "are not", "failed to", "unable to"]
#: Patterns of conditions, times and models in a methods text.
MARKERS = [
    r"(?i)\b(?:\d+(?:\.\d+)?(?:\s?[x×]\s?10\^?\d+)?)\s?(?:uM|μM|mM|nM|pM|mg/kg(?:/day)?|g/kg|mg/mL|ug/mL|μg/mL|ng/mL|g/L|CFU(?:/mL)?|CFU|MOI|% DSS)\b",
    r"(?i)\b\d+(?:\.\d+)?\s?(?:h|hr|hrs|hour|hours|day|days|week|weeks)\b",
    r"(?i)\b(?:Caco-2|HT-29|RAW ?264\.7|THP-1|HCT116|IEC-6|MODE-K|LoVo|SW480|MC38|HIEC|CCD[- ]841|T84|LS174T)\b",
    r"(?i)\b(?:C57BL/6(?:J)?|BALB/c|Sprague[- ]Dawley|Wistar|germ-free|specific pathogen-free|SPF|DSS(?:-induced)? colitis|TNBS(?:-induced)? colitis|AOM/DSS|Il10-/-|IL-10 knockout|NOD/SCID)\b",
]


def has_either_way(query: Column, target: Column) -> Column:
    """Whether one text holds the other; false if either is blank (every text holds the empty one)."""
    return (query != "") & (target != "") & (F.contains(target, query) | F.contains(query, target))


def has_term(text_lower: Column, term: str) -> Column:
    """Whether a lower-cased text holds the term; terms of three letters or fewer must be whole words."""
    t = term.lower().strip()
    return text_lower.rlike(rf"(?<![\p{{L}}\p{{N}}_]){quoted(t)}(?![\p{{L}}\p{{N}}_])") if len(t) <= 3 else F.contains(text_lower, F.lit(t))


def entity_pattern(aliases: Sequence[str]) -> str:
    """A pattern for any of the aliases between characters that aren't letters or digits."""
    forms = [r"\s+".join(quoted(w) for w in a.lower().split()) for a in aliases if a.strip()]
    return rf"(?<![a-z0-9])(?:{'|'.join(forms)})(?![a-z0-9])"


def may_mention(text_lower: Column, aliases: Sequence[str]) -> Column:
    """Whether a lower-cased text holds the last word of any alias, as every text does that mentions one."""
    last = dict.fromkeys(a.lower().split()[-1] for a in aliases if a.strip())
    return reduce(lambda a, b: a | b, [F.contains(text_lower, F.lit(w)) for w in last]) if last else F.lit(True)


def mentions(text: Column, aliases: Sequence[str]) -> Column:
    return may_mention(F.lower(text), aliases) & F.lower(collapsed(text)).rlike(entity_pattern(aliases))


def affirms(text: Column, aliases: Sequence[str], reach: int = 55) -> Column:
    """Whether any alias is mentioned without a negator in the ``reach`` characters before it; few texts mention one at all."""
    not_before = "".join(rf"(?<!\b{quoted(n)}\b.{{0,{reach - len(n)}}})" for n in NEGATORS)
    low, e = F.lower(collapsed(text)), entity_pattern(aliases)
    return may_mention(F.lower(text), aliases) & low.rlike(e) & low.rlike(rf"(?={e}){not_before}")


def any_of(text: Column, terms: Sequence[str]) -> Column:
    """Whether the lower-cased text holds any of the terms."""
    return F.lower(text).rlike("|".join(quoted(t.lower()) for t in terms))


def hits(text: Column, terms: Sequence[str]) -> Column:
    """How many of the terms the lower-cased text holds."""
    low = F.lower(text)
    return sum((F.contains(low, F.lit(t.lower())).cast("int") for t in terms), F.lit(0))


def sentences(text: Column) -> Column:
    return F.array_remove(F.split(collapsed(text), r"(?<=[.!?])\s+"), "")  # of a blank text only


def windows(text: Column, most: int = 2) -> Column:
    """Every run of one to ``most`` sentences, without repeats; for short texts, as each run looks at all sentences."""
    s = sentences(text)
    runs = lambda i: F.transform(F.sequence(F.lit(1), F.lit(most)), lambda w: F.array_join(F.slice(s, i + 1, w), " "))
    each = F.when(F.size(s) > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.size(s) - 1), runs))).otherwise(F.array().cast("array<string>"))
    return distinct_in_order(each)


def without_tags(text: Column, most: int = 1200) -> Column:
    """Tags as spaces, white space collapsed, cut."""
    return F.left(collapsed(F.regexp_replace(text, "<[^>]+>", " ")), F.lit(most))


def shortened(text: Column, most: int = 520) -> Column:
    clean = collapsed(text)
    return F.when(F.length(clean) > most, F.concat(F.regexp_replace(F.left(clean, F.lit(most - 1)), r"\s+$", ""), F.lit("…"))).otherwise(clean)


def phrase(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"^[ .;,:]+|[ .;,:]+$", "")


#: The forms in which a claim cites its sources.
CITED = (r"(?i)\[PMID:[^\]]+\]", r"(?i)\bPMCID?:\s*\S+", r"https?://\S+", r"(?i)protocols\.io\S*")


def without_references(text: Column) -> Column:
    for pattern in CITED:
        text = F.regexp_replace(text, pattern, "")
    return F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"^[ ;|,]+|[ ;|,]+$", "")


def claim_key(text: Column) -> Column:
    """A claim up to its first bar, without references, in lower-case letters and digits."""
    return collapsed(F.regexp_replace(F.lower(F.substring_index(without_references(text), "|", 1)), r"[^a-z0-9\s]+", " "))


def markers(text: Column, most: int = 8) -> Column:
    """Conditions, times and models that a text names, in this order."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(f"({p})"), F.lit(1)) for p in MARKERS])
    return F.slice(distinct_in_order(F.transform(found, phrase)), 1, most)


def first_label(rules: Sequence[tuple[Column, str]], default: str) -> Column:
    """The label of the first rule that holds."""
    out = F.lit(default)
    for holds, label in reversed(rules):
        out = F.when(holds, F.lit(label)).otherwise(out)
    return out


def model_scope(text: Column) -> Column:
    """The model that a paper's text says it used."""
    low = F.lower(F.coalesce(text, F.lit("")))
    dss, mouse = low.rlike(r"\b(?:dss|dextran sodium sulfate)\b"), low.rlike(r"\b(?:mouse|mice|murine)\b")
    # fixed values: the labels and the terms that lead to them
    rules = [
        (dss & mouse, "a DSS-induced mouse colitis model"),
        (dss, "a DSS-induced colitis model"),
        (mouse & low.rlike("colitis|inflammatory bowel|ibd"), "a paper-reported mouse colitis model"),
        (low.rlike("organoid|epithelial cell|macrophage|cell line|in vitro"), "the paper-reported in vitro host model"),
        (low.rlike("patients|participants|cohort|clinical"), "the paper-reported human population"),
        (mouse, "the paper-reported mouse model"),
        (low.rlike("rat|animal|in vivo"), "the paper-reported preclinical model"),
    ]
    return first_label(rules, "the paper-reported experimental model")
