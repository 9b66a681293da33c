"""Normal forms of the lists that come out of a plan's audit, from JSON of whatever shape to columns of one type."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.names import stripped

#: How many items of each list count, and its fields with what stands for a missing one.
#: A missing list (None) is empty; the fields in ``LOWERED`` are in small letters; ``AUDIT``'s lists of claims have a reason or not.
LIMITS = {"claims": 12, "evidence": 14, "reflections": 10, "queries": 12, "strengths": 10}
FIELDS = {
    "claims": {"claim": "", "support_level": "speculative", "pmids": None},
    "evidence": {"claim_type": "unspecified", "claim": "", "support_level": "speculative", "pmids": None, "model_type": "unspecified", "evidence_summary": ""},
    "reflections": {"initial_claim": "", "self_critique": "", "evidence_checked": None, "revision": "", "remaining_uncertainty": ""},
    "queries": {"round": 0, "label": "", "query": "", "rationale": "", "pmid_count": 0, "article_count": 0},
    "strengths": {"topic": "", "support_level": "speculative", "evidence_type": "unspecified", "rationale": "", "representative_pmids": None},
}
LOWERED = {"support_level"}
AUDIT = {"supported_claims": False, "inference_only_claims": True, "unsupported_or_overstated_claims": True}


def text_of(value: Column, default: str = "") -> Column:
    """A JSON value as trimmed text; null, false, 0 and empty texts, lists and objects give the default.  Other values that aren't text are written as JSON."""
    kind, text = F.schema_of_variant(value), value.cast("string")
    empty = value.isNull() | (kind == "VOID") | (text == "") | ((kind != "STRING") & text.rlike(r"^(?:false|-?0(?:\.0*)?(?:E[+-]?\d+)?|\[\]|\{\})$"))
    return F.when(empty, F.lit(default)).otherwise(stripped(text))


def texts_of(value: Column) -> Column:
    """A JSON list's items as trimmed texts without blank ones; null items go, and what isn't a list is an empty one."""
    items = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))
    return F.filter(F.transform(items, lambda x: stripped(x.cast("string"))), lambda x: x.isNotNull() & (x != ""))


def number_of(value: Column) -> Column:
    """A JSON number, or a text that is one, as a whole number towards 0; all else is 0."""
    return F.coalesce(F.try_variant_get(value, "$", "double").cast("long"), F.lit(0).cast("long"))


def _items(value: Column, fields: Mapping[str, object], most: int) -> Column:
    items = F.slice(F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>")), 1, most)
    objects = F.filter(items, lambda x: F.schema_of_variant(x).startswith("OBJECT"))

    def field(x: Column, name: str, default: object) -> Column:
        v = F.try_variant_get(x, f"$.{name}", "variant")
        if default is None:
            return texts_of(v).alias(name)
        if isinstance(default, int):
            return number_of(v).alias(name)
        text = text_of(v, default)
        return (F.lower(text) if name in LOWERED else text).alias(name)

    return F.transform(objects, lambda x: F.struct(*[field(x, n, d) for n, d in fields.items()]))


def normal_items(json: Column, kind: str, with_reason: bool = False) -> Column:
    """The list of ``kind`` ("claims", "evidence", "reflections", "queries" or "strengths") in JSON as an array of structs.

    Of the first items (as many as ``LIMITS`` says) those that are objects stay,
    each with all fields of its kind: texts trimmed, levels in small letters,
    lists of texts without blanks.  Null, text that isn't JSON, and JSON that isn't
    a list give an empty array.  ``with_reason`` adds a claim's reason.
    """
    fields = FIELDS[kind] | ({"reason": ""} if with_reason else {})
    return _items(F.try_parse_json(json), fields, LIMITS[kind])


def normal_audit(json: Column) -> Column:
    """A protocol's audit in JSON as a struct: its assessment, three lists of claims (the latter two with reasons) and the gaps; all empty if it isn't an object."""
    whole = F.try_parse_json(json)
    at = lambda name: F.try_variant_get(whole, f"$.{name}", "variant")
    lists = [_items(at(n), FIELDS["claims"] | ({"reason": ""} if why else {}), LIMITS["claims"]).alias(n) for n, why in AUDIT.items()]
    return F.struct(text_of(at("overall_assessment")).alias("overall_assessment"), *lists, texts_of(at("priority_gaps")).alias("priority_gaps"))
