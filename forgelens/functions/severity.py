"""Severity of an advisory: numeric score, score in prose, then a label."""

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .registries import SCORE_TEXT_REGEX, SEVERITY_LABELS, SEVERITY_ORDER
from .text import contains_any, regex

# JSON keys that hold a score or a label.
SCORE_KEYS = ["score", "cvss_score", "cvss3_score", "cvss2_score"]
SCORE_KEY_PARTS = ["score", "cvss"]
LABEL_KEYS = ["severity"]
LABEL_KEY_PARTS = ["severity", "level", "priority"]
# Lower bound of a score and its severity.
SCORE_BANDS = [(9.0, "Critical"), (7.0, "High"), (4.0, "Medium")]

_SCORE_AND_LABEL = T.StructType(
    [T.StructField("score", T.DoubleType()), T.StructField("label", T.StringType())]
)


def _as_score(value):
    if isinstance(value, (int, float, str)):
        try:
            return float(value)
        except (ValueError, OverflowError):
            return None
    return None


def _as_label(value):
    return (value.strip() or None) if isinstance(value, str) else None


def _search(node, exact_keys, key_parts, accept):
    """Depth-first search of a JSON document for the first acceptable value.

    At each object the exact keys go first, in their order; then its entries in
    document order, each tried by a part of its name and then descended into.
    """
    pending = [(None, node)]  # what is still to be visited, the next one last
    while pending:
        key, child = pending.pop()
        if key is not None and any(part in key.lower() for part in key_parts):
            value = accept(child)
            if value is not None:
                return value
        if isinstance(child, list):
            pending += [(None, entry) for entry in reversed(child)]
        elif isinstance(child, dict):
            for exact in exact_keys:
                value = accept(child.get(exact))
                if value is not None:
                    return value
            pending += reversed(child.items())
    return None


def json_score_and_label(document: str | None):
    """Score and label of a document; one that cannot be parsed has neither."""
    try:
        node = json.loads(document) if document else None
    except (ValueError, RecursionError):
        node = None
    return (
        _search(node, SCORE_KEYS, SCORE_KEY_PARTS, _as_score),
        _search(node, LABEL_KEYS, LABEL_KEY_PARTS, _as_label),
    )


@F.arrow_udf(_SCORE_AND_LABEL)
def advisory_json_severity(documents: pa.Array) -> pa.Array:
    """What a free-form advisory document says about its severity."""
    found = [json_score_and_label(document.as_py()) for document in documents]
    return pa.array(
        [{"score": score, "label": label} for score, label in found],
        type=to_arrow_type(_SCORE_AND_LABEL),
    )


def text_score(*texts) -> Column:
    """First score named in the texts, null without one."""
    named = F.regexp_extract(F.concat_ws(" ", *texts), regex(SCORE_TEXT_REGEX, "i"), 1)
    return named.try_cast("double")


def score_band(score: Column) -> Column:
    band = F
    for bound, name in SCORE_BANDS:
        # NaN is no score above any bound, though Spark sorts it last
        band = band.when((score >= bound) & ~F.isnan(score), name)
    return band.when(score.isNotNull(), "Low")


def label_band(label: Column) -> Column:
    upper = F.upper(label)
    band = F
    for parts, name in SEVERITY_LABELS:
        band = band.when(contains_any(upper, parts), name)
    return band


def severity(json_score: Column, json_label: Column, *texts) -> Column:
    score = F.coalesce(json_score, text_score(*texts))
    return F.coalesce(score_band(score), label_band(json_label), F.lit("Unknown"))


def severity_rank(severity_name: Column) -> Column:
    """1 for Critical up to 5 for Unknown (and anything else)."""
    rank = F
    for position, name in enumerate(SEVERITY_ORDER, start=1):
        rank = rank.when(severity_name == name, position)
    return rank.otherwise(len(SEVERITY_ORDER))


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(name) for name in SEVERITY_ORDER]), rank)
