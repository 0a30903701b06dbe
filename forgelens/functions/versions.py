"""Versions as keys that sort as the versions do (PEP 440), and the test against affected ranges.

A key is binary: numbers are written with their length in front, so that bytes compare as
the numbers do, and each part of a version that may be missing has a mark below or above
the others, as the order asks.  Keys can be compared, sorted, joined and stored.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the pattern of a version in PEP 440 (public domain), lower-case.
PEP_440 = (
    r"^\s*v?(?:([0-9]+)!)?([0-9]+(?:\.[0-9]+)*)"
    r"(?:[-_.]?(alpha|a|beta|b|preview|pre|c|rc)[-_.]?([0-9]+)?)?"
    r"(?:-([0-9]+)|[-_.]?(post|rev|r)[-_.]?([0-9]+)?)?"
    r"(?:[-_.]?(dev)[-_.]?([0-9]+)?)?(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?\s*$"
)
NUMBERS = r"^[0-9]+(?:\.[0-9]+)*$"
LEADING_NUMBERS = r"^\s*v?([0-9]+(?:\.[0-9]+)*)"
_END, _LEAST, _MOST = "!", "0", "z"  # below all numbers and letters, below and above all marks


def _number(digits: Column) -> Column:
    """Digits of any number, so that it sorts as the number does; none are 0."""
    plain = F.ltrim(digits, F.lit("0"))
    return F.concat(F.char(F.length(plain) + 64), plain)


def _release(numbers: Column) -> Column:
    trimmed = F.when(numbers.endswith("0"), F.regexp_replace(numbers, r"(?:\.0+)+$", "")).otherwise(numbers)
    return F.array_join(F.transform(F.split(trimmed, r"\."), _number), "")


def _plain(numbers: Column) -> Column:
    """The key of a release and nothing else."""
    return F.concat(_number(F.lit("")), _release(numbers), F.lit(_END + _MOST + _LEAST + _MOST + _LEAST))


def version_key(version: Column) -> Column:
    """The key of a version: epoch, release without trailing zeros, pre-release, post-release,
    development release, local label, in that order.

    What is no version by PEP 440 counts as the release of its leading numbers, 0 if there
    are none; a null version has no key.
    """
    # most versions are numbers and dots and need no other part
    return F.when(version.rlike(NUMBERS), _plain(version).cast("binary")).otherwise(_parsed(version))


def _parsed(version: Column) -> Column:
    marked = F.regexp_replace(F.lower(version), PEP_440, "\n".join(f"${i}" for i in range(1, 11)))
    # one element, so that the split parts are worked out once and named
    return F.transform(F.array(F.split(marked, "\n")), lambda f: _key(f, version))[0]


def _key(f: Column, version: Column) -> Column:
    epoch, release, pre, pre_number, implicit, post, post_number, dev, dev_number, local = (f[i] for i in range(10))
    has = lambda part: part != ""
    after = has(implicit) | has(post)
    pre_mark = F.when(pre.isin("alpha", "a"), "a").when(pre.isin("beta", "b"), "b").otherwise("c")
    label = F.transform(
        F.split(local, "[-_.]"),
        lambda s: F.when(s.rlike("^[0-9]+$"), F.concat(F.lit("n"), _number(s))).otherwise(
            F.concat(F.lit("l"), s, F.lit(_END))
        ),
    )
    full = F.concat(
        _number(epoch),
        _release(release),
        F.lit(_END),
        F.when(has(pre), F.concat(pre_mark, _number(pre_number)))
        .when(has(dev) & ~after, _LEAST)
        .otherwise(_MOST),
        F.when(after, F.concat(F.lit("1"), _number(F.when(has(implicit), implicit).otherwise(post_number))))
        .otherwise(_LEAST),
        F.when(has(dev), F.concat(F.lit("d"), _number(dev_number))).otherwise(_MOST),
        F.when(has(local), F.concat(F.lit("1"), F.array_join(label, ""), F.lit(_END))).otherwise(_LEAST),
    )
    leading = F.regexp_extract(F.lower(version), LEADING_NUMBERS, 1)
    return F.when(F.size(f) == 10, full).otherwise(_plain(leading)).cast("binary")


def is_pinned(version: Column) -> Column:
    """A missing version and one with a wildcard stand for every version."""
    return version.isNotNull() & ~version.contains("*")


def span_keys(affected: Column) -> Column:
    """(introduced, fixed) ranges with comparable bounds; a null end leaves a range open."""
    return F.transform(
        affected,
        lambda span: F.struct(
            version_key(F.coalesce(span["introduced"], F.lit("0"))).alias("low"),
            version_key(span["fixed"]).alias("high"),
        ),
    )


def affects(spans: Column, versions: Column, version: Column, key: Column | None = None) -> Column:
    """Whether an advisory covers a version: listed, or inside a range.

    ``spans`` come from :func:`span_keys`, once per advisory, and ``key`` from
    :func:`version_key`, once per dependency.  An unpinned version is covered by every
    advisory.
    """
    key = version_key(version) if key is None else key
    return ~is_pinned(version) | covers(spans, versions, version, key)


def covers(spans: Column, versions: Column, version: Column, key: Column) -> Column:
    """Whether a version is listed or its key inside a range; null is neither."""
    in_range = F.exists(
        spans,
        lambda span: (span["low"] <= key) & (span["high"].isNull() | (key < span["high"])),
    )
    listed = F.array_contains(versions, version)
    return F.coalesce(in_range, F.lit(False)) | F.coalesce(listed, F.lit(False))
