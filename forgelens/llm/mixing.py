"""Mixing sources to target weights by temperature, in built-in functions only."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import save

STEPS = 50  # halvings of the exponent's interval
DIGITS = 6  # of the exponent that are kept
PER_BUCKET = 256  # rows of a source that one bucket of its permutation should hold
LEVEL = 3  # hash digits of a bucket that one running sum goes over


def words(text: Column) -> Column:
    """Tokens of a text for mixing: words between spaces and control spaces, and an end."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint") + 1


def _sum(values: Column, f) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + f(x))


def exponent(shares: Column, target_entropy: float, max_repeats: float, budget: Column) -> Column:
    """The temperature exponent for an array of source shares.

    The largest exponent up to 1 whose weights share^a / sum have an entropy of
    ``target_entropy`` times that of equal weights; raised, where needed, to the
    least one at which no source is read more than ``max_repeats`` times when
    ``budget`` times all tokens are drawn.  Found by bisection.
    """
    n = F.size(shares)

    def total(a):
        return _sum(shares, lambda s: F.exp(a * F.ln(s)))

    def entropy(a):
        mean = _sum(shares, lambda s: F.exp(a * F.ln(s)) * F.ln(s)) / total(a)
        return F.ln(total(a)) - a * mean

    def repeats(a):
        least = F.array_min(shares)
        return budget * F.exp((a - 1) * F.ln(least)) / total(a)

    def bisect(low: Column, fine) -> Column:
        """The end of [low, 1] where ``fine`` turns from true to false, or 1."""
        start = F.struct(low.alias("low"), F.lit(1.0).alias("high"))

        def halve(x, _):
            middle = (x["low"] + x["high"]) / 2
            ok = fine(middle)
            return F.struct(
                F.when(ok, middle).otherwise(x["low"]).alias("low"),
                F.when(ok, x["high"]).otherwise(middle).alias("high"),
            )

        return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, halve)["high"]

    goal = F.lit(target_entropy) * F.ln(n.cast("double")) - 1e-12
    by_entropy = F.when(entropy(F.lit(1.0)) >= goal, F.lit(1.0)).otherwise(
        bisect(F.lit(0.0), lambda a: entropy(a) >= goal)
    )
    by_repeats = F.when(repeats(F.lit(0.0)) <= max_repeats, F.lit(0.0)).otherwise(
        bisect(F.lit(0.0), lambda a: repeats(a) > max_repeats)
    )
    return F.round(F.greatest(by_entropy, by_repeats), DIGITS)


def source_weights(
    sizes: DataFrame, target_entropy: float, max_repeats: float, budget: float, block_tokens: int
) -> DataFrame:
    """(source, source_tokens, exponent, weight, quota, per_block) from (source, source_tokens).

    The exponent needs one number per source, eight bytes each, and no row of data;
    three numbers pass the driver.
    """
    one = sizes.agg(
        F.sort_array(F.collect_list("source_tokens")).alias("all"),
        F.sum("source_tokens").alias("total"),
    )
    shares = F.transform("all", lambda t: t / F.col("total"))
    a = exponent(F.col("shares"), target_entropy, max_repeats, F.lit(budget))
    one = one.select("total", shares.alias("shares")).select("total", "shares", a.alias("exponent"))
    z = _sum(F.col("shares"), lambda s: F.exp(F.col("exponent") * F.ln(s)))
    found = one.select("total", "exponent", z.alias("z")).first()
    total, power, z = found["total"] or 1, found["exponent"], found["z"]
    weight = F.exp(F.lit(power) * F.ln(F.col("source_tokens") / F.lit(total))) / F.lit(z)
    weight = F.round(weight, 9)
    return sizes.select(
        "source",
        "source_tokens",
        F.lit(power).alias("exponent"),
        weight.alias("weight"),
        F.floor(weight * F.lit(total * budget) + 0.5).alias("quota"),
        F.greatest(F.floor(weight * block_tokens + 0.5), F.lit(1)).alias("per_block"),
    )


def _before_buckets(sums: DataFrame, digits: int) -> DataFrame:
    """(_key, epoch, _bucket, _before): a source's tokens in the buckets before each one.

    Summed level by level over groups of ``LEVEL`` hash digits, the first ones first, so
    that no window holds more than 16 ** LEVEL rows, however many buckets a source has.
    """
    group = ["_key", "epoch"]
    prefixes = [F.substring("_bucket", 1, min(d, digits)) for d in range(LEVEL, digits + LEVEL, LEVEL)]
    placed = sums.withColumn("_before", F.lit(0).cast("bigint"))
    for level, prefix in enumerate(prefixes or [F.col("_bucket")]):
        above = prefixes[level - 1] if level else F.lit("")
        totals = sums.groupBy(*group, above.alias("_above"), prefix.alias("_at")).agg(
            F.sum("_in_bucket").alias("_total")
        )
        order = Window.partitionBy(*group, "_above").orderBy("_at")
        totals = totals.select(*group, "_at", (F.sum("_total").over(order) - F.col("_total")).alias("_more"))
        placed = (
            placed.withColumn("_at", prefix)
            .join(totals, [*group, "_at"])
            .withColumn("_before", F.col("_before") + F.col("_more"))
            .drop("_at", "_more")
        )
    return placed.select(*group, "_bucket", "_before")


def temperature_mix(
    docs: DataFrame,
    target_entropy: float = 0.95,
    max_repeats: float = 4.0,
    budget: float = 1.0,
    block_tokens: int = 1 << 16,
    seed: str = "mix",
    id_cols: tuple[str, ...] = ("doc_id",),
    source_col: str = "source",
    text_col: str = "text",
    tokens_col: str | None = None,
) -> DataFrame:
    """The documents in the order in which a mixture of their sources is read.

    Every row is one reading: (ids, source, epoch, tokens, start, block, position,
    exponent, weight).  Each source is read in permutations of all its documents,
    one per epoch, until its share of ``budget`` times all tokens is used up; the
    document that reaches the end is read whole.  ``start`` counts the source's
    tokens before it.  A block holds about ``block_tokens`` tokens, of each source
    its weight; inside, rows are shuffled and numbered by ``position``.

    Null sources are a source of their own; null and empty texts count one token,
    their end.  Repeated rows are separate documents.  An empty table gives no rows.

    ``tokens_col`` names a column with the documents' token counts, such as n_tokens of
    :func:`~forgelens.llm.token_counts.token_counts`; null or negative ones count 0, and
    the end is added here.  Without it a document's words are counted, which makes little
    of scripts without spaces.

    The permutation is the order of md5(seed, epoch, first id).  Its running token
    count is summed over buckets of that hash first, level by level, and inside buckets
    then, so a source with most of the rows is spread like all others.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null"))
    if tokens_col is None:
        tokens = words(F.col(text_col).cast("string"))
    else:
        tokens = F.greatest(F.coalesce(F.col(tokens_col).cast("bigint"), F.lit(0)), F.lit(0)) + 1
    rows = docs.select(
        *id_cols, F.col(source_col).alias("source"), key.alias("_key"), tokens.alias("tokens")
    )
    rows = save(rows, "mix-tokens")
    per_source = rows.groupBy(F.col("_key").alias("source")).agg(
        F.sum("tokens").alias("source_tokens"), F.count("*").alias("n")
    )
    largest = per_source.agg(F.max("n").alias("n")).first()["n"] or 1
    digits = min(8, max(0, math.ceil(math.log(largest / PER_BUCKET, 16)))) if largest > PER_BUCKET else 0
    plan = source_weights(
        per_source.select("source", "source_tokens"), target_entropy, max_repeats, budget, block_tokens
    ).withColumnRenamed("source", "_key")
    plan = save(plan, "mix-plan")
    name = F.coalesce(F.col(id_cols[0]).cast("string"), F.lit(""))
    rounds = F.when(
        F.col("quota") > 0, F.sequence(F.lit(0).cast("bigint"), F.expr("(quota - 1) div source_tokens"))
    )
    readings = (
        rows.join(plan, "_key")
        .withColumn("epoch", F.explode(rounds))
        .withColumn("_hash", F.md5(F.concat_ws(":", F.lit(seed), F.col("epoch").cast("string"), name)))
        .withColumn("_bucket", F.substring("_hash", 1, digits) if digits else F.lit(""))
    )
    bucket = ["_key", "epoch", "_bucket"]
    in_buckets = save(readings.groupBy(*bucket).agg(F.sum("tokens").alias("_in_bucket")), "mix-buckets")
    sums = _before_buckets(in_buckets, digits)
    inside = Window.partitionBy(*bucket).orderBy("_hash", *id_cols, "tokens")
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = (
        F.col("epoch") * F.col("source_tokens")
        + F.col("_before")
        + F.sum("tokens").over(inside)
        - F.col("tokens")
    )
    placed = (
        readings.join(sums, bucket)
        .withColumn("start", start)
        .where("start < quota")
        .withColumn("block", F.expr("start div per_block"))
    )
    shuffled = F.md5(F.concat_ws(":", F.lit(seed), "_key", F.col("epoch").cast("string"), name))
    in_block = Window.partitionBy("block").orderBy(shuffled, *id_cols, "start")
    return placed.withColumn("position", F.row_number().over(in_block).cast("bigint")).select(
        *id_cols, "source", "epoch", "tokens", "start", "block", "position", "exponent", "weight"
    )
