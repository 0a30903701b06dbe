"""N-gram Jaccard join: near duplicates by a size-aware heavy-light set join."""

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shingles import shingle_hashes, shingle_sets
from .store import save, shuffle_partitions

#: Jaccard of at least 4/5, in whole numbers: 5 * common >= 4 * union.  The most that
#: two linked sets of n and m shingles can do with is ceil(4 (n + m) / 9) common ones,
#: and ceil(4 n / 5) for n alone.
SLOTS_BITS = 22  # slots of the frequency sketch, one byte each once added up: 4 MiB
_BLOCKS = 64
TEXTS = (1 << 16) - 1  # texts that a task counts before it hands its counters on
_PER_DOUBLING = 8  # levels of the sketch from one frequency to twice as much
LARGEST_LIGHT = 64  # sets above it are never enumerated
ROUNDS = 24  # pivot rounds at most before what is left in the lists is compared
PER_POSTING = 0.05  # pairs left for each posting at which pivot rounds may end
WORDS = 4  # 64-bit words of the short parity that stands beside a posting in the last join
EARLIER = 2  # lists before one in which the last join looks for a pair
LESS = 0.8  # they also end once a round leaves more than this share of the pairs


def needed(n):
    return (4 * n + 4) // 5


def frequency_sketch(docs: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """(levels, frequency): a level of each slot, the top bits of a shingle's hash, and
    about how often a shingle of that level occurs.

    Slots are counted in every task over whole texts, without a bound, and added up block
    by block in Spark.  Level 0 are slots that hold no more than chance deals to them;
    above, levels grow with the logarithm of what a slot holds beyond that, up to
    2 ** 31, so frequent shingles are told from rare ones at every size of the input.
    The levels have a fixed size and can be sent to all tasks.  They only order
    shingles, rare ones first; any order gives the same links.
    """
    size = 1 << SLOTS_BITS
    width = size // _BLOCKS
    most = TEXTS

    def count(batches):
        seen, texts = np.zeros(size, np.uint16), 0
        pack = zstandard.ZstdCompressor(level=1).compress

        def blocks():
            packed = [pack(seen[i * width : (i + 1) * width].tobytes()) for i in range(_BLOCKS)]
            return pa.RecordBatch.from_arrays(
                [pa.array(range(_BLOCKS), pa.int64()), pa.array(packed, pa.binary())], ["block", "counts"]
            )

        for batch in batches:
            for h in shingle_hashes(batch.column(0).to_pylist()):
                if texts == most:  # a text counts once, so no slot has overflowed
                    yield blocks()
                    seen[:], texts = 0, 0
                seen[(h >> np.uint64(64 - SLOTS_BITS)).astype(np.int64)] += 1
                texts += 1
        yield blocks()

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for block, counts in zip(*(c.to_pylist() for c in batch.columns)):
                own = sums.setdefault(block, np.zeros(width, np.uint64))
                own += np.frombuffer(unpack(counts), np.uint16)
        keys = list(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array([sums[k].tobytes() for k in keys], pa.binary()),
             pa.array([int(sums[k].sum()) for k in keys], pa.int64())],
            ["block", "counts", "total"],
        )

    schema = "block bigint, counts binary"
    texts = docs.select(F.col(text_col).cast("string").alias("_text"))
    counted = texts.mapInArrow(count, schema).repartition(_BLOCKS, "block")
    added = save(counted.mapInArrow(add, f"{schema}, total bigint"), "frequencies")
    mean = (added.agg(F.sum("total")).first()[0] or 0) / size
    # a few rare shingles above it come late, which costs less than frequent ones below
    chance = int(mean + 2 * mean**0.5 + 1)

    def rate(batches):
        for batch in batches:
            levels = [slot_levels(np.frombuffer(c, np.uint64), chance).tobytes() for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(levels, pa.binary())], ["block", "levels"])

    levels = np.zeros(size, np.uint8)
    for row in added.select("block", "counts").mapInArrow(rate, "block bigint, levels binary").collect():
        levels[row["block"] * width : (row["block"] + 1) * width] = np.frombuffer(row["levels"], np.uint8)
    frequency = chance + np.exp2((np.arange(256) - 1) / _PER_DOUBLING)
    frequency[0] = max(1, mean)
    return levels, frequency


def slot_levels(counts: np.ndarray, chance: int) -> np.ndarray:
    """0 for counts up to ``chance``, above it by the logarithm of the rest."""
    rest = np.maximum(counts.astype(np.float64) - chance, 0)
    levels = 1 + np.floor(_PER_DOUBLING * np.log2(np.maximum(rest, 1)))
    return np.where(rest > 0, np.minimum(levels, 255), 0).astype(np.uint8)


def _prefixes(docs: DataFrame, carry: list[str], text_col: str, sketch) -> DataFrame:
    """Per row: set size, digest and parity of the set, and its first shingles, rare ones first."""
    rows = docs.select(*carry, F.col(text_col).cast("string").alias("_text"))
    levels = docs.sparkSession.sparkContext.broadcast(sketch[0])
    frequency = sketch[1]
    schema = T.StructType(
        [rows.schema[c] for c in carry]
        + [T.StructField(n, T.LongType()) for n in ("n", "set_a", "set_b", "weight")]
        + [T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("parity", T.BinaryType())]
        + [T.StructField("words", T.ArrayType(T.LongType()))]
    )

    def each(batches):
        level_of = levels.value
        for batch in batches:
            sizes, first, second, weights, keys, ends, parities, words = [], [], [], [], [], [0], [], []
            for h in shingle_sets(batch.column(len(carry)).to_pylist()):
                n = len(h)
                a, b = np.frombuffer(hashlib.blake2b(h.tobytes(), digest_size=16).digest(), np.int64)
                level = level_of[(h >> np.uint64(64 - SLOTS_BITS)).astype(np.int64)]
                order = np.argsort(level, kind="stable")[: min(n, n - needed(n) + 2)]
                sizes.append(n)
                first.append(a)
                second.append(b)
                weights.append(int(frequency[level[order[:-1]]].sum()))
                keys.append(h[order].astype(np.int64))
                ends.append(ends[-1] + len(order))
                parities.append(parity(h))
                words.append(np.frombuffer(parity(h, 64 * WORDS), np.int64))
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            numbers = [pa.array(c, pa.int64()) for c in (sizes, first, second, weights)]
            short = pa.ListArray.from_arrays(
                pa.array(range(0, WORDS * len(words) + 1, WORDS), pa.int32()),
                pa.array(np.concatenate(words) if words else np.zeros(0, np.int64)),
            )
            columns = [*batch.columns[: len(carry)], *numbers, lists, pa.array(parities, pa.binary()), short]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(each, schema)


def choose_boundary(sets: DataFrame) -> int:
    """Size up to which sets are enumerated: where the summed cost is least.

    A light set of n costs the pairs of its first shingles; a heavy one a row for each
    of them and the rows met in their lists, as the frequency sketch counts them.  Sets
    just below the boundary are in both.  Sizes above LARGEST_LIGHT are heavy, so the
    driver gets that many sums at most.
    """
    sums = (
        sets.where(F.col("n") <= LARGEST_LIGHT)
        .groupBy("n")
        .agg(F.count("*").alias("sets"), F.sum("weight").alias("met"))
        .collect()
    )
    light, heavy = np.zeros(LARGEST_LIGHT + 1), np.zeros(LARGEST_LIGHT + 1)
    for row in sums:
        n = row["n"]
        first = n - needed(n) + 2
        light[n] = row["sets"] * first * (first - 1) / 2
        heavy[n] = row["sets"] * (first - 1) + row["met"]
    costs = [
        light[: x + 1].sum() + heavy[needed(x + 1) :].sum() for x in range(LARGEST_LIGHT + 1)
    ]
    return int(np.argmin(costs))


def _postings(sets: DataFrame, boundary: int) -> DataFrame:
    """(key, row, n, rest): every key of a set and how many common shingles it allows.

    Two linked sets share a pair among their first ceil(n / 5) + 2 shingles, and one
    among the first ceil(n / 5) + 1.  In the list of the first such key, ``rest``, the
    shingles from there on and those of the key, bounds what they have in common.
    Light sets that can link with the smallest heavy one stand in both kinds of list.
    """
    at = F.posexplode("keys").alias("pos", "key")
    single = sets.where(F.col("n") >= needed(boundary + 1)).select("row", "n", F.size("keys").alias("k"), at)
    single = single.where((F.col("pos") < F.col("k") - 1) | (F.col("n") < 2)).select(
        "key", "row", "n", (F.col("n") - F.col("pos")).alias("rest")
    )
    light = sets.where((F.col("n") <= boundary) & (F.col("n") > 1))
    pairs = F.flatten(
        F.transform(
            "keys",
            lambda k, i: F.transform(
                F.slice("keys", F.lit(1), i),
                lambda j: F.struct(F.xxhash64(j, k, F.lit(2)).alias("key"), i.alias("pos")),
            ),
        )
    )
    double = light.select("row", "n", F.explode(pairs).alias("p")).select(
        "p.key", "row", "n", (F.col("n") - F.col("p.pos") + 1).alias("rest")
    )
    return single.unionByName(double)


def _possible(a: str, b: str) -> Column:
    """Whether two postings of a list can belong to linked sets."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    common = F.least(F.col(f"{a}.rest"), F.col(f"{b}.rest"))
    return (9 * common >= 4 * (na + nb)) & (5 * na >= 4 * nb) & (5 * nb >= 4 * na)


def _with_earlier(postings: DataFrame) -> DataFrame:
    """The postings with the keys of the set's last EARLIER postings before each."""
    order = Window.partitionBy("row").orderBy(F.desc("rest"), "key")
    before = [F.lag("key", i).over(order).alias(f"before_{i}") for i in range(1, EARLIER + 1)]
    return postings.select("*", *before)


def _close(a: str, b: str) -> Column:
    """Whether two sets can be linked by their short parities, see :func:`_plausible`."""
    turned = sum(
        (F.bit_count(F.col(f"{a}.word_{i}").bitwiseXOR(F.col(f"{b}.word_{i}"))) for i in range(WORDS)), F.lit(0)
    )
    return 9 * turned <= F.col(f"{a}.n") + F.col(f"{b}.n")


def _met_earlier(a: str, b: str) -> Column:
    """Whether two postings of a list stand together in an earlier list of both sets too.

    What is possible in a list is possible in earlier ones, where more shingles follow.
    Going back from list to list ends at one that has the pair and no such list before it,
    so leaving out all others loses none, and a pair of long texts is not made again for
    each of the many keys that it shares.
    """
    same = F.lit(False)
    for i in range(1, EARLIER + 1):
        for j in range(1, EARLIER + 1):
            same = same | F.coalesce(F.col(f"{a}.before_{i}") == F.col(f"{b}.before_{j}"), F.lit(False))
    return same


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = np.sort(np.concatenate([a, b]))
    common = int((both[1:] == both[:-1]).sum())
    return 5 * common >= 4 * (len(both) - common)


def parity(h: np.ndarray, size: int | None = None) -> bytes:
    """Bits by the last bits of the hashes, each set if an odd number of them falls on it.

    Their number is ``size``, or the power of two from twice the set's size on, 64 at least.
    """
    size = size or max(64, 1 << max(2 * len(h) - 1, 0).bit_length())
    odd = np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def apart(a: bytes, b: bytes) -> int:
    """At most the number of shingles that one set has and the other has not: each of
    them turns one bit.  A longer parity is folded to the length of the other."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _plausible(pairs: DataFrame, parities: DataFrame) -> DataFrame:
    """The pairs (a, b) that may be similar by the parities of their sets.

    Sets of n and m that link differ in (n + m) / 9 shingles at most, so no link is lost.
    """
    left = parities.select(F.col("row").alias("a"), F.col("n").alias("na"), F.col("parity").alias("x"))
    right = parities.select(F.col("row").alias("b"), F.col("n").alias("nb"), F.col("parity").alias("y"))

    def near(batches):
        for batch in batches:
            sizes, x, y = (c.to_pylist() for c in batch.columns[2:])
            fine = [9 * apart(i, j) <= n for n, i, j in zip(sizes, x, y)]
            yield batch.select(["a", "b"]).filter(pa.array(fine, pa.bool_()))

    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    return both.select("a", "b", F.col("na") + F.col("nb"), "x", "y").mapInArrow(near, "a bigint, b bigint")


def _links(pairs: DataFrame, texts: DataFrame, parities: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough; texts move for plausible ones only."""
    pairs = _plausible(pairs, parities)
    left = texts.select(F.col("row").alias("a"), F.col("_z").alias("x"))
    right = texts.select(F.col("row").alias("b"), F.col("_z").alias("y"))

    def compare(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                a, b, x, y = (c.to_pylist() for c in some.columns)
                texts = dict(zip([*a, *b], [*x, *y]))  # each text of these pairs once
                plain = [unpack(z).decode("utf-8", "surrogatepass") for z in texts.values()]
                sets = dict(zip(texts, shingle_sets(plain)))
                fine = [similar(sets[i], sets[j]) for i, j in zip(a, b)]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(fine, pa.bool_())], ["a", "b", "linked"]
                )

    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return both.mapInArrow(compare, "a bigint, b bigint, linked boolean").where("linked").select("a", "b")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()
) -> DataFrame:
    """(id, carried columns, n_shingles, component_id, first) of every row.

    Two rows link when the distinct five-word shingles of their texts have a Jaccard
    similarity of at least 0.8; components are those of all links.  ``component_id`` is
    the smallest id in the component, ``first`` marks one row of it with that id.  A
    null or empty text, or one without words, links with nothing and is a component of
    its own, as is each of several such rows.  Null ids come after all others.
    Repeated rows link like any equal texts.  An empty table gives no rows.

    Equal sets are one set from the start.  Small sets enumerate the pairs of their
    rarest shingles, large ones stand in the inverted lists of single ones; where small
    ends is the cheapest size.  In each list the sets are first compared with one
    pivot; then only sets that are still in different components and can be similar
    by size and place meet, so a list of near copies costs as many rows as it has
    members.  Pairs are tried on parities of the sets, the last ones on short parities
    within their join, before their texts move.  All comparisons are exact on 64-bit shingle hashes.
    """
    sketch = frequency_sketch(docs, text_col)
    base = docs.select(F.col(id_col).alias("_id"), *carry, F.col(text_col).cast("string").alias("_text"))
    base = base.withColumn("_sha", F.xxhash64("_text"))
    prefixes = save(
        _prefixes(base, ["_id", *carry, "_sha"], "_text", sketch).withColumn(
            "row", F.monotonically_increasing_id()
        ),
        "prefixes",
    )
    order = F.struct(F.col("_id").isNull().alias("z"), F.col("_id").alias("id"), F.col("row").alias("row"))
    members = prefixes.select("_id", *carry, "n", "set_a", "set_b", "row")
    same = ["set_a", "set_b", "n"]
    classes = save(
        members.where("n > 0").groupBy(*same).agg(F.min(order).alias("least")).select(
            *same, F.col("least.row").alias("row")
        ),
        "set-classes",
    )
    sets = prefixes.select("row", "n", "weight", "keys").join(classes.select("row"), "row")
    boundary = choose_boundary(sets.select("n", "weight"))
    postings = save(_met(_postings(sets, boundary)), "postings")

    # the sets that stand in a list with another
    met = postings.select("row").distinct()
    wanted = prefixes.select(F.col("_id").alias("i"), F.col("_sha").alias("s"), "row").join(met, "row")
    packed = _packed(base)
    texts = packed.join(
        wanted, packed["_id"].eqNullSafe(wanted["i"]) & packed["_sha"].eqNullSafe(wanted["s"])
    ).select("row", "_z")
    texts = save(_one_each(texts), "texts")

    parities = save(prefixes.select("row", "n", "parity", "words").join(met, "row"), "parities")
    found = _compared(postings, texts, parities)
    own = found.select(F.col("node").alias("row"), "component")
    # a class stands for all rows with its set
    classes = classes.join(own, "row", "left").withColumn("component", F.coalesce("component", "row"))
    joined = members.join(classes.select(*same, "component"), same, "left")
    joined = joined.withColumn("component", F.coalesce("component", "row"))
    joined = save(joined.select("_id", *carry, "n", "row", "component"), "near")
    # written, so that the rows of a large component can be split among the tasks of the join
    least = joined.groupBy("component").agg(F.min(order).alias("least"), F.count("*").alias("of"))
    least = save(least.where("of > 1").drop("of"), "least")
    alone = F.col("least").isNull()
    return joined.join(least, "component", "left").select(
        F.col("_id").alias(id_col),
        *carry,
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("_id")).otherwise(F.col("least.id")).alias("component_id"),
        (alone | (F.col("row") == F.col("least.row"))).alias("first"),
    )


def _met(postings: DataFrame) -> DataFrame:
    """The postings of lists with at least two members.

    Rows are sorted by key and streamed.  A set is in a list once, so a list can hold
    no more than its share of all postings, and none is gathered.
    """
    columns = ["key", "row", "n", "rest"]
    packed = postings.select("key", "row", (F.shiftleft("n", 31) + F.col("rest")).alias("sizes"))
    n = shuffle_partitions(postings.sparkSession)
    ordered = packed.repartition(n, "key").sortWithinPartitions("key")

    def walk(batches):
        held = None  # the last row so far, and whether the one before has its key
        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            before = np.zeros(0, bool)
            if held is not None:
                rows, before = np.concatenate([held[0], rows], axis=1), np.array([held[1]])
            if not rows.shape[1]:
                continue
            same = rows[0, 1:] == rows[0, :-1]
            earlier = np.concatenate([before if len(before) else [False], same])
            keep = earlier[:-1] | same
            held = rows[:, -1:], bool(earlier[-1])
            yield out(rows[:, :-1][:, keep])
        if held is not None and held[1]:
            yield out(held[0])

    def out(rows):
        key, row, sizes = rows
        return pa.RecordBatch.from_arrays(
            [pa.array(c) for c in (key, row, sizes >> 31, sizes & (1 << 31) - 1)], columns
        )

    return ordered.mapInArrow(walk, "key bigint, row bigint, n bigint, rest bigint")


def _packed(base: DataFrame) -> DataFrame:
    """(_id, _sha, _z): texts as they cross the network, a third of their sets' size."""
    schema = T.StructType([base.schema["_id"], base.schema["_sha"], T.StructField("_z", T.BinaryType())])

    def pack(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            blobs = [squeeze((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], schema.names)

    return base.select("_id", "_sha", "_text").mapInArrow(pack, schema)


def _one_each(texts: DataFrame) -> DataFrame:
    """One of each run of rows with one number, which repeated rows of a table give."""

    def walk(batches):
        last = None
        for batch in batches:
            rows = batch.column(0).to_pylist()
            new = [r != b for r, b in zip(rows, [last, *rows])]
            last = rows[-1] if rows else last
            yield batch.filter(pa.array(new, pa.bool_()))

    return texts.mapInArrow(walk, texts.schema)


def _pairs_left(labelled: DataFrame) -> float:
    """Pairs of different components in one list, whether or not they can be similar."""
    parts = labelled.groupBy("key", "component").agg(F.count("*").cast("double").alias("c"))
    lists = parts.groupBy("key").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("own"))
    return lists.agg(F.sum(F.col("c") * F.col("c") - F.col("own")) / 2).first()[0] or 0.0


def _compared(postings: DataFrame, texts: DataFrame, parities: DataFrame) -> DataFrame:
    """(node, component) of all sets with a link, from their lists."""
    labels = tried = None
    labelled = postings.withColumn("component", F.col("row"))
    size, before = postings.count(), None
    for turn in range(ROUNDS):
        # the pivot of a list is a member of its largest component, another in each round
        parts = labelled.groupBy("key", "component").agg(
            F.count("*").alias("c"), F.min_by(F.struct("row", "n", "rest"), F.xxhash64("row", F.lit(turn))).alias("p")
        )
        pivots = parts.groupBy("key").agg(
            F.max_by(F.struct("p", "component"), F.struct("c", "component")).alias("q"),
            F.count("*").alias("components"),
        )
        pivots = pivots.where("components > 1").select("key", F.col("q.p").alias("y"), F.col("q.component").alias("d"))
        members = labelled.join(pivots, "key").select(
            F.struct("row", "n", "rest").alias("x"), "y", F.col("component") != F.col("d")
        ).toDF("x", "y", "open")
        fits = members.where(F.col("open") & _possible("x", "y"))
        fits = fits.select(F.col("x.row").alias("a"), F.col("y.row").alias("b")).distinct()
        if tried is not None:
            fits = fits.join(tried, ["a", "b"], "left_anti")
        fits = save(fits, "pivot-pairs")
        new = save(_links(fits, texts, parities), "pivot-links")
        tried = fits if tried is None else tried.union(fits)
        labels = components(new if labels is None else new.union(labels.toDF("a", "b")))
        labelled = postings.join(labels, postings["row"] == labels["node"], "left").select(
            "key", "row", "n", "rest", F.coalesce("component", "row").alias("component")
        )
        labelled = save(labelled, "labelled")
        left = _pairs_left(labelled)
        if left <= PER_POSTING * size or (before is not None and left > LESS * before):
            break
        before = left
    # lists in which several components are left
    open_lists = (
        labelled.groupBy("key")
        .agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        .where("lo <> hi")
        .select("key")
    )
    rest = _with_earlier(labelled.join(open_lists, "key"))
    words = [F.col("words")[i].alias(f"word_{i}") for i in range(WORDS)]
    rest = rest.join(parities.select("row", *words), "row")
    x, y = rest.alias("x"), rest.alias("y")
    pairs = x.join(
        y,
        (F.col("x.key") == F.col("y.key"))
        & (F.col("x.row") < F.col("y.row"))
        & (F.col("x.component") != F.col("y.component"))
        & _possible("x", "y")
        & _close("x", "y")
        & ~_met_earlier("x", "y"),
    ).select(F.col("x.row").alias("a"), F.col("y.row").alias("b"))
    seen = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = pairs.distinct().join(seen, ["a", "b"], "left_anti")
    last = save(_links(save(pairs, "open-pairs"), texts, parities), "open-links")
    return components(last.union(labels.toDF("a", "b")))
