"""Repeated byte strings across documents, found by ranking positions in Spark.

A position stands for the ``length`` bytes from it on.  Ranks of growing prefixes decide
which positions repeat: positions with equal ranks are sorted next to each other, get a
common finer rank, and leave when they are alone or when their whole string is settled.

Neighbouring positions share most of their bytes, so they are ranked together:

* Round 1: every position takes the least-hashed ANCHOR bytes among those inside its
  string.  Equal strings take the same ones at the same place, so the rank of the anchor
  is a first rank of the position.  Positions in a row with one anchor form a run.
* Round 2: what is left of a run is ranked in cells of CELL positions by the bytes that
  all of them share, all but CELL - 1 of their length.
* Round 3: what is left of a cell is ranked position by position, by whole strings.

In each round rows (rank, bytes beyond it, position) are sorted; of equal rows the first
position goes on and the others are covered, and a rank with one sort of bytes is done.
"""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shingles import mixed
from .store import save, shuffle_partitions

ANCHOR = 32
CELL = 8
_BASE = 0x9E3779B97F4A7C15
_COLUMNS = ["g", "x", "y", "pos", "len"]
_ROWS = T.StructType([T.StructField(n, T.LongType()) for n in _COLUMNS])
_COVERED = -1  # in y: a row that needs no ranking


def anchored_runs(data: bytes, length: int):
    """(first position, last position, anchor, its hash) of each run of positions."""
    h = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    step, base = 1, _BASE
    while step < ANCHOR:
        h = h[:-step] * np.uint64(base) + h[step:]
        base = base * base % (1 << 64)
        step *= 2
    h = mixed(h)
    # least hash, then leftmost place, in windows of length - ANCHOR + 1 places
    least = (h & np.uint64(0xFFFFFFFF << 32)) | np.arange(len(h), dtype=np.uint64)
    window, step = length - ANCHOR + 1, 1
    while step * 2 <= window:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if window > step:
        least = np.minimum(least[: step - window], least[window - step :])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([first[1:], [len(place)]]) - 1
    return first, last, place[first], h[place[first]]


def _batch(columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], _COLUMNS)


def _run_rows(texts: DataFrame, length: int, bits: int) -> DataFrame:
    """Round 1 rows of (doc, text); of equal runs in one batch only the first is ranked."""

    def rows(batches):
        for batch in batches:
            parts = []
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if data is None or len(data) < length:
                    continue
                first, last, place, h = anchored_runs(data, length)
                view = memoryview(data)
                name = np.fromiter(
                    (xxhash.xxh3_64_intdigest(view[a : b + length]) for a, b in zip(first.tolist(), last.tolist())),
                    np.uint64, len(first),
                )
                width = last - first + 1
                # the run's hash in x; its width and where its anchor stands in y
                y = width << 7 | place - first
                parts.append((h.astype(np.int64), name.astype(np.int64), y, (doc << bits) + first, width + length - 1))
            if not parts:
                continue
            g, x, y, pos, size = map(np.concatenate, zip(*parts))
            order = np.argsort(pos, kind="stable")
            g, x, y, pos, size = (c[order] for c in (g, x, y, pos, size))
            order = np.argsort(mixed(g.astype(np.uint64) + x.astype(np.uint64) * np.uint64(_BASE)), kind="stable")
            equal = [c[order][1:] == c[order][:-1] for c in (g, x, y)]
            again = np.concatenate([[False], equal[0] & equal[1] & equal[2]])
            later = np.zeros(len(g), bool)
            later[order[again]] = True
            begin, end = merged(pos[later], pos[later] + size[later])
            yield _batch([c[~later] for c in (g, x, y, pos, size)])
            spread = mixed(begin.astype(np.uint64)).astype(np.int64)
            yield _batch([spread, np.zeros_like(begin), np.full_like(begin, _COVERED), begin, end - begin])

    return texts.mapInArrow(rows, _ROWS)


def merged(begin: np.ndarray, end: np.ndarray):
    """Spans, ascending by begin, with those that overlap or touch made one."""
    if not len(begin):
        return begin, end
    reach = np.maximum.accumulate(end)
    new = np.concatenate([[True], begin[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    return begin[at], reach[np.concatenate([at[1:], [len(begin)]]) - 1]


def _ranked(rows: DataFrame) -> DataFrame:
    """The rows with ``open``: covered positions (false), or those that go on (true).

    Sorted by rank, bytes and position.  Of equal (g, x, y) the first goes on if its
    rank has others, all later ones are covered.  One row is held over from batch to
    batch, so a rank of any size streams through.
    """
    schema = T.StructType([*_ROWS.fields, T.StructField("open", T.BooleanType())])

    def out(columns, is_open):
        n = len(columns[0])
        return pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.int64()) for c in columns), pa.array(np.full(n, is_open))], schema.names
        )

    def walk(batches):
        last = None  # key of the row before
        held = None  # a first whose rank has shown nothing else so far
        rank = None  # rank of the first before
        for batch in batches:
            if not batch.num_rows:
                continue
            c = [col.to_numpy(zero_copy_only=False) for col in batch.columns]
            done = c[2] == _COVERED
            if done.any():
                yield out([v[done] for v in c], False)
                c = [v[~done] for v in c]
                if not len(c[0]):
                    continue
            g, x, y = c[:3]
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            if last is not None:
                new[0] = (g[0], x[0], y[0]) != last
            last = (g[-1], x[-1], y[-1])
            if not new.all():
                yield out([v[~new] for v in c], False)
            f = [v[new] for v in c]
            if not len(f[0]):
                continue
            fg = f[0]
            if held is not None and held[0] == fg[0]:
                yield out([np.array([v]) for v in held], True)
            before = np.concatenate([[rank is not None and fg[0] == rank], fg[1:] == fg[:-1]])
            after = np.concatenate([fg[1:] == fg[:-1], [False]])
            yield out([v[before | after] for v in f], True)
            rank = fg[-1]
            held = None if before[-1] else [v[-1] for v in f]

    n = shuffle_partitions(rows.sparkSession)
    ordered = rows.repartition(n, "g").sortWithinPartitions(*_COLUMNS[:4])
    return ordered.mapInArrow(walk, schema)


def _cell_rows(texts: DataFrame, left: DataFrame, length: int, bits: int) -> DataFrame:
    """Round 2 rows: the open runs in cells, ranked by the bytes a cell shares.

    x and y hold the up to CELL - 1 bytes on either side of those, as they are, and
    which of the cell's positions the run has.
    """
    start = F.col("pos").bitwiseAND(F.lit((1 << bits) - 1))
    runs = left.select(F.shiftright("pos", bits).alias("_doc"), F.struct(start.alias("s"), "g", "y").alias("r"))
    runs = runs.groupBy("_doc").agg(F.collect_list("r").alias("runs"))
    joined = texts.join(runs, "_doc").select("_doc", "_z", "runs")
    shared = length - CELL + 1

    def rows(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for doc, packed, runs in zip(*(c.to_pylist() for c in batch.columns)):
                data, made = unpack(packed), []
                for run in runs:
                    width, at = run["y"] >> 7 & 127, run["y"] & 127
                    anchor, seed = run["s"] + at, run["g"] & (1 << 63) - 1
                    lo = at - width + 1  # bytes in front of the anchor: lo to at
                    for cell in range(lo // CELL, at // CELL + 1):
                        base = anchor - cell * CELL
                        k0, k1 = max(lo - cell * CELL, 0), min(at - cell * CELL, CELL - 1)
                        end = base + shared
                        made.append((
                            xxhash.xxh3_64_intdigest(data[base:end], seed ^ cell),
                            int.from_bytes(data[base - k1 : base], "big") | k0 << 56 | k1 << 59,
                            int.from_bytes(data[end : end + CELL - 1 - k0], "little"),
                            (doc << bits) + base - k1,
                            k1 - k0 + length,
                        ))
                c = list(zip(*made))
                yield _batch([np.array(c[0], np.uint64).astype(np.int64), *(np.array(v, np.int64) for v in c[1:])])

    return joined.mapInArrow(rows, _ROWS)


def _position_rows(left: DataFrame, length: int) -> DataFrame:
    """Round 3 rows: the positions of the open cells, ranked by whole strings."""

    def rows(batches):
        for batch in batches:
            g, x, y, pos, _ = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:5])
            k0, k1 = x >> 56 & 7, x >> 59 & 7
            for k in range(CELL):
                has = (k0 <= k) & (k <= k1)
                front = x[has] & ((1 << 8 * k) - 1)
                back = y[has] & ((1 << 8 * (CELL - 1 - k)) - 1)
                rank = mixed(g[has].astype(np.uint64) + np.uint64(_BASE * (k + 1) % (1 << 64)))
                # the string is the cell's shared bytes with these: x and y tell it from others
                yield _batch([rank.astype(np.int64), front, back, pos[has] + k1[has] - k, np.full(has.sum(), length)])

    return left.select(*_COLUMNS).mapInArrow(rows, _ROWS)


def remove_repeats(
    docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row.

    Texts are UTF-8 bytes; a null text counts as empty.  A byte is removed if a string
    of ``length`` bytes that covers it also starts earlier: in a document with a
    smaller id, or earlier in its own.  Overlapping starts count, strings do not cross
    documents, and they are judged on the input.  Rows that repeat an id stand in the
    order of their texts, null ids last.  ``spans`` lists the removed runs as (begin,
    end).  Texts shorter than ``length`` keep everything; an empty table gives no rows.

    Texts cross the network compressed, twice; all ranking moves rows of five numbers.
    Strings are told apart by hashes of 64 bits and more within one anchor, itself known
    by 64.  Ids may be of any kind that can be sorted; a text so long, and so many
    documents, that their places do not fit in 62 bits are refused.
    """
    if not 2 * ANCHOR <= length <= ANCHOR + 127:
        raise ValueError(f"length must be from {2 * ANCHOR} to {ANCHOR + 127}")
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    longest = F.max(F.octet_length("_text"))
    facts = base.agg(
        longest.alias("longest"), F.count("*").alias("n"), F.count_distinct("_id").alias("ids"),
        F.min("_id").alias("lo"), F.max("_id").alias("hi"),
    ).first()
    bits = int(facts["longest"] or 1).bit_length()
    whole = isinstance(base.schema["_id"].dataType, T.IntegralType)
    plain = whole and facts["n"] == facts["ids"] and max(abs(facts["lo"] or 0), abs(facts["hi"] or 0)) < 1 << (62 - bits)
    if plain:
        base = base.withColumn("_doc", F.col("_id").cast("bigint"))
    else:
        base = _numbered(base)
        last = base.agg(F.max("_doc").alias("m")).first()["m"] or 0
        if last >= 1 << (62 - bits):
            raise OverflowError(f"{last + 1} documents with texts of up to {facts['longest']} bytes")
    texts = base.select("_doc", F.col("_text").cast("binary").alias("_text"))
    packed = _packed(texts)

    one = save(_ranked(_run_rows(texts, length, bits)), "ranked-runs")
    two = save(_ranked(_cell_rows(packed, one.where("open"), length, bits)), "ranked-cells")
    three = _ranked(_position_rows(two.where("open"), length)).where("NOT open")
    spans = (
        one.where("NOT open").select("pos", "len")
        .union(two.where("NOT open").select("pos", "len"))
        .union(three.select("pos", "len"))
        .select(
            F.shiftright("pos", bits).alias("_doc"),
            F.struct(F.col("pos").bitwiseAND(F.lit((1 << bits) - 1)).alias("s"), "len").alias("r"),
        )
        .groupBy("_doc")
        .agg(F.collect_list("r").alias("runs"))
    )
    ids = base.select("_doc", "_id") if not plain else None
    found = _cut(packed.join(spans, "_doc", "left").select("_doc", "_z", "runs"))
    if ids is None:
        return found.withColumnRenamed("_doc", id_col)
    return found.join(ids.withColumnRenamed("_id", id_col), "_doc").drop("_doc").select(id_col, *found.columns[1:])


def _numbered(base: DataFrame) -> DataFrame:
    """The rows, written in the order of (id, text) and numbered in it."""
    n = shuffle_partitions(base.sparkSession)
    keys = [F.col("_id").asc_nulls_last(), F.col("_text")]
    ordered = base.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    written = save(ordered.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    row = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    most = (written.agg(F.max(row).alias("m")).first()["m"] or 0) + 1
    return written.select("_id", "_text", (F.shiftright("_at", 33) * most + row).alias("_doc"))


def _packed(texts: DataFrame) -> DataFrame:
    def pack(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            blobs = [squeeze(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], ["_doc", "_z"])

    return texts.mapInArrow(pack, "_doc bigint, _z binary")


def _cut(joined: DataFrame) -> DataFrame:
    span = T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType(
        [T.StructField(n, T.LongType()) for n in ("_doc", "n_bytes", "n_removed", "n_spans")]
        + [T.StructField("kept_sha256", T.StringType()), T.StructField("spans", T.ArrayType(span))]
    )

    def cut(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            sizes, removed, counts, shas, spans = [], [], [], [], []
            for packed, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = unpack(packed)
                begin = np.array([r["s"] for r in runs or ()], np.int64)
                end = begin + np.array([r["len"] for r in runs or ()], np.int64)
                order = np.argsort(begin)
                begin, end = merged(begin[order], end[order])
                kept, at = hashlib.sha256(), 0
                for b, e in zip(begin.tolist(), end.tolist()):
                    kept.update(data[at:b])
                    at = e
                kept.update(data[at:])
                sizes.append(len(data))
                removed.append(int((end - begin).sum()))
                counts.append(len(begin))
                shas.append(kept.hexdigest())
                spans.append([{"begin": b, "end": e} for b, e in zip(begin.tolist(), end.tolist())])
            arrow = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in (sizes, removed, counts)),
                 pa.array(shas, pa.string()), pa.array(spans, arrow)],
                schema.names,
            )

    return joined.mapInArrow(cut, schema)
