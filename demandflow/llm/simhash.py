"""SimHash near-duplicate groups by anchor-point covering.

Fingerprints are 64 bits: word shingles are hashed with XXH64 (seed 42) and a bit
is set when more than half of the hashes set it. Two fingerprints are linked when
they differ in at most ``max_bits`` bits.

Links are found without comparing all pairs. The 64 bits are cut into
``max_bits // 2 + 1`` parts, so a linked pair differs in at most one bit of some
part. Over the first ``2**m - 1`` bits of a part the words of the Hamming code are
the anchors: the code is perfect with covering radius 1, so every fingerprint has
exactly one anchor within 1, and its partner (threshold 1) lies within radius plus
threshold = 2 of that anchor. Each distinct fingerprint is therefore replicated to
every anchor within distance 2 (at most ``2**(m-1)`` per part: 16 for 31 bits) and
fingerprints are compared per anchor on all 64 bits.

An anchor with more than ``BLOCK`` members (a large group of near copies) is cut
into blocks by hash; each pair of blocks is its own unit of work. Inside a unit a
breadth-first search keeps only the members not reached yet, so a dense group of n
costs about n comparisons, and it emits one edge per reached member, never all pairs.

Defined cases: null and blank texts have fingerprint 0 and link like any other;
fewer words than the shingle length: the whole sequence is one shingle; repeated
rows and null keys are kept, a null key never becomes a component id (a component
with null keys only has a null id); extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from demandflow.llm.common import release, free_name, stored
from demandflow.llm.components import components
from demandflow.session import ship_package

SEED = 42
#: Members of an anchor compared in one unit of work.
BLOCK = 20_000
#: Units up to this many members are compared shift by shift, many units at once.
SMALL = 24


def fingerprint(text: str | None, shingle: int) -> int:
    """The unsigned fingerprint of one whole text."""
    from xxhash import xxh64_intdigest

    found = (text or "").encode().lower().split()  # bytes: A-Z and the six white-space characters only
    if not found:
        return 0
    flat = b" ".join(found)
    if len(found) <= shingle:
        begin, end = [0], [len(flat)]
    else:
        at = np.zeros(len(found) + 1, dtype=np.int64)
        np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1, out=at[1:])
        begin, end = at[:-shingle].tolist(), (at[shingle:] - 1).tolist()
    counts, step = np.zeros(64, dtype=np.int64), 8192
    for k in range(0, len(begin), step):
        h = np.fromiter((xxh64_intdigest(flat[a:b], SEED) for a, b in zip(begin[k:k + step], end[k:k + step])),
                        np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(begin), bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.zeros(batch.num_rows, dtype=np.uint64)
            for at in range(0, batch.num_rows, 256):
                for k, t in enumerate(batch.column(2).slice(at, 256).to_pylist()):
                    fps[at + k] = fingerprint(t, shingle)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))],
                                  names=["key", "row_hash", "fp"])
        release()
    return run


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """key, row_hash (of key and text), fp (signed long) per row."""
    ship_package(df.sparkSession)
    k, t = F.col(key).cast("long"), F.col(text).cast("string")
    return df.select(k.alias("key"), F.xxhash64(k, t).alias("row_hash"), t.alias("text")).mapInArrow(
        _fingerprints(shingle), "key long, row_hash long, fp long")


def hamming_masks(m: int) -> list[list[int]]:
    """For each syndrome of the Hamming code with ``m`` check bits: the flips that
    lead to an anchor at distance 2 or less."""
    n = 2 ** m - 1
    flip = lambda *at: sum(1 << (i - 1) for i in at)
    return [[0]] + [[flip(s)] + [flip(i, i ^ s) for i in range(1, n + 1) if i < i ^ s] for s in range(1, n + 1)]


def anchors(fp: Column, max_bits: int) -> Column:
    """Array of the anchors of a fingerprint: (part, code word) packed into a long."""
    parts = max_bits // 2 + 1
    width = 64 // parts
    m = (width + 1).bit_length() - 1
    n = 2 ** m - 1
    masks = F.array(*[F.array(*[F.lit(x).cast("long") for x in row]) for row in hamming_masks(m)])
    out = []
    for p in range(parts):
        bits = F.shiftrightunsigned(fp, p * width).bitwiseAND(F.lit(2 ** n - 1).cast("long"))
        syndrome = F.lit(0)
        for j in range(m):
            check = sum(1 << (i - 1) for i in range(1, n + 1) if i >> j & 1)
            parity = F.bit_count(bits.bitwiseAND(F.lit(check).cast("long"))).bitwiseAND(F.lit(1))
            syndrome = syndrome + F.shiftleft(parity, j)
        tag = F.lit(p << n).cast("long")
        tagged = bits.bitwiseOR(tag)
        out.append(F.transform(F.element_at(masks, syndrome + 1), tagged.bitwiseXOR))
    return F.concat(*out)


def forest(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, root) that connect exactly the linked members of one unit."""
    left, us, vs = fps, [], []
    while len(left) > 1:
        root, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            step = max(1, 2_000_000 // len(left))
            some, front = front[:step], front[step:]
            near = (np.bitwise_count(some[:, None] ^ left[None, :]) <= max_bits).any(axis=0)
            found, left = left[near], left[~near]
            us.append(found)
            vs.append(np.full(len(found), root))
            front = np.concatenate([front, found])
    return (np.concatenate(us), np.concatenate(vs)) if us else (fps[:0], fps[:0])


def _units(unit: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of whole units; rows of a unit are adjacent."""
    starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]]) if len(unit) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(unit)])
    us, vs = [fps[:0]], [fps[:0]]
    end = np.repeat(starts + sizes, sizes)
    small = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SMALL), sizes))
    for shift in range(1, SMALL):
        small = small[small + shift < end[small]]
        if not len(small):
            break
        near = small[np.bitwise_count(fps[small] ^ fps[small + shift]) <= max_bits]
        us.append(fps[near])
        vs.append(fps[near + shift])
    for k in np.flatnonzero(sizes > SMALL):
        u, v = forest(np.unique(fps[starts[k]:starts[k] + sizes[k]]), max_bits)
        us.append(u)
        vs.append(v)
    pairs = np.unique(np.stack([np.concatenate(us), np.concatenate(vs)]), axis=1)
    return pairs[0], pairs[1]


def _links(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_unit, held_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def emit(unit, fps):
            u, v = _units(unit, fps, max_bits)
            return pa.record_batch([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for batch in batches:
            unit = np.r_[held_unit, batch.column(0).to_numpy()]
            fps = np.r_[held_fp, batch.column(1).to_numpy().view(np.uint64)]
            if not len(unit):
                continue
            cut = int(np.flatnonzero(unit != unit[-1])[-1]) + 1 if (unit != unit[-1]).any() else 0
            if cut:
                yield emit(unit[:cut], fps[:cut])
            held_unit, held_fp = unit[cut:], fps[cut:]
        yield emit(held_unit, held_fp)
    return run


def links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column ``fp``): not every linked
    pair, but enough that the components are exactly those of all links."""
    members = fps.select("fp", F.explode(anchors(F.col("fp"), max_bits)).alias("anchor"))
    hot = stored(members.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK), "hot")
    cold = members.select(F.col("anchor").alias("unit"), "fp")
    if not hot.isEmpty():
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
        split = members.join(hot, "anchor").select("fp", "anchor", own.alias("b"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("o"))
        split = split.select(F.xxhash64("anchor", F.least("b", "o"), F.greatest("b", "o")).alias("unit"), "fp")
        cold = members.join(hot, "anchor", "left_anti").select(F.col("anchor").alias("unit"), "fp").union(split)
    return cold.repartition("unit").sortWithinPartitions("unit").mapInArrow(_links(max_bits), "u long, v long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3,
                    max_bits: int = 3) -> DataFrame:
    """key, row_hash, fp and component_id (smallest key reachable over links) per row."""
    rows = stored(fingerprints(df, key, text, shingle), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("key").alias("first")), "distinct")
    roots = components(links(distinct, max_bits))
    first = stored(roots.join(distinct, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("first").alias("f1")), "first")
    smallest = first.join(distinct, F.col("root") == F.col("fp")).select("root", F.least("f1", "first").alias("component_id"))
    smallest = stored(smallest, "smallest")
    member = roots.join(smallest, "root").select("node", "component_id")
    member = stored(member.union(smallest.select(F.col("root").alias("node"), "component_id")), "member")
    ids = distinct.join(member, F.col("node") == F.col("fp"), "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return rows.join(stored(ids, "ids"), "fp").select("key", "row_hash", "fp", "component_id")


def one_per_group(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3,
                  max_bits: int = 3) -> DataFrame:
    """The rows of ``df`` that stay: of each group the row with the smallest key
    (null keys last), one row where rows repeat. Columns are unchanged."""
    found = near_duplicates(df, key, text, shingle, max_bits)
    rank = F.struct(F.col("key").isNull(), F.col("key"), F.col("row_hash"))
    # by fingerprint first: a group of copies is reduced before the shuffle on its component
    best = found.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("g")).agg(F.min(rank).alias("best"))
    row, other = free_name(df, "_row"), free_name(df, "_hash")
    keep = stored(best.select(F.col("best.row_hash").alias(other)).distinct(), "keep")
    # the hash covers key and text; as the only join key it also serves the removal of
    # repeated rows, so texts are exchanged once
    hashed = df.withColumn(row, F.xxhash64(F.col(key).cast("long"), F.col(text).cast("string")))
    kept = hashed.join(keep, F.col(row) == F.col(other), "left_semi")
    return kept.dropDuplicates([row, key]).select(*df.columns)
