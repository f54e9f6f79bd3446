"""Shards of near-equal bytes by histogram sort."""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass, field
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, pack, unpack

#: Candidate boundaries lie so densely that a piece between two has this share of all rows at most, where keys differ,
#: and so many bytes on average from the first round on, up to 2^18 pieces.
PIECE_SHARE, PIECE_BYTES = 1 / 1024, 1 << 29


def round_bits(size: int) -> tuple[int, ...]:
    """Bits of the two 64-bit keys that each round of probes adds: the first five rounds split the first key.

    The first round has 12 bits, and more where so many bytes make more pieces.
    """
    first = min(18, max(12, (size // PIECE_BYTES).bit_length()))
    rest = [(64 - first + k) // 4 for k in range(4)]
    return first, *rest, 12, 13, 13, 13, 13


@dataclass
class Piece:
    """Rows between two neighbouring candidate boundaries: those whose keys have this prefix."""

    level: int
    prefix: tuple[int, int]
    rows: int
    size: int
    one_first: bool
    one_key: bool
    pieces: list[Piece] = field(default_factory=list)

    def leaves(self) -> list[Piece]:
        return [x for p in self.pieces for x in p.leaves()] if self.pieces else [self]


def prefix(level: int, bits: tuple[int, ...]) -> tuple[Column, Column]:
    done = sum(bits[: level + 1])
    if done <= 64:
        return F.shiftrightunsigned("key1", 64 - done), F.lit(0).cast("long")
    return F.col("key1"), F.shiftrightunsigned("key2", 128 - done)


def with_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The sort key: first the text's hash, so that equal texts stay together, then that of the id."""
    row = F.col("_row")
    return pack(docs).withColumns({"key1": F.xxhash64(row.getField(text_col)), "key2": F.xxhash64(row.getField(id_col), F.lit(3)), "size": F.coalesce(F.octet_length(row.getField(text_col)), F.lit(0)).cast("long") + 1})


def count_below(keys: DataFrame, level: int, within: list[Piece] | None, bits: tuple[int, ...]) -> list[Piece]:
    """Exact rows and bytes between the candidate boundaries of a level, for the pieces in question."""
    p1, p2 = prefix(level, bits)
    if within is not None:
        q1, q2 = prefix(within[0].level, bits)
        asked = keys.sparkSession.createDataFrame([p.prefix for p in within], "q1 long, q2 long")
        keys = keys.join(F.broadcast(asked), (q1 == F.col("q1")) & (q2 == F.col("q2")), "left_semi")
    counted = keys.groupBy(p1.alias("p1"), p2.alias("p2")).agg(
        F.count("*").alias("rows"), F.sum("size").alias("size"), (F.min("key1") == F.max("key1")).alias("one_first"), (F.min("key2") == F.max("key2")).alias("one_second")
    )
    return [Piece(level, (r["p1"], r["p2"]), r["rows"], r["size"], r["one_first"], r["one_first"] and r["one_second"]) for r in counted.collect()]


def unsigned(p: tuple[int, int]) -> tuple[int, int]:
    return p[0] % (1 << 64), p[1] % (1 << 64)


def parent_prefix(p: Piece, level: int, rounds: tuple[int, ...]) -> tuple[int, int]:
    """The prefix of p at an earlier level."""
    bits, of = sum(rounds[: level + 1]), sum(rounds[: p.level + 1])
    first = unsigned(p.prefix)[0]
    if bits <= 64:
        return first >> (min(64, of) - bits), 0
    return first, unsigned(p.prefix)[1] >> (of - bits)


def find_pieces(keys: DataFrame, n_shards: int, tolerance: float, bits: tuple[int, ...]) -> list[Piece]:
    """Refine the candidate boundaries, a round of exact counting after another, until every splitter is met."""
    top = Piece(-1, (0, 0), 0, 0, False, False)
    top.pieces = sorted(count_below(keys, 0, None, bits), key=lambda p: unsigned(p.prefix))
    if not top.pieces:
        return []
    rows, size = sum(p.rows for p in top.pieces), sum(p.size for p in top.pieces)
    while True:
        leaves, todo, end = top.leaves(), [], 0
        edges = [0, *accumulate(p.size for p in leaves)]
        for at, p in enumerate(leaves):
            start, end = edges[at], edges[at + 1]
            inside = [size * j / n_shards for j in range(1, n_shards) if start < size * j / n_shards < end]
            unmet = any(min(t - start, end - t) > tolerance * size / n_shards for t in inside)
            if (unmet or p.rows > max(1000, PIECE_SHARE * rows)) and not p.one_key and p.level + 1 < len(bits):
                todo.append(p)
        if not todo:
            return leaves
        for level in {p.level for p in todo}:
            for jump in (False, True):  # where all rows of a piece have the same text, the second key splits it
                asked = [p for p in todo if p.level == level and (p.one_first and level < 4) == jump]
                if not asked:
                    continue
                found = count_below(keys, 5 if jump else level + 1, asked, bits)
                of = {unsigned(p.prefix): p for p in asked}
                for x in found:
                    of[parent_prefix(x, level, bits)].pieces.append(x)
                for p in asked:
                    p.pieces.sort(key=lambda x: unsigned(x.prefix))


def splitters(leaves: list[Piece], n_shards: int) -> list[int]:
    """The shard of each piece: splitter j is the boundary that is nearest to j shards' bytes."""
    edges = [0, *accumulate(p.size for p in leaves)]
    cuts = []
    for j in range(1, n_shards):
        target = edges[-1] * j / n_shards
        k = bisect_left(edges, target)
        k = k - 1 if k and (k == len(edges) or target - edges[k - 1] <= edges[k] - target) else k
        cuts.append(max(k, cuts[-1] if cuts else 0))
    return [sum(c <= at for c in cuts) for at in range(len(leaves))]


def shard(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.01) -> DataFrame:
    """docs with shard (0 to n_shards - 1) and slot (gapless from 0 in each shard); shards have near-equal bytes.

    A row counts its text's UTF-8 bytes (null: none) plus 1. Rows are in order of the text's hash, then that of
    the id; equal texts share a shard unless a group is so large that a splitter must fall inside it. A splitter
    is within tolerance of its exact place (a share of a shard) unless rows of equal id and text, or one single
    row, lie across it. Null ids and texts are values like any other; repeated rows each get a slot of their own.
    An empty table gives an empty one; fewer rows than shards leave shards empty. Columns of docs named shard or
    slot are replaced.

    The driver gets counts only: 4,096 in the first round, up to 2^18 for very large tables, and 8,192 for each piece that is refined. Rows
    move once, dealt by piece, so neither a shard nor a hot group is ever gathered in one task.
    """
    keyed = with_keys(docs, id_col, text_col)
    keys = materialize(keyed.select("key1", "key2", "size"), "keys")
    bits = round_bits(keys.agg(F.sum("size")).first()[0] or 0)
    leaves = find_pieces(keys, n_shards, tolerance, bits)
    placed = splitters(leaves, n_shards)
    seen = [0] * n_shards
    rows: dict[int, list] = {}
    for at, (p, s) in enumerate(zip(leaves, placed, strict=True)):
        rows.setdefault(p.level, []).append((*p.prefix, at, s, seen[s]))
        seen[s] += p.rows
    found = []
    for level, table in rows.items():
        names = [f"{c}_{level}" for c in ("p1", "p2", "piece", "shard", "first")]
        places = docs.sparkSession.createDataFrame(table, ", ".join(f"{c} {t}" for c, t in zip(names, ("long", "long", "int", "int", "long"), strict=True)))
        p1, p2 = prefix(level, bits)
        keyed = keyed.join(F.broadcast(places), (p1 == F.col(names[0])) & (p2 == F.col(names[1])), "left")
        found.append(names)
    best = {c: F.coalesce(*[F.col(n[i]) for n in found]) if found else F.lit(None).cast(t) for i, (c, t) in enumerate((("piece", "int"), ("shard", "int"), ("first", "long")), 2)}
    keyed = keyed.select("_row", "key1", "key2", *[v.alias(c) for c, v in best.items()])
    rank = F.row_number().over(Window.partitionBy("piece").orderBy("key1", "key2"))
    slots = keyed.withColumn("slot", (F.col("first") + rank - 1).cast("long"))
    return unpack(slots, docs.columns, shard=F.col("shard"), slot=F.col("slot"))
