"""SimHash near-duplicates: fingerprints are sharded by blocks of bits, and each shard is searched by a BK-tree.

A tree of all fingerprints would have to be broadcast whole and, at this radius, be walked almost whole for each
query. The pigeonhole principle gives smaller shards without loss: of `blocks` blocks of bits, fingerprints with
at most `radius` differing bits agree on at least `blocks - radius`, so every such choice of blocks is a shard key.
Shards meet by shuffle instead of broadcast, because their number grows with the data.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import discard, hot_from, join_by_heat, materialize

#: Shingles that are counted at a time, and bytes of a text that are cut into words at a time.
BLOCK_SHINGLES, BLOCK_BYTES = 1 << 15, 1 << 20
#: Fingerprints of a shard that one tree holds; larger shards are split into pairs of parts.
TREE_SIZE = 4096
#: Shingle sets, and shingles of them, that a part of a candidate group holds when its pairs are compared exactly.
PART_SETS, PART_SHINGLES = 1024, 1 << 22


def word_blocks(data: bytes, width: int) -> Iterator[list[bytes]]:
    """Words of data, in lists that overlap by width - 1 words, so that memory stays bounded on long texts."""
    carry: list[bytes] = []
    at, any_yet = 0, False
    while at < len(data):
        end = min(len(data), at + BLOCK_BYTES)
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        words = carry + data[at:end].split()
        at = end
        if len(words) >= width:
            yield words
            any_yet, carry = True, words[len(words) - width + 1 :] if width > 1 else []
        else:
            carry = words
    if carry and not any_yet:
        yield carry


def widened(digests: bytes, bits: int) -> np.ndarray:
    """Hashes of that many bits, as bytes, from 128-bit digests: word k mixes the first half plus k times the second."""
    halves = np.frombuffer(digests, np.uint64).reshape(-1, 2)
    x = halves[:, :1] + np.arange(bits // 64, dtype=np.uint64) * (halves[:, 1:] | np.uint64(1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return np.ascontiguousarray(x ^ (x >> np.uint64(31))).view(np.uint8)


def fingerprint(text: str | None, width: int, bits: int, seed: int) -> bytes:
    """SimHash of the word shingles of text, repeats included; a bit is set if it is in over half the hashes.

    A-Z are lower-cased; words are runs without ASCII white space. Fewer words than width: the whole sequence is
    the one shingle. No words or null: zero. Big-endian bytes.
    """
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    counts, total = np.zeros(bits, np.int64), 0
    for words in word_blocks(data, width):
        for at in range(0, max(1, len(words) - width + 1), BLOCK_SHINGLES):
            part = words[at : at + BLOCK_SHINGLES + width - 1]
            shingles = [b" ".join(part[i : i + width]) for i in range(max(1, len(part) - width + 1))]
            if bits == 64:
                hashes = np.frombuffer(b"".join([xxhash.xxh64_digest(s, seed) for s in shingles]), np.uint8).reshape(-1, 8)
            else:
                hashes = widened(b"".join([xxhash.xxh3_128_digest(s, seed) for s in shingles]), bits)
            for k in range(0, len(hashes), 255):  # so many ones at most fit into a byte
                counts += np.unpackbits(hashes[k : k + 255], axis=1).sum(axis=0, dtype=np.uint8)
            total += len(shingles)
    return np.packbits(2 * counts > total).tobytes()


def shingle_set(text: str | None, width: int, seed: int) -> np.ndarray:
    """The distinct shingles of text, cut as for fingerprint(): 128-bit hashes as rows of two words, in order of the first."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    found = [np.empty((0, 2), np.uint64)]
    for words in word_blocks(data, width):
        digests = [xxhash.xxh3_128_digest(b" ".join(words[i : i + width]), seed) for i in range(max(1, len(words) - width + 1))]
        found.append(np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2))
    halves = np.concatenate(found)
    return halves[np.unique(halves[:, 0], return_index=True)[1]]


def set_fingerprint(shingles: np.ndarray, bits: int) -> bytes:
    """SimHash of a shingle_set(): each shingle counts once, so that distances follow the Jaccard similarity."""
    counts = np.zeros(bits, np.int64)
    for at in range(0, len(shingles), BLOCK_SHINGLES):
        counts += np.unpackbits(widened(shingles[at : at + BLOCK_SHINGLES].tobytes(), bits).reshape(-1, bits // 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(shingles)).tobytes()


def with_fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int = 4, bits: int = 64, seed: int = 42) -> DataFrame:
    """(id, text_hash, fp) for every row of docs; text_hash tells rows of one id apart."""

    @F.pandas_udf("binary")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width, bits, seed) for t in texts], dtype=object)

    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), prints(F.col(text_col)).alias("fp"))


def block_tables(bits: int = 64, blocks: int = 6, radius: int = 4) -> list[list[int]]:
    """Bit numbers of each shard key: every choice of blocks - radius blocks. No pair within the radius is lost."""
    cut = np.array_split(np.arange(bits), blocks)
    return [[int(b) for k in chosen for b in cut[k]] for chosen in combinations(range(blocks), blocks - radius)]


def sampled_tables(bits: int, n_tables: int, key_bits: int, seed: int = 7) -> list[list[int]]:
    """Bit numbers of each shard key, drawn at random: for radii where the pigeonhole keys would be too short."""
    draw = random.Random(seed)
    return [draw.sample(range(bits), key_bits) for _ in range(n_tables)]


def tables_for(count: int, bits: int = 64, radius: int = 4) -> list[list[int]]:
    """block_tables() whose keys are so long that shards of count fingerprints stay within a tree; at least radius + 2 blocks."""
    blocks = radius + 2
    while bits * (blocks - radius) // blocks < math.log2(max(1, count) / TREE_SIZE) and blocks < 2 * radius + 2:
        blocks += 1
    return block_tables(bits, blocks, radius)


def similar_tables(count: int, bits: int = 512) -> list[list[int]]:
    """sampled_tables() for a similarity of 0.8 among count texts: keys of 15 bits or more, a shard having 1,000 texts or so.

    Two such texts agree on a bit with probability 0.85, so the number of keys grows with their length: they share
    one with probability 0.999 at any size of the corpus.
    """
    key_bits = max(15, math.ceil(math.log2(max(1, count) / 1024)))
    return sampled_tables(bits, math.ceil(7 / 0.85**key_bits), key_bits)


def hamming(many: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.bitwise_count(many ^ one).sum(axis=1, dtype=np.int64)


class BKTree:
    """Children are keyed by their integer Hamming distance to the parent.

    The tree is that of one insertion after another, but built from the root down: the members of a ring, those
    at one distance from the root, are the subtree below that edge.
    """

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        self.children: list[list[tuple[int, int]]] = [[] for _ in prints]
        todo = [np.arange(len(prints))] if len(prints) else []
        while todo:
            members = todo.pop()
            root, rest = members[0], members[1:]
            if len(rest) == 0:
                continue
            distance = hamming(prints[rest], prints[root])
            order = np.argsort(distance, kind="stable")
            rest, distance = rest[order], distance[order]
            starts = np.flatnonzero(np.r_[True, distance[1:] != distance[:-1]])
            for at, ring in zip(starts, np.split(rest, starts[1:]), strict=True):
                self.children[root].append((int(distance[at]), int(ring[0])))
                todo.append(ring)

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(node, numbers of the queries within the radius of it), following only edges within the radius."""
        todo = [(0, np.arange(len(queries)))] if len(self.prints) else []
        while todo:
            node, who = todo.pop()
            distance = hamming(queries[who], self.prints[node])
            near = who[distance <= radius]
            if len(near):
                yield node, near
            for edge, child in self.children[node]:
                below = who[np.abs(distance - edge) <= radius]
                if len(below):
                    todo.append((child, below))


def as_words(prints: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(prints), ">u8").astype(np.uint64).reshape(len(prints), -1)


def star_links(prints: list[bytes], radius: int, left: np.ndarray | None = None) -> list[tuple[bytes, bytes]]:
    """Links (member, root) that connect what is within the radius in a shard, one for each member at most.

    left: where given, only pairs of a left and a right member count.
    """
    words = as_words(prints)
    label = np.arange(len(prints))
    tree_of = np.arange(len(prints)) if left is None else np.flatnonzero(left)
    query_of = tree_of if left is None else np.flatnonzero(~left)
    for node, near in BKTree(words[tree_of]).search(words[query_of], radius):
        met = np.unique(np.r_[label[tree_of[node]], label[query_of[near]]])
        if len(met) > 1:
            label[np.isin(label, met)] = met[0]
    return [(prints[i], prints[k]) for i, k in enumerate(label) if i != k]


def _link_shards(radius: int, limit: int | None):
    """A function for mapInPandas over rows sorted by shard: links, and the rows of shards beyond the limit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[bytes] = []
        sides: list[bool] = []
        at: tuple | None = None
        over = False
        out: dict[str, list] = {}

        def reset() -> None:
            out.update({"hot": [], "shard": [], "key": [], "a": [], "b": []})

        def put(hot: bool, key: tuple, a: bytes, b: bytes | None) -> None:
            for name, v in (("hot", hot), ("shard", key[0]), ("key", key[1]), ("a", a), ("b", b)):
                out[name].append(v)

        def finish() -> None:
            if at is not None and not over and len(held) > 1:
                parts = None if at[2] == at[3] else np.array(sides)
                for a, b in star_links(held, radius, parts):
                    put(False, at, a, b)
            held.clear()
            sides.clear()

        reset()
        for batch in batches:
            for shard, key, lo, hi, part, fp in zip(*(batch[c] for c in ("shard", "key", "lo", "hi", "part", "fp")), strict=True):
                if (shard, key, lo, hi) != at:
                    finish()
                    at, over = (shard, key, lo, hi), False
                if over:
                    put(True, at, fp, None)
                    continue
                held.append(fp)
                sides.append(part == lo)
                if limit is not None and len(held) > limit:
                    for x in held:
                        put(True, at, x, None)
                    held.clear()
                    sides.clear()
                    over = True
            if len(out["hot"]) >= 10_000:
                yield pd.DataFrame(out)
                reset()
        finish()
        if out["hot"]:
            yield pd.DataFrame(out)

    return run


_LINKS = "hot boolean, shard int, key long, a binary, b binary"


def fingerprint_links(prints: DataFrame, radius: int, tables: list[list[int]], tree_size: int = TREE_SIZE) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of prints (column fp) that connect what is within the radius.

    A shard beyond tree_size fingerprints is split into parts, and each pair of parts is a shard of its own.
    """
    n_bits = max(max(t) for t in tables) + 1

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = list(batch["fp"])
            if not fps:
                continue
            bits = np.unpackbits(np.frombuffer(b"".join(fps), np.uint8).reshape(len(fps), -1), axis=1)
            assert bits.shape[1] >= n_bits
            for k, chosen in enumerate(tables):
                yield pd.DataFrame({"shard": np.int32(k), "key": bits[:, chosen] @ (1 << np.arange(len(chosen), dtype=np.int64)), "fp": fps})

    shards = prints.select("fp").distinct().mapInPandas(keys, "shard int, key long, fp binary")
    whole = shards.withColumns({c: F.lit(0) for c in ("lo", "hi", "part")})
    met = whole.repartition("shard", "key").sortWithinPartitions("shard", "key").mapInPandas(_link_shards(radius, tree_size), _LINKS)
    met = materialize(met, "shards")
    links, hot = met.where("not hot").select("a", "b"), met.where("hot")
    if hot.isEmpty():
        return links
    hot = hot.select("shard", "key", F.col("a").alias("fp"))
    parts = materialize(hot.groupBy("shard", "key").agg(F.ceil(F.count("*") / tree_size).cast("int").alias("n")), "hot")
    dealt = hot.join(parts, ["shard", "key"]).withColumn("part", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("n")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.withColumns({"lo": F.least("part", "other"), "hi": F.greatest("part", "other")})
    order = ["shard", "key", "lo", "hi"]
    more = dealt.select(*order, "part", "fp").repartition(*order).sortWithinPartitions(*order).mapInPandas(_link_shards(radius, None), _LINKS)
    return links.unionByName(materialize(more.select("a", "b"), "shards"))


def with_set_fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int, bits: int, seed: int) -> DataFrame:
    """(id, text_hash, fp, node, n) for every row of docs: node names the set of n shingles."""

    @F.pandas_udf("fp binary, node binary, n long")
    def prints(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            shingles = shingle_set(t, width, seed)
            rows.append((set_fingerprint(shingles, bits), xxhash.xxh3_128_digest(shingles[:, 0].tobytes()), len(shingles)))
        return pd.DataFrame(rows, columns=["fp", "node", "n"])

    found = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), prints(F.col(text_col)).alias("p"))
    return found.select("id", "text_hash", "p.fp", "p.node", "p.n")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted arrays of distinct values; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def similar_links(sets: list[np.ndarray], similarity: float, left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of numbers whose sets have the similarity, enough to connect all that such pairs connect.

    Pairs that are connected already aren't compared. left: where given, only pairs of a left and a right member count.
    """
    label = np.arange(len(sets))
    size = np.array([len(x) for x in sets])
    links = []
    for i in range(1, len(sets)):
        open_ = np.arange(i) if left is None else np.flatnonzero(left[:i] != left[i])
        open_ = open_[np.minimum(size[open_], size[i]) >= similarity * np.maximum(size[open_], size[i]) - 1e-9]
        open_ = open_[label[open_] != label[i]]
        while len(open_):
            k, open_ = open_[-1], open_[:-1]
            if jaccard(sets[k], sets[i]) >= similarity:
                links.append((int(k), i))
                label[label == label[i]] = label[k]
                open_ = open_[label[open_] != label[i]]
    return links


def _verify_groups(width: int, seed: int, similarity: float):
    """A function for mapInPandas over rows sorted by root, lo, hi: the similar pairs of each pair of parts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: tuple | None = None
        held: dict[bytes, tuple[np.ndarray, bool]] = {}

        def finish() -> list[tuple[bytes, bytes]]:
            nodes = list(held)
            sides = None if at is None or at[1] == at[2] else np.array([side for _, side in held.values()])
            found = [(nodes[i], nodes[k]) for i, k in similar_links([x for x, _ in held.values()], similarity, sides)]
            held.clear()
            return found

        for batch in batches:
            out = []
            for root, lo, hi, part, node, text in zip(*(batch[c] for c in ("root", "lo", "hi", "part", "node", "text")), strict=True):
                if (root, lo, hi) != at:
                    out += finish()
                    at = (root, lo, hi)
                if node not in held:
                    held[node] = (np.ascontiguousarray(shingle_set(text, width, seed)[:, 0]), part == lo)
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])
        if last := finish():
            yield pd.DataFrame(last, columns=["a", "b"])

    return run


def verified_links(docs: DataFrame, sets: DataFrame, id_col: str, text_col: str, width: int, seed: int, similarity: float) -> DataFrame:
    """Links (a, b) between nodes of sets, as far as the Jaccard similarity of their shingles is similarity or more.

    sets: node, n, first (a row of docs that has the set) and root, the group of candidates. All pairs of a group are
    compared; a large group is dealt into parts, and each pair of parts is compared on its own.
    """
    many = sets.groupBy("root").agg(F.count("*").alias("c"), F.sum("n").alias("n")).where("c > 1")
    parts = materialize(many.select("root", "c", F.ceil(F.greatest(F.col("c") / PART_SETS, F.col("n") / PART_SHINGLES)).cast("int").alias("parts")), "candidates")
    hot = hot_from(parts.agg(F.sum("c")).first()[0] or 0)
    members = join_by_heat(sets, parts, "root", "c", hot).select("root", "parts", "node", F.col("first.id").alias("_id"), F.col("first.text_hash").alias("_hash"))
    members = materialize(members, "members")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(members, F.col("id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash")))
    dealt = texts.withColumn("part", F.pmod(F.xxhash64("node"), F.greatest(F.lit(1), "parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), "parts") - 1)))
    order = ["root", "lo", "hi"]
    dealt = dealt.withColumns({"lo": F.least("part", "other"), "hi": F.greatest("part", "other")}).select(*order, "part", "node", "text")
    found = materialize(dealt.repartition(*order).sortWithinPartitions(*order).mapInPandas(_verify_groups(width, seed, similarity), "a binary, b binary"), "similar")
    discard(parts, members)
    return found


def least_row() -> Column:
    """The least row of a group: by id, nulls last, then by the hash of the text."""
    return F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash"))


def named_groups(firsts: DataFrame, roots: DataFrame, node: str) -> tuple[DataFrame, int]:
    """(node, rep_id, rep_hash, copies) for each row of firsts (node, first, copies), and from how many copies a node is hot.

    roots (node, root) are the components. first is the least row of a node, and the least of its group represents it.
    """
    of = firsts.join(roots.withColumnRenamed("node", node), node, "left")
    rooted = materialize(of.select(node, "first", "copies", F.coalesce("root", node).alias("root")), "rooted")  # a root stands for itself
    least = materialize(rooted.groupBy("root").agg(F.min("first").alias("least"), F.count("*").alias("nodes"), F.sum("copies").alias("all")), "least")
    sums = least.agg(F.sum("nodes"), F.sum("all")).first()
    named = join_by_heat(rooted, least.drop("all"), "root", "nodes", hot_from(sums[0] or 0))
    named = materialize(named.select(node, F.col("least.id").alias("rep_id"), F.col("least.text_hash").alias("rep_hash"), "copies"), "groups")
    discard(rooted, least)
    return named, hot_from(sums[1] or 0)


def similar_text_groups(docs: DataFrame, id_col: str, text_col: str, width: int, bits: int, radius: int, tables: list[list[int]] | None, seed: int, similarity: float) -> DataFrame:
    """As near_duplicate_groups, but fingerprints only find candidates: links are pairs of that Jaccard similarity."""
    prints = materialize(with_set_fingerprints(docs, id_col, text_col, width, bits, seed), "prints")
    distinct = materialize(prints.groupBy("fp", "node", "n").agg(least_row().alias("first"), F.count("*").alias("copies")), "distinct")
    links = fingerprint_links(distinct, radius, tables or similar_tables(distinct.count(), bits))
    near = components(links)
    sets = materialize(distinct.join(near.withColumnRenamed("node", "fp"), "fp", "left").select("node", "n", "first", "copies", F.coalesce("root", "fp").alias("root")), "sets")
    discard(links, near, distinct)
    similar = verified_links(docs, sets, id_col, text_col, width, seed, similarity)
    roots = components(similar)
    named, hot = named_groups(sets.select("node", "first", "copies"), roots, "node")
    discard(sets, similar, roots)
    return join_by_heat(prints, named, "node", "copies", hot).select("id", "text_hash", "fp", "rep_id", "rep_hash")


def near_duplicate_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, bits: int = 64, radius: int = 4, tables: list[list[int]] | None = None, seed: int = 42, similarity: float | None = None
) -> DataFrame:
    """One row (id, text_hash, fp, rep_id, rep_hash) for each row of docs.

    Rows are in one group if a chain of fingerprints links them, each at most radius bits from the next; equal
    fingerprints are always linked. rep_id is the smallest id of the group (nulls last) and rep_hash the text
    hash of that row (the smallest, on ties). Null and empty texts have fingerprint zero and are linked like any
    other. Repeated rows stay repeated. Without rows the result is empty. Other columns of docs are ignored.
    Where similarity is given, candidates are linked only if the sets of their shingles are that similar.
    """
    if similarity is not None:
        return similar_text_groups(docs, id_col, text_col, width, bits, radius, tables, seed, similarity)
    prints = materialize(with_fingerprints(docs, id_col, text_col, width, bits, seed), "prints")
    firsts = materialize(prints.groupBy("fp").agg(least_row().alias("first"), F.count("*").alias("copies")), "firsts")
    links = fingerprint_links(firsts, radius, tables or tables_for(firsts.count(), bits, radius))
    roots = components(links)
    named, hot = named_groups(firsts, roots, "fp")
    discard(firsts, links, roots)
    return join_by_heat(prints, named, "fp", "copies", hot).select("id", "text_hash", "fp", "rep_id", "rep_hash")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs without near-duplicates: of each group the representative stays, once, all columns kept.

    Repeated rows and rows that share id and text hash of the representative count as one.
    """
    groups = near_duplicate_groups(docs, id_col, text_col, **how)
    kept = groups.where("id <=> rep_id and text_hash = rep_hash").groupBy("id", "text_hash").agg(F.count("*").alias("n"))
    kept = materialize(kept.select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), "n"), "kept")

    def those(which: DataFrame) -> DataFrame:
        return docs.join(which, docs[id_col].eqNullSafe(which["_id"]) & (F.xxhash64(docs[text_col]) == which["_hash"]), "left_semi")

    repeated = kept.where("n > 1")
    once = those(kept.where("n = 1"))
    if repeated.isEmpty():
        return once
    return once.unionByName(those(repeated).dropDuplicates([id_col, text_col]))


#: For groups of texts whose five-word shingles have a similarity of 0.8 or more: at that Jaccard similarity two
#: fingerprints differ in 15 % of their bits, 77 of 512 on average, with a deviation of 8; the radius is four deviations
#: above. No pigeonhole key is long enough for such a radius, so shard keys are drawn bits, as many as similar_tables()
#: states. Fingerprints only find candidates: the shingles themselves are compared.
SIMILAR_TEXTS = {"width": 5, "bits": 512, "radius": 108, "similarity": 0.8}
