"""Near-duplicate documents by MinHash with tensored banding, every link confirmed on full sets.

A document's set holds its distinct five-word shingles (64-bit hashes). Two collections of KEYS keys are
formed, each key from HASHES min-hashes of its own; a table is keyed by one key of either collection, so
2 * KEYS * HASHES min-hashes serve KEYS ** 2 tables of 2 * HASHES min-hashes each, about the square root
of what separate tables would take. With 16 and 4, a pair at similarity 0.75 shares no table with a
chance of 0.005, one at 0.8 with 0.0005, one at 0.9 with less than one in a million; a group is missed only if all
its links are.

1. Documents with equal sets form one class; one row of each goes on, as a node.
2. Keys that only one node has are dropped. The pairs of the remaining ones, few for most nodes, are the
   tables' buckets.
3. Every node is compared with the smallest node of each of its buckets. Links give components.
4. Of the nodes whose keys, of either collection, several components still have, it is counted how many shingles of each any
   other of them has: no pair can share more than the smaller of its two counts, and what cannot reach
   the threshold so is left out. Texts with a passage in common and little else drop out here.
5. Of the rest, nodes outside the largest component of a first key are compared with PIVOTS further nodes of it. Where
   several components have a first key even then, they are compared with all nodes of other components that share a
   second key as well, each pair at the smallest first key that both have. So every pair that shares a bucket is compared,
   ruled out or already connected, while near copies that are connected cost a few comparisons for each node. From
   step 4 on a node takes part with its 2 * KEYS keys and not with its KEYS ** 2 tables.

Pairs go on to the comparison if their sizes and a sketch of 128 bits allow the threshold, those of the last
step also by one of 1024 bits (either turns down a pair at the threshold with a chance below one in 10,000),
and are then compared on the full sets. Everything stays in tables: nothing but counts reaches the driver.

Words are runs of ``[^\\x20\\x09-\\x0D]``, A-Z in lower case. With fewer than five words the whole
sequence is one shingle; without words the set is empty and linked with nothing. Null texts are empty. A null doc_id
is larger than all others. Rows are told apart by number, so repeated rows and ids are fine: they have
equal sets and are one class. An empty table gives no rows. Other columns are carried along by
``drop_near_copies`` and are not read by the rest.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinledger.llm.common import columns_of, numbered, written
from twinledger.llm.components import connected_components

SHINGLE, PERCENT = 5, 75
KEYS, HASHES = 16, 4
#: Nodes of each bucket with several components that the others are compared with before pairs are.
PIVOTS = 3
#: Of 128 sketch bits, how many may differ: 16 are expected at 0.75, with a deviation of 3.7.
SKETCH_BITS, SKETCH_DIFFERENCE = 128, 33
#: The same for the nodes of the last step: 128 are expected, with a deviation of 10.6.
LONG_BITS, LONG_DIFFERENCE = 1024, 170
#: Values that are held at once while min-hashes are formed: 1 MB for each step of the formula.
HELD_HASHES = 2**17
#: Nodes whose ids are broadcast when their texts are fetched; beyond it the texts are shuffled.
BROADCAST_NODES = 2_000_000
#: Words remembered by a worker: some 10 MB. Workers outlive a step, so this adds to the memory of all after it.
KEPT_WORDS = 80_000
_SIGNATURE = (
    "n_shingles long, set_a long, set_b long, keys_a array<long>, keys_b array<long>, "
    "sketch_a long, sketch_b long"
)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < KEPT_WORDS:
            self[word] = value
        return value


@lru_cache(maxsize=1)
def _words() -> _Words:
    return _Words()


@lru_cache(maxsize=8)
def _constants(n: int) -> np.ndarray:
    """n fixed odd 64-bit numbers."""
    values = [xxhash.xxh3_64_intdigest(f"minhash {i}") | 1 for i in range(n)]
    return np.array(values, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingle hashes of a whole text, sorted."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_words().__getitem__, words), np.uint64, len(words))
    factors = _constants(2 * SHINGLE)
    width = min(SHINGLE, len(words))
    count = len(words) - width + 1
    total = np.full(count, factors[SHINGLE + width - 1], np.uint64)  # differs by the number of words
    for i in range(width):
        total += hashes[i : i + count] * factors[i]
    return np.unique(_mixed(total))


def min_hashes(shingles: np.ndarray, n: int) -> np.ndarray:
    """n min-hashes of a set that is not empty."""
    factors = _constants(2 * SHINGLE + n)[2 * SHINGLE :, None]
    out = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    step = HELD_HASHES // n
    for at in range(0, len(shingles), step):
        part = shingles[None, at : at + step] ^ (factors >> np.uint64(7))
        out = np.minimum(out, (part * factors).min(axis=1))
    return out


def _sketch(mins: np.ndarray) -> np.ndarray:
    """A bit of each min-hash, 64 to a number."""
    bits = ((_mixed(mins) >> np.uint64(40)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


def signature(text: str | None) -> tuple:
    shingles = shingle_set(text)
    digest = xxhash.xxh3_128_digest(shingles.tobytes())
    set_a, set_b = np.frombuffer(digest, np.int64)
    if not len(shingles):
        return 0, set_a, set_b, [], [], 0, 0
    mins = min_hashes(shingles, 2 * KEYS * HASHES)
    grouped = _mixed(mins).reshape(2 * KEYS, HASHES)
    factors = _constants(HASHES)
    keys = _mixed((grouped * factors).sum(axis=1, dtype=np.uint64)).view(np.int64)
    sketch_a, sketch_b = _sketch(mins[:SKETCH_BITS])
    return len(shingles), set_a, set_b, keys[:KEYS], keys[KEYS:], sketch_a, sketch_b


def _signatures(docs: DataFrame) -> DataFrame:
    """_row, doc_id and the signature of every row of docs numbered as _llm_row."""

    @F.pandas_udf(_SIGNATURE)
    def sign(texts: pd.Series) -> pd.DataFrame:
        names = [column.split()[0] for column in _SIGNATURE.split(", ")]
        return pd.DataFrame([signature(t) for t in texts], columns=names, dtype=object)

    signed = docs.select(F.col("_llm_row").alias("_row"), "doc_id", sign("text").alias("s"))
    return signed.select("_row", "doc_id", "s.*")


def _full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, shingles: the whole sets of the given rows."""

    @F.pandas_udf("array<long>")
    def sets(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t).view(np.int64) for t in texts], dtype=object)

    if nodes.count() <= BROADCAST_NODES:
        nodes = F.broadcast(nodes)
    texts = docs.select(F.col("_llm_row").alias("node"), "text").join(nodes, "node", "left_semi")
    return texts.select("node", sets("text").alias("shingles"))


def _long_sketches(sets: DataFrame) -> DataFrame:
    """node, bits: a sketch of LONG_BITS of each set."""

    @F.pandas_udf("array<long>")
    def sketches(sets: pd.Series) -> pd.Series:
        return pd.Series(
            [_sketch(min_hashes(np.asarray(s, np.int64).view(np.uint64), LONG_BITS)) for s in sets], dtype=object
        )

    return sets.select("node", sketches("shingles").alias("bits"))


def _confirmed(spark: SparkSession, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """u, v: those pairs whose full sets reach the threshold."""
    of_u = sets.select(F.col("node").alias("u"), F.col("shingles").alias("set_u"))
    of_v = sets.select(F.col("node").alias("v"), F.col("shingles").alias("set_v"))
    common = F.size(F.array_intersect("set_u", "set_v"))
    union = F.size("set_u") + F.size("set_v") - F.col("common")
    return written(
        spark,
        pairs.join(of_v, "v")
        .join(of_u, "u")
        .select("u", "v", "set_u", "set_v", common.alias("common"))
        .filter(100 * F.col("common") >= PERCENT * union)
        .select("u", "v"),
    )


def _may_reach(n: str, m: str, sketches: tuple[str, str, str, str]):
    """Whether sizes and sketches allow the threshold."""
    a, b, c, d = (F.col(x) for x in sketches)
    sizes = 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)
    return sizes & (F.bit_count(a.bitwiseXOR(c)) + F.bit_count(b.bitwiseXOR(d)) <= SKETCH_DIFFERENCE)


def _shared_keys(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """node, firsts, seconds: the keys of either collection that other nodes have too, for nodes with both."""
    keys = nodes.select(
        "node", F.posexplode(F.concat("keys_a", "keys_b")).alias("slot", "key")
    ).select("node", (F.col("slot") < KEYS).alias("first"), F.xxhash64("slot", "key").alias("key"))
    shared = written(
        spark, keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    )
    held = keys.join(shared, "key", "left_semi").groupBy("node").agg(
        F.collect_list(F.when(F.col("first"), F.col("key"))).alias("firsts"),
        F.collect_list(F.when(~F.col("first"), F.col("key"))).alias("seconds"),
    )
    return written(spark, held.filter((F.size("firsts") > 0) & (F.size("seconds") > 0)))


def _held_keys(spark: SparkSession, nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """node, n, sketch_a, sketch_b, firsts, seconds: one row for each node that may share a table's key."""
    attributes = nodes.select("node", F.col("n_shingles").alias("n"), "sketch_a", "sketch_b")
    return written(spark, attributes.join(keys, "node"))


def _buckets(spark: SparkSession, held: DataFrame) -> DataFrame:
    """key, node, n, sketch_a, sketch_b: the places of nodes in those tables that others may share."""
    return written(
        spark, held.select(F.explode(_table_keys()).alias("key"), "node", "n", "sketch_a", "sketch_b")
    )


def _table_keys():
    """The keys of all tables: pairs of a key of either collection."""
    return F.flatten(F.transform("firsts", lambda a: F.transform("seconds", lambda b: F.xxhash64(a, b))))


def _links_to_smallest(spark: SparkSession, docs: DataFrame, buckets: DataFrame) -> DataFrame:
    centres = written(
        spark,
        buckets.groupBy("key")
        .agg(F.min("node").alias("u"), F.count(F.lit(1)).alias("members"))
        .filter("members > 1")
        .select("key", "u"),
    )
    stars = buckets.join(centres, "key").filter("u != node").select(
        "u", F.col("node").alias("v"), "n", "sketch_a", "sketch_b"
    )
    pairs = written(spark, stars.distinct())
    of_u = buckets.select(
        F.col("node").alias("u"), F.col("n").alias("m"), F.col("sketch_a").alias("a"), F.col("sketch_b").alias("b")
    ).distinct()
    of_u = written(spark, of_u.join(pairs.select("u").distinct(), "u", "left_semi"))
    allowed = pairs.join(of_u, "u").filter(_may_reach("n", "m", ("a", "b", "sketch_a", "sketch_b")))
    pairs = written(spark, allowed.select("u", "v"))
    nodes = written(spark, pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    return _confirmed(spark, pairs, written(spark, _full_sets(docs, nodes)))


def _shared_counts(spark: SparkSession, sets: DataFrame) -> DataFrame:
    """node, shared: how many of its shingles any other node of these has."""
    places = sets.select("node", F.explode("shingles").alias("shingle"))
    common = written(
        spark, places.groupBy("shingle").agg(F.count(F.lit(1)).alias("n_nodes")).filter("n_nodes > 1").select("shingle")
    )
    return places.join(common, "shingle", "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("shared"))


def _still_mixed(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """Those nodes of which a key has several roots, one row each, their ``keys`` cut to such keys.

    Only (node, root, key) goes through the keys, all else stays with the node.
    """
    places = nodes.select("node", "root", F.explode("keys").alias("key"))
    roots = places.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"))
    mixed = written(spark, roots.filter("least < most").select("key"))
    kept = places.join(mixed, "key", "left_semi").groupBy("node").agg(F.collect_list("key").alias("keys"))
    return written(spark, nodes.drop("keys").join(kept, "node"))


def _still_open(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """Those nodes that may share a bucket with a node of another root, ``firsts`` and ``seconds`` cut to keys that may.

    Both keys of a bucket with several roots have several. So keys are looked at one by one, and a node gives a
    row for each of its keys, 2 * KEYS at most, and not for each of its tables, which are up to KEYS ** 2.
    """
    mixed = _still_mixed(spark, nodes.withColumn("keys", F.concat("firsts", "seconds")))
    cut = mixed.withColumns({c: F.array_intersect(c, "keys") for c in ("firsts", "seconds")})
    return written(spark, cut.drop("keys").filter((F.size("firsts") > 0) & (F.size("seconds") > 0)))


def _outside(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """node, key, main, us: nodes and their keys with several roots, but for nodes of a key's most frequent root.

    That root is main, and us are PIVOTS nodes with the key. A key of near copies that are connected
    so gives rows for its other nodes only, however many have it.
    """
    places = nodes.select("node", "root", F.explode("keys").alias("key"))
    turns = [f"first_{turn}" for turn in range(PIVOTS)]
    least = [F.min(F.struct(F.xxhash64("node", F.lit(i)), "node")).alias(turn) for i, turn in enumerate(turns)]
    parts = places.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n_nodes"), *least)
    buckets = parts.groupBy(F.col("key").alias("bucket")).agg(
        F.count(F.lit(1)).alias("parts"),
        F.max(F.struct("n_nodes", "root"))["root"].alias("main"),
        F.array_distinct(F.array(*[F.min(turn)["node"] for turn in turns])).alias("us"),
    )
    buckets = written(spark, buckets.filter("parts > 1").drop("parts"))
    met = (F.col("key") == F.col("bucket")) & (F.col("root") != F.col("main"))
    return places.join(buckets, met).select("node", "key", "main", "us")


def _links_between(spark: SparkSession, docs: DataFrame, held: DataFrame, roots: DataFrame) -> DataFrame:
    """Links between components that share a bucket."""
    rooted = held.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    found = _still_open(spark, rooted)
    sets = written(spark, _full_sets(docs, written(spark, found.select("node"))))
    able = F.col("shared") * 100 >= F.col("n") * PERCENT
    open_ = _still_open(spark, found.join(written(spark, _shared_counts(spark, sets)), "node").filter(able))
    most = F.least("shared", "shared_u")
    enough = 100 * most >= PERCENT * (F.col("n") + F.col("m") - most)
    possible = (
        (F.col("root") != F.col("root_u")) & enough & _may_reach("n", "m", ("a", "b", "sketch_a", "sketch_b"))
    )
    # A few nodes of each first key against those outside its largest component.
    near = written(spark, _outside(spark, _by_first(open_)).select("node", F.explode("us").alias("u")).distinct())
    pairs = near.join(open_.drop("firsts", "seconds"), "node").join(_of_nodes(open_), "u").filter(possible)
    links = _confirmed(spark, written(spark, pairs.select("u", F.col("node").alias("v"))), sets)
    if not links.isEmpty():
        open_ = written(spark, open_.drop("root").join(_merged(spark, open_, links), "node"))
    pairs = _remaining_pairs(spark, open_, sets, possible)
    return written(spark, links.union(_confirmed(spark, pairs, sets)))


def _merged(spark: SparkSession, rows: DataFrame, links: DataFrame) -> DataFrame:
    """node, root: one row for each node of rows, its component grown by the links, drawn between the roots."""
    root_of = written(spark, rows.select("node", "root"))
    joined = (
        links.join(root_of.select(F.col("node").alias("u"), F.col("root").alias("a")), "u")
        .join(root_of.select(F.col("node").alias("v"), F.col("root").alias("b")), "v")
        .select(F.col("a").alias("u"), F.col("b").alias("v"))
    )
    merged = connected_components(spark, joined).select(F.col("node").alias("root"), F.col("root").alias("new_root"))
    return written(
        spark, root_of.join(merged, "root", "left").select("node", F.coalesce("new_root", "root").alias("root"))
    )


def _remaining_pairs(spark: SparkSession, open_: DataFrame, sets: DataFrame, possible) -> DataFrame:
    """u, v: nodes of different components that share a bucket and may reach the threshold, each pair once.

    They are met by first key: near copies share few of those, but a large part of all tables. Two nodes of
    different components both have all keys that they share, since such keys have several roots. So a pair is made at
    the smallest first key that both have, if they share a second one too. One node at least is outside the key's main
    component.
    """
    sketches = _long_sketches(sets.join(open_.select("node"), "node", "left_semi"))
    nodes = written(spark, open_.join(sketches, "node"))
    right = _by_first(nodes).select("*", F.explode("keys").alias("key")).drop("keys")
    outside = _outside(spark, _by_first(open_)).select(F.col("node").alias("u"), F.col("key").alias("key_u"), "main")
    left = outside.join(_of_nodes(nodes, "bits", "firsts", "seconds"), "u").withColumnsRenamed(
        {"bits": "bits_u", "firsts": "firsts_u", "seconds": "seconds_u"}
    )
    other = (F.col("root") == F.col("main")) | (F.col("u") < F.col("node"))
    differing = sum(
        (F.bit_count(F.get("bits", F.lit(i)).bitwiseXOR(F.get("bits_u", F.lit(i)))) for i in range(LONG_BITS // 64)),
        F.lit(0),
    )
    smallest = F.array_min(F.array_intersect("firsts", "firsts_u"))
    once = (differing <= LONG_DIFFERENCE) & (smallest == F.col("key")) & F.arrays_overlap("seconds", "seconds_u")
    met = left.join(right, (F.col("key_u") == F.col("key")) & other & possible & once)
    return written(spark, met.select(F.least("u", "node").alias("u"), F.greatest("u", "node").alias("v")))


def _by_first(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("keys", F.col("firsts"))


def _of_nodes(rows: DataFrame, *more: str) -> DataFrame:
    """The nodes of rows with what a pair's other side is compared by."""
    return rows.select(
        *more,
        F.col("node").alias("u"),
        F.col("n").alias("m"),
        F.col("sketch_a").alias("a"),
        F.col("sketch_b").alias("b"),
        F.col("root").alias("root_u"),
        F.col("shared").alias("shared_u"),
    )


def components(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """_row, doc_id, n_shingles, component_id, keep_row for every row."""
    return _components(spark, numbered(spark, docs.select("doc_id", "text"), "_llm_row"))


def _components(spark: SparkSession, docs: DataFrame) -> DataFrame:
    rows = written(spark, _signatures(docs))
    same_set = ["n_shingles", "set_a", "set_b"]
    classes = written(
        spark,
        rows.filter("n_shingles > 0")
        .groupBy(*same_set)
        .agg(F.min("doc_id").alias("class_id"), F.coalesce(F.min_by("_row", "doc_id"), F.min("_row")).alias("node")),
    )
    nodes = rows.withColumnRenamed("_row", "node").join(classes.select("node"), "node", "left_semi")
    keys = _shared_keys(spark, nodes)
    held = _held_keys(spark, nodes, keys)
    first = _links_to_smallest(spark, docs, _buckets(spark, held))
    roots = connected_components(spark, first)
    second = _links_between(spark, docs, held, roots)
    if not second.isEmpty():
        roots = connected_components(spark, first.union(second))
    rooted = written(
        spark, classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    )
    smallest = written(
        spark,
        rooted.groupBy("root").agg(
            F.min("class_id").alias("component_id"),
            F.coalesce(F.min_by("node", "class_id"), F.min("node")).alias("keep_row"),
        ),
    )
    found = written(spark, rooted.join(smallest, "root").select(*same_set, "component_id", "keep_row"))
    full = rows.filter("n_shingles > 0").select("_row", "doc_id", *same_set).join(found, same_set)
    empty = rows.filter("n_shingles = 0").withColumns(
        {"component_id": F.col("doc_id"), "keep_row": F.col("_row")}
    )
    columns = ["_row", "doc_id", "n_shingles", "component_id", "keep_row"]
    return full.select(*columns).unionByName(empty.select(*columns))


def near_copy_report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    return components(spark, docs).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def drop_near_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with one document of each component: that with the smallest doc_id."""
    rows = numbered(spark, docs, "_llm_row")
    found = _components(spark, rows)
    dropped = found.filter("_row != keep_row").select(F.col("_row").alias("_llm_row"))
    return rows.join(dropped, "_llm_row", "left_anti").select(*columns_of(docs))
