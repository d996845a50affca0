"""Near-duplicate groups by SuperMinHash, banding, exact verification and union-find.

A document's set is its distinct five-word shingles. Documents of equal sets form
a class, and one representative of each class goes on. Its SuperMinHash signature
has 128 slots in 32 bands of four: two sets at similarity 0.75 share a band with
probability 1 - 5e-6. Representatives that share a band are candidates; every link
is confirmed on full sets.

Not all pairs of a bucket are made. Each member is first compared with the
bucket's centre; links found join components. Of the pairs of a bucket that still
lie in different components, those are compared that can be similar enough by
what they share with the centre and beside it, so no link is lost. A bucket of more
than BLOCK members is dealt into blocks, and each pair of blocks is a group of its
own; a centre's set goes to a task once for each BLOCK members.

Defined results: a null or empty text has no shingles and links with nothing; a
null doc_id links with nothing, is kept and has a null component; rows that repeat a doc_id
are one node, which has the links of any of its texts, and are kept or dropped
together; an empty table gives no rows; a very long text is one set like any other;
other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm import common, graph

WIDTH = 5
PERCENT = 75
BANDS, ROWS = 32, 4
#: Elements in one signature step: a matrix row of BANDS*ROWS bytes for each.
CHUNK = 150_000
#: Members of a group that one task compares with as many others, or with their centre.
BLOCK = 2000


def superminhash(elements: np.ndarray, sizes: np.ndarray, slots: int) -> np.ndarray:
    """Signatures of many sets at once, a row each; ``elements`` holds the sets one after another.

    Element x draws a random permutation of the slots step by step; at step j it
    offers j + u for the slot its permutation has at j. Offers grow with j, so a
    set is done once all its slots hold less than the next step's least offer.
    """
    sets = np.repeat(np.arange(len(sizes)), sizes)
    best = np.full((len(sizes), slots), np.inf)
    flat = best.reshape(-1)
    for at in range(0, len(elements), CHUNK):
        x, of = elements[at : at + CHUNK], sets[at : at + CHUNK]
        order = np.broadcast_to(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(x), slots)).copy()
        active = np.arange(len(x))
        for j in range(slots):
            active = active[best.max(axis=1)[of[active]] > j]
            if not len(active):
                break
            draw = common.mixed(x[active] + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            k = j + (((draw & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j)) >> np.uint64(32)).astype(np.int64)
            slot = order[active, k].astype(np.int64)
            order[active, k] = order[active, j]
            np.minimum.at(flat, of[active] * slots + slot, j + (draw >> np.uint64(32)) * 2.0**-32)
    return best


def bands_of(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of each signature; the band's number is part of it."""
    bits = signatures.view(np.uint64).reshape(len(signatures), bands, rows)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(signatures), bands)).copy()
    for r in range(rows):
        keys = common.mixed(keys * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, r])
    return keys.view(np.int64)


def _sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    return [np.unique(common.shingle_hashes(common.hashed(common.words_of(t)), width)) for t in texts]


def features(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, a 128-bit key of the set, and its band keys (null without shingles)."""
    common.arrow_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            sets = _sets(batch.column(1).to_pylist(), width)
            sizes = np.array([len(s) for s in sets], np.int64)
            keys_a = np.array([int(common.mixed(s).sum(dtype=np.uint64)) if len(s) else 0 for s in sets], np.uint64)
            keys_b = np.array([int(np.bitwise_xor.reduce(common.mixed(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)))) if len(s) else 0 for s in sets], np.uint64)
            full = np.flatnonzero(sizes)
            bands: list = [None] * len(sets)
            if len(full):
                found = bands_of(superminhash(np.concatenate([sets[i] for i in full]), sizes[full], BANDS * ROWS))
                for i, row in zip(full, found, strict=True):
                    bands[i] = row
            arrays = [batch.column(0), pa.array(sizes), pa.array(keys_a.view(np.int64)), pa.array(keys_b.view(np.int64)), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "key_a", "key_b", "bands"])

    schema = "doc_id long, n_shingles long, key_a long, key_b long, bands array<long>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id and its distinct shingle hashes."""
    common.arrow_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            sets = [s.view(np.int64) for s in _sets(batch.column(1).to_pylist(), width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "shingles"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, shingles array<long>")


def measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with the sizes of their full sets, of what they share, and what of ``a`` is not in ``b``."""
    pairs = common.settle(pairs, "pairs")

    def side(of: str) -> DataFrame:
        ids = pairs.select(F.col(of).alias("doc_id")).distinct()
        few = common.maybe_broadcast(ids, ids.count())
        return sets.join(few, "doc_id", "left_semi").select(F.col("doc_id").alias(of), F.col("shingles").alias(f"of_{of}"))

    # a pair carries its member's set to the centre's, which comes once for each BLOCK members
    copies = pairs.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("copies"))
    own = pairs.join(copies, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("copies")).cast("int").alias("copy")).join(side("a"), "a")
    centre = side("b").join(copies, "b").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    both = own.join(centre, ["b", "copy"])
    return both.select("a", "b", F.size("of_a").alias("n_a"), F.size("of_b").alias("n_b"), F.size(F.array_intersect("of_a", "of_b")).alias("shared"), F.array_except("of_a", "of_b").alias("own"))


def linked(pairs: DataFrame, percent: int) -> DataFrame:
    """The measured pairs whose sets are similar enough."""
    return pairs.filter(100 * F.col("shared") >= percent * (F.col("n_a") + F.col("n_b") - F.col("shared"))).select("a", "b").distinct()


def group(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``."""
    found = common.settle(features(docs, width), "features")
    key = ["n_shingles", "key_a", "key_b"]
    full = found.filter("n_shingles > 0 and doc_id is not null")
    classes = common.settle(full.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "classes")
    member = common.settle(full.select("doc_id", *key).join(classes.drop("bands"), key).select("doc_id", *key, "rep"), "members")
    # a doc_id that repeats with other texts links their classes
    again = member.groupBy("doc_id").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).filter("least <> most")
    own = member.join(again, "doc_id").select(F.col("rep").alias("a"), F.col("least").alias("b")).distinct()

    buckets = common.settle(classes.select("rep", F.explode("bands").alias("key")).distinct(), "bands")
    sizes = buckets.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    shared = common.settle(_with_facts(buckets, sizes), "buckets")  # members of buckets of two or more
    # a bucket's centre is the member whose buckets are largest: what the others were made from, if they are edited copies
    weight = shared.groupBy("rep").agg(F.sum("size").alias("weight"))
    weighed = shared.join(weight, "rep")
    centres = weighed.groupBy("key").agg(F.max(F.struct(F.col("weight"), (-F.col("rep")).alias("minus"))).alias("c"), F.max("size").alias("size")).select("key", (-F.col("c.minus")).alias("b"), "size")
    shared = common.settle(_with_facts(shared.drop("size"), centres).drop("size"), "centred")
    ids = common.settle(shared.select(F.col("rep").alias("doc_id")).distinct(), "ids")
    few = common.maybe_broadcast(ids, ids.count())
    sets = common.settle(shingle_sets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(few, "doc_id", "left_semi"), width), "sets")

    # first each member with the centres of its buckets
    near = common.settle(measured(shared.filter("rep <> b").select(F.col("rep").alias("a"), "b").distinct(), sets), "near")
    links = common.settle(linked(near, percent).unionByName(own), "links")
    labels = graph.components(links)

    # then the buckets that still hold several components, c being the centre: what two members share is
    # at most the smaller of what each shares with c, and what both have beside c
    named = shared.join(labels, F.col("rep") == F.col("node"), "left").select("key", "rep", "b", F.coalesce("label", "rep").alias("label"))
    open_keys = named.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("size")).filter("least <> most").select("key", "size")
    still = common.settle(_with_facts(named, open_keys).drop("size").filter("rep <> b"), "open")
    to_centre = near.groupBy(F.col("a").alias("rep"), "b").agg(F.max("n_a").alias("n"), F.max("shared").alias("shared"))
    held = still.join(to_centre, ["rep", "b"]).select("key", "rep", "label", "n", "shared", F.col("shared").alias("room"))
    enough = F.expr(f"{100 + percent} * least(shared_a, shared_b) >= {percent} * (n_a + n_b)")
    pairs = _across(held, ["key"], percent, enough).select("a", "b").distinct()
    beside = still.select("rep", "b", "label").distinct().join(near.withColumnRenamed("a", "rep"), ["rep", "b"])
    beside = common.settle(beside.select("rep", "b", "label", F.col("n_a").alias("n"), "shared", F.explode("own").alias("s")), "beside")
    times = beside.groupBy("b", "s").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("times")).filter("least <> most").select("b", "s", "times")
    # of what a member has beside c, its partner must have `need` at least: then both have one of the rarest others
    member_of = beside.join(times, ["b", "s"]).groupBy("rep", "b", "label", "n", "shared").agg(F.array_sort(F.collect_list(F.struct("times", "s"))).alias("beside"))
    member_of = member_of.withColumn("room", F.col("shared") + F.size("beside")).withColumn("need", F.greatest(F.lit(1), F.ceil(F.col("n") * percent / 100) - F.col("shared")))
    rarest = member_of.filter("size(beside) >= need").withColumn("s", F.explode(F.expr("slice(beside, 1, cast(size(beside) - need + 1 as int))"))).withColumn("s", F.col("s.s"))
    reach = F.expr(f"{100 + percent} * (least(shared_a, shared_b) + least(room_a - shared_a, room_b - shared_b)) >= {percent} * (n_a + n_b)")
    both = _across(rarest, ["b", "s"], percent, reach).select("a", "b").distinct()
    links = common.settle(links.unionByName(linked(measured(pairs.unionByName(both).distinct(), sets), percent)), "links")
    labels = graph.components(links)

    named = member.select(*key, "rep").distinct().join(labels, F.col("rep") == F.col("node"), "left").select(*key, F.coalesce("label", "rep").alias("label"))
    whole = found.filter("n_shingles > 0 and doc_id is not null").select("doc_id", *key).join(named, key).select("doc_id", "n_shingles", F.col("label").alias("component_id"))
    alone = found.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return whole.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _with_facts(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """``rows`` with what ``facts`` (key, size, ...) say of their keys; rows of other keys go.

    Keys of more than BLOCK rows are few (one for each BLOCK rows at most): they go to the rows, which are not dealt by them.
    """
    facts = common.settle(facts, "facts")
    large = facts.filter(F.col("size") > BLOCK)
    n = large.count()
    if not n:
        return rows.join(facts, "key")
    rest = rows.join(common.maybe_broadcast(large.select("key"), n), "key", "left_anti")
    return rest.join(facts.filter(F.col("size") <= BLOCK), "key").unionByName(rows.join(common.maybe_broadcast(large, n), "key"))


def _across(rows: DataFrame, on: list[str], percent: int, also, block: int = BLOCK) -> DataFrame:
    """Pairs of ``rows`` (rep, label, n, shared, room) equal in ``on``, of different components and of similar sizes.

    Groups of more than ``block`` rows are dealt into blocks, and compared a pair of blocks at a time.
    """
    columns = ["rep", "label", "n", "shared", "room"]
    large = common.settle(rows.groupBy(*on).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).filter("blocks > 1"), "large")
    # one row for each ``block`` rows at most; broadcast where few, so that a large group is dealt before it is shuffled
    rows = rows.select(*on, *columns).join(common.maybe_broadcast(large, large.count()), on, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    on = [*on, "low", "high"]
    columns = [*columns, "own", "other"]
    a = rows.select(*[F.col(c).alias(f"on_{c}") for c in on], *[F.col(c).alias("a" if c == "rep" else f"{c}_a") for c in columns])
    b = rows.select(*[F.col(c).alias(f"of_{c}") for c in on], *[F.col(c).alias("b" if c == "rep" else f"{c}_b") for c in columns])
    same = F.expr(f"label_a > label_b and 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) and own_a = other_b")
    for c in on:
        same = same & (F.col(f"on_{c}") == F.col(f"of_{c}"))
    return a.join(b, same & also).select("a", "b")


def deduplicated(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that are kept: one document of each group, with all columns."""
    groups = group(docs, width, percent)
    name = common.free_name(docs, "__gone")
    gone = groups.filter("not kept").select(F.col("doc_id").alias(name)).distinct()
    gone = common.settle(gone, "gone")
    return docs.join(common.maybe_broadcast(gone, gone.count()), docs["doc_id"].cast("long") == F.col(name), "left_anti")


def op2_superminhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(common.table(spark, sf_dir, "documents"))
