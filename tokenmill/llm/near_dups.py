"""Near-duplicate documents by HyperMinHash sketches of word shingles.

A document is the set of its distinct word shingles. Its sketch keeps, for each of
``REGISTERS`` hash buckets, the smallest hash as a leading-zero count and the
mantissa bits after the first one bit, so a register takes 16 bits. Registers are
compressed further into band keys; documents that agree on a band are candidates,
the Jaccard estimate from their registers, corrected for chance collisions, drops
the hopeless ones, and the full shingle sets decide.

Equal sets are one class and are compared once. In a band's bucket all classes are
first compared with the smallest class; whatever that connects is settled. Only
buckets that still hold several components are compared further, in blocks of
bounded size, only across components, and inside the task, which returns no more
than the links that join components. So a large group of near copies makes about
one row for each member and band, and no link that decides a component is left out.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm import words as wd
from tokenmill.llm.components import connected
from tokenmill.sources import scratch

#: words of a shingle, and the least similarity in per cent
SHINGLE, PERCENT = 5, 85

#: sketch registers (a power of two), mantissa bits of a register, registers of a band.
#: A pair at 0.85 shares no band with probability (1 - 0.85^4)^32, about 5e-11.
REGISTERS, MANTISSA, ROWS = 128, 10, 4

#: classes of one bucket, and shingles of these, that a task compares at a time
BLOCK, BLOCK_SHINGLES = 512, 1 << 18

#: deviations below the threshold at which an estimate drops a pair
SLACK = 5.0

_BUCKET_BITS = REGISTERS.bit_length() - 1


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes. A text of fewer words than a
    shingle is one shingle, a text without words has none."""
    offsets, numbers, distinct = wd.split(texts)
    codes = wd.hashes(distinct)[numbers] if len(numbers) else np.zeros(0, np.uint64)
    n = len(codes) - size + 1
    rolled = wd.chained([codes[i:i + n] for i in range(size)]) if n > 0 else codes[:0]
    for start, stop in zip(offsets[:-1], offsets[1:], strict=True):
        if stop - start >= size:
            yield np.unique(rolled[start:stop - size + 1])
        elif stop > start:
            yield wd.chained([codes[i:i + 1] for i in range(start, stop)])
        else:
            yield codes[:0]


def _fill_order() -> np.ndarray:
    """For each register, the order in which it looks for a filled one when empty."""
    rng = np.random.default_rng(20240229)
    return np.stack([rng.permutation(REGISTERS) for _ in range(REGISTERS)])


def sketch(hashes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Registers (uint16) of a sorted, non-empty set of hashes. The top bits choose
    the bucket, so the smallest hash of a bucket is the first one in it. An empty
    bucket takes the register of the first filled one in its own fixed order, which
    keeps the chance of agreement at the similarity for small sets too."""
    edges = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(64 - _BUCKET_BITS)
    first = np.searchsorted(hashes, edges)
    last = np.append(first[1:], len(hashes))
    filled = last > first
    least = hashes[np.minimum(first, len(hashes) - 1)] << np.uint64(_BUCKET_BITS)
    exponent = np.frexp(least.astype(np.float64))[1]  # exact to the first one bit for all but rounding ups
    exponent = np.where((exponent > 0) & ((least >> np.maximum(exponent - 1, 0).astype(np.uint64)) == 0),
                        exponent - 1, exponent)
    zeros = np.minimum(64 - exponent, 63)
    body = np.where(zeros < 63, least << np.minimum(zeros + 1, 63).astype(np.uint64), np.uint64(0))
    registers = ((zeros.astype(np.uint64) << np.uint64(MANTISSA)) | (body >> np.uint64(64 - MANTISSA)))
    registers = registers.astype(np.uint16)
    if not filled.all():
        source = order[np.arange(REGISTERS), filled[order].argmax(axis=1)]
        registers = np.where(filled, registers, registers[source])
    return registers


def chance_collision() -> float:
    """The probability that two independent registers agree: the same count of zeros,
    then the same mantissa."""
    return sum(4.0 ** -(z + 1) for z in range(63)) * 2.0 ** -MANTISSA


def _sketches(batches):
    order = _fill_order()
    for batch in wd.slices(batches):
        sizes, digests, sketches = [], [], []
        for hashes in shingle_sets(batch.column("text")):
            sizes.append(len(hashes))
            digests.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None)
            sketches.append(sketch(hashes, order).tobytes() if len(hashes) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
             pa.array(sketches, pa.binary())], ["doc_id", "n_shingles", "digest", "sketch"])


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, digest of the whole set, sketch) for each document."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _sketches, "doc_id long, n_shingles long, digest binary, sketch binary")


def _bands(batches):
    places = REGISTERS // ROWS
    for batch in batches:
        if not batch.num_rows:
            continue
        registers = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16)
        registers = registers.reshape(-1, places, ROWS).astype(np.uint64)
        keys = wd.chained([np.tile(np.arange(places, dtype=np.uint64), batch.num_rows),
                           *(registers[:, :, i].ravel() for i in range(ROWS))]).view(np.int64)
        offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * places)
        yield pa.RecordBatch.from_arrays(
            [batch.column("rep"), batch.column("n_shingles"), pa.ListArray.from_arrays(offsets, pa.array(keys))],
            ["rep", "n_shingles", "keys"])


def _full_sets(batches):
    for batch in wd.slices(batches):
        sets = [hashes.view(np.int64) for hashes in shingle_sets(batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], ["rep", "hashes"])


def _least_estimate(smaller: np.ndarray, percent: int) -> np.ndarray:
    """Estimates below this rule a pair out, from the size of its smaller set."""
    share = percent / 100
    return share - SLACK * np.sqrt(share * (1 - share) / np.clip(smaller, 1, REGISTERS))


def _hopeful(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs of sketches may reach the similarity: first by the set sizes,
    which is certain, then by the corrected estimate."""
    smaller, larger = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    possible = 100 * smaller >= percent * larger
    chance = chance_collision()
    estimate = ((a == b).mean(axis=-1) - chance) / (1 - chance)
    return possible & (estimate >= _least_estimate(smaller, percent))


def _estimated(percent: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS)
                    for c in ("sketch_a", "sketch_b"))
            n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            yield batch.filter(pa.array(_hopeful(a, b, n_a, n_b, percent))).select(["a", "b"])
    return run


def _by_block_pair(handle):
    """``handle`` on the rows of each block pair; the rows come sorted by bucket and block pair,
    which holds about twice ``BLOCK`` classes or ``BLOCK_SHINGLES`` shingles."""
    def run(batches):
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("key", "block_a", "block_b")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            edges = [0, *cuts.tolist(), batch.num_rows]
            for start, stop in zip(edges[:-1], edges[1:], strict=True):
                piece, mark = batch.slice(start, stop - start), tuple(keys[:, start])
                if held and held[0] != mark:
                    yield from handle(pa.Table.from_batches(held[1]))
                    held = []
                held = [mark, [*(held[1] if held else []), piece]]
        if held:
            yield from handle(pa.Table.from_batches(held[1]))
    return run


def _block_pair(rows: pa.Table):
    """(components, sketches, sizes, places of one block, of the other) of a block pair's rows."""
    sizes, sides = (rows.column(c).to_numpy() for c in ("n_shingles", "side"))
    groups = np.unique(rows.column("comp").to_numpy(), return_inverse=True)[1]
    first, second = rows.column("block_a")[0].as_py(), rows.column("block_b")[0].as_py()
    registers = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint16).reshape(-1, REGISTERS)
    left = np.flatnonzero(sides == first)
    return groups, registers, sizes, left, left if first == second else np.flatnonzero(sides == second)


def _across(i: int, left, right, groups, registers, sizes, percent: int) -> np.ndarray:
    """The places of a block pair that a class, of another component, may be linked with."""
    j = right[right > i] if left is right else right
    j = j[groups[j] != groups[i]]
    return j[_hopeful(registers[j], registers[i], sizes[j], sizes[i], percent)] if len(j) else j


def _with_hope(percent: int):
    """The rows of a block pair that some other of them, of another component, may be linked
    with by their sketches: only these need their sets."""
    def hoping(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        groups, registers, sizes, left, right = _block_pair(rows)
        wanted = np.zeros(rows.num_rows, bool)
        for i in left:
            j = _across(i, left, right, groups, registers, sizes, percent)
            wanted[j] = True
            wanted[i] |= len(j) > 0
        yield from rows.filter(pa.array(wanted)).to_batches()
    return _by_block_pair(hoping)


def _bucket_links(percent: int):
    """Links across components inside each block pair of a bucket, no more than join what its
    earlier links have left apart."""
    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        groups, registers, sizes, left, right = _block_pair(rows)
        reps = rows.column("rep").to_numpy()
        sets = rows.column("hashes").combine_chunks()
        bounds = sets.offsets.to_numpy().astype(np.int64)
        distinct, codes = np.unique(sets.flatten().to_numpy(), return_inverse=True)
        bounds = bounds - bounds[0]
        marked, found = np.zeros(len(distinct), bool), []
        for i in left:
            j = _across(i, left, right, groups, registers, sizes, percent)
            if not len(j):
                continue
            own = codes[bounds[i]:bounds[i + 1]]
            marked[own] = True
            shared = np.array([np.count_nonzero(marked[codes[bounds[x]:bounds[x + 1]]]) for x in j])
            marked[own] = False
            for x in j[100 * shared >= percent * (sizes[i] + sizes[j] - shared)]:
                if groups[x] != groups[i]:
                    groups[groups == groups[x]] = groups[i]
                    found.append((reps[i], reps[x]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(side) for side in zip(*found, strict=True)], ["a", "b"])
    return _by_block_pair(pairs)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity."""
    both = (pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
            .withColumn("shared", F.size(F.array_intersect("set_a", "set_b")).cast("long")))
    return both.where(100 * F.col("shared") >= percent * (F.size("set_a") + F.size("set_b") - F.col("shared"))) \
        .select("a", "b")


def links(classes: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Verified pairs (a, b) of class representatives that connect every two classes
    which candidate pairs connect.

    ``classes`` has rep, n_shingles and sketch; ``docs`` has the texts.
    """
    if classes.isEmpty():
        return classes.select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    sizes = classes.select("rep", "n_shingles", "sketch")
    banded = sizes.mapInArrow(_bands, "rep long, n_shingles long, keys array<long>")
    members = banded.select("rep", "n_shingles", F.explode("keys").alias("key"))
    # buckets with company only, which are few, and one of those with the same members
    buckets = (members.groupBy("key").agg(
        F.min("rep").alias("leader"), F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles"),
        F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("mark")).where("n > 1")
        .groupBy("leader", "n", "shingles", "mark").agg(F.min("key").alias("key")))
    members, members_path = scratch.placed(members.drop("n_shingles").join(buckets.drop("mark"), "key"), "members")
    scratch.release(classes.sparkSession)

    # candidates grow with the corpus, so their ids are never broadcast
    wanted = members.select(F.col("rep").alias("doc_id")).distinct().hint("merge")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(wanted, "doc_id", "left_semi")
    sets, sets_path = scratch.placed(texts.mapInArrow(_full_sets, "rep long, hashes array<long>"), "sets")

    stars = members.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    tried = stars.join(sizes.toDF("a", "n_a", "sketch_a"), "a").join(sizes.toDF("b", "n_b", "sketch_b"), "b") \
        .mapInArrow(_estimated(percent), "a long, b long")
    scratch.release(classes.sparkSession)
    found = scratch.table(_verified(tried, sets, percent), "links")
    scratch.release(classes.sparkSession)
    settled = connected(found)

    placed = (members.where("n > 2").join(settled, members["rep"] == settled["node"], "left")
              .withColumn("comp", F.coalesce("component", "rep")).drop("node", "component"))
    mixed = (placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
             .where("low <> high").select("key"))
    pair = ["key", "block_a", "block_b"]
    late = (placed.join(mixed, "key", "left_semi").join(sizes, "rep")
            .withColumn("blocks", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)))
            .withColumn("side", F.pmod(F.xxhash64("rep"), "blocks"))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
            .select("key", F.least("side", "other").alias("block_a"), F.greatest("side", "other").alias("block_b"),
                    "side", "rep", "comp", "n_shingles", "sketch"))
    late = late.repartition(*pair).sortWithinPartitions(*pair)
    # sets are many times a sketch, so they are fetched for what the sketches leave
    hoping, hoping_path = scratch.placed(late.mapInArrow(_with_hope(percent), late.schema), "hoping")
    scratch.release(classes.sparkSession)
    late = (hoping.join(sets, "rep").select(*late.columns, "hashes").repartition(*pair).sortWithinPartitions(*pair)
            .mapInArrow(_bucket_links(percent), "a long, b long"))
    late = scratch.table(late.distinct(), "late")
    for path in (members_path, sets_path, hoping_path):
        scratch.remove(classes.sparkSession, path)
    return found.union(late)


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row (doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    Two documents are linked if 100 * shared shingles >= percent * all shingles of
    both; component_id is the smallest doc_id reachable by links, kept says that it
    is the document's own. Texts that are NULL or have no words have 0 shingles and
    are linked with nothing. Rows of one doc_id are one document to the links. A row
    whose doc_id is NULL takes no part: its component_id is NULL and it is kept.
    Other columns of ``docs``, whatever their names, are not looked at.
    """
    docs = docs.select("doc_id", "text")
    rows, rows_path = scratch.placed(sketched(docs), "sketches")
    known = rows.where("digest is not null and doc_id is not null")
    classes = scratch.table(
        known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"),
                                    F.first("sketch").alias("sketch")), "classes")
    # a document without words shares its doc_id with no class; one with several rows may have several classes
    member = scratch.table(rows.select("doc_id", "n_shingles", "digest").join(
        classes.select("digest", "rep"), "digest", "left"), "judged")
    scratch.remove(docs.sparkSession, rows_path)  # classes have the sketches
    known = member.where("digest is not null and doc_id is not null")
    several = known.groupBy("doc_id").agg(F.count_distinct("digest").alias("n")).where("n > 1").select("doc_id")
    edges = links(classes, docs, percent)
    if not several.isEmpty():
        edges = edges.union(member.join(several, "doc_id").where("rep is not null").select("doc_id", "rep"))
    components = connected(edges)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return (member.join(components, F.col("rep") == F.col("node"), "left")
            .select("doc_id", "n_shingles", component.alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def deduplicated(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, all columns kept."""
    spark, path = docs.sparkSession, scratch.folder(docs.sparkSession, "judged")
    with scratch.passing(spark):
        near_duplicates(docs, percent).select("doc_id", "kept").write.parquet(path)
    judged = spark.read.parquet(path)
    keep = judged.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    repeated = keep.where("rows > 1").select("doc_id")
    once = docs.join(keep.where("rows = 1").select("doc_id"), "doc_id", "left_semi")
    rest = docs.where("doc_id is null")
    if not repeated.isEmpty():
        rest = rest.union(docs.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return once.union(rest).select(docs.columns)
