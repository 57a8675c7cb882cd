"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

Rotations learned on a bounded sample turn a vector into balanced bits: the sample's
principal axes are rotated until the signs of the coordinates are as close to the
coordinates as they get. The code is cut into substrings, one for each table. Two vectors
are candidates if some table's substrings differ in at most one bit; the whole codes must
then be close, and the cosine of the original vectors decides.

Substrings have about as many bits as the number of vectors has, so a table's bucket holds
few unrelated vectors at any size; the number of tables, and with it of rotations, follows
from that width and the chance that a pair at the threshold is missed. Centring moves the
vectors of a pair apart by an angle that is bounded by how far they are from the mean, so
tables and distances follow from those lengths; where vectors have so much in common that
this takes too many tables, they are coded as they are.
"""

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.components import connected
from tokenmill.sources import scratch

#: least cosine of a link
COSINE = 0.98

#: vectors that the rotations are learned from at most, and the steps of learning
SAMPLE, STEPS = 20_000, 30

#: chance of missing a pair at the threshold, if its bits differ independently
MISS = 1e-4

#: tables at most for centred vectors
CENTRED = 64

#: deviations above the expected distance at which codes are too far apart
SLACK = 6.0


def _differ(cosine: float, lengths: np.ndarray) -> np.ndarray:
    """Share of differing bits of two unit vectors at the threshold, if less their mean
    neither is shorter than ``lengths``: the angle is widest where both are as short."""
    return 2 * np.arcsin(np.minimum(1, math.sqrt(max(0, 1 - cosine) / 2) / np.maximum(lengths, 1e-9))) / math.pi


@dataclass(frozen=True)
class Plan:
    """Bits of a substring, tables, and the largest distance of whole codes of vectors that
    are not centred."""

    width: int
    tables: int
    reach: int

    @classmethod
    def of(cls, vectors: int, cosine: float = COSINE, miss: float = MISS, lengths: np.ndarray | None = None) -> "Plan":
        """``lengths`` are those of a sample of the vectors less their mean, if that is taken off."""
        differ = _differ(cosine, np.ones(1) if lengths is None else lengths)
        width = min(40, max(8, math.ceil(math.log2(max(vectors, 1) + 1))))
        meet = (1 - differ) ** width + width * differ * (1 - differ) ** (width - 1)
        tables = math.ceil(math.log(miss) / math.log(1 - meet.max()))
        while tables <= CENTRED and len(meet) > 1 and ((1 - meet) ** tables).mean() > miss:
            tables += 1
        plan = cls(width, tables, 0)
        return cls(width, tables, int(plan.reaches(np.ones(1), cosine)[0]))

    def reaches(self, lengths: np.ndarray, cosine: float) -> np.ndarray:
        """The largest distance from codes of vectors less their mean that are no shorter."""
        bits, differ = self.width * self.tables, _differ(cosine, lengths)
        return np.ceil(bits * differ + SLACK * np.sqrt(bits * differ * (1 - differ))).astype(np.int32)


def learned(sample: np.ndarray, mean: np.ndarray, bits: int, steps: int = STEPS) -> np.ndarray:
    """Projections: the sign of each projection of a unit vector less ``mean`` is a bit.
    One rotation gives as many bits as the vectors have dimensions; further ones start
    from other random rotations."""
    rng = np.random.default_rng(7)
    size = sample.shape[1]
    axes = np.linalg.eigh((sample - mean).T @ (sample - mean))[1][:, ::-1] if 1 < len(sample) else np.eye(size)
    turned, found = (sample - mean) @ axes, []
    for _ in range(-(-bits // size)):
        rotation = np.linalg.qr(rng.standard_normal((size, size)))[0]
        for _ in range(steps if len(sample) > size else 0):
            u, _, v = np.linalg.svd(turned.T @ np.sign(turned @ rotation))
            rotation = u @ v
        found.append(axes @ rotation)
    return np.concatenate(found, axis=1)[:, :bits]


def _codes(mean: np.ndarray, projections: np.ndarray, plan: Plan, cosine: float):
    weights, bits = 1 << np.arange(plan.width, dtype=np.int64), plan.width * plan.tables

    def run(batches):
        models = {len(mean): (mean, projections)}
        for batch in batches:
            parts, reach = np.zeros((batch.num_rows, plan.tables), np.int64), np.zeros(batch.num_rows, np.int32)
            lists = batch.column("embedding")
            sizes = lists.value_lengths().to_numpy()
            values, ends = lists.flatten().to_numpy(), np.cumsum(sizes)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                vectors = values[(ends[rows] - size)[:, None] + np.arange(size)]
                unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
                if size not in models:  # vectors of another length have random rotations
                    models[size] = np.zeros(size), learned(np.zeros((0, size)), np.zeros(size), bits)
                middle, turned = models[size]
                centred = unit - middle
                reach[rows] = plan.reaches(np.linalg.norm(centred, axis=1) if middle.any() else np.ones(len(rows)), cosine)
                parts[rows] = (centred @ turned > 0).reshape(len(rows), plan.tables, plan.width) @ weights
            code = pa.ListArray.from_arrays(
                pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * plan.tables), pa.array(parts.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("class"), batch.column("label"), batch.column("size"), pa.array(reach), code],
                ["class", "label", "size", "reach", "code"])
    return run


def _close(cosine: float):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sides = [batch.column(c) for c in ("vector_a", "vector_b")]
            sizes = sides[0].value_lengths().to_numpy()
            ends, values = np.cumsum(sizes), [s.flatten().to_numpy() for s in sides]
            starts = ends - sizes
            dot, first, second = (np.add.reduceat(x * y, starts) for x, y in (
                (values[0], values[1]), (values[0], values[0]), (values[1], values[1])))
            linked = dot / (np.sqrt(first) * np.sqrt(second)) >= cosine
            yield batch.filter(pa.array(linked)).select(["a", "b"])
    return run


def _met(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join that shuffles both sides. Spark guesses a table's size from its compressed files,
    with one element for each array and one row for each that is exploded, so it would collect
    tables on the driver that are many times what a broadcast may be."""
    return left.join(right.hint("merge"), on, how)


def candidates(coded: DataFrame, plan: Plan) -> DataFrame:
    """Pairs (a, b) of classes, each once, whose substrings in some table differ in at most
    one bit and whose codes are within reach of either: b looks into the buckets next to its own."""
    stored = coded.select(F.col("class").alias("a"), "label", "size", F.col("reach").alias("reach_a"), F.col("code").alias("code_a"),
                          F.posexplode("code").alias("table", "key"))
    steps = F.array(*(F.lit(x).cast("long") for x in [0, *(1 << i for i in range(plan.width))]))
    asking = (coded.select(F.col("class").alias("b"), "label", "size", F.col("reach").alias("reach_b"), F.col("code").alias("code_b"),
                           F.posexplode("code").alias("table", "own"))
              .withColumn("step", F.explode(steps))
              .select("b", "label", "size", "reach_b", "code_b", "table", F.col("own").bitwiseXOR(F.col("step")).alias("key")))
    distance = [F.bit_count(F.col("code_a")[i].bitwiseXOR(F.col("code_b")[i])) for i in range(plan.tables)]
    # a pair that an earlier table has found is not found again
    first = reduce(lambda so_far, i: F.when(distance[i] <= 1, F.lit(i)).otherwise(so_far),
                   reversed(range(plan.tables)), F.lit(-1))
    return (_met(stored, asking, ["label", "size", "table", "key"])
            .where((F.col("a") < F.col("b")) & (F.col("table") == first)
                   & (sum(distance[1:], distance[0]) <= F.greatest("reach_a", "reach_b")))
            .select("a", "b"))


def links(classes: DataFrame, cosine: float = COSINE, sample: int = SAMPLE, miss: float = MISS) -> DataFrame:
    """Pairs (a, b) of classes with equal label and size whose cosine reaches the threshold."""
    n = classes.groupBy("label", "size").count().agg(F.max("count")).first()[0]
    if not n:
        return classes.select(F.col("class").alias("a"), F.col("class").alias("b"))
    drawn = (classes.orderBy(F.xxhash64("class"), "class").limit(sample).select("embedding").toArrow()
             .column("embedding").combine_chunks())
    sizes, ends = drawn.value_lengths().to_numpy(), drawn.offsets.to_numpy()[1:]
    size = max(set(sizes.tolist()), key=lambda s: ((sizes == s).sum(), s))
    vectors = drawn.values.to_numpy()[(ends[sizes == size] - size)[:, None] + np.arange(size)]
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    mean = unit.mean(axis=0)
    plan = Plan.of(n, cosine, miss, np.linalg.norm(unit - mean, axis=1))
    if plan.tables > CENTRED:
        mean, plan = np.zeros(size), Plan.of(n, cosine, miss)
    projections = learned(unit, mean, plan.width * plan.tables)
    coded = scratch.table(classes.select("class", "label", "size", "embedding").mapInArrow(
        _codes(mean, projections, plan, cosine), "class long, label long, size int, reach int, code array<long>"), "codes")
    first = classes.select(F.col("class").alias("a"), F.col("embedding").alias("vector_a"))
    second = classes.select(F.col("class").alias("b"), F.col("embedding").alias("vector_b"))
    pairs = _met(_met(candidates(coded, plan), first, "a"), second, "b")
    return pairs.select("a", "b", "vector_a", "vector_b").mapInArrow(_close(cosine), "a long, b long")


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, **options) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``embeddings``.

    Rows of one label are linked if their cosine, in double precision, is at least
    ``cosine``; n_links counts the other rows a row is linked with directly. A row without
    links is its own component. NULL labels, NULL or empty or zero vectors, and vectors with
    NULL or non-finite components have no links, nor have vectors of different lengths with
    each other. Equal vectors of a label are one class, compared once, and count as links of
    each other. component_id is the smallest vec_id in reach; rows whose vec_id is NULL have
    links but cannot be it, and are kept if nothing in reach has a vec_id.
    """
    vector = F.transform("embedding", lambda x: x.cast("double"))
    fit = F.aggregate(vector, F.lit(0.0), lambda total, x: total + x * x)  # NULL if any component is
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), vector.alias("embedding"))
    usable = (F.col("label").isNotNull() & (F.size("embedding") > 0)
              & F.coalesce((fit > 0) & ~F.isnan(fit) & (fit < float("inf")), F.lit(False)))
    known = rows.where(usable)
    classes = scratch.table(
        known.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
        .withColumn("size", F.size("embedding")).withColumn("class", F.monotonically_increasing_id()), "classes")
    found = scratch.table(links(classes, cosine, **options), "links")
    copies = classes.select(F.col("class").alias("b"), "copies")
    both = found.union(found.select("b", "a"))
    degree = _met(both, copies, "b").groupBy(F.col("a").alias("class")).agg(F.sum("copies").alias("others"))
    members = (_met(classes, connected(found).withColumnRenamed("node", "class"), "class", "left")
               .select("class", "least", F.coalesce("component", "class").alias("component")))
    least = members.groupBy("component").agg(F.min("least").alias("component_id"))
    named = _met(classes.select("class", "label", "embedding", "copies"),
                 _met(members, least, "component").select("class", "component_id"), "class")
    judged = (_met(named, degree, "class", "left")
              .select("label", "embedding", "component_id",
                      (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")))
    linked = _met(known, judged, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                       F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
