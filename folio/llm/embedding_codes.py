"""Near-duplicate embeddings by randomised-rotation binary codes with stored correction factors.

A unit vector x is turned by a stack of random rotations; the signs of its coordinates are its code, x' the unit vector
with those signs, and <x', x> its stored correction factor.  For another vector y, <x', y> / <x', x> is an unbiased
estimate of <x, y>, as what x' has besides x lies in a direction that the rotations make random.  For a pair of cosine
``least`` or more it misses by sqrt(1 - least^2) * sqrt(1 / <x', x>^2 - 1) / sqrt(m (d - 1)) times a factor that exceeds
``SURE`` with a probability below 2 exp(-SURE^2 / 2), for m rotations of d dimensions.  y itself is kept as bytes with
randomised rounding, whose whole error is added to the bound.  Pairs whose upper bound is below ``least`` are done with;
all others are recomputed in double precision from the vectors, and only those results make links.

Which pairs are estimated: bits of the code, in bands, are keys of buckets, and vectors that share one meet.  A bit
differs with probability angle / pi, so the number of bands follows from the bits of a band, the least cosine and the
share of links at exactly that cosine that may be missed (``MISSED``).  Bits grow with the logarithm of the number of
vectors, so that a bucket of unrelated vectors keeps its size; the work grows like n^1.23.

Equal vectors are one vector with a count.  Very close ones form balls: a vector within half the angle of a link of its
ball's leader is linked with all others that are, so such pairs are counted and never compared.  Balls grow in rounds,
each over one long band: a vector turns to the most popular leader in its bucket, if exact recomputation shows it within
reach.  Buckets over ``BLOCK`` rows are dealt into blocks by ball and hash, and pairs of blocks of one ball are left out
before rows are copied for them, so a hot group costs its size times what else is in its bucket.  Pairs that share
several bands are told by each and meet in one distinct; the vectors of pairs stay where they are until a pair asks.

Defined results: vectors that are null, empty or zero, or hold null or non-finite components, link with nothing, and so
do vectors of different lengths; rows with equal ids are rows of their own, and links of one to another count; a null id
has the least id of its component like any row, null if there is none, and is kept only if it has none; of an id that
stands in several rows, each row equal to its component is kept; an empty table gives an empty one; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import near_dedup, scratch

LEAST = 0.9
#: Code bits; at least so many, in whole rotations.
CODE_BITS = 128
#: Deviations that an estimate may lie below the least cosine before a pair is turned down.
SURE = 5.0
#: Share of the links at exactly the least cosine that may share no band.
MISSED = 1e-5
#: Unrelated vectors in a bucket, about.
OCCUPANCY = 400
#: Bits of a band for balls, and rounds of them.
BALL_BITS = 32
BALL_ROUNDS = 3
#: Rows that a block of a bucket holds, about.
BLOCK = 1024
#: Cells of a matrix of estimates that are held at a time.
CELLS = 1 << 22
SEED = 20_231
CODED = "vec long, dim int, unit array<double>, code binary, factor double, bytes binary, scale double, bands array<long>, ball_bands array<long>"
_rotations: dict[tuple[int, int], np.ndarray] = {}


def rotations(dim: int, count: int) -> np.ndarray:
    """``count`` random rotations of ``dim`` dimensions, one below the other; the same in every worker."""
    if (dim, count) not in _rotations:
        out = []
        for k in range(count):
            q, r = np.linalg.qr(np.random.default_rng([SEED, dim, k]).standard_normal((dim, dim)))
            out.append(q * np.sign(np.diag(r)))
        _rotations[dim, count] = np.concatenate(out)
    return _rotations[dim, count]


def code_rotations(dim: int) -> int:
    return -(-CODE_BITS // dim)


def band_plan(n: int, least: float = LEAST, missed: float = MISSED, occupancy: int = OCCUPANCY) -> tuple[int, int]:
    """(bits of a band, bands) for n vectors."""
    bits = min(40, max(4, round(math.log2(max(n, 1) / occupancy)) if n > occupancy else 4))
    together = (1 - math.acos(least) / math.pi) ** bits
    return bits, math.ceil(math.log(missed) / math.log1p(-together))


def units(rows: list) -> tuple[np.ndarray, list[int]]:
    """Unit vectors of the usable ones among rows of one length, and which those are."""
    x = np.array(rows, np.float64)
    most = np.abs(x).max(1)
    usable = np.flatnonzero(np.isfinite(most) & (most > 0))
    x = x[usable] / most[usable][:, None]  # so that no square overflows
    return x / np.sqrt((x * x).sum(1))[:, None], usable.tolist()


def band_keys(signs: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """A number for the bits of each band."""
    own = signs[:, : bits * bands].reshape(len(signs), bands, bits).astype(np.int64)
    return own @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def codes(unit: np.ndarray, number: np.ndarray, bits: int, bands: int) -> dict[str, np.ndarray]:
    """Codes, correction factors, rounded bytes and keys of unit vectors of one length."""
    dim = unit.shape[1]
    m = code_rotations(dim)
    wanted = max(m, -(-(bits * bands) // dim))
    turned = unit @ rotations(dim, wanted).T
    ball = unit @ rotations(dim, wanted + -(-(BALL_BITS * BALL_ROUNDS) // dim))[dim * wanted :].T
    own = turned[:, : m * dim] / math.sqrt(m)
    factor = np.abs(own).sum(1) / math.sqrt(m * dim)
    scale = np.abs(unit).max(1) / 127
    steps = unit / scale[:, None]
    dice = np.stack([np.random.default_rng([SEED, int(v)]).random(dim) for v in number]) if len(number) else np.zeros_like(unit)
    rounded = np.clip(np.floor(steps + dice), -127, 127).astype(np.int8)
    return {"code": np.packbits(own > 0, axis=1), "factor": factor, "bytes": rounded, "scale": scale, "bands": band_keys(turned > 0, bits, bands), "ball_bands": band_keys(ball > 0, BALL_BITS, BALL_ROUNDS)}


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))


def _code(bits: int, bands: int):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, vectors = batch.column(0).to_numpy(), batch.column(1)
            lengths = np.array([len(v) for v in vectors.to_pylist()])
            for dim in np.unique(lengths):
                rows = np.flatnonzero(lengths == dim)
                unit, usable = units(vectors.take(pa.array(rows)).to_pylist())
                own = number[rows][usable]
                x = codes(unit, own, bits, bands)
                raw = [pa.array([row.tobytes() for row in x[c]], pa.binary()) for c in ("code", "bytes")]
                columns = [pa.array(own), pa.array(np.full(len(own), dim, np.int32)), _lists(unit), raw[0], pa.array(x["factor"]), raw[1], pa.array(x["scale"]), _lists(x["bands"]), _lists(x["ball_bands"])]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in CODED.split(", ")])

    return code


def _cosine(x: str, y: str):
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p)


def balls(coded: DataFrame, least: float = LEAST) -> DataFrame:
    """(vec, ball): each vector's leader, itself where no leader is within half the angle of a link."""
    reach = math.cos(math.acos(least) / 2 - 1e-7)
    units_of = coded.select("vec", "unit")
    ball = coded.select("vec", F.col("vec").alias("ball"))
    for k in range(BALL_ROUNDS):
        size = ball.groupBy("ball").agg(F.count(F.lit(1)).alias("size"))
        member = ball.join(size, "ball").join(coded.select("vec", "dim", F.col("ball_bands")[k].alias("key")), "vec")
        # the most popular ball of a bucket, the least number on ties; alone in a bucket, a vector has no one to turn to
        popular = member.groupBy("dim", "key").agg(F.max(F.struct("size", (-F.col("ball")).alias("less"))).alias("best"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
        # read again, so that the rows of a hot bucket can be split in this join
        popular = scratch.stored(popular.select("dim", "key", F.col("best.size").alias("best_size"), (-F.col("best.less")).alias("leader")), "embedding-popular")
        turn = member.join(popular, ["dim", "key"])
        turn = turn.filter((F.col("leader") != F.col("ball")) & ((F.col("best_size") > F.col("size")) | (F.col("leader") < F.col("ball"))))
        near = turn.select("vec", "leader").join(units_of, "vec").join(units_of.select(F.col("vec").alias("leader"), F.col("unit").alias("other")), "leader").filter(_cosine("unit", "other") >= reach)
        moved = scratch.stored(near.select("vec", "leader"), "embedding-turns")
        ball = scratch.stored(ball.join(moved, "vec", "left").select("vec", F.coalesce("leader", "ball").alias("ball")), "embedding-balls")
    # a leader that has turned to another ball is still within reach of those that stayed
    return ball


def _meeting(coded: DataFrame, ball: DataFrame, bands: int, block: int) -> DataFrame:
    """Rows of buckets with the pair of blocks (x, y) to which each copy goes; blocks of a bucket are parts of its balls."""
    own = scratch.stored(coded.select("vec", "dim", "code", "factor", "bytes", "scale", "bands").join(ball, "vec"), "embedding-own")
    narrow = own.select("vec", "dim", "code", "factor", "bytes", "scale", "ball", F.posexplode("bands").alias("band", "key"))
    bucket = ["dim", "band", "key"]
    sizes = narrow.groupBy(*bucket).agg(F.count(F.lit(1)).alias("rows"), F.min("ball").alias("least"), F.max("ball").alias("most")).filter("rows > 1 and least <> most")
    sizes = scratch.stored(sizes, "embedding-buckets")
    large = sizes.filter(F.col("rows") > block).select(*bucket)
    hot = narrow.select(*bucket, "ball").join(scratch.limited(large), bucket)
    # a ball with many rows in a large bucket has blocks of its own; all others share blocks by hash
    parts = scratch.stored(hot.groupBy(*bucket, "ball").agg(F.count(F.lit(1)).alias("n")), "embedding-parts")
    shared = parts.filter(F.col("n") <= block // 4).groupBy(*bucket).agg(F.sum("n").alias("n")).select(*bucket, F.lit(None).cast("long").alias("pure"), "n")
    cut = shared.unionByName(parts.filter(F.col("n") > block // 4).select(*bucket, F.col("ball").alias("pure"), "n")).withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
    cut = scratch.stored(cut, "embedding-cut")
    # balls of a bucket meet, each with all others and the shared part also with itself; then their blocks do
    other = cut.select(*bucket, F.col("pure").alias("other_pure"), F.col("parts").alias("other_parts"))
    met = cut.join(other, bucket).filter(F.col("pure").isNull() | F.col("other_pure").isNull() | (F.col("pure") != F.col("other_pure")))
    numbers = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    met = met.withColumn("part", numbers("parts")).withColumn("other_part", numbers("other_parts"))
    named = lambda pure, part: F.concat_ws(":", F.coalesce(F.col(pure).cast("string"), F.lit("-")), part)
    met = met.select(*bucket, named("pure", "part").alias("name"), named("other_pure", "other_part").alias("other"))
    met = scratch.stored(met.select(*bucket, "name", F.least("name", "other").alias("x"), F.greatest("name", "other").alias("y")), "embedding-blocks")
    pure = cut.filter("pure is not null").select(*bucket, F.col("pure").alias("ball"), F.col("parts").alias("own_parts"))
    rest = cut.filter("pure is null").select(*bucket, F.col("parts").alias("rest_parts"))
    live = narrow.join(scratch.limited(sizes.select(*bucket, (F.col("rows") > block).alias("large"))), bucket)
    small = live.filter("not large").select(*narrow.columns, F.lit("").alias("name"), F.lit("").alias("x"), F.lit("").alias("y"))
    dealt = live.filter("large").join(scratch.limited(pure), [*bucket, "ball"], "left").join(scratch.limited(rest), bucket, "left")
    spread = lambda parts: F.pmod(F.xxhash64("vec"), F.coalesce(F.col(parts), F.lit(1))).cast("string")
    dealt = dealt.withColumn("name", F.when(F.col("own_parts").isNotNull(), F.concat_ws(":", F.col("ball").cast("string"), spread("own_parts"))).otherwise(F.concat_ws(":", F.lit("-"), spread("rest_parts"))))
    dealt = dealt.join(scratch.limited(met), [*bucket, "name"]).select(*narrow.columns, "name", "x", "y")
    return small.unionByName(dealt)


def _estimates(least: float):
    wide = math.sqrt(1 - least * least)

    def told(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        vec, ball, factor, scale = (rows[c].to_numpy() for c in ("vec", "ball", "factor", "scale"))
        dim, name = rows["dim"][0].as_py(), np.array(rows["name"].to_pylist())
        m = code_rotations(dim)
        bits = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(len(vec), -1)
        signs = (np.unpackbits(bits, axis=1, count=m * dim).astype(np.float32) * 2 - 1) / np.float32(math.sqrt(m * dim))
        back = np.frombuffer(b"".join(rows["bytes"].to_pylist()), np.int8).reshape(len(vec), dim) * scale[:, None]
        turned = (back @ rotations(dim, m).T / math.sqrt(m)).astype(np.float32)
        # what an estimate may lie below the least cosine: the code's own spread, the rounding and single precision
        spread = np.sqrt(np.maximum(1 / factor**2 - 1, 0)) / math.sqrt(m * max(dim - 1, 1))
        slack = SURE * wide * spread
        rounding = scale * math.sqrt(dim) + 1e-5
        x, y = rows["x"][0].as_py(), rows["y"][0].as_py()
        left = np.flatnonzero(name == x)
        right = np.flatnonzero(name == y) if x != y else left
        step = max(1, CELLS // max(len(right), 1))
        for k in range(0, len(left), step):
            i = left[k : k + step]
            estimate = signs[i] @ turned[right].T / factor[i][:, None]
            open_ = estimate + slack[i][:, None] + rounding[right][None, :] / factor[i][:, None] >= least
            open_ &= ball[i][:, None] != ball[right][None, :]
            if x == y:
                open_ &= vec[i][:, None] < vec[right][None, :]
            a, b = np.nonzero(open_)
            if len(a):
                a, b = vec[i[a]], vec[right[b]]
                yield pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    def estimates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            groups = list(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("dim", "band", "key", "x", "y")), strict=True))
            start = 0
            for k, g in enumerate(groups):
                if g != last:
                    if k > start:
                        held.append(batch.slice(start, k - start))
                    if held:
                        yield from told(pa.Table.from_batches(held))
                    held, start, last = [], k, g
            held.append(batch.slice(start))
        if held:
            yield from told(pa.Table.from_batches(held))

    return estimates


def candidates(coded: DataFrame, ball: DataFrame, bands: int, *, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """(a, b), a < b: pairs of different balls that the estimates do not turn down."""
    group = ["dim", "band", "key", "x", "y"]
    met = _meeting(coded, ball, bands, block).repartition(*group).sortWithinPartitions(*group)
    return met.mapInArrow(_estimates(least), "a long, b long").distinct()


def exact_links(pairs: DataFrame, coded: DataFrame, least: float = LEAST) -> DataFrame:
    """Those pairs whose cosine in double precision is ``least`` or more."""
    units_of = coded.select("vec", "unit")
    both = pairs.join(units_of.withColumnRenamed("vec", "a"), "a").join(units_of.select(F.col("vec").alias("b"), F.col("unit").alias("other")), "b")
    return both.filter(_cosine("unit", "other") >= least).select("a", "b")


def near_vectors(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", least: float = LEAST, block: int = BLOCK, occupancy: int = OCCUPANCY) -> DataFrame:
    """(id, n_links, component_id, kept) for each row."""
    vector = F.col(vector_col).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)
    own = scratch.stored(rows.select(F.col(id_col).cast("long").alias("id"), F.when(usable, F.transform(vector, lambda x: x + 0.0)).alias("v")), "embedding-rows")
    whole = own.filter("v is not null").groupBy("v").agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("n"))
    whole = scratch.stored(whole.withColumn("vec", F.monotonically_increasing_id()), "embedding-vectors")
    bits, bands = band_plan(whole.count(), least, occupancy=occupancy)
    coded = scratch.stored(whole.select("vec", "v").mapInArrow(_code(bits, bands), CODED), "embedding-codes")
    ball = balls(coded, least)
    links = scratch.stored(exact_links(candidates(coded, ball, bands, least=least, block=block), coded, least), "embedding-links")
    counts = whole.select("vec", "n")
    direct = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(counts.withColumnRenamed("vec", "b"), "b").groupBy("a").agg(F.sum("n").alias("direct"))
    inside = ball.join(counts, "vec").groupBy("ball").agg(F.sum("n").alias("inside"))
    edges = links.unionByName(ball.filter("vec <> ball").select(F.col("vec").alias("a"), F.col("ball").alias("b")))
    roots = near_dedup.components(edges).withColumnRenamed("key", "k")
    named = whole.join(roots, F.col("vec") == F.col("k"), "left").select("vec", "v", "least_id", F.coalesce("root", "vec").alias("root"))
    named = scratch.stored(named.join(ball, "vec").join(inside, "ball").join(direct.withColumnRenamed("a", "vec"), "vec", "left"), "embedding-named")
    component = named.groupBy("root").agg(F.min("least_id").alias("component"))
    told = named.join(component, "root").select("v", "component", (F.col("inside") + F.coalesce("direct", F.lit(0)) - 1).alias("links"))
    out = own.join(scratch.stored(told, "embedding-told"), "v", "left")
    component = F.when(F.col("v").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
