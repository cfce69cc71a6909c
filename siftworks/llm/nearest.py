"""Approximate nearest neighbours by multi-index hashing over learnt rotated binary codes.

Codes are signs under rotations that are fitted on a bounded sample (iterative
quantization from several starts). Equal vectors are one class, searched once.

1. Codes are split into substrings and each is indexed, by blocks of neighbouring codes. A code within radius ``r`` of a
   query agrees with it in some substring but for ``r // substrings`` bits, so probing all such values
   and checking the whole code retrieves every code within the radius. A query is done if
   its neighbours so found are nearer than what could lie beyond the radius but by chance.
2. The others need a wider radius, at which the buckets that probing opens hold nearly all codes
   (for vectors without clusters that is inherent). Their codes are compared in blocks:
   queries in lots against blocks of codes, everything within the wide radius or, where that
   is little, the nearest codes of the block.

What is retrieved is reranked by the cosine of the original vectors in double precision. The
wide radius is the one that holds ``TARGET`` of the sample's own neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftworks.session import staged

SAMPLE_ROWS = 4096
ROTATIONS = 4
SUBSTRING = 16
NARROW = 1  # bits a substring may differ by in probing
SURE = 0.97  # cosine that nearly always lies within the narrow radius
TARGET = 0.99
BLOCK, LOT = 4096, 512
BLOCK_BITS = 8  # of the number of codes in a block of the substring index
LEAST = 64


def cosines(many: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Cosine of one vector with each of many, the same whatever else is in the block."""
    many, one = many.astype(np.float64), one.astype(np.float64)
    return (many * one).sum(axis=1) / (np.sqrt((many * many).sum(axis=1)) * np.sqrt((one * one).sum()))


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def rotations(sample: np.ndarray, count: int = ROTATIONS, rounds: int = 30) -> np.ndarray:
    """``count`` projections side by side whose signs lose little, fitted to unit vectors."""
    bits = -(-min(64, sample.shape[1]) // 8) * 8
    _, axes = np.linalg.eigh(sample.T @ sample)
    axes = axes[:, ::-1][:, :bits]
    if axes.shape[1] < bits:
        axes = np.pad(axes, ((0, 0), (0, bits - axes.shape[1])))
    found = []
    for seed in range(count):
        turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))[0]
        flat = sample @ axes
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.sign(flat @ turn).T @ flat)
            turn = (u @ vt).T
        found.append(axes @ turn)
    return np.concatenate(found, axis=1)


def codes(vectors: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Binary codes as bytes, one row for each vector."""
    return np.packbits(_unit(vectors) @ turn > 0, axis=1)


def distances(many: np.ndarray, one: np.ndarray) -> np.ndarray:
    width = many.shape[1]
    if width % 8 == 0:
        many, one = many.view(np.uint64), one.view(np.uint64)
    return np.bitwise_count(many ^ one).sum(axis=1, dtype=np.int32)


def wide_radius(sample: np.ndarray, turn: np.ndarray, k: int, target: float = TARGET) -> int:
    """The radius that holds ``target`` of the neighbours among the sample itself."""
    own = codes(sample, turn)
    far = []
    for i in range(min(256, len(sample))):
        near = np.argsort(-cosines(sample, sample[i]), kind="stable")[1 : k + 1]
        far.append(distances(own[near], own[i]))
    return int(np.quantile(np.concatenate(far), target)) if far and len(sample) > 1 else 0


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _valid(rows: DataFrame) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where(
        F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    )


def _top(rows: DataFrame, key: str, k: int) -> DataFrame:
    """The best ``k`` rows of each key; partial results are cut before they are shuffled."""
    order = Window.partitionBy(key).orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _coded(rows: DataFrame, turn: np.ndarray, dim: int, id_name: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = codes(_matrix(batch.column("embedding"), dim), turn)
            yield batch.append_column("code", pa.array([x.tobytes() for x in own], pa.binary()))

    picked = rows.select(id_name, "embedding")
    return picked.mapInArrow(run, f"{id_name} long, embedding array<double>, code binary")


def _probes(code: str, bits: int, near: int) -> F.Column:
    """``(substring, value)`` for each 16-bit substring of a code, and for all values ``near`` bits away."""
    flips = F.array(*[F.lit(x) for x in ([0] + [1 << b for b in range(SUBSTRING)] if near else [0])])

    def around(j: int) -> F.Column:
        word = F.conv(F.hex(F.substring(code, 2 * j + 1, 2)), 16, 10).cast("int")
        return F.transform(flips, lambda x: F.struct(F.lit(j).alias("j"), word.bitwiseXOR(x).alias("v")))

    return F.flatten(F.array(*[around(j) for j in range(bits // SUBSTRING)]))


def _probed(queries: DataFrame, index: DataFrame, bits: int, dim: int, k: int) -> DataFrame:
    """``(qkey, vec_id, score)``: per block of codes the best ``k`` of those within the narrow radius of each query's.

    The buckets of a substring hold blocks of neighbouring codes, so near copies share few entries, however
    many they are. A query meets each block that its probes name once; the code check and the rerank by floats
    are done there, and what is among a query's best is among the best of its block.
    """
    radius = (bits // SUBSTRING) * (NARROW + 1) - 1
    entries = index.select("block", F.explode(_probes("code", bits, 0)).alias("at")).select("block", "at.*").distinct()
    probes = queries.select("qkey", F.explode(_probes("code", bits, NARROW)).alias("at")).select("qkey", "at.*")
    asked = staged(probes.join(entries, ["j", "v"]).select("qkey", "block").distinct(), "asked")
    # a block that very many queries ask for is dealt out with some of them each
    lots = asked.groupBy("block").agg(F.ceil(F.count("*") / LOT).alias("lots"))
    dealt = asked.join(lots, "block").withColumn("lot", F.pmod(F.xxhash64("qkey"), F.col("lots")))
    left = dealt.join(queries.select("qkey", "code", "embedding"), "qkey").select("block", "lot", "qkey", "code", "embedding")
    members = index.join(lots, "block").select(
        F.col("block").alias("of_block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1)).alias("of_lot"),
        "vec_id",
        "code",
        "embedding",
    )

    def run(wanted: pa.Table, block: pa.Table) -> pa.Table:
        q_ids, ids = wanted.column("qkey").to_pylist(), block.column("vec_id").to_numpy()
        q_own, own = (np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(t.num_rows, -1) for t in (wanted, block))
        q_vectors, vectors = _matrix(wanted.column("embedding"), dim), _matrix(block.column("embedding"), dim)
        out = []
        for q, code, vector in zip(q_ids, q_own, q_vectors, strict=True):
            near = np.flatnonzero(distances(own, code) <= radius) if len(ids) else ids
            score = cosines(vectors[near], vector)
            out += [(q, int(ids[near[b]]), float(score[b])) for b in np.lexsort((ids[near], -score))[:k]]
        kinds = (pa.int64(), pa.int64(), pa.float64())
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["qkey", "vec_id", "score"])

    both = left.groupBy("block", "lot").cogroup(members.groupBy("of_block", "of_lot"))
    return both.applyInArrow(run, "qkey long, vec_id long, score double")


def _one_row(part: pa.RecordBatch | pa.Table, dim: int, id_name: str) -> dict[str, pa.Array]:
    """Many rows as one row of bytes."""
    return {
        "ids": pa.array([part.column(id_name).to_numpy().tobytes()], pa.binary()),
        "codes": pa.array([b"".join(part.column("code").to_pylist())], pa.binary()),
        "vectors": pa.array([_matrix(part.column("embedding"), dim).tobytes()], pa.binary()),
    }


def _blocks(rows: DataFrame, dim: int, size: int) -> DataFrame:
    """Blocks of up to ``size`` neighbouring rows, each one row of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, size):
                yield pa.record_batch(_one_row(batch.slice(a, size), dim, "vec_id"))

    return rows.select("vec_id", "code", "embedding").mapInArrow(run, "ids binary, codes binary, vectors binary")


def _lots(queries: DataFrame, dim: int, lots: int) -> DataFrame:
    """Queries dealt into numbered lots by hash, each one row of bytes."""

    def run(table: pa.Table) -> pa.Table:
        return pa.table({"lot": table.column("lot")[:1], **{f"q_{k}": v for k, v in _one_row(table, dim, "qkey").items()}})

    dealt = queries.select("qkey", "code", "embedding", F.pmod(F.xxhash64("qkey"), F.lit(lots)).alias("lot"))
    return dealt.groupBy("lot").applyInArrow(run, "lot long, q_ids binary, q_codes binary, q_vectors binary")


def _scanned(queries: DataFrame, index: DataFrame, radius: int, dim: int, k: int) -> DataFrame:
    """``(qkey, vec_id, score)``: per block the best of the codes within the wide radius of each query's."""
    lots = -(-queries.count() // LOT)
    if not lots:
        return queries.sparkSession.createDataFrame([], "qkey long, vec_id long, score double")
    spread = max(2 * index.sparkSession.sparkContext.defaultParallelism, 1)
    blocks = _blocks(index.repartition(spread, "vec_id"), dim, BLOCK)
    numbers = F.sequence(F.lit(0).cast("long"), F.lit(lots - 1).cast("long"))
    pairs = blocks.withColumn("lot", F.explode(numbers)).join(_lots(queries, dim, lots), "lot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, q_ids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["q_ids"], np.int64)
                own = np.frombuffer(row["codes"], np.uint8).reshape(len(ids), -1)
                q_own = np.frombuffer(row["q_codes"], np.uint8).reshape(len(q_ids), -1)
                vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, dim)
                wanted = np.frombuffer(row["q_vectors"], np.float64).reshape(-1, dim)
                out = []
                for q, code, vector in zip(q_ids.tolist(), q_own, wanted, strict=True):
                    far = distances(own, code)
                    near = np.flatnonzero(far <= radius)
                    if len(near) < k:
                        near = np.argpartition(far, min(LEAST, len(far)) - 1)[:LEAST]
                    score = cosines(vectors[near], vector)
                    best = np.lexsort((ids[near], -score))[:k]
                    out += [(q, int(ids[near[b]]), float(score[b])) for b in best]
                names = ("qkey", "vec_id", "score")
                columns = zip(*out, strict=True)
                yield pa.record_batch({n: pa.array(list(c)) for n, c in zip(names, columns, strict=True)})

    return pairs.select("ids", "codes", "vectors", "q_ids", "q_codes", "q_vectors").mapInArrow(
        run, "qkey long, vec_id long, score double"
    )


def nearest(rows: DataFrame, wanted: str = "vec_id % 50 = 0", k: int = 5, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found of each row that ``wanted`` names, itself left out.

    Nearness is the cosine in double precision, ties go to the smaller id; a query
    with fewer candidates gets all of them. Rows without an id, and vectors that are null, empty, zero or hold
    null or non-finite components take no part. An id given several times counts
    once, with the smallest of its vectors. Vectors are compared with those of their own
    length. Other columns are ignored. Without queries or candidates the result is empty.
    """
    valid = _valid(rows).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    # of equal vectors the smallest k + 1 ids can be among the nearest of anything
    order = Window.partitionBy("embedding").orderBy("vec_id")
    few = staged(valid.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1), "classes")
    queries = staged(valid.where(wanted).withColumnRenamed("vec_id", "query_id"), "queries")
    result = None
    for (dim,) in few.select(F.size("embedding")).distinct().collect():
        own = few.where(F.size("embedding") == dim)
        part = _nearest(own, queries.where(F.size("embedding") == dim), dim, k, sample_rows)
        result = part if result is None else result.unionByName(part)
    if result is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return result


def _nearest(few: DataFrame, queries: DataFrame, dim: int, k: int, sample_rows: int) -> DataFrame:
    firsts = few.where("nth = 1").select("vec_id", "embedding")
    sample = firsts.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toPandas()["embedding"]
    sample = _unit(np.array(sample.tolist(), np.float64).reshape(-1, dim))
    turn = rotations(sample)
    bits = turn.shape[1]
    # neighbouring codes in blocks; the upper bits of the number are the partition's
    coded = staged(_coded(firsts, turn, dim, "vec_id"), "codes")
    ordered = coded.repartitionByRange("code", "vec_id").sortWithinPartitions("code", "vec_id")
    index = staged(ordered.withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)), "index")
    distinct = queries.groupBy("embedding").agg(F.min("query_id").alias("qkey"))
    searched = staged(_coded(distinct, turn, dim, "qkey"), "searched")
    # a class is entered with its smallest ids, each with the class's score
    members = few.join(firsts.withColumnRenamed("vec_id", "first"), "embedding").select("first", "vec_id")

    def with_members(found: DataFrame) -> DataFrame:
        best = _top(found, "qkey", k + 1).select("qkey", F.col("vec_id").alias("first"), "score")
        return _top(best.join(members, "first").select("qkey", "vec_id", "score"), "qkey", k + 1)

    probed = staged(with_members(_probed(searched, index, bits, dim, k + 1)), "probed")
    sure = probed.groupBy("qkey").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    done = sure.where((F.col("n") > k) & (F.col("least") >= SURE)).select("qkey")
    rest = searched.join(done, "qkey", "left_anti")
    wide = with_members(_scanned(rest, index, wide_radius(sample, turn, k), dim, k + 1))
    found = probed.join(done, "qkey", "left_semi").unionByName(wide).drop("rank")
    named = queries.join(searched.select("qkey", "embedding"), "embedding").select("query_id", "qkey")
    others = named.join(found, "qkey").where("vec_id <> query_id")
    return _top(others, "query_id", k).select("query_id", "rank", "vec_id", "score")
