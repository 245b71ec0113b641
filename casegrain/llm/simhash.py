"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: 64 bits, a bit being set if it is set in more than half of a text's shingle hashes. Two are linked if at
most ``tau`` bits differ; classes are what links connect.

Search works on distinct fingerprints. Correlated bits are grouped into two partitions of 32 bits; with thresholds t0
and t1 such that t0 + t1 = tau - 1 (an exhausted partition has -1), a linked pair must be within the threshold in at
least one partition. For each fingerprint, dynamic programming over the partitions allocates the thresholds, on
candidate counts estimated from exact counts of all 16-bit blocks. It then visits the buckets of the values
that near its own; whoever meets there is verified on all 64 bits.

A bucket of more than HOT fingerprints (and those near it, which its members visit) goes to many tasks: its rows are sent to sub-buckets by each of
tau + 1 blocks of the other partition's bits, of which a linked pair agrees in one at least.

A bucket never emits its pairs: it is split into sub-buckets by what its members may still differ in, and
emits a spanning forest of its links, at most one row for each member. Components over those edges are the
same as over all links. They are found by contraction (large star, small star) in rounds that are written down.

Defined results: null and empty texts have the fingerprint zero and are linked like any other; fewer words
than a shingle has are one shingle; a null id is in its class but never names it, unless the class has no other; repeated
rows are each reported; an empty table gives an empty result; of extra columns all stay, except those named
like the added ones (fingerprint, component_id), which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrain.llm.common import forgotten, written

SHINGLE, TAU, SEED = 3, 3, 42
PARTS, WIDTH, BLOCK = 2, 32, 16
#: Rows of the matrix of hash bits at a time, fingerprints for the correlation of bits, cost of a visit in candidates.
CHUNK, SAMPLE, VISIT = 1 << 15, 20_000, 1.0
#: Members of a bucket that are compared at a time; larger ones are split by the bits they may differ in.
DENSE = 2048
#: Fingerprints that share a partition's bits, from which on their bucket is sent to several tasks.
HOT = 100_000
#: Lower-cases A-Z; ASCII white space is what bytes.split() parts at.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_POWERS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    words = text.translate(LOWER).split() if text else []
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    n = len(words) - shingle + 1
    hashes = np.fromiter((digest(join(s), SEED) for s in zip(*(words[k:] for k in range(shingle)), strict=False)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, CHUNK):
        ones += np.unpackbits(hashes[k : k + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(_POWERS[2 * ones > n].sum())


def fingerprinted(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp), fp being the fingerprint as a signed long; id and hash tell rows apart later."""
    slim = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    id_type = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            prints = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(prints.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    return slim.mapInArrow(run, f"doc_id {id_type}, text_hash long, fp long")


# Partitions and thresholds.


def grouped_bits(sample: np.ndarray) -> list[list[int]]:
    """Two partitions of 32 bits: each next bit joins the bits it is most correlated with."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
    if len(bits) < 2:
        return [list(range(32)), list(range(32, 64))]
    with np.errstate(divide="ignore", invalid="ignore"):
        near = np.abs(np.nan_to_num(np.corrcoef(bits.T), nan=1.0))  # a constant bit goes with anything
    np.fill_diagonal(near, 0)
    first = [int(near.max(axis=1).argmax())]
    while len(first) < WIDTH:
        left = [b for b in range(64) if b not in first]
        first.append(max(left, key=lambda b: (near[b, first].mean(), -b)))
    return [sorted(first), sorted(set(range(64)) - set(first))]


def packed(prints: np.ndarray, bits: list[int]) -> np.ndarray:
    """The named bits of each fingerprint, side by side."""
    out = np.zeros(len(prints), np.uint64)
    for k, b in enumerate(bits):
        out |= ((prints >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def masks(width: int, radius: int) -> list[int]:
    """All masks of ``width`` bits with exactly ``radius`` bits set."""
    out = [(0, -1)]
    for _ in range(radius):
        out = [(m | 1 << b, b) for m, last in out for b in range(last + 1, width)]
    return [m for m, _ in out]


def near_counts(counts: np.ndarray, most: int) -> np.ndarray:
    """[value, d]: how many counted are exactly d bits away from the value."""
    at = np.arange(len(counts))
    width = len(counts).bit_length() - 1
    return np.stack([sum(counts[at ^ m] for m in masks(width, d)) for d in range(most + 1)], axis=1)


def allocated(prints: np.ndarray, parts: list[list[int]], shares: list[np.ndarray], total: int, tau: int) -> np.ndarray:
    """Thresholds [fingerprint, partition] that sum to tau - partitions + 1 at the least estimated cost.

    ``shares`` has, for each partition's 16-bit blocks in turn, the share of all fingerprints at each distance from
    each value. Cost of a threshold: visits of buckets, and the candidates expected there.
    """
    radii = tau - len(parts) + 2  # thresholds -1 to tau - partitions + 1 and, if others have -1, above
    top = radii - 1 + (len(parts) - 1)
    visits = np.cumsum([len(masks(WIDTH, r)) for r in range(top + 1)])
    costs = []
    for k, bits in enumerate(parts):
        value = packed(prints, bits)
        dist = None
        for j in range(0, WIDTH, BLOCK):
            block = shares[(k * WIDTH + j) // BLOCK][(value >> np.uint64(j)).astype(np.int64) & (1 << BLOCK) - 1][:, : top + 1]
            dist = block if dist is None else np.stack([sum(dist[:, a] * block[:, d - a] for a in range(d + 1)) for d in range(top + 1)], axis=1)
        cost = np.cumsum(dist, axis=1) * total + VISIT * visits
        costs.append(np.concatenate((np.zeros((len(prints), 1)), cost), axis=1))  # column r + 1: threshold r
    # best[s]: the least cost of the partitions so far with thresholds + 1 that sum to s.
    goal = tau + 1
    best = np.full((len(prints), goal + 1), np.inf)
    best[:, 0] = 0
    chosen = []
    for cost in costs:
        new, pick = np.full_like(best, np.inf), np.zeros(best.shape, np.int8)
        for s in range(goal + 1):
            for r in range(min(s, cost.shape[1] - 1) + 1):
                c = best[:, s - r] + cost[:, r]
                better = c < new[:, s]
                new[better, s], pick[better, s] = c[better], r
        best = new
        chosen.append(pick)
    out, s = np.zeros((len(prints), len(parts)), np.int8), np.full(len(prints), goal)
    for k in range(len(parts) - 1, -1, -1):
        r = chosen[k][np.arange(len(prints)), s]
        out[:, k], s = r - 1, s - r
    return out


# Buckets.


def forest(prints: np.ndarray, tau: int, bits: int = 64) -> list[tuple[int, int]]:
    """Edges (indices) that connect what links of at most ``tau`` bits connect; members are distinct.

    More than DENSE members are compared only within groups that agree in one of tau + 1 blocks of bits, which any
    linked pair does; no pair is stored.
    """
    parent = list(range(len(prints)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges: list[tuple[int, int]] = []

    def compare(members: np.ndarray) -> None:
        own = prints[members]
        for k in range(len(members) - 1):
            for j in np.flatnonzero(np.bitwise_count(own[k + 1 :] ^ own[k]) <= tau).tolist():
                a, b = root(int(members[k])), root(int(members[k + 1 + j]))
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    edges.append((int(members[k]), int(members[k + 1 + j])))

    def split(members: np.ndarray, used: int) -> None:
        varied = [b for b in range(bits) if not used >> b & 1]
        if len(members) <= DENSE or len(varied) < 2 * (tau + 1):
            compare(members)
            return
        for block in range(tau + 1):
            own = varied[block :: tau + 1]
            value = packed(prints[members], own)
            order = np.argsort(value, kind="stable")
            cuts = np.flatnonzero(np.diff(value[order])) + 1
            for part in np.split(order, cuts):
                if len(part) > 1:
                    split(members[part], used | sum(1 << b for b in own) if len(part) > DENSE else used)

    split(np.arange(len(prints)), 0)
    return edges


def _visits(parts, shares, total, tau, hot):
    """Each fingerprint's own bucket in each partition (home), and the buckets it visits; ``hot`` are sorted bucket numbers."""

    def rows_of(bucket: np.ndarray, prints: np.ndarray, home: bool, part: int) -> Iterator[tuple]:
        if len(hot):
            among = hot[np.minimum(np.searchsorted(hot, bucket), len(hot) - 1)] == bucket
            other, many = parts[1 - part], prints[among]
            for block in range(tau + 1):
                own = packed(many, other[block :: tau + 1])
                yield np.uint64(1 << 62) + ((bucket[among] * np.uint64(tau + 1) + np.uint64(block)) << np.uint64(-(-WIDTH // (tau + 1)))) + own, many, home
            bucket, prints = bucket[~among], prints[~among]
        yield bucket, prints, home

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shares.value
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                prints = batch.column(0).to_numpy()[k : k + 4096].view(np.uint64)
                limits = allocated(prints, parts, tables, total, tau)
                for part, bits in enumerate(parts):
                    value = packed(prints, bits)
                    own = np.uint64(part << WIDTH)
                    rows = [*rows_of(value | own, prints, True, part)]
                    for r in range(1, int(limits[:, part].max(initial=-1)) + 1):
                        at = limits[:, part] >= r
                        for m in masks(WIDTH, r):
                            rows += rows_of((value[at] ^ np.uint64(m)) | own, prints[at], False, part)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([v for v, _, _ in rows]).view(np.int64)), pa.array(np.concatenate([p for _, p, _ in rows]).view(np.int64)), pa.array(np.repeat([h for _, _, h in rows], [len(p) for _, p, _ in rows]))], names=["bucket", "fp", "home"])

    return run


def _forests(tau: int):
    """Edges from rows that come sorted by bucket; a bucket at a time is held, 8 bytes a member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # pieces of the bucket that may go on

        def edges(bucket, prints, home) -> Iterator[pa.RecordBatch]:
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]))
            homes = np.add.reduceat(home.astype(np.int64), cuts[:-1])
            pairs = []
            for a, b, n in zip(cuts[:-1].tolist(), cuts[1:].tolist(), homes, strict=True):
                if n and b - a > 1:  # visitors alone meet nobody
                    own = prints[a:b].view(np.uint64)
                    if b - a == 2:
                        found = [(0, 1)] if int(np.bitwise_count(own[0] ^ own[1])) <= tau else []
                    else:
                        found = forest(own, tau)
                    pairs += [(int(prints[a + x]), int(prints[a + y])) for x, y in found]
            for k in range(0, len(pairs), 65536):
                x, y = np.array(pairs[k : k + 65536], np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            last = int(np.searchsorted(now[0], now[0][-1]))
            if held and (last or held[-1][0][-1] != now[0][0]):
                held.append(tuple(x[:last] for x in now))
                yield from edges(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held = []
            elif last:
                yield from edges(*(x[:last] for x in now))
            held.append(tuple(x[last:] for x in now))
        if held:
            yield from edges(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def links(prints: DataFrame, tau: int = TAU) -> DataFrame:
    """Edges (a, b), a < b, among distinct fingerprints (column fp) that connect the same classes as all links."""
    spark = prints.sparkSession
    total = prints.count()
    chance = F.xxhash64("fp", F.lit(3)).bitwiseAND(F.lit((1 << 30) - 1)) < int((1 << 30) * min(1.0, SAMPLE / max(1, total)))
    sample = np.array([r[0] for r in prints.where(chance).select("fp").collect()], np.int64).view(np.uint64)  # SAMPLE on average
    parts = grouped_bits(np.sort(sample))
    # Exact counts of each 16-bit block: four tables of 65,536 at most.
    blocks = [bits[j : j + BLOCK] for bits in parts for j in range(0, WIDTH, BLOCK)]
    value = lambda bits: sum((F.shiftrightunsigned("fp", b).bitwiseAND(F.lit(1).cast("long")) * (1 << k) for k, b in enumerate(bits)), F.lit(0))
    pairs = prints.select(F.explode(F.array(*[value(bits) + (n << BLOCK) for n, bits in enumerate(blocks)])).alias("v"))
    counts = np.zeros(len(blocks) << BLOCK)
    for v, n in pairs.groupBy("v").count().toLocalIterator():
        counts[v] = n
    shares = [near_counts(c / max(1, total), tau) for c in counts.reshape(len(blocks), -1)]
    homes = prints.select(F.explode(F.array(*[value(bits).cast("long") + (n << WIDTH) for n, bits in enumerate(parts)])).alias("v"))
    full = [r[0] for r in homes.groupBy("v").count().where(F.col("count") > HOT).collect()]  # a row for each HOT fingerprints at most
    near_full = {v ^ m for v in full for r in range(tau + 1) for m in masks(WIDTH, r)}
    hot = np.array(sorted(near_full), np.uint64)
    rows = prints.mapInArrow(_visits(parts, spark.sparkContext.broadcast(shares), total, tau, hot), "bucket long, fp long, home boolean")
    near = rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_forests(tau), "a long, b long")
    return near.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each component, for the nodes of edges (a, b)."""
    now = written(edges.select("a", "b"), "edges")
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: greater neighbours go to the least of the neighbourhood.
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: lesser neighbours and the node itself go to the least of them.
        down = large.where("b < a")
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        new = written(small.select(F.col("b").alias("a"), F.col("a").alias("b")), "edges")  # a is the lesser
        # Done when every node has one lesser neighbour, which has none itself.
        if new.groupBy("b").agg(F.count("*").alias("n")).where("n > 1").isEmpty() and new.select("a").join(new.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
            return new.select(F.col("b").alias("node"), F.col("a").alias("root")).union(new.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        forgotten(now)
        now = new


def classed(prints: DataFrame, tau: int = TAU) -> DataFrame:
    """The rows of a written table with a column ``fp``, and doc_id, with root (the class) and component_id."""
    reps = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    return connected(prints, reps, links(reps.select("fp"), tau))


def connected(prints: DataFrame, reps: DataFrame, edges: DataFrame) -> DataFrame:
    """``prints`` with root and component_id; ``reps`` has each fp and its least doc_id, ``edges`` links fps."""
    roots = written(components(edges), "roots")
    rooted = reps.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = written(rooted.join(names, "root").select("fp", "root", "component_id"), "classes")
    return prints.join(by_print, "fp")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, tau: int = TAU) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each document."""
    prints = written(fingerprinted(docs, shingle), "prints")
    return classed(prints, tau).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, tau: int = TAU, similarity: float | None = None) -> DataFrame:
    """One document of each class: that with the least id, null last, then by the hash of its text.

    With ``similarity``, links are the pairs of at least that Jaccard similarity, found by longer fingerprints in more partitions (see
    ``similar``) and verified exactly, in place of those of at most ``tau`` bits.
    """
    if similarity is not None:
        from casegrain.llm import similar

        return firsts(docs, similar.classed(docs, shingle, similarity))
    return firsts(docs, classed(written(fingerprinted(docs, shingle), "prints"), tau))


def firsts(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The first row of ``docs`` in each class; ``classes`` has root, doc_id and text_hash of each row."""
    alike = classes.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    first = alike.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash", "n")).alias("k"))
    kept = written(first.select(F.col("k.doc_id").alias("_id"), F.col("k.text_hash").alias("_hash"), F.col("k.n").alias("_n")), "kept")
    rows = docs.select(F.struct("*").alias("_row"), "doc_id", F.xxhash64("text").alias("_h"))
    rows = rows.join(kept, (F.col("_h") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    if kept.where("_n > 1").isEmpty():
        return rows.select("_row.*")
    once = rows.where("_n = 1").select("_row")  # rows equal in id and text: any one of them
    return once.union(rows.where("_n > 1").groupBy("doc_id", "_h").agg(F.first("_row").alias("_row")).select("_row")).select("_row.*")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
