"""SimHash near-duplicates, searched by the generalised pigeonhole principle."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, discard, fresh, materialise, pieces, spread_join, texts
from .components import connected_components

BITS = 64
#: Fingerprints of which a key brings together more than this aren't compared in pairs but by the balls around them.
CROWD = 48
#: Hashes whose bits are counted at once.
AT_ONCE = 1 << 13
#: Costs that the plan weighs against each other: making and joining a key, and comparing a candidate.
KEY_COST, PAIR_COST = 1.0, 0.2
#: Texts in which shingles are counted: about this many, or one in SAMPLE_STEP if that is more; from which count on one is frequent, and how many of these are told to all tasks.
SAMPLE, SAMPLE_STEP, FREQUENT, FREQUENT_AT_MOST = 5_000, 50, 5, 200_000
#: Words of 64 bits in the sketch of a set that stands beside each of its keys. The one that is looked at once for each pair has as many bits as the set has hashes, up to the next power of 2.
SKETCH = 4
#: Bytes of text from which shingles are made at once.
SHINGLE_BYTES = 1 << 19
#: Rows of a key that one task compares with all of them.
SALT = 2_000
#: What rounding may add to a bound on similarity.
EPS = 1e-6


# Fingerprints


def features(text: str, size: int) -> tuple[list[bytes], list[int] | None]:
    """What is hashed, with weights: shingles of ``size`` words, repeats included (no weights), or for size 0 the distinct words, by the root of their number."""
    words = text.encode().lower().split()
    if size == 0:
        counts = Counter(words)
        return list(counts), [math.isqrt(256 * c) for c in counts.values()]
    if len(words) <= size:
        return [b" ".join(words)] if words else [], None
    joined = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[: len(words) - size]]]
    return [joined[a:b] for a, b in zip(starts, ends[size - 1 :], strict=True)], None


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """k hashes of each hash: itself, and others by the finaliser of splitmix64."""
    out = [hashes]
    for i in range(1, k):
        z = hashes + np.uint64(i * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(z ^ (z >> np.uint64(31)))
    return np.stack(out, 1)


def majority(hashes: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Of (n, k) hashes k fingerprints: bit i is set if more than half of the (weighted) hashes have it.

    Sums are of whole numbers below 2^24 in single precision, or below 2^53 in double, and so exact.
    """
    k = hashes.shape[1]
    w = np.ones(len(hashes)) if weights is None else weights.astype(np.float64)
    total = w.sum()
    kind = np.float32 if total < 1 << 24 else np.float64
    sums = np.zeros(k * BITS, np.float64)
    for at in range(0, len(hashes), AT_ONCE):
        part = np.ascontiguousarray(hashes[at : at + AT_ONCE], "<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").astype(kind)
        sums += w[at : at + AT_ONCE].astype(kind) @ bits
    return np.packbits(2 * sums > total, bitorder="little").view("<u8")


def _fingerprints(size: int, seed: int, k: int, text_key: bool, columns: str):
    schema = arrow_schema(columns)

    def one(text: str) -> np.ndarray:
        found, weights = features(text, size)
        h = xxhash.xxh64_intdigest
        hashes = np.array([h(f, seed) for f in found], np.uint64)
        return majority(mixed(hashes, k), None if weights is None else np.array(weights)) if found else np.zeros(k, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            got = batch["text"].to_pylist()
            made = np.stack([one(t) for t in got]).view(np.int64)
            arrays = [batch["doc_id"], *[pa.array(np.ascontiguousarray(made[:, i])) for i in range(k)]]
            if text_key:
                arrays.append(pa.array([xxhash.xxh3_128_digest(t) for t in got], pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def fingerprints(docs: DataFrame, *, size: int = 3, seed: int = 42, k: int = 1, text_key: bool = False) -> DataFrame:
    """doc_id and k 64-bit fingerprints (as signed longs), fp0, fp1, ..., of k hashes; on demand text_key, a hash of the whole text."""
    columns = "doc_id long," + ",".join(f"fp{i} long" for i in range(k)) + ",text_key binary" * text_key
    return texts(docs).mapInArrow(_fingerprints(size, seed, k, text_key, columns), columns)


# The plan: partitions of bits and their thresholds


@dataclass
class Plan:
    """Bits of each partition, and within how many bits of it a probe looks; -1: not at all."""

    parts: list[list[int]]
    thresholds: list[int]
    cost: float


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and for bits i, j (i = j too) in how many both are set. Only sums are shuffled or collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS), np.int64), 0
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                v = np.asarray(batch["fp"].slice(at, AT_ONCE)).astype(np.int64).view(np.uint8).reshape(-1, 8)
                bits = np.unpackbits(v, axis=1, bitorder="little").astype(np.float32)
                both += (bits.T @ bits).astype(np.int64)  # exact: counts stay below 2^24
                n += len(bits)
        i, j = np.triu_indices(BITS)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([*i, BITS], pa.int32()), pa.array([*j, BITS], pa.int32()), pa.array([*both[i, j], n], pa.int64())], ["i", "j", "n"])

    sums = fps.select("fp").mapInArrow(run, "i int,j int,n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both, total = np.zeros((BITS, BITS), np.int64), 0
    for r in sums:
        if r["i"] == BITS:
            total = r["n"]
        else:
            both[r["i"], r["j"]] = both[r["j"], r["i"]] = r["n"]
    return total, both


def correlated_groups(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """The bits in m groups of near-equal size; each begins with the bit left that is most correlated and takes those most correlated with it."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, out = list(range(BITS)), []
    for k in range(m):
        size = len(left) // (m - k)
        own = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(own[0])
        while len(own) < size:
            best = max(left, key=lambda b: (corr[b, own].sum(), -b))
            own.append(best)
            left.remove(best)
        out.append(sorted(own))
    return out


def chance_within(n: int, both: np.ndarray, part: list[int]) -> list[float]:
    """P(two fingerprints differ in at most t bits of the part), t = 0, 1, ...: a beta-binomial with the mean and variance that the pair counts give."""
    w, n = len(part), max(n, 1)
    p = np.diag(both)[part] / n
    p11 = both[np.ix_(part, part)] / n
    p10, p01 = p[:, None] - p11, p[None, :] - p11
    p00 = 1 - p11 - p10 - p01
    joint = 2 * (p11 * p00 + p10 * p01)
    differ = 2 * p * (1 - p)
    mean = differ.sum()
    np.fill_diagonal(joint, differ)
    variance = joint.sum() - mean**2
    q = min(max(mean / w, 1e-9), 1 - 1e-9)
    rho = max((variance / (w * q * (1 - q)) - 1) / max(w - 1, 1), 1e-6)
    a, b = q * (1 / rho - 1), (1 - q) * (1 / rho - 1)
    beta = lambda x, y: math.lgamma(x) + math.lgamma(y) - math.lgamma(x + y)
    density = [math.exp(math.lgamma(w + 1) - math.lgamma(k + 1) - math.lgamma(w - k + 1) + beta(k + a, w - k + b) - beta(a, b)) for k in range(w + 1)]
    return np.cumsum(density).tolist()


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds from -1 that sum to ``total`` at the least cost, by dynamic programming over the partitions.

    ``costs[i][t + 1]`` is the cost of threshold t in partition i.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for t, c in enumerate(row, -1):
                if spent + t not in after or cost + c < after[spent + t][0]:
                    after[spent + t] = cost + c, [*chosen, t]
        best = after
    return best[total]


def make_plan(n: int, both: np.ndarray, radius: int) -> Plan:
    """The cheapest plan for all fingerprints within ``radius`` bits.

    With m partitions, thresholds that sum to radius - m + 1 are enough: if two fingerprints differed in more than
    t bits of each partition, they would differ in more than radius bits in all. The cost of a threshold is
    that of the keys it makes, and of the candidates that it is estimated to bring together. Few fingerprints favour more, narrow partitions; many favour wide ones that are probed.
    """
    best = None
    for m in range(1, radius + 3):
        parts = correlated_groups(n, both, m)
        costs = []
        for part in parts:
            near = chance_within(n, both, part)
            keys = [sum(math.comb(len(part), k) for k in range(t + 1)) for t in range(radius + 1)]
            costs.append([0.0, *[n * (KEY_COST * (keys[t] + bool(t)) + PAIR_COST * n * near[t] / 2) for t in range(radius + 1)]])
        cost, thresholds = allocate(costs, radius - m + 1)
        if best is None or cost < best.cost:
            best = Plan(parts, thresholds, cost)
    return best


# Search


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _mask(bits) -> int:
    return _signed(sum(1 << b for b in bits))


def _ball(part: list[int], t: int) -> list[int]:
    return [_mask(c) for k in range(t + 1) for c in combinations(part, k)]


def pairs_within(fps: DataFrame, radius: int, plan: Plan, of: int | None = None, made: list[DataFrame] | None = None) -> DataFrame:
    """Links (a, b) between the ``rep`` of distinct fingerprints ``fp``: they join exactly those fingerprints that a chain of steps of ``radius`` bits at most joins.

    Each fingerprint is indexed by its bits in each partition, and probes all values within the threshold;
    pairs that meet are verified. Values that too many share aren't compared in pairs: the fingerprints that
    have or probe one are linked through balls, each under all keys within radius / 2 bits of it, rounded up. Two are
    within the radius if and only if the ball of one and the inner ball (rounded down) of the other meet, so
    each need only be linked with the least whose inner ball holds the key. ``made`` gets the tables that the links are read from.
    """
    used = [(i, p, t) for i, (p, t) in enumerate(zip(plan.parts, plan.thresholds, strict=True)) if t >= 0]
    key = lambda i, v: F.struct(F.lit(i).alias("part"), v.alias("value"))
    index = fps.select("fp", "rep", F.explode(F.array(*[key(i, F.col("fp").bitwiseAND(F.lit(_mask(p)))) for i, p, _ in used])).alias("k"))
    index = index.select("fp", "rep", "k.part", "k.value")
    sizes = index.groupBy("part", "value").agg(F.count("*").alias("n"))
    probed = [(i, p, t) for i, p, t in used if t > 0]
    if probed:
        flips = F.array(*[F.struct(F.lit(i).alias("part"), F.lit(_mask(p)).alias("mask"), F.lit(x).alias("flip")) for i, p, t in used for x in _ball(p, t)])
        probe = fps.select("fp", "rep", F.explode(flips).alias("k")).select("fp", "rep", "k.part", F.col("fp").bitwiseAND(F.col("k.mask")).bitwiseXOR(F.col("k.flip")).alias("value"))
        shared = materialise(sizes, "keys", of=of)
    else:
        probe, shared = index, materialise(sizes.where("n > 1"), "keys", of=of)
    few, many = shared.where(F.col("n") <= CROWD).select("part", "value"), shared.where(F.col("n") > CROWD).select("part", "value")
    left = probe.join(few, ["part", "value"]).alias("l")
    right = index.join(few, ["part", "value"]).alias("r")
    near = F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp"))) <= radius
    met = left.join(right, ["part", "value"]).where((F.col("l.rep") != F.col("r.rep")) & near)
    met = met.select(F.least("l.rep", "r.rep").alias("a"), F.greatest("l.rep", "r.rep").alias("b")).distinct()
    crowd = probe.join(many, ["part", "value"], "left_semi").select("fp", "rep").distinct()
    ball = F.array(*map(F.lit, _ball(list(range(BITS)), -(-radius // 2))))
    centre = F.transform(ball, lambda x: F.struct(x.bitwiseXOR(F.col("fp")).alias("centre"), (F.bit_count(x) <= radius // 2).alias("inner")))
    keyed = materialise(crowd.select("rep", F.inline(centre)), "balls", of=of)
    least = keyed.groupBy("centre").agg(F.min(F.when(F.col("inner"), F.col("rep"))).alias("least"), F.count("*").alias("n")).where("n > 1 and least is not null")
    stars = keyed.join(least, "centre").where("rep <> least").select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct()
    if made is not None:
        made += [shared, keyed]
    return met.unionByName(stars)


def link_fingerprints(fps: DataFrame, radius: int, made: list[DataFrame] | None = None) -> DataFrame:
    """Links between the reps of distinct fingerprints, after making the plan."""
    n, both = bit_statistics(fps)
    return pairs_within(fps, radius, make_plan(n, both, radius), n, made)


def near_duplicates(docs: DataFrame, *, size: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """Each document's fingerprint and component: doc_id, fp, component_id, the least doc_id that links reach.

    Documents with equal fingerprints are one node from the start, so thousands of copies make one row. A null
    or empty text has fingerprint 0, linked like any other. Rows with one doc_id may have different texts; each
    row has its own component. Rows with a null doc_id are linked too; the least is taken among others, and is
    null only where there are none. An empty table gives no rows. Other columns don't matter.
    """
    own = materialise(fingerprints(docs, size=size, seed=seed).select("doc_id", F.col("fp0").alias("fp")), "fingerprints")
    of = own.count()
    nodes = own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    # A fingerprint is its own name in links, so that rows that share a doc_id stay apart.
    distinct = materialise(nodes.select("fp", F.col("fp").alias("rep"), "least", "rows"), "nodes", of=of)
    parts = connected_components(link_fingerprints(distinct.select("fp", "rep"), radius), of)
    linked = distinct.join(parts, F.col("fp") == F.col("node"))
    least = linked.groupBy("component").agg(F.min("least").alias("component_least"))
    moved = linked.join(least, "component").select("fp", F.col("component_least"))
    named = distinct.join(moved, "fp", "left").select("fp", F.coalesce("component_least", "least").alias("component_id"), "rows")
    return spread_join(own, materialise(named, "named", of=of), "fp", of).select("doc_id", "fp", "component_id")


# Verified near-duplicates


def shingle_set(text: str, size: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    return np.unique(np.array([xxhash.xxh64_intdigest(f, 7) for f in features(text, size)[0]], np.uint64))


def _digest(hashes: np.ndarray) -> int:
    return _signed(xxhash.xxh3_64_intdigest(hashes.tobytes()))


def frequent_shingles(docs: DataFrame, size: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles that are frequent in a sample of the texts, in order, and their ranks (the length of the count in bits).

    They only decide in which order a set is read, so a poor sample makes searches slower, never wrong.
    """
    step = min(max(count // SAMPLE, 1), SAMPLE_STEP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, SHINGLE_BYTES):
            found = np.concatenate([shingle_set(t, size) for t in batch["text"].to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["h"])

    sample = texts(docs).where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0)
    counts = sample.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    rows = counts.orderBy(F.desc("n"), "h").limit(FREQUENT_AT_MOST).toPandas()
    h, rank = rows["h"].to_numpy(np.int64).view(np.uint64), np.frexp(rows["n"].to_numpy(np.float64))[1].astype(np.int64)
    order = np.argsort(h)
    return h[order], rank[order]


def prefix(hashes: np.ndarray, similarity: float, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The rarest hashes of a set, as many that any set of this similarity has one of them in its own prefix."""
    known, ranks = frequent
    rank = np.zeros(len(hashes), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        rank = np.where(known[at] == hashes, ranks[at], 0)
    return hashes[np.lexsort((hashes, rank))[: len(hashes) - math.ceil(similarity * len(hashes) - EPS) + 1]] if len(hashes) else hashes


def sketch(hashes: np.ndarray, words: int) -> np.ndarray:
    """Of each of words * 64 classes of hashes, whether the set has an odd number: where two sketches differ, one set has what the other lacks."""
    odd = np.bincount((hashes % np.uint64(words * BITS)).astype(np.int64), minlength=words * BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


_SKETCH = [f"s{i}" for i in range(SKETCH)]


def _prefixes(size: int, similarity: float, frequent: tuple[np.ndarray, np.ndarray], columns: str):
    schema = arrow_schema(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, SHINGLE_BYTES):
            sets = [shingle_set(t, size) for t in batch["text"].to_pylist()]
            drawn = np.stack([sketch(s, SKETCH) for s in sets])
            wide = [sketch(s, max(SKETCH, 1 << max(len(s) - 1, 0).bit_length() - 6) if len(s) > BITS else SKETCH) for s in sets]
            fps = np.concatenate([majority(s[:, None]) if len(s) else np.zeros(1, np.uint64) for s in sets]).view(np.int64)
            made = [[_digest(s) for s in sets], [len(s) for s in sets], fps, [prefix(s, similarity, frequent).tobytes() for s in sets], *[np.ascontiguousarray(drawn[:, i]) for i in range(SKETCH)], wide]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_key"], *[pa.array(c, t.type) for c, t in zip(made, list(schema)[2:], strict=True)]], schema=schema)

    return run


def _keys(k: int):
    """A row for each hash of a prefix, with n, its place, and whether it is among the k that lead (the least of another hash): 31 bits, 32 bits and one of ``about``."""
    schema = arrow_schema("key long,node long,about long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = [np.frombuffer(x, np.uint64) for x in batch["prefix"].to_pylist()]
            if not sum(map(len, sets)):
                continue
            lead = []
            for s in sets:
                low = mixed(s, 2)[:, 1]
                lead.append(low <= np.partition(low, k - 1)[k - 1] if len(s) > k else np.ones(len(s), bool))
            times = np.array([len(s) for s in sets])
            about = np.repeat(np.asarray(batch["n"]), times) << 33 | np.concatenate([np.arange(t) for t in times]) << 1 | np.concatenate(lead)
            columns = [np.concatenate(sets).view(np.int64), np.repeat(np.asarray(batch["node"]), times), about]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    return run


def _shingle_sets(size: int):
    schema = arrow_schema("node long,hashes binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, SHINGLE_BYTES):
            sets = [shingle_set(t, size) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], schema=schema)

    return run


def _similar(least: float):
    """Of rows (a, b, hashes) sorted by a and b, that of a itself (b is null) first: the links (a, b) whose sets are similar."""
    schema = arrow_schema("a long,b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            for a, b, s in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), batch["hashes"].to_pylist(), strict=True):
                y = np.frombuffer(s, np.uint64)
                if b is None:
                    x = y
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both / (len(x) + len(y) - both) >= least:
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in (0, 1)], schema=schema)

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and text_key, a hash of the text: with the id it names a row, up to equal rows."""
    return texts(docs).withColumn("text_key", F.xxhash64("text"))


def _needed(similarity: float) -> Column:
    """By how many shingles two sets l, r may differ at most."""
    return (1 - similarity) / (1 + similarity) * (F.col("l.n") + F.col("r.n")) + EPS


def may_be_equal_enough(similarity: float) -> Column:
    """Of two sets l, r: sizes and sketches allow the similarity. It holds for all pairs that are similar."""
    apart = sum((F.bit_count(F.col(f"l.{c}").bitwiseXOR(F.col(f"r.{c}"))) for c in _SKETCH[1:]), F.bit_count(F.col("l.s0").bitwiseXOR(F.col("r.s0"))))
    return (F.least("l.n", "r.n") >= similarity * F.greatest("l.n", "r.n") - EPS) & (apart <= _needed(similarity))


def may_be_similar(similarity: float) -> Column:
    """Of two rows l, r of one key: moreover the hashes from their places on allow it. For the first hash that two similar sets share it holds."""
    rest = F.least(F.col("l.n") - F.col("l.at"), F.col("r.n") - F.col("r.at"))
    need = similarity / (1 + similarity) * (F.col("l.n") + F.col("r.n")) - EPS
    return (rest >= need) & may_be_equal_enough(similarity)


def verified(docs: DataFrame, nodes: DataFrame, links: DataFrame, size: int, similarity: float, of: int) -> tuple[DataFrame, DataFrame]:
    """Of links (a, b) between sets those that are similar, and the table of sets that they are found with. A set is sent once for each of its links from a lesser one, and once for its own."""
    involved = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    named = materialise(nodes.join(involved, "node", "left_semi").select(F.col("least.doc_id").alias("id"), F.col("least.text_key").alias("key")), "named", of=of)
    few = F.broadcast(named) if named.count() <= FEW_IDS else named
    rows = _keyed(docs).join(few, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")), "left_semi")
    sets = materialise(rows.mapInArrow(_shingle_sets(size), "node long,hashes binary").groupBy("node").agg(F.max("hashes").alias("hashes")), "shingles", of=of)
    ends = links.join(sets, F.col("b") == F.col("node")).select("a", "b", "hashes")
    heads = sets.join(links.select(F.col("a").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "hashes")
    ordered = ends.unionByName(heads).repartition("a").sortWithinPartitions("a", F.col("b").asc_nulls_first())
    discard(named)
    return ordered.mapInArrow(_similar(similarity), "a long,b long"), sets


def pairs_of_keys(shared: DataFrame, similarity: float, of: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between nodes of different components that share a key and may be similar, and the table they come from; of (key, node, n, at, component, sketch).

    The members of a key's largest component are only compared with the others there, so a crowd that is one component but for
    a few costs as many comparisons as it has members for each of these. Keys with many rows are dealt to several tasks.
    """
    parts = shared.groupBy("key", "component").agg(F.count("*").alias("m"))
    keys = parts.groupBy("key").agg(F.max(F.struct("m", "component")).alias("most"), F.count("*").alias("parts"), F.sum("m").alias("rows")).where("parts > 1")
    keys = keys.select("key", F.col("most.component").alias("largest"), F.ceil(F.col("rows") / SALT).cast("int").alias("salts"))
    open_ = materialise(shared.join(keys, "key"), "open", of=of)
    left = open_.where("component <> largest").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")).alias("l")
    right = open_.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).alias("r")
    once = (F.col("r.component") == F.col("r.largest")) | (F.col("l.component") < F.col("r.component"))
    met = left.join(right, ["key", "salt"]).where((F.col("l.component") != F.col("r.component")) & once & may_be_similar(similarity))
    return met.select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")).distinct(), open_


def _folded(wide: Column, to: Column) -> Column:
    """A sketch of the length of ``to``, where it is twice as long: the halves, one over the other, are the sketch of half the length."""
    half = F.size(to)
    return F.when(F.size(wide) > half, F.zip_with(F.slice(wide, 1, half), F.slice(wide, half + 1, half), lambda x, y: x.bitwiseXOR(y))).otherwise(wide)


def screened(links: DataFrame, nodes: DataFrame, similarity: float, parts: DataFrame | None = None) -> DataFrame:
    """Of links (a, b) between nodes those that sizes and wide sketches allow, and that ``parts`` (node, component) don't join already. Sizes that allow it differ by less than a factor of 2, and so do sketches by one folding at most."""
    about = nodes.select("node", "n", "wide")
    alike = F.least("l.n", "r.n") >= similarity * F.greatest("l.n", "r.n") - EPS
    if parts is not None:
        about = about.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
        alike = alike & (F.col("l.component") != F.col("r.component"))
    left = links.join(about.alias("l"), F.col("a") == F.col("l.node"))
    both = left.join(about.alias("r"), F.col("b") == F.col("r.node")).where(alike)
    x, y = F.col("l.wide"), F.col("r.wide")
    apart = F.aggregate(F.zip_with(_folded(x, y), _folded(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, k: n + k)
    return both.where(apart <= _needed(similarity)).select("a", "b")


def neighbours(keys: DataFrame, similarity: float) -> DataFrame:
    """Of the rows (key, node, about) of keys that several nodes have: those of crowded keys (more than three rows), and those with ``others`` that may be similar.

    Under each key a row looks at the two before it, in an order of the key's own. Under a key of two or three rows these are all pairs; under a crowded one
    only leading keys look, which bounds the links of a node (and places, which only the first shared hash must pass, don't matter). One shuffle of narrow rows.
    """
    order = Window.partitionBy("key").orderBy(F.xxhash64("key", "node"), "node")
    seen = {i: F.lag(F.struct("node", "about"), i).over(order) if i > 0 else F.lead("node", -i).over(order) for i in (1, 2, 3, -1, -2, -3)}
    rows = keys.select("*", *[c.alias(f"x{i + 3}") for i, c in seen.items()])
    there = {i: F.col(f"x{i + 3}").isNotNull() for i in seen}
    rows = rows.where(there[1] | there[-1])
    size, place = (lambda c: F.shiftright(c, 33)), (lambda c: F.shiftright(c, 1).bitwiseAND(0xFFFFFFFF))
    rows = rows.withColumns({"n": size(F.col("about")), "at": place(F.col("about")), "lead": F.col("about") % 2 == 1})
    crowded = there[3] | there[-3] | (there[1] & there[-2]) | (there[2] & there[-1])

    def near(i: int) -> Column:
        n, at = size(F.col(f"x{i + 3}.about")), place(F.col(f"x{i + 3}.about"))
        sizes = F.least("n", n) >= similarity * F.greatest("n", n) - EPS
        rest = F.least(F.col("n") - F.col("at"), n - at) >= similarity / (1 + similarity) * (F.col("n") + n) - EPS
        return F.when(there[i] & sizes & F.when(F.col("crowded"), F.col("lead")).otherwise(rest), F.col(f"x{i + 3}.node"))

    out = rows.withColumn("crowded", crowded).select("key", "node", "n", "at", "crowded", F.array_compact(F.array(near(1), near(2))).alias("others"))
    return out.where(F.col("crowded") | (F.size("others") > 0))


def components_by_fingerprints(docs: DataFrame, nodes: DataFrame, size: int, similarity: float, radius: int, of: int) -> DataFrame:
    """node and component, by the operator's search: nodes with one fingerprint, and those with fingerprints within ``radius`` bits (the plan's partitions and thresholds, probes, verification), are candidates; a link is each of them whose sets are similar."""
    fps = materialise(nodes.groupBy("fp").agg(F.min("node").alias("rep")), "simhashes", of=of)
    made = [fps]
    same = nodes.select("fp", "node").join(fps, "fp").where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    near = materialise(screened(link_fingerprints(fps, radius, made).unionByName(same).distinct(), nodes, similarity), "near", of=of)
    discard(*made)
    found, sets = verified(docs, nodes, near, size, similarity, of)
    parts = connected_components(found, of)
    discard(near, sets)
    return parts


def _joined(parts: DataFrame, links: DataFrame, of: int) -> DataFrame:
    """The components ``parts`` after further links."""
    return connected_components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links), of)


def _similar_sets(docs: DataFrame, k: int, size: int, similarity: float, radius: int) -> tuple[DataFrame, DataFrame]:
    """Two tables: doc_id, text_key and node of each row; and of each node (set of shingles) its component, least row and number of rows."""
    columns = "doc_id long,text_key long,node long,n long,fp long,prefix binary," + ",".join(f"{c} long" for c in _SKETCH) + ",wide array<long>"
    of = docs.count()
    read = materialise(_keyed(docs).mapInArrow(_prefixes(size, similarity, frequent_shingles(docs, size, of), columns), columns), "prefixes")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("least")
    nodes = materialise(read.groupBy("node").agg(*[F.max(c).alias(c) for c in ("n", "fp", "prefix", *_SKETCH, "wide")], least, F.count("*").alias("rows")), "nodes", of=of)
    own = materialise(read.select("doc_id", "text_key", "node"), "rows")
    discard(read)
    near = components_by_fingerprints(docs, nodes, size, similarity, radius, of)
    keys = nodes.select("node", "n", "prefix").mapInArrow(_keys(k), "key long,node long,about long")
    shared = materialise(neighbours(keys, similarity), "keys", of=of)
    met = shared.select("node", F.explode("others").alias("other")).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    tried = materialise(screened(met, nodes, similarity, near), "tried", of=of)
    found, sets = verified(docs, nodes, tried, size, similarity, of)
    parts = _joined(near, found, of)
    discard(near, tried, sets)
    about = nodes.select("node", *_SKETCH).join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    left, open_ = pairs_of_keys(shared.where("crowded").select("key", "node", "n", "at").join(about, "node"), similarity, of)
    close = materialise(screened(left, nodes, similarity), "close", of=of)
    discard(shared, open_)
    more, sets = verified(docs, nodes, close, size, similarity, of)
    before, parts = parts, _joined(parts, more, of)
    discard(before, close, sets)
    placed = materialise(nodes.select("node", "least", "rows").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed", of=of)
    discard(parts, nodes)
    first = placed.groupBy("component").agg(F.min("least").alias("first"))
    return own, placed.join(first, "component")


def similar_documents(docs: DataFrame, *, k: int = 8, size: int = 5, similarity: float = 0.8, radius: int = 2) -> DataFrame:
    """Each document and its component: doc_id, component_id, the least doc_id that links reach; links join texts whose sets of ``size``-word shingles have a Jaccard similarity of ``similarity`` or more.

    Equal sets are one node from the start. First the nodes' SimHash fingerprints within ``radius`` bits are searched, by the partitions and
    thresholds of ``make_plan``, and each pair found is verified by its sets. Similar sets may have fingerprints farther apart, so
    an exact search follows for pairs that this hasn't joined, and no link is missed: two such sets share a shingle among the first
    (1 - similarity) of each, rare ones first, so these are the keys (prefix filter), with filters on sizes, places and sketches; each pair is
    verified. So that crowds of copies don't cost all their pairs, under a crowded key a node is first verified against two neighbours, and this
    under ``k`` of its keys; pairs are then made only between nodes that aren't yet in one component. ``k`` and ``radius`` change the cost, never the result.
    Nulls, repeated rows and empty tables are as in ``near_duplicates``.
    """
    own, placed = _similar_sets(docs, k, size, similarity, radius)
    named = placed.select("node", F.col("first.doc_id").alias("component_id"), "rows")
    return spread_join(own, named, "node", own.count()).select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, *, k: int = 8, size: int = 5, similarity: float = 0.8, radius: int = 2) -> DataFrame:
    """All columns of ``docs``; of each component of ``similar_documents`` one row stays, that with the least doc_id (then the least hash of its text).

    A row is named by its doc_id and its text, so rows that share an id but not a text are judged apart. Of rows equal in both one
    stays. A row with a null doc_id stays only where no row of its component has one. The names of rows that go are broadcast if they are few, which is counted;
    else the join shuffles.
    """
    own, placed = _similar_sets(docs, k, size, similarity, radius)
    name, key, mark = (fresh(n, docs.columns) for n in ("gone_id", "gone_key", "again"))
    judged = spread_join(own, placed.select("node", "first", "rows"), "node", own.count())
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    gone = materialise(judged.where(~stays).select(F.col("doc_id").alias(name), F.col("text_key").alias(key)).distinct(), "gone", of=own.count())
    again = own.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias(name), F.col("text_key").alias(key))
    repeats = not again.isEmpty()
    own_id, own_key = F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit("")))
    same = own_id.eqNullSafe(F.col(name)) & (own_key == F.col(key))
    few = lambda t: F.broadcast(t) if t.count() <= FEW_IDS else t
    kept = docs.join(few(gone), same, "left_anti")
    if not repeats:
        discard(own)
        return kept
    again = materialise(again, "again")
    discard(own)
    repeated = kept.join(few(again), same, "left_semi").withColumn(mark, F.row_number().over(Window.partitionBy(own_id, own_key).orderBy(F.lit(1)))).where(F.col(mark) == 1)
    return kept.join(few(again), same, "left_anti").unionByName(repeated.drop(mark))


#: Names of rows up to which they are broadcast: 16 bytes each.
FEW_IDS = 1_000_000


def hexadecimal(fp: Column) -> Column:
    """16 lower-case digits of the unsigned fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
