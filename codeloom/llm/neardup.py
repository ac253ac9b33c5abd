"""Near-duplicate records with small edits (problem 2).

Method: chosen-path join. Texts with the same canonical key and the same set of runs form one
class; classes are split on sampled shared tokens (min-hash positions of their sets), each of
the ROOT_RUNS independent runs taking another position. A node with at most BRUTE_FORCE
members is compared pair by pair; a larger one is split again, on CHILD_SPLITS positions that
are neither a root's nor another split's, down to DEPTH splits. What is still large then goes to an exact prefix-filter join
(rarest tokens of each set), so no bucket is ever cut short. Pairs of small nodes pass a
sketch, two bits of the min-hash of every position, and are then verified exactly on the texts.

Recall: a pair with similarity s shares a root node with probability 1 - (1 - s) ** ROOT_RUNS,
that is 0.999994 at the threshold of 0.7, more above it. RUNS_PER_GROUP runs share their split
positions, groups share none, so that a pair whose tokens are all hot is missed with the
probability of ``miss``: 6.7e-6 after one split and 7.5e-6 after two, at the threshold. The
sketch turns away a pair at the threshold with a probability of ``sketch_miss`` (fewer than
SKETCH_AGREE of the positions equal, each equal with 0.775), which keeps all of it at TARGET_RECALL,
and lets about one in 37,000 unrelated pairs through.

Skew: copies are joined as one class first. A node with more than BRUTE_FORCE members in one
batch is known to be large: its rows are spread over salts and one row per batch tells the
other holders, so that no task gets all rows of a hot token.

Defined cases: null, empty and short texts have no runs and take part in no pair; copies
under the canonical key are no pair; repeated rows appear as members of their class; ids are
unique per table and below 2 ** 59, extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.canon import canonical_json, canonical_text, key_of, keys_sql, plain_key
from codeloom.llm.shingles import list_array, mix, run_sets, slices
from codeloom.llm.spots import bit_filter, hits, pick, spot
from codeloom.plans.durable import forget, persist_table
from codeloom.sources.tables import table

WORDS = 3
#: Similarity threshold as a fraction, compared in whole numbers.
SHARE, OF = 7, 10
TARGET_RECALL = 0.99999
ROOT_RUNS = math.ceil(math.log(1 - TARGET_RECALL) / math.log(1 - SHARE / OF))
DEPTH = 2
RUNS_PER_GROUP = 2
GROUPS = ROOT_RUNS // RUNS_PER_GROUP
BRUTE_FORCE = 600
#: Parts that the rows of a hot node are spread over.
SALTS = 1024
#: A class or row is named by id * TABLES + rec.
TABLES = 16


def miss(similarity: float, splits: int, child_splits: int) -> float:
    """Probability that a pair meets in no node after so many splits of every node it shares."""
    apart = 1 - similarity
    return (1 - (1 - apart**RUNS_PER_GROUP) * (1 - apart**child_splits) ** splits) ** GROUPS


def sketch_miss(similarity: float, agree: int, positions: int) -> float:
    """Probability that a pair's sketches agree at fewer than ``agree`` positions."""
    equal = similarity + (1 - similarity) / 4
    return sum(math.comb(positions, k) * equal**k * (1 - equal) ** (positions - k) for k in range(agree))


#: The fewest splits that keep TARGET_RECALL for a pair at the threshold whose tokens are all hot.
CHILD_SPLITS = next(k for k in range(1, 64) if miss(SHARE / OF, DEPTH, k) < 1 - TARGET_RECALL)
CHILD_POSITIONS = DEPTH * GROUPS * CHILD_SPLITS
POSITIONS = ROOT_RUNS + CHILD_POSITIONS
#: The most positions that a pair's sketches must agree at and still keep TARGET_RECALL.
SKETCH_AGREE = max(
    k for k in range(POSITIONS) if miss(SHARE / OF, DEPTH, CHILD_SPLITS) + sketch_miss(SHARE / OF, k, POSITIONS) <= 1 - TARGET_RECALL
)
#: Numbers in a row of min-hashes: 32 bits for a root position, 16 for a split position.
MINS = ROOT_RUNS + -(-CHILD_POSITIONS // 2)

_FACTORS = mix(np.arange(1, POSITIONS + 1, dtype=np.uint64)) | np.uint64(1)
_TERMS = mix(np.arange(1001, 1001 + POSITIONS, dtype=np.uint64))
#: Positions in each half of a sketch, two bits each.
HALF = 32
assert POSITIONS <= 2 * HALF

SKETCH = ("sketch_1", "sketch_2")
FEATURES = "key long, c1 long, c2 long, n int, sid long, mins array<int>, sketch_1 long, sketch_2 long"


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text, plain) to (key, c1, c2, text), two hashes of the canonical key, of the texts that have one."""
    for batch in batches:
        keys = list(map(key_of, *(batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))))
        own = batch.filter(pa.array([x is not None for x in keys], pa.bool_()))
        hashes = b"".join(xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in keys if x is not None)
        c1, c2 = np.frombuffer(hashes, np.int64).reshape(-1, 2).T
        yield pa.RecordBatch.from_arrays([own.column(0), pa.array(c1), pa.array(c2), own.column(1)], names=["key", "c1", "c2", "text"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text: size and identity of its set, a sketch, a min-hash at every position."""
    for whole in batches:
        for batch in slices(whole):
            runs, counts = run_sets(batch.column(3), WORDS)
            has = counts > 0
            if not has.any():
                continue
            starts = (np.cumsum(counts) - counts)[has]
            identity = np.add.reduceat(mix(runs), starts)
            mins = np.zeros((len(starts), MINS), np.int32)
            split = mins[:, ROOT_RUNS:].view(np.uint16)
            sketch = np.zeros((2, len(starts)), np.uint64)
            for p in range(POSITIONS):
                low = np.minimum.reduceat(runs * _FACTORS[p] + _TERMS[p], starts)
                mixed = mix(low)
                if p < ROOT_RUNS:
                    mins[:, p] = (low >> np.uint64(32)).astype(np.uint32).view(np.int32)
                else:
                    split[:, p - ROOT_RUNS] = mixed >> np.uint64(48)
                sketch[p // HALF] |= (mixed & np.uint64(3)) << np.uint64(2 * (p % HALF))
            keep = pa.array(has)
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).filter(keep) for i in range(3)]
                + [
                    pa.array(counts[has].astype(np.int32)),
                    pa.array(identity.view(np.int64)),
                    list_array(mins.ravel(), np.full(len(starts), MINS)),
                ]
                + [pa.array(part.view(np.int64)) for part in sketch],
                names=["key", "c1", "c2", "n", "sid", "mins", *SKETCH],
            )


def features(texts: DataFrame) -> DataFrame:
    """FEATURES of (key, text) rows that have a run and a canonical key.

    The plain rule is applied here only to texts that are not ASCII, as their letters are the JVM's to tell.
    """
    plain = F.when(F.octet_length("text") > F.length("text"), plain_key(F.col("text")))
    return texts.select("key", "text", plain.alias("plain")).mapInArrow(lambda batches: _features(_named(batches)), FEATURES)


NODES = "node long, salt int, key long, at int, n int, sketch_1 long, sketch_2 long"


def _salted(nodes: np.ndarray, keys: np.ndarray, at: np.ndarray, n: np.ndarray, sketch: list[np.ndarray]) -> pa.RecordBatch:
    """NODES rows of one batch; hot nodes get salts and one row with key -1 and salt 0."""
    values, which, counts = np.unique(nodes, return_inverse=True, return_counts=True)
    hot = counts > BRUTE_FORCE
    salt = np.where(hot[which], 1 + (mix(keys.view(np.uint64)) % np.uint64(SALTS)).astype(np.int64), 0)
    extra = int(hot.sum())
    pad = np.zeros(extra, np.int64)
    columns = (
        np.concatenate([nodes, values[hot]]),
        np.concatenate([salt, pad]).astype(np.int32),
        np.concatenate([keys, pad - 1]),
        np.concatenate([at, pad]).astype(np.int32),
        np.concatenate([n, pad]).astype(np.int32),
        *(np.concatenate([part, pad]) for part in sketch),
    )
    return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["node", "salt", "key", "at", "n", *SKETCH])


def _mins(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy().reshape(-1, MINS)


def _roots(skip: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, n, mins, sketch, spot) to the nodes of every run; the table takes part in the node.

    Rows whose spot is in the filter give nothing, if there is one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if skip.value is not None:
                batch = batch.filter(pa.array(~hits(skip.value, batch.column(5).to_numpy())))
            if not batch.num_rows:
                continue
            mins = _mins(batch.column(2))[:, :ROOT_RUNS].astype(np.int64)
            key = np.repeat(batch.column(0).to_numpy(), ROOT_RUNS)
            at = np.tile(np.arange(ROOT_RUNS), len(mins))
            node = mix(mix(mins.ravel().view(np.uint64)) + (at + 100 * (key % TABLES)).astype(np.uint64)).view(np.int64)
            n, *sketch = (np.repeat(batch.column(i).to_numpy(), ROOT_RUNS) for i in (1, 3, 4))
            yield _salted(node, key, at, n, sketch)

    return run


def split_positions(depth: int) -> np.ndarray:
    """Split positions of each run's nodes that were split ``depth`` times, a row per run."""
    group = np.arange(ROOT_RUNS) // RUNS_PER_GROUP
    return ((depth * GROUPS + group) * CHILD_SPLITS)[:, None] + np.arange(CHILD_SPLITS)


def _children(depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(node, at, key, n, mins, sketch) of large nodes of run ``at`` to their splits."""
    positions = split_positions(depth)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node, at, key, n, *sketch = (np.repeat(batch.column(i).to_numpy(), CHILD_SPLITS) for i in (0, 1, 2, 3, 5, 6))
            where = positions[batch.column(1).to_numpy()]
            mins = np.ascontiguousarray(_mins(batch.column(4))[:, ROOT_RUNS:]).view(np.uint16)
            low = np.take_along_axis(mins, where, axis=1).ravel().astype(np.uint64)
            child = mix(mix(node.view(np.uint64) + where.ravel().astype(np.uint64)) + low).view(np.int64)
            yield _salted(child, key, at, n, sketch)

    return split


def _different(bits: np.ndarray) -> np.ndarray:
    """Two-bit groups that are not zero."""
    bits = bits.view(np.uint64)
    return np.bitwise_count((bits | bits >> np.uint64(1)) & np.uint64(0x5555555555555555)).astype(np.int64)


#: A candidate pair (a < b), or a row of a large node: its node and run in ``b`` and ``at``.
SCANNED = "a long, b long, at int"
PAIR = -1


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """NODES sorted by (node, salt): pairs of the small nodes, rows of the large ones.

    At most BRUTE_FORCE rows of a node are held; more make it large and pass on at once.
    """

    def finish(columns: list[np.ndarray], again: np.ndarray) -> pa.RecordBatch:
        node, salt, key, at, n, *sketch = columns
        starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.empty(0, np.int64)
        sizes = np.diff(np.concatenate([starts, [len(node)]])).astype(np.int64)
        run = np.repeat(np.arange(len(starts)), sizes)
        told = np.zeros(len(starts), bool)
        np.logical_or.at(told, run, (key < 0) | (salt > 0) | again)
        large = (told | (sizes > BRUTE_FORCE))[run]
        a, b = [], []
        small = np.flatnonzero(~large)
        step, left = 1, small[sizes[run[small]] > 1]
        while len(left):
            left = left[left + step < len(node)]
            left = left[run[left + step] == run[left]]
            if not len(left):
                break
            x, y = left, left + step
            least, most = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
            equal = POSITIONS - sum(_different(part[x] ^ part[y]) for part in sketch)
            fits = (OF * least >= SHARE * most) & (equal >= SKETCH_AGREE) & (key[x] != key[y])
            a.append(np.minimum(key[x], key[y])[fits])
            b.append(np.maximum(key[x], key[y])[fits])
            step += 1
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1) if a else np.empty((2, 0), np.int64)
        out = np.flatnonzero(large & (key >= 0))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([pairs[0], key[out]])),
                pa.array(np.concatenate([pairs[1], node[out]])),
                pa.array(np.concatenate([np.full(pairs.shape[1], PAIR), at[out]]).astype(np.int32)),
            ],
            names=["a", "b", "at"],
        )

    held: list[np.ndarray] | None = None
    passed: int | None = None  # a node whose first rows went on as large ones
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [column.to_numpy() for column in batch.columns]
        if held is not None:
            rows = [np.concatenate([h, r]) for h, r in zip(held, rows, strict=True)]
        node = rows[0]
        last = int(np.searchsorted(node, node[-1]))
        goes_on = len(node) - last > BRUTE_FORCE
        cut = len(node) if goes_on else last
        again = node[:cut] == passed if passed is not None else np.zeros(cut, bool)
        yield finish([r[:cut] for r in rows], again)
        if goes_on:
            passed, held = int(node[-1]), None
        else:
            held = [r[last:] for r in rows]
    if held is not None:
        again = held[0] == passed if passed is not None else np.zeros(len(held[0]), bool)
        yield finish(held, again)


def _split(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, large rows, the saved table of both) of NODES rows, by one shuffle."""
    found = persist_table(
        nodes.repartition("node", "salt").sortWithinPartitions("node", "salt").mapInArrow(_scan, SCANNED), "nodes"
    )
    pairs = found.where(F.col("at") == PAIR).select("a", "b")
    return pairs, found.where(F.col("at") != PAIR).select(F.col("a").alias("key"), F.col("b").alias("node"), "at"), found


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole):
            runs, counts = run_sets(batch.column(1), WORDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), list_array(runs.view(np.int64), counts)], names=["key", "runs"])


def _size_fits(a: Column, b: Column) -> Column:
    return OF * F.least(a, b) >= SHARE * F.greatest(a, b)


def prefix_candidates(sets: DataFrame) -> DataFrame:
    """Exact candidates (a, b) among (key, runs): pairs that share one of their rarest runs.

    Two sets that are similar enough share at least one of the n - ceil(0.7 n) + 1 rarest
    runs of either, in any order common to both.
    """
    rec = F.pmod("key", F.lit(TABLES)).alias("rec")
    each = sets.select(rec, "key", F.size("runs").alias("n"), F.explode("runs").alias("run"))
    counts = each.groupBy("rec", "run").agg(F.count(F.lit(1)).alias("df"))
    ranked = (
        each.join(counts, ["rec", "run"])
        .groupBy("rec", "key", "n")
        .agg(F.array_sort(F.collect_list(F.struct("df", "run"))).alias("order"))
    )
    kept = F.col("n") - F.ceil(F.col("n") * SHARE / OF) + 1
    heads = ranked.select("rec", "key", "n", F.explode(F.slice("order", F.lit(1), kept.cast("int"))).alias("e")).select(
        "rec", "key", "n", F.col("e.run").alias("run")
    )
    a, b = heads.alias("a"), heads.alias("b")
    on = (F.col("a.rec") == F.col("b.rec")) & (F.col("a.run") == F.col("b.run")) & (F.col("a.key") < F.col("b.key"))
    return a.join(b, on).where(_size_fits(F.col("a.n"), F.col("b.n"))).select(F.col("a.key").alias("a"), F.col("b.key").alias("b"))


def texts_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """At least the (key, text) rows of the wanted keys, without moving the others."""
    return pick(texts.select("key", "text"), ("key",), bit_filter(wanted, "key"))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, text_a, text_b) to the pairs that are similar and no copies of each other."""
    for whole in batches:
        for batch in slices(whole):
            left, n_left = run_sets(batch.column(2), WORDS)
            right, n_right = run_sets(batch.column(3), WORDS)
            shift = np.uint64(52)
            tag = lambda runs, n: (np.repeat(np.arange(len(n)), n).astype(np.uint64) << shift) | runs
            both = np.intersect1d(tag(left, n_left), tag(right, n_right), assume_unique=True)
            shared = np.bincount((both >> shift).astype(np.int64), minlength=batch.num_rows)
            good = OF * shared >= SHARE * (n_left + n_right - shared)
            texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for i in np.flatnonzero(good):
                x, y = texts[0][i], texts[1][i]
                good[i] = (canonical_json(x) or canonical_text(x)) != (canonical_json(y) or canonical_text(y))
            yield batch.filter(pa.array(good)).select([0, 1])


def similar_classes(texts: DataFrame, found: DataFrame, copies: DataFrame) -> DataFrame:
    """(a, b), a < b, of similar classes by the chosen-path join.

    ``found`` has FEATURES of all rows; those in ``copies`` take no part. Rows that may be copies
    go through a join, all others start where they are. ``found`` and what is saved on the way are removed
    once they are no longer read.
    """
    columns = ("key", "n", "mins", *SKETCH)
    skip = bit_filter(copies, "key")
    context = texts.sparkSession.sparkContext
    again = pick(found.select(*columns), ("key",), skip).join(copies.select("key"), "key", "left_anti")
    own = found.select(*columns, spot("key")).mapInArrow(_roots(context.broadcast(skip)), NODES)
    pairs, large, saved_nodes = _split(own.unionByName(again.select(*columns, spot("key")).mapInArrow(_roots(context.broadcast(None)), NODES)))
    candidates, done = [pairs], [saved_nodes]
    for depth in range(DEPTH):
        if large.isEmpty():
            break
        rows = large.join(found.select(*columns), "key")
        pairs, large, saved_nodes = _split(rows.select("node", "at", *columns).mapInArrow(_children(depth), NODES))
        candidates.append(pairs)
        done.append(saved_nodes)
    if not large.isEmpty():
        rest = large.select("key").distinct()
        picked = texts_of(texts, rest).join(rest, "key").mapInArrow(_sets, "key long, runs array<long>")
        done.append(persist_table(picked, "rest"))
        candidates.append(prefix_candidates(done[-1]))
    joined = persist_table(reduce(DataFrame.unionByName, candidates).distinct(), "candidates")
    forget(*done, found)
    wanted = joined.select(F.col("a").alias("key")).unionAll(joined.select("b"))
    picked = persist_table(texts_of(texts, wanted), "texts")
    a = picked.select(F.col("key").alias("a"), F.col("text").alias("text_a"))
    b = picked.select(F.col("key").alias("b"), F.col("text").alias("text_b"))
    both = joined.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")
    pairs = persist_table(both.mapInArrow(_verify, "a long, b long"), "pairs")
    forget(joined, picked)
    return pairs


CLASS = ("c1", "c2", "sid", "n", "rec")


def near_duplicates(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, copies) of (key, text) rows.

    pairs: (a, b) between the classes of different texts; a class has the key of its row with
    the smallest id. copies: (key, cls) of every other row of a class.
    """
    found = persist_table(features(texts).withColumn("rec", F.pmod("key", F.lit(TABLES))), "features")
    classes = found.groupBy(*CLASS).agg(F.min("key").alias("cls"), F.count(F.lit(1)).alias("size"))
    several = persist_table(classes.where("size > 1").drop("size"), "classes")
    keys = pick(found.select(*CLASS, "key"), CLASS, bit_filter(several, *CLASS))
    copies = persist_table(keys.join(several, list(CLASS)).where("key <> cls").select("key", "cls"), "copies")
    forget(several)
    return similar_classes(texts, found, copies), copies


#: The tables of the problem: number in ``rec``, name, key column, text column.
SNIPPETS = ((0, "feedback", "id", "original_code"), (1, "optimization_candidate", "candidate_id", "optimized_code"))


def snippets(spark: SparkSession, directory: str) -> DataFrame:
    """(key, text) of both tables."""
    parts = [
        table(spark, directory, name).select((F.col(key) * TABLES + rec).alias("key"), F.col(text).alias("text"))
        for rec, name, key, text in SNIPPETS
    ]
    return parts[0].unionByName(parts[1])


def _rec_table(key: str) -> Column:
    return F.when(F.pmod(key, F.lit(TABLES)) == 0, SNIPPETS[0][1]).otherwise(SNIPPETS[1][1]).alias("rec_table")


def _id(key: str) -> Column:
    return F.shiftright(key, TABLES.bit_length() - 1)


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    """Row pairs: the class pairs with every member of either class, as the problem asks."""
    pairs, copies = near_duplicates(snippets(spark, directory))
    ends = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    members = persist_table(
        copies.join(ends, "cls").select("cls", "key").unionByName(ends.select("cls", F.col("cls").alias("key"))), "members"
    )
    a = members.select(F.col("cls").alias("a"), F.col("key").alias("x"))
    b = members.select(F.col("cls").alias("b"), F.col("key").alias("y"))
    rows = pairs.join(a, "a").join(b, "b")
    return rows.select(_rec_table("x"), _id("x").alias("x"), _id("y").alias("y")).select(
        "rec_table", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")
    )


def p2_links(spark: SparkSession, directory: str) -> DataFrame:
    """One row per document with a link or a copy: its class and the classes linked to that."""
    pairs, copies = near_duplicates(snippets(spark, directory))
    ends = pairs.select(F.col("a").alias("cls")).unionAll(pairs.select("b"))
    links = ends.groupBy("cls").agg(F.count(F.lit(1)).alias("n_links"))
    members = copies.select("key", "cls").unionAll(copies.select("cls", "cls")).unionAll(ends.select("cls", "cls")).distinct()
    return members.join(links, "cls", "left").select(
        _rec_table("key"),
        _id("key").alias("id"),
        _id("cls").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


QUERIES = {"p2_found": p2_found, "p2_links": p2_links}

# All pairs that share a run, without copies.
_PAIRS = keys_sql("SELECT 'feedback' AS rec_table, id, original_code AS x FROM feedback UNION ALL SELECT 'optimization_candidate', candidate_id, optimized_code FROM optimization_candidate") + r""",
         w AS (SELECT rec_table, id, regexp_extract_all(lower(x), '[\p{L}\p{N}_]+') AS ws FROM t WHERE x IS NOT NULL),
         r AS (SELECT DISTINCT rec_table, id, hash(ws[i], ws[i + 1], ws[i + 2]) AS run FROM (SELECT *, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
         n AS (SELECT rec_table, id, count(*) AS n FROM r GROUP BY 1, 2),
         s AS (SELECT a.rec_table, a.id AS id_a, b.id AS id_b, count(*) AS n FROM r a JOIN r b ON a.rec_table = b.rec_table AND a.run = b.run AND a.id < b.id GROUP BY 1, 2, 3)
    SELECT s.rec_table, id_a, id_b FROM s JOIN n a ON a.rec_table = s.rec_table AND a.id = id_a JOIN n b ON b.rec_table = s.rec_table AND b.id = id_b
    JOIN k x ON x.rec_table = s.rec_table AND x.id = id_a JOIN k y ON y.rec_table = s.rec_table AND y.id = id_b
    WHERE 10 * s.n >= 7 * (a.n + b.n - s.n) AND x.canon <> y.canon"""

ORACLES = {"p2_found": _PAIRS}
