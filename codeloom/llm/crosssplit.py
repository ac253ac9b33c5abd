"""Same or near-same records across splits (problem 5).

Method: weighted cosine join between the training side and the evaluation side. Each text is
a unit vector of term weights, the terms being its different three-word runs. Terms stand in
one order for all vectors, frequent ones first. A vector is indexed only from the term on at
which the norm of what precedes it (the residual) could reach the threshold; a pair below the
threshold on every common indexed term cannot reach it at all. Candidates are pruned by the
largest weights, accumulated over the inverted lists, pruned again with the residual norms,
and the survivors get exact dot products.

With equal weights a share of 7/10 common runs implies a cosine of at least 2 * 0.7 / 1.7, so
the join at that threshold loses no pair; the share itself is then checked exactly.

Frequent terms are found by counting within batches and adding up what is frequent in any of
them. That table orders terms only: no term, vector or pair is dropped by it.

Defined cases: null, empty and short texts have no terms and no pair; equal sets are joined
once as a class and expanded at the end; a split name other than train counts as evaluation
whatever its case, a null one belongs to neither side; extra columns are ignored.
"""

from __future__ import annotations


from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.shingles import list_array, mix, run_sets, slices
from codeloom.llm.spots import bit_filter, hits, pick, spot
from codeloom.plans.durable import forget, persist_table
from codeloom.sources.tables import table

WORDS = 3
SHARE, OF = 7, 10
COSINE = 2 * SHARE / (OF + SHARE)

#: A term in this share of a batch's texts is frequent there; at most FREQUENT_TERMS of them,
#: the most frequent ones, are sent to every task (1 MB) to order terms.
FREQUENT_SHARE = 0.0005
FREQUENT_TERMS = 50_000

TRAIN, EVALUATION = 1, 2
FIELDS = ("original", "optimized")
VECTORS = "field int, id long, side int, sid long, n int, terms array<long>"


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, side, texts of FIELDS) to one row per text that has terms."""
    for whole in batches:
        for batch in slices(whole):
            for field in range(len(FIELDS)):
                runs, counts = run_sets(batch.column(2 + field), WORDS)
                has = counts > 0
                if not has.any():
                    continue
                keep, own = pa.array(has), counts[has]
                identity = np.add.reduceat(mix(runs), np.cumsum(own) - own)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(own), field, np.int32)),
                        batch.column(0).filter(keep),
                        batch.column(1).filter(keep),
                        pa.array(identity.view(np.int64)),
                        pa.array(own.astype(np.int32)),
                        list_array(runs.view(np.int64), own),
                    ],
                    names=["field", "id", "side", "sid", "n", "terms"],
                )


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms, counts = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
        often = counts >= max(2, FREQUENT_SHARE * batch.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array(terms[often]), pa.array(counts[often])], names=["term", "df"])


def frequent_terms(vectors: DataFrame) -> DataFrame:
    """(term, df) of the terms that are frequent in some batch; df counts those batches."""
    found = vectors.select("terms").mapInArrow(_frequent, "term long, df long")
    return found.groupBy("term").agg(F.sum("df").alias("df")).orderBy(F.desc("df"), "term").limit(FREQUENT_TERMS)


def _indexed(frequent: tuple[np.ndarray, np.ndarray], cosine: float, skip: np.ndarray | None):
    """mapInArrow function: the indexed part of (field, cid, spot, terms[, weights]) vectors.

    One row per indexed term: its weight in the unit vector, the residual norm of all terms
    before it, and the vector's largest weight and weight sum for the bound by maximum weights.
    Without weights all are 1. Vectors whose spot is in ``skip`` give nothing. Numbers are rounded to
    32 bits, which SLACK makes up for.
    """
    terms, ranks = frequent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if skip is not None:
                batch = batch.filter(pa.array(~hits(skip, batch.column(2).to_numpy())))
            if not batch.num_rows:
                continue
            lists = batch.column(3)
            flat = lists.flatten().to_numpy()
            weights = batch.column(4).flatten().to_numpy() if batch.num_columns > 4 else np.ones(len(flat))
            counts = pc.list_value_length(lists).to_numpy().astype(np.int64)
            rows = np.repeat(np.arange(batch.num_rows), counts)
            at = np.searchsorted(terms, flat)
            at[at == len(terms)] = 0
            known = terms[at] == flat if len(terms) else np.zeros(len(flat), bool)
            rank = np.where(known, ranks[at] if len(terms) else 0, np.iinfo(np.int64).max)
            order = np.lexsort((flat, rank, rows))
            flat, weights = flat[order], weights[order]
            starts = np.cumsum(counts) - counts
            norm = np.sqrt(np.add.reduceat(weights * weights, starts))
            unit = weights / np.repeat(norm, counts)
            passed = np.cumsum(unit * unit)
            upto = passed - np.repeat(passed[starts] - unit[starts] ** 2, counts)
            index = upto >= cosine * cosine - 1e-9
            residual = np.sqrt(np.maximum(upto - unit * unit, 0))
            largest, total = np.maximum.reduceat(unit, starts), np.add.reduceat(unit, starts)
            own = rows[index]
            take = pa.array(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(flat[index])]
                + [pa.array(x.astype(np.float32)) for x in (unit[index], residual[index], largest[own], total[own])],
                names=["field", "cid", "term", "w", "residual", "largest", "total"],
            )

    return run


INDEXED = "field int, cid long, term long, w float, residual float, largest float, total float"
#: What rounding to 32 bits may take from a sum of products, far above it.
SLACK = 1e-4


def weighted_cosine_pairs(vectors: DataFrame, frequent: DataFrame, cosine: float = COSINE, copies: DataFrame | None = None) -> DataFrame:
    """(field, x, y, cosine, shared, nx, ny): vector x of the training side and y of the evaluation
    side with at least ``cosine``, their common terms and the terms of either.

    ``vectors`` has (field, cid, sides, terms) and perhaps weights: positive weights of different
    terms; the bits of ``sides`` tell the sides a vector has rows on. ``copies`` may tell of equal
    vectors: (field, cid, cls, sides) of each; then only the one that names its class takes part,
    with the sides of its class.
    """
    top = frequent.toArrow()
    terms = top.column("term").to_numpy().astype(np.int64)
    order = np.argsort(terms)
    context = vectors.sparkSession.sparkContext
    shared = context.broadcast((terms[order], order.astype(np.int64)))
    has_weights = ["weights"] if "weights" in vectors.columns else []
    skip = bit_filter(copies, "field", "cid") if copies is not None else None
    skipped = context.broadcast(skip)
    plain = ["field", "cid", "sides", "terms", *has_weights]

    def lists(rows: DataFrame, side: int, leave: bool) -> DataFrame:
        def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _indexed(shared.value, cosine, skipped.value if leave else None)(batches)

        own = rows.where(F.col("sides").bitwiseAND(side) != 0)
        return own.select("field", "cid", spot("field", "cid"), "terms", *has_weights).mapInArrow(index, INDEXED)

    vectors = vectors.select(*plain)
    if copies is None:
        train, held = lists(vectors, TRAIN, False), lists(vectors, EVALUATION, False)
    else:
        # Vectors that may have copies go through a join, all others are indexed where they are.
        told = copies.select("field", "cid", "cls", F.col("sides").alias("all_sides"))
        again = pick(vectors, ("field", "cid"), skip).join(told, ["field", "cid"], "left").where("cls IS NULL OR cls = cid")
        again = again.withColumn("sides", F.coalesce("all_sides", "sides")).select(*plain)
        train, held = (lists(vectors, side, True).unionByName(lists(again, side, False)) for side in (TRAIN, EVALUATION))
    train, held = train.alias("t"), held.alias("e")
    bound = F.least(F.col("t.largest") * F.col("e.total"), F.col("e.largest") * F.col("t.total"))
    dots = (
        train.join(held, (F.col("t.field") == F.col("e.field")) & (F.col("t.term") == F.col("e.term")))
        .where((bound >= cosine - SLACK) & (F.col("t.cid") != F.col("e.cid")))
        .groupBy(F.col("t.field").alias("field"), F.col("t.cid").alias("x"), F.col("e.cid").alias("y"))
        .agg(
            F.sum(F.col("t.w") * F.col("e.w")).alias("dot"),
            F.min(F.col("t.residual") * F.col("e.residual")).alias("rest"),
        )
    )
    # After the first common indexed term every common term is indexed in both vectors, so what
    # is missing from the sum stands before it, where the residual norms are smallest.
    pairs = persist_table(dots.where(F.col("dot") + F.col("rest") >= cosine - SLACK).select("field", "x", "y"), "dots")
    wanted = pairs.select("field", F.col("x").alias("cid")).unionAll(pairs.select("field", "y"))
    terms_of = pick(vectors.select("field", "cid", "terms", *has_weights), ("field", "cid"), bit_filter(wanted, "field", "cid"))
    x = terms_of.select("field", F.col("cid").alias("x"), F.col("terms").alias("tx"), *[F.col(w).alias("wx") for w in has_weights])
    y = terms_of.select("field", F.col("cid").alias("y"), F.col("terms").alias("ty"), *[F.col(w).alias("wy") for w in has_weights])
    both = pairs.join(x, ["field", "x"]).join(y, ["field", "y"])
    return both.select("field", "x", "y", "tx", "ty", *[w for own in has_weights for w in ("wx", "wy")]).mapInArrow(_exact(cosine), EXACT)


EXACT = "field int, x long, y long, cosine double, shared int, nx int, ny int"


def _exact(cosine: float):
    """mapInArrow function: exact dot products of (field, x, y, tx, ty[, wx, wy]), by merging sorted terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                n, sides = batch.num_rows, []
                for at in (3, 4):
                    lists = batch.column(at)
                    counts = pc.list_value_length(lists).to_numpy().astype(np.int64)
                    rows, flat = np.repeat(np.arange(n), counts), lists.flatten().to_numpy()
                    weights = batch.column(at + 2).flatten().to_numpy() if batch.num_columns > 5 else np.ones(len(flat))
                    sides.append((counts, rows, flat, weights, np.bincount(rows, weights * weights, n)))
                (nx, rx, fx, wx, sx), (ny, ry, fy, wy, sy) = sides
                # Terms as numbers of the batch, so that a row and a term make one key.
                known, number = np.unique(np.concatenate([fx, fy]), return_inverse=True)
                kx, ky = rx * len(known) + number[: len(fx)], ry * len(known) + number[len(fx) :]
                _, ix, iy = np.intersect1d(kx, ky, assume_unique=True, return_indices=True)
                dot = np.bincount(rx[ix], wx[ix] * wy[iy], n)
                told = dot / np.sqrt(np.maximum(sx * sy, 1e-300))
                common = np.bincount(rx[ix], minlength=n)
                keep = told >= cosine - 1e-9
                columns = [pa.array(c[keep].astype(np.int32)) for c in (common, nx, ny)]
                kept = batch.filter(pa.array(keep))
                yield pa.RecordBatch.from_arrays(
                    [kept.column(0), kept.column(1), kept.column(2), pa.array(told[keep]), *columns],
                    names=["field", "x", "y", "cosine", "shared", "nx", "ny"],
                )

    return run


def class_pairs(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, copies) of (id, split_name, *FIELDS) rows.

    pairs: (field, x, y) of classes of equal sets, x with rows in train and y with rows in another
    split; a class has the least id of its rows. copies: (field, cid, side, cls, sides) of all
    rows of the classes with several.
    """
    name = F.lower(F.trim("split_name"))
    side = F.when(name == "train", TRAIN).otherwise(EVALUATION).cast("int")
    vectors = persist_table(
        records.where("split_name IS NOT NULL")
        .select("id", side.alias("side"), *FIELDS)
        .mapInArrow(_vectors, VECTORS),
        "vectors",
    )
    key = ["field", "sid", "n"]
    classes = vectors.groupBy(*key).agg(F.min("id").alias("cls"), F.bit_or("side").alias("sides"), F.count(F.lit(1)).alias("size"))
    several = persist_table(classes.where("size > 1").drop("size"), "classes")
    keys = pick(vectors.select(*key, "id", "side"), tuple(key), bit_filter(several, *key))
    copies = persist_table(keys.join(several, key).select("field", F.col("id").alias("cid"), "side", "cls", "sides"), "copies")
    own = vectors.select("field", F.col("id").alias("cid"), F.col("side").alias("sides"), "terms")
    near = weighted_cosine_pairs(own, frequent_terms(vectors), copies=copies)
    near = near.where(OF * F.col("shared") >= SHARE * (F.col("nx") + F.col("ny") - F.col("shared"))).select("field", "x", "y")
    same = several.where(F.col("sides") == TRAIN + EVALUATION).select("field", F.col("cls").alias("x"), F.col("cls").alias("y"))
    pairs = persist_table(near.unionByName(same), "pairs")
    forget(vectors, several)
    return pairs, copies


def _members(pairs: DataFrame, copies: DataFrame, end: str, side: int, name: str) -> DataFrame:
    """``pairs`` with ``name``, a row for every row of the class ``end`` on a side."""
    own = copies.where(F.col("side") == side).select("field", F.col("cls").alias(end), F.col("cid").alias(name))
    return pairs.join(own, ["field", end], "left").withColumn(name, F.coalesce(name, end))


def cross_split_pairs(records: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of (id, split_name, *FIELDS) rows: one in train, one not."""
    pairs, copies = class_pairs(records)
    rows = _members(_members(pairs, copies, "x", TRAIN, "a"), copies, "y", EVALUATION, "b")
    return rows.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()


def leaked_rows(records: DataFrame) -> DataFrame:
    """(id) of the evaluation rows with a partner in train: class members, no row pairs."""
    pairs, copies = class_pairs(records)
    ends = pairs.select("field", "y").distinct()
    return _members(ends, copies, "y", EVALUATION, "id").select("id").distinct()


def _records(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "simple_dataset_generator").select(
        F.col("example_id").alias("id"), "split_name", *FIELDS
    )


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    return cross_split_pairs(_records(spark, directory))


def p5_report(spark: SparkSession, directory: str) -> DataFrame:
    """Per evaluation split and source: rows, and rows that overlap with the training split."""
    rows = table(spark, directory, "simple_dataset_generator").select(
        F.col("example_id").alias("id"), F.lower(F.trim("split_name")).alias("split_name"), "source"
    )
    hit = leaked_rows(_records(spark, directory)).withColumn("hit", F.lit(1))
    return (
        rows.where("split_name <> 'train'")
        .join(hit, "id", "left")
        .groupBy("split_name", "source")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count("hit").alias("n_leaked"))
    )


QUERIES = {"p5_found": p5_found, "p5_report": p5_report}

_PAIRS = r"""
    WITH w AS (SELECT example_id AS id, lower(trim(split_name)) = 'train' AS train, f,
                      regexp_extract_all(lower(CASE f WHEN 0 THEN original ELSE optimized END), '[\p{L}\p{N}_]+') AS ws
               FROM simple_dataset_generator, (SELECT unnest([0, 1]) AS f) WHERE split_name IS NOT NULL),
         r AS (SELECT DISTINCT id, train, f, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS run
               FROM (SELECT *, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
         n AS (SELECT id, f, count(*) AS n FROM r GROUP BY 1, 2),
         s AS (SELECT a.id AS x, b.id AS y, a.f, count(*) AS k FROM r a JOIN r b ON a.f = b.f AND a.run = b.run AND a.train AND NOT b.train GROUP BY 1, 2, 3),
         p AS (SELECT DISTINCT least(x, y) AS id_a, greatest(x, y) AS id_b FROM s JOIN n a ON a.id = x AND a.f = s.f JOIN n b ON b.id = y AND b.f = s.f
               WHERE 10 * k >= 7 * (a.n + b.n - k))"""

ORACLES = {
    "p5_found": _PAIRS + " SELECT id_a, id_b FROM p",
    "p5_report": _PAIRS
    + """
    , h AS (SELECT id_a AS id FROM p UNION SELECT id_b FROM p)
    SELECT lower(trim(split_name)) AS split_name, source, count(*) AS n_rows, count(h.id) AS n_leaked
    FROM simple_dataset_generator LEFT JOIN h ON h.id = example_id WHERE lower(trim(split_name)) <> 'train' GROUP BY 1, 2""",
}
