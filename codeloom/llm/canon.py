"""Copies hidden by formatting differences (problem 3).

Two texts are copies if their canonical keys are equal. The key of a plain text is the text
lower-cased, without every character that is not a letter, a digit or an operator sign. The
key of a text that is a JSON object as a whole lists its fields, at any depth, sorted by
canonical name, with canonical string values, so that field order and layout don't matter.

Method: canonical records are range-partitioned and sorted by (key, id); each partition is
scanned once, adjacent full keys compared. The id is part of the sort key, so a key that
holds a third of all rows spreads over as many partitions as its size asks for, and only the
runs at partition boundaries, at most two per partition, are matched up afterwards.

Defined cases: null texts and texts without a letter or digit have no key and are left out;
repeated rows and ties fall to the smallest id; extra columns are ignored; empty tables give
empty results; texts are compared whole, however long.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.plans.durable import persist_table
from codeloom.sources.tables import table

# Fixed value: the operator signs that count in a comparison, beside letters and digits.
SIGNS = r"+\-*/%<>=!&|^~@"
KEPT_SIGNS = SIGNS.replace("\\", "")
DROPPED = rf"[^\p{{L}}\p{{N}}{SIGNS}]+"
_DROPPED_PY = re.compile(rf"[^\w{SIGNS}]+|_+")

#: What is trimmed off a JSON object.
JSON_SPACE = "\ufeff \t\r\n"
#: Starts of a key: a JSON object's sorts apart from plain text, and no plain key has it.
JSON_MARK = "{"


#: The plain rule for ASCII texts, as tables of bytes.
_LOWER = bytes(range(256)).lower()
_DROPPED_ASCII = bytes(c for c in range(128) if _DROPPED_PY.match(chr(c)))


def canonical_text(text: str) -> str:
    """The plain rule, as the column expression plain_key applies it."""
    if text.isascii():
        return text.encode().translate(_LOWER, _DROPPED_ASCII).decode()
    return _DROPPED_PY.sub("", text.lower())


def _canonical_value(value: object) -> str:
    if isinstance(value, str):
        return '"' + canonical_text(value)
    if isinstance(value, _Fields):
        return "{" + ",".join(sorted(f"{canonical_text(k)}:{_canonical_value(v)}" for k, v in value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_canonical_value, value)) + "]"
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    return json.dumps(value)


class _Fields(list):
    """The fields of a JSON object, repeated names included."""


def canonical_json(text: str) -> str | None:
    """Key of a text that is a JSON object as a whole, None for any other.

    An object nested too deeply for the parser (hundreds of levels) counts as plain text.
    """
    try:
        value = json.loads(text.strip(JSON_SPACE), object_pairs_hook=_Fields)
        return JSON_MARK + _canonical_value(value) if isinstance(value, _Fields) else None
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def _json_key(texts):
    return texts.map(lambda x: None if x is None else canonical_json(x))


def plain_key(text: F.Column) -> F.Column:
    """The plain rule on a text column, whether or not a letter or digit is left."""
    return F.regexp_replace(F.lower(text), DROPPED, "")


def canonical_key(text: F.Column) -> F.Column:
    """Canonical key of a text column; null where there is nothing to compare.

    Only texts that begin and end like an object reach Python; the rest stays in the JVM.
    """
    bare = F.btrim(text, F.lit(JSON_SPACE))
    shaped = F.when(bare.startswith("{") & bare.endswith("}"), text)
    plain = plain_key(text)
    return F.when(plain.rlike(r"[\p{L}\p{N}]"), F.coalesce(_json_key(shaped), plain))


def key_of(text: str | None, plain: str | None) -> str | None:
    """canonical_key of one text, of which ``plain`` is the plain_key; it may be null if the text is ASCII."""
    if text is None:
        return None
    if plain is None:
        plain = canonical_text(text)
    # What the plain rule keeps besides the signs are letters and digits.
    if not plain.strip(KEPT_SIGNS):
        return None
    bare = text.strip(JSON_SPACE)
    return (canonical_json(bare) if bare.startswith("{") and bare.endswith("}") else None) or plain


def keyed_records(records: DataFrame, key: str, text: str) -> DataFrame:
    """(id, canon) of the rows that have something to compare."""
    records = records.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return records.select("id", canonical_key(F.col("text")).alias("canon")).where("canon IS NOT NULL")


SCAN_SCHEMA = "rec int, id long, head long, part int, kind int, canon string"
COPY, OPENING, EDGE = 0, 1, 2


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sorted partition of (rec, canon, id): adjacent full keys are compared.

    COPY rows repeat the key before them; ``head`` is the first id of their run. OPENING rows
    belong to the partition's first run, which may have begun in an earlier partition. Two
    EDGE rows tell the first and the last run's key and head.
    """
    part = TaskContext.get().partitionId()
    last, head, run, first = None, None, 0, None

    def rows(rec, ids, heads, kind, canon=None):
        n = len(ids)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(rec, pa.int32()),
                pa.array(ids, pa.int64()),
                pa.array(heads, pa.int64()),
                pa.array(np.full(n, part), pa.int32()),
                pa.array(np.full(n, kind), pa.int32()),
                pa.array(canon if canon is not None else [None] * n, pa.string()),
            ],
            names=["rec", "id", "head", "part", "kind", "canon"],
        )

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        recs, keys = batch.column(0), batch.column(1)
        rec, ids = recs.to_numpy(), batch.column(2).to_numpy()
        starts = np.ones(n, bool)
        if n > 1:
            starts[1:] = pc.or_(pc.not_equal(keys[1:], keys[:-1]), pc.not_equal(recs[1:], recs[:-1])).to_numpy(
                zero_copy_only=False
            )
        here = (int(rec[0]), keys[0].as_py())
        starts[0] = here != last
        if first is None:
            first = (*here, int(ids[0]))
        which = np.cumsum(starts)
        heads = np.concatenate([[ids[0] if head is None else head], ids[starts]])[which]
        opening = which + run == 1
        copies = ~opening & ~starts
        for mask, kind in ((opening, OPENING), (copies, COPY)):
            if mask.any():
                yield rows(rec[mask], ids[mask], heads[mask], kind)
        last, head, run = (int(rec[-1]), keys[n - 1].as_py()), int(heads[-1]), run + int(which[-1])
    if first is not None:
        yield rows([first[0], last[0]], [first[2], head], [first[2], head], EDGE, [first[1], last[1]])


def find_copies(keyed: DataFrame) -> DataFrame:
    """(rec, keep_id, copy_id) for (rec, id, canon) rows: every copy but the smallest id."""
    # Saved first: range partitioning reads its input twice, once to sample it.
    keyed = persist_table(keyed.select("rec", "canon", "id"), "keys")
    scanned = persist_table(
        keyed.repartitionByRange("rec", "canon", "id")
        .sortWithinPartitions("rec", "canon", "id")
        .mapInArrow(_scan, SCAN_SCHEMA),
        "copies",
    )
    edges = scanned.where(F.col("kind") == EDGE)
    heads = edges.groupBy("rec", "canon").agg(F.min("head").alias("keep"))
    # A run that opens a partition has its head where the run began; one row per partition.
    opened = edges.groupBy("part").agg(F.min(F.struct("rec", "canon", "id")).alias("first"))
    opened = opened.select("part", "first.rec", "first.canon").join(heads, ["rec", "canon"]).select("part", "keep")
    rows = scanned.where(F.col("kind") != EDGE)
    return (
        rows.where(F.col("kind") == COPY)
        .select("rec", F.col("head").alias("keep_id"), F.col("id").alias("copy_id"))
        .unionByName(
            rows.where(F.col("kind") == OPENING)
            .join(opened, "part")
            .where(F.col("id") != F.col("keep"))
            .select("rec", F.col("keep").alias("keep_id"), F.col("id").alias("copy_id"))
        )
    )


#: The tables of the problem: number in ``rec``, name, key column, text column.
SUBMISSIONS = ((0, "feedback", "id", "original_code"), (1, "optimization_request", "request_id", "code"))


def submissions(spark: SparkSession, directory: str) -> DataFrame:
    """(rec, id, canon) of both tables."""
    parts = [
        keyed_records(table(spark, directory, name), key, text).select(F.lit(rec).alias("rec"), "id", "canon")
        for rec, name, key, text in SUBMISSIONS
    ]
    return parts[0].unionByName(parts[1])


def _rec_table() -> F.Column:
    return F.when(F.col("rec") == 0, SUBMISSIONS[0][1]).otherwise(SUBMISSIONS[1][1]).alias("rec_table")


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    return find_copies(submissions(spark, directory)).select(_rec_table(), "keep_id", "copy_id")


def p3_representatives(spark: SparkSession, directory: str) -> DataFrame:
    """One row per record with copies: the representative and its exact number of copies."""
    found = find_copies(submissions(spark, directory))
    return found.groupBy("rec", "keep_id").agg((F.count(F.lit(1)) + 1).alias("n_copies")).select(
        _rec_table(), "keep_id", "n_copies"
    )


QUERIES = {"p3_found": p3_found, "p3_representatives": p3_representatives}


def _plain(x: str) -> str:
    return rf"regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}+*/%<>=!&|^~@-]', '', 'g')"


def keys_sql(tables: str) -> str:
    """CTEs: ``t`` (rec_table, id, x) as given and ``k`` (rec_table, id, canon), the keys of the texts that have one.

    The leaves of a JSON object with their canonical paths, sorted, stand for its fields in any order.
    """
    path, leaf = _plain("fullkey"), f"CASE WHEN e.type = 'VARCHAR' THEN '\"' || {_plain("e.atom->>'$'")} ELSE coalesce(e.atom::VARCHAR, e.type) END"
    bare = "trim(x, chr(65279) || ' ' || chr(9) || chr(13) || chr(10))"
    return f"""
    WITH t AS ({tables}),
         o AS (SELECT rec_table, id, {bare} AS j FROM t WHERE starts_with({bare}, '{{') AND json_valid({bare})),
         f AS (SELECT o.rec_table, o.id, '{{' || array_to_string(list_sort(list({path} || ':' || {leaf})), ',') AS canon FROM o, json_tree(o.j) AS e
               WHERE e.type NOT IN ('OBJECT', 'ARRAY') GROUP BY 1, 2),
         k AS (SELECT t.rec_table, t.id, coalesce(f.canon, {_plain('x')}) AS canon FROM t LEFT JOIN f USING (rec_table, id)
               WHERE regexp_matches({_plain('x')}, '[\\p{{L}}\\p{{N}}]'))"""


_COPIES = keys_sql("SELECT 'feedback' AS rec_table, id, original_code AS x FROM feedback UNION ALL SELECT 'optimization_request', request_id, code FROM optimization_request") + """,
         c AS (SELECT *, min(id) OVER (PARTITION BY rec_table, canon) AS keep_id FROM k)"""

ORACLES = {
    "p3_found": _COPIES + " SELECT rec_table, keep_id, id AS copy_id FROM c WHERE id <> keep_id",
    "p3_representatives": _COPIES + " SELECT rec_table, keep_id, count(*) AS n_copies FROM c GROUP BY 1, 2 HAVING count(*) > 1",
}
