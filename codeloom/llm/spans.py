"""Long exact spans shared between records (problem 4).

Method: compact windows. The tokens of a text are its GRAM-character grams, hashed. The
Cartesian tree of those hashes groups all pieces of at least ``length`` characters by the gram
with the least hash in them: one compact window (left, centre, right) stands for all pieces
that start at or after ``left``, end at or before ``right`` and hold the centre. A piece that
stands verbatim in two records has the same least gram in both, so both have a window with
that signature, and one hash function is enough for exact spans. Windows whose signature
stands in one record only are dropped; the others are joined on their signature and the text
around the centres is compared character by character.

Skew: equal fields are joined once, as a class, before anything else. A signature with more
than PAIRWISE windows is not compared pair by pair: each of its pieces of ``length`` characters
is hashed twice, to 128 bits together, and grouped with map-side aggregation, which is linear in
the rows and gathers no group anywhere.

Defined cases: null, empty and short fields share nothing; a stretch repeated within one
record, or between the two solutions of one record, is not shared; repeated rows are records
of their own and share all of their text; positions count characters from 1; extra columns
are ignored; texts are searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.shingles import list_array, mix
from codeloom.plans.durable import persist_table
from codeloom.sources.tables import table

LENGTH = 120
GRAM = 48
#: Windows of one signature that are compared pair by pair, at most.
PAIRWISE = 48
#: Windows of one signature in one batch that make it hot, and the parts its rows are split into.
HOT = 64
SALTS = 1024
#: Characters hashed at once.
CHUNK = 4_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters of the texts as numbers, and where each text begins (and the end)."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return chars, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def gram_hashes(chars: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the ``k`` characters from each position on, by doubling."""
    level, size, power = mix(chars.astype(np.uint64) + np.uint64(1)), 1, _BASE
    out, done = None, 0
    while True:
        if k & size:
            if out is None:
                out, done = level.copy(), size
            else:
                n = len(chars) - done - size + 1
                if n <= 0:
                    return np.empty(0, np.uint64)
                # What is done so far stands in front; its hash moves up by this part's length.
                out = out[:n] * power + level[done : done + n]
                done += size
        if 2 * size > k:
            return mix(out) if out is not None else np.empty(0, np.uint64)
        n = len(level) - size
        if n <= 0:
            return np.empty(0, np.uint64)
        level = level[:n] * power + level[size : size + n]
        size, power = 2 * size, np.uint64(int(power) * int(power) & 0xFFFFFFFFFFFFFFFF)


def compact_windows(hashes: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """(left, centre, right) of every node of the Cartesian tree that spans ``width`` hashes.

    Of equal hashes the leftmost is the centre. Only the top of the tree is walked; a text
    whose tree is a mere chain (one gram over and over) is walked with a stack instead.
    """
    out: list[tuple[int, int, int]] = []
    todo = [(0, len(hashes) - 1)]
    limit = 64 + 16 * len(hashes) // width
    while todo:
        left, right = todo.pop()
        if right - left + 1 < width:
            continue
        centre = left + int(hashes[left : right + 1].argmin())
        out.append((left, centre, right))
        if len(out) > limit:
            return _windows_by_stack(hashes, width)
        todo.append((left, centre - 1))
        todo.append((centre + 1, right))
    return out


def _windows_by_stack(hashes: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    values, n = hashes.tolist(), len(hashes)
    left, right, stack = [0] * n, [n - 1] * n, []
    for i, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            right[stack.pop()] = i - 1
        left[i] = stack[-1] + 1 if stack else 0
        stack.append(i)
    return [(left[i], i, right[i]) for i in range(n) if right[i] - left[i] + 1 >= width]


def _pieces(texts: list[str]) -> Iterator[list[int]]:
    """Row numbers in groups of about CHUNK characters."""
    group, size = [], 0
    for i, t in enumerate(texts):
        group.append(i)
        size += len(t)
        if size > CHUNK:
            yield group
            group, size = [], 0
    if group:
        yield group


def _windows(length: int):
    """mapInArrow: (rec, field, text) to WINDOWS rows.

    A signature with HOT windows of several records in one batch is known to be shared. Its
    rows get a salt, and one row with centre -1 goes the common way for the batch, so that the
    other holders of the signature learn of it: no task gets a third of all rows for one key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = length - GRAM + 1
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for group in _pieces(texts):
                chars, begins = code_points([texts[i] for i in group])
                hashes = gram_hashes(chars, GRAM)
                own, centres = [], []
                for at in range(len(group)):
                    begin, size = int(begins[at]), int(begins[at + 1] - begins[at])
                    if size < length:
                        continue
                    found = compact_windows(hashes[begin : begin + size - GRAM + 1], width)
                    own.extend([at] * len(found))
                    centres.extend([begin + centre for _, centre, _ in found])
                at, places = np.array(own, np.int64), np.array(centres, np.int64)
                signs = hashes[places].view(np.int64) if len(places) else np.empty(0, np.int64)
                rows = np.array(group, np.int64)[at] if len(at) else at
                recs = batch.column(0).to_numpy()[rows]
                salt, extra = _salts(signs, recs)
                both = np.concatenate([np.arange(len(signs)), extra])
                centre = np.concatenate([places - begins[at], np.full(len(extra), -1)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signs[both]),
                        pa.array(np.concatenate([salt, np.zeros(len(extra))]).astype(np.int32)),
                        pa.array(recs[both]),
                        batch.column(1).take(pa.array(rows[both])),
                        pa.array(centre.astype(np.int32)),
                    ],
                    names=["sign", "salt", "rec", "field", "centre"],
                )

    return run


WINDOWS = "sign long, salt int, rec long, field int, centre int"


def _salts(signs: np.ndarray, recs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A salt for each window, 0 for those of no hot signature, and one row of each hot one."""
    salt = np.zeros(len(signs), np.int64)
    values, first, which, counts = np.unique(signs, return_index=True, return_inverse=True, return_counts=True)
    extra = []
    for hot in np.flatnonzero(counts >= HOT):
        rows = np.flatnonzero(which == hot)
        if (recs[rows] != recs[rows[0]]).any():
            salt[rows] = 1 + (mix(recs[rows].view(np.uint64)) % np.uint64(SALTS)).astype(np.int64)
            extra.append(first[hot])
            other = rows[recs[rows] != recs[rows[0]]][0]
            extra.append(other)
    return salt, np.array(extra, np.int64)


def _shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """WINDOWS sorted by (sign, salt) to (sign, rec, field, centre) of shared signatures.

    Rows are held only while their signature has shown one record, so what is held is bounded by
    one record's windows, however many rows a signature has.
    """

    def out(batch: pa.RecordBatch, keep: np.ndarray) -> pa.RecordBatch:
        keep = keep & (batch.column(4).to_numpy() >= 0)
        return batch.filter(pa.array(keep)).select(["sign", "rec", "field", "centre"])

    held: list[pa.RecordBatch] = []  # rows of one signature and one record
    passed: int | None = None  # a signature known to be shared
    for batch in batches:
        if not batch.num_rows:
            continue
        signs, recs = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], signs[1:] != signs[:-1]]))
        low, high = np.minimum.reduceat(recs, starts), np.maximum.reduceat(recs, starts)
        if held:
            if held[0].column(0)[0].as_py() == signs[0]:
                rec = held[0].column(2)[0].as_py()
                low[0], high[0] = min(low[0], rec), max(high[0], rec)
            if low[0] != high[0] or len(starts) > 1 or held[0].column(0)[0].as_py() != signs[0]:
                shared = held[0].column(0)[0].as_py() == signs[0] and low[0] != high[0]
                for part in held:
                    yield out(part, np.full(part.num_rows, shared) | (part.column(1).to_numpy() > 0))
                held = []
        several = (low != high) | (signs[starts] == passed if passed is not None else False)
        passed = int(signs[-1]) if several[-1] else None
        keep = np.repeat(several, np.diff(np.concatenate([starts, [len(signs)]])))
        end = len(signs)
        if not several[-1]:  # the last run may go on
            end = int(starts[-1])
            held.append(batch.slice(end))
        head = batch.slice(0, end)
        yield out(head, keep[:end] | (head.column(1).to_numpy() > 0))
    for part in held:
        yield out(part, part.column(1).to_numpy() > 0)


SHARED = "sign long, rec long, field int, centre int"


def _cut(length: int):
    """mapInArrow: a field and its kept windows to CUTS rows, the text around each centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = length - GRAM
        for batch in batches:
            out: list[list] = [[] for _ in _CUT_NAMES]
            for rec, field, lo, hi, text, signs, centres, many in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for sign, centre, often in zip(signs, centres, many, strict=True):
                    begin = max(0, centre - reach)
                    row = (sign, often, rec, field, lo, hi, centre, text[begin:centre], text[centre : centre + GRAM + reach])
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, _CUT_TYPES, strict=True)], names=_CUT_NAMES
            )

    return run


CUTS = (
    "sign long, many boolean, rec long, field int, lo long, hi long, centre int, before string, after string"
)
_CUT_NAMES = ["sign", "many", "rec", "field", "lo", "hi", "centre", "before", "after"]
_CUT_TYPES = [
    pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()
]


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] equal, a[:high] not
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def _compare(length: int):
    """mapInArrow over CUTS sorted by sign: SPANS of matches in other records.

    Runs of one sign have at most PAIRWISE rows; equal surroundings are compared once.
    """

    def matches(rows: list[tuple]) -> Iterator[tuple[int, int, int, int]]:
        groups: dict[tuple[str, str], list[tuple]] = {}
        for row in rows:
            groups.setdefault((row[7][::-1], row[8]), []).append(row)
        keys = list(groups)
        lows = [min(r[4] for r in groups[k]) for k in keys]
        highs = [max(r[5] for r in groups[k]) for k in keys]
        for i, (before, after) in enumerate(keys):
            spans = set()
            for j, (other_before, other_after) in enumerate(keys):
                left, right = (len(before), len(after)) if i == j else (_common(before, other_before), _common(after, other_after))
                if left + right >= length:
                    spans.add((left, right, lows[j], highs[j]))
            for row in groups[(before, after)]:
                for left, right, low, high in spans:
                    if row[4] != low or row[5] != high or low != high:
                        yield row[2], row[3], row[6] - left, row[6] + right - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_rows: list[tuple] = []
        for batch in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if open_rows and open_rows[-1][0] != row[0]:
                    found.extend(matches(open_rows))
                    open_rows = []
                open_rows.append(row)
            yield _spans_batch(found)
        yield _spans_batch(matches(open_rows) if open_rows else [])

    return run


SPANS = "rec long, field int, start int, stop int"


def _spans_batch(rows) -> pa.RecordBatch:
    unique = list(set(rows))
    columns = list(zip(*unique, strict=True)) if unique else [[]] * 4
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["rec", "field", "start", "stop"]
    )


def _hash_pieces(length: int):
    """mapInArrow over CUTS: PIECES, one row for every piece that holds the centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before, after = batch.column(7).to_pylist(), batch.column(8).to_pylist()
            chars, begins = code_points([x + y for x, y in zip(before, after, strict=True)])
            hashes, again = gram_hashes(chars, length), gram_hashes(chars ^ np.uint32(0x5BD1E995), length)
            sizes = np.diff(begins) - length + 1
            counts = np.maximum(sizes, 0)
            rows = np.repeat(np.arange(batch.num_rows), counts)
            offsets = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
            start = batch.column(6).to_numpy() - np.array([len(x) for x in before], np.int64)
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[begins[:-1][rows] + offsets].view(np.int64)) for h in (hashes, again)]
                + [batch.column(i).take(take) for i in (2, 3, 4, 5)]
                + [pa.array((start[rows] + offsets).astype(np.int32))],
                names=["piece", "piece_2", "rec", "field", "lo", "hi", "start"],
            )

    return run


PIECES = "piece long, piece_2 long, rec long, field int, lo long, hi long, start int"


def shared_spans(fields: DataFrame, length: int = LENGTH) -> DataFrame:
    """(rec, field, start_pos, end_pos) of (rec long, field int, text) rows.

    ``rec`` identifies the record, ``field`` its text field. One row per longest run of
    characters that lie in a piece of ``length`` that stands in another record.
    """
    fields = fields.where(F.length("text") >= length)
    keyed = persist_table(
        fields.select(
            "rec",
            "field",
            F.xxhash64("text").alias("t1"),
            F.xxhash64(F.lit("second"), "text").alias("t2"),
            F.length("text").alias("size"),
        ),
        "fields",
    )
    # Equal fields are one class; its least field stands for it, lo and hi bound its records.
    classes = keyed.groupBy("t1", "t2").agg(
        F.min("rec").alias("lo"), F.max("rec").alias("hi"), F.min(F.struct("rec", "field")).alias("at")
    )
    classes = persist_table(classes.select("t1", "t2", "lo", "hi", "at.rec", "at.field"), "classes")
    shared = persist_table(
        fields.select("rec", "field", "text")
        .mapInArrow(_windows(length), WINDOWS)
        .repartition("sign", "salt")
        .sortWithinPartitions("sign", "salt")
        .mapInArrow(_shared_only, SHARED),
        "windows",
    )
    # Signatures that several classes of different records hold; copies count once.
    own = shared.join(classes.select("rec", "field", "lo", "hi"), ["rec", "field"])
    signs = own.groupBy("sign").agg(
        F.min("lo").alias("low"),
        F.max("hi").alias("high"),
        F.min(F.struct("rec", "field")).alias("a"),
        F.max(F.struct("rec", "field")).alias("b"),
        F.count(F.lit(1)).alias("n"),
    )
    signs = signs.where("low <> high AND a <> b").select("sign", (F.col("n") > PAIRWISE).alias("many"))
    kept = (
        own.join(signs, "sign")
        .groupBy("rec", "field")
        .agg(
            F.first("lo").alias("lo"),
            F.first("hi").alias("hi"),
            F.collect_list(F.struct("sign", "centre", "many")).alias("at"),
        )
    )
    cuts = persist_table(
        fields.join(kept, ["rec", "field"])
        .select("rec", "field", "lo", "hi", "text", "at.sign", "at.centre", "at.many")
        .mapInArrow(_cut(length), CUTS),
        "cuts",
    )
    few = (
        cuts.where("NOT many")
        .repartition("sign")
        .sortWithinPartitions("sign")
        .mapInArrow(_compare(length), SPANS)
    )
    pieces = cuts.where("many").mapInArrow(_hash_pieces(length), PIECES)
    piece = ["piece", "piece_2"]
    common = pieces.groupBy(*piece).agg(F.min("lo").alias("low"), F.max("hi").alias("high")).where("low <> high")
    often = pieces.join(common.select(*piece), piece).select(
        "rec", "field", "start", (F.col("start") + length - 1).alias("stop")
    )
    found = few.unionByName(often).groupBy("rec", "field").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    classes = classes.join(found, ["rec", "field"], "left").where("lo <> hi OR spans IS NOT NULL")
    classes = classes.select("t1", "t2", F.when(F.col("lo") == F.col("hi"), _merge("spans")).alias("runs"))
    # A field that other records hold as a whole is shared from end to end.
    whole = F.array(F.struct(F.lit(0).alias("start"), (F.col("size") - 1).alias("stop")))
    return (
        keyed.join(classes, ["t1", "t2"])
        .select("rec", "field", F.explode(F.coalesce("runs", whole)).alias("run"))
        .select(
            "rec",
            "field",
            (F.col("run.start") + 1).cast("long").alias("start_pos"),
            (F.col("run.stop") + 1).cast("long").alias("end_pos"),
        )
    )


def _merge(spans: str) -> F.Column:
    """Sorted spans, those that touch or overlap joined into one."""
    empty = F.array().cast("array<struct<start:int,stop:int>>")

    def add(done, span):
        last = F.element_at(done, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["stop"], span["stop"]).alias("stop"))
        fits = (F.size(done) > 0) & (span["start"] <= F.get(done, F.size(done) - 1)["stop"] + 1)
        return F.when(fits, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(
            F.concat(done, F.array(span))
        )

    return F.aggregate(F.array_sort(spans), empty, add)


NAMES = ("naive_solution.code", "optimized_solution.code", "optimized_code")


def _code_fields(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """(fields, records): texts by record number, and the record numbers' tables and ids."""
    scraped = table(spark, directory, "dataset_scraper").select(
        F.lit("dataset_scraper").alias("rec_table"),
        F.col("problem_id").alias("rec_id"),
        # Even numbers for text ids (63 bits of a hash), odd ones for whole numbers, which stay exact.
        F.shiftleft(F.xxhash64("problem_id"), 1).alias("rec"),
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("field"), F.col("naive_solution.code").alias("text")),
                F.struct(F.lit(1).alias("field"), F.col("optimized_solution.code").alias("text")),
            )
        ).alias("f"),
    )
    candidates = table(spark, directory, "optimization_candidate").select(
        F.lit("optimization_candidate").alias("rec_table"),
        F.col("candidate_id").cast("string").alias("rec_id"),
        (F.shiftleft("candidate_id", 1) + 1).alias("rec"),
        F.lit(2).alias("field"),
        F.col("optimized_code").alias("text"),
    )
    both = scraped.select("rec_table", "rec_id", "rec", "f.field", "f.text").unionByName(candidates)
    both = both.where(F.length("text") >= LENGTH)
    return both.select("rec", "field", "text"), both.select("rec", "rec_table", "rec_id", "field")


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    fields, records = _code_fields(spark, directory)
    return (
        shared_spans(fields)
        .join(records, ["rec", "field"])
        .select("rec_table", "rec_id", F.element_at(F.array(*map(F.lit, NAMES)), F.col("field") + 1).alias("code_field"), "start_pos", "end_pos")
    )


def p4_shares(spark: SparkSession, directory: str) -> DataFrame:
    """Per record with shared text: characters in its code fields and how many are shared."""
    fields, records = _code_fields(spark, directory)
    spans = shared_spans(fields).groupBy("rec").agg(F.sum(F.col("end_pos") - F.col("start_pos") + 1).alias("n_shared"))
    sizes = fields.groupBy("rec").agg(F.sum(F.length("text")).alias("n_chars"))
    names = records.select("rec", "rec_table", "rec_id").distinct()
    return spans.join(sizes, "rec").join(names, "rec").select("rec_table", "rec_id", "n_chars", "n_shared")


QUERIES = {"p4_found": p4_found, "p4_shares": p4_shares}

_RUNS = f"""
    WITH t AS (SELECT 'dataset_scraper' AS rec_table, problem_id AS rec_id, '{NAMES[0]}' AS code_field, naive_solution.code AS x FROM dataset_scraper
               UNION ALL SELECT 'dataset_scraper', problem_id, '{NAMES[1]}', optimized_solution.code FROM dataset_scraper
               UNION ALL SELECT 'optimization_candidate', candidate_id::VARCHAR, '{NAMES[2]}', optimized_code FROM optimization_candidate),
         g AS (SELECT rec_table, rec_id, code_field, s, md5(substr(x, s, {LENGTH})) AS piece
               FROM (SELECT *, unnest(range(1, length(x) - {LENGTH} + 2)) AS s FROM t WHERE length(x) >= {LENGTH})),
         c AS (SELECT piece FROM g GROUP BY 1 HAVING count(DISTINCT (rec_table, rec_id)) > 1),
         m AS (SELECT g.*, CASE WHEN s <= lag(s) OVER w + {LENGTH} THEN 0 ELSE 1 END AS fresh FROM g JOIN c USING (piece)
               WINDOW w AS (PARTITION BY rec_table, rec_id, code_field ORDER BY s)),
         i AS (SELECT *, sum(fresh) OVER (PARTITION BY rec_table, rec_id, code_field ORDER BY s) AS k FROM m),
         r AS (SELECT rec_table, rec_id, code_field, min(s) AS start_pos, max(s) + {LENGTH - 1} AS end_pos FROM i
               GROUP BY rec_table, rec_id, code_field, k)"""

ORACLES = {
    "p4_found": _RUNS + " SELECT * FROM r",
    "p4_shares": _RUNS
    + f"""
    , n AS (SELECT rec_table, rec_id, sum(length(x))::BIGINT AS n_chars FROM t WHERE length(x) >= {LENGTH} GROUP BY 1, 2)
    SELECT rec_table, rec_id, n_chars, sum(end_pos - start_pos + 1)::BIGINT AS n_shared FROM r JOIN n USING (rec_table, rec_id) GROUP BY 1, 2, 3""",
}
