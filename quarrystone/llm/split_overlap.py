"""Problem 6: records of evaluation splits that appear, exactly or nearly, in the training split.

Every record becomes a short normalised text of one token per field, a grid cell
of each condition and of the measured value,

    Ap12|Bp-5|C~|...Hp3|

in which a training record is written once. Evaluation records contribute
passages: every run of RUN neighbouring fields, and the whole text, each in as
many variants as its numbers lie within the tolerance of a cell's edge. Shards
of the evaluation passages are compiled into Aho-Corasick automata that scan the
training texts of the shard; a passage may match anywhere in a text, and counts
for the evaluation records of the text's structure and metal. The matched runs
of an evaluation record are merged into the fields of it that training records
cover, which may be some or all; records whose whole text is met are compared
with the training record exactly, number by number.

A shard holds the records of many structures and metals. A subject with many
records is cut on both sides, its training texts by one salt and its evaluation
records by another, each part meeting each of the other, so that neither what a
task holds in memory (a bounded number of evaluation records) nor what streams
past it grows with the subject. Equal texts are scanned once a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.sources.tables import cut

STEP = 0.01  # width of a grid cell in ln(value); wider than twice any tolerance in use
RUN = 3  # fields of a passage
HOT, SHARD = 200_000, 20_000  # training texts streamed past, evaluation records held, by one task for one subject
PAIRS = 500_000  # compared at a time
OUT = "eval_id string, train_id string, covered long"


def _records(df: DataFrame, row_id: str, structure: Column, metal: Column, conditions: list[Column], measure: Column, role: Column) -> DataFrame:
    """(id, train, subject, check, numbers, milli) of every usable row: unrecorded conditions are NaN, the measure is in thousandths."""
    gone = F.lit(float("nan"))
    milli = F.round(measure * 1000).cast("long")
    return df.where(role.isin("train", "validation", "test") & structure.isNotNull() & metal.isNotNull() & milli.isNotNull()).select(
        F.col(f"`{row_id}`").cast("string").alias("id"), (role == "train").alias("train"), F.xxhash64(structure, metal).alias("subject"), F.hash(metal, structure).alias("check"),
        F.array(*[F.coalesce(c.cast("double"), gone) for c in conditions]).alias("numbers"), milli.alias("milli"),
    )


def _cells(x: np.ndarray, shift: float) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.floor((np.log(np.abs(x)) + shift) / STEP)


def _tokens(x: np.ndarray, tol: float) -> list[list[tuple[str, ...]]]:
    """Per field, per row: the tokens of the cells a value within the relative tolerance may lie in, its own first."""
    own, low, high = (_cells(x, s).tolist() for s in (0.0, -1.01 * tol, 1.01 * tol))
    sign = np.where(np.isnan(x), "~", np.where(x == 0, "0", np.where(x < 0, "n", "p"))).tolist()
    out = []
    for j in range(x.shape[1]):
        letter, column = chr(65 + j), []
        for i, row in enumerate(sign):
            s = row[j]
            if s in "~0":
                column.append((f"{letter}{s}|",))
            else:
                a, b, c = own[i][j], low[i][j], high[i][j]
                column.append((f"{letter}{s}{a:.0f}|",) if a == b == c else (f"{letter}{s}{a:.0f}|", f"{letter}{s}{(b if b != a else c):.0f}|"))
        out.append(column)
    return out


def _measures(milli: np.ndarray, reach: int) -> list[tuple[str, ...]]:
    """Per row: the measure's tokens, its own first."""
    width = 3 * reach + 2
    own, low, high = ((milli + k) // width for k in (0, -reach, reach))
    return [(f"={a}|",) if a == b == c else (f"={a}|", f"={b if b != a else c}|") for a, b, c in zip(own.tolist(), low.tolist(), high.tolist(), strict=True)]


class _Passages:
    """The passages of a shard's evaluation records and what has been met of them."""

    def __init__(self, n: int, tol: float, reach: int):
        import ahocorasick

        self.n, self.tol, self.reach, self.run = n, tol, reach, max(1, min(RUN, n))
        self.automaton, self.whole, self.runs = ahocorasick.Automaton(), {}, {}
        self.ids, self.numbers, self.milli, self.subject, self.check = [], [], [], [], []
        self.mine: list[list[tuple[int, int]]] = []  # (run's number, first field) of each record
        self.met: set[tuple[int, int]] = set()  # (subject, run's number)
        self.seen: dict[tuple[int, str], list[int] | None] = {}

    def add(self, ids, numbers, milli, subject, check) -> None:
        columns = [*_tokens(numbers, self.tol), _measures(milli, self.reach)]
        for i, (s, fields) in enumerate(zip(subject.tolist(), zip(*columns, strict=True), strict=True), len(self.ids)):
            for text in map("".join, product(*fields)):
                self.whole.setdefault((s, text), []).append(i)
                self._pattern(text, -1)
            parts = []
            for at in range(self.n + 2 - self.run):
                for text in map("".join, product(*fields[at : at + self.run])):
                    k = self.runs.setdefault(text, len(self.runs))
                    self._pattern(text, k)
                    parts.append((k, at))
            self.mine.append(parts)
        self.ids.extend(ids)
        for name, part in zip(("numbers", "milli", "subject", "check"), (numbers, milli, subject, check), strict=True):
            getattr(self, name).append(part)

    def _pattern(self, text: str, k: int) -> None:
        if text not in self.automaton or k >= 0:
            self.automaton.add_word(text, k)

    def close(self) -> None:
        self.automaton.make_automaton()
        self.numbers, self.milli, self.subject, self.check = (np.concatenate(x) for x in (self.numbers, self.milli, self.subject, self.check))
        self.subjects = np.unique(self.subject)

    def scan(self, subject: int, text: str) -> list[int]:
        """Marks the runs met in a training text and returns the evaluation records whose whole text it is."""
        hits = ()
        for _, k in self.automaton.iter(text):
            if k >= 0:
                self.met.add((subject, k))
            else:
                hits = self.whole.get((subject, text), ())
        return hits

    def covered(self) -> tuple[list[str], list[int]]:
        """(ids, merged fields as bits) of the records of which anything was met."""
        span, ids, bits = (1 << self.run) - 1, [], []
        for name, s, parts in zip(self.ids, self.subject.tolist(), self.mine, strict=True):
            fields = 0
            for k, at in parts:
                if (s, k) in self.met:
                    fields |= span << at
            if fields:
                ids.append(name)
                bits.append(fields)
        return ids, bits


def _scanner(n: int, tol: float, reach: int):
    """The function of one shard: evaluation rows come first and fill the automaton, training rows stream past."""

    def columns(batch: pa.RecordBatch, rows: np.ndarray):
        part = batch.take(pa.array(rows))
        return part.column(0).to_pylist(), part.column(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, n), part.column(5).to_numpy(), part.column(2).to_numpy(), part.column(3).to_numpy()

    def batch_of(evals: list, trains: list, covered: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(evals, pa.string()), pa.array(trains, pa.string()), pa.array(covered, pa.int64())], names=["eval_id", "train_id", "covered"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ready, every = _Passages(n, tol, reach), False, (1 << (n + 1)) - 1

        def pairs(left, right, ids, numbers, milli, check) -> pa.RecordBatch:
            a, b = np.repeat(np.array(left, np.int64), [len(r) for r in right]), np.concatenate([np.asarray(r, np.int64) for r in right])
            x, y = numbers[a], held.numbers[b]
            with np.errstate(invalid="ignore"):
                alike = np.where(np.isnan(x) | np.isnan(y), np.isnan(x) & np.isnan(y), np.abs(x - y) <= tol * np.maximum(np.abs(x), np.abs(y))).all(axis=1)
            ok = alike & (np.abs(milli[a] - held.milli[b]) <= reach) & (check[a] == held.check[b])
            return batch_of([held.ids[i] for i in b[ok]], [ids[i] for i in a[ok]], [every] * int(ok.sum()))

        for batch in batches:
            train = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            fresh = np.flatnonzero(~train)
            if len(fresh):
                held.add(*columns(batch, fresh))
            if not train.any() or not held.ids:
                continue
            if not ready:
                held.close()
                ready = True
            rows = np.flatnonzero(train & np.isin(batch.column(2).to_numpy(), held.subjects))
            if not len(rows):
                continue
            ids, numbers, milli, subject, check = columns(batch, rows)
            tokens = [*_tokens(numbers, 0.0), _measures(milli, reach)]
            left, right, size, known = [], [], 0, {}
            for i, (s, fields) in enumerate(zip(subject.tolist(), zip(*tokens, strict=True), strict=True)):
                text = "".join(f[0] for f in fields)
                hits = known.get((s, text))
                if hits is None:
                    hits = known[s, text] = held.scan(s, text)
                if hits:
                    left.append(i)
                    right.append(hits)
                    size += len(hits)
                    if size >= PAIRS:
                        yield pairs(left, right, ids, numbers, milli, check)
                        left, right, size = [], [], 0
            if left:
                yield pairs(left, right, ids, numbers, milli, check)
        if ready:
            some, bits = held.covered()
            yield batch_of(some, [None] * len(some), bits)

    return scan


def split_overlaps(df: DataFrame, row_id: str, structure: Column, metal: Column, conditions: list[Column], measure: Column, role: Column, tol: float = 1e-3, reach: int = 10) -> DataFrame:
    """(eval_id, train_id, covered): every pair of an evaluation and a training record of one structure and metal, all conditions
    alike within `tol` or unrecorded in both, measures (three decimals) at most `reach` thousandths apart, with all bits of `covered` set;
    and, with train_id NULL, which fields of an evaluation record (bit i the i-th condition, the last the measure) training texts of its
    structure and metal cover; coverage() sums it up.

    Conditions must be NULL where unrecorded. Rows whose role is not 'train', 'validation' or 'test', or without structure, metal
    or measure take no part. Rows repeated under one id give repeated pairs. Empty tables give an empty result.
    """
    records = _records(df, row_id, structure, metal, conditions, measure, role)
    counts = records.groupBy("subject").agg(F.count_if("train").alias("n"), F.count_if(~F.col("train")).alias("e")).where("n > 0 AND e > 0")
    counts = cut(counts.select("subject", "e", F.ceil(F.col("n") / HOT).cast("int").alias("salts"), F.ceil(F.col("e") / SHARD).cast("int").alias("slices")))  # a line a subject
    total = counts.agg(F.sum(F.col("e") * F.col("salts")).alias("e"), F.max(F.greatest("salts", "slices")).alias("most")).first()
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(total["e"] or 0) // SHARD))
    if (total["most"] or 1) > 1:
        each = lambda mine, other: F.transform(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1), lambda k: F.struct(F.pmod(F.xxhash64("id"), F.coalesce(F.col(mine), F.lit(1))).cast("int").alias("own"), k.alias("met")))
        records = records.join(counts.where("salts > 1 OR slices > 1").drop("e"), "subject", "left")
        spot = F.explode(F.when(F.col("train"), each("salts", "slices")).otherwise(each("slices", "salts")))
        records = records.withColumn("s", spot).withColumns({"salt": F.when(F.col("train"), F.col("s.own")).otherwise(F.col("s.met")), "slice": F.when(F.col("train"), F.col("s.met")).otherwise(F.col("s.own"))})
    else:
        records = records.withColumns({"salt": F.lit(0), "slice": F.lit(0)})
    sharded = records.repartition(parts, "subject", "salt", "slice").sortWithinPartitions("train")
    return sharded.select("id", "train", "subject", "check", "numbers", "milli").mapInArrow(_scanner(len(conditions), tol, reach), OUT)


def coverage(overlaps: DataFrame, n_fields: int) -> DataFrame:
    """(eval_id, covered, coverage, repeated) of each evaluation record met at all: the fields covered by training records together, their share of n_fields (conditions and measure), and whether one training record repeats it."""
    per = overlaps.groupBy("eval_id").agg(F.bit_or("covered").alias("covered"), F.max(F.col("train_id").isNotNull()).alias("repeated"))
    return per.select("eval_id", "covered", (F.bit_count("covered") / n_fields).alias("coverage"), "repeated")
