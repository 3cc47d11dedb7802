"""Exact copies: counting quotient filters find repeated fingerprints, the bytes of those texts decide.

Every partition puts the fingerprints of its texts into counting quotient filters, one for each segment
(the fingerprints' first bits). Filters of a segment are merged run by run, their remainders being
sorted, so nothing is lost. Texts whose fingerprint counts more than one go to byte verification: a
grouping by the whole text. A group is one row for each task before it is shuffled, so large groups
of copies cost no more than small ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkproof.llm.common import BLANK, stored

#: Quotients of a segment: 2**QUOTIENT_BITS. Fingerprints that one merged segment should hold, and that a task holds before it writes filters.
QUOTIENT_BITS, SEGMENT_ROWS, HELD = 12, 1 << 22, 1 << 20
#: Repeated fingerprints are broadcast by their first bits only: at most 2**ROUTE_BITS rows, however many there are.
ROUTE_BITS = 20
#: Groups of at least this share of all rows, 512 at most, are joined by broadcast.
HOT_SHARE = 512

FIELDS = ("occupied", "run_ends", "remainders", "repeated", "counts")
SCHEMA = "segment long, " + ", ".join(f"{f} binary" for f in FIELDS)


@dataclass
class QuotientFilter:
    """Multiset of the fingerprints that share their first `segment_bits` bits.

    The next QUOTIENT_BITS bits are the quotient, the rest the remainder. Remainders lie sorted in
    runs, one for each quotient that occurs: `occupied` has a bit for every quotient, `run_ends` one
    for every remainder, and `repeated` marks those with a count above one, kept in `counts`.
    """

    segment_bits: int
    segment: int
    occupied: np.ndarray
    run_ends: np.ndarray
    remainders: np.ndarray
    repeated: np.ndarray
    counts: np.ndarray

    @property
    def remainder_bits(self) -> int:
        return 64 - self.segment_bits - QUOTIENT_BITS

    @classmethod
    def of_sorted(cls, segment_bits: int, fingerprints: np.ndarray, counts: np.ndarray) -> QuotientFilter:
        """fingerprints: uint64, rising, of one segment."""
        rest = 64 - segment_bits - QUOTIENT_BITS
        quotient = (fingerprints >> np.uint64(rest)) & np.uint64((1 << QUOTIENT_BITS) - 1)
        occupied = np.zeros(1 << QUOTIENT_BITS, bool)
        occupied[quotient] = True
        ends = np.ones(len(fingerprints), bool)
        ends[:-1] = quotient[1:] != quotient[:-1]
        segment = int(fingerprints[0]) >> (64 - segment_bits) if segment_bits else 0
        return cls(segment_bits, segment, occupied, ends, fingerprints & np.uint64((1 << rest) - 1), counts > 1, counts[counts > 1])

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray]:
        """All fingerprints, rising, with their counts."""
        run = np.cumsum(self.run_ends) - self.run_ends
        quotient = np.flatnonzero(self.occupied).astype(np.uint64)[run]
        values = (quotient << np.uint64(self.remainder_bits)) | self.remainders
        if self.segment_bits:
            values |= np.uint64(self.segment << (64 - self.segment_bits))
        counts = np.ones(len(values), np.int64)
        counts[self.repeated] = self.counts
        return values, counts

    def count(self, fingerprint: int) -> int:
        """How often a fingerprint of this segment was put in: rank of its quotient, then a search in that run."""
        quotient = (fingerprint >> self.remainder_bits) & ((1 << QUOTIENT_BITS) - 1)
        if not self.occupied[quotient]:
            return 0
        run = int(self.occupied[:quotient].sum())
        ends = np.flatnonzero(self.run_ends)
        first, last = (int(ends[run - 1]) + 1 if run else 0), int(ends[run]) + 1
        wanted = np.uint64(fingerprint & ((1 << self.remainder_bits) - 1))
        at = first + int(np.searchsorted(self.remainders[first:last], wanted))
        if at == last or self.remainders[at] != wanted:
            return 0
        return int(self.counts[int(self.repeated[:at].sum())]) if self.repeated[at] else 1

    @classmethod
    def merged(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        """One filter with all fingerprints; counts of equal remainders of a run add up."""
        parts = [f.fingerprints() for f in filters]
        values = np.concatenate([p[0] for p in parts])
        counts = np.concatenate([p[1] for p in parts])
        order = np.argsort(values, kind="stable")
        values, counts = values[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        return cls.of_sorted(filters[0].segment_bits, values[first], np.add.reduceat(counts, first))

    def row(self) -> dict:
        width = -(-self.remainder_bits // 8)
        low = self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        return {
            "segment": self.segment, "occupied": np.packbits(self.occupied).tobytes(), "run_ends": np.packbits(self.run_ends).tobytes(),
            "remainders": low.tobytes(), "repeated": np.packbits(self.repeated).tobytes(), "counts": self.counts.astype("<i8").tobytes()}

    @classmethod
    def of_row(cls, segment_bits: int, row: dict) -> QuotientFilter:
        width = -(-(64 - segment_bits - QUOTIENT_BITS) // 8)
        low = np.frombuffer(row["remainders"], np.uint8).reshape(-1, width)
        whole = np.zeros((len(low), 8), np.uint8)
        whole[:, :width] = low

        def bits(name: str, n: int) -> np.ndarray:
            return np.unpackbits(np.frombuffer(row[name], np.uint8), count=n).astype(bool)

        return cls(
            segment_bits, row["segment"], bits("occupied", 1 << QUOTIENT_BITS), bits("run_ends", len(low)), whole.view("<u8").ravel(),
            bits("repeated", len(low)), np.frombuffer(row["counts"], "<i8"))


def partition_filters(segment_bits: int):
    """(fingerprint) to rows of filters, at most HELD fingerprints at a time."""

    def rows(held: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        segment = values >> np.uint64(64 - segment_bits) if segment_bits else np.zeros(len(values), np.uint64)
        cuts = [0, *(np.flatnonzero(segment[1:] != segment[:-1]) + 1).tolist(), len(values)]
        made = [QuotientFilter.of_sorted(segment_bits, values[a:b], counts[a:b]).row() for a, b in zip(cuts, cuts[1:])]
        return as_batch(made)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            n += batch.num_rows
            if n >= HELD:
                yield rows(held)
                held, n = [], 0
        if n:
            yield rows(held)

    return run


def as_batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, pa.schema([("segment", pa.int64()), *[(f, pa.binary()) for f in FIELDS]]))


def merge_segment(segment_bits: int):
    def run(table: pa.Table) -> pa.Table:
        merged = QuotientFilter.merged([QuotientFilter.of_row(segment_bits, r) for r in table.to_pylist()])
        return pa.Table.from_batches([as_batch([merged.row()])])

    return run


def listed(segment_bits: int):
    """Filters to (fingerprint, n)."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                values, counts = QuotientFilter.of_row(segment_bits, row).fingerprints()
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], names=["fingerprint", "n"])

    return run


def counted_fingerprints(fingerprints: DataFrame, rows: int) -> DataFrame:
    """(fingerprint, n) of a one-column table of longs, through merged filters that lie in the shared folder."""
    tasks = int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    segment_bits = max(1, (max(tasks, -(-rows // SEGMENT_ROWS)) - 1).bit_length())
    filters = fingerprints.mapInArrow(partition_filters(segment_bits), SCHEMA)
    merged = stored(filters.groupBy("segment").applyInArrow(merge_segment(segment_bits), SCHEMA), "filters")
    return merged.mapInArrow(listed(segment_bits), "fingerprint long, n long")


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, " ")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row of docs (doc_id, text).

    Texts are equal when they are after each run of white space became one space; null counts as
    empty, and all empty texts are one group. keep_id is the smallest doc_id of the group (null ids
    count only if there is no other); rows that share that id are all kept. Other columns of docs are
    not looked at. An empty table gives none.
    """
    own = docs.select("doc_id", normalised(F.col("text")).alias("normal")).withColumn("fingerprint", F.xxhash64("normal"))
    rows = docs.count()
    counts = stored(counted_fingerprints(own.select("fingerprint"), rows).filter("n > 1"), "repeated")
    route = F.shiftrightunsigned("fingerprint", 64 - ROUTE_BITS)
    routes = counts.select(route.alias("route")).distinct()  # at most 2**ROUTE_BITS rows
    routed = own.withColumn("route", route).join(F.broadcast(routes), "route", "left_semi")
    verified = routed.groupBy("fingerprint", "normal").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = stored(
        verified.filter("group_size > 1").select(F.unhex(F.sha2("normal", 256)).alias("digest"), "keep_id", "group_size"), "groups")

    large = F.col("group_size") * HOT_SHARE >= rows
    hot = groups.filter(large).select("digest", F.struct("keep_id", "group_size").alias("hot"))
    cold = groups.filter(~large).select(F.col("digest").alias("key"), F.struct("keep_id", "group_size").alias("cold"))
    each = docs.select("doc_id", F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest")).join(F.broadcast(hot), "digest", "left")
    # rows of large groups are done; a key of their own keeps them from meeting in one task
    spread = F.concat("digest", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    joined = each.withColumn("key", F.when(F.col("hot").isNull(), F.col("digest")).otherwise(spread)).join(cold, "key", "left")
    group = F.coalesce("hot", "cold")
    keep = F.when(group.isNull(), F.col("doc_id")).otherwise(group["keep_id"])
    return joined.select(
        "doc_id", keep.alias("keep_id"), F.coalesce(group["group_size"], F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY n) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY n) AS kept, sha256(n) AS text_sha256
FROM t
"""
