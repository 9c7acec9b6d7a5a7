"""Quality selection by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstone.llm import common
from gridstone.llm.common import durable


@dataclass(frozen=True)
class Resampling:
    """Parameters.

    buckets: hashed 1- and 2-grams are counted in so many. target_rows: labelled rows the target model is fitted on at
    most (smallest hashes of doc_id); the raw model counts every document. fraction: share of the documents kept.
    length: n-grams that a document's mean log ratio stands for, so that long documents do not win or lose by
    their length alone. seed: of the Gumbel noise.
    """

    buckets: int = 1 << 14
    target_rows: int = 20_000
    fraction: float = 0.8
    length: float = 200.0
    seed: int = 9


def _ngrams(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all 1- and 2-grams of every text, and n + 1 offsets; white space parts words."""
    words, cuts = common.word_hashes(column, common.SPACES)
    n = np.diff(cuts)
    pairs = np.maximum(n - 1, 0)
    ends = np.concatenate([[0], np.cumsum(n + pairs)])
    out = np.empty(int(ends[-1]), np.int64)
    of = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(words)) - cuts[:-1][of]
    out[ends[:-1][of] + place] = (words % np.uint64(buckets)).astype(np.int64)
    if len(words) > 1:
        both = common.mix(common.mix(words[:-1]) + words[1:])
        same = of[:-1] == of[1:]
        out[(ends[:-1] + n)[of[:-1][same]] + place[:-1][same]] = (both[same] % np.uint64(buckets)).astype(np.int64)
    return out, ends


def _models(docs: DataFrame, labels: DataFrame, p: Resampling) -> np.ndarray:
    """log(target / raw) for each bucket, both with one added to each count."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    target = np.array(sorted(r[0] for r in good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.target_rows).collect()), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, p.buckets), np.int64)
        for batch in common.slices(batches, "text"):
            grams, ends = _ngrams(batch.column(1), p.buckets)
            counts[0] += np.bincount(grams, minlength=p.buckets)
            ids = batch.column(0).cast(pa.int64()).fill_null(-(2**63)).to_numpy()
            chosen = np.repeat(np.isin(ids, target), np.diff(ends))
            counts[1] += np.bincount(grams[chosen], minlength=p.buckets)
        some = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[0][some]), pa.array(counts[1][some])], names=["bucket", "raw", "target"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sums = rows.mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    counts = np.ones((2, p.buckets))
    for r in sums.collect():
        counts[:, r["bucket"]] += (r["raw"], r["target"])
    counts /= counts.sum(1, keepdims=True)
    return np.log(counts[1]) - np.log(counts[0])


def _threshold(keys: DataFrame, keep: int) -> tuple[float, int] | None:
    """The ``keep``-th largest (key, then smallest doc_id order number) as (key, how many of that key stay).

    Bounds close in by histograms of 1,024 bins over all rows; the driver sees bins, never keys of all rows.
    """
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    above = 0
    while low < high:
        width = (high - low) / 1024
        if low + width <= low:
            break
        bins = F.least(F.floor((F.col("key") - low) / width), F.lit(1023)).alias("bin")
        inside = keys.where((F.col("key") >= low) & (F.col("key") <= high))
        found = inside.groupBy(bins).agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b"))
        for r in sorted(found.collect(), key=lambda r: -r["bin"]):
            if above + r["n"] >= keep:
                low, high = r["a"], r["b"]
                break
            above += r["n"]
    return low, keep - above


def resample(docs: DataFrame, labels: DataFrame, p: Resampling = Resampling()) -> DataFrame:
    """doc_id, n_grams, log_weight, key, kept: a row per document.

    log_weight: mean over the document's n-grams of log(target / raw), times ``length``. key: that plus Gumbel noise
    that depends on doc_id and seed alone. kept: whether key is among the largest ``fraction`` of all keys, which
    draws documents without replacement in proportion to their weights; ties go to the smaller doc_id.

    Defined cases: null texts and texts without words have log_weight 0; rows without doc_id share one noise; rows
    that repeat a doc_id are weighed each; without labels of quality 1 the target is uniform; extra columns are
    ignored; an empty table gives an empty result.
    """
    ratio = _models(docs, labels, p)
    fields = [("doc_id", pa.int64()), ("n_grams", pa.int64()), ("log_weight", pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            grams, ends = _ngrams(batch.column(1), p.buckets)
            total = np.concatenate([[0.0], np.cumsum(ratio[grams])])
            n = np.diff(ends)
            mean = (total[ends[1:]] - total[ends[:-1]]) / np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(np.round(p.length * mean, 6))], schema=pa.schema(fields))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, n_grams long, log_weight double")
    uniform = (F.pmod(F.xxhash64(F.lit(p.seed), "doc_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    scored = durable(scored.withColumn("key", F.col("log_weight") - F.log(-F.log(uniform))), "quality-keys")
    keep = int(scored.count() * p.fraction)
    if not keep:
        return scored.withColumn("kept", F.lit(False))
    edge, stay = _threshold(scored, keep)
    tied = scored.where(F.col("key") == edge).orderBy(F.col("doc_id").asc_nulls_last()).limit(stay).agg(F.max("doc_id")).first()[0]
    last = F.lit(False) if tied is None else F.coalesce(F.col("doc_id") <= tied, F.lit(False))
    return scored.withColumn("kept", (F.col("key") > edge) | ((F.col("key") == edge) & last))
