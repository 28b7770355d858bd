"""Helpers that the corpus operators share: table access, batch views, landing, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dealgrid.session import cut_lineage

#: White space of the contracts: space and the controls from tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def land(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: values drawn once stay as they are, whoever fails later."""
    return cut_lineage(df, name)


def crc_mod(key: Column, modulus: int) -> Column:
    """crc32 of a key as text, modulo `modulus`; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def as_bytes(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8 bytes, null as empty."""
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def small_batches(batches: Iterator[pa.RecordBatch], max_bytes: int, *columns: str) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about `max_bytes` of `columns` together, and one row at least."""
    for batch in batches:
        lengths = (pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False) for c in columns)
        sizes = np.sum([x.astype(np.int64) for x in lengths], axis=0)
        slot = (np.cumsum(sizes) - sizes) // max_bytes
        edges = [0, *(np.flatnonzero(np.diff(slot)) + 1).tolist(), len(sizes)]
        for start, end in zip(edges, edges[1:]):
            if end > start:
                yield batch.slice(start, end - start)


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each row's list."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """The smallest node of each node's component, as (node, component), for undirected edges (a, b).

    Alternates large-star and small-star steps until every component is a star around its smallest node. A node's
    minimum is folded on the map side and joined back, so a node with very many edges is no single task's work, and each
    round is written to the shared folder. Self loops and nulls give no row; repeated edges count once.
    """
    edges = land(edges.select("a", "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    state = _fingerprint(edges)
    while state[0]:
        # Large star: every larger neighbour of a node points to the smallest node next to it.
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # Small star: every smaller neighbour, and the node itself, point to the smallest of them.
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.explode(F.array(F.struct("m", F.col("a").alias("n")), F.struct("m", F.col("b").alias("n")))).alias("e"))
        edges = land(small.select(F.col("e.m").alias("a"), F.col("e.n").alias("b")).where("a <> b").distinct(), name)
        before, state = state, _fingerprint(edges)
        if before == state:
            break
    roots = edges.select("a").distinct().select(F.col("a").alias("node"), F.col("a").alias("component"))
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionAll(roots)
