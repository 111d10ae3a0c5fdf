"""Near-duplicate vectors by spherical k-means cells and blocked cosine products.

Equal vectors of a label collapse into one class first. Centres are fitted on
a bounded sample; every class lives in the cell of its nearest centre and
visits each other cell that can hold a vector close enough to it. The border
between two cells is the plane of equal products with their centres, so a
vector whose angle to that plane exceeds the threshold's angle is linked with
nothing beyond it: no link is missed, whatever the centres are. Vectors with
no clusters visit most cells, and the work is then that of all pairs of a
label. Within a cell of a label the cosines of residents with residents and
visitors are computed as products of blocks of bounded size. A block pair
returns how many vectors each class is linked with and a spanning forest of
its links, never the pairs themselves, so a dense cluster costs rows in
proportion to its size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from corvane.functions.text import let
from corvane.llm.arrow import take
from corvane.operators.components import Forest, connected_components
from corvane.operators.skew import join_hot
from corvane.storage import drop, materialize

MOST_CELLS = 16_384  # beyond 40 million vectors cells grow instead; centres of 512 dimensions take 64 MB


def unit(values: Column) -> Column:
    """A vector over its length, in double precision; null where it is null, zero or holds null or non-finite components.

    It is scaled by its largest component first, so that no square overflows or
    vanishes. Each step is bound once: written as columns, the optimiser would
    put the length into the loop over the components.
    """

    def largest(v: Column) -> Column:
        return F.aggregate(v, F.lit(0.0), lambda m, x: F.when(m.isNull() | x.isNull() | F.isnan(x), F.lit(None).cast("double")).otherwise(F.greatest(m, F.abs(x.cast("double")))))

    def scaled(v: Column, by: Column) -> Column:
        return F.transform(v, lambda x: x.cast("double") / by)

    def over_length(v: Column) -> Column:
        return let(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)), lambda n: scaled(v, n))

    return let(values, lambda v: let(largest(v), lambda m: F.when((m > 0) & (m < float("inf")), let(scaled(v, m), over_length))))


def spherical_kmeans(x: np.ndarray, k: int, steps: int = 8) -> np.ndarray:
    """``k`` unit centres of unit rows, from evenly spread starting rows; a centre left without rows keeps its place."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(np.int64)].copy()
    for _ in range(steps):
        nearest = np.concatenate([(x[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        norm = np.linalg.norm(sums, axis=1)
        full = norm > 0
        centres[full] = sums[full] / norm[full, None]
    return centres


def reached(x: np.ndarray, centres: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of every row of ``x``, and which other cells can hold a vector at a cosine of ``threshold``."""
    products = x @ centres.T
    home = products.argmax(1)
    apart = np.sqrt(np.maximum(2 - 2 * (centres @ centres.T), 0))  # between unit centres
    sine = np.sqrt(1 - min(threshold, 1.0) ** 2) if threshold > 0 else np.inf
    with np.errstate(invalid="ignore"):
        limit = np.nan_to_num(sine * apart, nan=0.0, posinf=np.inf) + 1e-6  # far above the rounding of any product
    over = products[np.arange(len(x)), home][:, None] - products <= limit[home]
    over[np.arange(len(x)), home] = False
    return home, over


def _assign(classes: DataFrame, centres: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """A row for every class and cell it lives in or visits: ``class_id, label, n, vec, cell, lives``.

    Of two cells only one receives visitors from the other, the lower where
    their sum is even and else the higher, so a pair meets in one cell.
    """
    held = classes.sparkSession.sparkContext.broadcast(centres)
    schema = StructType([*classes.schema.fields, StructField("cell", IntegerType()), StructField("lives", BooleanType())])

    def run(batches):
        names = classes_columns
        for whole in batches:
            for first in range(0, whole.num_rows, 1024):
                b = whole.slice(first, 1024)
                sizes = np.asarray(b.column(names.index("vec")).value_lengths())
                flat = b.column(names.index("vec")).flatten().to_numpy(zero_copy_only=False)
                ends = np.cumsum(sizes)
                row, cell, lives = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
                for dim in np.unique(sizes):
                    at = np.flatnonzero(sizes == dim)
                    c = held.value.get(int(dim))
                    home, i, to = np.zeros(len(at), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
                    if c is not None:
                        home, over = reached(flat[(ends[at] - dim)[:, None] + np.arange(dim)], c, threshold)
                        i, to = np.nonzero(over)
                        there = np.where((home[i] + to) % 2 == 0, to < home[i], to > home[i])
                        i, to = i[there], to[there]
                    row += [at, at[i]]
                    cell += [home, to]
                    lives += [np.ones(len(at), bool), np.zeros(len(i), bool)]
                row, cell, lives = np.concatenate(row), np.concatenate(cell), np.concatenate(lives)
                for s in range(0, len(row), 4096):
                    part = slice(s, s + 4096)
                    took = [take(b.column(i), row[part].tolist()) for i in range(len(names))]
                    yield pa.RecordBatch.from_arrays([*took, pa.array(cell[part], pa.int32()), pa.array(lives[part])], names=[*names, "cell", "lives"])

    classes_columns = classes.columns
    return classes.mapInArrow(run, schema)


LINKED = "kind int, a long, b long, n long"


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label", cell_size: int = 256, sample: int = 20_000, block: int = 1024) -> DataFrame:
    """``key, n_links, component_id, kept`` for every row; links need equal labels and a cosine of at least ``threshold`` in double precision.

    Rows with a null label, a null or zero vector, or null or non-finite
    components link with nothing; neither do vectors of different lengths.
    ``n_links`` counts other rows, equal vectors included. Keys are taken to be
    unique; rows with null keys take part as copies do but have null results.
    The centres are fitted on about ``sample`` vectors, at least four a cell;
    they and the number of cells bear on the time only, every link is found.
    Other columns are not read; an empty table gives an empty one.
    """
    rows = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.when(F.col(label).isNotNull(), unit(F.col(vector))).alias("vec"))
    rows = rows.select("id", F.when(F.col("vec").isNotNull(), F.col("label")).alias("label"), "vec")
    classes = materialize(rows.where("vec is not null").groupBy("label", "vec").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n")).where("class_id is not null"), "vectors")
    total = classes.count()
    k = min(MOST_CELLS, max(1, total // (10 * cell_size)))
    sample = max(sample, 4 * k)
    chance = F.pmod(F.xxhash64("class_id"), F.lit(1 << 30)) < F.lit(float(1 << 30) * min(1.0, sample / max(total, 1)))
    drawn = classes.where(chance).select("class_id", "vec").toPandas().sort_values("class_id")
    centres = {}
    if k > 1:
        for dim, part in drawn.groupby(drawn["vec"].map(len)):
            x = np.stack(part["vec"].tolist())
            if len(x) > k:
                centres[int(dim)] = spherical_kmeans(x, k)
    placed = materialize(_assign(classes, centres, threshold).withColumn("dim", F.size("vec")), "cells")
    sizes = placed.groupBy("label", "dim", "cell").agg(F.count_if("lives").alias("residents"), F.count_if(~F.col("lives")).alias("visitors")).where("residents > 0")
    sizes = sizes.select("label", "dim", "cell", *[F.ceil(F.col(c) / block).cast("int").alias(c) for c in ("residents", "visitors")])
    # a class is in one block of its cell; a resident's meets each block and a visitor's those of residents: a row for every pair of blocks it is part of
    draw = F.xxhash64("class_id", F.lit(7))
    own = F.when(F.col("lives"), F.pmod(draw, F.col("residents"))).otherwise(F.col("residents") + F.pmod(draw, F.col("visitors"))).cast("int")
    dealt = placed.join(sizes, ["label", "dim", "cell"]).withColumn("own", own)
    met = F.col("residents") + F.when(F.col("lives"), F.col("visitors")).otherwise(0)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), met - 1)))
    dealt = dealt.select("class_id", "n", "vec", "cell", "own", "label", "dim", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("class_id", ignore_index=True)
        ids, n, own = pdf["class_id"].to_numpy(), pdf["n"].to_numpy(), pdf["own"].to_numpy()
        x = np.stack(pdf["vec"].tolist())
        lo, hi = pdf["lo"].iloc[0], pdf["hi"].iloc[0]
        left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        forest, links, edges = Forest(len(x)), np.zeros(len(x), np.int64), []
        for s in range(0, len(left), 512):
            i, j = np.nonzero(x[left[s : s + 512]] @ x[right].T >= threshold)
            i, j = left[i + s], right[j]
            if lo == hi:
                i, j = i[i < j], j[i < j]
            np.add.at(links, i, n[j])
            np.add.at(links, j, n[i])
            edges += [(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if forest.join(a, b)]
        some = np.flatnonzero(links)
        return pd.DataFrame({"kind": [0] * len(some) + [1] * len(edges), "a": [*ids[some], *(ids[a] for a, _ in edges)], "b": [*ids[some], *(ids[b] for _, b in edges)], "n": [*links[some], *([0] * len(edges))]})

    found = materialize(dealt.groupBy("label", "dim", "cell", "lo", "hi").applyInPandas(compare, LINKED), "links")
    counts = found.where("kind = 0").groupBy(F.col("a").alias("class_id")).agg(F.sum("n").alias("linked"))
    groups = connected_components(found.where("kind = 1").select("a", "b"))
    known = classes.join(counts, "class_id", "left").join(groups.withColumnRenamed("id", "class_id"), "class_id", "left")
    known = known.select("label", "vec", "n", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "class_id").alias("component"))
    known = materialize(known, "known")
    drop(placed, found)
    # a class of null keys only has no row in ``known``, nor has a vector that cannot be used
    usable = rows.where("vec is not null")
    out = join_hot(usable, known, ["label", "vec"], "n", classes.agg(F.sum("n").alias("n")).first()["n"] or 0).select("id", "links", "component")
    alone = usable.where("id is null").join(known.select("label", "vec"), ["label", "vec"], "left_anti").select("id").union(rows.where("vec is null").select("id"))
    out = out.unionByName(alone.select("id", F.lit(0).cast("long").alias("links"), F.lit(None).cast("long").alias("component")))
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
