"""Near-duplicate embeddings by randomised-rotation binary codes.

A vector is normalised and turned by a random rotation; the signs of its coordinates are its code, and the inner
product of code and vector is the stored correction factor.  The product of one vector's code with another vector
(in eight-bit steps), divided by the factor, estimates the cosine without bias, and the factor bounds the error.
Codes meet in buckets that share a few sign bits, over as many bands as the wanted recall takes.  A pair whose upper
bound stays below the threshold is done with; every other pair is open and is computed again in double precision from
its two vectors, which are fetched only then.

Equal vectors are folded into one with a weight first.  No pairs are emitted: the open pairs of a block of a bucket are
a row of bits at each vector, and what comes back is counts of links and the spanning roots of components.  A pair
that meets in several bands is counted in the first.

Defined results: a null label, a null or zero vector, or one with null or non-finite components links with nothing,
any other does, however large or small its components are; vectors of different lengths are not compared; rows with
equal vec_id count as vectors of their own; other columns play no part.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_roots, blocked, components, map_groups, materialize

#: Chance that a pair at the threshold meets in no band.
MISS = 1e-6
#: Vectors that a bucket of unrelated vectors holds on average.
BUCKET = 32
#: Rows of a block.
BLOCK = 256
#: Width of the confidence bound in standard errors of the estimate.
EPSILON = 4.0


def rotation(dim: int, turn: int) -> np.ndarray:
    """The ``turn``-th random rotation of ``dim`` dimensions (fixed seed)."""
    q, r = np.linalg.qr(np.random.default_rng([dim, turn]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


_rotations: dict = {}


def _turned(unit: np.ndarray, turn: int) -> np.ndarray:
    key = (unit.shape[1], turn)
    if key not in _rotations:
        _rotations[key] = rotation(*key).T.copy()
    return unit @ _rotations[key]


def band_keys(unit: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """bands x n bucket numbers: consecutive sign bits of as many rotations as it takes."""
    dim = unit.shape[1]
    turns = -(-bits * bands // dim)
    signs = np.concatenate([_turned(unit, t) >= 0 for t in range(turns)], axis=1)[:, : bits * bands]
    return (signs.reshape(len(unit), bands, bits) @ (1 << np.arange(bits, dtype=np.int64))).T


def plan_bands(n: int, cosine: float) -> tuple[int, int]:
    """Bits of a bucket and number of bands for ``n`` vectors of the largest label."""
    bits = min(30, max(4, round(math.log2(max(n, 1) / BUCKET))))
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(MISS) / math.log(1 - agree)))


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code (packed signs), correction factor, and the rotated vector in eight-bit steps with its step width."""
    turned = _turned(unit, 0)
    signs = turned >= 0
    factor = np.abs(turned).sum(axis=1) / math.sqrt(unit.shape[1])
    step = np.abs(turned).max(axis=1) / 127
    return np.packbits(signs, axis=1), factor, np.rint(turned / step[:, None]).astype(np.int8), step


def upper_bounds(code: np.ndarray, factor: np.ndarray, eight: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Upper confidence bounds of all cosines between codes (rows) and eight-bit vectors (columns)."""
    dim = eight.shape[1]
    signs = np.unpackbits(code, axis=1)[:, :dim].astype(np.float32) * 2 - 1
    estimate = (signs @ eight.astype(np.float32).T) * (step / math.sqrt(dim))[None, :] / factor[:, None]
    error = EPSILON * np.sqrt(np.maximum(1 - factor**2, 0)) / factor / math.sqrt(max(dim - 1, 1))
    rounding = step / 2 * math.sqrt(dim)  # of the eight-bit steps, at most
    return estimate + error[:, None] + rounding[None, :] / factor[:, None]


def _units(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small components would not be finite or 0
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cosines(unit: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the pairs a, b only, a few million numbers at a time."""
    out, some = np.empty(len(a)), max(1, (1 << 21) // unit.shape[1])
    for at in range(0, len(a), some):
        part = slice(at, at + some)
        out[part] = np.einsum("ij,ij->i", unit[a[part]], unit[b[part]])
    return out


def distinct_vectors(table: DataFrame) -> DataFrame:
    """rid, label, dim, embedding, weight, first_id: one row for each different valid vector of a label."""
    e = F.col("embedding")
    sound = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    valid = table.where(F.col("label").isNotNull() & e.isNotNull()).where(sound)
    folded = valid.groupBy("label", "embedding").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("first_id"))
    return materialize(folded.select(F.monotonically_increasing_id().alias("rid"), "label", F.size("embedding").alias("dim"), "embedding", "weight", "first_id"), "vectors")


def link_counts(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """(rid, links, root) rows: links to be summed, roots as edges; from each block that has links."""
    most = vectors.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    bits, bands = plan_bands(most, cosine)

    def code_rows(batches):
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                unit = _units(part["embedding"])
                code, factor, eight, step = encode(unit)
                keys = band_keys(unit, bits, bands)
                for b in range(bands):
                    yield pd.DataFrame({"rid": part["rid"].to_numpy(), "label": part["label"].to_numpy(), "dim": dim, "band": b, "bucket": keys[b], "code": [x.tobytes() for x in code], "factor": factor.astype(np.float32), "eight": [x.tobytes() for x in eight], "step": step.astype(np.float32)})

    label = vectors.schema["label"].dataType.simpleString()
    group = ["label", "dim", "band", "bucket"]
    coded = vectors.select("rid", "label", "dim", "embedding").mapInPandas(code_rows, f"rid long, label {label}, dim int, band int, bucket long, code binary, factor float, eight binary, step float")
    coded = materialize(coded, "codes")

    def partners(key, c):
        """The vectors of a block that have open pairs, each with the bits of its partners (those of side 0)."""
        dim = int(key[1])
        code = np.frombuffer(b"".join(c["code"]), np.uint8).reshape(len(c["rid"]), -1)
        eight = np.frombuffer(b"".join(c["eight"]), np.int8).reshape(len(c["rid"]), dim)
        rows, cols = (np.flatnonzero(c["side"] == s) for s in (0, 1))
        within = key[4] == key[5]
        if within:
            cols = rows
        if not len(rows) or not len(cols) or within and len(rows) < 2:
            return
        f, s = c["factor"].astype(np.float64), c["step"].astype(np.float64)
        may = upper_bounds(code[rows], f[rows], eight[cols], s[cols]) >= cosine
        may &= upper_bounds(code[cols], f[cols], eight[rows], s[rows]).T >= cosine
        if within:
            np.fill_diagonal(may, False)
        some, others = may.any(axis=1), may.any(axis=0)
        if not some.any():
            return
        bits_of = np.empty(int(some.sum()), object)
        bits_of[:] = [x.tobytes() for x in np.packbits(may[some][:, others], axis=1)]
        hit, side = rows[some], np.zeros(len(bits_of), np.int32)
        if not within:
            hit, side = np.concatenate([hit, cols[others]]), np.concatenate([side, np.ones(int(others.sum()), np.int32)])
            bits_of = np.concatenate([bits_of, np.array([b""] * int(others.sum()), object)])
        yield [c["rid"][hit], *[c[k][hit] for k in block], side, np.arange(len(hit), dtype=np.int32), bits_of]

    block = [*group, "bi", "bj"]
    dealt = blocked(coded, group, "rid", BLOCK)
    found = map_groups(dealt, block, partners, f"rid long, label {label}, dim int, band int, bucket long, bi int, bj int, side int, place int, open binary")
    found = materialize(found, "partners")

    def exact(key, c):
        unit = _units(c["embedding"])
        within = key[4] == key[5]
        rows, cols = (np.flatnonzero(c["side"] == s) for s in (0, 1))
        if within:
            cols = rows
        open_bits = np.frombuffer(b"".join(c["open"][rows]), np.uint8).reshape(len(rows), -1)
        linked = np.unpackbits(open_bits, axis=1)[:, : len(cols)].astype(bool)
        i, j = np.nonzero(linked)
        linked[i, j] = _cosines(unit, rows[i], cols[j]) >= cosine
        if not linked.any():
            return
        keys = band_keys(unit, bits, bands)
        for b in range(int(key[2])):  # counted in an earlier band
            linked &= keys[b][rows][:, None] != keys[b][cols][None, :]
        weight = c["weight"]
        if within:
            square, at = linked | linked.T, rows
            links = linked @ weight[cols]
        else:
            at = np.concatenate([rows, cols])
            square = np.zeros((len(at), len(at)), bool)
            square[: len(rows), len(rows) :] = linked
            square |= square.T
            links = np.concatenate([linked @ weight[cols], linked.T @ weight[rows]])
        keep = links > 0
        if keep.any():
            root = block_roots(square)
            rid = c["rid"][at]
            yield [rid[keep], links[keep].astype(np.int64), rid[root][keep]]

    again = found.join(vectors.select("rid", "embedding", "weight"), "rid")
    return materialize(map_groups(again, block, exact, "rid long, links long, root long", ["place"]), "links")


def embedding_dedup(table: DataFrame, cosine: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``table`` (vec_id, embedding, label)."""
    table = table.select("vec_id", "embedding", "label")
    vectors = distinct_vectors(table)
    links = link_counts(vectors, cosine)
    total = links.groupBy("rid").agg(F.sum("links").alias("links"))
    roots = components(links.select(F.col("rid").alias("a"), F.col("root").alias("b")))
    reps = vectors.join(total, "rid", "left").join(roots.withColumnsRenamed({"node": "rid"}), "rid", "left")
    reps = materialize(reps.select("label", "embedding", "first_id", F.coalesce("root", "rid").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "reps")
    ids = reps.groupBy("root").agg(F.min("first_id").alias("component_id"))
    reps = reps.join(ids, "root").select("label", "embedding", "n_links", "component_id")
    rows = table.join(reps, ["label", "embedding"], "left")
    component = F.coalesce("component_id", "vec_id")
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
