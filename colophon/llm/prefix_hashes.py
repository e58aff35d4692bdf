"""Document fingerprints from prefix polynomial hashes.

The array of a text holds, for every prefix, the sum of its code points times powers of a base, modulo a prime.  Two
entries give the hash of any span, so that spans are compared without reading them (``PrefixHashes.equal``), and the
longest common extension of two places is found by binary search (``extension``, ``back_extension``).  Two bases are
used at once; the arrays of a text are worked off in parts, and hashes of parts are put together by powers.

A fingerprint keeps of a text: its length, its hash, the hashes of beginnings and of ends whose lengths lie on one grid
(each about STEP longer than the one before), and the least hashes of its spans of WINDOW characters in each of BINS
classes.  ``likeness`` of two fingerprints is 1 for equal ones; else the larger of two shares, below 1: the longest
common beginning and end, found by binary search over the grid (so rounded down by up to STEP), over the longer text;
and the resemblance of their spans (BINS samples).  The first sees one edit however large, the second many small ones.

``fingerprint_edits`` gives each document and an edited text of it, whose last third comes from the next document in
descending order of ids.  Documents are range-sorted by id (and hash of the text), compressed for the way, so a task
needs one document at a time; only the first and last document of each partition are put together afterwards.

Defined results: null texts are empty; an empty text is like an empty one (1) and like no other (0).  A null id comes
after all others, rows of equal ids are ordered by a hash of their texts; rows equal in both are interchangeable.  The
last document is followed by the first, a single one by itself.  Other columns play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from . import common
from .common import code_points, materialize

#: The prime (2**31 - 1: products stay below 2**62) and the two bases.
PRIME, BASES = (1 << 31) - 1, (1_532_489_911, 987_654_323)
WINDOW, BINS, STEP = 24, 64, 8
#: Bytes that a fingerprint keeps of the hash of a beginning or end.
KEPT = 3

_P, _BITS = np.uint64(PRIME), np.uint64(31)
_tables: dict = {}


def _reduced(x: np.ndarray) -> np.ndarray:
    """Numbers below 2**62 modulo the prime."""
    x = (x & _P) + (x >> _BITS)
    x = (x & _P) + (x >> _BITS)
    x[x == _P] = 0
    return x


def _powers(base: int) -> np.ndarray:
    """Powers of the base that one part of a text needs."""
    n = common.CHUNK_CHARS + 2 * WINDOW
    if len(_tables.get(base, ())) < n:
        out = np.ones(n, np.uint64)
        size = 1
        while size < n:
            more = min(size, n - size)
            out[size : size + more] = _reduced(out[:more] * np.uint64(pow(base, size, PRIME)))
            size += more
        _tables[base] = out
    return _tables[base]


INVERSES = tuple(pow(b, -1, PRIME) for b in BASES)


def _power(base: int, n: int) -> int:
    return int(_powers(base)[n]) if n < common.CHUNK_CHARS else pow(base, n, PRIME)


def prefix_sums(codes: np.ndarray, base: int) -> np.ndarray:
    """len(codes) + 1 prefix hashes of at most one part of a text."""
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_reduced((codes.astype(np.uint64) + np.uint64(1)) * _powers(base)[: len(codes)]), out=sums[1:])
    return _reduced(sums)


class PrefixHashes:
    """The prefix arrays of a whole text (eight bytes a character)."""

    def __init__(self, text: str):
        codes, size = code_points(text), common.CHUNK_CHARS
        self.n, self.sums = len(codes), []
        for base in BASES:
            out, total = np.zeros(self.n + 1, np.uint32), 0
            for at in range(0, self.n, size):
                part = prefix_sums(codes[at : at + size], base)
                part = _reduced(part * np.uint64(_power(base, at))) + np.uint64(total)
                out[at : at + len(part)] = np.where(part >= _P, part - _P, part)
                total = int(out[at + len(part) - 1])
            self.sums.append(out)

    def span(self, i: int, j: int) -> tuple[int, int]:
        """The hash of characters i to j, wherever they stand."""
        return tuple((int(s[j]) - int(s[i])) * _power(inverse, i) % PRIME for s, inverse in zip(self.sums, INVERSES))

    def equal(self, i: int, j: int, other: PrefixHashes, a: int, b: int) -> bool:
        return j - i == b - a and self.span(i, j) == other.span(a, b)

    def extension(self, i: int, other: PrefixHashes, a: int) -> int:
        """How many characters from i and from a on are the same."""
        return _longest(min(self.n - i, other.n - a), lambda k: self.span(i, i + k) == other.span(a, a + k))

    def back_extension(self, i: int, other: PrefixHashes, a: int) -> int:
        """How many characters before i and before a are the same."""
        return _longest(min(i, a), lambda k: self.span(i - k, i) == other.span(a - k, a))


def _longest(most: int, holds) -> int:
    """The largest k up to ``most`` that holds, where all smaller ones do too (0 always does)."""
    low = 0
    while low < most:
        middle = (low + most + 1) // 2
        low, most = (middle, most) if holds(middle) else (low, middle - 1)
    return low


def grid(n: int) -> np.ndarray:
    """Lengths up to n of the beginnings and ends that fingerprints keep."""
    if "grid" not in _tables or _tables["grid"][-1] <= n:
        out = [1]
        while out[-1] <= 2 * n:
            out.append(out[-1] + max(1, out[-1] // STEP))
        _tables["grid"] = np.array(out)
    return _tables["grid"][: _tables["grid"].searchsorted(n, side="right")]


#: A span's hash is cut to 46 bits, the upper six of which give its class.
_CLASS, _CUT = np.uint64(40), np.uint64(18)
_NONE = ~np.uint64(0)


def _span_keys(sums: np.ndarray) -> np.ndarray:
    """Hashes of all spans of WINDOW characters."""
    n = max(0, len(sums) - WINDOW)
    return common.mix(_reduced((sums[len(sums) - n :] + (_P - sums[:n])) * _powers(INVERSES[0])[:n]) + np.uint64(1)) >> _CUT


def _least(keys: np.ndarray, groups: int) -> np.ndarray:
    """The least key of each class of each group (the number above 46 bits)."""
    keys, edges = np.sort(keys), np.arange(groups * BINS, dtype=np.uint64) << _CLASS
    at = keys.searchsorted(edges)
    found = keys[np.minimum(at, len(keys) - 1)] if len(keys) else np.full(len(edges), _NONE)
    return np.where((at < len(keys)) & (found >> _CLASS == edges >> _CLASS), found, _NONE).reshape(groups, BINS)


def _packed(n: int, hashes, least: np.ndarray, short: np.ndarray) -> bytes:
    classes = np.where(least == _NONE, np.uint64(0), (least & np.uint64((1 << 40) - 1)) % np.uint64(255) + np.uint64(1))
    return struct.pack("<QQ", n, (int(hashes[0]) << 31) + int(hashes[1])) + classes.astype(np.uint8).tobytes() + short.tobytes()


def _shortened(pairs: np.ndarray) -> np.ndarray:
    return common.mix((pairs[0] << _BITS) + pairs[1] + np.uint64(1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEPT]


def _whole_span(hash0) -> np.ndarray:
    return common.mix(np.array([hash0], np.uint64) + np.uint64(1)) >> _CUT


def _some(texts: list[str]) -> list[bytes]:
    """Fingerprints of texts of one part in all, from one prefix array."""
    sizes = np.array([len(t) for t in texts])
    to = np.cumsum(sizes)
    at = to - sizes
    grids = [grid(n) for n in sizes]
    counts = np.array([len(g) for g in grids])
    lengths, a, b = np.concatenate(grids), np.repeat(at, counts), np.repeat(to, counts)
    whole, front, back, first = np.empty((2, len(texts)), np.uint64), np.empty((2, len(a)), np.uint64), np.empty((2, len(a)), np.uint64), None
    codes = code_points("".join(texts))
    for x, base in enumerate(BASES):
        sums, inverse = prefix_sums(codes, base), _powers(INVERSES[x])
        first = sums if first is None else first
        span = lambda i, j: _reduced((sums[j] + (_P - sums[i])) * inverse[i])  # noqa: E731, B023
        whole[x], front[x], back[x] = span(at, to), span(a, a + lengths), span(b - lengths, b)
    keys, doc = _span_keys(first), np.repeat(np.arange(len(texts), dtype=np.uint64), sizes)
    inside = doc[: len(keys)] == doc[WINDOW - 1 : WINDOW - 1 + len(keys)]
    keys = keys[inside] + (doc[: len(keys)][inside] << np.uint64(46))
    least = _least(keys, len(texts))
    short_front, short_back, cuts, out = _shortened(front), _shortened(back), np.append(0, np.cumsum(counts)).tolist(), []
    for k, n in enumerate(sizes.tolist()):
        i, j = cuts[k], cuts[k + 1]
        own = _least(_whole_span(whole[0, k]), 1)[0] if 0 < n < WINDOW else least[k]  # a short text is its only span
        out.append(_packed(n, whole[:, k], own, np.concatenate([short_front[i:j], short_back[i:j]])))
    return out


def _long(text: str) -> bytes:
    """The fingerprint of a text of any length, read in parts: hash and wanted prefixes are carried on."""
    n, size = len(text), common.CHUNK_CHARS
    lengths = grid(n)
    wanted = np.unique(np.concatenate([lengths, n - lengths]))
    marks, hashes, tail, least = np.zeros((2, len(wanted)), np.uint64), [0, 0], np.zeros(0, np.uint32), np.full((1, BINS), _NONE)
    for start in range(0, n, size):
        end, seen = min(start + size, n), len(tail)
        codes, first = np.concatenate([tail, code_points(text[start:end])]), None
        i, j = wanted.searchsorted(start, side="right"), wanted.searchsorted(end, side="right")
        at = np.append(wanted[i:j], end) - (start - seen)
        for x, base in enumerate(BASES):
            sums = prefix_sums(codes, base)
            first = sums if first is None else first
            scale = np.uint64(_power(base, start) * _power(INVERSES[x], seen) % PRIME)
            values = _reduced(_reduced((sums[at] + (_P - sums[seen])) * scale) + np.uint64(hashes[x]))
            marks[x, i:j], hashes[x] = values[:-1], int(values[-1])
        least, tail = np.minimum(least, _least(_span_keys(first), 1)), codes[-(WINDOW - 1) :]
    front, before = marks[:, wanted.searchsorted(lengths)], marks[:, wanted.searchsorted(n - lengths)]
    turned = [np.array([pow(inverse, int(k), PRIME) for k in n - lengths], np.uint64) for inverse in INVERSES]
    back = np.stack([_reduced((np.uint64(h) + (_P - m)) * t) for h, m, t in zip(hashes, before, turned)])
    return _packed(n, hashes, least[0], np.concatenate([_shortened(front), _shortened(back)]))


def fingerprints(texts: list[str]) -> list[bytes]:
    out = []
    for _, some in common.chunks(texts):
        out += [_long(some[0])] if common.is_long(some) else _some(some)
    return out


def likenesses(ones: list[bytes], twos: list[bytes]) -> list[float]:
    """Of pairs of fingerprints, from 0 to 1; 1 for equal ones only."""
    if not ones:
        return []
    a, b = (np.frombuffer(b"".join(x[16 : 16 + BINS] for x in xs), np.uint8).reshape(-1, BINS) for xs in (ones, twos))
    used = ((a > 0) | (b > 0)).sum(axis=1)
    share = ((a == b) & (a > 0)).sum(axis=1) / np.maximum(used, 1)
    share = (share - 1 / 255) / (1 - 1 / 255)  # classes that agree by chance
    return [_likeness(x, y, s) for x, y, s in zip(ones, twos, share.tolist())]


def _likeness(one: bytes, two: bytes, share: float) -> float:
    if one[:16] == two[:16]:
        return 1.0
    n, m = int.from_bytes(one[:8], "little"), int.from_bytes(two[:8], "little")
    if not n or not m:
        return 0.0
    lengths, front = grid(min(n, m)), 16 + BINS
    own, others = (len(one) - front) // 2 + front, (len(two) - front) // 2 + front

    def shared(at: int, to: int) -> int:
        k = _longest(len(lengths), lambda k: one[at + (k - 1) * KEPT : at + k * KEPT] == two[to + (k - 1) * KEPT : to + k * KEPT])
        return int(lengths[k - 1]) if k else 0

    both = min(shared(front, front) + shared(own, others), n, m)
    return min(max(share, both / max(n, m), 0.0), 1 - 1 / (max(n, m) + 1))


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as much of the beginning of the following one."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _results(texts: list[str], prints: list[bytes]) -> list[tuple]:
    """Length, digest of the edited text, both fingerprints and both likenesses of all texts but the last."""
    changed = [edited(t, u) for t, u in zip(texts, texts[1:])]
    new = fingerprints(changed)
    digests = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in changed]
    return list(zip(map(len, texts), digests, prints, new, likenesses(prints[:-1], new), likenesses(prints[:-1], prints[1:])))


RESULT = "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


@F.pandas_udf(BinaryType())
def _compressed(text: pd.Series) -> pd.Series:
    pack = zstandard.ZstdCompressor(level=1).compress
    return pd.Series([pack(t.encode("utf-8", "surrogatepass")) for t in text])


def _chain(batches):
    """The results of all documents but the last; the first and the last as texts (edge 0 and 1)."""
    part, names, ids, texts, prints = TaskContext.get().partitionId(), ["part", "edge", "text", *_COLUMNS], [], [], []
    for pdf in batches:
        read = zstandard.ZstdDecompressor().decompress
        all_ids, all_texts = pdf["doc_id"].tolist(), [read(t).decode("utf-8", "surrogatepass") for t in pdf["packed"]]
        for start, some in common.chunks(all_texts):
            out = [] if ids else [(part, 0, some[0], all_ids[start], *[None] * 6)]
            # the last document of what came before waits for the first one here
            ids, texts, prints = ids + all_ids[start : start + len(some)], texts + some, prints + fingerprints(some)
            out += [(part, None, None, i, *x) for i, x in zip(ids, _results(texts, prints))]
            ids, texts, prints = ids[-1:], texts[-1:], prints[-1:]
            yield pd.DataFrame(out, columns=names).astype({"edge": "Int32", "n_chars": "Int64"})
    if ids:
        yield pd.DataFrame([(part, 1, texts[0], ids[0], *[None] * 6)], columns=names).astype({"edge": "Int32", "n_chars": "Int64"})


def _seams(batches):
    for pdf in batches:
        rows = [(i, *_results([t, u], fingerprints([t, u]))[0]) for i, t, u in zip(pdf["doc_id"], pdf["text"], pdf["following"])]
        yield pd.DataFrame(rows, columns=_COLUMNS)


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each document."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("tie"), _compressed("text").alias("packed"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie")]
    # a number of partitions is named, so that none are put together: the number of a partition is its place in the order
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    done = materialize(dealt.select("doc_id", "packed").mapInPandas(_chain, f"part int, edge int, text string, doc_id {kind}, {RESULT}"), "fingerprints")
    edges = done.where("edge IS NOT NULL").select("part", "edge", "doc_id", "text")
    # one row a partition
    parts = edges.where("edge = 0").select("part")
    onward = parts.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("next"))
    first = edges.where("edge = 0").select(F.col("part").alias("next"), F.col("text").alias("following"))
    last = edges.where("edge = 1").join(onward, "part").join(first, "next").select("doc_id", "text", "following")
    whole = done.where("edge IS NULL").select(*_COLUMNS).unionByName(last.mapInPandas(_seams, f"doc_id {kind}, {RESULT}"))
    return whole.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})
