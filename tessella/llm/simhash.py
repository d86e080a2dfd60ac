"""Near duplicates by SimHash, with the anchor points of a covering code.

Fingerprints of two texts link where at most two of their 64 bits differ. Anchors are the words of the perfect Hamming
code over the low 63 bits: every fingerprint is within its covering radius, 1, of an anchor. If two fingerprints differ in two
bits at most, some point lies within one bit of both, and that point's anchor within two bits of both. So each distinct fingerprint
is replicated to the anchors within radius + threshold / 2 = 2 bits (32 of them, or 1 for an anchor itself), and fingerprints are compared
per anchor. An anchor has at most 2 * (1 + 63 + 1953) fingerprints around it, so no group can grow with the data.

Comparisons emit links to one representative per anchor and component, not pairs; components follow from
these links (``graph.connected_components``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import column, whole_groups
from .graph import connected_components, ensure_checkpoint_dir

_SEED = 42
DIFFER = 2


def fingerprint(text: str, shingle: int = 3) -> int:
    """SimHash of a text's word shingles, repeats counted; 0 without words."""
    words = text.encode("utf-8").lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    whole = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size) - 1
    start = end + 1 - size
    n = max(1, len(words) - shingle + 1)
    stop = end[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(whole[a:b], _SEED) for a, b in zip(start[:n].tolist(), stop.tolist())], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, n, 1 << 14):
        ones += np.unpackbits(h[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long): the fingerprint's bits as a signed number. Null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = column(batch, id_col).cast(pa.int64()), column(batch, text_col)
            for lo in range(0, len(texts), 1000):
                fps = np.array([fingerprint(t) for t in texts[lo : lo + 1000].to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([ids[lo : lo + 1000], pa.array(fps.view(np.int64))], [id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} long, fp long")


def _syndrome(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(the low bits, the place of the one bit to flip for a word of the code, from 1; 0 for a word of the code)."""
    low = fps & np.uint64((1 << bits) - 1)
    syndrome = np.zeros(len(fps), dtype=np.uint64)
    for bit in range(bits.bit_length()):
        mask = np.uint64(sum(1 << (place - 1) for place in range(1, bits + 1) if place >> bit & 1))
        syndrome |= (np.bitwise_count(low & mask).astype(np.uint64) & np.uint64(1)) << np.uint64(bit)
    return low, syndrome


def nearest_anchor(fps: np.ndarray, bits: int = 63) -> np.ndarray:
    """The anchor within one bit of each fingerprint, by the Hamming code over the low ``bits`` bits (63, 31, ...)."""
    low, syndrome = _syndrome(fps, bits)
    one = np.uint64(1)
    return np.where(syndrome == 0, low, low ^ (one << (np.maximum(syndrome, one) - one)))


def anchors_of(fps: np.ndarray, bits: int = 63) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, index of the fingerprint) for every anchor within two bits of each fingerprint, by the Hamming code over the low ``bits`` bits."""
    low, syndrome = _syndrome(fps, bits)
    own = np.flatnonzero(syndrome == 0)
    far = np.flatnonzero(syndrome != 0)
    s = syndrome[far]
    one = np.uint64(1)
    out, index = [low[own], low[far] ^ (one << (s - one))], [own, far]
    for place in range(1, bits + 1):
        i = np.uint64(place)
        j = s ^ i
        use = j > i  # each pair of places once; s == i is the flip of one bit above
        out.append(low[far[use]] ^ (one << (i - one)) ^ (one << (j[use] - one)))
        index.append(far[use])
    return np.concatenate(out), np.concatenate(index)


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def joined(parent: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The roots of all nodes once each of ``x`` is joined with that of ``y`` at the same place."""
    while len(x):
        parent = _roots(parent)
        x, y = parent[x], parent[y]
        apart = x != y
        x, y = x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
    return _roots(parent)


def links_at_anchors(anchor: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, smallest fingerprint of its component among the given rows) that follow from comparing the rows of each anchor."""
    nodes, node = np.unique(fp, return_inverse=True)
    order = np.argsort(anchor, kind="stable")
    a, f, v = anchor[order], fp[order], node[order]
    parent = np.arange(len(nodes))
    place = np.arange(len(a))
    step = 1
    while len(place):
        place = place[place < len(a) - step]
        place = place[a[place] == a[place + step]]
        if not len(place):
            break
        near = place[np.bitwise_count(f[place] ^ f[place + step]) <= DIFFER]
        parent = joined(parent, v[near], v[near + step])
        step += 1
    moved = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[moved], nodes[parent[moved]]


def link_distinct(distinct: DataFrame) -> DataFrame:
    """(u long, v long): links between distinct fingerprints that connect exactly what chains of close fingerprints connect."""

    def replicate(batches):
        for batch in batches:
            fps = column(batch, "fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for lo in range(0, len(fps), 1 << 14):
                some = fps[lo : lo + (1 << 14)]
                anchor, index = anchors_of(some)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(some[index].view(np.int64))], ["anchor", "fp"])

    def compare(batches):
        for table in whole_groups(batches, "anchor"):
            u, v = links_at_anchors(*(column(table, k).to_numpy(zero_copy_only=False).view(np.uint64) for k in ("anchor", "fp")))
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    return distinct.mapInArrow(replicate, "anchor long, fp long").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint hex string, component_id): one row per input row; component_id is the smallest id that links lead to.

    Null and empty texts have fingerprint zero and link like others. Rows with the same text share a component; rows
    with a null id take part in links but are never the smallest unless all are null. Other columns are ignored.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    fps = fingerprints(docs, id_col, text_col).checkpoint()
    least = fps.groupBy("fp").agg(F.min(id_col).alias("least"))
    members = connected_components(link_distinct(least.select("fp")))
    rooted = least.join(members, least["fp"] == members["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    component = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = rooted.join(component, "root").select(F.col("fp").alias("fp_"), "component_id")
    return fps.join(labels, fps["fp"] == labels["fp_"], "left").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
