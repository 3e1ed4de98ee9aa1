"""Near-duplicate documents: SuperMinHash, banding, verification on full sets, union-find grouping.

1. Each document becomes the set of hashes of its ``shingle``-word shingles and a SuperMinHash
   signature of ``bands * rows`` values.  Documents with the same set are one *text* from here on.
2. Each band of the signature is a bucket.  Every text is tied to the least text in each of its
   buckets; components of these ties are *families*.  All texts that share any bucket are in one
   family, so a link is missed only if no band agrees: at a similarity of 0.85, 3 in 10 million.
3. In each family, the text with the fullest buckets (a group's centre) is compared with every other.
4. Texts that it does not confirm are compared with the rest of their family in blocks: exact
   intersection sizes of two blocks of about ``BLOCK`` shingles at a time.
5. Components of the confirmed links are the groups.

Sets are compared by 64-bit hashes of their shingles.  Within a block only a spanning forest of the
links found is returned, so large groups do not make pairs of all their members.

Edge cases: a text with fewer words than a shingle is one shingle; a null, empty or blank text has
no shingles and is linked with nothing; repeated rows form a group with one id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, texts
from .components import UnionFind, connected_components

BLOCK = 1 << 16
STRETCH = 1 << 19
_ODD = np.uint64(0x9E3779B97F4A7C15)
MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def powers(base: int, size: int) -> np.ndarray:
    """``base ** 0 .. base ** (size - 1)`` modulo 2**64."""
    out = np.full(size, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


def run_hashes(codes: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each run of codes that are ``inside``; the last code must not be."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside]).astype(np.int8)))
    first, stop = edge[::2], edge[1::2]
    size = 1 << (len(codes) + 1).bit_length()
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes.astype(np.uint64) * powers(int(_ODD), size)[: len(codes)])])
    back = powers(pow(int(_ODD), -1, 1 << 64), size)
    return mix((sums[stop] - sums[first]) * back[first] ^ mix((stop - first).astype(np.uint64))), first, stop


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of a text, with A-Z lower-cased."""
    data = np.frombuffer(text.encode("utf-8").lower() + b" ", np.uint8)
    parts, at = [], 0
    while at < len(data):  # a stretch at a time, each up to white space
        end = min(len(data), at + STRETCH)
        while end < len(data) and not (data[end - 1] == 32 or 9 <= data[end - 1] <= 13):
            end += 1
        part = data[at:end]
        parts.append(run_hashes(part, (part != 32) & ((part < 9) | (part > 13)))[0])
        at = end
    return np.concatenate(parts)


def shingle_set(text: str, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the lower-cased text's shingles."""
    h = word_hashes(text)
    if not len(h):
        return h
    n = max(1, len(h) - size + 1)
    out = np.full(n, min(size, len(h)), np.uint64)
    for k in range(min(size, len(h))):
        out = mix((out ^ h[k : k + n]) * _ODD + np.uint64(k))
    return np.unique(out)


def super_minhash(elements: np.ndarray, owner: np.ndarray, n_sets: int, m: int) -> np.ndarray:
    """Signatures (``n_sets`` by ``m``) of sets given as flat ``elements`` with their set's number.

    Element by element, step j draws a rank and swaps it into place j of a permutation of 0..m-1;
    the place drawn gets j plus a uniform fraction if that is less than what it has.  All elements
    take a step together; a set stops once all of its values are below the next step.
    """
    sig = np.full((n_sets, m), float(m), np.float64)
    flat = sig.reshape(-1)
    place = np.broadcast_to(np.arange(m, dtype=np.uint16), (len(elements), m)).copy()
    active = np.arange(len(elements))
    for j in range(m):
        seeds = mix(elements[active] + np.uint64((j + 1) * int(_ODD) & MASK))
        fraction = (seeds >> np.uint64(11)).astype(np.float64) / float(1 << 53)
        k = j + ((mix(seeds) >> np.uint64(32)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        drawn = place[active, k]
        place[active, k] = place[active, j]
        np.minimum.at(flat, owner[active] * m + drawn, fraction + j)
        going = sig.max(1) >= j + 1
        active = active[going[owner[active]]]
        if not len(active):
            break
    return sig


def signatures(sets: list[np.ndarray], m: int, together: int = 30_000) -> np.ndarray:
    """Signatures of sets, ``together`` elements at a time: that of a union is the least of its parts'."""
    sig = np.full((len(sets), m), float(m))
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    for at in range(0, len(flat), together):
        own = owner[at : at + together]
        low, high = own[0], own[-1] + 1
        sig[low:high] = np.minimum(sig[low:high], super_minhash(flat[at : at + together], own - low, high - low, m))
    return sig


def _signatures(shingle: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle) for t in batch.column(1)]
            sig = signatures(sets, bands * rows).view(np.uint64).reshape(len(sets), bands, rows)
            keys = np.broadcast_to(np.arange(bands, dtype=np.uint64) * _ODD, (len(sets), bands)).copy()
            for r in range(rows):
                keys = mix(keys ^ sig[:, :, r]) * _ODD
            n = np.array([len(s) for s in sets], np.int64)
            d1 = np.array([int(np.add.reduce(mix(s))) for s in sets], np.uint64).view(np.int64)
            d2 = np.array([int(np.add.reduce(mix(s ^ _ODD))) for s in sets], np.uint64).view(np.int64)
            band = pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).reshape(-1)), bands).cast(pa.list_(pa.int64()))
            yield pa.record_batch([batch.column(0), pa.array(n), pa.array(d1), pa.array(d2), band], ["doc_id", "n", "d1", "d2", "bands"])

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle).view(np.int64) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "elements"])

    return run


def _block_links(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """A spanning forest of the links between the ``left`` and the other rows of one pair of blocks."""
    frame = frame.drop_duplicates(["doc_id", "left"]).sort_values(["left", "doc_id"])
    sets = frame["elements"].to_list()
    n_left = len(frame) - int(frame["left"].sum())  # the rows of the other side come first
    ids = frame["doc_id"].to_list()
    if not n_left or n_left == len(ids):
        return pd.DataFrame({"u": [], "v": []}, dtype="int64")
    sizes = np.array([len(s) for s in sets])
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    other = row < n_left
    shared = np.intersect1d(code[other], code[~other])  # what only one side has adds nothing
    common = np.zeros((n_left, len(ids) - n_left), np.float32)
    for at in range(0, len(shared), 4096):
        part = shared[at : at + 4096]
        spot = np.searchsorted(part, code)
        hit = (spot < len(part)) & (part[np.minimum(spot, len(part) - 1)] == code)
        table = np.zeros((len(ids), len(part)), np.float32)
        table[row[hit], spot[hit]] = 1
        common += table[:n_left] @ table[n_left:].T
    inter = common.astype(np.int64)
    a, b = np.nonzero(100 * inter >= percent * (sizes[:n_left, None] + sizes[None, n_left:] - inter))
    groups, out = UnionFind(), []
    for x, y in zip(a.tolist(), b.tolist()):
        u, v = ids[x], ids[n_left + y]
        if u != v and groups.union(u, v):
            out.append((u, v))
    return pd.DataFrame(out, columns=["u", "v"], dtype="int64")


def near_duplicates(spark: SparkSession, docs: DataFrame, percent: int = 85, shingle: int = 5, bands: int = 32, rows: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, text_class`` per document; ``percent`` is the least Jaccard similarity that links.

    The defaults of ``bands`` and ``rows`` are for ``percent >= 80``.
    """
    ws = Workspace(spark)
    docs = texts(docs, id_col, text_col)
    per_doc = ws.table(docs.mapInArrow(_signatures(shingle, bands, rows), "doc_id long, n long, d1 long, d2 long, bands array<long>"), "signatures")
    same = per_doc.where("n > 0").groupBy("n", "d1", "d2").agg(F.min_by("bands", "doc_id").alias("bands"), F.min("doc_id").alias("rep"))
    reps = ws.table(same, "texts")

    keyed = reps.select(F.col("rep"), F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("rep").alias("least"), F.count("*").alias("size")).where("size > 1")
    ties = ws.table(keyed.join(buckets, "key").groupBy("rep", "least").agg(F.sum("size").alias("size")), "ties")
    roots = connected_components(ws, ties.select("rep", "least"))
    centrality = ties.groupBy("rep").agg(F.sum("size").alias("weight"))
    family = centrality.join(roots, centrality.rep == roots.node, "left").select("rep", F.coalesce("root", "rep").alias("family"), "weight")
    family = ws.table(family, "families")
    ws.drop(roots)
    # The centre: the fullest buckets, the least id of several.
    centres = family.groupBy("family").agg(F.max(F.struct("weight", (-F.col("rep")).alias("minus"))).alias("c"), F.count("*").alias("members"))
    centres = centres.select("family", (-F.col("c.minus")).alias("centre"), "members")

    members = docs.join(family.select(F.col("rep").alias("doc_id"), "family"), "doc_id").dropDuplicates(["doc_id"])
    sets = members.select("doc_id", "text").mapInArrow(_sets(shingle), "doc_id long, elements array<long>")
    sets = ws.table(sets.join(family.select(F.col("rep").alias("doc_id"), "family"), "doc_id"), "sets")
    heads = sets.join(centres.withColumnRenamed("centre", "doc_id").drop("family"), "doc_id").select("family", "members", F.col("doc_id").alias("centre"), F.col("elements").alias("head"))
    common = F.size(F.array_intersect("elements", "head"))
    total = F.size("elements") + F.size("head")
    star = sets.join(heads, "family").where("doc_id <> centre").select("family", "doc_id", "centre", "members", F.size("elements").alias("n"), F.size("head").alias("n_head"), (common * 100 >= (total - common) * percent).alias("linked"))
    star = ws.table(star, "star")

    # What the centre left open, against the rest of the family, block by block.
    open_size = F.sum(F.when(~F.col("linked"), F.col("n")).otherwise(0))
    rest = star.groupBy("family").agg(open_size.alias("open"), (F.sum("n") + F.max("n_head")).alias("all"), F.max("members").alias("members")).where("open > 0 and members > 2")
    rest = rest.select("family", F.ceil(F.col("open") / BLOCK).cast("int").alias("n_left"), F.ceil(F.col("all") / BLOCK).cast("int").alias("n_right"))
    pool = star.join(rest, "family").join(sets.drop("family"), "doc_id")
    left, right = F.pmod(F.xxhash64("doc_id"), "n_left").cast("int"), F.pmod(F.xxhash64("doc_id", F.lit(1)), "n_right").cast("int")
    pool = pool.select("family", "doc_id", "elements", "linked", "n_left", "n_right", left.alias("l"), right.alias("r"))
    as_left = pool.where("not linked").select("family", "doc_id", "elements", F.lit(True).alias("left"), "l", F.explode(F.sequence(F.lit(0), F.col("n_right") - 1)).alias("r"))
    as_right = pool.select("family", "doc_id", "elements", F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0), F.col("n_left") - 1)).alias("l"), "r")
    blocks = as_left.unionByName(as_right)
    found = blocks.groupBy("family", "l", "r").applyInPandas(lambda frame: _block_links(frame, percent), "u long, v long")
    links = ws.table(found.union(star.where("linked").select("centre", "doc_id")), "links")
    ws.drop(family, sets, star, ties)

    group = connected_components(ws, links)
    class_of = reps.join(group, reps.rep == group.node, "left").select("n", "d1", "d2", F.col("rep").alias("text_class"), F.coalesce("root", "rep").alias("component_id"))
    out = per_doc.drop("bands").join(class_of, ["n", "d1", "d2"], "left")
    component = F.coalesce("component_id", "doc_id")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (component == F.col("doc_id")).alias("kept"), F.coalesce("text_class", "doc_id").alias("text_class"))
    out = ws.table(out, "result")
    ws.drop(per_doc, reps, links, group)
    return out
