"""Benchmark decontamination: a BM25 inverted index of test items, block-max WAND, question and answer overlap.

The test items are the indexed side.  Spark counts document frequencies, lengths and every item's term
weights over all items; a weight is divided by its item's score against itself, so one threshold holds for
all items.  An index holds the postings of a bounded share of the items (``slice_postings``): for each
term its items and weights, cut into blocks of ``ITEMS_PER_BLOCK`` items with the greatest weight in each,
and its greatest weight of all.  The statistics are those of all items, so slices change no result.

Every training passage (windows of twice the longest item, overlapping by half, over whole texts) is a
query; the passages of a batch are searched together:

1. A passage's terms are ordered by their greatest weight.  The least of them, up to half the threshold
   together, are skipped: an item needs another half from the terms behind this pivot.
2. Only these terms' blocks are visited.  A block whose maxima, with all that was skipped, stay below the
   threshold is passed over; in the others the same bound is taken item by item.
3. What is left is scored exactly, and all items at or above the threshold are retrieved.

A retrieved item counts when the passage holds at least ``overlap`` of the 5-word shingles of its
question (all but the last line or sentence) and of its answer (the last).

Edge cases: items without words match nothing; an item of one sentence is its own question and
answer; parts of fewer than five words are one shingle; null and empty texts have no passages;
repeated documents or items give one row per distinct pair of ids; of equal scores the first passage counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, texts

ITEMS_PER_BLOCK = 8
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
SHINGLE = 5


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    parts = [p for p in text.strip().split("\n") if words(p)]
    if len(parts) < 2:
        parts = [p for p in _SENTENCE.split(text.strip()) if words(p)]
    if len(parts) < 2:
        return words(text), words(text)
    return words(" ".join(parts[:-1])), words(parts[-1])


def shingles(tokens: list[str]) -> set[tuple[str, ...]]:
    n = min(SHINGLE, len(tokens))
    return {tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1)} if n else set()


def held(part: list[str], passage: list[str]) -> float:
    """The share of ``part``'s shingles that ``passage`` holds."""
    want = shingles(part)
    n = min(SHINGLE, len(part))
    have = {tuple(passage[i : i + n]) for i in range(len(passage) - n + 1)}
    return len(want & have) / len(want) if want else 0.0


class WandIndex:
    """Postings of ``(item id, text, {term: weight})`` rows.

    ``starts[t]:starts[t + 1]`` are the blocks of term t in ``blocks``, with their maxima in ``best``.
    """

    def __init__(self, items: list[tuple[int, str, dict[str, float]]]):
        items = sorted(items, key=lambda x: (x[0], x[1]))
        self.ids, self.parts = [i for i, _, _ in items], [question_and_answer(t) for _, t, _ in items]
        self.weights = [w for _, _, w in items]
        self.terms = {t: k for k, t in enumerate(sorted({t for w in self.weights for t in w}))}
        postings = sorted((self.terms[t], k, x) for k, w in enumerate(self.weights) for t, x in w.items())
        term, self.items = (np.array([p[c] for p in postings], np.int64) for c in (0, 1))
        self.values, block = np.array([p[2] for p in postings]), self.items // ITEMS_PER_BLOCK
        self.n_blocks = -(-len(items) // ITEMS_PER_BLOCK) or 1
        first = np.flatnonzero(np.diff(term * self.n_blocks + block, prepend=-1))
        self.blocks = block[first]
        self.best = np.maximum.reduceat(self.values, first) if postings else np.zeros(0)
        self.postings = np.append(first, len(postings))
        self.starts = np.searchsorted(term[first], np.arange(len(self.terms) + 1))
        self.greatest = np.maximum.reduceat(self.best, self.starts[:-1]) if postings else np.zeros(0)

    def search(self, owner: np.ndarray, term: np.ndarray, threshold: float) -> Iterator[tuple[int, int, float]]:
        """``passage, item, score`` of all at or above the threshold, from distinct (passage, term) pairs."""
        if not len(owner):
            return
        least = threshold - 1e-9
        most = self.greatest[term]
        order = np.lexsort((most, owner))
        owner, term, most = owner[order], term[order], most[order]
        begins = np.flatnonzero(np.diff(owner, prepend=-1))
        each = np.diff(np.append(begins, len(owner)))
        total = np.cumsum(most)
        within = total - np.repeat(total[begins] - most[begins], each)
        behind = within >= least / 2  # at or behind the pivot
        skipped = np.bincount(owner[~behind], most[~behind], owner[-1] + 1)
        o, t = owner[behind], term[behind]
        count = self.starts[t + 1] - self.starts[t]
        at = np.repeat(self.starts[t] - np.cumsum(count) + count, count) + np.arange(count.sum())
        query = np.repeat(o, count)
        places, which = np.unique(query * self.n_blocks + self.blocks[at], return_inverse=True)
        bound = np.bincount(which, self.best[at], len(places)) + skipped[places // self.n_blocks]
        open_ = (bound >= least)[which]  # in these blocks, the same bound item by item
        query, at = query[open_], at[open_]
        count = self.postings[at + 1] - self.postings[at]
        at = np.repeat(self.postings[at] - np.cumsum(count) + count, count) + np.arange(count.sum())
        places, which = np.unique(np.repeat(query, count) * len(self.ids) + self.items[at], return_inverse=True)
        bound = np.bincount(which, self.values[at], len(places)) + skipped[places // len(self.ids)]
        spans = dict(zip(owner[begins].tolist(), zip(begins.tolist(), (begins + each).tolist())))
        names = list(self.terms)
        for place in places[bound >= least].tolist():
            passage, k = divmod(place, len(self.ids))
            a, b = spans[passage]
            known = {names[x] for x in term[a:b].tolist()}
            score = sum(x for w, x in self.weights[k].items() if w in known)
            if score >= least:
                yield passage, k, score


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [words(t) for t in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))], ["item_id", "text", "words"])


def weighted_items(ws: Workspace, items: DataFrame, k1: float, b: float) -> tuple[DataFrame, int, int]:
    """``item, item_id, text, weights`` of all items (``doc_id, text``), the words of the longest, and how many postings there are."""
    tokens = items.mapInArrow(_words, "item_id long, text string, words array<string>").where(F.size("words") > 0)
    tokens = ws.table(tokens.withColumn("item", F.xxhash64("item_id", "text")), "items")
    whole = tokens.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean"), F.max(F.size("words")).alias("span")).first()
    counts = tokens.select("item", F.size("words").alias("size"), F.explode("words").alias("w")).groupBy("item", "size", "w").agg(F.count("*").alias("f"))
    counts = ws.table(counts, "counts")
    idf = F.log(1 + (whole.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    among = counts.groupBy("w").agg(F.count("*").alias("df")).select("w", idf.alias("idf"))
    raw = F.col("idf") * F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("size") / F.lit(whole.mean)))
    # An item has as many terms as it has words at most.
    lists = counts.join(among, "w").groupBy("item").agg(F.collect_list(F.struct("w", raw.alias("x"))).alias("all"), F.sum(raw).alias("whole"))
    weights = F.map_from_entries(F.transform("all", lambda p: F.struct(p["w"], p["x"] / F.col("whole")))).alias("weights")
    out = ws.table(tokens.drop("words").join(lists.select("item", weights), "item"), "weights")
    return out, whole.span or 0, counts.count()


def _scan(shared, span: int, threshold: float, overlap: float):
    names = ["doc_id", "item_id", "word_start", "score", "question_overlap", "answer_overlap"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        get = index.terms.get
        for batch in batches:
            docs, out = batch.column(0).to_pylist(), []
            at: list[tuple[int, int, list[str]]] = []  # document, first word and words of each passage
            pairs: list[np.ndarray] = []

            def search():
                if not pairs:
                    return
                pair = np.concatenate(pairs)
                for p, item, score in index.search(pair >> 32, pair & 0xFFFFFFFF, threshold):
                    k, begin, passage = at[p]
                    question, answer = index.parts[item]
                    q, a = held(question, passage), held(answer, passage)
                    if q >= overlap and a >= overlap:
                        out.append((docs[k], index.ids[item], begin, round(score, 6), q, a))
                at.clear(), pairs.clear()

            for k, text in enumerate(batch.column(1)):
                tokens = words(text.as_py())
                ids = np.array([get(w, -1) for w in tokens], np.int64)
                for begin in range(0, max(len(ids) - span, 1), span):
                    part = np.unique(ids[begin : begin + 2 * span])
                    part = part[part >= 0]
                    if len(part):
                        pairs.append(part | (len(at) << 32))
                        at.append((k, begin, tokens[begin : begin + 2 * span]))
                    if len(at) == 1024:
                        search()
            search()
            yield pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*out) if out else [[]] * 6, kinds)], names)

    return run


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.6, overlap: float = 0.8, k1: float = 1.2, b: float = 0.75, slice_postings: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, word_start, score, question_overlap, answer_overlap``: the best passage of each pair."""
    spark = docs.sparkSession
    ws = Workspace(spark)
    base = texts(docs, id_col, text_col)
    weighted, span, postings = weighted_items(ws, texts(items, item_id_col, item_text_col).dropDuplicates(), k1, b)
    slices = -(-postings // slice_postings) or 1
    schema = "doc_id long, item_id long, word_start long, score double, question_overlap double, answer_overlap double"
    found = None
    for k in range(slices):  # each slice is bounded; one is the rule
        rows = weighted.where(F.pmod("item", F.lit(slices)) == k).select("item_id", "text", "weights").collect()
        shared = spark.sparkContext.broadcast(WandIndex([tuple(r) for r in rows]))
        part = base.mapInArrow(_scan(shared, max(1, span), threshold, overlap), schema)
        if slices > 1:
            part = ws.table(part, "found")
            shared.unpersist()
        found = part if found is None else found.union(part)
    best = F.max(F.struct("score", (-F.col("word_start")).alias("minus"), "question_overlap", "answer_overlap")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("b.minus")).alias("word_start"), "b.score", "b.question_overlap", "b.answer_overlap")
