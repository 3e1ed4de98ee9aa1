"""Each operator against a plain version on small inputs, with the edge cases that its docstring names."""

import hashlib
import random
import uuid
import zlib

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomledger.llm import align, decontaminate, lines, minhash, packing, pii, pitman_yor, quality, repair, suffix_dedup, token_counts, token_file, warc
from loomledger.llm.common import Workspace
from loomledger.llm.components import connected_components
from loomledger.llm.encoding import ChunkEncoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")


def prose(n, seed, vocabulary=400):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgiklmnoprstuvé") for _ in range(r.randint(2, 9))) for _ in range(vocabulary)]
    return " ".join(r.choice(words) for _ in range(n))


def corpus():
    r = random.Random(5)
    long = prose(300, 1)
    copies = []
    for k in range(150):  # a large group of near copies, in a chain of more and more changes
        words = long.split()
        for _ in range(k % 12):
            words[r.randrange(len(words))] = "Other"
        copies.append(" ".join(words))
    shared = prose(90, 2)
    odd = [None, "", "   \n\t ", "one two", "one two", "One TWO", "a\x0bb\x0cc", "é è 中文 ~ !!", "x" * 1200, "ab" * 900, prose(9000, 3)]
    mixed = [f"{prose(40 + k, 100 + k)}\n{shared if k % 3 == 0 else ''}\n{prose(30, 200 + k)}" for k in range(40)]
    texts = copies + odd + mixed + [mixed[0], mixed[1] + " end"]
    return list(enumerate(texts, 1))


@pytest.fixture(scope="module")
def docs():
    return corpus()


def frame(spark, docs, extra=True):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    if extra:  # columns whose names clash with the operators' own
        for c in ("h", "n", "key", "shard", "bands", "w", "kept", "start", "line_no"):
            df = df.withColumn(c, F.lit(None).cast("string"))
    return df


def by_id(df, *columns):
    return {r[0]: tuple(r)[1:] for r in df.select("doc_id", *columns).collect()}


def test_minhash(spark, docs):
    got = by_id(minhash.near_duplicates(spark, frame(spark, docs)), "n_shingles", "component_id", "kept")
    assert got == brute.near_duplicates(docs)


def test_signature_estimates_similarity():
    r = np.random.default_rng(1)
    common, a, b = (r.integers(0, 1 << 63, n, dtype=np.uint64) for n in (600, 200, 200))
    sets = [np.concatenate([common, a]), np.concatenate([common, b])]
    sig = minhash.super_minhash(np.concatenate(sets), np.repeat([0, 1], 800), 2, 256)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.09


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(0, k) for k in range(1000, 1200)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = connected_components(Workspace(spark), spark.createDataFrame(edges, "a long, b long"))
    assert {x[0]: x[1] for x in got.collect()} == {x: find(x) for x in parent if find(x) != x}


def test_quality_base(spark, docs):
    got = by_id(quality.clean(frame(spark, docs)), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == {d: brute.base_quality(t) for d, t in docs}


def test_quality_verdicts_against_plain_rules(spark, docs):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = docs + [(10_000 + k, t) for k, t in table]
    got = by_id(quality.clean(frame(spark, rows)), "clean_text", "kept")
    want = {d: brute.quality(t) for d, t in rows}
    assert got == want and 0 < sum(k for _, k in want.values()) < len(want)


def test_quality_lines(spark):
    good = "The council met on Tuesday and agreed to repair the old bridge before winter comes."
    other = "Traffic will use the ferry until the first lorries can cross in March."
    text = f"Home | News | Sport | Weather\n{good}\nshort line\n© 2020 All rights reserved.\n{other}"
    rows = quality.clean(frame(spark, [(1, text), (2, "menu | a | b\n" * 8 + "x y z"), (3, None)])).collect()
    found = {r.doc_id: r for r in rows}
    assert found[1].kept and found[1].clean_text == f"{good}\n{other}"
    assert not found[2].kept and not found[3].kept


def test_quality_loss_counts_boilerplate(spark):
    good = "The council met on Tuesday and agreed to repair the old bridge before winter comes."
    page = "\n".join([f"{prose(10, 300 + k)} privacy policy {prose(4, 400 + k)}." for k in range(12)] + [good])
    whole = f"{good}\nProgress in the design in question was slower than anyone had hoped for.\nThey put the backlog in order."
    rows = {r.doc_id: r for r in quality.clean(frame(spark, [(1, page), (2, whole)])).collect()}
    assert not rows[1].base_failed and rows[1].clean_text == good and not rows[1].kept
    assert rows[2].kept and rows[2].clean_text == whole


def test_quality_notices(spark):
    good = "The council met on Tuesday and agreed to repair the old bridge before winter comes."
    other = "Traffic will use the ferry until the first lorries can cross in March."
    notices = ["Tous droits réservés par la maison d'édition de la ville.", "Alle Rechte vorbehalten, auch die der Übersetzung.", "Copyright 2019 by the bridge office of the county.", "https://example.org/a", "Seite 3 von 12", "Todos los derechos reservados por la ciudad."]
    kept = ["In 2019 they had 3 of 12 votes for the new copyright law.", "See https://example.org/a for the plans of the bridge."]
    text = "\n".join([good, *notices, other, *kept, good + " Again.", other + " Again."])
    (row,) = quality.clean(frame(spark, [(1, text)])).collect()
    assert row.clean_text == "\n".join([good, other, *kept, good + " Again.", other + " Again."])


def test_token_file(spark, docs, tmp_path):
    path = str(tmp_path / "ids")
    token_file.write_token_file(spark, frame(spark, docs), path, WORD)
    got = {r.doc_id: r for r in token_file.read_token_file(spark, path, with_ids=True).collect()}
    t, start = Tokenizer.from_file(WORD), 0
    for d, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        r = got[d]
        assert (r.start, r.n_tokens, r.ids) == (start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    asked = spark.createDataFrame([(d,) for d in range(0, len(docs) + 9, 3)] + [(3,), (None,)], "doc_id long")
    some = token_file.read_documents(spark, path, asked).collect()
    assert sorted(r.doc_id for r in some) == [d for d, _ in docs if d % 3 == 0]
    assert all(r.ids == got[r.doc_id].ids for r in some)


def test_code_lengths():
    r = np.random.default_rng(3)
    counts = (r.pareto(0.6, 3000) * 5).astype(np.int64)
    lengths = token_file.code_lengths(counts)
    used = counts > 0
    assert (lengths[used] > 0).all() and lengths.max() <= token_file.MAX_BITS
    assert sum(2.0 ** -lengths[used].astype(float)) <= 1
    p = counts[used] / counts.sum()
    assert (p * lengths[used]).sum() < -(p * np.log2(p)).sum() + 1


def test_line_dedup(spark):
    a, b = prose(30, 1) + ".", prose(30, 2) + "."
    docs = [(1, f"{a}\n{b}"), (2, f"{a}\nown words here"), (3, f"{a.upper()}\n\n--\n--"), (4, f"{b} 12\n{b} 77"), (5, None), (6, "own words here")]
    got = by_id(lines.dedup_lines(spark, frame(spark, docs)), "n_lines", "n_removed", "clean_text")
    assert got[1] == (2, 0, f"{a}\n{b}")
    assert got[2] == (2, 1, "own words here") and got[3] == (4, 1, "\n--\n--")
    assert got[4][:2][0] == 2 and got[4][1] >= 1  # two lines that differ in digits only
    assert got[5] == (1, 0, "") and got[6] == (1, 1, "")


def test_line_dedup_finds_changed_words(spark):
    """One word changed in lines of 6 to 40 words, and several in long ones."""
    r, docs = random.Random(11), []
    for k in range(70):
        words = prose(6 + k % 35, 900 + k).split()
        changed = list(words)
        for _ in range(1 + len(words) // 20):
            changed[r.randrange(len(words))] = "other"
        docs += [(2 * k + 1, f"{' '.join(words)}\nown {k}"), (2 * k + 2, " ".join(changed))]
    want = brute.line_dedup(docs)
    assert sum(n for _, n, _ in want.values()) > 90
    assert by_id(lines.dedup_lines(spark, frame(spark, docs)), "n_lines", "n_removed", "clean_text") == want


@pytest.mark.parametrize("similarity", [0.8, 0.95])
def test_similar_lines(spark, similarity):
    r = random.Random(7)
    pairs = []
    for k in range(60):
        a = "".join(r.choice("abc ") for _ in range(r.choice([0, 5, 40, 400])))
        b = "".join(c if r.random() > k / 150 else r.choice("xyz") for c in a)
        pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a string, b string")
    rows = df.select(lines.within(F.col("a"), F.col("b"), F.floor(F.greatest(F.length("a"), F.length("b")) * (1 - similarity) + 1e-9).cast("int")).alias("s"), F.levenshtein("a", "b").alias("d"), F.greatest(F.length("a"), F.length("b")).alias("n")).collect()
    assert all(x.s == (x.d <= int(x.n * (1 - similarity) + 1e-9)) for x in rows)


def test_edit_distances():
    r, pairs = random.Random(8), [("", ""), ("", "abc"), ("abc", ""), ("a" * 64, "a" * 64), ("a" * 65, "b" * 64), ("é中" * 70, "中é" * 64)]
    for _ in range(150):
        a = "".join(r.choice("abc ") for _ in range(r.choice([1, 40, 63, 64, 65, 128, 200])))
        pairs.append((a, "".join(r.choice("xyz") if r.random() < 0.2 else c * r.choice([0, 1, 1, 1, 2]) for c in a)))
    for a, b in pairs:
        assert brute.edit_distance(*lines.without_common_ends(a, b)) == brute.edit_distance(a, b)
    assert lines.edit_distances(*map(list, zip(*pairs))).tolist() == [brute.edit_distance(a, b) for a, b in pairs]


def test_no_similar_pair_is_ruled_out():
    r, pairs = random.Random(8), [("", ""), ("", "abc"), ("abc", "abc"), ("a" * 64, "a" * 64)]
    for k in range(200):
        a = "".join(r.choice("abcdé ") for _ in range(r.choice([1, 3, 40, 200])))
        pairs.append((a, "".join(r.choice("xyz") if r.random() < k / 600 else c * r.choice([0, 1, 1, 1, 1, 1, 1, 2]) for c in a)))
    may = lines.may_be_similar(*map(list, zip(*pairs)), 0.8)
    true = [brute.edit_distance(a, b) <= int(max(len(a), len(b)) * 0.2 + 1e-9) for a, b in pairs]
    assert sum(true) > 40 and all(m for m, t in zip(may, true) if t)
    assert not lines.may_be_similar([prose(50, 1)], [prose(50, 2)], 0.8)[0]


def test_suffix_dedup(spark, docs):
    got = by_id(suffix_dedup.remove_repeats(spark, frame(spark, docs)), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.repeats(docs)


def test_suffix_order():
    r = random.Random(4)
    base = bytes(r.choice(b"ab") for _ in range(900))
    group = [suffix_dedup.Suffix(base[k:700] + bytes([r.choice(b"ab")]) * 50, 300 - k, 5, (k, 0, 1)) for k in range(20)]
    for x in group:
        for y in group:
            p, q = x.data[x.anchor :], y.data[y.anchor :]
            n = next((i for i, (a, b) in enumerate(zip(p, q)) if a != b), min(len(p), len(q)))
            assert suffix_dedup.extension(x, y, True) == n


def test_decontamination(spark):
    items = [(k, f"{prose(30, 500 + k)}?\n{prose(12, 600 + k)}.") for k in range(25)]
    docs = [(1, prose(200, 1)), (2, f"{prose(700, 2)}\n{items[3][1]}\n{prose(300, 3)}"), (3, items[4][1].split("\n")[0]), (4, None), (5, items[7][1].upper())]
    got = decontaminate.contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(2, 3), (5, 7)}


@pytest.mark.parametrize("slice_postings", [1 << 20, 90])
def test_decontamination_equals_plain_bm25(spark, slice_postings):
    """The same rows whatever the slices of the index, and those of a plain BM25 over all items."""
    items = [(k, f"{prose(6 + k % 20, 500 + k, 60)}?\n{prose(4, 600 + k, 60)}.") for k in range(30)] + [(40, None), (41, "?!"), (3, f"{prose(9, 503, 60)}?\n{prose(4, 603, 60)}.")]
    docs = [(k, f"{prose(60, k, 60)} {items[k % 30][1] if k % 3 else ''} {prose(90, 90 + k, 60)}") for k in range(40)] + [(50, None), (51, ""), (52, " ".join(t for _, t in items[:25]))]
    docs.append(docs[4])
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1)).withColumn("weights", F.lit(2))
    got = decontaminate.contaminated(frame(spark, docs), table, threshold=0.5, overlap=0.3, slice_postings=slice_postings)
    rows = {(r.doc_id, r.item_id): (r.word_start, round(r.score, 5), r.question_overlap, r.answer_overlap) for r in got.collect()}
    assert rows == brute.contaminated(docs, items, 0.5, 0.3) and len(rows) > 20


def test_language_model(spark, docs):
    got = by_id(pitman_yor.score_documents(spark, frame(spark, docs)), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    for d, (held, n, known, train, base) in brute.unigram(docs).items():
        assert got[d][:4] == (held, n, known, train)
        assert got[d][4] == pytest.approx(base)
        assert got[d][5] < 0
    held = [v for v in got.values() if v[0] and v[1] > 20]
    assert sum(v[5] for v in held) > sum(v[4] for v in held)  # better than the smoothed unigram


def test_predictive_probabilities_sum_to_one():
    r, prior = np.random.default_rng(1), pitman_yor.Prior()
    counts = r.poisson(0.7, (200, pitman_yor.CLASSES)).astype(float)
    counts[counts.sum(1) == 0, 0] = 1
    words = pitman_yor.Words(counts, np.arange(200, dtype=np.uint64), 200, prior)
    history, customers = [words.totals()], counts.sum(0)
    for k in range(2):
        words.sweep(history[-1], k)
        history.append(words.totals())
    whole = words.predictive(history[-1], customers).sum(0) + pitman_yor.unknown_probability(history[-1:], customers, 200, prior)
    assert whole == pytest.approx(np.ones(pitman_yor.CLASSES))


def test_packing(spark, docs):
    rows = packing.pack(spark, frame(spark, docs), BYTE).collect()
    t = Tokenizer.from_file(BYTE)
    ids = {d: np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4") for d, x in docs}
    bins, pieces = {}, {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for d, x in ids.items():
        own = sorted(pieces[d])
        assert [p[0] for p in own] == list(range(len(own))) and own[-1][1] + own[-1][2] == len(x)
        assert all(p[2] == 2048 for p in own[1:])
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(bins) <= len(brute.first_fit_decreasing([n for own in pieces.values() for _, _, n in own], 2048))


def test_token_counts(spark, docs):
    lengths = token_counts.encoded_lengths(frame(spark, docs), BYTE)
    table = token_counts.length_table(lengths).cache()
    t = Tokenizer.from_file(BYTE)
    n = sorted(len(t.encode(x or "", add_special_tokens=False).ids) for _, x in docs)
    for limit in (0, 1, 50, 2048, 10**6):
        assert token_counts.truncated_total(table, limit) == sum(min(x, limit) for x in n)
    assert token_counts.quantile(table, 0.5) == n[-(-len(n) // 2) - 1]
    for r in table.collect():
        assert (r.docs_longer, r.tokens_total, r.tokens_up_to) == (sum(x > r.n_tokens for x in n), sum(n), sum(x for x in n if x <= r.n_tokens))


def test_warc(spark, tmp_path):
    page = "<html>" + "x" * 120 + "</html>"
    pages = [(1, "http://a/x", "<p>short</p>"), (2, "http://a/y", page), (3, None, page), (4, "http://b", None), (5, "http://b", "<p>short</p>"), (6, "http://c", page + "\r\n\r\nWARC/1.1é")]
    path = str(tmp_path / "w")
    warc.write_warc(spark.createDataFrame(pages, "page_id long, url string, html string"), path)
    rows = {int(r.metadata.page_id): r for r in warc.assemble(warc.read_records(spark, path)).collect()}
    for p, (n, digest, kind, refers) in brute.captures([(p, h) for p, _, h in pages]).items():
        r = rows[p]
        assert (int(r.metadata.payload_bytes), r.payload_digest, r.record_type, r.original and int(r.original.page_id)) == (n, digest, kind, refers)
        assert r.request is not None and (r.payload is None) == (kind == "revisit")


@pytest.mark.parametrize("path, keeps_space", [(BYTE, True), (WORD, False)])
def test_encoder_equals_library(path, keeps_space):
    r = random.Random(3)
    parts = ["a", "B", " ", "\n", "\t", " ", "~", "!", "é", "中", "\x1c", "1", "'s", "<|endoftext|>", "\r", "\xa0", "  "]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    e = ChunkEncoder(path, keeps_space, cache_size=500)
    assert [np.frombuffer(x, e.dtype).tolist() for x in e.encode(texts)] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("path, keeps_space", [(BYTE, True), (WORD, False)])
def test_added_tokens_as_by_the_library(path, keeps_space):
    texts = ["x <|endoftext|> y", "plain words", "<|endoftext|>", "a<|startoftext|>b\n c", "<|endoftext|><|endoftext|>\n", "<|ENDOFTEXT|> <|endof text|>"]
    e, t = ChunkEncoder(path, keeps_space), Tokenizer.from_file(path)
    assert [np.frombuffer(x, e.dtype).tolist() for x in e.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_added_tokens_in_token_file(spark, tmp_path):
    texts = ["x <|endoftext|> y", "plain words", "<|startoftext|>a"]
    token_file.write_token_file(spark, frame(spark, list(enumerate(texts))), str(tmp_path / "ids"), WORD)
    t = Tokenizer.from_file(WORD)
    got = {r.doc_id: r.ids for r in token_file.read_token_file(spark, str(tmp_path / "ids"), with_ids=True).collect()}
    assert got == {k: [*t.encode(x, add_special_tokens=False).ids, 1] for k, x in enumerate(texts)}


def test_empty_tables(spark, tmp_path):
    none = frame(spark, [])
    assert minhash.near_duplicates(spark, none).count() == 0
    assert quality.clean(none).count() == 0
    token_file.write_token_file(spark, none, str(tmp_path / "t"), WORD)
    assert token_file.read_token_file(spark, str(tmp_path / "t")).count() == 0
    assert lines.dedup_lines(spark, none).count() == 0
    assert suffix_dedup.remove_repeats(spark, none).count() == 0
    assert decontaminate.contaminated(none, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert pitman_yor.score_documents(spark, none).count() == 0
    assert packing.pack(spark, none, BYTE).count() == 0
    assert token_counts.length_table(token_counts.encoded_lengths(none, BYTE)).count() == 0
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert warc.assemble(warc.read_records(spark, str(tmp_path / "w"))).count() == 0


def test_repeated_rows(spark):
    docs = [(1, prose(60, 1)), (1, prose(60, 1)), (2, prose(60, 1))]
    assert sorted(map(tuple, minhash.near_duplicates(spark, frame(spark, docs)).select("doc_id", "component_id").collect())) == [(1, 1), (1, 1), (2, 1)]
    assert pitman_yor.score_documents(spark, frame(spark, docs)).count() == 3
    assert packing.pack(spark, frame(spark, docs), BYTE).count() == 3
    kept = suffix_dedup.remove_repeats(spark, frame(spark, [(1, "q" * 400), (1, "q" * 400)])).collect()
    assert [r.n_removed for r in kept] == [400, 400] and kept[0].kept_sha256 == hashlib.sha256(b"").hexdigest()


ALIGNED = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_align_against_whole_texts(spark, docs, monkeypatch):
    odd = ["\n", "\n\na  b\n \nc\t\td", "▁ x", "<|endoftext|> <s> <0x41> <unk>", "a\0b c", "  at both ends  ", "日本語 テスト 😀😀 ok", "é" * 300, "😀" * 50, "a" * 70000, "w " * 30000 + "end", "\x1c a \x85 b", "a\r\n next", "don't we'll \nI'm"]
    rows = docs + list(enumerate(odd, 10_000)) + docs[:3] + [(10_001, "another text of this id")]
    want = sorted(brute.alignment(rows, BYTE, PIECE))
    for window in (align.WINDOW, 64):  # in one window, and through many
        monkeypatch.setattr(align.end_events, "__defaults__", (window,))
        got = sorted(tuple(r) for r in align.align(spark, frame(spark, rows), BYTE, PIECE).select("doc_id", *ALIGNED).collect())
        assert got == want


def test_align_groups_and_links_of_a_text(spark):
    rows = align.aligned_groups(frame(spark, [(1, "Unbelievable things happen"), (2, None)]), BYTE, PIECE).collect()
    encoder = align.pair_encoder(BYTE, PIECE)
    by = {r.doc_id: r for r in rows}
    assert by[2].groups == "" and by[2].pairs == []
    for group in by[1].groups.split(";"):
        a, b = (list(map(int, side.split(","))) for side in group.split("|"))
        assert b"".join(encoder.a_bytes[k] for k in a) == b"".join(encoder.b_bytes[k] for k in b)


def test_align_beyond_the_broadcast_and_empty(spark, docs, monkeypatch):
    want = sorted(brute.alignment(docs[:60], BYTE, PIECE))
    monkeypatch.setattr(align, "BROADCAST_PAIRS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = sorted(tuple(r) for r in align.align(spark, frame(spark, docs[:60]), BYTE, PIECE).select("doc_id", *ALIGNED).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == want
    assert align.align(spark, frame(spark, []), BYTE, PIECE).collect() == []


def turns(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    for c in ("there", "kind", "at", "phase", "copies", "seen"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    return df


def random_turns():
    r = random.Random(11)
    said = ["Yes.", "No!", "Why?", "  ", "", "cut off", "cut off ", "End.\n", None, "a.b", "?"]
    rows = []
    for conv in [*range(150), None]:
        for turn in range(r.randint(0, 9)):
            rows.append((conv, r.choice([turn, turn, turn, None, turn * 3]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), r.choice(said) if r.random() < 0.5 else f"Line {r.random()}."))
    return rows + [(7, 1, "user", "Same.")] * 40 + [(999, t, "user" if t % 2 else "assistant", f"Word {t % 50}.") for t in range(400)]


def test_repair_against_all_edits(spark):
    import sys

    sys.setrecursionlimit(10_000)
    rows = random_turns()
    want = sorted(brute.repaired(rows), key=str)
    out = repair.repair(repair.damage(turns(spark, rows)))
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, out.collect()), key=str) == want


def test_repaired_turns_are_well_formed(spark):
    import re

    found = {}
    for r in repair.repaired_turns(repair.damage(turns(spark, random_turns()))).collect():
        found.setdefault(r.conv_id, []).append(r)
    assert found
    for rows in found.values():
        rows.sort(key=lambda r: r.position)
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in rows))


def test_repair_of_dropped_and_empty_tables(spark):
    dropped = next((c, 0) for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    (row,) = repair.repair(repair.damage(turns(spark, [(*dropped, "user", "Hello.")]))).collect()
    assert tuple(row) == (dropped[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair.repair(repair.damage(turns(spark, []))).collect() == []


def personal_texts():
    """Personal data, near misses and their neighbours in all orders."""
    r = random.Random(3)
    parts = ["a.b@c.de", "x@y", "x@y..z", "a@b.c_d@e.f", "é@ü.de", "@a.b", "1.2.3.4.5.6.7.8", "300.1.2.3", "001.02.255.256", "1.2.3.0000255", "9" * 25 + ".1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112",
             "5500 0000 0000 0004 4111111111111111", "+1 (017) 555-7713", "+49 30 1234567 8", "+1", "+12", "+1 2345678 ) x", "+1234567890123456", "++12345678", "😀", "\n", "word", "12-", "  ", "12.5", "+7.(", "1" * 40]
    texts = [None, "", "plain words only"] + parts
    texts += [r.choice(["", " ", ", "]).join(r.choice(parts) for _ in range(r.randint(1, 9))) for _ in range(120)]
    return list(enumerate([*texts, "x" * 60000 + "@" + "a" * 60000, "a@b.cd " * 3000, "1 " * 9000, "+1" + " " * 20000, "1.2.3.4 " * 700]))


def test_pii_base_rules(spark):
    rows = personal_texts()
    out = pii.digest(pii.find(spark, frame(spark, rows + rows[:5])))
    assert out.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    got = out.collect()
    assert sorted(r.doc_id for r in got) == sorted(k for k, _ in rows + rows[:5])
    texts = dict(rows)
    for r in got:
        want = brute.personal(texts[r.doc_id])
        written = [f"{kind}:{a}:{b}" for kind, spans in want.items() for a, b in spans]
        assert tuple(r)[1:5] == tuple(map(len, want.values())), texts[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(written) <= set(spans)
        key = lambda s: (pii.KINDS.index(s.split(":")[0]), int(s.split(":")[1]))
        assert [key(s) for s in spans] == sorted(key(s) for s in spans)


def test_pii_adds_written_out_forms_and_leaves_other_numbers(spark):
    personal = [
        ("email", "write to ", "maria.lopez at example dot org"), ("email", "", "jo(at)mail.com"), ("email", "contact: ", "max [at] firma [dot] de"), ("ip", "server ", "10[.]0[.]12[.]7"), ("ip", "", "2001:db8:0:0:8a2e:370:7334:1"),
        ("card", "visa: ", "3782 822463 10005"), ("phone", "call ", "(212) 555-0147"), ("phone", "Tel: ", "0301/2345678"), ("card", "so ", "7536784127813050"),
    ]
    other = ["on 2024-01-15 at 12:30:45", "ISBN 978-3-16-148410-0", "order 84512345", "in 1990-1995 2000-2005 and", "the number 4845168114407320 here", "version 1.2.3.400", "meet at noon dot", "@handle", "12 @ 3.50", "10 000 000 people"]
    texts = [(k, f"{lead}{value}, und so weiter", lead, value, kind) for k, (kind, lead, value) in enumerate(personal)]
    rows = [(k, text) for k, text, *_ in texts] + list(enumerate(other, 100))
    found = pii.find(spark, frame(spark, rows))
    got = by_id(pii.digest(found), "spans")
    for k, _, lead, value, kind in texts:
        assert got[k] == (f"{kind}:{len(lead)}:{len(lead) + len(value)}",), value
    assert {k: got[k] for k, _ in enumerate(other, 100)} == {k: ("",) for k, _ in enumerate(other, 100)}
    clean = by_id(pii.redact(found), "text")
    assert clean[0] == ("write to [email], und so weiter",) and clean[100] == (other[0],)
    assert by_id(pii.redact(pii.find(spark, frame(spark, [(1, "a@b.cd or +1 (017) 555-7713!")]))), "text")[1] == ("[email] or [phone]!",)


def test_pii_held_out_accuracy(spark):
    trees, thresholds = pii._fitted(pii.EXAMPLES)
    rows = pii.labelled(spark, pii.EXAMPLES + 800).where(F.col("example") >= pii.EXAMPLES)  # written later than those that fitted
    score = F.expr(pii._score(trees)) >= F.get(F.array(*map(F.lit, thresholds)), "kind")
    for r in rows.groupBy("kind").agg(F.avg(F.when(score, F.col("label"))).alias("precision"), F.avg(F.when(F.col("label") == 1, score.cast("int"))).alias("recall")).collect():
        assert r.precision >= 0.95 and r.recall >= 0.9, r
    assert pii.digest(pii.find(spark, frame(spark, []))).collect() == []


def test_pii_runs_no_python(spark):
    plan = pii.digest(pii.find(spark, frame(spark, [(1, "a")])))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_repeated_rows_are_each_a_document(spark, docs, tmp_path):
    """op2, op3, op4 and op9: a row that stands twice gives what it gives once, twice; op4 keeps the same lines."""
    some = [x for x in docs[:12]] + docs[150:175]
    twice = some + some
    rows = lambda df, *c: sorted(map(str, df.select(*c).collect()))
    judged = ("doc_id", "n_words", "n_dup_lines", "kept", "clean_text")
    assert rows(quality.clean(frame(spark, twice)), *judged) == sorted(2 * rows(quality.clean(frame(spark, some)), *judged))
    cleaned = ("doc_id", "n_lines", "n_removed", "clean_text")
    assert rows(lines.dedup_lines(spark, frame(spark, twice)), *cleaned) == sorted(2 * rows(lines.dedup_lines(spark, frame(spark, some)), *cleaned))
    token_file.write_token_file(spark, frame(spark, twice), str(tmp_path / "ids"), WORD)
    back = token_file.read_token_file(spark, str(tmp_path / "ids")).collect()
    assert sorted(r.doc_id for r in back) == sorted(d for d, _ in twice)
    at = sorted((r.start, r.n_tokens) for r in back)
    assert [a for a, _ in at] == [sum(n for _, n in at[:k]) for k in range(len(at))]
    once, again = (token_counts.encoded_lengths(frame(spark, x), BYTE).count() for x in (some, twice))
    assert again == 2 * once


def test_captures_with_clashing_columns_and_ties(spark, tmp_path):
    """op10: pages with other columns, nulls and equal payloads; the smallest page is the response."""
    long = "<html>" + "x" * 200_000 + "</html>"
    pages = [(5, "u", long), (3, "u", long), (9, None, long), (4, "v", None), (6, "v", ""), (8, "w", "short")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for c in ("payload", "record_type", "metadata", "refers_to", "payload_digest", "h"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    warc.write_warc(df, str(tmp_path / "warc"))
    out = warc.assemble(warc.read_records(spark, str(tmp_path / "warc"))).collect()
    got = {int(r.metadata["page_id"]): (r.record_type, int(r.original["page_id"]) if r.original and r.original["page_id"] else None) for r in out}
    assert got == {p: ("revisit", 3) if p in (5, 9) else ("response", None) for p, *_ in pages}


def test_line_dedup_pairs_of_a_crowded_key_only(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(7))
    passage = " ".join(word() for _ in range(20))
    long = [passage + " " + " ".join(word() for _ in range(30)) for _ in range(500)]
    short = [f"{passage} {word()} {word()}" for _ in range(2)]  # similar to each other, to no long one; all that they share all have
    rows = list(enumerate(long + short))
    got = {x.doc_id: x.n_removed for x in lines.dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: int(k == 501) for k in range(502)}


@pytest.mark.parametrize("block", [256, 40])
def test_line_dedup_makes_no_rows_of_a_crowded_keys_pairs(spark, monkeypatch, block):
    """400 lines with one passage in common: no table grows with their square, and near copies among them are still found."""
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(2000)]
    text = {k: "passage in common of all " + " ".join(r.choice(words) for _ in range(r.choice([6, 9, 14]))) for k in range(400)}
    text |= {400 + k: text[k][:-1] + "0" for k in range(0, 400, 50)}
    made, table = [], Workspace.table

    def counted(ws, df, name):
        out = table(ws, df, name)
        made.append((name, out.count()))
        return out

    monkeypatch.setattr(Workspace, "table", counted)
    monkeypatch.setattr(lines, "BLOCK_LINES", block)
    got = {x.doc_id: x.n_removed for x in lines.dedup_lines(spark, spark.createDataFrame(list(text.items()), "doc_id long, text string")).collect()}
    assert {k for k, n in got.items() if n} == {k for k in text if k >= 400}
    assert max(n for _, n in made) < 20 * len(text), made


def test_bounded_edit_distances():
    """With a bound, distances up to it are exact and the others are over it, whatever the lengths."""
    r = random.Random(2)
    left, right = [], []
    for _ in range(300):
        x = [r.choice("abcdef ") for _ in range(r.choice([0, 1, 30, 63, 64, 65, 128, 129, 300]))]
        y = list(x)
        for _ in range(r.randrange(len(x) // 3 + 3)):
            y[(p := r.randrange(len(y) + 1)) : p + r.randrange(2)] = r.choice(["", "a", "f"])
        left.append("".join(x)), right.append("".join(y))
    exact = np.array([brute.edit_distance(x, y) for x, y in zip(left, right)])
    for share in (0.05, 0.2, 0.5):
        allowed = lines.allowed_edits(np.array([max(len(x), len(y)) for x, y in zip(left, right)]), 1 - share)
        got = lines.edit_distances(left, right, allowed)
        assert ((got <= allowed) == (exact <= allowed)).all() and (got[exact <= allowed] == exact[exact <= allowed]).all()


def test_unlike_lines_are_ruled_out_together(monkeypatch):
    """Few pairs of unlike lines with a passage in common are looked at one by one, and the answers are those of plain distances."""
    r, left, right = random.Random(4), [], []
    for k in range(900):
        passage, x, y = prose(4, k % 7), prose(25 + k % 9, 3 * k), prose(25 + k % 9, 3 * k + 1)
        if k % 30 == 0:
            y = "".join(c if r.random() > k / 3000 else r.choice("é中x ") for c in x)
        left.append(f"{passage} {x}"), right.append(f"{passage} {y}")
    looked, one = [], lines.are_similar
    monkeypatch.setattr(lines, "are_similar", lambda *pair: looked.append(pair) or one(*pair))
    got = lines.similar_pairs(left, right, 0.8).tolist()
    assert got == [brute.edit_distance(x, y) <= int(max(len(x), len(y)) * 0.2 + 1e-9) for x, y in zip(left, right)]
    assert sum(got) >= 10 and len(looked) < 300


def test_distances_of_long_lines():
    r = random.Random(6)
    x = "".join(r.choice("abcdefgh ") for _ in range(30_000))
    y = x[:100] + "changed" + x[100:15_000] + x[15_020:]
    assert lines.edit_distance(x, y, 6_000) == 27 and lines.are_similar(x, y, 0.8)
    assert lines.edit_distance(x, x[::-1], 3_000) > 3_000 and not lines.are_similar(x, x[::-1], 0.8)


def test_line_dedup_shuffles_a_bounded_share_at_a_time(spark, monkeypatch, tmp_path):
    """Blocks of a crowded key's texts go to tasks in rounds of about half of the corpus, rows of keys in slices; the result is the same."""
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    text = {k: "passage in common of all " + " ".join(word() for _ in range(r.choice([6, 9, 14]))) for k in range(400)}
    text |= {400 + k: text[k][:-1] + "0" for k in range(0, 400, 20)}
    rounds, shared, table, compare = [], [], Workspace.table, lines._compare_blocks

    def weighed(similarity):
        def run(batches):
            batches = list(batches)
            n = sum(len(x) for b in batches for x in b.column(7).to_pylist())
            (tmp_path / uuid.uuid4().hex).write_text(str(n))
            return compare(similarity)(iter(batches))

        return run

    def noted(ws, df, name):
        out = table(ws, df, name)
        if name == "shared":
            shared.append(out.count())
        if found := list(tmp_path.iterdir()):
            rounds.append(sum(int(x.read_text()) for x in found))
            for x in found:
                x.unlink()
        return out

    monkeypatch.setattr(Workspace, "table", noted)
    monkeypatch.setattr(lines, "_compare_blocks", weighed)
    monkeypatch.setattr(lines, "BLOCK_LINES", 20)
    monkeypatch.setattr(lines, "ROUND_CHARS", 1, raising=False)
    got = {x.doc_id: x.n_removed for x in lines.dedup_lines(spark, spark.createDataFrame(list(text.items()), "doc_id long, text string")).collect()}
    assert {k for k, n in got.items() if n} == {k for k in text if k >= 400}
    assert len(rounds) > 3 and max(rounds) < 1.5 * sum(map(len, text.values())), rounds
    assert len(shared) > 1 and max(shared) < 0.8 * sum(shared), shared


@pytest.mark.parametrize("letters", ["abcdefghij ", "".join(map(chr, range(0x430, 0x4B0))) + " "])
def test_near_lines_are_settled_together(monkeypatch, letters):
    """Of pairs of which half are near, few are looked at one by one, unless they have more different characters than there are kinds."""
    r, left, right = random.Random(8), [], []
    for k in range(300):
        x = [r.choice(letters) for _ in range(150 + k % 40)]
        y = list(x)
        for _ in range(r.randrange(80)):
            y[(p := r.randrange(len(y) + 1)) : p + r.randrange(2)] = r.choice(["", letters[0], letters[1]])
        left.append("".join(x)), right.append("".join(y))
    want = [brute.edit_distance(x, y) <= int(max(len(x), len(y)) * 0.2 + 1e-9) for x, y in zip(left, right)]
    looked, one = [], lines.are_similar
    monkeypatch.setattr(lines, "are_similar", lambda *pair: looked.append(pair) or one(*pair))
    assert lines.similar_pairs(left, right, 0.8).tolist() == want
    assert 75 < sum(want) < 225 and (len(looked) < 64 or len(letters) > lines.KINDS)


def test_near_copies_of_a_crowded_key_give_few_links():
    """150 lines, each near to all others: no more links than lines, and these join them all."""
    r = random.Random(9)
    base = [r.choice("abcdefghij") for _ in range(200)]
    norms = ["".join("z" if k <= j < k + 20 else c for j, c in enumerate(base)) for k in range(150)]
    rows = [(1, 0, 0, k, k, len(x), 0, x) for k, x in enumerate(norms)]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["key", "pair", "side", "h", "root", "chars", "spot", "norm"])
    links = [x for b in lines._compare_blocks(0.8)(iter([batch])) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    assert len(links) == len(norms) - 1 and len({x for pair in links for x in pair}) == len(norms)
