"""The training-data operators against brute force, on odd rows and on the smallest tables."""

import collections
import itertools
import hashlib
import math
import re
import time
import zlib
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cellquery.llm import (
    ann,
    decontaminate,
    lm,
    mixing,
    ngram_join,
    quality,
    repeats,
    scratch,
    sharding,
    substrings,
    suffixes,
    tokens,
)
from cellquery.llm import words as W
from conftest import SMALL

KIND = "doc_id long, text string, lang string, source string, n_chars long, class string, hash long"
PASSAGE = " ".join(f"w{k}" for k in range(30))
LONG = " ".join(f"Long{k % 97}x{k % 13}" for k in range(4000))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, copies, near copies, repeats, clashing names."""
    near = PASSAGE + " and a tail of ten more plain words to end it"
    rows = [
        (1, PASSAGE, "en", "a"),
        (2, "Before it: " + PASSAGE + " after it", "en", "a"),
        (3, PASSAGE, None, "b"),
        (4, None, "en", "b"),
        (5, "", "en", None),
        (6, LONG, "en", None),
        (7, near, "de", "c"),
        (8, near.replace("plain", "simple"), "de", "c"),
        (9, "ÉAUX été ñ ü " + "naïve " * 30, "fr", "c"),
        (None, "no id here " + PASSAGE, "fr", "c"),
        (None, "another one without an id", None, None),
        (10, "short one", "en", "a"),
        (10, "short one", "en", "a"),
        (11, "  \t\n ", "en", "a"),
        (12, "x" * 300, "en", "a"),
        (13, "y" * 20 + "x" * 300, "en", "a"),
    ]
    return spark.createDataFrame([(*r, None, "own", 7) for r in rows], KIND)


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], KIND)


def by_id(frame, *columns):
    return collections.Counter(tuple(r) for r in frame.select("id", *columns).collect())


def order(doc_id):
    return (1 << 63) - 1 if doc_id is None else doc_id


def texts_of(frame):
    rows = [(r.doc_id, r.text or "") for r in frame.select("doc_id", "text").collect()]
    return sorted(rows, key=lambda r: order(r[0]))


def fold(text):
    return re.sub(rb"[A-Z]", lambda m: m.group().lower(), text.encode())


def plain_words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", text.encode())


def repeats_by_hand(rows, units, join, width, same_document):
    """First start of every window, then everything covered by a later one."""
    first = {}
    for doc_id, text in rows:
        parts = units(text)
        for at in range(len(parts) - width + 1):
            place = (order(doc_id), at if same_document else 0)
            window = tuple(parts[at : at + width])
            first[window] = min(first.get(window, place), place)
    out = collections.Counter()
    for doc_id, text in rows:
        parts, gone = units(text), set()
        for at in range(len(parts) - width + 1):
            if first[tuple(parts[at : at + width])] < (order(doc_id), at if same_document else 0):
                gone.update(range(at, at + width))
        kept = join([p for k, p in enumerate(parts) if k not in gone])
        out[doc_id, len(parts), len(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("table", ["odd", "given"])
def test_repeated_words(request, table):
    docs = request.getfixturevalue(table)
    got = by_id(substrings.remove_repeats(docs), "n", "n_removed", "sha")
    assert got == repeats_by_hand(texts_of(docs), plain_words, b" ".join, 20, True)


@pytest.mark.parametrize("table", ["odd", "given"])
def test_repeated_bytes(request, table):
    docs = request.getfixturevalue(table)
    got = by_id(suffixes.remove_repeats(docs), "n", "n_removed", "sha")
    assert got == repeats_by_hand(texts_of(docs), str.encode, bytes, 50, False)


def test_frequent_passages_without_ids(spark):
    """One opening in half of the documents, ids missing, repeated or falling, over many tasks."""
    rows = []
    for k in range(400):
        doc_id = None if k % 5 == 0 else 1000 - k // 2
        opening = PASSAGE if k % 2 else "".join(f"own{k} " * 3)
        rows.append((doc_id, f"{opening} then {k} " + "again and again the same few words " * (k % 7)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(23)
    kept = texts_of(docs)
    got = by_id(substrings.remove_repeats(docs), "n", "n_removed", "sha")
    assert got == repeats_by_hand(kept, plain_words, b" ".join, 20, True)
    got = by_id(suffixes.remove_repeats(docs), "n", "n_removed", "sha")
    assert got == repeats_by_hand(kept, str.encode, bytes, 50, False)


@pytest.mark.parametrize("seed", range(5))
def test_runs_settle_what_they_can(seed):
    """What is left to meet elsewhere gives the same verdicts as all rows would."""
    rng = np.random.default_rng(seed)
    runs = [rng.integers(0, [6, 9, 4], (rng.integers(0, 40), 3)) for _ in range(6)]
    everything = np.concatenate(runs).tolist()
    sent, later, several = [], [], []
    for groups, owner, place in (r.T.astype(np.int64) for r in runs):
        key, _, first = repeats.settled(groups, owner + 100, (owner, place))
        assert (key[first] == groups[first]).all()
        sent += zip(key.tolist(), owner.tolist(), place.tolist())
        later += (~first).tolist()
        key, again, _ = suffixes.by_class(groups, owner + 100)
        several += zip(key.tolist(), (owner + 100).tolist(), again.tolist())
    least = lambda rows, k: min(tuple(r[1:]) for r in rows if r[0] == k)
    for row, (key, owner, place), known in zip(everything, sent, later):
        assert (tuple(row[1:]) > least(everything, row[0])) == (known or (owner, place) > least(sent, key))
    shared = {}
    for row, (key, owner, again) in zip(everything, several):
        others = {r[1] for r in several if r[0] == key}
        seen = (row[0], row[1])
        shared[seen] = shared.get(seen, False) or again or len(others) > 1
    for group, owner, _ in everything:
        assert shared[group, owner] == (len({r[1] for r in everything if r[0] == group}) > 1)


def thue_morse(size, zero, one):
    """A sequence and its opposite, which polynomial hashes modulo a power of two can't tell apart."""
    bits = [bin(k).count("1") % 2 for k in range(size)]
    return [zero if b else one for b in bits], [one if b else zero for b in bits]


def one_text(text):
    data = text.encode()
    return W.Texts(None, 0, np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)]))


@pytest.mark.parametrize("size", [256, 1024, 8192])
def test_patterns_have_their_own_hashes(size):
    """As texts, as words, as sequences of words, and folded."""
    marks = []
    for sequence in (*thue_morse(size, "a", "b"), *thue_morse(size, "a ", "b "), *thue_morse(size, "abcdefgh", "ijklmnop")):
        text = one_text("".join(sequence))
        cut = W.split(text, W.SPACES)
        marks += [suffixes.fingerprint(text)[0], substrings.fingerprint(text)[0]]
        if len(cut.starts) == 1:
            marks.append(W.hashes(text, cut, True)[0])
            whole = text.data.tobytes()
            distinct = {whole[at : at + 50] for at in range(len(whole) - 49)}
            assert np.unique(W.strings(text.data, 50)).size == len(distinct)
    assert len(set(marks)) == len(marks)


def test_hashes_tell_bytes_apart():
    """All words of two letters, zeros at the end, equal words at other places, and case."""
    letters = "abcdefgh\0"
    words = [a + b for a in letters for b in letters] + ["a", "a\0", "a\0\0", "\0", "a" * 8, "a" * 8 + "\0", "a" * 9, "a" * 16]
    words = list(dict.fromkeys(words))
    text = one_text(" ".join(words * 3))
    hashed = W.hashes(text, W.split(text, W.SPACES), False).reshape(3, -1)
    assert (hashed == hashed[0]).all()
    assert len(set(hashed[0].tolist())) == len(words)
    big, small = one_text("Grün ABCDEFGHIJ"), one_text("grün abcdefghij")
    assert (W.hashes(big, W.split(big, W.SPACES), True) == W.hashes(small, W.split(small, W.SPACES), True)).all()


def test_patterns_are_no_repeats(spark):
    """Texts that are the opposite of each other lose only what they share."""
    rows = []
    for k, (zero, one) in enumerate([("a", "b"), ("a ", "b "), ("left ", "right ")]):
        for sequence in thue_morse(2048, zero, one):
            rows.append((len(rows), "".join(sequence)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(suffixes.remove_repeats(docs), "n", "n_removed", "sha")
    assert got == repeats_by_hand(rows, str.encode, bytes, 50, False)
    got = by_id(substrings.remove_repeats(docs), "n", "n_removed", "sha")
    assert got == repeats_by_hand(rows, plain_words, b" ".join, 20, True)
    joined = {r["id"]: r["component_id"] for r in ngram_join.near_duplicates(docs).collect()}
    assert joined[0] == 0 and joined[1] == 1


def test_common_phrase_with_many_surroundings(spark, monkeypatch):
    """A phrase in all documents, with strings around it that other documents of any distance share."""
    monkeypatch.setattr(suffixes, "HELD", 60)
    monkeypatch.setattr(suffixes, "BLOCK", 9)
    draw = np.random.default_rng(3)
    word = lambda: "".join(draw.choice(list("abcdefgh"), 20))
    sides = [word() for _ in range(40)]
    rows = []
    for k in range(300):
        left, right = (sides[draw.integers(40)] if draw.random() < 0.6 else word() for _ in range(2))
        rows.append((k, f"{word()}{left} the licence of this text is free {right}{word()}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    right = repeats_by_hand(rows, str.encode, bytes, 50, False)
    assert sum(n for (_, _, n, _) in right) > 0
    assert by_id(suffixes.remove_repeats(docs), "n", "n_removed", "sha") == right


def test_strings_held_are_bounded():
    state = {"lead": None, "hash": np.empty(0, np.uint64), "order": np.empty(0, np.int64)}
    draw = np.random.default_rng(4)
    undecided = 0
    for block in range(20):
        data = [bytes(draw.integers(97, 123, 34, np.uint8)) + b"L" * 16 + bytes(draw.integers(97, 123, 34, np.uint8)) for _ in range(10)]
        columns = [[0] * 10, [b"L" * 16] * 10, [block] * 10, list(range(10)), [0] * 10, [34] * 10, data]
        kinds = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        names = ["bucket", "lead", "order", "class", "place", "before", "bytes"]
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
        for out in suffixes.compare_block(batch, state, 50, 1000):
            undecided += out.num_rows
        assert state["hash"].size <= 1000 + 10 * 35
    assert state["hash"].size + undecided == 20 * 10 * 35


def test_suffixes_are_sorted_by_one_number(spark, odd):
    """No window over the suffixes, whose sort compares rows, and no column in Python that is not used there."""
    docs = odd.select(F.col("doc_id").alias("order"), "text")
    split_at = spark.sparkContext.broadcast(np.array([0], np.int64))
    plan = suffixes.shared(suffixes.suffixes(docs, 50, split_at), 3)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert re.search(r"Sort \[hash#\d+L ASC NULLS FIRST\], false", plan)
    assert re.search(r"Project \[hash#\d+L, class#\d+L, place#\d+\]", plan)


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_neighbours_over_batches(size):
    """Groups that go on over batches: of one class, of two, known to be shared, with places that come twice."""
    draw = np.random.default_rng(size)
    rows = [(int(h), int(c), int(p)) for h, c, p in zip(*(draw.integers(0, k, 400) for k in (150, 3, 4)))]
    rows += [(200, 5, k % 7) for k in range(60)] + [(201, 5, k % 7) for k in range(60)] + [(201, 6, 1)]
    rows += [(202, 5, -1 - k) for k in range(9)]
    rows.sort(key=lambda r: r[0])
    state, got = {}, set()
    for at in range(0, len(rows), size):
        columns = zip(("hash", "class", "place"), zip(*rows[at : at + size]), (pa.int64(), pa.int64(), pa.int32()))
        mark, place = suffixes.neighbours(pa.RecordBatch.from_pydict({n: pa.array(c, k) for n, c, k in columns}), state)
        got |= set(zip(mark.tolist(), place.tolist()))
        assert state["place"].size <= 7
    groups = collections.defaultdict(set)
    for h, c, p in rows:
        groups[h].add((c, p))
    several = [g for g in groups.values() if len({c for c, _ in g}) > 1 or any(p < 0 for _, p in g)]
    assert got == {(c, p if p >= 0 else -1 - p) for g in several for c, p in g}


@pytest.mark.parametrize("width", [16, 17, 50, 300])
def test_anchors_of_pieces(monkeypatch, width):
    """Every string has one anchor, at the same place wherever it stands; pieces and texts leave no seam."""
    monkeypatch.setattr(suffixes, "PIECE", 32)
    draw = np.random.default_rng(width)
    same = bytes(draw.integers(97, 100, 400, np.uint8))
    parts = [same, b"", b"short", b"z" * 29 + same, bytes(draw.integers(97, 123, 90, np.uint8)), b"a" * 700]
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(x) for x in parts])
    texts = W.Texts(None, 0, data, ends - [len(x) for x in parts], ends)
    owner, anchor, first, last, lead, hashed = suffixes.anchored(texts, width)
    places = {}
    whole = data.tobytes()
    for who, at, low, high, eight, mark in zip(owner, anchor, first, last, lead, hashed):
        assert whole[at : at + 8] == int(eight).to_bytes(8, "big")
        for start in range(low, high + 1):
            assert texts.starts[who] <= start and start + width <= texts.ends[who]
            assert start <= at <= start + width - suffixes.LEAD
            assert places.setdefault(whole[start : start + width], (at - start, mark)) == (at - start, mark)
    spread = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last)])
    assert sorted(spread.tolist()) == [p for a, b in zip(texts.starts, texts.ends) for p in range(a, b - width + 1)]


def test_cut_texts_as_a_batch():
    """Spans of several texts: overlapping, touching, apart, up to the end of one and from the start of the next."""
    words = ["abcdefghij" * 12, "é" * 60, "k" * 50, "l" * 80]
    gone = [[(0, 3), (2, 5), (54, 55), (70, 71)], [(70, 71), (0, 1)], [(0, 1)], [(0, 1), (29, 31)]]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    spans = [[{"start": a, "end": b} for a, b in g] for g in gone]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(4), pa.int64()), pa.array(words), pa.array(spans, kind)], ["class", "text", "gone"]
    ).slice(1)
    (texts,) = W.runs([batch], "text")
    rows = suffixes.cut_texts(texts, 50).to_pylist()
    assert [r["class"] for r in rows] == [1, 2, 3]
    for row, word, places in zip(rows, words[1:], gone[1:]):
        data = word.encode()
        lost = {p for a, b in places for p in range(a, min(b + 49, len(data)))}
        kept = bytes(c for k, c in enumerate(data) if k not in lost)
        assert row["kept"] == hashlib.sha256(kept).hexdigest() and row["n_removed"] == len(lost)
        runs = [p for a, b in zip(row["starts"], row["ends"]) for p in range(a, b)]
        assert runs == sorted(lost) and all(a < b for a, b in zip(row["ends"], row["starts"][1:]))


@pytest.mark.parametrize("window", [5, 9, 14])
def test_covers_meet_at_some_offset(window):
    period, mask, length = substrings.cover_for(window)
    assert length + period - 1 == window
    for a in range(period):
        for b in range(period):
            assert any(mask[(a + d) % period] and mask[(b + d) % period] for d in range(period))


@pytest.mark.parametrize("table, paired", [("odd", 2), ("odd", 9), ("given", 2), ("given", 9)])
def test_near_duplicates(request, table, paired, monkeypatch):
    monkeypatch.setattr(ngram_join, "STAR", 2)  # lists of three and more take the way of the large
    monkeypatch.setattr(ngram_join, "PAIRED", paired)  # the middle lists are empty, or not
    docs = request.getfixturevalue(table)
    rows = [(i, re.findall(rb"[^\x20\x09-\x0D]+", fold(t))) for i, t in texts_of(docs)]
    grams = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for _, w in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if grams[a] and 100 * len(grams[a] & grams[b]) >= 80 * len(grams[a] | grams[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    wanted = collections.Counter((i, len(g), rows[find(k)][0]) for k, ((i, _), g) in enumerate(zip(rows, grams)))
    assert by_id(ngram_join.near_duplicates(docs), "n", "component_id") == wanted
    if table == "given":
        kept = [r.doc_id for r in ngram_join.keep_one(docs.union(docs.limit(3))).collect()]
        assert sorted(kept) == sorted({c for _, _, c in wanted})


def test_near_duplicates_of_a_crowd(spark):
    """A base and many copies of it with two edits each, of which few are near each other."""
    draw = np.random.default_rng(1)
    base = [f"b{k}" for k in range(60)]
    texts = [" ".join(base)]
    for _ in range(60):
        copy = list(base)
        for at in draw.choice(60, 2, replace=False):
            copy[at] = f"e{draw.integers(1 << 30)}"
        texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    grams = [{tuple(t.split()[k : k + 5]) for k in range(56)} for t in texts]
    root = list(range(61))
    for a in range(61):
        for b in range(a):
            if 100 * len(grams[a] & grams[b]) >= 80 * len(grams[a] | grams[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    got = {r.id: r.component_id for r in ngram_join.near_duplicates(docs).collect()}
    assert got == dict(enumerate(root)) and len(set(root)) > 1


def item_hits(docs, items):
    cut = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t or ""))
    windows = collections.defaultdict(set)
    for item, text in items:
        words = cut(text)
        for at in range(max(1, len(words) - 9) if words else 0):
            windows[tuple(words[at : at + 10])].add("" if item is None else str(item))
    out = collections.Counter()
    for doc_id, text in docs:
        words, hit, found = cut(text), set(), set()
        for size in {len(w) for w in windows}:
            for at in range(len(words) - size + 1):
                if names := windows.get(tuple(words[at : at + size])):
                    hit.update(range(at, at + size))
                    found |= names
        name = None if doc_id is None else str(doc_id)
        sha = decontaminate.sha256_of(found)
        out[name, len(words), len(hit), len(found), sha, bool(hit)] += 1
    return out


@pytest.mark.parametrize("blocks", [10**6, 40])
def test_benchmark_hits(spark, odd, blocks):
    items = [(1, PASSAGE), (2, "short ONE"), (3, None), (4, " .,! "), (None, "no id here"), (5, PASSAGE), (20, "x" * 300)]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.digest(decontaminate.find_items(odd, table, block_words=blocks))
    assert by_id(found, "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == item_hits(texts_of(odd), items)
    kept = decontaminate.keep_clean(odd, table)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {4, 5, 6, 9, 11, 13, None}


def test_blocks_of_items_keep_rows_apart(spark):
    """Rows with one id, or none, and equal word counts, each hit by another block of the benchmark."""
    items = [(k, " ".join(f"i{k}w{n}" for n in range(12))) for k in range(8)]
    texts = [f"before {text} after" for _, text in items] + [" ".join(["clean"] * 14)]
    texts += [items[a][1] + " " + " ".join(items[b][1].split()[:2]) for a, b in ((2, 5), (6, 1))]
    rows = [(doc_id, text) for doc_id in (None, 7, 7) for text in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.digest(decontaminate.find_items(docs, table, block_words=40))
    assert by_id(found, "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == item_hits(rows, items)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "c x b y a"), (2, "a b z z z z c"), (3, "a b"), (4, "c"), (5, "b a")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "a b c")], "item_id long, text string")
    rows = decontaminate.find_items(docs, items, slack=2).collect()
    assert {int(r.id): (r.items, r.near) for r in rows} == {1: ([], ["9"]), **{k: ([], []) for k in (2, 3, 4, 5)}}


def test_tokens_equal_the_library(odd, given):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    for docs in (odd, given):
        got = by_id(tokens.count_tokens(docs, path), "n_bytes", "n_tokens", "over_limit")
        wanted = collections.Counter()
        for doc_id, text in texts_of(docs):
            n = len(library.encode(text, add_special_tokens=False).ids)
            wanted[doc_id, len(text.encode()), n, n > 2048] += 1
        assert got == wanted
    counter = tokens.Counter(tokens.read_merges(path))
    for text in ("a<|endoftext|>b <|ENDOFTEXT|>", "ΑΣ İ é \x1cb", "it's WE'RE 12", "x" * 2000, "﻿a​b"):
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("table", ["odd", "given"])
def test_language_model(request, table):
    docs = request.getfixturevalue(table)
    words = [(i, re.findall(rb"[^\x20\x09-\x0D]+", fold(t)) + [None]) for i, t in texts_of(docs)]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = collections.Counter(w for i, ws in words if not held(i) for w in ws)
    total, whole = sum(counts.values()), sum(counts.values()) + len(counts) + 1
    rows = lm.score_all(docs, frequent=50).collect()  # most words take the way of the rare
    got = sorted((order(r.id), r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in rows)
    assert got == sorted((order(i), held(i), len(w), sum(counts[x] > 0 for x in w), total) for i, w in words)
    base = sorted(sum(math.log10((counts[x] + 1) / whole) for x in w) for _, w in words)
    assert np.allclose(sorted(r.base_score for r in rows), base)
    assert all(r.score < 0 for r in rows)
    if table == "given":
        gain = [sum(r.score - r.base_score for r in rows if r.held_out == side) for side in (True, False)]
        assert min(gain) > 0


def test_class_probabilities_sum_to_one():
    draw = np.random.default_rng(3)
    weights = draw.normal(size=(lm.TEMPLATES, lm.FEATURES, lm.CLASSES)).astype(np.float32)
    slots = draw.integers(0, lm.FEATURES, (lm.TEMPLATES, 50))
    chance = np.exp(lm.log_chances(weights, np.zeros(lm.CLASSES, np.float32), slots))
    assert np.allclose(chance.sum(axis=1), 1, atol=1e-4)


def test_chances_equal_the_softmax():
    draw = np.random.default_rng(4)
    weights = draw.normal(size=(lm.TEMPLATES, lm.FEATURES, lm.CLASSES))
    slots = draw.integers(0, lm.FEATURES, (lm.TEMPLATES, 500))
    for template, far in enumerate((-60, 60, -60, 60)):  # templates that leave nothing of each other
        weights[template, slots[template, :50], : 16 + template] += far
    logs = (weights - weights.max(axis=2, keepdims=True)).astype(np.float32)
    found, sums = lm.chances(logs, np.exp(logs), slots)
    scores = sum(logs[t][slots[t]].astype(np.float64) for t in range(lm.TEMPLATES))
    exact = scores.max(axis=1) + np.log(np.exp(scores - scores.max(axis=1, keepdims=True)).sum(axis=1))
    assert exact.min() < math.log(lm.LEAST) and np.allclose(sums, exact, atol=1e-4)
    assert np.allclose(found, np.exp(scores - exact[:, None]), atol=1e-4)
    total = np.zeros((lm.TEMPLATES, lm.CLASSES, lm.FEATURES))
    assert lm.add_chances(total, logs, np.exp(logs), slots) == pytest.approx(sums.sum())
    assert total.sum() == pytest.approx(500 * lm.TEMPLATES, rel=1e-5)
    assert np.allclose(total[2, :, slots[2, -1]], found[slots[2] == slots[2, -1]].sum(axis=0), atol=1e-5)


def converged_by_hand(rows, ridge, steps=60):
    """Classes of all tokens, and log10 probabilities of those of each row, of plain gradient updates that go on beyond any stop."""
    batch = pa.RecordBatch.from_pydict({"text": pa.array([t for _, t in rows], pa.string())})
    blocks = list(lm.token_blocks([batch]))
    kind = np.concatenate([lm.classes_of(b.tokens) for b in blocks])
    slots = np.concatenate([lm.contexts(b) for b in blocks], axis=1)
    sizes = np.concatenate([np.diff(b.ends, prepend=0) for b in blocks])
    held = np.repeat([i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows], sizes)
    bins = slots + lm.FEATURES * np.arange(lm.TEMPLATES)[:, None]  # one feature of each template
    at, own = bins[:, ~held], kind[~held]
    seen = np.zeros((lm.TEMPLATES * lm.FEATURES, lm.CLASSES))
    for template in at:
        np.add.at(seen, (template, own), 1)
    share = np.bincount(own, minlength=lm.CLASSES) + 1.0
    bias = np.log(share / share.sum())
    weights = np.zeros(seen.shape)

    def logs(places):
        scores = weights[places].sum(axis=0) + bias
        scores -= scores.max(axis=1, keepdims=True)
        return scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))

    for _ in range(steps):
        chance = np.exp(logs(at))
        guess = np.stack([np.bincount(at.ravel(), np.tile(c, lm.TEMPLATES), len(seen)) for c in chance.T], axis=1)
        weights += np.clip((seen - guess - ridge * weights) / (guess + ridge) * (1.5 / lm.TEMPLATES), -1, 1)
    gain = logs(bins)[np.arange(kind.size), kind] / math.log(10)
    return kind, np.add.reduceat(gain, np.concatenate([[0], np.cumsum(sizes)[:-1]]))


def test_scores_are_those_of_a_converged_model(given):
    rows = sorted(texts_of(given), key=lambda r: order(r[0]))
    kinds, gain = converged_by_hand(rows, 8.0)
    words = [re.findall(rb"[^\x20\x09-\x0D]+", fold(t)) + [None] for _, t in rows]
    kind = dict(zip((w for ws in words for w in ws), kinds.tolist()))
    counts = collections.Counter(
        w for (i, _), ws in zip(rows, words) if i is None or zlib.crc32(str(i).encode()) % 7 != 2 for w in ws
    )
    mass = np.ones(lm.CLASSES)
    for w, n in counts.items():
        mass[kind[w]] += n + 1
    inner = [sum(math.log10((counts[w] + 1) / mass[kind[w]]) for w in ws) for ws in words]
    wanted = gain + np.array(inner)
    got = sorted(lm.score_all(given).collect(), key=lambda r: order(r.id))
    apart = np.array([r.score for r in got]) - wanted
    sizes = np.array([r.n_tokens for r in got])
    print("log10 a token apart:", apart.sum() / sizes.sum(), np.abs(apart).sum() / sizes.sum())
    assert [r.id for r in got] == [i for i, _ in rows]
    assert abs(apart.sum()) / sizes.sum() < 0.01 and np.abs(apart).sum() / sizes.sum() < 0.01


def test_neighbours(spark):
    draw = np.random.default_rng(5)
    vectors = draw.normal(size=(400, 12)) * draw.uniform(0.5, 2, (400, 1))
    vectors[7] = vectors[300] = vectors[20]
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    rows += [(1000, None), (1020, [0.0] * 12), (1040, [float("nan")] * 12), (1060, [1.0, None] * 6), (1080, []), (None, rows[1][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.nearest(frame, lambda i: i % 20 == 0, top=10).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.id)
        assert r.score == pytest.approx(float(vectors[r.query_id] @ vectors[r.id]), rel=1e-12)
    right = 0
    for query in range(0, 400, 20):
        scores = vectors @ vectors[query]
        scores[query] = -np.inf
        best = np.lexsort((np.arange(400), -scores))[:10]
        right += len({*best.tolist()} & {*got[query]})
    assert set(got) == set(range(0, 400, 20)) and right >= 0.9 * 200
    assert all(len(v) == 10 for v in got.values())


@pytest.mark.parametrize("scale", ["tiny", "few", "outlier", "skewed"])
def test_neighbours_are_whole(spark, scale):
    draw = np.random.default_rng(11)
    vectors = draw.normal(size=({"tiny": 12, "few": 40}.get(scale, 1500), 64))
    vectors /= np.sqrt((vectors**2).sum(axis=1))[:, None]
    if scale == "outlier":
        vectors[33] *= 100
    if scale == "skewed":
        vectors *= draw.lognormal(0, 1, (len(vectors), 1))
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.nearest(frame, lambda i: i % 10 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.id)
    least = min(20, len(vectors) - 1)
    right = 0
    for query in range(0, len(vectors), 10):
        assert len(got[query]) == len({*got[query]}) == least
        scores = vectors @ vectors[query]
        scores[query] = -np.inf
        right += len({*np.argsort(-scores)[:least].tolist()} & {*got[query]})
    share = right / least / len(got)
    print(scale, "recall", share)
    assert share >= (1 if scale == "tiny" else 0.85)


def test_neighbours_of_repeated_ids_and_tiny_vectors(spark):
    draw = np.random.default_rng(12)
    vectors = draw.normal(size=(30, 8))
    ids = list(range(28)) + [3, 20]
    vectors[25], vectors[29] = np.abs(vectors[25]) * 1e-170, vectors[20]
    vectors[26] = [1e-300] + [0.0] * 7
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>")
    found = ann.nearest(frame, lambda i: i % 5 == 0).collect()
    wanted = {k: ids[k] for k in range(30) if ids[k] % 5 == 0}  # 20 is there twice, 25 is tiny
    assert collections.Counter(r.query_id for r in found) == collections.Counter(
        i for i in wanted.values() for _ in range(20)
    )
    assert {25, 26} <= {r.id for r in found}
    right = 0
    for query in wanted:
        scores = vectors @ vectors[query]
        order = sorted((k for k in range(30) if k != query), key=lambda k: (-scores[k], ids[k]))[:20]
        near = collections.Counter((ids[k], scores[k].round(9)) for k in order)
        mine = collections.Counter({(r.id, round(r.score, 9)): 1 for r in found if r.query_id == ids[query]})
        right += sum((near & mine).values())
    assert right >= 0.8 * 20 * len(wanted)


def test_recall_on_the_given_vectors(spark):
    given = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = given.collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    got = collections.defaultdict(set)
    for r in ann.nearest(given, lambda i: i % 20 == 0).collect():
        got[r.query_id].add(r.id)
    right = 0
    for at in np.flatnonzero(ids % 20 == 0):
        scores = vectors @ vectors[at]
        scores[at] = -np.inf
        right += len(set(ids[np.argsort(-scores)[:20]].tolist()) & got[ids[at]])
    assert right / 20 / len(got) >= 0.9


@pytest.mark.parametrize("count", [1, 20, 27, 100])
def test_reach_is_that_of_the_probes(count):
    place = np.random.default_rng(21).uniform(-3, 3, (6, 2, 3))
    far = ann.reach(place, count)
    buckets = np.array(list(itertools.product(range(-5, 5), repeat=3)))
    for table in range(2):
        near = ann.visited(buckets, place[:, table], far[:, table])
        for row in range(6):
            wanted = {tuple(b) for b in ann.probes(place[row, table], count)}
            assert {tuple(b) for b in buckets[near[:, row]]} == wanted


def multiprobe_by_hand(ids, vectors, is_query, top, visits):
    """The best of each query among the rows whose bucket it probes in some table; bands by hand."""
    norms = np.sqrt((vectors**2).sum(axis=1))
    bands = np.floor(np.log2(norms.max()) - np.log2(norms)).astype(int)
    longest = {b: norms[bands == b].max() for b in set(bands.tolist())}
    hashing = ann.Hashing(vectors.shape[1], longest, 4, 7, 2.0, 7)
    codes = np.floor(hashing.places(vectors, bands.tolist()))
    found = {}
    for q in np.flatnonzero([is_query(i) for i in ids]):
        place = hashing.places(vectors[q : q + 1], None)[0]
        seen = [{tuple(b) for b in ann.probes(place[t], visits)} for t in range(4)]
        near = [k for k in range(len(ids)) if k != q and any(tuple(codes[k, t]) in seen[t] for t in range(4))]
        found[ids[q]] = sorted(near, key=lambda k: (-round(float(vectors[k] @ vectors[q]), 12), ids[k]))[:top]
    return {q: [ids[k] for k in near] for q, near in found.items()}


def crowded_vectors():
    """Most directions once, and one of them in a third of the rows, at several lengths."""
    draw = np.random.default_rng(22)
    vectors = draw.normal(size=(600, 16))
    vectors[::3] = vectors[0]
    vectors[::6] *= 2.0
    vectors[5::7] *= 0.1
    return vectors


@pytest.mark.parametrize("visits", [8, 250])
def test_neighbours_equal_probes_by_hand(spark, monkeypatch, visits):
    monkeypatch.setattr(ann, "GROUP", 17, raising=False)
    vectors = crowded_vectors()
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.nearest(frame, lambda i: i % 5 == 0, visits=visits).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.id)
    wanted = multiprobe_by_hand(list(range(600)), vectors, lambda i: i % 5 == 0, 20, visits)
    assert set(got) == set(wanted) and all(len(v) == 20 for v in got.values())
    whole = [q for q, near in wanted.items() if len(near) == 20]
    assert len(whole) > 50 and all(got[q] == wanted[q] for q in whole)


def test_queries_travel_once(spark, monkeypatch):
    vectors = crowded_vectors()
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    counts, run = [], type(frame).mapInArrow

    def counted(self, *args):
        found = run(self, *args)
        counts.extend([self.count(), found.count()])
        return found

    monkeypatch.setattr(type(frame), "mapInArrow", counted)
    ann.nearest(frame, lambda i: i % 5 == 0, top=1).collect()
    tasks = 2 * spark.sparkContext.defaultParallelism
    assert max(counts) <= max(len(vectors), len(vectors) // 5 * tasks)  # no step has a row per query and bucket


def test_probes_come_in_order():
    place = np.array([0.2, 5.9, -3.5])
    found = ann.probes(place, 20)
    cost = [sum(((p - b) if q < b else (b + 1 - p)) ** 2 for p, b, q in zip(place, np.floor(place), f) if q != b) for f in found]
    assert found[0].tolist() == [0, 5, -4] and cost == sorted(cost)
    assert len({tuple(f) for f in found}) == 20


def test_mix(odd, given):
    for docs in (odd, given):
        rows = mixing.mix(docs).collect()
        assert len(rows) == docs.count() and all(r.taken in (0, r.size, 2 * r.size) for r in rows)
        for source in {r.source for r in rows}:
            mine = [r for r in rows if r.source == source]
            assert sum(r.size for r in mine) == mine[0].source_size
            assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r.size for r in mine)
        assert sum({r.source: r.target for r in rows}.values()) == pytest.approx(1.5 * sum(r.size for r in rows))
        taken = sum(r.copies for r in rows)
        assert mixing.take(docs).count() == taken and mixing.take(docs).columns == docs.columns


def test_mix_with_a_third_of_ids_null(spark):
    rows = [(None if k % 3 == 0 else k, f"w{k} " * (1 + k % 7), "en", "ab"[k % 2]) for k in range(6000)]
    docs = spark.createDataFrame([(*r, None, "own", 7) for r in rows], KIND)
    found = mixing.mix(docs).collect()
    for source in "ab":
        mine = [r for r in found if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 7
    wide = docs.withColumns({n: F.lit(n) for n in ("_source", "_hash", "_salt", "_copy", "_below")})
    assert mixing.take(wide).columns == wide.columns and mixing.take(wide).count() == sum(r.copies for r in found)


def test_mix_is_nested(given):
    small, large = (
        {r.id for r in mixing.mix(given, share=s).collect() if r.copies} for s in (0.3, 0.6)
    )
    assert small < large


@pytest.mark.parametrize("balance", [1.0, 1.25])
def test_shards(odd, given, balance):
    for docs in (odd, given):
        rows = sharding.shard(docs, 16, balance=balance).collect()
        sizes = collections.Counter(r.shard for r in rows)
        assert len(rows) == docs.count()
        assert max(sizes.values()) <= math.ceil(len(rows) * balance / 16) + 1
        if balance == 1.0:
            assert max(sizes.values()) - min(sizes.get(k, 0) for k in range(16)) <= 1
        for shard, n in sizes.items():
            assert sorted(r.slot for r in rows if r.shard == shard) == list(range(n))


def plain_ring(rows, owners, nodes, room):
    """Every row walks the ring by itself: ``rows`` are ``(place, what)`` in the order of their slots."""
    waiting = collections.defaultdict(list)
    for place, what in rows:
        waiting[owners[place]].append(what)
    filled, out = collections.Counter(), collections.Counter()
    while waiting:
        onward = collections.defaultdict(list)
        for node in sorted(waiting):
            for what in waiting[node]:
                shard = nodes[node]
                if filled[shard] < room[shard]:
                    out[what, shard, filled[shard]] += 1
                    filled[shard] += 1
                    continue
                step = (node + 1) % len(nodes)
                while filled[nodes[step]] >= room[nodes[step]]:
                    step = (step + 1) % len(nodes)
                onward[step].append(what)
        waiting = onward
    return out


@pytest.mark.parametrize("balance", [1.0, 1.25])
def test_shards_equal_a_plain_ring(spark, odd, given, balance):
    crowd = spark.createDataFrame(
        [(None if k % 3 == 0 else k % 11, f"text {k // 2}") for k in range(600)], "doc_id long, text string"
    )
    for docs in (odd, given, crowd):
        hashed = lambda c: F.xxhash64(F.col(c).cast("string"))
        rows = docs.select(
            sharding.place_of("doc_id", 512).alias("place"), sharding.part_of("doc_id", "text").alias("part"),
            hashed("doc_id").alias("h"), hashed("text").alias("t"), "doc_id", "text",
        ).collect()
        rows.sort(key=lambda r: (r.place, r.part, r.h, r.doc_id or 0, r.t))
        owners, nodes = sharding.ring(spark, 5, 512, 8)
        room = sharding.capacities(len(rows), 5, balance)
        expected = plain_ring([(r.place, (r.doc_id, r.text)) for r in rows], owners, nodes, room)
        got = sharding.shard(docs, 5, balance=balance, slots=512, nodes=8).collect()
        assert collections.Counter(((r.doc_id, r.text), r.shard, r.slot) for r in got) == expected


def test_room_limits_movement(given):
    def moved(balance):
        before, after = (
            {r.doc_id: r.shard for r in sharding.shard(given, n, balance=balance).collect()} for n in (16, 17)
        )
        return sum(before[k] != after[k] for k in before) / len(before)

    assert moved(2.0) < 0.3 and moved(2.0) <= moved(1.0)


def test_quality(spark, given):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = {r.id: r for r in quality.classify(given, labels).collect()}
    right = [((r.quality == 1 and r.toxic == 0) == rows[r.doc_id].keep) for r in labels.collect() if r.doc_id in rows]
    assert len(rows) == given.count() and sum(right) >= 0.8 * len(right)


def test_sites_shrink(spark):
    docs = spark.createDataFrame([(k, f"h{k % 10}", f"h{k % 10}/p") for k in range(1001)], "id long, host string, path string")
    labels = spark.createDataFrame([(k, int(k % 10 == 0), 0) for k in range(1000)], "id long, low int, toxic int")
    shift = {r.host: r.low_shift for r in quality.sites(docs, labels).collect()}
    assert shift["h0"] > 3 and all(shift[f"h{k}"] < 0 for k in range(1, 10))


def strength_by_hand(groups):
    """``groups``: bad, n and prior mean each."""
    groups = [(bad, n, m) for bad, n, m in groups if n]
    excess = sum((bad - n * m) ** 2 - n * m * (1 - m) for bad, n, m in groups)
    pairs = sum(n * (n - 1) for _, n, _ in groups)
    if not pairs or excess <= 0:
        return 1e6
    spread = sum(m * (1 - m) for _, _, m in groups) / len(groups)
    return min(max(spread / (excess / pairs) - 1, 1), 1e6)


def test_posteriors_equal_brute_force(spark, given):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    known = {r.doc_id: {"low": 1 - r.quality, "toxic": r.toxic} for r in labels.collect()}
    docs = given.select("doc_id", "source", "lang").collect()
    rows = {r.id: r for r in quality.classify(given, labels).collect()}
    for target in quality.TARGETS:
        paths, hosts = collections.defaultdict(lambda: [0, 0]), collections.defaultdict(lambda: [0, 0])
        for r in docs:
            if r.doc_id in known:
                for total in (paths[r.source, r.lang], hosts[r.source]):
                    total[0] += known[r.doc_id][target]
                    total[1] += 1
        rate = sum(b for b, _ in hosts.values()) / sum(n for _, n in hosts.values())
        s = strength_by_hand([(b, n, rate) for b, n in hosts.values()])
        host = {k: (b + s * rate) / (n + s) for k, (b, n) in hosts.items()}
        s = strength_by_hand([(b, n, host[k[0]]) for k, (b, n) in paths.items()])
        path = {k: (b + s * host[k[0]]) / (n + s) for k, (b, n) in paths.items()}
        odds = lambda p: math.log(p / (1 - p))
        for r in docs:
            site = path.get((r.source, r.lang))
            shift = odds(min(max(site, 1e-6), 1 - 1e-6)) - odds(rate) if site is not None else 0
            got = rows[r.doc_id]
            assert got[f"p_{target}"] == pytest.approx(1 / (1 + math.exp(-got[f"{target}_evidence"] - shift)), abs=1e-9)
    assert all(r.keep == (r.p_low < 0.5 and r.p_toxic < 0.5) for r in rows.values())


def test_odd_labels(spark, odd):
    labels = spark.createDataFrame(
        [(1, 1, 0), (1, 0, None), (None, 0, 1), (2, None, None), (77, 0, 0)], "doc_id long, quality int, toxic int"
    )
    kept = quality.keep_good(odd, labels)
    assert kept.columns == odd.columns and kept.count() <= odd.count()
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.keep_good(odd, none).count() == odd.count()


def test_empty_tables(spark, nothing):
    none = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    path = public_tokenizers.path("word_bpe_49k.json")
    for result in (
        substrings.remove_repeats(nothing),
        suffixes.remove_repeats(nothing),
        ngram_join.near_duplicates(nothing),
        ngram_join.keep_one(nothing),
        decontaminate.find_items(nothing, none),
        tokens.count_tokens(nothing, path),
        lm.score_all(nothing),
        ann.nearest(vectors, lambda i: i % 20 == 0),
        mixing.mix(nothing),
        mixing.take(nothing),
        sharding.shard(nothing, 16),
        quality.classify(nothing, labels),
    ):
        assert result.collect() == []


def test_shuffle_files_go_without_garbage_collection(spark):
    """What ``finished`` shuffles is let go when it is written, not some time later."""
    system = SimpleNamespace(gc=lambda: None)
    held = SimpleNamespace(conf=spark.conf, _jvm=SimpleNamespace(System=system, org=spark._jvm.org), _jsc=spark._jsc)
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {f.name for folder in disk.localDirsString() for f in Path(folder).glob("*/shuffle_*")}

    before = shuffled()
    rows = spark.range(1000).select((F.col("id") % 7).alias("k")).repartition(3, "k")
    kept = scratch.finished(held, lambda: rows.groupBy("k").count())
    until = time.time() + 20
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before
    assert spark.conf.get(scratch._LET_GO) == "false"
    assert kept.count() == 7
