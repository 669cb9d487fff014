"""Token counts by heap-and-linked-list byte-pair merging.

A word starts as one symbol per byte, the last one marked as a word's end. The adjacent pair of
lowest rank is popped from a heap and merged in a linked list, again and again; the count is the
number of symbols minus the merges. No identifiers are made.

Words repeat, so each task keeps the counts of the words it has seen, up to a bound. Nulls and
empty texts have no tokens; repeated rows are counted each; a text is never cut.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
import zlib

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellquery.llm.scratch import prepare

#: Words whose counts a task keeps; beyond it, it starts anew.
KNOWN_WORDS = 500_000


def read_merges(path: str) -> dict:
    """Ranks, split pattern and special strings of a vocabulary file with word-end merges."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model = spec["model"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    steps = spec["pre_tokenizer"]["pretokenizers"]
    return {
        "key": zlib.crc32(json.dumps(spec, sort_keys=True).encode()),
        "ranks": {(a, b): k for k, (a, b) in enumerate(pairs)},
        "end": model["end_of_word_suffix"],
        "pattern": next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split"),
        "special": [t["content"] for t in spec["added_tokens"]],
    }


@functools.cache
def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable Latin-1, else 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


BYTES = byte_symbols()


def count_merged(symbols: list[str], ranks: dict) -> int:
    """Symbols left when no adjacent pair has a rank any more; ties go to the leftmost pair."""
    size = len(symbols)
    if size == 1:
        return 1
    after = list(range(1, size + 1))
    before = list(range(-1, size - 1))
    ranked = map(ranks.get, zip(symbols, symbols[1:]))
    heap = [(rank, at) for at, rank in enumerate(ranked) if rank is not None]
    heapq.heapify(heap)
    left = size
    while heap:
        rank, at = heapq.heappop(heap)
        other = after[at]
        if other >= size or ranks.get((symbols[at], symbols[other])) != rank:
            continue  # the pair is gone
        symbols[at] += symbols[other]
        symbols[other] = ""
        after[at] = far = after[other]
        left -= 1
        if far < size:
            before[far] = at
            if (rank := ranks.get((symbols[at], symbols[far]))) is not None:
                heapq.heappush(heap, (rank, at))
        if (low := before[at]) >= 0 and (rank := ranks.get((symbols[low], symbols[at]))) is not None:
            heapq.heappush(heap, (rank, low))
    return left


class Counter(dict):
    """Token counts of words between white space; a missing word is counted when asked for."""

    def __init__(self, merges: dict):
        super().__init__()
        self.merges, self.known = merges, KNOWN_WORDS
        self.pieces = regex.compile(merges["pattern"])
        self.special = re.compile("|".join(map(re.escape, merges["special"])) or r"(?!)")
        self.marks = tuple(merges["special"])
        self.piece = functools.lru_cache(KNOWN_WORDS)(self.count_piece)

    def count_piece(self, piece: str) -> int:
        symbols = [BYTES[b] for b in piece.encode()]
        symbols[-1] += self.merges["end"]
        return count_merged(symbols, self.merges["ranks"])

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings: composed, lower case letter by letter, split."""
        text = unicodedata.normalize("NFC", text)
        text = text.lower() if text.isascii() else "".join(map(str.lower, text))
        return sum(map(self.piece, self.pieces.findall(text)))

    def __missing__(self, word: str) -> int:
        if len(self) >= self.known:
            self.clear()
        self[word] = found = self.plain(word)
        return found

    def count(self, text: str) -> int:
        """No token holds white space, so words are counted apart. The controls 28 to 31 are white
        space to ``split`` but not to the tokenizer; they and special strings take the long way."""
        if any(mark in text for mark in self.marks):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(map(self.count, parts))
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self.plain(text)
        return sum(map(self.__getitem__, text.split()))


_kept: dict[int, Counter] = {}


def counter_of(sent) -> Counter:
    """The counter of this worker process; the next task in it finds the words already counted."""
    if sent.value["key"] not in _kept:
        _kept.clear()
        _kept[sent.value["key"]] = Counter(sent.value)
    return _kept[sent.value["key"]]


def count_tokens(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048
) -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit`` per row; ``path`` is the driver's vocabulary file.

    The ranks (of fixed size) go to the tasks; there is no shuffle.
    """
    prepare(docs)
    sent = docs.sparkSession.sparkContext.broadcast(read_merges(path))

    def count(batches):
        counter = counter_of(sent)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
            found = pa.array([counter.count(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, found], ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    out = rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
