"""Evaluation passages in training text, found with a distributed positional inverted index.

The index is partitioned by document: each block of texts has, for every term, the delta-coded list of its positions in
the block's token stream. A search fetches the lists of the test terms only. In each block it starts from the rarest term
of each window of the passage, whose positions, adjusted by the term's offset, give the possible starts of the passage;
these are intersected with the adjusted lists of all other terms. Runs of ``length`` consecutive offsets on one start are
phrase matches; windows of twice the length in which as many offsets occur within ``slack`` places of one start are proximity
matches. Any term may be missing from those, so their starts are where several of the rarest terms of a window agree, of
which there are so many that no match can miss them.

Words are maximal runs of letters and digits, compared without case and accents, compatibility forms resolved. Defined
results for odd input: null and empty texts match nothing; passages shorter than ``length`` words match nothing; repeated
rows and copies match each under its id; items that share a sentence are all reported; an empty table gives no match.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import materialize, scratch_path

_word = re.compile(r"[^\W_]+").findall
_marks = re.compile(r"[̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯]+")
#: Tokens of a block, about; a text is never divided. Empty positions between two texts, more than a proximity window spans.
BLOCK_TOKENS, GAP = 1_000_000, 4096
#: Items searched at once, which bounds what the driver and a broadcast hold.
ITEM_BLOCK = 10_000
#: Terms of a proximity match that must agree before all others are looked at. Any number up to ``length`` finds all matches.
NEAR_LEAST = 5


def words(text: str) -> list[str]:
    """Words of a text as they are compared."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.casefold())
        text = _marks.sub("", unicodedata.normalize("NFKD", text.casefold()))
    else:
        text = text.lower()
    return _word(text)


def encode(positions: np.ndarray) -> bytes:
    """Sorted positions as variable-length deltas, seven bits a byte, low bits first."""
    deltas = np.diff(positions, prepend=0).astype(np.uint64)
    # a block spans less than 2 ** 35 positions
    size = 1 + sum((deltas >= (1 << (7 * k))).astype(np.int64) for k in range(1, 5))
    ends = np.cumsum(size)
    out = np.zeros(ends[-1] if ends.size else 0, np.uint8)
    for k in range(int(size.max()) if size.size else 0):
        at = size > k
        out[(ends - size)[at] + k] = ((deltas[at] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | (np.uint8(128) * (size[at] > k + 1))
    return out.tobytes()


def decode(blob: bytes) -> np.ndarray:
    data = np.frombuffer(blob, np.uint8)
    if not data.size:
        return np.zeros(0, np.int64)
    last = data < 128
    group = np.cumsum(last) - last
    first = np.flatnonzero(np.r_[True, last[:-1]])
    shift = np.arange(data.size) - first[group]
    return np.cumsum(np.add.reduceat((data & 127).astype(np.int64) << (7 * shift), first))


class Codes(dict):
    """Codes of the words of what stands between two blanks, each resolved once; ``terms`` are the words by code."""

    #: Chunks held before the tables are begun anew.
    FULL = 1_000_000

    def __init__(self) -> None:
        super().__init__()
        self.terms: list[str] = []
        self.index: dict[str, int] = {}

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        out = []
        for w in words(chunk):
            code = self.index.get(w)
            if code is None:
                code = self.index[w] = len(self.terms)
                self.terms.append(w)
            out.append(code)
        self[chunk] = found = tuple(out)
        return found

    def read(self, text: str) -> np.ndarray:
        # blanks end words, and no form of a word reaches over one
        return np.fromiter(chain.from_iterable(map(self.__getitem__, text.split())), np.int64)


INDEX = "block string, term string, n int, positions binary, documents binary"


def build_index(df: DataFrame, key: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The positional index of whole texts: one row per block and term, and per block one row with the null term that has
    the documents' ids (``documents``, as int64) and first positions."""

    def block_rows(number: int, ids: list[int], starts: list[int], tokens: list[np.ndarray], known: Codes) -> pa.RecordBatch:
        place = np.concatenate([s + np.arange(t.size) for s, t in zip(starts, tokens)])
        codes = np.concatenate(tokens)
        order = np.argsort(codes, kind="stable")
        place, codes = place[order], codes[order]
        first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        ends = np.r_[first[1:], codes.size]
        counts, vocabulary = ends - first, [known.terms[c] for c in codes[first].tolist()]
        name = f"{ids[0] if ids else 0}-{number}-{len(ids)}"
        terms, ns = [None, *vocabulary], [len(ids), *counts.tolist()]
        blobs = [encode(np.array(starts, np.int64)), *(encode(place[e - c : e]) for e, c in zip(ends.tolist(), counts.tolist()))]
        documents = [np.array(ids, np.int64).tobytes()] + [None] * len(vocabulary)
        return pa.RecordBatch.from_arrays(
            [pa.array([name] * len(terms)), pa.array(terms, pa.string()), pa.array(ns, pa.int32()), pa.array(blobs, pa.binary()), pa.array(documents, pa.binary())],
            names=["block", "term", "n", "positions", "documents"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        number, ids, starts, tokens, size, at, known = 0, [], [], [], 0, 0, Codes()
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                codes = known.read(t)
                if i is None or not codes.size:
                    continue
                ids.append(i)
                starts.append(at)
                tokens.append(codes)
                at += codes.size + GAP
                size += codes.size
                if size >= block_tokens:
                    yield block_rows(part * 100_000 + number, ids, starts, tokens, known)
                    number, ids, starts, tokens, size, at = number + 1, [], [], [], 0, 0
                    known = Codes() if len(known) > Codes.FULL else known
        if ids:
            yield block_rows(part * 100_000 + number, ids, starts, tokens, known)

    return df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).filter(F.col("text").isNotNull()).mapInArrow(run, INDEX)


def _member(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not sorted_values.size:
        return np.zeros(wanted.shape, bool)
    at = np.minimum(np.searchsorted(sorted_values, wanted), sorted_values.size - 1)
    return sorted_values[at] == wanted


def _within(sorted_values: np.ndarray, wanted: np.ndarray, slack: int) -> np.ndarray:
    """For each wanted position the first value within ``slack`` places of it, or -1."""
    if not sorted_values.size:
        return np.full(wanted.shape, -1, np.int64)
    found = sorted_values[np.minimum(np.searchsorted(sorted_values, wanted - slack), sorted_values.size - 1)]
    return np.where(np.abs(found - wanted) <= slack, found, -1)


def runs_of(hits: np.ndarray, least: int) -> list[tuple[int, int]]:
    """``(end, length)`` of the runs of at least ``least`` true values; the end is that of the last one."""
    edges = np.flatnonzero(np.diff(np.r_[False, hits, False].astype(np.int8)))
    return [(int(z) - 1, int(z - a)) for a, z in zip(edges[::2], edges[1::2]) if z - a >= least]


def anchors(passage: list[str], frequency: dict[str, int], length: int) -> list[int]:
    """Offsets of the rarest term of each window of ``length`` words."""
    rank = [frequency.get(w, 0) for w in passage]
    return sorted({min(range(s, s + length), key=lambda p: (rank[p], -p)) for s in range(len(passage) - length + 1)})


def near_offsets(passage: list[str], frequency: dict[str, int], length: int, least: int) -> list[int]:
    """Offsets of which every window of twice the length that has ``length`` words of a match has at least ``least``: as
    many can miss as the window has words beyond ``length``. The rarest ones; a term that occurs nowhere is one that misses."""
    width = min(2 * length, len(passage))
    rank = [frequency.get(w, 0) for w in passage]
    rarest = (sorted(range(s, s + width), key=lambda p: (rank[p], p))[: width - length + least] for s in range(len(passage) - width + 1))
    return sorted({p for window in rarest for p in window if rank[p]})


def near_starts(lists: dict[str, np.ndarray], passage: list[str], offsets: list[int], slack: int, least: int) -> np.ndarray:
    """All starts within ``slack`` places of which ``least`` of the offsets' terms occur."""
    begin = [lists[passage[p]] - p for p in offsets if passage[p] in lists]
    at = np.sort(np.concatenate(begin)) if begin else np.zeros(0, np.int64)
    if at.size < least:
        return np.zeros(0, np.int64)
    first, last = at[: at.size - least + 1], at[least - 1 :]
    close = np.flatnonzero(last - first <= 2 * slack)
    first, last = first[close] + slack, last[close] - slack
    return np.unique(np.concatenate([(last + d)[last + d <= first] for d in range(2 * slack + 1)]))


def match_block(lists: dict[str, np.ndarray], starts: np.ndarray, ids: np.ndarray, passages: list[tuple[int, list[str]]], frequency: dict[str, int], length: int, slack: int | None) -> list[tuple[int, int, str, int]]:
    """``(document, item, kind, words)`` of one block; without a slack of phrases only."""
    empty, best = np.zeros(0, np.int64), {}

    def keep(where: int, item: int, value: tuple[bool, int]) -> None:
        doc = int(ids[np.searchsorted(starts, where, "right") - 1])
        if value > best.get((doc, item), (False, 0)):
            best[doc, item] = value

    least = min(NEAR_LEAST, length)
    for item, passage in passages:
        if len(passage) < length:
            continue
        begin = [lists[passage[p]] - p for p in anchors(passage, frequency, length) if passage[p] in lists]
        candidates = np.unique(np.concatenate(begin)) if begin else empty
        if candidates.size:
            hits = np.stack([_member(lists.get(w, empty), candidates + p) for p, w in enumerate(passage)], axis=1)
            for k in np.flatnonzero(hits.sum(axis=1) >= length):
                # a run is in one document, as there are empty positions between two; those of a long passage may be in several
                for end, n in runs_of(hits[k], length):
                    keep(candidates[k] + end, item, (True, n))
        if slack is None:
            continue
        # offsets that occur within slack places of a start, in any window of twice the length
        near = near_starts(lists, passage, near_offsets(passage, frequency, length, least), slack, least)
        if near.size:
            places = np.stack([_within(lists.get(w, empty), near + p, slack) for p, w in enumerate(passage)], axis=1)
            width = min(2 * length, len(passage))
            total = np.cumsum(np.pad(places >= 0, ((0, 0), (1, 0))), axis=1)
            sums = total[:, width:] - total[:, :-width]
            # all words of a window are in one document, which may begin after the passage's own start
            for k, s in zip(*np.nonzero(sums >= length)):
                keep(int(places[k, s : s + width].max()), item, (False, int(sums[k, s])))
    return [(doc, item, "phrase" if phrase else "proximity", n) for (doc, item), (phrase, n) in best.items()]


def find_leaks(index: DataFrame, items: DataFrame, length: int = 13, slack: int | None = 3, item: str = "item_id", passage: str = "passage") -> DataFrame:
    """``(doc_id, item_id, match_kind, n_words)`` of all texts of the index that hold a part of a test item; with ``slack`` None
    phrases only.

    The items are searched in blocks of ``ITEM_BLOCK``, one of which the driver holds at a time; the result of each of several
    blocks is written before the next is read.
    """
    if slack is not None and 2 * (length + slack) >= GAP:
        raise ValueError(f"a proximity window of {2 * (length + slack)} places would reach over the {GAP} between two texts")
    spark = index.sparkSession
    given = items.select(F.col(item).alias("item"), F.col(passage).alias("passage")).dropna().distinct()
    blocks = -(-given.count() // ITEM_BLOCK)
    if blocks <= 1:
        return _search(index, given.collect(), length, slack)
    placed = given.withColumn("block", F.pmod(F.xxhash64("item", "passage"), F.lit(2 * blocks)))
    path = scratch_path(spark, "leaks")
    for k in range(2 * blocks):
        _search(index, placed.filter(F.col("block") == k).collect(), length, slack).write.mode("append").parquet(path)
    return _best_match(spark.read.parquet(path))


def _best_match(found: DataFrame) -> DataFrame:
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("match_kind") == "phrase", "n_words", "match_kind")).alias("b")).select("doc_id", "item_id", "b.match_kind", "b.n_words")


def _search(index: DataFrame, items: list, length: int, slack: int | None) -> DataFrame:
    spark = index.sparkSession
    passages = [(r[0], words(r[1])) for r in items]
    terms = spark.createDataFrame([(w,) for w in sorted({w for _, p in passages for w in p})], "term string")
    wanted = index.join(F.broadcast(terms), "term", "left_semi").unionByName(index.filter(F.col("term").isNull()))
    frequency = {r["term"]: r["n"] for r in wanted.filter("term is not null").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    shared = spark.sparkContext.broadcast((passages, frequency))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, starts, ids = {}, None, None
        for b in batches:
            for term, blob, documents in zip(b.column("term").to_pylist(), b.column("positions").to_pylist(), b.column("documents").to_pylist()):
                if term is None:
                    starts, ids = decode(blob), np.frombuffer(documents, np.int64)
                else:
                    lists[term] = decode(blob)
        found = match_block(lists, starts, ids, *shared.value, length, slack) if starts is not None else []
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else ([],) * 4, (pa.int64(), pa.int64(), pa.string(), pa.int32()))], names=["doc_id", "item_id", "match_kind", "n_words"])

    # a block has about BLOCK_TOKENS tokens, which bounds its lists
    blocks = wanted.select("block", "term", "positions", "documents")
    return _best_match(blocks.groupBy("block").applyInArrow(lambda t: pa.Table.from_batches(list(run(iter(t.to_batches())))), "doc_id bigint, item_id bigint, match_kind string, n_words int"))


def leaks(documents: DataFrame, items: DataFrame, length: int = 13, slack: int | None = 3) -> DataFrame:
    """Index the texts (written to the shared folder) and search all items in it."""
    return find_leaks(materialize(build_index(documents), "index"), items, length, slack)
