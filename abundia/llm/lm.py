"""Language-model scoring with sharded Elias-Fano n-gram tries.

Words, pairs and triples of all training documents are counted, and every one of them
is in the model: no vocabulary, count threshold or size limit leaves any out.
Smoothing is interpolated absolute discounting of triples over pairs over add-one words,
so probabilities of a context sum to one.

The tries are split by the middle word of a triple, whose shard then holds all that the
triple needs: the pairs and the triples that share this word. Shards have about ``SHARD``
tokens, so their number grows with the input and their size does not. A word in
more tokens than half a shard is dealt on by the word before it; its pairs are counted by
themselves, and the counts of those that stand in several of its shards are sent to these. If that takes more than ``DICTIONARY``
rows, the pairs that stand in most shards, as many as that, are in a file as frequent words are, and only the others are sent. In ``ROUNDS`` rounds every task sends the triples of its
texts to the shards as packed blocks, so that no more than a part of them is on
disk at once; a shard builds its trie, looks all of them up and returns a sum for each document of a block.
Documents are numbered inside the chunk of texts that made the blocks; their keys travel once in a round, and the sums meet by chunk.

A trie has levels for pairs and triples. A level holds, for every parent, its
children's word ids in order. Two Elias-Fano sequences describe it: the
monotone pointers to the first child of each parent, and the children made
monotone by adding parent * vocabulary; a child is found by successor search
relative to its context: the upper bits name a short run, inside which the low
bits are searched. Counts are kept as they are.

Word counts: the ``DICTIONARY`` words of highest count are in a file that every executor
maps into memory; other words are joined with the table of all counts, for the base
score and for the shards alike, so no word is cut off.

Defined cases: null and empty texts have one token, the end; a null doc_id is not
held out; repeated rows are scored alike; an empty table gives an empty result;
without training tokens only the add-one terms are left; extra columns are not read.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abundia.llm import common as C
from abundia.llm.common import saved

DICTIONARY = 1 << 20
#: Tokens of a shard of the trie, about.
SHARD = 1 << 19
#: Parts in which the shards are filled, one after the other.
ROUNDS = 3
DISCOUNT = 0.75
#: Tokens whose n-grams are counted or sent together by a task.
CHUNK = 1 << 21
END, START, NONE = (int(x) for x in C.mix(np.arange(1, 4, dtype=np.uint64) * np.uint64(C.BASE)))


# -- Elias-Fano ------------------------------------------------------------------------


@dataclass
class EliasFano:
    """A monotone sequence: low bits as they are, upper parts in unary."""

    low: np.ndarray
    unary: np.ndarray  # bits of the upper parts, packed
    ends: np.ndarray  # per upper part, elements up to it: the select directory, from ``unary``
    shift: int
    size: int

    @staticmethod
    def arrays(values: np.ndarray) -> dict[str, np.ndarray]:
        values = values.astype(np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        ratio = max(1, top // max(1, n))
        kind, shift = (np.uint8, 8) if ratio < 1 << 12 else (np.uint16, 16) if ratio < 1 << 20 else (np.uint32, 32)
        high = (values >> np.uint64(shift)).astype(np.int64)
        bits = np.zeros(n + (top >> shift) + 1, np.uint8)
        bits[high + np.arange(n)] = 1
        return {"low": (values & np.uint64((1 << shift) - 1)).astype(kind), "unary": np.packbits(bits), "shape": np.array([shift, n, len(bits)], np.int64)}

    @classmethod
    def of(cls, parts: dict[str, np.ndarray]) -> EliasFano:
        shift, n, length = (int(x) for x in parts["shape"])
        zeros = np.flatnonzero(np.unpackbits(parts["unary"], count=length) == 0)
        return cls(parts["low"], parts["unary"], (zeros - np.arange(len(zeros))).astype(np.int32), shift, n)

    def access(self, i: np.ndarray) -> np.ndarray:
        high = np.searchsorted(self.ends, i, "right")
        return (high.astype(np.int64) << self.shift) | self.low[i].astype(np.int64)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Place of each value, or -1: search for the successor among the elements with the same upper part."""
        high = values >> self.shift
        inside = high < len(self.ends)
        high = np.where(inside, high, 0)
        a = np.where(high > 0, self.ends[high - 1], 0).astype(np.int64)
        b = np.where(inside, self.ends[high], a).astype(np.int64)
        low, stop = (values & ((1 << self.shift) - 1)).astype(self.low.dtype), b.copy()
        active = np.flatnonzero(a < b)
        while len(active):
            mid = (a[active] + b[active]) >> 1
            less = self.low[mid] < low[active]
            a[active] = np.where(less, mid + 1, a[active])
            b[active] = np.where(less, b[active], mid)
            active = active[a[active] < b[active]]
        hit = a < stop
        hit[hit] = self.low[a[hit]] == low[hit]
        return np.where(hit, a, -1)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct values, place of each value among them), by hashing; only the distinct ones are sorted."""
    coded = pa.array(values.view(np.int64)).dictionary_encode()
    kinds = coded.dictionary.to_numpy().view(values.dtype)
    order = np.argsort(kinds)
    place = np.empty(len(kinds), np.int32)
    place[order] = np.arange(len(kinds), dtype=np.int32)
    return kinds[order], place[coded.indices.to_numpy()]


# -- the model -------------------------------------------------------------------------


class Trie:
    """All training n-grams of a shard; words are numbers below ``size``.

    ``pairs`` (parent * size + child, sorted) have counts ``two``; ``contexts`` are sorted numbers of word pairs (v, u),
    ``triples`` (place of the context * size + child, sorted) have counts ``three``.
    """

    def __init__(self, size: int, pairs: np.ndarray, two: np.ndarray, contexts: int, triples: np.ndarray, three: np.ndarray):
        self.size, self.two, self.three = size, two, three
        self.children = [EliasFano.of(EliasFano.arrays(x)) for x in (pairs, triples)]
        first = [np.searchsorted(x, np.arange(n + 1) * size) for x, n in ((pairs, size), (triples, contexts))]
        self.pointers = [EliasFano.of(EliasFano.arrays(x)) for x in first]
        self.sums = [np.concatenate([[0], np.cumsum(c)]) for c in (two, three)]

    def count(self, level: int, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Training count of each child, 0 where it is not in the trie."""
        kept = (self.two, self.three)[level]
        if not len(kept):
            return np.zeros(len(parent), np.int64)
        at = self.children[level].find(parent * self.size + word)
        return np.where(at >= 0, kept[np.maximum(at, 0)], 0)

    def context(self, level: int, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, distinct words) that follow each parent in training."""
        a, b = self.pointers[level].access(parent), self.pointers[level].access(parent + 1)
        return self.sums[level][b] - self.sums[level][a], b - a


def mixed(count: np.ndarray, total: np.ndarray, kinds: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Discounted share of a child in its context and the lower order's part; the lower order alone in an unknown context."""
    known = np.maximum(total, 1)
    return np.where(total > 0, (np.maximum(count - DISCOUNT, 0.0) + DISCOUNT * kinds * lower) / known, lower)


def shard_scores(u: np.ndarray, v: np.ndarray, w: np.ndarray, times: np.ndarray, size: int, none: int, p1: np.ndarray, hot: tuple, listed=None) -> tuple[np.ndarray, np.ndarray]:
    """(log10 P(w | u, v) of the distinct triples, place of each row among them).

    ``times`` is 1 for rows in training, else 0; ``none`` marks a ``u`` that is not there; ``p1`` has the probability of each
    word; ``hot`` has the words that other shards hold too, tokens and distinct words after each of them in all shards, and
    those of their pairs that other shards hold too (v, w, count); ``listed`` tells which pairs are in the file of pairs, and their counts.
    """
    contexts, at = distinct(v * size + u)
    keys, place = distinct(at.astype(np.int64) * size + w)
    three = np.bincount(place, weights=times, minlength=len(keys)).astype(np.int64)
    own, word = keys // size, keys % size
    middle, before = contexts[own] // size, contexts[own] % size
    pairs, which = distinct(middle * size + word)
    two = np.bincount(which, weights=three, minlength=len(pairs)).astype(np.int64)
    outside, after, kinds, hot_v, hot_w, hot_c = hot
    two[np.searchsorted(pairs, hot_v * size + hot_w)] = hot_c  # every pair that comes stands in this shard too
    parent, child = pairs // size, pairs % size
    if listed is not None:
        far = np.flatnonzero(np.isin(parent, outside))
        known, count = listed(parent[far], child[far])
        two[far[known]] = count[known]
    mine, seen = two > 0, three > 0
    trie = Trie(size, pairs[mine], two[mine], len(contexts), keys[seen], three[seen])
    total, followers = trie.context(0, parent)
    if len(outside):
        at = np.minimum(np.searchsorted(outside, parent), len(outside) - 1)
        total, followers = (np.where(outside[at] == parent, a, b) for a, b in ((after[at], total), (kinds[at], followers)))
    lower = mixed(trie.count(0, parent, child), total, followers, p1[child])[which]
    full = mixed(trie.count(1, own, word), *trie.context(1, own), lower)
    return np.log10(np.where(before == none, lower, full)), place


def write_file(arrays: dict[str, np.ndarray], path: str) -> list[tuple[str, str, int, int]]:
    """All arrays in one file; the header tells (name, type, length, place)."""
    header, at = [], 0
    with open(path, "wb") as out:
        for name, array in arrays.items():
            gap = -at % 8
            out.write(b"\0" * gap)
            header.append((name, array.dtype.str, len(array), at + gap))
            out.write(np.ascontiguousarray(array).tobytes())
            at += gap + array.nbytes
        out.write(b"\0" * 8)
    return header


def shipped(spark: SparkSession, keys: np.ndarray, counts: np.ndarray) -> tuple[str, list]:
    """(name, header) of a file of counts by key that Spark hands to every executor, also to later ones."""
    order = np.argsort(keys)
    name = f"words-{uuid.uuid4().hex}.bin"
    path = os.path.join(tempfile.mkdtemp(prefix="abundia-words-"), name)
    header = write_file({"words": keys[order], "counts": counts[order]}, path)
    spark.sparkContext.addFile(path)
    return name, header


class Dictionary:
    """A file of counts by word, or by pair of words, mapped into memory."""

    def __init__(self, path: str, header: list[tuple[str, str, int, int]]):
        file = np.memmap(path, np.uint8, "r")
        self.words, self.counts = (np.frombuffer(file, kind, n, at) for _, kind, n, at in header)

    def look_up(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each word is in the file, its count or 0)."""
        if not len(self.words):
            return np.zeros(len(words), bool), np.zeros(len(words), np.int64)
        at = self.places(words)
        return at >= 0, np.where(at >= 0, self.counts[at], 0)

    def places(self, words: np.ndarray) -> np.ndarray:
        """Place of each word in the file, or -1."""
        if not len(self.words):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, at, -1)


# -- counting and scoring in Spark ------------------------------------------------------


def _rows(docs: DataFrame, folds: int, held: int) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    out = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string")) % folds == held, F.lit(False))
    rows = docs.select(C.id_or_least().alias("id"), F.xxhash64(text).alias("text_key"), out.alias("held_out"), text.alias("text"))
    return rows.withColumn("key", F.xxhash64("id", "text_key"))


def _tokens(batch: pa.RecordBatch):
    """(first row, row of each token, tokens with an end after each text) by pieces."""
    offsets, data = C.text_buffers(batch.column(batch.schema.get_field_index("text")))
    for low, high in C.pieces(offsets):
        words = C.Words(offsets[low : high + 1], data[offsets[low] : offsets[high]], lower=True)
        prints, n = words.hashes(), np.diff(words.bounds)
        row = np.repeat(np.arange(high - low), n + 1)
        tokens = np.full(len(row), END, np.uint64)
        body = np.ones(len(row), bool)
        body[np.cumsum(n + 1) - 1] = False
        tokens[body] = prints
        yield low, row, tokens


def _numbered(tokens: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, u, v, w): distinct words, and the triple that ends at each token as places in them; START before the first, NONE before that."""
    words, last = distinct(np.concatenate([tokens, np.array([START, NONE], np.uint64)]))
    start, none, last = last[-2], last[-1], last[:-2]
    new = np.ones(len(row), bool)
    new[1:] = row[1:] != row[:-1]
    middle = np.where(new, start, np.roll(last, 1))
    return words, np.where(new, none, np.roll(middle, 1)), middle, last


def _counted(chunk: int):
    """A task function that counts the tokens of its texts, a chunk at a time."""

    def flush(held):
        words, place = distinct(np.concatenate(held))
        return pa.RecordBatch.from_arrays([C.longs(words), pa.array(np.bincount(place, minlength=len(words)))], ["w", "c"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for _, _, tokens in _tokens(batch):
                held.append(tokens)
                size += len(tokens)
                if size >= chunk:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    return run


def least_count(table: DataFrame, most: int) -> int:
    """Least count c such that at most ``most`` rows count c or more, from the histogram of all counts."""
    level = F.when(F.col("c") < 65536, F.col("c")).otherwise(65536 * F.floor(F.log2("c")))
    bars = sorted(table.groupBy(level.cast("long").alias("level")).agg(F.count("*").alias("n"), F.min("c").alias("c")).collect(), reverse=True)
    have, least = 0, None
    for bar in bars:
        have += bar["n"]
        if have > most:
            break
        least = bar["c"]
    return least if least is not None else (1 << 62)


class Shards:
    """Which shard a triple goes to."""

    def __init__(self, number: int, hot: np.ndarray, parts: np.ndarray):
        self.number, self.hot, self.parts = number, hot, parts
        #: The file of the pairs that stand in most shards, if there is one.
        self.listed: tuple[str, list] | None = None

    def of(self, words: np.ndarray, first: np.ndarray, middle: np.ndarray, last: np.ndarray) -> np.ndarray:
        """By the middle word; a word in ``hot`` also by what is before it, or by the last word where there is nothing. Triples are places in ``words``."""
        out = (C.mix(words) % np.uint64(self.number)).astype(np.int32)[middle]
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, words), len(self.hot) - 1)
            parts = np.where(self.hot[at] == words, self.parts[at], np.uint64(0))
            some = np.flatnonzero((parts > 0)[middle])
            v, deal = middle[some], np.where(words[first[some]] == NONE, last[some], first[some])
            key = self._part(words[v], C.mix(words + np.uint64(C.BASE))[deal] % parts[v])
            out[some] = C.mix(key) % np.uint64(self.number)
        return out

    @staticmethod
    def _part(v: np.ndarray, part: np.ndarray) -> np.ndarray:
        return C.mix(v + (part + np.uint64(1)) * np.uint64(C.BASE))

    def homes(self) -> list[tuple[int, int]]:
        """(word, shard) of every shard that a word in ``hot`` is dealt to."""
        out = set()
        for word, n in zip(self.hot, self.parts, strict=True):
            keys = self._part(np.full(int(n), word, np.uint64), np.arange(int(n), dtype=np.uint64))
            out |= {(int(word.view(np.int64)), int(s)) for s in C.mix(keys) % np.uint64(self.number)}
        return sorted(out)


RARE, PAIR, CONTEXT = range(3)
BLOCK = "shard int, chunk long, data binary"
ANSWER = "chunk long, data binary"
SUMS = "key long, score double, more double, gain double"
KINDS = {1: np.uint8, 2: np.uint16, 4: np.uint32}


def _narrow(numbers: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as the largest needs, first bytes first; the first byte tells how many."""
    top = int(numbers.max()) if len(numbers) else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4
    return bytes([width]) + numbers.astype(KINDS[width]).view(np.uint8).reshape(-1, width).T.tobytes()


def _wide(data: bytes) -> np.ndarray:
    width = data[0]
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, offset=1).reshape(width, -1).T).view(KINDS[width]).ravel()


def _packed(parts: list[bytes]) -> bytes:
    """Several byte strings as one, compressed; their lengths stand before it."""
    body = b"".join(parts)
    return np.array([len(parts), *map(len, parts)], np.uint32).tobytes() + pa.compress(body, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    ends = np.concatenate([[0], np.cumsum(np.frombuffer(data, np.uint32, n, 4), dtype=np.int64)])
    body = pa.decompress(data[4 + 4 * n :], decompressed_size=int(ends[-1]), codec="zstd", asbytes=True)
    return [body[low:high] for low, high in zip(ends, ends[1:], strict=False)]


def _chunks(flush, chunk: int):
    """A task function that gives (tokens, row, key and training mark of the rows) of (key, held_out, text) rows to ``flush``, a chunk at a time."""

    def run(batches):
        parts, size, rows = [], 0, 0
        for batch in batches:
            keys = batch.column(0).to_numpy()
            times = (~batch.column(1).to_numpy(zero_copy_only=False)).astype(np.uint8)
            for low, row, tokens in _tokens(batch):
                n = int(row[-1]) + 1 if len(row) else 0
                parts.append((tokens, (row + rows).astype(np.int32), keys[low : low + n], times[low : low + n]))
                size, rows = size + len(tokens), rows + n
                if size >= chunk:
                    yield from flush(parts)
                    parts, size, rows = [], 0, 0
        if size:
            yield from flush(parts)

    return run


def _steps(places: np.ndarray) -> bytes:
    """Ascending places as the steps between them."""
    return _narrow(np.diff(places, prepend=0))


def _places(data: bytes) -> np.ndarray:
    return np.cumsum(_wide(data), dtype=np.int64)


def _blocks(shards: Shards, turn: int, turns: int, chunk: int, name: str, header: list):
    """A task function: the triples of (key, held_out, text) rows, packed for each shard of a round.

    The words of a block, first those in the middle, are steps between places in the dictionary, and the fingerprints of those outside it.
    Its texts are steps between their places in the chunk; the first block of a chunk also has the keys of all its texts.
    """

    def flush(parts) -> Iterator[pa.RecordBatch]:
        tokens, doc, keys, times = (np.concatenate(c) for c in zip(*parts, strict=True))
        parts.clear()
        words, first, middle, last = _numbered(tokens, doc)
        del tokens
        shard = shards.of(words, first, middle, last)
        mine = np.flatnonzero(shard % turns == turn)
        if not len(mine):
            return
        theirs = shard[mine].astype(np.uint16 if shards.number <= 1 << 16 else np.int32)
        mine = mine[np.argsort(theirs, kind="stable")]  # texts stay in order inside a shard
        shard, doc, triples = shard[mine], doc[mine], [x[mine] for x in (middle, first, last)]
        del middle, first, last
        starts = np.flatnonzero(np.diff(shard, prepend=-1))
        listed = Dictionary(SparkFiles.get(name), header).places(words)
        place, inside, blocks = np.zeros(len(words), np.int32), np.zeros(len(words), bool), []
        for low, high in zip(starts, [*starts[1:], len(mine)], strict=True):
            here = [x[low:high] for x in triples]
            inner, outer = (x[np.diff(x, prepend=-1) > 0] for x in (np.sort(here[0]), np.sort(np.concatenate(here[1:]))))
            inside[inner] = True
            outer = outer[~inside[outer]]
            inside[inner] = False
            used, data = [], []
            for some in (inner, outer):
                near = listed[some] >= 0
                used += [some[near], some[~near]]
                data += [_steps(listed[some[near]]), words[some[~near]].tobytes()]
            used = np.concatenate(used)
            place[used] = np.arange(len(used))
            data += [_narrow(place[x]) for x in here]
            begin = np.flatnonzero(np.diff(doc[low:high], prepend=-1))
            here = doc[low + begin]
            data += [_steps(here), _narrow(np.diff(begin, append=high - low)), np.packbits(times[here]).tobytes(), b"" if low else keys.tobytes()]
            blocks.append(_packed(data))
        # the chunk is known by its texts, in order
        chunk_id = C.mix(keys.view(np.uint64) + np.arange(len(keys), dtype=np.uint64) * np.uint64(C.BASE)).sum(dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(shard[starts], pa.int32()), C.longs(np.full(len(blocks), chunk_id)), pa.array(blocks, pa.binary())], ["shard", "chunk", "data"])

    return _chunks(flush, chunk)


def _pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One fingerprint for two words in order."""
    return C.mix(C.mix(v) + w)


def _hot_pairs(shards: Shards, chunk: int):
    """A task function: (v, w, shards, c), how often each pair of a word in ``hot`` is in training, and the shards it goes to; once for a task, or for ``chunk`` of them."""

    def count(parts) -> Iterator[tuple[np.ndarray, ...]]:
        tokens, doc, _, times = (np.concatenate(c) for c in zip(*parts, strict=True))
        parts.clear()
        words, first, middle, last = _numbered(tokens, doc)
        some = np.flatnonzero(np.isin(words, shards.hot)[middle])
        shard = shards.of(words, first[some], middle[some], last[some])
        size, number = len(words), shards.number
        keys, place = distinct((middle[some].astype(np.int64) * size + last[some]) * number + shard)
        c = np.bincount(place, weights=times[doc[some]], minlength=len(keys)).astype(np.int64)
        pair = keys // number
        yield words[pair // size], words[pair % size], keys % number, c

    def joined(held: list) -> pa.RecordBatch:
        v, w, shard, c = (np.concatenate(x) for x in zip(*held, strict=True))
        kinds, place = distinct(_pair(v, w))
        row = np.zeros(len(kinds), np.int64)
        row[place] = np.arange(len(v))
        keys, at = distinct(place.astype(np.int64) * shards.number + shard)
        starts = np.flatnonzero(np.diff(keys // shards.number, prepend=-1))
        homes = C.lists_of(pa.array((keys % shards.number).astype(np.int32)), np.diff(starts, append=len(keys)))
        total = np.bincount(place, weights=c, minlength=len(kinds)).astype(np.int64)
        return pa.RecordBatch.from_arrays([C.longs(v[row]), C.longs(w[row]), homes, pa.array(total)], ["v", "w", "shards", "c"])

    def run(batches):
        held, size = [], 0
        for part in _chunks(count, chunk)(batches):
            held.append(part)
            size += len(part[0])
            if size >= chunk:
                yield joined(held)
                held, size = [], 0
        if size:
            yield joined(held)

    return run


def _shard_sums(shards: Shards, name: str, header: list, unit: float):
    """A group function: (chunk, data) for each block of a shard, from the blocks and the counts that come with them.

    An answer has sums for the texts of its block: the score, and for those with known words outside the dictionary in it, how many
    (``more``) and their part of the base score (``gain``).
    """

    def run(blocks: pa.Table, extra: pa.Table) -> pa.Table:
        if not len(blocks):
            return pa.table({"chunk": pa.array([], pa.int64()), "data": pa.array([], pa.binary())})
        dictionary = Dictionary(SparkFiles.get(name), header)
        lists, places, spots, sizes, times, keys = [], [], [], [], [], []
        for data in blocks["data"]:
            a, b, c, d, middle, first, last, here, counts, marks, given = _unpacked(data.as_py())
            lists.append(np.concatenate([x for near, far in ((a, b), (c, d)) for x in (dictionary.words[_places(near)], np.frombuffer(far, np.uint64))]))
            places.append((_wide(middle), _wide(first), _wide(last)))
            spots.append(here)
            sizes.append(_wide(counts))
            times.append(np.unpackbits(np.frombuffer(marks, np.uint8), count=len(sizes[-1])))
            keys.append(given)
        v, w, c = (extra[n].to_numpy() for n in ("v", "w", "c"))
        kind = extra["kind"].to_numpy()
        v, w, rare, pair, context = v.view(np.uint64), w.view(np.uint64), kind == RARE, kind == PAIR, kind == CONTEXT
        words, at = distinct(np.concatenate([*lists, v[context], np.array([NONE], np.uint64)]))
        number = lambda x: np.searchsorted(words, x)
        lists = np.split(at.astype(np.int64), np.cumsum([len(x) for x in lists]))[:-1]
        middle, first, last = (np.concatenate([x[p[i]] for x, p in zip(lists, places, strict=True)]) for i in range(3))
        size = np.concatenate(sizes)
        doc = np.repeat(np.arange(len(size)), size)
        counts = dictionary.look_up(words)[1].astype(np.float64)
        far, some = np.zeros(len(words), bool), number(w[rare])
        counts[some], far[some] = c[rare], True
        order = np.argsort(v[context])
        around = [x[context][order] for x in (v, c, w.view(np.int64))]
        hot = (number(around[0]), *around[1:], number(v[pair]), number(w[pair]), c[pair])
        listed = None
        if shards.listed and len(around[0]):
            pairs = Dictionary(SparkFiles.get(shards.listed[0]), shards.listed[1])
            listed = lambda a, b: pairs.look_up(_pair(words[a], words[b]))
        score, place = shard_scores(first, middle, last, np.concatenate(times)[doc], len(words), int(number(np.uint64(NONE))), (counts + 1.0) / unit, hot, listed)
        some = np.flatnonzero(far[last])
        score = np.bincount(doc, score[place], len(size))
        more = np.bincount(doc[some], minlength=len(size))
        gain = np.bincount(doc[some], np.log10(counts[last[some]] + 1.0), len(size))
        ends, answers = np.cumsum([len(x) for x in sizes]), []
        for here, low, high, given in zip(spots, [0, *ends], ends, keys, strict=False):
            some = low + np.flatnonzero(more[low:high])
            answers.append(_packed([here, score[low:high].tobytes(), _steps(some - low), _narrow(more[some]), gain[some].tobytes(), given]))
        return pa.table({"chunk": blocks["chunk"], "data": pa.array(answers, pa.binary())})

    return run


def _chunk_sums(answers: pa.Table) -> pa.Table:
    """(key, score, more, gain) of the texts of a chunk from the answers to its blocks."""
    given = [_unpacked(x.as_py()) for x in answers["data"]]
    keys = np.frombuffer(max((x[-1] for x in given), key=len), np.int64)
    sums = np.zeros((3, len(keys)))
    for here, score, far, more, gain, _ in given:
        spots = _places(here)
        sums[0, spots] += np.frombuffer(score)
        spots = spots[_places(far)]
        sums[1, spots] += _wide(more)
        sums[2, spots] += np.frombuffer(gain)
    return pa.table({"key": pa.array(keys), **{n: pa.array(x) for n, x in zip(("score", "more", "gain"), sums, strict=True)}})


def _extra(rows: DataFrame, rare: DataFrame, table: DataFrame, shards: Shards, chunk: int) -> DataFrame:
    """(shard, kind, v, w, c): what a shard cannot count by itself.

    RARE: counts of the ``rare`` words (shard, w) of a shard. PAIR: count of a pair of a word in ``hot``, for those of its shards that
    hold the pair, if they are several; the pairs in most shards are in the file ``shards.listed`` instead if that is many rows. CONTEXT: a word in ``hot``, for each of its shards, with the distinct words (as ``w``) and tokens that follow it.
    """
    none = F.lit(0).cast("long")
    out = rare.distinct().join(table, "w").select("shard", F.lit(RARE).alias("kind"), none.alias("v"), "w", "c")
    if not len(shards.hot):
        return saved(out)
    homes = F.broadcast(rows.sparkSession.createDataFrame(shards.homes(), "v long, shard int"))
    found = rows.select("key", "held_out", "text").mapInArrow(_hot_pairs(shards, chunk), "v long, w long, shards array<int>, c long")
    pairs = saved(found.groupBy("v", "w").agg(F.sum("c").alias("c"), F.array_distinct(F.flatten(F.collect_list("shards"))).alias("shards")).where("c > 0"))
    shared = pairs.where("size(shards) > 1")
    if (shared.agg(F.sum(F.size("shards"))).first()[0] or 0) > DICTIONARY:
        least = least_count(shared.select(F.size("shards").alias("c")), DICTIONARY)
        known = shared.where(F.size("shards") >= least).select("v", "w", "c").toArrow()
        v, w = (known[n].to_numpy().view(np.uint64) for n in ("v", "w"))
        shards.listed = shipped(rows.sparkSession, _pair(v, w), known["c"].to_numpy())
        shared = shared.where(F.size("shards") < least)
    shared = shared.select(F.explode("shards").alias("shard"), F.lit(PAIR), "v", "w", "c")
    around = pairs.groupBy("v").agg(F.count("*").alias("w"), F.sum("c").alias("c")).join(homes, "v").select("shard", F.lit(CONTEXT), "v", "w", "c")
    out = saved(out.union(shared).union(around))
    C.drop_table(pairs)
    return out


def scored(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    spark = docs.sparkSession
    size, chunk, turns = SHARD, CHUNK, ROUNDS
    rows = _rows(docs, folds, held)
    single = rows.where("NOT held_out").select("text").mapInArrow(_counted(chunk), "w long, c long")
    table = saved(single.groupBy("w").agg(F.sum("c").alias("c")))
    total, distinct = (int(x) for x in table.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first())
    known = table.where(F.col("c") >= least_count(table, DICTIONARY)).toArrow()
    words, counts = known["w"].to_numpy().view(np.uint64), known["c"].to_numpy()
    name, header = shipped(spark, words, counts)
    unit = float(total + distinct + 1)

    # shards are filled by the words that many triples have in the middle; START is one of them
    texts, trained = rows.agg(F.count("*"), F.coalesce(F.sum((~F.col("held_out")).cast("long")), F.lit(0))).first()
    tokens = total * texts // max(1, trained)
    often_words, often = np.append(words, np.uint64(START)), np.append(counts, trained)
    hot = np.flatnonzero((often > size // 2) & (often_words != np.uint64(END)))
    hot = hot[np.argsort(often_words[hot])]
    shards = Shards(tokens // size + 1, often_words[hot], (often[hot] // (size // 2) + 1).astype(np.uint64))

    def run(batches):
        dictionary = Dictionary(SparkFiles.get(name), header)
        for batch in batches:
            n_all, known_all, base_all, rare_all, shard_all = [], [], [], [], []
            for _, row, tokens in _tokens(batch):
                mine, u, v, w = _numbered(tokens, row)
                found, count = dictionary.look_up(mine)
                found, base = found[w], (np.log10(count + 1.0) - np.log10(unit))[w]
                n = int(row[-1]) + 1 if len(row) else 0
                n_all.append(np.bincount(row, minlength=n))
                known_all.append(np.bincount(row, weights=found, minlength=n).astype(np.int64))
                base_all.append(np.bincount(row, weights=base, minlength=n))
                far = np.flatnonzero(~found)
                rare_all += _split(tokens[far], row[far], n)
                shard_all += _split(shards.of(mine, u[far], v[far], w[far]), row[far], n)
            if n_all:
                sizes = [len(r) for r in rare_all]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(i) for i in range(4)],
                        *[pa.array(np.concatenate(x)) for x in (n_all, known_all, base_all)],
                        C.lists_of(C.longs(np.concatenate(rare_all)), sizes),
                        C.lists_of(pa.array(np.concatenate(shard_all), pa.int32()), sizes),
                    ],
                    ["id", "text_key", "key", "held_out", "n_tokens", "n_known", "base_score", "rare", "shards"],
                )

    kind = "id long, text_key long, key long, held_out boolean, n_tokens long, n_known long, base_score double, rare array<long>, shards array<int>"
    first = saved(rows.select("id", "text_key", "key", "held_out", "text").mapInArrow(run, kind))
    far = first.where("size(rare) > 0").select(F.explode(F.arrays_zip("rare", "shards")).alias("x")).select(F.col("x.shards").alias("shard"), F.col("x.rare").alias("w"))
    extra = _extra(rows, far, table, shards, chunk)
    sums = []
    for turn in range(turns):
        blocks = rows.select("key", "held_out", "text").mapInArrow(_blocks(shards, turn, turns, chunk, name, header), BLOCK)
        theirs = extra.where(F.col("shard") % turns == turn)
        found = blocks.groupBy("shard").cogroup(theirs.groupBy("shard")).applyInArrow(_shard_sums(shards, name, header, unit), ANSWER)
        sums.append(saved(found.groupBy("chunk").applyInArrow(_chunk_sums, SUMS)))
    C.drop_table(extra)
    score = sums[0]
    for more in sums[1:]:
        score = score.union(more)
    # rows that are the same in id and text have one sum together
    times = first.groupBy("key").agg(F.count("*").alias("times"))
    score = score.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("score", "more", "gain")]).join(times, "key")
    out = first.join(score.select("key", *[(F.col(c) / F.col("times")).alias(c) for c in ("score", "more", "gain")]), "key", "left")
    return out.select(
        F.nullif("id", F.lit(-(1 << 63)).cast("long")).alias("doc_id"),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0.0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("gain", F.lit(0.0))).alias("base_score"),
        "score",
    )


def _split(tokens: np.ndarray, row: np.ndarray, rows: int) -> list[np.ndarray]:
    return np.split(tokens, np.searchsorted(row, np.arange(1, rows))) if rows else []
