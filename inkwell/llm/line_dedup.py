"""Line deduplication by an exact set-similarity join.

A line's set holds its distinct words, A-Z in lower case. A line goes where an earlier line (by doc_id, then line number) has
a set with Jaccard >= percent / 100 to its own. Lines with equal sets are folded: all but the first place of a set go. What
is left, one line a set, is joined:

1. Words are ordered by rarity, counted over all documents in a table of fixed size (2**SLOT_BITS counters), then by hash.
2. Two similar sets share one of their first n - ceil(percent * n / 100) + 1 words. Each set sends an entry for each of
   these words to the word's block; a block's entries meet word by word.
3. Pairs must pass the length filter, the positional filter (what stands before and behind the shared word bounds the
   overlap) and the bit filter: parity maps of two sets differ in no more bits than the sets differ in words. Maps have 192
   bits, or folded 64 where one of the sets has few words.
4. In the first turn a set names its likeliest earlier partner of each block, and if that one is no close one, up to `best`
   further ones that are looked at if it fails. Where more than `crowd` sets share a word, a set that meets a likely partner
   among the `PIVOTS` earliest looks no further: a crowd of similar lines makes one pair a member.
5. Pairs are verified on whole sets of word hashes, which are made once more for the lines that pairs name.
6. Sets that have looked at less than all, and found nothing, meet all earlier sets of their words in a second turn, to
   which only their words' entries are sent. These tell the first words of their sets, so that of the words which two sets
   share the first alone makes a pair. So no link is lost.

A word stands for 42 bits of its hash besides its rarity, a line's place and set for 64: a pair of lines is misjudged with a
chance of about 2**-30.

`summary` and `clean` go by line_join, which does the same in DataFrame operations alone; `marks`, here, is the form whose words,
hashes and join of a block are numpy under mapInArrow.

Words are `[^\\x20\\x09-\\x0D]+`; lines end at \\n. Lines without words and null texts lose nothing; an empty table gives an
empty result. Null doc_ids come first. Rows that repeat a doc_id share their places: lines at equal places aren't earlier
than one another, and what is removed at a place goes from each of those rows that has that set there. Texts may have any
length: a long one makes a pass of its own. Further columns stay as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import line_join
from .blocks import bits_for
from .common import in_sieve, PASS_BYTES, plain_names, shipped, sieve, slices, small_batches, tabled, tidied, totals, written
from .hashing import Words, distinct, mixed

PERCENT = 75
SLOT_BITS = 18
CROWD, PIVOTS, BEST = 1024, 64, 16
#: Sets of up to this many words have 64-bit maps.
FEW = 56
#: Bits of a word's key: 6 of rarity, 42 of its hash.
KEY_BITS = 48
#: Pairs that a block compares at a time.
STEP = 400_000
#: Words that ask in a second turn are known by so many bits.
ASKED_BITS = 20
NO_ID = -(2**63)
ENTRY = np.dtype([("word", "<u4"), ("n", "<u4"), ("place", "<u4"), ("line", "<u4"), ("probe", "<u4"), ("mark", "<u4"), ("doc", "<i8"), ("fold", "<u8"), ("second", "<u8"), ("third", "<u8")])
#: Words of its prefix that an entry tells in the second turn; sets that share later words alone may be paired by several.
TOLD = 32
TOLD_ENTRY = np.dtype([*ENTRY.descr, ("told", "<u4", (TOLD,))])
ENTRIES = "block int, n int, entries binary"
#: a, b: lines, b earlier, by number(); rest: not the likeliest partner; differ: bits; more: a has looked at less than all.
PAIRS = "rest boolean, a long, b long, differ int, more boolean"


def number(doc: np.ndarray, line: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """One number for a line's place and 32 bits of its set's hash."""
    return mixed(mixed(doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + line.astype(np.uint64)) + mark.astype(np.uint64))


class Lines:
    """The lines with words of a batch (doc_id, text): their distinct words in order of rarity, one line after another."""

    def __init__(self, part: pa.RecordBatch, levels: np.ndarray):
        words = Words(part.column(1), lower=True)
        hashes, row = words.hashes(), words.row_of()
        upto = np.zeros(len(words.data) + 1, np.int64)
        np.cumsum(words.data == 10, out=upto[1:])
        above = upto[words.starts]
        fresh = np.ones(len(row), bool)
        fresh[1:] = (row[1:] != row[:-1]) | (above[1:] != above[:-1])
        first = np.flatnonzero(fresh)
        self.doc = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)[row[first]]
        self.line = (above[first] - upto[words.rows[row[first]]]).astype(np.uint32)
        keys = (levels[hashes & np.uint64((1 << SLOT_BITS) - 1)].astype(np.uint64) << np.uint64(KEY_BITS - 6)) | (hashes >> np.uint64(64 - (KEY_BITS - 6)))
        of, self.keys = self._sorted(np.cumsum(fresh) - 1, keys)
        self.starts = np.searchsorted(of, np.arange(len(first)))
        self.n = np.diff(np.append(self.starts, len(of)))
        self.finished = mixed(self.keys)
        self.set = mixed(np.add.reduceat(self.finished, self.starts)) if len(of) else np.zeros(0, np.uint64)

    @staticmethod
    def _sorted(of: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct words of lines in order; a line's number shares 64 bits with the word's key, so lines go in groups."""
        group, lines, words = 1 << (64 - KEY_BITS), [], []
        cuts = np.searchsorted(of, np.arange(0, (of[-1] if len(of) else 0) + group + 1, group))
        for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            both = distinct(((of[a:b] - k * group).astype(np.uint64) << np.uint64(KEY_BITS)) | keys[a:b])
            lines.append((both >> np.uint64(KEY_BITS)).astype(np.int64) + k * group)
            words.append(both & np.uint64((1 << KEY_BITS) - 1))
        return np.concatenate(lines), np.concatenate(words)

    def marks(self) -> np.ndarray:
        return self.set >> np.uint64(32)

    def numbers(self) -> np.ndarray:
        return number(self.doc, self.line, self.marks())

    def maps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each set the parity map folded to 64 bits, and the second and third 64 of 192 bits (sets of few words: 0)."""
        bit = ((self.finished >> np.uint64(40)) * np.uint64(192)) >> np.uint64(24)
        one = np.uint64(1) << (bit & np.uint64(63))
        fold = np.bitwise_xor.reduceat(one, self.starts)
        parts = (np.bitwise_xor.reduceat(np.where(bit >> np.uint64(6) == k, one, np.uint64(0)), self.starts) for k in (1, 2))
        return fold, *(np.where(self.n > FEW, part, np.uint64(0)) for part in parts)

    def entries(self, percent: int, wanted: np.ndarray | None = None) -> np.ndarray:
        """The prefixes of the batch's sets, each at its first place; with `wanted` those of wanted words (by their first ASKED_BITS), with the words told."""
        kind = ENTRY if wanted is None else TOLD_ENTRY
        if not len(self.n):
            return np.zeros(0, kind)
        order = np.lexsort((self.line, self.doc, self.set))
        here = self.set[order]
        chosen = order[np.append(True, here[1:] != here[:-1])]
        n = self.n[chosen]
        prefix = n - -(-percent * n // 100) + 1
        place = np.arange(prefix.sum()) - np.repeat(np.cumsum(prefix) - prefix, prefix)
        fold, second, third = self.maps()
        of = np.repeat(chosen, prefix)
        word = self.finished[self.starts[of] + place] >> np.uint64(32)
        if wanted is not None:
            some = wanted[word >> np.uint64(32 - ASKED_BITS)]
            of, place, word = of[some], place[some], word[some]
        out = np.zeros(len(place), kind)
        out["word"] = word
        out["place"] = place
        for k in range(TOLD if wanted is not None else 0):
            more = np.flatnonzero(place > k)
            out["told"][more, k] = self.finished[self.starts[of[more]] + k] >> np.uint64(32)
        for name, values in (("n", self.n), ("line", self.line), ("doc", self.doc), ("mark", self.marks()), ("fold", fold), ("second", second), ("third", third)):
            out[name] = values[of]
        return out


def packed(entries: np.ndarray) -> bytes:
    """Byte by byte: the bytes that seldom change shrink to next to nothing."""
    return pa.compress(np.ascontiguousarray(entries.view(np.uint8).reshape(len(entries), entries.itemsize).T).tobytes(), codec="zstd", asbytes=True)


def unpacked(n: int, data: bytes, kind: np.dtype) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=n * kind.itemsize, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).reshape(-1).view(kind)


def _dealt(entries: np.ndarray, bits: int) -> pa.RecordBatch:
    block = (entries["word"].astype(np.int64) << bits) >> 32
    order = np.argsort((block << 33) | ((entries["n"] > FEW).astype(np.int64) << 32) | entries["word"], kind="stable")  # like beside like
    entries, block = entries[order], block[order]
    at = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block)) if len(block) else np.zeros(1, np.int64)
    cuts = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
    return pa.RecordBatch.from_arrays([pa.array(block[at[:-1]], pa.int32()), pa.array([b - a for a, b in cuts], pa.int32()), pa.array([packed(entries[a:b]) for a, b in cuts], pa.binary())], names=["block", "n", "entries"])


def rarity(docs: DataFrame) -> tuple[np.ndarray, int]:
    """For each slot of word hashes twice the logarithm of how many words fall there, 2**SLOT_BITS bytes for any corpus; and the bytes of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, size = np.zeros(1 << SLOT_BITS, np.int64), 0
        for part in slices(batches):
            words = Words(part.column(1), lower=True)
            counts += np.bincount((words.hashes() & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64), minlength=1 << SLOT_BITS)
            size += len(words.data)
        yield from tabled(np.append(counts, size))

    counts = totals(small_batches(docs).mapInArrow(tidied(run), "block int, counts binary"), (1 << SLOT_BITS) + 1)
    return np.minimum(63, 2 * np.log2(np.maximum(counts[:-1], 1))).astype(np.uint8), int(counts[-1])


class Block:
    """The entries of whole words: each set once, at its first place, and word by word in order of size."""

    def __init__(self, e: np.ndarray, percent: int):
        sets = mixed(e["mark"] + mixed(e["fold"] + mixed(e["second"] + mixed(e["third"] + e["n"]))))
        order = np.lexsort((1 - e["probe"].astype(np.int8), e["line"], e["doc"], sets))
        head = np.append(True, sets[order][1:] != sets[order][:-1])
        first = order[np.flatnonzero(head)[np.cumsum(head) - 1]]  # of each entry's set the first place
        same = (e["doc"][order] == e["doc"][first]) & (e["line"][order] == e["line"][first]) & (e["probe"][order] == e["probe"][first])
        e = e[order[same]]
        e = e[np.argsort((e["word"].astype(np.uint64) << np.uint64(32)) | e["n"], kind="stable")]
        self.percent, self.word, self.n = percent, e["word"], e["n"].astype(np.int64)
        self.doc, self.line, self.mark, self.probe, self.fold, self.second, self.third = (e[c].copy() for c in ("doc", "line", "mark", "probe", "fold", "second", "third"))
        self.told = e["told"].copy() if "told" in e.dtype.names else None
        self.place = e["place"].astype(np.int64)
        word = self.word.astype(np.uint64) << np.uint64(32)
        key = word | e["n"]
        self.begin, self.end = np.searchsorted(self.word, self.word, "left"), np.searchsorted(self.word, self.word, "right")
        self.least, self.most = np.searchsorted(key, word | (-(-percent * self.n // 100)).astype(np.uint64)), np.searchsorted(key, word | (100 * self.n // percent).astype(np.uint64), "right")
        self.found: list[tuple] = []

    def earlier(self, j: np.ndarray, i: np.ndarray) -> np.ndarray:
        return (self.doc[j] < self.doc[i]) | ((self.doc[j] == self.doc[i]) & (self.line[j] < self.line[i]))

    def compare(self, i: np.ndarray, j: np.ndarray, turned: bool) -> None:
        """Keeps the pairs (later, earlier) that pass; `turned`: i may be the earlier, else such pairs are left out."""
        both = self.n[i] + self.n[j]
        fold = self.fold[i] ^ self.fold[j]
        differ = np.bitwise_count(fold).astype(np.int64)
        ok = (100 + self.percent) * differ <= (100 - self.percent) * both
        i, j, differ, both, fold = i[ok], j[ok], differ[ok], both[ok], fold[ok]
        long = np.flatnonzero((self.n[i] > FEW) & (self.n[j] > FEW))
        second, third = self.second[i[long]] ^ self.second[j[long]], self.third[i[long]] ^ self.third[j[long]]
        differ[long] = np.bitwise_count(fold[long] ^ second ^ third).astype(np.int64) + np.bitwise_count(second) + np.bitwise_count(third)
        ok = (100 + self.percent) * differ <= (100 - self.percent) * both
        i, j, differ, both = i[ok], j[ok], differ[ok], both[ok]
        overlap = np.minimum(self.place[i], self.place[j]) + np.minimum(self.n[i] - self.place[i], self.n[j] - self.place[j])
        ok = (100 + self.percent) * overlap >= self.percent * both
        i, j, differ = i[ok], j[ok], differ[ok]
        late = self.earlier(j, i)
        if turned:
            soon = self.earlier(i, j)
            i, j, differ = np.concatenate([i[late], j[soon]]), np.concatenate([j[late], i[soon]]), np.concatenate([differ[late], differ[soon]])
        else:
            i, j, differ = i[late], j[late], differ[late]
        if self.told is not None:
            new = ~self.told_before(i, j)
            i, j, differ = i[new], j[new], differ[new]
        self.found.append((i, j, differ))

    def told_before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether a word before, at which the pair passes too, makes this pair."""
        out = np.zeros(len(i), bool)
        for a in range(0, len(i), STEP // TOLD):
            x, y = i[a : a + STEP // TOLD], j[a : a + STEP // TOLD]
            n, m, both = self.n[x], self.n[y], self.percent * (self.n[x] + self.n[y])
            his = self.told[y]
            his_own = np.arange(TOLD) < self.place[y][:, None]
            for k in range(min(TOLD, int(self.place[x].max()))):
                at, l = np.nonzero((his == self.told[x, k][:, None]) & his_own & (self.place[x] > k)[:, None])
                passes = (100 + self.percent) * (np.minimum(k, l) + np.minimum(n[at] - k, m[at] - l)) >= both[at]
                out[a + at[passes]] = True
        return out

    def ranges(self, asking: np.ndarray, low: np.ndarray, high: np.ndarray, turned: bool) -> None:
        """Compares each of asking with its places low to high, STEP pairs at a time."""
        counts = high - low
        asking, low, counts = asking[counts > 0], low[counts > 0], counts[counts > 0]
        upto, a = np.cumsum(counts), 0
        while a < len(asking):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + STEP, "right")))
            c = counts[a:b]
            i = np.repeat(asking[a:b], c)
            self.compare(i, np.repeat(low[a:b], c) + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c), turned)
            a = b

    def first_turn(self, crowd: int) -> np.ndarray:
        """Meets all; returns which entries have met a pivot and looked no further."""
        deferred, crowded = np.zeros(len(self.n), bool), self.end - self.begin > crowd
        for start in np.unique(self.begin[crowded]).tolist():
            stop, before = int(self.end[start]), len(self.found)
            order = np.lexsort((self.line[start:stop], self.doc[start:stop]))
            pivots = start + order[:PIVOTS]
            for a in range(start, stop, STEP // PIVOTS):
                members = np.arange(a, min(a + STEP // PIVOTS, stop))
                self.compare(np.repeat(members, len(pivots)), np.tile(pivots, len(members)), False)
            for i, _, _ in self.found[before:]:
                deferred[i] = True
        alone = np.flatnonzero(~crowded)
        self.ranges(alone, alone + 1, self.most[alone], True)
        left = np.flatnonzero(crowded & ~deferred)
        self.ranges(left, self.least[left], self.most[left], False)
        return deferred

    def second_turn(self) -> np.ndarray:
        asking = np.flatnonzero(self.probe == 1)
        self.ranges(asking, self.least[asking], self.most[asking], False)
        return np.zeros(len(self.n), bool)

    def pairs(self, deferred: np.ndarray, best: int | None) -> list[np.ndarray]:
        """The columns of PAIRS: each pair once, whatever words have shown it, and at most `best` of each line."""
        i, j, differ = (np.concatenate([x[k] for x in self.found] or [np.zeros(0, np.int64)]).astype(np.int64) for k in range(3))
        names = number(self.doc, self.line, self.mark)
        a, b = names[i], names[j]
        order = np.lexsort((b, differ, a))
        # Well below half of what two sets may differ in: such a partner fails next to never, and if it does, there is the second turn.
        close = (100 + self.percent) * (2 * differ + 4) <= (100 - self.percent) * (self.n[i] + self.n[j])
        a, b, differ, late, close = a[order], b[order], differ[order], deferred[i][order], close[order]
        if not len(a):
            return [np.zeros(0, t) for t in (bool, np.int64, np.int64, np.int32, bool)]
        keep = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        heads = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        group = np.cumsum(np.append(True, a[1:] != a[:-1])) - 1
        turn = np.cumsum(keep) - 1
        turn = turn - turn[heads][group]
        more = np.logical_or.reduceat(late, heads)
        if best:
            most = np.where(close[heads], 1, best)
            more |= np.maximum.reduceat(turn, heads) >= most
            keep &= turn < most[group]
        return [turn[keep] > 0, a[keep].view(np.int64), b[keep].view(np.int64), differ[keep].astype(np.int32), more[group][keep]]


def _met(sent: DataFrame, percent: int, crowd: int | None, best: int | None) -> DataFrame:
    """PAIRS of the entries sent, met block by block; without `crowd` in the second turn."""
    names = [x.split()[0] for x in PAIRS.split(", ")]

    def met(held: list[np.ndarray]) -> pa.RecordBatch:
        block = Block(np.concatenate(held), percent)
        found = block.pairs(block.first_turn(crowd) if crowd else block.second_turn(), best)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for block, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != now and held:
                    yield met(held)
                    held = []
                now = block
                held.append(unpacked(n, data, ENTRY if crowd else TOLD_ENTRY))
        if held:
            yield met(held)

    return written(sent.repartition("block").sortWithinPartitions("block").mapInArrow(tidied(run), PAIRS), by="rest")


def _listed(docs: DataFrame, levels, asked) -> DataFrame:
    """doc, line, name, set of each line with words, and its keys where it may be asked for; without `levels` no keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            lines = Lines(part, levels.value)
            names = lines.numbers()
            some = in_sieve(asked.value, names)
            keys = lines.keys[np.repeat(some, lines.n)].view(np.int64)
            ends = np.concatenate([[0], np.cumsum(np.where(some, lines.n, 0))]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys), mask=pa.array(~some)) if len(some) else pa.array([], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(lines.doc), pa.array(lines.line.astype(np.int32)), pa.array(names.view(np.int64)), pa.array(lines.set.view(np.int64)), listed], names=["doc", "line", "name", "set", "keys"])

    return written(docs.mapInArrow(tidied(run), "doc long, line int, name long, set long, keys array<long>"))


def _similar(pairs: DataFrame, keys: DataFrame, percent: int) -> DataFrame:
    """The lines a of the pairs (a, b) that are similar."""
    named = lambda side: keys.select(F.col("name").alias(side), F.col("keys").alias(f"{side}_keys"))
    both = pairs.join(named("b"), "b").join(named("a"), "a")
    same = F.size(F.array_intersect("a_keys", "b_keys"))
    return written(both.filter(100 * same >= percent * (F.size("a_keys") + F.size("b_keys") - same)).select("a").distinct())


def _passing(pairs: DataFrame, asked) -> DataFrame:
    """The pairs whose a is in a sieve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_sieve(asked.value, batch.column(0).to_numpy().view(np.uint64))))

    return pairs.mapInArrow(tidied(run), "a long, b long")


def _gone(docs: DataFrame, levels, pairs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The lines that are similar to an earlier one, those whose pairs have all failed, and all lines as by _listed.

    Each line asks its likeliest partners first, the rest if these fail.
    """
    share = docs.sparkSession.sparkContext.broadcast
    lines = _listed(docs, levels, share(sieve(pairs.select("a", "b"))))
    keys = lines.filter("keys IS NOT NULL").select("name", "keys").dropDuplicates(["name"])
    likely = written(pairs.filter("NOT rest").select("a", "b").distinct())
    gone = _similar(likely, keys, percent)
    waiting = written(likely.select("a").distinct().join(gone, "a", "left_anti"))
    rest = _passing(pairs.filter("rest").select("a", "b"), share(sieve(waiting)))
    rest = written(rest.join(waiting, "a", "left_semi").distinct())
    if not rest.isEmpty():
        gone = gone.unionByName(_similar(rest, keys, percent))
        waiting = waiting.join(gone, "a", "left_anti")
    return gone, waiting, lines


def marks(docs: DataFrame, percent: int = PERCENT, crowd: int = CROWD, best: int = BEST) -> DataFrame:
    """doc_id, line, removed for each line with words of docs (doc_id, text); lines count from 0."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    share = docs.sparkSession.sparkContext.broadcast
    table, size = rarity(docs)
    levels, bits = share(table), bits_for(size // (4 * PASS_BYTES) + 1)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield _dealt(Lines(part, levels.value).entries(percent), bits)

    pairs = _met(docs.mapInArrow(tidied(send), ENTRIES), percent, crowd, best)
    gone, waiting, lines = _gone(docs, levels, pairs, percent)
    waiting = written(waiting.join(pairs.filter("more").select("a").distinct(), "a", "left_semi"))
    if not waiting.isEmpty():
        ask = share(sieve(waiting))
        asked = lambda e: in_sieve(ask.value, number(e["doc"], e["line"], e["mark"]))

        def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = np.zeros(1 << ASKED_BITS, np.int64)
            for batch in batches:
                for keys in batch.column(0):
                    keys = keys.values.to_numpy().view(np.uint64)
                    prefix = mixed(keys[: len(keys) - -(-percent * len(keys) // 100) + 1])
                    seen[(prefix >> np.uint64(64 - ASKED_BITS)).astype(np.int64)] = 1
            yield from tabled(seen)

        asking = lines.filter("keys IS NOT NULL").join(waiting.withColumnRenamed("a", "name"), "name", "left_semi").select("keys")
        wanted = share(totals(asking.mapInArrow(tidied(words), "block int, counts binary"), 1 << ASKED_BITS) > 0)

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches):
                e = Lines(part, levels.value).entries(percent, wanted.value)
                e["probe"] = asked(e)
                yield _dealt(e, bits)

        met = _met(docs.mapInArrow(tidied(probe), ENTRIES), percent, None, None)
        gone = gone.unionByName(_gone(docs, levels, met, percent)[0]).distinct()
    return _told(lines, gone)


def _told(lines: DataFrame, gone: DataFrame) -> DataFrame:
    """A line goes if it isn't at its set's first place, or if that place is among those gone."""
    lines = lines.select("doc", "line", "name", "set")
    firsts = lines.groupBy("set").agg(F.min(F.struct("doc", "line", "name")).alias("first"), F.count("*").alias("n")).select("set", F.struct("first.doc", "first.line").alias("first"), F.col("first.name").alias("name"), "n")
    told = firsts.join(gone.select(F.col("a").alias("name"), F.lit(True).alias("gone")), "name", "left").filter("n > 1 OR gone")
    out = lines.join(written(told.select("set", "first", F.coalesce("gone", F.lit(False)).alias("gone"))), "set", "left")
    removed = F.coalesce(F.col("gone") | (F.struct("doc", "line") > F.col("first")), F.lit(False))
    return out.select(_id().alias("doc_id"), "line", removed.alias("removed"))


def _id() -> Column:
    return F.when(F.col("doc") != NO_ID, F.col("doc"))


def summary(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_lines (with words), n_removed, removed (their numbers, joined by commas); documents without words have 0, 0 and an empty string. Rows that repeat a doc_id each tell of all their lines together."""
    counted = line_join.removed(docs, percent).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.col("removed").cast("long")).alias("n_removed"), F.array_sort(F.collect_set(F.when(F.col("removed"), F.col("line")))).alias("numbers"))
    counted = counted.withColumnRenamed("doc_id", "of")
    out = docs.select("doc_id").join(counted, F.col("doc_id").eqNullSafe(F.col("of")), "left")
    return out.select("doc_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_lines", "n_removed")), F.concat_ws(",", F.transform("numbers", lambda x: x.cast("string"))).alias("removed"))


@plain_names("doc_id", "text")
def clean(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with the removed lines cut from text; null stays null."""
    gone = line_join.removed(docs, percent).filter("removed").groupBy(F.col("doc_id").alias("__of")).agg(F.collect_set("line").alias("__gone"))
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("__gone", i)), "\n")
    out = docs.join(written(gone), F.col("doc_id").eqNullSafe(F.col("__of")), "left")
    return out.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept)).select(*docs.columns)


shipped(__name__)
