"""Line deduplication by an exact set-similarity join, in DataFrame operations alone.

A line's set holds its distinct words, A-Z in lower case. A line goes where an earlier line (by doc_id, then line number) has
a set with Jaccard >= percent / 100 to its own. Lines with equal sets are folded: all but the first place of a set go. What
is left, one line a set, is joined:

1. Words are ordered by length, the longest first, then by hash: long words are rare ones, so no count of them is needed.
2. A set's signs are its pairs of neighbouring words in this order. A word that one of two sets has alone breaks two pairs of
   its own set and one of the other, so sets of n and m words with o in common, and d = n + m - 2 * o apart, share o - 1 - d
   signs or more. Where that is c at least, they share one of their first n - c. Sets so small that c may be 0 have the words
   of their prefix, n - ceil(percent * n / 100) + 1 of them, as signs too. A sign stands for 32 bits of its hash.
3. Signs that another set has too are entries; where there is just one other, its size must be near. Entries that meet an earlier one of their sign are asking; it must pass the length filter and the
   bit filter: parity maps of two sets differ in no more bits than the sets differ in words. Maps have 192 bits, or folded 64
   where one of the sets has few words.
4. Entries that an asking one meets are asked. Sets of both are made once more, from the lines that they name.
5. A line goes if one of its asking entries meets an asked one whose whole set is similar.

Steps 3 to 5 are semi-joins: whether there is a partner is all that is asked for, so a crowd of near lines makes a row an
entry, not a row a pair. Lines of a crowd that have a partner stop at the first; those that have none look at all before them
that share a sign.

A word stands for its length and 58 bits of its hash, a line's set for 64, beside its place for 32.

Words are `[^\\x20\\x09-\\x0D]+`; lines end at \\n. Lines without words and null texts lose nothing; an empty table gives an
empty result. Null doc_ids come first. Rows that repeat a doc_id share their places: lines at equal places aren't earlier
than one another, and what is removed at a place goes from each of those rows that has that set there. Texts may have any
length.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import dropped
from .common import written as stored

#: Sets of up to this many words have 64-bit maps.
FEW = 56
#: Bits of a word's hash in its key; before them stands 31 less its length in bytes.
HASH_BITS, LONGEST = 58, 31
NO_ID = -(2**63)
WHITE = "\t\x0b\x0c\r"
#: What an entry tells of its set.
TOLD = ["doc", "line", "mark", "n", "fold", "second", "third"]
#: How lines are known: by place and 32 bits of the set's hash.
PLACE = ["doc", "line", "mark"]


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder; the shuffle files they came from are deleted at once."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        return stored(df)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)


def _key(word: Column) -> Column:
    length = F.lit(LONGEST) - F.least(F.octet_length(word), F.lit(LONGEST))
    return F.shiftleft(length.cast("long"), HASH_BITS).bitwiseOR(F.shiftrightunsigned(F.xxhash64(word), 64 - HASH_BITS))


def _parity(keys: Column, third: int | None = None) -> Column:
    """The parity map of the words of one third, or of all."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(63).cast("int"))
    some = lambda x: bit(x) if third is None else F.when(F.shiftright(x, 6) % 3 == third, bit(x)).otherwise(F.lit(0).cast("long"))
    return F.aggregate(keys, F.lit(0).cast("long"), lambda held, x: held.bitwiseXOR(some(x)))


def _lines(docs: DataFrame) -> DataFrame:
    """doc, line, text of the lines with words of docs (doc_id, text)."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc")
    return docs.select(doc, F.posexplode(F.split("text", "\n")).alias("line", "text")).filter(F.col("text").rlike("[^\\x20\\x09-\\x0D]"))


def _lowered() -> Column:
    """text with A-Z in lower case and spaces for all white space.

    What isn't ASCII is lowered byte by byte, which takes the first bytes of two-byte characters to those of longer ones; how many
    bytes follow still tells them apart.
    """
    bytes_ = F.decode(F.col("text").cast("binary"), "ISO-8859-1")
    low = F.lower(F.when(F.length("text") == F.octet_length("text"), F.col("text")).otherwise(bytes_))
    white = reduce(or_, (F.contains("text", F.lit(x)) for x in WHITE))
    return F.when(white, F.translate(low, WHITE, " " * len(WHITE))).otherwise(low)


def _sets(lines: DataFrame) -> DataFrame:
    """doc, line, set, keys of lines: the keys of a set in order."""
    lowered = _lowered()
    keys = lines.select("doc", "line", F.sort_array(F.array_distinct(F.transform(F.split(lowered, " "), _key))).alias("keys"))
    # Where spaces meet there is an empty word, whose key is the last.
    empty = F.element_at("keys", -1) == _key(F.lit(""))
    keys = keys.select("doc", "line", F.when(empty, F.slice("keys", 1, F.size("keys") - 1)).otherwise(F.col("keys")).alias("keys"))
    return keys.select("doc", "line", F.xxhash64("keys").alias("set"), "keys")


def _earlier(b: str, a: str) -> Column:
    return (F.col(f"{b}.doc") < F.col(f"{a}.doc")) | ((F.col(f"{b}.doc") == F.col(f"{a}.doc")) & (F.col(f"{b}.line") < F.col(f"{a}.line")))


def _passes(percent: int) -> Column:
    """Entries a and b of a word, b earlier, that pass the filters."""
    a, b = ({c: F.col(f"{side}.{c}") for c in TOLD} for side in "ab")
    both, (fold, second, third) = a["n"] + b["n"], (a[c].bitwiseXOR(b[c]) for c in ("fold", "second", "third"))
    close = lambda differ: (100 + percent) * differ <= (100 - percent) * both
    far = F.bit_count(fold.bitwiseXOR(second).bitwiseXOR(third)) + F.bit_count(second) + F.bit_count(third)
    sizes = (100 * a["n"] >= percent * b["n"]) & (100 * b["n"] >= percent * a["n"])
    return (F.col("a.word") == F.col("b.word")) & sizes & close(F.bit_count(fold)) & _earlier("b", "a") & ((a["n"] <= FEW) | (b["n"] <= FEW) | close(far))


def _signs(percent: int) -> Column:
    """The signs of the sets `keys`."""
    n = F.size("keys")
    part = F.ceil(percent * n / 100).cast("int")
    shared = F.ceil((2 * percent - 100) * (n + part) / (100 + percent)).cast("int") - 1
    short = lambda hash_: F.shiftright(hash_, 32).cast("int")
    many = n - F.greatest(shared, F.lit(1))
    pairs = F.zip_with(F.slice("keys", 1, many), F.slice("keys", 2, many), lambda x, y: short(F.xxhash64(x, y)))
    return F.when(shared >= 1, pairs).otherwise(F.concat(pairs, F.transform(F.slice("keys", 1, n - part + 1), lambda x: short(F.xxhash64(x)))))


def _shared(signs: DataFrame, percent: int) -> DataFrame:
    """word, set of the signs (set, n, word) that another set has too, once each; not where the only other one's size is too far."""
    every = W.partitionBy("word")
    told = {"low": F.min("set"), "high": F.max("set"), "least": F.min("n"), "most": F.max("n"), "rows": F.count("*")}
    shared = signs.withColumns({name: e.over(every) for name, e in told.items()})
    shared = shared.filter((F.col("low") != F.col("high")) & ((F.col("rows") > 2) | (100 * F.col("least") >= percent * F.col("most"))))
    return shared.select("word", "set").distinct()  # where they lie, so that copies of a line are one before they are sent


def removed(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, line, removed for each line with words of docs (doc_id, text); lines count from 0."""
    n = F.size("keys")
    long = lambda third: F.when(n > FEW, _parity(F.col("keys"), third)).otherwise(F.lit(0).cast("long"))
    all_lines = written(_sets(_lines(docs)).select("doc", "line", "set", n.alias("n"), _parity(F.col("keys")).alias("fold"), long(1).alias("second"), long(2).alias("third"), _signs(percent).alias("signs")))
    # Of a set's lines the first place; the rest of the struct is the same in all.
    first = F.min(F.struct("doc", "line", "n", "fold", "second", "third")).alias("first")
    firsts = written(all_lines.groupBy("set").agg(first, F.count("*").alias("copies")).select("set", "first.*", "copies"))
    lines = written(all_lines.select("doc", "line", "set"))
    shared = _shared(all_lines.select("set", "n", F.explode("signs").alias("word")), percent)
    entries = written(shared.join(firsts, "set").select(*(F.col(c) if c != "mark" else _mark() for c in TOLD), "word"))
    dropped(all_lines)
    return _told(lines, firsts, _gone(docs, entries, percent))


def _mark() -> Column:
    return F.shiftright("set", 32).cast("int").alias("mark")


def _gone(docs: DataFrame, entries: DataFrame, percent: int) -> DataFrame:
    """doc, line, mark of each line with a similar earlier one."""
    # Both sides need the same columns, so that they are shuffled once.
    either = F.col("a.mark").isNotNull() | F.col("b.mark").isNotNull()
    asking = written(entries.alias("a").join(entries.alias("b"), _passes(percent) & either, "left_semi"))
    words = written(asking.select("word").distinct())
    asked = written(entries.join(words, "word", "left_semi").alias("b").join(asking.alias("a"), _passes(percent), "left_semi"))
    places = written(asking.select(*PLACE).union(asked.select(*PLACE)).distinct())
    again = _sets(_lines(docs).join(places.select("doc", "line").distinct(), ["doc", "line"], "left_semi"))
    keys = written(again.select("doc", "line", _mark(), "keys").join(places, PLACE, "left_semi").dropDuplicates(PLACE))
    # Most lines are settled at the first of their words.
    least = asking.groupBy(*PLACE).agg(F.min("word").alias("word"))
    gone = _similar(asking.join(least, [*PLACE, "word"], "left_semi"), asked, keys, percent)
    left = written(asking.join(gone, PLACE, "left_anti"))
    return gone.union(_similar(left, asked, keys, percent))


def _similar(asking: DataFrame, asked: DataFrame, keys: DataFrame, percent: int) -> DataFrame:
    """doc, line, mark of the lines asking of which an entry meets a similar set."""
    asked = asked.join(asking.select("word").distinct(), "word", "left_semi")
    a, b = (side.join(keys, PLACE).alias(name) for side, name in ((asking, "a"), (asked, "b")))
    same = F.size(F.array_intersect("a.keys", "b.keys"))
    similar = 100 * same >= percent * (F.col("a.n") + F.col("b.n") - same)
    return written(a.join(b, _passes(percent) & similar, "left_semi").select(*PLACE).distinct())


def _told(lines: DataFrame, firsts: DataFrame, gone: DataFrame) -> DataFrame:
    """A line goes if it isn't at its set's first place, or if that place is gone."""
    firsts = firsts.select("set", "doc", "line", _mark(), "copies").join(gone.withColumn("gone", F.lit(True)), PLACE, "left").filter("copies > 1 OR gone")
    firsts = firsts.withColumn("first", F.struct("doc", "line"))
    out = lines.select("doc", "line", "set").join(firsts.select("set", "first", F.coalesce("gone", F.lit(False)).alias("gone")), "set", "left")
    goes = F.coalesce(F.col("gone") | (F.struct("doc", "line") > F.col("first")), F.lit(False))
    return out.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "line", goes.alias("removed"))
