"""Phrase collocations: frequent phrases by mergeable Misra-Gries summaries, counted exactly by a second pass.

First pass: each task counts the n-grams of a piece of its texts by hash and sends the counts on, cut
by hash partition. The task of a partition keeps one Misra-Gries summary of them: hashes with
counters, at most as many as the partition's share of all occurrences by the threshold. Where more
meet, as many as are too many lose their smallest part: all counters are lowered by one amount,
and those at zero go. What was taken off so far is the most by which a counter is too low, and it
never reaches the threshold, so every frequent n-gram survives.

Second pass: n-grams whose hash survived, as a bit array of bounded size tells, are counted as text.
The array only spares work: what passes it by chance is counted too, and falls below the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.arrow import small, utf8
from logweave.operators.pinning import pin_table

MIN_COUNT, MAX_WORDS, TOP = 30, 4, 2000
#: Counters that a partition's summary is planned for, n-grams that a task counts at once, and bits of the array at most.
SUMMARY, PIECE, MAX_BITS = 1 << 20, 1 << 22, 1 << 27
NO_LANG = "und"

#: The characters that part pieces; what isn't one of them, a space or a tab is a word's.
CUTS = ".,;:!?\n\x0b\x0c\r"
_CUT = 0xFF  # a byte that UTF-8 doesn't have
_TABLE = bytes(_CUT if chr(i) in CUTS else (i + 32 if 65 <= i <= 90 else (32 if i == 9 else i)) for i in range(256))
_MARK = bytes([_CUT])
_ODD = np.uint64(0x9E3779B97F4A7C15)


def pieces(text: bytes | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased, with a mark between pieces and at the end."""
    words = (text or b"").translate(_TABLE).replace(_MARK, b" \xff ").split()
    return [*words, _MARK]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class _Vocabulary(dict):
    """Numbers of words met, 0 for the mark, with their hashes and UTF-8."""

    def __init__(self):
        self[_MARK] = 0
        self.words, self.hashes = [_MARK], [0]

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.words)
        self.words.append(word)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        return n


class Piece:
    """The n-grams of some texts: word numbers, and by n the places where one starts and their hashes."""

    def __init__(self):
        self.vocabulary, self.parts, self.langs, self.size = _Vocabulary(), [], [], 0

    def add(self, text: bytes | None, lang: str) -> None:
        ids = np.fromiter(map(self.vocabulary.__getitem__, pieces(text)), np.int32)
        self.parts.append(ids)
        self.langs.append(lang)
        self.size += len(ids)

    def grams(self, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, starts, hashes) for n up to `most`. The hash is of the words and the language."""
        self.ids = np.concatenate(self.parts)
        names = list(dict.fromkeys(self.langs))
        hashed = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in names], np.uint64)
        self.lang = np.repeat(np.array([names.index(x) for x in self.langs]), [len(p) for p in self.parts])
        self.names = names
        one = np.array(self.vocabulary.hashes, np.uint64)[self.ids]
        at = np.flatnonzero(self.ids)
        h = hashed[self.lang[at]]
        for n in range(1, most + 1):
            if n > 1:
                stay = self.ids[at + n - 1] > 0  # the last id is a mark, so this stays inside
                at, h = at[stay], h[stay]
            h = _mixed(h * _ODD + one[at + n - 1])
            yield n, at, h


def texts_in_pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[Piece]:
    """Rows (text, lang) as pieces of about `most` n-grams; a text is never cut."""
    piece = Piece()
    for b in small(batches):
        for text, lang in zip(utf8(b.column(0)), b.column(1).to_pylist(), strict=True):
            piece.add(text, lang)
            if piece.size * 4 >= most:
                yield piece
                piece = Piece()
    if piece.size:
        yield piece


class Summary:
    """A Misra-Gries summary: sorted keys with counters, of which `taken` was taken off in all."""

    def __init__(self, capacity: int, threshold: int):
        self.capacity, self.threshold, self.taken = capacity, threshold, 0
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.waiting, self.n_waiting = [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.n_waiting += len(keys)
        if self.n_waiting >= self.capacity:
            self.merge()

    def merge(self) -> None:
        """Adds up what waits; then lowers all counters until `capacity` are left, but in sum by less than the threshold."""
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(c for _, c in self.waiting)])
        self.waiting, self.n_waiting = [], 0
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        self.keys, self.counts = keys[starts], np.add.reduceat(counts, starts) if len(keys) else counts
        over = len(self.keys) - self.capacity
        if over > 0 and self.taken + 1 < self.threshold:
            least = min(int(np.partition(self.counts, over - 1)[over - 1]), self.threshold - 1 - self.taken)
            stay = self.counts > least
            self.keys, self.counts, self.taken = self.keys[stay], self.counts[stay] - least, self.taken + least

    def survivors(self) -> np.ndarray:
        """Keys that may have been counted `threshold` times."""
        self.merge()
        return self.keys[self.counts + self.taken >= self.threshold]


def language(lang: str | Column) -> Column:
    return F.coalesce((lang if isinstance(lang, Column) else F.col(lang)).cast("string"), F.lit(NO_LANG))


def _slots(h: np.ndarray, partitions: int) -> np.ndarray:
    """Hash partition and 32 bits of each hash, as one number."""
    return (((h >> np.uint64(32)) * np.uint64(partitions)) >> np.uint64(32) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


def gram_counts(rows: DataFrame, partitions: int, max_words: int = MAX_WORDS, piece: int = PIECE) -> DataFrame:
    """(part, keys, counts) of n-grams by hash from rows (text, lang): 32-bit keys and how often each was met, as little-endian arrays; a row for each hash partition and piece of text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in texts_in_pieces(batches, piece):
            slots = np.sort(np.concatenate([_slots(h, partitions) for _, _, h in p.grams(max_words)]))
            starts = np.flatnonzero(np.concatenate([[True], slots[1:] != slots[:-1]])) if len(slots) else np.empty(0, np.int64)
            counts, slots = np.diff(np.append(starts, len(slots))).astype(np.uint32), slots[starts]
            parts = (slots >> np.uint64(32)).astype(np.int64)
            edges = np.searchsorted(parts, np.arange(partitions + 1))
            keys = slots.astype(np.uint32)
            for at in range(0, partitions, 256):
                own = [i for i in range(at, min(at + 256, partitions)) if edges[i + 1] > edges[i]]
                cut = lambda a: pa.array([a[edges[i] : edges[i + 1]].tobytes() for i in own], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), cut(keys), cut(counts)], ["part", "keys", "counts"])

    return rows.mapInArrow(count, "part int, keys binary, counts binary")


def surviving_slots(counts: DataFrame, partitions: int, capacity: int, threshold: int) -> DataFrame:
    """(slot, taken): partition and 32-bit key of what a Misra-Gries summary for each hash partition keeps as perhaps frequent."""

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = Summary(capacity, threshold)
        for b in batches:
            for part, keys, own in zip(*(c.to_pylist() for c in b.columns), strict=True):
                summary.add(np.frombuffer(keys, np.uint32).astype(np.uint64) | np.uint64(part << 32), np.frombuffer(own, np.uint32).astype(np.int64))
        if summary.n_waiting or len(summary.keys):
            found = summary.survivors().view(np.int64)
            for at in range(0, len(found), 1 << 16):
                own = found[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), summary.taken))], ["slot", "taken"])

    return counts.repartitionById(partitions, F.col("part")).mapInArrow(summarize, "slot bigint, taken bigint")


def bit_array(slots: DataFrame, bits: int) -> bytes:
    """A bit for each number below `bits` that is the low end of a slot; at most MAX_BITS / 64 numbers come to the driver."""
    at = F.col("slot").bitwiseAND(bits - 1)
    words = slots.groupBy(F.shiftright(at, 6).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))).alias("own")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("own").to_numpy()
    return out.tobytes()


def _same(p: Piece, n: int, at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether the n-grams at these places are really those at `first`, hashes aside."""
    same = p.lang[at] == p.lang[first]
    for k in range(n):
        same &= p.ids[at + k] == p.ids[first + k]
    return same


def phrase_counts(rows: DataFrame, array: bytes, max_words: int = MAX_WORDS, piece: int = PIECE) -> DataFrame:
    """(lang, phrase, n_words, f) of the n-grams whose bit is set, counted by text over rows (text, lang)."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(array)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        mask = np.uint64(len(bits) * 8 - 1)
        for p in texts_in_pieces(batches, piece):
            for n, at, h in p.grams(max_words):
                low = h & mask
                stay = (bits[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 > 0
                at, h = at[stay], h[stay]
                order = np.argsort(h, kind="stable")
                at, h = at[order], h[order]
                new = np.concatenate([[True], h[1:] != h[:-1]])[: len(h)]
                first = at[np.flatnonzero(new)][np.cumsum(new) - 1] if len(at) else at
                new |= ~_same(p, n, at, first)  # an equal hash of another n-gram starts a group of its own
                starts = np.flatnonzero(new)
                times = np.diff(np.append(starts, len(at)))
                for a in range(0, len(starts), 1 << 16):
                    some, words = at[starts[a : a + (1 << 16)]], p.vocabulary.words
                    table = np.stack([p.ids[some + k] for k in range(n)], axis=1).tolist()
                    said = pa.array([b" ".join([words[i] for i in row]) for row in table], pa.binary()).cast(pa.string())
                    langs = pa.array([p.names[i] for i in p.lang[some].tolist()], pa.string())
                    yield pa.RecordBatch.from_arrays([langs, said, pa.array(np.full(len(some), n, np.int32)), pa.array(times[a : a + (1 << 16)])], ["lang", "phrase", "n_words", "times"])

    found = rows.mapInArrow(count, "lang string, phrase string, n_words int, times bigint")
    return found.groupBy("lang", "phrase", "n_words").agg(F.sum("times").alias("f"))


def frequent_phrases(rows: DataFrame, n_all: int, threshold: int = MIN_COUNT, max_words: int = MAX_WORDS, summary: int = SUMMARY) -> DataFrame:
    """(lang, phrase, n_words, f), pinned: all n-grams of up to `max_words` words that rows (text, lang) hold `threshold` times or more. `n_all` is the number of words in all."""
    mass = max(1, n_all * max_words)
    planned = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    partitions = max(1, min(planned, mass // (1 << 14)), math.ceil(2 * mass / (threshold * summary)))
    # twice a partition's even share of all occurrences, by the threshold, and one more
    capacity = 2 * mass // (partitions * threshold) + 1
    slots = pin_table(surviving_slots(gram_counts(rows, partitions, max_words), partitions, capacity, threshold), "surviving_slots")
    wanted = max(1 << 12, 16 * slots.count())
    array = bit_array(slots, min(MAX_BITS, 1 << (wanted - 1).bit_length()))
    return pin_table(phrase_counts(rows, array, max_words).where(F.col("f") >= threshold), "frequent_phrases")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, summary: int = SUMMARY) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best phrases of two and more words.

    a, l and r count the phrase and the two parts of its lowest-scoring cut, n all words of the
    language; the score is 2000000 * a / (l + r), floored. A phrase inside a longer frequent one that has at least 80 %
    of its occurrences goes. Null and empty texts have no words, a null language is `und`; each row
    counts, repeated ones too. Other columns aren't read. Ties go by a, then by the phrase's bytes.
    """
    rows = docs.select(F.col(text).cast("string").alias("text"), language(lang).alias("lang"))
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09.,;:!?\x0A-\x0D]+")), F.lit(0)).cast("long")
    totals = pin_table(rows.groupBy("lang").agg(F.sum(words).alias("n")), "language_words")
    counts = frequent_phrases(rows, totals.agg(F.sum("n")).first()[0] or 0, min_count, max_words, summary)

    said = counts.where("n_words > 1").select("lang", "phrase", "n_words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    joined = lambda start, n: F.array_join(F.slice("w", start, n), " ")
    cuts = said.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)))
    cuts = cuts.select("lang", "phrase", "n_words", "a", "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.col("n_words") - F.col("k")).alias("right"))
    part = lambda name, f: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    score = F.expr("cast(2000000 as decimal(20, 0)) * cast(a as decimal(18, 0)) div (cast(l as decimal(18, 0)) + cast(r as decimal(18, 0)))").cast("long")
    best = cuts.withColumn("cut", F.struct(score.alias("score"), "k", "l", "r")).groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))

    # (start, words) of each shorter phrase of two and more words in a longer one
    inner = said.where("n_words > 2").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("n_words") - 1))).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n_words") - F.col("m") + 1)))
    longer = inner.select("lang", joined(F.col("i"), F.col("m")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    hundred = lambda c, n: F.col(c).cast("decimal(20, 0)") * n
    left = best.join(longer, ["lang", "phrase"], "left").where(F.col("most").isNull() | (hundred("most", 100) < hundred("a", 80)))
    left = left.select("lang", "phrase", "a", "cut.score", "cut.l", "cut.r")

    # the best of each of 64 parts of a language first, so that few meet to be ranked
    order = "ORDER BY score DESC, a DESC, phrase"
    few = left.withColumn("place", F.expr(f"row_number() OVER (PARTITION BY lang, pmod(xxhash64(phrase), 64) {order})")).where(F.col("place") <= top)
    ranked = few.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang {order})").cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
