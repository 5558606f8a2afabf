"""Phrase collocations by stripes: each prefix keys a counter of the words that follow it.

A pass over the texts counts the stripes of all prefixes of one length. A task adds up its own stripes, tasks' stripes are merged element
by element, and one merged structure gives the extensions of every prefix (phrases one word longer with their counts), the total of the
prefix (of the empty prefix: all words of a language) and, as maxima over a stripe and over the phrases that end alike, which phrases a
longer one subsumes. Only phrases that are frequent themselves are prefixes of the next pass, since a phrase is no more frequent than
its parts.

* Frequent phrases are handed to the next pass as a bitmap of fixed size; what passes it by accident only costs a counter, since
  the merged counts decide.
* Stripes travel packed, in groups of the hash range, whose number grows with the input. The stripe of a hot prefix is cut into parts by
  next word, so it spreads, and a merging task streams over its groups and holds one of them at a time.
* Words and phrases are named by 64-bit hashes with the language as seed; two frequent words of one name end the job. A batch of texts is
  split and hashed as one array of bytes.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbweave.llm.common import written
from kbweave.llm.jaccard import mixed
from kbweave.session import estimated_bytes

LONGEST = 5
PARTS = 256
HOT_SHARE = 4096  # a prefix with more than this share of all words is hot; there are no more such than this
GROUP_BITS = (12, 16)
GROUP_BYTES = 1 << 20
BITMAP_BITS = 25
HELD = 1 << 20  # entries a task adds up before it hands its stripes on
TOLD = 1 << 18  # words a task remembers to have named; a forgotten one is named again
SLICE = 1 << 20
ENTRY = np.dtype([("prefix", "<u8"), ("next", "<u8"), ("n", "<i8")])
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_CLEAN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0a\x0b\x0c\x0d\x09", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 10 + b" ")
_KIND = np.zeros(256, dtype=np.int8)
_KIND[[32, 10]] = 1, 2
_BASE = 0xD1342543DE82EF95
_LETTERS = np.random.default_rng(20_024).integers(0, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@functools.lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, for that many places."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


@dataclass
class Words:
    """The words of a cleaned text in order: names, numbers of the pieces they stand in, and where they begin and end."""

    name: np.ndarray
    piece: np.ndarray
    begin: np.ndarray
    end: np.ndarray


def words_of(data: bytes, seed: np.uint64) -> Words:
    """All words at once: a word's hash is a difference of two running sums over the text, freed of its place.

    The text is taken in slices that end at a blank, so memory is a few slices beside the words.
    """
    found, at, pieces = [], 0, 0
    while at < len(data):
        stop = len(data)
        if stop - at > SLICE:
            blanks = [x for x in (data.find(b" ", at + SLICE), data.find(b"\n", at + SLICE)) if x >= 0]
            stop = min(blanks) + 1 if blanks else stop
        d = np.frombuffer(data, dtype=np.uint8, count=stop - at, offset=at)
        kind = _KIND[d]
        edges = np.flatnonzero(np.diff((kind == 0).view(np.int8), prepend=0, append=0))
        begin, end = edges[::2], edges[1::2]
        up, down = _powers(1 << max(SLICE, len(d)).bit_length())
        sums = np.zeros(len(d) + 1, dtype=np.uint64)
        np.cumsum(_LETTERS[d] * up[: len(d)], out=sums[1:])
        name = mixed(((sums[end] - sums[begin]) * down[begin]) ^ seed)
        breaks = np.cumsum(kind == 2, dtype=np.int64)
        found.append((name, breaks[begin] + pieces, begin + at, end + at))
        pieces, at = pieces + int(breaks[-1]), stop
    if not found:
        nothing = np.zeros(0, dtype=np.int64)
        return Words(nothing.astype(np.uint64), nothing, nothing, nothing)
    return Words(*(np.concatenate(column) for column in zip(*found)))


def extended(prefix: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Names of phrases from the names of all but the last word and of the last word."""
    return mixed(prefix * _FACTOR + following)


def _in_bitmap(names: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    place = (names & np.uint64((1 << BITMAP_BITS) - 1)).astype(np.int64)
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & np.uint8(1) == 1


def _entries(prefix, following, n) -> np.ndarray:
    entries = np.empty(len(following), ENTRY)
    entries["prefix"], entries["next"], entries["n"] = prefix, following, n
    return entries


def _merged(entries: np.ndarray) -> np.ndarray:
    """Stripes added element by element: one entry a prefix and next word."""
    if not len(entries):
        return entries
    entries = entries[np.argsort(extended(entries["prefix"], entries["next"]))]
    new = np.concatenate(([True], (entries["prefix"][1:] != entries["prefix"][:-1]) | (entries["next"][1:] != entries["next"][:-1])))
    out = entries[new]
    out["n"] = np.add.reduceat(entries["n"], np.flatnonzero(new))
    return out


def _places(entries: np.ndarray, hot: np.ndarray | None) -> np.ndarray:
    """A hash of each stripe or, of a hot prefix (all if None), of the stripe's part; its top bits are the group."""
    part = mixed(entries["next"]) % np.uint64(PARTS) + np.uint64(1)
    if hot is not None:
        part = np.where(np.isin(entries["prefix"], hot), part, np.uint64(0))
    return mixed(entries["prefix"] ^ (part * _FACTOR))


SENT = "g int, data binary, id long, lang string, word string"
MERGED = "prefix long, next long, phrase long, n long, id long, lang string, word string"


def _sent(entries: np.ndarray, hot: np.ndarray | None, bits: int) -> pa.RecordBatch:
    """Merged entries as rows of a group and its packed stripes: prefixes, sizes, next words, counts."""
    place = _places(entries, hot)
    order = np.argsort(place)
    place, entries = place[order], entries[order]
    runs = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (entries["prefix"][1:] != entries["prefix"][:-1]))))
    prefix, sizes = entries["prefix"][runs], np.diff(np.append(runs, len(entries))).astype("<u4")
    following, n = np.ascontiguousarray(entries["next"]), entries["n"].astype("<u4")
    group = (place[runs] >> np.uint64(64 - bits)).astype(np.int32)
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    run_edges, entry_edges = np.append(first, len(runs)).tolist(), np.append(runs[first], len(entries)).tolist()
    packed = [
        b"".join((np.uint32(r1 - r0).tobytes(), prefix[r0:r1].tobytes(), sizes[r0:r1].tobytes(), following[e0:e1].tobytes(), n[e0:e1].tobytes()))
        for r0, r1, e0, e1 in zip(run_edges, run_edges[1:], entry_edges, entry_edges[1:])
    ]
    nothing = pa.nulls(len(first), pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array(group[first]), pa.array(packed, pa.binary()), pa.nulls(len(first), pa.int64()), nothing, nothing], names=["g", "data", "id", "lang", "word"]
    )


def _unpacked(data: bytes) -> np.ndarray:
    stripes_ = int.from_bytes(data[:4], "little")
    prefix = np.frombuffer(data, "<u8", stripes_, 4)
    sizes = np.frombuffer(data, "<u4", stripes_, 4 + 8 * stripes_)
    n = int(sizes.sum())
    at = 4 + 12 * stripes_
    return _entries(np.repeat(prefix, sizes), np.frombuffer(data, "<u8", n, at), np.frombuffer(data, "<u4", n, at + 8 * n))


def _named(rows: list[tuple[int, str, bytes | None]], bits: int) -> pa.RecordBatch:
    """Names of languages (no word) and of words, sent with the stripes."""
    ids = np.array([i for i, _, _ in rows], dtype=np.uint64)
    group = (mixed(ids) >> np.uint64(64 - bits)).astype(np.int32)
    words = pa.array([w for _, _, w in rows], pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array(group), pa.nulls(len(rows), pa.binary()), pa.array(ids.view(np.int64)), pa.array([lang for _, lang, _ in rows], pa.string()), words],
        names=["g", "data", "id", "lang", "word"],
    )


def lang_name(lang: str) -> np.uint64:
    import xxhash

    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))


class _Told:
    """Words a task has named: a table by low bits answers for most, a bounded set for the rest."""

    def __init__(self) -> None:
        self.known, self.table = set(), np.zeros(1 << 20, dtype=np.uint64)

    def fresh(self, words: Words, often: np.ndarray, data: bytes) -> list[tuple[int, bytes]]:
        slot = (words.name[often] & np.uint64(len(self.table) - 1)).astype(np.int64)
        often = often[self.table[slot] != words.name[often]]
        seen, place = np.unique(words.name[often], return_index=True)
        self.table[(seen & np.uint64(len(self.table) - 1)).astype(np.int64)] = seen
        rows = [(i, data[words.begin[at] : words.end[at]]) for i, at in zip(seen.tolist(), often[place].tolist()) if i not in self.known]
        if len(self.known) > TOLD:
            self.known.clear()
        self.known.update(i for i, _ in rows)
        return rows


def stripes(documents: DataFrame, length: int, known, bits: int) -> DataFrame:
    """Rows ``SENT``: the stripes of all prefixes of ``length`` words, each task's added up; ``documents`` has ``lang, text``.

    With length 0 the prefix is the language. ``known`` is the broadcast pair of a bitmap of the frequent phrases of ``length`` words and the hot
    ones among them; an extension counts only if its first and its last ``length`` words are in the bitmap. Length 0 also names the languages,
    length 1 the frequent words.
    """

    def counted(words: Words, lang: np.uint64) -> np.ndarray:
        if length == 0:
            names = np.sort(words.name)
            new = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1]))) if len(names) else np.zeros(0, dtype=np.int64)
            return _entries(lang, names[new], np.diff(np.append(new, len(names))))
        prefix = words.name
        for place in range(1, length):
            prefix = extended(prefix[:-1], words.name[place:])
        often = _in_bitmap(prefix, known.value[0]) & (words.piece[length - 1 :] == words.piece[: len(prefix)])
        at = np.flatnonzero(often[:-1] & often[1:] & (words.piece[: len(prefix) - 1] == words.piece[length:])) if len(prefix) else np.zeros(0, dtype=np.int64)
        return _entries(prefix[at], words.name[at + length], 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = known.value[1] if length else None
        langs: dict[str, np.uint64] = {}
        told = _Told()
        held, waiting, size = np.zeros(0, ENTRY), [], 0
        for batch in batches:
            texts: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if text:
                    texts.setdefault(lang, []).append(text)
            named = []
            for lang, members in texts.items():
                if lang not in langs:
                    langs[lang] = lang_name(lang)
                    named += [(int(langs[lang]), lang, None)] if length == 0 else []
                data = b"\n".join(members).translate(_CLEAN)
                words = words_of(data, langs[lang])
                if length == 1:
                    often = np.flatnonzero(_in_bitmap(words.name, known.value[0]))
                    named += [(i, lang, word) for i, word in told.fresh(words, often, data)]
                if len(words.name) >= length:
                    waiting.append(counted(words, langs[lang]))
                    size += len(waiting[-1])
            if named:
                yield _named(named, bits)
            if size > max(len(held), HELD // 4):
                held, waiting, size = _merged(np.concatenate([held, *waiting])), [], 0
                if len(held) > HELD:
                    yield _sent(held, hot, bits)
                    held = held[:0]
        held = _merged(np.concatenate([held, *waiting]))
        if len(held):
            yield _sent(held, hot, bits)

    return documents.mapInArrow(run, SENT)


def merge(sent: DataFrame, least: int, totals: bool) -> DataFrame:
    """Rows ``MERGED``: every extension with a count of ``least`` or more, if asked the totals of the prefixes (no next word), and the names."""

    def result(entries: np.ndarray) -> pa.RecordBatch:
        entries = _merged(entries)
        often = entries[entries["n"] >= least]
        columns = [often["prefix"], often["next"], extended(often["prefix"], often["next"]), often["n"]]
        columns = [pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns]
        if totals and len(entries):
            prefix, place = np.unique(entries["prefix"], return_inverse=True)
            sums = np.zeros(len(prefix), dtype=np.int64)
            np.add.at(sums, place, entries["n"])
            more = [pa.array(prefix.view(np.int64)), pa.nulls(len(prefix), pa.int64()), pa.nulls(len(prefix), pa.int64()), pa.array(sums)]
            columns = [pa.concat_arrays([a, b]) for a, b in zip(columns, more)]
        rows = len(columns[0])
        names = [pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.string()), pa.nulls(rows, pa.string())]
        return pa.RecordBatch.from_arrays([*columns, *names], names=["prefix", "next", "phrase", "n", "id", "lang", "word"])

    def names_of(named: pa.RecordBatch) -> pa.RecordBatch:
        """Each name once, as far as one batch shows."""
        _, first = np.unique(named.column(2).to_numpy(), return_index=True)
        keep = sorted({*first.tolist(), *np.flatnonzero(np.diff(named.column(2).to_numpy(), prepend=0)).tolist()})
        named = named.take(pa.array(keep, pa.int64()))
        nothing = pa.nulls(len(keep), pa.int64())
        return pa.RecordBatch.from_arrays(
            [nothing, nothing, nothing, nothing, named.column(2), named.column(3), named.column(4)], names=["prefix", "next", "phrase", "n", "id", "lang", "word"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, group = np.zeros(0, ENTRY), None
        for batch in batches:
            ids = batch.column(2)
            packed = batch.filter(ids.is_null())
            if packed.num_rows:
                parts = [_unpacked(data) for data in packed.column(1).to_pylist()]
                entries = np.concatenate(parts)
                place = np.repeat(packed.column(0).to_numpy(), [len(part) for part in parts])
                if group is not None and place[0] != group:
                    yield result(carried)
                    carried = carried[:0]
                group = int(place[-1])
                done, rest = entries[place != group], entries[place == group]
                if len(done):
                    yield result(np.concatenate([carried, done]))
                    carried = rest
                else:
                    carried = _merged(np.concatenate([carried, rest]))
            if packed.num_rows < batch.num_rows:
                yield names_of(batch.filter(ids.is_valid()))
        if len(carried):
            yield result(carried)

    return sent.repartition("g").sortWithinPartitions("g").mapInArrow(run, MERGED)


def bitmap_of(names: DataFrame) -> np.ndarray:
    """The set of the names' low bits in ``2^BITMAP_BITS`` bits; rows of 4 KB come to the driver, 4 MB in all."""
    low = names.select(F.col("phrase").bitwiseAND((1 << BITMAP_BITS) - 1).alias("low"))
    block, bit = F.shiftright("low", 15).alias("block"), F.col("low").bitwiseAND(32767).alias("bit")
    out = np.zeros((1 << BITMAP_BITS) // 8, dtype=np.uint8)
    for number, bits in low.select(block, bit).groupBy("block").agg(F.bitmap_construct_agg("bit")).collect():
        out[number * 4096 : (number + 1) * 4096] = np.frombuffer(bits, dtype=np.uint8)
    return out


def phrases(documents: DataFrame, least: int, longest: int = LONGEST) -> tuple[DataFrame | None, DataFrame]:
    """``lang, phrase, size, f`` of all phrases of 1 to ``longest`` words with ``least`` or more occurrences, and ``lang, n``.

    None instead of phrases if no word is that frequent.
    """
    spark = documents.sparkSession
    docs = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    bits = min(max((estimated_bytes(docs) // GROUP_BYTES).bit_length(), GROUP_BITS[0]), GROUP_BITS[1])
    first = written(merge(stripes(docs, 0, None, bits), least, totals=True), "stripes")
    lang = first.where("lang is not null").groupBy(F.col("id").alias("prefix")).agg(_only("lang"))
    totals = first.where("next is null and n is not null").groupBy("prefix").agg(F.sum("n").alias("n")).join(lang, "prefix").select("lang", "n")
    level = first.where("next is not null").select(F.col("next").alias("phrase"), "n")
    share = (totals.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE + 1
    found = words = last = None
    for length in range(1, longest + 1):
        if level.isEmpty():
            break
        if length < longest:
            hot = [row["phrase"] for row in level.where(F.col("n") >= share).select("phrase").collect()]
            known = spark.sparkContext.broadcast((bitmap_of(level), np.array(hot, dtype=np.int64).view(np.uint64)))
            following = written(merge(stripes(docs, length, known, bits), least, totals=False), "stripes")
            known.destroy()
        if length == 1:
            names = following.where("word is not null").groupBy(F.col("id").alias("phrase")).agg(_only("word"), _only("lang"))
            words = written(level.join(names, "phrase").select("phrase", "lang", F.col("word").alias("text"), F.col("n").alias("f")), "words")
            last = words
        else:
            tail = words.select(F.col("phrase").alias("next"), F.col("text").alias("word"))
            head = last.select(F.col("phrase").alias("prefix"), "lang", "text")
            longer = level.join(head, "prefix").join(tail, "next")
            last = written(longer.select("phrase", "lang", F.concat_ws(" ", "text", "word").alias("text"), F.col("n").alias("f")), "phrases")
        rows = last.select("lang", F.col("text").alias("phrase"), F.lit(length).alias("size"), "f")
        found = rows if found is None else found.unionByName(rows)
        if length < longest:
            level = following.where("next is not null").select("prefix", "next", "phrase", "n")
    return found, totals


def _only(name: str) -> Column:
    """The one value of a group; two values of one hash end the job."""
    clash = F.raise_error(F.lit("two words share a hash")).cast("string")
    return F.when(F.min(name) == F.max(name), F.min(name)).otherwise(clash).alias(name)


def collocations(documents: DataFrame, least: int = 100, best: int = 2000, subsumed: int = 100, longest: int = LONGEST) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``best`` phrases of 2 to ``longest`` words of each language.

    Texts (``lang``, ``text``; other columns are not read) are lower-cased (A-Z), split at ``[.,;:!?]`` and line ends into pieces and those at spaces
    and tabs into words; a null language is ``und``, a null text empty. A phrase with ``a`` occurrences within pieces, at least ``least``, is cut
    in two where ``floor(1000 a n / (l r))`` is lowest, first such cut on ties; ``n`` counts the language's words, ``l`` and ``r`` the parts.
    A phrase goes if a longer one that holds it has at least ``subsumed`` percent of its occurrences. Ranks go by score, then ``a``, both
    descending, then by the phrase's bytes. Repeated rows count each; an empty table gives an empty result.
    """
    found, totals = phrases(documents, least, longest)
    if found is None:
        empty = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"
        return documents.sparkSession.createDataFrame([], empty)
    parts = found.select("lang", F.col("phrase").alias("part"), F.col("f").alias("f_part"))
    long_ones = found.where("size > 1")
    tail = lambda k: F.expr(f"substring(phrase, char_length(substring_index(phrase, ' ', {k})) + 2)")
    cuts = long_ones.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "f", "k", F.expr("substring_index(phrase, ' ', k)").alias("first"), tail("k").alias("rest"))
    cuts = cuts.join(parts.select("lang", F.col("part").alias("first"), F.col("f_part").alias("l")), ["lang", "first"])
    cuts = cuts.join(parts.select("lang", F.col("part").alias("rest"), F.col("f_part").alias("r")), ["lang", "rest"])
    cuts = cuts.join(totals, "lang")
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(f as decimal(17,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(17,0)) * cast(r as decimal(17,0)))")
    lowest = cuts.groupBy("lang", "phrase").agg(F.first("f").alias("a"), F.first("n").alias("n"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    # The most frequent extension to either side; longer ones are no more frequent than these.
    longer = long_ones.where("size > 2")
    sides = longer.select("lang", F.expr("substring_index(phrase, ' ', size - 1)").alias("phrase"), "f").unionByName(longer.select("lang", tail(1).alias("phrase"), "f"))
    most = sides.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    kept = lowest.join(most, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < subsumed * F.col("a")))
    rows = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
