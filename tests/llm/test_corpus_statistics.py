"""Collocations, line deduplication and resampling against brute force, with edge cases and hot keys."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kbweave.llm import collocations, line_dedup, resampling

LONG = "The licence of this text is given in the file beside it."
ODD = [(1, None, None), (2, "", "en"), (3, " \n\t", None), (4, "word", "en"), (4, "word", "en"), (None, "no id", "en"), (5, "x" * 70_000, "fr"), (6, "é　ß 日本 🙂\x00 ▁ a.b", "en")]


def frame(spark, rows):
    """``doc_id, text, lang`` with extra columns of clashing names."""
    wide = [(*row, "clash", 1, "h", "n") for row in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, lang string, phrase string, score int, h1 string, n_lines string")


# --- collocations ----------------------------------------------------------------------


def brute_collocations(rows, least, best):
    totals, counts = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lower):
            words = re.findall(r"[^ \t]+", piece)
            totals[lang] += len(words)
            for size in range(1, 6):
                for at in range(len(words) - size + 1):
                    counts[lang, " ".join(words[at : at + size])] += 1
    often = {key: n for key, n in counts.items() if n >= least}
    found = {}
    for (lang, phrase), a in often.items():
        words, n = phrase.split(" "), totals[lang]
        if len(words) == 1:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = often[lang, " ".join(words[:k])], often[lang, " ".join(words[k:])]
            cuts.append((1000 * a * n // (left * right), k, left, right))
        inside = [f" {phrase} " in f" {other} " and other != phrase and 100 * f >= 100 * a for (of, other), f in often.items() if of == lang]
        if not any(inside):
            score, _, left, right = min(cuts)
            found.setdefault(lang, []).append((-score, -a, phrase.encode(), left, right, n))
    return {(lang, rank, p.decode(), -a, x, y, n, -score) for lang, rows in found.items() for rank, (score, a, p, x, y, n) in enumerate(sorted(rows)[:best], 1)}


@pytest.mark.parametrize("least, best", [(2, 50), (5, 3), (40, 2000)])
def test_collocations(spark, least, best):
    rng = random.Random(least)
    words = ["a", "B", "ab", "é", "日本", "the", "of", "\x00", "x" * 300]
    rows = list(ODD)
    for i in range(150):
        text = "".join(rng.choice(words[: rng.randrange(2, 10)]) + rng.choice(["  ", " ", " ", "\t", ". ", "\n", "\r\n", ","]) for _ in range(rng.randrange(40)))
        rows.append((i, text, rng.choice(["en", "en", "fr", None])))
    rows += [(1000 + i, "good morning to all of you", "en") for i in range(60)]
    got = collocations.collocations(frame(spark, rows).repartition(5), least, best).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute_collocations(rows, least, best)


def test_collocations_of_little(spark):
    empty = collocations.collocations(frame(spark, ODD).limit(0))
    assert empty.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and empty.count() == 0
    assert collocations.collocations(frame(spark, ODD), 100).count() == 0


def test_stripes_are_handed_on_early(spark, monkeypatch):
    """Tasks that can hold few entries and words give the same result, and a hot prefix is spread over groups."""
    rng = random.Random(8)
    rows = [(i, " ".join("the " + rng.choice("abcdefghijklmnopqrst") for _ in range(50)), "en") for i in range(40)]
    assert {tuple(r) for r in collocations.collocations(frame(spark, rows), 5).collect()} == brute_collocations(rows, 5, 2000)
    many = np.arange(3000, dtype=np.uint64)
    entries = collocations._entries(np.tile(many, 2) % 7, np.tile(many, 2), 2)
    merged = collocations._merged(entries)
    assert len(merged) == 3000 and set(merged["n"]) == {4}
    for hot, groups in ((None, 1000), (np.array([3], dtype=np.uint64), 100), (np.zeros(0, dtype=np.uint64), 1)):
        sent = collocations._sent(merged, hot, 12)
        assert len(sent) >= groups and (hot is None or len(hot) or len(sent) == 7)
        parts = [collocations._unpacked(x) for x in sent.column(1).to_pylist()]
        assert sorted(np.concatenate(parts).tolist()) == sorted(merged.tolist())
        for group, part in zip(sent.column(0).to_pylist(), parts):
            assert set((collocations._places(part, hot) >> np.uint64(52)).tolist()) == {group}


def test_words_in_slices(monkeypatch):
    rng = random.Random(9)
    data = "".join(rng.choice(["a", "b", "é", "日本", "abc", " ", " ", "\n", "\x00", "\x1c"]) for _ in range(5000)).encode() + b"x" * 300
    whole = collocations.words_of(data, np.uint64(5))
    monkeypatch.setattr(collocations, "SLICE", 64)
    parts = collocations.words_of(data, np.uint64(5))
    assert all((a == b).all() for a, b in zip(vars(whole).values(), vars(parts).values()))
    texts = [data[i:j] for i, j in zip(whole.begin, whole.end)]
    pieces = [(n, w) for n, piece in enumerate(data.split(b"\n")) for w in piece.split(b" ") if w]
    assert pieces == list(zip(whole.piece.tolist(), texts))
    names = dict(zip(texts, whole.name.tolist()))
    assert len(set(names.values())) == len(names) and [names[t] for t in texts] == whole.name.tolist()
    assert len(collocations.words_of(b"", np.uint64(1)).name) == 0 and len(collocations.words_of(b" \n ", np.uint64(1)).name) == 0


def test_scores_beyond_64_bits(spark):
    expr = "(cast(1000 as decimal(4,0)) * cast(f as decimal(17,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(17,0)) * cast(r as decimal(17,0)))"
    f, n, left, right = 3 * 10**14 + 7, 9 * 10**16 + 1, 8 * 10**14 + 3, 10**14 + 9
    row = spark.createDataFrame([(f, n, left, right)], "f long, n long, l long, r long").select(F.expr(expr)).first()
    assert row[0] == 1000 * f * n // (left * right)


# --- line deduplication ----------------------------------------------------------------


def brute_lines(rows, min_chars, min_docs):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    holders = {}
    low = -(1 << 63)
    for doc, text, _ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(low if doc is None else doc)
    out = []
    for doc, text, _ in rows:
        lines = (text or "").split("\n")
        own = low if doc is None else doc
        kept = [x for x in lines if len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == own]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def line_rows():
    rng = random.Random(4)
    common = [f"Line {i} of the common kind, as many texts hold it" for i in range(12)]
    rows = [(i, t, lang) for i, t, lang in ODD]
    for i in range(120):
        lines = []
        for _ in range(rng.randrange(9)):
            line = rng.choice(common) if rng.random() < 0.5 else f"Only {rng.random()} in this one text, nowhere else at all"
            lines.append(rng.choice(["", " ", "\t\r"]) + (line.upper() if rng.random() < 0.2 else line) + rng.choice(["", "  ", "\x0b"]))
        lines += [rng.choice(["", "short", common[0]])] * rng.randrange(3)
        rows.append((rng.randrange(-40, 90), "\n".join(lines), "en"))
    rows += [(None, LONG, "en"), (None, LONG + "\n\n", "en"), (200, f"\n{LONG}\n{LONG}\n", "en")] + [(201 + i, LONG + "\nend", "en") for i in range(4)]
    rows += [(300, "\n".join([LONG] * 2000 + ["tail"]), "en"), (300, LONG + "\nanother text of one id", "en"), (301, LONG, "en")]
    return rows


@pytest.mark.parametrize("batches", [1, 4, 7])
def test_lines(spark, batches):
    rows = line_rows()
    got = line_dedup.dedup(frame(spark, rows).repartition(6), batches=batches)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "text"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_lines(rows, 40, 5)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("kbweave_lines")]


def test_lines_with_many_common_hashes(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 3)
    rows = line_rows()
    got = line_dedup.dedup(frame(spark, rows), min_chars=5, min_docs=2).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_lines(rows, 5, 2)


def test_no_lines(spark):
    assert line_dedup.dedup(frame(spark, ODD).limit(0)).count() == 0


def test_runs_share_no_hash_and_are_compacted(spark):
    runs = line_dedup.LineRuns(spark, fan=3)
    seen = set()
    for batch in range(8):
        held = [(h % 50, 0, 1000 - 100 * batch + h % 3) for h in range(batch * 5, batch * 5 + 30)]
        repeats = runs.add(spark.createDataFrame(held, "h1 long, h2 long, doc long"))
        first = {}
        for h1, _, doc in held:
            if h1 not in seen:
                first[h1] = max(doc, first.get(h1, doc))
        assert sorted(tuple(r) for r in repeats.collect()) == sorted(x for x in held if first.get(x[0]) != x[2])
        seen |= {h1 for h1, _, _ in held}
        assert all(len(level) < 3 for level in runs.levels)
        stored = [r["h1"] for run in runs.runs() for r in run.collect()]
        assert sorted(stored) == sorted(seen)
    assert sum(map(len, runs.levels)) < 5
    runs.close()


def test_stored_runs_are_not_shuffled(spark):
    runs = line_dedup.LineRuns(spark)
    rows = spark.range(1000).select(F.xxhash64("id").alias("h1"), F.xxhash64(F.lit(1), "id").alias("h2"), F.col("id").alias("doc"))
    runs.add(rows)
    fresh = rows.groupBy(line_dedup.HASH).agg(F.max("doc")).hint("merge").join(runs.runs()[0].select(line_dedup.HASH).hint("merge"), line_dedup.HASH, "left_anti")
    assert fresh._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    runs.close()


# --- resampling -------------------------------------------------------------------------


def brute_resample(rows, target, percent, min_words, buckets):
    def features(text):
        lower = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        return len(words), [zlib.crc32(x) % buckets for x in words + [a + b" " + b for a, b in zip(words, words[1:])]]

    docs = [(doc, *features(text)) for doc, text, _ in rows]
    s, t = Counter(b for _, _, f in docs for b in f), Counter(b for text in target for b in features(text)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)}
    scored = []
    for doc, words, found in docs:
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'null' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        scored.append((doc, words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((x for x in scored if x[1] >= min_words), key=lambda x: (-x[4], x[0] is None, x[0] or 0, x[2], x[3]))
    drawn = fit[: percent * len(fit) // 100]
    out = [(x[0], x[2], x[3], x[4], rank) for rank, x in enumerate(drawn, 1)]
    rest = Counter(scored)
    rest.subtract(drawn)
    return sorted([*out, *((x[0], x[2], x[3], x[4], None) for x in rest.elements())], key=repr)


@pytest.mark.parametrize("percent, min_words, buckets", [(25, 20, 10_000), (60, 1, 7), (100, 0, 70_000), (0, 5, 100)])
def test_resample(spark, percent, min_words, buckets):
    rng = random.Random(percent)
    words = ["Alpha", "beta", "é", "x1", "日本", "long" * 80, "ß", "0"]
    rows = list(ODD) + [(i % 150, rng.choice([" ", "-", "\n"]).join(rng.choice(words) for _ in range(rng.randrange(60))), "en") for i in range(200)]
    rows += [(900, "same text of many words " * 9, "en")] * 5 + [(None, "beta x1 " * 20, "en"), (None, "beta x1 " * 30, "en")]
    target = ["Beta x1, beta", None, "", "ß 日本 0"]
    wanted = spark.createDataFrame([(i, t, 0) for i, t in enumerate(target)], "item_id long, text string, n_words int")
    got = resampling.resample(frame(spark, rows).repartition(4), wanted, percent, min_words, buckets=buckets)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_resample(rows, target, percent, min_words, buckets)


def test_resample_of_nothing(spark):
    target = spark.createDataFrame([("a b",)], "text string")
    assert resampling.resample(frame(spark, ODD).limit(0), target).count() == 0
    assert resampling.resample(frame(spark, ODD), target.limit(0)).count() == len(ODD)


def test_checksums():
    rng = random.Random(1)
    features = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 2, 3, 7, 7, 7, 200, 256, 257, 9000]))) for _ in range(500)]
    assert resampling.crc32s(features).tolist() == [zlib.crc32(x) for x in features] and len(resampling.crc32s([])) == 0
