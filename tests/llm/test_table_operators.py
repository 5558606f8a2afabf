"""Joins, searches, archives, shards and the pipeline against brute force and fixed cases."""

import hashlib
import math
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from kbweave.llm import ann, decontam, jaccard, sharding, warc
from kbweave.llm.queries import QUERIES
from kbweave.session import scratch_path

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


# --- n-gram Jaccard join -----------------------------------------------------------------


def shingle_set(text, size):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute_components(rows, size, percent):
    sets = [(i, shingle_set(t, size)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(x)] = find(y)
    least = defaultdict(list)
    for x, (i, _) in enumerate(sets):
        least[find(x)].append(i)
    smallest = {r: min((i for i in ids if i is not None), default=None) for r, ids in least.items()}
    return Counter((i, len(s), smallest[find(x)] if s else i) for x, (i, s) in enumerate(sets))


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80)])
def test_join_finds_all_components(spark, size, percent):
    rng = random.Random(size)
    rows = [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "One two"), (1004, "one  TWO"), (1005, "one two"), (None, "one two"), (1006, "x " * 9000)]
    base = words(rng, 120)
    for i in range(120):  # a group of near copies with few and many edits, and chains of small steps
        text = list(base)
        for _ in range(rng.randrange(8)):
            text[rng.randrange(len(text))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
        if i % 6 == 0:
            base = list(text)
    passage = words(rng, 60)
    rows += [(200 + i, " ".join(words(rng, rng.randrange(1, 40)) + passage * (i % 2))) for i in range(100)]
    rows += [(400 + i, rows[8 + i % 9][1]) for i in range(60)] + [(400, rows[8][1])]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, component_id string")
    found = Counter(tuple(r) for r in jaccard.near_duplicates(docs, size, percent).collect())
    assert found == brute_components(rows, size, percent)


def test_join_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.near_duplicates(docs).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, None), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.near_duplicates(docs).collect())) == [(1, 2, 1), (2, 0, 2), (2, 0, 2)]


def test_one_of_each(spark):
    text = "the same words stand in both of these two documents here"
    docs = spark.createDataFrame([(3, text), (2, text.upper()), (2, text.upper()), (5, "other"), (6, None), (None, text)], "doc_id long, text string")
    kept = sorted(((r["doc_id"], r["text"]) for r in jaccard.one_of_each(docs).collect()), key=str)
    assert kept == sorted([(2, text.upper()), (5, "other"), (6, None), (None, text)], key=str)


def test_op3(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in QUERIES["op3_jaccard"](spark, SF_DIR).collect()) == brute_components(rows, 4, 85)


# --- decontamination ---------------------------------------------------------------------


def brute_leaks(docs, items):
    split = lambda x: regex.findall(r"[\p{L}\p{N}]+", (x or "").lower())
    grams = lambda w: [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
    texts = {i: split(x) for i, x in items if i is not None}
    sets = {i: set(grams(w)) for i, w in texts.items() if len(w) >= 5}
    held = Counter(s for v in sets.values() for s in v)
    weight = lambda s: math.floor(16 * (1 + math.log(max(len(sets), 1) / held.get(s, 1))) + 0.5)
    found = {}
    for d, x in docs:
        g = grams(split(x))
        for i, own in sets.items():
            n, total, best = len(texts[i]), sum(map(weight, own)), None
            for start in range(max(len(g) + 4 - n, 0) + 1):
                window = set(g[start : start + n - 4])
                both = sum(map(weight, window & own))
                similarity = both / (sum(map(weight, window)) + total - both)
                if similarity >= 0.8 and (best is None or similarity > best[1]):
                    best = (start, similarity)
            if best:
                found[d, i] = (best[0], n, round(best[1], 9))
    return found


def test_leaks_by_brute_force(spark):
    rng = random.Random(2)
    items = [(i, " ".join(words(rng, rng.randrange(3, 60)))) for i in range(40)] + [(90, None), (91, ""), (None, "a b c d e f g")]
    items += [(92, items[10][1]), (93, " ".join(items[11][1].split()[:-1] + ["zz"]))]
    docs = []
    for d in range(150):
        item = items[rng.randrange(40)][1].split()
        for _ in range(rng.randrange(3)):  # edits around the threshold
            at = rng.randrange(len(item))
            item[at : at + rng.randrange(2)] = [f"e{rng.randrange(999)}"] * rng.randrange(2)
        before, after = words(rng, rng.randrange(40)), words(rng, rng.randrange(40))
        text = before + item + after if d % 3 else before + after
        docs.append((d, " ".join(text).replace("w", "W") if d % 2 else ",\n ".join(text)))
    docs += [(900, None), (901, ""), (902, "a b"), (903, (items[5][1] + " ") * 40 + "x " * 8000)]
    frame = spark.createDataFrame([(*r, 1) for r in docs + [docs[1]]], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(*r, "c") for r in items], "item_id long, text string, start string")
    rows = decontam.contaminated(frame, bench).collect()
    found = {(r["doc_id"], r["item_id"]): (r["start"], r["n_words"], round(r["similarity"], 9)) for r in rows}
    assert len(found) == len(rows) and found == brute_leaks(docs, items)
    dirty = {d for d, _ in found}
    kept = decontam.clean(frame, bench)
    assert kept.columns == frame.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(d for d, _ in docs + [docs[1]] if d not in dirty)
    assert decontam.contaminated(frame.limit(0), bench).count() == 0 and decontam.contaminated(frame, bench.limit(0)).count() == 0


# --- nearest neighbours ------------------------------------------------------------------


def brute_nearest(ids, x, q, depth=10):
    d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
    others = ids != q
    order = np.lexsort((ids[others], d[others]))[:depth]
    return list(zip(ids[others][order].tolist(), d[others][order].tolist()))


def test_recall(spark):
    sf = "/root/testdata/sf0.1"
    if not os.path.exists(sf):
        pytest.skip("no data")
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    ids, x = rows["vec_id"].to_numpy(), np.stack(rows["embedding"].to_numpy()).astype(float)
    found = QUERIES["op6_multi_index"](spark, sf).toPandas().sort_values(["query_id", "rank"])
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        mine = found[found["query_id"] == q]
        assert mine["rank"].tolist() == list(range(1, 11)) and q not in set(mine["vec_id"])
        d = np.sqrt(((np.stack([x[ids == v][0] for v in mine["vec_id"]]) - x[ids == q][0]) ** 2).sum(1))
        assert np.allclose(d, mine["score"], rtol=0, atol=1e-12) and (np.diff(mine["score"]) >= 0).all()
        hits += len(set(mine["vec_id"]) & {v for v, _ in brute_nearest(ids, x, q)})
        total += 10
    assert hits / total >= 0.9


def test_nearest_of_copies_and_broken_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5)).astype(np.float32)
    x[100:220] = x[100]  # a large group of copies
    rows = [(i, x[i].tolist(), "c") for i in range(300)]
    broken = [(900, None, "c"), (1000, [], "c"), (1100, [0.0] * 5, "c"), (1200, [1.0, None, 1.0, 1.0, 1.0], "c"), (1300, [float("nan")] * 5, "c"), (1400, [float("inf")] * 5, "c"), (1500, [1.0], "c"), (None, [1.0] * 5, "c")]
    table = spark.createDataFrame(rows + broken + rows[:3], "vec_id long, embedding array<float>, rank string")
    found = ann.nearest(table, F.col("vec_id") % 50 == 0, share=1.0).toPandas().sort_values(["query_id", "rank"])
    assert sorted(set(found["query_id"])) == [0, 50, 100, 150, 200, 250]
    for q in (0, 50, 100, 150, 200, 250):
        want = brute_nearest(np.arange(300), x.astype(float), q)
        mine = found[found["query_id"] == q]
        assert mine["vec_id"].tolist() == [v for v, _ in want]
        assert np.allclose(mine["score"], [d for _, d in want], atol=1e-12)
    few = ann.nearest(table.filter("vec_id < 4"), F.col("vec_id") == 0, share=1.0).collect()
    assert len(few) == 3
    assert ann.nearest(table.filter("vec_id >= 900"), F.col("vec_id") % 50 == 0).count() == 1 - 1
    assert ann.nearest(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_walk_goes_by_summed_distance():
    rng = np.random.default_rng(6)
    counts = rng.integers(0, 5, size=30)
    index = ann.Index(0, (np.zeros((5, 1)), np.zeros((6, 1))), counts, counts, counts)
    for _ in range(50):
        da, db, enough = rng.random(5), rng.random(6), rng.integers(0, 70)
        order = np.argsort((da[:, None] + db[None]).ravel(), kind="stable")
        held = np.concatenate(([0], np.cumsum(counts[order])))
        size = int(np.argmax(held >= enough)) if (held >= enough).any() else 30
        assert set(np.flatnonzero(index.walk(da, db, enough))) == set(order[:size].tolist())


# --- WARC --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>" + "é" * 600 + "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n</p>"
    rows = [(1, "http://a/1", big), (7, "http://a/7", big), (3, None, big), (3, None, big), (4, "http://a/\r\nX: y", "small"), (5, "u", "small"), (6, "u", None), (8, "u", ""), (None, "u", big), (None, "u", "z" * 2000), (9, "u", "y" * 3_000_000)]
    return spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, record_type string")


def test_archives(spark, pages):
    path = scratch_path(spark, "warc-test")
    warc.write(warc.page_records(pages), path)
    rows = warc.read(spark, path).collect()
    assert len(rows) == pages.count()
    sources = {r["page_id"]: r["html"] or "" for r in pages.collect()}
    for r in rows:
        if r["record_type"] == "response":
            assert hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"] and len(r["payload"]) == r["payload_length"]
        if r["record_id"] and r["record_type"] == "response":
            assert r["payload"].decode() == sources[int(r["record_id"].rpartition(":")[2])]
    kinds = Counter((r["record_id"], r["record_type"], r["refers_to"]) for r in rows)
    assert kinds[("urn:page:1", "revisit", "urn:page:7")] == 1 and kinds[("urn:page:3", "revisit", "urn:page:7")] == 2
    assert kinds[("urn:page:7", "response", None)] == 1 and kinds[(None, "revisit", "urn:page:7")] == 1 and kinds[(None, "response", None)] == 1
    assert kinds[("urn:page:4", "response", None)] == 1 and kinds[("urn:page:5", "response", None)] == 1
    revisits = warc.read(spark, path).filter("record_type = 'revisit'")
    assert revisits.count() == 4
    assert warc.read(spark, path).filter(F.col("record_id").isin("urn:page:4", "urn:page:9")).count() == 2
    assert warc.read(spark, path).filter("refers_to is null and target_uri = 'u'").count() == 5
    none = warc.read(spark, path, payload="revisit").filter("record_type = 'response'").collect()
    assert len(none) == 7 and all(r["payload"] is None for r in none)
    empty = scratch_path(spark, "warc-test")
    warc.write(warc.page_records(pages.limit(0)), empty)
    assert warc.read(spark, empty).count() == 0


def test_unwanted_payloads_are_skipped(tmp_path):
    """The reader takes predicates over and does not read what they rule out."""
    from pyspark.sql.datasource import EqualTo

    rows = [{"record_id": f"r{i}", "record_type": "response" if i % 9 else "metadata", "target_uri": "u", "payload_digest": None, "payload_length": None, "refers_to": None, "payload": bytes([65 + i % 26]) * 500_000} for i in range(40)]
    (tmp_path / "a.warc").write_bytes(b"".join(map(warc.record_bytes, rows)))
    reader = warc.WarcReader(str(tmp_path), None)
    left = list(reader.pushFilters([EqualTo(("record_type",), "metadata"), EqualTo(("payload",), b"x")]))
    assert [f.attribute for f in left] == [("payload",)]
    (part,) = reader.partitions()

    class Counted:
        def __init__(self, inner):
            self.inner, self.read_bytes = inner, 0

        def read(self, n):
            data = self.inner.read(n)
            self.read_bytes += len(data)
            return data

        def seek(self, at):
            self.inner.seek(at)

    with open(tmp_path / "a.warc", "rb") as file:
        source = Counted(file)
        found = list(reader.records(source, part.size))
    assert [r["record_id"] for r in found] == [f"r{i}" for i in range(0, 40, 9)]
    assert all(r["payload"] == rows[int(r["record_id"][1:])]["payload"] for r in found)
    assert source.read_bytes < 40 * (1 << 16) + 5 * 600_000


# --- shards ------------------------------------------------------------------------------


def test_shards_fit_and_keep_all_rows(spark):
    rng = random.Random(9)
    rows = [(i, "x" * rng.randrange(400)) for i in range(3000)] + [(5000, "y" * 30_000), (5001, None), (5002, ""), (None, "n")] + [(6000, "same" * 50)] * 150
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, shard string")
    path = scratch_path(spark, "shards-test")
    found = sharding.write_shards(docs, path, limit=20_000).toPandas()
    assert Counter((None if math.isnan(i) else int(i), t) for i, t in zip(found["doc_id"], found["text"])) == Counter(rows)
    found["bytes"] = found["text"].map(lambda t: len(t.encode()) if t else 0)
    sums = found.groupby("shard").agg(bytes=("bytes", "sum"), n=("bytes", "size"), told=("shard_bytes", "first"), rows=("shard_rows", "first"))
    assert ((sums["bytes"] <= 20_000) | (sums["n"] == 1)).all()
    assert (sums["bytes"] == sums["told"]).all() and (sums["n"] == sums["rows"]).all()
    names = sorted({s.split("-")[0] for s in found["shard"]})
    assert not any(b != a and b.startswith(a) for a in names for b in names)  # prefixes do not contain each other
    assert 0.9 < sum(2.0 ** -len(a) for a in names) <= 1.0  # a split may leave a bucket without rows
    parents = Counter()
    for shard, size in sums["bytes"].items():  # only buckets over the limit were split
        name = shard.split("-")[0]
        for depth in range(len(name)):
            parents[name[:depth]] += size
    assert all(size > 20_000 for size in parents.values())
    assert sharding.assigned(docs.limit(0)).count() == 0


def test_op9(spark):
    rows = QUERIES["op9_sharding"](spark, SF_DIR).collect()
    assert len(rows) == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()


# --- pipeline ----------------------------------------------------------------------------


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, SF_DIR)
        assert out.columns == docs.columns
        path = scratch_path(spark, "pipeline-test")
        out.write.parquet(path)
        seen.append((name, kept, spark.read.parquet(path)))
        kept = seen[-1][2]
    ids = lambda df: {r["doc_id"] for r in df.collect()}
    groups = brute_components([(r["doc_id"], r["text"]) for r in seen[1][1].collect()], 5, 80)
    assert ids(seen[1][2]) == {i for i, _, c in groups if i == c}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    leaks = brute_leaks([(r["doc_id"], r["text"]) for r in seen[2][1].collect()], items)
    assert ids(seen[2][2]) == ids(seen[2][1]) - {d for d, _ in leaks}
    assert ids(seen[3][2]) == ids(seen[3][1])
    assert all(r["n_chars"] == len(r["text"]) for r in seen[3][2].collect())
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r["doc_id"] for r in rows} == ids(seen[3][2]) and all(r["round_trip"] for r in rows)
    assert set(texts) >= {r["doc_id"] for r in rows}


def near_copies(groups, size, words=60, edits=2, seed=3):
    """Groups of texts that differ from their first one by a few words."""
    rng = random.Random(seed)
    rows = []
    for group in range(groups):
        base = [f"g{group}w{rng.randrange(10_000)}" for _ in range(words)]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(edits + 1)):
                own[rng.randrange(words)] = f"x{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(own)))
    return rows


def test_pairs_grow_with_the_rows(spark, monkeypatch):
    """Groups of 10, 50 and 250 near copies are compared in proportion to their rows."""
    counts = {}
    verified = jaccard.verified
    for size in (10, 50, 250):
        asked = []
        monkeypatch.setattr(jaccard, "verified", lambda pairs, *rest: asked.append(pairs.count()) or verified(pairs, *rest))
        rows = near_copies(500 // size, size)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        groups = jaccard.near_duplicates(docs, 4, 75).groupBy("component_id").count().collect()
        assert max(r["count"] for r in groups) > size / 2
        counts[size] = sum(asked)
    assert counts[250] < 3 * len(rows) and counts[250] < 2 * counts[10] + len(rows), counts


def test_bitmaps_lose_no_pair(spark):
    """The bound of folded bitmaps is never below the true overlap, and rules out pairs just below the threshold."""
    rng = np.random.default_rng(6)
    pool = rng.integers(0, 1 << 63, size=4000, dtype=np.uint64)
    rows, pairs, true = [], [], []
    for i in range(300):
        n = int(rng.integers(1, 900))
        first = pool[rng.choice(4000, n, replace=False)]
        own = rng.choice(n, int(n * rng.uniform(0.8, 1)), replace=False)
        second = np.unique(np.concatenate([first[own], rng.integers(0, 1 << 63, size=int(rng.integers(0, n // 5 + 1)), dtype=np.uint64)]))
        first = np.unique(first)
        for k, found in enumerate((first, second)):
            rows.append((2 * i + k, jaccard.BITMAP, jaccard.bitmap(found).tolist()))
        pairs.append((2 * i, 2 * i + 1, len(first), len(second)))
        common = len(np.intersect1d(first, second))
        true.append(100 * common >= 85 * (len(first) + len(second) - common))
    parts = spark.createDataFrame(rows, "node long, fragment int, part array<long>")
    left = {r["a"] // 2 for r in jaccard._possible(spark.createDataFrame(pairs, "a long, b long, na int, nb int"), parts, 85).collect()}
    similar = {i for i, same in enumerate(true) if same}
    assert similar <= left and len(left - similar) < 0.2 * (300 - len(similar)) and 30 < len(similar) < 270
    whole = pool[:700]
    small = jaccard.bitmap(whole[:500])
    assert len(jaccard.bitmap(whole)) == 2 * len(small) == 128 and len(jaccard.bitmap(whole[:1])) == 1
