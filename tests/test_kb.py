import datetime
import json

import pytest
from pyspark.sql import functions as F

from kbweave.operators import kb, staging
from kbweave.operators.chunking import explode_notes
from kbweave.plans.build import build_from_files, build_from_notes, build_from_texts, chunk_id
from kbweave.plans.retrieve import request_table, retrieve


def rows(spark, entries):
    data = [(i, c, t, "{}", s, datetime.datetime(2024, 1, 1), v) for i, c, t, s, v in entries]
    return spark.createDataFrame(
        data,
        "id long, collection string, content string, metadata string, source string, created_at timestamp, embedding array<float>",
    )


BASE = [(1, "a", "one", "f1", [1.0]), (2, "a", "two", "f2", [2.0]), (3, "b/c", "three", "f1", [3.0])]


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_lifecycle(spark, tmp_path):
    path = str(tmp_path / "kb")
    bad = [(8, "a", "", "f", [1.0]), (9, "a", "x", "f", [])]
    kb.overwrite(rows(spark, BASE + bad), path)
    assert ids(kb.read(spark, path)) == [1, 2, 3]
    for _ in range(2):
        kb.append(rows(spark, [(4, "a", "four", "f3", [4.0])]), path, "more")
    assert ids(kb.read(spark, path, "a")) == [1, 2, 4]
    kb.overwrite(rows(spark, [(5, "b/c", "five", "f3", [4.0])]), path)
    assert ids(kb.read(spark, path)) == [1, 2, 4, 5]
    assert kb.rename(spark, path, "b/c", "d") and not kb.rename(spark, path, "gone", "x")
    assert not kb.rename(spark, path, "a", "d")
    assert ids(kb.read(spark, path, "d")) == [5] and kb.validate(spark, path, "a") == 3
    assert kb.drop(spark, path, "a") and ids(kb.read(spark, path)) == [5]
    with pytest.raises(ValueError):
        kb.validate(spark, path, "a")
    with pytest.raises(ValueError):
        kb.check_name("_hidden")


def test_append_refuses_another_dimension(spark, tmp_path):
    path = str(tmp_path / "kb")
    kb.overwrite(rows(spark, BASE), path)
    kb.append(rows(spark, [(4, "new", "t", "f", [1.0, 2.0])]), path, "more")
    with pytest.raises(Exception, match="collection a has dimension 1, got 2"):
        kb.append(rows(spark, [(5, "a", "t", "f", [1.0, 2.0]), (6, "new", "t", "f", [1.0, 2.0])]), path, "wrong")
    assert ids(kb.read(spark, path)) == [1, 2, 3, 4]
    kb.append(rows(spark, [(7, "new", "t", "f", [1.0, 2.0, 3.0])]), path, "more")  # replaces the only rows of its label
    assert ids(kb.read(spark, path, "new")) == [7]


def test_mixed_kinds_and_repeated_appends_keep_their_own_texts(spark, tmp_path):
    path = str(tmp_path / "kb")
    docs = spark.createDataFrame([(1, "the red fox runs over the hill"), (2, "blue whales swim in the cold sea")], "doc_id long, text string")
    notes = spark.createDataFrame([(1, "fox", "a note on the red fox"), (2, "sea", "a note on the sea")], "note_id long, title string, content string")
    kb.append(build_from_texts(docs, collection=F.lit("c")).unionByName(build_from_notes(notes, collection=F.lit("c"))), path, "one")
    kb.append(build_from_texts(docs, collection=F.lit("c")), path, "two")
    stored = kb.read(spark, path)
    assert stored.count() == 6 and stored.select("batch", "row_id").distinct().count() == 6
    asked = spark.createDataFrame([(1, "red fox")], "query_id long, question string")
    for depth in (1, 2, 3, 6):
        hits = retrieve(asked, stored, depth=depth, rerank_count=0).orderBy("rank").collect()
        assert [r["rank"] for r in hits] == list(range(1, depth + 1))
    assert sorted(r["content"] for r in hits) == sorted(r["content"] for r in stored.collect())


def test_chunk_names_never_end_the_build(spark):
    big = spark.createDataFrame([(-1, 0), (1 << 50, 3), (5, 1 << 21), (5, 7)], "d long, i long")
    names = [r[0] for r in big.select(chunk_id(F.col("d"), F.col("i"))).collect()]
    assert len(set(names)) == 4 and names[3] == (5 << 20) + 7


def test_reading_one_collection_prunes_folders(spark, tmp_path):
    path = str(tmp_path / "kb")
    kb.overwrite(rows(spark, BASE), path)
    plan = kb.read(spark, path, "a").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(collection" in plan and "ReadSchema: struct<id:bigint>" in plan


def test_catalog_and_guard(spark):
    table = kb.catalog(rows(spark, BASE)).orderBy("collection").collect()
    assert [(r["collection"], r["chunk_count"], r["source_count"]) for r in table] == [("a", 2, 2), ("b/c", 1, 1)]
    known = spark.createDataFrame([("a", 4, "m1")], "collection string, embedding_dimension int, embedding_model string")
    incoming = spark.createDataFrame(
        [("a", 4, "m1"), ("a", 4, "m2"), ("a", 5, "m1"), ("n", 4, "m1")], "collection string, dimension int, model string"
    )
    checked = kb.append_check(incoming, known)
    assert sorted(r["status"] for r in checked.collect()) == ["model_differs", "new", "ok", "refused"]
    with pytest.raises(Exception, match="has dimension 4, got 5"):
        kb.require_appendable(checked).collect()


@pytest.mark.parametrize(
    "metadata, expected",
    [
        ('{"n": 5, "s": "5"}', {"n": 5, "s": "5", "source": 'q"x', "created_at": 7}),
        ("{}", {"source": 'q"x', "created_at": 7}),
        ("[1]", {"source": 'q"x', "created_at": 7}),
        (None, {"source": 'q"x', "created_at": 7}),
        ('{"source":"own","created_at":1}', {"source": "own", "created_at": 1}),
    ],
)
def test_metadata(spark, metadata, expected):
    df = spark.createDataFrame([(metadata,)], "m string")
    done = df.select(kb.complete_metadata(F.col("m"), F.lit('q"x'), F.lit(7)).alias("d"), kb.source_of(F.col("m")).alias("s"))
    assert json.loads(done.first()["d"]) == expected


def test_metadata_document(spark):
    document = json.dumps({"embeddingModel": "m", "created_at": "2024-01-02 03:04:05.000123", "files": ["a"]})
    other = json.dumps({"embedding_model": "n", "created_at": "2024-01-02 03:04:05.123456"})
    df = spark.createDataFrame([(document,), (other,)], "d string").select(kb.parse_metadata_document(F.col("d")).alias("p"))
    a, b = [r["p"] for r in df.collect()]
    assert a["embedding_model"] == "m" and a["created_at"].microsecond == 123000 and a["files"] == ["a"]
    assert b["embedding_model"] == "n" and b["created_at"].microsecond == 123456


def test_staging(spark, tmp_path):
    path = str(tmp_path / "staged")
    chunks = spark.createDataFrame([("t", "s", 0, "{}")], staging.STAGED_SCHEMA)
    assert not staging.exists(spark, path)
    staging.save(chunks, path)
    assert staging.exists(spark, path) and staging.load(spark, path).count() == 1
    assert staging.delete(spark, path) and not staging.exists(spark, path)
    (tmp_path / "old.json").write_text('[{"text":"a","source":"s","chunkIndex":3,"metadata":"{}"}]')
    assert staging.load_json_array(spark, str(tmp_path / "old.json")).first()["chunkIndex"] == 3


def test_notes(spark):
    notes = spark.createDataFrame(
        [(1, " t ", "x" * 501), (2, "short", "tiny"), (3, " ", "text"), (4, "t", "\n")], "note_id long, title string, content string"
    )
    got = [(r["note_id"], r["source"], len(r["content"])) for r in explode_notes(notes).orderBy("note_id", "chunk_index").collect()]
    assert got == [(1, "t (BLK 1/2)", 500), (1, "t (BLK 2/2)", 101), (2, "short", 4)]


def test_build_and_retrieve(spark, tmp_path):
    docs = [(i, f"document {i} about " + ("foxes and hounds " if i % 2 else "ships and ports ") * 3) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    path = str(tmp_path / "kb")
    kb.overwrite(build_from_texts(df, collection=F.lit("k")), path)
    table = kb.read(spark, path)
    asked = spark.createDataFrame([(1, "foxes hounds"), (2, "ships ports")], "query_id long, question string")
    hits = retrieve(asked, table, depth=6, rerank_count=2).collect()
    assert len(hits) == 4
    assert all(("foxes" in r["content"]) == (r["query_id"] == 1) for r in hits)
    fallback = retrieve(asked, table, depth=3, reranker_available=False).collect()
    assert sorted(r["score"] for r in fallback) == [0.98, 0.98, 0.99, 0.99, 1.0, 1.0]


def test_build_from_files(spark):
    files = spark.createDataFrame([("/x/a.txt", "a.txt", "some plain text"), ("/x/e.txt", "e.txt", " ")], "path string, file_name string, text string")
    built = build_from_files(files, collection="c").collect()
    assert [r["source"] for r in built] == ["a.txt"] and json.loads(built[0]["metadata"])["chunkIndex"] == 0


def test_chunk_ids(spark):
    df = spark.createDataFrame([(5, 3)], "d long, c int")
    assert df.select(chunk_id(F.col("d"), F.col("c"))).first()[0] == (5 << 20) + 3


def test_requests_keep_blank_lines(spark):
    prompts = spark.createDataFrame([(1, "", "a\n\nb"), (2, "sys", "sys\n\na\n\nb")], "query_id long, system string, prompt string")
    bodies = {r["query_id"]: json.loads(r["body"]) for r in request_table(prompts, F.lit("m"), F.lit("http://x")).collect()}
    assert bodies[1]["messages"] == [{"role": "user", "content": "a\n\nb"}]
    assert bodies[2]["messages"] == [{"role": "system", "content": "sys"}, {"role": "user", "content": "a\n\nb"}]


def other(spark, entries, model="m"):
    return rows(spark, entries).withColumn("model", F.lit(model))


def test_overwrite_is_seen_as_a_whole(spark, tmp_path, monkeypatch):
    """Readers see the old rows of all collections until the switch, the new ones after it, and never both or neither."""
    path = str(tmp_path / "kb")
    kb.overwrite(rows(spark, BASE), path)
    kb.append(rows(spark, [(4, "a", "four", "f", [4.0]), (5, "c", "five", "f", [5.0])]), path, "more")
    before, seen = kb.read(spark, path), []
    check = kb._require_one_dimension
    monkeypatch.setattr(kb, "_require_one_dimension", lambda *a, **b: seen.append(ids(kb.read(spark, path))) or check(*a, **b))
    label = kb.overwrite(rows(spark, [(6, "a", "six", "f", [6.0]), (7, "b/c", "seven", "f", [7.0])]), path)
    assert seen == [[1, 2, 3, 4, 5]]
    assert ids(kb.read(spark, path)) == [5, 6, 7] and ids(before) == [1, 2, 3, 4, 5]  # a reader from before ends on the old rows
    assert kb.purge(spark, path) == 3 and kb.purge(spark, path) == 0
    assert ids(kb.read(spark, path)) == [5, 6, 7]
    kb.append(rows(spark, [(8, "a", "eight", "f", [8.0])]), path, "more")  # a label whose rows were replaced can be used again
    assert ids(kb.read(spark, path, "a")) == [6, 8] and ids(kb.read(spark, path)) == [5, 6, 7, 8]
    assert {r["batch"] for r in kb.read(spark, path, "b/c").collect()} == {label}


def test_writes_that_die_change_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "kb")
    kb.overwrite(rows(spark, BASE), path)
    for step in ("_require_one_dimension", "_write"):
        with monkeypatch.context() as patch:
            patch.setattr(kb, step, lambda *a, **b: (_ for _ in ()).throw(RuntimeError("lost")))
            patch.setattr(kb, "_remove_batch", lambda *a: None)  # as if the driver died
            patch.setattr(kb, "_take", lambda *a: None)
            with pytest.raises(RuntimeError):
                kb.overwrite(rows(spark, [(9, "a", "nine", "f", [9.0])]), path)
            with pytest.raises(RuntimeError):
                kb.append(rows(spark, [(9, "a", "nine", "f", [9.0])]), path, f"dead {step}/x")
        assert ids(kb.read(spark, path)) == [1, 2, 3]
    kb.append(rows(spark, [(4, "a", "four", "f", [4.0])]), path, "dead _write/x")  # the same label again
    assert ids(kb.read(spark, path)) == [1, 2, 3, 4]


def test_many_replaced_partitions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(kb, "HIDDEN_FILTERS", 2)
    path = str(tmp_path / "kb")
    kb.overwrite(rows(spark, [(i, f"c{i}", "t", "f", [1.0]) for i in range(6)]), path)
    kb.overwrite(rows(spark, [(10 + i, f"c{i}", "t", "f", [1.0]) for i in range(5)]), path)
    assert ids(kb.read(spark, path)) == [5, 10, 11, 12, 13, 14]
    assert kb.rename(spark, path, "c0", "d") and ids(kb.read(spark, path)) == [5, 10, 11, 12, 13, 14]


def test_one_dimension_within_a_write(spark, tmp_path):
    path = str(tmp_path / "kb")
    mixed = [(1, "n", "t", "f", [1.0]), (2, "n", "t", "f", [1.0, 2.0])]
    for write in (lambda: kb.append(rows(spark, mixed), path, "x"), lambda: kb.overwrite(rows(spark, mixed), path)):
        with pytest.raises(ValueError, match="collection n has dimension 1, got 2"):
            write()
    kb.append(rows(spark, BASE), path, "y")
    assert ids(kb.read(spark, path)) == [1, 2, 3]


def test_another_model_warns(spark, tmp_path):
    path = str(tmp_path / "kb")
    kb.append(other(spark, BASE, "one"), path, "a")
    with pytest.warns(UserWarning, match="collection a holds vectors of one and two"):
        kb.append(other(spark, [(4, "a", "t", "f", [1.0])], "two"), path, "b")
    models = {(r["collection"], r["embedding_model"]): r["rows"] for r in kb.models_of(kb.read(spark, path)).collect()}
    assert models == {("a", "one"): 2, ("a", "two"): 1, ("b/c", "one"): 1}


def test_opening_checks(spark, tmp_path):
    path = str(tmp_path / "kb")
    kb.overwrite(rows(spark, BASE), path)
    wanted = spark.createDataFrame([("a",), ("gone",)], "collection string")
    assert sorted(tuple(r) for r in kb.opening_checks(wanted, path).collect()) == [("a", "ok", 2, 0), ("gone", "missing", 0, 0)]
    old = str(tmp_path / "old")
    rows(spark, BASE).withColumn("batch", F.lit("b")).write.partitionBy("collection", "batch").parquet(old)
    assert "dimension" in kb.opening_checks(wanted, old).first()["status"]


def test_vectors_of_models_that_follow_the_setting(spark):
    docs = spark.createDataFrame([(1, "some words to embed here")], "doc_id long, text string")
    norm = lambda **options: sum(x * x for x in build_from_texts(docs, **options).first()["embedding"]) ** 0.5
    assert norm() == pytest.approx(1, abs=1e-5) and norm(model="Qwen3-bge", normalize=False) == pytest.approx(1, abs=1e-5)
    assert norm(model="bge-small", normalize=True) == pytest.approx(1, abs=1e-5)
    assert abs(norm(model="bge-small", normalize=False) - 1) > 0.05
    assert build_from_texts(docs, model="bge-small").first()["model"] == "bge-small"
