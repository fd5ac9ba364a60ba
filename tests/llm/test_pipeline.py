"""The pipeline's stages one by one on a small table, and as a whole."""

import corpus_pipeline
import pyarrow.parquet as pq

from bookmerge.llm import decontaminate, entries, jaccard_join, line_dedup, packing, quality_model
from tests.llm.test_operators import bench_words, components, crc, line_key, tokens, world  # noqa: F401

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for stage in (quality_model.stage, line_dedup.stage, jaccard_join.stage, decontaminate.stage):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() <= docs.count()


def test_one_document_of_each_group_stays(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r["doc_id"] for r in jaccard_join.stage(spark, docs, SF).select("doc_id").collect()}
    groups = {r["component"] for r in jaccard_join.jaccard_classes(docs.select("doc_id", "text")).collect()}
    assert kept == groups


def test_quality_stage_keeps_clean_documents(spark):
    labels = pq.read_table(f"{SF}/labels.parquet").to_pylist()
    kept = {r["doc_id"] for r in quality_model.stage(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()}
    good = [r["doc_id"] in kept for r in labels if r["quality"] == 1]
    assert sum(good) >= 0.97 * len(good)


def test_whole(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    total = out.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).toDF("doc_id", "a", "b")
    assert total.where("a <> b").count() == 0


def rows_after(spark, stage, world):  # noqa: F811
    """Rows of the stage over the small odd tables, and its input rows."""
    docs = spark.read.parquet(f"{world[0]}/documents.parquet")
    return sorted(map(tuple, stage(spark, docs, world[0]).collect()), key=repr), [dict(zip(docs.columns, (r[c] for c in docs.columns), strict=True)) for r in world[1]["documents"]]


def values(rows):
    return sorted((tuple(r.values()) for r in rows), key=repr)


def test_line_dedup_rows(spark, world):  # noqa: F811
    got, docs = rows_after(spark, line_dedup.stage, world)
    first = {}
    for r in sorted(docs, key=lambda r: r["doc_id"]):
        for x in (r["text"] or "").split("\n"):
            first.setdefault(line_key(x), r["doc_id"])
    want = []
    for r in docs:
        kept = [x for x in (r["text"] or "").split("\n") if len(line_key(x)) < 10 or first[line_key(x)] == r["doc_id"]]
        text = None if r["text"] is None else "\n".join(kept)
        want.append({**r, "text": text, "n_chars": None if text is None else len(text)})
    assert got == values(want) != values(docs)


def test_decontaminated_rows(spark, world):  # noqa: F811
    got, docs = rows_after(spark, decontaminate.stage, world)
    windows = set()
    for w in (bench_words(b["text"]) for b in world[1]["benchmark"]):
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    sizes = {len(w) for w in windows}
    hit = lambda w: any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))
    want = [r for r in docs if not hit(bench_words(r["text"]))]
    assert got == values(want) and 0 < len(want) < len(docs)


def test_one_document_a_group(spark, world):  # noqa: F811
    got, docs = rows_after(spark, jaccard_join.stage, world)
    part = components([(r["doc_id"], r["text"]) for r in docs])
    want = [r for r in docs if part[r["doc_id"]] == r["doc_id"]]
    assert got == values(want) and len(want) < len(docs)


def test_quality_rows(spark, world):  # noqa: F811
    got, docs = rows_after(spark, quality_model.stage, world)
    good = {r["doc_id"] for r in entries.queries()["op6_quality_model"](spark, world[0]).collect() if r["score"] >= 0.5}
    assert got == values(r for r in docs if r["doc_id"] in good)


def test_packed_ids(spark, world):  # noqa: F811
    docs = spark.read.parquet(f"{world[0]}/documents.parquet")
    want = {}
    for r in world[1]["documents"]:
        want.setdefault(r["doc_id"], []).append(tokens(r["text"]))
    total = 0
    for p in packing.stage(spark, docs, world[0]).collect():
        assert any(len(x) == p["doc_tokens"] and crc(x[p["start"] : p["start"] + p["length"]]) == p["ids_crc32"] for x in want[p["doc_id"]])
        total += p["length"]
    assert total == sum(len(x) for xs in want.values() for x in xs)
