"""The corpus pipeline, stage by stage, on the smallest tables."""

import math
from collections import Counter

import corpus_pipeline
import pytest
from quantgrid.llm import jaccard_join, packing

from .test_on_spark import SF, brute_jaccard, brute_lines, brute_targets, words


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, held = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        held[name] = (before.collect(), docs.collect())
        if name != "best_fit_packing":
            assert docs.columns == columns
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    before, after = held["toxicity"]
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    assert len(gone - toxic) <= 0.05 * len(before)
    before, after = held["line_dedup"]
    want = {d: text for d, text, _, _ in brute_lines(before)}
    assert len(before) == len(after) and all(r["n_chars"] == len(r["text"]) and r["text"] == want[r["doc_id"] or -1] for r in after)
    before, after = held["jaccard_join"]
    assert {r["doc_id"] for r in after} == {g for *_, g in brute_jaccard(before)}
    before, after = held["source_mix"]
    copies = Counter(r["doc_id"] for r in after)
    assert max(copies.values()) <= 2 and {*copies} <= {r["doc_id"] for r in before}
    size = {r["doc_id"]: len(words(r["text"])) for r in before}
    taken, goal, longest = Counter(), brute_targets(before), {}
    for r in after:
        taken[r["source"]] += size[r["doc_id"]]
    for r in before:
        longest[r["source"]] = max(longest.get(r["source"], 0), size[r["doc_id"]])
    assert all(math.floor(t) <= taken[s] <= t + longest[s] for s, t in goal.items())  # the last one is taken whole
    before, after = held["best_fit_packing"]
    total, want = Counter(), Counter()
    for r in after:
        total[r["doc_id"]] += r["length"]
    for r in before:
        want[r["doc_id"]] += len(words(r["text"])) + 1
    assert total == want


def test_columns_stay(spark):
    """Columns called as those that the operators add stay as they are."""
    names = "score n_lines n_dropped size source_size target taken group_id __id2 __lost __score __size a.b `c text.x".split()
    docs = spark.createDataFrame([(i, f"one two three four five six {i} seven\nline {i}", "en", "ab"[i % 2], 9, *([i] * len(names))) for i in range(12)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n.replace('`', '``')}` int" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns, name
        assert all(r[n] == r["doc_id"] for r in got.collect() for n in names)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).columns[:3] == ["doc_id", "source", "piece"]


def test_prefix():
    assert jaccard_join.prefix_depth(0.8, 0.0) == jaccard_join.DEPTH
    with pytest.raises(ValueError):
        jaccard_join.prefix_depth(0.2, 0.9999)
    assert jaccard_join.prefix_depth(0.2, 0.9999, trees=48) == 1


def test_bins_whatever_the_partitions(spark):
    """Bins depend on the rows alone: other partitions, the same placements, repeated rows among them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source", "text")
    docs = docs.unionByName(docs.where("doc_id < 20")).unionByName(docs.where("doc_id < 20"))
    one, two = ({tuple(r): 0 for r in packing.pack_documents(d).collect()} for d in (docs.repartition(3), docs.repartition(11, "text")))
    assert one == two


def test_rows_that_repeat(spark):
    """A row repeated 3000 times and a near copy of it: linked, and verified from one text."""
    words = " ".join(f"w{i}" for i in range(60))
    docs = spark.range(3000).selectExpr("cast(1 as long) as doc_id", f"'{words}' as text").unionByName(spark.createDataFrame([(2, words + " more")], "doc_id long, text string"))
    got = {(r["doc_id"], r["group_id"], r["n_links"]): 0 for r in jaccard_join.jaccard_join(docs).collect()}
    assert set(got) == {(1, 1, 1), (2, 1, 1)}
