"""The pipeline's stages, each held against its operator on what the stage before kept."""

from collections import Counter

import corpus_pipeline
from inkwell.llm.common import written

from .test_dedup import components, shingles
from .test_rules import verdicts


def test_stages_pass_on_documents(spark, docs, rows, tmp_path):
    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    long = next(t for _, t, *_ in rows if t and len(t) > 50_000).split()
    spark.createDataFrame([(1, " ".join(long[40:80]))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    now, counts = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = written(stage(spark, now, d), name)
        assert now.columns == docs.columns
        counts.append(now.count())
    assert counts[0] > counts[1] > counts[2] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, now, d).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(last.collect()) == sorted(corpus_pipeline.run(spark, d).select("doc_id", "start", "n_tokens", "ids_crc32").collect())


def test_stages_judge_rows_without_ids_alike(spark, odd, rows):
    """Null and reused ids, repeated rows and clashing columns: each stage gives what plain loops over its own input give."""
    kept = corpus_pipeline.quality(spark, odd, "").collect()
    every = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in odd.collect()]
    want = Counter(row for row, k in zip(every, verdicts(every), strict=True) if k)
    assert Counter((r["doc_id"], r["text"], r["lang"], r["source"]) for r in kept) == want

    # Near duplicates: as many rows stay as there are groups of texts, and one of each.
    texts = [r["text"] for r in odd.collect()]
    groups = components(list(enumerate(texts)), 5)
    stay = corpus_pipeline.near_dedup(spark, odd, "").collect()
    of = {}
    for k, t in enumerate(texts):
        of.setdefault(t, groups[k][1])
    worded = [r["text"] for r in stay if shingles(r["text"], 5)]
    assert sorted(of[t] for t in worded) == sorted({root for k, (n, root, _) in groups.items() if n})
    assert sum(not shingles(r["text"], 5) for r in stay) == sum(not n for n, _, _ in groups.values())
    assert stay and set(odd.columns) == set(stay[0].asDict())


def test_pipeline_of_an_empty_table(spark, nothing, tmp_path):
    d = str(tmp_path)
    nothing.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0
