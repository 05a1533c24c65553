import corpus_pipeline
from tesserae.llm.common import stored

from .helpers import SF, odd_documents
from .test_documents import brute_jaccard, brute_repeats


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, SF), f"test-{name}")
        before, after = {r.doc_id: r for r in docs.collect()}, out.collect()
        if name != "packing":
            assert out.columns == corpus_pipeline.COLUMNS and {r.doc_id for r in after} <= set(before) and len({r.doc_id for r in after}) == len(after)
            assert all(r.n_chars == len(r.text) for r in after)
        if name == "near_duplicates":
            ids = sorted(before)
            links = brute_jaccard([(i, before[i].text) for i in ids])
            label = list(range(len(ids)))
            for _ in ids:
                label = [min([label[i], *(label[j] for j in links[i])]) for i in range(len(ids))]
            assert sorted(r.doc_id for r in after) == [ids[i] for i in range(len(ids)) if label[i] == i]
        if name == "repeats":
            ids = sorted(before)
            left = {i: n - gone for i, (n, gone, _, _) in zip(ids, brute_repeats([before[i].text for i in ids], corpus_pipeline.REPEATED), strict=True)}
            assert all(len(r.text.encode()) == left[r.doc_id] for r in after if "�" not in r.text) and all(left[i] == 0 or i in {r.doc_id for r in after} for i in ids)
        if name == "benchmark":
            items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert not any(i in r.text for r in after for i in items)
        kept.append(len(after))
        docs = out
    assert kept[0] > 150 and kept[3] > 0.7 * kept[0]


def test_odd_and_empty_documents(spark):
    for docs in (odd_documents(spark), odd_documents(spark).limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, SF), f"odd-{name}")
        docs.collect()
