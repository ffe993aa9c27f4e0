import corpus_pipeline
from sitespec.llm.common import materialize
from sitespec.llm.mixing import domains_of, mixing_rates
from tests.llm.test_minmax_dedup import brute


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = [(10_001, None, "en", "s", None), (10_002, "", "en", None, 0), (10_003, "12 34", None, "s", 5), (10_004, "password = abcdefgh and the rest of the words", "en", "s", 45)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    before = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, docs, sf_dir), "stage")
        seen[name] = (docs, after)
        if name != "SentencePiece":
            assert after.columns == before.columns
        docs = after
    assert list(seen) == ["language ID", "MinHash near-dedup", "secret scans", "mixing", "SentencePiece"]
    ids = {k: sorted(r.doc_id for r in v[1].select("doc_id").collect()) for k, v in seen.items()}
    assert ids["language ID"] == sorted([*range(200), 10_004])
    rows = [(r.doc_id, r.text) for r in seen["language ID"][1].collect()]
    assert ids["MinHash near-dedup"] == [r[0] for r in brute(rows, 80) if r[3]]
    assert ids["secret scans"] == ids["MinHash near-dedup"]
    text = {r.doc_id: r.text for r in seen["secret scans"][1].collect()}
    assert text[10_004] == "<secret> and the rest of the words"
    assert sorted(set(ids["mixing"])) == ids["secret scans"]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rates = {r.doc_id: r.rate for r in mixing_rates(seen["mixing"][0], domains_of(labels), corpus_pipeline.WEIGHTS, 1.0)[0].collect()}
    assert all(abs(ids["mixing"].count(k) - r) < 1 for k, r in rates.items())
    assert ids["SentencePiece"] == ids["mixing"]


def test_run_is_the_stages(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "ids", "n_pieces"] and out.count() >= 150
