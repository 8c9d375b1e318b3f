"""Each stage of the corpus pipeline against brute force, and the whole of it."""

import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from lakeloom.llm import language_id, registry, secrets

from .conftest import SCHEMA, awkward
from .test_operators import brute_components, check_packing, key

SMALL = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=key)


def test_stage_names_and_registration():
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard_join", "secret_scan", "best_fit_packing"]
    names = registry.queries()
    assert [next(n for n in names if n.startswith(f"op{k}_")) for k in range(1, 11)]
    assert set(registry.oracle_sql()) <= set(names)


def test_language_stage_rejects_what_has_no_language(spark, docs):
    out = pipeline.identify_language(spark, docs, SMALL)
    assert out.columns == docs.columns
    kept = {r.text for r in out.collect()}
    for _, text, *_ in awkward():
        if text is None or not language_id.letter_table()[[ord(c) for c in text]].any():
            assert text not in kept
        elif text.isascii():
            assert text in kept
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert pipeline.identify_language(spark, unlabelled, SMALL).count() == sum(language_id.ngram_counts(t or "")[0].size > 0 for _, t, *_ in awkward())


def test_exact_stage_keeps_the_largest_id_once(spark, docs):
    out = pipeline.drop_copies(spark, docs, SMALL)
    best = {}
    for r in awkward():
        if r[1] not in best or (r[0] or -1) > (best[r[1]][0] or -1):
            best[r[1]] = r
    # Null counts as empty: ids 1 (null) and 2 (empty) are one group.
    del best[None]
    assert rows(out) == sorted((tuple(r) for r in best.values()), key=key)


def test_near_stage_keeps_one_of_each_group(spark, docs):
    out = pipeline.drop_near_copies(spark, docs, SMALL)
    roots = brute_components([(r[0], r[1]) for r in awkward()])
    want = [tuple(r) for r, (i, _, root) in zip(awkward(), roots) if i == root]
    assert rows(out) == sorted(want, key=key)


def test_secret_stage_masks_and_keeps_all(spark, docs):
    out = pipeline.mask_secrets(spark, docs, SMALL)
    want = []
    for i, t, lang, source, n in awkward():
        text = None if t is None else secrets.mask(t)
        want.append((i, text, lang, source, n if text is None else len(text)))
    assert rows(out) == sorted(want, key=key)
    assert not any(secrets.base_spans(r.text or "") for r in out.collect())


def test_stages_keep_extra_columns_whatever_their_names(spark, docs, clashing):
    extra = len(docs.columns)
    for _, stage in pipeline.STAGES[:-1]:
        plain, out = stage(spark, docs, SMALL), stage(spark, clashing, SMALL)
        assert out.columns == clashing.columns and [f.dataType for f in out.schema] == [f.dataType for f in clashing.schema]
        got = out.collect()
        assert sorted((tuple(r)[:extra] for r in got), key=key) == rows(plain)
        assert all(tuple(r)[extra:] == tuple(range(len(r) - extra)) for r in got)
    assert rows(pipeline.pack_sequences(spark, clashing, SMALL).drop("sequence_id", "offset")) == rows(pipeline.pack_sequences(spark, docs, SMALL).drop("sequence_id", "offset"))


def test_stages_on_an_empty_table(spark, empty):
    docs = empty
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        assert docs.count() == 0


def test_run_packs_what_the_stages_keep(spark):
    out = pipeline.run(spark, SMALL).collect()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SMALL)
        docs = spark.createDataFrame([tuple(r) for r in kept.collect()], SCHEMA)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    used, total = check_packing(out, texts, 2048)
    assert used <= total / 2048 * 1.05 + 1
    assert Tokenizer.from_file(P.path("byte_bpe_50k.json")).get_vocab_size() > 50_000
