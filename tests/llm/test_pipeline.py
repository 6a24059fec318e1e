import collections

import corpus_pipeline
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from tessellon.llm import bpe, fm, mixing, pii, simhash, toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    plain = "quiet river stones gather under the long bridge while grey birds wait for rain and nobody hurries home tonight".split()
    rows = [(i, " ".join(plain[i % 7 :] + [f"word{i}x{j}" for j in range(12)]), "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " you moron", "en", "s0", None) for i in range(30)]
    rows += [(200, rows[5][1], "en", None, 3), (201, None, None, None, None), (202, "", "en", "s1", 0), (203, "mail me at a.b@c.example now or then", "en", "s1", 5)]
    return rows


def labelled(spark, tmp_path):
    rows = [(i, 1, 0) for i in range(60)] + [(100 + i, 1, 1) for i in range(30)] + [(None, None, None), (7, 1, None)]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages_against_plain_python(spark, tmp_path):
    sf, rows = labelled(spark, tmp_path), documents()
    docs = spark.createDataFrame(rows, COLUMNS).repartition(3)

    out = corpus_pipeline.drop_toxic(spark, docs, sf)
    assert out.columns == docs.columns
    left = sorted(out.collect(), key=lambda r: r.doc_id)
    assert {r.doc_id for r in left} == {r[0] for r in rows if not 100 <= r[0] < 200}

    docs = spark.createDataFrame(left, COLUMNS)
    out = corpus_pipeline.drop_near_copies(spark, docs, sf)
    assert out.columns == docs.columns
    kept = sorted(out.collect(), key=lambda r: r.doc_id)
    prints = {r.doc_id: simhash.fingerprint(r.text) for r in left}
    group = {i: i for i in prints}
    for _ in prints:
        group = {i: min(group[j] for j in prints if ((prints[i] ^ prints[j]) & (2**64 - 1)).bit_count() <= 4) for i in prints}
    assert [r.doc_id for r in kept] == sorted(i for i in prints if group[i] == i)
    assert 200 not in {r.doc_id for r in kept} and 5 in {r.doc_id for r in kept}

    docs = spark.createDataFrame(kept, COLUMNS)
    clean = sorted(corpus_pipeline.redact_personal_data(spark, docs, sf).collect(), key=lambda r: r.doc_id)
    assert [(r.doc_id, r.text, r.n_chars) for r in clean] == [(r.doc_id, pii.redact(r.text), None if r.text is None else len(pii.redact(r.text))) for r in kept]
    assert any(r.text and "[EMAIL]" in r.text for r in clean)

    docs = spark.createDataFrame(clean, COLUMNS)
    mixed = corpus_pipeline.mix_sources(spark, docs, sf)
    assert mixed.columns == docs.columns
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    mixed = mixed.collect()
    assert collections.Counter(r.doc_id for r in mixed) == collections.Counter({k: v for k, v in copies.items() if v})

    docs = spark.createDataFrame(mixed, COLUMNS)
    own = bpe.loaded(public_tokenizers.path(corpus_pipeline.BPE_FILE), public_tokenizers.PATTERN)
    public = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    done = corpus_pipeline.encode(spark, docs, sf).collect()
    assert sorted((r.doc_id, list(memoryview(bytes(r.token_ids)).cast("I"))) for r in done) == sorted((r.doc_id, public.encode_ordinary(r.text or "")) for r in mixed)


def test_rows_stay_rows(spark, tmp_path):
    """Repeated rows, null keys, extra columns with the names of helpers, and an empty table."""
    sf = labelled(spark, tmp_path)
    rows = [(*r, 1.5, "x") for r in documents()[:10] + documents()[:2]] + [(None, "alone in the whole table", "en", "s9", 1, 2.5, "y")] * 2
    docs = spark.createDataFrame(rows, COLUMNS + ", fp double, row string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf).count() == 0
        assert stage(spark, docs, sf).columns == docs.columns
    kept = corpus_pipeline.drop_near_copies(spark, docs, sf).collect()
    assert len(kept) == len({r.doc_id for r in kept}) and sum(r.doc_id is None for r in kept) == 1
    assert corpus_pipeline.encode(spark, docs.limit(0), sf).count() == 0


def test_run_applies_all_stages(spark, tmp_path):
    sf = labelled(spark, tmp_path)
    spark.createDataFrame(documents(), COLUMNS).write.parquet(f"{sf}/documents.parquet")
    assert corpus_pipeline.run(spark, sf).count() > 20
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "pii", "mix", "bpe"]


def test_no_labels_know_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    docs = spark.createDataFrame(documents(), COLUMNS)
    machine = toxicity.learn(docs, labels, fm.remainder(F.col("doc_id"), 5) != 0)
    assert {r.score for r in toxicity.score(docs, machine).collect()} == {0.5}


def test_a_machine_that_knows_nothing_rejects_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(documents(), COLUMNS)
    out = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and out.count() == docs.count()
