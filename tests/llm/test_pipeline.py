"""The stages, one by one, against plain versions of what each must do to its input."""

import pytest

import corpus_pipeline
from tarn.llm import mixing, pieces, quality
from tests.llm.test_shingles import plain_kept


@pytest.fixture(scope="module")
def stages(spark, data):
    docs, out = spark.read.parquet(f"{data}/documents.parquet"), []
    out.append(docs.toPandas())
    for _, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, data).cache()
        out.append(result.toPandas())
        docs = result
    return out


def test_rejected_documents_go(stages, duck):
    kept = duck.execute(f"SELECT doc_id FROM ({quality.OP5_SQL}) WHERE kept").df()["doc_id"]
    assert set(stages[1]["doc_id"]) == set(kept)
    assert list(stages[1].columns) == list(stages[0].columns)
    before = stages[0].set_index("doc_id")["text"]
    for i, t in zip(stages[1]["doc_id"], stages[1]["text"], strict=True):
        assert set(t.split("\n")) <= set(before[i].split("\n"))


def test_one_of_each_group_stays(stages):
    kept, _ = plain_kept(list(zip(stages[1]["doc_id"], stages[1]["text"], strict=True)))
    assert sorted(stages[2]["doc_id"]) == sorted(kept)


def test_passages_go_from_later_documents(stages):
    before = stages[2].set_index("doc_id")["text"]
    assert set(stages[3]["doc_id"]) <= set(before.index)
    shorter = [i for i, t in zip(stages[3]["doc_id"], stages[3]["text"], strict=True) if t != before[i]]
    for i in shorter:
        own = before[i].encode()
        others = {own[k : k + 50] for k in range(len(own) - 49)}
        assert any(o.encode()[k : k + 50] in others for j, o in before.items() if j < i for k in range(len(o.encode()) - 49))
    assert (stages[3]["n_chars"] == stages[3]["text"].str.len()).all()


def test_mix_takes_whole_copies(spark, stages):
    copies = mixing.mix(spark.createDataFrame(stages[3])).toPandas().set_index("doc_id")["copies"]
    assert stages[4].groupby("doc_id").size().to_dict() == copies[copies > 0].to_dict()


def test_ids_decode(stages):
    assert len(stages[5]) == len(stages[4]) and stages[5]["exact"].all()
    decoder, texts = pieces.Decoder(pieces.Vocabulary.load(pieces.MODEL)), stages[4].drop_duplicates("doc_id").set_index("doc_id")["text"]
    assert all(decoder.decode(list(ids)) == texts[i] for i, ids in zip(stages[5]["doc_id"], stages[5]["ids"], strict=True))


def test_run_equals_the_stages(spark, data, stages):
    got = corpus_pipeline.run(spark, data).toPandas()
    key = lambda d: sorted((i, n, tuple(x)) for i, n, x in zip(d["doc_id"], d["n_tokens"], d["ids"], strict=True))
    assert key(got) == key(stages[5])


def test_odd_rows_pass_through_all_stages(spark, odd, empty):
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "").cache()
            known = {r["doc_id"] for r in docs.select("doc_id").distinct().collect()}
            assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} <= known
            if name == "sentencepiece_ids":
                assert out.count() == docs.count()
            else:
                assert out.columns == docs.columns
                assert bool(out.count()) == bool(docs.count())
                docs = out
