"""The pipeline stage by stage on a small corpus with planted cases."""

import random

import corpus_pipeline
from linkloom.llm import bpe, pii
from linkloom.llm.common import vocabulary_path
from tests.llm.test_spark import BENCH, WORDS, prose

BAD = ["idiot", "stupid", "moron", "worthless"]


def test_pipeline(spark, tmp_path):
    r = random.Random(2)
    texts = {k: prose(40, 900 + k) for k in range(240)}
    toxic = set(range(0, 240, 5))
    for k in toxic:
        texts[k] += " " + " ".join(r.sample(BAD, 2))
    texts[241] = texts[1]
    texts[242] = texts[2].replace(texts[2].split()[9], r.choice(WORDS), 1)
    texts[243] = prose(20, 1) + " " + BENCH[0][1] + " " + prose(5, 77)
    texts[244] = "mail me at a.b@c.example.org please"
    texts[245] = None
    sf = str(tmp_path)
    spark.createDataFrame([(k, t, "en", "s", 1, "extra") for k, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long, more string").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k in toxic)) for k in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "minhash_near_dedup", "benchmark_decontamination", "pii", "bpe"]
    out = {row["doc_id"]: row for row in corpus_pipeline.run(spark, sf).collect()}
    assert set(out) == set(texts) - toxic - {241, 242}
    model, w = bpe.BPE(vocabulary_path()), pii.train()
    for k in out:
        t = texts[k]
        if k == 243:
            t = prose(20, 1) + " \n " + prose(5, 77) if BENCH[0][1][-1].isalnum() else None
        if k == 243 and t is None:
            assert not set(BENCH[0][1].split()[:3]) <= set((out[k]["decoded"] or "").replace("</w>", "").split())
            continue
        want = model.encode(pii.mask(t, pii.find_spans(t, w)[1]))
        assert list(out[k]["ids"]) == want and out[k]["decoded"] == model.decode(want)
    assert "email" in out[244]["decoded"].replace(" ", "")
