import base64

import numpy as np
import pytest

from rankloom.llm import language_id, quality_rules
from rankloom.llm.textcore import WORD, Words

from .test_mixing import brute_mix
from .test_ngram_join import brute as plain_components
from .test_quality import brute as plain_measures

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns, name
        ids = {r.doc_id for r in after.collect()}
        assert ids <= {r.doc_id for r in before.collect()} and ids
        before = after
    assert corpus_pipeline.STAGES[-1][1](spark, before, SF).count() == before.count()


def test_run_is_repeatable(spark):
    a, b = (sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect()) for _ in range(2))
    assert a == b and a


def test_empty_documents(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("place", range(5))
def test_stages_on_awkward_documents(spark, place):
    from . import cases

    docs = cases.documents(spark, clash=True)
    name, stage = corpus_pipeline.STAGES[place]
    out = stage(spark, docs, SF)
    n = out.count()
    assert place == 4 or out.columns == docs.columns, name
    assert stage(spark, cases.empty(spark), SF).count() == 0
    assert n == 13 if place == 4 else 0 < n <= 39


def test_chain_against_plain_python(spark):
    """Every stage again, document by document, with the stages' fitted models and nothing else of theirs."""
    import public_tokenizers as P
    import tiktoken

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = [tuple(r) for r in docs.collect()]

    rules = quality_rules.fit(docs, labels)
    others, total = rules.others(), int(rules.raw.sum())

    def good(text):
        n, _, _, _, repeated = plain_measures(text)
        words = Words([text or ""]).hashes
        return n >= 50 and 100 * repeated <= 50 * n and rules.score(quality_rules.ngram_buckets(words), quality_rules.fold_of(words), others, total) >= quality_rules.MIN_SCORE

    rows = [r for r in rows if good(r[1])]
    model = language_id.fit(spark.createDataFrame(rows, docs.schema))
    lattice = model.lattice()

    def identified(text):
        if not any(map(str.isalpha, text or "")):
            return False
        logs = sum(model.forward(lattice, ["▁" + w])[0] for w in WORD.findall(text))
        return 1 / np.exp(np.maximum(logs - logs.max(), -700)).sum() >= 0.5

    rows = [r for r in rows if identified(r[1])]
    component = {i: c for i, _, c in plain_components([(r[0], r[1]) for r in rows])}
    rows = [r for r in rows if component[r[0]] == r[0]]
    taken = brute_mix([(r[0], r[3], r[1]) for r in rows])
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in rows:
        ids = encoding.encode_ordinary(r[1])
        want += [(r[0], ids)] * (taken[r[0], r[3], r[1]] // len(WORD.findall(r[1])))
    got = [(r.doc_id, list(r.ids)) for r in corpus_pipeline.run(spark, SF).collect()]
    assert len(want) > 50 and sorted(got) == sorted(want)
