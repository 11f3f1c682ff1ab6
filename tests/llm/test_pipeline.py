"""Every stage against a plain version of it, on its own input."""
import hashlib
import re

import pytest

pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

import corpus_pipeline  # noqa: E402
import public_tokenizers  # noqa: E402
from moodframe.llm.common import written  # noqa: E402
from moodframe.llm.queries import QUERIES  # noqa: E402
from plain_stages import plain_contaminated, plain_lines, plain_quality, plain_simhash_keep  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns = docs.columns
    plain = {"quality_rules": lambda d: [x for x in d if plain_quality(x, d)],
             "line_dedup": lambda d: plain_lines(d),
             "simhash_near_dedup": lambda d: plain_simhash_keep(d),
             "benchmark_decontamination": lambda d: [x for x in d if not plain_contaminated(x[1], bench)]}
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [tuple(r) for r in docs.collect()]
        docs = written(stage(spark, docs, SF), name)
        assert docs.columns == columns
        after = sorted(tuple(r) for r in docs.collect())
        assert after == sorted(plain[name](before)), name
        sizes.append((len(before), len(after), sum(len(x[1]) for x in before) - sum(len(x[1]) for x in after)))
    assert sizes[0][1] < sizes[0][0] and sizes[2][1] < sizes[2][0] and sizes[3][1] < sizes[3][0]    # decisions take effect
    got = {r.doc_id: r for r in corpus_pipeline.tokens(spark, docs, SF).collect()}
    hf = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, text, *_ in (tuple(r) for r in docs.collect()):
        ids = hf.encode(text, add_special_tokens=False).ids
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(hf.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, got.values()))


def test_all_queries_are_registered():
    import __spark_entry__
    names = [k for k in __spark_entry__.queries() if re.fullmatch(r"op\d+_.*", k)]
    assert sorted(int(re.match(r"op(\d+)", k)[1]) for k in names) == list(range(1, 14)) and set(names) == set(QUERIES)
    assert "pipeline" in __spark_entry__.queries()
