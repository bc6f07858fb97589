import random
import zlib

import corpus_pipeline as P
import numpy as np
import public_tokenizers
from test_exact_dedup import lower
from test_jaccard_join import brute
from tokenizers import Tokenizer

from shardloom.llm import language_id as L
from shardloom.llm import secrets as S


def test_rows_match_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rng = random.Random(1)
    extra = [(10_000 + i, t, "en", "src0", len(t or "")) for i, t in enumerate(["", None, "12 34", "THE same", "the SAME", "password=abcdefghij the", *[" ".join(rng.choice("abcd") for _ in range(3000))] * 2])]
    docs.union(spark.createDataFrame(extra, docs.schema)).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = L.fit_on(docs)
    rows = sorted([(r.doc_id, r.text) for r in docs.collect() if model.predict(r.text)[1] >= L.LEAST])
    last = {lower(t): i for i, t in rows}
    rows = [(i, t) for i, t in rows if last[lower(t)] == i]
    _, label = brute([t for _, t in rows])
    rows = [(i, S.redact(t, S.find_secrets(t))) for k, (i, t) in enumerate(rows) if label[k] == k]
    lib, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {}
    for i, t in rows:
        ids = lib.encode(t, add_special_tokens=False).ids + [0]
        for p, s in enumerate(range(0, len(ids), 2048)):
            own = np.array(ids[s : s + 2048], "<u4").tobytes()
            want[i, p] = (s, len(own) // 4, zlib.crc32(own))
    got = P.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    assert 10_005 in {i for i, _ in want} and not {10_000, 10_001, 10_002, 10_003} & {i for i, _ in want}


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(30)
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, sf).dtypes == docs.dtypes
