"""The pipeline against a plain version that shares only the definitions, not the searches."""

import base64
import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken
from llm_cases import SF_SMALL, awkward, clashing, empty
from test_decontaminate import brute as plain_leaks
from test_secret_scan import brute as plain_secrets
from test_simhash import components, plain as plain_fingerprint

import corpus_pipeline
from postlytics.llm import langid
from postlytics.llm.common import crc_mod


def test_run_equals_plain_version(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    model = langid.fit(docs.where(crc_mod("doc_id", 3) != 1))
    preds = {d: [x[0] for x in langid.label_texts([t], model)] for d, t in rows.items()}
    rows = {d: t for d, t in rows.items() if preds[d][0] != "und" and (
        preds[d][1] >= 0.4 or sum(s["end"] - s["start"] for s in preds[d][2] if s["end"] - s["start"] >= 100) >= 0.4 * len(t))}
    least = components({d: plain_fingerprint(t) for d, t in rows.items()})
    rows = {d: t for d, t in rows.items() if least[d] == d}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()}
    leaked = {d for d, _ in plain_leaks(rows, items)}
    rows = {d: t for d, t in rows.items() if d not in leaked}
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for d, t in rows.items():
        out, at = "", 0
        for _, a, b in plain_secrets(t):
            if a >= at:
                out += t[at:a] + "[secret]"
            at = max(at, b)
        t = out + t[at:]
        ids = library.encode_ordinary(t)
        want[d] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest(), ids)
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["ids"])
           for r in corpus_pipeline.run(spark, SF_SMALL).collect()}
    assert got == want and leaked


def test_stages_on_awkward_rows(spark):
    for rows in (clashing(awkward(spark)), awkward(spark), empty(spark)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, rows, SF_SMALL)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.schema.simpleString() == rows.schema.simpleString()
            assert out.count() <= rows.count()


def test_clean_documents_stay(spark):
    rows = [(i, f"the morning of day{i} was bright and nobody{i} had anything{i} to add about matter{i} at all", "en", "s", 1)
            for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        if name != "simhash_near_dedup":  # short texts that differ in few words are near copies there
            assert stage(spark, docs, SF_SMALL).count() == 40, name
