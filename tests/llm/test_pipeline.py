"""The pipeline's result against brute-force versions of its stages."""

import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from quillon.llm import line_crf
from quillon.llm.common import read_table
from test_native import plain_spans
from test_quality_rules import plain
from test_similar import plain_groups
from tokenizers import Tokenizer


def test_run_against_plain_stages(spark, sf_dir):
    labels = read_table(spark, sf_dir, "labels")
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    table = read_table(spark, sf_dir, "documents")
    docs = {r.doc_id: r.text for r in table.collect()}
    model = line_crf.train(table, labels)
    docs = {d: t for d, t in docs.items() if line_crf.score_texts(model, [t or ""])[0] >= 0.7}
    kept = {r[0] for r in plain(sorted(docs.items()), good) if r[-2]}
    docs = {d: t for d, t in docs.items() if d in kept}
    root = plain_groups(docs)
    docs = {d: t for d, t in docs.items() if root[d] == d}
    for d, t in docs.items():
        at, out = 0, ""
        for a, _, b in plain_spans(t)[1]:
            if a >= at:
                out += t[at:a] + "[SECRET]"
            at = max(at, b)
        docs[d] = out + t[at:]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(docs)
    for d, t in docs.items():
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        mine = [r for r in rows if r.doc_id == d]
        assert sum(r.length for r in mine) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in mine)
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append(r.length)
    assert max(map(sum, used.values())) <= 1024
    assert len(used) <= -(-sum(r.length for r in rows) // 1024) * 1.02 + 1


def test_stages_keep_the_columns_and_clean_documents(spark, docs, sf_dir):
    clean = ["The harbour was quiet when the ferry came in, " * 1 + " ".join(f"word{k}{j}" for j in range(60)) + "." for k in range(5)]
    frame = docs([*clean, clean[0], None, "token=abcdefghijklmnop " + clean[1]], "1 as score")
    frame = frame.withColumnRenamed("score", "kept")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, sf_dir)
        assert out.columns == frame.columns
        assert stage(spark, frame.limit(0), sf_dir).count() == 0
    masked = {r.doc_id: r for r in corpus_pipeline.mask_secrets(spark, frame, sf_dir).collect()}
    assert masked[7].text.startswith("[SECRET] The") and masked[7].n_chars == len(masked[7].text)
    assert {d: r.text for d, r in masked.items() if d < 5} == dict(enumerate(clean))
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, frame, sf_dir).collect()}
    assert kept >= {0, 1, 2, 3, 4, 6} and 5 not in kept
    assert [re.sub(r"\W", "", n) for n, _ in corpus_pipeline.STAGES] == ["qualityclassifier", "qualityrules", "simhashneardedup", "secretscans", "bestfitpacking"]
