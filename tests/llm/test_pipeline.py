from __future__ import annotations

import hashlib
import random

from tokenizers import Tokenizer

import corpus_pipeline
from dealweave.llm import byte_bpe, quality
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_simhash import brute_components, brute_fingerprint


def texts_and_items():
    rng = random.Random(12)
    pool = "the house of all these people was under water when light from that river came over it and then some".split()
    pool += [w + e for w in ("work", "look", "call", "form") for e in ("", "s", "ed", "ing", "er")]

    def prose(n):
        return " ".join(rng.choice(pool) for _ in range(n))

    items = [(i, prose(20)) for i in range(4)]
    texts = [None, "", "short text", "again and again " * 60]
    texts += ["Cookie notice\n" + prose(120) + "\n cookie NOTICE " for _ in range(12)]
    base = prose(400)
    texts += [base, base, base + " tail", prose(60) + " " + items[1][1] + " " + prose(30), prose(900) + " " + items[2][1]]
    return texts, items


def test_pipeline_equals_brute_force(spark, tmp_path):
    texts, items = texts_and_items()
    folder = str(tmp_path)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 5) for i, t in enumerate(texts)],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint, fp int")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    kept = {r.doc_id: r.text for r in quality.verdicts(quality.measures(docs)).where("kept").collect()}
    assert {4, 16, 17, 18, 19, 20} <= kept.keys() and not {0, 1, 2, 3} & kept.keys()
    ids = sorted(kept)
    lines = dict(zip(ids, [x[2] for x in brute_lines([kept[i] for i in ids], 10)], strict=True))
    assert "ookie" not in lines[4]
    label = brute_components([brute_fingerprint(lines[i]) for i in ids])
    single = [i for n, i in enumerate(ids) if label[n] == n]
    assert 17 not in single
    clean = []
    for i in single:
        n_words, n_hit, _ = brute_hits(lines[i], items)
        if not (n_hit and 20 * n_hit >= n_words):
            clean.append(i)
    assert 19 not in clean and 20 in clean
    library = Tokenizer.from_file(byte_bpe.VOCABULARY)
    library.no_truncation()
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted(r.doc_id for r in got) == clean
    for r in got:
        assert r.token_ids == library.encode(lines[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(r.token_ids) and r.n_chars == len(lines[r.doc_id])
        assert r.decoded_sha256 == hashlib.sha256(lines[r.doc_id].encode()).hexdigest()


def test_stages_keep_the_columns_of_documents_and_take_empty_tables(spark, tmp_path):
    texts, items = texts_and_items()
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, texts[4], "en", "s", 3)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for rows in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, rows, str(tmp_path))
            assert rows.columns == docs.columns
        assert corpus_pipeline.encode(spark, rows, "").count() == rows.count()
