from __future__ import annotations

import random

import corpus_pipeline
import __spark_entry__


def test_stages_keep_columns_and_take_effect(spark, docs, rows):
    at, sizes = docs, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        at = stage(spark, at, "/nowhere")
        if k < 4:
            assert at.columns == docs.columns
        sizes.append(at.count())
    letters = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    assert sizes[1] == len(letters)
    assert sizes[2] == len({r[1] for r in letters})
    assert sizes[3] < sizes[2]
    assert at.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_language_id_rejects_noise_and_keeps_clean_text(spark):
    rng = random.Random(2)
    clean = [(i, " ".join(rng.choice(["the", "cat", "sat", "on", "that", "mat", "with", "hats"]) for _ in range(60)), "en", "a", 1) for i in range(60)]
    noise = [(100 + i, "".join(rng.choice("ЖЗИЙКЛМНОПРСТУФХЦЧШЩ一二三四五六七八九十") for _ in range(80)), None, "a", 1) for i in range(3)]
    docs = spark.createDataFrame([*clean, *noise, (200, "Re.", None, "a", 1), (201, None, "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.identified(spark, docs, "/nowhere")
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {*range(60), 200}


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
