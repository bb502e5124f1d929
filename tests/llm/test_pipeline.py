"""The pipeline's stages against what they are to leave."""

from __future__ import annotations

import re

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark):
    de, fr = "schung einlich ungsch lichein " * 3, "eautre oiment treoi menteau " * 3
    texts = [f"{(de, fr)[i % 2]}{i} a{i}b c{i}d" for i in range(30)]
    shared = " ".join(f"schein{i}" for i in range(60))
    texts += [f"password = hunter2{i} {de} u{i}v " + " ".join(f"ung{i}x{k}" for k in range(90)) + f" {shared}" for i in range(3)]
    texts += [None, "", "123 !!", texts[31]]
    rows = [(i, t, None if not t else ("fr" if "oi" in t else "de"), None, None) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, COLUMNS)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "ngram_join", "suffix_dedup", "secret_scan", "packing"]
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        out[name] = docs.collect()
        if name != "packing":
            assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    assert {r.doc_id for r in out["language_id"]} == {*range(33), 36}
    assert {r.doc_id for r in out["ngram_join"]} == {*range(33)}
    assert {r.doc_id for r in out["suffix_dedup"]} == {*range(33)}
    assert all("schein30" not in r.text and r.n_chars == len(r.text) for r in out["suffix_dedup"] if r.doc_id >= 30)
    assert all(not re.search("hunter2", r.text) for r in out["secret_scan"])
    assert sum("<assign>" in r.text for r in out["secret_scan"]) == 3
    assert {r.doc_id for r in out["packing"]} == {*range(33)}


def test_empty(spark):
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_columns_of_any_name_pass_through(spark):
    """Columns that carry names which steps could use inside survive every stage, with their values."""
    names = ["_id", "_text", "_runs", "_blob", "_spans", "_dk", "score", "lang_pred", "doc", "runs", "spans", "own", "key", "found", "kept", "print", "blob"]
    extra = ", ".join(f"{n} string" for n in names)
    shared = " ".join(f"schein{i}" for i in range(60))
    rows = [(i, f"einlich ungsch a{i}b c{i}d {shared if i < 3 else ''} {' '.join(f'u{i}v{k}' for k in range(90))} token = abcdef{i}", "de" if i % 2 else None, None, None) for i in range(9)]
    docs = spark.createDataFrame([(*r, *(f"{n}{r[0]}" for n in names)) for r in rows], f"{COLUMNS}, {extra}")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert [c for c in docs.columns] == [c.split()[0] for c in f"{COLUMNS}, {extra}".split(", ")]
        got = docs.collect()
        assert len(got) == 9 and all(r[n] == f"{n}{r.doc_id}" for r in got for n in names), name
    assert all(r.lang == "de" for r in got)  # a missing language is written by the first stage
    assert all(("schein30" in r.text) == (r.doc_id >= 99) for r in got)


def test_passages_of_over_50_words_go(spark):
    """The repeat window of the pipeline is shorter than any passage of over 50 words of ordinary length."""
    passage = " ".join(f"wort{i % 7}" for i in range(51))
    rows = [(i, " ".join(f"x{i}y{k}" for k in range(80)) + f" links{i} {passage} {i}rechts " + " ".join(f"z{i}y{k}" for k in range(80)), "de", None, None) for i in range(4)]
    suffix = dict(corpus_pipeline.STAGES)["suffix_dedup"]
    got = suffix(spark, spark.createDataFrame(rows, COLUMNS), "").collect()
    assert all("wort" not in r.text and f" links{r.doc_id}" in r.text and f"{r.doc_id}rechts " in r.text for r in got)


def test_tasks_let_go_of_other_operators_caches():
    """Workers go from stage to stage: what the packing stage's encoder remembers must not stay beside another stage's work."""
    import public_tokenizers

    from farelens.llm import _words, language, ngram_join

    path = public_tokenizers.path("word_bpe_49k.json")
    for task in (language._count, ngram_join._sets, ngram_join._meet):
        kept = _words.encoder(path)
        assert _words.encoder(path) is kept
        list(task(iter(())))
        assert not _words._SHARED
