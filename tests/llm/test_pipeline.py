import hashlib
from collections import Counter

import corpus_pipeline
from latticework.llm import bpe, langid

from .test_operators import brute_groups, brute_lines, plain_targets, words_of


def test_pipeline(spark, folder, rows):
    """run() against the stages done one after the other in plain Python."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    filters = langid.train_on_documents(docs)
    kept = []
    for r in rows:
        lang, score = filters.predict(r[1])
        if lang != "und" and (score >= langid.MIN_SCORE or len(r[1]) < langid.MIN_CHARS):
            kept.append(r)
    kept = [(k[0], k[4], None, k[1], None) for k in brute_lines(kept, 2).elements()]
    roots = brute_groups([r[1] for r in kept], [r[0] for r in kept])
    stay = {r[0]: r for r, c in zip(kept, roots, strict=True) if r[0] == c and r[0] is not None}
    nulls = [r for r, c in zip(kept, roots, strict=True) if r[0] is None and c is None]
    stay = [*stay.values(), *nulls[:1]]

    out = corpus_pipeline.run(spark, folder).collect()
    encoder = bpe.codec(bpe.default_ranks(), bpe.default_pattern())[0]
    texts = {r[0]: r[1] for r in stay}
    counts = Counter(r.doc_id for r in out)
    assert set(counts) <= set(texts) and max(counts.values()) <= 2
    for r in out:
        ids = encoder.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())

    # Each source's words come near its target: whole documents at its end make the difference.
    names = sorted({r[3] for r in stay}, key=lambda s: (s is None, s or ""))
    size = {s: [len(words_of(r[1])) for r in stay if r[3] == s] for s in names}
    for s, target in zip(names, plain_targets([sum(size[s]) for s in names]), strict=True):
        taken = sum(counts[r[0]] * len(words_of(r[1])) for r in stay if r[3] == s)
        assert abs(taken - target) <= max(size[s]) / 2 + 1


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        extra = [c for c in docs.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
        # Columns that operators might use themselves come through as they were.
        assert out.count() > 0 and all(set(r) == {"x"} for r in out.select(*[f"`{c}`" for c in extra]).distinct().collect())


def test_stages_on_odd_rows(spark, folder):
    """Nulls, blanks, ties, repeated rows and a source's only document, stage by stage."""
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    text = "the same words of one and the same text " * 3
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, text, "en", "a", 2), (None, text, None, None, None), (3, None, "en", "a", None), (4, "", "en", None, 0), (5, " \n", None, "b", 3), (6, "only line here", "en", "z", 14)]
    docs = spark.createDataFrame(rows, columns)
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in df.collect())
    assert {r.doc_id for r in stages["language_id"](spark, docs, folder).collect()} == {1, 2, 6, None}
    lines = {r.doc_id: (r.text, r.n_chars) for r in stages["line_dedup"](spark, docs, folder).collect()}
    # Three of a's four documents share their only line; others are alone on their sources.
    assert lines == {1: ("", 0), 2: ("", 0), None: (text, None), 3: (None, None), 4: ("", 0), 5: (" \n", 3), 6: ("only line here", 14)}
    assert [x[1] for x in ids(stages["simhash_near_dedup"](spark, docs.where("text IS NOT NULL AND text NOT IN ('', ' \n')"), folder))] == [1, 6]
    assert [r.doc_id for r in stages["simhash_near_dedup"](spark, docs.where("text IS NULL OR trim(text, ' \n') = ''"), folder).collect()] == [3]
    mixed = stages["mix_sources"](spark, docs, folder).collect()
    assert {r.doc_id for r in mixed} <= {1, 2, 6, None} and all(r.text and r.text.strip() for r in mixed)
    assert stages["bpe_tokens"](spark, docs, folder).count() == len(rows)
    nothing = docs.limit(0)
    assert all(stage(spark, nothing, folder).count() == 0 for stage in stages.values())


def test_pipeline_of_nothing(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0
