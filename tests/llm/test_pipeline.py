"""The pipeline's stages on a small corpus, each against what it promises."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from riverloom.llm import common, language, minhash, mixture
from riverloom.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus(spark):
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*COLUMNS)
    odd = spark.createDataFrame(
        [(10_001, None, "en", "src0", 0), (10_002, "12 34 !!", None, None, 8), (10_003, "", "fr", "src1", 0), (3, None, "en", "src0", 0)],
        base.schema,
    )
    return base.unionByName(odd).unionByName(base.where("doc_id < 5"))


def test_stages_keep_their_promises(spark):
    sf = "/root/testdata/sf0.001"
    docs = corpus(spark)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_duplicates", "decontamination", "source_mix", "token_output"]
    stages = dict(corpus_pipeline.STAGES)
    first = common.written(stages["language_id"](spark, docs, sf), "s1")
    assert first.columns == COLUMNS
    kept = {r.doc_id for r in first.select("doc_id").collect()}
    assert not kept & {10_001, 10_002, 10_003} and len(kept) >= 0.97 * docs.select("doc_id").distinct().count() - 3
    second = common.written(stages["near_duplicates"](spark, first, sf), "s2")
    classes = {r.doc_id: r.class_id for r in minhash.near_duplicates(first).collect()}
    assert sorted(r.doc_id for r in second.collect()) == sorted({c for c in classes.values()})
    third = common.written(stages["decontamination"](spark, second, sf), "s3")
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    grams = {tuple(w[k : k + 10]) for w in map(common.split_words, items) for k in range(max(1, len(w) - 9))}

    def clean(t):
        w = common.split_words(t)
        return not any(tuple(w[k : k + 10]) in grams for k in range(len(w)))

    assert sorted(r.doc_id for r in third.collect()) == sorted(r.doc_id for r in second.collect() if clean(r.text))
    fourth = common.written(stages["source_mix"](spark, third, sf), "s4")
    assert fourth.columns == COLUMNS
    texts = {r.doc_id: r.text for r in third.collect()}
    counts = {}
    for r in fourth.collect():
        assert texts[r.doc_id] == r.text
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert max(counts.values()) <= 3
    last = stages["token_output"](spark, fourth, sf).collect()
    assert len(last) == sum(counts.values())
    assert sorted(r.start for r in last)[0] == 0 and sum(r.n_tokens for r in last) == max(r.start + r.n_tokens for r in last)


def test_other_columns_and_long_texts_pass(spark):
    sf = "/root/testdata/sf0.001"
    names = ["score", "spans", "lang_pred", "n_words", "items", "size", "target", "taken", "digest", "component", "uid", "h", "shard"]
    docs = corpus(spark).limit(60)
    long = docs.where("text is not null").orderBy("doc_id").limit(1).withColumn("doc_id", F.lit(77_777).cast("long"))
    docs = docs.unionByName(long.withColumn("text", F.repeat(F.concat("text", F.lit(" ")), 3000)))
    docs = docs.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf), f"more-{name}")
        assert docs.columns == [*COLUMNS, *names], name
    rows = docs.collect()
    assert all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names) and any(r.doc_id == 77_777 for r in rows)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == len(rows)


def test_no_documents(spark):
    docs = corpus(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, "/root/testdata/sf0.001"), f"empty-{name}")
        assert docs.count() == 0


def plain_language(model, text):
    """(language, share of letters) by going through the words one after another."""
    words = language.words_of(text)
    if not words:
        return "und", 0.0
    score = model.scores(words).astype(float)
    value, came = score[0], []
    for row in score[1:]:
        stay = value >= value.max() - language.SWITCH
        came.append(np.where(stay, np.arange(len(value)), value.argmax()))
        value = np.where(stay, value, value.max() - language.SWITCH) + row
    path = [int(value.argmax())]
    for c in reversed(came):
        path.append(int(c[path[-1]]))
    letters = [0] * len(model.languages)
    for k, w, sure in zip(reversed(path), words, model.fits(words).any(axis=1), strict=True):
        letters[k] += len(w) * bool(sure)
    best = max(range(len(letters)), key=lambda k: (letters[k], -k))
    return model.languages[best], letters[best] / sum(map(len, words))


def test_a_run_equals_a_plain_computation(spark, tmp_path):
    from test_pair_operators import similarity, union
    from test_text_operators import brute_mix
    from tokenizers import Tokenizer

    docs = corpus(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [tuple(r) for r in docs.collect()]
    model = language.Model.fit(sorted({(r[1], r[2]) for r in rows if r[1] is not None and r[2] is not None}))
    told = [(r, *plain_language(model, r[1])) for r in rows]
    rows = [r for r, lang, share in told if lang != "und" and share >= corpus_pipeline.LEAST_SCORE]
    # near-duplicates: of each class the smallest id, and once
    texts = sorted({r[:2] for r in rows})
    links = [(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and similarity(a[1], b[1]) >= 0.8]
    classes = union(range(len(texts)), links)
    firsts = {texts[c] for c in classes.values()}
    rows = sorted({r for r in rows if r[:2] in firsts})
    grams = {tuple(w[k : k + 10]) for w in map(common.split_words, (r.text for r in bench.collect())) for k in range(max(1, len(w) - 9))}
    words = {r: common.split_words(r[1]) for r in rows}
    rows = [r for r in rows if not any(tuple(words[r][k : k + 10]) in grams for k in range(len(words[r])))]
    kept = spark.createDataFrame(rows, docs.schema)
    hashed = kept.withColumn("g", mixture.row_hash(kept, 17)).withColumn("n", mixture.n_words("text")).withColumn("t", F.xxhash64("text")).collect()
    taken = brute_mix([(r.source, r.g, r.doc_id, r.n) for r in hashed], mixture.SHARD)
    library = Tokenizer.from_file(tokenizer_path())
    want, start = [], 0
    for r, n in sorted(zip(hashed, taken, strict=True), key=lambda x: (x[0].doc_id, x[0].t)):
        for _ in range(int(n / r.n + 0.5) if r.n else 0):
            ids = [*library.encode(r.text, add_special_tokens=False).ids, 2]
            want.append((r.doc_id, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
            start += len(ids)
    got = sorted((tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=lambda r: r[1])
    assert got == want and len(want) > 100
