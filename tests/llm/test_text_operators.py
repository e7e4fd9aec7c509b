"""Decontamination, language, licences, pseudonyms and mixing against brute force."""

from __future__ import annotations

import collections
import datetime
import hashlib
import hmac
import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from riverloom.llm import common, decontaminate, language, licenses, mixture, pseudonyms


def test_words_are_those_of_the_pattern():
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for t in ["", "A b-c", "Éa ß_x 9z\x7fq\u0080r", "日本 語", "a" * 1000, "\x00\n"]:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
        assert [w.decode() for w in common.split_words(t)] == pattern.findall(lower)
    assert common.split_words(None) == []


# ------------------------------------------------------------- decontamination


def brute_hits(text, items, width=10):
    w = common.split_words(text)
    hit, met = set(), set()
    for item, t in items:
        x = common.split_words(t)
        for k in range(max(1, len(x) - width + 1) if x else 0):
            p = x[k : k + width]
            for at in range(len(w) - len(p) + 1):
                if w[at : at + len(p)] == p:
                    hit.update(range(at, at + len(p)))
                    met.add(item)
    return len(w), len(hit), sorted(met - {None})


def contaminated_corpus(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    items = [(str(k), " ".join(rng.choices(words, k=rng.choice([3, 9, 10, 14, 25])))) for k in range(25)]
    items += [("a", None), ("b", ""), ("10", items[3][1]), ("c", "solo"), ("d", items[5][1])]
    docs = []
    for _ in range(60):
        body = rng.choices([*words, "other", "solo" if rng.random() < 0.1 else "more"], k=rng.randint(0, 80))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(body))
            body[at:at] = (rng.choice(items)[1] or "").split()
        docs.append(" ".join(body))
    docs += [None, "", "...", docs[0], (items[0][1] + " ") * 5, items[4][1].upper().replace(" ", "--")]
    return list(enumerate(docs)), items


@pytest.mark.parametrize("shard,block", [(1_000_000, 8_000_000), (100, 8_000_000), (700, 300), (100, 12)])
def test_hits_are_those_of_a_scan(spark, monkeypatch, shard, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    docs, items = contaminated_corpus()
    items.append((None, "no id here"))
    docs.append((len(docs), "so no id here either"))
    bench = spark.createDataFrame(items, "item_id string, text string")
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in docs], "doc_id long, text string, spans string, n_words int")
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", shard)
    monkeypatch.setattr(decontaminate, "LOCATED", 50)
    got = {r.doc_id: r for r in decontaminate.digest(decontaminate.scan(df, bench)).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        n, hit, met = brute_hits(t, items)
        want = (n, hit, len(met), hashlib.sha256(",".join(met).encode()).hexdigest(), hit > 0)
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated) == want
    assert any(got[i].n_hit and not got[i].n_items for i in got)


def test_removal_takes_the_spans_out(spark):
    passage = " ".join(f"b{k}" for k in range(14))
    rows = [(1, f"Before. {passage.upper()}! After"), (2, "clean text"), (3, None), (4, f"{passage} x {passage}")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, spans int")
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = {r.doc_id: r.text for r in decontaminate.remove(df.drop("spans"), bench).collect()}
    assert got == {1: "Before. \n! After", 2: "clean text", 3: None, 4: "\n x \n"}


def test_long_documents_are_indexed_whole(spark):
    rng = random.Random(3)
    passage = " ".join(f"b{k}" for k in range(10))
    body = " ".join(f"w{rng.randrange(20_000)}" for _ in range(60_000))
    text = f"{body} {passage} {'again ' * 30_000}{passage}"
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    r = decontaminate.digest(decontaminate.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), bench)).first()
    assert (r.n_words, r.n_hit, r.n_items) == (90_020, 20, 1)


def test_empty_benchmark_and_documents(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.digest(decontaminate.scan(docs, none)).first().n_hit == 0
    assert decontaminate.scan(docs.limit(0), none).count() == 0


def test_index_counts_and_locates():
    rng = np.random.default_rng(0)
    for _ in range(30):
        text = np.append(rng.integers(0, 4, rng.integers(1, 60)), 0).astype(np.int32)
        index = decontaminate.FMIndex(text, 4, sample=3)
        for _ in range(10):
            p = rng.integers(1, 4, rng.integers(1, 5)).astype(np.int32)
            low, high = index.search(p, np.array([0]), np.array([len(p)]))
            want = [k for k in range(len(text) - len(p) + 1) if (text[k : k + len(p)] == p).all()]
            assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == want


def test_suffixes_are_sorted_whatever_repeats():
    rng = np.random.default_rng(5)
    for size, symbols in ((1, 1), (2, 1), (50, 1), (300, 2), (500, 40_000_000)):
        text = np.append(rng.integers(1, symbols + 1, size), 0)
        assert decontaminate.suffix_array(text).tolist() == sorted(range(len(text)), key=lambda k: text[k:].tolist())


def test_ranks_count_ones():
    rng = np.random.default_rng(6)
    for n in (0, 1, 63, 64, 65, 1000):
        bits = rng.integers(0, 2, n)
        r = decontaminate.RankBits(bits)
        assert r.rank1(np.arange(n + 1)).tolist() == [int(bits[:k].sum()) for k in range(n + 1)]
        assert r[np.arange(n)].tolist() == bits.astype(bool).tolist() and r.total == bits.sum()


def test_phrases_take_few_bytes():
    """Half a million different words in one block."""
    import pickle

    rows = [(str(k), [b"word%d" % (50 * k + j) for j in range(50)]) for k in range(10_000)]
    assert len(pickle.dumps(decontaminate.Phrases.of(rows, 10))) < 16_000_000


def test_cut_spans_takes_words_out():
    assert decontaminate.cut_spans("One, two; three four.", [(1, 3)]) == "One, \n four."
    assert decontaminate.cut_spans("é a é", [(0, 1), (2, 3)]) == "\n a \n"
    assert decontaminate.cut_spans(None, []) is None


# ------------------------------------------------------------- language


def test_viterbi_finds_the_best_path(monkeypatch):
    monkeypatch.setattr(language, "PIECE", 5)
    rng = np.random.default_rng(0)
    for _ in range(60):
        k = int(rng.integers(2, 5))
        sizes = rng.integers(0, 23, 6)
        score = rng.normal(0, 3, (int(sizes.sum()), k)).astype(np.float32)
        got = language.viterbi(score, sizes, 2.5)
        at = 0
        for n in sizes:
            s, p = score[at : at + n].astype(float), got[at : at + n]
            at += n
            if n:
                v = s[0].copy()
                for row in s[1:]:
                    v = row + np.maximum(v, v.max() - 2.5)
                value = s[np.arange(n), p].sum() - 2.5 * (p[1:] != p[:-1]).sum()
                assert abs(v.max() - value) < 1e-3


def test_held_out_accuracy_and_spans(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    docs = spark.read.parquet(path).select("doc_id", "text", "lang")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    model = language.learn(docs.where(~held))
    found = language.predict(docs.where(held), model).collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.95 * len(found)
    assert all(0 <= r.score <= 1 for r in found)
    two = "the and of to in is for with that by " * 6 + "der und die nicht sch lich ung keit für ein " * 6
    odd = [(1, two), (2, None), (3, "123 !?"), (4, ""), (5, "日本語"), (6, "The and OF")]
    df = spark.createDataFrame([(*r, "zz") for r in odd], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in language.predict(df, model).collect()}
    assert [s.lang for s in got[1].spans] == ["en", "de"] and 0.4 < got[1].score < 0.7
    assert [got[i].lang_pred for i in (2, 3, 4)] == ["und"] * 3 and got[2].score == 0
    assert got[6].lang_pred == "en" and got[5].lang_pred != "und"


def test_nothing_learnt(spark):
    df = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    labelled = spark.createDataFrame([("a", None), (None, "en")], "text string, lang string")
    model = language.learn(labelled)
    assert language.predict(df, model).first().lang_pred == "und"
    assert language.predict(df.limit(0), model).count() == 0


def test_scripts_narrow_languages():
    model = language.Model.fit([("привет мир как дела " * 20, "ru"), ("hello world how are you " * 20, "en")])
    assert (model.scores(["мир", "how"]).argmax(axis=1) == [model.languages.index("ru"), model.languages.index("en")]).all()


def test_every_language_is_fitted_on_different_texts(spark):
    rows = [(f"text {k} of many copies", "aa") for k in range(50) for _ in range(200)]
    rows += [(f"other {k}", "bb") for k in range(500) for _ in range(3)]
    rows += [(f"rare {k}", f"r{k:03d}") for k in range(230)] + [("rare 1", "bb"), (None, "aa"), ("x", None)]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    got = [tuple(r) for r in language.sample(df, "text", "lang").collect()]
    assert len(set(got)) == len(got)
    many = {lang: sum(x == lang for _, x in got) for lang in {x for _, x in got}}
    assert many == {"aa": 50, "bb": 400, **{f"r{k:03d}": 1 for k in range(230)}}
    assert set(got) <= set(rows)
    model, want = language.learn(df), language.Model.fit(got)
    assert model.languages == want.languages and model.scripts == want.scripts
    assert (model.uses == want.uses).all() and (model.table == want.table).all()


def test_a_rare_language_of_few_texts_is_learnt(spark):
    rows = [(f"mot {k} français {k * 7}", "fr") for k in range(900)] + [(f"wort {k % 3} deutsch", "de") for k in range(15_000)] + [("12 34", "xx")]
    model = language.learn(spark.createDataFrame(rows, "text string, lang string"))
    assert model.languages == ["de", "fr", "xx"]


def letter_runs(word):
    text = f"\n{word}\n"
    return [(n, text[i : i + n]) for i in range(len(word) + 1) for n in range(1, 5) if i + n <= len(text) and text[i : i + n] != "\n"]


def test_word_scores_are_those_of_a_plain_computation():
    texts = {"en": "The cat and the dog, the hat", "de": "Der Hund und die Katze der Hut", "ru": "кот и собака"}
    model = language.Model.fit([(t, lang) for lang, t in texts.items()])
    words = ["the", "hund", "кот", "zzz", "собака", "日本", "a"]
    got = model.scores(words)
    counts = {}
    for lang, t in texts.items():
        found = [r for w in re.findall(r"[^\W\d_]+", t.lower()) for r in letter_runs(w)]
        counts[lang] = collections.Counter(found)
    script = {"en": "Latin", "de": "Latin", "ru": "Cyrillic"}
    for row, w in zip(got, words, strict=True):
        own = {"кот": "Cyrillic", "собака": "Cyrillic", "日本": "Han"}.get(w, "Latin")
        want = []
        for lang in model.languages:
            total = {n: sum(c for (m, _), c in counts[lang].items() if m == n) for n in range(1, 5)}
            s = sum(np.log((counts[lang][r] + language.SMOOTHING) / (total[r[0]] + language.SMOOTHING * language.BUCKETS)) / 4 for r in letter_runs(w))
            want.append(s - (0 if script[lang] == own else language.FOREIGN))
        want = np.array(want) - max(want) if own != "Han" else np.zeros(3)
        assert np.allclose(row, want, atol=1e-3), w


def test_long_and_repeated_texts(spark):
    model = language.Model.fit([("the cat and the dog", "en"), ("der hund und die katze", "de")])
    long = "the dog and the cat " * 100_000
    df = spark.createDataFrame([(1, long), (2, "der hund"), (2, "der hund"), (3, long + "die katze")], "doc_id long, text string")
    got = sorted((r.doc_id, r.lang_pred, round(r.score, 4)) for r in language.predict(df, model, keep_text=False, spans=False).collect())
    assert [g[:2] for g in got] == [(1, "en"), (2, "de"), (2, "de"), (3, "en")] and got[0][2] == 1.0


@pytest.mark.parametrize("languages", [4, 40, 200])
def test_memory_of_a_long_text_is_bounded(languages):
    """A million words: the pass itself takes less than 100 MB, whatever the number of languages."""
    rng = np.random.default_rng(0)
    score = rng.normal(0, 3, (1000, languages)).astype(np.float32)
    n = 1_000_000 if languages < 8 else 60_000
    word = rng.integers(0, 1000, n)
    tracemalloc.start()
    language.viterbi(score, np.array([n]), 8.0, word)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100 * n


def test_many_languages_take_one_pass_with_the_same_result(monkeypatch):
    rng = np.random.default_rng(1)
    sizes = np.array([0, 7, 700, 1, 0, 300])
    score = rng.normal(0, 3, (int(sizes.sum()), 6)).astype(np.float32)
    want = language.viterbi(score, sizes, 5.0)
    monkeypatch.setattr(language, "PIECE_LANGUAGES", 5)
    assert (language.viterbi(score, sizes, 5.0) == want).all()
    model = language.Model.fit([("the cat and the dog", "en"), *((f"w{k}", f"x{k}") for k in range(220))])
    assert len(model.languages) == 221
    (path, *_), (none, *_) = language.Tagger(model).paths(["the dog and the cat " * 50, None])
    assert {model.languages[k] for k in path} == {"en"} and not len(none)


def test_every_script_is_evidence(spark):
    learnt = {"en": "hello world how are you", "gu": "ગુજરાતી ભાષા છે", "kn": "ಕನ್ನಡ ಭಾಷೆ", "my": "မြန်မာ ဘာသာ", "am": "አማርኛ ቋንቋ ነው", "bo": "བོད་སྐད་ ཡིག", "km": "ភាសា ខ្មែរ", "ff": "𞤆𞤵𞤤𞤢𞤪 𞤬𞤵𞤤𞤬𞤵𞤤𞤣𞤫"}
    model = language.Model.fit([(t * 5, lang) for lang, t in learnt.items()])
    odd = {"日本語": 0.0, "привет мир": 0.0, "hello мирмир": 5 / 11, "ʻhello ʻworld": 1.0}
    df = spark.createDataFrame([(t,) for t in [*learnt.values(), *odd]], "text string")
    got = {r.text: (r.lang_pred, r.score) for r in language.predict(df, model).collect()}
    assert {t: got[t] for t in learnt.values()} == {t: (lang, 1.0) for lang, t in learnt.items()}
    assert {t: got[t][1] for t in odd} == odd and got["ʻhello ʻworld"][0] == "en"
    one = language.Model.fit([("hello world", "en")])
    assert [r.score for r in language.predict(df.where("text = '日本語'"), one).collect()] == [0.0]
    assert {language.script_of(w) for w in ("日", "ひ", "ア", "ｱ", "ａ", "한", "ʻ", "𠀀", "豈")} == {"Han", "Kana", "Latin", "Hangul", ""}


# ------------------------------------------------------------- licences


def test_licenses_match_whatever_their_spelling(spark):
    mit = licenses.NOTICES["MIT"]
    british = mit.replace("sublicense", "Sub-Licence").upper()
    rows = [
        (1, "Copyright (c) 2020 A. Person\n\n" + mit),
        (2, "  " + british + "  © 1999, 2001 B\n"),
        (3, mit + " and more"),
        (4, None),
        (5, ""),
        (6, "released under the mit licence"),
        (7, "Copyright notice of a kind"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string")
    got = {r.doc_id: r.license for r in licenses.scan(df, licenses.known_licenses(spark)).collect()}
    assert got == {1: "MIT", 2: None, 3: None, 4: None, 5: None, 6: "MIT-notice", 7: None}
    same = spark.createDataFrame([(1, british)], "doc_id long, text string")
    assert licenses.scan(same, licenses.known_licenses(spark)).first().license == "MIT"
    assert licenses.scan(df, licenses.known_licenses(spark), most_broadcast=1).count() == len(rows)
    assert licenses.scan(df.limit(0), licenses.known_licenses(spark)).count() == 0


def test_long_and_repeated_texts_are_looked_up_whole(spark):
    mit = licenses.NOTICES["MIT"]
    rows = [(1, mit), (1, mit), (2, mit + " more" * 300_000), (3, "word " * 400_000), (4, "!" * 100_000)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), licenses.known_licenses(spark)).collect()
    assert sorted((r.doc_id, r.license) for r in got if r.license) == [(1, "MIT")] * 2 and len(got) == 5


def test_licenses_equal_their_sql_where_they_are_found(spark, tmp_path):
    import duckdb

    from riverloom.llm import oracles, queries

    known = licenses.known_texts()
    rows = [(k, f"Copyright (c) {1990 + k % 30} Someone\n\n{t.upper() if k % 3 else t}") for k, (_, t) in enumerate(known)]
    rows += [(1000 + k, t + " and more") for k, (_, t) in enumerate(known[:20])] + [(2000, None), (2001, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(f"select doc_id, canon_sha256, license from ({oracles.oracle_sql()['op8_licenses']})").fetchall()
    got = [(r.doc_id, r.canon_sha256, r.license) for r in queries.queries()["op8_licenses"](spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert {n for i, _, n in got if i < 1000} == {n for n, _ in known} and not any(n for i, _, n in got if i >= 1000)


def test_license_files_with_their_titles_and_full_texts(spark):
    long = {f.stem: f.read_text() for f in licenses.FOLDER.glob("*.txt")}
    line = "\n\nCopyright (c) 2020 A. Person\n"
    want = [(n, t) for n, t in long.items()]
    want += [(n, title + line + "\n" + licenses.NOTICES[n]) for n, x in licenses.TITLES.items() if n in licenses.NOTICES for title in x]
    want += [("BSD-3-Clause", "BSD 3-Clause License" + line + "All rights reserved.\n\n" + long["BSD-3-Clause"].split("reserved.")[1].replace("* Re", "1. Re", 1).replace("* Re", "2. Re", 1).replace("* N", "3. N"))]
    want += [("MIT", "MIT License" + line + "All rights reserved.\n" + licenses.NOTICES["MIT"]), ("Unlicense", "The Unlicense\n\n" + long["Unlicense"])]
    want += [("Apache-2.0", long["Apache-2.0"].split("APPENDIX")[0]), ("GPL-2.0", long["GPL-2.0"].split("How to Apply")[0]), (None, long["GPL-3.0"][:-400])]
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(want)], "doc_id long, text string")
    got = {r.doc_id: r.license for r in licenses.scan(df, licenses.known_licenses(spark)).collect()}
    assert [got[k] for k in range(len(want))] == [n for n, _ in want] and len(long) >= 16


# ------------------------------------------------------------- pseudonyms

KEY = "k"


def keyed(kind, turn, half):
    return hmac.new(KEY.encode(), f"{kind}|{turn}|{half}".encode(), "sha256").hexdigest()


def shift(half, other, turn, alphabet, kind):
    text = "".join(keyed(kind, turn * 100 + i, other) for i in range((len(half) - 1) // 16 + 1))
    return "".join(alphabet[(alphabet.index(c) + int(text[4 * i : 4 * i + 4], 16)) % len(alphabet)] for i, c in enumerate(half))


def feistel(digits, kind, alphabet=pseudonyms.DIGITS):
    n = len(digits) // 2
    left, right = digits[:n], digits[n:]
    for turn in range(1, pseudonyms.ROUNDS + 1):
        if turn % 2:
            right = shift(right, left, turn, alphabet, kind) if right else right
        else:
            left = shift(left, right, turn, alphabet, kind) if left else left
    return left + right


def luhn(d):
    total = sum(int(c) if k % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for k, c in enumerate(reversed(d)))
    return total % 10


def pseudonymised(spark, texts, **extra):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kinds string")
    return [(r.text, r.n_pseudonyms, r.kinds) for r in pseudonyms.pseudonymise(df, KEY).orderBy("doc_id").collect()]


def test_pseudonyms_of_valid_values_only(spark):
    keep = ["1.2.3 and 300.1.1.1", "9807915762804490", "1981-02-29", "000-12-3456", "v1.2.3.4.5", "DE00 3704 0044 0532 0130 00", "12345", "a@b", "", "plain"]
    got = pseudonymised(spark, [*keep, None])
    assert got == [(t, 0, []) for t in keep] + [(None, 0, [])]


def valid_ssn(d):
    return not (d[:3] in ("000", "666") or d[0] == "9" or d[3:5] == "00" or d[5:] == "0000")


def north_american(d):
    return bool(re.fullmatch("[2-9][0-9]{2}[2-9][0-9]{6}", d))


def walked(value, kind, valid):
    now = feistel(value, kind)
    while valid(now) != valid(value):
        now = feistel(now, kind)
    return now


def mail_of(x):
    head, last = x.lower().rsplit(".", 1)
    new = iter(feistel(re.sub("[^a-z0-9]", "", head), "email", pseudonyms.LOWER))
    return "".join(next(new) if c in pseudonyms.LOWER else c for c in head) + f".{last}.invalid"


def test_pseudonyms_equal_the_plain_computation(spark):
    text = "x 4845168114407329, 4845-1681-1440-7329 +1 (017) 555-7713 10.0.0.1 123-45-6789 a.B@c.example.com end"
    ((out, n, kinds),) = pseudonymised(spark, [text])
    card = "4" + feistel("84516811440732"[:14], "card")
    card += str((10 - luhn(card + "0")) % 10)
    phone = walked("0175557713", "phone", north_american)
    bits = feistel("0a000001", "ip", pseudonyms.HEX)
    ip = ".".join(str(int(bits[k : k + 2], 16)) for k in (0, 2, 4, 6))
    ssn = walked("123456789", "ssn", valid_ssn)
    groups = "-".join(card[k : k + 4] for k in (0, 4, 8, 12))
    want = f"x {card}, {groups} +1 ({phone[:3]}) {phone[3:6]}-{phone[6:]} {ip} {ssn[:3]}-{ssn[3:5]}-{ssn[5:]} {mail_of('a.b@c.example.com')} end"
    assert out == want and n == 6 and kinds == ["card", "email", "ip", "phone", "ssn"]
    assert luhn(card) == 0


def test_phones_are_linked_whatever_their_spelling(spark):
    same = ["+1 415 555 2671", "+14155552671", "+1 (415) 555-2671", "(415) 555-2671", "415-555-2671", "415.555.2671", "(415)555-2671"]
    got = pseudonymised(spark, [*same, "+49 30 1234567", "+49301234567", "+351 21 123 4567", "+351211234567", "x415-555-2671", "415-555-2671-3"])
    digits = [re.sub("[^0-9]", "", t) for t, _, _ in got]
    phone = walked("4155552671", "phone", north_american)
    assert digits[:7] == ["1" + phone] * 3 + [phone] * 4 and north_american(phone)
    assert digits[7] == digits[8] == "49" + walked("301234567", "phone", lambda _: False)
    assert digits[9] == digits[10] == "351" + walked("211234567", "phone", lambda _: False)
    assert [n for _, n, _ in got] == [1] * 11 + [0] * 2


def test_social_security_numbers_stay_valid(spark):
    rng = random.Random(1)
    drawn = (f"{rng.randrange(10**9):09d}" for _ in range(400))
    values = sorted({d for d in drawn if valid_ssn(d)})
    got = [re.sub("-", "", t) for t, _, _ in pseudonymised(spark, [f"{d[:3]}-{d[3:5]}-{d[5:]}" for d in values])]
    assert got == [walked(d, "ssn", valid_ssn) for d in values] and all(map(valid_ssn, got)) and len(set(got)) == len(values)


def test_addresses_of_any_length(spark):
    long, longer = "a" * 70 + "@b.example.com", "A" * 3000 + "@b.example.com"
    got = pseudonymised(spark, [long, longer, "Mail Q.X@Y.ORG, q.x@y.org!"])
    assert got[0][0] == mail_of(long) and len(got[0][0]) == len(long) + 8
    assert got[1][0] == f"u{keyed('email', 0, longer.lower())}@example.invalid"
    assert got[2][0] == f"Mail {mail_of('q.x@y.org')}, {mail_of('q.x@y.org')}!" and got[2][1] == 2


def test_the_key_is_in_no_plan(spark):
    df = spark.createDataFrame([("call +14155552671",)], "text string")
    out = pseudonyms.pseudonymise(df, "a very secret key")
    plan = out._jdf.queryExecution().toString()
    inner = pseudonyms.pads("a very secret key")[0]
    assert out.first().n_pseudonyms == 1 and "__key" in plan
    assert "a very secret key" not in plan and inner.hex() not in plan.lower() and inner.decode("latin1") not in plan
    assert pseudonyms.pseudonymise(df, "other").first().text != out.first().text
    assert pseudonyms.pseudonymise(df.limit(0), "k").count() == 0


def day_of(date):
    a, b = pseudonyms.DAYS
    left, right = divmod((date - datetime.date(1900, 1, 1)).days, b)
    for turn in range(1, pseudonyms.ROUNDS + 1):
        if turn % 2:
            right = (right + int(keyed("date", turn, str(left))[:12], 16)) % b
        else:
            left = (left + int(keyed("date", turn, str(right))[:12], 16)) % a
    return datetime.date(1900, 1, 1) + datetime.timedelta(days=left * b + right)


def test_pseudonyms_of_dates_are_a_permutation(spark):
    first = datetime.date(1900, 1, 1)
    days = [first + datetime.timedelta(days=k) for k in range(0, 73049, 61)]
    got = [r[0] for r in pseudonymised(spark, [d.isoformat() for d in days])]
    found = [datetime.date.fromisoformat(x) for x in got]
    assert found == [day_of(d) for d in days] and len(set(found)) == len(days)
    assert len({day_of(first + datetime.timedelta(days=k)) for k in range(73049)}) == 73049
    assert [r[0] for r in pseudonymised(spark, [days[5].strftime("%d.%m.%Y"), days[5].strftime("%Y/%m/%d")])] == [found[5].strftime("%d.%m.%Y"), found[5].strftime("%Y/%m/%d")]


def iban_of(flat):
    account = flat[4:]
    new = iter(feistel(re.sub("[^0-9]", "", account), "iban"))
    account = "".join(next(new) if c.isdigit() else c for c in account)
    rest = int("".join(str(int(c, 36)) for c in account + flat[:2] + "00")) % 97
    return f"{flat[:2]}{98 - rest:02d}{account}"


def test_ibans_stay_valid_and_equal_values_stay_linked(spark):
    values = ["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "FR14 2004 1010 0505 0001 3M02 606", "MT84 MALT 0110 0001 2345 MTLC AST0 01S", "NO93 8601 1117 947"]
    got = pseudonymised(spark, [*values, *(f"to {v.replace(' ', '')} NOW 12" for v in values), *(f"PAY {v} THIS AB12" for v in values)])
    n = len(values)
    for k, v in enumerate(values):
        want = iban_of(v.replace(" ", ""))
        spaced, flat, amid = got[k][0], got[n + k][0], got[2 * n + k][0]
        assert (spaced.replace(" ", ""), flat, amid) == (want, f"to {want} NOW 12", f"PAY {spaced} THIS AB12"), v
        assert [len(g) for g in spaced.split(" ")] == [len(g) for g in v.split(" ")]
        assert int("".join(str(int(c, 36)) for c in want[4:] + want[:4])) % 97 == 1


def test_values_beside_others_are_found(spark):
    ((out, n, kinds),) = pseudonymised(spark, ["7536784127813050 4845168114407329 35 +1 (017) 555-7713 35 10.0.0.1 7"])
    assert n == 4 and kinds == ["card", "ip", "phone"] and re.match(r"7\d{15} 4\d{15} ", out) and " 35 +1 (" in out and out.endswith(" 7")


def test_short_digit_strings_are_permuted(spark):
    for n in (1, 2, 3):
        values = [str(k).zfill(n) for k in range(10**n)]
        df = pseudonyms.with_key(spark.createDataFrame([(v,) for v in values], "d string"), KEY)
        got = [r[0] for r in df.select(pseudonyms.feistel(F.col("d"), F.col("__key"), "t")).collect()]
        assert sorted(got) == values


def test_long_texts_are_scanned_whole(spark):
    text = "a.b-c " * 40_000 + "4845168114407329" + " 7" * 40_000 + " x" * 1000
    ((out, n, _),) = pseudonymised(spark, [text])
    assert n >= 1 and "4845168114407329" not in out and len(out) == len(text)


# ------------------------------------------------------------- mixing


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, out, free = float(sum(sizes.values())), {}, set(names)
    while free:
        left = total - sum(out.values())
        level = left / sum(w[s] for s in free)
        over = {s for s in free if w[s] * level > cap * sizes[s]}
        if not over:
            out |= {s: w[s] * level for s in free}
            break
        out |= {s: cap * sizes[s] for s in over}
        free -= over
    return out


def documents(seed=0, n=600):
    rng = random.Random(seed)
    names = ["b", "a", "Z", "é", None, "hot", "tiny", "empty"]
    rows = []
    for k in range(n):
        s = "hot" if rng.random() < 0.4 else rng.choice(names[:5])
        rows.append((k, s, " ".join(["w"] * rng.choice([0, 1, 5, 40, 300]))))
    rows += [(n, "tiny", "one two"), (n + 1, "empty", None), (n + 2, "empty", " \t\n"), (3, "a", "x y z"), (3, "a", "x y z"), (None, "b", "q")]
    return rows


@pytest.mark.parametrize("shard", [1_000_000, 2000])
def test_mix_comes_near_its_targets(spark, shard):
    rows = documents()
    df = spark.createDataFrame([(*r, 7.0) for r in rows], "doc_id long, source string, text string, target double")
    got = mixture.mix(df, block=8, shard=shard).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 3 * r.size
    want = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
    for s, t in taken.items():
        assert abs(t - want[s]) <= 8 + 0.02 * want[s], (s, t, want[s])
    again = mixture.mix(df.repartition(5), block=8, shard=shard).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def race(votes, seats):
    won = [0] * len(votes)
    for _ in range(seats):
        k = max(range(len(votes)), key=lambda k: (votes[k] / (2 * won[k] + 1), -k))
        won[k] += 1
    return won


def brute_mix(rows, shard, seed=17, block=mixture.BLOCK):
    """(taken of each row) from (source, hash, id, size) rows by the definition."""
    sizes = {}
    for s, _, _, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    target = brute_targets(sizes)
    names = sorted(sizes, key=lambda s: (s is not None, [ord(c) for c in s or ""]))  # Spark's order: null first
    block = max(1, min(block, int(min(t for t in target.values() if t > 0) // mixture.LEAST_BLOCKS)))
    blocks = race([target[s] for s in names], round(sum(target.values()) / block))
    taken = [0] * len(rows)
    for s, quota in zip(names, blocks, strict=True):
        count = max(1, -(-sizes[s] // shard))
        own = {}
        for k, (source, h, i, n) in enumerate(rows):
            if source == s:
                own.setdefault(h % count, []).append((h, i is not None, i or 0, n, k))
        parts = sorted(own)
        tokens = [sum(x[3] for x in own[p]) for p in parts]
        for p, total, won in zip(parts, tokens, race(tokens, quota) if sum(tokens) else [0] * len(parts), strict=True):
            left = min(won * block, 3 * total)
            rounds = left // total if total else 0
            rest = left - rounds * total
            for *_, n, k in sorted(own[p]):
                part = min(n, rest)
                taken[k] = rounds * n + part
                rest -= part
    return taken


@pytest.mark.parametrize("shard", [1_000_000, 9000])
def test_mix_takes_what_the_definition_says(spark, shard):
    rows = [(s if s != "tiny" else "b", i, t) for i, s, t in documents(5)]
    rows += [(s, None, t) for s, _, t in rows[:200]]  # a third without an id
    df = spark.createDataFrame([(i, s, t) for s, i, t in rows], "doc_id long, source string, text string")
    got = mixture.mix(df.withColumn("h", mixture.row_hash(df, 17)), shard=shard)
    hashed = df.withColumn("h", mixture.row_hash(df, 17))
    hashed = hashed.withColumn("g", mixture.row_hash(hashed, 17)).select("source", "g", "doc_id", mixture.n_words("text").alias("n"), "h").collect()
    want = brute_mix([tuple(r)[:4] for r in hashed], shard)
    found = sorted((r.source or "", r.doc_id or -1, r.h, r.size, r.taken) for r in got.collect())
    assert found == sorted((r.source or "", r.doc_id or -1, r.h, r.n, t) for r, t in zip(hashed, want, strict=True))


def test_small_sources_get_their_target(spark):
    rows = [(k, "a", "w " * 1000) for k in range(50)] + [(90, "b", "one two three four"), (91, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.source: (r.target, r.taken) for r in mixture.mix(df).groupBy("source").agg(F.min("target").alias("target"), F.sum("taken").alias("taken")).collect()}
    assert got["b"] == (12.0, 12) and got[None] == (3.0, 3) and abs(got["a"][0] - got["a"][1]) <= 1


def test_mix_spreads_rows_without_ids_and_reads_long_texts(spark):
    rows = [(None, "a", f"w{k} " * 40) for k in range(300)] + [(7, "a", f"v{k} " * 40) for k in range(300)] + [(8, "b", "long " * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    spread = df.where("source = 'a'").select(F.pmod(mixture.row_hash(df, 17), F.lit(10)).alias("s")).groupBy("s").count().collect()
    assert len(spread) == 10 and max(r["count"] for r in spread) < 120
    assert mixture.mix(df, shard=5000).where("doc_id = 8").first().size == 300_000


def test_mix_of_nothing_and_of_empty_texts(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, "")], "doc_id long, source string, text string")
    assert [(r.size, r.target, r.taken) for r in mixture.mix(df).collect()] == [(0, 0.0, 0)] * 2
    assert mixture.mix(df.limit(0)).count() == 0
    assert mixture.copies(mixture.mix(df)).count() == 0


def test_quotas_are_those_of_the_race(spark):
    rng = random.Random(4)
    for n, seats in ((1, 5), (4, 0), (7, 23), (40, 300)):
        votes = [rng.choice([0, 1, 3, 50, 1000, 999.5]) for _ in range(n)]
        if not any(votes):
            votes[0] = 1
        won = [0] * n
        for _ in range(seats):
            k = max(range(n), key=lambda k: (votes[k] / (2 * won[k] + 1), -k))
            won[k] += 1
        df = spark.createDataFrame([(k, float(v), seats) for k, v in enumerate(votes)], "p long, v double, s long")
        got = {r.p: r.won for r in mixture.sainte_lague(df, "v", "s", ["p"]).collect()}
        assert [got[k] for k in range(n)] == won
