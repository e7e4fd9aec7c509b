"""Language identification of whole texts, with the spans of mixed-language ones.

A word's script narrows the languages it can be in. Its score in each is a smoothed log-likelihood of its letters in
runs of one to four, word ends included, learnt from labelled texts. A Viterbi pass over the words of a text then finds
the best sequence of languages when each change costs a fixed penalty. Its runs are the spans; the language with most
letters is the text's, and its share of the letters the score.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riverloom.llm import common

#: Texts per language that a model is fitted on.
SAMPLE_TEXTS = 400
#: Buckets of the letter-run table.
BUCKETS = 1 << 16
ORDERS = 4
SMOOTHING = 0.1
#: Cost of a change of language between two words, in nats.
SWITCH = 8.0
#: What a word of a script that a language does not use costs it.
FOREIGN = 20.0
#: A language uses a script that holds at least this share of its letters.
SCRIPT_SHARE = 0.01
#: Words that a worker keeps scores of, words of a batch, and words of a Viterbi piece.
CACHE_WORDS, BATCH_WORDS, PIECE = 250_000, 200_000, 256
#: Scores that a worker keeps or computes at once: with many languages it keeps fewer words.
SCORES = 8_000_000
#: Parts that a language's texts are ranked in, parts that its sample is counted in, and chosen texts that are
#: broadcast, 24 bytes each; more are shuffled.
PARTS, COUNT_PARTS, MOST_CHOSEN = 16, 4, 500_000
#: With more languages than this, texts are not cut into pieces: a piece takes a byte for each pair of languages a word.
PIECE_LANGUAGES = 8

#: First and last code points of scripts, from the Unicode blocks. Letters elsewhere are named after theirs.
SCRIPTS = [
    (0x0041, 0x024F, "Latin"),
    (0x0370, 0x03FF, "Greek"),
    (0x0400, 0x052F, "Cyrillic"),
    (0x0530, 0x058F, "Armenian"),
    (0x0590, 0x05FF, "Hebrew"),
    (0x0600, 0x077F, "Arabic"),
    (0x0900, 0x097F, "Devanagari"),
    (0x0980, 0x09FF, "Bengali"),
    (0x0B80, 0x0BFF, "Tamil"),
    (0x0C00, 0x0C7F, "Telugu"),
    (0x0E00, 0x0E7F, "Thai"),
    (0x10A0, 0x10FF, "Georgian"),
    (0x1100, 0x11FF, "Hangul"),
    (0x1E00, 0x1EFF, "Latin"),
    (0x1F00, 0x1FFF, "Greek"),
    (0x3040, 0x309F, "Kana"),
    (0x30A0, 0x30FF, "Kana"),
    (0x3400, 0x4DBF, "Han"),
    (0x4E00, 0x9FFF, "Han"),
    (0xAC00, 0xD7AF, "Hangul"),
]
_FIRST = [a for a, _, _ in SCRIPTS]
#: First words of the names of letters that stand in words of any script, and words before a script's name.
_SHARED, _FORMS = {"MODIFIER", "MASCULINE", "FEMININE", "MICRO"}, ("FULLWIDTH ", "HALFWIDTH ", "OLD ", "NEW ", "CJK ")

LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


@cache
def script_of_letter(letter: str) -> str:
    """The script of a letter: that of the ranges, else the first word of its Unicode name; empty for shared letters."""
    c = ord(letter)
    k = bisect_right(_FIRST, c) - 1
    if k >= 0 and c <= SCRIPTS[k][1]:
        return SCRIPTS[k][2]
    name = unicodedata.name(letter, "unnamed")
    for form in _FORMS:
        name = name.removeprefix(form)
    first = name.split()[0].split("-")[0]
    alike = {"HIRAGANA": "Kana", "KATAKANA": "Kana", "UNIFIED": "Han", "COMPATIBILITY": "Han"}
    return "" if first in _SHARED else alike.get(first, first.capitalize())


def script_of(word: str) -> str:
    """The script of a word's first letter that has one, empty where none has."""
    return script_of_letter(word[0]) or next(filter(None, map(script_of_letter, word)), "")


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def letter_runs(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ORDERS, positions) buckets of the runs that begin at each letter or word end, -1 for none; words' first positions."""
    text = "\n" + "\n".join(words) + "\n"
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.flatnonzero(c == 10)
    first = ends[:-1]
    n = int(ends[-1])  # the last end begins no run
    inner = np.zeros(len(c) + ORDERS, np.int64)
    inner[: len(c)] = np.cumsum(c == 10)
    out = np.full((ORDERS, n), -1, np.int64)
    padded = np.concatenate([c, np.zeros(ORDERS, np.uint64)])
    h = np.zeros(n, np.uint64)
    at = np.arange(n)
    for k in range(ORDERS):
        h = h * np.uint64(0x100000001B3) + padded[at + k] + np.uint64(1)
        x = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        bucket = ((x >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64)
        # ends strictly inside the run: after its first character and before its last
        crossing = inner[np.minimum(at + k - 1, len(c) - 1)] - inner[at] if k >= 2 else 0
        valid = (crossing == 0) & (at + k < len(c))
        if k == 0:
            valid &= c[:n] != 10
        out[k, valid] = bucket[valid]
    return out, first


class Counts:
    """Letter runs and letters by script of a language's texts."""

    def __init__(self):
        self.runs = np.zeros((ORDERS, BUCKETS), np.int64)
        self.scripts: dict[str, int] = {}

    def add(self, text: str) -> None:
        words = words_of(text)
        for a in range(0, len(words), 50_000):
            runs, _ = letter_runs(words[a : a + 50_000])
            for n in range(ORDERS):
                self.runs[n] += np.bincount(runs[n][runs[n] >= 0], minlength=BUCKETS)
        for w in words:
            if s := script_of(w):
                self.scripts[s] = self.scripts.get(s, 0) + len(w)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (ORDERS, BUCKETS + 1, languages); the last bucket is for no run
    scripts: dict[str, int]  # the numbers of the scripts of the texts learnt from
    uses: np.ndarray  # (scripts, languages)

    @classmethod
    def fit(cls, rows: list[tuple[str, str]]) -> Model:
        """From (text, language) rows."""
        counts: dict[str, Counts] = {}
        for text, lang in rows:
            counts.setdefault(lang, Counts()).add(text)
        return cls.of(counts)

    @classmethod
    def of(cls, counts: dict[str, Counts]) -> Model:
        languages = sorted(counts)
        table = np.zeros((ORDERS, BUCKETS + 1, len(languages)), np.float32)
        scripts: dict[str, np.ndarray] = {}
        for k, lang in enumerate(languages):
            runs = counts[lang].runs
            share = np.log((runs + SMOOTHING) / (runs.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS))
            table[:, :BUCKETS, k] = share / ORDERS
            for s, n in sorted(counts[lang].scripts.items()):
                scripts.setdefault(s, np.zeros(len(languages)))[k] += n
        letters = np.array(list(scripts.values())).reshape(len(scripts), len(languages))
        uses = letters >= SCRIPT_SHARE * np.maximum(letters.sum(axis=0), 1)
        return cls(languages, table, {s: k for k, s in enumerate(scripts)}, uses)

    def fits(self, words: list[str]) -> np.ndarray:
        """(words, languages): whether a language uses a word's script; all do where a word has none."""
        uses = np.concatenate([self.uses, np.zeros((1, len(self.languages)), bool), np.ones((1, len(self.languages)), bool)])
        foreign, none = len(self.scripts), len(self.scripts) + 1
        script = (self.scripts.get(s, foreign) if s else none for s in map(script_of, words))
        return uses[np.fromiter(script, np.int64, len(words))]

    def scores(self, words: list[str]) -> np.ndarray:
        """(words, languages): log-likelihoods less the best one of each word; zeros where no language uses its script."""
        step = max(64, min(50_000, SCORES // (16 * max(1, len(self.languages)))))
        parts = [self._scores(words[a : a + step]) for a in range(0, len(words), step)]
        return np.concatenate([*parts, np.zeros((0, len(self.languages)), np.float32)])

    def _scores(self, words: list[str]) -> np.ndarray:
        runs, first = letter_runs(words)
        per = np.zeros((runs.shape[1], len(self.languages)), np.float32)
        for n in range(ORDERS):
            per += self.table[n][runs[n]]  # -1 is the last bucket
        out = np.add.reduceat(per, first, axis=0)
        fits = self.fits(words)
        some = fits.any(axis=1)
        out[some] -= np.where(fits[some], 0, FOREIGN).astype(np.float32)
        out[~some] = 0
        return out - out.max(axis=1, keepdims=True)


class Tagger:
    """A model with the scores of words met before."""

    def __init__(self, model: Model):
        self.model = model
        k = max(1, len(model.languages))
        self.batch_words = max(20_000, min(BATCH_WORDS, 4 * SCORES // k))
        self.cache_words = min(CACHE_WORDS, SCORES // k)
        self.known = _Numbers()
        self.score = np.zeros((0, len(model.languages)), np.float32)
        self.letters = np.zeros(0, np.int64)
        self.evidence = np.zeros(0, np.int64)  # letters of words whose script a language uses

    def forget(self) -> None:
        """The half of the words that was met first stays: it holds the frequent ones."""
        self.known = _Numbers(islice(self.known.items(), self.cache_words // 2))
        self.score = self.score[: len(self.known)].copy()
        self.letters = self.letters[: len(self.known)].copy()
        self.evidence = self.evidence[: len(self.known)].copy()

    def paths(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(language numbers, letters, letters that are evidence) of the words of each text."""
        if not self.model.languages:
            return iter([(np.zeros(0, np.int64),) * 3 for _ in texts])
        if len(self.known) > self.cache_words:
            self.forget()
        number = self.known.__getitem__
        ids = [np.fromiter(map(number, words_of(t)), np.int64) for t in texts]
        if fresh := self.known.fresh:
            self.known.fresh = []
            self.score = np.concatenate([self.score, self.model.scores(fresh)])
            self.letters = np.concatenate([self.letters, np.fromiter(map(len, fresh), np.int64, len(fresh))])
            sure = self.model.fits(fresh).any(axis=1)
            self.evidence = np.concatenate([self.evidence, self.letters[len(self.evidence) :] * sure])
        flat = np.concatenate([*ids, np.zeros(0, np.int64)])
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        path = viterbi(self.score, sizes, SWITCH, flat)
        cut = np.cumsum(sizes)[:-1]
        columns = (path, self.letters[flat], self.evidence[flat])
        return zip(*(np.split(x, cut) for x in columns), strict=True) if len(ids) else iter(())


class _Numbers(dict):
    def __init__(self, known=()):
        super().__init__(known)
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


def viterbi(score: np.ndarray, sizes: np.ndarray, penalty: float, word: np.ndarray | None = None) -> np.ndarray:
    """The best language of every word of texts laid end to end; ``word`` gives the row of ``score`` of each.

    Texts are cut into pieces of PIECE words, and every piece is solved for every language that may stand before it;
    a text's pieces are then joined one after another. The result is that of one pass over each text, but all pieces
    of a batch advance together. With more than PIECE_LANGUAGES languages each text is gone through in one pass. A word
    takes 64 bytes at most in the first case, and languages / 8 + 26 in the second, besides the scores of the different
    words.
    """
    k = score.shape[1]
    word = np.arange(len(score)) if word is None else word
    path = np.zeros(len(word), np.int64)
    if not len(word) or k < 2:
        return path
    if k > PIECE_LANGUAGES:
        return _whole(score, sizes, penalty, word)
    start = np.cumsum(sizes) - sizes
    count = -(-sizes // PIECE)
    text = np.repeat(np.arange(len(sizes)), count)
    number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    begin = start[text] + number * PIECE
    length = np.minimum(PIECE, sizes[text] - number * PIECE)
    order = np.argsort(-length, kind="stable")
    begin, length, opening = begin[order], length[order], number[order] == 0
    slot = np.empty(len(order), np.int64)
    slot[order] = np.arange(len(order))
    active = np.searchsorted(-length, -np.arange(int(length.max())), side="left")  # pieces longer than t
    back = np.zeros((len(word), k, k), np.int8)
    v = score[word[begin]][:, None, :] - np.where(np.eye(k, dtype=bool), 0, penalty).astype(np.float32)[None]
    v[opening] = score[word[begin[opening]]][:, None, :]
    own = np.arange(k)
    for t in range(1, len(active)):
        m = active[t]
        now = v[:m]
        best = now.argmax(axis=2)
        change = np.take_along_axis(now, best[..., None], 2) - np.float32(penalty)
        stay = now >= change
        back[begin[:m] + t] = np.where(stay, own, best[..., None])
        v[:m] = np.where(stay, now, change) + score[word[begin[:m] + t]][:, None, :]
    entry, leave = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    some = np.flatnonzero(count > 0)
    some = some[np.argsort(-count[some], kind="stable")]
    first = (np.cumsum(count) - count)[some]
    total = v[slot[first], 0].astype(np.float64)
    links = []
    for j in range(1, int(count.max())):
        m = int((count[some] > j).sum())
        joined = total[:m, :, None] + v[slot[first[:m] + j]]
        links.append(joined.argmax(axis=1))
        total[:m] = np.take_along_axis(joined, links[-1][:, None, :], 1)[:, 0]
    at = total.argmax(axis=1)
    for j in range(int(count.max()) - 1, -1, -1):
        m = int((count[some] > j).sum())
        here = slot[first[:m] + j]
        leave[here] = at[:m]
        if j:
            at[:m] = links[j - 1][np.arange(m), at[:m]]
            entry[here] = at[:m]
    for t in range(len(active) - 1, -1, -1):
        m = active[t]
        where = begin[:m] + t
        path[where] = leave[:m]
        if t:
            leave[:m] = back[where, entry[:m], leave[:m]]
    return path


def _whole(score: np.ndarray, sizes: np.ndarray, penalty: float, word: np.ndarray) -> np.ndarray:
    """The same in one pass over each text: a word needs a bit for each language, not a byte for each pair of them."""
    order = np.argsort(-sizes, kind="stable")
    begin, length = (np.cumsum(sizes) - sizes)[order], sizes[order]
    active = np.searchsorted(-length, -np.arange(int(length.max())), side="left")  # texts longer than t
    k = score.shape[1]
    stay, best = np.zeros((len(word), -(-k // 8)), np.uint8), np.zeros(len(word), np.int16)
    v = score[word[begin[: active[0]]]]
    for t in range(1, len(active)):
        m = active[t]
        now = v[:m] - v[:m].max(axis=1, keepdims=True)
        where = begin[:m] + t
        best[where] = now.argmax(axis=1)
        stay[where] = np.packbits(now >= -penalty, axis=1)
        v[:m] = np.maximum(now, -np.float32(penalty)) + score[word[where]]
    path = np.zeros(len(word), np.int64)
    at = v.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        m = active[t]
        where = begin[:m] + t
        path[where] = at[:m]
        own = (stay[where, at[:m] // 8] >> (7 - at[:m] % 8)) & 1
        at[:m] = np.where(own == 1, at[:m], best[where])
    return path


def sample(labelled: DataFrame, text_col: str, lang_col: str, texts: int = SAMPLE_TEXTS) -> DataFrame:
    """(text, lang): at most ``texts`` different texts of each language, those with the smallest hashes; all where fewer.

    Copies of a text count once for a language. Hashes of the different texts are shuffled and ranked in PARTS parts of
    each language, then what is left over all parts, so no task ranks most of a language. The chosen hashes are
    broadcast where they are few, which is checked.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where("lang is not null and text is not null")
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("g", F.xxhash64(F.lit(1), "text"))
    key = ["lang", "h", "g"]
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("h", "g"))
    chosen = rows.select(*key).distinct().withColumn("part", F.pmod("g", F.lit(PARTS)))
    chosen = chosen.withColumn("n", rank("lang", "part")).where(F.col("n") <= texts)
    chosen = chosen.withColumn("n", rank("lang")).where(F.col("n") <= texts)
    chosen = common.written(chosen.select(*key), "chosen")
    if chosen.limit(MOST_CHOSEN + 1).count() <= MOST_CHOSEN:
        chosen = F.broadcast(chosen)
    found = rows.join(chosen, key, "left_semi").groupBy(*key).agg(F.min("text").alias("text"))
    return found.select("text", "lang")


COUNTED = "lang string, kind int, bucket int, script string, n long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's texts by language; kind is the length of a run, or 0 for letters of a script."""
    counts: dict[str, Counts] = {}

    def rows(lang: str, c: Counts) -> pa.RecordBatch:
        kind, bucket = np.nonzero(c.runs)
        n = c.runs[kind, bucket]
        scripts = {None: 0, **c.scripts}  # a language whose texts have no letters is one, too
        some = len(scripts)
        return pa.RecordBatch.from_pydict(
            {
                "lang": pa.array([lang] * (len(n) + some), pa.string()),
                "kind": pa.array(np.concatenate([kind + 1, np.zeros(some, np.int64)]), pa.int32()),
                "bucket": pa.array(np.concatenate([bucket, np.zeros(some, np.int64)]), pa.int32()),
                "script": pa.array([None] * len(n) + list(scripts), pa.string()),
                "n": pa.array(np.concatenate([n, np.fromiter(scripts.values(), np.int64, some)]), pa.int64()),
            }
        )

    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for a, texts in common.text_slices(batch.column("text"), 4_000_000):
            for lang, text in zip(langs[a : a + len(texts)], texts, strict=True):
                counts.setdefault(lang, Counts()).add(text)
            if len(counts) > 32:  # 2 MB each
                yield from (rows(*x) for x in counts.items())
                counts.clear()
    yield from (rows(*x) for x in counts.items())
    counts.clear()
    common.release()


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", texts: int = SAMPLE_TEXTS) -> Model:
    """A model of every language that is not null, fitted on the texts of ``sample``.

    Texts stay on the executors, whatever their length; the driver gets the sums of their counts, at most about 260,000
    numbers a language, which is also the size of the model.
    """
    with common.Scratch(labelled.sparkSession):
        # few tasks count a language, so that the numbers of its runs come from few of them
        dealt = sample(labelled, text_col, lang_col, texts).repartition("lang", F.pmod(F.xxhash64("text"), F.lit(COUNT_PARTS)))
        found = dealt.mapInArrow(_count, COUNTED)
        total = found.groupBy("lang", "kind", "bucket", "script").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, Counts] = {}
    columns = [total.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "bucket", "n")]
    names, scripts = total.column("lang").to_pylist(), total.column("script").to_pylist()
    for lang, script, kind, bucket, n in zip(names, scripts, *columns, strict=True):
        own = counts.setdefault(lang, Counts())
        if kind:
            own.runs[kind - 1, bucket] = n
        elif script is not None:
            own.scripts[script] = int(n)
    return Model.of(counts)


PREDICTED = "lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))


def predict(docs: DataFrame, model: Model, *, text_col: str = "text", keep_text: bool = True, spans: bool = True) -> DataFrame:
    """``docs`` with lang_pred, score and the spans [start, end) of words in one language.

    The score is the language's share of all letters. A word of a script that no learnt language uses counts for none:
    a text of such words only has score 0. A null or empty text, one without letters, and any text where nothing was
    learnt are ``und`` with score 0 and no spans. Ties go to the language whose name sorts first. Rows that repeat are
    judged alike, and an empty table gives an empty one. A text of any length is read whole: it takes about 100 bytes a
    word, and four for each language for each different word. Columns of ``docs`` named like new ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score", "spans")
    fields = [f for f in docs.schema.fields if keep_text or f.name != text_col]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [PREDICTED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        languages = shared.value.languages
        for batch in batches:
            columns = [batch.column(f.name) for f in fields]
            for a, texts in common.text_slices(batch.column(text_col), tagger.batch_words * 6):
                pred, share, runs = [], [], []
                for path, letters, evidence in tagger.paths(texts):
                    if not len(path) or not languages:
                        pred.append(UNKNOWN), share.append(0.0), runs.append([])
                        continue
                    by = np.bincount(path, evidence, len(languages))
                    pred.append(languages[int(by.argmax())])
                    share.append(float(by.max() / letters.sum()))
                    runs.append(_runs(path, languages) if spans else [])
                yield pa.RecordBatch.from_arrays(
                    [c.slice(a, len(texts)) for c in columns] + [pa.array(pred, pa.string()), pa.array(share, pa.float64()), pa.array(runs, _SPANS)],
                    [f.name for f in fields] + ["lang_pred", "score", "spans"],
                )
        del tagger
        common.release()

    return docs.mapInArrow(run, schema)


def _runs(path: np.ndarray, languages: list[str]) -> list[dict]:
    edge = np.concatenate([[0], np.flatnonzero(path[1:] != path[:-1]) + 1, [len(path)]])
    return [{"start": int(a), "end": int(b), "lang": languages[path[a]]} for a, b in zip(edge[:-1], edge[1:], strict=True)]
