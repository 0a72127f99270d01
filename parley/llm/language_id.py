"""Language of whole texts, word by word.

The script of a word leaves the languages that were seen in that script. Each remaining language scores the word by
its character n-grams (naive Bayes over hashed n-grams, bounded per word), and Viterbi with a penalty for every switch
labels the spans. The language with the most letters is the document's.

Cases: a text that is null or has no letter is `und` with score 0. Words in a script that no learned language uses are
neutral; a text of such words alone gets the most frequent learned language with score 0. Ties go to the more frequent
language. Without training rows every text is `und`. Repeated rows get equal results. Other columns are not read.
"""

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.memory import give_back
from parley.operators.topn import first_per_group

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
TRAIN_ROWS = 800  # sampled rows per language
SWITCH = 8.0
FLOOR = -6.0
CHUNK = 1_500_000
CACHE_WORDS = 100_000
LETTERS = re.compile(r"[^\W\d_]+")

# First and last code point of the letter ranges of common scripts.
SCRIPTS = (
    ("latin", 0x0041, 0x024F),
    ("greek", 0x0370, 0x03FF),
    ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x077F),
    ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF),
    ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF),
    ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x1F00, 0x1FFF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
)
NAMES = sorted({s for s, _, _ in SCRIPTS}) + ["other"]
_LOW = np.array([a for _, a, _ in SCRIPTS])
_HIGH = np.array([b for _, _, b in SCRIPTS])
_ID = np.array([NAMES.index(s) for s, _, _ in SCRIPTS])


def scripts(code: np.ndarray) -> np.ndarray:
    """Index into NAMES of each code point."""
    at = np.maximum(np.searchsorted(_LOW, code, "right") - 1, 0)
    inside = (code >= _LOW[at]) & (code <= _HIGH[at])
    return np.where(inside, _ID[at], len(NAMES) - 1)


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, index of the word) of every n-gram, and the script of every word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    code = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), sizes)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]) + 1
    buckets, owners = [], []
    for n in ORDERS:
        mixed = np.full(max(len(code) - n + 1, 0), n, np.uint64)
        for k in range(n):
            mixed = (mixed ^ code[k : len(code) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        same = word[: len(mixed)] == word[n - 1 :]
        buckets.append((mixed[same] >> np.uint64(20)) % np.uint64(BUCKETS))
        owners.append(word[: len(mixed)][same])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners), scripts(code[first].astype(np.int64))


def _count(batches):
    for pdf in batches:
        for lang, texts in pdf.groupby("lang")["text"]:
            seen: dict[str, int] = {}
            for text in texts:
                for w in LETTERS.findall((text or "").lower()):
                    seen[w] = seen.get(w, 0) + 1
            if not seen:
                continue
            weight = np.fromiter(seen.values(), np.int64, len(seen))
            bucket, word, script = ngrams(list(seen))
            count = np.bincount(bucket, weight[word], BUCKETS)
            at = np.flatnonzero(count)
            by_script = np.bincount(script, weight, len(NAMES))
            more = np.flatnonzero(by_script)
            yield pd.DataFrame(
                {
                    "lang": lang,
                    "bucket": np.concatenate([at, BUCKETS + more]),
                    "n": np.concatenate([count[at], by_script[more]]).astype(np.int64),
                }
            )


class Model:
    """Log probabilities per bucket and language, and the languages that each script allows."""

    def __init__(self, langs: list[str], counts: np.ndarray, by_script: np.ndarray):
        self.langs = langs
        rate = counts + 0.1
        self.log = np.log(rate / rate.sum(0)).astype(np.float32) if langs else np.zeros((BUCKETS, 0), np.float32)
        # A script is allowed where it makes up one word in a hundred of a language.
        self.allowed = by_script >= 0.01 * np.maximum(by_script.sum(0), 1)

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bounded scores per word and language (0 for the best), and whether the word says anything."""
        bucket, word, script = ngrams(words)
        rows = self.log[bucket]
        total = np.stack([np.bincount(word, rows[:, k], len(words)) for k in range(len(self.langs))], 1) / len(ORDERS)
        allowed = self.allowed[script]
        known = allowed.any(1)
        total = np.where(allowed | ~known[:, None], total, -np.inf)
        total = np.maximum(total - total.max(1, keepdims=True), FLOOR)
        total[~known] = 0
        return total, known


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Model from doc_id, text and lang; at most `rows` documents per language are read, chosen by hash of the id."""
    able = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = first_per_group(able.select("doc_id", "lang"), ["lang"], order, rows).select("doc_id", "lang").distinct()
    sample = able.join(F.broadcast(chosen), ["doc_id", "lang"])  # `rows` ids per language
    sums = sample.mapInPandas(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # At most BUCKETS rows per language.
    table = sums.toPandas()
    size = table[table["bucket"] >= BUCKETS].groupby("lang")["n"].sum()
    langs = sorted(size.index, key=lambda x: (-size[x], x))
    counts = np.zeros((BUCKETS + len(NAMES), len(langs)))
    counts[table["bucket"], table["lang"].map({x: k for k, x in enumerate(langs)}).astype(int)] = table["n"]
    return Model(langs, counts[:BUCKETS], counts[BUCKETS:])


class _Words:
    """Scores of the words seen lately by this worker: row numbers by word. Row 0 stands for a word without letters."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        # Room for a full cache and one chunk of new words.
        self.row: dict[str, int] = {}
        self.used = 1
        self.score = np.zeros((2 * CACHE_WORDS, len(self.model.langs)), np.float32)
        self.letters, self.known = np.zeros(2 * CACHE_WORDS, np.int32), np.zeros(2 * CACHE_WORDS, bool)

    def rows(self, words: list[str]) -> np.ndarray:
        new = list(set(words).difference(self.row))
        if self.used + len(new) > len(self.letters):
            self.clear()
            new = list(set(words))
            more = 1 + len(new) - len(self.letters)
            if more > 0:  # one very long text
                self.score = np.zeros((1 + len(new), self.score.shape[1]), np.float32)
                self.letters, self.known = np.zeros(1 + len(new), np.int32), np.zeros(1 + len(new), bool)
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            score, known = self.model.score(part)
            at = slice(self.used, self.used + len(part))
            self.score[at], self.known[at] = score, known
            self.letters[at] = [sum(map(str.isalpha, w)) for w in part]
            self.row.update((w, self.used + i if self.letters[self.used + i] else 0) for i, w in enumerate(part))
            self.used += len(part)
        return np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))


def viterbi(score: np.ndarray, sizes: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of every word; score holds the words of all texts one after another, sizes their number per text."""
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    order = np.argsort(-sizes, kind="stable")
    start, sizes = start[order], sizes[order]
    steps = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(steps), "left")
    best = np.zeros((len(sizes), score.shape[1]))
    back: list[tuple[np.ndarray, np.ndarray]] = []
    for t in range(steps):
        n = active[t]
        now = best[:n]
        if t:
            top = now.argmax(1)
            jump = now[np.arange(n), top][:, None] - switch
            moved = now < jump
            back.append((moved, top))
            now = np.where(moved, jump, now)
        best[:n] = now + score[start[:n] + t]
    label = np.zeros(len(score), np.int64)
    state = best.argmax(1)
    for t in range(steps - 1, -1, -1):
        n = active[t]
        label[start[:n] + t] = state[:n]
        if t:
            moved, top = back[t - 1]
            state[:n] = np.where(moved[np.arange(n), state[:n]], top, state[:n])
    return label


RESULT = "lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>"


def label_texts(words: _Words, texts: list[str], spans: bool):
    """(language, score, spans) of each text."""
    langs = words.model.langs
    found: list[str] = []
    sizes = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        own = LETTERS.findall(text.lower())
        sizes[k] = len(own)
        found += own
    row = words.rows(found)
    label = viterbi(words.score[row], sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    cells = len(texts) * len(langs)
    told = np.bincount(owner * len(langs) + label, words.letters[row] * words.known[row], cells).reshape(len(texts), -1)
    letters = np.bincount(owner, words.letters[row], len(texts))
    best = told.argmax(1)
    share = told[np.arange(len(texts)), best] / np.maximum(letters, 1)
    end = np.cumsum(sizes)
    for k, text in enumerate(texts):
        if not letters[k]:
            yield "und", 0.0, []
            continue
        runs = _spans(text, label[end[k] - sizes[k] : end[k]], langs) if spans else None
        yield langs[best[k]], float(share[k]), runs


def _spans(text: str, label: np.ndarray, langs: list[str]) -> list[tuple[int, int, str]]:
    """Runs of words of one label, as character offsets of the text."""
    runs: list[list] = []
    # Case folding may change lengths, so words are taken from the text itself where it can be aligned.
    places = [m.span() for m in LETTERS.finditer(text if len(text.lower()) == len(text) else text.lower())]
    for (a, b), k in zip(places, label):
        if runs and runs[-1][2] == langs[k]:
            runs[-1][1] = b
        else:
            runs.append([a, b, langs[k]])
    return [tuple(r) for r in runs]


def predictor(docs: DataFrame, model: Model, spans: bool = False):
    """Column function text -> struct(lang_pred, score, spans)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers per language

    @F.pandas_udf(RESULT)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words, texts = _Words(shared.value), None
        for texts in batches:
            out: list[tuple] = []
            if not words.model.langs:
                out = [("und", 0.0, [])] * len(texts)
            else:
                ends = texts.str.len().cumsum() // CHUNK
                for _, chunk in texts.groupby(ends, sort=False):
                    out += label_texts(words, list(chunk), spans)
            yield pd.DataFrame(out, columns=["lang_pred", "score", "spans"])
        del words, texts
        give_back()

    return predict


def identify(docs: DataFrame, model: Model, text: Column | str = "text", spans: bool = False) -> DataFrame:
    """docs with `_language`, the struct of the prediction."""
    return docs.withColumn("_language", predictor(docs, model, spans)(F.coalesce(F.col(text), F.lit(""))))
