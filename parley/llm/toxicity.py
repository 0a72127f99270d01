"""Toxicity of whole texts by a convolutional classifier over hashed word embeddings.

A word is the sum of what two hash tables hold for it, so that a collision in one table alone does not make a word look
like another. Filters of widths one to three run over the words, the largest response of each filter over the whole
text is kept, and a logistic layer gives the logit. All of it is trained in numpy on a bounded sample of labelled rows.
A response only depends on the words under the filter, so each distinct word is projected once per task and texts are
sums and maxima of gathered rows.

The threshold is calibrated for each language on rows the network was not trained on. The language is guessed from the
words; it is not read from a column. The score is shifted so that the threshold is at one half.

Cases: null and empty texts are scored like a text without words. Rows without a label are not learned from; without
toxic or without clean rows the score is the share of toxic rows among them (0 without rows). Repeated rows get equal
results. Columns besides `doc_id`, `text` and, for learning, `lang` are not read.
"""

import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.memory import give_back
from parley.operators.topn import first_per_group

BUCKETS = 1 << 18
DIMS = 8
FILTERS = 6
WIDTHS = (1, 2, 3)
TRAIN_ROWS = 2500  # sampled toxic rows
CLEAN_TO_TOXIC = 2  # sampled clean rows for each of them
LEAST_DOCS = 3  # sampled documents a word must be in to be learned
SHRINK = 4  # documents
EPOCHS = 4
BATCH = 128
CLEAN_WEIGHT = 4  # a share of clean texts called toxic weighs as much as so many shares of toxic texts missed
RATE = 0.005
DECAY = 1e-4
CHUNK = 250_000
SLICE = 50_000  # words of a text that training holds responses of at once
CACHE_WORDS = 100_000
WORD = re.compile(r"\w+")
_COLUMNS = FILTERS * sum(WIDTHS)


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Place of each word in the two tables."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    one = np.fromiter(map(zlib.crc32, raw), np.int64, len(raw)) % BUCKETS
    two = np.fromiter((zlib.crc32(r, 0x5BD1E995) for r in raw), np.int64, len(raw)) % BUCKETS
    return one, two


def _blocks() -> list[tuple[int, int, int]]:
    """(width, offset in it, first column) of each projection."""
    out, at = [], 0
    for width in WIDTHS:
        for k in range(width):
            out.append((width, k, at))
            at += FILTERS
    return out


def responses(projected: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Responses of all filters at every word; flat ends with the pad rows that the widest filter needs."""
    n = len(flat) - max(WIDTHS) + 1
    out = np.zeros((n, FILTERS * len(WIDTHS)), np.float32)
    for width, k, at in _blocks():
        first = WIDTHS.index(width) * FILTERS
        out[:, first : first + FILTERS] += projected[flat[k : k + n], at : at + FILTERS]
    return out


def flatten(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of all texts with pad rows (0) between, start and end of each text; a text without words is one pad."""
    gap = np.zeros(max(WIDTHS) - 1, np.int64)
    none = np.zeros(1, np.int64)
    parts, start, end, at = [], [], [], 0
    for rows in docs:
        own = rows if len(rows) else none
        parts += [own, gap]
        start.append(at)
        end.append(at + len(own))
        at += len(own) + len(gap)
    return np.concatenate(parts), np.array(start), np.array(end)


def _pool(response: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    # Only windows that begin in a text: those that begin in the padding reach into the next one.
    return np.maximum.reduceat(response, np.column_stack([start, end]).ravel()[:-1], 0)[::2]


def _tops(projected: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest response of each filter over one text, and the rows under the filter there."""
    none = np.zeros(1, np.int64)
    padded = np.concatenate([rows if len(rows) else none, np.zeros(max(WIDTHS) - 1, np.int64)])
    best, place = None, None
    for a in range(0, max(len(rows), 1), SLICE):
        response = responses(projected, padded[a : a + SLICE + max(WIDTHS) - 1])
        top = response.argmax(0)
        found = response[top, np.arange(response.shape[1])]
        if best is None:
            best, place = found, top
        else:
            best, place = np.maximum(best, found), np.where(found > best, top + a, place)
    return best, padded[place[:, None] + np.arange(max(WIDTHS))]


class Model:
    """Trained tables, filters, output layer and thresholds."""

    def __init__(self, prior: float = 0.0):
        self.prior, self.ready = prior, False
        self.langs: list[str] = []
        self.shift = np.zeros(1)

    def project(self, words: list[str]) -> np.ndarray:
        """Filter projections and language evidence of words."""
        one, two = buckets(words)
        vectors = np.concatenate([self.table[0][one], self.table[1][two]], 1)
        return np.concatenate([vectors @ self.filters, self.evidence[one]], 1, dtype=np.float32)

    def logits(self, projected: np.ndarray, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Logit and index of the guessed language of each text."""
        flat, start, end = flatten(docs)
        pooled = _pool(responses(projected, flat), start, end)
        logit = np.maximum(pooled + self.bias, 0) @ self.out + self.base
        told = np.add.reduceat(projected[flat, _COLUMNS:], start, 0, dtype=np.float64)
        return logit, told.argmax(1) if told.shape[1] else np.zeros(len(docs), np.int64)

    def scores(self, logit: np.ndarray, lang: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(logit - self.shift[lang], -30, 30)))


def fit(texts: Sequence[str], label: np.ndarray, lang: list[str | None], seed: int = 7) -> Model:
    """Model from a sample of labelled texts."""
    rng = np.random.default_rng(seed)
    model = Model(float(label.mean()) if len(label) else 0.0)
    if not 0 < label.sum() < len(label):
        return model
    index: dict[str, int] = {}
    docs = [np.array([index.setdefault(w, len(index)) for w in words_of(t)], np.int32) for t in texts]
    names = list(index)
    held = np.zeros(len(docs), bool)
    for value in (0, 1):  # a quarter of each label is left for the thresholds, if there is enough of it
        own = rng.permutation(np.flatnonzero(label == value))
        held[own[: len(own) // 4]] = True
    # Words in several training documents.
    seen = np.zeros((len(names), 2))
    for d in np.flatnonzero(~held):
        seen[np.unique(docs[d]), label[d]] += 1
    learned = np.flatnonzero(seen.sum(1) >= min(LEAST_DOCS, max(1, len(docs) // 100)))
    if not len(learned):
        return model
    vocabulary = [names[k] for k in learned]
    row = np.zeros(len(names), np.int64)
    row[learned] = np.arange(1, len(learned) + 1)
    rows = [row[d].astype(np.int32) for d in docs]
    place, table, into = [], [], []
    counts = seen[learned]
    total = np.array([(label[~held] == 0).sum(), (label[~held] == 1).sum()], float)
    odds = np.log((counts[:, 1] + 0.5) / (total[1] + 1)) - np.log((counts[:, 0] + 0.5) / (total[0] + 1))
    odds *= counts.sum(1) / (counts.sum(1) + SHRINK)  # few documents say little
    for b in buckets(vocabulary):
        own, inverse = np.unique(b, return_inverse=True)
        start = rng.normal(0, 0.01, (len(own), DIMS))
        # The first number of a vector starts from the log odds of the words that share it.
        start[:, 0] = np.bincount(inverse, odds) / np.bincount(inverse) / 4
        place.append(own)
        into.append(inverse)
        table.append(start)
    filters = rng.normal(0, 0.3, (2 * DIMS, _COLUMNS))
    for width, _, at in _blocks():
        filters[[0, DIMS], at : at + FILTERS] = np.abs(filters[[0, DIMS], at : at + FILTERS]) + 1 / width
    values = {
        "t0": table[0],
        "t1": table[1],
        "filters": filters,
        "bias": np.full(FILTERS * len(WIDTHS), -1.0),
        "out": np.abs(rng.normal(0.5, 0.2, FILTERS * len(WIDTHS))),
        "base": np.array([-2.0]),
    }
    first = {k: np.zeros_like(v) for k, v in values.items()}
    second = {k: np.zeros_like(v) for k, v in values.items()}
    train = np.flatnonzero(~held)
    weight = np.where(label == 1, len(train) / (2 * max(total[1], 1)), len(train) / (2 * max(total[0], 1)))
    step = 0
    for _ in range(EPOCHS):
        for chunk in np.array_split(rng.permutation(train), max(1, len(train) // BATCH)):
            step += 1
            x = np.concatenate([values["t0"][into[0]], values["t1"][into[1]]], 1)
            projected = np.concatenate([np.zeros((1, _COLUMNS)), x @ values["filters"]]).astype(np.float32)
            pooled, under = (np.stack(c) for c in zip(*(_tops(projected, rows[d]) for d in chunk)))
            hidden = np.maximum(pooled + values["bias"], 0)
            logit = np.clip(hidden @ values["out"] + values["base"], -30, 30)
            error = (1 / (1 + np.exp(-logit)) - label[chunk]) * weight[chunk] / len(chunk)
            back = error[:, None] * values["out"] * (hidden > 0)
            # The gradient of a maximum goes to the place that holds it.
            changed = np.zeros((len(vocabulary) + 1, _COLUMNS))
            for d in np.flatnonzero(np.abs(back).sum(1) > 1e-9):
                for width, k, at in _blocks():
                    own = WIDTHS.index(width) * FILTERS + np.arange(FILTERS)
                    changed[under[d, own, k], at + np.arange(FILTERS)] += back[d, own]
            changed = changed[1:]
            dx = changed @ values["filters"].T
            slope = {
                "t0": DECAY * values["t0"],
                "t1": DECAY * values["t1"],
                "filters": x.T @ changed + DECAY * values["filters"],
                "bias": back.sum(0),
                "out": hidden.T @ error + DECAY * values["out"],
                "base": np.array([error.sum()]),
            }
            np.add.at(slope["t0"], into[0], dx[:, :DIMS])
            np.add.at(slope["t1"], into[1], dx[:, DIMS:])
            for key, g in slope.items():  # Adam
                first[key] = 0.9 * first[key] + 0.1 * g
                second[key] = 0.99 * second[key] + 0.01 * g * g
                move = first[key] / (1 - 0.9**step) / (np.sqrt(second[key] / (1 - 0.99**step)) + 1e-8)
                values[key] = values[key] - RATE * move
    del rows, seen, first, second, x, projected
    give_back()
    model.table = [np.zeros((BUCKETS, DIMS), np.float32) for _ in range(2)]
    for t, own in enumerate(place):
        model.table[t][own] = values[f"t{t}"]
    model.filters = values["filters"].astype(np.float32)
    model.bias, model.out, model.base = values["bias"], values["out"], float(values["base"][0])
    model.ready = True
    _learn_language(model, names, docs, lang)
    _calibrate(model, texts, label, held)
    return model


def _learn_language(model: Model, names: list[str], docs: list[np.ndarray], lang: list[str | None]) -> None:
    """Evidence of each bucket for each language, from how often its words are in documents of that language."""
    model.langs = sorted({x for x in lang if x is not None})
    counts = np.full((BUCKETS, len(model.langs)), 0.1, np.float32)
    place, _ = buckets(names)
    for words, own in zip(docs, lang):
        if own is not None:
            np.add.at(counts[:, model.langs.index(own)], place[np.unique(words)], 1)
    if model.langs:  # in place: the table has a row for each bucket
        counts /= counts.sum(0, dtype=np.float64)
        np.log(counts, out=counts)
        counts -= counts.mean(1, keepdims=True, dtype=np.float64)
    model.evidence = counts


def _calibrate(model: Model, texts: Sequence[str], label: np.ndarray, held: np.ndarray) -> None:
    """Threshold per language: the best cut of the rows that were left out of training."""
    use = held if 0 < label[held].sum() < held.sum() else np.ones(len(texts), bool)
    chosen, label = np.flatnonzero(use), label[use]
    store = _Words(model)
    found = [model.logits(*store.look([words_of(texts[d]) for d in chosen[k : k + 50]])) for k in range(0, len(chosen), 50)]
    logit, lang = (np.concatenate(x) for x in zip(*found))

    def cut(z: np.ndarray, y: np.ndarray) -> float:
        grid = np.linspace(z.min(), z.max(), 400)
        soft = 1 / (1 + np.exp(-np.clip(z[:, None] - grid, -30, 30)))  # a single odd row moves the cost a little only
        cost = CLEAN_WEIGHT * soft[y == 0].mean(0) + (1 - soft[y == 1]).mean(0)
        return float(grid[cost.argmin()])

    whole = cut(logit, label)
    model.shift = np.full(max(len(model.langs), 1), whole)
    for k in range(len(model.langs)):
        own = lang == k
        if min((label[own] == 1).sum(), (label[own] == 0).sum()) >= 8:
            model.shift[k] = cut(logit[own], label[own])


class _Words:
    """Projections of the words this worker saw lately; row 0 is the pad."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.projected = np.zeros((2 * CACHE_WORDS, _COLUMNS + len(self.model.langs)), np.float32)

    def look(self, docs: list[list[str]]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Table of projections and the rows of each text."""
        if len(self.row) > CACHE_WORDS:
            self.row.clear()
        new = list(set().union(*docs).difference(self.row))
        base = len(self.row) + 1
        if base + len(new) > len(self.projected):
            more = np.zeros((base + len(new) - len(self.projected), self.projected.shape[1]), np.float32)
            self.projected = np.concatenate([self.projected, more])
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            self.projected[base + k : base + k + len(part)] = self.model.project(part)
        self.row.update(zip(new, range(base, base + len(new))))
        return self.projected, [np.fromiter(map(self.row.__getitem__, d), np.int64, len(d)) for d in docs]


class _Column(Sequence):
    """Texts of an Arrow column, each made a string only while it is read."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        self.column = column

    def __len__(self) -> int:
        return len(self.column)

    def __getitem__(self, at: int) -> str | None:
        return self.column[int(at)].as_py()


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Model from doc_id, text, lang and the labels (doc_id, toxic); at most `rows` toxic documents are read, and
    CLEAN_TO_TOXIC times as many clean ones.

    A document with several labels counts as toxic if one of them is; of an id with several texts the least is learned.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = docs.select("doc_id").distinct().join(known, "doc_id")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = first_per_group(chosen, ["toxic"], order, rows * CLEAN_TO_TOXIC).where(
        (F.col("toxic") == 0) | (F.col("rank") <= rows)
    ).select("doc_id", "toxic")
    # (1 + CLEAN_TO_TOXIC) * `rows` ids; the sample of texts is bounded by the same number.
    sample = docs.select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id")
    sample = sample.groupBy("doc_id", "toxic").agg(F.min(F.struct("text", "lang")).alias("row"))
    table = sample.select("doc_id", "toxic", "row.text", "row.lang").toArrow().sort_by("doc_id")
    label = table["toxic"].to_numpy().astype(np.int64)
    model = fit(_Column(table["text"].combine_chunks()), label, table["lang"].to_pylist())
    del table
    give_back()
    return model


def scorer(docs: DataFrame, model: Model):
    """Column function text -> score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: two tables of BUCKETS rows

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        store, texts = _Words(own) if own.ready else None, None
        for texts in batches:
            if store is None:
                yield pd.Series(np.full(len(texts), own.prior))
                continue
            out = []
            for _, chunk in texts.groupby(texts.str.len().cumsum() // CHUNK, sort=False):
                out.append(own.scores(*own.logits(*store.look([words_of(t) for t in chunk]))))
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))
        del store, texts
        give_back()

    return score


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with `_toxicity`, the score of each text."""
    return docs.withColumn("_toxicity", scorer(docs, model)(F.coalesce(F.col("text"), F.lit(""))))
