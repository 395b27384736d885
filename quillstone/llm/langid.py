"""Language identification: script ranges, then Viterbi over words with a switching penalty.

A model holds, for each language, log-probabilities of hashed letter n-grams (two and
three letters, with word edges) and the scripts its letters come from. A word is scored
for the languages whose scripts hold its first letter. Viterbi finds, for each text, the
labels of its words that maximise the sum of word scores less SWITCH for each change of
language; runs of one label are the text's spans. The text's language is the one that
labels most letters, its score the share of letters so labelled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm import flat
from quillstone.llm.common import id_texts, keep_rows, light, slices, small_batches

BUCKETS, SWITCH, FLOOR = 1 << 15, 6.0, -12.0
#: Code points of texts read at once, but for a longer one, and words scored at once.
PASS_POINTS, PASS_WORDS = 250_000, 1 << 15
#: First code point of each script range (fixed values); 0 is everything else.
SCRIPTS = (
    (0x0041, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "other Indic"), (0x0E00, "Thai"),
    (0x0E80, "other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "other"), (0x1E00, "Latin"),
    (0x1F00, "Greek"), (0x2000, "other"), (0x2C60, "Latin"), (0x2C80, "other"), (0x3040, "Kana"),
    (0x3100, "other"), (0x3130, "Hangul"), (0x3190, "other"), (0x3400, "Han"), (0xA000, "other"),
    (0xA720, "Latin"), (0xA800, "other"), (0xAC00, "Hangul"), (0xD7B0, "other"), (0xF900, "Han"), (0xFB00, "other"),
)
NAMES = sorted({name for _, name in SCRIPTS})
_FROM = np.array([0, *(c for c, _ in SCRIPTS)])
_NAME = np.array([NAMES.index("other"), *(NAMES.index(n) for _, n in SCRIPTS)])
#: Letters of these are words of their own: such scripts have no spaces.
_UNSPACED = np.isin(_NAME, [NAMES.index(n) for n in ("Han", "Kana", "Thai")])


def script_of(points: np.ndarray) -> np.ndarray:
    return _NAME[np.searchsorted(_FROM, points, "right") - 1]


def _words(texts: list[str]) -> flat.Words:
    """Runs of letters and marks with a letter in them; letters of unspaced scripts stand alone."""
    w = flat.words_of(texts, "LM")
    lettered = np.logical_or.reduceat(flat._table("L")[w.points], np.stack([w.start, w.end], 1).ravel())[::2] if len(w.start) else np.ones(0, bool)
    if not lettered.all():
        doc = w.doc[lettered]
        w = flat.Words(w.points, w.start[lettered], w.end[lettered], doc, np.searchsorted(doc, np.arange(len(texts) + 1)))
    at = np.searchsorted(_FROM, w.points[w.start], "right") - 1
    if not _UNSPACED[at].any():
        return w
    n = np.where(_UNSPACED[at], w.end - w.start, 1)
    first = np.repeat(np.cumsum(n) - n, n)
    step = np.arange(int(n.sum())) - first
    start = np.repeat(w.start, n) + step
    end = np.where(np.repeat(_UNSPACED[at], n), start + 1, np.repeat(w.end, n))
    doc = np.repeat(w.doc, n)
    return flat.Words(w.points, start, end, doc, np.searchsorted(doc, np.arange(len(texts) + 1)))


def _grams(w: flat.Words) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of every n-gram."""
    n = w.end - w.start + 2  # with an edge mark on both sides
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    place = np.clip(np.repeat(w.start, n) + at - 1, 0, len(w.points) - 1)
    mark = (at == 0) | (at == np.repeat(n, n) - 1)
    p = np.where(mark, np.uint32(32), w.points[place]).astype(np.uint64)
    word = np.repeat(np.arange(len(n)), n)
    two = p[:-1] * np.uint64(0x1F123BB5) + p[1:]
    three = (two[:-1] * np.uint64(0x1F123BB5) + p[2:]) * np.uint64(0x9E3779B97F4A7C15)
    two = two * np.uint64(0xC2B2AE3D27D4EB4F)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    same2, same3 = word[:-1] == word[1:], word[:-2] == word[2:]
    return np.concatenate([two[same2] >> shift, three[same3] >> shift]).astype(np.int64), np.concatenate([word[:-1][same2], word[:-2][same3]])


@dataclass
class Model:
    languages: list[str]
    logp: np.ndarray  #: buckets x languages, float32, relative to the best language
    scripts: np.ndarray  #: scripts x languages, True where the language uses the script

    def scores(self, w: flat.Words) -> np.ndarray:
        """words x languages; the best of a word is 0, none is under FLOOR. Of long texts some words at a time."""
        out = np.zeros((len(w.start), len(self.languages)), np.float32)
        for lo in range(0, len(w.start), PASS_WORDS):
            hi = lo + PASS_WORDS
            out[lo:hi] = self._scores(flat.Words(w.points, w.start[lo:hi], w.end[lo:hi], w.doc[lo:hi], w.bounds))
        return out

    def _scores(self, w: flat.Words) -> np.ndarray:
        k = len(self.languages)
        bucket, word = _grams(w)
        out = np.stack([np.bincount(word, weights=self.logp[bucket, j], minlength=len(w.start)) for j in range(k)], 1).astype(np.float32)
        may = self.scripts[script_of(w.points[w.start])]
        out = np.where(may | ~may.any(1, keepdims=True), out, np.float32(-1e4))
        return np.maximum(out - out.max(1, keepdims=True), np.float32(FLOOR))


def viterbi(score: np.ndarray, bounds: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of each word; texts are stepped through side by side."""
    n, k = score.shape
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    begin, size = bounds[:-1][order], size[order]
    stay = np.ones((n, k), bool)
    top = np.zeros(n, np.int64)
    live = int(np.count_nonzero(size))
    value = score[begin[:live]].copy()
    last = np.zeros(len(size), np.int64)
    counts = np.searchsorted(-size, -np.arange(int(size.max(initial=0)) + 1), "left")  # counts[t]: texts of over t words
    for t in range(1, int(size.max(initial=0)) + 1):
        m = int(counts[t])
        if m < live:  # those that end here
            last[m:live] = value[m:live].argmax(1)
            value, live = value[:m], m
            if not m:
                break
        best = value.argmax(1)
        other = value[np.arange(m), best][:, None] - switch
        at = begin[:m] + t
        stay[at] = value >= other
        top[at] = best
        value = np.maximum(value, other) + score[at]
    label = np.zeros(n, np.int64)
    now = last.copy()
    for t in range(int(size.max(initial=0)) - 1, -1, -1):
        m = int(counts[t])
        at = begin[:m] + t
        label[at] = now[:m]
        keep = stay[at, now[:m]]
        now[:m] = np.where(keep, now[:m], top[at])
    return label


def predict(model: Model, texts: list[str]) -> tuple[list[str], list[float], list[float]]:
    """Language, its share of the letters, and the share of letters in scripts that the model knows, of each text."""
    out, score, known = ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
    if not model.languages:
        return out, score, known
    k = len(model.languages)
    use = model.scripts.any(1)
    size, scores, length, used = [np.zeros(1, np.int64)], [np.zeros((0, k), np.float32)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    for lo, hi in slices(texts, PASS_POINTS):
        w = _words(texts[lo:hi])
        size.append(np.diff(w.bounds))
        scores.append(model.scores(w))
        length.append(w.end - w.start)
        used.append(use[script_of(w.points[w.start])])
    # all texts are stepped through side by side: the number of steps is that of the longest
    bounds, n, used = np.cumsum(np.concatenate(size)), np.concatenate(length), np.concatenate(used)
    label = viterbi(np.concatenate(scores), bounds)
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    letters = np.bincount(doc * k + label, weights=n, minlength=len(texts) * k).reshape(-1, k)
    used = np.bincount(doc, n * used, len(texts))
    total, best = letters.sum(1), letters.argmax(1)
    for d in np.flatnonzero(total):
        out[d], score[d], known[d] = model.languages[best[d]], float(letters[d, best[d]] / total[d]), float(used[d] / total[d])
    return out, score, known


def spans(model: Model, text: str) -> list[tuple[int, int, str]]:
    """(start, end, language) of each run of words of one language, in the lower-cased text."""
    w = _words([text])
    if not len(w.start) or not model.languages:
        return []
    label = viterbi(model.scores(w), w.bounds)
    first = np.flatnonzero(np.r_[True, np.diff(label) != 0])
    last = np.r_[first[1:], len(label)] - 1
    return [(int(w.start[a]), int(w.end[b]), model.languages[label[a]]) for a, b in zip(first, last)]


def train(labelled: DataFrame, per_language: int = 1000, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> Model:
    """Learns from about `per_language` rows of each language, chosen by a hash of id and text.

    Rows with null language or text are left out. Whole texts are counted on the executors;
    the driver gets one row of counts for each language and task.
    """
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id")).filter("lang is not null and text is not null")
    n = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not n:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(NAMES), 0), bool))
    share = F.create_map(*[F.lit(x) for lang, c in n.items() for x in (lang, min(1.0, per_language / c))])
    few = rows.filter(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)

    def count(batches):
        grams, scripts = {}, {}
        for batch in light(batches):
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in set(langs):
                of = [t for x, t in zip(langs, texts) if x == lang]
                for lo, hi in slices(of, PASS_POINTS):
                    w = _words(of[lo:hi])
                    for at in range(0, len(w.start), PASS_WORDS):
                        some = flat.Words(w.points, w.start[at : at + PASS_WORDS], w.end[at : at + PASS_WORDS], w.doc, w.bounds)
                        grams[lang] = grams.get(lang, 0) + np.bincount(_grams(some)[0], minlength=BUCKETS)
                    if len(w.start):
                        scripts[lang] = scripts.get(lang, 0) + np.bincount(script_of(w.points[w.start]), minlength=len(NAMES))
        yield pa.RecordBatch.from_arrays([pa.array(list(grams)), pa.array([g.astype("<i4").tobytes() for g in grams.values()], pa.binary()), pa.array([s.astype("<i4").tobytes() for s in scripts.values()], pa.binary())] if grams else [pa.array([], pa.string()), pa.array([], pa.binary()), pa.array([], pa.binary())], names=["lang", "grams", "scripts"])

    counts = {lang: [np.zeros(BUCKETS), np.zeros(len(NAMES))] for lang in sorted(n)}
    # the sample is small: a handful of tasks count it, each sends one row per language
    sample = few.select("lang", "text").coalesce(16)
    for r in sample.mapInArrow(count, "lang string, grams binary, scripts binary").toLocalIterator():
        counts[r["lang"]][0] += np.frombuffer(r["grams"], "<i4")
        counts[r["lang"]][1] += np.frombuffer(r["scripts"], "<i4")
    counts = {k: v for k, v in counts.items() if v[0].sum()}
    if not counts:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(NAMES), 0), bool))
    g = np.stack([v[0] for v in counts.values()], 1) + 0.5
    logp = np.log(g / g.sum(0))
    s = np.stack([v[1] for v in counts.values()], 1)
    return Model(list(counts), (logp - logp.max(1, keepdims=True)).astype(np.float32), s >= 0.01 * s.sum(0))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def has_letter(texts: list[str]) -> list[bool]:
    return [any(c.isalpha() for c in t) for t in texts]


def keep_identified(docs: DataFrame, least_known: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs whose language is one of those learned, columns unchanged.

    What goes: null texts, texts without a letter, and texts of whose letters less than
    least_known are in words of a script that a learned language uses. Mixtures of learned
    languages stay, whatever their shares; if nothing could be learned, all with a letter
    stay. Repeated rows and null ids are judged like any other; other columns are passed on.
    """
    model = train(docs.filter(F.col(id_col).isNotNull() & ~held_out(id_col)), lang_col=lang_col, text_col=text_col, id_col=id_col)
    if not model.languages:
        return keep_rows(docs, text_col, has_letter)

    def keep(texts):
        lang, _, known = predict(model, texts)
        return [x != "und" and share >= least_known for x, share in zip(lang, known)]

    return keep_rows(docs, text_col, keep)


def identify(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs: id, held_out, lang_pred, score.

    Without a model, one is learned from rows that are not held out and have a language;
    rows with a null id are never learned from. Predictions read the text alone. Null texts
    and texts without a letter are `und` with score 0, as is everything if nothing could be
    learned; equal sums go to the language first in order. Repeated rows stay.
    """
    if model is None:
        model = train(docs.filter(F.col(id_col).isNotNull() & ~held_out(id_col)), lang_col=lang_col, text_col=text_col, id_col=id_col)

    def label(batches):
        for batch in light(batches):
            lang, score, _ = predict(model, id_texts(batch)[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["id", "held_out", "lang_pred", "score"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out(id_col).alias("held_out"))
    return rows.mapInArrow(label, f"id {rows.schema['id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)
