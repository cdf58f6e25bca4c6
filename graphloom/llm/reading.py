"""Reading level of each document (problem 9).

A familiar-word formula: how many words lie outside lists of frequent words,
and how long sentences are. The lists are the corpus's own: a word is familiar
at a threshold if at least that share of the documents of its language have
it, so they stay alike as the corpus grows. Weights are fitted to a bounded
sample of judged documents. Only prose counts: code, tables, headings, links
and identifiers are passed over.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut

# Function words that tell the languages of the corpus apart.
FUNCTION_WORDS = {
    "en": "the a an this each every any of and is it you that when before with to in",
    "de": "der die das und ein eine ist den dem nicht mit auf zu im sind denn",
    "fr": "le la les des une un est et dans pour que qui du au",
    "es": "el la los las una un es y en para que con del por se",
}
LANGUAGES = tuple(FUNCTION_WORDS)
_VOTES = {lang: frozenset(words.split()) for lang, words in FUNCTION_WORDS.items()}

# Document shares at which a word counts as familiar; the smallest bounds the lists' length.
SHARES = (0.3, 0.25, 0.2, 0.175, 0.15, 0.125, 0.1, 0.085, 0.07, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01, 0.003)
N_FEATURES = 3 * len(SHARES) + 8 + len(LANGUAGES) - 1
MAX_LABELLED = 50_000  # judged documents used for the fit
DEMANDING = 4  # lowest level that counts as demanding
WORDS_KEPT = 200_000  # entries of a worker's memory of tokens, or of counts before they are sent

_FENCE = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\n]*$|\Z)", re.M | re.S)
_INLINE = re.compile(r"`[^`\n]*`")
_EDGES = "\"'“”„‘’«»‹›()[]{}<>.,;:!?¡¿…*_~—–-"
_END = (".", "!", "?", "…", "。", "！", "？", "।")
# scripts written without spaces: each letter is taken for a word
_UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]|[\U00020000-\U0003ffff])")


def _word(token: str) -> tuple[str | None, bool]:
    """The word in a token, None if it is no prose, and whether the token ends a sentence."""
    bare = token.strip(_EDGES)
    tail = token.rstrip("\"'“”‘’«»)]}*_~")
    ends = tail.endswith(_END)
    letters = bare.replace("-", "").replace("'", "").replace("’", "")
    if not letters.isalpha():
        return None, ends
    if not (letters.islower() or letters.isupper() or letters[1:].islower() or "-" in bare or letters.lower() == letters.upper()):
        return None, ends
    return bare.lower(), ends


class Prose:
    """Sentences of words in a text; remembers tokens met before, up to a bound."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[str | None, bool]] = {}

    def sentences(self, text: str | None) -> list[list[str]]:
        if not text or text.isspace():
            return []
        if "```" in text or "~~~" in text:
            text = _FENCE.sub("\n\n", text)
        out: list[list[str]] = []
        known = self.known
        now: list[str] = []
        for line in text.split("\n"):
            line = line.strip()
            if not line or line[0] in "|#":
                if now:
                    out.append(now)
                    now = []
                continue
            if "`" in line:
                line = _INLINE.sub(" ", line)
            if not line.isascii() and _UNSPACED.search(line):
                line = _UNSPACED.sub(r" \1 ", line)
            for token in line.split():
                got = known.get(token)
                if got is None:
                    got = _word(token)
                    if len(token) < 64:
                        known[token] = got
                word, ends = got
                if word is not None:
                    now.append(word)
                if ends and now:
                    out.append(now)
                    now = []
        if now:
            out.append(now)
        if len(known) > WORDS_KEPT:
            known.clear()
        return out


def language(words: Counter) -> str:
    """The language whose function words are most of the words; without any, the words' script, as ``script:greek``.

    Latin words without function words count as the first of LANGUAGES.
    """
    votes = {lang: sum(words[w] for w in own) for lang, own in _VOTES.items()}
    best = max(LANGUAGES, key=votes.__getitem__)
    if votes[best] or all(w < "\u0250" for w in words):
        return best
    scripts = Counter()
    for w, n in words.items():
        scripts[unicodedata.name(w[0], "unknown").partition(" ")[0].lower()] += n
    script = min(scripts, key=lambda x: (-scripts[x], x))
    return best if script == "latin" else f"script:{script}"


class Lists:
    """Familiar words by language, as numbers into tables of their list and share."""

    def __init__(self, shares: dict[str, dict[str, float]]) -> None:
        flat = [(lang, w, v) for lang, words in sorted(shares.items()) for w, v in sorted(words.items())]
        self.numbers: dict[str, dict[str, int]] = defaultdict(dict)
        for i, (lang, w, _) in enumerate(flat):
            self.numbers[lang][w] = i + 1
        share = np.array([0.0, *(v for _, _, v in flat)])
        # thresholds fall, so a word outside of n lists is outside of the first n
        self.outside = np.array([sum(v < t for t in SHARES) for v in share])
        self.log = np.log(share + 1e-3)


def features(texts: list[list[list[str]]], lists: Lists) -> tuple[np.ndarray, list[str | None]]:
    """Measures of texts and their languages: shares of words outside each list, sentence length and both combined.

    Texts without words have a row of NaN and no language.
    """
    k, n_texts = len(SHARES), len(texts)
    numbers: list[int] = []
    langs: list[str | None] = []
    lengths: list[int] = []
    n_sentences = np.zeros(n_texts, dtype=np.int64)
    for i, sentences in enumerate(texts):
        words = list(chain.from_iterable(sentences))
        langs.append(language(Counter(words)) if words else None)
        if words:
            numbers.extend(map(lists.numbers[langs[-1]].get, words, repeat(0)))
            lengths.extend(map(len, sentences))
            n_sentences[i] = len(sentences)
    out = np.full((n_texts, N_FEATURES), np.nan)
    if not numbers:
        return out, langs
    text_of_sentence = np.repeat(np.arange(n_texts), n_sentences)
    length = np.array(lengths, dtype=float)
    total = np.bincount(text_of_sentence, length, n_texts)
    text_of_word = np.repeat(text_of_sentence, np.array(lengths))
    number = np.array(numbers)
    has = np.flatnonzero(n_sentences)
    words = np.maximum(total, 1)[:, None]
    by_list = np.bincount(text_of_word * (k + 1) + lists.outside[number], minlength=n_texts * (k + 1)).reshape(n_texts, k + 1)
    outside = by_list[:, ::-1].cumsum(1)[:, ::-1][:, 1:] / words
    log_share = np.bincount(text_of_word, lists.log[number], n_texts) / words[:, 0]
    per = np.maximum(n_sentences, 1)
    mean = np.log(np.maximum(total / per, 1e-9))
    ordered = length[np.lexsort((length, text_of_sentence))]
    first = np.cumsum(n_sentences) - n_sentences
    low, high = (np.minimum(first + x, len(ordered) - 1) for x in ((per - 1) // 2, per // 2))
    median, longest = (ordered[low] + ordered[high]) / 2, ordered[np.minimum(first + per - 1, len(ordered) - 1)]
    part = lambda flag: np.bincount(text_of_sentence, flag, n_texts) / per
    flags = np.array([[float(lang == x) for x in LANGUAGES[1:]] for lang in langs])
    foreign = flags.sum(1, keepdims=True)
    rows = np.c_[outside, outside * mean[:, None], outside * foreign, log_share, mean, mean * mean, np.log1p(median), np.log(longest), part(length >= 25), part(length >= 15), part(length <= 6), flags]
    out[has] = rows[has]
    return out, langs


class Model:
    """Logistic regression of "demanding" on standardised features."""

    def __init__(self, rows: np.ndarray, demanding: np.ndarray, penalty: float = 0.3) -> None:
        self.mean, self.scale = rows.mean(0), rows.std(0) + 1e-9
        x = self._inputs(rows)
        w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
        ridge[-1] = 1e-6
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge)
            step = np.linalg.solve(hessian, x.T @ (demanding - p) - ridge * w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w

    def _inputs(self, rows: np.ndarray) -> np.ndarray:
        return np.c_[(rows - self.mean) / self.scale, np.ones(len(rows))]

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._inputs(rows) @ self.weights, -30, 30)))


def document_frequencies(documents: DataFrame) -> DataFrame:
    """Documents of a language that have a word: lang, word, n_docs; the word '' counts the documents themselves.

    Workers add up before they send, so that frequent words are not shuffled
    once per document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prose, counts = Prose(), defaultdict(Counter)

        def sent() -> pa.RecordBatch:
            rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["lang", "word", "n"])

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                for text in batch.column(0).slice(at, 500).to_pylist():
                    words = Counter(w for s in prose.sentences(text) for w in s)
                    if words:
                        own = counts[language(words)]
                        own.update(words.keys())
                        own[""] += 1
                if sum(map(len, counts.values())) > WORDS_KEPT:
                    yield sent()
        yield sent()

    parts = documents.select("text").mapInArrow(run, "lang string, word string, n long")
    return parts.groupBy("lang", "word").agg(F.sum("n").alias("n_docs"))


def familiar_words(documents: DataFrame) -> DataFrame:
    """Words that at least the smallest of SHARES of a language's documents have: lang, word, share.

    As a document holds a bounded number of words, the list's length is bounded
    by that number over the smallest share and does not grow with the corpus.
    """
    df = cut(document_frequencies(documents))
    totals = df.filter("word = ''").select("lang", F.col("n_docs").alias("total"))
    shares = df.filter("word <> ''").join(F.broadcast(totals), "lang")  # a row per language
    return shares.select("lang", "word", (F.col("n_docs") / F.col("total")).alias("share")).filter(F.col("share") >= min(SHARES))


def judged(labels: DataFrame) -> DataFrame:
    """One level per judged document: doc_id, level (the mean of its raters' latest judgements).

    Repeats count once; null documents and levels are left out.
    """
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col("level").isNotNull())
    latest = rows.groupBy("doc_id", "rater").agg(F.max(F.struct("rated_at", "level")).alias("r"))
    return latest.groupBy("doc_id").agg(F.avg("r.level").alias("level"))


def plain_formula(unfamiliar: np.ndarray, sentence_length: np.ndarray) -> np.ndarray:
    """The published familiar-word formula: percentage of unfamiliar words and words per sentence, with its constant above 5 %."""
    percent = 100 * unfamiliar
    return 0.1579 * percent + 0.0496 * sentence_length + np.where(percent > 5, 3.6365, 0.0)


COLLEGE = 9.0  # the formula's published grade for college students
LEVELS = "doc_id long, lang string, n_words long, unfamiliar double, sentence_length double, formula double, score double, demanding boolean"


def reading_levels(documents: DataFrame, labels: DataFrame | None = None, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Every document's estimate: doc_id, lang, n_words, unfamiliar, sentence_length, formula, score, demanding.

    ``unfamiliar`` is the share of words outside the list of words that a tenth
    of the language's documents have, ``formula`` the plain formula over it and
    the sentence length. ``score`` is the probability that the text is of level
    4 or 5, by lists of several lengths weighted on the judged documents, and
    ``demanding`` whether it is at least a half. Without labels, or without
    judgements of both kinds, scores are null and the formula decides, from its
    grade for college students on. Texts without prose have null measures and
    are not demanding. At most ``max_labelled`` judged documents, chosen by a
    hash of their id, are used for the fit; their measures (4 bytes each, so
    12 MB in all) are what comes to the driver, with the lists of words.
    """
    spark = documents.sparkSession
    shares: dict[str, dict[str, float]] = {}
    listed = familiar_words(documents).toArrow()
    for lang, word, share in zip(*(listed.column(i).to_pylist() for i in range(3))):
        shares.setdefault(lang, {})[word] = share
    shared = spark.sparkContext.broadcast(shares)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prose, known = Prose(), Lists(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                x, langs = features([prose.sentences(t) for t in part.column(1).to_pylist()], known)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() if lang else None for r, lang in zip(x.astype(np.float32), langs)], pa.binary())], names=["level", "x"])

    fitted = None
    if labels is not None:
        sample = judged(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
        texts = documents.select("doc_id", "text").join(sample, "doc_id").select("level", "text")
        rows = texts.mapInArrow(measured, "level double, x binary").filter("x IS NOT NULL").toArrow()
        hard = (rows.column(0).to_numpy() >= DEMANDING - 0.5).astype(float)
        if 0 < hard.sum() < len(hard):
            fitted = Model(np.frombuffer(b"".join(rows.column(1).to_pylist()), np.float32).reshape(len(hard), -1).astype(float), hard)
    model = spark.sparkContext.broadcast(fitted)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prose, known, m = Prose(), Lists(shared.value), model.value
        tenth = SHARES.index(0.1)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [prose.sentences(t) for t in part.column(1).to_pylist()]
                x, langs = features(texts, known)
                none = np.array([lang is None for lang in langs])
                n_words = np.array([sum(map(len, s)) for s in texts])
                length = n_words / np.maximum([len(s) for s in texts], 1)
                plain = plain_formula(x[:, tenth], length)
                score = np.full(len(texts), np.nan)
                if m is not None and not none.all():
                    score[~none] = m.score(x[~none])
                unknown = none if m is not None else np.ones(len(texts), dtype=bool)
                demanding = np.nan_to_num(score) >= 0.5 if m is not None else np.nan_to_num(plain) >= COLLEGE
                arrays = [part.column(0), pa.array(langs, pa.string()), pa.array(n_words, pa.int64()), pa.array(x[:, tenth], mask=none), pa.array(length, mask=none), pa.array(plain, mask=none), pa.array(score, mask=unknown), pa.array(demanding & ~none)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "lang", "n_words", "unfamiliar", "sentence_length", "formula", "score", "demanding"])

    return documents.select("doc_id", "text").mapInArrow(scored, LEVELS)


def profile(levels: DataFrame, by: str = "lang") -> DataFrame:
    """Documents, demanding ones and mean measures per value of ``by``."""
    return levels.groupBy(by).agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("demanding").alias("n_demanding"), F.avg("unfamiliar").alias("unfamiliar"), F.avg("sentence_length").alias("sentence_length"))
