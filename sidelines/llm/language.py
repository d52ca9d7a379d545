"""Language identification with spans of mixed-language text.

Training counts, for each language, hashed byte trigrams of words (A-Z in lower
case, word borders as blanks) and the scripts of words, over all labelled
rows; Spark sums the counts, at most languages x (2**16 + 32) of them, which is
what the driver reads.

Prediction: a word's script, by ranges of code points, names the candidates, the
languages that use it.  Only they score the word, by the log
probability of its trigrams; the others stand ``FAR`` below the worst of them.  Viterbi over the words, with a penalty for every
switch, labels spans; it advances all documents of a batch by one word at a
time.  Words are scored and labelled in groups of a bounded number of (letter, candidate) and (word,
language) pairs, so memory does not grow with the number of languages, but for a
single text's words.  The document's language is the one with most letters; its score is that
language's share of the letters.

Defined results: a NULL text, or one without a letter, is ``und`` with score 0;
so is any text when there is nothing to learn from.  Ties go to the first
language in alphabetical order.  Rows with a NULL or empty text or NULL
language teach nothing.  Repeated rows get equal answers; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sidelines.llm import arrays as A
from sidelines.llm.catalog import register
from sidelines.llm.common import crc_mod, table

GRAMS = 1 << 16
SCRIPTS = 32
#: Pairs of words and languages that are labelled together, and of letters and candidates that are scored together.
GROUP_CELLS, SCORE_CELLS = 8_000_000, 1 << 22
#: Log probability by which a language that does not use a word's script is behind.
FAR = 50.0


#: Where scripts begin among code points, and their classes (fixed values); 0: plain Latin letters, and signs of no script.
_RANGES = ((0x0, 0), (0xC0, 1), (0x370, 2), (0x400, 3), (0x530, 4), (0x590, 5), (0x600, 6), (0x700, 0), (0x750, 6), (0x780, 0), (0x900, 7), (0x980, 8),
           (0xA00, 9), (0xA80, 10), (0xB00, 11), (0xB80, 12), (0xC00, 13), (0xC80, 14), (0xD00, 15), (0xD80, 16), (0xE00, 17), (0xE80, 18),
           (0xF00, 19), (0x1000, 20), (0x10A0, 21), (0x1100, 22), (0x1200, 23), (0x13A0, 0), (0x1780, 24), (0x1800, 0), (0x1E00, 1), (0x1F00, 2),
           (0x2000, 0), (0x2E80, 25), (0x3040, 26), (0x3100, 25), (0x3130, 22), (0x3190, 25), (0x31F0, 26), (0x3200, 25), (0xA000, 0), (0xAC00, 22),
           (0xD7B0, 0), (0xF900, 25), (0xFB00, 0), (0x20000, 25), (0x323B0, 0))
_BEGINS, _CLASS = (np.array(c) for c in zip(*_RANGES))


def code_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points of the letters whose first bytes stand at ``at`` (well-formed UTF-8)."""
    b = data[at].astype(np.int64)
    more = [(data[np.minimum(at + k, len(data) - 1)] & 0x3F).astype(np.int64) for k in (1, 2, 3)]
    two, three = (b & 0x1F) << 6 | more[0], (b & 0x0F) << 12 | more[0] << 6 | more[1]
    four = (b & 0x07) << 18 | more[0] << 12 | more[1] << 6 | more[2]
    return np.where(b < 0x80, b, np.where(b < 0xE0, two, np.where(b < 0xF0, three, four)))


def scripts_of(data: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Script class of every byte of ``letters``; 0 for the later bytes of a letter."""
    out = np.zeros(len(letters), np.uint8)
    lead = np.flatnonzero(data[letters] >= 0xC0)
    out[lead] = _CLASS[np.searchsorted(_BEGINS, code_points(data, letters[lead]), "right") - 1]
    return out


LETTER = np.zeros(256, bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = LETTER[0x80:] = True
NORMAL = np.where(LETTER, A.LOWER, 0x20).astype(np.uint32)


def _grams(data: np.ndarray, off: np.ndarray):
    """Words of a slice: (document, letters, script) of each, and the trigram of each letter byte."""
    start, end, doc = A.words(data, off, LETTER)
    b = NORMAL[data]
    before, after = np.empty_like(b), np.empty_like(b)
    before[1:], after[:-1] = b[:-1], b[1:]
    before[off[:-1][off[:-1] < len(b)]] = 0x20
    after[off[1:][off[1:] > 0] - 1] = 0x20
    letters = np.flatnonzero(LETTER[data])
    code = (before[letters] << np.uint32(16)) | (b[letters] << np.uint32(8)) | after[letters]
    gram = (code * np.uint32(2654435761)) >> np.uint32(16)
    length = end - start
    script = np.maximum.reduceat(scripts_of(data, letters), np.cumsum(length) - length) if len(length) else np.zeros(0, np.uint8)
    return doc, length, script, gram


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", smooth: float = 0.1):
    """(languages, trigram scores [GRAMS, languages], allowed [SCRIPTS, languages])."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column(1).to_pylist()
            for at, data, off in A.slices(b.column(0)):
                doc, length, script, gram = _grams(data, off)
                names = langs[at:at + len(off) - 1]
                kinds = {k: i for i, k in enumerate(dict.fromkeys(names))}
                kind = np.array([kinds[x] for x in names])
                of_word = kind[doc]
                of_letter = np.repeat(of_word, length)
                both = np.bincount(of_letter * GRAMS + gram, minlength=len(kinds) * GRAMS)
                scripts = np.bincount(of_word * SCRIPTS + script, minlength=len(kinds) * SCRIPTS)
                for k, i in kinds.items():
                    c = np.concatenate([both[i * GRAMS:(i + 1) * GRAMS], scripts[i * SCRIPTS:(i + 1) * SCRIPTS]])
                    seen[k] = seen[k] + c if k in seen else c
        for k, c in seen.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())],
                                             names=["lang", "gram", "n"])

    t = (labelled.select(labelled[text_col].alias("t"), labelled[lang_col].cast("string").alias("lang")).dropna()
         .mapInArrow(count, "lang string, gram int, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow())
    names = np.array(t.column("lang").to_pylist(), dtype=object)
    langs = sorted(set(names))
    counts = np.zeros((GRAMS + SCRIPTS, len(langs)))
    if langs:
        counts[t.column("gram").to_numpy(), np.searchsorted(langs, names)] = t.column("n").to_numpy()
    grams, scripts = counts[:GRAMS], counts[GRAMS:]
    score = np.log((grams + smooth) / (grams.sum(0) + smooth * GRAMS)).astype(np.float32)
    used = scripts >= np.maximum(1, 1e-4 * scripts.sum(0))
    used[~used.any(1)] = True                       # a script that no language uses narrows nothing
    return langs, score, used


def word_scores(gram: np.ndarray, length: np.ndarray, script: np.ndarray, score: np.ndarray, used: np.ndarray) -> np.ndarray:
    """[words, languages]: candidates by their trigrams, the others ``FAR`` below the worst candidate."""
    out = np.empty((len(length), score.shape[1]), np.float32)
    begin = np.cumsum(length) - length
    for kind in np.unique(script):
        of, cand = np.flatnonzero(script == kind), np.flatnonzero(used[kind])
        size = length[of]
        cut = np.cumsum(size) // max(1, SCORE_CELLS // len(cand))
        for part in np.split(np.arange(len(of)), np.flatnonzero(np.diff(cut)) + 1):
            w, n = of[part], size[part]
            first = np.cumsum(n) - n
            seen = gram[np.repeat(begin[w] - first, n) + np.arange(n.sum())]
            s = np.add.reduceat(score[seen] if len(cand) == score.shape[1] else score[seen[:, None], cand], first, axis=0)
            if len(cand) < score.shape[1]:
                out[w] = s.min(1, keepdims=True) - np.float32(FAR)
                out[w[:, None], cand] = s
            else:
                out[w] = s
    return out


def viterbi(score: np.ndarray, length: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every word.  ``score``: words x labels, document after document of ``length`` words."""
    n, k = score.shape
    label = np.zeros(n, np.int16)
    order = np.argsort(-length, kind="stable")
    size = length[order]
    base = (np.cumsum(length) - length)[order]
    steps = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(steps), "left")       # documents longer than t
    best = np.zeros((len(size), k), np.float32)
    stay, source = np.empty((n, k), bool), np.empty(n, np.int16)
    for t in range(steps):
        a = active[t]
        rows = base[:a] + t
        v = best[:a]
        top = v.argmax(1)
        leave = v[np.arange(a), top] - penalty
        keep = v >= leave[:, None]
        stay[rows], source[rows] = keep, top
        best[:a] = np.where(keep, v, leave[:, None]) + score[rows]
    state = best.argmax(1).astype(np.int16)
    for t in range(steps - 1, -1, -1):
        a = active[t]
        rows = base[:a] + t
        s = state[:a]
        label[rows] = s
        state[:a] = np.where(stay[rows, s], s, source[rows])
    return label


def _label(texts: pa.Array, langs: list[str], score: np.ndarray, used: np.ndarray, penalty: float) -> Iterator[tuple]:
    """(language, score, spans) of each text, in order."""
    docs, words, lens, held = [], [], [], 0
    rows = 0

    def flush():
        nonlocal docs, words, lens, held, rows
        if rows:
            doc, s, length = np.concatenate(docs), np.concatenate(words), np.concatenate(lens)
            per = np.bincount(doc, minlength=rows)
            lab = viterbi(s, per, penalty)
            weight = np.bincount(doc * len(langs) + lab, weights=length, minlength=rows * len(langs)).reshape(rows, -1)
            top = weight.argmax(1)
            total = weight.sum(1)
            change = np.flatnonzero((doc[1:] != doc[:-1]) | (lab[1:] != lab[:-1])) + 1
            first = np.concatenate([[0], change]) if len(doc) else change
            last = np.concatenate([change, [len(doc)]]) if len(doc) else change
            begin = np.cumsum(per) - per
            spans: list[list[str]] = [[] for _ in range(rows)]
            for d, k, x, y in zip(doc[first].tolist(), lab[first].tolist(), (first - begin[doc[first]]).tolist(), (last - begin[doc[first]]).tolist()):
                spans[d].append(f"{langs[k]}:{x}:{y}")
            for i in range(rows):
                yield (langs[top[i]], float(weight[i, top[i]] / total[i]), ",".join(spans[i])) if total[i] else ("und", 0.0, "")
        docs, words, lens, held, rows = [], [], [], 0, 0

    for _, data, off in A.slices(texts):
        doc, length, script, gram = _grams(data, off)
        if len(length):
            docs.append(doc + rows)
            words.append(word_scores(gram, length, script, score, used))
            lens.append(length)
            held += len(length)
        else:
            docs.append(doc), words.append(np.zeros((0, len(langs)), np.float32)), lens.append(length)
        rows += len(off) - 1
        if held * len(langs) >= GROUP_CELLS:
            yield from flush()
    yield from flush()


SCHEMA = "id bigint, lang_pred string, score double, spans string"


def _predict(texts: pa.Array, model, penalty: float) -> list[tuple]:
    """(language, score, spans) of each text of a batch."""
    langs, score, used = model
    if not langs:
        return [("und", 0.0, "")] * len(texts)
    out = list(_label(texts, langs, score, used, penalty))
    # bytes above ASCII count as letters until here; texts without an ASCII letter are looked at exactly
    plain = np.zeros(len(texts), bool)
    for at, data, off in A.slices(texts):
        total = np.concatenate([[0], np.cumsum(LETTER[data] & (data < 0x80))])
        plain[at:at + len(off) - 1] = total[off[1:]] > total[off[:-1]]
    for i in np.flatnonzero(~plain):
        if not any(map(str.isalpha, texts[int(i)].as_py() or "")):
            out[i] = ("und", 0.0, "")
    return out


def identify(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", penalty: float = 12.0) -> DataFrame:
    """One row per input row: id, lang_pred, score, spans (``lang:first word:last word + 1``)."""
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(zip(*_predict(b.column(1), model, penalty))) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()),
                                              pa.array(cols[2], pa.string())], names=["id", "lang_pred", "score", "spans"])

    d = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].alias("text"))
    return d.mapInArrow(predict, SCHEMA)


def keep_identified(docs: DataFrame, model, min_score: float, text_col: str = "text", penalty: float = 12.0) -> DataFrame:
    """The rows of ``docs``, unchanged, that have a language with at least ``min_score`` of the letters.

    All rows when the model has no language."""
    if not model[0]:
        return docs
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [lang != "und" and score >= min_score for lang, score, _ in _predict(b.column(at), model, penalty)]
            yield b.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept from training: crc32 of the id modulo 4 is 2 (a NULL id is not)."""
    return F.coalesce(crc_mod(F.col(id_col), 4) == 2, F.lit(False))


def corpus_model(docs: DataFrame):
    return train(docs.filter(~held_out()))


@register("op9_language_id")
def op9_language_id(spark, sf_dir):
    """Language of every document, learned from three quarters of the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, corpus_model(docs)).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "spans")
