"""Language of whole texts: script ranges narrow the candidates, Viterbi over word scores labels spans.

A word is what stands between white space (of scripts written without spaces, four letters at most). Its score under a
language is the log probability of its letters, pairs and threes of letters and of the word itself, as learned from
labelled texts. The script of most of its letters bars every language that is hardly ever written in it. The best path
through the words, a switch of the language costing a fixed penalty, gives spans; the language with most letters is the
text's.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlab.llm.common import as_text
from textlab.sources.scratch import materialize

#: Blocks of the scripts that are told apart; any other letter is of one further script.
SCRIPTS = {
    "Latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "Armenian": [(0x530, 0x58F), (0xFB13, 0xFB17)],
    "Hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "Syriac": [(0x700, 0x74F)],
    "Devanagari": [(0x900, 0x97F), (0xA8E0, 0xA8FF)],
    "Bengali": [(0x980, 0x9FF)],
    "Gurmukhi": [(0xA00, 0xA7F)],
    "Gujarati": [(0xA80, 0xAFF)],
    "Oriya": [(0xB00, 0xB7F)],
    "Tamil": [(0xB80, 0xBFF)],
    "Telugu": [(0xC00, 0xC7F)],
    "Kannada": [(0xC80, 0xCFF)],
    "Malayalam": [(0xD00, 0xD7F)],
    "Sinhala": [(0xD80, 0xDFF)],
    "Thai": [(0xE00, 0xE7F)],
    "Lao": [(0xE80, 0xEFF)],
    "Tibetan": [(0xF00, 0xFFF)],
    "Myanmar": [(0x1000, 0x109F)],
    "Georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)],
    "Hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "Ethiopic": [(0x1200, 0x139F)],
    "Khmer": [(0x1780, 0x17FF)],
    "Mongolian": [(0x1800, 0x18AF)],
    "Kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9D)],
    "Han": [(0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}
#: Scripts written without spaces between words.
UNSPACED = ("Thai", "Lao", "Tibetan", "Myanmar", "Khmer", "Kana", "Han")

#: Cost of a switch of the language between two words, in the unit of the word scores (natural logarithms).
SWITCH = 20.0
#: A script stands for a language if so large a share of the language's letters is written in it.
LEAST_SCRIPT = 0.01
#: Share of a language's probability that is spread evenly over all cells, seen or not.
SPREAD = 0.01
#: Cells that the features of a language are hashed into, fewer if there are very many languages.
CELLS, MODEL_CELLS, MAX_LANGS = 1 << 16, 1 << 23, 1024
#: Words worked on at a time (a longer text alone), fewer if there are many languages.
SOME_WORDS = 400_000
UNKNOWN = "und"

_BARRED = np.float32(-1e6)
_N = len(SCRIPTS) + 2                       # 0 is no letter, the last is any other script
_CHARS = "".join(f"{chr(a)}-{chr(b)}" for s in UNSPACED for a, b in SCRIPTS[s])
_HAS_UNSPACED, _WORDS = re.compile(f"[{_CHARS}]"), re.compile(f"[{_CHARS}]{{1,4}}|[^\\s{_CHARS}]+")


@functools.lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Script number of every code point that is a letter or a mark on one; 0 for all others."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    named = np.full(sys.maxunicode + 1, _N - 1, np.uint8)
    for k, ranges in enumerate(SCRIPTS.values(), 1):
        for a, b in ranges:
            named[a:b + 1] = k
    kinds = np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(sys.maxunicode + 1)])
    out[kinds] = named[kinds]
    return out


def words(text: str) -> list[str]:
    """The words of a whole text, in order; what has no letter is among them and has no score."""
    return _WORDS.findall(text) if _HAS_UNSPACED.search(text) else text.split()


class _Ids(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Features(NamedTuple):
    """Of distinct words: the word and cell of every feature, counts of letters by script, whether a letter is among them."""

    word: np.ndarray
    cell: np.ndarray
    scripts: np.ndarray
    real: np.ndarray


def _hashed(v: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        v = (v + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        v = (v ^ (v >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return v ^ (v >> np.uint64(32))


def features(distinct: Iterable[str], cells: int) -> Features:
    """Hashed letters, pairs, threes and whole words of lower-cased ``distinct`` words, without what is no letter."""
    joint = "\n" + "".join(w + "\n" for w in distinct).lower()
    c = np.frombuffer(joint.encode("utf-32-le"), np.uint32).astype(np.int64)
    script = letters()[c]
    end = c == 10
    word = np.cumsum(end) - 1                                # a line end belongs to the word after it
    n = int(end.sum()) - 1
    keep = end | (script > 0)
    c, script, word, end = c[keep], script[keep], word[keep], end[keep]
    at = np.flatnonzero(~end)
    of = word[at]
    one = c.astype(np.uint64)
    with np.errstate(over="ignore"):
        two = one[at - 1] * np.uint64(0x110000) + one[at]
        three = two * np.uint64(0x110000) + one[at + 1]
        place = (at - np.searchsorted(of, of)).astype(np.uint64) if len(at) else at.astype(np.uint64)
        whole = np.zeros(n, np.uint64)
        begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(at) else at
        if len(at):
            whole[of[begin]] = np.add.reduceat(_hashed(one[at] + (place << np.uint64(32)), 4), begin)
    some = np.unique(of)
    cell = np.concatenate([_hashed(one[at], 1), _hashed(two, 2), _hashed(three, 3), whole[some]]) % np.uint64(cells)
    scripts = np.bincount(of * _N + script[at], minlength=n * _N).reshape(n, _N)
    real = np.zeros(n, bool)
    real[of[np.flatnonzero(_is_letter(c[at]))]] = True
    return Features(np.concatenate([of, of, of, some]), cell.astype(np.int64), scripts, real)


@functools.lru_cache(maxsize=1)
def _marks() -> np.ndarray:
    return np.array([unicodedata.category(chr(c))[0] == "M" for c in range(sys.maxunicode + 1)])


def _is_letter(c: np.ndarray) -> np.ndarray:
    return ~_marks()[c]


def _some_texts(column: pa.Array, most: int) -> Iterator[tuple[int, list[str], list[list[str]]]]:
    """(first row, texts, their words) for runs of rows with about ``most`` words in all."""
    a, texts, held, n = 0, [], [], 0
    for b in range(len(column)):
        text = as_text(column.slice(b, 1))[0]
        found = words(text)
        if held and n + len(found) > most:
            yield a, texts, held
            a, texts, held, n = b, [], [], 0
        texts.append(text)
        held.append(found)
        n += len(found)
    if held:
        yield a, texts, held


def _ids(texts: list[list[str]]) -> tuple[_Ids, np.ndarray, np.ndarray]:
    """Distinct words, the number of every word, and the text that it belongs to."""
    known = _Ids()
    sizes = np.array([len(x) for x in texts], np.int64)
    ids = np.fromiter((known[x] for one in texts for x in one), np.int64, int(sizes.sum()))
    return known, ids, np.repeat(np.arange(len(texts)), sizes)


def _count(langs: list[str], cells: int):
    number = {x: k for k, x in enumerate(langs)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, scripts = np.zeros((len(langs), cells)), np.zeros((len(langs), _N))
        for batch in batches:
            of = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
            for a, _, texts in _some_texts(batch.column(1), SOME_WORDS):
                known, ids, text = _ids(texts)
                f = features(known, cells)
                for k in np.unique(of[a:a + len(texts)]):
                    times = np.bincount(ids[of[a + text] == k], minlength=len(known)).astype(float)
                    grams[k] += np.bincount(f.cell, weights=times[f.word], minlength=cells)
                    scripts[k] += times @ f.scripts
        both = np.concatenate([grams, scripts], axis=1).astype(np.int64)
        for k, row in enumerate(both):
            some = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k), pa.int32()), pa.array(some, pa.int32()),
                                              pa.array(row[some], pa.int64())], names=["lang", "cell", "n"])

    return run


class Model(NamedTuple):
    """Languages (sorted), log probability of every cell under each, and which scripts each is written in."""

    langs: list[str]
    score: np.ndarray
    written: np.ndarray

    def emissions(self, f: Features) -> np.ndarray:
        """Score of every distinct word under every language; languages not written in its script are barred."""
        n = len(f.real)
        out = np.zeros((n, len(self.langs)))
        letters_end = len(f.word) - len(np.unique(f.word))
        for k in range(len(self.langs)):
            of = self.score[f.cell, k]
            out[:, k] = (np.bincount(f.word[:letters_end], weights=of[:letters_end], minlength=n) / 3
                         + np.bincount(f.word[letters_end:], weights=of[letters_end:], minlength=n))
        allowed = self.written[:, f.scripts.argmax(axis=1)].T
        allowed[~allowed.any(axis=1)] = True                 # a script that no language is known to use bars none
        return np.where(allowed, out, _BARRED).astype(np.float32)


def fit(rows: DataFrame, lang: str = "lang", text: str = "text") -> Model | None:
    """Model of all ``rows`` with a language and a text; None without any. Over ``MAX_LANGS`` languages is an error."""
    known = rows.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"),
                                                                                  F.col(text).alias("text"))
    langs = sorted(r["lang"] for r in known.select("lang").distinct().limit(MAX_LANGS + 1).collect())
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not langs:
        return None
    cells = min(CELLS, 1 << (MODEL_CELLS // len(langs)).bit_length() - 1)
    counts = known.mapInArrow(_count(langs, cells), "lang int, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    found = counts.toArrow()                                 # at most languages x (cells + scripts), 8 M and a few, rows
    both = np.zeros((len(langs), cells + _N))
    both[found.column("lang").to_numpy(), found.column("cell").to_numpy()] = found.column("n").to_numpy()
    total = np.maximum(both[:, :cells].sum(axis=1, keepdims=True), 1)
    score = np.log((both[:, :cells] / total + SPREAD / cells) / (1 + SPREAD))
    share = both[:, cells:] / np.maximum(both[:, cells:].sum(axis=1, keepdims=True), 1)
    return Model(langs, np.ascontiguousarray(score.T.astype(np.float32)), share >= LEAST_SCRIPT)


def best_path(e: np.ndarray, ids: np.ndarray, sizes: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Viterbi labels of every word of texts side by side: ``e`` scores of distinct words, ``sizes`` words of each text.

    All texts step together, longest first. Staying goes before switching, and the smaller label before the larger.
    """
    order = np.argsort(-sizes, kind="stable")
    begin = (np.cumsum(sizes) - sizes)[order]
    size = sizes[order]
    longest = int(size.max(initial=0))
    active = np.searchsorted(-size, -np.arange(longest), "left")        # texts with more words than the step's number
    state = np.zeros((len(size), e.shape[1]), np.float64)
    left = np.zeros((len(ids), e.shape[1]), bool)            # came from another language, the best one
    best = np.zeros(len(ids), np.int32)
    for t in range(longest):
        n = int(active[t])
        at, v = begin[:n] + t, state[:n]
        if t:
            top = v.argmax(axis=1)
            other = v[np.arange(n), top][:, None] - switch
            best[at], left[at] = top, other > v
            np.maximum(v, other, out=v)
        v += e[ids[at]]
    label = np.zeros(len(ids), np.int32)
    now = np.zeros(len(size), np.int32)
    for t in range(longest - 1, -1, -1):
        n, ends = int(active[t]), int(active[t + 1]) if t + 1 < longest else 0
        now[ends:n] = state[ends:n].argmax(axis=1)
        at = begin[:n] + t
        label[at] = now[:n]
        now[:n] = np.where(left[at, now[:n]], best[at], now[:n])
    return label


def _places(text: str, found: list[str], wanted: list[int]) -> list[tuple[int, int]]:
    """(start, end) in code points of the words with the ``wanted`` numbers (ascending)."""
    out, at, k = [], 0, 0
    for n in wanted:
        while k <= n:
            start = text.index(found[k], at)
            at = start + len(found[k])
            k += 1
        out.append((start, at))
    return out


def _label(model: Model, texts: list[str], held: list[list[str]]) -> Iterator[tuple[str, float, list[dict]]]:
    known, ids, text = _ids(held)
    f = features(known, len(model.score))
    sized = f.scripts.sum(axis=1)
    real = f.real[ids]
    number = np.arange(len(ids)) - np.repeat(np.cumsum([len(x) for x in held]) - [len(x) for x in held], [len(x) for x in held])
    ids, text, number = ids[real], text[real], number[real]
    sizes = np.bincount(text, minlength=len(held))
    e = model.emissions(f)
    label = best_path(e, ids, sizes)
    n = len(model.langs)
    weight = np.bincount(text * n + label, weights=sized[ids], minlength=len(held) * n).reshape(len(held), n)
    first = np.cumsum(sizes) - sizes
    for k in range(len(held)):
        if not sizes[k]:
            yield UNKNOWN, 0.0, []
            continue
        a, b = first[k], first[k] + sizes[k]
        pred = int(weight[k].argmax())
        own = e[ids[a:b][label[a:b] == pred]].astype(np.float64).sum(axis=0)
        sure = 1 / np.exp(np.maximum(own - own[pred], -700)).sum() if own[pred] >= own.max() else 0.0
        turn = np.flatnonzero(label[a + 1:b] != label[a:b - 1])
        starts, ends = np.concatenate([[0], turn + 1]), np.concatenate([turn, [sizes[k] - 1]])
        wanted = np.unique(np.concatenate([starts, ends]))
        place = dict(zip(wanted.tolist(), _places(texts[k], held[k], number[a:b][wanted].tolist())))
        spans = [{"start": place[x][0], "end": place[y][1], "lang": model.langs[label[a + x]]}
                 for x, y in zip(starts.tolist(), ends.tolist())]
        yield model.langs[pred], float(sure * weight[k, pred] / weight[k].sum()), spans


SPANS = "array<struct<start:long,end:long,lang:string>>"


def _predict(model):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        most = min(SOME_WORDS, max(1, (SOME_WORDS * 16) // len(m.langs)))
        for batch in batches:
            for a, texts, held in _some_texts(batch.column(2), most):
                pred, score, spans = zip(*_label(m, texts, held))
                rows = batch.slice(a, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(spans, kind)],
                    names=["doc_id", "held_out", "lang_pred", "score", "spans"])

    return run


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 4, is 2 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def predict(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, spans (start, end in code points, language).

    Learns from the rows with a language and a text that are not held out; predicts from the text alone. ``score`` is
    the share of the text's letters in the language's spans times the language's probability there (languages taken as
    equally likely). Null text, text without a letter, or nothing to learn from: ``und``, 0 and no span; a
    text without spaces or of any length is taken whole; ids may repeat or be null, every row is predicted; an empty
    table gives an empty result; other columns are not read.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"),
                       F.col(lang).alias("lang"))
    model = fit(rows.filter(~F.col("held_out")))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
                           F.array().cast(SPANS).alias("spans"))
    shared = docs.sparkSession.sparkContext.broadcast(model)   # 8 M numbers at most
    return materialize(rows.select("doc_id", "held_out", "text").mapInArrow(
        _predict(shared), f"doc_id {kind}, held_out boolean, lang_pred string, score double, spans {SPANS}"), "languages")
