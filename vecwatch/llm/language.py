"""Language identification with spans.

Scripts of a word's letters (ranges of code points) narrow the languages that it can be of to those learned with that script. The score of a word in a language is the
log-likelihood of its character n-grams, word ends included, in hashed tables of n-gram shares. Viterbi over the words of a text, with a penalty per switch, labels
spans of one language each; the language with most letters is the text's.

Most texts are of one language. There the constant path is the best one if no run of words gains more than the penalty in any other language, which sums from the
left show for whole batches at once; only the other texts are walked word by word. Both give the same path.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from .common import mixed, packed, slices, small_side, stored
from .toxicity import held_out

SAMPLE_ROWS = 1000     # bound of the rows per language that a fit reads: those with the smallest hashes of their ids, whole texts
BUCKETS = 1 << 15
GRAMS = (1, 2, 3, 4)
SMOOTH = 0.5
SHARPNESS = 0.5        # n-grams of a word overlap, so their likelihoods count for less
SPREAD = 8.0           # most that one word can speak for one language against another
PENALTY = 12.0         # of a switch of language
SCRIPT_SHARE = 0.001   # share of a language's letters from which a script belongs to it
CACHED_WORDS = 200_000
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")

#: First code point of each range and its script (fixed values). A range ends where the next begins; "" takes part in no narrowing.
SCRIPTS = (
    (0x0000, "latin"), (0x0250, ""), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, ""), (0x0750, "arabic"), (0x0780, ""),
    (0x08A0, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "odia"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"),
    (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x13A0, ""), (0x1780, "khmer"), (0x1800, ""), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, ""), (0x3040, "kana"), (0x3100, ""), (0x3130, "hangul"), (0x3190, ""), (0x3400, "han"), (0xA000, ""),
    (0xAC00, "hangul"), (0xD7B0, ""), (0xF900, "han"), (0xFB00, ""), (0x20000, "han"), (0x32000, ""),
)
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS} - {""})
_STARTS = np.array([start for start, _ in SCRIPTS])
_NUMBERS = np.array([SCRIPT_NAMES.index(name) if name else -1 for _, name in SCRIPTS])


def scripts_of(code_points: np.ndarray) -> np.ndarray:
    """Number of each code point's script, -1 for none."""
    return _NUMBERS[np.searchsorted(_STARTS, code_points, side="right") - 1]


def grams(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the words with their ends marked, and the number of the word each comes from, in order of n."""
    line = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    edge = line == 32
    word = np.cumsum(edge) - 1  # a space counts to the word after it
    out, of = [], []
    for n in GRAMS:
        m = len(line) - n + 1
        if m <= 0:
            continue
        # an n-gram lies in one word and its two marks: only its first and last characters may be marks
        inner = np.zeros(m, bool)
        for i in range(1, n - 1):
            inner |= edge[i : i + m]
        at = np.flatnonzero(~inner if n > 1 else ~edge)
        if n == 2:
            at = at[~(edge[at] & edge[at + 1])]
        value = np.full(len(at), n, np.uint64)
        for i in range(n):
            value = value * np.uint64(0x100000001B3) + line[at + i]
        out.append((mixed(value) % np.uint64(buckets)).astype(np.int64))
        of.append(word[at])
    return (np.concatenate(out), np.concatenate(of)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


@dataclass
class Model:
    names: list[str]        # languages, ascending
    weights: np.ndarray     # buckets x languages: scaled log shares
    scripts: np.ndarray     # scripts x languages: the language is written in the script

    def parts(self) -> tuple:
        """What tasks are sent: plain values, so that executors need no copy of this module."""
        return self.names, self.weights, self.scripts

    def scores(self, words: list[str]) -> np.ndarray:
        """Score of every word in every language: 0 for the likeliest, down to -SPREAD; a language without the word's script is at -SPREAD if some language has it."""
        found, of = grams(words, len(self.weights))
        out = np.zeros((len(words), len(self.names)), np.float64)
        order = np.argsort(of, kind="stable")
        starts = np.searchsorted(of[order], np.arange(len(words)))
        if len(words):
            out = np.add.reduceat(self.weights[found[order]], starts, axis=0)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        letters = np.frombuffer("".join(words).encode("utf-32-le", "replace"), "<u4").astype(np.int64)
        kind, owner = scripts_of(letters), np.repeat(np.arange(len(words)), sizes)
        fits = np.ones(out.shape, bool)
        for s in np.unique(kind[kind >= 0]):
            if self.scripts[s].any():
                fits[owner[kind == s]] &= self.scripts[s]
        fits[~fits.any(axis=1)] = True
        out = np.where(fits, out, -np.inf)
        return np.maximum(out - out.max(axis=1, keepdims=True), -SPREAD) if len(words) else out


def viterbi(scores: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best path of language numbers through a (words x languages) table, with a penalty per switch. Ties: no switch, then the smaller number."""
    n, k = scores.shape
    came, now = np.empty((n, k), np.int32), scores[0].tolist()
    stay = list(range(k))
    for t, row in enumerate(scores[1:].tolist(), 1):
        best = max(range(k), key=now.__getitem__)
        floor = now[best] - penalty
        back = [j if now[j] >= floor else best for j in stay]
        now = [(now[j] if now[j] >= floor else floor) + row[j] for j in stay]
        came[t] = back
    path = np.empty(n, np.int32)
    path[-1] = max(range(k), key=now.__getitem__)
    for t in range(n - 1, 0, -1):
        path[t - 1] = came[t, path[t]]
    return path


def constant(ids: np.ndarray, starts: np.ndarray, table: np.ndarray, best: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Texts (runs of `ids`, rows of `table`, from each start) whose constant path in language `best` no other path can beat: no run of words gains more than the penalty."""
    sizes = np.diff([*starts, len(ids)])
    own = np.repeat(best, sizes)
    text = np.repeat(np.arange(len(starts)), sizes)
    good = np.ones(len(starts), bool)
    base = table[ids, own]
    for k in range(table.shape[1]):
        gain = table[ids, k] - base
        ahead = np.flatnonzero(good)
        if not np.any(np.maximum.reduceat(gain, starts) > 0):
            continue
        # a text has no run above the penalty if even its gaining words together stay below it
        total = np.add.reduceat(np.maximum(gain, 0), starts)
        for t in ahead[total[ahead] > penalty]:
            run = np.cumsum(gain[starts[t] : starts[t] + sizes[t]])
            lowest = np.minimum.accumulate(np.concatenate([[0.0], run]))[:-1]
            good[t] = (run - lowest).max() <= penalty
    return good


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS, label: str = "lang", buckets: int = BUCKETS) -> Model:
    """Learns from at most `rows` labelled rows of each language, whole texts: those with the smallest hashes of their ids; of several rows of an id and language the smallest text.

    N-grams and letters are counted in tasks; the driver gets one sum per language and bucket or script, so languages should be in the hundreds at most. Rows with a null label, id or text are not learned from.
    """
    known = docs.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    order = W.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id")
    names = known.select("doc_id", F.col(label).alias("y")).distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rows).drop("rank")
    texts = known.select("doc_id", F.col(label).alias("y"), "text").join(small_side(stored(names)), ["doc_id", "y"]).groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("y", "text")
    first_script = buckets

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, at_most=1 << 20):
                for y, text in zip(part.column("y").to_pylist(), part.column("text").to_pylist()):
                    words = WORD.findall(text.lower())
                    if not words:
                        continue
                    own = sums.setdefault(y, np.zeros(buckets + len(SCRIPT_NAMES), np.int64))
                    own[:buckets] += np.bincount(grams(words, buckets)[0], minlength=buckets)
                    kind = scripts_of(np.frombuffer("".join(words).encode("utf-32-le", "replace"), "<u4").astype(np.int64))
                    own[buckets:] += np.bincount(kind[kind >= 0], minlength=len(SCRIPT_NAMES))
        for y, own in sums.items():
            used = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([y] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(own[used])], names=["y", "b", "n"])

    sums = texts.mapInArrow(count, "y string, b int, n long").groupBy("y", "b").agg(F.sum("n").alias("n")).toPandas()
    labels = sorted(sums["y"].unique().tolist())
    table = np.zeros((buckets + len(SCRIPT_NAMES), len(labels)))
    for k, y in enumerate(labels):
        mine = sums[sums["y"] == y]
        table[mine["b"].to_numpy(), k] = mine["n"].to_numpy()
    seen, letters = table[:first_script] + SMOOTH, table[first_script:]
    shares = np.log(seen / seen.sum(axis=0)) * SHARPNESS if labels else seen
    return Model(labels, shares, letters >= SCRIPT_SHARE * np.maximum(letters.sum(axis=0), 1))


class _Table(dict):
    """Rows of word scores, worked out once per word while the table holds."""

    def __init__(self, model: Model):
        self.model, self.rows = model, np.zeros((0, len(model.names)))

    def ids(self, words: list[str]) -> np.ndarray:
        """Row numbers of the words, valid until the next call."""
        if len(self) > CACHED_WORDS:
            self.clear()
            self.rows = self.rows[:0]
        new = [w for w in dict.fromkeys(words) if w not in self]
        if new:
            self.update(zip(new, range(len(self), len(self) + len(new))))
            parts = [self.rows, *(self.model.scores(new[i : i + 20_000]) for i in range(0, len(new), 20_000))]
            self.rows = np.concatenate(parts)
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


SPANS = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("words", T.LongType()), T.StructField("letters", T.LongType())]))


def labelled(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """`docs` packed as `row`, with lang_pred, score and spans (language, first word from 0, words and letters) of its whole text.

    `score` is the share of letters in spans of the predicted language times its probability against the others by all words, damped by the root of their number.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.parts())
    rows = packed(docs)
    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", SPANS)])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        table, k = _Table(model), len(model.names)
        kind = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("words", pa.int64()), ("letters", pa.int64())]))
        for batch in batches:
            plain = pa.RecordBatch.from_arrays([batch.column("row"), batch.column("row").field("text")], names=["row", "text"])
            for part in slices(plain, at_most=1 << 20):
                texts = [WORD.findall(t.lower()) if t else [] for t in part.column("text").to_pylist()]
                filled = [i for i, words in enumerate(texts) if words and k]
                names, scores, spans = [UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts]
                if filled:
                    flat = [w for i in filled for w in texts[i]]
                    ids = table.ids(flat)
                    letters = np.fromiter(map(len, flat), np.int64, len(flat))
                    counts = np.array([len(texts[i]) for i in filled])
                    starts = np.cumsum(counts) - counts
                    totals = np.stack([np.add.reduceat(table.rows[ids, j], starts) for j in range(k)], axis=1)
                    best = totals.argmax(axis=1)
                    same = constant(ids, starts, table.rows, best, penalty)
                    for n, i in enumerate(filled):
                        a, b = starts[n], starts[n] + counts[n]
                        path = np.full(b - a, best[n]) if same[n] else viterbi(table.rows[ids[a:b]], penalty)
                        cuts = np.concatenate([[0], np.flatnonzero(np.diff(path)) + 1])
                        sizes = np.add.reduceat(letters[a:b], cuts)
                        of = np.bincount(path[cuts], sizes, minlength=k)
                        top = int(of.argmax())
                        gap = (totals[n] - totals[n, top]) / np.sqrt(counts[n])
                        names[i], scores[i] = model.names[top], float(of[top] / of.sum() / np.exp(np.minimum(gap, 50)).sum())
                        spans[i] = [{"lang": model.names[path[c]], "first_word": int(c), "words": int(e - c), "letters": int(s)} for c, e, s in zip(cuts, [*cuts[1:], b - a], sizes)]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, kind)], names=["row", "lang_pred", "score", "spans"])

    return rows.mapInArrow(label, schema)


def language(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of `docs`, and its number of spans; languages of held-out rows are not looked at.

    Null texts, empty ones and those without a letter are `und` with score 0 and no span, as is every text where no language could be learned. Only the text makes the
    prediction. Ties go to the smaller language name. Repeated rows score alike, extra columns are not read, an empty table gives no rows.
    """
    model = fit(docs.where(~held_out()), rows)
    out = labelled(docs.select("doc_id", "text"), model)
    return out.select("row.doc_id", held_out("row.doc_id").alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))
