"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.words import held_out, mix
from citeloom.runtime import written

ORDER = 5  # characters of a gram
# Documented bounds of the classifier; predictions cover all rows and whole texts.
SAMPLE_PER_LANGUAGE = 1000  # documents a model is made from
CALIBRATION_PER_LANGUAGE = 500  # further ones that set the limit for rejection
MARGIN = 1.5  # of the highest excess seen in calibration
LEAST_EXCESS = 5.0  # bits times root of characters granted at least: few calibration texts differ little
LENGTH_CAP = 400  # characters beyond which a longer text does not tighten the limit
UNKNOWN = "und"
PIECE_VALUES = 8_000_000  # characters times languages that are scored at once

_MULTIPLIERS = mix(np.arange(101, 133, dtype=np.uint64)) | np.uint64(1)
_GRAMS = "lang int, high long, low long, n long"
_SCORED = "doc_id long, held_out boolean, lang string, n_letters long, best int, score double, entropy double, own double"


class Letters:
    """Characters as numbers: a letter is its lower-case code point, everything else 0."""

    def __init__(self):
        self.known = np.full(0x110000, -1, np.int32)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        out = self.known[points]
        if (out < 0).any():
            for p in np.unique(points[out < 0]).tolist():
                self.known[p] = p if chr(p).isalpha() else 0
            out = self.known[points]
        return out


def sequences(texts: list[str | None], letters: Letters) -> tuple[np.ndarray, np.ndarray]:
    """Letters of the texts, one 0 after each run of letters, and the length per text."""
    lowered = [t.lower() if t else "" for t in texts]
    ids = letters(np.frombuffer(("\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32))
    keep = ids > 0
    keep[1:] |= keep[:-1] & (ids[1:] == 0)
    ends = np.cumsum(np.fromiter(map(len, lowered), np.int64, len(lowered)) + 1)
    upto = np.concatenate([[0], np.cumsum(keep)])
    return ids[keep], np.diff(np.concatenate([[0], upto[ends]]))


def windows(ids: np.ndarray, counts: np.ndarray, order: int) -> np.ndarray:
    """A row per character: itself, then the ``order`` - 1 before it; 0 before the start of a text."""
    pad = order - 1
    at = np.arange(len(ids)) + (np.repeat(np.arange(len(counts)), counts) + 1) * pad
    whole = np.zeros(len(ids) + (len(counts) + 1) * pad, np.int32)
    whole[at] = ids
    return np.stack([whole[at - k] for k in range(order)])


def _hash(rows: np.ndarray, first: int, last: int) -> np.ndarray:
    """Hash of characters first..last-1 of every window."""
    out = np.zeros(rows.shape[1], np.uint64)
    for k in range(first, last):
        out += (rows[k].astype(np.uint64) + np.uint64(1)) * _MULTIPLIERS[k]
    return out


def _counter(order: int, index: dict[str, int]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters()
        for batch in batches:
            langs = np.array([index[x] for x in batch.column(0).to_pylist()], np.int32)
            texts = batch.column(1).to_pylist()
            for k in range(0, len(texts), 200):
                ids, counts = sequences(texts[k: k + 200], letters)
                if len(ids) == 0:
                    continue
                rows = windows(ids, counts, order).astype(np.int64)
                high, low = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
                for j in range(order):
                    side = high if j >= 3 else low
                    side |= rows[j] << (21 * (j % 3))
                lang = np.repeat(langs[k: k + 200], counts)
                found, n = np.unique(np.stack([lang.astype(np.int64), high, low]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found[0].astype(np.int32)), pa.array(found[1]), pa.array(found[2]), pa.array(n.astype(np.int64))],
                                                 names=["lang", "high", "low", "n"])

    return count


@dataclass
class Level:
    """Grams of one length in a sorted hash array, and the contexts one character shorter."""

    keys: np.ndarray
    logs: np.ndarray  # grams x languages: interpolated log2 probability
    contexts: np.ndarray
    weights: np.ndarray  # contexts x languages: log2 of what is left to shorter contexts


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place in a sorted array, -1 for none."""
    if len(keys) == 0:
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


@dataclass
class Models:
    """Models of all languages over shared sorted hash arrays."""

    languages: list[str]
    levels: list[Level]  # of 1, 2, ... characters
    uniform: float  # log2 probability of a character no model has seen

    def logs(self, rows: np.ndarray) -> np.ndarray:
        """log2 probability of every character by every language."""
        out = np.zeros((rows.shape[1], len(self.languages)), np.float32)
        open_ = np.arange(rows.shape[1])
        for length in range(len(self.levels), 0, -1):
            level = self.levels[length - 1]
            part = rows if len(open_) == rows.shape[1] else rows[:, open_]
            at = _find(level.keys, _hash(part, 0, length))
            hit = at >= 0
            out[open_[hit]] += level.logs[at[hit]]
            open_, part = open_[~hit], part[:, ~hit]
            if len(open_) == 0:
                return out
            context = _find(level.contexts, _hash(part, 1, length))
            seen = context >= 0
            out[open_[seen]] += level.weights[context[seen]]
        out[open_] += np.float32(self.uniform)
        return out

    def entropies(self, ids: np.ndarray, counts: np.ndarray, order: int) -> np.ndarray:
        """Bits per character, texts x languages; texts without letters have none."""
        out = np.zeros((len(counts), len(self.languages)))
        some = counts > 0
        if some.any():
            logs = self.logs(windows(ids, counts, order)).astype(np.float64)
            out[some] = -np.add.reduceat(logs, (np.cumsum(counts) - counts)[some], axis=0) / counts[some, None]
        return out


def kneser_ney(lang: np.ndarray, chars: np.ndarray, n: np.ndarray, languages: list[str]) -> Models:
    """Models from gram counts. ``chars``: characters x grams, the predicted one first.

    Full grams count occurrences, shorter ones distinct characters before them. A
    level's discount is n1 / (n1 + 2 n2) of each language's counts.
    """
    order, width = len(chars), len(languages)
    known = len(np.unique(chars[0])) if chars.size else 0
    uniform = 1.0 / (known + 1)
    tables = []  # (rows of characters, languages, counts) from long to short
    rows, who, count = chars, lang, n
    for length in range(order, 0, -1):
        tables.append((rows, who, count))
        if length > 1:
            packed = np.stack([who, *rows[: length - 1]])
            found, count = np.unique(packed, axis=1, return_counts=True)
            who, rows = found[0], found[1:]
    levels: list[Level] = []
    below = None
    for length, (rows, who, count) in enumerate(reversed(tables), 1):
        key, context = _hash(rows, 0, length), _hash(rows, 1, length)
        keys, first, at = np.unique(key, return_index=True, return_inverse=True)
        contexts, of = np.unique(context, return_inverse=True)
        c = np.zeros((len(keys), width))
        c[at, who] = count
        total, kinds = np.zeros((len(contexts), width)), np.zeros((len(contexts), width))
        np.add.at(total, (of, who), count)
        np.add.at(kinds, (of, who), 1)
        n1, n2 = (c == 1).sum(axis=0), (c == 2).sum(axis=0)
        discount = np.where(n1 + 2 * n2 > 0, n1 / np.maximum(n1 + 2 * n2, 1), 0.5)
        discount = np.clip(discount, 0.1, 0.9)
        left = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        here = of[first]
        if below is None:
            lower = np.full((len(keys), width), uniform)
        else:
            lower = below[1][_find(below[0], _hash(rows[:, first], 0, length - 1))]
        p = np.maximum(c - discount, 0) / np.maximum(total[here], 1) + left[here] * lower
        below = (keys, p)
        levels.append(Level(keys, np.log2(p).astype(np.float32), contexts, np.log2(left).astype(np.float32)))
    return Models(languages, levels, float(np.log2(uniform)))


def _scorer(models, order: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, levels, uniform = models.value
        model = Models(languages, [Level(*x) for x in levels], uniform)
        letters, width = Letters(), max(1, len(model.languages))
        index = {x: k for k, x in enumerate(model.languages)}
        for batch in batches:
            lengths = np.asarray(batch.column(3).fill_null("").to_pandas().str.len(), np.int64) if batch.num_rows else np.zeros(0, np.int64)
            first = 0
            while first < batch.num_rows:
                reach = np.searchsorted(np.cumsum(lengths[first:]), PIECE_VALUES // width, "right")
                last = first + max(1, int(reach))
                part = batch.slice(first, last - first)
                first = last
                ids, counts = sequences(part.column(3).to_pylist(), letters)
                if model.languages:
                    bits = model.entropies(ids, counts, order)
                    best = bits.argmin(axis=1)
                    lowest = bits[np.arange(len(best)), best]
                    share = 1 / np.exp2(lowest[:, None] - bits).sum(axis=1)
                    own = np.array([bits[i, index[x]] if x in index else np.nan for i, x in enumerate(part.column(2).to_pylist())], float)
                else:
                    best = np.zeros(len(counts), int)
                    lowest, share, own = np.zeros((3, len(counts)))
                nothing = (counts == 0) | (not model.languages)
                best, share = np.where(nothing, -1, best), np.where(nothing, 0.0, np.round(share, 6))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(counts), pa.array(best.astype(np.int32)), pa.array(share),
                     pa.array(np.round(lowest, 6)), pa.array(own)],
                    names=["doc_id", "held_out", "lang", "n_letters", "best", "score", "entropy", "own"])

    return score


def _sampled(table: DataFrame, languages: list[str], n: int) -> DataFrame | None:
    """At most ``n`` labelled rows of each language, by a hash of the id, numbered by ``place``."""
    out = None
    for x in languages:
        some = (table.where(F.col("lang") == x).select("doc_id", "lang").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
                .withColumn("learns", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)) < 2))
        out = some if out is None else out.unionByName(some)
    return out


def identify(docs: DataFrame, modulus: int = 4, remainder: int = 2, order: int = ORDER, sample: int = SAMPLE_PER_LANGUAGE,
             calibration: int = CALIBRATION_PER_LANGUAGE, margin: float = MARGIN) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, entropy, rejected.

    Models are fitted on labelled documents whose crc32(doc_id as text) mod
    ``modulus`` is not ``remainder``: of each language at most ``sample`` +
    ``calibration`` rows, of which two thirds make the model and one third the limit
    of rejection. The language with the lowest bits per character wins, ties to the
    first by name. ``score`` is its share of 2**-bits over all languages.
    ``rejected``: no letters, or more bits than calibration texts of that language
    ever needed (with a margin, by text length). Null texts and texts without
    letters are ``und`` with score 0; without labels all are. Rows without id are
    predicted and never learned from.
    """
    held = held_out(F.col("doc_id"), modulus, remainder)
    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("lang").cast("string").alias("lang"), "text")
    labelled = table.where(~F.col("held_out") & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    languages = sorted(r["lang"] for r in labelled.select("lang").distinct().collect())
    spark = docs.sparkSession
    limits: list[tuple[int, float, float]] = []
    if languages:
        chosen = written(_sampled(labelled, languages, sample + calibration), "language-sample")
        # At most languages * (sample + calibration) ids: a bounded table.
        texts = table.join(F.broadcast(chosen), ["doc_id", "lang"])
        index = {x: k for k, x in enumerate(languages)}
        counts = (texts.where("learns").select("lang", "text").mapInArrow(_counter(order, index), _GRAMS)
                  .groupBy("lang", "high", "low").agg(F.sum("n").alias("n")).toArrow())
        high, low = counts["high"].to_numpy(), counts["low"].to_numpy()
        chars = np.stack([((high if j >= 3 else low) >> (21 * (j % 3))) & 0x1FFFFF for j in range(order)])
        models = kneser_ney(counts["lang"].to_numpy().astype(np.int64), chars, counts["n"].to_numpy(), languages)
    else:
        models = Models([], [], 0.0)
    # plain arrays, so that a worker needs no class to read them
    sent = spark.sparkContext.broadcast((models.languages, [(x.keys, x.logs, x.contexts, x.weights) for x in models.levels], models.uniform))
    columns = ["doc_id", "held_out", "lang", "text"]
    if languages:
        tried = (texts.where(~F.col("learns")).select(*columns).mapInArrow(_scorer(sent, order), _SCORED)
                 .where("n_letters > 0").select("lang", "n_letters", "own").toArrow())
        lang, letters, own = tried["lang"].to_numpy(zero_copy_only=False), tried["n_letters"].to_numpy(), tried["own"].to_numpy()
        for k, x in enumerate(languages):
            mine = lang == x
            if mine.any():
                size = np.minimum(letters[mine], LENGTH_CAP)
                middle = float(np.average(own[mine], weights=size))
                limits.append((k, middle, margin * max(LEAST_EXCESS, float(((own[mine] - middle) * np.sqrt(size)).max()))))
    scored = table.select(*columns).mapInArrow(_scorer(sent, order), _SCORED)
    names = F.array(*[F.lit(x) for x in languages]) if languages else F.array(F.lit(UNKNOWN))
    limit = F.lit(float("inf"))
    for k, middle, excess in limits:
        near = middle + excess / F.sqrt(F.least("n_letters", F.lit(LENGTH_CAP)))
        limit = F.when(F.col("best") == k, near).otherwise(limit)
    return scored.select("doc_id", "held_out", F.when(F.col("best") < 0, UNKNOWN).otherwise(F.get(names, F.col("best"))).alias("lang_pred"),
                         "score", "entropy", ((F.col("best") < 0) | (F.col("entropy") > limit)).alias("rejected"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents that are not rejected; columns stay as they are.

    An id goes only if all its rows are rejected; rows without id go if they are
    rejected together.
    """
    gone = identify(docs).groupBy(F.col("doc_id").alias("_gone")).agg(F.min("rejected").alias("_all")).where("_all").select("_gone")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone"]), "left_anti")
