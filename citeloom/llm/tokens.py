"""Token counts under a unigram model, with one forward pass per shared prefix of words."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.words import byte_tables, cut, per_document, text_bytes, words

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
WORD_MARK = "▁"  # stands for the space before a word in the vocabulary
BYTE_PENALTY = 10.0  # how much less likely a byte piece is than the rarest piece
GROUP_BYTES = 16_000_000

_COUNTED = "doc_id long, n_words long, n_tokens long"


def load_vocabulary(path: str = VOCABULARY) -> dict[str, float]:
    """Log probabilities of the pieces of a vocabulary file.

    Such a file orders its pieces by merge rank; a piece of rank r gets the weight
    1 / (r + 1), normalised (Zipf's law). Control, unknown and byte pieces are no
    pieces of text.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    kept.sort(key=lambda i: (-model.get_score(i), i))
    whole = math.log(sum(1 / (r + 1) for r in range(len(kept))))
    return {model.id_to_piece(i): -math.log(r + 1) - whole for r, i in enumerate(kept)}


def by_ending(pieces: dict[str, float]) -> dict[str, float | None]:
    """Pieces, and all their endings that are no pieces themselves (None): a backward search stops where neither holds."""
    table: dict[str, float | None] = {}
    for p in pieces:
        for k in range(1, len(p)):
            table.setdefault(p[k:], None)
    table.update(pieces)
    return table


def count_tokens(sorted_words: Iterable[str], table: dict[str, float | None], byte_log: float) -> list[int]:
    """Tokens of the most likely segmentation of every word; equal scores go to fewer tokens.

    Sorted words are a walk through their trie: the forward scores of a prefix that
    a word shares with the one before are kept, only the rest is computed. A
    character that is no piece costs its UTF-8 bytes.
    """
    best, used = [0.0], [0]
    before = ""
    out = []
    for word in sorted_words:
        shared, most = 0, min(len(word), len(before))
        while shared < most and word[shared] == before[shared]:
            shared += 1
        del best[shared + 1:], used[shared + 1:]
        for end in range(shared + 1, len(word) + 1):
            top, n = -math.inf, 0
            for start in range(end - 1, -1, -1):
                log = table.get(word[start:end], 0.0)
                if log is None:
                    continue
                if log == 0.0:
                    break
                score = best[start] + log
                if score > top or score == top and used[start] + 1 < n:
                    top, n = score, used[start] + 1
            if table.get(word[end - 1]) is None:
                size = len(word[end - 1].encode("utf-8", "surrogatepass"))
                score = best[end - 1] + size * byte_log
                if score > top or score == top and used[end - 1] + size < n:
                    top, n = score, used[end - 1] + size
            best.append(top)
            used.append(n)
        out.append(used[len(word)])
        before = word
    return out


def _counter(vocabulary, byte_log: float):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = by_ending(vocabulary.value)
        for batch in batches:
            for group in cut(*text_bytes(batch.column(1)), GROUP_BYTES):
                hashes, slices, sizes = [], [], []
                for piece in cut(group.offsets, group.data):
                    found = words(piece, byte_tables(lower=False))
                    at = int(group.offsets[piece.first])
                    hashes.append(found.hashes)
                    slices.append(np.stack([found.starts + at, found.ends + at]))
                    sizes.append(np.diff(found.first))
                n_words = np.concatenate(sizes)
                _, first, inverse = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
                raw, spans = group.data.tobytes(), np.concatenate(slices, axis=1)[:, first]
                texts = [WORD_MARK + raw[a:b].decode("utf-8", "replace") for a, b in zip(*spans.tolist(), strict=True)]
                order = sorted(range(len(texts)), key=texts.__getitem__)
                counts = np.zeros(len(texts), np.int64)
                counts[order] = count_tokens([texts[i] for i in order], table, byte_log)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(group.first, group.documents), pa.array(n_words), pa.array(per_document(counts[inverse], n_words, np.add, 0))],
                    names=["doc_id", "n_words", "n_tokens"])

    return count


def token_counts(docs: DataFrame, vocabulary: dict[str, float] | None = None, path: str = VOCABULARY) -> DataFrame:
    """One row per document: doc_id, n_words, n_tokens.

    A text is cut at white space (space, tab to carriage return); every word, with
    the word mark before it, is segmented on its own. Distinct words of a group of
    texts are segmented once. Null and empty texts have no tokens. Nothing is
    shuffled; the vocabulary, as large as its file, is broadcast. Only the driver
    reads the file.
    """
    vocabulary = load_vocabulary(path) if vocabulary is None else vocabulary
    byte_log = min(vocabulary.values(), default=0.0) - BYTE_PENALTY
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_counter(sent, byte_log), _COUNTED)
