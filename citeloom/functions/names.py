"""Name comparison: prefix, acronym and containment variants as column expressions,
edit ratios as Arrow-batched helpers."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.functions.text import norm_name

# Words an acronym skips.
ACRONYM_STOPWORDS = ("a", "an", "the", "of", "for", "from", "and", "to", "in", "on", "with")


def _by_length(a: Column, b: Column) -> tuple[Column, Column]:
    first = F.length(a) <= F.length(b)
    return F.when(first, a).otherwise(b), F.when(first, b).otherwise(a)


def _letter_at(text: Column, position: Column) -> Column:
    return F.substring(text, position, F.lit(1)).rlike(r"^\p{L}$")


def is_prefix_variant(a: Column, b: Column) -> Column:
    """The shorter name starts the longer one and no letter follows it."""
    short, long = _by_length(norm_name(a), norm_name(b))
    return (F.length(short) >= 2) & F.startswith(long, short) & ~_letter_at(long, F.length(short) + 1)


def acronym(name: Column) -> Column:
    """Upper-case initials of the significant words; null with fewer than two."""
    words = F.filter(
        F.regexp_extract_all(name, F.lit("[A-Za-z]+"), F.lit(0)),
        lambda w: ~F.lower(w).isin(*ACRONYM_STOPWORDS),
    )
    letters = F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))
    return F.when(F.size(words) >= 2, letters)


def is_acronym_variant(a: Column, b: Column) -> Column:
    short, long = _by_length(a, b)
    return (
        (F.length(short) >= 2)
        & short.rlike(r"^\p{L}+$")
        & F.coalesce(acronym(long) == F.upper(short), F.lit(False))
    )


def is_contained(a: Column, b: Column) -> Column:
    """The shorter name's first occurrence in the longer one has no letter beside it."""
    short, long = _by_length(norm_name(a), norm_name(b))
    at = F.instr(long, short)
    before_ok = (at == 1) | ~_letter_at(long, at - 1)
    return (
        (F.length(short) >= 2) & (short != long) & (at > 0)
        & before_ok & ~_letter_at(long, at + F.length(short))
    )


def sequence_ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def normalised_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio; the order of the arguments matters."""
    return pd.Series([sequence_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def ratio_above(a: Column, b: Column, floor: float) -> Column:
    """Matching-blocks ratio where it is above ``floor``, else 0.

    Matching blocks are a common subsequence, so its longest one bounds the ratio;
    only pairs it leaves open are compared block by block.
    """

    def score(x: str, y: str) -> float:
        total = len(x) + len(y)
        if total and 2 * lcs_length(x, y) / total <= floor:
            return 0.0
        found = sequence_ratio(x, y)
        return found if found > floor else 0.0

    @F.pandas_udf(T.DoubleType())
    def scores(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([score(p, q) for p, q in zip(x, y)], dtype="float64")

    return scores(a, b)


SIGNATURE_WORDS, LEVELS = 4, 8  # 32 classes of letters, counted up to 8


def _signature(name: str) -> list[int]:
    words = [0] * SIGNATURE_WORDS
    for kind, held in Counter(ord(ch) % (SIGNATURE_WORDS * LEVELS) for ch in name).items():
        words[kind // LEVELS] |= ((1 << min(held, LEVELS)) - 1) << (LEVELS * (kind % LEVELS))
    return [w - (1 << 64) if w >> 63 else w for w in words]


@F.pandas_udf(T.ArrayType(T.LongType()))
def letter_signature(name: pd.Series) -> pd.Series:
    """How often letters of each class occur, up to a level, in unary: an array of longs.

    An insertion or deletion changes one count by one, so the bits in which two
    names differ are at most their edits.
    """
    return name.map(_signature)


def signature_distance(a: Column, b: Column) -> Column:
    """Bits in which two signatures differ: at most the edits between the names."""
    return sum((F.bit_count(a[j].bitwiseXOR(b[j])) for j in range(SIGNATURE_WORDS)), F.lit(0))


def name_similarity(a: Column, b: Column) -> Column:
    """1.0 for the three naming patterns, else the ratio of the normalised names."""
    pattern = is_prefix_variant(a, b) | is_acronym_variant(a, b) | is_contained(a, b)
    return F.when(pattern, F.lit(1.0)).otherwise(normalised_ratio(norm_name(a), norm_name(b)))


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, bit-parallel over the first argument."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    state = full
    for ch in b:
        hit = state & masks.get(ch, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """Insert/delete similarity on a scale of 0 to 100."""
    total = len(a) + len(b)
    return 100.0 if total == 0 else 200.0 * lcs_length(a, b) / total


def _masks(text: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, ch in enumerate(text):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    return masks


def _prefix_lcs(masks: dict[str, int], size: int, text: str) -> Iterator[int]:
    """Longest common subsequence of the masked string with every prefix of ``text``, in one pass."""
    full = state = (1 << size) - 1
    for ch in text:
        hit = state & masks.get(ch, 0)
        state = ((state + hit) | (state - hit)) & full
        yield size - state.bit_count()


def _whole_lcs(masks: dict[str, int], size: int, text: str) -> int:
    full = state = (1 << size) - 1
    for ch in text:
        hit = state & masks.get(ch, 0)
        if hit:
            state = ((state + hit) | (state - hit)) & full
    return size - state.bit_count()


def best_window_ratio(a: str, b: str, enough: float = 100.0, least: float = 0.0) -> float:
    """Best indel ratio of the shorter string against the windows of the longer.

    Windows have the shorter string's length and shrink at both ends. The search
    stops once ``enough`` is reached: a caller testing a floor needs no more, and
    may say with ``least`` that ratios below it need not be told apart.

    All shrunk windows of one end cost one pass. A window moved by one place
    gains at most one common letter, so a whole window that misses the count it
    needs by some letters rules out as many of its neighbours on both sides.
    """
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    m, n = len(short), len(long)
    if m == 0:
        return 100.0 if n == 0 else 0.0
    if short in long:
        return 100.0
    letters, masks = set(short), _masks(short)
    best = 0.0

    # a window is best aligned when it starts or ends on a shared character
    for i, common in enumerate(_prefix_lcs(masks, m, long[:m - 1])):
        if long[i] in letters:
            best = max(best, 200.0 * common / (m + i + 1))
            if best >= enough:
                return best
    back = _masks(short[::-1])
    for i, common in enumerate(_prefix_lcs(back, m, long[:n - m:-1])):
        if long[n - 1 - i] in letters:
            best = max(best, 200.0 * common / (m + i + 1))
            if best >= enough:
                return best
    if m == n:
        for one, pieces in ((_masks(long), short[:m - 1]), (_masks(long[::-1]), short[:0:-1])):
            best = max(best, max((200.0 * c / (m + i + 1) for i, c in enumerate(_prefix_lcs(one, m, pieces))), default=0.0))

    def needed() -> int:
        """Common letters with which a whole window is better than the best, and no less than ``least``."""
        count = max(0, int(max(best, least) * m / 100) - 1)
        while 200.0 * count / (2 * m) <= best or 200.0 * count / (2 * m) < least:
            count += 1
        return count

    asked, spans = needed(), [(0, n - m)]
    while spans and best < enough and asked <= m:
        low, high = spans.pop()
        if low > high:
            continue
        at = (low + high) // 2
        common = _whole_lcs(masks, m, long[at:at + m])
        if common >= asked and (long[at + m - 1] if at < n - m else long[at]) in letters:
            best = 200.0 * common / (2 * m)
            asked = needed()
        reach = max(0, asked - common - 1)  # no window so near can do
        spans += [(at + 1 + reach, high), (low, at - 1 - reach)]
    return best


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_ratio(x or "", y or "") for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([best_window_ratio(x or "", y or "") for x, y in zip(a, b)], dtype="float64")


def grounded(text: Column, source: Column, floor: float) -> Column:
    """partial_ratio(text, source) >= floor; verbatim text is settled without Python."""

    @F.pandas_udf(T.BooleanType())
    def reaches(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([best_window_ratio(x, y, floor, floor) >= floor for x, y in zip(a, b)], dtype="bool")

    verbatim = F.contains(source, text)
    # rows settled on the JVM side pass empty strings to the helper
    asked = F.when(verbatim, F.lit("")).otherwise(F.coalesce(text, F.lit("")))
    against = F.when(verbatim, F.lit("")).otherwise(F.coalesce(source, F.lit("")))
    return F.coalesce(verbatim, F.lit(False)) | reaches(asked, against)
