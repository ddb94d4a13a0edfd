"""Fill-in-the-middle: cut texts into prefix, middle and suffix, and reorder them for infilling.

Bavarian et al., "Efficient Training of Language Models to Fill in the Middle", 2022. The cuts lie between units (lines,
sentences, words or single characters). A unit ends behind a character of certain classes, so units are counted and
located over the classes of the characters alone: the texts of a batch are joined and one wavelet matrix (Claude, Navarro
and Ordonez, 2015) holds the classes. A rank query per class and end of a text, added over the classes that end a unit,
gives the number of units; the end of the k-th one is found by a select query if one class ends units, else by bisection
on the added ranks. All texts of a batch are asked in one go.

Forms: `psm` is <P>prefix<S>suffix<M>middle, `spm` is <S>suffix<P>prefix<M>middle, `plain` the text as it is, which
empty texts and those that contain a mark keep. The first and second hash of the seeded digest of the key choose the
cuts, the third whether a text is transformed, the fourth the form. `restore` gives the text back from output and form.

Defined cases: a NULL text counts as empty, a NULL key as an empty one in the digest. Rows that share a key have the same
hashes, repeated rows the same output; nothing depends on other rows. Extra columns are kept by `transform`, whatever
their names. An empty table gives no rows. A text of any length is one row of one task and needs about ten bytes a
character there.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONG, STRING = T.LongType(), T.StringType()
# The marks, and the characters of each class; all others are of class 0.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CLASSES = {1: "\n", 2: " \t\x0b\x0c\r\x85\xa0\u2028\u2029\u3000", 3: ".!?…。！？", 4: ",;:、，；：", 5: ")]}»”’"}
LEVELS = 3
# The classes that end a unit.
UNITS = {"line": (1,), "sentence": (1, 3), "clause": (1, 3, 4), "word": (1, 2), "character": tuple(range(6))}
# Characters that are put into one matrix, unless one text is longer.
_BLOCK = 1 << 20


@dataclass(frozen=True)
class Infilling:
    """Where texts are cut, the percentage that is transformed, and of those the percentage in the form `spm`."""

    unit: str = "line"
    percent: int = 100
    spm_percent: int = 50
    seed: int = 7


class BitVector:
    """Bits in words of 64 with the number of ones before each word; answers arrays of rank and select queries."""

    def __init__(self, bits: np.ndarray):
        self.size = len(bits)
        padded = np.zeros((self.size // 64 + 1) * 8, np.uint8)
        packed = np.packbits(bits, bitorder="little")
        padded[: len(packed)] = packed
        self.words = padded.view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))
        self.ones = int(self.before[-1])

    def rank1(self, at: np.ndarray) -> np.ndarray:
        """The number of ones among the first `at` bits."""
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << rest) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below)

    def select(self, bit: int, k: np.ndarray) -> np.ndarray:
        """The place of the k-th such bit, counted from 0; it must exist."""
        before = self.before if bit else np.arange(len(self.before)) * 64 - self.before
        word = np.searchsorted(before, k, side="right") - 1
        words = self.words[word] if bit else ~self.words[word]
        left = k - before[word]
        place = np.zeros(len(k), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            half = words & np.uint64((1 << width) - 1)
            ones = np.bitwise_count(half).astype(np.int64)
            up = left >= ones
            left = np.where(up, left - ones, left)
            place += np.where(up, width, 0)
            words = np.where(up, words >> np.uint64(width), half)
        return word * 64 + place


class WaveletMatrix:
    """A sequence of small symbols, one bit vector per binary digit from the highest on, each level sorted by the last."""

    def __init__(self, symbols: np.ndarray, levels: int = LEVELS):
        self.levels, self.size = [], len(symbols)
        for level in range(levels - 1, -1, -1):
            bits = symbols >> level & 1
            self.levels.append(BitVector(bits))
            symbols = np.concatenate((symbols[bits == 0], symbols[bits == 1]))

    def _digits(self, symbol: int):
        for number, bits in enumerate(self.levels):
            yield bits, symbol >> (len(self.levels) - 1 - number) & 1

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often the symbol occurs among the first `at` ones."""
        low, high = np.zeros_like(at), at
        for bits, digit in self._digits(symbol):
            ones_low, ones_high = bits.rank1(low), bits.rank1(high)
            if digit:
                zeros = bits.size - bits.ones
                low, high = zeros + ones_low, zeros + ones_high
            else:
                low, high = low - ones_low, high - ones_high
        return high - low

    def select(self, symbol: int, k: np.ndarray) -> np.ndarray:
        """The place of the k-th occurrence, counted from 0; it must exist."""
        low = np.zeros(1, np.int64)
        for bits, digit in self._digits(symbol):
            ones = bits.rank1(low)
            low = bits.size - bits.ones + ones if digit else low - ones
        place = low + k
        for bits, digit in reversed(list(self._digits(symbol))):
            place = bits.select(digit, place - (bits.size - bits.ones) * digit)
        return place


@lru_cache(1)
def _class_table() -> np.ndarray:
    table = np.zeros(1 << 16, np.uint8)
    for number, characters in CLASSES.items():
        table[[ord(c) for c in characters]] = number
    return table


def class_codes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return _class_table()[np.minimum(codes, 0xFFFF)]


class Units:
    """The units of texts that lie one after the other, text i between `edges[i]` and `edges[i + 1]`."""

    def __init__(self, texts: list[str], unit: str):
        self.ending = UNITS[unit]
        self.edges = np.cumsum([0, *map(len, texts)])
        self.matrix = WaveletMatrix(class_codes("".join(texts)))
        self.before = self._ends(self.edges)
        whole = self.before[1:] - self.before[:-1]
        # What follows the last end of a unit is one more.
        starts, ends = self.edges[:-1], self.edges[1:]
        filled = ends > starts
        last = self._ends(np.maximum(ends - 1, 0))
        open_end = filled & (self.before[1:] == last)
        self.closed, self.counts = whole, whole + open_end

    def _ends(self, at: np.ndarray) -> np.ndarray:
        """The number of characters that end a unit among the first `at`."""
        return sum(self.matrix.rank(symbol, at) for symbol in self.ending)

    def cut(self, k: np.ndarray) -> np.ndarray:
        """For each text the number of its characters in its first `k` units."""
        sizes = np.diff(self.edges)
        found = np.where(k > 0, sizes, 0)
        inner = np.flatnonzero((k > 0) & (k <= self.closed))
        if len(inner):
            wanted = self.before[inner] + k[inner] - 1
            if len(self.ending) == 1:
                place = self.matrix.select(self.ending[0], wanted)
            else:
                place = self._bisect(wanted, self.edges[inner], self.edges[inner + 1] - 1)
            found[inner] = place + 1 - self.edges[inner]
        return found

    def _bisect(self, wanted: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The place of the end of a unit that has `wanted` ends before it."""
        low, high = low.copy(), high.copy()
        while (low < high).any():
            middle = (low + high) // 2
            passed = self._ends(middle + 1) > wanted
            high, low = np.where(passed, middle, high), np.where(passed, low, middle + 1)
        return low


def _arranged(texts: list[str], hashes: np.ndarray, how: Infilling):
    """(n, form, prefix_chars, middle_chars, output) of each text."""
    units = Units(texts, how.unit)
    counts = units.counts
    chosen = hashes[:, :2] % (counts + 1)[:, None]
    first, second = units.cut(chosen.min(axis=1)), units.cut(chosen.max(axis=1))
    transformed, spm = hashes[:, 2] % 100 < how.percent, hashes[:, 3] % 100 < how.spm_percent
    for text, n, a, b, change, turned in zip(texts, *(c.tolist() for c in (counts, first, second, transformed, spm))):
        if not change or not text or PREFIX in text or SUFFIX in text or MIDDLE in text:
            yield n, "plain", None, None, text
            continue
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        if turned:
            yield n, "spm", a, b - a, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
        else:
            yield n, "psm", a, b - a, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def transform(rows: DataFrame, how: Infilling = Infilling(), key: str = "key", text: str = "text") -> DataFrame:
    """(row, n, form, prefix_chars, middle_chars, output) for each row, `row` being the given columns without the text.

    `n` is the number of units. Lengths are in code points, NULL for plain texts.
    """
    others = [F.col(c) for c in rows.columns if c != text]
    digest = F.sha2(F.concat(F.lit(f"{how.seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    hashed = rows.select(F.struct(*others).alias("row"), F.coalesce(text, F.lit("")).alias("text"), digest.alias("digest"))

    def run(batches):
        import pyarrow as pa

        kinds = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())]
        for batch in batches:
            texts, low, held = batch.column("text").to_pylist(), 0, 0
            digests = batch.column("digest").to_pylist()
            hashes = np.array([[int(d[i : i + 8], 16) for i in range(0, 32, 8)] for d in digests], np.int64).reshape(-1, 4)
            for high, one in enumerate(texts, 1):
                held += len(one)
                if held >= _BLOCK or high == len(texts):
                    made = list(zip(*_arranged(texts[low:high], hashes[low:high], how)))
                    columns = [pa.array(c, kind) for c, (_, kind) in zip(made, kinds)]
                    yield pa.record_batch([batch.column("row").slice(low, high - low), *columns], names=["row", *(n for n, _ in kinds)])
                    low, held = high, 0

    schema = hashed.select("row").schema
    for name, kind in (("n", LONG), ("form", STRING), ("prefix_chars", LONG), ("middle_chars", LONG), ("output", STRING)):
        schema = schema.add(name, kind)
    return hashed.mapInArrow(run, schema)


def restore(output: Column, form: Column) -> Column:
    """The text of an output. A mark is found where it stands first, as no piece of a transformed text holds one."""
    lead = {"psm": (PREFIX, SUFFIX), "spm": (SUFFIX, PREFIX)}

    def rebuilt(name: str) -> Column:
        opening, second = lead[name]
        between, last = F.locate(second, output), F.locate(MIDDLE, output)
        a = F.substring(output, F.lit(len(opening) + 1), between - len(opening) - 1)
        b = F.substring(output, between + len(second), last - between - len(second))
        middle = F.substring(output, last + len(MIDDLE), F.length(output))
        return F.concat(a, middle, b) if name == "psm" else F.concat(b, middle, a)

    return F.when(form == "psm", rebuilt("psm")).when(form == "spm", rebuilt("spm")).otherwise(output)


def oracle(how: Infilling = Infilling()) -> str:
    """SQL for the digests of transformed documents, cut at lines."""
    h = [f"('0x' || substr(sha256('{how.seed}:' || doc_id), {i}, 8))::BIGINT" for i in (1, 9, 17, 25)]
    marked = " OR ".join(f"contains(t, '{m}')" for m in (PREFIX, SUFFIX, MIDDLE))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u FROM documents
), c AS (SELECT *, len(u) AS n, {h[0]} % (len(u) + 1) AS i, {h[1]} % (len(u) + 1) AS j FROM d
), p AS (
  SELECT *, array_to_string(u[1:least(i, j)], '') AS a, array_to_string(u[least(i, j) + 1:greatest(i, j)], '') AS m,
         array_to_string(u[greatest(i, j) + 1:], '') AS z,
         CASE WHEN t = '' OR {marked} OR {h[2]} % 100 >= {how.percent} THEN 'plain'
              WHEN {h[3]} % 100 < {how.spm_percent} THEN 'spm' ELSE 'psm' END AS form
  FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || a || '{SUFFIX}' || z || '{MIDDLE}' || m
              ELSE '{SUFFIX}' || z || '{PREFIX}' || a || '{MIDDLE}' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
