"""BPE encoding and decoding over a contiguous rank array.

A word's pieces are kept as boundaries, with the rank of every adjacent pair in an array beside them.
The smallest rank (leftmost on ties) is found by a scan, its boundary deleted, and the two ranks that
touched it are looked up again. Words of more than ``SCAN`` symbols, where repeated scans would cost
the square of the length, take the same merges from a heap; the result is equal.

The tokenizer file (its path is a parameter, and executors need it at that path) gives vocabulary,
merges, added tokens and the split pattern. Each task reads it once; encoded words are kept in a
table of bounded size, so memory does not grow with the corpus.

Null texts count as empty and give no tokens. Rows pass through in place, whatever their ids, repeats
or other columns; an added column replaces one of its name.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructField, StructType

from tablegraph.llm.frame import tuned

# Words that the scan handles; and encoded words that a worker keeps.
SCAN = 64
KEPT = 400_000

# Letters and numbers of the regex module's Unicode tables that were assigned after the
# tables (version 16) of the tokenizer library; there they are neither.
LATER = """
558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF
10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686
16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191
191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE
1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479
3D000-3FC3F
"""

# Lower cases that the library knows and Python's older tables don't.
LOWER = {
    0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB,
    0xA7DC: 0x19B, 0x1C89: 0x1C8A,
    **{c: c + 32 for c in range(0x10D50, 0x10D66)}, **{c: c + 27 for c in range(0x16EA0, 0x16EB9)},
    0x3A3: 0x3C3,  # one character at a time, sigma has one lower case
}


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where it prints, else the next from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def known_classes(pattern: str) -> str:
    """The pattern with letters and numbers as the tokenizer library's Unicode tables know them."""
    later = "".join(
        f"\\U{int(a, 16):08X}-\\U{int(b or a, 16):08X}"
        for a, _, b in (span.partition("-") for span in LATER.split())
    )
    for kind in (r"\p{L}", r"\p{N}"):
        pattern = pattern.replace(kind, f"[{kind}--[{later}]]")
    return pattern


def latin_classes(pattern: str) -> str:
    """The pattern for the standard library's matcher and texts below U+0250, with its classes spelt out."""
    below = [chr(c) for c in range(0x250)]
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        own = regex.compile(f"[{kind}]", regex.V1)
        pattern = pattern.replace(kind, "".join(f"\\u{ord(c):04x}" for c in below if own.match(c)))
    return pattern


def merge_short(parts: list[int], merges: dict[int, int], ranks: dict[int, int], size: int) -> list[int]:
    """Merge by scanning the array of adjacent ranks.

    ``parts`` numbers the symbol behind each boundary; a pair's key is ``first * size + second``, so a merge
    deletes one boundary and looks up the two keys that touch it.
    """
    none = len(ranks)
    get = ranks.get
    near = [get(a * size + b, none) for a, b in zip(parts, parts[1:])]
    while near:
        least = min(near)
        if least == none:
            break
        i = near.index(least)
        parts[i] = merges[parts[i] * size + parts[i + 1]]
        del parts[i + 1], near[i]
        if i:
            near[i - 1] = get(parts[i - 1] * size + parts[i], none)
        if i < len(near):
            near[i] = get(parts[i] * size + parts[i + 1], none)
    return parts


def merge_long(parts: list[str], rank: dict) -> list[str]:
    """The same merges in the same order from a heap of (rank, place), with linked neighbours."""
    parts = list(parts)
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:]))
            if (r := rank.get((a, b))) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i] if parts[i] else n
        if parts[i] != a or j >= n or parts[j] != b:
            continue  # one of the two has merged since
        parts[i], parts[j] = a + b, ""
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y < n and (r := rank.get((parts[x], parts[y]))) is not None:
                heapq.heappush(heap, (r, x, parts[x], parts[y]))
    return [p for p in parts if p]


class Codec:
    """Encoder and decoder of one tokenizer file of the word-ending byte kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab = model["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {tuple(m): i for i, m in enumerate(pairs)}
        self.suffix = model["end_of_word_suffix"]
        # Symbols by number, so that a pair is one integer.
        self.size = max(self.vocab.values()) + 1
        self.ranks = {self.vocab[a] * self.size + self.vocab[b]: i for (a, b), i in self.rank.items()}
        self.merges = {self.vocab[a] * self.size + self.vocab[b]: self.vocab[a + b] for a, b in self.rank}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added = added
        self.tokens = {i: t for t, i in (self.vocab | added).items()}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = split["pattern"]["Regex"]
        self.words = regex.compile(known_classes(pattern), regex.V1)
        self.latin = re.compile(latin_classes(pattern))
        self.beyond_latin = re.compile(r"[^\x00-\u024f]")
        self.specials = regex.compile(
            "(" + "|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True)) + ")"
        ) if added else None
        self.letters = byte_letters()
        self.inner = [self.vocab[x] for x in self.letters]
        self.last = [self.vocab[x + self.suffix] for x in self.letters]
        self.odd_capitals = re.compile("[" + "".join(map(chr, LOWER)) + "]")
        self.kept: dict[str, tuple[int, ...]] = {}

    def word(self, word: str) -> tuple[int, ...]:
        data = word.encode("utf-8")
        if len(data) <= SCAN:
            inner = self.inner
            parts = [inner[b] for b in data]
            parts[-1] = self.last[data[-1]]
            got = tuple(merge_short(parts, self.merges, self.ranks, self.size))
            if len(self.kept) >= KEPT:
                self.kept.clear()
            self.kept[word] = got
            return got
        names = [self.letters[b] for b in data]
        names[-1] += self.suffix
        return tuple(self.vocab[p] for p in merge_long(names, self.rank))

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for piece in self.specials.split(text) if self.specials else [text]:
            if piece in self.added:
                ids.append(self.added[piece])
                continue
            if not piece.isascii():
                piece = unicodedata.normalize("NFC", piece)
                if self.odd_capitals.search(piece):
                    piece = piece.translate(LOWER)
            piece = piece.lower()
            # No word of the pattern holds white space.
            found = (self.words if self.beyond_latin.search(piece) else self.latin).findall(piece)
            get, word = self.kept.get, self.word
            for w in found:
                ids += get(w) or word(w)
        return ids

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))


def mapped(df: DataFrame, path: str, source: str, targets: list[StructField], convert) -> DataFrame:
    """The rows with ``targets`` made from ``source`` in one pass; a task reads the tokenizer file once."""
    tuned(df.sparkSession)
    made = [t.name for t in targets]
    names = [f.name for f in df.schema.fields if f.name not in made]
    schema = StructType([*[f for f in df.schema.fields if f.name in names], *targets])

    def run(batches):
        own = Codec(path)
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            found = convert(own, batch.column(batch.schema.get_field_index(source)))
            yield pa.RecordBatch.from_arrays([*columns, *found], names=[*names, *made])

    return df.mapInArrow(run, schema)


def ids_of(own: Codec, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array, and where each text's end."""
    flat, ends = [], [0]
    for text in texts.to_pylist():
        if text:
            flat += own.encode(text)
        ends.append(len(flat))
    return np.array(flat, np.int32), np.array(ends, np.int32)


def id_bytes(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Each row's ids as little-endian unsigned 32-bit integers."""
    data, places = ids.astype("<u4").tobytes(), (4 * ends.astype(np.int64)).tolist()
    return pa.array([data[a:b] for a, b in zip(places, places[1:])], pa.binary())


def texts_of(own: Codec, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    flat, places = ids.tolist(), ends.tolist()
    return pa.array([own.decode(flat[a:b]) for a, b in zip(places, places[1:])], pa.string())


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Adds the token ids of each whole text as ``array<int>``."""

    def convert(own, texts):
        ids, ends = ids_of(own, texts)
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))]

    return mapped(df, path, text_col, [StructField(ids_col, ArrayType(IntegerType()))], convert)


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Adds the text of each row's ids: the tokens as the file spells them, one space between."""

    def convert(own, lists):
        return [pa.array([own.decode(ids or []) for ids in lists.to_pylist()], pa.string())]

    return mapped(df, path, ids_col, [StructField(text_col, StringType())], convert)


def round_trip(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids",
               bytes_col: str = "ids_bytes", decoded_col: str = "decoded") -> DataFrame:
    """Adds a text's ids, the ids as bytes, and the text that the bytes, read back, decode to, in one pass."""
    targets = [StructField(ids_col, ArrayType(IntegerType())), StructField(bytes_col, BinaryType()),
               StructField(decoded_col, StringType())]

    def convert(own, texts):
        ids, ends = ids_of(own, texts)
        stored = id_bytes(ids, ends)
        back = np.frombuffer(b"".join(stored.to_pylist()), "<u4").astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)), stored, texts_of(own, back, ends)]

    return mapped(df, path, text_col, targets, convert)

