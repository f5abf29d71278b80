"""Packing of tokenised documents into fixed windows by Karmarkar-Karp differencing.

A document is cut into whole windows and a rest; the rest is cut into parts of at most `part` tokens. Whole windows are
sequences as they are. Parts go to groups of about `windows` windows by hash. In each group, multiway differencing
splits the parts over the least number of windows that could hold them: partial partitions are merged two at a time,
largest spread first, with opposing imbalances, which leaves nearly equal windows. If one exceeds the capacity, the
number of windows rises by one and the group is split again.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import materialize

#: Words of the cache at most, and characters of a cached word at most; longer ones are encoded each time.
_CACHE_MOST, _WORD_MOST = 250_000, 64
#: A text is encoded in stretches of about so many characters, cut at spaces where that can't change the result.
_STRETCH = 1 << 18
#: A normaliser that only joins white space and lower-cases, and a step that changes nothing but the spelling of bytes.
_LOWER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
_LATIN = [chr(i) for i in range(256)]
_PROBES = ("It's I'm ALL we'll x'S, \"'s\" 'tis 3.14 word.,;word ***9*a're''d 12th\n\n(a)b_c<|a|>", "".join(_LATIN), " ".join(_LATIN), "".join(f"a{c}1{c}.{c}'s" for c in _LATIN))
_tokenizers: dict[str, WordTokenizer] = {}


def _class(kind: str) -> str:
    """The Latin-1 characters of a general category, for a regex class."""
    return "".join(f"\\x{i:02x}" for i, c in enumerate(_LATIN) if unicodedata.category(c)[0] == kind)


class WordTokenizer:
    """A tokenizer with a bounded cache from words to the little-endian bytes of their ids.

    Texts are taken apart only where the tokenizer's file says that it lower-cases, splits by a pattern that never
    crosses white space, and encodes each match by itself. Latin-1 texts are then split by that pattern here, and others
    are cut at spaces. For any other file, or if a probe comes out differently, the tokenizer encodes whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.of = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        self.special = [x["content"] for x in said.get("added_tokens") or []]
        vocabulary = self.of.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        self.pattern = self._pattern(said)
        if self.pattern is not None and self.encode(list(_PROBES)) != self._whole(list(_PROBES)):
            self.pattern = None

    @staticmethod
    def _pattern(said: dict) -> re.Pattern | None:
        steps = (said.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        regex = (steps[0].get("pattern") or {}).get("Regex", "")
        by_words = {"type": "Split", "pattern": {"Regex": regex}, "behavior": "Removed", "invert": True}
        if said.get("normalizer") != _LOWER or steps != [by_words, _BYTES] or said["model"].get("end_of_word_suffix") != "</w>":
            return None
        for name, chars in (("\\p{L}", _class("L")), ("\\p{N}", _class("N")), ("\\s", "\\x09-\\x0d\\x20\\x85\\xa0")):
            regex = regex.replace(name, chars)
        own = None if "\\p" in regex else re.compile(regex)
        return own if own is not None and not own.groups else None

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, as the tokenizer gives them for the whole text."""
        cut = [self._stretches(t) for t in texts]
        parts = [p for stretches in cut for p in stretches]
        split = [self._split(p) for p in parts]
        if len(self.words) > _CACHE_MOST:
            self.words = {}
        long = self._learn(set().union(*[w for w in split if w is not None]))
        get = self.words.__getitem__
        rest = iter(self._whole([p for p, w in zip(parts, split, strict=True) if w is None]))
        ids = iter([next(rest) if w is None else b"".join(map(get, w)) for w in split])
        for w in long:
            del self.words[w]
        return [next(ids) if len(stretches) == 1 else b"".join(next(ids) for _ in stretches) for stretches in cut]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.of.encode_batch(texts, add_special_tokens=False)]

    def _stretches(self, text: str) -> list[str]:
        """The text in parts, cut before spaces; whole if the tokenizer isn't known to split there."""
        out, at = [], 0
        while self.pattern is not None and len(text) - at > _STRETCH and (cut := text.find(" ", at + _STRETCH)) > 0:
            out.append(text[at:cut])
            at = cut
        return [*out, text[at:]]

    def _split(self, text: str) -> list[str] | None:
        """The words of Latin-1 text without special tokens, if the tokenizer's pattern is known; else None."""
        if self.pattern is None or any(x in text for x in self.special):
            return None
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        return self.pattern.findall(text.lower())

    def _learn(self, words: set[str]) -> list[str]:
        """Caches new words, many in one call (each ends with a token that ends a word); returns those too long to keep."""
        new = list(words.difference(self.words))
        for at in range(0, len(new), 1000):
            part = new[at : at + 1000]
            ids = np.array(self.of.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(cuts) == len(part):
                raw = ids.tobytes()
                found = [raw[4 * a : 4 * b] for a, b in zip([0, *cuts], cuts, strict=False)]
            else:
                found = self._whole(part)
            self.words.update(zip(part, found, strict=True))
        return [w for w in new if len(w) > _WORD_MOST]


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048, part: int = 512, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]) for each piece of each row: the text's ids and then end_id,
    cut into whole windows of `capacity` and a rest of pieces of at most `part`. tokenizer is a file of the tokenizers library."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    last = np.array([end_id], "<u4").tobytes()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _tokenizer(tokenizer)
        for b in it:
            texts = [x.as_py() or "" for x in b.column("text")]
            at = 0
            while at < len(texts):  # about 1 MB of text at a time
                end, size = at, 0
                while end < len(texts) and size < 1_000_000:
                    size += len(texts[end])
                    end += 1
                which, start, length, crc, total, ids = [], [], [], [], [], []
                for i, raw in enumerate(own.encode(texts[at:end]), at):
                    raw += last
                    n = len(raw) // 4
                    whole = n - n % capacity
                    for a, z in [*((k, k + capacity) for k in range(0, whole, capacity)), *((k, min(k + part, n)) for k in range(whole, n, part))]:
                        piece = raw[4 * a : 4 * z]
                        which.append(i)
                        start.append(a)
                        length.append(z - a)
                        crc.append(zlib.crc32(piece))
                        total.append(n)
                        if with_ids:
                            ids.append(np.frombuffer(piece, "<u4").astype(np.int32))
                columns = [b.column("doc_id").take(pa.array(which, pa.int64())), *[pa.array(x, pa.int64()) for x in (start, length, crc, total)]]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(ids, pa.list_(pa.int32()))] * with_ids], names)
                at = end

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(batches, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids)


def differencing(sizes: list[int], m: int) -> list[list[int]]:
    """Karmarkar-Karp for m sets: the places of `sizes` that each set holds."""
    heap = []
    for n, (i, size) in enumerate(sorted(enumerate(sizes), key=lambda x: (-x[1], x[0]))):
        sums = np.zeros(m, np.int64)
        sums[-1] = size
        heap.append((-size, n, sums, [*[()] * (m - 1), (i,)]))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, n, a, held_a = heapq.heappop(heap)
        _, _, b, held_b = heapq.heappop(heap)
        sums = a + b[::-1]  # the largest with the smallest
        held = [(x, y) if x and y else x or y for x, y in zip(held_a, reversed(held_b), strict=True)]
        order = np.argsort(sums, kind="stable")
        sums = sums[order] - sums[order[0]]
        heapq.heappush(heap, (-int(sums[-1]), n, sums, [held[k] for k in order.tolist()]))
    return [list(_flat(x)) for x in heap[0][3]] if heap else [[] for _ in range(m)]


def _flat(held: tuple) -> Iterator[int]:
    stack = [held]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            stack.extend(reversed(x))
        else:
            yield x


def fill(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows of at most `capacity`: as few as could hold all, one more whenever one exceeds it.

    Sizes far below the capacity are tied into bundles first, in the order given, so that a group of very many tiny
    parts has no more items than one of larger parts.
    """
    if not sizes:
        return []
    least = max(1, capacity // 64)
    bundles, size = [], least
    for i, x in enumerate(sizes):
        if size + x > least or x >= least:
            bundles.append([])
            size = 0
        bundles[-1].append(i)
        size += x
    tied = [sum(sizes[i] for i in b) for b in bundles]
    m = max(1, -(-sum(sizes) // capacity))
    while True:
        held = differencing(tied, m)
        if max(sum(tied[i] for i in x) for x in held) <= capacity:
            return [[j for i in x for j in bundles[i]] for x in held if x]
        m += 1


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048, part: int = 512, windows: int = 128, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids], sequence_id, offset) for every piece.

    Pieces of a sequence lie gapless from offset 0; a sequence has at most `capacity` tokens. A null or empty text is
    its end_id alone. Repeated rows and null ids are packed like any other row. An empty table gives no rows.
    Whole windows need no group. Other pieces go to groups by a hash of their row number in the pieces as written, which
    a lost task gives again; pieces that are alike are spread like others.
    """
    pieces = materialize(token_pieces(docs, tokenizer, end_id, capacity, part, with_ids, id_col, text_col), "pieces")
    own = pieces.columns
    rows = pieces.withColumn("row", F.monotonically_increasing_id())
    short = F.col("length") < capacity
    total = pieces.where(short).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    groups = max(1, -(-total // (windows * capacity)))

    def place(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.drop_columns("grp").sort_by([("length", "descending"), ("row", "ascending")]).drop_columns("row")
        sizes = rows["length"].to_pylist()
        window, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for k, held in enumerate(fill(sizes, capacity)):
            at = 0
            for i in held:
                window[i], offset[i] = k, at
                at += sizes[i]
        return rows.append_column("sequence_id", pa.array(window + (key[0].as_py() << 32))).append_column("offset", pa.array(offset))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    parts = rows.where(short).withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")).groupBy("grp").applyInArrow(place, schema)
    # Numbers of the two kinds never meet: the rows' are below, the groups' from 0 up.
    return parts.unionByName(rows.where(~short).select(*own, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
