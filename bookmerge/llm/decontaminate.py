"""Benchmark decontamination: one Aho-Corasick automaton over normalised items, scanning each text once.

Normalising maps bytes to bytes in place (A-Z to lower case, other ASCII outside words to blanks), so
an offset in the normalised words leads back to the original text. Words of the items become code points, and so an
item a string of them. Ten consecutive words always hold one of the item's blocks of five (those that begin at its
words 0, 5, 10, ...), so the automaton holds these blocks, with a node for a word at most, instead of all windows. Where a
block occurs, the words beside it are compared with the item's; ten words that agree are a window. Items of less than ten
words are patterns of their own, and so are windows all of whose blocks occur at more than ``HOT`` places.
The automaton is built once in each worker from the items, which are broadcast up to ``ITEM_BYTES`` of text (about 10
bytes of automaton a byte). A larger benchmark is scanned in parts of that size; the table is written between
them, so no worker holds more than one automaton. No step shuffles.

Edge cases: a null or word-free text has no words and is never contaminated; a null or word-free item
has no windows; items that share an id count once; rows that share a doc_id are judged each on its own;
a null item_id counts as the empty id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookmerge.llm._shared import in_pieces, pick, read, written

WINDOW = 10
#: Item text of one automaton.
ITEM_BYTES = 8 << 20
#: Places of a block from which windows do without it.
HOT = 64
#: Code points that stand for words: one a word, or two (of halves that do not meet) where there are more words.
POINTS = 1_000_000

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(raw: bytes | None) -> list[bytes]:
    return (raw or b"").translate(_WORDS).split()


def _point(n: int) -> str:
    return chr(n + 1 if n < 0xD7FF else n + 0x801)  # no surrogates, no 0


class Index:
    """The items of one pass: their words as code points, and the automaton over their patterns.

    A pattern's value is (number of words, items that it is a whole window of, places (item, word) where it is a block).
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW, points: int = POINTS, hot: int = HOT):
        import ahocorasick

        split = [words_of(text) for _, text in items]
        order = {w: n for n, w in enumerate(dict.fromkeys(w for ws in split for w in ws))}
        self.width = 1 if len(order) <= points else 2
        half = points // 2
        self.code = {w: _point(n) if self.width == 1 else _point(n // half) + _point(half + n % half) for w, n in order.items()}
        self.window, size = window, (window + 1) // 2
        self.lines = ["".join([self.code[w] for w in ws]) for ws in split]
        at = lambda line, i, n: line[i * self.width : (i + n) * self.width]
        places: dict[str, list[tuple[int, int]]] = {}
        whole: dict[str, set[int]] = {}
        for item, (line, ws) in enumerate(zip(self.lines, split, strict=True)):
            if 0 < len(ws) < window:
                whole.setdefault(line, set()).add(item)
            elif ws:
                for i in range(0, len(ws) - size + 1, size):
                    places.setdefault(at(line, i, size), []).append((item, i))
        crowded = {k for k, v in places.items() if len(v) > hot}
        if crowded:
            for item, (line, ws) in enumerate(zip(self.lines, split, strict=True)):
                for i in range(len(ws) - window + 1):
                    blocks = range(-(-i // size) * size, i + window - size + 1, size)
                    if all(at(line, b, size) in crowded for b in blocks):
                        whole.setdefault(at(line, i, window), set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for pattern in whole.keys() | (places.keys() - crowded):
            self.automaton.add_word(pattern, (len(pattern) // self.width, tuple(whole.get(pattern, ())), tuple(places[pattern]) if pattern in places and pattern not in crowded else ()))
        if len(self.automaton):
            self.automaton.make_automaton()

    def scan(self, raw: bytes | None) -> tuple[int, np.ndarray, set[int]]:
        """Number of words, which of them are hit, positions of the items that occur."""
        words = words_of(raw)
        n, width = len(words), self.width
        if not n or not len(self.automaton):
            return n, np.zeros(0, bool), set()
        code, unknown = self.code.get, "\0" * width
        line = "".join([code(w, unknown) for w in words])
        runs, items = [], set()
        for end, (size, whole, places) in self.automaton.iter(line):
            last = end // width
            first = last - size + 1
            if whole:
                runs.append((first, last + 1))
                items.update(whole)
            for item, at in places:
                left, right = self._beside(line, first, last + 1, self.lines[item], at, at + size)
                if left + size + right >= self.window:
                    runs.append((first - left, last + 1 + right))
                    items.add(item)
        hit = np.zeros(0, bool)
        if runs:
            marks = np.zeros(n + 1, np.int64)
            a, b = np.array(runs).T
            np.add.at(marks, a, 1)
            np.add.at(marks, b, -1)
            hit = np.cumsum(marks[:-1]) > 0
        return n, hit, items

    def _beside(self, x: str, a: int, b: int, y: str, c: int, d: int) -> tuple[int, int]:
        """How many words before a (and c) and from b (and d) on agree, as many as a window with this block can have."""
        w, most = self.width, self.window - (b - a)
        left = right = 0
        while left < min(most, a, c) and x[(a - left - 1) * w : (a - left) * w] == y[(c - left - 1) * w : (c - left) * w]:
            left += 1
        most = min(most, len(x) // w - b, len(y) // w - d)
        while right < most and x[(b + right) * w : (b + right + 1) * w] == y[(d + right) * w : (d + right + 1) * w]:
            right += 1
        return left, right


_indexes: dict[int, Index] = {}


def _index(key: int, items: list[tuple[str, bytes]], window: int) -> Index:
    """The worker's index, kept between tasks."""
    if key not in _indexes:
        _indexes.clear()
        _indexes[key] = Index(items, window)
    return _indexes[key]


def _spans(raw: bytes, hit: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of hit words: first and last code point (exclusive) in the original text, and the number of words."""
    norm = np.frombuffer(raw.translate(_WORDS), np.uint8) != 32
    starts = np.flatnonzero(norm & ~np.concatenate([[False], norm[:-1]]))
    ends = np.flatnonzero(norm & ~np.concatenate([norm[1:], [False]])) + 1
    points = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return [(int(points[starts[a]]), int(points[ends[b - 1]]), int(b - a)) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64())]))
_FOUND = "n_words long, n_hit long, hit_words binary, item_ids array<string>, spans array<struct<start:bigint,end:bigint,words:bigint>>"


def _pass(df: DataFrame, items: list[tuple[str, bytes]], window: int) -> DataFrame:
    """One narrow pass of one automaton; hits of earlier passes (hit_words, item_ids) are kept."""
    shared = df.sparkSession.sparkContext.broadcast(items)
    key = hash((window, tuple(items)))
    rest = [f for f in df.schema.fields if f.name not in ("n_words", "n_hit", "hit_words", "item_ids", "spans")]
    names = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        index = _index(key, known, window)
        for batch in batches:
            texts = batch.column("__text").cast(pa.binary()).to_pylist()
            before = zip(batch.column("hit_words").to_pylist(), batch.column("item_ids").to_pylist(), strict=True) if "hit_words" in batch.schema.names else ((None, None) for _ in texts)
            n_words, n_hit, bits, ids, spans = [], [], [], [], []
            for raw, (old_bits, old_ids) in zip(texts, before, strict=True):
                n, hit, found = index.scan(raw)
                if old_bits:
                    old = np.unpackbits(np.frombuffer(old_bits, np.uint8))[:n].astype(bool)
                    hit = hit | old if len(hit) else old
                n_words.append(n)
                n_hit.append(int(hit.sum()))
                bits.append(np.packbits(hit).tobytes() if hit.any() else None)
                ids.append(sorted({known[i][0] for i in found} | set(old_ids or ())))
                spans.append([{"start": a, "end": b, "words": w} for a, b, w in _spans(raw, hit)] if hit.any() else [])
            columns = [batch.column(c) for c in names] + [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(bits, pa.binary()), pa.array(ids, pa.list_(pa.string())), pa.array(spans, _SPAN)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "n_words", "n_hit", "hit_words", "item_ids", "spans"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), _FOUND])
    return df.mapInArrow(in_pieces(run), schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item_id: str = "item_id", item_texts: tuple[str, ...] = ("text",), window: int = WINDOW) -> DataFrame:
    """``keep`` columns of docs plus n_words, n_hit, item_ids (sorted), spans of hit runs in the original text.

    ``item_texts`` names the columns of an item that hold questions and answers; each is an item text of its own.
    """
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.explode(F.array(*(F.col(c) for c in item_texts))).alias("t")).where(F.col("t").isNotNull())
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, -(-total // ITEM_BYTES))
    found = docs.select(*(F.col(c) for c in keep), F.col(text).alias("__text"))
    for k in range(parts):
        items = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k)
        found = _pass(found, [(r["i"], r["t"].encode()) for r in items.toLocalIterator()], window)
        if k + 1 < parts:  # else Spark would run the passes, and hold their automata, side by side
            found = written(found, "scanned")
    return found.drop("hit_words")


def ids_digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(pick(read(spark, sf_dir, "documents"), "doc_id", "text"), pick(read(spark, sf_dir, "benchmark"), "item_id", "text"))
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), spans.alias("spans"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window, with the columns of docs."""
    names = docs.columns
    plain = [f"_c{i}" for i in range(len(names))]
    found = decontaminate(docs.toDF(*plain), pick(read(spark, sf_dir, "benchmark"), "item_id", "text"), text=plain[names.index("text")], keep=tuple(plain))
    return found.where(F.col("n_hit") == 0).select(*plain).toDF(*names)
