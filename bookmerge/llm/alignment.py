"""Alignment of two tokenizers over the corpus: each distinct text once, pair counts by multiplicity, measures back to doc_ids.

Rows are grouped by their full text (its SHA-256), so copies, however many, are counted before the shuffle and one text of
each group travels. Each distinct text is cut where one blank stands between two characters that are no white space. No token
of either tokenizer spans such a place: the byte-level one starts a pre-token there, and no piece of the other has a blank behind
another character (the constructor looks). So a block of texts encodes each of its distinct parts once, all in a few calls, and the offsets where
tokens of both end are one sorted intersection for the whole block.

Corpus-wide counts: each block gives its distinct id pairs with the number of documents (copies included), these are
summed by pair, and the sums go back to the blocks that asked, once a pair and block, never once a text. Highest counts of an A id are one more
grouping. Nothing is broadcast. A block is bounded by its texts' bytes; one long text is worked off in parts.

Edge cases: a null or empty text, or one whose pieces' bytes differ from the text with a blank before it (as with U+2581), has no tokens: zeros
and ''. Repeated rows count as documents of their own; rows keep their doc_id, null or not.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookmerge.llm._shared import pick, read, written

#: Characters of text that make a block, and that are worked on at once; both bound a task's memory.
BLOCK, PART = 8 << 20, 4 << 20
#: Characters that go to a tokenizer in one call.
CALL = 1 << 18
#: Id pairs in a row of a block's list.
LIST = 4096
#: Links of a group up to which they are told apart one by one; beyond it the group's ids are counted first.
SINGLE = 1 << 10

_CLEAN = re.compile(r"(?<=\S) (?=\S)")


class _Numbers(dict):
    """Numbers keys as they come."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level token stands for."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    odd = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(odd)}


class Aligner:
    """Both tokenizers with the bytes of their tokens; one for each worker process."""

    def __init__(self, definition: str, model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(definition)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        byte = _byte_of_char()
        n_a, n_b = self.a.get_vocab_size(), self.b.get_piece_size()
        self.bytes_a = [bytes(byte.get(c, 0x3F) for c in self.a.id_to_token(i) or "") for i in range(n_a)]
        pieces = [self.b.id_to_piece(i) for i in range(n_b)]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece holds a blank behind another character: texts can't be cut at blanks")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.len_a, self.len_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        #: What a token adds to the text of the groups: ids of A before a comma or a bar, ids of B before a comma or a semicolon.
        self.said = [f"{i}{end}" for n, ends in ((n_a, ",|"), (n_b, ",;")) for end in ends for i in range(n)]
        self.said_len = np.fromiter(map(len, self.said), np.int64, len(self.said))
        self.offsets = (0, n_a, 2 * n_a, 2 * n_a + n_b)

    def _tokens(self, words: list[str], raw: list[bytes]) -> tuple[list[list[int]], list[list[int]], list[int]]:
        """Ids of the words, each behind a blank, by both; a list for each call. The words that either does not give back as they are have none."""
        units: list[list[int]] = []
        size, joined = 0, False
        for n, w in enumerate(words):
            clean = not (w[:1].isspace() or w[-1:].isspace())
            if not (clean and joined and size + len(w) < CALL):
                units.append([])
                size, joined = 0, clean
            units[-1].append(n)
            size += len(w) + 1
        ids_a, ids_b, bad = [], [], []
        for unit in units:
            text = " ".join(words[n] for n in unit)
            a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text, num_threads=1)
            whole = b" " + b" ".join(raw[n] for n in unit)
            if b"".join(map(self.bytes_a.__getitem__, a)) == whole == b"".join(map(self.bytes_b.__getitem__, b)):
                ids_a.append(a)
                ids_b.append(b)
            elif len(unit) == 1:
                bad.append(unit[0])
            else:  # word by word
                for n in unit:
                    one_a, one_b, odd = self._tokens([words[n]], [raw[n]])
                    ids_a += one_a
                    ids_b += one_b
                    bad += [n] * len(odd)
        return ids_a, ids_b, bad

    def align(self, words: list[str]) -> dict:
        """Measures of words, each behind a blank: figures by word, its groups as text, and its id pairs with their links (``ptr``, ``code``, ``occ``)."""
        raw = [w.encode() for w in words]
        listed_a, listed_b, bad = self._tokens(words, raw)
        a, b = (np.fromiter((i for ids in x for i in ids), np.int64, sum(map(len, x))) for x in (listed_a, listed_b))
        size = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
        size[bad] = 0
        word_ends = np.cumsum(size)
        ends_a, ends_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        g_a, g_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        n_a, n_b = np.bincount(g_a, minlength=len(common)), np.bincount(g_b, minlength=len(common))
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        word = np.searchsorted(word_ends, common)  # of each group
        by_word = lambda x: np.bincount(word, weights=x, minlength=len(words)).astype(np.int64)
        links = n_a * n_b
        # the text: a group's A tokens, then its B tokens
        said = np.empty(len(a) + len(b), np.int64)
        last_a, last_b = np.diff(g_a, append=-1) != 0, np.diff(g_b, append=-1) != 0
        said[np.arange(len(a)) + first_b[g_a]] = a + np.where(last_a, self.offsets[1], self.offsets[0])
        said[np.arange(len(b)) + (first_a + n_a)[g_b]] = b + np.where(last_b, self.offsets[3], self.offsets[2])
        text = "".join(map(self.said.__getitem__, said.tolist()))
        token_ends = np.cumsum(np.bincount(word, weights=n_a + n_b, minlength=len(words)).astype(np.int64))
        cuts = np.concatenate([[0], np.cumsum(self.said_len[said])])[token_ends].tolist()
        groups = [text[x:y] for x, y in zip([0, *cuts[:-1]], cuts, strict=True)]
        # links one by one, or by counts where a group has very many
        small = np.flatnonzero(links <= SINGLE)
        n = links[small]
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        g = np.repeat(small, n)
        codes, owners, occ = [a[first_a[g] + k // n_b[g]] << 32 | b[first_b[g] + k % n_b[g]]], [word[g]], [np.ones(len(g), np.int64)]
        for g in np.flatnonzero(links > SINGLE).tolist():
            (x, cx), (y, cy) = np.unique(a[first_a[g] : first_a[g] + n_a[g]], return_counts=True), np.unique(b[first_b[g] : first_b[g] + n_b[g]], return_counts=True)
            codes.append((x[:, None] << 32 | y[None, :]).ravel())
            occ.append((cx[:, None] * cy[None, :]).ravel())
            owners.append(np.full(len(codes[-1]), word[g]))
        owner, code, occ = _summed(np.concatenate(owners), np.concatenate(codes), np.concatenate(occ))
        good = np.ones(len(words), bool)
        good[bad] = False
        return {"good": good, "n_a": by_word(n_a), "n_b": by_word(n_b), "n_groups": np.bincount(word, minlength=len(words)), "n_links": by_word(links), "groups": groups, "ptr": np.searchsorted(owner, np.arange(len(words) + 1)), "code": code, "occ": occ}


def _summed(owner: np.ndarray, code: np.ndarray, occ: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows by (owner, code), with sums."""
    if not len(code):
        return owner, code, occ
    found, place = np.unique(code, return_inverse=True)
    key = owner * len(found) + place
    order = np.argsort(key, kind="stable")
    key = key[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[start] // len(found), found[key[start] % len(found)], np.add.reduceat(occ[order], start)


_FIGURES = ("n_a", "n_b", "n_groups", "n_links")


class Block:
    """Distinct texts (key, text, copies) and what alignment makes of them."""

    def __init__(self, aligner: Aligner):
        self.aligner, self.keys, self.copies, self.size = aligner, [], [], 0
        self.bad: set[int] = set()
        self.figures: list[list[int]] = []
        self.states: list = []
        self.links: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._clear()

    def _clear(self) -> None:
        self.numbers, self.runs, self.chars = _Numbers(), [], 0

    def add(self, key: bytes, text: str, copies: int) -> None:
        n = len(self.keys)
        self.keys.append(key)
        self.copies.append(copies)
        self.figures.append([0] * len(_FIGURES))
        self.states.append(hashlib.sha256())
        self.size += len(text)
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > PART:
                cut = _CLEAN.search(text, at + PART)
                end = cut.start() if cut else end
            words = _CLEAN.split(text[at:end])
            self.runs.append((n, np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))))
            self.chars += end - at
            at = end + 1
            if self.chars >= PART:
                self.flush()

    def flush(self) -> None:
        """Aligns the distinct words so far and adds them up by text."""
        if not self.runs:
            return
        words = self.aligner.align(list(self.numbers))
        owner = np.repeat([n for n, _ in self.runs], [len(x) for _, x in self.runs])
        used = np.concatenate([x for _, x in self.runs])
        for n, x in self.runs:
            if not words["good"][x].all():
                self.bad.add(n)
                continue
            if self.figures[n][0]:
                self.states[n].update(b";")
            self.states[n].update("".join(map(words["groups"].__getitem__, x.tolist()))[:-1].encode())
            for i, f in enumerate(_FIGURES):
                self.figures[n][i] += int(words[f][x].sum())
        _, first, times = np.unique(owner * len(words["good"]) + used, return_index=True, return_counts=True)
        owner, used = owner[first], used[first]
        n = np.diff(words["ptr"])[used]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(words["ptr"][used], n)
        self.links.append(_summed(np.repeat(owner, n), words["code"][at], words["occ"][at] * np.repeat(times, n)))
        self._clear()

    def rows(self) -> Iterator[pa.RecordBatch]:
        """The block's texts as one row, then its pairs in lists, ascending, with the documents that hold them."""
        self.flush()
        block = uuid.uuid4().int >> 65
        owner, code, occ = _summed(*map(np.concatenate, zip(*self.links, strict=True))) if self.links else (np.zeros(0, np.int64),) * 3
        good = np.ones(len(self.keys), bool)
        good[list(self.bad)] = False
        keep = good[owner]
        owner, code, occ = owner[keep], code[keep], occ[keep]
        pairs, place = np.unique(code, return_inverse=True)
        weight = np.bincount(place, weights=np.asarray(self.copies, np.float64)[owner], minlength=len(pairs)).astype(np.int64)
        ptr = pa.array(np.searchsorted(owner, np.arange(len(self.keys) + 1)), pa.int32())
        nested = lambda x, t: pa.ListArray.from_arrays(ptr, pa.array(x, t))
        figures = [f if ok else [0] * len(_FIGURES) for f, ok in zip(self.figures, good, strict=True)]
        columns = [pa.array(self.keys, pa.binary()), *(pa.array([f[i] for f in figures], pa.int64()) for i in range(len(_FIGURES)))]
        columns += [pa.array([s.hexdigest() if ok else "" for s, ok in zip(self.states, good, strict=True)]), nested(place, pa.uint32()), nested(occ, pa.int64())]
        body = pa.RecordBatch.from_arrays(columns, names=["key", *_FIGURES, "groups_sha256", "place", "occ"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, body.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(body)
        yield _batch([(block, sink.getvalue().to_pybytes(), None, None)])
        for at in range(0, len(pairs), LIST):
            yield _batch([(block, None, pairs[at : at + LIST], weight[at : at + LIST])])


_ALIGNED = "block long, body binary, pair array<long>, weight array<long>"
_SCHEMA = pa.schema([("block", pa.int64()), ("body", pa.binary()), ("pair", pa.list_(pa.int64())), ("weight", pa.list_(pa.int64()))])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


_aligners: dict[int, Aligner] = {}


def _aligned(definition: str, model: bytes):
    """A function over Arrow batches (key, text, copies): the rows of their blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash((definition, model))
        if key not in _aligners:
            _aligners.clear()
            _aligners[key] = Aligner(definition, model)
        block = Block(_aligners[key])
        for batch in batches:
            for i in range(batch.num_rows):
                block.add(batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py())
                if block.size >= BLOCK:
                    yield from block.rows()
                    block = Block(_aligners[key])
        if block.keys:
            yield from block.rows()

    return run


_MEASURES = "key binary, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _measures(bodies: pa.Table, answers: pa.Table) -> pa.Table:
    """The texts of one block with the sums over their links; answers: (block, pair, count, best) of all its pairs."""
    answers = answers.sort_by("pair")
    count, best = answers.column("count").to_numpy(), answers.column("best").to_numpy(zero_copy_only=False).astype(np.int64)
    out = []
    for body in bodies.column("body").to_pylist():
        for rows in pa.ipc.open_stream(body):
            place, occ = (rows.column(c).values.to_numpy() for c in ("place", "occ"))
            ptr = rows.column("place").offsets.to_numpy()
            sums = [np.concatenate([[0], np.cumsum(occ * x[place])]) if len(place) else np.zeros(1, np.int64) for x in (best, count)]
            n_best, count_sum = (s[ptr[1:]] - s[ptr[:-1]] for s in sums)
            figures = [rows.column(f) for f in _FIGURES]
            out.append(pa.RecordBatch.from_arrays([rows.column("key"), *figures, pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), rows.column("groups_sha256")], names=["key", *_FIGURES, "n_best", "count_sum", "groups_sha256"]))
    return pa.Table.from_batches(out)


def distinct_texts(documents: DataFrame) -> DataFrame:
    """(key, text, copies): rows grouped by their full text, whose SHA-256 is the key; null and empty ones are left out."""
    return pick(documents, "text").where("text <> ''").groupBy(_key().alias("key")).agg(F.first("text").alias("text"), F.count("*").alias("copies"))


def _key():
    return F.unhex(F.sha2(F.col("text").cast("binary"), 256))


def align_texts(texts: DataFrame, definition: str, model: bytes) -> tuple[DataFrame, DataFrame]:
    """(measures by key, pair counts) of distinct texts (key, text, copies). Pair counts: pair (A id << 32 | B id), count, best (highest of the A id)."""
    table = written(texts.mapInArrow(_aligned(definition, model), _ALIGNED), "aligned")
    pairs = table.where("pair is not null").select("block", F.explode(F.arrays_zip("pair", "weight")).alias("p")).select("block", "p.pair", "p.weight")
    counts = written(pairs.groupBy("pair").agg(F.sum("weight").alias("count")), "pair-counts")
    highest = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("count").alias("highest"))
    counts = counts.join(highest, F.shiftright("pair", 32) == F.col("a")).select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    answers = pairs.select("block", "pair").join(counts, "pair").select("block", "pair", "count", "best")
    bodies = table.where("body is not null").select(F.col("block").alias("home"), "body")
    return bodies.groupBy("home").cogroup(answers.groupBy("block")).applyInArrow(_measures, _MEASURES), counts


def aligned_documents(documents: DataFrame, definition: str, model: bytes) -> DataFrame:
    """(doc_id, measures) for each row of documents."""
    measures = align_texts(distinct_texts(documents), definition, model)[0]
    docs = pick(documents, "doc_id", "text").select("doc_id", F.when(F.col("text") != "", _key()).alias("key"))
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in (*_FIGURES, "n_best", "count_sum")]
    return docs.join(measures, "key", "left").select("doc_id", *zero, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


def files(a: str | None = None, b: str | None = None) -> tuple[str, bytes]:
    """Both tokenizers' files, read once on the driver; of fixed size."""
    import public_tokenizers

    with open(a or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f, open(b or public_tokenizers.path("piece_bpe_32k.model"), "rb") as g:
        return f.read(), g.read()


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned_documents(read(spark, sf_dir, "documents"), *files())
