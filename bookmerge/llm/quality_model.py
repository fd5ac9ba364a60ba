"""Quality classifier: attention over passages (multiple-instance learning), from document labels alone.

A document is a bag of 64-word passages. A passage is encoded as byte frequencies, word-shape figures
and hashed word counts, then through a small hidden layer. Gated attention (Ilse, Tomczak, Welling
2018) weighs the passages; the weighted mean decides. Encoder, attention and output are learned
together from document labels, on the driver, over a bounded sample of whole documents: those whose hashed ids are
least, at most ``MAX_TRAIN`` of them and as many as have ``MAX_TRAIN_PASSAGES`` passages together (one at least). Scoring is one
narrow pass over every whole text; the weights it broadcasts have a fixed size. No step shuffles texts.

Labels, lang, source and doc_id are no inputs of a score. Only rows whose crc32(doc_id as text) mod 3
is not 1 train. A document labelled both 0 and 1 counts as 1. Edge cases: a null or empty text is one empty passage; a null doc_id is not held
out; without any usable label every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookmerge.llm._shared import in_pieces, pick, read, written

PASSAGE_WORDS, HASHED, HIDDEN, GATE = 64, 64, 24, 16
MAX_TRAIN, MAX_TRAIN_PASSAGES, EPOCHS, SEED = 2000, 1 << 17, 12, 7
#: Texts are encoded in blocks of about so many bytes.
BLOCK = 1 << 20

_CLASS = np.zeros(256, np.int64)
_CLASS[:33] = 0
_CLASS[10] = 1
_CLASS[128:] = 2
_CLASS[48:58] = 3
_CLASS[65:91] = 4
_CLASS[97:123] = 5
_punct = [i for i in range(33, 127) if not chr(i).isalnum()]
_CLASS[_punct] = 6 + np.arange(len(_punct))
CLASSES = 6 + len(_punct)
FEATURES = CLASSES + 6 + HASHED
_POWERS = np.cumprod(np.full(1 << 12, 0x9E3779B1, dtype=np.uint64))


def _encode_block(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Passage features, and the number of passages of each text (one at least)."""
    joined = b" ".join(texts) + b" "
    buf = np.frombuffer(joined, np.uint8)
    blank = (buf == 32) | ((buf >= 9) & (buf <= 13))
    start = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    end = np.flatnonzero(blank & np.concatenate([[False], ~blank[:-1]]))
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    first_word = np.searchsorted(start, begins)
    n_words = np.diff(first_word)
    n_pass = np.maximum(1, -(-n_words // PASSAGE_WORDS))
    first_pass = np.cumsum(n_pass) - n_pass
    total = int(n_pass.sum())
    word_doc = np.repeat(np.arange(len(texts)), n_words)
    word_pass = first_pass[word_doc] + (np.arange(len(start)) - first_word[word_doc]) // PASSAGE_WORDS
    x = np.zeros((total, FEATURES))
    if not len(start):
        return x, n_pass
    # Bytes: those before a passage's first word belong to the passage before it, or to the text's first; never to another text.
    owner = np.repeat(np.arange(len(texts)), n_pass)
    k = np.arange(total) - first_pass[owner]
    byte_at = np.where(k == 0, begins[owner], start[np.minimum(first_word[owner] + k * PASSAGE_WORDS, len(start) - 1)])
    byte_pass = np.repeat(np.arange(total), np.diff(byte_at, append=len(buf)))
    counts = np.bincount(byte_pass * CLASSES + _CLASS[buf], minlength=total * CLASSES).reshape(total, CLASSES)
    n_bytes = np.maximum(1, counts.sum(axis=1))
    x[:, :CLASSES] = np.sqrt(counts / n_bytes[:, None])
    length = end - start
    pos = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    word_bytes = buf[pos + np.repeat(start, length)]
    h = np.add.reduceat((word_bytes.astype(np.uint64) + np.uint64(1)) * _POWERS[pos % len(_POWERS)], np.cumsum(length) - length)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    n = np.maximum(1, np.bincount(word_pass, minlength=total))
    per = lambda v: np.bincount(word_pass, weights=v, minlength=total) / n
    mean = per(length)
    same = lambda k: np.concatenate([np.zeros(min(k, len(h))), (h[k:] == h[:-k]) & (word_doc[k:] == word_doc[:-k])])
    bins = np.bincount(word_pass * HASHED + (h >> np.uint64(58)).astype(np.int64), minlength=total * HASHED).reshape(total, HASHED) / n[:, None]
    x[:, CLASSES : CLASSES + 6] = np.stack([np.log1p(mean), np.log1p(np.sqrt(np.maximum(0, per(length.astype(float) ** 2) - mean**2))), per(same(1)), per(same(2)), (bins**2).sum(axis=1), np.log1p(n)], axis=1)
    x[:, CLASSES + 6 :] = np.sqrt(bins)
    x[np.repeat(n_words == 0, n_pass)] = 0  # a text without words is the same whatever stands beside it
    return x, n_pass


def encode(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of texts, encoded; a very long text is a block of its own."""
    block, size = [], 0
    for t in texts:
        block.append(t or b"")
        size += len(t or b"")
        if size >= BLOCK:
            yield _encode_block(block)
            block, size = [], 0
    if block:
        yield _encode_block(block)


def forward(w: dict[str, np.ndarray], x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    h = np.tanh((x - w["mean"]) / w["scale"] @ w["w1"] + w["b1"])
    t, g = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"])))
    starts = np.cumsum(counts) - counts
    s = (t * g) @ w["a"]
    s = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), counts))
    weight = s / np.repeat(np.add.reduceat(s, starts), counts)
    z = np.add.reduceat(weight[:, None] * h, starts)
    score = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["b"], -30, 30)))
    return {"h": h, "t": t, "g": g, "weight": weight, "z": z, "score": score}


def fit(x: np.ndarray, counts: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Weights by Adam on the log loss of mini-batches of 64 documents."""
    rng = np.random.default_rng(seed)
    w = {"w1": rng.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, HIDDEN)), "b1": np.zeros(HIDDEN), "v": rng.normal(0, 0.3, (HIDDEN, GATE)), "u": rng.normal(0, 0.3, (HIDDEN, GATE)), "a": rng.normal(0, 0.3, GATE), "c": rng.normal(0, 0.3, HIDDEN), "b": np.zeros(1)}
    fixed = {"mean": x.mean(axis=0, dtype=float), "scale": x.std(axis=0, dtype=float) + 0.02}
    m, v = {k: np.zeros_like(p) for k, p in w.items()}, {k: np.zeros_like(p) for k, p in w.items()}
    offsets, step = np.cumsum(counts) - counts, 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), 64):
            docs = order[at : at + 64]
            n = counts[docs]
            rows = np.arange(n.sum()) + np.repeat(offsets[docs] - (np.cumsum(n) - n), n)
            xb, yb = x[rows].astype(float), y[docs]
            f = forward(w | fixed, xb, n)
            err = (f["score"] - yb) / len(docs)
            dz = err[:, None] * w["c"]
            dz_rows = np.repeat(dz, n, axis=0)
            dot = (dz_rows * f["h"]).sum(axis=1)
            starts = np.cumsum(n) - n
            ds = f["weight"] * (dot - np.repeat(np.add.reduceat(f["weight"] * dot, starts), n))
            dt, dg = ds[:, None] * w["a"] * f["g"], ds[:, None] * w["a"] * f["t"]
            pre_t, pre_g = dt * (1 - f["t"] ** 2), dg * f["g"] * (1 - f["g"])
            dh = f["weight"][:, None] * dz_rows + pre_t @ w["v"].T + pre_g @ w["u"].T
            pre = dh * (1 - f["h"] ** 2)
            grads = {"w1": ((xb - fixed["mean"]) / fixed["scale"]).T @ pre, "b1": pre.sum(axis=0), "v": f["h"].T @ pre_t, "u": f["h"].T @ pre_g, "a": (ds[:, None] * f["t"] * f["g"]).sum(axis=0), "c": f["z"].T @ err, "b": np.array([err.sum()])}
            step += 1
            for k, g in grads.items():
                g = g + 1e-4 * w[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - 0.01 * (1 - epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return w | fixed


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bags, sizes = [], []
        for x, counts in encode(batch.column("text").cast(pa.binary()).to_pylist()):
            bags += [part.astype("<f4").tobytes() for part in np.split(x, np.cumsum(counts)[:-1])]
            sizes += counts.tolist()
        yield pa.RecordBatch.from_arrays([batch.column("at"), batch.column("quality"), pa.array(sizes, pa.int64()), pa.array(bags, pa.binary())], ["at", "quality", "n", "bag"])


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_passages: int = MAX_TRAIN_PASSAGES) -> dict[str, np.ndarray] | None:
    """Weights learned from docs (doc_id, text) and labels (doc_id, quality); None where no label is usable."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(~held_out() & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    sample = usable.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")  # max_train rows at most
    rows = rows.select(F.xxhash64("doc_id", "text").alias("at"), "quality", "text")
    bags = written(rows.mapInArrow(in_pieces(_bags), "at long, quality int, n long, bag binary").orderBy("at", "quality").limit(2 * max_train), "bags")
    chosen, total = set(), 0
    for at, quality, n in sorted((r["at"], r["quality"], r["n"]) for r in bags.select("at", "quality", "n").collect()):  # no more than 2 * max_train rows
        if total + n <= max_passages:  # a document that does not fit is left out, and those behind it are not
            chosen.add((at, quality))
            total += n
    if not chosen:
        return None
    got = sorted((r["at"], r["quality"], r["bag"]) for r in bags.where(F.col("n") <= max_passages).toLocalIterator() if (r["at"], r["quality"]) in chosen)
    x = [np.frombuffer(bag, "<f4").reshape(-1, FEATURES) for _, _, bag in got]
    return fit(np.concatenate(x), np.array([len(b) for b in x]), np.array([q for _, q, _ in got], float))


def score(docs: DataFrame, weights: dict[str, np.ndarray] | None) -> DataFrame:
    """docs (with a text column) plus __score; every passage of every text counts."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(weights)  # fixed size
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            scores = []
            for x, counts in encode(batch.column("text").cast(pa.binary()).to_pylist()):
                scores.append(forward(w, x, counts)["score"] if w else np.full(len(counts), 0.5))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores) if scores else np.zeros(0))], [*names, "__score"])

    return docs.mapInArrow(in_pieces(run), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", __score double")


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(read(spark, sf_dir, "documents"), "doc_id", "text")
    scored = score(docs, train(docs, pick(read(spark, sf_dir, "labels"), "doc_id", "quality")))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, with the columns of docs."""
    names = docs.columns
    plain = [f"_c{i}" for i in range(len(names))]
    weights = train(pick(docs, "doc_id", "text"), pick(read(spark, sf_dir, "labels"), "doc_id", "quality"))
    at = plain[names.index("text")]
    scored = score(docs.toDF(*plain).withColumnRenamed(at, "text"), weights)
    return scored.where("__score >= 0.5").drop("__score").toDF(*names)
