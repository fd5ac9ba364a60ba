"""Quality rules: base text rules, then cross-document line frequency by host.

Every text is read once; its base figures and the hashes of its distinct normalised lines go to a
table in the shared folder. Distinct documents are counted for each (host, line hash), summed before and after a shuffle
on all three keys, so a line that half of a host repeats loads no single task. Lines in more than ``share`` of the host's
documents are boilerplate, but those of ``low`` documents at most never are. There is no other bound, so a line that the
same share of a host's documents holds gets the same verdict however large the host is. A document that loses more than
``max_removed`` of its words to them is depleted and is rejected; so are copies of one document beyond the limit.
Frequent lines of a host are at most the lines of a mean document / ``share``; they are written, and Spark broadcasts them or not by
the size of that table. Each row also gets the positions of its boilerplate lines, and ``clean`` gives the kept rows
with texts that lack these lines.

Edge cases: a null or empty text has no words, so it fails the base rules; a null source is a host of
its own; repeated rows are judged one by one, and rows that share a doc_id (or have none) count as one document; empty lines are no lines here.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookmerge.llm._shared import id_or_least, in_pieces, pick, read, written

MIN_WORDS = 50
#: A line is boilerplate in more documents of its host than this share of them, and than LOW.
SHARE, LOW = 0.05, 2
#: Share of its words that a document may lose to boilerplate.
MAX_REMOVED = 0.5

_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows that are found twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered, upto = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + 3 - max(upto, i)
            upto = i + 3
    return covered


def figures(raw: bytes | None) -> tuple[list[int], dict[int, list]]:
    """The base figures, and by hash of the normalised line its words and its positions in the text."""
    raw = raw or b""
    words = raw.split()
    lines: dict[int, list] = {}
    seen, dup = set(), 0
    for at, line in enumerate(raw.split(b"\n")):
        in_line = line.split()
        if not in_line:
            continue
        dup += line in seen
        seen.add(line)
        key = xxhash.xxh3_64_intdigest(b" ".join(in_line).lower()) - (1 << 63)
        found = lines.setdefault(key, [0, []])
        found[0] += len(in_line)
        found[1].append(at)
    solid = raw.translate(None, b" \t\n\r\x0b\x0c")
    return [len(words), len(solid.decode("utf-8", "replace")), len(raw) - len(raw.translate(None, b"#*$%&|<>")), dup, repeat_words(words)], lines


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = [figures(raw) for raw in batch.column("text").cast(pa.binary()).to_pylist()]
        base = [pa.array([f[i] for f, _ in done], pa.int64()) for i in range(5)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), batch.column("digest"), *base, pa.array([list(x) for _, x in done], pa.list_(pa.int64())), pa.array([[n for n, _ in x.values()] for _, x in done], pa.list_(pa.int64())), pa.array([[at for _, at in x.values()] for _, x in done], pa.list_(pa.list_(pa.int32())))], ["doc_id", "host", "digest", *_BASE, "line_keys", "line_words", "line_at"])


def _copy(host: str, text: str) -> list[Column]:
    """Rows that agree in these are copies on one host and get one verdict."""
    return [F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.xxhash64(text).alias("digest")]


def judge(docs: DataFrame, host: str = "source", min_words: int = MIN_WORDS, share: float = SHARE, low: int = LOW, max_removed: float = MAX_REMOVED) -> DataFrame:
    """doc_id, the base figures, base_failed, kept, n_boilerplate_words, host, digest and boilerplate (line positions) for each row of docs (doc_id, text, host)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_copy(host, "text"), "text")
    schema = "doc_id long, host string, digest long, " + ", ".join(f"{c} long" for c in _BASE) + ", line_keys array<long>, line_words array<long>, line_at array<array<int>>"
    parsed = written(rows.mapInArrow(in_pieces(_parse), schema).withColumn("row", F.monotonically_increasing_id()), "line-figures")

    doc = id_or_least().alias("d")
    limit = F.greatest(F.lit(float(low)), share * F.col("host_docs"))
    sizes = parsed.select("host", doc).groupBy("host").agg(F.count_distinct("d").alias("host_docs"))
    counts = parsed.select("host", doc, F.explode("line_keys").alias("line")).groupBy("host", "line").agg(F.count_distinct("d").alias("n"))
    frequent = counts.where(F.col("n") > low).join(sizes, "host").where(F.col("n") > limit).select("host", "line")
    frequent = written(frequent, "frequent-lines")

    lines = parsed.select("host", "row", F.explode(F.arrays_zip("line_keys", "line_words", "line_at")).alias("x")).select("host", "row", F.col("x.line_keys").alias("line"), F.col("x.line_words").alias("words"), F.col("x.line_at").alias("at"))
    removed = lines.join(frequent, ["host", "line"]).groupBy("row").agg(F.sum("words").alias("n_boilerplate_words"), F.array_sort(F.flatten(F.collect_list("at"))).alias("boilerplate"))
    judged = parsed.select("row", "doc_id", "host", "digest", *_BASE).join(removed, "row", "left").withColumn("n_boilerplate_words", F.coalesce("n_boilerplate_words", F.lit(0)))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", *_BASE, failed.alias("base_failed"), (~failed & (F.col("n_boilerplate_words") <= max_removed * F.col("n_words"))).alias("kept"), "n_boilerplate_words", "host", "digest", F.coalesce("boilerplate", F.array().cast("array<int>")).alias("boilerplate"))


def clean(docs: DataFrame, host: str = "source", **limits: float) -> DataFrame:
    """The kept rows of docs, their texts without boilerplate lines; n_chars follows the text where it is a column."""
    names = docs.columns
    plain = [f"_c{i}" for i in range(len(names))]
    d, t, h = (plain[names.index(n)] for n in ("doc_id", "text", host))
    verdicts = judge(pick(docs, *dict.fromkeys(["doc_id", "text", host])), host, **limits).where("kept")
    verdicts = verdicts.groupBy(id_or_least().alias("__d"), F.col("host").alias("__host"), F.col("digest").alias("__digest")).agg(F.first("boilerplate").alias("__gone"))
    rows = docs.toDF(*plain)
    keyed = rows.select("*", id_or_least(d).alias("__d"), *(c.alias(f"__{n}") for c, n in zip(_copy(h, t), ("host", "digest"), strict=True)))
    joined = keyed.join(verdicts, ["__d", "__host", "__digest"]).select(*plain, "__gone")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for raw, gone in zip(batch.column(t).cast(pa.binary()).to_pylist(), batch.column("__gone").to_pylist(), strict=True):
                left = set(gone)
                done.append(b"\n".join(x for i, x in enumerate(raw.split(b"\n")) if i not in left) if left else raw)
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.binary()).cast(pa.string()) if c == t else batch.column(c) for c in plain], plain)

    out = joined.mapInArrow(in_pieces(apply), rows.schema).toDF(*names)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(pick(read(spark, sf_dir, "documents"), "doc_id", "text", "source"))
    return judged.select("doc_id", *_BASE, "base_failed", "kept", "n_boilerplate_words")
