"""Chat formatting in budgeted windows: prefix sums of turn tokens choose turn-aligned spans.

Every window opens with the conversation's system turn, repeats the last turns before it up to
``HISTORY`` tokens, then takes new turns while the budget lasts. Loss lies on assistant turns that are
new in their window; repeated ones are masked, so each is a target once. A turn is written as
``### role: text</turn>`` with backslashes doubled and control strings broken by a backslash,
which reading back undoes.

Rows are range-partitioned on (conversation, turn), so one conversation may span partitions: each partition sums
its turns' tokens, and the totals of leading and trailing conversations (two rows a partition)
shift the sums of those that began before. The sums cut a long conversation into stretches of
``STRETCH`` tokens that are formatted apart, with the turns that its first window may repeat. No task holds
more than a stretch. Reading back for the digests is sequential within a conversation by nature of a hash,
but streams window by window.

Edge cases: a null text or role is empty; turns that tie are ordered by a hash of role and text, then by these; a null turn
comes first; a null conv_id is a conversation of its own; a turn over the budget is a window with the system turn alone
(``over_budget``); a conversation without assistant turns has no loss.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookmerge.llm._shared import in_pieces, parts_for, pick, read, small_side, written, written_in_parts
from bookmerge.llm.tokens import definition_of, encoder

BUDGET, HISTORY, STRETCH = 2048, 256, 1 << 17
# The template.
OPEN, CLOSE = "### ", "</turn>\n"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("###", "\\###").replace("</turn>", "\\</turn>")


def escape_role(role: str) -> str:
    return escape(role).replace(":", "\\:")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def formatted(role: str, text: str) -> tuple[str, str]:
    """Head and body of a turn, without the closing mark."""
    return f"{OPEN}{escape_role(role)}: ", escape(text)


#: Possessive repeats: no way back is kept, whatever a turn's length.
_TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>\n))*+)</turn>\n", re.S)


def turns_of(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start and end of the escaped text) of each turn of a formatted window."""
    return [(unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)) for m in _TURN.finditer(text)]


def choose(sizes: np.ndarray, first: int, system: int, budget: int, history: int) -> list[tuple[int, int, int]]:
    """Spans (repeated from, new from, new to) over a stretch's turns; those before ``first`` are only history.

    ``system`` is the system turn's size where it is to be repeated (0 in a window that holds it anew).
    """
    ends = np.cumsum(sizes)
    starts = ends - sizes
    spans, at = [], first
    while at < len(sizes):
        begin = int(np.searchsorted(starts, starts[at] - history))
        while begin < at and system + ends[at] - starts[begin] > budget:
            begin += 1
        upto = max(at + 1, int(np.searchsorted(ends, starts[begin] + budget - system, side="right")))
        spans.append((begin, at, upto))
        at = upto
    return spans


_SUMMED = ["kind", "part", "lead", "conv_id", "turn", "role", "text", "tokens", "before"]
_SUMMED_TYPES = [pa.int8(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]


def _prefix_sums(definition):
    """Ordered turns in; turns with their tokens and the tokens before them in this partition, and two rows of totals, out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(definition.value)
        part = conv = None
        lead, total, lead_total, seen = True, 0, 0, False
        rows = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _SUMMED_TYPES, strict=True)], _SUMMED)
        for batch in batches:
            turns = batch.to_pylist()
            sizes = e.encode(["".join([*formatted(t["role"], t["text"]), CLOSE]).encode() for t in turns])
            out = []
            for t, ids in zip(turns, sizes, strict=True):
                if not seen:
                    part, conv, seen = t["part"], t["conv_id"], True
                    first = conv
                if t["conv_id"] != conv:
                    if lead:
                        lead_total = total
                    conv, lead, total = t["conv_id"], False, 0
                out.append((0, part, lead, conv, t["turn"], t["role"], t["text"], len(ids), total))
                total += len(ids)
            if out:
                yield rows(out)
        if seen:
            yield rows([(1, part, True, first, None, None, None, total if lead else lead_total, None), (1, part, False, conv, None, None, None, total, None)])

    return run


_WINDOW = ["conv_id", "window", "text", "n_repeated", "loss_spans", "tokens", "over_budget"]
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_WINDOW_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int32(), _SPANS, pa.int64(), pa.bool_()]


def _windows(budget: int, history: int):
    def stretch(conv, number: int, turns: list[dict]) -> list[tuple]:
        """Turns: the system turn if the stretch only repeats it, then history, then new ones."""
        system = turns[0] if turns[0]["system"] else None
        repeated_system = system is not None and turns[0]["halo"]
        body = turns[1:] if repeated_system else turns
        first = sum(t["halo"] for t in body)
        sizes = np.array([t["tokens"] for t in body], np.int64)
        out = []
        spans = []
        if system is not None and not repeated_system:  # the window that holds the system turn anew, then the others
            spans = choose(sizes, first, 0, budget, history)[:1]
            at = spans[0][2]
            spans += [(max(b, 1), a, c) for b, a, c in choose(sizes, at, system["tokens"], budget, history)]
        else:
            spans = choose(sizes, first, system["tokens"] if system else 0, budget, history)
        for w, (begin, new, upto) in enumerate(spans):
            head = [system] if system is not None and (repeated_system or w) else []
            chosen = head + body[begin:upto]
            n_repeated = len(head) + new - begin
            parts, at, loss = [], 0, []
            for k, t in enumerate(chosen):
                opening, text = formatted(t["role"], t["text"])
                if t["role"] == "assistant" and k >= n_repeated:
                    loss.append({"start": at + len(opening), "end": at + len(opening) + len(text)})
                parts += [opening, text, CLOSE]
                at += len(opening) + len(text) + len(CLOSE)
            tokens = sum(t["tokens"] for t in chosen)
            out.append((conv, number << 24 | w, "".join(parts), n_repeated, loss, tokens, tokens > budget))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            out = []
            for t in batch.to_pylist():
                key = t["conv_id"], t["stretch"]
                if key != at and held:
                    out += stretch(*at, held)
                    held = []
                at = key
                held.append(t)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _WINDOW_TYPES, strict=True)], _WINDOW)
        if held:
            out = stretch(*at, held)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _WINDOW_TYPES, strict=True)], _WINDOW)

    return run


def windows(turns: DataFrame, tokenizer: str | None = None, budget: int = BUDGET, history: int = HISTORY, stretch: int = STRETCH) -> DataFrame:
    """conv_id, window (ascending in order), text, n_repeated (turns that the window repeats), loss_spans, tokens, over_budget."""
    spark = turns.sparkSession
    clean = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    clean = clean.withColumn("tie", F.xxhash64("role", "text"))
    order = ["conv_id", "turn", "tie", "role", "text"]
    parts = parts_for(spark, clean.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    ordered = clean.repartitionByRange(parts, "conv_id", "turn", "tie").sortWithinPartitions(*order).drop("tie").withColumn("part", F.spark_partition_id().cast("long"))
    schema = "kind byte, part long, lead boolean, conv_id long, turn long, role string, text string, tokens long, before long"
    summed = written(ordered.mapInArrow(in_pieces(_prefix_sums(spark.sparkContext.broadcast(definition_of(tokenizer)))), schema), "turn-sums")

    totals = sorted(summed.where("kind = 1").select("part", "lead", "conv_id", "tokens").collect(), key=lambda r: (r["part"], not r["lead"]))  # two rows a partition
    bases, carried, conv = [], 0, object()
    for lead, trail in zip(totals[::2], totals[1::2], strict=True):
        bases.append((lead["part"], carried if lead["conv_id"] == conv else 0))
        one = lead["conv_id"] == trail["conv_id"]
        carried = (bases[-1][1] if one else 0) + trail["tokens"]
        conv = trail["conv_id"]
    base = spark.createDataFrame(bases, "part long, base long")
    rows = summed.where("kind = 0").join(small_side(base, len(bases)), "part").withColumn("before", F.col("before") + F.when(F.col("lead"), F.col("base")).otherwise(0))
    rows = rows.select("conv_id", "turn", "role", "text", "tokens", "before", (F.col("role").eqNullSafe("system") & (F.col("before") == 0)).alias("system"))

    own = F.floor(F.col("before") / stretch)
    rows = rows.withColumn("stretch", own)
    # Turns that the next stretch's first window may repeat, and the system turn for every later stretch of a long conversation.
    halo = rows.where((F.col("before") >= (own + 1) * stretch - history) & ~F.col("system")).withColumn("stretch", own + 1)
    later = rows.where("stretch > 0").select("conv_id", "stretch").distinct()
    # A null conv_id is a conversation of its own, so it equals itself here.
    ends = later.select(F.col("conv_id").alias("later_id"), F.col("stretch").alias("later_stretch"))
    one = F.col("conv_id").eqNullSafe(F.col("later_id"))
    halo = halo.join(ends, one & (F.col("stretch") == F.col("later_stretch")), "left_semi")
    system = rows.where("system").drop("stretch").join(ends, one).drop("later_id").withColumnRenamed("later_stretch", "stretch")
    every = rows.withColumn("halo", F.lit(False)).unionByName(halo.withColumn("halo", F.lit(True))).unionByName(system.withColumn("halo", F.lit(True)))
    dealt = every.repartition(parts, "conv_id", "stretch").sortWithinPartitions("conv_id", "stretch", F.desc("system"), "before", "turn", "role", "text")
    return dealt.mapInArrow(in_pieces(_windows(budget, history)), "conv_id long, window long, text string, n_repeated int, loss_spans array<struct<start:bigint,end:bigint>>, tokens long, over_budget boolean")


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows in order in; a row of digests for each conversation out, in bounded memory."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    conv = state = None
    out: list[tuple] = []

    def done() -> None:
        if state:
            out.append((conv, state["turns"], state["all"].hexdigest(), state["loss"], state["under"].hexdigest(), state["chars"]))

    for batch in batches:
        for w in batch.to_pylist():
            if state is None or w["conv_id"] != conv:
                done()
                conv, state = w["conv_id"], {"turns": 0, "all": hashlib.sha256(), "loss": 0, "under": hashlib.sha256(), "chars": 0}
            state["chars"] += len(w["text"])
            for role, text, _, _ in turns_of(w["text"])[w["n_repeated"] :]:
                state["turns"] += 1
                state["all"].update(f"{role}\n{text}\n".encode())
            for span in w["loss_spans"]:
                text = unescape(w["text"][span["start"] : span["end"]])
                state["loss"] += len(text)
                state["under"].update(text.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
            out = []
    done()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


def op4_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = pick(read(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text").unionByName(extra)
    made, parts = written_in_parts(windows(turns), "chat-windows")
    ordered = made.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "window")
    return ordered.mapInArrow(in_pieces(_read_back), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
