"""Very long turns, the encoder of passages in plain loops, and what a bounded sample leaves out."""

import math
import tracemalloc

import numpy as np
import pytest

from bookmerge.llm import chat_windows, jaccard_join, quality_model
from tests.llm.test_operators import run, world  # noqa: F401


@pytest.mark.parametrize("kind", ["plain", "escapes", "brackets"])
def test_a_turn_of_twenty_megabytes(kind):
    """Reading a long turn back takes a few times its text, whatever it is made of."""
    text = {"plain": "word " * 4_000_000, "escapes": "\\### a </turn> " * 1_300_000, "brackets": "<" * 20_000_000}[kind]
    head, body = chat_windows.formatted("user", text)
    whole = head + body + chat_windows.CLOSE
    tracemalloc.start()
    try:
        ((role, back, start, end),) = chat_windows.turns_of(whole)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert role == "user" and back == text and whole[start:end] == body
    assert peak < 40 * len(text)


def plain_passages(text):
    """Features of a text's passages, byte by byte and word by word."""
    raw = text.encode()
    blank = b" \t\n\r\x0b\x0c"
    words, at = [], 0
    while at < len(raw):
        if raw[at] in blank:
            at += 1
            continue
        end = at
        while end < len(raw) and raw[end] not in blank:
            end += 1
        words.append((at, end))
        at = end
    n = quality_model.PASSAGE_WORDS
    groups = [words[k : k + n] for k in range(0, len(words), n)] or [[]]
    power, hashes = 1, []
    for a, b in words:
        h, power = 0, 0x9E3779B1
        for c in raw[a:b]:
            h = (h + (c + 1) * power) % 2**64
            power = power * 0x9E3779B1 % 2**64
        hashes.append((h ^ h >> 29) * 0xBF58476D1CE4E5B9 % 2**64)
    out, done = [], 0
    for g, group in enumerate(groups):
        first = 0 if g == 0 else group[0][0]
        last = groups[g + 1][0][0] if g + 1 < len(groups) else len(raw) + 1  # the blank that ends a text counts
        row = [0.0] * quality_model.FEATURES
        if group:
            inside = (raw + b" ")[first:last]
            for c in inside:
                row[quality_model._CLASS[c]] += 1
            for k in range(quality_model.CLASSES):
                row[k] = math.sqrt(row[k] / len(inside))
            size = [b - a for a, b in group]
            mean = sum(size) / len(size)
            mine = range(done, done + len(group))
            same = [sum(i >= k and hashes[i] == hashes[i - k] for i in mine) / len(group) for k in (1, 2)]
            bins = [0.0] * quality_model.HASHED
            for i in mine:
                bins[hashes[i] >> 58] += 1 / len(group)
            row[quality_model.CLASSES : quality_model.CLASSES + 6] = [math.log1p(mean), math.log1p(math.sqrt(max(0.0, sum(x * x for x in size) / len(size) - mean**2))), *same, sum(b * b for b in bins), math.log1p(len(group))]
            row[quality_model.CLASSES + 6 :] = [math.sqrt(b) for b in bins]
        done += len(group)
        out.append(row)
    return out


def test_encoder_and_score_in_plain_loops(monkeypatch):
    """From text to score: passages, features and attention as loops give them."""
    texts = ["one two two one", "", " \t\n", " ".join(f"Wörd{i % 9}, #{i}!" for i in range(130)) + "\n", "x" * 300 + " y y y", "\n\n a  b\tc " * 80]
    monkeypatch.setattr(quality_model, "BLOCK", 700)
    got = [(x, counts) for x, counts in quality_model.encode([t.encode() for t in texts])]
    x, counts = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
    want = [plain_passages(t) for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    assert np.allclose(x, np.array([row for w in want for row in w]), atol=1e-9)
    rng = np.random.default_rng(0)
    f, h, g = quality_model.FEATURES, quality_model.HIDDEN, quality_model.GATE
    w = {"mean": rng.normal(size=f), "scale": np.ones(f), "w1": rng.normal(size=(f, h)) / 9, "b1": rng.normal(size=h), "v": rng.normal(size=(h, g)), "u": rng.normal(size=(h, g)), "a": rng.normal(size=g), "c": rng.normal(size=h), "b": rng.normal(size=1)}
    scores = np.concatenate([quality_model.forward(w, *block)["score"] for block in got])
    for rows, score in zip(want, scores, strict=True):
        hidden = [[math.tanh(sum((row[i] - w["mean"][i]) * w["w1"][i, j] for i in range(f)) + w["b1"][j]) for j in range(h)] for row in rows]
        gate = [sum(math.tanh(sum(z[j] * w["v"][j, k] for j in range(h))) / (1 + math.exp(-sum(z[j] * w["u"][j, k] for j in range(h)))) * w["a"][k] for k in range(g)) for z in hidden]
        e = [math.exp(s - max(gate)) for s in gate]
        pooled = [sum(e[p] / sum(e) * hidden[p][j] for p in range(len(rows))) for j in range(h)]
        assert score == pytest.approx(1 / (1 + math.exp(-(sum(pooled[j] * w["c"][j] for j in range(h)) + w["b"][0]))), abs=1e-9)


def test_attention_finds_what_a_mean_loses():
    """One marked passage of many decides a label that the others contradict: attention learns where to look, and equal weights lose it."""
    rng = np.random.default_rng(3)
    bags, labels, marked = [], [], []
    for i in range(600):
        bag = np.zeros((40, quality_model.FEATURES))
        bag[:, 1] = rng.choice([-1.0, 1.0], 40)
        at = int(rng.integers(40))
        bag[at, :3] = 0, 1.0 if i % 2 else -1.0, 1.0
        bags.append(bag)
        labels.append(i % 2)
        marked.append(at)
    counts, y = np.full(len(bags), 40), np.array(labels, float)
    w = quality_model.fit(np.concatenate(bags[:450]), counts[:450], y[:450], epochs=40)
    right = lambda model: ((quality_model.forward(model, np.concatenate(bags[450:]), counts[450:])["score"] >= 0.5) == (y[450:] > 0)).mean()
    assert right(w) > 0.95 and right({**w, "a": np.zeros_like(w["a"])}) < 0.75
    top = quality_model.forward(w, np.concatenate(bags[450:]), counts[450:])["weight"].reshape(-1, 40).argmax(1)
    found = top == np.array(marked[450:])
    assert max(found[y[450:] == c].mean() for c in (0, 1)) > 0.9  # one class is told by where it looks, the other by finding nothing


def test_a_document_that_does_not_fit_is_left_out_alone(spark):
    """A labelled document beyond the sample's passages does not end the sample."""
    rows = [(i, ("good words here " if i % 2 else "## $$ || && ") * (40_000 if i in (3, 4, 5) else 30)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    limit = 200
    assert all(len(r[1].split()) / quality_model.PASSAGE_WORDS > limit for r in rows if r[0] in (3, 4, 5))
    weights = quality_model.train(docs, labels, max_passages=limit)
    scored = {r["doc_id"]: r["__score"] for r in quality_model.score(docs, weights).select("doc_id", "__score").collect()}
    assert all((scored[i] > 0.5) == bool(i % 2) for i in scored)
    assert quality_model.train(docs.where("doc_id in (3, 4, 5)"), labels, max_passages=limit) is None


def test_sketch_under_load():
    """Where every counter holds thousands of shingles, those that stand out still do, and the rest are level."""
    rng = np.random.default_rng(4)
    counts = rng.poisson(1_800_000, 1 << 16).astype(np.int64)
    counts[[5, 77]] += [9_000, 10**9]
    told = jaccard_join.standing_out(counts)
    assert told.dtype == np.uint16 and told[77] == 0xFFFF and told[5] > jaccard_join.HEAVY
    assert (told > jaccard_join.HEAVY).sum() < 70 and np.median(told) == 0
    few = np.array([0, 0, 0, 3, 70_000])
    assert jaccard_join.standing_out(few).tolist() == [0, 0, 0, 3, 0xFFFF]


@pytest.mark.parametrize("kind", ["level", "full", "noise"])
def test_links_whatever_the_sketch_says(spark, world, monkeypatch, kind):  # noqa: F811
    """The sketch steers cost alone: with counters that tell nothing, or all are heavy, the classes are the same."""
    want = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in run(spark, world, "op10_jaccard_join")}
    made = {"level": np.zeros_like, "full": lambda c: np.full_like(c, 0xFFFF), "noise": lambda c: np.random.default_rng(1).integers(0, 0xFFFF, len(c))}[kind]
    monkeypatch.setattr(jaccard_join, "standing_out", lambda counts: made(counts).astype(np.uint16))
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in run(spark, world, "op10_jaccard_join")} == want
