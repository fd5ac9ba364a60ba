"""Prefix trie, alignment and near vectors over small odd tables, against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from bookmerge.llm import alignment, entries, near_vectors, prefix_trie
from bookmerge.llm.hnsw import Graph
from tests.llm.test_operators import rows_of_documents


def put(folder, name, rows, types):
    pq.write_table(pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(types.items())}), f"{folder}/{name}.parquet")


# ---- prefix trie

CONV = {"conv_id": pa.int64(), "turn": pa.int64(), "role": pa.string(), "text": pa.string(), "depth": pa.int64(), "node": pa.string()}


def conversations(seed=4):
    rnd = random.Random(seed)
    turns = [("user", "hi"), ("user", "hi there\tyou\n"), ("assistant", "ok  ok"), (None, "x"), ("", "x"), ("user", None), ("user", ""), ("1:a", "b"), ("1", ":ab")]
    rows = []
    for c in [*range(0, 90), -3, -20, -23, 1_000, 10**12 + 7]:
        for t in range(rnd.randrange(1, 7)):
            rows.append((c, t, *turns[min(rnd.randrange(9), rnd.randrange(9))], 5, "clash"))
    first = [r for r in rows if r[0] == 41]
    rows += [(c, *r[1:]) for c in range(200, 260) for r in first]  # copies
    rows += [(*r, 5, "clash") for r in ((7, None, "user", "first"), (7, None, "user", "first"), (8, 1, "b", "tie"), (8, 1, "a", "tie"))]
    rnd.shuffle(rows)
    return rows


def plain_trie(rows):
    own = defaultdict(list)
    for c, t, role, text, *_ in rows:
        own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [(r[2], r[3]) for r in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if c is not None else 0
        head = own.get(c - int(np.fmod(c, 20)), []) if c is not None else []
        rebuilt[c] = (*head[:h], *v[h:])
    held = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            held[turns[:d]].append(c)
    low = lambda x: min((c for c in x if c is not None), default=None)
    out = []
    for path, members in held.items():
        below = [p for p in held if p[: len(path)] == path]
        kids = lambda p: [q for q in held if len(q) == len(p) + 1 and q[:-1] == p]
        saved = sum((len(held[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in members if rebuilt[c] == path)))
        out.append((low(members), len(path), low(held[path[:-1]]) if path else None, len(members), len(kids(path)), sum(not kids(p) for p in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("size", [1024, 5])
def test_trie(spark, tmp_path, size):
    rows = conversations()
    put(tmp_path, "conversations", rows, CONV)
    turns = prefix_trie.rebuilt(prefix_trie.turns_of(spark.read.parquet(f"{tmp_path}/conversations.parquet")))
    nodes = prefix_trie.trie(turns, size)
    want = plain_trie(rows)
    assert sorted((tuple(r) for r in nodes.select(TRIE).collect()), key=repr) == want
    told = duckdb.connect().sql(prefix_trie.ORACLE.replace("from conversations", f"from '{tmp_path}/conversations.parquet'")).fetchall()
    assert sorted(told, key=repr) == want
    assert prefix_trie.members(turns, nodes).count() == len({r[0] for r in rows})


def test_trie_of_odd_ids(spark):
    """Rows without conv_id are one conversation, a long chain needs few rounds, and an end at the root is told."""
    rows = [(None, 0, "user", "lost", 1, ""), (None, 1, "user", "gone", 1, ""), (3, 0, "user", "lost", 1, "")]
    rows += [(c, t, "user", f"t{t}", 1, "") for c in (400, 500) for t in range(130)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, Depth long, node string")
    got = sorted((tuple(r) for r in prefix_trie.trie(prefix_trie.turns_of(df).unionByName(prefix_trie.rebuilt(prefix_trie.turns_of(df)).where("place = -1"))).select(TRIE).collect()), key=repr)
    by = {(r[1], r[0]): r for r in got}
    assert by[0, 3][3:6] == (4, 2, 2) and by[1, 3][3:7] == (2, 1, 1, 1) and by[2, None][3] == 1
    assert by[1, 400][6] == 130 and by[130, 400][7] == hashlib.sha256(b"400,500").hexdigest()


# ---- alignment


def plain_alignment(texts):
    a_tok, b_tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a_tok.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in plain)}
    found, held = [], Counter()
    for t in texts:
        groups, links, a, b = [], Counter(), [], []
        if t:
            a, b = a_tok.encode(" " + t, add_special_tokens=False).ids, b_tok.encode(t)
            raw_a = [bytes(byte[c] for c in a_tok.id_to_token(i)) for i in a]
            raw_b = [bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if not b"".join(raw_a) == b"".join(raw_b) == (" " + t).encode():
                a, b = [], []
        if a:
            ends = [set(np.cumsum([len(x) for x in raw]).tolist()) for raw in (raw_a, raw_b)]
            at_a = at_b = i = j = 0
            for end in sorted(ends[0] & ends[1]):
                x, y = [], []
                while at_a < end:
                    x.append(a[i])
                    at_a += len(raw_a[i])
                    i += 1
                while at_b < end:
                    y.append(b[j])
                    at_b += len(raw_b[j])
                    j += 1
                groups.append((x, y))
                links.update((p, q) for p in x for q in y)
        held.update(set(links))
        found.append((a, b, groups, links))
    best = defaultdict(int)
    for (p, _), n in held.items():
        best[p] = max(best[p], n)
    text = lambda groups: hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest() if groups else ""
    return [(len(a), len(b), len(g), sum(x.values()), sum(n for k, n in x.items() if held[k] == best[k[0]]), sum(n * held[k] for k, n in x.items()), text(g)) for a, b, g, x in found]


ODD = ["a  b", " x", "x ", "\n", " ", "don't  'll 12 3", "<|endoftext|> <s> </s>", "= " * 5 + "=" * 600, "▁ x", "aaaa" * 80 + "▁", "é😀​中文字\x00\x1f y", "ﬁ n̈ ▁", "\ta\n b\r\n"]


def test_alignment(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(alignment, "PART", 150)
    monkeypatch.setattr(alignment, "BLOCK", 4000)
    monkeypatch.setattr(alignment, "SINGLE", 6)
    rows = [(r["doc_id"], r["text"] if r["text"] is None else r["text"][:3000], "clash") for r in rows_of_documents()] + [(1000 + i, t, "") for i, t in enumerate(ODD)] + [(2000, ODD[0], ""), (None, ODD[0], "")]
    rnd = random.Random(8)
    rows += [(3000 + i, "".join(rnd.choice("ab é😀\n\t  '’s12中\x1f.=-▁<|") for _ in range(rnd.randrange(1, 60))), "") for i in range(300)]
    put(tmp_path, "documents", rows, {"doc_id": pa.int64(), "text": pa.string(), "KEY": pa.string()})
    got = sorted((tuple(r) for r in alignment.aligned_documents(spark.read.parquet(f"{tmp_path}/documents.parquet"), *alignment.files()).collect()), key=repr)
    assert got == sorted(((i, *x) for (i, *_), x in zip(rows, plain_alignment([r[1] for r in rows]), strict=True)), key=repr)


def test_parts_and_blocks_change_nothing():
    """A text that is worked off in many parts has the figures of one part."""
    aligner = alignment.Aligner(*alignment.files())
    text = " ".join(f"word{i % 37} \n Zz{i}" for i in range(3000))
    rows = []
    for part in (1 << 22, 97):
        alignment.PART, old = part, alignment.PART
        try:
            block = alignment.Block(aligner)
            block.add(b"k", text, 3)
            first, *lists = block.rows()
        finally:
            alignment.PART = old
        rows.append((pa.ipc.open_stream(first.column("body")[0].as_py()).read_all().to_pylist(), [(x.column("pair")[0].as_py(), x.column("weight")[0].as_py()) for x in lists]))
    assert rows[0] == rows[1]
    assert rows[0][0][0]["groups_sha256"] == plain_alignment([text])[0][6]
    assert {w for _, x in rows[0][1] for w in x} == {3}


def test_group_with_very_many_tokens():
    """Two tokenizers that never meet inside a run: links are counted, not listed."""
    aligner = alignment.Aligner(*alignment.files())
    odd = next((t for t in ("-" * 5001, "=" * 5003, "a" * 5001, "ab" * 2501) if plain_alignment([t])[0][2] < 20), None)
    for text in [t for t in (odd, "_" * 3001, "　" * 801) if t]:
        block = alignment.Block(aligner)
        block.add(b"k", text, 1)
        body = pa.ipc.open_stream(next(block.rows()).column("body")[0].as_py()).read_all().to_pylist()[0]
        assert (body["n_a"], body["n_b"], body["n_groups"], body["n_links"], body["groups_sha256"]) == (*plain_alignment([text])[0][:4], plain_alignment([text])[0][6])


# ---- near vectors


def plain_links(rows, least):
    unit = []
    for _, v, *_ in rows:
        v = None if v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not any(v) else np.asarray(v, np.float64) / np.abs(np.asarray(v, np.float64)).max()
        unit.append(None if v is None else v / np.linalg.norm(v))
    near = [[j for j, y in enumerate(unit) if j != i and x is not None and y is not None and len(x) == len(y) and x @ y >= least] for i, x in enumerate(unit)]
    out, seen = [None] * len(rows), set()
    for i in range(len(rows)):
        if i not in seen:
            group, todo = [], [i]
            seen.add(i)
            while todo:
                group.append(k := todo.pop())
                todo += [j for j in near[k] if j not in seen]
                seen.update(near[k])
            ids = [rows[k][0] for k in group if rows[k][0] is not None]
            for k in group:
                out[k] = (rows[k][0], len(near[k]), min(ids, default=None), rows[k][0] == min(ids, default=None))
    return sorted(out, key=repr)


def odd_vectors():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 12))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base + rng.normal(size=base.shape) * s for s in (0, 0.05, 0.2, 0.3)]))]
    hub = rng.normal(size=12)
    rows += [(1000 + i, (hub + rng.normal(size=12) * 0.12).tolist()) for i in range(150)]  # a large group of near ones
    rows += [(2000 + i, rows[3][1]) for i in range(40)]  # copies
    rows += [(3000, None), (3001, []), (3002, [0.0] * 12), (3003, [1.0] * 11 + [None]), (3004, [float("nan")] + [1.0] * 11), (3005, [float("inf")] * 12), (3006, [1.0, 2.0]), (3007, [2.0, 4.0]), (3008, [-1.0, -2.0])]
    rows += [(3009, [1e300] * 12), (3010, [1e-300] * 12), (5, rows[9][1]), (None, rows[11][1]), (None, (rng.normal(size=12) * 50).tolist()), (3011, [-0.0] * 11 + [1.0]), (3012, [0.0] * 11 + [1.0])]
    return rows


@pytest.mark.parametrize("beam", [(32, 512), (1, 2)])
def test_near_vectors(spark, monkeypatch, beam):
    """Narrow beams are widened by the audit, and what the widest one can't hold is scanned."""
    monkeypatch.setattr(near_vectors, "BEAM", beam[0])
    monkeypatch.setattr(near_vectors, "WIDEST", beam[1])
    rows = [(*r, "clash") for r in odd_vectors()]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, Links string")
    assert sorted((tuple(r) for r in near_vectors.near_vectors(df).collect()), key=repr) == plain_links(rows, 0.9)


def test_near_vectors_in_passes(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "PASS_BYTES", 1)
    monkeypatch.setattr(near_vectors, "SHARD", 20)
    rows = odd_vectors()[:120]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(i, np.asarray(v, np.float32).astype(float).tolist()) for i, v in rows]
    assert sorted((tuple(r) for r in near_vectors.near_vectors(df).collect()), key=repr) == plain_links(rows, 0.9)


@pytest.mark.parametrize("widest", [512, 1])
def test_own_shard_counts_each_link_once(monkeypatch, widest):
    """Links between scanned and other vectors, or two scanned ones, count once on either side."""
    monkeypatch.setattr(near_vectors, "WIDEST", widest)
    monkeypatch.setattr(near_vectors, "BEAM", 1)
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(size=(50, 8)), rng.normal(size=8) + rng.normal(size=(70, 8)) * 0.1])
    v /= np.linalg.norm(v, axis=1)[:, None]
    levels = Graph.levels(len(v))
    order = np.argsort(-levels, kind="stable")
    x = v[order]
    copies = rng.integers(1, 5, len(x))
    n, _, label = near_vectors.linked(x, copies, x, copies, Graph.built(x.astype(np.float32), levels[order]).layers, 0.9, own=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    assert (n == near @ copies).all()
    assert (np.unique(label[near.nonzero()[0]]).size, (label[near.nonzero()[0]] == label[near.nonzero()[1]]).all()) == (np.unique(label[near.any(1)]).size, True)


def test_graph_recall():
    """Every layer's links point into the layer, and near neighbours are found at a width far below the shard."""
    rng = np.random.default_rng(1)
    v = rng.normal(size=(400, 24)).repeat(5, axis=0) + rng.normal(size=(2000, 24)) * 0.1
    v = (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32)
    levels = Graph.levels(len(v))
    order = np.argsort(-levels, kind="stable")
    graph = Graph.built(v[order], levels[order])
    assert len(graph.layers) > 1 and all(layer.max() < len(layer) for layer in graph.layers)
    ids, sims = graph.search(graph.vectors, 16)
    true = graph.vectors @ graph.vectors.T >= 0.9
    found = sum(np.isin(np.flatnonzero(t), i).sum() for t, i in zip(true, ids, strict=True))
    assert found >= 0.99 * true.sum()
    assert np.allclose(sims[:, 0], 1, atol=1e-5)


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_alignment", "op13_near_vectors"])
def test_empty(spark, tmp_path, name):
    put(tmp_path, "conversations", [], CONV)
    put(tmp_path, "documents", [], {"doc_id": pa.int64(), "text": pa.string()})
    put(tmp_path, "embeddings", [], {"vec_id": pa.int64(), "embedding": pa.list_(pa.float32()), "label": pa.int32()})
    assert entries.queries()[name](spark, str(tmp_path)).count() == 0
