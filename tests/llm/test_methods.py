"""Parts of the operators against plain versions: hashes, indexes, graphs, gradients, neighbours; and stages over odd tables."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from bookmerge.llm import decontaminate, entries, jaccard_join, line_dedup, packing, quality_model
from tests.llm.test_operators import components, empty, shingles, tokens, world  # noqa: F401


def thue_morse(n, first):
    s = first
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s[:n]


def test_hashes_tell_crafted_words_apart():
    """Two words whose polynomial sums agree for any base modulo a power of two."""
    from bookmerge.llm import tokens as T
    from bookmerge.llm.shingles import shingle_sets

    a, b = thue_morse(4096, "a"), thue_morse(4096, "b")
    e = T.Encoder(T.definition_of(None))
    got = e.encode([a.encode(), b.encode(), f"{b} {a}".encode()]) + e.encode([b.encode(), a.encode()])
    want = [tokens(t)[:-1] for t in (a, b, f"{b} {a}", b, a)]
    assert [x.tolist() for x in got] == want
    x, y = shingle_sets([f"{a} w x y z".encode(), f"{b} w x y z".encode()])
    assert x.tolist() != y.tolist()


@pytest.mark.parametrize("points,hot", [(1_000_000, 64), (8, 64), (1_000_000, 0), (6, 1)])
def test_benchmark_index(points, hot):
    """Hits and items of random texts over few words, with one or two code points a word and crowded blocks."""
    from bookmerge.llm.decontaminate import Index

    rnd = random.Random(points + hot)
    for _ in range(30):
        items = [(str(n), " ".join(f"w{rnd.randrange(3)}" for _ in range(rnd.randrange(0, 25)))) for n in range(6)]
        index = Index([(n, t.encode()) for n, t in items], points=points, hot=hot)
        for _ in range(10):
            words = [f"w{rnd.randrange(3)}" for _ in range(rnd.randrange(0, 40))]
            at = rnd.randrange(len(words) + 1)
            words[at:at] = rnd.choice(items)[1].split()[: rnd.randrange(8, 14)]
            hit, found = np.zeros(len(words), bool), set()
            for k, (_, t) in enumerate(items):
                w = t.split()
                n = min(10, len(w))
                for i in range(len(w) - n + 1 if w else 0):
                    for j in range(len(words) - n + 1):
                        if words[j : j + n] == w[i : i + n]:
                            hit[j : j + n] = True
                            found.add(k)
            n, got, items_found = index.scan(" ".join(words).encode())
            assert n == len(words) and items_found == found and (got.tolist() if len(got) else [False] * n) == hit.tolist()


def test_quality_verdict_acts(spark):
    """kept against a plain count of documents a host; copies count one by one, rows of one doc_id once."""
    from bookmerge.llm.quality_rules import LOW, SHARE, judge

    rnd = random.Random(8)
    frames = [" ".join(f"f{k}x{i}" for i in range(70)) for k in range(6)]
    rows = []
    for i in range(160):
        own = " ".join(f"d{i}x{k}" for k in range(60))
        rows.append((i, "\n".join([*(f for k, f in enumerate(frames) if rnd.random() < (k + 1) / 40), own]), rnd.choice(["h", "g", None])))
    rows += [(200 + i, rows[3][1], "h") for i in range(9)] + [(300, rows[5][1], "g")] * 9
    docs, hosts = {}, {}
    for i, text, host in rows:
        hosts.setdefault(host, set()).add(i)
        for line in text.split("\n"):
            docs.setdefault((host, line), set()).add(i)
    want = Counter()
    for i, text, host in rows:
        limit = max(LOW, SHARE * len(hosts[host]))
        gone = sum(len(x.split()) for x in text.split("\n") if len(docs[host, x]) > limit)
        want[i, gone <= 0.5 * len(text.split())] += 1
    got = Counter((r["doc_id"], r["kept"]) for r in judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())
    assert got == want and sum(n for (_, kept), n in want.items() if not kept) > 10


def test_long_candidates_and_many_matches(spark):
    """Runs of 100,000 characters and as many matches; offsets stay those of a plain scan."""
    import re
    import time

    from bookmerge.llm.secrets import scan

    rnd = random.Random(3)
    run = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789") for _ in range(100_000))
    dull = "zy1" * 40_000
    many = " ".join(rnd.choice(["0123456789abcdef" * 2, "é" * rnd.randrange(5)]) for _ in range(20_000))
    began = time.time()
    got = {r["text"]: r for r in scan(spark.createDataFrame([(run,), (dull,), (many,)], "text string")).collect()}
    assert time.time() - began < 120
    (one,) = got[run]["all_spans"]
    assert one["start"] < 100 and one["end"] > 99_900 and not got[dull]["all_spans"]
    assert [(x["start"], x["end"]) for x in got[many]["base_spans"]] == [m.span() for m in re.finditer("[0-9a-f]{32,}", many)]


def test_components_of_random_graphs(spark):
    from bookmerge.llm.components import connected_components

    rnd = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 150)] + [(1000, 2000 + i) for i in range(10_000)] + [(500 + i, 500 + (i + 1) % 40) for i in range(40)]
    edges += [(rnd.randrange(20_000, 20_400), rnd.randrange(20_000, 20_400)) for _ in range(150)]
    rnd.shuffle(edges)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    inner = {n for e in edges if e[0] != e[1] for n in e}
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in inner}


def test_blocks_spread_over_redirects(spark):
    """Verdicts over random redirects, chains and a hub, against a plain search."""
    from bookmerge.llm.url_filters import judge

    rnd = random.Random(9)
    urls = [f"http://{rnd.choice(['bad.x', 'good.x', 'mid.y', 'far.z'])}/p{i}" for i in range(300)]
    moves = [(urls[i], urls[i + 1]) for i in range(100)] + [(urls[100], urls[k]) for k in range(101, 160)] + [(rnd.choice(urls[160:]), rnd.choice(urls[160:])) for _ in range(60)]
    near = {u: {u} for u in urls}
    for a, b in moves:
        both = near[a] | near[b]
        for u in both:
            near[u] = both
    own = lambda u: "block" if "bad.x" in u else "allow" if "good.x" in u else None
    want = {i: own(u) or ("block" if any(own(v) == "block" for v in near[u]) and not any(own(v) == "allow" for v in near[u]) else "allow") for i, u in enumerate(urls)}
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in judge(pages, [("block", "bad.x/"), ("allow", "good.x/")], spark.createDataFrame(moves, "a string, b string")).collect()}
    assert got == want and len(set(want.values())) == 2


def weights(rng):
    n, h, g = quality_model.FEATURES, 5, 3
    return {"w1": rng.normal(0, 0.3, (n, h)), "b1": rng.normal(0, 0.1, h), "v": rng.normal(0, 1, (h, g)), "u": rng.normal(0, 1, (h, g)), "a": rng.normal(0, 1, g), "c": rng.normal(0, 1, h), "b": np.array([0.2]), "mean": rng.normal(0, 0.1, n), "scale": rng.uniform(0.5, 1, n)}


def test_attention_forward():
    """Gated attention document by document in plain loops."""
    rng = np.random.default_rng(1)
    w, counts = weights(rng), np.array([1, 4, 2, 7])
    x = rng.normal(size=(counts.sum(), quality_model.FEATURES))
    got, at = quality_model.forward(w, x, counts)["score"], 0
    for k, n in enumerate(counts):
        h = [np.tanh((x[at + i] - w["mean"]) / w["scale"] @ w["w1"] + w["b1"]) for i in range(n)]
        s = np.array([np.dot(w["a"], np.tanh(v @ w["v"]) / (1 + np.exp(-(v @ w["u"])))) for v in h])
        share = np.exp(s) / np.exp(s).sum()
        z = sum(p * v for p, v in zip(share, h, strict=True))
        assert np.isclose(got[k], 1 / (1 + np.exp(-(z @ w["c"] + w["b"][0]))))
        at += n


def test_attention_gradient(monkeypatch):
    """One step of fitting moves each weight against the numeric gradient's sign."""
    rng = np.random.default_rng(2)
    monkeypatch.setattr(quality_model, "HIDDEN", 4)
    monkeypatch.setattr(quality_model, "GATE", 3)
    counts = rng.integers(1, 5, 12)
    x, y = rng.normal(size=(counts.sum(), quality_model.FEATURES)), rng.integers(0, 2, 12).astype(float)
    start = quality_model.fit(x, counts, y, epochs=0)
    after = quality_model.fit(x, counts, y, epochs=1)

    def loss(w):
        p = quality_model.forward(w, x, counts)["score"]
        reg = sum(5e-5 * (w[k] ** 2).sum() for k in ("w1", "b1", "v", "u", "a", "c", "b"))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)) + reg

    for k in ("w1", "b1", "v", "u", "a", "c", "b"):
        flat = start[k].reshape(-1)
        for i in rng.choice(flat.size, min(6, flat.size), replace=False):
            up, down = ({**start, k: start[k].copy()} for _ in range(2))
            up[k].reshape(-1)[i] += 1e-5
            down[k].reshape(-1)[i] -= 1e-5
            slope = (loss(up) - loss(down)) / 2e-5
            if abs(slope) > 1e-6:
                assert np.sign(after[k].reshape(-1)[i] - flat[i]) == -np.sign(slope), k


def test_neighbours_on_the_curve_are_alike():
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist() if t and len(t) > 300]
    ids = [np.array(tokens(t), np.uint32) for t in texts]
    points = packing.points_of(ids, packing.projection())
    order = np.argsort(packing.curve_keys(points, points.mean(axis=0), points.std(axis=0)))
    bags = [Counter(i.tolist()) for i in ids]

    def alike(a, b):
        x, y = bags[a], bags[b]
        return sum(x[k] * y[k] for k in x) / (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5

    rnd = random.Random(1)
    near = np.mean([alike(a, b) for a, b in zip(order[:-1], order[1:], strict=True)])
    far = np.mean([alike(*rnd.sample(range(len(ids)), 2)) for _ in range(2000)])
    assert near > far + 0.1


def test_op8_long_documents_in_chunks(spark, monkeypatch):
    """Chunks of one document join to pieces again; no id is lost or doubled."""
    monkeypatch.setattr(packing, "CHUNK", 100)
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(["alpha", "beta", "gamma"]) for _ in range(n)) for n in (5, 950, 9000, 30, 0, 4100)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1, texts[1])]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    whole = {i: tokens(t) for i, t in rows}
    for r in got:
        assert np.frombuffer(r["ids"], "<u4").tolist() == whole[r["doc_id"]][r["start"] : r["start"] + r["length"]]
    assert sum(r["length"] for r in got) == sum(len(whole[i]) for i, _ in rows)
    assert len(got) < 100


def test_every_link_and_its_count(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LONG", 12)
    monkeypatch.setattr(jaccard_join, "BLOCK_MEMBERS", 5)
    rnd = random.Random(11)
    base = [f"w{rnd.randrange(300)}" for _ in range(50)]
    rows = []
    for i in range(45):
        t = list(base)
        for _ in range(rnd.choice([0, 0, 1, 2, 3])):
            t[rnd.randrange(50)] = f"x{rnd.randrange(99)}"
        rows.append((i, " ".join(t[: rnd.choice([50, 50, 46, 12, 8])])))
    rows += [(90, None), (91, ""), (92, "one two"), (93, "ONE two")]
    sets = [shingles(t) for _, t in rows]
    links = lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)
    want = {i: sum(links(s, t) for k, t in enumerate(sets) if k != n) for n, ((i, _), s) in enumerate(zip(rows, sets, strict=True))}
    got = {r["d"]: r["n_links"] for r in jaccard_join.link_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and max(want.values()) > 5


STAGES = {"quality": quality_model.stage, "lines": line_dedup.stage, "jaccard": jaccard_join.stage, "benchmark": decontaminate.stage, "packing": packing.stage}


@pytest.mark.parametrize("name", STAGES)
def test_stages_over_empty_tables(spark, empty, name):  # noqa: F811
    assert STAGES[name](spark, spark.read.parquet(f"{empty}/documents.parquet"), empty).count() == 0


@pytest.mark.parametrize("name", STAGES)
def test_stages_over_nulls_repeats_and_clashing_names(spark, world, name):  # noqa: F811
    """Columns named like the stages' own, rows twice, null ids and texts: each stage runs and keeps whole rows."""
    long = " ".join(f"u{k}" for k in range(150_000))
    rows = [(None, None, "a", 1), (None, "", "b", 2), (7, "one two three", None, 3), (7, "one two three", None, 3), (8, long, "c", None), (9, "same line of text here\nand more", "d", 5), (10, "same line of text here", "e", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string, class long").toDF("doc_id", "text", "Text", "DOC_ID")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        got = STAGES[name](spark, docs, world[0]).collect()
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
    if name == "packing":
        assert sum(r["length"] for r in got) == sum(len(tokens(t)) for _, t, _, _ in rows)
    else:
        ids = Counter(r["doc_id"] for r in got)
        every = Counter(r[0] for r in rows)
        if name == "lines":
            assert ids == every and {r["text"] for r in got if r["doc_id"] == 10} == {""}
        elif name == "jaccard":
            part = components([(-1 if i is None else i, t) for i, t, _, _ in rows])
            assert ids == Counter({i: n for i, n in every.items() if part[-1 if i is None else i] == (-1 if i is None else i)})
        elif name == "benchmark":
            assert ids == every
        assert all(not (ids - every) for _ in [0]) and all(len(r) == 4 for r in got)


@pytest.mark.parametrize("name", ["op1_decontaminate", "op3_url_filters", "op4_chat_windows", "op6_quality_model"])
def test_side_tables_with_clashing_columns(spark, world, tmp_path, name):  # noqa: F811
    """benchmark, labels, pages and conversations with extra columns that differ from theirs in case alone."""
    import pyarrow.parquet as pq

    for table in ("documents", "benchmark", "conversations", "pages", "labels"):
        t = pq.read_table(f"{world[0]}/{table}.parquet")
        for c in t.column_names[:3]:
            t = t.append_column(c.upper(), pa.array([str(i) for i in range(t.num_rows)]))
        pq.write_table(t, f"{tmp_path}/{table}.parquet")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        assert entries.queries()[name](spark, str(tmp_path)).count() == entries.queries()[name](spark, world[0]).count()
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
