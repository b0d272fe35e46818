import random
import re
from itertools import combinations

import duckdb
import numpy as np

from tidemark.llm import line_dedup, minhash
from tidemark.llm.common import components


def test_line_dedup_rules(spark):
    shared = "  Read   MORE\there "
    rows = [(k, f"own {k}\n{shared}\n\nend {k}", k, "r") for k in range(12)]
    rows += [(12, "read more here", 0, "r"), (13, None, 0, "r"), (14, "", 0, "r"), (15, "a\nb", 0, "r"), (15, "a\nb", 0, "r"), (None, "x\nREAD more HERE", 0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k long, r string")
    out = line_dedup.line_dedup(docs).collect()
    assert out and docs.columns == line_dedup.line_dedup(docs).columns
    got = sorted(str((str(r.doc_id), r.text)) for r in out)
    want = [(str(k), f"own {k}\n\nend {k}") for k in range(12)] + [("12", ""), ("13", None), ("14", ""), ("15", "a\nb"), ("15", "a\nb"), ("None", "x")]
    assert got == sorted(map(str, want))


def test_line_dedup_copies_are_one_document(spark):
    docs = spark.createDataFrame([(k, "page\nlast") for k in range(40)], "doc_id long, text string")
    assert {r.text for r in line_dedup.line_dedup(docs).collect()} == {"page\nlast"}
    assert line_dedup.line_dedup(docs.limit(0)).collect() == []


def test_line_dedup_of_a_long_text(spark):
    lines = [f"own {k}" if k % 3 else "  Shared\tLINE" for k in range(300_000)]
    rows = [(k, f"shared line\nrest {k}", "m", 1) for k in range(11)] + [(50, "\n".join(lines), "m", 1), (51, "\n" * 200_000, "m", 1), (52, None, None, None), (53, "", "m", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mask string, k int")
    out = {r.doc_id: r.text for r in line_dedup.line_dedup(docs).collect()}
    assert out[50] == "\n".join(x for x in lines if x.startswith("own")) and out[0] == "rest 0"
    assert out[51] == "\n" * 200_000 and out[52] is None and out[53] == ""


def test_line_dedup_equals_sql(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "source", "text")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(x[:4] for x in c.execute(line_dedup.SQL).fetchall())
    assert sorted(map(tuple, line_dedup.line_dedup(docs).collect())) == want


def shingle_set(text, n=3):
    w = re.findall(r"[^\W_]+", text.lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def groups_of(rows):
    return {r.doc_id: r.group_id for r in rows}


def test_near_duplicates_recall(spark):
    rng = random.Random(1)
    vocab = [f"w{k}" for k in range(3000)]
    base = [rng.choices(vocab, k=rng.randrange(60, 400)) for _ in range(150)]
    rows, boiler = [], rng.choices(vocab, k=25)
    for b, w in enumerate(base):
        for _ in range(rng.choice([1, 1, 2, 3, 9])):
            rate = rng.choice([0, 0.01, 0.05])
            rows.append((len(rows), " ".join((boiler if b % 2 else []) + [x if rng.random() > rate else rng.choice(vocab) for x in w])))
    got = groups_of(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    sets = [shingle_set(t) for _, t in rows]
    j = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in combinations(range(len(rows)), 2)}
    close = [p for p, v in j.items() if v >= 0.55]
    hit = [p for p in close if got.get(p[0], -1) == got.get(p[1], -2)]
    assert len(hit) >= 0.98 * len(close)
    joined = [p for p in j if got.get(p[0], -1) == got.get(p[1], -2)]
    assert all(j[p] > 0.3 for p in joined)


def test_near_duplicates_edges(spark):
    text = " ".join(f"v{k}" for k in range(80))
    rows = [(1, text, 1), (2, text.upper(), 2), (2, text.upper(), 2), (3, text + " more", 3), (4, None, 4), (5, "", 5), (6, "", 6), (7, "!!! ???", 7), (None, text, 8), (8, "hi", 9), (9, "Hi!", 9), (10, "hi there", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int")
    assert groups_of(minhash.near_duplicates(docs).collect()) == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}
    left = minhash.near_dedup(docs)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(["1", "4", "5", "6", "7", "None", "8", "10"])
    assert minhash.near_duplicates(docs.limit(0)).collect() == []


def test_many_copies_with_one_label(spark):
    rng = random.Random(2)
    w = [f"c{k}" for k in range(2000)]
    rows = [(k, " ".join(w[:i] + ["x"] + w[i + 1 :])) for k, i in enumerate(rng.sample(range(2000), 150))]
    got = groups_of(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {k: 0 for k in range(150)}


def test_regions_reach_every_close_pair():
    rng = np.random.default_rng(1)
    label = np.sort(rng.integers(0, 3, (400, 8)).astype(np.uint32).view([("", np.uint32)] * 8).ravel()).view(np.uint32).reshape(400, 8)
    i, j, large = minhash.regions(label)
    pairs = set(zip(i.tolist(), j.tolist()))
    assert all((k, k + 1) in pairs for k in range(399) if label[k, 0] == label[k + 1, 0])
    assert all(j - i < minhash.LEAF for i, j in pairs)
    for a, b, d in large:
        assert b - a > minhash.LEAF and (label[a:b, :d] == label[a, :d]).all()
    for a in range(400):  # a pair is in a leaf, or in a region that is large at every depth it shares
        for b in range(a + 1, min(400, a + 40)):
            d = int(np.argmin(np.append(label[a] == label[b], False)))
            if d and (a, b) not in pairs:
                assert ((label[:, :d] == label[a, :d]).all(axis=1)).sum() > minhash.LEAF


def star(size, keep, seed, words=260):
    """A document and copies of it that were edited apart from one another: few pairs but those with it are near."""
    rng = random.Random(seed)
    w = [f"s{seed}x{k}" for k in range(words)]
    rows = [" ".join(w)]
    for k in range(size):
        spans = [w[i : i + 13] for i in range(0, words, 13)]
        out = [x if rng.random() < keep else [f"n{seed}y{k}z{rng.random()}" for _ in x] for x in spans]
        rows.append(" ".join(sum(out, [])))
    return rows


def test_copies_that_are_near_their_original_only(spark):
    rows, of = [], []
    for seed, size in enumerate((30, 100, 600, 2500)):
        made = star(size, 0.78, seed)
        of += [(len(rows), len(rows) + k) for k in range(1, len(made))]
        rows += made
    order = list(range(len(rows)))
    random.Random(5).shuffle(order)
    docs = spark.createDataFrame([(order[k], t) for k, t in enumerate(rows)], "doc_id long, text string").repartition(4, "doc_id")
    got = groups_of(minhash.near_duplicates(docs).collect())
    sets = [shingle_set(t) for t in rows]
    close = [(a, b) for a, b in of if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5]
    assert len(close) > 1500
    for first in {a for a, _ in close}:
        mine = [(a, b) for a, b in close if a == first]
        assert np.mean([got.get(order[a], -1) == got.get(order[b], -2) for a, b in mine]) >= 0.9


def test_hot_region_is_linear_and_may_be_cut():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    n = 60_000
    label = np.zeros((n, 8), np.uint32)
    label[:, 1:] = rng.integers(0, 40, (n, 7))
    low = rng.integers(0, 256, (n, 128)).astype(np.uint8)
    twin = rng.permutation(n)[:2000].reshape(-1, 2)  # pairs that share seven bytes of eight
    for a, b in twin:
        label[b] = label[a]
        low[b] = np.where(rng.random(128) < 0.9, low[a], low[b])
    order = np.lexsort(label.T[::-1])

    def batches():
        for i in range(0, n, 5000):
            o = order[i : i + 5000]
            yield pa.RecordBatch.from_arrays([pa.array(o), pa.array(np.zeros(len(o), np.int32)), minhash._fixed(label[o].astype(">u4")), minhash._fixed(low[o])], ["node", "tree", "label", "low"])

    found = [{(a, b) for x in minhash._pairs(batches(), 0.5, block) for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist())} for block in (7000, 100_000)]
    want = {(min(a, b), max(a, b)) for a, b in twin.tolist()}
    assert want <= found[0] and want <= found[1]


def test_components(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(60)] + [(100 + rng.randrange(50), 100 + rng.randrange(50)) for _ in range(40)] + [(5, None), (None, None), (300, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for x in parent}


def test_work_dir_is_qualified(spark):
    from tidemark.llm.common import work_dir

    import pyarrow.fs as pafs

    assert work_dir(spark).startswith("file:///") and pafs.FileSystem.from_uri(work_dir(spark))[1].startswith("/")


def test_near_copies_in_a_script_without_spaces(spark):
    rng = random.Random(6)
    base = [chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(300)]
    near = [c if k % 60 else "好" for k, c in enumerate(base)]
    other = [chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(300)]
    docs = spark.createDataFrame([(k, "".join(t)) for k, t in enumerate((base, near, other))], "doc_id long, text string")
    assert groups_of(minhash.near_duplicates(docs).collect()) == {0: 0, 1: 0}
