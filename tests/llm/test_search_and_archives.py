"""Neighbours against brute force, archives against what was written, the pipeline against its stages."""

import base64
import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest

from tests.llm.rows import documents, frame
from tracesift.llm import vptree, warc


def vectors():
    rng = random.Random(6)
    rows = [(k, [rng.gauss(0, 1) for _ in range(6)]) for k in range(300)]
    rows += [(300 + k, [1.0, 0.5, 0.0, 0.0, 0.0, -1.0]) for k in range(60)]  # copies
    rows += [(400 + k, [0.0] * k + [1.0] + [0.0] * (5 - k)) for k in range(6)]  # many ties at zero
    rows += [(500, None), (501, []), (502, [0.0] * 6), (503, [float("nan")] + [1.0] * 5), (504, [float("inf")] + [1.0] * 5), (505, [None] + [1.0] * 5), (None, [1.0] * 6), (506, [1.0, 2.0]), (520, [2.0, 1.0])]
    return [*rows, rows[0]]


def brute(rows, every, nearest):
    sound = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = set()
    for i, q in sound:
        if i % every == 0:
            scored = []
            for j, x in sound:
                if j != i and len(x) == len(q):
                    s = 0.0
                    for a, b in zip(q, x, strict=True):
                        s += a * b
                    scored.append((-s, j))
            out |= {(i, k, j, -s) for k, (s, j) in enumerate(sorted(scored)[:nearest], 1)}
    return out


@pytest.mark.parametrize(("shard", "block", "regions"), [(25_000, 20_000, None), (90, 7, None), (20, 4, 8)])
def test_exact_search_equals_brute_force(spark, shard, block, regions):
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<double>").repartition(3)
    got = {tuple(r) for r in vptree.search(spark, df, every=20, nearest=7, shard_rows=shard, block_rows=block, regions=regions).collect()}
    assert got == brute(vectors(), 20, 7)


def test_regions_are_ruled_out_and_a_larger_factor_keeps_the_recall(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(16, 6))
    centres *= 5 / np.linalg.norm(centres, axis=1, keepdims=True)
    x = np.repeat(centres, 150, axis=0) + rng.normal(size=(2400, 6)) * 0.15
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows, 40, 10)
    for factor, least in ((1.0, 1.0), (1.1, 0.9)):
        got = {tuple(r) for r in vptree.search(spark, df, every=40, nearest=10, shard_rows=200, factor=factor, regions=16).collect()}
        assert len({(a, c) for a, _, c, _ in got} & {(a, c) for a, _, c, _ in want}) >= least * len(want)
    top = vptree.Regions(x, float((x * x).sum(axis=1).max()) * 1.001, 16)
    d = top.distances(top.lifted(x, True))
    home = top.of(d)
    top.bounds = {r: np.array([d[home == r][:, list(top.paths[r])].min(axis=0), d[home == r][:, list(top.paths[r])].max(axis=0)]) for r in set(home.tolist())}
    q = top.distances(top.lifted(x[::40], False))
    y = top.lifted(x, True)
    true = np.linalg.norm(top.lifted(x[::40], False)[:, None, :] - y[None, :, :], axis=2)
    least = top.least(q)
    for r in set(home.tolist()):
        assert (least[:, r] <= true[:, home == r].min(axis=1) + 1e-9).all()
    kth = np.sort(true, axis=1)[:, 9]
    assert (least > kth[:, None]).mean() > 0.2  # what an exact search need not visit


def test_near_ties_beyond_the_spare_ones_are_all_scored():
    import numpy as np
    import pyarrow as pa

    base = np.array([1.0, 1e-9, 0.3])
    x = np.array([base + np.array([0.0, 1e-26 * k, 0.0]) for k in range(60)])
    tree = vptree.Tree(x, float((x * x).sum(axis=1).max()) * 1.001, leaf=8)
    trees = pa.table({"tree": pa.array([__import__("pickle").dumps((tree, [[k] for k in range(60)]))], pa.binary())})
    queries = pa.table({"uid": pa.array([0], pa.int64()), "v": pa.array([base.tolist()]), "known": pa.array([None], pa.float64())})
    got = vptree._search((pa.scalar(3),), queries, trees, 5, 1.0).to_pydict()
    want = sorted((-float(s), k) for k, s in enumerate(vptree._exact(np.repeat(base[None], 60, axis=0), x)))[:6]
    assert [(-s, i) for s, i in zip(got["score"], got["id"], strict=True)] == want


def test_relaxed_pruning_keeps_recall_on_clustered_vectors():
    import numpy as np

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 8)) * 4
    x = np.repeat(centres, 100, axis=0) + rng.normal(size=(4000, 8)) * 0.3
    tree = vptree.Tree(x, float((x * x).sum(axis=1).max()) * 1.001, leaf=64)
    q = x[::50]
    want = np.argsort(-(q @ x.T), axis=1)[:, :10]
    for factor, least in ((1.0, 1.0), (1.05, 0.9)):
        found, _ = tree.search(q, 10, 10, factor)
        recall = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(found.tolist(), want.tolist(), strict=True)])
        assert recall >= least, (factor, recall)


def test_no_vectors(spark):
    assert vptree.search(spark, spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


PAGES = [(3, "u3", "same"), (1, "u1", "same"), (2, None, "same"), (5, "a b\r\nc", "é" * 5000), (6, "u", None), (7, "u", ""), (8, "u", "x" * 300), (None, "u", "same"), (1, "u1", "same"), (9, "u\x00", "\r\n\r\nWARC/1.1")]


@pytest.mark.parametrize("chunk", [1 << 20, 64])
def test_archives_round_trip(spark, tmp_path, chunk):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, sha1 string").repartition(3)
    listed = warc.write_archives(spark, pages, tmp_path.as_uri() + "/w", chunk=chunk, archive=500)
    rows = warc.read_archives(listed, tmp_path.as_uri() + "/w", chunk=chunk).collect()
    least = defaultdict(lambda: None)
    for i, _, h in PAGES:
        if i is not None:
            least[h or ""] = i if least[h or ""] is None else min(i, least[h or ""])
    want = Counter()
    for i, _, h in PAGES:
        data, again = (h or "").encode(), i != least[h or ""]
        want[(i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", least[h or ""] if again else None)] += 1
    assert Counter((r.record_id, r.payload_bytes, r.prefix_sha1, r.record_type, r.refers_to) for r in rows if r.last) == want
    whole = defaultdict(bytes)
    for r in sorted((r for r in rows if r.record_type == "response" and r.record_id != 1), key=lambda r: (r.record_id, r.chunk_no)):
        assert len(r.data) <= chunk
        whole[r.record_id] += bytes(r.data)
        assert base64.b32encode(hashlib.sha1(whole[r.record_id]).digest()).decode() == r.prefix_sha1
    assert whole[5] == ("é" * 5000).encode() and whole[9] == b"\r\n\r\nWARC/1.1"


def test_no_pages(spark, tmp_path):
    listed = warc.write_archives(spark, spark.createDataFrame([], "page_id long, url string, html string"), tmp_path.as_uri() + "/w")
    assert warc.read_archives(listed, tmp_path.as_uri() + "/w").count() == 0


def test_pipeline_keeps_clean_documents_and_drops_the_others(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    rest = documents()[0][2:]
    text = lambda n: " ".join(f"w{rng.randint(0, 9999)}" for _ in range(n))
    rows = [(k, text(60), *rest) for k in range(40)]
    rows += [(100 + k, f"{text(30)} grubbo {text(10)} grubbo", *rest) for k in range(30)]
    item = text(14)
    rows += [(200, rows[3][1], *rest), (201, rows[3][1] + " end", *rest), (202, f"{text(40)} {item} {text(40)}", *rest), (203, item, *rest), (204, f"{text(20)} mail jo@ex.org {text(20)}", *rest), (205, None, *rest)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, int(100 <= k < 130)) for k in [*range(30), *range(100, 125)]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        if k < 4:
            assert docs.columns == frame(spark, rows).columns
            kept.append({r.doc_id: r.text for r in docs.collect()})
    assert set(kept[0]) == {r[0] for r in rows} - set(range(100, 130))
    assert set(kept[1]) == set(kept[0]) - {200, 201}
    assert set(kept[2]) == set(kept[1]) - {203} and item not in kept[2][202] and all(kept[2][k] == kept[1][k] for k in kept[2] if k != 202)
    assert "jo@" not in kept[3][204] and all(kept[3][k] == kept[2][k] for k in kept[3] if k != 204)
    assert {r.doc_id for r in docs.collect()} == set(kept[3])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
