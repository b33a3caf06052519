"""Kernels against plain re-statements, very long texts, and the pipeline on empty tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.rows import SCHEMA, documents, frame
from tracesift.llm import packing, pii, sharding, similar, simhash, substrings, tokenstore, toxicity, warc
from tracesift.llm.common import Scratch


def near_copies(rng, groups=25):
    texts = []
    for k in range(groups):
        base = [f"w{k}x{rng.randint(0, 300)}" for _ in range(rng.randint(40, 150))]
        for changed in (0, 1, 1, 2, 3, 5, 8):
            copy = list(base)
            for at in rng.sample(range(len(base)), min(changed, len(base))):
                copy[at] = f"new{rng.randint(0, 10**6)}"
            texts.append(" ".join(copy))
    return texts


def roots_of(n, pairs):
    root = list(range(n))
    for i, j in pairs:
        if root[i] != root[j]:
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_alike_links_what_all_pairs_link():
    rng = random.Random(12)
    sets = [similar.shingles(t.encode()) for t in near_copies(rng)] + [np.empty(0, dtype=np.uint64)] * 2
    jaccard = lambda a, b: len(np.intersect1d(a, b)) / max(1, len(np.union1d(a, b))) if len(a) or len(b) else 1.0
    want = roots_of(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8])
    assert roots_of(len(sets), similar.alike(sets)) == want


@pytest.mark.parametrize(("bucket", "block"), [(50_000, 1 << 18), (20, 400)])
def test_blocks_change_nothing(spark, monkeypatch, bucket, block):
    texts = near_copies(random.Random(13), 12)
    docs = frame(spark, [(k, t, *documents()[0][2:]) for k, t in enumerate(texts)])
    monkeypatch.setattr(similar.verified, "__defaults__", (similar.SHINGLE, block))
    rows = similar.grouped(Scratch(spark, "t"), docs.select("doc_id", "text"), bucket=bucket).collect()
    sets = [set(similar.shingles(t.encode()).tolist()) for t in texts]
    want = roots_of(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    groups = defaultdict(set)
    for r in rows:
        groups[bytes(r.component)].add(r.doc_id)
    assert {frozenset(g) for g in groups.values()} == {frozenset(k for k, r in enumerate(want) if r == x) for x in set(want)}


def test_links_of_many_rows_of_one_half_are_those_of_all_pairs():
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**63, (30, similar.WORDS), dtype=np.uint64)
    words = np.repeat(centre, 40, axis=0)
    for row in words:  # a few bits each
        for bit in rng.choice(64 * similar.WORDS, rng.integers(0, 40), replace=False):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    keys = np.sort((np.int64(5) << 56) | rng.integers(0, 2, len(words)))
    place = 4
    other = (words[:, place // 8] >> np.uint64(8 * (place % 8))) & np.uint64(255)
    pairs = [(i, j) for i in range(len(words)) for j in range(i) if keys[i] == keys[j] and int(other[i] ^ other[j]).bit_count() <= 1 and np.bitwise_count(words[i] ^ words[j]).sum() <= 90]
    a, b = similar.linked(keys, words, 90)
    assert roots_of(len(words), zip(a.tolist(), b.tolist(), strict=True)) == roots_of(len(words), pairs)


def test_the_ordinal_fit_is_the_plain_one():
    """Against gradient steps on the negative log likelihood, itself by numeric differences."""
    rng = np.random.default_rng(9)
    n, width = 60, 4
    x = (rng.random((n, width)) < 0.4) * rng.integers(1, 4, (n, width))
    grades = np.clip((x @ np.array([1.0, -0.7, 0.4, 0.2]) + rng.normal(size=n)).round().astype(int), 0, 2)
    weight, penalty = rng.random(n) + 0.5, 2.0
    rows, columns = np.nonzero(x)
    w, t = toxicity.fit_ordinal(rows, columns, x[rows, columns].astype(float), grades, weight, width, penalty=penalty, steps=2000)

    def loss(p):
        z, cuts = x @ p[:width], [p[width], p[width] + math.exp(p[width + 1])]
        total = 0.0
        for k in range(n):
            more = [1.0, *(1 / (1 + math.exp(-(z[k] - c))) for c in cuts), 0.0]
            total -= weight[k] / weight.sum() * math.log(more[grades[k]] - more[grades[k] + 1])
        return total + penalty / n / 2 * sum(v * v for v in p[:width])

    p = np.concatenate([np.zeros(width), [0.0, 0.0]])
    for _ in range(3000):
        g = np.array([(loss(p + e) - loss(p - e)) / 2e-5 for e in np.eye(width + 2) * 1e-5])
        p = p - 0.8 * g
        if np.abs(g).max() < 1e-5:
            break
    fitted = np.concatenate([w, [t[0], math.log(t[1] - t[0])]])
    assert loss(fitted) <= loss(p) + 1e-6
    assert np.allclose(fitted, p, atol=0.02)


def test_repeated_documents_of_a_label_are_fitted_once(spark):
    rows = [(k, "zorg vile zorg" if k % 2 else "plain calm words", *documents()[0][2:]) for k in range(40)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    once, often = toxicity.train(spark, frame(spark, rows), labels), toxicity.train(spark, frame(spark, rows + rows[:1] * 500 + rows[1:2] * 500), labels)
    assert np.array_equal(once.weights, often.weights) and once.limit == often.limit


def test_terms_are_those_of_all_counts(spark):
    rng = random.Random(21)
    names = [f"name{k}" for k in range(12)]
    texts = []
    for _ in range(400):
        who = rng.randrange(12)
        words = [rng.choice("alpha beta gamma delta epsilon".split()) for _ in range(6)] + ([names[who]] if rng.random() < 0.5 else []) + [f"r{rng.randint(0, 40)}"]
        if rng.random() < 0.8:
            words.append(f"u{who}@host{who % 3}.example.org")
        rng.shuffle(words)
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scratch = Scratch(spark, "t")
    got = {(r.entity, r.term): (round(r.share, 9), r.action) for r in pii.disclosing(scratch, docs, pii.base_table(scratch, docs, ["doc_id"])).collect()}
    n, n_term, n_entity, n_both, kinds = len(texts), Counter(), Counter(), Counter(), defaultdict(set)
    for t in texts:
        emails = re.findall(r"\S+@\S+", t)
        entities = {f"email:{e}" for e in emails} | {f"domain:{e.split('@')[1]}" for e in emails}
        terms = {w for w in re.findall(r"[a-z0-9]+", re.sub(r"\S+@\S+", " ", t)) if len(w) >= 3}
        n_entity.update(entities)
        n_term.update({w for w in re.findall(r"[a-z0-9]+", t) if len(w) >= 3})
        for e in entities:
            for w in terms:
                n_both[e, w] += 1
                kinds[e, w].add(t)
    want = {}
    for (e, w), both in n_both.items():
        share = math.log2(n * both / n_term[w] / n_entity[e]) / math.log2(n / n_entity[e])
        if len(kinds[e, w]) >= 3 and share >= 0.7:
            want[e, w] = (round(share, 9), "remove" if share >= 0.9 else "generalise")
    assert got == want and len(want) > 5


def test_texts_of_many_entities_and_of_many_words(spark):
    """A text of thousands of entities, and one of some MB, through the operators that read whole texts."""
    many = " ".join(f"word{k} u{k}@mail{k % 9}.example.com 10.0.{k % 255}.{k % 250}" for k in range(3000))
    long = " ".join(f"{k % 977}tok{k % 31}" for k in range(400_000))
    docs = spark.createDataFrame([(1, many), (2, long), (3, long + " tail"), (4, None)], "doc_id long, text string")
    found = {r.doc_id: r for r in pii.find(spark, docs).collect()}
    assert (found[1].n_email, found[1].n_ip, found[2].n_email, found[4].n_ip) == (3000, 3000, 0, 0)
    kept = {r.doc_id: r.text for r in pii.sanitise(spark, docs).collect()}
    assert kept[1] == " ".join(f"word{k} [EMAIL] [IP]" for k in range(3000)) and kept[2] == long and kept[4] is None
    assert {r.doc_id for r in similar.keep_one(spark, docs).collect()} == {1, 2, 4}
    assert len({r.component_id for r in simhash.near_duplicates(spark, docs).collect()}) == 3
    repeated = {r.doc_id: r for r in substrings.repeated(spark, docs).collect()}
    assert (repeated[2].n_words, repeated[2].n_removed, repeated[3].n_removed) == (400_000, 400_000, 400_000)
    stored = {r.doc_id: r for r in tokenstore.read_store(spark, tokenstore.write_store(spark, docs)).collect()}
    pieces = [r for r in packing.pack(spark, docs).collect() if r.doc_id == 2]
    assert sum(r.length for r in pieces) == stored[2].n_tokens and stored[4].n_tokens == 1
    assert {r.doc_id: r["size"] for r in sharding.shard(spark, docs).collect()}[2] == len(long) + 1


def test_archives_and_packs_are_read_by_many_tasks(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"u{k}", f"<p>{k % 60} {'x' * 50}</p>") for k in range(300)], "page_id long, url string, html string").repartition(6)
    listed = warc.write_archives(spark, pages, f"file://{tmp_path}/warc", archive=64)
    assert listed.count() >= 50
    read = warc.read_archives(listed, f"file://{tmp_path}/warc", with_data=True)
    tasks = read.selectExpr("spark_partition_id() AS p", "record_id", "data", "record_type").collect()
    assert len({r.p for r in tasks}) >= 30 and len({r.record_id for r in tasks}) == 300
    assert {bytes(r.data).decode() for r in tasks if r.record_type == "response"} == {f"<p>{k} {'x' * 50}</p>" for k in range(60)}


def test_ids_are_as_wide_as_the_pack_says(tmp_path):
    writer = tokenstore.PackWriter(f"file://{tmp_path}", 4)
    ids = np.array([1, 70_000, 5], dtype="<u4")
    name, _, _ = writer.add(ids.tobytes())
    writer.close()
    (_, item, lengths, data), = tokenstore.blocks(f"file://{tmp_path}", name)
    assert item == 4 and lengths.tolist() == [12] and bytes(data) == ids.tobytes()
    rows, = tokenstore._chunks([__import__("pyarrow").record_batch([[name]], names=["pack"])], f"file://{tmp_path}")
    assert rows.column("n").to_pylist() == [3] and rows.column("crc").to_pylist() == [zlib.crc32(ids.tobytes())]


def test_the_pipeline_on_empty_tables_and_repeated_ids(spark, tmp_path):
    import corpus_pipeline

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")

    labels, benchmark = "doc_id long, quality int, toxic int", "item_id long, text string"
    write("labels", [], labels)
    write("benchmark", [], benchmark)
    write("documents", [], SCHEMA)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    rows = [(1, f"text {k} of one id with words enough to stand alone {'very ' * k}", *documents()[0][2:]) for k in range(5)] + [(None, None, *documents()[0][2:]), (None, "", *documents()[0][2:])]
    write("documents", rows, SCHEMA)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in out) == {1: 5, None: 1}
