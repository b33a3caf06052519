"""Each operator on awkward rows against a plain re-statement of what it must return."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.rows import SCHEMA, documents, frame
from tracesift.llm import decontamination, packing, pii, sharding, simhash, similar, substrings, tokenstore, toxicity
from tracesift.llm.common import Scratch
from tracesift.llm.components import components
from tracesift.llm.tokens import Encoder, tokenizer_path

SPACE = r"[^\x20\x09-\x0D]+"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def ids_of(text, end):
    from tokenizers import Tokenizer

    ids_of.tokenizer = getattr(ids_of, "tokenizer", None) or Tokenizer.from_file(tokenizer_path())
    return np.array([*ids_of.tokenizer.encode(text or "", add_special_tokens=False).ids, end], dtype="<u4")


def simhash_of(text):
    words = re.findall(SPACE, lower(text))
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(prints, distance=4):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(prints))]


@pytest.mark.parametrize("bucket", [50_000, 2])
def test_simhash_components(spark, bucket):
    rows = documents()
    prints = [simhash_of(r[1]) for r in rows]
    roots = components_of(prints)
    least = {g: min((r[0] for r, x in zip(rows, roots, strict=True) if x == g and r[0] is not None), default=None) for g in roots}
    want = Counter((r[0], f"{p:016x}", least[g]) for r, p, g in zip(rows, prints, roots, strict=True))
    got = Counter(map(tuple, simhash.near_duplicates(spark, frame(spark), bucket=bucket).collect()))
    assert got == want


def test_simhash_links_every_near_pair_of_random_fingerprints(spark):
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 2**63, 60, dtype=np.uint64)
    near = np.array([c ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for c in centre for k in (1, 2, 3, 4, 5)], dtype=np.uint64)
    values = np.unique(np.concatenate([centre, near]))
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    for bucket in (50_000, 4):
        rows = simhash.variants(df, bucket=bucket).groupBy("key").agg(F.collect_list("fp").alias("f")).collect()
        met = {tuple(sorted((a, b))) for r in rows for a in r.f for b in r.f if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
        signed = values.view(np.int64).tolist()
        assert met == {tuple(sorted((a, b))) for a in signed for b in signed if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4}


def test_simhash_variants_are_never_what_is_broadcast(spark, tmp_path):
    spark.range(20_000).selectExpr("xxhash64(id) AS fp").write.parquet(f"file://{tmp_path}/fps")
    stored = spark.read.schema("fp long").parquet(f"file://{tmp_path}/fps")
    for bucket in (50_000, 4):
        plan = simhash.variants(stored, bucket=bucket)._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("BuildRight") == 2 and "BuildLeft" not in plan and "SortMergeJoin" not in plan
    assert simhash.variants(stored).count() == 64 * 20_000


def test_keep_one_keeps_one_of_each_component(spark):
    rows = documents()
    roots = components_of([simhash_of(r[1]) for r in rows])
    kept = simhash.keep_one(spark, frame(spark))
    assert kept.columns == frame(spark).columns
    got = kept.collect()
    assert len(got) == len(set(roots))
    by_id = defaultdict(set)
    for r, g in zip(rows, roots, strict=True):
        by_id[(r[0], r[1])].add(g)
    assert len({g for r in got for g in by_id[(r.doc_id, r.text)]}) == len(got)


@pytest.mark.parametrize("kind", ["long", "binary"])
def test_one_task_finds_the_components_that_rounds_find(spark, kind):
    rng = np.random.default_rng(7)
    pairs = [*rng.integers(-200, 200, (150, 2)).tolist(), *[(300 + k, 301 + k) for k in rng.permutation(60).tolist()], (5, 5), (900, 900)]
    name = (lambda x: x) if kind == "long" else (lambda x: bytes([x % 7 * 40, 0, 255]) + (x + 500).to_bytes(2, "little") + bytes(x % 3))
    edges = spark.createDataFrame([(name(a), name(b)) for a, b in pairs], f"u {kind}, v {kind}").repartition(5)
    least = {name(x): name(x) for p in pairs if p[0] != p[1] for x in p}
    for _ in range(len(least)):
        for a, b in pairs:
            if a != b:
                least[name(a)] = least[name(b)] = min(least[name(a)], least[name(b)])
    read = lambda df: sorted((r.node if kind == "long" else bytes(r.node), r.component if kind == "long" else bytes(r.component)) for r in df.collect())
    for whole in (0, 10, 1 << 18):
        assert read(components(Scratch(spark, "test"), edges, whole=whole)) == sorted(least.items())
    assert not components(Scratch(spark, "test"), edges.limit(0), whole=9).count()


def test_the_pipeline_takes_no_rounds_for_few_near_copies(spark, monkeypatch):
    wrote, write = [], Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, name: wrote.append(name) or write(self, df, name))
    words = [f"w{k}" for k in range(400)]
    rows = [(n, " ".join(words[:n] + ["other"] + words[n:])) for n in range(6)] + [(10, "alone here in this table of texts")]
    kept = similar.keep_one(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 10]
    assert {"candidates-whole", "stars-whole"} <= set(wrote) and not [x for x in wrote if re.search(r"-[mls]?[1-9]", x)]


def test_the_fit_holds_few_bytes_of_a_feature_on_the_driver():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(3)
    ids = [np.unique(rng.integers(0, toxicity.DIMENSIONS, 5000)).astype(np.int32) for _ in range(400)]
    lists = [pa.array(x, pa.list_(pa.int32())) for x in (ids, [np.ones(len(x), dtype=np.int32) for x in ids])]
    got = pa.table({"toxic": [k % 2 == 0 for k in range(400)], "words": [5000] * 400, "features": lists[0], "counts": lists[1]})
    tracemalloc.start()
    toxicity.fit(got, 200, 200)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 * toxicity.DIMENSIONS + 16 * sum(map(len, ids))


def test_the_pipeline_keeps_one_of_all_copies_from_a_similarity_of_four_fifths(spark):
    import random

    import corpus_pipeline

    rng, texts = random.Random(6), [None, "", "one", "One", "two words"]
    for k in range(30):
        base = [f"w{k}x{rng.randint(0, 300)}" for _ in range(rng.randint(60, 200))]
        for changed in (0, 1, 2, 3, 4, 6, 9):
            copy = list(base)
            for at in rng.sample(range(len(base)), changed):
                copy[at] = f"new{rng.randint(0, 10**6)}"
            texts.append(" ".join([*copy, *["boilerplate of all documents that says nothing much"] * (k % 2)]))
    sets = []
    for t in texts:
        w = re.findall(SPACE, lower(t))
        sets.append({" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    alike = [[1.0 if a == b else len(a & b) / len(a | b) for b in sets] for a in sets]
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if alike[i][j] >= 0.8 and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    assert sum(0.8 <= x < 0.95 for row in alike for x in row) > 50
    rows = [(k, t, *documents()[0][2:]) for k, t in enumerate(texts)]
    kept = corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), "")
    assert kept.columns == frame(spark).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(min(k for k, r in enumerate(root) if r == g) for g in set(root))
    assert corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows).limit(0), "").count() == 0


def test_a_repeated_word_counts_at_scoring_as_in_the_fit():
    weights = np.zeros(toxicity.DIMENSIONS, dtype=np.float32)
    weights[toxicity.features(b"bad")[0]] = 0.25
    model = toxicity.Model(weights, np.array([5.0]), 0.5)
    assert model.linear(b"bad " * 3) == 0.75 and model.linear(b"bad " * 8) == model.linear(b"bad " * 1000) == 2.0
    assert model.linear(b"") == 0.0


def test_substring_dedup(spark):
    rows = documents()
    words = [re.findall(SPACE, r[1] or "") for r in rows]
    for window in (35, 5):
        count = Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
        want = Counter()
        for r, w in zip(rows, words, strict=True):
            out = [False] * len(w)
            for k in range(len(w) - window + 1):
                if count[tuple(w[k : k + window])] > 1:
                    out[k : k + window] = [True] * window
            kept = " ".join(x for x, o in zip(w, out, strict=True) if not o)
            want[(r[0], len(w), sum(out), hashlib.sha256(kept.encode()).hexdigest())] += 1
        got = substrings.repeated(spark, frame(spark), window).select("doc_id", "n_words", "n_removed", "kept_sha256")
        assert Counter(map(tuple, got.collect())) == want


ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "Two Words"), (3, None), (4, ""), (5, "one"), (None, "gamma delta epsilon"), (2, "Two Words"), (6, "漢字"), (7, "mu nu " * 12)]


@pytest.mark.parametrize("group_words", [500_000, 5])
def test_decontamination(spark, group_words):
    rows = [*documents(), (900, "say ALPHA beta, gamma-delta epsilon zeta eta theta iota kappa lambda! end", *documents()[0][2:]), (901, "nu mu nu mu nu mu nu mu nu mu nu mu nu", *documents()[0][2:])]
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = defaultdict(set)
    for item, text in ITEMS:
        w = find(text)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(item)
    want = Counter()
    for r in rows:
        w, hit, items = find(r[1]), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    items |= {str(i) for i in windows[tuple(w[k : k + n])] if i is not None}
        want[(r[0], len(w), len(hit), len(items), ",".join(sorted(items)))] += 1
    found = decontamination.find(spark, frame(spark, rows), spark.createDataFrame(ITEMS, "item_id long, text string"), group_words=group_words)
    got = Counter((r.doc_id, r.n_words, sum(s["end"] - s["first"] for s in r.spans), len(r["items"]), ",".join(r["items"])) for r in found.collect())
    assert got == want


def test_decontamination_cuts_spans_and_drops_what_is_mostly_spans(spark):
    rest = documents()[0][2:]
    rows = [(1, "before the rest of it, Two words; after all of this text", *rest), (2, "two words", *rest), (3, "clean text", *rest), (4, None, *rest)]
    out = decontamination.remove(spark, frame(spark, rows), spark.createDataFrame([(2, "Two Words")], "item_id long, text string"))
    assert out.columns == frame(spark).columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "before the rest of it, ; after all of this text", 3: "clean text", 4: None}


def test_sharding(spark):
    rows = documents()
    got = sharding.shard(spark, frame(spark)).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r.slot)
        assert r.grown_shard in (r["shard"], 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({(r.doc_id, r["shard"]) for r in got}) == len({r.doc_id for r in got})


def test_sharding_follows_weights_and_moves_rows_into_the_new_shard_only(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "doc_id")
    tree = {0: {0: {0: 1.0, 1: 3.0}}, 1: {1: {2: 4.0}}}
    n = {r["shard"]: r["count"] for r in sharding.place(rows, "doc_id", tree).groupBy("shard").count().collect()}
    assert all(abs(n[s] - 20_000 * w / 8) < 400 for s, w in ((0, 1), (1, 3), (2, 4)))
    moved = sharding.place(sharding.place(rows, "doc_id", tree), "doc_id", sharding.grown(tree, 3), "g_").filter("shard <> g_shard")
    assert {r.g_shard for r in moved.select("g_shard").distinct().collect()} == {3}


def test_packing(spark):
    rows = documents()
    got = packing.pack(spark, frame(spark), capacity=256).collect()
    want = Counter()
    for r in rows:
        ids, at = ids_of(r[1], 0), 0
        size = (len(ids) - 1) % 256 + 1
        for piece in range(-(-len(ids) // 256)):
            want[(r[0], piece, at, size, zlib.crc32(ids[at : at + size].tobytes()))] += 1
            at, size = at + size, 256
    assert Counter((r.doc_id, r.piece, r.start, r["length"], r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256


@pytest.mark.parametrize("lengths", [[1025] * 7 + [500] * 9 + [3], list(range(1, 400)), [2048] * 5, [1], [700 + k % 700 for k in range(5000)]])
def test_plans_pack_every_piece_once_and_nearly_fill_their_sequences(lengths):
    histogram = Counter(lengths)
    plan = packing.solve(histogram, 2048)
    packed = Counter()
    for config, times in plan:
        assert times > 0 and sum(size * n for size, n in config.items()) <= 2048
        for size, n in config.items():
            packed[size] += n * times
    assert packed == histogram
    free, used = [], 0  # best fit, longest first
    for length in sorted(lengths, reverse=True):
        fit = min((f for f in free if f >= length), default=None)
        if fit is None:
            used, fit = used + 1, 2048
        else:
            free.remove(fit)
        free.append(fit - length)
    assert sum(n for _, n in plan) <= used * 1.01 + 1


def test_token_store_round_trip(spark):
    rows = documents()
    folder = tokenstore.write_store(spark, frame(spark))
    ids = [(r[0], ids_of(r[1], 2)) for r in rows]
    got = sorted(tokenstore.read_store(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in ids), key=lambda i: -1 if i is None else i)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(x), zlib.crc32(x.tobytes())) for i, x in ids)
    whole = tokenstore.read_ids(spark, folder).collect()
    assert Counter((r.doc_id, bytes(r.ids)) for r in whole) == Counter((i, x.astype("<u2").tobytes()) for i, x in ids)
    stored = spark.read.parquet(f"{folder}/index").agg(F.sum("chunks")).first()[0]
    named = spark.read.parquet(f"{folder}/recipes").select(F.explode("addresses")).distinct().count()
    assert stored == named  # each chunk once


def test_a_damaged_pack_is_not_read_as_sound(spark):
    from pathlib import Path

    folder = tokenstore.write_store(spark, frame(spark))
    pack = next(Path(folder.removeprefix("file:")).glob("packs/*.pack")) if not folder.startswith("file://") else next(Path(folder.removeprefix("file://")).glob("packs/*.pack"))
    packs = sorted(pack.parent.glob("*.pack"))
    for p in packs:
        data = p.read_bytes()
        p.write_bytes(data[:-3] + bytes([data[-3] ^ 0x55]) + data[-2:])  # a byte that surely changes
    with pytest.raises(Exception):  # noqa: B017, PT011
        tokenstore.read_store(spark, folder).collect()


def test_encoder_equals_the_library():
    import random

    e, rng = Encoder(tokenizer_path(), cache_entries=60), random.Random(2)
    parts = ["a", "b", "é", " ", " ", "\n", "\t", "  ", "1", "22", "'s", "'", "!", "..", " ", "　", "漢", "😀", "<|endoftext|>", "\x85", "\x1c", "\x0b", "The", "Ω"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    for k in range(0, len(texts), 40):
        for t, got in zip(texts[k : k + 40], e.encode_many(texts[k : k + 40]), strict=True):
            assert np.frombuffer(got, dtype=e.dtype).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_toxicity_on_held_out_documents(spark):
    import random

    rng, plain = random.Random(4), [r[1] for r in documents() if r[1] and len(r[1]) < 2000]
    bad = ["grubbo", "snarvex", "plonkish"]
    rows, labels = [], []
    for k in range(400):
        words = rng.choice(plain).split() + [f"w{rng.randint(0, 500)}" for _ in range(20)]
        if k % 4 == 0:
            for _ in range(rng.randint(1, 6)):
                words.insert(rng.randint(0, len(words)), rng.choice(bad) + rng.choice(["", "s", "er", "ing,"]))
        rows.append((k, " ".join(words), *documents()[0][2:]))
        if k < 200:
            labels.append((k, 1, int(k % 4 == 0)))
    labels += [(0, 1, 0), (None, 1, 1), (999, 1, 1), (7, None, None)]
    rows += [(None, None, *documents()[0][2:]), (1000, "", *documents()[0][2:])]
    docs, of = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(spark, docs, of)
    got = {r.doc_id: r for r in toxicity.score(spark, docs, model).collect()}
    wrong = [k for k in range(200, 400) if got[k].toxic != (k % 4 == 0)]
    assert len(wrong) <= 4, wrong
    assert not got[None].toxic and not got[1000].toxic and got[1000].grade == 0
    assert list(model.thresholds) == sorted(model.thresholds)
    assert np.mean([got[k].expected_severity for k in range(0, 400, 4)]) > np.mean([got[k].expected_severity for k in range(1, 400, 4)]) + 0.5
    kept = toxicity.clean(spark, docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {k for k, r in got.items() if not r.toxic}
    none = toxicity.train(spark, docs, of.filter("toxic = 0"))
    assert {r.toxic for r in toxicity.score(spark, docs, none).collect()} == {False}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    items, labels = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")
    assert simhash.near_duplicates(spark, empty).count() == 0
    assert simhash.keep_one(spark, empty).count() == 0
    assert substrings.repeated(spark, empty).count() == 0
    assert decontamination.find(spark, empty, items).count() == 0
    assert sharding.shard(spark, empty).count() == 0
    assert packing.pack(spark, empty).count() == 0
    assert tokenstore.read_store(spark, tokenstore.write_store(spark, empty)).count() == 0
    assert toxicity.score(spark, empty, toxicity.train(spark, empty, labels)).count() == 0
    assert pii.sanitise(spark, empty).count() == 0


def test_pii_keeps_clashing_columns(spark):
    out = pii.sanitise(spark, frame(spark, [(1, "mail jo@ex.org now", *documents()[0][2:]), (2, "nothing", *documents()[0][2:])]))
    assert out.columns == frame(spark).columns
    assert {r.doc_id: (r.text, r.base) for r in out.collect()} == {1: ("mail [EMAIL] now", "b"), 2: ("nothing", "b")}
