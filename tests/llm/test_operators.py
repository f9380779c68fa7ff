"""The ten operators against brute force, on awkward rows, and on no rows."""

import itertools
import math
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vistaframe.llm import hnsw, langid, mixing, neardup, pitman_yor, quality, shard, topk, toxicity
from vistaframe.llm.common import crc_fold, sample_ids, words


def test_sharding_sizes_slots_and_margins(spark, docs):
    rows = shard.assign(docs, 3).collect()
    assert len(rows) == 11
    per = Counter(r.shard for r in rows)
    assert max(per.values()) - min(per.values()) <= 1
    for s in per:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(per[s]))
    by_id = {r.doc_id: r for r in rows}
    assert by_id[3].size == 1 and by_id[3].text_crc32 == 0
    assert by_id[6].text_crc32 == zlib.crc32(b"Short text") and by_id[6].size == 11
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, shard.assign(docs, 3).collect()), key=str)
    assert shard.assign(docs.limit(0), 3).count() == 0
    m = shard.communication_matrix([5, 0, 7, 100], [38, 37, 37], 1)
    assert [sum(r) for r in m] == [5, 0, 7, 100] and [sum(c) for c in zip(*m, strict=True)] == [38, 37, 37]


def test_shards_hold_whole_rows(spark, docs, tmp_path):
    path = f"file://{tmp_path}/shards"
    shard.write_shards(docs, path, 3)
    back = spark.read.parquet(path)
    assert sorted(r["count"] for r in back.groupBy("shard").count().collect()) == [3, 4, 4]
    same = back.select(*docs.columns)
    assert same.exceptAll(docs).count() == 0 == docs.exceptAll(same).count()


def test_hypergeometric_moments():
    import random

    rng = random.Random(5)
    draws = [shard.hypergeometric(rng, 30, 70, 20) for _ in range(4000)]
    assert abs(np.mean(draws) - 6) < 0.15 and abs(np.var(draws) - 20 * 0.3 * 0.7 * 80 / 99) < 0.3


def test_mixing_targets_and_bounds(spark, docs):
    rows = mixing.plan(docs).collect()
    assert len(rows) == 11 and all(0 <= r.taken <= 2 * r["size"] for r in rows)
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1
        assert own[0].target <= 2 * own[0].source_size + 1e-9
    assert abs(sum({r.source: r.target for r in rows}.values()) - 1.5 * sum(r["size"] for r in rows)) < 1e-6
    assert mixing.plan(docs.limit(0)).count() == 0


def test_mixed_rows_meet_targets_with_repeated_and_null_ids(spark):
    """Every source's words come within half a document of its target, however often an id,
    a text or a whole row is repeated."""
    rng = np.random.default_rng(21)
    rows = []
    for i in range(900):
        text = " ".join(["w"] * int(rng.integers(1, 30))) + f" t{i % 50}"
        rows.append((None if i % 3 == 0 else int(i % 7 if i % 3 == 1 else i), text, None, "abc"[i % 3] if i % 10 else None, i))
    rows += [(5, "one and the same row of seven words", "en", "c", 1)] * 400
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    targets = {r.source: r.target for r in mixing.plan(frame).select("source", "target").distinct().collect()}
    got, longest = Counter(), 31
    for r in mixing.mixed(frame).collect():
        got[r.source] += len(r.text.split())
    assert set(got) == set(targets) == {"a", "b", "c", None}
    for source, target in targets.items():
        assert abs(got[source] - target) <= longest / 2 + 1
    taken = Counter()
    for r in mixing.plan(frame).collect():
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - t) <= 1 for s, t in targets.items())
    assert mixing.mixed(frame.limit(0)).count() == 0


def test_sharding_spreads_equal_rows(spark):
    """Equal rows are dealt as independently as others: a chi-square over shards and slots."""
    rows = [(7, "the same text", "en", "a", 1)] * 4000 + [(i, f"text {i}", "en", "a", 1) for i in range(4000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mine = [r for r in shard.assign(frame, 8).collect() if r.doc_id == 7]
    per = Counter((r.shard, r.slot // 250) for r in mine)
    assert len(per) == 32 and sum((n - 125) ** 2 / 125 for n in per.values()) < 70


def test_shards_with_clashing_names(spark, docs, tmp_path):
    path = f"file://{tmp_path}/shards"
    named = docs.withColumn("shard", F.lit("x")).withColumn("slot", F.lit("y")).withColumn("at", F.lit(1))
    shard.write_shards(named, path, 3)
    back = spark.read.parquet(path)
    assert "shard_" in back.columns and back.filter("shard = 'x' AND slot = 'y'").count() == 11


def test_results_replace_columns_of_their_names(spark, docs, labels):
    named = docs.withColumn("Score", F.lit("x")).withColumn("lang_pred", F.lit("x")).withColumn("spans", F.lit("x"))
    out = quality.scored(named, quality.fit(docs, labels))
    assert out.columns == [*docs.columns, "lang_pred", "spans", "score"] and dict(out.dtypes)["score"] == "double" and out.count() == 11
    out = langid.identified(named, langid.fit(docs))
    assert out.columns == [*docs.columns, "spans", "lang_pred", "score"] and out.count() == 11
    out = toxicity.tagged(named, toxicity.fit(docs, labels))
    assert out.columns == [*docs.columns, "lang_pred", "score", "spans"] and out.count() == 11


def test_numerals_are_no_letters(spark, docs):
    frame = spark.createDataFrame([(1, "½ ① ²"), (2, "Ⅷ 12"), (3, "ª")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in langid.identified(frame, langid.fit(docs)).collect()}
    assert got[1] == got[2] == "und" and got[3] != "und"


def test_batches_are_cut_by_bytes():
    from vistaframe.llm.common import pieces_of

    batch = pa.RecordBatch.from_pydict({"text": ["x" * 1000] * 100 + ["y" * 100_000] + ["z"] * 300})
    cut = list(pieces_of(batch, 256, 20_000))
    assert pa.Table.from_batches(cut).equals(pa.Table.from_batches([batch]))
    assert all(c.num_rows <= 256 and (c.num_rows == 1 or c.nbytes <= 20_000) for c in cut)


def test_mixed_rows_keep_columns(spark, clashing):
    out = mixing.mixed(clashing)
    assert out.columns == clashing.columns
    assert out.filter("text IS NULL OR trim(text) = ''").count() == 0


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_against_brute_force(spark, docs, width):
    import random

    rng = random.Random(width)
    base = [f"v{i}" for i in range(80)]
    extra = []
    for i in range(60):
        ws = list(base)
        for _ in range(rng.randrange(0, 4)):
            ws[rng.randrange(80)] = f"q{rng.randrange(1000)}"
        extra.append((100 + i, " ".join(ws), "en", "z", 1))
    every = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.detect(every, width).collect()), key=str)

    rows = every.collect()
    sets = []
    for r in rows:
        w = words(r.text)
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            parent[root(i)] = root(j)
    want = []
    for i, r in enumerate(rows):
        ids = [rows[j].doc_id for j in range(len(rows)) if root(j) == root(i) and rows[j].doc_id is not None]
        component = min(ids) if ids else None
        want.append((r.doc_id, len(sets[i]), component, r.doc_id == component))
    assert got == sorted(want, key=str)
    assert neardup.detect(every.limit(0), width).count() == 0


def test_signature_threshold_loses_almost_no_pair():
    p = sum(math.comb(neardup.POSITIONS, k) * 0.2**k * 0.8 ** (neardup.POSITIONS - k) for k in range(neardup.THRESHOLD + 1, neardup.POSITIONS + 1))
    assert p < 2e-5
    rng = np.random.default_rng(0)
    one = rng.integers(0, 2**16, neardup.POSITIONS).astype(np.uint16)
    for _ in range(200):  # every pair within the threshold shares a key
        two = one.copy()
        at = rng.choice(neardup.POSITIONS, neardup.THRESHOLD, replace=False)
        two[at] += 1
        keys = neardup.index_keys(np.stack([one, two]))
        shared = sorted(set(keys[0].tolist()) & set(keys[1].tolist()), key=keys[0].tolist().index)
        assert shared and (shared[0] >> 48) & 0xFFFF == neardup.first_shared((one == two)[None])[0]


def test_bit_maps_bound_from_above():
    rng = np.random.default_rng(1)
    for n in (50, 300, 512):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.r_[a[: int(0.9 * n)], rng.integers(0, 2**63, n // 10).astype(np.uint64)])
        maps = [neardup.bit_map(x) for x in (a, b)]
        body = np.stack([np.frombuffer(m[2], np.uint64) for m in maps])
        size, level, taken = np.array([len(a), len(b)]), np.array([m[0] for m in maps]), np.array([m[1] for m in maps])
        spare = taken - np.bitwise_count(body).sum(axis=1)
        assert 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
        assert neardup._may_reach(size, level, taken, spare, body, 0, np.array([1]))[0].all()


def test_joined_parts_take_their_roots_along(spark):
    parts = spark.createDataFrame([(2, 1), (1, 1), (6, 5), (5, 5)], "node long, part long")
    links = spark.createDataFrame([(2, 6), (7, 8)], "a long, b long")
    got = {r.node: r.part for r in neardup.joined(parts, links).collect()}
    assert got == {1: 1, 2: 1, 5: 1, 6: 1, 7: 7, 8: 7}


def test_deduplicated_keeps_one_and_columns(spark, clashing):
    out = neardup.deduplicated(clashing)
    ids = [r.doc_id for r in out.collect()]
    assert out.columns == clashing.columns
    assert sorted(i for i in ids if i in (1, 2, 8)) == [1] and ids.count(5) == 1 and ids.count(3) == 1 and ids.count(4) == 1


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(600)]
    rows += [(700, None), (701, [1.0, None] + [0.0] * 6), (702, [float("nan")] * 8), (703, [0.0] * 8), (704, []), (705, rows[0][1]), (706, rows[0][1]), (None, rows[1][1]), (707, [float("inf")] * 8)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_top_k_is_exact(spark, vectors):
    frame = topk.integers(vectors)
    got = sorted(map(tuple, topk.search(frame, 5).collect()))
    data = {r.vec_id: np.array(r.vector) for r in frame.collect()}
    want = []
    for q in [i for i in data if i % 50 == 0]:
        best = sorted((-int(data[q] @ data[c]), c) for c in data if c != q)[:5]
        want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    assert got == sorted(want)
    assert topk.search(frame.limit(0), 5).count() == 0


def test_top_k_prunes_clustered_blocks():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16)) * 400
    body = np.floor(np.concatenate([c + rng.normal(size=(100, 16)) * 20 for c in centres]))
    index = topk.BlockIndex(np.arange(len(body)), body)
    bounds = index.bounds(body[:50])
    for q in range(50):
        ids, scores = index.search(q, body[q], bounds[q], 5)
        order = sorted((-(body[q] @ body[c]), c) for c in range(len(body)) if c != q)[:5]
        assert [(-s, i) for s, i in zip(scores.tolist(), ids.tolist(), strict=True)] == order
    assert index.scored < 50 * len(index.high) * 0.7


def test_top_k_huge_components_stay_exact():
    body = np.array([[2.0**40, 1.0], [2.0**40, 2.0], [-(2.0**40), 5.0]])
    index = topk.BlockIndex(np.array([1, 2, 3]), body)
    ids, scores = index.search(9, body[0], index.bounds(body[:1])[0], 2)
    assert ids.tolist() == [2, 1] and int(scores[0]) == 2**80 + 2


def test_hnsw_recall_and_scores(spark, vectors):
    frame = hnsw.usable_vectors(vectors)
    rows = hnsw.search(frame, 20).collect()
    data = {r.vec_id: np.array(r.vector) for r in frame.collect()}
    assert 703 not in data and 700 not in data and None not in data
    hits = total = 0
    for q in [i for i in data if i % 20 == 0]:
        mine = [r for r in rows if r.query_id == q]
        assert [r.rank for r in sorted(mine, key=lambda r: r.rank)] == list(range(1, 21))
        for r in mine:
            assert r.vec_id != q and abs(r.score - data[q] @ data[r.vec_id]) < 1e-12
        best = {c for _, c in sorted((-(data[q] @ data[c]), c) for c in data if c != q)[:20]}
        hits += len(best & {r.vec_id for r in mine})
        total += 20
    assert hits / total >= 0.9
    assert hnsw.search(frame.limit(0), 20).count() == 0


def test_hnsw_graph_recall_with_copies():
    rng = np.random.default_rng(4)
    body = np.concatenate([rng.normal(size=(3000, 24)), np.tile(rng.normal(size=(1, 24)), (500, 1))])
    ids = rng.permutation(len(body)).astype(np.int64)
    graph = hnsw.Graph(ids, body)
    assert len(graph.unit) == 3001
    queries = np.arange(0, 3500, 35)
    found = hnsw._answer(20, hnsw.SEARCH_BEAM)(graph, ids[queries], body[queries]).to_pandas()
    hits = 0
    for q in queries:
        s = body @ body[q]
        s[q] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:20]])
        hits += len(best & set(found[found.query_id == ids[q]].vec_id))
    assert hits / (20 * len(queries)) >= 0.9


@pytest.mark.parametrize("part_tokens", [pitman_yor.PART_TOKENS, 3000])
def test_language_model_counts_and_base(spark, docs, part_tokens):
    named = docs.withColumn("held_out", F.lit("x")).withColumn("score", F.lit("x")).withColumn("part", F.lit("x"))
    out = pitman_yor.scored(named, crc_fold("doc_id", 10) == 0, part_tokens).collect()
    rows = docs.collect()
    assert len(out) == len(rows)
    tokens = {(r.doc_id, r.text): words(r.text) + [b" end"] for r in rows}
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for r in rows if not held(r.doc_id) for w in tokens[r.doc_id, r.text])
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)) for (i, _), w in ((( r.doc_id, 0), tokens[r.doc_id, r.text]) for r in rows))
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    assert all(r.score <= 0 and math.isfinite(r.score) for r in out)
    assert pitman_yor.scored(docs.limit(0), crc_fold("doc_id", 10) == 0).count() == 0


@pytest.fixture()
def no_task(monkeypatch):
    task = SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0))
    monkeypatch.setattr(pitman_yor, "TaskContext", task)


def _language_corpus():
    rng = np.random.default_rng(12)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, 120) % 300) for _ in range(120)]
    return texts, [i % 6 == 0 for i in range(120)]


def _language_model(parts, room):
    """The model of a small corpus in this process: parts, roots after each sweep, kept states."""
    texts, held = _language_corpus()
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts, "held_out": held})
    size = sum(len(t.split()) + 1 for t in texts)
    keys, common = {}, []
    for r in (r for b in pitman_yor._counting(room / size)(iter([batch])) for r in b.to_pylist()):
        if r["kind"] == 0 and len(common) < 50:
            common.append(r["key"])
        if r["kind"] >= 0 and r["n"] > room / 2:
            keys.setdefault(r["kind"], []).append((r["key"], r["n"]))
    busy, common = pitman_yor.Busy(keys, room), np.sort(np.array(common, np.int64).astype(np.uint64))
    rows = [r for b in pitman_yor._chunks(parts, busy, common)(iter([batch])) for r in b.to_pylist() if r["part"] >= 0]
    every = [(r["part"], pitman_yor.Part.load(pitman_yor.Part.of([pitman_yor._unpack(r["body"])], [0], 3, common).save())) for r in rows]
    roots, got, held_state = [], [[] for _ in every], [None] * 3
    for sweep in range(pitman_yor.BURN_IN + pitman_yor.SAMPLES):
        sums, boxes = np.zeros(4), [[] for _ in range(3)]
        for i, (n, one) in enumerate(every):
            seen, counts = pitman_yor.told(got[i], roots)
            state = list(one.states(n, seen))[-1]
            got[i].append([])
            for b, message in one.messages(state, counts):
                boxes[b].append((i, message))
        for b, box in enumerate(boxes):
            held_state[b], back, more = pitman_yor.seated_root(b, sweep, [m for _, m in box], held_state[b], roots[-1] if roots else None)
            for (i, _), g in zip(box, back, strict=True):
                got[i][sweep].append(g)
            sums += more
        roots.append(pitman_yor.Root(sums[0], sums[1], roots[0].vocabulary if roots else int(sums[2])))
    return busy, every, roots, [pitman_yor.told(g, roots)[0] for g in got], held_state


@pytest.mark.parametrize(("parts", "room"), [(1, 1e9), (8, 1e9), (8, 150.0)])
def test_language_model_probabilities(no_task, parts, room):
    """Every restaurant's probabilities sum to one and equal the recursion written out, with
    one partition, several, and restaurants opened as rooms."""
    busy, every, roots, answers, buckets = _language_model(parts, room)
    assert len(every) == parts and (len(busy.keys[0]) > 0) == (len(busy.keys[1]) > 0) == (room < 1e9)
    texts, held = _language_corpus()
    train = Counter(w for t, h in zip(texts, held, strict=True) if not h for w in [*t.split(), None])
    assert roots[0].vocabulary == len(train) and sum(one.c.sum() for _, one in every) == sum(train.values())
    base, end = roots[-1].base, roots[-1]
    (dl, dm, dr), (sl, sm, sr) = pitman_yor.DISCOUNT, pitman_yor.STRENGTH
    root, spare = {}, (sr + dr * end.tables) / (sr + end.customers)
    for codes, customers, tables, _ in buckets:
        for w, c, t in zip(codes.tolist(), customers.tolist(), tables.tolist(), strict=True):
            root[w] = ((c - dr * t) if c else 0) / (sr + end.customers) + spare * base
    code = lambda w: pitman_yor.END if w is None else pitman_yor.xxhash.xxh3_64_intdigest(w.encode())
    for w, c in train.items():
        if c == 1:  # settled: one customer at one table
            root[code(w)] = (1 - dr) / (sr + end.customers) + spare * base
    assert len(root) == len(train)
    known = sum(root.values())
    for t in texts:
        for w in t.split():
            root.setdefault(code(w), spare * base)
    assert abs(known + spare * base - 1) < 1e-9
    for (n, one), roots_seen in zip(every, answers, strict=True):
        state = list(one.states(n, roots_seen[:-1]))[-1]
        assert np.allclose(roots_seen[-1], [root[w] for w in one.words.tolist()])
        got, mid = one.probabilities(state, roots_seen[-1]), one.in_middle(state, roots_seen[-1])
        t, tm = state
        assert ((t > 0) == (one.c > 0)).all() and (t <= np.maximum(one.c, 0)).all()
        # a middle restaurant's customers are the tables of its leaves
        leaf_groups, mid_groups = {}, {}
        for i in range(len(one.w)):
            leaf_groups.setdefault(int(one.leaf[i]), {})[int(one.w[i])] = (one.c[i], t[i])
            c, _ = mid_groups.setdefault(int(one.leaf_mid[one.leaf[i]]), {}).get(int(one.w[i]), (0, 0))
            mid_groups[int(one.leaf_mid[one.leaf[i]])][int(one.w[i])] = (c + t[i], tm[one.pair_of[i]])

        def predict(groups, d, s, w, parent):
            c, k = groups.get(w, (0, 0))
            return ((c - d * k) + (s + d * sum(x for _, x in groups.values())) * parent) / (s + sum(x for x, _ in groups.values()))

        plain = lambda w: root[int(one.words[w])]
        for i in range(0, len(one.w), 37):
            m = mid_groups[int(one.leaf_mid[one.leaf[i]])]
            pm = predict(m, dm, sm, int(one.w[i]), plain(int(one.w[i])))
            assert abs(pm - mid[one.pair_of[i]]) < 1e-12
            leaf = leaf_groups[int(one.leaf[i])]
            assert abs(predict(leaf, dl, sl, int(one.w[i]), pm) - got[i]) < 1e-12
            spread = (sl + dl * sum(x for _, x in leaf.values())) / (sl + sum(x for x, _ in leaf.values()))
            there = sum(predict(leaf, dl, sl, w, predict(m, dm, sm, w, plain(w))) for w in leaf)
            rest = 1 - sum(predict(m, dm, sm, w, plain(w)) for w in leaf)
            assert abs(there + spread * rest - 1) < 1e-9


def test_partitions_change_no_sums(no_task):
    """The root's sums are those of one partition, up to the draws."""
    one, many = _language_model(1, 1e9)[2], _language_model(8, 1e9)[2]
    assert one[0].customers == many[0].customers and one[0].tables == many[0].tables
    for a, b in zip(one, many, strict=True):
        assert abs(a.customers / b.customers - 1) < 0.03 and abs(a.tables / b.tables - 1) < 0.05


def test_tables_are_drawn_from_their_conditional_distribution():
    """Against all seatings of five customers, enumerated; and large groups against a long chain."""
    d, s, others, parent = pitman_yor.DISCOUNT[0], pitman_yor.STRENGTH[0], 3.0, 0.05
    mass = Counter()

    def sit(sizes, left, weight):
        if not left:
            mass[len(sizes)] += weight
            return
        for k in range(len(sizes)):
            sit([n + (j == k) for j, n in enumerate(sizes)], left - 1, weight * (sizes[k] - d))
        sit([*sizes, 1], left - 1, weight * (s + d * (others + len(sizes))) * parent)

    sit([1], 4, (s + d * others) * parent)
    want = np.array([mass[t] for t in range(1, 6)]) / sum(mass.values())
    n = 40_000
    got = pitman_yor.draw(np.random.default_rng(1), np.full(n, 5.0), np.full(n, others), np.full(n, parent), 0)
    share = np.bincount(got.astype(int), minlength=6)[1:] / n
    assert np.abs(share - want).max() < 0.01
    c = 2 * pitman_yor.STIRLING
    table = pitman_yor.stirling(d, c)[c, 1:]
    for others, parent in ((3.0, 0.05), (300.0, 0.01), (3000.0, 0.02), (30_000.0, 0.02)):
        exact = table + np.cumsum(np.log((s + d * (others + np.arange(c))) * parent))
        exact = np.exp(exact - exact.max()) / np.exp(exact - exact.max()).sum()
        t = np.arange(1, c + 1)
        mean = exact @ t
        spread = math.sqrt(exact @ t**2 - mean**2)
        drawn = pitman_yor.draw(np.random.default_rng(2), np.full(n, float(c)), np.full(n, others), np.full(n, parent), 0)
        assert abs(drawn.mean() - mean) < 0.02 * mean + 0.03 and abs(drawn.std() / spread - 1) < 0.06
    assert np.allclose(pitman_yor.lgamma(np.array([0.3, 1.0, 7.5, 1e6])), [math.lgamma(x) for x in (0.3, 1.0, 7.5, 1e6)])


def test_language_model_learns_contexts(spark):
    """Held-out perplexity is far below the base's, and texts that occur twice score apart."""
    d = "/root/testdata/sf0.001"
    rows = pitman_yor.query(spark, d).collect()
    held = [r for r in rows if r.held_out]
    tokens = sum(r.n_tokens for r in held)
    assert sum(r.score for r in held) / tokens > sum(r.base_score for r in held) / tokens + 0.3


def test_language_model_does_not_depend_on_partitions(spark, monkeypatch):
    """Busy restaurants are shared: their tokens may lie in many partitions without another result."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    copies = docs.filter("doc_id < 3").crossJoin(spark.range(40)).select((F.col("doc_id") + 1000 * (F.col("id") + 1)).alias("doc_id"), "text")
    docs = docs.unionByName(copies).localCheckpoint()
    seen, plan = [], pitman_yor.busy_contexts
    monkeypatch.setattr(pitman_yor, "busy_contexts", lambda *a: seen.append(plan(*a)) or seen[-1])
    one, many = ({r.doc_id: (r.score, r.base_score) for r in pitman_yor.scored(docs, crc_fold("doc_id", 10) == 0, n).collect()} for n in (pitman_yor.PART_TOKENS, 2000))
    assert [[len(k) > 0 for k in busy.keys] for busy, _, _ in seen] == [[False, False], [True, True]]
    assert one.keys() == many.keys()
    for i, (score, base) in one.items():
        assert abs(score - many[i][0]) < 1e-6 and abs(base - many[i][1]) < 1e-6


def test_language_model_splits_as_common_words():
    """Also slices of a batch, as long batches are cut; and nulls, other spaces and odd characters."""
    texts = [" one  Two\x0bthree\x0c", None, "", "  \t\r\n", "É\x85a\x1cB c", "x\u2003y İZ", *[f"A{chr(i)}b" for i in range(1, 0x300)], "last One "] * 3
    for kind in (pa.string(), pa.large_string()):
        whole = pa.array(texts).cast(kind)
        for start, n in ((0, len(texts)), (3, 900), (901, 700), (len(texts) - 1, 1)):
            for sliced in (whole.slice(start, n), pa.array(texts).slice(start, n).cast(kind)):
                flat, counts = pitman_yor.split(sliced)
                want = [words(t) for t in texts[start : start + n]]
                assert counts.tolist() == [len(w) + 1 for w in want]
                assert flat.cast(pa.large_binary()).to_pylist() == [x for w in want for x in w]
                numbers, codes = pitman_yor.tokens([flat], counts)
                assert codes[numbers].tolist() == [c for w in want for c in [*map(pitman_yor.xxhash.xxh3_64_intdigest, w), pitman_yor.END]]


def test_language_model_of_words_that_occur_once(spark):
    """Buckets of words that get no message in later sweeps, or none at all."""
    for text, n in (("a b c", 4), (None, 1)):
        rows = pitman_yor.scored(spark.createDataFrame([(1, text)], "doc_id long, text string"), F.lit(False)).collect()
        assert [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in rows] == [(1, n, n, n)]
        assert rows[0].score < 0 and math.isfinite(rows[0].score)


def test_quality_learns_and_defines_cases(spark, docs, labels):
    good = [(i, f"the quick {i} fox jumps over the lazy dog number {i}", 1) for i in range(100, 220)]
    bad = [(i, f"BUY!! {i} NOW!! CHEAP!! $$$ DEAL!!", 0) for i in range(300, 420)]
    frame = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    model = quality.fit(frame, frame.select("doc_id", "quality"))
    rows = quality.scored(frame, model).collect()
    assert np.mean([(r.score >= 0.5) == r.quality for r in rows]) > 0.97
    awkward = quality.scored(docs, model).collect()
    assert len(awkward) == 11 and all(0 <= r.score <= 1 for r in awkward)
    assert quality.scored(docs.limit(0), model).count() == 0
    nothing = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.scored(docs, nothing).collect()} == {0.5}
    assert quality.accepted(docs.withColumn("score", F.lit("x")), model).columns[-1] == "score"


def test_quality_reads_texts_without_spaces():
    """Documents that differ only beyond the first 64 bytes of one long word."""
    rng = np.random.default_rng(14)
    sets = (list("风雨山河"), list("花鸟鱼虫"))
    texts = ["同" * 24 + "".join(rng.choice(sets[i % 2], 200)) for i in range(200)]
    assert b"".join(quality.pieces(texts[0])) == texts[0].encode() and quality.pieces("a bc") == [b"a", b"bc"]
    found = list(quality.Features().of_batch(texts))
    weights = quality.train([(*f, i % 2) for i, f in enumerate(found[:150])])
    assert np.mean([(quality.score(weights, *f) >= 0.5) == i % 2 for i, f in enumerate(found[150:])]) > 0.95
    assert quality.shape(b"a-1" * 20) != quality.shape(b"a-1" * 19)


def test_language_learns_and_defines_cases(spark, docs):
    rng = np.random.default_rng(8)
    parts = {"aa": ["tion", "ing", "the"], "bb": ["eau", "oux", "ette"]}
    rows = [(i, " ".join("".join(rng.choice(parts[k], 3)) for _ in range(40)), k) for i, k in enumerate(["aa", "bb"] * 90)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(frame)
    got = langid.identified(frame, model).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    awkward = {r.doc_id: r for r in langid.identified(docs, model).collect()}
    assert awkward[3].lang_pred == awkward[4].lang_pred == awkward[9].lang_pred == "und" and awkward[3].score == 0
    assert langid.identified(docs.limit(0), model).count() == 0
    assert langid.Network.load(langid.fit(docs.limit(0))).languages == []
    assert {r.lang_pred for r in langid.identified(docs, langid.fit(docs.limit(0))).collect()} == {"und"}


def test_sample_has_every_class(spark):
    """More classes than 256, and the rows of each class as many as its quota."""
    rows = [(i, f"l{i % 400:03d}") for i in range(1200)] + [(9999, None)]
    got = sample_ids(spark.createDataFrame(rows, "doc_id long, lang string"), "doc_id", 800, ["lang"]).collect()
    assert Counter(r.lang for r in got) == {f"l{i:03d}": 2 for i in range(400)}


def test_network_tables_equal_the_network():
    net = langid.Network(["a", "b", "c"])
    x = langid.windows("Ein kleines Haus steht am Waldrand. " * 20)
    e = net.p["embed"][x]
    pooled = []
    for k in langid.WIDTHS:
        r = sum(e[:, j : j + langid.WINDOW] @ net.p[f"w{k}"][j] for j in range(k)) + net.p[f"b{k}"]
        pooled.append(r.max(axis=1))
    want = np.maximum(np.concatenate(pooled, axis=1), 0) @ net.p["out"] + net.p["bias"]
    assert np.allclose(langid.Scorer(net).logits(x), want, atol=1e-4)


def test_toxicity_learns_spans_and_defines_cases(spark, docs, labels):
    rng = np.random.default_rng(9)
    plain = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(400):
        ws = list(rng.choice(plain, 60))
        if i % 2:
            for _ in range(3):
                ws[rng.integers(60)] = str(rng.choice(["grumblefoo", "snarkbar", "vexqua" + str(rng.integers(50))]))
        rows.append((i, " ".join(ws), i % 2))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(frame, frame.select("doc_id", "toxic"))
    got = toxicity.tagged(frame, model).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([(r.score >= 0.5) == r.toxic for r in held]) > 0.95
    hit = next(r for r in got if r.toxic and r.spans)
    assert any(k in hit.text[hit.spans[0].start : hit.spans[0].stop] for k in ("grumble", "snark", "vexqua"))
    awkward = toxicity.tagged(docs, model, spans=False).collect()
    assert len(awkward) == 11 and all(0 <= r.score <= 1 for r in awkward)
    assert toxicity.tagged(docs.limit(0), model).count() == 0
    assert toxicity.fit(docs, labels.limit(0))


def test_toxicity_query_gives_spans(spark):
    d = "/root/testdata/sf0.001"
    rows = toxicity.query(spark, d).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    assert len(rows) >= 200 and any(r.spans for r in rows)
    for r in rows:
        for s in r.spans:
            passage = texts[r.doc_id][s.start : s.stop]
            assert passage and passage == passage.strip() and 0.5 <= s.marginal <= 1


def test_toxicity_trains_on_whole_documents():
    """Every token of a document stands in one chain, and every cue of a toxic one is tagged."""
    rng = np.random.default_rng(13)
    docs = [(rng.integers(1, 500, (toxicity.KINDS, n)).astype(np.int32), y) for n, y in ((1000, 1), (64, 1), (0, 1), (777, 0))]
    cues = np.array([5, 9])
    rows, tags = toxicity.training_chains(docs, cues)
    assert sorted(rows[0][rows[0] >= 0].tolist()) == sorted(np.concatenate([c[0] for c, _ in docs]).tolist())
    want = sum(int(np.isin(c[0], cues).sum()) for c, y in docs if y)
    assert tags.sum() == want and set(rows[0][tags == 1].tolist()) <= {5, 9}


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(10)
    u, a = rng.normal(size=(3, 5)), np.exp(rng.normal(size=(2, 2)))
    f, b, _ = toxicity.marginal_odds(u, a)
    for i in range(3):
        mass = np.zeros((5, 2))
        for y in itertools.product((0, 1), repeat=5):
            w = math.exp(sum(u[i, t] * y[t] for t in range(5))) * math.prod(a[y[t], y[t + 1]] for t in range(4))
            for t in range(5):
                mass[t, y[t]] += w
        p = (f * b)[i] / (1 + (f * b)[i])
        assert np.allclose(p, mass[:, 1] / mass.sum(axis=1))


def test_stretches_link_to_whole_texts():
    """The odds of texts cut into stretches are those of the uncut chains."""
    rng = np.random.default_rng(15)
    a = np.exp(np.array([[0.5, -2.0], [-1.0, 1.5]]))
    stretches = np.array([1, 4, 2, 7])
    u = rng.normal(-2, 3, (int(stretches.sum()), 8))
    f, b = toxicity.linked_odds(u, a, stretches)
    at = 0
    for n in stretches:
        one, two, _ = toxicity.marginal_odds(u[at : at + n].reshape(1, -1), a)
        assert np.allclose(f[at : at + n].ravel(), one[0]) and np.allclose(b[at : at + n].ravel(), two[0])
        at += n


def test_field_gradient_descends():
    """One training step moves the weights against the numeric gradient of the log likelihood."""
    rng = np.random.default_rng(16)
    u, y, t = rng.normal(size=(4, 6)), rng.integers(0, 2, (4, 6)), rng.normal(size=(2, 2))

    def loss(u, t):
        a, out = np.exp(t), 0.0
        for row, tags in zip(u, y, strict=True):
            mass = [math.exp(sum(row[i] * z[i] for i in range(6))) * math.prod(a[z[i], z[i + 1]] for i in range(5)) for z in itertools.product((0, 1), repeat=6)]
            own = sum(row[i] * tags[i] for i in range(6)) + sum(t[tags[i], tags[i + 1]] for i in range(5))
            out += math.log(sum(mass)) - own
        return out

    f, b, e = toxicity.marginal_odds(u, np.exp(t))
    p = f * b / (1 + f * b)
    for i, j in ((0, 0), (2, 3), (3, 5)):
        step = np.zeros_like(u)
        step[i, j] = 1e-5
        assert abs((loss(u + step, t) - loss(u - step, t)) / 2e-5 - (p - y)[i, j]) < 1e-6


def test_network_gradients_are_those_of_the_loss():
    net = langid.Network(["a", "b", "c"], seed=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(17)
    x = rng.integers(97, 123, (6, langid.WINDOW + max(langid.WIDTHS) - 1)).astype(np.uint8)
    y = np.array([0, 1, 2, 0, 1, 2])

    def loss():
        e, pooled = net.p["embed"][x], []
        for k in langid.WIDTHS:
            pooled.append((sum(e[:, j : j + langid.WINDOW] @ net.p[f"w{k}"][j] for j in range(k)) + net.p[f"b{k}"]).max(axis=1))
        z = np.maximum(np.concatenate(pooled, axis=1), 0) @ net.p["out"] + net.p["bias"]
        return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(6), y]))

    got = net.gradients(x, y)
    for name, where in (("out", (3, 1)), ("bias", (2,)), ("w2", (0, 4, 5)), ("w4", (3, 2, 7)), ("b3", (6,)), ("embed", (int(x[0, 0]), 2))):
        held, h = net.p[name][where], 1e-6
        net.p[name][where] = held + h
        up = loss()
        net.p[name][where] = held - h
        down = loss()
        net.p[name][where] = held
        assert abs((up - down) / (2 * h) - got[name][where]) < 1e-4


def test_ftrl_equals_the_updates_written_out():
    rng = np.random.default_rng(18)
    examples = [(np.unique(rng.integers(0, 16, 4)), None, int(rng.integers(2))) for _ in range(30)]
    examples = [(i, rng.random(len(i)), y) for i, _, y in examples]
    got = quality.train(examples, bits=4, epochs=2, alpha=0.3, beta=1.0, l1=0.05, l2=0.2, seed=1)
    z, n = [0.0] * 17, [0.0] * 17

    def weight(i):
        if abs(z[i]) <= 0.05:
            return 0.0
        return -(z[i] - math.copysign(0.05, z[i])) / ((1.0 + math.sqrt(n[i])) / 0.3 + 0.2)

    order = np.random.default_rng(1)
    for _ in range(2):
        for k in order.permutation(30):
            index, value, y = examples[k]
            parts = [(int(i), float(v)) for i, v in zip(index, value, strict=True)] + [(16, 1.0)]
            p = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in parts)))
            for i, v in parts:
                g = (p - y) * v
                w = weight(i)
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.3 * w
                n[i] += g * g
    assert np.allclose(got, [weight(i) for i in range(17)])


def test_vectors_with_further_columns(spark, vectors):
    """Columns named as the searches' own change nothing."""
    named = vectors.withColumn("shard", F.lit("x")).withColumn("vector", F.lit("x")).withColumn("is_query", F.lit("x")).withColumn("score", F.lit(1))
    assert sorted(topk.search(topk.integers(named)).collect()) == sorted(topk.search(topk.integers(vectors)).collect())
    assert hnsw.usable_vectors(named).columns == hnsw.usable_vectors(vectors).columns


def test_keys_and_places_sorted_as_one_number():
    """The stable order, also of keys too large to carry their places."""
    rng = np.random.default_rng(3)
    for keys in (np.empty(0, np.int64), np.zeros(1, np.int64), rng.integers(0, 9, 1000), rng.integers(0, 1 << 38, 1000), rng.integers(0, 3, 1000) << 61):
        assert (pitman_yor._rising(keys) == np.argsort(keys, kind="stable")).all()
