"""Near-duplicates, decontamination, repeated strings, language model, pages and the pipeline against brute force."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.helpers import SCHEMA, awkward, awkward_rows, empty, prose
from urbanloom.llm import components, decontaminate, html_extract, near_groups, page_model, pitman_yor, simhash, suffix_dedup, url_filter


def slow_print(text, n=3):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))] if w else []
    votes = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def groups(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_components(spark):
    rows = awkward_rows()
    got = simhash.simhash_components(awkward(spark)).collect()
    assert collections.Counter((r.doc_id, r.fp & (2**64 - 1)) for r in got) == collections.Counter((r[0], slow_print(r[1])) for r in rows)
    prints = collections.defaultdict(set)
    for r in rows:
        if r[0] is not None:
            prints[r[0]].add(slow_print(r[1]))
    # A row belongs to the component of its fingerprint; ids with two texts have two nodes.
    nodes = sorted({(f, i) for i, fs in prints.items() for f in fs})
    least = {}
    for f, i in nodes:
        least[f] = min(i, least.get(f, i))
    found = groups(sorted(least), lambda a, b: (a ^ b).bit_count() <= 3)
    members = collections.defaultdict(list)
    for f, g in found.items():
        members[g].append(least[f])
    for r in got:
        assert r.component_id == (None if r.doc_id is None else min(members[found[r.fp & (2**64 - 1)]]))
    assert simhash.simhash_components(empty(spark)).count() == 0


@pytest.mark.parametrize(("radius", "segments", "block"), [(3, 7, 4096), (6, 13, 8)])
def test_hamming_links_lose_nothing(spark, monkeypatch, radius, segments, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    values = {int(b) for b in base}
    for b in base:
        at = int(b)
        for _ in range(12):
            for bit in rng.choice(64, rng.integers(1, radius + 3), replace=False):
                at ^= 1 << int(bit)
            values.add(at)
    values = sorted(values)
    nodes = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)), k) for k, v in enumerate(values)], "fp long, node long")
    links = simhash.hamming_links(nodes, radius, segments)
    assert all((values[r.u] ^ values[r.v]).bit_count() == r.distance <= radius for r in links.collect())
    roots = {r.node: r.root for r in components.connected_components(links.select("u", "v")).collect()}
    expected = groups(range(len(values)), lambda a, b: (values[a] ^ values[b]).bit_count() <= radius)
    assert {k: roots.get(k, k) for k in range(len(values))} == expected


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(1000, 1001), (5, 5), (None, 3)], "u long, v long")
    got = {r.node: r.root for r in components.connected_components(links).collect()}
    assert got == {k: 0 for k in range(301)} | {1000: 1000, 1001: 1000}


def test_one_of_each_group(spark):
    base = prose(500, 120).split()
    near = lambda k: " ".join("edited" if j == 10 * k + 3 else w for j, w in enumerate(base))
    rows = [(k, t, *[None] * 13) for k, t in [(5, " ".join(base)), (6, near(1)), (7, near(4)), (8, near(9)), (20, prose(501, 120)), (21, prose(502, 120)), (30, " ".join(base)), (30, " ".join(base)), (40, prose(503, 120)), (40, prose(503, 120))]]
    got = near_groups.one_of_each_group(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r.doc_id for r in got.collect()) == [5, 20, 21, 40]
    frame = near_groups.one_of_each_group(awkward(spark))
    assert frame.columns == awkward(spark).columns
    ids = [r.doc_id for r in frame.collect()]
    assert ids.count(0) == 1 and 2 not in ids and 13 in ids
    assert near_groups.one_of_each_group(empty(spark)).count() == 0


def jaccard(a, b, n=5):
    x, y = ({tuple(t.lower().split()[k : k + n]) for k in range(max(1, len(t.split()) - n + 1))} for t in (a, b))
    return len(x & y) / len(x | y)


def kept_of(spark, texts):
    rows = [(k, t, *[None] * 13) for k, t in enumerate(texts)]
    return {r.doc_id for r in near_groups.one_of_each_group(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}


def test_candidates_grow_with_the_texts_not_their_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_groups, "MEMBERS", 8)
    rng = random.Random(5)
    base = prose(600, 300).split()

    def edited(count):
        at = set(rng.sample(range(300), count))
        return " ".join(f"new{rng.randrange(10**6)}" if k in at else w for k, w in enumerate(base))

    texts = [edited(4) for _ in range(50)] + [edited(3) for _ in range(10)] + [edited(9) for _ in range(10)]
    frame = spark.createDataFrame(list(enumerate(texts)), "node long, text string").repartition(3)
    sets = near_groups.shared_prefixes(frame, 5, 0.8).persist()
    none = spark.createDataFrame([], "node long, root long")
    forest = near_groups.candidate_forest(sets, none, 0.8, near_groups.Scratch(spark)).persist()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert 0 < forest.count() < 70 * tasks < 70 * 69 / 2 / 3
    links = near_groups.links_apart(forest, sets, none, frame, 5, 0.8)
    assert all(jaccard(texts[r.u], texts[r.v]) >= 0.8 for r in links.collect())
    roots = {r.node: r.root for r in components.connected_components(links).collect()}
    expected = groups(range(len(texts)), lambda a, b: jaccard(texts[a], texts[b]) >= 0.8)
    assert {k: roots.get(k, k) for k in range(len(texts))} == expected
    assert 5 < len(set(expected.values())) < 60


def test_groups_of_block_edits(spark):
    rng, texts = np.random.default_rng(5), []
    for k in range(40):
        words = prose(7000 + k, int(rng.integers(40, 200))).split()
        drop, at = int(len(words) * 0.17), int(rng.integers(0, len(words)))
        texts += [" ".join(words), " ".join(words[:-drop]), " ".join(words[:at] + prose(8000 + k, len(words) // 12).split() + words[at:])]
    found = groups(range(len(texts)), lambda a, b: a // 3 == b // 3 and jaccard(texts[a], texts[b]) >= 0.8)
    assert len(set(found.values())) < len(texts) / 2 and kept_of(spark, texts) == set(found.values())


def test_groups_within_equal_word_sets(spark):
    rng, texts = np.random.default_rng(6), []
    for k in range(12):
        words = [f"{w}x{j}" for j, w in enumerate(prose(7100 + k, 80).split())]
        texts += [" ".join(rng.permutation(words)), " ".join(words), " ".join(words + words[-5:])]
    assert kept_of(spark, texts) == {k for k in range(len(texts)) if k % 3 < 2}


def test_groups_among_many_false_neighbours(spark):
    rng, texts = np.random.default_rng(7), []
    words = [f"{w}x{j}" for j, w in enumerate(prose(7200, 120).split())]
    for k in range(80):
        own = list(rng.permutation(words))
        own[int(rng.integers(0, 120))] = f"own{k}"
        texts += [" ".join(own), " ".join([*own[:60], *(f"new{k}y{j}" for j in range(5)), *own[65:]])]
    assert kept_of(spark, texts) == {k for k in range(len(texts)) if k % 2 == 0}


def multiset(words, n):
    return collections.Counter(tuple(words[k : k + n]) for k in range(max(0, len(words) - n + 1)))


def test_decontamination(spark):
    items = [(0, prose(900, 40)), (1, prose(901, 25)), (2, None), (3, ""), (4, "three short words"), (5, prose(900, 40))]
    edited = prose(900, 40).split()
    edited[20] = "other"
    texts = {
        0: prose(1, 30) + " " + prose(900, 40) + " " + prose(2, 30), 1: prose(3, 80), 2: prose(4, 10) + " " + " ".join(edited) + " " + prose(5, 10), 3: prose(901, 25).upper(),
        4: None, 5: "", 6: prose(900, 40)[:60], 7: "and Three SHORT words too", 8: " ".join(prose(901, 25).split()[:12]) + " " + prose(6, 30), 9: prose(1, 30) + " " + prose(900, 40) + " " + prose(2, 30),
    }
    docs = spark.createDataFrame([(k, t, *[None] * 13) for k, t in texts.items()], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = set()
    for i, t in items:
        w = (t or "").lower().split()
        n = min(5, len(w))
        for d, text in texts.items():
            v = (text or "").lower().split()
            for s in range(len(v) - len(w) + 1) if w else ():
                a, b = multiset(v[s : s + len(w)], n), multiset(w, n)
                if sum((a & b).values()) / sum((a | b).values()) >= 0.8:
                    expected.add((d, i))
    got = decontaminate.find_leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == expected
    kept = decontaminate.drop_leaking(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(texts) - {d for d, _ in expected}
    assert decontaminate.drop_leaking(awkward(spark), bench).count() == awkward(spark).count()
    assert decontaminate.find_leaks(empty(spark), bench).count() == 0
    assert decontaminate.drop_leaking(docs, bench.limit(0)).count() == docs.count()


def test_decontamination_at_the_threshold_and_of_short_texts(spark):
    item = prose(910, 67).split()
    edited = item[:30] + ["x", "y", "z"] + item[33:]  # shares 56 of 63 shingles: 56 / 70
    texts = {0: [*prose(911, 20).split(), *edited, *prose(912, 20).split()], 1: item[:62], 2: item[:57], 3: item[:50], 4: edited[:60]}
    docs = spark.createDataFrame([(k, " ".join(t), *[None] * 13) for k, t in texts.items()], SCHEMA)
    got = {r.doc_id: r for r in decontaminate.find_leaks(docs, spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")).collect()}
    assert {k: (r.start_word, r.n_words) for k, r in got.items()} == {0: (20, 67), 1: (0, 62), 2: (0, 57)}
    assert [got[k].similarity for k in (0, 1, 2)] == [56 / 70, 58 / 63, 53 / 63]


def test_decontamination_of_repetitive_texts(spark):
    """A text that repeats a passage, or one word, has hits everywhere; starts come in linear time."""
    item = prose(920, 40).split()
    texts = {0: item * 500, 1: ["word"] * 20_000, 2: item[:30] + ["y"] * 3 + item[33:40]}
    items = [(0, " ".join(item)), (1, "word " * 30)]
    docs = spark.createDataFrame([(k, " ".join(t), *[None] * 13) for k, t in texts.items()], SCHEMA)
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(0, 0): 1.0, (1, 1): 1.0}


def test_votes_of_many_hashes(spark):
    row = spark.range(1).select(decontaminate.simhash(F.concat(F.array_repeat(F.lit(-1).cast("long"), 70_000), F.array_repeat(F.lit(5).cast("long"), 69_999))).alias("fp")).first()
    assert row.fp == -1


def test_windows_beyond_the_radius_are_found(spark):
    """Windows at 0.8 exactly: within a radius of 1 there are next to none of them."""
    rng, items, texts = np.random.default_rng(3), [], []
    for k in range(40):
        words = prose(930 + k, 67).split()
        at = int(rng.integers(5, 55))
        items.append((k, " ".join(words)))
        texts.append(" ".join([*prose(5000 + k, 15).split(), *words[:at], "x", "y", "z", *words[at + 3 :], *prose(6000 + k, 15).split()]))
    docs, bench = spark.createDataFrame([(k, t, *[None] * 13) for k, t in enumerate(texts)], SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    for radius in (1, decontaminate.RADIUS):
        assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench, radius=radius).collect()} == {(k, k) for k in range(40)}


def repeats(rows):
    first = {}
    for i, t in sorted(((math.inf if r[0] is None else r[0], r[1] or "") for r in rows), key=lambda x: x[0]):
        raw = t.encode()
        for p in range(len(raw) - 49):
            first.setdefault(raw[p : p + 50], i)
    out = []
    for r in rows:
        raw, i = (r[1] or "").encode(), math.inf if r[0] is None else r[0]
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 49):
            if first[raw[p : p + 50]] < i:
                gone[p : p + 50] = True
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((r[0], len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return collections.Counter(out)


def test_repeated_strings(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 4096)  # so that long texts are read in pieces here as well
    extra = [(200, "ab" * 60, *[None] * 13), (201, "x" + "ab" * 40 + "y", *[None] * 13), (202, prose(7, 30)[20:] + "end", *[None] * 13), (203, "\x00" * 80 + "q" * 49, *[None] * 13), (204, "z" + "\x00" * 70, *[None] * 13)]
    rows = [*awkward_rows(), *extra]
    docs = spark.createDataFrame(rows, SCHEMA)
    for chunk, anchors in ((4_000, 300), (1 << 20, 1_000_000)):
        got = suffix_dedup.remove_repeats(docs, chunk_bytes=chunk, bucket_anchors=anchors).collect()
        assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == repeats(rows)
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def test_anchors_in_pieces(monkeypatch):
    text = np.frombuffer(prose(3, 3000).encode(), np.uint8)
    whole = suffix_dedup.anchors(text)
    monkeypatch.setattr(suffix_dedup, "PIECE", 500)
    starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(*suffix_dedup.anchors(text)[2:], strict=True)])
    assert sorted(starts) == list(range(len(text) - 49))
    assert set(whole[1]) == set(suffix_dedup.anchors(text)[1])


def test_loser_tree_merges():
    rng = np.random.default_rng(0)
    runs, everything = [], []
    for _ in range(7):
        rows = np.unique(rng.integers(0, 3, (rng.integers(0, 40), suffix_dedup.KEY)).astype(np.uint8) * (rng.random(suffix_dedup.KEY) < 0.1), axis=0).astype(np.uint8)
        shared, rests = suffix_dedup.front_code(rows)
        runs.append((shared.tobytes(), rests))
        everything += [r.tobytes() for r in rows]
    strings, sources, prefixes = suffix_dedup.loser_tree(runs)
    assert strings == sorted(everything)
    for a, b, p in zip(strings, strings[1:], prefixes[1:], strict=False):
        assert p == next((k for k in range(suffix_dedup.KEY) if a[k] != b[k]), suffix_dedup.KEY)


def test_pitman_yor(spark):
    rows = awkward_rows()
    got = pitman_yor.score_texts(awkward(spark)).collect()
    assert len(got) == len(rows)
    tokens = [((r[1] or "").encode().lower().split() + [b" "], zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 7 == 2, r[0]) for r in rows]
    counts = collections.Counter(w for ws, held, _ in tokens if not held for w in ws)
    n, v = sum(counts.values()), len(counts)
    expected = collections.Counter((i, held, len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6)) for ws, held, i in tokens)
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == expected
    assert pitman_yor.score_texts(empty(spark)).count() == 0


@pytest.mark.parametrize(("chunk_bytes", "bucket_bytes"), [(3_000, 500_000), (9_000, 12_000), (100_000, 3_000)])
def test_pitman_yor_is_the_same_for_all_chunks_and_buckets(spark, chunk_bytes, bucket_bytes):
    """Frequent contexts are split when there are many buckets; the scores do not show it."""
    rng = np.random.default_rng(4)
    spelled = [f"w{k}" for k in range(200)]
    docs = [(k, " ".join(w for pair in zip(["the"] * 60, rng.choice(spelled, 60, p=np.arange(200, 0, -1) / 20100), strict=True) for w in pair), *[None] * 13) for k in range(150)]
    frame = spark.createDataFrame(docs, SCHEMA)
    one = {r.doc_id: r.score for r in pitman_yor.score_texts(frame).collect()}
    many = {r.doc_id: r.score for r in pitman_yor.score_texts(frame.repartition(5), chunk_bytes=chunk_bytes, bucket_bytes=bucket_bytes).collect()}
    assert one == pytest.approx(many, abs=1e-6)


def test_pitman_yor_splits_frequent_contexts(spark):
    frame = spark.createDataFrame([(b"The a the b the c " * 50,), (b"",)], "data binary")
    found = pitman_yor.frequent_contexts(frame, 1_000, 4)
    assert set(found) == {xxhash.xxh64_intdigest(w, 42) for w in (b"the", b"a", b"b", b"c")} and found[xxhash.xxh64_intdigest(b"the", 42)] == 4
    split = pitman_yor.Split(4, found)
    the = np.full(100, xxhash.xxh64_intdigest(b"the", 42), np.uint64)
    assert len(set(split.bucket(the, np.arange(100, dtype=np.uint64)).tolist())) > 1
    assert len(set(split.bucket(the + np.uint64(1), np.arange(100, dtype=np.uint64)).tolist())) == 1


def test_pitman_yor_probabilities_add_up(spark):
    """Scores against the model in dictionaries, whose probabilities over the known words, the end and one unknown word are summed."""
    rng = np.random.default_rng(6)
    spelled = [f"v{k}" for k in range(25)]
    train = [" ".join(rng.choice(spelled, 30, p=np.arange(25, 0, -1) / 325)) for _ in range(60)]
    in_training = iter([k for k in range(1_000) if zlib.crc32(str(k).encode()) % 7 != 2])
    held = iter([k for k in range(1_000, 9_000) if zlib.crc32(str(k).encode()) % 7 == 2])
    docs = [(next(in_training), text) for text in train]
    known = sorted({w for text in train for w in text.split()})
    after = {c: {w: next(held) for w in [*known, "unseen"]} for c in ("v0", "v7", "v24")}
    ends = {c: next(held) for c in after}
    texts = {i: f"{c} {w}" for c, of in after.items() for w, i in of.items()} | {i: c for c, i in ends.items()}
    starts = {w: next(held) for w in [*known, "unseen"]}
    texts |= {i: w for w, i in starts.items()}
    none = next(held)
    docs += [*texts.items(), (none, "")]
    score = {r.doc_id: r.score for r in pitman_yor.score_texts(spark.createDataFrame([(i, x, *[None] * 13) for i, x in docs], SCHEMA)).collect()}
    model = slow_pitman_yor(train)
    for i, x in texts.items():
        assert score[i] == pytest.approx(model.score(x), abs=1e-4)
    assert score[none] == pytest.approx(model.score(""), abs=1e-4)
    for c in [None, "v0", "v7", "v24", "unseen"]:
        assert sum(model.probability(c, w) for w in [*known, END_WORD, "unseen"]) == pytest.approx(1, abs=1e-9)


END_WORD = " "


class slow_pitman_yor:
    """The model in dictionaries, dish by dish; draws are the operator's, all else is written anew."""

    def __init__(self, texts):
        d, s = pitman_yor.CONTEXT
        d0, s0 = pitman_yor.PARENT
        digest = lambda w: pitman_yor.START if w is None else xxhash.xxh64_intdigest(w.encode(), 42)
        self.pairs = collections.Counter(p for text in texts for p in zip([None, *text.split()], [*text.split(), END_WORD], strict=True))
        self.followers = collections.Counter()
        for (c, _), n in self.pairs.items():
            self.followers[c] += n
        self.known = {w for _, w in self.pairs}
        tables = dict.fromkeys(self.pairs, 1)
        self.samples = []
        for sweep in range(pitman_yor.BURN_IN + pitman_yor.SAMPLES + 1):
            if sweep:
                opened = collections.Counter()
                for (c, _), t in tables.items():
                    opened[c] += t
                t_all, s_all = sum(guests.values()), sum(seated.values())
                fresh = {}
                for (c, w), n in self.pairs.items():
                    others = guests[w] - tables[c, w]
                    base = (max(others - d0 * min(seated[w], others), 0) + (s0 + d0 * s_all) / (len(self.known) + 1)) / (s0 + t_all)
                    key = pitman_yor.mixed(np.array([digest(c)], np.uint64), 3) ^ np.array([digest(w)], np.uint64)
                    fresh[c, w] = int(pitman_yor.seat(np.array([n]), np.array([(s + d * opened[c]) * base]), d, key, sweep)[0])
                tables = fresh
                pull = (s0 + d0 * s_all) / (len(self.known) + 1)
            guests = collections.Counter()
            for (_, w), t in tables.items():
                guests[w] += t
            seated = {w: int(pitman_yor.seat(np.array([g]), np.array([pull]), d0, np.array([digest(w)], np.uint64), sweep)[0]) if sweep else 1 for w, g in guests.items()}
            if sweep > pitman_yor.BURN_IN:
                self.samples.append((tables, guests, seated))

    def probability(self, context, word):
        d, s = pitman_yor.CONTEXT
        d0, s0 = pitman_yor.PARENT
        found = []
        for tables, guests, seated in self.samples:
            base = (guests.get(word, 0) - d0 * seated.get(word, 0) + (s0 + d0 * sum(seated.values())) / (len(self.known) + 1)) / (s0 + sum(guests.values()))
            opened = sum(t for (c, _), t in tables.items() if c == context)
            found.append((self.pairs.get((context, word), 0) - d * tables.get((context, word), 0) + (s + d * opened) * base) / (s + self.followers.get(context, 0)))
        return sum(found) / len(found)

    def score(self, text):
        w = text.split()
        return sum(math.log10(self.probability(c, x)) for c, x in zip([None, *w], [*w, END_WORD], strict=True))


def test_pitman_yor_beats_its_base(spark):
    """Texts of one word each, over all words and one unknown, next to the texts that were learnt from."""
    rng = np.random.default_rng(1)
    vocabulary = [f"v{k}" for k in range(30)]
    train = [(k, " ".join(rng.choice(vocabulary, 20, p=np.arange(30, 0, -1) / 465)), *[None] * 13) for k in range(60)]
    known = {w for r in train if zlib.crc32(str(r[0]).encode()) % 7 != 2 for w in r[1].split()}
    probes = [10_000 + k for k in range(5_000) if zlib.crc32(str(10_000 + k).encode()) % 7 == 2][: len(known) + 2]
    asked = [*sorted(known), "unseen", ""]
    docs = spark.createDataFrame([*train, *[(i, w, *[None] * 13) for i, w in zip(probes, asked, strict=True)]], SCHEMA)
    rows = {r.doc_id: r for r in pitman_yor.score_texts(docs).collect()}
    scores = pitman_yor.score_texts(docs.where("doc_id < 10000").unionByName(docs.where("doc_id >= 10000")))
    assert scores.count() == len(train) + len(asked)
    seen = pitman_yor.perplexity(scores).collect()
    assert all(r.perplexity < r.base_perplexity for r in seen if not r.held_out)
    assert rows[probes[-1]].n_tokens == 1 and 10 ** rows[probes[-1]].score < 0.5


def test_seating():
    keys = np.arange(40_000, dtype=np.uint64)
    drawn = pitman_yor.seat(np.full(40_000, 3), np.full(40_000, 2.0), 0.5, keys, 1)
    second = 2 / 2.5
    third = (2 / 3.5, 2 / 3.0)  # with one table, with two
    chance = [(1 - second) * (1 - third[0]), (1 - second) * third[0] + second * (1 - third[1]), second * third[1]]
    assert np.bincount(drawn, minlength=4)[1:] / 40_000 == pytest.approx(chance, abs=0.01)
    odd = pitman_yor.seat(np.array([0, 1, 5_000, 100_000]), np.array([1.0, 1.0, 3.0, 3.0]), 0.5, keys[:4], 1)
    assert odd[0] == 0 and odd[1] == 1 and 1 <= odd[2] <= 5_000
    # Blocks of customers against one customer after the other.
    rng = np.random.default_rng(0)
    slow = np.ones(2_000)
    for i in range(1, 1_500):
        slow += rng.random(2_000) < 30.0 / (30.0 + i - 0.8 * slow)
    fast = pitman_yor.seat(np.full(2_000, 1_500), np.full(2_000, 30.0), 0.8, keys[:2_000], 2)
    assert fast.mean() == pytest.approx(slow.mean(), rel=0.01) and fast.std() == pytest.approx(slow.std(), rel=0.1)


def test_binomial_quantiles():
    u = (np.arange(20_000) + 0.5) / 20_000
    for n, p in ((2, 0.5), (40, 0.3), (16, 0.99)):
        k = pitman_yor.binomial(u, np.full(len(u), float(n)), np.full(len(u), p))
        expected = [math.comb(n, x) * p**x * (1 - p) ** (n - x) for x in range(n + 1)]
        assert np.bincount(k.astype(int), minlength=n + 1) / len(u) == pytest.approx(expected, abs=1e-3)


PAGE = """<!DOCTYPE html><html><head><title>Site &amp; co</title><style>p{}</style></head><body><header><p>Logo and slogan of the site</p></header>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About</a></li></ul></nav><!-- an <p>old</p> paragraph -->
<article><h1>Caf&eacute;  <b>news</b></h1><p>First paragraph with <a href="/x">a link</a> in
 running text, long enough.<p>Second<br>paragraph &lt;tag&gt; &#x41;&#66; with 3 < 4 in it.<script>var t = "</p>";</script><ul><li>Item one of the list</li></ul>
<div class="comments"><p>Great post! I really enjoyed reading it a lot.</p></div></article>
<aside class="sidebar"><p>Most read stories of the week, gathered for you</p></aside><form><label>Mail</label><input></form>
<div class="cookie-notice">We use cookies to make this site better for everyone.</div><footer>&copy; Site</footer></body></html>"""


def test_main_text(spark):
    assert html_extract.main_text(PAGE) == "Café news\nFirst paragraph with a link in running text, long enough.\nSecond paragraph <tag> AB with 3 < 4 in it.\nItem one of the list"
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (4, "w", "<p>cut off <b"), (None, "x", "a" * 200_000), (1, "u", PAGE), (5, "y", "<nav>only menus</nav>"), (6, "z", "<div>" * 3000 + "deep text, well inside of all that, is found" + "</div>" * 3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_extract.extract_main_text(pages).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by_id = {r.page_id: r.text for r in got}
    assert by_id[2] == by_id[3] == by_id[5] == "" and by_id[4] == "cut off" and by_id[6].startswith("deep text")
    assert html_extract.extract_main_text(pages.limit(0)).count() == 0


def test_minimum_cut_is_minimal():
    rng = np.random.default_rng(2)
    for _ in range(30):
        n = int(rng.integers(1, 8))
        content, boiler = rng.integers(0, 10, n).tolist(), rng.integers(0, 10, n).tolist()
        edges = [(a, b, int(rng.integers(0, 8))) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.6]
        cost = lambda side: sum(b if s else c for s, c, b in zip(side, content, boiler, strict=True)) + sum(w for a, b, w in edges if side[a] != side[b])  # noqa: E731,B023
        best = min(cost([bool(m >> k & 1) for k in range(n)]) for m in range(1 << n))
        assert cost(html_extract.minimum_cut(content, boiler, edges)) == best


URLS = [
    ("https://A.Example.org/en/12?x", "a.example.org", "/en/12", "example.org/en/1", "block"), ("http://example.org/es/a#b", "example.org", "/es/a", "example.org/es/", "block"),
    ("http://x.com/fr/", "x.com", "/fr/", "com/fr/", "allow"), ("http://x.com/de/1", "x.com", "/de/1", "com/de/", "block"), ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    ("http://example.org", "example.org", "", None, "allow"), (None, "", "", None, "allow"), ("no scheme/path", "", "", None, "allow"), ("ftp://h.net:80/a?b://c/d", "h.net:80", "/a", None, "allow"),
]


def test_url_rules(spark, monkeypatch):
    rows = [(k, u[0]) for k, u in enumerate(URLS)] + [(0, URLS[0][0]), (None, URLS[1][0])]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    expected = collections.Counter((k, *u[1:]) for k, u in enumerate(URLS)) + collections.Counter([(0, *URLS[0][1:]), (None, *URLS[1][1:])])
    for inline in (256, 0):
        monkeypatch.setattr(url_filter, "MAX_INLINE_RULES", inline)
        got = url_filter.url_verdicts(pages).collect()
        assert collections.Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == expected
    assert url_filter.url_verdicts(pages.limit(0)).count() == 0


@pytest.mark.parametrize("bound", [50_000, 0])
def test_url_templates_learn_from_rules(spark, monkeypatch, bound):
    monkeypatch.setattr(url_filter, "MAX_BROADCAST_TEMPLATES", bound)
    urls = [f"http://h.net/spam/{k}/" for k in range(40)] + [f"http://h.net/good/{k}" for k in range(40)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = [("block", f"h.net/spam/{k}") for k in (1, 2, 3)] + [("allow", "h.net/good/1")]
    got = {r.page_id: r for r in url_filter.url_verdicts(pages, rules).collect()}
    assert got[0].rule is None and got[0].verdict == "block" and got[0].template_rejected
    assert got[40].rule is None and got[40].verdict == "allow"


def judged(spark, urls, rules=url_filter.CONTRACT_RULES, **options):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"host": F.lit("clash"), "template": F.lit(None), "un": F.lit(1)})
    return [r.verdict for r in sorted(url_filter.url_verdicts(pages, rules, **options).collect(), key=lambda r: r.page_id)]


def test_url_templates_inherit_purity(spark):
    """Under the contract's rules: a host of blocked pages only loses its other pages; one of allowed pages keeps them."""
    urls = [f"http://spam.com/de/{k}" for k in range(60)] + ["http://spam.com/it/1", "http://spam.com/"]
    urls += [f"http://fine.com/fr/{k}" for k in range(60)] + ["http://fine.com/it/1"] + ["http://other.net/it/1"]
    got = judged(spark, urls)
    assert got[60:62] == ["block", "block"] and got[-2:] == ["allow", "allow"]


def test_url_wildcards_decide(spark):
    """Names vary below /u: pages called x are blocked, pages called y are not. Only a wildcard pools the names."""
    names = ["".join("abcdefgh"[int(c)] for c in oct(k + 64)[2:]) for k in range(60)]
    urls = [f"http://h.net/u/{n}/{page}" for n in names for page in "xy"] + ["http://h.net/u/zzz/x", "http://h.net/u/zzz/y"]
    rules = [("block", f"h.net/u/{n}/x") for n in names] + [("allow", f"h.net/u/{n}/y") for n in names]
    assert judged(spark, urls, rules)[-2:] == ["block", "allow"]
    assert judged(spark, urls, rules, max_fanout=1000)[-2:] == ["allow", "allow"]
    assert judged(spark, urls, rules, depth=2)[-2:] == ["allow", "allow"]


def test_very_long_and_tied_urls(spark):
    long = "http://h.net/" + "a/" * 20_000
    assert judged(spark, [long, "http://h.net/ab/c", "http://h.net/ab"], [("block", "net/ab/"), ("allow", "h.net/")]) == ["allow", "block", "allow"]
    assert judged(spark, ["http://h.net/ab"], [("block", "net/ab"), ("allow", "h.net/")]) == ["allow"]
    assert judged(spark, ["http://x.org/a"], [("block", "x.org/"), ("allow", "x.org/")]) == ["block"]


def test_cut_beats_threshold(monkeypatch):
    """On made-up pages other than those of the fit, the cut makes fewer errors than the classifier alone."""
    errors, exact = {}, {}
    for edge in (0, html_extract.EDGE):
        monkeypatch.setattr(html_extract, "EDGE", edge)
        errors[edge] = exact[edge] = 0
        for html, kept in page_model.pages(200, 7):
            found = [b.text for b in html_extract.main_blocks(html)]
            errors[edge] += len(set(found) ^ set(kept))
            exact[edge] += found == kept
    assert errors[html_extract.EDGE] < 0.9 * errors[0] and exact[html_extract.EDGE] > exact[0] + 10


def test_cut_of_whole_pages_is_minimal():
    weights, agree = page_model.fitted()
    seen = 0
    for html, _ in page_model.pages(200, 8):
        blocks = html_extract.blocks_of(html)
        if len(blocks) > 12:
            continue
        seen += 1
        content, boiler = html_extract.terminal_costs(blocks, weights)
        edges = html_extract.edges_of(blocks, agree)
        cost = lambda side: sum(b if s else c for s, c, b in zip(side, content, boiler, strict=True)) + sum(w for a, b, w in edges if side[a] != side[b])  # noqa: E731,B023
        kept = [b.text for b in html_extract.main_blocks(html)]
        side = html_extract.minimum_cut(content, boiler, edges)
        assert kept == [b.text for b, s in zip(blocks, side, strict=True) if s]
        assert cost(side) == min(cost([bool(m >> k & 1) for k in range(len(blocks))]) for m in range(1 << len(blocks)))
    assert seen >= 5


KEPT = "The paragraph that is kept, of course it is."
BETWEEN = "<p>One long paragraph of prose that stands here, first of all.</p>{}<p>Another long paragraph of prose stands here, last of all.</p>"


@pytest.mark.parametrize(
    "page",
    [f'<body class="has-sidebar no-ads"><article><p>{KEPT}</p></article></body>', f'<main class="main search-results"><p>{KEPT}</p></main>', "<article>" + BETWEEN.format(f'<div class="story-share-count"><p>{KEPT}</p></div>') + "</article>"],
)
def test_names_of_ancestors_lose_no_article(page):
    assert KEPT in html_extract.main_text(page)


def test_readers_comments_go():
    comment = "I never agreed with a word of this, and neither did my dog."
    for place in (f'<section id="comments"><article><p>{comment}</p></article></section>', f'<div class="comment-list"><div><p>{comment}</p></div></div>'):
        found = html_extract.main_text("<article>" + BETWEEN.format("") + place + "</article><footer>(c) us</footer>")
        assert comment not in found and found.startswith("One long") and found.endswith("last of all.")


def test_pipeline_matches_its_operators(spark, tmp_path):
    import corpus_pipeline
    from urbanloom.llm import quality_rules, secret_scan

    leak = prose(900, 40)
    docs = awkward(spark).unionByName(spark.createDataFrame([(300, prose(301, 30) + " " + leak + " " + prose(302, 30), "en", "a", *[None] * 11), (301, prose(303, 60), "en", "b", *[None] * 11)], SCHEMA))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "decontaminate", "secret_scan", "source_mix"]
    frame = docs
    for name, stage in corpus_pipeline.STAGES:
        before = frame.count()
        out = stage(spark, frame, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        assert frame.count() <= before
        if name != "source_mix":
            assert frame.columns == docs.columns
        if name == "quality_rules":
            assert frame.count() == quality_rules.apply_policy(quality_rules.ledger(docs)).where("kept").count()
        if name == "simhash_near_dedup":
            ids = [r.doc_id for r in frame.collect()]
            assert ids.count(0) == 1 and 2 not in ids and 14 not in ids and 300 in ids
        if name == "decontaminate":
            assert 300 not in [r.doc_id for r in frame.collect()] and before - frame.count() == 1
        if name == "secret_scan":
            assert frame.count() == before and secret_scan.find_secrets(frame).where("size(spans) > 0").count() == 0
    assert {"taken", "target"} <= set(frame.columns) and frame.where("taken <= 0").count() == 0
    ran = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, ran.drop("row").collect())) == sorted(map(str, frame.drop("row").collect()))
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, nothing, str(tmp_path))
        assert nothing.count() == 0
