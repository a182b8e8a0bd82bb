"""Each operator against brute force on small tables with nulls, empty and very long texts, ties, repeats and odd columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from pagesieve.llm import brown, exact, langid, mixing, packing, sharding, simhash, tokens, topk, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, part string, `key` int"
random.seed(5)
VOCABULARY = ["the", "of", "And", "river", "stone", "light", "été", "où", "naïve", "Straße", "x1", "42", "it's", "—", "<|endoftext|>", "a"]


def prose(n, seed=None):
    r = random.Random(seed) if seed is not None else random
    return " ".join(r.choice(VOCABULARY) + r.choice(["", "", ".", ",", "\n"]) for _ in range(n))


def rows(texts, sources=("a", "b", None, "c")):
    return [(i, t, ["en", "fr", None][i % 3], sources[i % len(sources)], len(t or ""), 7, "p", 1) for i, t in enumerate(texts)]


TEXTS = [None, "", " \n\t", "one", "One two", "one two three", "ONE two three", "\x1c\x85 a\u00a0b", "12 34", prose(40, 1), prose(40, 1), prose(41, 2), prose(3000, 3), "x" * 70_000, *(prose(30 + i, i) for i in range(60))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([*rows(TEXTS), (None, "one two three", None, None, 0, 7, "p", 1), (3, "one", "en", "a", 3, 7, "p", 1)], DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def word_count(text):
    return len((text or "").encode().split())


# 1 -----------------------------------------------------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        level = (total - sum(capped.values())) / max(sum(weight[s] for s in free), 1)
        above = [s for s in free if weight[s] * level > 2 * sizes[s]]
        if not above:
            return capped | {s: weight[s] * level for s in free}
        capped |= {s: 2.0 * sizes[s] for s in above}


def test_mix(spark, docs):
    found = mixing.mix(docs).collect()
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += word_count(r.text)
    targets = brute_targets(sizes)
    assert len(found) == docs.count()
    taken = Counter()
    for r in found:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, targets[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert taken == {s: math.floor(t + 1e-9) for s, t in targets.items()}
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    assert mixing.mix(empty(spark)).collect() == []


def test_mix_makes_whole_copies(spark, docs):
    copies = mixing.mixed_documents(docs)
    assert copies.columns == docs.columns
    want = defaultdict(int)
    for r in mixing.mix(docs).collect():
        want[r.doc_id] = max(want[r.doc_id], 1 if r.size == 0 else r.epochs)
    got = Counter(r.doc_id for r in copies.collect())
    per_id = Counter(r.doc_id for r in docs.collect())
    assert got == {d: n * per_id[d] for d, n in want.items() if n}


# 2 -----------------------------------------------------------------------------------------------------------------


def test_pack_covers_every_id_once(spark, docs):
    found = packing.pack(docs, with_ids=True).collect()
    t = tokens.load(tokens.TOKENIZER)
    want = Counter((r.doc_id, tuple(t.encode(r.text or "", add_special_tokens=False).ids + [0])) for r in docs.collect())
    got, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        got[r.doc_id, r.doc_tokens].append((r.start, tuple(ids.tolist())))
        sequences[r.sequence_id].append((r.offset, r.length))
    left = Counter()
    for (doc_id, n), pieces in got.items():
        same = [ids for (d, ids), k in want.items() for _ in range(k) if d == doc_id and len(ids) == n]
        assert sum(len(p) for _, p in pieces) == n * len(same)
        for ids in same:
            at = 0
            while at < n:
                piece = next(p for p in pieces if p[0] == at and p[1] == ids[at : at + len(p[1])])
                pieces.remove(piece)
                at += len(piece[1])
            left[doc_id, ids] += 1
        assert not pieces
    assert left == want
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024 and (at == 1024 or at & (at - 1) == 0)
    assert packing.pack(empty(spark)).collect() == []


def test_pack_prefers_lexical_neighbours():
    terms = [np.array(x) for x in ([1, 2, 3], [7, 8, 9], [1, 2, 4], [7, 8, 6])]
    weights = [np.ones(3)] * 4
    found = packing.pack_shard(np.array([500, 500, 524, 524]), terms, weights)
    assert [[d for d, _, _ in s] for s in found] == [[0, 2], [1, 3]]


def plain_windows(lengths, terms, weights, window):
    """The first windows' documents by comparing each seed with every unused document over all terms."""
    weight = [dict(zip(t.tolist(), w.tolist(), strict=True)) for t, w in zip(terms, weights, strict=True)]
    rest, unused, out = [n % window for n in lengths], {d for d, n in enumerate(lengths) if n % window}, []
    for seed in range(len(lengths)):
        if seed not in unused:
            continue
        unused.discard(seed)
        score = {d: sum(weight[d].get(t, 0.0) for t in weight[seed]) for d in unused}
        room, taken = window - rest[seed], [seed]
        while room and unused:
            nearest = sorted(unused, key=lambda d: (-score[d], d))[: packing.NEIGHBOURS]
            fitted = False
            for d in nearest:
                if rest[d] <= room:
                    taken.append(d)
                    room -= rest[d]
                    unused.discard(d)
                    fitted = True
            if room and not fitted:
                taken.append(nearest[0])
                rest[nearest[0]] -= room
                room = 0
        if not room:
            out.append(taken)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_pack_returns_neighbours_in_the_order_of_their_score(seed):
    r = np.random.default_rng(seed)
    lengths = r.integers(1, 300, 260)
    terms = [np.unique(r.integers(0, 60, r.integers(1, 40))) for _ in lengths]
    weights = [r.integers(1, 9, len(t)).astype(float) for t in terms]
    found = packing.pack_shard(lengths, terms, weights, 256)
    whole = sum(n // 256 for n in lengths)
    want = plain_windows(lengths.tolist(), terms, weights, 256)
    assert [[d for d, _, _ in s] for s in found[whole : whole + len(want)]] == want


def test_pack_brings_neighbours_together(spark):
    """Documents about the same rare word lie in different partitions of the input and meet in one window."""
    r = random.Random(15)
    common = ["the", "of", "and", "to", "in", "is", "was", "for", "on", "with"]
    topics = ["".join(r.choice("bcdfgklmnprst") + r.choice("aeiou") for _ in range(5)) for _ in range(60)]
    texts = [" ".join(r.choice(common) if r.random() < 0.7 else topic for _ in range(60)) for topic in topics for _ in range(5)]
    order = random.Random(16).sample(range(300), 300)
    found = packing.pack(spark.createDataFrame([(f"d{i}", texts[i]) for i in order], "doc_id string, text string").repartition(5)).collect()
    together = defaultdict(set)
    for x in found:
        together[x.sequence_id].add(int(x.doc_id[1:]) // 5)
    # 5 documents a topic: dealt at random, most windows would hold one of each of theirs.
    per_topic = Counter(t for topics in together.values() for t in topics)
    assert sorted(per_topic.values())[30] <= 2


# 3 -----------------------------------------------------------------------------------------------------------------


def brute_base(texts_by_id):
    train = Counter()
    for d, t in texts_by_id:
        if zlib.crc32(str("" if d is None else d).encode()) % 10:
            train.update([*(t or "").encode().lower().split(), b""])
    n, v = sum(train.values()), len(train)
    out = []
    for d, t in texts_by_id:
        words = [*(t or "").encode().lower().split(), b""]
        out.append((d, len(words), sum(train[w] > 0 for w in words), n, sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)))
    return out


def plain_class_lm(docs, dictionary, core, classes, rounds):
    """The scores by plain Python: {(doc_id, text): score}."""
    split = lambda t: [*(t or "").encode().lower().split()]
    train = [split(t) for d, t in docs if zlib.crc32(str("" if d is None else d).encode()) % 10]
    count = Counter(w for t in train for w in t)
    steps = defaultdict(list)
    for w, c in [*count.items(), (b"", len(train))]:
        if c:
            steps[math.floor(math.log2(c) * 16)].append((w, c))
    chosen = []
    for s in sorted(steps, reverse=True):
        if len(chosen) + len(steps[s]) > dictionary:
            break
        chosen += steps[s]
    ranked = [w for w, c in sorted(chosen, key=lambda x: (-x[1], x[0])) if w]
    top = ranked[:core]
    bigrams = np.zeros((len(top), len(top)), np.int64)
    for t in train:
        for a, b in zip(t, t[1:], strict=False):
            if a in top and b in top:
                bigrams[top.index(a), top.index(b)] += 1
    end = classes
    of = dict(zip(top, brown.exchange_classes(bigrams, classes).tolist(), strict=True)) if top else {}

    def neighbours(t):
        for left, w, right in zip([b"", *t], t, [*t[1:], b""], strict=False):
            yield w, end if left == b"" else of.get(left), end if right == b"" else of.get(right)

    def gains():
        pairs = np.full((classes + 1, classes + 1), brown.ADDED_PAIRS)
        for t in train:
            for a, b in zip([b"", *t], [*t, b""], strict=True):
                x, y = (end if w == b"" else of.get(w) for w in (a, b))
                if x is not None and y is not None:
                    pairs[x, y] += 1
        return np.log(pairs / pairs.sum(0)), np.log(pairs / pairs.sum(1)[:, None]), pairs

    def best(words, default):
        into, onto, pairs = gains()
        score = {w: np.zeros(classes) for w in words}
        met = set()
        for t in train:
            for w, left, right in neighbours(t):
                if w in score:
                    for k in range(classes):
                        score[w][k] += (into[left, k] if left is not None else 0) + (onto[k, right] if right is not None else 0)
                    if left is not None or right is not None:
                        met.add(w)
        common = int(np.argmax(pairs.sum(0)[:classes]))
        return {w: int(np.argmax(np.round(x, 6))) if w in met else default(w, common) for w, x in score.items()}

    if top:
        for _ in range(rounds):
            of = best(ranked, lambda w, _: of.get(w, ranked.index(w) % classes))
    of |= best([w for w in count if w not in of], lambda w, common: common)
    n = np.zeros((classes + 1, classes + 1))
    for t in train:
        c = [end, *(of[w] for w in t), end]
        for a, b in zip(c, c[1:], strict=False):
            n[a, b] += 1
    size, inside = n.sum(0), Counter(of.values())
    inside[end] = 1
    own = (size + 0.1) / (size.sum() + 0.1 * len(size))
    room = [size[k] + 0.1 * (inside[k] + 1) for k in range(classes + 1)]
    unknown = max(range(classes), key=lambda k: (round(math.log10(own[k] / room[k]), 9), -k))
    out = {}
    for d, t in docs:
        last, total = end, 0.0
        for w in [*split(t), b""]:
            k = end if w == b"" else of.get(w, unknown)
            c = len(train) if w == b"" else count[w]
            total += math.log10((n[last, k] + 50 * own[k]) / (n[last].sum() + 50)) + math.log10((c + 0.1) / room[k])
            last = k
        out[d, t] = total
    return out


@pytest.mark.parametrize(("dictionary", "core", "classes"), [(1 << 18, 1024, 64), (9, 4, 3), (30, 8, 5), (0, 4, 3)])
def test_class_lm_equals_a_plain_model(spark, docs, monkeypatch, dictionary, core, classes):
    for name, value in (("DICTIONARY", dictionary), ("EXCHANGE_WORDS", core), ("CLASSES", classes), ("BLOCK_WORDS", 4), ("TOGETHER", 500)):
        monkeypatch.setattr(brown, name, value)
    r = random.Random(21)
    more = spark.createDataFrame([(1000 + i, " ".join(f"w{int(r.expovariate(0.1))}" for _ in range(r.choice([1, 5, 40]))), None, None, 0, 7, "p", 1) for i in range(120)], DOCS)
    docs = docs.unionByName(more)
    want = plain_class_lm([(x.doc_id, x.text) for x in docs.collect()], dictionary, core, classes, brown.SHARED_ROUNDS)
    found = sorted(((str(x.doc_id), x.n_tokens), x.score) for x in brown.score_texts(docs).collect())
    for (key, score), (other, plain) in zip(found, sorted(((str(d), word_count(t) + 1), x) for (d, t), x in want.items() for _ in range(docs.where(docs.doc_id.eqNullSafe(d) & docs.text.eqNullSafe(t)).count() if d in (3, None) else 1)), strict=True):
        assert key == other and math.isclose(score, plain, rel_tol=1e-9)


@pytest.mark.parametrize("dictionary", [1 << 18, 5])
def test_class_lm(spark, docs, monkeypatch, dictionary):
    monkeypatch.setattr(brown, "DICTIONARY", dictionary)
    found = brown.score_texts(docs).collect()
    want = sorted(brute_base([(r.doc_id, r.text) for r in docs.collect()]), key=str)
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found), key=str)
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=lambda x: (str(x[0]), x[1])), sorted(want, key=lambda x: (str(x[0]), x[1])), strict=True):
        assert a[:4] == b[:4] and math.isclose(a[4], b[4], rel_tol=1e-9)
    assert all(r.score < 0 for r in found)
    assert brown.score_texts(empty(spark)).collect() == []


def test_class_lm_runs_one_python_process_for_each_core(spark, monkeypatch):
    """No stage has two Arrow kernels in a row, which would take two processes."""
    learnt = spark.createDataFrame([(np.array([0, 1, 0, 2], "<u4").tobytes(),)], "codes binary")
    plans, kind = [], type(learnt)
    monkeypatch.setattr(kind, "collect", lambda self, f=kind.collect: plans.append(self._jdf.queryExecution().executedPlan().toString()) or f(self))
    assert len(brown._exchanged(learnt, np.array([0, 1, brown.CLASSES]))) == 3
    nodes = [re.findall(r"MapInArrow|Exchange", p) for p in plans]
    assert max(n.count("MapInArrow") for n in nodes) == 3 and not any(a == b == "MapInArrow" for n in nodes for a, b in zip(n, n[1:], strict=False))


def test_counts_of_a_small_task_take_little_room(monkeypatch):
    """A task's part of a count matrix holds only the cells it has counted, not all blocks whole."""
    monkeypatch.setattr(brown, "_salt", lambda salts: 0)
    codes = np.array([0, 5, 1023, 0, 5], "<u4")
    kernel = brown._matrix_blocks(1024, 1024, "<u4", lambda c: c[:-1] * 1024 + c[1:], 3)
    assert sum(b.nbytes for b in kernel(iter([pa.RecordBatch.from_pydict({"codes": [codes.tobytes()]})]))) < 1000
    assert sum(b.num_rows for b in kernel(iter([]))) == 0


def test_class_lm_writes_few_files(spark, monkeypatch, tmp_path):
    """Each file that an executor writes may start processes; a small table in many parts doesn't make many files."""
    whole = spark.createDataFrame([(i, prose(20 + i % 7, i) + f" w{i % 50}") for i in range(200)], "doc_id long, text string")
    whole.repartition(20).write.parquet(f"{tmp_path}/docs")
    names, few = [], 2 * spark.sparkContext.defaultParallelism
    monkeypatch.setattr(brown, "stored", lambda df, f=brown.stored: (out := f(df), names.append(out))[0])
    monkeypatch.setattr(brown, "DICTIONARY", 20)
    want = sorted(tuple(r) for r in brown.score_texts(whole.coalesce(1)).collect())
    held = {"spark.sql.shuffle.partitions": "20", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "1m"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        parts = spark.read.parquet(f"{tmp_path}/docs")
        names.clear()
        assert parts.rdd.getNumPartitions() == 20
        got = sorted(tuple(r) for r in brown.score_texts(parts).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(names) == 4 and all(0 < len(x.inputFiles()) <= few for x in names), [len(x.inputFiles()) for x in names]
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and all(math.isclose(x, y, rel_tol=1e-9) for x, y in zip(a[5:], b[5:], strict=True))


def test_class_lm_without_training_rows(spark):
    r = brown.score_texts(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).collect()[0]
    assert r.held_out and (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and math.isclose(r.base_score, 3 * math.log10(0.1 / 0.1), abs_tol=1e-9)


def test_class_lm_beats_the_base_on_held_out_text(spark):
    r = random.Random(0)
    sentence = lambda: " ".join(x for _ in range(30) for x in (r.choice(["der", "die", "das"]), r.choice(["hund", "katze", "maus"]), r.choice(["läuft", "springt"])))
    found = brown.score_texts(spark.createDataFrame([(i, sentence()) for i in range(400)], "doc_id long, text string")).where("held_out").groupBy().sum("score", "base_score").first()
    assert found[0] > 0.6 * found[1]


def test_exchange_finds_classes():
    a = np.zeros((6, 6), np.int64)
    for i in range(6):
        for j in range(6):
            a[i, j] = 50 if i % 2 != j % 2 else 0
    of = brown.exchange_classes(a, 2)
    assert len({tuple(of[0::2]), tuple(of[1::2])}) == 2 and len(set(of[0::2])) == len(set(of[1::2])) == 1


# 4 -----------------------------------------------------------------------------------------------------------------


def brute_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h) + len(p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[2] if best else "allow"


RULES = [*urls.RULES, ("example.org", "/", "allow"), ("example.org", "/es/a", "allow"), ("a.example.org", "/", "block"), ("b.c", "", "block"), ("b.c", "/x%2", "allow"), ("org", "/", "block")]


def test_urls(spark):
    r = random.Random(1)
    hosts = ["example.org", "A.Example.org", "x.a.example.org", "org", "com", "b.c", "..b.c", "notexample.org", "", "user@b.c:80", "é.com"]
    paths = ["", "/", "/es/", "/es/a/b", "/en/1", "/en/12", "/en", "/fr/q", "/de/", "/x%2F", "//"]
    some = [None, "", "no scheme", "http://", "://", "a://b://c"] + [f"http://{r.choice(hosts)}{r.choice(paths)}{r.choice(['', '?a=/b', '#f://x', '?'])}" for _ in range(400)]
    pages = spark.createDataFrame([(i % 300 if i % 17 else None, u, "h", 1, 2) for i, u in enumerate(some)], "page_id long, url string, host string, `row` int, part int")
    for rules in (RULES, urls.RULES, []):
        for parts in (1, 7):
            found = urls.judge_urls(pages, urls.rules_frame(spark, rules), partitions=parts).collect()
            got = Counter((x.page_id, x.host, x.path, x.rule, x.verdict) for x in found)
            merged = {(h, p): max(v for a, b, v in rules if (a, b) == (h, p)) for h, p, _ in rules}
            want = Counter((x.page_id, *brute_verdict(x.url, [(h, p, v) for (h, p), v in merged.items()])) for x in pages.collect())
            assert got == want
    assert urls.judge_urls(pages.limit(0), urls.rules_frame(spark)).collect() == []


# 5 -----------------------------------------------------------------------------------------------------------------


def brute_fingerprint(text, width=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, radius):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for i, d in enumerate(ids):
        least[find(i)].append(d)
    return [min((x for x in least[find(i)] if x is not None), default=None) for i in range(len(ids))]


def test_simhash_groups(spark, docs):
    found = simhash.near_duplicates(docs).collect()
    own = docs.collect()
    fps = [brute_fingerprint(r.text) for r in own]
    want = Counter(zip([r.doc_id for r in own], [f"{f:016x}" for f in fps], brute_components([r.doc_id for r in own], fps, 3), strict=True))
    assert Counter((r.doc_id, bytes(r.fp).hex(), r.component_id) for r in found) == want
    assert simhash.near_duplicates(empty(spark)).collect() == []


@pytest.mark.parametrize("tile", [8192, 20])
def test_tiles_join_all_within_the_radius(spark, tile):
    r = np.random.default_rng(3)
    fps = [int(x) for x in r.integers(0, 1 << 63, 30)]
    for _ in range(370):  # chains and clusters of near fingerprints
        f = fps[int(r.integers(len(fps)))]
        for bit in r.integers(0, 64, int(r.integers(1, 5))):
            f ^= 1 << int(bit)
        fps.append(f)
    fps = list(dict.fromkeys(fps))
    half = lambda f: ((f >> 32).bit_count(), (f & 0xFFFFFFFF).bit_count())
    nodes = spark.createDataFrame([(i, bytearray(f.to_bytes(8, "big")), *half(f)) for i, f in enumerate(fps)], "node long, fp binary, x int, y int")
    offsets = [(dx, dy) for dx in range(-3, 4) for dy in range(-3, 4) if abs(dx) + abs(dy) <= 3]
    found = {x.node: x.root for x in simhash.components(simhash.hamming_links(nodes, radius=3, offsets=offsets, tile=tile)).collect()}
    assert [found.get(i, i) for i in range(len(fps))] == brute_components(list(range(len(fps))), fps, 3)


def test_segments_skip_no_pair():
    r = np.random.default_rng(4)
    base = r.integers(0, 1 << 62, 40).astype(np.uint64)
    fps = np.unique(np.concatenate([base[r.integers(0, 40, 1500)] ^ (np.uint64(1) << r.integers(0, 64, 1500).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 1500).astype(np.uint64)), r.integers(0, 1 << 62, 500).astype(np.uint64)]))
    root = simhash.tile_links([int(f).to_bytes(8, "big") for f in fps], np.zeros(len(fps)), 3)
    assert [fps[i] for i in root] == [fps[i] for i in brute_components(list(range(len(fps))), [int(f) for f in fps], 3)]


def test_near_copies_go_and_clean_documents_stay(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    clean = [[word() for _ in range(200)] for _ in range(30)]
    near = []
    for w in clean[:10]:
        w = list(w)
        w[r.randrange(200)] = "changed"
        near.append(w)
    data = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(clean + near)] + [(90, None), (91, ""), (92, "one word")], "doc_id long, text string")
    assert sorted(x.doc_id for x in simhash.drop_near_duplicates(data).collect()) == [*range(30), 90, 92]


def test_near_groups_equal_those_of_the_sets(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(r.choice([30, 80, 200, 400]))]
        for _ in range(6):
            own = list(base)
            for _ in range(r.choice([0, 1, 2, 4, 8])):
                own[r.randrange(len(own))] = word()
            texts.append(" ".join(own[: r.choice([len(own), len(own) - 5])]))
    data = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, "", "one two"])], "doc_id long, text string").repartition(4)
    found = simhash.near_duplicates(data, width=5, words=simhash.WIDE_WORDS, radius=simhash.WIDE_RADIUS, first_radius=simhash.FIRST_RADIUS, similarity=0.8)
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in [*texts, None, "", "one two"]]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert {x.doc_id: x.component_id for x in found.collect()} == {i: find(i) for i in range(len(sets))}


def test_near_copies_under_the_same_id(spark):
    r = random.Random(9)
    base = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(60)]
    near, other = " ".join([*base[:-1], "changed"]), " ".join(base[::-1])
    data = spark.createDataFrame([(1, " ".join(base)), (2, near), (2, other), (2, other), (None, near), (None, None)], "doc_id long, text string")
    assert Counter((x.doc_id, x.text) for x in simhash.drop_near_duplicates(data).collect()) == {(1, " ".join(base)): 1, (2, other): 1, (None, None): 1}


def test_near_copies_of_any_type_with_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(40))
    names = ["doc_id", "text", "row", "h", "fp", "whole", "text_hash", "id_hash", "component_id", "own_id", "copies", "id", "digest"]
    data = spark.createDataFrame([("b", text, *range(11)), ("a", text + " end", *range(11)), ("c", "x", *range(11)), (None, "", *range(11))], ", ".join(f"{c} {'string' if i < 2 else 'int'}" for i, c in enumerate(names)))
    for found, want in ((simhash.drop_near_duplicates(data), {"a", "c", None}), (exact.drop_exact_duplicates(data), {"a", "b", "c", None}), (langid.keep_known_languages(data.withColumn("lang", data.text)), {"a", "b", "c"})):
        assert found.columns[:13] == names and {x.doc_id for x in found.collect()} == want
    assert {x.doc_id: x.component_id for x in simhash.near_duplicates(data).collect()}.keys() == {"a", "b", "c", None}
    assert {x.keep_id for x in exact.exact_dedup(data.union(data.selectExpr("'z'", *names[1:]))).collect()} == {"z"}
    mixed = mixing.mixed_documents(data.withColumn("source", data.doc_id))
    assert mixed.columns == [*names, "source"] and {x.doc_id for x in mixed.collect()} >= {None}


def test_stages_take_empty_tables(spark):
    for stage in (langid.keep_known_languages, exact.drop_exact_duplicates, simhash.drop_near_duplicates, mixing.mixed_documents):
        found = stage(empty(spark))
        assert found.columns == empty(spark).columns and found.collect() == []


def similar(a, b, width=5, least=0.8):
    a, b = (set(simhash.shingle_hashes(t, width).tolist()) for t in (a, b))
    return len(a & b) + 1e-9 >= least * len(a | b)


def test_sets_link_only_what_is_similar():
    sets = [np.arange(a, a + n).astype(np.uint64) for a, n in ((0, 10), (1, 10), (40, 10), (0, 3), (41, 9), (90, 0))]
    forest = simhash._SimilarSets(sets, 0.8)
    none = np.empty(0, np.int64)
    forest.link(none, none)
    forest.link(np.array([0, 0]), np.array([2, 3]))
    assert forest.root.tolist() == [0, 1, 2, 3, 4, 5]
    i, j = np.triu_indices(6, 1)
    forest.link(i[::-1], j[::-1])
    assert forest.root.tolist() == [0, 0, 2, 3, 2, 5]


def test_short_texts_are_compared_whole(spark):
    """Sets of 4 and 5 shingles that share 4 are 0.8 alike, and their fingerprints differ in up to a quarter of the bits."""
    r = random.Random(10)
    texts = []
    for _ in range(400):
        words = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(r.choice([8, 8, 9, 16, 17]))]
        texts += [" ".join(words), " ".join([*words, "more"])]
    found = {x.doc_id: x.component_id for x in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), width=5, words=simhash.WIDE_WORDS, radius=simhash.WIDE_RADIUS, first_radius=simhash.FIRST_RADIUS).collect()}
    assert found == {i: i - 1 if i % 2 and similar(texts[i - 1], texts[i]) else i for i in range(800)}
    assert sum(found[i] < i for i in found) > 300


@pytest.mark.parametrize("most", [simhash.MOST_BITS, 1])
def test_a_family_below_the_similarity_stays(spark, monkeypatch, most):
    """Many documents of one template, each 0.7 like the others: none is a copy, though all are candidates of each other."""
    monkeypatch.setattr(simhash, "MOST_BITS", most)  # 1: the join instead of the bitmap
    monkeypatch.setattr(simhash, "TILE_BYTES", 1 << 16)
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    shared = [word() for _ in range(90)]
    texts = [" ".join([*shared, *(word() for _ in range(18))]) for _ in range(300)]
    texts += [texts[5] + " x", texts[7] + " y"]
    assert not similar(texts[0], texts[1]) and similar(texts[5], texts[300])
    data = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert sorted(x.doc_id for x in simhash.drop_near_duplicates(data).collect()) == list(range(300))


# 6 -----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 40, 41, 1000])
def test_permutation(n):
    at = sharding.permute(np.arange(n), n)
    assert sorted(at) == list(range(n)) and list(sharding.permute(at, n, backwards=True)) == list(range(n))
    shard, slot = sharding.locate(n - 1, n)
    assert sharding.row_number_at(shard, slot, n) == n - 1


def test_shards(spark, docs, tmp_path):
    found = sharding.assign_shards(docs).collect()
    own = docs.collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in own)
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
        assert (r.shard, r.slot) == sharding.locate(r.row_number, len(own))
    assert max(map(len, slots.values())) - min(len(slots.get(s, [])) for s in range(40)) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = sharding.assign_shards(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    assert sharding.assign_shards(empty(spark)).collect() == []
    unique = docs.where("doc_id > 3")
    sharding.write_shards(unique, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((r.doc_id, r.text) for r in unique.collect())


# 7 -----------------------------------------------------------------------------------------------------------------


def test_token_counts(spark, docs):
    t = tokens.load(tokens.TOKENIZER)
    want = Counter((r.doc_id, len((r.text or "").encode()), n := len(t.encode(r.text or "", add_special_tokens=False).ids), n > 512) for r in docs.collect())
    assert Counter(map(tuple, tokens.count_tokens(docs).collect())) == want
    assert tokens.count_tokens(empty(spark)).collect() == []


def test_pieces_and_remembered_ids_agree_with_the_library():
    t = tokens.load(tokens.TOKENIZER)
    encode = tokens.IdEncoder()
    r = random.Random(13)
    marks = ["。", "、", "あ", "日本", "漢", "é", "ß", " ", "  ", "\n", "\u3000", "\u00a0", "\x1c", "\u200b", "'s", "’", "a", "1", "²", "!", "<|endoftext|>", "한", "Ж", "\u0301", "🙂"]
    fuzz = ["".join(r.choice(marks) for _ in range(r.choice([5, 60, 300]))) for _ in range(300)]
    assert len(list(tokens.pieces("日本語の文です。" * 5000, 1000))) > 20
    for text in [*TEXTS, *fuzz, "a  b\n\n c \u2003 d\t\te", "don't  we'll 've <|endoftext|>x", "日本語 text ½ ² ٣", "  lead", "trail  "]:
        text = text or ""
        ids = t.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encode(text), "<u4").tolist() == ids
        assert "".join(tokens.pieces(text, 50)) == text
        assert sum(tokens.lengths(tokens.TOKENIZER, list(tokens.pieces(text, 50)))) == len(ids)


def test_token_counts_of_another_kind(spark, docs):
    t = tokens.load("piece_bpe_32k.model")
    found = {(r.doc_id, r.n_bytes): r.n_tokens for r in tokens.count_tokens(docs, tokenizer="piece_bpe_32k.model").collect()}
    assert all(found[r.doc_id, len((r.text or "").encode())] == len(t.encode(r.text or "")) for r in docs.collect())


# 8 -----------------------------------------------------------------------------------------------------------------


def test_top_k(spark):
    r = random.Random(2)
    vectors = [(i, [r.choice([-0.5, 0.25, 0.1, 1.0, 0.0]) for _ in range(4)]) for i in range(600)]
    vectors += [(700, None), (701, [0.1, None, 0.2, 0.3]), (702, [float("nan")] * 4), (703, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (750, [0.0] * 4), (800, [1.0] * 4)] + [(900 + i, [1.0] * 4) for i in range(300)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id long, embedding array<float>, v int, id int")
    found = topk.top_k(df, df.where("vec_id % 50 = 0"))
    good = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = set()
    for q in good:
        if q % 50 == 0:
            ranked = sorted(((-sum(a * b for a, b in zip(good[q], good[c], strict=True)), c) for c in good if c != q))[:5]
            want |= {(q, k + 1, c, -s) for k, (s, c) in enumerate(ranked)}
    assert {tuple(x) for x in found.collect()} == want and found.count() == len(want)
    two = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(x) for x in topk.top_k(two, two.where("vec_id = 0")).collect()] == [(0, 1, 1, 256 * 512)]
    assert topk.top_k(two.limit(0), two.limit(0)).collect() == []


def test_top_k_with_repeated_ids(spark):
    r = random.Random(8)
    vectors = [(r.randrange(90), [r.choice([-2.0, 0.0, 1.0]) for _ in range(3)]) for _ in range(400)] + [(0, [float(i), 5.0, 5.0]) for i in range(9)] + [(7, [9.0, 9.0, 9.0])] * 3 + [(60, [3.0, 3.0, 3.0])] * 2
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    want = []
    for q in {q for q, _ in vectors if q % 20 == 0}:
        ranked = sorted((-sum(int(a * b) * 256 * 256 for a, b in zip(x, y, strict=True)), c) for p, x in vectors if p == q for c, y in vectors if c != q)[:5]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(ranked)]
    assert sorted(tuple(x) for x in topk.top_k(df, df.where("vec_id % 20 = 0")).collect()) == sorted(want)


@pytest.mark.parametrize("block", [1, 7, 2048])
def test_top_k_over_many_blocks(spark, monkeypatch, block):
    """Blocks by signs, a k-th score that travels between them, vectors of unequal length, ids of another type."""
    monkeypatch.setattr(topk, "BLOCK", block)
    r = random.Random(14)
    vectors = [(f"v{i:03}", [r.gauss(0, 1) for _ in range(r.choice([3, 5, 5]))]) for i in range(150)] + [("v200", [0.0] * 5), ("v201", [])]
    df = spark.createDataFrame(vectors, "vec_id string, embedding array<double>")
    good = {i: [math.floor(256 * x) for x in v] for i, v in vectors}
    want = []
    for q in list(good)[::9]:
        ranked = sorted((-sum(a * b for a, b in zip(good[q], good[c], strict=False)), c) for c in good if c != q)[:5]
        want += [(q, k + 1, c, -x) for k, (x, c) in enumerate(ranked)]
    found = topk.top_k(df, df.where(df.vec_id.isin(list(good)[::9])))
    assert sorted(map(tuple, found.collect())) == sorted(want)


@pytest.mark.parametrize("seed", range(5))
def test_threshold_stops_with_the_right_rows(seed):
    r = np.random.default_rng(seed)
    m = r.integers(-9, 9, (500, 6))
    lists = np.argsort(m, axis=0, kind="stable").T.copy()
    q = r.integers(-5, 5, 6) * (r.random(6) > 0.3)
    got, scores = topk.threshold_top(m, lists, q, 5)
    every = m @ q
    kth = np.sort(every)[-5]
    above, _ = topk.threshold_top(m, lists, q, 5, (), int(kth) + 1)
    assert set(above) == set(np.flatnonzero(every > kth)) and len(topk.threshold_top(m, lists, q, 5, (), 10**6)[0]) == 0
    assert set(np.flatnonzero(every > kth)) <= set(got) and (every >= kth).sum() >= 5 and set(np.flatnonzero(every >= kth)) == set(got) and list(every[got]) == list(scores)


# 9 -----------------------------------------------------------------------------------------------------------------


def test_suffix_automaton_parses_into_longest_matches():
    r = random.Random(3)
    for _ in range(50):
        sample = "".join(r.choice("ab c") for _ in range(60))
        text = "".join(r.choice("ab cd") for _ in range(40))
        n, at = 0, 0
        while at < len(text):
            end = at + 1
            while end <= len(text) and text[at:end] in sample:
                end += 1
            at = max(at + 1, end - 1)
            n += 1
        assert langid.phrase_count(langid.suffix_automaton(sample), text) == n


def test_all_texts_at_once_are_parsed_like_one(monkeypatch):
    r = random.Random(8)
    sample = tuple((lang, "".join(r.choice(letters) for _ in range(300))) for lang, letters in (("x", "ab c"), ("y", "abd "), ("z", "é c")))
    texts = ["".join(r.choice("abcdé ?") for _ in range(r.choice([0, 1, 5, 40, 200]))) for _ in range(60)]
    starts = [langid.suffix_automaton(t) for _, t in sample]
    want = [[langid.phrase_count(s, t) for s in starts] for t in texts]
    assert langid.Parser(sample).counts(texts).tolist() == want
    assert langid.Parser(sample).counts([]).tolist() == []
    monkeypatch.setattr(langid, "TABLE_ENTRIES", 0)
    assert langid.Parser(sample).counts(texts).tolist() == want


def test_predictions_equal_brute_force():
    """Greedy longest phrases under each language, counted by searching the sample; ties go to the language that sorts first."""
    r = random.Random(17)
    sample = tuple((lang, "".join(r.choice(letters) for _ in range(n))) for lang, letters, n in (("aa", "abc ", 90), ("bb", "abc ", 90), ("cc", "cde ", 70)))
    sample = (*sample, ("dd", sample[0][1]))  # as "aa", so that the two always tie
    texts = [None, "", "12 .", *("".join(r.choice("abcde XY") for _ in range(r.choice([1, 3, 30, 200]))) for _ in range(40))]

    def phrases(known, text):
        n, at = 0, 0
        while at < len(text):
            end = at + 1
            while end <= len(text) and text[at:end] in known:
                end += 1
            at, n = max(at + 1, end - 1), n + 1
        return n

    for text, (lang, score) in zip(texts, langid.predictions(sample, texts), strict=True):
        own = langid.normalized(text)
        ranked = sorted((phrases(known, own) * math.log2(len(known) + 2) / len(own), name) for name, known in sample) if own else []
        assert lang == (ranked[0][1] if ranked else "und") and lang != "dd"
        assert math.isclose(score, 1 - ranked[0][0] / ranked[1][0] if ranked else 0.0, abs_tol=1e-12)


def test_language(spark, docs):
    r = random.Random(4)
    say = {"en": "the and of to in that is was he for it with as his on be at by".split(), "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein".split(), "fr": "le de un être et à il avoir ne je son que se qui ce dans en du".split()}
    data = [(i, " ".join(r.choice(say[lang]) for _ in range(5 + i % 40)), lang, "s") for i in range(600) for lang in [("en", "de", "fr")[i % 3]]]
    df = spark.createDataFrame([*data, (1000, None, "en", "s"), (1001, "12 ... ²", None, "s"), (None, "the of", None, None)], "doc_id long, text string, lang string, source string")
    sample = langid.training_sample(df.where(langid.in_training(df.doc_id)))
    assert [lang for lang, _ in sample] == ["de", "en", "fr"]
    found = {x.doc_id: x for x in langid.detect(df, sample).collect()}
    held = [(i, lang) for i, _, lang, _ in data if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(found[i].lang_pred == lang for i, lang in held) >= 0.98 * len(held)
    assert found[1000].lang_pred == found[1001].lang_pred == "und" and found[1000].score == 0
    assert all(0 <= x.score <= 1 for x in found.values())
    kept = langid.keep_known_languages(df)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == set(found) - {1000, 1001}
    assert langid.detect(empty(spark), sample).collect() == []
    assert {x.lang_pred for x in langid.detect(docs, ()).collect()} == {"und"}


def test_known_languages_without_labels(spark):
    in_fold = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2][:3]
    for lang, ids in ((None, range(3)), ("en", in_fold)):
        df = spark.createDataFrame([*((i, "the of and", lang) for i in ids), (1000, None, None), (1001, "12 ... ²", None)], "doc_id long, text string, lang string")
        assert {x.doc_id for x in langid.keep_known_languages(df).collect()} == set(ids)


# 10 ----------------------------------------------------------------------------------------------------------------


def test_cuckoo_index_inserts_deletes_and_grows():
    index, live = exact.CuckooIndex(2, max_kicks=8), {}
    r = random.Random(6)
    for step in range(4000):
        digest = hashlib.sha256(str(r.randrange(900)).encode()).digest()
        assert index.get(digest) == live.get(digest)
        if digest in live:
            assert index.may_contain(digest) and index.delete(digest)
            del live[digest]
        else:
            index.insert(digest, step)
            live[digest] = step
    assert dict(index.items()) == live and index.size == len(live) and index.resizes > 3
    assert not index.delete(b"\0" * 32)


def test_exact_dedup(spark, docs):
    more = docs.union(docs.where("doc_id = 9")).union(spark.createDataFrame([(None, None, None, None, 0, 7, "p", 1)] * 2, DOCS))
    found = exact.exact_dedup(more).collect()
    groups = defaultdict(list)
    for r in more.collect():
        groups[hashlib.sha256((r.text or "").encode()).hexdigest()].append(r.doc_id)
    best = {h: max((d for d in ids if d is not None), default=None) for h, ids in groups.items()}
    assert Counter((r.doc_id, r.text_sha256, r.keep_id, r.group_size) for r in found) == Counter((d, h, best[h], len(ids)) for h, ids in groups.items() for d in ids)
    assert Counter((r.doc_id, r.text_sha256) for r in found if r.kept) == Counter((best[h], h) for h in groups)
    kept = exact.drop_exact_duplicates(more)
    assert kept.columns == more.columns
    assert Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in kept.collect()) == Counter((best[h], h) for h in groups)
    assert exact.exact_dedup(empty(spark)).collect() == []


def test_stored_tables_can_be_dropped(spark):
    from pagesieve.llm.common import drop_stored, stored

    df = stored(spark.range(5))
    path = df.inputFiles()[0]
    assert df.count() == 5 and spark.sparkContext.applicationId in path
    drop_stored(spark)
    import os

    assert not os.path.exists(path.removeprefix("file://"))
