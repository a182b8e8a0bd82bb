"""The pipeline on small tables, stage by stage, against plain Python."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from pagesieve.llm import tokens

R = random.Random(11)
SAY = {"en": "the and of to in that is was he for it with as his on be at by".split(), "de": "der die und den von zu das mit sich des auf für ist im dem nicht ein".split()}


def prose(lang, n):
    return " ".join(R.choice(SAY[lang]) + ("." if R.random() < 0.1 else "") for _ in range(n)) + " " + "".join(R.choice("abcdefgh") for _ in range(8))


def table():
    rows = [(i, prose(("en", "de")[i % 2], 60 + i % 50), ("en", "de")[i % 2], f"s{i % 3}" if i % 7 else None) for i in range(80)]
    rows += [(100 + i, rows[i][1], "en", "s0") for i in range(0, 20, 2)]  # exact copies
    for i in range(20, 30):  # near copies: one word of about a hundred
        words = rows[i][1].split()
        words[len(words) // 2] = "changedword"
        rows.append((200 + i, " ".join(words), rows[i][2], "s1"))
    return [*rows, (300, None, "en", "s0"), (301, "123 456 --", None, "s1"), (302, "", "de", None), (303, prose("en", 2500), "en", "s2")]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in table()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{base}/documents.parquet")
    docs, out = spark.read.parquet(f"{base}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(base)).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        out.append((name, docs))
    return str(base), out


def rows_of(df):
    return [(r.doc_id, r.text, r.source) for r in df.collect()]


def test_stages_keep_the_columns(stages, spark):
    base, out = stages
    assert [n for n, _ in out] == ["language ID", "exact dedup", "near dedup", "mixing", "packing"]
    assert all(df.dtypes == spark.read.parquet(f"{base}/documents.parquet").dtypes for _, df in out[:-1])


def test_language_stage(stages):
    assert sorted(i for i, _, _ in rows_of(stages[1][0][1])) == sorted(i for i, t, _, _ in table() if t and any(map(str.isalpha, t)))


def test_exact_stage(stages):
    best: dict = {}
    for i, t, _ in rows_of(stages[1][0][1]):
        best[t] = max(i, best.get(t, i))
    assert sorted(i for i, _, _ in rows_of(stages[1][1][1])) == sorted(best.values())


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_near_stage(stages):
    before = {i: shingles(t) for i, t, _ in rows_of(stages[1][1][1])}
    root = {i: i for i in before}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in before:
        for b in before:
            if a < b and len(before[a] & before[b]) >= 0.8 * len(before[a] | before[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert sorted(i for i, _, _ in rows_of(stages[1][2][1])) == sorted({find(i) for i in before})
    assert len({find(i) for i in before}) < len(before)


def test_mixing_stage(stages):
    before = rows_of(stages[1][2][1])
    size = {i: len(t.encode().split()) for i, t, _ in before}
    sizes: Counter = Counter()
    for i, _, s in before:
        sizes[s] += size[i]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    capped: dict = {}
    while True:
        free = [s for s in sizes if s not in capped]
        level = (1.5 * sum(sizes.values()) - sum(capped.values())) / max(1, sum(weight[s] for s in free))
        above = {s: 2.0 * sizes[s] for s in free if weight[s] * level > 2 * sizes[s]}
        if not above:
            break
        capped |= above
    target = capped | {s: weight[s] * level for s in sizes if s not in capped}
    after = Counter(i for i, _, _ in rows_of(stages[1][3][1]))
    for s in sizes:
        own = [i for i, _, x in before if x == s]
        taken = sum(after[i] * size[i] for i in own)
        assert math.floor(target[s]) <= taken <= math.floor(target[s]) + max(size[i] for i in own)
        assert max(after[i] for i in own) <= 2
    assert set(after) <= set(size)


def test_packing_stage(stages):
    t = tokens.load(tokens.TOKENIZER)
    want = Counter()
    for i, text, _ in rows_of(stages[1][3][1]):
        want[i] += len(t.encode(text, add_special_tokens=False).ids) + 1
    got, sequences = Counter(), defaultdict(list)
    for r in stages[1][4][1].collect():
        got[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *(n for _, n in parts[:-1])]).tolist()
        total = sum(n for _, n in parts)
        assert total <= 1024 and total & (total - 1) == 0


def test_run(spark, stages):
    from pagesieve.llm.common import stored_tables

    before = stored_tables()
    found = corpus_pipeline.run(spark, stages[0])
    assert len(set(stored_tables()) - set(before)) == 2  # what the last stage reads, and its ids
    assert Counter(r.doc_id for r in found.collect()).keys() == Counter(r.doc_id for r in stages[1][4][1].collect()).keys()


def test_run_over_nothing(spark, tmp_path):
    """No documents, or none that the first stage keeps, give no sequences."""
    for name, rows in (("empty", []), ("unknown", [(1, None, None, None, 0), (2, "12 -- 3", "en", "a", 7)])):
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / name / "documents.parquet"))
        assert corpus_pipeline.run(spark, str(tmp_path / name)).collect() == []


def test_entry_lists_the_queries():
    import __spark_entry__ as e

    names = e.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(e.oracle_sql()) <= set(names)
