import hashlib
import json

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from ridgeline.llm import bpe, exact_dedup, langid, mixing, near_dedup, substring
from ridgeline.llm.components import components

lower = lambda t: (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def words_of(t):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", lower(t))


def shingle_set(t, k):
    w = words_of(t)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(rows, k, percent=80):
    s = {i: shingle_set(t, k) for i, t in rows}
    label = {i: i for i in s}
    ids = sorted(s)
    changed = True
    links = [(a, b) for x, a in enumerate(ids) for b in ids[:x] if s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return {i: (len(s[i]), label[i]) for i in ids}


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.integers(len(w))] = f"e{rng.integers(10**6)}"
    return w


def corpus(seed=0):
    rng = np.random.default_rng(seed)
    rows, vocab = [], [f"v{i}" for i in range(3000)]
    for _ in range(12):
        base = rng.choice(vocab, int(rng.integers(12, 150))).tolist()
        rows += [" ".join(edited(rng, base, int(rng.integers(0, 1 + len(base) // 8)))) for _ in range(int(rng.integers(1, 12)))]
    hub = rng.choice(vocab, 120).tolist()
    rows += [" ".join(edited(rng, hub, int(n))) for n in rng.integers(0, 16, 40)]
    chain = rng.choice(vocab, 100).tolist()
    for _ in range(10):  # neighbours are alike, ends are not
        rows.append(" ".join(chain))
        chain = edited(rng, chain, 5)
    rows += ["one", "One", "one", "a b", "A  B", "", None, None, " \n", "x y z", "x y z", "long " + " ".join(vocab) * 3, "é É"]
    order = rng.permutation(len(rows))
    return [(int(i), t) for i, t in zip(order, rows)]


@pytest.mark.parametrize("k, heavy", [(2, near_dedup.HEAVY), (5, 1)])
def test_near_duplicates_against_brute_force(spark, k, heavy):
    rows = corpus(k)
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, component_id long").repartition(6)
    want = brute_components(rows, k)
    got = near_dedup.near_duplicates(df, words=k, heavy=heavy).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.component_id == r.doc_id)


def test_near_duplicates_edges(spark):
    # an id that repeats with another text: each row is a document
    rows = [(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "q r s"), (None, None), (3, "q  R s"), (3, "k l m n")]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, __id string, doc int")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(None, None, False), (None, None, False), (1, 1, True), (1, 1, True), (2, 2, True), (3, 2, False), (3, 3, True)], key=repr)
    left = near_dedup.drop_near_duplicates(df)
    assert left.columns == df.columns and sorted((r[:2] for r in left.collect()), key=repr) == sorted((r for r in rows if r != (3, "q  R s")), key=repr)
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0 and near_dedup.drop_near_duplicates(df.limit(0)).count() == 0


def test_the_bound_of_a_star_loses_no_pair():
    rng = np.random.default_rng(1)
    U = np.uint64
    for _ in range(200):
        hub = np.unique(rng.integers(0, 2**60, int(rng.integers(1, 300)), dtype=np.int64).astype(U))
        make = lambda: np.union1d(hub[rng.random(len(hub)) < rng.uniform(0.5, 1)], rng.choice(shared, int(rng.integers(0, len(shared)))))  # noqa: B023, E731
        shared = rng.integers(0, 2**60, 80, dtype=np.int64).astype(U)
        x, y = make(), make()
        pop = lambda v: int(sum(int(i).bit_count() for i in v))
        more = [near_dedup.bitmap(np.setdiff1d(v, hub)) for v in (x, y)]
        less = [near_dedup.bitmap(np.setdiff1d(hub, v)) for v in (x, y)]
        gone = [len(np.setdiff1d(hub, v)) for v in (x, y)]
        over = [len(np.setdiff1d(v, hub)) for v in (x, y)]
        within = len(hub) - max(gone[1] + pop(less[0] & ~less[1]), gone[0] + pop(less[1] & ~less[0]))
        most = within + min(over[0] - pop(more[0] & ~more[1]), over[1] - pop(more[1] & ~more[0]))
        assert most >= len(np.intersect1d(x, y))


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 20)] + [(7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(20))


def test_exact_copies_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(200).selectExpr("id AS doc_id", "concat('t', id % 60) AS text").coalesce(1)
        out = exact_dedup.exact_dedup(df, keep="max").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(out) == 200 and sum(r.kept for r in out) == 60
    assert all(r.keep_id == max(i for i in range(200) if i % 60 == r.doc_id % 60) for r in out)


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_copies_against_brute_force(spark, keep):
    rng = np.random.default_rng(2)
    texts = [None, "", "a", "A", " a", "é", "long" * 9000] + [f"t{i}" for i in range(20)]
    rows = [(i, texts[int(j)]) for i, j in enumerate(rng.integers(0, len(texts), 300))] + [(5, "a"), (5, "a"), (None, "solo"), (None, "a")]
    df = spark.createDataFrame([(i, t, True) for i, t in rows], "doc_id long, text string, kept boolean").repartition(7)
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = exact_dedup.exact_dedup(df, keep=keep).collect()
    assert len(out) == len(rows)
    kept = {}
    for r in out:
        text = next(t or "" for i, t in rows if i == r.doc_id and hashlib.sha256((t or "").encode()).hexdigest() == r.text_sha256)
        own = [i for i in groups[text] if i is not None]
        assert r.keep_id == ((max if keep == "max" else min)(own) if own else None) and r.group_size == len(groups[text])
        kept[text] = kept.get(text, 0) + r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1} and set(kept) == set(groups)
    left = exact_dedup.drop_copies(df, keep=keep)
    assert left.columns == df.columns and left.count() == len(groups)
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


def test_repeated_passages(spark):
    rng = np.random.default_rng(3)
    new = lambda n: [f"u{x}" for x in rng.integers(0, 10**9, n)]
    shared, near, short = new(70), new(90), new(30)
    slightly = near[:40] + ["changed"] + near[41:]
    body = {
        0: new(100) + shared + new(50), 1: shared + new(300), 2: new(5) + [w.upper() for w in shared], 3: new(60) + near + new(10), 4: new(33) + slightly + new(80),
        5: new(200) + short, 6: short + new(40), 7: new(400), 8: [], 10: new(49), 11: (p := new(60)) + p,
    }
    rows = [(i, " ".join(w)) for i, w in body.items()] + [(9, None), (20, " ".join(body[7])), (21, " ".join(body[7]))]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, start int").repartition(5)
    out = substring.repeated_passages(df).collect()
    spans = {}
    for r in out:
        spans.setdefault(r.doc_id, []).append((r.start, r.start + r.n_words))
    assert set(spans) == {0, 1, 2, 3, 4, 7, 20, 21}
    assert (100, 170) in spans[0] and (0, 70) in spans[1] and (5, 75) in spans[2]
    assert (60, 150) in spans[3] and (33, 123) in spans[4] and (0, 400) in spans[20]
    assert substring.repeated_passages(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind, n", [("changed", 50), ("inserted", 52), ("changed", 55), ("changed", 60), ("two", 100)])
def test_passages_with_an_edit_in_the_middle_are_found(kind, n):
    """Of pairs at similarity 0.8 and above, as many as two of four hashes leave: at least 0.95 of them."""
    rng = np.random.default_rng(n)
    new = lambda k: rng.integers(0, 2**62, k).astype(np.uint64)
    found = 0
    for _ in range(150):
        one, m = new(n), n // 2
        two = one.copy()
        for e in (n // 3, 2 * n // 3) if kind == "two" else (m,):
            two[e] = new(1)[0]
        if kind == "inserted":
            two = np.concatenate([one[:m], new(1), one[m:]])
        a, b = np.concatenate([new(150), one, new(150)]), np.concatenate([new(90), two, new(150)])
        (ka, _, at), (kb, _, rat) = substring.posts([a]), substring.posts([b])
        _, i, j = np.intersect1d(ka, kb, return_indices=True)
        keep = substring.interval_join(at[i]) & substring.akin(at[i], rat[j])
        got = substring.passages(a, b, at[i][keep] >> 36, rat[j][keep] >> 36)
        assert all(p[:4] == (150, 150 + n, 90, 90 + len(two)) and p[4] >= 0.8 for p in got)
        found += len(got)
    assert found >= 0.95 * 150


def test_equal_texts_that_repeat_themselves_are_confirmed_at_once(monkeypatch):
    """All places of two equal texts lie in one passage: no run of words about any of them is followed further."""
    rng = np.random.default_rng(2)
    text = rng.integers(0, 2**62, 8).astype(np.uint64)[rng.integers(0, 8, 900)]
    key, _, at = substring.posts([text])
    first = {k: a for k, a in zip(key[::-1].tolist(), at[::-1].tolist(), strict=True)}
    rat = np.array([first[k] for k in key.tolist()])
    x, y = np.concatenate([at, at]) >> 36, np.concatenate([at, rat]) >> 36
    chains, chain = [], substring.chain
    monkeypatch.setattr(substring, "chain", lambda *a: chains.append(1) or chain(*a))
    assert substring.passages(text, text.copy(), x, y) == [(0, 900, 0, 900, 1.0)]
    assert not chains


def brute_runs(texts, least=50):
    """(a, start in a, b, start in b, words) of the longest equal runs of `least` words or more of each two texts."""
    out = []
    for a in range(len(texts)):
        for b in range(a):
            x, y = texts[a], texts[b]
            grid = np.array([[u == v for v in y] for u in x], bool) if x and y else np.zeros((0, 0), bool)
            for d in range(-len(y) + 1, len(x)):
                diag = np.concatenate([[False], np.diagonal(grid, -d), [False]])
                edge = np.flatnonzero(diag[1:] != diag[:-1])
                for i, j in zip(edge[::2], edge[1::2], strict=True):
                    if j - i >= least:
                        out.append((a, int(i) + max(0, d), b, int(i) + max(0, -d), int(j - i)))
    return out


def test_passages_against_brute_force_whatever_the_split(spark, monkeypatch):
    """Every equal run of 50 words or more of any two texts lies in a passage that is reported of each; splits and batches change nothing."""
    rng = np.random.default_rng(12)
    new = lambda n: [f"u{x}" for x in rng.integers(0, 10**9, n)]
    line, hot, texts = new(20), new(62), []
    for k in range(10):
        p, q = new(50 + 3 * k), new(70)
        for _ in range(int(rng.integers(2, 5))):
            cut_ = int(rng.integers(0, 30))
            near = list(q)
            near[int(rng.integers(len(q)))] = "edit"
            texts.append(new(int(rng.integers(0, 40))) + p[cut_ if len(p) - cut_ >= 40 else 0 :] + line + near + new(int(rng.integers(0, 30))) + (hot if k % 3 == 0 else []))
    want = brute_runs(texts)
    assert len(want) > 20
    seen = []
    for parts, rows in ((1, 400_000), (6, 100)):
        monkeypatch.setattr(substring, "ROWS", rows)
        df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(parts)
        seen.append(sorted(map(tuple, substring.repeated_passages(df).collect())))
    assert seen[0] == seen[1]
    spans = {}
    for r in seen[0]:
        spans.setdefault(r[0], []).append((r[1], r[1] + r[2]))
    for a, i, b, j, n in want:
        for doc, start in ((a, i), (b, j)):
            assert any(x <= start and start + n <= y for x, y in spans.get(doc, [])), (doc, start, n)


def test_passages_of_which_earlier_documents_hold_parts(spark):
    rng = np.random.default_rng(8)
    new = lambda n: [f"u{x}" for x in rng.integers(0, 10**9, n)]
    early, late = [], []
    for parts, n in [([(0, 48)], 60), ([(0, 40), (20, 60)], 60), ([(0, 48), (12, 60)], 60), ([(0, 48), (27, 75)], 75), ([(0, 40), (10, 50)], 50)] * 8:
        p = new(n)
        early += [new(80) + p[x:y] + new(80) for x, y in parts]
        late.append([new(30) + p + new(40), new(70) + p + new(20), n])
    texts = early + [t for b, c, _ in late for t in (b, c)]
    out = substring.repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)).collect()
    got = {(r.doc_id, r.start, r.n_words, r.partner_id, r.partner_start) for r in out}
    want = set()
    for k, (_, _, n) in enumerate(late):
        b = len(early) + 2 * k
        want |= {(b, 30, n, b + 1, 70), (b + 1, 70, n, b, 30)}
    assert got == want


def test_near_passages_of_which_earlier_documents_hold_parts(spark):
    """Two later documents share a passage with an edit; earlier ones, which hold its parts under 50 words, come first under all of its keys."""
    rng = np.random.default_rng(9)
    new = lambda n: [f"u{x}" for x in rng.integers(0, 10**9, n)]
    early, late = [], []
    for parts, n in [([(0, 40), (30, 70)], 70), ([(0, 45), (35, 80)], 80), ([(0, 34), (30, 64)], 64)] * 6:
        p = new(n)
        q = p[: n // 2] + ["edit"] + p[n // 2 + 1 :]
        early += [new(80) + x[y:z] + new(80) for y, z in parts for x in (p, q)]
        late.append([new(30) + p + new(40), new(70) + q + new(20), n])
    texts = early + [t for b, c, _ in late for t in (b, c)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {(r.doc_id, r.start, r.n_words, r.partner_id, r.partner_start) for r in substring.repeated_passages(df.repartition(5)).collect()}
    assert got == {(r.doc_id, r.start, r.n_words, r.partner_id, r.partner_start) for r in substring.repeated_passages(df.repartition(2)).collect()}
    want = set()
    for k, (_, _, n) in enumerate(late):
        b = len(early) + 2 * k
        want |= {(b, 30, n, b + 1, 70), (b + 1, 70, n, b, 30)}
    assert got == want

def test_texts_that_repeat_a_word_are_not_compared_in_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    texts = [fresh(30) + ["the"] * int(rng.integers(18, 48)) + fresh(30) for _ in range(60)]
    head, tail = fresh(12), fresh(14)  # equal runs of under 50 words, but a passage of 54 and 59
    texts += [fresh(20) + head + ["the"] * n + tail + fresh(20) for n in (28, 33)]
    compared, confirmed = [], substring.confirmed
    monkeypatch.setattr(substring, "confirmed", lambda *a, **k: (out := confirmed(*a, **k), compared.append(out.count()))[0])
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    out = {(r.doc_id, r.start, r.n_words, r.partner_id) for r in substring.repeated_passages(df).collect()}
    assert out == {(60, 20, 54, 61), (61, 20, 59, 60)}
    assert sum(compared) < 300  # all pairs: some 1,800


def test_bounds_rule_out_no_pair_with_a_passage():
    rng, some = np.random.default_rng(6), 0
    for _ in range(400):
        common = rng.integers(0, 10**6, 120).astype(np.uint64)
        common[40 : 40 + rng.integers(5, 45)] = 7  # one word repeated
        a, b = common.copy(), np.delete(common, rng.integers(0, 120, rng.integers(1, 9)))
        for t in (a, b):
            t[rng.integers(0, len(t), rng.integers(0, 6))] = rng.integers(0, 10**6)
        sa, sb = (substring.shingles(t, 5) for t in (a, b))
        x, y = np.nonzero(sa[:, None] == sb)
        if substring.passages(a, b, x, y):
            some += 1
            sides = substring.may_hold(sa, substring.again(sa), np.sort(sb)), substring.may_hold(sb, substring.again(sb), np.sort(sa))
            assert sides[0].any() or sides[1].any()
    assert some > 50


def test_centres_lose_no_near_copy(spark, monkeypatch):
    monkeypatch.setattr(substring, "CENTRES", 2)
    rng = np.random.default_rng(8)
    common = [f"c{i}" for i in range(90)]
    texts = []
    for _ in range(24):  # copies of which some pairs are similar enough and others are not
        t = list(common)
        for k in rng.choice(90, int(rng.integers(0, 3)), replace=False):
            t[k] = f"x{rng.integers(0, 10**9)}"
        texts.append([f"f{x}" for x in rng.integers(0, 10**9, 15)] + t + [f"f{x}" for x in rng.integers(0, 10**9, 15)])
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    held = {i: np.zeros(120, bool) for i in range(24)}
    for r in substring.repeated_passages(df).collect():
        held[r.doc_id][r.start : r.start + r.n_words] = True
    words = [np.array([hash(w) for w in t]).astype(np.uint64) for t in texts]
    for i in range(24):
        want = np.zeros(120, bool)
        for j in range(24):
            x, y = np.nonzero(substring.shingles(words[i], 5)[:, None] == substring.shingles(words[j], 5))
            for p in substring.passages(words[i], words[j], x, y) if i != j else ():
                want[p[0] : p[1]] = True
        assert want.any() and not (want & ~held[i]).any()


def test_pipeline_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(4)
    vocab = [f"wort{i}" for i in range(400)]
    rows = []
    for i in range(60):
        t = rng.choice(vocab, int(rng.integers(8, 60))).tolist()
        rows.append((i, " ".join(t), "aa", f"s{i % 3}", len(t)))
    for j, i in enumerate((1, 2, 3, 3)):
        rows.append((100 + j, rows[i][1], "aa", "s0", 1))
    rows += [(200, rows[5][1] + " mehr", "aa", "s1", 1), (201, None, "aa", "s1", 0), (202, "", None, None, 0), (203, "12 34", "aa", "s2", 2)]
    pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).to_parquet(tmp_path / "documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    left = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    best = {}
    for r in left:
        best[r[1]] = max(best.get(r[1], r), r, key=lambda x: x[0])
    left = list(best.values())
    comp = brute_components([(r[0], r[1]) for r in left], 5)
    left = [r for r in left if comp[r[0]][1] == r[0]]
    docs = spark.createDataFrame(left, "doc_id long, text string, lang string, source string, n_chars long")
    want = {r.doc_id: r.copies for r in mixing.mix_sources(docs).collect() if r.copies}
    assert out.doc_id.value_counts().to_dict() == want
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.public_path())
    texts = {r[0]: r[1] for r in left}
    assert all(lib.encode(texts[d], add_special_tokens=False).ids == list(ids) for d, ids in zip(out.doc_id, out.ids))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "bpe"] and langid.UNKNOWN == "und" and json.dumps(list(want))
