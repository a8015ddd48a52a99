import re

import numpy as np
import pytest

from ridgeline.llm import bpe, chat, langid, licenses, url_filter
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
fold = lambda t: (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def scanned(text):
    w = WORD.findall(fold(text))
    at = {p: [i for i in range(len(w)) if w[i : i + len(p.split())] == p.split()] for p in licenses.PHRASES}
    every = [i for v in at.values() for i in v]
    base = {licenses.PHRASES[p] for p, v in at.items() if v}
    more, best = set(), 0.0
    for t, label in licenses.TEMPLATES:
        tokens = set(t.split())
        n = licenses.stride(t)
        for s in range(0, len(w), n):
            share = len(tokens & set(w[s : s + 2 * n])) / len(tokens)
            if share >= licenses.THRESHOLD - 1e-12:
                more.add(label)
                best = max(best, share)
    return len(w), len(every), min(every, default=None), max(every, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if every else best


def test_licenses_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vocab = [t for x, _ in licenses.TEMPLATES for t in x.split()] + ["foo", "bar", "é", "cc", "by"] * 10
    texts = [" ".join(rng.choice(vocab, int(n))) for n in rng.integers(0, 90, 40)]
    texts += [None, "", "CC BY cc-by cc by by", "All Rights Reserved. all rights  reserved", "x " * 20 + licenses.TEMPLATES[1][0].replace("free", "fee") + " y" * 30, "İ general public license", "no words: --- \u0000 ..."]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    for r in licenses.scan_licenses(df).collect():
        want = scanned(texts[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == want[:6] and r.score == pytest.approx(want[6])
    assert licenses.scan_licenses(df.limit(0)).count() == 0
    long = " ".join(f"t{i}" for i in range(300))  # templates of any length and number, other labels
    many = [(f"a{i} b{i} c{i}", f"it's {i}") for i in range(1500)] + [(long, "long"), ("--", "no words")]
    df = spark.createDataFrame([(1, "x " * 777 + long + " y"), (2, "c7 z a7 B7"), (3, "a8 b8")], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in licenses.scan_licenses(df, templates=many).collect()} == {1: "long", 2: "it's 7", 3: ""}
    assert {r.labels for r in licenses.scan_licenses(df, templates=[]).collect()} == {""}


def test_preferences(spark):
    rows = [(0, 0, "user", "Hi"), (0, 1, "assistant", "Yes"), (0, 2, "user", None), (1, 0, "user", "Hi"), (1, 1, "assistant", "No"), (2, 0, None, "a"), (4, 0, "user", "s"), (4, 1, "assistant", "t"), (5, 0, "user", "s"), (5, 1, "assistant", "t"), (None, 0, "user", "lost")]
    df = spark.createDataFrame([(*r, "p") for r in rows], "conv_id long, turn long, role string, text string, prompt string")
    out = {r.pair_id: r for r in chat.format_preferences(df, F.floor(F.col("conv_id") / 2), F.col("conv_id") % 2 == 0).collect()}
    r = out[0]
    assert (r.prompt_turns, r.prompt) == (1, "<|user|>\nHi<|end|>\n") and r.paired
    assert r.chosen == "<|assistant|>\nYes<|end|>\n<|user|>\n<|end|>\n" and r.rejected == "<|assistant|>\nNo<|end|>\n"
    assert r.chosen_mask == f"{len('<|assistant|>|Yes<|end|>|')}:1,{len('<|user|>|<|end|>|')}:0"
    assert not out[1].paired and out[1].rejected is None and out[1].prompt == "" and out[1].chosen == "<||>\na<|end|>\n"
    assert out[2].chosen == "" and out[2].rejected == "" and out[2].prompt_turns == 2 and set(out) == {0, 1, 2}
    assert chat.format_preferences(df.limit(0), F.col("conv_id"), F.col("conv_id") > 0).count() == 0


def test_languages_are_told_apart(spark):
    rng = np.random.default_rng(4)
    words = {"aa": ["the", "and", "this", "with", "house"], "bb": ["der", "und", "nicht", "über", "haus"], "cc": ["это", "дом", "не", "как", "мир"]}
    rows = [(i, " ".join(rng.choice(words[k := list(words)[i % 3]], int(rng.integers(3, 80)))), k) for i in range(300)]
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "123 -- !", None), (903, "the house and this " * 5000, None), (904, "x", None)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    out = {r.doc_id: r for r in langid.language_id(df).collect()}
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in out.items())
    held = [(out[i].lang_pred, k) for i, _, k in rows[:300] if out[i].held_out]
    assert len(held) > 40 and np.mean([a == b for a, b in held]) > 0.95
    assert [out[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "aa"] and out[902].score == 0
    kept = langid.drop_unknown(df)
    assert kept.columns == df.columns and {900, 901, 902}.isdisjoint({r.doc_id for r in kept.collect()}) and kept.count() == len(rows) - 3
    assert langid.language_id(df.limit(0)).count() == 0


def test_documents_pass_where_no_language_is_known(spark):
    rows = [(1, "the house", None), (2, "über", None), (3, "123 -- !", None), (4, "", None), (5, None, None), (None, "дом", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = langid.drop_unknown(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {1, 2, None} and kept.count() == 3


def test_bpe_is_the_librarys(spark):
    import hashlib

    from tokenizers import Tokenizer

    path = bpe.public_path()
    lib = Tokenizer.from_file(path)
    lib.no_truncation()
    lib.no_padding()
    rng = np.random.default_rng(5)
    letters = list("abcdefgh ijklmnop'qrstuvwxyz ABC 0123456789.,!?-_\n\té ßæøÿ ĳŉſ ™漢字İı😀\u0000\u200b\u0301²¼")
    texts = ["".join(rng.choice(letters, int(n))) for n in rng.integers(0, 200, 150)]
    texts += [None, "", " ", "<|startoftext|>hello<|endoftext|> world", "it's they've I'LL", "a" * 3000, "supercalifragilistic" * 200, "été ÉTÉ ẞ", "don 't 's"]
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in bpe.encode_bpe(df, path).collect():
        ids = lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids), texts[r.doc_id]
        assert r.ids_sha256 == sha(" ".join(map(str, ids))) and r.decoded_sha256 == sha(lib.decode(ids, skip_special_tokens=False))
    assert bpe.encode_bpe(df.limit(0), path).count() == 0


def test_urls(spark):
    urls = ["http://A.example.ORG/es/x?q#f", "https://example.org/en/123", "http://b.com/fr/", "http://x.y.com/de/1", "http://notexample.org/es/", None, "", "no scheme", "ftp://host", "http://h?x://y/z", "://#", "http://casino-bonus.net/casino/spin", "http://museum.net/about", "http://example.org/fr/"]
    df = spark.createDataFrame([(i, u, "v") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    out = {r.page_id: r for r in url_filter.judge_urls(df).collect()}
    assert [out[i].rule for i in range(5)] == ["example.org/es/", "example.org/en/1", "com/fr/", "com/de/", "org/"]
    assert [out[i].verdict for i in range(5)] == ["block", "block", "allow", "block", "allow"]
    assert (out[0].host, out[0].path) == ("a.example.org", "/es/x") and [(out[i].host, out[i].path) for i in (5, 6, 7, 10)] == [("", "")] * 4
    assert (out[8].host, out[8].path) == ("host", "") and (out[9].host, out[9].path) == ("h", "")
    assert out[11].verdict == "block" and out[12].verdict == "allow" and out[13].rule == "org/"
    for i, u in enumerate(urls):
        assert (out[i].host, out[i].path) == url_filter.parts(u)
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_url_model_on_hosts_left_out():
    rows = url_filter.labelled()
    host = np.array([url_filter.parts(u)[0].split(".")[0] for u, _ in rows])
    rng, right = np.random.default_rng(6), []
    for _ in range(3):
        held = np.isin(host, rng.choice(np.unique(host), len(np.unique(host)) // 4, replace=False))
        w, b = url_filter.train([r for r, h in zip(rows, held) if not h])
        p = url_filter.scores([url_filter.key(*(x.encode() for x in url_filter.parts(u))) for (u, _), h in zip(rows, held) if h], w, b)
        y = np.array([label for (_, label), h in zip(rows, held) if h])
        assert (p[y == 0] >= 0.5).mean() < 0.02  # what is to be allowed is
        right.append(((p >= 0.5) == (y == 1)).mean())
    assert np.mean(right) > 0.9


def test_url_model_learns_nothing_from_the_pages_tables():
    rows = [(*url_filter.parts(u), label) for u, label in url_filter.labelled()]
    assert {h.split(".")[0] for h, _, _ in rows}.isdisjoint("thther tionble ererin handth blog m www spam-farm cheap-pills".split())
    assert not any(re.match(r"/(en|fr|de|es)/[0-9]+", p) for _, p, _ in rows)
    apart = [(f"http://{h}.example.info{p}", label) for label, hosts, paths in (
        (0, "gallery theatre choir botany physics parish observatory orchard railway chess bakery cinema geology poetry sailing", "/history/1890 /events/june /map.html"),
        (1, "casino-jackpot spam-blaster pills-discount adult-videos phishing-trap malware-hub loans-payday poker-bonus torrent-free fake-watches click-tracker xxx-singles win-casino seo-farm ad-pixel", "/click?id=77 /casino/bonus /free-prize.exe"),
    ) for h in hosts.split() for p in paths.split()]
    w, b = url_filter.train(url_filter.labelled())
    p = url_filter.scores([url_filter.key(*(x.encode() for x in url_filter.parts(u))) for u, _ in apart], w, b)
    y = np.array([label for _, label in apart])
    assert ((p >= 0.5) == (y == 1)).mean() > 0.95


def test_convolutions_against_the_definition():
    rng = np.random.default_rng(3)
    net = langid.Network(["a", "b", "c"])
    net.out, net.bias = rng.normal(size=net.out.shape).astype(np.float32), rng.normal(size=3).astype(np.float32)
    texts = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (1, 5, 256, 700)]
    x = np.concatenate([langid.windows(t) for t in texts])
    want = np.zeros((len(x), langid.WINDOW - 3, len(net.width)))
    for r, row in enumerate(x):
        for f, width in enumerate(net.width):
            for i in range(langid.WINDOW - 3):
                want[r, i, f] = sum(net.tables[j][row[i + j], f] for j in range(width))
    assert np.allclose(net.convolved(x), want, atol=1e-4)
    logits = np.maximum(want.max(axis=1), 0) @ net.out + net.bias
    assert np.allclose(net.logits(x), logits, atol=1e-3)
    best, score = net.predict(texts)
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    at = 0
    for k, t in enumerate(texts):
        n = -(-len(t) // langid.WINDOW)
        size = np.array([langid.WINDOW] * (n - 1) + [len(t) - langid.WINDOW * (n - 1)])
        mean = (p[at : at + n] * size[:, None]).sum(axis=0) / size.sum()
        assert best[k] == mean.argmax() and score[k] == pytest.approx(mean.max(), abs=1e-3)
        at += n
