"""BPE encoding and decoding by speculation: greedy longest match, pairwise verification, exact merging of what fails."""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import by_bytes, kept, table

END, MARK = "</w>", ""  # the suffix of a word's last symbol; the one character that stands for it here
LETTERS, DIGITS = "a-zªµºß-öø-ÿā-ſ", "0-9²³¹¼½¾"
#: Texts of these characters alone are split here; Unicode tables agree on them. All others go through the library's own normaliser.
OTHER = re.compile("[^\t\n\r\x20-\x7e¡-įı-ſ]")
SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^\s{LETTERS}{DIGITS}]+")
CACHED = 150_000
SHORT, NEVER = 40, np.iinfo(np.int64).max


def byte_chars() -> list[str]:
    """The printable character for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in own:
            out[b] = chr(b)
        else:
            out[b], extra = chr(256 + extra), extra + 1
    return out


class WordBPE:
    """A tokenizer file whose words end in </w>. blob: the file's content."""

    def __init__(self, blob: str):
        from tokenizers import Tokenizer

        spec = json.loads(blob)
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END or spec.get("decoder") or spec.get("post_processor"):
            raise ValueError("a word-end BPE without decoder or post-processor is expected")
        self.library = Tokenizer.from_str(blob)
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) or "(?!)")
        self.vocab = {(k[: -len(END)] + MARK if k.endswith(END) and len(k) > len(END) else k): v for k, v in model["vocab"].items()}
        self.text = {v: k for k, v in model["vocab"].items()} | {v: k for k, v in self.specials.items()}
        self.reach: dict[str, int] = {}  # the longest token that begins with these two characters
        for k in self.vocab:
            self.reach[k[:2]] = max(len(k), self.reach.get(k[:2], 1))
        self.map = str.maketrans(dict(enumerate(byte_chars())))
        n = self.n = max(self.text) + 1
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        ids = model["vocab"]
        left, right = (np.array([ids[m[i]] for m in merges], np.int64) for i in (0, 1))
        made = np.array([ids[a + b] for a, b in merges], np.int64)
        rank = np.arange(len(merges), dtype=np.int64)
        order = np.argsort(left * n + right, kind="stable")
        self.keys, self.key_rank = (left * n + right)[order], rank[order]
        self.made = made
        self.symbols = {k: v for k, v in self.vocab.items() if len(k) == 1 or (len(k) == 2 and k[1] == MARK)}
        self.pairs = {(a, b): (r, m) for a, b, r, m in zip(left.tolist(), right.tolist(), rank.tolist(), made.tolist(), strict=True)}
        self.rank, self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        # where several merges make the same token, the first counts
        self.rank[made[::-1]], self.left[made[::-1]], self.right[made[::-1]] = rank[::-1], left[::-1], right[::-1]
        # a token is sound if its own merge is what merging its symbols ends in
        self.sound = np.ones(n, bool)
        t = np.unique(made)
        self.sound[t] = self.apart(self.left[t], self.right[t], self.rank[t])
        for m in np.argsort(self.rank)[(self.rank < 0).sum() :]:  # parts come before wholes
            self.sound[m] &= self.sound[self.left[m]] & self.sound[self.right[m]]
        self.coded: dict[str, str] = {}
        self.decoded: dict[str, str] = {}

    def merge_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair; a large number where there is none."""
        k = x * self.n + y
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[at] == k, self.key_rank[at], NEVER)

    def apart(self, x: np.ndarray, y: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether neighbours x, y stay apart while their symbols merge, below rank until.

        The seam is followed back in time: at each step, the part formed last is undone. A pair on the seam would have merged
        if its rank is below those of the merges that took either part away (on equal ranks, the left pair merges first).
        """
        x, y = x.copy(), y.copy()
        ok = np.ones(len(x), bool)
        top = np.full(len(x), np.iinfo(np.int64).max - 1) if until is None else until.copy()
        px, py, live = top, top.copy(), np.arange(len(x))
        while len(live):
            a, b = x[live], y[live]
            r = self.merge_rank(a, b)
            bad = (r < px[live]) & (r <= py[live])
            ok[live[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~bad & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb = live[go], a[go], b[go], ra[go], rb[go]
            undo = ra > rb
            l, m = live[undo], live[~undo]
            px[l], x[l] = ra[undo], self.right[a[undo]]
            py[m], y[m] = rb[~undo], self.left[b[~undo]]
        return ok

    def greedy(self, word: str) -> list[int] | None:
        """Longest matches from the left; None where none fits."""
        vocab, reach = self.vocab, self.reach
        if word in vocab:
            return [vocab[word]]
        out, i, n = [], 0, len(word)
        while i < n:
            for j in range(min(n, i + reach.get(word[i : i + 2], 1)), i, -1):
                t = vocab.get(word[i:j])
                if t is not None:
                    out.append(t)
                    i = j
                    break
            else:
                return None
        return out

    def merge(self, word: str) -> list[int]:
        """Exact merging, lowest rank first, leftmost among equals: a heap over a linked list, n log n for a word of n symbols."""
        from heapq import heapify, heappop, heappush

        ids = [self.vocab[c] for c in word[:-2]] + [self.vocab[word[-2:]]]
        n, pairs = len(ids), self.pairs
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(*pairs[p], i, p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in pairs]
        heap = [(r, i, m, p) for r, m, i, p in heap]
        heapify(heap)
        while heap:
            _, i, m, p = heappop(heap)
            j = after[i]
            if j < 0 or (ids[i], ids[j]) != p:
                continue
            ids[i], ids[j] = m, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            after[j] = -1
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (q := (ids[k], ids[after[k]])) in pairs:
                    r, made = pairs[q]
                    heappush(heap, (r, k, made, q))
        return [t for t in ids if t >= 0]

    def merge_all(self, words: list[str]) -> list[list[int]]:
        """merge() for many short words at once: a row of ids for each, and the rank of each pair; a step merges one pair in every row."""
        out: list[list[int]] = []
        for at in range(0, len(words), 8192):
            part = words[at : at + 8192]
            size = np.array([len(w) - 1 for w in part], np.int64)
            m, wide = len(part), int(size.max(initial=1))
            ids = np.full((m, wide + 1), -1, np.int64)
            one = self.symbols
            flat = np.fromiter((one[c] for w in part for c in (*w[:-2], w[-2:])), np.int64, size.sum())
            ids[np.arange(wide + 1) < size[:, None]] = flat
            rank = np.full((m, wide + 1), NEVER, np.int64)
            there = ids[:, 1:] >= 0
            rank[:, :-1][there] = self.merge_rank(ids[:, :-1][there], ids[:, 1:][there])
            live = np.arange(m)
            while len(live):
                i = rank[live].argmin(axis=1)  # the leftmost of the lowest
                r = rank[live, i]
                go = r < NEVER
                live, i, r = live[go], i[go], r[go]
                if not len(live):
                    break
                a, k = ids[live], rank[live]
                a[np.arange(len(live)), i] = self.made[r]
                after = np.arange(wide)[None, :] > i[:, None]
                a[:, :-1][after] = a[:, 1:][after]
                k[:, :-1][after] = k[:, 1:][after]
                for j in (i - 1, i):  # the two pairs that hold the new token
                    own = np.flatnonzero(j >= 0)
                    x, y = a[own, j[own]], a[own, j[own] + 1]
                    k[own, j[own]] = np.where(y >= 0, self.merge_rank(x, y), NEVER)
                a[:, wide] = -1
                k[:, wide - 1 :] = NEVER
                ids[live], rank[live] = a, k
            out += [row[:n] for row, n in zip(ids.tolist(), (ids >= 0).sum(axis=1).tolist(), strict=True)]
        return out

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of words in byte-level characters."""
        marked = [w + MARK for w in words]
        out = [self.greedy(w) for w in marked]
        size = np.array([len(x or ()) for x in out], np.int64)
        flat = np.fromiter((t for x in out for t in x or ()), np.int64, size.sum())
        of = np.repeat(np.arange(len(out)), size)
        bad = np.array([x is None for x in out], bool)
        bad[of[~self.sound[flat]]] = True
        seam = np.flatnonzero(of[1:] == of[:-1])
        pair, back = np.unique(flat[seam] * self.n + flat[seam + 1], return_inverse=True)
        apart = self.apart(pair // self.n, pair % self.n)
        bad[of[seam[~apart[back]]]] = True
        failed = np.flatnonzero(bad).tolist()
        short = [i for i in failed if len(marked[i]) <= SHORT]
        for i, ids in zip(short, self.merge_all([marked[i] for i in short]), strict=True):
            out[i] = ids
        for i in failed:
            if len(marked[i]) > SHORT:
                out[i] = self.merge(marked[i])
        return out

    def words(self, texts: list[str]) -> list[list[str]]:
        """Words in byte-level characters of each text, special tokens as themselves (as MARK and the token)."""
        out = []
        for text in texts:
            own, at = [], 0
            for m in self.special.finditer(text):
                own += self.plain(text[at : m.start()])
                own.append(MARK + m[0])
                at = m.end()
            out.append(own + self.plain(text[at:]) if at else self.plain(text))
        return out

    def plain(self, text: str) -> list[str]:
        if OTHER.search(text) is None:
            # raw words: mapped to bytes only when they are not in the cache
            return SPLIT.findall(text.lower())
        return [MARK + MARK + w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]

    def encode(self, texts: list[str]) -> list[tuple[str, str]]:
        """For each text: its ids in decimal, joined by a space; its decoded text (tokens joined by a space)."""
        split = self.words(texts)
        coded, decoded = self.coded, self.decoded
        if len(coded) > CACHED:
            coded.clear()
            decoded.clear()
        new = list(set().union(*split).difference(coded))
        raw = []
        for w in new:
            if w.startswith(MARK + MARK):
                raw.append(w[2:])
            elif not w.startswith(MARK):
                raw.append(w.encode().decode("latin-1").translate(self.map))
        found = iter(self.encode_words(raw))
        for w in new:
            ids = [self.specials[w[1:]]] if w.startswith(MARK) and not w.startswith(MARK + MARK) else next(found)
            coded[w] = " ".join(map(str, ids))
            decoded[w] = " ".join([self.text[i] for i in ids])
        return [(" ".join(map(coded.__getitem__, own)), " ".join(map(decoded.__getitem__, own))) for own in split]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.text[i] for i in ids if i in self.text)


def encode_bpe(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256 and, if with_ids, ids (array of int).

    Ids are those of the tokenizers library without special tokens added, truncation or padding; decoded keeps special tokens.
    Every distinct word not seen before is cut greedily into the longest tokens; all neighbours in a batch are then verified at once: a
    cut is the true one if each token is what its own symbols merge to and each pair of neighbours would stay apart. Words that fail
    are merged exactly. Null and empty texts give no tokens. Rows are encoded where they lie, whole, whatever their length; no shuffle. The file (path, read
    once on the driver) is broadcast: a fixed size. A worker keeps CACHED words at most beyond a batch.
    """
    by_bytes(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    with open(path, encoding="utf-8") as f:  # a tokenizer file lies with the driver, not in the tables' store
        blob = f.read()
    name, sent = hashlib.sha256(blob.encode()).hexdigest(), sc.broadcast(blob)

    def run(batches):
        import pyarrow as pa

        model = kept(("bpe", name), lambda: WordBPE(sent.value))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                coded = model.encode([t or "" for t in part["text"].to_pylist()])
                sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
                columns = [part["id"], pa.array([i.count(" ") + 1 if i else 0 for i, _ in coded], pa.int64()), pa.array([sha(i) for i, _ in coded]), pa.array([sha(d) for _, d in coded])]
                if with_ids:
                    columns.append(pa.array([[int(x) for x in i.split()] for i, _ in coded], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])]
    schema = f"id {dict(rows.dtypes)['id']}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def public_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_bpe(table(spark, sf_dir, "documents"), public_path(), with_ids=False)
