"""Language identification by a byte convolutional network, trained in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import by_bytes, table, utf8

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 8
#: The classifier is fitted on this many labelled documents at most (those of the smallest hashes of doc_id), two windows of each.
MOST_TRAIN = 4000
UNKNOWN = "und"
#: A filter drops what the network tells with a smaller score: with four languages, little better than a guess.
LEAST_SCORE = 0.4
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[:32] = 32


def windows(text: bytes, size: int = WINDOW) -> np.ndarray:
    """The whole text in rows of `size` folded bytes, the last one filled with spaces; one row at least."""
    n = max(1, -(-len(text) // size))
    out = np.full(n * size, 32, np.uint8)
    out[: len(text)] = FOLD[np.frombuffer(text, np.uint8)]
    return out.reshape(n, size)


class Network:
    """Filters of 2, 3 and 4 bytes over one-hot bytes, maximum over the window, ReLU and a linear layer with softmax.

    tables[j]: (256, filters) weights of byte j of a filter; those that are narrower are zero beyond their width.
    """

    def __init__(self, langs: list[str], seed: int = 6):
        rng = np.random.default_rng(seed)
        self.langs, n = langs, FILTERS * len(WIDTHS)
        self.width = np.repeat(WIDTHS, FILTERS)
        self.tables = rng.normal(0, 0.3, (max(WIDTHS), 256, n)).astype(np.float32)
        self.tables *= (np.arange(max(WIDTHS))[:, None] < self.width)[:, None, :]
        self.out, self.bias = rng.normal(0, 0.2, (n, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
        self.pairs = None

    def convolved(self, x: np.ndarray) -> np.ndarray:
        """(windows, positions, filters): two table look-ups of byte pairs make the sums of all widths."""
        if self.pairs is None:
            t, f = self.tables, FILTERS
            self.pairs = (t[0][:, None, :] + t[1][None, :, :]).reshape(65536, -1), (t[2][:, None, f:] + t[3][None, :, f:]).reshape(65536, -1)
        p = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        z = self.pairs[0][p[:, :-2]]
        z[:, :, FILTERS:] += self.pairs[1][p[:, 2:]]
        return z

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = [np.maximum(self.convolved(x[i : i + 64]).max(axis=1), 0) @ self.out + self.bias for i in range(0, len(x), 64)]
        return np.concatenate(out) if out else np.empty((0, len(self.langs)), np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, size: int = 64, rate: float = 0.01, seed: int = 6) -> Network:
        """Adam on the cross-entropy; each window is cut to a random length in each epoch, so that short texts are known, too."""
        rng = np.random.default_rng(seed)
        params = [self.tables, self.out, self.bias]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        n, wide = self.out.shape[0], x.shape[1]
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), size):
                t += 1
                rows = order[i : i + size]
                b = x[rows].copy()
                length = np.where(rng.random(len(b)) < 0.5, wide, rng.integers(8, wide + 1, len(b)))
                b[np.arange(wide)[None, :] >= length[:, None]] = 32
                self.pairs = None if t == 1 else self.pairs
                z = sum(self.tables[j][b[:, j : wide - 3 + j]] for j in range(max(WIDTHS)))
                at = z.argmax(axis=1)
                h = np.take_along_axis(z, at[:, None, :], axis=1)[:, 0, :]
                a = np.maximum(h, 0)
                s = a @ self.out + self.bias
                p = np.exp(s - s.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(b)), y[rows]] -= 1
                p /= len(b)
                g = (p @ self.out.T) * (h > 0)
                gt = np.zeros_like(self.tables)
                for j in range(max(WIDTHS)):
                    byte = np.take_along_axis(b, np.minimum(at + j, wide - 1), axis=1).astype(np.int64)
                    gt[j] = np.bincount((byte * n + np.arange(n)[None, :]).ravel(), (g * (j < self.width)).ravel(), 256 * n).reshape(256, n)
                for k, (w, d) in enumerate(zip(params, (gt, a.T @ p, p.sum(axis=0)), strict=True)):
                    m[k] += 0.1 * (d - m[k])
                    v[k] += 0.001 * (d * d - v[k])
                    w -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.pairs = None
        return self

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The language (position in langs) and its probability: the mean over the windows of the whole text, by their bytes."""
        parts = [windows(t) for t in texts]
        count = np.array([len(p) for p in parts])
        s = self.logits(np.concatenate(parts)) if parts else np.empty((0, len(self.langs)))
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        of = np.repeat(np.arange(len(texts)), count)
        weight = np.full(len(of), float(WINDOW))
        last = np.cumsum(count) - 1
        weight[last] = [max(1, len(t) - WINDOW * (c - 1)) for t, c in zip(texts, count, strict=True)]
        total = np.stack([np.bincount(of, p[:, k] * weight, len(texts)) for k in range(len(self.langs))], axis=1)
        share = total / total.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        return best, share[np.arange(len(texts)), best]


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, most: int = MOST_TRAIN) -> Network | None:
    """A network from a bounded sample: `most` rows of text and language at most, two windows of each. None without any such row.

    They are those of the smallest hashes of id and text, among the smallest 2 * most in expectation of all that have a language."""
    text, n = F.col(text_col), F.length(text_col)
    cut_ = lambda seed: F.substring(text, (F.pmod(F.xxhash64(id_col, F.lit(seed)), F.greatest(n - WINDOW, F.lit(1))) + 1).cast("int"), F.lit(WINDOW))
    rows = docs.filter(F.col(lang_col).isNotNull() & text.rlike(r"\p{L}")).select(F.xxhash64(id_col, text_col).alias("h"), F.col(lang_col).alias("lang"), cut_(1).alias("a"), cut_(2).alias("b"))
    # Each task sends what it keeps to the driver: so that this doesn't grow with the tasks, hashes that can't be among the smallest go first.
    share = 2 * most / max(1, docs.filter(F.col(lang_col).isNotNull()).count())
    if share < 1:
        rows = rows.filter(F.col("h") <= F.lit(int(share * 2**64) - 2**63))
    rows = rows.dropDuplicates(["h", "lang"])  # a row that repeats is one example
    rows = rows.orderBy("h", "lang", "a").limit(most).collect()
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return None
    x = np.concatenate([windows(t.encode())[:1] for r in rows for t in (r["a"], r["b"])])
    y = np.repeat([langs.index(r["lang"]) for r in rows], 2)
    return Network(langs).fit(x, y, epochs=max(6, min(60, 40_000 // len(x))))


def identify(docs: DataFrame, network: Network | None, text_col: str = "text") -> DataFrame:
    """docs with two more columns at the end: the predicted language and its score. Rows are judged where they lie, whole texts, window by window; no shuffle.

    A row's text goes to Python and back once, in batches bounded by bytes. Texts that are null, empty or without a letter are `und` with score 0; so is
    everything if there is no network.
    """
    by_bytes(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(network)  # half a MB, whatever the input
    inner = [f"c{i}" for i in range(len(docs.columns))]  # so that no column clashes with those that are added
    text = inner[docs.columns.index(text_col)]
    rows = docs.toDF(*inner).withColumn("letters", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))

    def judge(batches):
        import pyarrow as pa

        net = sent.value
        for batch in batches:
            langs, scores = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                known = np.flatnonzero(np.array(part["letters"].to_pylist(), bool) & (net is not None))
                if len(known):
                    best, p = net.predict(utf8(part[text].take(pa.array(known))))
                    langs[at + known], scores[at + known] = np.array(net.langs, object)[best], p
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in inner), pa.array(langs.tolist(), pa.string()), pa.array(scores)], names=[*inner, "lang_pred", "score"])

    kinds = dict(rows.dtypes)
    out = rows.mapInArrow(judge, ", ".join([*(f"{c} {kinds[c]}" for c in inner), "lang_pred string, score double"]))
    return out.select(*[F.col(i).alias(c) for i, c in zip(inner, docs.columns, strict=True)], "lang_pred", "score")


def held_out(id_col: str):
    """Whether a row is kept from training: crc32 of its id as text, mod 4, is 2. A null id is in neither part: false, and not learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_train: int = MOST_TRAIN) -> DataFrame:
    """Per row: id, held_out, lang_pred, score. Learns from rows that are not held out and have a language; repeated rows are judged alike."""
    network = train(docs.filter(~held_out(id_col)), id_col, text_col, lang_col, most_train)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(held_out(id_col), F.lit(False)).alias("held"))
    return identify(rows, network).select(F.col("id").alias(id_col), F.col("held").alias("held_out"), "lang_pred", "score")


def drop_unknown(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs, all columns, whose language the network tells with a score of `least` at least. Texts without a letter are `und` and go, as does a
    language labelled `und`. Where no network can be trained, as no row to learn from has a language, all texts with a letter stay."""
    network = train(docs.filter(~held_out(id_col)), id_col, text_col, lang_col)
    if network is None:
        return docs.filter(F.col(text_col).rlike(r"\p{L}"))
    inner = [f"c{i}" for i in range(len(docs.columns))]
    judged = identify(docs.toDF(*inner), network, inner[docs.columns.index(text_col)])
    kept = judged.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return kept.select(*[F.col(i).alias(c) for i, c in zip(inner, docs.columns, strict=True)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))
