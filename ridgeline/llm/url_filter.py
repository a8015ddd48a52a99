"""URL filter: host and path rules, then logistic regression on hashed character n-grams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import LOWER, UPPER, U, mix, table, utf8

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
BITS, GRAMS = 16, (3, 4, 5)
MOST_RULES = 1000
#: The labelled table: hosts and paths by verdict, crossed below. None of them is taken from the tables that the filter is run on.
_BAD = "casino-bonus free-casino adult-cams xxx-videos click-bait ad-tracker tracker-pixel malware-drop phishing-login fake-bank win-prize payday-loans replica-watches torrent-warez link-farm seo-spam poker-online hot-singles".split()
_GOOD = "library museum university school docs wiki encyclopedia news journal archive weather garden kitchen health science history music travel forum open-data research".split()
_BAD_PATHS = "/click?id=1 /buy-now /win/prize.html /ads/banner /casino/spin /xxx/1 /track/pixel.gif /free-download.exe".split()
_GOOD_PATHS = "/contact /catalogue/books /images/photo.jpg /guide/chapter-two /article/2020/05/title /docs/index.html /about /wiki/page".split()


def neutral(n: int = 400, seed: int = 10) -> list[str]:
    """Host words without meaning, made of syllables by a rule: what a model has never seen is no reason to block."""
    rng = np.random.default_rng(seed)
    start, vowel, end = "b c d f g h j k l m n p r s t v w br ch cl dr fl gr pl pr sh sp st th tr".split(), "a e i o u ea ou".split(), ["", "", "n", "r", "s", "t", "ng", "nd", "st"]
    pick = lambda x: x[rng.integers(len(x))]
    return ["".join(pick(start) + pick(vowel) + pick(end) for _ in range(rng.integers(1, 4))) for _ in range(n)]


def labelled() -> list[tuple[str, int]]:
    """URLs and whether they are to be blocked (1): some hundred rows, made up for this module."""
    out = []
    for label, hosts, paths in ((1, _BAD, _BAD_PATHS), (0, _GOOD, _GOOD_PATHS)):
        for i, host in enumerate(hosts):
            for j, path in enumerate(paths):
                # Half of the rows cross a host with paths of the other kind: hosts tell more than paths.
                path = path if (i + j) % 2 else (_GOOD_PATHS + _BAD_PATHS)[(i * 5 + j) % 16] if label else path
                out.append((f"http://{host}.example.{('com', 'net', 'org')[(i + j) % 3]}{path}", label))
    plain = [*_GOOD_PATHS, "", "/", "/1", "/a/12", "/b/345/", "/page/6.html"]
    return out + [(f"http://{host}.example.{('com', 'net', 'org')[i % 3]}{plain[i % len(plain)]}", 0) for i, host in enumerate(neutral())]


def grams(keys: list[bytes], bits: int = BITS, widths=GRAMS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all keys on end: the slot of each, and the key that it is of."""
    size = np.array([len(k) for k in keys], np.int64)
    data = np.frombuffer(b"".join(keys), np.uint8).astype(U)
    of = np.repeat(np.arange(len(keys)), size)
    slots, owner = [], []
    for w in widths:
        n = len(data) - w + 1
        if n <= 0:
            continue
        h = np.full(n, w, U)
        for i in range(w):
            h = h * U(257) + data[i : i + n] + U(1)
        whole = of[:n] == of[w - 1 : w - 1 + n]
        slots.append((mix(h[whole]) >> U(64 - bits)).astype(np.int64))
        owner.append(of[:n][whole])
    none = np.empty(0, np.int64)
    return np.concatenate(slots or [none]), np.concatenate(owner or [none])


def key(host: bytes, path: bytes) -> bytes:
    return b"^" + host + b"|" + path + b"$"


def parts(url: str) -> tuple[str, str]:
    """Host (A-Z folded) and path of a URL, as in host_of and path_of."""
    import re

    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(str.maketrans(UPPER, LOWER)), re.match(r"[^?#]*", rest[len(host) :])[0]


def train(rows: list[tuple[str, int]], bits: int = BITS, rounds: int = 300, rate: float = 8.0, ridge: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch gradient descent on the labelled rows, both labels of equal weight in all; features are shares of the key's n-grams."""
    y = np.array([label for _, label in rows], float)
    counts = np.bincount(y.astype(int), minlength=2)
    each = np.where(y == 1, 1 / max(1, counts[1]), 1 / max(1, counts[0])) / 2
    slots, of = grams([key(*(p.encode() for p in parts(u))) for u, _ in rows], bits)
    share = 1.0 / np.sqrt(np.maximum(np.bincount(of, minlength=len(rows)), 1))[of]
    w, b = np.zeros(1 << bits), 0.0
    for _ in range(rounds):
        z = np.bincount(of, w[slots] * share, len(rows)) + b
        g = (1 / (1 + np.exp(-z)) - y) * each
        w -= rate * (np.bincount(slots, g[of] * share, 1 << bits) + ridge * w)
        b -= rate * g.sum()
    return w, b


def scores(keys: list[bytes], w: np.ndarray, b: float) -> np.ndarray:
    slots, of = grams(keys, int(np.log2(len(w))))
    n = np.maximum(np.bincount(of, minlength=len(keys)), 1)
    return 1 / (1 + np.exp(-(np.bincount(of, w[slots], len(keys)) / np.sqrt(n) + b)))


def rest_of(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str]] | None = None, rows: list[tuple[str, int]] | None = None, threshold: float = 0.5) -> DataFrame:
    """Per row: id, host, path, rule, verdict, score (the model's probability of block).

    Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z folded; path: from there up to ``?``, ``#`` or the end. Null
    URLs and URLs without ``://`` have neither. A rule ``host/path`` fits its host and all subdomains if the path starts with the
    rule's; the longest rule wins (ties: the smallest). Where none fits, the model blocks at the threshold. rules are part of the plan, MOST_RULES at
    most. The model (2^16 weights, half a MB) is trained on the driver from a labelled table that is a parameter. Rows are judged where they lie: no
    shuffle, whatever share of them one host has. Rows that repeat are judged alike; an empty table gives no rows.
    """
    rules = RULES if rules is None else rules
    if len(rules) > MOST_RULES:
        raise ValueError(f"{MOST_RULES} rules at most")
    model = train(rows if rows is not None else labelled())
    url = F.coalesce(F.col(url_col), F.lit(""))
    df = pages.select(F.col(id_col).alias("id"), rest_of(url).alias("rest"))
    df = df.withColumn("h", F.regexp_extract("rest", r"^[^/?#]*", 0))
    df = df.withColumn("path", F.regexp_extract(F.expr("substring(rest, length(h) + 1)"), r"^[^?#]*", 0)).withColumn("host", F.translate("h", UPPER, LOWER))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r, v in sorted(rules, key=lambda x: (len(x[0]), [-ord(c) for c in x[0]])):  # the last that fits wins
        host, _, path = r.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    df = df.select("id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))

    def judge(batches):
        import pyarrow as pa

        for t in batches:
            keys = [key(h, p) for h, p in zip(utf8(t["host"]), utf8(t["path"]), strict=True)]
            p = scores(keys, *model)
            ruled = t["ruled"].to_pylist()
            said = [r or ("block" if x >= threshold else "allow") for r, x in zip(ruled, p, strict=True)]
            yield pa.RecordBatch.from_arrays([t["id"], t["host"], t["path"], t["rule"], pa.array(said, pa.string()), pa.array(p, pa.float64())], names=["id", "host", "path", "rule", "verdict", "score"])

    kind = dict(df.dtypes)["id"]
    return df.mapInArrow(judge, f"id {kind}, host string, path string, rule string, verdict string, score double").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))
