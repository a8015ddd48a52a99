"""MinHash near-dedup by a signature-coordinate inverted join."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import U, WordHash, by_bytes, cut, discard, kept, mix, release, shingles, table, utf8
from ridgeline.llm.components import components, merged

#: A signature has 24 coordinates, each the value of two of 48 minima.
COORDINATES, MINIMA, THRESHOLD, WORDS = 24, 48, 80, 2
MISS = 1e-6  # the probability at most with which a pair of the similarity asked for collides in too few coordinates
STARS, PIVOTS = 2, 64  # rounds of pivots, and pivots of a star
HEAVY = 4096  # comparisons from which a list's members are first compared to the smallest node of its largest component
MOST_SENT = 300_000  # rows (id, doc, own) up to which the documents to be compared are sent to all tasks, some 10 MB; more are joined by a shuffle
BYTES = ["m1", "m2", "m3"]


def needed(n: int, p: float) -> int:
    """The largest number that n trials of probability p fall short of with a probability of MISS at most, 1 at least."""
    from math import comb

    short, least = 0.0, 0
    while least < n and (short := short + comb(n, least) * p**least * (1 - p) ** (n - least)) <= MISS:
        least += 1
    return max(1, least)


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, n + 1, dtype=U) * U(0x632BE59BD9B4E019))
    return (seeds >> U(32)).astype(np.uint32), seeds.astype(np.uint32) | np.uint32(1)


def sets(texts: list[bytes | None], k: int, words: WordHash) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out = []
    for t in texts:
        s = np.sort(shingles(words.of(t), k))
        out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s)
    return out


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of each permutation over the set's hashes, in 32 bits."""
    h = (s >> U(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(h), 1024):
        part = h[None, i : i + 1024] ^ a[:, None]
        part *= b[:, None]
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x2C1B3C6D)
        out = np.minimum(out, part.min(axis=1))
    return out


def profiles(docs: DataFrame, k: int) -> DataFrame:
    """doc, own, n (set size), set_a, set_b (128-bit hash of the set), posts (coordinate and value in one number each), m1, m2, m3 (a byte of each coordinate's value)."""

    def run(batches):
        import pyarrow as pa

        words = kept("words", WordHash)
        a, b = permutations(MINIMA)
        shift = np.arange(8, dtype=U) * U(8)
        for batch in batches:
            n, h, keys, minis = [], [], [], []
            for s in sets(utf8(batch["text"]), k, words):
                sig = signature(s, a, b)
                n.append(len(s))
                h.append((int(np.bitwise_xor.reduce(mix(s + U(1)), initial=0)), int(np.add.reduce(mix(s + U(2)), dtype=U))))
                two = mix((sig[::2].astype(U) << U(32)) | sig[1::2].astype(U))
                keys.append(((two & ~U(31)) | np.arange(COORDINATES, dtype=U)).view(np.int64))
                byte = two >> U(56)
                minis.append([int(np.bitwise_or.reduce(byte[i : i + 8] << shift)) for i in (0, 8, 16)])
            long = lambda v: pa.array(np.array(v, U).view(np.int64))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * COORDINATES, pa.int32()), pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch["doc"], batch["own"], pa.array(n, pa.int64()), long([x for x, _ in h]), long([x for _, x in h]), flat, *(long([x[i] for x in minis]) for i in range(3))], names=["doc", "own", "n", "set_a", "set_b", "posts", *BYTES])

    return docs.mapInArrow(run, "doc long, own long, n long, set_a long, set_b long, posts array<long>, m1 long, m2 long, m3 long")


def collisions(x: str, y: str) -> Column:
    """In how many of the 24 coordinates two signatures collide, by one byte of each value: never fewer than do, and one too many in 256 that don't."""
    out = F.lit(COORDINATES)
    for m in BYTES:
        d = F.col(f"{x}.{m}").bitwiseXOR(F.col(f"{y}.{m}"))
        for by in (1, 2, 4):
            d = d.bitwiseOR(F.shiftright(d, by))
        out = out - F.bit_count(d.bitwiseAND(F.lit(0x0101010101010101)))
    return out


def alike(x: str, y: str, percent: int, need: int) -> Column:
    """Sizes allow the similarity, and the coordinates that collide reach the match threshold."""
    small, large = F.least(f"{x}.n", f"{y}.n"), F.greatest(f"{x}.n", f"{y}.n")
    return (small * 100 >= large * percent) & (collisions(x, y) >= need)


def bitmap(values: np.ndarray) -> np.ndarray:
    """512 bits, of which each value sets one."""
    out, v = np.zeros(8, U), values & U(511)
    np.bitwise_or.at(out, (v >> U(6)).astype(np.int64), U(1) << (v & U(63)))
    return out


def compared(pairs: DataFrame, rows: DataFrame, names: DataFrame, words: int, many: bool = False) -> DataFrame:
    """For pairs (a, b) of nodes, whose texts are those of names (id, doc, own) in rows (doc, own, text), on full sets: na, nb, both (the intersection), more and less: what b has beyond a, and a beyond b, as bitmaps; pm and pl: their bits."""
    # Pairs that grow with the corpus are merged at every size: a plan that broadcasts them while they are few would tell nothing of a larger run.
    sized = lambda df: df.hint("merge") if many else df
    ids = sized(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    who = cut(names.join(ids, "id"))
    who_ = who.hint("merge") if many else F.broadcast(who) if who.count() <= MOST_SENT else who  # texts then stay where they are, but those asked for
    # a document's id and a hash of its text: where an id repeats with another text, the right one is taken
    texts = cut(rows.join(who_, ["doc", "own"]).groupBy("id").agg(F.min("text").alias("text")))
    release(pairs.sparkSession)

    def run(batches):
        import pyarrow as pa

        held = kept("words", WordHash)
        last, x = None, None
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                out, more, less = [], [], []
                for a, s, t in zip(batch["a"].to_pylist(), utf8(batch["s"]), utf8(batch["t"]), strict=True):
                    if a != last:  # rows of one a follow each other
                        last, x = a, sets([s], words, held)[0]
                    y = sets([t], words, held)[0]
                    common = x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y
                    gone = np.ones(len(x), bool)
                    gone[np.searchsorted(x, y[common])] = False
                    out.append((len(x), len(y), int(common.sum())))
                    more.append(bitmap(y[~common]))
                    less.append(bitmap(x[gone]))
                n = np.array(out, np.int64).reshape(-1, 3)
                bits = [pa.array([int(np.bitwise_count(x).sum()) for x in v], pa.int64()) for v in (more, less)]
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * 8, pa.int32()), pa.array(np.concatenate(v).view(np.int64))) for v in (more, less)]
                yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], *(pa.array(n[:, j]) for j in range(3)), *lists, *bits], names=["a", "b", "na", "nb", "both", "more", "less", "pm", "pl"])

    joined = pairs.join(sized(texts.toDF("b", "t")), "b").join(sized(texts.toDF("a", "s")), "a").select("a", "b", "s", "t")
    out = cut(joined.mapInArrow(run, "a long, b long, na long, nb long, both long, more array<long>, less array<long>, pm long, pl long"))
    discard(texts, who)
    release(pairs.sparkSession)
    return out


STAR = ["ref", "n", "nh", "both", "more", "less", "pm", "pl"]  # what is known of a document against a centre ref of nh elements


def stars_of(near: DataFrame) -> DataFrame:
    """id and STAR of the members of compared pairs, centres too; each in one star."""
    none = F.array(*[F.lit(0).cast("long")] * 8)
    zero = F.lit(0).cast("long")
    away = near.select(F.col("b").alias("id"), F.col("a").alias("ref"), F.col("nb").alias("n"), F.col("na").alias("nh"), "both", "more", "less", "pm", "pl")
    centre = near.select(F.col("a").alias("id"), F.col("a").alias("ref"), F.col("na").alias("n"), F.col("na").alias("nh"), F.col("na").alias("both"), none.alias("more"), none.alias("less"), zero.alias("pm"), zero.alias("pl"))
    return cut(away.union(centre).groupBy("id").agg(F.min(F.struct(*STAR)).alias("r")).select("id", "r.*"))


def most_shared(x: str, y: str) -> Column:
    """The most that two members of a star (rows with the same ref) can share, by what is known of each against its centre.

    Each bit that x's bitmap of missing elements sets and y's doesn't stands for an element of the centre that x has not and y has: so they share at most
    what the centre holds less what y misses and those bits. Likewise of what they have beyond the centre. The bound loses no pair.
    """
    c = lambda p, name: F.col(f"{p}.{name}")
    bits = lambda name: sum((F.bit_count(F.get(c(x, name), F.lit(i)).bitwiseAND(F.get(c(y, name), F.lit(i)))) for i in range(8)), F.lit(0))
    within = c(x, "nh") + bits("less") - F.greatest(c(y, "nh") - c(y, "both") + c(x, "pl"), c(x, "nh") - c(x, "both") + c(y, "pl"))
    return within + bits("more") + F.least(c(x, "n") - c(x, "both") - c(x, "pm"), c(y, "n") - c(y, "both") - c(y, "pm"))


def may_link(x: str, y: str, percent: int) -> Column:
    """False where both are known against the same centre and can't share enough."""
    fits = (100 + percent) * most_shared(x, y) >= percent * (F.col(f"{x}.n") + F.col(f"{y}.n"))
    return F.coalesce(F.when(F.col(f"{x}.ref") == F.col(f"{y}.ref"), fits), F.lit(True))


def prefixes(reps: DataFrame, prefix: int) -> DataFrame:
    """id, n, m1, m2, m3, keys: each document's postings of its prefix, those that another document has, too.

    Postings that no other document has order first and lead nowhere: of m others, m - (24 - prefix) are left in the prefix.
    """
    posts = reps.select("id", F.explode("posts").alias("key"))
    often = posts.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1")
    own = posts.join(often, "key").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("l"))
    own = own.withColumn("left", F.size("l") - (COORDINATES - prefix)).filter("left > 0")
    return cut(own.select("id", F.slice("l", F.lit(1), F.col("left"))["key"].alias("keys")).join(reps.select("id", "n", *BYTES), "id"))


def linked(near: DataFrame, percent: int) -> DataFrame:
    return near.filter(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def with_components(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds comp to rows of id: its component, itself if it has no link."""
    return df.join(labels.select(F.col("node").alias("id"), "label"), "id", "left").withColumn("comp", F.coalesce("label", "id")).drop("label")


def pivot_pairs(stars: DataFrame, labels: DataFrame, percent: int, seed: int) -> DataFrame:
    """Pairs of a star's member that is not in the star's largest component and a member that is: the likeliest few of PIVOTS by the bound."""
    own = with_components(stars, labels)
    size = own.groupBy("ref", "comp").agg(F.count("*").alias("c")).groupBy("ref").agg(F.max(F.struct("c", "comp"))["comp"].alias("major"), F.count("*").alias("comps")).filter("comps > 1").select("ref", "major")
    own = cut(own.join(size, "ref"))
    fields = ["id", *STAR[1:]]
    pivots = own.filter("comp = major").groupBy("ref", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(PIVOTS)).alias("slot")).agg(F.min(F.struct(*fields)).alias("p")).select("ref", "p.*")
    most = most_shared("x", "y")
    tried = own.filter("comp <> major").alias("x").join(pivots.alias("y"), "ref").filter((100 + percent) * most >= percent * (F.col("x.n") + F.col("y.n")))
    best = tried.select(F.col("x.id").alias("x"), F.struct((most / (F.col("x.n") + F.col("y.n"))).alias("score"), F.col("y.id").alias("y")).alias("s"))
    best = best.groupBy("x").agg(F.slice(F.sort_array(F.collect_list("s"), asc=False), 1, 4).alias("s")).select("x", F.explode("s.y").alias("y"))
    out = cut(best.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    discard(own)
    return out


def judged(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, heavy: int = HEAVY) -> DataFrame:
    """Per row: doc (its id), own (a hash of its text), n_shingles, component_id, kept.

    A document's set holds its distinct shingles of `words` words (A-Z folded); with fewer words, the whole sequence; without words, or null, nothing:
    such a document is linked with none. Documents are linked if 100 * intersection >= percent * union of their full sets, and a
    component is named after its smallest id; kept tells whether the row has that id. Rows that repeat an id are documents of their own.
    Rows of null id stand for no node: their component is null.

    Documents of equal sets form a class, of which one row goes on as a node: nodes are row numbers, so that ids need not tell texts apart. A signature has
    24 coordinates of two minima each; each (coordinate, value) is a posting. Documents that share an inverted list collide in its
    coordinate. Two documents of similarity 0.8 collide in 15 coordinates on average and, but for one pair in a million at most, in 4 or more: the match
    threshold. Documents order their postings by global frequency, rarest first; those that collide in 4 of 24 share one of the first 21
    of both (prefix), so that the longest lists are skipped and never merged. For each pair that a prefix list proposes, the collisions in all coordinates,
    those of skipped lists too, are counted on a byte of each value; pairs of the threshold are retained, if sizes allow the similarity, and
    confirmed on full sets. So that a group of m copies costs about m pairs, each list is first read as a star about its smallest node:
    members that reach the threshold with it are compared to it, which ties most of a group together and bounds what any two members can share (most_shared). Members that
    are left out are then compared to the likeliest of a few members inside. Only then are lists read in full, for pairs of
    different components that the bound does not rule out: edits that two copies don't share rule them out. No list is cut. heavy: comparisons from which
    a list's members are first compared to one of its largest component, too, so that the bound rules out more; it changes the work, not the result.
    """
    spark = docs.sparkSession
    by_bytes(spark)
    j = percent / 100
    need = needed(COORDINATES, j * j)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("own"), F.col(text_col).alias("text"))
    p = cut(profiles(rows, words).withColumn("row", F.monotonically_increasing_id()))
    rep = F.struct("doc", "row", "own", "posts", *BYTES)
    reps = p.filter("n > 0 AND doc IS NOT NULL").groupBy("set_a", "set_b", "n").agg(F.min(rep).alias("r"), F.count("*").alias("members"))
    reps = cut(reps.select("set_a", "set_b", "n", "members", F.col("r.row").alias("id"), *[f"r.{c}" for c in ("doc", "own", "posts", *BYTES)]))
    names = reps.select("id", "doc", "own")
    release(spark)
    lists = prefixes(reps, COORDINATES - need + 1)
    release(spark)

    # stars about each list's smallest node
    posted = lists.select(F.explode("keys").alias("key"), "id", "n", *BYTES)
    hubs = posted.groupBy("key").agg(F.min(F.struct("id", "n", *BYTES)).alias("h"), F.count("*").alias("c")).filter("c > 1").select("key", "h.*")
    around = posted.alias("x").join(hubs.alias("y"), "key").filter((F.col("x.id") != F.col("y.id")) & alike("x", "y", min(65, percent), need))
    pairs = cut(around.select(F.col("y.id").alias("a"), F.col("x.id").alias("b")).distinct())
    release(spark)
    near = compared(pairs, rows, names, words, many=True)
    discard(pairs)
    labels = components(linked(near, percent))
    stars = stars_of(near)
    discard(near)

    def also(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        found = compared(pairs, rows, names, words)
        out = merged(labels, linked(found, percent))
        discard(found, pairs, labels)
        return out

    for seed in range(STARS):
        pairs = pivot_pairs(stars, labels, percent, seed)
        if not pairs.limit(1).count():
            discard(pairs)
            break
        labels = also(pairs, labels)

    # what is left: members of a list in different components
    known = with_components(lists, labels).select(F.explode("keys").alias("key"), "id", "n", *BYTES, "comp")
    apart = known.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
    inside = lists.join(labels.select(F.col("node").alias("id"), F.col("label").alias("comp")), "id").select(F.explode("keys").alias("key"), "comp")
    major = inside.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "comp"))["comp"].alias("major"))
    still = cut(known.join(apart.join(major, "key", "left"), "key"))
    discard(lists)
    release(spark)
    outside = F.coalesce(F.col("comp") != F.col("major"), F.lit(True))
    # members of long lists: what they differ in from the smallest node of the list's largest component
    long = still.filter("major IS NOT NULL").groupBy("key", "major").agg(F.count("*").alias("c"), F.sum(outside.cast("int")).alias("o")).filter(F.col("c") * F.col("o") >= heavy).select("key")
    often = still.join(long, "key", "left_semi").filter("id <> major").groupBy("id", "major").agg(F.count("*").alias("c")).groupBy("id").agg(F.max(F.struct("c", "major"))["major"].alias("a"))
    pairs = cut(often.select("a", F.col("id").alias("b")))
    if pairs.limit(1).count():
        near = compared(pairs, rows, names, words)
        better = stars_of(near)
        joined = stars.join(better, "id", "left_anti").unionByName(better)
        stars, old = cut(joined), stars
        discard(near, better, old)
    discard(pairs)
    full = still.join(stars.drop("n"), "id", "left")
    once = F.coalesce(F.col("y.comp") == F.col("y.major"), F.lit(False)) | (F.col("x.id") < F.col("y.id"))
    rest = full.filter(outside).alias("x").join(full.alias("y"), "key").filter(once & (F.col("x.comp") != F.col("y.comp")) & alike("x", "y", percent, need) & may_link("x", "y", percent))
    pairs = cut(rest.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct())
    discard(still, stars)
    release(spark)
    if pairs.limit(1).count():
        labels = also(pairs, labels)

    classes = reps.select("set_a", "set_b", "n", "members", "doc", F.col("id").alias("rep"))
    classes = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    # a component is named after the smallest document of its classes
    least = classes.filter("label IS NOT NULL").groupBy("label").agg(F.min("doc").alias("component"))
    classes = classes.join(least, "label", "left").withColumn("component", F.coalesce("component", "doc"))
    # Single documents that no link moves need no row here.
    classes = cut(classes.filter("members > 1 OR component <> doc").select("set_a", "set_b", "n", "component"))
    discard(labels, reps)
    out = p.select("doc", "own", "n", "set_a", "set_b").join(classes, ["set_a", "set_b", "n"], "left")
    component = F.when((F.col("n") > 0) & F.col("doc").isNotNull(), F.coalesce("component", "doc")).otherwise(F.col("doc"))
    return out.select("doc", "own", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc"), F.lit(False)).alias("kept"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = THRESHOLD, heavy: int = HEAVY) -> DataFrame:
    """Per row: id, n_shingles, component_id, kept: see judged()."""
    return judged(docs, id_col, text_col, words, percent, heavy).select(F.col("doc").alias(id_col), "n_shingles", "component_id", "kept")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, of which the smallest id of each component stays. Rows that repeat both that id and its text stay. Rows of null id stay."""
    inner = [f"c{i}" for i in range(len(docs.columns))]  # so that no column clashes
    rows, id_, text = docs.toDF(*inner), F.col(inner[docs.columns.index(id_col)]), F.col(inner[docs.columns.index(text_col)])
    gone = judged(docs, id_col, text_col, words, percent).filter("NOT kept AND doc IS NOT NULL").select("doc", "own").distinct()
    return rows.join(gone, (id_.cast("long") == F.col("doc")) & (F.xxhash64(text) == F.col("own")), "left_anti").toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s FROM w),
c AS MATERIALIZED (SELECT row_number() OVER () AS c, list_sort(s) AS s, len(s) AS n, min(doc_id) AS rep FROM s WHERE len(s) > 0 GROUP BY list_sort(s), len(s)),
u AS MATERIALIZED (SELECT rep, n, unnest(s) AS sh FROM c),
p AS MATERIALIZED (SELECT a.rep AS a, b.rep AS b FROM u a JOIN u b ON a.sh = b.sh AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS MATERIALIZED (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT rep AS node, rep AS seen FROM c UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
l AS (SELECT node, min(seen) AS label FROM r GROUP BY node)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(l.label, s.doc_id) AS component_id, coalesce(l.label, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON len(s.s) > 0 AND c.s = list_sort(s.s) LEFT JOIN l ON l.node = c.rep
"""
