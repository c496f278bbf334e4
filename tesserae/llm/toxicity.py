"""Toxicity scores from an induced lexicon.

Words are runs of letters, in lower case.  Labelled documents name the seed
terms, toxic and clean.  The graph joins every seed with every word that stands
near it, whatever their frequency, weighted by positive pointwise mutual
information over all documents.  Random walks with restart from the toxic and
from the clean seeds, alternating between seeds and words, give each word a
polarity, and the polarities score documents.  Counts, edges, walks and scores
cover all documents and are Spark aggregations; only the labels learned from are
a bounded sample, and only figures of the seeds, which that sample bounds, come to
the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import terms
from . import textops as T
from .langid import _Letters
from .sparkops import cut, held_out

_LOW = np.uint64(terms.ROWS - 1)


def _letters(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = _Letters(data, off)
    return w.hash & ~_LOW, w.first


#: Stands in place of a seed for the documents in which a word is near any marked seed.
_ANY = -2


def _near_seeds(h: np.ndarray, first: np.ndarray, seeds: np.ndarray, window: int, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, seed, documents): the words at most `window` places from a seed in one row, and in how many rows; a seed isn't its own neighbour.

    For seed `_ANY`, the rows in which the word is that near to any of the `marked` seeds.
    """
    at, found = T.lookup(seeds, h)
    place = np.flatnonzero(found)
    row = T.row_of(first)
    words, which, rows = [], [], []
    for k in [*range(-window, 0), *range(1, window + 1)]:
        p = place[(place + k >= 0) & (place + k < len(h))]
        p = p[(row[p + k] == row[p]) & (h[p + k] != h[p])]
        words.append(h[p + k])
        which.append(at[p])
        rows.append(row[p])
    w, s, r = np.concatenate(words), np.concatenate(which), np.concatenate(rows)
    c = w | r.astype(np.uint64)
    order = np.lexsort((s, c))
    c, s = c[order], s[order]
    new = np.flatnonzero(np.append(True, (c[1:] != c[:-1]) | (s[1:] != s[:-1]))) if len(c) else np.zeros(0, np.int64)
    c, s = c[new], s[new]
    some = np.unique(c[marked[s]])
    c, s = np.append(c, some), np.append(s, np.full(len(some), _ANY))
    return _added(c & ~_LOW, s, np.ones(len(c), np.int64))


def _added(word: np.ndarray, seed: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of `n` over equal pairs."""
    if not len(word):
        return word, seed, n
    order = np.lexsort((seed, word))
    word, seed = word[order], seed[order]
    new = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (seed[1:] != seed[:-1])))
    return word[new], seed[new], np.add.reduceat(n[order], new)


def seed_graph(docs: DataFrame, seeds: np.ndarray, window: int = 5, least_docs: int = 1, marked: np.ndarray | None = None) -> DataFrame:
    """Edges (word, seed, n, df, near, weight) of `docs(text)`: seed is a place in the sorted keys `seeds`, n the documents that have both within `window` words, df those that have the word, near those that have it within `window` words of any `marked` seed (a flag for each seed), weight the pair's positive PMI.

    Every pair of a seed and a word near it has an edge, if its PMI is over
    zero; with `least_docs` over 1, only pairs with n as large.
    """
    shared = docs.sparkSession.sparkContext.broadcast((seeds, np.zeros(len(seeds), bool) if marked is None else marked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single, pairs, held = terms.Counter(), [], 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal held
            keys, counts = single.taken()
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), -1, np.int32)), pa.array(counts.astype(np.int64))], ["word", "seed", "n"])
            if pairs:
                word, seed, n = _added(*(np.concatenate([p[i] for p in pairs]) for i in range(3)))
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(seed.astype(np.int32)), pa.array(n)], ["word", "seed", "n"])
            pairs.clear()
            held = 0

        for batch in batches:
            data, off = T.column(batch.column("text"))
            for _, _, d, o in T.slices(data, off, 1_000_000, terms.ROWS):
                h, first = _letters(d, o)
                single.add(*terms.key_counts(terms.distinct_in_rows(h, first)))
                pairs.append(_near_seeds(h, first, shared.value[0], window, shared.value[1]))
                held += len(pairs[-1][0])
                if held + sum(single.size) > terms._HELD:
                    yield from out()
        yield from out()

    counted = docs.select("text").mapInArrow(run, "word long, seed int, n long").groupBy("word", "seed").agg(F.sum("n").alias("n"))
    of = lambda seed: F.max(F.when(F.col("seed") == seed, F.col("n"))).over(Window.partitionBy("word"))
    counted = cut(counted.withColumns({"df": of(-1), "near": F.coalesce(of(_ANY), F.lit(0))}).where((F.col("seed") >= 0) & (F.col("n") >= least_docs) | F.col("word").isin(seeds.view(np.int64).tolist())))
    own = np.zeros(len(seeds))
    for r in counted.where("seed = -1").select("word", "df").collect():
        own[np.searchsorted(seeds, np.array([r["word"]]).view(np.uint64)[0])] = r["df"]
    sizes = docs.sparkSession.createDataFrame([(i, float(x)) for i, x in enumerate(own)], "seed int, seed_df double")
    pmi = F.log(F.col("n") * F.lit(float(docs.count())) / (F.col("df") * F.col("seed_df")))
    return counted.where((F.col("seed") >= 0) & (F.col("n") >= least_docs)).join(F.broadcast(sizes), "seed").select("word", "seed", "n", "df", "near", pmi.alias("weight")).where("weight > 0")


def walk(edges: DataFrame, starts: np.ndarray, restart: float = 0.5, steps: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Seeds' visit probabilities (starts x seeds) of random walks with restart from each row of `starts`, and each seed's sum of weights.

    A walk goes from a seed to a word and back to a seed of that word, by the
    weights of `edges(word, seed, weight)`, which lie by word in their parts; only
    sums for the seeds leave a part.  A seed without an edge stays where it is.
    """
    size = starts.shape[1]
    out = np.zeros(size)
    for r in edges.groupBy("seed").agg(F.sum("weight").alias("w")).collect():
        out[r["seed"]] = r["w"]
    x = starts.copy()
    if not out.any():
        return x, out
    for _ in range(steps):
        now = np.where(out > 0, x / np.maximum(out, 1e-300), 0.0)

        def step(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            got = [b for b in batches if b.num_rows]
            if not got:
                return
            t = pa.Table.from_batches(got)
            _, word = np.unique(t.column("word").to_numpy(), return_inverse=True)
            seed, weight = t.column("seed").to_numpy(), t.column("weight").to_numpy()
            total = np.bincount(word, weights=weight)
            moved = np.zeros_like(now)
            for k in range(len(now)):
                at = np.bincount(word, weights=now[k, seed] * weight) / total
                moved[k] = np.bincount(seed, weights=at[word] * weight, minlength=now.shape[1])
            k, s = np.nonzero(moved)
            yield pa.RecordBatch.from_arrays([pa.array((k * now.shape[1] + s).astype(np.int64)), pa.array(moved[k, s])], ["at", "x"])

        moved = np.zeros(x.size)
        for r in edges.select("word", "seed", "weight").mapInArrow(step, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
            moved[r["at"]] = r["x"]
        x = (1 - restart) * (moved.reshape(x.shape) + np.where(out > 0, 0.0, x)) + restart * starts
    return x, out


def _labelled(docs: DataFrame, labels: DataFrame, most_labels: int) -> dict:
    """{doc_id: toxic} of at most `most_labels` labelled rows that aren't held out, chosen by a hash of the id."""
    rows = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    return {r["doc_id"]: r["toxic"] for r in rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels).collect()}


def upper_tail(k: int, n: int, p: float) -> float:
    """Probability of k or more hits in n trials of probability p."""
    i = np.arange(k, n + 1)
    logs = [math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) for x in i.tolist()]
    return float(np.exp(np.array(logs) + i * math.log(max(p, 1e-12)) + (n - i) * math.log(max(1 - p, 1e-12))).sum())


def _by_label(docs: DataFrame, known: dict) -> DataFrame:
    """(word, toxic, clean): in how many of the labelled documents of each kind a word occurs."""
    spark = docs.sparkSession
    ids = spark.createDataFrame(list(known.items()), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, toxic int")
    some = docs.join(F.broadcast(ids), "doc_id").select("text", "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = terms.Counter(), terms.Counter()

        def out() -> Iterator[pa.RecordBatch]:
            for v in (0, 1):
                keys, counts = found[v].taken()
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts * v, pa.int64()), pa.array(counts * (1 - v), pa.int64())], ["word", "toxic", "clean"])

        for batch in batches:
            y = batch.column("toxic").to_numpy()
            for v in (0, 1):
                data, off = T.column(batch.filter(pa.array(y == v)).column("text"))
                for _, _, d, o in T.slices(data, off, 1_000_000, terms.ROWS):
                    found[v].add(*terms.key_counts(terms.distinct_in_rows(*_letters(d, o))))
            if sum(map(sum, (f.size for f in found))) > terms._HELD:
                yield from out()
        yield from out()

    return some.mapInArrow(run, "word long, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def seeds_of(docs: DataFrame, known: dict, least_seed: int = 3, false_seeds: float = 1.0, clean_ratio: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted seed keys, whether each is toxic, and the share of toxic documents among its labelled ones.

    Toxic seeds: words in `least_seed` toxic documents of the sample, and in so
    many of them that by chance `false_seeds` of all words in as many labelled
    documents would be.  Clean
    seeds: words in no more toxic documents than chance gives, for each toxic
    seed about `clean_ratio` in as many labelled documents, chosen by a hash.
    """
    counted = cut(_by_label(docs, known).withColumn("both", F.col("toxic") + F.col("clean")))
    n = docs.join(F.broadcast(docs.sparkSession.createDataFrame(list(known.items()), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y int")), "doc_id").agg(F.sum("y").alias("toxic"), F.count("*").alias("both")).first()
    share = (n["toxic"] or 0) / max(1, n["both"])
    words = counted.where(F.col("both") >= least_seed).count()
    maybe = counted.where((F.col("toxic") >= least_seed) & (F.col("toxic") > 2 * share * F.col("both"))).collect()
    toxic = [r for r in maybe if upper_tail(r["toxic"], r["both"], share) * words < false_seeds]
    if not toxic:
        return np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0)
    level = lambda c: F.round(F.log2(c)).cast("int")
    wanted: dict[int, int] = {}
    for r in toxic:
        k = int(math.floor(math.log2(r["both"]) + 0.5))
        wanted[k] = wanted.get(k, 0) + clean_ratio
    quiet = counted.where((F.col("both") >= least_seed) & (F.col("toxic") <= share * F.col("both"))).withColumn("level", level(F.col("both")))
    there = {r["level"]: r["count"] for r in quiet.groupBy("level").count().collect()}
    rate = F.lit(0.0)
    for k, m in wanted.items():
        rate = F.when(F.col("level") == k, F.lit(m / max(1, there.get(k, 0)))).otherwise(rate)
    clean = quiet.where(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < rate * (1 << 30)).collect()
    keys = np.array([r["word"] for r in [*toxic, *clean]], np.int64).view(np.uint64)
    sure = np.array([(r["toxic"] + 0.5) / (r["both"] + 1.0) for r in [*toxic, *clean]])
    order = np.argsort(keys)
    return keys[order], (np.arange(len(keys)) < len(toxic))[order], sure[order]


def induce(docs: DataFrame, labels: DataFrame, window: int = 5, most_labels: int = 20_000, least_seed: int = 3, false_seeds: float = 1.0, least_docs: int = 1) -> tuple[DataFrame | None, dict]:
    """The lexicon (word, polarity over 0 to 1) of `docs(doc_id, text)` from `labels(doc_id, toxic)`, and the labels learned from.

    A word's polarity is the balance of the two walks' visits, toxic less clean
    over both, times the share of the word's documents in which it stands near a
    toxic seed, where one document more counts as one in which it doesn't, so that
    a word of few documents is less sure; a toxic seed has at least the polarity of
    its own labels.
    Words that lean to the clean side have none.  Without toxic seeds there is no lexicon.
    """
    known = _labelled(docs, labels, most_labels)
    if not any(known.values()):
        return None, known
    seeds, toxic, sure = seeds_of(docs, known, least_seed, false_seeds)
    if not toxic.any():
        return None, known
    edges = cut(seed_graph(docs, seeds, window, least_docs, toxic).repartition("word"))
    starts = np.stack([toxic / toxic.sum(), ~toxic / max(1, (~toxic).sum())])
    x, out = walk(edges, starts)
    # A walk's visits are compared with the other's on the scale of one seed's restart.
    x = np.where(out > 0, x / np.maximum(out, 1e-300), 0.0) * np.array([toxic.sum(), (~toxic).sum()])[:, None]
    spark = docs.sparkSession
    each = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x[0], x[1]))], "seed int, up double, down double")
    met = edges.join(F.broadcast(each), "seed").groupBy("word").agg(F.sum(F.col("up") * F.col("weight")).alias("up"), F.sum(F.col("down") * F.col("weight")).alias("down"), F.first("near").alias("near"), F.first("df").alias("df"))
    polarity = (F.col("up") - F.col("down")) / (F.col("up") + F.col("down")) * F.col("near") / (F.col("df") + 1)
    own = spark.createDataFrame([(int(k), float(2 * s - 1)) for k, s in zip(seeds.view(np.int64)[toxic], sure[toxic])], "word long, polarity double")
    lexicon = met.select("word", polarity.alias("polarity")).unionByName(own).groupBy("word").agg(F.max("polarity").alias("polarity")).where("polarity > 0")
    return cut(lexicon), known


FEATURES = ("top", "mass")


#: Words of the lexicon that are broadcast at once: 64 MB.
_PIECE = 1 << 22


def _pieces(lexicon: DataFrame | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """The lexicon as sorted keys and polarities, in pieces of about `_PIECE` words."""
    if lexicon is None:
        return []
    many = lexicon.count() // _PIECE + 1
    out = []
    for k in range(many):
        got = lexicon.where(F.pmod(F.xxhash64("word"), F.lit(many)) == k).toArrow()
        keys = got.column("word").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        out.append((keys[order], got.column("polarity").to_numpy()[order]))
    return out


def measure(docs: DataFrame, lexicon: DataFrame | None) -> DataFrame:
    """(doc_id, top, mass) of `docs(doc_id, text)`: the greatest polarity (0 without one) and log1p of the sum of the polarities over 0.5."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = [docs.sparkSession.sparkContext.broadcast(p) for p in _pieces(lexicon)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = T.column(batch.column("text"))
            out: list[list[np.ndarray]] = [[], []]
            for _, _, d, o in T.slices(data, off, 1_000_000, terms.ROWS):
                h, first = _letters(d, o)
                p = np.zeros(len(h))
                for piece in shared:
                    keys, polarity = piece.value
                    at, found = T.lookup(keys, h)
                    p[found] = polarity[at[found]]
                top = np.zeros(len(o) - 1)
                np.maximum.at(top, T.row_of(first), p)
                out[0].append(top)
                out[1].append(np.log1p(T.sums(np.where(p > 0.5, p, 0.0), first, np.float64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(np.concatenate(x) if x else np.zeros(0)) for x in out]], ["doc_id", *FEATURES])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, top double, mass double")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Weights (last: intercept) of ridge logistic regression by Newton steps; classes weigh as they come."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.clip(np.linalg.solve(h, g), -5, 5)
    return w


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, **how) -> DataFrame:
    """For every row: doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold).

    Labels of held-out rows, and lang, source and doc_id, play no part in a
    score.  Null and empty texts score as texts without lexicon words; without
    labels every score is 0.  Repeated rows score alike; a document labelled
    twice counts as toxic if either label says so; an empty table gives an empty
    result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    lexicon, known = induce(rows, labels, **how)
    measured = cut(measure(rows, lexicon))
    spark = docs.sparkSession
    w = None
    if any(known.values()):
        ids = spark.createDataFrame([(i, v) for i, v in known.items()], f"doc_id {labels.schema['doc_id'].dataType.simpleString()}, y int")
        sample = measured.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y", *FEATURES).count().select("y", *FEATURES).toArrow()
        y = sample.column("y").to_numpy().astype(np.float64)
        if 0 < y.sum() < len(y):
            w = logistic(np.column_stack([sample.column(f).to_numpy() for f in FEATURES]), y)
    value = F.lit(0.0)
    if w is not None:
        z = F.lit(float(w[-1]))
        for f, x in zip(FEATURES, w):
            z = z + F.col(f) * F.lit(float(x))
        value = 1 / (1 + F.exp(-z))
    return measured.select("doc_id", held_out().alias("held_out"), value.alias("score"), (value >= threshold).cast("int").alias("predicted"))
