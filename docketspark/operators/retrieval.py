"""Search: postings and BM25, exact nearest neighbours in blocks, fusion, re-ranking, metrics."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketspark.functions.text import stem, terms
from docketspark.session import cut, shuffle_parallelism, spread


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """term, id, tf and the length of the text in terms; terms are stemmed."""
    t = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), terms(F.col(text_col)).alias("ts"))
    each = t.select("id", F.size("ts").alias("len"), F.explode("ts").alias("w"))
    return each.groupBy(stem(F.col("w")).alias("term"), "id").agg(F.count("*").alias("tf"), F.first("len").alias("len"))


def token_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """w, id, tf and the length of the text in tokens, written once: everything a search asks of the texts is read from it."""
    t = spread(docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).select("id", terms(F.col("text")).alias("ts"))
    each = t.select("id", F.size("ts").alias("len"), F.explode("ts").alias("w"))
    return cut(each.groupBy("w", "id").agg(F.count("*").alias("tf"), F.first("len").alias("len")))


def corpus_size(tokens: DataFrame) -> tuple[int, float]:
    """(texts with tokens, their mean length)."""
    n, mean = tokens.groupBy("id").agg(F.first("len").alias("len")).agg(F.count("*"), F.avg("len")).first()
    return n, mean or 0.0


def query_postings(docs: DataFrame, id_col: str, text_col: str, asked: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """As postings(), for the query terms of ``asked`` (w: tokens): ``stem*`` counts all tokens that start so, the others are equal.

    Prefixes meet the vocabulary, not the texts, by their first characters (a stem has five or more).
    ``tokens`` is what token_counts() gives, if it is there already.
    """
    tokens = token_counts(docs, id_col, text_col) if tokens is None else tokens
    vocabulary = tokens.select("w").distinct()
    terms_ = asked.select(query_term(F.col("w")).alias("term")).distinct()
    starts = terms_.where(F.col("term").endswith("*")).select("term", F.expr("left(term, length(term) - 1)").alias("start"))
    begun = vocabulary.withColumn("five", F.substring("w", 1, 5)).join(starts.withColumn("five", F.substring("start", 1, 5)), "five").where(F.col("w").startswith(F.col("start")))
    same = vocabulary.join(terms_.select("term", F.col("term").alias("w")), "w")
    means = cut(begun.select("w", "term").unionByName(same.select("w", "term")))
    return tokens.join(means, "w").groupBy("term", "id").agg(F.sum("tf").alias("tf"), F.first("len").alias("len"))


def query_term(w: Column) -> Column:
    """``stem*`` for letters-only tokens of 7 and more, else the token; no token holds a '*'."""
    return F.when((F.length(w) >= 7) & w.rlike(r"^\p{L}+$"), F.concat(stem(w), F.lit("*"))).otherwise(w)


def bm25(post: DataFrame, queries: DataFrame, n_docs: int, mean_len: float, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, id, score: sum over the query's distinct terms; ``queries``: query_id, term.

    Document frequencies cover the whole corpus; a term in more than half of it gets the floor 1e-6.
    """
    q = queries.select("query_id", "term").distinct()
    mine = post.join(q.select("term").distinct(), "term", "left_semi")
    return _weighted(mine, n_docs, mean_len, k1, b).join(q, "term").groupBy("query_id", "id").agg(F.sum("s").alias("score"))


def _weighted(mine: DataFrame, n_docs: int, mean_len: float, k1: float, b: float) -> DataFrame:
    """The postings with ``s``, what the term adds to the score of the text."""
    df = mine.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / mean_len))
    return mine.join(df, "term").select("term", "id", part.alias("s"))


def bm25_top(post: DataFrame, queries: DataFrame, n_docs: int, mean_len: float, k: int, digits: int = 6, k1: float = 1.2, b: float = 0.75, row_block: int = 4096, query_block: int = 1024) -> DataFrame:
    """query_id, id, score, rank: the k best of bm25(), scores rounded; for queries as long as texts.

    As in nearest(), blocks of texts meet blocks of queries, so a term that many queries ask for is
    no pair of rows.  Terms travel as numbers.
    """
    q = queries.select("query_id", "term").distinct()
    row_block = max(256, min(row_block, -(-n_docs // (2 * shuffle_parallelism(post.sparkSession)))))  # blocks for every core
    codes = cut(q.select("term").distinct().coalesce(1).select("term", F.monotonically_increasing_id().alias("t")))
    n_queries = q.select("query_id").distinct().count()
    rb, qb = max(1, -(-n_docs // row_block)), max(1, -(-n_queries // query_block))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    rows = _weighted(post.join(codes, "term", "left_semi"), n_docs, mean_len, k1, b).join(codes, "term")
    a = rows.select("t", F.col("id").cast("long").alias("id"), "s", F.pmod(F.xxhash64("id"), F.lit(rb)).alias("rb"), each(qb).alias("qb"))
    w = q.join(codes, "term").select("t", F.col("query_id").cast("long").alias("query_id"), F.pmod(F.xxhash64("query_id"), F.lit(qb)).alias("qb"), each(rb).alias("rb"))

    def pair(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or asks.empty:
            return pd.DataFrame(columns=["query_id", "id", "score"])
        ids, qs, scores = _scores(rows, asks)
        take = min(k, len(ids))
        least = np.partition(scores, len(ids) - take, axis=1)[:, len(ids) - take]
        i, j = np.nonzero((scores > 0) & (scores >= least[:, None] - 2 * 10.0**-digits))  # equal ones are told apart later
        return pd.DataFrame({"query_id": qs[i], "id": ids[j], "score": scores[i, j]})

    found = a.groupBy("rb", "qb").cogroup(w.groupBy("rb", "qb")).applyInPandas(pair, "query_id long, id long, score double")
    return top_k(found.withColumn("score", F.round("score", digits)), k)


def _scores(rows: pd.DataFrame, asks: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, query ids, scores of all pairs): frequent terms by matrix product, the others pair by pair."""
    ids, doc = np.unique(rows["id"].to_numpy(), return_inverse=True)
    qs, ask = np.unique(asks["query_id"].to_numpy(), return_inverse=True)
    terms_, term = np.unique(asks["t"].to_numpy(), return_inverse=True)
    t, s = rows["t"].to_numpy(), rows["s"].to_numpy()
    at = np.minimum(np.searchsorted(terms_, t), len(terms_) - 1)
    mine = terms_[at] == t
    at, doc, s = at[mine], doc[mine], s[mine]
    scores = np.zeros((len(qs), len(ids)))
    n_ask, n_doc = np.bincount(term, minlength=len(terms_)), np.bincount(at, minlength=len(terms_))
    often = n_ask * n_doc * 100 > scores.size
    column = np.cumsum(often) - 1
    for lo in range(0, int(often.sum()), 512):
        hot = often & (column >= lo) & (column < lo + 512)
        left, right = np.zeros((len(qs), 512)), np.zeros((512, len(ids)))
        x, y = hot[term], hot[at]
        left[ask[x], column[term[x]] - lo] = 1
        right[column[at[y]] - lo, doc[y]] = s[y]
        scores += left @ right
    order = np.argsort(term, kind="stable")
    ask, first = ask[order], np.cumsum(n_ask) - n_ask
    y = ~often[at]
    at, doc, s = at[y], doc[y], s[y]
    ends = np.cumsum(n_ask[at])
    flat, lo = scores.ravel(), 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 2_000_000)))
        n = n_ask[at[lo:hi]]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        np.add.at(flat, ask[np.repeat(first[at[lo:hi]], n) + within] * len(ids) + np.repeat(doc[lo:hi], n), np.repeat(s[lo:hi], n))
        lo = hi
    return ids, qs, scores


def top_k(scored: DataFrame, k: int, by: str = "query_id", score: str = "score", tie: str = "id", ascending: bool = False) -> DataFrame:
    """The k best of each query with their rank; the planner keeps k rows a task before it shuffles."""
    w = Window.partitionBy(by).orderBy(F.col(score).asc() if ascending else F.col(score).desc(), tie)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


CELLS = 1 << 22  # distances a task holds at once: 32 MB of doubles


def _blocks(vectors: DataFrame, queries: DataFrame, value: str, row_block: int, query_block: int, n_rows: int | None, n_queries: int | None) -> tuple[DataFrame, DataFrame]:
    """Both sides hashed into blocks of bounded size, each under every block of the other (key, value, rb, qb)."""
    n_rows = vectors.count() if n_rows is None else n_rows
    n_queries = queries.count() if n_queries is None else n_queries
    rb, qb = max(1, -(-n_rows // row_block)), max(1, -(-n_queries // query_block))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    a = vectors.select(F.col("id").cast("long").alias("key"), value, F.pmod(F.xxhash64("id"), F.lit(rb)).alias("rb"), every(qb).alias("qb"))
    q = queries.select(F.col("query_id").cast("long").alias("key"), F.col("v").alias("w"), F.pmod(F.xxhash64("query_id"), F.lit(qb)).alias("qb"), every(rb).alias("rb"))
    return a, q


def _closest(x: np.ndarray, ids: np.ndarray, y: np.ndarray, qs: np.ndarray, k: int) -> pd.DataFrame:
    """query_id, id, distance of the k nearest rows of x to each row of y, and of those tied with the last; a row is not its own."""
    out, norms, step = [], (x * x).sum(1), max(1, CELLS // max(len(x), 1))
    for lo in range(0, len(y), step):
        part = y[lo : lo + step]
        d = np.maximum((part * part).sum(1)[:, None] + norms[None, :] - 2 * part @ x.T, 0)
        d[qs[lo : lo + step, None] == ids[None, :]] = np.inf
        take = min(k, len(ids))
        last = np.partition(d, take - 1, axis=1)[:, take - 1]
        i, j = np.nonzero((d <= last[:, None] + 1e-9) & np.isfinite(d))
        out.append(pd.DataFrame({"query_id": qs[lo + i], "id": ids[j], "distance": np.sqrt(d[i, j])}))
    return pd.concat(out)


_NEAR = "query_id long, id long, distance double"


def nearest(vectors: DataFrame, queries: DataFrame, k: int, dim: int, row_block: int = 16384, query_block: int = 2048, n_rows: int | None = None, n_queries: int | None = None) -> DataFrame:
    """query_id, id, distance: the exact k nearest rows of each query, itself left out.

    Both sides are hashed into blocks of bounded size; each pair of blocks is a few matrix products of bounded
    size that hand on k rows a query, and a partial top-k merges them.  ``vectors``: id, v; ``queries``:
    query_id, v.  Nothing is broadcast, and no pair of rows is ever a row.
    """
    a, q = _blocks(vectors, queries, "v", row_block, query_block, n_rows, n_queries)

    def pair(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or asks.empty:
            return pd.DataFrame(columns=["query_id", "id", "distance"])
        x, y = np.stack(rows["v"].to_numpy()).astype(np.float64), np.stack(asks["w"].to_numpy()).astype(np.float64)
        return _closest(x, rows["key"].to_numpy(), y, asks["key"].to_numpy(), k)

    found = a.groupBy("rb", "qb").cogroup(q.groupBy("rb", "qb")).applyInPandas(pair, _NEAR)
    return top_k(found.withColumn("distance", F.round("distance", 9)), k, score="distance", ascending=True)


def fit_scales(vectors: DataFrame, sample: int = 20000, seed: int = 7) -> np.ndarray:
    """Greatest absolute value of each dimension in a bounded sample (``sample`` rows, the smallest by a hash of the id)."""
    rows = vectors.orderBy(F.xxhash64(F.col("id"), F.lit(seed)), "id").limit(sample).select("v").toPandas()
    return np.maximum(np.abs(np.stack(rows["v"].to_numpy())).max(0), 1e-12)


def encode_vectors(vectors: DataFrame, scales: np.ndarray) -> DataFrame:
    """(id, code): the index - every row as one byte a dimension, a quarter of its floats."""

    def run(it: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy())
                codes = np.clip(np.rint(x / scales * 127), -127, 127).astype(np.int8)
                yield pd.DataFrame({"id": pdf["id"], "code": [c.tobytes() for c in codes]})

    return vectors.select("id", "v").mapInPandas(run, f"id {vectors.schema['id'].dataType.simpleString()}, code binary")


def nearest_encoded(index: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, scales: np.ndarray, more: int = 4, row_block: int = 65536, query_block: int = 2048) -> DataFrame:
    """As nearest(), with distances from the codes of encode_vectors() first and exact ones for the ``more`` * k best.

    The scan reads the codes of all rows and the vectors of the candidates only.  It suits vectors without
    clusters, where lists of centroids leave out too much; recall is measured in the tests.
    """
    a, q = _blocks(index, queries, "code", row_block, query_block, None, None)

    def pair(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or asks.empty:
            return pd.DataFrame(columns=["query_id", "id", "distance"])
        x = np.frombuffer(b"".join(rows["code"]), dtype=np.int8).reshape(len(rows), -1) * (scales / 127).astype(np.float32)
        return _closest(x, rows["key"].to_numpy(), np.stack(asks["w"].to_numpy()).astype(np.float32), asks["key"].to_numpy(), more * k)

    rough = a.groupBy("rb", "qb").cogroup(q.groupBy("rb", "qb")).applyInPandas(pair, _NEAR)
    best = top_k(rough, more * k, score="distance", ascending=True).select("query_id", "id")
    both = best.join(vectors.select(F.col("id").cast("long").alias("id"), "v"), "id").join(queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("v").alias("w")), "query_id")
    gap = F.zip_with("v", "w", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    exact = both.select("query_id", "id", F.round(F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x)), 9).alias("distance"))
    return top_k(exact, k, score="distance", ascending=True)


class Resident:
    """Vectors of bounded number held by one process, for single queries without a job: more than ``most`` rows are refused."""

    def __init__(self, vectors: DataFrame, most: int = 1_000_000):
        rows = vectors.select("id", "v").limit(most + 1).toArrow()
        if rows.num_rows > most:
            raise ValueError(f"more than {most} vectors")
        self.ids = rows["id"].to_numpy()
        flat = rows["v"].combine_chunks()
        self.x = flat.flatten().to_numpy().astype(np.float32).reshape(len(self.ids), -1) if len(self.ids) else np.zeros((0, 0), np.float32)
        self.norms = (self.x * self.x).sum(1)

    def nearest(self, v: np.ndarray, k: int) -> list[tuple[int, float]]:
        """(id, distance) of the k nearest rows, ties to the smaller id."""
        if not len(self.ids):
            return []
        v = np.asarray(v, dtype=np.float32)
        d = self.norms - 2 * (self.x @ v)
        take = min(k, len(d))
        near = np.flatnonzero(d <= np.partition(d, take - 1)[take - 1])
        exact = np.sqrt(((self.x[near].astype(np.float64) - v) ** 2).sum(1))
        return [(int(self.ids[near[i]]), float(exact[i])) for i in np.lexsort((self.ids[near], np.round(exact, 9)))[:take]]


def fit_centroids(vectors: DataFrame, n_lists: int | None = None, sample: int = 20000, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """k-means centroids from a bounded sample (``sample`` rows, the smallest by a hash of the id).

    The number of lists is the root of the number of rows unless given; for vectors with clusters.
    """
    n_lists = n_lists or max(1, int(vectors.count() ** 0.5))
    rows = vectors.orderBy(F.xxhash64(F.col("id"), F.lit(seed)), "id").limit(sample).select("v").toPandas()
    x = np.stack(rows["v"].to_numpy()).astype(np.float64)
    c = x[np.random.default_rng(seed).permutation(len(x))[:n_lists]].copy()
    for _ in range(rounds):
        near = ((x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T).argmin(1)
        for j in range(len(c)):
            if (near == j).any():
                c[j] = x[near == j].mean(0)
    return c


def assign_lists(vectors: DataFrame, centroids: np.ndarray, probes: int, name: str) -> DataFrame:
    """Rows with the ``probes`` nearest lists, one row each, in column ``list``; every row is indexed."""
    key = vectors.columns[0]

    def run(it: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
                d = (centroids * centroids).sum(1)[None] - 2 * x @ centroids.T
                lists = np.argsort(d, axis=1)[:, :probes]
                yield pdf.loc[pdf.index.repeat(probes)].assign(list=lists.ravel())

    kind = vectors.schema[key].dataType.simpleString()
    return vectors.mapInPandas(run, f"{key} {kind}, v array<float>, list long").withColumnRenamed(key, name)


def nearest_indexed(vectors: DataFrame, queries: DataFrame, k: int, centroids: np.ndarray, probes: int, salt: int = 4) -> DataFrame:
    """As nearest(), looking only into the lists nearest to each query.

    A list that holds a third of all rows is split by ``salt``, and the queries go to each part.
    """
    a = assign_lists(vectors, centroids, 1, "id").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(salt)))
    q = assign_lists(queries, centroids, probes, "query_id").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salt - 1).cast("long"))))

    def pair(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or asks.empty:
            return pd.DataFrame(columns=["query_id", "id", "distance"])
        x, y = np.stack(rows["v"].to_numpy()).astype(np.float64), np.stack(asks["v"].to_numpy()).astype(np.float64)
        d = np.sqrt(np.maximum((y * y).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * y @ x.T, 0))
        ids, qs = rows["id"].to_numpy(), asks["query_id"].to_numpy()
        d[qs[:, None] == ids[None, :]] = np.inf
        take = min(k, len(ids))
        best = np.argsort(d, axis=1)[:, :take]
        out = pd.DataFrame({"query_id": np.repeat(qs, take), "id": ids[best].ravel(), "distance": np.take_along_axis(d, best, 1).ravel()})
        return out[np.isfinite(out["distance"])]

    found = a.groupBy("list", "part").cogroup(q.groupBy("list", "part")).applyInPandas(pair, "query_id long, id long, distance double")
    return top_k(found.dropDuplicates(["query_id", "id"]).withColumn("distance", F.round("distance", 9)), k, score="distance", ascending=True)


def fuse(ranked: DataFrame, k: int = 60, by: str = "query_id") -> DataFrame:
    """Reciprocal rank fusion of lists (query_id, id, rank): sum of 1 / (k + rank)."""
    return ranked.groupBy(by, "id").agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"))


def min_max(df: DataFrame, by: str, value: str, out: str) -> DataFrame:
    """Value scaled to 0..1 within the group; 1 where all are equal.  Two aggregates and a join, no window."""
    r = df.groupBy(by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scaled = F.when(F.col("_hi") == F.col("_lo"), 1.0).otherwise((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return df.join(r, by).withColumn(out, scaled).drop("_lo", "_hi")


def blend(content: Column, structure: Column, alpha: float = 0.6) -> Column:
    a = min(1.0, max(0.0, alpha))
    return content * a + structure * (1 - a)


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """query_id, ndcg, recall at k.  ``ranked``: query_id, id, rank; ``relevant``: query_id, id."""
    rel = relevant.distinct()
    total = rel.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    got = ranked.where(F.col("rank") <= k).join(rel.withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    gain = got.groupBy("query_id").agg(F.sum(F.coalesce("hit", F.lit(0)) / F.log2(F.col("rank") + 1)).alias("dcg"), F.sum(F.coalesce("hit", F.lit(0))).alias("hits"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_rel"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1))
    return total.join(gain, "query_id", "left").select("query_id", (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"), (F.coalesce("hits", F.lit(0)) / F.col("n_rel")).alias("recall"))


def label_metrics(ranked: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """ranking_metrics() where the rows of a query's own label, itself left out, are the relevant ones.

    ``labels``: id, label.  Counts by label replace the pairs of queries and relevant rows.
    """
    sizes = labels.groupBy("label").agg((F.count("*") - 1).alias("n_rel"))
    asked = labels.select(F.col("id").alias("query_id"), F.col("label").alias("_ql"))
    got = ranked.where(F.col("rank") <= k).join(asked, "query_id").join(labels.select("id", F.col("label").alias("_l")), "id", "left")
    hit = F.coalesce((F.col("_l") == F.col("_ql")).cast("int"), F.lit(0))
    gain = got.groupBy("query_id", F.col("_ql").alias("label")).agg(F.sum(hit / F.log2(F.col("rank") + 1)).alias("dcg"), F.sum(hit).alias("hits"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_rel"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1))
    return gain.join(sizes, "label").where("n_rel > 0").select("query_id", (F.col("dcg") / ideal).alias("ndcg"), (F.col("hits") / F.col("n_rel")).alias("recall"))
