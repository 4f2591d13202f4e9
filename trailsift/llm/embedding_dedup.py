"""Embedding near-dedup by product quantisation: inverted lists, residual codes, table-lookup distances, exact cosine rerank.

Equal vectors are one class, so copies cost nothing further.  Coarse centroids and the codebooks of the residual's subspaces are trained
on a bounded sample; every class is indexed in the list of its nearest centroid.  Every class is also a query: it visits the ``PROBES``
nearest lists.  There its similarity to each member is summed from lookup tables over the member's codes.  The sum is off by no more
than the length of what the codes leave of the member, so a pair is reranked unless that bound rules it out: inside a visited list no
link is lost.  A pair counts if either of the two visits the other's list.  Rerank is the cosine in double precision.

Lists and their queries are dealt in blocks, so a list that holds a third of all vectors is many tasks.  Tasks return per vector the
number of its links and its place in a spanning forest of the links they saw, never the pairs.

Vectors of different lengths never link.  The most frequent length has an index of its own, and so has every other length of more than
``BLOCK`` classes; the classes of a smaller one are compared with each other, each length in a task of its own.

Defined results: a vector that is null, zero, or holds null or non-finite components links with nothing; an empty table gives an empty result; rows with equal ids are separate rows; other columns are never looked at.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailsift.llm.common import stored
from trailsift.llm.components import components

SIMILARITY = 0.9
LIST_SIZE = 256  # members of a list, on average
LISTS = 4096  # bound of the lists
TRAINED = 20_000  # bound of the vectors trained on
PROBES = 12
SUBSPACES, CODES = 16, 64
BLOCK = 1_500  # members or queries of a list in one task, on average
PAIRS = 50_000  # reranked at a time


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _means(x: np.ndarray, k: int, spherical: bool, rounds: int = 8) -> np.ndarray:
    """Lloyd's algorithm from spread starting points."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres, spherical)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        count = np.bincount(near, minlength=len(centres))
        used = count > 0
        centres[used] = total[used] / count[used, None]
        if spherical:
            size = np.linalg.norm(centres, axis=1, keepdims=True)
            centres = np.where(size > 1e-9, centres / np.maximum(size, 1e-9), centres)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray, spherical: bool) -> np.ndarray:
    offset = 0.0 if spherical else (centres**2).sum(1) / 2
    return np.concatenate([(x[k : k + 4096] @ centres.T - offset).argmax(1) for k in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


class Codebook:
    """Coarse centroids and the codes of the residual's subspaces."""

    def __init__(self, sample: np.ndarray, lists: int) -> None:
        self.coarse = _means(sample, lists, True)
        rest = sample - self.coarse[_nearest(sample, self.coarse, True)]
        self.cuts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        self.books = [_means(np.ascontiguousarray(rest[:, cut]), CODES, False) for cut in self.cuts]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lists to visit (the nearest, the home, first), codes, and how much of each vector the codes leave out."""
        close = x @ self.coarse.T
        visits = np.argsort(-close, axis=1, kind="stable")[:, :PROBES]
        rest = x - self.coarse[visits[:, 0]]
        codes = np.stack([_nearest(rest[:, cut], book, False) for cut, book in zip(self.cuts, self.books, strict=True)], axis=1)
        for m, cut in enumerate(self.cuts):
            rest[:, cut] -= self.books[m][codes[:, m]]
        return visits, codes.astype(np.uint8), np.linalg.norm(rest, axis=1)

    def looked_up(self, queries: np.ndarray, home: int, codes: np.ndarray) -> np.ndarray:
        """Similarity of each query to each coded member of one list, from a table per query and subspace."""
        found = np.repeat((queries @ self.coarse[home])[:, None], len(codes), axis=1)
        for m, cut in enumerate(self.cuts):
            found += (queries[:, cut] @ self.books[m].T)[:, codes[:, m]]
        return found


def usable(vector: Column) -> Column:
    """Neither null nor zero, and of finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _numbered(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows with the key of their class, null where the vector links with nothing."""
    vector = F.col(vector_col).cast("array<double>")
    key = F.when(usable(vector), F.unhex(F.md5(F.array_join(F.transform(vector, lambda x: (x + 0.0).cast("string")), ","))))
    return vectors.select(F.col(id_col).alias("id"), vector.alias("vector"), key.alias("key"))


def _forest(a: np.ndarray, b: np.ndarray, nodes: int) -> np.ndarray:
    """The least node of each node's component."""
    root = np.arange(nodes)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _linked(queries: np.ndarray, members: np.ndarray, may: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs with a cosine of ``least`` or more among those that may have it."""
    q, x = np.nonzero(may)
    sizes_q, sizes_x = np.linalg.norm(queries, axis=1), np.linalg.norm(members, axis=1)
    keep = [np.zeros(0, bool)]
    for k in range(0, len(q), PAIRS):
        i, j = q[k : k + PAIRS], x[k : k + PAIRS]
        keep.append(np.einsum("ij,ij->i", queries[i], members[j]) / (sizes_q[i] * sizes_x[j]) >= least)
    kept = np.concatenate(keep)
    return q[kept], x[kept]


def links(classes: DataFrame, book: Codebook, least: float) -> DataFrame:
    """Of classes (node, vector, n): per node and task, ``links`` (weighted by the copies of the other class) and ``root``."""
    spark = classes.sparkSession

    def assign(parts):  # noqa: ANN001, ANN202
        for pdf in parts:
            if len(pdf):
                visits, codes, left = book.assign(_unit(np.stack(pdf["vector"])))
                yield pdf.assign(visits=list(visits.astype(np.int32)), codes=[c.tobytes() for c in codes], left_out=left)

    schema = "node long, vector array<double>, n long, visits array<int>, codes binary, left_out double"
    indexed = stored(classes.select("node", "vector", "n").mapInPandas(assign, schema), "pq-index")
    visits = indexed.select("node", "vector", "n", "visits", F.posexplode("visits").alias("rank", "list"))
    # Blocks of each list: its members and its queries are counted, a bounded number of lists.
    blocks = visits.groupBy("list").agg(
        F.ceil(F.count(F.when(F.col("rank") == 0, 1)) / F.lit(BLOCK)).cast("int").alias("member_blocks"), F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("query_blocks")
    )
    blocks = F.broadcast(spark.createDataFrame(blocks.collect(), "list int, member_blocks int, query_blocks int")).filter("member_blocks > 0")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    members = indexed.withColumn("list", F.col("visits")[0]).join(blocks, "list").select(
        "list", own("member_blocks").alias("mb"), every("query_blocks").alias("qb"), F.lit(True).alias("member"), "node", "vector", "n", "visits", "codes", "left_out"
    )
    queries = visits.join(blocks, "list").select(
        "list", every("member_blocks").alias("mb"), own("query_blocks").alias("qb"), F.lit(False).alias("member"), "node", "vector", "n", "visits",
        F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("left_out"),
    )

    def meet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, q = pdf[pdf["member"]], pdf[~pdf["member"]]
        if not len(x) or not len(q):
            return pd.DataFrame({"node": [], "links": [], "root": []})
        home = int(key[0])
        vx, vq = np.stack(x["vector"]), np.stack(q["vector"])
        nx, nq, wx, wq = (c.to_numpy() for c in (x["node"], q["node"], x["n"], q["n"]))
        codes = np.frombuffer(b"".join(x["codes"]), np.uint8).reshape(len(x), -1)
        may = book.looked_up(_unit(vq), home, codes) >= least - x["left_out"].to_numpy()[None, :] - 1e-9
        may &= nq[:, None] != nx[None, :]
        i, j = _linked(vq, vx, may, least)
        # The member's own visit finds the pair again if it visits the query's home; only otherwise it is counted here for the member.
        visits_x, home_q = np.stack(x["visits"]), np.stack(q["visits"])[:, 0]
        unseen = (visits_x[j] != home_q[i][:, None]).all(axis=1)
        nodes, at = np.unique(np.concatenate([nq, nx]), return_inverse=True)
        a, b = at[: len(nq)][i], at[len(nq) :][j]
        found = np.bincount(a, weights=wx[j], minlength=len(nodes)) + np.bincount(b[unseen], weights=wq[i][unseen], minlength=len(nodes))
        root = _forest(a, b, len(nodes))
        seen = np.zeros(len(nodes), bool)
        seen[a] = seen[b] = True
        return pd.DataFrame({"node": nodes[seen], "links": found[seen].astype(np.int64), "root": nodes[root[seen]]})

    return members.union(queries).groupBy("list", "mb", "qb").applyInPandas(meet, "node long, links long, root long")


def _compared(least: float):  # noqa: ANN202
    """Links among all classes of one length, in the form of ``links``."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        vectors, n, nodes = np.stack(pdf["vector"]), pdf["n"].to_numpy(), pdf["node"].to_numpy()
        i, j = _linked(vectors, vectors, np.triu(np.ones((len(nodes), len(nodes)), bool), 1), least)
        found = np.bincount(i, weights=n[j], minlength=len(nodes)) + np.bincount(j, weights=n[i], minlength=len(nodes))
        root = _forest(i, j, len(nodes))
        return pd.DataFrame({"node": nodes, "links": found.astype(np.int64), "root": nodes[root]})[found > 0]

    return compare


def dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = SIMILARITY) -> DataFrame:
    """Per row: ``id``, ``n_links`` (other rows linked directly), ``component_id`` (least id of the component)."""
    rows = stored(_numbered(vectors, id_col, vector_col), "vectors")
    fits = F.col("key").isNotNull()
    grouped = rows.filter(fits).groupBy("key").agg(F.min("id").alias("least_id"), F.count("*").alias("n"), F.first("vector").alias("vector"))
    classes = stored(grouped.withColumn("node", F.monotonically_increasing_id()).withColumn("length", F.size("vector")), "vector-classes")
    lengths = sorted(((r["count"], r["length"]) for r in classes.groupBy("length").count().collect()), reverse=True)
    if not lengths:
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    indexed = [lengths[0], *((total, length) for total, length in lengths[1:] if total > BLOCK)]
    parts = []
    for total, length in indexed:
        own = classes.filter(F.col("length") == length)
        draw = F.xxhash64("key", F.lit("train"))
        sample = own.select(draw.alias("draw"), "vector").orderBy("draw").limit(TRAINED).collect()
        book = Codebook(_unit(np.array([r["vector"] for r in sample])), min(LISTS, 1 + total // LIST_SIZE))
        parts.append(links(own, book, least))
    if len(lengths) > len(indexed):
        rest = classes.filter(~F.col("length").isin([length for _, length in indexed]))
        parts.append(rest.groupBy("length").applyInPandas(_compared(least), "node long, links long, root long"))
    found = stored(reduce(DataFrame.union, parts), "vector-links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    placed = classes.select("key", "node", "n", "least_id").join(counts, "node", "left").join(roots, "node", "left").select(
        "key", "least_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")
    )
    placed = stored(placed, "vector-roots")
    lowest = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    result = placed.join(lowest, "root").select("key", "n_links", "component_id")
    own = rows.select("id", F.when(fits, F.col("key")).alias("key"))
    return own.join(result, "key", "left").select(
        "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")
    )
