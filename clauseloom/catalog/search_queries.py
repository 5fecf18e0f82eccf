"""Vectors and search over all embeddings and all clauses found."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from clauseloom.catalog import ctes as C
from clauseloom.catalog import fixture
from clauseloom.catalog.registry import query
from clauseloom.functions.vectors import inner_product
from clauseloom.operators import dense, display, inverted, sparse
from clauseloom.sources.stages import stage
from clauseloom.taxonomy import CLAUSE_TYPES


def _embeddings(spark, sf_dir):
    return fixture.spread(fixture.table(spark, sf_dir, "embeddings"), "vec_id")


def _index(spark, sf_dir):
    return dense.unit_vectors(_embeddings(spark, sf_dir), "vec_id", "embedding")


def _label_queries(spark, sf_dir):
    """One query per label: the mean direction of its vectors."""
    means = dense.mean_vectors(_embeddings(spark, sf_dir), "label", "embedding")
    return dense.unit_vectors(means, "label", "vector").withColumnRenamed("item_id", "query_id")


def _shown(hits):
    """Hits as compared with SQL: ranked on the full score, shown with six places."""
    return hits.withColumns({"rank": F.col("rank").cast("long"), "score": F.round("score", 6)})


def _sample_hits(spark, items, k=5):
    return inverted.search(fixture.sample_queries(spark), items, k)


@query(
    "unit_vectors",
    C.sql(
        """SELECT vec_id, CAST(unnest(range(len(v))) AS INTEGER) AS pos, round(unnest(v), 6) + 0.0 AS x
        FROM units""",
        "units",
    ),
)
def _(spark, sf_dir):
    rows = _index(spark, sf_dir).select(F.col("item_id").alias("vec_id"), F.posexplode("vector").alias("pos", "x"))
    return rows.withColumn("x", F.round("x", 6) + F.lit(0.0))


@query(
    "inner_products",
    C.sql(
        """SELECT a.vec_id, round(list_inner_product(a.v, b.v), 6) + 0.0 AS score
        FROM units a JOIN units b ON b.vec_id = a.vec_id + 1""",
        "units",
    ),
)
def _(spark, sf_dir):
    index = _index(spark, sf_dir)
    following = index.select((F.col("item_id") - 1).alias("item_id"), F.col("vector").alias("other"))
    return index.join(following, "item_id").select(
        F.col("item_id").alias("vec_id"),
        (F.round(inner_product("vector", "other"), 6) + F.lit(0.0)).alias("score"),
    )


@query(
    "contract_vectors",
    C.sql(
        """SELECT contract_id, CAST(len(embedding) AS INTEGER) AS dimensions, label
        FROM contracts JOIN embeddings ON vec_id = doc_id""",
        "contracts",
    ),
)
def _(spark, sf_dir):
    vectors = fixture.table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return (
        fixture.contracts(spark, sf_dir)
        .select("doc_id", "contract_id")
        .join(vectors, "doc_id")
        .select("contract_id", F.size("embedding").alias("dimensions"), "label")
    )


@query(
    "nearest_one",
    C.sql(
        """SELECT row_number() OVER (ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM (
          SELECT vec_id, round(list_inner_product(v, (SELECT list(x / norm ORDER BY pos) FROM (
            SELECT pos, x, sqrt(sum(x * x) OVER ()) AS norm FROM (
              SELECT pos, avg(x) AS x FROM (SELECT unnest(range(len(embedding))) AS pos,
                unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY pos)))), 6) AS score FROM units)
        ORDER BY score DESC, vec_id LIMIT 5""",
        "units",
    ),
)
def _(spark, sf_dir):
    everything = _embeddings(spark, sf_dir).withColumn("query", F.lit(1))
    means = dense.mean_vectors(everything, "query", "embedding")
    asked = dense.unit_vectors(means, "query", "vector").withColumnRenamed("item_id", "query_id")
    hits = dense.nearest(asked, _index(spark, sf_dir), 5)
    return _shown(hits).select("rank", F.col("item_id").alias("vec_id"), "score")


@query(
    "nearest_batch",
    C.sql("SELECT query_id, rank, item_id, score FROM label_hits WHERE rank <= 5", "label_hits"),
)
def _(spark, sf_dir):
    hits = dense.nearest(_label_queries(spark, sf_dir), _index(spark, sf_dir), 5)
    return _shown(hits)


@query(
    "hits_above_threshold",
    C.sql(
        f"""SELECT query_id, rank, item_id, score FROM {C.text_hits('exemplar_queries')}
        WHERE rank <= 20 AND score >= 0.5""",
        "postings",
        "item_idf",
        "items",
        "exemplar_queries",
    ),
)
def _(spark, sf_dir):
    asked = spark.createDataFrame([(c.name, c.exemplar) for c in CLAUSE_TYPES], "query_id string, text string")
    hits = sparse.above(inverted.search(asked, fixture.stored_items(spark, sf_dir), 20), 0.5)
    return _shown(hits)


@query(
    "nearest_capped",
    C.sql("SELECT query_id, rank, item_id, score FROM label_hits WHERE rank <= 10", "label_hits"),
)
def _(spark, sf_dir):
    hits = sparse.cap_results(dense.nearest(_label_queries(spark, sf_dir), _index(spark, sf_dir), 20), 20, 10)
    return _shown(hits)


@query(
    "nearest_few_items",
    C.sql(
        """SELECT q.label AS query_id, i.label AS item_id, round(list_inner_product(q.v, i.v), 6) AS score
        FROM label_queries q CROSS JOIN label_queries i""",
        "label_queries",
    ),
)
def _(spark, sf_dir):
    # k is larger than the index of label means: each query gets as many hits as there are labels.
    means = _label_queries(spark, sf_dir)
    index = means.withColumnRenamed("query_id", "item_id")
    return _shown(dense.nearest(means, index, 1000)).select("query_id", "item_id", "score")


def _label_centres(spark, sf_dir):
    """The mean directions of the labels, in the order of the labels: ten fixed centres."""
    rows = _label_queries(spark, sf_dir).orderBy("query_id").collect()
    return np.array([r["vector"] for r in rows])


def _vector_queries(index):
    return index.filter(F.col("item_id") % 25 == 0).withColumnRenamed("item_id", "query_id")


@query(
    "nearest_in_cells",
    C.sql("SELECT query_id, rank, item_id, round(score, 6) AS score FROM cell_hits WHERE rank <= 5", "cell_hits"),
)
def _(spark, sf_dir):
    index, centres = _index(spark, sf_dir), _label_centres(spark, sf_dir)
    celled = dense.assign_to_centres(index, centres)
    return _shown(dense.nearest_in_cells(_vector_queries(index), celled, centres, 5, probes=2))


@query(
    "cell_recall",
    C.sql(
        """SELECT query_id, count(*) AS hits, count(c.item_id) AS found, round(count(c.item_id) / count(*), 6) AS recall
        FROM (SELECT * FROM exact_hits WHERE rank <= 5) e
        LEFT JOIN (SELECT * FROM cell_hits WHERE rank <= 5) c USING (query_id, item_id) GROUP BY query_id""",
        "exact_hits",
        "cell_hits",
    ),
)
def _(spark, sf_dir):
    index, centres = _index(spark, sf_dir), _label_centres(spark, sf_dir)
    asked = _vector_queries(index)
    found = dense.nearest_in_cells(asked, dense.assign_to_centres(index, centres), centres, 5, probes=2)
    return dense.recall(dense.nearest(asked, index, 5), found)


def _stored_cells(spark, sf_dir):
    """(index, celled, centres): the vectors stored by cell, around the label means."""
    index, centres = _index(spark, sf_dir), _label_centres(spark, sf_dir)
    return index, stage(dense.assign_to_centres(index, centres), "cells", "cell"), centres


def _fiftieth(index):
    return index.filter(F.col("item_id") % 50 == 0).withColumnRenamed("item_id", "query_id")


@query(
    "nearest_by_bound",
    C.sql(
        "SELECT query_id, rank, item_id, round(score, 6) AS score FROM exact_hits WHERE rank <= 5 AND query_id % 50 = 0",
        "exact_hits",
    ),
)
def _(spark, sf_dir):
    index, celled, centres = _stored_cells(spark, sf_dir)
    return _shown(dense.nearest_by_bound(_fiftieth(index), celled, centres, 5)[0])


@query(
    "bound_recall",
    C.sql(
        """SELECT query_id, count(*) AS hits, count(*) AS found, 1.0::DOUBLE AS recall FROM exact_hits
        WHERE rank <= 5 AND query_id % 50 = 0 GROUP BY query_id""",
        "exact_hits",
    ),
)
def _(spark, sf_dir):
    index, celled, centres = _stored_cells(spark, sf_dir)
    asked = _fiftieth(index)
    return dense.recall(dense.nearest(asked, index, 5), dense.nearest_by_bound(asked, celled, centres, 5)[0])


@query(
    "nearest_in_groups",
    C.sql(
        "SELECT query_id, rank, item_id, round(score, 6) AS score FROM exact_hits WHERE rank <= 5", "exact_hits"
    ),
)
def _(spark, sf_dir):
    # A bound that any number of queries passes: they meet the vectors in groups.
    index = _index(spark, sf_dir)
    return _shown(dense.nearest(_vector_queries(index), index, 5, max_bytes=0))


@query(
    "uncached_texts",
    C.sql(
        """SELECT sha256(text) AS digest, text FROM contracts GROUP BY text
        HAVING sha256(text) NOT IN (SELECT sha256(text) FROM contracts WHERE doc_id IN (SELECT doc_id FROM labels))""",
        "contracts",
    ),
)
def _(spark, sf_dir):
    # The cache holds the texts of all labelled documents.
    contracts = fixture.stored_contracts(spark, sf_dir)
    labelled = contracts.join(fixture.table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    cache = labelled.select(F.sha2("text", 256).alias("digest"))
    return dense.uncached(contracts, cache, "contract_id", "text")


@query(
    "term_weights", C.sql("SELECT term, df, round(idf, 6) AS idf FROM item_idf", "item_idf")
)
def _(spark, sf_dir):
    return sparse.term_weights(fixture.stored_items(spark, sf_dir)).select("term", "df", F.round("idf", 6).alias("idf"))


@query("postings", C.sql("SELECT item_id, term, round(weight, 6) AS weight FROM postings", "postings"))
def _(spark, sf_dir):
    items = fixture.stored_items(spark, sf_dir)
    return sparse.postings(items, sparse.term_weights(items)).select(
        "item_id", "term", F.round("weight", 6).alias("weight")
    )


@query(
    "sample_search",
    C.sql(
        f"SELECT query_id, rank, item_id, score FROM {C.text_hits('sample_queries')} WHERE rank <= 5",
        "postings",
        "item_idf",
        "items",
        "sample_queries",
    ),
)
def _(spark, sf_dir):
    return _shown(_sample_hits(spark, fixture.stored_items(spark, sf_dir)))


@query(
    "benchmark_search",
    C.sql(
        f"SELECT query_id, rank, item_id, score FROM {C.text_hits('benchmark_queries')} WHERE rank <= 5",
        "postings",
        "item_idf",
        "items",
        "benchmark_queries",
    ),
)
def _(spark, sf_dir):
    asked = fixture.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    hits = inverted.search(asked, fixture.stored_items(spark, sf_dir), 5)
    return _shown(hits)


@query(
    "search_hits",
    C.sql(
        f"""SELECT h.query_id, h.rank, h.score, i.contract_id, i.clause_type, i.filename, i.clause
        FROM {C.text_hits('sample_queries')} h JOIN items i USING (item_id) WHERE h.rank <= 3""",
        "postings",
        "item_idf",
        "items",
        "sample_queries",
    ),
)
def _(spark, sf_dir):
    items = fixture.stored_items(spark, sf_dir)
    hits = sparse.attach(_sample_hits(spark, items, 3), items)
    return hits.select(
        "query_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), "contract_id", "clause_type",
        "filename", "clause",
    )


@query(
    "hit_lines",
    C.sql(
        f"""SELECT h.query_id, h.rank, i.contract_id, i.clause_type, round(h.score, 3) AS score,
        substring(i.clause, 1, 100) || '...' AS snippet
        FROM {C.text_hits('sample_queries')} h JOIN items i USING (item_id) WHERE h.rank <= 2""",
        "postings",
        "item_idf",
        "items",
        "sample_queries",
    ),
)
def _(spark, sf_dir):
    items = fixture.stored_items(spark, sf_dir)
    hits = sparse.attach(_sample_hits(spark, items, 2), items)
    return display.hit_lines(hits).withColumn("rank", F.col("rank").cast("long"))
