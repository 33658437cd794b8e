"""How queries and their SQL are kept: the same columns, integers as BIGINT, doubles rounded: scores have up to eleven decimals, so that no value lies on an edge."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The derived relations of sources/relations.py, in SQL, in an order in which each needs only earlier ones.
RELATIONS = {
    "perms": "SELECT CAST(range AS BIGINT) AS perm_idx FROM range(10)",
    "cand": "SELECT CAST(o_custkey AS BIGINT) AS qid, CAST(o_orderkey AS BIGINT) AS docid, o_totalprice AS base, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 AS fs_rank FROM orders",
    "pool": "SELECT * FROM cand WHERE fs_rank < 20",
    "score_log": "SELECT p.qid, g.perm_idx, p.docid, row_number() OVER (PARTITION BY p.qid, g.perm_idx ORDER BY (p.docid * (2 * g.perm_idx + 3)) % 1009, p.docid) - 1 AS position, p.base * (1 + CASE WHEN g.perm_idx = 0 THEN 0 ELSE ((p.docid * (7 + g.perm_idx) + 13 * g.perm_idx) % 101 - 50) / 200.0E0 END) / 100000.0E0 AS score FROM pool p CROSS JOIN perms g",
    "qrels": "SELECT CAST(o_custkey AS BIGINT) AS qid, CAST(o_orderkey AS BIGINT) AS docid, CAST(CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 3 WHEN '2' THEN 2 WHEN '3' THEN 1 ELSE 0 END AS INT) AS rel FROM orders",
    "ranked": "SELECT qid, perm_idx, docid, position, score, row_number() OVER (PARTITION BY qid, perm_idx ORDER BY score DESC, docid) - 1 AS rnk FROM score_log",
    "qdim": "SELECT CAST(c.c_custkey AS BIGINT) AS qid, r.r_name AS dataset, c.c_mktsegment AS variant, CAST(42 + c.c_custkey % 3 AS INT) AS training_seed FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey",
    "deep_pool": "SELECT qid, docid, base, fs_rank FROM (SELECT qid, docid, base, row_number() OVER (PARTITION BY qid ORDER BY base DESC, docid) - 1 AS fs_rank FROM (SELECT CAST(l_suppkey AS BIGINT) AS qid, CAST(l_partkey AS BIGINT) AS docid, max(l_extendedprice) AS base FROM lineitem GROUP BY l_suppkey, l_partkey) a) b WHERE fs_rank < 101",
    "silver_raw": "SELECT d.source AS query_id, d.doc_id, g.perm_idx AS k, CAST((d.n_chars * (g.perm_idx + 3)) % 13 AS DOUBLE) / 4.0E0 AS score FROM documents d CROSS JOIN perms g WHERE g.perm_idx < 4",
    "silver_qrels": "SELECT d.source AS query_id, d.doc_id, CAST(2 * l.quality + (1 - l.toxic) AS INT) AS rel FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
    "reader_items": "SELECT c.conv_id AS qid, c.turn AS perm_idx, c.text AS prediction, g.text AS gold FROM conversations c JOIN (SELECT conv_id, text FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE role = 'user') u WHERE rn = 1) g ON c.conv_id = g.conv_id WHERE c.role = 'assistant'",
    "verdict_items": "SELECT user_id AS qid, event_id % 10 AS perm_idx, CASE event_type WHEN 'view' THEN 'SUPPORTED' WHEN 'click' THEN 'SUPPORTED' WHEN 'purchase' THEN 'REFUTED' WHEN 'signup' THEN 'NEI' ELSE NULL END AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_id % 10 ORDER BY event_id) AS rn FROM events) e WHERE rn = 1",
    # steps that several queries share
    "judged": "SELECT r.*, coalesce(q.rel, 0) AS rel FROM ranked r LEFT JOIN qrels q ON r.qid = q.qid AND r.docid = q.docid",
    "ideal": "SELECT qid, sum(CASE WHEN i <= 10 THEN rel / log2(i + 1) ELSE 0 END) AS idcg, sum(CASE WHEN i <= 10 THEN (pow(2, rel) - 1) / log2(i + 1) ELSE 0 END) AS xdcg, count(*) FILTER (WHERE rel > 0) AS n_rel FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, docid) AS i FROM qrels) GROUP BY qid",
    "ndcg": "SELECT j.qid, j.perm_idx, CASE WHEN max(i.idcg) > 0 THEN sum(CASE WHEN j.rnk < 10 THEN j.rel / log2(j.rnk + 2) ELSE 0 END) / max(i.idcg) ELSE 0 END AS ndcg FROM judged j JOIN ideal i ON j.qid = i.qid GROUP BY j.qid, j.perm_idx",
    "docpairs": "SELECT a.qid, a.perm_idx, a.docid AS i, b.docid AS j, CASE WHEN a.rnk < b.rnk THEN 1 ELSE -1 END AS s FROM ranked a JOIN ranked b ON a.qid = b.qid AND a.perm_idx = b.perm_idx AND a.docid < b.docid",
    "pairsums": "SELECT qid, i, j, sum(s) AS t, count(*) AS k FROM docpairs GROUP BY qid, i, j",
    "tau": "SELECT qid, avg((t * t - k) / CAST(k * (k - 1) AS DOUBLE)) AS tau FROM pairsums GROUP BY qid",
    "psi": "SELECT qid, tau, CASE WHEN tau IS NOT NULL THEN least(1, greatest(0, (1 - tau) / 2)) END AS tau_psi FROM tau",
}


def closure(sql: str) -> str:
    """sql behind the relations that it names, directly or through others."""
    import re

    needed: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in RELATIONS:
            if name not in needed and re.search(rf"\b{name}\b(?!\s*\()", text):
                needed.add(name)
                todo.append(RELATIONS[name])
    found = ", ".join(f"{n} AS ({s})" for n, s in RELATIONS.items() if n in needed)
    return f"WITH {found} " if found else ""


def register(name: str, query: Query, sql: str | None, i: str = "", d: str = "", s: str = "", digits: int = 11) -> None:
    """i, d, s: the integer, double and other columns of the result; digits: the decimals of doubles."""
    ints, doubles, others = i.split(), d.split(), s.split()

    def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query(spark, sf_dir)
        return df.select(*(F.col(c).cast("bigint").alias(c) for c in ints), *((F.round(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), digits) + 0.0).alias(c) for c in doubles), *others)

    QUERIES[name] = plain
    if sql is not None:
        columns = [f"CAST({c} AS BIGINT) AS {c}" for c in ints] + [f"round(CAST({c} AS DOUBLE), {digits}) + 0.0 AS {c}" for c in doubles] + others
        ORACLE_SQL[name] = f"{closure(sql)}SELECT {', '.join(columns)} FROM ({sql}) AS result"
