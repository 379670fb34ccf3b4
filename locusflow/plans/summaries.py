"""Registered queries of the cluster and component summaries, membership and joined arms."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusflow.operators import denovo
from locusflow.plans.registry import query
from locusflow.session import table

CLUSTERS = "c AS (SELECT l_partkey AS cluster, l_suppkey % 7 AS core, l_orderkey AS node, CAST(l_quantity AS BIGINT) AS reads FROM lineitem)"
MEMBERS = "m AS (SELECT l_partkey AS component, l_orderkey % 3 AS part, l_suppkey % 12 AS sample FROM lineitem)"
WEIGHTS = "w AS (SELECT l_suppkey AS sample, CAST(l_linenumber % 4 AS BIGINT) AS k, SUM(CASE WHEN l_suppkey % 5 = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) END) AS weight FROM lineitem GROUP BY 1, 2)"
SHARES = f"{WEIGHTS}, q AS (SELECT sample, k, CASE WHEN SUM(weight) OVER (PARTITION BY sample) > 0 THEN CAST(weight AS DOUBLE) / CAST(SUM(weight) OVER (PARTITION BY sample) AS DOUBLE) ELSE 0.25 END AS share FROM w)"


def _weights(spark, sf):
    x = F.when(F.col("l_suppkey") % 5 == 0, 0).otherwise(F.col("l_quantity").cast("long"))
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("sample"), (F.col("l_linenumber") % 4).cast("long").alias("k")).agg(F.sum(x).alias("weight"))


@query(f"WITH {CLUSTERS} SELECT cluster, COUNT(DISTINCT core) AS cores, CAST(SUM(reads) AS BIGINT) AS reads, arg_min(node, -reads * 1000000000000 + node) AS seed FROM c GROUP BY 1")
def cluster_summary(spark, sf):
    return denovo.cluster_summary(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("cluster"), (F.col("l_suppkey") % 7).alias("core"), F.col("l_orderkey").alias("node"), F.col("l_quantity").cast("long").alias("reads")))


@query(f"""WITH {MEMBERS}, p AS (SELECT component, COUNT(DISTINCT part) AS parts FROM m GROUP BY 1), o AS (SELECT component, sample, COUNT(DISTINCT part) AS own FROM m GROUP BY 1, 2)
    SELECT sample, COUNT(*) AS components, COUNT(*) FILTER (parts > 1) AS split, COUNT(*) FILTER (own > 1) AS multi, COUNT(*) FILTER (parts > 1) / COUNT(*) AS split_share, COUNT(*) FILTER (own > 1) / COUNT(*) AS multi_share FROM o JOIN p USING (component) GROUP BY 1""")
def sample_burden(spark, sf):
    return denovo.sample_burden(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("component"), (F.col("l_orderkey") % 3).alias("part"), (F.col("l_suppkey") % 12).alias("sample")))


@query(f"WITH {SHARES} SELECT * FROM q")
def membership_shares(spark, sf):
    return denovo.normalize_membership(_weights(spark, sf), 4)


@query(f"WITH {SHARES} SELECT sample, k AS cluster, share FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY share DESC, k) AS r FROM q) WHERE r = 1")
def membership_assignments(spark, sf):
    return denovo.assignments(denovo.normalize_membership(_weights(spark, sf), 4))


@query("""WITH s AS (SELECT p_partkey AS locus, CASE WHEN p_partkey % 3 = 0 THEN repeat('A', p_size) ELSE repeat('A', p_size) || repeat('N', 24) || repeat('C', p_partkey % 9) END AS seq FROM part)
    SELECT locus, CASE WHEN instr(seq, repeat('N', 24)) > 0 THEN substr(seq, 1, instr(seq, repeat('N', 24)) - 1) ELSE seq END AS arm1, CASE WHEN instr(seq, repeat('N', 24)) > 0 THEN substr(seq, instr(seq, repeat('N', 24)) + 24) END AS arm2, seq FROM s""")
def joined_arms(spark, sf):
    k, left = F.col("p_partkey"), F.repeat(F.lit("A"), F.col("p_size"))
    seq = denovo.join_arms(left, F.when(k % 3 != 0, F.repeat(F.lit("C"), (k % 9).cast("int"))))
    a, b = denovo.split_arms("seq")
    return table(spark, sf, "part").select(k.alias("locus"), seq.alias("seq")).select("locus", a.alias("arm1"), b.alias("arm2"), denovo.join_arms(a, b).alias("seq"))


@query("SELECT p_partkey AS locus, p_size AS length FROM (SELECT * FROM part ORDER BY md5('7:' || CAST(p_partkey AS VARCHAR)), p_partkey LIMIT 100)")
def sampled_loci(spark, sf):
    return denovo.sample_loci(table(spark, sf, "part").select(F.col("p_partkey").alias("locus"), F.col("p_size").alias("length")), 100, 7)
