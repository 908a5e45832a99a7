"""Registry of the queries and, where SQL can say it, the equivalent SQL text."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise KeyError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


# ---------------------------------------------------------------------------
# SQL fragments: the same cohorts and folds, stated in SQL on the given tables.
# ---------------------------------------------------------------------------

MODALITY_SQL = """
line_feat AS (
  SELECT l_orderkey AS o_orderkey,
         [round(sum(l_quantity), 9), round(avg(l_quantity), 9), round(min(l_quantity), 9), round(max(l_quantity), 9),
          round(sum(l_extendedprice) / 1000, 9), round(avg(l_extendedprice) / 1000, 9), round(avg(l_discount), 9),
          round(max(l_discount), 9), round(avg(l_tax), 9), count(*)::DOUBLE] AS features
  FROM lineitem GROUP BY l_orderkey),
cust_feat AS (
  SELECT c_custkey,
         [round(c_acctbal / 1000, 9), round(abs(c_acctbal) / 1000, 9),
          list_position(['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY'], c_mktsegment)::DOUBLE,
          c_nationkey::DOUBLE, n_regionkey::DOUBLE] AS features
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
keyed AS (
  SELECT o_orderkey, o_orderkey::VARCHAR AS sample_id, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS label_raw,
         o_custkey, o_totalprice, o_orderdate, o_orderpriority
  FROM orders),
t_mge AS (SELECT sample_id, label_raw, features FROM keyed JOIN line_feat USING (o_orderkey)),
t_mdm AS (
  SELECT sample_id, label_raw,
         [round(o_totalprice / 1000, 9), year(o_orderdate)::DOUBLE, month(o_orderdate)::DOUBLE, day(o_orderdate)::DOUBLE,
          substr(o_orderpriority, 1, 1)::DOUBLE, isodow(o_orderdate)::DOUBLE] AS features
  FROM keyed),
t_mcna AS (SELECT sample_id, label_raw, features FROM keyed JOIN cust_feat ON o_custkey = c_custkey)"""

COHORT_SQL = (
    MODALITY_SQL
    + """,
cohort AS (
  SELECT d.sample_id, d.label_raw - 1 AS y,
         coalesce(g.features, [NULL,NULL,NULL,NULL,NULL,NULL,NULL,NULL,NULL,NULL]::DOUBLE[]) AS mge,
         d.features AS mdm,
         coalesce(c.features, [NULL,NULL,NULL,NULL,NULL]::DOUBLE[]) AS mcna
  FROM t_mdm d LEFT JOIN t_mge g ON d.sample_id = g.sample_id LEFT JOIN t_mcna c ON d.sample_id = c.sample_id)"""
)

CELLS_SQL = """
cells AS (
  SELECT sample_id, y, 'mge' AS modality, generate_subscripts(mge, 1) - 1 AS pos, unnest(mge) AS x FROM cohort
  UNION ALL
  SELECT sample_id, y, 'mdm', generate_subscripts(mdm, 1) - 1, unnest(mdm) FROM cohort
  UNION ALL
  SELECT sample_id, y, 'mcna', generate_subscripts(mcna, 1) - 1, unnest(mcna) FROM cohort)"""


def folds_sql(source: str = "cohort", n_splits: int = 5, n_repeats: int = 5, seed: int = 42, stratified: bool = True) -> str:
    by = "repeat_id, y" if stratified else "repeat_id"
    start = "CASE WHEN y = 1 THEN (SELECT count(*) FROM {s} WHERE y = 0) ELSE 0 END".format(s=source) if stratified else "0"
    return f"""
folds AS (
  SELECT repeat_id::INT AS repeat_id,
         ((row_number() OVER (PARTITION BY {by} ORDER BY sha256('{seed}|' || repeat_id || '|' || sample_id)) - 1 + {start}) % {n_splits})::INT AS fold_id,
         sample_id, y
  FROM {source}, range({n_repeats}) r(repeat_id))"""


MEMBERS_SQL = """
members AS (
  SELECT f.repeat_id, k.fold_id::INT AS fold_id, f.sample_id, f.y,
         CASE WHEN f.fold_id = k.fold_id THEN 'test' ELSE 'train' END AS role
  FROM folds f, range(5) k(fold_id))"""

INNER_SQL = """
inner_folds AS (
  SELECT repeat_id, fold_id,
         ((row_number() OVER (PARTITION BY repeat_id, fold_id, y
             ORDER BY sha256((1000 + repeat_id * 100 + fold_id) || '|' || sample_id)) - 1
           + CASE WHEN y = 1 THEN count(*) FILTER (WHERE y = 0) OVER (PARTITION BY repeat_id, fold_id) ELSE 0 END) % 3)::INT AS inner_fold_id,
         sample_id, y
  FROM members WHERE role = 'train')"""

FIT_SQL = """
medians AS (
  SELECT m.repeat_id, m.fold_id, c.modality, c.pos, count(c.x) AS n_present, median(c.x) AS median
  FROM members m JOIN cells c ON m.sample_id = c.sample_id WHERE m.role = 'train' GROUP BY ALL),
fitted AS (
  SELECT m.repeat_id, m.fold_id, c.modality, c.pos, any_value(d.median) AS median, count(*) AS n_train,
         count(*) - count(c.x) AS n_missing, avg(coalesce(c.x, d.median)) AS mean, var_pop(coalesce(c.x, d.median)) AS variance
  FROM members m JOIN cells c ON m.sample_id = c.sample_id
  JOIN medians d ON d.repeat_id = m.repeat_id AND d.fold_id = m.fold_id AND d.modality = c.modality AND d.pos = c.pos
  WHERE m.role = 'train' GROUP BY m.repeat_id, m.fold_id, c.modality, c.pos)"""


def words_sql(digest: str) -> str:
    """The multiset identity of a column of hex digests."""
    sums = " || '|' || ".join(
        f"sum(('0x' || substr({digest}, {1 + 8 * w}, 8))::BIGINT)::VARCHAR" for w in range(8)
    )
    return f"sha256(count({digest})::VARCHAR || '|' || {sums})"
