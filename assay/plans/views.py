"""The given tables seen as benchmark inputs; one SQL text serves Spark and the comparison engine."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")

VIEWS = {
    "materials": """
        SELECT o_orderkey AS material_id, o_orderkey AS ordinal, o_totalprice / 5e4 - 5e0 AS e_form_dft,
          (o_custkey % 1000) * 1e-3 * 9e-1 - 15e-2 AS each_true, (o_orderpriority <> '5-LOW') AS uniq_proto,
          o_orderkey % 5 + 1 AS step, o_custkey % 230 + 1 AS spg_num, o_custkey % 97 AS proto_id, o_orderdate AS added_at
        FROM orders""",
    "preds": """
        SELECT l.l_returnflag AS model_key, l.l_orderkey AS material_id,
          CASE WHEN min(l.l_quantity) >= 49e0 THEN m.e_form_dft + 6e0
               ELSE m.e_form_dft + (min(l.l_discount) - 3e-2) * 4e0 END AS e_form_pred
        FROM lineitem l JOIN materials m ON m.material_id = l.l_orderkey
        GROUP BY l.l_returnflag, l.l_orderkey, m.e_form_dft""",
    "composition": """
        SELECT o_orderkey AS material_id, 'E' || CAST(n_nationkey AS VARCHAR(8)) AS element, 1e0 + o_orderkey % 4 AS amount
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey
        UNION ALL
        SELECT DISTINCT l_orderkey AS material_id, 'P' || CAST(p_size AS VARCHAR(8)) AS element, 1e0 + p_size % 3 AS amount
        FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "curve": """
        SELECT event_type AS side, user_id AS curve_id,
          row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) * 25e-2
            + CASE WHEN event_type = 'view' THEN 0e0 ELSE 1e-1 END AS x, value AS y
        FROM events""",
    "spectrum": "SELECT vec_id, label, CAST(pos AS BIGINT) AS pos, CAST(v AS DOUBLE) AS freq, pos % 8 + 1e0 AS w FROM emb_long",
    "atoms": """
        SELECT label AS system, frame, CAST(floor(pos / 3e0) AS INT) AS atom,
          5e0 + 1e1 * max(CASE WHEN pos % 3 = 0 THEN CAST(v AS DOUBLE) END) AS x,
          5e0 + 1e1 * max(CASE WHEN pos % 3 = 1 THEN CAST(v AS DOUBLE) END) AS y,
          5e0 + 1e1 * max(CASE WHEN pos % 3 = 2 THEN CAST(v AS DOUBLE) END) AS z
        FROM (SELECT *, dense_rank() OVER (PARTITION BY label ORDER BY vec_id) AS frame, max(pos) OVER (PARTITION BY vec_id) AS last FROM emb_long) t
        WHERE pos < 3 * floor((last + 1) / 3e0) GROUP BY label, frame, CAST(floor(pos / 3e0) AS INT)""",
}

VIEWS |= {
    "elements": "SELECT n_nationkey AS element, 3e-1 + n_nationkey * 5e-2 AS r_cov, 1e0 + n_nationkey * 1e-1 AS r_vdw FROM nation",
    "parts": "SELECT p_partkey AS part_id, p_size AS size, p_type AS kind, p_retailprice AS price FROM part",
    "items": "SELECT l_orderkey AS material_id, l_linenumber AS line, l_quantity AS q, l_discount AS d, l_tax AS t, l_returnflag AS flag FROM lineitem",
    "records": "SELECT event_id, event_type, user_id, value FROM events",
    "runs": "SELECT o_orderkey AS run_id, o_custkey AS cust, o_orderpriority AS hardware, o_totalprice AS seconds, o_orderstatus AS status FROM orders",
    "vectors": "SELECT vec_id, label, embedding FROM embeddings",
}

_EMB = {
    "spark": "SELECT vec_id, label, posexplode(embedding) AS (pos, v) FROM embeddings",
    "sql": "SELECT vec_id, label, unnest(range(len(embedding))) AS pos, unnest(embedding) AS v FROM embeddings",
}


def _chain(names: list[str], emb: str) -> str:
    needed: list[str] = []

    def need(name: str) -> None:
        body = VIEWS[name] if name != "emb_long" else ""
        for other in [*VIEWS, "emb_long"]:
            if other != name and re.search(rf"(FROM|JOIN)\s+{other}\b", body):
                need(other)
        if name not in needed:
            needed.append(name)

    for name in names:
        need(name)
    return ",\n".join(f"{n} AS ({emb if n == 'emb_long' else VIEWS[n]})" for n in needed)


#: Spark deals these rows out in all shuffle partitions: it would merge them by compressed bytes, of which sorted keys
#: take few, and a task would sort, join and group many times as much as it reads. All that follows by key stays there.
_DEALT = {
    "FROM lineitem l JOIN materials m": "FROM (SELECT /*+ REPARTITION({n}, l_orderkey) */ l_orderkey, l_returnflag, l_quantity, l_discount FROM lineitem) l JOIN materials m",
}

#: The atoms in Spark: frames are ranked over ids, not over their components, and a vector's components stay together, so that
#: what a label has does not go through one task.
_ATOMS = """
    WITH ids AS (SELECT label, vec_id, max(size(embedding)) AS n FROM embeddings WHERE size(embedding) > 0 GROUP BY label, vec_id),
    ranked AS (SELECT label, vec_id, dense_rank() OVER (PARTITION BY label ORDER BY vec_id) AS frame, max(n) OVER (PARTITION BY vec_id) AS n FROM ids),
    triples AS (SELECT e.label, e.vec_id, frame, embedding, explode(sequence(0, (least(n - n % 3, size(embedding)) + 2) div 3 - 1)) AS at
      FROM embeddings e JOIN ranked r ON e.label <=> r.label AND e.vec_id <=> r.vec_id WHERE size(embedding) > 0 AND n >= 3)
    SELECT label AS system, frame, CAST(at AS INT) AS atom, 5e0 + 1e1 * max(CAST(get(embedding, int(3 * at)) AS DOUBLE)) AS x,
      5e0 + 1e1 * max(CAST(get(embedding, int(3 * at + 1)) AS DOUBLE)) AS y, 5e0 + 1e1 * max(CAST(get(embedding, int(3 * at + 2)) AS DOUBLE)) AS z
    FROM triples GROUP BY label, vec_id, frame, at"""


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame over the Parquet tables of ``sf_dir``."""
    text = _ATOMS if name == "atoms" else f"WITH {_chain([name], _EMB['spark'])}\nSELECT * FROM {name}"
    for rows, dealt in _DEALT.items():
        text = text.replace(rows, dealt.format(n=spark.conf.get("spark.sql.shuffle.partitions")))
    for t in TABLES:
        text = re.sub(rf"\b(FROM|JOIN)(\s+){t}\b", rf"\1\2parquet.`{sf_dir}/{t}.parquet`", text)
    return spark.sql(text)


def sql_with(names: str, body: str) -> str:
    """SQL whose CTEs are the named views."""
    return f"WITH {_chain(names.split(), _EMB['sql'])}\n{body}" if not body.lstrip().startswith(",") else f"WITH {_chain(names.split(), _EMB['sql'])}{body}"
