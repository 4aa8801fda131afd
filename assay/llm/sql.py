"""SQL that gives the rows of the corpus queries, where SQL can express them."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

_CRC = """
MACRO_TABLE AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t
), HEXED AS (
  SELECT doc_id, text, lower(hex(encode(coalesce(text, '')))) AS h, strlen(coalesce(text, '')) AS n FROM documents
), CRC AS (
  SELECT doc_id, text, n, xor(list_reduce(
    list_transform(range(n), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)),
    lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS BIGINT)]), CAST(4294967295 AS BIGINT)), 4294967295) AS crc
  FROM HEXED, MACRO_TABLE
)"""

OP2 = f"""
WITH {_CRC}, SIZED AS (
  SELECT doc_id, n + 1 AS size, crc AS text_crc32,
    sum(n + 1) OVER (ORDER BY doc_id, crc ROWS UNBOUNDED PRECEDING) AS upto, sum(n + 1) OVER () AS total
  FROM CRC
), CUT AS (
  SELECT doc_id, size, text_crc32, least(15, CAST((16 * (2 * upto - size)) // (2 * total) AS BIGINT)) AS shard FROM SIZED
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM CUT"""

OP7 = rf"""
WITH R AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents
), D AS (SELECT *, CAST('0x' || substr(k, 1, 4) AS BIGINT) % 64 AS shard FROM R),
S0 AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM D GROUP BY source
), S1 AS (
  SELECT *, turn % 3 + 1 AS weight, 3 * source_size AS cap, sum(source_size) OVER ()::BIGINT AS total FROM S0
), S2 AS (
  SELECT *, total - coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS toks,
    sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ws
  FROM S1
), S3 AS (SELECT *, CAST(toks AS DOUBLE) / CAST(ws AS DOUBLE) * weight > cap AS filled FROM S2),
S4 AS (
  SELECT *, CASE WHEN filled THEN CAST(cap AS DOUBLE) ELSE CAST(total - coalesce(sum(cap) FILTER (filled) OVER (), 0) AS DOUBLE)
    / CAST(sum(weight) FILTER (NOT filled) OVER () AS DOUBLE) * weight END AS target
  FROM S3
), Q AS (
  SELECT source, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, turn) AS r, total AS seats
  FROM S4, LATERAL (SELECT unnest(range(CAST(floor(target) AS BIGINT) + 2)) AS k) WHERE target > 0
), S5 AS (
  SELECT S4.*, (SELECT count(*) FROM Q WHERE Q.source IS NOT DISTINCT FROM S4.source AND r <= seats) AS quota FROM S4
), C0 AS (SELECT source, shard, sum(size)::BIGINT AS words FROM D GROUP BY ALL),
CQ AS (
  SELECT C0.source, C0.shard, row_number() OVER (PARTITION BY C0.source ORDER BY words / (2 * k + 1) DESC, C0.shard) AS r, quota
  FROM C0 JOIN S5 ON C0.source IS NOT DISTINCT FROM S5.source,
    LATERAL (SELECT unnest(range(CAST(floor(quota * words / source_size) AS BIGINT) + 2)) AS k) WHERE words > 0
), CN AS (SELECT source, shard, count(*) AS blocks FROM CQ WHERE r <= quota GROUP BY ALL),
C AS (
  SELECT C0.source, C0.shard, words, source_size, target, least(coalesce(blocks, 0), 3 * words) AS quota,
    CAST('0x' || substr(md5('17:' || coalesce(C0.source, '') || ':' || C0.shard), 1, 8) AS BIGINT)
      % greatest(1, words) AS start
  FROM C0 JOIN S5 ON C0.source IS NOT DISTINCT FROM S5.source LEFT JOIN CN ON CN.source IS NOT DISTINCT FROM C0.source AND CN.shard = C0.shard
), P AS (
  SELECT D.*, sum(size) OVER (PARTITION BY source, shard ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT - size AS pos FROM D
), T AS (
  SELECT P.*, C.* EXCLUDE (source, shard), CASE WHEN words > 0 THEN quota % words ELSE 0 END AS rest
  FROM P JOIN C ON P.source IS NOT DISTINCT FROM C.source AND P.shard = C.shard
)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size = 0 THEN 0 ELSE size * (quota // words)
    + greatest(0, least(pos + size, start + rest) - greatest(pos, start))
    + greatest(0, least(pos + size, start + rest - words) - greatest(pos, 0)) END AS BIGINT) AS taken
FROM T"""


# no masks: alignments with enough equal tokens, and in them each window of 16 tokens, or the whole item
OP8 = r"""
WITH DW AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
IW AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
DT AS (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS i FROM DW),
IT AS (SELECT item_id, unnest(w) AS t, unnest(range(len(w))) AS j FROM IW),
A AS (
  SELECT doc_id, item_id, i - j AS start FROM DT JOIN IT USING (t) GROUP BY ALL HAVING count(*) >= 10
), X AS (
  SELECT A.*, least(16, len(IW.w)) AS ww, CASE WHEN len(IW.w) < 12 THEN 100 ELSE 80 END AS percent,
    greatest(-start, 0) AS a, least(len(IW.w), len(DW.w) - start) AS b, DW.w AS d, IW.w AS t
  FROM A JOIN DW USING (doc_id) JOIN IW USING (item_id)
  UNION ALL -- shorter items occur whole
  SELECT doc_id, item_id, i, len(IW.w), 100, 0, len(IW.w), DW.w, IW.w
  FROM IW JOIN DT ON DT.t = IW.w[1] JOIN DW USING (doc_id) WHERE len(IW.w) < 10 AND DW.w[i + 1 : i + len(IW.w)] = IW.w
), Y AS (
  SELECT *, list_transform(range(a, b), lambda i: CAST(d[start + i + 1] = t[i + 1] AS INTEGER)) AS same FROM X
), Z AS (
  SELECT *, list_bool_or(list_transform(range(0, len(same) - ww + 1), lambda s: 100 * list_sum(same[s + 1 : s + ww]) >= percent * ww)) AS ok FROM Y
), B AS (
  SELECT doc_id, item_id, start, CAST(list_sum(same) AS BIGINT) AS matched, CAST(len(same) AS BIGINT) AS compared FROM Z WHERE ok
)
SELECT doc_id, item_id, matched, compared, CAST(start AS BIGINT) AS start FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, abs(start), compared DESC, start DESC) AS r FROM B
) WHERE r = 1"""

OP9 = rf"""
WITH RECURSIVE W AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents
), S AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM W WHERE len(w) > 0)
), N AS (SELECT doc_id, count(*) AS n FROM S GROUP BY doc_id),
P AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM S x JOIN S y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
L AS (SELECT a, b FROM P JOIN N x ON x.doc_id = a JOIN N y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
REACH AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT REACH.a, L.b FROM REACH JOIN L ON L.a = REACH.b
)
SELECT documents.doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(b) FROM REACH WHERE REACH.a = documents.doc_id) AS component_id
FROM documents LEFT JOIN N USING (doc_id)"""

# a run: three lines, or one or two with more than 50 words
OP10 = rf"""
WITH L AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS l,
    list_transform(string_split(text, chr(10)), lambda x: len(regexp_extract_all(x, '{_WORD}'))) AS w FROM documents
), P AS (SELECT doc_id, l, w, unnest(range(1, len(l) + 1)) AS i, unnest(range(1, len(l) + 1)) AS j FROM L),
R AS (
  SELECT doc_id, i, n, '1' AS kind, md5(l[i]) AS r FROM P, (SELECT 1 AS n) WHERE w[i] > 50
  UNION ALL
  SELECT doc_id, i, n, '2', md5(l[i]) || md5(l[i + 1]) FROM P, (SELECT 2 AS n) WHERE i < len(l) AND w[i] + w[i + 1] > 50
  UNION ALL
  SELECT doc_id, i, n, '3', md5(l[i]) || md5(l[i + 1]) || md5(l[i + 2]) FROM P, (SELECT 3 AS n) WHERE i + 1 < len(l)
), F AS (SELECT *, row_number() OVER (PARTITION BY kind, r ORDER BY doc_id, i) AS k FROM R),
G AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + n)))) AS gone FROM F WHERE k > 1 GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(CASE WHEN gone IS NULL THEN text ELSE array_to_string(
    list_transform(list_filter(range(1, len(l) + 1), lambda i: NOT list_contains(gone, i)), lambda i: l[i]), chr(10)) END, '')) AS kept_sha256
FROM L LEFT JOIN G USING (doc_id)"""


def _clusters(clusters: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """Centroid clustering, one pair of tables a round."""
    nearest = """N{0} AS MATERIALIZED (
  SELECT vec_id, x, CAST(cluster AS INTEGER) AS cluster, dist FROM (
    SELECT V.vec_id, V.x, V.rid, C.cluster, list_sum(list_transform(range(1, {1}), lambda i: (V.x[i] - C.at[i]) * (V.x[i] - C.at[i]))) AS dist
    FROM V, C{0} C
  ) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY dist, cluster) = 1
)"""
    nearest = nearest.replace("{1}", str(dims + 1))
    tables = [
        f"""V AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda v: CAST(floor({scale}.0::DOUBLE * CAST(v AS DOUBLE)) AS HUGEINT)) AS x
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda v: isfinite(v))) = {dims}
)""",
        f"""C0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), x) - 1 AS cluster, x AS at FROM V
  QUALIFY row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), x) <= {clusters}
)""",
    ]
    for i in range(rounds):
        tables += [
            nearest.replace("{0}", str(i)),
            f"""S{i} AS (
  SELECT cluster, pos, sum(v) AS s, CAST(count(*) AS HUGEINT) AS n FROM (SELECT cluster, unnest(range(1, {dims + 1})) AS pos, unnest(x) AS v FROM N{i}) GROUP BY ALL
), M{i} AS (
  SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS HUGEINT) ORDER BY pos) AS at FROM S{i} GROUP BY cluster
), C{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(M{i}.at, C{i}.at) AS at FROM C{i} LEFT JOIN M{i} USING (cluster))""",
        ]
    tables.append(nearest.replace("{0}", str(rounds)))
    return "WITH " + ", ".join(tables) + f"""
SELECT vec_id, cluster, CAST(dist AS BIGINT) AS distance, CAST(sum(dist) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(dist) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(C.at, lambda v: CAST(v AS VARCHAR)), ',')) AS centroid_sha256
FROM N{rounds} JOIN C{rounds} C USING (cluster)"""


OP12 = _clusters()


def _manifest(levels: int = 6, fanout: int = 16) -> str:
    """A Merkle tree per source and one over the sources, up to ``fanout ** levels`` leaves each."""

    def value(x: str) -> str:
        return f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(value(x) for x in ('doc_id', 'source', 'lang', 'n_chars', text))})"

    def climb(k: int, name: str) -> list[str]:
        """Table name_k has g, idx, digest; lone nodes stay what they are on the next level."""
        return [
            f"""{name}{k + 1} AS MATERIALIZED (
  SELECT g, idx // {fanout} AS idx, CASE WHEN max(total) = 1 THEN max(digest) ELSE sha256(string_agg(digest, '' ORDER BY idx)) END AS digest
  FROM (SELECT *, count(*) OVER (PARTITION BY g) AS total FROM {name}{k}) GROUP BY g, idx // {fanout}
), {name}P{k} AS MATERIALIZED (
  SELECT a.g, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
    coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r, (SELECT count(*) FROM {name}{k} t WHERE t.g = a.g) AS total
  FROM {name}{k} a JOIN {name}{k} b ON a.g = b.g AND a.idx // {fanout} = b.idx // {fanout} GROUP BY a.g, a.idx
)"""
        ]

    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = """xor(list_reduce(list_transform(range(len(CAST(doc_id AS VARCHAR))), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(i + 1 AS BIGINT), 1)) AS BIGINT)),
      lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS BIGINT)]), CAST(4294967295 AS BIGINT)), 4294967295)"""
    tables = [
        _CRC.split(", HEXED")[0].strip(),
        f"""L AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || source, '-') AS g, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(low)} ELSE {leaf('text')} END AS found
  FROM documents, MACRO_TABLE
), D AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM L),
A0 AS MATERIALIZED (SELECT g, idx, leaf AS digest FROM D)""",
    ]
    for k in range(levels):
        tables += climb(k, "A")
    tables.append(f"B0 AS MATERIALIZED (SELECT 'all' AS g, row_number() OVER (ORDER BY g) - 1 AS idx, digest, g AS source FROM A{levels})")
    for k in range(levels):
        tables += climb(k, "B")
    fold = "CASE WHEN p.total = 1 THEN {h} ELSE sha256(p.l || {h} || p.r) END"
    proof = "CASE WHEN p.total = 1 THEN proof ELSE proof || p.l || p.r END"
    tables.append("F0 AS (SELECT doc_id, leaf, g, idx AS place, found AS h, '' AS proof FROM D)")
    for k in range(levels):
        tables.append(
            f"F{k + 1} AS MATERIALIZED (SELECT doc_id, leaf, F{k}.g, place // {fanout} AS place, {fold.format(h='h')} AS h, {proof} AS proof FROM F{k} JOIN AP{k} p ON p.g = F{k}.g AND p.idx = place)"
        )
    tables.append(f"G0 AS (SELECT doc_id, leaf, F.g, B0.idx AS place, B0.digest AS subroot, h, proof FROM F{levels} F JOIN B0 ON B0.source = F.g)")
    for k in range(levels):
        tables.append(f"G{k + 1} AS MATERIALIZED (SELECT doc_id, leaf, G{k}.g, place // {fanout} AS place, subroot, {fold.format(h='h')} AS h, {proof} AS proof FROM G{k} JOIN BP{k} p ON p.idx = place)")
    return "WITH " + ", ".join(tables) + f"""
SELECT doc_id, leaf, subroot, R.digest AS root, sha256(proof) AS proof_sha256, h AS folded_root, h = R.digest AS verified FROM G{levels}, B{levels} R"""


OP13 = _manifest()

SQL = {
    "op2_sharding": OP2, "op7_mixing": OP7, "op8_decontamination": OP8, "op9_jaccard_join": OP9, "op10_line_dedup": OP10,
    "op12_centroids": OP12, "op13_merkle": OP13,
}
