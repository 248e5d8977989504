"""SQL of the queries that SQL can express, for an independent engine on the same tables."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(column: str) -> str:
    """Lower-cased (A-Z only) runs of letters, digits and non-ASCII characters."""
    text = f"translate(coalesce({column}, ''), '{UPPER}', '{LOWER}')"
    return rf"regexp_extract_all({text}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


# base32 of the SHA-1: five hexadecimal digits are four base32 digits
WARC_REVISITS = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT page_id, n, array_to_string([('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')[1 + CAST(
        (('0x' || substr(hex, 1 + 5 * (i // 4), 5))::INTEGER >> (15 - 5 * (i % 4))) & 31 AS INTEGER)] for i in range(32)], '') AS digest
      FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM (SELECT *, min(page_id) OVER (PARTITION BY digest, n) AS first FROM d)
"""

# every window of the items' words at every place of the documents
BENCHMARK_HITS = f"""
WITH doc AS (SELECT doc_id, {words('text')} AS w FROM documents),
item AS (SELECT DISTINCT item_id, {words('text')} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, list_slice(w, i, i + 9) AS words
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT len(words) AS n FROM win),
place AS (SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS words
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, lengths WHERE len(w) >= n)),
found AS (SELECT p.doc_id, p.i, p.n, win.item_id FROM place p JOIN win ON p.words = win.words),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM found) GROUP BY doc_id),
owner AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(o.n_items, 0) AS n_items,
       sha256(coalesce(o.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN hit h ON d.doc_id = h.doc_id LEFT JOIN owner o ON d.doc_id = o.doc_id
"""

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _floor_mean(total: str, n: str) -> str:
    """Whole-number division that rounds down for negative sums too."""
    return f"CAST(({total} - (({total} % {n}) + {n}) % {n}) // {n} AS BIGINT)"


def mean_order_clusters(rounds: int = 10, k: int = 8, width: int = 64) -> str:
    """All distances of every round, without any search order."""
    steps = [f"""kept AS MATERIALIZED (SELECT vec_id, CAST(i AS INTEGER) AS i, CAST(floor(1024 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x
  FROM embeddings, range(1, {width + 1}) r(i) WHERE len(embedding) = {width} AND {_FINITE}),
c0 AS MATERIALIZED (SELECT cluster, i, x AS c FROM kept JOIN (
  SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR))) - 1 AS cluster
  FROM (SELECT DISTINCT vec_id FROM kept) QUALIFY cluster < {k}) USING (vec_id))"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, min({{'d': d, 'cluster': cluster}}) AS best
  FROM (SELECT vec_id, cluster, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM kept JOIN c{r} USING (i) GROUP BY vec_id, cluster) GROUP BY vec_id)""")
        if r < rounds:
            mean = _floor_mean("sum(x)", "count(*)")
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT cluster, i, coalesce(m, c) AS c FROM c{r} LEFT JOIN (
  SELECT best.cluster AS cluster, i, {mean} AS m FROM kept JOIN a{r} USING (vec_id) GROUP BY ALL) USING (cluster, i))""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(best.cluster AS INTEGER) AS cluster, best.d AS distance,
       CAST(sum(best.d) OVER (PARTITION BY best.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN (SELECT cluster, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster) f
  ON f.cluster = best.cluster"""


def pivot_codes(rounds: int = 2, entries: int = 64, parts: int = 16, step: int = 4) -> str:
    """All distances between parts and entries, for vectors of one length (``parts * step``)."""
    places = range(step)
    cut = ", ".join(f"CAST(floor(256 * CAST(embedding[{step} * part + {j + 1}] AS DOUBLE)) AS BIGINT) AS x{j}" for j in places)
    apart = " + ".join(f"(x{j} - c{j}) * (x{j} - c{j})" for j in places)
    steps = [f"""kept AS MATERIALIZED (SELECT vec_id, label, embedding FROM embeddings WHERE {_FINITE}),
part AS MATERIALIZED (SELECT vec_id, CAST(part AS INTEGER) AS part, {cut} FROM kept, range({parts}) r(part)),
b0 AS MATERIALIZED (SELECT part, entry, {", ".join(f"x{j} AS c{j}" for j in places)} FROM part JOIN (
  SELECT vec_id, CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS entry FROM kept QUALIFY entry < {entries}) USING (vec_id))"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, part, min({{'d': {apart}, 'entry': entry}}) AS best
  FROM part JOIN b{r} USING (part) GROUP BY vec_id, part)""")
        if r < rounds:
            means = ", ".join(f"{_floor_mean(f'sum(x{j})', 'count(*)')} AS m{j}" for j in places)
            steps.append(f"""b{r + 1} AS MATERIALIZED (SELECT part, entry, {", ".join(f"coalesce(m{j}, c{j}) AS c{j}" for j in places)}
  FROM b{r} LEFT JOIN (SELECT part, best.entry AS entry, {means} FROM part JOIN a{r} USING (vec_id, part) GROUP BY ALL) USING (part, entry))""")
    listed = ", ".join(f"CAST(c{j} AS VARCHAR)" for j in places)
    return "WITH " + ",\n".join(steps) + f""",
coded AS (SELECT vec_id, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error
  FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(concat_ws(',', {listed}), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)"""


MEAN_ORDER_CLUSTERS, PIVOT_CODES = mean_order_clusters(), pivot_codes()
