"""DuckDB SQL for the queries that SQL can express.

The others rest on a hash, a tokenizer, a trained model or a random rounding that SQL lacks; their tests
compare them with plain Python.
"""

from __future__ import annotations

from .sharding import even_tree, with_new_shard

WORD = r"[^\x20\x09-\x0D]+"


def _tree_values(tree) -> str:
    rows = [f"('{region}', '{rack}', {number}, {weight})" for region, racks in tree.items()
            for rack, shards in racks.items() for number, weight in shards.items()]
    return ", ".join(rows)


def _descent(tree, name: str) -> str:
    """CTEs that place every key in ``tree``: one draw for each child of each chosen node."""
    draw = ("arg_min({child}, -ln((CAST(('0x' || substr(md5(k.key || '|' || {label}), 1, 13)) AS BIGINT) + 0.5) "
            "/ 4503599627370496.0) / w)")
    return f"""
{name}_tree(region, rack, shard, weight) AS (VALUES {_tree_values(tree)}),
{name}_regions AS (SELECT region, sum(weight) AS w FROM {name}_tree GROUP BY 1),
{name}_racks AS (SELECT region, rack, sum(weight) AS w FROM {name}_tree GROUP BY 1, 2),
{name}_region AS (SELECT k.key, {draw.format(child='region', label='region')} AS region
  FROM keys k, {name}_regions GROUP BY 1),
{name}_rack AS (SELECT k.key, {draw.format(child='r.rack', label='r.rack')} AS rack
  FROM {name}_region k JOIN {name}_racks r ON r.region = k.region GROUP BY 1),
{name}_shard AS (SELECT k.key, {draw.format(child='t.shard', label="'shard' || t.shard").replace('/ w)', '/ t.weight)')} AS shard
  FROM {name}_rack k JOIN {name}_tree t ON t.rack = k.rack GROUP BY 1)"""


_BASE = even_tree()

SHARDS = f"""
WITH items AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, text,
    coalesce(CAST(doc_id AS VARCHAR), 'null') AS key FROM documents),
keys AS (SELECT DISTINCT key FROM items),{_descent(_BASE, 'now')},{_descent(with_new_shard(_BASE), 'grown')}
SELECT r.doc_id, r.size, 'key' AS law, CAST(n.shard AS INTEGER) AS shard, CAST(g.shard AS INTEGER) AS grown_shard
FROM items r JOIN now_shard n USING (key) JOIN grown_shard g USING (key)"""

QUALITY = rf"""
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT rid, doc_id, text, regexp_extract_all(text, '{WORD}') AS words,
    [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '{WORD}')] AS lines FROM texts),
spots AS (SELECT rid, words, unnest(range(1, len(words) - 1)) AS pos FROM split WHERE len(words) > 2),
grams AS (SELECT rid, pos, words[pos] || ' ' || words[pos + 1] || ' ' || words[pos + 2] AS gram FROM spots),
often AS (SELECT rid, pos FROM grams QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
inside AS (SELECT rid, count(DISTINCT pos + k) AS n FROM often, range(3) AS o(k) GROUP BY rid),
counted AS (SELECT s.rid, doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(i.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines,
    length(text) - length(regexp_replace(text, '[!?]', '', 'g')) AS n_marks,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals,
    length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) AS n_letters
  FROM split s LEFT JOIN inside i USING (rid)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 30 * n_words OR 100 * n_dup_lines > 50 * n_lines
    OR 100 * n_capitals > 60 * n_letters OR 100 * n_marks > 50 * n_words
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM failed"""


def _clusters(count: int, rounds: int, dimensions: int, scale: int) -> str:
    """Exact rounds over whole numbers: the nearest centroid, then floors of the means."""
    distance = ("list_sum(list_transform(list_zip(v.parts, c.parts), "
                "lambda p: CAST((p[1] - p[2]) * (p[1] - p[2]) AS BIGINT)))")

    def assign(k: int) -> str:
        return f"""
near{k} AS (SELECT id, any_value(v.vec_id) AS vec_id, any_value(v.parts) AS parts,
  min(struct_pack(distance := CAST({distance} AS BIGINT), cluster := c.cluster)) AS best
  FROM vectors v, centre{k} c GROUP BY id)"""

    def move(k: int) -> str:
        return f"""
total{k} AS (SELECT best.cluster AS cluster, d, CAST(floor(sum(parts[d]) / count(*)) AS BIGINT) AS part
  FROM near{k}, range(1, {dimensions + 1}) AS t(d) GROUP BY ALL),
centre{k + 1} AS (SELECT c.cluster, coalesce(list(part ORDER BY d) FILTER (part IS NOT NULL), any_value(c.parts)) AS parts
  FROM centre{k} c LEFT JOIN total{k} USING (cluster) GROUP BY c.cluster)"""

    steps = ",".join(f"{assign(k)},{move(k)}" for k in range(rounds))
    return f"""
WITH vectors AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id,
    list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT)) AS parts FROM embeddings
  WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: isfinite(x))) = {dimensions}),
centre0 AS (SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS cluster, parts
  FROM (SELECT sha256('1:' || vec_id) AS h, parts FROM vectors ORDER BY h LIMIT {count})),{steps},{assign(rounds)},
cost AS (SELECT best.cluster AS cluster, CAST(sum(best.distance) AS BIGINT) AS cluster_inertia FROM near{rounds} GROUP BY 1)
SELECT n.vec_id, n.best.cluster AS cluster, n.best.distance AS distance, cost.cluster_inertia,
  (SELECT CAST(sum(cluster_inertia) AS BIGINT) FROM cost) AS inertia,
  sha256(array_to_string(c.parts, ',')) AS centroid_sha256
FROM near{rounds} n JOIN cost ON cost.cluster = n.best.cluster JOIN centre{rounds} c ON c.cluster = n.best.cluster"""


_ODD_CHAT = r"\### Assistant: </turn> ok"

# a turn: "### role", line end, text, line end, "</turn>", line end; a backslash before "### " and "</turn>" in texts
CHATS = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{_ODD_CHAT}'), (-7, 1, 'assistant', '{_ODD_CHAT}'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(14 + length(role) + length(text) + (length(text) - length(replace(text, '### ', ''))) // 4
    + (length(text) - length(replace(text, '</turn>', ''))) // 7) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""

ORACLES = {"op9_quality": QUALITY, "op12_clusters": _clusters(16, 3, 64, 64), "op13_chats": CHATS}
