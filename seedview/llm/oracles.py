"""DuckDB SQL for the text queries that SQL can express: chat formatting, host rules, the Merkle manifest
and centroid clustering.

The others learn models, hash with functions that SQL lacks, or build indexes; they are tested against
brute force.
"""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

_CHAT = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *,
    length(text) + length(regexp_replace(text, '[^\\]', '', 'g')) + length(text)
      - length(regexp_replace(text, '#{3,}', '', 'g')) + (length(text) - length(replace(text, '</turn>', ''))) // 7 AS chars
  FROM rows
)
SELECT conv_id,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars + length(role) + 14) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

_FAILS = {
    "short": "n_words < 20",
    "repeats": "100 * n_repeat_words > 30 * n_words",
    "symbols": "100 * n_symbols > 10 * word_chars",
    "lines": "100 * n_dup_lines > 30 * n_lines",
    "upper": "100 * n_upper > 50 * word_chars",
    "long_words": "word_chars > 25 * n_words",
}


def _host_rules() -> str:
    each = lambda form: ",\n  ".join(form.format(n=name, fail=fail) for name, fail in _FAILS.items())
    return rf"""
WITH texts AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS run FROM texts, unnest(range(1, len(ws) - 6)) AS r(i)
), twice AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, run) > 1
), again AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(8) AS r(k) GROUP BY doc_id
), counts AS (
  SELECT t.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS filled,
    coalesce(a.n, 0) AS n_repeat_words
  FROM texts t LEFT JOIN again a USING (doc_id)
), lines AS (
  SELECT *, len(filled) AS n_lines, CAST(len(filled) - len(list_distinct(filled)) AS BIGINT) AS n_dup_lines FROM counts
), failed AS (
  SELECT *, {each("{fail} AS fail_{n}")} FROM lines
), hosts AS (
  SELECT source, count(*) AS n, {each("sum(CAST(fail_{n} AS INT)) / count(*) AS r_{n}")} FROM failed GROUP BY source
), moments AS (
  SELECT avg(1 / n) AS noise, {each("avg(r_{n}) AS m_{n}, coalesce(var_samp(r_{n}), 0) AS v_{n}")} FROM hosts
), extra AS (
  SELECT *, {each("v_{n} - m_{n} * (1 - m_{n}) * noise AS x_{n}")} FROM moments
), prior AS (
  SELECT *, {each("CASE WHEN x_{n} > 0 THEN least(greatest(m_{n} * (1 - m_{n}) / x_{n} - 1, 1), 1000) ELSE 1000 END AS w_{n}")}
  FROM extra
), rates AS (
  SELECT source, greatest({each("(r_{n} * n + m_{n} * w_{n}) / (n + w_{n})")}) AS worst FROM hosts, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  fail_short OR fail_repeats AS base_failed,
  NOT ({" OR ".join(f"fail_{name}" for name in _FAILS)} OR worst > 0.5) AS kept
FROM failed f JOIN rates r ON f.source IS NOT DISTINCT FROM r.source
"""


def _manifest(group_levels: int = 6, top_levels: int = 4, fanout: int = 16) -> str:
    """Trees of up to ``fanout ** group_levels`` rows a source and ``fanout ** top_levels`` sources."""
    fields = lambda text: " || ".join(
        f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || {x}, '-')" for x in ("doc_id", "source", "lang", "n_chars", text)
    )
    bit = "SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END AS c FROM ({})"
    table = "SELECT i, i AS c FROM range(256) AS r(i)"
    for _ in range(8):
        table = bit.format(table)
    parts = [
        f"crc AS (SELECT list(c ORDER BY i) AS t FROM ({table}))",
        """ids AS (SELECT *, xor(4294967295, list_reduce(
    [4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS h FROM documents, crc)""",
        """texts AS (SELECT *, CASE WHEN h % 5 = 0 THEN
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other FROM ids)""",
        f"digests AS (SELECT doc_id, source, sha256({fields('text')}) AS leaf, sha256({fields('other')}) AS f FROM texts)",
        """leaves AS (SELECT *, coalesce('=' || source, '-') AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, f) - 1 AS place,
    count(*) OVER (PARTITION BY source) AS n FROM digests)""",
        "s0 AS MATERIALIZED (SELECT tree, place, n, leaf AS d FROM leaves)",
        "p0 AS (SELECT doc_id, leaf, tree, place, n, f, '' AS sib FROM leaves)",
    ]

    def climb(nodes: str, walk: str, levels: int, more: str) -> None:
        for k in range(levels):
            parts.append(
                f"""{nodes}{k + 1} AS MATERIALIZED (SELECT tree, place // {fanout} AS place, (n + {fanout - 1}) // {fanout} AS n,
    sha256(string_agg(d, '' ORDER BY place)) AS d, list(d ORDER BY place) AS ds FROM {nodes}{k} WHERE n > 1 GROUP BY ALL)"""
            )
            parts.append(
                f"""{walk}{k + 1} AS (SELECT doc_id, leaf{more}, p.tree, p.place // {fanout} AS place, (p.n + {fanout - 1}) // {fanout} AS n,
    CASE WHEN p.n > 1 THEN sha256(array_to_string(
      [CASE WHEN i = p.place % {fanout} + 1 THEN f ELSE ds[i] END for i in range(1, len(ds) + 1)], '')) ELSE f END AS f,
    CASE WHEN p.n > 1 THEN sib || array_to_string([ds[i] for i in range(1, len(ds) + 1) if i <> p.place % {fanout} + 1], '') ELSE sib END AS sib
  FROM {walk}{k} p LEFT JOIN {nodes}{k + 1} s ON p.n > 1 AND s.tree = p.tree AND s.place = p.place // {fanout})"""
            )

    climb("s", "p", group_levels, "")
    roots = " UNION ALL ".join(f"SELECT tree, d FROM s{k} WHERE n = 1" for k in range(group_levels + 1))
    parts.append(f"subroots AS MATERIALIZED (SELECT tree AS of, d, row_number() OVER (ORDER BY tree) - 1 AS place FROM ({roots}))")
    parts.append("t0 AS MATERIALIZED (SELECT '' AS tree, place, count(*) OVER () AS n, d FROM subroots)")
    parts.append(
        f"""q0 AS (SELECT doc_id, leaf, r.d AS subroot, '' AS tree, r.place, (SELECT count(*) FROM subroots) AS n, f, sib
  FROM p{group_levels} p JOIN subroots r ON r.of = p.tree)"""
    )
    climb("t", "q", top_levels, ", subroot")
    last = " UNION ALL ".join(f"SELECT d FROM t{k} WHERE n = 1" for k in range(top_levels + 1))
    parts.append(f"root AS (SELECT d AS root FROM ({last}))")
    return (
        "WITH "
        + ",\n".join(parts)
        + f"""
SELECT doc_id, leaf, subroot, root, sha256(sib) AS proof_sha256, f AS folded_root, f = root AS verified
FROM q{top_levels}, root"""
    )


def _centroids(rounds: int = 10, k: int = 8, size: int = 64) -> str:
    distance = f"CAST(list_sum([(v.x[i] - c.x[i]) * (v.x[i] - c.x[i]) for i in range(1, {size + 1})]) AS BIGINT)"
    parts = [
        f"""kept AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r,
    [CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT) for e in embedding] AS x
  FROM embeddings WHERE len(embedding) = {size} AND len([e for e in embedding if e IS NOT NULL AND isfinite(e)]) = {size})""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x
  FROM (SELECT sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, x FROM kept ORDER BY h, x LIMIT {k}))""",
    ]
    for t in range(rounds + 1):
        parts.append(
            f"""a{t} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(x) AS x, min(b).c AS c, min(b).d AS d
  FROM (SELECT r, vec_id, v.x, struct_pack(d := {distance}, c := c.c) AS b FROM kept v, c{t} c) GROUP BY r)"""
        )
        if t < rounds:
            parts.append(
                f"""m{t} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x
  FROM (SELECT c, i, sum(x[i]) AS s, count(*) AS n FROM a{t}, range(1, {size + 1}) AS g(i) GROUP BY c, i) GROUP BY c)"""
            )
            parts.append(
                f"""c{t + 1} AS MATERIALIZED (SELECT c, [CAST(e AS BIGINT) for e in coalesce(m.x, o.x)] AS x
  FROM c{t} o LEFT JOIN m{t} m USING (c))"""
            )
    return (
        "WITH "
        + ",\n".join(parts)
        + f"""
SELECT vec_id, CAST(a.c AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c USING (c)"""
    )


ORACLES: dict[str, str] = {
    "op4_host_rules": _host_rules(),
    "op8_chat_format": _CHAT,
    "op12_merkle_manifest": _manifest(),
    "op13_centroids": _centroids(),
}
