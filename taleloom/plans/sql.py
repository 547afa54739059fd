"""The derived tables as DuckDB SQL: what the oracles start from."""

from __future__ import annotations

from taleloom.functions.constants import COLORS, GREY, KINDS
from taleloom.functions.titles import TITLE, TRIM, VALID_PAIRS, WS

PALETTE_SQL = "['#ef4444', '#f97316', '#eab308', '#22c55e', '#14b8a6', '#3b82f6', '#8b5cf6', '#ec4899']"
KINDS_SQL = ", ".join(f"'{k}'" for k in KINDS)
PAIRS_SQL = ", ".join(f"'{p}'" for p in VALID_PAIRS)
COLOR_CASE = "CASE {} " + " ".join(f"WHEN '{k}' THEN '{c}'" for k, c in COLORS.items()) + f" ELSE '{GREY}' END"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '{TRIM}', '', 'g')"


def entity_id(kind: str, label: str) -> str:
    return f"{kind} || ':' || upper(regexp_replace({trim(label)}, '{WS}+', '_', 'g'))"


NOTES = r"""
items AS (SELECT l_orderkey, string_agg(item, '. ' ORDER BY l_linenumber, item) AS items
          FROM (SELECT l_orderkey, l_linenumber, '[ITEM:KEY|' || p_name || '] by [FACTION:GUILD|' || p_brand || ']' AS item FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY l_orderkey),
notes AS (SELECT 'n' || k AS id, k AS ord,
                 CASE k % 50 WHEN 3 THEN '[FOO|Order ' || k || ']' WHEN 7 THEN '[CHARACTER:CITY|Order ' || k || ']' WHEN 9 THEN ' [LOCATION] ' WHEN 11 THEN '[ITEM:KEY]'
                             WHEN 13 THEN '[SCENE| padded ' || k || ' ]' WHEN 15 THEN '[EVENT|Order ' || k WHEN 17 THEN '[EVENT|' WHEN 19 THEN '[NPC|Order ' || k || '|x]'
                             ELSE CASE WHEN k % 2 = 0 THEN '[EVENT:MEETING|Order ' || k || ']' ELSE 'Order ' || k END END AS title,
                 '[CHARACTER|' || c_name || '] of [LOCATION:COUNTRY|' || n_name || '] #' || c_mktsegment || ' [[Order ' || (k - 1) || ']] @' || lower(c_mktsegment) || coalesce('. ' || items, '') AS content,
                 CASE WHEN k % 10 = 0 THEN NULL WHEN k % 97 = 0 THEN 'nowhere' ELSE 's' || c_nationkey || '-' || c_mktsegment END AS folder_id,
                 lower(c_mktsegment) AS tag, k % 10 = 1 AS favorite, o_orderdate AS created_at, c_name AS customer
          FROM (SELECT o_orderkey AS k, * FROM orders) LEFT JOIN items ON k = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
"""

FOLDERS = r"""
folders AS (SELECT 'r' || r_regionkey AS id, CASE WHEN r_regionkey % 2 = 0 THEN '[LOCATION:CONTINENT]' ELSE '[LOCATION]' END AS name, NULL::VARCHAR AS parent_id,
                   CASE WHEN r_regionkey = 0 THEN '#000000' END AS color, r_regionkey::BIGINT AS ord FROM region
            UNION ALL SELECT 'f' || n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN '[LOCATION:COUNTRY|' || n_name || ']' WHEN 1 THEN n_name ELSE '[FACTION|' || n_name || ']' END,
                   CASE WHEN n_nationkey = 24 THEN 'gone' ELSE 'r' || n_regionkey END, CASE WHEN n_nationkey % 7 = 0 THEN '#123456' END, n_nationkey + 100 FROM nation
            UNION ALL SELECT DISTINCT 's' || c_nationkey || '-' || c_mktsegment, c_mktsegment, 'f' || c_nationkey, NULL, c_nationkey + 1000 FROM customer
            UNION ALL VALUES ('x0', 'ring', 'x1', NULL, 5000), ('x1', 'ring', 'x0', NULL, 5001))
"""


def parsed(source: str, column: str, name: str) -> str:
    """CTEs that end in `name`: source with kind, subtype and label."""
    return f"""
{name}_m AS (SELECT *, {trim(column)} AS t_ FROM {source}),
{name}_g AS (SELECT *, regexp_matches(t_, '{TITLE}') AS m_, regexp_extract(t_, '{TITLE}', 1) AS k_, regexp_extract(t_, '{TITLE}', 2) AS s_, regexp_extract(t_, '{TITLE}', 3) AS l_ FROM {name}_m),
{name}_o AS (SELECT *, m_ AND k_ IN ({KINDS_SQL}) AND (s_ = '' OR k_ || ':' || s_ IN ({PAIRS_SQL})) AS ok_ FROM {name}_g),
{name} AS (SELECT * EXCLUDE (t_, m_, k_, s_, l_, ok_), CASE WHEN ok_ THEN k_ END AS kind, CASE WHEN ok_ AND s_ <> '' THEN s_ END AS subtype, CASE WHEN ok_ AND l_ <> '' THEN {trim('l_')} END AS label FROM {name}_o)
"""


DERIVED = NOTES + "," + parsed("notes", "title", "pn") + """,
derived AS (SELECT * EXCLUDE (kind, subtype, label), coalesce(label, '') <> '' AS is_entity, CASE WHEN coalesce(label, '') <> '' THEN kind END AS entity_kind,
                   CASE WHEN coalesce(label, '') <> '' THEN subtype END AS entity_subtype, CASE WHEN coalesce(label, '') <> '' THEN label END AS entity_label FROM pn)
"""

TYPED = FOLDERS + "," + parsed("folders", "name", "typed")

TREE = TYPED + """,
tree AS (SELECT id, 0 AS depth, id AS path, color, kind, subtype, NULL::VARCHAR AS inherited_kind, NULL::VARCHAR AS inherited_subtype, NULL::VARCHAR AS parent_color
         FROM typed WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM folders)
         UNION ALL
         SELECT f.id, t.depth + 1, t.path || '/' || f.id, f.color, f.kind, f.subtype, coalesce(t.kind, t.inherited_kind), coalesce(t.subtype, t.inherited_subtype), t.color
         FROM tree t JOIN typed f ON f.parent_id = t.id),
full_folders AS (SELECT f.*, t.inherited_kind, t.inherited_subtype FROM typed f LEFT JOIN tree t ON f.id = t.id)
"""

NOTE_FOLDER = DERIVED + "," + TREE + """,
placed AS (SELECT d.*, coalesce(f.kind, f.inherited_kind) AS folder_kind, coalesce(f.subtype, f.inherited_subtype) AS folder_subtype, f.id AS found_folder FROM derived d LEFT JOIN full_folders f ON d.folder_id = f.id)
"""


def with_(ctes: str, select: str, recursive: bool = True) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes.strip().rstrip(',')} {select}"
