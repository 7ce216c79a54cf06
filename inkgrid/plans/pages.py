"""Queries on the structure of raw pages, and their SQL: a stack kept as a list by a recursive table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pages
from ..operators.tables import read
from .registry import query

#: Elements that all text of a page should lie in.
TAGGED = ["article", "nav", "footer", "li"]


def _list(names: list[str]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


_QUOTED = pages.TOKEN.replace("'", "''")
_BY_RULE: dict[tuple, list[str]] = {}
for _name, (_targets, _barriers) in pages.CLOSES.items():
    _BY_RULE.setdefault((tuple(_targets), tuple(_barriers)), []).append(_name)


def _choice(which: int) -> str:
    whens = " ".join(f"WHEN list_contains({_list(names)}, name) THEN {_list(list(rule[which]))}" for rule, names in _BY_RULE.items())
    return f"CASE {whens} ELSE []::VARCHAR[] END"


#: Every token with the names of the elements around it, outermost first, and their places.
TREE = f"""WITH RECURSIVE tok AS (SELECT page_id, regexp_extract_all(html, '{_QUOTED}') AS t FROM pages WHERE html IS NOT NULL),
flat AS (SELECT page_id, unnest(t) AS token, unnest(range(len(t)))::INT AS node FROM tok),
named AS (SELECT *, lower(regexp_extract(token, '{pages.NAME}', 1)) AS name FROM flat),
ruled AS (SELECT *, {_choice(0)} AS targets, {_choice(1)} AS barriers FROM named),
walk AS (SELECT page_id, -1 AS node, []::VARCHAR[] AS around, []::INT[] AS places, []::VARCHAR[] AS next_around, []::INT[] AS next_places FROM tok
  UNION ALL
  SELECT page_id, node, around, places,
    CASE WHEN opens THEN list_append(around, name) ELSE around END, CASE WHEN opens THEN list_append(places, node) ELSE places END
  FROM (SELECT page_id, node, name, kept.next_around[1:keep] AS around, kept.next_places[1:keep] AS places,
      name <> '' AND name[1] <> '/' AND NOT list_contains({_list(pages.VOID + pages.RAW)}, name) AS opens
    FROM (SELECT r.page_id, r.node, r.name, w.next_around, w.next_places,
        CASE WHEN r.name[1] = '/' THEN coalesce(list_max(list_filter(range(1, len(w.next_around) + 1), lambda i: w.next_around[i] = r.name[2:])) - 1, len(w.next_around))
          WHEN coalesce(list_max(list_filter(range(1, len(w.next_around) + 1), lambda i: list_contains(r.targets, w.next_around[i]))), 0) > coalesce(list_max(list_filter(range(1, len(w.next_around) + 1), lambda i: list_contains(r.barriers, w.next_around[i]))), 0)
            THEN list_max(list_filter(range(1, len(w.next_around) + 1), lambda i: list_contains(r.targets, w.next_around[i]))) - 1
          ELSE len(w.next_around) END AS keep
      FROM walk w JOIN ruled r ON r.page_id = w.page_id AND r.node = w.node + 1) kept) s),
nodes AS (SELECT w.page_id, w.node, CASE WHEN n.name = '' THEN '#text' ELSE n.name END AS name, n.token, w.around, w.places, coalesce(w.places[len(w.places)], -1) AS parent, len(w.around)::INT AS depth
  FROM walk w JOIN named n USING (page_id, node) WHERE NOT regexp_matches(n.token, '^<[!?]') AND NOT starts_with(n.name, '/'))"""

_TEXT = "trim(replace(replace(replace(replace(replace(regexp_replace(token, '[ \\t\\n\\r\\f]+', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&nbsp;', chr(160)), '&amp;', '&'))"


@query(f"""{TREE} SELECT page_id, node, name, parent, depth, CASE WHEN name = '#text' THEN length({_TEXT}) ELSE 0 END AS n_chars FROM nodes""")
def r13_page_nodes(spark, sf_dir):
    """One row for each element and text of a page, with the element around it and its depth."""
    nodes = pages.page_nodes(read(spark, sf_dir, "pages"))
    return nodes.select("page_id", "node", "name", "parent", "depth", F.when(F.col("name") == "#text", F.length(pages.visible_text(F.col("token")))).otherwise(0).cast("long").alias("n_chars"))


_STYLE = "lower(regexp_extract(token, '(?is)^<[^>]*\\sstyle\\s*=\\s*\"([^\"]*)\"', 1))"


#: Nodes with how many hiding and tagged elements lie around each.
SEEN = f"""{TREE}, own AS (SELECT page_id, node, name <> '#text' AND (list_contains({_list(pages.HIDDEN)}, name) OR regexp_matches(token, '(?i)^<[^>]*\\shidden(\\s|>|/|=)') OR regexp_matches({_STYLE}, 'display\\s*:\\s*none|visibility\\s*:\\s*hidden')) AS hides, list_contains({_list(TAGGED)}, name) AS tagged FROM nodes),
hiding AS (SELECT page_id, list(node) FILTER (hides) AS h, list(node) FILTER (tagged) AS t FROM own GROUP BY page_id),
seen AS (SELECT n.*, name <> '#text' AS element, CASE WHEN name = '#text' THEN {_TEXT} ELSE '' END AS text, len(list_intersect(places, coalesce(h, []))) AS nh, len(list_intersect(places, coalesce(t, []))) AS nt, list_contains({_list(TAGGED)}, name) AS tagged, CASE WHEN name = 'style' THEN token ELSE '' END AS css FROM nodes n JOIN hiding USING (page_id))"""


@query(f"""{SEEN}
SELECT page_id, count(*) FILTER (element)::BIGINT AS elements, max(depth)::INT AS deepest, count(*) FILTER (list_contains({_list(pages.FORBIDDEN)}, name))::BIGINT AS forbidden,
  (count(*) FILTER (regexp_matches({_STYLE}, 'background[^;]*url\\(')) + sum(len(regexp_extract_all(css, '(?i)background[^;}}]*url\\('))))::BIGINT AS background_images,
  sum(len(regexp_extract_all(css, '(?i)::?(before|after)')))::BIGINT AS generated_content, count(*) FILTER (tagged AND nt > 0)::BIGINT AS nested_tagged,
  count(*) FILTER (text <> '' AND nh = 0 AND nt = 0)::BIGINT AS untagged_texts, sum(CASE WHEN nh > 0 THEN length(text) ELSE 0 END)::BIGINT AS hidden_chars, sum(CASE WHEN nh = 0 THEN length(text) ELSE 0 END)::BIGINT AS visible_chars,
  sha256(coalesce(string_agg(text, chr(10) ORDER BY node) FILTER (text <> '' AND nh = 0), '')) AS text_sha256
FROM seen GROUP BY page_id""")
def v16_page_structure(spark, sf_dir):
    """Forbidden elements, background images, generated content, hidden and untagged text, nested tags by page."""
    return pages.page_evidence(pages.page_nodes(read(spark, sf_dir, "pages")), TAGGED)
