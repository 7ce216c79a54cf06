"""Page structure: raw HTML to one row a node (element or text), and evidence as aggregates over those rows.

Tokens are cut by one regular expression in the JVM; a small fold over their names keeps the stack of open
elements (a page is one row, so it is one value already). What lies inside what is then a running sum over the nodes of a page:
no node looks up its ancestors.

Rules of nesting: void elements have no content; script, style, title and textarea hold raw text; a start tag closes what HTML
lets it close (a paragraph before a block, a list item before a list item, and so on); an end tag closes everything up
to its element and is ignored if that is not open; the end of the page closes the rest. Formatting elements are
not opened again in the next paragraph. A null page has no nodes.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import spread

#: Pages whose nodes one task should hold.
TASK_PAGES = 1000
#: Names fixed by the HTML standard.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
RAW = ["script", "style", "title", "textarea"]
BLOCK = ["address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"]
#: start tag -> (open elements that it closes, elements that keep those behind them open)
CLOSES: dict[str, tuple[list[str], list[str]]] = {
    **{name: (["p"], ["button", "table"]) for name in BLOCK},
    "li": (["li"], ["ul", "ol"]),
    "dt": (["dt", "dd"], ["dl"]),
    "dd": (["dt", "dd"], ["dl"]),
    "tr": (["tr"], ["table"]),
    "td": (["td", "th"], ["table", "tr"]),
    "th": (["td", "th"], ["table", "tr"]),
    "option": (["option"], ["select"]),
}
FORBIDDEN = ["canvas", "img", "picture", "video", "iframe", "object", "embed", "input", "textarea", "select", "svg"]
HIDDEN = ["head", "script", "style", "title", "template", "noscript", "textarea"]

#: Comments, raw elements whole, declarations, tags (quoted values may hold ">"), text, and a lone "<".
TOKEN = (
    r"(?is)<!--.*?-->|" + "|".join(rf"<{name}\b[^>]*>.*?</{name}\s*>" for name in RAW) + r"|<[!?][^>]*>"
    r"""|</?[a-z][^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*>|[^<]+|<"""
)
NAME = r"^<(/?[a-zA-Z][a-zA-Z0-9-]*)"

_TREE = T.StructType([T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("parent", "depth", "stop")])


def open_elements(names: list[str]) -> tuple[list[int], list[int], list[int]]:
    """(parent, depth, stop) of each token from its name ("" for text, "/p" for an end tag): the place of the element around it
    (-1 for none), how many are open, and for an element the place of the token that ends it (its own if it has no
    content, the number of tokens if the page's end does)."""
    parent, depth, stop = [-1] * len(names), [0] * len(names), list(range(len(names)))
    stack: list[tuple[str, int]] = []

    def close(down_to: int, at: int) -> None:
        while len(stack) > down_to:
            stop[stack.pop()[1]] = at

    for at, name in enumerate(names):
        if name[:1] == "/":
            found = [i for i, (other, _) in enumerate(stack) if other == name[1:]]
            if found:
                close(found[-1], at)
        elif name in CLOSES:
            targets, barriers = CLOSES[name]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in targets:
                    close(i, at)
                    break
                if stack[i][0] in barriers:
                    break
        parent[at], depth[at] = (stack[-1][1] if stack else -1), len(stack)
        if name and name[0] != "/" and name not in VOID and name not in RAW:
            stack.append((name, at))
    close(0, len(names))
    return parent, depth, stop


@F.pandas_udf(_TREE)
def _tree(names: pd.Series) -> pd.DataFrame:
    rows = [open_elements(list(n)) for n in names]
    return pd.DataFrame({"parent": [r[0] for r in rows], "depth": [r[1] for r in rows], "stop": [r[2] for r in rows]})


def page_nodes(pages: DataFrame) -> DataFrame:
    """page_id, node, name ("#text" for text), parent, depth, stop, token: a row for each element and text, in page order.

    ``node`` is the place of the token in the page, so comments, declarations and end tags leave gaps. The nodes of a large table are dealt
    over tasks of as many pages each: what is told page by page shuffles none again."""
    tokens = F.regexp_extract_all("html", F.lit(TOKEN), F.lit(0))
    names = F.transform("tokens", lambda t: F.lower(F.regexp_extract(t, NAME, 1)))
    cut = pages.filter("html IS NOT NULL").select("page_id", tokens.alias("tokens")).withColumn("names", names)
    # an end tag cut off at "<", a comment or a declaration has no name either: it is no text
    placed = cut.withColumn("tree", _tree("names")).select("page_id", F.explode(F.arrays_zip("tokens", "names", "tree.parent", "tree.depth", "tree.stop", F.sequence(F.lit(0), F.size("tokens") - 1).alias("node"))).alias("n"))
    flat = placed.select("page_id", F.col("n.node").alias("node"), F.col("n.names").alias("name"), F.col("n.parent").alias("parent"), F.col("n.depth").alias("depth"), F.col("n.stop").alias("stop"), F.col("n.tokens").alias("token"))
    mark = F.col("token").rlike(r"^<[!?]") | F.col("name").startswith("/")
    nodes = flat.filter(~mark).withColumn("name", F.when(F.col("name") == "", "#text").otherwise(F.col("name")))
    return spread(nodes, "page_id", rows=TASK_PAGES, of=pages)


def attribute(token: Column, name: str) -> Column:
    """Value of an attribute of a start tag, quoted or bare; '' if it has none, null if it is absent."""
    start = F.regexp_extract(token, r"""(?s)^<[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*>""", 0)
    value = F.regexp_extract(start, rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", 0)
    bare = F.regexp_replace(F.regexp_replace(value, rf"(?is)^\s{name}\s*=\s*", ""), r"""^["']|["']$""", "")
    return F.when(value != "", bare).when(start.rlike(rf"(?i)\s{name}(\s|>|/)"), "")


def hides(name: Column, token: Column) -> Column:
    """Whether an element keeps its content from view: by its name, ``hidden``, or a style of its own."""
    style = F.coalesce(F.lower(attribute(token, "style")), F.lit(""))
    return name.isin(HIDDEN) | attribute(token, "hidden").isNotNull() | style.rlike(r"display\s*:\s*none|visibility\s*:\s*hidden")


def covered(nodes: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Adds, for each flag of elements, how many elements with it lie around a node: a running sum over starts and ends."""
    own = {c: F.when(F.coalesce(flag, F.lit(False)), 1).otherwise(0) for c, flag in flags.items()}
    opens = F.col("stop") > F.col("node")  # what has no content covers nothing
    start = F.struct(F.col("node").alias("at"), F.lit(1).alias("order"), *[F.when(opens, F.col(f"_{c}")).otherwise(0).alias(c) for c in own])
    # an element ends before the node at its stop
    end = F.struct(F.col("stop").alias("at"), F.lit(0).alias("order"), *[(-F.col(f"_{c}")).alias(c) for c in own])
    marks = reduce(lambda a, b: a | b, [F.col(f"_{c}") == 1 for c in own])
    # both are made of the row of the node, so pages are cut into tokens once; an end carries no text
    events = nodes.withColumns({f"_{c}": v for c, v in own.items()}).withColumn("_e", F.explode(F.when(opens & marks, F.array(start, end)).otherwise(F.array(start))))
    kept = [F.when(F.col("_e.order") == 1, F.col("token")).alias("token") if c == "token" else F.col(c) for c in nodes.columns]
    before = Window.partitionBy("page_id").orderBy("_e.at", "_e.order").rowsBetween(Window.unboundedPreceding, -1)
    summed = events.select(*kept, "_e").withColumns({c: F.coalesce(F.sum(f"_e.{c}").over(before), F.lit(0)) for c in flags})
    return summed.filter("_e.order = 1").select(*nodes.columns, *flags)


def visible_text(token: Column) -> Column:
    """Text of a node: blanks run together, the five basic character references read."""
    out = F.regexp_replace(token, r"[ \t\n\r\f]+", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(out)


def page_evidence(nodes: DataFrame, tagged: list[str]) -> DataFrame:
    """A row a page: forbidden elements, background images, generated content, hidden and untagged text, nesting.

    ``tagged`` names the elements that text must lie in. ``text_sha256`` is that of the visible texts in page order."""
    name, token = F.col("name"), F.col("token")
    element = name != "#text"
    style = F.coalesce(F.lower(attribute(token, "style")), F.lit(""))
    inside = covered(nodes, {"n_hiding": element & hides(name, token), "n_tagged": name.isin(tagged)})
    text = F.when(~element, visible_text(token)).otherwise("")
    seen = (text != "") & (F.col("n_hiding") == 0)
    css = F.when(name == "style", token).otherwise("")
    shown = F.filter(F.array_sort(F.collect_list(F.when(seen, F.struct("node", text.alias("text"))))), lambda x: x.isNotNull())
    return inside.groupBy("page_id").agg(
        F.count_if(element).alias("elements"),
        F.max("depth").alias("deepest"),
        F.count_if(name.isin(FORBIDDEN)).alias("forbidden"),
        (F.count_if(style.rlike(r"background[^;]*url\(")) + F.sum(F.regexp_count(css, F.lit(r"(?i)background[^;}]*url\(")))).alias("background_images"),
        F.sum(F.regexp_count(css, F.lit(r"(?i)::?(before|after)"))).alias("generated_content"),
        F.count_if(name.isin(tagged) & (F.col("n_tagged") > 0)).alias("nested_tagged"),
        F.count_if(seen & (F.col("n_tagged") == 0)).alias("untagged_texts"),
        F.sum(F.when((text != "") & (F.col("n_hiding") > 0), F.length(text)).otherwise(0)).alias("hidden_chars"),
        F.sum(F.when(seen, F.length(text)).otherwise(0)).alias("visible_chars"),
        F.sha2(F.array_join(F.transform(shown, lambda x: x["text"]), "\n"), 256).alias("text_sha256"),
    )
