"""URL rules and a path-template tree for the pages no rule decides.

A page's host is what stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, in lower case; its
path goes on to ``?``, ``#`` or the end. A rule fits its host and all subdomains where the path begins with the rule's;
the longest wins.

The tree has a root per host and a branch per path segment, as deep as the paths go. A segment value stays a branch of its own
when at least ``MIN_ROWS`` pages go through it and it is no number, id or hash; all others are variable and become a wildcard,
which keeps a file extension. What a node decides does not depend on other nodes' sizes. Where fewer than ``MIN_ROWS`` pages or
one single path go on below a node, the rest of the path is one last branch.

Labels are given by the caller as 1 (reject), 0 (keep) or null; each node counts those of its subtree. Siblings are ordered by
their share of rejected labels, in steps of a thousandth, and one after another joined to the group before it as long as the two
do not differ by a two-proportion test against the whole group; the siblings of a group count their labels together. A node's
purity is smoothed with its parent's from the root down: (rejected + ``WEIGHT`` * parent's purity) / (labelled + ``WEIGHT``), above
the root ``PRIOR``; a node that holds all of its parent's labels adds nothing and keeps its purity. A template is a whole path of branches; it is rejected at a purity of ``PURITY`` or more. A branch without labels
has its parent's purity, so a host is rejected as a whole only when its labels say so, and one without labels is allowed.

A null URL or one without ``://`` has an empty host and path, fits no rule and is allowed unless the templates of the
empty host say otherwise. Repeated rows count as often as they stand there; long paths are read whole; an empty table gives an
empty result; columns other than page_id and url are not read. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearhome.session import written

# fixed values
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

MIN_ROWS = 5
SIMILAR = 1.96  # standard errors between the label shares of branches that are merged
STEPS = 1000  # of a label share; siblings within one are not told apart
WEIGHT = 4.0
PRIOR = 0.25
PURITY = 0.8
VARIABLE = r"^([0-9]+|[0-9A-Fa-f-]{16,})(\.[A-Za-z][A-Za-z0-9]{0,4})?$"  # numbers, ids and hashes
EXTENSION = r"(\.[A-Za-z][A-Za-z0-9]{0,4})$"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def first_rule(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, as a struct with nulls where none does."""
    chain = F.when(F.lit(False), F.struct(F.lit("").alias("rule"), F.lit("").alias("verdict")))
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        chain = chain.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict")))
    return chain


def counted_paths(urls: DataFrame) -> DataFrame:
    """(host, path, n, labelled, rejected) of ``urls`` (host, path, label); counted before the shuffle, so a hot path is one row a task."""
    rejected = F.coalesce(F.sum("label"), F.lit(0)).cast("long")
    return urls.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("label").alias("labelled"), rejected.alias("rejected"))


def _wildcard(segment: Column) -> Column:
    return F.concat(F.lit("*"), F.regexp_extract(segment, EXTENSION, 1))


def templates(paths: DataFrame) -> DataFrame:
    """``paths`` with ``names``, the branches from the host to the end of every path. One round a level that has frequent nodes."""
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    rows = written(paths.select("*", segments.alias("left"), F.array().cast("array<string>").alias("names")), "url-paths")
    done, level = rows.filter(F.size("left") == 0), 0
    while True:
        active = rows.filter(F.size("left") > 0).select("*", F.concat_ws("/", "names").alias("node"), F.get("left", F.lit(0)).alias("segment"))
        rest = F.concat_ws("/", "left")
        nodes = active.groupBy("host", "node").agg(F.sum("n").alias("total"), F.min(rest).alias("low"), F.max(rest).alias("high"))
        nodes = written(nodes.select("host", "node", (F.col("total") >= MIN_ROWS).alias("frequent"), (F.col("low") == F.col("high")).alias("single")), f"url-nodes-{level}")
        if nodes.isEmpty():
            return done.drop("left")
        branches = active.groupBy("host", "node", "segment").agg(F.sum("n").alias("own")).filter(F.col("own") >= MIN_ROWS)
        branches = written(branches.filter(~F.col("segment").rlike(VARIABLE)).select("host", "node", "segment", F.lit(True).alias("literal")), f"url-branches-{level}")
        known = active.join(nodes, ["host", "node"]).join(branches, ["host", "node", "segment"], "left")
        last = ~F.col("frequent") | F.col("single")
        tail = F.transform("left", lambda s: F.when(F.col("frequent") & ~s.rlike(VARIABLE), s).otherwise(_wildcard(s)))
        name = F.when(last, F.array_join(tail, "/")).when(F.col("literal"), F.col("segment")).otherwise(_wildcard(F.col("segment")))
        left = F.when(last, F.array().cast("array<string>")).otherwise(F.slice("left", 2, 2**30))
        named = known.select(*paths.columns, left.alias("left"), F.array_append("names", name).alias("names"))
        rows = written(named, f"url-level-{level}")
        done, level = done.unionByName(rows.filter(F.size("left") == 0)), level + 1


def tree(rows: DataFrame) -> DataFrame:
    """(host, names, depth, labelled, rejected): the nodes of all templates, ``names`` being those down to the node."""
    whole = rows.groupBy("host", "names").agg(F.sum("labelled").alias("labelled"), F.sum("rejected").alias("rejected"))
    depth = F.explode(F.sequence(F.lit(0), F.size("names"))).alias("depth")
    nodes = whole.select("host", "names", "labelled", "rejected", depth).select("host", F.slice("names", 1, F.col("depth")).alias("names"), "depth", "labelled", "rejected")
    return nodes.groupBy("host", "names", "depth").agg(F.sum("labelled").alias("labelled"), F.sum("rejected").alias("rejected"))


def _group(state: Column, step: Column) -> Column:
    """The next step of label shares joins the group so far or begins another."""
    pooled = (step["rejected"] + state["rejected"] + 1) / (step["labelled"] + state["labelled"] + 2)
    error = F.sqrt(pooled * (1 - pooled) * (1 / step["labelled"] + 1 / state["labelled"]))
    apart = step["rejected"] / step["labelled"] - state["rejected"] / state["labelled"] > SIMILAR * error
    new = (state["labelled"] == 0) | apart
    total = lambda c: F.when(new, step[c]).otherwise(state[c] + step[c]).alias(c)
    number = state["number"] + F.when(new, 1).otherwise(0)
    return F.struct(
        number.alias("number"), total("labelled"), total("rejected"),
        F.array_append(state["steps"], F.struct(number.alias("number"), step["share"].alias("share"))).alias("steps"),
    )


def merged_branches(nodes: DataFrame) -> DataFrame:
    """(host, names, pooled_labelled, pooled_rejected) of the labelled nodes: the labels of their group of similar siblings.

    A parent's siblings are first added up by step of their share, so the list that is gone through has ``STEPS`` + 1 rows at most.
    """
    parent = F.slice("names", 1, F.col("depth") - 1)
    share = F.floor(F.lit(STEPS) * F.col("rejected") / F.col("labelled")).cast("int")
    siblings = nodes.filter("labelled > 0 AND depth > 0").select("host", parent.alias("parent"), "names", share.alias("share"), "labelled", "rejected")
    steps = siblings.groupBy("host", "parent", "share").agg(F.sum("labelled").alias("labelled"), F.sum("rejected").alias("rejected"))
    in_order = F.array_sort(F.collect_list(F.struct("share", "labelled", "rejected")))
    start = F.struct(
        F.lit(0).alias("number"), F.lit(0).cast("long").alias("labelled"), F.lit(0).cast("long").alias("rejected"),
        F.array().cast("array<struct<number:int,share:int>>").alias("steps"),
    )
    found = steps.groupBy("host", "parent").agg(in_order.alias("list")).select("host", "parent", F.inline(F.aggregate("list", start, _group)["steps"]))
    groups = written(steps.join(found, ["host", "parent", "share"]), "url-steps")
    totals = groups.groupBy("host", "parent", "number").agg(F.sum("labelled").alias("pooled_labelled"), F.sum("rejected").alias("pooled_rejected"))
    pooled = groups.select("host", "parent", "share", "number").join(totals, ["host", "parent", "number"])
    return siblings.select("host", "parent", "names", "share").join(pooled, ["host", "parent", "share"]).select("host", "names", "pooled_labelled", "pooled_rejected")


def purities(rows: DataFrame) -> DataFrame:
    """(host, names, purity, own_labelled) of every template, smoothed from the root down."""
    nodes = written(tree(rows), "url-tree")
    merged = written(merged_branches(nodes), "url-merged")
    known = nodes.join(merged, ["host", "names"], "left").select(
        "host", "names", F.col("labelled").alias("own"), F.coalesce("pooled_labelled", "labelled").alias("n"), F.coalesce("pooled_rejected", "rejected").alias("r"),
    )
    whole = rows.groupBy("host", "names").agg(F.sum("labelled").alias("own_labelled"))
    depth = F.explode(F.sequence(F.lit(0), F.size("names"))).alias("depth")
    steps = whole.select("host", F.col("names").alias("whole"), "own_labelled", depth).withColumn("names", F.slice("whole", 1, F.col("depth")))
    path = F.array_sort(F.collect_list(F.struct("depth", "own", "n", "r")))
    lists = steps.join(known, ["host", "names"]).groupBy("host", F.col("whole").alias("names")).agg(path.alias("path"), F.max("own_labelled").alias("own_labelled"))
    smoothed = lambda above, node: (node["r"] + WEIGHT * above["purity"]) / (node["n"] + WEIGHT)
    start = F.struct(F.lit(PRIOR).alias("purity"), F.lit(-1).cast("long").alias("own"))
    purity = F.aggregate("path", start, lambda above, node: F.struct(
        F.when(node["own"] == above["own"], above["purity"]).otherwise(smoothed(above, node)).alias("purity"), node["own"].alias("own"),
    ))["purity"]
    return lists.select("host", "names", purity.alias("purity"), "own_labelled")


def judged(urls: DataFrame) -> DataFrame:
    """(host, path, template, purity, rejected, own_labelled) of every different host and path of ``urls`` (host, path, label)."""
    rows = written(templates(written(counted_paths(urls), "url-counts")), "url-templates")
    known = written(purities(rows), "url-purity")
    template = F.when(F.size("names") > 0, F.concat_ws("/", "host", F.array_join("names", "/"))).otherwise(F.col("host"))
    found = rows.join(known, ["host", "names"])
    return found.select("host", "path", template.alias("template"), "purity", (F.col("purity") >= PURITY).alias("rejected"), "own_labelled")


def filtered_pages(pages: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of every page; labels are the verdicts of the rules."""
    slim = pages.select("page_id", F.col("url").cast("string").alias("url"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = slim.select("page_id", host.alias("host"), path.alias("path")).withColumn("first", first_rule(F.col("host"), F.col("path")))
    label = F.when(F.col("first.verdict") == "block", 1).when(F.col("first.verdict") == "allow", 0)
    rows = written(rows.select("page_id", "host", "path", F.col("first.rule").alias("rule"), F.col("first.verdict").alias("ruled"), label.alias("label")), "url-rows")
    done = rows.join(written(judged(rows), "url-judged"), ["host", "path"])
    verdict = F.coalesce("ruled", F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow")))
    return done.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
