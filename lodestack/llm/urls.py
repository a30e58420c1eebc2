"""Operator 9, URL filters: fixed rules, and a path-template tree per host.

The method: digits in path segments are generalised first.  The tree of a host is then
named level by level, from the first segment of its paths to the last of the longest.
At each level the branches under one named node are compared by their labelled share of
good pages, each with its siblings together (two-proportion test at ``Z``, given
``LEAST`` labelled pages on both sides).  A branch that differs keeps its name; all that
do not are merged into one wildcard, and their pages are pooled for the next level.  The
names along a path make its template; templates are rejected if their labelled purity,
smoothed toward the host's, which is smoothed toward the corpus's, is under ``PURITY``.
Jobs follow the levels that can still split, not the longest path (see ``templates``).
All of it is grouped sums; no group is gathered.

Only built-in functions are used.  Defined results: host and path are empty for a
null url or one without ``://``; such pages share the template of the empty host;
without labels every purity is the corpus's prior of one half smoothed, so that
nothing is learned against a page and the verdict is "allow"; conflicting labels
count as bad; a share that ties with its siblings' is alike; repeated rows give repeated
rows; an empty table gives an empty one; other columns than id and url are not read;
paths and urls of any length and depth are taken whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, checkpointed
from .skew import light

# Verdict, host, path.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("block", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
Z, LEAST, SMOOTH, PURITY = 1.96, 5, 10.0, 0.5


def host_of(url: Column) -> Column:
    after = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(rule_path))
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def _shape(path: Column) -> Column:
    """The path with digits generalised; a star of its own is written as its code."""
    return F.regexp_replace(F.replace(path, F.lit("*"), F.lit("%2A")), "[0-9]+", "{n}")


def _settled(leaves: DataFrame, node: list[str], scratch: Scratch) -> DataFrame:
    """The templates of leaves (with ``rest``) below nodes where no test can succeed, in one pass for all levels.

    There a branch keeps its name only if it is its node's only one.  So what lies below such a
    node is parted by nothing but where empty segments stand: these stay apart from the others.
    """
    empty = F.filter(F.transform("rest", lambda s, i: F.when(s == "", i)), lambda i: i.isNotNull())
    rows = leaves.select(*node, "host", "shape", empty.alias("empty"), F.posexplode("rest").alias("at", "segment"))
    before = F.concat_ws(",", F.transform(F.filter("empty", lambda i: i < F.col("at")), lambda i: i.cast("string")))
    rows = rows.select(*node, "shape", "at", "segment", F.xxhash64(before).alias("below"))
    per = scratch.save(rows.groupBy(*node, "at", "below").agg(F.min("segment").alias("least"), F.max("segment").alias("most")), "settled-levels")
    named = rows.join(light(per), [*node, "at", "below"])
    name = F.when((F.col("least") == F.col("most")) | (F.col("segment") == ""), F.col("segment")).otherwise("*")
    paths = named.groupBy("host", "shape").agg(F.array_sort(F.collect_list(F.struct("at", name.alias("name")))).alias("names"))
    paths = scratch.save(paths.select("host", "shape", F.concat_ws("/", F.transform("names", lambda n: n["name"])).alias("tail")), "settled-paths")
    out = leaves.join(light(paths), ["host", "shape"], "left")
    # A path that ends here has no tail; an empty last segment has an empty one.
    template = F.when(F.col("tail").isNull(), F.col("template")).otherwise(F.concat_ws("/", "template", "tail"))
    return out.select("host", "shape", "labelled", "good", template.alias("template"))


def templates(leaves: DataFrame, scratch: Scratch, z: float = Z, least: int = LEAST) -> DataFrame:
    """host, shape, labelled, good, template, from a row for each host and shape.

    A round goes down a level in all nodes where a branch may yet differ: those with labelled
    pages enough on both sides, and more than one branch.  Nodes without that many labelled
    pages are settled whole, and levels with one branch are passed at once, so the number of
    rounds is that of the levels that can split, not that of the longest path.
    """
    parts = F.split("shape", "/")
    # Paths begin with a slash, so that the first part is empty.
    rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    node = ["host", "template"]
    now = scratch.save(leaves.select("host", "shape", "labelled", "good", F.lit("").alias("template"), rest.alias("rest")), "level-0")
    done, closed, level = [now.where("size(rest) = 0").drop("rest")], [], 0
    while True:
        left = now.where("size(rest) > 0")
        # What all paths below a node begin with is what the first and the last of them do.
        sums = left.groupBy(*node).agg(F.sum("labelled").alias("all_n"), F.sum("good").alias("all_g"), F.min("rest").alias("a"), F.max("rest").alias("b"))
        shared = F.array_position(F.concat(F.zip_with("a", "b", lambda x, y: ~F.coalesce(x == y, F.lit(False))), F.array(F.lit(True))), True) - 1
        nodes = scratch.save(sums.select(*node, "all_n", "all_g", shared.cast("int").alias("skip")), f"nodes-{level}")
        open_nodes = nodes.where(F.col("all_n") >= 2 * least)
        closed.append(left.join(light(nodes.where(F.col("all_n") < 2 * least).select(*node)), node, "left_semi"))
        if not open_nodes.limit(1).count():
            break
        level += 1
        left = left.join(light(open_nodes), node)
        # The node's own name stays what pages are pooled by; ``way`` is the name with the levels passed over.
        passed = F.concat_ws("/", F.col("template"), F.array_join(F.slice("rest", F.lit(1), F.col("skip")), "/"))
        way = F.when(F.col("skip") > 0, passed).otherwise(F.col("template"))
        left = left.withColumn("template", way).withColumn("rest", F.slice("rest", F.col("skip") + 1, F.size("rest"))).drop("skip")
        left = scratch.save(left, f"left-{level}")
        done.append(left.where("size(rest) = 0").drop("rest", "all_n", "all_g"))
        left = left.where("size(rest) > 0").withColumn("segment", F.col("rest")[0])
        own = left.groupBy(*node, "segment").agg(F.sum("labelled").alias("n"), F.sum("good").alias("g"))
        own = scratch.save(own, f"own-{level}")
        parents = own.groupBy(*node).agg(F.count(F.lit(1)).alias("branches"), F.sum("n").alias("all_n"), F.sum("g").alias("all_g"))
        own = own.join(parents, node)
        others, share = F.col("all_n") - F.col("n"), F.try_divide("all_g", "all_n")
        error = F.sqrt(share * (1 - share) * (F.try_divide(F.lit(1.0), F.col("n")) + F.try_divide(F.lit(1.0), others)))
        apart = F.abs(F.try_divide("g", "n") - F.try_divide(F.col("all_g") - F.col("g"), others))
        differs = (F.col("n") >= least) & (others >= least) & (apart > z * error)
        wild = (F.col("segment") != "") & (F.col("branches") > 1) & ~F.coalesce(differs, F.lit(False))
        own = scratch.save(own.select(*node, "segment", F.when(wild, "*").otherwise(F.col("segment")).alias("name")), f"names-{level}")
        named = left.drop("all_n", "all_g").join(light(own), [*node, "segment"])
        named = named.select("host", "shape", "labelled", "good", F.concat_ws("/", "template", "name").alias("template"), F.slice("rest", F.lit(2), F.size("rest")).alias("rest"))
        now = scratch.save(named, f"level-{level}")
        done.append(now.where("size(rest) = 0").drop("rest"))
    out = _settled(scratch.save(reduce(DataFrame.unionByName, closed), "closed"), node, scratch)
    return reduce(DataFrame.unionByName, done, out)


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, z: float = Z, least: int = LEAST, smooth: float = SMOOTH, purity: float = PURITY) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity.

    ``labels`` (doc_id, quality) says which pages, by their id, are good.
    """
    url = F.col("url").cast("string")
    base = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    said = labels.select(F.col("doc_id").alias("page_id"), F.col("quality").cast("int").alias("good")).where("page_id IS NOT NULL AND good IS NOT NULL")
    said = said.groupBy("page_id").agg(F.min("good").alias("good"))
    shaped = base.withColumn("shape", _shape(F.col("path")))
    with Scratch(pages.sparkSession) as scratch:
        leaves = shaped.join(said, "page_id", "left").groupBy("host", "shape")
        leaves = leaves.agg(F.count("good").alias("labelled"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
        found = scratch.save(templates(leaves, scratch, z, least), "templates")
        corpus = found.agg(((F.coalesce(F.sum("good"), F.lit(0)) + smooth / 2) / (F.coalesce(F.sum("labelled"), F.lit(0)) + smooth)).alias("p0"))
        hosts = found.groupBy("host").agg(F.sum("labelled").alias("hn"), F.sum("good").alias("hg")).join(F.broadcast(corpus))  # one row
        hosts = scratch.save(hosts.select("host", ((F.col("hg") + smooth * F.col("p0")) / (F.col("hn") + smooth)).alias("p1")), "hosts")
        pure = found.groupBy("host", "template").agg(F.sum("labelled").alias("n"), F.sum("good").alias("g")).join(light(hosts), "host")
        pure = scratch.save(pure.select("host", "template", ((F.col("g") + smooth * F.col("p1")) / (F.col("n") + smooth)).alias("purity")), "purities")
        decided = checkpointed(found.join(light(pure), ["host", "template"]).select("host", "shape", "template", "purity"))
    out = shaped.join(light(decided), ["host", "shape"], "left")
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(verdict, F.when(F.col("purity") < purity, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", name.alias("rule"), verdict.alias("verdict"), "template", F.round("purity", 6).alias("purity"))
