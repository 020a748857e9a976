"""URL filter: host and path rules, and a path-template tree for the rest.

Templates: a path is a list of segments, and the urls of a host form a tree of
them.  Segments with a digit are variable and become a wildcard; so do the
children of a node that has more than MANY of them, each seen fewer than SEEN
times on average.  The labelled branches of a node are put in the order of the rates at
which they are blocked, and neighbours that a two-proportion test can't tell apart
are merged.  From the host down, each node's purity is smoothed towards its
parent's: (blocked + STRENGTH * parent's) / (labelled + STRENGTH), the host's
towards PRIOR.  So a template without labels draws on its siblings; where those
are left in groups that differ, on what lies above them.  A template is
rejected if its purity is over LIMIT.

A rule for a path says of the urls beside that path only that it leaves them out.  Its
labels therefore count from the level on at which the rule's own path ends: they
are lent to what lies below, never to the host's other paths.

Everything is counted per (host, template) and combined before it is shuffled,
so a host with a third of all urls is no single group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlens.llm.common import materialise

#: Levels of the tree; what lies deeper is one wildcard below its branch.
DEPTH = 4
MANY, SEEN = 20, 3
PRIOR, STRENGTH, LIMIT = 0.1, 4.0, 0.5
#: Square of the normal deviate beyond which two rates differ.
DIFFER = 3.84
#: Stands for the end of a path.
END = "/"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def parse(url: Column) -> tuple[Column, Column]:
    """Host and path: from the first ``://`` to ``/``, ``?``, ``#`` or the end,
    and on to ``?``, ``#`` or the end.  Both empty if there is none."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _UPPER.lower()), path


def apply_rules(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """The longest rule (``domain/path`` -> verdict) that fits, and its verdict.
    A rule fits its domain and all subdomains if the path starts with its own."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text in sorted(rules, key=lambda r: (len(r), r)):
        domain, _, prefix = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + prefix)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(rules[text])).otherwise(verdict)
    return rule, verdict


def _shape(path: Column) -> Column:
    """Segments, those with a digit as wildcards, deeper ones as one."""
    parts = F.transform(F.slice(F.split(path, "/", -1), 2, DEPTH + 1),
                        lambda s: F.when(s.rlike("[0-9]"), F.lit("*")).otherwise(s))
    return F.when(F.size(parts) > DEPTH, F.concat(F.slice(parts, 1, DEPTH), F.array(F.lit("*")))).otherwise(parts)


def templates(shapes: DataFrame) -> DataFrame:
    """(host, shape, template, purity) of ``shapes(host, shape, n, blocked,
    labelled)``, one row a shape; template is the generalised list of segments.  With a
    column ``since``, rows may differ in it alone: their labels count from that level on."""
    if "since" not in shapes.columns:
        shapes = shapes.withColumn("since", F.lit(0))
    nodes = shapes.withColumn("template", F.array().cast("array<string>"))
    for level in range(1, DEPTH + 2):
        # try_element_at is null below a path's end; such paths stay as they are.
        seg = F.try_element_at("shape", F.lit(level))
        kids = nodes.where(seg.isNotNull()).groupBy("host", "template", seg.alias("seg")).agg(F.sum("n").alias("n"))
        wide = materialise(kids.groupBy(F.col("host").alias("h"), F.col("template").alias("t"))
                           .agg(F.count("*").alias("kids"), F.sum("n").alias("n"))
                           .where(f"kids > {MANY} and n < {SEEN} * kids").select("h", "t", F.lit(True).alias("wide")))
        named = F.when(F.col("wide") & (seg != ""), F.lit("*")).otherwise(seg)
        nodes = materialise(
            nodes.join(wide, (F.col("h") == F.col("host")) & (F.col("t") == F.col("template")), "left")
            .withColumn("template", F.when(seg.isNull(), F.col("template")).otherwise(
                F.concat("template", F.array(named))))
            .drop("h", "t", "wide"))
    leaves = materialise(nodes.groupBy("host", "template", "since").agg(F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled")))
    return (nodes.join(materialise(_judged(leaves)), (F.col("h") == F.col("host")) & (F.col("t") == F.col("template")))
            .select("host", "shape", "template", "purity").distinct())


def _alike(x: Column, n: Column, y: Column, m: Column) -> Column:
    """Whether a two-proportion test can't tell x of n from y of m."""
    rate = F.try_divide(x + y, n + m)
    z2 = F.try_divide((F.try_divide(x, n) - F.try_divide(y, m)) ** 2, rate * (1 - rate) * (F.try_divide(F.lit(1.0), n) + F.try_divide(F.lit(1.0), m)))
    # Equal rates of 0 or 1 have no variance and are alike.
    return F.coalesce(z2 < DIFFER, x * m == y * n)


def _judged(leaves: DataFrame) -> DataFrame:
    """(h, t, purity) of ``leaves(host, template, since, blocked, labelled)``, one row a template."""
    # A path's end is a branch of its own beside the longer paths; no segment is a slash.
    path = F.concat("template", F.array(F.lit(END)))
    steps = materialise(leaves.select("host", "template", "since", "blocked", "labelled", F.explode(
        F.transform(F.sequence(F.lit(0), F.size(path)), lambda i: F.slice(path, 1, i))).alias("node")))
    nodes = materialise(steps.groupBy("host", "node").agg(
        *[F.sum(F.when(F.size("node") >= F.col("since"), F.col(c)).otherwise(0)).alias(n) for c, n in (("blocked", "x"), ("labelled", "n"))]))
    # Branches in the order of their rates; those of one rate are one row, so a parent's
    # list is far shorter than its branches are many.
    parent = F.slice("node", 1, F.greatest(F.size("node") - 1, F.lit(0)))
    rates = (nodes.where((F.size("node") > 0) & (F.col("n") > 0))
             .groupBy("host", parent.alias("parent"), (F.col("x") / F.col("n")).alias("rate"))
             .agg(F.sum("x").alias("x"), F.sum("n").alias("n")))
    order = Window.partitionBy("host", "parent").orderBy("rate")
    before = [F.lag(c).over(order) for c in ("x", "n")]
    apart = F.coalesce(~_alike(F.col("x"), F.col("n"), *before), F.lit(False))
    grouped = materialise(rates.withColumn("apart", apart.cast("int"))
                          .withColumn("merged", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0))))
    pools = grouped.groupBy("host", "parent", "merged").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    pooled = materialise(
        grouped.select("host", "parent", "merged", "rate").join(pools, ["host", "parent", "merged"])
        .select(F.col("host").alias("h"), F.col("parent").alias("p"), F.col("rate").alias("r"), F.col("x").alias("all_x"), F.col("n").alias("all_n")))
    split = materialise(grouped.groupBy(F.col("host").alias("sh"), F.col("parent").alias("sp")).agg((F.max("merged") > 0).alias("split")))
    known = (nodes.withColumn("rate", F.try_divide("x", "n"))
             .join(pooled, (F.col("h") == F.col("host")) & (F.col("p") == parent) & (F.col("r") == F.col("rate")) & (F.size("node") > 0), "left")
             .join(split, (F.col("sh") == F.col("host")) & (F.col("sp") == F.col("node")), "left"))
    known = materialise(known.select(
        F.col("host").alias("h"), F.col("node").alias("at"), F.coalesce("all_x", "x").cast("double").alias("x"),
        F.coalesce("all_n", "n").cast("double").alias("n"), F.col("n").alias("here"), F.coalesce("split", F.lit(False)).alias("split")))
    trails = (steps.select("host", "template", "node").distinct().join(known, (F.col("h") == F.col("host")) & (F.col("at") == F.col("node")))
              .groupBy("host", "template").agg(F.sort_array(F.collect_list(F.struct(F.size("node").alias("depth"), "x", "n", "here", "split"))).alias("trail")))

    def down(told: Column, node: Column) -> Column:
        # A branch with all labels of its parent has no evidence that the parent lacks.
        same = (node["here"] > 0) & (node["here"] == told["here"])
        own = F.when(same, told["own"]).otherwise((node["x"] + STRENGTH * told["lent"]) / (node["n"] + STRENGTH))
        # Branches that differ say nothing of another one: it draws on what is above them.
        return F.struct(own.alias("own"), F.when(node["split"], told["lent"]).otherwise(own).alias("lent"), node["here"].alias("here"))

    first = F.struct(F.lit(PRIOR).alias("own"), F.lit(PRIOR).alias("lent"), F.lit(-1).cast("long").alias("here"))
    return trails.select(F.col("host").alias("h"), F.col("template").alias("t"), F.aggregate("trail", first, down)["own"].alias("purity"))


def filter_urls(pages: DataFrame, rules: dict[str, str], url: str = "url", keep: list | None = None) -> DataFrame:
    """The rows of ``pages`` (struct ``row``, of the columns ``keep``), with ``host``, ``path``,
    ``rule`` (null if none fits), ``template``, ``purity`` and ``verdict``, allow or block: the rule's, or the
    template's.  The rules' verdicts are the labels the templates learn from.

    A null url, or one without ``://``, has an empty host and path, fits no rule
    and is judged by the template of such urls.  Very long urls are judged like others, by
    their first segments; repeated rows stay; an empty table gives no rows, and columns of the
    input can't clash (they are in ``row``).
    """
    host, path = parse(F.col(url))
    rule, verdict = apply_rules(F.col("host"), F.col("path"), rules)
    parsed = (pages.select(F.struct(*(keep or ["*"])).alias("row"), host.alias("host"), path.alias("path"))
              .select("row", "host", "path", rule.alias("rule"), verdict.alias("told"), _shape(F.col("path")).alias("shape")))
    depth = F.lit(0)
    for text in rules:
        depth = F.when(F.col("rule") == text, F.lit(min(DEPTH + 1, len([x for x in text.split("/")[1:] if x])))).otherwise(depth)
    shapes = materialise(parsed.groupBy("host", "shape", depth.alias("since")).agg(
        F.count("*").alias("n"), F.count_if(F.col("told") == "block").alias("blocked"), F.count("told").alias("labelled")))
    judged = materialise(templates(shapes)).select(F.col("host").alias("h"), F.col("shape").alias("s"), "template", "purity")
    own = F.when(F.col("purity") > LIMIT, F.lit("block")).otherwise(F.lit("allow"))
    return (parsed.join(judged, (F.col("h") == F.col("host")) & (F.col("s") == F.col("shape")))
            .select("row", "host", "path", "rule", "template", "purity", F.coalesce("told", own).alias("verdict")))
