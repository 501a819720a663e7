"""URL filter by path templates (operator 10). DataFrame and SQL functions only.

Every host has a tree of path segments. Going down the tree, a segment stays literal if its labelled pages are bad
significantly more or less often than those beside it, however small a part of its node it is; all others become the
wildcard `*`. Sibling branches whose shares of bad labelled pages do not differ are merged, however many they are.
Segments that all pages of a node have in common are passed at once. What is left is a small number of templates a host.
A template is blocked when its labelled pages, smoothed by the pages beside it, are mostly bad; a page is evidence once,
so a branch that holds all pages of the one above has its share, and the length of a path decides nothing.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import small
from ledgerline.session import materialize

#: The rules of the query's contract: (host, path) fits the host and its subdomains, if the path starts with it.
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]


#: Siblings are merged by their shares of bad pages in steps of one in so many, so a node has at most this many to order.
STEPS = 1000


def host_of(url: Column) -> Column:
    """Behind the first `://`, up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end; empty without `://`."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_verdict(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(name, verdict) of the rule with the longest host and path that fits, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def _smoothed(bad: Column, labelled: Column, prior: Column, weight: float) -> Column:
    return (bad + weight * prior) / (labelled + weight)


def _similar(branches: DataFrame, z: float) -> DataFrame:
    """(host, template, step, name, ml, mb): one name for siblings whose shares of bad pages do not differ, and their pages.

    Siblings (host, template, own, l, b, step) are added up by step of their share, and neighbouring steps are parted where
    they differ by more than `z` standard errors. A branch of several literals is called by its smallest one, the number
    of the others and a hash of all; one with the wildcard among its members is `*`.
    """
    steps = branches.groupBy("host", "template", "step").agg(
        F.sum("l").alias("l"), F.sum("b").alias("b"), F.max(F.col("own") == "*").alias("wild"), F.min("own").alias("least"),
        F.count(F.lit(1)).alias("members"), F.bit_xor(F.xxhash64("own")).alias("hash"),
    )
    order = Window.partitionBy("host", "template").orderBy("step")
    n, m = F.greatest("l", F.lit(1)), F.greatest(F.lag("l").over(order), F.lit(1))
    share, pooled = F.col("b") / n, (F.col("b") + F.lag("b").over(order)) / F.greatest(F.col("l") + F.lag("l").over(order), F.lit(1))
    parted = share - F.lag(share).over(order) > z * F.sqrt(pooled * (1 - pooled) * (1 / n + 1 / m))
    runs = steps.withColumn("parted", F.coalesce(parted, F.lit(False)).cast("int")).withColumn("run", F.sum("parted").over(order))
    run = Window.partitionBy("host", "template", "run")
    several = F.concat(
        F.min("least").over(run), F.lit("|+"), (F.sum("members").over(run) - 1).cast("string"), F.lit("~"), F.hex(F.bit_xor("hash").over(run))
    )
    name = F.when(F.max("wild").over(run), "*").when(F.sum("members").over(run) == 1, F.col("least")).otherwise(several)
    return runs.select(
        "host", "template", "step", name.alias("name"), F.sum("l").over(run).alias("ml"), F.sum("b").over(run).alias("mb")
    )


def _differs(bad: Column, labelled: Column, others_bad: Column, others: Column, z: float) -> Column:
    """Whether two shares differ by more than `z` standard errors; each has one bad and one good page more (Agresti-Caffo)."""
    a, b = (bad + 1) / (labelled + 2), (others_bad + 1) / (others + 2)
    return F.abs(a - b) > z * F.sqrt(a * (1 - a) / (labelled + 2) + b * (1 - b) / (others + 2))


def _nodes(active: DataFrame, least_count: int, weight: float) -> DataFrame:
    """What each node (host, template) holds: labelled and bad pages, those that go on, how many segments all have in common."""
    goes = F.size("rest") > 0
    nodes = active.groupBy("host", "template").agg(
        F.sum("labelled").alias("nl"), F.sum("bad").alias("nb"), F.first("prior").alias("prior"),
        *[F.coalesce(F.sum(F.when(goes, F.col(c))), F.lit(0)).alias(k) for k, c in (("gn", "n"), ("gl", "labelled"), ("gb", "bad"))],
        F.min("rest").alias("low"), F.max("rest").alias("high"),
    )
    # The segments that the first and the last path in order have in common are those of all.
    same = F.zip_with("low", "high", lambda a, b: F.coalesce(a == b, F.lit(False)))
    differs = F.array_position(same, False).cast("int")
    common = F.when(differs == 0, F.size("low")).otherwise(differs - 1)
    rest_prior = _smoothed(F.col("nb") - F.col("gb"), F.col("nl") - F.col("gl"), F.col("prior"), weight)
    return nodes.select(
        "host", "template", "nl", "nb", "gl", "gb", common.alias("common"),
        ((F.col("gn") >= least_count) & (F.col("gb") > 0) & (F.col("gb") < F.col("gl"))).alias("open"),
        _smoothed(F.col("nb"), F.col("nl"), F.col("prior"), weight).alias("share"),
        _smoothed(F.col("gb"), F.col("gl"), rest_prior, weight).alias("going_share"),
    )


def _split(active: DataFrame, least_labelled: int, least_count: int, z: float, weight: float) -> DataFrame:
    """Rows of open nodes, one segment further down."""
    node = ["host", "template"]
    branches = materialize(
        active.groupBy(*node, F.col("rest")[0].alias("segment")).agg(
            F.sum("n").alias("cn"), F.sum("labelled").alias("cl"), F.sum("bad").alias("cb"),
            *[F.first(c).alias(c) for c in ("gl", "gb", "nl", "nb", "prior")],
        ), "siblings",
    )
    enough = (F.col("cn") >= least_count) & (F.col("cl") >= least_labelled)
    # Branches too few in rows are never literal; what they hold together is one sum a node.
    wholes = branches.groupBy(*node).agg(
        *[F.first(c).alias(c) for c in ("gl", "gb", "nl", "nb", "prior")],
        *[F.coalesce(F.sum(F.when(~enough, F.col(c))), F.lit(0)).alias(k) for k, c in (("rl", "cl"), ("rb", "cb"))],
    )
    wholes = small(materialize(wholes, "wholes"))
    literal = (
        _differs(F.col("cb"), F.col("cl"), F.col("gb") - F.col("cb"), F.col("gl") - F.col("cl"), z)
        | _differs(F.col("cb"), F.col("cl"), F.col("rb"), F.col("rl"), z)
    )
    literals = materialize(branches.where(enough).select(*node, "segment", "cl", "cb").join(wholes, node).where(literal), "literals")
    sums = literals.groupBy(*node).agg(F.sum("cl").alias("ll"), F.sum("cb").alias("lb"))
    wild = wholes.join(sums, node, "left").select(
        *node, F.lit("*").alias("own"), (F.col("gl") - F.coalesce("ll", F.lit(0))).alias("l"), (F.col("gb") - F.coalesce("lb", F.lit(0))).alias("b"),
        "nl", "nb", "prior",
    )
    own = literals.select(*node, F.col("segment").alias("own"), F.col("cl").alias("l"), F.col("cb").alias("b"), "nl", "nb", "prior")
    step = F.when(F.col("l") > 0, F.floor(STEPS * F.col("b") / F.col("l") + 0.5)).cast("int")
    named = wild.unionByName(own).withColumn("step", step)
    # A wildcard without labelled pages has no share and is like no other branch; it has its node's pages as prior.
    names = _similar(named.where("l > 0"), z)
    other = [F.col(c) - F.coalesce(F.col(m), F.lit(0)) for c, m in (("nb", "mb"), ("nl", "ml"))]
    below = named.join(names, [*node, "step"], "left").select(
        *node, "own", F.coalesce("name", "own").alias("name"), _smoothed(*other, F.col("prior"), weight).alias("below")
    )
    below = materialize(below, "names")
    stars = below.where("own = '*'").select(*node, F.col("name").alias("star"), F.col("below").alias("star_below"))
    chosen = below.where("own <> '*'").withColumnRenamed("own", "segment")
    rows = active.select("host", "path", "n", "labelled", "bad", "rest", "template", F.col("rest")[0].alias("segment"))
    rows = rows.join(small(stars), node).join(small(chosen), [*node, "segment"], "left")
    return rows.select(
        "host", "path", "n", "labelled", "bad", F.expr("slice(rest, 2, size(rest))").alias("rest"),
        F.concat("template", F.lit("/"), F.coalesce("name", "star")).alias("template"), F.coalesce("below", "star_below").alias("prior"),
    )


def path_templates(
    urls: DataFrame, least_labelled: int = 5, least_count: int = 20, z: float = 2.58, weight: float = 5.0
) -> DataFrame:
    """(host, path, template, purity): the template of each distinct host and path and its smoothed share of bad pages.

    `urls` has host, path, labelled and bad (0 or 1 a row). A segment is literal with at least `least_count` rows,
    `least_labelled` of them labelled, if its share of bad rows differs by `z` standard errors from that of all its siblings
    together or of those with too few rows, or if all rows of the node have it; other literal siblings with similar shares
    of bad rows are one branch, or join the wildcard if they are similar to it. The same rule ends the tree at every level,
    with a last segment `**`: where the rows that go on are fewer than `least_count` or not labelled both ways, no split of
    them can differ. So there are as many rounds as levels at which 20 rows of a node still differ, however long paths are.
    A node's share is smoothed with `weight` rows of the share of its parent's other rows, which is smoothed the same way;
    a host's with that of all other hosts. A segment that is itself `*` counts as the wildcard.
    """
    pages = materialize(
        urls.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")),
        "paths",
    )
    labelled, bad = pages.agg(F.coalesce(F.sum("labelled"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()  # two numbers
    hosts = pages.groupBy("host").agg(F.sum("labelled").alias("hl"), F.sum("bad").alias("hb"))
    prior = (bad - F.col("hb") + 1) / (labelled - F.col("hl") + 2)
    rest = F.filter(F.split("path", "/"), lambda s: s != "").alias("rest")
    active = materialize(
        pages.join(small(materialize(hosts.select("host", prior.alias("prior")), "hosts")), "host")
        .select("host", "path", "n", "labelled", "bad", rest, F.lit("").alias("template"), "prior"), "tree",
    )
    finished = active.select("host", "path", "template", F.col("prior").alias("purity")).limit(0)
    while not active.isEmpty():
        nodes = small(materialize(_nodes(active, least_count, weight), "nodes"))
        rows = active.join(nodes, ["host", "template"])
        ended = F.size("rest") == 0
        finished = finished.unionByName(rows.where(ended | ~F.col("open")).select(
            "host", "path", F.when(ended, F.col("template")).otherwise(F.concat("template", F.lit("/**"))).alias("template"),
            F.when(ended, F.col("share")).otherwise(F.col("going_share")).alias("purity"),
        ))
        rows = rows.where(~ended & F.col("open"))
        passed = rows.where("common > 0").select(
            "host", "path", "n", "labelled", "bad", F.expr("slice(rest, common + 1, size(rest))").alias("rest"),
            F.concat("template", F.lit("/"), F.array_join(F.expr("slice(rest, 1, common)"), "/")).alias("template"), "prior",
        )
        split = _split(rows.where("common = 0"), least_labelled, least_count, z, weight)
        active = materialize(passed.unionByName(split), "tree")
    return finished


def url_filter(
    pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES, threshold: float = 0.5, **model
) -> DataFrame:
    """One row for each row of `pages`: host, path, fitting rule, verdict, template and its smoothed share of bad pages.

    `labels` has page_id and bad (boolean), at most a row a page; null is no label, and of several the first is
    taken after sorting. A rule's verdict goes first, else a template whose share exceeds `threshold` is blocked.
    A null or malformed url has an empty host and path, hence the template of that host. Nothing is dropped;
    rows with one page_id are judged by their own urls.
    """
    marks = labels.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.min("bad").alias("bad"))
    name, verdict = rule_verdict(F.col("host"), F.col("path"), rules)
    read = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = read.join(marks, "page_id", "left").select(
        "host", "path", F.col("bad").isNotNull().cast("int").alias("labelled"), F.coalesce(F.col("bad").cast("int"), F.lit(0)).alias("bad")
    )
    templates = path_templates(urls, **model)
    return read.join(templates, ["host", "path"]).select(
        "page_id", "host", "path", name.alias("rule"),
        F.coalesce(verdict, F.when(F.col("purity") > threshold, "block").otherwise("allow")).alias("verdict"),
        "template", F.round("purity", 6).alias("bad_share"),
    )
