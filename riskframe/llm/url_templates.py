"""URL filters: rules first, then per-host templates of paths judged by the labels they hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.texts import LOWER, UPPER
from riskframe.session import materialise

#: Fixed values: (verdict, host, start of the path) of the rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: A branch of so few urls is a value of a variable segment, not a place of the site.
FEW = 2

#: Branches whose shares of blocked labels are within so many standard errors of their siblings' are alike.
ALIKE = 1.96

#: A template is rejected from so many labelled urls and this smoothed share of urls with a blocking label among all its urls;
#: so many urls at the parent's share are added.
SUPPORT, PURITY, PRIOR = 5, 0.8, 10.0

#: How a template shows a segment with digits, values seen a few times, and labelled branches that are alike. No path has # or ?.
VARIABLE, RARE, MERGED = "#", "?", "?~"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for NULL or a url without ``://``."""
    known = F.coalesce(url, F.lit(""))
    rest = F.regexp_extract(known, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule, as text, and its verdict; NULL if none fits. ``rules`` is a short list."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, domain, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(domain + start)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def shape(path: Column) -> Column:
    """The segments of a path, all of them; those with a digit are one variable segment."""
    segments = F.array_remove(F.split(path, "/"), "")
    return F.transform(segments, lambda s: F.when(s.rlike("[0-9]"), F.lit(VARIABLE)).otherwise(s))


COUNTS = ("n", "n_block", "n_labelled")


def _smoothed() -> Column:
    """Urls without a label count against the share of blocked ones."""
    return (F.col("n_block") + PRIOR * F.col("above")) / (F.col("n") + PRIOR)


def _undecided() -> Column:
    """Whether a template below a node could be rejected and hold a url without a label.

    Deeper templates have no more labels than the node. Without a blocking label the share is at most
    PRIOR / (SUPPORT + PRIOR), which is less than PURITY.
    """
    return (F.col("support") >= SUPPORT) & (F.col("blocking") > 0) & (F.col("urls") > F.col("support"))


def _branch_names(rows: DataFrame) -> DataFrame:
    """What each ``branch`` of a node is called in the templates below it.

    A branch whose labels are unlike those of its siblings together keeps its name, at any number of branches. Of the others, those of few
    urls are values of one variable segment, and labelled ones are merged; a branch without labels and of more urls keeps its name.
    """
    node = ["host", "template"]
    branches = rows.groupBy(*node, "branch").agg(*[F.sum(c).alias(c) for c in COUNTS])
    whole = branches.groupBy(*node).agg(F.sum("n_block").alias("all_block"), F.sum("n_labelled").alias("all_labelled"))
    known, others = F.col("n_labelled"), F.col("all_labelled") - F.col("n_labelled")
    pooled = F.col("all_block") / F.col("all_labelled")
    error = F.sqrt(pooled * (1 - pooled) * (1 / known + 1 / others))
    apart = F.abs(F.col("n_block") / known - (F.col("all_block") - F.col("n_block")) / others) > ALIKE * error
    compared = (known > 0) & (others > 0)
    name = (
        F.when(F.col("branch") == "", F.lit(""))
        .when(compared & apart, F.concat(F.lit("/"), "branch"))
        .when(F.col("n") <= FEW, F.lit(f"/{RARE}"))
        .when(compared, F.lit(f"/{MERGED}"))
        .otherwise(F.concat(F.lit("/"), "branch"))
    )
    return branches.join(whole, node).select(*node, "branch", name.alias("name"))


def templates(paths: DataFrame) -> DataFrame:
    """The template of each ``host`` and ``shape``, and whether it is ``rejected``.

    ``paths`` has ``host``, ``shape``, ``n`` (urls), ``n_block`` and ``n_labelled``, one row
    for each host and shape. From the root on, a level at a time, branches get their names (see ``_branch_names``). The
    share of a template is smoothed towards its parent's, the host's towards that of all hosts. A node is not followed further where no
    template below it can change a verdict; its template then ends in ``/**``. So there are as many rounds as the labels need, not
    as the longest path has segments.
    """
    sums = [F.sum(c).alias(c) for c in COUNTS]
    total = paths.agg(((F.sum("n_block") + 1) / (F.sum("n") + 2)).alias("above"), F.lit(1).alias("every"))
    hosts = paths.groupBy("host").agg(*sums).withColumn("every", F.lit(1)).join(F.broadcast(total), "every")  # one row
    measures = [_smoothed().alias("share"), F.col("n_labelled").alias("support"), F.col("n_block").alias("blocking"), F.col("n").alias("urls")]
    rows = paths.withColumn("template", F.lit("")).join(hosts.select("host", *measures), "host")
    ended, level = [], 0
    while True:
        # Written level by level, so that no level's plan holds all levels above it.
        rows = materialise(rows, f"level-{level}")
        last = F.size("shape") <= level
        shown = F.when(last, F.col("template")).otherwise(F.concat("template", F.lit("/**")))
        rejected = (F.col("support") >= SUPPORT) & (F.col("share") >= PURITY)
        over = (F.coalesce(F.try_element_at("shape", F.lit(level)), F.lit("")) == "") if level else F.lit(False)
        ended.append(rows.filter(over | ~_undecided()).select("host", "shape", shown.alias("template"), rejected.alias("rejected")))
        rows = rows.filter(~over & _undecided())
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, ended)
        node = ["host", "template"]
        branch = F.coalesce(F.try_element_at("shape", F.lit(level + 1)), F.lit(""))
        rows = rows.select(*node, "shape", *COUNTS, F.col("share").alias("above"), branch.alias("branch"))
        named = rows.join(_branch_names(rows), [*node, "branch"])
        # The end of a path is a branch of its own: it has the node's name and a mark.
        named = named.withColumns({"template": F.concat("template", "name"), "end": F.col("branch") == ""}).drop("name", "branch")
        # Rows of a node have the same share above it, but for values merged under equal names: those have the same parent too.
        nodes = named.groupBy(*node, "end").agg(*sums, F.max("above").alias("above")).select(*node, "end", *measures)
        rows = named.drop("above").join(nodes, [*node, "end"]).drop("end")
        level += 1


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``template`` and ``verdict`` ("allow" or "block") of each row's url.

    A url that a rule fits has the rule's verdict and labels its template; others are blocked if their
    template is rejected. NULL urls, and ones without ``://``, have an empty host and path and are judged like any other.
    Repeated rows are judged each, and count each for their template. Paths have no longest length. A share that is
    exactly ``PURITY`` is rejected. Other columns of ``pages`` are not read. No rows give no rows.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", shape(F.col("path")).alias("shape"), rule.alias("rule"), verdict.alias("ruled"))
    counted = rows.groupBy("host", "shape").agg(
        F.count("*").alias("n"), F.count_if(F.col("ruled") == "block").alias("n_block"), F.count("ruled").alias("n_labelled")
    )
    found = templates(materialise(counted, "shapes"))
    judged = rows.join(found, ["host", "shape"], "left")
    own = F.when(F.coalesce("rejected", F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", "template", F.coalesce("ruled", own).alias("verdict"))
