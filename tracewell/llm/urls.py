"""URL filters: rules for hosts and paths, and a tree of path templates with labelled purity.

The tree grows level by level over the distinct paths, with one row for each: segments that
look variable become ``*``, and so do labelled siblings whose labels don't differ more than
chance allows (``*+`` where the variable ones do differ from them). Others stay branches of
their own, however many siblings there are.

A branch's purity is its share of bad labels, smoothed towards what the tree says without
it: its prior is the smoothed share of the labels beside it, which has the next level's as
its prior, up to the host's and a fixed one above that. So a branch without labels takes
after its surroundings, one label says the same at any depth, and no label counts twice.
Where a branch has no label, or one path only, nothing below it can differ, so its levels
end there (``**`` for the segments that are left). Each level is a few grouped sums and
joins, so a host may have any number of paths and a path any number of segments.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.storage import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Segments that vary by their form: numbers with a suffix or not, long hexadecimal names, dates.
VARIABLE = r"^(\d+(\.\w+)?|[0-9a-fA-F]{8,}|[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|\d{4}-\d{2}-\d{2})$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """The longest rule (host/path) that fits, and its verdict; both null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r), r)):
        name, _, start = r.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, rules[r]).otherwise(verdict)
    return rule, verdict


def path_templates(paths: DataFrame, scratch: Scratch, prior: Sequence[float] = (0.5, 1.5), z: float = 1.96) -> DataFrame:
    """Add ``template`` and ``bad_share`` to paths (host, path, labelled, bad; one row for each host and path).

    Slashes at a path's ends make no segments. Siblings are alike if a branch's share of bad
    labels is ``z`` standard errors at most from that of all other labelled siblings.
    """
    weight = float(sum(prior))
    segments = F.split(F.regexp_replace("path", "^/+|/+$", ""), "/")
    rows = paths.withColumns({"_segments": segments, "template": F.lit(""), "_prior": F.lit(prior[0] / weight)})
    node, done, level = ["host", "template"], [], 0
    while True:
        seg = F.get("_segments", F.lit(level))
        # A path that ends here is a branch of its own (e), beside those that go on (s).
        here = rows.withColumn("_seg", F.when(seg.isNull(), "e").when(seg.rlike(VARIABLE), "s*").otherwise(F.concat(F.lit("s"), seg)))
        kids = here.groupBy(*node, "_seg").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"), F.count("*").alias("paths"), F.first("_prior").alias("_prior"))
        kids = scratch.table(kids)
        if kids.isEmpty():
            break
        star, goes_on = F.col("_seg") == "s*", F.col("_seg") != "e"
        only = lambda c, which: F.sum(F.when(which, F.col(c)).otherwise(0))
        sums = {"all_labelled": F.sum("labelled"), "all_bad": F.sum("bad"), "on_labelled": only("labelled", goes_on), "on_bad": only("bad", goes_on), "star_labelled": only("labelled", star), "star_bad": only("bad", star)}
        total = scratch.table(kids.groupBy(*node).agg(*(v.alias(k) for k, v in sums.items())))
        kids = kids.join(total, node)  # aggregates are read back, so hot parents' partitions can be split

        def alike(labelled: Column, bad: Column) -> Column:
            """Whether the share of bad labels is like that of all others that go on; not so without labels on both sides."""
            rest, rest_bad = F.col("on_labelled") - labelled, F.col("on_bad") - bad
            p = F.try_divide("on_bad", "on_labelled")
            gap = F.abs(F.try_divide(bad, labelled) - F.try_divide(rest_bad, rest))
            error = F.sqrt(p * (1 - p) * (F.try_divide(F.lit(1.0), labelled) + F.try_divide(F.lit(1.0), rest)))
            return F.coalesce(gap <= z * error, F.lit(False))

        merges = goes_on & (F.col("labelled") > 0) & alike(F.col("labelled"), F.col("bad"))
        apart = (F.col("star_labelled") > 0) & ~alike(F.col("star_labelled"), F.col("star_bad"))
        name = F.when(star, "s*").when(merges, F.when(apart, "s*+").otherwise("s*")).otherwise(F.col("_seg"))
        kids = scratch.table(kids.withColumn("_name", name))
        branches = kids.groupBy(*node, "_name").agg(F.sum("labelled").alias("own_labelled"), F.sum("bad").alias("own_bad"), F.sum("paths").alias("own_paths"))
        kids = kids.join(scratch.table(branches), [*node, "_name"])
        beside = (F.col("all_bad") - F.col("own_bad") + weight * F.col("_prior")) / (F.col("all_labelled") - F.col("own_labelled") + weight)
        names = scratch.table(kids.select(*node, "_seg", "_name", "own_labelled", "own_bad", "own_paths", beside.alias("_beside")))
        left = F.size("_segments") - level - 1
        bare, alone = F.col("own_labelled") == 0, F.col("own_paths") == 1
        grown = F.when(F.col("_name") == "e", F.col("template")).otherwise(F.concat("template", F.lit("/"), F.substr("_name", F.lit(2))))
        rest = F.transform(F.slice("_segments", level + 2, F.greatest(left, F.lit(0))), lambda s: F.when(s.rlike(VARIABLE), "*").otherwise(s))
        tail = F.when(left <= 0, "").when(alone, F.concat(F.lit("/"), F.array_join(rest, "/"))).when(bare, "/**").otherwise("")
        share = (F.col("own_bad") + weight * F.col("_beside")) / (F.col("own_labelled") + weight)
        joined = here.drop("_prior").join(names, [*node, "_seg"])
        joined = joined.select(*paths.columns, "_segments", F.concat(grown, tail).alias("template"), F.col("_beside").alias("_prior"), share.alias("bad_share"), ((F.col("_name") == "e") | bare | alone).alias("_done"))
        joined = scratch.table(joined)
        done.append(joined.filter("_done").select(*paths.columns, "template", "bad_share"))
        rows, level = joined.filter("NOT _done").drop("_done", "bad_share"), level + 1
    return reduce(DataFrame.unionByName, done) if done else paths.withColumns({"template": F.lit(""), "bad_share": F.lit(prior[0] / weight)})


def url_filter(pages: DataFrame, rules: dict[str, str], label: str | None = None, most_bad: float = 0.5, prior: Sequence[float] = (0.5, 1.5)) -> DataFrame:
    """Verdict on each row of pages (page_id, url; other columns are ignored, but ``label``).

    ``rules`` maps ``host/path`` to block or allow; a rule fits its host, all subdomains, and
    paths that start with its path; the longest decides. Other pages get their template's
    verdict: block if its smoothed share of bad labels (``path_templates``, with ``prior`` for a
    host without labels) is over ``most_bad``. Labels (1 bad, 0 good, null unknown) come from
    the column ``label``; without one, what the rules decide is labelled, and other pages of a
    host are judged by it.

    Returns page_id, host, path, rule, template, bad_share and verdict. A null url, or one
    without ``://``, has an empty host and path and no rule. Repeated rows and rows without an
    id are judged by their url. An empty table gives an empty result. Urls of any length are
    whole; columns but these are ignored, whatever their names.
    """
    scratch = Scratch(pages.sparkSession)
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), *([F.col(label).cast("int").alias("label")] if label else []))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "given": verdict})
    if not label:
        rows = rows.withColumn("label", (F.col("given") == "block").cast("int"))
    rows = scratch.table(rows)
    paths = rows.groupBy("host", "path").agg(F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).alias("bad"))
    known = scratch.table(path_templates(scratch.table(paths), scratch, prior).select("host", "path", "template", "bad_share"))
    scratch.keep(rows, known)
    out = rows.join(known, ["host", "path"])
    own = F.when(F.col("bad_share") > most_bad, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", "template", "bad_share", F.coalesce("given", own).alias("verdict"))
