"""URL filtering by a per-host tree of path templates with smoothed labelled purity.

Rules give labels; where no rule fits, the template that a url belongs to decides:

1. Every path segment becomes a literal or, if it varies by nature (digits, long hexadecimal), a wildcard; segments
   from the ``depth``-th on are one wildcard. Equal (host, segments) are counted first, so everything after that works
   on templates, not on urls.
2. From the host down, a node of the tree with more than ``max_fanout`` different children has its literal ones
   replaced by a wildcard, so that what lies below them is pooled.
3. Sibling branches whose share of blocked labels does not differ from their parent's (two-sided test on proportions,
   ``merge_z``) are merged; so are those above it, and those below.
4. The purity of a branch is its share of blocked labels, smoothed towards its parent's purity, the host's towards the
   whole corpus' share. A branch without labels has its parent's. A template whose nearest labelled branch has
   ``min_labels`` labels, and whose purity is ``reject_purity`` or more, is rejected.

Edge cases: a null url, or one without ``://``, has an empty host and path, no rule and the verdict of
template "" of host "" (allow unless labels say otherwise). Of equally long rules the first in code point order counts.
Very long urls are read whole. Repeated rows are judged alike, one by one. An empty table gives an empty result.
Columns of the input other than the id and the url are not carried.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanloom.llm.common import cut

#: (verdict, rule); a rule is a host, then the start of a path. Fixed values of the query's contract.
CONTRACT_RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: Rules beyond this number are joined by host suffix, not written out as one expression.
MAX_INLINE_RULES = 256
#: Rejected templates up to this number are broadcast; beyond, both sides are salted and shuffled.
MAX_BROADCAST_TEMPLATES = 50_000
#: Levels of the tree.
DEPTH = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.lower(), slash + path


def _fits(rule: str, host: Column, path: Column) -> Column:
    rule_host, rule_path = split_rule(rule)
    return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)


def ruled(urls: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Add ``rule`` and ``rule_verdict`` of the longest rule that fits; both null if none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    if len(ordered) <= MAX_INLINE_RULES:
        rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
        for said, text in reversed(ordered):
            fits = _fits(text, F.col("host"), F.col("path"))
            rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
        return urls.withColumn("rule", rule).withColumn("rule_verdict", verdict)
    spark = urls.sparkSession
    known = spark.createDataFrame(
        [(i, said, text, *split_rule(text)) for i, (said, text) in enumerate(ordered)],
        "rank int, said string, rule string, rule_host string, rule_path string",
    )
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    pairs = urls.select("host", "path").distinct()
    best = (
        pairs.withColumn("rule_host", F.explode(suffixes))
        .join(known, "rule_host")
        .where(F.col("path").startswith(F.col("rule_path")))
        .groupBy("host", "path")
        .agg(F.min(F.struct("rank", "rule", "said")).alias("best"))
        .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.said").alias("rule_verdict"))
    )
    return urls.join(best, ["host", "path"], "left")


def segment_shape(segment: Column) -> Column:
    """A literal, or a wildcard where a segment varies by nature. A file suffix stays."""
    suffix = F.regexp_extract(segment, "(\\.[A-Za-z]{1,5})$", 1)
    body = F.regexp_replace(segment, "\\.[A-Za-z]{1,5}$", "")
    kind = (
        F.when(body.rlike("^[0-9]+$"), "{n}")
        .when(body.rlike("^[0-9A-Fa-f]{8,}(-[0-9A-Fa-f]+)*$"), "{h}")
        .when(body.rlike("[0-9]"), F.regexp_replace(body, "[0-9]+", "{n}"))
        .otherwise(body)
    )
    return F.concat(kind, suffix)


def path_segments(path: Column, depth: int) -> Column:
    """The shapes of a path's segments; those from the ``depth``-th on are one wildcard if there are several."""
    parts = F.split(path, "/", -1)
    shaped = lambda n: F.transform(F.slice(parts, 2, n), segment_shape)
    return F.when(F.size(parts) - 1 > depth, F.concat(shaped(depth - 1), F.array(F.lit("{*}")))).otherwise(shaped(depth))


def template_tree(labelled: DataFrame, depth: int, max_fanout: int, merge_z: float, prior_weight: float) -> DataFrame:
    """One row per (host, template): its branch in the tree, the labels that speak for it, and its purity.

    ``labelled`` has host, segments, template, and blocked (1, 0, or null where there is no label).
    """
    tree = labelled.groupBy("host", "template").agg(F.first("segments").alias("segments"), F.count("blocked").alias("n"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("b"))
    tree = cut(tree.withColumn("p0", F.lit("")))
    for d in range(1, depth + 1):
        above, segment = f"p{d - 1}", F.get("segments", F.lit(d - 1))
        fan = tree.groupBy("host", above).agg(F.count_distinct(segment).alias("fan"))
        wide = (F.col("fan") > max_fanout) & ~F.contains(segment, F.lit("{"))
        tree = tree.join(fan, ["host", above]).withColumn(f"p{d}", F.concat(F.col(above), F.lit("/"), F.when(wide, "{s}").otherwise(segment))).drop("fan")
        tree = cut(tree.withColumn(f"p{d}", F.coalesce(f"p{d}", above)))  # a path that ends stays at its last node
    corpus = tree.agg(F.coalesce(F.sum("b") / F.greatest(F.sum("n"), F.lit(1)), F.lit(0.0)).alias("share")).first()[0]
    smoothed = lambda b, n, purity: (F.col(b) + prior_weight * purity) / (F.col(n) + prior_weight)
    hosts = tree.groupBy("host").agg(F.sum("n").alias("un"), F.sum("b").alias("ub"))
    tree = tree.join(hosts, "host").withColumn("purity", smoothed("ub", "un", F.lit(corpus))).withColumn("support", F.col("un"))
    for d in range(1, depth + 1):
        # un, ub: the labels of the parent node; bn, bb: those of the branch that the node is merged into.
        above, here = f"p{d - 1}", f"p{d}"
        nodes = tree.groupBy("host", above, here).agg(F.sum("n").alias("kn"), F.sum("b").alias("kb"), F.first("un").alias("un"), F.first("ub").alias("ub"))
        pooled = F.col("ub") / F.greatest(F.col("un"), F.lit(1))
        error = F.sqrt(pooled * (1 - pooled) / F.greatest(F.col("kn"), F.lit(1)))
        z = F.when(error > 0, (F.col("kb") / F.greatest(F.col("kn"), F.lit(1)) - pooled) / error).otherwise(F.lit(0.0))
        side = F.when(F.col("kn") == 0, F.concat(F.lit("unlabelled "), here)).when(F.abs(z) <= merge_z, "similar").when(z > 0, "above").otherwise("below")
        nodes = cut(nodes.withColumn("side", side).select("host", above, here, "kn", "kb", "side"))
        branches = nodes.groupBy("host", above, "side").agg(F.sum("kn").alias("bn"), F.sum("kb").alias("bb"))
        placed = nodes.join(branches, ["host", above, "side"])
        tree = tree.drop("un", "ub").join(placed, ["host", above, here])
        known = (F.col("bn") > 0) & (F.col(here) != F.col(above))
        tree = (
            tree.withColumn("purity", F.when(known, smoothed("bb", "bn", F.col("purity"))).otherwise(F.col("purity")))
            .withColumn("support", F.when(known, F.col("bn")).otherwise(F.col("support")))
            .withColumnsRenamed({"kn": "un", "kb": "ub"})
            .drop("bn", "bb", "side")
        )
        tree = cut(tree)
    return tree.select("host", "template", F.col(f"p{depth}").alias("branch"), F.col("support").alias("n_labels"), "purity")


def url_verdicts(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = CONTRACT_RULES,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    depth: int = DEPTH,
    max_fanout: int = 32,
    merge_z: float = 1.96,
    prior_weight: float = 2.0,
    min_labels: int = 5,
    reject_purity: float = 0.9,
) -> DataFrame:
    """Judge every url: id, host, path, rule, verdict, template, by_template."""
    url = F.col(url_col).cast("string")
    base = pages.select(F.col(id_col).alias("page_id"), url.alias("__url")).select("page_id", host_of(F.col("__url")).alias("host"), path_of(F.col("__url")).alias("path"))
    judged = ruled(base, rules).withColumn("segments", path_segments(F.col("path"), depth))
    judged = judged.withColumn("template", F.when(F.size("segments") > 0, F.concat(F.lit("/"), F.array_join("segments", "/"))).otherwise(F.lit("")))
    blocked = F.when(F.col("rule_verdict") == "block", 1).when(F.col("rule_verdict") == "allow", 0)
    tree = template_tree(judged.select("host", "segments", "template", blocked.alias("blocked")), depth, max_fanout, merge_z, prior_weight)
    rejected = tree.where((F.col("n_labels") >= min_labels) & (F.col("purity") >= reject_purity)).select("host", "template", F.lit(True).alias("rejected"))
    # Counting up to the bound decides whether the list may be broadcast; both ways give the same rows.
    known = rejected.limit(MAX_BROADCAST_TEMPLATES + 1).collect()
    if len(known) <= MAX_BROADCAST_TEMPLATES:
        small = pages.sparkSession.createDataFrame(known, "host string, template string, rejected boolean")
        joined = judged.join(F.broadcast(small), ["host", "template"], "left")
    else:
        salts = 16
        spread = rejected.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = judged.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(salts)).cast("int")).join(spread, ["host", "template", "salt"], "left")
    by_template = F.coalesce(F.col("rejected"), F.lit(False))
    verdict = F.coalesce(F.col("rule_verdict"), F.when(by_template, "block").otherwise("allow"))
    return joined.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", by_template.alias("template_rejected"))
