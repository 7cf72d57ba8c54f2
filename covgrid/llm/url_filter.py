r"""URL filter: fixed rules, then a path-template tree per host.

Every url becomes ``host`` and ``path``.  A rule (host, path, verdict) fits its
host and all subdomains when the path starts with the rule's path; the longest
rule wins.  Urls without a rule are judged by templates learned from labelled
urls:

1. a path is cut into ``depth`` segments (what lies deeper is one segment);
   numbers, hexadecimal ids and very long tokens become placeholders, an
   extension stays;
2. level by level, a node of the host's tree whose children are many and thin
   (more than ``max_children``, fewer than ``min_support`` urls each on
   average) gets one wildcard child ``*``;
3. level by level, sibling branches that lead to the same rest of the template
   are merged into ``*`` where a branch's share of bad labels does not differ
   significantly from the pooled share (z-test; a branch without labels does
   not differ);
4. a template is rejected (block) when its smoothed purity
   ``(good + weight * prior) / (labelled + weight)`` lies significantly below
   the prior, the share of good labels overall (1 without labels): by more than
   ``sqrt(reject_z2)`` standard errors of ``labelled + weight`` labels.  Where labels hold
   no signal, nothing but such chance deviations is rejected.

All steps after the first work on one row per (host, distinct generalised
path), pre-aggregated before the shuffle; a hot host is an ordinary key of
plain joins.  JVM-side only.

Defined cases: a null url or one without ``://`` has an empty host and path
and is judged like any other; repeated rows are judged alike; an empty table
gives no rows; extra columns are kept, also with clashing names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covgrid.llm import common
from covgrid.llm.line_dedup import LOWERED, UPPER
from covgrid.session import materialize

DEPTH = 4
MAX_CHILDREN = 20
MIN_SUPPORT = 5
WEIGHT = 10.0
Z2 = 3.84  # 95 % two-sided
REJECT_Z2 = 9.55  # 99.9 % one-sided, as very many templates are tested

#: Placeholders of step 1: (regular expression of the stem, placeholder).
SHAPES = [("^[0-9]+$", "{n}"), ("^[0-9a-fA-F-]{8,}$", "{x}"), ("^.{25,}$", "{s}")]


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWERED)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """``(rule, verdict)``: the longest fitting rule, else null."""
    none = F.lit(None).cast("string")
    rule, verdict = none, none
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # a longer rule wraps the shorter
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _segment(path: Column, i: int, depth: int) -> Column:
    parts = F.split(path, "/")
    if i == depth:
        raw = F.array_join(F.slice(parts, i + 1, F.greatest(F.size(parts) - i, F.lit(0))), "/")
        raw = F.when(F.size(parts) > i, raw).otherwise("")
    else:
        raw = F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
    stem, extension = F.regexp_extract(raw, r"^(.*?)(\.[a-z]{1,5})?$", 1), F.regexp_extract(raw, r"\.[a-z]{1,5}$", 0)
    shape = stem
    for pattern, name in reversed(SHAPES):
        shape = F.when(stem.rlike(pattern), name).otherwise(shape)
    return F.concat(shape, extension)


def learn_templates(leaves: DataFrame, depth: int = DEPTH, max_children: int = MAX_CHILDREN,
                    min_support: int = MIN_SUPPORT, weight: float = WEIGHT,
                    reject_z2: float = REJECT_Z2) -> DataFrame:
    """``leaves(host, s1.., n, m, bad)`` -> ``host, s1.., template, purity, blocked``."""
    s = [f"s{i}" for i in range(1, depth + 1)]
    t = [f"t{i}" for i in range(1, depth + 1)]
    tree = leaves
    for i in range(depth):  # wildcards for variable segments
        node = ["host", *t[:i]]
        wide = (tree.groupBy(*node, s[i]).agg(F.sum("n").alias("n")).groupBy(*node)
                .agg(F.count("*").alias("children"), F.sum("n").alias("n"))
                .select(*node, ((F.col("children") > max_children)
                                & (F.col("n") < F.col("children") * min_support)).alias("wide")))
        tree = tree.join(wide, node).withColumn(t[i], F.when(F.col("wide"), "*").otherwise(F.col(s[i]))).drop("wide")
        tree = materialize(tree, "url-tree")
    for i in reversed(range(depth)):  # merge similar siblings
        rest = ["host", *t[:i], *t[i + 1:]]
        branch = tree.groupBy(*rest, t[i]).agg(F.sum("m").alias("bm"), F.sum("bad").alias("bb"))
        pool = branch.groupBy(*rest).agg(F.count("*").alias("k"), F.sum("bm").alias("pm"), F.sum("bb").alias("pb"))
        m, b, pm, pb = (F.col(c).cast("double") for c in ("bm", "bb", "pm", "pb"))
        alike = (F.col("k") > 1) & ((b * pm - pb * m) * (b * pm - pb * m) <= F.lit(Z2) * m * pb * (pm - pb))
        merged = branch.join(pool, rest).select(*rest, t[i], F.when(alike, "*").otherwise(F.col(t[i])).alias("to"))
        tree = tree.join(merged, [*rest, t[i]]).drop(t[i]).withColumnRenamed("to", t[i])
        tree = materialize(tree, "url-tree")
    prior = tree.agg(F.coalesce(1 - F.sum("bad").cast("double") / F.nullif(F.sum("m"), F.lit(0)), F.lit(1.0))
                     .alias("prior")).first()["prior"]
    total = (tree.groupBy("host", *t).agg(F.sum("m").alias("pm"), F.sum("bad").alias("pb"))
             .select("host", *t, ((F.col("pm") - F.col("pb") + F.lit(weight * prior))
                                  / (F.col("pm") + F.lit(float(weight)))).alias("purity"), "pm"))
    below = F.lit(prior) - F.col("purity")
    blocked = (below > 0) & (below * below * (F.col("pm") + F.lit(float(weight))) > F.lit(reject_z2 * (prior * (1 - prior))))
    return tree.join(total, ["host", *t]).select(
        "host", *s, F.concat_ws("/", "host", *t).alias("template"), "purity",
        blocked.alias("blocked"))


def judge_urls(urls: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url", bad_col: str = "bad",
               depth: int = DEPTH, **params) -> DataFrame:
    """``urls`` plus a struct column ``_url``: ``host, path, rule, verdict, template,
    purity``.  ``bad_col`` is the label of a url (true: bad; null: unlabelled)."""
    host, path = host_path(F.col(url_col))
    cut = common.packed(urls, _host=host, _path=path, _bad=F.col(bad_col))
    cut = cut.withColumns({f"_s{i}": _segment(F.col("_path"), i, depth) for i in range(1, depth + 1)})
    s = [f"s{i}" for i in range(1, depth + 1)]
    keys = [F.col("_host").alias("host"), *(F.col(f"_{c}").alias(c) for c in s)]
    leaves = cut.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count("_bad").alias("m"),
        F.coalesce(F.sum(F.col("_bad").cast("long")), F.lit(0)).cast("long").alias("bad"))
    found = learn_templates(materialize(leaves, "url-leaves"), depth, **params)
    found = found.select(*(F.col(c).alias(f"_f{c}") for c in ("host", *s)), F.col("template").alias("_template"),
                         F.col("purity").alias("_purity"), F.col("blocked").alias("_blocked"))
    on = reduce(lambda a, b: a & b, [F.col(f"_{c}") == F.col(f"_f{c}") for c in ("host", *s)])
    rule, verdict = match_rule(F.col("_host"), F.col("_path"), rules)
    return common.unpacked(cut.join(found, on, "left"), urls.columns, _url=F.struct(
        F.col("_host").alias("host"), F.col("_path").alias("path"), rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("_blocked"), "block").otherwise("allow")).alias("verdict"),
        F.col("_template").alias("template"), F.col("_purity").alias("purity")))


def oracle(urls_sql: str, rules: list[tuple[str, str, str]], depth: int = DEPTH, max_children: int = MAX_CHILDREN,
           min_support: int = MIN_SUPPORT, weight: float = WEIGHT, reject_z2: float = REJECT_Z2) -> str:
    """DuckDB SQL of ``judge_urls`` for a query giving ``page_id, url, bad``."""
    s = [f"s{i}" for i in range(1, depth + 1)]
    t = [f"t{i}" for i in range(1, depth + 1)]
    seg = []
    for i in range(1, depth + 1):
        raw = f"coalesce(parts[{i + 1}], '')" if i < depth else f"array_to_string(parts[{i + 1}:], '/')"
        shape = "stem"
        for pattern, name in reversed(SHAPES):
            shape = f"CASE WHEN regexp_matches(stem, '{pattern}') THEN '{name}' ELSE {shape} END"
        stem = rf"regexp_extract({raw}, '^(.*?)(\.[a-z]{{1,5}})?$', 1)"
        seg.append(f"({shape.replace('stem', stem)}) || regexp_extract({raw}, '\\.[a-z]{{1,5}}$') AS s{i}")
    ctes = [f"u AS ({urls_sql})",
            "r AS (SELECT *, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest0 FROM u)",
            f"h AS (SELECT *, translate(regexp_extract(coalesce(rest0, ''), '^[^/?#]*'), '{UPPER}', '{LOWERED}') AS host,"
            " regexp_extract(coalesce(rest0, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM r)",
            "p AS (SELECT *, string_split(path, '/') AS parts FROM h)",
            f"c AS (SELECT *, {', '.join(seg)} FROM p)",
            f"tree0 AS (SELECT host, {', '.join(s)}, count(*) AS n, count(bad) AS m,"
            f" coalesce(sum(bad::INT), 0) AS bad FROM c GROUP BY ALL)"]
    at = "tree0"
    for i in range(depth):
        node = ", ".join(["host", *t[:i]])
        ctes.append(f"wide{i} AS (SELECT {node}, count(*) > {max_children} AND sum(n) < count(*) * {min_support} AS wide"
                    f" FROM (SELECT {node}, {s[i]}, sum(n) AS n FROM {at} GROUP BY ALL) GROUP BY {node})")
        ctes.append(f"grown{i} AS (SELECT x.*, CASE WHEN wide THEN '*' ELSE {s[i]} END AS {t[i]}"
                    f" FROM {at} x JOIN wide{i} USING ({node}))")
        at = f"grown{i}"
    for i in reversed(range(depth)):
        rest = ", ".join(["host", *t[:i], *t[i + 1:]])
        ctes.append(f"branch{i} AS (SELECT {rest}, {t[i]}, sum(m)::DOUBLE AS bm, sum(bad)::DOUBLE AS bb FROM {at} GROUP BY ALL)")
        ctes.append(f"pool{i} AS (SELECT {rest}, count(*) AS k, sum(bm) AS pm, sum(bb) AS pb FROM branch{i} GROUP BY ALL)")
        ctes.append(f"to{i} AS (SELECT {rest}, {t[i]}, CASE WHEN k > 1 AND (bb * pm - pb * bm) * (bb * pm - pb * bm)"
                    f" <= {Z2} * bm * pb * (pm - pb) THEN '*' ELSE {t[i]} END AS dest FROM branch{i} JOIN pool{i} USING ({rest}))")
        ctes.append(f"merged{i} AS (SELECT x.* REPLACE (dest AS {t[i]}) FROM {at} x JOIN to{i} USING ({rest}, {t[i]}))".replace(
            "SELECT x.* REPLACE (dest AS", "SELECT * EXCLUDE (dest) REPLACE (dest AS"))
        at = f"merged{i}"
    keys = ", ".join(["host", *t])
    ctes.append(f"prior AS (SELECT coalesce(1 - sum(bad)::DOUBLE / nullif(sum(m), 0), 1.0) AS prior FROM {at})")
    ctes.append(f"total AS (SELECT {keys}, (sum(m) - sum(bad) + {weight} * any_value(prior)) / (sum(m) + {weight}) AS purity,"
                f" sum(m) AS pm, any_value(prior) AS prior FROM {at}, prior GROUP BY {keys})")
    ctes.append(f"found AS (SELECT host, {', '.join(s)}, concat_ws('/', {keys}) AS template, purity, prior > purity"
                f" AND (prior - purity) * (prior - purity) * (pm + {weight}) > {reject_z2} * (prior * (1 - prior)) AS blocked FROM {at} JOIN total USING ({keys}))")
    rule = verdict = "NULL"
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
        rule, verdict = f"CASE WHEN {fits} THEN '{h + p}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{v}' ELSE {verdict} END"
    return (f"WITH {', '.join(ctes)} SELECT page_id, host, path, {rule} AS rule,"
            f" coalesce({verdict}, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict,"
            f" template, purity FROM c JOIN found USING (host, {', '.join(s)})")
