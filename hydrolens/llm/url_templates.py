"""URL filter: fixed rules, and a tree of path templates per host for the rest.

Paths are cut into segments. From the root down, a segment stays as it is where it has a
fair share of its parent's pages; the others, which vary, become one wildcard. What lies
deeper than ``DEPTH`` segments is one rest. Pages that a rule judges are the labelled ones.
Siblings of like shape whose labelled shares differ less than chance explains are merged.
A template's purity, the share of allowed pages, is smoothed with that of the branch above
it, this one with its own, up to the host and all hosts; a template below the limit is
rejected, and a page without a rule gets its template's verdict.

Everything is DataFrame expressions; siblings that are not wildcards are few by their share,
so no window grows with the data.

Defined cases: a null url or one without ``://`` has an empty host and path and is judged
like any other, as is a very long one; no labelled pages at all: purity one half, which is allowed; of rules of equal
length the alphabetically first wins; repeated rows get equal results and null ids pass
through; an empty table gives an empty table. Results have the columns named here only, so
extra columns can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrolens.llm.tables import lower_ascii, written

DEPTH = 3
WILDCARD = "*"
SHARE = 0.05  # of the parent's pages that a segment needs to stay
LEAST = 3  # and pages
PRIOR = 5.0  # pages that the purity of the branch above counts for
ALIKE = 1.64  # standard deviations within which siblings are merged
LIMIT = 0.5  # purity below which a template is rejected


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self) -> Column:
        host = (F.col("host") == self.host) | F.col("host").endswith("." + self.host)
        return host & F.col("path").startswith(self.path)


# The rules.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id``, ``host`` and ``path``."""
    url = F.col(url_col).cast("string")
    after = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    after = F.coalesce(after, F.lit(""))
    host = lower_ascii(F.regexp_extract(after, "^[^/?#]*", 0))
    path = F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)
    return pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))


def ruled(rows: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``rule`` and ``label``, its verdict; null where no rule fits."""
    rule = label = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name), reverse=True):  # the last one asks first
        rule, label = F.when(r.fits(), r.name).otherwise(rule), F.when(r.fits(), r.verdict).otherwise(label)
    return rows.withColumns({"rule": rule, "label": label})


def templated(rows: DataFrame) -> DataFrame:
    """Adds ``t1`` to ``t{DEPTH}``, the segments or wildcards, and ``rest``."""
    bare = F.regexp_replace("path", "^/+|/+$", "")
    parts = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "/"))
    out = rows.withColumn("parts", parts)
    out = out.withColumns({f"s{d}": F.coalesce(F.get("parts", F.lit(d - 1)), F.lit("")) for d in range(1, DEPTH + 1)})
    out = out.withColumn("rest", (F.size("parts") > DEPTH).cast("int")).drop("parts")
    branch = ["host"]
    for d in range(1, DEPTH + 1):
        # Rare segments can't stay; they go before a host's segments meet in one task.
        often = (F.col("n") >= LEAST) | (F.col(f"s{d}") == "")
        own = out.groupBy(*branch, f"s{d}").agg(F.count("*").alias("n")).filter(often)
        whole = out.groupBy(*branch).agg(F.count("*").alias("whole"))
        stays = (F.col("n") >= F.col("whole") * SHARE) | (F.col(f"s{d}") == "")
        kept = own.join(whole, branch).filter(stays).select(*branch, f"s{d}", F.col(f"s{d}").alias(f"t{d}"))
        out = out.join(kept, [*branch, f"s{d}"], "left").withColumn(f"t{d}", F.coalesce(f"t{d}", F.lit(WILDCARD)))
        branch = [*branch, f"t{d}"]
    return out.drop(*[f"s{d}" for d in range(1, DEPTH + 1)])


def _merged(nodes: DataFrame, above: list[str], name: str) -> DataFrame:
    """Adds ``group``, a number that like siblings share; ``above`` is their parent."""
    order = Window.partitionBy(*above, "shape").orderBy("purity", name)
    n, p = F.col("labelled") + PRIOR, F.col("purity")
    before_n, before_p = F.lag(n).over(order), F.lag(p).over(order)
    pooled = (n * p + before_n * before_p) / (n + before_n)
    deviation = F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-9)) * (1 / n + 1 / before_n))
    parts = F.coalesce(((p - before_p) / deviation >= ALIKE).cast("int"), F.lit(0))
    steps = nodes.withColumn("step", parts)
    return steps.withColumn("group", F.sum("step").over(order)).drop("step")


def purities(leaves: DataFrame) -> DataFrame:
    """``host``, ``t1`` to ``t{DEPTH}``, ``rest`` and ``purity`` of every template, from its
    ``allowed`` and ``labelled`` pages."""
    sums = leaves.agg(F.sum("allowed").alias("a"), F.sum("labelled").alias("n")).first()
    overall = ((sums["a"] or 0) + 0.5 * PRIOR) / ((sums["n"] or 0) + PRIOR)

    def smooth(allowed, labelled, above) -> Column:
        return (F.col(allowed) + PRIOR * above) / (F.col(labelled) + PRIOR)

    levels = ["host", *[f"t{d}" for d in range(1, DEPTH + 1)], "rest"]
    added = [F.sum("allowed").alias("allowed"), F.sum("labelled").alias("labelled")]
    hosts = leaves.groupBy("host").agg(*added)
    branch = ["host"]  # merged branches have one name, so what lies below is added up too
    known = hosts.select("host", smooth("allowed", "labelled", F.lit(overall)).alias("above"))
    for d in range(1, len(levels)):
        name, merged = levels[d], F.concat_ws(":", "shape", "group").alias(f"m{d}")
        shape = F.max((F.col(levels[d + 1]) == WILDCARD).cast("int")) if d < DEPTH else F.lit(0)
        nodes = leaves.groupBy(*branch, name).agg(*added, shape.alias("shape")).join(known, branch)
        nodes = nodes.withColumn("purity", smooth("allowed", "labelled", F.col("above")))
        grouped = written(_merged(nodes, branch, name), "url-branches")
        pool = grouped.groupBy(*branch, "shape", "group").agg(*added, F.first("above").alias("over"))
        known = pool.select(*branch, merged, smooth("allowed", "labelled", F.col("over")).alias("above"))
        leaves = leaves.join(grouped.select(*branch, name, merged), [*branch, name])
        leaves = written(leaves, "url-leaves")
        branch = [*branch, f"m{d}"]
    return leaves.join(known, branch).select(*levels, F.col("above").alias("purity"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``template`` and its ``purity``."""
    rows = written(templated(ruled(parsed(pages, id_col, url_col), rules)), "url-templates")
    key = ["host", *[f"t{d}" for d in range(1, DEPTH + 1)], "rest"]
    allowed, labelled = F.count(F.when(F.col("label") == "allow", 1)), F.count("label")
    leaves = written(rows.groupBy(*key).agg(allowed.alias("allowed"), labelled.alias("labelled")), "url-leaves")
    known = rows.join(purities(leaves), key)
    shown = F.rtrim(F.concat_ws("/", *key[:-1]), F.lit("/"))
    learned = F.when(F.col("purity") < LIMIT, "block").otherwise("allow")
    return known.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("label", learned).alias("verdict"),
        F.when(F.col("rest") == 1, F.concat(shown, F.lit("/**"))).otherwise(shown).alias("template"),
        "purity",
    )
