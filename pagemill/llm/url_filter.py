"""URL filtering by given rules and by association rules mined from labels."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations, product

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.shelf import put, table

#: (host, path, verdict)
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
ALLOW, BLOCK = "verdict=allow", "verdict=block"


@dataclass(frozen=True)
class Mined:
    """A rule: all of items in a URL speak for blocking it."""

    items: tuple[str, ...]
    confidence: float
    support: int


def host_path(url: str) -> tuple[Column, Column]:
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.expr(f"substring({url}, locate('://', {url}) + 3)"))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), upper, upper.lower())
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(rules: list[tuple[str, str, str]], host: str, path: str) -> tuple[Column, Column]:
    """The longest rule that fits, as written, and its verdict; else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((F.col(host) == h) | F.col(host).endswith("." + h)) & F.col(path).startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def tokens(url: str, host: str, path: str) -> Column:
    """What a URL says besides numbers: scheme, host, each parent domain, each
    path part (digits as #), the last part's ending, query keys, a fragment."""
    labels = F.split(F.col(host), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("domain="), F.array_join(F.slice(labels, i, F.size(labels) - i + 1), ".")))
    bare = F.regexp_replace(F.col(path), r"\.[A-Za-z0-9]{1,8}$", "")
    parts = F.filter(F.split(F.regexp_replace(bare, "[0-9]+", "#"), "/"), lambda p: (p != "") & (p != "#"))
    ending = F.regexp_extract(F.col(path), r"\.([A-Za-z0-9]{1,8})$", 1)
    keys = F.regexp_extract_all(F.regexp_extract(F.col(url), r"\?([^#]*)", 1), F.lit(r"(?:^|&)([^=&]+)"), 1)
    one = lambda c, v: F.when(c, F.array(v)).otherwise(F.expr("cast(array() as array<string>)"))
    return F.coalesce(
        F.array_distinct(
            F.concat(
                one(F.col(host) != "", F.concat(F.lit("scheme="), F.lower(F.regexp_extract(F.col(url), r"^([^:]*)://", 1)))),
                F.when(F.col(host) != "", domains).otherwise(F.expr("cast(array() as array<string>)")),
                F.transform(parts, lambda p: F.concat(F.lit("part="), p)),
                one(ending != "", F.concat(F.lit("ending="), ending)),
                F.transform(keys, lambda k: F.concat(F.lit("key="), k)),
                one(F.col(url).contains("#"), F.lit("fragment")),
            )
        ),
        F.expr("cast(array() as array<string>)"),
    )


def mine(labelled: DataFrame, support: float = 0.01, least: int = 20, confidence: float = 0.8, longest: int | None = 3) -> list[Mined]:
    """Blocking rules of (tokens, bad) rows by FP-growth: token sets of at most
    `longest` (None: of any size) that `support` of the rows have (and `least` rows), bad ones among
    them to `confidence`. A rule that a part of it equals or betters goes.
    Tokens of 19 rows in 20 or more say nothing and are left out. Tokens that
    stand in the very same rows are one item while sets are mined, so that many
    of them don't make every set of them frequent; each rule then holds for
    each choice of them."""
    rows = put(labelled.where("bad is not null").select("tokens", "bad"), "labelled")
    n = rows.count()
    if not n:
        return []
    everywhere = [r.t for r in rows.select(F.explode("tokens").alias("t")).groupBy("t").count().where(F.col("count") >= 0.95 * n).select("t").collect()]
    # of tokens with the same rows, told by 128 bits of these, the first stands for all
    each = rows.withColumn("row", F.monotonically_increasing_id()).select("row", F.explode(F.array_distinct("tokens")).alias("t"))
    alike = each.groupBy("t").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y"))
    classes = alike.where(F.col("n") >= max(support * n, least)).groupBy("n", "x", "y").agg(F.sort_array(F.collect_list("t")).alias("ts")).where(F.size("ts") > 1)
    same = {r.ts[0]: r.ts for r in classes.select("ts").collect()}
    everywhere = sorted({*everywhere, *(t for ts in same.values() for t in ts[1:])})
    kept = F.filter("tokens", lambda t: ~t.isin(everywhere)) if everywhere else F.col("tokens")
    baskets = rows.select(F.concat(kept, F.array(F.when(F.col("bad") == 1, BLOCK).otherwise(ALLOW))).alias("items"))
    share = max(support, least / n)
    if share > 1:
        return []
    model = FPGrowth(itemsCol="items", minSupport=share * confidence, minConfidence=confidence).fit(baskets)
    found = (
        model.associationRules.where(F.array_contains("consequent", BLOCK) & ~F.array_contains("antecedent", ALLOW) & (F.lit(True) if longest is None else F.size("antecedent") <= longest))
        .where((F.col("lift") > 1) & (F.col("support") / F.col("confidence") >= share))
        .orderBy(F.size("antecedent"), F.desc("confidence"), F.desc("support"), F.sort_array("antecedent"))
        .collect()
    )
    out: dict[tuple[str, ...], Mined] = {}
    chosen = ((tuple(sorted(c)), r) for r in found for c in product(*[same.get(t, [t]) for t in r.antecedent]))
    for items, r in chosen:
        if 2 ** len(items) < len(out):
            parts = (out[p] for k in range(1, len(items)) for p in combinations(items, k) if p in out)
        else:
            parts = (m for p, m in out.items() if set(p) <= set(items))
        if not any(m.confidence >= r.confidence for m in parts):
            out[items] = Mined(items, float(r.confidence), round(r.support * n / r.confidence))
    return list(out.values())


def best_mined(rules: list[Mined], tokens_col: str) -> Column:
    """The confidence of the surest mined rule that a row's tokens complete,
    else null, by inverted index: each token names its rules, and a rule holds
    when as many tokens name it as it has."""
    if not rules:
        return F.lit(None).cast("double")
    index: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        for t in r.items:
            index.setdefault(t, []).append(i)
    names = F.create_map(*[c for t, ids in index.items() for c in (F.lit(t), F.array(*[F.lit(i) for i in ids]))])
    sizes, sure = F.array(*[F.lit(len(r.items)) for r in rules]), F.array(*[F.lit(r.confidence) for r in rules])
    named = F.flatten(F.transform(F.filter(tokens_col, lambda t: F.array_contains(F.array(*[F.lit(t) for t in index]), t)), lambda t: names[t]))
    whole = F.filter(F.array_distinct(named), lambda i: F.size(F.filter(named, lambda j: j == i)) == sizes[i])
    return F.array_max(F.transform(whole, lambda i: sure[i]))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], mined: list[Mined], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id_col, host, path, rule, verdict, confidence) per row: the longest
    given rule decides, else a mined rule blocks, else the page is allowed.

    Null URLs and those without :// have empty host and path, no rule and are
    allowed. Null ids and repeated rows pass; extra columns are left out.
    """
    host, path = host_path("url")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url")).withColumn("host", host).withColumn("path", path)
    rule, verdict = rule_of(rules, "host", "path")
    return (
        rows.withColumn("rule", rule)
        .withColumn("given", verdict)
        .withColumn("tokens", tokens("url", "host", "path"))
        .withColumn("confidence", best_mined(mined, "tokens"))
        .select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("given", F.when(F.col("confidence").isNotNull(), "block"), F.lit("allow")).alias("verdict"), "confidence")
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages carry the id of the document that they show as the number of their
    path; that document's quality label is the page's."""
    pages = table(spark, sf_dir, "pages")
    host, path = host_path("url")
    asked = pages.select("url").withColumn("host", host).withColumn("path", path)
    shown = asked.select(F.expr("try_cast(regexp_extract(path, '([0-9]+)(?:[.][a-z]+)?/?$', 1) as bigint)").alias("doc_id"), tokens("url", "host", "path").alias("tokens"))
    labels = table(spark, sf_dir, "labels").where("quality in (0, 1)").groupBy("doc_id").agg(F.max(1 - F.col("quality")).alias("bad"))
    return judge(pages, RULES, mine(shown.join(labels, "doc_id"), longest=None))


QUERIES = {"op4_url_filter": op4_url_filter}
ORACLE: dict[str, str] = {}
