"""URL filtering by association rules.

Labelled URLs become baskets of all their tokens. FP-growth mines the sets of tokens that are frequent among the bad ones: the tree is a
distributed table of its paths with counts of all and of bad URLs, and each round grows every set by the tokens of its conditional paths.
Rules tokens -> block are kept by support, confidence and significance and pruned to their smallest antecedents. An inverted index from each rule's
rarest token finds the rules that can match a URL. Listed rules (host and path) come first.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusflow.llm.common import arrow_map
from locusflow.session import cut, prepare

#: Of the labelled urls, the share and the number that a rule must block rightly, the share of its own that must be bad, and its least
#: chi-square statistic (one in a thousand by chance).
SUPPORT, LEAST, CONFIDENCE, CHI2 = 0.005, 20, 0.6, 10.83
#: Tokens of a rule, at most.
LARGEST = 3
#: Rules sent to the executors at once; more rules go in several rounds.
INDEX = 50_000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


LISTED = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host(url: Column) -> Column:
    """Between the first :// and the next / ? # or the end, A-Z lower-cased; empty for a null url or one without ://."""
    return F.coalesce(_lower(F.regexp_extract(_rest(url), r"\A([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: Column) -> Column:
    """Distinct tokens: host labels by place from the right, its two last labels, scheme, path segments (digits as #), ending, query keys, fragment. A null url has none."""
    h, p = host(url), path(url)
    labels = F.filter(F.reverse(F.split(h, r"\.")), lambda x: x != "")
    segments = F.filter(F.split(F.regexp_replace(p, r"\d+", "#"), "/"), lambda x: x != "")
    query = F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "[&;]"), lambda x: x != "")
    one = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.array(F.concat(F.lit(name), c))).otherwise(F.array().cast("array<string>"))
    all_ = F.concat(
        one("scheme:", F.regexp_extract(url, r"\A([A-Za-z][A-Za-z0-9+.-]*)://", 1)),
        F.transform(labels, lambda x, i: F.concat(F.lit("host"), i.cast("string"), F.lit(":"), x)),
        one("site:", F.regexp_extract(h, r"([^.]+\.[^.]+)\z", 1)),
        F.transform(segments, lambda x, i: F.concat(F.lit("path"), i.cast("string"), F.lit(":"), x)),
        one("end:", F.regexp_extract(p, r"\.([A-Za-z0-9]+)\z", 1)),
        F.transform(query, lambda x: F.concat(F.lit("query:"), F.regexp_extract(x, r"\A([^=]*)", 1))),
        one("fragment:", F.regexp_extract(url, r"#(.+)\z", 1)),
    )
    return F.coalesce(F.array_distinct(all_), F.array().cast("array<string>"))


def _chi2(hits: Column, all_: Column, bad: int, n: int) -> Column:
    """Statistic of the two-by-two table of a match (``all_`` urls, ``hits`` of them bad) and badness (``bad`` of ``n``)."""
    x, m = hits.cast("double"), all_.cast("double")
    odd = x * F.lit(float(n)) - m * F.lit(float(bad))
    return odd * odd * F.lit(float(n)) / F.greatest(m * (F.lit(float(n)) - m) * F.lit(float(bad) * float(n - bad)), F.lit(1e-9))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST, chi2: float = CHI2, largest: int = LARGEST) -> DataFrame:
    """rule_id, antecedent (array of tokens), support, confidence of the rules antecedent -> block.

    ``labelled``: url, bad (boolean); rows with a null in either teach nothing. A rule blocks at least ``least`` bad labelled urls and ``support`` of
    all labelled ones, is right at least ``confidence`` of the time and beyond chance by ``chi2``, and has at most ``largest`` tokens; one that
    holds a smaller rule's antecedent changes no verdict and is pruned. Every such rule is found, however many tokens a url has: tokens that occur in the
    same labelled urls, as the keys of one long query string do, are mined as one. No labelled rows, or none bad, give no rules.
    """
    spark = prepare(labelled.sparkSession)
    none = spark.createDataFrame([], "rule_id long, antecedent array<string>, support double, confidence double")
    base = cut(labelled.where("url is not null and bad is not null").select(tokens(F.col("url")).alias("items"), "bad").where(F.size("items") > 0))
    n, bad = base.agg(F.count("*"), F.count_if("bad")).first()
    need = max(least, math.ceil(support * n - 1e-9))
    if bad < need:
        return none
    good = (F.col("x") / F.col("m") >= confidence) & (_chi2(F.col("x"), F.col("m"), bad, n) >= chi2)
    held = base.withColumn("id", F.monotonically_increasing_id()).select("id", "bad", F.explode("items").alias("token"))
    urls = F.struct(F.bit_xor(F.xxhash64("id")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("b"))
    single = held.groupBy("token").agg(F.count("*").alias("m"), F.count_if("bad").alias("x"), urls.alias("urls")).where(F.col("x") >= need)  # a token of fewer bad urls is in no rule
    alike = cut(single.groupBy("m", "x", "urls").agg(F.min("token").alias("token"), F.collect_list("token").alias("same")))
    # the tree of FP-growth as a table of its paths, commonest token first; what holds a rule of one token is superfluous
    told = held.join(alike.where(~good).select("token", F.col("m").alias("often")), "token").groupBy("id").agg(F.first("bad").alias("bad"), F.sort_array(F.collect_list(F.struct(-F.col("often"), "token"))).alias("items"))
    paths = told.groupBy(F.array().cast("array<string>").alias("suffix"), F.col("items.token").alias("items")).agg(F.count("*").alias("m"), F.count_if("bad").alias("x"))
    rules, grown = alike.where(good).select(F.array("token").alias("items"), "m", "x"), alike.where(~good).select(F.array().cast("array<string>").alias("suffix"), "token")
    for size in range(2, largest + 1):  # conditional paths of each set that is not a rule, and the sets that they make
        ends = paths.select("suffix", "items", "m", "x", F.posexplode("items").alias("pos", "token")).where("pos > 0").join(grown, ["suffix", "token"])
        paths = cut(ends.groupBy(F.concat("suffix", F.array("token")).alias("suffix"), F.slice("items", 1, F.col("pos")).alias("items")).agg(F.sum("m").alias("m"), F.sum("x").alias("x")))
        sets = cut(paths.select("suffix", "m", "x", F.explode("items").alias("token")).groupBy("suffix", "token").agg(F.sum("m").alias("m"), F.sum("x").alias("x")).where(F.col("x") >= need))
        if sets.isEmpty():
            break
        rules, grown = rules.unionByName(sets.where(good).select(F.concat("suffix", F.array("token")).alias("items"), "m", "x")), sets.where(~good).select("suffix", "token")
    rules = cut(rules.withColumn("items", F.array_sort("items")).withColumn("rule", F.xxhash64(F.array_join("items", "\n"))))
    # a rule of at most `largest` tokens has few proper subsets: those that are rules themselves make it superfluous
    subsets = rules.where(F.size("items") > 1).select("rule", "items", F.explode(F.expr("sequence(1, shiftleft(1, size(items)) - 2)")).alias("mask"))
    sub = F.filter("items", lambda x, i: F.getbit(F.col("mask"), i) == 1)
    inner = subsets.select("rule", F.xxhash64(F.array_join(sub, "\n")).alias("inner")).join(rules.select(F.col("rule").alias("inner")), "inner").select("rule").distinct()
    whole = rules.join(inner, "rule", "left_anti").withColumn("antecedent", F.array().cast("array<string>"))
    each = cut(alike.select("token", F.explode("same").alias("own")))
    for i in range(largest):  # every choice of one token for each that was mined as one with it
        whole = whole.withColumn("token", F.get("items", F.lit(i))).join(each, "token", "left").withColumn("antecedent", F.concat("antecedent", F.array_compact(F.array("own")))).drop("token", "own")
    antecedent = F.array_sort("antecedent")
    return whole.select(F.xxhash64(F.array_join(antecedent, "\n")).alias("rule_id"), antecedent.alias("antecedent"), (F.col("x") / F.lit(n)).alias("support"), (F.col("x") / F.col("m")).alias("confidence"))


def _indexes(rules: DataFrame, index: int = INDEX) -> Iterator[dict[str, list[tuple[int, frozenset]]]]:
    """Inverted indexes (rarest token: rules) of at most about ``index`` of the rules (rule_id, items) each."""
    n = rules.count()
    rounds = -(-n // index) + (n > index)
    for r in range(rounds):
        part = rules.where(F.pmod(F.col("rule_id"), F.lit(rounds)) == r).select("rule_id", "items").toArrow().to_pylist()
        seen = Counter(t for a in part for t in a["items"])
        post: dict[str, list[tuple[int, frozenset]]] = {}
        for a in part:
            post.setdefault(min(a["items"], key=lambda t: (seen[t], t)), []).append((a["rule_id"], frozenset(a["items"])))
        if post:
            yield post


def matched(df: DataFrame, rules: DataFrame, url: str = "url", index: int = INDEX) -> DataFrame:
    """``df`` with mined (boolean; replaced where it exists): whether a rule's tokens all occur in the url. Rules travel as inverted indexes of at most ``index`` rules."""
    df = df.drop("mined")
    out, names, own = df.withColumn("mined", F.lit(False)), df.columns, "_url_tokens"
    for post in _indexes(cut(rules.select("rule_id", F.col("antecedent").alias("items"))), index):
        sent = df.sparkSession.sparkContext.broadcast(post)

        def f(b: pa.RecordBatch, sent=sent) -> pa.RecordBatch:
            found = []
            for done, toks in zip(b.column("mined").to_pylist(), b.column(own).to_pylist(), strict=True):
                have = set(toks)
                found.append(done or any(rule <= have for t in have for _, rule in sent.value.get(t, ())))
            return pa.record_batch({c: b.column(c) for c in names} | {"mined": pa.array(found, pa.bool_())})

        out = arrow_map(out.withColumn(own, tokens(F.col(url))), f, ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", mined boolean")
    return out


def listed(h: Column, p: Column, rules: tuple[Rule, ...] = LISTED) -> tuple[Column, Column]:
    """(rule, verdict) of the longest listed rule that fits, or nulls: its host or a subdomain, and a path that starts with its own."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the last to fit is the longest
        fits = ((h == r.host) | F.endswith(h, F.lit("." + r.host))) & F.startswith(p, F.lit(r.path))
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def judge(pages: DataFrame, labelled: DataFrame, rules: tuple[Rule, ...] = LISTED, **mining) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), mined of every page url.

    A listed rule's verdict holds; else a url that a mined rule matches is blocked and any other allowed. Null urls and urls
    without :// have empty host and path and are allowed. Urls are read whole whatever their length. Equal urls get equal verdicts, one row per
    row; an empty table gives none; other columns of ``pages`` play no part. ``mining``: options of ``mine``.
    """
    got = matched(pages.select("page_id", "url"), mine(labelled, **mining))
    h, p = host(F.col("url")), path(F.col("url"))
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    return got.select("page_id", h.alias("host"), p.alias("path"), "mined").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("mined"), "block").otherwise("allow")).alias("verdict"), "mined")
