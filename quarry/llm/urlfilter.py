"""URL filters: host and path rules found by their rarest literal token (DataFrame functions only).

A rule (host, path) fits its host and all subdomains where the url's path starts with the rule's; the longest fitting rule gives the
verdict, else `default`. Each rule is indexed under the one of its whole tokens that the fewest urls have; a url's tokens fetch the rules,
and only those run their regular expression. A rule without a whole token is tried on every url. Up to `broadcast_rules` rules the index
is a literal map inside the scan's own stage; larger rule sets are joined on the token. A null url, or one without `://`, has an empty host
and path; repeated rules are one; of equally long rules block wins. Other columns are ignored, empty tables give empty results.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: host, path, verdict.
Rules = list[tuple[str, str, str]]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_TOKEN = r"[A-Za-z0-9]+"


def parts(url) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path of a url."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.regexp_extract(url, _PARTS, 2)


def tokens_of_rule(host: str, path: str) -> list[str]:
    """Literal tokens that every fitting url has whole: all of the host, and those of the path that end inside it."""
    return re.findall(_TOKEN, host) + re.findall(_TOKEN + r"(?=[^A-Za-z0-9])", path)


def regex_of_rule(host: str, path: str) -> str:
    return r"^(?:[^/]*\.)?" + re.sub(r"([^A-Za-z0-9/])", r"\\\1", host + path)


def url_verdicts(pages: DataFrame, rules: Rules, default: str = "allow", broadcast_rules: int = 2000) -> DataFrame:
    """page_id, host, path, rule (host + path, or null), verdict of every url."""
    host, path = parts(F.col("url"))
    urls = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("tokens", F.array_distinct(F.regexp_extract_all(F.concat("host", "path"), F.lit(_TOKEN), F.lit(0))))
    rules = sorted(set(rules), key=lambda r: (r[2] == "block", r))
    index = _rarest(urls, rules)
    pick = _in_place if len(rules) <= broadcast_rules else _joined
    return pick(urls, rules, index, default)


def _rarest(urls: DataFrame, rules: Rules) -> list[str | None]:
    """For each rule, its token in the fewest urls; counts cover all urls, and only the rules' tokens come to the driver."""
    wanted = {t for h, p, _ in rules for t in tokens_of_rule(h, p)}
    if not wanted:
        return [None] * len(rules)
    spark = urls.sparkSession
    known = spark.createDataFrame([(t,) for t in sorted(wanted)], "token string")
    known = F.broadcast(known) if len(wanted) <= 100_000 else known
    seen = urls.select(F.explode("tokens").alias("token")).join(known, "token").groupBy("token").count()
    counts = {r["token"]: r["count"] for r in seen.collect()}
    return [min((counts.get(t, 0), t) for t in own)[1] if (own := tokens_of_rule(h, p)) else None for h, p, _ in rules]


def _rank(place: int, rule: tuple[str, str, str]) -> int:
    """Longer rules rank higher; among equally long ones the later place."""
    return (len(rule[0]) + len(rule[1])) * 1_000_000 + place


def _in_place(urls: DataFrame, rules: Rules, index: list[str | None], default: str) -> DataFrame:
    """Candidates from a literal map token -> rules; no shuffle."""

    def literal(k: int) -> F.Column:
        h, p, v = rules[k]
        return F.struct(F.lit(_rank(k, rules[k])).cast("long").alias("rank"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), F.lit(regex_of_rule(h, p)).alias("regex"))

    by_token: dict[str | None, list[F.Column]] = {}
    for k, token in enumerate(index):
        by_token.setdefault(token, []).append(literal(k))
    always = F.array(*by_token.pop(None)) if None in by_token else None
    found = []
    if by_token:
        # a token's rules are looked up among the url's own tokens; unknown tokens cost one comparison of hashes
        lookup = F.create_map(*(x for t, own in sorted(by_token.items()) for x in (F.lit(t), F.array(*own))))
        mine = F.array_intersect(F.col("tokens"), F.array(*(F.lit(t) for t in sorted(by_token))))
        found.append(F.flatten(F.transform(mine, lambda t: F.element_at(lookup, t))))
    if always is not None:
        found.append(always)
    if not found:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    site = F.concat("host", "path")
    fits = F.filter(F.concat(*found), lambda c: F.regexp_like(site, c["regex"]))
    best = F.array_max(F.transform(fits, lambda c: F.struct(c["rank"].alias("rank"), c["rule"].alias("rule"), c["verdict"].alias("verdict"))))
    return urls.select("page_id", "host", "path", best.alias("best")).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def _joined(urls: DataFrame, rules: Rules, index: list[str | None], default: str) -> DataFrame:
    """Candidates by a join on the token. Equal (host, path) are judged once, so a hot host or page costs one row."""
    rows = [(t, _rank(k, r), r[0] + r[1], r[2], regex_of_rule(r[0], r[1])) for k, (t, r) in enumerate(zip(index, rules, strict=True))]
    table = urls.sparkSession.createDataFrame(rows, "token string, rank long, rule string, verdict string, regex string")
    sites = urls.select("host", "path", "tokens").distinct()
    fits = sites.select("host", "path", F.explode("tokens").alias("token")).join(table.where("token is not null"), "token").where(F.regexp_like(F.concat("host", "path"), F.col("regex")))
    best = fits.groupBy("host", "path").agg(F.max(F.struct("rank", "rule", "verdict")).alias("best"))
    loose = [r for r in rows if r[0] is None]
    out = urls.join(best, ["host", "path"], "left")
    if loose:  # rules without a whole token are tried in place
        tried = _in_place(urls, [rules[k] for k, t in enumerate(index) if t is None], [None] * len(loose), default)
        rank = {r[2]: r[1] for r in loose}
        ranks = F.create_map(*(x for k, v in rank.items() for x in (F.lit(k), F.lit(v).cast("long"))))
        alone = tried.where("rule is not null").select("host", "path", F.struct(F.element_at(ranks, F.col("rule")).alias("rank"), "rule", "verdict").alias("other")).distinct()
        out = out.join(alone, ["host", "path"], "left").withColumn("best", F.greatest("best", "other"))
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
