"""URL filter: pattern rules found through the rarest literal token of each, host rules by longest match.

A pattern is plain text with ``*`` for any characters, ``^`` for a separator or the end, a leading or trailing ``|``
for the start or end of the url, and a leading ``@@`` for an exception. Its literal tokens are runs of letters and
digits that both ends of the text delimit, so that each of them is a whole token of any url that fits. A rule is
stored under the token that fewest urls hold; the tokens of a url fetch candidate rules and only those run their
regular expression. Rules without a token of that kind are candidates for every url.
"""

import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from trustdesk.llm.common import column, map_arrow

#: The host rules of the contract, in its order.
HOST_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: Patterns of urls that hold no text of their own: paging and tracking copies, logins, carts, searches, files.
PATTERNS = ["?page=*&ref=", "/login^", "/signin^", "/cart^", "/checkout^", "/wp-admin/", "sessionid=", "replytocom=",
            "/search?*q=", "/tag/", "/print/", "^utm_source=", ".exe|", ".zip|", ".jpg|", ".png|", "/feed/|",
            "://ads.", "://tracker.", "/es/*.html|", "@@/cart/manual^", "@@://docs."]
#: A rule set is sent to every task; a larger one is refused rather than broadcast.
MAX_RULES = 1_000_000
SEPARATOR = r"(?:[^0-9a-z_.%-]|\Z)"
VERDICT = StructType([StructField(n, StringType()) for n in ("host", "path", "rule", "verdict")])


def to_regex(pattern: str) -> str:
    """Regular expression of a pattern, in lower case, without its exception mark."""
    body = pattern.lower().removeprefix("@@")
    head, tail = body.startswith("|"), body.endswith("|")
    body = body[head:len(body) - tail]
    inner = "".join({"*": ".*", "^": SEPARATOR}.get(c, re.escape(c)) for c in body)
    return r"\A" * head + inner + r"\Z" * tail


def literal_tokens(pattern: str) -> list:
    """Tokens that every fitting url holds whole: letter and digit runs bounded by other characters of the pattern."""
    body = pattern.lower().removeprefix("@@")
    if body.startswith("|"):
        body = "^" + body[1:]
    if body.endswith("|"):
        body = body[:-1] + "^"
    return re.findall(r"(?<=[^0-9a-z*])[0-9a-z]+(?=[^0-9a-z*])", body)


def ascii_lower(c):
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def token_counts(pages: DataFrame, patterns, url="url") -> dict:
    """Number of urls that hold each literal token of the rules, over all rows; bounded by the rule set."""
    wanted = sorted({t for p in patterns for t in literal_tokens(p)})
    if not wanted:
        return {}
    spark = pages.sparkSession
    rules = spark.createDataFrame([(t,) for t in wanted], "token string")
    tokens = pages.select(F.explode(F.array_distinct(
        F.regexp_extract_all(ascii_lower(column(url)), F.lit("[0-9a-z]+"), F.lit(0)))).alias("token"))
    found = tokens.join(F.broadcast(rules), "token").groupBy("token").count().collect()
    return dict.fromkeys(wanted, 0) | {r["token"]: r["count"] for r in found}


def index_rules(patterns, counts) -> tuple:
    """Rules by the rarest token of each, and the rules that have no token."""
    if len(patterns) > MAX_RULES:
        raise ValueError(f"{len(patterns)} rules; at most {MAX_RULES} are sent to the tasks")
    by_token, rest = {}, []
    for p in patterns:
        rule = (to_regex(p), p.startswith("@@"))
        tokens = literal_tokens(p)
        where = by_token.setdefault(min(tokens, key=lambda t: (counts.get(t, 0), t)), []) if tokens else rest
        where.append(rule)
    return by_token, rest


def host_table(rules) -> dict:
    """Host rules by host, longest first."""
    table = {}
    for verdict, rule in rules:
        host, slash, path = rule.partition("/")
        table.setdefault(host, []).append((rule, slash + path, verdict))
    return {h: sorted(r, key=lambda x: -len(x[0])) for h, r in table.items()}


def judge(pages: DataFrame, patterns=PATTERNS, host_rules=HOST_RULES, url="url", keep=None) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` of each url.

    A null url, or one without ``://``, has an empty host and path, and only patterns can block it. A url that no
    host rule fits is blocked if a pattern fits and no exception does. Input columns named like a result column are
    replaced. One pass to count the tokens of the rules, one to judge; neither moves a row between tasks.
    """
    by_token, rest = index_rules(patterns, token_counts(pages, patterns, url))
    hosts = host_table(host_rules)
    lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

    def start():
        compiled = {}
        address = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
        token = re.compile(r"[0-9a-z]+")

        def fits(rule, text):
            if rule[0] not in compiled:
                compiled[rule[0]] = re.compile(rule[0], re.S)
            return compiled[rule[0]].search(text) is not None

        def host_rule(host, path):
            best, labels = None, host
            while True:
                for rule in hosts.get(labels, ()):
                    if path.startswith(rule[1]) and (best is None or len(rule[0]) > len(best[0])):
                        best = rule
                if "." not in labels:
                    return best
                labels = labels.partition(".")[2]

        def blocked(text):
            candidates = [r for t in sorted(set(token.findall(text))) for r in by_token.get(t, ())] + rest
            hit = any(fits(r, text) for r in candidates if not r[1])
            return hit and not any(fits(r, text) for r in candidates if r[1])

        def one(text):
            text = text or ""
            low = text.encode().translate(lower).decode()
            found = address.search(text)
            host = found[1].encode().translate(lower).decode() if found else ""
            path = found[2] if found else ""
            rule = host_rule(host, path) if found else None
            return host, path, rule and rule[0], rule[2] if rule else "block" if blocked(low) else "allow"

        return lambda urls: [pa.array(x, pa.string()) for x in zip(*map(one, urls.to_pylist()), strict=True)]

    return map_arrow(pages, [column(url)], VERDICT, start, keep)


def oracle(patterns=PATTERNS, host_rules=HOST_RULES) -> str:
    """SQL for ``judge`` over ``pages``: every pattern runs on every url."""
    def fits(p):
        text = to_regex(p).replace(r"\A", "^").replace(r"\Z", r"\z").replace("'", "''")
        return f"regexp_matches(low, '(?s){text}')"

    block = " OR ".join(fits(p) for p in patterns if not p.startswith("@@")) or "false"
    allow = " OR ".join(fits(p) for p in patterns if p.startswith("@@")) or "false"
    ranked = sorted(host_rules, key=lambda r: -len(r[1]))

    def when(rule):
        host, slash, path = rule.partition("/")
        return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash + path}')"

    rules = " ".join(f"WHEN {when(r)} THEN '{r}'" for _, r in ranked)
    verdicts = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for v, r in ranked)
    upper, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH parts AS (
  SELECT page_id, translate(coalesce(url, ''), '{upper}', '{small}') AS low,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{upper}', '{small}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
ruled AS (SELECT *, CASE {rules} END AS rule FROM parts)
SELECT page_id, host, path, rule,
       CASE {verdicts} WHEN ({block}) AND NOT ({allow}) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled"""
