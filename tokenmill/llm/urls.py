"""URL verdicts by host and path rules that spread over redirects and canonical links.

A rule decides a URL whose host is the rule's or a subdomain of it and whose path starts
with the rule's; of several the longest does. Pages that name another URL as their own, by
a canonical link or a redirect, and the URLs they name are aliases. The aliases of one
connected component share decisions: a URL without a rule of its own is allowed if any
alias has an allow rule, else blocked if any has a block rule, else allowed. So an explicit
allow takes precedence over a block that comes along a link, and no alias overrides a
URL's own rule.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.components import connected

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"),
         ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: what is no tag of the page; attributes start after white space, a quote or a slash
_HIDDEN = r"""(?is)<!--.*?-->|<script\b.*?</script\s*>"""
_LINK = r"""(?is)<link\b[^>]*>"""
_META = r"""(?is)<meta\b[^>]*>"""
_CANONICAL = r"""(?is)(?<=[\s"'/])rel\s*=\s*["']?\s*([^"'>]*\s)?canonical[\s"'>/]"""
_REFRESH = r"""(?is)(?<=[\s"'/])http-equiv\s*=\s*["']?\s*refresh[\s"'>/]"""
_HREF = r"""(?is)(?<=[\s"'/])href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
_TARGET = r"""(?is)(?<=[\s"'/])content\s*=\s*["']?[^"'>]*?\burl\s*=\s*['"]?\s*([^"'>\s]+)"""

#: names of character references
_ENTITIES = (("amp", "&"), ("AMP", "&"), ("lt", "<"), ("LT", "<"), ("gt", ">"), ("GT", ">"),
             ("quot", '"'), ("QUOT", '"'), ("apos", "'"))


def _lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty
    for NULL and where there is no ``://``."""
    return F.coalesce(_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _rules(rules) -> list[tuple[str, str, str]]:
    """(host, path, verdict), the longest first."""
    return sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))


def _first_rule(rules, of, host_name: Column, path_name: Column) -> Column:
    found = F.lit(None).cast("string")
    for rule in reversed(_rules(rules)):
        at_host = (host_name == rule[0]) | host_name.endswith("." + rule[0])
        found = F.when(at_host & path_name.startswith(rule[1]), F.lit(of(rule))).otherwise(found)
    return found


def key(url: Column) -> Column:
    """What makes two URLs the same node: host, path and query, without scheme and fragment;
    NULL where there is no host."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    return F.when(host(url) != "", F.concat(host(url), path(url), query))


def _unquoted(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"""^["']|["']$""", ""))


def _character(code: Column) -> Column:
    """The character with a number in hexadecimal digits; NULL where there is none."""
    value = F.conv(code, 16, 10).cast("long")
    known = (value > 0) & (value <= 0x10FFFF) & ~value.between(0xD800, 0xDFFF)
    return F.decode(F.unhex(F.lpad(F.when(known, code), 8, "0")), "UTF-32")


def decoded(text: Column) -> Column:
    """``text`` with numeric character references and those of XML replaced, once."""
    def part(piece):
        decimal = F.conv(F.regexp_extract(piece, r"^#0*([0-9]{1,7});", 1), 10, 16)
        digits = F.regexp_extract(piece, r"^#[xX]0*([0-9A-Fa-f]{1,6});", 1)
        found = F.coalesce(_character(F.nullif(digits, F.lit(""))), _character(decimal))
        for name, character in _ENTITIES:
            found = F.when(piece.startswith(name + ";"), F.lit(character)).otherwise(found)
        return F.coalesce(F.concat(found, F.regexp_replace(piece, r"(?s)^[^;]*;", "")), F.concat(F.lit("&"), piece))

    pieces = F.split(text, "&")
    whole = F.concat(F.element_at(pieces, 1), F.array_join(F.transform(F.slice(pieces, 2, F.size(pieces)), part), ""))
    return F.when(text.contains("&"), whole).otherwise(text)


def named_urls(html: Column) -> Column:
    """What the canonical links and the redirect tags of a page point to; those in comments
    and scripts are none."""
    html = F.regexp_replace(html, _HIDDEN, " ")
    link = F.filter(F.regexp_extract_all(html, F.lit(_LINK), 0), lambda tag: tag.rlike(_CANONICAL))
    meta = F.filter(F.regexp_extract_all(html, F.lit(_META), 0), lambda tag: tag.rlike(_REFRESH))
    href = F.transform(link, lambda tag: _unquoted(F.regexp_extract(tag, _HREF, 1)))
    target = F.transform(meta, lambda tag: _unquoted(F.regexp_extract(tag, _TARGET, 1)))
    return F.filter(F.transform(F.concat(href, target), lambda url: F.trim(decoded(url))), lambda url: url != "")


def resolved(named: Column, base: Column) -> Column:
    """``named`` as a whole URL, relative to the page's own; dot segments stay as they are,
    and addresses that are not of the web, such as ``mailto:``, are NULL."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?://)", 1)
    folder = F.regexp_replace(path(base), r"[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (F.when(named.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.\-]*://"), named)
            .when(named.startswith("//"), F.concat(F.regexp_extract(scheme, r"(?s)^(.*?:)//", 1), named))
            .when(named.startswith("/"), F.concat(scheme, host(base), named))
            .when(named.rlike(r"^[?#]"), F.concat(scheme, host(base), path(base), named))
            .when(named.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.\-]*:"), F.lit(None))
            .otherwise(F.concat(scheme, host(base), folder, named)))


def aliases(pages: DataFrame) -> DataFrame:
    """(a, b): the node of each page that names other URLs, and the node of each of those."""
    named = pages.where(F.col("html").rlike(r"(?i)canonical|refresh")) \
        .select("url", F.explode_outer(named_urls(F.col("html"))).alias("named")).where("named is not null")
    edges = named.select(key(F.col("url")).alias("a"), key(resolved(F.col("named"), F.col("url"))).alias("b"))
    return edges.where("a is not null and b is not null and a <> b").distinct()


def verdicts(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of ``pages``; rule is the deciding
    rule's host and path, NULL where none fits.

    A URL that is NULL or has no ``://`` has neither host nor path, fits no rule, has no
    aliases and is allowed. NULL html names nothing. Repeated rows give a row each.
    """
    pages = pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string"))
    edges = aliases(pages)
    components = connected(edges)
    node_host = F.regexp_extract("node", r"(?s)^([^/?]*)", 1)
    node_path = F.regexp_extract("node", r"(?s)^[^/?]*([^?]*)", 1)
    explicit = _first_rule(rules, lambda r: r[2], node_host, node_path)
    shared = (components.withColumn("explicit", explicit).groupBy("component")
              .agg(F.max((F.col("explicit") == "allow").cast("int")).alias("allowed"),
                   F.max((F.col("explicit") == "block").cast("int")).alias("blocked")))
    spread = (components.join(shared, "component")
              .select(F.col("node").alias("key"),
                      F.when(F.col("allowed") == 1, "allow").when(F.col("blocked") == 1, "block").alias("spread")))
    judged = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"),
                          key(F.col("url")).alias("key"))
    own = {"rule": lambda r: r[0] + r[1], "own": lambda r: r[2]}
    judged = judged.select("*", *(_first_rule(rules, of, F.col("host"), F.col("path")).alias(name)
                                  for name, of in own.items()))
    return (judged.join(spread, "key", "left")
            .select("page_id", "host", "path", "rule",
                    F.coalesce("own", "spread", F.lit("allow")).alias("verdict")))
