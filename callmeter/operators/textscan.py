"""Text that should not be published: home paths, e-mails, unknown domains, listed terms, line by line."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

c = F.col
# fixed values: what to look for, and what is allowed
HOME_PATH = r"(?:/home/|/Users/|/root/|[A-Za-z]:\\+Users\\+)[\p{L}\p{N}_.-]+"
EMAIL = r"(?i)[\p{L}\p{N}][\p{L}\p{N}_.+-]*@[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)*\.[a-z]{2,}"
URL_HOST = r"(?i)https?://([\p{L}\p{N}_.-]+)"
ALLOWED_EMAIL = r"(?i)^(?:noreply@github\.com|[\p{L}\p{N}_.+-]+@users\.noreply\.github\.com|[\p{L}\p{N}_.+-]+@example\.(?:com|org|net))$"
ALLOWED_DOMAINS = ("github.com", "githubusercontent.com", "python.org", "docs.python.org", "peps.python.org", "pypi.org", "opensource.org",
                   "example.com", "example.org", "keepachangelog.com", "semver.org", "pipx.pypa.io")


def scan_text(texts: DataFrame, key: str, text: str, deny: DataFrame | list[str] = (), allowed=ALLOWED_DOMAINS) -> DataFrame:
    """(key, line, kind, value) for every finding; `deny` terms match anywhere, whatever their case.

    A cheap test on the whole text comes before it is cut into lines. A list of terms becomes one
    expression; a DataFrame of terms (column `term`) is joined instead.
    """
    terms = None if isinstance(deny, DataFrame) else [t.lower() for t in deny]
    suspect = c(text).contains("@") | c(text).contains("://") | c(text).rlike(HOME_PATH)
    if terms is None:
        suspect = F.lit(True)
    for t in terms or ():
        suspect = suspect | F.lower(text).contains(t)
    lines = texts.filter(suspect).select(c(key), F.posexplode(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")).alias("n", "s"))
    found = lambda kind, values: F.transform(values, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("value")))
    every = lambda pattern, group=0: F.regexp_extract_all("s", F.lit(pattern), F.lit(group))
    mails = F.filter(every(EMAIL), lambda m: ~m.rlike(ALLOWED_EMAIL))

    def known(host):
        h = F.regexp_replace(F.lower(host), r"\.+$", "")
        ok = h.isin(*allowed)
        for d in allowed:
            ok = ok | h.endswith("." + d)
        return ok

    parts = [found("home path", every(HOME_PATH)), found("email", mails),
             found("domain", F.filter(every(URL_HOST, 1), lambda h: ~known(h)))]
    if terms:
        hits = F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.lower("s").contains(t))
        parts.append(found("denied term", hits))
    out = lines.select(key, (c("n") + 1).alias("line"), F.explode(F.concat(*parts)).alias("f")).select(key, "line", "f.kind", "f.value")
    if terms is None:
        named = lines.join(deny.select(F.lower("term").alias("term")), F.lower(c("s")).contains(c("term"))).select(
            key, (c("n") + 1).alias("line"), F.lit("denied term").alias("kind"), c("term").alias("value"))
        out = out.unionByName(named)
    return out
