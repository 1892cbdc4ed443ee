"""Repository and article addresses, as column expressions. What is not accepted gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts and the charset of a repository address.
REPOSITORY_HOST = "github.com"
ARTICLE_HOST_SUFFIX = ".hashnode.dev"
_PART = "[A-Za-z0-9][A-Za-z0-9._-]*"
_REPOSITORY = rf"^(?i:https://{REPOSITORY_HOST.replace('.', '[.]')})/({_PART})/({_PART}?)(?:\.git)?/?$"
_ARTICLE = r"^(?i:https)://(?:[^/?#@]*@)?([^/?#:@]+)(?::\d+)?(/[^?#]*)(\?[^#]*)?$"


def repository(url: Column) -> Column:
    """owner/name of an https address with exactly two path parts; no port, user, query or fragment."""
    owner = F.regexp_extract(url, _REPOSITORY, 1)
    name = F.regexp_extract(url, _REPOSITORY, 2)
    return F.when(url.rlike(_REPOSITORY) & (name != "") & ~F.lower(name).isin(".git"), F.concat_ws("/", owner, name))


def repository_url(url: Column) -> Column:
    """The address in its one form."""
    return F.concat(F.lit(f"https://{REPOSITORY_HOST}/"), repository(url))


def is_article(url: Column) -> Column:
    """An https address below a publication's host, with a path and no fragment."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _ARTICLE, 1)), r"\.+$", "")
    path = F.regexp_replace(F.regexp_extract(url, _ARTICLE, 2), "/", "")
    return F.coalesce(url.rlike(_ARTICLE) & host.endswith(ARTICLE_HOST_SUFFIX) & (F.length(host) > len(ARTICLE_HOST_SUFFIX)) & (path != ""), F.lit(False))


def article_endpoint(url: Column) -> Column:
    """The Markdown endpoint of an accepted article address: path with .md, query dropped."""
    return F.when(is_article(url), F.concat(F.regexp_replace(F.regexp_replace(url, r"\?[^#]*$", ""), "/+$", ""), F.lit(".md")))


def kind(source: Column) -> Column:
    """What a source is: article, repository, markdown, pages, archive, or null for none of them."""
    low = F.lower(source)
    return F.when(is_article(source), "article").when(repository(source).isNotNull(), "repository").when(low.rlike(r"\.(md|markdown)$"), "markdown").when(low.endswith(".pdf"), "pages").when(low.endswith(".zip"), "archive")
