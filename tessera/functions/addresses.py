"""Web addresses and the HTML attributes that hold them, as Column builders."""

from __future__ import annotations

import html as entities

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .dates import let

_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
#: What is no markup of the page itself.
_HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b([^>]*)>.*?(?:</\1\s*>|\z)"
_INSIDE = "(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
_ATTRIBUTE = r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|(?!["'])[^\s>]+))?"""
_EDGE = r"(?U)^\s+|\s+$"


@F.pandas_udf(ArrayType(StringType()))
def unescaped(texts: pd.Series) -> pd.Series:
    """Texts with all character references of HTML resolved, for which Spark has no function: Arrow batches."""
    return texts.map(lambda xs: [None if x is None else entities.unescape(x) if "&" in x else x for x in xs], na_action="ignore")


def _joined(scheme: Column, authority: Column, path: Column, query: Column, fragment: Column) -> Column:
    rooted = F.when((authority != "") & (path != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path)
    part = lambda mark, c: F.when(c != "", F.concat(F.lit(mark), c)).otherwise("")
    return F.concat(scheme, F.lit(":"), F.when(authority != "", F.concat(F.lit("//"), authority)).otherwise(""), rooted, part("?", query), part("#", fragment))


def resolved(base: Column, reference: Column) -> Column:
    """A reference seen from a page's address (RFC 3986, dot segments resolved, the scheme in lower case); one with another
    scheme than the page's stays as it is. Null where either is. Parameters after ; are part of their path segment."""
    bare = F.regexp_replace(F.regexp_replace(reference, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    r = [F.regexp_extract(bare, _PARTS, i) for i in range(1, 6)]
    b = [F.regexp_extract(base, _PARTS, i) for i in range(1, 6)]
    scheme = F.lower(b[0])
    same = (r[0] == "") | (F.lower(r[0]) == scheme)

    above = F.split(b[2], "/")
    above = F.when(F.element_at(above, -1) != "", F.slice(above, F.lit(1), F.size(above) - 1)).otherwise(above)
    own = F.split(r[2], "/")
    both = F.concat(above, own)
    middle = F.filter(F.slice(both, F.lit(2), F.greatest(F.size(both) - 2, F.lit(0))), lambda s: s != "")
    merged = F.when(F.size(both) > 1, F.concat(F.slice(both, 1, 1), middle, F.slice(both, -1, 1))).otherwise(both)
    steps = F.when(r[2].startswith("/"), own).otherwise(merged)
    up = lambda done: F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
    walked = F.aggregate(steps, F.array().cast("array<string>"), lambda done, s: F.when(s == "..", up(done)).when(s == ".", done).otherwise(F.array_append(done, s)))
    path = F.array_join(walked, "/")
    path = F.when(F.element_at(steps, -1).isin(".", ".."), F.concat(path, F.when(F.size(walked) > 0, "/").otherwise(""))).otherwise(path)
    path = F.when(path == "", "/").otherwise(path)
    return (
        F.when(bare == "", base)
        .when(~same, bare)
        .when(r[1] != "", _joined(scheme, r[1], r[2], r[3], r[4]))
        .when(r[2] == "", _joined(scheme, b[1], b[2], F.when(r[3] != "", r[3]).otherwise(b[3]), r[4]))
        .otherwise(_joined(scheme, b[1], path, r[3], r[4]))
    )


def visible(html: Column) -> Column:
    """A page without comments and the contents of scripts and styles; their tags stay."""
    return F.regexp_replace(html, _HIDDEN, "<$1$2></$1>")


def tags(html: Column) -> Column:
    """All opening tags of a page."""
    return F.regexp_extract_all(visible(html), F.lit(rf"(?is)<[a-z][^\s/>]*{_INSIDE}>"), 0)


def anchors(html: Column) -> Column:
    """Each anchor of a page: its opening tag and what follows up to its end, the next anchor or the page's end."""
    return F.regexp_extract_all(visible(html), F.lit(rf"(?is)<a(?=[\s/>]){_INSIDE}>.*?(?=</a\s*>|<a[\s/>]|\z)"), 0)


def opening(element: Column) -> Column:
    """The opening tag with which an element begins."""
    return F.regexp_extract(element, rf"(?is)^<[a-z][^\s/>]*{_INSIDE}>", 0)


def attributes(tag: Column) -> Column:
    """(name, value) of an opening tag's attributes that have a value, names in lower case, values unquoted but still escaped."""
    inside = F.regexp_replace(tag, r"(?is)^<[a-z][^\s/>]*|/?>$", "")
    pairs = F.arrays_zip(F.regexp_extract_all(inside, F.lit(_ATTRIBUTE), 1).alias("n"), F.regexp_extract_all(inside, F.lit(_ATTRIBUTE), 2).alias("v"))
    bare = lambda v: F.when(F.left(v, F.lit(1)).isin('"', "'"), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)
    return F.transform(F.filter(pairs, lambda p: p["v"] != ""), lambda p: F.struct(F.lower(p["n"]).alias("name"), bare(p["v"]).alias("value")))


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, the last one if it is repeated; null without."""
    own = F.filter(attributes(tag), lambda a: a["name"] == name)
    return let(own, lambda found: F.when(F.size(found) > 0, F.element_at(found, -1)["value"]))


def texts(element: Column) -> Column:
    """The texts between an element's tags, still escaped."""
    return F.split(F.regexp_replace(element, rf"(?is)^<[a-z][^\s/>]*{_INSIDE}>", ""), rf"(?s)</?[A-Za-z]{_INSIDE}>")


def run_together(nodes: Column) -> Column:
    """Texts without the white space at their ends, as one."""
    return F.array_join(F.transform(nodes, lambda x: F.regexp_replace(x, _EDGE, "")), "")
