"""Pieces of DuckDB SQL that say what functions/urls.py says, made from the same tables."""

from __future__ import annotations

from ..functions import tables as T
from ..functions.urls import PARTS


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def part(url: str, n: int) -> str:
    return f"regexp_extract({url}, '{PARTS}', {n})"


def host(url: str) -> str:
    return f"regexp_replace(lower(regexp_replace({part(url, 2)}, '^.*@', '')), ':[0-9]*$', '')"


def starts(x: str, prefixes) -> str:
    return "(" + " OR ".join(f"starts_with({x}, '{p}')" for p in prefixes) + ")"


def holds(x: str, parts) -> str:
    return "(" + " OR ".join(f"contains({x}, '{p}')" for p in parts) + ")"


def normal_path(p: str) -> str:
    """Paths without ``..`` segments."""
    return f"('/' || array_to_string(list_filter(string_split(url_decode({p}), '/'), lambda s: s NOT IN ('', '.')), '/'))"


def tracking(k: str) -> str:
    return f"(lower({k}) IN ({quoted(T.TRACKING_KEYS)}) OR {starts(f'lower({k})', T.TRACKING_PREFIXES)})"


def sorted_query(q: str) -> str:
    """Queries of plain characters with one value for each key."""
    return f"array_to_string(list_sort(list_filter(string_split({q}, '&'), lambda p: p <> '' AND NOT {tracking("string_split(p, '=')[1]")})), '&')"


def normal_url(url: str) -> str:
    q = sorted_query(part(url, 4))
    return (
        f"CASE WHEN lower({part(url, 1)}) IN ('http', 'https') THEN lower({part(url, 1)}) || '://' || {host(url)} || {normal_path(part(url, 3))} "
        f"|| CASE WHEN {part(url, 4)} <> '' AND {q} <> '' THEN '?' || {q} ELSE '' END ELSE {url} END"
    )


def is_page(url: str) -> str:
    last = f"regexp_extract(regexp_replace({part(url, 3)}, '/$', ''), '([^/]*)$', 1)"
    return f"(NOT contains({last}, '.') OR lower(regexp_extract({last}, '\\.([^.]*)$', 1)) IN ({quoted(T.PAGE_SUFFIXES)}))"


def drop_query(q: str) -> str:
    k = "lower(string_split(p, '=')[1])"
    return f"array_to_string(list_filter(string_split({q}, '&'), lambda p: NOT ({k} IN ({quoted(T.DROP_KEYS)}) OR starts_with({k}, 'utm_'))), '&')"


def canonical(url: str) -> str:
    """Keys of urls; segments that mark pages are found by expression."""
    marker = "/(page|paged|comment-page)([-_][^/]*)?(/[0-9]+)?(/|$)"
    p = f"regexp_replace(regexp_replace(regexp_replace({part(url, 3)}, '(?i){marker}', '/', 'g'), '^/+', ''), '/+$', '')"
    q = drop_query(part(url, 4))
    return f"({part(url, 1)} || '://' || {part(url, 2)} || '/' || {p} || CASE WHEN {q} <> '' THEN '?' || {q} ELSE '' END || CASE WHEN {part(url, 5)} <> '' THEN '#' || {part(url, 5)} ELSE '' END)"


def weight(url: str) -> str:
    return f"(CASE WHEN {part(url, 4)} <> '' THEN 10 ELSE 0 END + CASE WHEN contains({part(url, 3)}, '/page/') OR contains({part(url, 3)}, '/comment-page') THEN 5 ELSE 0 END)"


def local_path(url: str) -> str:
    p = part(url, 3)
    raw = f"(CASE WHEN {p} IN ('', '/') THEN '/index.html' ELSE {p} END)"
    named = f"regexp_replace(CASE WHEN ends_with({raw}, '/') THEN {raw} || 'index.html' ELSE {raw} END, '^/', '')"
    full = f"(CASE WHEN contains(regexp_extract({named}, '([^/]*)$', 1), '.') THEN {named} ELSE {named} || '/index.html' END)"
    q = part(url, 4)
    asked = f"CASE WHEN {q} = '' THEN {full} ELSE regexp_replace({full}, '\\.[^./]*$', '') || '_' || translate({q}, '/\\:?&', '_____') || regexp_extract({full}, '(\\.[^./]*)$', 1) END"
    return f"({host(url)} || '/' || {asked})"
