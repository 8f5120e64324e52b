"""Elements, media, accessibility and robots rules of a page as functions for SQL, to be used with ``LATERAL``."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import dom


def _rows(what: str):
    """A table function of one text that gives the rows of ``dom.extract``; null is an empty page."""
    make, schema = dom._SCHEMAS[what]
    names = [field.split()[0] for field in schema.split(", ")]

    class Rows:
        def eval(self, text: str):
            for row in make(text or ""):
                yield tuple(int(row[n]) if isinstance(row[n], bool) else row[n] for n in names)

    return F.udtf(Rows, returnType=schema)


class RobotsRules:
    """``rule, allow`` of a robots.txt for an agent, in the order in which they stand."""

    def eval(self, text: str, agent: str):
        from ..operators.robots import parse

        got = parse(text or "", agent or "")
        yield from ((rule, allow) for kind, allow in (("allow", True), ("disallow", False)) for rule in got[kind])


#: Name in SQL of each table function.
FUNCTIONS = {
    "page_elements": lambda: _rows("structure"),
    "page_media": lambda: _rows("media"),
    "page_accessibility": lambda: _rows("accessibility"),
    "page_links": lambda: _rows("links"),
    "page_census": lambda: _rows("census"),
    "robots_rules": lambda: F.udtf(RobotsRules, returnType="rule string, allow boolean"),
}


def register(spark: SparkSession) -> None:
    """Make all of FUNCTIONS known to ``spark.sql``."""
    for name, made in FUNCTIONS.items():
        spark.udtf.register(name, made())
