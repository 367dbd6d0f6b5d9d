"""JSON helpers (JSN1, JSN2) on Spark's VARIANT type, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse(c) -> Column:
    """The text as VARIANT; NULL unless the whole text is one JSON value.

    One parse decides both: the parser ignores what follows a value, so the text is parsed as the
    first of two elements of an array whose second is the text's own hash. Only if the text is one
    value are there two elements, the hash the second. ``NaN`` and ``Infinity`` are not JSON."""
    def elements(x, h):
        both = F.try_parse_json(F.concat(F.lit("["), x, F.lit(',"'), h, F.lit('"]')))
        return let(F.variant_get(both, "$", "array<variant>"), lambda a: F.when(
            (F.size(a) == 2) & (F.try_variant_get(a[1], "$", "string") == h), a[0]))
    return let(_c(c), lambda x: let(F.md5(x), lambda h: elements(x, h)))


def is_valid_json(c) -> Column:
    """True iff the whole text is one JSON value; NULL text is not valid."""
    return parse(c).isNotNull()


def inject_field(c, key: str, value) -> Column:
    """``obj[key] = value`` then serialise compactly; NULL unless the text is a JSON object.

    Values keep their JSON types (a map of VARIANT), and the injected key wins over an
    existing one (``spark.sql.mapKeyDedupPolicy=LAST_WIN``, set by the session helper)."""
    m = F.when(is_valid_json(c), F.from_json(_c(c), "map<string, variant>"))  # keeps the order of the keys
    return F.to_json(F.map_concat(m, F.create_map(F.lit(key), _c(value).cast("variant"))))
