"""HTML as column expressions, so that a page's parts are made where its rows are."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that HTML writes as entities.
_ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))


def escaped(text: Column) -> Column:
    """Text for HTML; null gives ''."""
    out = F.coalesce(text, F.lit(""))
    for char, entity in _ENTITIES:
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def element(name: str, *inner: Column | str, **attributes: Column | str) -> Column:
    """An element with its inner HTML, which is taken as it is, and its attributes, of which columns are escaped. `_` in a name stands for `-`, a last one for none."""
    parts = [F.lit(f"<{name}")]
    for key, value in attributes.items():
        parts += [F.lit(f' {key.rstrip("_").replace("_", "-")}="'), F.lit(value) if isinstance(value, str) else escaped(value), F.lit('"')]
    parts += [F.lit(">"), *(F.lit(x) if isinstance(x, str) else x for x in inner), F.lit(f"</{name}>")]
    return F.concat(*parts)


def counted(n: Column, one: str, many: str | None = None) -> Column:
    """A number with its noun."""
    return F.concat(n.cast("string"), F.when(n == 1, f" {one}").otherwise(f" {many or one + 's'}"))
