"""Text of an element of a page, found by its id inside the page's row.

Comments, scripts and styles are taken out, the start tag with the id is located, and the
rest is cut into tags and texts.  A fold over these pieces counts how deep elements of the
same name are nested until the matching end tag; the texts before it are joined and their
entities decoded.  An element without end tag reaches to the end of the page, a void
element is empty, a page without the id (or a null page) gives null.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SILENT = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
# fixed values: names of the entities that are decoded; `&amp;` comes last, so that it makes no new ones
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&amp;": "&"}


def decoded(text: Column) -> Column:
    """Numeric entities up to U+10FFFF, then the named ones of ``ENTITIES``."""
    parts = F.split(text, "&#")

    def number(part: Column) -> Column:
        code = F.regexp_extract(part, r"^(?:[xX]([0-9a-fA-F]{1,6})|([0-9]{1,7}));", 0)
        value = F.when(code.rlike("^[xX]"), F.conv(F.regexp_replace(code, "[xX;]", ""), 16, 10)).otherwise(F.regexp_replace(code, ";", "")).cast("int")
        char = F.decode(F.unhex(F.lpad(F.hex(value), 8, "0")), "UTF-32")
        fits = (code != "") & value.between(1, 0x10FFFF) & ~value.between(0xD800, 0xDFFF)
        return F.when(fits, F.concat(char, F.substring(part, F.length(code) + 1, F.length(part)))).otherwise(F.concat(F.lit("&#"), part))

    out = F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), number), ""))
    for name, char in ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def with_element_text(pages: DataFrame, html: str, element_id: str, out: str) -> DataFrame:
    """``pages`` with the decoded text of the element with ``element_id`` as column ``out``."""
    key = re.escape(element_id)
    start = rf"(?is)<([a-z][a-z0-9]*)(?=[^>]*?\sid\s*=\s*(?:\"{key}\"|'{key}'|{key}(?=[\s/>])))[^>]*>"
    columns = pages.columns
    found = pages.withColumn("_clean", F.regexp_replace(html, SILENT, ""))
    found = found.withColumn("_open", F.regexp_extract("_clean", start, 0)).withColumn("_tag", F.lower(F.regexp_extract("_clean", start, 1)))
    rest = F.substring(F.col("_clean"), F.position(F.col("_open"), F.col("_clean")) + F.length("_open"), F.length("_clean"))
    pieces = F.regexp_extract_all(rest, F.lit("(?s)<[^>]*>|[^<]+"), F.lit(0))
    found = found.select(*columns, "_open", "_tag", pieces.alias("_pieces"))
    # the names alone, so that the fold compares short texts: `p` opens, `/p` closes, others are empty
    name = lambda x: F.when(x.startswith("<") & ~x.endswith("/>"), F.lower(F.regexp_extract(x, r"^<(/?[a-zA-Z][a-zA-Z0-9]*)", 1))).otherwise("")
    found = found.withColumn("_names", F.transform("_pieces", name))
    state = lambda depth, at: F.struct(depth.cast("int").alias("depth"), at.cast("int").alias("at"))
    step = lambda s, x: F.when(s["depth"] == 0, s).otherwise(state(
        s["depth"] + F.when(x == F.col("_tag"), 1).when(x == F.concat(F.lit("/"), F.col("_tag")), -1).otherwise(0), s["at"] + 1))
    found = found.withColumn("_end", F.aggregate("_names", state(F.lit(1), F.lit(0)), step))
    inner = F.slice("_pieces", F.lit(1), F.col("_end.at"))
    body = F.array_join(F.filter(inner, lambda x: ~x.startswith("<")), "")
    text = F.when(F.col("_open").isNull() | (F.col("_open") == ""), None).when(F.col("_tag").isin(VOID) | F.col("_open").endswith("/>"), "").otherwise(decoded(body))
    return found.select(*columns, text.alias(out))
