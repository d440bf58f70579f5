"""Linked data in web pages: its nodes at any depth, and the rents that pages name."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickwork.sources.workspace import written

#: The patterns of blocks and prices, and what rents a week and a month can be.
BLOCK = r"(?is)<script[^>]+application/ld\+json[^>]*>(.*?)</script>"
WEEKLY = r"(?i)£\s*([\d,]+(?:\.\d{1,2})?)\s*(?:per\s+week|pw\b|p/w|pppw|/\s*week|a\s+week|weekly)"
MONTHLY = r"(?i)£\s*([\d,]+(?:\.\d{1,2})?)\s*(?:per\s+month|pcm\b|p/m|pppm|/\s*month|a\s+month|monthly)"
WEEKLY_KEY = r'(?i)"(?:price_?per_?week|weekly_?(?:price|rent)|rent_?ppw|price_?pw|pricePerWeek)"\s*:\s*"?(\d{2,3}(?:\.\d{1,2})?)"?'
WEEKLY_BOUNDS, MONTHLY_BOUNDS = (60, 550), (300, 4000)
PRICE_KEYS = ("price", "lowPrice", "minPrice")
ADDRESS_KEYS = ("streetAddress", "addressLocality", "addressRegion", "postalCode")


def blocks(html: Column) -> Column:
    """The texts of the linked-data blocks of a page."""
    return F.transform(F.regexp_extract_all(html, F.lit(BLOCK), 1), F.trim)


def json_nodes(df: DataFrame, text: str, max_depth: int = 1000) -> DataFrame:
    """The other columns, path and node: every object of each JSON text, at whatever depth; none for a text that is no JSON.

    A level of all texts is taken apart at a time by a table function over
    variants, and only objects and arrays go on, so there are as many rounds as
    the deepest text has levels. A path tells the way from the outermost value.
    """
    keep = [c for c in df.columns if c != text]
    level = df.select(*keep, F.lit("$").alias("path"), F.try_parse_json(text).alias("node")).where("node IS NOT NULL")
    out = None
    for _ in range(max_depth):
        kind = F.schema_of_variant("node")
        level = written(level.where(F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY"))), "json-level")
        if level.isEmpty():
            break
        found = level.where(F.startswith(F.schema_of_variant("node"), F.lit("OBJECT")))
        out = found if out is None else out.unionAll(found)
        step = "concat(path, coalesce(concat('.', e.key), concat('[', e.pos, ']'))) AS path"
        level = df.sparkSession.sql(f"SELECT {''.join(f'l.`{c}`, ' for c in keep)}{step}, e.value AS node FROM {{level}} l, LATERAL variant_explode(l.node) e", level=level)
    else:
        raise RuntimeError(f"JSON of more than {max_depth} levels")
    return level.select(*keep, "path", "node") if out is None else out


def node_text(node: str | Column, key: str) -> Column:
    """A node's value of a key as text; null for one that Python counts as nothing."""
    value = F.try_variant_get(node, f"$.{key}", "string")
    return F.when(~value.isin("", "0", "0.0", "false"), value)


def address(node: str | Column) -> Column:
    """The postal address of a node: as it is if it is text, else its parts joined."""
    parts = F.concat_ws(", ", *[node_text(node, f"address.{k}") for k in ADDRESS_KEYS])
    inner = F.try_variant_get(node, "$.address", "variant")
    return F.when(F.startswith(F.schema_of_variant(inner), F.lit("OBJECT")), parts).otherwise(node_text(node, "address"))


def number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def page_rents(df: DataFrame, html: str) -> DataFrame:
    """The other columns, rent_type, ppw, pcm: the lowest and, if it differs, highest plausible rent of each page ("From", "To").

    Prices come from nodes of linked data (by the week if the node speaks of
    weeks), from keys of embedded JSON and from the text. A page with weekly
    rents is told by these alone, one without by its monthly ones; one without
    either is left out. Each row of ``df`` is a page of its own.
    """
    keep = [c for c in df.columns if c != html]
    pages = written(df.withColumn("__page", F.monotonically_increasing_id()), "pages")
    nodes = json_nodes(pages.select("__page", F.explode(blocks(F.col(html))).alias("json")), "json")
    price = number(F.coalesce(*[node_text("node", k) for k in PRICE_KEYS]))
    week = F.contains(F.lower(F.to_json("node")), F.lit("week")) | F.contains(F.lower(F.coalesce(node_text("node", "unitText"), F.lit(""))), F.lit("wee"))
    found = nodes.select("__page", week.alias("weekly"), price.alias("price"))
    for pattern, weekly in ((WEEKLY_KEY, True), (WEEKLY, True), (MONTHLY, False)):
        texts = pages.select("__page", F.lit(weekly).alias("weekly"), F.explode(F.regexp_extract_all(html, F.lit(pattern), 1)).alias("t"))
        found = found.unionAll(texts.select("__page", "weekly", number(F.col("t"))))
    within = lambda weekly, bounds: F.when(F.col("weekly") == F.lit(weekly), F.when(F.col("price").between(*bounds), F.col("price")))
    ranges = [agg(within(weekly, bounds)).alias(f"{name}_{end}") for name, weekly, bounds in (("w", True, WEEKLY_BOUNDS), ("m", False, MONTHLY_BOUNDS)) for end, agg in (("low", F.min), ("high", F.max))]
    ends = found.groupBy("__page").agg(*ranges).where("w_low IS NOT NULL OR m_low IS NOT NULL")
    by_week = F.col("w_low").isNotNull()
    low, high = (F.when(by_week, F.col(f"w_{end}")).otherwise(F.col(f"m_{end}")) for end in ("low", "high"))
    row = lambda kind, p: F.struct(F.lit(kind).alias("rent_type"), F.when(by_week, p).otherwise(F.bround(p * 12 / 52, 2)).alias("ppw"), F.when(by_week, F.bround(p * 52 / 12, 2)).otherwise(p).alias("pcm"))
    rents = ends.select("__page", F.explode(F.filter(F.array(row("From", low), F.when(high > low, row("To", high))), lambda r: r.isNotNull())).alias("r")).select("__page", "r.*")
    return pages.join(rents, "__page").select(*keep, "rent_type", "ppw", "pcm")


def _prices(node) -> Iterator[tuple[bool, float]]:
    """(by the week, price) of a parsed value and all that it holds."""
    if isinstance(node, dict):
        price = next((node[k] for k in PRICE_KEYS if node.get(k)), None)
        if price is not None:
            try:
                yield "week" in json.dumps(node).lower() or "wee" in str(node.get("unitText", "")).lower(), float(str(price).replace(",", ""))
            except ValueError:
                pass
    for inner in node.values() if isinstance(node, dict) else node if isinstance(node, list) else ():
        yield from _prices(inner)


def rents_of_page(html: str | None) -> list[tuple[str, float, float]]:
    """(rent_type, ppw, pcm) of one page, in plain Python; for the table function, and to test the other way against."""
    found = [(True, p) for p in re.findall(WEEKLY_KEY, html or "") + re.findall(WEEKLY, html or "")] + [(False, p) for p in re.findall(MONTHLY, html or "")]
    prices = [(w, float(p.replace(",", ""))) for w, p in found if p.replace(",", "")]
    for block in re.findall(BLOCK, html or ""):
        try:
            prices += _prices(json.loads(block.strip()))
        except ValueError:
            continue
    weekly, monthly = (sorted({p for w, p in prices if w == by and low <= p <= high}) for by, (low, high) in ((True, WEEKLY_BOUNDS), (False, MONTHLY_BOUNDS)))
    if weekly:
        return [(kind, p, round(p * 52 / 12, 2)) for kind, p in (("From", weekly[0]), ("To", weekly[-1]))[: 1 + (len(weekly) > 1)]]
    return [(kind, round(p * 12 / 52, 2), p) for kind, p in (("From", monthly[0]), ("To", monthly[-1]))[: 1 + (len(monthly) > 1)]] if monthly else []


class PageRents:
    """A table function: the rents of a page given as html."""

    def eval(self, html: str | None):
        yield from rents_of_page(html)


def page_rents_table():
    """``PageRents`` for a lateral join: ``df.lateralJoin(page_rents_table()(F.col("html").outer()))``."""
    return F.udtf(PageRents, returnType="rent_type string, ppw double, pcm double")
