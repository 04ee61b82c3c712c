"""Page elements -> dated menu rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tavola.functions import text as X
from tavola.functions import values as V
from tavola.functions.rules import first_contained
from tavola.functions.text import any_of

OPTION = r"(?U)^([A-Z]):\s*(.+)"
SEPARATOR = r"(?iuU)\s*[AB]:\s*"


def restaurant_of(src: Column) -> Column:
    """Restaurant of a logo's address; the name for unknown ones if none fits."""
    return first_contained(F.lower(F.coalesce(src, F.lit(""))), V.RESTAURANTS, V.UNKNOWN_RESTAURANT)


def sections(elements: DataFrame, strict_logos: bool = False) -> DataFrame:
    """``path, date, pos, section, restaurant, text``: the paragraphs of each restaurant's section.

    Every image begins a section.  A known logo changes the restaurant, another
    image does not (``strict_logos``: it ends the restaurant's part).
    Paragraphs before the first known logo, empty and administrative ones go.
    """
    page = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    img = F.col("tag") == "img"
    src = F.lower(F.coalesce("src", F.lit("")))
    known = F.when(img & any_of(src, V.LOGOS), restaurant_of(F.col("src")))
    mark = F.when(img & F.lit(strict_logos), F.coalesce(known, F.lit(""))).otherwise(known)
    rows = elements.withColumn("restaurant", F.last(mark, ignorenulls=True).over(page)).withColumn("section", F.sum(img.cast("int")).over(page))
    text = X.strip(F.coalesce("text", F.lit("")))
    rows = rows.where((F.col("tag") == "p") & (F.coalesce("restaurant", F.lit("")) != "")).withColumn("text", text)
    return rows.where((F.col("text") != "") & ~any_of(F.lower("text"), V.PARAGRAPH_SKIP)).select("path", "date", "pos", "section", "restaurant", "text")


def section_prices(paragraphs: DataFrame) -> DataFrame:
    """``path, section, prices``: the last price in range of each kind; a line of the regular kind is not asked for the other."""
    low, price = F.lower("text"), X.price_of(F.col("text"))
    ft = low.contains("ft")
    regular = low.contains("menü") & ft
    extra = ~regular & low.contains("extra") & ft
    rows = paragraphs.select("path", "section", "pos", F.when(regular & price.between(*V.REGULAR_PRICE), price).alias("r"), F.when(extra & price.between(*V.EXTRA_PRICE), price).alias("e"))
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("pos")))
    both = rows.groupBy("path", "section").agg(last("r").alias("r"), last("e").alias("e"))
    return both.select("path", "section", F.map_filter(F.create_map(F.lit("regular"), "r", F.lit("extra"), "e"), lambda _, v: v.isNotNull()).alias("prices"))


def split_options(col: Column) -> Column:
    """Parts of more than two characters between ``A:`` and ``B:``, wherever these stand."""
    return F.filter(F.transform(F.split(col, SEPARATOR, -1), X.strip), lambda p: F.length(p) > 2)


def menu_lines(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """``rows`` without ``text_col``, with ``dish_name, item_number, menu_type``, one row per dish of each line.

    An option line gives its dish; a line with separators one dish per part;
    a line with a soup word itself; any other itself unless it has a word that
    no dish has.  The first that fits counts.
    """
    raw = F.col(text_col)
    keep = [c for c in rows.columns if c != text_col]
    ok = (F.length(raw) >= 3) & ~raw.rlike(r"(?U)^[\d\s]*(?:Ft|ft)[\s\W]*$")
    d = rows.where(ok).select(*keep, X.scrub(raw).alias("_c")).where(F.length("_c") >= 3)
    c = F.col("_c")
    low = F.lower(c)
    item = lambda name, n, kind: F.struct(name.alias("dish_name"), n.cast("int").alias("item_number"), kind.alias("menu_type"))
    dish = X.strip(F.regexp_extract(c, OPTION, 2))
    none = F.array().cast("array<struct<dish_name:string,item_number:int,menu_type:string>>")
    main = F.lit("main")
    found = (
        F.when(c.rlike("^[A-Z]:"), F.when(dish != "", F.array(item(dish, F.lit(1), F.concat(F.lit("option_"), F.regexp_extract(c, OPTION, 1))))).otherwise(none))
        .when(c.rlike(SEPARATOR), F.transform(split_options(c), lambda p, i: item(p, i + 1, main)))
        .when(any_of(low, V.SOUP_WORDS) | ~any_of(low, V.DEFAULT_SKIP), F.array(item(c, F.lit(1), main)))
        .otherwise(none)
    )
    return d.select(*keep, F.explode(found).alias("_x")).select(*keep, "_x.*")


def daily_menus(elements: DataFrame, strict_logos: bool = False) -> DataFrame:
    """``date, restaurant, dish_name, item_number, menu_type, prices`` from page elements."""
    paragraphs = sections(elements, strict_logos)
    prices = section_prices(paragraphs)
    rows = menu_lines(paragraphs.join(prices, ["path", "section"], "left"))
    return rows.select("date", "restaurant", "dish_name", "item_number", "menu_type", "prices")
