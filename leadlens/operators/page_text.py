"""A page as short structured text: what tells of people, each kind under its own heading and within its budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlens.operators.page_tree import element, part

#: Characters of a piece of linked data, of the whole page in place of sections, of all; sections' characters from which the page isn't needed.
DATA_MOST, PAGE_MOST, MOST, ENOUGH = 3000, 4000, 12_000, 200
NOISE = ("svg", "noscript", "iframe", "video", "audio", "nav", "footer", "style", "script")
ROOMS = ("main", "article", "section")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
NO_PORTRAIT = ("logo", "icon", "banner", "background", "decoration", "spacer", "arrow", "button")
#: A section counts from so many characters; equal beginnings of this length are one section; divisions so far below a room are left to it.
LEAST, SAME, DEPTH = 20, 100, 3


def structured(tree: DataFrame, most: int = MOST, page_most: int = PAGE_MOST, data_most: int = DATA_MOST) -> DataFrame:
    """(page_id, text) of trees: linked data of people, image texts, mail links, sections with headings (or the page if they say little).

    Navigation, footers and the like are left out. Linked data is read before its
    scripts go. Sections within sections repeat their text; equal beginnings are
    one. Everything is cut to its budget, the whole to ``most`` characters.
    """
    t = tree.withColumn("gone", F.filter("elements", lambda e: e["tag"].isin(*NOISE)))
    inside = lambda e: F.exists("gone", lambda g: (e["at"] >= g["at"]) & (e["at"] <= g["last"]))
    seen = F.transform("strings", lambda s, i: F.when(~F.exists("gone", lambda g: (i >= g["low"]) & (i < g["high"])), s))
    t = t.select("page_id", "data", "elements", seen.alias("seen"), F.filter("elements", lambda e: ~inside(e)).alias("left"))
    elements, left = F.col("elements"), F.col("left")
    lines = lambda e: F.array_compact(part(F.col("seen"), e["low"], e["high"], most))

    def under(title: str, found: Column) -> Column:
        return F.when(F.size(found) > 0, F.concat(F.lit(f"[{title}]\n"), F.array_join(found, "\n")))

    people = F.filter("data", lambda d: F.lower(d).contains('"person"') | F.lower(d).contains('"employee"'))
    linked = F.transform(people, lambda d: F.concat(F.lit("[JSON-LD] "), F.substring(d, 1, data_most)))
    alts = F.filter(F.transform(F.filter(left, lambda e: e["tag"] == "img"), lambda e: F.trim(e["alt"])), lambda a: F.length(a).between(4, 119) & ~F.lower(a).rlike("|".join(NO_PORTRAIT)))
    mails = F.transform(
        F.filter(left, lambda e: (e["tag"] == "a") & F.lower(e["href"]).startswith("mailto:") & F.split_part(e["href"], F.lit("?"), F.lit(1)).contains("@")),
        lambda e: _mail(F.trim(F.split_part(F.substring(e["href"], 8, 1000), F.lit("?"), F.lit(1))), F.array_join(lines(e), "")),
    )

    def apart(e: Column) -> Column:
        """A room, or a division near one (or near the top)."""
        up = element(elements, e["parent"])
        up2 = F.when(up.isNotNull(), element(elements, up["parent"]))
        up3 = F.when(up2.isNotNull(), element(elements, up2["parent"]))
        near = up["tag"].isin(*ROOMS) | up2["tag"].isin(*ROOMS) | up3["tag"].isin(*ROOMS)
        return e["tag"].isin(*ROOMS) | ((e["tag"] == "div") & (F.coalesce(near, F.lit(False)) | up2.isNull()))

    def section(e: Column) -> Column:
        heads = F.filter(left, lambda h: h["tag"].isin(*HEADINGS) & (h["at"] > e["at"]) & (h["at"] <= e["last"]))
        titles = F.filter(F.transform(heads, lambda h: F.array_join(lines(h), "")), lambda x: x != "")
        text = F.array_join(F.concat(F.transform(titles, lambda x: F.concat(F.lit("## "), x)), lines(e)), "\n")
        return F.when((F.size(heads) > 0) & (F.length(text) > LEAST), text)

    told = F.array_compact(F.transform(F.filter(left, apart), section))
    t = t.select("page_id", linked.alias("linked"), under("Image alt text", alts).alias("alts"), under("Email links", mails).alias("mails"), told.alias("told"), F.array_join(F.array_compact("seen"), "\n").alias("page"))
    first = F.filter("told", lambda s, i: ~F.exists(F.slice("told", 1, i), lambda x: F.substring(x, 1, SAME) == F.substring(s, 1, SAME)))
    t = t.withColumn("told", first)
    size = F.aggregate("told", F.lit(0), lambda n, s: n + F.length(s))
    whole = F.when((size < ENOUGH) & (F.col("page") != ""), F.concat(F.lit("[Full page text]\n"), F.substring("page", 1, page_most)))
    parts = F.concat("linked", F.array_compact(F.array("alts", "mails")), F.transform("told", lambda s: F.concat(F.lit("[Section]\n"), s)), F.array_compact(F.array(whole)))
    return t.select("page_id", F.substring(F.array_join(parts, "\n\n"), 1, most).alias("text"))


def _mail(address: Column, said: Column) -> Column:
    return F.when((said == "") | (F.lower(said) == F.lower(address)), address).otherwise(F.concat(said, F.lit(" <"), address, F.lit(">")))
