"""People and addresses of pages: cards by six strategies within sections or the page, addresses with the nearest name.

Everything but parsing is column expressions on the page's tree (``page_tree``);
only what was found is shuffled, to decide between findings of one name or address.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadlens.functions import emails, gates, url_rules, urls
from leadlens.functions.once import once
from leadlens.operators.ingest import without_credentials
from leadlens.operators.page_tree import HEADINGS, element, part, trees

# ---- Fixed values: words that results depend on.
#: Parts of job titles: no name has one.
JOBS = (
    "ceo", "cfo", "cto", "coo", "cmo", "cpo", "cro", "ciso", "chief", "president", "founder", "vice president", "vp ", " vp", "svp", "evp", "avp", "director", "head of", "lead", "principal", "partner",
    "general manager", "gm ", "executive", "officer", "chairman", "chairwoman", "chair ", "manager", "senior", "staff", "engineer", "developer", "analyst", "consultant", "specialist", "coordinator", "associate", "advisor", "counsel", "attorney",
)
#: Words of trades that no name has.
TRADES = ("accountant", "accounting", "bookkeeper", "bookkeeping", "administrator", "administrative", "assistant", "technician", "supervisor", "representative", "certified", "public", "licensed", "registered", "intern", "trainee", "apprentice", "receptionist", "secretary", "clerk", "controller", "treasurer")
#: Classes of cards, most telling first; classes of a card's title.
CARD_CLASSES = ("person|team|member|leader|executive|founder", "bio|profile|staff|employee", "card|tile|item")
TITLE_CLASSES = "title|role|position|job|designation"
#: A heading of at most 80 characters with one of these opens a section of people; so do ids and classes with the words.
SECTION_HEADINGS = ("meet the people", "meet people", "leadership", "executive", "management", "team", "people behind", "founder", "board of directors", "advisory board", "c-suite", "leader", "key people", "who we are", "people of", "about us", "the company")
SECTION_WORDS = ("team", "leadership", "executives", "founders", "board", "people", "staff")
#: Images of no person; what their texts are split at.
NO_PORTRAIT = ("logo", "icon", "banner", "photo", "image", "headshot", "background")
ALT_BREAKS = (",", " - ", " — ", " | ")
#: Texts of a page (its first 60,000 characters) about a company's own people.
PEOPLE_SIGNALS = ("leadership team", "executive team", "executive leadership", "management team", "board of directors", "our team", "meet the team", "our leadership", "founders", "executives", "directors", '"@type":"person"', '"@type": "person"', "chief executive officer", "chief operating officer", "chief technology officer", "chief financial officer", "co-founder", "cofounder", "vice president", "managing director", "general partner", "team-member", "team_member", "leadership-card", "bio-card", "person-card", "staff-card", "profile-card")
#: Fewer cards than these send the search on to the next scope; a snippet's length; the score of a page of people.
ENOUGH, SNIPPET, LEAST_SCORE = 3, 280, 4
# ---- end of fixed values

CARD_TAGS = ("div", "li", "article", "section")
CARD = "struct<name:string,title:string,kind:string>"


def like_name(text: Column) -> Column:
    """Two to five capitalised words of letters, without titles, that the gate for names lets through; credentials don't count."""

    def told(clean: Column) -> Column:
        shaped = F.length(clean).between(3, 80) & clean.rlike(r"^\S+(\s+\S+){1,4}$") & F.regexp_replace(clean, "[-'.]", "").rlike(r"^\p{Lu}\p{L}*(\s+(\p{Lu}\p{L}*)?)*$")
        job = once(F.lower(clean), lambda low: low.rlike("|".join(JOBS)) | low.rlike(rf"\b({'|'.join(TRADES)})\b"))
        return F.when(shaped, F.when(~job, gates.person_name_reason(clean).isNull()).otherwise(False)).otherwise(False)

    return once(without_credentials(F.trim(text)), told)


def like_title(text: Column) -> Column:
    """A job title: the gate for titles lets it through, and it is short or has a title's words."""

    def told(clean: Column) -> Column:
        plausible = (clean != "") & (F.length(clean) <= 100) & ((F.length(clean) <= 40) | F.lower(clean).rlike("|".join(JOBS)))
        return F.when(plausible, gates.title_reason(clean).isNull()).otherwise(False)

    return once(F.trim(text), told)


def _said(strings: Column) -> Column:
    return F.transform(strings, lambda s: F.struct(s.alias("s"), like_name(s).alias("n"), like_title(s).alias("t")))


def _of(said: Column, e: Column) -> Column:
    """The strings within an element; none of a null one."""
    return F.when(e.isNotNull(), part(said, e["low"], e["high"])).otherwise(part(said, F.lit(0), F.lit(0)))


def _joined(said: Column) -> Column:
    return F.array_join(F.transform(said, lambda x: x["s"]), "")


def _first_name(said: Column, most: int = 40) -> Column:
    return F.try_element_at(F.filter(F.slice(said, 1, most), lambda x: x["n"]), F.lit(1))["s"]


def _beside(said: Column, name: Column, step: int = 1) -> Column:
    """The title right after (or before) a name among strings."""
    at = F.array_position(F.transform(said, lambda x: x["s"]), name)
    other = F.when((at > 0) & (at + step > 0), F.try_element_at(said, (at + step).cast("int")))
    return F.when(other["t"], other["s"])


def _within(elements: Column, e: Column, tags: tuple[str, ...], cls: str | None = None) -> Column:
    """The first element of the tags (and class) within ``e``, among its first 60."""
    near = part(elements, e["at"] + 1, e["last"] + 1, 60)
    fits = lambda x: x["tag"].isin(*tags) & (x["class"].rlike(cls) if cls else F.lit(True))
    return F.try_element_at(F.filter(near, fits), F.lit(1))


def sections(elements: Column, strings: Column) -> Column:
    """array<struct(at, last)>: sections of people: by a heading (its block and up to five siblings after it) and by id or class."""
    two = lambda e: e["kids"] >= 2
    text = lambda e: F.lower(F.array_join(part(strings, e["low"], e["high"]), ""))
    opens = lambda e: e["tag"].isin(*HEADINGS) & (F.length(text(e)) <= 80) & text(e).rlike("|".join(SECTION_HEADINGS))
    after = lambda h: F.filter(F.slice(F.filter(elements, lambda x: (x["parent"] == h["parent"]) & (x["at"] > h["at"]) & x["tag"].isin("section", "div", "article", "ul")), 1, 5), two)
    block = lambda h: F.array_compact(F.array(element(elements, h["block"])))
    by_heading = F.flatten(F.transform(F.filter(elements, opens), lambda h: F.concat(block(h), after(h))))
    by_word = F.filter(elements, lambda e: e["tag"].isin("section", "div", "article") & two(e) & (e["class"].rlike("|".join(SECTION_WORDS)) | e["id"].rlike(rf"^((our|meet[-_]the|advisory|executive|leadership)[-_])?({'|'.join(SECTION_WORDS)})([-_](members|section|team))?$")))
    return F.transform(F.concat(by_heading, by_word), lambda e: F.struct(e["at"].alias("at"), e["last"].alias("last")))


def _alt_ways(alt: Column) -> tuple[list[Column], list[Column]]:
    """Names and titles that an image's text may be read as, in the order they are tried; null where a break is missing."""
    clean = F.when(~F.lower(alt).rlike("|".join(NO_PORTRAIT)), F.trim(alt))
    halves = [F.split(clean, f"\\Q{b}\\E", 2) for b in ALT_BREAKS]
    cut = F.nullif(F.regexp_extract(clean, rf"(?i)^(.+?)\s+(?=({'|'.join(j.strip() for j in JOBS)})\b)", 1), F.lit(""))
    rest = F.regexp_replace(F.substr(clean, F.length(cut) + 1), r"^[\s\-–—|,]+|[\s\-–—|,]+$", "")
    several = [F.when(F.size(h) > 1, F.trim(h[0])) for h in halves], [F.when(F.size(h) > 1, F.trim(h[1])) for h in halves]
    return [*several[0], F.trim(cut), clean], [*several[1], rest, F.lit(None).cast("string")]


def _elements_of_interest(tree: DataFrame) -> DataFrame:
    """One row an element that a strategy starts from, with the strings in and around it."""
    t = tree.select("page_id", "elements", _said(F.col("strings")).alias("said"), sections(F.col("elements"), F.col("strings")).alias("sections"))
    elements, said = F.col("elements"), F.col("said")
    profile = lambda e: (e["tag"] == "a") & F.lower(e["href"]).contains("linkedin.")
    starts = F.filter(elements, lambda e: profile(e) | (~e["framed"] & ((e["tag"] == "img") | (e["tag"].isin(*CARD_TAGS, *HEADINGS[1:]) & (e["high"] > e["low"])))))

    def view(e: Column) -> Column:
        up = element(elements, e["parent"])
        above = F.when(up.isNotNull(), element(elements, up["parent"]))
        after = lambda x: _of(said, F.when(x.isNotNull(), element(elements, x["next"])))
        image = e["tag"] == "img"
        none = part(said, F.lit(0), F.lit(0))
        return F.struct(
            e.alias("e"), _of(said, e).alias("mine"), F.when(image | e["tag"].isin(*HEADINGS), _of(said, up)).otherwise(none).alias("around"),
            F.struct(up["tag"].alias("tag"), up["framed"].alias("framed"), up["peers"].alias("peers"), up["peer_strings"].alias("strings")).alias("up"),
            after(e).alias("after"), F.when(image, after(up)).otherwise(none).alias("after_up"), F.when(image, after(above)).otherwise(none).alias("after_above"),
            F.when(e["tag"] == "a", _of(said, element(elements, e["box"]))).otherwise(none).alias("boxed"),
            F.when(e["tag"].isin(*CARD_TAGS), _of(said, _within(elements, e, (*HEADINGS[1:], "strong", "b")))).otherwise(none).alias("head"),
            F.when(e["tag"].isin(*CARD_TAGS), _of(said, _within(elements, e, ("p", "span", "div"), TITLE_CLASSES))).otherwise(none).alias("role"),
            F.when(e["tag"] == "li", _of(said, _within(elements, e, ("strong", "b", "em")))).otherwise(none).alias("bold"),
            F.array_position(F.transform(F.col("sections"), lambda s: (e["at"] > s["at"]) & (e["at"] <= s["last"])), F.lit(True)).alias("section"),
        )

    return t.select("page_id", F.explode(F.transform(starts, view)).alias("v")).select("page_id", "v.*")


def cards(tree: DataFrame) -> DataFrame:
    """page_id, name, title, kind: people without addresses, one row a name and page.

    First within sections; if those give fewer than ``ENOUGH`` names, profile links,
    card classes and repeated siblings of the whole page; if there are still
    fewer, its portraits, headings and list items. Of several findings of a name
    the first scope, section, strategy and place counts.
    """
    v = _elements_of_interest(tree)
    e, mine, tag = F.col("e"), F.col("mine"), F.col("e.tag")
    groups = ("mine", "head", "role", "bold", "after", "after_up")
    alt_names, alt_titles = _alt_ways(F.when(tag == "img", e["alt"]))
    texts = F.array(*[F.nullif(_joined(F.col(g)), F.lit("")) for g in groups], *alt_names, *alt_titles)
    v = v.select("*", _said(texts).alias("whole"), _first_name(mine).alias("within"))
    whole = lambda group, flag: F.when(F.col("whole")[groups.index(group)][flag], F.col("whole")[groups.index(group)]["s"])
    ways = range(len(groups), len(groups) + len(alt_names))
    portrait = F.coalesce(*[F.when(F.col("whole")[k]["n"], F.struct(F.col("whole")[k]["s"].alias("name"), F.when(F.col("whole")[k + len(alt_names)]["t"], F.col("whole")[k + len(alt_names)]["s"]).alias("title"))) for k in ways])
    headed = F.when(F.size("head") > 0, whole("head", "n")).otherwise(_first_name(mine, 3))

    def card(strategy: int, kind: str, name: Column, title: Column, where: Column, sub: Column | int = 0) -> Column:
        sub = sub if isinstance(sub, Column) else F.lit(sub)
        return F.when(where & name.isNotNull(), F.struct(F.lit(strategy).alias("strategy"), sub.cast("int").alias("sub"), F.struct(name.alias("name"), title.alias("title"), F.lit(f"card_{kind}").alias("kind")).cast(CARD).alias("card")))

    boxed, around = F.col("boxed"), F.col("around")
    group = reduce(lambda rest, k: F.when(e["class"].rlike(CARD_CLASSES[k]), k).otherwise(rest), reversed(range(len(CARD_CLASSES))), F.lit(None).cast("int"))
    per = F.col("up.strings") / F.col("up.peers")
    linked = F.coalesce(whole("mine", "n"), "within", F.when(F.length(_joined(boxed)) <= 500, _first_name(boxed)))
    beside = F.coalesce(_first_name(around), whole("after", "n"), whole("after_up", "n"), _first_name(F.col("after_up"), 1), _first_name(F.col("after_above"), 1))
    named = {"linked": F.when(tag == "a", linked), "headed": F.when(tag.isin(*CARD_TAGS) & group.isNotNull(), headed), "pictured": F.when(tag == "img", F.coalesce(portrait["name"], beside)), "alt_title": portrait["title"]}
    v = v.select("*", *[c.alias(n) for n, c in named.items()])
    name = F.col
    found = F.array_compact(F.array(
        card(1, "profile", name("linked"), F.coalesce(_beside(mine, name("linked")), _beside(boxed, name("linked")), _beside(boxed, name("linked"), -1)), tag == "a"),
        card(2, "class", name("headed"), F.coalesce(whole("role", "t"), _beside(mine, name("headed"))), tag.isin(*CARD_TAGS), group),
        card(3, "siblings", name("within"), _beside(mine, name("within")), tag.isin("div", "li", "article") & F.col("up.tag").isin("div", "ul", "section", "article") & ~F.col("up.framed") & (F.col("up.peers") >= 2) & per.between(1.5, 6) & (F.size(mine) >= 2)),
        card(4, "portrait", name("pictured"), F.coalesce("alt_title", _beside(around, name("pictured")), _beside(F.col("after_up"), name("pictured"))), tag == "img"),
        card(5, "heading", whole("mine", "n"), F.coalesce(whole("after", "t"), _beside(around, whole("mine", "n"))), tag.isin(*HEADINGS[1:])),
        card(6, "item", name("within"), F.coalesce(_beside(mine, name("within")), F.when(~F.col("whole")[groups.index("bold")]["s"].eqNullSafe(name("within")), whole("bold", "t"))), tag == "li"),
    ))
    rows = v.select("page_id", "section", e["at"].alias("at"), F.explode(found).alias("c")).select("page_id", "section", "at", "c.strategy", "c.sub", F.struct(without_credentials(F.trim("c.card.name")).alias("name"), "c.card.title", "c.card.kind").alias("card"))
    scope = F.when(F.col("section") > 0, 0).when(F.col("strategy") <= 3, 1).otherwise(2)
    order = F.struct(scope.alias("scope"), "section", "strategy", "sub", "at")
    best = rows.groupBy("page_id", F.lower(F.trim("card.name")).alias("key")).agg(F.min_by("card", order).alias("card"), F.min(order)["scope"].alias("scope"))
    page = Window.partitionBy("page_id")
    so_far = lambda k: F.count_if(F.col("scope") <= k).over(page)
    best = best.withColumns({"in_sections": so_far(0), "primary": so_far(1)})
    kept = (F.col("scope") == 0) | ((F.col("in_sections") < ENOUGH) & ((F.col("scope") == 1) | (F.col("primary") < ENOUGH)))
    return best.where(kept).select("page_id", "card.*")


def name_piece(text: Column) -> Column:
    """The part of a label that is a name: "Ann Lee – VP Sales", "VP Sales | Ann Lee"."""
    bare = F.regexp_replace(text, f"(?i){emails.EMAIL}", " ")
    pieces = F.transform(F.split(bare, r"[|/·•,;]|\s+[-–—]\s+"), lambda p: F.regexp_replace(F.regexp_replace(p, r"\s+", " "), r"^[\s:.,()\[\]<>\"-]+|[\s:,()\[\]<>\"-]+$", ""))
    return F.try_element_at(F.filter(pieces, lambda p: like_name(p)), F.lit(1))


def _decoded(value: Column, link: Column) -> Column:
    """A value with escapes of JSON and of links resolved, signs in words written out."""
    plain = F.regexp_replace(value, r"(?i)\\?u00(3c|3e|22|26)", " ")
    plain = F.when(link, F.coalesce(F.try_url_decode(F.replace(plain, F.lit("+"), F.lit("%2B"))), plain)).otherwise(plain)
    loose = F.lower(plain)
    at, dot = r"\s*(\[at\]|\(at\)|\bat\b)\s*", r"\s*(\[dot\]|\(dot\)|\bdot\b)\s*"
    return F.when(~loose.contains("@") & loose.rlike(at) & loose.rlike(dot), F.regexp_replace(F.regexp_replace(loose, at, "@"), dot, ".")).otherwise(plain)


def addresses(tree: DataFrame) -> DataFrame:
    """page_id, email, name, kind, snippet, is_role: an address once a page, from links, then other attributes, then text.

    name: the nearest of the element itself, its parent, what stands before that,
    and the headings before; else of the address. A role's address has no name of its own.
    """
    t = tree.select("page_id", "elements", "strings", "owners", "attributes", F.filter("elements", lambda e: e["tag"].isin(*HEADINGS)).alias("heads"))
    elements, strings = F.col("elements"), F.col("strings")
    words = lambda e: F.when(e.isNotNull(), F.array_join(part(strings, e["low"], e["high"]), " "))
    hinted = lambda s: s.contains("@") | (F.lower(s).rlike(r"\bat\b") & F.lower(s).rlike(r"\bdot\b"))

    def place(pass_: Column, at: Column, owner: Column, value: Column, link: Column, text: Column) -> Column:
        me = element(elements, owner)
        up = F.when(me.isNotNull(), element(elements, me["parent"]))
        before = F.when(up.isNotNull() & (up["before_low"] >= 0), F.array_join(part(strings, up["before_low"], up["before_high"]), " "))
        seen = F.coalesce(up["heads"], me["heads"], F.lit(0))  # headings before the parent, or the element without one
        heads = F.reverse(F.slice("heads", F.greatest(seen - 20, F.lit(0)) + 1, F.least(seen, F.lit(20))))
        near = F.when(text, F.array(words(me))).otherwise(F.concat(F.array(words(me), words(up), before), F.transform(heads, words)))
        kind = F.when(text, "text").when((me["tag"] == "a") & F.lower(me["href"]).startswith("mailto:"), "mailto_link").when(me["tag"] == "a", "link").otherwise(me["tag"])
        said = F.when(text, value).otherwise(words(me))
        return F.struct(pass_.alias("pass"), at.alias("at"), value.alias("value"), link.alias("link"), near.alias("near"), kind.alias("kind"), F.substring(F.regexp_replace(said, r"\s+", " "), 1, SNIPPET).alias("snippet"))

    of_attributes = F.transform("attributes", lambda a, i: place(F.when(a["link"], 0).otherwise(1), i, a["owner"], a["value"], a["link"], F.lit(False)))
    spoken = F.filter(F.transform(strings, lambda s, i: F.struct(s.alias("s"), i.alias("i"))), lambda x: hinted(x["s"]))
    of_texts = F.transform(spoken, lambda x: place(F.lit(2), x["i"], F.element_at(F.col("owners"), x["i"] + 1), x["s"], F.lit(False), F.lit(True)))
    rows = t.select("page_id", F.explode(F.concat(of_attributes, of_texts)).alias("p")).select("page_id", "p.*")
    rows = rows.withColumn("mails", emails.extract(_decoded(F.col("value"), F.col("link"))))
    rows = rows.select("page_id", "pass", "at", "near", "kind", "snippet", F.posexplode("mails").alias("k", "email"))
    found = rows.groupBy("page_id", "email").agg(F.min_by(F.struct("near", "kind", "snippet"), F.struct("pass", "at", "k")).alias("f")).select("page_id", "email", "f.*")
    role = emails.role_like(F.col("email"))
    found = found.withColumn("near", F.array_compact("near"))
    first = lambda strings: F.try_element_at(F.filter(F.transform(strings, name_piece), lambda n: n.isNotNull()), F.lit(1))
    nearest = F.coalesce(*[first(F.slice("near", at, n)) for at, n in ((1, 1), (2, 1), (3, 2), (5, 40))])  # the rest only where none was found
    return found.select("page_id", "email", F.coalesce(nearest, F.when(~role, emails.name_from_local(F.col("email")))).alias("name"), "kind", F.nullif("snippet", F.lit("")).alias("snippet"), role.alias("is_role"))


def card_gate(url: Column, html: Column) -> Column:
    """Whether cards are looked for: never on pages about others; else by the page's score or its texts."""
    head = F.lower(F.substring(F.coalesce(html, F.lit("")), 1, 60_000))
    told = reduce(lambda a, s: a | head.contains(s), PEOPLE_SIGNALS[1:], head.contains(PEOPLE_SIGNALS[0]))
    return url_rules.blocked_reason(url).isNull() & ~url_rules.is_news(url) & (F.coalesce(urls.page_score(url, html) >= LEAST_SCORE, F.lit(False)) | told)


def candidates(pages: DataFrame) -> DataFrame:
    """page_id, email, name, title, kind, snippet, is_role: what pages (page_id, url, html; domain: of the company, may be null or missing) tell of people.

    Addresses of other organisations than the domain are left out, if there is a
    domain. A card whose name an address has gives it its title (the longest) and
    goes; candidates that the gates refuse go. A page_id stands for one page; null pages give nothing.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.col("domain") if "domain" in pages.columns else F.lit(None).cast("string").alias("domain"))
    tree = trees(own)
    told = own.select("page_id", "url", F.lower("domain").alias("domain"), card_gate(F.col("url"), F.col("html")).alias("gate"))
    mails = addresses(tree).join(told.select("page_id", "domain"), "page_id")
    mails = mails.where(F.col("domain").isNull() | emails.same_org(F.split_part("email", F.lit("@"), F.lit(2)), F.col("domain")))
    people = cards(trees(own.where(card_gate(F.col("url"), F.col("html")))))
    people = people.where(gates.candidate_reason(F.col("name"), F.lit(None).cast("string")).isNull()).withColumn("key", F.lower("name"))
    snippet = F.concat_ws(" - ", "name", "title")
    alone = people.select("page_id", "key", F.lit(None).cast("string").alias("email"), "name", "title", "kind", snippet.alias("snippet"), F.lit(False).alias("is_role"), F.lit(True).alias("card"))
    mails = mails.where(gates.candidate_reason(F.col("name"), F.col("email")).isNull()).select("page_id", F.lower("name").alias("key"), "email", "name", F.lit(None).cast("string").alias("title"), "kind", "snippet", "is_role", F.lit(False).alias("card"))
    same = Window.partitionBy("page_id", "key")
    both = alone.unionByName(mails).withColumns({"best": F.max_by("title", F.length("title")).over(same), "addressed": F.max(~F.col("card")).over(same)})
    title = F.when(F.col("card"), F.col("title")).otherwise(F.col("best"))
    return both.where(~(F.col("card") & F.col("addressed"))).select("page_id", "email", "name", title.alias("title"), "kind", "snippet", "is_role")
