"""Which pages are sources of a company's own people: ordered rules on path segments, with the rule that decided.

A rule is a name and words. A word is a whole segment (- and _ count alike); a
detail rule's word must have a segment behind it. Of the rules that hold the
first is the reason. Words are kept apart from matching, so a table of one's own
can be given.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlens.functions import gates

WHOLE, DETAIL, STEM = "whole", "detail", "stem"

# ---- Fixed values: rule names, their words and order, which reasons depend on.
#: Pages whose people are customers, partners, applicants, speakers or guests.
BLOCKED_SOURCES = (
    ("customer_story", WHOLE, ("customer-story", "customer-stories")), ("case_study", WHOLE, ("case-study", "case-studies")), ("success_story", WHOLE, ("success-story", "success-stories")),
    ("testimonial", WHOLE, ("testimonial", "testimonials")), ("reviews_detail", DETAIL, ("review", "reviews")), ("client_story", WHOLE, ("client-story", "client-stories")), ("customer_spotlight", WHOLE, ("customer-spotlight", "customer-success")),
    ("customers_detail", DETAIL, ("customers",)), ("clients_detail", DETAIL, ("clients",)), ("partners_detail", DETAIL, ("partner", "partners")), ("integrations_detail", DETAIL, ("integration", "integrations")),
    ("marketplace_detail", DETAIL, ("marketplace",)), ("app_directory", WHOLE, ("app-directory",)), ("careers_detail", DETAIL, ("career", "careers")), ("jobs_detail", DETAIL, ("job", "jobs")),
    ("openings", WHOLE, ("opening", "openings")), ("positions", WHOLE, ("position", "positions")), ("work_with_us", WHOLE, ("work-with-us",)), ("join_us", WHOLE, ("join-us",)), ("hiring", WHOLE, ("hiring",)),
    ("legal", WHOLE, ("legal",)), ("terms", WHOLE, ("terms",)), ("privacy", WHOLE, ("privacy",)), ("support", WHOLE, ("support",)), ("help", WHOLE, ("help",)), ("faq", WHOLE, ("faq",)), ("documentation", WHOLE, ("documentation",)), ("docs", WHOLE, ("docs",)),
    ("events_detail", DETAIL, ("event", "events")), ("webinars_detail", DETAIL, ("webinar", "webinars")), ("conferences", WHOLE, ("conference", "conferences")), ("workshops", WHOLE, ("workshop", "workshops")),
    ("podcasts_detail", DETAIL, ("podcast", "podcasts")), ("episodes_detail", DETAIL, ("episode", "episodes")),
)
#: Segments that overrule a block.
STRONG_SEGMENTS = ("team", "teams", "leadership", "executive", "executives", "management", "people", "staff", "board", "director", "directors", "governance", "advisor", "advisors", "bio", "bios", "who-we-are", "whoweare", "who-weare", "whowe-are", "our-team", "ourteam", "company")
#: Words in the path of a post that make it one about the company's own people.
POST_WORDS = ("appoint", "appointed", "appointment", "join", "joins", "welcome", "welcomes", "announce", "announces", "announced", "announcing", "leadership", "executive", "exec", "board", "director", "ceo", "cto", "cfo", "coo", "cmo", "cpo", "cro", "founder", "cofounder", "co-founder", "president")
#: Pages that list a company's people, or news of them.
PEOPLE_SOURCES = (
    ("about", WHOLE, ("about",)), ("about_us", WHOLE, ("about-us",)), ("company", WHOLE, ("company",)), ("team", WHOLE, ("team",)), ("teams", WHOLE, ("teams",)), ("leadership", WHOLE, ("leadership",)), ("people", WHOLE, ("people",)), ("staff", WHOLE, ("staff",)),
    ("executive", WHOLE, ("executive", "executives")), ("management", WHOLE, ("management",)), ("founders", WHOLE, ("founder", "founders")), ("board", WHOLE, ("board",)), ("directors", WHOLE, ("director", "directors")),
    ("who_we_are", WHOLE, ("who-we-are", "whoweare")), ("our_team", WHOLE, ("our-team", "ourteam")), ("our_people", WHOLE, ("our-people", "ourpeople")), ("our_story", WHOLE, ("our-story", "ourstory")),
    ("press_room", WHOLE, ("press-room", "pressroom")), ("newsroom", WHOLE, ("newsroom",)), ("press_index", WHOLE, ("press",)), ("news_index", WHOLE, ("news",)), ("press_release", WHOLE, ("press-release", "pressrelease")),
    ("security", WHOLE, ("security",)), ("trust", WHOLE, ("trust",)), ("compliance", WHOLE, ("compliance",)), ("investor", WHOLE, ("investor", "investors")), ("ir", WHOLE, ("ir",)),
)
#: Below /blog: pages of these kinds about these subjects list people too (any subject of an author's).
BLOG_SUBJECTS = (("blog_category_about", "category", ("about", "company")), ("blog_tag_about", "tag", ("about", "team", "leadership", "company")))
#: Pages of no people by subject: words of whole segments with a slash behind (singular; an s may follow), and beginnings of segments.
NO_PEOPLE = (
    ("content", DETAIL, "blog article post press-release podcast episode webinar video event conference workshop whitepaper ebook guide report resource"),
    ("customers", STEM, "customer-stor case-stud success-stor testimonial client-stor"), ("customers", DETAIL, "review reference"),
    ("careers", STEM, "career opening work-with-us join-us hiring recruitment greenhouse lever.co workable bamboohr"), ("careers", DETAIL, "job position apply application"),
    ("products", STEM, "pricing teams-phone teams-chat teams-meeting teams-integration teams-calling teams-voice teams-video teams-collaboration microsoft-teams ms-teams team-management team-productivity team-collaboration team-software team-tools team-platform"),
    ("products", DETAIL, "product feature solution platform service capability capabilitie offering module"),
    ("opinions", STEM, "thought-leadership leadership-insights leadership-blog leadership-articles leadership-resources leadership-content leadership-series leadership-podcast leadership-webinar"),
    ("legal", STEM, "terms privacy cookie gdpr"), ("legal", DETAIL, "legal compliance security trust"), ("help", DETAIL, "support help faq doc documentation api developer sdk"),
    ("accounts", STEM, "login signin signup register get-started start-free request-demo schedule book- contact-sales utm-"), ("accounts", DETAIL, "demo trial campaign lp landing promo offer"),
    ("partners", STEM, "partner-"), ("partners", DETAIL, "integration connector marketplace app-store"), ("locale", DETAIL, "en-us en-gb en-au en-ca de fr es it pt ja zh ko"),
)
#: Whole segments of pages of people.
LISTED = (
    "about about-us aboutus our-story who-we-are our-company team teams our-team the-team meet-the-team meet-our-team meet-us care-team leadership leaders our-leadership leadership-team executive-team executives executive-leadership senior-leadership senior-team "
    "c-suite management management-team board board-of-directors directors advisors advisory-board people our-people staff employees founders our-founders partners company press-room pressroom press"
)
#: News of a company, by whole segments and by beginnings; media of which a single piece is one.
NEWS_SEGMENTS, NEWS_STEMS, NEWS_MEDIA = ("press-release", "press-releases", "in-the-news"), ("case-stud", "customer-stor", "testimonial", "success-stor"), ("webinar", "webinars", "podcast", "podcasts", "episode", "episodes")
# ---- end of fixed values


def raw_segments(url: Column) -> Column:
    """The segments of a lower-case path, _ as -; a trailing slash leaves an empty last one."""
    path = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1))
    return F.slice(F.split(F.replace(path, F.lit("_"), F.lit("-")), "/"), 2, 1000)


def _words(words: tuple[str, ...] | list[str]) -> Column:
    return F.array(*map(F.lit, words))


def _has(segments: Column, words: tuple[str, ...] | list[str]) -> Column:
    return F.arrays_overlap(segments, _words(words))


def _followed(segments: Column, empty: bool) -> Column:
    """Segments with one behind them; ``empty``: a trailing slash is enough."""
    own = segments if empty else F.filter(segments, lambda s: s != "")
    return F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0)))


def _begins(segments: Column, stems: tuple[str, ...] | list[str]) -> Column:
    return F.exists(segments, lambda s: reduce(lambda a, b: a | b, (s.startswith(x) for x in stems)))


def first_rule(segments: Column, rules: tuple[tuple[str, str, tuple[str, ...]], ...]) -> Column:
    """The name of the first rule that holds; null if none does."""
    behind = _followed(segments, False)
    tests = {WHOLE: lambda w: _has(segments, w), DETAIL: lambda w: _has(behind, w), STEM: lambda w: _begins(segments, w)}
    out = F
    for name, kind, words in rules:
        out = out.when(tests[kind](words), name)
    return out


def blocked_reason(url: Column, rules: tuple = BLOCKED_SOURCES) -> Column:
    """Why a page is no source of people; null if it may be one. Strong segments overrule; posts with words of appointments pass."""
    segments = raw_segments(url)
    places = F.filter(segments, lambda s: s != "")
    after_blog = F.slice(places, F.array_position(places, "blog").cast("int") + 1, 100)
    post = F.array_contains(places, "blog") & (F.coalesce(F.try_element_at(after_blog, F.lit(1)).rlike("^[0-9]{4}$"), F.lit(False)) | (F.size(after_blog) >= 3))
    told = _has(F.flatten(F.transform(segments, lambda s: F.split(s, "[^a-z0-9]+"))), POST_WORDS) | F.exists(segments, lambda s: s.contains("co-founder"))
    return (
        F.when(_has(segments, STRONG_SEGMENTS), F.lit(None).cast("string"))
        .when(post, F.when(~told, "blocked_blog_post"))
        .otherwise(F.concat(F.lit("blocked_pattern:"), first_rule(segments, rules)))
    )


def people_rule(url: Column, rules: tuple = PEOPLE_SOURCES) -> Column:
    """The rule by which a page lists people; null if none, or if it is blocked."""
    segments = raw_segments(url)
    places = F.filter(segments, lambda s: s != "")
    below = F.slice(places, F.array_position(places, "blog").cast("int") + 1, 2)
    blog = F.when(F.array_contains(places, "blog") & (F.size(below) == 2), F.struct(below[0].alias("kind"), below[1].alias("subject")))
    extra = F.when(blog["kind"] == "author", "blog_author")
    for name, kind, subjects in BLOG_SUBJECTS:
        extra = extra.when((blog["kind"] == kind) & blog["subject"].isin(*subjects), name)
    return F.when(blocked_reason(url).isNull(), F.coalesce(first_rule(segments, rules), extra))


def source_class(url: Column) -> Column:
    """struct(blocked, people): the reasons for and against a page as a source."""
    return F.struct(blocked_reason(url).alias("blocked"), people_rule(url).alias("people"))


def page_filter(url: Column, blocked: tuple = NO_PEOPLE, listed: str = LISTED) -> Column:
    """struct(allowed, reason): whether a crawl keeps a page. Blocks come before listed segments; what no rule names is not kept."""
    segments = raw_segments(url)
    behind = _followed(segments, True)
    numbered = lambda of, digits: F.exists(F.arrays_zip(F.slice(segments, 1, F.greatest(F.size(segments) - 1, F.lit(0))).alias("a"), F.slice(segments, 2, 1000).alias("b")), lambda x: x["a"].isin(*of) & x["b"].rlike(digits))
    out = F
    for name, kind, words in blocked:
        own = words.split()
        out = out.when(_begins(segments, own) if kind == STEM else _has(behind, own + [f"{w}s" for w in own if name != "locale"]), F.struct(F.lit(False).alias("allowed"), F.lit(f"blocked:{name}").alias("reason")))
    dated = numbered(("news", "press"), "^([12]|[a-z]+-[0-9]{4})")
    regional = F.exists(F.arrays_zip(behind.alias("a"), F.slice(segments, 2, 1000).alias("b")), lambda x: x["a"].rlike("^[a-z]{2}(-[a-z]{2})?$") & x["b"].startswith("about"))
    no = lambda why: F.struct(F.lit(False).alias("allowed"), F.lit(why).alias("reason"))
    out = out.when(dated, no("blocked:dated")).when(regional, no("blocked:locale"))
    out = out.when(_has(segments, listed.split()), F.struct(F.lit(True).alias("allowed"), F.lit("listed").alias("reason")))
    return out.otherwise(no("no_rule"))


def is_news(url: Column) -> Column:
    """Releases and news about the company, cases, and single pieces of its media (a number behind the medium)."""
    segments = raw_segments(url)
    pairs = F.arrays_zip(_followed(segments, True).alias("a"), F.slice(segments, 2, 1000).alias("b"))
    return _has(segments, NEWS_SEGMENTS) | _begins(segments, NEWS_STEMS) | F.exists(pairs, lambda x: x["a"].isin(*NEWS_MEDIA) & x["b"].rlike("^[0-9]"))


def is_blog_author(url: Column, title: Column) -> Column:
    """Named on a blog without a leader's title: an author, not one of the company's leaders."""
    path = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1))
    return path.contains("/blog") & ~gates.has_leadership_title(title)


def by_source(candidates: DataFrame, strict: bool = True) -> DataFrame:
    """Candidates (with url) from pages that may be sources; ``strict``: from pages that list people only. A null url passes."""
    url = F.col("url")
    keep = blocked_reason(url).isNull()
    if strict:
        keep = keep & (F.coalesce(url, F.lit("")).eqNullSafe("") | people_rule(url).isNotNull())
    return candidates.where(keep)
