"""Gates: what may be stored as a person, a title or an address of one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadlens.functions.once import once

# ---- Fixed values: words and patterns that results depend on.
#: Standards and business abbreviations that look like names.
COMPLIANCE = ("pci", "pcidss", "pci-dss", "pci dss", "soc", "soc1", "soc2", "soc 1", "soc 2", "soc-1", "soc-2", "iso", "iso27001", "iso 27001", "iso-27001", "iso27k", "hipaa", "hitech", "gdpr", "ccpa", "cpra", "ferpa", "glba", "sox", "sarbanes-oxley", "sarbanes oxley", "fedramp", "fed-ramp", "fed ramp", "nist", "cis", "cmmc", "fisma", "itar", "hitrust", "aicpa", "ssae", "ssae16", "ssae18", "api", "sdk", "saas", "paas", "iaas", "roi", "kpi", "okr", "nps", "crm", "erp", "hrm", "hris", "gdp", "cagr", "arr", "mrr")
CITIES = ("new york", "new york city", "nyc", "los angeles", "la", "chicago", "houston", "phoenix", "philadelphia", "san antonio", "san diego", "dallas", "san jose", "austin", "jacksonville", "san francisco", "sf", "seattle", "denver", "boston", "washington", "washington dc", "dc", "atlanta", "miami", "portland", "las vegas", "detroit", "minneapolis", "north bethesda", "london", "paris", "berlin", "tokyo", "sydney", "melbourne", "singapore", "hong kong", "shanghai", "beijing", "mumbai", "bangalore", "delhi", "dubai", "toronto", "vancouver", "montreal", "mexico city", "sao paulo", "buenos aires", "amsterdam", "dublin", "zurich", "geneva", "stockholm", "oslo", "copenhagen", "helsinki", "warsaw", "prague", "vienna", "brussels", "lisbon", "madrid", "barcelona", "milan", "rome", "tel aviv", "seoul")
STATES = ("california", "texas", "florida", "new york state", "illinois", "pennsylvania", "ohio", "georgia", "michigan", "north carolina", "new jersey", "virginia", "washington state", "arizona", "massachusetts", "tennessee", "indiana", "maryland", "missouri", "wisconsin", "colorado", "minnesota", "south carolina", "alabama", "louisiana", "kentucky", "oregon", "connecticut")
COUNTRIES = ("usa", "united states", "us", "uk", "united kingdom", "canada", "australia", "germany", "france", "japan", "china", "india", "brazil", "mexico", "spain", "italy", "netherlands", "switzerland", "sweden", "norway", "denmark", "finland", "ireland", "israel", "south korea", "korea", "taiwan", "argentina")
REGIONS = ("emea", "apac", "latam", "americas", "europe", "asia", "north america", "south america", "middle east", "africa", "asia pacific", "western europe", "eastern europe")
DIRECTIONS = ("north", "south", "east", "west")
NAVIGATION = ("home", "about", "about us", "contact", "contact us", "team", "our team", "leadership", "careers", "jobs", "blog", "news", "press", "media", "resources", "products", "services", "solutions", "pricing", "support", "help", "faq", "documentation", "docs", "login", "sign in", "sign up", "register", "account", "privacy", "terms", "legal", "cookies", "sitemap", "engineering", "marketing", "sales", "finance", "human resources", "hr", "operations", "customer success", "product", "design", "legal team", "executive team", "board of directors", "advisory board", "investors", "partners", "data partners", "premier partners", "technology partners", "read more", "learn more", "see more", "view all", "get started", "request demo", "book a demo", "subscribe", "newsletter", "download", "share")
NOT_NAMES = ("unlock", "opportunity", "opportunities", "see", "action", "demo", "trial", "request", "book", "schedule", "started", "start", "learn", "more", "logo", "circle", "cares", "care", "partner", "partners", "solutions", "resources", "our", "firm", "useful", "links", "services", "service", "contact", "about", "home", "menu", "navigation", "footer", "header", "sidebar", "copyright", "privacy", "policy", "terms", "conditions", "sitemap", "search", "login", "signup", "register", "subscribe", "newsletter", "blog", "news", "events", "careers", "jobs", "faq", "help", "support", "tax", "preparation", "accounting", "bookkeeping", "payroll", "advisory", "consulting", "audit", "assurance", "compliance", "planning", "business", "individual", "corporate", "estate", "retirement", "wealth", "management", "financial", "insurance", "accountant", "analyst", "administrator", "administrative", "assistant", "associate", "coordinator", "specialist", "technician", "supervisor", "representative", "consultant", "advisor", "certified", "public", "licensed", "registered", "intern", "trainee", "receptionist", "secretary", "clerk", "officer", "controller", "treasurer", "bookkeeper", "manager", "director", "executive", "president", "principal")
PARTICLES = ("van", "von", "de", "del", "da", "di", "du", "la", "le")
SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "phd", "md")
GLUE = ("in", "for", "to", "with", "and", "the", "of")
#: Words that a title has at least one of; phrases that none has; what its beginning can't be; the longest title.
ROLE_WORDS = ("chief", "ceo", "cfo", "cto", "coo", "cmo", "cpo", "cro", "ciso", "president", "founder", "cofounder", "chair", "vp", "svp", "evp", "director", "head", "manager", "principal", "partner", "counsel", "officer", "executive", "advisor")
BLURBS = ("insights", "features", "built right", "built in", "learn", "get", "grow", "connect", "instantly", "out of the box")
CALLS = ("unlock ", "request ", "book ", "schedule ", "get started")
LONGEST_TITLE = 80
LEADERS = ("ceo", "cto", "cfo", "coo", "cmo", "cpo", "cro", "ciso", "chief", "president", "founder", "co-founder", "cofounder", "vp ", "vice president", "svp", "evp", "director", "head of", "partner", "managing", "chair", "chairman", "chairwoman")
PLACEHOLDER_LOCALS = ("jdoe", "j.doe", "johndoe", "john.doe", "john_doe", "janedoe", "jane.doe", "jane_doe", "test", "testuser", "test.user", "test_user", "example", "sample", "demo", "demouser", "placeholder", "yourname", "your.name", "your_name", "firstname", "first.name", "first_name", "lastname", "last.name", "last_name", "firstname.lastname", "first.last", "user", "newuser", "tempuser", "admin", "administrator", "root", "sysadmin", "nobody", "null", "void", "anonymous", "anon", "name", "email", "address", "person")
ROLE_LOCALS = ("info", "contact", "hello", "support", "sales", "team", "admin", "help", "office", "careers", "hr", "jobs", "press", "media", "marketing", "billing", "accounts", "service", "enquiries", "inquiries", "general", "feedback", "webmaster", "postmaster", "abuse", "security", "privacy", "legal", "compliance", "pr", "noreply", "no-reply", "donotreply", "do-not-reply", "mailer-daemon")
THIRD_PARTY = ("/customer-stor", "/case-stud", "/success-stor", "/testimonial", "/client-stor", "/customer-spotlight", "/review/", "/reviews/")
BLOGS = ("/blog/", "/article/", "/articles/", "/post/", "/posts/")
# ---- end of fixed values

GEOGRAPHY = CITIES + STATES + COUNTRIES + REGIONS


def _low(c: Column) -> Column:
    """Lower case without outer white space; NULL as blank."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", ""))


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def _holds(c: Column, parts: tuple[str, ...]) -> Column:
    """One of the parts occurs in lower-cased ``c``."""
    low = F.lower(F.coalesce(c, F.lit("")))
    out = low.contains(parts[0])
    for p in parts[1:]:
        out = out | low.contains(p)
    return out


def is_compliance_term(c: Column) -> Column:
    return _low(c).isin(*COMPLIANCE)


def is_geography_term(c: Column) -> Column:
    """A place, a direction, or a direction and a word ("north bethesda")."""
    return once(_low(c), lambda low: low.isin(*GEOGRAPHY, *DIRECTIONS) | low.rlike(r"^(north|south|east|west)\s+[a-z][a-z\s'-]+$"))


def is_navigation(c: Column) -> Column:
    return _low(c).isin(*NAVIGATION)


def has_leadership_title(title: Column) -> Column:
    return _holds(title, LEADERS)


def is_third_party_url(url: Column) -> Column:
    """A page about others: customers, cases, reviews."""
    return _holds(url, THIRD_PARTY)


def is_blog_url(url: Column) -> Column:
    return _holds(url, BLOGS)


def _local(email: Column) -> Column:
    return _low(F.split_part(email, F.lit("@"), F.lit(1)))


def is_role_email(email: Column) -> Column:
    return F.coalesce(email.contains("@") & _local(email).isin(*ROLE_LOCALS), F.lit(False))


def is_placeholder(email: Column) -> Column:
    return F.coalesce(_local(email).isin(*PLACEHOLDER_LOCALS), F.lit(False))


def person_name_reason(name: Column) -> Column:
    """Why a string can't be a person's name: the first of fifteen checks that fails; NULL if none does."""
    edge = r"[ ,;:|/\\()\[\]{}<>]"
    tokens_of = lambda clean: F.filter(F.transform(F.split(F.regexp_replace(F.regexp_replace(clean, r"\s+", " "), r"^[ ,;:|/\\]+|[ ,;:|/\\]+$", ""), " "), lambda t: F.regexp_replace(t, f"^{edge}+|{edge}+$", "")), lambda t: t != "")
    dotless = lambda t: F.lower(F.regexp_replace(t, r"^\.+|\.+$", ""))
    core_of = lambda tokens: F.filter(tokens, lambda t: ~dotless(t).isin(*SUFFIXES))
    letters = r"^\p{L}+$"
    spelt = lambda t: F.lower(t).isin(*PARTICLES) | dotless(t).rlike(r"^\p{L}$") | t.rlike(r"^[A-Za-z][A-Za-z'.-]*$")
    part = lambda t: (F.length(dotless(t)) >= 2) & F.regexp_replace(dotless(t), "['-]", "").rlike(letters)

    def of_tokens(clean: Column, tokens: Column, core: Column) -> Column:
        other = F.try_element_at(F.filter(F.transform(core, dotless), lambda t: t.isin(*NOT_NAMES)), F.lit(1))
        words = F.split(clean, r"\s+")
        return (
            F.when(F.size(tokens) == 0, "empty_tokens")
            .when(F.size(core) > 5, "too_many_tokens")
            .when(other.isNotNull(), F.concat(F.lit("non_person_token:"), other))
            .when((F.size(core) >= 3) & F.exists(core, lambda t: F.lower(t).isin(*GLUE)), "looks_like_phrase")
            .when(F.exists(core, lambda t: ~spelt(t)), "bad_token_chars")
            .when((F.upper(clean) == clean) & (F.lower(clean) != clean) & (F.size(words) <= 3) & F.forall(words, lambda w: F.length(w) <= 6), "likely_acronym")
            .when(F.size(core) == 1, F.when(F.length(dotless(core[0])) < 3, "single_token_too_short"))
            .when(F.size(F.filter(core, part)) < 2, "not_enough_name_parts")
        )

    def of_clean(clean: Column) -> Column:
        return (
            F.when(clean == "", "empty_name")
            .when(is_compliance_term(clean), "compliance_term")
            .when(is_geography_term(clean), "geography_term")
            .when(is_navigation(clean), "nav_boilerplate")
            .when(clean.rlike(r"^[\p{Nd}\s.-]+$"), "numeric_only")
            .when(clean.rlike(r"\p{Nd}"), "contains_digits")
            .when(clean.contains("@"), "contains_at_sign")
            .otherwise(once(tokens_of(clean), lambda tokens: once(core_of(tokens), lambda core: of_tokens(clean, tokens, core))))
        )

    return once(F.regexp_replace(F.coalesce(name, F.lit("")), r"^\s+|\s+$", ""), of_clean)


def title_reason(title: Column) -> Column:
    """Why a string can't be a job title; NULL if it can, and for a blank one."""

    def told(clean: Column, low: Column) -> Column:
        return (
            F.when(clean == "", F.lit(None).cast("string"))
            .when(F.length(clean) > LONGEST_TITLE, "title_too_long")
            .when(is_geography_term(clean), "geography_as_title")
            .when(is_navigation(clean), "nav_boilerplate_as_title")
            .when(_holds(clean, BLURBS), "marketing_buzzword_in_title")
            .when(low.contains(" in action") & low.rlike("^(see|watch) "), "cta_see_in_action")
            .when(low.rlike(f"^({'|'.join(CALLS)})"), "cta_prefix")
            .when(low.contains("opportunities") & low.contains("unlock"), "cta_unlock_opportunities")
            .when(~low.rlike(rf"\b({'|'.join(ROLE_WORDS)})\b"), "missing_role_keyword")
        )

    clean = F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+", " "), "^ | $", "")
    return once(clean, lambda c: once(F.lower(c), lambda low: told(c, low)))


def candidate_reason(name: Column, email: Column) -> Column:
    """Why a candidate isn't stored; NULL if it may be: placeholder and role addresses, names, neither of both."""
    told = lambda why: (  # noqa: E731  (the name's reason is worked out once)
        F.when(~_blank(email) & is_placeholder(email), F.concat(F.lit("placeholder_email:"), _local(email)))
        .when(is_role_email(email) & _blank(name), "role_email_no_name")
        .when(is_role_email(email) & why.isNotNull(), F.concat(F.lit("role_email_invalid_name:"), why))
        .when(~_blank(name) & why.isNotNull(), F.concat(F.lit("invalid_name:"), why))
        .when(_blank(name) & _blank(email), "no_name_or_email")
    )
    return once(person_name_reason(name), told)


def clean_title(title: Column) -> Column:
    """The title, or NULL if it is none."""
    return F.when(~_blank(title) & title_reason(title).isNull(), title)


def clean_email(email: Column) -> Column:
    """The address, or NULL if it is a role's."""
    return F.when(~_blank(email) & ~is_role_email(email), email)


def is_person(name: Column, email: Column, title: Column, approved: Column, url: Column, kind: Column) -> Column:
    """Whether a candidate is kept as a person.

    Never from pages about others, nor from blogs unless the title leads; a
    name must be one; then approval, an address, a title that is one, or a
    profile as the source is enough.
    """
    kept_source = _blank(url) | ~(is_third_party_url(url) | (is_blog_url(url) & ~has_leadership_title(title)))
    named = _blank(name) | person_name_reason(name).isNull()
    signal = F.coalesce(approved, F.lit(False)) | ~_blank(email) | clean_title(title).isNotNull() | _holds(kind, ("linkedin", "profile"))
    return kept_source & named & signal
