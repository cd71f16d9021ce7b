"""E-mail addresses: extraction, roles, permutations of a person's name."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadlens.functions.once import once

EMAIL = r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"
#: Local parts of roles and placeholders; those that an export counts as roles; role words on pages; roles left out of pattern inference.
ROLE_LOCALS = ("info", "hello", "support", "help", "sales", "contact", "team", "office", "careers", "jobs", "hr", "billing", "accounts", "privacy", "legal", "security", "admin", "webmaster", "newsletter", "press", "media", "example")
EXPORT_ROLES = ("info", "sales", "support", "help", "hello", "contact", "billing", "customerservice", "customersuccess", "careers", "jobs", "hr", "admin", "office", "team", "marketing", "press", "media")
ROLE_WORDS = ("info", "contact", "hello", "hi", "support", "help", "success", "customersuccess", "cs", "sales", "marketing", "growth", "press", "media", "pr", "jobs", "job", "careers", "career", "hiring", "recruiting", "recruiter", "talent", "hr", "billing", "payments", "invoices", "accounts", "accounting", "finance", "legal", "privacy", "security", "abuse", "postmaster", "webmaster", "admin", "administrator", "root", "system", "no-reply", "noreply", "donotreply", "newsletter", "news", "updates", "alerts", "notifications", "notify", "bounce", "mailer-daemon", "team", "office", "partners", "partner", "founders", "founder", "example")
INFERENCE_ROLES = ("info", "sales", "support", "hello", "marketing", "press", "admin")
#: Local-part patterns in their order of preference.
PATTERNS = ("first.last", "first_last", "firstlast", "first", "flast", "firstl", "f.last", "first.l", "first-last", "first_l", "f_last", "last", "lastfirst")
MAX_PERMUTATIONS = 6


def local(email: Column) -> Column:
    return F.lower(F.split_part(email, F.lit("@"), F.lit(1)))


def domain_split(email: Column) -> Column:
    """What follows the first @ up to the next; blank without one."""
    return F.lower(F.split_part(email, F.lit("@"), F.lit(2)))


def domain_tail(email: Column) -> Column:
    """All behind the first @; the whole string without one."""
    return F.lower(F.substring(email, F.instr(email, F.lit("@")) + 1, F.length(email)))


def extract(text: Column) -> Column:
    """Distinct addresses of a text in their order, lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(EMAIL), F.lit(0)))


def deobfuscate(text: Column) -> Column:
    """'at' and 'dot' in brackets become signs, if both occur and there is no @ yet."""
    at, dot = r"\s*[\[(]\s*at\s*[\])]\s*", r"\s*[\[(]\s*dot\s*[\])]\s*"
    low = F.lower(text)
    return F.when(~text.contains("@") & low.rlike(at) & low.rlike(dot), F.regexp_replace(F.regexp_replace(low, at, "@"), dot, ".")).otherwise(text)


def is_role_or_placeholder(email: Column) -> Column:
    """A role's address, with or without a +tag, or one that takes no replies."""
    return email.contains("@") & _role_local(local(email))


def _role_local(loc: Column) -> Column:
    base = F.regexp_replace(loc, r"^([^+]+)\+.+$", "$1")
    return loc.isin(*ROLE_LOCALS) | (loc.contains("+") & base.isin(*ROLE_LOCALS)) | loc.startswith("noreply") | loc.startswith("no-reply")


def is_export_role(email: Column) -> Column:
    """A role's address for exports: trimmed, without +tag and dots."""
    return F.replace(F.split_part(F.trim(local(email)), F.lit("+"), F.lit(1)), F.lit("."), F.lit("")).isin(*EXPORT_ROLES)


def role_like(email: Column) -> Column:
    """The local part or one of its words is a role."""
    loc = local(email)
    return F.arrays_overlap(F.array_append(F.split(loc, "[^a-z]+"), loc), F.array(*map(F.lit, ROLE_WORDS)))


def same_org(email_domain: Column, official: Column) -> Column:
    return (email_domain == official) | email_domain.endswith(F.concat(F.lit("."), official))


def email_hash(email: Column) -> Column:
    return F.sha2(F.encode(F.lower(F.trim(email)), "UTF-8"), 256)


def localpart(pattern: str, fn: Column, ln: Column) -> Column:
    """One pattern on normalised names; NULL if a part it needs is blank."""
    f1, l1 = F.substring(fn, 1, 1), F.substring(ln, 1, 1)
    value = {
        "first.last": F.concat(fn, F.lit("."), ln), "first_last": F.concat(fn, F.lit("_"), ln), "firstlast": F.concat(fn, ln), "first": fn, "flast": F.concat(f1, ln),
        "firstl": F.concat(fn, l1), "f.last": F.concat(f1, F.lit("."), ln), "first.l": F.concat(fn, F.lit("."), l1), "first-last": F.concat(fn, F.lit("-"), ln),
        "first_l": F.concat(fn, F.lit("_"), l1), "f_last": F.concat(f1, F.lit("_"), ln), "last": ln, "lastfirst": F.concat(ln, fn),
    }[pattern]
    need = fn != "" if pattern == "first" else ln != "" if pattern == "last" else (fn != "") & (ln != "")
    return F.when(need, value)


def permutations(first: Column, last: Column, preferred: Column | None = None, limit: int = MAX_PERMUTATIONS) -> Column:
    """array<struct(pattern, localpart)>: the preferred pattern first, then by preference, distinct, at most ``limit``."""
    fn, ln = (F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "") for c in (first, last))

    def usable(n: Column) -> Column:
        every = F.array(*[F.struct(F.lit(p).alias("pattern"), localpart(p, n["fn"], n["ln"]).alias("localpart")) for p in PATTERNS])
        held = lambda rows: F.filter(rows, lambda x: x["localpart"].isNotNull())
        if preferred is None:
            return held(every)
        return once(held(every), lambda rows: F.concat(F.filter(rows, lambda x: x["pattern"] == n["preferred"]), F.filter(rows, lambda x: ~F.coalesce(x["pattern"] == n["preferred"], F.lit(False)))))

    def distinct(rows: Column) -> Column:
        locals_ = F.transform(rows, lambda x: x["localpart"])
        return once(locals_, lambda own: F.filter(rows, lambda x, i: F.array_position(own, x["localpart"]) == i + 1))

    given = F.struct(fn.alias("fn"), ln.alias("ln"), (F.lit(None).cast("string") if preferred is None else preferred).alias("preferred"))
    return F.slice(once(once(given, usable), distinct), 1, limit)


def name_from_local(email: Column) -> Column:
    """A person's name from a separated local part (two title-cased pieces), else NULL."""
    parts = F.filter(F.split(F.split_part(local(email), F.lit("+"), F.lit(1)), "[._-]+"), lambda p: p.rlike("^[a-z]{2,}$"))
    return F.when(F.size(parts) >= 2, F.concat_ws(" ", F.initcap(parts[0]), F.initcap(F.element_at(parts, -1))))


def followed(local_part: Column, first: Column, last: Column) -> Column:
    """array<string>: every pattern that gives the local part from normalised names."""
    return F.array_compact(F.array(*[F.when(localpart(p, first, last) == local_part, F.lit(p)) for p in PATTERNS]))


#: Older templates beside the patterns, by preference: (first, between, last), each a part's name ("f", "l": initials).
TEMPLATES = (("first", ".", "last"), ("first", "_", "last"), ("first", "", "last"), ("f", "", "last"), ("first", "", "l"), ("f", ".", "last"), ("first", ".", "l"), ("first", "-", "last"), ("last", "", "first"), ("last", ".", "first"), ("last", "", "f"), ("l", "", "first"))


def template(parts: tuple[str, str, str], fn: Column, ln: Column) -> Column:
    """A template filled with folded names; blank parts stay blank."""
    value = {"first": fn, "last": ln, "f": F.substring(fn, 1, 1), "l": F.substring(ln, 1, 1)}
    return F.concat(value[parts[0]], F.lit(parts[1]), value[parts[2]])


def candidates(first: Column, last: Column, domain: Column, folded_first: Column, folded_last: Column, preferred: Column | None = None, only: str | None = None, cap: int = MAX_PERMUTATIONS) -> Column:
    """array<string>: the addresses to try for a person, in order; without role addresses, at most ``cap``.

    Patterns come first (the preferred one before all, cut to ``MAX_PERMUTATIONS`` before roles are
    left out), then older templates on names folded to ASCII. ``only``: one pattern, or one template as "{first}.{last}".
    """
    if only in PATTERNS:
        own = [x for x in (F.lower(F.coalesce(c, F.lit(""))) for c in (first, last))]
        locals_ = F.array(localpart(only, *(F.regexp_replace(c, "[^a-z0-9]", "") for c in own)))
    else:
        folded = F.struct(*[F.regexp_replace(c, "[^a-z0-9]", "").alias(n) for n, c in (("fn", folded_first), ("ln", folded_last))])
        filled = lambda every: once(folded, lambda n: F.array(*[template(t, n["fn"], n["ln"]) for t in every]))
        if only:
            parts = re.fullmatch(r"\{(\w+)\}(.?)\{(\w+)\}", only)
            locals_ = filled([parts.groups()]) if parts else F.array(F.lit(""))
        else:
            locals_ = F.concat(F.transform(permutations(first, last, preferred), lambda x: x["localpart"]), filled(TEMPLATES))
    dom = F.lower(F.trim(domain))
    # local parts are lower case without a sign, so each is judged before the domain is put to it
    own = F.filter(F.array_distinct(locals_), lambda x: (F.coalesce(x, F.lit("")) != "") & ~_role_local(x))
    kept = F.slice(F.transform(own, lambda x: F.concat(x, F.lit("@"), dom)), 1, max(cap, 0))
    usable = (F.concat(F.coalesce(first, F.lit("")), F.coalesce(last, F.lit(""))) != "") & (F.coalesce(domain, F.lit("")) != "")
    return F.when(usable, kept).otherwise(F.array().cast("array<string>"))


def shape(locals_: Column) -> Column:
    """The template that a domain's published local parts (array) suggest: separators, then initial and name, then name, then name and initial."""
    some = lambda pattern: F.exists(locals_, lambda x: x.rlike(pattern))
    return (
        F.when(some(r"^[^.]+\.[^.]+$"), "{first}.{last}")
        .when(some("^[^_]+_[^_]+$"), "{first}_{last}")
        .when(some("^[^-]+-[^-]+$"), "{first}-{last}")
        .when(some("^[a-z][a-z0-9]+$"), "{f}{last}")
        .when(some("^[a-z0-9]{6,}$"), "{first}{last}")
        .when(some("^[a-z0-9]+[a-z]$"), "{first}{l}")
    )


def pattern_of(local_part: Column, first: Column, last: Column) -> Column:
    """The first pattern that gives a local part from a name; NULL if none does."""
    fn, ln = (F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "") for c in (first, last))
    given = F.struct(fn.alias("fn"), ln.alias("ln"), local_part.alias("local"))
    return once(given, lambda n: F.coalesce(*[F.when(localpart(p, n["fn"], n["ln"]) == n["local"], F.lit(p)) for p in PATTERNS]))
