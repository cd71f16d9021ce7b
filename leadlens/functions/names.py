"""Names, titles and companies: normal forms and gates."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from leadlens.functions.transliteration import latin

#: Name particles that belong to the surname (of two words: both), titles and suffixes around a name, words kept low in titles, abbreviations.
PARTICLES = frozenset("da das de del della di dos du la le van von bin binti ibn al el".split())
TWO_PARTICLES = frozenset(("de la", "de los", "de las", "van der", "van de", "van den", "von der", "von den", "von dem", "auf der", "op de", "op den"))
HONORIFICS = frozenset("mr mrs ms miss mx dr prof".split())
SUFFIXES = frozenset("jr sr ii iii iv phd md mba cpa esq".split())
SMALL = frozenset("a an and as at by for in of on or the to with".split())
ABBREVIATIONS = {x.lower(): x for x in "CEO CFO COO CTO CIO CMO CRO CPO VP SVP EVP AVP HR IT PR QA R&D UI UX PhD MBA B2B SaaS AI ML".split()}
#: Legal forms: (tokens at a name's end, displayed form).
COMPANY_FORMS = (("incorporated", "Inc"), ("inc", "Inc"), ("llc", "LLC"), ("l l c", "LLC"), ("ltd", "Ltd"), ("limited", "Ltd"), ("pty ltd", "Pty Ltd"), ("gmbh", "GmbH"), ("ag", "AG"), ("sa", "SA"), ("s a", "SA"), ("bv", "BV"), ("corp", "Corp"), ("corporation", "Corp"), ("co", "Co"), ("company", "Co"), ("plc", "PLC"), ("srl", "SRL"), ("oy", "Oy"), ("ab", "AB"))


def arrow(returns: str):
    """A pandas function as a column function; the UDF is made when called, so that workers can import this module."""

    def wrap(f):
        def column(*cols):
            return F.pandas_udf(f, returns)(*cols)

        column.__doc__ = f.__doc__
        return column

    return wrap


CJK = "[一-鿿぀-ヿ가-힯]"


def collapse(c: Column) -> Column:
    """Trimmed, white space collapsed, blank as NULL."""
    return F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))


def is_cjk(c: Column) -> Column:
    return c.rlike(CJK)


def safe_name(c: Column) -> Column:
    """Only a-z and 0-9 remain."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def _fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


@arrow("string")
def nfkc(s: pd.Series) -> pd.Series:
    """NFKC, trimmed, white space collapsed; blank as NULL."""
    return s.map(lambda x: " ".join(unicodedata.normalize("NFKC", x).split()) or None, na_action="ignore")


#: Texts that are held as Python strings at once.
AT_ONCE = 64


def _folded(texts: pa.Array) -> pa.Array:
    fold = lambda x: " ".join((x.lower() if x.isascii() else latin(x)).split())
    parts = (texts.slice(k, AT_ONCE).to_pylist() for k in range(0, len(texts), AT_ONCE))
    return pa.concat_arrays([pa.array([], pa.string())] + [pa.array([None if x is None else fold(x) for x in part], pa.string()) for part in parts])


def ascii_fold(c: Column) -> Column:
    """Lower case in Latin letters (``transliteration``); what isn't ASCII then is dropped; white space collapsed."""
    return F.arrow_udf(_folded, "string")(c)


@arrow("string")
def idna(s: pd.Series) -> pd.Series:
    """A domain in NFKC, trimmed, lower case, its labels in their ASCII form if they have one."""

    def one(x: str) -> str | None:
        low = unicodedata.normalize("NFKC", x).strip().lower()
        try:
            return low.encode("idna").decode("ascii")
        except UnicodeError:
            return low

    return s.map(lambda x: one(x) if x else None, na_action="ignore")


@arrow("string")
def strip_diacritics(s: pd.Series) -> pd.Series:
    return s.map(_fold, na_action="ignore")


def split_hard(full: str | None) -> tuple[str, str]:
    """(first, last): CJK names have the surname first; particles at the end join the surname, single ones and pairs."""
    tokens = unicodedata.normalize("NFKC", full or "").split()
    if len(tokens) < 2:
        return (tokens[0] if tokens else ""), ""
    if re.search(CJK, full or ""):
        return " ".join(tokens[1:]), tokens[0]
    low = [t.lower() for t in tokens]
    cut = len(tokens) - 1
    while cut > 0:
        if low[cut - 1] in PARTICLES:
            cut -= 1
        elif cut > 1 and f"{low[cut - 2]} {low[cut - 1]}" in TWO_PARTICLES:
            cut -= 2
        else:
            break
    return " ".join(tokens[:cut]), " ".join(tokens[cut:])


def without_affixes(full: str | None) -> str:
    """A name without one honorific run in front and the suffixes behind."""
    tokens = [t for t in re.split(r"[^\w\-'.]+", (full or "").strip()) if t]
    bare = [t.strip(".").lower() for t in tokens]
    start = next((k for k, t in enumerate(bare) if t not in HONORIFICS), len(tokens))
    stop = len(tokens)
    while stop > start and bare[stop - 1] in SUFFIXES:
        stop -= 1
    return " ".join(tokens[start:stop])


def _capitals(token: str) -> str:
    """The first letter, and the first behind a hyphen or an apostrophe, as capitals."""
    return re.sub(r"([^\W\d_])([^\-–'’ʼʹꞌ]*)", lambda m: m.group(1).upper() + m.group(2).lower(), token)


def display_name(first: str | None, last: str | None) -> tuple[str, str]:
    """Both parts in display case; particles of the surname stay low."""
    out = []
    tokens = unicodedata.normalize("NFKC", last or "").split()
    for k, t in enumerate(tokens):
        low = t.lower()
        out.append(low if low in PARTICLES or (k and f"{tokens[k - 1].lower()} {low}" in TWO_PARTICLES) else _capitals(t))
    return " ".join(map(_capitals, unicodedata.normalize("NFKC", first or "").split())), " ".join(out)


def split_person(full: str | None) -> tuple[str | None, str | None]:
    """(first, last) of a full name in display case, without honorifics and suffixes; blank parts as None."""
    first, last = display_name(*split_hard(without_affixes(full)))
    return first or None, last or None


@arrow("first string, last string")
def split_name(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([split_person(x) for x in s], columns=["first", "last"], index=s.index)


@arrow("first string, last string")
def split_parts(s: pd.Series) -> pd.DataFrame:
    """First and last name as they are written; blank if there is none."""
    return pd.DataFrame([split_hard(x) for x in s], columns=["first", "last"], index=s.index)


@arrow("first string, last string, error string")
def norm_parts(first: pd.Series, last: pd.Series) -> pd.DataFrame:
    """Display case of both parts; the error name.empty if nothing is left."""
    rows = [display_name(f, x) for f, x in zip(first, last)]
    return pd.DataFrame([(f, x, None if f or x else "name.empty") for f, x in rows], columns=["first", "last", "error"], index=first.index)


@arrow("string")
def norm_person(s: pd.Series) -> pd.Series:
    """Display case of a whole name."""
    return s.map(lambda x: " ".join(filter(None, display_name(*split_hard(x)))) or None, na_action="ignore")


def _title(text: str) -> str | None:
    out = []
    for k, w in enumerate(text.split()):
        core = w.strip(".,;:")
        if core.lower() in ABBREVIATIONS:
            new = ABBREVIATIONS[core.lower()]
        elif k and core.lower() in SMALL:
            new = core.lower()
        else:
            new = "-".join(p[:1].upper() + p[1:].lower() for p in core.split("-"))
        out.append(w.replace(core, new, 1) if core else w)
    return " ".join(out) or None


@arrow("string")
def norm_title(s: pd.Series) -> pd.Series:
    return s.map(_title, na_action="ignore")


def company_key(name: str | None) -> tuple[str | None, str | None]:
    """(display, key): legal form in its usual spelling; the key has neither it, nor case, marks or diacritics."""
    text = " ".join(unicodedata.normalize("NFKC", name or "").split())
    key = " ".join(re.sub("[^0-9a-z]+", " ", _fold(text).lower()).split())
    display = text
    changed = True
    while changed:
        changed = False
        for form, shown in sorted(COMPANY_FORMS, key=lambda f: -len(f[0])):
            if key.endswith(" " + form):
                key, changed = key[: -len(form) - 1], True
                if display == text:
                    pattern = r"[,\s]+" + r"[.\s]*".join(map(re.escape, form.replace(" ", ""))) + r"\.?$"
                    display = re.sub(pattern, " " + shown, text, flags=re.I)
                break
    return display or None, key or None


@arrow("display string, key string")
def norm_company(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([company_key(x) for x in s], columns=["display", "key"], index=s.index)


#: Words that a line holds which may be a title.
TITLE_WORDS = "chief|officer|director|manager|head|lead|president|vp|engineer|founder|partner|analyst|consultant|specialist|coordinator|assistant|developer|designer|sales|marketing|counsel|ceo|cfo|cto|coo"

#: Titles known as a whole; rules, the first whose text a title holds anywhere decides (so abbreviations match inside words, as results need); words of role families and of the seniority ladder, the first met decides.
EXACT_TITLES = (
    ("ceo", "Executive", "C"), ("cto", "Engineering", "C"), ("cfo", "Finance", "C"), ("coo", "Operations", "C"), ("cio", "IT", "C"), ("cmo", "Marketing", "C"), ("cro", "Sales", "C"), ("chro", "HR", "C"), ("ciso", "Security", "C"),
    ("general counsel", "Legal", "C"), ("product manager", "Product", "IC"),
)
TITLE_RULES = (
    ("chief executive officer", "Executive", "C"), ("ceo", "Executive", "C"), ("chief revenue officer", "Sales", "C"), ("cro", "Sales", "C"), ("co-founder", "Founder", "C"), ("founder", "Founder", "C"),
    ("svp, sales", "Sales", "VP"), ("evp, sales", "Sales", "VP"), ("vp, sales", "Sales", "VP"), ("head of sales", "Sales", "Director"), ("director of sales", "Sales", "Director"), ("sales manager", "Sales", "Manager"),
    ("chief marketing officer", "Marketing", "C"), ("cmo", "Marketing", "C"), ("vp, marketing", "Marketing", "VP"), ("head of marketing", "Marketing", "Director"), ("director of marketing", "Marketing", "Director"),
    ("head of data", "Data", "Director"), ("director of data", "Data", "Director"), ("data engineer", "Data", "IC"),
    ("chief technology officer", "Engineering", "C"), ("cto", "Engineering", "C"), ("vp, engineering", "Engineering", "VP"), ("head of engineering", "Engineering", "Director"), ("director of engineering", "Engineering", "Director"),
    ("product manager", "Product", "IC"), ("head of product", "Product", "Director"),
    ("cfo", "Finance", "C"), ("chief financial officer", "Finance", "C"), ("vp, finance", "Finance", "VP"),
    ("coo", "Operations", "C"), ("chief operating officer", "Operations", "C"), ("head of operations", "Operations", "Director"),
    ("chro", "HR", "C"), ("chief human resources officer", "HR", "C"), ("general counsel", "Legal", "C"),
)
FAMILY_WORDS = (
    ("Founder", ("founder", "co-founder", "co founder", "cofounder")), ("Executive", ("ceo", "president")), ("Engineering", ("cto", "chief technology officer")), ("IT", ("cio", "chief information officer")),
    ("Marketing", ("cmo", "chief marketing officer")), ("Finance", ("cfo", "chief financial officer")), ("Sales", ("cro", "chief revenue officer")), ("HR", ("chro", "chief human resources officer", "chief people officer")),
    ("Security", ("ciso", "chief information security officer")), ("Legal", ("general counsel",)),
    ("Sales", ("sales", "revenue", "business development", "bd")), ("Marketing", ("marketing", "growth", "demand generation", "brand")), ("Customer Success", ("customer success", "customer experience", "cx", "account management")),
    ("Support", ("support", "helpdesk", "service desk")), ("Finance", ("finance", "accounting", "controller")), ("Operations", ("operations", "ops", "supply chain")), ("HR", ("human resources", "people", "talent", "recruit", "recruiting")),
    ("Legal", ("legal", "counsel", "attorney", "lawyer", "jd")), ("Product", ("product",)), ("Engineering", ("engineering", "software", "developer", "devops", "sre")), ("IT", ("information technology", "it", "sysadmin", "systems administrator")),
    ("Data", ("data", "analytics", "business intelligence", "bi", "machine learning", "ml", "ai")), ("Security", ("security", "infosec", "application security", "ciso")), ("Design", ("design", "ux", "ui", "user experience")),
)
LADDER_WORDS = (
    ("C", ("chief", "ceo", "cfo", "coo", "cto", "cmo", "cio", "ciso", "president", "general counsel", "gc")), ("VP", ("svp", "evp", "vice president", "vp")), ("Director", ("director", "head of")), ("Manager", ("manager", "mgr")),
)
#: Family and seniority where nothing else tells them.
UNTITLED = ("General Management", "IC")


def canonical_title(title: Column) -> tuple[Column, Column]:
    """(role_family, seniority): whole titles, then rules, then words; a founder counts as C; else General Management and IC."""
    low = F.lower(F.trim(F.coalesce(title, F.lit(""))))

    def first(rows: list[tuple[Column, str]]) -> Column:
        """What the first row says whose condition holds."""
        out = F
        for hit, told in rows:
            out = out.when(hit, told)
        return out

    def tell(t: Column) -> Column:
        padded = F.concat(F.lit(" "), F.regexp_replace(t, "[^a-z0-9_]", " "), F.lit(" "))
        holds = lambda own: padded.rlike(f" ({'|'.join(w.replace('-', ' ') for w in own)}) ")
        found = first([(holds(own), name) for name, own in FAMILY_WORDS])
        ladder = first([(holds(own), name) for name, own in LADDER_WORDS])
        known = [(t == x, f"{fam}|{sen}") for x, fam, sen in EXACT_TITLES] + [(t.contains(x), f"{fam}|{sen}") for x, fam, sen in TITLE_RULES]
        return F.coalesce(first(known), F.concat_ws("|", F.coalesce(found, F.lit(UNTITLED[0])), F.coalesce(ladder, F.when(found == "Founder", "C"), F.lit(UNTITLED[1]))))

    # within a lambda, so that filters which repeat it don't outgrow a compiled method
    told = F.transform(F.array(low), tell)[0]
    return F.split_part(told, F.lit("|"), F.lit(1)), F.split_part(told, F.lit("|"), F.lit(2))
