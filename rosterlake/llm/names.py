"""Variant spellings of the names of people and agencies.

Every distinct name is rewritten to its canonical forms: without titles,
suffixes and contact data, in either order, with nicknames replaced by the
names they stand for, given names cut to initials, legal forms and
abbreviations of agencies unified, and with one letter left out (two spellings
one edit apart share such a form). The forms are exploded and equi-joined. How
rare a rewriting is scores it: a form that fits one person is a link, a form
that fits several (an initial that two given names of one surname begin with)
is none.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.llm.graph import components, pairs_within
from rosterlake.session import materialise

#: Nicknames and the given names they stand for.
NICKNAMES = """
alex alexander alexandra; al albert alan alexander; andy andrew; babs barbara; barb barbara; basti sebastian bastian; bea beatrice; becca rebecca;
becky rebecca; bella isabella; ben benjamin; benji benjamin; beth elizabeth; betty elizabeth; bill william; billy william; bob robert; bobby robert;
caro caroline; charlie charles charlotte; chris christopher christian christina; chuck charles; dan daniel; danny daniel; dave david; deb deborah;
debbie deborah; dick richard; dora dorothea theodora; doug douglas; ed edmund edward edgar; eddie edmund edward; ferdi ferdinand; flick felicity;
fran frances francesca; frank francis franklin; fred frederick alfred; freddie frederick; gabe gabriel; gene eugene; gerry gerald gerard;
greg gregory; gwen gwendolyn; hal harold henry; harry harold henry; hattie harriet; izzy isabella isabel; jackie jacqueline; jake jacob; jamie james;
jim james; jimmy james; jo joanna josephine; joe joseph; jon jonathan; jonny jonathan; johnny john jonathan; josh joshua; judy judith; kate katherine;
kat katherine; kathy katherine; katie katherine; ken kenneth; kit christopher; kris kristina kristian; lena magdalena helena; len leonard; leo leonard;
letty leticia; liz elizabeth; lizzie elizabeth; maggie margaret; magda magdalena; matt matthew; meg margaret; mick michael; mike michael; nat nathaniel natalia;
nate nathaniel; ned edmund edward; nick nicholas; nico nicholas; pam pamela; pat patricia patrick; peggy margaret; penny penelope; pete peter;
pippa philippa; rach rachel; rafa rafael; ray raymond; rick richard; rob robert; rosie rosalind; roz rosalind; sam samuel samantha;
sandy alexander sandra; sasha alexander alexandra; seb sebastian; steve stephen; sue susanna; susie susanna; ted theodore edward; tess theresa;
thea dorothea theodora; theo theodore; tilly matilda; tim timothy; tina kristina christina valentina; toby tobias; tom thomas; tommy thomas; toni antonia;
tony anthony; tori victoria; tricia patricia; vicky victoria; vince vincent; vlad vladimir; volodya vladimir; will william; zoli zoltan
"""
#: Titles and suffixes that are no part of a name.
TITLES = frozenset("mr mrs ms miss mx dr prof ing dipl sir dame lady herr frau sig sra sr mme mlle hon rev".split())
SUFFIXES = frozenset("jr sr ii iii iv phd msc bsc mba md ma ba cv resume pmp esq she her hers he him his they them their".split())
#: Legal forms of companies.
LEGAL = frozenset("gmbh mbh gesellschaft ltd limited inc incorporated llc llp plc corp corporation co sa sas sarl srl spa bv nv ag kg oy ab as aps pty lda the".split())
#: Words of agency names with their abbreviations.
AGENCY = """
talent; partners ptnrs partner; staffing; services svcs service svc; careers; recruitment recruiting recruit; group grp; executive exec; technical tech;
resourcing; people; advisory; search; selection; international intl; consulting consultants; agency; solutions; associates assoc; personnel; hr; jobs; hiring
"""

_NICK = {n: tuple(full) for line in NICKNAMES.replace("\n", " ").split(";") if (p := line.split()) for n, *full in [p]}
_WORDS = {short: words[0] for line in AGENCY.replace("\n", " ").split(";") if (words := line.split()) for short in words}

_MAIL = re.compile(r"[\w.+-]+\s*(?:@|\(at\)|\[at\]|\{at\}|\s+at\s+)\s*[\w-]+(?:\s*(?:\.|\(dot\)|\[dot\]|\s+dot\s+)\s*[\w-]+)+", re.I)
_PHONE = re.compile(r"(?:\+|\(|\b)\d[\d\s()./+-]*(?:\s*(?:ext|x)\.?\s*\d+)?", re.I)
_BRACKET = re.compile(r"[(\[<{][^()\[\]<>{}]*[)\]>}]")
_TOKEN = re.compile(r"[^\W\d_]+")
_NOBODY = frozenset({"unknown", "candidate", "anonymous", "none", "null", "na", "applicant"})


def fold(text: str) -> str:
    """Lower case without accents."""
    text = unicodedata.normalize("NFKD", text.casefold())
    return "".join(c for c in text if not unicodedata.combining(c)).replace("ø", "o").replace("ł", "l").replace("æ", "ae")


def clean(name: str) -> str:
    """The name without contact data and remarks in brackets."""
    name = _MAIL.sub(" ", name)
    name = _BRACKET.sub(" ", _PHONE.sub(" ", name))
    return re.sub(r"[\s,;|/–—-]+$", "", name).strip()


def _tokens(part: str) -> list[str]:
    """Letters run together over hyphens and apostrophes; dotted initials apart."""
    return _TOKEN.findall(re.sub(r"(?<=\w\w)['’‐-](?=\w\w)", "", part))


def parse(name: str) -> tuple[str, list[str], list[str]] | None:
    """(kind, full tokens, initials) of a name; None if it names nobody."""
    text = fold(clean(name))
    plain = re.sub(r"\b([a-z])\.\s?([a-z])\.(?=\s|,|$)", r"\1\2", text)  # s.a. and b.v.
    words = _TOKEN.findall(plain)
    agency = [w for w in words if w in _WORDS]
    if agency and len(words) >= 2:
        head = [w for w in words if w not in _WORDS and w not in LEGAL and w not in ("and", "und", "y", "et") and len(w) > 2]
        if head:
            # an agency's rarest word, then the first of its describing words
            return "agency", ["".join(head), _WORDS[agency[0]]], []
    comma = text.split(",", 1)
    given_first = len(comma) == 1 or not _names(comma[1]) or not _names(comma[0])
    if given_first:
        found = _names(text)
    else:
        family = [w for w in _names(comma[0]) if len(w) > 1]
        found = _names(comma[1]) + (["".join(family)] if family else [])
    if not found or set(found) <= _NOBODY:
        return None
    full, initials = [w for w in found if len(w) > 1], [w for w in found if len(w) == 1]
    if given_first and len(full) >= 3:
        # given, middle, family: the middle name is one more name that may be left out
        full = [full[0], full[-1]]
    elif len(full) >= 3:
        full = [full[0], full[-1]]
    return ("person", full, initials) if full else None


def _names(part: str) -> list[str]:
    return [w for w in _tokens(part) if w not in TITLES and w not in SUFFIXES]


_ENTITY = "name string, entity bigint, kind string, a string, b string, initial string"


def entities(names: DataFrame, column: str) -> DataFrame:
    """(name, entity, kind, a, b, initial) of each distinct name that names somebody.

    Names with one entity differ only in titles, order, accents, case, middle
    names, legal form or contact data. a and b are its two tokens in
    alphabetical order; an entity with an initial has one token, a.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name in batch.column(0).to_pylist():
                got = parse(name)
                if got is None:
                    continue
                kind, full, initials = got
                if kind == "agency":
                    rows.append((name, "agency " + " ".join(full), kind, full[0], full[1], None))
                elif len(full) == 2:
                    a, b = sorted(full)
                    rows.append((name, f"person {a} {b}", kind, a, b, None))
                elif initials:
                    rows.append((name, f"initial {full[0]} {initials[0]}", "initial", full[0], None, initials[0]))
                else:
                    rows.append((name, f"single {full[0]}", "single", full[0], None, None))
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in range(6)]
            kinds = (pa.string(), pa.int64(), *[pa.string()] * 4)
            cols[1] = [_hash(e) for e in cols[1]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["name", "entity", "kind", "a", "b", "initial"])

    distinct = names.select(F.col(column).alias("name")).filter(F.col("name").isNotNull() & (F.trim("name") != "")).distinct()
    return distinct.mapInArrow(run, _ENTITY)


def _shorter(token: str) -> list[str]:
    """The token and the token with one letter left out. Very long ones, which no name is, stand for themselves alone."""
    return [token, *({token[:i] + token[i + 1 :] for i in range(len(token))} if len(token) <= LONGEST else ())]


#: Words of more letters are no names; they get no misspelt forms.
LONGEST = 64
_FORM = "form bigint, way string, entity bigint, token string"


def _hash(text: str) -> int:
    h = xxhash.xxh3_64_intdigest(text)
    return h - (1 << 64) if h >> 63 else h


def forms(found: DataFrame, known: DataFrame) -> DataFrame:
    """Every canonical rewriting of the entities of people and agencies: (form, way, entity, token).

    ``known`` is (token, name): misspelt given names with the one they stand for.

    A form is the hash of the token that stayed and of what became of the other
    one, ``token``. ``way`` is plain (as written), nick, typo, initial or slip (a
    typo beside an initial).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2_000):
                batch = whole.slice(at, 2_000)
                out = []
                for entity, kind, a, b, initial, right_a, right_b in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                    if kind == "person":
                        for token, other, right in ((a, b, right_b), (b, a, right_a)):
                            out.append((_hash(f"{other}|{token}"), "plain", entity, token))
                            out.extend((_hash(f"{other}|{full}"), "nick", entity, token) for full in _NICK.get(token, ()))
                            if len(token) >= 4:
                                short, meant = _shorter(token), (other, *_NICK.get(other, ()), *((right,) if right else ()))
                                out.extend((_hash(f"{m}|{s}"), "typo", entity, token) for m in meant for s in short)
                                out.extend((_hash(f"{i}|{s}"), "slip", entity, token) for i in {m[0] for m in meant} for s in short)
                            out.extend((_hash(f"{other}|{i}"), "initial", entity, token) for i in {token[0], *(n[0] for n in _NICK.get(token, ()))})
                    elif kind == "initial":
                        out.append((_hash(f"{a}|{initial}"), "initial", entity, a))
                        if len(a) >= 5:
                            out.extend((_hash(f"{initial}|{s}"), "slip", entity, a) for s in _shorter(a))
                    elif kind == "agency":
                        out.extend((_hash(f"{b}|{s}"), "typo", entity, a) for s in _shorter(a))
                cols = list(zip(*out, strict=True)) if out else [[] for _ in range(4)]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["form", "way", "entity", "token"])

    one = found.select("entity", "kind", "a", "b", "initial").distinct()
    for side in ("a", "b"):
        one = one.join(known.select(F.col("token").alias(side), F.col("name").alias(f"right_{side}")), side, "left")
    return one.select("entity", "kind", "a", "b", "initial", "right_a", "right_b").mapInArrow(run, _FORM)


def misspelt(often: DataFrame) -> DataFrame:
    """(token, name): tokens that are one edit from just one token of at least :data:`OFTENER` times their partners; ``often`` is (token, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(_hash(s), t, n) for t, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if len(t) >= 4 for s in _shorter(t)]
            cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], ["form", "token", "n"])

    near = often.select("token", "n").mapInArrow(run, "form bigint, token string, n bigint")
    given = near.filter(F.col("n") >= OFTENER).select("form", F.col("token").alias("name"), F.col("n").alias("m"))
    met = near.join(given, "form").filter(F.col("m") >= OFTENER * F.col("n")).filter(one_edit(F.col("token"), F.col("name")))
    return met.groupBy("token").agg(F.min("name").alias("name"), F.count_distinct("name").alias("k")).filter("k = 1").select("token", "name")


#: A token with so many times the partners of one that is an edit away may be what that one is misspelt for. A ratio, as both counts grow with the data.
OFTENER = 5


#: A rewriting links if more than this of what it could stand for is one person.
RARE = 0.5


def rare(met: DataFrame) -> DataFrame:
    """Rows whose rewriting is rare enough, with ``score``: one over ``k``, the number of people that it could stand for."""
    return met.withColumn("score", 1 / F.col("k")).filter(F.col("score") > RARE)


def people(df: DataFrame, column: str = "name") -> DataFrame:
    """(person, name): every distinct value that names somebody, with a number of whom it names.

    Null and blank names, and names that name nobody ("Unknown candidate"), give
    no row; equal values count once. Other columns don't matter, whatever their
    names; an empty table gives no rows.
    """
    found = materialise(entities(df, column), "entities")
    # in how many entities a token stands: given names in many, misspellings in one
    held = found.filter("kind in ('person', 'agency')").select("entity", F.explode(F.array("a", "b")).alias("token")).distinct()
    often = materialise(held.groupBy("token").agg(F.count("*").alias("n")), "tokens")
    rewritten = materialise(forms(found, materialise(misspelt(often), "misspelt")), "forms")

    # a nickname with one family name is a link if just one of the names it stands for exists with it
    plain = rewritten.filter("way = 'plain'").select("form", F.col("entity").alias("to"))
    short = rewritten.filter("way = 'nick'").select("form", "entity")
    hits = short.join(plain, "form").filter("entity != to").groupBy("entity").agg(F.min("to").alias("to"), F.count_distinct("to").alias("k"))
    by_nick = rare(hits).select("entity", "to")
    # two nicknames of one name, where the name itself doesn't occur
    lone = short.join(plain.select("form"), "form", "left_anti")
    by_twin = lone.join(lone.groupBy("form").agg(F.min("entity").alias("to")), "form").select("entity", "to").filter("entity != to").distinct()

    # one edit apart with the other token alike
    typo = rewritten.filter("way = 'typo'").select("form", "entity", "token")
    several = typo.groupBy("form").agg(F.min("token").alias("least"), F.max("token").alias("most")).filter("least != most").select("form")
    met = materialise(typo.join(several, "form", "left_semi").distinct(), "met").join(often, "token")
    usual = met.groupBy("form").agg(F.max(F.struct("n", "token", "entity")).alias("top"))
    near = met.join(usual, "form").filter(F.col("entity") != F.col("top.entity"))
    near = near.select("entity", F.col("top.entity").alias("to"), "token", F.col("top.token").alias("wanted"), "n", F.col("top.n").alias("m"))
    near = materialise(near.filter(one_edit(F.col("token"), F.col("wanted"))).distinct(), "near")
    # a token with partners of its own, whether given or family name, is no misspelling unless the other has many times as many
    shared = near.select("token", "wanted", "entity").distinct().groupBy("token", "wanted").agg(F.count("*").alias("shared"))
    by_typo = near.join(shared, ["token", "wanted"]).filter((F.col("shared") == F.col("n")) | (F.col("m") >= OFTENER * F.col("n"))).select("entity", "to").distinct()

    first = materialise(components(by_nick.unionByName(by_twin).unionByName(by_typo), "entity", "to"), "people")
    people = found.select("entity", "kind").distinct().join(first, "entity", "left").withColumn("person", F.coalesce("component", "entity"))

    # an initial is a link if all that it can stand for is one person
    initial = rewritten.filter("way = 'initial'").select("form", "entity").distinct().join(people, "entity")
    full = initial.filter("kind = 'person'").groupBy("form").agg(F.min("person").alias("person"), F.count_distinct("person").alias("k"))
    full = rare(full)
    by_initial = initial.filter("kind = 'initial'").select("form", "entity").join(full, "form").select("entity", F.col("person").alias("meant"))
    # a misspelt family name with an initial: just one person within one edit, and nobody of that very name
    slips = rewritten.filter("way = 'slip'").select("form", "entity", "token")
    lonely = people.filter("kind = 'initial'").join(by_initial.select("entity"), "entity", "left_anti").select("entity")
    alone = slips.join(lonely, "entity", "left_semi").select("form", "entity", F.col("token").alias("written"))
    close = alone.join(slips.select("form", "token", F.col("entity").alias("of")), "form").filter(one_edit(F.col("written"), F.col("token")))
    close = close.select("entity", "of").distinct().join(people.filter("kind = 'person'").select(F.col("entity").alias("of"), "person"), "of")
    close = rare(close.groupBy("entity").agg(F.min("person").alias("meant"), F.count_distinct("person").alias("k"))).select("entity", "meant")
    people = people.join(by_initial.unionByName(close).groupBy("entity").agg(F.min("meant").alias("meant")), "entity", "left")
    people = people.select("entity", F.coalesce("meant", "person").alias("person"))

    return materialise(found.select("name", "entity").join(people, "entity").select("person", "name").distinct(), "named")


def groups(df: DataFrame, column: str = "name") -> DataFrame:
    """(name, group_name, n_links): one row per spelling that has others beside it; group_name is the least of them."""
    named = people(df, column)
    sizes = named.groupBy("person").agg(F.min("name").alias("group_name"), F.count("*").alias("n")).filter("n > 1")
    return named.join(sizes, "person").select("name", "group_name", (F.col("n") - 1).alias("n_links"))


def variants(df: DataFrame, column: str = "name") -> DataFrame:
    """(name_a, name_b), name_a < name_b by code point: different values that name the same person or agency, of :func:`people`."""
    named = people(df, column)
    return pairs_within(named, "person", "name").select(F.col("x").alias("name_a"), F.col("y").alias("name_b")).distinct()


def one_edit(a, b):
    """One letter added, dropped or changed, or two neighbours swapped."""
    swapped = (F.length(a) == F.length(b)) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))
    return (F.levenshtein(a, b) <= 1) | (swapped & (F.levenshtein(a, b) == 2))
